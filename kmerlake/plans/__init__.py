"""Registered queries and the views they run on."""

from kmerlake.plans import annotation, genotyping, models, results

_MODULES = (genotyping, annotation, results, models)
QUERIES = {name: f for m in _MODULES for name, f in m.Q.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
