"""Operators for preparing training text at scale.

Each module holds one operator with a general interface; ``queries`` registers
the thin ``opN_<name>`` queries.  Nothing outside this subpackage imports it.
"""
