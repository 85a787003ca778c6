"""Every registered query against its oracle on the small tables."""

import decimal

import duckdb
import pytest

from kmerlake.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"feature_importance", "importance_coords", "oob_accuracy", "forest_predict"}


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, sf_dir, duck, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs_without_oracle(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 20


def test_nothing_imports_the_text_operators():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "kmerlake"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "kmerlake.llm" in p.read_text()]
