"""Registered queries against their SQL on the smallest tables, where they are present."""

import os

import duckdb
import pytest

from corpusweave import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, FOLDER)
    if name not in registry.oracle_sql():
        assert got.count() > 0
        return
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(plain(tuple(r)) for r in got.select(*want.columns).collect()) == sorted(plain(r) for r in want.fetchall())


def test_every_part_name_is_scored(spark):
    """The shortlist of each distinct name over all names, by plain code."""
    from corpusweave.functions.similarity import composite
    from corpusweave.operators.resolve import FLOOR, SHORTLIST, TIE_BAND

    names = sorted({r[0] for r in spark.read.parquet(f"{FOLDER}/part.parquet").select("p_name").collect()})
    want = set()
    for m in names:
        scores = {n: composite(m, n) for n in names}
        best = max(scores.values())
        order = sorted(names, key=lambda n: (best - scores[n] > TIE_BAND, -scores[n], n))
        want |= {(m, n) for n in [n for n in order if scores[n] >= FLOOR][:SHORTLIST]}
    got = registry.queries()["x11_fuzzy_score"](spark, FOLDER)
    assert {(r["mention"], r["name"]) for r in got.collect()} == want and got.select("mention").distinct().count() == len(names)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 8
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
