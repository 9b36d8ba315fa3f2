"""Queries against their SQL over the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

import __spark_entry__ as entry  # noqa: E402
from auditspark.plans import oracles, queries  # noqa: E402


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return float(v) if not isinstance(v, str) and hasattr(v, "__float__") else v


def compare(spark, con, query, sql):
    got = query(spark, SF)
    names = sorted(got.columns)
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    want = [tuple(plain(r[columns.index(n)]) for n in names) for r in cur.fetchall()]
    have = [tuple(plain(r[n]) for n in names) for r in got.collect()]
    assert sorted(have, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_oracle(spark, db, name):
    compare(spark, db, queries.QUERIES[name], oracles.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["claim_id", "verdict", "rationale"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bounded_search_where_other_numbers_are_equal(spark, tmp_path):
    """Numbers that the header line holds anyway (12, 34, and the 7 that is appended), and none."""
    rows = [(i, n) for i, n in enumerate([12, 12, 34, 34, 7, 7, 2, 2, 127, 1, None, None])]
    spark.createDataFrame(rows, "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["bounded_search"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, got)) == sorted(con.execute(oracles.SQL["bounded_search"]).fetchall())
