"""Queries of the subpackage against their SQL, and how good the trained ones are on held-out rows."""

import os
import zlib

import numpy as np
import pytest

duckdb = pytest.importorskip("duckdb")

from auditspark.llm import queries, sql  # noqa: E402
from tests.test_oracles import SF, TABLES, compare  # noqa: E402

SF_01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_oracle(spark, db, name):
    compare(spark, db, queries.QUERIES[name], sql.SQL[name])


def test_held_out_language(spark):
    got = {r["doc_id"]: r for r in queries.op7_language(spark, SF_01).collect()}
    docs = spark.read.parquet(f"{SF_01}/documents.parquet").collect()
    held = [(got[r["doc_id"]]["lang_pred"], r["lang"]) for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(got) == len(docs) and np.mean([a == b for a, b in held]) > 0.98


def test_held_out_toxicity(spark):
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, SF_01).collect()}
    labels = spark.read.parquet(f"{SF_01}/labels.parquet").collect()
    held = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.93


def test_recall(spark):
    got = queries.op3_neighbours(spark, SF_01).collect()
    rows = spark.read.parquet(f"{SF_01}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r["vec_id"] for r in rows])
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -9
        want = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        hits += len(want & {r["vec_id"] for r in got if r["query_id"] == ids[i]})
        total += 5
    assert hits >= 0.9 * total
