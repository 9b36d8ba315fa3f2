"""Ranked lexical search against a plain loop, with small shards and slabs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from auditspark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOC, ITEM = "doc_id long, text string, shard int, id string, items int, score int, asked string", "item_id long, text string, slab int, term string, w int"


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        found = []
        for doc, bag in bags:
            m = 50 + (50 * sum(bag.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in wanted if t in bag)
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "éTÉ", "中文", "x y", "A-b", "_", "ß"]
    text = lambda n: rng.choice([" ", "\n", "_", "-"]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.choice([1, 2, 5, 30]))) for i in range(150)]
    docs += [(3, docs[9][1]), (None, docs[5][1]), (None, docs[5][1]), (500, None), (501, ""), (502, "_- \t"), (503, "Long " * 30000)] + [(600 + i, "same words") for i in range(20)]
    items = [(i, text(rng.choice([1, 3, 8]))) for i in range(25)] + [(25, "SAME"), (26, None), (27, "..."), (4, "w1 w2"), (None, "w3"), (28, "unheard"), (29, "long")]
    return docs, items


@pytest.mark.parametrize("shard, slab, few", [(1 << 14, 50_000, 16), (7, 9, 16), (7, 9, 1)])
def test_against_plain_loop(spark, monkeypatch, shard, slab, few):
    docs, items = corpus(1)
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "SLAB", slab)
    monkeypatch.setattr(lexical, "BROADCAST_SLABS", few)
    d = spark.createDataFrame([(*x, 1, "c", 2, 3, "z") for x in docs], DOC).repartition(3)
    q = spark.createDataFrame([(*x, 1, "t", 2) for x in items], ITEM)
    got = sorted((tuple(r) for r in lexical.rank_documents(d, q, 5).collect()), key=str)
    assert got == brute(docs, items, 5)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a", 0, "b", 0)], ITEM)
    assert lexical.rank_documents(docs, items).count() == 0
    full = spark.createDataFrame([(1, "a b", 0, "", 0, 0, "")], DOC)
    assert lexical.rank_documents(full, items.limit(0)).count() == 0
    assert lexical.rank_documents(full, items).count() == 0 or lexical.rank_documents(full, items).first()["doc_id"] == 1


def test_selection_keeps_smallest_ids_of_a_tie():
    scores, ids = np.array([5, 7, 5, 5, 0, 9]), np.array([4, 9, 1, 3, 0, 8])
    for k in range(1, 7):
        at = lexical.select_top(scores, ids, np.zeros(6, bool), k)
        want = sorted((-s, i) for s, i in zip(scores, ids) if s > 0)[:k]
        assert sorted((-scores[x], ids[x]) for x in at) == want


def test_length_measures_do_not_overflow():
    assert lexical.length_measures(np.array([10**9]), 10**12, 10**13).tolist() == [50 + 50 * 10**9 * 10**12 // 10**13]


@pytest.mark.parametrize("held", [1, 60, 2000])
def test_candidates_of_a_task_are_merged_whenever_they_are_many(spark, monkeypatch, held):
    docs, items = corpus(2)
    monkeypatch.setattr(lexical, "SHARD_DOCS", 4)
    monkeypatch.setattr(lexical, "SLAB", 30)
    monkeypatch.setattr(lexical, "HELD", held)
    got = lexical.rank_documents(spark.createDataFrame([(*x, 1, "c", 2, 3, "z") for x in docs], DOC).coalesce(1), spark.createDataFrame([(*x, 1, "t", 2) for x in items], ITEM), 5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, 5)


def test_best_of_candidates():
    rng = np.random.default_rng(5)
    key, score, ids, null = rng.integers(0, 9, 400), rng.integers(1, 12, 400), rng.permutation(400), rng.random(400) < 0.1
    for k in (1, 3, 50):
        want = [x for j in range(9) for x in sorted((int(j), int(-s), bool(z), int(i)) for q, s, i, z in zip(key, score, ids, null) if q == j)[:k]]
        q, s, i, z = lexical.best_of(key, score, ids, null, k)
        assert list(zip(q.tolist(), (-s).tolist(), z.tolist(), i.tolist())) == want


def test_a_task_holds_one_shard_and_few_texts_at_a_time(spark):
    """A split of 3 million words, most of them seen once: a reader's batch of the index is a row group, and none has a row of 40 MB or all rows of the split."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(size)
    docs = spark.range(50).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 60000), x -> hex(x * (id + 3000)))) AS text").coalesce(1)
    index, n_docs = lexical.build_index(docs)
    assert n_docs == 50 and index.count() >= 5 and index.selectExpr("sum(size(ids))").first()[0] == 50
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    groups = [m.row_group(g) for m in files for g in range(m.num_row_groups)]
    assert max(g.total_byte_size for g in groups) < 16e6
    assert not any(g.column(c).is_stats_set for g in groups for c in range(g.num_columns))  # a writer would hold whole shards as least and greatest values
    assert int(spark.conf.get(size)) <= 4 << 20
