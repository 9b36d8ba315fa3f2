"""Ranked lexical search over postings in shards of documents.

Each task cuts the documents it reads into shards and writes one row for each: the postings of all terms in compressed sparse
rows (sorted terms, where each one's postings begin, places of documents, integer impacts; each the bytes of an array, as
Spark's readers hold 12 bytes of levels and room for each entry of a list of numbers). Impacts are worked out when the
index is built, from the counts of all documents. A search reads the vocabularies alone for the number of documents of each
asked term, then the postings: for each item, term by term, into a dense accumulator of the shard's documents, of which the
k best are selected, ties by id; what a task's shards found is merged in the task, what tasks found in two steps, so an item's
rows meet in no single large task. Documents are never shuffled. Items are searched in slabs of bounded size.

A task holds a batch of texts, one shard of some megabytes and a bounded number of candidates, however large the table and its
splits are.

Terms are known by 64-bit hashes of their bytes. Two of 10^5 terms of a shard share one with a chance of 3 in 10^10.

Nulls and odd input: a null text, or one without terms, is no document and no item; rows with equal item ids are one item
with the terms of all; each row of a repeated document is ranked, equal scores by ascending id with null ids last; null
item ids are one item; very long texts are indexed whole; an empty table gives an empty result; only the id and the text
are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WIDE, cut, small_batches
from .words import chunks, words

#: A shard ends after so many words or documents; terms of a slab of items, and up to how many slabs are broadcast (16 bytes a term).
SHARD_WORDS, SHARD_DOCS, SLAB, BROADCAST_SLABS = 1 << 19, 1 << 14, 50_000, 16
#: A task merges what its shards found when it holds so many candidates.
HELD = 1 << 18
#: Into so many parts each item's candidates are merged before all of them are, and slabs too many for a broadcast are dealt.
PARTS = 32
#: Bytes of terms: ASCII letters and digits, and all of longer UTF-8 sequences.
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True


def _counts(batches):
    for batch in batches:
        docs = terms = 0
        for _, data, offsets in chunks(batch.column(0)):
            inside = TERM[data]
            starts = inside.copy()
            starts[1:] &= ~inside[:-1]
            begins = offsets[:-1][np.diff(offsets) > 0]
            starts[begins] = inside[begins]  # a term doesn't go on into the next text
            each = np.add.reduceat(starts, begins, dtype=np.int64) if len(begins) else np.zeros(0, np.int64)
            docs, terms = docs + int((each > 0).sum()), terms + int(each.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], ["n_docs", "n_terms"])


def collection_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and the terms of all of them with repeats."""
    both = docs.select("text").mapInArrow(_counts, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return both[0] or 0, both[1] or 0


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def length_measures(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 50 + ((50 * n * n_docs) div n_terms), in whole numbers that can't overflow on the way."""
    return np.array([100 - 50 + (50 * x * n_docs) // n_terms for x in n.tolist()], np.int64)


def _shard(hashes: list, lengths: list, ids: list, kind, n_docs: int, n_terms: int) -> dict:
    """Postings of some documents: their terms' hashes in order, numbers of terms, and ids."""
    n = np.concatenate(lengths)
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")  # documents stay in order within a term
    doc, h = np.repeat(np.arange(len(n), dtype=np.int32), n)[order], h[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
    starts = np.flatnonzero(new)
    tf = np.diff(np.append(starts, len(h)))
    doc, h = doc[starts], h[starts]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    impact = impacts(tf, length_measures(n, n_docs, n_terms)[doc])
    ids = pa.concat_arrays(ids).cast(kind)
    return {"ids": ids, "terms": h[first], "begins": np.append(first, len(h)).astype(np.int32), "docs": doc, "impacts": impact.astype(np.int32)}


def _indexer(kind: pa.DataType, n_docs: int, n_terms: int):
    def run(batches):
        shard, held, hashes, lengths, ids, words_held = TaskContext.get().partitionId() << 32, 0, [], [], [], 0

        def row():
            found = _shard(hashes, lengths, ids, kind, n_docs, n_terms)
            ids_found = pa.ListArray.from_arrays([0, len(found["ids"])], found.pop("ids"))
            return pa.RecordBatch.from_arrays([pa.array([shard]), ids_found, *(pa.array([x.tobytes()]) for x in found.values())], ["shard", "ids", *found])

        for batch in batches:
            for first, data, offsets in chunks(batch.column(1)):
                h, begins = words(data, offsets, TERM)
                n = np.diff(begins)
                have = np.flatnonzero(n)
                if not len(have):
                    continue
                hashes.append(h)
                lengths.append(n[have])
                ids.append(batch.column(0).take(pa.array(first + have)))
                held, words_held = held + len(have), words_held + len(h)
                if held >= SHARD_DOCS or words_held >= SHARD_WORDS:
                    yield row()
                    shard, held, hashes, lengths, ids, words_held = shard + 1, 0, [], [], [], 0
        if held:
            yield row()

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, int]:
    """(one row for each shard: shard, ids, terms, begins, docs, impacts; the number of documents with a term), written."""
    small_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), "text")
    n_docs, n_terms = collection_size(rows)
    schema = "shard long, ids array<long>, terms binary, begins binary, docs binary, impacts binary"
    return cut(rows.mapInArrow(_indexer(pa.int64(), n_docs, n_terms), schema), "lexical-index", **WIDE), n_docs


def _item_terms(batches):
    for batch in batches:
        for first, data, offsets in chunks(batch.column(1)):
            h, begins = words(data, offsets, TERM)
            item = np.repeat(np.arange(len(offsets) - 1) + first, np.diff(begins))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(item)), pa.array(h.view(np.int64))], ["item_id", "term"])


def _numbers(batch: pa.RecordBatch, row: int, *names: str) -> list[np.ndarray]:
    """A shard's arrays, without a copy of their bytes."""
    return [np.frombuffer(batch.column(x)[row].as_buffer(), np.uint64 if x == "terms" else np.int32) for x in names]


def _places(terms: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which asked terms are among a shard's, and where."""
    asked = asked.view(np.uint64)
    at = np.searchsorted(terms, asked).clip(max=len(terms) - 1)
    there = np.flatnonzero(terms[at] == asked)
    return there, at[there]


def _document_counts(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            asked = batch.column("asked")[i].values.to_numpy()
            terms, begins = _numbers(batch, i, "terms", "begins")
            there, at = _places(terms, asked)
            yield pa.RecordBatch.from_arrays([pa.array(asked[there]), pa.array((begins[at + 1] - begins[at]).astype(np.int64))], ["term", "df"])


def select_top(scores: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal ones by ascending id and null ids last."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        s = scores[at]
        least = s[np.argpartition(s, len(s) - k)[len(s) - k]]
        above, ties = at[s > least], at[s == least]
        ties = ties[np.lexsort((ids[ties], null[ties]))][: k - len(above)]
        at = np.concatenate((above, ties))
    return at


def best_of(key: np.ndarray, score: np.ndarray, id_: np.ndarray, null: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Each key's k best of these candidates, as select_top picks them."""
    order = np.lexsort((id_, null, -score, key))
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    order = order[rank < k]
    return key[rank < k], score[order], id_[order], null[order]


def _searcher(k: int):
    def run(batches):
        part, names, held, n = TaskContext.get().partitionId() % PARTS, {}, [], 0

        def merged():
            return best_of(*(np.concatenate(x) for x in zip(*held)), k)

        def rows(key, score, id_, null):
            slab = key >> 32
            for s in np.unique(slab).tolist():
                own = slab == s
                items = names[s].take(pa.array(key[own] & 0xFFFFFFFF))
                yield pa.RecordBatch.from_arrays([items, pa.array(id_[own], mask=null[own]), pa.array(score[own]), pa.array(np.full(own.sum(), part, np.int32))], ["item_id", "doc_id", "score", "part"])

        for batch in batches:
            for i in range(batch.num_rows):
                ids, slab = batch.column("ids")[i].values, batch.column("slab")[i].as_py()
                null = ids.is_null().to_numpy(zero_copy_only=False)
                plain = ids.fill_null(0).to_numpy()
                terms, begins, docs, impact = _numbers(batch, i, "terms", "begins", "docs", "impacts")
                items = batch.column("items")[i].values
                asked = items.field("asked")
                ends, inner = np.asarray(asked.offsets) - asked.offsets[0].as_py(), asked.flatten()
                there, at = _places(terms, inner.field("term").to_numpy())
                weights, of = inner.field("w").to_numpy()[there], np.searchsorted(ends, there, "right") - 1
                total, found = np.zeros(len(plain), np.int64), []
                bounds = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))) if len(of) else []
                for b, e in zip(bounds[:-1], bounds[1:]):
                    total.fill(0)
                    for t, w in zip(at[b:e].tolist(), weights[b:e].tolist()):
                        some = slice(begins[t], begins[t + 1])
                        total[docs[some]] += w * impact[some].astype(np.int64)
                    top = select_top(total, plain, null, k)
                    found.append((np.full(len(top), slab << 32 | int(of[b])), total[top], plain[top], null[top]))
                if not found:
                    continue
                held.append(tuple(np.concatenate(x) for x in zip(*found)))
                n += len(held[-1][0])
                if slab not in names:  # a copy: the ids alone, not the batch that they came in
                    names[slab] = pa.concat_arrays([items.field("item_id"), items.field("item_id")[:0]])
                if n >= HELD:
                    held = [merged()]
                    n = len(held[0][0])
                    if n >= HELD // 2:
                        yield from rows(*held[0])
                        names, held, n = {}, [], 0
        if n:
            yield from rows(*merged())

    return run


def _with_slabs(index: DataFrame, slabs: DataFrame, n: int) -> DataFrame:
    """Each shard's row beside each slab's: by a broadcast of few slabs, else dealt by slab and part of the shards."""
    rows = index.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if n <= BROADCAST_SLABS:
        return rows.join(F.broadcast(slabs), "slab")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(PARTS)))
    return rows.join(slabs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))), ["slab", "part"]).drop("part")


def search_index(index: DataFrame, n_docs: int, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score of each item's (item_id, text) k best documents."""
    kind = dict(items.dtypes)["item_id"]
    asked = cut(items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {kind}, term long").distinct(), "lexical-items")
    n = max(1, -(-asked.count() // SLAB))
    deal = lambda key: F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("slab")
    vocabulary = asked.select("term").distinct().groupBy(deal("term")).agg(F.collect_list("term").alias("asked"))
    counts = _with_slabs(index.select("shard", "terms", "begins"), vocabulary, n).select("terms", "begins", "asked")
    df = counts.mapInArrow(_document_counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * n_docs + 2) / (2 * F.col("df") + 1))).alias("w")
    weighed = asked.join(df.select("term", weight), "term").groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("asked"))
    slabs = cut(weighed.groupBy(deal("item_id")).agg(F.collect_list(F.struct("item_id", "asked")).alias("items")), "lexical-slabs")
    found = _with_slabs(index, slabs, n).mapInArrow(_searcher(k), f"item_id {kind}, doc_id long, score long, part int")
    best = lambda *by: F.row_number().over(Window.partitionBy("item_id", *by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    found = found.withColumn("rank", best("part")).filter(F.col("rank") <= k)
    return found.withColumn("rank", best()).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of each item (item_id, text)."""
    index, n_docs = build_index(docs)
    return search_index(index, n_docs, items, k)
