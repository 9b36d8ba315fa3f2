"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct lower-cased runs of letters of a whole text and their beginnings of PREFIXES bytes, so that forms of
one word share what they mean, hashed to 2^BITS places. The machine adds a weight for
each term and, for each pair of terms, the product of their factors, so a pair can weigh more or less than its parts: an
insult beside the mention of a group, or an insult that is quoted. It learns only terms that the labelled sample shows to
matter (by a chi-square test), which keeps chance words of long texts out.

The model is fitted on a bounded sample, in one task: the SAMPLE labelled documents with the smallest hashes of their id.
Its terms are at most TERMS that pass the test alone, or, up to as many again, within pairs with one of those: a group's
name may be as common in clean texts as in toxic ones and still change what an insult beside it means. The sample is put in
order by id and text before it is learned from, so partitions and reruns don't change a score.

Nulls and odd input: a null or empty text has no terms and gets the score of the bias; labels that are null are not learned
from, a document with several labels counts as toxic if one says so; of several texts of one id the smallest by hash, then
by itself, is learned from and each is scored; null ids are scored, not learned from; beginnings of words are cut by bytes;
very long texts are scored whole; a score of exactly 0.5 is toxic; without labels of both kinds every score is the share of
toxic labels, or 0; an empty table gives an empty result; more columns, whatever their names, are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .langid import remainder
from .words import LETTERS, chunks, words

BITS, FACTORS, SAMPLE, TERMS, CHI = 20, 4, 12_000, 2048, 12.0
PREFIXES = (5, 7)
#: Terms beside which others are tested, and what a term must reach there: a stricter limit, for more tests are made.
PAIRED, PAIR_CHI = 64, 30.0
#: Terms counted or looked up at a time, since numpy turns them into 64-bit numbers for that.
SLICE = 1 << 20
#: Documents of a step of descent, and steps at least.
BATCH, STEPS = 256, 600


def terms(texts: pa.Array):
    """(places of the distinct terms of all texts, where each text's begin)."""
    places, begins, at = [], [np.zeros(1, np.int64)], 0
    for _, data, offsets in chunks(texts):
        h, b, cut = words(data, offsets, LETTERS, PREFIXES)
        n = len(offsets) - 1
        doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(b)) << np.uint64(32)
        key = np.concatenate([doc | (h >> np.uint64(64 - BITS)), *[doc[at] | (x >> np.uint64(64 - BITS)) for at, x in cut]])
        key.sort()
        if len(key):
            key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        places.append((key & np.uint64(0xFFFFFFFF)).astype(np.int32))
        begins.append(at + np.searchsorted(key >> np.uint64(32), np.arange(1, n + 1, dtype=np.uint64), "left"))
        at = int(begins[-1][-1]) if n else at
    return np.concatenate(places) if places else np.zeros(0, np.int32), np.concatenate(begins)


def _sums(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of x between begins, in order (empty spans: 0)."""
    total = np.concatenate((np.zeros((1, *x.shape[1:]), x.dtype), np.cumsum(x, axis=0)))
    return total[begins[1:]] - total[begins[:-1]]


def _counts(places: np.ndarray) -> np.ndarray:
    """How often each place occurs."""
    out = np.zeros(1 << BITS)
    for i in range(0, len(places), SLICE):
        out += np.bincount(places[i : i + SLICE], minlength=1 << BITS)
    return out


def _look_up(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.concatenate([table[:0], *[table[places[i : i + SLICE]] for i in range(0, len(places), SLICE)]])


def _partners(places, begins, labels, best, y) -> np.ndarray:
    """Terms that pass the test only among documents that have one of the terms best: of each the largest value counts."""
    other, found = np.ones(1 << BITS, bool), np.zeros(1 << BITS)
    other[best] = False
    other = _look_up(other, places)
    for term in best[:PAIRED].tolist():
        mine = np.zeros(len(labels), bool)
        mine[np.searchsorted(begins, np.flatnonzero(places == term), "right") - 1] = True
        n, share = mine.sum(), labels[mine].mean()
        at = np.repeat(mine, np.diff(begins)) & other
        count, bad = _counts(places[at]), _counts(places[at & y])
        spread = np.maximum(count * share * (1 - share) * (1 - count / n), 1e-9)
        found = np.maximum(found, np.where(count >= 8, (np.abs(bad - count * share) - 0.5).clip(0) ** 2 / spread, 0))
    new = np.argsort(-found, kind="stable")[:TERMS]
    return new[found[new] > PAIR_CHI]


class Machine:
    """place: of each hashed term, its row in w and v, or -1."""

    def __init__(self, places: np.ndarray, begins: np.ndarray, labels: np.ndarray, *, epochs: int = 30, rate: float = 0.1, decay: float = 0.002, seed: int = 7):
        n, toxic = len(labels), int(labels.sum())
        self.place = np.full(1 << BITS, -1, np.int16)
        self.bias = -10.0 if not toxic else 10.0 if toxic == n else float(np.log(toxic / (n - toxic)))
        self.w, self.v = np.zeros(0), np.zeros((0, FACTORS))
        if not n or toxic in (0, n):
            return
        y = np.repeat(labels > 0, np.diff(begins))
        seen, bad = _counts(places), _counts(places[y])
        share = toxic / n
        spread = np.maximum(seen * share * (1 - share) * (1 - seen / n), 1e-9)
        chi = np.where(seen >= 3, (np.abs(bad - seen * share) - 0.5).clip(0) ** 2 / spread, 0)
        best = np.argsort(-chi, kind="stable")[:TERMS]
        best = best[chi[best] > CHI]
        best = np.sort(np.concatenate((best, _partners(places, begins, labels, best, y))))
        self.place[best] = np.arange(len(best))
        rng = np.random.default_rng(seed)
        self.w, self.v = np.zeros(len(best)), rng.normal(0, 0.05, (len(best), FACTORS))
        rows, begins = self._rows(places, begins)
        sums = {"w": np.full(self.w.shape, 1e-6), "v": np.full(self.v.shape, 1e-6)}
        sum_b = 1e-6
        batches = max(1, n // BATCH)
        for _ in range(max(epochs, -(-STEPS // batches))):
            order = rng.permutation(n)
            for batch in np.array_split(order, batches):
                span = [rows[begins[i] : begins[i + 1]] for i in batch]
                at, counts = np.concatenate(span), np.array([len(x) for x in span])
                doc = np.repeat(np.arange(len(batch)), counts)
                s = np.stack([np.bincount(doc, self.v[at, f], len(batch)) for f in range(FACTORS)], 1)
                raw = self._raw(at, np.concatenate(([0], np.cumsum(counts))))
                g = (1 / (1 + np.exp(-raw.clip(-30, 30))) - labels[batch]) / len(batch)
                gb, gw = g.sum(), np.bincount(at, g[doc], len(self.w)) + decay * self.w / batches
                gv = g[doc][:, None] * (s[doc] - self.v[at])
                gv = np.stack([np.bincount(at, gv[:, f], len(self.w)) for f in range(FACTORS)], 1) + decay * self.v / batches
                sum_b += gb * gb
                self.bias -= rate * gb / np.sqrt(sum_b)
                for name, x, grad in (("w", self.w, gw), ("v", self.v, gv)):
                    sums[name] += grad * grad
                    x -= rate * grad / np.sqrt(sums[name])

    def _rows(self, places, begins):
        rows = _look_up(self.place, places)
        known = rows >= 0
        return rows[known], np.searchsorted(np.flatnonzero(known), begins)

    def _raw(self, rows, begins):
        v = self.v[rows]
        pairs = 0.5 * (_sums(v, begins) ** 2 - _sums(v * v, begins)).sum(1)
        return self.bias + _sums(self.w[rows], begins) + pairs

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-self._raw(*self._rows(*terms(texts))).clip(-30, 30)))


def _train(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("h", "ascending"), ("doc_id", "ascending")])
    machine = Machine(*terms(rows.column("text")), (rows.column("toxic").to_numpy() > 0).astype(float))
    return pa.table({"machine": pa.array([pickle.dumps(machine)], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """docs (doc_id, text) and labels (doc_id, toxic) to learn from; at most sample labelled documents are used."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    marks = marks.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample)
    picked = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")  # sample rows of three numbers
    picked = picked.groupBy("doc_id").agg(F.first("h").alias("h"), F.first("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    got = picked.groupBy().applyInArrow(_train, "machine binary").collect()  # sample rows in one task, one small model
    return pickle.loads(got[0][0]) if got else Machine(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0))


def scorer(docs: DataFrame, machine: Machine):
    """A function of a text column: the score."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts), pa.float64())

    return score


def _learn(docs: DataFrame, parts: int, held: int) -> DataFrame:
    return docs.filter(remainder("doc_id", parts) != held).select("doc_id", "text")


def score_toxicity(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted. Learns from rows whose checksum of the id isn't held modulo parts."""
    machine = fit(_learn(docs, parts, held), labels)
    out = docs.select("doc_id", (remainder("doc_id", parts) == held).alias("held_out"), scorer(docs, machine)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_civil(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """docs without the texts that are predicted toxic."""
    machine = fit(_learn(docs, parts, held), labels)
    return docs.filter(scorer(docs, machine)("text") < 0.5)
