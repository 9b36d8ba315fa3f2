"""Quality rules with risk-controlled thresholds.

Two base rules are fixed: too few words, and too many words in repeated three-word windows. Each further rule rejects a text
whose measure, a whole number, is above a cutoff, and cutoffs are chosen by stratum (a column, the language by default) so
that false rejections are limited: with confidence 1 - DELTA, in no stratum more than ALPHA of the texts that are good, and
that the base rules pass, are rejected by the rules together.

Labelled texts are split by a hash of the text, so copies stay on one side, and count once in a stratum. One fold proposes:
for each level of LEVELS, from mild to strict, each rule's cutoff is the smallest value that at most so many thousandths of
the fold's good texts exceed, and of the rules only the fewest are used that reject as many of the fold's bad texts as all
would: a rule that adds nothing there can only lose good texts. Three folds certify, level by level from the mildest: the exact binomial probability of at most
as many rejected good texts as were seen, were ALPHA the true share, must be within DELTA / number of strata. A stratum's
levels are tested in that fixed order and the first failure ends its sequence, so levels need no correction of their own and
strata are corrected by Bonferroni's. Of the certified levels the one that rejects most bad texts of the proposing fold is
taken, of equal ones the mildest; a stratum without a certified level, or without labels, has the base rules alone. The last
fold is left out of all this, for measuring. Counts cover all labelled texts; nothing is sampled.

Nulls and odd input: a null or empty text has no words and fails the base rules; a null stratum is one of its own; labels
that are null or neither 0 nor 1 are ignored, a text with labels of both kinds counts as bad; rows of a repeated id are
judged each, labelled alike; a measure equal to a cutoff passes; very long texts are measured whole; an empty table gives an
empty result; only the id, the text and the stratum are read, so other columns may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut
from .words import NOT_SPACE, chunks, mix, spans, word_edges

#: Share of good texts that may be rejected in a stratum, and the chance that any stratum's is above it.
ALPHA, DELTA = 0.05, 0.05
#: Thousandths of the proposing fold's good texts that each rule's cutoff may leave above it, from mild to strict.
LEVELS = (0, 1, 2, 5, 10, 20, 50)
#: Folds of labelled texts: of FOLDS the first is held out, the second proposes, the others certify.
FOLDS = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_digits")


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _CAPITAL, _DIGIT, _MARK = _bytes("#*$%&|<>"), _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("0123456789"), _bytes("!\"'()+,-./:;=?@[\\]^_`{}~")
_LEAD = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point


def _ratio(part: str, whole: str, by: int = 1000) -> Column:
    return F.when(F.col(whole) > 0, F.expr(f"{by} * {part} div {whole}")).otherwise(F.lit(0)).cast("long")


#: The rules: a name and a measure, in thousandths of the text (word_length: in tenths of a code point).
RULES = {
    "symbols": ("n_symbols", "word_chars", 1000),
    "capitals": ("n_capitals", "word_chars", 1000),
    "marks": ("n_marks", "word_chars", 1000),
    "digits": ("n_digits", "word_chars", 1000),
    "dup_lines": ("n_dup_lines", "n_lines", 1000),
    "repeats": ("n_repeat_words", "n_words", 1000),
    "word_length": ("word_chars", "n_words", 10),
}
#: Above it a measure is taken as it, so that a histogram has no more rows than that.
TOP = 1000


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
    counts = np.diff(np.append(np.flatnonzero(new), len(keys)))
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(counts > 1, counts)
    return out


def measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """MEASURES of each text of some bytes."""
    n = len(offsets) - 1

    def per_text(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return upto[offsets[1:]] - upto[offsets[:-1]]

    of = lambda doc: mix(doc.astype(np.uint64) + np.uint64(1))
    inside = NOT_SPACE[data]
    starts, ends = word_edges(data, offsets) if len(data) else (np.zeros(0, np.int64),) * 2
    begins = np.searchsorted(starts, offsets)
    n_words = np.diff(begins)
    covered = np.zeros(len(starts) + 1, bool)
    if len(starts) > 2:
        h = spans(data, starts, ends)
        doc = np.repeat(np.arange(n), n_words)
        first = np.flatnonzero(doc[2:] == doc[:-2])
        window = mix(mix(mix(h[first]) + h[first + 1]) + h[first + 2])
        again = first[_repeats(window ^ of(doc[first]))] if len(first) else first
        covered[again] = covered[again + 1] = covered[again + 2] = True
    upto = np.concatenate(([0], np.cumsum(covered[:-1], dtype=np.int64)))
    ends_of_lines = np.flatnonzero(data == 10)
    line_starts, line_ends = np.sort(np.concatenate((offsets[:-1], ends_of_lines + 1))), np.sort(np.concatenate((ends_of_lines, offsets[1:])))
    worded = np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))
    full = worded[line_ends] > worded[line_starts]
    line_starts, line_ends = line_starts[full], line_ends[full]
    doc = np.searchsorted(offsets, line_starts, "right") - 1
    n_lines = np.bincount(doc, minlength=n)
    keys = spans(data, line_starts, line_ends) ^ of(doc) if len(doc) else np.zeros(0, np.uint64)
    n_distinct = np.bincount(doc[np.unique(keys, return_index=True)[1]], minlength=n)
    return [n_words, per_text(inside & _LEAD[data]), per_text(_SYMBOL[data]), n_lines - n_distinct, upto[begins[1:]] - upto[begins[:-1]], n_lines, *[per_text(x[data]) for x in (_CAPITAL, _MARK, _DIGIT)]]


def _measures(batches):
    for batch in batches:
        got = [measure(data, offsets) for _, data, offsets in chunks(batch.column(batch.num_columns - 1))]
        columns = [pa.array(np.concatenate([x[i] for x in got]).astype(np.int64) if got else np.zeros(0, np.int64)) for i in range(len(MEASURES))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *MEASURES])


def measured(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, key (a hash of the text), fold, MEASURES, base_failed and a column r_<rule> of each rule."""
    kinds = dict(docs.dtypes)
    rows = docs.select("doc_id", F.col(stratum).alias("stratum"), F.md5(F.coalesce("text", F.lit(""))).alias("key"), "text")
    schema = f"doc_id {kinds['doc_id']}, stratum {kinds[stratum]}, key string, " + ", ".join(f"{x} long" for x in MEASURES)
    out = rows.mapInArrow(_measures, schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fold = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % FOLDS
    return out.withColumns({"fold": fold, "base_failed": failed} | {f"r_{name}": F.least(_ratio(*spec), F.lit(TOP).cast("long")) for name, spec in RULES.items()})


def binomial_tail(x: int, n: int, p: float) -> float:
    """The probability of at most x of n when each has probability p, by the continued fraction of the incomplete beta."""
    if x >= n or p <= 0:
        return 1.0
    if x < 0 or p >= 1:
        return 0.0
    a, b, q = n - x, x + 1, 1 - p
    if q > (a + 1) / (a + b + 2):  # the fraction converges fast on the other side
        return 1.0 - _beta(b, a, p)
    return _beta(a, b, q)


def _beta(a: float, b: float, x: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, tiny = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), 1e-300), 1e-300
    total, m = d, 0
    while True:
        m += 1
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-15 or m > 1_000_000:
            return front * total


def upper_bound(x: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound on a share of which x of n were seen, wrong with probability delta."""
    if x >= n:
        return 1.0
    low, high = x / n, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if binomial_tail(x, n, middle) > delta else (low, middle)
    return high


def _certified(x: pd.Series, n: pd.Series, alpha: pd.Series, delta: pd.Series) -> pd.DataFrame:
    rows = list(zip(x.tolist(), n.tolist(), alpha.tolist(), delta.tolist()))
    return pd.DataFrame({"certified": [n > 0 and binomial_tail(x, n, a) <= d for x, n, a, d in rows], "bound": [upper_bound(x, n, d) if n else 1.0 for x, n, _, d in rows]})


def _useful(cutoffs: DataFrame, bad: DataFrame) -> DataFrame:
    """cutoffs with those alone, of each stratum and level, of the fewest rules that reject as many bad texts as all do."""
    by = ["stratum", "level"]
    joined = bad.join(bounded(cutoffs.withColumnRenamed("stratum", "s"), cutoffs.count()), F.col("stratum").eqNullSafe(F.col("s")))
    mask = sum((F.when(_over(x), 1 << i).otherwise(0) for i, x in enumerate(RULES)), F.lit(0))
    masks = joined.groupBy(*by, mask.alias("mask")).agg(F.count("*").alias("n"))
    sets = masks.withColumn("set", F.explode(F.sequence(F.lit(0), F.lit((1 << len(RULES)) - 1))))
    caught = sets.groupBy(*by, "set").agg(F.sum(F.when(F.col("mask").bitwiseAND(F.col("set")) != 0, F.col("n")).otherwise(0)).alias("caught"))
    order = Window.partitionBy(*by).orderBy(F.col("caught").desc(), F.bit_count("set"), "set")
    best = caught.withColumn("i", F.row_number().over(order)).filter("i = 1").select(F.col("stratum").alias("s"), F.col("level").alias("l"), "set")
    out = cutoffs.join(best, F.col("stratum").eqNullSafe(F.col("s")) & (F.col("level") == F.col("l")), "left")
    used = lambda i: F.coalesce(F.col("set"), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0
    return out.select(*by, *[F.when(used(i), F.col(f"c_{x}")).alias(f"c_{x}") for i, x in enumerate(RULES)])


def thresholds(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, level, bound, n_good, n_rejected and c_<rule>: the cutoffs of each stratum with a certified level.

    rows: what measured() returns; labels: doc_id, quality (1 good, 0 bad).
    """
    names = list(RULES)
    marks = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    seen = rows.filter("not base_failed and fold != 0").join(marks, "doc_id")
    seen = seen.groupBy("stratum", "key", "fold", *[f"r_{x}" for x in names]).agg(F.min("quality").alias("quality"))
    seen = cut(seen, "rules-labelled")
    values = F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.col(f"r_{x}").alias("value")) for x in names])).alias("v")
    counts = seen.filter("fold = 1 and quality = 1").select("stratum", values).groupBy("stratum", "v.rule", "v.value").agg(F.count("*").alias("n"))
    by = Window.partitionBy("stratum", "rule")
    above = counts.select("stratum", "rule", "value", (F.sum("n").over(by) - F.sum("n").over(by.orderBy("value"))).alias("above"), F.sum("n").over(by).alias("total"))
    levels = above.withColumn("level", F.explode(F.array(*map(F.lit, LEVELS)))).filter(F.col("above") * 1000 <= F.col("level") * F.col("total"))
    cutoffs = levels.groupBy("stratum", "level").agg(*[F.min(F.when(F.col("rule") == x, F.col("value"))).alias(f"c_{x}") for x in names])
    cutoffs = cut(_useful(cut(cutoffs, "rules-proposed"), seen.filter("fold = 1 and quality = 0")), "rules-cutoffs")
    cut_of = bounded(cutoffs.withColumnRenamed("stratum", "s"), cutoffs.count())
    tried = seen.join(cut_of, F.col("stratum").eqNullSafe(F.col("s"))).withColumn("rejected", _any(names))
    good, proposing = F.col("quality") == 1, F.col("fold") == 1
    certifying = good & ~proposing
    tested = tried.groupBy("stratum", "level").agg(F.count_if(certifying).alias("n_good"), F.count_if(certifying & F.col("rejected")).alias("n_rejected"), F.count_if(~good & proposing & F.col("rejected")).alias("gain"))
    n_strata = max(1, cutoffs.select("stratum").distinct().count())
    tested = tested.withColumn("test", F.pandas_udf(_certified, "certified boolean, bound double")("n_rejected", "n_good", F.lit(float(alpha)), F.lit(delta / n_strata)))
    order = Window.partitionBy("stratum").orderBy("level")
    passed = tested.withColumn("so_far", F.bool_and("test.certified").over(order)).filter("so_far")
    best = passed.withColumn("i", F.row_number().over(Window.partitionBy("stratum").orderBy(F.col("gain").desc(), "level"))).filter("i = 1")
    chosen = best.select("stratum", "level", "n_good", "n_rejected", F.col("test.bound").alias("bound"))
    c = cutoffs.withColumnsRenamed({"stratum": "s", "level": "l"})
    return chosen.join(c, F.col("stratum").eqNullSafe(F.col("s")) & (F.col("level") == F.col("l"))).drop("s", "l")


def _over(name: str) -> Column:
    return F.coalesce(F.col(f"r_{name}") > F.col(f"c_{name}"), F.lit(False))


def _any(names) -> Column:
    out = F.lit(False)
    for x in names:
        out = out | _over(x)
    return out


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, MEASURES, base_failed, kept, failed_rules (names of the rules above their cutoffs), held_out, for each row."""
    rows = cut(measured(docs, stratum), "rules-measured")
    limits = cut(thresholds(rows, labels, alpha, delta).withColumnRenamed("stratum", "s"), "rules-thresholds")
    out = rows.join(bounded(limits, limits.count()), F.col("stratum").eqNullSafe(F.col("s")), "left")
    failed = F.concat_ws(",", *[F.when(_over(x), F.lit(x)) for x in RULES])
    return out.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & (failed == "")).alias("kept"), failed.alias("failed_rules"), (F.col("fold") == 0).alias("held_out"))
