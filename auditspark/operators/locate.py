"""Where a value stands in a document: words with positions, searched page by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_digits

#: Pages looked at.
PAGES = 3


def scan_order(page: Column, pages: Column, budget: int = PAGES) -> Column:
    """The page and its neighbours, nearest first, the earlier of two first; 1, 2, 3 if the page is unknown."""
    start = F.greatest(F.least(page, pages), F.lit(1))
    order = F.transform(F.sequence(F.lit(1), F.greatest(pages, F.lit(1))), lambda p: F.struct(F.abs(p - start).alias("d"), (p > start).alias("after"), p.alias("p")))
    return F.slice(F.transform(F.array_sort(order), lambda x: x["p"]), 1, budget)


def plain(v: Column) -> Column:
    """Letters and digits only, lower case, for comparison of words."""
    return F.regexp_replace(F.lower(ascii_digits(v)), "[^0-9a-zء-ي.]+|^[.]+|[.]+$", "")


def find_runs(words: DataFrame, needles: DataFrame) -> DataFrame:
    """words (doc_id, page, idx, content), needles (needle_id, doc_id, tokens): (needle_id, doc_id, page, first, last) of
    every place where the needle's tokens follow one another.

    The first token is an equi-join; each further one counts matches at idx - i, so a run is a group with all of them.
    """
    at = words.select("doc_id", "page", "idx", plain(F.col("content")).alias("token"))
    want = needles.select("needle_id", "doc_id", F.size("tokens").alias("n"), F.posexplode("tokens").alias("i", "t")).withColumn("token", plain(F.col("t")))
    hits = at.join(want, ["doc_id", "token"]).groupBy("needle_id", "doc_id", "page", (F.col("idx") - F.col("i")).alias("first"), "n").agg(F.count_distinct("i").alias("k"))
    return hits.filter("k = n").select("needle_id", "doc_id", "page", "first", (F.col("first") + F.col("n") - 1).alias("last"))


def fuzzy_run(words: DataFrame, tokens: DataFrame, gap: int = 2) -> DataFrame:
    """(needle_id, doc_id, page, first, last, n_tokens): the run with most distinct tokens of the needle, at most gap words
    between two; of equal runs the first. tokens: (needle_id, doc_id, token)."""
    at = words.select("doc_id", "page", "idx", plain(F.col("content")).alias("token"))
    hits = at.join(tokens.select("needle_id", "doc_id", plain(F.col("token")).alias("token")).distinct(), ["doc_id", "token"])
    by = Window.partitionBy("needle_id", "doc_id", "page").orderBy("idx")
    starts = F.when(F.col("idx") - F.lag("idx").over(by) <= gap + 1, 0).otherwise(1)
    islands = hits.withColumn("start", starts).withColumn("island", F.sum("start").over(by))
    runs = islands.groupBy("needle_id", "doc_id", "page", "island").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count_distinct("token").alias("n_tokens"))
    best = runs.groupBy("needle_id", "doc_id", "page").agg(F.min(F.struct((-F.col("n_tokens")).alias("less"), "first", "last", "n_tokens")).alias("r"))
    return best.select("needle_id", "doc_id", "page", "r.first", "r.last", "r.n_tokens")


def nearest(occurrences: DataFrame, anchors: DataFrame) -> DataFrame:
    """Of each needle's occurrences (needle_id, page, ord, x, y) the one nearest to its anchor (needle_id, page, ax, ay)."""
    both = occurrences.join(anchors, ["needle_id", "page"])
    d = (F.col("x") - F.col("ax")) * (F.col("x") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("y") - F.col("ay"))
    return both.groupBy("needle_id").agg(F.min(F.struct(d.alias("d"), "ord", "page", "x", "y")).alias("r")).select("needle_id", "r.page", "r.ord", "r.x", "r.y")


def locate(words: DataFrame, needles: DataFrame, documents: DataFrame, budget: int = PAGES) -> DataFrame:
    """(needle_id, doc_id, step, page, first, last): exact runs on the cited page, then its neighbours, then fuzzy runs.

    needles (needle_id, doc_id, page, tokens); documents (doc_id, pages).
    """
    scan = needles.join(documents, "doc_id").select("needle_id", "doc_id", "tokens", F.posexplode(scan_order(F.col("page"), F.col("pages"), budget)).alias("at", "page"))
    exact = find_runs(words, needles).join(scan.select("needle_id", "doc_id", "page", "at"), ["needle_id", "doc_id", "page"]).withColumn("step", F.lit(1))
    loose = fuzzy_run(words, needles.select("needle_id", "doc_id", F.explode("tokens").alias("token"))).join(scan, ["needle_id", "doc_id", "page"])
    loose = loose.filter(F.col("n_tokens") * 2 >= F.size("tokens")).withColumn("step", F.lit(2))
    cols = ["needle_id", "doc_id", "step", "at", "page", "first", "last"]
    both = exact.select(cols).unionByName(loose.select(cols))
    return both.groupBy("needle_id", "doc_id").agg(F.min(F.struct("step", "at", "first", "page", "last")).alias("r")).select("needle_id", "doc_id", "r.step", "r.page", "r.first", "r.last")
