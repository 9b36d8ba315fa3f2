"""Layout answers (nested JSON) shredded to rows: pages, words and lines with their polygons in units of the page.

An answer has contents, each with pages, each with width, height, words and lines; an item has content and source, its polygon
as text. Every answer, page and item gives a row, also one that can't be used, which carries an error: nothing is dropped, and
a bad part spoils no other. Answers are parsed once, to variants; there is no shuffle.

* kind ``answer`` (one row, only if the answer gives no page): ``empty`` (null or white space), ``not JSON``, ``no pages``
* kind ``page``: ``no size`` (width or height missing, not a number or not above 0); its items have no place then
* kind ``word`` or ``line``: ``no polygon`` (fewer than one whole point, or a coordinate that is no number)

A page is known by its ``pageNumber``, or, without one, by its place among all pages of the answer; two pages may have one
number. ``idx`` is an item's place in its list, bad ones counted. A missing content is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.intake import centroid, coordinates, shape, whole_points

ITEM = ["kind", "idx", "content", "polygon", "x", "y", "left", "top"]


#: Read at once from the answer: what is of another kind is null where it stands, and no part is copied as a variant.
ITEMS = "array<struct<content: string, source: string>>"
PAGES = f"array<struct<pageNumber: int, width: double, height: double, words: {ITEMS}, lines: {ITEMS}>>"


def _all(rows: Column, kind: str) -> Column:
    return F.coalesce(rows, F.array().cast(kind))


def shred(answers: DataFrame) -> DataFrame:
    """answers (doc_id, raw) as rows (doc_id, page, kind, idx, content, polygon, x, y, left, top, width, height, error).

    x and y are the polygon's centre as it was given; left and top its first point as a part of the page. A page's row carries
    nothing of the answer and an item's row only numbers of its page, so the work grows with the items, not with pages times answer."""
    parsed = answers.select("doc_id", (F.trim(F.coalesce("raw", F.lit(""))) == "").alias("empty"), F.try_parse_json("raw").alias("v"))
    no_page = F.when(F.col("empty"), "empty").when(F.col("v").isNull(), "not JSON").otherwise("no pages")
    pages = F.flatten(F.array_compact(F.try_variant_get("v", "$.contents", f"array<struct<pages: {PAGES}>>")["pages"]))  # transform would copy each page
    rows = parsed.select("doc_id", no_page.alias("no_page"), pages.alias("pages")).select("doc_id", "no_page", F.posexplode_outer("pages").alias("nth", "p"))
    size = lambda name: F.when(F.col(f"p.{name}") > 0, F.col(f"p.{name}")).alias(name)
    words, lines, itself = _all(F.col("p.words"), ITEMS), _all(F.col("p.lines"), ITEMS), F.array(F.lit(None)).cast(ITEMS)
    of_page = rows.select("doc_id", F.when(F.col("nth").isNull(), F.col("no_page")).alias("no_page"), F.coalesce("p.pageNumber", F.col("nth") + 1).alias("page"), size("width"), size("height"), F.size(words).alias("n_words"), F.concat(itself, words, lines).alias("items"))
    each = of_page.select("doc_id", "no_page", "page", "width", "height", "n_words", F.posexplode("items").alias("at", "i"))
    at, n_words = F.col("at"), F.col("n_words")
    kind = F.when(at > n_words, "line").when(at > 0, "word").when(F.col("no_page").isNotNull(), "answer").otherwise("page")
    idx = F.when(at > n_words, at - 1 - n_words).when(at > 0, at - 1)
    read = each.select("doc_id", "no_page", "page", "width", "height", kind.alias("kind"), idx.alias("idx"), F.when(at > 0, F.coalesce("i.content", F.lit(""))).alias("content"), coordinates(F.col("i.source")).alias("numbers"))
    lowest = F.try_element_at(F.sort_array(F.slice("numbers", 2, 2 * whole_points(F.col("numbers")))), F.lit(1))  # null if there is none, or one is no number
    placed = read.withColumn("points", F.when(lowest.isNotNull(), shape(F.col("numbers"))["points"]))
    error = F.when(F.col("kind") == "answer", F.col("no_page")).when(F.col("kind") == "page", F.when(F.col("width").isNull() | F.col("height").isNull(), "no size")).when(F.col("points").isNull(), "no polygon")
    middle, first = centroid(F.col("points")), F.try_element_at("points", F.lit(1))
    return placed.select(
        "doc_id", "page", "kind", "idx", "content", F.col("points").alias("polygon"), middle["x"].alias("x"), middle["y"].alias("y"),
        (first["x"] / F.col("width")).alias("left"), (first["y"] / F.col("height")).alias("top"), "width", "height", error.alias("error"),
    )


def items(shredded: DataFrame, kind: str) -> DataFrame:
    """The usable words or lines (doc_id, page, idx, content, x, y), as operators.places.page_index takes them."""
    return shredded.filter((F.col("kind") == kind) & F.col("error").isNull()).select("doc_id", "page", "idx", "content", "x", "y")


def errors(shredded: DataFrame) -> DataFrame:
    return shredded.filter(F.col("error").isNotNull()).select("doc_id", "page", "kind", "idx", "error")
