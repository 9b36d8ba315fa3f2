"""Documents before they are read: pages, units, routing and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A page is text from so many characters; estimated tokens of pages.
TEXT_FROM, TEXT_TOKENS, IMAGE_TOKENS, SAMPLE_PAGES = 200, 900, 1400, 12


def route(text: Column) -> Column:
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) >= TEXT_FROM, "text").otherwise("image")


def survey(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text): of each document its pages, the share of text in a sample spread over it, and tokens."""
    n = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    step = F.greatest(F.ceil(F.col("n_pages") / SAMPLE_PAGES), F.lit(1))
    sample = pages.join(n, "doc_id").filter((F.col("page") - 1) % step == 0)
    out = sample.groupBy("doc_id", "n_pages").agg(F.avg(F.when(route(F.col("text")) == "text", 1.0).otherwise(0.0)).alias("text_share"))
    return out.withColumn("tokens", F.floor(F.col("n_pages") * (F.col("text_share") * TEXT_TOKENS + (1 - F.col("text_share")) * IMAGE_TOKENS)).cast("long"))


def page_units(documents: DataFrame, chunk: int) -> DataFrame:
    """documents (doc_id, n_pages) -> one row a unit of at most chunk pages."""
    out = documents.filter("n_pages > 0").withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("n_pages") - 1, F.lit(chunk))))
    return out.select("doc_id", F.expr(f"cast(offset div {chunk} as int)").alias("unit"), F.col("offset").cast("int").alias("offset"), F.least(F.lit(chunk), F.col("n_pages") - F.col("offset")).cast("int").alias("n_unit_pages"), F.ceil(F.col("n_pages") / chunk).cast("int").alias("n_units"))


def passes(units: DataFrame, short: int = 2, times: int = 2) -> DataFrame:
    """Short units are read more than once."""
    return units.withColumn("pass", F.explode(F.sequence(F.lit(1), F.when(F.col("n_unit_pages") <= short, times).otherwise(1))))


def page_spec(spec: Column, n: Column) -> Column:
    """'1-3,7,9-' as the sorted distinct pages within 1..n."""

    def pages(part):
        ends = F.split(F.trim(part), "-")
        low = F.coalesce(F.element_at(ends, 1).try_cast("int"), F.lit(1))
        high = F.when(F.size(ends) == 1, low).otherwise(F.coalesce(F.try_element_at(ends, F.lit(2)).try_cast("int"), n))
        low, high = F.greatest(low, F.lit(1)), F.least(high, n)
        return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

    parts = F.filter(F.split(spec, ","), lambda p: F.trim(p) != "")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages))))


def cache_key(content: Column, *params: Column) -> Column:
    return F.sha2(F.concat_ws("\0", content, *params), 256)


def cache_misses(tasks: DataFrame, cache: DataFrame) -> DataFrame:
    """Tasks (digest, ...) whose digest isn't in the cache, equal ones once."""
    return tasks.dropDuplicates(["digest"]).join(cache, "digest", "left_anti")


def unread_files(units: DataFrame) -> DataFrame:
    """units (path, read): files of which a unit couldn't be read."""
    return units.groupBy("path").agg(F.bool_and(F.col("read").isNotNull()).alias("whole")).filter("not whole").select("path")


def priority(doc_type: Column, order=("invoice", "contract_boq", "coc", "delivery_note", "other")) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), doc_type), F.lit(0)) - 1, F.lit(9)).cast("int")


def read_with(rows: DataFrame, reader, schema: str) -> DataFrame:
    """The seam for readers of images and models: reader is a function of Arrow or pandas batches, run in tasks."""
    return rows.mapInPandas(reader, schema)
