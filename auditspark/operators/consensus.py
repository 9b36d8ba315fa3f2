"""One record from several reads of a unit: recursive votes, and a further read only where two reads disagree.

Reads are rows. What two of them must agree on is a signature made by recursion over the schema: numbers to two decimals and
the runs of digits in texts, not wording and page numbers. A value that two reads share wins; objects on which no two agree
are voted field by field, at any depth; else the first read's value counts. All of it is one expression over the few reads
of a unit, so a vote costs one aggregate by unit, and units in dispute are found from signatures alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StringType, StructType

from ..functions.text import bind, signature
from ..sources.documents import passes
from .reads import KEY_FIELDS

# Fields whose wording, and digits in it, may differ between two right reads.
WORDING = {"description_ar", "description_en", "text_ar", "basis", "seller_name_ar", "ref", "kind", "per", "unit", "source_file", "claim_type", "page"}

#: Units of a task, of which it sorts and votes all reads.
UNITS = 50_000


def comparable(value: Column, kind: DataType, skip: dict[str, list[str]] | None = None) -> Column:
    """What is compared of a value: null if nothing is. skip: fields of sections that don't count."""
    if isinstance(kind, StructType):
        fields = [f for f in kind.fields if f.name not in WORDING]
        kept = [comparable(value[f.name], _without(f.dataType, (skip or {}).get(f.name, []))).alias(f.name) for f in fields]
        return F.when(value.isNotNull(), F.struct(F.lit(1).alias("_"), *kept))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: F.struct(comparable(x, kind.elementType).alias("x")))
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("k"), comparable(e["value"], kind.valueType).alias("v")))
        return F.array_sort(F.filter(entries, lambda e: e["v"].isNotNull() & ~e["k"].isin(*WORDING)))
    if isinstance(kind, BooleanType):
        return value
    if isinstance(kind, NumericType):
        return F.bround(value.cast("double"), 2) + F.lit(0.0)
    return signature(value if isinstance(kind, StringType) else value.cast("string"))


def _without(kind: DataType, names: list[str]) -> DataType:
    return StructType([f for f in kind.fields if f.name not in names]) if names and isinstance(kind, StructType) else kind


def agreement(value: Column, kind: DataType, skip: dict[str, list[str]] | None = None) -> Column:
    """The signature as a text: two reads agree if theirs are equal. Absent and null fields are alike."""
    return F.to_json(F.struct(comparable(value, kind, skip).alias("v")), {"ignoreNullFields": "true"})


def vote(values: Column, kind: DataType) -> Column:
    """The value that two of an array of values agree on, the first such; else objects field by field, else the first that
    isn't null: a read that missed something never outvotes one that saw it."""

    def settle(r: Column) -> Column:
        live, signs = r["live"], r["signs"]
        shared = F.transform(signs, lambda s, i: F.when(F.size(F.filter(signs, lambda o: o == s)) >= 2, i))
        first = F.get(live, F.lit(0))
        if isinstance(kind, StructType):
            fields = [vote(F.transform(live, _field(f.name)), f.dataType).alias(f.name) for f in kind.fields]
            first = F.when(F.size(live) > 1, F.struct(*fields)).otherwise(first)
        elif isinstance(kind, MapType):
            keys = F.array_distinct(F.flatten(F.transform(live, F.map_keys)))
            entries = F.transform(keys, lambda k: F.struct(k.alias("k"), vote(F.transform(live, lambda m: F.try_element_at(m, k)), kind.valueType).alias("v")))
            first = F.when(F.size(live) > 1, F.map_from_entries(entries)).otherwise(first)
        return bind(lambda a: F.when(a["at"].isNotNull(), F.get(live, a["at"])).otherwise(first), at=F.get(F.array_compact(shared), F.lit(0)))

    signed = lambda r: bind(settle, live=r["live"], signs=F.transform(r["live"], lambda x: agreement(x, kind)))
    return bind(signed, live=F.filter(values, lambda x: x.isNotNull()))


def _field(name: str):
    return lambda x: x[name]


def empty_record(kind: StructType) -> Column:
    """A record of which nothing was seen: lists are empty, all else is null."""
    none = lambda t: F.array().cast(t) if isinstance(t, ArrayType) else F.lit(None).cast(t)
    return F.struct(*[none(f.dataType).alias(f.name) for f in kind.fields])


def first_filled_anchors(anchors: Column, kind: StructType) -> Column:
    """Of an array of anchors each field's first value that isn't empty; hints are not voted on."""
    filled = lambda name: F.coalesce(F.get(F.filter(F.transform(anchors, _field(name)), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0)), F.lit(""))
    return F.struct(*[filled(f.name).alias(f.name) for f in kind.fields])


def settle_reads(reads: DataFrame, key: list[str], order: str = "pass") -> DataFrame:
    """(key, docs, anchors, n_reads) of reads (key, order, docs, anchors); failed reads, without docs, don't count, and a
    single read is taken as it is."""
    types = {f.name: f.dataType for f in reads.schema.fields}
    in_order = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)  # noqa: E731  # records needn't be sortable
    grouped = reads.filter("docs is not null").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "docs", "anchors")), in_order).alias("r"))
    of = lambda name: F.transform("r", _field(name))
    one = F.size("r") == 1
    docs = F.when(one, F.col("r")[0]["docs"]).otherwise(F.coalesce(vote(of("docs"), types["docs"]), empty_record(types["docs"])))
    anchors = F.when(one, F.col("r")[0]["anchors"]).otherwise(first_filled_anchors(of("anchors"), types["anchors"]))
    return grouped.select(*key, docs.alias("docs"), anchors.alias("anchors"), F.size("r").alias("n_reads"))


def disputed(reads: DataFrame, key: list[str], verified: DataFrame | None = None) -> DataFrame:
    """key of the units of whose reads exactly two succeeded and don't agree; for verified ones header fields don't count,
    since the focused read settles them."""
    kind = reads.schema["docs"].dataType
    signs = reads.filter("docs is not null").select(*key, agreement(F.col("docs"), kind).alias("all"), agreement(F.col("docs"), kind, KEY_FIELDS).alias("rest"))
    pairs = signs.groupBy(*key).agg(F.count("*").alias("n"), (F.min("all") != F.max("all")).alias("all"), (F.min("rest") != F.max("rest")).alias("rest")).filter("n = 2 and all")
    if verified is None:
        return pairs.select(*key)
    pairs = pairs.join(verified.select(*key).distinct().withColumn("verified", F.lit(True)), key, "left")
    return pairs.filter("rest or verified is null").select(*key)


def key_fields_there(focused: Column, kind: StructType) -> Column:
    """Whether a focused read found anything."""
    empty = lambda v, t: F.coalesce(v, F.lit(0.0)) == 0 if isinstance(t, NumericType) else F.coalesce(v, F.lit("")) == ""
    found = [~empty(focused[s.name][f.name], f.dataType) for s in kind.fields for f in s.dataType.fields]
    out = F.lit(False)
    for x in found:
        out = out | x
    return F.coalesce(out, F.lit(False))


def apply_key_fields(docs: Column, focused: Column, kind: StructType, focused_kind: StructType) -> Column:
    """docs with what the focused read (sections of fields) found of sections that docs have, where its digits differ."""
    for section in [s for s in focused_kind.fields if s.name in kind.names]:
        new, inner = docs[section.name], kind[section.name].dataType
        for f in [f for f in section.dataType.fields if f.name in inner.names]:
            target = inner[f.name].dataType
            value, old = focused[section.name][f.name].cast(target), docs[section.name][f.name]
            there = F.coalesce(value != (0 if isinstance(target, NumericType) else ""), F.lit(False))
            new = new.withField(f.name, F.when(there & (agreement(old, target) != agreement(value, target)), value).otherwise(old))
        docs = docs.withField(section.name, F.when(docs[section.name].isNotNull(), new))
    return docs


def read_units(
    units: DataFrame, key: list[str], reader: Callable[[DataFrame], DataFrame], focused: Callable[[DataFrame], DataFrame] | None = None,
    short: int = 2, times: int = 2, store: Callable[[DataFrame], DataFrame] = DataFrame.checkpoint,
) -> DataFrame:
    """key, docs, anchors, n_reads, disputed, one row a unit; a unit of which no read succeeded is a hole without docs.

    units: key, n_unit_pages, unit (0: its file's first). Units of at most short pages are read so many times, the others
    once; those whose two reads disagree once more. reader takes rows of units with pass and returns key, pass, docs, anchors
    (docs null: the read failed); focused takes first units and returns key, key_fields. store cuts lineage behind what was
    read, so that no reader runs twice.
    """
    # Reads are far wider than units: dealt by units, a task's sorts and votes hold the same at any size.
    spark = units.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-units.count() // UNITS))
    tasks += tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))  # else it is the default shuffle, whose small parts are put together
    units = units.repartition(tasks, *key)
    reads = store(reader(passes(units, short, times)))
    checks = verified = None
    if focused is not None:
        kind = (checks := store(focused(units.filter("unit = 0")))).schema["key_fields"].dataType
        checks = checks.filter(key_fields_there(F.col("key_fields"), kind)).select(*key, "key_fields")
        verified = checks.select(*key)
    again = store(disputed(reads, key, verified))
    third = store(reader(units.join(again, key, "left_semi").withColumn("pass", F.lit(times + 1))))
    out = settle_reads(reads.unionByName(third.select(*reads.columns)), key)
    if checks is not None:
        new = apply_key_fields(F.col("docs"), F.col("key_fields"), reads.schema["docs"].dataType, kind)
        out = out.join(checks, key, "left").withColumn("docs", F.when(F.col("key_fields").isNotNull(), new).otherwise(F.col("docs"))).drop("key_fields")
    return units.select(*key).join(out, key, "left").join(again.withColumn("disputed", F.lit(True)), key, "left").withColumns({"n_reads": F.coalesce("n_reads", F.lit(0)), "disputed": F.coalesce("disputed", F.lit(False))})
