"""One record from several reads of the same document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_digits


def majority_vote(reads: DataFrame, key: list[str], ord_col: str = "ord", value: str = "value", sig: Column | None = None) -> DataFrame:
    """(key, value, support): of each key the first value whose signature two reads share, else the first that isn't null."""
    kept = reads.filter(F.col(value).isNotNull()).withColumn("sig", sig if sig is not None else F.col(value).cast("string"))
    groups = kept.groupBy(*key, "sig").agg(F.count("*").alias("support"), F.min(F.struct(ord_col, value)).alias("first"))
    pick = F.min(F.struct((F.col("support") < 2).alias("alone"), F.col(f"first.{ord_col}").alias("o"), F.col(f"first.{value}").alias("v"), "support"))
    return groups.groupBy(*key).agg(pick.alias("p")).select(*key, F.col("p.v").alias(value), F.col("p.support").alias("support"))


def first_filled(reads: DataFrame, key: list[str], columns: list[str], ord_col: str = "ord") -> DataFrame:
    """Field by field the first read that isn't empty ('' and 0 and null are empty)."""

    def filled(name):
        zero = F.lit("") if dict(reads.dtypes)[name] == "string" else F.lit(0)
        return F.min(F.when(F.col(name).isNotNull() & (F.col(name) != zero), F.struct(ord_col, name))).getField(name).alias(name)

    return reads.groupBy(*key).agg(*[filled(x) for x in columns])


def drop_repeated(rows: DataFrame, order: str, ignore: list[str] = ()) -> DataFrame:
    """Rows that differ in nothing but where they were read count once, the first one."""
    same = [x for x in rows.columns if x not in {order, *ignore}]
    first = rows.groupBy(*same).agg(F.min(F.struct(order, *ignore)).alias("r"))
    return first.select(*same, F.col(f"r.{order}").alias(order), *[F.col(f"r.{x}").alias(x) for x in ignore])


def best_of_code(rows: DataFrame, by: list[str], code: str = "item_code", order: str = "pos") -> DataFrame:
    """One row of each code, digit scripts alike: described and priced before described before others, then the first.

    It stands where the code was first seen (column ``first_pos``).
    """
    described = F.coalesce("description", F.lit("")) != ""
    priced = F.coalesce("unit_price", F.lit(0.0)) != 0
    rank = F.when(described & priced, 0).when(described, 1).otherwise(2)
    keyed = rows.withColumn("code_key", F.trim(ascii_digits(F.col(code).cast("string"))))
    rest = [x for x in rows.columns if x not in {*by, order}]
    picked = keyed.groupBy(*by, "code_key").agg(F.min(F.struct(rank.alias("rank"), order, *rest)).alias("r"), F.min(order).alias("first_pos"))
    return picked.select(*by, *[F.col(f"r.{x}").alias(x) for x in rest], F.col(f"r.{order}").alias(order), "first_pos")


def real_rows(rows: Column) -> Column:
    """Rows of a bill that name something and have a price or quantity."""
    text = lambda v: F.coalesce(v, F.lit("")) != ""
    num = lambda v: F.coalesce(v, F.lit(0.0)) != 0
    return F.filter(rows, lambda r: (text(r["item_code"]) | text(r["description_ar"]) | text(r["description_en"])) & (num(r["unit_price"]) | num(r["quantity"])))


def fix_terms(terms: Column) -> Column:
    """Penalty terms with per as their own words have it."""
    from ..functions.text import clause_period

    return F.transform(terms, lambda t: t.withField("per", clause_period(F.concat_ws(" ", t["text_ar"], t["basis"]))))


def erp_merge(extracted: Column, seeded: Column) -> Column:
    """Documents that were read win over seeded ones, but for the receipt; lists that aren't read stay seeded."""
    filled = lambda name: F.when(F.size(extracted[name]) > 0, extracted[name]).otherwise(seeded[name])
    return F.struct(
        F.coalesce(extracted["invoice"], seeded["invoice"]).alias("invoice"), filled("boq").alias("boq"), F.coalesce(extracted["coc"], seeded["coc"]).alias("coc"),
        F.coalesce(seeded["receipt"], extracted["receipt"]).alias("receipt"), F.coalesce(extracted["contract"], seeded["contract"]).alias("contract"),
        *[seeded[x].alias(x) for x in ("penalties", "attachments", "detected")],
    )


def fix_contract_value(base: Column, total: Column, vat: float = 0.15) -> tuple[Column, Column]:
    """(base, total): equal values are both the total; exchanged values are put right."""
    near = lambda a, b: F.abs(a - b) < 1.0
    equal = (base > 0) & (total > 0) & near(base, total)
    turned = (total > 0) & (base > total) & ~equal & near(base, total * (1 + vat))
    return F.when(equal, F.round(total / (1 + vat), 2)).when(turned, total).otherwise(base), F.when(turned, base).otherwise(total)


def rebase_page(page: Column, offset: Column) -> Column:
    return F.when(page > 0, page + offset).otherwise(0)


def consistent(*checks: Column) -> Column:
    """Three-valued and: parts that are null don't apply; null if none does."""
    applies = F.array_compact(F.array(*checks))
    return F.when(F.size(applies) > 0, F.forall(applies, lambda x: x))


def usage_totals(calls: DataFrame, *numbers: str) -> DataFrame:
    """One row: how many calls, and the sums of their numbers to one decimal."""
    return calls.agg(F.count("*").alias("calls"), *[F.round(F.sum(F.col(x).cast("decimal(18,4)")), 1).cast("double").alias(x) for x in numbers])
