"""Matching of invoice, contract and receipt lines, as joins over tables of lines.

Tables: invoice lines (claim_id, pos, item_code, unit_price, quantity, amount), bill of quantities (claim_id, pos, item_code,
unit_price, quantity), receipt lines (claim_id, pos, item_code, quantity). Where a code repeats in a reference table, its
last row counts. Every join is on (claim_id, item_code), so line tables kept in buckets by claim_id are joined in place.
A bill of quantities that all claims share can be given without claim_id; then codes alone are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import MONEY, QUANTITY


def deduction() -> Column:
    return (F.coalesce("quantity", F.lit(0.0)) < 0) | (F.coalesce("amount", F.lit(0.0)) < 0)


def keys_of(boq: DataFrame) -> list[str]:
    return ["claim_id", "item_code"] if "claim_id" in boq.columns else ["item_code"]


def last_of_code(rows: DataFrame) -> DataFrame:
    """The last row of each code: an aggregate, so that repeated codes meet before the shuffle."""
    keys = keys_of(rows)
    rest = [x for x in rows.columns if x not in keys]
    picked = rows.groupBy(*keys).agg(F.max(F.struct("pos", *[x for x in rest if x != "pos"])).alias("r"))
    return picked.select(*keys, *[F.col(f"r.{x}").alias(x) for x in rest])


def reference(boq: DataFrame, *names: str) -> DataFrame:
    last = last_of_code(boq)
    return last.select(*keys_of(boq), *[F.col(x).alias(f"boq_{x}") for x in names], F.lit(True).alias("in_boq"))


def boq_lines_match(lines: DataFrame, boq: DataFrame) -> DataFrame:
    """Each billed line with issue: 'not in BoQ', 'unit price' or null. Deductions aren't compared."""
    joined = lines.filter(~deduction()).join(reference(boq, "unit_price"), keys_of(boq), "left")
    issue = F.when(F.col("in_boq").isNull(), "not in BoQ").when(F.abs(F.col("unit_price") - F.col("boq_unit_price")) > MONEY, "unit price")
    return joined.select("claim_id", "pos", "item_code", "unit_price", "boq_unit_price", issue.alias("issue"))


def line_match_summary(lines: DataFrame, boq: DataFrame) -> DataFrame:
    """(claim_id, ok, mismatches, deductions) for every claim with lines."""
    bad = boq_lines_match(lines, boq).groupBy("claim_id").agg(F.count_if(F.col("issue").isNotNull()).alias("mismatches"))
    cut = lines.groupBy("claim_id").agg(F.count_if(deduction()).alias("deductions"))
    out = cut.join(bad, "claim_id", "left").withColumn("mismatches", F.coalesce("mismatches", F.lit(0)))
    return out.select("claim_id", (F.col("mismatches") == 0).alias("ok"), "mismatches", "deductions")


def billed_vs_received(lines: DataFrame, receipts: DataFrame, boq: DataFrame) -> DataFrame:
    """Lines billed above what was received; a code that wasn't received counts as 0."""
    got = last_of_code(receipts).select(*keys_of(receipts), F.col("quantity").alias("received"))
    joined = lines.join(got, keys_of(receipts), "left").join(reference(boq, "quantity"), keys_of(boq), "left")
    joined = joined.withColumn("received", F.coalesce("received", F.lit(0.0)))
    return joined.filter(F.col("quantity") > F.col("received") + QUANTITY).select("claim_id", "pos", "item_code", F.col("quantity").alias("billed"), "received", "boq_quantity")


def received_within_boq(receipts: DataFrame, boq: DataFrame) -> DataFrame:
    joined = receipts.join(reference(boq, "quantity"), keys_of(boq), "left")
    issue = F.when(F.col("in_boq").isNull(), "not in BoQ").when(F.col("quantity") > F.col("boq_quantity") + QUANTITY, "quantity")
    return joined.withColumn("issue", issue).filter(F.col("issue").isNotNull()).select("claim_id", "pos", "item_code", F.col("quantity").alias("received"), "boq_quantity", "issue")


def certified_values(claims: DataFrame, receipts: DataFrame, boq: DataFrame) -> DataFrame:
    """(claim_id, certified): received quantities at contract prices, exact in decimals; 0 without a match."""
    price = reference(boq, "unit_price").drop("in_boq")
    value = F.sum(F.col("quantity").cast("decimal(18,4)") * F.col("boq_unit_price").cast("decimal(18,4)")).cast("decimal(38,4)")
    sums = receipts.join(price, keys_of(boq)).groupBy("claim_id").agg(value.alias("certified"))
    return claims.select("claim_id").join(sums, "claim_id", "left").withColumn("certified", F.coalesce("certified", F.lit(0).cast("decimal(38,4)")))


def pair_lines(lines: DataFrame, boq: DataFrame, deductions: bool = False) -> DataFrame:
    """Full outer pairing: the k-th row of a code in the bill takes the k-th billed line of the code. Empty codes don't pair.

    With deductions, those lines are rows too, paired with nothing.
    """
    keys = keys_of(boq)
    if deductions:
        columns = ["claim_id", F.nullif(F.col("item_code").cast("string"), F.lit("")).alias("code"), F.col("pos").alias("line_pos"), F.col("unit_price").alias("billed_price"), F.col("quantity").alias("billed_quantity")]
        apart = lines.filter(deduction()).select(*columns).withColumn("status", F.lit("deduction"))
        return pair_lines(lines, boq).unionByName(apart, allowMissingColumns=True)
    nth = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy("pos"))
    mine = lines.filter(~deduction()).withColumn("nth", nth(["claim_id", "item_code"]))
    mine = mine.select("claim_id", F.nullif(F.col("item_code").cast("string"), F.lit("")).alias("code"), "nth", F.col("pos").alias("line_pos"), F.col("unit_price").alias("billed_price"), F.col("quantity").alias("billed_quantity"))
    ref = boq.withColumn("nth", nth(keys)).select(*keys[:-1], F.nullif(F.col("item_code").cast("string"), F.lit("")).alias("code"), "nth", F.col("pos").alias("boq_pos"), F.col("unit_price").alias("boq_price"), F.col("quantity").alias("boq_quantity"))
    return mine.join(ref, [*keys[:-1], "code", "nth"], "full_outer").withColumn("status", line_status())


def line_status() -> Column:
    """Of a paired row: not billed, not in the bill, price agrees or not."""
    return F.when(F.col("line_pos").isNull(), "not billed").when(F.col("boq_pos").isNull(), "not in BoQ").when(F.abs(F.col("billed_price") - F.col("boq_price")) <= MONEY, "price matches").otherwise("unit price differs")


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("status").agg(F.count("*").alias("n"))


def missing_attachments(claims: DataFrame, attachments: DataFrame, required: list[str]) -> DataFrame:
    """(claim_id, doc_key) that are required and not filed; attachments (claim_id, name)."""
    want = claims.select("claim_id").distinct().select("claim_id", F.explode(F.array(*map(F.lit, required))).alias("doc_key"))
    have = attachments.select("claim_id", F.lower(F.trim("name")).alias("doc_key"))
    return want.join(have, ["claim_id", "doc_key"], "left_anti")


def payment_history(claims: DataFrame) -> DataFrame:
    """claims (claim_id, contract, claim_date, amount) with what was paid on the contract before: cumulative_prior, prior_count."""
    before = Window.partitionBy("contract").orderBy("claim_date", "claim_id").rowsBetween(Window.unboundedPreceding, -1)
    paid = F.coalesce(F.sum(F.col("amount").cast("decimal(18,4)")).over(before), F.lit(0)).cast("decimal(28,4)")
    return claims.withColumn("cumulative_prior", paid).withColumn("prior_count", F.count("*").over(before))


def identity_check(printed: DataFrame) -> DataFrame:
    """printed (claim_id, field, value): fields of which two documents or more print a value, and whether all agree."""
    from ..functions.text import ident_key

    named = printed.filter(F.coalesce("value", F.lit("")) != "").groupBy("claim_id", "field").agg(F.count("*").alias("n"), F.count_distinct(ident_key(F.col("value"))).alias("values"))
    return named.filter("n >= 2").withColumn("ok", F.col("values") == 1)


def line_totals(boq: DataFrame) -> DataFrame:
    """(claim_id, total): unit price times quantity, summed exactly; a missing number counts as 0."""
    number = lambda x: F.coalesce(F.col(x), F.lit(0.0)).cast("decimal(18,4)")
    return boq.groupBy("claim_id").agg(F.sum((number("unit_price") * number("quantity")).cast("decimal(28,4)")).alias("total"))
