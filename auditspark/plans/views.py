"""Claims-shaped views of the star-schema test tables: orders are claims, line items their lines, parts the bill of quantities.

Values are perturbed by remainders of the key, so that every rule has claims that keep it and claims that break it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rules import REQUIRED_ATTACHMENTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their position in the order; the natural key repeats, so all columns order it."""
    items = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return items.withColumn("pos", F.row_number().over(order))


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, pos, item_code, quantity (negative where returned), unit_price (5 above the list in every third line), amount."""
    price = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    rows = line_items(spark, sf_dir).join(price, "l_partkey")
    quantity = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    unit = F.col("p_retailprice") + F.when(F.col("l_linenumber") % 3 == 0, 5.0).otherwise(0.0)
    return rows.select(F.col("l_orderkey").alias("claim_id"), "pos", F.col("l_partkey").alias("item_code"), quantity.alias("quantity"), unit.alias("unit_price"), (quantity * unit).alias("amount"))


def boq_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, item_code, unit_price, quantity, shared by all claims: no tenth part, every seventh twice."""
    part = table(spark, sf_dir, "part").filter(F.col("p_partkey") % 10 != 0)
    copies = F.explode(F.when(F.col("p_partkey") % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("pos")
    rows = part.select(copies, F.col("p_partkey").alias("item_code"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("quantity"))
    return rows.select("pos", "item_code", (F.col("price") + F.col("pos") - 1).alias("unit_price"), "quantity")


def receipt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_items(spark, sf_dir).filter("l_linestatus = 'F'")
    quantity = F.col("l_quantity") - F.when(F.col("l_linenumber") % 4 == 0, 1.0).otherwise(0.0)
    return rows.select(F.col("l_orderkey").alias("claim_id"), "pos", F.col("l_partkey").alias("item_code"), quantity.alias("quantity"))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, contract, claim_date, amount: orders as payments on their customer's contract."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("contract"), F.col("o_orderdate").alias("claim_date"), F.col("o_totalprice").alias("amount"))


def contract_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contract, contract_value: what was paid on it in all, a tenth less for even contracts. Exact in decimals."""
    paid = payments(spark, sf_dir).groupBy("contract").agg(F.sum(F.col("amount").cast("decimal(18,2)")).alias("s"))
    share = F.when(F.col("contract") % 2 == 0, F.lit("0.9")).otherwise(F.lit("1.0")).cast("decimal(2,1)")
    return paid.select("contract", (F.col("s") * share).cast("decimal(28,4)").alias("contract_value"))


def _iso(d):
    return F.date_format(d, "yyyy-MM-dd")


def tlv_payload(values: dict) -> Column:
    """A base64 payload of tags and texts of up to 255 bytes."""
    byte = lambda n: F.unhex(F.lpad(F.hex(n), 2, "0"))
    parts = [F.concat(byte(F.lit(t)), byte(F.octet_length(v)), F.encode(v, "UTF-8")) for t, v in values.items()]
    return F.regexp_replace(F.base64(F.concat(*parts)), r"\s", "")


def invoice_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, total (text), payload: codes of orders; every sixteenth total is 10 too high."""
    o = table(spark, sf_dir, "orders")
    k, total = F.col("o_orderkey"), F.format_string("%.2f", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 16 == 0, 10.0).otherwise(0.0))
    fields = {1: F.concat(F.lit("Vendor "), (k % 100).cast("string")), 2: F.concat(F.lit("3"), F.lpad(k.cast("string"), 13, "0"), F.lit("3")), 3: F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), 4: total, 5: F.lit("0.00")}
    return o.select(k.alias("id"), "o_totalprice", total.alias("total"), F.to_date("o_orderdate").alias("day"), tlv_payload(fields).alias("payload"))


def nested_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole claims in the nested schema. Lines are gathered per order, of which there are few."""
    lines = invoice_lines(spark, sf_dir)
    known = boq_lines(spark, sf_dir).groupBy("item_code").agg(F.max(F.struct("pos", "unit_price", "quantity")).alias("b")).select("item_code", F.col("b.unit_price").alias("boq_price"), F.col("b.quantity").alias("boq_quantity"))
    received = receipt_lines(spark, sf_dir).select("claim_id", "pos", F.col("quantity").alias("received"))
    code = F.col("item_code").cast("string")
    nothing = F.lit(None)
    line = F.struct("pos", code.alias("item_code"), F.lit("").alias("description_ar"), "unit_price", "quantity", "amount", F.lit(1).alias("page"), F.lit("").alias("source_file"))
    ref = F.when(F.col("boq_price").isNotNull(), F.struct("pos", code.alias("item_code"), F.lit("").alias("description_ar"), F.lit("").alias("description_en"), F.lit("").alias("unit"), F.col("boq_price").alias("unit_price"), F.col("boq_quantity").alias("quantity"), F.lit(1).alias("page"), F.lit("").alias("source_file")))
    got = F.when(F.col("received").isNotNull(), F.struct("pos", code.alias("item_code"), F.lit("").alias("description_ar"), F.col("received").alias("quantity"), F.lit(1).alias("page"), F.lit("").alias("source_file")))
    gather = lambda v, name: F.transform(F.array_sort(F.collect_list(v)), lambda x: x.dropFields("pos")).alias(name)
    by = lines.join(known, "item_code", "left").join(received, ["claim_id", "pos"], "left").groupBy("claim_id").agg(gather(line, "lines"), gather(ref, "boq"), gather(got, "received"))

    o = table(spark, sf_dir, "orders").join(by, F.col("o_orderkey") == F.col("claim_id"), "left")
    k, base, day = F.col("o_orderkey"), F.col("o_totalprice"), F.to_date("o_orderdate")
    mod = lambda n: k % n
    vat = base * 0.15
    total = base + vat + F.when(mod(5) == 0, 1.0).otherwise(0.0)
    value = F.when(mod(6) == 0, 0.0).when(mod(6) == 1, base).otherwise(base * 3.0)
    kind = F.when(mod(7) == 0, "final").when(mod(7) == 1, "first").otherwise("periodic")
    end = F.date_add(day, (mod(40) - 20).cast("int"))
    number = F.concat(F.lit("INV-2026-"), k.cast("string"))
    vat_no = F.concat(F.lit("3"), F.lpad(k.cast("string"), 13, "0"), F.lit("3"))
    false = F.when(mod(2) == 0, F.lit(False))
    term = lambda rate, per, cap: F.array(F.struct(F.lit("delay").alias("kind"), F.lit(rate).alias("rate_percent"), F.lit(per).alias("per"), F.lit("").alias("basis"), F.lit(cap).alias("cap_percent"), F.lit("").alias("text_ar"), F.lit("c").alias("ref"), F.lit(1).alias("page"), F.lit("").alias("source_file")))
    seen = lambda key, vat_number, expiry: F.struct(F.lit(f"{key}.pdf").alias("file_name"), F.lit(key).alias("doc_key"), F.create_map(F.lit("cr_number"), F.lpad(k.cast("string"), 10, "1"), F.lit("vat_number"), vat_number, F.lit("expiry_date"), _iso(expiry), F.lit("vendor_name_ar"), F.concat(F.lit("vendor "), (k % 100).cast("string"))).alias("fields"), F.lit(1).alias("page"))
    said = F.format_string("%.2f", total + F.when(mod(16) == 0, 10.0).otherwise(0.0))
    payload = tlv_payload({1: F.concat(F.lit("Vendor "), (k % 100).cast("string")), 2: vat_no, 3: _iso(day), 4: said, 5: F.format_string("%.2f", vat)})
    payload = F.when(mod(37) == 0, "").otherwise(payload)
    invoice = F.struct(number.alias("invoice_no"), _iso(day).alias("invoice_date"), F.concat(F.lit("Vendor "), (k % 100).cast("string")).alias("seller_name_ar"), vat_no.alias("seller_vat_number"), total.alias("total_with_vat"), vat.alias("vat_amount"), (mod(31) == 0).alias("vat_exempt"), payload.alias("qr_payload"), "lines", F.lit(1).alias("page"), F.lit("").alias("source_file"))
    coc = F.struct(
        F.lit("C").alias("coc_no"), _iso(F.date_add(day, mod(30).cast("int"))).alias("coc_date"), (total + F.when(mod(13) == 0, 2.0).otherwise(0.0)).alias("claim_amount"), base.alias("claim_net"), (vat + F.when(mod(17) == 0, 3.0).otherwise(0.0)).alias("vat_amount"), F.concat(F.lit("inv 2026/"), k.cast("string")).alias("invoice_ref"),
        mod(4).cast("int").alias("payment_no"), F.when(mod(19) == 0, "periodic").otherwise(kind).alias("claim_type"), F.lit("").alias("contract_no"), F.lit("").alias("contract_start_date"), _iso(F.date_add(end, mod(8).cast("int"))).alias("contract_end_date"),
        (value * 1.15 + F.when(mod(23) == 0, 5.0).otherwise(0.0)).alias("contract_value_with_vat"), F.lit("").alias("award_letter_no"), F.lit("").alias("site_handover_date"), false.alias("has_delay"), false.alias("has_stoppage"), false.alias("has_observations"), F.lit(0).alias("delay_days"), F.lit(1).alias("page"), F.lit("").alias("source_file"),
    )
    receipt = F.struct(F.lit("R").alias("receipt_no"), _iso(F.date_add(day, mod(25).cast("int"))).alias("receipt_date"), F.col("received").alias("lines"), F.lit(1).alias("page"), F.lit("").alias("source_file"))
    contract = F.struct(F.lit("K").alias("contract_no"), F.lit("").alias("start_date"), F.lit("").alias("end_date"), value.alias("value_base"), F.lit(0.0).alias("value_with_vat"), F.when(mod(4) == 1, term(1.0, "week", 10.0)).when(mod(4) == 2, term(0.1, "day", 5.0)).otherwise(F.filter(term(1.0, "", 1.0), lambda _: F.lit(False))).alias("penalty_terms"), F.lit(1).alias("page"), F.lit("").alias("source_file"))
    penalty = F.array(F.struct(F.lit("").alias("reason_ar"), (mod(5) * 100.0).alias("amount"), F.lit("").alias("date")))
    filed = F.filter(F.transform(F.array(*map(F.lit, REQUIRED_ATTACHMENTS)), lambda x, i: F.when(i != mod(8), x)), lambda x: x.isNotNull())
    documents = F.struct(
        F.when(mod(29) != 0, invoice).alias("invoice"), F.col("boq"), F.when(mod(9) != 0, coc).alias("coc"), F.when(mod(10) != 0, receipt).alias("receipt"), contract.alias("contract"),
        F.when(mod(3) == 0, penalty).otherwise(F.filter(penalty, lambda _: F.lit(False))).alias("penalties"), filed.alias("attachments"),
        F.array(seen("commercial registration", vat_no, F.date_add(day, (mod(50) - 10).cast("int"))), seen("zakat certificate", F.when(mod(14) == 0, F.lit("399999999999993")).otherwise(vat_no), F.date_add(day, F.lit(30)))).alias("detected"),
    )
    claimed = F.when(mod(11) == 0, "").when(mod(11) == 1, F.concat(k.cast("string"), F.lit("-2026-INV"))).otherwise(number)
    return o.select(
        k.cast("string").alias("id"), F.lit("").alias("po_no"), F.concat(F.lit("vendor "), (k % 100).cast("string")).alias("vendor_name_ar"), value.alias("contract_value"), base.alias("claim_amount_base"), vat.alias("vat_amount"), total.alias("claim_amount_total"),
        F.when(mod(6) == 1, 0.0).otherwise(base * mod(3)).alias("cumulative_prior"), F.when(F.col("o_orderstatus") == "F", "goods").otherwise("works").alias("contract_kind"), _iso(end).alias("contract_end_date"), _iso(day).alias("claim_date"),
        claimed.alias("invoice_no"), mod(4).cast("int").alias("payment_no"), mod(3).cast("int").alias("prior_payment_count"), kind.alias("claim_type"), documents.alias("documents"),
    )
