"""From a document's raw read to claim documents: dates, codes, pages, bills, penalty terms and contract values put in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..functions.dates import normalize_date
from ..functions.text import coerce_code
from .merge import fix_contract_value, fix_terms, real_rows, rebase_page

# Header fields that a focused second read settles, and anchors that a read may name.
KEY_FIELDS = {"invoice": ["invoice_no", "invoice_date", "seller_vat_number", "total_with_vat", "vat_amount"], "coc": ["coc_no", "coc_date", "claim_amount", "claim_net", "vat_amount", "invoice_ref"], "receipt": ["receipt_no", "receipt_date"], "contract": ["contract_no", "value_base", "value_with_vat"]}
ANCHORS = ("commencement_date", "site_handover_date", "signing_date")
#: Lists that a read never fills.
NOT_READ = ("penalties", "attachments", "detected")


def in_order(value: Column, kind: DataType, offset: Column, name: str = "") -> Column:
    """value with dates, codes and pages in order wherever they stand: fields are known by name, at any depth."""
    if isinstance(kind, StructType):
        fields = [in_order(value[f.name], f.dataType, offset, f.name).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: in_order(x, kind.elementType, offset, name)) if isinstance(kind.elementType, StructType) else value
    if name.endswith("_date") and kind.simpleString() == "string":
        return F.coalesce(normalize_date(value), value)
    if name == "item_code":
        return coerce_code(value)
    return rebase_page(value, offset) if name == "page" else value


def validate_read(reads: DataFrame, docs: str = "documents", offset: Column | None = None) -> DataFrame:
    """reads with the column docs as claims have it; lists that aren't read become null, anchors, if any, trimmed texts."""
    kind = reads.schema[docs].dataType
    whole = reads.withColumn(docs, in_order(F.col(docs), kind, F.lit(0) if offset is None else offset))
    v, names = F.col(docs), set(kind.names)
    if "boq" in names:
        v = v.withField("boq", real_rows(F.coalesce(v["boq"], F.array().cast(kind["boq"].dataType))))
    if "contract" in names:
        base, total = fix_contract_value(F.coalesce(v["contract"]["value_base"], F.lit(0.0)), F.coalesce(v["contract"]["value_with_vat"], F.lit(0.0)))
        contract = v["contract"].withField("value_base", base).withField("value_with_vat", total)
        if "penalty_terms" in kind["contract"].dataType.names:
            contract = contract.withField("penalty_terms", fix_terms(v["contract"]["penalty_terms"]))
        v = v.withField("contract", F.when(v["contract"].isNotNull(), contract))
    for name in NOT_READ:
        if name in names:
            v = v.withField(name, F.lit(None).cast(kind[name].dataType))
    out = whole.withColumn(docs, F.when(F.col(docs).isNotNull(), v))
    if "anchors" in out.columns:
        out = out.withColumn("anchors", F.struct(*[F.trim(F.coalesce(F.col("anchors")[x], F.lit(""))).alias(x) for x in ANCHORS]))
    return out


def without_key_fields(docs: Column, kind: StructType) -> Column:
    """Documents without the header fields that the second read settles, for comparing two reads."""
    for section, fields in KEY_FIELDS.items():
        if section in kind.names:
            docs = docs.withField(section, docs[section].dropFields(*[x for x in fields if x in kind[section].dataType.names]))
    return docs


def unused_files(dropped: DataFrame, kept: DataFrame) -> DataFrame:
    """Paths of dropped files (claim_id, path) that no kept one of the claim names: what may be deleted."""
    return dropped.select("claim_id", "path").distinct().join(kept.select("claim_id", "path"), ["claim_id", "path"], "left_anti")
