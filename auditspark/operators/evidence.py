"""Evidence of findings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Computed figures aren't printed anywhere; the rest leads to a document by the words of its path.
COMPUTED = r"(?i)(remaining|expected|difference|certified|cumulative|deductions|delay_days)"
LEADS = (("invoice", r"(?i)(invoice|vat|qr)"), ("contract_boq", r"(?i)(boq|contract)"), ("coc", r"(?i)coc|completion"), ("delivery_note", r"(?i)receipt|received"))


def nesting(json: Column) -> Column:
    """How many brackets of a JSON text are open at once, at most; those within strings don't count."""
    brackets = F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\\\]|\\\\.)*+"', ""), r"[^\[\]{}]", "")
    step = lambda at, x: F.struct((at["now"] + F.when(x.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(at["most"], at["now"] + F.when(x.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.when(brackets != "", F.aggregate(F.split(brackets, ""), start, step)["most"]).otherwise(F.when(json.isNotNull(), 0))


def flatten_json(rows: DataFrame, column: str, depth: int | None = None) -> DataFrame:
    """All columns of rows but column, with path and value of every leaf of the JSON text.

    Each level explodes objects and arrays of what is left, as often as the deepest text is nested: without a depth that is
    measured first, and with one, deeper parts are kept as JSON text. A JSON text's size bounds its leaves.
    """
    if depth is None:
        depth = rows.agg(F.max(nesting(F.col(column)))).first()[0] or 0
    keep = [x for x in rows.columns if x != column]
    todo = rows.select(*keep, F.lit("").alias("path"), F.try_parse_json(column).alias("v"))
    done = todo.limit(0)
    for _ in range(depth):
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        leaf = todo.filter(~F.coalesce(nested, F.lit(False)))
        done = done.unionByName(leaf)
        todo.filter(nested).createOrReplaceTempView("_nested_evidence")
        cols = ", ".join(f"t.`{x}`" for x in keep)
        todo = rows.sparkSession.sql(f"SELECT {cols}{', ' if cols else ''}concat(t.path, '.', coalesce(e.key, cast(e.pos AS string))) AS path, e.value AS v FROM _nested_evidence t, LATERAL variant_explode(t.v) e")
    done = done.unionByName(todo)
    return done.filter("path != ''").select(*keep, F.expr("substring(path, 2)").alias("path"), F.expr("cast(v AS string)").alias("value"))


def target_document(path: Column) -> Column:
    out = F.when(path.rlike(COMPUTED), None)
    for name, pattern in LEADS:
        out = out.when(path.rlike(pattern), name)
    return out
