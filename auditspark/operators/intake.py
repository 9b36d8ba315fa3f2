"""What happens between reading documents and checking them: codes beside faces, kinds of attachments, fields read twice,
places on pages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ATTACHMENTS, bind, display_name, doc_key, signature

# Fields that an attachment may print; what a claim's files of one kind stand for.
ATTACHMENT_FIELDS = ["vendor_name_ar", "cr_number", "vat_number", "reference_no", "issue_date", "expiry_date"]
AMOUNT_OFF = 0.01

#: Polygons of up to so many points, the usual ones, are read without lambda functions.
CORNERS = 4


def qr_summary(invoices: DataFrame) -> DataFrame:
    """invoices (id, q, status and the face: seller_name, vat_number, invoice_date, total, vat) -> (id, field, decoded,
    expected, match, status): five rows a code; match is null where one side is empty."""
    get = lambda n: F.coalesce(F.try_element_at("q.fields", F.lit(n)), F.lit(""))
    face = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    amount = lambda n: F.coalesce(F.abs(get(n).try_cast("double") - F.col(n)) <= AMOUNT_OFF, F.lit(False))
    pairs = [
        ("seller_name", get("seller_name"), face("seller_name"), display_name(get("seller_name")) == display_name(F.col("seller_name"))),
        ("vat_number", get("vat_number"), face("vat_number"), get("vat_number") == face("vat_number")),
        ("timestamp", get("timestamp"), face("invoice_date"), F.startswith(get("timestamp"), face("invoice_date"))),
        ("total", get("total"), F.format_string("%.2f", F.col("total")), amount("total")),
        ("vat", get("vat"), F.format_string("%.2f", F.col("vat")), amount("vat")),
    ]
    rows = [F.struct(F.lit(n).alias("field"), d.alias("decoded"), e.alias("expected"), F.when((d != "") & (e != ""), m).alias("match")) for n, d, e, m in pairs]
    return invoices.filter("q is not null").select("id", "status", F.inline(F.array(*rows)))


def classify_attachments(files: DataFrame, detected: DataFrame) -> DataFrame:
    """files (id, pos, file_name), detected (id, file_name, ord, doc_key): every detection of a file, each kind once, the
    first; files without one by their name."""
    known = detected.filter(F.col("doc_key").isin(list(ATTACHMENTS)))
    first = known.groupBy("id", "file_name", "doc_key").agg(F.min("ord").alias("ord"))
    joined = files.join(first, ["id", "file_name"], "left")
    guess = F.when(F.col("doc_key").isNull(), F.lit("name")).otherwise("reader")
    return joined.select("id", "pos", "file_name", F.coalesce("doc_key", doc_key(F.col("file_name"))).alias("doc_key"), "ord", guess.alias("by"))


def labels(rows: DataFrame) -> DataFrame:
    """rows with the English label of their doc_key, the key itself where there is none."""
    names = F.create_map(*[F.lit(x) for k, (label, _) in ATTACHMENTS.items() for x in (k, label)])
    return rows.withColumn("label", F.coalesce(F.try_element_at(names, F.col("doc_key")), F.nullif(F.col("doc_key"), F.lit("")), F.lit("document")))


def attachment_keys(classified: DataFrame, files: DataFrame) -> DataFrame:
    """(id, keys): the sorted kinds of a claim's attachments; a file of contract and bill stands for both. files (id, doc_type)."""
    of_files = files.filter("doc_type = 'contract_boq'").select("id", F.explode(F.array(F.lit("contract"), F.lit("boq"))).alias("doc_key"))
    both = classified.filter("doc_key != 'other'").select("id", "doc_key").unionByName(of_files)
    return both.groupBy("id").agg(F.array_sort(F.collect_set("doc_key")).alias("keys"))


def detected_from_raw(answers: DataFrame) -> DataFrame:
    """answers (id, file_name, raw): the JSON list in a noisy answer as (id, file_name, ord, doc_key, fields, page), known
    kinds and fields only, of each kind the first, empty values dropped."""
    schema = "array<struct<doc_key: string, page: int, fields: map<string, string>>>"
    items = F.from_json(F.nullif(F.regexp_extract("raw", r"(?s)\[.*\]", 0), F.lit("")), schema)
    flat = answers.select("id", "file_name", F.posexplode(items).alias("ord", "e")).filter(F.col("e.doc_key").isin(list(ATTACHMENTS)))
    fields = F.map_filter(F.coalesce("e.fields", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(ATTACHMENT_FIELDS) & (F.coalesce(v, F.lit("")) != ""))
    rows = flat.select("id", "file_name", "ord", F.col("e.doc_key").alias("doc_key"), fields.alias("fields"), F.greatest(F.coalesce("e.page", F.lit(0)), F.lit(0)).alias("page"))
    first = rows.groupBy("id", "file_name", "doc_key").agg(F.min("ord").alias("ord"))
    return rows.join(first, ["id", "file_name", "doc_key", "ord"]).select("id", "file_name", "ord", "doc_key", "fields", "page")


def looks_like(documents: Column) -> Column:
    """What a file that was sent as an invoice is, by what could be read of it."""
    contract = documents["contract"].isNotNull() | (F.size(documents["boq"]) > 0)
    return F.when(contract, "contract").when(documents["coc"].isNotNull(), "coc").when(documents["receipt"].isNotNull(), "receipt").otherwise("unknown")


def override(full: Column, focused: Column, section_there: Column) -> Column:
    """The focused read of a field where its section exists and the two differ in their digits."""
    value = F.nullif(focused, F.lit(""))
    return F.when(section_there & value.isNotNull() & ~signature(value).eqNullSafe(signature(full)), value).otherwise(full)


def stamp_source(rows: Column, source: Column) -> Column:
    """Rows with source_file where they have none."""
    return F.transform(rows, lambda r: r.withField("source_file", F.coalesce(F.nullif(r["source_file"], F.lit("")), source)))


def polygon(source: Column) -> Column:
    """'D(page,x1,y1,...)' as (page, points)."""
    return bind(lambda v: shape(v["numbers"]), numbers=coordinates(source))


def coordinates(source: Column) -> Column:
    """The numbers of a polygon's text, null where there is none: the first half of polygon, for rows that keep it as a column."""
    return F.split(F.regexp_extract(source, r"D\(([^)]*)\)", 1), ",").try_cast("array<double>")


def whole_points(numbers: Column) -> Column:
    """How many points have both numbers."""
    return F.greatest(F.floor((F.size(numbers) - 1) / 2), F.lit(0)).cast("int")


def shape(numbers: Column) -> Column:
    """Numbers of a polygon as (page, points)."""
    n = whole_points(numbers)
    at = lambda i: F.try_element_at(numbers, i)
    point = lambda i: F.struct(at(2 * i + 2).alias("x"), at(2 * i + 3).alias("y"))
    points = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), point)
    few = _few(n, lambda k: F.array(*[point(F.lit(i)) for i in range(k)]))
    return F.struct(at(F.lit(1)).try_cast("int").alias("page"), few.when(n > 0, points).otherwise(F.array().cast("array<struct<x: double, y: double>>")).alias("points"))


def _few(n: Column, value: Callable[[int], Column]) -> Column:
    """A case for each n up to CORNERS, without a lambda function, which is interpreted for each point."""
    out = F.when(n == CORNERS, value(CORNERS))
    for k in range(1, CORNERS):
        out = out.when(n == k, value(k))
    return out


def centroid(points: Column) -> Column:
    added = lambda n, k: reduce(lambda acc, i: acc + F.try_element_at(points, F.lit(i + 1))[n], range(k), F.lit(0.0))
    total = lambda n: _few(F.size(points), lambda k: added(n, k)).otherwise(F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[n]))
    mean = lambda n: total(n) / F.size(points)
    return F.when(F.size(points) > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))


def page_fraction(points: Column, width: Column, height: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] / width).alias("x"), (p["y"] / height).alias("y")))


def file_index(files: Column, name: Column, doc_type: Column) -> Column:
    """Place of the file of that base name, else of the first of the type, else -1; files: array of (path, doc_type)."""
    base = lambda p: F.element_at(F.split(p, "/"), -1)
    by_name = F.array_position(F.transform(files, lambda f: base(f["path"])), base(name))
    by_type = F.array_position(F.transform(files, lambda f: f["doc_type"]), doc_type)
    return F.coalesce(F.nullif(by_name, F.lit(0)), F.nullif(by_type, F.lit(0)), F.lit(0)).cast("int") - 1


def line_location(evidence: DataFrame, lines: DataFrame, headers: DataFrame) -> DataFrame:
    """evidence (claim_id, doc, item_code): page and file of the line of that code, else of the document's header.
    lines (claim_id, doc, item_code, page, source_file), headers (claim_id, doc, page, source_file)."""
    first = lines.groupBy("claim_id", "doc", "item_code").agg(F.min(F.struct("page", "source_file")).alias("l"))
    head = headers.select("claim_id", "doc", F.struct("page", "source_file").alias("h"))
    out = evidence.join(first, ["claim_id", "doc", "item_code"], "left").join(head, ["claim_id", "doc"], "left").withColumn("at", F.coalesce("l", "h"))
    return out.select("claim_id", "doc", "item_code", "at.page", "at.source_file")
