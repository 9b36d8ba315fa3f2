"""Invoice and receipt lines to rows of the bill of quantities by wording and price, where codes don't say it.

Lines and rows are shuffled by claim and part of its lines; their pairs exist only within a task, which returns a row for
each line that has a match (``matches``). Wording is compared only where it can matter: an upper bound of the measure, from the
letters that two texts have in common, is worked out for every pair, and rows are compared from the highest bound on until no
other can be the best or a runner-up within the lead that a match must have. ``scores`` has a row for every pair. The
assignment, in which a row that one line has isn't given to another, is a set operation too: a line's target doesn't depend on
other lines, so of the lines with one target the first takes it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.similarity import COVER_FROM, COVER_MOST, measure, most_alike, similarity
from ..functions.text import canonical_code, name_key
from .checks import MONEY
from .lines import deduction

# Wording alone, its lead over the next, wording with an equal price, what the price adds, the lead to move.
ACCEPT, LEAD, WITH_PRICE, PRICE_ADDS, MOVE_LEAD, PLAUSIBLE = 0.9, 0.04, 0.45, 0.05, 0.1, 0.75
# Fixed value: how far doubles of one sum can be apart.
TINY = 1e-9
#: Lines of a claim that a group compares with the rows of the bill.
PART = 2_048
# Fixed value: how a date begins that isn't a duration.
ISO = r"^\d{4}-\d{2}-\d{2}"


def line_key(lines: DataFrame) -> list[str]:
    """Columns that name a line: of one document, or of several with the column doc."""
    return [x for x in ("claim_id", "doc", "pos") if x in lines.columns]


def canonical_matches(lines: DataFrame, boq: DataFrame) -> DataFrame:
    """(line, target): the only code of the bill with the line's canonical code."""
    index = boq.groupBy("claim_id", canonical_code(F.col("item_code")).alias("canon")).agg(F.count_distinct("item_code").alias("n"), F.min("item_code").alias("target")).filter("n = 1")
    mine = lines.filter(F.trim(F.coalesce("item_code", F.lit(""))) != "").select(*line_key(lines), canonical_code(F.col("item_code")).alias("canon"))
    return mine.join(index, ["claim_id", "canon"]).select(*line_key(lines), "target")


def same_price(a: Column, b: Column) -> Column:
    return (F.coalesce(a, F.lit(0.0)) != 0) & F.coalesce(F.abs(a - b) <= MONEY, F.lit(False))


def letter_bag(key: Column) -> Column:
    """The letters of a text, the n-th of each kind told apart: texts have as many letters in common as their bags."""
    letters = F.array_sort(F.transform(F.filter(F.split(key, ""), lambda c: c != ""), F.ascii))
    return F.transform(letters, lambda c, i: c.cast("long") * 65536 + i - F.array_position(letters, c))


def bound(a: Column, b: Column, common: Column) -> Column:
    """The measure of wording, had the texts a and b all their common letters in the same order: never below the measure."""
    n, m = F.length(a), F.length(b)
    shorter = F.least(n, m)
    covered = F.when(shorter >= COVER_FROM, F.least(common / shorter, F.lit(COVER_MOST))).otherwise(0.0)
    return F.when(a == b, 1.0).when(shorter == 0, 0.0).otherwise(F.greatest(2 * common / (n + m), covered) + 1e-9)


def bounds(lines: DataFrame, boq: DataFrame) -> DataFrame:
    """Every line with every row of its claim: line, item_code, code, line_text, boq_text, same (price), most (bound)."""
    by = line_key(lines)
    mine = lines.filter(~deduction()).select(*by, "item_code", name_key(F.col("description")).alias("line_text"), F.col("unit_price").alias("line_price")).filter("line_text != ''")
    ref = boq.select("claim_id", F.col("pos").alias("boq_pos"), F.col("item_code").alias("code"), name_key(F.col("description")).alias("boq_text"), F.col("unit_price").alias("boq_price"))
    both = mine.withColumn("line_bag", letter_bag(F.col("line_text"))).join(ref.withColumn("boq_bag", letter_bag(F.col("boq_text"))), "claim_id")
    most = bound(F.col("line_text"), F.col("boq_text"), F.size(F.array_intersect("line_bag", "boq_bag")))
    return both.select(*by, "item_code", "code", "boq_pos", "line_text", "boq_text", same_price(F.col("line_price"), F.col("boq_price")).alias("same"), most.alias("most"))


def compared(lines: DataFrame, boq: DataFrame) -> DataFrame:
    """bounds() with strength: null for pairs that can change no match, as neither best nor a runner-up within the lead."""
    line = Window.partitionBy(*line_key(lines))
    pairs = bounds(lines, boq).withColumn("rival", F.col("code") != F.coalesce("item_code", F.lit("")))
    bonus = F.when(F.max("same").over(Window.partitionBy(*line_key(lines), "code")), PRICE_ADDS).otherwise(0.0)
    pairs = pairs.withColumn("bonus", bonus).withColumn("promise", F.when(F.col("rival"), F.col("most") + F.col("bonus")))
    pairs = pairs.withColumn("i", F.row_number().over(line.orderBy(F.col("promise").desc_nulls_last(), "boq_pos"))).withColumn("priced", F.size(F.collect_set(F.when(F.col("rival") & F.col("same"), F.col("code"))).over(line)))
    of_price = F.col("same") & (F.col("priced") == 1)
    wording = lambda when: similarity(F.when(when, F.col("line_text")), F.when(when, F.col("boq_text")))
    pairs = pairs.withColumn("now", ~F.col("rival") | (F.col("i") == 1) | of_price).withColumn("first", wording(F.col("now")))
    best = F.max(F.when(F.col("rival") & F.col("now"), F.col("first") + F.when(F.col("same"), PRICE_ADDS).otherwise(0.0))).over(line)
    pairs = pairs.withColumn("reach", best - LEAD - 1e-9)
    later = ~F.col("now") & (F.col("promise") >= F.col("reach")) & ((F.col("promise") >= ACCEPT - LEAD - 1e-9) | (F.col("priced") == 1))
    pairs = pairs.withColumn("later", F.coalesce(later, F.lit(False))).withColumn("second", wording(F.col("later")))
    return pairs.withColumn("strength", F.when(F.col("now"), F.col("first")).when(F.col("later"), F.col("second"))).drop("rival", "bonus", "promise", "i", "now", "first", "reach", "later", "second")


def scores(lines: DataFrame, boq: DataFrame) -> DataFrame:
    """(line, item_code, code, strength, same_price, score, row_score, code_ord) for each line and code of its claim; strength
    and scores are null where they can change no match. score: of the code; row_score: of its best row by itself."""
    pairs = compared(lines, boq)
    row = F.col("strength") + F.when(F.col("same"), PRICE_ADDS).otherwise(0.0)
    out = pairs.groupBy(*line_key(lines), "item_code", "code").agg(F.max("strength").alias("strength"), F.max("same").alias("same_price"), F.max(row).alias("row_score"), F.min("boq_pos").alias("code_ord"))
    return out.withColumn("score", F.col("strength") + F.when(F.col("same_price"), PRICE_ADDS).otherwise(0.0))


def best_matches(scored: DataFrame) -> DataFrame:
    """(line, target, score, row_score): lines for which one code is decisively the best, its own not counted."""
    by = line_key(scored)
    others = scored.filter(F.col("code") != F.coalesce("item_code", F.lit("")))
    order = Window.partitionBy(*by).orderBy(F.col("score").desc_nulls_last(), "code_ord")
    ranked = others.withColumn("i", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).withColumn("priced", F.count_if("same_price").over(Window.partitionBy(*by)))
    clear = (F.col("score") >= ACCEPT) & (F.coalesce("next", F.lit(0.0)) <= F.col("score") - LEAD)
    only = (F.col("priced") == 1) & F.col("same_price") & (F.col("strength") >= WITH_PRICE)
    return ranked.filter((F.col("i") == 1) & (clear | only)).select(*by, F.col("code").alias("target"), "score", "row_score")


def _match(like, codes: np.ndarray, first: np.ndarray, own: int, most: np.ndarray, same: np.ndarray) -> tuple[int, float] | None:
    """The code that is decisively the best for a line and its score, or none.

    like: row of the bill -> measure; codes and most: of each row the number of its code (-1: none) and the bound; first: of
    each code its first place; own: the line's code; same: rows of the line's price.
    """
    rival = (codes >= 0) & (codes != own)
    priced = np.unique(codes[rival & same])
    bonus = np.zeros(len(first))
    bonus[priced] = PRICE_ADDS
    promise = np.where(rival, most + bonus[codes], -1.0)
    only = int(priced[0]) if len(priced) == 1 else -1
    rows = np.flatnonzero(promise >= (0.0 if only >= 0 else ACCEPT - LEAD - TINY))
    if not len(rows) or only < 0 and promise.max() < ACCEPT - TINY:
        return None
    wording: dict[int, float] = {}
    top, score, rest = -1, -1.0, 0.0

    def compare(r):
        nonlocal top, score, rest
        c = int(codes[r])
        wording[c] = max(wording.get(c, 0.0), like(r))
        now = wording[c] + float(bonus[c])
        if c == top:
            score = max(score, now)
        elif top < 0 or (now, -first[c]) > (score, -first[top]):
            top, score, rest = c, now, max(rest, score)
        else:
            rest = max(rest, now)

    if only >= 0:
        for r in np.flatnonzero(codes == only):
            compare(r)
    for r in rows[np.argsort(-promise[rows], kind="stable")].tolist():
        p = promise[r]
        if p < score - LEAD - TINY or only < 0 and max(p, score) < ACCEPT - TINY:
            break
        # two are so near to the best there can be that neither is clearly the best: only the price can decide
        if rest > max(p, score) - LEAD + TINY and (only < 0 or top != only or p < score - TINY):
            break
        if codes[r] != only:
            compare(r)
    clear = score >= ACCEPT and rest <= score - LEAD
    return (top, score) if clear or top == only and wording[top] >= WITH_PRICE else None


def _matches(by: list[str], schema: pa.Schema):
    """Lines and rows of a claim -> the lines that have a match."""

    def run(lines: pa.Table, boq: pa.Table) -> pa.Table:
        if not lines.num_rows or not boq.num_rows:
            return schema.empty_table()
        lines = lines.sort_by("line_text")
        number = {x: i for i, x in enumerate(dict.fromkeys(x for x in boq.column("code").to_pylist() if x is not None))}
        codes = np.array([number.get(x, -1) for x in boq.column("code").to_pylist()])
        places = boq.column("boq_pos").cast(pa.float64()).fill_null(-np.inf).to_numpy()
        first = np.full(len(number), np.inf)
        np.minimum.at(first, codes[codes >= 0], places[codes >= 0])
        prices, asked = (x.cast(pa.float64()).fill_null(np.nan).to_numpy() for x in (boq.column("boq_price"), lines.column("line_price")))
        items, texts, rows = lines.column("item_code").to_pylist(), lines.column("line_text").to_pylist(), boq.column("boq_text").fill_null("").to_pylist()
        names, out, held = list(number), [], None
        for places_of, bounds_of in most_alike(texts, rows):
            for i, most in zip(places_of, bounds_of):
                if texts[i] != held:
                    held, known = texts[i], {}

                def like(r, text=held, known=known):
                    if (x := known.get(rows[r])) is None:
                        x = known[rows[r]] = measure(text, rows[r])
                    return x

                with np.errstate(invalid="ignore"):
                    same = (np.abs(asked[i] - prices) <= MONEY) & (asked[i] != 0)
                if found := _match(like, codes, first, number.get("" if items[i] is None else items[i], -2), most, same):
                    target, score = found
                    row_score = max(like(r) + (PRICE_ADDS if same[r] else 0.0) for r in np.flatnonzero(codes == target).tolist())
                    mine = [] if items[i] is None else [like(r) for r in np.flatnonzero(codes == number.get(items[i], -2)).tolist()]
                    out.append((i, names[target], score, row_score, max(mine, default=None)))
        kept = lines.take(pa.array([x[0] for x in out], pa.int64()))
        return pa.table([*(kept.column(x) for x in [*by, "item_code"]), *(pa.array([x[k] for x in out], schema.field(name).type) for k, name in enumerate(("target", "score", "row_score", "own"), 1))], schema=schema)

    return run


def matches(lines: DataFrame, boq: DataFrame) -> DataFrame:
    """(line, item_code, target, score, row_score, own): lines for which one code is decisively the best, its own not counted;
    own: how well the rows of its own code fit.

    Lines and rows are shuffled, pairs are not: a claim's lines are dealt into parts of about PART, each with a copy of the
    claim's rows, which must fit into a task.
    """
    by = line_key(lines)
    mine = lines.filter(~deduction() & F.col("claim_id").isNotNull())
    parts = mine.groupBy("claim_id").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    mine = mine.select(*by, "item_code", name_key(F.col("description")).alias("line_text"), F.col("unit_price").alias("line_price")).filter("line_text != ''")
    mine = mine.join(parts, "claim_id").withColumn("part", F.pmod(F.xxhash64(*by), F.col("parts")).cast("int")).drop("parts")
    ref = boq.select("claim_id", F.col("pos").alias("boq_pos"), F.col("item_code").alias("code"), name_key(F.col("description")).alias("boq_text"), F.col("unit_price").alias("boq_price"))
    # names of its own: lines and rows may be of one table
    ref = ref.join(parts, "claim_id").select(F.col("claim_id").alias("of_claim"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("of_part"), "boq_pos", "code", "boq_text", "boq_price")
    kind = T.StructType([*(lines.schema[x] for x in [*by, "item_code"]), T.StructField("target", boq.schema["item_code"].dataType), *(T.StructField(x, T.DoubleType()) for x in ("score", "row_score", "own"))])
    return mine.groupBy("claim_id", "part").cogroup(ref.groupBy("of_claim", "of_part")).applyInArrow(_matches(by, to_arrow_schema(kind)), kind)


def _own_rows(boq: DataFrame) -> DataFrame:
    """(claim_id, item_code, own_price, own_text): the last row of each code."""
    last = boq.groupBy("claim_id", "item_code").agg(F.max(F.struct("pos", "unit_price", "description")).alias("r"))
    return last.select("claim_id", "item_code", F.col("r.unit_price").alias("own_price"), F.col("r.description").alias("own_text"), F.lit(True).alias("in_boq"))


def align_codes(lines: DataFrame, boq: DataFrame) -> DataFrame:
    """(line, item_code, new_code) of the lines whose code should be another one of the bill.

    A line whose code is in the bill keeps it if it has no description or the same price, and moves only to a row that fits
    clearly better; any other line goes to the only row of its canonical code, else to its best match. A code that a line
    of the document has, or an earlier line takes, isn't given again. Only lines that may move are compared.
    """
    by = line_key(lines)
    own = lines.filter(~deduction()).join(_own_rows(boq), ["claim_id", "item_code"], "left").withColumn("in_boq", F.coalesce("in_boq", F.lit(False)))
    settled = F.col("in_boq") & ((F.trim(F.coalesce("description", F.lit(""))) == "") | same_price(F.col("unit_price"), F.col("own_price")))
    free = own.filter(~settled)
    best = matches(free.drop("own_price", "own_text", "in_boq"), boq).drop("item_code")
    canon = canonical_matches(free.filter("not in_boq"), boq).withColumnRenamed("target", "canon")
    ready = free.select(*by, "item_code", "in_boq").join(best, by, "left").join(canon, by, "left")
    target = F.when(F.col("in_boq"), F.when(F.col("row_score") >= F.col("own") + MOVE_LEAD, F.col("target"))).otherwise(F.coalesce("canon", "target"))
    moves = ready.select(*by, F.coalesce("item_code", F.lit("")).alias("item_code"), target.alias("new_code")).filter("new_code is not null and new_code != item_code")
    document = [x for x in by if x != "pos"]
    taken = lines.select(*document, F.col("item_code").alias("new_code")).distinct()
    order = Window.partitionBy(*document, "new_code").orderBy("pos")
    return moves.join(taken, [*document, "new_code"], "left_anti").withColumn("i", F.row_number().over(order)).filter("i = 1").select(*by, "item_code", "new_code")


def align_documents(invoices: DataFrame, receipts: DataFrame, boq: DataFrame) -> DataFrame:
    """(claim_id, doc, pos, item_code, new_code) for invoice lines and, by wording alone and with codes of its own taken, for
    receipt lines (claim_id, pos, item_code, description, quantity), which have no price."""
    names = ["claim_id", "pos", "item_code", "description", "unit_price", "quantity", "amount"]
    paid = invoices.select(F.lit("invoice").alias("doc"), *names)
    got = receipts.select(F.lit("receipt").alias("doc"), "claim_id", "pos", "item_code", "description", F.lit(0.0).alias("unit_price"), "quantity", F.lit(0.0).alias("amount"))
    return align_codes(paid.unionByName(got), boq)


def plausible(lines: DataFrame, boq: DataFrame) -> DataFrame:
    """lines that aren't deductions, with in_boq and plausible: whether the row of their own code has the same price or much
    the same wording, or nothing speaks against it. One comparison a line."""
    own = lines.filter(~deduction()).join(_own_rows(boq), ["claim_id", "item_code"], "left")
    text = name_key(F.col("description"))
    alike = similarity(text, name_key(F.col("own_text"))) >= PLAUSIBLE
    fits = (text == "") | same_price(F.col("unit_price"), F.col("own_price")) | alike
    return own.select(*lines.columns, F.col("in_boq").isNotNull().alias("in_boq"), (F.col("in_boq").isNotNull() & fits).alias("plausible"))


def needs(lines: DataFrame, boq: DataFrame, contracts: DataFrame) -> DataFrame:
    """(claim_id, codes, date) for each contract (claim_id, end_date, anchors: array of dates): whether codes of invoice lines
    must be looked at, and whether an end date that is a duration can be worked out from an anchor."""
    bad = plausible(lines, boq).groupBy("claim_id").agg(F.bool_or(~F.col("plausible")).alias("bad"))
    billed = boq.select("claim_id").distinct().withColumn("billed", F.lit(True))
    end = F.coalesce("end_date", F.lit(""))
    dated = F.exists(F.coalesce("anchors", F.array().cast("array<string>")), lambda a: F.coalesce(a, F.lit("")) != "")
    out = contracts.join(bad, "claim_id", "left").join(billed, "claim_id", "left")
    return out.select("claim_id", F.coalesce(F.col("bad") & F.col("billed"), F.lit(False)).alias("codes"), ((end != "") & ~end.rlike(ISO) & dated).alias("date"))


def apply_patch(lines: DataFrame, patch: DataFrame, boq: DataFrame) -> DataFrame:
    """lines with codes of patch (claim_id, pos, ord, new_code) where the bill and the lines have them, each code once, the first."""
    real = patch.join(boq.select("claim_id", F.col("item_code").alias("new_code")).distinct(), ["claim_id", "new_code"], "left_semi")
    real = real.join(lines.select("claim_id", "pos").distinct(), ["claim_id", "pos"], "left_semi")
    once = real.groupBy("claim_id", "new_code").agg(F.min(F.struct("ord", "pos")).alias("p")).select("claim_id", F.col("p.pos").alias("pos"), F.col("p.ord").alias("ord"), "new_code")
    last = once.groupBy("claim_id", "pos").agg(F.max(F.struct("ord", "new_code")).alias("p")).select("claim_id", "pos", F.col("p.new_code").alias("new_code"))
    return lines.join(last, ["claim_id", "pos"], "left").withColumn("item_code", F.coalesce("new_code", "item_code")).drop("new_code")


def patch_end_date(end_date: Column, new: Column) -> Column:
    """The new date, cut to its day, where the old one is no date; else the old one."""
    return F.when(F.coalesce(new, F.lit("")).rlike(ISO) & ~F.coalesce(end_date, F.lit("")).rlike(ISO), F.substring(new, 1, 10)).otherwise(end_date)
