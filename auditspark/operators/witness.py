"""Repair of misread digits by a document's own text layer: a value that the text doesn't have gives way to the only one
in the text that is a slip away, and, for amounts, that makes the sums right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import amount_forms, bind, contains_identifier, digit_runs, digits, near, restyle, usable, witness_text

# Shortest identifier, tolerance of printed totals, VAT rate.
LEAST_LENGTH, TOLERANCE, VAT = 5, 1.0, 0.15
TOKEN, AMOUNT = "[^0-9a-zء-ي/._-]+", r"(\d+(?:\.\d+)?)"


def near_identifiers(text: Column, value: Column) -> Column:
    """Tokens of the text a slip away from value; if there are none, digit runs a slip away from its digits."""
    tokens = F.array_distinct(F.transform(F.split(witness_text(text), TOKEN, -1), lambda t: F.regexp_replace(t, "^[._/-]+|[._/-]+$", "")))
    none = F.array().cast("array<string>")

    def found(r: Column) -> Column:
        by_token = F.filter(tokens, lambda t: near(t, r["v"]))
        by_digits = F.when(r["d"] == r["v"], F.filter(F.array_distinct(digit_runs(text)), lambda t: near(t, r["d"]))).otherwise(none)
        return F.when(F.length(r["v"]) >= LEAST_LENGTH, bind(lambda q: F.when(F.size(q["x"]) == 0, by_digits).otherwise(q["x"]), x=by_token)).otherwise(none)

    return bind(found, v=witness_text(value), d=digits(value))


def repair_identifier(text: Column, value: Column) -> Column:
    """value, or the only token that it can have been read from."""
    ask = usable(text) & (F.coalesce(value, F.lit("")) != "") & ~contains_identifier(text, value)
    alone = lambda r: F.when(F.size(r["x"]) == 1, restyle(value, F.try_element_at(r["x"], F.lit(1)))).otherwise(value)
    return F.when(ask, bind(alone, x=near_identifiers(text, value))).otherwise(value)


def amounts(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(witness_text(text), F.lit(AMOUNT), 1), lambda t: t.try_cast("double")))


def contains_amount(text: Column, value: Column) -> Column:
    return F.exists(amounts(text), lambda a: F.abs(a - value) < 0.005)


def _near_among(values: Column, value: Column) -> Column:
    forms = lambda v: F.transform(amount_forms(v), lambda f: digits(f))
    slip = lambda a, mine: F.exists(forms(a), lambda x: F.exists(mine, lambda y: near(x, y)))
    return bind(lambda r: F.array_sort(F.filter(values, lambda a: a.isNotNull() & slip(a, r["mine"]))), mine=forms(value))


def near_amounts(text: Column, value: Column) -> Column:
    """Amounts of the text one slip in the digits away from value, in order."""
    return _near_among(amounts(text), value)


def repair_amount(text: Column, value: Column, fits) -> Column:
    """value, or the only near amount of the text for which fits(amount) holds."""
    found = F.filter(near_amounts(text, value), fits)
    fix = usable(text) & ~contains_amount(text, value) & (F.size(found) == 1)
    return F.when(fix, F.try_element_at(found, F.lit(1))).otherwise(value)


# The numbers of a line, in the order in which they are looked for.
NUMBERS = ("amount", "unit_price", "quantity")


def line_repair(line: Column, among: Column) -> Column:
    """A line (a record with NUMBERS) where quantity times price isn't the amount and one of the three isn't among the amounts
    of the text: with the only near one that makes it right."""
    number = lambda n: F.coalesce(line[n], F.lit(0.0))

    def fits(n: str, v: Column) -> Column:
        amount, price, quantity = (v if x == n else number(x) for x in NUMBERS)
        return (amount > 0) & (F.abs(quantity * price - amount) <= F.greatest(F.lit(TOLERANCE), 0.001 * amount))

    wrong = ~fits("amount", number("amount"))
    absent = {n: (number(n) > 0) & ~F.exists(among, lambda a: F.abs(a - number(n)) < 0.005) for n in NUMBERS}  # noqa: B023
    one = sum((F.when(x, 1).otherwise(0) for x in absent.values()), F.lit(0)) == 1
    fixed = line
    for n in NUMBERS:
        near_ones = F.when(wrong & one & absent[n], F.filter(_near_among(among, number(n)), _trial(fits, n)))
        fixed = fixed.withField(n, bind(_only(line[n]), x=near_ones))
    return F.when(line.isNotNull(), fixed)


def _trial(fits, name: str):
    return lambda v: fits(name, v)


def _only(value: Column):
    return lambda r: F.when(F.size(r["x"]) == 1, F.get(r["x"], F.lit(0))).otherwise(value)


def repair_lines(lines: DataFrame, text: str = "page_text") -> DataFrame:
    """Lines (with NUMBERS) put right by their text; unusable texts change nothing."""
    fixed = bind(lambda r: line_repair(r["l"], r["among"]), l=F.struct(*NUMBERS), among=amounts(F.col(text)))
    return lines.withColumn("fixed", F.when(usable(F.col(text)), fixed).otherwise(F.struct(*NUMBERS))).drop(*NUMBERS).select("*", *[F.col(f"fixed.{n}") for n in NUMBERS]).drop("fixed")


def repair_contract(text: Column, base: Column, total: Column) -> tuple[Column, Column]:
    """(base, total): a value that the text doesn't have, the total first, gives way to the only near one that goes with the
    other: equal to it, or apart by VAT. Equal values are repaired together. Of one printed figure in both places the base
    follows."""
    tolerance = lambda other: F.greatest(F.lit(TOLERANCE), 0.001 * other)
    close = lambda a, b, other: F.abs(a - b) <= tolerance(other)
    goes = lambda v, other: (other <= 0) | close(v, other, other) | close(v, other * (1 + VAT), other) | close(other, v * (1 + VAT), other)
    only = lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0)))
    among = amounts(text)

    def fix(value: Column, other: Column) -> Column:
        asked = usable(text) & (value > 0) & ~contains_amount(text, value)
        found = F.when(asked, _near_among(among, value))
        return F.coalesce(only(F.filter(found, lambda v: goes(v, other))), F.when(value == other, only(found)))

    def both(r: Column) -> Column:
        return bind(lambda q: F.struct(F.when(base != total, fix(base, F.coalesce(q["new"], total))).alias("base"), q["new"].alias("total")), new=r["new"])

    new = bind(both, new=fix(total, base))
    new_base, new_total = F.coalesce(new["base"], base), F.coalesce(new["total"], total)
    one_figure = (F.abs(new_base - new_total) < 1.0) | (base == total)
    changed = new["base"].isNotNull() | new["total"].isNotNull() | (base == total)
    return F.when(changed & one_figure & (new_total > 0) & (base > 0), F.round(new_total / (1 + VAT), 2)).otherwise(new_base), new_total


def invoice_consistent(lines_total: Column, total: Column, vat: Column) -> Column:
    """Lines add up to the net amount, and VAT is its share of it; null if there is nothing to compare."""
    from .merge import consistent

    net = total - vat
    by_lines = F.when((lines_total > 0) & (net > 0), F.abs(lines_total - net) <= TOLERANCE)
    by_vat = F.when((vat > 0) & (net > 0), F.abs(vat - VAT * net) <= F.greatest(F.lit(TOLERANCE), 0.001 * net))
    return consistent(by_lines, by_vat)


# Identifiers and amounts that the text may correct, by document.
IDENTIFIERS = {"invoice": ["invoice_no", "seller_vat_number"], "coc": ["coc_no", "invoice_ref", "contract_no", "award_letter_no"], "receipt": ["receipt_no"], "contract": ["contract_no"]}
AMOUNTS = {"invoice": ["total_with_vat", "vat_amount"], "coc": ["claim_amount", "claim_net", "vat_amount"]}


def coc_consistent(amount: Column, net: Column, vat: Column) -> Column:
    """Net and VAT add up, and VAT is its share; null if the parts aren't printed."""
    from .merge import consistent

    by_sum = F.when((net > 0) & (vat > 0) & (amount > 0), F.abs(net + vat - amount) <= TOLERANCE)
    by_vat = F.when((net > 0) & (vat > 0), F.abs(vat - VAT * net) <= F.greatest(F.lit(TOLERANCE), 0.001 * net))
    return consistent(by_sum, by_vat)


def _first_repair(values: list[Column], text: Column, check) -> Column:
    """The array of values, with the first that a single near amount puts right in its place, if check fails as they are."""
    n = len(values)

    def fix(r: Column, i: int) -> Column:
        fits = lambda x: F.coalesce(check(*[x if j == i else r["v"][j] for j in range(n)]), F.lit(False))
        absent = ~F.exists(r["among"], lambda a: F.abs(a - r["v"][i]) < 0.005)
        return bind(lambda q: F.when(absent & (F.size(q["x"]) == 1), F.try_element_at(q["x"], F.lit(1))), x=F.filter(_near_among(r["among"], r["v"][i]), fits))

    def put(r: Column) -> Column:
        at = F.array_position(F.transform(r["fixes"], lambda x: x.isNotNull()), True)
        return F.transform(r["v"], lambda x, i: F.when(i + 1 == at, F.get(r["fixes"], i)).otherwise(x))

    def repaired(r: Column) -> Column:
        wrong = ~F.coalesce(check(*[r["v"][j] for j in range(n)]), F.lit(True))
        return F.when(wrong, bind(put, v=r["v"], fixes=F.array(*[fix(r, i) for i in range(n)]))).otherwise(r["v"])

    return bind(repaired, v=F.array(*[F.coalesce(x, F.lit(0.0)) for x in values]), among=amounts(text))


def _repaired(name: str, section: Column, text: Column) -> Column:
    """A document of the claim with what the text corrects; all from its values as read."""
    out = section
    for field in IDENTIFIERS[name]:
        out = out.withField(field, repair_identifier(text, section[field]))
    if name == "contract":
        value = lambda field: F.coalesce(section[field], F.lit(0.0))
        base, total = repair_contract(text, value("value_base"), value("value_with_vat"))
        return out.withField("value_base", base).withField("value_with_vat", total)
    if name not in AMOUNTS:
        return out
    check = coc_consistent
    if name == "invoice":
        # lines first: the header is checked against their sum
        out = out.withField("lines", bind(lambda r: F.transform(section["lines"], lambda x: line_repair(x, r["among"])), among=amounts(text)))
        section = out
        lines_total = F.aggregate(F.coalesce(section["lines"], F.array()), F.lit(0.0), lambda acc, x: acc + F.coalesce(x["amount"], F.lit(0.0)))
        check = lambda total, vat: invoice_consistent(lines_total, total, vat)
    new = _first_repair([section[field] for field in AMOUNTS[name]], text, check)
    place = lambda r: _with_fields(r["s"], {field: r["new"][i] for i, field in enumerate(AMOUNTS[name])})
    return bind(place, s=out, new=new)


def _with_fields(record: Column, values: dict[str, Column]) -> Column:
    for field, value in values.items():
        record = record.withField(field, value)
    return record


def reconcile(claims: DataFrame, text: str = "page_text") -> DataFrame:
    """Nested claims with identifiers and amounts of their documents corrected by the text; unusable texts change nothing.

    One projection: what an expression needs more than once is bound, so that the plan grows with the fields.
    """

    def documents(r: Column) -> Column:
        fixed = {name: F.when(r["d"][name].isNotNull(), _repaired(name, r["d"][name], r["t"])) for name in IDENTIFIERS}
        return F.when(usable(r["t"]), _with_fields(r["d"], fixed)).otherwise(r["d"])

    return claims.withColumn("documents", bind(documents, d=F.col("documents"), t=F.col(text)))
