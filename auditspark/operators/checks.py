"""Checks of one claim, as Spark columns over the nested claim.

A check is a function of its rule's parameters that returns a struct: ok (true, false, or null where it doesn't apply),
override (a severity that replaces the rule's when ok is false) and evidence (JSON). All checks of a claim are evaluated in
one projection; nothing is shuffled. Lines of a claim are arrays, looked up by code where the last row of a code counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import codes, text
from ..functions.dates import LEAST_YEAR, parse_date, swap_day_month

# Tolerances, VAT, and attachments whose validity counts.
MONEY, QUANTITY, CONTRACT_VALUE = 0.01, 1e-6, 1.0
VAT = 0.15
DATED = ["commercial registration", "zakat certificate", "gosi certificate"]

CHECKS: dict[str, Callable[[dict], Column]] = {}


def check(name: str):
    """Register a check, so that rules can name it."""

    def add(f):
        CHECKS[name] = f
        return f

    return add


def outcome(ok: Column, override: Column | str | None = None, **evidence: Column) -> Column:
    override = F.lit(override) if override is None or isinstance(override, str) else override
    facts = F.to_json(F.struct(*[v.alias(k) for k, v in evidence.items()]), {"ignoreNullFields": "false"}) if evidence else F.lit("{}")
    return F.struct(ok.cast("boolean").alias("ok"), override.cast("string").alias("override"), facts.alias("evidence"))


def c(name: str) -> Column:
    return F.col(name)


def doc(name: str) -> Column:
    return F.col(f"documents.{name}")


INVOICE, COC, RECEIPT, CONTRACT = (f"documents.{x}" for x in ("invoice", "coc", "receipt", "contract"))


def field(section: str, name: str) -> Column:
    return F.col(f"{section}.{name}")


def there(section: str) -> Column:
    return F.col(section).isNotNull()


def number(v: Column) -> Column:
    return F.coalesce(v, F.lit(0.0))


def string(v: Column) -> Column:
    return F.coalesce(v, F.lit(""))


def empty(kind: str) -> Column:
    """A constant empty array."""
    return F.array().cast(f"array<{kind}>")


def lines() -> Column:
    return F.coalesce(field(INVOICE, "lines"), empty("struct<item_code: string, description_ar: string, unit_price: double, quantity: double, amount: double, page: int, source_file: string>"))


def boq() -> Column:
    return F.coalesce(doc("boq"), empty("struct<item_code: string, description_ar: string, description_en: string, unit: string, unit_price: double, quantity: double, page: int, source_file: string>"))


def received() -> Column:
    return F.coalesce(field(RECEIPT, "lines"), empty("struct<item_code: string, description_ar: string, quantity: double, page: int, source_file: string>"))


def detected() -> Column:
    return F.coalesce(doc("detected"), empty("struct<file_name: string, doc_key: string, fields: map<string, string>, page: int>"))


def last(found: Column) -> Column:
    """The last element, or null."""
    return F.when(F.size(found) > 0, F.element_at(found, F.greatest(F.size(found), F.lit(1))))


def by_code(of: Column, code: Column) -> Column:
    return last(F.filter(of, lambda b: b["item_code"] == code))


def deduction(line: Column) -> Column:
    return (number(line["quantity"]) < 0) | (number(line["amount"]) < 0)


def off(a: Column, b: Column, most: float = MONEY) -> Column:
    return F.abs(number(a) - number(b)) > most


def penalties() -> Column:
    return c("_penalties")


def _penalties() -> Column:
    """In the order of the list, so that the sum doesn't depend on how rows are spread."""
    return F.coalesce(F.aggregate(doc("penalties"), F.lit(0.0), lambda acc, p: acc + number(p["amount"])), F.lit(0.0))


def problems(*each: tuple[Column, str]) -> Column:
    """Names of those conditions that hold."""
    return F.array_compact(F.array(*[F.when(bad, name) for bad, name in each]))


# -- intake ---------------------------------------------------------------------------------------------------------------


@check("metadata_complete")
def metadata_complete(params: dict) -> Column:
    numeric = {"payment_no", "prior_payment_count", "contract_value", "claim_amount_base", "vat_amount", "claim_amount_total"}
    missing = problems(*[((number(c(f)) == 0) if f in numeric else (string(c(f)) == ""), f) for f in params.get("fields", [])])
    return outcome(F.size(missing) == 0, missing=missing)


@check("invoice_no_matches")
def invoice_no_matches(params: dict) -> Column:
    on_invoice = string(field(INVOICE, "invoice_no"))
    same = string(c("invoice_no")).isin(*text.bidi_forms(on_invoice))
    return outcome(there(INVOICE) & same, claim=c("invoice_no"), invoice=field(INVOICE, "invoice_no"))


@check("vat_math")
def vat_math(params: dict) -> Column:
    total = number(c("claim_amount_base")) + number(c("vat_amount"))
    return outcome(~off(total, c("claim_amount_total")), expected=F.round(total, 2), claimed=c("claim_amount_total"))


@check("qr_present")
def qr_present(params: dict) -> Column:
    has = there(INVOICE) & (string(field(INVOICE, "qr_payload")) != "")
    return outcome(F.when(F.coalesce(field(INVOICE, "vat_exempt"), F.lit(False)), None).otherwise(has))


def _coded_amount(name: str) -> Column:
    return F.try_element_at(c("_qr.fields"), F.lit(name)).try_cast("double")


@check("qr_authentic")
def qr_authentic(params: dict) -> Column:
    vat = string(F.try_element_at(c("_qr.fields"), F.lit("vat_number")))
    face = string(field(INVOICE, "seller_vat_number"))
    agrees = lambda name, value: F.coalesce(F.abs(_coded_amount(name) - number(value)) <= MONEY, F.lit(False))
    bad = problems(
        (~text.vat_number_ok(vat), "vat_format"),
        ((face != "") & (vat != face), "vat_number"),
        (~agrees("total", field(INVOICE, "total_with_vat")), "total"),
        (~agrees("vat", field(INVOICE, "vat_amount")), "vat_amount"),
    )
    ok = F.when(string(field(INVOICE, "qr_payload")) == "", None).when(~c("_qr.valid"), False).otherwise(F.size(bad) == 0)
    return outcome(ok, error=c("_qr.error"), problems=bad)


@check("qr_phase2")
def qr_phase2(params: dict) -> Column:
    status = c("_qr_status")
    ok = F.when(string(field(INVOICE, "qr_payload")) == "", None).otherwise(status == "valid")
    return outcome(ok, F.when(status == "invalid_signature", "fail").otherwise("warn"), status=status)


# -- contract and payments ------------------------------------------------------------------------------------------------


@check("boq_lines_match")
def boq_lines_match(params: dict) -> Column:
    bad, mine = c("_line_issues"), c("_lines")
    return outcome(F.when(F.size(mine) > 0, F.size(bad) == 0), mismatches=bad, deductions=F.size(F.filter(mine, lambda x: x["deduction"])))


def _disbursed() -> Column:
    return F.round(number(c("cumulative_prior")) + number(c("claim_amount_base")), 2)


@check("cumulative_within_contract")
def cumulative_within_contract(params: dict) -> Column:
    value = number(c("contract_value"))
    ok = F.when(value <= 0, False).otherwise(_disbursed() <= value + MONEY)
    return outcome(ok, F.when(value <= 0, "warn"), cumulative=_disbursed(), contract_value=value, remaining=value - number(c("cumulative_prior")))


@check("payment_not_already_disbursed")
def payment_not_already_disbursed(params: dict) -> Column:
    no, prior = F.coalesce(c("payment_no"), F.lit(0)), F.coalesce(c("prior_payment_count"), F.lit(0))
    return outcome(F.when(no < 1, None).otherwise(no > prior), payment_no=no, prior=prior)


@check("payment_sequence")
def payment_sequence(params: dict) -> Column:
    no, prior = F.coalesce(c("payment_no"), F.lit(0)), F.coalesce(c("prior_payment_count"), F.lit(0))
    return outcome(F.when((no >= 1) & (no <= prior), None).otherwise(no == prior + 1), expected=prior + 1, got=no)


@check("claim_type_consistent")
def claim_type_consistent(params: dict) -> Column:
    value, left = number(c("contract_value")), number(c("contract_value")) - _disbursed()
    kind, prior = c("claim_type"), F.coalesce(c("prior_payment_count"), F.lit(0))
    closes = (kind != "final") & (value > 0) & (F.abs(left) <= MONEY)
    ok = (
        F.when((kind == "final") & (value <= 0), None)
        .when((kind == "final") & (left > MONEY), False)
        .when(kind == "final", True)
        .when((kind == "first") & (prior > 0), False)
        .when(closes, False)
        .otherwise(True)
    )
    return outcome(ok, F.when(closes & ~((kind == "first") & (prior > 0)), "warn"), claim_type=kind, remaining=left, prior=prior)


@check("final_claim_closes_contract")
def final_claim_closes_contract(params: dict) -> Column:
    value, left = number(c("contract_value")), number(c("contract_value")) - _disbursed()
    ok = F.when(c("claim_type") != "final", None).when(value <= 0, False).when(left < -MONEY, None).otherwise(F.abs(left) <= MONEY)
    return outcome(ok, F.when(value <= 0, "warn"), difference=left)


# -- acceptance -----------------------------------------------------------------------------------------------------------


def _goods() -> Column:
    return c("contract_kind") == "goods"


@check("acceptance_present")
def acceptance_present(params: dict) -> Column:
    return outcome(F.when(_goods(), there(RECEIPT)).otherwise(there(COC)), kind=c("contract_kind"))


@check("coc_amount_matches_claim")
def coc_amount_matches_claim(params: dict) -> Column:
    ok = F.when(there(COC), ~off(field(COC, "claim_amount"), c("claim_amount_total")))
    return outcome(ok, coc=field(COC, "claim_amount"), claim=c("claim_amount_total"))


@check("coc_invoice_ref_matches")
def coc_invoice_ref_matches(params: dict) -> Column:
    ref = string(field(COC, "invoice_ref"))
    expected = F.coalesce(F.nullif(string(field(INVOICE, "invoice_no")), F.lit("")), string(c("invoice_no")))
    same = text.ident_key(ref).isin(*map(text.ident_key, text.bidi_forms(expected)))
    return outcome(F.when(there(COC) & (ref != "") & (expected != ""), same), coc=ref, expected=expected)


@check("coc_amounts_match_invoice")
def coc_amounts_match_invoice(params: dict) -> Column:
    net, vat = number(field(COC, "claim_net")), number(field(COC, "vat_amount"))
    face_vat = number(field(INVOICE, "vat_amount"))
    bad = problems(
        ((net > 0) & off(net, number(field(INVOICE, "total_with_vat")) - face_vat), "net"),
        ((vat > 0) & off(vat, face_vat), "vat"),
        ((net > 0) & (vat > 0) & off(net + vat, field(INVOICE, "total_with_vat")), "total"),
    )
    return outcome(F.when(there(COC) & there(INVOICE) & ((net > 0) | (vat > 0)), F.size(bad) == 0), problems=bad)


@check("coc_payment_matches_claim")
def coc_payment_matches_claim(params: dict) -> Column:
    no, mine, kind = F.coalesce(field(COC, "payment_no"), F.lit(0)), F.coalesce(c("payment_no"), F.lit(0)), string(field(COC, "claim_type"))
    both = (no >= 1) & (mine >= 1)
    bad = problems((both & (no != mine), "payment_no"), ((kind != "") & (kind != c("claim_type")), "claim_type"))
    return outcome(F.when(there(COC) & (both | (kind != "")), F.size(bad) == 0), problems=bad)


@check("coc_contract_value_matches")
def coc_contract_value_matches(params: dict) -> Column:
    own, printed = number(c("contract_value")), number(field(CONTRACT, "value_with_vat"))
    expected = F.when(printed > 0, printed).when(own > 0, F.round(own * (1 + VAT), 2))
    coc = number(field(COC, "contract_value_with_vat"))
    return outcome(F.when(there(COC) & (coc > 0) & expected.isNotNull(), ~off(coc, expected, CONTRACT_VALUE)), coc=coc, expected=expected)


@check("coc_award_letter_matches")
def coc_award_letter_matches(params: dict) -> Column:
    letters = F.filter(detected(), lambda d: d["doc_key"] == "award letter")
    ref = string(F.when(F.size(letters) > 0, F.try_element_at(F.element_at(letters, 1)["fields"], F.lit("reference_no"))))
    coc = string(field(COC, "award_letter_no"))
    return outcome(F.when((text.ident_key(ref) != "") & (text.ident_key(coc) != ""), text.ident_key(ref) == text.ident_key(coc)), coc=coc, letter=ref)


@check("billed_vs_received")
def billed_vs_received(params: dict) -> Column:
    over = c("_over")
    return outcome(F.when(there(INVOICE) & there(RECEIPT), F.size(over) == 0), over=over)


@check("received_within_boq")
def received_within_boq(params: dict) -> Column:
    bad = c("_received_issues")
    return outcome(F.when(there(RECEIPT) & (F.size(boq()) > 0), F.size(bad) == 0), issues=bad)


@check("claimed_within_certified_value")
def claimed_within_certified_value(params: dict) -> Column:
    certified = F.round(F.aggregate(c("_received"), F.lit(0.0), lambda acc, x: acc + number(x["quantity"]) * number(x["boq_price"])), 2)
    ok = F.when(there(RECEIPT) & (F.size(boq()) > 0), number(c("claim_amount_base")) <= certified + MONEY)
    return outcome(ok, certified=certified, claimed=c("claim_amount_base"))


# -- delay and penalties --------------------------------------------------------------------------------------------------


def _contract_end() -> Column:
    return c("_contract_end")


def _coc_end() -> Column:
    return c("_coc_end")


def _month_first() -> Column:
    """The certificate prints the contract's end with day and month exchanged."""
    return c("_month_first")


def _end() -> Column:
    return F.coalesce(_contract_end(), _coc_end())


def _done() -> Column:
    """The day of the receipt of goods, or of the certificate of works."""
    return c("_done")


def _late() -> Column:
    """Days from the contract's end to completion."""
    return c("_late")


@check("coc_contract_end_matches")
def coc_contract_end_matches(params: dict) -> Column:
    days = F.abs(F.datediff(_coc_end(), _contract_end()))
    ok = F.when(_coc_end().isNotNull() & _contract_end().isNotNull(), _month_first() | (days <= params.get("tolerance_days", 0)))
    return outcome(ok, days=days, date_order=F.when(_month_first(), "month-first"))


def _none_declared() -> Column:
    false = lambda name: field(COC, name).eqNullSafe(F.lit(False))
    return there(COC) & false("has_delay") & false("has_stoppage") & false("has_observations")


@check("coc_delay_vs_penalties")
def coc_delay_vs_penalties(params: dict) -> Column:
    return outcome(F.when(there(COC), ~((penalties() > 0) & _none_declared())), penalties=penalties())


@check("delay_from_dates")
def delay_from_dates(params: dict) -> Column:
    delay, none = _late(), penalties() <= 0
    denied = ~_goods() & field(COC, "has_delay").eqNullSafe(F.lit(False)) & there(COC)
    ok = F.when(delay.isNull(), None).when(delay <= 0, True).when(denied, False).when(none, False).otherwise(True)
    return outcome(ok, F.when(~denied & none, "warn"), delay_days=F.greatest(delay, F.lit(0)), penalties=F.round(penalties(), 2), contract_end=_end(), completion=_done())


def _term() -> tuple[Column, Column]:
    """The clause that says most, the first of equals, and the highest ceiling."""
    of_delay = F.filter(field(CONTRACT, "penalty_terms"), lambda t: (t["kind"] == "delay") & ((number(t["rate_percent"]) > 0) | (number(t["cap_percent"]) > 0)))
    whole = lambda t: (string(t["basis"]) == "") | F.contains(t["basis"], F.lit("عقد")) | F.contains(F.lower(t["basis"]), F.lit("contract"))
    key = lambda t: F.struct((string(t["per"]) != "") & whole(t), number(t["cap_percent"]) > 0, number(t["rate_percent"]))
    best = F.aggregate(F.slice(of_delay, 2, 10_000), F.try_element_at(of_delay, F.lit(1)), lambda acc, t: F.when(key(t) > key(acc), t).otherwise(acc))
    return F.when(F.size(of_delay) > 0, best), F.aggregate(of_delay, F.lit(0.0), lambda acc, t: F.greatest(acc, number(t["cap_percent"])))


@check("penalties_vs_contract_terms")
def penalties_vs_contract_terms(params: dict) -> Column:
    term, cap = c("_term"), c("_cap")
    basis = F.when(number(c("contract_value")) != 0, c("contract_value")).otherwise(number(field(CONTRACT, "value_base")))
    whole = (string(term["basis"]) == "") | F.contains(term["basis"], F.lit("عقد")) | F.contains(F.lower(term["basis"]), F.lit("contract"))
    total, delay = F.round(penalties(), 2), F.greatest(_late(), F.lit(0))
    most = F.round(cap / 100 * basis, 2)
    units = F.when(term["per"] == "day", delay).when(term["per"] == "week", F.ceil(delay / 7)).otherwise(0)
    expected = F.when(whole & (units > 0), F.round(F.least(number(term["rate_percent"]) / 100 * units * basis, F.when(most > 0, most)), 2)).otherwise(0.0)
    over, less = (most > 0) & (total > most + MONEY), (expected > 0) & (total < expected - MONEY)
    ok = F.when(term.isNull(), None).when(over, False).when(_late().isNull(), None).when(delay == 0, True).when(total <= 0, False).when(less, False).otherwise(True)
    warn = F.when(~over & (total > 0) & less, "warn")
    return outcome(ok, warn, penalties=total, cap_amount=F.when(over, most), delay_days=delay, expected_penalty=F.when(expected > 0, expected), clause=term["ref"])


# -- the vendor's file ----------------------------------------------------------------------------------------------------


@check("attachments_complete")
def attachments_complete(params: dict) -> Column:
    have = F.transform(F.coalesce(doc("attachments"), F.array().cast("array<string>")), lambda a: F.lower(F.trim(a)))
    missing = F.array_except(F.array(*[F.lit(x.strip().lower()) for x in params.get("required", [])]), have)
    return outcome(F.size(missing) == 0, missing=missing)


@check("vat_treatment_declared")
def vat_treatment_declared(params: dict) -> Column:
    return outcome(F.when(there(INVOICE), F.coalesce(field(INVOICE, "vat_exempt"), F.lit(False)) | (number(field(INVOICE, "vat_amount")) > 0)))


def _printed(name: str) -> Column:
    """Values of a field over all detected attachments that print it."""
    return c(f"_printed_{name}")


def _printed_of(name: str) -> Column:
    return F.filter(F.transform(detected(), lambda d: string(F.try_element_at(d["fields"], F.lit(name)))), lambda v: v != "")


@check("attachment_identity_consistent")
def attachment_identity_consistent(params: dict) -> Column:
    compared, differ = [], []
    for name in ("cr_number", "vat_number"):
        values = _printed(name)
        compared.append(F.size(values) >= 2)
        differ.append((F.size(values) >= 2) & (F.size(F.array_distinct(c(f"_keys_{name}"))) > 1))
    return outcome(F.when(compared[0] | compared[1], ~(differ[0] | differ[1])), cr=_printed("cr_number"), vat=_printed("vat_number"))


@check("attachment_vat_matches_invoice")
def attachment_vat_matches_invoice(params: dict) -> Column:
    own, values = string(field(INVOICE, "seller_vat_number")), _printed("vat_number")
    same = F.size(F.array_except(c("_keys_vat_number"), F.array(text.ident_key(own)))) == 0
    return outcome(F.when((own != "") & (F.size(values) > 0), same), invoice=own, attachments=values)


@check("attachment_vendor_name_consistent")
def attachment_vendor_name_consistent(params: dict) -> Column:
    keys = F.filter(c("_name_keys"), lambda k: k != "")
    base = F.try_element_at(keys, F.lit(1))
    agrees = lambda k: (k == base) | F.contains(base, k) | F.contains(k, base)
    return outcome(F.when(F.size(keys) >= 2, F.forall(keys, agrees)), names=keys)


@check("attachment_id_formats")
def attachment_id_formats(params: dict) -> Column:
    cr, vat = F.transform(_printed("cr_number"), text.digits), F.transform(_printed("vat_number"), text.digits)
    bad = F.concat(F.filter(cr, lambda v: F.length(v) != 10), F.filter(vat, lambda v: ~text.vat_number_ok(v)))
    return outcome(F.when(F.size(cr) + F.size(vat) > 0, F.size(bad) == 0), malformed=bad)


@check("attachment_certificates_valid")
def attachment_certificates_valid(params: dict) -> Column:
    as_of = F.coalesce(c("_claim_date"), F.lit(params["as_of"]).cast("date") if params.get("as_of") else F.current_date())
    ends = c("_ends")
    expired = F.filter(ends, lambda e: e["expiry"] < as_of)
    return outcome(F.when((F.size(ends) > 0) & (F.year(as_of) >= LEAST_YEAR), F.size(expired) == 0), expired=expired)


def _ends() -> Column:
    """Attachments whose validity counts, with the day of its end."""
    of = F.filter(detected(), lambda d: d["doc_key"].isin(DATED))
    ends = F.transform(of, lambda d: F.struct(d["doc_key"].alias("doc_key"), parse_date(F.try_element_at(d["fields"], F.lit("expiry_date"))).alias("expiry")))
    return F.filter(ends, lambda e: e["expiry"].isNotNull() & (F.year(e["expiry"]) >= LEAST_YEAR))


def _referenced(found: Column, *names: str) -> list[Column]:
    """Fields of a looked-up row, and whether there is one."""
    return [found.isNotNull().alias("in_boq"), *[found[n].alias(f"boq_{'price' if n == 'unit_price' else n}") for n in names]]


def with_lookups(claims):
    """claims with what several checks use, once: dates, and lines beside the rows that their codes name."""
    claims = claims.withColumns({
        "_contract_end": F.coalesce(parse_date(c("contract_end_date")), parse_date(field(CONTRACT, "end_date"))),
        "_coc_end": parse_date(field(COC, "contract_end_date")), "_coc_date": parse_date(field(COC, "coc_date")), "_receipt_date": parse_date(field(RECEIPT, "receipt_date")),
        "_boq_of": F.transform(lines(), lambda x: by_code(boq(), x["item_code"])), "_got_of": F.transform(lines(), lambda x: by_code(received(), x["item_code"])),
        "_boq_of_received": F.transform(received(), lambda x: by_code(boq(), x["item_code"])),
    })
    claims = claims.withColumns({
        "_penalties": _penalties(), "_ends": _ends(), **{f"_printed_{x}": _printed_of(x) for x in ("cr_number", "vat_number")}, "_claim_date": parse_date(c("claim_date")),
        "_month_first": F.coalesce((c("_coc_end") != c("_contract_end")) & (swap_day_month(c("_coc_end")) == c("_contract_end")), F.lit(False)),
        "_lines": F.transform(F.arrays_zip(lines().alias("line"), c("_boq_of").alias("ref"), c("_got_of").alias("got")), lambda z: F.struct(
            z["line"]["item_code"].alias("item_code"), z["line"]["unit_price"].alias("unit_price"), number(z["line"]["quantity"]).alias("quantity"), deduction(z["line"]).alias("deduction"),
            *_referenced(z["ref"], "unit_price", "quantity"), number(z["got"]["quantity"]).alias("received"))),
        "_received": F.transform(F.arrays_zip(received().alias("line"), c("_boq_of_received").alias("ref")), lambda z: F.struct(z["line"]["item_code"].alias("item_code"), number(z["line"]["quantity"]).alias("quantity"), *_referenced(z["ref"], "unit_price", "quantity"))),
    })
    turned = F.when(_month_first(), F.coalesce(swap_day_month(c("_coc_date")), c("_coc_date"))).otherwise(c("_coc_date"))
    claims = claims.withColumns({"_done": F.when(_goods(), c("_receipt_date")).otherwise(turned), "_term": _term()[0], "_cap": _term()[1]})
    claims = claims.withColumn("_late", F.datediff(_done(), _end()))
    price_off = lambda x: off(x["boq_price"], x["unit_price"])
    too_much = lambda x: x["quantity"] > number(x["boq_quantity"]) + QUANTITY
    return claims.withColumns({
        **{f"_keys_{x}": F.transform(f"_printed_{x}", text.ident_key) for x in ("cr_number", "vat_number")},
        "_line_issues": F.transform(F.filter(c("_lines"), lambda x: ~x["deduction"] & (~x["in_boq"] | price_off(x))), lambda x: F.struct(x["item_code"].alias("item_code"), F.when(~x["in_boq"], "not in BoQ").otherwise("unit price").alias("issue"), x["unit_price"].alias("invoice"), x["boq_price"].alias("boq"))),
        "_over": F.transform(F.filter(c("_lines"), lambda x: x["quantity"] > x["received"] + QUANTITY), lambda x: F.struct(x["item_code"].alias("item_code"), x["quantity"].alias("billed"), x["received"].alias("received"), x["boq_quantity"].alias("boq"))),
        "_received_issues": F.transform(F.filter(c("_received"), lambda x: ~x["in_boq"] | too_much(x)), lambda x: F.struct(x["item_code"].alias("item_code"), F.when(~x["in_boq"], "not in BoQ").otherwise("quantity").alias("issue"), x["quantity"].alias("received"), x["boq_quantity"].alias("boq"))),
    })


def with_decoded(claims):
    """claims with what needs Arrow functions: the decoded code, its status, and folded vendor names in order."""
    claims = claims.withColumn("_qr", codes.tlv(field(INVOICE, "qr_payload")))
    claims = claims.withColumn("_qr_status", codes.phase2(c("_qr.tags")))
    names = F.concat(F.array(string(c("vendor_name_ar")), string(field(INVOICE, "seller_name_ar"))), F.transform(detected(), lambda d: string(F.try_element_at(d["fields"], F.lit("vendor_name_ar")))))
    joined = text.name_key(F.array_join(F.transform(names, lambda n: F.regexp_replace(n, "[\r\n]", " ")), " xqsepqx "))
    claims = with_lookups(claims)
    return claims.withColumn("_name_keys", F.transform(F.split(joined, " ?xqsepqx ?", -1), lambda k: F.trim(k)))
