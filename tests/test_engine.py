"""Rules over whole claims: a good claim, and what each change does to it."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from auditspark.functions import codes
from auditspark.operators import engine
from auditspark.operators.rules import REQUIRED_ATTACHMENTS
from auditspark.schema import CLAIM
from auditspark.sources import claims as source

VAT_NO = "310122393500003"


def base():
    line = lambda code, price, n: {"item_code": code, "description_ar": "", "unit_price": price, "quantity": n, "amount": price * n, "page": 1, "source_file": ""}
    boq = lambda code, price, n: {"item_code": code, "description_ar": "", "description_en": "", "unit": "", "unit_price": price, "quantity": n, "page": 1, "source_file": ""}
    payload = codes.encode({1: "Vendor", 2: VAT_NO, 3: "2026-01-05", 4: "1150.00", 5: "150.00"})
    return {
        "id": "A", "contract_value": 10000.0, "claim_amount_base": 1000.0, "vat_amount": 150.0, "claim_amount_total": 1150.0, "cumulative_prior": 2000.0,
        "contract_kind": "works", "contract_end_date": "2026-03-31", "claim_date": "2026-01-06", "invoice_no": "INV-2026-00070", "payment_no": 3, "prior_payment_count": 2, "claim_type": "periodic",
        "vendor_name_ar": "Vendor", "origin": "erp", "source_files": [],
        "documents": {
            "invoice": {"invoice_no": "INV-2026-00070", "invoice_date": "2026-01-05", "seller_name_ar": "VENDOR.", "seller_vat_number": VAT_NO, "total_with_vat": 1150.0, "vat_amount": 150.0, "vat_exempt": False, "qr_payload": payload, "lines": [line("1", 100.0, 10.0)], "page": 1, "source_file": ""},
            "boq": [boq("1", 100.0, 50.0), boq("2", 10.0, 5.0)],
            "coc": {"coc_no": "C", "coc_date": "2026-01-05", "claim_amount": 1150.0, "claim_net": 1000.0, "vat_amount": 150.0, "invoice_ref": "inv/2026/00070", "payment_no": 3, "claim_type": "periodic", "contract_end_date": "2026-03-31", "contract_value_with_vat": 11500.0, "has_delay": False, "has_stoppage": False, "has_observations": False},
            "receipt": {"receipt_no": "R", "receipt_date": "2026-01-04", "lines": [{"item_code": "1", "description_ar": "", "quantity": 10.0, "page": 1, "source_file": ""}]},
            "contract": {"contract_no": "K", "end_date": "", "value_base": 10000.0, "value_with_vat": 0.0, "penalty_terms": []},
            "penalties": [], "attachments": [f" {x.upper()}" for x in REQUIRED_ATTACHMENTS],
            "detected": [{"file_name": "z.pdf", "doc_key": "zakat certificate", "fields": {"cr_number": "1010123456", "vat_number": VAT_NO, "expiry_date": "2027-01-01"}, "page": 1}, {"file_name": "c.pdf", "doc_key": "commercial registration", "fields": {"cr_number": "١٠١٠١٢٣٤٥٦"}, "page": 1}],
        },
    }


def changed(**paths):
    claim = copy.deepcopy(base())
    for path, value in paths.items():
        at = claim
        *parents, last = path.split("__")
        for p in parents:
            at = at[int(p)] if isinstance(at, list) else at[p]
        at[int(last) if isinstance(at, list) else last] = value
    return claim


D = "documents__"
TERM = {"kind": "delay", "rate_percent": 1.0, "per": "week", "basis": "", "cap_percent": 6.0, "text_ar": "", "ref": "9.1"}
LATE = {"contract_end_date": "2026-02-20", D + "coc__coc_date": "2026-03-03", D + "coc__contract_end_date": "2026-02-20", D + "coc__has_delay": True}
CASES = {
    "good": ({}, {}),
    "no_value": ({"contract_value": 0.0}, {"boq.cumulative_within_contract": "warn"}),
    "over_value": ({"contract_value": 2500.0, D + "coc__contract_value_with_vat": 2875.0}, {"boq.cumulative_within_contract": "fail"}),
    "paid_before": ({"payment_no": 2, D + "coc__payment_no": 2}, {"boq.payment_not_already_disbursed": "fail", "boq.payment_sequence": None}),
    "skipped": ({"payment_no": 5, D + "coc__payment_no": 5}, {"boq.payment_sequence": "warn"}),
    "first_again": ({"claim_type": "first", D + "coc__claim_type": "first"}, {"boq.claim_type_consistent": "fail"}),
    "final_short": ({"claim_type": "final", D + "coc__claim_type": "final"}, {"boq.claim_type_consistent": "fail", "boq.final_claim_closes_contract": "warn"}),
    "periodic_closes": ({"contract_value": 3000.0, D + "coc__contract_value_with_vat": 3450.0}, {"boq.claim_type_consistent": "warn"}),
    "bidi": ({"invoice_no": "00070-2026-INV"}, {}),
    "wrong_no": ({"invoice_no": "INV-2026-00071"}, {"intake.invoice_no_matches": "fail"}),
    "bad_sum": ({"claim_amount_total": 1151.0}, {"intake.vat_math": "fail", "three_way.coc_amount_matches_claim": "fail"}),
    "no_code": ({D + "invoice__qr_payload": ""}, {"intake.qr_present": "fail", "intake.qr_authentic": None, "intake.qr_phase2": None}),
    "no_invoice": ({D + "invoice": None}, {"intake.invoice_no_matches": "fail", "intake.qr_present": "fail", "intake.qr_authentic": None, "intake.qr_phase2": None, "boq.lines_match": None, "three_way.coc_amounts_match_invoice": None, "three_way.billed_vs_received": None, "prefinance.vat_treatment": None, "prefinance.vat_matches_invoice": None}),
    "price": ({D + "invoice__lines__0__unit_price": 101.0}, {"boq.lines_match": "fail"}),
    "deduction": ({D + "invoice__lines__0__quantity": -1.0}, {}),
    "over_received": ({D + "invoice__lines__0__quantity": 11.0}, {"three_way.billed_vs_received": "fail"}),
    "over_boq": ({D + "receipt__lines__0__quantity": 51.0}, {"three_way.received_within_boq": "fail"}),
    "uncertified": ({D + "receipt__lines__0__quantity": 1.0}, {"three_way.billed_vs_received": "fail", "three_way.claimed_within_certified_value": "fail"}),
    "no_coc": ({D + "coc": None}, {"three_way.acceptance_present": "warn", **{f"three_way.coc_{x}": None for x in ("amount_matches_claim", "invoice_ref", "amounts_match_invoice", "payment_matches_claim", "contract_value")}, "final.delay_vs_penalties": None, "final.delay_from_dates": None, "final.coc_contract_end": None}),
    "coc_sum": ({D + "coc__vat_amount": 149.0}, {"three_way.coc_amounts_match_invoice": "fail"}),
    "coc_value": ({D + "coc__contract_value_with_vat": 11502.0}, {"three_way.coc_contract_value": "fail"}),
    "end_off": ({D + "coc__contract_end_date": "2026-04-30"}, {"final.coc_contract_end": "fail"}),
    "end_near": ({D + "coc__contract_end_date": "2026-04-02"}, {}),
    "month_first": ({"contract_end_date": "2026-07-01", D + "coc__contract_end_date": "2026-01-07", D + "coc__coc_date": "2026-01-06"}, {}),
    "denied_delay": ({**LATE, D + "coc__has_delay": False}, {"final.delay_from_dates": "fail"}),
    "no_penalty": (LATE, {"final.delay_from_dates": "warn"}),
    "unknown_delay": ({**LATE, D + "coc__has_delay": None, D + "penalties": [{"reason_ar": "", "amount": 10.0, "date": ""}]}, {}),
    "contradiction": ({D + "penalties": [{"reason_ar": "", "amount": 10.0, "date": ""}]}, {"final.delay_vs_penalties": "fail"}),
    "terms_unmet": ({**LATE, D + "contract__penalty_terms": [TERM]}, {"final.delay_from_dates": "warn", "final.penalties_vs_contract": "fail"}),
    "terms_low": ({**LATE, D + "contract__penalty_terms": [TERM], D + "penalties": [{"reason_ar": "", "amount": 100.0, "date": ""}]}, {"final.penalties_vs_contract": "warn"}),
    "terms_met": ({**LATE, D + "contract__penalty_terms": [TERM], D + "penalties": [{"reason_ar": "", "amount": 200.0, "date": ""}]}, {"final.penalties_vs_contract": "ok"}),
    "terms_over": ({**LATE, D + "contract__penalty_terms": [TERM], D + "penalties": [{"reason_ar": "", "amount": 700.0, "date": ""}]}, {"final.penalties_vs_contract": "fail"}),
    "missing_file": ({D + "attachments": REQUIRED_ATTACHMENTS[1:]}, {"prefinance.attachments_complete": "fail"}),
    "other_cr": ({D + "detected__1__fields": {"cr_number": "1010123457"}}, {"prefinance.identity_consistent": "fail"}),
    "short_cr": ({D + "detected__1__fields": {"cr_number": "101"}}, {"prefinance.identity_consistent": "fail", "prefinance.identifier_format": "warn"}),
    "other_name": ({D + "detected__1__fields": {"cr_number": "1010123456", "vendor_name_ar": "Someone else"}}, {"prefinance.vendor_name_consistent": "warn"}),
    "expired": ({D + "detected__0__fields": {"vat_number": VAT_NO, "expiry_date": "2026-01-05"}}, {"prefinance.certificates_valid": "fail", "prefinance.identity_consistent": None}),
    "hijri": ({D + "detected__0__fields": {"vat_number": VAT_NO, "expiry_date": "1447-11-20"}}, {"prefinance.certificates_valid": None, "prefinance.identity_consistent": None}),
}
NOT_BAD = {"intake.qr_phase2": "warn"}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    claims = []
    for name, (paths, _) in CASES.items():
        claims.append(changed(**paths) | {"id": name})
    path = tmp_path_factory.mktemp("claims") / "claims.json"
    path.write_text(json.dumps(claims, ensure_ascii=False))
    frame = source.read_claims(spark, str(path))
    rows = engine.findings(frame).collect()
    out = {}
    for r in rows:
        out.setdefault(r["claim_id"], {})[r["rule_id"]] = r["severity"]
    return frame, out


@pytest.mark.parametrize("name", CASES)
def test_case(found, name):
    got = {k: v for k, v in found[1][name].items() if v != "ok"}
    want = NOT_BAD | CASES[name][1]
    assert got == {k: v for k, v in want.items() if v not in (None, "ok")}
    for rule, severity in CASES[name][1].items():
        assert found[1][name].get(rule) == severity


def test_rollup(found):
    frame, _ = found
    some = frame.filter(F.col("id").isin("good", "price", "no_value"))
    found_, runs, verdicts = engine.run(some)
    assert {r["claim_id"]: r["verdict"] for r in verdicts.collect()} == {"good": "needs_human", "price": "reject", "no_value": "needs_human"}
    assert {r["claim_id"]: r["rationale"] for r in verdicts.collect()}["price"] == "Invoice lines are in the bill of quantities"
    assert runs.count() == 15 and {r["severity"] for r in runs.filter("claim_id = 'good'").collect()} == {"ok", "warn"}
    assert {r["gate"] for r in engine.findings(some, ["intake"]).select("gate").collect()} == {"intake"}
    with pytest.raises(ValueError):
        engine.findings(some, ["nowhere"])


def test_no_claims(spark):
    none = source.empty_claims(spark)
    assert [x.count() for x in engine.run(none)] == [0, 0, 0]
    assert none.schema == spark.createDataFrame([], CLAIM).schema


def test_last_of_id_and_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "a", "po_no": "1"}, {"id": "a", "po_no": "2", "unknown": 5}, {"id": "b", "source_files": [{"path": "x", "doc_type": "invoice"}]}]))
    claims = source.read_claims(spark, str(tmp_path / "c.json"))
    assert {r["id"]: (r["po_no"], r["claim_type"], r["contract_value"]) for r in claims.collect()} == {"a": ("2", "periodic", 0.0), "b": ("", "periodic", 0.0)}
    files = spark.createDataFrame([("y",)], "path string")
    assert [r["id"] for r in source.available(claims, files).collect()] == ["a"]


PAGE = "Invoice INV-2026-00070 VAT 310122393500003 account 20261234 reference 99887766 total 1,150.00 vat 150.00 certificate 1,150.00 1,000.00 contract 14,950,000.00"


def test_text_corrects_reads(spark, tmp_path):
    from auditspark.operators import witness

    bad = changed(**{
        D + "invoice__invoice_no": "INV-2026-00007", D + "invoice__seller_vat_number": "310122395300003", D + "invoice__total_with_vat": 11500.0,
        D + "coc__claim_net": 10000.0, D + "contract__value_base": 4950000.0, D + "contract__value_with_vat": 4950000.0,
    })
    plain = copy.deepcopy(bad) | {"id": "B"}
    (tmp_path / "c.json").write_text(json.dumps([bad, plain]))
    claims = source.read_claims(spark, str(tmp_path / "c.json")).withColumn("page_text", F.when(F.col("id") == "A", PAGE).otherwise("no digits"))
    got = {r["id"]: r["documents"] for r in witness.reconcile(claims).select("id", "documents").collect()}
    a, b = got["A"], got["B"]
    assert (a["invoice"]["invoice_no"], a["invoice"]["seller_vat_number"], a["invoice"]["total_with_vat"]) == ("INV-2026-00070", VAT_NO, 1150.0)
    assert a["coc"]["claim_net"] == 1000.0 and (a["contract"]["value_base"], a["contract"]["value_with_vat"]) == (13000000.0, 14950000.0)
    assert (b["invoice"]["invoice_no"], b["invoice"]["total_with_vat"], b["coc"]["claim_net"]) == ("INV-2026-00007", 11500.0, 10000.0)


def test_text_corrects_lines_before_the_header(spark, tmp_path):
    """A line's amount read with a digit too much, which alone makes the header look wrong."""
    from auditspark.operators import witness

    bad = changed(**{D + "invoice__total_with_vat": 1150.0, D + "invoice__vat_amount": 150.0})
    line = bad["documents"]["invoice"]["lines"][0]
    bad["documents"]["invoice"]["lines"] = [line | {"quantity": 10.0, "unit_price": 100.0, "amount": 10000.0}]
    (tmp_path / "c.json").write_text(json.dumps([bad]))
    claims = source.read_claims(spark, str(tmp_path / "c.json")).withColumn("page_text", F.lit(PAGE + " line 10 x 100.00"))
    invoice = witness.reconcile(claims).first()["documents"]["invoice"]
    assert invoice["lines"][0]["amount"] == 1000.0 and invoice["total_with_vat"] == 1150.0


def test_roll_ups_equal_those_of_the_findings(spark):
    """Within a row of claims as by way of the findings, for all gates and for some."""
    from auditspark.plans import views

    claims = views.nested_claims(spark, "/root/testdata/sf0.001").filter("cast(id as int) % 5 = 0")
    for gates in (None, ["prefinance", "boq_match"]):
        found, runs, verdicts = engine.run(claims, gates)
        found.cache()
        assert sorted(engine.roll_up(claims, gates).collect()) == sorted(verdicts.collect())
        assert sorted(engine.gate_roll_up(claims, gates).collect()) == sorted(runs.collect())


def test_rules_from_files(spark, tmp_path):
    from auditspark.operators.rules import RULES, read_rules

    for gate in ("prefinance", "intake"):
        pack = {"gate": gate, "rules": [{"id": r.rule_id, "check": r.check, "severity": r.severity, "title": r.title, "source": r.source, "params": r.params} for r in RULES if r.gate == gate]}
        (tmp_path / f"{gate}.json").write_text(json.dumps(pack, indent=1))
    got = read_rules(spark, str(tmp_path))
    assert got == tuple(r for r in RULES if r.gate == "intake") + tuple(r for r in RULES if r.gate == "prefinance")
    (tmp_path / "odd.json").write_text('{"gate": "none", "rules": []}')
    with pytest.raises(ValueError, match="none"):
        read_rules(spark, str(tmp_path))


def test_roll_ups_and_plain_findings_without_evidence(spark):
    """Plain findings equal the findings; neither they nor roll-ups write evidence or filter an array of all outcomes."""
    from auditspark.plans import queries, views

    claims = views.nested_claims(spark, "/root/testdata/sf0.001").filter("cast(id as int) % 5 = 0")
    plain = engine.plain_findings(claims)
    assert sorted(plain.collect()) == sorted(engine.findings(claims).select(plain.columns).collect())
    for name in ("claim_verdicts", "gate_severity", "rule_findings", "ext_findings_rollup"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "to_json" not in plan and "StructsToJson" not in plan
        assert plan.count("lambdafunction") and not any("rule_order" in part and "lambdafunction" in part for part in plan.split("\n"))
