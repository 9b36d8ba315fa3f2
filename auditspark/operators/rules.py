"""The rules as data: which check each gate runs, in which order, how bad its failure is."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITIES = ("ok", "warn", "fail")


@dataclass(frozen=True)
class Rule:
    gate: str
    rule_id: str
    check: str
    severity: str = "fail"
    title: str = ""
    source: str = ""
    params: dict = field(default_factory=dict)


# Gates in order; rules of each gate in order, with severity, parameters and normative source.
GATES = ("intake", "boq_match", "three_way_match", "final_check", "prefinance")
REQUIRED_FIELDS = ["invoice_no", "payment_no", "claim_type", "claim_date"]
REQUIRED_ATTACHMENTS = ["contract", "boq", "award letter", "work commencement", "commercial registration", "zakat certificate", "gosi certificate"]
RULES = (
    Rule("intake", "intake.metadata_complete", "metadata_complete", "fail", "Claim header complete", "procedure", {"fields": REQUIRED_FIELDS}),
    Rule("intake", "intake.invoice_no_matches", "invoice_no_matches", "fail", "Invoice number as claimed", "procedure"),
    Rule("intake", "intake.vat_math", "vat_math", "fail", "Total is base plus VAT", "VAT Implementing Regulations"),
    Rule("intake", "intake.qr_present", "qr_present", "fail", "Invoice code present", "ZATCA e-invoicing"),
    Rule("intake", "intake.qr_authentic", "qr_authentic", "fail", "Invoice code agrees with the invoice", "ZATCA e-invoicing"),
    Rule("intake", "intake.qr_phase2", "qr_phase2", "warn", "Invoice code is signed", "ZATCA e-invoicing"),
    Rule("boq_match", "boq.lines_match", "boq_lines_match", "fail", "Invoice lines are in the bill of quantities", "contract"),
    Rule("boq_match", "boq.cumulative_within_contract", "cumulative_within_contract", "fail", "Payments within the contract value", "Procurement Law Exec. Regulations"),
    Rule("boq_match", "boq.payment_not_already_disbursed", "payment_not_already_disbursed", "fail", "Payment not disbursed before", "practice"),
    Rule("boq_match", "boq.payment_sequence", "payment_sequence", "warn", "Payments in sequence", "contract"),
    Rule("boq_match", "boq.claim_type_consistent", "claim_type_consistent", "fail", "Claim type fits the balance", "practice"),
    Rule("boq_match", "boq.final_claim_closes_contract", "final_claim_closes_contract", "warn", "Final claim closes the contract", "Procurement Law Exec. Regulations"),
    Rule("three_way_match", "three_way.acceptance_present", "acceptance_present", "warn", "Acceptance document present", "procedure"),
    Rule("three_way_match", "three_way.coc_amount_matches_claim", "coc_amount_matches_claim", "fail", "Certified amount as claimed", "procedure"),
    Rule("three_way_match", "three_way.coc_invoice_ref", "coc_invoice_ref_matches", "fail", "Certificate names the invoice", "procedure"),
    Rule("three_way_match", "three_way.coc_amounts_match_invoice", "coc_amounts_match_invoice", "fail", "Certificate and invoice amounts agree", "procedure"),
    Rule("three_way_match", "three_way.coc_payment_matches_claim", "coc_payment_matches_claim", "fail", "Certificate and claim are of one payment", "procedure"),
    Rule("three_way_match", "three_way.coc_contract_value", "coc_contract_value_matches", "fail", "Certificate has the contract value", "contract"),
    Rule("three_way_match", "three_way.coc_award_letter", "coc_award_letter_matches", "warn", "Certificate names the award letter", "procedure"),
    Rule("three_way_match", "three_way.billed_vs_received", "billed_vs_received", "fail", "Nothing billed that wasn't received", "Procurement Law Exec. Regulations"),
    Rule("three_way_match", "three_way.received_within_boq", "received_within_boq", "fail", "Nothing received beyond the bill of quantities", "contract"),
    Rule("three_way_match", "three_way.claimed_within_certified_value", "claimed_within_certified_value", "fail", "Claim within the certified value", "Procurement Law Exec. Regulations"),
    Rule("final_check", "final.delay_vs_penalties", "coc_delay_vs_penalties", "fail", "Declared delay and penalties agree", "internal audit"),
    Rule("final_check", "final.delay_from_dates", "delay_from_dates", "fail", "Delay by dates is declared", "contract"),
    Rule("final_check", "final.coc_contract_end", "coc_contract_end_matches", "fail", "Certificate has the contract's end", "contract", {"tolerance_days": 3}),
    Rule("final_check", "final.penalties_vs_contract", "penalties_vs_contract_terms", "fail", "Penalties follow the contract's clause", "contract"),
    Rule("prefinance", "prefinance.attachments_complete", "attachments_complete", "fail", "Required attachments filed", "procedure", {"required": REQUIRED_ATTACHMENTS}),
    Rule("prefinance", "prefinance.vat_treatment", "vat_treatment_declared", "fail", "VAT charged or exempt", "VAT Implementing Regulations"),
    Rule("prefinance", "prefinance.identity_consistent", "attachment_identity_consistent", "fail", "Attachments are of one vendor", "procedure"),
    Rule("prefinance", "prefinance.vat_matches_invoice", "attachment_vat_matches_invoice", "fail", "Attachments have the invoice's VAT number", "ZATCA e-invoicing"),
    Rule("prefinance", "prefinance.vendor_name_consistent", "attachment_vendor_name_consistent", "warn", "One vendor name throughout", "procedure"),
    Rule("prefinance", "prefinance.identifier_format", "attachment_id_formats", "warn", "Identifiers well formed", "registration formats"),
    Rule("prefinance", "prefinance.certificates_valid", "attachment_certificates_valid", "fail", "Certificates valid on the claim's date", "procedure"),
)


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [(r.gate, GATES.index(r.gate) + 1, r.rule_id, i, r.check, r.severity, r.title, r.source) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "gate string, gate_order int, rule_id string, rule_order int, check string, severity string, title string, source string")


def gates_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g, i + 1) for i, g in enumerate(GATES)], "gate string, gate_order int")


def read_rules(spark: SparkSession, path: str, gates=GATES) -> tuple[Rule, ...]:
    """Rules from JSON files, one object a file or line: gate, and rules of id, check, severity, title, source and params.

    Gates come in their order, rules in that of their files. An unknown gate is an error; an unknown check is passed over
    when the rules run.
    """
    kind = "gate string, rules array<struct<id: string, check: string, severity: string, title: string, source: string, params: variant>>"
    packs = spark.read.schema(kind).option("multiLine", True).json(path).select("gate", F.to_json("rules").alias("rules")).collect()  # a row a gate
    if unknown := sorted({p["gate"] or "" for p in packs} - set(gates)):
        raise ValueError(f"unknown gates: {', '.join(unknown)}")
    out = []
    for pack in sorted(packs, key=lambda p: gates.index(p["gate"])):
        for r in json.loads(pack["rules"] or "[]"):
            out.append(Rule(pack["gate"], r["id"], r["check"], r.get("severity") or "fail", r.get("title") or "", r.get("source") or "", r.get("params") or {}))
    return tuple(out)


def known_gates(wanted) -> list[str]:
    """The wanted gates in order; an unknown one is an error."""
    unknown = sorted(set(wanted) - set(GATES))
    if unknown:
        raise ValueError(f"unknown gates: {', '.join(unknown)}")
    return [g for g in GATES if g in set(wanted)]
