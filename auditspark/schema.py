"""Schema of nested claims. A missing number is 0, a missing text '', a missing document null."""

from __future__ import annotations

CLAIM = """
id string, po_no string, project_no string, project_name_ar string, project_name_en string, vendor_account string,
vendor_name_ar string, vendor_name_en string, contract_value double, claim_amount_base double, vat_amount double,
claim_amount_total double, cumulative_prior double, contract_kind string, contract_end_date string, claim_date string,
invoice_no string, payment_no int, prior_payment_count int, claim_type string, status_ar string, origin string,
source_files array<struct<path: string, doc_type: string>>,
documents struct<
  invoice: struct<invoice_no: string, invoice_date: string, seller_name_ar: string, seller_vat_number: string,
    total_with_vat: double, vat_amount: double, vat_exempt: boolean, qr_payload: string,
    lines: array<struct<item_code: string, description_ar: string, unit_price: double, quantity: double, amount: double, page: int, source_file: string>>,
    page: int, source_file: string>,
  boq: array<struct<item_code: string, description_ar: string, description_en: string, unit: string, unit_price: double, quantity: double, page: int, source_file: string>>,
  coc: struct<coc_no: string, coc_date: string, claim_amount: double, claim_net: double, vat_amount: double, invoice_ref: string,
    payment_no: int, claim_type: string, contract_no: string, contract_start_date: string, contract_end_date: string,
    contract_value_with_vat: double, award_letter_no: string, site_handover_date: string, has_delay: boolean, has_stoppage: boolean,
    has_observations: boolean, delay_days: int, page: int, source_file: string>,
  receipt: struct<receipt_no: string, receipt_date: string, lines: array<struct<item_code: string, description_ar: string, quantity: double, page: int, source_file: string>>, page: int, source_file: string>,
  contract: struct<contract_no: string, start_date: string, end_date: string, value_base: double, value_with_vat: double,
    penalty_terms: array<struct<kind: string, rate_percent: double, per: string, basis: string, cap_percent: double, text_ar: string, ref: string, page: int, source_file: string>>,
    page: int, source_file: string>,
  penalties: array<struct<reason_ar: string, amount: double, date: string>>,
  attachments: array<string>,
  detected: array<struct<file_name: string, doc_key: string, fields: map<string, string>, page: int>>>
"""

#: Values that stand for a missing field of a claim's header.
DEFAULTS = {"contract_kind": "works", "claim_type": "periodic", "origin": "erp", "payment_no": 0, "prior_payment_count": 0}
