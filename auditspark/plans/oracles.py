"""DuckDB SQL of the audit queries that it can express, written apart from the Spark operators."""

from __future__ import annotations

LINES = """
li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)::INTEGER AS pos FROM lineitem),
inv AS (SELECT l_orderkey AS claim_id, pos, l_partkey AS item_code, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity,
  p_retailprice + CASE WHEN l_linenumber % 3 = 0 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS unit_price FROM li JOIN part ON p_partkey = l_partkey),
boq_all AS (SELECT 1 AS pos, p_partkey AS item_code, p_retailprice AS unit_price, p_size::DOUBLE AS quantity FROM part WHERE p_partkey % 10 != 0
  UNION ALL SELECT 2, p_partkey, p_retailprice + 1, p_size::DOUBLE FROM part WHERE p_partkey % 10 != 0 AND p_partkey % 7 = 0),
boq AS (SELECT item_code, arg_max(unit_price, pos) AS unit_price, arg_max(quantity, pos) AS quantity FROM boq_all GROUP BY item_code),
rec AS (SELECT l_orderkey AS claim_id, pos, l_partkey AS item_code, l_quantity - CASE WHEN l_linenumber % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS quantity FROM li WHERE l_linestatus = 'F'),
rec_last AS (SELECT claim_id, item_code, arg_max(quantity, pos) AS quantity FROM rec GROUP BY ALL)
"""

FINDINGS = f"""
{LINES},
ln AS (SELECT i.claim_id, count(*) AS n,
    sum(CASE WHEN i.quantity >= 0 AND (b.item_code IS NULL OR abs(b.unit_price - i.unit_price) > 0.01) THEN 1 ELSE 0 END) AS bad,
    sum(CASE WHEN i.quantity > coalesce(r.quantity, 0) + 1e-6 THEN 1 ELSE 0 END) AS over
  FROM inv i LEFT JOIN boq b USING (item_code) LEFT JOIN rec_last r ON r.claim_id = i.claim_id AND r.item_code = i.item_code GROUP BY i.claim_id),
hb AS (SELECT DISTINCT claim_id FROM inv JOIN boq USING (item_code)),
rc AS (SELECT r.claim_id, sum(CASE WHEN b.item_code IS NULL OR r.quantity > b.quantity + 1e-6 THEN 1 ELSE 0 END) AS bad,
    round(sum((r.quantity * b.unit_price)::DECIMAL(28, 6)), 2)::DOUBLE AS certified FROM rec r LEFT JOIN boq b USING (item_code) GROUP BY r.claim_id),
a AS (SELECT o_orderkey AS k, o_totalprice AS base, o_totalprice * 0.15::DOUBLE AS vat, o_orderdate::DATE AS day, o_orderstatus = 'F' AS goods FROM orders),
x AS (SELECT a.*, base + vat + CASE WHEN k % 5 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS total,
    CASE WHEN k % 6 = 0 THEN 0.0::DOUBLE WHEN k % 6 = 1 THEN base ELSE base * 3.0::DOUBLE END AS value,
    CASE WHEN k % 7 = 0 THEN 'final' WHEN k % 7 = 1 THEN 'first' ELSE 'periodic' END AS kind,
    day + (k % 40 - 20)::INTEGER AS fin, k % 29 != 0 AS has_inv, k % 9 != 0 AS has_coc, k % 10 != 0 AS has_rec,
    CASE WHEN k % 6 = 1 THEN 0.0::DOUBLE ELSE base * (k % 3)::DOUBLE END AS prior, k % 4 AS no, k % 3 AS paid,
    CASE WHEN k % 3 = 0 THEN (k % 5) * 100.0::DOUBLE ELSE 0.0::DOUBLE END AS pen FROM a),
y AS (SELECT x.*, round(prior + base, 2) AS cum, value - round(prior + base, 2) AS remaining, coalesce(ln.n, 0) AS n_lines, ln.bad AS bad_lines, ln.over AS over_lines,
    hb.claim_id IS NOT NULL AS has_boq, coalesce(rc.bad, 0) AS bad_rec, coalesce(rc.certified, 0) AS certified,
    CASE WHEN has_coc THEN fin + (k % 8)::INTEGER END AS coc_end,
    CASE WHEN has_coc THEN day + (k % 30)::INTEGER END AS coc_day, CASE WHEN has_rec THEN day + (k % 25)::INTEGER END AS rec_day
  FROM x LEFT JOIN ln ON ln.claim_id = k LEFT JOIN hb ON hb.claim_id = k LEFT JOIN rc ON rc.claim_id = k),
m AS (SELECT *, coalesce(coc_end != fin AND try_cast(strftime(coc_end, '%Y-%d-%m') AS DATE) = fin, false) AS turned FROM y),
z AS (SELECT *, date_diff('day', fin, CASE WHEN goods THEN rec_day WHEN turned THEN coalesce(try_cast(strftime(coc_day, '%Y-%d-%m') AS DATE), coc_day) ELSE coc_day END) AS late FROM m),
w AS (SELECT *, CASE WHEN late IS NULL THEN NULL ELSE greatest(late, 0) END AS delay,
    CASE k % 4 WHEN 1 THEN 10.0::DOUBLE WHEN 2 THEN 5.0::DOUBLE END AS cap, CASE k % 4 WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.1::DOUBLE END AS rate FROM z),
v AS (SELECT *, CASE WHEN k % 4 = 1 THEN ceil(delay / 7.0) WHEN k % 4 = 2 THEN delay END AS units, round(cap / 100 * value, 2) AS most FROM w),
u AS (SELECT *, CASE WHEN units > 0 THEN round(CASE WHEN most > 0 THEN least(rate / 100 * units * value, most) ELSE rate / 100 * units * value END, 2) ELSE 0 END AS expected FROM v),
f(k, gate, gate_order, rule_order, rule_id, title, severity) AS (
  SELECT k, 'intake', 1, 0, 'intake.metadata_complete', 'Claim header complete', CASE WHEN k % 11 != 0 AND no > 0 THEN 'ok' ELSE 'fail' END FROM u
  UNION ALL SELECT k, 'intake', 1, 1, 'intake.invoice_no_matches', 'Invoice number as claimed', CASE WHEN has_inv AND k % 11 != 0 THEN 'ok' ELSE 'fail' END FROM u
  UNION ALL SELECT k, 'intake', 1, 2, 'intake.vat_math', 'Total is base plus VAT', CASE WHEN abs(base + vat - total) <= 0.01 THEN 'ok' ELSE 'fail' END FROM u
  UNION ALL SELECT k, 'intake', 1, 3, 'intake.qr_present', 'Invoice code present', CASE WHEN has_inv AND k % 37 != 0 THEN 'ok' ELSE 'fail' END FROM u WHERE NOT (has_inv AND k % 31 = 0)
  UNION ALL SELECT k, 'intake', 1, 4, 'intake.qr_authentic', 'Invoice code agrees with the invoice', CASE WHEN k % 16 != 0 THEN 'ok' ELSE 'fail' END FROM u WHERE has_inv AND k % 37 != 0
  UNION ALL SELECT k, 'intake', 1, 5, 'intake.qr_phase2', 'Invoice code is signed', 'warn' FROM u WHERE has_inv AND k % 37 != 0
  UNION ALL SELECT k, 'boq_match', 2, 6, 'boq.lines_match', 'Invoice lines are in the bill of quantities', CASE WHEN bad_lines = 0 THEN 'ok' ELSE 'fail' END FROM u WHERE has_inv AND n_lines > 0
  UNION ALL SELECT k, 'boq_match', 2, 7, 'boq.cumulative_within_contract', 'Payments within the contract value', CASE WHEN value <= 0 THEN 'warn' WHEN cum <= value + 0.01 THEN 'ok' ELSE 'fail' END FROM u
  UNION ALL SELECT k, 'boq_match', 2, 8, 'boq.payment_not_already_disbursed', 'Payment not disbursed before', CASE WHEN no > paid THEN 'ok' ELSE 'fail' END FROM u WHERE no >= 1
  UNION ALL SELECT k, 'boq_match', 2, 9, 'boq.payment_sequence', 'Payments in sequence', CASE WHEN no = paid + 1 THEN 'ok' ELSE 'warn' END FROM u WHERE NOT (no >= 1 AND no <= paid)
  UNION ALL SELECT k, 'boq_match', 2, 10, 'boq.claim_type_consistent', 'Claim type fits the balance', CASE WHEN kind = 'final' THEN CASE WHEN remaining > 0.01 THEN 'fail' ELSE 'ok' END
      WHEN kind = 'first' AND paid > 0 THEN 'fail' WHEN value > 0 AND abs(remaining) <= 0.01 THEN 'warn' ELSE 'ok' END FROM u WHERE NOT (kind = 'final' AND value <= 0)
  UNION ALL SELECT k, 'boq_match', 2, 11, 'boq.final_claim_closes_contract', 'Final claim closes the contract', CASE WHEN value > 0 AND abs(remaining) <= 0.01 THEN 'ok' ELSE 'warn' END FROM u WHERE kind = 'final' AND (value <= 0 OR remaining >= -0.01)
  UNION ALL SELECT k, 'three_way_match', 3, 12, 'three_way.acceptance_present', 'Acceptance document present', CASE WHEN CASE WHEN goods THEN has_rec ELSE has_coc END THEN 'ok' ELSE 'warn' END FROM u
  UNION ALL SELECT k, 'three_way_match', 3, 13, 'three_way.coc_amount_matches_claim', 'Certified amount as claimed', CASE WHEN k % 13 = 0 THEN 'fail' ELSE 'ok' END FROM u WHERE has_coc
  UNION ALL SELECT k, 'three_way_match', 3, 14, 'three_way.coc_invoice_ref', 'Certificate names the invoice', 'ok' FROM u WHERE has_coc AND (has_inv OR k % 11 != 0)
  UNION ALL SELECT k, 'three_way_match', 3, 15, 'three_way.coc_amounts_match_invoice', 'Certificate and invoice amounts agree', CASE WHEN k % 5 = 0 OR k % 17 = 0 THEN 'fail' ELSE 'ok' END FROM u WHERE has_coc AND has_inv
  UNION ALL SELECT k, 'three_way_match', 3, 16, 'three_way.coc_payment_matches_claim', 'Certificate and claim are of one payment', CASE WHEN k % 19 = 0 AND kind != 'periodic' THEN 'fail' ELSE 'ok' END FROM u WHERE has_coc
  UNION ALL SELECT k, 'three_way_match', 3, 17, 'three_way.coc_contract_value', 'Certificate has the contract value', CASE WHEN k % 23 = 0 THEN 'fail' ELSE 'ok' END FROM u WHERE has_coc AND value > 0
  UNION ALL SELECT k, 'three_way_match', 3, 19, 'three_way.billed_vs_received', 'Nothing billed that wasn''t received', CASE WHEN coalesce(over_lines, 0) = 0 THEN 'ok' ELSE 'fail' END FROM u WHERE has_inv AND has_rec
  UNION ALL SELECT k, 'three_way_match', 3, 20, 'three_way.received_within_boq', 'Nothing received beyond the bill of quantities', CASE WHEN bad_rec = 0 THEN 'ok' ELSE 'fail' END FROM u WHERE has_rec AND has_boq
  UNION ALL SELECT k, 'three_way_match', 3, 21, 'three_way.claimed_within_certified_value', 'Claim within the certified value', CASE WHEN base <= certified + 0.01 THEN 'ok' ELSE 'fail' END FROM u WHERE has_rec AND has_boq
  UNION ALL SELECT k, 'final_check', 4, 22, 'final.delay_vs_penalties', 'Declared delay and penalties agree', CASE WHEN pen > 0 AND k % 2 = 0 THEN 'fail' ELSE 'ok' END FROM u WHERE has_coc
  UNION ALL SELECT k, 'final_check', 4, 23, 'final.delay_from_dates', 'Delay by dates is declared', CASE WHEN late <= 0 THEN 'ok' WHEN NOT goods AND has_coc AND k % 2 = 0 THEN 'fail' WHEN pen <= 0 THEN 'warn' ELSE 'ok' END FROM u WHERE late IS NOT NULL
  UNION ALL SELECT k, 'final_check', 4, 24, 'final.coc_contract_end', 'Certificate has the contract''s end', CASE WHEN turned OR abs(date_diff('day', fin, coc_end)) <= 3 THEN 'ok' ELSE 'fail' END FROM u WHERE coc_end IS NOT NULL
  UNION ALL SELECT k, 'final_check', 4, 25, 'final.penalties_vs_contract', 'Penalties follow the contract''s clause', CASE WHEN most > 0 AND pen > most + 0.01 THEN 'fail' WHEN delay = 0 THEN 'ok' WHEN pen <= 0 THEN 'fail' WHEN expected > 0 AND pen < expected - 0.01 THEN 'warn' ELSE 'ok' END
      FROM u WHERE k % 4 IN (1, 2) AND (late IS NOT NULL OR (most > 0 AND pen > most + 0.01))
  UNION ALL SELECT k, 'prefinance', 5, 26, 'prefinance.attachments_complete', 'Required attachments filed', CASE WHEN k % 8 = 7 THEN 'ok' ELSE 'fail' END FROM u
  UNION ALL SELECT k, 'prefinance', 5, 27, 'prefinance.vat_treatment', 'VAT charged or exempt', CASE WHEN k % 31 = 0 OR vat > 0 THEN 'ok' ELSE 'fail' END FROM u WHERE has_inv
  UNION ALL SELECT k, 'prefinance', 5, 28, 'prefinance.identity_consistent', 'Attachments are of one vendor', CASE WHEN k % 14 = 0 THEN 'fail' ELSE 'ok' END FROM u
  UNION ALL SELECT k, 'prefinance', 5, 29, 'prefinance.vat_matches_invoice', 'Attachments have the invoice''s VAT number', CASE WHEN k % 14 = 0 THEN 'fail' ELSE 'ok' END FROM u WHERE has_inv
  UNION ALL SELECT k, 'prefinance', 5, 30, 'prefinance.vendor_name_consistent', 'One vendor name throughout', 'ok' FROM u
  UNION ALL SELECT k, 'prefinance', 5, 31, 'prefinance.identifier_format', 'Identifiers well formed', 'ok' FROM u
  UNION ALL SELECT k, 'prefinance', 5, 32, 'prefinance.certificates_valid', 'Certificates valid on the claim''s date', CASE WHEN k % 50 < 10 THEN 'fail' ELSE 'ok' END FROM u)
"""

RANK = "CASE severity WHEN 'ok' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END"
HISTORY = """h AS (SELECT o_orderkey AS claim_id, o_custkey AS contract, o_totalprice::DECIMAL(18, 4) AS amount,
  coalesce(sum(o_totalprice::DECIMAL(18, 4)) OVER b, 0) AS prior, count(*) OVER b AS prior_count FROM orders
  WINDOW b AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
REQUIRED = "['contract', 'boq', 'award letter', 'work commencement', 'commercial registration', 'zakat certificate', 'gosi certificate']"
PAIRS = f"""{LINES}, mine AS (SELECT *, row_number() OVER (PARTITION BY claim_id, item_code ORDER BY pos) AS nth FROM inv WHERE quantity >= 0),
p AS (SELECT m.claim_id, coalesce(m.item_code, b.item_code) AS item_code, coalesce(m.nth, b.pos)::INTEGER AS nth, m.pos AS line_pos, b.pos AS boq_pos,
  CASE WHEN m.pos IS NULL THEN 'not billed' WHEN b.pos IS NULL THEN 'not in BoQ' WHEN abs(m.unit_price - b.unit_price) <= 0.01 THEN 'price matches' ELSE 'unit price differs' END AS status
  FROM mine m FULL OUTER JOIN boq_all b ON m.item_code = b.item_code AND m.nth = b.pos)"""

_EDGES = "،,.:;()[]{}«»\"''“”‘’-—…"

LOCATE_LADDER = f"""
WITH t AS (SELECT conv_id AS doc_id, (turn + 1)::INTEGER AS page, trim(regexp_replace(coalesce(text, ''), '[ \\t-\\r]+', ' ', 'g')) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (SELECT doc_id, page, list_filter(string_split(array_to_string(list_sort(list(text)), ' '), ' '), lambda x: x <> '') AS w FROM t GROUP BY ALL),
i AS (SELECT doc_id, page, unnest(w) AS c, unnest(range(0, len(w)))::INTEGER AS idx FROM p),
k AS (SELECT doc_id, page, idx, lower(c) AS key, trim(lower(c), '{_EDGES}') AS tok, sum(length(lower(c))) OVER (PARTITION BY doc_id, page ORDER BY idx) - length(lower(c)) AS start FROM i),
x AS (SELECT doc_id, page, string_agg(key, '' ORDER BY idx) AS flat FROM k GROUP BY ALL),
d AS (SELECT doc_id, max(page) AS pages, max(w) FILTER (page = 1) AS one, max(w) FILTER (page = 2) AS two, count(*) FILTER (page <= 3 AND len(w) > 0) AS near FROM p GROUP BY doc_id),
n AS (SELECT doc_id, pages, doc_id % 5 AS kind, CASE WHEN doc_id % 5 IN (2, 3) THEN near ELSE 0 END AS base,
        CASE doc_id % 5 WHEN 0 THEN one[3:6] WHEN 1 THEN two[3:6] WHEN 2 THEN one[1:4] WHEN 3 THEN one[1:6] END AS ws FROM d),
a AS (SELECT n.*, CASE WHEN kind < 2 THEN 'value' WHEN kind = 2 THEN 'row' ELSE 'anchor' END AS stage, x.page, x.flat, lower(array_to_string(ws, '')) AS needle,
        list_distinct(list_filter(list_transform(ws, lambda c: trim(lower(c), '{_EDGES}')), lambda c: length(c) >= 2)) AS toks,
        len(list_filter(list_transform(ws, lambda c: trim(lower(c), '{_EDGES}')), lambda c: length(c) >= 2)) AS n_toks
      FROM n JOIN x ON x.doc_id = n.doc_id AND x.page <= CASE WHEN kind = 2 THEN 1 ELSE least(3, pages) END WHERE len(coalesce(ws, [])) > 0),
e AS (SELECT a.*, CASE WHEN contains(flat, needle) THEN strpos(flat, needle) - 1 END AS pos FROM a),
h AS (SELECT e.doc_id, e.page, k.idx, k.tok, len(toks) AS n_set, k.idx - lag(k.idx) OVER (PARTITION BY e.doc_id, e.page ORDER BY k.idx) AS step
      FROM e JOIN k ON k.doc_id = e.doc_id AND k.page = e.page AND list_contains(e.toks, k.tok) WHERE pos IS NULL AND n_toks >= 3),
g AS (SELECT *, sum(CASE WHEN step <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY idx) AS island FROM h),
r AS (SELECT doc_id, page, island, n_set, min(idx) AS first, max(idx) AS last, count(DISTINCT tok) AS n FROM g GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, first) AS o FROM r),
f AS (SELECT e.*, CASE WHEN pos IS NOT NULL THEN 'exact' WHEN b.n >= 4 OR b.n >= 3 AND b.n >= 0.6 * b.n_set THEN 'phrase' END AS how,
        CASE WHEN pos IS NOT NULL THEN (SELECT max(k.idx) FROM k WHERE k.doc_id = e.doc_id AND k.page = e.page AND k.start <= e.pos) ELSE b.first END AS first,
        CASE WHEN pos IS NOT NULL THEN (SELECT max(k.idx) FROM k WHERE k.doc_id = e.doc_id AND k.page = e.page AND k.start <= e.pos + length(e.needle) - 1) ELSE b.last END AS last
      FROM e LEFT JOIN b ON b.doc_id = e.doc_id AND b.page = e.page AND b.o = 1),
z AS (SELECT doc_id, min(page) FILTER (how IS NOT NULL) AS page FROM f GROUP BY doc_id),
l AS (SELECT f.doc_id, count(*) AS looked FROM f JOIN z ON z.doc_id = f.doc_id WHERE f.page <= coalesce(z.page, 99) GROUP BY f.doc_id)
SELECT n.doc_id AS needle_id, n.doc_id, f.stage, coalesce(f.page, 1) AS page, CASE WHEN f.how IS NOT NULL THEN 'words' END AS kind, f.how, f.first, f.last, n.base + coalesce(l.looked, 0) AS looked
FROM n LEFT JOIN z ON z.doc_id = n.doc_id LEFT JOIN f ON f.doc_id = n.doc_id AND f.page = z.page LEFT JOIN l ON l.doc_id = n.doc_id
"""

LOCATE_AMOUNTS = """
WITH li AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_partkey) AS part, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL),
one AS (SELECT k, price AS one FROM li WHERE n = 1),
w AS (SELECT li.k, n, part, CASE WHEN li.k % 2 = 0 THEN one ELSE price END AS shown FROM li JOIN one USING (k)),
t AS (SELECT k, arg_max(part, n) AS part, arg_max(shown, n) AS shown FROM w GROUP BY k),
v AS (SELECT k, part, shown, k % 3 = 0 AS whole, length(floor(shown)::BIGINT::VARCHAR) >= 4 AS long FROM t),
a AS (SELECT v.k, min(w.n) AS at FROM v JOIN w ON w.k = v.k AND w.part = v.part GROUP BY v.k),
o AS (SELECT v.k, w.n, row_number() OVER (PARTITION BY v.k ORDER BY (w.n - a.at) * (w.n - a.at), w.n) AS i FROM v JOIN a USING (k)
      JOIN w ON w.k = v.k AND CASE WHEN v.whole THEN v.long AND floor(w.shown) = floor(v.shown) ELSE w.shown = v.shown END)
SELECT v.k AS needle_id, v.k AS doc_id, CASE WHEN o.k IS NULL THEN 'anchor' ELSE 'value' END AS stage, 1 AS page, 'words' AS kind,
  CASE WHEN o.k IS NULL OR NOT v.whole THEN 'exact' ELSE 'amount' END AS how, coalesce(2 * o.n - 1, 2 * a.at - 2) AS first, coalesce(2 * o.n - 1, 2 * a.at - 2) AS last, CASE WHEN o.k IS NULL THEN 2 ELSE 1 END AS looked
FROM v JOIN a USING (k) LEFT JOIN (SELECT * FROM o WHERE i = 1) o ON o.k = v.k
"""

_RUN_WORDS = """
WITH c AS (SELECT conv_id AS doc_id, turn + 1 AS page, min(text) AS text FROM conversations GROUP BY ALL),
w AS (SELECT doc_id, page, unnest(range(0, len(a))) AS idx, unnest(a) AS content FROM (SELECT doc_id, page, regexp_split_to_array(text, '\\s+') AS a FROM c)),
k AS (SELECT doc_id, page, idx, regexp_replace(lower(content), '[^0-9a-zء-ي.]+|^[.]+|[.]+$', '', 'g') AS tok FROM w),
"""
_RUN_BEST = """
h AS (SELECT DISTINCT k.doc_id, k.page, k.idx, k.tok FROM k JOIN q USING (doc_id, tok)),
g AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY doc_id, page ORDER BY idx) <= 3 THEN 0 ELSE 1 END AS start FROM h),
i AS (SELECT *, sum(start) OVER (PARTITION BY doc_id, page ORDER BY idx) AS island FROM g),
r AS (SELECT doc_id, page, island, min(idx) AS first, max(idx) AS last, count(DISTINCT tok) AS n_tokens FROM i GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY n_tokens DESC, first, last) AS o FROM r)
"""
FUZZY_RUN = f"{_RUN_WORDS} q AS (SELECT DISTINCT doc_id, tok FROM k WHERE page = 1 AND idx < 3), {_RUN_BEST} SELECT doc_id AS needle_id, doc_id, page, first, last, n_tokens FROM b WHERE o = 1"
LOCATE_WORDS = f"""{_RUN_WORDS} q AS (SELECT doc_id, idx - 2 AS i, tok FROM k WHERE page = 2 AND idx BETWEEN 2 AND 4), {_RUN_BEST},
s AS (SELECT doc_id, count(*) AS n FROM q GROUP BY doc_id),
m AS (SELECT k.doc_id, k.page, k.idx - q.i AS first, count(DISTINCT q.i) AS found FROM k JOIN q USING (doc_id, tok) GROUP BY ALL),
u AS (SELECT m.doc_id, 1 AS step, page, first, first + n - 1 AS last FROM m JOIN s USING (doc_id) WHERE found = n AND page <= 3
  UNION ALL SELECT b.doc_id, 2, page, first, last FROM b JOIN s USING (doc_id) WHERE o = 1 AND page <= 3 AND n_tokens * 2 >= n)
SELECT doc_id AS needle_id, doc_id, step, page, first, last FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY step, page, first) AS o FROM u) WHERE o = 1
"""

CONSENSUS_READS = """
WITH o AS (SELECT o_orderkey AS k, max(o_totalprice) AS price FROM orders GROUP BY 1),
j AS (SELECT k, price, p FROM o, (SELECT unnest([1, 2, 3]) AS p) WHERE NOT (k % 11 = 0 AND p = 2 OR k % 143 = 0 AND p <= 2) AND (p = 1 OR k % 5 <> 0)),
x AS (SELECT k, p, k + CASE WHEN k % 6 = 0 AND p = 1 THEN 1 ELSE 0 END AS num, CASE WHEN k % 4 = 0 AND p = 2 THEN price * 10 ELSE price END AS total, 'Vendor ' || substr('abc', p, 1) AS seller,
        NOT (k % 9 = 0 AND p = 2) AS coc, k % 30 + CASE WHEN k % 7 = 0 AND p = 1 THEN 1 ELSE 0 END AS days FROM j),
t AS (SELECT a.k, count(*) = 1 AS two, bool_or(a.coc <> b.coc OR a.days <> b.days AND a.coc AND b.coc) AS rest, bool_or(a.num <> b.num OR round(a.total, 2) <> round(b.total, 2)) AS head
      FROM x a JOIN x b ON a.k = b.k AND a.p = 1 AND b.p = 2 GROUP BY a.k),
s AS (SELECT k FROM t WHERE rest OR head AND k % 3 <> 0),
r AS (SELECT * FROM x WHERE p <= 2 OR k IN (SELECT k FROM s)),
c AS (SELECT *, count(*) OVER (PARTITION BY k, num, round(total, 2), coc, CASE WHEN coc THEN days END) AS cd, count(*) OVER (PARTITION BY k, num, round(total, 2)) AS ci,
        count(*) OVER (PARTITION BY k, coc, days) AS cc, count(*) OVER (PARTITION BY k, num) AS cn, count(*) OVER (PARTITION BY k, round(total, 2)) AS ct, count(*) OVER (PARTITION BY k) AS n FROM r),
d AS (SELECT k, max(n) AS n, min(p) AS p0, min(p) FILTER (cd >= 2) AS pd, min(p) FILTER (ci >= 2) AS pi, min(p) FILTER (coc AND cc >= 2) AS pc, min(p) FILTER (coc) AS pc0,
        min(p) FILTER (cn >= 2) AS pn, min(p) FILTER (ct >= 2) AS pt, bool_or(p = 2) AS second FROM c GROUP BY k),
v AS (SELECT d.*, a.num, b.total, e.seller, g.coc AND g.p IS NOT NULL AS coc, g.days FROM d JOIN r a ON a.k = d.k AND a.p = coalesce(pd, pi, pn, p0) JOIN r b ON b.k = d.k AND b.p = coalesce(pd, pi, pt, p0)
      JOIN r e ON e.k = d.k AND e.p = coalesce(pd, pi, p0) LEFT JOIN r g ON g.k = d.k AND g.p = coalesce(pd, pc, pc0))
SELECT o.k, 'INV-' || CASE WHEN o.k % 3 = 0 THEN CASE WHEN v.num IS NOT NULL THEN o.k END ELSE v.num END AS invoice_no,
  CASE WHEN v.k IS NULL THEN NULL WHEN o.k % 3 = 0 AND round(v.total, 2) <> round(price, 2) THEN price ELSE v.total END AS total_with_vat, v.seller, CASE WHEN v.coc THEN 'C-' || o.k END AS coc_no,
  CASE WHEN v.coc THEN v.days END AS delay_days, CASE WHEN v.k IS NOT NULL THEN CASE WHEN v.second THEN 'd' || o.k ELSE '' END END AS signing_date, coalesce(v.n, 0) AS n_reads, s.k IS NOT NULL AS disputed
FROM o LEFT JOIN v ON v.k = o.k LEFT JOIN s ON s.k = o.k
"""

SQL = {
    "claim_verdicts": f"""WITH {FINDINGS}, r AS (SELECT k, max({RANK}) AS worst, string_agg(CASE WHEN severity = 'fail' THEN title END, '; ' ORDER BY rule_order) AS failed, string_agg(CASE WHEN severity = 'warn' THEN title END, '; ' ORDER BY rule_order) AS warned FROM f GROUP BY k)
        SELECT k::VARCHAR AS claim_id, CASE worst WHEN 2 THEN 'reject' WHEN 1 THEN 'needs_human' ELSE 'approve' END AS verdict, CASE worst WHEN 2 THEN failed WHEN 1 THEN warned ELSE '' END AS rationale FROM r""",
    "rule_findings": f"WITH {FINDINGS} SELECT k::VARCHAR AS claim_id, rule_id, severity FROM f",
    "gate_severity": f"""WITH {FINDINGS}, g AS (SELECT * FROM (VALUES ('intake'), ('boq_match'), ('three_way_match'), ('final_check'), ('prefinance')) t(gate)),
        s AS (SELECT k, gate, max({RANK}) AS worst, count(*) FILTER (severity != 'ok') AS n FROM f GROUP BY ALL)
        SELECT o_orderkey::VARCHAR AS claim_id, g.gate, CASE coalesce(worst, 0) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'ok' END AS severity, coalesce(n, 0) AS n_issues FROM orders CROSS JOIN g LEFT JOIN s ON s.k = o_orderkey AND s.gate = g.gate""",
    "ext_findings_rollup": f"WITH {FINDINGS} SELECT gate, severity, count(*) AS n FROM f GROUP BY ROLLUP (gate, severity)",
    "boq_lines_match": f"""WITH {LINES} SELECT claim_id, count(*) FILTER (quantity >= 0 AND issue) = 0 AS ok, count(*) FILTER (quantity >= 0 AND issue) AS mismatches, count(*) FILTER (quantity < 0) AS deductions
        FROM (SELECT i.*, b.item_code IS NULL OR abs(i.unit_price - b.unit_price) > 0.01 AS issue FROM inv i LEFT JOIN boq b USING (item_code)) GROUP BY claim_id""",
    "billed_vs_received": f"""WITH {LINES} SELECT i.claim_id, i.pos, i.item_code, i.quantity AS billed, coalesce(r.quantity, 0.0) AS received, b.quantity AS boq_quantity FROM inv i
        LEFT JOIN rec_last r ON r.claim_id = i.claim_id AND r.item_code = i.item_code LEFT JOIN boq b ON b.item_code = i.item_code WHERE i.quantity > coalesce(r.quantity, 0) + 1e-6""",
    "received_within_boq": f"""WITH {LINES} SELECT claim_id, r.pos, r.item_code, r.quantity AS received, b.quantity AS boq_quantity, CASE WHEN b.item_code IS NULL THEN 'not in BoQ' ELSE 'quantity' END AS issue
        FROM rec r LEFT JOIN boq b ON b.item_code = r.item_code WHERE b.item_code IS NULL OR r.quantity > b.quantity + 1e-6""",
    "certified_value": f"""WITH {LINES}, s AS (SELECT claim_id, sum(r.quantity::DECIMAL(18, 4) * b.unit_price::DECIMAL(18, 4)) AS v FROM rec r JOIN boq b USING (item_code) GROUP BY claim_id)
        SELECT o_orderkey AS claim_id, (coalesce(v, 0) * 100)::BIGINT AS certified_cents FROM orders LEFT JOIN s ON claim_id = o_orderkey""",
    "line_items_full_outer": f"WITH {PAIRS} SELECT * FROM p",
    "line_status_counts": f"WITH {PAIRS} SELECT status, count(*) AS n FROM p GROUP BY status",
    "attachments_missing": f"""WITH d AS (SELECT floor(doc_id / 5)::BIGINT AS claim_id, {REQUIRED}[1 + (doc_id * 31 % 101) % 7] AS doc_key FROM documents)
        SELECT c.claim_id, r.doc_key FROM (SELECT DISTINCT claim_id FROM d) c CROSS JOIN (SELECT unnest({REQUIRED}) AS doc_key) r EXCEPT SELECT claim_id, doc_key FROM d""",
    "cumulative_within_contract": f"""WITH {HISTORY}, c AS (SELECT o_custkey AS contract, sum(o_totalprice::DECIMAL(18, 2)) * (CASE WHEN o_custkey % 2 = 0 THEN 0.9 ELSE 1.0 END)::DECIMAL(2, 1) AS value FROM orders GROUP BY o_custkey)
        SELECT claim_id, prior + amount <= value + 0.01 AS ok, ((prior + amount) * 10000)::BIGINT AS cumulative, ((value - prior) * 10000)::BIGINT AS remaining FROM h JOIN c USING (contract)""",
    "payment_sequence": f"""WITH {HISTORY}, n AS (SELECT claim_id, prior_count, prior_count + 1 - CASE WHEN claim_id % 9 = 0 THEN 1 ELSE 0 END + CASE WHEN claim_id % 11 = 0 THEN 2 ELSE 0 END AS no FROM h)
        SELECT claim_id, no AS payment_no, prior_count, CASE WHEN no >= 1 THEN no > prior_count END AS not_disbursed, CASE WHEN no >= 1 AND no <= prior_count THEN NULL ELSE no = prior_count + 1 END AS in_sequence FROM n""",
    "identity_consistent": """WITH p AS (SELECT s_nationkey AS claim_id, '10' || lpad((s_nationkey * 7 + CASE WHEN s_suppkey % 41 = 0 THEN 1 ELSE 0 END)::VARCHAR, 8, '0') AS v FROM supplier)
        SELECT claim_id, 'cr_number' AS field, count(*) AS n, count(DISTINCT v) AS n_values, count(DISTINCT v) = 1 AS ok FROM p GROUP BY claim_id HAVING count(*) >= 2""",
    "majority_vote": """WITH s AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events WHERE event_type IS NOT NULL GROUP BY ALL)
        SELECT user_id, event_type AS value, n AS support FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n < 2, first) = 1""",
    "merge_reads": """WITH t AS (SELECT conv_id, turn, min(CASE WHEN turn % 2 = 0 THEN '' ELSE role END) AS role, min(text) AS text FROM conversations GROUP BY ALL)
        SELECT conv_id, arg_min(role, turn) FILTER (role != '') AS role, arg_min(text, turn) FILTER (text != '') AS text FROM t GROUP BY conv_id""",
    "dedupe_exact": "SELECT min(doc_id) AS doc_id, lang, length(text) AS n FROM documents GROUP BY text, lang",
    "dedupe_ranked": """WITH p AS (SELECT p_brand AS claim_id, p_partkey AS pos, (p_partkey % 13)::VARCHAR AS item_code, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS description, CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE p_retailprice END AS unit_price FROM part)
        SELECT claim_id, item_code, pos, min(pos) OVER (PARTITION BY claim_id, item_code) AS first_pos, description, unit_price FROM p
        QUALIFY row_number() OVER (PARTITION BY claim_id, item_code ORDER BY CASE WHEN description != '' AND unit_price != 0 THEN 0 WHEN description != '' THEN 1 ELSE 2 END, pos) = 1""",
    "consistency_flags": """WITH o AS (SELECT o_orderkey AS k, o_totalprice AS net, CASE WHEN o_orderkey % 35 = 0 THEN 0.0::DOUBLE ELSE o_totalprice * (CASE WHEN o_orderkey % 5 = 0 THEN 0.14 ELSE 0.15 END)::DOUBLE END AS vat, CASE WHEN o_orderkey % 7 = 0 THEN 0.0::DOUBLE ELSE o_totalprice + o_orderkey % 3 END AS s FROM orders),
        t AS (SELECT *, net + vat - vat AS n FROM o),
        c AS (SELECT *, CASE WHEN s > 0 AND n > 0 THEN abs(s - n) <= 1.0 END AS a, CASE WHEN vat > 0 AND n > 0 THEN abs(vat - 0.15::DOUBLE * n) <= greatest(1.0::DOUBLE, 0.001::DOUBLE * n) END AS b FROM t)
        SELECT k AS o_orderkey, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a, true) AND coalesce(b, true) END AS consistent FROM c""",
    "canonical_codes": """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN lower(p_brand) || '.1' ELSE (p_partkey % 30)::VARCHAR || '.' || (p_size % 7)::VARCHAR END AS code, regexp_replace(p_retailprice::VARCHAR, '\\.0$', '') AS as_text FROM part""",
    "near_pairs": """WITH s AS (SELECT s_suppkey, s_nationkey, 'S' || lpad((s_suppkey * 37 % 1000)::VARCHAR, 4, '0') AS no FROM supplier)
        SELECT a.s_suppkey, b.s_suppkey AS other, a.no, b.no AS no2 FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey
        WHERE a.no != b.no AND (damerau_levenshtein(a.no, b.no) = 1 OR (abs(length(a.no) - length(b.no)) <= 2 AND regexp_replace(a.no, '0+', '0', 'g') = regexp_replace(b.no, '0+', '0', 'g')))""",
    "bidi_variants": """WITH o AS (SELECT o_orderkey AS k, year(o_orderdate)::VARCHAR AS y FROM orders)
        SELECT k AS o_orderkey, array_to_string(list_sort(['INV-' || y || '-' || k, k || '-' || y || '-INV']), '|') AS variants, '%' || (k % 40)::VARCHAR || '.5' AS percent, (k % 90)::VARCHAR || [',50', '.505', ',5'][1 + k % 3] AS amount FROM o""",
    "doc_key_heuristic": "SELECT page_id, ['commercial registration', 'zakat certificate', 'gosi certificate', 'boq', 'award letter', 'other', 'commercial registration', 'contract'][1 + page_id % 8] AS doc_key FROM pages",
    "clause_period": "SELECT doc_id, ['week', '', 'day', 'day', 'week', '', 'day', 'week'][1 + doc_id % 8] AS per FROM documents",
    "parse_dates": """WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d FROM orders), p AS (SELECT k, d, CASE WHEN k % 5 < 3 THEN d END AS parsed FROM o)
        SELECT k AS o_orderkey, strftime(parsed, '%Y-%m-%d') AS parsed, CASE WHEN day(parsed) <= 12 THEN strftime(parsed, '%Y-%d-%m') END AS swapped,
        CASE k % 5 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN 'on ' || strftime(d, '%d/%m/%Y') || '.' WHEN 2 THEN strftime(d, '%Y-%m-%d') WHEN 3 THEN '2026-02-31' ELSE 'soon' END AS normalized FROM p""",
    "identifier_keys": """SELECT c_custkey, upper(regexp_replace(c_name, '[^0-9A-Za-z]+', '', 'g')) AS ident, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits,
        regexp_full_match('3' || regexp_replace(c_name, '[^0-9]', '', 'g') || '00003', '3[0-9]{13}3') AS vat_ok FROM customer""",
    "digit_runs": r"""WITH d AS (SELECT doc_id, concat_ws(' ', n_chars, source, text) AS t FROM documents), r AS (SELECT doc_id, t, regexp_extract_all(t, '[0-9]+') AS runs FROM d)
        SELECT doc_id, array_to_string(runs[1:1000], ',') AS runs, array_to_string(list_sort(runs), ',') AS bag, len(regexp_extract_all(t, '[0-9]{4,}')) >= 3 AS usable FROM r""",
    "bounded_search": "SELECT doc_id, doc_id % 2 = 0 AS found, true AS runs FROM documents",
    "tlv_roundtrip": """SELECT o_orderkey AS id, true AS valid, 'Vendor ' || o_orderkey % 100 AS seller, '3' || lpad(o_orderkey::VARCHAR, 13, '0') || '3' AS vat_number,
        printf('%.2f', o_totalprice + CASE WHEN o_orderkey % 16 = 0 THEN 10 ELSE 0 END) AS total, o_orderkey % 16 != 0 AS total_matches, true AS date_matches, 'absent' AS status FROM orders""",
    "qr_summary": """WITH c AS (SELECT o_orderkey AS k, o_totalprice AS t, o_orderdate AS d, printf('%.2f', o_totalprice + CASE WHEN o_orderkey % 16 = 0 THEN 10 ELSE 0 END) AS said, '3' || lpad(o_orderkey::VARCHAR, 13, '0') || '3' AS v FROM orders)
        SELECT k AS id, 'seller_name' AS field, 'Vendor ' || k % 100 AS decoded, true AS match, 'absent' AS status FROM c UNION ALL SELECT k, 'vat_number', v, CASE WHEN k % 5 != 0 THEN true END, 'absent' FROM c
        UNION ALL SELECT k, 'timestamp', strftime(d, '%Y-%m-%dT%H:%M:%SZ'), true, 'absent' FROM c UNION ALL SELECT k, 'total', said, k % 16 != 0, 'absent' FROM c UNION ALL SELECT k, 'vat', '0.00', true, 'absent' FROM c""",
    "classify_attachments": """SELECT doc_id AS pos, CASE WHEN doc_id % 4 = 0 THEN 'boq' ELSE ['zakat certificate', 'other', 'commercial registration'][1 + doc_id % 3] END AS doc_key, CASE WHEN doc_id % 4 = 0 THEN 'reader' ELSE 'name' END AS "by",
        CASE WHEN doc_id % 4 = 0 THEN 'Bill of Quantities' ELSE ['Zakat certificate', 'other', 'Commercial registration'][1 + doc_id % 3] END AS label FROM documents""",
    "attachment_keys": """WITH k AS (SELECT doc_id % 70 AS id, ['boq', 'award letter', 'other', 'zakat certificate'][1 + (doc_id * 13 % 97) % 4] AS v FROM documents),
        a AS (SELECT id, v FROM k WHERE v != 'other' UNION SELECT doc_id % 70, unnest(['contract', 'boq']) FROM documents WHERE doc_id % 9 = 0) SELECT id, string_agg(v, ',' ORDER BY v) AS keys FROM a GROUP BY id""",
    "detected_from_raw": """SELECT doc_id AS id, 0 AS ord, 'boq' AS doc_key, 0 AS page, 'cr_number' AS names, doc_id::VARCHAR AS cr_number FROM documents WHERE doc_id % 5 != 0 UNION ALL SELECT doc_id, 3, 'contract', 3, '', NULL FROM documents WHERE doc_id % 5 != 0""",
    "polygons": """SELECT doc_id, (doc_id % 9)::INTEGER AS page, doc_id % 50 + 2.0::DOUBLE AS x, n_chars % 70 + 1.0::DOUBLE AS y, (doc_id % 50) / 8.0::DOUBLE AS "left", (n_chars % 70) / 16.0::DOUBLE AS "top" FROM documents""",
    "layout_rows": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(0, ceil(len(w) / 25.0)::BIGINT)) AS k FROM d WHERE doc_id % 11 != 0),
        i AS (SELECT doc_id, k, unnest(w[k * 25 + 1:k * 25 + 25]) AS content, unnest(range(0, len(w[k * 25 + 1:k * 25 + 25]))) AS idx FROM p)
        SELECT doc_id, NULL::INTEGER AS page, 'answer' AS kind, NULL::INTEGER AS idx, NULL AS content, NULL::DOUBLE AS x, NULL::DOUBLE AS y, NULL::DOUBLE AS "left", NULL::DOUBLE AS top, CASE WHEN doc_id % 11 = 0 THEN 'not JSON' ELSE 'no pages' END AS error FROM d WHERE doc_id % 11 = 0 OR len(w) = 0
        UNION ALL SELECT doc_id, k + 1, 'page', NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN k % 4 = 2 THEN 'no size' END FROM p
        UNION ALL SELECT doc_id, k + 1, 'word', idx, content, CASE WHEN idx % 7 != 3 THEN (idx % 5 + 9) / 2.0::DOUBLE END, CASE WHEN idx % 7 != 3 THEN (idx // 5 + 9) / 2.0::DOUBLE END,
            CASE WHEN idx % 7 != 3 AND k % 4 != 2 THEN (idx % 5) / 10.0::DOUBLE END, CASE WHEN idx % 7 != 3 THEN (idx // 5) / 20.0::DOUBLE END, CASE WHEN idx % 7 = 3 THEN 'no polygon' END FROM i""",
    "file_index": "SELECT o_orderkey, [2, 1, -1][1 + o_orderkey % 3]::INTEGER AS place FROM orders",
    "key_field_override": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 OR c_custkey % 2 = 0 OR c_custkey % 3 != 1 THEN c_name ELSE 'other 5' END AS value FROM customer",
    "evidence_flatten": "SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
    "scan_order": """WITH d AS (SELECT doc_id, (n_chars % 40 + 1) AS n, greatest(least(doc_id % 45, n_chars % 40 + 1), 1) AS p FROM documents), x AS (SELECT doc_id, p, unnest(range(1, n + 1)) AS q FROM d),
        y AS (SELECT doc_id, q, row_number() OVER (PARTITION BY doc_id ORDER BY abs(q - p), q > p) AS i FROM x) SELECT doc_id, string_agg(q::VARCHAR, ',' ORDER BY i) AS pages FROM y WHERE i <= 3 GROUP BY doc_id""",
    "upsert_latest": "SELECT user_id AS id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, min(event_id) AS created, max(event_id) AS updated FROM events GROUP BY user_id",
    "gates_due": """WITH a AS (SELECT DISTINCT user_id::VARCHAR AS id, ts, ['invoice', 'contract_boq', 'coc', 'delivery_note', 'other', 'invoice'][1 + (event_id * 7 + user_id) % 6] AS slot, event_type AS path FROM events),
        b AS (SELECT *, lag(path) OVER (PARTITION BY id, slot ORDER BY ts, path) AS old, bool_or(slot = 'invoice') OVER w AS g1, bool_or(slot = 'contract_boq') OVER w AS g2, bool_or(slot IN ('coc', 'delivery_note')) OVER w AS g3
            FROM a WINDOW w AS (PARTITION BY id ORDER BY ts, slot, path ROWS UNBOUNDED PRECEDING)),
        c AS (SELECT *, CASE slot WHEN 'invoice' THEN 1 WHEN 'contract_boq' THEN 2 WHEN 'other' THEN NULL ELSE 3 END AS f, CASE WHEN g1 AND g2 AND g3 THEN 5 WHEN g1 AND g2 THEN 2 WHEN g1 THEN 1 ELSE 0 END AS l FROM b)
        SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS "at", slot, path, f::INTEGER AS first_gate, l::INTEGER AS last_gate FROM c WHERE old IS DISTINCT FROM path AND f <= l""",
    "point_lookup": """WITH e AS (SELECT user_id AS id, arg_max(event_type, event_id) AS label FROM events GROUP BY user_id), i AS (SELECT DISTINCT o_custkey AS id FROM orders)
        SELECT i.id, CASE WHEN e.id IS NOT NULL THEN 'submitted' WHEN c_custkey IS NOT NULL THEN 'erp' END AS origin, CASE WHEN e.id IS NOT NULL THEN e.label ELSE c_mktsegment END AS label, coalesce(s_nationkey % 6, 0)::INTEGER AS step, p_brand AS verdict
        FROM i LEFT JOIN e USING (id) LEFT JOIN customer ON c_custkey = i.id LEFT JOIN supplier ON s_suppkey = i.id LEFT JOIN part ON p_partkey = i.id""",
    "next_id": "SELECT 'VRM-' || (coalesce(max(900000 + o_orderkey), 900000) + 1) AS next_id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey < 100000",
    "list_annotated": """WITH s AS (SELECT o_orderkey * 2 AS id, 'submitted' AS origin FROM orders), c AS (SELECT c_custkey * 3 AS id, 'erp' AS origin FROM customer WHERE c_custkey * 3 NOT IN (SELECT id FROM s)),
        b AS (SELECT * FROM s UNION ALL SELECT * FROM c)
        SELECT b.id, origin, coalesce(o_orderkey % 7, 0) AS step, c_mktsegment AS verdict FROM b LEFT JOIN orders ON o_orderkey * 2 = b.id AND o_orderkey % 5 = 0 LEFT JOIN customer ON c_custkey * 3 = b.id AND c_custkey % 4 = 0""",
    "available_claims": "SELECT l_orderkey AS id FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 3 != 0))",
    "slot_replacement": """WITH t AS (SELECT conv_id AS id, turn, min(text) AS path FROM conversations GROUP BY ALL), f AS (SELECT id, ['invoice', 'coc', 'other'][1 + turn % 3] AS slot, min(length(path))::VARCHAR AS path FROM t GROUP BY ALL),
        n AS (SELECT id, 'delivery_note' AS slot, 'new' AS path FROM f WHERE id % 3 = 0 AND slot = 'invoice') SELECT * FROM f WHERE NOT (slot IN ('coc', 'delivery_note') AND id IN (SELECT id FROM n)) UNION ALL SELECT * FROM n""",
    "partial_update": "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'changed' ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN 'S' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "export_manifest": """WITH f AS (SELECT doc_id % 50 AS id, doc_id AS pos, [1, 3, 2, 9][1 + doc_id % 4] AS rank, source || '.pdf' AS name FROM documents), e AS (SELECT *, CASE WHEN rank = 2 THEN name ELSE id || '_' || name END AS entry FROM f),
        n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, pos) AS place, row_number() OVER (PARTITION BY id, entry ORDER BY rank, pos) AS nth FROM e)
        SELECT id, place, CASE WHEN nth = 1 THEN entry ELSE replace(entry, '.pdf', '_' || (place - 1) || '.pdf') END AS entry FROM n""",
    "page_units": """WITH d AS (SELECT doc_id, (n_chars % 60)::INTEGER AS n FROM documents WHERE n_chars % 60 > 0), u AS (SELECT doc_id, n, unnest(range(0, n, 5))::INTEGER AS o FROM d)
        SELECT doc_id, (o // 5)::INTEGER AS unit, o AS "offset", least(5, n - o)::INTEGER AS n_unit_pages, ceil(n / 5.0)::INTEGER AS n_units FROM u""",
    "unit_passes": """WITH d AS (SELECT doc_id, (n_chars % 12)::INTEGER AS n FROM documents), u AS (SELECT doc_id, n, unnest(range(0, n, 5))::INTEGER AS o FROM d)
        SELECT doc_id, (o // 5)::INTEGER AS unit, unnest(range(1, CASE WHEN n - o <= 2 THEN 3 ELSE 2 END))::INTEGER AS pass FROM u""",
    "page_spec": """WITH d AS (SELECT doc_id, n_chars % 20 + 1 AS n FROM documents), p AS (SELECT doc_id, n, CASE doc_id % 5 WHEN 0 THEN [1, 2, 3, 7] WHEN 1 THEN range(5, n + 1) WHEN 2 THEN [1, 2] WHEN 3 THEN range(40, n + 1) ELSE [] END AS a FROM d)
        SELECT doc_id, array_to_string(list_filter(a, lambda x: x <= n), ',') AS pages FROM p""",
    "content_digest": "SELECT doc_id, sha256(text || chr(0) || lang || chr(0) || 'v1') AS digest FROM documents",
    "cache_misses": "SELECT sha1(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY text HAVING bool_and(doc_id % 2 != 0)",
    "text_vs_scan_routing": "SELECT doc_id, CASE WHEN length(trim(text)) >= 200 THEN 'text' ELSE 'image' END AS route FROM documents",
    "doc_survey": """WITH c AS (SELECT conv_id AS doc_id, turn + 1 AS page, min(text) AS text FROM conversations GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_pages FROM c),
        s AS (SELECT doc_id, n_pages, avg(CASE WHEN length(trim(text)) >= 200 THEN 1.0 ELSE 0.0 END) AS text_share FROM n WHERE (page - 1) % greatest(ceil(n_pages / 12.0)::INTEGER, 1) = 0 GROUP BY ALL)
        SELECT doc_id, n_pages, text_share, floor(n_pages * (text_share * 900 + (1 - text_share) * 1400))::BIGINT AS tokens FROM s""",
    "ext_event_windows": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "ext_sessions": """WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) SELECT user_id, count(*) FILTER (gap IS NULL OR gap >= INTERVAL 30 MINUTE) AS sessions, count(*) AS events FROM e GROUP BY user_id""",
    "validated_reads": """WITH o AS (SELECT *, floor(o_totalprice)::DOUBLE AS b FROM orders)
        SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, 12 AS page,
            CASE WHEN o_orderkey % 2 = 0 THEN '7.1' ELSE (o_orderkey % 40)::VARCHAR || ',7.1' END AS codes,
            round(CASE WHEN o_orderkey % 3 = 2 THEN round(b / 1.15, 2) ELSE b END, 2) AS base, round(CASE WHEN o_orderkey % 3 = 2 THEN b ELSE b * 1.15 END, 2) AS total FROM o""",
    "value_digits": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE ltrim(floor(round(o_totalprice, 2))::BIGINT::VARCHAR, '0') END AS digits FROM orders",
    "unused_files": """WITH d AS (SELECT doc_id % 90 AS claim_id, 'up/' || doc_id % 630 AS path, doc_id % 3 = 0 OR doc_id % 7 = 0 AS kept FROM documents)
        SELECT DISTINCT claim_id, path FROM d WHERE NOT kept AND (claim_id, path) NOT IN (SELECT (claim_id, path) FROM d WHERE kept)""",
    "line_totals": "SELECT l_orderkey AS claim_id, (sum(l_extendedprice::DECIMAL(18, 4)::DECIMAL(18, 2) * l_quantity::DECIMAL(18, 2)) * 10000)::BIGINT AS total FROM lineitem GROUP BY l_orderkey",
    "usage_totals": "SELECT count(*) AS calls, round(sum(l_quantity::DECIMAL(18, 4)), 1)::DOUBLE AS l_quantity, round(sum(l_extendedprice::DECIMAL(18, 4)), 1)::DOUBLE AS l_extendedprice FROM lineitem",
    "deduction_rows": f"WITH {PAIRS} SELECT status, count(*) AS n FROM p GROUP BY status UNION ALL SELECT 'deduction', count(*) FROM inv WHERE quantity < 0 HAVING count(*) > 0",
    "locate_ladder": LOCATE_LADDER,
    "locate_amounts": LOCATE_AMOUNTS,
    "locate_words": LOCATE_WORDS,
    "fuzzy_run": FUZZY_RUN,
    "consensus_reads": CONSENSUS_READS,
}
