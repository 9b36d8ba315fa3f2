"""Examples of the scalar functions."""

import base64
import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from auditspark.functions import codes, curves, dates, text
from auditspark.functions.similarity import strength
from auditspark.operators import witness
from auditspark.sources import documents as docs


def one(spark, make, *values):
    """The value of an expression over literal columns."""
    return spark.range(1).select(make(*[F.lit(v) for v in values]).alias("v")).first()["v"]


@pytest.mark.parametrize("given, want", [("10.10", "10.1"), ("OF-101", "of-101"), ("2.1.1", "2.1.1"), ("٣٥", "35"), (" 06.10", "6.1"), ("5.0", "5.0"), (None, "")])
def test_canonical_code(spark, given, want):
    assert one(spark, lambda v: text.canonical_code(v.cast("string")), given) == want


@pytest.mark.parametrize("given, want", [("2026-07-12", 12), ("12-07-2026", 12), ("12/07/2026", 12), ("٢٠٢٦-٠٧-١٢", 12), ("at 2026-07-12T10:00", 12), ("prose", None), ("", None), ("2026-02-31", None)])
def test_parse_date(spark, given, want):
    assert one(spark, dates.parse_date, given) == (datetime.date(2026, 7, want) if want else None)


@pytest.mark.parametrize("given, want", [("12-07-2026", "2026-07-12"), ("2026-7-2", "2026-07-02"), ("1447/01/15", "1447-01-15"), ("soon", "soon"), ("40-40-2026", "40-40-2026")])
def test_normalize_date(spark, given, want):
    assert one(spark, dates.normalize_date, given) == want


@pytest.mark.parametrize("given, want", [("1% every 7 days", "week"), ("every 30 days", ""), ("each day" , ""), ("per day", "day"), ("كل ٧ أيام", "week"), ("غرامة يومية", "day"), ("10% of the value", "")])
def test_clause_period(spark, given, want):
    assert one(spark, text.clause_period, given) == want


@pytest.mark.parametrize("a, b, want", [("310122393500003", "310122395300003", True), ("1850", "1580", True), ("66000", "6600", True), ("2300000", "23000", True), ("120", "120", False), ("1234", "1256", False), ("1234", "4321", False)])
def test_near(spark, a, b, want):
    assert one(spark, text.near, a, b) is want


@pytest.mark.parametrize("given, want", [("310122393500003", True), ("410122393500003", False), ("310122393500001", False), ("3101", False), ("", False)])
def test_vat_number(spark, given, want):
    assert one(spark, text.vat_number_ok, given) is want


@pytest.mark.parametrize("given, want", [("vendor C.R 2026.pdf", "commercial registration"), ("scrap.pdf", "other"), ("Zakat.pdf", "zakat certificate"), ("عقد.pdf", "contract"), (None, "other")])
def test_doc_key(spark, given, want):
    assert one(spark, lambda v: text.doc_key(v.cast("string")), given) == want


def test_bidi_and_ident(spark):
    assert one(spark, text.bidi_variants, "INV-2026-7") == ["INV-2026-7", "7-2026-INV"]
    assert one(spark, text.ident_key, "inv/٢٠٢٦/00070") == "INV202600070"


def test_name_key_folds_forms(spark):
    assert one(spark, text.name_key, "شركة الأُمّة،  ＡＢＣ") == "شركه الامه abc"


def test_bounded(spark):
    assert one(spark, text.bounded_in, "total 89.9 SAR", "89.9") is True
    assert one(spark, text.bounded_in, "total 189.95 SAR", "89.9") is False
    assert one(spark, text.contains_identifier, "no INV 2026 0342.", "INV-2026-0342") is True
    assert one(spark, text.contains_identifier, "no INV 2026 0342.", "INV-2026-004") is False


def test_witness_text(spark):
    assert one(spark, text.witness_text, "66,000.00  ٢٬٥٠٠") == "66000.00 2500"
    assert one(spark, text.witness_text, "2,50%") == "2,50%"


def test_amount_repair(spark):
    page = "invoice 20261234 account 99887766 phone 55443322 total 230,000.00"
    always = lambda v: F.lit(True)
    fix = lambda v: witness.repair_amount(F.lit(page), v, always)
    assert one(spark, fix, 2300000.0) == 230000.0
    assert one(spark, fix, 230000.0) == 230000.0
    assert one(spark, fix, 511111.0) == 511111.0
    assert one(spark, lambda v: witness.repair_amount(F.lit("no digits"), v, always), 2300000.0) == 2300000.0


def test_contract_repair(spark):
    page = "contract 20261234 dated 20260101 reference 99887766 value 14,950,000.00"
    both = spark.range(1).select(F.struct(*[v.alias(n) for n, v in zip("bt", witness.repair_contract(F.lit(page), F.lit(4950000.0), F.lit(4950000.0)))]).alias("v")).first()["v"]
    assert both["t"] == 14950000.0 and both["b"] == 13000000.0


def test_contract_repair_of_one_side(spark):
    """The total lost a digit while the base is the printed figure; a base is put right by its total; a pair that fits stays."""
    page = "contract 20261234 dated 20260101 reference 99887766 value 14,950,000.00 net 13,000,000.00"
    pair = lambda b, t: tuple(spark.range(1).select(*witness.repair_contract(F.lit(page), F.lit(b), F.lit(t))).first())
    assert pair(14950000.0, 4950000.0) == (13000000.0, 14950000.0)
    assert pair(1300000.0, 14950000.0) == (13000000.0, 14950000.0)
    assert pair(13000000.0, 14950000.0) == (13000000.0, 14950000.0)
    assert pair(0.0, 1495000.0) == (0.0, 14950000.0) and pair(7.0, 8.0) == (7.0, 8.0)


def test_line_repair(spark):
    page = "invoice 20261234 account 99887766 reference 55443322 lines 10 x 1,500.00 = 15,000.00 and 3 x 20.50 = 61.50"
    lines = [(1, 10.0, 1500.0, 150000.0), (2, 10.0, 150.0, 15000.0), (3, 3.0, 20.5, 61.5), (4, 10.0, 15.0, 1500000.0), (5, 3.0, 20.5, None)]
    frame = spark.createDataFrame([(*x, page) for x in lines] + [(6, 10.0, 1500.0, 150000.0, "no digits")], "i int, quantity double, unit_price double, amount double, page_text string")
    got = {r["i"]: (r["quantity"], r["unit_price"], r["amount"]) for r in witness.repair_lines(frame).collect()}
    assert got == {1: (10.0, 1500.0, 15000.0), 2: (10.0, 1500.0, 15000.0), 3: (3.0, 20.5, 61.5), 4: (10.0, 15.0, 1500000.0), 5: (3.0, 20.5, None), 6: (10.0, 1500.0, 150000.0)}


def test_strength():
    assert strength("", "a") == 0 and strength("a b", "a b") == 1
    assert strength("supply of office chairs", "supply of office chairs with arms and a head rest, all colours") == 0.95
    assert 0 < strength("chair", "chalk") < 1


def test_tlv(spark):
    good = codes.encode({1: "مؤسسة", 2: "310122393500003", 3: "2026-01-01", 4: "1150.00", 5: "150.00"})
    long = codes.encode({1: "a", 1 + 8: "x", 2: "b", 3: "c", 4: "d", 5: "e"})
    rows = spark.createDataFrame([(good,), (good[:-4],), ("AQI",), ("%%",), ("",), (None,), (long,)], "p string").select(codes.tlv(F.col("p")).alias("q")).collect()
    assert [r["q"]["valid"] for r in rows] == [True, False, False, False, False, False, True]
    assert rows[0]["q"]["fields"]["seller_name"] == "مؤسسة"
    assert codes.phase2_status(dict(rows[0]["q"]["tags"])) == "absent"
    assert codes.phase2_status({6: b"short", 7: b"x", 8: b"y"}) == "pseudo"


def test_page_spec(spark):
    spec = lambda s, n: one(spark, lambda a, b: docs.page_spec(a, b), s, n)
    assert spec("1-3,7,9-", 10) == [1, 2, 3, 7, 9, 10]
    assert spec("5-2, x", 4) == [1] or spec("5-2", 4) == []
    assert spec("", 4) == []


def _sign(c, secret, digest, k=987654321):
    r = curves.times(c, k, c.g)[0] % c.n
    return r, pow(k, -1, c.n) * (int.from_bytes(digest, "big") + r * secret) % c.n


def _der_key(c, point):
    name = next(k for k, v in curves.CURVES.items() if v is c)
    wrap = lambda tag, body: bytes([tag, len(body)]) + body
    bits = b"\0\x04" + point[0].to_bytes(32, "big") + point[1].to_bytes(32, "big")
    return wrap(0x30, wrap(0x30, wrap(6, curves.EC_KEY) + wrap(6, name)) + wrap(3, bits))


@pytest.mark.parametrize("c", [curves.SECP256K1, curves.P256], ids=lambda c: c.name)
def test_signatures(c):
    assert curves.on_curve(c, c.g) and curves.times(c, c.n, c.g) is None
    secret, digest = 123456789, hashlib.sha256(b"invoice").digest()
    key = _der_key(c, curves.times(c, secret, c.g))
    pack = lambda pair: b"".join(x.to_bytes(32, "big") for x in pair)
    text = base64.b64encode(digest)
    status = lambda d, s, k=key: codes.phase2_status({6: d, 7: s, 8: k, 9: b"stamp"})
    assert status(digest, pack(_sign(c, secret, digest))) == "valid"
    assert status(text, base64.b64encode(pack(_sign(c, secret, hashlib.sha256(digest).digest())))) == "valid"
    assert status(text, pack(_sign(c, secret, hashlib.sha256(text).digest()))) == "valid"
    assert status(hashlib.sha256(b"other").digest(), pack(_sign(c, secret, digest))) == "invalid_signature"
    assert status(digest.hex().encode(), pack(_sign(c, secret, digest))) == "pseudo"
    assert status(digest, b"short") == "pseudo" and status(digest, pack(_sign(c, secret, digest)), b"8f2a1c34-uuid") == "pseudo"
    r, s = _sign(c, secret, digest)
    number = lambda v: (lambda b: bytes([2, len(b)]) + b)(v.to_bytes(33, "big").lstrip(b"\0") if v >> 255 == 0 else v.to_bytes(33, "big"))
    body = number(r) + number(s)
    assert status(digest, bytes([0x30, len(body)]) + body) == "valid"
    assert curves.public_key(b"\x04" + pack(curves.SECP256K1.g))[0] is curves.SECP256K1
