"""Verification of ECDSA signatures, for invoice codes that carry one. Affine arithmetic with Python's integers."""

from __future__ import annotations

from dataclasses import dataclass

Point = tuple[int, int] | None


@dataclass(frozen=True)
class Curve:
    """y^2 = x^3 + a x + b modulo p; base point g of order n."""

    name: str
    p: int
    a: int
    b: int
    g: tuple[int, int]
    n: int


# The two curves in use, and object identifiers in DER.
SECP256K1 = Curve(
    "secp256k1", 2**256 - 2**32 - 977, 0, 7,
    (0x79BE667EF9DCBBAC55A06295CE870B07029BFCDB2DCE28D959F2815B16F81798, 0x483ADA7726A3C4655DA4FBFC0E1108A8FD17B448A68554199C47D08FFB10D4B8),
    0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEBAAEDCE6AF48A03BBFD25E8CD0364141,
)
P256 = Curve(
    "P-256", 2**256 - 2**224 + 2**192 + 2**96 - 1, -3, 0x5AC635D8AA3A93E7B3EBBD55769886BC651D06B0CC53B0F63BCE3C3E27D2604B,
    (0x6B17D1F2E12C4247F8BCE6E563A440F277037D812DEB33A0F4A13945D898C296, 0x4FE342E2FE1A7F9B8EE7EB4A7C0F9E162BCE33576B315ECECBB6406837BF51F5),
    0xFFFFFFFF00000000FFFFFFFFFFFFFFFFBCE6FAADA7179E84F3B9CAC2FC632551,
)
EC_KEY = bytes.fromhex("2a8648ce3d0201")
CURVES = {bytes.fromhex("2b8104000a"): SECP256K1, bytes.fromhex("2a8648ce3d030107"): P256}


def add(c: Curve, s: Point, t: Point) -> Point:
    if s is None or t is None:
        return t if s is None else s
    if s[0] == t[0]:
        if (s[1] + t[1]) % c.p == 0:
            return None
        slope = (3 * s[0] * s[0] + c.a) * pow(2 * s[1], -1, c.p)
    else:
        slope = (t[1] - s[1]) * pow(t[0] - s[0], -1, c.p)
    x = (slope * slope - s[0] - t[0]) % c.p
    return x, (slope * (s[0] - x) - s[1]) % c.p


def times(c: Curve, k: int, s: Point) -> Point:
    out = None
    for bit in bin(k)[2:]:
        out = add(c, out, out)
        if bit == "1":
            out = add(c, out, s)
    return out


def on_curve(c: Curve, s: tuple[int, int]) -> bool:
    x, y = s
    return 0 <= x < c.p and 0 <= y < c.p and (y * y - x * x * x - c.a * x - c.b) % c.p == 0


def der(data: bytes) -> list[tuple[int, bytes]]:
    """Tags and contents of DER elements that lie side by side; ValueError if they are cut off."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            raise ValueError("cut off")
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 128:
            more = size - 128
            size, at = int.from_bytes(data[at : at + more], "big"), at + more
        if at + size > len(data):
            raise ValueError("cut off")
        out.append((tag, data[at : at + size]))
        at += size
    return out


def public_key(data: bytes) -> tuple[Curve, tuple[int, int]]:
    """A key as DER with its curve, or an uncompressed point on secp256k1; ValueError if it is neither."""
    curve, point = SECP256K1, data
    if data[:1] == b"\x30":
        try:
            (_, body), = der(data)
            (_, kind), (_, bits) = der(body)
            (_, key), (_, name) = der(kind)
        except ValueError as error:
            raise ValueError("not a public key") from error
        if key != EC_KEY or name not in CURVES or bits[:1] != b"\0":
            raise ValueError("not a key on a known curve")
        curve, point = CURVES[name], bits[1:]
    if len(point) != 65 or point[0] != 4:
        raise ValueError("not an uncompressed point")
    xy = int.from_bytes(point[1:33], "big"), int.from_bytes(point[33:], "big")
    if not on_curve(curve, xy):
        raise ValueError("not on the curve")
    return curve, xy


def signature(data: bytes) -> tuple[int, int]:
    """r and s of 64 plain bytes or a DER pair; ValueError if it is neither."""
    if len(data) == 64:
        return int.from_bytes(data[:32], "big"), int.from_bytes(data[32:], "big")
    (tag, body), = der(data)
    (first, r), (second, s) = der(body)
    if (tag, first, second) != (0x30, 2, 2):
        raise ValueError("not a pair of numbers")
    return int.from_bytes(r, "big"), int.from_bytes(s, "big")


def verify(c: Curve, key: tuple[int, int], digest: bytes, r: int, s: int) -> bool:
    if not (0 < r < c.n and 0 < s < c.n):
        return False
    z, w = int.from_bytes(digest[:32], "big"), pow(s, -1, c.n)
    found = add(c, times(c, z * w % c.n, c.g), times(c, r * w % c.n, key))
    return found is not None and found[0] % c.n == r
