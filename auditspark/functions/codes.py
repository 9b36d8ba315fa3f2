"""Tag-length-value payloads of invoice codes."""

from __future__ import annotations

import base64
import binascii
import hashlib
import re

import pyarrow as pa
from pyspark.sql import functions as F

from . import curves

# Tags of the first phase, all needed, and of the second.
FIRST_TAGS = {1: "seller_name", 2: "vat_number", 3: "timestamp", 4: "total", 5: "vat"}
SECOND_TAGS = {6: "invoice_hash", 7: "signature", 8: "public_key", 9: "stamp"}

TYPE = "struct<valid: boolean, fields: map<string, string>, tags: map<int, binary>, error: string>"


def walk(raw: bytes) -> tuple[list[tuple[int, bytes]], str]:
    """Tags with values, and what is wrong at the end, if anything."""
    out, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw):
            return out, "truncated header"
        value = raw[at + 2 : at + 2 + raw[at + 1]]
        if len(value) < raw[at + 1]:
            return out, "truncated value"
        out.append((raw[at], value))
        at += 2 + len(value)
    return out, ""


def decode(payload: str | None) -> tuple[bool, dict, dict, str]:
    """A repeated tag's last value counts, unknown tags are passed over."""
    try:
        raw = base64.b64decode(payload or "", validate=True)
    except (binascii.Error, ValueError):
        return False, {}, {}, "not base64"
    pairs, error = walk(raw)
    fields = {}
    for tag, value in pairs:
        if tag in FIRST_TAGS:
            try:
                fields[FIRST_TAGS[tag]] = value.decode()
            except UnicodeDecodeError:
                return False, fields, dict(pairs), f"tag {tag} is not UTF-8"
    missing = [name for name in FIRST_TAGS.values() if name not in fields]
    error = error or ("missing " + ", ".join(missing) if missing else "")
    return not error, fields, dict(pairs), error


def tlv(payload):
    """Decoded payloads, in Arrow batches."""

    @F.arrow_udf(TYPE)
    def run(payloads: pa.Array) -> pa.Array:
        found = [decode(p) for p in payloads.to_pylist()]
        kinds = (pa.bool_(), pa.map_(pa.string(), pa.string()), pa.map_(pa.int32(), pa.binary()), pa.string())
        columns = [pa.array([list(x[i].items()) if i in (1, 2) else x[i] for x in found], t) for i, t in enumerate(kinds)]
        return pa.StructArray.from_arrays(columns, ["valid", "fields", "tags", "error"])

    return run(payload)


def _bytes(value: bytes) -> bytes:
    """A value printed as base64 text, decoded; others as they are."""
    if re.fullmatch(rb"[A-Za-z0-9+/]+={0,2}", value) and len(value) % 4 == 0:
        try:
            return base64.b64decode(value, validate=True)
        except binascii.Error:
            pass
    return value


def phase2_status(tags: dict[int, bytes] | None) -> str:
    """absent without tags above 5, pseudo where they can't be a hash, a signature and a key, else valid or not.

    Signers differ in what they sign: the hash itself, the hash as a message, or the hash's base64 text as a message.
    """
    tags = tags or {}
    if not any(t in tags for t in SECOND_TAGS):
        return "absent"
    digest, signed = _bytes(tags.get(6, b"")), _bytes(tags.get(7, b""))
    plain = len(signed) == 64 or signed[:1] == b"\x30" and 66 <= len(signed) <= 74
    if len(digest) != 32 or not plain:
        return "pseudo"
    try:
        curve, key = curves.public_key(tags.get(8, b""))
    except ValueError:
        return "pseudo"
    try:
        pair = curves.signature(signed)
    except ValueError:
        return "invalid_signature"
    messages = (digest, hashlib.sha256(digest).digest(), hashlib.sha256(tags[6]).digest())
    return "valid" if any(curves.verify(curve, key, m, *pair) for m in messages) else "invalid_signature"


def phase2(tags):
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([phase2_status(dict(x) if x is not None else None) for x in values.to_pylist()], pa.string())

    return run(tags)


def encode(values: dict[int, str]) -> str:
    """For fixtures: a payload of these tags."""
    return base64.b64encode(b"".join(bytes([t, len(v.encode())]) + v.encode() for t, v in values.items())).decode()
