"""Secret scans: patterns name candidates, decoding and parsing them confirms structure."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import by_bytes, table, text_of

#: Kinds found by their pattern alone, and those that the structure of the decoded bytes
#: confirms: private keys (in hexadecimal, base64 or a text block) and signed tokens.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "private_key", "signed_token")

_ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_BLOCK = re.compile(
    r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----([^-]{16,})-----END \1PRIVATE KEY-----"
)
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
_TOKEN = re.compile(
    r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?!\.?[A-Za-z0-9_-])"
)
_ANY_HEX = re.compile(r"(?:[0-9a-f]{2})+|(?:[0-9A-F]{2})+")
#: A text without these holds no candidate; RE2 looks at each character once.
_ANY = (
    r"(?i:passw|secret|token|api_?key)|AKIA|PRIVATE KEY|[0-9a-f]{32}|[A-Za-z0-9+/_-]{32}"
    r"|[A-Za-z0-9_-]{8}\.[A-Za-z0-9_-]{2,}\."
)

_BATCH = 4 << 20

#: Tags of the encoding rules (fixed values).
_INTEGER, _OCTETS, _OBJECT, _SEQUENCE = 0x02, 0x04, 0x06, 0x30
#: What an OpenSSH private key begins with (fixed value).
_SSH = b"openssh-key-v1\x00"


def _elements(data: bytes, start: int, stop: int, most: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, stop) of the definite-length elements that fill ``data[start:stop]``.

    None if a length is wrong, not in its shortest form, or more than ``most`` follow.
    """
    found = []
    while start < stop:
        if len(found) == most or stop - start < 2:
            return None
        tag, size, at = data[start], data[start + 1], start + 2
        if size & 0x80:
            wide = size & 0x7F
            if not 1 <= wide <= 4 or at + wide > stop:
                return None
            size = int.from_bytes(data[at : at + wide], "big")
            if size < 0x80 or size >> (8 * (wide - 1)) == 0:
                return None
            at += wide
        if at + size > stop:
            return None
        found.append((tag, at, at + size))
        start = at + size
    return found


def is_encoded_key(data: bytes) -> bool:
    """Whether the bytes are one private key in the distinguished encoding.

    A sequence over all bytes, of a version and then: eight numbers or more (RSA), five
    numbers (DSA), the octets of a scalar (elliptic curves), or an algorithm and octets
    that hold the key (PKCS 8); or an algorithm with parameters and octets of cipher text.
    """
    whole = _elements(data, 0, len(data), 1)
    if not whole or whole[0][0] != _SEQUENCE:
        return False
    parts = _elements(data, whole[0][1], whole[0][2], 16)
    if not parts or len(parts) < 2:
        return False
    tags = [t for t, _, _ in parts]

    def algorithm(part: tuple[int, int, int]) -> bool:
        inner = _elements(data, part[1], part[2], 4) if part[0] == _SEQUENCE else None
        return bool(inner) and inner[0][0] == _OBJECT and inner[0][2] > inner[0][1]

    if tags[0] == _SEQUENCE:
        return len(parts) == 2 and tags[1] == _OCTETS and algorithm(parts[0]) and parts[1][2] - parts[1][1] >= 16
    if tags[0] != _INTEGER or parts[0][2] - parts[0][1] != 1:
        return False
    version = data[parts[0][1]]
    numbers = [t == _INTEGER and b > a for t, a, b in parts[1:]]
    if version <= 1 and len(parts) >= 9 and all(numbers[:8]):
        return parts[1][2] - parts[1][1] >= 32
    if version == 0 and len(parts) == 6 and all(numbers):
        return True
    if version == 1 and tags[1] == _OCTETS:
        return 16 <= parts[1][2] - parts[1][1] <= 72 and all(t in (0xA0, 0xA1) for t in tags[2:])
    return version <= 1 and len(parts) >= 3 and algorithm(parts[1]) and tags[2] == _OCTETS and parts[2][2] - parts[2][1] >= 16


def is_ssh_key(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key: strings with their lengths, nested."""
    if not data.startswith(_SSH):
        return False
    at = len(_SSH)

    def string() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    cipher, derivation, options = string(), string(), string()
    if not cipher or not derivation or options is None or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16 or not all(string() for _ in range(keys)):
        return False
    return bool(string()) and at <= len(data)


def _json(text: str) -> dict | None:
    data = from_base64(text)
    try:
        value = json.loads(data.decode()) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def from_base64(text: str) -> bytes | None:
    """The bytes of base64 in either alphabet, padded or not; None where it can't be."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1 or len(text) - len(body) > 2:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    """Whether the header names an algorithm and the parts decode: claims, and a signature
    unless the algorithm is none."""
    names = _json(header)
    if names is None or not isinstance(names.get("alg"), str) or not names["alg"]:
        return False
    if names["alg"].lower() == "none":
        return signature == "" and _json(payload) is not None
    signed = from_base64(signature)
    return signed is not None and len(signed) >= 16 and (_json(payload) is not None or "b64" in names or "zip" in names)


def _is_key(data: bytes | None) -> bool:
    return data is not None and len(data) >= 24 and (is_encoded_key(data) or is_ssh_key(data))


def _key_spans(text: str) -> Iterator[tuple[int, int]]:
    for m in _BLOCK.finditer(text):
        body = m[2].strip()
        if "\n\n" in body:  # headers of an encrypted block end in an empty line
            body = body.split("\n\n", 1)[1]
        if _is_key(from_base64("".join(body.split()))):
            yield m.start(), m.end()
    for m in _RUN.finditer(text):
        run = m[0]
        # 0x30 begins every encoded key; M[A-P] is that byte in base64, 30 in hexadecimal
        if run[0] == "M" or run.startswith("b3BlbnNzaC1r"):
            if _is_key(from_base64(run)):
                yield m.start(), m.end()
        elif run.startswith("30") and _ANY_HEX.fullmatch(run) and _is_key(bytes.fromhex(run)):
            yield m.start(), m.end()


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets, by start and then kind as listed.

    Spans of one kind don't overlap; those of different kinds may. A key inside a text
    block is reported once, as the block.
    """
    found = [
        ("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8
    ]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    stop = 0
    for start, end in sorted(_key_spans(text)):
        if start >= stop:
            found.append(("private_key", start, end))
            stop = end
    found += [
        ("signed_token", m.start(), m.end()) for m in _TOKEN.finditer(text) if is_signed_token(*m.groups())
    ]
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda s: (s[1], rank[s[0]]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans`` of every row: an array of kind, start and end in code points.

    Ordered by start and then kind, ends exclusive. Null and empty texts have none,
    repeated rows and null keys each theirs; empty tables give empty ones, other columns
    are ignored. Texts that can't hold a candidate are told by one Arrow expression;
    the others are scanned whole, in batches of bounded bytes, each pattern in time
    linear in the text.
    """
    source = docs.select(F.col(key).cast("long").alias(key), text_of(F.col(text)).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", _BATCH):
            maybe = pc.match_substring_regex(batch.column("text"), _ANY).to_pylist()
            spans = [
                [dict(zip(("kind", "start", "end"), s)) for s in secret_spans(t.as_py())] if m else []
                for t, m in zip(batch.column("text"), maybe)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(spans, _SPANS)], [key, "spans"])

    return source.mapInArrow(scan, f"{key} long, spans array<struct<kind:string,start:long,end:long>>")


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )
