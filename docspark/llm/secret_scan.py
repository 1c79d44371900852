"""Secret scanning with structural confirmation.

The base kinds (assign, access, hex) are reported by pattern. Beyond them, long
runs of base64 and hex characters are only candidates: a span is added when
decoding and parsing proves what it is.

* ``jwt``: three base64url parts; the first is a JSON object that names an
  algorithm, the second a JSON object.
* ``pkcs``: base64 or hex of an ASN.1 private key (RSA, EC or PKCS#8): every
  nested length must lead exactly to the end, with the fields of that encoding.
* ``openssh``: base64 of an OpenSSH private key whose nested lengths fit.
* ``basic``: base64 after ``Basic`` that decodes to printable user:password.

Every place where a token or key could begin is tried. A run of base64 or hex characters (base64 over line
ends) is read once and decoded once for each alignment; lengths and fields are then read at offsets, so time is
near linear in a text, whatever it holds.

Patterns run over whole texts. A text without a run of RUN such characters and
without a keyword of ``assign`` is passed over after those two searches, which
every reported match would have met.

Defined cases: null and empty texts hold nothing (counts 0, base_sha256 of the
empty string, empty spans); overlapping kinds are all reported; ties in start
stand in the order of KINDS; repeated rows give equal rows; further columns are
ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import table, text_or_empty

RUN = 20
KINDS = ["assign", "access", "hex", "jwt", "pkcs", "openssh", "basic"]
#: The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of hex digits is kept from 24 on
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{%d}" % RUN)
_DOTTED = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,}")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{32,}")
_BASE64_ON = re.compile(r"([A-Za-z0-9+/]+)(?:\s|\\[nrt])*")  # a line of a key and what parts it from the next, escaped line ends included
_HEX_ANY = re.compile(r"[0-9a-fA-F]{64,}")
_JSON_START = re.compile("ey[JA]|ew[ok0]")  # base64 of an opening brace and a quote or white space
_BASIC = re.compile(r"[Bb]asic\x20+([A-Za-z0-9+/]{8,}={0,2})")
_DECODER = json.JSONDecoder()
_OPENSSH = b"openssh-key-v1\0"
_OPENSSH_START = "b3BlbnNzaC1rZXktdjEA"


def _base64(text: str, url: bool = False) -> bytes | None:
    text = re.sub(r"\s", "", text).rstrip("=")
    text += "=" * (-len(text) % 4)
    try:
        return base64.b64decode(text, b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(part: str) -> dict | None:
    data = _base64(part, url=True)
    try:
        found = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _object_at(text: str, at: int) -> tuple[dict | None, int]:
    """The JSON object that begins at a place, and its end; it is read from pieces that grow as long as they are too short, so a failure costs what was read."""
    size = 1024
    while True:
        part = text[at : at + size]
        try:
            found, end = _DECODER.raw_decode(part)
            return (found if isinstance(found, dict) else None), at + end
        except RecursionError:
            return None, at
        except json.JSONDecodeError as e:
            if at + size >= len(text) or not (e.msg.startswith("Unterminated") or e.pos > size - 16):
                return None, at
        size *= 8


def _header(part: str) -> int | None:
    """Where in a token's first part its header begins: the first place from which it decodes to a JSON object that names an algorithm."""
    decoded: dict[int, tuple[str, int]] = {}
    for m in _JSON_START.finditer(part):
        at = m.start()
        if (len(part) - at) % 4 == 1:
            continue
        # One decoding serves all starts of an alignment; a character stands for a byte.
        first = at % 4
        if first not in decoded:
            text = (_base64(part[first:], url=True) or b"").decode("latin-1")
            decoded[first] = text, text.rfind('"alg"') if text.rstrip().endswith("}") else -1
        text, last = decoded[first]
        begin = (at - first) // 4 * 3
        if begin > last:  # no header without this name behind it and a brace at the end
            continue
        found, end = _object_at(text, begin)
        if found and isinstance(found.get("alg"), str) and not text[end:].strip() and _json_object(part[at:]):
            return at
    return None


def asn1(data: bytes, at: int = 0, end: int | None = None, most: int = 16) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill data[at:end] exactly, or None, as if there are more than ``most``: no key has."""
    end, out = len(data) if end is None else end, []
    while at < end:
        if at + 2 > end or len(out) == most:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > end:
                return None
            n, at = int.from_bytes(data[at : at + size]), at + size
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def is_private_key(data: bytes, at: int = 0, end: int | None = None) -> bool:
    """Whether data[at:end] is one RSA, EC or PKCS#8 private key in DER."""
    top = asn1(data, at, end)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    fields = asn1(data, *top[0][1:])
    if not fields or len(fields) < 2 or fields[0][0] != 0x02:
        return False
    version, tags = int.from_bytes(data[fields[0][1] : fields[0][2]]), [t for t, _, _ in fields]
    if version in (0, 1) and tags[:3] == [0x02, 0x30, 0x04]:
        inner = asn1(data, *fields[1][1:])
        return bool(inner) and inner[0][0] == 0x06
    if version == 1 and tags[1] == 0x04:
        return all(t in (0xA0, 0xA1) for t in tags[2:])
    return version in (0, 1) and len(tags) >= 9 and all(t == 0x02 for t in tags[:9])


def der_length(data: bytes, at: int = 0) -> int:
    """Bytes of the sequence that begins at data[at], if its first field is a version number of 0 or 1, else 0."""
    if len(data) < at + 8 or data[at] != 0x30:
        return 0
    size = data[at + 1] & 0x7F if data[at + 1] & 0x80 else 0
    if size > 4 or data[at + 2 + size : at + 4 + size] != b"\x02\x01" or len(data) <= at + 4 + size or data[at + 4 + size] > 1:
        return 0
    return 2 + size + (int.from_bytes(data[at + 2 : at + 2 + size]) if size else data[at + 1])


def openssh_length(data: bytes, at: int = 0) -> int:
    """Bytes of the OpenSSH private key that begins at data[at] (magic, then strings whose lengths fit inside), else 0."""
    if not data.startswith(_OPENSSH, at):
        return 0
    first, at = at, at + len(_OPENSSH)
    for _ in range(3):  # cipher, derivation, its options
        if at + 4 > len(data):
            return 0
        at += 4 + int.from_bytes(data[at : at + 4])
    if at + 4 > len(data):
        return 0
    keys, at = int.from_bytes(data[at : at + 4]), at + 4
    if not 1 <= keys <= 16:
        return 0
    for _ in range(keys + 1):  # the public keys and the private part
        if at + 4 > len(data):
            return 0
        at += 4 + int.from_bytes(data[at : at + 4])
    return at - first if at <= len(data) else 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if _LONG.search(text):
        if "AKIA" in text:
            out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans that decoding and parsing confirm."""
    out = []
    if "asic " in text:
        for m in _BASIC.finditer(text):
            data = _base64(m[1])
            user, colon, word = (data or b"").partition(b":")
            if user and colon and word and all(32 <= b < 127 for b in data):
                out.append((m.start(1), m.end(1), "basic"))
    if not _LONG.search(text) and text.count(".") < 2:
        return out
    if _JSON_START.search(text):
        out += _tokens(text)
    if "M" in text or _OPENSSH_START in text:
        out += _base64_keys(text)
    end = 0
    for m in _HEX_ANY.finditer(text):
        whole = [bytes.fromhex(m[0][k : len(m[0]) - (len(m[0]) - k) % 2]) for k in (0, 1)]
        for start in _places("30", m[0]):
            data, at = whole[start % 2], start // 2
            n = der_length(data, at)
            if m.start() + start >= end and 0 < n <= len(data) - at and is_private_key(data, at, at + n):
                end = m.start() + start + 2 * n
                out.append((m.start() + start, end, "pkcs"))
    return out


def _tokens(text: str) -> list[tuple[int, int, str]]:
    """Signed tokens: any three parts of a dotted run, the first from any place in it."""
    out, end = [], 0
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for first, second, third in zip(parts, parts[1:], parts[2:]):
            if at >= end and second and _JSON_START.search(first) and _json_object(second) is not None:
                start = _header(first)
                if start is not None:
                    end = at + len(first) + len(second) + len(third) + 2
                    out.append((at + start, end, "jwt"))
            at += len(first) + 1
    return out


def _places(part: str, text: str) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


class _Run:
    """Base64 characters from a place of a text on, over line ends, with the places of its lines and its four decodings."""

    def __init__(self, text: str, start: int):
        parts, self.held, self.places, n, at = [], [], [], 0, start
        while m := _BASE64_ON.match(text, at):
            self.held.append(n)
            self.places.append(m.start())
            parts.append(m[1])
            n, at = n + len(m[1]), m.end()
        self.chars, self.end = "".join(parts), at

    @cached_property
    def decoded(self) -> list[bytes]:
        n = len(self.chars)
        return [_base64(self.chars[k : n - ((n - k) % 4 == 1)]) or b"" for k in range(4)]

    def number(self, place: int) -> int:
        """Number of the character at a place of the text."""
        k = bisect_right(self.places, place) - 1
        return self.held[k] + place - self.places[k]

    def place(self, number: int) -> int:
        k = bisect_right(self.held, number) - 1
        return self.places[k] + number - self.held[k]


def _base64_keys(text: str) -> list[tuple[int, int, str]]:
    """Keys in base64 that begin anywhere in a run of such characters; their own lengths say where they end."""
    out, end, run = [], 0, None
    for m in _BASE64.finditer(text):
        if run is None or m.start() >= run.end:
            run = None  # read when a key may begin
        for kind, first in (("pkcs", "M"), ("openssh", _OPENSSH_START)):
            for start in (m.start() + k for k in _places(first, m[0])):
                if start < end:
                    continue
                run = run or _Run(text, m.start())
                number = run.number(start)
                data, at = run.decoded[number % 4], number // 4 * 3
                n = der_length(data, at) if kind == "pkcs" else openssh_length(data, at)
                if 0 < n <= len(data) - at and (kind == "openssh" or is_private_key(data, at, at + n)):
                    end = run.place(number + -(-n * 4 // 3) - 1) + 1
                    end += len(re.match("={0,2}", text[end : end + 2])[0])
                    out.append((start, end, kind))
    return sorted(out)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


FINDINGS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"


def findings(text: str) -> tuple:
    base, more = base_spans(text), confirmed_spans(text)
    n = [sum(s[2] == kind for s in base) for kind in KINDS[:3]]
    return (*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more))


def scan(docs: DataFrame) -> DataFrame:
    """docs with __found: FINDINGS of every whole text."""

    @F.pandas_udf(FINDINGS)
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([findings(t) for t in texts], columns=[c.split()[0] for c in FINDINGS.split(", ")])

    return docs.withColumn("__found", found(text_or_empty("text")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "__found.*")
