"""Secret scan: keyword automaton, anchored patterns at its hits, embedded checksums.

An Aho-Corasick automaton runs over each whole text once and reports where a keyword of
any rule begins.  Only there is the rule's pattern tried, anchored; the rest of the text
never meets a regular expression.  A run of hexadecimal digits has no keyword of its own,
so every four-digit run is one: the first hit in a run is the run's start.

Base kinds (leftmost, non-overlapping per kind; a failing match is dropped, but what it
covered stays covered): ``assign``, ``access``, ``hex``.  Added kinds, kept only if what
they embed proves right: ``checked`` (prefixed tokens of 36 letters and digits whose last
six are the base-62 CRC-32 of the first thirty), ``jwt`` (a header that decodes to JSON
with an algorithm, and a payload that decodes to JSON) and ``pem`` (a private-key block
whose body is base-64 of a DER sequence of the stated length).

Defined cases: a null text is the empty one and has no spans; texts of any length are
scanned whole; offsets are code points, ends exclusive; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import text_or_empty

KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("checked", "jwt", "pem")
ORDER = {kind: i for i, kind in enumerate(KINDS + ADDED_KINDS)}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
JWT_RUN = re.compile(r"eyJ[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END (?:[A-Z]+ )?PRIVATE KEY-----")

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def base62_crc(body: str) -> str:
    """CRC-32 of the text in base 62, six digits."""
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits


def _json_part(part: str) -> dict | None:
    try:
        found = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (binascii.Error, ValueError):
        return None
    return found if isinstance(found, dict) else None


def _der_sequence(body: str) -> bool:
    try:
        raw = base64.b64decode("".join(body.split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    if len(raw) < 4 or raw[0] != 0x30:
        return False
    if raw[1] < 0x80:
        return raw[1] + 2 == len(raw)
    n = raw[1] & 0x7F
    return 0 < n < 5 and int.from_bytes(raw[2 : 2 + n], "big") + 2 + n == len(raw)


#: kind -> anchored pattern, test of a match
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 8),
    "access": (ACCESS, lambda m: len(m[0]) >= 16),
    "hex": (HEX, lambda m: len(m[0]) >= 32),
    "checked": (CHECKED, lambda m: base62_crc(m[1][:30]) == m[1][30:]),
    "jwt": (JWT, lambda m: "alg" in (_json_part(m[1]) or {}) and _json_part(m[2]) is not None),
    "pem": (PEM, lambda m: _der_sequence(m[1])),
}

#: kind -> keywords as they stand in the text with A-Z lower-cased
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "checked": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    digits = "0123456789abcdef"
    for word in (a + b + c + d for a in digits for b in digits for c in digits for d in digits):
        found.add_word(word, ("hex", 4))
    found.make_automaton()
    return found


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, by start, then kind as listed."""
    covered = dict.fromkeys(RULES, 0)
    spans = []
    # the automaton reports hits by their ends; those of one kind with one start order differ
    # in length only where one keyword begins another, which none here does
    for last, (kind, n) in automaton().iter(text.encode().lower().decode()):
        start = last + 1 - n
        if start < covered[kind]:
            continue
        pattern, holds = RULES[kind]
        m = pattern.match(text, start)
        if m:
            covered[kind] = m.end()
            if holds(m):
                spans.append((kind, start, m.end()))
        elif kind == "jwt" and (run := JWT_RUN.match(text, start)):
            # what follows the run decided: a start further on in the run fails likewise
            covered[kind] = run.end()
    return sorted(spans, key=lambda s: (s[1], ORDER[s[0]]))


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with every covered stretch (spans may overlap) replaced by the mark."""
    parts, at = [], 0
    for _, start, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]]) if parts else text


def secret_spans(df: DataFrame, text_col: str = "text") -> Column:
    """Column with the spans of each whole text: kind, start, end."""

    @F.arrow_udf(SPANS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            yield pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t)] for t in batch.to_pylist()], kind)

    return scan(text_or_empty(df, text_col))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: its id and ``secrets`` (array of kind, start, end)."""
    return df.select(df[id_col], secret_spans(df, text_col).alias("secrets"))


def redact_secrets(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> Column:
    """Column with each text after redaction; a null text stays null."""

    @F.arrow_udf("string")
    def redact(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([t and redacted(t, find_secrets(t), mark) for t in batch.to_pylist()], pa.string())

    return redact(df[text_col].cast("string"))
