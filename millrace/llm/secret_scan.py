"""Secret scans: keyword prefilter, anchored patterns, checksums.

An Aho-Corasick automaton over the ASCII-lower-cased text reports keyword hits; each kind's pattern is then tried
only at the place a hit points to, in order, never before the end of the kind's last match. Kinds whose format
embeds a checksum (the CRC-32 at the end of `gh?_` and `npm_` tokens) count only if it fits. Hex runs have no
keyword; a fixed-length run pattern finds their starts.

Kinds in order: assign, access, hex (the base kinds), then token (checksummed), key (private key blocks). Spans
are code points, end exclusive. Null texts are empty; texts are scanned whole. Repeated rows are scanned alike, matches of
several kinds at one place all count.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import add_from_text

KINDS = ("assign", "access", "hex", "token", "key")
BASE = 3

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_TOKEN = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
#: Between its borders a key may have `Name: value` lines, each with continuation lines, before the base64 part.
_KEY = re.compile(
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:\s*+(?:(?:[A-Za-z][A-Za-z0-9-]*+:|[\x20\t])(?:(?!-----)[^\n])*+\n)*+"
    r"(?:[A-Za-z0-9+/=\s:,]|-(?!----))*+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?"
)

_WORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",),
          "token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), "key": ("-----begin",)}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum(payload: str) -> str:
    """CRC-32 in six base-62 digits."""
    n, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _BASE62[digit] + out
    return out


#: By kind: the pattern and what a match must also satisfy.
_RULES = {
    "assign": (_ASSIGN, lambda m: m.end(2) - m.start(2) >= 8),
    "access": (_ACCESS, lambda m: m.end() - m.start() >= 16),
    "token": (_TOKEN, lambda m: checksum(m[1]) == m[2]),
    "key": (_KEY, lambda m: True),
}


def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, keywords in _WORDS.items():
        for word in keywords:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def find(text: str, hits) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every secret, ascending."""
    lower = text.lower() if text.isascii() else text.encode().lower().decode()
    starts: dict[str, list[int]] = {}
    for end, (kind, length) in hits.iter(lower):
        starts.setdefault(kind, []).append(end + 1 - length)
    found = []
    for kind, at in starts.items():
        pattern, holds = _RULES[kind]
        after = 0
        for start in sorted(at):
            if start >= after and (m := pattern.match(text, start)):
                after = m.end()
                if holds(m):
                    found.append((start, KINDS.index(kind), after))
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found.sort()
    return found


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _spans(found: list[list[tuple[int, int, int]]]) -> pa.Array:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    return pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in row] for row in found], pa.list_(kind))


def scan(df: DataFrame, text: str = "text", spans: str = "secret_spans", keep_text: bool = True) -> DataFrame:
    """`df` with the array `spans` of (kind, start, end), by start, then kind; a column of that name is replaced."""

    def start():
        hits = automaton()
        return lambda column: [_spans([find(t or "", hits) for t in column.to_pylist()])]

    return add_from_text(df, text, [T.StructField(spans, SPANS)], start, keep_text)


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each union of overlapping spans replaced by the kind of its first."""
    out, upto, i = [], 0, 0
    while i < len(found):
        begin, kind, end = found[i]
        i += 1
        while i < len(found) and found[i][0] < end:
            end = max(end, found[i][2])
            i += 1
        out += [text[upto:begin], f"<{KINDS[kind]}>"]
        upto = end
    return "".join([*out, text[upto:]])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with the secrets in `text` replaced by their kinds in angle brackets; texts without any are unchanged, nulls stay null."""

    def start():
        hits = automaton()
        return lambda column: [pa.array([None if t is None else redacted(t, find(t, hits)) for t in column.to_pylist()], pa.string())]

    done = add_from_text(df, text, [T.StructField("_mr_redacted", T.StringType())], start)
    return done.select([F.col("_mr_redacted").alias(c) if c.lower() == text.lower() else F.col(c) for c in df.columns])
