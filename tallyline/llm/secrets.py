"""Secret scans: an Aho-Corasick prefilter finds keywords, anchored expressions run only at the hits, and kinds that
carry a checksum are validated by it.

The three base kinds give what a plain left-to-right search with their expressions gives. Everything runs over the
UTF-8 bytes; positions are turned into code points for the spans found only.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, carried, kind_of, text_of

KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
BASE = KINDS[:3]

# Keywords, expressions and least lengths of the base kinds.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ASSIGN_LEAST = 6
ACCESS_WORD = "AKIA"
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile(rb"[0-9a-f]+")
HEX_LEAST = 24
# Tokens with an embedded checksum.
GITHUB_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
NPM_WORD = "npm_"
CRC_BODY = re.compile(rb"([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
XPRV_WORD = "xprv"
XPRV = re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

_HEX_MARKS = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_HEX_RUN = b"h" * HEX_LEAST


def base62_crc(body: bytes) -> bytes:
    """Six base-62 digits of the CRC-32 of a token's random part."""
    n, out = zlib.crc32(body), []
    for _ in range(6):
        n, digit = divmod(n, 62)
        out.append(BASE62[digit])
    return bytes(reversed(out))


def base58_checked(word: bytes) -> bool:
    """Whether the last four bytes are the double SHA-256 of those before them."""
    n = 0
    for c in word:
        n = n * 58 + BASE58.index(c)
    if n.bit_length() > 82 * 8:
        return False
    data = n.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    """Keywords in lower case, to (kind, length); built once in each Python worker."""
    found = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", (ACCESS_WORD,)), ("github", GITHUB_WORDS), ("npm", (NPM_WORD,)), ("xprv", (XPRV_WORD,))):
        for word in words:
            found.add_word(word.lower(), (kind, len(word)))
    found.make_automaton()
    return found


def _at(kind: str, data: bytes, i: int) -> tuple[int, bool]:
    """End of the match at a hit (0: none), and whether it counts."""
    if kind == "assign":
        m = ASSIGN.match(data, i)
        return (m.end(), m.end(2) - m.start(2) >= ASSIGN_LEAST) if m else (0, False)
    if kind == "access":
        m = ACCESS.match(data, i)
        return (m.end(), m.end() - i >= ACCESS_LEAST) if m else (0, False)
    if kind == "xprv":
        m = XPRV.match(data, i)
        return (m.end(), base58_checked(m[0])) if m else (0, False)
    m = CRC_BODY.match(data, i + 4)
    good = m is not None and data[i : i + 4].decode("latin-1") in (*GITHUB_WORDS, NPM_WORD) and base62_crc(m[1]) == m[2]
    return (m.end(), True) if good else (0, False)


def byte_spans(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secrets in a UTF-8 text, in bytes, by start and then kind as listed."""
    spans, ends = [], dict.fromkeys(KINDS, 0)
    for last, (kind, size) in _automaton().iter(data.lower().decode("latin-1")):  # one character a byte
        start = last + 1 - size
        if start >= ends[kind]:
            end, good = _at(kind, data, start)
            if end:
                ends[kind] = end
            if good:
                spans.append((start, end, kind))
    marks = data.translate(_HEX_MARKS)
    start = marks.find(_HEX_RUN)
    while start >= 0:
        end = HEX.match(data, start).end()
        spans.append((start, end, "hex"))
        start = marks.find(_HEX_RUN, end)
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def code_points(data: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The same spans in code points."""
    if data.isascii() or not spans:
        return spans
    at, points, place = 0, 0, {}
    for i in sorted({x for s in spans for x in s[:2]}):
        points += len(data[at:i].decode())
        at = i
        place[i] = points
    return [(place[a], place[b], kind) for a, b, kind in spans]


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_<kind> for each of KINDS, base_spans, spans (kind:start:end, comma-joined).

    Starts and ends are code points, the end exclusive; spans go by start, then by kind as listed. Per kind, matches
    are leftmost and do not overlap; those too short or with a wrong checksum are dropped after matching. Null texts
    count as empty: no spans, empty strings. Texts of any length are read whole. Null ids and repeated rows each keep
    their row; other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    bound_batches(docs)
    rows = docs.select(carried(id_col).alias("doc"), F.encode(text_of(text_col), "UTF-8").alias("data"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for data in map(bytes, batch.pop("data")):
                found.append(code_points(data, byte_spans(data)))
            for kind in KINDS:
                batch[f"n_{kind}"] = np.array([sum(s[2] == kind for s in spans) for spans in found], dtype=np.int64)
            batch["base_spans"] = [_listed([s for s in spans if s[2] in BASE]) for spans in found]
            batch["spans"] = [_listed(spans) for spans in found]
            yield batch

    counts = ", ".join(f"n_{kind} bigint" for kind in KINDS)
    found = rows.mapInPandas(run, f"doc string, {counts}, base_spans string, spans string")
    return found.withColumn("doc", F.col("doc").cast(kind_of(docs, id_col))).withColumnRenamed("doc", id_col)


def redacted(data: bytes, mark: bytes) -> bytes:
    """A UTF-8 text with each stretch that spans cover replaced by ``mark``."""
    out, at = [], 0
    for start, end, _ in byte_spans(data):
        if start >= at:
            out += [data[at:start], mark]
        at = max(at, end)
    return b"".join([*out, data[at:]]) if out else data


def redact_secrets(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[REDACTED]") -> DataFrame:
    """All rows and columns of ``docs``, secrets in the text replaced by ``mark`` and ``chars_col`` set to the new length.

    Texts without a secret, null ones included, stay as they are, and so does their ``chars_col``.
    """
    bound_batches(docs)
    sealed = mark.encode()

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else redacted(x.encode(), sealed).decode() for x in texts], dtype=object)

    made = "clean"
    while made in docs.columns:
        made += "_"
    new = docs.withColumn(made, clean(F.col(text_col)))
    changed = F.col(made) != F.col(text_col)
    out = [
        F.col(made).alias(c) if c == text_col
        else F.when(changed, F.length(made).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == chars_col
        else F.col(f"`{c}`")
        for c in docs.columns
    ]
    return new.select(*out)
