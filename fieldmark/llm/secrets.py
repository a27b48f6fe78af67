"""Secret scans: keyword automaton first, anchored patterns only at its hits, checksums last.

An Aho-Corasick automaton finds the keywords in one pass; the pattern of a
kind is tried only where its keyword begins.  Runs of hexadecimal digits have
no keyword: a byte table turns the text into marks and a substring search for
32 marks finds the texts that are worth a pattern.  Tokens that carry a CRC-32
are reported only if it holds.  One pass over the rows, no shuffle.

Null or empty text: no spans.  Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.frames import doc_text, pieces
from fieldmark.llm.words import ASCII_LOWER

#: Keywords of assignments, and prefixes of tokens with a checksum.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "github")

#: On lower-cased text, so that only A-Z count as the other case.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CHECKED = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_HEX_MARKS = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for words, kind in ((ASSIGN_WORDS, "assign"), (("akia",), "access"), (CHECKED_PREFIXES, "github")):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def checksum_holds(body: str, check: str) -> bool:
    """Whether ``check`` is the CRC-32 of ``body`` in base 62, six places."""
    x, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        x, r = divmod(x, 62)
        digits = BASE62[r] + digits
    return digits == check


def spans_of(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, by start and then kind."""
    if not text:
        return []
    raw = text.encode()
    low = raw.translate(ASCII_LOWER).decode()
    out, free = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end - size + 1, kind) for end, (kind, size) in _automaton().iter(low))
    for at, kind in hits:
        if at < free[kind]:
            continue
        if kind == "assign":
            if m := _ASSIGN.match(low, at):
                free[kind] = m.end()
                if len(m[1]) >= 8:
                    out.append((at, m.end(), kind))
        elif kind == "access":
            if m := _ACCESS.match(text, at):
                free[kind] = m.end()
                if m.end() - at >= 16:
                    out.append((at, m.end(), kind))
        elif (m := _CHECKED.match(text, at)) and checksum_holds(m[1], m[2]):
            free[kind] = m.end()
            out.append((at, m.end(), kind))
    if b"x" * 32 in raw.translate(_HEX_MARKS):
        out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with every span, overlapping ones as one, replaced by ``[SECRET]``."""
    parts, at, end = [], 0, -1
    for a, b, _ in spans:
        if a >= end:
            if end >= 0:
                parts.append("[SECRET]")
                at = end
            parts.append(text[at:a])
            end = b
        else:
            end = max(end, b)
    return "".join([*parts, "[SECRET]", text[end:]]) if spans else text


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, counts by kind, digest of the base spans, and ``spans`` (all)."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_assign", "n_access", "n_hex", "n_checked", "base_sha256", "spans"]
        for b in pieces(batches):
            rows = []
            for t in b.column(1):
                spans = spans_of(t.as_py())
                base = joined([s for s in spans if s[2] != "github"])
                n = [sum(s[2] == k for s in spans) for k in KINDS]
                rows.append((*n, hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
            cols = list(zip(*rows)) or [()] * 6
            arrays = [pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names)

    return doc_text(docs).mapInArrow(run, schema)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; every row and column stays, a null text stays null.

    Where ``docs`` has n_chars, it is counted anew for changed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            at = b.schema.get_field_index("text")
            texts = [t.as_py() for t in b.column(at)]
            texts = [t if not t else redacted(t, spans_of(t)) for t in texts]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out
