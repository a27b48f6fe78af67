"""Substring dedup by passages: every run of ``least_words`` words or more that occurs more than once.

Lines and paragraphs play no part here: a passage may start and end anywhere,
and be broken into lines differently each time.  All windows of
``least_words`` words are units; the occurrence that ranks first, by (doc_id,
offset), stays, and the words of every other one are removed.  Words removed
side by side are one span, with its original offsets.

1.  A window's fingerprint is the least hash of its shingles of half its
    size (winnowing).  Equal windows have equal fingerprints, and neighbours
    mostly share theirs, so about one hash in thirteen words is counted.
2.  Fingerprints that occur twice are put in a bitmap of fixed size.  Only
    windows whose fingerprint is in it can repeat; when it fills up, more
    windows pass, with the same results.
3.  Those windows are digested (128 bits) and grouped across the corpus.
    Within a chunk of documents a digest is one row, with its first place
    there, so a passage that stands in many documents is no hot key.

Words are compared after A-Z are lower-cased.  Null or short texts have no
windows.  Repeated ids rank by text and then share one place: rows equal in id
and text keep the same passages.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.frames import doc_text, pieces, settle
from fieldmark.llm.words import _MIX, ASCII_LOWER, WordHashes, lower_words, mixed

_LAST = 2**63 - 1  # a null id ranks last
_CHUNK_CHARS = 8 << 20
_ROWS = 20_000
_BUCKET = 32_768  # bits of one of Spark's bitmaps
_SCHEMA = "chunk long, slot int, one long, two long, doc long, mark long, at int, doc_id long, n_words long, packed binary"
_COLUMNS = [c.split() for c in _SCHEMA.split(", ")]
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def over(a: np.ndarray, width: int, op: Callable) -> np.ndarray:
    """``op`` over each window of ``width`` values, by doubling."""
    n, size = len(a) - width + 1, 1
    if n <= 0:
        return a[:0]
    while size * 2 <= width:
        a = op(a[:-size], a[size:])
        size *= 2
    return op(a[:n], a[width - size : width - size + n])


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mixed(x * _MIX[0] + y)


def fingerprints(hashes: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the half-size shingles, and the least of them in each window."""
    half = max(1, least_words // 2)
    small = over(hashes, half, _joined)
    return small, over(small, least_words - half + 1, np.minimum)


def chosen(small: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The shingles that are the least of some window, one for each place."""
    span = len(small) - len(least)
    edge = np.zeros(span, np.uint64)
    return small[small == over(np.concatenate([edge, least, edge]), span + 1, np.maximum)]


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end, in code points, of each word."""
    raw = np.frombuffer(text.encode(), np.uint8)
    word = np.concatenate([[False], ~((raw == 32) | ((raw >= 9) & (raw <= 13))), [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points[edges[::2]], points[edges[1::2]]


def _batch(columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), _KINDS[k]) for c, k in _COLUMNS], [c for c, _ in _COLUMNS])


def _repeated_fingerprints(docs: DataFrame, least_words: int, bits: int) -> np.ndarray:
    """Bitmap of the fingerprints that occur at two places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, n = WordHashes(), [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            for a in range(0, len(h), _ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(h[a : a + _ROWS].view(np.int64)), pa.array(c[a : a + _ROWS])], ["h", "n"])

        for b in pieces(batches):
            for text in b.column(1):
                words = lower_words(text.as_py())
                if len(words) >= least_words:
                    held.append(chosen(*fingerprints(known.of(words), least_words)))
                    n += len(held[-1])
            if n >= 1_000_000:
                yield from counted()
                held, n = [], 0
        if held:
            yield from counted()

    twice = doc_text(docs).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    place = twice.select((F.pmod("h", F.lit(bits)) + 1).alias("p"))
    maps = place.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("part"))
    out = np.zeros(max(bits, _BUCKET) // 8, np.uint8)
    for r in maps.collect():
        a = (r.bucket - 1) * (_BUCKET // 8)
        out[a : a + _BUCKET // 8] = np.frombuffer(r.part, np.uint8)
    return out


def _pack(*parts: np.ndarray) -> bytes:
    """Arrays of small steps, compressed."""
    steps = [np.diff(p, prepend=0).astype(np.int32) for p in parts]
    return zlib.compress(np.concatenate([np.array([len(s) for s in steps], np.int32), *steps]).tobytes(), 1)


def _unpack(packed: bytes, n: int) -> list[np.ndarray]:
    a = np.frombuffer(zlib.decompress(packed), np.int32)
    return [np.cumsum(p) for p in np.split(a[n:], np.cumsum(a[:n])[:-1])]


def _chunks(docs: DataFrame, least_words: int, chunk_chars: int, bitmap: np.ndarray, bits: int) -> DataFrame:
    """Digest rows (chunk, slot, digest, first place) and document rows (their windows, packed) of all chunks."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, maybe = WordHashes(), shared.value
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0

        def windows_of(text: str) -> tuple | None:
            words = text.encode().translate(ASCII_LOWER).split()
            if len(words) < least_words:
                return len(words), None
            hashes = known.of(words)
            low = (fingerprints(hashes, least_words)[1] & np.uint64(bits - 1)).astype(np.int64)
            at = np.flatnonzero(maybe[low >> 3] >> (low & 7).astype(np.uint8) & 1)
            if not len(at):
                return len(words), None
            one, two = over(hashes, least_words, _joined)[at], over(mixed(hashes ^ _MIX[1]), least_words, _joined)[at]
            inside = np.cumsum(np.bincount(at, minlength=len(words) + 1) - np.bincount(at + least_words, minlength=len(words) + 1))[: len(words)] > 0
            word = np.flatnonzero(inside)
            start, end = word_places(text)
            return len(words), (at, one, two, word, start[word], end[word])

        def of_chunk() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda d: d[:2])
            full = [d for d in held if d[4]]
            if full:
                number = np.cumsum([0] + [a[:2] != b[:2] for a, b in zip(full, full[1:])])
                doc = np.repeat(number, [len(d[4][0]) for d in full])
                at, one, two = (np.concatenate([d[4][i] for d in full]) for i in range(3))
                order = np.lexsort((two, one))  # stable: equal digests stay in the order of places
                new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
                slot = np.empty(len(at), np.int64)  # a digest's slot is the number of its first window
                slot[order] = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                slot = order[slot]
                again = (doc != doc[slot]) | (at != at[slot])
                rank, mark = (np.array([d[i] for d in full], np.int64)[np.searchsorted(number, np.arange(number[-1] + 1))] for i in (0, 1))
                first = np.sort(order[new])
                for a in range(0, len(first), _ROWS):
                    s = first[a : a + _ROWS]
                    yield _batch({"chunk": np.full(len(s), chunk), "slot": s, "one": one[s].view(np.int64), "two": two[s].view(np.int64), "doc": rank[doc[s]], "mark": mark[doc[s]], "at": at[s]})
            a, packed = 0, []
            for d in held:
                if d[4]:
                    window, _, _, word, start, end = d[4]
                    b = a + len(window)
                    packed.append(_pack(word, start, end, np.searchsorted(word, window), slot[a:b], again[a:b].astype(np.int32)))
                    a = b
                else:
                    packed.append(None)
            for a in range(0, len(held), _ROWS):
                part = held[a : a + _ROWS]
                yield _batch({"chunk": [chunk] * len(part), "doc_id": [d[2] for d in part], "mark": [d[1] for d in part], "n_words": [d[3] for d in part], "packed": packed[a : a + _ROWS]})

        for b in pieces(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                mark = xxhash.xxh3_64_intdigest(text) - 2**63
                held.append((_LAST if doc_id is None else doc_id, mark, doc_id, *windows_of(text)))
                size += len(text)
                if size >= chunk_chars:
                    yield from of_chunk()
                    chunk, held, size = chunk + 1, [], 0
        yield from of_chunk() if held else ()

    return doc_text(docs).mapInArrow(run, _SCHEMA)


def repeated_passages(docs: DataFrame, least_words: int = 50, chunk_chars: int = _CHUNK_CHARS, bits: int = 1 << 26) -> DataFrame:
    """Per row of ``docs``: doc_id, mark (hash of its text), n_words, n_removed (spans), n_removed_words, and ``removed``:
    the (start, end) in the text, code points, of each span of words in windows that have an earlier occurrence.

    ``substring_dedup.without`` cuts them. ``bits`` is a power of two."""
    rows = settle(_chunks(docs, least_words, chunk_chars, _repeated_fingerprints(docs, least_words, bits), bits), "passages")
    place = F.struct("doc", "mark", "at")
    # A digest has one row a chunk, so its partition is bounded by the number of chunks.
    digests = rows.filter("slot is not null").select("chunk", "slot", place.alias("place"), F.min(place).over(Window.partitionBy("one", "two")).alias("first"))
    later = digests.filter("place > first").select("chunk", "slot")
    documents = rows.filter("slot is null").select("chunk", "doc_id", "mark", "n_words", "packed")

    def run(group: pa.Table) -> pa.Table:
        slots = group.column("slot").drop_null().to_numpy()
        gone = np.zeros(int(slots.max()) + 1 if len(slots) else 0, bool)
        gone[slots] = True
        out: list[tuple] = []
        of_docs = group.filter(pc.is_null(group.column("slot")))
        for doc_id, mark, n, packed in zip(*(of_docs.column(c).to_pylist() for c in ("doc_id", "mark", "n_words", "packed"))):
            spans, words = [], 0
            if packed is not None:
                word, start, end, window, slot, again = _unpack(packed, 6)
                away = again > 0
                known = slot < len(gone)
                away[known] |= gone[slot[known]]
                window = window[away]
                cover = np.cumsum(np.bincount(window, minlength=len(word) + 1) - np.bincount(window + least_words, minlength=len(word) + 1))[: len(word)] > 0
                at = np.flatnonzero(cover)
                words = len(at)
                if words:
                    cut = np.flatnonzero(np.diff(word[at]) > 1)
                    firsts, lasts = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [words - 1]])]
                    spans = [{"start": s, "end": e} for s, e in zip(start[firsts].tolist(), end[lasts].tolist())]
            out.append((doc_id, mark, n, len(spans), words, spans))
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        names = ["doc_id", "mark", "n_words", "n_removed", "n_removed_words", "removed"]
        return pa.table([pa.array([o[i] for o in out], k) for i, k in enumerate([pa.int64()] * 5 + [span])], names)

    schema = "doc_id long, mark long, n_words long, n_removed long, n_removed_words long, removed array<struct<start:int,end:int>>"
    return documents.unionByName(later, allowMissingColumns=True).groupBy("chunk").applyInArrow(run, schema)
