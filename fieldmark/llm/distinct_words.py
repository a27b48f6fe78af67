"""Per-chunk words, encoded once each across the whole corpus, and brought back.

A chunk is a run of documents of one input split, up to ``chunk_chars``
characters; a digest of its texts names it.  Its distinct pre-tokens are dealt
by a hash of the word into buckets, each a packed row (chunk, bucket, words,
slots), and its documents become packed slot lists.  All rows of a bucket meet
in one task, so each distinct word is encoded once; even the commonest word is
there once a chunk.  The results return to their chunk packed, and a chunk is
put together in one bounded task.  Shuffled data grow with the chunks'
vocabularies and not with word occurrences, and no word can become a hot key.
There are three buckets for each shuffle partition.  A bucket's rows go through
its task one after another and leave it at once; what the task holds is the
bucket's distinct words alone, however many chunks there are.

Words and documents are made in two passes over the texts: splitting twice
costs less than writing the slot lists to disk once more.  Both passes must
read the rows in the same order, so rows that come from anything but files are
settled first; a chunk's digest tells if its texts did change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from fieldmark.llm import pretokens
from fieldmark.llm.frames import doc_text, from_files, give_back, settle

CHUNK_CHARS = 8 << 20
_CHUNK = "chunk binary, bucket int, slots binary, lengths binary, words binary, doc_ids array<long>, sizes array<int>, packed binary, counts binary"
_NAMES = ["chunk", "bucket", "slots", "lengths", "words", "doc_ids", "sizes", "packed", "counts"]
_TYPES = [pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]

#: Encodes distinct words: to a list of ids, or of numbers, for each.
Encoder = Callable[[list[str]], list[list[int]]]


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as four byte planes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).reshape(-1).view("<u4").astype(np.int64)


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), t) for c, t in zip(_NAMES, _TYPES)], _NAMES)


def _dealt(words: dict[str, int], buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(bucket, slots, lengths, words), packed, of the words of a chunk; words are in order, which packs well."""
    raw = [w.encode() for w in words]
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw)) % np.uint64(buckets)
    order = np.argsort(hashed, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(hashed[order])) + 1):
        if len(part):
            found = sorted(part.tolist(), key=raw.__getitem__)
            slots, lengths = np.array(found), np.array([len(raw[i]) for i in found])
            yield int(hashed[found[0]]), packed(slots), packed(lengths), zstandard.ZstdCompressor(level=3).compress(b"".join(raw[i] for i in found))


def _words(lengths: bytes, words: bytes) -> list[str]:
    at = np.concatenate([[0], np.cumsum(unpacked(lengths))]).tolist()
    raw = zstandard.ZstdDecompressor().decompress(words)
    return [raw[a:b].decode() for a, b in zip(at, at[1:])]


def chunks(docs: DataFrame, buckets: int | None, special: str | None = None, counted: bool = False, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The word rows of all chunks, dealt to ``buckets``; if that is None, their document rows.

    ``counted``: documents as (slot, count) and not in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, name, rows = {}, 0, xxhash.xxh3_128(), []

        def finished() -> Iterator[pa.RecordBatch]:
            chunk = name.digest()
            if buckets is not None:
                for bucket, slots, lengths, raw in _dealt(words, buckets):
                    yield _batch(chunk=[chunk], bucket=[bucket], slots=[slots], lengths=[lengths], words=[raw])
            for ids, sizes, blob, counts in rows:
                yield _batch(chunk=[chunk], doc_ids=[ids], sizes=[sizes], packed=[blob], counts=[counts])

        for b in batches:
            texts = b.column(1).to_pylist()
            for part in pretokens.batches_of(texts, 1 << 20):
                slots = pretokens.slots_of([texts[i] for i in part], words, special)
                for i in part:
                    raw = (texts[i] or "").encode()
                    name.update(len(raw).to_bytes(8, "little") + raw)
                    held += len(raw)
                if buckets is None:
                    pairs = [np.unique(s, return_counts=True) for s in slots] if counted else [(s, s[:0]) for s in slots]
                    ids = b.column(0).take(pa.array(part)).to_pylist()
                    rows.append((ids, [len(p[0]) for p in pairs], packed(np.concatenate([p[0] for p in pairs])), packed(np.concatenate([p[1] for p in pairs]))))
                if held >= chunk_chars:
                    yield from finished()
                    words, held, name, rows = {}, 0, xxhash.xxh3_128(), []
        yield from finished()
        words, rows = {}, []
        give_back()

    return doc_text(docs).mapInArrow(run, _CHUNK)


def encoded(rows: DataFrame, encode: Encoder) -> DataFrame:
    """(chunk, slots, lengths, flat) of the word rows, packed; each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        values: list[list[int]] = []
        for b in batches:
            get = {c: b.column(b.schema.get_field_index(c)) for c in ("chunk", "slots", "lengths", "words")}
            sizes, flats = [], []
            for n, raw in zip(get["lengths"], get["words"]):
                words = _words(n.as_py(), raw.as_py())
                new = [w for w in words if w not in known]
                known.update(zip(new, range(len(values), len(values) + len(new))))
                values += encode(new) if new else []
                own = [values[known[w]] for w in words]
                sizes.append(packed(np.array([len(v) for v in own])))
                flats.append(packed(np.fromiter(chain.from_iterable(own), np.int64)))
            yield pa.RecordBatch.from_arrays([get["chunk"], get["slots"], pa.array(sizes, pa.binary()), pa.array(flats, pa.binary())], ["chunk", "slots", "lengths", "flat"])
        give_back()

    return rows.select("bucket", "chunk", "slots", "lengths", "words").groupBy("bucket").applyInArrow(run, "chunk binary, slots binary, lengths binary, flat binary")


#: Makes rows from (doc_ids, slots of each document, counts of each, start, size, flat) of some documents of a chunk.
Finish = Callable[[list, list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]


def brought_back(rows: DataFrame, words: DataFrame, finish: Finish, schema: str) -> DataFrame:
    """``finish`` of every chunk's documents, with the encodings of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, sizes, flats, docs = [], [], [], []
        for b in batches:
            get = {c: b.column(b.schema.get_field_index(c)) for c in ("slots", "lengths", "flat", "doc_ids", "sizes", "packed", "counts")}
            for i in range(len(b)):
                if get["slots"][i].is_valid:
                    for to, c in ((slots, "slots"), (sizes, "lengths"), (flats, "flat")):
                        to.append(unpacked(get[c][i].as_py()))
                else:
                    docs.append([get[c][i].as_py() for c in ("doc_ids", "sizes", "packed", "counts")])
        none = np.zeros(0, np.int64)
        slot, got, flat = (np.concatenate([*x, none]) for x in (slots, sizes, flats))
        known = int(slot.max()) + 1 if len(slot) else 0
        size, start = np.full(known, -1, np.int64), np.zeros(known, np.int64)
        size[slot] = got  # chunks with equal texts are one chunk here, whose words are there more than once
        start[slot] = np.cumsum(got) - got
        if not docs or (size < 0).any():
            raise RuntimeError("the rows were read in another order the second time; settle them first")
        for ids, n, blob, counts in docs:
            cuts, every, times = np.cumsum(n)[:-1], unpacked(blob), unpacked(counts)
            if len(every) and every.max() >= known:
                raise RuntimeError("the rows were read in another order the second time; settle them first")
            yield finish(ids, np.split(every, cuts), np.split(times, cuts) if len(times) else [times] * len(ids), start, size, flat)
        del slots, sizes, flats, docs, slot, got, flat, size, start
        give_back()

    both = rows.select("chunk", "doc_ids", "sizes", "packed", "counts").unionByName(words, allowMissingColumns=True)
    return both.groupBy("chunk").applyInArrow(run, schema)


def over_distinct_words(docs: DataFrame, encode: Encoder, finish: Finish, schema: str, *, special: str | None = None, counted: bool = False, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Split, encode each distinct word once, and finish each chunk."""
    docs = doc_text(docs)
    if not from_files(docs):
        docs = settle(docs, "texts")
    buckets = 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = encoded(chunks(docs, buckets, special, counted, chunk_chars), encode)
    return brought_back(chunks(docs, None, special, counted, chunk_chars), words, finish, schema)
