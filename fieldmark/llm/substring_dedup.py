"""Substring dedup by line and paragraph hashing, down to the clauses of lines.

Documents are cut into units - paragraphs, lines, or clauses of lines - whose
text is normalised.  A unit's run is the shortest sequence of units from it on
that has ``run_words`` words; with ``run_words`` 0, each unit of ``least_words``
words or more is its own run.  Runs are digested, all digests are grouped
across the corpus, and the occurrence that ranks first, by (doc_id, offset),
stays.  The units of every other one are removed; their original offsets are
kept.

Whole lines alone lose what starts or ends inside a line.  A passage holds a
run of clauses if it has ``run_words`` words besides its broken clauses at
both ends, so runs of 30 words find passages of 50 and more; sequences of
common clauses that long do not occur by chance.

Within a chunk of documents a digest is one row, with its first place there,
so a passage that stands in a third of all documents is one row a chunk.
Digests are counted first; only those of more than one chunk are ranked, and
the commonest of them, at most 200, are joined by broadcast, so that none is
a hot key.

Null or empty texts, texts without words and texts shorter than a run have
nothing removed; an empty table gives no rows.  Repeated ids rank by text and
then share one place: rows equal in id and text keep the same units.  A null
id ranks last.  In a text that repeats itself with overlap, a unit goes if any
later occurrence covers it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.llm.distinct_words import packed, unpacked
from fieldmark.llm.frames import doc_text, free_name, give_back, join_groups, maybe_in, settle
from fieldmark.llm.words import ASCII_LOWER

#: A clause ends with a line or after these.
CLAUSE_ENDS = ".!?,;:"
UNITS = {"line": re.compile(r"[^\n]+"), "paragraph": re.compile(r"(?:[^\n]|\n(?![ \t]*\n))+"), "clause": re.compile(rf"[^\n{CLAUSE_ENDS}]+[{CLAUSE_ENDS}]*")}


def normalised(unit: str) -> list[bytes]:
    """The words of a unit, A-Z lower-cased."""
    return unit.encode().translate(ASCII_LOWER).split()


_LAST = 2**63 - 1  # a null id ranks last
_CHUNK_CHARS = 8 << 20
_ROWS = 20_000
_SCHEMA = "chunk long, slot int, one long, two long, doc long, mark long, at int, doc_ids array<long>, marks array<long>, packed binary"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_NAMES, _TYPES = zip(*((c, _KINDS[k]) for c, k in (field.split() for field in _SCHEMA.split(", "))))


def _batch(columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), t) for c, t in zip(_NAMES, _TYPES)], _NAMES)


def runs_of(text: str, pattern: re.Pattern, least_words: int, run_words: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, bytes]]]:
    """Units (start, end, words) of a text, and its runs (first unit, unit after the last, digest)."""
    units, raw, upto = [], [], [0]
    for m in pattern.finditer(text):
        words = normalised(m[0])
        if len(words) >= max(1, 0 if run_words else least_words):
            units.append((m.start(), m.end(), len(words)))
            raw.append(b" ".join(words))
            upto.append(upto[-1] + len(words))
    if run_words:
        ends = np.searchsorted(upto, np.array(upto[:-1], np.int64) + run_words).tolist()
        ends = ends[: sum(e <= len(units) for e in ends)]
    else:
        ends = range(1, len(units) + 1)
    return units, [(i, j, xxhash.xxh3_128_digest(b" ".join(raw[i:j]))) for i, j in enumerate(ends)]


def _chunks(docs: DataFrame, unit: str, least_words: int, run_words: int, chunk_chars: int) -> DataFrame:
    """Digest rows (chunk, slot, digest, first place) and document rows (their units and runs) of all chunks."""
    pattern = UNITS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, known, held, chars = TaskContext.get().partitionId() << 32, {}, [], 0

        def finished() -> Iterator[pa.RecordBatch]:
            digests, (slots, places) = list(known), zip(*known.values()) if known else ((), ())
            for a in range(0, len(digests), _ROWS):
                pair = np.frombuffer(b"".join(digests[a : a + _ROWS]), np.int64).reshape(-1, 2)
                doc, mark, at = zip(*places[a : a + _ROWS])
                yield _batch({"chunk": [chunk] * len(pair), "slot": slots[a : a + _ROWS], "one": pair[:, 0], "two": pair[:, 1], "doc": doc, "mark": mark, "at": at})
            for a in range(0, len(held), 256):
                part, numbers = held[a : a + 256], []
                for _, rank, mark, units, runs in part:
                    for k, (start, end, words) in enumerate(units):
                        slot, until = runs[k] if k < len(runs) else (-1, k)
                        numbers.append((slot + 1, slot >= 0 and places[slot] != (rank, mark, start), start, end, words, until - k))
                every = np.array(numbers, np.int64).reshape(-1, 6).T.reshape(-1)
                sizes = np.array([len(d[3]) for d in part], np.int64)
                yield _batch({"chunk": [chunk], "doc_ids": [[d[0] for d in part]], "marks": [[d[2] for d in part]], "packed": [packed(np.concatenate([sizes, every]))]})

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                rank, mark = _LAST if doc_id is None else doc_id, xxhash.xxh3_64_intdigest(text) - 2**63
                units, runs = runs_of(text, pattern, least_words, run_words)
                for n, (i, j, digest) in enumerate(runs):
                    place = (rank, mark, units[i][0])
                    entry = known.setdefault(digest, (len(known), place))
                    if place < entry[1]:
                        known[digest] = (entry[0], place)
                    runs[n] = (entry[0], j)
                held.append((doc_id, rank, mark, units, runs))
                chars += len(text)
                if chars >= chunk_chars:
                    yield from finished()
                    chunk, known, held, chars = chunk + 1, {}, [], 0
        yield from finished()
        known, held = {}, []
        give_back()

    return doc_text(docs).mapInArrow(run, _SCHEMA)


def _later(digests: DataFrame) -> DataFrame:
    """(chunk, slot) of the chunks' digests whose first place is in another chunk."""
    often = digests.groupBy("one", "two").agg(F.count("*").alias("n")).filter("n > 1")
    often = settle(often, "repeated")
    flag = free_name(digests, "maybe")
    some = maybe_in(digests, "one", often.select("one"), flag).filter(flag).drop(flag)
    # What the bitmap lets through besides is alone under its digest, and so its own first.
    first = some.groupBy("one", "two").agg(F.min(F.struct("doc", "mark", "at")).alias("first"), F.count("*").alias("n"))
    return join_groups(some, first, ["one", "two"]).filter(F.struct("doc", "mark", "at") > F.col("first")).select("chunk", "slot")


def repeated_units(docs: DataFrame, unit: str = "clause", least_words: int = 5, run_words: int = 30, chunk_chars: int = _CHUNK_CHARS) -> DataFrame:
    """Per row of ``docs``: doc_id, mark (hash of its text), n_units, n_removed, n_removed_words, and ``removed``: the
    (start, end) in the text, code points, of the units in runs that have an earlier occurrence; with ``run_words``,
    units side by side are one span."""
    rows = settle(_chunks(docs, unit, least_words, run_words, chunk_chars), "units")
    later = _later(rows.filter("slot is not null").select("chunk", "slot", "one", "two", "doc", "mark", "at"))
    docs_ = rows.filter("slot is null").select("chunk", "doc_ids", "marks", "packed")

    def run(group: pa.Table) -> pa.Table:
        slots = group.column("slot").drop_null().to_numpy()
        gone = np.zeros(int(slots.max()) + 2 if len(slots) else 1, bool)  # the first place stands for no run
        gone[slots + 1] = True
        out: list[tuple] = []
        of_docs = group.filter(group.column("slot").is_null())
        for ids, marks, blob in zip(*(of_docs.column(c).to_pylist() for c in ("doc_ids", "marks", "packed"))):
            numbers = unpacked(blob)
            sizes = numbers[: len(ids)]
            slot, again, starts, ends, words, until = numbers[len(ids) :].reshape(6, -1)
            away = (again > 0) | gone[np.where(slot < len(gone), slot, 0)]
            cover = np.zeros(len(slot) + 1, np.int64)
            np.add.at(cover, np.flatnonzero(away), 1)
            np.subtract.at(cover, (np.arange(len(slot)) + until)[away], 1)
            cover = np.cumsum(cover)[:-1] > 0
            a = 0
            for doc_id, mark, size in zip(ids, marks, sizes.tolist()):
                at = np.flatnonzero(cover[a : a + size]) + a
                cut = np.flatnonzero(np.diff(at) > 1) if run_words else np.arange(len(at) - 1)
                firsts, lasts = (at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]) if len(at) else (at, at)
                spans = [{"start": s, "end": e} for s, e in zip(starts[firsts].tolist(), ends[lasts].tolist())]
                out.append((doc_id, mark, size, len(at), int(words[at].sum()), spans))
                a += size
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = [pa.int64()] * 5 + [span]
        names = ["doc_id", "mark", "n_units", "n_removed", "n_removed_words", "removed"]
        return pa.table([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)

    schema = "doc_id long, mark long, n_units long, n_removed long, n_removed_words long, removed array<struct<start:int,end:int>>"
    return docs_.unionByName(later, allowMissingColumns=True).groupBy("chunk").applyInArrow(run, schema)


def without(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` with the removed units cut from ``text``, each with the line end after it; all rows and columns stay."""
    id_, mark, own, removed = (free_name(docs, c) for c in ("id", "mark", "own", "removed"))
    spans = repeated.filter("n_removed > 0").select(F.col("doc_id").alias(id_), F.col("mark").alias(mark), F.col("removed").alias(removed))
    # Rows equal in id and text have equal spans.
    spans = spans.groupBy(id_, mark).agg(F.first(removed).alias(removed))
    names = docs.columns

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [xxhash.xxh3_64_intdigest(t or "") - 2**63 for t in b.column("text").to_pylist()]
            yield b.append_column(own, pa.array(found, pa.int64()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, gone in zip(b.column("text").to_pylist(), b.column(removed).to_pylist()):
                parts, at = [], 0
                for span in gone or []:
                    parts.append(text[at : span["start"]])
                    at = span["end"] + (text[span["end"] : span["end"] + 1] == "\n")
                texts.append(text if not gone else "".join([*parts, text[at:]]))
            b = b.select(names)
            yield b.set_column(names.index("text"), "text", pa.array(texts, pa.string()))

    marked = docs.mapInArrow(marks, T.StructType([*docs.schema.fields, T.StructField(own, T.LongType())]))
    joined = marked.join(spans, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(mark)), "left")
    return joined.select(*names, removed).mapInArrow(cut, docs.schema)
