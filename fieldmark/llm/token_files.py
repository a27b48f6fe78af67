"""Token-ID output: Parquet files of token lists in document order.

Documents are range-partitioned and sorted by id, so that files follow each
other in ascending order; each task encodes its distinct pre-tokens once with
the library and writes list columns with dictionary encoding (and delta
encoding where a dictionary grows too large), row groups and pages of a given
size, and page indexes.  Counts and positions are columns of their own: reading them
touches no token page, and reading some documents' tokens touches their pages.

A document's place in the whole stream is its shard's offset, summed from the
count column alone, and its place within the shard, which was written.

Null or empty text: the end token alone. Repeated ids: by text, then as they
are equal in any order. Null ids come first. Empty input: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.llm import pretokens
from fieldmark.llm import vocabularies as V
from fieldmark.llm.frames import doc_text

SCHEMA = "shard int, doc_id long, n_tokens long, start_in_shard long, ids array<int>"
END_ID = 0
_MOST_WORDS = 400_000


class _Encoded:
    """Ids of the words that a worker has met, kept from task to task; when there are too many, those of one batch only go."""

    def __init__(self, path: str):
        self.path, self.special = path, V.special_string(path)
        self.words: dict[str, int] = {}
        self.start = self.size = self.flat = self.seen = np.zeros(0, np.int64)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > _MOST_WORDS:
            self.forget()
        before = len(self.words)
        slots = pretokens.slots_of(texts, self.words, self.special)
        size, flat = V.library_flat(self.path, list(islice(self.words, before, None)))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])
        every = np.concatenate(slots)
        here = np.bincount(every, minlength=len(self.words)) > 0
        self.seen = np.concatenate([self.seen, np.zeros(len(size), np.int64)]) + here
        ids, n = V.gathered(every, self.start, self.size, self.flat), self.size[every]
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([len(s) for s in slots])]
        return np.split(ids, ends[:-1])

    def forget(self) -> None:
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) > _MOST_WORDS // 2:
            keep = keep[:0]
        names = list(self.words)
        self.words = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.flat = V.gathered(keep, self.start, self.size, self.flat)
        self.size = self.size[keep]
        self.start = np.cumsum(self.size) - self.size
        self.seen = np.ones(len(keep), np.int64)


@lru_cache(2)
def _known(path: str) -> _Encoded:
    return _Encoded(path)


def encode_in_order(docs: DataFrame, path: str = V.BYTE_BPE_JSON, end_id: int = END_ID) -> DataFrame:
    """Rows of ``SCHEMA`` in ascending doc_id order, partition by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before, known = TaskContext.get().partitionId(), 0, _known(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for rows in pretokens.batches_of(texts, 3 << 20):
                ids = known.ids([texts[i] for i in rows])
                n = np.array([len(x) + 1 for x in ids], np.int64)
                end = np.array([end_id], np.int32)
                flat = np.concatenate([p for x in ids for p in (x.astype(np.int32), end)])
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), shard, np.int32)), b.column(0).take(pa.array(rows)), pa.array(n), pa.array(before + offsets[:-1].astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    ["shard", "doc_id", "n_tokens", "start_in_shard", "ids"],
                )
                before += int(n.sum())

    ordered = doc_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, out: str, path: str = V.BYTE_BPE_JSON, end_id: int = END_ID, row_group_bytes: int = 64 << 20, page_bytes: int = 256 << 10, page_rows: int = 1000) -> None:
    writer = encode_in_order(docs, path, end_id).write.mode("overwrite")
    for k, v in {
        "compression": "snappy", "parquet.enable.dictionary": True, "parquet.writer.version": "v2", "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows,
    }.items():
        writer = writer.option(k, v)
    writer.parquet(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_tokens`` wrote, with ``start``: the number of ids of all documents before."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    # One row a shard, which is one a write task: small.
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(F.col("shard").alias("s"), F.coalesce(before, F.lit(0)).alias("offset"))
    joined = rows.join(F.broadcast(offsets), F.col("shard") == F.col("s"))
    return joined.select("doc_id", (F.col("offset") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids")


def with_crc32(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, the unsigned crc32 of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4").view(np.uint8)
            crc = [zlib.crc32(flat[4 * a : 4 * z]) for a, z in zip(at.tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
