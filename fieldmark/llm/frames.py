"""Reading tables, and joins and flags that several operators share. Lineage is cut by :mod:`fieldmark.sources.settled`."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.sources.settled import new_path, settle  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_BYTES = 8 << 20
LEAST_HOT = 10_000  # rows of one key that are no load for a task


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Hand rows to Python in Arrow batches of at most ``size`` bytes, so that a worker's memory does not depend on row
    counts. A session setting, made where the queries and stages start; a smaller one is left alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > size or int(now) <= 0:
        spark.conf.set(name, str(size))


def doc_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, so that other columns are not read and cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def from_files(df: DataFrame) -> bool:
    """Whether rows are read from files and come in the same order each time: nothing but columns and filters follow."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return {re.match(r"\W*(\w+)", line)[1] for line in plan.splitlines()} <= {"Project", "Filter", "Relation"}


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that what a task makes of one is small."""
    for b in batches:
        for a in range(0, len(b), rows):
            yield b.slice(a, rows)
    give_back()


def give_back() -> None:
    """Return what a finished task has freed to the system: workers live on, and the next stage needs the memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """A column name made from ``name`` that ``df`` does not hold in either case of its letters."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def maybe_in(rows: DataFrame, column: str, ids: DataFrame, flag: str, bits: int = 1 << 26) -> DataFrame:
    """``rows`` with a boolean ``flag``: false only where ``column`` is surely not among the one column of ``ids``.
    ``flag`` must be a name that ``rows`` does not hold, see :func:`free_name`.

    The ids go to a bitmap of ``bits`` bits, 8 MB by default whatever their number, which is broadcast.  When the
    ids outgrow it, more rows are flagged and later joins shuffle more, with the same results."""
    place = lambda c: F.pmod(F.xxhash64(c, F.lit("bitmap")), F.lit(bits))
    at_, part, found = (free_name(rows, c) for c in ("bit_place", "bit_bucket", "bit_map"))
    at = ids.select(place(F.col(ids.columns[0]).cast("long")).alias(at_))
    maps = at.groupBy(F.bitmap_bucket_number(at_).alias(part)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at_)).alias(found))
    marked = rows.withColumn(at_, place(F.col(column).cast("long")))
    marked = marked.join(F.broadcast(maps), F.bitmap_bucket_number(at_) == F.col(part), "left")
    byte = F.conv(F.hex(F.substring(found, (F.shiftright(F.bitmap_bit_position(at_), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.lit(1).bitwiseAND(F.call_function("shiftright", byte, F.pmod(F.bitmap_bit_position(at_), F.lit(8)).cast("int")))
    return marked.withColumn(flag, F.coalesce(bit == 1, F.lit(False))).drop(at_, part, found)


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], n: str = "n", how: str = "inner", total: int | None = None, most: int = 200) -> DataFrame:
    """``rows`` joined (inner or left) with ``groups``, which has one row for each key ``on`` and the number ``n`` of its rows.

    Keys with more than one row in ``most`` of ``total`` are hot, if they have more than ``LEAST_HOT`` rows; there are
    fewer than ``most`` of them, so they are broadcast and their rows stay where they are.  The others are shuffled, and
    none fills a partition."""
    if total is None:
        groups = settle(groups, "groups")
        total = groups.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    if total <= LEAST_HOT:
        return rows.join(groups.drop(n), on, how)
    bound = max(LEAST_HOT, total // most)
    hot = F.broadcast(groups.filter(F.col(n) > bound).drop(n))
    cold = groups.filter(F.col(n) <= bound).drop(n)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on, how))
