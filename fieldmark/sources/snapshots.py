"""Immutable snapshot files, their manifest, and partitions replaced from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_files(spark: SparkSession, path: str, source: str, endpoint: str) -> DataFrame:
    """One row a file: source, endpoint, path, sha256 of its bytes, and when it was written."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.lit(source).alias("source"), F.lit(endpoint).alias("endpoint"), "path", F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("fetched_at"))


def register(new: DataFrame, manifest: DataFrame) -> DataFrame:
    """New manifest rows: ``ok`` for content not seen at its endpoint before, else ``skipped_dupe``."""
    seen = manifest.filter("status = 'ok'").select(F.col("source").alias("_s"), F.col("endpoint").alias("_e"), F.col("sha256").alias("_h")).distinct()
    w = Window.partitionBy("source", "endpoint", "sha256").orderBy("fetched_at", "path")
    joined = new.withColumn("_n", F.row_number().over(w)).join(seen, (F.col("source") == F.col("_s")) & (F.col("endpoint") == F.col("_e")) & (F.col("sha256") == F.col("_h")), "left")
    fresh = F.col("_h").isNull() & (F.col("_n") == 1)
    return joined.withColumn("status", F.when(fresh, "ok").otherwise("skipped_dupe")).drop("_n", "_s", "_e", "_h")


def latest_ok(manifest: DataFrame) -> DataFrame:
    """The newest good snapshot of each source and endpoint."""
    rest = [c for c in manifest.columns if c not in ("source", "endpoint")]
    best = F.max_by(F.struct(*rest), F.struct("fetched_at", "snapshot_id")).alias("_r")
    return manifest.filter("status = 'ok'").groupBy("source", "endpoint").agg(best).select("source", "endpoint", "_r.*")


def replace_partition(rows: DataFrame, path: str, keys: Sequence[str], snapshot_id: str) -> None:
    """Replace the partitions that ``rows`` has (all, without keys); columns may be added, and every row is stamped."""
    out = rows.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("overwrite")
    if keys:
        out = out.partitionBy(*keys).option("partitionOverwriteMode", "dynamic")
    out.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table whose files may have grown columns over time."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def read_seasons(spark: SparkSession, path: str, schema: T.StructType | str, seasons: Sequence[int], kind: str = "parquet", **options) -> DataFrame:
    """Rows of the asked seasons; raises ValueError if the files hold another one."""
    rows = spark.read.schema(schema).options(**options).format(kind).load(path)
    other = [r[0] for r in rows.filter(~F.col("season").isin(*seasons)).select("season").distinct().limit(20).collect()]
    if other:
        raise ValueError(f"{path} has seasons that were not asked for: {sorted(other)}")
    return rows.filter(F.col("season").isin(*seasons))


def flat(rows: DataFrame) -> DataFrame:
    """Nested columns as text: arrays of plain values joined by ``; ``, everything else as JSON."""

    def text(f: T.StructField) -> F.Column:
        if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StructType, T.ArrayType, T.MapType)):
            return F.array_join(F.col(f.name).cast("array<string>"), "; ").alias(f.name)
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(f.name).alias(f.name)
        return F.col(f.name)

    return rows.select(*[text(f) for f in rows.schema.fields])


def export_board(board: DataFrame, path: str, first: int = 250, position: str | None = None) -> None:
    """The board's first rows of one league as one CSV file with a header, flags joined by ``|``."""
    rows = board if position is None else board.filter(F.col("position") == position)
    rows = rows.orderBy("overall_rank").limit(first)
    rows.withColumn("flags", F.array_join("flags", "|")).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def diff(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """How two payloads differ: ids in both or one, rows where each field differs, and the largest change of ``adp``."""
    a, b = left.select(key, *[F.col(f).alias(f"l_{f}") for f in fields], F.lit(1).alias("_l")), right.select(key, *[F.col(f).alias(f"r_{f}") for f in fields], F.lit(1).alias("_r"))
    both = a.join(b, key, "full")
    in_both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.groupBy().agg(
        F.count_if(in_both).alias("common"), F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"),
        *[F.count_if(in_both & ~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}"))).alias(f"{f}_differs") for f in fields],
        *([F.max(F.when(in_both, F.abs(F.col("l_adp") - F.col("r_adp")))).alias("max_adp_change")] if "adp" in fields else []),
    )


def first_pass_wins(pages: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Of rows that several pages repeat, the one that came first."""
    w = Window.partitionBy(key).orderBy(*order)
    return pages.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
