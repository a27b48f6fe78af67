"""Ranking runs: a board each, what it was made from, and which one is frozen.

Boards are partitions of one table.  Which run of a league is frozen is a
versioned file: a writer reads the newest version, makes the next one, and
moves it into place only if nobody else has put that version there meanwhile;
who comes second reads again.  So exactly one run of a league is frozen,
whoever writes, and a reader sees one version or the other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run_id string, league_id long, started_at timestamp, config_hash string, n_players long"
_FROZEN = "league_id long, run_id string"


def config_hash(config: DataFrame) -> str:
    """A digest of configuration rows, whatever their order; equal rows give equal digests."""
    row = F.to_json(F.struct(*sorted(config.columns)), {"ignoreNullFields": "false"})
    return config.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(row))), 256)).first()[0]  # a league's settings are a few rows


def record(board: DataFrame, path: str, league_id: int, config: DataFrame, started_at: str, run_id: str | None = None) -> str:
    """Keep a league's board as a run; gives its id. Its manifest row is written last, so a run that is listed is whole."""
    spark, run_id = board.sparkSession, run_id or uuid.uuid4().hex
    at = f"{path}/boards/run_id={run_id}"
    board.write.mode("overwrite").parquet(at)
    n = spark.read.parquet(at).count()
    row = spark.createDataFrame([(run_id, league_id, config_hash(config), n)], "run_id string, league_id long, config_hash string, n_players long")
    row = row.withColumn("started_at", F.lit(started_at).cast("timestamp")).select(*[c.split()[0] for c in MANIFEST.split(", ")])
    row.write.mode("overwrite").parquet(f"{path}/runs/{run_id}")
    return run_id


def _frozen(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """The newest version and its frozen run of each league."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/frozen")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return 0, {}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    newest = max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)
    if not newest:
        return 0, {}
    rows = spark.read.schema(_FROZEN).json(f"{path}/frozen/v{newest:09}").collect()  # a row a league that has a frozen run
    return newest, {r.league_id: r.run_id for r in rows}


def _commit(spark: SparkSession, path: str, version: int, frozen: dict[int, str]) -> bool:
    """Put a version into place unless it is there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    draft, final = (jvm.org.apache.hadoop.fs.Path(f"{path}/frozen/{n}") for n in (f".{uuid.uuid4().hex}", f"v{version:09}"))
    spark.createDataFrame(sorted(frozen.items()), _FROZEN).coalesce(1).write.json(draft.toString())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else jvm.java.net.URI("file:///"), conf).rename(draft, final, none)
    except Exception as e:  # noqa: BLE001  only one kind is expected, whose class depends on the bridge
        if "FileAlreadyExists" not in str(e) and "already exists" not in str(e) and "not empty" not in str(e).lower():
            raise
        draft.getFileSystem(conf).delete(draft, True)
        return False
    return True


def freeze(spark: SparkSession, path: str, run_id: str, before_commit=None) -> int:
    """Freeze a run and thaw what its league had frozen before; gives the version that says so.

    ``before_commit`` is called between reading and writing, for tests of two writers."""
    row = runs(spark, path).filter(F.col("run_id") == run_id).first()
    if row is None:
        raise ValueError(f"there is no run {run_id}")
    while True:
        version, frozen = _frozen(spark, path)
        if before_commit:
            before_commit()
        if _commit(spark, path, version + 1, frozen | {row.league_id: run_id}):
            return version + 1


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Every run that was recorded, and whether it is its league's frozen one."""
    _, frozen = _frozen(spark, path)
    ids = spark.createDataFrame(sorted(frozen.items()), "_l long, _r string")
    known = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{path}/runs")
    return known.join(F.broadcast(ids), (F.col("league_id") == F.col("_l")) & (F.col("run_id") == F.col("_r")), "left").withColumn("is_frozen", F.col("_r").isNotNull()).drop("_l", "_r")
