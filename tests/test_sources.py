"""Snapshot files, replaced partitions, seasons and exports on disk."""

import csv
import glob

import pytest
from pyspark.sql import functions as F

from fieldmark.sources import payloads, snapshots


def test_register_by_content(spark, tmp_path):
    for name, text in (("a", "one"), ("b", "one"), ("c", "two")):
        (tmp_path / f"{name}.json").write_text(text)
    files = snapshots.scan_files(spark, str(tmp_path), "site", "adp")
    none = spark.createDataFrame([], "source string, endpoint string, sha256 string, status string")
    got = snapshots.register(files, none)
    assert sorted(r.status for r in got.collect()) == ["ok", "ok", "skipped_dupe"]
    assert {r.status for r in snapshots.register(files, got).collect()} == {"skipped_dupe"}


def test_replace_partition_and_growth(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 2024), (2, 2025)], "x int, season int")
    snapshots.replace_partition(rows, path, ["season"], "s1")
    snapshots.replace_partition(rows.filter("season = 2025").selectExpr("x + 10 AS x", "season", "'new' AS y"), path, ["season"], "s2")
    got = {(r.x, r.season, r.y, r.snapshot_id) for r in snapshots.read_table(spark, path).collect()}
    assert got == {(1, 2024, None, "s1"), (12, 2025, "new", "s2")}


def test_read_seasons(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.createDataFrame([(1, 2024), (2, 2025)], "x int, season int").write.parquet(path)
    assert snapshots.read_seasons(spark, path, "x int, season int", [2024, 2025]).count() == 2
    with pytest.raises(ValueError, match="2025"):
        snapshots.read_seasons(spark, path, "x int, season int", [2024])


def test_export_board(spark, tmp_path):
    board = spark.createDataFrame([(2, "b", "RB", ["x", "y"]), (1, "a", "QB", []), (3, "c", "RB", ["z"])], "overall_rank int, name string, position string, flags array<string>")
    snapshots.export_board(board, str(tmp_path / "out"), first=2)
    (file,) = glob.glob(str(tmp_path / "out" / "*.csv"))
    with open(file) as f:
        assert [(r["name"], r["flags"]) for r in csv.DictReader(f)] == [("a", ""), ("b", "x|y")]


def test_payload_faults(spark):
    docs = ['{"meta": {"teams": 10}, "players": []}', '{"meta": {"teams": 12}, "players": [{"player_id": 1}]}', '{"meta": {"teams": 10}, "players": [{"player_id": 1}]}', "not json"]
    raw = spark.createDataFrame([(d,) for d in docs], "json string")
    assert [r.fault for r in payloads.adp_faults(raw, 10).orderBy(F.length("json")).collect()] == ["empty", "empty", "league size"]
    assert payloads.weekly_rows(spark.createDataFrame([('{"week": 3}',), ('{"week": null}',), ("{}",)], "json string")).count() == 1


def test_flat(spark):
    row = snapshots.flat(spark.range(1).select(F.array(F.lit(1), F.lit(2)).alias("a"), F.struct(F.lit(1).alias("x")).alias("s"), F.lit("t").alias("t"))).first()
    assert tuple(row) == ("1; 2", '{"x":1}', "t")
