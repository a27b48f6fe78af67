"""Runs and their freeze, sources that fail, coverage gates."""

import pytest
from pyspark.sql import functions as F

from fieldmark.operators import context, market
from fieldmark.sources import runs


@pytest.fixture()
def recorded(spark, tmp_path):
    path = str(tmp_path)
    board, config = spark.createDataFrame([(1, 2.0)], "player_id int, value double"), spark.createDataFrame([("QB", 1), ("WR", None)], "slot string, n int")
    for k, league in (("a", 1), ("b", 1), ("c", 2)):
        runs.record(board, path, league, config, f"2026-08-0{ord(k) - 96} 10:00:00", k)
    return path


def frozen(spark, path):
    return {r.run_id for r in runs.runs(spark, path).filter("is_frozen").collect()}


def test_exactly_one_run_is_frozen(spark, recorded):
    assert frozen(spark, recorded) == set()
    assert {r.run_id for r in context.serving_run(runs.runs(spark, recorded)).collect()} == {"b", "c"}  # the newest
    runs.freeze(spark, recorded, "a")
    runs.freeze(spark, recorded, "c")
    assert frozen(spark, recorded) == {"a", "c"}
    runs.freeze(spark, recorded, "b")
    assert frozen(spark, recorded) == {"b", "c"}
    assert {r.run_id for r in context.serving_run(runs.runs(spark, recorded)).collect()} == {"b", "c"}
    with pytest.raises(ValueError, match="no run"):
        runs.freeze(spark, recorded, "z")


def test_two_writers_at_once(spark, recorded):
    """A second writer commits between the first one's look and write; the first one looks again, and both have had effect."""
    other = iter([lambda: runs.freeze(spark, recorded, "c"), lambda: runs.freeze(spark, recorded, "b")])
    version = runs.freeze(spark, recorded, "a", before_commit=lambda: next(other, lambda: None)())
    assert version == 3 and frozen(spark, recorded) == {"a", "c"}


def test_config_hash(spark):
    h = lambda rows: runs.config_hash(spark.createDataFrame(rows, "slot string, n int").repartition(2))
    assert h([("QB", 1), ("WR", None)]) == h([("WR", None), ("QB", 1)]) != h([("QB", 1), ("WR", 2)])


def test_failing_sources_are_skipped(spark):
    good = spark.createDataFrame([(1, 10, 2.0, 999.0), (1, 11, 1.0, 5.0), (1, 12, None, 1.0)], "league_id int, player_id long, order double, adp double")
    broken = good.withColumn("order", F.raise_error(F.lit("no")).cast("double"))
    sources = [("good", lambda: good), ("broken", lambda: broken), ("empty", lambda: good.filter("player_id = 12")), ("odd", lambda: good.drop("player_id")), ("gone", lambda: spark.read.parquet("/nowhere/at/all"))]
    rows, bad = market.collect_each(spark, sources)
    assert sorted(tuple(r) for r in rows.select("player_id", "source", "rank", "adp").collect()) == [(10, "good", 2.0, None), (11, "good", 1.0, 5.0)]
    problems = {r.source: r.problem for r in bad.collect()}
    assert sorted(problems) == ["broken", "empty", "gone", "odd"] and problems["empty"] == "no rows"
    assert market.collect_each(spark, [])[0].count() == 0


def test_coverage_gate(spark):
    rows = [(s, w, t, "REG") for s in (1, 2) for w in range(1, 19) for t in "ab" if (s, w, t) != (2, 5, "a")] + [(1, 19, "a", "POST"), (3, 1, "a", "REG"), (3, 1, "b", "REG"), (4, 20, "a", "POST")]
    got = {r.season: r for r in context.week_coverage(spark.createDataFrame(rows, "season int, week int, team string, season_type string"), 2).collect()}
    assert {k: r.complete for k, r in got.items()} == {1: True, 2: True, 3: False, 4: False}
    assert (got[2].thin_weeks, got[1].post_weeks, got[4].reg_weeks, got[4].rows, got[3].reg_teams) == (1, [19], [], 1, 2)
    roster = spark.createDataFrame([("ACT", None), ("ACT", None), (None, "R01")], "status string, code string")
    assert [tuple(r) for r in context.status_histogram(roster).collect()] == [("ACT", None, 2), (None, "R01", 1)]
