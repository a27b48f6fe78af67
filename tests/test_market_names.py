"""Market rows of defences: all pairs of a team, dealt over tasks in bounded lists."""

from collections import Counter

from pyspark.sql import functions as F

from fieldmark.operators import identity

NAMES = "source_id long, name_norm string, team string, position string"
HUB = "player_id long, name_norm string, team string, position string"


def test_pairs_of_one_team_are_dealt_over_tasks(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        names = spark.createDataFrame([(k, "d", "T", "DEF") for k in range(400)], NAMES)
        hub = spark.createDataFrame([(k, "d", "T", "DEF") for k in range(2500)], HUB)
        got = identity.match_market(names, hub)
        by = Counter({r.task: r["count"] for r in got.groupBy(F.spark_partition_id().alias("task")).count().collect()})
        assert got.select("source_id", "player_id").distinct().count() == sum(by.values()) == 400 * 2500
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert len(by) > 8 and max(by.values()) < 0.4 * sum(by.values())


def test_lists_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(identity, "LISTED", 3)
    hub = spark.createDataFrame([(k, "d", "TU"[k % 2], "DEF") for k in range(200)], HUB)
    lists = identity._listed(hub).collect()
    assert max(len(r._players) for r in lists) == 3
    assert sorted((r._t, p) for r in lists for p in r._players) == sorted(("TU"[k % 2], k) for k in range(200))


def test_odd_rows(spark):
    """Equal rows and players without an id stay, a row without a team meets nobody."""
    names = spark.createDataFrame([(1, "d", "T", "DEF"), (1, "d", "T", "DEF"), (2, "d", None, "DEF"), (3, "d", "U", "DEF"), (None, None, "T", "DEF"), (5, "ann b", "T", "QB")], NAMES)
    hub = spark.createDataFrame([(10, "d", "T", "DEF"), (11, None, "T", "DEF"), (None, "x", "T", "DEF"), (12, "d", None, "DEF"), (13, "d", "V", "DEF"), (14, "ann b", "W", "QB")], HUB)
    out = identity.match_market(names, hub)
    assert out.columns == ["source_id", "name_norm", "team", "position", "player_id", "matched_by"]
    got = Counter((r.source_id, r.player_id, r.matched_by) for r in out.collect())
    assert got == Counter({**{(1, p, "team"): 2 for p in (10, 11, None)}, **{(None, p, "team"): 1 for p in (10, 11, None)}, (5, 14, "name_pos"): 1})
