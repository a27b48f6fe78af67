"""Profiles: facets meet in one grouping."""

import re

from fieldmark.operators import board


def test_profiles(spark):
    players = spark.createDataFrame([(1, "WR", "KC"), (2, "RB", None), (3, "QB", "SF")], "player_id int, position string, team string")
    seasons = spark.createDataFrame([(1, 2025, 9.5), (1, 2024, 8.0), (9, 2025, 1.0)], "player_id int, season int, ppg double")
    market = spark.createDataFrame([(2, "b", None), (2, "a", 3.0), (2, "a", 3.0)], "player_id int, source string, rank double")
    context = spark.createDataFrame([("KC", "new caller")], "team string, note string")
    out = board.profiles(players, {"seasons": (seasons, ["season"]), "market": (market, ["source"])}, context)
    got = {r.player_id: r for r in out.collect()}
    assert sorted(got) == [1, 2, 3]
    assert [(s.season, s.ppg) for s in got[1].seasons] == [(2024, 8.0), (2025, 9.5)] and got[1].context.note == "new caller" and got[1].market == []
    assert [(m.source, m["rank"]) for m in got[2].market] == [("a", 3.0), ("a", 3.0), ("b", None)] and got[2].context is None
    assert (got[3].position, got[3].seasons, got[3].market) == ("QB", [], [])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Aggregate \[", plan)) == 1
    assert board.profiles(players.limit(0), {"seasons": (seasons, ["season"])}).count() == 0
