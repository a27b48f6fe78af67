"""Nulls, ties and empty tables in season totals, the crosswalk, position means and rounds."""

from pyspark.sql import functions as F

from fieldmark.operators import draft, features, identity, projection

LINE = "player_id long, season int, week int, team string, position string, targets double, carries double"
POOL = "league_id long, player_id long, vorp double, adp double, sd_adp double"
PLAN = "league_id long, round int, overall_pick long, live_pick_no long"


def test_season_totals(spark):
    rows = [(1, 2000, 1, "A", "WR", 3.0, None), (1, 2000, 2, "B", None, None, 1.0), (1, 2000, 3, None, None, 5.0, None), (2, 2000, 1, None, None, None, None)]
    out = features.season_totals(spark.createDataFrame(rows, LINE), F.lit(1.5), ["targets", "carries"])
    got = {r["player_id"]: r for r in out.collect()}
    one, two = got[1], got[2]
    assert (one["games"], one["points"], one["targets"], one["mean_targets"], one["team"], one["position"]) == (3, 4.5, 8.0, 4.0, "B", "WR")  # B is as common and later
    assert (two["targets"], two["mean_targets"], two["team"], two["position"], two["role_key"]) == (0.0, None, None, None, "")
    assert features.season_totals(spark.createDataFrame([], LINE), F.lit(1.5), ["targets", "carries"]).count() == 0


def test_crosswalk(spark):
    hub = spark.createDataFrame([(1, "a", "x y", "T", "WR"), (2, "b", "x y", "U", "WR"), (3, "b", "z", None, "QB"), (4, None, "w", "T", "RB")], "player_id long, a_id string, name_norm string, team string, position string")
    rows = [(10, "a", None, None, None), (11, "b", "x y", "U", "WR"), (12, "b", "x y", None, "WR"), (13, None, "w", None, "RB"), (13, None, "w", None, "RB"), (14, None, None, None, None)]
    source = spark.createDataFrame(rows, "source_id long, a_id string, name_norm string, team string, position string")
    got = sorted((r["source_id"], r["player_id"] or 0, r["matched_by"]) for r in identity.crosswalk(source, hub, ["a_id"]).collect())
    assert got == [(10, 1, "id:a_id"), (11, 2, "name_team_pos"), (12, 0, "new"), (13, 4, "name_pos"), (13, 4, "name_pos"), (14, 0, "new")]


def test_position_means(spark):
    stats = sorted({s for pair in projection.RATES.values() for s in pair})
    rows = [(1, "WR", *[2.0] * len(stats)), (2, "WR", *[0.0] * len(stats)), (3, None, *[4.0] * len(stats))]
    history = spark.createDataFrame(rows, "player_id long, position string, " + ", ".join(f"{s} double" for s in stats))
    got = {r["player_id"]: r["ypt"] for r in projection.shrunk_rates(history).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {1: 1.0, 2: 1.0, 3: 1.0}


def test_rounds_without_value(spark):
    plan = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 2, None), (2, 1, 1, 1)], PLAN)
    pool = spark.createDataFrame([(1, 7, 4.0, None, 1.0), (1, 8, -3.0, None, 1.0), (2, 9, None, 5.0, 1.0), (2, 9, 0.0, 5.0, 1.0)], POOL)
    got = {(r["league_id"], r["round"]): r["mean"] for r in draft.best_by_round(pool, plan).collect()}
    assert got == {(1, 1): 4.0, (2, 1): 0.0}


def test_budget_of_no_teams(spark):
    shares = spark.createDataFrame([], "season int, team string, games long, share double")
    players = spark.createDataFrame([(1, "A", 0.5), (2, "A", 0.75), (3, None, 0.2)], "player_id long, team string, share double")
    got = {r["player_id"]: round(r["share"], 9) for r in projection.fit_to_budget(players, projection.measured_budget(shares, "share")).collect()}
    assert got == {1: 0.4, 2: 0.6, 3: 0.2}
