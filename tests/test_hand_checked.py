"""Values worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.functions.names import normal_name
from fieldmark.operators import draft, durability, features, scoring, valuation


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column).first()[0]


def test_value_tiers(spark):
    rows = [(1, i, "RB", float(p), 6.0) for i, p in enumerate([20, 19.8, 15, 14.9, 10])]
    d = spark.createDataFrame(rows, "league_id long, player_id long, position string, ppg double, weekly_sd double")
    assert [r.value_tier for r in valuation.value_tiers(d).orderBy("player_id").collect()] == [1, 1, 2, 2, 3]


def test_room_order_skips_kept(spark):
    rows = [(1, i, "RB", float(a), r, 4.0, i == 2) for i, a, r in ((1, 3, 1), (2, 7.5, 2), (3, 12, 3), (4, 20, 4))]
    d = spark.createDataFrame(rows, "league_id long, player_id long, position string, adp double, overall_rank long, sd_adp double, kept boolean")
    got = {r.player_id: r.room_adp for r in valuation.room_gaps(d).collect()}
    assert got == {1: 1, 2: None, 3: 2, 4: 3}


def test_p_available(spark):
    p = lambda pick, adp, sd: one(spark, valuation.p_available(F.lit(pick), F.lit(adp).cast("double"), F.lit(sd).cast("double")))
    assert p(20.0, 20.0, 5.0) == pytest.approx(0.5, abs=1e-6)
    assert p(20.0, None, 5.0) == 1.0


def test_age_and_games(spark):
    f = lambda pos, age: one(spark, features.age_factor(F.lit(pos), F.lit(float(age))))
    assert (f("RB", 26), f("RB", 30), f("QB", 40)) == (1.0, 0.85, 0.95)
    e = features.expected_games(F.lit(1.5), F.lit("RB"), F.lit(0), F.lit(51), F.lit(51), F.lit(None).cast("int"))
    assert one(spark, e) == 14.6


def test_leave_one_out(spark):
    """One large group over many range partitions, a small one, ties, and candidates who are surely there; a clashing name."""
    rnd = np.random.default_rng(1)
    rows = [(1, i, float(rnd.integers(0, 60)), float(rnd.choice([0.0, 1.0, rnd.random(), rnd.random() / 30])), i) for i in range(400)] + [(None, 1000 + i, 5.0, 0.5, i) for i in range(3)]
    df = spark.createDataFrame(rows, "league_id long, player_id long, value double, p double, run long").repartition(6)
    got, cut = ({r.player_id: r.others_best for r in valuation.leave_one_out(df, ["league_id"], one_run=n).collect()} for n in (1000, 2))
    assert got == pytest.approx(cut)
    want = {}
    for g in (1, None):
        group = sorted((-v, i, p) for k, i, v, p, _ in rows if k == g)
        for _, me, _ in group:
            want[me], none = 0.0, 1.0
            for v, i, p in group:
                if i != me:
                    want[me] -= v * p * none
                    none *= 1 - p
    assert got == pytest.approx(want)


def test_snake(spark):
    leagues = spark.createDataFrame([(1, 10, 16)], "league_id long, teams long, rounds int")
    k = spark.createDataFrame([(1, 3, 2, 77)], "league_id long, team_slot int, cost_round int, player_id long")
    plan = draft.schedule(leagues, k)
    assert plan.count() == 160
    hole = plan.filter("is_keeper").first()
    assert (hole.overall_pick, hole.live_pick_no) == (18, None)
    assert plan.filter("overall_pick = 19").first().live_pick_no == 18


def test_bonuses_are_for_games(spark):
    d = spark.createDataFrame([(1202.0, 924.0)], "rushing_yards double, receiving_yards double")
    d = scoring.adapt(d, required=())
    with_, without = d.select(scoring.points()).first()[0], d.select(scoring.points(bonuses=None)).first()[0]
    assert with_ - without == 12


def test_negatives(spark):
    d = scoring.adapt(spark.createDataFrame([(2.0,)], "fumbles_lost double"), required=())
    assert d.select(scoring.points(), scoring.points(negatives=False)).first()[:] == (-4.0, 0.0)


def test_missing_stat_raises(spark):
    with pytest.raises(ValueError, match="pass_yd"):
        scoring.adapt(spark.createDataFrame([(1.0,)], "receptions double"))


def test_names(spark):
    names = {"Eddy Piñeiro": "eddy pineiro", "Michael Pittman Jr.": "michael pittman", "James Cook III": "james cook", "Ja'Marr Chase": "jamarr chase"}
    d = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r.name: r.n for r in d.select("name", normal_name(F.col("name")).alias("n")).collect()} == names


def test_ledger(spark):
    weeks = lambda n: spark.createDataFrame([("a", 2025, w) for w in range(1, n + 1)], "player_id string, season int, week int")
    none = spark.createDataFrame([], "player_id string, season int, cause string")
    r = durability.ledger(weeks(17), weeks(4), none).first()
    assert (r.eligible, r.played, r.missed, r.spells, r.causes) == (17, 4, 13, 0, [])


def test_spell_gaps(spark):
    d = spark.createDataFrame([("a", 2025, "knee", w) for w in (1, 2, 4, 7, 8)], "player_id string, season int, cause string, week int")
    got = sorted((r.first_week, r.last_week, r.listed) for r in durability.spells(d).collect())
    assert got == [(1, 4, 3), (7, 8, 2)]


def test_mixture_tiers():
    x = np.array([1.0, 1.1, 1.2, 9.0, 9.1, 9.3, 20.0, 20.5, 21.0])
    assert valuation.mixture_tiers(x, 3).tolist() == [1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert valuation.mixture_tiers(np.array([2.0, 2.0]), 4).tolist() == [1, 1]


def test_tiers_never_fall(spark, sf):
    from fieldmark.plans.bindings import bound

    p = bound(spark, sf, "pool").withColumn("composite_rank", F.col("adp"))
    out = valuation.consensus_tiers(p, {"QB": 6, "RB": 8}).join(p.select("league_id", "player_id", "composite_rank"), ["league_id", "player_id"])
    pdf = out.toPandas().sort_values(["league_id", "position", "composite_rank", "player_id"])
    assert all(g["tier"].is_monotonic_increasing for _, g in pdf.groupby(["league_id", "position"]))
