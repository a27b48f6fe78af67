"""Reasons, injury causes, lineups and best available at the borders of their rules."""

import pytest
from pyspark.sql import functions as F

from fieldmark.operators import board, durability, signals

NUMBERS = "ppg vorp pos_rank e_games room_adp our_pick gap gap_z target_share prev_target_share last_ppg prev_ppg carry_share td_diff ppg_diff missed_3y eligible_3y known_missed line_delta ecr_sd disagreement vendor_ppg inhouse_ppg age age_factor years_exp draft_round draft_pick depth_rank depth_change".split()
TEXTS = "position status body_part play_caller qb_status qb1 line_note coach draft_team depth_as_of".split()
FLAGS = "is_rookie new_caller new_coach contract_year just_paid".split()


def why(spark, **facts):
    """Rule ids, polarities and texts of one player of whom nothing else is known."""
    schema = ", ".join([*(f"{c} double" for c in NUMBERS), *(f"{c} string" for c in TEXTS), *(f"{c} boolean" for c in FLAGS), "causes array<string>", "league_id int", "player_id int"])
    names = [c.split()[0] for c in schema.split(", ")]
    facts = {"league_id": 1, "player_id": 1} | {k: float(v) if k in NUMBERS and v is not None else v for k, v in facts.items()}
    rows = signals.reason_rows(spark.createDataFrame([tuple(facts.get(c) for c in names)], schema)).orderBy("place").collect()
    return [(r.rule_id, r.polarity, r.text) for r in rows]


@pytest.mark.parametrize(("facts", "want"), [
    ({}, [("experience", None)][:0]),
    ({"is_rookie": True}, [("rookie_draft_capital", -1)]),
    ({"is_rookie": True, "draft_round": 1, "draft_pick": 3}, [("rookie_draft_capital", 1)]),
    ({"is_rookie": True, "draft_round": 2}, [("rookie_draft_capital", 0)]),
    ({"depth_rank": 1}, [("depth_chart", 1)]), ({"depth_rank": 2, "depth_change": -1}, [("depth_chart", 0)]), ({"depth_rank": 3}, [("depth_chart", -1)]), ({"depth_change": 2}, []),
    ({"position": "RB", "carry_share": 0.5}, [("usage_level", 1)]), ({"position": "RB", "carry_share": 0.1, "target_share": 0.3}, [("usage_level", 0)]), ({"position": "RB", "carry_share": 0.6, "target_share": 0.3}, [("carries_share", 1)]),
    ({"position": "WR", "carry_share": 0.6, "target_share": 0.2}, [("usage_level", 1)]), ({"position": "WR", "target_share": 0.19}, [("usage_level", 0)]),
    ({"last_ppg": 10, "prev_ppg": 0}, []), ({"last_ppg": 10, "prev_ppg": 8.5}, [("ppg_trend", 1)]), ({"last_ppg": 10, "prev_ppg": 11.5}, [("ppg_trend", -1)]),
    ({"missed_3y": 3, "eligible_3y": 0}, []), ({"missed_3y": 3}, []), ({"missed_3y": 3, "eligible_3y": 10, "causes": ["a", "b", "c", "d"]}, [("games_missed", -1)]),
    ({"room_adp": 10}, []), ({"room_adp": 10, "our_pick": 10}, [("market_position", 0)]), ({"gap": 6, "gap_z": -1}, [("adp_gap", 1)]), ({"gap": 6, "gap_z": 0.9}, []),
    ({"years_exp": 1}, [("experience", 1)]), ({"years_exp": 4, "is_rookie": False}, [("experience", 0)]), ({"status": ""}, []), ({"status": "ACT"}, []), ({"status": "Out", "known_missed": 2}, [("current_injury", -1)]),
    ({"qb_status": "settled"}, []), ({"qb_status": "competition"}, [("qb_situation", -1)]), ({"line_delta": 0}, []), ({"line_delta": -1}, [("ol_delta", -1)]), ({"age": 30, "age_factor": 1}, []), ({"age": 30, "age_factor": 0.9}, [("age", -1)]),
    ({"contract_year": True}, [("contract", 0)]), ({"disagreement": 1}, [("expert_disagreement", -1)]), ({"vendor_ppg": 10, "inhouse_ppg": 9}, [("projection_sources", -1)]), ({"td_diff": -3}, [("td_regression", 1)]), ({"ppg_diff": 1}, [("ppg_luck", -1)]),
])
def test_rule(spark, facts, want):
    got = why(spark, **facts)
    assert [(r, p) for r, p, _ in got] == want
    assert all(t for _, _, t in got)


def test_six_reasons_in_order(spark):
    got = why(spark, ppg=12.34, vorp=55, pos_rank=3, e_games=15.5, position="RB", is_rookie=False, target_share=0.2, prev_target_share=0.1, last_ppg=12, prev_ppg=9, carry_share=0.7, depth_rank=1, depth_change=-2, depth_as_of="2026-08-01", td_diff=4, ppg_diff=2, years_exp=2)
    assert [r for r, _, _ in got] == ["projection", "target_share_trend", "ppg_trend", "carries_share", "depth_chart", "td_regression"]
    assert [t for _, _, t in got][0] == "Projected for 12.3 points a game, RB3, 55 over replacement, in 15.5 games"
    assert got[4][2] == "Place 1 of the depth chart at RB (2026-08-01), up by 2 in a month"


@pytest.mark.parametrize(("cause", "soft", "structural"), [("ACL", 0, 1), ("oracle", 0, 0), ("Knee", 0, 0), ("MCL sprain", 0, 1), ("Torn labrum", 0, 1), ("Achilles tendon", 0, 1), ("Lisfranc", 0, 0), ("Hamstring", 1, 0), ("Soft tissue", 1, 0), ("soft", 0, 0), ("Quad fracture", 1, 1), (None, 0, 0)])
def test_causes(spark, cause, soft, structural):
    reports = spark.createDataFrame([(1, 2025, 3, " ", cause, " Out ", None), (1, 2025, 4, None, cause, "Questionable", None), (None, 2025, 4, "x", None, "Out", None)], "player_id long, season int, week int, report_injury string, practice_injury string, report_status string, practice_status string")
    spells = durability.spells(durability.injury_weeks(reports))
    assert [(r.cause, r.listed) for r in spells.collect()] == [(cause or "Unspecified", 2)]
    none = spark.createDataFrame([], "player_id long, season int, week int")
    r = durability.ledger(none, none, spells).first()
    assert (r.spells, r.soft_tissue, r.structural, r.eligible, r.missed) == (1, soft, structural, 0, 0)


def test_played_without_an_eligible_week_has_a_row(spark):
    weeks = spark.createDataFrame([(1, 2025, 3)], "player_id long, season int, week int")
    none = weeks.limit(0)
    spells = durability.spells(none.withColumn("cause", F.lit("x")))
    assert [(r.player_id, r.eligible, r.played, r.missed) for r in durability.ledger(none, weeks, spells).collect()] == [(1, 0, 0, 0)]


def test_horizon_and_weights(spark):
    plan = spark.createDataFrame([(1, k, s, (k - 1) // 2 + 1) for k, s in enumerate([1, 2, 2, 1], 1)], "league_id int, live_pick_no long, team_slot int, round int")
    at = lambda n: tuple(board.horizon(plan, spark.createDataFrame([(1, n)], "league_id int, picks_made int"), 1).first())
    assert [at(n) for n in range(5)] == [(1, 0, 3, 2), (1, 1, 3, 2), (1, 2, 3, 2), (1, 3, 3, 2), (1, 4, None, None)]
    weight = lambda p, *x: spark.range(1).select(board.slot_weight(F.lit(p), *map(F.lit, x))).first()[0]
    assert [weight("WR", 0, 0, d) for d in (0, 1, 2, 3, 4)] == [0.35, 0.35, 0.193, 0.106, 0.1]
    assert (weight("WR", 0, 1, 5), weight("QB", 0, 1, 0), weight("K", 0, 0, 0), weight("K", 1, 0, 0)) == (1.0, 0.15, 0.03, 1.0)


def test_best_available_and_idle_teams(spark):
    rows = [(1, 1, "K", 1, False), (1, 2, "RB", 5, False), (1, 3, "RB", 2, True), (2, 4, "K", 7, False), (2, 5, "DEF", 3, False), (3, 6, "K", 2, True)]
    b = spark.createDataFrame(rows, "league_id int, player_id int, position string, overall_rank int, drafted boolean")
    best = lambda n: sorted((r.league_id, r.player_id) for r in board.best_available(b, None if n is None else F.lit(n)).collect())
    assert best(11) == best(None) == [(1, 2), (2, 5)] and best(12) == [(1, 1), (2, 5)]
    plan = spark.createDataFrame([(1, 1, 1, 1, 1, None), (1, 2, 1, 2, None, 77), (1, 3, 2, 3, 2, None), (1, 4, 2, 3, 3, None)], "league_id int, overall_pick int, round int, team_slot int, live_pick_no long, keeper_player_id int")
    picks = spark.createDataFrame([(1, 10, 3, 1)], "league_id int, player_id int, team_slot int, overall_pick int")
    placed = board.team_rosters(plan, picks)
    assert sorted((r.overall_pick, r.player_id, r.is_keeper, r.on_turn) for r in placed.collect()) == [(1, 10, False, False), (2, 77, True, None), (3, None, False, None), (4, None, False, None)]
    assert sorted(map(tuple, board.drift(placed).collect())) == [(1, 1, 1, 0, True), (1, 2, 0, 0, False), (1, 3, 0, 1, True)]
    r = {x.team_slot: x for x in board.roster(spark.createDataFrame([(1, 1, "RB")] * 4, "league_id int, team_slot int, position string"), plan).collect()}
    assert sorted(r) == [1, 2, 3] and (r[2].open_WR, r[2].open_FLEX, r[1].open_RB, r[1].open_FLEX, r[1].bench_RB) == (3, 1, 0, 0, 2)
