"""Queries over whole tables against results by definition."""

import math
from collections import defaultdict

import pytest

from fieldmark.plans import registry
from fieldmark.plans.bindings import bound, table

QUERIES = registry.queries()


def test_leave_one_out_of_the_whole_pool(spark, sf):
    groups = defaultdict(list)
    for r in bound(spark, sf, "pool").collect():
        z = None if r.adp is None else (40 - r.adp) / max(r.sd_adp or 1, 1)
        groups[r.league_id, r.position].append((-r.ppg, r.player_id, 1.0 if z is None else 1 - 0.5 * (1 + math.erf(z / math.sqrt(2)))))
    want = {}
    for group in groups.values():
        for _, me, _ in group:
            want[me], none = 0.0, 1.0
            for value, other, p in sorted(group):
                if other != me:
                    want[me] -= value * p * none
                    none *= 1 - p
    got = {r.player_id: r.others_best for r in QUERIES["h12_leave_one_out"](spark, sf).collect()}
    assert got == pytest.approx(want, abs=1e-3)


def test_every_league_has_a_schedule(spark, sf):
    ids = {r.c_custkey for r in table(spark, sf, "customer").collect()}
    got = defaultdict(set)
    for r in QUERIES["h13_schedule"](spark, sf).collect():
        got[r.league_id].add((r.overall_pick, r.team_slot, r.keeper_player_id))
    assert got.keys() == ids
    for i in ids:
        teams, kept = 8 + i % 5, {(1 + i % 7, 1 + i % 16): 2 * i, (8, 1 + i % 3): 2 * i + 1}
        slots = [s for k in range(16) for s in (range(1, teams + 1) if k % 2 == 0 else range(teams, 0, -1))]
        assert got[i] == {(k + 1, s, kept.get((s, k // teams + 1))) for k, s in enumerate(slots)}
    assert {r.league_id for r in QUERIES["h14_turns"](spark, sf).collect()} == ids
    assert {r.league_id for r in QUERIES["h14_on_clock"](spark, sf).collect()} == ids
    assert {r.league_id for r in QUERIES["h13_keeper_faults"](spark, sf).collect()} == {i for i in ids if i % 3 == 0}


def test_stale_rows_of_the_whole_manifest(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts").collect()
    newest = {}
    for r in rows:
        if r.event_id % 3:
            k = r.user_id % 4, r.event_type
            newest[k] = max(newest.get(k, r.ts), r.ts)
    want = {r.event_id for r in rows if (k := (r.user_id % 4, r.event_type)) in newest and newest[k] > r.ts}
    got = [r.snapshot_id for r in QUERIES["f4_stale_sources"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_byes_of_all_games(spark, sf):
    played = defaultdict(set)
    for r in table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate").collect():
        for team in (r.o_custkey % 32, r.o_orderkey % 32):
            played[r.o_orderdate.year, team].add((r.o_orderdate.timetuple().tm_yday + 6) // 7)
    want = {(*k, w) for k, weeks in played.items() for w in range(1, 19) if w not in weeks}
    assert want and {tuple(r) for r in QUERIES["c25_bye_weeks"](spark, sf).select("season", "team", "week").collect()} == want


def test_profiles_of_the_whole_pool(spark, sf):
    got = [r.player_id for r in QUERIES["j10_profiles"](spark, sf).select("player_id").collect()]
    assert sorted(got) == sorted(r.player_id for r in bound(spark, sf, "pool").collect())
