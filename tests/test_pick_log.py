"""The batch fold of long logs."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from fieldmark.operators import draft
from fieldmark.plans import registry
from fieldmark.plans.board_queries import pick_events
from fieldmark.plans.valuation_queries import plan as league_plan
from fieldmark.streaming import picks


def _brute(rows, plan):
    slots, out, state, seen = {}, [], {}, set()
    for s in sorted(plan, key=lambda s: (s.league_id, s.overall_pick)):
        if s.live_pick_no is not None:
            slots.setdefault(s.league_id, []).append(picks.Slot(s.overall_pick, s.round, s.team_slot))
    for e in sorted(rows, key=lambda e: (e.picked_at, e.event_id)):
        if (e.league_id, e.event_id) not in seen:
            seen.add((e.league_id, e.event_id))
            event = picks.Event(e.event_id, e.action, e.player_id, e.team_slot, e.source, e.overall_pick, 0)
            state[e.league_id], d = picks.decide(state.get(e.league_id, {}), slots.get(e.league_id, []), event)
            out.append((e.league_id, e.event_id, e.action, d.live_pick_no, d.reason))
    return sorted(out)


def test_no_league_is_loaded_whole(spark, sf):
    events = pick_events(spark, sf)
    plan = draft.schedule(events.select("league_id").distinct().withColumns({"teams": F.lit(3), "rounds": F.lit(2)}))
    out = picks.fold_in_batch(events, plan)
    assert "InPandas" not in out._jdf.queryExecution().toString()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # a league spans many batches
    try:
        got = sorted((r.league_id, r.event_id, r.action, r.live_pick_no, r.reason) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == _brute(events.collect(), plan.collect())


def test_leagues_grow_with_the_users(spark):
    n = [registry.queries()["k1_pick_log"](spark, f"/root/testdata/{sf}").select("league_id").distinct().count() for sf in ("sf0.001", "sf0.01")]
    assert n[1] > 5 * n[0]


def test_null_leagues_and_players(spark):
    rows = [(2, None, "pick", 7, 1, "manual", "2026-01-01 00:00:02"), (1, None, "pick", None, None, None, "2026-01-01 00:00:01"), (3, 4, "pick", 7, 1, "manual", "2026-01-01 00:00:01")]
    d = spark.createDataFrame(rows, "event_id long, league_id long, action string, player_id long, team_slot int, source string, picked_at string").withColumn("picked_at", F.col("picked_at").cast("timestamp"))
    plan = draft.schedule(spark.createDataFrame([(None, 2, 2), (4, 2, 2)], "league_id long, teams long, rounds int"))
    got = {r.event_id: (r.live_pick_no, r.reason) for r in picks.fold_in_batch(d, plan).collect()}
    assert got == {1: (None, "unknown event"), 2: (1, None), 3: (1, None)}


def test_schedules_of_a_batch_are_not_unpacked_together(spark, monkeypatch):
    plan = draft.schedule(spark.createDataFrame([(1, 10, 16)], "league_id long, teams long, rounds int"))
    events = spark.createDataFrame([], picks.EVENTS)
    caught = []
    frame = type(events)
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema, real=frame.mapInArrow: caught.append((f, self)) or real(self, f, schema))
    picks.fold_in_batch(events, plan)
    (run, rows), n = caught[0], 2000
    one = rows.toArrow().combine_chunks().to_batches()[0]
    slots, ids = one.column("slots"), pa.array([*range(n), n - 1], pa.int64())
    given = {"league_id": ids, "slots": pa.concat_arrays([*[slots] * n, pa.nulls(1, slots.type)]), "action": pa.array([None] * n + ["pick"]), "player_id": ids}
    batch = pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n + 1, f.type)) for f in one.schema], names=one.schema.names)
    tracemalloc.start()
    try:
        out = [r for b in run(iter([batch])) for r in b.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [(r["league_id"], r["overall_pick"], r["round"], r["team_slot"], r["reason"]) for r in out] == [(n - 1, 1, 1, 1, None)]
    assert peak < 8e6  # all of them together take 110 MB


def _schedules(spark, sf, name, monkeypatch, of="packed_plan", at=0):
    """The leagues whose schedules a query makes, and those of its log."""
    seen = []
    monkeypatch.setattr(picks, of, lambda *a, real=getattr(picks, of): seen.append(a[at]) or real(*a))
    registry.queries()[name](spark, sf)
    ids = lambda d: {r.league_id for r in d.select("league_id").distinct().collect()}
    return ids(seen[0]), ids(pick_events(spark, sf)), ids(league_plan(spark, sf))


def test_pick_log_makes_schedules_of_its_leagues_only(spark, sf, monkeypatch):
    made, heard, every = _schedules(spark, sf, "k1_pick_log", monkeypatch)
    assert made == heard & every and len(every) > 10 * len(made) > 0


def test_standing_picks_make_schedules_of_their_leagues_only(spark, sf, monkeypatch):
    made, heard, every = _schedules(spark, sf, "k2_standing_picks", monkeypatch)
    assert made == heard & every and len(every) > 10 * len(made) > 0


def test_standing_picks_fold_once(spark, sf):
    """A null time, a null league and a reset count as ever; the plan holds the fold once."""
    rows = [(1, 4, "pick", 7, 1, None), (2, 4, "reset", None, 2, "01"), (3, 4, "pick", 8, 3, "02"), (4, 4, "undo", 8, 3, "03"), (5, 4, "pick", 9, 3, "04"), (6, None, "pick", 7, 1, "01"), (7, 5, "pick", 7, 1, None), (8, 5, "pick", 8, 2, "01"), (9, 5, "undo", 8, 2, "02")]
    d = spark.createDataFrame([(e, g, a, p, None if a == "reset" else n, None if t is None else f"2026-01-01 00:00:{t}") for e, g, a, p, n, t in rows], "event_id long, league_id long, action string, player_id long, overall_pick int, picked_at string")
    d = d.withColumns({"picked_at": F.col("picked_at").cast("timestamp"), "team_slot": F.lit(1), "reason": F.lit(None).cast("string")})
    got = sorted(((r.league_id, r.overall_pick, r.player_id) for r in picks.standing_in_batch(d).collect()), key=repr)
    assert got == [(4, 3, 9), (5, 1, 7), (None, 1, 7)]
    plan = registry.queries()["k2_standing_picks"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_live_state_makes_schedules_of_its_leagues_only(spark, sf, monkeypatch):
    """Both where the log is folded and where the next slot is looked up."""
    for of, at in (("packed_plan", 0), ("live_state", 1)):
        made, heard, every = _schedules(spark, sf, "k3_live_state", monkeypatch, of, at)
        assert made == heard & every and len(every) > 10 * len(made) > 0
