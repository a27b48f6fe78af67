"""The pick stream gives what the batch fold gives, whatever the order of arrival; what it keeps is refreshed by league."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fieldmark.operators import board, draft
from fieldmark.plans.board_queries import pick_events
from fieldmark.plans.valuation_queries import plan as league_plan
from fieldmark.streaming import picks

NAMES = [c.split()[0] for c in picks.EVENTS.split(", ")]


def events_of(spark, rows):
    """Rows: event_id, league_id, action, player_id, team_slot, source, overall_pick, second of the day."""
    df = spark.createDataFrame(rows, "event_id long, league_id long, action string, player_id long, team_slot int, source string, overall_pick int, at long")
    return df.withColumn("picked_at", F.timestamp_seconds(F.col("at") + 1767225600)).select(*NAMES)


def one(k, action, player=None, source="manual", league=1, pick=None, team=None, at=None):
    return (k, league, action, player, team, source, pick, k if at is None else at)


def plan_of(spark, *leagues, keepers=()):
    k = spark.createDataFrame(list(keepers), "league_id long, team_slot int, cost_round int, player_id long")
    return draft.schedule(spark.createDataFrame(list(leagues), "league_id long, teams long, rounds int"), k)


def plain(df):
    return sorted((tuple(r[c] for c in ("league_id", "event_id", "action", "player_id", "team_slot", "overall_pick", "round", "live_pick_no", "standing", "reason")) for r in df.collect()), key=repr)


def told(df):
    return sorted((r.event_id, r.overall_pick, r.standing, r.reason) for r in df.collect())


def stream_of(spark, path, files):
    for rows in files:  # one micro-batch each
        d = rows if hasattr(rows, "columns") else events_of(spark, rows)
        d.coalesce(1).write.mode("append").parquet(str(path / "in"))
    return spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))


TICK = one(10**6, "tick", league=-1, at=80000)  # the watermark passes all that is more than the lateness before it


def test_rules(spark):
    plan = plan_of(spark, (1, 2, 2), keepers=[(1, 2, 1, 77)])  # live picks 1, 3, 4; pick 2 is a keeper's hole
    rows = [
        one(1, "pick", 10), one(2, "pick", 10), one(3, "pick", 11, "feed"), one(4, "undo"), one(5, "pick", 12, pick=3), one(6, "pick", 12, pick=2), one(7, "pick", 12, pick=9), one(8, "pick", 12, team=1),
        one(9, "pick", 13), one(10, "reset"), one(11, "pick"), one(12, "undo"), one(13, "pick", 14, pick=4), one(14, "pick", 15), one(15, "pick", 16), one(16, "pick", 17), one(17, "undo"), one(18, "pick", 18, league=5),
    ]
    assert told(picks.fold_in_batch(events_of(spark, rows), plan)) == [
        (1, 1, 1, None), (2, None, 1, "already drafted"), (3, 3, 2, None), (4, None, 2, "last pick is not manual"), (5, None, 2, "slot taken"), (6, None, 2, "no such pick"), (7, None, 2, "no such pick"),
        (8, 4, 3, None), (9, None, 3, "draft complete"), (10, None, 0, None), (11, None, 0, "unknown event"), (12, None, 0, "nothing to undo"), (13, 4, 1, None), (14, 3, 2, None), (15, None, 2, "slot taken"),
        (16, None, 2, "slot taken"), (17, 4, 1, None), (18, None, 0, "no schedule"),
    ]


def test_stream_equals_batch_in_any_order(spark, sf, tmp_path):
    """Leagues of 8 to 12 teams with keepers in one stream; files hold events of any time."""
    events = pick_events(spark, sf).withColumn("league_id", F.col("event_id") % 5).select(*NAMES)
    again = events.filter("event_id % 7 = 0").withColumn("player_id", F.lit(400).cast("long")).withColumn("picked_at", F.col("picked_at") + F.expr("interval 3 minutes"))
    whole = events.unionByName(again).withColumn("part", F.pmod(F.hash("event_id", "player_id"), F.lit(3))).cache()
    tick = events.agg(F.max("picked_at").alias("m")).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("league_id"), F.lit("tick").alias("action"), F.lit(None).cast("long").alias("player_id"), F.lit(None).cast("int").alias("team_slot"), F.lit("x").alias("source"), F.lit(None).cast("int").alias("overall_pick"), (F.col("m") + F.expr("interval 400 days")).alias("picked_at"))
    files = [whole.filter(F.col("part") == k).drop("part") for k in range(3)] + [tick]
    plan = league_plan(spark, sf)
    out = picks.run_available(picks.decisions(stream_of(spark, tmp_path, files), plan, lateness="90 days", idle_days=5000), str(tmp_path))
    batch = picks.fold_in_batch(whole.drop("part"), plan)
    got = plain(out)
    assert got == plain(batch) and len({r[0] for r in got}) > 1 and {r[-1] for r in got} >= {None, "slot taken", "nothing to undo"}
    # What stands is what the stream's last word says.
    at_end = picks.standing_in_batch(batch)
    assert sorted(map(tuple, at_end.collect())) == sorted(map(tuple, picks.standing_picks(out).collect()))


def test_earlier_pick_arrives_later(spark, tmp_path):
    plan = plan_of(spark, (1, 2, 2))
    files = [[one(2, "pick", 20, at=600)], [one(1, "pick", 20, at=300), one(3, "pick", 21, at=301)], [TICK]]
    out = picks.run_available(picks.decisions(stream_of(spark, tmp_path, files), plan), str(tmp_path))
    assert told(out) == [(1, 1, 1, None), (2, None, 2, "already drafted"), (3, 2, 2, None)]


def test_idle_leagues_start_anew(spark, tmp_path):
    plan = plan_of(spark, (1, 2, 1))
    day = 86400
    files = [[one(1, "pick", 20)], [one(9, "tick", league=-1, at=3 * day)], [one(10, "tick", league=-1, at=3 * day)], [one(2, "pick", 20, at=3 * day)], [one(11, "tick", league=-1, at=5 * day)]]
    out = picks.run_available(picks.decisions(stream_of(spark, tmp_path, files), plan, idle_days=1), str(tmp_path))
    assert [r for r in told(out) if r[0] < 9] == [(1, 1, 1, None), (2, 1, 1, None)]


def test_late_events_are_counted(spark, tmp_path):
    at = lambda h, m: h * 3600 + m * 60
    files = [[one(1, "pick", 1, at=at(1, 0)), one(2, "pick", 2, at=at(1, 5))], [one(3, "pick", 3, at=at(3, 0))], [one(8, "pick", 8, at=at(3, 0))],
             [one(4, "pick", 4, at=at(3, 1)), one(5, "pick", 5, at=at(0, 30)), one(6, "pick", 6, at=at(2, 0)), one(7, "pick", 7, at=at(2, 55))], [TICK]]
    out, late = picks.run_counted(picks.decisions(stream_of(spark, tmp_path, files), plan_of(spark, (1, 10, 2))), str(tmp_path))
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 3, 4, 7, 8]
    assert late == 2


def test_live_state(spark):
    plan = plan_of(spark, (1, 10, 2))
    made = lambda rows: {r.league_id: (r.picks_made, r.team_slot, r.round) for r in picks.live_state(picks.fold_in_batch(events_of(spark, rows), plan), plan).collect()}
    rows = [one(k, "pick", k) for k in range(1, 4)]
    assert made(rows) == {1: (3, 4, 1)}
    undone = [*rows, one(4, "undo"), one(5, "undo", league=2)]
    assert made(undone) == {1: (2, 3, 1), 2: (0, None, None)}  # the second league has no plan
    assert made([*undone, one(6, "reset")])[1] == (0, 1, 1)
    assert made([one(k, "pick", k) for k in range(1, 21)]) == {1: (20, None, None)}


def pool_of(spark, leagues, n=120):
    rows = [(g, g * 1000 + i, ["QB", "WR", "RB", "TE", "K", "DEF"][i * 7 % 6], float(n - i * 3 % 70), None if i % 9 == 4 else float(1 + i * 5 % n), None if i % 7 == 0 else 4.0) for g in leagues for i in range(n)]
    return spark.createDataFrame(rows, "league_id long, player_id long, position string, vorp double, adp double, sd_adp double")


@pytest.fixture(scope="module")
def followed(spark, tmp_path_factory):
    """A stream of three leagues with a board, and the files after each part of it."""
    path = tmp_path_factory.mktemp("follow")
    plan = plan_of(spark, (1, 2, 16), (2, 3, 16), (3, 2, 16), keepers=[(2, 1, 2, 2005), (2, 3, 16, 2006)])
    ranked = pool_of(spark, (1, 2, 3)).cache()
    kept = plan.filter("keeper_player_id is not null").select("league_id", "team_slot", F.col("keeper_player_id").alias("player_id"))
    tables = lambda standing, live: board.live_tables(ranked, plan, kept, standing, live, 1)
    first = [one(k, "pick", g * 1000 + 3 * k, league=g, at=100 * g + k) for g in (1, 2, 3) for k in range(1, 8)]
    tick = lambda k, at: one(10**6 + k, "tick", league=-1, at=at)
    random.Random(5).shuffle(first)
    second = [one(100 + k, "pick", 2000 + 3 * k + 40, league=2, at=2000 + k) for k in range(1, 20)] + [one(200, "undo", league=2, at=2100), one(201, "reset", league=1, at=2000), one(202, "pick", 1001, league=1, at=2001)]
    seen = []
    for files in ([first[:9], first[9:], [tick(1, 1500)], [tick(2, 1500)]], [second, [tick(3, 6000)], [tick(4, 6000)]]):
        picks.follow(picks.decisions(stream_of(spark, path, files), plan), plan, str(path / "out"), tables)
        seen.append({str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path / "out/board").rglob("*.parquet")})
    return path, plan, ranked, kept, events_of(spark, first + second), seen


def test_board_equals_that_from_scratch(spark, followed):
    path, plan, ranked, kept, events, _ = followed
    decided = picks.fold_in_batch(events, plan)
    want = board.live_tables(ranked, plan, kept, picks.standing_in_batch(decided), picks.live_state(decided, plan), 1)
    for name, rows in want.items():
        got = spark.read.parquet(str(path / "out" / name)).select(*rows.columns)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, rows.withColumn("league_id", F.col("league_id").cast("int")).collect()), key=repr), name
    live = spark.read.parquet(str(path / "out/live"))
    assert live.count() >= 5
    assert plain(spark.read.parquet(str(path / "out/decisions")).unionByName(spark.read.parquet(str(path / "out/refused")), allowMissingColumns=True).filter("league_id > 0")) == plain(decided)


def test_only_touched_leagues_are_written(followed):
    before, after = followed[-1]
    of = lambda files, g: {f: t for f, t in files.items() if f"league_id={g}/" in f}
    assert of(before, 3) and of(before, 3) == of(after, 3)
    assert of(before, 1) != of(after, 1) and of(before, 2) != of(after, 2)
