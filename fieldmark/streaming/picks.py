"""A draft's picks as a stream of events, with state per league.

Events are picks, undos (of the last standing pick, if it is a manual one) and
resets.  A league's live slots, its size and its keepers' holes come from its
schedule.  A pick takes the slot on the clock, or the one that it names; a slot
holds one standing pick, the first wins, and a player is drafted once.  What is
refused goes to the output with its reason.

The rules are one small function over (standing picks, event).  A batch folds a
league's log from the start.  A stream keeps events in list state until the
watermark has passed them, and then folds them in the order of their time, so it
decides as the batch does whatever the order of arrival within the lateness.  Ids
that were seen are map state, so of several rows with an id the first in time
counts in both.  A league's state expires some time after its last event.
"""

from __future__ import annotations

import threading
import uuid
from collections import namedtuple
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "event_id long, league_id long, action string, player_id long, team_slot int, source string, overall_pick int, picked_at timestamp"
_DECIDED = "league_id long, event_id long, action string, player_id long, team_slot int, at long, overall_pick int, round int, live_pick_no int, standing int, reason string"
_PICKS = "array<struct<overall_pick:int,team_slot:int,player_id:long>>"
OUTPUT = _DECIDED.replace("at long", "picked_at timestamp")
#: A slot of a schedule, a standing pick, and an event; ``at`` is in microseconds.
Slot = namedtuple("Slot", "overall_pick round team_slot")
Pick = namedtuple("Pick", "player_id team_slot manual")
Event = namedtuple("Event", "event_id action player_id team_slot source overall_pick at")
Decision = namedtuple("Decision", "overall_pick round live_pick_no team_slot reason")
#: Standing picks by overall pick.
Standing = dict[int, Pick]

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decide(standing: Standing, slots: list[Slot], e: Event) -> tuple[Standing, Decision]:
    """The picks that stand after an event, and what became of it; ``slots`` are a league's live ones in order."""
    no = lambda why: (standing, Decision(None, None, None, e.team_slot, why))
    if e.action == "reset":
        return {}, Decision(None, None, None, e.team_slot, None)
    if e.action == "undo":
        if not standing:
            return no("nothing to undo")
        last = max(standing)
        if not standing[last].manual:
            return no("last pick is not manual")
        return {k: p for k, p in standing.items() if k != last}, _at(slots, last, standing[last].team_slot)
    if e.action != "pick" or e.player_id is None:
        return no("unknown event")
    if any(p.player_id == e.player_id for p in standing.values()):
        return no("already drafted")
    if not slots:
        return no("no schedule")
    if e.overall_pick is None and len(standing) >= len(slots):
        return no("draft complete")
    pick = slots[len(standing)].overall_pick if e.overall_pick is None else e.overall_pick
    if all(s.overall_pick != pick for s in slots):
        return no("no such pick")
    if pick in standing:
        return no("slot taken")
    found = _at(slots, pick, e.team_slot)
    return standing | {pick: Pick(e.player_id, found.team_slot, e.source == "manual")}, found


def _at(slots: list[Slot], pick: int, team: int | None) -> Decision:
    n = next(i for i, s in enumerate(slots) if s.overall_pick == pick)
    return Decision(pick, slots[n].round, n + 1, slots[n].team_slot if team is None else team, None)


def _folded(league: int | None, events: Iterable[Event], standing: Standing, slots: list[Slot]) -> Iterator[tuple[Standing, tuple]]:
    """The standing picks after each event, and its row of the output."""
    for e in events:
        standing, d = decide(standing, slots, e)
        yield standing, (league, e.event_id, e.action, e.player_id, d.team_slot, e.at, d.overall_pick, d.round, d.live_pick_no, len(standing), d.reason)


def packed_plan(plan: DataFrame) -> DataFrame:
    """(league_id, slots): a league's live slots in order, from the rows of its schedule."""
    live = plan.filter("live_pick_no is not null")
    slot = F.struct(F.col("live_pick_no").cast("int").alias("n"), F.col("overall_pick").cast("int").alias("overall_pick"), F.col("round").cast("int").alias("round"), F.col("team_slot").cast("int").alias("team_slot"))
    return live.groupBy(F.col("league_id").cast("long").alias("league_id")).agg(F.array_sort(F.collect_list(slot)).alias("slots"))


def heard(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of leagues that have an event; others have no part in a decision. Null is a league like any other."""
    leagues = events.select(F.col("league_id").cast("long").alias("_league")).distinct()
    return rows.join(leagues, F.col("league_id").eqNullSafe(F.col("_league")), "left_semi")


def _micros(events: DataFrame) -> DataFrame:
    named = "overall_pick" in events.columns
    return events.select(
        F.col("league_id").cast("long").alias("league_id"), F.col("event_id").cast("long").alias("event_id"), "action", F.col("player_id").cast("long").alias("player_id"), F.col("team_slot").cast("int").alias("team_slot"),
        "source", (F.col("overall_pick") if named else F.lit(None)).cast("int").alias("overall_pick"), F.unix_micros("picked_at").alias("at"), "picked_at",
    )


def _timed(decided: DataFrame) -> DataFrame:
    rest = [c.split()[0] for c in OUTPUT.split(", ")] + [c for c in decided.columns if c == "picks"]
    return decided.withColumn("picked_at", F.timestamp_micros("at")).select(*rest)


def fold_in_batch(events: DataFrame, plan: DataFrame) -> DataFrame:
    """Decisions on a whole log under the leagues' schedules.

    What stands is bounded by a schedule, but refused picks, undos and resets are not: a league's events are read in order
    after its schedule, batch by batch, and only its state is held; of a batch's schedules one at a time is unpacked, as
    those of leagues without events follow each other. Of rows with one id in a league the first in time counts. Null times
    come first; a league without a schedule refuses every pick."""
    names = ["event_id", "action", "player_id", "team_slot", "source", "overall_pick", "at"]
    rest = [c for c in names if c not in ("event_id", "at")]
    once = _micros(events).groupBy("league_id", "event_id").agg(F.min(F.struct("at", *rest)).alias("e")).select("league_id", "event_id", "e.*")
    both = once.unionByName(packed_plan(plan), allowMissingColumns=True).withColumn("is_plan", F.col("slots").isNotNull())
    order = ["league_id", F.desc("is_plan"), "at", "event_id"]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _DECIDED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        league, standing, slots = object(), {}, []
        for b in batches:
            columns, plans, rows = [b.column(c).to_pylist() for c in ("league_id", *names)], b.column("slots"), []
            for i, (of, *e) in enumerate(zip(*columns)):
                if of != league:
                    league, standing, slots = of, {}, []
                if plans[i].is_valid:
                    live = plans[i].values
                    slots = [Slot(*s) for s in zip(*(live.field(c).to_pylist() for c in Slot._fields))]
                    continue
                for standing, row in _folded(league, [Event(*e)], standing, slots):
                    rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    ordered = both.select("league_id", "slots", "is_plan", *names).repartition("league_id").sortWithinPartitions(*order)
    return _timed(ordered.mapInArrow(run, _DECIDED))


class _Draft(StatefulProcessor):
    """One league: its schedule, standing picks, seen ids, and events that the watermark has not passed."""

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getValueState("slots", "overall_picks array<int>, rounds array<int>, team_slots array<int>")
        self.standing = handle.getValueState("standing", "overall_picks array<int>, players array<long>, team_slots array<int>, manual array<boolean>")
        self.waiting = handle.getListState("waiting", "event_id long, action string, player_id long, team_slot int, source string, overall_pick int, at long")
        self.seen = handle.getMapState("seen", "event_id long", "at long")
        self.last = handle.getValueState("last", "at long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        slots = initialState["slots"].iloc[0]
        self.slots.update(([int(s["overall_pick"]) for s in slots], [int(s["round"]) for s in slots], [int(s["team_slot"]) for s in slots]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for part in rows:
            part = part.astype(object).where(part.notna(), None)
            whole = lambda x: None if x is None else int(x)
            for r in part.itertuples():
                new.append((whole(r.event_id), r.action, whole(r.player_id), whole(r.team_slot), r.source, whole(r.overall_pick), int(r.at)))
        self.waiting.appendList(new)
        newest = max(e[-1] for e in new)
        if self.last.exists():
            newest = max(newest, self.last.get()[0])
        self.last.update((newest,))
        self._wait(min(e[-1] for e in new))
        self._wait(newest + self.idle_us)
        return iter([])

    def _wait(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        every = [Event(*e) for e in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((e for e in every if e.at <= passed), key=lambda e: (e.at, e.event_id is not None, e.event_id or 0, *((x is not None, x if x is not None else 0) for x in (e.action, e.player_id, e.team_slot, e.source, e.overall_pick))))
        later = [e for e in every if e.at > passed]
        rows, standing = [], {}
        if due:
            if self.standing.exists():
                standing = {k: Pick(*p) for k, *p in zip(*self.standing.get())}
            slots = [Slot(*s) for s in zip(*self.slots.get())] if self.slots.exists() else []
            fresh, met = [], set()
            for e in due:
                if e.event_id not in met and not self.seen.containsKey((e.event_id,)):
                    fresh.append(e)
                met.add(e.event_id)
            for e in fresh:
                self.seen.updateValue((e.event_id,), (e.at,))
            for standing, row in _folded(key[0], fresh, standing, slots):
                rows.append(row)
            if rows:
                self.standing.update((list(standing), [p.player_id for p in standing.values()], [p.team_slot for p in standing.values()], [p.manual for p in standing.values()]))
            if later:
                self.waiting.put([tuple(e) for e in later])
                self._wait(min(e.at for e in later))
            else:
                self.waiting.clear()
        elif not later and self.last.exists() and self.last.get()[0] + self.idle_us <= passed:
            for state in (self.standing, self.waiting, self.seen, self.last):
                state.clear()  # the schedule stays
        if rows:
            picks = [None] * (len(rows) - 1) + [[{"overall_pick": k, "team_slot": p.team_slot, "player_id": p.player_id} for k, p in sorted(standing.items())]]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _DECIDED.split(", ")])
            yield out.astype({"league_id": "Int64", "player_id": "Int64", "team_slot": "Int32", "overall_pick": "Int32", "round": "Int32", "live_pick_no": "Int32", "standing": "Int32"}).assign(picks=picks)

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """List and map state and timers need the RocksDB store; a session setting, read when a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def decisions(events: DataFrame, plan: DataFrame, lateness: str = "10 minutes", idle_days: int = 60) -> DataFrame:
    """Decisions on a stream, in the order of event time: an event is decided when the watermark has passed it, and late ones
    are dropped. ``plan`` has the leagues' schedules, which become the first state. ``picks``, on the last row that a league
    has in a micro-batch, are all of its standing picks. ``idle_days`` after its last event a league starts anew."""
    use_state_store(events.sparkSession)
    clean = _micros(events).withWatermark("picked_at", lateness)
    out = clean.groupBy("league_id").transformWithStateInPandas(
        _Draft(idle_days * 86_400_000_000), f"{_DECIDED}, picks {_PICKS}", "append", "EventTime", initialState=packed_plan(plan).groupBy("league_id")
    )
    return _timed(out)


def standing_picks(decided: DataFrame) -> DataFrame:
    """(league_id, overall_pick, team_slot, player_id): the picks that stand at the last decision of each league in a
    micro-batch of :func:`decisions`."""
    last = decided.filter("picks is not null").groupBy("league_id").agg(F.max_by("picks", F.struct("picked_at", "event_id")).alias("picks"))
    return last.select("league_id", F.explode("picks").alias("p")).select("league_id", "p.*")


def standing_in_batch(decided: DataFrame) -> DataFrame:
    """The same of a whole log's decisions: picks after their league's last reset that no undo took back, by slots.

    The decisions are read once: a slot's last one and the league's last reset are few."""
    done = decided.filter("reason is null").withColumn("when", F.struct("picked_at", "event_id"))
    last = done.groupBy("league_id", "overall_pick").agg(F.max_by(F.struct("when", "action", "team_slot", "player_id"), "when").alias("p"))
    reset_at = F.max(F.when(F.col("p.action") == "reset", F.col("p.when"))).over(Window.partitionBy("league_id"))
    after = last.withColumn("reset_at", reset_at).filter("p.action = 'pick'").filter(F.col("reset_at").isNull() | (F.col("p.when") > F.col("reset_at")))
    return after.select("league_id", "overall_pick", "p.team_slot", "p.player_id")


def live_state(decided: DataFrame, plan: DataFrame) -> DataFrame:
    """After a micro-batch of decisions: picks that stand and who is on the clock, null when the draft is complete, for each
    league that the batch has an event of."""
    made = decided.groupBy("league_id").agg(F.max_by("standing", F.struct("picked_at", "event_id")).alias("picks_made"))
    nxt = plan.filter("live_pick_no is not null").select("league_id", (F.col("live_pick_no") - 1).cast("int").alias("picks_made"), "team_slot", "round")
    return made.join(nxt, ["league_id", "picks_made"], "left").select("league_id", "picks_made", "team_slot", "round")


def follow(stream: DataFrame, plan: DataFrame, path: str, board=None) -> DataFrame:
    """Process all that a stream of decisions has now, and keep these tables under ``path``:

    ``decisions`` and ``refused``: what stands or undoes and what was refused, a folder a micro-batch, so that a repeated
    one replaces itself; ``live``: picks made and who is on the clock. ``board``, a function of (standing picks, live state)
    of the leagues in a micro-batch that gives tables by name with a column league_id: their rows of these leagues are
    replaced, a partition a league, and the files of all other leagues stay as they are. Gives the live state of each league."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        at = f"{path}/all/batch={number}"
        batch.write.mode("overwrite").parquet(at)
        done = batch.sparkSession.read.schema(batch.schema).parquet(at)
        if done.isEmpty():
            return
        done.filter("reason is null").drop("picks").write.mode("overwrite").parquet(f"{path}/decisions/batch={number}")
        done.filter("reason is not null").drop("picks").write.mode("overwrite").parquet(f"{path}/refused/batch={number}")
        state = live_state(done, plan)
        state.write.mode("overwrite").parquet(f"{path}/live/batch={number}")
        if board is not None:
            state = batch.sparkSession.read.schema(state.schema).parquet(f"{path}/live/batch={number}")
            for name, rows in board(standing_picks(done), state).items():
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("league_id").parquet(f"{path}/{name}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    live = spark.read.option("basePath", f"{path}/live").parquet(f"{path}/live")
    last = F.max_by(F.struct("picks_made", "team_slot", "round"), "batch").alias("s")
    return live.groupBy("league_id").agg(last).select("league_id", "s.*")


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Process all that a stream has now, exactly once, to Parquet under ``path``, and read it back."""
    return run_counted(stream, path)[0]


class _Late(StreamingQueryListener):
    """Sums what the watermark drops, over every micro-batch of one query, until that query ends."""

    def __init__(self, name: str):
        self.name, self.n, self.run, self.ended = name, 0, None, threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = event.runId

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.name:
            self.n += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run:
            self.ended.set()


def run_counted(stream: DataFrame, path: str) -> tuple[DataFrame, int]:
    """As :func:`run_available`, and how many late events the watermark dropped."""
    spark, late = stream.sparkSession, _Late(f"picks-{uuid.uuid4().hex}")
    spark.streams.addListener(late)
    try:
        query = stream.writeStream.queryName(late.name).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        if not late.ended.wait(60):  # progress comes in order, and the end after it
            raise TimeoutError("the count of late events is not complete")
    finally:
        spark.streams.removeListener(late)
    return spark.read.schema(stream.schema).parquet(f"{path}/out"), late.n
