"""The draft board: rows, live order, horizons, rosters, slot weights and panels. All by league."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.columns import flag, zero
from fieldmark.operators.valuation import BENCH, FLEX, FLEX_POSITIONS, NO_VALUE, SLOTS, leave_one_out, p_available
from fieldmark.sources.settled import settle

LATE_ROUND = 12


def rows(ranked: DataFrame, picks: DataFrame, keepers: DataFrame, my_slot: int) -> DataFrame:
    """Board rows with who drafted or kept each player; ``value`` is value over replacement."""
    p = picks.select(F.col("league_id").alias("_l"), F.col("player_id").alias("_p"), F.col("team_slot").alias("_slot"), F.col("overall_pick"))
    k = keepers.select(F.col("league_id").alias("_kl"), F.col("player_id").alias("_kp"), F.col("team_slot").alias("_kslot"))
    out = ranked.join(p, (F.col("league_id") == F.col("_l")) & (F.col("player_id") == F.col("_p")), "left").join(k, (F.col("league_id") == F.col("_kl")) & (F.col("player_id") == F.col("_kp")), "left")
    owner = F.coalesce("_kslot", "_slot")
    tags = F.array_compact(F.array(F.when(F.col("_kslot").isNotNull(), "kept"), F.when(F.col("_slot").isNotNull(), "drafted"), F.when(owner == my_slot, "mine")))
    return out.withColumns({"value": F.col("vorp"), "owner": owner, "drafted": owner.isNotNull(), "is_mine": flag(owner == my_slot), "tags": tags}).drop("_l", "_p", "_kl", "_kp", "_slot", "_kslot")


def undrafted(ranked: DataFrame, picks: DataFrame, keepers: DataFrame) -> DataFrame:
    return ranked.join(picks, ["league_id", "player_id"], "left_anti").join(keepers, ["league_id", "player_id"], "left_anti")


def live_room(free: DataFrame, made: DataFrame) -> DataFrame:
    """Room order of those left, counted on from the picks made; unknown for those without a draft position, who stay."""
    n = F.row_number().over(Window.partitionBy("league_id").orderBy(F.asc_nulls_last("adp"), "player_id"))
    both = free.join(made.select("league_id", "picks_made"), "league_id", "left")
    return both.withColumn("live_adp", F.when(F.col("adp").isNotNull(), n + zero("picks_made"))).drop("picks_made")


def horizon(plan: DataFrame, made: DataFrame, slot: int) -> DataFrame:
    """Per league: picks_made, the last pick before the one that we decide about, and that one's round.

    We decide about our next pick, or about the one after while we are on the clock; at our last pick there is no other.
    Leagues where we have no pick left have a null horizon."""
    live = plan.filter("live_pick_no is not null").join(made.select("league_id", "picks_made"), "league_id", "left").withColumn("picks_made", zero("picks_made"))
    mine = (F.col("team_slot") == slot) & (F.col("live_pick_no") > F.col("picks_made"))
    at = F.struct("live_pick_no", "round")
    both = live.groupBy("league_id").agg(F.max("picks_made").alias("picks_made"), F.min(F.when(mine, at)).alias("first"), F.min(F.when(mine & (F.col("live_pick_no") > F.col("picks_made") + 1), at)).alias("second"))
    target = F.coalesce("second", "first")
    return both.select("league_id", "picks_made", (target["live_pick_no"] - 1).alias("horizon"), target["round"].alias("horizon_round"))


def _there(default: float | None) -> Column:
    """Chance to be there at the horizon of a player with a room order, and ``default`` without one."""
    sd = F.coalesce(F.nullif(F.col("sd_adp"), F.lit(0.0)), F.lit(10.0))
    p = F.when(F.col("horizon").isNull(), None).when(F.col("live_adp").isNull(), F.lit(default)).when(F.col("horizon") <= F.col("picks_made"), 1.0)
    return p.otherwise(p_available(F.col("horizon"), F.col("live_adp").cast("double"), sd))


def live_chance(free: DataFrame, at: DataFrame) -> DataFrame:
    """Chance to be there at the horizon: unknown without a draft position or a horizon, sure if nobody picks before, and
    with a deviation of 10 where none is known."""
    return free.join(at, "league_id").withColumn("p", _there(None))


def roster(picked: DataFrame, teams: DataFrame | None = None) -> DataFrame:
    """By league and team: open places by position, open flexible ones, bench by position. ``picked`` has position, keepers
    among them; teams of ``teams`` (league_id, team_slot) without players have all places open."""
    n = picked.groupBy("league_id", "team_slot").pivot("position", list(SLOTS)).agg(F.count(F.lit(1)))
    if teams is not None:
        n = teams.select("league_id", "team_slot").distinct().join(n, ["league_id", "team_slot"], "full")
    have = {p: zero(p) for p in SLOTS}
    surplus = sum([F.greatest(have[p] - SLOTS[p], F.lit(0)) for p in FLEX_POSITIONS[1:]], F.greatest(have[FLEX_POSITIONS[0]] - SLOTS[FLEX_POSITIONS[0]], F.lit(0)))
    return n.select(
        "league_id", "team_slot", *[F.greatest(F.lit(SLOTS[p]) - have[p], F.lit(0)).alias(f"open_{p}") for p in SLOTS], F.greatest(FLEX - surplus, F.lit(0)).alias("open_FLEX"),
        *[F.greatest(have[p] - SLOTS[p], F.lit(0)).alias(f"bench_{p}") for p in SLOTS],
    )


def bye_stacks(picked: DataFrame, byes: DataFrame, least: int = 3) -> DataFrame:
    """Weeks in which a team lacks at least ``least`` of its players."""
    return picked.join(byes, "team").groupBy("league_id", "team_slot", "bye").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("player_id")).alias("players")).filter(F.col("n") >= least)


def slot_weight(position: Column, open_: Column, open_flex: Column, depth: Column) -> Column:
    """What another player of the position is worth to a roster with so many open places and a bench so deep."""
    needed = (open_ > 0) | (position.isin(*FLEX_POSITIONS) & (open_flex > 0))
    deep = F.greatest(F.lit(0.10), 0.35 * F.pow(F.lit(0.55), F.greatest(depth - 1, F.lit(0))))
    return F.when(needed, 1.0).when(position.isin(*NO_VALUE), 0.03).when(position == "QB", 0.15).otherwise(F.round(deep, 3))


def position_weights(rosters: DataFrame, slot: int) -> DataFrame:
    """(league_id, position, slot_weight) of our team's roster, see :func:`roster`."""
    each = F.array(*[F.struct(F.lit(p).alias("position"), F.col(f"open_{p}").alias("open"), F.col("open_FLEX").alias("flex"), F.col(f"bench_{p}").alias("bench")) for p in SLOTS])
    rows = rosters.filter(F.col("team_slot") == slot).select("league_id", F.explode(each).alias("r"))
    return rows.select("league_id", "r.position", slot_weight(F.col("r.position"), F.col("r.open"), F.col("r.flex"), F.col("r.bench")).alias("slot_weight"))


def live_vona(free: DataFrame, weights: DataFrame) -> DataFrame:
    """Those that have a value, with the best other one expected at the horizon in the same position, and what a player is
    worth over him, weighted by what our roster needs. If nobody picks before the horizon no other one counts.

    ``free`` has live_adp and the league's horizon; where there is none, vona is null."""
    c = free.filter(F.col("vorp").isNotNull() & ~F.col("position").isin(*NO_VALUE)).withColumns({"value": F.greatest("vorp", F.lit(0.0)), "p_other": _there(1.0)})
    c = leave_one_out(c.withColumn("p_other", zero("p_other")), ["league_id", "position"], p="p_other").drop("p_other").join(weights, ["league_id", "position"], "left")
    best = F.when(F.col("horizon") > F.col("picks_made"), F.col("others_best")).when(F.col("horizon").isNotNull(), 0.0)
    return c.withColumn("others_best", best).withColumn("vona", F.col("slot_weight") * (F.col("value") - F.col("others_best")))


def panel(free: DataFrame, round_now: Column, k: int = 5) -> DataFrame:
    """The first of each position by value; kickers and defences by draft position, and only late."""
    none = F.col("position").isin(*NO_VALUE)
    order = [F.when(none, 0).otherwise(1), F.when(none, F.coalesce("adp", F.lit(1e9))).otherwise(-F.col("vorp")), F.col("player_id")]
    n = F.row_number().over(Window.partitionBy("league_id", "position").orderBy(*order))
    return free.filter(~none | (round_now >= LATE_ROUND)).withColumn("place", n).filter(F.col("place") <= k)


def live_tables(ranked: DataFrame, plan: DataFrame, kept: DataFrame, standing: DataFrame, live: DataFrame, slot: int, k: int = 3) -> dict[str, DataFrame]:
    """What a draft's screen shows of the leagues in ``live`` (league_id, picks_made), for our team at ``slot``:

    ``rosters``, places of every team; ``board``, each player left with his room order, chance and value over the best
    other one; ``panel``, the first ``k`` of each position. All work is within those leagues: other rows of ``ranked``,
    ``plan``, ``kept`` (league_id, team_slot, player_id) and ``standing`` are filtered before anything is sorted."""
    of = lambda df: df.join(F.broadcast(live.select("league_id")), "league_id", "left_semi")  # noqa: E731  the leagues of a micro-batch
    ranked, plan, kept, standing = of(ranked), of(plan), of(kept), of(standing)
    held = kept.select("league_id", "team_slot", "player_id").unionByName(standing.select("league_id", "team_slot", "player_id"))
    rosters = roster(held.join(ranked.select("league_id", "player_id", "position"), ["league_id", "player_id"]), plan)
    free = live_room(undrafted(ranked, standing.select("league_id", "player_id"), kept.select("league_id", "player_id")), live)
    chance = settle(live_chance(free, horizon(plan, live, slot)), "chances")  # read for values, for board and for panel
    vona = live_vona(chance, position_weights(rosters, slot)).select("league_id", "player_id", "slot_weight", "others_best", "vona")
    board = chance.join(vona, ["league_id", "player_id"], "left")
    shown = panel(board.filter("horizon is not null"), F.col("horizon_round"), k)
    return {
        "rosters": rosters, "board": board.select("league_id", "player_id", "position", "live_adp", "p", "slot_weight", "others_best", "vona"),
        "panel": shown.select("league_id", "position", "place", "player_id", "p", "others_best", "vona"),
    }


def team_rosters(plan: DataFrame, picks: DataFrame) -> DataFrame:
    """Every team's players: keepers in their holes, and picks, in the order made, at the schedule's live slots, with the team
    that made each and whether it was on turn. Slots to come have no player. ``picks``: league_id, player_id, team_slot,
    overall_pick."""
    made = picks.withColumn("live_pick_no", F.row_number().over(Window.partitionBy("league_id").orderBy("overall_pick", "player_id")).cast("long"))
    made = made.select("league_id", "live_pick_no", F.col("player_id").alias("picked"), F.col("team_slot").alias("picked_by"))
    both = plan.join(made, ["league_id", "live_pick_no"], "left")
    return both.select(
        "league_id", "overall_pick", "round", "live_pick_no", "team_slot", F.coalesce("keeper_player_id", "picked").alias("player_id"), F.col("keeper_player_id").isNotNull().alias("is_keeper"), "picked_by",
        F.when(F.col("picked").isNotNull(), F.col("picked_by") == F.col("team_slot")).alias("on_turn"),
    )


def drift(placed: DataFrame) -> DataFrame:
    """Live picks that each team should have made so far and has made, idle teams too, and whether they differ."""
    made = placed.filter("picked_by is not null")
    teams = placed.select("league_id", "team_slot").distinct()
    want = made.groupBy("league_id", "team_slot").agg(F.count("*").alias("expected"))
    have = made.groupBy("league_id", F.col("picked_by").alias("team_slot")).agg(F.count("*").alias("actual"))
    both = teams.join(want, ["league_id", "team_slot"], "full").join(have, ["league_id", "team_slot"], "full")
    return both.select("league_id", "team_slot", zero("expected").alias("expected"), zero("actual").alias("actual"), (zero("expected") != zero("actual")).alias("offender"))


def lineup_tally(picked: DataFrame) -> DataFrame:
    """Per team: fixed places filled, flexible ones filled, and the bench."""
    n = picked.groupBy("league_id", "team_slot", "position").agg(F.count("*").alias("n"))
    places = F.create_map(*[x for p, c in SLOTS.items() for x in (F.lit(p), F.lit(c))])
    fixed = F.least("n", F.coalesce(places[F.col("position")], F.lit(0)))
    over = F.when(F.col("position").isin(*FLEX_POSITIONS), F.col("n") - fixed).otherwise(0)
    g = n.groupBy("league_id", "team_slot").agg(F.sum(fixed).alias("fixed"), F.sum(over).alias("over"), F.sum("n").alias("players"))
    flex = F.least("over", F.lit(FLEX).cast("long"))
    return g.select("league_id", "team_slot", "fixed", flex.alias("flex"), (F.col("players") - F.col("fixed") - flex).alias("bench"), (F.col("players") > sum(SLOTS.values()) + FLEX + BENCH).alias("over_full"))


def sort_board(board: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Nulls last either way, ties by rank."""
    return board.orderBy(F.desc_nulls_last(by) if descending else F.asc_nulls_last(by), "overall_rank")


def filter_board(board: DataFrame, position: str | None = None, marks: Sequence[str] = (), hide_drafted: bool = False, search: str = "") -> DataFrame:
    """Rows of a position, with all of the given flags, still free, and whose name, team and position hold a text in any case."""
    if position:
        board = board.filter(F.col("position") == position)
    for m in marks:
        board = board.filter(flag(F.array_contains("flags", m)))
    if hide_drafted:
        board = board.filter(~flag(F.col("drafted")))
    text = search.strip().lower()
    if text:
        hay = F.lower(F.concat_ws(" ", "name", F.coalesce("team", F.lit("")), "position"))
        board = board.filter(F.contains(hay, F.lit(text)))
    return board


def best_available(board: DataFrame, round_now: Column | None = None) -> DataFrame:
    """Each league's highest-ranked player who is still free. Kickers and defences are held back until their rounds, also
    where the round is not known, unless nobody else is left."""
    free = board.filter(~flag(F.col("drafted")))
    late = flag(round_now >= LATE_ROUND) if round_now is not None else F.lit(False)
    held_back = F.col("position").isin(*NO_VALUE) & ~late
    first = F.min(F.struct(held_back.alias("held_back"), "overall_rank", "player_id")).alias("first")
    return free.groupBy("league_id").agg(first).select("league_id", "first.player_id", "first.overall_rank")


def profiles(players: DataFrame, facets: Mapping[str, tuple[DataFrame, Sequence[str]]], context: DataFrame | None = None) -> DataFrame:
    """One nested row a player: ``players`` (player_id, team, ...) with an array of each facet's rows, in order.

    A facet is (rows with player_id, the columns that order them); its other columns become structs. All facets travel as one
    tagged union to one grouping by player, so each is shuffled once however many there are; facets of one row are arrays of
    one. ``context``, a row a team, is broadcast: teams are a league's few dozen. Players without rows have empty arrays;
    rows of unknown players are left out."""
    cells = {n: F.struct(*order, *[c for c in df.columns if c not in ("player_id", *order)]) for n, (df, order) in facets.items()}
    own = F.struct(*[c for c in players.columns if c != "player_id"])
    empty = {n: F.lit(None).cast(df.select(cells[n]).schema[0].dataType) for n, (df, _) in facets.items()}
    nobody = F.lit(None).cast(players.select(own).schema[0].dataType)
    parts = [players.select("player_id", own.alias("_own"), *[e.alias(n) for n, e in empty.items()])]
    for name, (df, _) in facets.items():
        parts.append(df.select("player_id", nobody.alias("_own"), *[(cells[n] if n == name else e).alias(n) for n, e in empty.items()]))
    every = reduce(lambda x, y: x.unionByName(y), parts)
    out = every.groupBy("player_id").agg(F.first("_own", True).alias("_own"), *[F.array_sort(F.collect_list(n)).alias(n) for n in facets]).filter("_own is not null").select("player_id", "_own.*", *facets)
    if context is not None:
        out = out.join(F.broadcast(context.select(F.col("team").alias("_team"), F.struct(*[c for c in context.columns if c != "team"]).alias("context"))), F.col("team") == F.col("_team"), "left").drop("_team")
    return out
