"""Snake schedules, turns, keepers, and the log of picks folded in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.names import normal_name
from fieldmark.functions.columns import flag, running, zero
from fieldmark.operators.valuation import expected_best, p_available


def snake_slot(overall: Column, teams: Column) -> Column:
    """Slot on turn at an overall pick: every second round runs backwards."""
    rnd, at = F.floor((overall - 1) / teams), F.pmod(overall - 1, teams)
    return F.when(rnd % 2 == 0, at + 1).otherwise(teams - at)


def schedule(leagues: DataFrame, keepers: DataFrame | None = None) -> DataFrame:
    """Every pick of each league (league_id, teams, rounds); kept ones are holes, and live ones are numbered without gaps.

    ``keepers``: league_id, team_slot, cost_round, player_id. See :func:`keeper_faults` for rows that do not fit."""
    every = leagues.select("league_id", F.col("teams").cast("long").alias("teams"), F.explode(F.sequence(F.lit(1).cast("long"), (F.col("teams") * F.col("rounds")).cast("long"))).alias("overall_pick"))
    every = every.withColumns({"round": F.floor((F.col("overall_pick") - 1) / F.col("teams")).cast("int") + 1, "team_slot": snake_slot(F.col("overall_pick"), F.col("teams")).cast("int")})
    if keepers is None:
        out = every.withColumns({"keeper_player_id": F.lit(None).cast("long")})
    else:
        k = keepers.select(F.col("league_id").alias("_l"), F.col("team_slot").alias("_s"), F.col("cost_round").alias("_r"), F.col("player_id").alias("keeper_player_id"))
        out = every.join(k, (F.col("league_id") == F.col("_l")) & (F.col("team_slot") == F.col("_s")) & (F.col("round") == F.col("_r")), "left").drop("_l", "_s", "_r")
    live = F.col("keeper_player_id").isNull()
    number = F.sum(live.cast("int")).over(running(Window.partitionBy("league_id").orderBy("overall_pick")))
    return out.withColumns({"is_keeper": ~live, "live_pick_no": F.when(live, number)}).drop("teams")


def keeper_faults(leagues: DataFrame, keepers: DataFrame) -> DataFrame:
    """Keepers that no schedule can hold: out of range, or two for one team's round."""
    k = keepers.join(leagues.select("league_id", "teams", "rounds"), "league_id", "left")
    outside = ~flag((F.col("team_slot") >= 1) & (F.col("team_slot") <= F.col("teams")) & (F.col("cost_round") >= 1) & (F.col("cost_round") <= F.col("rounds")))
    n = F.count("*").over(Window.partitionBy("league_id", "team_slot", "cost_round"))
    fault = F.when(outside, "out of range").when(n > 1, "duplicate")
    return k.withColumn("fault", fault).filter(F.col("fault").isNotNull()).select("league_id", "team_slot", "cost_round", "player_id", "fault")


def turns(plan: DataFrame, slot: int) -> DataFrame:
    """A team's live picks with its next one and how many live picks lie between."""
    mine = plan.filter((F.col("team_slot") == slot) & F.col("live_pick_no").isNotNull())
    w = Window.partitionBy("league_id").orderBy("overall_pick")
    nxt = F.lead("live_pick_no").over(w)
    return mine.select("league_id", "round", "overall_pick", "live_pick_no", F.lead("overall_pick").over(w).alias("next_pick"), (nxt - F.col("live_pick_no") - 1).alias("picks_until_next"))


def on_clock(plan: DataFrame, made: DataFrame) -> DataFrame:
    """The first live pick after those made, per league (league_id, picks_made); leagues that are done have none."""
    live = plan.filter("live_pick_no is not null").join(made, "league_id", "left")
    nxt = live.filter(F.col("live_pick_no") == zero("picks_made") + 1)
    return nxt.select("league_id", "overall_pick", "round", "team_slot", zero("picks_made").alias("picks_made"))


def turn_plan(candidates: DataFrame, picks: DataFrame, k: int = 5, least: float = 0.25) -> DataFrame:
    """The best ``k`` candidates with a fair chance to be there, at each of a team's picks; a league's picks are few."""
    both = candidates.join(picks.select("league_id", "overall_pick", "round"), "league_id")
    both = both.withColumn("p", p_available(F.col("overall_pick"), F.col("adp"), F.col("sd_adp"))).filter(F.col("p") >= least)
    w = Window.partitionBy("league_id", "overall_pick").orderBy(F.desc("vorp"), "player_id")
    return both.withColumn("choice", F.row_number().over(w)).filter(F.col("choice") <= k)


def best_by_round(pool: DataFrame, plan: DataFrame) -> DataFrame:
    """Expected best value by round: mean, least and greatest over the slots' live picks.

    Only candidates above their baseline meet the picks: the others are worth 0, come after all of these, and add nothing.
    A baseline is set by a league's starters, so they are few however many players there are. Without any, 0 is expected."""
    picks = plan.filter("live_pick_no is not null").select("league_id", "round", F.col("overall_pick").alias("pick"))
    each = picks.join(pool.filter("vorp > 0").select("league_id", "player_id", F.col("vorp").alias("value"), "adp", "sd_adp"), "league_id", "left")
    each = each.withColumn("p", p_available(F.col("pick"), F.col("adp"), F.col("sd_adp")))
    best = expected_best(each, ["league_id", "round", "pick"]).withColumn("expected_best", F.coalesce("expected_best", F.lit(0.0)))
    return best.groupBy("league_id", "round").agg(F.avg("expected_best").alias("mean"), F.min("expected_best").alias("least"), F.max("expected_best").alias("greatest"))


def keeper_surplus(candidates: DataFrame, by_round: DataFrame) -> DataFrame:
    """Value over what each round is expected to give, and the first round where that is positive."""
    both = candidates.join(by_round.select("league_id", "round", "mean"), "league_id").withColumn("surplus", F.round(F.col("vorp") - F.col("mean"), 3))
    first = F.min(F.when(F.col("surplus") > 0, F.col("round"))).over(Window.partitionBy("league_id", "player_id"))
    return both.withColumn("break_even", first)


def surplus_wide(surplus: DataFrame, rounds: int) -> DataFrame:
    return surplus.groupBy("league_id", "player_id", "break_even").pivot("round", list(range(1, rounds + 1))).agg(F.first("surplus"))


#: The two verdicts.
KEEP, INSTEAD = "KEEP", "DRAFT INSTEAD"


def keeper_report(candidates: DataFrame, people: DataFrame, surplus: DataFrame) -> DataFrame:
    """Per candidate (league_id, name, cost_round): the player of that normalised name, the least id where several have it,
    his surplus at the cost round, and the verdict. Names that nobody has stay, with ``found`` false and no verdict."""
    known = people.select("league_id", "player_id", normal_name(F.col("name")).alias("name_norm")).groupBy("league_id", "name_norm").agg(F.min("player_id").alias("player_id"))
    at = surplus.select("league_id", "player_id", F.col("round").alias("cost_round"), "surplus", "break_even")
    asked = candidates.withColumn("name_norm", normal_name(F.col("name"))).join(known, ["league_id", "name_norm"], "left").join(at, ["league_id", "player_id", "cost_round"], "left")
    found = F.col("player_id").isNotNull()
    verdict = F.when(found, F.when(F.col("surplus") > 0, KEEP).otherwise(INSTEAD))
    return asked.select("league_id", "name", "cost_round", found.alias("found"), "player_id", "surplus", "break_even", verdict.alias("verdict"))


def keeper_verdict(surplus: DataFrame, cost: DataFrame, luck: DataFrame, production: DataFrame) -> DataFrame:
    """Keep where the value is above what the asked round gives, else draft instead; with the signals that either table has."""
    signals = luck.join(production, "player_id", "full")
    at = surplus.join(cost, ["league_id", "player_id"]).filter(F.col("round") == F.col("cost_round"))
    verdict = F.when(F.col("surplus") > 0, KEEP).otherwise(INSTEAD)
    return at.join(signals, "player_id", "left").withColumn("verdict", verdict)
