"""Projections from opportunity: shares of a team's work, efficiency pulled towards the position, and a team's budget.

Shares and rates are grouped by player, compared within (season, team) or a
position, and every ordered table (slots, draft rounds) is small by its nature.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.columns import clip, flag, ratio, running, total, zero
from fieldmark.operators import scoring
from fieldmark.operators.features import RECENCY, recency_weight

#: Opportunities at which a player's own rate counts half, by rate.
SHRINK = {"ypt": 170, "catch": 160, "rec_td": 155, "ypc": 800, "rush_td": 280, "ypa": 460, "pass_td": 1030, "pass_int": 240}
#: rate's numerator and opportunities.
RATES = {
    "ypt": ("receiving_yards", "targets"), "catch": ("receptions", "targets"), "rec_td": ("receiving_tds", "targets"), "ypc": ("rushing_yards", "carries"),
    "rush_td": ("rushing_tds", "carries"), "ypa": ("passing_yards", "attempts"), "pass_td": ("passing_tds", "attempts"), "pass_int": ("passing_interceptions", "attempts"),
}
QUALIFYING, ROOKIE_GAMES = 8, 8


def volume(lines: DataFrame, expected: DataFrame | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """Sums of what a player did in a season, and of what was expected of him."""
    stats = sorted({s for pair in RATES.values() for s in pair})
    sums = lines.groupBy("player_id", "season").agg(F.count("*").alias("games"), F.max("position").alias("position"), *[total(s).alias(s) for s in stats])
    if expected is None:
        return sums
    e = expected.groupBy("player_id", "season").agg(*[total(c).alias(c) for c in columns])
    return sums.join(e, ["player_id", "season"], "left").withColumns({c: zero(c) for c in columns})


def share_per_game(shares: DataFrame, team_games: Column, games: Column, columns: Sequence[str], least: int = QUALIFYING) -> DataFrame:
    """Share of a season's work as if every game had been played, between 0 and 1."""
    return shares.withColumns({f"{c}_pg": clip(F.col(c) * team_games / F.greatest(games, F.lit(least)), 0.0, 1.0) for c in columns})


def own_share(seasons: DataFrame, column: str, latest: int, least: int = QUALIFYING) -> DataFrame:
    """Recency-weighted share over seasons with enough games in the role of the last one."""
    role = F.max_by("role_key", "season").over(Window.partitionBy("player_id"))
    enough = seasons.filter(F.col("games") >= least).withColumn("role", role)
    w = recency_weight(F.col("season"), latest, RECENCY)
    same = enough.filter(F.col("role_key") == F.col("role"))
    g = same.groupBy("player_id").agg(F.sum(w * F.col(column)).alias("s"), F.sum(w).alias("w"), F.sum("games").alias("games"))
    return g.select("player_id", F.when(F.col("w") > 0, F.col("s") / F.col("w")).alias("own"), "games")


def slot_baseline(seasons: DataFrame, column: str, least: int = 8) -> DataFrame:
    """Mean share by position and depth rank where there are enough, never rising with depth."""
    m = seasons.groupBy("position", "depth_rank").agg(F.avg(column).alias("mean"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return m.withColumn("slot", F.min("mean").over(running(Window.partitionBy("position").orderBy("depth_rank")))).select("position", "depth_rank", "slot")


def slot_of(players: DataFrame, slots: DataFrame) -> DataFrame:
    """Each player's slot; ranks beyond the deepest known one take that one. Slots are one row a rank."""
    deepest = slots.groupBy("position").agg(F.max("depth_rank").alias("deepest"))
    p = players.join(F.broadcast(deepest), "position", "left").withColumn("_rank", F.least("depth_rank", "deepest"))
    s = slots.select(F.col("position").alias("_p"), F.col("depth_rank").alias("_d"), "slot")
    return p.join(F.broadcast(s), (F.col("position") == F.col("_p")) & (F.col("_rank") == F.col("_d")), "left").drop("_p", "_d", "_rank", "deepest")


def round_factors(rookies: DataFrame, column: str, low: float = 0.2, high: float = 1.0) -> DataFrame:
    """Mean by position and draft round relative to the first round, within bounds and never rising."""
    m = rookies.groupBy("position", "draft_round").agg(F.avg(column).alias("mean"))
    first = F.max(F.when(F.col("draft_round") == 1, F.col("mean"))).over(Window.partitionBy("position"))
    m = m.withColumn("factor", clip(ratio(F.col("mean"), first), low, high))
    return m.withColumn("factor", F.min("factor").over(running(Window.partitionBy("position").orderBy("draft_round")))).select("position", "draft_round", "factor")


def shrunk_rates(history: DataFrame, k: Mapping[str, int] = SHRINK) -> DataFrame:
    """Each rate as a mixture of a player's own and his position's, own weight n / (n + k).

    ``history``: player_id, position and sums; the position's rate is that of all its players together.  Those means are
    one row a position, so they are broadcast."""
    means = history.groupBy(F.col("position").alias("_position")).agg(*[ratio(F.sum(a), F.sum(n), 0.0).alias(f"_{name}") for name, (a, n) in RATES.items()])
    both = history.join(F.broadcast(means), F.col("position").eqNullSafe(F.col("_position")))
    out = {}
    for name, (a, n) in RATES.items():
        own, mean = ratio(F.col(a), F.col(n)), F.col(f"_{name}")
        w = F.col(n) / (F.col(n) + k[name])
        out[name] = w * F.coalesce(own, mean) + (1 - w) * mean
    return both.select("player_id", "position", *[c.alias(name) for name, c in out.items()])


def efficiency_history(seasons: DataFrame) -> DataFrame:
    """Sums over seasons in the role of the last season; over all seasons for players who have none such with work."""
    stats = sorted({s for pair in RATES.values() for s in pair})
    player = Window.partitionBy("player_id")
    role = seasons.withColumn("role", F.max_by("role_key", "season").over(player))
    role = role.withColumn("same", flag((F.col("role_key") == F.col("role")) & (F.col("targets") + F.col("carries") + F.col("attempts") > 0)))
    used = role.withColumn("any", F.max("same").over(player)).filter(F.col("same") | ~F.col("any"))
    return used.groupBy("player_id").agg(F.max_by("position", "season").alias("position"), *[F.sum(s).alias(s) for s in stats])


def stability(seasons: DataFrame, name: str, least: int = 25, pairs: int = 15) -> DataFrame:
    """How a rate repeats: correlation of a season's with the next one's, both less their position's mean, and the
    opportunities at which own and position's rates weigh the same."""
    a, n = RATES[name]
    r = seasons.filter(F.col(n) >= least).withColumn("rate", F.col(a) / F.col(n))
    r = r.withColumn("centred", F.col("rate") - F.avg("rate").over(Window.partitionBy("season", "position"))).select("player_id", "season", "centred", F.col(n).cast("double").alias("n"))
    nxt = r.select("player_id", (F.col("season") - 1).alias("season"), F.col("centred").alias("after"), F.col("n").alias("n2"))
    both = r.join(nxt, ["player_id", "season"])
    out = both.groupBy().agg(F.count("*").alias("pairs"), F.corr("centred", "after").alias("r"), (2 / F.avg(1 / F.col("n") + 1 / F.col("n2"))).alias("n"))
    fine = (F.col("pairs") >= pairs) & (F.col("r") > 0)
    return out.select(F.lit(name).alias("rate"), "pairs", "r", F.when(fine, F.col("n") * (1 - F.col("r")) / F.col("r")).alias("k"))


def share_source(players: DataFrame) -> DataFrame:
    """Own share and slot mixed by games; rookies by slot and draft round; the rest by slot. Backup passers get the slot."""
    v = F.when(F.col("slot").isNull(), 1.0).otherwise(F.col("own_games") / (F.col("own_games") + ROOKIE_GAMES))
    backup = (F.col("position") == "QB") & (F.col("depth_rank") > 1)
    mixed = v * F.col("own") + (1 - v) * zero("slot")
    share = F.when(backup, F.col("slot")).when(F.col("own").isNotNull(), mixed).when(F.col("is_rookie"), F.col("slot") * F.coalesce("factor", F.lit(1.0))).otherwise(F.col("slot"))
    source = F.when(backup, "slot").when(F.col("own").isNotNull(), "own").when(F.col("is_rookie"), "rookie").otherwise("slot")
    return players.withColumns({"share": zero(share), "share_source": source})


def measured_budget(shares: DataFrame, column: str, team_games: int = 17, games: int = 3, least: float = 0.01) -> DataFrame:
    """Median over teams of the per-game shares of those who took part, added up: more than 1, as players miss games."""
    real = shares.filter((F.col("games") >= games) & (F.col(column) >= least)).withColumn("pg", F.col(column) * team_games / F.col("games"))
    return real.groupBy("season", "team").agg(F.sum("pg").alias("sum")).groupBy().agg(F.percentile("sum", F.lit(0.5)).alias("budget"))


def fit_to_budget(players: DataFrame, budget: float | Column | DataFrame, redistribute: bool = True, most_gain: float = 0.5) -> DataFrame:
    """A team's free share goes to its players by share, none gaining over half of his own; then teams over budget are scaled down.

    ``budget`` may be the one row of :func:`measured_budget`; one without teams to measure counts as 1."""
    if isinstance(budget, DataFrame):
        one = budget.select(F.coalesce("budget", F.lit(1.0)).alias("_budget"))
        return fit_to_budget(players.join(F.broadcast(one), how="cross"), F.col("_budget"), redistribute, most_gain).drop("_budget")  # one row
    team = Window.partitionBy("team")
    had = F.sum("share").over(team)
    gain = F.least(F.col("share") / had * F.greatest(F.lit(0.0), F.lit(budget) - had), most_gain * F.col("share")) if redistribute else F.lit(0.0)
    out = players.withColumn("gain", F.when(F.col("team").isNotNull() & (had > 0), gain).otherwise(0.0)).withColumn("share", F.col("share") + F.col("gain"))
    now = F.sum("share").over(team)
    scale = F.when(F.col("team").isNotNull() & (now > budget), F.lit(budget) / now).otherwise(1.0)
    return out.withColumn("cap_scale", scale).withColumn("share", F.col("share") * F.col("cap_scale"))


def context_factor(position: Column, qb_tier: Column, unsettled: Column, line_delta: Column, new_caller: Column) -> Column:
    """Effect of a team's passer, line and play-caller, between 0.94 and 1.06."""
    catcher = position.isin("RB", "WR", "TE")
    tier = F.when(qb_tier == 1, 0.04).when(qb_tier == 2, 0.02).when(qb_tier == 4, -0.03).otherwise(0.0)
    out = F.lit(1.0) + F.when(catcher, tier + F.when(unsettled, -0.02).otherwise(0.0)).otherwise(0.0)
    out = out + zero(line_delta) * F.when(position == "QB", 0.015).when(position == "RB", 0.010).otherwise(0.0) + F.when(new_caller, -0.01).otherwise(0.0)
    return F.round(clip(out, 0.94, 1.06), 4)


def points_per_game(players: DataFrame, age_factor: Column, context: Column, **rules) -> DataFrame:
    """Work a game times efficiency, as points under a league's rules, with age and context.

    ``players``: targets_pg, carries_pg, attempts_pg, the rates and position; ``rules`` go to :func:`scoring.points`
    (weights, whole yards, overrides by position). Bonuses are a matter of single games and are not added here."""
    work = {"targets": "targets_pg", "carries": "carries_pg", "attempts": "attempts_pg"}
    line = players.withColumns({stat: F.col(work[n]) * F.col(rate) for rate, (stat, n) in RATES.items()})
    points = scoring.points(bonuses=None, position=F.col("position"), **rules)
    scored = scoring.adapt(line).select(*[F.col(c) for c in players.columns if c not in RATES], points.alias("_points"))
    return scored.withColumn("inhouse_ppg", F.col("_points") * age_factor * context).drop("_points")
