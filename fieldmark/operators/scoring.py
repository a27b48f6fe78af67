"""Scoring stat lines under the rules of many leagues at once.

A league is a row: weights by stat, bonus tiers, and switches.  Rules reach
the lines through one broadcast join (leagues are configuration: their number
is checked) and all arithmetic is column expressions, so a line is read once
however many leagues score it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.columns import zero

#: Weights of the default league.
WEIGHTS = {
    "pass_yd": 0.04, "pass_td": 6.0, "pass_int": -2.0, "two_pt": 2.0, "rush_yd": 0.1, "rush_td": 6.0, "rec": 0.5, "rec_yd": 0.1, "rec_td": 6.0,
    "fum_lost": -2.0, "ret_td": 6.0,
}
#: Bonus tiers of the default league, (threshold, points) by stat.
BONUSES = {
    "pass_yd": ((350, 1.0), (400, 2.0), (425, 3.0)),
    "rush_yd": ((100, 1.0), (150, 2.0), (200, 3.0)),
    "rec_yd": ((100, 1.0), (150, 2.0), (200, 3.0)),
}
#: Yards for a point follow the fractional switch for these stats.
YARDAGE = ("pass_yd", "rush_yd", "rec_yd")
#: Source columns by stat; the first present one counts, and a tuple is a sum.
ALIASES: dict[str, Sequence[str | tuple[str, ...]]] = {
    "pass_yd": ("passing_yards", "pass_yd"), "pass_td": ("passing_tds", "pass_td"), "pass_int": ("passing_interceptions", "interceptions", "pass_int"),
    "rush_yd": ("rushing_yards", "rush_yd"), "rush_td": ("rushing_tds", "rush_td"), "rec": ("receptions", "rec"), "rec_yd": ("receiving_yards", "rec_yd"),
    "rec_td": ("receiving_tds", "rec_td"), "fum_lost": ("fumbles_lost_total", "fumbles_lost", "fum_lost"), "ret_td": ("special_teams_tds", "ret_td"),
    "two_pt": (("passing_2pt_conversions", "rushing_2pt_conversions", "receiving_2pt_conversions"), "two_pt"),
}
REQUIRED = ("pass_yd", "pass_td", "rush_yd", "rush_td", "rec", "rec_yd", "rec_td")
MOST_LEAGUES = 100_000


def adapt(lines: DataFrame, aliases: Mapping = ALIASES, required: Sequence[str] = REQUIRED) -> DataFrame:
    """``lines`` with one column a stat, nulls as 0; columns are resolved from the schema alone.

    Raises ValueError if a required stat has no source column; other stats are then 0."""
    have, stats = set(lines.columns), {}
    for stat, sources in aliases.items():
        for s in sources:
            parts = (s,) if isinstance(s, str) else tuple(p for p in s if p in have)
            if parts and set(parts) <= have:
                stats[stat] = reduce(lambda a, b: a + b, [zero(p).cast("double") for p in parts])
                break
        else:
            if stat in required:
                raise ValueError(f"no source column for {stat} among {sorted(have)}")
            stats[stat] = F.lit(0.0)
    return lines.withColumns(stats)


def leagues(df: DataFrame) -> DataFrame:
    """Configuration rows, after a check that they are few enough to broadcast."""
    n = df.limit(MOST_LEAGUES + 1).count()
    if n > MOST_LEAGUES:
        raise ValueError(f"more than {MOST_LEAGUES} leagues; score them in parts")
    return F.broadcast(df)


def _weight(weights, stat: str, position: Column | None, overrides) -> Column:
    w = weights[stat] if isinstance(weights, Column) else F.lit(float(weights.get(stat, 0.0)))
    w = zero(w)
    for pos, own in (overrides or {}).items():
        if stat in own and position is not None:
            w = F.when(position == pos, F.lit(float(own[stat]))).otherwise(w)
    return w


def stat_points(stat: str, weight: Column, fractional: Column | bool = True) -> Column:
    """Points of a stat; whole-yard leagues give a point for every full 1/weight yards, either sign."""
    plain = F.col(stat) * weight
    if stat not in YARDAGE or fractional is True:
        return plain
    per = F.lit(1.0) / weight
    whole = F.when(weight != 0, F.signum(stat) * F.floor(F.abs(stat) / per + 1e-9)).otherwise(F.lit(0.0))
    return F.when(fractional, plain).otherwise(whole) if isinstance(fractional, Column) else whole


def bonus_points(bonuses: Mapping = BONUSES, mode: str = "cumulative") -> Column:
    """Bonus of a game: every tier that is reached, or with ``highest`` the top one of each stat."""
    out = F.lit(0.0)
    for stat, tiers in bonuses.items():
        if mode == "cumulative":
            for threshold, points in tiers:
                out = out + F.when(F.col(stat) >= threshold, F.lit(float(points))).otherwise(0.0)
        else:
            best = F.lit(0.0)
            for threshold, points in sorted(tiers):
                best = F.when(F.col(stat) >= threshold, F.lit(float(points))).otherwise(best)
            out = out + best
    return out


def points(
    weights: Mapping | Column = WEIGHTS, bonuses: Mapping | None = BONUSES, *, mode: str = "cumulative", fractional: Column | bool = True,
    negatives: bool = True, position: Column | None = None, overrides: Mapping | None = None,
) -> Column:
    """Points of an adapted stat line, rounded to 4. ``bonuses=None`` for season totals."""
    out = reduce(lambda a, b: a + b, [stat_points(s, _weight(weights, s, position, overrides), fractional) for s in ALIASES])
    if bonuses:
        out = out + bonus_points(bonuses, mode)
    return F.round(out if negatives else F.greatest(out, F.lit(0.0)), 4)


def breakdown(weights: Mapping = WEIGHTS, bonuses: Mapping | None = BONUSES) -> Column:
    """Map from stat, or ``bonus:<stat>``, to its points; zeros are left out."""
    items: list[Column] = []
    for s in ALIASES:
        items += [F.lit(s), F.round(stat_points(s, _weight(weights, s, None, None)), 4)]
    for s in bonuses or {}:
        items += [F.lit(f"bonus:{s}"), bonus_points({s: bonuses[s]})]
    return F.map_filter(F.create_map(*items), lambda _, v: v != 0)


def fan_out(lines: DataFrame, configs: DataFrame) -> DataFrame:
    """Adapted lines under every league: ``configs`` has league_id, weights (map), fractional, negatives and bonus (multiplier)."""
    few = leagues(configs.select("league_id", "weights", "fractional", "negatives", "bonus"))
    out = lines.join(few, how="cross")  # lines times leagues is the result's size
    p = reduce(lambda a, b: a + b, [stat_points(s, zero(F.col("weights")[s]), F.col("fractional")) for s in ALIASES])
    p = p + F.col("bonus") * bonus_points()
    p = F.when(F.col("negatives"), p).otherwise(F.greatest(p, F.lit(0.0)))
    return out.withColumn("points", F.round(p, 4)).drop("weights", "fractional", "negatives", "bonus")


def bonus_rate(games: DataFrame, season_weights: Sequence[float] = (0.5, 0.3, 0.2), full: int = 17) -> DataFrame:
    """Bonus points a game of each player: season means, weighted by recency and by weeks up to a full season."""
    per = games.groupBy("player_id", "season").agg(F.avg("bonus").alias("mean"), F.count("*").alias("weeks"))
    newest = games.agg(F.max("season").alias("newest"))
    per = per.join(F.broadcast(newest))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in season_weights]), (F.col("newest") - F.col("season") + 1).cast("int"))
    w = F.when(F.col("newest") - F.col("season") < len(season_weights), w).otherwise(0.0) * F.least("weeks", F.lit(full)) / full
    per = per.withColumn("w", w)
    return per.groupBy("player_id").agg(F.when(F.sum("w") > 0, F.sum(F.col("mean") * F.col("w")) / F.sum("w")).otherwise(0.0).alias("bonus_rate"))


def vendor_ppg(totals: DataFrame, rates: DataFrame, known_missed: Column, least_games: int = 6, season_games: int = 17) -> DataFrame:
    """A vendor's season total as points a game: scored without game bonuses, over the games he is expected to be there for
    (six at least), with the player's own bonus rate on top."""
    scored = adapt(totals).withColumn("season_points", points(bonuses=None))
    games = F.greatest(F.lit(least_games), F.lit(season_games) - zero(known_missed))
    out = scored.join(rates.select("player_id", "bonus_rate"), "player_id", "left")
    return out.withColumn("vendor_ppg", F.col("season_points") / games + zero("bonus_rate"))
