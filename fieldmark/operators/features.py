"""Player-season features from weekly lines.

Everything groups by (player, season): one shuffle on the player carries the
season aggregates, and what is compared across players - team totals, weekly
thresholds, ranks - is grouped by (season, ...) keys that grow with the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.columns import dominant, flag, free_name, ladder, ratio, total, zero
from fieldmark.functions.ranking import tie_ranks

#: Weights of a season by its age in seasons, and games that make a season rank.
RECENCY = (0.5, 0.3, 0.2)
RANKED_GAMES = 8


def regular_weeks(lines: DataFrame, players: DataFrame, seasons: Sequence[int] | None = None) -> DataFrame:
    """Regular-season lines of known players; the season filter reaches the scan."""
    out = lines.filter(F.col("season_type") == "REG")
    if seasons:
        out = out.filter(F.col("season").isin(*seasons))
    return out.join(players.select("player_id").distinct(), "player_id", "left_semi")


def team_totals(lines: DataFrame, stats: Sequence[str]) -> DataFrame:
    """Sums over every player of a team and season; rows without a team stay out of the shuffle."""
    return lines.filter(F.col("team").isNotNull()).groupBy("season", "team").agg(*[total(s).alias(f"team_{s}") for s in stats])


def season_shares(lines: DataFrame, stats: Sequence[str]) -> DataFrame:
    """Share of each stint's team total, summed over a player's season; 0 where the team has none."""
    stint = lines.filter(F.col("team").isNotNull()).groupBy("player_id", "season", "team").agg(*[total(s).alias(s) for s in stats])
    joined = stint.join(team_totals(stint, stats), ["season", "team"])  # both sides from one pass over the lines
    return joined.groupBy("player_id", "season").agg(*[F.sum(ratio(F.col(s), F.col(f"team_{s}"), 0.0)).alias(f"{s}_share") for s in stats])


def season_totals(lines: DataFrame, points: Column, stats: Sequence[str]) -> DataFrame:
    """Games, points and rates of each player and season, with the commonest team and position as its role."""
    keys = ["player_id", "season"]
    # Lines are summed up by team and position first; the few sums of a player's season give its totals and its role.
    parts = lines.withColumn("points", points).groupBy(*keys, "team", "position").agg(
        F.count("*").alias("games"), F.sum("points").alias("points"), *[total(s).alias(s) for s in stats],
        F.sum("targets").alias("_targets"), F.count("targets").alias("_counted"), F.max("week").alias("_week"),
    )
    parts = parts.repartition(*keys)
    of = {c: Window.partitionBy(*keys, c) for c in ("team", "position")}
    order = {f"_{c}": F.when(F.col(c).isNotNull(), F.struct((-F.sum("games").over(w)).alias("n"), (-F.max("_week").over(w)).alias("week"), F.col(c).alias("value"))) for c, w in of.items()}
    out = parts.withColumns(order).groupBy(*keys).agg(
        F.sum("games").alias("games"), F.round(F.sum("points"), 4).alias("points"), *[F.sum(s).alias(s) for s in stats],
        ratio(F.sum("_targets"), F.sum("_counted")).alias("mean_targets"), *[F.min(f"_{c}")["value"].alias(c) for c in of],
    )
    out = out.withColumn("role_key", F.concat_ws("-", "team", "position"))
    rates = {f"{s}_pg": F.col(s) / F.col("games") for s in stats}
    opportunities = (zero("targets") + zero("carries")) / F.col("games")
    return out.withColumns({"ppg": F.col("points") / F.col("games"), "opportunities_pg": opportunities} | rates)


def positional_ranks(seasons: DataFrame, least_games: int = RANKED_GAMES) -> DataFrame:
    """Least rank by ppg among players with enough games (null for others), and by points among all. Seasons and positions
    are few and grow with the players, so ranks are made over range partitions."""
    names = seasons.columns
    enough = free_name(names, "enough")
    rows = seasons.withColumn(enough, F.coalesce(F.col("games") >= least_games, F.lit(False)))
    rows = tie_ranks(rows, ["season", "position", enough], "ppg", "ppg_rank")
    rows = tie_ranks(rows, ["season", "position"], "points", "points_rank")
    return rows.select(*names, F.when(F.col(enough), F.col("ppg_rank")).alias("ppg_rank"), "points_rank")


def wide_seasons(seasons: DataFrame, players: DataFrame, metrics: Sequence[str], years: Sequence[int]) -> DataFrame:
    """One row a player, metrics by season as columns; players without history keep nulls."""
    wide = seasons.groupBy("player_id").pivot("season", list(years)).agg(*[F.first(m).alias(m) for m in metrics])
    if len(metrics) == 1:
        wide = wide.select("player_id", *[F.col(f"`{y}`").alias(f"{y}_{metrics[0]}") for y in years])
    return players.select("player_id").join(wide, "player_id", "left")


def latest_and_previous(seasons: DataFrame, metrics: Sequence[str], latest: int) -> DataFrame:
    """Metrics of the latest season and the one before, and their change where both are there."""
    at = lambda m, y: F.max(F.when(F.col("season") == y, F.col(m)))
    cols = [at(m, y).alias(f"{name}_{m}") for m in metrics for y, name in ((latest, "last"), (latest - 1, "prev"))]
    out = seasons.filter(F.col("season").isin(latest, latest - 1)).groupBy("player_id").agg(*cols)
    return out.withColumns({f"yoy_{m}": F.col(f"last_{m}") - F.col(f"prev_{m}") for m in metrics})


def recency_weight(season: Column, latest: Column | int, weights: Sequence[float] = RECENCY) -> Column:
    age = F.lit(latest) - season if isinstance(latest, int) else latest - season
    return reduce(lambda w, k: w.when(age == k, F.lit(float(weights[k]))), range(len(weights)), F.when(F.lit(False), 0.0)).otherwise(0.0)


def role_trend(seasons: DataFrame, metric: str, latest: int) -> DataFrame:
    """Recency-weighted mean of ``metric`` over seasons in the role of the last season played, weights made to sum to 1."""
    last = seasons.groupBy("player_id").agg(F.max_by("role_key", "season").alias("role"), F.max("season").alias("last_season"), F.count("*").alias("seasons"))
    w = recency_weight(F.col("season"), latest)
    both = seasons.join(last, "player_id").filter(F.col("role_key") == F.col("role"))
    sums = both.groupBy("player_id").agg(
        F.sum(w * F.col(metric)).alias("s"), F.sum(F.when(F.col(metric).isNotNull(), w)).alias("w"), F.count("*").alias("role_seasons"),
        F.max("last_season").alias("last_season"), F.max("seasons").alias("seasons"),
    )
    return sums.select("player_id", F.when(F.col("w") > 0, F.col("s") / F.col("w")).alias(f"trend_{metric}"), "role_seasons", "seasons", "last_season")


def luck(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Actual less expected points, touchdowns and yards over the weeks that both tables have.

    The expected table's season is text and its week a double; keys are cast, rows without an id or with other
    text are left out."""
    e = expected.select(
        "player_id", F.expr("try_cast(season AS INT)").alias("season"), F.col("week").cast("int").alias("week"),
        *[zero(c).alias(c) for c in ("points_exp", "td_exp", "yards_exp")],
    ).filter("player_id is not null and season is not null and week is not null")
    both = actual.join(e, ["player_id", "season", "week"])
    sums = both.groupBy("player_id", "season").agg(
        F.count("*").alias("games_both"), *[F.sum(c).alias(c) for c in ("points", "tds", "yards", "points_exp", "td_exp", "yards_exp")]
    )
    return sums.select(
        "player_id", "season", "games_both", ((F.col("points") - F.col("points_exp")) / F.col("games_both")).alias("ppg_diff"),
        (F.col("tds") - F.col("td_exp")).alias("td_diff"), (F.col("yards") - F.col("yards_exp")).alias("yards_diff"),
    )


def weekly_cutoffs(weeks: DataFrame, ranks: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """The k-th best score of each week and position for every named rank, or the last one of a smaller group."""
    deepest = F.array_max(F.array(*[F.lit(k) for by in ranks.values() for k in by.values()]))
    w = Window.partitionBy("season", "week", "position").orderBy(F.desc("points"), "player_id")
    best = weeks.filter(F.col("position").isin(*ranks)).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= deepest)
    names = sorted({name for by in ranks.values() for name in by})
    k = {name: reduce(lambda c, p: c.when(F.col("position") == p, ranks[p].get(name)), ranks, F.when(F.lit(False), 0)) for name in names}
    return best.groupBy("season", "week", "position").agg(*[F.min(F.when(F.col("n") <= k[name], F.col("points"))).alias(name) for name in names])


def weekly_spread(weeks: DataFrame, players: DataFrame, ranks: Mapping[str, Mapping[str, int]], least_opportunities: int = 3) -> DataFrame:
    """Distribution of a player's weekly points in a season; players without a counted week keep a row of nulls.

    ``ranks`` names starter, boom and bust cutoffs by position. Quantiles are interpolated."""
    used = weeks.filter(zero("targets") + zero("carries") + zero("attempts") >= least_opportunities)
    joined = used.join(weekly_cutoffs(weeks, ranks), ["season", "week", "position"], "left")
    share = lambda c: F.avg(flag(c).cast("double"))
    out = joined.groupBy("player_id", "season").agg(
        F.count("*").alias("n"), F.avg("points").alias("mean"), F.stddev_samp("points").alias("sd"), F.percentile("points", F.lit(0.25)).alias("p25"),
        F.percentile("points", F.lit(0.9)).alias("p90"), share(F.col("points") >= F.col("starter")).alias("pct_starter"),
        share(F.col("points") >= F.col("boom")).alias("pct_boom"), share(F.col("points") < F.col("bust")).alias("pct_bust"),
    )
    out = out.withColumn("cv", F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")))
    return players.select("player_id").join(out, "player_id", "left")


def team_tendencies(lines: DataFrame) -> DataFrame:
    """Volume, pass rate and concentration of each team and season."""
    known = lines.filter(F.col("team").isNotNull())
    team = known.groupBy("season", "team").agg(
        F.countDistinct("week").alias("weeks"), total("attempts").alias("attempts"), total("carries").alias("carries"), total("targets").alias("targets")
    )
    per = known.groupBy("season", "team", "player_id").agg(total("targets").alias("t"), total(F.when(F.col("position") == "RB", F.col("carries"))).alias("c"))
    w = lambda c: Window.partitionBy("season", "team").orderBy(F.desc(c), "player_id")
    ranked = per.withColumns({"tn": F.row_number().over(w("t")), "cn": F.row_number().over(w("c"))})
    tops = ranked.groupBy("season", "team").agg(F.sum(F.when(F.col("tn") <= 2, F.col("t"))).alias("top2"), F.sum(F.when(F.col("cn") == 1, F.col("c"))).alias("top_rb"))
    out = team.join(tops, ["season", "team"])
    plays = F.col("attempts") + F.col("carries")
    return out.select(
        "season", "team", "weeks", F.round(plays / F.col("weeks"), 2).alias("plays_pg"), F.round(ratio(F.col("attempts"), plays), 4).alias("pass_rate"),
        F.round(ratio(F.col("top2"), F.col("targets")), 4).alias("top2_target_share"), F.round(ratio(F.col("top_rb"), F.col("carries")), 4).alias("top_rb_carry_share"),
    )


#: Games that a player of the position misses, by draft round up to 2, up to 5, and later or unknown.
MISSED = {"RB": (2.4, 3.3, 3.8), "WR": (2.2, 2.8, 3.3), "TE": (2.0, 2.6, 3.2), "QB": (1.5, 2.0, 2.5)}
#: Factors by age, (greatest age, factor) and what follows; ages from which a player is past the cliff.
AGE_STEPS = {
    "RB": (((27, 1.0), (28, 0.97), (29, 0.92), (30, 0.85)), 0.78),
    "WR": (((23, 1.05), (29, 1.0), (31, 0.96)), 0.88),
    "TE": (((25, 1.03), (31, 1.0)), 0.93),
    "QB": (((35, 1.0),), 0.95),
}
CLIFF = {"RB": 29, "WR": 31, "TE": 32}


def expected_games(adp_round: Column, position: Column, missed: Column, eligible: Column, played: Column, known_missed: Column) -> Column:
    """Games to expect of 17: base misses by position and round, one more for every 20 % of excess miss rate, less weeks known to be lost.

    History counts from 8 games played."""

    def base_of(row: tuple[float, float, float]) -> Column:
        return F.when(adp_round <= 2, row[0]).when(adp_round <= 5, row[1]).otherwise(row[2])

    base = reduce(lambda c, p: c.when(position == p, base_of(MISSED[p])), MISSED, F.when(F.lit(False), 0.0)).otherwise(base_of(MISSED["WR"]))
    rate = F.when((played >= RANKED_GAMES) & (eligible > 0), missed / eligible)
    extra = F.when(rate > base / 17, (rate - base / 17) / 0.20).otherwise(0.0)
    games = F.least(F.lit(17.0) - zero(known_missed), F.lit(17.0) - base - extra)
    return F.round(F.greatest(F.lit(0.0), F.least(games, F.lit(17.0))), 2)


def age_at(birth_date: Column, day: Column) -> Column:
    return F.datediff(day, birth_date) / 365.25


def age_factor(position: Column, age: Column) -> Column:
    out = F.when(age.isNull(), 1.0)
    for p, (steps, rest) in AGE_STEPS.items():
        out = out.when(position == p, ladder(F.floor(age), steps, rest))
    return out.otherwise(1.0)


def past_cliff(position: Column, age: Column) -> Column:
    return flag(reduce(lambda c, p: c.when(position == p, F.floor(age) >= CLIFF[p]), CLIFF, F.when(F.lit(False), F.lit(False))).otherwise(False))


def bye_weeks(games: DataFrame, weeks: int = 18) -> DataFrame:
    """Weeks without a game of each season and team."""
    sides = games.select("season", "week", F.col("home_team").alias("team")).unionByName(games.select("season", "week", F.col("away_team").alias("team")))
    sides = sides.filter(F.col("team").isNotNull()).distinct()
    all_weeks = sides.select("season", "team").distinct().select("season", "team", F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("week"))
    return all_weeks.join(sides, ["season", "team", "week"], "left_anti")


def reconcile(ours: DataFrame, theirs: DataFrame, keys: Sequence[str], measures: Sequence[str], within: float = 1e-6) -> DataFrame:
    """Rows of a full join with, for each measure, whether both sides agree; nulls agree with nulls."""
    a, b = ours.select(*keys, *[F.col(m).alias(f"our_{m}") for m in measures]), theirs.select(*keys, *[F.col(m).alias(f"their_{m}") for m in measures])
    joined = a.join(b, list(keys), "full")
    same = {f"{m}_agrees": F.coalesce(F.abs(F.col(f"our_{m}") - F.col(f"their_{m}")) <= within, F.col(f"our_{m}").isNull() & F.col(f"their_{m}").isNull()) for m in measures}
    return joined.withColumns(same)
