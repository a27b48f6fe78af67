"""Who could play, who did, and why not: eligible weeks, spells, ledgers and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.columns import flag, running, top, zero
from fieldmark.operators.features import RANKED_GAMES, expected_games

#: Roster states that count, and codes and code initials that do not.
ELIGIBLE_STATES = ("ACT", "INA", "RES", "PUP")
EXCLUDED_INITIALS = ("P", "W", "E", "F")
EXCLUDED_CODES = ("R02", "R03", "R06", "R09", "R30", "R33", "R40")
#: Reports and practice notes that make an injury week, and causes that are no injuries.
REPORTS = ("Out", "Doubtful", "Questionable")
PRACTICE = r"(?i)did not participate|limited participation"
NO_INJURY = r"(?i)^not injury related"
UNSPECIFIED = "Unspecified"
#: Causes that are soft-tissue and structural injuries.
SOFT_TISSUE = r"(?i)hamstring|groin|calf|quad|soft tissue"
STRUCTURAL = r"(?i)\bacl\b|achilles|\bmcl\b|\bpcl\b|patell|fracture|torn"
#: What makes a player injury-prone, the games of a season, and missed weeks that end one.
MISS_RATE, LEAST_EVENTS, LEAST_SEASONS, GAMES, SEASON_ENDING = 0.20, 2, 2, 17, 4


def eligible_weeks(roster: DataFrame) -> DataFrame:
    """Distinct (player_id, season, week) of regular weeks in a state that counts and without a code that excludes."""
    code = F.col("code")
    fine = code.isNull() | (~F.substring(code, 1, 1).isin(*EXCLUDED_INITIALS) & ~code.isin(*EXCLUDED_CODES))
    return roster.filter(F.col("status").isin(*ELIGIBLE_STATES) & fine).select("player_id", "season", "week").distinct()


def played_weeks(lines: DataFrame) -> DataFrame:
    """Distinct weeks with at least one opportunity."""
    chances = zero("targets") + zero("carries") + zero("attempts")
    return lines.filter(chances >= 1).select("player_id", "season", "week").distinct()


def injury_weeks(reports: DataFrame) -> DataFrame:
    """Distinct (player_id, season, week, cause) of weeks that count as injured; the cause is the first text that is not
    blank, and ``Unspecified`` where there is none. Rows without a player are left out."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    cause = F.coalesce(text("report_injury"), text("practice_injury"), F.lit(UNSPECIFIED))
    hurt = flag(F.trim("report_status").isin(*REPORTS)) | flag(F.col("practice_status").rlike(PRACTICE))
    rows = reports.filter(F.col("player_id").isNotNull() & hurt).withColumn("cause", cause).filter(~F.col("cause").rlike(NO_INJURY))
    return rows.select("player_id", "season", "week", "cause").distinct()


def spells(weeks: DataFrame, keys: Sequence[str] = ("player_id", "season", "cause"), at: str = "week", bridge: int = 2) -> DataFrame:
    """Islands of ``at`` for each key: a gap of more than ``bridge`` starts a new spell."""
    w = Window.partitionBy(*keys).orderBy(at)
    starts = (F.col(at) - F.lag(at).over(w) > bridge) | F.lag(at).over(w).isNull()
    numbered = weeks.select(*keys, at).distinct().withColumn("_new", starts.cast("int"))
    numbered = numbered.withColumn("spell", F.sum("_new").over(running(w)))
    return numbered.groupBy(*keys, "spell").agg(F.min(at).alias(f"first_{at}"), F.max(at).alias(f"last_{at}"), F.count("*").alias("listed"))


def ledger(eligible: DataFrame, played: DataFrame, spells_: DataFrame) -> DataFrame:
    """Per player and season of any of the three tables: weeks eligible, played (of those) and missed, spells, their causes,
    and how many were soft-tissue or structural."""
    keys = ["player_id", "season"]
    e = eligible.groupBy(*keys).agg(F.count("*").alias("eligible"))
    p = played.join(eligible, [*keys, "week"]).groupBy(*keys).agg(F.count("*").alias("played"))
    s = spells_.groupBy(*keys).agg(
        F.count("*").alias("spells"), F.array_sort(F.collect_set("cause")).alias("causes"), F.count_if(F.col("cause").rlike(SOFT_TISSUE)).alias("soft_tissue"),
        F.count_if(F.col("cause").rlike(STRUCTURAL)).alias("structural"),
    )
    every = e.select(*keys).unionByName(played.select(*keys)).unionByName(s.select(*keys)).distinct()
    out = every.join(e, keys, "left").join(p, keys, "left").join(s, keys, "left")
    out = out.withColumns({c: zero(c) for c in ("eligible", "played", "spells", "soft_tissue", "structural")})
    return out.withColumns({"missed": F.greatest(F.col("eligible") - F.col("played"), F.lit(0)), "causes": F.coalesce("causes", F.array().cast("array<string>"))})


def top_causes(spells_: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` commonest causes of each player, then by name, as an ordered array."""
    n = spells_.groupBy("player_id", "cause").agg(F.count("*").alias("n"))
    best = top(n, ["player_id"], [F.desc("n"), F.asc("cause")], k)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "cause")))
    return best.groupBy("player_id").agg(ordered["cause"].alias("top_causes"))


def season_ending(spells_: DataFrame, eligible: DataFrame, played: DataFrame, week_one: DataFrame, cutoff: Column, least: int = SEASON_ENDING) -> DataFrame:
    """Structural spells after which nothing was played and at least ``least`` eligible weeks were missed; the latest of each player.

    ``week_one`` has a season's first day; a listing later than ``cutoff`` days count. Weeks of a player and season
    bound the range join."""
    s = spells_.filter(F.col("cause").rlike(STRUCTURAL))
    weeks = eligible.join(played.withColumn("did", F.lit(1)), ["player_id", "season", "week"], "left")
    later = s.join(weeks, ["player_id", "season"]).filter(F.col("week") >= F.col("first_week"))
    ended = later.groupBy("player_id", "season", "cause", "first_week", "last_week").agg(zero(F.sum("did")).alias("played_after"), F.count_if(F.col("did").isNull()).alias("unplayed"))
    ended = ended.filter((F.col("played_after") == 0) & (F.col("unplayed") >= least)).join(week_one, "season")
    listed = F.date_add(F.col("first_day"), 7 * (F.col("last_week").cast("int") - 1))
    ended = ended.withColumn("last_listed", listed).filter(F.col("last_listed") >= cutoff)
    return top(ended, ["player_id"], [F.desc("last_listed"), F.desc("first_week"), F.asc("cause")]).select("player_id", "season", "cause", "last_listed", "unplayed")


def trailing_absence(eligible: DataFrame, played: DataFrame) -> DataFrame:
    """Eligible weeks missed in a row at the end of each player's season."""
    did = eligible.join(played.withColumn("did", F.lit(1)), ["player_id", "season", "week"], "left")
    w = Window.partitionBy("player_id", "season").orderBy(F.desc("week"))
    seen = did.withColumn("since", zero(F.sum("did").over(running(w))))
    return seen.groupBy("player_id", "season").agg(F.count_if(F.col("since") == 0).alias("trailing_missed"))


def totals(ledgers: DataFrame, latest: int, seasons: int = 3) -> DataFrame:
    """Per player over the last seasons: what he missed and why, and whether that makes him injury-prone."""
    recent = ledgers.filter((F.col("season") > latest - seasons) & (F.col("season") <= latest))
    t = recent.groupBy("player_id").agg(
        F.sum("eligible").alias("eligible_3y"), F.sum("played").alias("played_3y"), F.sum("missed").alias("missed_3y"), F.sum("spells").alias("events"),
        F.count_if(F.col("spells") > 0).alias("seasons_with_events"), F.sum("soft_tissue").alias("soft_tissue"), F.count_if(F.col("soft_tissue") > 0).alias("soft_seasons"),
    )
    often = (F.col("miss_rate") >= MISS_RATE) & (F.col("events") >= LEAST_EVENTS) & (F.col("seasons_with_events") >= LEAST_SEASONS)
    soft = (F.col("soft_tissue") >= LEAST_EVENTS) & (F.col("soft_seasons") >= LEAST_SEASONS)
    rate = F.when(F.col("eligible_3y") > 0, F.round(F.col("missed_3y") / F.col("eligible_3y"), 4))
    return t.withColumn("miss_rate", rate).withColumn("injury_prone", flag(often) | flag(soft))


def summary(ledgers: DataFrame, players: DataFrame, causes: DataFrame, ending: DataFrame, trailing: DataFrame, status: DataFrame, latest: int, kickoff: Column, seasons: int = 3) -> DataFrame:
    """A row for every player (player_id, position, birth_date): totals of the last seasons, his causes, whether he is
    injury-prone or comes back from a structural injury and since which season, his state now, and the games to expect, of
    which all history counts here.

    ``causes``: :func:`top_causes`; ``ending``: :func:`season_ending`; ``trailing``: :func:`trailing_absence`, of which the
    latest season counts; ``status``: player_id, status, body_part, known_missed. All are one row a player, so every join is
    on player_id, which all of them are grouped by."""
    blank = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    end = ending.select("player_id", F.col("cause").alias("_cause"), F.col("season").alias("_season"))
    last = trailing.filter(F.col("season") == latest).select("player_id", "trailing_missed")
    now = status.select("player_id", blank("status"), blank("body_part"), "known_missed")
    out = players
    for part in (totals(ledgers, latest, seasons), causes, end, last, now):
        out = out.join(part, "player_id", "left")
    known, absent = zero("known_missed"), zero("trailing_missed") >= SEASON_ENDING
    returns = structural_return(F.col("_cause").isNotNull(), F.col("body_part"), F.col("trailing_missed"), F.col("known_missed"))
    out = out.withColumns({"structural_return": returns, "known_missed": known, "injury_prone": flag(F.col("injury_prone"))})
    return out.withColumns({
        "structural_cause": F.when(F.col("structural_return"), F.coalesce("_cause", "body_part")),
        "structural_season": F.when(F.col("structural_return"), F.coalesce(F.col("_season"), F.when(absent, latest))),
        "age": F.round(F.datediff(kickoff, F.col("birth_date")) / 365.25, 2),
        "e_games": expected_games(F.lit(None).cast("double"), F.col("position"), F.col("missed_3y"), F.col("eligible_3y"), F.lit(RANKED_GAMES), F.col("known_missed")),
    }).drop("_cause", "_season")


def structural_return(reported: Column, body_part: Column, trailing_missed: Column, known_missed: Column) -> Column:
    """Back from a structural injury: seen in the reports, or by the state now and weeks missed; not if the season is lost."""
    by_state = flag(body_part.rlike(STRUCTURAL)) & flag(trailing_missed >= SEASON_ENDING)
    return (flag(reported) | by_state) & (zero(known_missed) < GAMES)


def chart_change(charts: DataFrame, days: int = 30) -> DataFrame:
    """Depth rank now and ``days`` ago, as of each team's latest chart, from the freshest chart that lists a player.

    The charts are the largest table: the two days of each team are aggregated first, and only their rows are joined."""
    latest = charts.groupBy("team").agg(F.max("dt").alias("now"))
    target = charts.join(latest, "team").filter(F.col("dt") <= F.date_sub("now", days))
    past = target.groupBy("team").agg(F.max("dt").alias("then"))
    days_ = latest.join(past, "team", "left")
    at = charts.join(days_, "team").filter((F.col("dt") == F.col("now")) | (F.col("dt") == F.col("then")))
    per = at.groupBy("team", "player_id", "now").agg(F.min(F.when(F.col("dt") == F.col("now"), F.col("depth"))).alias("depth_rank"), F.min(F.when(F.col("dt") == F.col("then"), F.col("depth"))).alias("depth_before"))
    per = per.filter(F.col("depth_rank").isNotNull())
    one = top(per, ["player_id"], [F.desc("now"), F.asc("depth_rank"), F.asc("team")])
    return one.select("player_id", "team", F.col("now").alias("as_of"), "depth_rank", "depth_before", (F.col("depth_rank") - F.col("depth_before")).alias("depth_change"))
