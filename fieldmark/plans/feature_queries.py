"""Scoring and season features over the test tables, with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.operators import durability, features, scoring
from fieldmark.sources.settled import settle
from fieldmark.plans.bindings import bound, ctes, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

STATS = ("targets", "carries", "attempts", "receptions", "receiving_yards", "rushing_yards")
CUTOFFS = {p: {"starter": s, "boom": b, "bust": 2 * s} for p, s, b in (("QB", 6, 3), ("RB", 8, 4), ("WR", 10, 5), ("TE", 4, 2))}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def adapted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.adapt(bound(spark, sf_dir, "weekly"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapted(spark, sf_dir).withColumn("points", scoring.points())


def regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.regular_weeks(adapted(spark, sf_dir), bound(spark, sf_dir, "players"))


BONUS_SQL = " + ".join(
    f"CASE WHEN {c} >= {t} THEN {p} ELSE 0 END"
    for c, tiers in (("passing_yards", ((350, 1), (400, 2), (425, 3))), ("rushing_yards", ((100, 1), (150, 2), (200, 3))), ("receiving_yards", ((100, 1), (150, 2), (200, 3))))
    for t, p in tiers
)
BASE_SQL = (
    "0.04 * passing_yards + 6 * passing_tds - 2 * passing_interceptions + 0.1 * rushing_yards + 6 * rushing_tds + 0.5 * receptions"
    " + 0.1 * receiving_yards + 6 * receiving_tds - 2 * fumbles_lost"
)
SCORED_SQL = f"scored AS (SELECT *, round({BASE_SQL} + {BONUS_SQL}, 4) AS points FROM weekly), reg AS (SELECT * FROM scored WHERE season_type = 'REG')"
WITH = f"WITH {ctes('weekly', 'players')}, {SCORED_SQL}"
SEASON_SQL = f"""{WITH}, sums AS (
  SELECT player_id, season, count(*) AS games, round(sum(points), 4) AS points, sum(targets) AS targets, sum(carries) AS carries, avg(targets) AS mean_targets
  FROM reg GROUP BY ALL),
teams AS (SELECT player_id, season, team FROM (SELECT player_id, season, team, row_number() OVER (PARTITION BY player_id, season ORDER BY count(*) DESC, max(week) DESC, team) AS n
  FROM reg GROUP BY player_id, season, team) WHERE n = 1),
roles AS (SELECT player_id, season, min(position) AS position FROM reg GROUP BY ALL),
seasons AS (SELECT *, points / games AS ppg, concat_ws('-', team, position) AS role_key FROM sums JOIN teams USING (player_id, season) JOIN roles USING (player_id, season))"""


@query("b2_score", f"{WITH} SELECT player_id, season, week, points FROM scored")
def b2_score(spark, sf_dir):
    """Adapter (B1), weights, and cumulative bonuses (B3)."""
    return scored(spark, sf_dir).select("player_id", "season", "week", "points")


_HIGHEST = " + ".join(
    f"CASE {' '.join(f'WHEN {c} >= {t} THEN {p}' for t, p in tiers)} ELSE 0 END"
    for c, tiers in (("passing_yards", ((425, 3), (400, 2), (350, 1))), ("rushing_yards", ((200, 3), (150, 2), (100, 1))), ("receiving_yards", ((200, 3), (150, 2), (100, 1))))
)


@query("b3_highest_bonus", f"{WITH} SELECT player_id, season, week, CAST({_HIGHEST} AS DOUBLE) AS bonus FROM scored")
def b3_highest_bonus(spark, sf_dir):
    return adapted(spark, sf_dir).select("player_id", "season", "week", scoring.bonus_points(mode="highest").alias("bonus"))


@query(
    "b2_whole_yards",
    f"""{WITH} SELECT player_id, season, week, round(greatest(0, floor(passing_yards / 25 + 1e-9) + floor(rushing_yards / 10 + 1e-9) + floor(receiving_yards / 10 + 1e-9)
  + 6 * passing_tds - 2 * passing_interceptions + 6 * rushing_tds + CASE WHEN position = 'TE' THEN 1.0 ELSE 0.5 END * receptions + 6 * receiving_tds - 2 * fumbles_lost), 4) AS points FROM scored""",
)
def b2_whole_yards(spark, sf_dir):
    """Whole-increment yardage, a position override, no negatives and no bonuses."""
    p = scoring.points(bonuses=None, fractional=False, negatives=False, position=F.col("position"), overrides={"TE": {"rec": 1.0}})
    return adapted(spark, sf_dir).select("player_id", "season", "week", p.alias("points"))


@query("b4_breakdown", f"""{WITH}, parts AS (
  SELECT player_id, season, week, unnest(['pass_yd', 'pass_td', 'rush_yd', 'rec', 'bonus:rec_yd']) AS stat,
    unnest([round(0.04 * passing_yards, 4), 6 * passing_tds, round(0.1 * rushing_yards, 4), 0.5 * receptions,
      CASE WHEN receiving_yards >= 100 THEN 1.0 ELSE 0 END + CASE WHEN receiving_yards >= 150 THEN 2 ELSE 0 END + CASE WHEN receiving_yards >= 200 THEN 3 ELSE 0 END]) AS points FROM weekly)
SELECT * FROM parts WHERE points <> 0""")  # fmt: skip
def b4_breakdown(spark, sf_dir):
    rows = adapted(spark, sf_dir).select("player_id", "season", "week", F.explode(scoring.breakdown()).alias("stat", "points"))
    return rows.filter(F.col("stat").isin("pass_yd", "pass_td", "rush_yd", "rec", "bonus:rec_yd"))


@query("b5_bonus_rate", f"""{WITH}, per AS (SELECT player_id, season, avg({BONUS_SQL}) AS mean, count(*) AS weeks FROM reg GROUP BY ALL),
w AS (SELECT *, CASE (SELECT max(season) FROM reg) - season WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 WHEN 2 THEN 0.2 ELSE 0 END * least(weeks, 17) / 17 AS w FROM per)
SELECT player_id, round(CASE WHEN sum(w) > 0 THEN sum(mean * w) / sum(w) ELSE 0 END, 6) AS bonus_rate FROM w GROUP BY player_id""")  # fmt: skip
def b5_bonus_rate(spark, sf_dir):
    rates = scoring.bonus_rate(regular(spark, sf_dir).withColumn("bonus", scoring.bonus_points()))
    return rates.withColumn("bonus_rate", F.round("bonus_rate", 6))


_LEAGUES = [(k, 0.02 + 0.01 * k, 0.25 * k, k % 2 == 0, float(k % 3 > 0)) for k in range(1, 5)]


@query("b7_league_fan_out", f"""{WITH}, leagues(league_id, pass_yd, rec, fractional, bonus) AS (VALUES {', '.join(f'({a}, {b}, {c}, {d}, {e})' for a, b, c, d, e in _LEAGUES)}),
lines AS (SELECT league_id, player_id, round(CASE WHEN fractional THEN pass_yd * passing_yards + 0.1 * rushing_yards ELSE floor(passing_yards / (1.0 / pass_yd) + 1e-9) + floor(rushing_yards / (1.0 / 0.1) + 1e-9) END
  + rec * receptions + 6 * rushing_tds + bonus * ({BONUS_SQL}), 4) AS points FROM reg, leagues)
SELECT league_id, player_id, count(*) AS games, round(sum(points), 3) AS points FROM lines GROUP BY ALL""")  # fmt: skip
def b7_league_fan_out(spark, sf_dir):
    rows = spark.createDataFrame(_LEAGUES, "league_id long, pass_yd double, rec double, fractional boolean, bonus double")
    configs = rows.select(
        "league_id", F.create_map(F.lit("pass_yd"), "pass_yd", F.lit("rec"), "rec", F.lit("rush_yd"), F.lit(0.1), F.lit("rush_td"), F.lit(6.0)).alias("weights"),
        "fractional", F.lit(True).alias("negatives"), "bonus",
    )
    out = scoring.fan_out(regular(spark, sf_dir), configs)
    return out.groupBy("league_id", "player_id").agg(F.count("*").alias("games"), F.round(F.sum("points"), 3).alias("points"))


@query("c2_dominant_team", f"{SEASON_SQL} SELECT player_id, season, team FROM seasons")
def c2_dominant_team(spark, sf_dir):
    return features.dominant(regular(spark, sf_dir), ["player_id", "season"], "team", "week")


@query("c3_team_shares", f"""{WITH}, stint AS (SELECT player_id, season, team, sum(targets) AS t, sum(carries) AS c FROM reg GROUP BY ALL),
withsum AS (SELECT *, sum(t) OVER (PARTITION BY season, team) AS tt, sum(c) OVER (PARTITION BY season, team) AS tc FROM stint)
SELECT player_id, season, round(sum(CASE WHEN tt <> 0 THEN t / tt ELSE 0 END), 6) AS targets_share, round(sum(CASE WHEN tc <> 0 THEN c / tc ELSE 0 END), 6) AS carries_share FROM withsum GROUP BY ALL""")  # fmt: skip
def c3_team_shares(spark, sf_dir):
    shares = features.season_shares(regular(spark, sf_dir), ["targets", "carries"])
    return shares.select("player_id", "season", *[F.round(c, 6).alias(c) for c in ("targets_share", "carries_share")])


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.season_totals(regular(spark, sf_dir), scoring.points(), STATS)


@query("c4_season_totals", f"{SEASON_SQL} SELECT player_id, season, games, points, round(ppg, 6) AS ppg, targets, round((targets + carries) / games, 6) AS opportunities_pg, round(mean_targets, 6) AS mean_targets, role_key FROM seasons")
def c4_season_totals(spark, sf_dir):
    s = seasons(spark, sf_dir)
    return s.select("player_id", "season", "games", "points", F.round("ppg", 6).alias("ppg"), "targets", F.round("opportunities_pg", 6).alias("opportunities_pg"), F.round("mean_targets", 6).alias("mean_targets"), "role_key")


_RANKED = f"""{SEASON_SQL}, ranked AS (SELECT player_id, season, games, position,
  CASE WHEN games >= 8 THEN rank() OVER (PARTITION BY season, position, games >= 8 ORDER BY ppg DESC) END AS ppg_rank,
  rank() OVER (PARTITION BY season, position ORDER BY points DESC) AS points_rank FROM seasons)"""


@query("c5_positional_ranks", f"{_RANKED} SELECT player_id, season, ppg_rank, points_rank FROM ranked")
def c5_positional_ranks(spark, sf_dir):
    return features.positional_ranks(seasons(spark, sf_dir)).select("player_id", "season", "ppg_rank", "points_rank")


@query("c6_wide_seasons", f"""{SEASON_SQL} SELECT p.player_id, {', '.join(f'max(points) FILTER (season = {y}) AS "{y}_points", max(games) FILTER (season = {y}) AS "{y}_games"' for y in (1999, 2000, 2001))}
FROM players p LEFT JOIN seasons s USING (player_id) GROUP BY p.player_id""")  # fmt: skip
def c6_wide_seasons(spark, sf_dir):
    return features.wide_seasons(seasons(spark, sf_dir), bound(spark, sf_dir, "players"), ["points", "games"], [1999, 2000, 2001])


@query("c7_yoy", f"""{SEASON_SQL} SELECT player_id, round(max(ppg) FILTER (season = 2000) - max(ppg) FILTER (season = 1999), 6) AS yoy_ppg
FROM seasons WHERE season IN (1999, 2000) GROUP BY player_id""")  # fmt: skip
def c7_yoy(spark, sf_dir):
    out = features.latest_and_previous(seasons(spark, sf_dir), ["ppg"], 2000)
    return out.select("player_id", F.round("yoy_ppg", 6).alias("yoy_ppg"))


@query("c8_role_trend", f"""{SEASON_SQL}, last AS (SELECT player_id, arg_max(role_key, season) AS role, max(season) AS last_season, count(*) AS seasons FROM seasons GROUP BY player_id),
w AS (SELECT *, CASE 2001 - season WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 WHEN 2 THEN 0.2 ELSE 0 END AS w FROM (SELECT player_id, season, ppg, role_key FROM seasons) JOIN last USING (player_id) WHERE role_key = role)
SELECT player_id, round(CASE WHEN sum(w) > 0 THEN sum(w * ppg) / sum(w) END, 6) AS trend_ppg, count(*) AS role_seasons, max(seasons) AS seasons, max(last_season) AS last_season FROM w GROUP BY player_id""")  # fmt: skip
def c8_role_trend(spark, sf_dir):
    return features.role_trend(seasons(spark, sf_dir), "ppg", 2001).withColumn("trend_ppg", F.round("trend_ppg", 6))


@query("c9_luck", f"""WITH {ctes('weekly', 'expected')}, {SCORED_SQL},
e AS (SELECT player_id, CAST(season AS INT) AS season, CAST(week AS INT) AS week, td_exp, yards_exp, 0.1 * yards_exp + 6 * td_exp + 0.5 * receptions_exp AS points_exp FROM expected)
SELECT player_id, season, count(*) AS games_both, round((sum(points) - sum(points_exp)) / count(*), 6) AS ppg_diff,
  sum(passing_tds + rushing_tds + receiving_tds) - sum(td_exp) AS td_diff, sum(passing_yards + rushing_yards + receiving_yards) - sum(yards_exp) AS yards_diff
FROM reg JOIN e USING (player_id, season, week) GROUP BY ALL""")  # fmt: skip
def c9_luck(spark, sf_dir):
    act = regular(spark, sf_dir).withColumns({"points": scoring.points(), "tds": F.expr("pass_td + rush_td + rec_td"), "yards": F.expr("pass_yd + rush_yd + rec_yd")})
    e = bound(spark, sf_dir, "expected").withColumn("points_exp", F.expr("0.1D * yards_exp + 6 * td_exp + 0.5D * receptions_exp"))
    return features.luck(act, e).withColumn("ppg_diff", F.round("ppg_diff", 6))


_CUT = ", ".join(
    f"min(points) FILTER (n <= CASE position {' '.join(f'WHEN {chr(39)}{p}{chr(39)} THEN {k[name]}' for p, k in CUTOFFS.items())} END) AS {name}" for name in ("starter", "boom", "bust")
)
_CUTS_SQL = f"""cuts AS (SELECT season, week, position, {_CUT} FROM (
  SELECT *, row_number() OVER (PARTITION BY season, week, position ORDER BY points DESC, player_id) AS n FROM reg WHERE position IN ('QB', 'RB', 'WR', 'TE')) WHERE n <= 20 GROUP BY ALL)"""


@query("c10_weekly_cutoffs", f"{WITH}, {_CUTS_SQL} SELECT * FROM cuts")
def c10_weekly_cutoffs(spark, sf_dir):
    return features.weekly_cutoffs(regular(spark, sf_dir).withColumn("points", scoring.points()), CUTOFFS)


@query("c11_weekly_spread", f"""{WITH}, {_CUTS_SQL}, s AS (
  SELECT player_id, season, count(*) AS n, avg(points) AS mean, stddev_samp(points) AS sd, quantile_cont(points, 0.25) AS p25, quantile_cont(points, 0.9) AS p90,
    avg(CASE WHEN points >= starter THEN 1.0 ELSE 0 END) AS pct_starter, avg(CASE WHEN points >= boom THEN 1.0 ELSE 0 END) AS pct_boom, avg(CASE WHEN points < bust THEN 1.0 ELSE 0 END) AS pct_bust
  FROM reg LEFT JOIN cuts USING (season, week, position) WHERE targets + carries + attempts >= 2 GROUP BY ALL)
SELECT p.player_id, season, n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(p25, 5) AS p25, round(p90, 5) AS p90, round(pct_starter, 5) AS pct_starter, round(pct_boom, 5) AS pct_boom,
  round(pct_bust, 5) AS pct_bust, round(CASE WHEN mean > 0 THEN sd / mean END, 5) AS cv FROM players p LEFT JOIN s USING (player_id)""")  # fmt: skip
def c11_weekly_spread(spark, sf_dir):
    out = features.weekly_spread(regular(spark, sf_dir).withColumn("points", scoring.points()), bound(spark, sf_dir, "players"), CUTOFFS, 2)
    return out.select("player_id", "season", "n", *[F.round(c, 5).alias(c) for c in ("mean", "sd", "p25", "p90", "pct_starter", "pct_boom", "pct_bust", "cv")])


@query("c12_team_tendencies", f"""{WITH}, team AS (SELECT season, team, count(DISTINCT week) AS weeks, sum(attempts) AS a, sum(carries) AS c, sum(targets) AS t FROM reg GROUP BY ALL),
per AS (SELECT season, team, player_id, sum(targets) AS t, coalesce(sum(carries) FILTER (position = 'RB'), 0) AS c FROM reg GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY season, team ORDER BY t DESC, player_id) AS tn, row_number() OVER (PARTITION BY season, team ORDER BY c DESC, player_id) AS cn FROM per),
tops AS (SELECT season, team, sum(t) FILTER (tn <= 2) AS top2, sum(c) FILTER (cn = 1) AS rb FROM r GROUP BY ALL)
SELECT season, team, weeks, round((a + c) / weeks, 2) AS plays_pg, round(a / nullif(a + c, 0), 4) AS pass_rate, round(top2 / nullif(t, 0), 4) AS top2_target_share, round(rb / nullif(c, 0), 4) AS top_rb_carry_share
FROM team JOIN tops USING (season, team)""")  # fmt: skip
def c12_team_tendencies(spark, sf_dir):
    return features.team_tendencies(regular(spark, sf_dir))


#: Cause texts: structural, soft-tissue, neither, near misses of both, and none at all.
_CAUSES = ("ACL", "knee", "Hamstring ", "torn labrum", "Soft tissue", "soft", "mcl sprain", "Oracle", "Achilles", "  ", None, "Right calf", "Not injury related - rest")
_REPORTS = {
    "report_injury": f"CASE event_id % {len(_CAUSES)} {' '.join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_CAUSES) if c is not None)} END", "practice_injury": "CASE event_id % 2 WHEN 0 THEN ' Quad fracture' END",
    "report_status": "CASE WHEN event_type = 'error' THEN ' Out ' WHEN event_type = 'view' THEN 'Probable' END", "practice_status": "CASE WHEN event_type = 'signup' THEN 'Did Not Participate in practice' WHEN event_type = 'click' THEN 'Full participation' END",
}
_DAYS = """days AS (SELECT user_id AS player_id, CAST(2022 + event_id % 3 AS INT) AS season, CAST(day(ts) AS INT) AS week, event_type, event_id FROM events)"""
_SPELLS = f"""{_DAYS}, reports AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in _REPORTS.items())} FROM days),
causes AS (SELECT *, coalesce(nullif(trim(report_injury), ''), nullif(trim(practice_injury), ''), 'Unspecified') AS cause FROM reports WHERE trim(report_status) IN ('Out', 'Doubtful', 'Questionable') OR regexp_matches(practice_status, '(?i)did not participate|limited participation')),
cause_days AS (SELECT DISTINCT player_id, season, cause, week FROM causes WHERE NOT regexp_matches(cause, '(?i)^not injury related')),
marked AS (SELECT *, CASE WHEN week - lag(week) OVER w > 2 OR lag(week) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM cause_days WINDOW w AS (PARTITION BY player_id, season, cause ORDER BY week)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY player_id, season, cause ORDER BY week) AS spell FROM marked),
spells AS (SELECT player_id, season, cause, CAST(spell AS BIGINT) AS spell, min(week) AS first_week, max(week) AS last_week, count(*) AS listed FROM numbered GROUP BY ALL)"""
_SOFT_SQL, _STRUCTURAL_SQL = ("regexp_matches({0}, '" + p + "')" for p in ("(?i)hamstring|groin|calf|quad|soft tissue", r"(?i)\bacl\b|achilles|\bmcl\b|\bpcl\b|patell|fracture|torn"))
_ELIGIBLE = """eligible AS (SELECT DISTINCT player_id, season, week FROM days WHERE event_type IN ('view', 'click')),
played AS (SELECT DISTINCT player_id, season, week FROM days WHERE event_type = 'purchase')"""


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("player_id"), (2022 + F.col("event_id") % 3).cast("int").alias("season"), F.dayofmonth("ts").alias("week"), "event_type", "event_id")


def _eligible(spark, sf_dir):
    """Roster rows with states and codes, of which views and clicks count."""
    d = _days(spark, sf_dir)
    e = F.col("event_type")
    d = d.withColumn("status", F.when(e == "purchase", "CUT").otherwise("ACT"))
    d = d.withColumn("code", F.when(e == "view", "A01").when(e == "error", "R06").when(e == "signup", "P02"))
    return durability.eligible_weeks(d)


def _played(spark, sf_dir):
    one = lambda t: F.when(F.col("event_type") == t, 1)
    return durability.played_weeks(_days(spark, sf_dir).withColumns({"targets": one("purchase"), "carries": F.lit(None).cast("int"), "attempts": F.lit(0)}))


def _spells(spark, sf_dir):
    rows = _days(spark, sf_dir).withColumns({c: F.expr(e) for c, e in _REPORTS.items()})
    return durability.spells(durability.injury_weeks(rows))


@query("c13_eligible_weeks", f"WITH {_DAYS}, {_ELIGIBLE} SELECT * FROM eligible")
def c13_eligible_weeks(spark, sf_dir):
    return _eligible(spark, sf_dir)


@query("c14_played_weeks", f"WITH {_DAYS}, {_ELIGIBLE} SELECT * FROM played")
def c14_played_weeks(spark, sf_dir):
    return _played(spark, sf_dir)


@query("c15_injury_spells", f"WITH {_SPELLS} SELECT * FROM spells")
def c15_injury_spells(spark, sf_dir):
    return _spells(spark, sf_dir)


_LEDGER = f"""{_SPELLS}, {_ELIGIBLE}, e AS (SELECT player_id, season, count(*) AS eligible FROM eligible GROUP BY ALL),
p AS (SELECT player_id, season, count(*) AS played FROM played JOIN eligible USING (player_id, season, week) GROUP BY ALL),
s AS (SELECT player_id, season, count(*) AS spells, array_to_string(list_sort(list(DISTINCT cause)), '; ') AS causes, count(*) FILTER ({_SOFT_SQL.format('cause')}) AS soft_tissue, count(*) FILTER ({_STRUCTURAL_SQL.format('cause')}) AS structural FROM spells GROUP BY ALL),
ledger AS (SELECT player_id, season, coalesce(eligible, 0) AS eligible, coalesce(played, 0) AS played, greatest(coalesce(eligible, 0) - coalesce(played, 0), 0) AS missed,
  coalesce(spells, 0) AS spells, coalesce(causes, '') AS causes, coalesce(soft_tissue, 0) AS soft_tissue, coalesce(structural, 0) AS structural
  FROM (SELECT player_id, season FROM e UNION SELECT player_id, season FROM played UNION SELECT player_id, season FROM s) LEFT JOIN e USING (player_id, season) LEFT JOIN p USING (player_id, season) LEFT JOIN s USING (player_id, season))"""


@query("c16_ledger", f"WITH {_LEDGER} SELECT * FROM ledger")
def c16_ledger(spark, sf_dir):
    out = durability.ledger(_eligible(spark, sf_dir), _played(spark, sf_dir), _spells(spark, sf_dir))
    return out.select("player_id", "season", "eligible", "played", "missed", "spells", F.array_join("causes", "; ").alias("causes"), "soft_tissue", "structural")


@query("c17_top_causes", f"""WITH {_SPELLS}, n AS (SELECT player_id, cause, count(*) AS n FROM spells GROUP BY ALL)
SELECT player_id, string_agg(cause, '; ' ORDER BY n DESC, cause) AS top_causes FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY n DESC, cause) AS k FROM n) WHERE k <= 3 GROUP BY player_id""")  # fmt: skip
def c17_top_causes(spark, sf_dir):
    return durability.top_causes(_spells(spark, sf_dir)).withColumn("top_causes", F.array_join("top_causes", "; "))


_FIRST = "SELECT * FROM (VALUES (2022, DATE '2022-01-01'), (2023, DATE '2023-01-01'), (2024, DATE '2024-01-01')) AS w(season, first_day)"
_ENDING = f"""first_days AS ({_FIRST}), later AS (
  SELECT s.player_id, s.season, s.cause, s.first_week, s.last_week, sum(CASE WHEN p.week IS NULL THEN 0 ELSE 1 END) AS after, sum(CASE WHEN p.week IS NULL THEN 1 ELSE 0 END) AS unplayed
  FROM spells s JOIN eligible e ON s.player_id = e.player_id AND s.season = e.season AND e.week >= s.first_week LEFT JOIN played p ON p.player_id = e.player_id AND p.season = e.season AND p.week = e.week WHERE {_STRUCTURAL_SQL.format('s.cause')} GROUP BY ALL),
ended AS (SELECT *, first_day + CAST(7 * (last_week - 1) AS INT) AS last_listed FROM later JOIN first_days USING (season) WHERE after = 0 AND unplayed >= 4),
ending AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY last_listed DESC, first_week DESC, cause) AS n FROM ended WHERE last_listed >= DATE '2023-04-01') WHERE n = 1)"""


def _ending(spark, sf_dir):
    return durability.season_ending(_spells(spark, sf_dir), _eligible(spark, sf_dir), _played(spark, sf_dir), spark.sql(_FIRST), F.lit("2023-04-01").cast("date"))


@query("c18_season_ending", f"WITH {_SPELLS}, {_ELIGIBLE}, {_ENDING} SELECT player_id, season, cause, CAST(last_listed AS DATE) AS last_listed, CAST(unplayed AS BIGINT) AS unplayed FROM ending")
def c18_season_ending(spark, sf_dir):
    return _ending(spark, sf_dir)


_TRAILING = """last_played AS (SELECT e.player_id, e.season, max(p.week) AS w FROM eligible e JOIN played p USING (player_id, season, week) GROUP BY ALL),
absences AS (SELECT player_id, season, count(*) FILTER (w IS NULL OR week > w) AS trailing_missed FROM eligible LEFT JOIN last_played USING (player_id, season) GROUP BY ALL)"""


@query("c19_trailing_absence", f"WITH {_DAYS}, {_ELIGIBLE}, {_TRAILING} SELECT * FROM absences")
def c19_trailing_absence(spark, sf_dir):
    return durability.trailing_absence(_eligible(spark, sf_dir), _played(spark, sf_dir))


#: The state now, of players who are the users of the log, some of them without one; a customer is a person with a birth date.
_STATE = "SELECT c_custkey AS player_id, CASE c_custkey % 4 WHEN 0 THEN 'IR' WHEN 1 THEN ' ' END AS status, CASE c_custkey % 3 WHEN 0 THEN 'Knee - Torn ACL' WHEN 1 THEN '' END AS body_part, CASE WHEN c_custkey % 11 = 0 THEN 17 WHEN c_custkey % 7 = 0 THEN 3 END AS known_missed FROM {customer} WHERE c_custkey % 5 > 0"
_USERS = "SELECT c_custkey AS player_id, CASE c_custkey % 4 WHEN 0 THEN 'WR' WHEN 1 THEN 'RB' WHEN 2 THEN 'TE' ELSE 'QB' END AS position, CASE WHEN c_custkey % 9 > 0 THEN CAST(CAST(1985 + c_custkey % 15 AS VARCHAR(4)) || '-03-0' || CAST(1 + c_custkey % 9 AS VARCHAR(1)) AS DATE) END AS birth_date FROM {customer}"


@query("c20_durability_summary", f"""WITH {_LEDGER}, {_ENDING}, {_TRAILING}, people AS ({_USERS.format(customer='customer')}), state AS ({_STATE.format(customer='customer')}),
t AS (SELECT player_id, sum(eligible) AS eligible_3y, sum(played) AS played_3y, sum(missed) AS missed_3y, sum(spells) AS events, count(*) FILTER (spells > 0) AS seasons_with_events, sum(soft_tissue) AS soft_tissue, count(*) FILTER (soft_tissue > 0) AS soft_seasons FROM ledger GROUP BY player_id),
j AS (SELECT p.*, t.* EXCLUDE (player_id), e.cause, e.season, coalesce(l.trailing_missed, 0) AS trailing_missed, nullif(trim(s.status), '') AS status, nullif(trim(s.body_part), '') AS body_part, coalesce(known_missed, 0) AS known_missed, round(missed_3y / nullif(eligible_3y, 0), 4) AS miss_rate
  FROM people p LEFT JOIN t USING (player_id) LEFT JOIN ending e USING (player_id) LEFT JOIN (SELECT * FROM absences WHERE season = 2024) l USING (player_id) LEFT JOIN state s USING (player_id)),
r AS (SELECT *, (cause IS NOT NULL OR (coalesce({_STRUCTURAL_SQL.format('body_part')}, false) AND trailing_missed >= 4)) AND known_missed < 17 AS structural_return,
  coalesce(miss_rate >= 0.2 AND events >= 2 AND seasons_with_events >= 2, false) OR coalesce(soft_tissue >= 2 AND soft_seasons >= 2, false) AS injury_prone,
  CASE position WHEN 'RB' THEN 3.8 WHEN 'TE' THEN 3.2 WHEN 'QB' THEN 2.5 ELSE 3.3 END::DOUBLE AS base FROM j)
SELECT player_id, CAST(eligible_3y AS BIGINT) AS eligible_3y, CAST(missed_3y AS BIGINT) AS missed_3y, miss_rate, injury_prone, structural_return, CASE WHEN structural_return THEN coalesce(cause, body_part) END AS structural_cause,
  CAST(CASE WHEN structural_return THEN coalesce(season, CASE WHEN trailing_missed >= 4 THEN 2024 END) END AS INT) AS structural_season, status, body_part, CAST(known_missed AS INT) AS known_missed, round((DATE '2026-09-10' - birth_date) / 365.25, 2) AS age,
  round(greatest(0.0::DOUBLE, least(17 - known_missed, 17 - base - CASE WHEN missed_3y / eligible_3y > base / 17 THEN (missed_3y / eligible_3y - base / 17) / 0.20 ELSE 0 END)), 2) AS e_games FROM r""")  # fmt: skip
def c20_durability_summary(spark, sf_dir):
    people, state = (spark.sql(q, customer=table(spark, sf_dir, "customer")) for q in (_USERS, _STATE))
    spells = settle(_spells(spark, sf_dir), "spells")
    led = durability.ledger(_eligible(spark, sf_dir), _played(spark, sf_dir), spells)
    ending = durability.season_ending(spells, _eligible(spark, sf_dir), _played(spark, sf_dir), spark.sql(_FIRST), F.lit("2023-04-01").cast("date"))
    trailing = durability.trailing_absence(_eligible(spark, sf_dir), _played(spark, sf_dir))
    out = durability.summary(led, people, durability.top_causes(spells), ending, trailing, state, 2024, F.lit("2026-09-10").cast("date"))
    return out.select("player_id", "eligible_3y", "missed_3y", "miss_rate", "injury_prone", "structural_return", "structural_cause", "structural_season", "status", "body_part", "known_missed", "age", "e_games")


@query("c21_expected_games", f"""WITH {ctes('pool')}, b AS (SELECT *, adp / 10 AS rnd, CAST(player_id % 9 AS DOUBLE) AS missed, CAST(player_id % 23 AS DOUBLE) AS played, CAST(player_id % 23 + player_id % 9 AS DOUBLE) AS eligible,
  CASE WHEN player_id % 7 = 0 THEN CAST(player_id % 6 AS INT) END AS known FROM pool),
c AS (SELECT *, CASE position WHEN 'RB' THEN CASE WHEN rnd <= 2 THEN 2.4 WHEN rnd <= 5 THEN 3.3 ELSE 3.8 END WHEN 'TE' THEN CASE WHEN rnd <= 2 THEN 2.0 WHEN rnd <= 5 THEN 2.6 ELSE 3.2 END
  WHEN 'QB' THEN CASE WHEN rnd <= 2 THEN 1.5 WHEN rnd <= 5 THEN 2.0 ELSE 2.5 END ELSE CASE WHEN rnd <= 2 THEN 2.2 WHEN rnd <= 5 THEN 2.8 ELSE 3.3 END END::DOUBLE AS base FROM b),
d AS (SELECT *, CASE WHEN played >= 8 AND missed / eligible > base / 17 THEN (missed / eligible - base / 17) / 0.20 ELSE 0 END AS extra FROM c)
SELECT player_id, round(greatest(0.0::DOUBLE, least(17 - coalesce(known, 0), 17 - base - extra)), 2) AS e_games FROM d""")  # fmt: skip
def c21_expected_games(spark, sf_dir):
    p = bound(spark, sf_dir, "pool")
    i = F.col("player_id")
    e = features.expected_games(F.col("adp") / 10, F.col("position"), (i % 9).cast("double"), (i % 23 + i % 9).cast("double"), (i % 23).cast("double"), F.when(i % 7 == 0, (i % 6).cast("int")))
    return p.select("player_id", e.alias("e_games"))


AGE_FACTOR_SQL = """CASE position WHEN 'RB' THEN CASE WHEN floor(age) <= 27 THEN 1.0 WHEN floor(age) <= 28 THEN 0.97 WHEN floor(age) <= 29 THEN 0.92 WHEN floor(age) <= 30 THEN 0.85 ELSE 0.78 END
  WHEN 'WR' THEN CASE WHEN floor(age) <= 23 THEN 1.05 WHEN floor(age) <= 29 THEN 1.0 WHEN floor(age) <= 31 THEN 0.96 ELSE 0.88 END WHEN 'TE' THEN CASE WHEN floor(age) <= 25 THEN 1.03 WHEN floor(age) <= 31 THEN 1.0 ELSE 0.93 END
  WHEN 'QB' THEN CASE WHEN floor(age) <= 35 THEN 1.0 ELSE 0.95 END ELSE 1.0 END::DOUBLE"""


@query("c22_age", f"""WITH {ctes('players')}, a AS (SELECT *, date_diff('day', birth_date, DATE '2001-09-01') / 365.25 AS age FROM players)
SELECT player_id, round(age, 6) AS age, {AGE_FACTOR_SQL} AS age_factor,
  coalesce(CASE position WHEN 'RB' THEN floor(age) >= 29 WHEN 'WR' THEN floor(age) >= 31 WHEN 'TE' THEN floor(age) >= 32 END, false) AS past_cliff FROM a""")  # fmt: skip
def c22_age(spark, sf_dir):
    p = bound(spark, sf_dir, "players").withColumn("age", features.age_at(F.col("birth_date"), F.lit("2001-09-01").cast("date")))
    pos, age = F.col("position"), F.col("age")
    return p.select("player_id", F.round("age", 6).alias("age"), features.age_factor(pos, age).alias("age_factor"), features.past_cliff(pos, age).alias("past_cliff"))


@query("c23_depth_chart", """WITH charts AS (SELECT CAST(ts AS DATE) AS dt, event_type AS team, user_id AS player_id, CAST(min(1 + floor(value)) AS INT) AS depth FROM events GROUP BY ALL),
latest AS (SELECT team, max(dt) AS now FROM charts GROUP BY team), past AS (SELECT team, max(dt) AS before FROM charts JOIN latest USING (team) WHERE dt <= now - 7 GROUP BY team),
per AS (SELECT team, player_id, now, min(depth) FILTER (dt = now) AS depth_rank, min(depth) FILTER (dt = before) AS depth_before FROM charts JOIN latest USING (team) LEFT JOIN past USING (team) WHERE dt = now OR dt = before GROUP BY ALL)
SELECT player_id, team, now AS as_of, depth_rank, depth_before, depth_rank - depth_before AS depth_change FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY now DESC, depth_rank, team) AS n FROM per WHERE depth_rank IS NOT NULL) WHERE n = 1""")  # fmt: skip
def c23_depth_chart(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    charts = e.groupBy(F.to_date("ts").alias("dt"), F.col("event_type").alias("team"), F.col("user_id").alias("player_id")).agg(F.min(1 + F.floor("value")).cast("int").alias("depth"))
    return durability.chart_change(charts, 7)


@query("c24_season_frame", f"""{_RANKED}, stint AS (SELECT player_id, season, team, sum(targets) AS t FROM reg GROUP BY ALL),
sh AS (SELECT player_id, season, sum(CASE WHEN tt <> 0 THEN t / tt ELSE 0 END) AS s FROM (SELECT *, sum(t) OVER (PARTITION BY season, team) AS tt FROM stint) GROUP BY ALL)
SELECT player_id, season, r.games, s.ppg, r.ppg_rank, round(sh.s, 6) AS targets_share FROM ranked r JOIN seasons s USING (player_id, season) LEFT JOIN sh USING (player_id, season)""")  # fmt: skip
def c24_season_frame(spark, sf_dir):
    shares = features.season_shares(regular(spark, sf_dir), ["targets"])
    out = features.positional_ranks(seasons(spark, sf_dir)).join(shares, ["player_id", "season"], "left")
    return out.select("player_id", "season", "games", "ppg", "ppg_rank", F.round("targets_share", 6).alias("targets_share"))


@query("c25_bye_weeks", """WITH g AS (SELECT year(o_orderdate) AS season, CAST(floor((dayofyear(o_orderdate) + 6) / 7) AS INT) AS week, o_custkey % 32 AS home_team, o_orderkey % 32 AS away_team FROM orders),
s AS (SELECT season, week, home_team AS team FROM g UNION SELECT season, week, away_team FROM g), k AS (SELECT DISTINCT season, team FROM s)
SELECT season, team, CAST(w AS INT) AS week FROM k, range(1, 19) r(w) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.season = k.season AND s.team = k.team AND s.week = w)""")  # fmt: skip
def c25_bye_weeks(spark, sf_dir):
    return _byes(table(spark, sf_dir, "orders"))


def _byes(o: DataFrame) -> DataFrame:
    week = F.floor((F.dayofyear("o_orderdate") + 6) / 7).cast("int")
    return features.bye_weeks(o.select(F.year("o_orderdate").alias("season"), week.alias("week"), (F.col("o_custkey") % 32).alias("home_team"), (F.col("o_orderkey") % 32).alias("away_team")))


@query("c26_reconcile", f"""{WITH}, ours AS (SELECT player_id, season, sum(receptions) AS receptions FROM reg GROUP BY ALL),
theirs AS (SELECT l_suppkey AS player_id, year(l_shipdate) AS season, CAST(count(*) AS DOUBLE) AS receptions FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)
SELECT player_id, season, o.receptions AS our_receptions, t.receptions AS their_receptions, coalesce(abs(o.receptions - t.receptions) <= 1e-6, o.receptions IS NULL AND t.receptions IS NULL) AS receptions_agrees
FROM ours o FULL JOIN theirs t USING (player_id, season)""")  # fmt: skip
def c26_reconcile(spark, sf_dir):
    ours = regular(spark, sf_dir).groupBy("player_id", "season").agg(F.sum("receptions").alias("receptions"))
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'")
    theirs = li.groupBy(F.col("l_suppkey").alias("player_id"), F.year("l_shipdate").alias("season")).agg(F.count("*").cast("double").alias("receptions"))
    return features.reconcile(ours, theirs, ["player_id", "season"], ["receptions"])


@query("b6_vendor_ppg", f"""{WITH}, t AS (SELECT player_id, {', '.join(f'sum({c}) AS {c}' for c in ('passing_yards', 'passing_tds', 'passing_interceptions', 'rushing_yards', 'rushing_tds', 'receptions', 'receiving_yards', 'receiving_tds', 'fumbles_lost'))}
  FROM reg WHERE season = 2000 GROUP BY player_id),
per AS (SELECT player_id, season, avg({BONUS_SQL}) AS mean, count(*) AS weeks FROM reg GROUP BY ALL), w AS (SELECT *, CASE (SELECT max(season) FROM reg) - season WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 WHEN 2 THEN 0.2 ELSE 0 END * least(weeks, 17) / 17 AS w FROM per),
b AS (SELECT player_id, CASE WHEN sum(w) > 0 THEN sum(mean * w) / sum(w) ELSE 0 END AS rate FROM w GROUP BY player_id)
SELECT player_id, round(round({BASE_SQL}, 4) / greatest(6, 17 - CASE WHEN player_id % 3 = 0 THEN player_id % 15 ELSE 0 END) + coalesce(rate, 0), 6) AS vendor_ppg FROM t LEFT JOIN b USING (player_id)""")  # fmt: skip
def b6_vendor_ppg(spark, sf_dir):
    reg = regular(spark, sf_dir)
    rates = scoring.bonus_rate(reg.withColumn("bonus", scoring.bonus_points()))
    raw = [c for c in bound(spark, sf_dir, "weekly").columns if c not in ("player_id", "season", "week", "season_type", "position", "team")]
    totals = reg.filter("season = 2000").groupBy("player_id").agg(*[F.sum(c).alias(c) for c in raw])
    missed = F.when(F.col("player_id") % 3 == 0, F.col("player_id") % 15)
    return scoring.vendor_ppg(totals, rates, missed).select("player_id", F.round("vendor_ppg", 6).alias("vendor_ppg"))
