"""Opportunity projection, curated context and gates over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.operators import context, features, projection, scoring
from fieldmark.plans.bindings import bound, ctes, table
from fieldmark.plans.feature_queries import AGE_FACTOR_SQL, SEASON_SQL, WITH, regular
from fieldmark.sources.settled import settle
from fieldmark.sources.snapshots import latest_ok

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


_STATS = sorted({s for pair in projection.RATES.values() for s in pair})
_VOL = """vol AS (SELECT player_id, season, count(*) AS games, max(position) AS position, sum(targets) AS targets, sum(carries) AS carries, sum(attempts) AS attempts, sum(receptions) AS receptions,
  sum(receiving_yards) AS receiving_yards, sum(receiving_tds) AS receiving_tds, sum(rushing_yards) AS rushing_yards, sum(rushing_tds) AS rushing_tds, sum(passing_yards) AS passing_yards, sum(passing_tds) AS passing_tds,
  sum(passing_interceptions) AS passing_interceptions FROM reg GROUP BY ALL)"""
_SHARE = """stint AS (SELECT player_id, season, team, sum(targets) AS t FROM reg GROUP BY ALL), shares AS (SELECT player_id, season, sum(CASE WHEN tt <> 0 THEN t / tt ELSE 0 END) AS targets_share FROM
  (SELECT *, sum(t) OVER (PARTITION BY season, team) AS tt FROM stint) GROUP BY ALL),
frame AS (SELECT player_id, season, games, position, team, role_key, targets_share, 1 + player_id % 3 AS depth_rank, 1 + player_id % 5 AS draft_round FROM seasons JOIN shares USING (player_id, season))"""
_FRAME = f"{SEASON_SQL}, {_SHARE}"
_EACH = "pg AS (SELECT *, least(greatest(targets_share * 17 / greatest(games, 8), 0), 1) AS pg FROM frame)"
_PG = f"{_FRAME}, {_EACH}"
#: Kinds of work, and whether what a team has free of it goes to its players.
WORK = {"targets": True, "carries": True, "attempts": False}


def player_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player-seasons with their role, sums and shares: what the projection needs of the weekly lines."""
    lines = regular(spark, sf_dir)
    s = features.season_totals(lines, scoring.points(), _STATS).select("player_id", "season", "games", "position", "team", "role_key", *_STATS)
    return s.join(features.season_shares(lines, list(WORK)), ["player_id", "season"], "left")


def framed(seasons: DataFrame) -> DataFrame:
    """Player-seasons that have shares, with a depth rank and a draft round."""
    out = seasons.filter("targets_share is not null").withColumns({"depth_rank": 1 + F.col("player_id") % 3, "draft_round": 1 + F.col("player_id") % 5})
    return projection.share_per_game(out, F.lit(17), F.col("games"), [f"{w}_share" for w in WORK])


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framed(player_seasons(spark, sf_dir))


@query("g1_volume", f"{WITH}, {_VOL} SELECT player_id, season, games, targets, rushing_yards, passing_interceptions FROM vol")
def g1_volume(spark, sf_dir):
    return projection.volume(regular(spark, sf_dir)).select("player_id", "season", "games", "targets", "rushing_yards", "passing_interceptions")


@query("g2_share_per_game", f"{_PG} SELECT player_id, season, round(pg, 6) AS pg FROM pg")
def g2_share_per_game(spark, sf_dir):
    return frame(spark, sf_dir).select("player_id", "season", F.round("targets_share_pg", 6).alias("pg"))


_OWN = """enough AS (SELECT * FROM pg WHERE games >= 8), last AS (SELECT player_id, arg_max(role_key, season) AS role FROM enough GROUP BY player_id),
w AS (SELECT e.*, CASE 2001 - season WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 WHEN 2 THEN 0.2 ELSE 0 END AS w FROM enough e JOIN last USING (player_id) WHERE role_key = role),
own AS (SELECT player_id, CASE WHEN sum(w) > 0 THEN sum(w * pg) / sum(w) END AS own, sum(games) AS own_games FROM w GROUP BY player_id)"""


@query("g3_own_share", f"{_PG}, {_OWN} SELECT player_id, round(own, 6) AS own, CAST(own_games AS BIGINT) AS games FROM own")
def g3_own_share(spark, sf_dir):
    return projection.own_share(frame(spark, sf_dir), "targets_share_pg", 2001).withColumn("own", F.round("own", 6))


_SLOTS = """m AS (SELECT position, depth_rank, avg(pg) AS mean, count(*) AS n FROM pg GROUP BY ALL HAVING count(*) >= 8), slots AS (SELECT position, depth_rank, min(mean) OVER (PARTITION BY position ORDER BY depth_rank) AS slot FROM m)"""


@query("g4_slot_baseline", f"{_PG}, {_SLOTS} SELECT position, depth_rank, round(slot, 6) AS slot FROM slots")
def g4_slot_baseline(spark, sf_dir):
    return projection.slot_baseline(frame(spark, sf_dir), "targets_share_pg").withColumn("slot", F.round("slot", 6))


_ROUNDS = """r AS (SELECT position, draft_round, avg(pg) AS mean FROM pg GROUP BY ALL), rq AS (SELECT *, mean / nullif(max(mean) FILTER (draft_round = 1) OVER (PARTITION BY position), 0) AS q FROM r), rf AS (SELECT *, CASE WHEN q IS NOT NULL THEN least(greatest(q, 0.2), 1.0) END AS f FROM rq),
factors AS (SELECT position, draft_round, min(f) OVER (PARTITION BY position ORDER BY draft_round) AS factor FROM rf)"""


@query("g5_round_factors", f"{_PG}, {_ROUNDS} SELECT position, draft_round, round(factor, 6) AS factor FROM factors")
def g5_round_factors(spark, sf_dir):
    return projection.round_factors(frame(spark, sf_dir), "targets_share_pg").withColumn("factor", F.round("factor", 6))


def _rate_sql(name: str, a: str, n: str, k: int) -> str:
    mean = f"coalesce(sum({a}) OVER p / nullif(sum({n}) OVER p, 0), 0)"
    return f"{n} / ({n} + {k}) * coalesce({a} / nullif({n}, 0), {mean}) + (1 - {n} / ({n} + {k})) * {mean} AS {name}"


_HISTORY = f"""h AS (SELECT v.*, s.role_key FROM vol v JOIN seasons s USING (player_id, season)), hl AS (SELECT player_id, arg_max(role_key, season) AS role FROM h GROUP BY player_id),
same AS (SELECT h.* FROM h JOIN hl USING (player_id) WHERE role_key = role AND targets + carries + attempts > 0), used AS (SELECT * FROM same UNION ALL SELECT * FROM h WHERE player_id NOT IN (SELECT player_id FROM same)),
history AS (SELECT player_id, arg_max(position, season) AS position, {', '.join(f'sum({s}) AS {s}' for s in _STATS)} FROM used GROUP BY player_id),
rates AS (SELECT player_id, position, {', '.join(_rate_sql(n, a, b, projection.SHRINK[n]) for n, (a, b) in projection.RATES.items())} FROM history WINDOW p AS (PARTITION BY position))"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.efficiency_history(player_seasons(spark, sf_dir))


@query("g7_efficiency_history", f"{SEASON_SQL}, {_VOL}, {_HISTORY} SELECT player_id, position, targets, rushing_yards, attempts FROM history")
def g7_efficiency_history(spark, sf_dir):
    return history(spark, sf_dir).select("player_id", "position", "targets", "rushing_yards", "attempts")


@query("g6_shrunk_rates", f"{SEASON_SQL}, {_VOL}, {_HISTORY} SELECT player_id, {', '.join(f'round({n}, 6) AS {n}' for n in projection.RATES)} FROM rates")
def g6_shrunk_rates(spark, sf_dir):
    return projection.shrunk_rates(history(spark, sf_dir)).select("player_id", *[F.round(n, 6).alias(n) for n in projection.RATES])


@query("g8_stability", f"""{WITH}, {_VOL}, r AS (SELECT player_id, season, position, receiving_yards / targets AS rate, CAST(targets AS DOUBLE) AS n FROM vol WHERE targets >= 10),
c AS (SELECT *, rate - avg(rate) OVER (PARTITION BY season, position) AS centred FROM r), b AS (SELECT a.centred AS x, z.centred AS y, a.n AS n1, z.n AS n2 FROM c a JOIN c z ON a.player_id = z.player_id AND z.season = a.season + 1),
o AS (SELECT count(*) AS pairs, corr(x, y) AS r, 2 / avg(1 / n1 + 1 / n2) AS n FROM b) SELECT 'ypt' AS rate, pairs, round(r, 6) AS r, round(CASE WHEN pairs >= 15 AND r > 0 THEN n * (1 - r) / r END, 3) AS k FROM o""")  # fmt: skip
def g8_stability(spark, sf_dir):
    out = projection.stability(projection.volume(regular(spark, sf_dir)), "ypt", least=10)
    return out.select("rate", "pairs", F.round("r", 6).alias("r"), F.round("k", 3).alias("k"))


_NOW = """deep AS (SELECT position, max(depth_rank) AS deepest FROM slots GROUP BY position), now AS (SELECT f.player_id, f.position, f.team, f.depth_rank, f.draft_round, f.player_id % 13 = 0 AS is_rookie FROM pg f WHERE season = 2001),
src AS (SELECT n.*, o.own, o.own_games, s.slot, fa.factor FROM now n LEFT JOIN own o USING (player_id) LEFT JOIN deep d ON d.position = n.position LEFT JOIN slots s ON s.position = n.position AND s.depth_rank = least(n.depth_rank, deepest)
  LEFT JOIN factors fa ON fa.position = n.position AND fa.draft_round = n.draft_round),
v AS (SELECT *, CASE WHEN slot IS NULL THEN 1.0 ELSE own_games / (own_games + 8) END AS v FROM src),
shared AS (SELECT *, coalesce(CASE WHEN position = 'QB' AND depth_rank > 1 THEN slot WHEN own IS NOT NULL THEN v * own + (1 - v) * coalesce(slot, 0) WHEN is_rookie THEN slot * coalesce(factor, 1.0) ELSE slot END, 0) AS share,
  CASE WHEN position = 'QB' AND depth_rank > 1 THEN 'slot' WHEN own IS NOT NULL THEN 'own' WHEN is_rookie THEN 'rookie' ELSE 'slot' END AS share_source FROM v)"""
_SHARED = f"{_PG}, {_OWN}, {_SLOTS}, {_ROUNDS}, {_NOW}"


def shared(f: DataFrame, work: str = "targets") -> DataFrame:
    """Shares of a kind of work of the latest season's players; ``f`` is read for each of their sources, so it is settled."""
    column = f"{work}_share_pg"
    own = projection.own_share(f, column, 2001).withColumnRenamed("games", "own_games")
    now = f.filter("season = 2001").select("player_id", "position", "team", "depth_rank", "draft_round", (F.col("player_id") % 13 == 0).alias("is_rookie"))
    p = projection.slot_of(now, projection.slot_baseline(f, column)).join(own, "player_id", "left")
    return projection.share_source(p.join(projection.round_factors(f, column), ["position", "draft_round"], "left"))


@query("g9_share_source", f"{_SHARED} SELECT player_id, round(share, 6) AS share, share_source FROM shared")
def g9_share_source(spark, sf_dir):
    return shared(settle(frame(spark, sf_dir), "seasons")).select("player_id", F.round("share", 6).alias("share"), "share_source")


@query("g10_measured_budget", f"{_FRAME}, s AS (SELECT season, team, sum(targets_share * 17 / games) AS s FROM frame WHERE games >= 3 AND targets_share >= 0.01 GROUP BY ALL) SELECT round(quantile_cont(s, 0.5), 6) AS budget FROM s")
def g10_measured_budget(spark, sf_dir):
    return projection.measured_budget(frame(spark, sf_dir), "targets_share").select(F.round("budget", 6).alias("budget"))


_FIT = """real AS (SELECT season, team, sum(targets_share * 17 / games) AS s FROM frame WHERE games >= 3 AND targets_share >= 0.01 GROUP BY ALL), bud AS (SELECT coalesce(quantile_cont(s, 0.5), 1.0) AS budget FROM real),
had AS (SELECT *, sum(share) OVER (PARTITION BY team) AS had FROM shared), g AS (SELECT *, CASE WHEN team IS NOT NULL AND had > 0 THEN least(share / had * greatest(0.0, (SELECT budget FROM bud) - had), 0.5 * share) ELSE 0 END AS gain FROM had),
n AS (SELECT *, sum(share + gain) OVER (PARTITION BY team) AS now_had FROM g), fit AS (SELECT *, (share + gain) * CASE WHEN team IS NOT NULL AND now_had > (SELECT budget FROM bud) THEN (SELECT budget FROM bud) / now_had ELSE 1 END AS final FROM n)"""


def fitted(f: DataFrame, work: str = "targets") -> DataFrame:
    """The same within the measured budget of that work."""
    return projection.fit_to_budget(shared(f, work), projection.measured_budget(f, f"{work}_share"), WORK[work])


def team_work(lines: DataFrame, season: int) -> DataFrame:
    """(team, targets_team, carries_team, attempts_team): a team's work a game in a season."""
    games = F.count_distinct("week")
    return lines.filter(F.col("season") == season).groupBy("team").agg(*[F.round(F.sum(w) / games, 2).alias(f"{w}_team") for w in WORK])


@query("g11_fit_to_budget", f"{_SHARED}, {_FIT} SELECT player_id, round(gain, 6) AS gain, round(final, 6) AS share FROM fit")
def g11_fit_to_budget(spark, sf_dir):
    return fitted(settle(frame(spark, sf_dir), "seasons")).select("player_id", F.round("gain", 6).alias("gain"), F.round("share", 6).alias("share"))


_CONTEXT = """CASE WHEN position IN ('RB', 'WR', 'TE') THEN CASE player_id % 5 WHEN 1 THEN 0.04 WHEN 2 THEN 0.02 WHEN 4 THEN -0.03 ELSE 0 END + CASE WHEN player_id % 7 = 0 THEN -0.02 ELSE 0 END ELSE 0 END
  + (player_id % 5 - 2) * CASE position WHEN 'QB' THEN 0.015 WHEN 'RB' THEN 0.01 ELSE 0 END + CASE WHEN player_id % 2 = 0 THEN -0.01 ELSE 0 END"""


def _context() -> F.Column:
    i = F.col("player_id")
    return projection.context_factor(F.col("position"), i % 5, i % 7 == 0, i % 5 - 2, i % 2 == 0)


@query("g12_context_factor", f"{WITH} SELECT player_id, round(least(greatest(1 + {_CONTEXT}, 0.94), 1.06), 4) AS factor FROM players")
def g12_context_factor(spark, sf_dir):
    return bound(spark, sf_dir, "players").select("player_id", _context().alias("factor"))


def _fit_sql(work: str) -> str:
    """The whole of a kind's shares as one table: player_id, position, team and what he has of it."""
    text = f"WITH {_SHARE}, {_EACH}, {_OWN}, {_SLOTS}, {_ROUNDS}, {_NOW}, {_FIT} SELECT player_id, position, team, final FROM fit".replace("sum(targets) AS t", f"sum({work}) AS t").replace("targets_share", f"{work}_share")
    return text if WORK[work] else text.replace("CASE WHEN team IS NOT NULL AND had > 0 THEN least(share / had * greatest(0.0, (SELECT budget FROM bud) - had), 0.5 * share) ELSE 0 END AS gain", "0.0 AS gain")


@query("g13_projection", f"""{SEASON_SQL}, {', '.join(f'{w}_fit AS ({_fit_sql(w)})' for w in WORK)}, {_VOL}, {_HISTORY},
per_team AS (SELECT team, {', '.join(f'round(sum({w}) / count(DISTINCT week), 2) AS {w}_team' for w in WORK)} FROM reg WHERE season = 2001 GROUP BY team),
aged AS (SELECT player_id, {AGE_FACTOR_SQL} AS aged FROM (SELECT player_id, position, (DATE '2001-09-01' - birth_date) / 365.25 AS age FROM players)),
ppg AS (SELECT player_id, t.position AS pos, targets_team * t.final * (ypt * 0.1 + catch * CASE t.position WHEN 'TE' THEN 1.0 ELSE 0.5 END + rec_td * 6) + carries_team * c.final * (ypc * 0.1 + rush_td * 6) + attempts_team * a.final * (ypa * 0.04 + pass_td * 6 - pass_int * 2) AS raw
  FROM targets_fit t JOIN carries_fit c USING (player_id) JOIN attempts_fit a USING (player_id) JOIN per_team ON per_team.team = t.team JOIN rates USING (player_id))
SELECT player_id, round(round(raw, 4) * coalesce(aged, 1.0) * round(least(greatest(1 + {_CONTEXT.replace('position', 'pos')}, 0.94), 1.06), 4), 3) AS inhouse_ppg
FROM ppg LEFT JOIN aged USING (player_id)""")  # fmt: skip
def g13_projection(spark, sf_dir):
    """Shares of targets, carries and passes, each with own and slot shares and a measured budget, of what a team has of them
    a game; shrunk rates, a league's scoring (tight ends get a point a catch), age and context, as points a game."""
    s = settle(player_seasons(spark, sf_dir), "seasons")
    f = framed(s)
    p = projection.shrunk_rates(projection.efficiency_history(s))
    for w in WORK:
        p = p.join(fitted(f, w).select("player_id", F.col("share").alias(f"{w}_share"), *(["team"] if w == "targets" else [])), "player_id")
    p = p.join(F.broadcast(team_work(regular(spark, sf_dir), 2001)), "team")  # a row a team
    born = bound(spark, sf_dir, "players").select("player_id", features.age_at(F.col("birth_date"), F.lit("2001-09-01").cast("date")).alias("age"))
    p = p.join(born, "player_id", "left").withColumns({f"{w}_pg": F.col(f"{w}_share") * F.col(f"{w}_team") for w in WORK})
    out = projection.points_per_game(p, features.age_factor(F.col("position"), F.col("age")), _context(), overrides={"TE": {"rec": 1.0}})
    return out.select("player_id", F.round("inhouse_ppg", 3).alias("inhouse_ppg"))


def _curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.when(i == 7, 99).when(i == 8, 9).otherwise(i).alias("team"), F.when(i % 6 > 0, F.concat(F.lit("u"), i)).otherwise(" ").alias("source_url"), (i % 6).alias("tier"),
        F.when(i % 10 > 0, F.date_sub(F.lit("2026-09-01").cast("date"), i)).alias("last_checked"), F.when(i % 9 == 0, "low").otherwise("high").alias("confidence"),
    )


_CURATED = """cur AS (SELECT CASE n_nationkey WHEN 7 THEN 99 WHEN 8 THEN 9 ELSE n_nationkey END AS team, CASE WHEN n_nationkey % 6 > 0 THEN concat('u', n_nationkey) ELSE ' ' END AS source_url, n_nationkey % 6 AS tier,
  CASE WHEN n_nationkey % 10 > 0 THEN DATE '2026-09-01' - n_nationkey END AS last_checked, CASE WHEN n_nationkey % 9 = 0 THEN 'low' ELSE 'high' END AS confidence FROM nation)"""


@query("f1_problems", f"""WITH {_CURATED} SELECT 'qb' AS "table", CAST(NULL AS VARCHAR) AS key, 'row count' AS problem WHERE (SELECT count(*) FROM cur) <> 32 UNION ALL SELECT 'qb', CAST(team AS VARCHAR), 'unknown key' FROM cur WHERE team = 99
UNION ALL SELECT 'qb', CAST(team AS VARCHAR), 'repeated key' FROM cur GROUP BY team HAVING count(*) > 1 UNION ALL SELECT 'qb', CAST(team AS VARCHAR), 'no source' FROM cur WHERE trim(source_url) = ''
UNION ALL SELECT 'qb', CAST(team AS VARCHAR), 'no date' FROM cur WHERE last_checked IS NULL UNION ALL SELECT 'qb', CAST(team AS VARCHAR), 'confidence not allowed' FROM cur WHERE confidence <> 'high' UNION ALL SELECT 'qb', CAST(team AS VARCHAR), 'tier out of range' FROM cur WHERE tier NOT BETWEEN 1 AND 4""")  # fmt: skip
def f1_problems(spark, sf_dir):
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team"))
    return context.problems(_curated(spark, sf_dir), "qb", "team", known, 32, {"confidence": ["high"]}, {"tier": (1, 4)})


@query("f2_merge", f"""WITH {_CURATED}, a AS (SELECT * FROM cur WHERE team < 20), b AS (SELECT * FROM cur WHERE team > 9 AND team < 99), m AS (SELECT coalesce(a.team, b.team) AS team, a.last_checked AS x, b.last_checked AS y, a.confidence AS p, b.confidence AS q, a.tier AS tier, b.tier + 1 AS tier2 FROM a FULL JOIN b ON a.team = b.team)
SELECT team, tier, tier2, least(x, y) AS oldest_check, concat_ws('; ', CASE WHEN DATE '2026-09-05' - x > 7 THEN concat('qb checked ', DATE '2026-09-05' - x, ' days ago') END, CASE WHEN p = 'low' THEN 'qb unsure' END,
  CASE WHEN DATE '2026-09-05' - y > 7 THEN concat('line checked ', DATE '2026-09-05' - y, ' days ago') END, CASE WHEN q = 'low' THEN 'line unsure' END) AS warning FROM m""")  # fmt: skip
def f2_merge(spark, sf_dir):
    c = _curated(spark, sf_dir)
    parts = [("qb", c.filter("team < 20"), ["tier"]), ("line", c.filter("team > 9 and team < 99").withColumn("tier2", F.col("tier") + 1), ["tier2"])]
    return context.merge(parts, "team", F.lit("2026-09-05").cast("date")).select("team", "tier", "tier2", "oldest_check", "warning")


@query("f3_week_coverage", f"""WITH {ctes('weekly')}, w AS (SELECT season, week, count(DISTINCT team) AS t FROM weekly WHERE season_type = 'REG' GROUP BY ALL), r AS (SELECT season, min(t) AS least_teams, count(*) FILTER (t < 16) AS thin_weeks FROM w GROUP BY season),
c AS (SELECT season, list_sort(list(DISTINCT week) FILTER (season_type = 'REG')) AS reg, count(DISTINCT team) FILTER (season_type = 'REG') AS reg_teams, count(*) FILTER (season_type = 'POST') AS post_rows, list_sort(list(DISTINCT week) FILTER (season_type = 'POST')) AS post, count(*) AS rows FROM weekly GROUP BY season)
SELECT season, coalesce(array_to_string(reg, ','), '') AS reg_weeks, reg_teams, post_rows, coalesce(array_to_string(post, ','), '') AS post_weeks, rows, least_teams, thin_weeks, reg IS NOT DISTINCT FROM range(1, 19) AND reg_teams = 16 AS complete FROM c LEFT JOIN r USING (season)""")  # fmt: skip
def f3_week_coverage(spark, sf_dir):
    out = context.week_coverage(bound(spark, sf_dir, "weekly"), 16)
    return out.withColumns({c: F.array_join(c, ",") for c in ("reg_weeks", "post_weeks")})


@query("f3_status_histogram", "SELECT CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 3 > 0 THEN substr(o_orderpriority, 1, 1) END AS code, count(*) AS n FROM orders GROUP BY ALL")
def f3_status_histogram(spark, sf_dir):
    i = F.col("o_orderkey")
    return context.status_histogram(table(spark, sf_dir, "orders").select(F.when(i % 7 > 0, F.col("o_orderstatus")).alias("status"), F.when(i % 3 > 0, F.substring("o_orderpriority", 1, 1)).alias("code")))


@query("f3_row_counts", f"WITH {ctes('weekly', 'expected')} SELECT 'weekly' AS \"table\", CAST(season AS VARCHAR) AS season, count(*) AS rows FROM weekly GROUP BY season UNION ALL SELECT 'expected', season, count(*) FROM expected GROUP BY season")
def f3_row_counts(spark, sf_dir):
    season = F.col("season").cast("string").alias("season")
    return context.row_counts({n: bound(spark, sf_dir, n).select(season) for n in ("weekly", "expected")})


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("s"), F.col("user_id") % 4).alias("source"), F.col("event_type").alias("endpoint"), F.col("event_id").alias("snapshot_id"), F.col("ts").alias("fetched_at"), F.when(F.col("event_id") % 3 == 0, "failed").otherwise("ok").alias("status"))


_MAN = "manifest AS (SELECT concat('s', user_id % 4) AS source, event_type AS endpoint, event_id AS snapshot_id, ts AS fetched_at, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'ok' END AS status FROM events)"


@query("f4_stale_sources", f"WITH {_MAN}, newest AS (SELECT source, endpoint, max(fetched_at) AS at FROM manifest WHERE status = 'ok' GROUP BY ALL) SELECT source, endpoint, snapshot_id FROM manifest m JOIN newest n USING (source, endpoint) WHERE n.at > m.fetched_at")
def f4_stale_sources(spark, sf_dir):
    m = manifest(spark, sf_dir)
    return context.stale_sources(m, m).select("source", "endpoint", "snapshot_id")


@query("a8_latest_ok", f"WITH {_MAN} SELECT source, endpoint, arg_max(snapshot_id, fetched_at) AS snapshot_id FROM manifest WHERE status = 'ok' GROUP BY ALL")
def a8_latest_ok(spark, sf_dir):
    return latest_ok(manifest(spark, sf_dir)).select("source", "endpoint", "snapshot_id")


@query("h22_serving_run", "WITH r AS (SELECT o_custkey % 50 AS league_id, CAST(o_orderkey AS VARCHAR) AS run_id, o_orderdate AS started_at, o_orderstatus = 'P' AND o_orderkey % 17 = 0 AS is_frozen FROM orders) SELECT league_id, run_id, is_frozen FROM (SELECT *, row_number() OVER (PARTITION BY league_id ORDER BY is_frozen DESC, started_at DESC, run_id DESC) AS n FROM r) WHERE n = 1")
def h22_serving_run(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    runs = o.select((F.col("o_custkey") % 50).alias("league_id"), F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderdate").alias("started_at"), ((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 17 == 0)).alias("is_frozen"))
    return context.serving_run(runs).select("league_id", "run_id", "is_frozen")
