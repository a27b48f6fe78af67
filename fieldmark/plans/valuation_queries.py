"""Valuation, draft schedules and keepers over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.operators import draft, valuation
from fieldmark.plans.bindings import bound, ctes, table
from fieldmark.plans.feature_queries import SEASON_SQL, seasons
from fieldmark.sources.settled import settle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TEAMS = 10


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


KEPT = "player_id % 37 = 0"


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "pool").withColumn("kept", F.expr(KEPT))


def _baselines_sql(source: str, kept: str) -> str:
    return f"""spots AS (SELECT league_id, position, CASE position WHEN 'WR' THEN 30 WHEN 'RB' THEN 20 ELSE 10 END AS starters,
  CASE position WHEN 'QB' THEN 0.1 WHEN 'RB' THEN 0.25 WHEN 'WR' THEN 0.35 WHEN 'TE' THEN 0.1 ELSE 0 END AS share
  FROM (SELECT DISTINCT league_id FROM {source}), (VALUES ('QB'), ('WR'), ('RB'), ('TE'), ('K'), ('DEF')) p(position)),
kept AS (SELECT league_id, position, count(*) AS kept FROM {source} WHERE {kept} GROUP BY ALL),
ordered AS (SELECT league_id, position, player_id, ppg, row_number() OVER (PARTITION BY league_id, position ORDER BY ppg DESC, player_id) AS n FROM {source}),
flexed AS (SELECT league_id, position, count(*) AS flex FROM (
  SELECT o.*, row_number() OVER (PARTITION BY league_id ORDER BY ppg DESC, position DESC, player_id) AS f FROM ordered o JOIN spots s USING (league_id, position) LEFT JOIN kept k USING (league_id, position)
  WHERE position IN ('RB', 'WR', 'TE') AND n > greatest(0, starters - coalesce(kept, 0))) WHERE f <= 10 GROUP BY ALL),
lines AS (SELECT league_id, position, share, greatest(1, starters + coalesce(flex, 0) - coalesce(kept, 0)) AS vols_rank FROM spots LEFT JOIN kept USING (league_id, position) LEFT JOIN flexed USING (league_id, position)),
base AS (SELECT l.league_id, l.position, vols_rank, CAST(vols_rank + round_even(60 * share, 0) AS INT) AS vorp_rank FROM lines l),
bases AS (SELECT b.*, coalesce(a.ppg, 0) AS vols_ppg, coalesce(z.ppg, 0) AS vorp_ppg FROM base b LEFT JOIN ordered a ON a.league_id = b.league_id AND a.position = b.position AND a.n = vols_rank
  LEFT JOIN ordered z ON z.league_id = b.league_id AND z.position = b.position AND z.n = vorp_rank)"""


def _values_sql(source: str, kept: str) -> str:
    return f"""{_baselines_sql(source, kept)},
valued AS (SELECT p.*, CASE WHEN position IN ('K', 'DEF') THEN 0 ELSE round(e_games * ppg + (17 - e_games) * vorp_ppg, 3) END AS season_value,
  CASE WHEN position IN ('K', 'DEF') THEN 0 ELSE round(e_games * ppg + (17 - e_games) * vorp_ppg - 17 * vorp_ppg, 3) END AS vorp, CASE WHEN position IN ('K', 'DEF') THEN 0 ELSE round(ppg - vols_ppg, 3) END AS vols
  FROM {source} p LEFT JOIN bases b USING (league_id, position)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY league_id ORDER BY vorp DESC, adp NULLS LAST, player_id) AS overall_rank,
  row_number() OVER (PARTITION BY league_id, position ORDER BY vorp DESC, adp NULLS LAST, player_id) AS pos_rank FROM valued)"""


_POOL = f"WITH {ctes('pool')}, "


def valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pool(spark, sf_dir)
    return valuation.ranks(valuation.values(p, valuation.baselines(p, TEAMS, p.filter("kept"))))


def valued_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written: for queries that use the valued pool several times."""
    return settle(valued(spark, sf_dir), "valued")


def others_sql(candidates: str) -> str:
    """What is expected of the best other one, for rows of ``candidates`` (league_id, position, player_id, v, p): from the last
    candidate upwards one step a rank, and the heads by windows."""
    return f"""cand AS (SELECT *, row_number() OVER (PARTITION BY league_id, position ORDER BY v DESC, player_id) AS i, count(*) OVER (PARTITION BY league_id, position) AS n FROM {candidates}),
tail AS (SELECT league_id, position, n AS i, 0.0::DOUBLE AS e FROM cand WHERE i = n UNION ALL
  SELECT t.league_id, t.position, t.i - 1, c.v * c.p + (1 - c.p) * t.e FROM tail t JOIN cand c ON c.league_id = t.league_id AND c.position = t.position AND c.i = t.i),
nobody AS (SELECT *, coalesce(product(1 - p) OVER (PARTITION BY league_id, position ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS q FROM cand),
heads AS (SELECT *, coalesce(sum(v * p * q) OVER (PARTITION BY league_id, position ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS head FROM nobody),
others AS (SELECT h.league_id, h.position, h.player_id, head + q * e AS others_best FROM heads h JOIN tail t ON t.league_id = h.league_id AND t.position = h.position AND t.i = h.i)"""


@query("h1_blend", f"""{_POOL}b AS (SELECT *, CASE WHEN player_id % 4 > 0 THEN round(ppg * 0.9 + 0.5, 2) END AS own, player_id % 6 = 0 AS rookie FROM pool)
SELECT player_id, round(CASE WHEN own IS NULL THEN ppg ELSE CASE WHEN rookie THEN 0.9 ELSE 0.7 END * ppg + (1 - CASE WHEN rookie THEN 0.9 ELSE 0.7 END) * own END + weekly_sd / 100, 6) AS blended FROM b""")  # fmt: skip
def h1_blend(spark, sf_dir):
    own = F.when(F.col("player_id") % 4 > 0, F.round(F.col("ppg") * 0.9 + 0.5, 2))
    out = valuation.blend(F.col("ppg"), own, F.col("player_id") % 6 == 0, F.col("weekly_sd") / 100)
    return bound(spark, sf_dir, "pool").select("player_id", F.round(out, 6).alias("blended"))


@query("h2_draft_depth", f"{_POOL}r AS (SELECT *, row_number() OVER (PARTITION BY league_id ORDER BY adp NULLS LAST, player_id) AS n FROM pool) SELECT league_id, position, count(*) AS n FROM r WHERE n <= 120 GROUP BY ALL")
def h2_draft_depth(spark, sf_dir):
    return valuation.draft_depth(bound(spark, sf_dir, "pool"), 120)


@query("h3_baselines", f"{_POOL}{_baselines_sql('pool', KEPT)} SELECT league_id, position, vols_rank, vorp_rank, vols_ppg, vorp_ppg FROM bases")
def h3_baselines(spark, sf_dir):
    p = pool(spark, sf_dir)
    return valuation.baselines(p, TEAMS, p.filter("kept"))


@query("h4_values", f"{_POOL}{_values_sql('pool', KEPT)} SELECT league_id, player_id, season_value, vorp, vols, overall_rank, pos_rank FROM ranked")
def h4_values(spark, sf_dir):
    """Season value, value over replacement, and overall and positional rank (H5)."""
    return valued(spark, sf_dir).select("league_id", "player_id", "season_value", "vorp", "vols", "overall_rank", "pos_rank")


@query("flagship_board", f"""{SEASON_SQL}, pool AS (SELECT season AS league_id, player_id, position, ppg, CAST(17 - player_id % 5 AS DOUBLE) AS e_games, CAST(NULL AS DOUBLE) AS adp FROM seasons WHERE games >= 8),
{_values_sql('pool', 'false')} SELECT league_id, player_id, round(ppg, 6) AS ppg, vorp FROM ranked""")  # fmt: skip
def flagship_board(spark, sf_dir):
    """From weekly lines to a board: score, season totals, baselines, value, rank - a league a season."""
    s = seasons(spark, sf_dir).filter("games >= 8")
    p = s.select(F.col("season").alias("league_id"), "player_id", "position", "ppg", (17 - F.col("player_id") % 5).cast("double").alias("e_games"), F.lit(None).cast("double").alias("adp"))
    out = valuation.ranks(valuation.values(p, valuation.baselines(p, TEAMS)))
    return out.select("league_id", "player_id", F.round("ppg", 6).alias("ppg"), "vorp")


#: EM as steps of a recursion over (group, start, component); tiers are components by mean, dense, and never fall down the ranks.
_TIERS = f"""WITH RECURSIVE {ctes('pool')}, known AS (SELECT league_id, position, player_id, adp AS x, row_number() OVER (PARTITION BY league_id, position ORDER BY adp, player_id) AS n FROM pool WHERE adp IS NOT NULL),
g AS (SELECT * FROM known WHERE n <= 60),
sizes AS (SELECT league_id, position, list(x ORDER BY n) AS xs, count(*) AS c, greatest(var_pop(x), 0) AS spread, least(count(DISTINCT x), CASE position WHEN 'QB' THEN 6 WHEN 'WR' THEN 9 WHEN 'TE' THEN 6 ELSE 8 END) AS k FROM g GROUP BY league_id, position),
begun AS (SELECT league_id, position, s, j, k, spread, xs, (c - 1) * (j + s) / k AS spot FROM sizes, (VALUES (0.5::DOUBLE), (0.25), (0.75)) v(s), LATERAL (SELECT unnest(range(0, k)) AS j)),
em AS (
  SELECT 0 AS step, league_id, position, s, j, xs[CAST(floor(spot) AS BIGINT) + 1] + (spot - floor(spot)) * (coalesce(xs[CAST(floor(spot) AS BIGINT) + 2], xs[-1]) - xs[CAST(floor(spot) AS BIGINT) + 1]) AS m, greatest(spread / (k * k), 1e-6) AS v, 1.0::DOUBLE / k AS w FROM begun
  UNION ALL
  SELECT step + 1, league_id, position, s, j, m, greatest(sq / n - m * m, 0) + 1e-6, n / sum(n) OVER (PARTITION BY league_id, position, s)
  FROM (SELECT step, league_id, position, s, j, sum(p) + 1e-12 AS n, sum(p * x) / (sum(p) + 1e-12) AS m, sum(p * x * x) AS sq
    FROM (SELECT step, league_id, position, s, j, x, e / sum(e) OVER (PARTITION BY league_id, position, s, n) AS p
      FROM (SELECT step, league_id, position, s, j, n, x, exp(l - max(l) OVER (PARTITION BY league_id, position, s, n)) AS e
        FROM (SELECT em.*, g.n, g.x, ln(w) - 0.5 * ln(2 * pi() * v) - (x - m) * (x - m) / (2 * v) AS l FROM em JOIN g ON g.league_id = em.league_id AND g.position = em.position WHERE step < {valuation.STEPS})))
    GROUP BY step, league_id, position, s, j)),
ends AS (SELECT em.*, g.n, g.player_id, ln(w) - 0.5 * ln(2 * pi() * v) - (x - m) * (x - m) / (2 * v) AS l FROM em JOIN g ON g.league_id = em.league_id AND g.position = em.position WHERE step = {valuation.STEPS}),
each_ AS (SELECT league_id, position, s, n, max(l) + ln(sum(exp(l - top))) AS likely, arg_max(j, l) AS j FROM (SELECT *, max(l) OVER (PARTITION BY league_id, position, s, n) AS top FROM ends) GROUP BY league_id, position, s, n),
chosen AS (SELECT league_id, position, s FROM (SELECT league_id, position, s, row_number() OVER (PARTITION BY league_id, position ORDER BY round(sum(likely), 6) DESC, CASE s WHEN 0.5 THEN 0 WHEN 0.25 THEN 1 ELSE 2 END) AS best FROM each_ GROUP BY league_id, position, s) WHERE best = 1),
ordered_ AS (SELECT league_id, position, s, j, row_number() OVER (PARTITION BY league_id, position, s ORDER BY m, j) AS place FROM em WHERE step = {valuation.STEPS}),
placed AS (SELECT league_id, position, e.n, dense_rank() OVER (PARTITION BY league_id, position ORDER BY place) AS tier FROM each_ e JOIN chosen USING (league_id, position, s) JOIN ordered_ USING (league_id, position, s, j)),
tiers AS (SELECT g.league_id, g.player_id, g.position, CAST(max(tier) OVER (PARTITION BY g.league_id, g.position ORDER BY g.n) AS INT) AS tier FROM g JOIN placed p ON p.league_id = g.league_id AND p.position = g.position AND p.n = g.n)
SELECT * FROM tiers UNION ALL SELECT k.league_id, player_id, k.position, t.tier + 1 FROM known k JOIN (SELECT league_id, position, max(tier) AS tier FROM tiers GROUP BY ALL) t ON t.league_id = k.league_id AND t.position = k.position WHERE n > 60"""


@query("h6_consensus_tiers", _TIERS)
def h6_consensus_tiers(spark, sf_dir):
    p = bound(spark, sf_dir, "pool").withColumn("composite_rank", F.col("adp"))
    return valuation.consensus_tiers(p, {"QB": 6, "RB": 8, "WR": 9, "TE": 6})


@query("h7_value_tiers", f"""{_POOL}s AS (SELECT league_id, position, quantile_cont(weekly_sd, 0.5) AS sd FROM pool GROUP BY ALL),
d AS (SELECT p.*, CASE WHEN lag(ppg) OVER w - ppg >= 0.5 * coalesce(sd, 5.0) THEN 1 ELSE 0 END AS fall FROM pool p LEFT JOIN s USING (league_id, position) WINDOW w AS (PARTITION BY p.league_id, p.position ORDER BY ppg DESC, player_id))
SELECT league_id, player_id, CAST(1 + sum(fall) OVER (PARTITION BY league_id, position ORDER BY ppg DESC, player_id) AS BIGINT) AS value_tier FROM d""".replace("weekly_sd, 0.5", "weekly_sd / 20, 0.5"))  # fmt: skip
def h7_value_tiers(spark, sf_dir):
    p = bound(spark, sf_dir, "pool").withColumn("weekly_sd", F.col("weekly_sd") / 20)
    return valuation.value_tiers(p).select("league_id", "player_id", "value_tier")


_GAPS = f"""{_values_sql('pool', KEPT)}, free AS (SELECT *, row_number() OVER (PARTITION BY league_id ORDER BY adp, player_id) AS room_adp, row_number() OVER (PARTITION BY league_id ORDER BY overall_rank) AS our_pick,
  row_number() OVER (PARTITION BY league_id, position ORDER BY adp, player_id) - row_number() OVER (PARTITION BY league_id, position ORDER BY overall_rank) AS pos_gap FROM ranked WHERE NOT ({KEPT}) AND adp IS NOT NULL)"""


@query("h8_room_gaps", f"{_POOL}{_GAPS} SELECT r.league_id, r.player_id, room_adp, our_pick, room_adp - our_pick AS gap, round((room_adp - our_pick) / greatest(coalesce(r.sd_adp, 10.0), 1.0), 3) AS gap_z, pos_gap FROM ranked r LEFT JOIN free f USING (player_id)")
def h8_room_gaps(spark, sf_dir):
    """Room order, our pick, the gap and its deviations, and the gap within the position (H9)."""
    return valuation.room_gaps(valued(spark, sf_dir)).select("league_id", "player_id", "room_adp", "our_pick", "gap", "gap_z", "pos_gap")


def _cdf(z: str) -> str:
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * (abs({z}) / sqrt(2.0::DOUBLE))))"
    poly = f"({t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE)))))"
    erf = f"(1 - {poly} * exp(-(abs({z}) / sqrt(2.0::DOUBLE)) * (abs({z}) / sqrt(2.0::DOUBLE))))"
    return f"(CASE WHEN {z} >= 0 THEN 0.5 * (1 + {erf}) ELSE 0.5 * (1 - {erf}) END)"


def _p_sql(pick: str) -> str:
    return f"CASE WHEN adp IS NULL THEN 1.0::DOUBLE ELSE 1 - {_cdf(f'(({pick} - adp) / greatest(coalesce(sd_adp, 1.0), 1.0))')} END"


@query("h10_p_available", f"{_POOL}x AS (SELECT 1) SELECT player_id, round({_p_sql('(CAST(player_id % 150 AS DOUBLE))')}, 7) AS p FROM pool")
def h10_p_available(spark, sf_dir):
    p = valuation.p_available((F.col("player_id") % 150).cast("double"), F.col("adp"), F.col("sd_adp"))
    return bound(spark, sf_dir, "pool").select("player_id", F.round(p, 7).alias("p"))


@query("h11_expected_best", f"""{_POOL}c AS (SELECT *, {_p_sql('40')} AS p FROM pool), w AS (SELECT *, coalesce(product(1 - p) OVER (PARTITION BY league_id, position ORDER BY ppg DESC, player_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS none FROM c)
SELECT league_id, position, round(sum(ppg * p * none), 5) AS expected_best FROM w GROUP BY ALL""")  # fmt: skip
def h11_expected_best(spark, sf_dir):
    c = bound(spark, sf_dir, "pool").withColumns({"p": valuation.p_available(F.lit(40.0), F.col("adp"), F.col("sd_adp")), "value": F.col("ppg")})
    return valuation.expected_best(c, ["league_id", "position"]).withColumn("expected_best", F.round("expected_best", 5))


_WITH_POOL = f"WITH RECURSIVE {ctes('pool')}, "


@query("h12_leave_one_out", f"{_WITH_POOL}every AS (SELECT league_id, position, player_id, ppg AS v, {_p_sql('40')} AS p FROM pool), {others_sql('every')} SELECT player_id, round(others_best, 5) AS others_best FROM others")
def h12_leave_one_out(spark, sf_dir):
    """Every candidate of the pool; those without a draft position are surely there."""
    return _others_best(bound(spark, sf_dir, "pool"))


def _others_best(candidates: DataFrame) -> DataFrame:
    c = candidates.select("league_id", "position", "player_id", F.col("ppg").alias("value"), valuation.p_available(F.lit(40.0), F.col("adp"), F.col("sd_adp")).alias("p"))
    return valuation.leave_one_out(c, ["league_id", "position"]).select("player_id", F.round("others_best", 5).alias("others_best"))


_PLAN = """leagues AS (SELECT c_custkey AS league_id, CAST(8 + c_custkey % 5 AS BIGINT) AS teams, 16 AS rounds FROM customer),
keepers AS (SELECT league_id, CAST(1 + league_id % 7 AS INT) AS team_slot, CAST(1 + league_id % 16 AS INT) AS cost_round, league_id * 2 AS player_id FROM leagues
  UNION ALL SELECT league_id, 8, CAST(1 + league_id % 3 AS INT), league_id * 2 + 1 FROM leagues),
every AS (SELECT league_id, teams, i AS overall_pick, CAST((i - 1) // teams + 1 AS INT) AS round, CAST(CASE WHEN ((i - 1) // teams) % 2 = 0 THEN (i - 1) % teams + 1 ELSE teams - (i - 1) % teams END AS INT) AS team_slot
  FROM leagues, LATERAL (SELECT unnest(range(1, teams * rounds + 1)) AS i)),
plan AS (SELECT e.league_id, overall_pick, round, e.team_slot, k.player_id AS keeper_player_id, k.player_id IS NOT NULL AS is_keeper,
  CASE WHEN k.player_id IS NULL THEN CAST(count(*) FILTER (k.player_id IS NULL) OVER (PARTITION BY e.league_id ORDER BY overall_pick) AS BIGINT) END AS live_pick_no
  FROM every e LEFT JOIN keepers k ON k.league_id = e.league_id AND k.team_slot = e.team_slot AND k.cost_round = e.round)"""


def leagues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("league_id"), (8 + F.col("c_custkey") % 5).alias("teams"), F.lit(16).alias("rounds"))


def keepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("league_id")
    one = leagues(spark, sf_dir).select("league_id", (1 + i % 7).cast("int").alias("team_slot"), (1 + i % 16).cast("int").alias("cost_round"), (i * 2).alias("player_id"))
    two = leagues(spark, sf_dir).select("league_id", F.lit(8).alias("team_slot"), (1 + i % 3).cast("int").alias("cost_round"), (i * 2 + 1).alias("player_id"))
    return one.unionByName(two)


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draft.schedule(leagues(spark, sf_dir), keepers(spark, sf_dir))


@query("h13_schedule", f"WITH {_PLAN} SELECT * FROM plan")
def h13_schedule(spark, sf_dir):
    return plan(spark, sf_dir)


@query("h13_keeper_faults", f"WITH {_PLAN}, odd AS (SELECT league_id, CASE WHEN league_id % 3 = 0 THEN 99 ELSE team_slot END AS team_slot, 1 AS cost_round, player_id FROM keepers) SELECT *, 'out of range' AS fault FROM odd WHERE team_slot = 99 UNION ALL SELECT *, 'duplicate' FROM odd o WHERE team_slot < 99 AND (SELECT count(*) FROM odd p WHERE p.league_id = o.league_id AND p.team_slot = o.team_slot) > 1")
def h13_keeper_faults(spark, sf_dir):
    return _faults(spark, sf_dir)


def _faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = keepers(spark, sf_dir)
    odd = k.select("league_id", F.when(F.col("league_id") % 3 == 0, 99).otherwise(F.col("team_slot")).alias("team_slot"), F.lit(1).alias("cost_round"), "player_id")
    return draft.keeper_faults(leagues(spark, sf_dir), odd)


@query("h14_turns", f"""WITH {_PLAN} SELECT league_id, round, overall_pick, live_pick_no, lead(overall_pick) OVER w AS next_pick, lead(live_pick_no) OVER w - live_pick_no - 1 AS picks_until_next
FROM plan WHERE team_slot = 3 AND live_pick_no IS NOT NULL WINDOW w AS (PARTITION BY league_id ORDER BY overall_pick)""")  # fmt: skip
def h14_turns(spark, sf_dir):
    return draft.turns(plan(spark, sf_dir), 3)


@query("h14_on_clock", f"WITH {_PLAN} SELECT league_id, overall_pick, round, team_slot, coalesce(CASE WHEN league_id % 3 > 0 THEN league_id % 60 END, 0) AS picks_made FROM plan WHERE live_pick_no = coalesce(CASE WHEN league_id % 3 > 0 THEN league_id % 60 END, 0) + 1")
def h14_on_clock(spark, sf_dir):
    return _clock(spark, sf_dir)


def _clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = leagues(spark, sf_dir).filter("league_id % 3 > 0").select("league_id", (F.col("league_id") % 60).alias("picks_made"))
    return draft.on_clock(plan(spark, sf_dir), made)


_TEN = """ten AS (SELECT league_id, i AS overall_pick, CAST((i - 1) // 10 + 1 AS INT) AS round, CASE WHEN ((i - 1) // 10) % 2 = 0 THEN (i - 1) % 10 + 1 ELSE 10 - (i - 1) % 10 END AS team_slot
  FROM (SELECT DISTINCT league_id FROM pool), LATERAL (SELECT unnest(range(1, 161)) AS i))"""


def _ten(spark, sf_dir):
    """Schedules without keepers for the pool's leagues."""
    return draft.schedule(bound(spark, sf_dir, "pool").select("league_id").distinct().withColumns({"teams": F.lit(10), "rounds": F.lit(16)}))


@query("h15_turn_plan", f"""{_POOL}{_values_sql('pool', KEPT)}, {_TEN}, c AS (SELECT r.league_id, player_id, vorp, overall_pick, {_p_sql('CAST(overall_pick AS DOUBLE)')} AS p FROM ranked r JOIN ten t ON t.league_id = r.league_id AND team_slot = 10)
SELECT league_id, overall_pick, player_id, choice FROM (SELECT *, row_number() OVER (PARTITION BY league_id, overall_pick ORDER BY vorp DESC, player_id) AS choice FROM c WHERE p >= 0.25) WHERE choice <= 5""")  # fmt: skip
def h15_turn_plan(spark, sf_dir):
    mine = draft.turns(_ten(spark, sf_dir), 10)
    return draft.turn_plan(valued(spark, sf_dir), mine).select("league_id", "overall_pick", "player_id", "choice")


@query("h20_spearman", f"""{_POOL}{_values_sql('pool', KEPT)}, x AS (SELECT league_id, rank() OVER (PARTITION BY league_id ORDER BY overall_rank) + (count(*) OVER (PARTITION BY league_id, overall_rank) - 1) / 2 AS a,
  rank() OVER (PARTITION BY league_id ORDER BY adp) + (count(*) OVER (PARTITION BY league_id, adp) - 1) / 2 AS b FROM ranked WHERE adp IS NOT NULL AND overall_rank <= 150) SELECT league_id, count(*) AS n, CASE WHEN count(*) >= 30 THEN round(corr(a, b), 6) END AS spearman FROM x GROUP BY ALL""")  # fmt: skip
def h20_spearman(spark, sf_dir):
    out = valuation.spearman(valued(spark, sf_dir).filter("overall_rank <= 150"), ["league_id"], "overall_rank", "adp")
    return out.withColumn("spearman", F.round("spearman", 6))


_ROUNDS = f"""{_values_sql('pool', KEPT)}, {_TEN}, e AS (SELECT r.league_id, round, overall_pick, player_id, greatest(vorp, 0) AS v, {_p_sql('CAST(overall_pick AS DOUBLE)')} AS p FROM ranked r JOIN ten t USING (league_id)),
w AS (SELECT *, coalesce(product(1 - p) OVER (PARTITION BY league_id, overall_pick ORDER BY v DESC, player_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS none FROM e),
b AS (SELECT league_id, round, overall_pick, sum(v * p * none) AS x FROM w GROUP BY ALL), rounds AS (SELECT league_id, round, avg(x) AS mean, min(x) AS least, max(x) AS greatest FROM b GROUP BY ALL)"""


@query("h24_best_by_round", f"{_POOL}{_ROUNDS} SELECT league_id, round, round(mean, 4) AS mean, round(least, 4) AS least, round(greatest, 4) AS greatest FROM rounds")
def h24_best_by_round(spark, sf_dir):
    out = draft.best_by_round(valued(spark, sf_dir), _ten(spark, sf_dir))
    return out.select("league_id", "round", *[F.round(c, 4).alias(c) for c in ("mean", "least", "greatest")])


@query("h23_keeper_surplus", f"""{_POOL}{_ROUNDS}, s AS (SELECT r.league_id, player_id, round, vorp - mean AS surplus FROM ranked r JOIN rounds USING (league_id) WHERE player_id % 37 = 0)
SELECT league_id, player_id, round, round(surplus, 2) AS surplus, min(round) FILTER (round(surplus, 3) > 0) OVER (PARTITION BY league_id, player_id) AS break_even FROM s""")  # fmt: skip
def h23_keeper_surplus(spark, sf_dir):
    v = valued_once(spark, sf_dir)
    by_round = draft.best_by_round(v, _ten(spark, sf_dir))
    out = draft.keeper_surplus(v.filter("kept").select("league_id", "player_id", "vorp"), by_round)
    return out.select("league_id", "player_id", "round", F.round(F.col("vorp") - F.col("mean"), 2).alias("surplus"), "break_even")


@query("h25_keeper_verdict", f"""{_POOL}{_ROUNDS}, s AS (SELECT r.league_id, player_id, round, round(vorp - mean, 3) AS surplus FROM ranked r JOIN rounds USING (league_id) WHERE player_id % 37 = 0),
sig AS (SELECT coalesce(a.player_id, b.player_id) AS player_id, td_diff, ppg AS last_ppg FROM (SELECT player_id, player_id % 5 AS td_diff FROM pool WHERE player_id % 2 = 0) a FULL JOIN (SELECT player_id, ppg FROM pool WHERE player_id % 3 = 0) b ON a.player_id = b.player_id)
SELECT s.player_id, CASE WHEN surplus > 0 THEN 'KEEP' ELSE 'DRAFT INSTEAD' END AS verdict, td_diff, last_ppg FROM s LEFT JOIN sig USING (player_id) WHERE round = 1 + s.player_id % 16""")  # fmt: skip
def h25_keeper_verdict(spark, sf_dir):
    v = valued_once(spark, sf_dir)
    out = draft.keeper_surplus(v.filter("kept").select("league_id", "player_id", "vorp"), draft.best_by_round(v, _ten(spark, sf_dir)))
    cost = v.filter("kept").select("league_id", "player_id", (1 + F.col("player_id") % 16).cast("int").alias("cost_round"))
    luck = v.filter("player_id % 2 = 0").select("player_id", (F.col("player_id") % 5).alias("td_diff"))
    production = v.filter("player_id % 3 = 0").select("player_id", F.col("ppg").alias("last_ppg"))
    return draft.keeper_verdict(out, cost, luck, production).select("player_id", "verdict", "td_diff", "last_ppg")


@query("h25_keeper_report", f"""{_POOL}{_ROUNDS}, s AS (SELECT r.league_id, player_id, round, round(vorp - mean, 3) AS surplus FROM ranked r JOIN rounds USING (league_id) WHERE player_id % 37 = 0),
evens AS (SELECT player_id, min(round) FILTER (surplus > 0) AS break_even FROM s GROUP BY player_id),
asked AS (SELECT league_id, player_id, CASE WHEN player_id % 2 = 0 THEN concat('PLÁYER-', CAST(player_id AS VARCHAR), ' Jr.') ELSE concat('nobody ', CAST(player_id AS VARCHAR)) END AS name, CAST(1 + player_id % 16 AS INT) AS cost_round FROM pool WHERE player_id % 37 = 0)
SELECT a.league_id, a.name, a.cost_round, a.player_id % 2 = 0 AS found, CASE WHEN a.player_id % 2 = 0 THEN a.player_id END AS player_id, surplus, CASE WHEN a.player_id % 2 = 0 THEN break_even END AS break_even,
  CASE WHEN a.player_id % 2 = 0 THEN CASE WHEN surplus > 0 THEN 'KEEP' ELSE 'DRAFT INSTEAD' END END AS verdict
FROM asked a LEFT JOIN s ON s.player_id = a.player_id AND s.round = a.cost_round AND a.player_id % 2 = 0 LEFT JOIN evens ON evens.player_id = a.player_id""")  # fmt: skip
def h25_keeper_report(spark, sf_dir):
    v = valued_once(spark, sf_dir)
    i = F.col("player_id")
    surplus = draft.keeper_surplus(v.filter("kept").select("league_id", "player_id", "vorp"), draft.best_by_round(v, _ten(spark, sf_dir)))
    asked = v.filter("kept").select("league_id", F.when(i % 2 == 0, F.concat(F.lit("PLÁYER-"), i, F.lit(" Jr."))).otherwise(F.concat(F.lit("nobody "), i)).alias("name"), (1 + i % 16).cast("int").alias("cost_round"))
    return draft.keeper_report(asked, v.select("league_id", "player_id", F.concat(F.lit("player "), i).alias("name")), surplus)
