"""Payloads, signals, the board and the pick log over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.functions.columns import flag, zero
from fieldmark.operators import board, context, draft, signals
from fieldmark.operators.valuation import nearest_decile_cut, room_gaps, spearman
from fieldmark.plans.bindings import bound, ctes, table
from fieldmark.plans.feature_queries import SEASON_SQL, seasons
from fieldmark.plans.valuation_queries import KEPT, _GAPS, _PLAN, _TEN, _cdf, _ten, _values_sql, keepers, leagues, others_sql, valued, valued_once
from fieldmark.sources import payloads, snapshots
from fieldmark.sources.settled import new_path, settle
from fieldmark.streaming import picks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_POOL = f"WITH {ctes('pool')}, "


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


# sources


def _projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    i = F.col("p_partkey")
    spot = F.element_at(F.array(*[F.lit(x) for x in ("QB", "RB", "WR", "OL")]), (i % 4 + 1).cast("int"))
    row = F.struct(
        i.cast("string").alias("player_id"), F.lit("2026").alias("season"), F.when(i % 10 == 0, 3).alias("week"), F.struct(F.col("p_name").alias("first_name"), F.lit("X").alias("last_name"), spot.alias("position"), F.col("p_brand").alias("team")).alias("player"),
        F.create_map(F.lit("rec"), F.col("p_size").cast("double"), F.lit("adp_std"), F.when(i % 3 == 0, 999.0).otherwise(F.col("p_retailprice")), F.lit("pts_std"), F.lit(1.0)).alias("stats"),
    )
    return p.select(F.to_json(row).alias("json"))


@query("a2_projections", """SELECT CAST(p_partkey AS VARCHAR) AS player_id, concat(p_name, ' X') AS name, p_brand AS team, CAST(p_size AS DOUBLE) AS rec, CASE WHEN p_partkey % 3 > 0 AND p_retailprice < 999 THEN p_retailprice END AS adp, true AS has_projection
FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 4 <> 3""")  # fmt: skip
def a2_projections(spark, sf_dir):
    return payloads.projections(_projections(spark, sf_dir)).select("player_id", "name", "team", F.col("stats")["stat_rec"].alias("rec"), F.col("adps")["adp_std"].alias("adp"), "has_projection")


@query("a3_player_master", """SELECT CAST(s_suppkey AS VARCHAR) AS player_id, s_name AS full_name, CASE WHEN s_suppkey % 3 > 0 THEN 'T' END AS team FROM supplier WHERE s_suppkey % 5 > 0 AND (s_suppkey % 3 > 0 OR s_suppkey % 2 = 0)""")
def a3_player_master(spark, sf_dir):
    """A document a nation, each a map of its players."""
    i = F.col("s_suppkey")
    one = F.struct(
        F.col("s_name").alias("full_name"), F.when(i % 5 > 0, "QB").otherwise("OL").alias("position"), F.when(i % 3 > 0, "T").alias("team"), F.when(i % 2 == 0, "Active").otherwise("Retired").alias("status"),
        i.cast("string").alias("espn_id"), F.create_map(F.lit("k"), F.lit("v")).alias("metadata"),
    )
    docs = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(i.cast("string"), one)))).alias("json"))
    return payloads.master(docs).select("player_id", "full_name", "team")


@query("a4_ranking_pages", """SELECT c_nationkey AS page, CAST(c_custkey AS VARCHAR) AS player_id, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS name, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey AS DOUBLE) / 8 END AS average_pick FROM customer""")
def a4_ranking_pages(spark, sf_dir):
    i = F.col("c_custkey")
    parts = F.array(
        F.create_map(F.lit("player_id"), i.cast("string")), F.create_map(F.lit("name"), F.when(i % 4 > 0, F.col("c_name")).otherwise("false")),
        F.create_map(F.lit("average_pick"), F.when(i % 3 > 0, (i / 8).cast("string")).otherwise("-")),
    )
    pages = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("page")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(i.cast("string"), parts))).alias("players"))).alias("json"))
    return payloads.ranking_page(pages).select("page", "player_id", "name", "average_pick")


@query("a5_adp_payloads", """SELECT p_partkey AS player_id, p_name AS name, p_retailprice AS adp, concat('b', p_size) AS format FROM part WHERE p_size % 2 = 0""")
def a5_adp_payloads(spark, sf_dir):
    """A payload a size, half of them for another league size."""
    one = F.struct(F.col("p_partkey").alias("player_id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("adp"))
    meta = F.struct(F.concat(F.lit("b"), F.col("p_size")).alias("type"), F.when(F.col("p_size") % 2 == 0, 10).otherwise(12).alias("teams"))
    docs = table(spark, sf_dir, "part").groupBy("p_size").agg(F.collect_list(one).alias("players")).select(F.to_json(F.struct(meta.alias("meta"), "players")).alias("json"))
    return payloads.adp_payload(docs, 10).select("player_id", "name", "adp", "format")


@query("a6_first_pass", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS n FROM orders) WHERE n = 1")
def a6_first_pass(spark, sf_dir):
    return snapshots.first_pass_wins(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderpriority", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("a7_register", """WITH n AS (SELECT event_id, event_type AS endpoint, sha256(CAST(floor(value) AS INT)::VARCHAR) AS h, ts FROM events), old AS (SELECT DISTINCT endpoint, h FROM n WHERE event_id % 40 = 0),
r AS (SELECT n.*, row_number() OVER (PARTITION BY n.endpoint, n.h ORDER BY ts, event_id) AS k, old.h IS NOT NULL AS seen FROM n LEFT JOIN old ON n.endpoint = old.endpoint AND n.h = old.h)
SELECT event_id, CASE WHEN NOT seen AND k = 1 THEN 'ok' ELSE 'skipped_dupe' END AS status FROM r""")  # fmt: skip
def a7_register(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("s").alias("source"), F.col("event_type").alias("endpoint"), "event_id", F.col("event_id").alias("path"), F.sha2(F.floor("value").cast("int").cast("string"), 256).alias("sha256"), F.col("ts").alias("fetched_at"))
    return snapshots.register(e, e.filter("event_id % 40 = 0").withColumn("status", F.lit("ok"))).select("event_id", "status")


@query("a10_flat", "SELECT p_name, string_agg(CAST(p_size AS VARCHAR), '; ' ORDER BY p_size) AS sizes FROM (SELECT DISTINCT p_name, p_size FROM part) GROUP BY p_name")
def a10_flat(spark, sf_dir):
    return snapshots.flat(table(spark, sf_dir, "part").groupBy("p_name").agg(F.array_sort(F.collect_set("p_size")).alias("sizes")))


@query("a12_diff", """WITH a AS (SELECT p_partkey AS id, p_type, p_retailprice AS adp FROM part WHERE p_partkey % 5 > 0), b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS p_type, p_retailprice + p_partkey % 4 AS adp FROM part WHERE p_partkey % 3 > 0)
SELECT count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS common, count(*) FILTER (b.id IS NULL) AS only_left, count(*) FILTER (a.id IS NULL) AS only_right,
  count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL AND a.p_type IS DISTINCT FROM b.p_type) AS p_type_differs, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL AND a.adp IS DISTINCT FROM b.adp) AS adp_differs, round(max(abs(a.adp - b.adp)), 6) AS max_adp_change FROM a FULL JOIN b ON a.id = b.id""")  # fmt: skip
def a12_diff(spark, sf_dir):
    p, i = table(spark, sf_dir, "part"), F.col("p_partkey")
    a = p.filter(i % 5 > 0).select(i.alias("id"), "p_type", F.col("p_retailprice").alias("adp"))
    b = p.filter(i % 3 > 0).select(i.alias("id"), F.when(i % 7 != 0, F.col("p_type")).alias("p_type"), (F.col("p_retailprice") + i % 4).alias("adp"))
    return snapshots.diff(a, b, "id", ["p_type", "adp"]).withColumn("max_adp_change", F.round("max_adp_change", 6))


@query("a1_read_seasons", f"WITH {ctes('weekly')} SELECT player_id, season, week, team, targets FROM weekly WHERE season IN (1995, 1996)")
def a1_read_seasons(spark, sf_dir):
    """Weekly lines of two seasons, written as files and read with their schema; a third season in the files would be an error."""
    path, names = new_path(spark, "weekly"), ["player_id", "season", "week", "team", "targets"]
    rows = bound(spark, sf_dir, "weekly").filter("season in (1995, 1996)").select(*names)
    rows.write.parquet(path)
    return snapshots.read_seasons(spark, path, rows.schema, [1995, 1996])


@query("a9_replaced_partitions", """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS season, CASE WHEN year(o_orderdate) IN (1994, 1995) THEN o_totalprice * 2 ELSE o_totalprice END AS price, CASE WHEN year(o_orderdate) IN (1994, 1995) THEN o_orderstatus END AS status,
  CASE WHEN year(o_orderdate) IN (1994, 1995) THEN 'second' ELSE 'first' END AS snapshot_id FROM orders WHERE year(o_orderdate) NOT IN (1994, 1995) OR o_orderkey % 3 = 0""")  # fmt: skip
def a9_replaced_partitions(spark, sf_dir):
    """A table by season of which a second snapshot replaces two seasons, with fewer rows and a column more."""
    path = new_path(spark, "orders")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("season"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    snapshots.replace_partition(o.drop("status"), path, ["season"], "first")
    snapshots.replace_partition(o.filter("season in (1994, 1995) and o_orderkey % 3 = 0").withColumn("price", F.col("price") * 2), path, ["season"], "second")
    return snapshots.read_table(spark, path).select("o_orderkey", F.col("season").cast("int").alias("season"), "price", "status", "snapshot_id")


@query("a11_exported_board", f"WITH {ctes('pool')}, {_values_sql('pool', KEPT)} SELECT CAST(overall_rank AS VARCHAR) AS overall_rank, CAST(player_id AS VARCHAR) AS player_id, position, concat_ws('|', CASE WHEN player_id % 2 = 0 THEN 'rookie' END, CASE WHEN player_id % 3 = 0 THEN 'value' END) AS flags FROM ranked WHERE league_id = 0 AND position = 'WR' AND pos_rank <= 50")
def a11_exported_board(spark, sf_dir):
    """The first fifty receivers of a league's board as CSV, read back as text; that many is what is exported."""
    path, i = new_path(spark, "board"), F.col("player_id")
    v = valued(spark, sf_dir).filter("league_id = 0").select("overall_rank", "player_id", "position", F.array_compact(F.array(F.when(i % 2 == 0, "rookie"), F.when(i % 3 == 0, "value"))).alias("flags"))
    snapshots.export_board(v, path, 50, "WR")
    return spark.read.option("header", True).option("nullValue", None).csv(path).withColumn("flags", F.coalesce("flags", F.lit("")))


# signals


#: What ids stand in for, as SQL of ``i``; shares and changes are exact in binary, and nulls reach every rule.
_FACTS = {
    "target_share": "CASE WHEN i % 29 = 7 THEN NULL ELSE (i % 7) / 16.0 END", "prev_target_share": "CASE WHEN i % 10 = 3 THEN NULL ELSE (i % 7) / 16.0 - (i % 11 - 5) / 64.0 END", "carry_share": "CASE WHEN i % 6 = 1 THEN NULL ELSE (i % 5) / 4.0 END",
    "last_ppg": "CASE WHEN i % 12 = 5 THEN NULL ELSE (i % 20) / 2.0 END", "prev_ppg": "CASE WHEN i % 14 = 3 THEN NULL ELSE (i % 20) / 2.0 - (i % 9 - 4) END", "td_diff": "i % 13 - 6.0", "ppg_diff": "CASE WHEN i % 8 = 2 THEN NULL ELSE (i % 9 - 4) / 2.0 END",
    "depth_rank": "CASE WHEN i % 4 = 3 THEN NULL ELSE i % 3 + 1 END", "depth_change": "CASE WHEN i % 8 = 6 THEN NULL ELSE i % 3 - 1 END", "age": "CASE WHEN i % 25 = 4 THEN NULL ELSE i % 15 + 21.0 END", "age_factor": "CASE i % 15 WHEN 0 THEN 0.875 WHEN 1 THEN 1.03125 ELSE 1.0 END",
    "is_rookie": "i % 13 = 0", "draft_round": "CASE WHEN i % 39 = 13 THEN NULL ELSE i % 7 + 1 END", "draft_pick": "CASE WHEN i % 26 = 0 THEN NULL ELSE i % 250 + 1 END", "draft_team": "CASE WHEN i % 65 = 0 THEN NULL ELSE team END", "years_exp": "CASE WHEN i % 19 = 6 THEN NULL ELSE i % 5 END",
    "line_delta": "CASE WHEN i % 10 = 9 THEN NULL ELSE i % 5 - 2 END", "injury_prone": "i % 6 = 0", "structural_return": "i % 17 = 0", "past_cliff": "i % 15 + 21 >= 31", "known_missed": "CASE WHEN i % 20 = 1 THEN NULL ELSE i % 4 END", "new_caller": "i % 8 = 0",
    "play_caller": "CASE WHEN i % 16 = 0 THEN 'A Caller' END", "qb_status": "CASE i % 9 WHEN 0 THEN 'competition' WHEN 1 THEN 'injury_return' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'settled' END", "qb1": "CASE WHEN i % 18 = 0 THEN 'A Passer' END",
    "status": "CASE i % 10 WHEN 0 THEN 'IR' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'ACT' ELSE 'Active' END", "missed_3y": "i % 12", "eligible_3y": "CASE WHEN i % 24 = 5 THEN 0 WHEN i % 24 = 7 THEN NULL ELSE 51 END", "new_coach": "i % 16 = 0",
    "coach": "CASE WHEN i % 32 = 0 THEN 'A Coach' END", "ecr_sd": "i % 11 + 0.5", "vendor_ppg": "CASE WHEN i % 21 = 2 THEN NULL ELSE (i % 40) / 2.0 END", "inhouse_ppg": "CASE WHEN i % 22 = 4 THEN NULL ELSE (i % 40) / 2.0 + (i % 7 - 3) / 2.0 END", "contract_year": "i % 50 = 1", "just_paid": "i % 50 = 2",
}


def _signalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked players with facts that their ids stand in for."""
    v = settle(room_gaps(valued(spark, sf_dir)).withColumn("i", F.col("player_id")).withColumn("disagreement", (F.col("i") % 101).cast("double") / 10 - 5), "gaps")
    v = v.join(F.broadcast(nearest_decile_cut(v).withColumnRenamed("cut", "disagreement_cut")), "league_id")  # a row a league
    words = {k for k in _FACTS if k in ("is_rookie", "draft_team", "injury_prone", "structural_return", "past_cliff", "new_caller", "play_caller", "qb_status", "qb1", "status", "new_coach", "coach", "contract_year", "just_paid")}
    v = v.withColumns({k: F.expr(e) if k in words else F.expr(e).cast("double") for k, e in _FACTS.items()})
    return v.withColumns({
        "yoy_target_share": F.col("target_share") - F.col("prev_target_share"), "yoy_ppg": F.col("last_ppg") - F.col("prev_ppg"), "vacated_gain": F.lit(0.0), "inhouse_edge": F.col("inhouse_ppg") - F.col("vendor_ppg"), "context": F.lit(1.0),
        "qb_unsettled": flag((F.col("qb_status") != "") & (F.col("qb_status") != "settled")), "established": F.col("adp") <= 50, "body_part": F.lit(None).cast("string"), "line_note": F.lit(None).cast("string"),
        "depth_as_of": F.lit(None).cast("date"), "causes": F.array().cast("array<string>"),
    }).drop("i")


_S = f"""{_POOL}{_GAPS}, s AS (SELECT r.*, room_adp, our_pick, room_adp - our_pick AS gap, round((room_adp - our_pick) / greatest(coalesce(r.sd_adp, 10.0), 1.0), 3) AS gap_z, pos_gap, r.player_id AS i FROM ranked r LEFT JOIN free f USING (player_id)),
x AS (SELECT *, (i % 101) / 10.0 - 5 AS disagreement, {", ".join(f"({e}) AS {k}" for k, e in _FACTS.items())} FROM s),
d AS (SELECT *, qb_status NOT IN ('', 'settled') AS qb_unsettled, row_number() OVER (PARTITION BY league_id ORDER BY (i % 101), i) AS k, count(*) OVER (PARTITION BY league_id) AS n FROM x),
cuts AS (SELECT league_id, CASE WHEN max(n) > 50 THEN max(disagreement) FILTER (k = floor(0.9 * (n - 1) + 0.5) + 1) ELSE 1.0 END AS cut FROM d GROUP BY league_id),
team AS (SELECT *, concat_ws(', ', CASE WHEN new_caller THEN 'new play-caller' END, CASE WHEN qb_unsettled THEN 'unsettled QB room' END, CASE WHEN line_delta <= -1 THEN 'offensive line downgrade' END) AS bad FROM d JOIN cuts USING (league_id)),
c AS (SELECT *, list_filter([CASE WHEN target_share - prev_target_share >= 0.03 THEN 'opportunity_gain' END, CASE WHEN td_diff <= -3 THEN 'negative_td_luck' END, CASE WHEN depth_change < 0 THEN 'depth_chart_rise' END, CASE WHEN last_ppg - prev_ppg >= 2 THEN 'ppg_trend_up' END,
    CASE WHEN target_share >= 0.25 OR carry_share >= 0.55 THEN 'elite_opportunity' END, CASE WHEN age <= 24 AND last_ppg > 0 AND position IN ('RB', 'WR', 'TE') THEN 'young_with_role' END,
    CASE WHEN ppg_diff <= -1 THEN 'underperformed_expected_points' END, CASE WHEN inhouse_ppg - vendor_ppg >= 1 THEN 'our_model_sees_more_than_the_vendor' END,
    CASE WHEN is_rookie AND draft_round <= 2 AND depth_rank <= 2 THEN 'high_draft_capital_with_a_role' END, CASE WHEN line_delta >= 1 THEN 'team_context:offensive line upgrade' END], lambda x: x IS NOT NULL) AS support,
  list_filter([CASE WHEN td_diff >= 3 THEN 'positive_td_luck' END, CASE WHEN injury_prone THEN 'injury_prone' END, CASE WHEN structural_return THEN 'structural_injury_return' END, CASE WHEN past_cliff THEN 'age_cliff' END,
    CASE WHEN disagreement >= cut THEN 'expert_disagreement' END, CASE WHEN known_missed >= 2 THEN 'announced_absence' END, CASE WHEN bad <> '' THEN 'team_context:' || bad END], lambda x: x IS NOT NULL) AS risk FROM team),
z AS (SELECT *, len(support) AS n_support, len(risk) AS n_risk FROM c)"""


@query("h17_signals", f"{_S} SELECT player_id, array_to_string(support, '|') AS support, array_to_string(risk, '|') AS risk FROM z")
def h17_signals(spark, sf_dir):
    return _signalled(spark, sf_dir).select("player_id", F.array_join(signals.support(), "|").alias("support"), F.array_join(signals.risk(), "|").alias("risk"))


@query("h18_flags", f"""{_S}, o AS (SELECT *, coalesce(adp <= 220, false) AND position NOT IN ('K', 'DEF') AS o FROM z) SELECT player_id, concat_ws('|', CASE WHEN i % 6 = 0 THEN 'injury_prone' END, CASE WHEN i % 17 = 0 THEN 'structural_injury_return' END,
  CASE WHEN is_rookie THEN 'rookie' END, CASE WHEN new_caller THEN 'new_play_caller' END, CASE WHEN qb_unsettled THEN 'qb_uncertain_team' END,
  CASE WHEN o AND gap_z >= 1 AND gap >= 6 AND n_support >= 2 AND adp <= 50 THEN 'value' END, CASE WHEN o AND gap_z >= 1 AND gap >= 6 AND n_support >= 2 AND NOT adp <= 50 THEN 'sleeper' END,
  CASE WHEN o AND gap_z <= -1 AND gap <= -6 AND n_risk >= 2 AND pos_gap > -5 THEN 'positional_reach' END, CASE WHEN o AND gap_z <= -1 AND gap <= -6 AND n_risk >= 2 AND NOT pos_gap > -5 THEN 'bust' END) AS flags FROM o""")  # fmt: skip
def h18_flags(spark, sf_dir):
    s = _signalled(spark, sf_dir)
    return s.select("player_id", F.array_join(signals.flags(signals.support(), signals.risk()), "|").alias("flags"))


def _why_sql() -> str:
    """Reasons from the rules as they are stated: (id, priority, kind, years, trigger, polarity, numbers, labels)."""
    share = "position = 'RB' AND coalesce(carry_share > 0, false)"
    sign = lambda x: f"CASE WHEN {x} > 0 THEN 1 ELSE -1 END"
    stated = [
        ("projection", 5, "value", "now", "ppg IS NOT NULL", "0", {"ppg": "ppg", "vorp": "vorp", "e_games": "e_games"}, {}),
        ("rookie_draft_capital", 8, "rookie", "now", "is_rookie", "CASE WHEN draft_round IS NULL THEN -1 WHEN draft_round = 1 THEN 1 ELSE 0 END", {"round": "draft_round", "pick": "CASE WHEN draft_round IS NOT NULL THEN draft_pick END"}, {"team": "CASE WHEN draft_round IS NOT NULL THEN draft_team END"}),
        ("target_share_trend", 10, "opportunity", "last two", "position IN ('WR', 'TE', 'RB') AND abs(target_share - prev_target_share) >= 0.03", sign("target_share - prev_target_share"), {"prev": "prev_target_share", "cur": "target_share", "delta": "round(target_share - prev_target_share, 3)"}, {}),
        ("ppg_trend", 12, "opportunity", "last two", "prev_ppg <> 0 AND abs(last_ppg - prev_ppg) >= 1.5", sign("last_ppg - prev_ppg"), {"prev": "prev_ppg", "cur": "last_ppg"}, {}),
        ("carries_share", 14, "opportunity", "last", "position = 'RB' AND carry_share >= 0.55", "1", {"carry_share": "carry_share"}, {}),
        ("depth_chart", 16, "opportunity", "now", "depth_rank IS NOT NULL", "CASE depth_rank WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -1 END", {"depth_rank": "depth_rank", "change_30d": "depth_change"}, {}),
        ("usage_level", 18, "opportunity", "last", f"(({share}) OR target_share > 0) AND NOT (position = 'RB' AND coalesce(carry_share >= 0.55, false))", f"CASE WHEN CASE WHEN {share} THEN carry_share >= 0.5 ELSE target_share >= 0.2 END THEN 1 ELSE 0 END", {"carry_share": f"CASE WHEN {share} THEN carry_share END", "target_share": f"CASE WHEN NOT ({share}) THEN target_share END"}, {}),
        ("td_regression", 20, "regression", "last", "abs(td_diff) >= 3", f"-({sign('td_diff')})", {"td_diff": "td_diff"}, {}),
        ("ppg_luck", 22, "regression", "last", "abs(ppg_diff) >= 1", f"-({sign('ppg_diff')})", {"ppg_diff": "ppg_diff"}, {}),
        ("current_injury", 28, "durability", "now", "status NOT IN ('', 'Active', 'ACT')", "-1", {"known_missed_weeks": "coalesce(known_missed, 0)"}, {"status": "status"}),
        ("games_missed", 30, "durability", "last three", "missed_3y >= 3 AND eligible_3y > 0", "-1", {"missed": "missed_3y", "eligible": "eligible_3y", "e_games": "e_games"}, {}),
        ("new_play_caller", 40, "context", "now", "new_caller", "0", {}, {"play_caller": "coalesce(play_caller, 'new play-caller')"}),
        ("qb_situation", 41, "context", "now", "qb_status NOT IN ('', 'settled')", "-1", {}, {"qb_status": "qb_status", "projected_qb1": "coalesce(qb1, 'TBD')"}),
        ("ol_delta", 42, "context", "now", "line_delta <> 0", sign("line_delta"), {"ol_delta": "line_delta"}, {}),
        ("new_head_coach", 43, "context", "now", "new_coach", "0", {}, {"hc": "coach"}),
        ("adp_gap", 50, "market", "now", "abs(gap) >= 6 AND abs(gap_z) >= 1", sign("gap"), {"gap": "gap", "gap_z": "gap_z"}, {}),
        ("expert_disagreement", 52, "market", "now", "disagreement >= 1", "-1", {"ecr_std": "ecr_sd", "residual": "disagreement"}, {}),
        ("projection_sources", 54, "value", "now", "abs(inhouse_ppg - vendor_ppg) >= 1", sign("inhouse_ppg - vendor_ppg"), {"vendor": "vendor_ppg", "inhouse": "inhouse_ppg", "blend": "ppg"}, {}),
        ("market_position", 55, "market", "now", "room_adp IS NOT NULL AND our_pick IS NOT NULL", "0", {"room_adp": "room_adp", "our_pick": "our_pick"}, {}),
        ("age", 60, "bio", "now", "age IS NOT NULL AND age_factor <> 1", "CASE WHEN age_factor < 1 THEN -1 ELSE 1 END", {"age": "age", "factor": "age_factor"}, {}),
        ("experience", 62, "bio", "now", "NOT is_rookie AND years_exp IS NOT NULL", "CASE WHEN years_exp = 1 THEN 1 ELSE 0 END", {"years_exp": "years_exp", "age": "age"}, {}),
        ("contract", 70, "bio", "now", "contract_year OR just_paid", "0", {}, {}),
    ]
    inputs = lambda numbers, labels: "concat_ws(';', NULL" + "".join(f", '{k}=' || printf('%.6f', CAST({v} AS DOUBLE) + 0.0)" for k, v in numbers.items()) + "".join(f", '{k}=' || {v}" for k, v in labels.items()) + ")"
    each = " UNION ALL ".join(f"SELECT league_id, player_id, {n} AS priority, '{r}' AS rule_id, '{kind}' AS kind, '{years}' AS years, {pol} AS polarity, {inputs(num, lab)} AS inputs FROM z WHERE {when}" for r, n, kind, years, when, pol, num, lab in stated)
    return f"{_S}, every AS ({each}), why AS (SELECT *, row_number() OVER (PARTITION BY league_id, player_id ORDER BY priority, rule_id) - 1 AS place FROM every)"


@query("h19_reasons", f"{_why_sql()} SELECT league_id, player_id, CAST(place AS INT) AS place, rule_id, kind, years, CAST(polarity AS INT) AS polarity, inputs FROM why WHERE place < 6")
def h19_reasons(spark, sf_dir):
    """Reasons in order with what they rest on; their wording is checked by tests."""
    r = signals.reason_rows(_signalled(spark, sf_dir))
    numbers = F.transform(F.map_entries("numbers"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.6f", e["value"])))
    labels = F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return r.select("league_id", "player_id", "place", "rule_id", "kind", "years", "polarity", F.array_join(F.concat(numbers, labels), ";").alias("inputs"))


@query("h21_run_gates", f"""{_why_sql()}, rho AS (SELECT league_id, rank() OVER (PARTITION BY league_id ORDER BY overall_rank) + (count(*) OVER (PARTITION BY league_id, overall_rank) - 1) / 2 AS a,
  rank() OVER (PARTITION BY league_id ORDER BY adp) + (count(*) OVER (PARTITION BY league_id, adp) - 1) / 2 AS b FROM ranked WHERE adp IS NOT NULL AND overall_rank IS NOT NULL),
sp AS (SELECT league_id, CASE WHEN count(*) >= 30 THEN corr(a, b) END AS rho FROM rho GROUP BY ALL), bullets AS (SELECT league_id, player_id, count(*) AS bullets FROM why WHERE place < 6 GROUP BY ALL),
t AS (SELECT league_id, count(*) FILTER (coalesce(bullets, 0) < 5) AS thin FROM ranked LEFT JOIN bullets USING (league_id, player_id) WHERE overall_rank <= 100 GROUP BY league_id)
SELECT league_id, coalesce(rho >= 0.8, false) AS agrees, coalesce(thin, 0) AS thin FROM sp FULL JOIN t USING (league_id)""")  # fmt: skip
def h21_run_gates(spark, sf_dir):
    """The gates over a board and its own reasons; five and not three are asked for, as nobody here has fewer than three."""
    v = settle(_signalled(spark, sf_dir), "signalled")
    return context.run_gates(spearman(v, ["league_id"], "overall_rank", "adp"), v, signals.reason_rows(v), least=5)


@query("h16_established", f"""{SEASON_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY ppg DESC, player_id) AS k FROM seasons WHERE season = 2000) SELECT player_id, coalesce(k <= 2 * CASE position WHEN 'QB' THEN 1 WHEN 'WR' THEN 3 WHEN 'RB' THEN 2 WHEN 'TE' THEN 1 END, false) AS established FROM r WHERE games >= 8""")
def h16_established(spark, sf_dir):
    s = seasons(spark, sf_dir)
    r = signals.prior_ranks(s, 2000).join(s.filter("season = 2000").select("player_id", "position"), "player_id")
    return r.select("player_id", signals.established(F.lit(None).cast("double"), F.col("prior_rank"), F.col("position"), 2, {"QB": 1, "WR": 3, "RB": 2, "TE": 1}).alias("established"))


# board

MY_SLOT = 10
#: Picks made in a league: none, our turn, between turns, our last turn, after it, and late between turns.
_MADE = "CASE league_id % 6 WHEN 0 THEN 37 WHEN 1 THEN 9 WHEN 2 THEN 0 WHEN 3 THEN 150 WHEN 4 THEN 118 ELSE 155 END"


def _kept(v: DataFrame) -> DataFrame:
    return v.filter(KEPT).select("league_id", "player_id", (1 + F.col("player_id") % 7).cast("int").alias("team_slot"))


def _picks(v: DataFrame, schedule: DataFrame) -> DataFrame:
    """The room takes players in the order of their draft position; every tenth pick is made by the first team instead."""
    n = F.row_number().over(Window.partitionBy("league_id").orderBy(F.asc_nulls_last("adp"), "player_id"))
    taken = v.filter(f"NOT ({KEPT})").withColumn("overall_pick", n).filter(F.col("overall_pick") <= F.expr(_MADE))
    taken = taken.join(schedule.select("league_id", F.col("overall_pick").cast("int").alias("overall_pick"), F.col("team_slot").alias("scheduled")), ["league_id", "overall_pick"])
    return taken.select("league_id", "player_id", F.when(F.col("overall_pick") % 10 == 0, 1).otherwise(F.col("scheduled")).cast("int").alias("team_slot"), "overall_pick", "position", "team")


_BOARD = f"WITH RECURSIVE {ctes('pool')}, {_values_sql('pool', KEPT)}, {_TEN}, {f"""order_ AS (SELECT *, row_number() OVER (PARTITION BY league_id ORDER BY adp NULLS LAST, player_id) AS k FROM ranked WHERE NOT ({KEPT})),
picks AS (SELECT o.league_id, player_id, position, team, k AS overall_pick, t.team_slot AS scheduled, CASE WHEN k % 10 = 0 THEN 1 ELSE t.team_slot END AS team_slot
  FROM order_ o JOIN ten t ON t.league_id = o.league_id AND t.overall_pick = k WHERE k <= {_MADE.replace('league_id', 'o.league_id')}),
made AS (SELECT l.league_id, count(p.player_id) AS picks_made FROM (SELECT DISTINCT league_id FROM pool) l LEFT JOIN picks p USING (league_id) GROUP BY l.league_id),
keepers_ AS (SELECT league_id, player_id, position, team, 1 + player_id % 7 AS team_slot FROM ranked WHERE {KEPT}),
held AS (SELECT league_id, team_slot, player_id, position, team FROM picks UNION ALL SELECT league_id, team_slot, player_id, position, team FROM keepers_)"""}"


@query("j1_board", f"""{_BOARD} SELECT r.league_id, r.player_id, vorp AS value, CAST(coalesce(p.team_slot, k.team_slot) AS INT) AS owner, coalesce(p.team_slot, k.team_slot) IS NOT NULL AS drafted,
  coalesce(coalesce(p.team_slot, k.team_slot) = {MY_SLOT}, false) AS is_mine, concat_ws(',', CASE WHEN k.team_slot IS NOT NULL THEN 'kept' END, CASE WHEN p.team_slot IS NOT NULL THEN 'drafted' END, CASE WHEN coalesce(p.team_slot, k.team_slot) = {MY_SLOT} THEN 'mine' END) AS tags
FROM ranked r LEFT JOIN picks p USING (player_id) LEFT JOIN keepers_ k USING (player_id)""")  # fmt: skip
def j1_board(spark, sf_dir):
    v = valued_once(spark, sf_dir)
    return board.rows(v, _picks(v, _ten(spark, sf_dir)), _kept(v), MY_SLOT).select("league_id", "player_id", "value", "owner", "drafted", "is_mine", F.array_join("tags", ",").alias("tags"))


def _live(spark, sf_dir) -> dict[str, DataFrame]:
    v = valued_once(spark, sf_dir)
    schedule = settle(_ten(spark, sf_dir), "schedule")
    taken = settle(_picks(v, schedule), "picks")
    made = v.select("league_id").distinct().join(taken.groupBy("league_id").agg(F.count("*").alias("picks_made")), "league_id", "left").select("league_id", zero("picks_made").alias("picks_made"))
    return board.live_tables(v, schedule, _kept(v), taken, settle(made, "made"), MY_SLOT)


_N = ", ".join(f"count(*) FILTER (position = '{p}') AS {p}" for p in ("QB", "WR", "RB", "TE", "K", "DEF"))
_LIVE = f"""{_BOARD},
teams AS (SELECT DISTINCT league_id, team_slot FROM ten), counts AS (SELECT t.league_id, t.team_slot, {_N} FROM teams t LEFT JOIN held h ON h.league_id = t.league_id AND h.team_slot = t.team_slot GROUP BY ALL),
rosters AS (SELECT league_id, team_slot, greatest(1 - QB, 0) AS open_QB, greatest(3 - WR, 0) AS open_WR, greatest(2 - RB, 0) AS open_RB, greatest(1 - TE, 0) AS open_TE, greatest(1 - K, 0) AS open_K, greatest(1 - DEF, 0) AS open_DEF,
  greatest(1 - (greatest(WR - 3, 0) + greatest(RB - 2, 0) + greatest(TE - 1, 0)), 0) AS open_FLEX, greatest(QB - 1, 0) AS bench_QB, greatest(WR - 3, 0) AS bench_WR, greatest(RB - 2, 0) AS bench_RB, greatest(TE - 1, 0) AS bench_TE,
  greatest(K - 1, 0) AS bench_K, greatest(DEF - 1, 0) AS bench_DEF FROM counts),
weights AS (SELECT league_id, position, CASE WHEN open > 0 OR (position IN ('RB', 'WR', 'TE') AND open_FLEX > 0) THEN 1.0 WHEN position IN ('K', 'DEF') THEN 0.03 WHEN position = 'QB' THEN 0.15
    ELSE round(greatest(0.10, 0.35 * pow(0.55, greatest(bench - 1, 0))), 3) END::DOUBLE AS slot_weight
  FROM (SELECT league_id, open_FLEX, unnest(['QB', 'WR', 'RB', 'TE', 'K', 'DEF']) AS position, unnest([open_QB, open_WR, open_RB, open_TE, open_K, open_DEF]) AS open, unnest([bench_QB, bench_WR, bench_RB, bench_TE, bench_K, bench_DEF]) AS bench
    FROM rosters WHERE team_slot = {MY_SLOT})),
targets AS (SELECT t.league_id, max(picks_made) AS picks_made, coalesce(min(overall_pick) FILTER (team_slot = {MY_SLOT} AND overall_pick > picks_made + 1), min(overall_pick) FILTER (team_slot = {MY_SLOT} AND overall_pick > picks_made)) AS target
  FROM ten t JOIN made USING (league_id) GROUP BY ALL),
h AS (SELECT league_id, picks_made, target - 1 AS horizon, (target - 1) // 10 + 1 AS horizon_round FROM targets),
free AS (SELECT r.*, picks_made, horizon, horizon_round, CASE WHEN adp IS NOT NULL THEN picks_made + row_number() OVER (PARTITION BY r.league_id ORDER BY adp NULLS LAST, r.player_id) END AS live_adp
  FROM ranked r JOIN h USING (league_id) WHERE r.player_id NOT IN (SELECT player_id FROM held)),
chances AS (SELECT *, CASE WHEN horizon IS NULL OR live_adp IS NULL THEN NULL WHEN horizon <= picks_made THEN 1.0::DOUBLE ELSE 1 - {_cdf("((horizon - live_adp) / greatest(coalesce(nullif(sd_adp, 0), 10.0), 1.0))")} END AS chance FROM free),
candidates AS (SELECT league_id, position, player_id, greatest(vorp, 0) AS v, CASE WHEN horizon IS NULL THEN 0 WHEN live_adp IS NULL THEN 1 ELSE chance END AS p FROM chances WHERE position NOT IN ('K', 'DEF')),
{others_sql('candidates')},
board AS (SELECT c.league_id, c.player_id, c.position, live_adp, chance AS p, adp, vorp, horizon_round, w.slot_weight, CASE WHEN horizon > picks_made THEN others_best WHEN horizon IS NOT NULL THEN 0.0 END AS others_best,
  w.slot_weight * (greatest(vorp, 0) - CASE WHEN horizon > picks_made THEN others_best WHEN horizon IS NOT NULL THEN 0.0 END) AS vona
  FROM chances c LEFT JOIN others o ON o.league_id = c.league_id AND o.player_id = c.player_id LEFT JOIN weights w ON w.league_id = c.league_id AND w.position = c.position AND c.position NOT IN ('K', 'DEF'))"""


@query("j2_live_room", f"{_LIVE} SELECT league_id, player_id, live_adp FROM board")
def j2_live_room(spark, sf_dir):
    return _live(spark, sf_dir)["board"].select("league_id", "player_id", "live_adp")


@query("j3_live_chance", f"{_LIVE} SELECT league_id, player_id, round(p, 6) AS p FROM board")
def j3_live_chance(spark, sf_dir):
    return _live(spark, sf_dir)["board"].select("league_id", "player_id", F.round("p", 6).alias("p"))


@query("j4_roster", f"{_LIVE} SELECT * FROM rosters")
def j4_roster(spark, sf_dir):
    """Open places and bench of every team, keepers among its players; teams without any have a row."""
    return _live(spark, sf_dir)["rosters"]


@query("j4_bye_stacks", f"{_BOARD}, b AS (SELECT league_id, team_slot, CAST(substr(team, 2) AS INT) % 3 AS bye, player_id FROM held) SELECT league_id, CAST(team_slot AS INT) AS team_slot, bye, count(*) AS n, string_agg(player_id, ',' ORDER BY player_id) AS players FROM b GROUP BY ALL HAVING count(*) >= 3")
def j4_bye_stacks(spark, sf_dir):
    v = valued_once(spark, sf_dir)
    byes = v.select("team").distinct().withColumn("bye", F.expr("CAST(substr(team, 2) AS INT) % 3"))
    held = _kept(v).unionByName(_picks(v, _ten(spark, sf_dir)).select("league_id", "player_id", "team_slot")).join(v.select("league_id", "player_id", "team"), ["league_id", "player_id"])
    return board.bye_stacks(held, byes).withColumn("players", F.array_join("players", ","))


@query("j5_slot_weight", f"{_POOL}w AS (SELECT player_id, position, player_id % 3 AS o, player_id % 2 AS f, player_id % 5 AS d FROM pool) SELECT player_id, CASE WHEN o > 0 OR (position IN ('RB', 'WR', 'TE') AND f > 0) THEN 1.0 WHEN position IN ('K', 'DEF') THEN 0.03 WHEN position = 'QB' THEN 0.15 WHEN d <= 1 THEN 0.35 ELSE round(greatest(0.10, 0.35 * pow(0.55, d - 1)), 3) END::DOUBLE AS weight FROM w")
def j5_slot_weight(spark, sf_dir):
    """Every branch, an empty bench among them."""
    i = F.col("player_id")
    return valued(spark, sf_dir).select("player_id", board.slot_weight(F.col("position"), i % 3, i % 2, i % 5).cast("double").alias("weight"))


@query("j5_live_vona", f"{_LIVE} SELECT league_id, player_id, slot_weight, round(vona, 4) AS vona FROM board")
def j5_live_vona(spark, sf_dir):
    return _live(spark, sf_dir)["board"].select("league_id", "player_id", "slot_weight", F.round("vona", 4).alias("vona"))


@query("j6_panel", f"""{_LIVE}, n AS (SELECT *, row_number() OVER (PARTITION BY league_id, position ORDER BY CASE WHEN position IN ('K', 'DEF') THEN coalesce(adp, 1e9) ELSE -vorp END, player_id) AS place FROM board
  WHERE horizon_round IS NOT NULL AND (position NOT IN ('K', 'DEF') OR horizon_round >= 12))
SELECT league_id, position, player_id, place, round(p, 5) AS p, round(vona, 4) AS vona FROM n WHERE place <= 3""")  # fmt: skip
def j6_panel(spark, sf_dir):
    return _live(spark, sf_dir)["panel"].select("league_id", "position", "player_id", "place", F.round("p", 5).alias("p"), F.round("vona", 4).alias("vona"))


def _kept_plan(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Schedules with the pool's keepers in holes, a team's in rounds of their own, and the picks made."""
    v = valued_once(spark, sf_dir)
    leagues = v.select("league_id").distinct().withColumns({"teams": F.lit(10), "rounds": F.lit(16)})
    nth = F.row_number().over(Window.partitionBy("league_id", "team_slot").orderBy("player_id")).cast("int")
    schedule = draft.schedule(leagues, _kept(v).withColumn("cost_round", nth))
    return schedule, _picks(v, _ten(spark, sf_dir))


_PLACED = f"""{_BOARD}, holes AS (SELECT *, row_number() OVER (PARTITION BY league_id, team_slot ORDER BY player_id) AS cost_round FROM keepers_),
plan AS (SELECT t.*, h.player_id AS kept, CASE WHEN h.player_id IS NULL THEN count(*) FILTER (h.player_id IS NULL) OVER (PARTITION BY t.league_id ORDER BY t.overall_pick) END AS live
  FROM ten t LEFT JOIN holes h ON h.league_id = t.league_id AND h.team_slot = t.team_slot AND h.cost_round = t.round),
placed AS (SELECT p.league_id, p.overall_pick, p.team_slot, coalesce(p.kept, m.player_id) AS player_id, p.kept IS NOT NULL AS is_keeper, m.team_slot AS picked_by FROM plan p LEFT JOIN picks m ON m.league_id = p.league_id AND m.overall_pick = p.live)"""


@query("j7_team_rosters", f"{_PLACED} SELECT league_id, overall_pick, player_id, is_keeper, CAST(picked_by AS INT) AS picked_by, team_slot = picked_by AS on_turn FROM placed")
def j7_team_rosters(spark, sf_dir):
    return board.team_rosters(*_kept_plan(spark, sf_dir)).select("league_id", "overall_pick", "player_id", "is_keeper", "picked_by", "on_turn")


@query("j7_drift", f"""{_PLACED}, w AS (SELECT league_id, team_slot, count(picked_by) AS expected FROM placed GROUP BY ALL), h AS (SELECT league_id, picked_by AS team_slot, count(*) AS actual FROM placed WHERE picked_by IS NOT NULL GROUP BY ALL)
SELECT league_id, CAST(team_slot AS INT) AS team_slot, expected, coalesce(actual, 0) AS actual, expected <> coalesce(actual, 0) AS offender FROM w LEFT JOIN h USING (league_id, team_slot)""")  # fmt: skip
def j7_drift(spark, sf_dir):
    """Live picks expected of every team, idle ones too, against those made, and who is out of turn."""
    return board.drift(board.team_rosters(*_kept_plan(spark, sf_dir)))


@query("j8_lineup_tally", f"""{_BOARD}, n AS (SELECT league_id, CAST(team_slot AS INT) AS team_slot, {_N} FROM picks GROUP BY ALL),
f AS (SELECT *, least(QB, 1) + least(WR, 3) + least(RB, 2) + least(TE, 1) + least(K, 1) + least(DEF, 1) AS fixed, least(1, greatest(WR - 3, 0) + greatest(RB - 2, 0) + greatest(TE - 1, 0)) AS flex, QB + WR + RB + TE + K + DEF AS n FROM n) SELECT league_id, team_slot, fixed, flex, n - fixed - flex AS bench, n > 16 AS over_full FROM f""")  # fmt: skip
def j8_lineup_tally(spark, sf_dir):
    v = valued_once(spark, sf_dir)
    return board.lineup_tally(_picks(v, _ten(spark, sf_dir)))


#: Free players in half of the leagues' positions only, so that some have nobody but kickers and defences left; the round by league, unknown in some.
_STARVED = "league_id % 2 = 0 OR position IN ('K', 'DEF')"
_ROUND = "CASE WHEN league_id % 4 = 1 THEN NULL ELSE 10 + league_id % 4 END"


@query("j9_best_available", f"""{_BOARD}, f AS (SELECT *, position IN ('K', 'DEF') AND NOT coalesce({_ROUND} >= 12, false) AS held_back FROM ranked WHERE player_id NOT IN (SELECT player_id FROM held) AND ({_STARVED}))
SELECT league_id, player_id, overall_rank FROM (SELECT *, row_number() OVER (PARTITION BY league_id ORDER BY held_back, overall_rank) AS n FROM f) WHERE n = 1""")  # fmt: skip
def j9_best_available(spark, sf_dir):
    v = valued_once(spark, sf_dir)
    rows = board.rows(v, _picks(v, _ten(spark, sf_dir)), _kept(v), MY_SLOT).filter(_STARVED)
    return board.best_available(rows, F.expr(_ROUND))


@query("j9_filtered_board", f"""{_BOARD} SELECT league_id, player_id, overall_rank FROM ranked WHERE position = 'RB' AND player_id % 6 = 0 AND player_id % 4 = 0 AND player_id NOT IN (SELECT player_id FROM held) AND lower('Player ' || player_id || ' ' || team || ' RB') LIKE '%t1%'""")
def j9_filtered_board(spark, sf_dir):
    """Running backs that are free, carry two flags, and match a search."""
    v = valued_once(spark, sf_dir)
    i = F.col("player_id")
    named = v.withColumns({"name": F.concat(F.lit("Player "), i), "flags": F.array_compact(F.array(F.when(i % 6 == 0, "injury_prone"), F.when(i % 4 == 0, "rookie")))})
    rows = board.rows(named, _picks(v, _ten(spark, sf_dir)), _kept(v), MY_SLOT)
    return board.sort_board(board.filter_board(rows, "RB", ["injury_prone", "rookie"], True, " T1"), "adp").select("league_id", "player_id", "overall_rank")


@query("j10_profiles", f"""{_why_sql().replace('WITH ' + ctes('pool'), 'WITH ' + ctes('pool', 'weekly'), 1)},
games AS (SELECT player_id, season, count(*) AS games, sum(targets) AS targets FROM weekly WHERE season_type = 'REG' GROUP BY ALL),
season_rows AS (SELECT player_id, string_agg(season || ':' || games || ':' || CAST(targets AS BIGINT), ',' ORDER BY season) AS seasons FROM games GROUP BY player_id),
site_rows AS (SELECT player_id, string_agg(source || ':' || printf('%.3f', rank), ',' ORDER BY source) AS market FROM (SELECT player_id, 'site' AS source, adp AS rank FROM pool WHERE adp IS NOT NULL UNION ALL SELECT player_id, 'experts', ppg FROM pool WHERE player_id % 3 > 0) GROUP BY player_id),
why_rows AS (SELECT player_id, string_agg(rule_id || ':' || polarity, ',' ORDER BY place) AS why FROM why WHERE place < 6 GROUP BY player_id)
SELECT z.player_id, z.position, z.team, coalesce(seasons, '') AS seasons, coalesce(market, '') AS market, coalesce(why, '') AS why, overall_rank, pos_rank, vorp, missed_3y::BIGINT AS missed_3y, injury_prone,
  CAST(substr(z.team, 2) AS INT) % 3 - 1 AS ol_delta FROM z LEFT JOIN season_rows USING (player_id) LEFT JOIN site_rows USING (player_id) LEFT JOIN why_rows USING (player_id)""")  # fmt: skip
def j10_profiles(spark, sf_dir):
    """Every player's document: seasons, market, reasons, ranking, summary and the context of his team."""
    v = settle(_signalled(spark, sf_dir), "signalled")
    weekly = bound(spark, sf_dir, "weekly").filter("season_type = 'REG'").groupBy("player_id", "season").agg(F.count("*").alias("games"), F.sum("targets").cast("long").alias("targets"))
    sites = v.filter("adp is not null").select("player_id", F.lit("site").alias("source"), F.col("adp").alias("rank")).unionByName(v.filter("player_id % 3 > 0").select("player_id", F.lit("experts").alias("source"), F.col("ppg").alias("rank")))
    facets = {
        "seasons": (weekly, ["season"]), "market": (sites, ["source"]), "why": (signals.reason_rows(v).select("player_id", "place", "rule_id", "polarity", "text"), ["place"]),
        "ranking": (v.select("player_id", "overall_rank", "pos_rank", "vorp"), ["overall_rank"]), "summary": (v.select("player_id", F.col("missed_3y").cast("long").alias("missed_3y"), "injury_prone"), ["missed_3y"]),
    }
    teams = v.select("team").distinct().withColumn("ol_delta", F.expr("CAST(substr(team, 2) AS INT) % 3 - 1"))
    p = board.profiles(v.select("player_id", "position", "team"), facets, teams)
    text = lambda c, *x: F.array_join(F.transform(c, lambda r: F.concat_ws(":", *[f(r) for f in x])), ",").alias(c)
    return p.select(
        "player_id", "position", "team", text("seasons", lambda r: r["season"], lambda r: r["games"], lambda r: r["targets"]), text("market", lambda r: r["source"], lambda r: F.format_string("%.3f", r["rank"])),
        text("why", lambda r: r["rule_id"], lambda r: r["polarity"]), F.col("ranking")[0]["overall_rank"].alias("overall_rank"), F.col("ranking")[0]["pos_rank"].alias("pos_rank"), F.col("ranking")[0]["vorp"].alias("vorp"),
        F.col("summary")[0]["missed_3y"].alias("missed_3y"), F.col("summary")[0]["injury_prone"].alias("injury_prone"), F.col("context.ol_delta").alias("ol_delta"),
    )


# pick log


def pick_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pick log: purchases are picks of a league of twenty users, one in 97 a reset, errors undo; some name their slot."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").filter("event_type in ('purchase', 'error')")
    action = F.when(F.col("event_type") == "error", "undo").when(i % 97 == 0, "reset").otherwise("pick")
    return e.select(
        "event_id", F.floor(F.col("user_id") / 20).alias("league_id"), action.alias("action"), (i % 401).alias("player_id"), F.when(i % 13 == 0, 1).cast("int").alias("team_slot"),
        F.when(i % 5 == 0, "feed").otherwise("manual").alias("source"), F.when(i % 11 == 0, i % 9 + 1).cast("int").alias("overall_pick"), F.col("ts").cast("timestamp").alias("picked_at"),
    )


def _logged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The pick log, and the schedules of the leagues in it: those of all customers have 160 rows each."""
    events = pick_events(spark, sf_dir)
    return events, draft.schedule(picks.heard(leagues(spark, sf_dir), events), picks.heard(keepers(spark, sf_dir), events))


_LOG = f"""WITH RECURSIVE {_PLAN},
slots AS (SELECT league_id, list({{'overall_pick': overall_pick, 'round': round, 'team_slot': team_slot}} ORDER BY overall_pick) AS slots, list(overall_pick ORDER BY overall_pick) AS numbers FROM plan WHERE live_pick_no IS NOT NULL GROUP BY league_id),
e AS (SELECT event_id, CAST(floor(user_id / 20) AS BIGINT) AS league_id, CASE WHEN event_type = 'error' THEN 'undo' WHEN event_id % 97 = 0 THEN 'reset' ELSE 'pick' END AS action, event_id % 401 AS player_id,
    CASE WHEN event_id % 13 = 0 THEN 1 END AS team_slot, CASE WHEN event_id % 5 = 0 THEN 'feed' ELSE 'manual' END AS source, CASE WHEN event_id % 11 = 0 THEN event_id % 9 + 1 END AS named,
    row_number() OVER (PARTITION BY CAST(floor(user_id / 20) AS BIGINT) ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('purchase', 'error')),
fold AS (
  SELECT league_id, 0::BIGINT AS n, [] :: STRUCT(overall_pick BIGINT, player_id BIGINT, team_slot INT, manual BOOLEAN)[] AS held, NULL::BIGINT AS event_id, NULL::BIGINT AS pick, NULL::INT AS team, NULL::VARCHAR AS reason FROM (SELECT DISTINCT league_id FROM e)
  UNION ALL
  SELECT league_id, n, CASE WHEN reason IS NOT NULL THEN held WHEN action = 'reset' THEN [] WHEN action = 'undo' THEN held[:-2]
      ELSE list_sort(list_append(held, {{'overall_pick': pick, 'player_id': player_id, 'team_slot': team, 'manual': source = 'manual'}})) END,
    event_id, CASE WHEN reason IS NULL AND action <> 'reset' THEN pick END, CASE WHEN reason IS NULL AND action <> 'reset' THEN team ELSE team_slot END, reason
  FROM (SELECT *, CASE WHEN action = 'undo' THEN held[-1].team_slot ELSE coalesce(team_slot, CAST(slots[list_position(numbers, pick)].team_slot AS INT)) END AS team,
      CASE WHEN action = 'undo' AND len(held) = 0 THEN 'nothing to undo' WHEN action = 'undo' AND NOT held[-1].manual THEN 'last pick is not manual'
        WHEN action = 'pick' AND list_contains(list_transform(held, lambda h: h.player_id), player_id) THEN 'already drafted' WHEN action = 'pick' AND slots IS NULL THEN 'no schedule'
        WHEN action = 'pick' AND named IS NULL AND len(held) >= len(slots) THEN 'draft complete' WHEN action = 'pick' AND NOT list_contains(numbers, pick) THEN 'no such pick'
        WHEN action = 'pick' AND list_contains(list_transform(held, lambda h: h.overall_pick), pick) THEN 'slot taken' END AS reason
    FROM (SELECT f.league_id, e.n, f.held, e.event_id, e.action, e.player_id, e.team_slot, e.source, e.named, s.slots, s.numbers, CASE WHEN e.action = 'undo' THEN f.held[-1].overall_pick ELSE coalesce(e.named, s.numbers[len(f.held) + 1]) END AS pick
      FROM fold f JOIN e ON e.league_id = f.league_id AND e.n = f.n + 1 LEFT JOIN slots s ON s.league_id = f.league_id))),
decided AS (SELECT f.*, e.action, e.player_id, list_position(s.numbers, f.pick) AS live, s.slots FROM fold f JOIN e USING (league_id, n) LEFT JOIN slots s ON s.league_id = f.league_id)"""


@query("k1_pick_log", f"""{_LOG} SELECT league_id, event_id, action, player_id, CAST(team AS INT) AS team_slot, CAST(pick AS INT) AS overall_pick, CAST(slots[live].round AS INT) AS round, CAST(live AS INT) AS live_pick_no,
  CAST(len(held) AS INT) AS standing, reason FROM decided""")  # fmt: skip
def k1_pick_log(spark, sf_dir):
    """Every event's decision under its league's schedule of 8 to 12 teams with keepers, folded in batch; the stream gives the same rows."""
    return picks.fold_in_batch(*_logged(spark, sf_dir)).drop("picked_at")


@query("k2_standing_picks", f"{_LOG}, ends AS (SELECT league_id, max(n) AS n FROM decided GROUP BY league_id) SELECT league_id, CAST(h.overall_pick AS INT) AS overall_pick, CAST(h.team_slot AS INT) AS team_slot, h.player_id FROM (SELECT d.league_id, unnest(held) AS h FROM decided d JOIN ends USING (league_id, n))")
def k2_standing_picks(spark, sf_dir):
    """What stands at the end of each league's log: one pick a slot."""
    return picks.standing_in_batch(picks.fold_in_batch(*_logged(spark, sf_dir)))


@query("k3_live_state", f"{_LOG}, ends AS (SELECT league_id, max(n) AS n FROM decided GROUP BY league_id) SELECT d.league_id, CAST(len(held) AS INT) AS picks_made, CAST(slots[len(held) + 1].team_slot AS INT) AS team_slot, CAST(slots[len(held) + 1].round AS INT) AS round FROM decided d JOIN ends USING (league_id, n)")
def k3_live_state(spark, sf_dir):
    """Picks made and who is on the clock in each league."""
    events, schedule = _logged(spark, sf_dir)
    return picks.live_state(picks.fold_in_batch(events, schedule), schedule)
