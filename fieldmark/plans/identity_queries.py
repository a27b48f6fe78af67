"""Identity resolution and market consensus over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.functions import names
from fieldmark.functions.names import POSITIONS, TEAMS, normal_name
from fieldmark.operators import identity, market
from fieldmark.plans.bindings import bound, ctes, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


_NAME_SQL = """coalesce(array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower(strip_accents({x})), '[-_/]', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' '),
  lambda w: w NOT IN ('', 'jr', 'sr', 'ii', 'iii', 'iv', 'v')), ' '), '')"""


def _map_sql(x: str, spelling: dict[str, str]) -> str:
    return f"CASE upper(trim({x})) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in spelling.items())} ELSE upper(trim({x})) END"


_CODES = "AZ LAR SFO kc FA NOR XX GNB"
_SPOTS = "WR,RB fb D/ST PK,K qb"


@query("d1_normal_names", f"""WITH n AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' Jr.' WHEN 1 THEN ' III' ELSE '' END AS name, string_split('{_CODES}', ' ')[CAST(doc_id % 8 AS INT) + 1] AS team, string_split('{_SPOTS}', ' ')[CAST(doc_id % 5 AS INT) + 1] AS spot FROM documents)
SELECT doc_id, CASE WHEN name IS NOT NULL THEN {_NAME_SQL.format(x='name')} END AS name_norm, {_map_sql('team', TEAMS)} AS team, {_map_sql("string_split(spot, ',')[1]", POSITIONS)} AS position FROM n""")  # fmt: skip
def d1_normal_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    end = F.when(F.col("doc_id") % 3 == 0, " Jr.").when(F.col("doc_id") % 3 == 1, " III").otherwise("")
    pick = lambda codes, n: F.element_at(F.split(F.lit(codes), " "), (F.col("doc_id") % n + 1).cast("int"))
    return d.select("doc_id", normal_name(F.concat("text", end)).alias("name_norm"), names.team(pick(_CODES, 8)).alias("team"), names.position(pick(_SPOTS, 5)).alias("position"))


_HUB = """hub AS (SELECT c_custkey + 1 AS player_id, concat('p ', CAST(c_custkey % 400 AS VARCHAR(9))) AS name_norm, concat('N', CAST(c_nationkey AS VARCHAR(9))) AS team, c_mktsegment AS position,
  CASE WHEN c_custkey % 3 = 0 THEN concat('a', CAST(c_custkey AS VARCHAR(9))) END AS a_id, CASE WHEN c_custkey % 5 = 0 THEN concat('b', CAST(c_custkey AS VARCHAR(9))) END AS b_id FROM {customer})"""
_SOURCE = """source AS (SELECT c_custkey AS source_id, CASE WHEN c_custkey % 4 = 0 THEN concat('a', CAST(c_custkey AS VARCHAR(9))) END AS a_id,
  CASE WHEN c_custkey % 2 = 0 THEN concat('b', CAST(c_custkey AS VARCHAR(9))) END AS b_id, concat('p ', CAST(c_custkey % 400 AS VARCHAR(9))) AS name_norm,
  CASE WHEN c_custkey % 7 = 0 THEN 'N99' ELSE concat('N', CAST(c_nationkey AS VARCHAR(9))) END AS team, CASE WHEN c_custkey % 11 = 0 THEN 'OTHER' ELSE c_mktsegment END AS position FROM {customer})"""


def _frame(spark: SparkSession, sf_dir: str, cte: str) -> DataFrame:
    name = cte.split(" AS ", 1)[0]
    return spark.sql(f"WITH {cte} SELECT * FROM {name}", customer=table(spark, sf_dir, "customer"))


def _step_sql(n: int, left: str, keys: str, how: str) -> str:
    on = " AND ".join(f"s.{k} = h.{k}" for k in keys.split())
    cols = ", ".join(keys.split())
    return f"""m{n} AS (SELECT s.source_id, h.player_id, '{how}' AS matched_by FROM {left} s JOIN (SELECT {cols}, min(player_id) AS player_id FROM hub GROUP BY {cols} HAVING count(*) = 1) h ON {on}),
l{n} AS (SELECT * FROM {left} WHERE source_id NOT IN (SELECT source_id FROM m{n}))"""


_CASCADE = ", ".join([
    _step_sql(1, "source", "a_id", "id:a_id"), _step_sql(2, "l1", "b_id", "id:b_id"), _step_sql(3, "l2", "name_norm team position", "name_team_pos"),
    _step_sql(4, "l3", "name_norm position", "name_pos"),
])
_LINKS = " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(1, 5)) + " UNION ALL SELECT source_id, CAST(NULL AS BIGINT), 'new' FROM l4"
_BOTH = f"{_HUB}, {_SOURCE}".format(customer="customer")


@query("d2_crosswalk", f"WITH {_BOTH}, {_CASCADE} SELECT * FROM ({_LINKS})")
def d2_crosswalk(spark, sf_dir):
    got = identity.crosswalk(_frame(spark, sf_dir, _SOURCE), _frame(spark, sf_dir, _HUB), ["a_id", "b_id"])
    return got.select("source_id", "player_id", "matched_by")


@query("d2_sources_in_order", f"""WITH {_BOTH}, {_CASCADE}, links AS ({_LINKS}), brought AS (SELECT player_id AS p, min(source_id) AS source_id FROM links WHERE player_id IS NOT NULL GROUP BY ALL),
hub2 AS (SELECT h.player_id, coalesce(h.a_id, s.a_id) AS a_id, coalesce(h.b_id, s.b_id) AS b_id FROM hub h LEFT JOIN brought b ON h.player_id = b.p LEFT JOIN source s ON s.source_id = b.source_id)
SELECT player_id, a_id, b_id FROM hub2""")  # fmt: skip
def d2_sources_in_order(spark, sf_dir):
    """What a source's links add to the hub, for the sources after it."""
    _, hub = identity.crosswalk_all([("first", _frame(spark, sf_dir, _SOURCE), ["a_id", "b_id"])], _frame(spark, sf_dir, _HUB))
    return hub.select("player_id", "a_id", "b_id")


#: People as a roster and three sources have them, each with some of the customers; the registry knows some by c_id.
_PERSON = "concat('P ', CAST(c_custkey % 300 AS VARCHAR(9))) AS name, concat('p ', CAST(c_custkey % 300 AS VARCHAR(9))) AS name_norm, CASE c_mktsegment WHEN 'FURNITURE' THEN 'DEF' ELSE c_mktsegment END AS position, CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE concat('N', CAST(c_nationkey AS VARCHAR(9))) END AS team"
_ID = lambda x, every, of="c_custkey": f"CASE WHEN c_custkey % {every} > 0 THEN concat('{x}', CAST({of} AS VARCHAR(9))) END AS {x}_id"
_PEOPLE = {
    "roster": f"SELECT c_custkey AS place, concat('g', CAST(c_custkey AS VARCHAR(9))) AS gsis_id, {_ID('a', 3)}, {_ID('b', 5)}, {_PERSON} FROM {{customer}} WHERE c_custkey % 5 IN (0, 1)",
    "ranks": f"SELECT c_custkey AS place, {_ID('a', 2)}, {_ID('b', 4)}, {_PERSON} FROM {{customer}} WHERE c_custkey % 5 IN (1, 2)",
    "pool": f"SELECT c_custkey AS place, {_ID('c', 4)}, {_ID('b', 2, 'c_custkey - c_custkey % 3')}, {_PERSON} FROM {{customer}} WHERE c_custkey % 5 IN (2, 3)",
    "projections": f"SELECT c_custkey AS place, {_ID('c', 3)}, {_ID('a', 4)}, {_PERSON} FROM {{customer}} WHERE c_custkey % 5 IN (3, 4)",
    "registry": "SELECT concat('c', CAST(c_custkey AS VARCHAR(9))) AS c_id, CASE WHEN c_custkey % 2 = 0 THEN concat('g', CAST(c_custkey AS VARCHAR(9))) END AS gsis_id, concat('R ', CAST(c_custkey AS VARCHAR(9))) AS name, concat('r ', CAST(c_custkey AS VARCHAR(9))) AS name_norm FROM {customer} WHERE c_custkey % 7 = 3",
}
_ORDER = (("ranks", ("a_id", "b_id"), False), ("pool", ("c_id", "b_id"), True), ("projections", ("c_id", "a_id"), False))
_FIELDS = ("name", "name_norm", "position", "team", "gsis_id", "a_id", "b_id", "c_id")


def _key_sql(gsis: str, position: str, team: str, name: str) -> str:
    return f"CASE WHEN {position} = 'DEF' THEN 'DEF:' || coalesce({team}, '') ELSE coalesce({gsis}, 'name:' || {name} || '|' || {position}) END"


def _source_sql(k: int, name: str, ids: tuple[str, ...], registry: bool) -> str:
    """One source's rows against the hub before it, and the hub after it."""
    index = ", ".join(f"i{k}_{i} AS (SELECT {i} AS v, arg_min(hub_key, seq) AS hub_key FROM hub{k - 1} WHERE {i} IS NOT NULL GROUP BY 1)" for i in ids)
    joins = " ".join(f"LEFT JOIN i{k}_{i} ON i{k}_{i}.v = s.{i}" for i in ids)
    found = [("CASE WHEN s.position = 'DEF' THEN 'DEF:' || coalesce(s.team, '') END", "def:team"), *((f"i{k}_{i}.hub_key", f"id:{i}") for i in ids), (f"t{k}.hub_key", "name+team+pos"), (f"n{k}.hub_key", "name+pos")]
    if registry:
        found.append((f"CASE WHEN r.c_id IS NOT NULL THEN {_key_sql('r.gsis_id', 's.position', 's.team', 'r.name_norm')} END", "registry:c_id"))
    found.append((_key_sql("NULL", "s.position", "s.team", "s.name_norm"), "new"))
    how = "CASE " + " ".join(f"WHEN ({e}) IS NOT NULL THEN '{w}'" for e, w in found) + " END"
    new = f"({how}) = 'registry:c_id'" if registry else "false"
    gsis, person = (f"CASE WHEN {new} THEN r.gsis_id END", {c: f"CASE WHEN {new} THEN r.{c} ELSE s.{c} END" for c in ("name", "name_norm")}) if registry else ("NULL::VARCHAR", {})
    own = {"gsis_id": gsis, **{i: f"s.{i}" for i in ids}, **{c: person.get(c, f"s.{c}") for c in ("name", "name_norm", "position", "team")}}
    cols = ", ".join(f"{e} AS {c}" for c, e in own.items())
    first = ", ".join(f"arg_min({c}, place) FILTER ({c} IS NOT NULL) AS {c}" for c in own)
    fields = ", ".join(f"coalesce(h.{c}, b.{c}) AS {c}" if c in own else f"h.{c} AS {c}" for c in _FIELDS)
    return f"""{index},
t{k} AS (SELECT name_norm, team, position, arg_min(hub_key, seq) AS hub_key FROM hub{k - 1} WHERE name_norm IS NOT NULL AND team IS NOT NULL AND position IS NOT NULL GROUP BY ALL),
n{k} AS (SELECT name_norm, position, min(hub_key) AS hub_key FROM hub{k - 1} WHERE name_norm IS NOT NULL AND position IS NOT NULL GROUP BY ALL HAVING count(*) = 1),
f{k} AS (SELECT place, coalesce({', '.join(e for e, _ in found)}) AS hub_key, {how} AS how, {cols} FROM {name} s {joins} LEFT JOIN t{k} ON t{k}.name_norm = s.name_norm AND t{k}.team = s.team AND t{k}.position = s.position
  LEFT JOIN n{k} ON n{k}.name_norm = s.name_norm AND n{k}.position = s.position {'LEFT JOIN registry r ON r.c_id = s.c_id' if registry else ''}),
b{k} AS (SELECT hub_key, min(place) AS place, arg_max(how, place) AS how, {first} FROM f{k} GROUP BY hub_key),
hub{k} AS (SELECT coalesce(h.hub_key, b.hub_key) AS hub_key, coalesce(h.seq, {k} * 1000000000 + b.place) AS seq, {fields}, concat_ws(';', h.match_sources, '{name}=' || b.how) AS match_sources FROM hub{k - 1} h FULL JOIN b{k} b ON h.hub_key = b.hub_key)"""


_GROWN = f"""WITH {', '.join(f"{n} AS ({q.format(customer='customer')})" for n, q in _PEOPLE.items())},
hub0 AS (SELECT {_key_sql('gsis_id', 'position', 'team', 'name_norm')} AS hub_key, min(place) AS seq, {', '.join(f'arg_min({c}, place) FILTER ({c} IS NOT NULL) AS {c}' for c in _FIELDS if c != 'c_id')}, NULL::VARCHAR AS c_id, 'roster=gsis_id' AS match_sources FROM roster GROUP BY 1),
{', '.join(_source_sql(k, *s) for k, s in enumerate(_ORDER, 1))}"""


def _people(spark, sf_dir, name: str) -> DataFrame:
    return spark.sql(_PEOPLE[name], customer=table(spark, sf_dir, "customer"))


def grown_hub(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    sources = [identity.Source(n, _people(spark, sf_dir, n), ids, "c_id" if known else None, _people(spark, sf_dir, "registry") if known else None) for n, ids, known in _ORDER]
    return identity.grow_hub(identity.new_hub(_people(spark, sf_dir, "roster"), ["a_id", "b_id"], "roster"), sources)


@query("d2_growing_hub", f"{_GROWN} SELECT hub_key, {', '.join(_FIELDS)}, match_sources FROM hub3")
def d2_growing_hub(spark, sf_dir):
    """A roster's hub after three sources in order: what nobody knew joins it, and later sources find it there."""
    hub, _ = grown_hub(spark, sf_dir)
    seen = F.concat_ws(";", *[F.when(F.col("match_sources")[n].isNotNull(), F.concat(F.lit(f"{n}="), F.col("match_sources")[n])) for n in ("roster", *(s[0] for s in _ORDER))])
    return hub.select("hub_key", *_FIELDS, seen.alias("match_sources"))


@query("d2_links", f"{_GROWN} SELECT 'ranks' AS source, place, hub_key, how FROM f1 UNION ALL SELECT 'pool', place, hub_key, how FROM f2 UNION ALL SELECT 'projections', place, hub_key, how FROM f3")
def d2_links(spark, sf_dir):
    return grown_hub(spark, sf_dir)[1]


@query("d3_first_value", """SELECT p_name, min_by(p_type, p_partkey) AS p_type FROM part WHERE p_partkey % 3 > 0 GROUP BY p_name""".replace("min_by", "arg_min"))
def d3_first_value(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("p_type", F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).otherwise("  "))
    return identity.first_value(p, "p_name", "p_type", "p_partkey")


@query("d4_overrides", """SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'FIXED' ELSE n_name END AS n_name FROM nation""")
def d4_overrides(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    fix = n.filter("n_nationkey % 2 = 0").select("n_nationkey", F.when(F.col("n_nationkey") % 4 == 0, "FIXED").alias("n_name"))
    return identity.override(n.select("n_nationkey", "n_name"), fix, "n_nationkey", ["n_name"])


@query("d5_unmatched", f"WITH {_BOTH}, {_CASCADE} SELECT source_id, 's' AS source, CASE WHEN source_id % 2 = 0 THEN CAST(source_id AS DOUBLE) END AS adp FROM l4")
def d5_unmatched(spark, sf_dir):
    got = identity.crosswalk(_frame(spark, sf_dir, _SOURCE), _frame(spark, sf_dir, _HUB), ["a_id", "b_id"])
    rows = got.select("source_id", F.lit("s").alias("source"), F.when(F.col("source_id") % 2 == 0, F.col("source_id").cast("double")).alias("adp"), "player_id")
    return identity.unmatched(rows).select("source_id", "source", "adp")


#: The stored table before: a third of the hub, some of its id rows still without their id; texts of one column out of date.
_STORED = "hub_key, row_number() OVER (ORDER BY hub_key) * 3 AS player_id, CASE WHEN hub_key LIKE '%7' THEN NULL ELSE gsis_id END AS gsis_id, name, name_norm, position, team, 'old' AS a_id"
_TAG = "CASE WHEN gsis_id IS NOT NULL THEN 'id' WHEN position = 'DEF' THEN 'def' ELSE 'name' END AS kind, CASE WHEN gsis_id IS NOT NULL THEN gsis_id WHEN position = 'DEF' THEN coalesce(team, '') ELSE concat_ws('|', name_norm, position) END AS value"


@query("d6_upsert", f"""{_GROWN}, stored AS (SELECT {_STORED} FROM hub3 WHERE hub_key LIKE '%1' OR hub_key LIKE '%7' OR hub_key LIKE '%3|%'),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, value ORDER BY hub_key) AS k FROM (SELECT *, {_TAG} FROM hub3 WHERE name IS NOT NULL AND position IS NOT NULL)), r1 AS (SELECT * FROM r WHERE k = 1),
h AS (SELECT kind, value, min(player_id) AS player_id FROM (SELECT *, {_TAG} FROM stored) GROUP BY ALL), met AS (SELECT r1.*, h.player_id FROM r1 LEFT JOIN h ON h.kind = r1.kind AND h.value = r1.value),
takers AS (SELECT m.value, f.player_id FROM (SELECT concat_ws('|', name_norm, position) AS by_name, min(value) AS value FROM met WHERE kind = 'id' AND player_id IS NULL GROUP BY 1) m
  JOIN (SELECT * FROM h WHERE kind = 'name' AND value NOT IN (SELECT value FROM r1 WHERE kind = 'name')) f ON f.value = m.by_name),
done AS (SELECT m.* EXCLUDE (player_id), coalesce(m.player_id, t.player_id) AS player_id FROM met m LEFT JOIN takers t ON m.kind = 'id' AND t.value = m.value)
SELECT s.player_id, {', '.join(f'coalesce(d.{c}, s.{c}) AS {c}' for c in ('gsis_id', 'name', 'name_norm', 'position', 'team', 'a_id'))}, false AS is_new FROM stored s LEFT JOIN done d ON d.player_id = s.player_id
UNION ALL SELECT NULL, gsis_id, name, name_norm, position, team, a_id, true FROM done WHERE player_id IS NULL""")  # fmt: skip
def d6_upsert(spark, sf_dir):
    """A hub of three kinds of rows into a stored table; players who got an id keep their player_id. New ids are checked by tests."""
    hub, _ = grown_hub(spark, sf_dir)
    stored = stored_players(hub)
    out = identity.upsert(stored, hub, ["gsis_id", "name", "name_norm", "position", "team", "a_id"])
    old = out.join(stored.select("player_id", F.lit(True).alias("old")), "player_id", "left")
    return old.withColumn("is_new", F.col("old").isNull()).withColumn("player_id", F.when(F.col("old"), F.col("player_id"))).drop("old")


def stored_players(hub: DataFrame) -> DataFrame:
    some = hub.filter("hub_key LIKE '%1' OR hub_key LIKE '%7' OR hub_key LIKE '%3|%'")
    some = identity.numbered(some.select("hub_key", "gsis_id", *identity.PERSON), "hub_key", buckets=1)
    gsis = F.when(~F.col("hub_key").like("%7"), F.col("gsis_id"))
    return some.select((F.col("_no") * 3).cast("long").alias("player_id"), gsis.alias("gsis_id"), *identity.PERSON, F.lit("old").alias("a_id"))


@query("d7_market_names", f"""WITH {_BOTH}, people AS (SELECT * FROM hub WHERE position <> 'FURNITURE'), d AS (SELECT * FROM hub WHERE position = 'FURNITURE'), s AS (SELECT * FROM source WHERE position <> 'FURNITURE'),
one AS (SELECT name_norm, position, min(player_id) AS player_id FROM people GROUP BY ALL HAVING count(*) = 1), two AS (SELECT name_norm, position, team, min(player_id) AS player_id FROM people GROUP BY ALL HAVING count(*) = 1),
three AS (SELECT split_part(name_norm, ' ', 2) AS last, position, team, min(player_id) AS player_id FROM people GROUP BY ALL HAVING count(*) = 1),
m AS (SELECT s.source_id, coalesce(one.player_id, two.player_id, three.player_id) AS player_id, CASE WHEN one.player_id IS NOT NULL THEN 'name_pos' WHEN two.player_id IS NOT NULL THEN 'name_pos_team' ELSE 'last_name_team' END AS matched_by
  FROM s LEFT JOIN one USING (name_norm, position) LEFT JOIN two USING (name_norm, position, team) LEFT JOIN three ON three.last = split_part(s.name_norm, ' ', 2) AND three.position = s.position AND three.team = s.team)
SELECT * FROM m WHERE player_id IS NOT NULL UNION ALL SELECT source.source_id, d.player_id, 'team' FROM source JOIN d USING (team) WHERE source.position = 'FURNITURE'""")  # fmt: skip
def d7_market_names(spark, sf_dir):
    """Duplicate names kept only where the team agrees; one segment stands for defences."""
    spot = F.when(F.col("position") == "FURNITURE", "DEF").otherwise(F.col("position"))
    src, hub = (_frame(spark, sf_dir, c).withColumn("position", spot) for c in (_SOURCE, _HUB))
    return identity.match_market(src.drop("a_id", "b_id"), hub).select("source_id", "player_id", "matched_by")


@query("d8_id_coverage", f"WITH {_BOTH} SELECT count(*) AS players, count(a_id) AS a_id, count(b_id) AS b_id FROM hub")
def d8_id_coverage(spark, sf_dir):
    return identity.id_coverage(_frame(spark, sf_dir, _HUB), ["a_id", "b_id"])


_IDS = """ids AS (SELECT c_custkey AS player_id, c_nationkey AS class, CASE WHEN c_custkey % 7 > 0 THEN CASE c_custkey % 3 WHEN 0 THEN concat('00-', lpad(CAST(c_custkey AS VARCHAR(9)), 7, '0'))
  WHEN 1 THEN concat('ABC', lpad(CAST(c_custkey AS VARCHAR(9)), 6, '0')) ELSE concat('x', CAST(c_custkey AS VARCHAR(9))) END END AS gsis_id FROM {customer})"""


@query("d8_id_styles", f"""WITH {_IDS.format(customer='customer')} SELECT class, count(*) AS rows, count(gsis_id) AS non_null, count(*) FILTER (regexp_matches(gsis_id, '^[0-9]{{2}}-[0-9]{{7}}$')) AS gsis_style,
  count(*) FILTER (regexp_matches(gsis_id, '^[A-Z]{{3}}[0-9]{{6}}$')) AS esb_style FROM ids GROUP BY class""")  # fmt: skip
def d8_id_styles(spark, sf_dir):
    return identity.id_styles(_frame(spark, sf_dir, _IDS), "gsis_id", ["class"])


@query("d8_unknown_teams", f"WITH t AS (SELECT string_split('AZ LAR XX FA QQQ', ' ')[CAST(c_custkey % 5 AS INT) + 1] AS team FROM customer) SELECT team, count(*) AS players FROM t WHERE team IN ('XX', 'QQQ') GROUP BY team")
def d8_unknown_teams(spark, sf_dir):
    code = F.element_at(F.split(F.lit("AZ LAR XX FA QQQ"), " "), (F.col("c_custkey") % 5 + 1).cast("int"))
    return identity.unknown_teams(table(spark, sf_dir, "customer").select(names.team(code).alias("team")))


@query("d8_resolved_share", """WITH r AS (SELECT concat('s', CAST(c_nationkey AS VARCHAR)) AS source, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank, CASE WHEN c_custkey % 6 > 0 THEN c_custkey END AS player_id FROM customer)
SELECT source, count(*) AS n, count(player_id) / count(*) AS resolved FROM r WHERE rank <= 20 GROUP BY source""")  # fmt: skip
def d8_resolved_share(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    ranks = c.select(F.concat(F.lit("s"), "c_nationkey").alias("source"), rank.alias("rank"), F.when(F.col("c_custkey") % 6 > 0, F.col("c_custkey")).alias("player_id"))
    return identity.resolved_share(ranks, 20)


@query("d9_listing", f"""WITH {ctes('pool')} SELECT player_id, name, CAST(rank AS DOUBLE) AS rank FROM (SELECT p_partkey AS player_id, p_name AS name, p_type AS position FROM part) p LEFT JOIN (SELECT player_id, adp AS rank FROM pool WHERE player_id % 2 = 0) r USING (player_id)
WHERE name LIKE '%ring%' AND position = 'SMALL' ORDER BY rank NULLS LAST, player_id LIMIT 20""")  # fmt: skip
def d9_listing(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("player_id"), F.col("p_name").alias("name"), F.col("p_type").alias("position"))
    r = bound(spark, sf_dir, "pool").filter("player_id % 2 = 0").select("player_id", F.col("adp").alias("rank"))
    return identity.listing(p, r, part="RING", position="SMALL", limit=20).select("player_id", "name", "rank")


#: Four sources over the pool: each orders it in its own way, and each lacks some players.
SOURCES = ("ecr", "site_a", "site_b", "site_c")
_MARKET = f"""{ctes('pool')}, long AS (
  SELECT league_id, player_id, position, 'ecr' AS source, ppg * -1 AS o, CAST(NULL AS DOUBLE) AS adp, round(1 + CAST(player_id % 29 AS DOUBLE) / 8, 3) AS std FROM pool
  UNION ALL SELECT league_id, player_id, position, 'site_a', adp, adp, sd_adp FROM pool WHERE player_id % 3 <> 0 AND adp IS NOT NULL
  UNION ALL SELECT league_id, player_id, position, 'site_b', adp + player_id % 7, CASE WHEN adp + player_id % 7 < 240 THEN adp + player_id % 7 END, NULL FROM pool WHERE player_id % 4 <> 0 AND adp IS NOT NULL
  UNION ALL SELECT league_id, player_id, position, 'site_c', adp * 2, CASE WHEN adp * 2 < 240 THEN adp * 2 END, NULL FROM pool WHERE player_id % 5 <> 0 AND adp IS NOT NULL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY league_id, source ORDER BY o, player_id) AS DOUBLE) AS rank FROM long)"""


def _market_sources(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    p = bound(spark, sf_dir, "pool")
    i, adp = F.col("player_id"), F.col("adp")
    ecr = p.select("league_id", "player_id", (-F.col("ppg")).alias("order"), F.round(1 + (i % 29).cast("double") / 8, 3).alias("std"))
    a = p.filter(i % 3 != 0).select("league_id", "player_id", adp.alias("order"), "adp", F.col("sd_adp").alias("std"))
    b = p.filter(i % 4 != 0).select("league_id", "player_id", (adp + i % 7).alias("order"), (adp + i % 7).alias("adp"))
    c = p.filter(i % 5 != 0).select("league_id", "player_id", (adp * 2).alias("order"), (adp * 2).alias("adp"))
    return [("ecr", ecr), ("site_a", a), ("site_b", b), ("site_c", c)]


def market_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.collect(_market_sources(spark, sf_dir), sentinel=240.0)


@query("e1_collect_each", f"WITH {_MARKET} SELECT league_id, player_id, source, rank, CASE WHEN adp < 240 THEN adp END AS adp, std FROM ranked WHERE source <> 'site_b'")
def e1_collect_each(spark, sf_dir):
    """The same sources, of which one cannot be planned, one fails while it runs and one has nothing to offer."""
    good = dict(_market_sources(spark, sf_dir))
    sources = [(n, lambda d=d: d) for n, d in good.items() if n != "site_b"]
    sources += [("lost", lambda: spark.read.parquet(f"{sf_dir}/no_such_table.parquet")), ("empty", lambda: good["ecr"].filter("false")), ("site_b", lambda: good["site_b"].withColumn("order", F.raise_error(F.lit("broken")).cast("double")))]
    return market.collect_each(spark, sources, sentinel=240.0)[0].select("league_id", "player_id", "source", "rank", "adp", "std")


@query("e1_collect", f"WITH {_MARKET} SELECT league_id, player_id, source, rank, CASE WHEN adp < 240 THEN adp END AS adp, std FROM ranked")
def e1_collect(spark, sf_dir):
    return market_long(spark, sf_dir).select("league_id", "player_id", "source", "rank", "adp", "std")


@query("e2_deviation_line", f"""WITH {ctes('pool')}, f AS (SELECT league_id, regr_count(sd_adp, adp) AS n, regr_slope(sd_adp, adp) AS b, regr_intercept(sd_adp, adp) AS a FROM pool GROUP BY league_id)
SELECT league_id, round(CASE WHEN n >= 20 THEN a ELSE 1.0 END, 6) AS a, round(CASE WHEN n >= 20 THEN b ELSE 0.10 END, 8) AS b, n FROM f""")  # fmt: skip
def e2_deviation_line(spark, sf_dir):
    out = market.deviation_line(bound(spark, sf_dir, "pool"), y="sd_adp")
    return out.select("league_id", F.round("a", 6).alias("a"), F.round("b", 8).alias("b"), "n")


@query("e3_expert_line", f"""WITH {_MARKET}, f AS (SELECT league_id, position, regr_count(std, rank) AS n, regr_slope(std, rank) AS b, regr_intercept(std, rank) AS a FROM ranked WHERE source = 'ecr' GROUP BY ALL)
SELECT league_id, position, round(a, 6) AS a, round(b, 8) AS b, n FROM f WHERE n >= 10""")  # fmt: skip
def e3_expert_line(spark, sf_dir):
    rows = market_long(spark, sf_dir).filter("source = 'ecr'").join(bound(spark, sf_dir, "pool").select("player_id", "position"), "player_id")
    out = market.deviation_line(rows, ["league_id", "position"], "rank", "std", market.LEAST_BY_POSITION).filter("n >= 10")
    return out.select("league_id", "position", F.round("a", 6).alias("a"), F.round("b", 8).alias("b"), "n")


def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = bound(spark, sf_dir, "pool").select("player_id", "position")
    return market.composite(market_long(spark, sf_dir), spots, SOURCES, SOURCES[1:], "ecr")


_COMPOSITE = f"""{_MARKET}, fixed AS (SELECT * REPLACE (CASE WHEN adp < 240 THEN adp END AS adp) FROM ranked),
w AS (SELECT league_id, player_id, min(position) AS position, avg(rank) AS mr, count(*) AS n_sources, stddev_samp(rank) AS composite_std, round(avg(adp), 2) AS composite_adp,
  max(rank) FILTER (source = 'ecr') AS er, max(std) FILTER (source = 'ecr') AS es, max(std) FILTER (source = 'site_a') AS own,
  coalesce(max(adp) FILTER (source = 'site_a'), max(adp) FILTER (source = 'site_b'), max(adp) FILTER (source = 'site_c')) AS x FROM fixed GROUP BY ALL),
ef AS (SELECT league_id, position, regr_slope(es, er) AS eb, regr_intercept(es, er) AS ea, regr_count(es, er) AS en FROM w GROUP BY ALL),
rf AS (SELECT league_id, CASE WHEN regr_count(own, x) >= 20 THEN coalesce(regr_slope(own, x), 0.1) ELSE 0.1 END AS b, CASE WHEN regr_count(own, x) >= 20 AND regr_slope(own, x) IS NOT NULL THEN regr_intercept(own, x) ELSE 1.0 END AS a FROM w GROUP BY ALL)"""


@query("e4_composite", f"""WITH {_COMPOSITE} SELECT league_id, player_id, n_sources, round(mr, 2) AS composite_rank, round(composite_std, 6) AS composite_std, composite_adp,
  round(CASE WHEN en >= 10 THEN es - (ea + eb * er) END, 3) AS disagreement, round(coalesce(own, greatest(1.0, a + b * composite_adp)), 3) AS sd_adp
FROM w LEFT JOIN ef USING (league_id, position) LEFT JOIN rf USING (league_id)""")  # fmt: skip
def e4_composite(spark, sf_dir):
    c = consensus(spark, sf_dir)
    return c.select("league_id", "player_id", F.col("n_sources").cast("long").alias("n_sources"), "composite_rank", F.round("composite_std", 6).alias("composite_std"), "composite_adp", "disagreement", "sd_adp")


@query("e5_depth_gate", f"""WITH {_COMPOSITE}, n AS (SELECT league_id, player_id, count(adp) AS n FROM fixed WHERE source <> 'ecr' GROUP BY ALL),
r AS (SELECT w.*, coalesce(n.n, 0) AS adps, en, row_number() OVER (PARTITION BY league_id ORDER BY round(mr, 2) NULLS LAST, player_id) AS k FROM w LEFT JOIN n USING (league_id, player_id) LEFT JOIN ef USING (league_id, position))
SELECT league_id, count(*) FILTER (k <= 150 AND adps < 2) AS thin_first, count(*) FILTER (adps < 1) AS thin_second, count(*) FILTER (k <= 150 AND (es IS NULL OR en < 10)) AS no_disagreement FROM r WHERE k <= 200 GROUP BY league_id""")  # fmt: skip
def e5_depth_gate(spark, sf_dir):
    return market.depth_gate(consensus(spark, sf_dir), SOURCES[1:])


@query("e6_page_summary", """SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS page_types,
  (SELECT string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FROM (SELECT event_id FROM events WHERE event_type = 'view' AND event_id < 60)) AS first, max(CAST(ts AS DATE)) AS latest FROM events""")  # fmt: skip
def e6_page_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    pages = e.select(F.col("event_type").alias("page_type"), F.col("event_id").alias("rank"), F.col("event_id").cast("string").alias("player"), F.to_date("ts").alias("scrape_date"))
    out = market.page_summary(pages, "view", 59)
    return out.select(F.array_join("page_types", ",").alias("page_types"), F.array_join("first", ",").alias("first"), "latest")
