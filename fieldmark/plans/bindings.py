"""How the given tables stand in for the library's inputs.

Each binding is SQL that Spark and DuckDB read alike; queries take it through
Spark, the SQL they are held against takes it as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A supplier is a player, a line item a play; weeks 1 to 18 of a year are a regular season, 19 to 22 the rest.
WEEKLY = """
SELECT l_suppkey AS player_id, season, week, CASE WHEN week <= 18 THEN 'REG' ELSE 'POST' END AS season_type,
  CASE l_suppkey % 20 WHEN 18 THEN 'K' WHEN 19 THEN 'DEF' ELSE
    CASE l_suppkey % 4 WHEN 0 THEN 'WR' WHEN 1 THEN 'RB' WHEN 2 THEN 'TE' ELSE 'QB' END END AS position,
  concat('T', CAST((l_suppkey * 7 + season + CASE WHEN l_suppkey % 10 = 0 AND week > 9 THEN 1 ELSE 0 END) % 16 AS VARCHAR(4))) AS team,
  CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity * 6 ELSE 0 END) AS DOUBLE) AS passing_yards,
  CAST(sum(CASE WHEN l_discount >= 0.075 THEN 1 ELSE 0 END) AS DOUBLE) AS passing_tds,
  CAST(sum(CASE WHEN l_tax >= 0.065 AND l_tax < 0.075 THEN 1 ELSE 0 END) AS DOUBLE) AS passing_interceptions,
  CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity * 3 ELSE 0 END) AS DOUBLE) AS rushing_yards,
  CAST(sum(CASE WHEN l_discount < 0.015 THEN 1 ELSE 0 END) AS DOUBLE) AS rushing_tds,
  CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS DOUBLE) AS receptions,
  CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity * 2 ELSE 0 END) AS DOUBLE) AS receiving_yards,
  CAST(sum(CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) AS DOUBLE) AS receiving_tds,
  CAST(sum(CASE WHEN l_tax >= 0.075 THEN 1 ELSE 0 END) AS DOUBLE) AS fumbles_lost,
  CAST(sum(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) AS DOUBLE) AS targets,
  CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS DOUBLE) AS carries,
  CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS DOUBLE) AS attempts
FROM (SELECT *, year(l_shipdate) AS season, CAST(floor((dayofyear(l_shipdate) + 6) / 7) AS INT) AS week FROM {lineitem}) x
WHERE week <= 22 GROUP BY l_suppkey, season, week"""

#: Expected values: what a line's discount-free price would make of each weekly line; ids and keys typed as upstream has them.
EXPECTED = """
SELECT l_suppkey AS player_id, CAST(season AS VARCHAR(4)) AS season, CAST(week AS DOUBLE) AS week,
  CAST(sum(l_quantity * 2 + l_linenumber) AS DOUBLE) AS yards_exp, CAST(sum(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) AS DOUBLE) AS td_exp,
  CAST(sum(CASE WHEN l_linenumber <= 2 THEN 1 ELSE 0 END) AS DOUBLE) AS receptions_exp
FROM (SELECT *, year(l_shipdate) AS season, CAST(floor((dayofyear(l_shipdate) + 6) / 7) AS INT) AS week FROM {lineitem}) x
WHERE week <= 18 AND l_partkey % 5 <> 0 GROUP BY l_suppkey, season, week"""

#: Players: suppliers, with a birth date and a draft round from their keys.
PLAYERS = """
SELECT s_suppkey AS player_id, s_name AS name,
  CASE s_suppkey % 20 WHEN 18 THEN 'K' WHEN 19 THEN 'DEF' ELSE
    CASE s_suppkey % 4 WHEN 0 THEN 'WR' WHEN 1 THEN 'RB' WHEN 2 THEN 'TE' ELSE 'QB' END END AS position,
  concat('T', CAST((s_suppkey * 7 + 2001) % 16 AS VARCHAR(4))) AS team,
  date_add(DATE '1966-01-01', CAST(s_suppkey * 37 % 5000 AS INT)) AS birth_date,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(1 + s_suppkey % 7 AS INT) END AS draft_round,
  s_suppkey % 13 = 0 AS is_rookie
FROM {supplier}"""

#: A pool to be drafted: parts, in leagues of 400 by key, so that leagues grow with the table, with points a game, games and an average draft position.
POOL = """
SELECT CAST(floor(p_partkey / 400) AS INT) AS league_id, p_partkey AS player_id,
  CASE p_partkey % 12 WHEN 0 THEN 'QB' WHEN 1 THEN 'K' WHEN 2 THEN 'DEF' WHEN 3 THEN 'TE' WHEN 4 THEN 'TE' WHEN 5 THEN 'RB' WHEN 6 THEN 'RB'
    WHEN 7 THEN 'RB' WHEN 8 THEN 'QB' ELSE 'WR' END AS position,
  concat('T', CAST(p_partkey % 16 AS VARCHAR(4))) AS team,
  round(CAST(p_partkey * 7919 % 2003 AS DOUBLE) / 50, 2) AS ppg, CAST(17 - p_partkey % 5 AS DOUBLE) AS e_games,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE round(CAST(p_partkey * 104729 % 3001 AS DOUBLE) / 12 + 1, 1) END AS adp,
  CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE round(1 + CAST(p_partkey % 17 AS DOUBLE) / 3, 3) END AS sd_adp, CAST(p_partkey * 31 % 997 AS DOUBLE) / 60 AS weekly_sd
FROM {part}"""

_TABLES = {"weekly": (WEEKLY, ["lineitem"]), "expected": (EXPECTED, ["lineitem"]), "players": (PLAYERS, ["supplier"]), "pool": (POOL, ["part"])}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, tables = _TABLES[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def ctes(*names: str) -> str:
    """The bindings as common table expressions, for DuckDB."""
    parts = []
    for name in names:
        sql, tables = _TABLES[name]
        sql = sql.format(**{t: t for t in tables})
        sql = sql.replace("date_add(DATE '1966-01-01', CAST(s_suppkey * 37 % 5000 AS INT))", "DATE '1966-01-01' + CAST(s_suppkey * 37 % 5000 AS INT)")
        parts.append(f"{name} AS ({sql})")
    return ", ".join(parts)
