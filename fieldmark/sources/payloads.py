"""Nested payloads of the market's sources, flattened with JSON functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions that are kept, states that keep a player without a team, and the mark of no draft position.
POSITIONS = ("QB", "RB", "WR", "TE", "K", "DEF")
STATES = ("Active", "Injured Reserve", "PUP")
NO_ADP = 999.0

PROJECTION = "player_id string, season string, week int, player struct<first_name:string,last_name:string,position:string,team:string>, stats map<string,double>"
MASTER = "map<string, struct<full_name:string,position:string,team:string,status:string,espn_id:string,birth_date:string,metadata:map<string,string>>>"
ADP = "struct<status:string,meta:struct<type:string,teams:int,rounds:int>,players:array<struct<player_id:long,name:string,position:string,team:string,adp:double,stdev:double,bye:int>>>"
PAGE = "struct<players:map<string,array<map<string,string>>>>"


def projections(raw: DataFrame, column: str = "json") -> DataFrame:
    """Season projections: ``stats`` split to ``stat`` and ``adp`` maps, positions of 999 as unknown, and whether there is
    any counting stat. Rows of a single week are refused; see :func:`weekly_rows`."""
    r = raw.select(F.from_json(column, PROJECTION).alias("r"), F.col(column).alias("raw")).select("r.*", "raw").filter(F.col("week").isNull() & F.col("player.position").isin(*POSITIONS))
    adp = F.map_filter("stats", lambda k, _: k.startswith("adp_"))
    stat = F.map_filter("stats", lambda k, _: ~k.startswith("adp_"))
    return r.select(
        "player_id", "season", F.concat_ws(" ", "player.first_name", "player.last_name").alias("name"), F.col("player.position").alias("position"), F.col("player.team").alias("team"),
        F.transform_keys(stat, lambda k, _: F.concat(F.lit("stat_"), k)).alias("stats"), F.transform_values(adp, lambda _, v: F.when(v < NO_ADP, v)).alias("adps"),
        F.exists(F.map_keys(stat), lambda k: ~k.startswith("pts_")).alias("has_projection"), "raw",
    )


def weekly_rows(raw: DataFrame, column: str = "json") -> DataFrame:
    return raw.filter(F.get_json_object(column, "$.week").isNotNull())


def master(raw: DataFrame, column: str = "json") -> DataFrame:
    """The player master, keyed by id: wanted positions, with a team or in a state that counts; what is nested as JSON."""
    p = raw.select(F.explode(F.from_json(column, MASTER)).alias("player_id", "p")).select("player_id", "p.*")
    keep = F.col("position").isin(*POSITIONS) & (F.col("team").isNotNull() | F.col("status").isin(*STATES))
    return p.filter(keep).withColumn("metadata", F.to_json("metadata"))


def ranking_page(raw: DataFrame, column: str = "json") -> DataFrame:
    """Players of a page whose rows are lists of single-key maps under numbered keys; ``-``, blank and false as null."""
    page = raw.select(*[c for c in raw.columns if c != column], F.explode(F.from_json(column, PAGE)["players"]).alias("index", "parts"))
    merged = F.aggregate("parts", F.create_map().cast("map<string,string>"), lambda a, b: F.map_concat(a, F.map_filter(b, lambda k, _: ~F.array_contains(F.map_keys(a), k))))
    value = lambda m, k: F.nullif(F.nullif(F.nullif(F.trim(m[k]), F.lit("-")), F.lit("")), F.lit("false"))
    out = page.withColumn("m", merged).withColumn("index", F.expr("try_cast(index AS INT)")).filter(F.col("index").isNotNull())
    number = lambda k: value(F.col("m"), k).try_cast("double")
    rest = [c for c in raw.columns if c != column]
    return out.select(*rest, "index", value(F.col("m"), "player_id").alias("player_id"), value(F.col("m"), "name").alias("name"), number("average_pick").alias("average_pick"), number("percent_drafted").alias("percent_drafted"))


def adp_payload(raw: DataFrame, teams: int, column: str = "json") -> DataFrame:
    """Players of a draft-position payload with its meta data, of the wanted league size."""
    p = raw.select(F.from_json(column, ADP).alias("p")).filter((F.col("p.meta.teams") == teams) & (F.size("p.players") > 0))
    return p.select(F.explode("p.players").alias("x"), F.col("p.meta.type").alias("format"), F.col("p.meta.teams").alias("teams")).select("x.*", "format", "teams")


def adp_faults(raw: DataFrame, teams: int, column: str = "json") -> DataFrame:
    """Payloads that are empty or of another league size, with the reason."""
    p = raw.select("*", F.from_json(column, ADP).alias("_p"))
    why: Column = F.when(F.coalesce(F.size("_p.players"), F.lit(0)) <= 0, "empty").when(F.coalesce(F.col("_p.meta.teams"), F.lit(-1)) != teams, "league size")
    return p.withColumn("fault", why).filter(F.col("fault").isNotNull()).drop("_p")
