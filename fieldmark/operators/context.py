"""Curated team context, and gates on what was read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def problems(rows: DataFrame, name: str, key: str, known: DataFrame, expected: int, enums: dict[str, Sequence[str]] | None = None, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(table, key, problem) of a curated table: count, unknown and repeated keys, missing provenance, values out of bounds."""
    say = lambda df, text: df.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"), F.lit(text).alias("problem"))
    found = [
        rows.groupBy().agg(F.count("*").alias("n")).filter(F.col("n") != expected).select(F.lit(name).alias("table"), F.lit(None).cast("string").alias("key"), F.lit("row count").alias("problem")),
        say(rows.join(known, key, "left_anti"), "unknown key"),
        say(rows.groupBy(key).count().filter("count > 1"), "repeated key"),
        say(rows.filter(F.coalesce(F.trim("source_url"), F.lit("")) == ""), "no source"),
        say(rows.filter(F.col("last_checked").isNull()), "no date"),
    ]
    found += [say(rows.filter(F.col(c).isNotNull() & ~F.col(c).isin(*v)), f"{c} not allowed") for c, v in (enums or {}).items()]
    found += [say(rows.filter(~F.col(c).between(*v)), f"{c} out of range") for c, v in (ranges or {}).items()]
    return reduce(lambda a, b: a.unionByName(b), found)


def merge(parts: Sequence[tuple[str, DataFrame, Sequence[str]]], key: str, today: Column, stale_days: int = 7) -> DataFrame:
    """Curated tables side by side, with maps of their sources, the oldest check, and a warning where they are stale or unsure."""
    out = None
    for name, df, columns in parts:
        one = df.select(key, *columns, F.col("source_url").alias(f"_{name}_url"), F.col("last_checked").alias(f"_{name}_at"), F.col("confidence").alias(f"_{name}_sure"))
        out = one if out is None else out.join(one, key, "full")
    names = [n for n, _, _ in parts]
    sources = F.map_filter(F.create_map(*[c for n in names for c in (F.lit(n), F.col(f"_{n}_url"))]), lambda _, v: v.isNotNull())
    warn = []
    for n in names:
        old = F.datediff(today, F.col(f"_{n}_at"))
        warn.append(F.when(old > stale_days, F.concat(F.lit(f"{n} checked "), old.cast("string"), F.lit(" days ago"))))
        warn.append(F.when(F.col(f"_{n}_sure") == "low", F.lit(f"{n} unsure")))
    checked = [F.col(f"_{n}_at") for n in names]
    oldest = F.least(*checked) if len(checked) > 1 else checked[0]
    columns = [c for _, _, cs in parts for c in cs]
    return out.select(key, *columns, sources.alias("sources"), oldest.alias("oldest_check"), F.concat_ws("; ", *warn).alias("warning"))


def week_coverage(lines: DataFrame, teams: int, weeks: int = 18) -> DataFrame:
    """Per season: regular weeks and teams, weeks that lack a team, weeks and rows after the regular season, all rows, and
    whether the season passes the gate: exactly the weeks from 1 to ``weeks``, and ``teams`` teams."""
    reg, post = F.col("season_type") == "REG", F.col("season_type") == "POST"
    listed = lambda when: F.array_sort(F.collect_set(F.when(when, F.col("week"))))
    per_week = lines.filter(reg).groupBy("season", "week").agg(F.countDistinct("team").alias("n"))
    thin = per_week.groupBy("season").agg(F.min("n").alias("least_teams"), F.count_if(F.col("n") < teams).alias("thin_weeks"))
    out = lines.groupBy("season").agg(
        listed(reg).alias("reg_weeks"), F.count_distinct(F.when(reg, F.col("team"))).alias("reg_teams"), F.count_if(post).alias("post_rows"), listed(post).alias("post_weeks"), F.count("*").alias("rows"),
    ).join(thin, "season", "left")
    whole = F.array(*[F.lit(w) for w in range(1, weeks + 1)])
    return out.withColumn("complete", (F.col("reg_weeks").cast("array<int>") == whole) & (F.col("reg_teams") == teams))


def status_histogram(roster: DataFrame) -> DataFrame:
    """Rows of each state and code, nulls too, the commonest first."""
    return roster.groupBy("status", "code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status", "code")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each table and season."""
    parts = [d.groupBy("season").agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "season", "rows") for n, d in tables.items()]
    return reduce(lambda x, y: x.unionByName(y), parts)


def stale_sources(served: DataFrame, manifest: DataFrame) -> DataFrame:
    """Served snapshots for whose endpoint a newer good one was fetched."""
    good = manifest.filter("status = 'ok'").select(F.col("source").alias("_s"), F.col("endpoint").alias("_e"), F.col("fetched_at").alias("_at"))
    newest = good.groupBy("_s", "_e").agg(F.max("_at").alias("_at"))
    return served.join(newest, (F.col("source") == F.col("_s")) & (F.col("endpoint") == F.col("_e")) & (F.col("_at") > F.col("fetched_at")), "left_semi")


def run_gates(correlation: DataFrame, ranked: DataFrame, bullets: DataFrame, floor: float = 0.8, first: int = 100, least: int = 3) -> DataFrame:
    """Per league: whether the board agrees enough with the market, and how many of its first players lack reasons."""
    n = bullets.groupBy("league_id", "player_id").agg(F.count("*").alias("n"))
    thin = ranked.filter(F.col("overall_rank") <= first).join(n, ["league_id", "player_id"], "left").groupBy("league_id").agg(F.count_if(F.coalesce("n", F.lit(0)) < least).alias("thin"))
    return correlation.join(thin, "league_id", "full").select("league_id", F.coalesce(F.col("spearman") >= floor, F.lit(False)).alias("agrees"), F.coalesce("thin", F.lit(0)).alias("thin"))


def serving_run(runs: DataFrame) -> DataFrame:
    """The run that each league serves: the frozen one, else the newest."""
    w = Window.partitionBy("league_id").orderBy(F.desc("is_frozen"), F.desc("started_at"), F.desc("run_id"))
    return runs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
