"""Market consensus: several sources' ranks and draft positions, side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.functions.columns import mean_of, sample_std
from fieldmark.sources.settled import settle

SCHEMA = "player_id long, source string, rank double, adp double, std double"
#: Rows for a fit of deviation on draft position, and the line used with fewer; rows for a position's fit.
LEAST_ROWS, DEFAULT_LINE, LEAST_BY_POSITION = 20, (1.0, 0.10), 10


def collect(sources: Sequence[tuple[str, DataFrame]], sentinel: float = 999.0) -> DataFrame:
    """All sources as long rows; draft positions from ``sentinel`` on are unknown, and a source's rank follows its order.

    Sources without usable rows add nothing. Ranks are numbered within a source and league, by ``order``."""
    return _ranked([_usable(name, df, sentinel) for name, df in sources])


def _usable(name: str, df: DataFrame, sentinel: float) -> DataFrame:
    adp = F.when(F.col("adp") < sentinel, F.col("adp")).cast("double") if "adp" in df.columns else F.lit(None).cast("double")
    std = F.col("std").cast("double") if "std" in df.columns else F.lit(None).cast("double")
    return df.select("league_id", "player_id", F.lit(name).alias("source"), adp.alias("adp"), std.alias("std"), F.col("order").cast("double").alias("order")).filter("order is not null")


def _ranked(parts: Sequence[DataFrame]) -> DataFrame:
    w = Window.partitionBy("league_id", "source").orderBy("order", "player_id")
    return reduce(lambda x, y: x.unionByName(y), parts).withColumn("rank", F.row_number().over(w).cast("double")).drop("order")


#: Makes a source's rows when it is asked for them.
Fetch = Callable[[], DataFrame]


def collect_each(spark: SparkSession, sources: Sequence[tuple[str, Fetch]], sentinel: float = 999.0) -> tuple[DataFrame, DataFrame]:
    """(:func:`collect` of the sources that can be read, what is wrong with the others: source, problem).

    Each source is read and written on its own, so one that fails, while it is planned or while it runs, costs its own rows
    alone; a source without usable rows is a problem too. With no good source the rows are empty."""
    good, bad = [], []
    for name, fetch in sources:
        try:
            rows = settle(_usable(name, fetch(), sentinel), name)
        except (PySparkException, ValueError, KeyError) as e:
            bad.append((name, f"{type(e).__name__}: {str(e).splitlines()[0][:200]}" if str(e) else type(e).__name__))
            continue
        if rows.isEmpty():
            bad.append((name, "no rows"))
        else:
            good.append(rows)
    none = spark.createDataFrame([], "league_id int, player_id long, source string, adp double, std double, order double")
    return _ranked(good or [none]), spark.createDataFrame(bad, "source string, problem string")


def deviation_line(rows: DataFrame, keys: Sequence[str] = ("league_id",), x: str = "adp", y: str = "std", least: int = LEAST_ROWS) -> DataFrame:
    """Intercept ``a`` and slope ``b`` of y on x for each key; the default line where rows are too few."""
    fit = rows.groupBy(*keys).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))
    enough = (F.col("n") >= least) & F.col("b").isNotNull()
    return fit.select(*keys, F.when(enough, F.col("a")).otherwise(DEFAULT_LINE[0]).alias("a"), F.when(enough, F.col("b")).otherwise(DEFAULT_LINE[1]).alias("b"), "n")


def composite(long: DataFrame, positions: DataFrame, names: Sequence[str], adp_names: Sequence[str], expert: str) -> DataFrame:
    """One row a league and player: mean rank over sources, their number and deviation, mean draft position, how much
    experts disagree beyond what is usual at that rank and position, and a deviation of the draft position."""
    wide = long.groupBy("league_id", "player_id").pivot("source", list(names)).agg(F.first("rank").alias("rank"), F.first("adp").alias("adp"), F.first("std").alias("std"))
    ranks = [F.col(f"{n}_rank") for n in names]
    adps = [F.col(f"{n}_adp") for n in adp_names]
    wide = wide.withColumns({
        "composite_rank": F.round(mean_of(ranks), 2), "n_sources": sum([r.isNotNull().cast("int") for r in ranks[1:]], ranks[0].isNotNull().cast("int")),
        "composite_std": sample_std(ranks), "composite_adp": F.round(mean_of(adps), 2),
    }).join(positions, "player_id")
    experts = deviation_line(wide.filter(F.col(f"{expert}_std").isNotNull()), ["league_id", "position"], f"{expert}_rank", f"{expert}_std", LEAST_BY_POSITION)
    experts = experts.select("league_id", "position", F.when(F.col("n") >= LEAST_BY_POSITION, F.col("a")).alias("ea"), F.when(F.col("n") >= LEAST_BY_POSITION, F.col("b")).alias("eb"))
    room = deviation_line(wide.select("league_id", F.coalesce(*adps).alias("adp"), F.coalesce(*[F.col(f"{n}_std") for n in adp_names]).alias("std")))
    out = wide.join(experts, ["league_id", "position"], "left").join(room.select("league_id", "a", "b"), "league_id", "left")
    own = F.coalesce(*[F.col(f"{n}_std") for n in adp_names])
    fitted = F.greatest(F.lit(1.0), F.col("a") + F.col("b") * F.col("composite_adp"))
    return out.withColumns({
        "disagreement": F.round(F.col(f"{expert}_std") - (F.col("ea") + F.col("eb") * F.col(f"{expert}_rank")), 3),
        "sd_adp": F.round(F.coalesce(own, fitted), 3), "sd_source": F.when(own.isNotNull(), "source").otherwise("fit"),
    })


def depth_gate(c: DataFrame, adp_names: Sequence[str], first: int = 150, second: int = 200) -> DataFrame:
    """Whether the first players by composite rank have enough draft positions behind them and a disagreement."""
    n = sum([F.col(f"{a}_adp").isNotNull().cast("int") for a in adp_names[1:]], F.col(f"{adp_names[0]}_adp").isNotNull().cast("int"))
    w = Window.partitionBy("league_id").orderBy(F.asc_nulls_last("composite_rank"), "player_id")
    r = c.withColumns({"_r": F.row_number().over(w), "_n": n})
    return r.filter(F.col("_r") <= second).groupBy("league_id").agg(
        F.count_if((F.col("_r") <= first) & (F.col("_n") < 2)).alias("thin_first"), F.count_if(F.col("_n") < 1).alias("thin_second"),
        F.count_if((F.col("_r") <= first) & F.col("disagreement").isNull()).alias("no_disagreement"),
    )


def page_summary(pages: DataFrame, overall: str, n: int = 10) -> DataFrame:
    """Page kinds, the overall page's first names, and the latest date."""
    first = F.filter(F.array_sort(F.collect_list(F.when((F.col("page_type") == overall) & (F.col("rank") <= n), F.struct("rank", "player")))), lambda x: x.isNotNull())
    return pages.groupBy().agg(F.array_sort(F.collect_set("page_type")).alias("page_types"), first["player"].alias("first"), F.max("scrape_date").alias("latest"))


def nearest_quantile(rows: DataFrame, keys: Sequence[str], column: str, q: float) -> DataFrame:
    """The value whose rank is nearest to the quantile's place, per key, as one of the values."""
    w = Window.partitionBy(*keys)
    r = rows.filter(F.col(column).isNotNull()).withColumns({"_r": F.row_number().over(w.orderBy(column)), "_n": F.count("*").over(w)})
    place: Column = F.floor(q * (F.col("_n") - 1) + 0.5) + 1
    return r.filter(F.col("_r") == place).select(*keys, F.col(column).alias("cut"), F.col("_n").alias("n"))
