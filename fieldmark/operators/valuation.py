"""What a player is worth in a league: baselines, value, ranks, tiers, gaps and odds of being there.

Every window is within a league or a league's position, so leagues spread over
tasks; one league's pool is a draft's size and fits a task by its nature.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fieldmark.functions.columns import before, free_name, normal_cdf, running, zero
from fieldmark.functions.ranking import tie_ranks
from fieldmark.sources.settled import settle
from fieldmark.operators.market import nearest_quantile

#: Starters of a lineup by position, flexible places and who may fill them, bench, and its share by position.
SLOTS = {"QB": 1, "WR": 3, "RB": 2, "TE": 1, "K": 1, "DEF": 1}
FLEX, FLEX_POSITIONS, BENCH = 1, ("RB", "WR", "TE"), 6
BENCH_SHARE = {"QB": 0.10, "RB": 0.25, "WR": 0.35, "TE": 0.10}
NO_VALUE = ("K", "DEF")
ROUNDS = sum(SLOTS.values()) + FLEX + BENCH


def _of(position: Column, table: Mapping, other=0) -> Column:
    out = F.when(F.lit(False), F.lit(other))
    for p, v in table.items():
        out = out.when(position == p, F.lit(v))
    return out.otherwise(F.lit(other))


def blend(vendor: Column, own: Column, is_rookie: Column, bonus: Column, weight: float = 0.7, rookie_weight: float = 0.9) -> Column:
    """Vendor and own points a game mixed, the vendor's alone where there is no own one, and the bonus rate on top."""
    w = F.when(F.coalesce(is_rookie, F.lit(False)), rookie_weight).otherwise(weight)
    return F.when(own.isNull(), vendor).when(vendor.isNull(), own).otherwise(w * vendor + (1 - w) * own) + zero(bonus)


def draft_depth(pool: DataFrame, first: int) -> DataFrame:
    """How many of each position are among the league's first ``first`` players by draft position."""
    w = Window.partitionBy("league_id").orderBy(F.asc_nulls_last("adp"), "player_id")
    return pool.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= first).groupBy("league_id", "position").agg(F.count("*").alias("n"))


def baselines(pool: DataFrame, teams: int, keepers: DataFrame | None = None) -> DataFrame:
    """Replacement points a game by league and position, for the worst starter (vols) and the last bench player (vorp).

    Places for flexible starters go to the best players beyond each position's own starters, ties to the later
    position; kept players come off the demand. 0 where the pool is too short."""
    spots = pool.select("league_id").distinct().withColumn("position", F.explode(F.array(*[F.lit(p) for p in SLOTS])))
    if keepers is not None:
        spots = spots.join(keepers.groupBy("league_id", "position").agg(F.count("*").alias("kept")), ["league_id", "position"], "left")
    spots = spots.withColumn("kept", zero("kept") if keepers is not None else F.lit(0)).withColumn("starters", teams * _of(F.col("position"), SLOTS))
    w = Window.partitionBy("league_id", "position").orderBy(F.desc("ppg"), "player_id")
    ranked = pool.select("league_id", "position", "player_id", "ppg").withColumn("n", F.row_number().over(w))
    beyond = ranked.join(spots, ["league_id", "position"]).filter(F.col("position").isin(*FLEX_POSITIONS) & (F.col("n") > F.greatest(F.lit(0), F.col("starters") - F.col("kept"))))
    best = Window.partitionBy("league_id").orderBy(F.desc("ppg"), F.desc("position"), "player_id")
    flex = beyond.withColumn("f", F.row_number().over(best)).filter(F.col("f") <= teams * FLEX).groupBy("league_id", "position").agg(F.count("*").alias("flex"))
    at = spots.join(flex, ["league_id", "position"], "left")
    at = at.withColumn("vols_rank", F.greatest(F.lit(1), F.col("starters") + zero("flex") - F.col("kept")))
    at = at.withColumn("vorp_rank", F.col("vols_rank") + F.bround(teams * BENCH * _of(F.col("position"), BENCH_SHARE, 0.0)).cast("int"))
    both = at.join(ranked, ["league_id", "position"], "left").groupBy("league_id", "position", "vols_rank", "vorp_rank").agg(
        zero(F.max(F.when(F.col("n") == F.col("vols_rank"), F.col("ppg")))).alias("vols_ppg"), zero(F.max(F.when(F.col("n") == F.col("vorp_rank"), F.col("ppg")))).alias("vorp_ppg")
    )
    return both


def values(pool: DataFrame, base: DataFrame, games: int = 17) -> DataFrame:
    """Season value with replacement for games missed, value over replacement, and the gap to the worst starter."""
    none = F.col("position").isin(*NO_VALUE)
    out = pool.join(base.select("league_id", "position", "vols_ppg", "vorp_ppg"), ["league_id", "position"], "left")
    season = F.col("e_games") * F.col("ppg") + (games - F.col("e_games")) * zero("vorp_ppg")
    return out.withColumns({
        "season_value": F.when(none, 0.0).otherwise(F.round(season, 3)), "vorp": F.when(none, 0.0).otherwise(F.round(season - games * zero("vorp_ppg"), 3)),
        "vols": F.when(none, 0.0).otherwise(F.round(F.col("ppg") - zero("vols_ppg"), 3)),
    })


def ranks(valued: DataFrame) -> DataFrame:
    """Overall and positional rank by value, then draft position, unknown ones last."""
    order = [F.desc("vorp"), F.asc_nulls_last("adp"), F.asc("player_id")]
    return valued.withColumns({
        "overall_rank": F.row_number().over(Window.partitionBy("league_id").orderBy(*order)),
        "pos_rank": F.row_number().over(Window.partitionBy("league_id", "position").orderBy(*order)),
    })


def value_tiers(ranked: DataFrame, share: float = 0.5, default_sd: float = 5.0) -> DataFrame:
    """A new tier where points a game drop by ``share`` of the position's median weekly deviation."""
    by = ["league_id", "position"]
    sd = ranked.groupBy(*by).agg(F.percentile("weekly_sd", F.lit(0.5)).alias("_sd"))
    w = Window.partitionBy(*by).orderBy(F.desc("ppg"), "player_id")
    drop = F.coalesce((F.lag("ppg").over(w) - F.col("ppg") >= share * F.coalesce("_sd", F.lit(default_sd))).cast("int"), F.lit(0))
    return ranked.join(sd, by, "left").withColumn("_drop", drop).withColumn("value_tier", 1 + F.sum("_drop").over(running(w))).drop("_sd", "_drop")


#: Where the first means of a mixture's starts lie within its k parts, and how many steps each start takes.
STARTS, STEPS = (0.5, 0.25, 0.75), 50


def _fitted(x: np.ndarray, k: int, start: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Likelihood, means and component of each value after EM from one start; ``x`` is sorted."""
    mean = np.quantile(x, (np.arange(k) + start) / k)
    var, weight = np.full(k, max(x.var() / k**2, 1e-6)), np.full(k, 1 / k)
    for step in range(STEPS + 1):
        log = np.log(weight) - 0.5 * np.log(2 * np.pi * var) - (x[:, None] - mean) ** 2 / (2 * var)
        top = log.max(1, keepdims=True)
        p = np.exp(log - top)
        total = p.sum(1, keepdims=True)
        if step == STEPS:
            break
        p /= total
        n = p.sum(0) + 1e-12
        mean = (p * x[:, None]).sum(0) / n
        var, weight = np.maximum((p * x[:, None] ** 2).sum(0) / n - mean**2, 0) + 1e-6, n / n.sum()
    return float((top[:, 0] + np.log(total[:, 0])).sum()), mean, log.argmax(1)


def mixture_tiers(x: np.ndarray, k: int) -> np.ndarray:
    """Component of each value in a one-dimensional Gaussian mixture, numbered from the lowest mean: the likeliest of three
    starts, the first of those equal to six digits. ``x`` is sorted; with fewer different values there are fewer components."""
    x = np.asarray(x, float)
    k = min(k, len(np.unique(x)))
    if k <= 1:
        return np.ones(len(x), int)
    fits = [_fitted(x, k, s) for s in STARTS]
    _, mean, component = max(fits, key=lambda f: round(f[0], 6))
    return np.argsort(np.argsort(mean, kind="stable"), kind="stable")[component] + 1


def consensus_tiers(pool: DataFrame, k: Mapping[str, int], window: int = 60) -> DataFrame:
    """Tiers of each league's position from a mixture over its first ``window`` consensus ranks, made non-decreasing
    down the ranks; later players are one tier below the last."""
    schema = "league_id long, player_id long, position string, tier int"

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("n")
        tier = np.maximum.accumulate(_dense(mixture_tiers(g["composite_rank"].to_numpy(), k.get(g["position"].iloc[0], 8))))
        return g.assign(tier=tier)[["league_id", "player_id", "position", "tier"]]

    w = Window.partitionBy("league_id", "position").orderBy("composite_rank", "player_id")
    known = pool.select(F.col("league_id").cast("long").alias("league_id"), F.col("player_id").cast("long").alias("player_id"), "position", "composite_rank").filter("composite_rank is not null")
    known = known.withColumn("n", F.row_number().over(w))
    # Python sees a window's ranks of each group; the rest need only its last tier.
    tiers = settle(known.filter(F.col("n") <= window).groupBy("league_id", "position").applyInPandas(fit, schema), "tiers")
    last = tiers.groupBy(F.col("league_id").alias("_l"), F.col("position").alias("_p")).agg((F.max("tier") + 1).alias("tier"))
    rest = known.filter(F.col("n") > window).join(last, F.col("league_id").eqNullSafe(F.col("_l")) & F.col("position").eqNullSafe(F.col("_p")))
    return tiers.unionByName(rest.select("league_id", "player_id", "position", "tier"))


def _dense(tiers: np.ndarray) -> np.ndarray:
    return np.unique(tiers, return_inverse=True)[1] + 1


def room_gaps(ranked: DataFrame) -> DataFrame:
    """Where the room takes each player among those not kept, where we would, and the gap in deviations (1 at least, 10 if unknown)."""
    free = ranked.filter(~F.coalesce(F.col("kept"), F.lit(False)) & F.col("adp").isNotNull())
    league = Window.partitionBy("league_id")
    pos = Window.partitionBy("league_id", "position")
    room = free.withColumns({
        "room_adp": F.row_number().over(league.orderBy("adp", "player_id")), "our_pick": F.row_number().over(league.orderBy("overall_rank")),
        "_room_pos": F.row_number().over(pos.orderBy("adp", "player_id")), "_our_pos": F.row_number().over(pos.orderBy("overall_rank")),
    })
    gap = F.col("room_adp") - F.col("our_pick")
    out = room.select("league_id", "player_id", "room_adp", "our_pick", gap.alias("gap"), F.round(gap / F.greatest(F.coalesce("sd_adp", F.lit(10.0)), F.lit(1.0)), 3).alias("gap_z"), (F.col("_room_pos") - F.col("_our_pos")).alias("pos_gap"))
    return ranked.join(out, ["league_id", "player_id"], "left")


def p_available(pick: Column, adp: Column, sd: Column) -> Column:
    """Chance that a player is still there at ``pick``; sure if nobody is known to take him."""
    z = (pick - adp) / F.greatest(F.coalesce(sd, F.lit(1.0)), F.lit(1.0))
    return F.when(adp.isNull(), 1.0).otherwise(1 - normal_cdf(z))


def expected_best(candidates: DataFrame, keys: list[str], value: str = "value", p: str = "p") -> DataFrame:
    """Expected value of the best one there, per key: each counts if he is there and no better one is."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), "player_id")
    none_better = F.coalesce(F.product(1 - F.col(p)).over(before(w)), F.lit(1.0))
    return candidates.withColumn("_e", F.col(value) * F.col(p) * none_better).groupBy(*keys).agg(F.sum("_e").alias("expected_best"))


#: Candidates of a group that a task takes at once.
ONE_RUN = 100_000


def leave_one_out(candidates: DataFrame, keys: list[str], value: str = "value", p: str = "p", one_run: int = ONE_RUN) -> DataFrame:
    """``candidates`` with ``others_best``: the expected best of all others of their group, by value and then player_id.

    A candidate maps what is expected after him, E, to ``v p + (1 - p) E``, and such maps compose: of a run of candidates to
    ``b + a E``.  A group of up to ``one_run`` candidates is one run.  Larger ones are cut into runs by range partitions, so
    they spread over tasks; each run gives its (a, b), a few rows a group are scanned from both ends, and each run is
    finished with what comes before and after it.  Nothing is divided out, so candidates who are surely there do no harm.
    Null values or chances are not allowed."""
    large = candidates.groupBy(*[F.col(k).alias(f"_large_{i}") for i, k in enumerate(keys)]).count().filter(F.col("count") > one_run).drop("count")
    large = settle(large, "large_groups")
    if large.isEmpty():
        return _finished_runs(candidates, keys, value, p, None)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_large_{i}")) for i, k in enumerate(keys)])
    some = candidates.join(F.broadcast(large), same, "left_semi")  # a row for every ``one_run`` rows at most
    return _finished_runs(candidates.join(F.broadcast(large), same, "left_anti"), keys, value, p, None).unionByName(_in_runs(some, keys, value, p))


def _in_runs(candidates: DataFrame, keys: list[str], value: str, p: str) -> DataFrame:
    """Leave-one-out of large groups, run by run."""
    kind, names = candidates.schema, candidates.columns
    marks = [free_name(names, c) for c in ("run", "a", "b", "none_before", "best_before", "best_after")]
    run_, a_, b_, none_, before_, after_ = marks
    order = [*keys, F.desc(value), "player_id"]
    dealt = candidates.repartitionByRange(*order).withColumn(run_, F.spark_partition_id())
    dealt = settle(dealt, "runs")  # the partition is part of the key from here on
    # The map of a run: its rows are few enough for one partition, which is what they came from.
    ordered = dealt.repartition(*keys, run_).sortWithinPartitions(*keys, run_, F.desc(value), "player_id")
    where = {c: i for i, c in enumerate([*names, run_])}
    by = [where[c] for c in (*keys, run_)]

    def runs_of(batches: Iterator[pa.RecordBatch], columns: list[int]) -> Iterator[tuple[tuple, list[list], bool]]:
        """(key, columns, whether the run ends there) of sorted rows, batch by batch."""
        held = None
        for batch in batches:
            got = [batch.column(i).to_pylist() for i in columns]
            key = list(zip(*(batch.column(i).to_pylist() for i in by)))
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            for s, z in zip(cuts, cuts[1:]):
                if held is not None:
                    yield *held, held[0] != key[s]
                held = key[s], [g[s:z] for g in got]
        if held is not None:
            yield *held, True

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, a, b = [], 1.0, 0.0
        for key, (v, p_), ends in runs_of(batches, [where[value], where[p]]):
            for x, y in zip(v, p_):
                b, a = b + a * x * y, a * (1 - y)
            if ends:
                out.append((*key, a, b))
                a, b = 1.0, 0.0
        columns = list(zip(*out)) or [()] * (len(keys) + 3)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, few_arrow)], schema=few_arrow)

    few = T.StructType([*(kind[k] for k in keys), T.StructField(run_, T.IntegerType()), T.StructField(a_, T.DoubleType()), T.StructField(b_, T.DoubleType())])
    few_arrow = to_arrow_schema(few)
    each = settle(ordered.mapInArrow(mapped, few), "run_maps")
    # Runs of a group are as many as the partitions that it spans.
    listed = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(run_, a_, b_))).alias("_runs"))
    start = F.struct(F.lit(1.0).alias(none_), F.lit(0.0).alias(before_))
    ahead = lambda upto: F.aggregate(upto, start, lambda s, r: F.struct((s[none_] * r[a_]).alias(none_), (s[before_] + s[none_] * r[b_]).alias(before_)))
    behind = lambda rest: F.aggregate(F.reverse(rest), F.lit(0.0), lambda e, r: r[b_] + r[a_] * e)
    n = F.size("_runs")
    scanned = F.transform("_runs", lambda r, i: F.struct(r[run_].alias(run_), ahead(F.slice("_runs", F.lit(1), i)).alias("s"), behind(F.slice("_runs", i + 2, n)).alias(after_)))
    ends_ = listed.select(*keys, F.explode(scanned).alias("_r")).select(*keys, f"_r.{run_}", f"_r.s.{none_}", f"_r.s.{before_}", f"_r.{after_}")
    ends_ = ends_.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(run_).alias("_run"), none_, before_, after_)
    both = dealt.join(ends_, [*(dealt[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), dealt[run_] == F.col("_run")])
    return _finished_runs(both.select(*names, run_, none_, before_, after_), keys, value, p, marks)


def _finished_runs(rows: DataFrame, keys: list[str], value: str, p: str, marks: list[str] | None) -> DataFrame:
    """Each run with what comes before and after it, in ``marks``; without them a group is one run and nothing does."""
    if marks is None:
        marks = [free_name(rows.columns, c) for c in ("run", "a", "b", "none_before", "best_before", "best_after")]
        names = rows.columns
        rows = rows.select(*names, F.lit(0).alias(marks[0]), F.lit(1.0).alias(marks[3]), F.lit(0.0).alias(marks[4]), F.lit(0.0).alias(marks[5]))
    else:
        names = [c for c in rows.columns if c not in marks]
    run_, _, _, none_, before_, after_ = marks
    both = rows.repartition(*keys, run_).sortWithinPartitions(*keys, run_, F.desc(value), "player_id")
    at = {c: i for i, c in enumerate([*names, run_, none_, before_, after_])}
    by = [at[c] for c in (*keys, run_)]
    out_schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("others_best", T.DoubleType())])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            v, p_, none, best, after = (whole.column(at[c]).to_pylist() for c in (value, p, none_, before_, after_))
            tail = [0.0] * len(v)  # what is expected after each one
            e = after[-1]
            for i in range(len(v) - 1, -1, -1):
                tail[i] = e
                e = v[i] * p_[i] + (1 - p_[i]) * e
            q, head, others = none[0], best[0], []
            for i in range(len(v)):
                others.append(head + q * tail[i])
                head += v[i] * p_[i] * q
                q *= 1 - p_[i]
            whole = whole.select(names).append_column("others_best", pa.array(others, pa.float64()))
            yield from whole.to_batches()

        last = None
        for batch in batches:
            key = list(zip(*(batch.column(i).to_pylist() for i in by)))
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            for s, z in zip(cuts, cuts[1:]):
                if z == s:
                    continue
                if held and key[s] != last:
                    yield from done()
                    held.clear()
                held.append(batch.slice(s, z - s))
                last = key[s]
        if held:
            yield from done()

    return both.mapInArrow(finished, out_schema)


def nearest_decile_cut(valued: DataFrame) -> DataFrame:
    """Cut for disagreement: the ninth decile by nearest rank where a league has more than 50 values, else 1."""
    cut = nearest_quantile(valued, ["league_id"], "disagreement", 0.9)
    return cut.select("league_id", F.when(F.col("n") > 50, F.col("cut")).otherwise(1.0).alias("cut"))


def spearman(a: DataFrame, keys: list[str], x: str, y: str, least: int = 30) -> DataFrame:
    """Rank correlation with average ranks for ties, per key; null for fewer than ``least`` pairs."""
    both = a.select(*keys, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    both = tie_ranks(tie_ranks(both, keys, x, "x_rank", False), keys, y, "y_rank", False)
    average = lambda r: F.col(r) + (F.col(f"{r}_ties") - 1) / 2
    r = both.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(average("x_rank"), average("y_rank")).alias("_r"))
    return r.select(*keys, "n", F.when(F.col("n") >= least, F.col("_r")).alias("spearman"))
