"""Exact ranks within few, huge groups: no task holds a group.

Rows go to range partitions by group and order, so a group spreads over as many
as it needs.  A partition's share of a group is counted (a row for each), the
counts before it are summed, and rows are numbered within their share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.columns import before, free_name, running, zero
from fieldmark.sources.settled import settle


def _upto(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``weight`` over the rows of the group up to and with this one; the order has no ties."""
    names = rows.columns
    part, own, sofar = (free_name(names, c) for c in ("range_part", "range_own", "range_before"))
    dealt = settle(rows.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(part, F.spark_partition_id()), "ranges")  # the part is a key from here on
    shares = dealt.groupBy(*keys, part).agg(F.sum(weight).alias(own))
    shares = shares.withColumn(sofar, zero(F.sum(own).over(before(Window.partitionBy(*keys).orderBy(part))))).drop(own)  # a row a partition that a group spans
    within = F.sum(weight).over(running(Window.partitionBy(*keys, part).orderBy(*order)))
    right = shares.select(*[F.col(k).alias(f"{part}_{i}") for i, k in enumerate(keys)], F.col(part).alias(f"{part}_at"), sofar)
    same = [F.col(k).eqNullSafe(F.col(f"{part}_{i}")) for i, k in enumerate(keys)]
    both = dealt.withColumn(own, within).join(right, [*same, F.col(part) == F.col(f"{part}_at")])
    return both.select(*names, (F.col(sofar) + F.col(own)).alias(name))


def ordinals(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... within ``keys`` in ``order``, which must not have ties."""
    return _upto(rows, keys, order, F.lit(1), name)


def tie_ranks(rows: DataFrame, keys: Sequence[str], by: str, name: str, descending: bool = True) -> DataFrame:
    """``rows`` with ``name``, the least rank of equal values of ``by`` within ``keys``, and ``name``_ties, how many have that
    value. Equal values are counted first, so they are one row while ranks are made."""
    ties = f"{name}_ties"
    values = rows.groupBy(*keys, by).agg(F.count("*").alias(ties))
    order = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    upto = _upto(values, keys, [order], F.col(ties), name)
    right = upto.select(*[F.col(k).alias(f"_{name}_{i}") for i, k in enumerate([*keys, by])], (F.col(name) - F.col(ties) + 1).alias(name), ties)
    same = [F.col(k).eqNullSafe(F.col(f"_{name}_{i}")) for i, k in enumerate([*keys, by])]
    return rows.join(right, same).drop(*[f"_{name}_{i}" for i in range(len(keys) + 1)])
