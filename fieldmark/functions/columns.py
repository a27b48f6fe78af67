"""Column expressions that several operators share. All stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def total(c: Column | str) -> Column:
    """Sum where nothing sums to 0."""
    return F.coalesce(F.sum(c), F.lit(0))


def zero(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


def clip(c: Column, low: float | Column, high: float | Column) -> Column:
    """``c`` within bounds; null stays null."""
    fix = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(c.isNotNull(), F.least(F.greatest(c, fix(low)), fix(high)))


def ratio(a: Column, b: Column, other: float | None = None) -> Column:
    """a / b, or ``other`` where b is 0 or null."""
    return F.when((b != 0) & b.isNotNull(), a / b).otherwise(F.lit(other))


def flag(c: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(c, F.lit(False))


def mean_of(columns: Sequence[Column]) -> Column:
    """Mean of those that are not null; null if all are."""
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    s = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    return F.when(n > 0, s / n)


def sample_std(columns: Sequence[Column]) -> Column:
    """Sample standard deviation across columns, of those that are not null; null for fewer than two."""
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    m = mean_of(columns)
    s = reduce(lambda a, b: a + b, [F.coalesce((c - m) * (c - m), F.lit(0.0)) for c in columns])
    return F.when(n > 1, F.sqrt(s / (n - 1)))


def free_name(names: Sequence[str], name: str) -> str:
    """A column name made from ``name`` that ``names`` do not hold in either case of its letters."""
    held = {c.lower() for c in names}
    while name.lower() in held:
        name += "_"
    return name


def before(w: WindowSpec) -> WindowSpec:
    """The rows before the current one."""
    return w.rowsBetween(Window.unboundedPreceding, -1)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution, by a rational approximation of erf (Abramowitz and Stegun 7.1.26, error 1.5e-7)."""
    z = F.abs(x) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = F.lit(1.0) - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def ladder(value: Column, steps: Sequence[tuple[float, float]], rest: float) -> Column:
    """The result of the first step whose bound ``value`` does not exceed; ``rest`` beyond all of them, null for null."""
    out = F.when(value.isNull(), F.lit(None).cast("double"))
    for bound, result in steps:
        out = out.when(value <= bound, F.lit(float(result)))
    return out.otherwise(F.lit(float(rest)))


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | Column = 1, name: str = "_n") -> DataFrame:
    """The first ``k`` rows of each key in ``order``; give an order without ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k).drop(name)


def dominant(df: DataFrame, keys: Sequence[str], column: str, when: str) -> DataFrame:
    """The commonest non-null value of ``column`` for each key; then the one seen last by ``when``, then the least."""
    n = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_count"), F.max(when).alias("_last"))
    return top(n, keys, [F.desc("_count"), F.desc("_last"), F.asc(column)]).select(*keys, column)
