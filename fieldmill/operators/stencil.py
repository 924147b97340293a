"""Finite differences and box sums on dense grids, as windows along one axis at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def along(axis: str, others: list[str]):
    """The window of a grid line: all other coordinates fixed."""
    return Window.partitionBy(*others).orderBy(axis)


def central(value: str, axis: str, others: list[str]) -> Column:
    """Central difference; 0 on the border."""
    w = along(axis, others)
    return F.coalesce(0.5 * (F.lead(value).over(w) - F.lag(value).over(w)), F.lit(0.0))


def gradient_magnitude(grid: DataFrame, value: str, axes: list[str], groups: list[str]) -> DataFrame:
    out = grid
    for a in axes:
        out = out.withColumn(f"_d{a}", central(value, a, [*groups, *(b for b in axes if b != a)]))
    total = sum((F.col(f"_d{a}") * F.col(f"_d{a}") for a in axes), F.lit(0.0))
    return out.withColumn("gradient", F.sqrt(total)).drop(*(f"_d{a}" for a in axes))


def total_variation(grid: DataFrame, value: str, axes: list[str]) -> DataFrame:
    """Sum over the axes of the mean absolute forward difference."""
    out = grid
    for a in axes:
        out = out.withColumn(f"_d{a}", F.abs(F.lead(value).over(along(a, [b for b in axes if b != a])) - F.col(value)))
    return out.agg(sum((F.avg(f"_d{a}") for a in axes), F.lit(0.0)).alias("tv"))


def local_sigma(grid: DataFrame, value: str, axes: list[str]) -> DataFrame:
    """Standard deviation in a box of three; beyond the border counts as zeros. One axis after the other."""
    out = grid.withColumns({"_m": F.col(value), "_s": F.col(value) * F.col(value)})
    for a in axes:
        w = along(a, [b for b in axes if b != a]).rowsBetween(-1, 1)
        out = out.withColumns({c: F.sum(c).over(w) for c in ("_m", "_s")})
    n = 3.0 ** len(axes)
    mean = F.col("_m") / n
    return out.withColumn("sigma", F.sqrt(F.greatest(F.col("_s") / n - mean * mean, F.lit(0.0)))).drop("_m", "_s")


def normalised(df: DataFrame, value: str) -> DataFrame:
    """Scores from 0 to 1 between the 1st and 99th percentile, or between the extremes where those coincide."""
    b = df.agg(F.percentile(value, F.array(F.lit(0.01), F.lit(0.99))).alias("q"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    flat = F.col("q")[1] - F.col("q")[0] < 1e-8
    b = b.select(F.when(flat, F.col("lo")).otherwise(F.col("q")[0]).alias("_lo"), F.when(flat, F.col("hi")).otherwise(F.col("q")[1]).alias("_hi"))
    out = df.crossJoin(F.broadcast(b))  # one row
    scaled = (F.col(value) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-8))
    return out.withColumn("score", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).drop("_lo", "_hi")
