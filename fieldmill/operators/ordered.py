"""Ranked selection: top-k, running budgets and greedy folds, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import snapshot


def running_totals(df: DataFrame, score: str | list[Column], key: list[str], sums: dict[str, Column], per_part: int = 500_000) -> DataFrame:
    """Running sums in the order (score falling, key rising), each up to and with its row. `score` may be a list of orderings instead.

    A larger table than per_part rows is cut into ranges of that whole order, so that rows of one score may lie in many, and is written once in ranges;
    ranges are summed, their sums run up, and rows run up within their range.
    """
    order = [*([F.desc(score)] if isinstance(score, str) else score), *key]
    rows = df.withColumns({f"_v_{k}": v for k, v in sums.items()})
    n = df.count()
    if n > per_part:
        ranged = rows.repartitionByRange(-(-n // per_part), *order)
        rows = snapshot(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    else:
        rows = rows.withColumn("_part", F.lit(0))
    totals = rows.groupBy("_part").agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = totals.select("_part", *(F.coalesce(F.sum(f"_t_{k}").over(ahead), F.lit(0)).alias(f"_s_{k}") for k in sums))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(F.broadcast(starts), "_part")
    return out.select(*df.columns, *((F.sum(f"_v_{k}").over(inside) + F.col(f"_s_{k}")).alias(k) for k in sums))


def within_budget(df: DataFrame, score: str, key: list[str], cost: Column, budget: float, most: int | None = None) -> DataFrame:
    """The longest run of best-scored rows whose total cost keeps to the budget (and of at most `most` rows)."""
    total = running_totals(df, score, key, {"_spent": cost, "_place": F.lit(1)})
    fits = F.col("_spent") <= budget
    return total.where(fits & (F.col("_place") <= most) if most is not None else fits).drop("_spent", "_place")


def top_union(df: DataFrame, score: str, key: list[str], fraction: float, cap_fraction: float, material: str | None = None, least: float | None = None, q95_times: float | None = None) -> DataFrame:
    """Top fraction by score, with all over a material threshold and all over a multiple of the scores' q95; capped.

    Under the cap material rows come first, by material value, then the others by score.
    """
    n = df.count()
    place = {"_place": F.lit(1)}
    ranked = running_totals(df, score, key, place).where(F.col("_place") <= max(1, int(n * fraction))).drop("_place")
    bar = df.where(F.col(score) > 0).agg(F.percentile(score, 0.95)).first()[0] if q95_times is not None else None
    is_material = (F.col(material) >= least) if material else F.lit(False)
    extra = is_material | ((F.col(score) >= bar * q95_times) if bar is not None else F.lit(False))
    union = ranked.union(df.where(extra)).distinct()
    cap = int(n * cap_fraction)
    first = F.when(is_material, F.col(material)) if material else F.lit(None).cast("double")
    return running_totals(union, [F.desc_nulls_last(first), F.desc(score)], key, place).where(F.col("_place") <= cap).drop("_place")


def quantile_band(df: DataFrame, score: str, low: float, high: float) -> DataFrame:
    """Rows whose score lies between two quantiles of the positive scores."""
    positive = df.where((F.col(score) > 0) & ~F.isnan(score))
    bounds = positive.agg(F.percentile(score, F.array(F.lit(low), F.lit(high)))).first()[0]
    return positive.where(F.col(score).between(*bounds)) if bounds else positive


def greedy_two_sizes(df: DataFrame, score: str, key: list[str], large: Column, large_cost: int, small_cost: int, budget: int, most_large: int) -> DataFrame:
    """Greedy knapsack over two kinds of action in score order: what no longer fits is passed over, the rest goes on.

    The remaining budget never grows, so once a large action doesn't fit none after it does: what is taken is a
    run of all rows up to there, then small ones only. Rows with a score of 0 or less are never taken.
    """
    rows = df.where(F.col(score) > 0)
    cost = F.when(large, large_cost).otherwise(small_cost)
    run = running_totals(rows, score, key, {"_spent": cost, "_larges": large.cast("int"), "_place": F.lit(1)})
    fits = (F.col("_spent") <= budget) & (~large | (F.col("_larges") <= most_large))
    stop = run.where(~fits).agg(F.min("_place")).first()[0]
    if stop is None:
        return run.select(*df.columns)
    taken = run.where(F.col("_place") < stop)
    left = budget - (taken.agg(F.sum(cost)).first()[0] or 0)
    later = run.where((F.col("_place") >= stop) & ~large).select(*df.columns)
    return taken.select(*df.columns).union(within_budget(later, score, key, F.lit(small_cost), left))
