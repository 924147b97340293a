"""Aggregates that compare arrays and images: one pass each, no row collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def psnr(mse: Column, top: Column) -> Column:
    return 20.0 * F.log10(F.greatest(top, F.lit(1e-8))) - 10.0 * F.log10(F.greatest(mse, F.lit(1e-20)))


def projection_metrics(predicted: DataFrame, *groups: str) -> DataFrame:
    """n, mae, psnr of prediction against target; the range is the largest target."""
    off = F.col("prediction") - F.col("target")
    return predicted.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(F.abs(off)).alias("mae"), psnr(F.avg(off * off), F.max("target")).alias("psnr"))


def array_stats(df: DataFrame, column: str, *groups: str) -> DataFrame:
    """n of all values; lo, hi, mean and p95 of the finite ones."""
    v = F.when(~F.isnan(column) & (F.abs(F.col(column)) < float("inf")), F.col(column))
    return df.groupBy(*groups).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.percentile(v, 0.95).alias("p95"))


def int_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) for bins 0 to bins - 1; negative values count as 0, larger ones are left out."""
    counts = df.select(F.greatest(F.col(column), F.lit(0)).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return frame.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def comparison(df: DataFrame, a: str, b: str, *groups: str) -> DataFrame:
    """mae, rmse, psnr and SSIM over one window, with the range of b."""
    off = F.col(a) - F.col(b)
    top = F.greatest(F.max(b) - F.min(b), F.lit(1e-8))
    c1, c2 = (0.01 * top) * (0.01 * top), (0.03 * top) * (0.03 * top)
    ma, mb = F.avg(a), F.avg(b)
    ssim = (2 * ma * mb + c1) * (2 * F.covar_pop(a, b) + c2) / ((ma * ma + mb * mb + c1) * (F.var_pop(a) + F.var_pop(b) + c2))
    return df.groupBy(*groups).agg(F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"), psnr(F.avg(off * off), F.max(b)).alias("psnr"), F.greatest(F.least(ssim, F.lit(1.0)), F.lit(-1.0)).alias("ssim"))


def display_range(df: DataFrame, column: str, *groups: str) -> DataFrame:
    """1st and 99.5th percentile; the extremes where they coincide, and a unit range where those do too."""
    q = F.percentile(column, F.array(F.lit(0.01), F.lit(0.995)))
    got = df.groupBy(*groups).agg(q.alias("q"), F.min(column).alias("lo"), F.max(column).alias("hi"))
    flat = F.col("q")[1] <= F.col("q")[0]
    low = F.when(flat, F.col("lo")).otherwise(F.col("q")[0])
    high = F.when(flat, F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1.0)).otherwise(F.col("q")[1])
    return got.select(*groups, low.alias("low"), high.alias("high"))
