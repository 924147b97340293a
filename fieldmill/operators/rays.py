"""Exact line integrals of parallel rays through the leaf tree: the (ray, leaf, integral) fact table."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EPS, detector, slab
from .lookup import KEY, locate, terms

RAY = ["view_id", "row", "col"]


def with_geometry(rays: DataFrame, size: int, views: int) -> DataFrame:
    """Direction (dx, dy), base (bx, by), height z and box interval (t0, t1) of each ray; missing rays have t0 = t1 = 0."""
    angle = -(F.col("view_id") * F.lit(math.pi) / views)
    out = rays.withColumns({"dx": F.cos(angle), "dy": F.sin(angle), "_u": detector(F.col("col"), size), "z": detector(F.col("row"), size)})
    out = out.withColumns({"bx": -F.col("dy") * F.col("_u"), "by": F.col("dx") * F.col("_u")}).drop("_u")
    one = F.lit(1.0)
    ax, bx, okx = slab(F.col("bx"), F.col("dx"), -one, one)
    ay, by, oky = slab(F.col("by"), F.col("dy"), -one, one)
    out = out.withColumns({"_lo": F.greatest(ax, ay), "_hi": F.least(bx, by), "_ok": okx & oky})
    hit = F.col("_ok") & (F.col("_hi") > F.col("_lo"))
    return out.withColumns({"t0": F.when(hit, F.col("_lo")).otherwise(0.0), "t1": F.when(hit, F.col("_hi")).otherwise(0.0)}).drop("_lo", "_hi", "_ok")


def segments(rays: DataFrame, finest: int) -> DataFrame:
    """Pieces of each ray between crossings of the finest grid: s0, s1."""
    def crossings(base: str, step: str):
        t = F.transform(F.sequence(F.lit(1), F.lit(finest - 1)), lambda k: (-1.0 + k * (2.0 / finest) - F.col(base)) / F.col(step))
        inside = F.filter(t, lambda x: (x > F.col("t0") + EPS) & (x < F.col("t1") - EPS))
        return F.when(F.abs(F.col(step)) >= EPS, inside).otherwise(F.array().cast("array<double>"))

    cuts = rays.where("t1 > t0").withColumn("_t", F.array_sort(F.concat(F.array("t0", "t1"), crossings("bx", "dx"), crossings("by", "dy"))))
    n = F.size("_t") - 1
    pairs = F.arrays_zip(F.slice("_t", 1, n).alias("s0"), F.slice("_t", 2, n).alias("s1"))
    return cuts.select("*", F.inline(pairs)).drop("_t").where(F.col("s1") > F.col("s0") + EPS)


def gauss_table(spark, most: int = 5) -> DataFrame:
    """Gauss-Legendre nodes and weights by order; 15 rows."""
    rows = [(order, float(x), float(w)) for order in range(1, most + 1) for x, w in zip(*np.polynomial.legendre.leggauss(order))]
    return spark.createDataFrame(rows, "rule long, gx double, gw double")


def spread(ways: DataFrame, size: int, views: int, finest: int, per_part: int = 1_000_000) -> DataFrame:
    """Rays dealt out by their key for the pieces they will be cut into, as small as their own rows are.

    All that follows for a ray stays in its partition: facts need no further exchange.
    """
    pieces = views * size * size * 2 * finest
    cores = ways.sparkSession.sparkContext.defaultParallelism
    return ways.repartition(min(100_000, max(cores, pieces // per_part)), *RAY)


def ray_terms(rays: DataFrame, leaves: DataFrame, levels: Sequence[int], size: int, views: int) -> DataFrame:
    """Quadrature terms of distinct rays: ray key, leaf key, coefficient, c, w = weight * half * basis."""
    ways = with_geometry(spread(rays.select(*RAY).distinct(), size, views, levels[-1]), size, views)
    cut = segments(ways, levels[-1])
    mid = 0.5 * (F.col("s0") + F.col("s1"))
    found = locate(cut.withColumns({"x": F.col("bx") + F.col("dx") * mid, "y": F.col("by") + F.col("dy") * mid}), leaves, levels)
    rule = F.greatest(F.lit(1), F.ceil((F.col("px") + F.col("py") + F.col("pz") + 1) / 2.0)).cast("long")
    nodes = found.withColumn("rule", rule).join(F.broadcast(gauss_table(rays.sparkSession)), "rule")
    half, centre = 0.5 * (F.col("s1") - F.col("s0")), 0.5 * (F.col("s1") + F.col("s0"))
    t = centre + half * F.col("gx")
    placed = nodes.withColumns({"x": F.col("bx") + F.col("dx") * t, "y": F.col("by") + F.col("dy") * t, "_w": half * F.col("gw")})
    return terms(placed, levels).select(*RAY, *KEY, "coefficient", "c", (F.col("_w") * F.col("basis")).alias("w"))


def ray_cell_contributions(rays: DataFrame, leaves: DataFrame, levels: Sequence[int], size: int, views: int) -> DataFrame:
    """(view_id, row, col, leaf key, integral) of all distinct rays; geometry is integrated once per distinct ray."""
    return ray_terms(rays, leaves, levels, size, views).groupBy(*RAY, *KEY).agg(F.sum(F.col("c") * F.col("w")).alias("integral"))


def predictions(rays: DataFrame, facts: DataFrame) -> DataFrame:
    """Rays with their predicted value; rays that meet no leaf get 0."""
    sums = facts.groupBy(*RAY).agg(F.sum("integral").alias("prediction"))
    return rays.join(sums, RAY, "left").withColumn("prediction", F.coalesce("prediction", F.lit(0.0)))


def sampled_predictions(rays: DataFrame, leaves: DataFrame, levels: Sequence[int], size: int, views: int, samples: int) -> DataFrame:
    """Distinct rays integrated by midpoint samples instead."""
    ways = with_geometry(spread(rays.select(*RAY).distinct(), size, views, samples // 2), size, views).where("t1 > t0").withColumn("h", (F.col("t1") - F.col("t0")) / samples)
    at = ways.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    t = F.col("t0") + (F.col("i") + 0.5) * F.col("h")
    spots = at.withColumns({"x": F.col("bx") + F.col("dx") * t, "y": F.col("by") + F.col("dy") * t})
    return terms(locate(spots, leaves, levels), levels).groupBy(*RAY).agg(F.sum(F.col("c") * F.col("basis") * F.col("h")).alias("prediction"))
