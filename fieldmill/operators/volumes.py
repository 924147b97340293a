"""Volumes compared where there is material, first fields from measurements or a coarse volume, and the hybrid score of where to refine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bricks import bricks, project
from .metrics import psnr
from .rays import RAY
from .stencil import gradient_magnitude, local_sigma, normalised


def material_metrics(volume: DataFrame, target: str, predicted: str, threshold: float) -> DataFrame:
    """One row: n, psnr and mae over the voxels whose target is over the threshold; no row where there are none."""
    off = F.col(predicted) - F.col(target)
    inside = volume.where(F.col(target) > threshold)
    return inside.agg(F.count("*").alias("n"), psnr(F.avg(off * off), F.max(target)).alias("psnr"), F.avg(F.abs(off)).alias("mae")).where("n > 0")


def boundary_metrics(volume: DataFrame, target: str, predicted: str, axes: Sequence[str], threshold: float, quantile: float = 0.9) -> DataFrame:
    """One row over the material voxels of steepest target: their number, both mean gradients and the ratio, and the mae of the values."""
    axes = list(axes)
    graded = gradient_magnitude(volume, target, axes, []).withColumnRenamed("gradient", "_t")
    graded = gradient_magnitude(graded, predicted, axes, []).withColumnRenamed("gradient", "_p")
    material = graded.where(F.col(target) > threshold)
    cut = material.agg(F.percentile("_t", quantile).alias("_cut"))
    edge = material.crossJoin(F.broadcast(cut)).where(F.col("_t") >= F.col("_cut"))  # one row
    out = edge.agg(F.count("*").alias("n"), F.avg("_t").alias("target_gradient"), F.avg("_p").alias("predicted_gradient"), F.avg(F.abs(F.col(predicted) - F.col(target))).alias("mae")).where("n > 0")
    return out.withColumn("gradient_ratio", F.col("predicted_gradient") / F.greatest("target_gradient", F.lit(1e-8)))


def masked_projection_metrics(volume: DataFrame, target: str, predicted: str, axes: Sequence[str], rays: DataFrame, n: int, size: int, views: int, samples: int, threshold: float, edge: int = 8) -> DataFrame:
    """(part, n, mae, psnr, share) of projections of both volumes where the target is material: over the full detector, and over the rays that meet any."""
    inside = F.col(target) > threshold
    masked = volume.select(*axes, *(F.when(inside, F.col(c)).otherwise(0.0).alias(c) for c in (target, predicted)), inside.cast("double").alias("_mask"))
    made = None
    for c, name in ((target, "target"), (predicted, "prediction"), ("_mask", "mask")):
        one = project(rays, bricks(masked, axes, c, n, edge), n, size, views, samples, edge).withColumnRenamed("prediction", name)
        made = one if made is None else made.join(one, RAY)
    both = made.select("*", F.explode(F.when(F.col("mask") > 1e-6, F.array(F.lit("full_detector"), F.lit("material_rays"))).otherwise(F.array(F.lit("full_detector")))).alias("part"))
    off = F.col("prediction") - F.col("target")
    out = both.groupBy("part").agg(F.count("*").alias("n"), F.avg(F.abs(off)).alias("mae"), psnr(F.avg(off * off), F.max("target")).alias("psnr"))
    total = made.agg(F.count("*").alias("_all"))
    return out.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")  # one row


def pooled(volume: DataFrame, axes: Sequence[str], value: str, n: int, coarse: int) -> DataFrame:
    """A volume of coarse ** 3 cells, each the mean of the voxels it covers or cuts: what a first field is made of."""
    out = volume.select(*axes, value)
    for a in axes:
        first = F.expr(f"({a} * {coarse}) div {n}")
        last = F.expr(f"(({a} + 1) * {coarse} - 1) div {n}")
        out = out.select(*(c for c in out.columns if c != a), F.explode(F.sequence(first, last)).alias(a))
    return out.groupBy(*axes).agg(F.avg(value).alias(value))


def mean_field(rays: DataFrame) -> DataFrame:
    """One row: the constant field that explains the mean of all targets along the box's depth of 2."""
    return rays.agg(F.greatest(F.avg("target") * 0.5, F.lit(1e-8)).alias("mu"))


def hybrid_score(volume: DataFrame, value: str, axes: Sequence[str], residual: DataFrame | None = None, alpha: float = 1.0, beta: float = 1.0, gamma: float = 0.25) -> DataFrame:
    """(axes, gradient, sigma, residual, score): normalised gradient, local spread and back-projected residual, weighted, summed and normalised.

    `residual` has a `score` for each voxel; without it the gradient and the spread count alone.
    """
    axes = list(axes)
    parts = {
        "gradient": normalised(gradient_magnitude(volume.select(*axes, value), value, axes, []), "gradient"),
        "sigma": normalised(local_sigma(volume.select(*axes, value), value, axes), "sigma"),
    }
    if residual is not None:
        parts["residual"] = normalised(residual.select(*axes, F.col("score").alias("raw")), "raw")
    made = None
    for name, df in parts.items():
        one = df.select(*axes, F.col("score").alias(name))
        made = one if made is None else made.join(one, axes)
    weights = {"gradient": alpha, "sigma": gamma, "residual": beta}
    total = made.withColumn("_sum", sum((weights[k] * F.col(k) for k in parts), F.lit(0.0)))
    return normalised(total, "_sum").select(*axes, *parts, "score")
