"""Losses besides the weighted projection loss: detector gradients, face continuity, volume samples; and back-projection."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import KEY, resolution, terms
from .scores import with_weights
from .tree import face_neighbours


def detector_edges(images: DataFrame, stride: int = 1) -> DataFrame:
    """Pairs of pixels `stride` apart along columns and rows: derivative, its target, the targets and residuals of both ends.

    `images` has view_id, row, col, prediction, target, a row for each pixel.
    """
    out = None
    for axis in ("row", "col"):
        ahead = images.select("view_id", *(c if c != axis else (F.col(c) - stride).alias(c) for c in ("row", "col")), F.col("prediction").alias("p2"), F.col("target").alias("t2"))
        pairs = images.join(ahead, ["view_id", "row", "col"]).select(
            "view_id", F.lit(axis).alias("axis"), "row", "col",
            ((F.col("p2") - F.col("prediction")) / stride).alias("slope"), ((F.col("t2") - F.col("target")) / stride).alias("target_slope"),
            ((F.col("t2") + F.col("target")) / 2).alias("target"), (F.col("prediction") - F.col("target")).alias("off1"), (F.col("p2") - F.col("t2")).alias("off2"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def gradient_loss(edges: DataFrame, group: str, quantile: float = 0.75, epsilon: float = 1e-4, mode: str = "inverse") -> DataFrame:
    """Per group: weighted mean square of slope residuals, and over edges of a target slope in the top quantile that of
    magnitudes, the square of the difference of mean magnitudes, and the mean square of the ends' residuals."""
    weighted = with_weights(edges, [group], mode, epsilon)
    size = F.abs(F.col("target_slope"))
    bars = edges.groupBy(group).agg(F.percentile(size, quantile).alias("_bar"))
    near = weighted.join(bars, group).withColumn("_w", F.when(size >= F.col("_bar"), F.col("weight")))
    square = lambda c: c * c
    at_least = lambda c: F.greatest(c, F.lit(epsilon))
    mean_w = at_least(F.avg("_w"))
    moment = lambda c: F.sum(F.col("_w") * F.abs(c)) / at_least(F.sum("_w"))
    return near.groupBy(group).agg(
        F.avg(F.col("weight") * square(F.col("slope") - F.col("target_slope"))).alias("signed"),
        (F.avg(F.col("_w") * square(F.abs("slope") - size)) / mean_w).alias("magnitude"),
        square(moment(F.col("slope")) - moment(F.col("target_slope"))).alias("moment"),
        (0.5 * F.avg(F.col("_w") * (square(F.col("off1")) + square(F.col("off2")))) / mean_w).alias("endpoint"),
    )


def shared_faces(leaves: DataFrame, levels: Sequence[int]) -> DataFrame:
    """Each face between two leaves once, from the finer side, or from the lower one where both are of one level."""
    return face_neighbours(leaves, levels).where((F.col("level") < F.col("own_level")) | ((F.col("level") == F.col("own_level")) & (F.col("side") == 1)))


def face_jumps(leaves: DataFrame, levels: Sequence[int], order: int = 2) -> DataFrame:
    """(own key, axis, side, spot, area, jump): difference of the two leaves' polynomials at quadrature points of each shared face."""
    nodes = [0.5] if order == 1 else [0.5 * (float(x) + 1) for x in np.polynomial.legendre.leggauss(order)[0]]
    spots = F.array(*(F.struct(F.lit(i * len(nodes) + j).alias("spot"), F.lit(u).alias("u"), F.lit(v).alias("v")) for i, u in enumerate(nodes) for j, v in enumerate(nodes)))
    faces = shared_faces(leaves, levels).select(*(f"own_{c}" for c in KEY), "axis", "side", *KEY).select("*", F.inline(spots))
    width = 2.0 / resolution(F.col("own_level"), levels)
    # of the two axes along the face the lower one takes u, the other v
    along = {"x": F.col("u"), "y": F.when(F.col("axis") == 0, F.col("u")).otherwise(F.col("v")), "z": F.col("v")}
    place = {a: -1.0 + (F.col(f"own_i{a}") + F.when(F.col("axis") == k, F.col("side").cast("double")).otherwise(along[a])) * width for k, a in enumerate("xyz")}
    held = [*(f"own_{c}" for c in KEY), "axis", "side", "spot", "area"]
    at = faces.withColumns(place | {"area": width * width})
    both = None
    for sign, names in ((1.0, [f"own_{c}" for c in KEY]), (-1.0, KEY)):
        own = at.select(*held, "x", "y", "z", *(F.col(n).alias(f"_{c}") for n, c in zip(names, KEY)))
        met = own.join(leaves.select(*(F.col(c).alias(f"_{c}") for c in KEY), "px", "py", "pz", "coeffs"), [f"_{c}" for c in KEY])
        met = met.select(*held, "x", "y", "z", "px", "py", "pz", "coeffs", *(F.col(f"_{c}").alias(c) for c in KEY))
        part = terms(met, levels).select(*held, (F.col("c") * F.col("basis") * sign).alias("part"))
        both = part if both is None else both.union(part)
    return both.groupBy(*held).agg(F.sum("part").alias("jump"))


def huber(off: Column, delta: float) -> Column:
    size = F.abs(off)
    return F.when(size <= delta, 0.5 * off * off).otherwise(delta * (size - 0.5 * delta))


def continuity_loss(leaves: DataFrame, levels: Sequence[int], delta: float = 0.02, order: int = 2) -> DataFrame:
    """One row: number of shared faces, and the mean Huber penalty of their jumps weighed by area."""
    penalty = face_jumps(leaves, levels, order).groupBy(*(f"own_{c}" for c in KEY), "axis", "side", "area").agg(F.avg(huber(F.col("jump"), delta)).alias("penalty"))
    return penalty.agg(F.count("*").alias("faces"), (F.sum(F.col("area") * F.col("penalty")) / F.greatest(F.sum("area"), F.lit(1e-12))).alias("loss"))


def sample_losses(rows: DataFrame, prediction: str, target: str, *groups: str) -> DataFrame:
    """mse, l1 and smooth l1 (Huber of width one)."""
    off = F.col(prediction) - F.col(target)
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(off * off).alias("mse"), F.avg(F.abs(off)).alias("l1"), F.avg(huber(off, 1.0)).alias("smooth_l1"))


def backprojected(grid: DataFrame, images: DataFrame, value: str, size: int, views: int) -> DataFrame:
    """Grid points (gx, gy, gz, x, y, z) with `score`: the image value where each view sees them, bilinear between pixel
    centres, zero outside, averaged over the views. Four equi-joins' worth of taps in one join on (view, row, col)."""
    spark = grid.sparkSession
    turned = spark.range(views).select(F.col("id").alias("view_id"), (-(F.col("id") * F.lit(math.pi) / views)).alias("angle"))
    seen = grid.crossJoin(F.broadcast(turned))  # a row for each view, whose number is fixed
    u = -F.sin("angle") * F.col("x") + F.cos("angle") * F.col("y")
    pixel = lambda c: ((c + 1.0) * size - 1.0) / 2.0
    seen = seen.select("gx", "gy", "gz", "view_id", pixel(u).alias("c"), pixel(F.col("z")).alias("r"))
    taps = F.array(*(F.struct((F.floor("r") + a).alias("row"), (F.floor("c") + b).alias("col"), ((F.col("r") - F.floor("r") if a else 1.0 - (F.col("r") - F.floor("r"))) * (F.col("c") - F.floor("c") if b else 1.0 - (F.col("c") - F.floor("c")))).alias("share")) for a in (0, 1) for b in (0, 1)))
    each = seen.select("gx", "gy", "gz", "view_id", F.inline(taps)).join(images.select("view_id", "row", "col", value), ["view_id", "row", "col"], "left")
    return each.groupBy("gx", "gy", "gz").agg((F.sum(F.col("share") * F.coalesce(F.col(value), F.lit(0.0))) / views).alias("score"))
