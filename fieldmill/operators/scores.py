"""Attribution of projection residuals to leaves, and predicted gains of refining them.

Rays of one geometry share their path, so weights and residuals are first summed per geometry; the fact
table and all features are computed once per distinct path, whatever the number of rays.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import EPS, slab
from .lookup import KEY, resolution
from .rays import RAY, with_geometry

MODES = {
    "inverse": "inverse", "inverse_target": "inverse", "reciprocal": "inverse",
    "uniform": "uniform", "none": "uniform", "mse": "uniform",
    "target_power": "target_power", "target": "target_power", "attenuation": "target_power", "foreground": "target_power",
    "sqrt_target": "sqrt_target", "sqrt_attenuation": "sqrt_target",
    "blend": "blend", "dynamic_range_balanced": "blend", "balanced": "blend", "inverse_target_blend": "blend", "inverse_edge_blend": "blend",
}


def with_weights(rays: DataFrame, groups: list[str], mode: str = "inverse", epsilon: float = 1e-4, power: float = 1.0, low: float | None = None, high: float | None = None, alpha: float = 0.15) -> DataFrame:
    """Rays with `weight`, of mean 1 within each group (the chunk that a scorer takes at once)."""
    kind = MODES.get(mode.lower())
    if kind is None:
        raise ValueError(f"unknown weight mode {mode!r}")
    size = F.abs(F.col("target"))
    chunk = Window.partitionBy(*groups)
    at_least = lambda c: F.greatest(c, F.lit(epsilon))
    even = lambda c: c / at_least(F.avg(c).over(chunk))
    inverse = 1.0 / at_least(size)
    edge = F.pow(size + epsilon, F.lit(power))
    raw = {"inverse": inverse, "uniform": F.lit(1.0), "target_power": edge, "sqrt_target": F.sqrt(size + epsilon)}
    if kind == "blend":
        share = min(1.0, max(0.0, alpha))
        out = rays.withColumn("_w", (1.0 - share) * even(inverse) + share * even(edge))
    else:
        out = rays.withColumn("_w", raw[kind])
    out = out.withColumn("weight", even(F.col("_w"))).drop("_w")
    if low is not None or high is not None:
        out = out.withColumn("weight", F.greatest(F.lit(low or 0.0), F.least(F.lit(float("inf") if high is None else high), F.col("weight"))))
        out = out.withColumn("weight", even(F.col("weight")))
    return out


def chunked(rays: DataFrame, size: int) -> DataFrame:
    """Rays with the number of their chunk: `size` rays of one view in id order."""
    place = F.row_number().over(Window.partitionBy("view_id").orderBy("ray_id")) - 1
    return rays.withColumn("chunk_id", F.floor(place / size))


def weighted_loss(weighted: DataFrame, *groups: str) -> DataFrame:
    off = F.col("prediction") - F.col("target")
    return weighted.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(F.col("weight") * off * off).alias("loss"))


def per_path(weighted: DataFrame) -> DataFrame:
    """Per geometry: n rays, sum_w, sum_wr (weight * residual), energy (weight * residual squared)."""
    off = F.col("prediction") - F.col("target")
    return weighted.groupBy(*RAY).agg(F.count("*").alias("n"), F.sum("weight").alias("sum_w"), F.sum(F.col("weight") * off).alias("sum_wr"), F.sum(F.col("weight") * off * off).alias("energy"))


def residual_scores(facts: DataFrame, paths: DataFrame) -> DataFrame:
    """Per leaf: energy attributed by share of the path integral, exposure, and score = energy / exposure."""
    size = F.abs(F.col("integral"))
    share = facts.withColumn("_size", size).withColumn("_all", F.sum("_size").over(Window.partitionBy(*RAY)))
    met = share.join(paths, RAY)
    out = met.groupBy(*KEY).agg(F.sum(F.col("energy") * F.col("_size") / F.greatest("_all", F.lit(1e-8))).alias("energy"), F.sum(F.col("n") * F.col("_size")).alias("exposure"))
    return out.withColumn("score", F.when(F.col("exposure") > 0, F.col("energy") / F.greatest("exposure", F.lit(1e-8))).otherwise(0.0))


def _bounds(axis: str, levels: Sequence[int]) -> tuple[Column, Column]:
    cell = 2.0 / resolution(F.col("level"), levels)
    low = -1.0 + F.col(f"i{axis}") * cell
    return low, cell


def haar_features(facts: DataFrame, levels: Sequence[int], size: int, views: int) -> list[Column] | DataFrame:
    """Path lengths through the eight virtual children against the seven Haar details: f0 to f6 of constant leaves."""
    ways = with_geometry(facts, size, views)
    (lx, cx), (ly, cy), (lz, cz) = (_bounds(a, levels) for a in "xyz")
    length = {}
    for i in (0, 1):
        for j in (0, 1):
            ax, bx, okx = slab(F.col("bx"), F.col("dx"), lx + i * 0.5 * cx, lx + (i + 1) * 0.5 * cx)
            ay, by, oky = slab(F.col("by"), F.col("dy"), ly + j * 0.5 * cy, ly + (j + 1) * 0.5 * cy)
            enter, leave = F.greatest(ax, ay), F.least(bx, by)
            length[i, j] = F.when(okx & oky & (leave > enter + EPS), leave - enter).otherwise(0.0)
    ways = ways.withColumns({f"_l{i}{j}": v for (i, j), v in length.items()})
    a, b, c, d = (F.col(f"_l{k}") for k in ("00", "01", "10", "11"))
    return _modes(ways, a + b + c + d, (a + b) - (c + d), (a + c) - (b + d), a - b - c + d, F.when(F.col("z") >= lz + 0.5 * cz, -1.0).otherwise(1.0))


def _modes(df: DataFrame, all_: Column, x: Column, y: Column, xy: Column, z: Column) -> DataFrame:
    scale = 1.0 / math.sqrt(8.0)
    modes = (x, y, z * all_, xy, z * x, z * y, z * xy)
    return df.withColumns({f"f{k}": m * scale for k, m in enumerate(modes)})


def trilinear_features(facts: DataFrame, levels: Sequence[int], size: int, views: int) -> DataFrame:
    """Path integrals of the seven details that a constant leaf gains as a trilinear one; two Gauss nodes are exact."""
    ways = with_geometry(facts, size, views)
    (lx, cx), (ly, cy), (lz, cz) = (_bounds(a, levels) for a in "xyz")
    ax, bx, okx = slab(F.col("bx"), F.col("dx"), lx, lx + cx)
    ay, by, oky = slab(F.col("by"), F.col("dy"), ly, ly + cy)
    ways = ways.withColumns({"_in": F.greatest(ax, ay), "_out": F.least(bx, by), "_ok": okx & oky})
    half = F.when(F.col("_ok") & (F.col("_out") > F.col("_in") + EPS), 0.5 * (F.col("_out") - F.col("_in"))).otherwise(0.0)
    centre = 0.5 * (F.col("_out") + F.col("_in"))
    clamp = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    node = 1.0 / math.sqrt(3.0)
    us, vs = [], []
    for s in (-node, node):
        t = centre + half * s
        us.append(1.0 - 2.0 * clamp((F.col("bx") + F.col("dx") * t - lx) / cx))
        vs.append(1.0 - 2.0 * clamp((F.col("by") + F.col("dy") * t - ly) / cy))
    z = 1.0 - 2.0 * clamp((F.col("z") - lz) / cz)
    ways = ways.withColumns({"_h": half, "_u0": us[0], "_u1": us[1], "_v0": vs[0], "_v1": vs[1], "_z": z})
    h, u0, u1, v0, v1 = (F.col(c) for c in ("_h", "_u0", "_u1", "_v0", "_v1"))
    return _modes(ways, 2.0 * h, h * (u0 + u1), h * (v0 + v1), h * (u0 * v0 + u1 * v1), F.col("_z"))


def detail_gain(features: DataFrame, paths: DataFrame, damping: float = 1e-8) -> DataFrame:
    """Per leaf the Gauss-Newton gain of its seven details: half the sum of gradient squared over damped Fisher."""
    met = features.join(paths.select(*RAY, "sum_w", "sum_wr"), RAY)
    sums = [x for k in range(7) for x in (F.sum(F.col("sum_wr") * F.col(f"f{k}")).alias(f"g{k}"), F.sum(F.col("sum_w") * F.col(f"f{k}") * F.col(f"f{k}")).alias(f"h{k}"))]
    per = met.groupBy(*KEY).agg(*sums)
    gain = sum((F.col(f"g{k}") * F.col(f"g{k}") / (F.col(f"h{k}") + damping) for k in range(7)), F.lit(0.0)) * 0.5
    seen = F.greatest(*(F.col(f"h{k}") for k in range(7))) > 0
    return per.select(*KEY, F.when(seen, gain).otherwise(0.0).alias("gain"))
