"""What replacing a subtree by its p0 or p1 block would do to the projection loss, and what a region adds to it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import slab
from .lookup import KEY, resolution, sendable
from .rays import RAY, with_geometry


def subtree_integrals(facts: DataFrame) -> DataFrame:
    """(ray key, node key, integral): each path's integral over all leaves below each internal node."""
    up = facts.where("level > 0").select(*RAY, "integral", *(F.col(c).alias(f"own_{c}") for c in KEY), F.explode(F.sequence(F.lit(0).cast("long"), F.col("level") - 1)).alias("level"))
    nodes = up.select(*RAY, "integral", "level", *(F.expr(f"shiftright(own_{c}, cast(own_level - level as int))").alias(c) for c in KEY[1:]))
    return nodes.groupBy(*RAY, *KEY).agg(F.sum("integral").alias("integral"))


def loss_changes(facts: DataFrame, rays: DataFrame, bank: DataFrame, levels: Sequence[int], size: int, views: int) -> DataFrame:
    """Per internal node the mean over all rays of 2 * residual * change + change ** 2, for p0 and p1 in its subtree's place.

    `rays` has a prediction and a target each; rays of one geometry are summed first. Terms between nodes are left out, so
    that the changes of disjoint nodes add up.
    """
    paths = rays.groupBy(*RAY).agg(F.count("*").alias("n"), F.sum(F.col("prediction") - F.col("target")).alias("off"))
    total = rays.agg(F.count("*").alias("all"))  # one row
    met = subtree_integrals(facts).join(sendable(bank.select(*KEY, "p0", "p1")), KEY).join(paths, RAY)
    g = with_geometry(met, size, views)
    width = 2.0 / resolution(F.col("level"), levels)
    low = {a: -1.0 + F.col(f"i{a}") * width for a in "xyz"}
    ax, bx, _ = slab(F.col("bx"), F.col("dx"), low["x"], low["x"] + width)
    ay, by, _ = slab(F.col("by"), F.col("dy"), low["y"], low["y"] + width)
    g = g.withColumns({"_in": F.greatest(ax, ay), "_out": F.least(bx, by)}).withColumn("_length", F.greatest(F.col("_out") - F.col("_in"), F.lit(0.0)))

    def place(sign: float, a: str) -> Column:
        t = (F.col("_out") + F.col("_in")) / 2 + sign / math.sqrt(3.0) * F.col("_length") / 2
        at = F.col("z") if a == "z" else F.col(f"b{a}") + F.col(f"d{a}") * t
        return F.least(F.greatest((at - low[a]) / width, F.lit(0.0)), F.lit(1.0))

    g = g.withColumns({f"_{a}{k}": place(s, a) for a in "xyz" for k, s in enumerate((-1.0, 1.0))})
    side = lambda a, k, bit: F.col(f"_{a}{k}") if bit else 1.0 - F.col(f"_{a}{k}")
    corner = lambda i, k: side("x", k, i >> 2) * side("y", k, i >> 1 & 1) * side("z", k, i & 1)
    p1 = sum((F.get("p1", F.lit(i)) * (corner(i, 0) + corner(i, 1)) for i in range(8)), F.lit(0.0)) * F.col("_length") / 2
    g = g.withColumns({"_d0": F.col("_length") * F.col("p0") - F.col("integral"), "_d1": p1 - F.col("integral")})
    change = lambda d: F.sum(2.0 * F.col("off") * F.col(d) + F.col("n") * F.col(d) * F.col(d))
    sums = g.groupBy(*KEY).agg(change("_d0").alias("p0_change"), change("_d1").alias("p1_change")).crossJoin(F.broadcast(total))
    return sums.select(*KEY, *((F.col(c) / F.col("all")).alias(c) for c in ("p0_change", "p1_change")))


def region_energy(facts: DataFrame, weighted: DataFrame, region: DataFrame) -> DataFrame:
    """One row: the mean over rays of weight * (residual * the region's share of the prediction) ** 2; no row without rays.

    `weighted` has a prediction, a target and a weight for each ray.
    """
    inside = facts.join(sendable(region.select(*KEY).distinct()), KEY, "left_semi").groupBy(*RAY).agg(F.sum("integral").alias("own"))
    met = weighted.join(inside, RAY, "left")
    part = (F.col("prediction") - F.col("target")) * F.coalesce("own", F.lit(0.0)) / F.greatest("prediction", F.lit(1e-8))
    return met.agg(F.count("*").alias("n"), F.avg(F.col("weight") * part * part).alias("energy"))


def accepted(before: Column, after: Column, bytes_added: Column, price: float, least_gain: float = 0.0) -> Column:
    """Whether a change of the tree stays: it must lower loss + price * bytes by more than `least_gain`."""
    return before - after - price * bytes_added > least_gain
