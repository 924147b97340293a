"""Statistics and ranked listings of the leaf tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import KEY, resolution

NODE_BYTES, DEGREE_BYTES, COEFFICIENT_BYTES = 8, 3, 2


def with_mean(leaves: DataFrame) -> DataFrame:
    """Leaves with the mean of their coefficients as mu."""
    return leaves.withColumn("mu", F.aggregate("coeffs", F.lit(0.0), lambda s, x: s + x) / F.size("coeffs"))


def packed_bytes():
    return NODE_BYTES + DEGREE_BYTES + COEFFICIENT_BYTES * F.size("coeffs")


def level_stats(leaves: DataFrame, levels: Sequence[int]) -> DataFrame:
    """Leaves, coefficients, packed bytes and cell width per level."""
    per = leaves.groupBy("level").agg(F.count("*").alias("leaves"), F.sum(F.size("coeffs")).alias("coefficients"), F.sum(packed_bytes()).alias("packed_bytes"))
    return per.withColumn("cell", 2.0 / resolution(F.col("level"), levels))


def top_leaves(leaves: DataFrame, n: int, least: float) -> DataFrame:
    """The n leaves of highest mean of those with a mean of `least` or more; of all leaves if none has."""
    means = with_mean(leaves)
    enough = means.where(F.col("mu") >= least)
    chosen = enough if enough.limit(1).count() else means
    return chosen.orderBy(F.desc("mu"), *KEY).limit(n)


def ancestors(leaves: DataFrame) -> DataFrame:
    """Distinct internal nodes: every proper ancestor of a leaf."""
    up = leaves.where("level > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("level") - 1)).alias("up"))
    shift = lambda c: F.expr(f"shiftright({c}, cast(level - up as int))")
    return up.select(F.col("up").cast("long").alias("level"), *(shift(c).alias(c) for c in KEY[1:])).distinct()


def sibling_groups(leaves: DataFrame) -> DataFrame:
    """Parents whose eight children are all leaves."""
    half = [F.expr(f"{c} div 2").alias(c) for c in KEY[1:]]
    return leaves.where("level > 0").groupBy((F.col("level") - 1).alias("level"), *half).agg(F.count("*").alias("children")).where("children = 8").drop("children")


def _face_mean(axis: int, side: int) -> Column:
    """Mean coefficient on one face of a leaf, within the row."""
    a = "xyz"[axis]
    stride = {"x": "(py + 1) * (pz + 1)", "y": "(pz + 1)", "z": "1"}[a]
    on = f"filter(sequence(0, size(coeffs) - 1), k -> (k div ({stride})) % (p{a} + 1) = {'0' if side == 0 else f'p{a}'})"
    return F.expr(f"aggregate({on}, 0D, (s, k) -> s + coeffs[k]) / size({on})")


def _mean_on(face: Column) -> Column:
    """Mean coefficient on the face of that number: axis * 2 + side."""
    out = None
    for k in range(6):
        mean = _face_mean(k // 2, k % 2)
        out = F.when(face == k, mean) if out is None else out.when(face == k, mean)
    return out


def face_neighbours(leaves: DataFrame, levels: Sequence[int]) -> DataFrame:
    """Leaf faces with the leaf on the other side: key, axis (0-2), side (0 low, 1 high), the face's mean as own_mean, neighbour key, degrees and coefficients.

    A probe a little beyond the middle of each face is located; faces on the box have no neighbour.
    """
    from .lookup import locate

    res = resolution(F.col("level"), levels)
    probes = leaves.select(*KEY, *(F.col(f"p{a}") for a in "xyz"), "coeffs", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("face")).withColumns({"axis": F.expr("cast(face div 2 as bigint)"), "side": F.expr("cast(face % 2 as bigint)"), "own_mean": _mean_on(F.col("face"))})
    sign = F.when(F.col("side") == 1, 1.0).otherwise(-1.0)
    for k, a in enumerate("xyz"):
        middle = -1.0 + (F.col(f"i{a}") + 0.5) * (2.0 / res)
        probes = probes.withColumn(a, F.when(F.col("axis") == k, middle + sign * (1.0 / res + 1e-5)).otherwise(middle))
    own = probes.select(*(F.col(c).alias(f"own_{c}") for c in KEY), *(F.col(f"p{a}").alias(f"own_p{a}") for a in "xyz"), "own_mean", "axis", "side", "x", "y", "z")
    return locate(own, leaves.select(*KEY, "coeffs", "px", "py", "pz"), levels)


def interface_jumps(leaves: DataFrame, levels: Sequence[int]) -> DataFrame:
    """Largest jump of face means across the two faces of each axis: key, axis, jump (0 without neighbours).

    A face's own mean goes along with its probe and its neighbour's is taken from the block that the probe meets, so that the one join is that of the probes.
    """
    met = face_neighbours(leaves, levels)
    other = _mean_on((F.col("axis") * 2 + 1 - F.col("side")).cast("int"))
    jumps = met.groupBy(*(F.col(f"own_{c}").alias(c) for c in KEY), "axis").agg(F.max(F.abs(F.col("own_mean") - other)).alias("jump"))
    all_axes = leaves.select(*KEY, F.explode(F.array(*(F.lit(k).cast("long") for k in range(3)))).alias("axis"))
    return all_axes.join(jumps, [*KEY, "axis"], "left").withColumn("jump", F.coalesce("jump", F.lit(0.0)))
