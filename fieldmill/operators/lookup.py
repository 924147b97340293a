"""Point to leaf lookup and evaluation of the piecewise polynomial field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bernstein_row, cell_of, inside_box

KEY = ["level", "ix", "iy", "iz"]
#: Leaves that may be sent to every executor: about 100 MB of keys and coefficients at most.
MOST_SENT = 500_000


def sendable(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """Mark a table for broadcast if a count shows that it is small; otherwise the join shuffles on its keys."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def candidate_cells(points: DataFrame, levels: Sequence[int]) -> DataFrame:
    """Each point inside the closed box with its cell at every level (one of them is a leaf)."""
    cells = [F.struct(F.lit(level).cast("long").alias("level"), *(cell_of(F.col(a), n).alias(f"i{a}") for a in "xyz")) for level, n in enumerate(levels)]
    return points.where(inside_box(F.col("x"), F.col("y"), F.col("z"))).select("*", F.inline(F.array(*cells)))


def locate(points: DataFrame, leaves: DataFrame, levels: Sequence[int]) -> DataFrame:
    """Points joined with their leaf: one equi-join on (level, ix, iy, iz), whatever the number of levels.

    Points outside the closed box match nothing and are dropped.
    """
    return candidate_cells(points, levels).join(sendable(leaves), KEY)


def resolution(level, levels: Sequence[int]):
    out = F.lit(float(levels[-1]))
    for k, n in enumerate(levels):
        out = F.when(level == k, float(n)).otherwise(out)
    return out


def local(axis: str, levels: Sequence[int], at: str | None = None):
    """A coordinate within its leaf's cell, in [0, 1] up to rounding."""
    return (F.col(at or axis) + 1.0) * resolution(F.col("level"), levels) / 2.0 - F.col(f"i{axis}")


def terms(located: DataFrame, levels: Sequence[int], coeffs: str = "coeffs") -> DataFrame:
    """One row per point and coefficient, with the basis value; sums of c * basis give the field.

    The basis of each axis is worked out once per point; coefficients are then exploded and multiplied as plain
    columns, in generated code small enough to be compiled.
    """
    placed = located.withColumns({f"_t{a}": F.least(F.greatest(local(a, levels), F.lit(0.0)), F.lit(1.0)) for a in "xyz"})
    based = placed.withColumns({f"_b{a}": bernstein_row(F.col(f"p{a}"), F.col(f"_t{a}")) for a in "xyz"}).drop("_tx", "_ty", "_tz")
    rows = based.select("*", F.posexplode(coeffs).alias("_k", "c")).drop(coeffs)
    k = F.col("_k").cast("long")
    spot = {"x": F.expr("cast(_k div ((pz + 1) * (py + 1)) as int)"), "y": F.expr("cast((_k div (pz + 1)) % (py + 1) as int)"), "z": F.expr("cast(_k % (pz + 1) as int)")}
    basis = F.get("_bx", spot["x"]) * F.get("_by", spot["y"]) * F.get("_bz", spot["z"])
    return rows.withColumn("basis", basis).withColumn("coefficient", k).drop("_k", "_bx", "_by", "_bz")


def evaluate(points: DataFrame, leaves: DataFrame, levels: Sequence[int], key: list[str]) -> DataFrame:
    """(key, value) of the field at points that `key` tells apart."""
    return terms(locate(points, leaves, levels), levels).groupBy(*key).agg(F.sum(F.col("c") * F.col("basis")).alias("value"))


def dense_grid(spark, n: int, plane: tuple[str, int] | None = None) -> DataFrame:
    """Voxel centres of an n-cube, or of one plane of it: gx, gy, gz, x, y, z."""
    grid = spark.range(n**3).selectExpr(f"id div {n * n} as gx", f"(id div {n}) % {n} as gy", f"id % {n} as gz")
    if plane:
        grid = grid.where(F.col(f"g{plane[0]}") == plane[1])
    return grid.select("*", *((-1.0 + (F.col(f"g{a}") + 0.5) * (2.0 / n)).alias(a) for a in "xyz"))
