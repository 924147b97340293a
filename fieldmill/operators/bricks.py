"""Dense volumes kept in bricks: trilinear samples and projections without a join for every voxel that a sample touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rays import RAY, with_geometry

BRICK = ["brick_x", "brick_y", "brick_z"]


def bricks(volume: DataFrame, axes: Sequence[str], value: str, n: int, edge: int = 8) -> DataFrame:
    """A dense volume of n ** 3 voxels as rows (brick_x, brick_y, brick_z, values) of (edge + 1) ** 3 voxels each.

    A brick has the first layers of the bricks after it as a halo, so that a sample needs one brick alone; past the volume's end its last layer goes on. A voxel is
    written eight times at most, and only where bricks meet.
    """
    out = volume
    for a, b in zip(axes, "xyz"):
        own, inside = F.expr(f"{a} div {edge}"), F.expr(f"{a} % {edge}")
        at = lambda brick, place: F.struct(brick.alias("brick"), place.alias("place"))
        before = F.when((inside == 0) & (F.col(a) > 0), F.array(at(own - 1, F.lit(edge).cast("long")))).otherwise(F.array().cast("array<struct<brick:bigint,place:bigint>>"))
        beyond = F.when(F.col(a) == n - 1, F.transform(F.sequence(F.lit(1).cast("long"), edge - inside), lambda k: at(own, inside + k))).otherwise(F.array().cast("array<struct<brick:bigint,place:bigint>>"))
        out = out.select("*", F.inline(F.concat(F.array(at(own, inside)), before, beyond)).alias(f"brick_{b}", f"_{b}"))
    place = (F.col("_x") * (edge + 1) + F.col("_y")) * (edge + 1) + F.col("_z")
    put = out.groupBy(*BRICK).agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), F.col(value).cast("double").alias("v")))).alias("_v"))  # (edge + 1) ** 3 of each
    return put.select(*BRICK, F.transform("_v", lambda v: v["v"]).alias("values"))


def _grid(at: Column, n: int) -> Column:
    """A coordinate of the box in voxels: 0 at the first centre."""
    return (at + 1.0) * (0.5 * n) - 0.5


def _trilinear(values: Column, edge: int, place: list[Column]) -> Column:
    """A brick's value at places counted in voxels from its first."""
    whole = [F.floor(p).cast("int") for p in place]
    part = [p - w for p, w in zip(place, whole)]
    e = edge + 1
    corner = lambda i, j, k: F.get(values, ((whole[0] + i) * e + whole[1] + j) * e + whole[2] + k)
    mix = lambda a, b, t: a * (1.0 - t) + b * t
    along_x = {(j, k): mix(corner(0, j, k), corner(1, j, k), part[0]) for j in (0, 1) for k in (0, 1)}
    along_y = {k: mix(along_x[0, k], along_x[1, k], part[1]) for k in (0, 1)}
    return mix(along_y[0], along_y[1], part[2])


def _in_volume(places: list[Column], n: int) -> Column:
    out = F.lit(True)
    for p in places:
        out = out & (p >= 0.0) & (p <= n - 1.0)
    return out


def sample(points: DataFrame, held: DataFrame, n: int, edge: int = 8) -> DataFrame:
    """Points x, y, z with the volume's trilinear value; 0 beyond the outermost voxel centres."""
    placed = points.withColumns({f"_g{a}": _grid(F.col(a), n) for a in "xyz"})
    spots = [F.col(f"_g{a}") for a in "xyz"]
    keyed = placed.withColumn("_in", _in_volume(spots, n)).withColumns({b: F.when(F.col("_in"), F.expr(f"cast(floor({s}) as bigint) div {edge}")) for b, s in zip(BRICK, ("_gx", "_gy", "_gz"))})
    met = keyed.join(held, BRICK, "left")
    value = _trilinear(F.col("values"), edge, [s - F.col(b) * edge for s, b in zip(spots, BRICK)])
    return met.withColumn("value", F.when(F.col("_in"), value).otherwise(0.0)).drop("values", "_in", "_gx", "_gy", "_gz", *BRICK)


def project(rays: DataFrame, held: DataFrame, n: int, size: int, views: int, samples: int, edge: int = 8) -> DataFrame:
    """(view_id, row, col, prediction): midpoint sums of a dense volume along distinct rays.

    A ray meets each brick on its way once: what is joined and shuffled are rays and bricks, not samples, and the samples of a brick are
    folded within the row.
    """
    samples = max(1, samples)
    ways = with_geometry(rays.select(*RAY).distinct(), size, views).withColumn("h", (F.col("t1") - F.col("t0")) / samples)
    t = lambda s: F.col("t0") + (s + 0.5) * F.col("h")
    ways = ways.withColumns({"_gz": _grid(F.col("z"), n), "_p": F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda s: F.struct(_grid(F.col("bx") + F.col("dx") * t(s), n).alias("x"), _grid(F.col("by") + F.col("dy") * t(s), n).alias("y")))})
    inside = F.filter("_p", lambda p: _in_volume([p["x"], p["y"], F.col("_gz")], n))
    part = lambda v: (F.floor(v) / edge).cast("long")
    placed = F.transform(inside, lambda p: F.struct(part(p["x"]).alias("brick_x"), part(p["y"]).alias("brick_y"), p["x"].alias("x"), p["y"].alias("y")))
    ways = ways.where("t1 > t0").withColumn("_p", placed).withColumn("brick_z", part(F.col("_gz")))
    each = ways.withColumn("_b", F.explode(F.array_distinct(F.transform("_p", lambda p: F.struct(p["brick_x"].alias("brick_x"), p["brick_y"].alias("brick_y"))))))
    own = F.transform(F.filter("_p", lambda p: (p["brick_x"] == F.col("_b.brick_x")) & (p["brick_y"] == F.col("_b.brick_y"))), lambda p: F.struct((p["x"] - F.col("_b.brick_x") * edge).alias("x"), (p["y"] - F.col("_b.brick_y") * edge).alias("y")))
    rows = each.select(*RAY, "h", (F.col("_gz") - F.col("brick_z") * edge).alias("_z"), F.col("_b.brick_x").alias("brick_x"), F.col("_b.brick_y").alias("brick_y"), "brick_z", own.alias("_p"))
    met = rows.join(held, BRICK)
    total = F.aggregate("_p", F.lit(0.0), lambda s, p: s + _trilinear(F.col("values"), edge, [p["x"], p["y"], F.col("_z")]))
    sums = met.select(*RAY, (total * F.col("h")).alias("part")).groupBy(*RAY).agg(F.sum("part").alias("prediction"))
    return rays.select(*RAY).distinct().join(sums, RAY, "left").withColumn("prediction", F.coalesce("prediction", F.lit(0.0)))
