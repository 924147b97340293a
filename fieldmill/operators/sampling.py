"""Row generators for fitting: detector subsets, drawn rays and voxels, held-out views, masks with a halo.

Draws are arithmetic on the draw's number, so a draw is the same after a lost executor and in any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import running_totals

#: Draws are numbers of so many hexadecimal digits: 60 bits.
DIGITS = 15


def drawn(number: Column, below: Column, seed: int) -> Column:
    """A number from 0 up to `below`, drawn with replacement by the draw's number and the seed: 60 bits of the MD5 of both."""
    mixed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), number.cast("string"))), 1, DIGITS), 16, 10)
    return mixed.cast("long") % below


def spaced(spark: SparkSession, size: int, count: int | None) -> DataFrame:
    """(i, at): `count` evenly spaced places of `size`, both ends included, rounded half to even; all where count is no less."""
    if count is None or count >= size:
        return spark.range(size).select(F.col("id").alias("i"), F.col("id").alias("at"))
    count = max(1, count)
    at = F.rint(F.col("id") * ((size - 1) / max(1, count - 1))).cast("long")
    return spark.range(count).select(F.col("id").alias("i"), at.alias("at"))


def uniform_rays(spark: SparkSession, count: int, views: int, size: int, seed: int) -> DataFrame:
    """(draw, view_id, row, col): rays drawn with replacement from all views and pixels."""
    n = F.lit(views * size * size)
    return spark.range(count).select(F.col("id").alias("draw"), drawn(F.col("id"), n, seed).alias("n")).selectExpr("draw", f"n div {size * size} as view_id", f"(n div {size}) % {size} as row", f"n % {size} as col")


def stratified_rays(spark: SparkSession, count: int, views: int, size: int, seed: int, batch: int) -> DataFrame:
    """(draw, view_id, row, col): views in turn, begun at the batch's number, and pixels drawn with replacement."""
    pixel = drawn(F.col("id"), F.lit(size * size), seed + batch)
    return spark.range(count).select(F.col("id").alias("draw"), ((F.col("id") + batch) % views).alias("view_id"), pixel.alias("p")).selectExpr("draw", "view_id", f"p div {size} as row", f"p % {size} as col")


def held_out_views(rays: DataFrame, share: float, seed: int) -> DataFrame:
    """(view_id, held_out): the views of least hash are held out, one at least and all but one at most.

    What ranks views is one row each.
    """
    views = rays.select("view_id").distinct().withColumn("draw", -drawn(F.col("view_id"), F.lit(1 << 60), seed))
    n = views.count()
    held = max(1, min(n - 1, round(n * share)))
    return running_totals(views, "draw", ["view_id"], {"place": F.lit(1)}).select("view_id", (F.col("place") <= held).alias("held_out"))


def volume_pools(voxels: DataFrame, value: str, gradient: str, least: float, quantile: float = 0.9) -> DataFrame:
    """Voxels with `material` (over the threshold) and `boundary` (material of a gradient in the material's top quantile)."""
    edge = voxels.where(F.col(value) > least).agg(F.percentile(gradient, quantile).alias("_edge"))
    marked = voxels.crossJoin(F.broadcast(edge))  # one row
    material = F.col(value) > least
    return marked.select(*voxels.columns, material.alias("material"), (material & F.coalesce(F.col(gradient) >= F.col("_edge"), F.lit(False))).alias("boundary"))


def pool_counts(count: int, sizes: dict[str, int], material: float, boundary: float) -> dict[str, int]:
    """How many are drawn from each pool; what an empty pool can't give goes to the background, or to all voxels where that is empty too."""
    edge = min(count, max(0, round(count * boundary)))
    core = min(count - edge, max(0, round(count * material)))
    wanted = {"boundary": edge, "material": core}
    out = {k: n for k, n in wanted.items() if n and sizes[k]}
    rest = count - sum(out.values())
    return out | ({("background" if sizes["background"] else "all"): rest} if rest else {})


def sample_volume(pools: DataFrame, key: list[str], count: int, seed: int, material: float = 0.5, boundary: float = 0.25) -> DataFrame:
    """(pool, draw, key, ...): voxels drawn with replacement from their pools; each pool's voxels are numbered once in key order."""
    spark, inside = pools.sparkSession, {"boundary": F.col("boundary"), "material": F.col("material"), "background": ~F.col("material"), "all": F.lit(True)}
    sizes = pools.agg(*(F.count_if(c).alias(k) for k, c in inside.items())).first().asDict()
    out = None
    for k, (pool, many) in enumerate(pool_counts(count, sizes, material, boundary).items()):
        numbered = running_totals(pools.where(inside[pool]).withColumn("_same", F.lit(0.0)), "_same", key, {"_place": F.lit(1)})
        draws = spark.range(many).select(F.lit(pool).alias("pool"), F.col("id").alias("draw"), (drawn(F.col("id"), F.lit(sizes[pool]), seed + k) + 1).alias("_place"))
        some = draws.join(numbered, "_place").drop("_place", "_same", "material", "boundary")
        out = some if out is None else out.unionByName(some)
    return out


def with_halo(cells: DataFrame, axes: Sequence[str], size: int, radius: int) -> DataFrame:
    """Distinct cells within `radius` of the given ones on every axis, as far as they lie in the grid."""
    out = cells.select(*axes)
    for a in axes:  # one axis after the other: a row becomes 2 * radius + 1, then equal ones meet
        moved = out.select(*(c for c in axes if c != a), F.explode(F.sequence(F.greatest(F.col(a) - radius, F.lit(0)), F.least(F.col(a) + radius, F.lit(size - 1)))).alias(a))
        out = moved.select(*axes).distinct()
    return out


def parents_to_split(scores: DataFrame, axes: Sequence[str], score: str, size: int, fraction: float, halo: int) -> DataFrame:
    """Cells one level up that hold one of the top-scored fraction of cells or its halo; at least one cell is taken."""
    k = max(1, int(size ** len(axes) * fraction))
    best = running_totals(scores, score, list(axes), {"_place": F.lit(1)}).where(F.col("_place") <= k)
    return with_halo(best, axes, size, halo).select(*(F.expr(f"{a} div 2").alias(a) for a in axes)).distinct()


def edge_pairs(images: DataFrame, value: str, count: int, views: int, size: int, seed: int, strides: Sequence[int] = (1, 2, 4), uniform: float = 0.5, oversampled: int = 8) -> DataFrame:
    """Pairs of pixels a stride apart: (draw, view_id, row, col, row_b, col_b, stride, a, b, derivative, midpoint, biased).

    A share is drawn uniformly; the rest are the steepest of a pool `oversampled` times as large, found by rank in ranges, not by one sort. View, direction,
    stride and place are draws of their own, so that each direction and stride is as likely as any other whatever room it has.
    """
    if count < 1 or not strides or min(strides) < 1 or max(strides) >= size or not 0.0 <= uniform <= 1.0:
        raise ValueError("count and strides must be positive, strides fit into the detector, and the uniform share lie in [0, 1]")
    even = min(count, round(count * uniform))
    steep = count - even
    number = F.col("draw")
    draws = images.sparkSession.range(even + max(steep, steep * max(1, oversampled))).withColumnRenamed("id", "draw")
    draws = draws.withColumns({"view_id": drawn(number, F.lit(views), seed), "_down": drawn(number, F.lit(2), seed + 1) == 0, "stride": F.element_at(F.array(*(F.lit(s).cast("long") for s in strides)), (drawn(number, F.lit(len(strides)), seed + 2) + 1).cast("int"))})
    step = {"row": F.when(F.col("_down"), F.col("stride")).otherwise(0), "col": F.when(F.col("_down"), 0).otherwise(F.col("stride"))}
    draws = draws.withColumns({k: drawn(number, size - step[k], seed + 3 + i) for i, k in enumerate(step)})
    draws = draws.withColumns({f"{k}_b": F.col(k) + step[k] for k in step})
    other = images.select("view_id", F.col("row").alias("row_b"), F.col("col").alias("col_b"), F.col(value).alias("b"))
    met = draws.join(images.select("view_id", "row", "col", F.col(value).alias("a")), ["view_id", "row", "col"]).join(other, ["view_id", "row_b", "col_b"])
    met = met.withColumns({"derivative": (F.col("b") - F.col("a")) / F.col("stride"), "midpoint": 0.5 * (F.col("a") + F.col("b")), "biased": F.col("draw") >= even})
    ranked = running_totals(met.where("biased"), [F.desc(F.abs(F.col("derivative")))], ["draw"], {"_place": F.lit(1)})
    return met.where("not biased").unionByName(ranked.where(F.col("_place") <= steep).drop("_place")).drop("_down")
