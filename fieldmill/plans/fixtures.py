"""The field model's tables, bound to the driver's tables by arithmetic alone (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import to_mu
from ..tables import table

#: Cells per axis at each level of the fixture tree.
LEVELS = (4, 8, 16)
SIZE = 16
VIEWS = 12


def _take(e: Column, spots: list[Column]) -> Column:
    return F.array(*(F.element_at(e, s.cast("int")).cast("double") for s in spots))


def _spot(i, j, k) -> Column:
    return (F.lit(i) if isinstance(i, int) else i) * 16 + (F.lit(j) if isinstance(j, int) else j) * 4 + k + 1


def logit_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf tree: level, ix, iy, iz, px, py, pz, logits."""
    e = F.col("embedding")
    roots = table(spark, sf_dir, "embeddings").where("vec_id < 64").select(
        "vec_id", F.col("label").cast("long").alias("label"), "embedding",
        F.expr("vec_id div 16").alias("ix"), F.expr("(vec_id div 4) % 4").alias("iy"), (F.col("vec_id") % 4).alias("iz"))
    corners = [_spot(a, b, F.lit(c)) for a in (0, 3) for b in (0, 3) for c in (0, 3)]
    degree = F.when(F.col("label") <= 1, 0).when(F.col("label") <= 3, 1).otherwise(3).cast("long")
    top = roots.where("label < 5").select(
        F.lit(0).cast("long").alias("level"), "ix", "iy", "iz", degree.alias("d"),
        F.when(degree == 0, _take(e, [F.lit(1)])).when(degree == 1, _take(e, corners)).otherwise(F.transform(e, lambda x: x.cast("double"))).alias("logits"))
    kids = roots.where("label >= 5").withColumn("oc", F.explode(F.sequence(F.lit(0), F.lit(7)))).selectExpr(
        "*", "cast(oc div 4 as bigint) ox", "cast((oc div 2) % 2 as bigint) oy", "cast(oc % 2 as bigint) oz", "(vec_id * 8 + oc + label) % 5 = 0 as cut")
    ox, oy, oz = F.col("ox"), F.col("oy"), F.col("oz")
    eight = [_spot(2 * ox + a, 2 * oy + b, 2 * oz + c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    kid_degree = F.expr("(vec_id + oc + 1) % 2").cast("long")
    mid = kids.where("not cut").select(
        F.lit(1).cast("long").alias("level"), (2 * F.col("ix") + ox).alias("ix"), (2 * F.col("iy") + oy).alias("iy"), (2 * F.col("iz") + oz).alias("iz"),
        kid_degree.alias("d"), F.when(kid_degree == 0, _take(e, eight[:1])).otherwise(_take(e, eight)).alias("logits"))
    last = kids.where("cut").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(7)))).selectExpr(
        "*", "cast(g div 4 as bigint) gx", "cast((g div 2) % 2 as bigint) gy", "cast(g % 2 as bigint) gz")
    gx, gy, gz = F.col("gx"), F.col("gy"), F.col("gz")
    low = last.select(
        F.lit(2).cast("long").alias("level"), (4 * F.col("ix") + 2 * ox + gx).alias("ix"), (4 * F.col("iy") + 2 * oy + gy).alias("iy"), (4 * F.col("iz") + 2 * oz + gz).alias("iz"),
        F.lit(0).cast("long").alias("d"), _take(e, [_spot(2 * ox + gx, 2 * oy + gy, 2 * oz + gz)]).alias("logits"))
    return top.union(mid).union(low).select("level", "ix", "iy", "iz", F.col("d").alias("px"), F.col("d").alias("py"), F.col("d").alias("pz"), "logits")


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf tree with attenuation coefficients: level, ix, iy, iz, px, py, pz, coeffs."""
    return logit_leaves(spark, sf_dir).select("level", "ix", "iy", "iz", "px", "py", "pz", F.transform("logits", lambda x: to_mu(x)).alias("coeffs"))


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ray_id, view_id, row, col, target, split, ts."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as ray_id", "user_id % 12 as view_id", "event_id % 16 as row", "(event_id div 16) % 16 as col", "value / 500.0D as target",
        "case when (user_id % 12) % 4 = 3 then 'test' else 'train' end as split", "ts")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z, target; rows may repeat."""
    at = "-1.0D + 2.0D * (({0} % 64) + 0.5D) / 64.0D"
    return table(spark, sf_dir, "lineitem").selectExpr(at.format("l_partkey") + " as x", at.format("l_orderkey") + " as y", at.format("l_suppkey") + " as z", "l_quantity / 50.0D as target")


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample grids of the candidate bank: node, at (0 to 63, last axis fastest), v."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.posexplode("embedding").alias("at", "e"))
    return e.select("node", F.col("at").cast("long").alias("at"), to_mu(F.col("e").cast("double")).alias("v"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense mean-target images: view_id, row, col, v; pixels without rays are 0."""
    ids = lambda n, name: spark.range(n).withColumnRenamed("id", name)
    frame = spark.range(VIEWS * SIZE * SIZE).selectExpr("id div 256 as view_id", "(id div 16) % 16 as row", "id % 16 as col")
    means = rays(spark, sf_dir).groupBy("view_id", "row", "col").agg(F.avg("target").alias("m"))
    return frame.join(means, ["view_id", "row", "col"], "left").select("view_id", "row", "col", F.coalesce("m", F.lit(0.0)).alias("v"))
