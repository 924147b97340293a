"""Inspection and integration queries: tree statistics, point values, slices, ray facts, residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookup, metrics, rays as ray_ops, tree
from . import fixtures as fx
from . import oracles as o

L, N, V = fx.LEVELS, fx.SIZE, fx.VIEWS
KEY = lookup.KEY


def r6(c):
    return F.round(c, 6)


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return ray_ops.ray_cell_contributions(fx.rays(spark, sf), fx.leaves(spark, sf), L, N, V)


def predicted(spark: SparkSession, sf: str, made: DataFrame | None = None) -> DataFrame:
    return ray_ops.predictions(fx.rays(spark, sf), facts(spark, sf) if made is None else made)


def leaf_level_stats(spark, sf):
    return tree.level_stats(fx.leaves(spark, sf), L).select("level", "leaves", "coefficients", "packed_bytes", r6("cell").alias("cell"))


def leaf_mean_mu(spark, sf):
    return tree.with_mean(fx.leaves(spark, sf)).select(*KEY, r6("mu").alias("mu"))


def leaf_topn_min_mu(spark, sf):
    return tree.top_leaves(fx.leaves(spark, sf), 50, 0.06).select(*KEY, r6("mu").alias("mu"))


def leaf_topn_fallback(spark, sf):
    return tree.top_leaves(fx.leaves(spark, sf), 20, 99.0).select(*KEY, r6("mu").alias("mu"))


def tensor_stats(spark, sf):
    c = fx.leaves(spark, sf).select(F.explode("coeffs").alias("v"))
    return metrics.array_stats(c, "v").select("n", *(r6(x).alias(x) for x in ("lo", "hi", "mean", "p95")))


def int_histogram(spark, sf):
    c = fx.leaves(spark, sf).select((F.col("px") * 2 - 1).alias("v"))
    return metrics.int_histogram(c, "v", 6)


def degree_tuples(spark, sf):
    return fx.leaves(spark, sf).select("px", "py", "pz").distinct()


def point_lookup(spark, sf):
    return lookup.locate(fx.points(spark, sf), fx.leaves(spark, sf), L).groupBy(*KEY).agg(F.count("*").alias("points"), F.round(F.sum("target"), 4).alias("target"))


def point_eval(spark, sf):
    spots = fx.points(spark, sf).groupBy("x", "y", "z").agg(F.count("*").alias("n"), F.sum("target").alias("target"))
    terms = lookup.terms(lookup.locate(spots, fx.leaves(spark, sf), L), L)
    values = terms.groupBy("x", "y", "z", "level", "ix", "iy", "iz", "px", "n", "target").agg(F.sum(F.col("c") * F.col("basis")).alias("value"))
    return values.groupBy("level", "px").agg(F.sum("n").alias("points"), F.round(F.sum(F.col("value") * F.col("n")), 4).alias("total"), F.round(F.sum(F.abs(F.col("value") - F.col("target") / F.col("n"))), 4).alias("off"))


def slice_decode(spark, sf):
    plane = lookup.dense_grid(spark, N, ("z", 5))
    return lookup.evaluate(plane, fx.leaves(spark, sf), L, ["gx", "gy"]).select("gx", "gy", r6("value").alias("value"))


def dense_decode(spark, sf):
    return lookup.evaluate(lookup.dense_grid(spark, N), fx.leaves(spark, sf), L, ["gx", "gy", "gz"]).select("gx", "gy", "gz", r6("value").alias("value"))


def ray_box(spark, sf):
    g = ray_ops.with_geometry(fx.rays(spark, sf).select("view_id", "row", "col").distinct(), N, V)
    return g.select("view_id", "row", "col", r6("t0").alias("t0"), r6("t1").alias("t1"))


def sampled_prediction(spark, sf):
    return ray_ops.sampled_predictions(fx.rays(spark, sf), fx.leaves(spark, sf), L, N, V, 32).select("view_id", "row", "col", F.round("prediction", 5).alias("prediction"))


def ray_cell_fact(spark, sf):
    return facts(spark, sf).select(*ray_ops.RAY, *KEY, r6("integral").alias("integral"))


def ray_prediction(spark, sf):
    return predicted(spark, sf).select("ray_id", r6("prediction").alias("prediction"))


def residual_metrics(spark, sf):
    return metrics.projection_metrics(predicted(spark, sf), "view_id").select("view_id", "n", r6("mae").alias("mae"), F.round("psnr", 4).alias("psnr"))


def render_split(spark, sf):
    """All pixels of the test views."""
    grid = spark.range(V * N * N).selectExpr("id div 256 as view_id", "(id div 16) % 16 as row", "id % 16 as col").where("view_id % 4 = 3")
    made = ray_ops.ray_cell_contributions(grid, fx.leaves(spark, sf), L, N, V)
    return ray_ops.predictions(grid, made).select("view_id", "row", "col", r6("prediction").alias("prediction"))


QUERIES = {f.__name__: f for f in (leaf_level_stats, leaf_mean_mu, leaf_topn_min_mu, leaf_topn_fallback, tensor_stats, int_histogram, degree_tuples, point_lookup, point_eval, slice_decode, dense_decode, ray_box, sampled_prediction, ray_cell_fact, ray_prediction, residual_metrics, render_split)}

_TOP = "WITH {leaves}, means AS (SELECT level, ix, iy, iz, list_avg(mu) AS m FROM leaves), flagged AS (SELECT *, max(m >= {least}) OVER () AS any_ok FROM means) SELECT level, ix, iy, iz, round(m, 6) AS mu FROM flagged WHERE m >= {least} OR NOT any_ok ORDER BY m DESC, level, ix, iy, iz LIMIT {n}"
_GRID_ENTER, _GRID_LEAVE, _GRID_OK = o.slab("-1.0", "1.0", "-1.0", "1.0")

ORACLES = {
    "leaf_level_stats": f"WITH {o.LEAVES} SELECT level, count(*) AS leaves, sum(len(mu))::BIGINT AS coefficients, sum(8+3+2*len(mu))::BIGINT AS packed_bytes, round(2.0/(4*2**level), 6) AS cell FROM leaves GROUP BY level",
    "leaf_mean_mu": f"WITH {o.LEAVES} SELECT level, ix, iy, iz, round(list_avg(mu), 6) AS mu FROM leaves",
    "leaf_topn_min_mu": _TOP.format(leaves=o.LEAVES, least=0.06, n=50),
    "leaf_topn_fallback": _TOP.format(leaves=o.LEAVES, least=99.0, n=20),
    "tensor_stats": f"WITH {o.LEAVES}, c AS (SELECT unnest(mu) AS v FROM leaves) SELECT count(*) AS n, round(min(v),6) AS lo, round(max(v),6) AS hi, round(avg(v),6) AS mean, round(quantile_cont(v,0.95),6) AS p95 FROM c",
    "int_histogram": f"WITH {o.LEAVES} SELECT b AS bin, count(d) AS n FROM range(6) t(b) LEFT JOIN leaves ON greatest(2*d-1, 0) = b GROUP BY b",
    "degree_tuples": f"WITH {o.LEAVES} SELECT DISTINCT d AS px, d AS py, d AS pz FROM leaves",
    "point_lookup": f"WITH {o.LEAVES}, {o.POINTS} SELECT level, ix, iy, iz, count(*) AS points, round(sum(target), 4) AS target FROM points p JOIN leaves l ON floor((p.x+1)*l.res/2)=l.ix AND floor((p.y+1)*l.res/2)=l.iy AND floor((p.z+1)*l.res/2)=l.iz GROUP BY ALL",
    "point_eval": f"WITH {o.LEAVES}, {o.COEFFS}, {o.POINTS}, spots AS (SELECT x, y, z, count(*) AS n, sum(target) AS target FROM points GROUP BY ALL), {o.value_at('spots')} SELECT v.level, l.d AS px, sum(n)::BIGINT AS points, round(sum(value*n), 4) AS total, round(sum(abs(value-target/n)), 4) AS off FROM values_at v JOIN leaves l USING (level, ix, iy, iz) GROUP BY ALL",
    "slice_decode": f"WITH {o.LEAVES}, {o.COEFFS}, {o.DENSE}, plane AS (SELECT * FROM dense WHERE gz = 5), {o.value_at('plane')} SELECT gx, gy, round(value, 6) AS value FROM values_at",
    "dense_decode": f"WITH {o.LEAVES}, {o.COEFFS}, {o.DENSE}, {o.value_at('dense')} SELECT gx, gy, gz, round(value, 6) AS value FROM values_at",
    "ray_box": f"WITH {o.RAYS}, {o.GEOMETRY}, b AS (SELECT *, {_GRID_ENTER} AS lo, {_GRID_LEAVE} AS hi, {_GRID_OK} AS ok FROM ways) SELECT view_id, row, col, round(CASE WHEN ok AND hi > lo THEN lo ELSE 0 END, 6) AS t0, round(CASE WHEN ok AND hi > lo THEN hi ELSE 0 END, 6) AS t1 FROM b",
    "ray_cell_fact": f"WITH {o.ALL_FACTS} SELECT view_id, row, col, level, ix, iy, iz, round(integral, 6) AS integral FROM facts",
    "ray_prediction": f"WITH {o.PREDICTED} SELECT ray_id, round(prediction, 6) AS prediction FROM predicted",
    "residual_metrics": f"WITH {o.PREDICTED} SELECT view_id, count(*) AS n, round(avg(abs(prediction-target)), 6) AS mae, round(20*log10(greatest(max(target),1e-8)) - 10*log10(greatest(avg((prediction-target)**2),1e-20)), 4) AS psnr FROM predicted GROUP BY view_id",
    "sampled_prediction": f"WITH {o.LEAVES}, {o.COEFFS}, {o.RAYS}, {o.GEOMETRY}, b AS (SELECT *, {_GRID_ENTER} AS lo, {_GRID_LEAVE} AS hi, {_GRID_OK} AS ok FROM ways), spots AS (SELECT view_id, row, col, (hi-lo)/32 AS h, bx+dx*(lo+(i+0.5)*(hi-lo)/32) AS x, byy+dy*(lo+(i+0.5)*(hi-lo)/32) AS y, z FROM b, range(32) t(i) WHERE ok AND hi > lo), {o.value_at('spots')} SELECT view_id, row, col, round(sum(value*h), 5) AS prediction FROM values_at GROUP BY ALL",
    "render_split": f"WITH rays AS (SELECT v AS view_id, r AS row, c AS col FROM range(12) a(v), range(16) b(r), range(16) e(c) WHERE v % 4 = 3), {o.LEAVES}, {o.COEFFS}, {o.GEOMETRY}, {o.GAUSS}, {o.FACTS} SELECT view_id, row, col, round(coalesce(sum(integral), 0), 6) AS prediction FROM rays LEFT JOIN facts USING (view_id, row, col) GROUP BY ALL",
}
