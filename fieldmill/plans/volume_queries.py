"""Queries of dense volumes in bricks, edge-biased ray pairs, topology checks, gathered coefficients and staged settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bricks, lookup, sampling, topology
from . import fixtures as fx
from . import oracles as o
from .fit_queries import SEED, _drawn
from .tree_queries import _VOLUME, AXES, _volume

L, N, V, KEY = fx.LEVELS, fx.SIZE, fx.VIEWS, lookup.KEY
EDGE, SAMPLES, PAIRS = 6, 24, 120  # 16 voxels an axis make bricks of unlike fill


def _bricks(spark, sf):
    return bricks.bricks(_volume(spark, sf), AXES, "value", N, EDGE)


def dense_projection(spark, sf):
    """All rays through the decoded volume by trilinear midpoint samples."""
    return bricks.project(fx.rays(spark, sf), _bricks(spark, sf), N, N, V, SAMPLES, EDGE).select("view_id", "row", "col", (F.round("prediction", 7) + 0.0).alias("prediction"))


def trilinear_samples(spark, sf):
    """Values at the points, summed by their cell of the root level."""
    at = bricks.sample(fx.points(spark, sf), _bricks(spark, sf), N, EDGE)
    cell = [F.floor((F.col(a) + 1) * 2).cast("long").alias(f"i{a}") for a in "xyz"]
    return at.groupBy(*cell).agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("value"), F.round(F.max("value"), 9).alias("most"))


def edge_pairs(spark, sf):
    made = sampling.edge_pairs(fx.images(spark, sf), "v", PAIRS, V, N, SEED)
    return made.select("draw", "view_id", "row", "col", "row_b", "col_b", "stride", "biased", *((F.round(c, 8) + 0.0).alias(c) for c in ("a", "b", "derivative", "midpoint")))


def topology_faults(spark, sf):
    """The tree as it is, and with leaves that are lost, doubled, hung below others, out of range, or hold other coefficients than they should."""
    whole = fx.leaves(spark, sf)
    kept = whole.where("not (level = 2 and (ix + 2 * iy + 3 * iz) % 7 = 0)").withColumn("coeffs", F.when(F.expr("(ix + iy) % 5 = 0"), F.slice("coeffs", 2, 64)).otherwise(F.col("coeffs")))
    below = whole.where("level = 1 and iz % 3 = 0").select((F.col("level") + 1).alias("level"), *((F.col(c) * 2).alias(c) for c in KEY[1:]), "px", "py", "pz", "coeffs")
    beyond = whole.where("level = 0").withColumn("ix", F.col("ix") + 3).withColumn("py", F.col("py") + 2)
    deep = whole.where("level = 2 and ix % 3 = 0").withColumn("level", F.lit(3).cast("long"))
    broken = kept.unionByName(whole.where("ix % 4 = 1")).unionByName(below).unionByName(beyond).unionByName(deep)
    listed = [topology.faults(t, L).select(F.lit(name).alias("tree"), "fault", "n") for name, t in (("whole", whole), ("broken", broken))]
    return listed[0].union(listed[1])


def constraint_gather(spark, sf):
    """Coefficients as weighted sums of two of the leaf means and a place that counts for nothing."""
    means = fx.leaves(spark, sf).select((F.col("level") * 4096 + (F.col("ix") * 16 + F.col("iy")) * 16 + F.col("iz")).alias("master_id"), F.element_at("coeffs", 1).alias("value"))
    rows = fx.rays(spark, sf).selectExpr("ray_id", "array(4096 + (view_id % 8 * 16 + col % 8) * 16 + row % 8, 8192 + (view_id * 16 + col) * 16 + row, -1, 4096 + (view_id % 8 * 16 + col % 8) * 16 + row % 8) as ids", "array(0.25D, 0.5D, 9.0D, 0.125D) as weights")
    return topology.gathered(rows, means, ["ray_id"], "ids", "weights").select("ray_id", F.round("value", 9).alias("value"))


BASE = {"mode": "inverse", "epsilon": 1e-4, "target_power": 1.0}
STAGES = {4000: {"mode": "blend", "blend_alpha": 0.3}, 1000: {"mode": "uniform"}, 7000: {"blend_alpha": 0.1, "epsilon": 1e-3}}


def staged_settings(spark, sf):
    """Each event's id as an iteration: the settings that hold there and the weight of a ramped loss."""
    at = F.col("ray_id")
    made = topology.staged_settings(at, BASE, STAGES, {"target_power": 2.0, "epsilon": None})
    return fx.rays(spark, sf).select("ray_id", *(c.alias(k) for k, c in made.items()), F.round(topology.ramped(at, 0.2, 500, 8000, 3000), 9).alias("ramp"))


QUERIES = {f.__name__: f for f in (dense_projection, trilinear_samples, edge_pairs, topology_faults, constraint_gather, staged_settings)}

_TAPS = "vol v ON v.gx BETWEEN floor(fx) AND least(floor(fx)+1, 15) AND v.gy BETWEEN floor(fy) AND least(floor(fy)+1, 15) AND v.gz BETWEEN floor(fz) AND least(floor(fz)+1, 15)"
_TRI = "v.v*greatest(0, 1-abs(fx-v.gx))*greatest(0, 1-abs(fy-v.gy))*greatest(0, 1-abs(fz-v.gz))"
_GRID = ", ".join("({a}+1)*8-0.5 AS f{a}".format(a=a) for a in "xyz")
_INSIDE = " AND ".join(f"f{a} BETWEEN 0 AND 15" for a in "xyz")
_IN, _OUT, _ = o.slab("-1", "1", "-1", "1")
_SQL_PROJECT = f"""{_VOLUME}, {o.RAYS}, {o.GEOMETRY}, cut AS (SELECT *, {_IN} AS t0, {_OUT} AS t1 FROM ways),
steps AS (SELECT view_id, row, col, (t1-t0)/{SAMPLES} AS h, bx+dx*(t0+(s+0.5)*(t1-t0)/{SAMPLES}) AS x, byy+dy*(t0+(s+0.5)*(t1-t0)/{SAMPLES}) AS y, z FROM cut, range({SAMPLES}) t(s) WHERE t1 > t0),
spots AS (SELECT *, {_GRID} FROM steps), summed AS (SELECT view_id, row, col, sum({_TRI}*h) AS p FROM spots JOIN {_TAPS} WHERE {_INSIDE} GROUP BY ALL)
SELECT view_id, row, col, round(coalesce(p, 0), 7) + 0.0 AS prediction FROM ways LEFT JOIN summed USING (view_id, row, col)"""
_SQL_SAMPLE = f"""{_VOLUME}, {o.POINTS}, numbered AS (SELECT x, y, z, count(*) AS many, {_GRID} FROM points GROUP BY x, y, z),
hit AS (SELECT n.x, n.y, n.z, sum({_TRI}) AS value FROM numbered n JOIN {_TAPS} WHERE {_INSIDE} GROUP BY ALL)
SELECT floor((x+1)*2)::BIGINT AS ix, floor((y+1)*2)::BIGINT AS iy, floor((z+1)*2)::BIGINT AS iz, sum(many)::BIGINT AS n, round(sum(many*coalesce(value, 0))/sum(many), 9) AS value, round(max(coalesce(value, 0)), 9) AS most FROM numbered LEFT JOIN hit USING (x, y, z) GROUP BY ALL"""
_EVEN = PAIRS // 2
_SQL_PAIRS = f"""WITH {o.RAYS}, {o.IMAGES}, d0 AS (SELECT i AS draw, {_drawn('i', str(V), SEED)} AS view_id, {_drawn('i', '2', SEED + 1)} = 0 AS down, [1, 2, 4][{_drawn('i', '3', SEED + 2)} + 1]::BIGINT AS stride FROM range({_EVEN + 8 * (PAIRS - _EVEN)}) t(i)),
d1 AS (SELECT *, CASE WHEN down THEN stride ELSE 0 END AS dr, CASE WHEN down THEN 0 ELSE stride END AS dc FROM d0), d2 AS (SELECT *, {_drawn('draw', f'{N} - dr', SEED + 3)} AS row, {_drawn('draw', f'{N} - dc', SEED + 4)} AS col FROM d1),
met AS (SELECT draw, d.view_id, d.row, d.col, d.row+dr AS row_b, d.col+dc AS col_b, stride, draw >= {_EVEN} AS biased, p.v AS a, q.v AS b, (q.v-p.v)/stride AS derivative, (p.v+q.v)/2 AS midpoint FROM d2 d JOIN images p ON p.view_id = d.view_id AND p.row = d.row AND p.col = d.col JOIN images q ON q.view_id = d.view_id AND q.row = d.row+dr AND q.col = d.col+dc)
SELECT draw, view_id, row, col, row_b, col_b, stride, biased, round(a, 8) + 0.0 AS a, round(b, 8) + 0.0 AS b, round(derivative, 8) + 0.0 AS derivative, round(midpoint, 8) + 0.0 AS midpoint FROM met QUALIFY NOT biased OR row_number() OVER (PARTITION BY biased ORDER BY abs(derivative) DESC, draw) <= {PAIRS - _EVEN}"""


def _faults_sql(source: str, name: str) -> str:
    kinds = {
        "level": f"SELECT count(*) FROM {source} WHERE level NOT BETWEEN 0 AND 2",
        "coordinate": f"SELECT count(*) FROM {source} WHERE level BETWEEN 0 AND 2 AND NOT (least(ix, iy, iz) >= 0 AND greatest(ix, iy, iz) < 4*2**level)",
        "degree": f"SELECT count(*) FROM {source} WHERE least(px, py, pz) < 0 OR greatest(px, py, pz) > 3",
        "coefficient_count": f"SELECT count(*) FROM {source} WHERE len(mu) <> (px+1)*(py+1)*(pz+1)",
        "coefficient_value": f"SELECT count(*) FROM {source} WHERE len(list_filter(mu, lambda v: NOT isfinite(v))) > 0",
        "repeated_key": f"SELECT count(*)-count(DISTINCT (level, ix, iy, iz)) FROM {source}_in",
        "nested_leaf": f"SELECT count(*) FROM (SELECT DISTINCT level, ix, iy, iz FROM {source}_in) SEMI JOIN {source}_up USING (level, ix, iy, iz)",
        "missing_child": f"SELECT coalesce(sum(8-coalesce(kids, 0)), 0) FROM {source}_up LEFT JOIN (SELECT level-1 AS level, ix//2 AS ix, iy//2 AS iy, iz//2 AS iz, count(*) AS kids FROM {source}_all WHERE level > 0 GROUP BY ALL) USING (level, ix, iy, iz)",
        "missing_root": f"SELECT 64-count(*) FROM {source}_all WHERE level = 0",
    }
    return " UNION ALL ".join(f"SELECT '{name}' AS tree, '{k}' AS fault, ({q})::BIGINT AS n" for k, q in kinds.items())


def _nodes_sql(source: str) -> str:
    return f"""{source}_in AS (SELECT level, ix, iy, iz FROM {source} WHERE level BETWEEN 0 AND 2 AND least(ix, iy, iz) >= 0 AND greatest(ix, iy, iz) < 4*2**level),
{source}_up AS (SELECT DISTINCT u AS level, ix >> (level-u)::INT AS ix, iy >> (level-u)::INT AS iy, iz >> (level-u)::INT AS iz FROM {source}_in, range(2) t(u) WHERE u < level),
{source}_all AS (SELECT level, ix, iy, iz FROM {source}_in UNION SELECT * FROM {source}_up)"""


_SQL_FAULTS = f"""WITH {o.LEAVES}, whole AS (SELECT level, ix, iy, iz, d AS px, d AS py, d AS pz, mu FROM leaves),
broken AS (SELECT level, ix, iy, iz, px, py, pz, CASE WHEN (ix+iy)%5 = 0 THEN mu[2:] ELSE mu END AS mu FROM whole WHERE NOT (level = 2 AND (ix+2*iy+3*iz)%7 = 0) UNION ALL SELECT * FROM whole WHERE ix%4 = 1 UNION ALL SELECT level+1, ix*2, iy*2, iz*2, px, py, pz, mu FROM whole WHERE level = 1 AND iz%3 = 0
  UNION ALL SELECT level, ix+3, iy, iz, px, py+2, pz, mu FROM whole WHERE level = 0 UNION ALL SELECT 3, ix, iy, iz, px, py, pz, mu FROM whole WHERE level = 2 AND ix%3 = 0),
{_nodes_sql('whole')}, {_nodes_sql('broken')} {_faults_sql('whole', 'whole')} UNION ALL {_faults_sql('broken', 'broken')}"""
_SQL_GATHER = f"""WITH {o.LEAVES}, {o.RAYS}, masters AS (SELECT level*4096+(ix*16+iy)*16+iz AS id, mu[1] AS v FROM leaves),
each AS (SELECT ray_id, unnest([4096+(view_id%8*16+col%8)*16+row%8, 8192+(view_id*16+col)*16+row, 4096+(view_id%8*16+col%8)*16+row%8]) AS id, unnest([0.25, 0.5, 0.125]::DOUBLE[]) AS w FROM rays)
SELECT ray_id, round(coalesce(sum(w*v), 0), 9) AS value FROM each LEFT JOIN masters USING (id) GROUP BY ray_id"""
_SQL_STAGES = f"""WITH {o.RAYS}, modes(start, mode) AS (VALUES (-1, 'inverse'), (1000, 'uniform'), (4000, 'blend')), alphas(start, blend_alpha) AS (VALUES (-1, NULL), (4000, 0.3::DOUBLE), (7000, 0.1::DOUBLE)), epsilons(start, epsilon) AS (VALUES (-1, 1e-4::DOUBLE), (7000, 1e-3::DOUBLE))
SELECT ray_id, mode, epsilon, 2.0::DOUBLE AS target_power, blend_alpha, round(CASE WHEN ray_id < 500 OR ray_id > 8000 THEN 0 ELSE 0.2::DOUBLE*least(1, (ray_id-500+1)/3000.0::DOUBLE) END, 9) AS ramp FROM rays ASOF JOIN modes ON ray_id >= modes.start ASOF JOIN alphas ON ray_id >= alphas.start ASOF JOIN epsilons ON ray_id >= epsilons.start"""

ORACLES = {"dense_projection": _SQL_PROJECT, "trilinear_samples": _SQL_SAMPLE, "edge_pairs": _SQL_PAIRS, "topology_faults": _SQL_FAULTS, "constraint_gather": _SQL_GATHER, "staged_settings": _SQL_STAGES}
