"""Queries of gated elevations, masked metrics, first fields and the hybrid score."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gate, lookup, losses, refine, volumes
from ..storage import snapshot
from . import fixtures as fx
from . import oracles as o
from .adapt_queries import _KEYS, _MODEL, _PATHS, _basis, _model
from .fit_queries import _BACK, _GRADED, _SHARED
from .inspect_queries import predicted
from .surface_queries import _values
from .tree_queries import _VOLUME, AXES, _volume
from .volume_queries import _GRID, _IN, _INSIDE, _OUT, _TAPS, _TRI, SAMPLES

L, N, V, KEY = fx.LEVELS, fx.SIZE, fx.VIEWS, lookup.KEY
TARGET, PART, RATE, PRICE, THRESHOLD = (1, 2, 1), 40, 0.02, 1e-8, 0.05


def gated_elevation(spark, sf):
    """Leaves of the two upper levels in parts of forty, raised, tuned by one step and kept or rolled back."""
    model = _model(spark, sf)
    chosen = model.leaves.where("level < 2 and ix % 3 = 1")
    after, audit = gate.gated_elevation(model, chosen, TARGET, L, N, V, PART, 1, RATE, price=PRICE)
    if after is not model:
        after.drop()
    model.drop()
    return audit.select("part", "leaves", "changed", "added_bytes", "accepted", *((F.round(c, 10) + 0.0).alias(c) for c in ("before", "after", "gain")))


def _both(spark, sf):
    """The decoded volume as target, and the same one a voxel further along x as prediction (its last layer stays)."""
    v = snapshot(_volume(spark, sf).select(*AXES, F.col("value").alias("target")), "volume")
    ahead = v.select((F.col("gx") - 1).alias("gx"), "gy", "gz", F.col("target").alias("predicted"))
    return v.join(ahead, AXES, "left").withColumn("predicted", F.coalesce("predicted", "target"))


def material_volume_metrics(spark, sf):
    return volumes.material_metrics(_both(spark, sf), "target", "predicted", THRESHOLD).select("n", F.round("psnr", 6).alias("psnr"), F.round("mae", 9).alias("mae"))


def boundary_metrics(spark, sf):
    made = volumes.boundary_metrics(_both(spark, sf), "target", "predicted", AXES, THRESHOLD)
    return made.select("n", *(F.round(c, 8).alias(c) for c in ("target_gradient", "predicted_gradient", "gradient_ratio", "mae")))


def masked_projection_metrics(spark, sf):
    test = fx.rays(spark, sf).where("split = 'test'")
    made = volumes.masked_projection_metrics(_both(spark, sf), "target", "predicted", AXES, test, N, N, V, SAMPLES, THRESHOLD)
    return made.select("part", "n", F.round("mae", 8).alias("mae"), F.round("psnr", 5).alias("psnr"), F.round("share", 8).alias("share"))


def pooled_volume(spark, sf):
    """The volume on five cells an axis, which cut voxels, and the constant field beside it."""
    made = volumes.pooled(_volume(spark, sf), AXES, "value", N, 5)
    return made.crossJoin(F.broadcast(volumes.mean_field(fx.rays(spark, sf)))).select(*AXES, F.round("value", 9).alias("value"), F.round("mu", 9).alias("mu"))


def hybrid_score(spark, sf):
    off = predicted(spark, sf).groupBy("view_id", "row", "col").agg(F.avg(F.abs(F.col("prediction") - F.col("target"))).alias("off"))
    back = losses.backprojected(lookup.dense_grid(spark, N), off, "off", N, V)
    made = volumes.hybrid_score(_volume(spark, sf), "value", AXES, snapshot(back.select(*AXES, "score"), "back"))
    return made.select(*AXES, *(F.round(c, 5).alias(c) for c in ("gradient", "sigma", "residual", "score")))


QUERIES = {f.__name__: f for f in (gated_elevation, material_volume_metrics, boundary_metrics, masked_projection_metrics, pooled_volume, hybrid_score)}

_BOTH = f"{_VOLUME}, two AS (SELECT a.gx, a.gy, a.gz, a.v AS t, coalesce(b.v, a.v) AS p FROM vol a LEFT JOIN vol b ON b.gx = a.gx+1 AND b.gy = a.gy AND b.gz = a.gz)"
_PSNR = "20*log10(greatest(max({t}), 1e-8))-10*log10(greatest(avg(pow({p}-{t}, 2)), 1e-20))"


def _slope(v: str) -> str:
    return "sqrt(" + "+".join(f"pow(coalesce(0.5*(lead({v}) OVER {w} - lag({v}) OVER {w}), 0), 2)" for w in "abc") + ")"


_WINDOWS = "WINDOW a AS (PARTITION BY gy, gz ORDER BY gx), b AS (PARTITION BY gx, gz ORDER BY gy), c AS (PARTITION BY gx, gy ORDER BY gz)"
_BOUNDARY = f"{_BOTH}, graded AS (SELECT *, {_slope('t')} AS gt, {_slope('p')} AS gp FROM two {_WINDOWS}), inside AS (SELECT * FROM graded WHERE t > {THRESHOLD}), edge AS (SELECT * FROM inside WHERE gt >= (SELECT quantile_cont(gt, 0.9) FROM inside)) SELECT count(*) AS n, round(avg(gt), 8) AS target_gradient, round(avg(gp), 8) AS predicted_gradient, round(avg(gp)/greatest(avg(gt), 1e-8), 8) AS gradient_ratio, round(avg(abs(p-t)), 8) AS mae FROM edge"
_TRI_OF = lambda c: _TRI.replace("v.v", f"v.{c}")
_MASKED = f"""{_BOTH}, {o.RAYS.replace('FROM events', 'FROM events WHERE (user_id%12)%4 = 3')}, {o.GEOMETRY}, masked AS (SELECT gx, gy, gz, CASE WHEN t > {THRESHOLD} THEN t ELSE 0 END AS t, CASE WHEN t > {THRESHOLD} THEN p ELSE 0 END AS p, CASE WHEN t > {THRESHOLD} THEN 1.0::DOUBLE ELSE 0 END AS m FROM two),
cut AS (SELECT *, {_IN} AS t0, {_OUT} AS t1 FROM ways), steps AS (SELECT view_id, row, col, (t1-t0)/{SAMPLES} AS h, bx+dx*(t0+(s+0.5)*(t1-t0)/{SAMPLES}) AS x, byy+dy*(t0+(s+0.5)*(t1-t0)/{SAMPLES}) AS y, z FROM cut, range({SAMPLES}) t(s) WHERE t1 > t0),
spots AS (SELECT *, {_GRID} FROM steps), summed AS (SELECT view_id, row, col, sum({_TRI_OF('t')}*h) AS t, sum({_TRI_OF('p')}*h) AS p, sum({_TRI_OF('m')}*h) AS m FROM spots JOIN {_TAPS.replace('vol v', 'masked v')} WHERE {_INSIDE} GROUP BY ALL),
rows_ AS (SELECT coalesce(t, 0) AS t, coalesce(p, 0) AS p, coalesce(m, 0) AS m FROM ways LEFT JOIN summed USING (view_id, row, col)),
parts_ AS (SELECT 'full_detector' AS part, * FROM rows_ UNION ALL SELECT 'material_rays', * FROM rows_ WHERE m > 1e-6)
SELECT part, count(*) AS n, round(avg(abs(p-t)), 8) AS mae, round({_PSNR.format(t='t', p='p')}, 5) AS psnr, round(count(*)/(SELECT count(*) FROM rows_)::DOUBLE, 8) AS share FROM parts_ GROUP BY part"""
_CELLS = ", ".join(f"range(5) {t}(c{a})" for t, a in zip(("i_", "j_", "k_"), "xyz"))
_COVERED = " AND ".join(f"g{a} >= (c{a}*16)//5 AND g{a} < ceil((c{a}+1)*16/5.0)" for a in "xyz")
_POOLED = f"{_VOLUME}, {o.RAYS} SELECT cx AS gx, cy AS gy, cz AS gz, round(avg(v), 9) AS value, (SELECT round(greatest(avg(target)*0.5, 1e-8), 9) FROM rays) AS mu FROM vol, {_CELLS} WHERE {_COVERED} GROUP BY ALL"


def _unit(table: str, column: str, out: str) -> str:
    return f"{out} AS (SELECT gx, gy, gz, least(greatest(({column}-lo)/greatest(hi-lo, 1e-8), 0), 1) AS {out} FROM {table}, (SELECT quantile_cont({column}, 0.01) AS lo, quantile_cont({column}, 0.99) AS hi FROM {table}))"


_HYBRID = f"""{_GRADED}, spread AS (SELECT a.gx, a.gy, a.gz, sqrt(greatest(sum(b.v*b.v)/27-pow(sum(b.v)/27, 2), 0)) AS s FROM vol a JOIN vol b ON abs(a.gx-b.gx) <= 1 AND abs(a.gy-b.gy) <= 1 AND abs(a.gz-b.gz) <= 1 GROUP BY ALL),
back AS ({_BACK.replace('round(coalesce(', '(coalesce(').replace(', 0)/12, 6) AS score', ', 0)/12) AS raw')}),
{_unit('graded', 'gradient', 'grade')}, {_unit('spread', 's', 'sigma')}, {_unit('back', 'raw', 'residual')},
total AS (SELECT *, grade + 0.25*sigma + residual AS whole FROM grade JOIN sigma USING (gx, gy, gz) JOIN residual USING (gx, gy, gz)), {_unit('total', 'whole', 'score')}
SELECT gx, gy, gz, round(grade, 5) AS gradient, round(sigma, 5) AS sigma, round(residual, 5) AS residual, round(score, 5) AS score FROM total JOIN score USING (gx, gy, gz)"""


def _gate_part(i: int) -> str:
    same = " AND ".join(f"x.{k} = g.{k}" for k in ("level", "ix", "iy", "iz"))
    lo, hi, ok = o.slab(*(f"(-1+{c}*2.0/res)" for c in ("ix", "(ix+1)", "iy", "(iy+1)")))
    weight = " * ".join(_basis(f"n.p{a}", f"q.k{a}", f"((n.{a}+1)*n.res/2-n.i{a})") for a in "xyz")
    high = {a: f"greatest(p{a}, {t})" for a, t in zip("xyz", TARGET)}
    short = " OR ".join(f"p{a} < {t}" for a, t in zip("xyz", TARGET))
    squares = lambda p: f"(w*{p}*{p}-2*{p}*wt+wtt)"
    return f"""own{i} AS (SELECT {_KEYS} FROM picked WHERE (place-1)//{PART} = {i}),
g{i} AS (SELECT x.* FROM m{i} x SEMI JOIN own{i} g ON {same} WHERE {short}),
new{i} AS (SELECT {_KEYS}, a.high AS px, b.high AS py, e.high AS pz, a.i AS kx, b.i AS ky, e.i AS kz, sum(c*a.w*b.w*e.w) AS c FROM g{i} JOIN lift a ON a.low = px AND a.high = {high['x']} AND a.j = kx JOIN lift b ON b.low = py AND b.high = {high['y']} AND b.j = ky JOIN lift e ON e.low = pz AND e.high = {high['z']} AND e.j = kz GROUP BY ALL),
lv{i}_ AS (SELECT DISTINCT {_KEYS}, px, py, pz, (4*2**level)::DOUBLE AS res FROM new{i}),
before{i} AS (SELECT view_id, row, col, sum(integral) AS before FROM f{i} x SEMI JOIN g{i} g ON {same} GROUP BY ALL),
hit{i} AS (SELECT w.*, l.*, {lo} AS s0, {hi} AS s1 FROM ways w SEMI JOIN before{i} USING (view_id, row, col), lv{i}_ l WHERE w.z >= -1+l.iz*2.0/res AND w.z < -1+(l.iz+1)*2.0/res AND {ok}),
n{i} AS (SELECT h.*, (s1-s0)/2*gw AS gwh, bx+dx*((s0+s1)/2+(s1-s0)/2*gx) AS x, byy+dy*((s0+s1)/2+(s1-s0)/2*gx) AS y FROM hit{i} h JOIN gauss ON n = greatest(1, ceil((px+py+pz+1)/2.0)) WHERE s1 > s0 + 1e-8),
t{i} AS (SELECT view_id, row, col, q.level, q.ix, q.iy, q.iz, q.kx, q.ky, q.kz, sum(gwh*{weight}) AS tw FROM n{i} n JOIN new{i} q USING ({_KEYS}) GROUP BY ALL),
now{i} AS (SELECT view_id, row, col, sum(c*tw) AS now FROM t{i} JOIN new{i} USING ({_KEYS}, kx, ky, kz) GROUP BY ALL),
off{i} AS (SELECT view_id, row, col, w*(prediction-before+now)-wt AS off FROM pa{i} JOIN before{i} USING (view_id, row, col) JOIN now{i} USING (view_id, row, col) WHERE NOT held_out),
grad{i} AS (SELECT q.*, coalesce(s, 0)*2/(SELECT sum(n) FROM pa0 WHERE NOT held_out)*(1-exp(-q.c)) AS g FROM new{i} q LEFT JOIN (SELECT {_KEYS}, kx, ky, kz, sum(off*tw) AS s FROM t{i} JOIN off{i} USING (view_id, row, col) GROUP BY ALL) USING ({_KEYS}, kx, ky, kz)),
done{i} AS (SELECT * EXCLUDE (l), greatest(l, 0)+ln(1+exp(-abs(l))) AS c FROM (SELECT {_KEYS}, px, py, pz, kx, ky, kz, c+ln(1-exp(-c))-{RATE!r}*g/(abs(g)+1e-8) AS l FROM grad{i})),
fresh{i} AS (SELECT view_id, row, col, {_KEYS}, sum(c*tw) AS integral FROM t{i} JOIN done{i} USING ({_KEYS}, kx, ky, kz) GROUP BY ALL),
way{i} AS (SELECT p.*, prediction-before+coalesce(own, 0) AS later FROM pa{i} p JOIN before{i} USING (view_id, row, col) LEFT JOIN (SELECT view_id, row, col, sum(integral) AS own FROM fresh{i} GROUP BY ALL) USING (view_id, row, col)),
v{i} AS (SELECT *, changed > 0 AND gain > 0 AND gain/greatest(added, 1) >= {PRICE!r} AS accepted FROM (SELECT {i}::BIGINT AS part, (SELECT count(*) FROM own{i}) AS leaves, (SELECT count(*) FROM lv{i}_) AS changed, 12*((SELECT count(*) FROM new{i})-(SELECT count(*) FROM g{i})) AS added,
  (SELECT sum({squares('prediction')})/sum(n) FROM pa{i} WHERE held_out) AS before, (SELECT coalesce(sum({squares('prediction')}-{squares('later')}), 0) FROM way{i} WHERE held_out)/(SELECT sum(n) FROM pa0 WHERE held_out) AS gain)),
m{i + 1} AS (SELECT * FROM m{i} x ANTI JOIN (SELECT * FROM g{i} WHERE (SELECT accepted FROM v{i})) g ON {same} UNION ALL SELECT * FROM done{i} WHERE (SELECT accepted FROM v{i})),
f{i + 1} AS (SELECT * FROM f{i} x ANTI JOIN (SELECT * FROM g{i} WHERE (SELECT accepted FROM v{i})) g ON {same} UNION ALL SELECT * FROM fresh{i} WHERE (SELECT accepted FROM v{i})),
pa{i + 1} AS (SELECT p.* REPLACE (CASE WHEN (SELECT accepted FROM v{i}) THEN coalesce(later, p.prediction) ELSE p.prediction END AS prediction) FROM pa{i} p LEFT JOIN (SELECT view_id, row, col, later FROM way{i}) USING (view_id, row, col))"""


PARTS = 4  # parts past the last selected leaf give no row
_GATED = f"""WITH {o.PREDICTED}, {_PATHS}, {_MODEL}, {_values('lift', refine.lift_matrix)}, picked AS (SELECT {_KEYS}, row_number() OVER (ORDER BY {_KEYS}) AS place FROM (SELECT DISTINCT {_KEYS} FROM m0 WHERE level < 2 AND ix%3 = 1)), {', '.join(_gate_part(i) for i in range(PARTS))}
""" + " UNION ALL ".join(f"SELECT part, leaves, changed, added AS added_bytes, accepted, round(before, 10) + 0.0 AS before, round(before-gain, 10) + 0.0 AS after, round(gain, 10) + 0.0 AS gain FROM v{i} WHERE leaves > 0" for i in range(PARTS))

ORACLES = {
    "gated_elevation": _GATED,
    "material_volume_metrics": f"{_BOTH} SELECT count(*) AS n, round({_PSNR.format(t='t', p='p')}, 6) AS psnr, round(avg(abs(p-t)), 9) AS mae FROM two WHERE t > {THRESHOLD}",
    "boundary_metrics": _BOUNDARY,
    "masked_projection_metrics": _MASKED,
    "pooled_volume": _POOLED,
    "hybrid_score": _HYBRID,
}


# Leaves two levels coarser than a face neighbour are cut in eight; on three levels that leaves no other ones.
_BALANCED = f"""WITH {_SHARED}, coarse AS (SELECT DISTINCT level, ix, iy, iz FROM faces WHERE own_level > level + 1),
after AS (SELECT level, len(mu) AS n FROM leaves ANTI JOIN coarse USING (level, ix, iy, iz) UNION ALL SELECT level+1, len(mu) FROM leaves SEMI JOIN coarse USING (level, ix, iy, iz), range(8))
SELECT level, count(*) AS leaves, sum(n)::BIGINT AS coefficients, true AS complete FROM after GROUP BY level"""


def _adam(steps: int, rate: float = 0.01) -> str:
    out = [f"""{o.LEAVES}, {o.COEFFS}, {o.RAYS.replace('FROM events', 'FROM events WHERE user_id%12 IN (1, 2)')}, {o.GEOMETRY}, {o.GAUSS}, {o.FACTS},
tw AS (SELECT view_id, row, col, level, ix, iy, iz, k, sum(w) AS w FROM parts GROUP BY ALL), seen AS (SELECT view_id, row, col, count(*) AS n, sum(target) AS t FROM rays GROUP BY ALL),
s0 AS (SELECT level, ix, iy, iz, unnest(range(len(logits))) AS k, unnest(logits) AS lg, 0.0::DOUBLE AS m, 0.0::DOUBLE AS s FROM logit_leaves)"""]
    for i in range(1, steps + 1):
        mu = "greatest(lg-3, 0)+ln(1+exp(-abs(lg-3)))"
        out.append(f"""p{i} AS (SELECT view_id, row, col, sum(({mu})*w) AS p FROM tw JOIN s{i - 1} USING (level, ix, iy, iz, k) GROUP BY ALL),
o{i} AS (SELECT view_id, row, col, n*coalesce(p, 0)-t AS off FROM seen LEFT JOIN p{i} USING (view_id, row, col)),
g{i} AS (SELECT level, ix, iy, iz, k, sum(off*w)/(SELECT count(*) FROM rays) AS g FROM tw JOIN o{i} USING (view_id, row, col) GROUP BY ALL),
e{i} AS (SELECT s.*, coalesce(g, 0)/(1+exp(-(lg-3))) AS g FROM s{i - 1} s LEFT JOIN g{i} USING (level, ix, iy, iz, k)),
s{i} AS (SELECT level, ix, iy, iz, k, lg-{rate}*((0.9*m+0.1*g)/(1-pow(0.9, {i})))/(sqrt((0.999*s+0.001*g*g)/(1-pow(0.999, {i})))+1e-8) AS lg, 0.9*m+0.1*g AS m, 0.999*s+0.001*g*g AS s FROM e{i})""")
    return f"WITH {', '.join(out)} SELECT level, ix, iy, iz, k AS coefficient, round(lg, 5) AS logit FROM s{steps}"


#: SQL for two queries of other modules.
ORACLES |= {"balance_2to1": _BALANCED, "adam_steps": _adam(2)}
