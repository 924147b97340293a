"""Queries of fitting: samplers, pools, halos, detector gradients, face continuity, back-projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates, losses, lookup, sampling, stencil
from . import fixtures as fx
from . import oracles as o
from .inspect_queries import predicted, r6
from .score_queries import _weighted_sql, staged_facts, weighted
from .tree_queries import _TREE_BANK, _VOLUME, AXES, _tree_bank, _volume

L, N, V, KEY = fx.LEVELS, fx.SIZE, fx.VIEWS, lookup.KEY
SEED = 7


def detector_subset(spark, sf):
    """Forty evenly spaced pixels of the detector with their mean target over the views."""
    at = sampling.spaced(spark, N * N, 40).selectExpr("i", f"at div {N} as row", f"at % {N} as col")
    return at.join(fx.images(spark, sf), ["row", "col"]).groupBy("i", "row", "col").agg(r6(F.avg("v")).alias("v"))


def _with_target(draws, spark, sf):
    return draws.join(fx.images(spark, sf), ["view_id", "row", "col"]).select("draw", "view_id", "row", "col", F.round("v", 8).alias("target"))


def uniform_ray_sample(spark, sf):
    return _with_target(sampling.uniform_rays(spark, 500, V, N, SEED), spark, sf)


def stratified_ray_sample(spark, sf):
    return _with_target(sampling.stratified_rays(spark, 500, V, N, SEED, 3), spark, sf)


def held_out_split(spark, sf):
    """Rays on either side of the held-out split of views."""
    rays = fx.rays(spark, sf)
    return rays.join(F.broadcast(sampling.held_out_views(rays, 0.25, SEED)), "view_id").groupBy("view_id", "held_out").agg(F.count("*").alias("n"))


def _pools(spark, sf):
    graded = stencil.gradient_magnitude(_volume(spark, sf), "value", AXES, [])
    return sampling.volume_pools(graded, "value", "gradient", 0.055, 0.9)


def volume_pools(spark, sf):
    return _pools(spark, sf).groupBy("material", "boundary").agg(F.count("*").alias("n"), F.round(F.sum("value"), 5).alias("total"))


def volume_sample(spark, sf):
    return sampling.sample_volume(_pools(spark, sf).select(*AXES, "value", "material", "boundary"), AXES, 400, SEED).select("pool", "draw", *AXES, r6("value").alias("value"))


def volume_losses(spark, sf):
    """The volume against the same one a voxel further along x."""
    v = _volume(spark, sf)
    ahead = v.select((F.col("gx") - 1).alias("gx"), "gy", "gz", F.col("value").alias("ahead"))
    return losses.sample_losses(v.join(ahead, AXES), "value", "ahead", "gz").select("gz", "n", *(F.round(c, 9).alias(c) for c in ("mse", "l1", "smooth_l1")))


def halo_activation(spark, sf):
    """Cells of the level above that hold the steepest two hundredths of voxels or their neighbours."""
    graded = stencil.gradient_magnitude(_volume(spark, sf), "value", AXES, []).select(*AXES, F.round("gradient", 9).alias("gradient"))
    return sampling.parents_to_split(graded, AXES, "gradient", N, 0.02, 1)


def shared_faces(spark, sf):
    return losses.shared_faces(fx.leaves(spark, sf), L).select(*(f"own_{c}" for c in KEY), "axis", "side", *KEY)


def face_continuity(spark, sf):
    return losses.continuity_loss(fx.leaves(spark, sf), L).select("faces", F.round("loss", 9).alias("loss"))


def _both_images(spark, sf):
    """Each pixel's target, and in place of a prediction the target of the pixel's next view."""
    v = fx.images(spark, sf)
    following = v.select(((F.col("view_id") + V - 1) % V).alias("view_id"), "row", "col", F.col("v").alias("prediction"))
    return v.withColumnRenamed("v", "target").join(following, ["view_id", "row", "col"])


def projection_gradient_loss(spark, sf):
    made = losses.gradient_loss(losses.detector_edges(_both_images(spark, sf), 2), "view_id")
    return made.select("view_id", *(F.round(c, 7).alias(c) for c in ("signed", "magnitude", "moment", "endpoint")))


def residual_backprojection(spark, sf):
    off = predicted(spark, sf).groupBy("view_id", "row", "col").agg(F.avg(F.abs(F.col("prediction") - F.col("target"))).alias("off"))
    return losses.backprojected(lookup.dense_grid(spark, N), off, "off", N, V).select(*AXES, r6("score").alias("score"))


def candidate_loss_change(spark, sf):
    _, bank = _tree_bank(spark, sf)
    made = staged_facts(spark, sf)
    done = candidates.loss_changes(made, predicted(spark, sf, made), bank, L, N, V)
    return done.select(*KEY, *((F.round(c, 7) + 0.0).alias(c) for c in ("p0_change", "p1_change")))


def region_energy(spark, sf):
    """What the leaves of the lowest level add to the weighted loss."""
    made = staged_facts(spark, sf)
    return candidates.region_energy(made, weighted(spark, sf, made=made), fx.leaves(spark, sf).where("level = 2")).select("n", F.round("energy", 6).alias("energy"))


QUERIES = {f.__name__: f for f in (candidate_loss_change, region_energy, detector_subset, uniform_ray_sample, stratified_ray_sample, held_out_split, volume_pools, volume_sample, volume_losses, halo_activation, shared_faces, face_continuity, projection_gradient_loss, residual_backprojection)}


def _drawn(number: str, below: str, seed: int) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:' || ({number})), 1, {sampling.DIGITS}) AS BIGINT) % ({below}))"


_GRADED = _VOLUME + ", g AS (SELECT *, coalesce(0.5*(lead(v) OVER a - lag(v) OVER a),0) AS dx, coalesce(0.5*(lead(v) OVER b - lag(v) OVER b),0) AS dy, coalesce(0.5*(lead(v) OVER c - lag(v) OVER c),0) AS dz FROM vol WINDOW a AS (PARTITION BY gy,gz ORDER BY gx), b AS (PARTITION BY gx,gz ORDER BY gy), c AS (PARTITION BY gx,gy ORDER BY gz)), graded AS (SELECT gx, gy, gz, v, sqrt(dx*dx+dy*dy+dz*dz) AS gradient FROM g)"
_POOLS = _GRADED + ", bar AS (SELECT quantile_cont(gradient, 0.9) AS edge FROM graded WHERE v > 0.055), pools AS (SELECT gx, gy, gz, v, v > 0.055 AS material, v > 0.055 AND gradient >= coalesce(edge, 1e300) AS boundary FROM graded, bar)"
_SAMPLE = f"""{_POOLS}, sizes AS (SELECT count(*) FILTER (boundary) AS nb, count(*) FILTER (material) AS nm, count(*) FILTER (NOT material) AS ng FROM pools),
ranked AS (SELECT 'boundary' AS pool, 0 AS k, row_number() OVER (ORDER BY gx, gy, gz) - 1 AS place, * FROM pools WHERE boundary UNION ALL SELECT 'material', 1, row_number() OVER (ORDER BY gx, gy, gz) - 1, * FROM pools WHERE material UNION ALL SELECT 'background', 2, row_number() OVER (ORDER BY gx, gy, gz) - 1, * FROM pools WHERE NOT material),
draws AS (SELECT 'boundary' AS pool, i AS draw, {_drawn('i', 'nb', SEED)} AS place FROM range(100) t(i), sizes UNION ALL SELECT 'material', i, {_drawn('i', 'nm', SEED + 1)} FROM range(200) t(i), sizes UNION ALL SELECT 'background', i, {_drawn('i', 'ng', SEED + 2)} FROM range(100) t(i), sizes)
SELECT pool, draw, gx, gy, gz, round(v, 6) AS value FROM draws JOIN ranked USING (pool, place)"""
_SHARED = f"""{o.LEAVES}, probes AS (SELECT l.*, axis, side, {', '.join(f"-1+(l.i{a}+0.5)*2.0/l.res + CASE WHEN axis = {k} THEN (2*side-1)*(1.0/l.res+1e-5) ELSE 0 END AS {a}" for k, a in enumerate('xyz'))} FROM leaves l, range(3) t(axis), range(2) u(side)),
faces AS (SELECT p.level AS own_level, p.ix AS own_ix, p.iy AS own_iy, p.iz AS own_iz, p.d AS own_d, p.mu AS own_mu, p.res AS own_res, axis, side, n.level, n.ix, n.iy, n.iz, n.d, n.mu, n.res FROM probes p JOIN leaves n ON floor((p.x+1)*n.res/2) = n.ix AND floor((p.y+1)*n.res/2) = n.iy AND floor((p.z+1)*n.res/2) = n.iz WHERE n.level < p.level OR (n.level = p.level AND side = 1))"""


def _poly(d: str, mu: str, at: dict[str, str]) -> str:
    """The polynomial of a leaf of degree 0, 1 or 3 as a sum over a nested list."""
    one = lambda a, k: f"(CASE WHEN {d}=0 OR {k}=0 OR {k}={d} THEN 1.0 ELSE 3.0 END * pow(least(greatest({at[a]},0),1), {k}) * pow(1-least(greatest({at[a]},0),1), {d}-{k}))"
    return f"list_sum(list_transform(range(len({mu})), lambda k: {mu}[k+1] * {one('x', f'(k//(({d}+1)*({d}+1)))')} * {one('y', f'((k//({d}+1))%({d}+1))')} * {one('z', f'(k%({d}+1))')}))"


_NODES = [0.5 - 0.5 / 3**0.5, 0.5 + 0.5 / 3**0.5]
_SPOT = {"x": "CASE WHEN axis=0 THEN side ELSE u END", "y": "CASE axis WHEN 1 THEN side WHEN 0 THEN u ELSE v END", "z": "CASE WHEN axis=2 THEN side ELSE v END"}
_CONTINUITY = f"""WITH {_SHARED}, spots AS (SELECT f.*, {', '.join(f'-1+(own_i{a}+{_SPOT[a]})*2.0/own_res AS {a}' for a in 'xyz')} FROM faces f, (VALUES ({_NODES[0]!r}::DOUBLE), ({_NODES[1]!r}::DOUBLE)) t(u), (VALUES ({_NODES[0]!r}::DOUBLE), ({_NODES[1]!r}::DOUBLE)) w(v)),
jumps AS (SELECT own_level, own_ix, own_iy, own_iz, axis, side, pow(2.0/own_res, 2) AS area, {_poly('own_d', 'own_mu', {a: f'(({a}+1)*own_res/2-own_i{a})' for a in 'xyz'})} - {_poly('d', 'mu', {a: f'(({a}+1)*res/2-i{a})' for a in 'xyz'})} AS jump FROM spots),
per AS (SELECT area, avg(CASE WHEN abs(jump) <= 0.02 THEN 0.5*jump*jump ELSE 0.02*(abs(jump)-0.01) END) AS penalty FROM jumps GROUP BY own_level, own_ix, own_iy, own_iz, axis, side, area)
SELECT count(*) AS faces, round(sum(area*penalty)/sum(area), 9) AS loss FROM per"""
_EDGES = f"""WITH {o.RAYS}, {o.IMAGES}, both_ AS (SELECT a.view_id, a.row, a.col, a.v AS t, b.v AS p FROM images a JOIN images b ON b.view_id = (a.view_id+1)%12 AND b.row = a.row AND b.col = a.col),
edges AS (SELECT a.view_id, (b.p-a.p)/2 AS s, (b.t-a.t)/2 AS g, (a.t+b.t)/2 AS mid, a.p-a.t AS o1, b.p-b.t AS o2 FROM both_ a JOIN both_ b ON a.view_id = b.view_id AND ((b.row = a.row+2 AND b.col = a.col) OR (b.row = a.row AND b.col = a.col+2))),
raw AS (SELECT *, 1.0/greatest(abs(mid), 1e-4) AS w0 FROM edges), wtd AS (SELECT *, w0/greatest(avg(w0) OVER (PARTITION BY view_id), 1e-4) AS w FROM raw), bars AS (SELECT view_id, quantile_cont(abs(g), 0.75) AS bar FROM edges GROUP BY view_id),
near AS (SELECT *, CASE WHEN abs(g) >= bar THEN w END AS q FROM wtd JOIN bars USING (view_id))
SELECT view_id, round(avg(w*(s-g)**2), 7) AS signed, round(avg(q*(abs(s)-abs(g))**2)/greatest(avg(q), 1e-4), 7) AS magnitude, round(pow(sum(q*abs(s))/greatest(sum(q), 1e-4) - sum(q*abs(g))/greatest(sum(q), 1e-4), 2), 7) AS moment, round(0.5*avg(q*(o1**2+o2**2))/greatest(avg(q), 1e-4), 7) AS endpoint FROM near GROUP BY view_id"""
_BACK = f"""WITH {o.PREDICTED}, {o.DENSE}, offs AS (SELECT view_id, row, col, avg(abs(prediction-target)) AS off FROM predicted GROUP BY ALL),
seen AS (SELECT gx, gy, gz, w AS view_id, ((-sin(-(w*pi()/12))*x + cos(-(w*pi()/12))*y + 1)*16-1)/2 AS c, ((z+1)*16-1)/2 AS r FROM dense, range(12) t(w))
SELECT gx, gy, gz, round(coalesce(sum(greatest(0, 1-abs(r-o.row))*greatest(0, 1-abs(c-o.col))*off), 0)/12, 6) AS score FROM seen s LEFT JOIN offs o ON o.view_id = s.view_id AND o.row BETWEEN floor(r) AND floor(r)+1 AND o.col BETWEEN floor(c) AND floor(c)+1 GROUP BY gx, gy, gz"""

_CELL = {a: f"(-1+c.n{a}*2.0/(4*2**c.nl))" for a in "xyz"}
_NODE_IN, _NODE_OUT, _ = o.slab(*(f"{_CELL['x']}{e}" for e in ("", "+2.0/(4*2**c.nl)")), *(f"{_CELL['y']}{e}" for e in ("", "+2.0/(4*2**c.nl)")))
_CORNERS = " + ".join("list_extract(p1, {i})*({both})".format(i=i + 1, both=" + ".join("*".join(f"{a}{k}" if i >> (2 - n) & 1 else f"(1-{a}{k})" for n, a in enumerate("xyz")) for k in (0, 1))) for i in range(8))
_CHANGES = f"""{_TREE_BANK}, {o.RAYS}, {o.GEOMETRY}, {o.GAUSS}, {o.FACTS}, sums AS (SELECT view_id, row, col, sum(integral) AS prediction FROM facts GROUP BY ALL),
off AS (SELECT view_id, row, col, count(*) AS n, sum(coalesce(prediction, 0)-target) AS off FROM rays LEFT JOIN sums USING (view_id, row, col) GROUP BY ALL),
below AS (SELECT view_id, row, col, u AS nl, ix >> (level-u)::INT AS nx, iy >> (level-u)::INT AS ny, iz >> (level-u)::INT AS nz, sum(integral) AS ref FROM facts, range(2) t(u) WHERE u < level GROUP BY ALL),
blocks AS (SELECT nl, nx, ny, nz, any_value(p0) AS p0, list(c ORDER BY k) AS p1 FROM bank JOIN p1c USING (nl, nx, ny, nz) GROUP BY ALL),
c AS (SELECT * FROM below JOIN blocks USING (nl, nx, ny, nz) JOIN ways USING (view_id, row, col) JOIN off USING (view_id, row, col)),
cut AS (SELECT c.*, {_NODE_IN} AS s0, {_NODE_OUT} AS s1 FROM c), len AS (SELECT *, greatest(s1-s0, 0) AS length, 2.0/(4*2**nl) AS w FROM cut),
spots AS (SELECT *, {', '.join(f"least(greatest(({'z' if a == 'z' else ('bx' if a == 'x' else 'byy') + '+d' + a + f'*((s0+s1)/2+({sign})*length/2/sqrt(3.0::DOUBLE))'}-(-1+n{a}*w))/w, 0), 1) AS {a}{k}" for a in 'xyz' for k, sign in ((0, -1), (1, 1)))} FROM len),
deltas AS (SELECT *, length*p0-ref AS d0, length/2*({_CORNERS})-ref AS d1 FROM spots)
SELECT nl AS level, nx AS ix, ny AS iy, nz AS iz, round(sum(2*off*d0+n*d0*d0)/(SELECT count(*) FROM rays), 7) + 0.0 AS p0_change, round(sum(2*off*d1+n*d1*d1)/(SELECT count(*) FROM rays), 7) + 0.0 AS p1_change FROM deltas GROUP BY ALL"""

ORACLES = {
    "candidate_loss_change": _CHANGES,
    "region_energy": f"WITH {o.PREDICTED}, {_weighted_sql('inverse', 'predicted')}, own AS (SELECT view_id, row, col, sum(integral) AS own FROM facts WHERE level = 2 GROUP BY ALL) SELECT count(*) AS n, round(avg(weight*pow((prediction-target)*coalesce(own, 0)/greatest(prediction, 1e-8), 2)), 6) AS energy FROM weighted LEFT JOIN own USING (view_id, row, col)",
    "detector_subset": f"WITH {o.RAYS}, {o.IMAGES}, picked AS (SELECT i, round_even(i*(255.0::DOUBLE/39), 0)::BIGINT AS p FROM range(40) t(i)) SELECT i, row, col, round(avg(v), 6) AS v FROM picked JOIN images ON row = p//16 AND col = p%16 GROUP BY ALL",
    "uniform_ray_sample": f"WITH {o.RAYS}, {o.IMAGES}, d AS (SELECT i AS draw, {_drawn('i', '3072', SEED)} AS n FROM range(500) t(i)) SELECT draw, view_id, row, col, round(v, 8) AS target FROM d JOIN images ON view_id = n//256 AND row = (n//16)%16 AND col = n%16",
    "stratified_ray_sample": f"WITH {o.RAYS}, {o.IMAGES}, d AS (SELECT i AS draw, (i+3)%12 AS w, {_drawn('i', '256', SEED + 3)} AS n FROM range(500) t(i)) SELECT draw, view_id, row, col, round(v, 8) AS target FROM d JOIN images ON view_id = w AND row = n//16 AND col = n%16",
    "held_out_split": f"WITH {o.RAYS}, views AS (SELECT DISTINCT view_id FROM rays), r AS (SELECT view_id, row_number() OVER (ORDER BY {_drawn('view_id', str(1 << 60), SEED)}, view_id) <= greatest(1, least((SELECT count(*) FROM views)-1, round_even((SELECT count(*) FROM views)*0.25, 0))) AS held_out FROM views) SELECT view_id, held_out, count(*) AS n FROM rays JOIN r USING (view_id) GROUP BY ALL",
    "volume_pools": _POOLS + " SELECT material, boundary, count(*) AS n, round(sum(v), 5) AS total FROM pools GROUP BY ALL",
    "volume_sample": _SAMPLE,
    "volume_losses": _VOLUME + " SELECT a.gz, count(*) AS n, round(avg((a.v-b.v)**2), 9) AS mse, round(avg(abs(a.v-b.v)), 9) AS l1, round(avg(CASE WHEN abs(a.v-b.v) <= 1 THEN 0.5*(a.v-b.v)**2 ELSE abs(a.v-b.v)-0.5 END), 9) AS smooth_l1 FROM vol a JOIN vol b ON b.gx = a.gx+1 AND b.gy = a.gy AND b.gz = a.gz GROUP BY a.gz",
    "halo_activation": _GRADED + ", best AS (SELECT gx, gy, gz FROM graded ORDER BY round(gradient, 9) DESC, gx, gy, gz LIMIT 81) SELECT DISTINCT (gx+a)//2 AS gx, (gy+b)//2 AS gy, (gz+c)//2 AS gz FROM best, range(-1, 2) t(a), range(-1, 2) u(b), range(-1, 2) w(c) WHERE gx+a BETWEEN 0 AND 15 AND gy+b BETWEEN 0 AND 15 AND gz+c BETWEEN 0 AND 15",
    "shared_faces": f"WITH {_SHARED} SELECT own_level, own_ix, own_iy, own_iz, axis, side, level, ix, iy, iz FROM faces",
    "face_continuity": _CONTINUITY,
    "projection_gradient_loss": _EDGES,
    "residual_backprojection": _BACK,
}
