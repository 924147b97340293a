"""Topology changes, compression, encoding, stencils and iterative fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compress, encode, fit, lookup, metrics, rewrite, stencil, tree
from ..storage import snapshot
from . import fixtures as fx
from . import oracles as o
from .inspect_queries import predicted, r6

L, N, V, KEY = fx.LEVELS, fx.SIZE, fx.VIEWS, lookup.KEY
PRICE = 3e-7


def _coefficient_rows(leaves):
    return leaves.select(*KEY, F.posexplode("coeffs").alias("k", "v")).select(*KEY, F.col("k").cast("long").alias("k"), r6("v").alias("v"))


def split_leaves(spark, sf):
    t = fx.leaves(spark, sf)
    return _coefficient_rows(rewrite.split(t, t.where("level < 2 and px <= 1")))


def elevate_leaves(spark, sf):
    """Constant roots become trilinear: one axis after the other."""
    t = fx.leaves(spark, sf)
    for axis in "xyz":
        t = snapshot(rewrite.elevate(t, t.where(f"level = 0 and p{axis} = 0"), axis), "elevated")
    return _coefficient_rows(t.where("level = 0"))


def reduce_leaves(spark, sf):
    """Trilinear leaves lose their slope along x."""
    t = fx.leaves(spark, sf)
    return _coefficient_rows(rewrite.reduce_degree(t, t.where("px = 1"), "x").where("px = 0 and py = 1"))


def merge_siblings(spark, sf):
    t = fx.leaves(spark, sf)
    constant = t.where("px > 0 and level > 0").select((F.col("level") - 1).alias("level"), *(F.expr(f"i{x} div 2").alias(f"i{x}") for x in "xyz")).distinct()
    done = rewrite.merge(t, tree.sibling_groups(t).join(constant, KEY, "left_anti"), L)
    return _coefficient_rows(done)


def balance_2to1(spark, sf):
    done, complete = rewrite.balance(fx.leaves(spark, sf), L)
    return tree.level_stats(done, L).select("level", "leaves", "coefficients", F.lit(complete).alias("complete"))


def internal_nodes(spark, sf):
    return tree.ancestors(fx.leaves(spark, sf))


def sibling_groups(spark, sf):
    return tree.sibling_groups(fx.leaves(spark, sf))


def _grid_bank(spark, sf):
    return compress.candidate_bank(fx.grids(spark, sf).withColumn("volume", F.lit(0.125)), ["node"])


def candidate_bank(spark, sf):
    b = _grid_bank(spark, sf)
    return b.select("node", r6("p0").alias("p0"), *(F.round(c, 7).alias(c) for c in ("p0_dist", "p1_dist")), *(r6(c).alias(c) for c in ("p0_detail", "p1_detail")))


def candidate_bank_p1(spark, sf):
    return _grid_bank(spark, sf).select("node", F.posexplode("p1").alias("k", "c")).select("node", F.col("k").cast("long").alias("k"), r6("c").alias("c"))


def _tree_bank(spark, sf):
    t = fx.leaves(spark, sf)
    return t, snapshot(compress.candidate_bank(compress.node_samples(t, L), KEY), "bank")


def tree_dp_lambda(spark, sf):
    t, bank = _tree_bank(spark, sf)
    return compress.select_tree(t, bank, 3, [PRICE]).select(*KEY, F.col("action").cast("long").alias("action"), F.col("bytes").cast("long").alias("bytes"), F.round("dist", 8).alias("dist"))


def lambda_bisection(spark, sf):
    """Leaves per level of the tree that just fits half the bytes, and the bytes it takes."""
    t, bank = _tree_bank(spark, sf)
    full = t.agg(F.sum(tree.packed_bytes())).first()[0]
    price = compress.price_for(t, bank, 3, full / 2)
    chosen = snapshot(compress.select_tree(t, bank, 3, [price]), "chosen")
    return tree.level_stats(compress.pruned(t, bank, chosen), L).select("level", "leaves", "packed_bytes")


def pruned_decode(spark, sf):
    """The pruned field on a plane."""
    t, bank = _tree_bank(spark, sf)
    done = compress.pruned(t, bank, compress.select_tree(t, bank, 3, [PRICE]))
    return lookup.evaluate(lookup.dense_grid(spark, N, ("x", 9)), done, L, ["gy", "gz"]).select("gy", "gz", r6("value").alias("value"))


def _quantise(bits):
    def query(spark, sf):
        c = fx.leaves(spark, sf).select(*KEY, F.posexplode("coeffs").alias("k", "v"))
        q = compress.quantised(c, "v", bits)
        return q.select(*KEY, F.col("k").cast("long").alias("k"), "q", r6(compress.dequantised()).alias("back"))

    return query


def packed_nodes(spark, sf):
    return encode.packed_nodes(fx.leaves(spark, sf), L[0])


def split_bits(spark, sf):
    return encode.split_bits(fx.leaves(spark, sf), L[0]).select("level", "place", F.col("bit").cast("long").alias("bit"))


def image_gradient(spark, sf):
    return stencil.gradient_magnitude(fx.images(spark, sf), "v", ["row", "col"], ["view_id"]).select("view_id", "row", "col", F.round("gradient", 8).alias("gradient"))


def _volume(spark, sf):
    return lookup.evaluate(lookup.dense_grid(spark, N), fx.leaves(spark, sf), L, ["gx", "gy", "gz"])


AXES = ["gx", "gy", "gz"]


def volume_gradient(spark, sf):
    return stencil.gradient_magnitude(_volume(spark, sf), "value", AXES, []).select(*AXES, r6("gradient").alias("gradient"))


def total_variation(spark, sf):
    return stencil.total_variation(_volume(spark, sf), "value", AXES).select(r6("tv").alias("tv"))


def local_sigma(spark, sf):
    return stencil.local_sigma(_volume(spark, sf), "value", AXES).select(*AXES, F.round("sigma", 5).alias("sigma"))


def normalised_score(spark, sf):
    g = stencil.gradient_magnitude(fx.images(spark, sf), "v", ["row", "col"], ["view_id"])
    return stencil.normalised(g, "gradient").select("view_id", "row", "col", r6("score").alias("score"))


def image_comparison(spark, sf):
    both = predicted(spark, sf).groupBy("view_id", "row", "col").agg(F.avg("prediction").alias("a"), F.avg("target").alias("b"))
    return metrics.comparison(both, "a", "b", "view_id").select("view_id", r6("mae").alias("mae"), r6("rmse").alias("rmse"), F.round("psnr", 4).alias("psnr"), r6("ssim").alias("ssim"))


def percentile_range(spark, sf):
    return metrics.display_range(fx.images(spark, sf), "v", "view_id").select("view_id", F.round("low", 8).alias("low"), F.round("high", 8).alias("high"))


def material_metrics(spark, sf):
    """Where the field exceeds a threshold: count, and error of its mean per cell against the field."""
    t = tree.with_mean(fx.leaves(spark, sf)).select("*", F.array("mu").alias("flat"))
    flat = t.select(*KEY, *(F.lit(0).cast("long").alias(f"p{x}") for x in "xyz"), F.col("flat").alias("coeffs"))
    a = _volume(spark, sf).where("value > 0.05").withColumnRenamed("value", "target")
    b = lookup.evaluate(lookup.dense_grid(spark, N), flat, L, AXES).withColumnRenamed("value", "prediction")
    return metrics.projection_metrics(a.join(b, AXES)).select("n", r6("mae").alias("mae"), F.round("psnr", 4).alias("psnr"))


def _loss_arrays(spark, sf):
    """Mean target of each 50 rays of a view, in arrival order."""
    from pyspark.sql.window import Window

    place = F.floor((F.row_number().over(Window.partitionBy("view_id").orderBy("ray_id")) - 1) / 50)
    means = fx.rays(spark, sf).withColumn("i", place).groupBy("view_id", "i").agg(F.avg("target").alias("v"))
    return means.groupBy("view_id").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("l")).select("view_id", F.transform("l", lambda x: x["v"]).alias("values"))


def ema_last(spark, sf):
    return _loss_arrays(spark, sf).select("view_id", r6(F.element_at(fit.ema(F.col("values"), 5), -1)).alias("ema"))


def convergence_window(spark, sf):
    p = fit.plateau(F.col("values"), 8, 0.02)
    return _loss_arrays(spark, sf).select("view_id", p.alias("p")).select("view_id", r6("p.start").alias("start"), r6("p.end").alias("end"), r6("p.improvement").alias("improvement"), "p.ready")


def kmeans_1d(spark, sf):
    rows, centres = fit.kmeans_1d(tree.with_mean(fx.leaves(spark, sf)), "mu", 4)
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), r6(F.avg("mu")).alias("mu"))


def mact_groups(spark, sf):
    """Principal templates of leaves by degree, material cluster and principal axis."""
    t = fx.leaves(spark, sf)
    rows, _ = fit.kmeans_1d(t.withColumn("dc", F.element_at("coeffs", 1)), "dc", 4)
    axes = tree.interface_jumps(t, L).groupBy(*KEY).agg(F.max(F.struct("jump", (-F.col("axis")).alias("a"))).alias("x")).select(*KEY, (-F.col("x.a")).alias("axis"))
    made = fit.group_bases(rows.join(axes, KEY).select("px", "cluster", "axis", "coeffs"), ["px", "cluster", "axis"], "coeffs")
    return made.select("px", "cluster", "axis", "n", "rank", r6(F.element_at("mean", 1)).alias("first_mean"))


def coefficient_gradient(spark, sf):
    return fit.coefficient_gradient(fx.rays(spark, sf), fx.logit_leaves(spark, sf), -3.0, L, N, V).select(*KEY, "coefficient", (F.round("gradient", 7) + 0.0).alias("gradient"))


def adam_steps(spark, sf):
    rays = fx.rays(spark, sf).where("view_id in (1, 2)")
    return fit.adam(rays, fx.logit_leaves(spark, sf), -3.0, L, N, V, 2).select(*KEY, "coefficient", F.round("logit", 5).alias("logit"))


QUERIES = {f.__name__: f for f in (split_leaves, elevate_leaves, reduce_leaves, merge_siblings, balance_2to1, internal_nodes, sibling_groups, candidate_bank, candidate_bank_p1, tree_dp_lambda, lambda_bisection, pruned_decode, packed_nodes, split_bits, image_gradient, volume_gradient, total_variation, local_sigma, normalised_score, image_comparison, percentile_range, material_metrics, ema_last, convergence_window, kmeans_1d, mact_groups, coefficient_gradient, adam_steps)}
QUERIES |= {"quantize_u8": _quantise(8), "quantize_u16": _quantise(16)}

_DESIGN, _INVERSE = compress.p1_design()
_FIT = "fit(k, spot, w, b) AS (VALUES " + ", ".join(f"({k},{s},{float(_INVERSE[k, s])!r},{float(_DESIGN[s, k])!r})" for k in range(8) for s in range(64)) + ")"


def _bank_sql(source: str, key: str) -> str:
    """bank(key, p0, p0_dist, p1_dist, p0_detail, p1_detail) and p1c(key, k, c) of samples(key, volume, spot, v)."""
    def on(a: str, b: str) -> str:
        return " AND ".join(f"{a}.{c.strip()}={b}.{c.strip()}" for c in key.split(","))

    def detail(t: str, v: str) -> str:
        return " UNION ALL ".join(f"SELECT {', '.join('a.' + c.strip() for c in key.split(','))}, avg((b.{v}-a.{v})**2)*9 AS q FROM {t} a JOIN {t} b ON {on('a', 'b')} AND b.spot=a.spot+{s} AND {ok} GROUP BY ALL" for s, ok in ((16, "a.spot//16<3"), (4, "(a.spot//4)%4<3"), (1, "a.spot%4<3")))

    return f"""{_FIT},
p1c AS (SELECT {key}, k, greatest(sum(v*w::DOUBLE), 1e-12) AS c FROM {source} JOIN fit USING (spot) GROUP BY ALL),
made AS (SELECT {key}, spot, sum(c*b::DOUBLE) AS f FROM p1c JOIN fit USING (k) GROUP BY ALL),
offs AS (SELECT s.*, v-f AS r FROM {source} s JOIN made USING ({key}, spot)),
d0 AS (SELECT {key}, sum(q) AS q0 FROM ({detail(source, 'v')}) GROUP BY ALL),
d1 AS (SELECT {key}, sum(q) AS q1 FROM ({detail('offs', 'r')}) GROUP BY ALL),
bank AS (SELECT {key}, avg(v) AS p0, var_pop(v)*volume AS p0_dist, avg(r*r)*volume AS p1_dist, any_value(q0)*volume AS p0_detail, any_value(q1)*volume AS p1_detail FROM offs JOIN d0 USING ({key}) JOIN d1 USING ({key}) GROUP BY {key}, volume)"""


_NODES = "up AS (SELECT DISTINCT u AS level, ix >> (level-u)::INT AS ix, iy >> (level-u)::INT AS iy, iz >> (level-u)::INT AS iz FROM leaves, range(2) t(u) WHERE u < level)"
_NODE_SAMPLES = "node_spots AS (SELECT level AS nl, ix AS nx, iy AS ny, iz AS nz, spot, pow(2.0/(4*2**level), 3) AS volume, " + ", ".join(f"-1+(i{a}+({p}+0.5)/4)*2.0/(4*2**level) AS {a}" for a, p in (("x", "spot//16"), ("y", "(spot//4)%4"), ("z", "spot%4"))) + " FROM up, range(64) t(spot))"
_TREE_BANK = f"WITH {o.LEAVES}, {o.COEFFS}, {_NODES}, {_NODE_SAMPLES}, {o.value_at('node_spots')}, samples AS (SELECT nl, nx, ny, nz, volume, spot, value AS v FROM values_at), {_bank_sql('samples', 'nl, nx, ny, nz')}"


def _dp(level: int, below: str) -> str:
    return f"""kids{level} AS (SELECT ix//2 AS nx, iy//2 AS ny, iz//2 AS nz, sum(bytes)+8 AS kb, sum(dist) AS kd FROM {below} GROUP BY ALL),
cost{level} AS (SELECT b.*, kb, kd, kd+{PRICE!r}::DOUBLE*kb AS c0, p0_dist+{PRICE!r}::DOUBLE*13 AS c1, p1_dist+{PRICE!r}::DOUBLE*27 AS c2 FROM kids{level} JOIN bank b USING (nx, ny, nz) WHERE nl = {level}),
act{level} AS (SELECT *, CASE WHEN c0 <= c1 AND c0 <= c2 THEN 0 WHEN c1 <= c2 THEN 1 ELSE 2 END AS action FROM cost{level}),
done{level} AS (SELECT nx AS ix, ny AS iy, nz AS iz, action, CASE action WHEN 0 THEN kb WHEN 1 THEN 13 ELSE 27 END AS bytes, CASE action WHEN 0 THEN kd WHEN 1 THEN p0_dist ELSE p1_dist END AS dist FROM act{level})"""


_DP = _TREE_BANK + ", leaf2 AS (SELECT ix, iy, iz, 11+2*len(mu) AS bytes, 0.0::DOUBLE AS dist FROM leaves WHERE level=2), " + _dp(1, "leaf2") + ", at1 AS (SELECT ix, iy, iz, bytes, dist FROM done1 UNION ALL SELECT ix, iy, iz, 11+2*len(mu), 0.0 FROM leaves WHERE level=1), " + _dp(0, "at1")
_QUANT = "WITH {leaves}, c AS (SELECT level, ix, iy, iz, unnest(range(len(mu))) AS k, unnest(mu) AS v FROM leaves), b AS (SELECT min(v) AS low, CASE WHEN max(v) > min(v) THEN max(v)-min(v) ELSE 1 END/{top}.0::DOUBLE AS scale FROM c), q AS (SELECT c.*, low, scale, round_even(least(greatest((v-low)/scale, 0), {top}), 0) AS q FROM c, b) SELECT level, ix, iy, iz, k, q::BIGINT AS q, round(low+q*scale, 6) AS back FROM q"
_VOLUME = f"WITH {o.LEAVES}, {o.COEFFS}, {o.DENSE}, {o.value_at('dense')}, vol AS (SELECT gx, gy, gz, value AS v FROM values_at)"
_IMG_GRAD = f"WITH {o.RAYS}, {o.IMAGES}, g AS (SELECT *, coalesce(0.5*(lead(v) OVER a - lag(v) OVER a),0) AS dr, coalesce(0.5*(lead(v) OVER b - lag(v) OVER b),0) AS dc FROM images WINDOW a AS (PARTITION BY view_id, col ORDER BY row), b AS (PARTITION BY view_id, row ORDER BY col)), m AS (SELECT view_id, row, col, sqrt(dr*dr+dc*dc) AS gradient FROM g)"
_PARTS = f"WITH {o.RAYS}, numbered AS (SELECT *, (row_number() OVER (PARTITION BY view_id ORDER BY ray_id)-1)//50 AS i FROM rays), means AS (SELECT view_id, i, avg(target) AS v FROM numbered GROUP BY ALL), arrays AS (SELECT view_id, list(v ORDER BY i) AS values FROM means GROUP BY view_id)"
_CHILD_AT = lambda a: f"(o{a}+j{a})/2.0"

_PACKED = f"WITH {o.LEAVES}, {_NODES}, nodes AS (SELECT level, ix, iy, iz, 0 AS leaf FROM up UNION ALL SELECT level, ix, iy, iz, 1 FROM leaves), p0 AS (SELECT *, ((ix >> level::INT)*4+(iy >> level::INT))*4+(iz >> level::INT) AS root, CASE WHEN level >= 1 THEN ((ix >> (level-1)::INT)%2)*4+((iy >> (level-1)::INT)%2)*2+(iz >> (level-1)::INT)%2 ELSE 0 END AS o1, CASE WHEN level >= 2 THEN (ix%2)*4+(iy%2)*2+iz%2 ELSE 0 END AS o2 FROM nodes), packed AS (SELECT row_number() OVER w - 1 AS node_id, level, ix, iy, iz, CASE WHEN leaf = 0 THEN (64+8*(sum(1-leaf) OVER w - 1))::BIGINT END AS child_base, CASE WHEN leaf = 1 THEN (sum(leaf) OVER w - 1)::BIGINT END AS leaf_id FROM p0 WINDOW w AS (ORDER BY level, root, o1, o2 ROWS UNBOUNDED PRECEDING))"

# each round takes the means of the values nearest to the centres before it; an empty cluster keeps its centre
_NEAREST = "list_position(list_transform(c, lambda x: abs(mu-x)), list_min(list_transform(c, lambda x: abs(mu-x))))"
_ROUNDS = ", ".join(f"r{i + 1} AS (SELECT list(coalesce(m, c0) ORDER BY k) AS c FROM (SELECT k, any_value(c[k]) AS c0, avg(mu) FILTER (near = k) AS m FROM (SELECT mu, c, {_NEAREST} AS near FROM means, r{i}), range(1, 5) t(k) GROUP BY k))" for i in range(25))
_KMEANS = f"WITH {o.LEAVES}, means AS (SELECT list_avg(mu) AS mu FROM leaves), r0 AS (SELECT quantile_cont(mu, [0, 1.0/3, 2.0/3, 1]) AS c FROM means), {_ROUNDS}"
_TRILINEAR = "list_sum(list_transform(range(8), lambda k: {p}[k+1] * (CASE WHEN (k//4)%2 = 1 THEN {x} ELSE 1-{x} END) * (CASE WHEN (k//2)%2 = 1 THEN {y} ELSE 1-{y} END) * (CASE WHEN k%2 = 1 THEN {z} ELSE 1-{z} END)))"


def _pruned_value(level: int) -> str:
    spot = {a: f"(({a}+1)*{4 * 2**level}/2.0-floor(({a}+1)*{4 * 2**level}/2.0))" for a in "xyz"}
    return f"WHEN a{level}.action = 1 THEN b{level}.p0 WHEN a{level}.action = 2 THEN " + _TRILINEAR.format(p=f"b{level}.p1", **spot)


_ON = lambda level, t, keys: " AND ".join(f"{t}.{k} = floor((v.{a}+1)*{4 * 2**level}/2.0)" for a, k in zip("xyz", keys))
_PRUNED = _DP + f", {o.DENSE}, plane AS (SELECT * FROM dense WHERE gx = 9), {o.value_at('plane').replace('at_leaf', 'plane_leaf').replace('values_at', 'plane_values')}, blocks AS (SELECT nl, nx, ny, nz, any_value(p0) AS p0, list(c ORDER BY k) AS p1 FROM bank JOIN p1c USING (nl, nx, ny, nz) GROUP BY ALL) SELECT v.gy, v.gz, round(CASE {_pruned_value(0)} {_pruned_value(1)} ELSE v.value END, 6) AS value FROM plane_values v LEFT JOIN done0 a0 ON {_ON(0, 'a0', ('ix', 'iy', 'iz'))} LEFT JOIN blocks b0 ON b0.nl = 0 AND {_ON(0, 'b0', ('nx', 'ny', 'nz'))} LEFT JOIN done1 a1 ON {_ON(1, 'a1', ('ix', 'iy', 'iz'))} LEFT JOIN blocks b1 ON b1.nl = 1 AND {_ON(1, 'b1', ('nx', 'ny', 'nz'))}"

ORACLES = {
    "merge_siblings": f"WITH {o.LEAVES}, {o.COEFFS}, par AS (SELECT level-1 AS pl, ix//2 AS px, iy//2 AS py, iz//2 AS pz, greatest(avg(mu[1]), 1e-12) AS v FROM leaves WHERE level > 0 GROUP BY ALL HAVING count(*) = 8 AND max(d) = 0) SELECT pl AS level, px AS ix, py AS iy, pz AS iz, 0::BIGINT AS k, round(v, 6) AS v FROM par UNION ALL SELECT level, ix, iy, iz, k::BIGINT, round(c, 6) FROM coeffs LEFT JOIN par ON pl = level-1 AND px = ix//2 AND py = iy//2 AND pz = iz//2 WHERE pl IS NULL",
    "kmeans_1d": _KMEANS + f" SELECT ({_NEAREST}-1)::INT AS cluster, count(*) AS n, round(avg(mu), 6) AS mu FROM means, r25 GROUP BY 1",
    "pruned_decode": _PRUNED,
    "packed_nodes": _PACKED + " SELECT * FROM packed",
    "split_bits": _PACKED + " SELECT level, node_id - min(node_id) OVER (PARTITION BY level) AS place, (child_base IS NOT NULL)::BIGINT AS bit FROM packed",
    "internal_nodes": f"WITH {o.LEAVES}, {_NODES} SELECT level, ix, iy, iz FROM up",
    "sibling_groups": f"WITH {o.LEAVES} SELECT level-1 AS level, ix//2 AS ix, iy//2 AS iy, iz//2 AS iz FROM leaves WHERE level > 0 GROUP BY ALL HAVING count(*) = 8",
    "split_leaves": f"WITH {o.LEAVES}, {o.COEFFS}, cut AS (SELECT * FROM leaves WHERE level < 2 AND d <= 1), kidk AS (SELECT c.level+1 AS level, 2*ix+ox AS ix, 2*iy+oy AS iy, 2*iz+oz AS iz, d, mu, ox, oy, oz, jx, jy, jz FROM cut c, range(2) a(ox), range(2) b(oy), range(2) e(oz), range(2) f(jx), range(2) g(jy), range(2) h(jz) WHERE jx <= d AND jy <= d AND jz <= d), vals AS (SELECT level, ix, iy, iz, (jx*(d+1)+jy)*(d+1)+jz AS k, CASE WHEN d = 0 THEN mu[1] ELSE "
    + " + ".join(f"mu[{a * 4 + b * 2 + c + 1}]*" + "*".join(f"{_CHILD_AT(x)}" if i else f"(1-{_CHILD_AT(x)})" for x, i in zip("xyz", (a, b, c))) for a in (0, 1) for b in (0, 1) for c in (0, 1))
    + " END AS v FROM kidk) SELECT level, ix, iy, iz, k, round(v, 6) AS v FROM vals UNION ALL SELECT level, ix, iy, iz, k, round(c, 6) FROM coeffs WHERE NOT (level < 2 AND d <= 1)",
    "elevate_leaves": f"WITH {o.LEAVES}, e AS (SELECT level, ix, iy, iz, CASE WHEN d = 0 THEN list_transform(range(8), lambda i: mu[1]) ELSE mu END AS mu FROM leaves WHERE level = 0), u AS (SELECT level, ix, iy, iz, unnest(range(len(mu))) AS k, unnest(mu) AS v FROM e) SELECT level, ix, iy, iz, k, round(v, 6) AS v FROM u",
    "reduce_leaves": f"WITH {o.LEAVES}, t AS (SELECT level, ix, iy, iz, unnest(range(4)) AS k, mu FROM leaves WHERE d = 1) SELECT level, ix, iy, iz, k, round(greatest((mu[k+1]+mu[k+5])/2, 1e-12), 6) AS v FROM t",
    "candidate_bank": f"WITH {o.GRIDS}, samples AS (SELECT node, 0.125::DOUBLE AS volume, spot, v FROM grids), {_bank_sql('samples', 'node')} SELECT node, round(p0,6) AS p0, round(p0_dist,7) AS p0_dist, round(p1_dist,7) AS p1_dist, round(p0_detail,6) AS p0_detail, round(p1_detail,6) AS p1_detail FROM bank",
    "candidate_bank_p1": f"WITH {o.GRIDS}, samples AS (SELECT node, 0.125::DOUBLE AS volume, spot, v FROM grids), {_bank_sql('samples', 'node')} SELECT node, k::BIGINT AS k, round(c,6) AS c FROM p1c",
    "tree_dp_lambda": _DP + " SELECT 1::BIGINT AS level, ix, iy, iz, action::BIGINT AS action, bytes::BIGINT AS bytes, round(dist, 8) AS dist FROM done1 UNION ALL SELECT 0, ix, iy, iz, action, bytes::BIGINT, round(dist, 8) FROM done0",
    "quantize_u8": _QUANT.format(leaves=o.LEAVES, top=255),
    "quantize_u16": _QUANT.format(leaves=o.LEAVES, top=65535),
    "image_gradient": _IMG_GRAD + " SELECT view_id, row, col, round(gradient, 8) AS gradient FROM m",
    "normalised_score": _IMG_GRAD + ", b AS (SELECT quantile_cont(gradient,0.01) AS lo, quantile_cont(gradient,0.99) AS hi FROM m) SELECT view_id, row, col, round(least(greatest((gradient-lo)/greatest(hi-lo,1e-8),0),1),6) AS score FROM m, b",
    "volume_gradient": _VOLUME + ", g AS (SELECT *, coalesce(0.5*(lead(v) OVER a - lag(v) OVER a),0) AS dx, coalesce(0.5*(lead(v) OVER b - lag(v) OVER b),0) AS dy, coalesce(0.5*(lead(v) OVER c - lag(v) OVER c),0) AS dz FROM vol WINDOW a AS (PARTITION BY gy,gz ORDER BY gx), b AS (PARTITION BY gx,gz ORDER BY gy), c AS (PARTITION BY gx,gy ORDER BY gz)) SELECT gx, gy, gz, round(sqrt(dx*dx+dy*dy+dz*dz), 6) AS gradient FROM g",
    "total_variation": _VOLUME + " SELECT round((SELECT avg(abs(b.v-a.v)) FROM vol a JOIN vol b ON b.gx=a.gx+1 AND b.gy=a.gy AND b.gz=a.gz)+(SELECT avg(abs(b.v-a.v)) FROM vol a JOIN vol b ON b.gx=a.gx AND b.gy=a.gy+1 AND b.gz=a.gz)+(SELECT avg(abs(b.v-a.v)) FROM vol a JOIN vol b ON b.gx=a.gx AND b.gy=a.gy AND b.gz=a.gz+1), 6) AS tv",
    "local_sigma": _VOLUME + " SELECT a.gx, a.gy, a.gz, round(sqrt(greatest(sum(b.v*b.v)/27-pow(sum(b.v)/27,2),0)), 5) AS sigma FROM vol a JOIN vol b ON abs(a.gx-b.gx)<=1 AND abs(a.gy-b.gy)<=1 AND abs(a.gz-b.gz)<=1 GROUP BY ALL",
    "image_comparison": f"WITH {o.PREDICTED}, m AS (SELECT view_id, row, col, avg(prediction) AS a, avg(target) AS b FROM predicted GROUP BY ALL), s AS (SELECT view_id, avg(abs(a-b)) AS mae, sqrt(avg((a-b)**2)) AS rmse, avg((a-b)**2) AS mse, max(b) AS top, greatest(max(b)-min(b),1e-8) AS r, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a,b) AS cab FROM m GROUP BY view_id) SELECT view_id, round(mae,6) AS mae, round(rmse,6) AS rmse, round(20*log10(greatest(top,1e-8))-10*log10(greatest(mse,1e-20)),4) AS psnr, round(greatest(-1,least(1,(2*ma*mb+pow(0.01*r,2))*(2*cab+pow(0.03*r,2))/((ma*ma+mb*mb+pow(0.01*r,2))*(va+vb+pow(0.03*r,2))))),6) AS ssim FROM s",
    "percentile_range": f"WITH {o.RAYS}, {o.IMAGES}, q AS (SELECT view_id, quantile_cont(v,0.01) AS a, quantile_cont(v,0.995) AS b, min(v) AS lo, max(v) AS hi FROM images GROUP BY view_id) SELECT view_id, round(CASE WHEN b<=a THEN lo ELSE a END,8) AS low, round(CASE WHEN b<=a THEN CASE WHEN hi>lo THEN hi ELSE lo+1 END ELSE b END,8) AS high FROM q",
    "material_metrics": _VOLUME + ", w AS (SELECT v.value AS target, list_avg(l.mu) AS prediction FROM values_at v JOIN leaves l USING (level, ix, iy, iz) WHERE v.value > 0.05) SELECT count(*) AS n, round(avg(abs(prediction-target)),6) AS mae, round(20*log10(greatest(max(target),1e-8))-10*log10(greatest(avg((prediction-target)**2),1e-20)),4) AS psnr FROM w",
    "ema_last": _PARTS + " SELECT view_id, round(list_reduce(values, lambda s, x: s*(1-2.0/6)+x*(2.0/6)), 6) AS ema FROM arrays",
    "convergence_window": _PARTS + ", w AS (SELECT view_id, values[-8:] AS r, len(values) >= 8 AS enough FROM arrays), e AS (SELECT view_id, enough, (r[1]+r[2])/2 AS s, (r[-2]+r[-1])/2 AS t FROM w) SELECT view_id, CASE WHEN enough THEN round(s,6) END AS start, CASE WHEN enough THEN round(t,6) END AS \"end\", CASE WHEN enough THEN round((s-t)/greatest(abs(s),1e-12),6) END AS improvement, CASE WHEN enough THEN (s-t)/greatest(abs(s),1e-12) >= -0.005 AND (s-t)/greatest(abs(s),1e-12) < 0.02 END AS ready FROM e",
    "coefficient_gradient": f"WITH {o.PREDICTED}, paths AS (SELECT view_id, row, col, sum(prediction-target) AS off FROM predicted GROUP BY ALL), slopes AS (SELECT level, ix, iy, iz, k, sum(off*w)/(SELECT count(*) FROM rays) AS s FROM parts JOIN paths USING (view_id, row, col) GROUP BY ALL), each AS (SELECT level, ix, iy, iz, unnest(range(len(logits))) AS k, unnest(logits) AS lg FROM logit_leaves) SELECT level, ix, iy, iz, k AS coefficient, round(coalesce(s,0)/(1+exp(-(lg-3))), 7) + 0.0 AS gradient FROM each LEFT JOIN slopes USING (level, ix, iy, iz, k)",
}
