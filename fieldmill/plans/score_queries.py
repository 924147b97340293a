"""Weights, losses, attribution, gains and ranked selection under byte budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup, ordered, scores, tree
from ..storage import snapshot
from . import fixtures as fx
from . import oracles as o
from .inspect_queries import facts, predicted, r6

L, N, V, KEY = fx.LEVELS, fx.SIZE, fx.VIEWS, lookup.KEY
CHUNK = 64


def weighted(spark, sf, mode="inverse", made=None, **more):
    return scores.with_weights(scores.chunked(predicted(spark, sf, made), CHUNK), ["view_id", "chunk_id"], mode, **more)


def staged_facts(spark, sf):
    """The fact table written once, for queries that read it more than once."""
    return snapshot(facts(spark, sf), "facts")


def _weights(mode, **more):
    def query(spark, sf):
        rays = scores.chunked(fx.rays(spark, sf), CHUNK)
        return scores.with_weights(rays, ["view_id", "chunk_id"], mode, **more).select("ray_id", "chunk_id", F.round("weight", 6).alias("weight"))

    return query


def weighted_loss(spark, sf):
    return scores.weighted_loss(weighted(spark, sf, "sqrt_target"), "view_id").select("view_id", "n", r6("loss").alias("loss"))


def attribution(spark, sf):
    made = staged_facts(spark, sf)
    return scores.residual_scores(made, scores.per_path(weighted(spark, sf, "uniform", made)))


def leaf_residual_score(spark, sf):
    return attribution(spark, sf).select(*KEY, F.round("energy", 4).alias("energy"), F.round("exposure", 4).alias("exposure"), F.round("score", 4).alias("score"))


def _constant_facts(spark, sf, made):
    return made.join(lookup.sendable(fx.leaves(spark, sf).where("px = 0 and level < 2").select(*KEY)), KEY, "left_semi")


def haar(spark, sf, made=None):
    made = staged_facts(spark, sf) if made is None else made
    return scores.detail_gain(scores.haar_features(_constant_facts(spark, sf, made), L, N, V), scores.per_path(weighted(spark, sf, made=made)), 1e-3)


def trilinear(spark, sf, made=None):
    made = staged_facts(spark, sf) if made is None else made
    return scores.detail_gain(scores.trilinear_features(_constant_facts(spark, sf, made), L, N, V), scores.per_path(weighted(spark, sf, made=made)), 1e-3)


def haar_gain(spark, sf):
    return haar(spark, sf).select(*KEY, F.round("gain", 4).alias("gain"))


def trilinear_gain(spark, sf):
    return trilinear(spark, sf).select(*KEY, F.round("gain", 4).alias("gain"))


def hp_rates(spark, sf):
    """The better of splitting (99 bytes) and raising to trilinear (14 bytes) for each constant leaf."""
    made = staged_facts(spark, sf)
    both = haar(spark, sf, made).withColumnRenamed("gain", "h").join(trilinear(spark, sf, made).withColumnRenamed("gain", "p"), KEY)
    h, p = F.col("h") / 99.0, F.col("p") / 14.0
    return snapshot(both.select(*KEY, (h >= p).alias("split"), F.greatest(h, p).alias("rate")), "rates")


def hp_greedy_select(spark, sf):
    chosen = ordered.greedy_two_sizes(hp_rates(spark, sf), "rate", KEY, F.col("split"), 99, 14, 1000, 4)
    return chosen.select(*KEY, "split")


def gain_topk(spark, sf):
    """Best splits by gain under a byte budget and a leaf cap."""
    return haar(spark, sf).where("gain > 0").orderBy(F.desc("gain"), *KEY).limit(min(25, 2500 // 99)).select(*KEY, F.round("gain", 4).alias("gain"))


def face_neighbours(spark, sf):
    pairs = tree.face_neighbours(fx.leaves(spark, sf), L)
    return pairs.select(*(f"own_{c}" for c in KEY), "axis", "side", *KEY)


def face_jump(spark, sf):
    return tree.interface_jumps(fx.leaves(spark, sf), L).select(*KEY, "axis", r6("jump").alias("jump"))


def jump_rates(spark, sf):
    """Volume-scaled face jump of each leaf that can be split, per byte a split adds."""
    leaves = snapshot(fx.leaves(spark, sf), "leaves")
    jumps = tree.interface_jumps(leaves, L).groupBy(*KEY).agg(F.max("jump").alias("jump"))
    sized = leaves.where("level < 2").select(*KEY, F.size("coeffs").alias("count"))
    cell = 2.0 / lookup.resolution(F.col("level"), L)
    cost = (85 + 14 * F.col("count")).cast("long")
    return jumps.join(sized, KEY).select(*KEY, cost.alias("bytes"), (F.col("jump") * cell * cell * cell / cost).alias("rate")).where("rate > 0").transform(lambda df: snapshot(df, "rates"))


def jump_budget_select(spark, sf):
    return ordered.within_budget(jump_rates(spark, sf), "rate", KEY, F.col("bytes"), 6000, most=40).select(*KEY, "bytes")


def fraction_threshold_select(spark, sf):
    means = tree.with_mean(fx.leaves(spark, sf)).select(*KEY, "mu")
    scored = snapshot(attribution(spark, sf).join(means, KEY).where("level < 2"), "scored")
    return ordered.top_union(scored, "score", KEY, 0.1, 0.25, "mu", 0.06, 1.0).select(*KEY)


def quantile_band_select(spark, sf):
    return ordered.quantile_band(snapshot(attribution(spark, sf).where("level < 2"), "scored"), "score", 0.4, 0.8).select(*KEY)


QUERIES = {f"projection_weights_{m}": _weights(m) for m in ("inverse", "uniform", "target_power", "sqrt_target", "blend")}
QUERIES["projection_weights_clamped"] = _weights("inverse", low=0.5, high=2.0)
QUERIES |= {f.__name__: f for f in (weighted_loss, leaf_residual_score, haar_gain, trilinear_gain, hp_greedy_select, gain_topk, face_neighbours, face_jump, jump_budget_select, fraction_threshold_select, quantile_band_select)}

_CHUNKS = "chunks AS (SELECT *, (row_number() OVER (PARTITION BY view_id ORDER BY ray_id) - 1)//64 AS chunk_id FROM {source})"
_EVEN = "{v}/greatest(avg({v}) OVER (PARTITION BY view_id, chunk_id), 1e-4)"
_RAW = {"inverse": "1.0/greatest(abs(target),1e-4)", "uniform": "1.0::DOUBLE", "target_power": "abs(target)+1e-4", "sqrt_target": "sqrt(abs(target)+1e-4)"}


def _weighted_sql(mode: str, source: str) -> str:
    chunks = _CHUNKS.format(source=source)
    if mode == "blend":
        raw = f"parts AS (SELECT *, {_RAW['inverse']} AS a, {_RAW['target_power']} AS b FROM chunks), raw AS (SELECT *, 0.85*{_EVEN.format(v='a')} + 0.15*{_EVEN.format(v='b')} AS v FROM parts)"
    else:
        raw = f"raw AS (SELECT *, {_RAW[mode]} AS v FROM chunks)"
    return f"{chunks}, {raw}, weighted AS (SELECT *, {_EVEN.format(v='v')} AS weight FROM raw)"


ORACLES = {f"projection_weights_{m}": f"WITH {o.RAYS}, {_weighted_sql(m, 'rays')} SELECT ray_id, chunk_id, round(weight, 6) AS weight FROM weighted" for m in ("inverse", "uniform", "target_power", "sqrt_target", "blend")}
ORACLES["projection_weights_clamped"] = f"WITH {o.RAYS}, {_weighted_sql('inverse', 'rays')}, held AS (SELECT *, greatest(0.5, least(2.0, weight)) AS c FROM weighted) SELECT ray_id, chunk_id, round({_EVEN.format(v='c')}, 6) AS weight FROM held"

_W = lambda mode: f"WITH {o.PREDICTED}, {_weighted_sql(mode, 'predicted')}"
_SHARES = """, expo AS (SELECT view_id, row, col, sum(abs(integral)) AS whole FROM facts GROUP BY ALL),
met AS (SELECT f.*, w.weight, w.prediction-w.target AS off, whole FROM facts f JOIN weighted w USING (view_id, row, col) JOIN expo USING (view_id, row, col)),
attributed AS (SELECT level, ix, iy, iz, sum(weight*off*off*abs(integral)/greatest(whole,1e-8)) AS energy, sum(abs(integral)) AS exposure FROM met GROUP BY ALL),
scored AS (SELECT *, CASE WHEN exposure > 0 THEN energy/greatest(exposure,1e-8) ELSE 0 END AS score FROM attributed)"""


def _child_length(i: int, j: int) -> str:
    low, mid = "(-1+l.{c}*2.0/l.res+{k}/l.res)", "(-1+l.{c}*2.0/l.res+({k}+1)/l.res)"
    enter, leave, ok = o.slab(low.format(c="ix", k=i), mid.format(c="ix", k=i), low.format(c="iy", k=j), mid.format(c="iy", k=j))
    return f"CASE WHEN {ok} AND ({leave}) > ({enter}) + 1e-8 THEN ({leave}) - ({enter}) ELSE 0 END"


_CHILD = ", ".join(f"{_child_length(i, j)} AS l{i}{j}" for i in (0, 1) for j in (0, 1))
_PARENTS = "flat AS (SELECT * FROM leaves WHERE d = 0 AND level < 2)"
_BASIS = [lambda x, y, z: x, lambda x, y, z: y, lambda x, y, z: z, lambda x, y, z: x * y, lambda x, y, z: x * z, lambda x, y, z: y * z, lambda x, y, z: x * y * z]


def _haar_mode(k: int) -> str:
    """The k-th detail as a sum over the children a way crosses, zb being 1 in the upper half."""
    parts = [f"l{i}{j}*(CASE WHEN zb = 1 THEN {_BASIS[k](1 - 2 * i, 1 - 2 * j, -1)} ELSE {_BASIS[k](1 - 2 * i, 1 - 2 * j, 1)} END)" for i in (0, 1) for j in (0, 1)]
    return f"({' + '.join(parts)})/sqrt(8.0)"


def _gain_sql(features: str) -> str:
    gains = " + ".join(f"pow(sum(weight*off*f{k}),2)/(sum(weight*f{k}*f{k})+1e-3)" for k in range(7))
    return f", {_PARENTS}, {features}, gains AS (SELECT level, ix, iy, iz, 0.5*({gains}) AS gain FROM features f JOIN (SELECT view_id, row, col, weight, prediction-target AS off FROM weighted) w USING (view_id, row, col) GROUP BY ALL)"


_HAAR = "crossed AS (SELECT w.view_id, w.row, w.col, l.level, l.ix, l.iy, l.iz, (w.z >= -1+l.iz*2.0/l.res+1/l.res)::INT AS zb, " + _CHILD + " FROM facts JOIN ways w USING (view_id, row, col) JOIN flat l USING (level, ix, iy, iz)), features AS (SELECT *, " + ", ".join(f"{_haar_mode(k)} AS f{k}" for k in range(7)) + " FROM crossed)"
_E, _X, _OKAY = o.slab("-1+l.ix*2.0/l.res", "-1+(l.ix+1)*2.0/l.res", "-1+l.iy*2.0/l.res", "-1+(l.iy+1)*2.0/l.res")


def _corner_mode(k: int) -> str:
    total = []
    for i in (0, 1):
        for j in (0, 1):
            for m in (0, 1):
                sign = _BASIS[k](1 - 2 * i, 1 - 2 * j, 1 - 2 * m)
                total.append(f"({sign})*{'u' if i else '(1-u)'}*{'v' if j else '(1-v)'}*{'q' if m else '(1-q)'}")
    return f"sum(half*({' + '.join(total)}))/sqrt(8.0)"


_TRI = (
    f"inout AS (SELECT w.*, l.level, l.ix, l.iy, l.iz, l.res, {_E} AS a, {_X} AS b FROM facts JOIN ways w USING (view_id, row, col) JOIN flat l USING (level, ix, iy, iz) WHERE {_OKAY}), "
    "spots AS (SELECT *, (b-a)/2 AS half, least(greatest((bx+dx*((a+b)/2+(b-a)/2*s)+1)*res/2-ix,0),1) AS u, least(greatest((byy+dy*((a+b)/2+(b-a)/2*s)+1)*res/2-iy,0),1) AS v, least(greatest((z+1)*res/2-iz,0),1) AS q FROM inout, (VALUES (-1/sqrt(3.0)), (1/sqrt(3.0))) g(s) WHERE b > a + 1e-8), "
    "features AS (SELECT view_id, row, col, level, ix, iy, iz, " + ", ".join(f"{_corner_mode(k)} AS f{k}" for k in range(7)) + " FROM spots GROUP BY ALL)"
)

_PROBE = "probes AS (SELECT *, f//2 AS axis, f%2 AS side, " + ", ".join(f"-1+(i{a}+0.5)*2.0/res + CASE WHEN f//2={k} THEN (CASE WHEN f%2=1 THEN 1 ELSE -1 END)*(1.0/res+1e-5) ELSE 0 END AS {a}" for k, a in enumerate("xyz")) + " FROM leaves, range(6) t(f))"
_PAIRS = _PROBE + ", pairs AS (SELECT p.level AS own_level, p.ix AS own_ix, p.iy AS own_iy, p.iz AS own_iz, axis, side, l.level, l.ix, l.iy, l.iz FROM probes p JOIN leaves l ON " + " AND ".join(f"floor((p.{a}+1)*l.res/2) = l.i{a}" for a in "xyz") + ")"
_FACE = "faces AS (" + " UNION ALL ".join(f"SELECT level, ix, iy, iz, {k}::BIGINT AS axis, {s}::BIGINT AS side, avg(c) AS m FROM coeffs WHERE k{a} = {'d' if s else 0} GROUP BY ALL" for k, a in enumerate("xyz") for s in (0, 1)) + ")"
_JUMPS = f"WITH {o.LEAVES}, {o.COEFFS}, {_PAIRS}, {_FACE}, jumps AS (SELECT own_level AS level, own_ix AS ix, own_iy AS iy, own_iz AS iz, p.axis, max(abs(a.m-b.m)) AS jump FROM pairs p JOIN faces a ON a.level=own_level AND a.ix=own_ix AND a.iy=own_iy AND a.iz=own_iz AND a.axis=p.axis AND a.side=p.side JOIN faces b ON b.level=p.level AND b.ix=p.ix AND b.iy=p.iy AND b.iz=p.iz AND b.axis=p.axis AND b.side=1-p.side GROUP BY ALL)"

ORACLES |= {
    "weighted_loss": _W("sqrt_target") + " SELECT view_id, count(*) AS n, round(avg(weight*(prediction-target)**2), 6) AS loss FROM weighted GROUP BY view_id",
    "leaf_residual_score": _W("uniform") + _SHARES + " SELECT level, ix, iy, iz, round(energy, 4) AS energy, round(exposure, 4) AS exposure, round(score, 4) AS score FROM scored",
    "haar_gain": _W("inverse") + _gain_sql(_HAAR) + " SELECT level, ix, iy, iz, round(gain, 4) AS gain FROM gains",
    "trilinear_gain": _W("inverse") + _gain_sql(_TRI) + " SELECT level, ix, iy, iz, round(gain, 4) AS gain FROM gains",
    "gain_topk": _W("inverse") + _gain_sql(_HAAR) + " SELECT level, ix, iy, iz, round(gain, 4) AS gain FROM gains WHERE gain > 0 ORDER BY gains.gain DESC, level, ix, iy, iz LIMIT 25",
    "face_neighbours": f"WITH {o.LEAVES}, {_PAIRS} SELECT * FROM pairs",
    "face_jump": _JUMPS + " SELECT l.level, l.ix, l.iy, l.iz, t.axis, round(coalesce(jump, 0), 6) AS jump FROM leaves l CROSS JOIN range(3) t(axis) LEFT JOIN jumps j ON j.level=l.level AND j.ix=l.ix AND j.iy=l.iy AND j.iz=l.iz AND j.axis=t.axis",
    "jump_budget_select": _JUMPS + ", best AS (SELECT level, ix, iy, iz, max(jump) AS jump FROM jumps GROUP BY ALL), rates AS (SELECT level, ix, iy, iz, (85+14*len(mu))::BIGINT AS bytes, jump*pow(2.0/res,3)/(85+14*len(mu)) AS rate FROM best JOIN leaves USING (level, ix, iy, iz) WHERE level < 2 AND jump > 0), spent AS (SELECT *, sum(bytes) OVER w AS s, row_number() OVER w AS n FROM rates WINDOW w AS (ORDER BY rate DESC, level, ix, iy, iz ROWS UNBOUNDED PRECEDING)) SELECT level, ix, iy, iz, bytes FROM spent WHERE s <= 6000 AND n <= 40",
    "fraction_threshold_select": _W("uniform") + _SHARES + ", pool AS (SELECT s.*, list_avg(mu) AS m FROM scored s JOIN leaves USING (level, ix, iy, iz) WHERE level < 2), ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, level, ix, iy, iz) AS n, count(*) OVER () AS total, (SELECT quantile_cont(score, 0.95) FROM pool WHERE score > 0) AS bar FROM pool), hit AS (SELECT *, m >= 0.06 AS material FROM ranked WHERE n <= greatest(1, floor(total*0.1)) OR m >= 0.06 OR score >= bar), final AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN material THEN m END DESC NULLS LAST, score DESC, level, ix, iy, iz) AS place FROM hit) SELECT level, ix, iy, iz FROM final WHERE place <= floor(total*0.25)",
    "quantile_band_select": _W("uniform") + _SHARES + ", pool AS (SELECT * FROM scored WHERE level < 2 AND score > 0) SELECT level, ix, iy, iz FROM pool WHERE score BETWEEN (SELECT quantile_cont(score, 0.4) FROM pool) AND (SELECT quantile_cont(score, 0.8) FROM pool)",
    "hp_greedy_select": _W("inverse") + _gain_sql(_HAAR).replace("features", "hf").replace("gains AS", "hg AS") + ", " + _TRI.replace("features", "tf") + ", tg AS (" + "SELECT level, ix, iy, iz, 0.5*(" + " + ".join(f"pow(sum(weight*off*f{k}),2)/(sum(weight*f{k}*f{k})+1e-3)" for k in range(7)) + ") AS gain FROM tf JOIN (SELECT view_id, row, col, weight, prediction-target AS off FROM weighted) w USING (view_id, row, col) GROUP BY ALL), "
    "rates AS (SELECT level, ix, iy, iz, h.gain/99 >= t.gain/14 AS split, greatest(h.gain/99, t.gain/14) AS rate FROM hg h JOIN tg t USING (level, ix, iy, iz)), "
    "ordered AS (SELECT *, row_number() OVER (ORDER BY rate DESC, level, ix, iy, iz) AS n FROM rates WHERE rate > 0), "
    "steps AS (WITH RECURSIVE walk AS (SELECT 0::BIGINT AS n, 1000::BIGINT AS room, 4::BIGINT AS larges, false AS taken UNION ALL "
    "SELECT o.n, CASE WHEN ok THEN room - cost ELSE room END, CASE WHEN ok AND split THEN larges - 1 ELSE larges END, ok FROM (SELECT o.n, o.split, w.room, w.larges, CASE WHEN o.split THEN 99 ELSE 14 END AS cost, CASE WHEN o.split THEN w.room >= 99 AND w.larges > 0 ELSE w.room >= 14 END AS ok FROM walk w JOIN ordered o ON o.n = w.n + 1) o) SELECT * FROM walk) "
    "SELECT level, ix, iy, iz, split FROM ordered JOIN steps USING (n) WHERE taken",
}
