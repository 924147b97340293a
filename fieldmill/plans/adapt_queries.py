"""Queries of adaptive rounds: diagnostics, proposals, masked tuning, and whole rounds on branches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adapt, lookup, rewrite, sampling, scores
from . import fixtures as fx
from . import oracles as o
from .fit_queries import _drawn
from .score_queries import CHUNK, _weighted_sql

L, N, V, KEY = fx.LEVELS, fx.SIZE, fx.VIEWS, lookup.KEY
SEED, PRICE, MERGE_PRICE = 7, 1e-10, 1e-11
#: Adam moves a logit by its rate; a plain step by the rate times a gradient that is a mean over all rays.
ADAM_RATE, PLAIN_RATE = 0.05, 1e6
SPLITS = {"p": False, "least_jump": 0.02}
RISES = {"h": False, "least_variation": 0.05, "least_ratio": 0.5}


def coefficient_diagnostics(spark, sf):
    found = adapt.diagnostics(fx.leaves(spark, sf), L)
    return found.select(*KEY, *(F.round(f"{k}_{a}", 5).alias(f"{k}_{a}") for k in ("variation", "ratio", "jump") for a in "xyz"))


def forward_proposals(spark, sf):
    """Splits where jumps are large, else rises in degree: the 300 best."""
    made = adapt.forward_proposals(adapt.diagnostics(fx.leaves(spark, sf), L), L, 300, least_variation=0.05, least_jump=0.02)
    return made.withColumn("score", F.round("score", 5))


def isotropic_proposals(spark, sf):
    made = adapt.forward_proposals(adapt.diagnostics(fx.leaves(spark, sf), L), L, 300, least_variation=0.05, h=False, isotropic=True)
    return made.withColumn("score", F.round("score", 5))


def reverse_proposals(spark, sf):
    leaves = fx.leaves(spark, sf)
    return adapt.reverse_proposals(leaves, adapt.diagnostics(leaves, L), 200).withColumn("score", F.round("score", 5))


def _model(spark, sf):
    """The fixture tree with the weighted rays of both sides of the held-out split."""
    rays = scores.with_weights(scores.chunked(fx.rays(spark, sf), CHUNK), ["view_id", "chunk_id"])
    sides = rays.join(F.broadcast(sampling.held_out_views(rays, 0.25, SEED)), "view_id")
    return adapt.first_model(fx.leaves(spark, sf), sides.where("not held_out"), sides.where("held_out"), L, N, V)


def _round(forward, reverse, rate, **proposing):
    def query(spark, sf):
        model = _model(spark, sf)
        after, audit = adapt.adaptive_round(model, L, N, V, forward, reverse, 1, rate, PRICE, MERGE_PRICE, **proposing)
        if after is not model:
            after.drop()
        model.drop()
        rounded = {"diagnostic": 5, "before": 11, "after": 11, "gain": 11}
        return audit.select("place", "action", *KEY, "axis", "added_bytes", "accepted", *((F.round(c, n) + 0.0).alias(c) for c, n in rounded.items()))

    return query


def masked_tuning(spark, sf):
    """Leaves of the root level raised by one degree along x, after one step along the new direction alone."""
    model = _model(spark, sf)
    rows = model.leaves.where("level = 0 and px < 3").orderBy(*KEY).limit(4).collect()
    out = None
    for r in rows:
        made = adapt.branch(model, {"action": "p_elevate", **{c: r[c] for c in KEY}, "axis": 0}, L, N, V)
        adapt.tune(model, made, 1, PLAIN_RATE, axis=0)
        one = spark.createDataFrame([(*(r[c] for c in KEY), k, float(v)) for k, v in enumerate(made.mu)], "level long, ix long, iy long, iz long, coefficient long, mu double")
        out = one if out is None else out.union(one)
    return out.withColumn("mu", F.round("mu", 9))


QUERIES = {f.__name__: f for f in (coefficient_diagnostics, forward_proposals, isotropic_proposals, reverse_proposals, masked_tuning)}
QUERIES |= {"adaptive_round_splits": _round(3, 2, ADAM_RATE, **SPLITS), "adaptive_round_rises": _round(4, 1, PLAIN_RATE, **RISES)}


# --- The same in SQL, on one row for each coefficient of a model m(key, px, py, pz, kx, ky, kz, c).

_KEYS = "level, ix, iy, iz"
_RES = "(4*2**{t}level)::DOUBLE"
_MODEL = f"m0 AS (SELECT {_KEYS}, d AS px, d AS py, d AS pz, kx, ky, kz, c FROM coeffs)"
_PINV = "pinv(p, i, s, w) AS (VALUES " + ", ".join(f"({p}, {i}, {s}, {float(w)!r}::DOUBLE)" for p in range(4) for i, row in enumerate(rewrite.fit_matrix(p)) for s, w in enumerate(row)) + ")"
_CHOOSE = "([[1],[1,1],[1,2,1],[1,3,3,1]][{n}+1][{k}+1])::DOUBLE"


def _basis(p: str, k: str, x: str) -> str:
    t = f"least(greatest({x}, 0), 1)"
    return f"({_CHOOSE.format(n=p, k=k)} * pow({t}, {k}) * pow(1-{t}, {p}-{k}))"


def _diagnosed(m: str, lv: str = "lv", diag: str = "diag") -> str:
    """lv(key, px, py, pz) and diag(key, px, py, pz, axis, p, variation, ratio, jump) of a model."""
    def along(axis: int, a: str) -> str:
        rest = " AND ".join(f"a.k{b} = b.k{b}" for b in "xyz" if b != a)
        steps = f"SELECT a.level, a.ix, a.iy, a.iz, max(abs(b.c-a.c)) AS steep, max(abs(b.c-a.c)) FILTER (a.k{a} = 0) AS low, max(abs(b.c-a.c)) FILTER (a.k{a} = a.p{a}-1) AS high FROM {m} a JOIN {m} b ON a.level = b.level AND a.ix = b.ix AND a.iy = b.iy AND a.iz = b.iz AND b.k{a} = a.k{a}+1 AND {rest} GROUP BY ALL"
        mean = lambda at: f"SELECT {_KEYS}, avg(c) AS v FROM {m} WHERE k{a} = {at} GROUP BY ALL"
        spot = {b: f"-1+(p.i{b}+0.5)*2.0/{_RES.format(t='p.')}" + (f"+(2*s-1)*(1.0/{_RES.format(t='p.')}+1e-5)" if b == a else "") for b in "xyz"}
        inside = " AND ".join(f"floor(({spot[b]}+1)*{_RES.format(t='q.')}/2.0) = q.i{b}" for b in "xyz")
        own, other = (f"(SELECT *, {k} AS s FROM ({mean('0')}) UNION ALL SELECT *, {1 - k} FROM ({mean(f'p{a}')}))" for k in (0, 1))
        jumps = f"SELECT p.level, p.ix, p.iy, p.iz, max(abs(f.v-g.v)) AS jump FROM {lv} p JOIN range(2) t(s) ON true JOIN {lv} q ON {inside} JOIN {own} f ON f.level = p.level AND f.ix = p.ix AND f.iy = p.iy AND f.iz = p.iz AND f.s = t.s JOIN {other} g ON g.level = q.level AND g.ix = q.ix AND g.iy = q.iy AND g.iz = q.iz AND g.s = t.s GROUP BY ALL"
        return f"SELECT {lv}.*, {axis}::BIGINT AS axis, p{a} AS p, greatest(coalesce(steep, 0)*p{a}*{_RES.format(t='')}/2, coalesce(jump, 0)*{_RES.format(t='')}/2) AS variation, coalesce(high/greatest(low, 1e-12), 0) AS ratio, coalesce(jump, 0) AS jump FROM {lv} LEFT JOIN ({steps}) USING ({_KEYS}) LEFT JOIN ({jumps}) USING ({_KEYS})"

    return f"{lv} AS (SELECT DISTINCT {_KEYS}, px, py, pz FROM {m}), {diag} AS ({' UNION ALL '.join(along(i, a) for i, a in enumerate('xyz'))})"


def _forward(most: int, least_variation: float = 1e-3, least_jump: float = 0.05, least_ratio: float = 0.5, p: bool = True, h: bool = True, isotropic: bool = False) -> str:
    rises = f"SELECT '{'p_elevate_isotropic' if isotropic else 'p_elevate'}' AS action, {_KEYS}, {'NULL::BIGINT' if isotropic else 'axis'} AS axis, {'max' if isotropic else ''}(CASE WHEN p > 0 THEN variation*ratio ELSE variation END) AS score FROM marked WHERE NOT cut AND {p} AND p < 3 AND variation > {least_variation!r} AND (p = 0 OR ratio >= {least_ratio!r}) {'GROUP BY ALL' if isotropic else ''}"
    return f"""marked AS (SELECT *, {h} AND level < 2 AND max(jump) OVER w > {least_jump!r} AS cut, max(jump) OVER w AS most FROM diag WINDOW w AS (PARTITION BY {_KEYS})),
cand AS (SELECT row_number() OVER (ORDER BY score DESC, {_KEYS}, axis) - 1 AS place, * FROM (SELECT 'h_split' AS action, {_KEYS}, min(axis) FILTER (jump = most) AS axis, any_value(most) AS score FROM marked WHERE cut GROUP BY {_KEYS} UNION ALL {rises}) QUALIFY place < {most})"""


def _reverse(most: int, lv: str = "lv", diag: str = "diag") -> str:
    """back(place, action, key, axis, score), from lv and diag of a model."""
    return f"""back AS (SELECT row_number() OVER (ORDER BY score, action, {_KEYS}, axis) - 1 AS place, * FROM (SELECT 'p_reduce' AS action, {_KEYS}, axis, variation AS score FROM {diag} WHERE p > 0
UNION ALL SELECT 'h_merge', level-1, ix//2, iy//2, iz//2, NULL, 0.0::DOUBLE FROM {lv} WHERE level > 0 GROUP BY ALL HAVING count(*) = 8) QUALIFY place < {most})"""


_BASE = f"WITH {o.LEAVES}, {o.COEFFS}, {_MODEL}, {_diagnosed('m0')}"


def _come(i: int, action: str) -> str:
    """What comes in place of g{i}, the region of a candidate, whose axis is in c{i}."""
    g = f"g{i}"
    if action == "h_split":
        side = lambda a, n, bit: f"CASE WHEN (oc//{bit})%2 = 0 THEN CASE WHEN k{a} <= {n} THEN {_CHOOSE.format(n=f'least({n}, 3)', k=f'least(k{a}, {n})')}/pow(2, {n}) ELSE 0 END ELSE CASE WHEN k{a} >= {n} THEN {_CHOOSE.format(n=f'greatest(p{a}-{n}, 0)', k=f'greatest(least(k{a}-{n}, p{a}-{n}), 0)')}/pow(2, p{a}-{n}) ELSE 0 END END"
        return f"SELECT level+1 AS level, 2*ix+oc//4 AS ix, 2*iy+(oc//2)%2 AS iy, 2*iz+oc%2 AS iz, px, py, pz, a AS kx, b AS ky, e AS kz, sum(c * ({side('x', 'a', 4)}) * ({side('y', 'b', 2)}) * ({side('z', 'e', 1)})) AS c FROM {g}, range(8) t(oc), range(4) u(a), range(4) v(b), range(4) w(e) WHERE a <= px AND b <= py AND e <= pz GROUP BY ALL"
    if action == "p_elevate":
        up = " UNION ALL ".join(f"SELECT {_KEYS}, {', '.join(f'p{b}+1 AS p{b}' if b == a else f'p{b}' for b in 'xyz')}, {', '.join(f'k{b}+t.s AS k{b}' if b == a else f'k{b}' for b in 'xyz')}, c * CASE WHEN t.s = 0 THEN 1-k{a}/(p{a}+1.0::DOUBLE) ELSE (k{a}+1)/(p{a}+1.0::DOUBLE) END AS c FROM {g}, range(2) t(s) WHERE (SELECT axis FROM c{i}) = {n}" for n, a in enumerate("xyz"))
        return f"SELECT {_KEYS}, px, py, pz, kx, ky, kz, sum(c) AS c FROM ({up}) GROUP BY ALL"
    shape = f"(SELECT any_value(level)-1 AS pl, any_value(ix)//2 AS nx, any_value(iy)//2 AS ny, any_value(iz)//2 AS nz, max(px) AS px, max(py) AS py, max(pz) AS pz FROM {g} HAVING count(*) > 0)"
    at = lambda a: f"-1+(s.n{a}+({a}s+0.5)/greatest(2*(s.p{a}+1), 4))*2.0/{_RES.format(t='s.p').replace('plevel', 'pl')}"
    local = {a: f"(({at(a)}+1)*{_RES.format(t='g.')}/2-g.i{a})" for a in "xyz"}
    terms = " * ".join(_basis(f"g.p{a}", f"g.k{a}", local[a]) for a in "xyz")
    spots = f"SELECT s.*, xs, ys, zs, sum(g.c*{terms}) AS v FROM {shape} s, range(8) t(xs), range(8) u(ys), range(8) w(zs), {g} g WHERE xs < greatest(2*(s.px+1), 4) AND ys < greatest(2*(s.py+1), 4) AND zs < greatest(2*(s.pz+1), 4) AND " + " AND ".join(f"floor(({at(a)}+1)*{_RES.format(t='g.')}/2) = g.i{a}" for a in "xyz") + " GROUP BY ALL"
    return f"SELECT pl AS level, nx AS ix, ny AS iy, nz AS iz, px, py, pz, a.i AS kx, b.i AS ky, e.i AS kz, greatest(sum(v*a.w*b.w*e.w), 1e-12) AS c FROM ({spots}) s JOIN pinv a ON a.p = px AND a.s = xs JOIN pinv b ON b.p = py AND b.s = ys JOIN pinv e ON e.p = pz AND e.s = zs GROUP BY ALL"


def _trial(i: int, action: str, source: str, place: int, tuned: bool) -> str:
    """One candidate tried on m{i}, f{i} (facts) and pa{i} (paths): v{i} is its audit row; gives m{i+1}, f{i+1}, pa{i+1}."""
    same = " AND ".join(f"x.{k} = g.{k}" for k in ("level", "ix", "iy", "iz"))
    merge = action == "h_merge"
    where = "x.level = c.level+1 AND x.ix//2 = c.ix AND x.iy//2 = c.iy AND x.iz//2 = c.iz" if merge else "x.level = c.level AND x.ix = c.ix AND x.iy = c.iy AND x.iz = c.iz"
    lo, hi, ok = o.slab(*(f"(-1+{c}*2.0/res)" for c in ("ix", "(ix+1)", "iy", "(iy+1)")))
    weight = " * ".join(_basis(f"n.p{a}", f"q.k{a}", f"((n.{a}+1)*n.res/2-n.i{a})") for a in "xyz")
    axis = f"(SELECT axis FROM c{i})"
    pick = lambda v: f"CASE {axis} WHEN 0 THEN {v}x WHEN 1 THEN {v}y ELSE {v}z END"
    line = ", ".join(f"CASE WHEN {axis} = {n} THEN -1 ELSE k{a} END" for n, a in enumerate("xyz"))
    if not tuned:
        step = "0"
    elif action == "p_elevate":
        step = f"{PLAIN_RATE!r}::DOUBLE*tangent*(sum(g*tangent) OVER w)/greatest(sum(tangent*tangent) OVER w, 1e-12)"
    else:
        step = f"{ADAM_RATE!r}::DOUBLE*g/(abs(g)+1e-8)"
    squares = lambda p: f"(w*{p}*{p}-2*{p}*wt+wtt)"
    stays = f"gain > 0 AND added > 0 AND gain/greatest(added, 1) > {PRICE!r}" if not merge else f"added < 0 AND greatest(-gain, 0)/greatest(-added, 1) < {MERGE_PRICE!r}"
    nodes = "-1" if merge else ("1" if action == "h_split" else "0")
    return f"""c{i} AS (SELECT * FROM {source} WHERE place = {place}), g{i} AS (SELECT x.* FROM m{i} x, c{i} c WHERE {where}),
new{i} AS ({_come(i, action)}),
lv{i}_ AS (SELECT DISTINCT {_KEYS}, px, py, pz, {_RES.format(t='')} AS res FROM new{i}),
own{i} AS (SELECT view_id, row, col, sum(integral) AS before FROM f{i} x SEMI JOIN g{i} g ON {same} GROUP BY ALL),
hit{i} AS (SELECT w.*, l.*, {lo} AS s0, {hi} AS s1 FROM ways w SEMI JOIN own{i} USING (view_id, row, col), lv{i}_ l WHERE w.z >= -1+l.iz*2.0/res AND w.z < -1+(l.iz+1)*2.0/res AND {ok}),
n{i} AS (SELECT h.*, (s1-s0)/2*gw AS gwh, bx+dx*((s0+s1)/2+(s1-s0)/2*gx) AS x, byy+dy*((s0+s1)/2+(s1-s0)/2*gx) AS y FROM hit{i} h JOIN gauss ON n = greatest(1, ceil((px+py+pz+1)/2.0)) WHERE s1 > s0 + 1e-8),
t{i} AS (SELECT view_id, row, col, q.level, q.ix, q.iy, q.iz, q.kx, q.ky, q.kz, sum(gwh*{weight}) AS tw FROM n{i} n JOIN new{i} q USING ({_KEYS}) GROUP BY ALL),
as{i} AS (SELECT view_id, row, col, sum(c*tw) AS now FROM t{i} JOIN new{i} USING ({_KEYS}, kx, ky, kz) GROUP BY ALL),
off{i} AS (SELECT p.view_id, p.row, p.col, w*(prediction-before+coalesce(now, 0))-wt AS off FROM pa{i} p JOIN own{i} USING (view_id, row, col) LEFT JOIN as{i} USING (view_id, row, col) WHERE NOT held_out),
grad{i} AS (SELECT q.*, 1-exp(-q.c) AS slope, coalesce(s, 0)*2/(SELECT sum(n) FROM pa0 WHERE NOT held_out)*(1-exp(-q.c)) AS g FROM new{i} q LEFT JOIN (SELECT {_KEYS}, kx, ky, kz, sum(off*tw) AS s FROM t{i} JOIN off{i} USING (view_id, row, col) GROUP BY ALL) USING ({_KEYS}, kx, ky, kz)),
tan{i} AS (SELECT *, pow(-1, {pick('k')})*{_CHOOSE.format(n=f'least({pick("p")}, 3)', k=pick('k'))}/greatest(slope, 1e-8) AS tangent FROM grad{i}),
moved{i} AS (SELECT *, c + ln(1-exp(-c)) - {step} AS l FROM tan{i} WINDOW w AS (PARTITION BY {_KEYS}, {line})),
done{i} AS (SELECT {_KEYS}, px, py, pz, kx, ky, kz, {'greatest(l, 0)+ln(1+exp(-abs(l)))' if tuned else 'c'} AS c FROM moved{i}),
fresh{i} AS (SELECT view_id, row, col, {_KEYS}, sum(c*tw) AS integral FROM t{i} JOIN done{i} USING ({_KEYS}, kx, ky, kz) GROUP BY ALL),
after{i} AS (SELECT view_id, row, col, sum(integral) AS after FROM fresh{i} GROUP BY ALL),
way{i} AS (SELECT p.*, before, coalesce(after, 0) AS after, prediction-before+coalesce(after, 0) AS later FROM pa{i} p JOIN own{i} USING (view_id, row, col) LEFT JOIN after{i} USING (view_id, row, col)),
e{i} AS (SELECT coalesce(sum({squares('prediction')}*pow(before/greatest(prediction, 1e-8), 2)), 0)/(SELECT sum(n) FROM pa0 WHERE held_out) AS a, coalesce(sum({squares('later')}*pow(after/greatest(later, 1e-8), 2)), 0)/(SELECT sum(n) FROM pa0 WHERE held_out) AS b FROM way{i} WHERE held_out),
sizes{i} AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT {_KEYS} FROM g{i})) AS there, 64*((SELECT count(*) FROM lv{i}_)-(SELECT count(*) FROM (SELECT DISTINCT {_KEYS} FROM g{i})))+12*((SELECT count(*) FROM new{i})-(SELECT count(*) FROM g{i}))+64*({nodes}) AS added),
v{i} AS (SELECT {i}::BIGINT AS place, action, {_KEYS}, axis, score AS diagnostic, CASE WHEN there > 0 THEN a END AS before, CASE WHEN there > 0 THEN b END AS after, CASE WHEN there > 0 THEN gain ELSE 0 END AS gain, CASE WHEN there > 0 THEN added ELSE 0 END AS added_bytes, there > 0 AND {stays} AS accepted FROM c{i}, (SELECT *, a-b AS gain FROM e{i}), sizes{i}),
m{i + 1} AS (SELECT * FROM m{i} x ANTI JOIN (SELECT * FROM g{i} WHERE (SELECT accepted FROM v{i})) g ON {same} UNION ALL SELECT * FROM done{i} WHERE (SELECT accepted FROM v{i})),
f{i + 1} AS (SELECT * FROM f{i} x ANTI JOIN (SELECT * FROM g{i} WHERE (SELECT accepted FROM v{i})) g ON {same} UNION ALL SELECT * FROM fresh{i} WHERE (SELECT accepted FROM v{i})),
pa{i + 1} AS (SELECT p.* REPLACE (CASE WHEN (SELECT accepted FROM v{i}) THEN coalesce(later, p.prediction) ELSE p.prediction END AS prediction) FROM pa{i} p LEFT JOIN (SELECT view_id, row, col, later FROM way{i}) USING (view_id, row, col))"""


_SIDES = f"""views AS (SELECT DISTINCT view_id FROM rays), sides AS (SELECT view_id, row_number() OVER (ORDER BY {_drawn('view_id', str(1 << 60), SEED)}, view_id) <= greatest(1, least((SELECT count(*) FROM views)-1, round_even((SELECT count(*) FROM views)*0.25, 0))) AS held_out FROM views)"""
_PATHS = f"{_weighted_sql('inverse', 'predicted')}, {_SIDES}, pa0 AS (SELECT view_id, row, col, count(*) AS n, sum(weight) AS w, sum(weight*target) AS wt, sum(weight*target*target) AS wtt, any_value(held_out) AS held_out, any_value(prediction) AS prediction FROM weighted JOIN sides USING (view_id) GROUP BY view_id, row, col), f0 AS (SELECT * FROM facts)"


def _round_sql(forward: int, reverse: int, action: str, **proposing) -> str:
    steps = [_trial(i, action, "cand", i, True) for i in range(forward)]
    steps += [_diagnosed(f"m{forward}", "lv_after", "diag_after"), _reverse(reverse, "lv_after", "diag_after")]
    steps += [_trial(forward + i, "h_merge", "back", i, False) for i in range(reverse)]
    rows = " UNION ALL ".join(f"SELECT place, action, {_KEYS}, axis, added_bytes, accepted, round(diagnostic, 5) + 0.0 AS diagnostic, round(before, 11) + 0.0 AS before, round(after, 11) + 0.0 AS after, round(gain, 11) + 0.0 AS gain FROM v{i}" for i in range(forward + reverse))
    return f"WITH {o.PREDICTED}, {_PATHS}, {_PINV}, {_MODEL}, {_diagnosed('m0')}, {_forward(forward, **proposing)}, {', '.join(steps)} {rows}"


def _tuned_sql(leaves: int) -> str:
    steps = [_trial(i, "p_elevate", "cand", i, True).split(f",\nfresh{i} AS")[0].replace(f" m{i} x", " m0 x").replace(f" f{i} x", " f0 x").replace(f" pa{i} p", " pa0 p") for i in range(leaves)]
    cand = f"cand AS (SELECT row_number() OVER (ORDER BY {_KEYS})-1 AS place, *, 0 AS axis FROM (SELECT DISTINCT {_KEYS} FROM m0 WHERE level = 0 AND px < 3) QUALIFY place < {leaves})"
    rows = " UNION ALL ".join(f"SELECT {_KEYS}, (kx*(py+1)+ky)*(pz+1)+kz AS coefficient, round(c, 9) AS mu FROM done{i}" for i in range(leaves))
    return f"WITH {o.PREDICTED}, {_PATHS}, {_MODEL}, {cand}, {', '.join(steps)} {rows}"


_WIDE = ", ".join(f"round(max({k}) FILTER (axis = {i}), 5) AS {k}_{a}" for k in ("variation", "ratio", "jump") for i, a in enumerate("xyz"))
_LISTED = f"SELECT action, {_KEYS}, axis, round(score, 5) AS score"
ORACLES = {
    "coefficient_diagnostics": f"{_BASE} SELECT {_KEYS}, {_WIDE} FROM diag GROUP BY {_KEYS}",
    "forward_proposals": f"{_BASE}, {_forward(300, 0.05, 0.02)} {_LISTED} FROM cand",
    "isotropic_proposals": f"{_BASE}, {_forward(300, 0.05, h=False, isotropic=True)} {_LISTED} FROM cand",
    "reverse_proposals": f"{_BASE}, {_reverse(200)} {_LISTED} FROM back",
    "masked_tuning": _tuned_sql(4),
    "adaptive_round_splits": _round_sql(3, 2, "h_split", **SPLITS),
    "adaptive_round_rises": _round_sql(4, 1, "p_elevate", **RISES),
}
