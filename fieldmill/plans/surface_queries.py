"""Queries of batch refinement, isosurface roots and their uncertainty."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup, refine, scores, surface, tree
from . import fixtures as fx
from . import oracles as o
from .adapt_queries import _KEYS, _MODEL, _RES, _basis, _diagnosed
from .score_queries import CHUNK, _weighted_sql

L, N, V, KEY = fx.LEVELS, fx.SIZE, fx.VIEWS, lookup.KEY
TARGET, RATE, ADDED, CAP, THRESHOLD, RAYS = (2, 1, 2), 1e6, 900, 700, 0.0525, 400


def _coefficients(leaves):
    rows = leaves.select(*KEY, "px", "py", "pz", F.posexplode("coeffs").alias("k", "c"))
    return rows.select(*KEY, "px", "py", "pz", F.col("k").cast("long").alias("k"), F.round("c", 6).alias("c"))


def elevate_to_degree(spark, sf):
    """Leaves of the upper levels raised to degrees of at least 2, 1 and 2."""
    leaves = fx.leaves(spark, sf)
    return _coefficients(refine.elevate_to(leaves, leaves.where("level < 2"), TARGET))


def split_under_cap(spark, sf):
    """The densest leaves split while the tree keeps to 700 leaves or, if it has more, whatever it has."""
    leaves = fx.leaves(spark, sf)
    scored = tree.with_mean(leaves).withColumn("mu", F.round("mu", 9))
    return refine.split_under_cap(leaves, scored, "mu", L, CAP).select(*KEY)


def gradient_refinement(spark, sf):
    leaves = fx.leaves(spark, sf)
    rays = scores.with_weights(scores.chunked(fx.rays(spark, sf), CHUNK), ["view_id", "chunk_id"])
    found = refine.new_energies(rays, leaves, leaves.where("level < 2"), TARGET, L, N, V)
    rated = refine.gradient_refinement(found, RATE, 0.2, leaves.count(), ADDED)
    return rated.select(*KEY, "added", (F.round("score", 7) + 0.0).alias("score"), "chosen")


def surface_roots(spark, sf):
    return surface.roots(fx.leaves(spark, sf), L, THRESHOLD)


def _sigma(spark, sf):
    rays = surface.spaced_rays(spark, fx.images(spark, sf), "v", N, V, RAYS).withColumn("_all", F.lit(1))
    weighted = scores.with_weights(rays, ["_all"])
    return surface.coefficient_sigma(weighted, fx.logit_leaves(spark, sf), -3.0, L, N, V)


def coefficient_sigma(spark, sf):
    return _sigma(spark, sf).select(*KEY, "coefficient", F.round("sigma", 5).alias("sigma"))


def surface_sigma(spark, sf):
    made = surface.surface_sigma(surface.roots(fx.leaves(spark, sf), L, THRESHOLD), fx.logit_leaves(spark, sf), _sigma(spark, sf), -3.0, L)
    return made.select("x", "y", "z", F.round("sigma", 5).alias("sigma"))


QUERIES = {f.__name__: f for f in (elevate_to_degree, split_under_cap, gradient_refinement, surface_roots, coefficient_sigma, surface_sigma)}


# Each degree's target, where it falls short of it.
_HIGH = {a: f"greatest(p{a}, {t})" for a, t in zip("xyz", TARGET)}


def _values(name: str, matrix) -> str:
    rows = [(p, q, i, j, float(w)) for p in range(4) for q in range(p, 4) for i, row in enumerate(matrix(p, q)) for j, w in enumerate(row)]
    return f"{name}(low, high, i, j, w) AS (VALUES " + ", ".join(f"({p}, {q}, {i}, {j}, {w!r}::DOUBLE)" for p, q, i, j, w in rows) + ")"


_SHORT = f"level < 2 AND ({' OR '.join(f'p{a} < {t}' for a, t in zip('xyz', TARGET))})"
_LIFT = _values("lift", refine.lift_matrix)
_RAISED = f"raised AS (SELECT {_KEYS}, px AS ox, py AS oy, pz AS oz, a.high AS px, b.high AS py, e.high AS pz, a.i AS kx, b.i AS ky, e.i AS kz, sum(c*a.w*b.w*e.w) AS c FROM m0 JOIN lift a ON a.low = px AND a.high = {_HIGH['x']} AND a.j = kx JOIN lift b ON b.low = py AND b.high = {_HIGH['y']} AND b.j = ky JOIN lift e ON e.low = pz AND e.high = {_HIGH['z']} AND e.j = kz WHERE {_SHORT} GROUP BY ALL)"
_PLACE = "((kx*(py+1)+ky)*(pz+1)+kz)::BIGINT AS k"
_WEIGHT = " * ".join(_basis(f"q.p{a}", f"q.k{a}", f"((n.{a}+1)*n.res/2-n.i{a})") for a in "xyz")
_REFINE = f"""WITH {o.PREDICTED}, {_weighted_sql('inverse', 'predicted')}, {_MODEL}, {_LIFT}, {_values('proj', lambda p, q: refine.column_projector([p], [q]))}, {_RAISED},
shapes AS (SELECT {_KEYS}, any_value(px) AS px, any_value(py) AS py, any_value(pz) AS pz, any_value((px+1)*(py+1)*(pz+1)-(ox+1)*(oy+1)*(oz+1)) AS added FROM raised GROUP BY {_KEYS}),
spots AS (SELECT h.* EXCLUDE (d), px, py, pz, (s1-s0)/2*gw AS gwh, bx+dx*((s0+s1)/2+(s1-s0)/2*gx) AS x, byy+dy*((s0+s1)/2+(s1-s0)/2*gx) AS y FROM hits h JOIN shapes USING ({_KEYS}) JOIN gauss ON n = greatest(1, ceil((px+py+pz+1)/2.0)) WHERE s1 > s0 + 1e-8),
off AS (SELECT view_id, row, col, 2*sum(weight*(prediction-target))/(SELECT count(*) FROM weighted) AS off FROM weighted GROUP BY ALL),
g AS (SELECT q.level, q.ix, q.iy, q.iz, ox, oy, oz, q.px, q.py, q.pz, kx, ky, kz, sum(off*gwh*{_WEIGHT}) AS g FROM spots n JOIN raised q USING ({_KEYS}) JOIN off USING (view_id, row, col) GROUP BY ALL),
held AS (SELECT {_KEYS}, a.i AS kx, b.i AS ky, e.i AS kz, sum(g*a.w*b.w*e.w) AS pg FROM g JOIN proj a ON a.low = ox AND a.high = px AND a.j = kx JOIN proj b ON b.low = oy AND b.high = py AND b.j = ky JOIN proj e ON e.low = oz AND e.high = pz AND e.j = kz GROUP BY ALL),
energy AS (SELECT {_KEYS}, greatest(sum(g*g)-sum(g*pg), 0) AS energy FROM g JOIN held USING ({_KEYS}, kx, ky, kz) GROUP BY ALL),
scored AS (SELECT {_KEYS}, added, {RATE!r}*coalesce(energy, 0)/greatest(2*added, 1) AS score FROM shapes LEFT JOIN energy USING ({_KEYS})),
run AS (SELECT {_KEYS}, sum(added) OVER w AS spent, row_number() OVER w AS place FROM scored WHERE score > 0 WINDOW w AS (ORDER BY score DESC, {_KEYS} ROWS UNBOUNDED PRECEDING))
SELECT {_KEYS}, added, round(score, 7) + 0.0 AS score, coalesce(spent <= {ADDED} AND place <= greatest(1, floor((SELECT count(*) FROM leaves)*0.2)), false) AS chosen FROM scored LEFT JOIN run USING ({_KEYS})"""

_UV = {"x": "yz", "y": "xz", "z": "xy"}


def _lines() -> str:
    """lines(key, axis, u, v, p, b): the block's polynomial along each line; b by rising index."""
    each = []
    for n, a in enumerate("xyz"):
        u, v = _UV[a]
        each.append(f"SELECT {_KEYS}, {n} AS axis, (s+0.5)/greatest(p{u}+1, 2) AS u, (t+0.5)/greatest(p{v}+1, 2) AS v, p{a} AS p, k{a} AS k, c*{_basis(f'p{u}', f'k{u}', f'((s+0.5)/greatest(p{u}+1, 2))')}*{_basis(f'p{v}', f'k{v}', f'((t+0.5)/greatest(p{v}+1, 2))')} AS w FROM curved, range(4) a(s), range(4) b(t) WHERE axis = {n} AND s < greatest(p{u}+1, 2) AND t < greatest(p{v}+1, 2)")
    return f"""steepest AS (SELECT {_KEYS}, axis FROM diag QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY variation DESC, axis) = 1),
curved AS (SELECT m0.*, axis FROM m0 JOIN steepest USING ({_KEYS}) WHERE px+py+pz > 0),
lines AS (SELECT {_KEYS}, axis, u, v, p, list(b ORDER BY k) AS b FROM (SELECT {_KEYS}, axis, u, v, p, k, sum(w) AS b FROM ({' UNION ALL '.join(each)}) GROUP BY ALL) GROUP BY ALL)"""


def _on_line(t: str) -> dict[str, str]:
    at = {"x": (t, "u", "u"), "y": ("u", t, "v"), "z": ("v", "v", t)}
    return {a: f"(-1+(i{a} + CASE axis WHEN 0 THEN {at[a][0]} WHEN 1 THEN {at[a][1]} ELSE {at[a][2]} END)*2.0/{_RES.format(t='')})" for a in "xyz"}


def _along(t: str) -> str:
    return f"list_sum(list_transform(range(len(b)), lambda i: b[i+1]*([[1],[1,1],[1,2,1],[1,3,3,1]][p+1][i+1])*pow({t}, i)*pow(1-{t}, p-i)))"


def _inside(p: str, q: str) -> str:
    return " AND ".join(f"least(floor(({p}.{a}+1)*{_RES.format(t=q + '.')}/2), {_RES.format(t=q + '.')}-1) = {q}.i{a}" for a in "xyz")


_FIELD = " * ".join(_basis(f"q.p{a}", f"q.k{a}", f"((n.{a}+1)*{_RES.format(t='q.')}/2-q.i{a})") for a in "xyz")

_FACE_AT = {a: f"-1+(i{a} + CASE WHEN face = {n} THEN 1.0 ELSE 0.5 END)*2.0/{_RES.format(t='')}" for n, a in enumerate("xyz")}
_ROOTS = f"""{o.LEAVES}, {o.COEFFS}, {_MODEL}, {_diagnosed('m0')}, {_lines()},
tails AS (SELECT {_KEYS}, axis, u, v, {', '.join(f'{e} AS {a}' for a, e in _on_line('1.0').items())} FROM lines),
tail_values AS (SELECT n.level, n.ix, n.iy, n.iz, n.axis, n.u, n.v, sum(q.c*{_FIELD}) AS tail FROM tails n JOIN m0 q ON {_inside('n', 'q')} GROUP BY ALL),
samples AS (SELECT l.*, s, s/8.0::DOUBLE AS t, CASE WHEN s < 8 THEN {_along('(s/8.0::DOUBLE)')} ELSE tail END - {THRESHOLD!r} AS f FROM lines l JOIN tail_values USING ({_KEYS}, axis, u, v), range(9) r(s)),
pairs AS (SELECT *, lead(f) OVER (PARTITION BY {_KEYS}, axis, u, v ORDER BY s) AS g FROM samples),
halves AS (SELECT {_KEYS}, axis, u, v, p, b, t AS lo, t+0.125 AS hi, f, 0 AS step FROM pairs WHERE f*g < 0 AND abs(f) > 1e-7 AND abs(g) > 1e-7
  UNION ALL SELECT {_KEYS}, axis, u, v, p, b, CASE WHEN f*m <= 0 THEN lo ELSE (lo+hi)/2 END, CASE WHEN f*m <= 0 THEN (lo+hi)/2 ELSE hi END, CASE WHEN f*m <= 0 THEN f ELSE m END, step+1 FROM (SELECT *, {_along('((lo+hi)/2)')} - {THRESHOLD!r} AS m FROM halves WHERE step < 12)),
found AS (SELECT {_KEYS}, axis, u, v, (lo+hi)/2 AS t FROM halves WHERE step = 12 UNION ALL SELECT {_KEYS}, axis, u, v, t FROM samples WHERE abs(f) <= 1e-7),
faces AS (SELECT {_KEYS}, face, side, {', '.join(f'{e} AS m{a}' for a, e in _FACE_AT.items())}, {', '.join(f'{e} + CASE WHEN face = {n} THEN side*1e-5::DOUBLE ELSE 0 END AS {a}' for n, (a, e) in enumerate(_FACE_AT.items()))} FROM lv, range(3) t(face), (VALUES (-1), (1)) s(side)),
face_values AS (SELECT n.level, n.ix, n.iy, n.iz, n.face, n.side, mx, my, mz, coalesce(sum(q.c*{_FIELD}), 0) AS v FROM faces n LEFT JOIN m0 q ON n.x <= 1 AND n.y <= 1 AND n.z <= 1 AND {_inside('n', 'q')} GROUP BY ALL),
jumps_ AS (SELECT mx AS x, my AS y, mz AS z FROM face_values GROUP BY {_KEYS}, face, mx, my, mz HAVING (max(v) FILTER (side = -1)-{THRESHOLD!r})*(max(v) FILTER (side = 1)-{THRESHOLD!r}) < 0),
roots_ AS (SELECT DISTINCT {', '.join(f'round_even({a}*1e6, 0)/1e6 + 0.0 AS {a}' for a in 'xyz')} FROM (SELECT {', '.join(f'{e} AS {a}' for a, e in _on_line('t').items())} FROM found UNION ALL SELECT x, y, z FROM jumps_))"""
_SIGMA = f"""{o.RAYS.replace('rays AS', 'rays0 AS')}, {o.IMAGES.replace('rays', 'rays0')},
rays AS (SELECT view_id, row, col, v AS target FROM images JOIN (SELECT round_even(i*({V * N * N - 1}.0::DOUBLE/{RAYS - 1}), 0)::BIGINT AS n FROM range({RAYS}) t(i)) ON view_id = n//{N * N} AND row = (n//{N})%{N} AND col = n%{N}),
weights AS (SELECT view_id, row, col, w/greatest(avg(w) OVER (), 1e-4) AS w FROM (SELECT *, 1/greatest(abs(target), 1e-4) AS w FROM rays)),
{o.GEOMETRY}, {o.GAUSS}, {o.FACTS}, tw AS (SELECT view_id, row, col, level, ix, iy, iz, k, sum(w) AS tw FROM parts GROUP BY ALL),
fisher AS (SELECT level, ix, iy, iz, k, sum(w*tw*tw) AS h FROM tw JOIN weights USING (view_id, row, col) GROUP BY ALL),
sigmas AS (SELECT level, ix, iy, iz, kx, ky, kz, k, d, c, 1/sqrt(coalesce(h, 0)*(1-exp(-c))*(1-exp(-c)) + 1e-6) AS sigma FROM coeffs LEFT JOIN fisher USING (level, ix, iy, iz, k))"""
_PART = " * ".join(_basis("q.d", f"q.k{a}", f"((n.{a}+1)*{_RES.format(t='q.')}/2-q.i{a})") for a in "xyz")

ORACLES = {
    "elevate_to_degree": f"WITH {o.LEAVES}, {o.COEFFS}, {_MODEL}, {_LIFT}, {_RAISED} SELECT {_KEYS}, px, py, pz, {_PLACE}, round(c, 6) AS c FROM raised UNION ALL SELECT {_KEYS}, px, py, pz, {_PLACE}, round(c, 6) FROM m0 WHERE NOT ({_SHORT})",
    "split_under_cap": f"WITH {o.LEAVES}, best AS (SELECT {_KEYS} FROM leaves WHERE level < 2 QUALIFY row_number() OVER (ORDER BY round(list_avg(mu), 9) DESC, {_KEYS}) <= greatest(0, ({CAP}-(SELECT count(*) FROM leaves))//7)) SELECT {_KEYS} FROM leaves ANTI JOIN best USING ({_KEYS}) UNION ALL SELECT level+1, 2*ix+a, 2*iy+b, 2*iz+c FROM best, range(2) s(a), range(2) t(b), range(2) u(c)",
    "gradient_refinement": _REFINE,
    "surface_roots": f"WITH RECURSIVE {_ROOTS} SELECT x, y, z FROM roots_",
    "coefficient_sigma": f"WITH {o.LEAVES}, {o.COEFFS}, {_SIGMA} SELECT level, ix, iy, iz, k AS coefficient, round(sigma, 5) AS sigma FROM sigmas",
    "surface_sigma": f"WITH RECURSIVE {_ROOTS}, {_SIGMA} SELECT n.x, n.y, n.z, round(sqrt(sum(pow({_PART}*(1-exp(-q.c))*q.sigma, 2))), 5) AS sigma FROM roots_ n JOIN sigmas q ON {_inside('n', 'q')} GROUP BY ALL",
}
