"""DuckDB SQL that derives the same results on its own: slab tests instead of grid crossings, nested lists
instead of exploded rows."""

from __future__ import annotations

import numpy as np


def _at(i, j, k) -> str:
    return f"e[({i})*16+({j})*4+({k})+1]::DOUBLE"


_CORNERS = ", ".join(_at(a, b, c) for a in (0, 3) for b in (0, 3) for c in (0, 3))
_EIGHT = ", ".join(_at(f"2*ox+{a}", f"2*oy+{b}", f"2*oz+{c}") for a in (0, 1) for b in (0, 1) for c in (0, 1))

MU = "greatest(({x})-3,0)+ln(1+exp(-abs(({x})-3)))"

LEAVES = f"""
roots AS (SELECT vec_id, label::BIGINT AS label, embedding AS e, vec_id//16 AS ix, (vec_id//4)%4 AS iy, vec_id%4 AS iz FROM embeddings WHERE vec_id < 64),
kids AS (SELECT *, oc//4 AS ox, (oc//2)%2 AS oy, oc%2 AS oz, (vec_id*8+oc+label)%5 = 0 AS cut FROM roots, range(8) t(oc) WHERE label >= 5),
grand AS (SELECT *, g//4 AS gx, (g//2)%2 AS gy, g%2 AS gz FROM kids, range(8) t(g) WHERE cut),
logit_leaves AS (
  SELECT 0::BIGINT AS level, ix, iy, iz, CASE WHEN label <= 1 THEN 0 WHEN label <= 3 THEN 1 ELSE 3 END::BIGINT AS d,
    CASE WHEN label <= 1 THEN [e[1]::DOUBLE] WHEN label <= 3 THEN [{_CORNERS}] ELSE list_transform(e, lambda v: v::DOUBLE) END AS logits FROM roots WHERE label < 5
  UNION ALL SELECT 1, 2*ix+ox, 2*iy+oy, 2*iz+oz, (vec_id+oc+1)%2, CASE WHEN (vec_id+oc+1)%2 = 0 THEN [{_at('2*ox', '2*oy', '2*oz')}] ELSE [{_EIGHT}] END FROM kids WHERE NOT cut
  UNION ALL SELECT 2, 4*ix+2*ox+gx, 4*iy+2*oy+gy, 4*iz+2*oz+gz, 0, [{_at('2*ox+gx', '2*oy+gy', '2*oz+gz')}] FROM grand),
leaves AS (SELECT level, ix, iy, iz, d, list_transform(logits, lambda v: {MU.format(x='v')}) AS mu, (4*(2**level))::DOUBLE AS res FROM logit_leaves)"""

COEFFS = """
ks AS (SELECT level, ix, iy, iz, d, res, mu, unnest(range(len(mu))) AS k FROM leaves),
coeffs AS (SELECT level, ix, iy, iz, d, res, mu[k+1] AS c, k, k//((d+1)*(d+1)) AS kx, (k//(d+1))%(d+1) AS ky, k%(d+1) AS kz FROM ks)"""

RAYS = """
rays AS (SELECT event_id AS ray_id, user_id%12 AS view_id, event_id%16 AS row, (event_id//16)%16 AS col, value/500.0::DOUBLE AS target,
  CASE WHEN (user_id%12)%4 = 3 THEN 'test' ELSE 'train' END AS split FROM events)"""

GEOMETRY = """
ways0 AS (SELECT DISTINCT view_id, row, col, cos(-(view_id*pi()/12)) AS dx, sin(-(view_id*pi()/12)) AS dy, -1+(col+0.5)*(2.0::DOUBLE/16) AS u, -1+(row+0.5)*(2.0::DOUBLE/16) AS z FROM rays),
ways AS (SELECT view_id, row, col, dx, dy, z, -dy*u AS bx, dx*u AS byy FROM ways0)"""

_LO, _HI = "(-1+{c}*2.0/res)", "(-1+({c}+1)*2.0/res)"


def slab(low_x: str, high_x: str, low_y: str, high_y: str) -> tuple[str, str, str]:
    """(enter, leave, possible) of a way through an upright box in x and y."""
    def one(base: str, step: str, low: str, high: str) -> tuple[str, str, str]:
        a, b = f"(({low}-{base})/{step})", f"(({high}-{base})/{step})"
        flat = f"(abs({step}) < 1e-8)"
        return f"CASE WHEN {flat} THEN -1e20 ELSE least({a},{b}) END", f"CASE WHEN {flat} THEN 1e20 ELSE greatest({a},{b}) END", f"(NOT {flat} OR ({base} >= {low} AND {base} <= {high}))"

    x, y = one("bx", "dx", low_x, high_x), one("byy", "dy", low_y, high_y)
    return f"greatest({x[0]}, {y[0]})", f"least({x[1]}, {y[1]})", f"({x[2]} AND {y[2]})"


_ENTER, _LEAVE, _OK = slab(_LO.format(c="ix"), _HI.format(c="ix"), _LO.format(c="iy"), _HI.format(c="iy"))

GAUSS = "gauss(n, gx, gw) AS (VALUES " + ", ".join(f"({n}::BIGINT, {float(x)!r}::DOUBLE, {float(w)!r}::DOUBLE)" for n in range(1, 6) for x, w in zip(*np.polynomial.legendre.leggauss(n))) + ")"

BINOMIAL = "CASE WHEN d=0 OR {k}=0 OR {k}=d THEN 1.0 ELSE d::DOUBLE END"  # degrees up to 3


def basis(k: str, x: str) -> str:
    t = f"least(greatest({x},0),1)"
    return f"({BINOMIAL.format(k=k)} * pow({t}, {k}) * pow(1-{t}, d-{k}))"


FACTS = f"""
hits AS (SELECT w.*, l.level, l.ix, l.iy, l.iz, l.d, l.res, {_ENTER} AS s0, {_LEAVE} AS s1 FROM ways w, leaves l
  WHERE w.z >= -1+l.iz*2.0/l.res AND w.z < -1+(l.iz+1)*2.0/l.res AND {_OK}),
nodes AS (SELECT h.*, (s1-s0)/2*gw AS gwh, bx+dx*((s0+s1)/2+(s1-s0)/2*gx) AS x, byy+dy*((s0+s1)/2+(s1-s0)/2*gx) AS y FROM hits h JOIN gauss ON n = greatest(1, ceil((3*d+1)/2.0)) WHERE s1 > s0 + 1e-8),
parts AS (SELECT n.view_id, n.row, n.col, n.level, n.ix, n.iy, n.iz, c.k, c.c, gwh * CASE WHEN n.d = 0 THEN 1.0 ELSE
  {basis('kx', '(x+1)*n.res/2-n.ix').replace('d=0', 'n.d=0').replace('=d ', '=n.d ').replace('d::', 'n.d::').replace(', d-', ', n.d-')} * {basis('ky', '(y+1)*n.res/2-n.iy').replace('d=0', 'n.d=0').replace('=d ', '=n.d ').replace('d::', 'n.d::').replace(', d-', ', n.d-')} * {basis('kz', '(z+1)*n.res/2-n.iz').replace('d=0', 'n.d=0').replace('=d ', '=n.d ').replace('d::', 'n.d::').replace(', d-', ', n.d-')} END AS w
  FROM nodes n JOIN coeffs c USING (level, ix, iy, iz)),
facts AS (SELECT view_id, row, col, level, ix, iy, iz, sum(c*w) AS integral FROM parts GROUP BY ALL)"""

ALL_FACTS = ",".join([LEAVES, COEFFS, RAYS, GEOMETRY, GAUSS, FACTS])

PREDICTED = ALL_FACTS + """,
sums AS (SELECT view_id, row, col, sum(integral) AS prediction FROM facts GROUP BY ALL),
predicted AS (SELECT r.*, coalesce(prediction, 0) AS prediction FROM rays r LEFT JOIN sums USING (view_id, row, col))"""

POINTS = """
points AS (SELECT -1+2.0::DOUBLE*((l_partkey%64)+0.5)/64 AS x, -1+2.0::DOUBLE*((l_orderkey%64)+0.5)/64 AS y, -1+2.0::DOUBLE*((l_suppkey%64)+0.5)/64 AS z, l_quantity/50.0 AS target FROM lineitem)"""


def value_at(source: str) -> str:
    """(all columns of source, leaf key, value) of the field at points x, y, z, by comparing with every leaf's box."""
    inside = " AND ".join(f"p.{a} >= -1+l.i{a}*2.0/l.res AND p.{a} < -1+(l.i{a}+1)*2.0/l.res" for a in "xyz")
    terms = " * ".join(basis(f"k{a}", f"(p.{a}+1)*c.res/2-c.i{a}").replace("d=0", "c.d=0").replace("=d ", "=c.d ").replace("d::", "c.d::").replace(", d-", ", c.d-") for a in "xyz")
    return f"""
at_leaf AS (SELECT p.*, l.level, l.ix, l.iy, l.iz FROM {source} p JOIN leaves l ON {inside}),
values_at AS (SELECT p.* , v.value FROM at_leaf p JOIN LATERAL (SELECT sum(c.c * {terms}) AS value FROM coeffs c WHERE c.level = p.level AND c.ix = p.ix AND c.iy = p.iy AND c.iz = p.iz) v ON true)"""


DENSE = """
dense AS (SELECT a AS gx, b AS gy, c AS gz, -1+(a+0.5)*(2.0::DOUBLE/16) AS x, -1+(b+0.5)*(2.0::DOUBLE/16) AS y, -1+(c+0.5)*(2.0::DOUBLE/16) AS z FROM range(16) t(a), range(16) u(b), range(16) v(c))"""

IMAGES = """
pixels AS (SELECT v AS view_id, r AS row, c AS col FROM range(12) a(v), range(16) b(r), range(16) e(c)),
images AS (SELECT view_id, row, col, coalesce(avg(target), 0) AS v FROM pixels LEFT JOIN rays USING (view_id, row, col) GROUP BY ALL)"""

GRIDS = f"""
grid0 AS (SELECT vec_id AS node, embedding AS e, unnest(range(64)) AS spot FROM embeddings),
grids AS (SELECT node, spot, {MU.format(x='e[spot+1]::DOUBLE')} AS v FROM grid0)"""
