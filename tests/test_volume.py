"""Bricks against plain trilinear sums, draws that are even and independent, ranges of tied scores, faults by name, settings by stage."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmill.operators import bricks, ordered, sampling, topology
from fieldmill.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def trilinear(v, x, y, z):
    n = len(v)
    f = [(c + 1) * 0.5 * n - 0.5 for c in (x, y, z)]
    if any(c < 0 or c > n - 1 for c in f):
        return 0.0
    low = [math.floor(c) for c in f]
    out = 0.0
    for i in range(8):
        at = [min(a + (i >> (2 - k) & 1), n - 1) for k, a in enumerate(low)]
        out += v[tuple(at)] * np.prod([(c - a) if i >> (2 - k) & 1 else 1 - (c - a) for k, (c, a) in enumerate(zip(f, low))])
    return out


@pytest.fixture(scope="module")
def volume(spark):
    v = np.random.default_rng(3).random((10, 10, 10))
    rows = [(i, j, k, float(v[i, j, k])) for i in range(10) for j in range(10) for k in range(10)]
    return v, spark.createDataFrame(rows, "gx long, gy long, gz long, v double")


@pytest.mark.parametrize("edge", [3, 4, 10, 16])
def test_bricks_hold_all_neighbours(spark, volume, edge):
    v, table = volume
    held = bricks.bricks(table, ["gx", "gy", "gz"], "v", 10, edge)
    assert {r[0] for r in held.select(F.size("values")).collect()} == {(edge + 1) ** 3} and held.count() == (-(-10 // edge)) ** 3
    rng = np.random.default_rng(edge)
    spots = np.concatenate([rng.uniform(-1.1, 1.1, (60, 3)), [[-0.9, -0.9, -0.9], [0.9, 0.9, 0.9], [0.9, -0.9, 0.1], [1.0, 0, 0]]])
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(spots)], "id int, x double, y double, z double")
    got = {r["id"]: r["value"] for r in bricks.sample(points, held, 10, edge).collect()}
    assert np.allclose([got[i] for i in range(len(spots))], [trilinear(v, *p) for p in spots], atol=1e-12)


def test_projection_is_the_sum_of_samples(spark, volume):
    v, table = volume
    held = bricks.bricks(table, ["gx", "gy", "gz"], "v", 10, 4)
    rays = spark.createDataFrame([(w, r, c) for w in (0, 2, 3, 5) for r in (0, 3, 7) for c in (0, 4, 7)] + [(0, 0, 0)], "view_id long, row long, col long")
    got = {tuple(r)[:3]: r["prediction"] for r in bricks.project(rays, held, 10, 8, 12, 20, 4).collect()}
    assert len(got) == 36
    for (w, row, col), value in got.items():
        a = -w * math.pi / 12
        dx, dy, u, z = math.cos(a), math.sin(a), -1 + (col + 0.5) / 4, -1 + (row + 0.5) / 4
        bx, by = -dy * u, dx * u
        spans = [sorted(((s - b) / d) for s in (-1, 1)) for b, d in ((bx, dx), (by, dy)) if abs(d) >= 1e-8]
        t0, t1 = max(s[0] for s in spans), min(s[1] for s in spans)
        h = (t1 - t0) / 20
        want = sum(trilinear(v, bx + dx * (t0 + (s + 0.5) * h), by + dy * (t0 + (s + 0.5) * h), z) for s in range(20)) * h if t1 > t0 else 0.0
        assert math.isclose(value, want, abs_tol=1e-12)


def test_draws_are_even_and_independent(spark):
    n, below = 40_000, 96
    df = spark.range(n).select("id", *(sampling.drawn(F.col("id"), F.lit(below), s).alias(f"d{s}") for s in (0, 1)))
    rows = np.array(df.orderBy("id").select("d0", "d1").collect())
    expected = n / below
    for d in rows.T:
        assert ((np.bincount(d, minlength=below) - expected) ** 2 / expected).sum() < 160  # chi square of 95 degrees: 160 has p < 1e-4
        assert len(np.unique(np.diff(d))) > below  # no constant step
        assert abs(np.corrcoef(d[:-1], d[1:])[0, 1]) < 0.03
    assert abs(np.corrcoef(rows.T)[0, 1]) < 0.03
    high = spark.range(1000).select(sampling.drawn(F.col("id"), F.lit(1 << 50), 3).alias("d")).agg(F.max("d")).first()[0]
    assert high > 1 << 49  # more items than 32 bits can number are drawn from


def test_ranges_split_equal_scores(spark):
    """Rows of one score are cut by their key; no range holds many more than per_part."""
    df = spark.range(5000).select(F.lit(1.0).alias("s"), F.col("id").alias("k"), (F.col("id") % 3).alias("c")).repartition(3)
    run = ordered.running_totals(df, "s", ["k"], {"place": F.lit(1), "spent": F.col("c")}, per_part=500)
    rows = run.orderBy("k").collect()
    assert [r["place"] for r in rows] == list(range(1, 5001)) and [r["spent"] for r in rows] == np.cumsum([i % 3 for i in range(5000)]).tolist()
    mixed = spark.range(3000).select((F.col("id") % 7).cast("double").alias("s"), F.col("id").alias("k"))
    run = ordered.running_totals(mixed, "s", ["k"], {"place": F.lit(1)}, per_part=400)
    want = sorted(range(3000), key=lambda i: (-(i % 7), i))
    assert [r["k"] for r in run.orderBy("place").collect()] == want


def test_edge_pairs_prefer_steep_ones(spark):
    image = spark.range(3 * 256).selectExpr("id div 256 as view_id", "(id div 16) % 16 as row", "id % 16 as col", "if(id % 16 >= 8, 1D, 0D) as v")
    made = sampling.edge_pairs(image, "v", 200, 3, 16, 5).toPandas()
    assert len(made) == 200 and made.biased.sum() == 100
    assert (made[made.biased].derivative.abs() > 0).mean() > 0.6 > 0.2 > (made[~made.biased].derivative.abs() > 0).mean()  # the pool has no more
    assert ((made.row_b - made.row) + (made.col_b - made.col) == made.stride).all() and made.row_b.max() < 16 and made.col_b.max() < 16
    for bad in ({"count": 0}, {"strides": (16,)}, {"strides": ()}, {"uniform": 1.5}):
        with pytest.raises(ValueError):
            sampling.edge_pairs(image, "v", **({"count": 5} | bad), views=3, size=16, seed=1)


def test_faults_are_named(spark):
    leaves = fx.leaves(spark, SF)
    topology.require_tree(leaves, fx.LEVELS)
    lost = leaves.where("not (level = 0 and ix = 0)")
    with pytest.raises(ValueError, match="missing_root"):
        topology.require_tree(lost, fx.LEVELS)
    doubled = leaves.union(leaves.limit(1)).withColumn("coeffs", F.transform("coeffs", lambda v: F.when(v > 0.06, float("nan")).otherwise(v)))
    with pytest.raises(ValueError, match="coefficient_value.*repeated_key: 1"):
        topology.require_tree(doubled, fx.LEVELS)


def test_settings_of_stages(spark):
    at = F.col("id")
    columns = topology.staged_settings(at, {"a": 1, "b": "x"}, {5: {"a": 2}, 2: {"b": "y"}, 9: None}, {"b": None})
    rows = spark.range(8).select("id", *(c.alias(k) for k, c in columns.items()), topology.ramped(at, 1.0, 2, 6, 4).alias("w")).orderBy("id").collect()
    assert [r["a"] for r in rows] == [1] * 5 + [2] * 3 and [r["b"] for r in rows] == ["x"] * 2 + ["y"] * 6
    assert [r["w"] for r in rows] == [0, 0, 0.25, 0.5, 0.75, 1, 1, 0]
    assert spark.range(1).select(topology.ramped(at + 5, 0.0).alias("w")).first()["w"] == 0
