"""Gated elevations that leave no trace or a whole model, pooled volumes, and metrics of nothing."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmill.operators import adapt, gate, volumes
from fieldmill.plans import adapt_queries
from fieldmill.plans import fixtures as fx

SF = "/root/testdata/sf0.001"
L, N, V = fx.LEVELS, fx.SIZE, fx.VIEWS


def test_gate_keeps_or_rolls_back(spark):
    model = adapt_queries._model(spark, SF)
    chosen = model.leaves.where("level = 1 and ix = 1 and px = 0")
    before = [sorted(map(tuple, t.collect()), key=repr) for t in (model.leaves, model.facts, model.paths)]
    same, audit = gate.gated_elevation(model, chosen, (1, 1, 1), L, N, V, 0, 0)
    row = audit.first()
    assert same is model and not row["accepted"] and math.isclose(row["before"], row["after"], rel_tol=1e-9)  # raised leaves alone change nothing
    same, audit = gate.gated_elevation(model, chosen, (1, 1, 1), L, N, V, 0, 1, price=1.0)
    assert same is model and audit.first()["reason"] == "gains too little for its bytes" and audit.first()["gain"] > 0
    assert [sorted(map(tuple, t.collect()), key=repr) for t in (model.leaves, model.facts, model.paths)] == before
    after, audit = gate.gated_elevation(model, chosen, (1, 1, 1), L, N, V, 0, 2, 0.02)
    row = audit.first()
    assert row["accepted"] and math.isclose(gate.held_out_loss(after), row["after"], rel_tol=1e-9)
    fresh = adapt.ray_cell_contributions(after.paths.select(*adapt.RAY), after.leaves, L, N, V).groupBy(*adapt.RAY).agg(F.sum("integral").alias("anew"))
    assert after.paths.join(fresh, adapt.RAY).where("abs(prediction - anew) > 1e-9").count() == 0
    assert after.leaves.where("level = 1 and ix = 1 and px = 0").count() == 0 and after.leaves.count() == model.leaves.count()
    again, audit = gate.gated_elevation(after, after.leaves.where("level = 1 and ix = 1 and px = 1"), (1, 1, 1), L, N, V)
    assert again is after and audit.first()["reason"] == "no leaf changes degree"


def test_gate_never_looks_at_test_views():
    assert gate.acceptance_sides("train_holdout") and not gate.acceptance_sides("Train")
    for source in ("test", "projection_test", "other"):
        with pytest.raises(ValueError):
            gate.acceptance_sides(source)


@pytest.mark.parametrize("n,coarse", [(6, 3), (5, 3), (4, 4), (3, 5)])
def test_pooled_is_adaptive(spark, n, coarse):
    v = np.random.default_rng(n).random((n, n, n))
    table = spark.createDataFrame([(i, j, k, float(v[i, j, k])) for i in range(n) for j in range(n) for k in range(n)], "x long, y long, z long, v double")
    span = lambda i: slice(i * n // coarse, -(-(i + 1) * n // coarse))
    got = {tuple(r)[:3]: r["v"] for r in volumes.pooled(table, ["x", "y", "z"], "v", n, coarse).collect()}
    assert len(got) == coarse**3 and all(math.isclose(x, v[span(i), span(j), span(k)].mean()) for (i, j, k), x in got.items())


def test_metrics_without_material(spark):
    table = spark.range(27).selectExpr("id div 9 as x", "(id div 3) % 3 as y", "id % 3 as z", "0.1D as t", "0.2D as p")
    assert volumes.material_metrics(table, "t", "p", 1.0).count() == 0
    assert volumes.boundary_metrics(table, "t", "p", ["x", "y", "z"], 1.0).count() == 0
    assert volumes.material_metrics(table, "t", "p", 0.0).first()["mae"] == pytest.approx(0.1)
