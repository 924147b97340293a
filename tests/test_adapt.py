"""Adaptive rounds: proposals and audits against SQL, branches that leave no trace, and tuning on the new direction alone."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmill import catalogue
from fieldmill.operators import adapt, rewrite
from fieldmill.plans import adapt_queries
from fieldmill.plans import fixtures as fx

SF = "/root/testdata/sf0.001"
L, N, V = fx.LEVELS, fx.SIZE, fx.VIEWS
KEY = adapt.KEY


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("embeddings", "events", "lineitem"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["coefficient_diagnostics", "forward_proposals", "reverse_proposals", "masked_tuning", "adaptive_round_splits"])
def test_query_matches_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = con.sql(catalogue.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = [sorted(map(tuple, r), key=repr) for r in (got.select(*names).collect(), want.project(", ".join(names)).fetchall())]
    assert len(rows[0]) == len(rows[1]) > 0
    for a, b in zip(*rows):
        assert all(math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-11) if isinstance(x, float) else x == y for x, y in zip(a, b)), (a, b)


@pytest.fixture(scope="module")
def model(spark):
    return adapt_queries._model(spark, SF)


def state(m):
    return tuple(sorted(map(tuple, df.collect()), key=repr) for df in (m.leaves, m.facts, m.paths))


def candidate(model, action, where, axis=None):
    r = model.leaves.where(where).orderBy(*KEY).first()
    return {"action": action, **{c: r[c] for c in KEY}, "axis": axis, "score": 0.0}


def test_rolled_back_candidates_leave_no_trace(spark, model):
    before = state(model)
    after, audit = adapt.adaptive_round(model, L, N, V, 2, 2, 1, 0.05, price=1e9, merge_price=0.0, p=False, least_jump=0.0)
    assert after is model and state(model) == before
    rows = audit.collect()
    assert len(rows) == 4 and not any(r["accepted"] for r in rows) and [r["place"] for r in rows] == [0, 1, 2, 3]


@pytest.mark.parametrize("action,where,axis", [("h_split", "level = 1 and px = 1", None), ("p_elevate_isotropic", "level = 0 and px = 0", None), ("p_reduce", "px = 3", 2)])
def test_committed_branch_is_a_whole_model(spark, model, action, where, axis):
    """Facts and predictions of a committed version are those of its leaves worked out anew; all other leaves stay bit for bit."""
    made = adapt.branch(model, candidate(model, action, where, axis), L, N, V)
    if action in adapt.FORWARD:
        same = adapt.energies(model, made)
        assert math.isclose(*same, rel_tol=1e-9)  # a split or rise alone changes no prediction
        adapt.tune(model, made, 2, 0.05 if action == "h_split" else 1e5, axis)
    after = adapt.committed(model, made)
    fresh = adapt.ray_cell_contributions(after.paths.select(*adapt.RAY), after.leaves, L, N, V)
    both = fresh.join(after.facts.withColumnRenamed("integral", "held"), [*adapt.RAY, *KEY], "full")
    assert both.where("held is null or integral is null or abs(held - integral) > 1e-10").count() == 0
    sums = after.facts.groupBy(*adapt.RAY).agg(F.sum("integral").alias("all"))
    assert after.paths.join(sums, adapt.RAY).where("abs(prediction - all) > 1e-9").count() == 0
    untouched = model.leaves.join(made.gone.select(*KEY), KEY, "left_anti")
    assert untouched.exceptAll(after.leaves.select(*untouched.columns)).count() == 0
    levels = after.leaves.agg(F.sum(F.pow(F.lit(0.125), F.col("level")))).first()[0]
    assert levels == 64  # still a partition of the box
    after.drop()


def test_tuning_lowers_the_training_loss(spark, model):
    def loss(m):
        p = F.col("prediction")
        return m.paths.where("not held_out").agg(F.sum(F.col("w") * p * p - 2 * p * F.col("wt") + F.col("wtt"))).first()[0]

    for action, rate, axis in (("h_split", 0.05, None),):
        made = adapt.branch(model, candidate(model, action, "level = 1 and px = 1", axis), L, N, V)
        adapt.tune(model, made, 3, rate, axis)
        after = adapt.committed(model, made)
        assert loss(after) < loss(model)
        after.drop()


def test_rises_move_the_new_direction_alone(spark, model):
    """What a plain step changes has no part that the degree before could make."""
    made = adapt.branch(model, candidate(model, "p_elevate", "px = 1", 0), L, N, V)
    before = made.mu.copy()
    adapt.tune(model, made, 1, 1e5, axis=0)
    shape = tuple(int(made.leaves[0][f"p{a}"]) + 1 for a in "xyz")
    logits = [v + np.log(-np.expm1(-v)) for v in (before, made.mu)]
    slope = -np.expm1(-before)  # of mu by logit
    moved = ((logits[1] - logits[0]) * slope).reshape(shape)
    assert np.abs(moved).max() > 0
    lift = np.array([[1 - i / 2 if j == i else i / 2 if j == i - 1 else 0.0 for j in range(2)] for i in range(3)])
    assert np.allclose(np.tensordot(lift, moved, (0, 0)), 0, atol=1e-9 * np.abs(moved).max())


def test_null_directions():
    for p in (1, 2, 3):
        lift = np.array([[1 - i / p if j == i else i / p if j == i - 1 else 0.0 for j in range(p)] for i in range(p + 1)])
        assert np.allclose(lift.T @ adapt.null_direction(p), 0)


def test_gone_leaves_and_verdicts(spark, model):
    lost = {"action": "h_split", "level": 2, "ix": 99, "iy": 0, "iz": 0, "axis": 0, "score": 1.0}
    assert adapt.branch(model, lost, L, N, V) is None
    assert adapt.branch(model, {**lost, "action": "h_merge"}, L, N, V) is None
    assert adapt.branch(model, candidate(model, "p_reduce", "px = 0", 0), L, N, V) is None
    assert adapt.verdict("h_split", 2.0, 1.0, 100, 0.01, 0)[1:] == (False, "gains too little for its bytes")
    assert adapt.verdict("h_split", 2.0, 1.0, 100, 0.001, 0)[1]
    assert not adapt.verdict("h_split", 1.0, 1.0, 100, 0, 0)[1]
    assert adapt.verdict("h_split", 2.0, 1.5, 100, 9, 0, "fixed_gain", 0.4)[1] and not adapt.verdict("h_split", 2.0, 1.5, 100, 0, 0, "fixed_gain", 0.6)[1]
    assert adapt.verdict("h_merge", 1.0, 1.1, -100, 0, 0.01)[1] and not adapt.verdict("p_reduce", 1.0, 2.1, -100, 0, 0.01)[1]
    with pytest.raises(ValueError):
        adapt.verdict("h_split", 1, 0, 1, 0, 0, "other")
    with pytest.raises(ValueError):
        adapt.changed(model.leaves, {"action": "other", "axis": 0}, L)
    assert [adapt.added_bytes(*v) for v in ((1, 1, 8, 8), (8, 8, 1, 1), (1, 8, 1, 12))] == [596, -596, 48]


def test_proposals_of_a_level_below_the_last(spark):
    leaves = fx.leaves(spark, SF)
    found = adapt.diagnostics(leaves, L)
    assert adapt.forward_proposals(found, L, 0).count() == 0
    some = adapt.forward_proposals(found, L, 10_000, least_jump=0.0, least_variation=0.0, least_ratio=0.0)
    assert some.where("action = 'h_split' and level = 2").count() == 0 and some.where("action = 'p_elevate'").count() > 0
    assert adapt.reverse_proposals(rewrite.split(leaves, leaves.where("level = 1 and px = 0").limit(1)), found, 10_000).where("action = 'h_merge' and level = 1").count() > 0
