"""The field engine: every query with SQL against DuckDB, and invariants of tree rewrites."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmill import catalogue
from fieldmill.operators import candidates, compress, encode, fit, lookup, ordered, rays, rewrite, sampling, tree
from fieldmill.sources import config, projections
from fieldmill.streaming import accumulate
from fieldmill.plans import fixtures as fx

SF = "/root/testdata/sf0.001"
QUICK = ["leaf_level_stats", "leaf_topn_min_mu", "leaf_topn_fallback", "int_histogram", "point_lookup", "point_eval", "slice_decode", "ray_cell_fact", "residual_metrics", "projection_weights_blend", "leaf_residual_score", "haar_gain", "trilinear_gain", "face_jump", "jump_budget_select", "hp_greedy_select", "split_leaves", "reduce_leaves", "candidate_bank", "tree_dp_lambda", "quantize_u8", "local_sigma", "convergence_window", "coefficient_gradient", "packed_nodes", "split_bits", "detector_subset", "uniform_ray_sample", "stratified_ray_sample", "held_out_split", "volume_sample", "halo_activation", "shared_faces", "face_continuity", "projection_gradient_loss", "residual_backprojection", "candidate_loss_change", "region_energy"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalogue.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()), key=repr) for df in (got, want)]
    assert rows[0] == rows[1]


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def volume(leaves):
    return leaves.agg(F.sum(F.pow(2.0 / lookup.resolution(F.col("level"), fx.LEVELS), F.lit(3.0)))).first()[0]


def plane(spark, leaves):
    grid = lookup.dense_grid(spark, 7, ("y", 3))
    return {(r["gx"], r["gz"]): r["value"] for r in lookup.evaluate(grid, leaves, fx.LEVELS, ["gx", "gz"]).collect()}


def test_split_and_elevate_keep_the_field(spark):
    leaves = fx.leaves(spark, SF)
    before = plane(spark, leaves)
    cut = rewrite.split(leaves, leaves.where("level < 2"))
    raised = rewrite.elevate(leaves, leaves.where("px < 2"), "y")
    for after in (cut, raised):
        assert volume(after) == pytest.approx(8.0)
        now = plane(spark, after)
        assert now.keys() == before.keys() and np.allclose([now[k] for k in before], [before[k] for k in before], atol=1e-12)
    assert (cut.count() - 64) % 7 == 0


def test_merge_undoes_split(spark):
    leaves = fx.leaves(spark, SF)
    chosen = leaves.where("level = 0 and px <= 1")
    cut = rewrite.split(leaves, chosen)
    back = rewrite.merge(cut, chosen.select(*lookup.KEY), fx.LEVELS)
    a, b = plane(spark, leaves), plane(spark, back)
    assert back.count() == leaves.count() and np.allclose([a[k] for k in a], [b[k] for k in a], atol=1e-9)


def test_balance_reaches_two_to_one(spark):
    done, complete = rewrite.balance(fx.leaves(spark, SF), fx.LEVELS)
    pairs = tree.face_neighbours(done, fx.LEVELS)
    assert complete and pairs.where("abs(own_level - level) > 1").count() == 0 and volume(done) == pytest.approx(8.0)


def test_uniform_field_gives_chord_lengths(spark):
    flat = spark.range(64).selectExpr("cast(0 as bigint) level", "id div 16 as ix", "(id div 4) % 4 as iy", "id % 4 as iz", "cast(0 as bigint) px", "cast(0 as bigint) py", "cast(0 as bigint) pz", "array(0.5D) as coeffs")
    ways = fx.rays(spark, SF)
    got = rays.predictions(ways, rays.ray_cell_contributions(ways, flat, fx.LEVELS, fx.SIZE, fx.VIEWS))
    chords = rays.with_geometry(got, fx.SIZE, fx.VIEWS)
    assert chords.where("abs(prediction - 0.5 * (t1 - t0)) > 1e-9").count() == 0


def test_budgets_over_several_ranges(spark):
    df = spark.range(1000).selectExpr("id as k", "cast((id * 7919) % 997 as double) as s", "id % 13 + 1 as c")
    got = {r["k"] for r in ordered.within_budget(df, "s", ["k"], F.col("c"), 900).collect()}
    small = ordered.running_totals(df, "s", ["k"], {"t": F.col("c")}, per_part=100).where("t <= 900")
    assert got == {r["k"] for r in small.collect()}


def test_greedy_passes_over_what_no_longer_fits(spark):
    rows = [(i, float(100 - i), i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, s double, big boolean")
    want, room, larges = set(), 500, 3
    for k, _, big in rows:
        cost = 99 if big else 14
        if cost <= room and (not big or larges):
            want.add(k)
            room -= cost
            larges -= big
    got = ordered.greedy_two_sizes(df, "s", ["k"], F.col("big"), 99, 14, 500, 3)
    assert {r["k"] for r in got.collect()} == want


def test_price_keeps_to_the_budget(spark):
    leaves = fx.leaves(spark, SF)
    full = leaves.agg(F.sum(tree.packed_bytes())).first()[0]
    done = compress.compress_to(leaves, fx.LEVELS, full / 3)
    assert volume(done) == pytest.approx(8.0)
    nodes = tree.ancestors(done).count()
    assert done.agg(F.sum(tree.packed_bytes())).first()[0] + compress.NODE_BYTES * nodes <= full / 3


def test_adam_lowers_the_loss(spark):
    ways = fx.rays(spark, SF).where("view_id = 2")
    logits = fx.logit_leaves(spark, SF)
    first = fit.coefficient_gradient(ways, logits, -3.0, fx.LEVELS, fx.SIZE, fx.VIEWS)
    assert first.where("gradient <> 0").count() > 0
    moved = fit.adam(ways, logits, -3.0, fx.LEVELS, fx.SIZE, fx.VIEWS, 1, rate=0.1).withColumnRenamed("logit", "now")
    met = first.join(moved, [*lookup.KEY, "coefficient"]).where("abs(gradient) > 1e-6")
    assert met.where("(now - logit) * gradient >= 0").count() == 0


def test_leaf_stream_reads_back(spark):
    leaves = fx.leaves(spark, SF)
    header, coords, mu, level, corners = encode.read_leaf_stream(encode.leaf_stream(leaves, fx.LEVELS, 30, 0.05))
    want = tree.with_mean(leaves).where("mu >= 0.05").orderBy(F.desc("mu"), *lookup.KEY).limit(30).collect()
    assert header["count"] == len(want) == len(coords) and [tuple(c) for c in coords] == [(r["ix"], r["iy"], r["iz"]) for r in want]
    assert np.allclose(mu, [r["mu"] for r in want], rtol=1e-6) and level.tolist() == [r["level"] for r in want]
    assert corners is None or corners.shape == (len(want), 8)


def test_draws_stay_in_their_pools(spark):
    cells = spark.range(50).selectExpr("id as k", "id < 20 as material", "id < 5 as boundary")
    some = sampling.sample_volume(cells, ["k"], 200, 3).collect()
    pools = {"boundary": range(5), "material": range(20), "background": range(20, 50)}
    assert all(r["k"] in pools[r["pool"]] for r in some) and [sum(r["pool"] == p for r in some) for p in pools] == [50, 100, 50]
    none = sampling.sample_volume(cells.where("k >= 20"), ["k"], 40, 3).collect()
    assert {r["pool"] for r in none} == {"background"} and len(none) == 40


def test_acceptance_weighs_bytes(spark):
    rows = spark.createDataFrame([(1.0, 0.5, 10), (1.0, 0.95, 10), (1.0, 1.2, -5)], "a double, b double, n int")
    assert [r[0] for r in rows.select(candidates.accepted(F.col("a"), F.col("b"), F.col("n"), 0.01)).collect()] == [True, False, False]


def test_config_includes_and_paths(tmp_path):
    import json

    (tmp_path / "base.json").write_text(json.dumps({"a": {"x": 1, "y": 2}, "b": 3}))
    (tmp_path / "child.json").write_text(json.dumps({"extends": "base.json", "a": {"y": 5}}))
    made = config.load(str(tmp_path / "child.json"))
    assert made["a"] == {"x": 1, "y": 5} and made["b"] == 3 and config.at(made, "a.y") == 5 and config.at(made, "a.q.r", 7) == 7
    (tmp_path / "base.json").write_text(json.dumps({"extends": "child.json"}))
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "child.json"))


def test_projection_folder(spark, tmp_path):
    import json

    rng = np.random.default_rng(1)
    for split in ("proj_train", "proj_test"):
        (tmp_path / split).mkdir()
    frames = rng.random((3, 4, 5)).astype(np.float32)
    for i, f in enumerate(frames):
        np.save(tmp_path / ("proj_train" if i else "proj_test") / f"{i:03d}.npy", f)
    named = [{"file_path": f"{'proj_train' if i else 'proj_test'}/{i:03d}.npy", "angle": 0.1 * i} for i in range(3)]
    meta = {"scanner": {"mode": "parallel", "nVoxel": [4, 4, 4], "nDetector": [4, 5]}, "proj_train": named[1:], "proj_test": named[:1]}
    (tmp_path / "meta_data.json").write_text(json.dumps(meta))
    got = projections.read_projections(spark, str(tmp_path)).toPandas()
    assert len(got) == 60 and got["target"].sum() == pytest.approx(float(frames.sum()), rel=1e-5)


def test_stream_of_rays_adds_up(spark, tmp_path):
    ways = fx.rays(spark, SF).where("view_id < 3")
    ways.repartition(2).write.parquet(str(tmp_path / "rays"))
    flat = fx.leaves(spark, SF).where("level = 0 and px = 0")
    facts = rays.ray_cell_contributions(ways, flat, fx.LEVELS, fx.SIZE, fx.VIEWS)
    facts.write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    stream = spark.readStream.schema(ways.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rays"))
    query = accumulate.start(stream, facts, str(tmp_path / "out"), str(tmp_path / "log"))
    query.processAllAvailable()
    query.stop()
    from fieldmill.operators import scores

    whole = scores.residual_scores(facts, scores.per_path(rays.predictions(ways, facts).withColumn("weight", F.lit(1.0))))
    a, b = ({tuple(r[c] for c in lookup.KEY): (r["energy"], r["exposure"]) for r in df.collect()} for df in (whole, accumulate.totals(spark, str(tmp_path / "out"))))
    assert a.keys() == b.keys() and np.allclose([a[k] for k in a], [b[k] for k in a])
