"""Archives and decoders: round trips of all layouts, and what is broken is named; roots, uncertainty and batch refinement."""

import glob
import json
import os
import shutil

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldmill import catalogue
from fieldmill.operators import decode, encode, lookup, refine, rewrite, surface
from fieldmill.plans import fixtures as fx
from fieldmill.sources import archives

SF = "/root/testdata/sf0.001"
L, KEY = fx.LEVELS, lookup.KEY


@pytest.fixture(scope="module")
def leaves(spark, tmp_path_factory):
    """A small tree of degrees 0 to 3: the first roots of the fixture tree, on a grid of one root cell for each."""
    path = f"file://{tmp_path_factory.mktemp('leaves')}/t"
    fx.leaves(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nodes(spark, leaves):
    return encode.packed_nodes(leaves, L[0]).toPandas()


@pytest.mark.parametrize("name", ["packed_decode", "split_bits_decode", "archive_packed_float16", "gradient_refinement", "surface_sigma"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), con.sql(catalogue.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()), key=repr) for df in (got, want)]
    assert rows[0] == rows[1]


def frame(spark, pdf):
    whole = pdf[["node_id", "child_base", "leaf_id"]].astype(float).fillna(-1).astype(int)
    return spark.createDataFrame(whole, "node_id long, child_base long, leaf_id long")


@pytest.mark.parametrize("message,change", [
    ("gaps", lambda n: n[n.node_id != 70]),
    ("both inner and a leaf", lambda n: n.assign(child_base=n.child_base.fillna(64))),
    ("leaf number is out of range", lambda n: n.assign(leaf_id=n.leaf_id + 1)),
    ("two nodes", lambda n: n.assign(leaf_id=n.leaf_id.where(n.leaf_id != 5, 4))),
    ("node number is out of range", lambda n: n.assign(child_base=n.child_base.where(n.child_base.isna() | (n.child_base != n.child_base.max()), 10_000_000))),
    ("no children", lambda n: n.assign(child_base=n.child_base.where(n.child_base != 64))),
    ("not every leaf is reached", lambda n: n.assign(child_base=n.child_base.where(n.child_base.isna() | (n.child_base != n.child_base.max()), n.child_base.max() - 8))),
])
def test_broken_nodes_are_named(spark, leaves, nodes, message, change):
    with pytest.raises(ValueError, match=message):
        decode.decode_packed(frame(spark, change(nodes.copy())), L, int(nodes.leaf_id.max()) + 1)


def test_nodes_below_the_last_level(spark, nodes):
    with pytest.raises(ValueError, match="below its last level"):
        decode.decode_packed(frame(spark, nodes), L[:2], int(nodes.leaf_id.max()) + 1)


def test_broken_bits_are_named(spark, leaves):
    bits = encode.split_bits(leaves, L[0]).toPandas()
    as_bits = lambda b: spark.createDataFrame(b, "level long, place long, bit int")
    for message, broken, count in (("bits for", bits.iloc[:-1][lambda b: ~((b.level == 1) & (b.place == 3))], None), ("below its last level", bits.assign(bit=bits.bit.where(bits.level < 2, 1)), None), ("leaves instead of 7", bits, 7)):
        with pytest.raises(ValueError, match=message):
            decode.decode_split_bits(as_bits(broken), L, count)
    whole = decode.decode_split_bits(as_bits(bits[bits.level < 2]), L)  # the last level needs no bits
    assert whole.select(*KEY).exceptAll(leaves.select(*KEY)).count() == 0 and whole.count() == leaves.count()


@pytest.mark.parametrize("topology,quantization,tolerance", [("packed_hierarchy", "uint8", 3e-4), ("explicit", "float16", 5e-5), ("split_masks", "uint16", 2e-6)])
def test_round_trip_in_small_chunks(spark, leaves, tmp_path, topology, quantization, tolerance):
    whole = leaves if topology != "split_masks" else leaves.withColumns({"px": F.lit(0).cast("long"), "py": F.lit(0).cast("long"), "pz": F.lit(0).cast("long"), "coeffs": F.slice("coeffs", 1, 1)})
    path = f"file://{tmp_path}/a"
    told = archives.write_archive(whole, path, L, quantization, topology, per_chunk=50)
    assert told["leaf_count"] == leaves.count() and told["file_bytes"] > 0 and told["raw_payload_bytes"] < told["model_bytes"]
    assert spark.read.parquet(f"{path}/chunks").where("kind = 'leaves'").count() > 5
    back = archives.read_archive(spark, path, L, (3, 3, 3))
    met = back.join(whole.withColumnRenamed("coeffs", "held"), [*KEY, "px", "py", "pz"])
    assert met.count() == leaves.count()
    worst = met.select(F.max(F.array_max(F.transform(F.arrays_zip("coeffs", "held"), lambda x: F.abs(x["coeffs"] - x["held"]))))).first()[0]
    assert worst < tolerance
    for bad in ({"levels": (4, 8)}, {"max_degree": (1, 1, 1)}):
        with pytest.raises(ValueError):
            archives.read_archive(spark, path, **bad)


def test_broken_archives_are_named(spark, leaves, tmp_path):
    path = str(tmp_path / "a")
    archives.write_archive(leaves, f"file://{path}", L, "uint16", "explicit", per_chunk=100)
    chunks, header = pd.read_parquet(f"{path}/chunks"), json.loads(pd.read_parquet(f"{path}/header").header[0])

    def reading(frame=chunks, **head):
        where = tmp_path / "b"
        shutil.rmtree(where, ignore_errors=True)
        spark.createDataFrame(frame, archives.CHUNK_TYPE).write.parquet(f"file://{where}/chunks")
        spark.createDataFrame([(json.dumps(header | head),)], "header string").write.parquet(f"file://{where}/header")
        return archives.read_archive(spark, f"file://{where}").count()

    assert reading() == leaves.count()
    cut = lambda column, f: chunks.assign(**{column: [f(v) if i == 0 else v for i, v in enumerate(chunks[column])]})
    shifted = lambda raw: (np.frombuffer(raw, "<u4") + 1).astype("<u4").tobytes()
    for message, broken in (("offsets must begin at 0", cut("c", shifted)), ("offsets end elsewhere", cut("d", lambda v: v[:-2])), ("another shape", cut("b", lambda v: v[:-1])), ("leaves instead of", chunks.iloc[1:])):
        with pytest.raises(Exception, match=message):
            reading(broken)
    for message, head in (("unknown layout", {"schema": "other"}), ("highest one", {"max_degree": [1, 1, 1]}), ("coefficients instead of", {"coefficient_count": 3})):
        with pytest.raises(Exception, match=message):
            reading(**head)
    with pytest.raises(ValueError):
        archives.write_archive(leaves, f"file://{tmp_path}/c", L, "uint16", "split_masks")
    with pytest.raises(ValueError):
        archives.write_archive(leaves, f"file://{tmp_path}/c", L, "float64")


def test_raised_leaves_keep_the_field(spark, leaves):
    raised = refine.elevate_to(leaves, leaves.where("level = 0"), (3, 2, 1))
    assert {tuple(r) for r in raised.where("level = 0").select("px", "py", "pz").distinct().collect()} <= {(3, 2, 1), (3, 3, 3)}
    points = spark.range(200).selectExpr("id", "-1 + 2 * ((id * 37) % 101 + 0.5D) / 101 as x", "-1 + 2 * ((id * 53) % 103 + 0.5D) / 103 as y", "-1 + 2 * ((id * 71) % 107 + 0.5D) / 107 as z")
    values = [{r["id"]: r["value"] for r in lookup.evaluate(points, t, L, ["id"]).collect()} for t in (leaves, raised)]
    assert np.allclose([values[0][i] for i in range(200)], [values[1][i] for i in range(200)], atol=1e-12)


def test_projector_and_selection(spark):
    for low, high in (((0, 0, 0), (1, 1, 1)), ((1, 0, 2), (2, 2, 3))):
        p = refine.column_projector(low, high)
        lift = np.eye(1)
        for a, b in zip(low, high):
            lift = np.kron(lift, refine.lift_matrix(a, b))
        assert np.allclose(p @ p, p) and np.allclose(p, p.T) and np.allclose(p @ lift, lift)
    rows = [(0, 0, 0, i, 0, 0, 0, 7, e) for i, e in enumerate((5.0, 4.0, 3.0, 2.0, 0.0))]
    found = spark.createDataFrame(rows, "level long, ix long, iy long, iz long, old_x long, old_y long, old_z long, added long, energy double")
    chosen = lambda **k: sorted(r["iz"] for r in refine.gradient_refinement(found, 1.0, **k).where("chosen").collect())
    assert chosen(fraction=1.0, eligible=10, most_added=21) == [0, 1, 2]
    assert chosen(fraction=0.2, eligible=10, most_added=100) == [0, 1]
    assert chosen(fraction=0.0, eligible=10, most_added=100) == [0] and chosen(fraction=1.0, eligible=10, most_added=100) == [0, 1, 2, 3]


def test_roots_of_a_plane(spark):
    """A field that rises along x as (x + 1) / 2 crosses 0.3 at x = -0.4; split leaves change nothing."""
    def field(spark, split):
        cells = [(0, ix, iy, iz, 1, 0, 0, [(ix + a) / 4 for a in (0, 1)]) for ix in range(4) for iy in range(4) for iz in range(4)]
        t = spark.createDataFrame(cells, "level long, ix long, iy long, iz long, px long, py long, pz long, coeffs array<double>")
        return rewrite.split(t, t.where("ix = 1")) if split else t

    for split in (False, True):
        found = surface.roots(field(spark, split), L, 0.3).toPandas()
        inner = found[found.max(axis=1) < 1]
        assert len(inner) and np.allclose(inner.x, -0.4, atol=1e-4)
        edge = found.drop(inner.index)  # the field ends at the box, where it is over 0.3
        assert len(edge[edge.x == 1.0]) == 16 and (edge.x > -0.4).all()
    assert surface.roots(field(spark, False), L, 5.0).count() == 0
