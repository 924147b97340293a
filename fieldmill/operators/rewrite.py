"""Topology changes of the leaf tree as set operations: anti-join what goes, union what comes.

Leaves are known by (level, ix, iy, iz) throughout, so a change never renumbers the others.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import binomial
from ..storage import discard, snapshot
from .lookup import KEY, evaluate
from .tree import face_neighbours

LEAF = [*KEY, "px", "py", "pz", "coeffs"]


def blocks(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (key, degrees, a, b, c, v) back to leaves with coefficients in order, last axis fastest."""
    at = (F.col("a") * (F.col("py") + 1) + F.col("b")) * (F.col("pz") + 1) + F.col("c")
    put = rows.groupBy(*keep).agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), "v"))).alias("_b"))  # at most 64 of each
    return put.select(*keep, F.transform("_b", lambda x: x["v"]).alias("coeffs"))


def coefficients(leaves: DataFrame) -> DataFrame:
    """One row per coefficient: its place (a, b, c) and value v."""
    rows = leaves.select(*LEAF[:-1], F.posexplode("coeffs").alias("k", "v")).withColumn("k", F.col("k").cast("long"))
    return rows.select(*LEAF[:-1], F.expr("k div ((pz + 1) * (py + 1))").alias("a"), F.expr("(k div (pz + 1)) % (py + 1)").alias("b"), (F.col("k") % (F.col("pz") + 1)).alias("c"), "v")


def replace(leaves: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    return leaves.join(gone.select(*KEY), KEY, "left_anti").select(*LEAF).unionByName(come.select(*LEAF))


def _half(p: Column, i: Column, old: Column, side: Column) -> Column:
    """Weight of an old coefficient in the i-th one of the lower (0) or upper (1) half: de Casteljau's rule in closed form."""
    low = F.when(old <= i, binomial(i, old) / F.pow(F.lit(2.0), i.cast("double"))).otherwise(0.0)
    high = F.when(old >= i, binomial(p - i, old - i) / F.pow(F.lit(2.0), (p - i).cast("double"))).otherwise(0.0)
    return F.when(side == 0, low).otherwise(high)


def split(leaves: DataFrame, chosen: DataFrame) -> DataFrame:
    """Leaves with the chosen ones cut in eight; the field stays the same everywhere."""
    cut = leaves.join(chosen.select(*KEY), KEY, "left_semi")
    child = F.explode(F.array(*(F.struct(F.lit(o // 4).cast("long").alias("ox"), F.lit(o // 2 % 2).cast("long").alias("oy"), F.lit(o % 2).cast("long").alias("oz")) for o in range(8)))).alias("o")
    keys = [(F.col("level") + 1).alias("level"), *((2 * F.col(f"i{x}") + F.col(f"o.o{x}")).alias(f"i{x}") for x in "xyz")]
    flat = cut.where("px = 0 and py = 0 and pz = 0").select("*", child).select(*keys, "px", "py", "pz", "coeffs")
    rows = coefficients(cut.where("px > 0 or py > 0 or pz > 0")).select("*", child)
    for x, old in zip("xyz", "abc"):  # one axis after the other keeps the number of rows small
        rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"p{x}"))).alias("_i"))
        rows = rows.withColumn("v", F.col("v") * _half(F.col(f"p{x}"), F.col("_i"), F.col(old), F.col(f"o.o{x}"))).drop(old).withColumnRenamed("_i", old)
        rows = rows.groupBy(*KEY, "px", "py", "pz", "o", "a", "b", "c").agg(F.sum("v").alias("v"))
    kids = blocks(rows.select(*keys, "px", "py", "pz", "a", "b", "c", "v"), LEAF[:-1])
    return replace(leaves, cut, flat.unionByName(kids))


def elevate(leaves: DataFrame, chosen: DataFrame, axis: str) -> DataFrame:
    """Leaves with the chosen ones' degree on one axis raised by one; the field stays the same."""
    up = leaves.join(chosen.select(*KEY), KEY, "left_semi")
    old = {"x": "a", "y": "b", "z": "c"}[axis]
    p, i = F.col(f"p{axis}") + 1, F.col(old)
    parts = F.array(F.struct(i.alias("to"), (1.0 - i / p).alias("w")), F.struct((i + 1).alias("to"), ((i + 1) / p).alias("w")))
    rows = coefficients(up).select("*", F.inline(parts)).withColumn("v", F.col("v") * F.col("w")).drop(old, "w").withColumnRenamed("to", old).withColumn(f"p{axis}", F.col(f"p{axis}") + 1)
    summed = rows.groupBy(*LEAF[:-1], "a", "b", "c").agg(F.sum("v").alias("v"))
    return replace(leaves, up, blocks(summed, LEAF[:-1]))


def _fit_table(spark, degrees: Sequence[int], matrices) -> DataFrame:
    """(p, i, old, w): a small constant table of least-squares weights per degree."""
    rows = [(p, i, j, float(w)) for p, m in zip(degrees, matrices) for i, row in enumerate(m) for j, w in enumerate(row)]
    return spark.createDataFrame(rows, "p long, i long, old long, w double")


def reduce_degree(leaves: DataFrame, chosen: DataFrame, axis: str, most: int = 3) -> DataFrame:
    """Leaves with the chosen ones' degree on one axis lowered by one, by least squares on coefficients."""
    down = leaves.join(chosen.select(*KEY), KEY, "left_semi").where(F.col(f"p{axis}") > 0)
    old = {"x": "a", "y": "b", "z": "c"}[axis]
    lift = lambda p: np.array([[(1 - i / p) if j == i else (i / p if j == i - 1 else 0.0) for j in range(p)] for i in range(p + 1)])
    table = _fit_table(leaves.sparkSession, range(1, most + 1), [np.linalg.pinv(lift(p)) for p in range(1, most + 1)])
    met = coefficients(down).join(F.broadcast(table.withColumnRenamed("old", "_old")), (F.col(f"p{axis}") == F.col("p")) & (F.col(old) == F.col("_old")))
    rows = met.withColumn("v", F.col("v") * F.col("w")).drop(old, "_old", "p", "w").withColumnRenamed("i", old).withColumn(f"p{axis}", F.col(f"p{axis}") - 1)
    summed = rows.groupBy(*LEAF[:-1], "a", "b", "c").agg(F.greatest(F.sum("v"), F.lit(1e-12)).alias("v"))
    return replace(leaves, down, blocks(summed, LEAF[:-1]))


def basis_matrix(p: int, x: np.ndarray) -> np.ndarray:
    from math import comb

    return np.stack([comb(p, i) * x**i * (1 - x) ** (p - i) for i in range(p + 1)], 1)


def fit_matrix(p: int) -> np.ndarray:
    """Least-squares weights of an axis' midpoint samples for its coefficients."""
    n = max(2 * (p + 1), 4)
    return np.linalg.pinv(basis_matrix(p, (np.arange(n) + 0.5) / n))


def merge(leaves: DataFrame, parents: DataFrame, levels: Sequence[int], most: int = 3) -> DataFrame:
    """Leaves with the eight children of each parent fitted by one block of their highest degrees.

    The fit is by least squares at midpoints; on a product grid it is one small matrix per axis. `parents`
    must name nodes whose eight children are leaves.
    """
    spark = leaves.sparkSession
    up = leaves.where("level > 0").select("*", (F.col("level") - 1).alias("_l"), *(F.expr(f"i{x} div 2").alias(f"_i{x}") for x in "xyz"))
    named = parents.select(F.col("level").alias("_l"), *(F.col(f"i{x}").alias(f"_i{x}") for x in "xyz"))
    kids = up.join(named, ["_l", "_ix", "_iy", "_iz"], "left_semi")
    shape = kids.groupBy("_l", "_ix", "_iy", "_iz").agg(*(F.max(f"p{x}").alias(f"p{x}") for x in "xyz"))
    spots = shape
    for x in "xyz":
        n = F.greatest(2 * (F.col(f"p{x}") + 1), F.lit(4))
        width = 2.0 / F.element_at(F.array(*(F.lit(float(v)) for v in levels)), (F.col("_l") + 1).cast("int"))
        spots = spots.select("*", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias(f"s{x}")).withColumn(x, -1.0 + (F.col(f"_i{x}") + (F.col(f"s{x}") + 0.5) / n) * width)
    node = ["_l", "_ix", "_iy", "_iz"]
    places = spots.select(*node, *(F.col(f"p{x}").alias(f"q{x}") for x in "xyz"), "sx", "sy", "sz", "x", "y", "z")
    rows = evaluate(places, kids.select(*LEAF), levels, [*node, "qx", "qy", "qz", "sx", "sy", "sz"]).withColumnRenamed("value", "v")
    table = _fit_table(spark, range(most + 1), [fit_matrix(p) for p in range(most + 1)])
    for x, out in zip("xyz", "abc"):
        t = table.select(F.col("p").alias(f"q{x}"), F.col("i").alias(out), F.col("old").alias(f"s{x}"), "w")
        rows = rows.join(F.broadcast(t), [f"q{x}", f"s{x}"]).withColumn("v", F.col("v") * F.col("w")).drop("w")
        rest = [c for c in rows.columns if c not in ("v", f"s{x}")]
        rows = rows.groupBy(*rest).agg(F.sum("v").alias("v"))
    done = rows.select(F.col("_l").alias("level"), *(F.col(f"_i{x}").alias(f"i{x}") for x in "xyz"), *(F.col(f"q{x}").alias(f"p{x}") for x in "xyz"), "a", "b", "c", F.greatest("v", F.lit(1e-12)).alias("v"))
    return replace(leaves, kids, blocks(done, LEAF[:-1]))


def balance(leaves: DataFrame, levels: Sequence[int], rounds: int = 8) -> tuple[DataFrame, bool]:
    """Split leaves until face neighbours differ by one level at most; (leaves, whether that was reached).

    Each round is a new snapshot, so a lost executor costs at most a round.
    """
    given = leaves
    for _ in range(rounds):
        pairs = face_neighbours(leaves, levels)
        coarse = snapshot(pairs.where(F.col("own_level") > F.col("level") + 1).select(*KEY).distinct(), "coarse")
        if not coarse.limit(1).count():
            return leaves, True
        later = snapshot(split(leaves, coarse), "leaves")
        discard(coarse, *([] if leaves is given else [leaves]))
        leaves = later
    return leaves, False
