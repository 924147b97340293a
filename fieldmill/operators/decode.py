"""Trees back from their compact forms: packed nodes and split bits, level after level, with the checks that a stored tree needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, snapshot
from .lookup import KEY
from .ordered import running_totals


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _roots(spark, n: int) -> DataFrame:
    return spark.range(n**3).selectExpr("id", f"id div {n * n} as ix", f"(id div {n}) % {n} as iy", f"id % {n} as iz")


def _children(df: DataFrame, number: Column) -> DataFrame:
    """(id, ix, iy, iz) of the eight children of each row; `number` of the first."""
    octant = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))
    cut = df.select(number.alias("_first"), *KEY[1:], octant.alias("_o"))
    bits = {"ix": "_o div 4", "iy": "(_o div 2) % 2", "iz": "_o % 2"}
    return cut.select((F.col("_first") + F.col("_o")).alias("id"), *(F.expr(f"2 * {c} + {bits[c]}").alias(c) for c in KEY[1:]))


def decode_packed(nodes: DataFrame, levels: Sequence[int], leaf_count: int) -> DataFrame:
    """(leaf_id, key) of the leaves of packed nodes (node_id, child_base, leaf_id; none is null or below 0).

    Each level is one join of its node numbers with the nodes. Raises for nodes that are not numbered 0, 1, ..., nodes that are both
    inner and leaf, node or leaf numbers out of range, inner nodes without children, nodes below the last level, and leaves that no level reaches or more than one node names.
    """
    spark = nodes.sparkSession
    tidy = nodes.select("node_id", *(F.when(F.col(c) >= 0, F.col(c)).cast("long").alias(c) for c in ("child_base", "leaf_id")))
    seen = tidy.agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("distinct"), F.min("node_id").alias("low"), F.max("node_id").alias("high"), F.count_if(F.col("child_base").isNotNull() & F.col("leaf_id").isNotNull()).alias("both"), F.count("leaf_id").alias("leaves"), F.countDistinct("leaf_id").alias("different"), F.max("leaf_id").alias("last")).first()
    _require(seen["n"] == 0 or (seen["distinct"] == seen["n"] and seen["low"] == 0 and seen["high"] == seen["n"] - 1), "node numbers must run from 0 without gaps")
    _require(seen["both"] == 0, "a node is both inner and a leaf")
    _require((seen["last"] if seen["last"] is not None else -1) < leaf_count, "a leaf number is out of range")
    _require(seen["leaves"] == seen["different"], "a leaf belongs to two nodes")
    out, held, front = None, [], _roots(spark, levels[0])
    for level in range(len(levels)):
        met = snapshot(front.join(tidy, F.col("id") == F.col("node_id"), "left"), "level")
        held.append(met)
        flags = met.agg(F.count("*").alias("n"), F.count_if(F.col("node_id").isNull()).alias("lost"), F.count_if(F.col("node_id").isNotNull() & F.col("leaf_id").isNull()).alias("inner"), F.count_if(F.col("node_id").isNotNull() & F.col("leaf_id").isNull() & F.col("child_base").isNull()).alias("bare")).first()
        _require(flags["lost"] == 0, "a node number is out of range")
        _require(flags["bare"] == 0, "an inner node has no children")
        found = met.where("leaf_id is not null").select("leaf_id", F.lit(level).cast("long").alias("level"), *KEY[1:])
        out = found if out is None else out.union(found)
        if not flags["inner"]:
            break
        _require(level + 1 < len(levels), "the tree goes on below its last level")
        front = _children(met.where("leaf_id is null"), F.col("child_base"))
    done = snapshot(out, "leaves")
    discard(*held)
    counts = done.agg(F.count("*").alias("n"), F.countDistinct("leaf_id").alias("different")).first()
    _require(counts["n"] == counts["different"] == leaf_count, "not every leaf is reached")
    return done


def decode_split_bits(bits: DataFrame, levels: Sequence[int], leaf_count: int | None = None) -> DataFrame:
    """(leaf_id, key) of the leaves of split bits (level, place, bit), leaves numbered level by level in packed order.

    A cut node's children follow those of the cut nodes before it on its level, so that its rank among them, a running total, gives their places. The
    last level needs no bits. Raises if a level has not as many bits as nodes, if a node of the last level is cut, or if the leaves are not leaf_count.
    """
    front, out, held, before = _roots(bits.sparkSession, levels[0]), None, [], 0
    for level in range(len(levels)):
        own = bits.where(F.col("level") == level).select(F.col("place").alias("_p"), "bit")
        last = level + 1 == len(levels)
        met = snapshot(front.join(own, F.col("id") == F.col("_p"), "full"), "level")
        held.append(met)
        n = met.agg(F.count("id").alias("nodes"), F.count("_p").alias("bits"), F.count("*").alias("all"), F.coalesce(F.sum(F.when(F.col("bit") > 0, 1)), F.lit(0)).alias("cut")).first()
        _require((last and n["bits"] == 0) or n["nodes"] == n["bits"] == n["all"], f"level {level} has {n['bits']} bits for {n['nodes']} nodes")
        _require(not last or n["cut"] == 0, "the tree goes on below its last level")
        is_cut = (F.coalesce(F.col("bit"), F.lit(0)) > 0).cast("int")
        ranked = running_totals(met.withColumn("_order", -F.col("id").cast("double")), "_order", ["id"], {"_cut": is_cut, "_leaf": 1 - is_cut})
        found = ranked.where(is_cut == 0).select((F.col("_leaf") - 1 + before).cast("long").alias("leaf_id"), F.lit(level).cast("long").alias("level"), *KEY[1:])
        out = found if out is None else out.union(found)
        before += n["nodes"] - n["cut"]
        if not n["cut"]:
            break
        front = _children(ranked.where(is_cut == 1), ((F.col("_cut") - 1) * 8).cast("long"))
    _require(leaf_count is None or before == leaf_count, f"{before} leaves instead of {leaf_count}")
    done = snapshot(out, "leaves")
    discard(*held)
    return done
