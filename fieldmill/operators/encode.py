"""Compact topology tables and the binary leaf stream of inspection clients."""

from __future__ import annotations

import json
import struct
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import KEY
from .ordered import running_totals
from .tree import ancestors, top_leaves

# Fixed values of the leaf stream's format.
MAGIC = b"ACTLEAF1"


def _path(roots: int, deepest: int = 16):
    """Number of a node within its level: the root's place, then one octant for each step down.

    Bit k of the coordinates, for each k below the level, makes the octant k steps above the node.
    """
    root = [F.expr(f"shiftright({c}, cast(level as int))") for c in KEY[1:]]
    out = F.call_function("shiftleft", (root[0] * roots + root[1]) * roots + root[2], (3 * F.col("level")).cast("int"))
    for k in range(deepest):
        bit = [F.shiftright(c, k).bitwiseAND(F.lit(1).cast("long")) for c in KEY[1:]]
        out = out + F.when(F.col("level") > k, F.shiftleft(bit[0] * 4 + bit[1] * 2 + bit[2], 3 * k)).otherwise(F.lit(0).cast("long"))
    return out


def packed_nodes(leaves: DataFrame, roots: int) -> DataFrame:
    """node_id, key, child_base and leaf_id of all nodes: level by level, children of a node side by side.

    A child's node is child_base + 4 * x bit + 2 * y bit + z bit; leaves have no child_base, inner nodes no leaf_id.
    """
    inner = ancestors(leaves).select(*KEY, F.lit(0).alias("leaf"))
    nodes = inner.union(leaves.select(*KEY, F.lit(1).alias("leaf"))).withColumn("path", _path(roots))
    ranked = nodes.withColumn("order", -(F.col("level") * 1e17 + F.col("path")))
    # inner nodes before a node within its level place its children on the next
    run = running_totals(ranked, "order", ["level", "path"], {"place": F.lit(1), "inners": F.lit(1) - F.col("leaf"), "leaves": F.col("leaf")})
    count = nodes.where("level = 0").count()
    base = (count + 8 * (F.col("inners") - 1)).cast("long")
    return run.select((F.col("place") - 1).cast("long").alias("node_id"), *KEY, F.when(F.col("leaf") == 0, base).alias("child_base"), F.when(F.col("leaf") == 1, (F.col("leaves") - 1).cast("long")).alias("leaf_id"))


def split_bits(leaves: DataFrame, roots: int) -> DataFrame:
    """(level, place, bit): for each node, in packed order within its level, whether it is cut."""
    nodes = packed_nodes(leaves, roots)
    first = nodes.groupBy("level").agg(F.min("node_id").alias("first"))  # a row for each level
    return nodes.join(F.broadcast(first), "level").select("level", (F.col("node_id") - F.col("first")).alias("place"), F.col("child_base").isNotNull().cast("int").alias("bit"))


def leaf_stream(leaves: DataFrame, levels: Sequence[int], n: int, least: float = 0.0) -> bytes:
    """The n densest leaves as a binary message: magic, header length, JSON header, coordinates, means, levels, corners.

    Only these n leaves reach the driver. Corners are there if some leaf is trilinear; constant ones repeat their mean.
    """
    rows = top_leaves(leaves, n, least).select(*KEY, "mu", F.when(F.col("px") + F.col("py") + F.col("pz") == 3, F.col("coeffs")).alias("corners")).collect()
    curved = any(r["corners"] for r in rows)
    header = json.dumps({"count": len(rows), "levels": list(levels), "corners": curved}).encode()
    coords = np.array([[r["ix"], r["iy"], r["iz"]] for r in rows], "<u2").tobytes()
    parts = [MAGIC, struct.pack("<I", len(header)), header, coords, b"\0" * (-len(coords) % 4), np.array([r["mu"] for r in rows], "<f4").tobytes(), np.array([r["level"] for r in rows], "u1").tobytes()]
    if curved:
        parts += [b"\0" * (-len(rows) % 4), np.array([r["corners"] or [r["mu"]] * 8 for r in rows], "<f4").tobytes()]
    return b"".join(parts)


def read_leaf_stream(raw: bytes) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(header, coordinates, means, levels, corners) of a leaf stream."""
    if raw[:8] != MAGIC:
        raise ValueError("no leaf stream")
    size = struct.unpack("<I", raw[8:12])[0]
    header, at = json.loads(raw[12 : 12 + size]), 12 + size
    n = header["count"]
    coords = np.frombuffer(raw, "<u2", 3 * n, at).reshape(n, 3)
    at += 6 * n + (-6 * n) % 4
    mu, level = np.frombuffer(raw, "<f4", n, at), np.frombuffer(raw, "u1", n, at + 4 * n)
    at += 5 * n + (-n) % 4
    return header, coords, mu, level, np.frombuffer(raw, "<f4", 8 * n, at).reshape(n, 8) if header["corners"] else None
