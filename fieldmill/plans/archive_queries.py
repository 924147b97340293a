"""Queries of compact archives and of the decoders they need."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import decode, encode, lookup, tree
from ..sources import archives
from ..storage import shared_folder, snapshot
from . import fixtures as fx
from .tree_queries import _PACKED

L, KEY = fx.LEVELS, lookup.KEY


def packed_decode(spark, sf):
    leaves = fx.leaves(spark, sf)
    return decode.decode_packed(encode.packed_nodes(leaves, L[0]), L, leaves.count()).select("leaf_id", *KEY)


def split_bits_decode(spark, sf):
    leaves = fx.leaves(spark, sf)
    return decode.decode_split_bits(snapshot(encode.split_bits(leaves, L[0]), "bits"), L, leaves.count()).select("leaf_id", *KEY)


def _archived(spark, leaves, quantization, topology):
    path = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    archives.write_archive(leaves, path, L, quantization, topology)
    rows = archives.read_archive(spark, path, L)
    return rows.select("leaf_id", *KEY, F.posexplode("coeffs").alias("k", "v")).select("leaf_id", *KEY, F.col("k").cast("long").alias("k"), F.round("v", 9).alias("v"))


def archive_packed_float16(spark, sf):
    return _archived(spark, fx.leaves(spark, sf), "float16", "packed_hierarchy")


def archive_explicit_uint16(spark, sf):
    return _archived(spark, fx.leaves(spark, sf), "uint16", "explicit")


def archive_masks_uint8(spark, sf):
    """The tree of leaf means, all of degree 0."""
    means = tree.with_mean(fx.leaves(spark, sf)).select(*KEY, *(F.lit(0).cast("long").alias(f"p{a}") for a in "xyz"), F.array("mu").alias("coeffs"))
    return _archived(spark, means, "uint8", "auto")


QUERIES = {f.__name__: f for f in (packed_decode, split_bits_decode, archive_packed_float16, archive_explicit_uint16, archive_masks_uint8)}

_ROWS = f"{_PACKED}, numbered AS (SELECT leaf_id, n.level, n.ix, n.iy, n.iz, mu FROM packed n JOIN leaves USING (level, ix, iy, iz) WHERE leaf_id IS NOT NULL), flat AS (SELECT leaf_id, level, ix, iy, iz, unnest(range(len(mu)))::BIGINT AS k, unnest(mu)::FLOAT::DOUBLE AS v FROM numbered)"
_MEANS = f"{_PACKED}, flat AS (SELECT leaf_id, n.level, n.ix, n.iy, n.iz, 0::BIGINT AS k, list_avg(mu)::FLOAT::DOUBLE AS v FROM packed n JOIN leaves USING (level, ix, iy, iz) WHERE leaf_id IS NOT NULL)"
_HALF = "pow(2, greatest(floor(log2(v)), -14) - 10)"
_STEPS = "{rows}, b AS (SELECT min(v) AS low, (max(v)-min(v))/{top}.0::DOUBLE AS s FROM flat) SELECT leaf_id, level, ix, iy, iz, k, round(low::FLOAT::DOUBLE + round_even((v-low)/s, 0)*s::FLOAT::DOUBLE, 9) AS v FROM flat, b"

ORACLES = {
    "packed_decode": f"{_PACKED} SELECT leaf_id, level, ix, iy, iz FROM packed WHERE leaf_id IS NOT NULL",
    "split_bits_decode": f"{_PACKED} SELECT leaf_id, level, ix, iy, iz FROM packed WHERE leaf_id IS NOT NULL",
    "archive_packed_float16": f"{_ROWS} SELECT leaf_id, level, ix, iy, iz, k, round(round_even(v/{_HALF}, 0)*{_HALF}, 9) AS v FROM flat",
    "archive_explicit_uint16": _STEPS.format(rows=_ROWS, top=65535),
    "archive_masks_uint8": _STEPS.format(rows=_MEANS, top=255),
}
