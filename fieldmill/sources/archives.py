"""Compact archives of a leaf tree: narrow arrays, cut into chunks of leaves that are written and read in partitions.

An archive is a folder: `chunks` holds arrays as binary values, `header` one JSON row, written last, with what all chunks share. Leaves are
in packed order (level by level, children of a node side by side). Three layouts: explicit keys and offsets; split masks (degree 0 and at most three
levels); packed nodes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.adapt import COEFFICIENT_STATE, LEAF_STATE, NODE_STATE
from ..operators.decode import decode_packed, decode_split_bits
from ..operators.encode import packed_nodes, split_bits
from ..operators.lookup import KEY
from ..storage import discard, snapshot

# Fixed values of the formats.
SCHEMAS = {"explicit": "compact_bernstein_octree_v1", "split_masks": "compact_bernstein_octree_splitmask_v2", "packed_hierarchy": "compact_bernstein_octree_packed_v3"}
KINDS = {"float16": "<f2", "uint8": "u1", "uint16": "<u2"}
CHUNK_TYPE = "kind string, chunk long, first long, n long, a binary, b binary, c binary, d binary"
LEAF_TYPE = "leaf_id long, level long, ix long, iy long, iz long, px long, py long, pz long, coeffs array<double>"


def _coefficients(values: np.ndarray, quantization: str, low: float, scale: float) -> bytes:
    values = values.astype(np.float32)
    if quantization == "float16":
        return values.astype("<f2").tobytes()
    top = 255.0 if quantization == "uint8" else 65535.0
    return np.rint(np.clip((values.astype(np.float64) - low) / scale, 0.0, top)).astype(KINDS[quantization]).tobytes()


def _values(raw: bytes, header: dict) -> np.ndarray:
    read = np.frombuffer(raw, KINDS[header["quantization"]]).astype(np.float64)
    return read if header["quantization"] == "float16" else float(np.float32(header["coefficient_min"])) + read * float(np.float32(header["coefficient_scale"]))


def _leaf_chunk(explicit: bool, quantization: str, low: float, scale: float):
    """A chunk's arrays: levels and coordinates (explicit only), degrees, offsets of its coefficients from its own first one, coefficients."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("leaf_id")
        counts = frame["coeffs"].map(len).to_numpy()
        keys = frame["level"].to_numpy("u1").tobytes() + frame[["ix", "iy", "iz"]].to_numpy("<u2").tobytes() if explicit else b""
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<u4").tobytes() if explicit else b""
        row = ("leaves", frame["chunk"].iloc[0], frame["leaf_id"].iloc[0], len(frame), keys, frame[["px", "py", "pz"]].to_numpy("u1").tobytes(), offsets, _coefficients(np.concatenate(frame["coeffs"].to_list()), quantization, low, scale))
        return pd.DataFrame([row], columns=[c.split()[0] for c in CHUNK_TYPE.split(", ")])

    return pack


def _bit_chunk(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("place")
    row = ("bits", frame["chunk"].iloc[0], frame["place"].iloc[0], len(frame), np.packbits(frame["bit"].to_numpy("u1")).tobytes(), bytes([frame["level"].iloc[0]]), b"", b"")
    return pd.DataFrame([row], columns=[c.split()[0] for c in CHUNK_TYPE.split(", ")])


def _node_chunk(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("node_id")
    row = ("nodes", frame["chunk"].iloc[0], frame["node_id"].iloc[0], len(frame), *(frame[c].fillna(-1).to_numpy("<i4").tobytes() for c in ("child_base", "leaf_id")), b"", b"")
    return pd.DataFrame([row], columns=[c.split()[0] for c in CHUNK_TYPE.split(", ")])


def write_archive(leaves: DataFrame, path: str, levels: Sequence[int], quantization: str = "uint16", topology: str = "packed_hierarchy", max_degree: Sequence[int] = (3, 3, 3), shift: float = -3.0, per_chunk: int = 65_536) -> dict:
    """Write a leaf tree; gives leaf_count, coefficient_count, raw_payload_bytes, file_bytes, model_bytes and their ratio.

    Of split masks, leaves must all have degree 0 and levels be three at most; `auto` takes them where they are possible and else explicit keys. A chunk
    of leaves is packed in one task, however large the tree. Coefficients are kept as float16, or in 8 or 16 bits between their extremes.
    """
    spark = leaves.sparkSession
    if quantization not in KINDS:
        raise ValueError(f"quantization is one of {', '.join(KINDS)}")
    masks = len(levels) <= 3 and (topology != "auto" or not leaves.where("px + py + pz > 0").limit(1).count())
    topology = topology if topology != "auto" else ("split_masks" if masks else "explicit")
    if topology not in SCHEMAS:
        raise ValueError(f"topology is one of {', '.join(SCHEMAS)} and auto")
    if topology == "split_masks" and (len(levels) > 3 or leaves.where("px + py + pz > 0").limit(1).count()):
        raise ValueError("split masks need leaves of degree 0 and at most three levels")
    nodes = snapshot(packed_nodes(leaves, levels[0]), "nodes")
    numbered = snapshot(nodes.where("leaf_id is not null").select("leaf_id", *KEY).join(leaves, KEY), "numbered")
    each = numbered.select(F.explode("coeffs").alias("v")).withColumn("v", F.col("v").cast("float").cast("double"))
    fine = F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))
    n, low, high = each.agg(F.count("*"), F.coalesce(F.min(fine), F.lit(0.0)), F.coalesce(F.max(fine), F.lit(1.0))).first()
    high = high if high > low else low + 1.0
    scale = (high - low) / (255.0 if quantization == "uint8" else 65535.0)
    part = lambda c: F.expr(f"{c} div {per_chunk}").alias("chunk")
    chunks = numbered.select("*", part("leaf_id")).groupBy("chunk").applyInPandas(_leaf_chunk(topology == "explicit", quantization, low, scale), CHUNK_TYPE)
    if topology == "packed_hierarchy":
        rows = nodes.select("node_id", "child_base", "leaf_id", part("node_id"))
        chunks = chunks.union(rows.groupBy("chunk").applyInPandas(_node_chunk, CHUNK_TYPE))
    elif topology == "split_masks":
        rows = split_bits(leaves, levels[0]).where(F.col("level") < max(1, len(levels) - 1)).select("level", "place", "bit", part("place"))
        chunks = chunks.union(rows.groupBy("level", "chunk").applyInPandas(_bit_chunk, CHUNK_TYPE))
    chunks.write.parquet(f"{path}/chunks")
    counts = nodes.agg(F.count("*").alias("nodes"), F.count("leaf_id").alias("leaves")).first()
    header = {"schema": SCHEMAS[topology], "topology": topology, "quantization": quantization, "coefficient_min": low, "coefficient_scale": scale, "level_resolutions": list(levels), "max_degree": list(max_degree), "attenuation_shift": shift, "leaf_count": counts["leaves"], "coefficient_count": n}
    spark.createDataFrame([(json.dumps(header, sort_keys=True),)], "header string").coalesce(1).write.parquet(f"{path}/header")
    discard(nodes, numbered)
    raw = spark.read.parquet(f"{path}/chunks").agg(F.sum(sum((F.octet_length(c) for c in "abcd"), F.lit(0)))).first()[0] or 0
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    model = counts["leaves"] * LEAF_STATE + n * COEFFICIENT_STATE + counts["nodes"] * NODE_STATE
    return {"leaf_count": counts["leaves"], "coefficient_count": n, "quantization": quantization, "raw_payload_bytes": raw, "file_bytes": files, "model_bytes": model, "file_ratio_vs_model_bytes": files / max(model, 1)}


def _leaf_rows(header: dict):
    """Leaves of chunks; level and coordinates are -1 where the layout keeps them elsewhere."""
    explicit, masks = header["topology"] == "explicit", header["topology"] == "split_masks"
    most = np.array(header["max_degree"])

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, n, keys, degrees, offsets, raw in zip(frame["first"], frame["n"], frame["a"], frame["b"], frame["c"], frame["d"]):
                if len(degrees) != 3 * n:
                    raise ValueError("the degrees have another shape than the leaves")
                degree = np.frombuffer(degrees, "u1").reshape(n, 3).astype(np.int64)
                if (degree > most).any() or (masks and degree.any()):
                    raise ValueError("a leaf's degree is over the highest one")
                counts = (degree + 1).prod(axis=1)
                values = _values(raw, header)
                at = np.concatenate([[0], np.cumsum(counts)])
                where = np.full((n, 4), -1, np.int64)
                if explicit:
                    held = np.frombuffer(offsets, "<u4").astype(np.int64)
                    if len(held) != n + 1 or len(keys) != 7 * n:
                        raise ValueError("the keys or offsets have another shape than the leaves")
                    if held[0] != 0:
                        raise ValueError("offsets must begin at 0")
                    if (np.diff(held) <= 0).any():
                        raise ValueError("a leaf has no coefficients")
                    if (held != at).any():
                        raise ValueError("offsets and degrees don't agree")
                    where[:, 0] = np.frombuffer(keys[:n], "u1")
                    where[:, 1:] = np.frombuffer(keys[n:], "<u2").reshape(n, 3)
                if at[-1] != len(values):
                    raise ValueError("offsets end elsewhere than the coefficients")
                yield pd.DataFrame({"leaf_id": first + np.arange(n), **{c: where[:, i] for i, c in enumerate(KEY)}, **{f"p{a}": degree[:, i] for i, a in enumerate("xyz")}, "coeffs": [values[i:j].tolist() for i, j in zip(at[:-1], at[1:])]})

    return unpack


def _bit_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for first, n, raw, level in zip(frame["first"], frame["n"], frame["a"], frame["b"]):
            if 8 * len(raw) < n:
                raise ValueError("a chunk has fewer bits than it says")
            yield pd.DataFrame({"level": level[0], "place": first + np.arange(n), "bit": np.unpackbits(np.frombuffer(raw, "u1"), count=n).astype(np.int32)})


def _node_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for first, n, base, leaf in zip(frame["first"], frame["n"], frame["a"], frame["b"]):
            if len(base) != 4 * n or len(leaf) != 4 * n:
                raise ValueError("node arrays must be of equal length")
            yield pd.DataFrame({"node_id": first + np.arange(n), "child_base": np.frombuffer(base, "<i4").astype(np.int64), "leaf_id": np.frombuffer(leaf, "<i4").astype(np.int64)})


def read_header(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.schema("header string").parquet(f"{path}/header").first()[0])


def read_archive(spark: SparkSession, path: str, levels: Sequence[int] | None = None, max_degree: Sequence[int] | None = None) -> DataFrame:
    """The leaves of an archive, with their leaf_id. Raises where arrays, offsets, counts or the tree don't agree, where the layout is unknown, or where
    levels or degrees are others than those asked for."""
    header = read_header(spark, path)
    if header["schema"] not in SCHEMAS.values() or SCHEMAS.get(header["topology"]) != header["schema"]:
        raise ValueError(f"unknown layout {header['schema']!r}")
    if levels is not None and list(levels) != header["level_resolutions"]:
        raise ValueError(f"the archive has levels {header['level_resolutions']}")
    if max_degree is not None and list(max_degree) != header["max_degree"]:
        raise ValueError(f"the archive has degrees up to {header['max_degree']}")
    chunks = spark.read.schema(CHUNK_TYPE).parquet(f"{path}/chunks")
    leaves = snapshot(chunks.where("kind = 'leaves'").mapInPandas(_leaf_rows(header), LEAF_TYPE), "read")
    n, different, last, coefficients = leaves.agg(F.count("*"), F.countDistinct("leaf_id"), F.max("leaf_id"), F.coalesce(F.sum(F.size("coeffs")), F.lit(0))).first()
    if not n == different == header["leaf_count"] == (last if last is not None else -1) + 1:
        raise ValueError(f"{n} leaves instead of {header['leaf_count']}")
    if coefficients != header["coefficient_count"]:
        raise ValueError(f"{coefficients} coefficients instead of {header['coefficient_count']}")
    if header["topology"] == "explicit":
        return leaves
    resolutions = header["level_resolutions"]
    if header["topology"] == "split_masks":
        bits = chunks.where("kind = 'bits'").mapInPandas(_bit_rows, "level long, place long, bit int")
        keys = decode_split_bits(bits, resolutions, header["leaf_count"])
    else:
        nodes = chunks.where("kind = 'nodes'").mapInPandas(_node_rows, "node_id long, child_base long, leaf_id long")
        keys = decode_packed(nodes, resolutions, header["leaf_count"])
    return leaves.drop(*KEY).join(keys, "leaf_id").select(*(c.split()[0] for c in LEAF_TYPE.split(", ")))
