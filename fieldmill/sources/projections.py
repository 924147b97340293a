"""Readers of projection datasets: a manifest, one array file per frame, a volume."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_TYPE = "path string, row int, col int, target double"


def manifest(spark: SparkSession, root: str) -> dict:
    """The manifest meta_data.json; only parallel scanners are taken."""
    text = spark.read.text(f"{root}/meta_data.json", wholetext=True).first()[0]
    found = json.loads(text)
    if found["scanner"]["mode"] != "parallel":
        raise ValueError("only parallel scanners are supported")
    return found


def _pixels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for path, content in zip(f["path"], f["content"]):
            image = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float64)
            row, col = np.indices(image.shape)
            yield pd.DataFrame({"path": path, "row": row.ravel().astype(np.int32), "col": col.ravel().astype(np.int32), "target": image.ravel()})


def read_projections(spark: SparkSession, root: str) -> DataFrame:
    """split, view_id, angle, row, col, target of all frames; files are decoded where they are read."""
    found = manifest(spark, root)
    views = [(s, i, p["file_path"], float(p["angle"])) for s in ("train", "test", "val") for i, p in enumerate(found.get(f"proj_{s}") or [])]
    named = spark.createDataFrame(views, "split string, view_id long, file string, angle double")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load([f"{root}/{d}" for d in sorted({v[2].split("/")[0] for v in views})])
    pixels = files.select("path", "content").mapInPandas(_pixels, FRAME_TYPE)
    depth = max(v[2].count("/") for v in views) + 1
    return pixels.withColumn("file", F.substring_index("path", "/", -depth)).join(F.broadcast(named), "file").select("split", "view_id", "angle", "row", "col", "target")


def read_volume(spark: SparkSession, root: str) -> DataFrame:
    """x, y, z, v of the volume that the manifest names."""
    def voxels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                volume = np.load(io.BytesIO(content), allow_pickle=False)
                for x, plane in enumerate(volume):
                    y, z = np.indices(plane.shape)
                    yield pd.DataFrame({"x": np.int32(x), "y": y.ravel().astype(np.int32), "z": z.ravel().astype(np.int32), "v": plane.ravel().astype(np.float64)})

    return spark.read.format("binaryFile").load(f"{root}/{manifest(spark, root)['vol']}").select("content").mapInPandas(voxels, "x int, y int, z int, v double")


def artifacts(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """Files under a folder by suffix, latest first: path, length, modified."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "path")
