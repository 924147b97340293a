"""Centroid clustering in integers: Lloyd's rounds, each vector held only against the centroids of its annulus.

A centroid at distance d of a vector has a norm within d of the vector's. Centroids are sorted by norm; the exact
distance to the one of nearest norm bounds d from above, and two binary searches give the run of centroids whose norms
lie in that annulus, both borders included. Those alone are compared, exactly. The bound needs no state of a vector, so a round
is one scan of the input that writes nothing: what leaves a task is a count and a sum of each cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .vectors import apart, is_whole, whole_rows

#: Norms are float64 of integers below 2**60: this much wider, an annulus loses no centroid to rounding.
SLACK = 1e-3


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; of equally near ones the smallest number."""
    lengths = np.sqrt((centroids * centroids).sum(axis=1).astype(np.float64))
    order = np.argsort(lengths, kind="stable")
    norms = lengths[order]
    own = np.sqrt((x * x).sum(axis=1).astype(np.float64))
    right = np.clip(np.searchsorted(norms, own), 0, len(norms) - 1)
    left = np.maximum(right - 1, 0)
    start = np.where(own - norms[left] < norms[right] - own, left, right)
    who = order[start]
    best = apart(x, centroids[who])
    bound = np.sqrt(best.astype(np.float64)) + SLACK
    first, last = np.searchsorted(norms, own - bound, "left"), np.searchsorted(norms, own + bound, "right")
    for place, k in enumerate(order):
        rows = np.flatnonzero((first <= place) & (place < last) & (start != place))
        d = apart(x[rows], centroids[k])
        nearer = (d < best[rows]) | ((d == best[rows]) & (k < who[rows]))
        rows = rows[nearer]
        best[rows], who[rows] = d[nearer], k
    return who, best


def _sums(centroids: np.ndarray, dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            _, x = whole_rows(batch.column("v"), dims, scale)
            who, _ = nearest(x, centroids)
            count += np.bincount(who, minlength=len(centroids))
            for k in np.unique(who):
                total[k] += x[who == k].sum(axis=0)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["k", "n", "total"])

    return run


def _moved(vectors: DataFrame, centroids: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """Each centroid as the exact floor of its vectors' mean; one without vectors stays."""
    each = vectors.mapInArrow(_sums(centroids, dims, scale), "k long, n long, total array<long>")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = each.select("k", "n", F.posexplode("total").alias("i", "x")).groupBy("k", "i").agg(wide("n").alias("n"), wide("x").alias("x"))
    out = centroids.copy()
    for r in sums.collect():  # a row for each centroid and component
        out[r["k"], r["i"]] = int(r["x"]) // int(r["n"])
    return out


def _assigned(centroids: np.ndarray, dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = whole_rows(batch.column("v"), dims, scale)
            who, d = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(kept)), pa.array(who.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    return run


def cluster(embeddings: DataFrame, clusters: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of `dims` finite components.

    Components become floor(scale * x). The first centroids are the vectors with the smallest sha256 of `1:<vec_id>`; after each of
    the `rounds` assignments a centroid moves to the floor of its vectors' mean, and a last assignment follows.

    Vectors that are null, of another length or hold null or non-finite components are left out. Repeated ids count as
    vectors of their own, those with one hash in order of their components; null ids are assigned, but are seeds only after all others. With fewer vectors than
    clusters each is a seed; an empty table gives no rows. Other columns are ignored, whatever their names. Components of 2**26 / scale or more raise
    an error. The driver holds centroids and their sums, never vectors.
    """
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    usable = vectors.where(is_whole(F.col("v")) & (F.size("v") == dims))
    ints = F.transform("v", lambda x: F.floor(x * scale))
    first = usable.orderBy(order.asc_nulls_last(), ints).limit(clusters).select(ints.alias("v")).collect()
    out = "vec_id long, cluster int, distance long"
    if not first:
        return embeddings.sparkSession.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["v"] for r in first], np.int64)
    for _ in range(rounds):
        centroids = _moved(vectors, centroids, dims, scale)
    done = staged(vectors.mapInArrow(_assigned(centroids, dims, scale), out), "clusters")
    per = {r["cluster"]: int(r["d"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row a cluster
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(k, d, sum(per.values()), prints[k]) for k, d in sorted(per.items())]
    of_cluster = embeddings.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
