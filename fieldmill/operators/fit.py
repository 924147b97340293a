"""Iterative parts: coefficient gradients from the fact table, Adam steps, plateau detection, clustering."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid, softplus
from ..storage import discard, snapshot
from .lookup import KEY
from .rays import RAY, ray_terms


def ema(values: Column, span: int) -> Column:
    """Exponential moving average of an array, folded in order."""
    alpha = 2.0 / (span + 1)
    start = F.array().cast("array<double>")
    return F.aggregate(values, start, lambda s, x: F.concat(s, F.array(F.when(F.size(s) == 0, x).otherwise((1 - alpha) * F.element_at(s, -1) + alpha * x))))


def plateau(values: Column, window: int, threshold: float, regression: float = 0.005) -> Column:
    """Whether the means of the first and last quarter of the last `window` values differ by little; with both means."""
    window = max(4, window)
    edge = max(1, window // 4)
    recent = F.slice(values, -window, window)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / edge
    start, end = mean(F.slice(recent, 1, edge)), mean(F.slice(recent, -edge, edge))
    gain = (start - end) / F.greatest(F.abs(start), F.lit(1e-12))
    enough = F.size(values) >= window
    return F.when(enough, F.struct(start.alias("start"), end.alias("end"), gain.alias("improvement"), ((gain >= -abs(regression)) & (gain < threshold)).alias("ready")))


def coefficient_gradient(rays: DataFrame, logits: DataFrame, shift: float, levels: Sequence[int], size: int, views: int) -> DataFrame:
    """Gradient of half the mean squared residual by each logit: key, coefficient, logit, gradient.

    `rays` has a target each; rays of one geometry are summed before they meet the path's terms.
    """
    act = logits.select(*KEY, "px", "py", "pz", F.transform("logits", lambda v: softplus(v + shift)).alias("coeffs"))
    terms = snapshot(ray_terms(rays, act, levels, size, views).groupBy(*RAY, *KEY, "coefficient").agg(F.sum("w").alias("w"), F.sum(F.col("c") * F.col("w")).alias("part")), "terms")
    made = terms.groupBy(*RAY).agg(F.sum("part").alias("prediction"))
    paths = rays.groupBy(*RAY).agg(F.count("*").alias("n"), F.sum("target").alias("target"))
    total = paths.agg(F.sum("n")).first()[0]
    off = paths.join(made, RAY, "left").select(*RAY, (F.coalesce("prediction", F.lit(0.0)) * F.col("n") - F.col("target")).alias("off"))
    slopes = terms.join(off, RAY).groupBy(*KEY, "coefficient").agg((F.sum(F.col("off") * F.col("w")) / total).alias("slope"))
    each = logits.select(*KEY, F.posexplode("logits").alias("coefficient", "logit")).withColumn("coefficient", F.col("coefficient").cast("long"))
    return each.join(slopes, [*KEY, "coefficient"], "left").select(*KEY, "coefficient", "logit", (F.coalesce("slope", F.lit(0.0)) * sigmoid(F.col("logit") + shift)).alias("gradient"))


def adam(rays: DataFrame, logits: DataFrame, shift: float, levels: Sequence[int], size: int, views: int, steps: int, rate: float = 0.01, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> DataFrame:
    """Logits after a number of Adam steps; the state is a table that each step replaces."""
    shape = logits.select(*KEY, "px", "py", "pz")
    state = logits.select(*KEY, F.posexplode("logits").alias("coefficient", "logit")).withColumn("coefficient", F.col("coefficient").cast("long")).withColumns({"m": F.lit(0.0), "s": F.lit(0.0)})
    for t in range(1, steps + 1):
        now = state.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("coefficient", "logit"))).alias("l")).select(*KEY, F.transform("l", lambda x: x["logit"]).alias("logits")).join(shape, KEY)
        g = coefficient_gradient(rays, now, shift, levels, size, views).select(*KEY, "coefficient", "gradient")
        m, s = b1 * F.col("m") + (1 - b1) * F.col("gradient"), b2 * F.col("s") + (1 - b2) * F.col("gradient") * F.col("gradient")
        step = rate * (m / (1 - b1**t)) / (F.sqrt(s / (1 - b2**t)) + eps)
        later = snapshot(state.join(g, [*KEY, "coefficient"]).select(*KEY, "coefficient", (F.col("logit") - step).alias("logit"), m.alias("m"), s.alias("s")), "adam")
        if t > 1:
            discard(state)
        state = later
    return state.select(*KEY, "coefficient", "logit")


def kmeans_1d(df: DataFrame, value: str, clusters: int, rounds: int = 25) -> tuple[DataFrame, list[float]]:
    """Rows with their cluster, and the centres: begun at evenly spaced quantiles, moved to means until they rest.

    An empty cluster keeps its centre. Where centres rest, those from before the last, idle move are given.
    """
    centres = df.agg(F.percentile(value, F.array(*(F.lit(i / max(1, clusters - 1)) for i in range(clusters))))).first()[0]
    def nearest(c: list[float]) -> Column:
        return F.array_min(F.array(*(F.struct(F.abs(F.col(value) - x).alias("d"), F.lit(i).alias("i")) for i, x in enumerate(c))))["i"]

    used = centres
    for _ in range(rounds):
        used = centres
        means = {r["k"]: r["m"] for r in df.groupBy(nearest(centres).alias("k")).agg(F.avg(value).alias("m")).collect()}
        moved = [means.get(i, c) for i, c in enumerate(centres)]
        if np.allclose(moved, centres, rtol=1e-5, atol=1e-8):
            break
        centres = moved
    return df.withColumn("cluster", nearest(used)), centres


def group_bases(rows: DataFrame, groups: list[str], values: str, retained: float = 0.99) -> DataFrame:
    """Per group: n, mean and principal directions of an array column that hold the given share of variance.

    Sums and products are aggregated; only a matrix as wide as the array, never a group, meets one task.
    """
    each = rows.select(*groups, values, F.posexplode(values).alias("i", "a"))
    pairs = each.select(*groups, "i", "a", F.posexplode(values).alias("j", "b"))
    sums = pairs.groupBy(*groups, "i", "j").agg(F.count("*").alias("n"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum("a").alias("sa"))

    def decompose(frame):
        import pandas as pd

        size = int(frame["i"].max()) + 1
        n = int(frame["n"].iloc[0])
        gram, mean = np.zeros((size, size)), np.zeros(size)
        gram[frame["i"], frame["j"]] = frame["ab"]
        mean[frame["i"]] = frame["sa"] / n
        values_, vectors = np.linalg.eigh(gram - n * np.outer(mean, mean))
        energy = np.clip(values_[::-1], 0, None)
        rank = 0
        if n > 1 and size > 1 and energy.sum() > 1e-18:
            rank = min(int(np.searchsorted(np.cumsum(energy) / energy.sum(), retained)) + 1, size, n)
        keys = {g: [frame[g].iloc[0]] for g in groups}
        return pd.DataFrame(keys | {"n": [n], "mean": [mean.tolist()], "rank": [rank], "basis": [vectors[:, ::-1][:, :rank].T.ravel().tolist()]})

    kinds = dict(rows.dtypes)
    return sums.groupBy(*groups).applyInPandas(decompose, ", ".join(f"{g} {kinds[g]}" for g in groups) + ", n long, mean array<double>, rank int, basis array<double>")
