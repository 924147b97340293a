"""Rate-distortion compression of the leaf tree: candidate blocks, bottom-up selection, quantisation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import snapshot
from .lookup import KEY, evaluate
from .rewrite import LEAF, basis_matrix
from .tree import ancestors, packed_bytes

AXIS = 4
NODE_BYTES, P0_BYTES, P1_BYTES = 8.0, 13.0, 27.0
ACTIONS = ("keep", "p0", "p1")


def p1_design(n: int = AXIS) -> tuple[np.ndarray, np.ndarray]:
    """(design, pseudo-inverse) of the trilinear block at n * n * n midpoints."""
    one = basis_matrix(1, (np.arange(n) + 0.5) / n)
    design = np.einsum("ai,bj,ck->abcijk", one, one, one).reshape(n**3, 8)
    return design, np.linalg.pinv(design)


def _constant(values: np.ndarray) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _detail(values: Column, n: int = AXIS) -> Column:
    """The mean squared forward difference of an n * n * n grid, summed over the axes."""
    spots = np.arange(n**3)
    out = F.lit(0.0)
    for step in (n * n, n, 1):
        low = spots[spots // step % n < n - 1]
        diff = F.transform(F.array(*(F.lit(int(i)) for i in low)), lambda i: F.get(values, i + int(step)) - F.get(values, i))
        out = out + _total(F.transform(diff, lambda d: d * d))
    return out * float((n - 1) ** 2) / float((n - 1) * n * n)


def node_samples(leaves: DataFrame, levels: Sequence[int], n: int = AXIS) -> DataFrame:
    """The field at n * n * n midpoints of every internal node: key, at, v, volume."""
    nodes = ancestors(leaves)
    width = F.element_at(F.array(*(F.lit(2.0 / v) for v in levels)), (F.col("level") + 1).cast("int"))
    at = nodes.select(*(F.col(c).alias(f"n_{c}") for c in KEY), (width * width * width).alias("volume"), width.alias("w"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n**3 - 1).cast("long"))).alias("at"))
    part = {"x": f"at div {n * n}", "y": f"(at div {n}) % {n}", "z": f"at % {n}"}
    spots = at.withColumns({a: -1.0 + (F.col(f"n_i{a}") + (F.expr(part[a]) + 0.5) / n) * F.col("w") for a in "xyz"})
    held = [f"n_{c}" for c in KEY]
    values = evaluate(spots, leaves, levels, [*held, "volume", "at"])
    return values.select(*(F.col(h).alias(c) for h, c in zip(held, KEY)), "volume", "at", F.col("value").alias("v"))


def candidate_bank(samples: DataFrame, key: list[str]) -> DataFrame:
    """Per node: p0 (mean), p1 (8 coefficients), and value and detail distortion of either, times the volume.

    `samples` has key, volume, at (0 to 63) and v. A node's 64 samples meet once, as an array; fits and differences are
    array sums within its row.
    """
    design, inverse = p1_design()
    grid = samples.groupBy(*key, "volume").agg(F.avg("v").alias("p0"), F.var_pop("v").alias("p0_dist"), F.sort_array(F.collect_list(F.struct("at", "v"))).alias("_g"))
    grid = grid.withColumn("_v", F.transform("_g", lambda x: x["v"])).drop("_g")
    grid = grid.withColumn("p1", F.array(*(F.greatest(_total(F.zip_with("_v", _constant(row), lambda x, w: x * w)), F.lit(1e-12)) for row in inverse)))
    def plus(fit: Column, k: int) -> Column:
        return F.zip_with(fit, _constant(design[:, k]), lambda s, b: s + F.get("p1", F.lit(k)) * b)

    fit = reduce(plus, range(8), F.array_repeat(F.lit(0.0), AXIS**3))
    grid = grid.withColumn("_r", F.zip_with("_v", fit, lambda x, y: x - y))
    made = {"p0_dist": F.col("p0_dist"), "p0_detail": _detail(F.col("_v")), "p1_dist": _total(F.transform("_r", lambda r: r * r)) / AXIS**3, "p1_detail": _detail(F.col("_r"))}
    return grid.select(*key, "p0", "p1", *((e * F.col("volume")).alias(c) for c, e in made.items()))


def select_tree(leaves: DataFrame, bank: DataFrame, depth: int, prices: Sequence[float], gamma: float = 0.0, allow_p0: bool = True) -> DataFrame:
    """One bottom-up pass for many prices of a byte at once: (price, key, action, bytes, dist) of internal nodes.

    A node is kept, or replaced by its p0 or p1 block, whichever costs least; ties go to the first of these.
    """
    spark = leaves.sparkSession
    lam = F.broadcast(spark.createDataFrame([(float(p),) for p in prices], "price double"))
    own = leaves.select(*KEY, packed_bytes().cast("double").alias("bytes"), F.lit(0.0).alias("dist"))
    below, out = None, None
    for level in range(depth - 1, -1, -1):
        here = own.where(F.col("level") == level).crossJoin(lam).select("price", *KEY, "bytes", "dist")  # a few prices, not a join of tables
        if below is not None:
            up = below.select("price", (F.col("level") - 1).alias("level"), *(F.expr(f"i{x} div 2").alias(f"i{x}") for x in "xyz"), "bytes", "dist")
            kids = up.groupBy("price", *KEY).agg((F.sum("bytes") + NODE_BYTES).alias("keep_bytes"), F.sum("dist").alias("keep_dist"))
            met = kids.join(bank.where(F.col("level") == level), KEY)
            d0, d1 = (F.col(f"{p}_dist") + gamma * F.col(f"{p}_detail") for p in ("p0", "p1"))
            cost = [F.col("keep_dist") + F.col("price") * F.col("keep_bytes"), d0 + F.col("price") * P0_BYTES if allow_p0 else F.lit(float("inf")), d1 + F.col("price") * P1_BYTES]
            action = F.when((cost[0] <= cost[1]) & (cost[0] <= cost[2]), 0).when(cost[1] <= cost[2], 1).otherwise(2)
            pick = lambda *v: F.when(action == 0, v[0]).when(action == 1, v[1]).otherwise(v[2])
            done = met.select("price", *KEY, action.alias("action"), pick(F.col("keep_bytes"), F.lit(P0_BYTES), F.lit(P1_BYTES)).alias("bytes"), pick(F.col("keep_dist"), d0, d1).alias("dist"))
            out = done if out is None else out.union(done)
            here = here.union(done.select("price", *KEY, "bytes", "dist"))
        below = here
    return out if out is not None else spark.createDataFrame([], "price double, level long, ix long, iy long, iz long, action int, bytes double, dist double")


def totals(leaves: DataFrame, chosen: DataFrame) -> DataFrame:
    """(price, bytes, dist) of whole trees: the sums over the roots."""
    roots = chosen.where("level = 0").groupBy("price").agg(F.sum("bytes").alias("b"), F.sum("dist").alias("d"))
    flat = leaves.where("level = 0").agg(F.coalesce(F.sum(packed_bytes()), F.lit(0)).alias("f"))
    return roots.crossJoin(F.broadcast(flat)).select("price", (F.col("b") + F.col("f")).alias("bytes"), F.col("d").alias("dist"))


def price_for(leaves: DataFrame, bank: DataFrame, depth: int, budget: float, gamma: float = 0.0, steps: int = 40, at_once: int = 4) -> float:
    """The price of a byte at which the tree just keeps to the budget: 0, or doubled from 1e-6 and then halved in.

    Several halvings are tried by one pass: 2 ** at_once - 1 prices between the bounds.
    """
    def sizes(prices: Sequence[float]) -> dict[float, float]:
        return {r["price"]: r["bytes"] for r in totals(leaves, select_tree(leaves, bank, depth, prices, gamma)).collect()}

    doubled = [1e-6 * 2.0**k for k in range(81)]
    found = sizes([0.0, *doubled])
    if not found or found[0.0] <= budget:
        return 0.0
    high = next((k for k, p in enumerate(doubled) if found[p] <= budget), None)
    if high is None:
        raise ValueError("no price reaches the budget")
    low, top = 0.0, doubled[high]
    for _ in range(steps // at_once):
        grid = [low + (top - low) * k / 2**at_once for k in range(1, 2**at_once)]
        found = sizes(grid)
        # what halving after halving would have tried
        a, b = 0, 2**at_once
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if found[grid[mid - 1]] > budget else (a, mid)
        low, top = (low if a == 0 else grid[a - 1]), (top if b == 2**at_once else grid[b - 1])
    return top


def pruned(leaves: DataFrame, bank: DataFrame, actions: DataFrame) -> DataFrame:
    """The tree that the actions leave: a replaced node hides all below it."""
    cut = actions.where("action > 0").select(*KEY, "action")
    up = lambda df: df.where("level > 0").select(*(F.col(c).alias(f"own_{c}") for c in KEY), F.explode(F.sequence(F.lit(0), F.col("level") - 1)).alias("up")).select(*(f"own_{c}" for c in KEY), F.col("up").cast("long").alias("level"), *(F.expr(f"shiftright(own_{c}, cast(own_level - up as int))").alias(c) for c in KEY[1:]))
    hidden = lambda df: up(df).join(cut.select(*KEY), KEY, "left_semi").select(*(F.col(f"own_{c}").alias(c) for c in KEY)).distinct()
    stay = leaves.join(hidden(leaves), KEY, "left_anti").select(*LEAF)
    live = cut.join(hidden(cut), KEY, "left_anti").join(bank, KEY)
    degree = (F.col("action") - 1).cast("long")
    come = live.select(*KEY, degree.alias("px"), degree.alias("py"), degree.alias("pz"), F.when(F.col("action") == 1, F.array("p0")).otherwise(F.col("p1")).alias("coeffs"))
    return stay.unionByName(come)


def compress_to(leaves: DataFrame, levels: Sequence[int], budget: float, gamma: float = 0.0) -> DataFrame:
    """The tree of least distortion found within a byte budget."""
    bank = snapshot(candidate_bank(node_samples(leaves, levels), KEY), "bank")
    price = price_for(leaves, bank, len(levels), budget, gamma)
    return pruned(leaves, bank, select_tree(leaves, bank, len(levels), [price], gamma))


def quantised(df: DataFrame, value: str, bits: int) -> DataFrame:
    """Adds q (0 to 2 ** bits - 1, half to even), low and scale of the whole column; a constant column counts as 1 wide."""
    bounds = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    top = float(2**bits - 1)
    spread = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    with_bounds = df.crossJoin(F.broadcast(bounds.select("low", (spread / top).alias("scale"))))  # one row
    return with_bounds.withColumn("q", F.rint(F.least(F.greatest((F.col(value) - F.col("low")) / F.col("scale"), F.lit(0.0)), F.lit(top))).cast("long"))


def dequantised() -> Column:
    return F.col("low") + F.col("q") * F.col("scale")
