"""Batch refinement: leaves raised to a target degree or split under a cap, and degrees chosen by what the loss' gradient asks of them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, snapshot
from . import rewrite
from .adapt import measured
from .lookup import KEY
from .ordered import running_totals
from .rays import RAY, ray_terms

#: Bytes that a coefficient adds to a packed tree (fixed value).
RATE_BYTES = 2


def lift_matrix(low: int, high: int) -> np.ndarray:
    """Coefficients of degree `high` from those of degree `low`."""
    out = np.eye(low + 1)
    for p in range(low + 1, high + 1):
        step = np.zeros((p + 1, p))
        for i in range(p + 1):
            if i < p:
                step[i, i] = 1 - i / p
            if i:
                step[i, i - 1] = i / p
        out = step @ out
    return out


def _axis_table(spark, matrices: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """(low, high, i, old, w) of each pair of degrees: a constant table of some hundred rows."""
    rows = [(low, high, i, j, float(w)) for (low, high), m in matrices.items() for i, row in enumerate(m) for j, w in enumerate(row) if w]
    return spark.createDataFrame(rows, "low long, high long, i long, old long, w double")


def elevate_to(leaves: DataFrame, chosen: DataFrame, target: tuple[int, int, int], most: int = 3) -> DataFrame:
    """Leaves with the chosen ones' degrees raised to the target wherever they fall short of it; the field stays the same.

    Each axis is one join with a constant table; a block is summed up once, not once for each degree gained.
    """
    short = " or ".join(f"p{a} < {t}" for a, t in zip("xyz", target))
    up = leaves.join(chosen.select(*KEY), KEY, "left_semi").where(short)
    table = F.broadcast(_axis_table(leaves.sparkSession, {(low, high): lift_matrix(low, high) for low in range(most + 1) for high in range(low, most + 1)}))
    rows = rewrite.coefficients(up)
    for a, t, old in zip("xyz", target, "abc"):
        high = F.greatest(F.col(f"p{a}"), F.lit(t).cast("long"))
        met = rows.withColumn("_high", high).join(table.withColumnRenamed("old", "_old"), (F.col(f"p{a}") == F.col("low")) & (F.col("_high") == F.col("high")) & (F.col(old) == F.col("_old")))
        rows = met.withColumn("v", F.col("v") * F.col("w")).withColumns({old: F.col("i"), f"p{a}": F.col("_high")}).drop("_high", "_old", "low", "high", "i", "w")
    summed = rows.groupBy(*rewrite.LEAF[:-1], "a", "b", "c").agg(F.sum("v").alias("v"))
    return rewrite.replace(leaves, up, rewrite.blocks(summed, rewrite.LEAF[:-1]))


def split_under_cap(leaves: DataFrame, scored: DataFrame, score: str, levels: Sequence[int], cap: int) -> DataFrame:
    """Leaves with the best-scored ones split while the tree keeps to `cap` leaves; leaves of the last level are passed over."""
    room = max(0, (cap - leaves.count()) // 7)
    able = scored.where((F.col("level") < len(levels) - 1) & F.col(score).isNotNull()).join(leaves.select(*KEY), KEY, "left_semi").select(*KEY, score)
    best = running_totals(able, score, KEY, {"_place": F.lit(1)}).where(F.col("_place") <= room)
    return rewrite.split(leaves, best)


def column_projector(low: Sequence[int], high: Sequence[int]) -> np.ndarray:
    """The projector of blocks of degrees `high` on those that degrees `low` can make."""
    out = np.eye(1)
    for p, q in zip(low, high):
        e = lift_matrix(p, q)
        out = np.kron(out, e @ np.linalg.pinv(e))
    return out


def new_energies(rays: DataFrame, leaves: DataFrame, chosen: DataFrame, target: tuple[int, int, int], levels: Sequence[int], size: int, views: int) -> DataFrame:
    """(key, old degrees, added, energy) of each chosen leaf that falls short of the target: the squared length of what its raised
    block's gradient has outside the column space of the rise, which the block before could not follow.

    `rays` have a target and a weight; the loss is the mean of weight * residual ** 2, its gradient is by coefficient. Raised leaves
    keep the field, so that predictions are those of the tree as it is.
    """
    spark = leaves.sparkSession
    short = " or ".join(f"p{a} < {t}" for a, t in zip("xyz", target))
    old = leaves.join(chosen.select(*KEY), KEY, "left_semi").where(short).select(*KEY, *(F.col(f"p{a}").alias(f"old_{a}") for a in "xyz"))
    raised = snapshot(elevate_to(leaves, chosen, target), "raised")
    terms = snapshot(ray_terms(rays.select(*RAY), raised, levels, size, views).groupBy(*RAY, *KEY, "coefficient").agg(F.sum("w").alias("tw"), F.sum(F.col("c") * F.col("w")).alias("part")), "terms")
    paths = measured(rays)
    total = paths.agg(F.sum("n")).first()[0] or 1
    made = terms.groupBy(*RAY).agg(F.sum("part").alias("prediction"))
    off = paths.join(made, RAY).select(*RAY, (2.0 / total * (F.col("w") * F.col("prediction") - F.col("wt"))).alias("off"))
    slopes = terms.join(off, RAY).groupBy(*KEY, "coefficient").agg(F.sum(F.col("off") * F.col("tw")).alias("g"))
    shape = raised.select(*KEY, *(F.col(f"p{a}").alias(f"new_{a}") for a in "xyz")).join(old, KEY)
    blocks = slopes.join(shape, KEY).groupBy(*shape.columns).agg(F.map_from_entries(F.collect_list(F.struct("coefficient", "g"))).alias("_g"))  # 64 of each at most
    count = lambda k: (F.col(f"{k}_x") + 1) * (F.col(f"{k}_y") + 1) * (F.col(f"{k}_z") + 1)
    full = shape.join(blocks.select(*KEY, "_g"), KEY, "left").withColumn("g", F.transform(F.sequence(F.lit(0).cast("long"), count("new") - 1), lambda k: F.coalesce(F.element_at("_g", k), F.lit(0.0))))
    kinds = shape.select(*(f"{k}_{a}" for k in ("old", "new") for a in "xyz")).distinct().collect()  # 64 at most
    if not kinds:
        discard(terms, raised)
        return spark.createDataFrame([], "level long, ix long, iy long, iz long, old_x long, old_y long, old_z long, added long, energy double")
    table = spark.createDataFrame([(*r, column_projector(r[:3], r[3:]).ravel().tolist()) for r in map(tuple, kinds)], ", ".join(f"{k}_{a} long" for k in ("old", "new") for a in "xyz") + ", _projector array<double>")
    met = full.join(F.broadcast(table), [f"{k}_{a}" for k in ("old", "new") for a in "xyz"])
    # |g| ** 2 - g' P g, folded within the row
    dot = "aggregate(sequence(0, size(g) - 1), 0D, (s, i) -> s + g[i] * aggregate(sequence(0, size(g) - 1), 0D, (t, j) -> t + _projector[i * size(g) + j] * g[j]))"
    energy = F.greatest(F.expr("aggregate(g, 0D, (s, x) -> s + x * x)") - F.expr(dot), F.lit(0.0))
    done = snapshot(met.select(*KEY, *(f"old_{a}" for a in "xyz"), (count("new") - count("old")).alias("added"), energy.alias("energy")), "energies")
    discard(terms, raised)
    return done


def gradient_refinement(energies: DataFrame, rate: float, fraction: float, eligible: int, most_added: int) -> DataFrame:
    """Energies with a score (rate * energy for each byte that the rise adds) and whether the leaf is chosen.

    In order of falling score, those of a positive score are taken as long as the coefficients added so far keep to most_added, and no more than the
    given fraction of the eligible leaves (one at least). What comes after the first that doesn't fit is not tried.
    """
    scored = energies.withColumn("score", rate * F.col("energy") / F.greatest(RATE_BYTES * F.col("added"), F.lit(1)))
    most = max(1, int(eligible * fraction))
    run = running_totals(scored.where("score > 0"), "score", KEY, {"_spent": F.col("added"), "_place": F.lit(1)})
    taken = run.where((F.col("_spent") <= most_added) & (F.col("_place") <= most)).select(*KEY, F.lit(True).alias("_taken"))
    return scored.join(taken, KEY, "left").withColumn("chosen", F.coalesce("_taken", F.lit(False))).drop("_taken")
