"""Batches of leaves raised in degree on trial: tuned on the training views, kept only if the held-out loss falls enough for the bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid, to_logit, to_mu
from ..storage import discard, snapshot
from . import rewrite
from .adapt import COEFFICIENT_STATE, Model
from .lookup import KEY
from .ordered import running_totals
from .rays import RAY, ray_terms
from .refine import elevate_to

GATE = "part long, leaves long, changed long, before double, after double, gain double, relative_gain double, added_bytes long, score double, accepted boolean, reason string"


def acceptance_sides(source: str) -> bool:
    """Whether a gate's source holds views out of the training ones. Test views can't be one: they are for evaluation alone."""
    kind = source.lower()
    if kind in ("train_holdout", "train_heldout", "heldout", "held_out"):
        return True
    if kind in ("train", "training"):
        return False
    raise ValueError("a gate looks at 'train_holdout' or 'train' views; test views are for evaluation alone")


def _squares(p: Column) -> Column:
    return F.col("w") * p * p - 2.0 * p * F.col("wt") + F.col("wtt")


def held_out_loss(model: Model) -> float:
    """The mean of weight * residual ** 2 over the held-out rays."""
    total = model.paths.where("held_out").agg(F.sum(_squares(F.col("prediction")))).first()[0]
    return (total or 0.0) / max(model.held_out, 1)


def _tuned(model: Model, terms: DataFrame, ways: DataFrame, state: DataFrame, steps: int, rate: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> DataFrame:
    """Coefficients (key, coefficient, mu) after Adam steps on the weighted training loss; other leaves' share of a path's prediction is fixed.

    As many leaves as asked for may be raised at once, so that coefficients stay in a table, a version for each step.
    """
    where = [*KEY, "coefficient"]
    now = snapshot(state.select(*where, to_logit(F.col("mu")).alias("logit"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s")), "tuned")
    for t in range(1, steps + 1):
        valued = now.withColumn("mu", to_mu(F.col("logit")))
        own = terms.join(valued.select(*where, "mu"), where).groupBy(*RAY).agg(F.sum(F.col("mu") * F.col("tw")).alias("own"))
        off = ways.where("not held_out").join(own, RAY).select(*RAY, (F.col("w") * (F.col("prediction") - F.col("before") + F.col("own")) - F.col("wt")).alias("off"))
        slopes = terms.join(off, RAY).groupBy(*where).agg(F.sum(F.col("off") * F.col("tw")).alias("g"))
        met = now.join(slopes, where, "left").withColumn("g", 2.0 / max(model.trained, 1) * F.coalesce("g", F.lit(0.0)) * sigmoid(F.col("logit") - 3.0))
        m, s = b1 * F.col("m") + (1 - b1) * F.col("g"), b2 * F.col("s") + (1 - b2) * F.col("g") * F.col("g")
        step = rate * (m / (1 - b1**t)) / (F.sqrt(s / (1 - b2**t)) + eps)
        later = snapshot(met.select(*where, (F.col("logit") - step).alias("logit"), m.alias("m"), s.alias("s")), "tuned")
        discard(now)
        now = later
    return now.select(*where, to_mu(F.col("logit")).alias("mu"))


def gated_elevation(model: Model, selected: DataFrame, target: tuple[int, int, int], levels: Sequence[int], size: int, views: int, per_part: int = 0, steps: int = 0, rate: float = 2e-2, least_gain: float = 0.0, least_relative: float = 0.0, price: float = 0.0) -> tuple[Model, DataFrame]:
    """Raise the selected leaves to a degree, part by part where per_part is set, each part on trial; the model that results and a row for each part.

    A part stays if the held-out loss falls by more than least_gain, by least_relative of itself or more, and by `price` or more for each byte. Each part is
    tried on the model that the parts before it have left. What is rolled back leaves no trace.
    """
    given, rows, spark = model, [], model.leaves.sparkSession
    numbered = snapshot(running_totals(selected.select(*KEY).distinct(), [], KEY, {"_place": F.lit(1)}), "selected")
    n = numbered.count()
    before = held_out_loss(model)
    for part in range(max(1, -(-n // per_part)) if per_part else 1):
        own = numbered.where(F.expr(f"(_place - 1) div {per_part}") == part) if per_part else numbered
        short = " or ".join(f"p{a} < {t}" for a, t in zip("xyz", target))
        gone = snapshot(model.leaves.join(own.select(*KEY), KEY, "left_semi").where(short), "gone")
        changed = gone.count()
        if not changed:
            rows.append((part, own.count(), 0, before, before, 0.0, 0.0, 0, 0.0, False, "no leaf changes degree"))
            discard(gone)
            continue
        come = snapshot(elevate_to(gone, gone, target), "come")
        held = model.facts.join(gone.select(*KEY), KEY, "left_semi").groupBy(*RAY).agg(F.sum("integral").alias("before"))
        ways = snapshot(model.paths.join(held, RAY), "ways")
        terms = snapshot(ray_terms(ways.select(*RAY), come, levels, size, views).groupBy(*RAY, *KEY, "coefficient").agg(F.sum("w").alias("tw")), "terms")
        state = come.select(*KEY, F.posexplode("coeffs").alias("coefficient", "mu")).withColumn("coefficient", F.col("coefficient").cast("long"))
        state = snapshot(_tuned(model, terms, ways, state, steps, rate), "values") if steps else state
        new = snapshot(terms.join(state, [*KEY, "coefficient"]).groupBy(*RAY, *KEY).agg(F.sum(F.col("mu") * F.col("tw")).alias("integral")), "integrals")
        later = new.groupBy(*RAY).agg(F.sum("integral").alias("own"))
        moved = ways.join(later, RAY, "left").select(*ways.columns, (F.col("prediction") - F.col("before") + F.coalesce("own", F.lit(0.0))).alias("then"))
        less = moved.where("held_out").agg(F.sum(_squares(F.col("prediction")) - _squares(F.col("then")))).first()[0]
        gain = (less or 0.0) / max(model.held_out, 1)
        added = COEFFICIENT_STATE * (come.agg(F.sum(F.size("coeffs"))).first()[0] - gone.agg(F.sum(F.size("coeffs"))).first()[0])
        relative, score = gain / max(before, 1e-12), gain / max(added, 1)
        fails = [why for bad, why in ((gain <= least_gain, "gains too little"), (relative < least_relative, "gains too little for the loss"), (score < price, "gains too little for its bytes")) if bad]
        rows.append((part, own.count(), changed, before, before - gain, gain, relative, added, score, not fails, fails[0] if fails else "gains enough on held-out views"))
        if not fails:
            block = state.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("coefficient", "mu"))).alias("_b"))  # 64 at most
            fresh = come.drop("coeffs").join(block, KEY).withColumn("coeffs", F.transform("_b", lambda x: x["mu"]))
            leaves = snapshot(rewrite.replace(model.leaves, gone, fresh), "leaves")
            facts = snapshot(model.facts.join(gone.select(*KEY), KEY, "left_anti").select(*RAY, *KEY, "integral").unionByName(new.select(*RAY, *KEY, "integral")), "facts")
            then = moved.select(*RAY, F.col("then").alias("_then"))
            paths = model.paths.join(then, RAY, "left").withColumn("prediction", F.coalesce("_then", "prediction")).drop("_then")
            after = Model(leaves, facts, snapshot(paths, "paths"), model.trained, model.held_out)
            if model is not given:
                model.drop()
            model, before = after, before - gain
        discard(gone, come, ways, terms, new, *([state] if steps else []))
    discard(numbered)
    return model, spark.createDataFrame(rows, GATE)
