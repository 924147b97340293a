"""Adaptive rounds: diagnostics of coefficients, proposed changes of the tree, and their trial on branches.

A model is three versioned tables: leaves, the (path, leaf, integral) facts, and paths with their measurements and prediction.
A branch holds only what a change makes different: the leaves that come, and the paths through them with their new
quadrature terms. It is tuned on the training views and scored on the held-out ones. Committing a branch writes the next version of the three tables; rolling
it back writes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, snapshot
from . import rewrite
from .lookup import KEY, resolution
from .rays import RAY, ray_cell_contributions, ray_terms
from .tree import interface_jumps, sibling_groups

#: Bytes of a model in memory: of a leaf, a coefficient and a node (fixed values).
LEAF_STATE, COEFFICIENT_STATE, NODE_STATE = 64, 12, 8
FORWARD = ("h_split", "p_elevate", "p_elevate_isotropic")
CANDIDATE = ["action", *KEY, "axis", "score"]


def diagnostics(leaves: DataFrame, levels: Sequence[int]) -> DataFrame:
    """Per leaf and axis: the field's steepness there, and whether its high-order coefficients carry it.

    key, degrees, and for each axis variation_ (largest step between coefficients, as a slope, or the jump to a neighbour if that is steeper),
    ratio_ (largest step at the high end over that at the low end; 0 for a constant axis), jump_ (of face means); `axis`: the steepest one.
    Steps are taken within the row's array; only the jumps need neighbours.
    """
    stride = {"x": "(py + 1) * (pz + 1)", "y": "(pz + 1)", "z": "1"}

    def step(a: str, where: str) -> Column:
        place = f"((k div ({stride[a]})) % (p{a} + 1))"
        spots = f"filter(sequence(0, size(coeffs) - 1), k -> {where.format(i=place)})"
        return F.expr(f"coalesce(array_max(transform({spots}, k -> abs(coeffs[int(k + {stride[a]})] - coeffs[k]))), 0D)")

    jumps = interface_jumps(leaves, levels).groupBy(*KEY).agg(*(F.max(F.when(F.col("axis") == i, F.col("jump"))).alias(f"jump_{a}") for i, a in enumerate("xyz")))
    own = leaves.select(*KEY, "px", "py", "pz", *(step(a, f"{{i}} < p{a}").alias(f"_all_{a}") for a in "xyz"), *(step(a, f"p{a} > 0 and {{i}} = 0").alias(f"_low_{a}") for a in "xyz"), *(step(a, f"p{a} > 0 and {{i}} = p{a} - 1").alias(f"_high_{a}") for a in "xyz"))
    half = resolution(F.col("level"), levels) / 2.0
    met = own.join(jumps, KEY)
    met = met.withColumns({f"variation_{a}": F.greatest(F.col(f"_all_{a}") * F.col(f"p{a}") * half, F.col(f"jump_{a}") * half) for a in "xyz"})
    met = met.withColumns({f"ratio_{a}": F.when(F.col(f"p{a}") > 0, F.col(f"_high_{a}") / F.greatest(F.col(f"_low_{a}"), F.lit(1e-12))).otherwise(0.0) for a in "xyz"})
    x, y, z = (F.col(f"variation_{a}") for a in "xyz")
    axis = F.when((x >= y) & (x >= z), 0).when(y >= z, 1).otherwise(2)
    return met.select(*KEY, "px", "py", "pz", *(f"{k}_{a}" for k in ("variation", "ratio", "jump") for a in "xyz"), axis.cast("long").alias("axis"))


def _per_axis(kind: str) -> list[Column]:
    return [F.col(f"{kind}_{a}") for a in "xyz"]


def forward_proposals(found: DataFrame, levels: Sequence[int], most: int, least_variation: float = 1e-3, least_jump: float = 0.05, least_ratio: float = 0.5, most_degree: int = 3, p: bool = True, h: bool = True, isotropic: bool = False) -> DataFrame:
    """The `most` best changes that add to the tree, from its diagnostics: action, key, axis, score; ties go by key and axis.

    A leaf with a jump over least_jump is split, unless it is on the last level. Any other may rise in degree on each axis (on all together if
    `isotropic`) where the field is steeper than least_variation and the ratio doesn't fall below least_ratio.
    """
    jumps = _per_axis("jump")
    largest = F.greatest(*jumps)
    first = F.when(jumps[0] == largest, 0).when(jumps[1] == largest, 1).otherwise(2)
    split = (F.lit(h) & (F.col("level") + 1 < len(levels))) & (largest > least_jump)
    act = lambda name, axis, score: F.struct(F.lit(name).alias("action"), axis.cast("long").alias("axis"), score.alias("score"))

    def rise(a: str) -> tuple[Column, Column]:
        degree, steep, ratio = F.col(f"p{a}"), F.col(f"variation_{a}"), F.col(f"ratio_{a}")
        allowed = (degree < most_degree) & (steep > least_variation) & ((degree == 0) | (ratio >= least_ratio))
        return allowed, F.when(degree > 0, steep * ratio).otherwise(steep)

    rises = [rise(a) for a in "xyz"]
    if not p:
        others = F.array().cast("array<struct<action:string,axis:bigint,score:double>>")
    elif isotropic:
        best = F.array_max(F.array(*(F.when(ok, s) for ok, s in rises)))
        others = F.filter(F.array(act("p_elevate_isotropic", F.lit(None), best)), lambda x: x["score"].isNotNull())
    else:
        others = F.filter(F.array(*(act("p_elevate", F.lit(i), F.when(ok, s)) for i, (ok, s) in enumerate(rises))), lambda x: x["score"].isNotNull())
    made = found.select(*KEY, F.inline(F.when(split, F.array(act("h_split", first, largest))).otherwise(others)))
    return made.select(*CANDIDATE).orderBy(F.desc("score"), *KEY, "axis").limit(max(0, most))


def reverse_proposals(leaves: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """The `most` changes that take least from the tree: the field's steepness along an axis whose degree falls, 0 for eight
    sibling leaves that become one. A merge is known by the parent's key; ties go by action, key and axis."""
    falls = found.select(*KEY, F.inline(F.filter(F.array(*(F.struct(F.lit(i).cast("long").alias("axis"), F.when(F.col(f"p{a}") > 0, F.col(f"variation_{a}")).alias("score")) for i, a in enumerate("xyz"))), lambda x: x["score"].isNotNull())))
    merges = sibling_groups(leaves).select(*KEY, F.lit(None).cast("long").alias("axis"), F.lit(0.0).alias("score"))
    both = falls.select(F.lit("p_reduce").alias("action"), *KEY, "axis", "score").union(merges.select(F.lit("h_merge").alias("action"), *KEY, "axis", "score"))
    return both.orderBy("score", "action", *KEY, "axis").limit(max(0, most))


def measured(rays: DataFrame) -> DataFrame:
    """Rays with a target and a weight, summed per path: n, w, wt, wtt. All that losses and energies need of them."""
    w, t = F.col("weight"), F.col("target")
    return rays.groupBy(*RAY).agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * t).alias("wt"), F.sum(w * t * t).alias("wtt"))


@dataclass
class Model:
    """A version: leaves, facts (path, leaf key, integral), and paths (n, w, wt, wtt, held_out, prediction)."""

    leaves: DataFrame
    facts: DataFrame
    paths: DataFrame
    #: Rays in training and held out; versions share them.
    trained: int
    held_out: int

    def drop(self) -> None:
        discard(self.leaves, self.facts, self.paths)


def first_model(leaves: DataFrame, train: DataFrame, held_out: DataFrame, levels: Sequence[int], size: int, views: int) -> Model:
    """A model of leaves and weighted rays; views are on either side."""
    both = measured(train).withColumn("held_out", F.lit(False)).unionByName(measured(held_out).withColumn("held_out", F.lit(True)))
    facts = snapshot(ray_cell_contributions(both.select(*RAY), leaves, levels, size, views), "facts")
    sums = facts.groupBy(*RAY).agg(F.sum("integral").alias("prediction"))
    paths = snapshot(both.join(sums, RAY, "left").withColumn("prediction", F.coalesce("prediction", F.lit(0.0))), "paths")
    counts = {r["held_out"]: r["n"] for r in paths.groupBy("held_out").agg(F.sum("n").alias("n")).collect()}
    return Model(snapshot(leaves.select(*rewrite.LEAF), "leaves"), facts, paths, counts.get(False, 0), counts.get(True, 0))


@dataclass
class Branch:
    """What a change makes different: leaves that go and come, and the paths through them.

    ways: path, its measurements, prediction, `before` (the going leaves' integral) and `terms`, one (k, w) for each of the coming coefficients it
    meets; k counts them over `leaves`. There are eight leaves at most, so their coefficients are held as one array.
    """

    gone: DataFrame
    leaves: list
    ways: DataFrame
    mu: np.ndarray

    def after(self) -> Column:
        """A path's integral over the coming leaves, folded over its terms."""
        mu = F.array(*map(F.lit, self.mu.tolist()))
        return F.aggregate("terms", F.lit(0.0), lambda s, x: s + F.get(mu, x["k"]) * x["w"])


def region(leaves: DataFrame, candidate) -> DataFrame:
    """The leaves that a candidate replaces: one, or for a merge the eight below its key."""
    level, at = candidate["level"], [candidate[c] for c in KEY[1:]]
    if candidate["action"] == "h_merge":
        here = (F.col("level") == level + 1) & F.expr(" and ".join(f"{c} div 2 = {v}" for c, v in zip(KEY[1:], at)))
        return leaves.where(here)
    return leaves.where((F.col("level") == level) & F.expr(" and ".join(f"{c} = {v}" for c, v in zip(KEY[1:], at))))


def changed(gone: DataFrame, candidate, levels: Sequence[int], most_degree: int = 3) -> DataFrame:
    """The leaves that come in place of a region."""
    action, axis = candidate["action"], candidate["axis"]
    if action == "h_split":
        return rewrite.split(gone, gone)
    if action == "p_elevate":
        return rewrite.elevate(gone, gone, "xyz"[axis])
    if action == "p_elevate_isotropic":
        for a in "xyz":
            gone = rewrite.elevate(gone, gone.where(F.col(f"p{a}") < most_degree), a)
        return gone
    if action == "p_reduce":
        return rewrite.reduce_degree(gone, gone, "xyz"[axis], most_degree)
    if action == "h_merge":
        half = [F.expr(f"{c} div 2").alias(c) for c in KEY[1:]]
        return rewrite.merge(gone, gone.select((F.col("level") - 1).alias("level"), *half).distinct(), levels, most_degree)
    raise ValueError(f"unknown action {action!r}")


def branch(model: Model, candidate, levels: Sequence[int], size: int, views: int) -> Branch | None:
    """The candidate tried on a model; None if the leaves it was proposed for are there no more."""
    gone = region(model.leaves, candidate)
    expected = 8 if candidate["action"] == "h_merge" else 1
    axis = candidate["axis"]
    if gone.count() != expected or (candidate["action"] == "p_reduce" and not gone.where(F.col(f"p{'xyz'[axis]}") > 0).count()):
        return None
    come = changed(gone, candidate, levels)
    rows = come.orderBy(*KEY).collect()  # eight at most
    first = np.cumsum([0, *(len(r["coeffs"]) for r in rows)])
    spark = gone.sparkSession
    numbers = spark.createDataFrame([(*(r[c] for c in KEY), int(f)) for r, f in zip(rows, first)], "level long, ix long, iy long, iz long, _first long")
    known = spark.createDataFrame([tuple(r[c] for c in rewrite.LEAF) for r in rows], come.select(*rewrite.LEAF).schema)
    own = model.facts.join(F.broadcast(gone.select(*KEY)), KEY, "left_semi").groupBy(*RAY).agg(F.sum("integral").alias("before"))
    crossing = snapshot(model.paths.join(own, RAY), "crossing")
    terms = ray_terms(crossing.select(*RAY), known, levels, size, views).join(F.broadcast(numbers), KEY)
    one = terms.groupBy(*RAY, (F.col("_first") + F.col("coefficient")).alias("k")).agg(F.sum("w").alias("w"))
    listed = one.groupBy(*RAY).agg(F.collect_list(F.struct(F.col("k").cast("int").alias("k"), "w")).alias("terms"))  # 512 at most
    ways = snapshot(crossing.join(listed, RAY, "left"), "ways")
    discard(crossing)
    return Branch(gone, rows, ways, np.concatenate([r["coeffs"] for r in rows]))


def null_direction(degree: int) -> np.ndarray:
    """The direction of an axis' coefficients that no polynomial of a lower degree has: alternating binomials, of length 1."""
    out = np.array([(-1.0) ** i * math.comb(degree, i) for i in range(degree + 1)])
    return out / np.linalg.norm(out)


def on_new_direction(gradient: np.ndarray, slope: np.ndarray, shape: tuple[int, int, int], axis: int) -> np.ndarray:
    """A block's logit gradient projected, line by line along an axis, on the direction that its last rise in degree has added."""
    g, j = (np.moveaxis(v.reshape(shape), axis, 0).reshape(shape[axis], -1) for v in (gradient, np.maximum(slope, 1e-8)))
    tangent = null_direction(shape[axis] - 1)[:, None] / j
    scale = (g * tangent).sum(axis=0) / np.maximum((tangent * tangent).sum(axis=0), 1e-12)
    rest = [n for i, n in enumerate(shape) if i != axis]
    return np.moveaxis((tangent * scale).reshape(shape[axis], *rest), 0, axis).ravel()


def tune(model: Model, made: Branch, steps: int, rate: float, axis: int | None = None, shift: float = -3.0, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> None:
    """Steps on the weighted loss of the training views that move the branch's coefficients only.

    With an axis, plain steps along the direction that its last rise in degree has added; otherwise Adam. Each step is one
    aggregation of the branch's paths; its state is as large as the branch's coefficients.
    """
    logits = made.mu + np.log(-np.expm1(-np.maximum(made.mu, 1e-12))) - shift
    m = s = np.zeros_like(logits)
    for t in range(1, steps + 1):
        off = F.col("w") * (F.col("prediction") - F.col("before") + made.after()) - F.col("wt")
        pulled = made.ways.where("not held_out and terms is not null").select(off.alias("off"), F.inline("terms").alias("k", "tw"))
        sums = pulled.groupBy("k").agg(F.sum(F.col("off") * F.col("tw")).alias("g")).collect()
        slope = np.exp(-np.logaddexp(0.0, -(logits + shift)))
        gradient = np.zeros_like(logits)
        for r in sums:
            gradient[r["k"]] = 2.0 * r["g"] / max(model.trained, 1)
        gradient *= slope
        if axis is not None:
            first = 0
            for leaf in made.leaves:
                shape = tuple(int(leaf[f"p{a}"]) + 1 for a in "xyz")
                n = math.prod(shape)
                if shape[axis] > 1:
                    gradient[first : first + n] = on_new_direction(gradient[first : first + n], slope[first : first + n], shape, axis)
                first += n
            logits = logits - rate * gradient
        else:
            m, s = b1 * m + (1 - b1) * gradient, b2 * s + (1 - b2) * gradient**2
            logits = logits - rate * (m / (1 - b1**t)) / (np.sqrt(s / (1 - b2**t)) + eps)
        made.mu = np.logaddexp(0.0, logits + shift)


def energies(model: Model, made: Branch) -> tuple[float, float]:
    """The region's energy on the held-out rays before and after: the mean of weight * (residual * the region's share of the prediction) ** 2."""
    after = made.after()
    now, then = F.col("prediction"), F.col("prediction") - F.col("before") + after
    squares = lambda p: F.col("w") * p * p - 2.0 * p * F.col("wt") + F.col("wtt")
    share = lambda own, p: F.pow(own / F.greatest(p, F.lit(1e-8)), 2.0)
    held = made.ways.where("held_out").withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<k:int,w:double>>")))
    r = held.agg(F.sum(squares(now) * share(F.col("before"), now)).alias("a"), F.sum(squares(then) * share(after, then)).alias("b")).first()
    return (r["a"] or 0.0) / max(model.held_out, 1), (r["b"] or 0.0) / max(model.held_out, 1)


def added_bytes(gone: int, gone_coefficients: int, come: int, come_coefficients: int) -> int:
    """What a change adds to a model's size; a split adds eight nodes, and a merge takes them."""
    nodes = 8 * ((come > gone) - (come < gone))
    return (come - gone) * LEAF_STATE + (come_coefficients - gone_coefficients) * COEFFICIENT_STATE + nodes * NODE_STATE


def verdict(action: str, before: float, after: float, added: int, price: float, merge_price: float, mode: str = "rate_distortion", least_gain: float = 0.0) -> tuple[float, bool, str]:
    """(score for each byte, whether the change stays, why)."""
    gain = before - after
    if action in FORWARD:
        score = gain / max(added, 1)
        if mode == "fixed_gain":
            stays = gain > least_gain and added > 0
        elif mode == "rate_distortion":
            stays = gain > 0 and added > 0 and score > price
        else:
            raise ValueError("mode is rate_distortion or fixed_gain")
        return score, stays, "gains enough on held-out views" if stays else ("gains nothing on held-out views" if gain <= 0 else "gains too little for its bytes")
    penalty = max(-gain, 0.0) / max(-added, 1)
    stays = added < 0 and penalty < merge_price
    return -penalty, stays, "costs little for the bytes it saves" if stays else "costs too much on held-out views"


def committed(model: Model, made: Branch) -> Model:
    """The next version: the branch's leaves, integrals and predictions in place of the region's."""
    spark = model.leaves.sparkSession
    rows, first, firsts = [], 0, []
    for leaf in made.leaves:
        n = len(leaf["coeffs"])
        rows.append((*(leaf[c] for c in rewrite.LEAF[:-1]), made.mu[first : first + n].tolist()))
        firsts.append((*(leaf[c] for c in KEY), first, first + n))
        first += n
    come = spark.createDataFrame(rows, model.leaves.schema)
    leaves = snapshot(rewrite.replace(model.leaves, made.gone, come), "leaves")
    mu = F.array(*map(F.lit, made.mu.tolist()))
    owners = F.broadcast(spark.createDataFrame(firsts, "level long, ix long, iy long, iz long, _from int, _to int"))
    each = made.ways.select(*RAY, F.inline("terms").alias("k", "tw")).join(owners, (F.col("k") >= F.col("_from")) & (F.col("k") < F.col("_to")))
    new = each.groupBy(*RAY, *KEY).agg(F.sum(F.get(mu, F.col("k")) * F.col("tw")).alias("integral"))
    kept = model.facts.join(F.broadcast(made.gone.select(*KEY)), KEY, "left_anti")
    facts = snapshot(kept.select(*RAY, *KEY, "integral").unionByName(new), "facts")
    none = F.array().cast("array<struct<k:int,w:double>>")
    moved = made.ways.withColumn("terms", F.coalesce("terms", none)).select(*RAY, (made.after() - F.col("before")).alias("_more"))
    paths = model.paths.join(moved, RAY, "left").withColumn("prediction", F.col("prediction") + F.coalesce("_more", F.lit(0.0))).drop("_more")
    return Model(leaves, facts, snapshot(paths, "paths"), model.trained, model.held_out)


AUDIT = "place long, action string, level long, ix long, iy long, iz long, axis long, diagnostic double, before double, after double, gain double, added_bytes long, score double, accepted boolean, reason string"


def adaptive_round(model: Model, levels: Sequence[int], size: int, views: int, most_forward: int = 8, most_reverse: int = 4, steps: int = 20, rate: float = 5e-3, price: float = 0.0, merge_price: float = 0.0, mode: str = "rate_distortion", least_gain: float = 0.0, **proposing) -> tuple[Model, DataFrame]:
    """One round: forward candidates one after another, each tried on a branch of the model as it then is, tuned and kept or rolled back, and then reverse
    candidates, proposed for what has come of it and not tuned. Gives the model and an audit row for each candidate.

    Candidates are as many as asked for, at most; whatever grows with the data stays in tables. A version that a commit replaces is deleted, but not
    the one that came in.
    """
    given, audit, spark = model, [], model.leaves.sparkSession

    def tried(now: Model, candidate) -> Model:
        row = (len(audit), candidate["action"], *(candidate[c] for c in KEY), candidate["axis"], candidate["score"])
        made = branch(now, candidate, levels, size, views)
        if made is None:
            audit.append((*row, None, None, 0.0, 0, 0.0, False, "its leaves are there no more"))
            return now
        if candidate["action"] in FORWARD:
            tune(now, made, steps, rate, candidate["axis"] if candidate["action"] == "p_elevate" else None)
        before, after = energies(now, made)
        n, size_gone = made.gone.agg(F.count("*"), F.sum(F.size("coeffs"))).first()
        added = added_bytes(n, size_gone, len(made.leaves), len(made.mu))
        score, stays, why = verdict(candidate["action"], before, after, added, price, merge_price, mode, least_gain)
        audit.append((*row, before, after, before - after, added, score, stays, why))
        out = committed(now, made) if stays else now
        discard(made.ways)
        if out is not now and now is not given:
            now.drop()
        return out

    for candidate in forward_proposals(diagnostics(model.leaves, levels), levels, most_forward, **proposing).collect():
        model = tried(model, candidate)
    for candidate in reverse_proposals(model.leaves, diagnostics(model.leaves, levels), most_reverse).collect():
        model = tried(model, candidate)
    return model, spark.createDataFrame(audit, AUDIT)
