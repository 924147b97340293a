"""Where the field crosses a threshold, and how certain coefficients and crossings are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bernstein_row, sigmoid
from .adapt import diagnostics
from .lookup import KEY, evaluate, locate, resolution, terms
from .rays import RAY, ray_terms
from .sampling import spaced

#: A value this near the threshold is a root itself.
EXACT = 1e-7


def _cubic(b: Column, t: Column) -> Column:
    """A cubic in Bernstein form."""
    u = 1.0 - t
    return F.get(b, F.lit(0)) * u * u * u + 3.0 * F.get(b, F.lit(1)) * t * u * u + 3.0 * F.get(b, F.lit(2)) * t * t * u + F.get(b, F.lit(3)) * t * t * t


def lines(leaves: DataFrame, levels: Sequence[int]) -> DataFrame:
    """Lines through each curved leaf along its steepest axis: key, axis, the places u and v on the other two (in the cell), and b, the field
    along the line as a cubic in Bernstein form.

    Along a line a block is a polynomial of one variable: its coefficients are folded with the bases of the other two axes once, within the row, and
    whatever follows evaluates four numbers.
    """
    curved = leaves.where("px + py + pz > 0").join(diagnostics(leaves, levels).select(*KEY, "axis"), KEY)
    other = {0: "yz", 1: "xz", 2: "xy"}
    pick = lambda f: F.when(F.col("axis") == 0, f(0)).when(F.col("axis") == 1, f(1)).otherwise(f(2))
    rows = curved.withColumns({"p": pick(lambda i: F.col(f"p{'xyz'[i]}")), "pu": pick(lambda i: F.col(f"p{other[i][0]}")), "pv": pick(lambda i: F.col(f"p{other[i][1]}"))})
    stride = {"x": "(py + 1) * (pz + 1)", "y": "(pz + 1)", "z": "1"}
    rows = rows.withColumns({"_s": pick(lambda i: F.expr(stride["xyz"[i]])), "_su": pick(lambda i: F.expr(stride[other[i][0]])), "_sv": pick(lambda i: F.expr(stride[other[i][1]]))})
    for name, p in (("u", "pu"), ("v", "pv")):
        n = F.greatest(F.col(p) + 1, F.lit(2))
        rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("_i")).withColumn(name, (F.col("_i") + 0.5) / n).drop("_i")
    rows = rows.withColumns({"_bu": bernstein_row(F.col("pu"), F.col("u")), "_bv": bernstein_row(F.col("pv"), F.col("v"))})
    folded = F.expr("transform(sequence(0, int(p)), i -> aggregate(sequence(0, int(pu)), 0D, (s, j) -> s + _bu[j] * aggregate(sequence(0, int(pv)), 0D, (t, k) -> t + _bv[k] * coeffs[int(i * _s + j * _su + k * _sv)])))")
    rows = rows.withColumn("_l", folded)
    l0, l1, l2, l3 = (F.get("_l", F.lit(i)) for i in range(4))
    cubic = F.when(F.col("p") == 0, F.array(l0, l0, l0, l0)).when(F.col("p") == 1, F.array(l0, (2.0 * l0 + l1) / 3.0, (l0 + 2.0 * l1) / 3.0, l1)).when(F.col("p") == 2, F.array(l0, (l0 + 2.0 * l1) / 3.0, (2.0 * l1 + l2) / 3.0, l2)).otherwise(F.array(l0, l1, l2, l3))
    return rows.select(*KEY, "axis", "u", "v", cubic.alias("b"))


def _placed(levels: Sequence[int], t: Column) -> dict[str, Column]:
    """The point at place t of a line."""
    width = 2.0 / resolution(F.col("level"), levels)
    spot = {"x": (t, F.col("u"), F.col("u")), "y": (F.col("u"), t, F.col("v")), "z": (F.col("v"), F.col("v"), t)}
    return {a: -1.0 + (F.col(f"i{a}") + F.when(F.col("axis") == 0, spot[a][0]).when(F.col("axis") == 1, spot[a][1]).otherwise(spot[a][2])) * width for a in "xyz"}


def roots(leaves: DataFrame, levels: Sequence[int], threshold: float, samples: int = 9, steps: int = 12) -> DataFrame:
    """Distinct points (x, y, z, to 1e-6) where the field is at the threshold.

    Along each curved leaf's lines, `samples` values are taken; a value within 1e-7 of the threshold is a root, and between two of
    unlike signs the crossing is halved `steps` times, all within the row. A line's last sample lies on the next leaf, whose value it has. Where two leaves meet, or
    the field meets the outside (which is 0), with the threshold between their values, the middle of the face is a root.
    """
    cut = lines(leaves, levels)
    ends = cut.withColumns(_placed(levels, F.lit(1.0)))
    own = [F.col(f"own_{c}") for c in KEY]
    keyed = ends.select(*(F.col(c).alias(f"own_{c}") for c in KEY), "axis", "u", "v", "x", "y", "z")
    last = evaluate(keyed, leaves, levels, [*(f"own_{c}" for c in KEY), "axis", "u", "v"]).select(*(o.alias(c) for o, c in zip(own, KEY)), "axis", "u", "v", F.col("value").alias("end"))
    met = cut.join(last, [*KEY, "axis", "u", "v"])
    at = F.array(*(F.lit(k / (samples - 1)) for k in range(samples)))
    values = F.transform(at, lambda t: F.when(t < 1.0, _cubic(F.col("b"), t)).otherwise(F.col("end")) - threshold)
    rows = met.withColumns({"_at": at, "_f": values})
    exact = F.transform(F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.abs(F.get("_f", i)) <= EXACT), lambda i: F.get("_at", i))
    sides = F.filter(F.sequence(F.lit(0), F.lit(samples - 2)), lambda i: (F.get("_f", i) * F.get("_f", i + 1) < 0) & (F.abs(F.get("_f", i)) > EXACT) & (F.abs(F.get("_f", i + 1)) > EXACT))

    def halved(s: Column) -> Column:
        mid = 0.5 * (s["lo"] + s["hi"])
        f = _cubic(F.col("b"), mid) - threshold
        left = s["f"] * f <= 0
        return F.struct(F.when(left, s["lo"]).otherwise(mid).alias("lo"), F.when(left, mid).otherwise(s["hi"]).alias("hi"), F.when(left, s["f"]).otherwise(f).alias("f"))

    def crossing(i: Column) -> Column:
        start = F.struct(F.get("_at", i).alias("lo"), F.get("_at", i + 1).alias("hi"), F.get("_f", i).alias("f"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: halved(s), lambda s: 0.5 * (s["lo"] + s["hi"]))

    along = rows.select(*KEY, "axis", "u", "v", F.explode(F.concat(exact, F.transform(sides, crossing))).alias("_t"))
    inner = along.select(*(c.alias(a) for a, c in _placed(levels, F.col("_t")).items()))
    return _distinct(inner.union(_faces(leaves, levels, threshold)))


def _faces(leaves: DataFrame, levels: Sequence[int], threshold: float, step: float = 1e-5) -> DataFrame:
    """Middles of the leaves' high faces with the threshold between the values on either side."""
    width = 2.0 / resolution(F.col("level"), levels)
    face = leaves.select(*KEY, width.alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("face"))
    middle = {a: -1.0 + (F.col(f"i{a}") + F.when(F.col("face") == k, 1.0).otherwise(0.5)) * F.col("_w") for k, a in enumerate("xyz")}
    face = face.select(*(F.col(c).alias(f"own_{c}") for c in KEY), "face", *(middle[a].alias(f"m{a}") for a in "xyz"))
    probes = face.select("*", F.explode(F.array(F.lit(-1.0), F.lit(1.0))).alias("side"))
    probes = probes.withColumns({a: F.col(f"m{a}") + F.when(F.col("face") == k, F.col("side") * step).otherwise(0.0) for k, a in enumerate("xyz")})
    key = [*(f"own_{c}" for c in KEY), "face", "mx", "my", "mz"]
    values = evaluate(probes, leaves, levels, [*key, "side"])
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("value")))
    both = values.groupBy(*key).agg(side(-1.0).alias("low"), F.coalesce(side(1.0), F.lit(0.0)).alias("high"))
    return both.where((F.col("low") - threshold) * (F.col("high") - threshold) < 0).select(*(F.col(f"m{a}").alias(a) for a in "xyz"))


def _distinct(points: DataFrame) -> DataFrame:
    return points.select(*((F.rint(F.col(a) * 1e6) / 1e6 + 0.0).alias(a) for a in "xyz")).distinct()


def spaced_rays(spark, images: DataFrame, value: str, size: int, views: int, most: int) -> DataFrame:
    """At most `most` pixels, evenly spaced over all views and pixels, with `value` as their target."""
    at = spaced(spark, views * size * size, most).selectExpr(f"at div {size * size} as view_id", f"(at div {size}) % {size} as row", f"at % {size} as col")
    return at.join(images.withColumnRenamed(value, "target"), RAY)


def coefficient_sigma(rays: DataFrame, logits: DataFrame, shift: float, levels: Sequence[int], size: int, views: int, damping: float = 1e-6) -> DataFrame:
    """(key, coefficient, sigma) of every logit: one over the root of the damped diagonal of the weighted Fisher matrix.

    `rays` have a weight each; the weights of one path are summed before they meet its terms. A coefficient that no ray meets has the damping alone.
    """
    act = logits.select(*KEY, "px", "py", "pz", F.transform("logits", lambda v: F.greatest(v + shift, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v + shift)))).alias("coeffs"))
    paths = rays.groupBy(*RAY).agg(F.sum("weight").alias("weight"))
    seen = ray_terms(paths.select(*RAY), act, levels, size, views).groupBy(*RAY, *KEY, "coefficient").agg(F.sum("w").alias("tw"))
    fisher = seen.join(paths, RAY).groupBy(*KEY, "coefficient").agg(F.sum(F.col("weight") * F.col("tw") * F.col("tw")).alias("_h"))
    each = logits.select(*KEY, F.posexplode("logits").alias("coefficient", "logit")).withColumn("coefficient", F.col("coefficient").cast("long"))
    slope = sigmoid(F.col("logit") + shift)
    return each.join(fisher, [*KEY, "coefficient"], "left").select(*KEY, "coefficient", (1.0 / F.sqrt(F.coalesce("_h", F.lit(0.0)) * slope * slope + damping)).alias("sigma"))


def surface_sigma(points: DataFrame, logits: DataFrame, sigma: DataFrame, shift: float, levels: Sequence[int], key: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """(key, sigma) of the field at points: coefficient sigmas carried through the slopes of the field by the logits."""
    both = logits.withColumnRenamed("logits", "coeffs")
    met = terms(locate(points.select(*key), both, levels), levels).join(sigma.withColumnRenamed("sigma", "_s"), [*KEY, "coefficient"])
    part = F.col("basis") * sigmoid(F.col("c") + shift) * F.col("_s")
    return met.groupBy(*key).agg(F.sqrt(F.sum(part * part)).alias("sigma"))
