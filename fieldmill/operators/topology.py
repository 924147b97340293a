"""Whether a leaf table is a tree, by aggregates and anti-joins; coefficients gathered from shared masters; settings by stage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import KEY, resolution
from .tree import ancestors

FAULTS = ("level", "coordinate", "degree", "coefficient_count", "coefficient_value", "repeated_key", "nested_leaf", "missing_child", "missing_root")


def faults(leaves: DataFrame, levels: Sequence[int], max_degree: Sequence[int] = (3, 3, 3)) -> DataFrame:
    """(fault, n): a row for each kind of fault and how often the table has it, 0 if it is sound.

    level, coordinate, degree: out of range; coefficient_count: other than the degrees say; coefficient_value: null or not finite; repeated_key: keys that
    occur again; nested_leaf: leaves with a leaf below them; missing_child: nodes that an inner node lacks; missing_root: cells of the first level without a node. The first three kinds are left out of
    the checks of the tree.
    """
    ok_level = F.col("level").between(0, len(levels) - 1)
    size = resolution(F.col("level"), levels)
    ok_place = F.lit(True)
    for c in KEY[1:]:
        ok_place = ok_place & (F.col(c) >= 0) & (F.col(c) < size)
    ok_degree = F.lit(True)
    for a, most in zip("xyz", max_degree):
        ok_degree = ok_degree & F.col(f"p{a}").between(0, most)
    bad = F.exists("coeffs", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    marked = leaves.withColumns({"_level": no(ok_level), "_place": no(ok_place), "_degree": no(ok_degree)})
    own = marked.agg(
        F.count_if("_level").alias("level"), F.count_if(~F.col("_level") & F.col("_place")).alias("coordinate"), F.count_if("_degree").alias("degree"),
        F.count_if(no(F.size("coeffs") == (F.col("px") + 1) * (F.col("py") + 1) * (F.col("pz") + 1))).alias("coefficient_count"), F.count_if(F.coalesce(bad, F.lit(True))).alias("coefficient_value"))
    placed = marked.where(~F.col("_level") & ~F.col("_place")).select(*KEY)
    keys = placed.groupBy(*KEY).agg(F.count("*").alias("_n"))
    inner = ancestors(keys.select(*KEY)).select(*KEY)
    half = [F.expr(f"{c} div 2").alias(c) for c in KEY[1:]]
    nodes = keys.select(*KEY).union(inner).distinct()
    families = nodes.where("level > 0").groupBy((F.col("level") - 1).alias("level"), *half).agg(F.count("*").alias("_kids"))
    one = lambda df, fault, n: df.agg(F.coalesce(n, F.lit(0)).cast("long").alias("n")).select(F.lit(fault).alias("fault"), "n")
    rest = [
        one(keys, "repeated_key", F.sum(F.col("_n") - 1)), one(keys.join(inner, KEY, "left_semi"), "nested_leaf", F.count("*")),
        one(inner.join(families, KEY, "left"), "missing_child", F.sum(8 - F.coalesce("_kids", F.lit(0)))), one(nodes.where("level = 0"), "missing_root", levels[0] ** 3 - F.count("*")),
    ]
    out = own.select(F.inline(F.array(*(F.struct(F.lit(k).alias("fault"), F.col(k).alias("n")) for k in FAULTS[:5]))))
    for df in rest:
        out = out.union(df)
    return out


def require_tree(leaves: DataFrame, levels: Sequence[int], max_degree: Sequence[int] = (3, 3, 3)) -> None:
    """Raise a ValueError that names every fault of a leaf table."""
    found = [f"{r['fault']}: {r['n']}" for r in faults(leaves, levels, max_degree).where("n > 0").collect()]
    if found:
        raise ValueError("no whole tree; " + ", ".join(found))


def gathered(constraints: DataFrame, masters: DataFrame, key: Sequence[str], ids: str, weights: str, master: str = "master_id", value: str = "value") -> DataFrame:
    """(key, value) of coefficients that are weighted sums of shared masters; ids below 0 count for nothing, and a coefficient of such alone is 0.

    `constraints` has an array of ids and one of weights in each row. Equal ids of a coefficient are summed before masters are looked up.
    """
    each = constraints.select(*key, F.inline(F.arrays_zip(F.col(ids).alias("i"), F.col(weights).alias("w"))))
    wanted = each.where("i >= 0").groupBy(*key, "i").agg(F.sum("w").alias("w"))
    met = wanted.join(masters.select(F.col(master).alias("i"), F.col(value).alias("_v")), "i")
    sums = met.groupBy(*key).agg(F.sum(F.col("w") * F.col("_v")).alias("value"))
    return constraints.select(*key).join(sums, list(key), "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def staged_settings(at: Column, base: Mapping, schedule: Mapping[int, Mapping], local: Mapping | None = None) -> dict[str, Column]:
    """A column for each setting as it holds at an iteration: the base, changed by every stage that has begun, and by `local` where that isn't None.

    Stages add up: a setting that a later stage doesn't name stays as an earlier one left it. They are a configuration, so that the lookup is an expression
    and no join.
    """
    stages = sorted((int(k), dict(v or {})) for k, v in schedule.items())
    fixed = {k: v for k, v in (local or {}).items() if v is not None}
    names = {**base, **{k: None for _, s in stages for k in s}, **fixed}
    out = {}
    for name in names:
        value = F.lit(base.get(name))
        if name in fixed:
            value = F.lit(fixed[name])
        else:
            for start, stage in stages:
                if name in stage:
                    value = F.when(at >= start, F.lit(stage[name])).otherwise(value)
        out[name] = value
    return out


def ramped(at: Column, weight: float, start: int = 1, stop: int | None = None, ramp_steps: int = 0) -> Column:
    """A loss' weight at an iteration: 0 before its start and after its stop, rising in equal steps at first."""
    grown = weight * F.least(F.lit(1.0), (at - start + 1) / float(ramp_steps)) if ramp_steps > 0 else F.lit(float(weight))
    off = (at < start) | ((at > stop) if stop is not None else F.lit(False)) | F.lit(weight <= 0)
    return F.when(off, 0.0).otherwise(grown)
