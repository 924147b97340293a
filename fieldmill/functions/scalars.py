"""Column expressions of the field model: activations, Bernstein bases, geometry of parallel rays."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8
SHIFT = -3.0


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log(F.lit(1.0) + F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    """Stable on both sides: exp is taken of a number that isn't positive."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def inverse_softplus(v: Column, least: float = 1e-12) -> Column:
    v = F.greatest(v, F.lit(least))
    return v + F.log(-F.expm1(-v))


def to_mu(logit: Column, shift: float = SHIFT) -> Column:
    return softplus(logit + shift)


def to_logit(mu: Column, shift: float = SHIFT) -> Column:
    return inverse_softplus(mu) - shift


def binomial(n: Column, k: Column, most: int = 3) -> Column:
    out = F.lit(None).cast("double")
    for a in range(most, -1, -1):
        for b in range(a, -1, -1):
            out = F.when((n == a) & (k == b), float(math.comb(a, b))).otherwise(out)
    return out


def bernstein_row(degree: Column, t: Column, most: int = 3) -> Column:
    """All basis polynomials of a degree of at most 3 as an array; t must lie in [0, 1]."""
    def power(x: Column, n: int) -> Column:
        return reduce(lambda a, b: a * b, [x] * n)

    out = None
    for p in range(most + 1):
        terms = []
        for i in range(p + 1):
            factors = [F.lit(float(math.comb(p, i)))] if 0 < i < p else []
            factors += ([power(t, i)] if i else []) + ([power(1.0 - t, p - i)] if i < p else [])
            terms.append(reduce(lambda a, b: a * b, factors) if factors else F.lit(1.0))
        row = F.array(*terms)
        out = F.when(degree == p, row) if out is None else out.when(degree == p, row)
    return out


def cell_of(x: Column, n: Column | int) -> Column:
    """Cell of [-1, 1] cut in n; 1 itself lies in the last."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.least(F.floor((x + 1.0) * n / 2.0), n - 1).cast("long")


def inside_box(x: Column, y: Column, z: Column) -> Column:
    return (F.abs(x) <= 1.0) & (F.abs(y) <= 1.0) & (F.abs(z) <= 1.0)


def detector(index: Column, size: int) -> Column:
    """Centre of a detector pixel."""
    return -1.0 + (index + 0.5) * (2.0 / size)


def slab(base: Column, step: Column, low: Column, high: Column) -> tuple[Column, Column, Column]:
    """(enter, leave, possible) of base + t * step within [low, high]."""
    flat = F.abs(step) < EPS
    safe = F.when(flat, 1.0).otherwise(step)
    a, b = (low - base) / safe, (high - base) / safe
    return (
        F.when(flat, -1e20).otherwise(F.least(a, b)),
        F.when(flat, 1e20).otherwise(F.greatest(a, b)),
        ~flat | ((base >= low) & (base <= high)),
    )
