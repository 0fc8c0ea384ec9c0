"""Hash sampling: every draw is a pure function of (seed, stream, row key).

The same row gives the same draw under any partitioning, retry or executor loss.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, functions as F

from stallkeeper.dims import literal_array

SEED = 42


def u(stream: str, *keys: Column | str, seed: int = SEED) -> Column:
    """Uniform in [0, 1) from the first 32 bits of an md5. Keys are SQL text (column names, literals) or columns."""
    if all(isinstance(k, str) for k in keys):
        parts = ", ".join(f"CAST({k} AS STRING)" for k in keys)
        return F.expr(f"CAST(conv(substring(md5(concat_ws('|', '{seed}|{stream}', {parts})), 1, 8), 16, 10) AS DOUBLE) / 4294967296D")
    columns = [F.expr(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", F.lit(f"{seed}|{stream}"), *[k.cast("string") for k in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform(lo, hi, draw: Column) -> Column:
    lo, hi = _col(lo), _col(hi)
    return lo + (hi - lo) * draw


def int_inclusive(lo, hi, draw: Column) -> Column:
    lo, hi = _col(lo), _col(hi)
    return (lo + F.floor((hi - lo + 1) * draw)).cast("long")


def normal(mean, std, draw: Column, angle: Column) -> Column:
    """Box-Muller on two independent draws."""
    return _col(mean) + _col(std) * F.sqrt(-2 * F.ln(1 - draw)) * F.cos(2 * math.pi * angle)


def exponential(scale, draw: Column) -> Column:
    return -_col(scale) * F.ln(1 - draw)


def beta(a: int, b: int, stream: str, *keys: Column | str) -> Column:
    """Ratio of gamma sums; shapes must be positive integers."""
    if not (isinstance(a, int) and isinstance(b, int) and a > 0 and b > 0):
        raise ValueError("beta needs positive integer shapes")
    draws = [-F.ln(1 - u(f"{stream}{i}", *keys)) for i in range(a + b)]
    first, total = sum(draws[1:a], draws[0]), sum(draws[1:], draws[0])
    return first / total


def cumulative(weights: Sequence[float]) -> list[float]:
    total = sum(weights)
    return [c / total for c in accumulate(weights)]


def weighted_choice(items: Sequence, weights: Sequence[float], draw: Column) -> Column:
    """First item whose cumulative weight exceeds the draw; NULL for no items."""
    if not items:
        return F.lit(None)
    expr = F
    for item, bound in zip(items[:-1], cumulative(weights)):
        expr = expr.when(draw < bound, F.lit(item))
    return F.lit(items[0]) if expr is F else expr.otherwise(F.lit(items[-1]))


def choice(items: Sequence, draw: Column) -> Column:
    """Uniform choice from a fixed list."""
    return F.element_at(literal_array(list(items)), (F.floor(draw * len(items)) + 1).cast("int"))


def weighted_choice_by_row(items: Column, weights: Column, draw: Column) -> Column:
    """Weighted choice where each row has its own items and weights arrays."""
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    found = F.aggregate(
        weights,
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("seen")),
        lambda acc, w: F.struct(
            (acc["sum"] + w).alias("sum"),
            (acc["seen"] + F.when(acc["sum"] + w <= draw * total, 1).otherwise(0)).alias("seen"),
        ),
        lambda acc: acc["seen"],
    )
    return F.element_at(items, F.least(found + 1, F.size(items)).cast("int"))


def poisson(rate: Column, cap: int, draw: Column) -> Column:
    """Inverse-CDF Poisson, values above cap reported as cap."""
    term, below, expr = F.exp(-rate), F.lit(0.0), F
    for k in range(cap):
        below = below + term
        expr = expr.when(draw <= below, F.lit(k))
        term = term * rate / (k + 1)
    return expr.otherwise(F.lit(cap)).cast("int")


def weighted_sample(items: Column, weights: Column, k: Column, stream: str, *keys: Column | str) -> Column:
    """k distinct items without replacement: smallest exponential keys -ln(1-u)/w win. Arrays are per-row and short."""
    keyed = F.zip_with(
        items, weights, lambda item, w: F.struct((-F.ln(1 - u(stream, *keys, item)) / w).alias("rank"), item.alias("item"))
    )
    return F.transform(F.slice(F.sort_array(keyed), 1, k.cast("int")), lambda s: s["item"])


def gate(p, draw: Column) -> Column:
    """True with probability p; a NULL probability is false."""
    return F.coalesce(draw < _col(p), F.lit(False))


def sample_indexes(k: Column, n: Column, slots: int, stream: str, *keys: Column | str) -> Column:
    """k distinct positions out of 1..n (k <= slots, k <= n) by Floyd's method: work grows with k, not with n."""
    draws = F.array(*[F.struct(F.lit(i + 1).alias("i"), u(f"{stream}{i}", *keys).alias("u")) for i in range(slots)])

    def step(chosen: Column, s: Column) -> Column:
        top = n - k + s["i"]
        draw = (1 + F.floor(top * s["u"])).cast("long")
        return F.concat(chosen, F.array(F.when(F.array_contains(chosen, draw), top.cast("long")).otherwise(draw)))

    return F.aggregate(F.slice(draws, F.lit(1), k.cast("int")), F.array().cast("array<bigint>"), step)


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
