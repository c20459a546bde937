"""Column builders shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut(value: Column, edges: Sequence[float], labels: Sequence) -> Column:
    """Right-closed bins ``(edge[i], edge[i+1]] -> labels[i]``; null outside."""
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        inside = value > lo
        if not math.isinf(hi):
            inside = inside & (value <= hi)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def safe_div(a: Column, b: Column) -> Column:
    """Null instead of an error or infinity for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def finite_or_zero(value: Column) -> Column:
    """Null, NaN and infinities become 0."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(value)


def uniform(seed: str, *parts: Column) -> Column:
    """Repeatable uniform number in [0, 1) from a seed and the row's identity."""
    text = F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def pick(u: Column, choices: Sequence[str]) -> Column:
    """Equal-weight choice by a uniform number."""
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (F.floor(u * len(choices)) + 1).cast("int"))


def weighted_pick(u: Column, weights: dict[str, float]) -> Column:
    """Weighted choice by a uniform number; the last choice takes the rounding rest."""
    out, acc = None, 0.0
    names = list(weights)
    for name in names[:-1]:
        acc = round(acc + weights[name], 10)
        out = F.when(u < acc, name) if out is None else out.when(u < acc, name)
    return out.otherwise(names[-1])


def strip_number(value: Column) -> Column:
    """Number from text after removing thousands commas, dollar and percent signs."""
    return F.regexp_replace(value, "[,$%]", "").try_cast("double")


def age_label(then: Column, now: Column) -> Column:
    """``3d ago`` / ``5h ago`` / ``12m ago``; hours need more than one hour."""
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))
    days = F.floor(seconds / 86400)
    rest = seconds - days * 86400
    return (
        F.when(days > 0, F.concat(days.cast("string"), F.lit("d ago")))
        .when(rest > 3600, F.concat(F.floor(rest / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(rest / 60).cast("string"), F.lit("m ago")))
    )
