"""Expressions over probability vectors held as array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: positions of the in-play classes among the ten outcomes.
IN_PLAY_CLASSES = (3, 4, 5, 6, 7, 9)
NLL_FLOOR = 1e-12


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)


def at(p: Column, i: Column | int) -> Column:
    """Zero-based element."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.element_at(p, (i + 1).cast("int"))


def normalise(p: Column) -> Column:
    s = total(p)
    return F.transform(p, lambda x: F.when(s > 0, x / s).otherwise(F.lit(0.0)))


def zero_class(p: Column, i: int, impossible: Column) -> Column:
    """Drop an impossible class and renormalise; null when no mass is left."""
    kept = F.transform(p, lambda x, j: F.when((j == i) & impossible, F.lit(0.0)).otherwise(x))
    s = total(kept)
    return F.when(s > 0, F.transform(kept, lambda x: F.when(impossible, x / s).otherwise(x)))


def leaves7(p10: Column, whiff: Column, ground: Column) -> Column:
    """Compose seven leaves from ten classes and two conditional heads."""
    s = sum((at(p10, i) for i in IN_PLAY_CLASSES[1:]), at(p10, IN_PLAY_CLASSES[0]))
    one = F.lit(1.0)
    return F.array(at(p10, 0), at(p10, 2), at(p10, 8), at(p10, 1) * whiff, at(p10, 1) * (one - whiff), s * ground, s * (one - ground))


def valid(p: Column, n_classes: int, tol: float = 1e-6) -> Column:
    """Finite, inside [0, 1], right length, sums to one."""
    bad = F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
    return F.coalesce((F.size(p) == n_classes) & ~bad & (F.abs(total(p) - 1) <= tol), F.lit(False))


def argmax(p: Column) -> Column:
    """Zero-based position of the largest element, the lowest index winning ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("bigint")


def nll(p: Column, y: Column) -> Column:
    return -F.log(F.greatest(at(p, y), F.lit(NLL_FLOOR)))


def brier(p: Column, y: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x * x) - 2 * at(p, y) + 1


def ece_bin(x: Column, bins: int = 10) -> Column:
    return F.least(F.floor(x * bins), F.lit(bins - 1)).cast("bigint")


def blend(p: Column, q: Column, w: Column) -> Column:
    """w * p + (1 - w) * q."""
    return F.zip_with(p, q, lambda a, b: w * a + (1 - w) * b)


def temperature(p: Column, t: Column) -> Column:
    """p^(1/t), renormalised."""
    return normalise(F.transform(p, lambda x: F.pow(F.greatest(x, F.lit(NLL_FLOOR)), 1 / t)))
