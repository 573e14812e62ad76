"""Deterministic draws from SHA-256, independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: str, *ids: Column, sep: str = ":") -> Column:
    return F.sha2(F.concat_ws(sep, F.lit(seed), *[i.cast("string") for i in ids]), 256)


def uniform(hex_digest: Column, start: int = 1) -> Column:
    """52-bit uniform in [0, 1): exact in a double."""
    return F.conv(F.substring(hex_digest, start, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mod5(hex_digest: Column) -> Column:
    """Whole 256-bit value modulo 5: 16 is 1 modulo 5, so the residue is the digit sum."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.substring(hex_digest, i, F.lit(1)), 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda acc, d: acc + d) % 5
