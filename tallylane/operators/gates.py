"""Checks that return a DataFrame of counts or violations; the caller decides whether to stop."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylane.functions.quantiles import with_row

c = F.col


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("count")).where("count > 1")


def ingest_census(df: DataFrame, key: Sequence[str], checks: Mapping[str, Column]) -> DataFrame:
    """Rows, null keys, duplicate keys and one count per named check."""
    null_key = F.exists(F.array(*[c(k).isNull() for k in key]), lambda x: x)
    counts = df.agg(F.count("*").alias("rows"), F.count_if(null_key).alias("null_key"), *[F.count_if(F.coalesce(e, F.lit(True))).alias(n) for n, e in checks.items()])
    dup = duplicate_keys(df, key).agg(F.count("*").alias("duplicate_keys"))
    return with_row(counts, dup)


def key_partition(a: DataFrame, b: DataFrame, whole: DataFrame) -> DataFrame:
    """Set relations of key sets: is A and B a partition of C, and how far from it."""
    def n(df, name):
        return df.agg(F.count("*").alias(name))

    a, b, whole = a.distinct(), b.distinct(), whole.distinct()
    out = n(a.intersect(b), "overlap")
    for df, name in ((a.union(b).subtract(whole), "outside"), (whole.subtract(a.union(b)), "missing"), (a.subtract(whole), "a_not_in_whole")):
        out = with_row(out, n(df, name))
    return out.withColumn("is_partition", (c("overlap") == 0) & (c("outside") == 0) & (c("missing") == 0))
