"""Exact quantiles without gathering a column in one task.

`percentile` keeps every distinct value of a group in one aggregation buffer.
That is fine for a bootstrap distribution, not for a raw column of a large log.
Here values are counted per distinct value, split into ranges, and only the range
totals (bounded by `ranges`) are ordered per group; the values inside a range are
ranked by a window over that range alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of an ungrouped aggregate, which always has exactly one row."""
    return df.join(F.broadcast(one_row))


def cumulative_counts(counts: DataFrame, value: str, count: str, by: Sequence[str] = (), ranges: int = 64) -> DataFrame:
    """`counts` (one row per value and group) with `below` (count of smaller values) and `total` of the group.

    Values are split into ranges at the edges of a quantile sketch over them, so that ranges hold about as many values
    each, however they are spread; only range totals are ordered per group.  The edges decide the split
    alone: results are exact.
    """
    by = list(by)
    shares = [i / ranges for i in range(1, ranges)]
    edges = (counts.groupBy(*by) if by else counts).agg(F.percentile_approx(value, shares, 10_000).alias("_edges"))
    joined = counts.join(edges, by) if by else with_row(counts, edges)
    placed = joined.withColumn("_b", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
    totals = placed.groupBy(*by, "_b").agg(F.sum(count).alias("_t"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"), F.sum("_t").over(Window.partitionBy(*by)).alias("total"))
    inside = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_own", F.sum(count).over(inside) - F.col(count))
    return summed.join(offsets, [*by, "_b"]).withColumn("below", F.col("_before") + F.col("_own")).drop("_b", "_own", "_before")


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """One row per group: `n` and `q` = linearly interpolated quantiles, in the order of `probs`."""
    by = list(by)
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    ranked = cumulative_counts(counts, "v", "c", by).withColumnRenamed("total", "n")
    exprs = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(float(p))
        for name, rank in (("l", F.floor(h)), ("h", F.ceil(h))):
            exprs.append(F.max(F.when((F.col("below") <= rank) & (F.col("below") + F.col("c") > rank), F.col("v"))).alias(f"{name}{i}"))
    picked = ranked.groupBy(*by).agg(F.max("n").alias("n"), *exprs)
    q = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(float(p))
        q.append(F.col(f"l{i}") + (h - F.floor(h)) * (F.col(f"h{i}") - F.col(f"l{i}")))
    return picked.select(*by, "n", F.array(*q).alias("q"))
