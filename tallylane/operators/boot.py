"""Cluster bootstrap of ratio estimators.

Rows are first summed per cluster, so the resampling never touches raw events.  Clusters get an index from a
digest order built in hash ranges, so no global sort runs in one task, and stand in packs of RANGE.  A draw of as many
clusters as there are is multinomial: its number is split over the packs by binomials, halving the packs level by
level, and inside a pack slot i takes cluster floor(u * size) with u a hash of (seed, pack, draw, slot).  All of it
follows from the seed, so any task makes the same draw again.  A pack gives one row of sums for each draw: there is no row
for a drawn cluster, and no group is too large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylane.functions import hashing
from tallylane.operators.lineage import materialise

c = F.col
#: Clusters of a pack, draws that a row of packed sums is asked for, and slots that are drawn together.
RANGE, BLOCK, TOGETHER = 4096, 2500, 1 << 21

# --- Fixed values: multipliers of a public 32-bit mixing function, and the odd fraction that spreads draws ---
MIX, SPREAD = (0x85EBCA6B, 0xC2B2AE35), 0x9E3779B9
# ----------------------------------------------------------------------------


def cluster_sums(df: DataFrame, cluster: str, sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """One row per (group, cluster), computed once: point estimates and resampling both read it."""
    return materialise(df.groupBy(*by, cluster).agg(*[F.sum(e).alias(n) for n, e in sums.items()]))


def digest_rank(df: DataFrame, digest: Column, by: Sequence[str] = ()) -> DataFrame:
    """Zero-based position `_i` of every row in digest order inside its group, and the group size `_g`.

    Rows are ranked inside 4096 digest ranges and shifted by the counts of earlier ranges, so
    even one huge group is spread over many tasks.
    """
    d = df.withColumn("_d", digest).withColumn("_r", F.substring("_d", 1, 3))
    ranges = d.groupBy(*by, "_r").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumns({"_off": F.coalesce(F.sum("_c").over(before), F.lit(0)), "_g": F.sum("_c").over(Window.partitionBy(*by))}).drop("_c")
    inside = Window.partitionBy(*by, "_r").orderBy("_d")
    return d.join(ranges, [*by, "_r"]).withColumn("_i", F.row_number().over(inside) - 1 + c("_off")).drop("_d", "_r", "_off")


def seed_word(seed: str) -> int:
    return int(hashlib.sha256(seed.encode()).hexdigest()[:8], 16)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(MIX[0])
    x = (x ^ (x >> np.uint32(13))) * np.uint32(MIX[1])
    return x ^ (x >> np.uint32(16))


def pack_sizes(seed: str, draws: int, clusters: int, pack: int, size: int = RANGE) -> np.ndarray:
    """How many of each draw's clusters fall into a pack; over all packs the sizes of a draw are one multinomial.

    From all packs down to the asked one, the packs are halved; a binomial gives the left half its share of what
    the draw has there.  Its generator is seeded with the half, so each pack finds the same splits.
    """
    low, high = 0, -(-clusters // size)
    n = np.full(draws, clusters, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        share = (middle - low) * size / (min(high * size, clusters) - low * size)
        left = np.random.Generator(np.random.PCG64([seed_word(seed), low, high])).binomial(n, share)
        n, low, high = (left, low, middle) if pack < middle else (n - left, middle, high)
    return n


def drawn_sums(values: np.ndarray, sizes: np.ndarray, draws: np.ndarray, seed: str, pack: int) -> np.ndarray:
    """Sums over `sizes[i]` clusters of a pack (rows of `values`), drawn with replacement for each of `draws`."""
    m, out = len(values), np.empty((len(draws), values.shape[1]))
    salt = mix(np.array([seed_word(seed) + pack & 0xFFFFFFFF], np.uint32))
    slots = mix(np.arange(int(sizes.max(initial=0)), dtype=np.uint32) ^ salt)
    step = max(1, TOGETHER // max(1, len(slots)))
    for low in range(0, len(draws), step):
        own, n = draws[low : low + step], sizes[low : low + step]
        shift = (own.astype(np.uint64) * np.uint64(SPREAD)).astype(np.uint32)
        u = mix(slots[None, :] + shift[:, None]) / 4294967296.0
        cell = np.arange(len(own))[:, None] * m + (u * m).astype(np.int64)
        inside = np.arange(len(slots))[None, :] < n[:, None]
        out[low : low + step] = np.bincount(cell[inside], minlength=len(own) * m).reshape(len(own), m) @ values
    return out


def bootstrap(sums: DataFrame, cluster: str, columns: Sequence[str], draws: int, seed: str, by: Sequence[str] = (), size: int = RANGE) -> DataFrame:
    """Resampled column sums per group and draw, plus `n_clusters`.  `sums` has one row per (group, cluster); a missing sum adds nothing."""
    by = list(by)
    indexed = digest_rank(sums, hashing.digest(seed, c(cluster)), by).withColumn("_pack", F.floor(c("_i") / size))
    rows = F.array_sort(F.collect_list(F.struct("_i", *[F.coalesce(c(x).cast("double"), F.lit(0.0)).alias(x) for x in columns])))
    packs = indexed.groupBy(*by, "_pack").agg(rows.alias("_rows"), F.max("_g").alias("_g"))
    asked = packs.select(*by, "_pack", "_g", *[c("_rows").getField(x).alias(x) for x in columns])
    asked = asked.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(BLOCK)))).repartition(*by, "_pack", "_first")
    k = len(by)

    def draw(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in range(batch.num_rows):
                pack, g, first = (batch.column(i)[row].as_py() for i in (k, k + 1, batch.num_columns - 1))
                values = np.stack([batch.column(i)[row].values.to_numpy(zero_copy_only=False) for i in range(k + 2, k + 2 + len(columns))], axis=1)
                own = np.arange(first, min(first + BLOCK, draws))
                found = drawn_sums(values, pack_sizes(seed, draws, g, pack, size)[own], own, seed, pack)
                groups = [batch.column(i).slice(row, 1).take(pa.array(np.zeros(len(own), np.int64))) for i in range(k)]
                yield pa.RecordBatch.from_arrays([*groups, pa.array(own.astype(np.int32)), *[pa.array(x) for x in found.T], pa.array(np.full(len(own), g))], names=[*by, "draw", *columns, "n_clusters"])

    fields = "".join(f"`{x}` {indexed.schema[x].dataType.simpleString()}, " for x in by) + "draw int, " + "".join(f"`{x}` double, " for x in columns)
    found = asked.mapInArrow(draw, f"{fields}n_clusters long")
    return found.groupBy(*by, "draw").agg(*[F.sum(x).alias(x) for x in columns], F.max("n_clusters").alias("n_clusters"))


def interval(replicates: DataFrame, estimate: Column, by: Sequence[str] = (), probs: Sequence[float] = (0.025, 0.975)) -> DataFrame:
    """Percentile interval and spread of an estimate over the draws (null estimates are left out)."""
    g = replicates.withColumn("_e", estimate).groupBy(*by)
    q = F.percentile("_e", F.array(*[F.lit(float(p)) for p in probs]))
    return g.agg(q[0].alias("ci_low"), q[len(probs) - 1].alias("ci_high"), F.stddev_pop("_e").alias("boot_sd"), F.count("_e").alias("valid_draws"))


def ratio(num: str, den: str) -> Column:
    return F.when(c(den) > 0, c(num) / c(den))
