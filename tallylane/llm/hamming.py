"""Exact top-k over binary codes by multi-index hashing with growing radii."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylane.llm.shared import materialise

BITS = 64
#: Distinct codes of one shard, and queries that meet a shard in one task.
SHARD, BLOCK = 1 << 17, 1 << 13


def sign_code(vector: str | Column, bits: int = BITS) -> Column:
    """Signs of the first 64 components, the first one as the lowest bit; a missing or null component counts as not positive."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    bit = lambda i: F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    code = bit(0)
    for i in range(1, bits):
        code = code.bitwiseOR(bit(i))
    return code


@lru_cache(64)
def _masks(width: int, radius: int) -> np.ndarray:
    """All words of `width` bits with `radius` ones."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)


class Index:
    """Codes cut into equal segments; for each segment, the codes in order of that segment's value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.n_segments = max(1, min(8, round(BITS / max(1.0, np.log2(max(2, len(codes)))))))
        edges = np.linspace(0, BITS, self.n_segments + 1).astype(int)
        self.cuts = [(int(a), int(b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.orders, self.values = [], []
        for low, width in self.cuts:
            value = ((codes >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            self.orders.append(order)
            self.values.append(value[order])

    def within(self, segment: int, value: int, radius: int) -> np.ndarray:
        """Positions of codes whose segment differs from `value` in exactly `radius` bits."""
        probes = value ^ _masks(self.cuts[segment][1], radius)
        low = np.searchsorted(self.values[segment], probes)
        high = np.searchsorted(self.values[segment], probes, side="right")
        some = high > low
        low, count = low[some], (high - low)[some]
        ends = np.cumsum(count)
        return self.orders[segment][np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count - low, count)]

    def nearest(self, query: np.uint64, enough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of all codes up to the distance at which k rows are reached.

        `enough[i]` rows share code i.  One segment after another is searched at the next radius.  When
        `done` segments have been searched at radius r and the others at r - 1, a code not met differs in
        more than r bits in each of the former and in r or more in each of the latter: every code up to
        done + segments * r - 1 bits has been verified, and the search ends when k rows lie within that.
        """
        met = np.zeros(len(self.codes), bool)
        positions, distances = np.zeros(0, np.int64), np.zeros(0, np.int64)
        radius = 0
        while True:
            for segment, (low, width) in enumerate(self.cuts):
                if radius <= width:
                    value = int((query >> np.uint64(low)) & np.uint64((1 << width) - 1))
                    new = self.within(segment, value, radius)
                    new = np.unique(new[~met[new]])
                    met[new] = True
                    positions = np.concatenate([positions, new])
                    distances = np.concatenate([distances, np.bitwise_count(self.codes[new] ^ query).astype(np.int64)])
                covered = segment + self.n_segments * radius
                near = distances <= covered
                if covered >= BITS or enough[positions[near]].sum() >= k:
                    order = np.argsort(distances[near], kind="stable")
                    positions, distances = positions[near][order], distances[near][order]
                    reach = np.cumsum(enough[positions])
                    last = distances[min(int(np.searchsorted(reach, k)), len(reach) - 1)] if len(reach) else 0
                    own = distances <= last
                    return positions[own], distances[own]
            radius += 1


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "id", code: str = "code", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Columns query, rank, neighbour, distance: the k rows nearest to each query, by Hamming distance, then key.

    Rows with one code are folded into one point that keeps its k smallest keys, as no more can be among
    the k nearest: copies of any number are one point, and nothing is lost.  Points are dealt to shards at random, queries
    to blocks; a task holds one shard's index and one block of queries, and sends on at most k neighbours
    for each of them.  Keys are whole numbers and not null; a null code stands for no row and no query.
    A query that is a row itself finds itself.  With fewer than k rows, all are returned.
    """
    points = rows.where(F.col(code).isNotNull() & F.col(key).isNotNull()).select(F.col(code).alias("code"), F.col(key).cast("long").alias("key"))
    # the k smallest keys of a code, without gathering the others: first within pieces of a code's rows
    piece = points.groupBy("code", F.pmod(F.xxhash64("key"), F.lit(64)).alias("piece"), "key").count().drop("count")
    ranked = piece.withColumn("r", F.row_number().over(Window.partitionBy("code", "piece").orderBy("key"))).where(F.col("r") <= k)
    folded = materialise(ranked.groupBy("code").agg(F.slice(F.sort_array(F.collect_list("key")), 1, k).alias("keys")))
    asked = materialise(queries.where(F.col(code).isNotNull() & F.col(key).isNotNull()).select(F.col(code).alias("code"), F.col(key).cast("long").alias("query")).distinct())
    n_shards, n_blocks = (int(-(-max(1, df.count()) // size)) for df, size in ((folded, shard), (asked, block)))
    left = folded.select(F.pmod(F.xxhash64("code"), F.lit(n_shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "code", "keys")
    right = asked.select(F.pmod(F.xxhash64("query"), F.lit(n_blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard"), "code", "query")

    def search(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(points) and len(asked):
            index = Index(points["code"].to_numpy().view(np.uint64))
            keys = points["keys"].to_numpy()
            enough = np.array([len(x) for x in keys])
            for query, own in zip(asked["query"].tolist(), asked["code"].to_numpy().view(np.uint64), strict=True):
                at, distance = index.nearest(own, enough, k)
                pairs = sorted((int(d), int(i)) for p, d in zip(at, distance, strict=True) for i in keys[p])[:k]
                found += [(query, d, i) for d, i in pairs]
        return pd.DataFrame(found, columns=["query", "distance", "neighbour"]).astype("int64")

    merged = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "query long, distance long, neighbour long")
    order = Window.partitionBy("query").orderBy("distance", "neighbour")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "neighbour", F.col("distance").cast("int").alias("distance"))


def digest(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select(F.col("vec_id").alias("id"), F.when(F.col("embedding").isNotNull(), sign_code("embedding")).alias("code"))
    return top_k(rows, rows.where("id % 50 = 0")).withColumnsRenamed({"query": "vec_id", "neighbour": "neighbour_id"})


SQL = """
WITH c AS (SELECT vec_id, [CASE WHEN x > 0 THEN 1 ELSE 0 END FOR x IN embedding[1:64]] AS b FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT vec_id, CAST(array_to_string(b, '') AS BIT) AS code FROM c),
d AS (SELECT q.vec_id, s.vec_id AS neighbour_id, CAST(bit_count(xor(q.code, s.code)) AS INTEGER) AS distance FROM s AS q, s WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM d)
SELECT vec_id, rank, neighbour_id, distance FROM r WHERE rank <= 10
"""
