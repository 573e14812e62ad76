"""Deterministic samples, panels and perturbations driven by SHA-256 order."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylane.functions import hashing
from tallylane.functions.quantiles import exact_quantiles, with_row
from tallylane.keys import LogKeys
from tallylane.operators.boot import digest_rank

c = F.col


def hash_holdout(ids: DataFrame, id_col: str, namespace: str) -> DataFrame:
    """Hold out the ids whose digest is 0 modulo 5."""
    return ids.select(id_col).distinct().withColumn("held_out", hashing.mod5(hashing.digest(namespace, c(id_col))) == 0)


def nested_samples(clusters: DataFrame, cluster: str, stratum: Sequence[str], seed: str, fractions: Sequence[float]) -> DataFrame:
    """Nested whole-cluster samples: the first ceil(N * fraction) clusters in order of (rank + 1/2) / n of their stratum.

    Ranks inside a stratum follow the digest; one cut over all clusters keeps the strata's shares and the total
    exact.  Ties between strata go by stratum, then cluster.  The order over all is taken in ranges of the
    fraction (at most 4096), whose totals are summed before, so that no window holds all clusters.
    """
    out = digest_rank(clusters, hashing.digest(seed, c(cluster)), stratum).withColumn("_at", (c("_i") + 0.5) / c("_g")).withColumn("_b", F.floor(c("_at") * 4096))
    w = Window.orderBy("_b")
    starts = out.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", (F.sum("_n").over(w) - c("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    placed = out.join(F.broadcast(starts), "_b").withColumn("_p", c("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_at", *stratum, cluster)))
    flags = {f"in_{round(f * 100)}": c("_p") <= F.ceil(c("_all") * f) for f in fractions}
    return placed.withColumns(flags).drop("_i", "_g", "_at", "_b", "_before", "_all", "_p")


def stratified_panel(train: DataFrame, keys: LogKeys, starter: str, per_cell: int, seed: str) -> DataFrame:
    """Actors with role, hand and volume band; up to `per_cell` per cell by digest order are selected."""
    a = train.groupBy(keys.actor).agg(
        F.count("*").alias("events"), F.count_if(c(keys.actor) == c(starter)).alias("_s"), F.min("p_throws").alias("_h0"), F.max("p_throws").alias("_h1"))
    cuts = exact_quantiles(a, "events", [0.25, 0.75]).select(c("q")[0].alias("_lo"), c("q")[1].alias("_hi"))
    a = with_row(a, cuts).select(
        keys.actor, "events", F.when(c("_s") * 2 >= c("events"), "starter").otherwise("relief").alias("role"), F.when(c("_h0") == c("_h1"), c("_h0")).otherwise("unknown").alias("hand"),
        F.when(c("events") <= c("_lo"), "low").when(c("events") <= c("_hi"), "middle").otherwise("high").alias("volume"))
    out = digest_rank(a, hashing.digest(seed, c(keys.actor), sep="|"), ["role", "hand", "volume"])
    return out.withColumn("cell_rank", c("_i") + 1).drop("_i", "_g").withColumn("selected", (c("cell_rank") <= per_cell) & (c("hand") != "unknown"))


def interleaved_requests(requests: DataFrame, role: str, id_cols: Sequence[str], seed: str, per_role: int) -> DataFrame:
    """Digest order inside each role; the first `per_role` of every role are selected and alternate by rank."""
    out = digest_rank(requests, hashing.digest(seed, *[c(x) for x in id_cols], sep="|"), [role])
    return out.withColumn("role_rank", c("_i") + 1).withColumn("selected", c("role_rank") <= per_role).drop("_i", "_g")


def exclusion_regimes(log: DataFrame, keys: LogKeys, held: DataFrame, entity: str, prefix: int) -> DataFrame:
    """Fit / prefix / evaluation flags when some entities are held out: their whole episodes leave the fit,
    their first `prefix` clusters are the prefix, later dates are evaluated."""
    mark = log.join(held.select(entity).distinct().withColumn("_held", F.lit(True)), entity, "left").withColumn("_held", F.coalesce("_held", F.lit(False)))
    appear = mark.where("_held").select(entity, keys.date, keys.cluster).distinct()
    order = Window.partitionBy(entity).orderBy(keys.date, keys.cluster)
    appear = appear.withColumn("_k", F.row_number().over(order))
    last = appear.where(c("_k") <= prefix).groupBy(entity).agg(F.max(keys.date).alias("_pd"))
    out = mark.withColumn("_ep", F.max("_held").over(keys.whole_episode())).join(appear.select(entity, keys.cluster, "_k"), [entity, keys.cluster], "left").join(last, entity, "left")
    return out.withColumns({
        "fit": ~c("_ep"), "prefix": F.coalesce(c("_held") & (c("_k") <= prefix), F.lit(False)),
        "evaluate": F.coalesce(c("_held") & (c("_k") > prefix) & (c(keys.date) > c("_pd")), F.lit(False))}).drop("_held", "_ep", "_k", "_pd")


def midpoint_uniform(*parts: Column, seed: str, domain: str) -> Column:
    """52-bit midpoint uniform: never exactly 0 or 1."""
    return hashing.uniform(hashing.digest(f"{seed}|{domain}", *parts, sep="|")) + F.lit(0.5 / (1 << 52))


def normal(*parts: Column, seed: str, domain: str) -> Column:
    """Standard normal by Box-Muller from two digests."""
    u, v = midpoint_uniform(*parts, seed=seed, domain=domain + ":u"), midpoint_uniform(*parts, seed=seed, domain=domain + ":v")
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def stress(log: DataFrame, keys: LogKeys, code: str, measure: str, n: int, seed: str, sigma: float) -> DataFrame:
    """Per event the last n codes under truncation, dropout and masking, and a noisy mean of the measure.

    Dropout and noise belong to the historical event's key, so every window sees the same
    perturbation.
    """
    key = [c(k) for k in keys.event]
    x = log.withColumns({"_u": midpoint_uniform(*key, seed=seed, domain="missing"), "_z": c(measure) + sigma * normal(*key, seed=seed, domain=measure)})
    w = keys.in_episode().rowsBetween(-n, -1)
    h = F.collect_list(F.struct(F.coalesce(code, F.lit("NA")).alias("code"), c("_u").alias("u"), c("_z").alias("z"))).over(w)
    x = x.withColumn("_h", h)

    def codes(arr):
        return F.array_join(F.transform(arr, lambda t: t["code"]), ",")

    return x.select(
        *keys.event, codes(c("_h")).alias("full"), codes(F.slice("_h", F.greatest(F.size("_h") - 1, F.lit(1)), 2)).alias("last2"),
        codes(F.filter("_h", lambda t: t["u"] >= 0.2)).alias("mask20"), codes(F.filter("_h", lambda t: t["u"] >= 0.5)).alias("mask50"),
        F.array_join(F.transform("_h", lambda t: F.lit("UNKNOWN")), ",").alias("masked_identity"),
        F.aggregate(F.filter("_h", lambda t: t["z"].isNotNull()), F.lit(0.0), lambda a, t: a + t["z"]).alias("noisy_sum"))


def draw_pool(df: DataFrame, tiers: Sequence[tuple[Sequence[str], int]], id_cols: Sequence[str], k: int, seed: str) -> DataFrame:
    """k draws per group in digest order, for every tier whose groups reach the minimum size."""
    out = None
    for i, (by, minimum) in enumerate(tiers):
        w = Window.partitionBy(*by).orderBy(hashing.digest(seed, *[c(x) for x in id_cols]), *id_cols)
        big = df.groupBy(*by).agg(F.count("*").alias("_n")).where(c("_n") >= minimum).select(*by)
        part = df.withColumn("draw", F.row_number().over(w)).where(c("draw") <= k).join(big, list(by), "left_semi").withColumn("tier", F.lit(i))
        part = part.select("tier", F.concat_ws("|", *[c(b).cast("string") for b in by]).alias("group"), "draw", *id_cols)
        out = part if out is None else out.unionByName(part)
    return out


def first_cluster(log: DataFrame, keys: LogKeys) -> DataFrame:
    """Every actor's first cluster, all columns."""
    first = log.groupBy(keys.actor).agg(F.min(F.struct(keys.date, keys.cluster)).alias("_f")).select(keys.actor, c("_f")[keys.cluster].alias(keys.cluster))
    return log.join(first, [keys.actor, keys.cluster], "left_semi")


def fraction_sample(clusters: DataFrame, cluster: str, seed: str, fraction: float) -> DataFrame:
    return clusters.withColumn("sampled", hashing.uniform(hashing.digest(seed, c(cluster))) < fraction)


def team_coverage(sampled: DataFrame, cluster: str, teams: Sequence[str], minimum: int) -> DataFrame:
    """Sampled clusters per team, with a gate."""
    t = sampled.withColumn("team", F.explode(F.array(*teams)))
    return t.groupBy("team").agg(F.countDistinct(F.when(c("sampled"), c(cluster))).alias("sampled_clusters"), F.countDistinct(cluster).alias("clusters")).withColumn("covered", c("sampled_clusters") >= minimum)
