"""Off-policy evaluation from logged actions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylane.functions.quantiles import with_row
from tallylane.keys import LogKeys
from tallylane.operators import boot
from tallylane.operators.ordered import cumulative_ratio

c = F.col


def logged_ratios(log: DataFrame, table: DataFrame, by: Sequence[str], clip: float | None, action: str = "action_id") -> DataFrame:
    """pi_e / pi_b of the logged action (1 where no decision was made); `table` holds pe, pb, q per action."""
    out = log.join(table, [*by, action], "left")
    has = (c(action) >= 0) & c("pb").isNotNull() & c("pe").isNotNull()
    rho = c("pe") / F.greatest(c("pb"), F.lit(1e-12))
    if clip is not None:
        rho = F.least(rho, F.lit(float(clip)))
    return out.withColumns({"has": has, "rho": F.when(has, rho).otherwise(1.0)})


def episode_weights(rows: DataFrame, keys: LogKeys, subset: Column) -> DataFrame:
    """Product, sum and subset sum of the ratios per episode, with decision and zero counts."""
    dec = F.when(c("has"), c("rho")).otherwise(0.0)
    zero = F.max(F.when(c("rho") == 0, 1).otherwise(0))
    prod = F.when(zero == 1, 0.0).otherwise(F.exp(F.sum(F.log(F.when(c("rho") > 0, c("rho"))))))
    return rows.groupBy(*keys.episode_key).agg(
        prod.alias("w_product"), F.sum(dec).alias("w_sum"), F.sum(F.when(subset, dec).otherwise(0.0)).alias("w_subset"),
        F.count_if("has").alias("n_decisions"), F.count_if(c("has") & subset).alias("n_subset"), F.count_if(c("has") & (c("rho") == 0)).alias("n_zero"))


def weighted_estimates(ep: DataFrame, weight: str, reward: str) -> DataFrame:
    """IPS, self-normalised IPS, effective sample size and weight diagnostics."""
    w, r = c(weight), c(reward)
    sw, s2, n = F.sum(w), F.sum(w * w), F.count("*")
    return ep.agg(
        F.avg(w * r).alias("ips"), F.when(sw > 0, F.sum(w * r) / sw).alias("snips"), F.when(sw > 0, sw * sw / s2).otherwise(0.0).alias("ess"),
        F.when(sw > 0, sw * sw / s2 / n).otherwise(0.0).alias("ess_frac"), F.max(w).alias("w_max"), F.avg(w).alias("w_mean"), n.alias("n_episodes"), F.avg((w == 0).cast("double")).alias("frac_zero"))


def onestep_terms(rows: DataFrame, keys: LogKeys) -> DataFrame:
    """Per episode: sum rho, sum rho * q, sum v, decisions.  Rows carry q (logged action) and v (state)."""
    def s(x):
        return F.sum(F.when(c("has"), x).otherwise(0.0))

    return rows.groupBy(*keys.episode_key).agg(s(c("rho")).alias("sum_rho"), s(c("rho") * c("q")).alias("sum_rho_q"), s(c("v")).alias("sum_v"), F.count_if("has").cast("double").alias("n_dec"))


def dr1_parts(terms: DataFrame, reward: str) -> DataFrame:
    return terms.withColumns({"a": c("sum_rho") * c(reward) - c("sum_rho_q"), "b": c("sum_rho"), "d": c("sum_v"), "n": c("n_dec")})


def dr1_value() -> Column:
    return F.when(c("b") > 0, c("a") / c("b")) + F.when(c("n") > 0, c("d") / c("n"))


def dr1_estimate(parts: DataFrame) -> DataFrame:
    s = parts.agg(*[F.sum(x).alias(x) for x in "abdn"])
    return s.select(F.when(c("n") > 0, (c("a") + c("d")) / c("n")).alias("plain"), dr1_value().alias("dr1"), F.when(c("n") > 0, c("d") / c("n")).alias("direct"), F.when(c("b") > 0, c("a") / c("b")).alias("correction"))


def trajectory_terms(rows: DataFrame, keys: LogKeys) -> DataFrame:
    """Trajectory doubly-robust terms per episode: value = base + w_last * reward, plain and weighted.

    The weighted form divides the cumulative ratio by its mean over all episodes that
    reached the step (one small table per step).
    """
    w = keys.in_episode()
    x = cumulative_ratio(rows, keys, "rho", "_cum").withColumns({
        "_t": F.row_number().over(w), "_vn": F.coalesce(F.lead("v").over(w), F.lit(0.0)), "_last": F.lead("v").over(w).isNull()})
    norm = x.groupBy("_t").agg(F.avg("_cum").alias("_norm"))
    x = x.join(F.broadcast(norm), "_t").withColumns({
        "_wdr": F.when(c("_norm") > 0, c("_cum") / c("_norm")).otherwise(0.0), "_step": c("_vn") - F.when(c("has"), c("q")).otherwise(c("v"))})
    first = F.sum(F.when(c("_t") == 1, c("v")).otherwise(0.0))
    return x.groupBy(*keys.episode_key).agg(
        (first + F.sum(c("_cum") * c("_step"))).alias("base_plain"), (first + F.sum(c("_wdr") * c("_step"))).alias("base_wdr"),
        F.sum(F.when(c("_last"), c("_cum")).otherwise(0.0)).alias("w_last"), F.sum(F.when(c("_last"), c("_wdr")).otherwise(0.0)).alias("w_last_wdr"))


def ratio_bootstrap(ep: DataFrame, cluster: str, parts: dict[str, Column], estimate: Column, draws: int, seed: str, by: Sequence[str] = ()) -> DataFrame:
    """Point estimate and cluster interval of any function of per-cluster sums."""
    sums = boot.cluster_sums(ep, cluster, parts, by)
    point = sums.groupBy(*by).agg(*[F.sum(x).alias(x) for x in parts], F.count("*").alias("clusters")).select(*by, estimate.alias("estimate"), "clusters")
    ci = boot.interval(boot.bootstrap(sums, cluster, list(parts), draws, seed, by), estimate, by)
    return point.join(ci, list(by)) if by else with_row(point, ci)


def bounds_layer(rows: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Mean lower / upper bounds, population share, and the smaller effective sample size per stratum."""
    cols = list(dict.fromkeys(x for s in sets for x in s))

    def ess(w):
        x = F.when(c("complete"), c(w))
        return F.sum(x) * F.sum(x) / F.sum(x * x)

    return rows.groupingSets([list(s) for s in sets], *cols).agg(
        F.count("*").alias("episodes"), F.avg("lower").alias("lower"), F.avg("upper").alias("upper"), F.avg(c("in_population").cast("double")).alias("share"),
        F.count_if("complete").alias("n_complete"), F.least(ess("w_candidate"), ess("w_reference")).alias("min_ess"))


def bounds_bootstrap(rows: DataFrame, cluster: str, draws: int, seed: str, max_invalid: float, min_clusters: int, min_episodes: int) -> DataFrame:
    """Cluster interval of both bound endpoints and of the mean over complete episodes; the latter is
    null when too many replicates hold no complete episode, all are null below the minimum size."""
    one = F.lit(1.0)
    sums = boot.cluster_sums(rows, cluster, {"lo": c("lower"), "hi": c("upper"), "n": one, "dc": F.when(c("complete"), c("delta")).otherwise(0.0), "nc": F.when(c("complete"), one).otherwise(0.0)})
    size = sums.agg(F.count("*").alias("clusters"), F.sum("n").cast("bigint").alias("episodes"))
    rep = boot.bootstrap(sums, cluster, ["lo", "hi", "n", "dc", "nc"], draws, seed)
    two = F.array(F.lit(0.025), F.lit(0.975))
    stats = rep.agg(F.percentile(c("lo") / c("n"), two).alias("_l"), F.percentile(c("hi") / c("n"), two).alias("_h"), F.percentile(F.when(c("nc") > 0, c("dc") / c("nc")), two).alias("_d"), F.count_if(c("nc") == 0).alias("invalid"))
    ok = (c("clusters") >= min_clusters) & (c("episodes") >= min_episodes)
    fine = ok & (c("invalid") / draws <= max_invalid)
    return with_row(size, stats).select(
        "clusters", "episodes", "invalid", F.when(ok, c("_l")[0]).alias("lower_low"), F.when(ok, c("_l")[1]).alias("lower_high"), F.when(ok, c("_h")[0]).alias("upper_low"),
        F.when(ok, c("_h")[1]).alias("upper_high"), F.when(fine, c("_d")[0]).alias("mean_low"), F.when(fine, c("_d")[1]).alias("mean_high"))


def after_first_violation(ep: DataFrame, actor: str, order: Sequence[str], violated: str) -> DataFrame:
    """Flag episodes strictly after the actor's first violating episode (order compared lexicographically)."""
    first = ep.where(violated).groupBy(actor).agg(F.min(F.struct(*order)).alias("_first"))
    return ep.join(first, actor, "left").withColumn("after_violation", F.coalesce(c("_first") < F.struct(*order), F.lit(False))).drop("_first")


def action_ranks(table: DataFrame, logged: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rank and gap (points) of the logged type among the supported actions; unsupported stays null."""
    w = Window.partitionBy(*by)
    ranked = table.withColumns({"_r": F.row_number().over(w.orderBy(c("q").desc(), "action_id")), "_top": F.max("q").over(w)})
    kind = ranked.groupBy(*by, "pitch_id").agg(F.min("_r").alias("best_rank"), F.max("q").alias("best_value"), F.max("_top").alias("_top"))
    kind = kind.withColumn("type_rank", F.row_number().over(w.orderBy("best_rank")))
    top = kind.where("best_rank = 1").select(*by, c("pitch_id").alias("top_type"), c("_top").alias("top_value"))
    out = logged.join(top, list(by), "left").join(kind.drop("_top"), [*by, "pitch_id"], "left")
    return out.withColumn("gap", 100 * (c("top_value") - c("best_value")))


def member_agreement(scores: DataFrame, by: Sequence[str], item: str, members: Sequence[str]) -> DataFrame:
    """Top-choice agreement and mean pairwise Spearman correlation of the members' score columns.

    Members are a few columns of the same row, so pairs are formed across columns and no
    self-join is needed.
    """
    w = Window.partitionBy(*by)
    ranks = scores.withColumns({f"_r{i}": F.rank().over(w.orderBy(m)) + (F.count("*").over(w.partitionBy(*by, m)) - 1) / 2.0 for i, m in enumerate(members)})
    tops = [F.max_by(item, F.struct(c(m), -c(item))).alias(f"_t{i}") for i, m in enumerate(members)]
    pairs = [(i, j) for i in range(len(members)) for j in range(i + 1, len(members))]
    out = ranks.groupBy(*by).agg(*tops, *[F.corr(f"_r{i}", f"_r{j}").alias(f"_c{i}{j}") for i, j in pairs])
    same = [(c(f"_t{i}") == c(f"_t{j}")).cast("double") for i, j in pairs]
    rho = F.array_compact(F.array(*[F.when(~F.isnan(f"_c{i}{j}"), c(f"_c{i}{j}")) for i, j in pairs]))
    mean = F.when(F.size(rho) > 0, F.aggregate(rho, F.lit(0.0), lambda a, x: a + x) / F.size(rho))
    return out.select(*by, (sum(same[1:], same[0]) / len(pairs)).alias("pairwise_agreement"), F.forall(F.array(*[s == 1 for s in same]), lambda x: x).alias("all_agree"), mean.alias("mean_spearman"), F.size(rho).cast("bigint").alias("defined_pairs"))
