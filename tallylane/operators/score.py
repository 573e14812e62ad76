"""Scoring of probability forecasts: losses, calibration, paired comparisons, decisions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylane.functions import probs
from tallylane.functions.quantiles import with_row
from tallylane.operators import boot

c = F.col

# --- Fixed values -----------------------------------------------------------
MIN_GROUP_CLUSTERS, MIN_GROUP_EVENTS = 30, 500
PRACTICAL_GAIN, BRIER_MARGIN = 0.003, 0.001
GUARD_NLL, GUARD_BRIER = 0.010, 0.002
# ----------------------------------------------------------------------------


def probability_gate(df: DataFrame, p: str, y: str, n_classes: int) -> DataFrame:
    """One row of violation counts; every count must be zero before scoring."""
    finite = ~F.exists(p, lambda x: x.isNull() | F.isnan(x))
    inside = ~F.exists(p, lambda x: (x < 0) | (x > 1))
    return df.agg(
        F.count("*").alias("rows"), F.count_if(F.size(p) != n_classes).alias("bad_length"), F.count_if(~finite).alias("not_finite"),
        F.count_if(~inside).alias("outside_unit"), F.count_if(F.abs(probs.total(c(p)) - 1) > 1e-6).alias("bad_mass"),
        F.count_if(c(y).isNull() | ~c(y).between(0, n_classes - 1)).alias("bad_label"))


def with_losses(df: DataFrame, p: str, y: str, suffix: str = "") -> DataFrame:
    return df.withColumns({f"nll{suffix}": probs.nll(c(p), c(y)), f"brier{suffix}": probs.brier(c(p), c(y))})


def _top_bins(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    conf = F.array_max(p)
    top = df.select(probs.argmax(c(p)).alias("_a"), c(y).alias("_y"), conf.alias("_c"), probs.ece_bin(conf, bins).alias("bin"))
    return top.groupBy("bin").agg(F.count("*").alias("n"), F.avg((c("_a") == c("_y")).cast("double")).alias("accuracy"), F.avg("_c").alias("confidence"))


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Accuracy and confidence per top-label bin, all bins present."""
    return _top_bins(df, p, y, bins).join(df.sparkSession.range(bins).withColumnRenamed("id", "bin"), "bin", "right").fillna(0, ["n"])


def class_report(df: DataFrame, p: str, y: str, n_classes: int, bins: int = 10) -> DataFrame:
    """Precision, recall, F1, rates, Brier and ECE per class from one pass over (class, bin) cells."""
    long = df.select(c(y).alias("_y"), probs.argmax(c(p)).alias("_a"), F.posexplode(p).alias("class", "_p"))
    hit = (c("_y") == c("class")).cast("double")
    cells = long.groupBy(c("class").cast("bigint").alias("class"), probs.ece_bin(c("_p"), bins).alias("_b")).agg(
        F.count("*").alias("n"), F.sum(hit).alias("pos"), F.sum("_p").alias("mass"), F.sum((c("_p") - hit) * (c("_p") - hit)).alias("sq"),
        F.count_if(c("_a") == c("class")).alias("chosen"), F.count_if((c("_a") == c("class")) & (c("_y") == c("class"))).alias("tp"))
    s = cells.groupBy("class").agg(
        F.sum("n").alias("_n"), F.sum("pos").cast("bigint").alias("support"), F.sum("chosen").alias("predicted"), F.sum("tp").alias("_tp"),
        F.sum("mass").alias("_m"), F.sum("sq").alias("_sq"), F.sum(F.abs(c("pos") - c("mass"))).alias("_e"))
    return s.select(
        "class", "support", "predicted", F.when(c("predicted") > 0, c("_tp") / c("predicted")).alias("precision"), F.when(c("support") > 0, c("_tp") / c("support")).alias("recall"),
        F.when(c("support") > 0, 2 * c("_tp") / (c("support") + c("predicted"))).alias("f1"), (c("support") / c("_n")).alias("observed_rate"),
        (c("_m") / c("_n")).alias("predicted_rate"), (c("_sq") / c("_n")).alias("brier"), (c("_e") / c("_n")).alias("ece"))


def metric_report(df: DataFrame, p: str, y: str, n_classes: int) -> DataFrame:
    """Log-loss, Brier, accuracy, macro-F1 over observed classes, ten-bin top-label ECE."""
    base = with_losses(df, p, y).agg(
        F.count("*").alias("n"), F.avg("nll").alias("log_loss"), F.avg("brier").alias("brier"), F.avg((probs.argmax(c(p)) == c(y)).cast("double")).alias("accuracy"))
    f1 = class_report(df, p, y, n_classes).agg(F.avg("f1").alias("macro_f1"))
    bins = _top_bins(df, p, y)
    ece = bins.agg((F.sum(c("n") * F.abs(c("accuracy") - c("confidence"))) / F.sum("n")).alias("ece"))
    return with_row(with_row(base, f1), ece)


def binary_report(df: DataFrame, p: str, y: str, cluster: str, bins: int = 10) -> DataFrame:
    """One row: rows, clusters, log-loss, Brier score and calibration error of a forecast of a yes or no, from one pass over bins."""
    q = F.greatest(F.least(c(p), F.lit(1 - 1e-12)), F.lit(1e-12))
    hit = c(y).cast("double")
    rows = df.select(cluster, q.alias("_q"), hit.alias("_h"), probs.ece_bin(q, bins).alias("_b"))
    cells = rows.groupBy("_b").agg(
        F.count("*").alias("n"), F.sum("_q").alias("_mass"), F.sum("_h").alias("_hits"), F.sum(-(c("_h") * F.log("_q") + (1 - c("_h")) * F.log1p(-c("_q")))).alias("_nll"), F.sum((c("_q") - c("_h")) * (c("_q") - c("_h"))).alias("_sq"))
    s = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), (F.sum("_nll") / F.sum("n")).alias("log_loss"), (F.sum("_sq") / F.sum("n")).alias("brier"), (F.sum(F.abs(c("_mass") - c("_hits"))) / F.sum("n")).alias("ece"))
    return with_row(s, rows.agg(F.count_distinct(cluster).alias("clusters")))


def outcome_calibration(df: DataFrame, columns: Sequence[str], y: str, bins: int) -> DataFrame:
    """NLL, top-1 accuracy and mean per-outcome ECE of a table joined to held-out rows (one column per outcome)."""
    arr = F.array(*columns)
    rows = df.select(c(y).alias("_y"), arr.alias("_p"))
    head = rows.agg(F.count("*").alias("n"), F.avg(probs.nll(c("_p"), c("_y"))).alias("nll"), F.avg((probs.argmax(c("_p")) == c("_y")).cast("double")).alias("top1"))
    long = rows.select("_y", F.posexplode("_p").alias("_k", "_q"))
    cells = long.groupBy("_k", probs.ece_bin(c("_q"), bins).alias("_b")).agg(F.sum("_q").alias("_s"), F.sum((c("_y") == c("_k")).cast("double")).alias("_o"), F.count("*").alias("_n"))
    per = cells.groupBy("_k").agg((F.sum(F.abs(c("_s") - c("_o"))) / F.sum("_n")).alias("_e"))
    return with_row(head, per.agg(F.avg("_e").alias("ece")))


# --- paired comparisons --------------------------------------------------------

def paired_deltas(df: DataFrame, candidate: str, control: str, y: str) -> DataFrame:
    a = with_losses(with_losses(df, candidate, y, "_a"), control, y, "_b")
    return a.withColumns({"d_nll": c("nll_a") - c("nll_b"), "d_brier": c("brier_a") - c("brier_b")}).drop("nll_a", "nll_b", "brier_a", "brier_b")


def compare(df: DataFrame, cluster: str, metrics: Mapping[str, str], draws: int, seed: str, by: Sequence[str] = (), upper: float = 0.975, two_sided: bool = False) -> DataFrame:
    """Cluster-bootstrap comparison of per-row differences, one row per group and metric.

    `p` is null-centred with the +1 correction: the share of centred replicates at or
    below the observed difference (or at least as extreme, two-sided).
    """
    by = list(by)
    sums = boot.cluster_sums(df, cluster, {**{f"s_{m}": c(col) for m, col in metrics.items()}, "n": F.lit(1.0)}, by)
    cols = [f"s_{m}" for m in metrics] + ["n"]
    observed = sums.groupBy(*by).agg(*[F.sum(x).alias(x) for x in cols], F.count("*").alias("clusters"))

    def long(frame, extra):
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), (c(f"s_{m}") / c("n")).alias("value")) for m in metrics])
        return frame.select(*by, *extra, F.explode(pairs).alias("_x")).select(*by, *extra, "_x.metric", "_x.value")

    obs = long(observed, ["clusters"]).withColumnRenamed("value", "delta").join(observed.select(*by, c("n").cast("bigint").alias("n")), by) if by else \
        with_row(long(observed, ["clusters"]).withColumnRenamed("value", "delta"), observed.select(c("n").cast("bigint").alias("n")))
    rep = long(boot.bootstrap(sums, cluster, cols, draws, seed, by), ["draw"])
    both = rep.join(obs.select(*by, "metric", "delta"), [*by, "metric"])
    centred = c("value") - c("delta")
    extreme = F.abs(centred) >= F.abs(c("delta")) if two_sided else centred <= c("delta")
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975), F.lit(float(upper))))
    stats = both.groupBy(*by, "metric").agg(q.alias("_q"), ((1 + F.count_if(extreme)) / (draws + 1)).alias("p"))
    # one cluster has no spread to resample: no interval and no p-value
    enough = c("clusters") >= 2
    found = {"ci_low": c("_q")[0], "ci_high": c("_q")[1], "upper": c("_q")[2], "p": c("p")}
    return obs.join(stats, [*by, "metric"]).select(*by, "metric", "n", "clusters", "delta", *[F.when(enough, x).alias(name) for name, x in found.items()])


def holm(df: DataFrame, p: str, family: Sequence[str] = ()) -> DataFrame:
    """Adjusted p-values per family; a null p keeps its slot in the family size."""
    w = Window.partitionBy(*family)
    ranked = w.orderBy(c(p).asc_nulls_last())
    out = df.withColumns({"_m": F.count(F.lit(1)).over(w), "_k": F.row_number().over(ranked)})
    raw = F.least((c("_m") - c("_k") + 1) * c(p), F.lit(1.0))
    run = F.max(raw).over(w.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("p_holm", F.when(c(p).isNotNull(), run)).drop("_m", "_k")


def decision(nll_delta: Column, nll_low: Column, nll_high: Column, brier_low: Column, brier_high: Column, p_holm: Column, seeds_improved: Column, required: int) -> Column:
    good = ((nll_delta <= -PRACTICAL_GAIN) & (nll_high < 0) & (p_holm <= 0.05) & (brier_high <= BRIER_MARGIN) & (seeds_improved >= required))
    return F.when(p_holm.isNull(), "unmeasured").when(good, "predictive_improvement").when((nll_low > 0) | (brier_low > BRIER_MARGIN), "worse_or_guardrail_failure").otherwise("inconclusive")


def explode_groups(df: DataFrame, groups: Mapping[str, Column]) -> DataFrame:
    """One row per group a row belongs to (a literal list of conditions, so at most that many copies)."""
    names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in groups.items()]))
    return df.withColumn("group", F.explode(names))


def guardrails(result: DataFrame) -> DataFrame:
    """Reporting gate and pass flag for a comparison by group."""
    eligible = (c("clusters") >= MIN_GROUP_CLUSTERS) & (c("n") >= MIN_GROUP_EVENTS)
    limit = F.when(c("metric") == "nll", GUARD_NLL).otherwise(GUARD_BRIER)
    return result.withColumns({"status": F.when(eligible, "reporting_eligible").otherwise("unmeasured_for_guardrail"), "passed": F.when(eligible, c("upper") <= limit)})


def interaction(df: DataFrame, cluster: str, delta: str, low: Column, high: Column, draws: int, seed: str) -> DataFrame:
    """Low minus high mean difference with a joint bootstrap of both groups."""
    sums = boot.cluster_sums(df.where(low | high), cluster, {
        "sl": F.when(low, c(delta)).otherwise(0.0), "nl": F.when(low, 1.0).otherwise(0.0), "sh": F.when(high, c(delta)).otherwise(0.0), "nh": F.when(high, 1.0).otherwise(0.0)})
    cols = ["sl", "nl", "sh", "nh"]
    est = F.when((c("nl") > 0) & (c("nh") > 0), c("sl") / c("nl") - c("sh") / c("nh"))
    ci = boot.interval(boot.bootstrap(sums, cluster, cols, draws, seed), est)
    return with_row(sums.agg(*[F.sum(x).alias(x) for x in cols]).select(est.alias("delta")), ci)


def calibration_comparison(df: DataFrame, cluster: str, candidate: str, control: str, y: str, draws: int, seed: str, bins: int = 10) -> DataFrame:
    """Difference of top-label ECE with every replicate re-binned: cluster x bin sums are resampled."""
    def side(p, tag):
        conf = F.array_max(p)
        gap = (probs.argmax(c(p)) == c(y)).cast("double") - conf
        return F.struct(F.lit(tag).alias("tag"), probs.ece_bin(conf, bins).alias("bin"), gap.alias("gap"))

    long = df.select(cluster, F.explode(F.array(side(candidate, "a"), side(control, "b"))).alias("_x")).select(cluster, "_x.*")
    cells = [F.sum(F.when((c("tag") == tag) & (c("bin") == b), c("gap")).otherwise(0.0)).alias(f"g_{tag}{b}") for tag in "ab" for b in range(bins)]
    sums = long.groupBy(cluster).agg(*cells, F.sum(F.when(c("tag") == "a", 1.0).otherwise(0.0)).alias("n"))
    names = [f"g_{tag}{b}" for tag in "ab" for b in range(bins)] + ["n"]

    def ece(tag):
        return sum((F.abs(c(f"g_{tag}{b}")) for b in range(1, bins)), F.abs(c(f"g_{tag}0"))) / c("n")

    est = ece("a") - ece("b")
    point = sums.agg(*[F.sum(x).alias(x) for x in names]).select(ece("a").alias("candidate"), ece("b").alias("control"), est.alias("delta"))
    return with_row(point, boot.interval(boot.bootstrap(sums, cluster, names, draws, seed), est))


def subgroup_decomposition(df: DataFrame, group: str, cluster: str, delta: str, draws: int, seed: str) -> DataFrame:
    """Disjoint groups whose contributions add up to the total mean difference, with an interval each."""
    sums = boot.cluster_sums(df, cluster, {"s": c(delta), "n": F.lit(1.0)}, [group])
    per = sums.groupBy(group).agg(F.sum("s").alias("_s"), F.sum("n").alias("_n"), F.count("*").alias("clusters"))
    total = per.agg(F.sum("_s").alias("_all_s"), F.sum("_n").alias("_all_n"))
    out = with_row(per, total).select(group, c("_n").cast("bigint").alias("events"), "clusters", (c("_s") / c("_n")).alias("mean_delta"), (c("_s") / c("_all_n")).alias("contribution"), (c("_all_s") / c("_all_n")).alias("total"))
    ci = boot.interval(boot.bootstrap(sums, cluster, ["s", "n"], draws, seed, [group]), boot.ratio("s", "n"), [group])
    return out.join(ci, group)
