"""Features that only see strictly earlier dates, or earlier events of the same cluster.

Events are first summed per (key, date).  A whole date is then excluded by a frame
that ends one row (one date) earlier, so a hot entity costs one row per date in
the window, not one row per event.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylane.functions import codes
from tallylane.keys import PRIOR, LogKeys

c = F.col


def daily_sums(log: DataFrame, by: Sequence[str], date: str, values: Mapping[str, Column]) -> DataFrame:
    return log.groupBy(*by, date).agg(*[F.sum(v.cast("double")).alias(n) for n, v in values.items()])


def prior_dates(daily: DataFrame, by: Sequence[str], date: str, names: Sequence[str]) -> DataFrame:
    """Running sums over strictly earlier dates of the same key (0 on the first date)."""
    w = Window.partitionBy(*by).orderBy(date).rowsBetween(*PRIOR)
    return daily.withColumns({n: F.coalesce(F.sum(n).over(w), F.lit(0.0)) for n in names})


def asof_profile(queries: DataFrame, history: DataFrame, by: Sequence[str], date: str, names: Sequence[str]) -> DataFrame:
    """Latest cumulative profile strictly before each query date; null when there is none.

    Query dates and history dates are stacked and a range frame ending at day -1 picks
    the last profile, so no range join is needed.  `history` holds per-date sums.
    """
    cumulative = history.groupBy(*by, date).agg(*[F.sum(n).alias(n) for n in names]).withColumns({
        n: F.sum(n).over(Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)) for n in names})
    probes = queries.select(*by, date).distinct()
    marked = cumulative.select(*by, date, F.struct(*names).alias("_p"), F.lit(False).alias("_probe")).unionByName(
        probes.withColumn("_probe", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.unix_date(date)).rangeBetween(Window.unboundedPreceding, -1)
    found = marked.withColumn("_p", F.last("_p", ignorenulls=True).over(w)).where("_probe").select(*by, date, "_p.*")
    return queries.join(found, [*by, date], "left")


def smoothed_prior_rate(log: DataFrame, keys: LogKeys, terminal: Column, prior_n: float = 30.0, base_rate: float = 0.320, out_rate: float = 0.220) -> DataFrame:
    """Per (entity, date): prior opportunities, reach rate and strikeout rate, with pseudo-observations."""
    reach = terminal & c("events").isin("single", "double", "triple", "home_run", "walk", "intent_walk", "hit_by_pitch")
    denominator = terminal & ~c("events").isin("sac_bunt", "catcher_interf")
    values = {"pa": terminal, "on_base": reach, "den": denominator, "so": terminal & c("events").isin(*codes.K_EVENTS)}
    values = {n: F.coalesce(v, F.lit(False)).cast("int") for n, v in values.items()}
    prior = prior_dates(daily_sums(log, [keys.entity], keys.date, values), [keys.entity], keys.date, list(values))
    return prior.select(
        keys.entity, keys.date, c("pa").cast("bigint").alias("pa_prior"),
        ((c("on_base") + prior_n * base_rate) / (c("den") + prior_n)).alias("reach_prior"),
        ((c("so") + prior_n * out_rate) / (c("pa") + prior_n)).alias("strikeout_prior"))


# --- Fixed values: six style rates, their starting rates and prior weights ----
STYLES = ("contact", "swing", "walk", "strikeout", "isolated_power", "groundball")
INITIAL_RATES = (0.76, 0.47, 0.085, 0.225, 0.165, 0.43)
PRIOR_WEIGHTS = (100.0, 200.0, 60.0, 60.0, 60.0, 60.0)
LEAGUE_WEIGHT = 500.0
STYLE_AT_BATS = ("single", "double", "triple", "home_run", "field_out", "force_out", "fielders_choice", "fielders_choice_out",
                 "field_error", "strikeout", "strikeout_double_play", "grounded_into_double_play", "double_play", "triple_play")
# ------------------------------------------------------------------------------


def style_counts(terminal: Column) -> dict[str, Column]:
    d, e = F.coalesce("description", F.lit("")), F.coalesce("events", F.lit(""))
    contact = d.isin("foul", "foul_tip", "hit_into_play")
    swing = contact | d.isin(*codes.WHIFF)
    decision = swing | d.isin("ball", "blocked_ball", "called_strike")
    pa = terminal & ~e.isin("intent_walk", "catcher_interf", "truncated_pa", "")
    ab = terminal & e.isin(*STYLE_AT_BATS)
    measured = (d == "hit_into_play") & c("launch_angle").isNotNull()
    extra = F.when(e == "double", 1).when(e == "triple", 2).when(e == "home_run", 3).otherwise(0)
    nums = (contact.cast("int"), swing.cast("int"), (pa & (e == "walk")).cast("int"), (pa & e.isin(*codes.K_EVENTS)).cast("int"),
            F.when(ab, extra).otherwise(0), (measured & (c("launch_angle") < 10)).cast("int"))
    dens = (swing, decision, pa, pa, ab, measured)
    out = {f"n{i}": F.coalesce(x, F.lit(0)) for i, x in enumerate(nums)}
    out.update({f"d{i}": F.coalesce(x.cast("int"), F.lit(0)) for i, x in enumerate(dens)})
    return out


def style_history(log: DataFrame, keys: LogKeys, terminal: Column) -> DataFrame:
    """Per (entity, date): six rates shrunk to the league's own strictly prior rate, and evidence weights."""
    counts = style_counts(terminal)
    names = list(counts)
    daily = daily_sums(log, [keys.entity], keys.date, counts)
    # one row per date: the only window of this module without a partition key
    league_w = Window.orderBy(keys.date).rowsBetween(*PRIOR)
    league = daily.groupBy(keys.date).agg(*[F.sum(n).alias(n) for n in names]).select(
        keys.date, *[((F.coalesce(F.sum(f"n{i}").over(league_w), F.lit(0.0)) + LEAGUE_WEIGHT * INITIAL_RATES[i])
                      / (F.coalesce(F.sum(f"d{i}").over(league_w), F.lit(0.0)) + LEAGUE_WEIGHT)).alias(f"l{i}") for i in range(len(STYLES))])
    own = prior_dates(daily, [keys.entity], keys.date, names).join(F.broadcast(league), keys.date)  # one row per date
    rates = [((c(f"n{i}") + PRIOR_WEIGHTS[i] * c(f"l{i}")) / (c(f"d{i}") + PRIOR_WEIGHTS[i])).alias(f"{s}_prior") for i, s in enumerate(STYLES)]
    weights = [(c(f"d{i}") / (c(f"d{i}") + PRIOR_WEIGHTS[i])).alias(f"{s}_weight") for i, s in enumerate(STYLES)]
    return own.select(keys.entity, keys.date, *rates, *weights)


def long_history(log: DataFrame, keys: LogKeys, token: str, length: int) -> DataFrame:
    """Per episode, up to `length` earlier events of its entity: completed episodes of the same
    cluster first, then strictly earlier dates; other clusters of the same date never count.

    Episodes with more than one entity are left out.  Histories are row frames over single tokens, taken at the first
    event of an episode and at the first token of a date, so no list is longer than `length`.  `row_number() <= length` lets
    Spark keep only `length` rows of an entity's date before the shuffle, so a hot entity stays small.
    """
    whole, token_ = keys.whole_episode(), F.struct(c(token).alias("token"))
    who = F.min(keys.entity).over(whole)
    one = log.select(*keys.event, who.alias(keys.entity), keys.date, token_.alias("_t"), (who == F.max(keys.entity).over(whole)).alias("_same")).where("_same").drop("_same")
    own = Window.partitionBy(keys.cluster, keys.entity).orderBy(keys.episode, keys.seq)
    ep = one.withColumns({"_n_game": F.row_number().over(own) - 1, "_game": F.collect_list("_t").over(own.rowsBetween(-length, -1)), "_prev": F.lag(keys.episode).over(own)})
    ep = ep.where(~c(keys.episode).eqNullSafe(c("_prev")))
    newest = Window.partitionBy(keys.entity, keys.date).orderBy(*[c(k).desc() for k in keys.event])
    tail = one.withColumn("_r", F.row_number().over(newest)).where(c("_r") <= length)
    dated = Window.partitionBy(keys.entity).orderBy(keys.date, *keys.event)
    past = tail.withColumns({"_past": F.collect_list("_t").over(dated.rowsBetween(-length, -1)), "_prev": F.lag(keys.date).over(dated)})
    past = past.where(~c(keys.date).eqNullSafe(c("_prev"))).select(keys.entity, keys.date, "_past")
    both = ep.join(past, [keys.entity, keys.date], "left")
    # the newest `length` of the past followed by the own cluster
    room = F.greatest(length - F.size("_game"), F.lit(0))
    older = F.coalesce(F.slice("_past", F.greatest(F.size("_past") - room + 1, F.lit(1)), room), F.slice("_game", 1, 0))
    return both.select(
        *keys.episode_key, keys.entity, F.transform(F.concat(older, c("_game")), lambda x: x["token"]).alias("tokens"),
        F.least("_n_game", F.lit(length)).cast("bigint").alias("n_cluster"))


def prior_support(log: DataFrame, keys: LogKeys, fit: Column) -> DataFrame:
    """Training events of the actor seen before each event: earlier dates, plus earlier in the same cluster."""
    flag = F.when(fit, 1).otherwise(0)
    dated = prior_dates(daily_sums(log, [keys.actor], keys.date, {"_d": flag}), [keys.actor], keys.date, ["_d"])
    here = F.coalesce(F.sum(flag).over(keys.in_cluster(keys.actor).rowsBetween(*PRIOR)), F.lit(0))
    return log.withColumn("_h", here).join(dated, [keys.actor, keys.date]).withColumn("prior_support", (c("_h") + c("_d")).cast("bigint")).drop("_h", "_d")


def trailing_workload(log: DataFrame, keys: LogKeys, days: int) -> DataFrame:
    """Per (actor, date): clusters and events in the `days` days before the date."""
    daily = log.groupBy(keys.actor, keys.date).agg(F.countDistinct(keys.cluster).alias("_g"), F.count("*").alias("_n"))
    w = Window.partitionBy(keys.actor).orderBy(F.unix_date(keys.date)).rangeBetween(-days, -1)
    return daily.select(keys.actor, keys.date, F.coalesce(F.sum("_g").over(w), F.lit(0)).alias("appearances"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("events"))


def profile_export(log: DataFrame, keys: LogKeys, by: Sequence[str], origins: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Sufficient statistics of every key as of each origin date, from strictly earlier rows."""
    daily = daily_sums(log, by, keys.date, values)
    dated = daily.withColumn("origin", F.explode(F.array(*[F.lit(o).cast("date") for o in origins]))).where(c(keys.date) < c("origin"))
    return dated.groupBy("origin", *by).agg(*[F.sum(n).alias(n) for n in values])


def refresh_profiles(log: DataFrame, keys: LogKeys, terminal: Column, as_of: str, unknown: int, low: float, stale_days: int) -> DataFrame:
    """Style profile of every entity as of a date, plus the profile an unknown entity would get.

    One empty probe row per entity is added on the date and the ordinary history runs over it.
    """
    day = F.lit(as_of).cast("date")
    cols = [keys.entity, keys.date, "description", "events", "launch_angle", "_t"]
    past = log.where(c(keys.date) < day).withColumn("_t", terminal).select(*cols)
    spark = log.sparkSession
    ids = past.select(keys.entity).distinct().unionByName(spark.range(1).select(F.lit(unknown).cast("bigint").alias(keys.entity)))
    probes = ids.select(keys.entity, day.alias(keys.date), F.lit("").alias("description"), F.lit(None).cast("string").alias("events"), F.lit(None).cast("double").alias("launch_angle"), F.lit(False).alias("_t"))
    style = style_history(past.unionByName(probes), keys, c("_t")).where(c(keys.date) == day)
    seen = past.groupBy(keys.entity).agg(F.max(keys.date).alias("last_seen"))
    weight = sum((c(f"{s}_weight") for s in STYLES[1:]), c(f"{STYLES[0]}_weight")) / len(STYLES)
    return style.join(seen, keys.entity, "left").select(
        keys.entity, *[f"{s}_prior" for s in STYLES], weight.alias("reliability"), "last_seen", (weight < low).alias("low_reliability"),
        F.coalesce(F.datediff(day, "last_seen") > stale_days, F.lit(False)).alias("stale"), c("last_seen").isNull().alias("unknown"))
