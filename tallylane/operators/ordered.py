"""Windows over the ordered log: episodes, transitions, outs, history and audits of order.

Every function takes the log and its keys and returns a lazy DataFrame.  All
windows are partitioned by cluster or episode.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylane.functions import codes
from tallylane.keys import PRIOR, LogKeys

c = F.col


def episodes(log: DataFrame, keys: LogKeys, first: Sequence[str], last: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """One row per episode: `first_*` and `last_*` columns, the event count, and carried columns."""
    def pick(cols, fn):
        return fn(F.struct(*cols), keys.seq)

    out = log.groupBy(*keys.episode_key).agg(
        pick([*first, *carry], F.min_by).alias("_a"), pick(last, F.max_by).alias("_b"), F.count("*").alias("n_events"))
    return out.select(
        *keys.episode_key, *[c(f"_a.{x}").alias(x) for x in carry],
        *[c(f"_a.{x}").alias(f"first_{x}") for x in first], *[c(f"_b.{x}").alias(f"last_{x}") for x in last], "n_events")


def previous_event(log: DataFrame, keys: LogKeys, columns: Mapping[str, object]) -> DataFrame:
    """Previous event of the same episode; the given default (may be None) at its start.

    A null in the previous event also reads as the default.
    """
    w = keys.in_episode()
    return log.withColumns({
        f"prev_{name}": F.lag(name).over(w) if d is None else F.coalesce(F.lag(name).over(w), F.lit(d)) for name, d in columns.items()})


def exact_predecessor(log: DataFrame, keys: LogKeys, column: str, unknown: str = "UNKNOWN") -> DataFrame:
    """Value at sequence n-1; a gap gives `unknown` instead of an older event."""
    w = keys.in_episode()
    ok = F.lag(keys.seq).over(w) == c(keys.seq) - 1
    return log.withColumns({
        f"previous_{column}": F.when(ok, F.coalesce(F.lag(column).over(w), F.lit(unknown))).otherwise(unknown),
        "previous_valid": F.coalesce(ok, F.lit(False))})


def next_state(log: DataFrame, keys: LogKeys, columns: Sequence[str], at: Column) -> DataFrame:
    """State of the next event of the same cluster, kept only on rows selected by `at`."""
    w = keys.in_cluster()
    return log.withColumns({f"next_{x}": F.when(at, F.lead(x).over(w)) for x in columns})


def interval_outs(log: DataFrame, keys: LogKeys, outs: str = "outs_when_up", event: str = "events") -> DataFrame:
    """Outs between an event and the next, credited to the actor on the left.

    Inside a half the difference of outs, at its end what was missing to three, at
    the end of the cluster what the event implies.  Outs beyond the implied ones at
    a substitution are ambiguous.  `outs_invalid` marks impossible differences.
    """
    w = keys.in_cluster()
    nxt = {x: F.lead(x).over(w) for x in (outs, keys.period, keys.side, keys.actor)}
    has_next = nxt[outs].isNotNull()
    same_half = has_next & (nxt[keys.period] == c(keys.period)) & (nxt[keys.side] == c(keys.side))
    implied = codes.implied_outs(c(event))
    delta = F.when(same_half, nxt[outs] - c(outs)).when(has_next, 3 - c(outs)).otherwise(implied)
    step = log.withColumns({
        "outs_event_implied": implied, "outs_recorded": delta.cast("bigint"),
        "outs_interval_change": F.coalesce(same_half & (nxt[keys.actor] != c(keys.actor)), F.lit(False))})
    return step.withColumns({
        "outs_ambiguous_extra": F.when(c("outs_interval_change"), F.greatest(c("outs_recorded") - c("outs_event_implied"), F.lit(0))).otherwise(0).cast("bigint"),
        "outs_invalid": ~c("outs_recorded").between(0, 3) | (c(outs) + c("outs_recorded") > 3)})


def starters(log: DataFrame, keys: LogKeys, outs: str = "outs_when_up") -> DataFrame:
    """First actor per (cluster, side) on every row, and whether that first event looks like a start."""
    w = keys.in_cluster(keys.side)
    return log.withColumns({
        "starter": F.first(keys.actor).over(w),
        "starter_valid": (F.first(keys.period).over(w) == 1) & (F.first(outs).over(w) == 0)})


def history_tokens(log: DataFrame, keys: LogKeys, token: Sequence[str], n: int, output: str = "history") -> DataFrame:
    """The previous n events of the episode, oldest first."""
    w = keys.in_episode().rowsBetween(-n, -1)
    return log.withColumn(output, F.collect_list(F.struct(*token)).over(w))


def actor_context(log: DataFrame, keys: LogKeys, token: Sequence[str], n: int, output: str = "context") -> DataFrame:
    """The last n earlier events by the same actor in the same cluster, oldest first."""
    w = keys.in_cluster(keys.actor).rowsBetween(-n, -1)
    return log.withColumn(output, F.collect_list(F.struct(*token)).over(w))


def prior_mean(log: DataFrame, keys: LogKeys, by: Sequence[str], values: Sequence[str], complete: Column) -> DataFrame:
    """Count and means of earlier complete events of the same cluster and group."""
    w = keys.in_cluster(*by).rowsBetween(*PRIOR)
    return log.withColumns({
        "prior_n": F.count(F.when(complete, 1)).over(w),
        **{f"prior_{v}": F.avg(F.when(complete, c(v))).over(w) for v in values}})


def adaptive_shift(df: DataFrame, values: Sequence[str], k: float) -> DataFrame:
    """Shrunken difference between the in-cluster mean and the reference mean."""
    weight = c("prior_n") / (c("prior_n") + F.lit(float(k)))
    return df.withColumns({f"shift_{v}": F.when(c("prior_n") == 0, 0.0).otherwise((c(f"prior_{v}") - c(f"ref_{v}")) * weight) for v in values})


def substitutions(log: DataFrame, keys: LogKeys, team: str) -> DataFrame:
    """First event of each new actor of a team within a cluster."""
    w = keys.in_cluster(team)
    out = log.withColumn("outgoing", F.lag(keys.actor).over(w))
    return out.where(c("outgoing") != c(keys.actor))


def evidence_packets(log: DataFrame, keys: LogKeys, selected: Column, state: Sequence[str]) -> DataFrame:
    """For selected events: the keys of the episode, earlier events of the actor, the recorded next state."""
    ids = F.concat_ws(":", *[c(x).cast("string") for x in keys.event])
    out = log.withColumns({
        "event_key": ids,
        "episode_keys": F.collect_list(ids).over(keys.in_episode().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "prior_same_actor": F.count("*").over(keys.in_cluster(keys.actor).rowsBetween(*PRIOR)),
        **{f"next_{x}": F.lead(x).over(keys.in_cluster()) for x in state}})
    return out.where(selected).withColumn("next_complete", F.forall(F.array(*[c(f"next_{x}").isNotNull() for x in state]), lambda x: x))


def score_changes(log: DataFrame, keys: LogKeys) -> DataFrame:
    """Per event and team the score after it (next event, or the final record), the change, and the half that earned it."""
    w = keys.in_cluster()
    teams = F.array(*[
        F.struct(
            F.lit(team).alias("team"), F.lit(side).alias("team_side"), c(f"{team}_score").alias("before"),
            F.coalesce(F.lead(f"{team}_score").over(w), c(f"post_{team}_score")).alias("after"))
        for team, side in (("away", "Top"), ("home", "Bot"))])
    # windows first, then one row per team
    base = log.withColumns({"_teams": teams, "_ns": F.lead(keys.side).over(w), "_np": F.lead(keys.period).over(w)})
    out = base.withColumn("_t", F.explode("_teams")).select(*log.columns, "_ns", "_np", "_t.*").withColumn("change", c("after") - c("before"))
    here, there = c(keys.side) == c("team_side"), c("_ns") == c("team_side")
    return out.withColumns({
        "decreased": c("change") < 0,
        "runs_scored": F.when(c("change") >= 0, c("change")),
        "target_period": F.when(here, c(keys.period)).when(there, c("_np")),
        "outside_half": ~here & ~F.coalesce(there, F.lit(False)) & (c("change") > 0)}).drop("_ns", "_np")


def line_score(log: DataFrame, keys: LogKeys) -> DataFrame:
    """Runs per cluster, team and period; null when a decrease makes the half unknown."""
    ch = score_changes(log, keys).where("target_period is not null")
    own = c(keys.side) == c("team_side")
    unknown = F.max(F.when(own & c("decreased"), 1).otherwise(0))
    return ch.groupBy(keys.cluster, "team", c("target_period").alias(keys.period)).agg(
        F.when(unknown == 0, F.coalesce(F.sum("runs_scored"), F.lit(0))).alias("runs"))


def line_score_issues(log: DataFrame, keys: LogKeys) -> DataFrame:
    """Score decreases and runs outside the batting half, counted per cluster and team."""
    return score_changes(log, keys).groupBy(keys.cluster, "team").agg(
        F.count_if("decreased").alias("decreases"), F.count_if("outside_half").alias("outside"))


def value_path(log: DataFrame, keys: LogKeys, value: str, final: Column) -> DataFrame:
    """Value before and after every event; after the last one the final result."""
    after = F.coalesce(F.lead(value).over(keys.in_cluster()), final)
    return log.withColumns({"value_before": c(value), "value_after": after}).withColumn("value_change", c("value_after") - c("value_before"))


def largest_changes(df: DataFrame, keys: LogKeys, k: int) -> DataFrame:
    """Top k events per cluster by absolute value change, the earlier event first on ties."""
    w = Window.partitionBy(keys.cluster).orderBy(F.abs("value_change").desc(), *keys.event)
    return df.where("value_change is not null").withColumn("rank", F.row_number().over(w)).where(c("rank") <= k)


def cumulative_ratio(df: DataFrame, keys: LogKeys, ratio: str, output: str = "rho_cum") -> DataFrame:
    """Product of the ratios up to and including each event of the episode; zeros are carried by a flag."""
    w = keys.in_episode().rowsBetween(Window.unboundedPreceding, 0)
    zero = F.max(F.when(c(ratio) == 0, 1).otherwise(0)).over(w)
    logs = F.sum(F.when(c(ratio) > 0, F.log(c(ratio)))).over(w)
    return df.withColumn(output, F.when(zero == 1, 0.0).otherwise(F.exp(F.coalesce(logs, F.lit(0.0)))))


def ranked_cohort(table: DataFrame, id_col: str, n: int) -> DataFrame:
    """Top n actors by outs; `stable` is false when ambiguous outs could change the membership.

    Only n rows are broadcast; the rest of the table is never brought to one task.
    """
    lower = table.withColumn("outs_lower", c("outs") - c("uncertain_outs"))
    top = lower.orderBy(c("outs").desc(), c("starts").desc(), id_col).limit(n).select(id_col)
    marked = lower.join(F.broadcast(top.withColumn("chosen", F.lit(True))), id_col, "left").fillna(False, ["chosen"])
    gate = marked.agg(
        F.count_if("chosen").alias("_n"), F.min(F.when(c("chosen"), c("outs_lower"))).alias("_lo"),
        F.max(F.when(~c("chosen"), c("outs"))).alias("_hi"))
    return marked.join(F.broadcast(gate)).withColumn("stable", (c("_n") == n) & F.coalesce(c("_lo") > c("_hi"), F.lit(False))).drop("_n", "_lo", "_hi")


def cluster_completion(log: DataFrame, keys: LogKeys) -> DataFrame:
    """Is the cluster finished by rule, judged on its last event, and who won."""
    fields = ["events", "outs_when_up", keys.period, keys.side, "post_home_score", "post_away_score"]
    last = log.groupBy(keys.cluster).agg(F.max_by(F.struct(*fields), F.struct(keys.episode, keys.seq)).alias("x")).select(keys.cluster, "x.*")
    done = c("outs_when_up") + codes.implied_outs(c("events")) == 3
    home, away = c("post_home_score") > c("post_away_score"), c("post_home_score") < c("post_away_score")
    terminal = F.coalesce(c("events") != "truncated_pa", F.lit(False))
    top = c(keys.side) == "Top"
    complete = (c(keys.period) >= 9) & terminal & ((top & done & home) | (~top & done & away) | (~top & home))
    return last.select(keys.cluster, complete.alias("complete"), F.when(complete, home.cast("double")).alias("final_home_win"))


def select_decisions(log: DataFrame, keys: LogKeys, team: str, last_period: int = 8) -> DataFrame:
    """First substitution per cluster that opens a fresh half; clusters without one keep a reason."""
    half = Window.partitionBy(*keys.half)
    side_prior = keys.in_cluster(team).rowsBetween(*PRIOR)
    base = log.withColumns({
        "outgoing": F.lag(keys.actor).over(keys.in_cluster(team)),
        "half_first": F.min(keys.episode).over(half),
        "prior_events": F.count("*").over(side_prior),
        "prior_actors": F.size(F.collect_set(keys.actor).over(side_prior)).cast("bigint")})
    fresh = base.where(
        (c("outgoing") != c(keys.actor)) & (c(keys.seq) == 1) & (c("outs_when_up") == 0)
        & (c(keys.period) <= last_period) & (c(keys.episode) == c("half_first")))
    pick = fresh.withColumn("_r", F.row_number().over(keys.in_cluster())).where("_r = 1").select(
        keys.cluster, keys.episode, keys.seq, c(team).alias("team"), "outgoing", c(keys.actor).alias("incoming"), "prior_events", "prior_actors")
    out = log.select(keys.cluster).distinct().join(pick, keys.cluster, "left")
    missing = c(keys.episode).isNull()
    return out.withColumns({
        "status": F.when(missing, "missing").otherwise("selected"),
        "missing_reason": F.when(missing, f"no_observed_fresh_half_inning_change_through_inning_{last_period}")})


def running_line(log: DataFrame, keys: LogKeys, entity: str, counters: Mapping[str, Column]) -> DataFrame:
    """Counters of an entity within the cluster, up to but excluding each event."""
    w = keys.in_cluster(entity).rowsBetween(*PRIOR)
    return log.withColumns({n: F.coalesce(F.sum(e.cast("bigint")).over(w), F.lit(0)) for n, e in counters.items()})


def revealed(log: DataFrame, keys: LogKeys, through: int) -> DataFrame:
    """The first `through` events of every cluster; apply before any other window."""
    return log.withColumn("ordinal", F.row_number().over(keys.in_cluster())).where(c("ordinal") <= through)


def recent_vs_trailing(log: DataFrame, keys: LogKeys, code: str, measure: str, recent: int, days: int) -> DataFrame:
    """Context before an event: earlier events, times facing the entity, and the recent mean of
    the same code (nulls inside the window are dropped, not replaced) against a trailing mean."""
    actor = keys.in_cluster(keys.actor).rowsBetween(*PRIOR)
    facing = keys.in_cluster(keys.actor, keys.entity)
    new_episode = F.when(F.coalesce(F.lag(keys.episode).over(facing) != c(keys.episode), F.lit(True)), 1).otherwise(0)
    same = keys.in_cluster(keys.actor, code).rowsBetween(-recent, -1)
    daily = log.groupBy(keys.actor, code, keys.date).agg(F.sum(measure).alias("_s"), F.count(measure).alias("_c"))
    span = Window.partitionBy(keys.actor, code).orderBy(F.unix_date(keys.date)).rangeBetween(-days, -1)
    base = daily.withColumns({"base_n": F.coalesce(F.sum("_c").over(span), F.lit(0)), "base_sum": F.sum("_s").over(span)}).drop("_s", "_c")
    out = log.withColumns({"prior_events": F.count("*").over(actor), "_new": new_episode, "recent_n": F.count(measure).over(same), "recent_mean": F.avg(measure).over(same)})
    out = out.withColumn("times_facing", F.sum("_new").over(facing.rowsBetween(Window.unboundedPreceding, 0)))
    joined = out.join(base.withColumnsRenamed({keys.actor: "_ba", code: "_bc", keys.date: "_bd"}), (c(keys.actor) == c("_ba")) & c(code).eqNullSafe(c("_bc")) & (c(keys.date) == c("_bd")), "left")
    mean = F.when(c("base_n") > 0, c("base_sum") / c("base_n"))
    return joined.withColumns({"base_mean": mean, "delta": c("recent_mean") - mean}).drop("_ba", "_bc", "_bd", "_new")
