"""Batch and streaming views over snapshots and revision ledgers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallylane.streaming import state

c = F.col


def latest_accepted(ledger: DataFrame, key: Sequence[str], order: str = "seq", first: bool = False) -> DataFrame:
    """First or last accepted revision per event, with its earliest receipt."""
    ok = ledger.where("outcome in ('new', 'correction')")
    pick = F.min_by if first else F.max_by
    return ok.groupBy(*key).agg(pick(F.struct("sha", "revision", order), order).alias("_x"), F.min("first_received").alias("first_received")).select(*key, "_x.*", "first_received")


def admission(shown: DataFrame, ledger: DataFrame, key: Sequence[str]) -> DataFrame:
    """A shown body is received only when it equals the newest accepted revision; otherwise it is held or unconfirmed."""
    newest = latest_accepted(ledger, key).select(*key, c("sha").alias("accepted_sha"), c("revision").alias("accepted_revision"))
    out = shown.join(newest, list(key), "left")
    status = F.when(c("accepted_sha").isNull(), "unconfirmed").when(c("sha") == c("accepted_sha"), "received").otherwise("held_last_accepted")
    return out.withColumns({"status": status, "corrected": F.coalesce(c("accepted_revision") > 1, F.lit(False))})


def frozen_context(ledger: DataFrame, queries: DataFrame, cluster: str, actor: str, order: Sequence[str], n: int) -> DataFrame:
    """The last n accepted events by the query's actor strictly before its key, in their latest versions.

    A query abstains if an earlier event of its cluster is `unknown`, of whatever actor, unless n accepted
    events of the query's actor are all newer than it: nothing unknown could then displace them.  The
    event right before the query must be known as well.  Events are numbered once per cluster and
    actor; a query takes a bounded frame of n accepted events, never the whole prefix.
    """
    latest = ledger.groupBy(cluster, *order).agg(F.max_by(F.struct(actor, "status", "token"), "version").alias("_x")).select(cluster, *order, "_x.*", F.lit(1).alias("_e"))
    both = latest.unionByName(queries.select(cluster, *order, actor, F.lit(0).alias("_e"), "decision_id"), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(*order, "_e"))
    both = both.withColumn("_at", place)
    good = (c("_e") == 1) & (c("status") == "accepted")
    before = Window.partitionBy(cluster).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_unknown", F.max(F.when((c("_e") == 1) & (c("status") == "unknown"), c("_at"))).over(before))
    # accepted events and queries alternate; the frame of a query is the run of its actor's last n accepted events
    own = Window.partitionBy(cluster, actor).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_done", F.coalesce(F.sum(good.cast("int")).over(own), F.lit(0)))
    recent = Window.partitionBy(cluster, actor).orderBy("_done").rangeBetween(-n, -1)
    run = F.collect_list(F.when(good, F.struct("_at", "token"))).over(recent)
    out = both.withColumn("_h", F.sort_array(run)).where("_e = 0")
    newer = (F.size("_h") == n) & (c("_unknown") < c("_h")[0]["_at"]) & (c("_unknown") < c("_at") - 1)
    blocked = c("_unknown").isNotNull() & ~newer
    return out.select("decision_id", cluster, *order, F.when(blocked, F.lit("prior_quality_unknown")).alias("abstain"), F.when(~blocked, F.transform("_h", lambda h: h["token"])).alias("context"))


def delayed_release(snapshots: DataFrame, viewers: DataFrame, cluster: str, delay: str, now: str) -> DataFrame:
    """Newest snapshot whose event time is at most now - delay for every viewer request: an as-of pick
    over one ordered window of snapshots and requests."""
    req = viewers.withColumn("_t", c(now) - c(delay))
    both = snapshots.select(cluster, c("event").alias("_t"), F.struct("event", "seq").alias("_s"), F.lit(0).alias("_k")).unionByName(
        req.select(cluster, "_t", F.lit(1).alias("_k"), "request_id"), allowMissingColumns=True)
    w = Window.partitionBy(cluster).orderBy("_t", "_k", F.coalesce(c("_s.seq"), F.lit(0))).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_s", F.last("_s", ignorenulls=True).over(w)).where("_k = 1").select("request_id", cluster, c("_s.seq").alias("released_seq"), c("_s.event").alias("released_event"))


def lag_windows(stream: DataFrame, event_time: str, lag: str, width: str, watermark: str | None) -> DataFrame:
    """Receipt minus event time per tumbling window; works on batch and streaming input."""
    df = stream.withWatermark(event_time, watermark) if watermark else stream
    out = df.groupBy(F.window(event_time, width)).agg(F.count("*").alias("n"), F.avg(lag).alias("mean_lag"), F.max(lag).alias("max_lag"))
    return out.select(c("window.start").alias("start"), "n", "mean_lag", "max_lag")


def lag_report(stream: DataFrame, source: DataFrame, event_time: str, lag: str, width: str, watermark: str) -> DataFrame:
    """All events accounted for: the windows a stream has closed, those open when its input ends, and one row `late` with the rows it dropped.

    `source` is the stream's input as a batch; of it, only windows that end behind the last watermark are read as open ones.
    """
    closed, dropped, mark = state.run_with_progress(lag_windows(stream, event_time, lag, width, watermark), source.sparkSession)
    rows = source if mark is None else source.where(F.window(event_time, width)["end"] > F.lit(mark).cast("timestamp"))
    open_ = lag_windows(rows, event_time, lag, width, None)
    late = source.sparkSession.range(1).select(F.lit(None).cast("timestamp").alias("start"), F.lit(dropped).cast("long").alias("n"), F.lit(None).cast("double").alias("mean_lag"), F.lit(None).cast(closed.schema["max_lag"].dataType).alias("max_lag"))
    return reduce(DataFrame.unionByName, [x.withColumn("status", F.lit(name)) for name, x in (("closed", closed), ("open", open_), ("late", late))])


def timeline_audit(snapshots: DataFrame, key: Sequence[str], order: str, value: str, provider: str, final_order) -> DataFrame:
    """Per key: first, last and final value, changes, provider conflicts, and absence from the final snapshot."""
    per = snapshots.groupBy(*key).agg(
        F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"), F.max(F.when(c(order) == final_order, c(value))).alias("final_value"), F.count_distinct(provider).alias("providers"))
    return per.withColumns({"changed": c("first_value") != c("last_value"), "conflict": c("providers") > 1, "missing_from_final": c("final_value").isNull()})
