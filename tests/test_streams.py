"""The same deliveries as one batch and as several micro-batches give the same ledger."""

import tempfile

import pytest

from tallylane.plans.feeds import EVENT_SCHEMA, deliveries
from tallylane.sources import log_io
from tallylane.streaming import release, state, views

SF = "/root/testdata/sf0.001"
STEPS = {"slots": (state.slot_step, state.SLOT_SCHEMA), "revisions": (state.revision_step, state.REVISION_SCHEMA), "intake": (state.intake_step, state.INTAKE_SCHEMA)}


@pytest.mark.parametrize("name", list(STEPS))
def test_micro_batches_inside_clusters_and_plain_fold_agree(spark, name):
    step, schema = STEPS[name]
    late = "status" if name == "intake" else "outcome"
    events = spark.read.parquet(f"{SF}/events.parquet")
    names = [p.split()[0] for p in schema.split(",")]
    ordered = sorted((r.asDict() for r in deliveries(events).collect()), key=lambda r: (r["game_pk"], r["seq"]))
    plain, docs = [], {}
    for r in ordered:
        plain += [tuple(o[n] for n in names) for o in step(docs.setdefault(r["game_pk"], {}), r)]
    rows = spark.createDataFrame(ordered, deliveries(events).schema)
    got = {}
    for parts in (1, 3):  # each file takes a part of every cluster, in receipt order, so that state crosses batches
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        for i in range(parts):
            rows.where(f"least((seq - game_pk * 864) * {parts} div 864, {parts - 1}) = {i}").coalesce(1).write.mode("append").parquet(f"{base}/in")
        s = log_io.snapshot_stream(spark, f"{base}/in", rows.schema, files_per_trigger=1)
        got[parts] = sorted(map(str, (tuple(r) for r in state.run_to_table(state.fold(s, ["game_pk"], "seq", step, schema, late=late), spark).collect())))
    expected = sorted(map(str, plain))
    assert got[1] == got[3] == expected and len(expected) > 100


def test_late_rows_are_reported_and_not_applied(spark):
    schema = "game_pk long, seq long, event long, stamp long, sha string, rank long, received long"
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for part in ([(1, 5, 10, 5, "a", 1, 100), (1, 1, 8, 3, "z", 1, 90)], [(1, 3, 9, 9, "b", 1, 110), (1, 6, 10, 6, "c", 1, 120)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    s = log_io.snapshot_stream(spark, f"{base}/in", spark.createDataFrame([], schema).schema, files_per_trigger=1)
    got = {r.seq: (r.outcome, r.version) for r in state.run_to_table(state.fold(s, ["game_pk"], "seq", state.slot_step, state.SLOT_SCHEMA, late="outcome"), spark).collect()}
    assert got == {1: ("new", 1), 5: ("new", 1), 3: ("late", None), 6: ("correction", 2)}


def test_closed_open_and_late_rows_are_all_of_the_input(spark):
    """Hours 0 to 3 in four files; the last one brings rows of hours whose windows the watermark has closed (one batch after it moved)."""
    from pyspark.sql import functions as F

    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    minutes = ([5, 20, 50], [70, 130, 190], [195], [10, 75, 200])
    for part in minutes:
        spark.createDataFrame([(m, float(m)) for m in part], "m long, value double").select((F.lit("2024-01-01 00:00:00").cast("timestamp").cast("long") + F.col("m") * 60).cast("timestamp").alias("ts"), "value").coalesce(1).write.mode("append").parquet(f"{base}/in")
    source = spark.read.parquet(f"{base}/in")
    found = views.lag_report(log_io.snapshot_stream(spark, f"{base}/in", source.schema), source, "ts", "value", "1 hour", "10 minutes").collect()
    by = {status: sorted((r.start.hour if r.start else None, r.n) for r in found if r.status == status) for status in ("closed", "open", "late")}
    assert by == {"closed": [(0, 3), (1, 1), (2, 1)], "open": [(3, 3)], "late": [(None, 2)]}
    assert sum(r.n for r in found) == 10


def test_timers_answer_requests_and_evict_snapshots(spark):
    """In-time rows in six files: answers are those of a plain as-of pick, requests behind the watermark stay open, and snapshots leave."""
    import random

    from pyspark.sql import functions as F

    rng, rows, base = random.Random(3), [], tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for b in range(12):
        part = [(g, "snapshot", b * 100 + rng.randrange(100), b * 1000 + i) for i in range(40) for g in (1, 2)] + [(g, "request", b * 100 + rng.randrange(100) - 20, 100_000 + b * 100 + i * 10 + g) for i in range(5) for g in (1, 2)]
        rows += part
        spark.createDataFrame(part, "g long, kind string, s long, number long").select("g", "kind", F.timestamp_seconds(F.col("s") + 1000).alias("at"), "number").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = log_io.snapshot_stream(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, release.PROVIDER)
    try:
        found, dropped, _ = state.run_with_progress(release.delayed_release_stream(stream.where("kind = 'snapshot'").withColumnRenamed("number", "seq"), stream.where("kind = 'request'").withColumnRenamed("number", "request_id"), "g", "120 seconds"), spark)
        found = found.collect()
    finally:
        spark.conf.set(name, before)
    mark = max(r[2] for r in rows) - 120
    want = {}
    for g, kind, at, number in rows:
        if kind == "request" and at <= mark:
            newest = max(((s, n) for x, k, s, n in rows if x == g and k == "snapshot" and s <= at), default=(None, None))
            want[number] = (g, newest[1], None if newest[0] is None else (newest[0] + 1000) * 1000)
    assert dropped == 0 and {r.request_id: (r.cluster, r.released_seq, r.released_at) for r in found} == want
    # 480 snapshots of a cluster came; those of two files and the delay are held at most
    assert max(r.held for r in found) <= 180 and len(want) > 80


def test_a_cluster_has_one_timer_and_one_read_and_write_in_a_call():
    """Calls to the state store are what the stream's time goes to: they must not grow with the requests of a cluster."""
    import pandas as pd

    class Calls:
        def __init__(self):
            self.value, self.log = None, []

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.log.append("get")
            return self.value

        def update(self, value):
            self.log.append("update")
            self.value = value

        def registerTimer(self, at):
            self.log.append(("timer", at))

        def deleteTimer(self, at):
            self.log.append(("no timer", at))

    class At:
        def __init__(self, at):
            self.at = at

        def getExpiryTimeInMs(self):
            return self.at

        getCurrentWatermarkInMs = getExpiryTimeInMs

    calls, step = Calls(), release.Release()
    step.init(calls)
    frame = pd.DataFrame([("snapshot", 1000 * i, i) for i in range(1, 41)] + [("request", 1000 * i + 500, 100 + i) for i in range(5, 40)], columns=["kind", "at", "number"])
    list(step.handleInputRows((7,), iter([frame.assign(at=pd.to_datetime(frame["at"], unit="ms"))]), None))
    assert calls.log == ["get", "update", ("timer", 5500)] or calls.log == ["get", ("timer", 5500), "update"]
    calls.log.clear()
    out = pd.concat(step.handleExpiredTimer((7,), At(20500), At(5500)))
    assert [x if isinstance(x, str) else x[0] for x in sorted(calls.log, key=str)] == ["timer", "get", "update"] and ("timer", 21500) in calls.log
    assert dict(zip(out["request_id"], out["released_seq"], strict=True)) == {100 + i: i for i in range(5, 21)}
    # what is held: all 40 at first; later answers no longer count what lies before their own
    assert out["held"].tolist() == [40] + [41 - i for i in range(6, 21)] and len(step._load()[0]) == 21


def test_requests_at_the_watermark_are_answered(spark):
    from pyspark.sql import functions as F

    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [(1, "snapshot", 100, 1), (1, "snapshot", 300, 3), (1, "request", 200, 7), (1, "request", 201, 8), (2, "request", 200, 9), (2, "snapshot", 200, 2)]
    spark.createDataFrame(rows, "g long, kind string, s long, number long").select("g", "kind", F.timestamp_seconds("s").alias("at"), "number").coalesce(1).write.parquet(f"{base}/in")
    stream = log_io.snapshot_stream(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, release.PROVIDER)
    try:
        found = state.run_to_table(release.delayed_release_stream(stream.where("kind = 'snapshot'").withColumnRenamed("number", "seq"), stream.where("kind = 'request'").withColumnRenamed("number", "request_id"), "g", "100 seconds"), spark).collect()
    finally:
        spark.conf.set(name, before)
    print(sorted((r.request_id, r.released_seq) for r in found))
    assert sorted((r.request_id, r.released_seq) for r in found) == [(7, 1), (9, 2)]


def test_small_keys_of_a_cluster_share_a_state(spark):
    """One state and one call for a cluster's decisions, with the answers (late rows too) of a state for each decision."""
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [(i % 3, f"{i % 3}:{i % 4}", (i * 7) % 60, "ab"[i // 9 % 2]) for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part * 20:part * 20 + 20], "g long, decision_id string, seq long, sha string").coalesce(1).write.mode("append").parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    got = {}
    for within in (None, ["g"]):
        s = log_io.snapshot_stream(spark, f"{base}/in", schema, files_per_trigger=1)
        out = state.fold(s, ["decision_id"], "seq", state.ledger_step, state.LEDGER_SCHEMA, late="outcome", within=within)
        got[within is None] = sorted(map(tuple, state.run_to_table(out, spark).collect()))
    assert got[True] == got[False] and {x[2] for x in got[True]} == {"first", "duplicate", "conflict", "late"}


def test_slot_rules():
    st = {}

    def send(seq, event, stamp, sha, rank=1):
        return state.slot_step(st, dict(game_pk=1, seq=seq, event=event, stamp=stamp, sha=sha, rank=rank, received=1000 + seq))[0]

    assert send(1, 10, 5, "a")["outcome"] == "new"
    assert send(2, 10, 5, "a")["outcome"] == "duplicate"
    assert send(3, 10, 6, "b")["version"] == 2
    assert send(4, 9, 4, "c")["outcome"] == "stale"
    assert send(5, 9, None, "c")["outcome"] == "stale"
    assert send(6, 9, 4, "c", rank=2)["outcome"] == "correction"
    assert send(7, 20, 1, "d")["version"] == 1


def test_revision_rules():
    st = {}

    def send(seq, pid, key, stamp, sha):
        return state.revision_step(st, dict(game_pk=1, seq=seq, provider_id=pid, at_bat_number=key, pitch_number=1, stamp=stamp, sha=sha, malformed=None, received=seq))

    assert send(1, "p", 1, 1, "a")[0]["outcome"] == "new"
    assert send(2, "p", 1, 1, "a") == []
    assert send(3, "p", 1, 1, "b")[0]["reason"] == "same_revision_hash_mismatch"
    assert send(4, "p", 1, 1, "b") == []
    assert send(5, "p", 1, 0, "c")[0]["reason"] == "stale_revision"
    assert send(6, "p", 1, None, "d")[0]["reason"] == "unordered_revision"
    assert send(7, "p", 2, 9, "e")[0]["reason"] == "conflicting_key"
    assert send(8, "q", 1, 9, "e")[0]["reason"] == "ambiguous_remap"
    assert send(9, "p", 1, 9, "e")[0]["revision"] == 2
