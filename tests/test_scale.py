"""Steps whose memory or time grew faster than they must: their plans, and the same results."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from tallylane.operators import model
from tallylane.plans import relations, testlog
from tallylane.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def test_support_audit_does_not_multiply_rows(spark):
    assert "Expand" not in plan(relations.audited(Tables(spark, SF))[1])


def test_log_gets_more_partitions_as_it_grows(spark):
    keyed = spark.range(10).withColumn("game_pk", F.col("id"))
    few, many = testlog.by_cluster(keyed, 100_000), testlog.by_cluster(keyed, 2_000_001)
    assert few.rdd.getNumPartitions() <= 8 and many.rdd.getNumPartitions() == 41 and sorted(many.collect()) == sorted(keyed.collect())


def test_log_keeps_its_partitions_where_the_session_has_more(spark):
    """Adaptive execution would join the session's partitions to one for each core."""
    keyed, had = spark.range(10).withColumn("game_pk", F.col("id")), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert testlog.by_cluster(keyed, 2_000_001).rdd.getNumPartitions() == 41
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)


def test_forecasts_are_graded_where_they_are_joined(spark):
    """No exchange after the join."""
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        graded = plan(relations._c10(Tables(spark, SF)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    assert "Exchange" not in graded[:graded.index("SortMergeJoin")]


def test_audit_does_not_move_the_log_by_actor(spark):
    with_masks = plan(relations.trajectories(Tables(spark, SF)))
    assert "SortMergeJoin [pitcher" not in with_masks


def test_weighted_winner_fit_equals_the_fit_of_all_rows(spark):
    """Coefficients of repeated rows, fitted once each with their number, are those of the rows one by one."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import Matrices

    rows = spark.range(3000).selectExpr("cast(id % 7 - 3 as double) as a", "cast(id % 3 as double) as b", "cast(pmod(hash(id), 10) < 4 + id % 7 - 3 as double) as y")
    m = model.winner_model(rows, "y", ["a", "b"], ["b"], 0.01)
    lr = LogisticRegression(labelCol="y", featuresCol="features", regParam=0.01, maxIter=100, standardization=False, lowerBoundsOnCoefficients=Matrices.dense(1, 2, [float("-inf"), 0.0]))
    plain = lr.fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows))
    assert list(m.coefficients) == pytest.approx(list(plain.coefficients), abs=1e-5) and m.intercept == pytest.approx(plain.intercept, abs=1e-5)
    assert m.summary.predictions.count() <= 42


def test_soft_clusters_derive_their_snapshots_once(spark):
    """The snapshots' own plan runs once, however often they are read."""
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rows = spark.range(60).selectExpr("id % 20 as who", "id as day", "cast(id % 7 as double) as r1", "cast(id % 5 as double) as r2", "1.0D as e").mapInPandas(count, "who long, day long, r1 double, r2 double, e double")
    out = model.soft_clusters(rows, ["r1", "r2"], ["e"], "who", 3, "r1").collect()
    assert len(out) == 60 and seen.value <= 60 and all(abs(sum(r.membership) - 1) < 1e-9 for r in out)


def test_smoothing_checks_codes_on_the_cells(spark, monkeypatch):
    """The rows reach their cells without a filter on codes; rows of unknown codes still have no cell."""
    from tallylane.operators import freq

    plans, keep = [], freq.materialise
    monkeypatch.setattr(freq, "materialise", lambda df: (plans.append(plan(df)), keep(df))[1])
    log = Tables(spark, SF).ids
    cells = freq.dirichlet_levels(log, "pitcher", 20.0, 40.0)["cells"]
    want = log.where("outcome_id >= 0 and action_id >= 0").groupBy("pitcher", "state_id", "action_id").count()
    got = cells.selectExpr("pitcher", "state_id", "action_id", "cast(" + " + ".join(f"n{i}" for i in range(11)) + " AS bigint)")
    assert plans and all("Filter (" not in p for p in plans) and sorted(got.collect()) == sorted(want.collect())


def test_bellman_check_counts_the_log_once(spark, monkeypatch):
    from tallylane.operators import freq
    from tallylane.plans import evaluation

    calls, levels = [], freq.dirichlet_levels
    monkeypatch.setattr(freq, "dirichlet_levels", lambda *a, **k: (calls.append(1), levels(*a, **k))[1])
    rows = evaluation._i02b(Tables(spark, SF)).collect()
    assert rows and all(r.optimal and r.consistent for r in rows) and len(calls) == 1


def test_style_speed_does_not_depend_on_the_order_of_rows(spark):
    from tallylane.operators import aggs

    def speed(values):
        rows = spark.createDataFrame([(1, "hit_into_play", None, 5, None, None, v) for v in values],
                                     "who int, description string, events string, zone int, bb_type string, launch_angle double, launch_speed double").coalesce(1)
        return aggs.style_table(rows, ["who"]).first().avg_launch_speed

    assert speed([0.1, 0.2, 0.3]) == speed([0.3, 0.2, 0.1]) == 0.6 / 3 and speed([None]) is None
    assert speed([1.0, float("inf")]) == float("inf") and speed([1e30, 3e30]) == 2e30


def test_outcome_design_is_dense_and_its_dates_do_not_derive_the_log_again(spark, monkeypatch):
    """spark.ml keeps a block of rows as dense where that takes less room: 8 bytes a value against 12 a value that is not zero."""
    from tallylane.plans import samples

    plans, quantiles = [], samples.exact_quantiles
    monkeypatch.setattr(samples, "exact_quantiles", lambda df, *a: (plans.append(plan(df)), quantiles(df, *a))[1])
    rows, names = samples.outcome_design(Tables(spark, "/root/testdata/sf0.01"))
    filled = rows.agg(F.avg(sum((F.col(n) != 0).cast("int") for n in names))).first()[0]
    assert 12 * filled > 8 * len(names) and plans and all("Window" not in p for p in plans)


def test_outcome_fit_reads_small_partitions_together(spark):
    assert [model.fit_partitions(n, 8) for n in (1, 8, 12, 120, 720)] == [1, 8, 8, 15, 90]
    rows = spark.range(0, 400, 1, 40).selectExpr("cast(id % 7 as double) as x", "cast(id % 3 as double) as y")
    read = []
    fit = model.LogisticRegression.fit
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(model.LogisticRegression, "fit", lambda self, df: (read.append(df.rdd.getNumPartitions()), fit(self, df))[1])
        model.outcome_model(rows, rows, ["x"], "y", budgets=(2,))
    assert read == [8]


def test_joins_on_episodes_keep_the_partitions_of_a_large_log(spark, monkeypatch):
    """As many tasks as the log has partitions, and the same rewards; adaptive execution would join the session's to one."""
    from tallylane.plans import registry

    larger = "/root/testdata/sf0.01"  # no episode of the smallest is retained
    plain = sorted(relations._f03(Tables(spark, larger)).collect())
    monkeypatch.setattr(registry, "_PLANS", {})
    monkeypatch.setattr(testlog, "PARTITION_EVENTS", 500)
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = Tables(spark, larger)
        n, steps = t.log_partitions, (relations.trajectories, relations._f02, relations.retained_episodes, relations._f03)
        assert n > 8 and [step(t).rdd.getNumPartitions() for step in steps] == [n] * len(steps)
        dealt = sorted(relations._f03(t).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    assert dealt and [r[:3] for r in dealt] == [r[:3] for r in plain] and [r.reward for r in dealt] == pytest.approx([r.reward for r in plain], abs=1e-12)
