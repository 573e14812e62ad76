"""Prior medians, repertoires, episode selection and duplicate keys against plain loops and hand-computed cases."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallylane.keys import DEFAULT_KEYS as K
from tallylane.operators import audit, joins, prior

c = F.col
DAY = dt.date(2024, 1, 1)


def plain_quantile(rows, key, day, share):
    v = [x for k, d, x in rows if k == key and d is not None and d < day and x is not None and not math.isnan(x)]
    return (len(v), float(np.quantile(v, share)) if v else None)


@pytest.mark.parametrize("share", [0.5, 0.9])
def test_prior_quantile_equals_a_plain_loop(spark, share):
    """Key 1 owns a third of the rows; ties, nulls, NaN, null keys and dates, over 256 distinct values."""
    rng = random.Random(7)
    rows = []
    for _ in range(3000):
        key = 1 if rng.random() < 0.33 else rng.choice([None, *range(2, 12)])
        day = None if rng.random() < 0.02 else DAY + dt.timedelta(days=rng.randrange(25))
        x = rng.choice([None, float("nan"), 0.0, -0.0, float(rng.randrange(5)), rng.uniform(-50, 50), rng.gauss(0, 1e-3)])
        rows.append((key, day, x))
    df = spark.createDataFrame(rows, "k long, d date, x double")
    asked = sorted({(k, d) for k, d, _ in rows if d}, key=str) + [(99, DAY), (1, DAY + dt.timedelta(days=400))]
    got = {(r.k, r.d): (r.n, r.q) for r in prior.prior_quantile(df, spark.createDataFrame(asked + asked[:5], "k long, d date"), ["k"], "d", "x", share).collect()}
    assert set(got) == set(asked)
    for k, d in asked:
        n, q = plain_quantile(rows, k, d, share)
        assert got[k, d][0] == n
        assert (got[k, d][1] is None) == (q is None) and (q is None or abs(got[k, d][1] - q) < 1e-12)


def test_prior_quantile_of_all_rows_and_of_none(spark):
    df = spark.createDataFrame([(DAY, 1.0), (DAY, 3.0), (DAY + dt.timedelta(days=1), 100.0)], "d date, x double")
    days = spark.createDataFrame([(DAY + dt.timedelta(days=i),) for i in range(3)], "d date")
    got = {r.d: (r.n, r.q) for r in prior.prior_quantile(df, days, [], "d", "x").collect()}
    assert got == {DAY: (0, None), DAY + dt.timedelta(days=1): (2, 2.0), DAY + dt.timedelta(days=2): (3, 3.0)}
    assert [tuple(r)[1:] for r in prior.prior_quantile(df.limit(0), days.limit(1), [], "d", "x").collect()] == [(0, None)]


def test_recent_repertoire_forgets_old_days(spark):
    log = spark.createDataFrame([(1, DAY, "FF")] * 3 + [(1, DAY + dt.timedelta(days=5), "SL")] * 2 + [(1, DAY + dt.timedelta(days=5), None)], "p long, d date, t string")
    days = spark.createDataFrame([(1, DAY + dt.timedelta(days=i)) for i in (0, 5, 6, 11, 20)] + [(2, DAY)], "p long, d date")
    got = {(r.p, (r.d - DAY).days): r.repertoire for r in prior.recent_repertoire(log, days, "p", "d", "t", ["SL", "FF"], 10, 2).collect()}
    assert got == {(1, 0): "", (1, 5): "FF:3", (1, 6): "SL:2|FF:3", (1, 11): "SL:2", (1, 20): "", (2, 0): ""}


def test_selection_by_hand(spark):
    """Actor 1: no prior on the first day, then one cluster of two allowed; actor 2 enters an episode of actor 1; actor 3 is no cohort."""
    def event(game, ab, seq, day, pitcher, batter=7, low=1.5, high=3.5):
        return (game, ab, seq, DAY + dt.timedelta(days=day), pitcher, batter, "FF", low, high)

    log = spark.createDataFrame(
        [event(10, 1, 1, 0, 1), event(10, 1, 2, 0, 1), event(11, 1, 1, 1, 1), event(11, 2, 1, 1, 1, batter=8), event(11, 3, 1, 1, 1), event(11, 3, 2, 1, 2), event(12, 1, 1, 2, 1), event(13, 1, 1, 3, 3)],
        "game_pk long, at_bat_number long, pitch_number long, game_date date, pitcher long, batter long, pitch_type string, sz_bot double, sz_top double")
    flags = log.select("game_pk", "at_bat_number").distinct().withColumns({r: F.lit(False) for r in audit.REASONS}).withColumn("identity_changes", (c("game_pk") == 11) & (c("at_bat_number") == 3)).withColumn("supported", ~c("identity_changes"))
    out = audit.select_episodes(log, flags, K, spark.createDataFrame([(1,), (2,)], "pitcher long"), 1, ["FF"], days=30, least=2).cache()
    got = {(r.game_pk, r.at_bat_number, r.pitcher): (r.reason, r.repertoire, r.zone_bottom) for r in out.collect()}
    assert got == {
        (10, 1, 1): ("no_supported_prior_repertoire", "", None), (11, 1, 1): ("selected", "FF:2", 1.5), (11, 2, 1): ("selected", "FF:2", 1.5),
        (11, 3, 1): ("identity_changes", "FF:2", 1.5), (11, 3, 2): ("identity_changes", "", 1.5), (12, 1, 1): ("beyond_cluster_limit", "FF:5", 1.5), (13, 1, 3): ("not_in_cohort", "", 1.5)}
    cover = {r.pitcher: tuple(r)[1:] for r in audit.selection_coverage(out, K).select("pitcher", "clusters", "episodes", "supported", "selected_clusters", "selected_episodes", "selected_supported").collect()}
    assert cover == {1: (3, 5, 3, 1, 3, 2), 2: (1, 1, 0, 0, 0, 0)}


def test_conflicting_duplicates_stop_and_identical_ones_do_not(spark):
    rows = [(1, 0, "a"), (1, 1, "a"), (2, 0, "a"), (2, 1, None), (3, 0, "a"), (3, 1, "bad"), (4, 0, "bad"), (None, 0, "a"), (None, 1, "b")]
    df = spark.createDataFrame(rows, "k int, copy int, v string")
    early = [("null_key", c("k").isNull()), ("bad", F.coalesce(c("v") == "bad", F.lit(False)))]
    fates = audit.row_fates(df, early, ("identical", "conflicting", ["k"], ["copy"], ["v"]), [("late", c("k") == 9)])
    assert fates.columns == ["k", "copy", "v", "fate"]
    got = {(r.k, r.copy): r.fate for r in fates.collect()}
    assert got == {(1, 0): "accepted", (1, 1): "identical", (2, 0): "conflicting", (2, 1): "conflicting", (3, 0): "accepted", (3, 1): "bad", (4, 0): "bad", (None, 0): "null_key", (None, 1): "null_key"}
    stop = {r.fate: r.stop for r in audit.fate_census(fates, {"conflicting": 0.0}, ["identical"]).collect()}
    assert stop["conflicting"] and not stop["identical"]


def test_forecast_for_another_order_of_outcomes_is_refused(spark):
    labels = spark.createDataFrame([(1, 1, i, f"u{i}", leaf, "FF", "observer_local", 100) for i, leaf in ((1, 0), (2, 1), (3, 2), (4, None))], "game_pk long, at_bat_number long, pitch_number long, uid string, leaf int, kind string, clock string, first_received long")
    slots = {1: "start", 2: "after:u1", 3: "after:u2", 4: "after:u3"}
    fc = [(1, "A", slots[i], 1, i, "OK", "PRE_RECEIPT", 50, ["*"], order) for i, order in ((1, [0, 1]), (2, [1, 0]), (3, [0, 1]), (4, [0, 1]))]
    forecasts = spark.createDataFrame(fc, "game_pk long, model string, slot string, t_episode long, t_seq long, status string, timing string, generated long, kinds array<string>, leaves array<int>")
    got = {r.pitch_number: r.reason for r in joins.grade_forecasts(labels, forecasts, K, ["A"], [0, 1]).collect()}
    assert got == {1: "ELIGIBLE", 2: "LEAF_ORDER_MISMATCH", 3: "LABEL_UNMAPPED", 4: "LABEL_UNMAPPED"}
