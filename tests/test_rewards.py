"""Successor rules and terminal rewards by hand."""

import pytest
from pyspark.sql import functions as F

from tallylane.operators import audit, rewards, score

STATE = "inning int, inning_topbot string, outs_when_up int, bases int, home_score int, away_score int, event string"
SHARES = "event string, bases int, outs_when_up int, out_delta int, to_bases int, adv_runs int, n long, cell long"


def after(spark, *states):
    """Successors by rule alone."""
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(states)], f"i int, {STATE}")
    out = rewards.advance(df.withColumns(rewards.rule_successor(F.col("event"), F.col("bases"), F.col("outs_when_up"))))
    return [(r.next_inning, r.next_inning_topbot, r.next_outs_when_up, r.next_bases, r.next_home_score, r.next_away_score, r.winner) for r in out.orderBy("i").collect()]


def test_rules_by_hand(spark):
    cases = [
        ((1, "Top", 0, 0, 0, 0, "walk"), (1, "Top", 0, 1, 0, 0, None)),
        ((1, "Top", 0, 2, 0, 0, "walk"), (1, "Top", 0, 3, 0, 0, None)),
        ((1, "Top", 0, 5, 0, 0, "hbp"), (1, "Top", 0, 7, 0, 0, None)),
        ((1, "Bot", 1, 7, 2, 3, "walk"), (1, "Bot", 1, 7, 3, 3, None)),
        ((3, "Top", 2, 5, 1, 1, "strikeout"), (3, "Bot", 0, 0, 1, 1, None)),
        ((3, "Bot", 2, 5, 1, 1, "out"), (4, "Top", 0, 0, 1, 1, None)),
        ((3, "Bot", 0, 5, 1, 1, "double_play"), (3, "Bot", 2, 4, 1, 1, None)),
        ((3, "Bot", 1, 4, 1, 1, "double_play"), (3, "Bot", 2, 4, 1, 1, None)),
        ((3, "Bot", 1, 1, 1, 1, "double_play"), (4, "Top", 0, 0, 1, 1, None)),
        ((5, "Top", 0, 6, 0, 0, "single"), (5, "Top", 0, 5, 0, 1, None)),
        ((5, "Top", 0, 7, 0, 0, "double"), (5, "Top", 0, 6, 0, 2, None)),
        ((5, "Top", 0, 7, 0, 0, "triple"), (5, "Top", 0, 4, 0, 3, None)),
        ((5, "Bot", 0, 7, 0, 0, "home_run"), (5, "Bot", 0, 0, 4, 0, None)),
        ((9, "Bot", 0, 6, 3, 3, "double"), (9, "Bot", 0, 2, 4, 3, "home")),
        ((9, "Bot", 1, 7, 3, 3, "home_run"), (9, "Bot", 1, 0, 7, 3, "home")),
        ((9, "Bot", 2, 0, 3, 4, "out"), (9, "Bot", 2, 0, 3, 4, "away")),
        ((9, "Top", 2, 0, 5, 4, "out"), (9, "Top", 2, 0, 5, 4, "home")),
        ((9, "Top", 2, 0, 4, 4, "out"), (9, "Bot", 0, 0, 4, 4, None)),
        ((9, "Bot", 2, 3, 4, 4, "out"), (10, "Top", 0, 2, 4, 4, None)),
        ((10, "Top", 2, 0, 4, 5, "out"), (10, "Bot", 0, 2, 4, 5, None))]
    assert after(spark, *(a for a, _ in cases)) == [b for _, b in cases]


def test_reward_is_the_expectation_for_the_first_defender(spark):
    """Two observed successors and five pseudo-observations of the rule: value .5 + .05 * outs for the home side."""
    shares = spark.createDataFrame([("single", 1, 0, 0, 5, 0, 3, 4), ("single", 1, 0, 1, 1, 1, 1, 4)], SHARES)
    ep = spark.createDataFrame([(1, 1, "Top", 0, 1, 0, 0, "single"), (2, 1, "Bot", 0, 1, 0, 0, "single"), (3, 1, "Top", 0, 0, 0, 0, "out"), (4, 9, "Bot", 0, 1, 3, 3, "single"), (5, 1, "Top", 0, 1, 0, 0, "single")], f"k int, {STATE}")
    value = 0.5 + 0.05 * F.col("outs_when_up")
    found = {r.k: r.reward for r in rewards.terminal_rewards(ep, shares, value, ["k"]).collect()}
    single = 3 / 9 * 0.5 + 1 / 9 * 0.55 + 5 / 9 * 0.5
    walkoff = 3 / 9 * 0.5 + 1 / 9 * 1.0 + 5 / 9 * 0.5
    assert found == pytest.approx({1: single, 2: 1 - single, 3: 0.55, 4: 1 - walkoff, 5: single})
    pairs = ep.drop("k").distinct()
    total = rewards.successors(pairs, shares, 5.0).groupBy(*rewards.STATE, "event").agg(F.sum("probability").alias("p")).collect()
    assert [r.p for r in total] == pytest.approx([1.0] * 4)
    assert rewards.terminal_rewards(ep.limit(0), shares, value, ["k"]).count() == 0
    none = {r.k: r.reward for r in rewards.terminal_rewards(ep, shares.limit(0), value, ["k"]).collect()}
    assert none == pytest.approx({1: 0.5, 2: 0.5, 3: 0.55, 4: 0.5, 5: 0.5})


def test_fitted_value_is_the_model(spark):
    from tallylane.functions import features

    names = [f"w{i}" for i in range(16)]
    rows = spark.createDataFrame([(5, "Bot", 1, 5, 3, 2, 1, None, 1), (9, "Top", 2, 0, 0, 4, None, None, None)], "inning int, inning_topbot string, outs_when_up int, bases int, home_score int, away_score int, on_1b int, on_2b int, on_3b int")
    weights = [0.1 * i - 0.5 for i in range(16)]
    design = features.winner_design()
    plain = 1 / (1 + F.exp(-(sum((design[n] * w for n, w in zip(names, weights, strict=True)), F.lit(0.25)))))
    for r in rows.select(rewards.fitted_value(weights, 0.25, names).alias("a"), plain.alias("b")).collect():
        assert r.a == pytest.approx(r.b)


def test_masks_tell_missing_support_from_an_unsupported_action(spark):
    pairs = spark.createDataFrame([(1, "a"), (1, "c"), (2, "x"), (1, "a")], "actor int, action string")
    assert {r.actor: r["mask"] for r in audit.support_masks(pairs, "actor", "action", ["a", "b", "c"]).collect()} == {1: 5, 2: 0}
    got = spark.createDataFrame([("a",), ("c",), ("x",), (None,)], "action string").select(audit.action_number("action", ["a", "b", "c"]).alias("i")).collect()
    assert [r.i for r in got] == [0, 2, None, None]


def test_binary_report_by_hand(spark):
    rows = spark.createDataFrame([("g", 0.5, True), ("g", 0.5, False), ("h", 1.0, True), ("h", 0.92, False)], "k string, p double, y boolean")
    r = score.binary_report(rows, "p", "y", "k").first()
    import math

    assert (r.rows, r.clusters) == (4, 2)
    assert r.log_loss == pytest.approx(-(2 * math.log(0.5) + math.log(1 - 1e-12) + math.log(0.08)) / 4)
    assert r.brier == pytest.approx((0.25 + 0.25 + 0.92**2) / 4, abs=1e-9) and r.ece == pytest.approx(abs(1.92 - 1) / 4)
