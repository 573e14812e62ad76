"""Hand-computed examples and properties."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallylane.functions import codes, hashing, states
from tallylane.functions.quantiles import exact_quantiles
from tallylane.keys import DEFAULT_KEYS as K
from tallylane.operators import aggs, boot, freq, model, ordered, policy, score


def expectancy_toy(spark):
    # game 1: two halves; game 1's last half is left out
    rows = []

    def pa(half, ab, outs, on1, score, post, event, pitches=1):
        side = "Top" if half % 2 == 0 else "Bot"
        for i in range(pitches):
            last = i == pitches - 1
            rows.append((1, half // 2 + 1, side, ab, i + 1, outs, on1, None, None, score, post if last else score, "hit_into_play" if last else "ball", event if last else None))

    pa(0, 1, 0, None, 0, 0, "single", 2)
    pa(0, 2, 0, 5, 0, 2, "home_run")
    pa(0, 3, 0, None, 2, 2, "field_out")
    pa(0, 4, 1, None, 2, 2, "field_out")
    pa(0, 5, 2, None, 2, 2, "field_out")
    pa(1, 6, 0, None, 0, 0, "field_out")
    schema = "game_pk bigint, inning int, inning_topbot string, at_bat_number bigint, pitch_number bigint, outs_when_up int, on_1b bigint, on_2b bigint, on_3b bigint, bat_score bigint, post_bat_score bigint, description string, events string"
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({"base_out_id": states.base_out_id(F.col("outs_when_up"), F.col("on_1b"), F.col("on_2b"), F.col("on_3b")), "outcome_id": codes.outcome11(F.col("description"), F.col("events"))})


def test_run_expectancy_by_hand(spark):
    ep = aggs.expectancy_episodes(expectancy_toy(spark), K)
    table = {r["base_out_id"]: (r["re"], r["n"]) for r in aggs.run_expectancy(ep).collect()}
    assert table[0] == (1.0, 2)  # runs to the end: 2 and 0
    assert table[1] == (2.0, 1)
    assert table[8] == (0.0, 1)
    delta = {(r["outcome_id"], r["base_out_id"]): r["delta"] for r in aggs.delta_expectancy(aggs.expectancy_change(ep, aggs.run_expectancy(ep))).where("n > 0").collect()}
    assert delta[(6, 0)] == pytest.approx(1.0)  # single, empty: 2 - 1
    assert delta[(9, 1)] == pytest.approx(1.0)  # home run, one on: 1 + 2 - 2


def test_state_codec_round_trip(spark):
    t = states.states_table(spark, 3, 4)
    back = t.select("state_id", states.state_id(F.col("count_id"), F.col("base_out_id"), F.col("cluster_id"), 3, F.col("context_id"), 4).alias("b"))
    assert back.where("b <> state_id").count() == 0 and t.count() == 288 * 12


def test_grid_edges_fall_in_the_upper_bin(spark):
    got = spark.createDataFrame([(x,) for x in (-1.0, -0.83, 0.0, 0.28, 0.83)], "x double").select(states.digitize(F.col("x"), states.X_EDGES).alias("b")).collect()
    assert [r["b"] for r in got] == [0, 1, 2, 3, 4]


def test_mod5_equals_the_big_integer(spark):
    import hashlib

    rows = spark.range(50).select("id", hashing.mod5(hashing.digest("ns", F.col("id"))).alias("m")).collect()
    for r in rows:
        assert r["m"] == int(hashlib.sha256(f"ns:{r['id']}".encode()).hexdigest(), 16) % 5


@pytest.mark.parametrize("values", [[1.0], [1.0, 1.0, 1.0, 9.0], list(np.random.default_rng(3).exponential(size=257)), [0.0] * 200 + [5.0, 7.0]])
def test_exact_quantiles(spark, values):
    probs = [0, 0.1, 0.25, 0.5, 0.9, 1]
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(values)], "v double, g int")
    got = exact_quantiles(df, "v", probs).collect()[0]
    assert got["n"] == len(values) and np.allclose(got["q"], np.quantile(values, probs))
    for r in exact_quantiles(df, "v", probs, ["g"]).collect():
        assert np.allclose(r["q"], np.quantile([v for i, v in enumerate(values) if i % 2 == r["g"]], probs))


def test_cumulative_ratio_with_zeros(spark):
    df = spark.createDataFrame([(1, 1, i + 1, r) for i, r in enumerate([2.0, 0.5, 0.0, 3.0])], "game_pk bigint, at_bat_number bigint, pitch_number bigint, rho double")
    got = [r["rho_cum"] for r in ordered.cumulative_ratio(df, K, "rho").orderBy("pitch_number").collect()]
    assert got == pytest.approx([2.0, 1.0, 0.0, 0.0])


def test_bootstrap_draws_every_slot(spark):
    sums = spark.range(37).select(F.col("id").alias("g"), F.lit(1.0).alias("n"), F.col("id").cast("double").alias("s"))
    rep = boot.bootstrap(sums, "g", ["n", "s"], 300, "t").collect()
    assert len(rep) == 300 and all(r["n"] == 37 for r in rep)
    means = np.array([r["s"] / r["n"] for r in rep])
    sd = np.arange(37).std() / math.sqrt(37)
    assert abs(means.mean() - 18) < 0.5 and 0.8 * sd < means.std() < 1.2 * sd


def test_draws_over_many_packs_are_multinomial():
    """Sizes of a draw add up over the packs, and have the mean and variance of a multinomial, as have the counts inside."""
    clusters, draws, size = 103, 4000, 8
    packs = -(-clusters // size)
    sizes = np.array([boot.pack_sizes("t", draws, clusters, p, size) for p in range(packs)])
    own = np.minimum(size, clusters - size * np.arange(packs))
    assert (sizes.sum(axis=0) == clusters).all()
    share = own / clusters
    assert np.allclose(sizes.mean(axis=1), own, rtol=0.05) and np.allclose(sizes.var(axis=1), clusters * share * (1 - share), rtol=0.12)
    assert abs(np.corrcoef(sizes[0], sizes[-2])[0, 1] + np.sqrt(share[0] * share[-2] / (1 - share[0]) / (1 - share[-2]))) < 0.05
    counts = np.concatenate([boot.drawn_sums(np.eye(n), sizes[p], np.arange(draws), "t", p) for p, n in enumerate(own)], axis=1)
    assert (counts.sum(axis=1) == clusters).all() and np.allclose(counts.mean(axis=0), 1, atol=0.08) and np.allclose(counts.var(axis=0), 1 - 1 / clusters, atol=0.15)
    few = boot.drawn_sums(np.eye(own[3]), sizes[3][100:110], np.arange(100, 110), "t", 3)
    assert (few == counts[100:110, 3 * size : 4 * size]).all()


@pytest.mark.parametrize("size", [boot.RANGE, 6])
def test_draws_do_not_depend_on_partitions_or_blocks(spark, monkeypatch, size):
    rows = [(g, i, float(i), None if i == 3 else 1.0) for g in ("a", "b") for i in range(20 if g == "a" else 1)]
    sums = spark.createDataFrame(rows, "h string, g long, s double, n double")

    def drawn(df, g):
        return {(r.h, r.draw): (r.s, r.n, r.n_clusters) for r in boot.bootstrap(df, g, ["s", "n"], 70, "t", ["h"], size).collect()}

    first = drawn(sums, "g")
    assert len(first) == 140 and {first[("b", d)] for d in range(70)} == {(0.0, 1.0, 1)}
    monkeypatch.setattr(boot, "BLOCK", 33)
    assert drawn(sums.repartition(7), "g") == first
    values = np.array([[r[2], r[3] or 0.0] for r in sorted((r for r in rows if r[0] == "a"), key=lambda r: hashlib.sha256(f"t:{r[1]}".encode()).hexdigest())])
    packs = [boot.drawn_sums(values[size * p : size * (p + 1)], boot.pack_sizes("t", 70, 20, p, size), np.arange(70), "t", p) for p in range(-(-20 // size))]
    assert np.allclose(sum(packs), [first[("a", d)][:2] for d in range(70)])


def test_one_cluster_has_no_interval(spark):
    log = spark.createDataFrame([("a", i % 4, 0.1 * i) for i in range(40)] + [("b", 1, 0.5)], "h string, g long, d double")
    got = {r.h: r for r in score.compare(log, "g", {"m": "d"}, 50, "t", ["h"]).collect()}
    assert got["b"].clusters == 1 and got["b"].p is None and got["b"].ci_low is None and got["a"].p is not None


def test_holm_by_hand(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", None), ("d", 0.03)], "k string, p double")
    got = {r["k"]: r["p_holm"] for r in score.holm(df, "p").collect()}
    assert got["a"] == pytest.approx(0.04) and got["d"] == pytest.approx(0.09) and got["b"] == pytest.approx(0.09) and got["c"] is None


def test_whole_percents_share_ties(spark):
    df = spark.createDataFrame([("g", x, n) for x, n in (("a", 1), ("b", 1), ("c", 1))], "g string, item string, n bigint")
    assert [r["percent"] for r in aggs.whole_percents(df, ["g"], "item").collect()] == [33, 33, 33]


def test_value_iteration_brute_force():
    """Two actions per state of a short chain, compared with enumerating all policies; next states by outcome, and by action too."""
    rng = np.random.default_rng(5)
    for by_action in (False, True):
        p = rng.dirichlet((1, 1), (3, 2))
        reward = rng.normal(size=(3, 2))
        after = np.array([[1, -1], [2, -1], [2, -1]]) if not by_action else np.array([[[1, -1], [2, -1]], [[2, -1], [-1, 2]], [[2, -1], [-1, -1]]])
        p = p * 0.9  # shorter than one, so that every policy ends
        q, v, sweeps, change = policy.iterate(p, reward, after, policy.VALUES["optimal"], max_iter=1000)

        def value(choice):
            own = np.zeros(3)
            for _ in range(800):
                own = policy.backup(p, reward, after, own)[np.arange(3), list(choice)]
            return own

        best = np.max([value(ch) for ch in itertools.product((0, 1), repeat=3)], axis=0)
        assert v == pytest.approx(best, abs=1e-6) and change < 1e-9 and sweeps < 1000
        assert policy.iterate(p, reward, after, policy.VALUES["optimal"], max_iter=2)[3] > 1e-9


def test_factors_give_the_smoothed_table(spark):
    """League cells, tilts and own counts put together equal the table of cells; states nobody has seen are solved too."""
    rng = np.random.default_rng(6)
    rows = [(int(a), int(s), int(g * 25 + rng.integers(3)), int(o)) for a, s, g, o in zip(rng.integers(0, 3, 600), rng.integers(0, 40, 600), rng.integers(0, 2, 600), rng.integers(0, 11, 600), strict=True)]
    log = spark.createDataFrame(rows, "pitcher long, state_id long, action_id long, outcome_id long")
    table = {(r.pitcher, r.state_id, r.action_id): r for r in freq.dirichlet_table(log, None, "pitcher", 20.0, 40.0, 12).collect()}
    league, tilts, own = freq.dirichlet_factors(log, "pitcher", 20.0, 40.0, 12)
    cell = {(r.state_id, r.action_id): np.array(r.p) for r in league.collect()}
    tilt = {(r.pitcher, r.count_id, r.pitch_id): np.array(r.tilt) for r in tilts.collect()}
    assert len(cell) == 288 * 225
    for r in own.collect():
        prior = cell[r.state_id, r.action_id] * tilt[r.pitcher, r.state_id // 24, r.action_id // 25]
        p = np.array(r.n) * (cell[r.state_id, r.action_id] > 0) + 40.0 * prior / prior.sum()
        assert p / p.sum() == pytest.approx([table[r.pitcher, r.state_id, r.action_id][f"p{o}"] for o in range(11)])
    rewards = spark.range(288 * 11).selectExpr("id div 11 as state_id", "id % 11 as outcome_id", "(id % 7) / 10.0 - 0.3D as reward", "case when id % 11 < 2 and id div 11 < 264 then id div 11 + 24 else -1L end as next_state")
    solved = policy.solve((league, tilts, own), rewards, "pitcher", 40.0).toPandas()
    assert solved.groupby("pitcher").state_id.nunique().tolist() == [288] * 3 and (solved.change < 1e-9).all()
    assert (solved.groupby(["pitcher", "state_id"]).q.max() - solved.groupby(["pitcher", "state_id"]).v.first()).abs().max() < 1e-9


def test_isotonic_lookup_takes_the_block_above_a_gap(spark):
    edges = model.upper_edges([0.1, 0.3, 0.5, 0.7], [0.2, 0.2, 0.6, 0.6])
    assert edges == [(0.3, 0.2), (0.7, 0.6)]
    got = [r.v for r in spark.createDataFrame([(x,) for x in (0.0, 0.3, 0.4, 0.7, 0.9)], "x double").select(model.step_value(F.col("x"), edges).alias("v")).collect()]
    assert got == [0.2, 0.2, 0.6, 0.6, 0.6]


