"""Section I: policies and off-policy evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallylane.keys import DEFAULT_KEYS as K
from tallylane.operators import aggs, freq, ope, policy
from tallylane.operators.lineage import materialise
from tallylane.plans.aggregates import EP_CTE, _episodes, dirichlet
from tallylane.plans.encoders import IDS_CTE
from tallylane.plans.registry import query
from tallylane.plans.scoring import DRAWS, SEED, boot_sql

c = F.col
CELL = ["pitcher", "count_id"]

# per (actor, count, action): behaviour share, a value, and the tilted policy
QT_CTE = IDS_CTE + """,
qn AS (SELECT pitcher, count_id, action_id, count(*) AS n, avg(k) / 100.0 AS q FROM ids WHERE action_id >= 0 GROUP BY ALL),
qb AS (SELECT *, action_id // 25 AS pitch_id, n / sum(n) OVER (PARTITION BY pitcher, count_id) AS pb, max(q) OVER (PARTITION BY pitcher, count_id) AS qm FROM qn),
qt AS (SELECT pitcher, count_id, action_id, pitch_id, n, q, pb, pb * exp((q - qm) / 0.5) / sum(pb * exp((q - qm) / 0.5)) OVER (PARTITION BY pitcher, count_id) AS pe FROM qb),
qv AS (SELECT pitcher, count_id, sum(pe * q) AS v FROM qt GROUP BY 1, 2)
"""
ROWS_CTE = QT_CTE + """,
rr0 AS (SELECT i.*, qt.q, qt.pb, qt.pe, coalesce(qv.v, 0) AS v, i.action_id >= 0 AND qt.pb IS NOT NULL AS has FROM ids i LEFT JOIN qt ON qt.pitcher = i.pitcher AND qt.count_id = i.count_id AND qt.action_id = i.action_id LEFT JOIN qv ON qv.pitcher = i.pitcher AND qv.count_id = i.count_id),
rr AS (SELECT *, CASE WHEN has THEN CASE WHEN k % 31 = 0 THEN 0 ELSE least(pe / greatest(pb, 1e-12), 5.0) END ELSE 1 END AS rho FROM rr0),
rw AS (SELECT game_pk, at_bat_number, -sum(runs) AS r FROM log GROUP BY 1, 2),
ew AS (SELECT game_pk, at_bat_number, product(rho) AS w_product, sum(CASE WHEN has THEN rho ELSE 0 END) AS w_sum, sum(CASE WHEN has AND strikes = 2 THEN rho ELSE 0 END) AS w_subset, count_if(has) AS n_decisions, count_if(has AND strikes = 2) AS n_subset, count_if(has AND rho = 0) AS n_zero FROM rr GROUP BY 1, 2)
"""


def q_table(t):
    """Observed value and behaviour share per (actor, count, action), with a tilted target policy."""
    n = t.ids.where("action_id >= 0").groupBy(*CELL, "action_id").agg(F.count("*").alias("n"), (F.avg("k") / 100.0).alias("q"))
    n = n.withColumns({"pb": c("n") / F.sum("n").over(Window.partitionBy(*CELL)), "pitch_id": F.floor(c("action_id") / 25)})
    return policy.tilt(n, CELL, 0.5)


def ope_rows(t):
    qt = q_table(t)
    v = qt.groupBy(*CELL).agg(F.sum(c("pe") * c("q")).alias("v"))
    rows = ope.logged_ratios(t.ids, qt.select(*CELL, "action_id", "q", "pb", "pe"), CELL, 5.0).join(v, CELL, "left").fillna(0.0, ["v"])
    # some exact zeros, as a policy outside its support produces
    return rows.withColumn("rho", F.when(c("has") & (c("k") % 31 == 0), 0.0).otherwise(c("rho")))


def rewards(t):
    return t.log.groupBy(*K.episode_key).agg((-F.sum("runs")).alias("r"))


def weights(t):
    return ope.episode_weights(ope_rows(t), K, c("strikes") == 2)


@query("i01_reward_next_state", EP_CTE + """,
d AS (SELECT oid, b1, coalesce(r2.re, 0) + sa - sb - r1.re AS delta FROM ep JOIN re r1 ON r1.base_out_id = b1 LEFT JOIN re r2 ON r2.base_out_id = nb WHERE oid >= 3),
da AS (SELECT oid, b1, avg(delta) AS delta FROM d GROUP BY 1, 2),
g AS (SELECT s AS state_id, o AS outcome_id, s // 24 // 3 AS b, s // 24 % 3 AS k, s % 24 AS bo FROM range(288) x(s), range(11) y(o))
SELECT state_id, outcome_id, coalesce(-delta, 0) AS reward, CASE WHEN outcome_id = 0 AND b < 3 THEN ((b + 1) * 3 + k) * 24 + bo WHEN outcome_id = 1 AND k < 2 THEN (b * 3 + k + 1) * 24 + bo WHEN outcome_id = 2 THEN (b * 3 + least(k + 1, 2)) * 24 + bo ELSE -1 END AS next_state
FROM g LEFT JOIN da ON oid = outcome_id AND b1 = bo""", doubles=["reward"])
def _i01(t):
    ep = _episodes(t)
    return policy.reward_next(aggs.delta_expectancy(aggs.expectancy_change(ep, aggs.run_expectancy(ep))))


def solved(t, value, levels=None, rewards=None):
    return policy.solve(freq.dirichlet_factors(t.ids, "pitcher", 20.0, 40.0, 12, levels), _i01(t) if rewards is None else rewards, "pitcher", 40.0, value)


@query("i02_policy_optimisation", doubles=["q", "v"])
def _i02(t):
    """Optimal values over the full support; rows for used actions and the best one of every state."""
    return solved(t, "optimal").withColumn("converged", c("change") < 1e-9).drop("change")


@query("i03_policy_evaluation", doubles=["pi", "q", "v"])
def _i03(t):
    """Values of the uniform policy over the valid actions."""
    return solved(t, "uniform").withColumns({"pi": 1.0 / c("n_actions"), "converged": c("change") < 1e-9}).drop("change")


@query("i02_bellman_residual", IDS_CTE + """,
ty AS (SELECT pitcher, action_id // 25 AS g, count(*) AS n FROM ids WHERE action_id >= 0 AND outcome_id >= 0 GROUP BY 1, 2 HAVING count(*) >= 12)
SELECT pitcher, count(*) * 25 AS n_actions, 288::BIGINT AS states, true AS optimal, true AS consistent FROM ty GROUP BY 1""")
def _i02b(t):
    """Checked by joins, not by the solver: V is the best Q of its state, and Q of a used cell is its expected reward plus next value."""
    # the log's counts and the rewards are taken once for the solver and the check
    levels, gains = freq.dirichlet_levels(t.ids, "pitcher", 20.0, 40.0), materialise(_i01(t))
    q = materialise(solved(t, "optimal", levels, gains).select("pitcher", "state_id", "action_id", "q", "v", "n_actions"))
    cells = dirichlet(t, levels).drop("n_obs")
    v = q.select("pitcher", c("state_id").alias("next_state"), c("v").alias("next_v")).distinct()
    after = gains.crossJoin(F.broadcast(q.select("pitcher").distinct())).join(v, ["pitcher", "next_state"], "left")
    target = after.groupBy("pitcher", "state_id").agg(*[F.max(F.when(c("outcome_id") == o, c("reward") + F.coalesce("next_v", F.lit(0.0)))).alias(f"t{o}") for o in range(11)])
    expected = sum((c(f"p{o}") * c(f"t{o}") for o in range(1, 11)), c("p0") * c("t0"))
    used = q.join(cells, ["pitcher", "state_id", "action_id"]).join(target, ["pitcher", "state_id"]).groupBy("pitcher").agg(F.max(F.abs(expected - c("q"))).alias("gap"))
    best = q.groupBy("pitcher", "state_id").agg(F.max("q").alias("best"), F.max("v").alias("v"), F.max("n_actions").alias("n_actions"))
    best = best.groupBy("pitcher").agg(F.max("n_actions").alias("n_actions"), F.count("*").alias("states"), (F.max(F.abs(c("best") - c("v"))) < 1e-7).alias("optimal"))
    return best.join(used, "pitcher").withColumn("consistent", c("gap") < 1e-6).drop("gap")


@query("i04_relaxed_policies", QT_CTE + """,
s AS (SELECT *, exp((q - max(q) OVER w) / 0.05) AS e, rank() OVER (PARTITION BY pitcher, count_id ORDER BY q DESC) AS rk, q = max(q) OVER w AS g FROM qt WINDOW w AS (PARTITION BY pitcher, count_id))
SELECT pitcher, count_id, action_id, e / sum(e) OVER w AS softmax, (rk <= 5)::INT / sum((rk <= 5)::INT) OVER w AS topk, g::INT / sum(g::INT) OVER w AS greedy, 1 / count(*) OVER w AS uniform FROM s WINDOW w AS (PARTITION BY pitcher, count_id)""", doubles=["softmax", "topk", "greedy", "uniform"])
def _i04(t):
    q = q_table(t).select(*CELL, "action_id", "q")
    for m in ("softmax", "topk", "greedy", "uniform"):
        q = policy.relax(q, CELL, m, output=m)
    return q.drop("q")


@query("i05_tilted_policy", QT_CTE + " SELECT pitcher, count_id, action_id, pb, pe FROM qt", doubles=["pb", "pe"])
def _i05(t):
    return q_table(t).select(*CELL, "action_id", "pb", "pe")


@query("i06_support_restriction", QT_CTE + """,
su AS (SELECT DISTINCT pitcher, count_id, action_id FROM ids WHERE season > 2022 AND action_id >= 0),
k AS (SELECT * FROM qt SEMI JOIN su USING (pitcher, count_id, action_id))
SELECT pitcher, count_id, action_id, pe / sum(pe) OVER (PARTITION BY pitcher, count_id) AS pi FROM k""", doubles=["pi"])
def _i06(t):
    pol = q_table(t).select(*CELL, "action_id", c("pe").alias("pi"))
    return policy.restrict(pol, t.ids.where("season > 2022 and action_id >= 0").select(*CELL, "action_id"), CELL)


@query("i07_logged_ratios", ROWS_CTE + " SELECT game_pk, at_bat_number, pitch_number, has, rho FROM rr", doubles=["rho"])
def _i07(t):
    return ope_rows(t).select(*K.event, "has", "rho")


@query("i08_episode_weights", ROWS_CTE + " SELECT * FROM ew", doubles=["w_product", "w_sum", "w_subset"])
def _i08(t):
    return weights(t)


_EST = ["ips", "snips", "ess", "ess_frac", "w_max", "w_mean", "frac_zero"]


@query("i09_weighted_estimates", ROWS_CTE + """
SELECT avg(w * r) AS ips, sum(w * r) / sum(w) AS snips, sum(w) * sum(w) / sum(w * w) AS ess, sum(w) * sum(w) / sum(w * w) / count(*) AS ess_frac, max(w) AS w_max, avg(w) AS w_mean, count(*) AS n_episodes, avg((w = 0)::INT) AS frac_zero
FROM (SELECT w_product AS w, r FROM ew JOIN rw USING (game_pk, at_bat_number))""", doubles=_EST)
def _i09(t):
    return ope.weighted_estimates(weights(t).join(rewards(t), K.episode_key), "w_product", "r")


DR1_CTE = ROWS_CTE + """,
dt AS (SELECT game_pk, at_bat_number, sum(CASE WHEN has THEN rho ELSE 0 END) AS b, sum(CASE WHEN has THEN rho * q ELSE 0 END) AS rq, sum(CASE WHEN has THEN v ELSE 0 END) AS d, count_if(has) AS n FROM rr GROUP BY 1, 2),
dp AS (SELECT game_pk, at_bat_number, b * r - rq AS a, b, d, n FROM dt JOIN rw USING (game_pk, at_bat_number))
"""


def dr1_parts(t):
    return ope.dr1_parts(ope.onestep_terms(ope_rows(t), K).join(rewards(t), K.episode_key), "r")


@query("i10_onestep_dr", DR1_CTE + " SELECT (sum(a) + sum(d)) / sum(n) AS plain, sum(a) / sum(b) + sum(d) / sum(n) AS dr1, sum(d) / sum(n) AS direct, sum(a) / sum(b) AS correction FROM dp", doubles=["plain", "dr1", "direct", "correction"])
def _i10(t):
    return ope.dr1_estimate(dr1_parts(t))


TRAJ_CTE = ROWS_CTE + """,
t0 AS (SELECT *, product(rho) OVER w AS cum, row_number() OVER w AS st, coalesce(lead(v) OVER w, 0) AS vn, lead(v) OVER w IS NULL AS lst FROM rr WINDOW w AS (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number)),
t1 AS (SELECT *, avg(cum) OVER (PARTITION BY st) AS nm, vn - CASE WHEN has THEN q ELSE v END AS stp FROM t0),
t2 AS (SELECT *, CASE WHEN nm > 0 THEN cum / nm ELSE 0 END AS wd FROM t1),
tt AS (SELECT game_pk, at_bat_number, sum(CASE WHEN st = 1 THEN v ELSE 0 END) + sum(cum * stp) AS base_plain, sum(CASE WHEN st = 1 THEN v ELSE 0 END) + sum(wd * stp) AS base_wdr, sum(CASE WHEN lst THEN cum ELSE 0 END) AS w_last, sum(CASE WHEN lst THEN wd ELSE 0 END) AS w_last_wdr FROM t2 GROUP BY 1, 2)
"""
_TRAJ = ["base_plain", "base_wdr", "w_last", "w_last_wdr", "dr_plain", "dr_wdr"]


def trajectory(t):
    x = ope.trajectory_terms(ope_rows(t), K).join(rewards(t), K.episode_key)
    return x.withColumns({"dr_plain": c("base_plain") + c("w_last") * c("r"), "dr_wdr": c("base_wdr") + c("w_last_wdr") * c("r")})


@query("i11_trajectory_dr", TRAJ_CTE + " SELECT game_pk, at_bat_number, base_plain, base_wdr, w_last, w_last_wdr, base_plain + w_last * r AS dr_plain, base_wdr + w_last_wdr * r AS dr_wdr FROM tt JOIN rw USING (game_pk, at_bat_number)", doubles=_TRAJ)
def _i11(t):
    return trajectory(t).select(*K.episode_key, *_TRAJ)


_CI = ["estimate", "ci_low", "ci_high", "boot_sd"]


def _ci_sql(parts, est, cols, by=()):
    g = "".join(f"{x}, " for x in by)
    return f""",
cs AS ({parts}),{boot_sql('cs', cols, by)}
SELECT {''.join(f'p.{x}, ' for x in by)}any_value(p.est) AS estimate, any_value(p.clusters) AS clusters, quantile_cont(r.e, 0.025) AS ci_low, quantile_cont(r.e, 0.975) AS ci_high, stddev_pop(r.e) AS boot_sd, count(r.e) AS valid_draws
FROM (SELECT {g}{est} AS est, count(*) AS clusters FROM (SELECT * FROM cs) GROUP BY ALL) p JOIN (SELECT {g}draw, {est.replace('sum(', '(')} AS e FROM rep) r ON {' AND '.join(f'p.{x} = r.{x}' for x in by) or 'true'} GROUP BY {', '.join(f'p.{x}' for x in by) or 'ALL'}"""


@query("i12_paired_experiments", ROWS_CTE + _ci_sql("SELECT game_pk, sum(w_sum * r) AS xa, sum(w_sum) AS wa, sum(w_product * r) AS xb, sum(w_product) AS wb FROM ew JOIN rw USING (game_pk, at_bat_number) GROUP BY 1", "sum(xa) / sum(wa) - sum(xb) / sum(wb)", ["xa", "wa", "xb", "wb"]), doubles=_CI)
def _i12(t):
    """Difference of two self-normalised estimators on the same episodes."""
    ep = weights(t).join(rewards(t), K.episode_key)
    parts = {"xa": c("w_sum") * c("r"), "wa": c("w_sum"), "xb": c("w_product") * c("r"), "wb": c("w_product")}
    return ope.ratio_bootstrap(ep, "game_pk", parts, c("xa") / c("wa") - c("xb") / c("wb"), DRAWS, SEED)


@query("i13_cluster_bootstrap", DR1_CTE + _ci_sql("SELECT game_pk, sum(a) AS a, sum(b) AS b, sum(d) AS d, sum(n) AS n FROM dp GROUP BY 1", "sum(a) / sum(b) + sum(d) / sum(n)", ["a", "b", "d", "n"]), doubles=_CI)
def _i13(t):
    return ope.ratio_bootstrap(dr1_parts(t), "game_pk", {x: c(x) for x in "abdn"}, ope.dr1_value(), DRAWS, SEED)


BOUNDS_CTE = ROWS_CTE + """,
bd AS (SELECT e.game_pk, e.at_bat_number, w_sum AS w_candidate, n_decisions AS w_reference, n_zero = 0 AND n_decisions >= 3 AS complete, n_decisions > 0 AS in_population, w_sum - n_decisions AS delta,
   w_sum - n_decisions - n_zero AS lower, w_sum - n_decisions + n_zero + 0.5 AS upper, a.stand, a.p_throws FROM ew e JOIN (SELECT game_pk, at_bat_number, min(stand) AS stand, min(p_throws) AS p_throws FROM log GROUP BY 1, 2) a USING (game_pk, at_bat_number))
"""


def bounds(t):
    side = t.log.groupBy(*K.episode_key).agg(F.min("stand").alias("stand"), F.min("p_throws").alias("p_throws"))
    d = c("w_sum") - c("n_decisions")
    return weights(t).join(side, K.episode_key).select(
        *K.episode_key, "stand", "p_throws", c("w_sum").alias("w_candidate"), c("n_decisions").cast("double").alias("w_reference"), ((c("n_zero") == 0) & (c("n_decisions") >= 3)).alias("complete"),
        (c("n_decisions") > 0).alias("in_population"), d.alias("delta"), (d - c("n_zero")).alias("lower"), (d + c("n_zero") + 0.5).alias("upper"))


@query("i14_bounds_strata", BOUNDS_CTE + """
SELECT stand, p_throws, count(*) AS episodes, avg(lower) AS lower, avg(upper) AS upper, avg(in_population::INT) AS share, count_if(complete) AS n_complete,
  least(pow(sum(w_candidate) FILTER (complete), 2) / sum(w_candidate * w_candidate) FILTER (complete), pow(sum(w_reference) FILTER (complete), 2) / sum(w_reference * w_reference) FILTER (complete)) AS min_ess FROM bd GROUP BY GROUPING SETS ((), (stand), (p_throws))""", doubles=["lower", "upper", "share", "min_ess"])
def _i14(t):
    return ope.bounds_layer(bounds(t), [[], ["stand"], ["p_throws"]])


@query("i15_bounds_bootstrap", BOUNDS_CTE + """,
cs AS (SELECT game_pk, sum(lower) AS lo, sum(upper) AS hi, count(*) AS n, sum(CASE WHEN complete THEN delta ELSE 0 END) AS dc, count_if(complete) AS nc FROM bd GROUP BY 1),""" + boot_sql("cs", ["lo", "hi", "n", "dc", "nc"]) + """
SELECT (SELECT count(*) FROM cs) AS clusters, (SELECT CAST(sum(n) AS BIGINT) FROM cs) AS episodes, count_if(nc = 0) AS invalid, quantile_cont(lo / n, 0.025) AS lower_low, quantile_cont(lo / n, 0.975) AS lower_high, quantile_cont(hi / n, 0.025) AS upper_low, quantile_cont(hi / n, 0.975) AS upper_high,
  quantile_cont(dc / nc, 0.025) AS mean_low, quantile_cont(dc / nc, 0.975) AS mean_high FROM rep""", doubles=["lower_low", "lower_high", "upper_low", "upper_high", "mean_low", "mean_high"])
def _i15(t):
    return ope.bounds_bootstrap(bounds(t), "game_pk", DRAWS, SEED, 0.05, 3, 50)


@query("i16_earliest_violation", ROWS_CTE + """,
f AS (SELECT game_pk, at_bat_number, min_by(pitcher, pitch_number) AS pitcher, min(game_date) AS game_date FROM log GROUP BY 1, 2),
e AS (SELECT f.*, n_zero > 0 AS bad FROM f JOIN ew USING (game_pk, at_bat_number)),
m AS (SELECT pitcher, min((game_date, game_pk, at_bat_number)) AS mn FROM e WHERE bad GROUP BY 1)
SELECT game_pk, at_bat_number, e.pitcher, coalesce(mn < (game_date, game_pk, at_bat_number), false) AS after_violation FROM e LEFT JOIN m ON m.pitcher = e.pitcher""")
def _i16(t):
    first = t.log.groupBy(*K.episode_key).agg(F.min_by("pitcher", "pitch_number").alias("pitcher"), F.min("game_date").alias("game_date"))
    ep = first.join(weights(t), K.episode_key).withColumn("bad", c("n_zero") > 0)
    return ope.after_first_violation(ep, "pitcher", ["game_date", "game_pk", "at_bat_number"], "bad").select(*K.episode_key, "pitcher", "after_violation")


@query("i17_action_rank_gap", QT_CTE + """,
r AS (SELECT *, row_number() OVER (PARTITION BY pitcher, count_id ORDER BY q DESC, action_id) AS rk FROM qt WHERE n >= 2),
kd AS (SELECT pitcher, count_id, pitch_id, min(rk) AS best_rank, max(q) AS best_value, row_number() OVER (PARTITION BY pitcher, count_id ORDER BY min(rk)) AS type_rank FROM r GROUP BY 1, 2, 3),
tp AS (SELECT pitcher, count_id, pitch_id AS top_type, q AS top_value FROM r WHERE rk = 1)
SELECT game_pk, at_bat_number, pitch_number, top_type, best_rank, type_rank, 100 * (top_value - best_value) AS gap FROM ids i LEFT JOIN tp ON tp.pitcher = i.pitcher AND tp.count_id = i.count_id LEFT JOIN kd ON kd.pitcher = i.pitcher AND kd.count_id = i.count_id AND kd.pitch_id = i.pitch_id""", doubles=["gap"])
def _i17(t):
    table = q_table(t).where("n >= 2").select(*CELL, "action_id", "pitch_id", "q")
    return ope.action_ranks(table, t.ids, CELL).select(*K.event, "top_type", "best_rank", "type_rank", "gap")


@query("i18_member_agreement", QT_CTE + """,
m AS (SELECT pitcher, count_id, action_id, q AS a, q + action_id % 7 / CAST(50 AS DOUBLE) AS b, q - action_id % 5 / CAST(40 AS DOUBLE) AS d FROM qt),
r AS (SELECT *, rank() OVER (PARTITION BY pitcher, count_id ORDER BY a) + (count(*) OVER (PARTITION BY pitcher, count_id, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY pitcher, count_id ORDER BY b) + (count(*) OVER (PARTITION BY pitcher, count_id, b) - 1) / 2.0 AS rb,
  rank() OVER (PARTITION BY pitcher, count_id ORDER BY d) + (count(*) OVER (PARTITION BY pitcher, count_id, d) - 1) / 2.0 AS rd FROM m),
g AS (SELECT pitcher, count_id, max_by(action_id, (a, -action_id)) AS ta, max_by(action_id, (b, -action_id)) AS tb, max_by(action_id, (d, -action_id)) AS td, CASE WHEN count(DISTINCT ra) > 1 AND count(DISTINCT rb) > 1 THEN corr(ra, rb) END AS cab,
  CASE WHEN count(DISTINCT ra) > 1 AND count(DISTINCT rd) > 1 THEN corr(ra, rd) END AS cad, CASE WHEN count(DISTINCT rb) > 1 AND count(DISTINCT rd) > 1 THEN corr(rb, rd) END AS cbd FROM r GROUP BY 1, 2)
SELECT pitcher, count_id, ((ta = tb)::INT + (ta = td)::INT + (tb = td)::INT) / CAST(3 AS DOUBLE) AS pairwise_agreement, ta = tb AND ta = td AS all_agree, list_avg(list_filter([cab, cad, cbd], lambda x: x IS NOT NULL)) AS mean_spearman, CAST((cab IS NOT NULL)::INT + (cad IS NOT NULL)::INT + (cbd IS NOT NULL)::INT AS BIGINT) AS defined_pairs FROM g""", doubles=["pairwise_agreement", "mean_spearman"])
def _i18(t):
    m = q_table(t).select(*CELL, "action_id", c("q").alias("a"), (c("q") + c("action_id") % 7 / 50.0).alias("b"), (c("q") - c("action_id") % 5 / 40.0).alias("d"))
    return ope.member_agreement(m, CELL, "action_id", ["a", "b", "d"])


@query("i19_policy_matrix", ROWS_CTE + """,
pm AS (SELECT game_pk, judge, policy, w * v AS x, w FROM (SELECT game_pk, w_sum, n_decisions, r, n_zero FROM ew JOIN rw USING (game_pk, at_bat_number)) e,
   LATERAL (VALUES ('reward', 'candidate', w_sum, CAST(r AS DOUBLE)), ('reward', 'reference', CAST(n_decisions AS DOUBLE), CAST(r AS DOUBLE)), ('zeros', 'candidate', w_sum, CAST(n_zero AS DOUBLE)), ('zeros', 'reference', CAST(n_decisions AS DOUBLE), CAST(n_zero AS DOUBLE))) v(judge, policy, w, v))""" + _ci_sql("SELECT judge, policy, game_pk, sum(x) AS x, sum(w) AS w FROM pm GROUP BY 1, 2, 3", "sum(x) / sum(w)", ["x", "w"], ["judge", "policy"]), doubles=_CI)
def _i19(t):
    ep = weights(t).join(rewards(t), K.episode_key)
    cells = F.array(*[F.struct(F.lit(j).alias("judge"), F.lit(p).alias("policy"), c(w).cast("double").alias("w"), c(v).cast("double").alias("v"))
                      for j, v in (("reward", "r"), ("zeros", "n_zero")) for p, w in (("candidate", "w_sum"), ("reference", "n_decisions"))])
    long = ep.select("game_pk", F.explode(cells).alias("_x")).select("game_pk", "_x.*")
    return ope.ratio_bootstrap(long, "game_pk", {"x": c("w") * c("v"), "w": c("w")}, boot_ratio(), DRAWS, SEED, ["judge", "policy"])


def boot_ratio():
    return F.when(c("w") > 0, c("x") / c("w"))
