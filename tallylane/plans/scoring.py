"""Section K: forecast scoring on the labelled log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallylane.functions import probs
from tallylane.keys import DEFAULT_KEYS as K
from tallylane.operators import boot, score
from tallylane.plans.aggregates import DIRICHLET_CTE, dirichlet
from tallylane.plans.encoders import IDS_CTE
from tallylane.plans.registry import query

c = F.col
DRAWS, SEED = 10_000, "boot"


def _vec_sql(step, mod):
    raw = [f"(1 + vi * {i + step} % {mod})" for i in range(10)]
    tot = " + ".join(raw)
    return "[" + ", ".join(f"{r} / CAST({tot} AS DOUBLE)" for r in raw) + "]"


PRED_CTE = IDS_CTE + f""",
pred AS (SELECT *, y10 AS y, {_vec_sql(3, 17)} AS p, {_vec_sql(5, 13)} AS q FROM ids WHERE y10 >= 0),
loss AS (SELECT *, -ln(greatest(p[y + 1], 1e-12)) AS nll_p, list_sum(list_transform(p, lambda x: x * x)) - 2 * p[y + 1] + 1 AS brier_p,
  -ln(greatest(q[y + 1], 1e-12)) AS nll_q, list_sum(list_transform(q, lambda x: x * x)) - 2 * q[y + 1] + 1 AS brier_q FROM pred),
dl AS (SELECT *, nll_p - nll_q AS d_nll, brier_p - brier_q AS d_brier FROM loss),
top AS (SELECT game_pk, y, list_position(p, list_max(p)) - 1 AS a, list_max(p) AS conf, least(floor(list_max(p) * 10), 9)::BIGINT AS bin, list_position(q, list_max(q)) - 1 AS aq, list_max(q) AS confq, least(floor(list_max(q) * 10), 9)::BIGINT AS binq FROM pred)
"""


def mix_sql(rows, x, rest):
    """The rows with the mixed 32-bit word `h` of their word `x`, next to the columns `rest`."""
    a, b = boot.MIX
    return f"""(SELECT {rest}, xor(h2, h2 >> 16) AS h FROM (SELECT {rest}, (xor(h1, h1 >> 13) * {b}::UBIGINT) & 4294967295::UBIGINT AS h2 FROM (SELECT {rest}, (xor(h0, h0 >> 16) * {a}::UBIGINT) & 4294967295::UBIGINT AS h1 FROM (SELECT {rest}, ({x})::UBIGINT AS h0 FROM {rows}))))"""


def boot_sql(sums, cols, by=(), cluster="game_pk", draws=DRAWS, seed=SEED):
    """`rep`: resampled sums per group and draw, from the CTE `sums` with one row per (group, cluster), for groups of one pack."""
    b = "".join(f"{x}, " for x in by)
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    on = " AND ".join([*(f"i.{x} IS NOT DISTINCT FROM s.{x}" for x in by), "i.idx = s.idx"])
    salt = int(boot.mix(boot.np.array([boot.seed_word(seed)], "uint32"))[0])
    slots = mix_sql("bi", f"xor(idx::UBIGINT, {salt}::UBIGINT)", f"{b}g")
    drawn = mix_sql(f"{slots}, range({draws}) r(draw)", f"(h + draw::UBIGINT * {boot.SPREAD}::UBIGINT) & 4294967295::UBIGINT", f"{b}g, draw")
    return f"""
bi AS (SELECT *, row_number() OVER ({part}ORDER BY sha256('{seed}:' || {cluster})) - 1 AS idx, count(*) OVER ({part}) AS g FROM {sums}),
bs AS (SELECT {b}draw, CAST(floor(h / 4294967296.0::DOUBLE * g) AS BIGINT) AS idx FROM {drawn}),
rep AS (SELECT {''.join(f's.{x}, ' for x in by)}s.draw, {', '.join(f'sum(i.{x}) AS {x}' for x in cols)} FROM bs s JOIN bi i ON {on} GROUP BY ALL)"""


def predictions(t):
    def vec(step, mod):
        raw = [1 + c("vi") * (i + step) % mod for i in range(10)]
        tot = sum(raw[1:], raw[0]).cast("double")
        return F.array(*[r / tot for r in raw])

    return t._plan("pred", lambda: t.ids.where("y10 >= 0").withColumns({"y": c("y10"), "p": vec(3, 17), "q": vec(5, 13)}))


def deltas(t):
    return score.paired_deltas(predictions(t), "p", "q", "y")


@query("k01_probability_gate", PRED_CTE + """,
b AS (SELECT CASE WHEN k % 25 = 0 THEN list_transform(p, lambda x: x * 1.5) WHEN k % 33 = 0 THEN p[1:9] ELSE p END AS p, CASE WHEN k = 50 THEN 10 ELSE y END AS y FROM pred)
SELECT count(*) AS rows, count_if(len(p) <> 10) AS bad_length, 0::BIGINT AS not_finite, count_if(len(list_filter(p, lambda x: x < 0 OR x > 1)) > 0) AS outside_unit, count_if(abs(list_sum(p) - 1) > 1e-6) AS bad_mass, count_if(y NOT BETWEEN 0 AND 9) AS bad_label FROM b""")
def _k01(t):
    bad = predictions(t).withColumns({
        "p": F.when(c("k") % 25 == 0, F.transform("p", lambda x: x * 1.5)).when(c("k") % 33 == 0, F.slice("p", 1, 9)).otherwise(c("p")), "y": F.when(c("k") == 50, 10).otherwise(c("y"))})
    return score.probability_gate(bad, "p", "y", 10)


@query("k02_row_losses", PRED_CTE + " SELECT game_pk, at_bat_number, pitch_number, nll_p AS nll, brier_p AS brier FROM loss", doubles=["nll", "brier"])
def _k02(t):
    return score.with_losses(predictions(t), "p", "y").select(*K.event, "nll", "brier")


CLASS_CTE = """,
lg AS (SELECT y, a, unnest(range(10)) AS class, unnest(p) AS pr FROM (SELECT y, p, list_position(p, list_max(p)) - 1 AS a FROM pred)),
cell AS (SELECT class, least(floor(pr * 10), 9) AS b, count(*) AS n, count_if(y = class) AS pos, sum(pr) AS mass, sum(power(pr - (y = class)::INT, 2)) AS sq, count_if(a = class) AS ch, count_if(a = class AND y = class) AS tp FROM lg GROUP BY 1, 2),
cls AS (SELECT class, CAST(sum(pos) AS BIGINT) AS support, CAST(sum(ch) AS BIGINT) AS predicted, CASE WHEN sum(ch) > 0 THEN sum(tp) / sum(ch) END AS precision, CASE WHEN sum(pos) > 0 THEN sum(tp) / sum(pos) END AS recall,
  CASE WHEN sum(pos) > 0 THEN 2 * sum(tp) / (sum(pos) + sum(ch)) END AS f1, sum(pos) / sum(n) AS observed_rate, sum(mass) / sum(n) AS predicted_rate, sum(sq) / sum(n) AS brier, sum(abs(pos - mass)) / sum(n) AS ece FROM cell GROUP BY 1)
"""


@query("k03_metric_report", PRED_CTE + CLASS_CTE + """
SELECT count(*) AS n, avg(nll_p) AS log_loss, avg(brier_p) AS brier, (SELECT avg((a = y)::INT) FROM top) AS accuracy, (SELECT avg(f1) FROM cls) AS macro_f1,
  (SELECT sum(n * abs(acc - cf)) / sum(n) FROM (SELECT count(*) AS n, avg((a = y)::INT) AS acc, avg(conf) AS cf FROM top GROUP BY bin)) AS ece FROM loss""", doubles=["log_loss", "brier", "accuracy", "macro_f1", "ece"])
def _k03(t):
    return score.metric_report(predictions(t), "p", "y", 10)


@query("k03_reliability", PRED_CTE + " SELECT r.bin, count(t.y) AS n, avg((a = y)::INT) AS accuracy, avg(conf) AS confidence FROM range(10) r(bin) LEFT JOIN top t ON t.bin = r.bin GROUP BY 1", doubles=["accuracy", "confidence"])
def _k03b(t):
    return score.reliability(predictions(t), "p", "y")


@query("k03_class_report", PRED_CTE + CLASS_CTE + " SELECT * FROM cls", doubles=["precision", "recall", "f1", "observed_rate", "predicted_rate", "brier", "ece"])
def _k03c(t):
    return score.class_report(predictions(t), "p", "y", 10)


@query("k04_holdout_table_metrics", DIRICHLET_CTE + """,
hr AS (SELECT row_number() OVER () AS rid, i.outcome_id AS y, l2.o, l2.l2 AS p FROM ids i JOIN l2 ON l2.pitcher = i.pitcher AND l2.state_id = i.state_id AND l2.action_id = i.action_id WHERE i.season > 2022 AND i.outcome_id >= 0),
hx AS (SELECT i.event_id, i.outcome_id AS y, max(l2.l2) AS mp, min_by(l2.o, (-l2.l2, l2.o)) AS a, max(CASE WHEN l2.o = i.outcome_id THEN l2.l2 END) AS py FROM ids i JOIN l2 ON l2.pitcher = i.pitcher AND l2.state_id = i.state_id AND l2.action_id = i.action_id WHERE i.season > 2022 AND i.outcome_id >= 0 GROUP BY 1, 2),
he AS (SELECT o, least(floor(p * 15), 14) AS b, sum(p) AS s, count_if(y = o) AS ob, count(*) AS n FROM hr GROUP BY 1, 2)
SELECT count(*) AS n, avg(-ln(greatest(py, 1e-12))) AS nll, avg((a = y)::INT) AS top1, (SELECT avg(e) FROM (SELECT sum(abs(s - ob)) / sum(n) AS e FROM he GROUP BY o)) AS ece FROM hx""", doubles=["nll", "top1", "ece"])
def _k04(t):
    rows = t.ids.where("season > 2022 and outcome_id >= 0 and action_id >= 0").select("pitcher", "state_id", "action_id", "outcome_id")
    joined = rows.join(dirichlet(t).drop("n_obs"), ["pitcher", "state_id", "action_id"])
    return score.outcome_calibration(joined, [f"p{i}" for i in range(11)], "outcome_id", 15)


def _compare_sql(rows, metrics, by=(), upper=0.975, two_sided=False, tail=""):
    """SQL counterpart of score.compare over the CTE `rows`."""
    b = "".join(f"{x}, " for x in by)
    cols = [f"s_{m}" for m in metrics] + ["n"]
    same = " AND ".join(f"o.{x} IS NOT DISTINCT FROM r.{x}" for x in by) or "true"
    ext = "abs(v - d) >= abs(d)" if two_sided else "v - d <= d"
    obs = " UNION ALL ".join(f"SELECT {b}'{m}' AS metric, CAST(sum(n) AS BIGINT) AS n, count(*) AS clusters, sum(s_{m}) / sum(n) AS d FROM cs GROUP BY ALL" for m in metrics)
    rep = " UNION ALL ".join(f"SELECT {b}draw, '{m}' AS metric, s_{m} / n AS v FROM rep" for m in metrics)
    return f""",
cs AS (SELECT {b}game_pk, {', '.join(f'sum({col}) AS s_{m}' for m, col in metrics.items())}, count(*) AS n FROM {rows} GROUP BY ALL),{boot_sql('cs', cols, by)},
ob AS ({obs}), rl AS ({rep}),
cmp AS (SELECT {''.join(f'o.{x}, ' for x in by)}o.metric, any_value(o.n) AS n, any_value(clusters) AS clusters, any_value(d) AS delta, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high, quantile_cont(v, {upper}) AS upper,
  (1 + count_if({ext})) / {DRAWS + 1}.0 AS p FROM ob o JOIN rl r ON o.metric = r.metric AND {same} GROUP BY {''.join(f'o.{x}, ' for x in by)}o.metric)
{tail or 'SELECT * FROM cmp'}"""


_CMP = ["delta", "ci_low", "ci_high", "upper", "p"]
_NB = {"nll": "d_nll", "brier": "d_brier"}


@query("k05_paired_comparison", PRED_CTE + _compare_sql("dl", _NB), doubles=_CMP)
def _k05(t):
    return score.compare(deltas(t), "game_pk", _NB, DRAWS, SEED)


_ECE_COLS = [f"g_{t}{b}" for t in "ab" for b in range(10)]


def _ece_sql(tag):
    return "(" + " + ".join(f"abs(g_{tag}{b})" for b in range(10)) + ") / n"


@query("k06_multi_metric_bootstrap", PRED_CTE + """,
es AS (SELECT game_pk, """ + ", ".join([f"sum(CASE WHEN bin = {b} THEN (a = y)::INT - conf ELSE 0 END) AS g_a{b}" for b in range(10)] + [f"sum(CASE WHEN binq = {b} THEN (aq = y)::INT - confq ELSE 0 END) AS g_b{b}" for b in range(10)]) + """, count(*) AS n FROM top GROUP BY 1),""" + boot_sql("es", [*_ECE_COLS, "n"]) + f""",
pt AS (SELECT {', '.join(f'sum({x}) AS {x}' for x in [*_ECE_COLS, 'n'])} FROM es), rr AS (SELECT {_ece_sql('a')} - {_ece_sql('b')} AS e FROM rep)
SELECT {_ece_sql('a')} AS candidate, {_ece_sql('b')} AS control, {_ece_sql('a')} - {_ece_sql('b')} AS delta, (SELECT quantile_cont(e, 0.025) FROM rr) AS ci_low, (SELECT quantile_cont(e, 0.975) FROM rr) AS ci_high, (SELECT stddev_pop(e) FROM rr) AS boot_sd, (SELECT count(e) FROM rr) AS valid_draws FROM pt""",
  doubles=["candidate", "control", "delta", "ci_low", "ci_high", "boot_sd"])
def _k06(t):
    return score.calibration_comparison(predictions(t), "game_pk", "p", "q", "y", DRAWS, SEED)


@query("k07_holm", PRED_CTE + _compare_sql("dl", _NB, ["p_throws", "stand"], tail="""
, h AS (SELECT *, CASE WHEN n >= 500 THEN p END AS pm, row_number() OVER (ORDER BY CASE WHEN n >= 500 THEN p END ASC NULLS LAST) AS kk, count(*) OVER () AS m FROM cmp)
SELECT p_throws, stand, metric, pm AS p, CASE WHEN pm IS NOT NULL THEN max(least((m - kk + 1) * pm, 1.0)) OVER (ORDER BY kk) END AS p_holm FROM h"""), doubles=["p", "p_holm"])
def _k07(t):
    """Tests below 500 events keep their slot in the family but get no adjusted value."""
    r = score.compare(deltas(t), "game_pk", _NB, DRAWS, SEED, ["p_throws", "stand"])
    return score.holm(r.withColumn("p", F.when(c("n") >= 500, c("p"))), "p").select("p_throws", "stand", "metric", "p", "p_holm")


@query("k08_decision_label", PRED_CTE + _compare_sql("dl", _NB, ["stand"], tail="""
, w AS (SELECT stand, max(delta) FILTER (metric = 'nll') AS d, max(ci_low) FILTER (metric = 'nll') AS lo, max(ci_high) FILTER (metric = 'nll') AS hi, max(ci_low) FILTER (metric = 'brier') AS bl, max(ci_high) FILTER (metric = 'brier') AS bh, max(p) FILTER (metric = 'nll') AS p FROM cmp GROUP BY 1),
s AS (SELECT stand, count_if(m < 0) AS imp FROM (SELECT stand, vi % 3 AS sd, avg(d_nll) AS m FROM dl GROUP BY 1, 2) GROUP BY 1)
SELECT stand, imp AS seeds_improved, CASE WHEN p IS NULL THEN 'unmeasured' WHEN d <= -0.003 AND hi < 0 AND p <= 0.05 AND bh <= 0.001 AND imp >= 2 THEN 'predictive_improvement' WHEN lo > 0 OR bl > 0.001 THEN 'worse_or_guardrail_failure' ELSE 'inconclusive' END AS decision FROM w JOIN s USING (stand)"""))
def _k08(t):
    d = deltas(t)
    r = score.compare(d, "game_pk", _NB, DRAWS, SEED, ["stand"])

    def pick(metric, col):
        return F.max(F.when(c("metric") == metric, c(col)))

    wide = r.groupBy("stand").agg(pick("nll", "delta").alias("d"), pick("nll", "ci_low").alias("lo"), pick("nll", "ci_high").alias("hi"), pick("brier", "ci_low").alias("bl"), pick("brier", "ci_high").alias("bh"), pick("nll", "p").alias("p"))
    seeds = d.groupBy("stand", (c("vi") % 3).alias("sd")).agg(F.avg("d_nll").alias("m")).groupBy("stand").agg(F.count_if(c("m") < 0).alias("seeds_improved"))
    out = wide.join(seeds, "stand")
    return out.select("stand", "seeds_improved", score.decision(c("d"), c("lo"), c("hi"), c("bl"), c("bh"), c("p"), c("seeds_improved"), 2).alias("decision"))


GROUPS = {"hand_L": "p_throws = 'L'", "hand_R": "p_throws = 'R'", "side_L": "stand = 'L'", "side_R": "stand = 'R'", "two_strikes": "strikes = 2", "less_two_strikes": "strikes < 2",
          "runners_on": "on_1b is not null or on_2b is not null or on_3b is not null", "bases_empty": "on_1b is null and on_2b is null and on_3b is null"}
ALPHA = 1 - 0.05 / 16


@query("k09_group_guardrails", PRED_CTE + ", gd AS (" + " UNION ALL ".join(f"SELECT '{g}' AS \"group\", game_pk, d_nll, d_brier FROM dl WHERE {w}" for g, w in GROUPS.items()) + ")" + _compare_sql("gd", _NB, ['"group"'], ALPHA, tail="""
SELECT *, CASE WHEN clusters >= 30 AND n >= 500 THEN 'reporting_eligible' ELSE 'unmeasured_for_guardrail' END AS status, CASE WHEN clusters >= 30 AND n >= 500 THEN upper <= CASE metric WHEN 'nll' THEN 0.010 ELSE 0.002 END END AS passed FROM cmp"""), doubles=_CMP)
def _k09(t):
    g = score.explode_groups(deltas(t), {n: F.expr(w) for n, w in GROUPS.items()})
    return score.guardrails(score.compare(g, "game_pk", _NB, DRAWS, SEED, ["group"], upper=ALPHA))


@query("k10_group_interaction", PRED_CTE + """,
ls AS (SELECT game_pk, sum(CASE WHEN pitcher % 3 = 0 THEN d_nll ELSE 0 END) AS sl, sum((pitcher % 3 = 0)::INT) AS nl, sum(CASE WHEN pitcher % 3 = 1 THEN d_nll ELSE 0 END) AS sh, sum((pitcher % 3 = 1)::INT) AS nh FROM dl WHERE pitcher % 3 < 2 GROUP BY 1),""" + boot_sql("ls", ["sl", "nl", "sh", "nh"]) + """,
rr AS (SELECT CASE WHEN nl > 0 AND nh > 0 THEN sl / nl - sh / nh END AS e FROM rep)
SELECT sum(sl) / sum(nl) - sum(sh) / sum(nh) AS delta, (SELECT quantile_cont(e, 0.025) FROM rr) AS ci_low, (SELECT quantile_cont(e, 0.975) FROM rr) AS ci_high, (SELECT stddev_pop(e) FROM rr) AS boot_sd, (SELECT count(e) FROM rr) AS valid_draws FROM ls""", doubles=["delta", "ci_low", "ci_high", "boot_sd"])
def _k10(t):
    return score.interaction(deltas(t), "game_pk", "d_nll", c("pitcher") % 3 == 0, c("pitcher") % 3 == 1, DRAWS, SEED)


@query("k11_factorial_contrasts", PRED_CTE + """,
cr AS (SELECT game_pk, nll_p - nll_q AS main_a, brier_p - brier_q AS main_b, nll_p - nll_q - brier_p + brier_q AS inter FROM loss)""" + _compare_sql("cr", {"main_a": "main_a", "main_b": "main_b", "interaction": "inter"}, two_sided=True), doubles=_CMP)
def _k11(t):
    """Linear contrasts of the four loss cells, two-sided."""
    l = score.with_losses(score.with_losses(predictions(t), "p", "y", "_p"), "q", "y", "_q")
    l = l.withColumns({"main_a": c("nll_p") - c("nll_q"), "main_b": c("brier_p") - c("brier_q"), "inter": c("nll_p") - c("nll_q") - c("brier_p") + c("brier_q")})
    return score.compare(l, "game_pk", {"main_a": "main_a", "main_b": "main_b", "interaction": "inter"}, DRAWS, SEED, two_sided=True)


@query("k12_scenario_comparison", PRED_CTE + """,
sp AS (SELECT game_pk, scenario, stand, -ln(greatest((CASE WHEN scenario = 'mask50' THEN 0.5 ELSE 0.8 END) * p[y + 1] + (CASE WHEN scenario = 'mask50' THEN 0.5 ELSE 0.2 END) * 0.1, 1e-12)) - nll_p AS d FROM loss, (VALUES ('mask20'), ('mask50')) v(scenario))""" + _compare_sql("sp", {"nll": "d"}, ["scenario", "stand"]), doubles=_CMP)
def _k12(t):
    """Loss under two degradations of the forecast against the clean one, per scenario and side."""
    l = score.with_losses(predictions(t), "p", "y")
    l = l.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(w).alias("w")) for n, w in (("mask20", 0.8), ("mask50", 0.5))]))).select("*", "_s.*")
    l = l.withColumn("d", -F.log(F.greatest(c("w") * probs.at(c("p"), c("y")) + (1 - c("w")) * 0.1, F.lit(1e-12))) - c("nll"))
    return score.compare(l, "game_pk", {"nll": "d"}, DRAWS, SEED, ["scenario", "stand"])


@query("k13_subgroup_decomposition", PRED_CTE + """,
gs AS (SELECT balls, game_pk, sum(d_nll) AS s, count(*) AS n FROM dl GROUP BY 1, 2),""" + boot_sql("gs", ["s", "n"], ["balls"]) + """,
ci AS (SELECT balls, quantile_cont(s / n, 0.025) AS ci_low, quantile_cont(s / n, 0.975) AS ci_high, stddev_pop(s / n) AS boot_sd, count(*) AS valid_draws FROM rep GROUP BY 1)
SELECT balls, CAST(sum(n) AS BIGINT) AS events, count(*) AS clusters, sum(s) / sum(n) AS mean_delta, sum(s) / (SELECT sum(n) FROM gs) AS contribution, (SELECT sum(s) / sum(n) FROM gs) AS total, any_value(ci_low) AS ci_low, any_value(ci_high) AS ci_high, any_value(boot_sd) AS boot_sd, any_value(valid_draws) AS valid_draws
FROM gs JOIN ci USING (balls) GROUP BY balls""", doubles=["mean_delta", "contribution", "total", "ci_low", "ci_high", "boot_sd"])
def _k13(t):
    return score.subgroup_decomposition(deltas(t), "balls", "game_pk", "d_nll", DRAWS, SEED)
