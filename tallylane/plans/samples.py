"""Sections G and L: samples, panels, clusters, calibration and hooks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallylane.functions import features, probs
from tallylane.functions.quantiles import exact_quantiles, with_row
from tallylane.keys import DEFAULT_KEYS as K
from tallylane.operators import aggs, asof, freq, model, ordered, sample, score
from tallylane.operators.lineage import materialise
from tallylane.plans.encoders import IDS_CTE
from tallylane.plans.ordered import OUTS_CTE, REFERENCE_CTE, terminal, with_outs
from tallylane.plans.registry import query
from tallylane.plans.scoring import PRED_CTE, predictions

c = F.col
KEY = K.event
SEED = "panel"


def u_sql(x):
    return f"(('0x' || substr(sha256({x}), 1, 13))::BIGINT / 4503599627370496.0)"


@query("g01_hash_holdout", "SELECT pitcher, list_sum(list_transform(string_split(sha256('hold:' || pitcher), ''), lambda ch: ('0x' || ch)::INT)) % 5 = 0 AS held_out FROM (SELECT DISTINCT pitcher FROM log)")
def _g01(t):
    return sample.hash_holdout(t.log, "pitcher", "hold")


@query("g02_nested_samples", OUTS_CTE + """,
g AS (SELECT game_pk, min(date_trunc('month', game_date))::DATE AS month, least(3, CAST(ceil(avg((pitcher = starter)::INT::DOUBLE) * 4) - 1 AS INT)) AS band0 FROM outs GROUP BY 1),
h AS (SELECT game_pk, month, greatest(band0, 0) AS role_band FROM g),
r AS (SELECT *, (row_number() OVER (PARTITION BY month, role_band ORDER BY sha256('nest:' || game_pk)) - 0.5) / count(*) OVER (PARTITION BY month, role_band) AS at_ FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY at_, month, role_band, game_pk) AS p_, count(*) OVER () AS n_ FROM r)
SELECT game_pk, month, role_band, p_ <= ceil(n_ * 0.25) AS in_25, p_ <= ceil(n_ * 0.5) AS in_50, p_ <= n_ AS in_100 FROM p""")
def _g02(t):
    """Strata are months and quarters of the starters' share of a cluster's events."""
    band = F.greatest(F.lit(0), F.ceil(F.avg((c("pitcher") == c("starter")).cast("double")) * 4) - 1).cast("int")
    clusters = with_outs(t.log).groupBy("game_pk").agg(F.min(F.trunc("game_date", "month")).alias("month"), band.alias("role_band"))
    return sample.nested_samples(clusters, "game_pk", ["month", "role_band"], "nest", [0.25, 0.5, 1.0])


@query("g03_stratified_panel", OUTS_CTE + f""",
a AS (SELECT pitcher, count(*) AS events, count_if(pitcher = starter) AS s, min(p_throws) AS h FROM outs WHERE season <= 2023 GROUP BY 1), q AS (SELECT quantile_cont(events, 0.25) AS lo, quantile_cont(events, 0.75) AS hi FROM a),
b AS (SELECT pitcher, events, CASE WHEN s * 2 >= events THEN 'starter' ELSE 'relief' END AS role, h AS hand, CASE WHEN events <= lo THEN 'low' WHEN events <= hi THEN 'middle' ELSE 'high' END AS volume FROM a, q),
r AS (SELECT *, row_number() OVER (PARTITION BY role, hand, volume ORDER BY sha256('{SEED}|' || pitcher), pitcher) AS cell_rank FROM b)
SELECT *, cell_rank <= 4 AS selected FROM r""")
def _g03(t):
    return sample.stratified_panel(with_outs(t.log).where("season <= 2023"), K, "starter", 4, SEED)


@query("g04_interleaved_requests", f"SELECT game_pk, at_bat_number, pitch_number, row_number() OVER w AS role_rank, row_number() OVER w <= 50 AS selected FROM log WINDOW w AS (PARTITION BY p_throws ORDER BY sha256('{SEED}|' || game_pk || '|' || at_bat_number || '|' || pitch_number), game_pk, at_bat_number, pitch_number)")
def _g04(t):
    return sample.interleaved_requests(t.log.select(*KEY, "p_throws"), "p_throws", KEY, SEED, 50).select(*KEY, "role_rank", "selected")


@query("g05_exclusion_regimes", """
h AS (SELECT *, batter % 9 = 0 AS held FROM log), ap AS (SELECT batter, game_pk, game_date, row_number() OVER (PARTITION BY batter ORDER BY game_date, game_pk) AS kk FROM (SELECT DISTINCT batter, game_pk, game_date FROM h WHERE held)),
pd AS (SELECT batter, max(game_date) AS pd FROM ap WHERE kk <= 2 GROUP BY 1)
SELECT h.game_pk, at_bat_number, pitch_number, NOT bool_or(held) OVER (PARTITION BY h.game_pk, at_bat_number) AS fit, coalesce(held AND kk <= 2, false) AS prefix, coalesce(held AND kk > 2 AND h.game_date > pd, false) AS evaluate
FROM h LEFT JOIN ap ON ap.batter = h.batter AND ap.game_pk = h.game_pk LEFT JOIN pd ON pd.batter = h.batter""")
def _g05(t):
    held = t.log.where("batter % 9 = 0").select("batter").distinct()
    return sample.exclusion_regimes(t.log, K, held, "batter", 2).select(*KEY, "fit", "prefix", "evaluate")


_KS = "game_pk || '|' || at_bat_number || '|' || pitch_number"
_MID = "0.5 / 4503599627370496.0"


@query("g06_stress", f"""
x AS (SELECT *, coalesce(pitch_type, 'NA') AS code, {u_sql(f"'st|missing|' || {_KS}")} + {_MID} AS u,
  release_speed + 0.3 * sqrt(-2 * ln({u_sql(f"'st|release_speed:u|' || {_KS}")} + {_MID})) * cos(2 * pi() * ({u_sql(f"'st|release_speed:v|' || {_KS}")} + {_MID})) AS z FROM log),
h AS (SELECT *, list({{'code': code, 'u': u, 'z': z}}) OVER (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS h FROM x)
SELECT game_pk, at_bat_number, pitch_number, coalesce(array_to_string(list_transform(h, lambda t: t.code), ','), '') AS "full", coalesce(array_to_string(list_transform(h[greatest(len(h) - 1, 1):], lambda t: t.code), ','), '') AS last2,
  coalesce(array_to_string(list_transform(list_filter(h, lambda t: t.u >= 0.2), lambda t: t.code), ','), '') AS mask20, coalesce(array_to_string(list_transform(list_filter(h, lambda t: t.u >= 0.5), lambda t: t.code), ','), '') AS mask50,
  coalesce(array_to_string(list_transform(h, lambda t: 'UNKNOWN'), ','), '') AS masked_identity, coalesce(list_sum(list_transform(h, lambda t: coalesce(t.z, 0))), 0) AS noisy_sum FROM h""", doubles=["noisy_sum"])
def _g06(t):
    return sample.stress(t.log, K, "pitch_type", "release_speed", 5, "st", 0.3)


@query("g07_draw_pool", """
n AS (SELECT *, row_number() OVER (PARTITION BY pitcher, pitch_type ORDER BY sha256('pool:' || event_id), event_id) AS d0, count(*) OVER (PARTITION BY pitcher, pitch_type) AS n0, row_number() OVER (PARTITION BY pitch_type ORDER BY sha256('pool:' || event_id), event_id) AS d1 FROM log WHERE pitch_type IS NOT NULL AND plate_x IS NOT NULL)
SELECT 0 AS tier, pitcher || '|' || pitch_type AS "group", d0 AS draw, event_id FROM n WHERE d0 <= 5 AND n0 >= 15 UNION ALL SELECT 1, pitch_type, d1, event_id FROM n WHERE d1 <= 5""")
def _g07(t):
    rows = t.log.where("pitch_type is not null and plate_x is not null")
    return sample.draw_pool(rows, [(["pitcher", "pitch_type"], 15), (["pitch_type"], 1)], ["event_id"], 5, "pool")


@query("g08_fixture_cut", "SELECT event_id, pitcher, game_pk FROM log l SEMI JOIN (SELECT pitcher, min_by(game_pk, (game_date, game_pk)) AS game_pk FROM log GROUP BY 1) USING (pitcher, game_pk)")
def _g08(t):
    return sample.first_cluster(t.log, K).select("event_id", "pitcher", "game_pk")


@query("g09_side_clusters")
def _g09(t):
    """k-means numbering depends on the initialisation, so this is checked by properties."""
    style = aggs.style_table(t.log, ["batter", "stand"])
    return model.side_clusters(style, "stand", ["L", "R"], "batter", ["k_rate", "bb_rate", "swing_rate", "contact_rate"], 3, c("n_pa") >= 3, "k_rate")


@query("g09_cluster_check", "SELECT stand, count(DISTINCT batter) AS actors, true AS numbered_by_centre, true AS own_side FROM log GROUP BY 1")
def _g09b(t):
    """Fitted rows of a side are numbered upwards by their mean of the ordering rate, and a side has numbers of its own."""
    style = aggs.style_table(t.log, ["batter", "stand"]).select("batter", "stand", "k_rate")
    rows = _g09(t).join(style, ["batter", "stand"])
    means = rows.where("not is_default").groupBy("stand", "cluster_id").agg(F.avg("k_rate").alias("m"))
    before = F.lag("m").over(Window.partitionBy("stand").orderBy("cluster_id"))
    order = means.withColumn("up", F.coalesce(c("m") >= before, F.lit(True))).groupBy("stand").agg(F.bool_and("up").alias("numbered_by_centre"))
    side = F.when(c("stand") == "L", 0).otherwise(1)
    sides = rows.groupBy("stand").agg(F.countDistinct("batter").alias("actors"), F.bool_and(F.floor(c("cluster_id") / 3) == side).alias("own_side"))
    return sides.join(order, "stand").select("stand", "actors", "numbered_by_centre", "own_side")


@query("g10_soft_clusters")
def _g10(t):
    style = asof.style_history(t.log, K, terminal())
    rates = [f"{s}_prior" for s in asof.STYLES]
    out = model.soft_clusters(style, rates, [f"{s}_weight" for s in asof.STYLES], "batter", 5, "isolated_power_prior")
    return out.select("batter", "game_date", *[c("membership")[i].alias(f"m{i}") for i in range(5)])


@query("g10_membership_check", "SELECT batter, count(DISTINCT game_date) AS snapshots, true AS sums_to_one, true AS positive FROM log GROUP BY 1")
def _g10b(t):
    m = [c(f"m{i}") for i in range(5)]
    return _g10(t).groupBy("batter").agg(
        F.count("*").alias("snapshots"), F.bool_and(F.abs(sum(m[1:], m[0]) - 1) < 1e-9).alias("sums_to_one"), F.bool_and(F.least(*m) >= 0).alias("positive"))


@query("g11_actor_clusters")
def _g11(t):
    shares = {"left": c("p_throws") == "L", **{f"t_{x}": F.coalesce(c("pitch_type") == x, F.lit(False)) for x in ("FF", "SI", "SL", "CU", "CH")}}
    return model.actor_clusters(t.log, "pitcher", ["release_speed", "release_spin_rate", "pfx_x", "pfx_z"], shares, 4)


WINNER = [f"w{i}" for i in range(1, 16)]


def winner_rows(t):
    """Design of every event of finished clusters, with the final winner."""
    log = t.log.join(ordered.cluster_completion(t.log, K).where("complete"), "game_pk")
    return log.select(*KEY, "season", "final_home_win", *[e.alias(n) for n, e in features.winner_design().items() if n != "w0"])


def winner_fit(t):
    """Winner model on the first events of the episodes of the training seasons, and the names of its columns."""
    rows = winner_rows(t).where("pitch_number = 1 and season <= 2022")
    return model.winner_model(rows, "final_home_win", WINNER, ["w1", "w2"], 0.01), WINNER


@query("g12_winner_model")
def _g12(t):
    """Predicted final-winner probability of every event of finished clusters."""
    m, cols = winner_fit(t)
    return model.predict(m, winner_rows(t), cols).select(*KEY, "final_home_win", c("p")[1].alias("p_home"))


@query("g12_winner_evaluation")
def _g12e(t):
    """Loss and calibration of the winner model on the first events of the later seasons' episodes."""
    m, cols = winner_fit(t)
    held = winner_rows(t).where("pitch_number = 1 and season > 2022")
    p = model.predict(m, held, cols).select("game_pk", "final_home_win", c("p")[1].alias("p_home"))
    return score.binary_report(p, "p_home", "final_home_win", "game_pk")


OUTCOMES = 11
CHANNELS = ["x", "zn", "speed", "move_x", "move_z"]


def outcome_design(t):
    """Rows with a known outcome, part (0 fit, 1 early stop, 2 held out), scaled channels and their hinges, count and sides.

    The early-stop part is the last fifth of the training seasons' dates; scalers and knots see the fit part alone.  Count and sides
    are -0.5 and 0.5, which moves the model's intercepts alone: with zeros in them, spark.ml would keep the rows as sparse blocks,
    whose products take several times as long as those of dense ones.
    """
    def half(condition):
        return F.coalesce(condition.cast("double"), F.lit(0.0)) - 0.5

    phys = features.physical_channels()
    rows = t.ids.where("outcome_id >= 0").select(*KEY, "season", "game_date", c("outcome_id").cast("double").alias("label"), *[phys[x].alias(x) for x in CHANNELS], "balls", "strikes",
                                                 half(c("stand") == "L").alias("left"), half(c("stand") == c("p_throws")).alias("same"))
    rows = materialise(rows)  # the log is derived once, not again for the dates
    days = rows.where("season <= 2022").select(F.unix_date("game_date").alias("day")).distinct()
    cut = exact_quantiles(days, "day", [0.8]).select(c("q")[0]).first()[0]  # one number
    rows = rows.withColumn("part", F.when(c("season") > 2022, 2).when(F.unix_date("game_date") > F.lit(cut).cast("double"), 1).otherwise(0))
    z = materialise(features.apply_scaler(rows, features.fit_scaler(rows.where("part = 0"), CHANNELS, 1e-8), CHANNELS, clip=features.HINGE_CLIP))
    z = features.hinge_table(z, z.where("part = 0"), [f"{x}_z" for x in CHANNELS])
    balls, strikes = [f"b{i}" for i in (1, 2, 3)], [f"s{i}" for i in (1, 2)]
    z = z.withColumns({n: half(c(col) == int(n[1])) for col, names in (("balls", balls), ("strikes", strikes)) for n in names})
    names = [f"{x}_z{h}" for x in CHANNELS for h in ("", "_h1", "_h2", "_h3")] + balls + strikes + ["left", "same"]
    return materialise(z.select(*KEY, "part", "label", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])), names


def outcome_fit(t):
    rows, names = outcome_design(t)
    m, history = model.outcome_model(rows.where("part = 0"), rows.where("part = 1"), names, "label")
    return m, history, rows, names


def outcome_predictions(m, rows, names):
    """Shares of all outcomes for the held-out rows; an outcome that the fit never saw has share 0."""
    p = model.predict(m, rows.where("part = 2").select(*KEY, "label", *names), names)
    return p.select(*KEY, "label", *[F.coalesce(F.get("p", F.lit(i)), F.lit(0.0)).alias(f"p{i}") for i in range(OUTCOMES)])


@query("g13_outcome_model")
def _g13(t):
    m, _, rows, names = outcome_fit(t)
    return outcome_predictions(m, rows, names)


@query("g13_probability_check", IDS_CTE + """,
e AS (SELECT outcome_id AS y FROM ids WHERE outcome_id >= 0 AND season > 2022)
SELECT y AS label, count(*) AS n, true AS sums_to_one, true AS better_than_shares, true AS stopped_at_best FROM e GROUP BY 1""")
def _g13b(t):
    """Shares sum to one, the mean loss over all held-out rows beats the fit part's own shares, and no fit had a lower loss on the early-stop part."""
    m, history, rows, names = outcome_fit(t)
    p = [c(f"p{i}") for i in range(OUTCOMES)]
    scored = outcome_predictions(m, rows, names).withColumn("_p", F.array(*p))
    fit = rows.where("part = 0")
    base = fit.groupBy("label").agg(F.count("*").alias("_n")).join(F.broadcast(fit.agg(F.count("*").alias("_all")))).select("label", F.array_repeat(c("_n") / c("_all"), OUTCOMES).alias("_p"))
    plain = model.log_loss(rows.where("part = 2").select("label").join(F.broadcast(base), "label", "left"), "_p", "label")
    better = model.log_loss(scored, "_p", "label") < plain
    held = model.predict(m, rows.where("part = 1").select(*KEY, "label", *names), names)
    kept = model.log_loss(held, "p", "label") <= min(h[2] for h in history) + 1e-5
    return scored.groupBy(c("label").cast("long").alias("label")).agg(
        F.count("*").alias("n"), F.bool_and(F.abs(sum(p[1:], p[0]) - 1) < 1e-9).alias("sums_to_one")).withColumns({"better_than_shares": F.lit(better), "stopped_at_best": F.lit(kept)})


def _grid_sql(rows, loss, low, high, by=(), points=9, rounds=3):
    """Successive grids in SQL."""
    b = "".join(f"{x}, " for x in by)
    join = " AND ".join(f"r.{x} = s.{x}" for x in by) or "true"
    sql = f"gs0 AS (SELECT {b}CAST({low} AS DOUBLE) AS lo, CAST({high} AS DOUBLE) AS hi FROM {rows} GROUP BY ALL)" if by else f"gs0 AS (SELECT CAST({low} AS DOUBLE) AS lo, CAST({high} AS DOUBLE) AS hi)"
    for i in range(1, rounds + 1):
        sql += f""",
gm{i} AS MATERIALIZED (SELECT {''.join(f's.{x}, ' for x in by)}j, s.lo, s.hi, s.lo + (s.hi - s.lo) * j / {points - 1} AS tt, avg({loss}) AS nll FROM (SELECT *, lo + (hi - lo) * j / {points - 1} AS t FROM gs{i - 1}, range({points}) g(j)) s JOIN {rows} r ON {join} GROUP BY ALL),
gb{i} AS (SELECT * FROM (SELECT *, row_number() OVER ({'PARTITION BY ' + ', '.join(by) if by else ''} ORDER BY nll, tt) AS rn FROM gm{i}) WHERE rn = 1),
gs{i} AS (SELECT {b}greatest(tt - (hi - lo) / {points - 1}, {low}) AS lo, least(tt + (hi - lo) / {points - 1}, {high}) AS hi FROM gb{i})"""
    return sql + f" SELECT {b}tt AS best, nll FROM gb{rounds}"


@query("g14_temperature_fit", PRED_CTE + "," + _grid_sql("pred", "-ln(greatest(power(greatest(p[y + 1], 1e-12), 1 / t) / list_sum(list_transform(p, lambda x: power(greatest(x, 1e-12), 1 / s.t))), 1e-12))", 0.5, 2.5, ["stand"]), doubles=["best", "nll"])
def _g14(t):
    """Best temperature per side over three grid rounds."""
    rows = predictions(t).select("stand", "y", "p")
    terms = [F.greatest(c("p")[i], F.lit(probs.NLL_FLOOR)) for i in range(10)]

    def loss(temp):
        s = sum((F.pow(x, 1 / temp) for x in terms[1:]), F.pow(terms[0], 1 / temp))
        return -F.log(F.greatest(F.pow(F.greatest(probs.at(c("p"), c("y")), F.lit(probs.NLL_FLOOR)), 1 / temp) / s, F.lit(probs.NLL_FLOOR)))

    return model.grid_fit(rows, loss, 0.5, 2.5, ["stand"])


@query("g14_blend_fit", PRED_CTE + "," + _grid_sql("pred", "-ln(greatest(s.t * p[y + 1] + (1 - s.t) * q[y + 1], 1e-12))", 0.0, 1.0), doubles=["best", "nll"])
def _g14b(t):
    rows = predictions(t).select(probs.at(c("p"), c("y")).alias("a"), probs.at(c("q"), c("y")).alias("b"))
    return model.grid_fit(rows, lambda w: -F.log(F.greatest(w * c("a") + (1 - w) * c("b"), F.lit(probs.NLL_FLOOR))), 0.0, 1.0)


@query("g15_isotonic")
def _g15(t):
    rows = predictions(t).select(*KEY, "season", "y", "p")
    n = len(rows.select("p").first()["p"])
    out = model.isotonic_classes(rows.where("season <= 2022"), rows.where("season > 2022"), "p", "y", n)
    return out.select(*KEY, *[c("p_iso")[i].alias(f"p{i}") for i in range(n)])


@query("g16_reference_means", REFERENCE_CTE + ", q AS (SELECT DISTINCT pitcher, pitch_type FROM log WHERE pitch_type IS NOT NULL) SELECT q.pitcher, q.pitch_type, coalesce(ra.m, rb.m, rg.m) AS ref_release_speed, CASE WHEN ra.m IS NOT NULL THEN 2 WHEN rb.m IS NOT NULL THEN 1 ELSE 0 END AS origin FROM q LEFT JOIN ra ON ra.pitcher = q.pitcher AND ra.pitch_type = q.pitch_type LEFT JOIN rb ON rb.pitch_type = q.pitch_type, rg", doubles=["ref_release_speed"])
def _g16(t):
    tiers = [["pitcher", "pitch_type"], ["pitch_type"]]
    train = t.log.where("season <= 2022 and release_speed is not null and pitch_type is not null")
    rows = t.log.where("pitch_type is not null").select("pitcher", "pitch_type").distinct()
    return freq.tiered_lookup(rows, freq.tiered_means(train, tiers, ["release_speed"], [8, 1]), tiers, ["release_speed"])


@query("g17_fraction_sample", f"""
g AS (SELECT DISTINCT game_pk, home_team, away_team, {u_sql("'fs:' || game_pk")} < 0.4 AS sampled FROM log), t AS (SELECT game_pk, home_team AS team, sampled FROM g UNION ALL SELECT game_pk, away_team, sampled FROM g)
SELECT team, count(DISTINCT CASE WHEN sampled THEN game_pk END) AS sampled_clusters, count(DISTINCT game_pk) AS clusters, count(DISTINCT CASE WHEN sampled THEN game_pk END) >= 4 AS covered FROM t GROUP BY 1""")
def _g17(t):
    g = t.log.select("game_pk", "home_team", "away_team").distinct()
    return sample.team_coverage(sample.fraction_sample(g, "game_pk", "fs", 0.4), "game_pk", ["home_team", "away_team"], 4)


@query("l01_batch_scoring", IDS_CTE + " SELECT game_pk, at_bat_number, pitch_number, CASE WHEN release_speed IS NULL THEN 'missing_speed' END AS abstain, CASE WHEN release_speed IS NOT NULL THEN 1 / (1 + exp(-(release_speed - 90) / 5)) END AS p_high FROM ids", doubles=["p_high"])
def _l01(t):
    """A user's scorer over Arrow batches, with an abstain reason."""
    def predict(pdf):
        import numpy as np
        speed = pdf["release_speed"].to_numpy(dtype=float)
        out = pdf[KEY].copy()
        out["abstain"] = np.where(np.isnan(speed), "missing_speed", None)
        out["p_high"] = 1 / (1 + np.exp(-(speed - 90) / 5))
        return out

    scored = model.score_batches(t.ids.select(*KEY, "release_speed"), predict, "game_pk bigint, at_bat_number bigint, pitch_number bigint, abstain string, p_high double")
    return scored.withColumn("p_high", F.when(~F.isnan("p_high"), c("p_high")))


@query("l02_label_hook", IDS_CTE + " SELECT label, count(*) AS n FROM (SELECT CASE WHEN y10 IN (3, 9) THEN 'out' WHEN y10 BETWEEN 4 AND 7 THEN 'hit' WHEN y10 < 0 THEN 'none' ELSE 'other' END AS label FROM ids) GROUP BY 1")
def _l02(t):
    """A label is any Column -> Column callable."""
    def label(y):
        return F.when(y.isin(3, 9), "out").when(y.between(4, 7), "hit").when(y < 0, "none").otherwise("other")

    return t.ids.groupBy(label(c("y10")).alias("label")).agg(F.count("*").alias("n"))
