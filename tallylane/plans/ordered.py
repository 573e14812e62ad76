"""Section E: windows over the ordered log, and the as-of family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallylane.functions import codes
from tallylane.keys import DEFAULT_KEYS as K
from tallylane.operators import asof, freq, ordered
from tallylane.plans.registry import query

c = F.col
KEY = ["game_pk", "at_bat_number", "pitch_number"]
W = "PARTITION BY game_pk, at_bat_number ORDER BY pitch_number"
G = "PARTITION BY game_pk ORDER BY at_bat_number, pitch_number"
PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
IMPLIED = """CASE WHEN events IN ('field_out','strikeout','force_out','fielders_choice_out','sac_fly','sac_bunt') THEN 1
  WHEN events IN ('grounded_into_double_play','double_play','strikeout_double_play','sac_fly_double_play') THEN 2 WHEN events = 'triple_play' THEN 3 ELSE 0 END"""
OUTS_CTE = f"""
o0 AS (SELECT *, lead(outs_when_up) OVER g AS no, lead(inning) OVER g AS ni, lead(inning_topbot) OVER g AS nt, lead(pitcher) OVER g AS np, {IMPLIED} AS implied FROM log WINDOW g AS ({G})),
o1 AS (SELECT *, no IS NOT NULL AND ni = inning AND nt = inning_topbot AS same_half FROM o0),
o2 AS (SELECT *, CASE WHEN same_half THEN no - outs_when_up WHEN no IS NOT NULL THEN 3 - outs_when_up ELSE implied END AS outs_recorded, coalesce(same_half AND np <> pitcher, false) AS chg FROM o1),
outs AS (SELECT *, CASE WHEN chg THEN greatest(outs_recorded - implied, 0) ELSE 0 END AS extra,
   first_value(pitcher) OVER s AS starter, first_value(inning) OVER s = 1 AND first_value(outs_when_up) OVER s = 0 AS starter_valid,
   CASE WHEN inning_topbot = 'Top' THEN home_team ELSE away_team END AS fielding_team
   FROM o2 WINDOW s AS (PARTITION BY game_pk, inning_topbot ORDER BY at_bat_number, pitch_number))
"""
TERMINAL = "(is_last AND events IS NOT NULL AND events <> 'truncated_pa')"


def with_outs(log):
    out = ordered.starters(ordered.interval_outs(log, K), K)
    return out.withColumn("fielding_team", F.when(c("inning_topbot") == "Top", c("home_team")).otherwise(c("away_team")))


def terminal():
    return F.coalesce(c("is_last") & (c("events") != "truncated_pa"), F.lit(False))


@query("e01_episode_first_last", """
SELECT game_pk, at_bat_number, min_by(inning, pitch_number) AS inning, min_by(outs_when_up, pitch_number) AS first_outs_when_up, min_by(bat_score, pitch_number) AS first_bat_score,
  max_by(coalesce(events, '-'), pitch_number) AS last_event, max_by(post_bat_score, pitch_number) AS last_post_bat_score, count(*) AS n_events FROM log GROUP BY 1, 2""")
def _e01(t):
    log = t.log.withColumn("event", F.coalesce("events", F.lit("-")))
    return ordered.episodes(log, K, ["outs_when_up", "bat_score"], ["event", "post_bat_score"], ["inning"])


@query("e02_previous_event", f"""
SELECT game_pk, at_bat_number, pitch_number, coalesce(lag(pitch_type) OVER w, 'START') AS prev_pitch_type, coalesce(lag(description) OVER w, 'START') AS prev_description,
  lag(plate_x) OVER w AS prev_plate_x FROM log WINDOW w AS ({W})""", doubles=["prev_plate_x"])
def _e02(t):
    return ordered.previous_event(t.log, K, {"pitch_type": "START", "description": "START", "plate_x": None}).select(*KEY, "prev_pitch_type", "prev_description", "prev_plate_x")


@query("e03_next_state", f"""
SELECT game_pk, at_bat_number, pitch_number, CASE WHEN {TERMINAL} THEN lead(outs_when_up) OVER g END AS next_outs_when_up, CASE WHEN {TERMINAL} THEN lead(inning) OVER g END AS next_inning,
  CASE WHEN {TERMINAL} THEN lead(inning_topbot) OVER g END AS next_inning_topbot, CASE WHEN {TERMINAL} THEN lead(home_score) OVER g END AS next_home_score FROM log WINDOW g AS ({G})""")
def _e03(t):
    cols = ["outs_when_up", "inning", "inning_topbot", "home_score"]
    return ordered.next_state(t.log, K, cols, terminal()).select(*KEY, *[f"next_{x}" for x in cols])


@query("e04_interval_outs", OUTS_CTE + """
SELECT game_pk, at_bat_number, pitch_number, implied AS outs_event_implied, outs_recorded, chg AS outs_interval_change, extra AS outs_ambiguous_extra,
  outs_recorded NOT BETWEEN 0 AND 3 OR outs_when_up + outs_recorded > 3 AS outs_invalid FROM outs""")
def _e04(t):
    return ordered.interval_outs(t.log, K).select(*KEY, "outs_event_implied", "outs_recorded", "outs_interval_change", "outs_ambiguous_extra", "outs_invalid")


@query("e05_starters", OUTS_CTE + "SELECT game_pk, at_bat_number, pitch_number, starter, starter_valid, pitcher = starter AS is_starter FROM outs")
def _e05(t):
    return ordered.starters(t.log, K).select(*KEY, "starter", "starter_valid", (c("pitcher") == c("starter")).alias("is_starter"))


@query("e06_prior_date_rate", f"""
f AS (SELECT batter, game_date, sum({TERMINAL}::INT) AS pa, sum(({TERMINAL} AND events IN ('single','double','triple','home_run','walk','intent_walk','hit_by_pitch'))::INT) AS ob,
  sum(({TERMINAL} AND events NOT IN ('sac_bunt','catcher_interf'))::INT) AS den, sum(({TERMINAL} AND events IN ('strikeout','strikeout_double_play'))::INT) AS so FROM log GROUP BY 1, 2),
p AS (SELECT batter, game_date, coalesce(sum(pa) OVER w, 0) AS pa, coalesce(sum(ob) OVER w, 0) AS ob, coalesce(sum(den) OVER w, 0) AS den, coalesce(sum(so) OVER w, 0) AS so
  FROM f WINDOW w AS (PARTITION BY batter ORDER BY game_date {PRIOR}))
SELECT l.game_pk, l.at_bat_number, l.pitch_number, pa AS pa_prior, (ob + 30 * 0.32) / (den + 30) AS reach_prior, (so + 30 * 0.22) / (pa + 30) AS strikeout_prior FROM log l JOIN p USING (batter, game_date)""",
  doubles=["reach_prior", "strikeout_prior"])
def _e06(t):
    rate = asof.smoothed_prior_rate(t.log, K, terminal())
    return t.log.select(*KEY, "batter", "game_date").join(rate, ["batter", "game_date"]).select(*KEY, "pa_prior", "reach_prior", "strikeout_prior")


_STYLE_NUM = [
    "description IN ('foul','foul_tip','hit_into_play')",
    "description IN ('foul','foul_tip','hit_into_play','swinging_strike','swinging_strike_blocked')",
    "pa AND e = 'walk'", "pa AND e IN ('strikeout','strikeout_double_play')", None, "bip AND launch_angle < 10"]
_STYLE_DEN = [_STYLE_NUM[1], "description IN ('foul','foul_tip','hit_into_play','swinging_strike','swinging_strike_blocked','ball','blocked_ball','called_strike')", "pa", "pa", "ab", "bip"]
STYLE_CTE = f"""
sb AS (SELECT *, coalesce(events, '') AS e, {TERMINAL} AND events NOT IN ('intent_walk','catcher_interf','truncated_pa') AS pa,
  {TERMINAL} AND events IN ('single','double','triple','home_run','field_out','force_out','fielders_choice','fielders_choice_out','field_error','strikeout','strikeout_double_play','grounded_into_double_play','double_play','triple_play') AS ab,
  description = 'hit_into_play' AND launch_angle IS NOT NULL AS bip FROM log),
sd AS (SELECT batter, game_date, """ + ", ".join(
    f"sum(CASE WHEN {n} THEN 1 ELSE 0 END) AS n{i}" if n else "sum(CASE WHEN ab THEN CASE e WHEN 'double' THEN 1 WHEN 'triple' THEN 2 WHEN 'home_run' THEN 3 ELSE 0 END ELSE 0 END) AS n4" for i, n in enumerate(_STYLE_NUM)) + ", " + ", ".join(
    f"sum(CASE WHEN {d} THEN 1 ELSE 0 END) AS d{i}" for i, d in enumerate(_STYLE_DEN)) + f""" FROM sb GROUP BY 1, 2),
sl AS (SELECT game_date, """ + ", ".join(f"(coalesce(sum(sum(n{i})) OVER w, 0) + 500 * {r}) / (coalesce(sum(sum(d{i})) OVER w, 0) + 500) AS l{i}" for i, r in enumerate(asof.INITIAL_RATES)) + f""" FROM sd GROUP BY game_date WINDOW w AS (ORDER BY game_date {PRIOR})),
sp AS (SELECT batter, game_date, """ + ", ".join(f"coalesce(sum(n{i}) OVER w, 0) AS n{i}, coalesce(sum(d{i}) OVER w, 0) AS d{i}" for i in range(6)) + f""" FROM sd WINDOW w AS (PARTITION BY batter ORDER BY game_date {PRIOR})),
style AS (SELECT batter, game_date, """ + ", ".join(
    f"(n{i} + {w} * l{i}) / (d{i} + {w}) AS {s}_prior, d{i} / CAST(d{i} + {w} AS DOUBLE) AS {s}_weight" for i, (s, w) in enumerate(zip(asof.STYLES, asof.PRIOR_WEIGHTS))) + " FROM sp JOIN sl USING (game_date))"
_STYLE_COLS = [f"{s}_{k}" for s in asof.STYLES for k in ("prior", "weight")]


@query("e07_style_history", STYLE_CTE + " SELECT * FROM style", doubles=_STYLE_COLS)
def _e07(t):
    return asof.style_history(t.log, K, terminal())


@query("e08_history_tokens", f"""
h AS (SELECT *, list(event_id) OVER w AS ids FROM log WINDOW w AS ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT game_pk, at_bat_number, pitch_number, coalesce(array_to_string(ids, ','), '') AS history, coalesce(len(ids), 0) AS n_valid FROM h""")
def _e08(t):
    h = ordered.history_tokens(t.log, K, ["event_id", "pitch_type", "plate_x"], 5)
    return h.select(*KEY, F.array_join(F.transform("history", lambda x: x["event_id"].cast("string")), ",").alias("history"), F.size("history").cast("bigint").alias("n_valid"))


@query("e09_long_history", """
ep AS (SELECT game_pk, at_bat_number, game_date, min(batter) AS batter FROM log GROUP BY 1, 2, 3 HAVING min(batter) = max(batter)),
ev AS (SELECT e.batter, e.game_date, e.game_pk, e.at_bat_number, l.pitch_number, l.event_id FROM log l JOIN ep e USING (game_pk, at_bat_number)),
m AS (SELECT q.game_pk, q.at_bat_number, q.batter, v.event_id, (v.game_pk = q.game_pk)::INT AS own, v.game_date AS d, v.game_pk AS g, v.at_bat_number AS a, v.pitch_number AS p
  FROM ep q JOIN ev v ON v.batter = q.batter AND (v.game_date < q.game_date OR (v.game_pk = q.game_pk AND v.at_bat_number < q.at_bat_number))),
r AS (SELECT *, row_number() OVER (PARTITION BY game_pk, at_bat_number ORDER BY own DESC, d DESC, g DESC, a DESC, p DESC) AS rn FROM m),
k AS (SELECT game_pk, at_bat_number, string_agg(event_id, ',' ORDER BY rn DESC) AS tokens, sum(own) AS n FROM r WHERE rn <= 32 GROUP BY 1, 2)
SELECT ep.game_pk, ep.at_bat_number, ep.batter, coalesce(tokens, '') AS tokens, CAST(coalesce(n, 0) AS BIGINT) AS n_cluster FROM ep LEFT JOIN k USING (game_pk, at_bat_number)""")
def _e09(t):
    return asof.long_history(t.log, K, "event_id", 32).withColumn("tokens", F.array_join(F.transform("tokens", lambda x: x.cast("string")), ","))


@query("e10_actor_context", """
h AS (SELECT *, list(event_id) OVER w AS ids FROM log WINDOW w AS (PARTITION BY game_pk, pitcher ORDER BY at_bat_number, pitch_number ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING))
SELECT game_pk, at_bat_number, pitch_number, coalesce(array_to_string(ids, ','), '') AS context FROM h""")
def _e10(t):
    h = ordered.actor_context(t.log, K, ["event_id"], 32)
    return h.select(*KEY, F.array_join(F.transform("context", lambda x: x["event_id"].cast("string")), ",").alias("context"))


REFERENCE_CTE = """
rt AS (SELECT * FROM log WHERE season <= 2022 AND release_speed IS NOT NULL AND pitch_type IS NOT NULL),
ra AS (SELECT pitcher, pitch_type, avg(release_speed) AS m FROM rt GROUP BY 1, 2 HAVING count(*) >= 8),
rb AS (SELECT pitch_type, avg(release_speed) AS m FROM rt GROUP BY 1), rg AS (SELECT avg(release_speed) AS m FROM rt)
"""


@query("e11_adaptive_shift", REFERENCE_CTE + f""",
p AS (SELECT *, count(release_speed) OVER w AS n, avg(release_speed) OVER w AS m0 FROM log WINDOW w AS (PARTITION BY game_pk, pitcher, pitch_type ORDER BY at_bat_number, pitch_number {PRIOR}))
SELECT p.game_pk, p.at_bat_number, p.pitch_number, n AS prior_n, CASE WHEN ra.m IS NOT NULL THEN 2 WHEN rb.m IS NOT NULL THEN 1 ELSE 0 END AS origin,
  CASE WHEN n = 0 THEN 0 ELSE (m0 - coalesce(ra.m, rb.m, rg.m)) * n / (n + 20.0) END AS shift_release_speed
FROM p LEFT JOIN ra ON ra.pitcher = p.pitcher AND ra.pitch_type = p.pitch_type LEFT JOIN rb ON rb.pitch_type = p.pitch_type, rg""", doubles=["shift_release_speed"])
def _e11(t):
    log = t.log
    train = log.where("season <= 2022 and release_speed is not null and pitch_type is not null")
    ref = freq.tiered_means(train, [["pitcher", "pitch_type"], ["pitch_type"]], ["release_speed"], minimum=[8, 1])
    prior = ordered.prior_mean(log, K, ["pitcher", "pitch_type"], ["release_speed"], c("release_speed").isNotNull())
    out = freq.tiered_lookup(prior, ref, [["pitcher", "pitch_type"], ["pitch_type"]], ["release_speed"])
    return ordered.adaptive_shift(out, ["release_speed"], 20).select(*KEY, "prior_n", "origin", "shift_release_speed")


@query("e12_prior_support", f"""
d AS (SELECT pitcher, game_date, sum((k % 3 <> 0)::INT) AS n FROM log GROUP BY 1, 2),
p AS (SELECT pitcher, game_date, coalesce(sum(n) OVER (PARTITION BY pitcher ORDER BY game_date {PRIOR}), 0) AS n FROM d)
SELECT game_pk, at_bat_number, pitch_number, CAST(p.n + coalesce(sum((k % 3 <> 0)::INT) OVER (PARTITION BY game_pk, l.pitcher ORDER BY at_bat_number, pitch_number {PRIOR}), 0) AS BIGINT) AS prior_support
FROM log l JOIN p USING (pitcher, game_date)""")
def _e12(t):
    return asof.prior_support(t.log, K, c("k") % 3 != 0).select(*KEY, "prior_support")


@query("e13_substitutions", OUTS_CTE + """,
s AS (SELECT *, lag(pitcher) OVER (PARTITION BY game_pk, fielding_team ORDER BY at_bat_number, pitch_number) AS outgoing FROM outs)
SELECT game_pk, at_bat_number, pitch_number, fielding_team, outgoing, pitcher AS incoming FROM s WHERE outgoing <> pitcher""")
def _e13(t):
    log = t.log.withColumn("fielding_team", F.when(c("inning_topbot") == "Top", c("home_team")).otherwise(c("away_team")))
    return ordered.substitutions(log, K, "fielding_team").select(*KEY, "fielding_team", "outgoing", c("pitcher").alias("incoming"))


@query("e14_evidence_packets", f"""
s AS (SELECT *, string_agg(game_pk || ':' || at_bat_number || ':' || pitch_number, ' ') OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS episode_keys,
  count(*) OVER (PARTITION BY game_pk, pitcher ORDER BY at_bat_number, pitch_number {PRIOR}) AS prior_same_actor, lead(inning) OVER g AS next_inning, lead(home_score) OVER g AS next_home_score FROM log WINDOW g AS ({G}))
SELECT game_pk || ':' || at_bat_number || ':' || pitch_number AS event_key, events, episode_keys, prior_same_actor, next_inning, next_home_score, next_inning IS NOT NULL AND next_home_score IS NOT NULL AS next_complete
FROM s WHERE events IN ('home_run', 'triple')""")
def _e14(t):
    p = ordered.evidence_packets(t.log, K, c("events").isin("home_run", "triple"), ["inning", "home_score"])
    return p.select("event_key", "events", F.array_join("episode_keys", " ").alias("episode_keys"), "prior_same_actor", "next_inning", "next_home_score", "next_complete")


SCORE_CTE = f"""
sc0 AS (SELECT *, lead(away_score) OVER g AS na, lead(home_score) OVER g AS nh, lead(inning_topbot) OVER g AS ns, lead(inning) OVER g AS ni FROM log WINDOW g AS ({G})),
sc AS (SELECT game_pk, inning, inning_topbot, ns, ni, 'away' AS team, 'Top' AS ts, coalesce(na, post_away_score) - away_score AS ch FROM sc0
  UNION ALL SELECT game_pk, inning, inning_topbot, ns, ni, 'home', 'Bot', coalesce(nh, post_home_score) - home_score FROM sc0)
"""


@query("e15_line_score", SCORE_CTE + """
SELECT game_pk, team, CASE WHEN inning_topbot = ts THEN inning ELSE ni END AS inning,
  CASE WHEN max(CASE WHEN inning_topbot = ts AND ch < 0 THEN 1 ELSE 0 END) = 0 THEN CAST(coalesce(sum(CASE WHEN ch >= 0 THEN ch END), 0) AS BIGINT) END AS runs
FROM sc WHERE inning_topbot = ts OR ns = ts GROUP BY ALL""")
def _e15(t):
    return ordered.line_score(t.log, K)


@query("e15_line_score_issues", SCORE_CTE + """
SELECT game_pk, team, count_if(ch < 0) AS decreases, count_if(inning_topbot <> ts AND coalesce(ns <> ts, true) AND ch > 0) AS outside FROM sc GROUP BY 1, 2""")
def _e15b(t):
    return ordered.line_score_issues(t.log, K)


@query("e15_largest_changes", f"""
v AS (SELECT game_pk, at_bat_number, pitch_number, coalesce(lead(k) OVER g, CASE WHEN post_home_score > post_away_score THEN 100 ELSE 0 END) - k AS change FROM log WINDOW g AS ({G})),
r AS (SELECT *, row_number() OVER (PARTITION BY game_pk ORDER BY abs(change) DESC, at_bat_number, pitch_number) AS rank FROM v)
SELECT game_pk, at_bat_number, pitch_number, change AS value_change, rank FROM r WHERE rank <= 5""")
def _e15c(t):
    final = F.when(c("post_home_score") > c("post_away_score"), 100).otherwise(0)
    return ordered.largest_changes(ordered.value_path(t.log, K, "k", final), K, 5).select(*KEY, "value_change", "rank")


@query("e16_value_before_after", f"""
SELECT game_pk, at_bat_number, pitch_number, k / 100.0 AS value_before, coalesce(lead(k / 100.0) OVER g, CASE WHEN post_home_score > post_away_score THEN 1.0 ELSE 0.0 END) AS value_after,
  coalesce(lead(k / 100.0) OVER g, CASE WHEN post_home_score > post_away_score THEN 1.0 ELSE 0.0 END) - k / 100.0 AS value_change FROM log WINDOW g AS ({G})""", doubles=["value_before", "value_after", "value_change"])
def _e16(t):
    final = F.when(c("post_home_score") > c("post_away_score"), 1.0).otherwise(0.0)
    return ordered.value_path(t.log.withColumn("v", c("k") / F.lit(100.0)), K, "v", final).select(*KEY, "value_before", "value_after", "value_change")


@query("e17_cumulative_ratio", f"SELECT game_pk, at_bat_number, pitch_number, k % 7 / CAST(3 AS DOUBLE) AS rho, product(k % 7 / CAST(3 AS DOUBLE)) OVER ({W}) AS rho_cum FROM log", doubles=["rho", "rho_cum"])
def _e17(t):
    return ordered.cumulative_ratio(t.log.withColumn("rho", c("k") % 7 / F.lit(3.0)), K, "rho").select(*KEY, "rho", "rho_cum")


COHORT_CTE = OUTS_CTE + """,
coh AS (SELECT pitcher, count(DISTINCT game_pk) AS starts, CAST(sum(outs_recorded) AS BIGINT) AS outs, CAST(sum(extra) AS BIGINT) AS uncertain_outs FROM outs WHERE pitcher = starter GROUP BY 1)
"""


def cohort_table(t):
    return with_outs(t.log).where("pitcher = starter").groupBy("pitcher").agg(
        F.countDistinct("game_pk").alias("starts"), F.sum("outs_recorded").alias("outs"), F.sum("outs_ambiguous_extra").alias("uncertain_outs"))


@query("e18_ranked_cohort", COHORT_CTE + """,
r AS (SELECT *, outs - uncertain_outs AS outs_lower, row_number() OVER (ORDER BY outs DESC, starts DESC, pitcher) <= 6 AS chosen FROM coh)
SELECT *, (SELECT count_if(chosen) = 6 AND coalesce(min(outs_lower) FILTER (chosen) > max(outs) FILTER (NOT chosen), false) FROM r) AS stable FROM r""")
def _e18(t):
    return ordered.ranked_cohort(cohort_table(t), "pitcher", 6)


COMPLETE_CTE = f"""
lastrow AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_pk ORDER BY at_bat_number DESC, pitch_number DESC) AS rn FROM log) WHERE rn = 1),
done AS (SELECT game_pk, inning >= 9 AND coalesce(events <> 'truncated_pa', false) AND ((inning_topbot = 'Top' AND outs_when_up + {IMPLIED} = 3 AND post_home_score > post_away_score)
   OR (inning_topbot = 'Bot' AND outs_when_up + {IMPLIED} = 3 AND post_home_score < post_away_score) OR (inning_topbot = 'Bot' AND post_home_score > post_away_score)) AS complete,
   CAST(post_home_score > post_away_score AS DOUBLE) AS hw FROM lastrow)
"""


@query("e19_completion_winner", COMPLETE_CTE + "SELECT game_pk, complete, CASE WHEN complete THEN hw END AS final_home_win FROM done")
def _e19(t):
    return ordered.cluster_completion(t.log, K)


@query("e20_decision_selection", OUTS_CTE + f""",
b AS (SELECT *, lag(pitcher) OVER tm AS outgoing, min(at_bat_number) OVER (PARTITION BY game_pk, inning, inning_topbot) AS hf, count(*) OVER tp AS prior_events, count(DISTINCT pitcher) OVER tp AS prior_actors FROM outs
  WINDOW tm AS (PARTITION BY game_pk, fielding_team ORDER BY at_bat_number, pitch_number), tp AS (PARTITION BY game_pk, fielding_team ORDER BY at_bat_number, pitch_number {PRIOR})),
f AS (SELECT *, row_number() OVER ({G}) AS rn FROM b WHERE outgoing <> pitcher AND pitch_number = 1 AND outs_when_up = 0 AND inning <= 8 AND at_bat_number = hf)
SELECT g.game_pk, at_bat_number, pitch_number, fielding_team AS team, outgoing, pitcher AS incoming, prior_events, prior_actors, CASE WHEN f.game_pk IS NULL THEN 'missing' ELSE 'selected' END AS status,
  CASE WHEN f.game_pk IS NULL THEN 'no_observed_fresh_half_inning_change_through_inning_8' END AS missing_reason
FROM (SELECT DISTINCT game_pk FROM log) g LEFT JOIN (SELECT * FROM f WHERE rn = 1) f USING (game_pk)""")
def _e20(t):
    log = t.log.withColumn("fielding_team", F.when(c("inning_topbot") == "Top", c("home_team")).otherwise(c("away_team")))
    return ordered.select_decisions(log, K, "fielding_team")


AT_BATS = ("single", "double", "triple", "home_run", "field_out", "force_out", "grounded_into_double_play", "double_play", "triple_play",
           "fielders_choice", "fielders_choice_out", "field_error", "strikeout", "strikeout_double_play")


@query("e21_running_line", f"""
SELECT game_pk, at_bat_number, pitch_number, CAST(coalesce(sum((coalesce(events, '') IN {AT_BATS})::INT) OVER b, 0) AS BIGINT) AS at_bats,
  CAST(coalesce(sum((coalesce(events, '') IN ('single','double','triple','home_run'))::INT) OVER b, 0) AS BIGINT) AS hits,
  CAST(coalesce(sum((coalesce(events, '') IN ('single','double','triple','home_run','walk','intent_walk','hit_by_pitch'))::INT) OVER b, 0) AS BIGINT) AS on_base,
  count(*) OVER p AS pitches, CAST(coalesce(sum((coalesce(events, '') IN ('strikeout','strikeout_double_play'))::INT) OVER p, 0) AS BIGINT) AS strikeouts, CAST(coalesce(sum(runs) OVER p, 0) AS BIGINT) AS runs_allowed
FROM log WINDOW b AS (PARTITION BY game_pk, batter ORDER BY at_bat_number, pitch_number {PRIOR}), p AS (PARTITION BY game_pk, pitcher ORDER BY at_bat_number, pitch_number {PRIOR})""")
def _e21(t):
    e = F.coalesce("events", F.lit(""))
    log = ordered.running_line(t.log, K, K.entity, {"at_bats": e.isin(*AT_BATS), "hits": e.isin(*codes.HIT_EVENTS), "on_base": e.isin(*codes.HIT_EVENTS, *codes.BB_EVENTS, "hit_by_pitch")})
    log = ordered.running_line(log, K, K.actor, {"pitches": F.lit(True), "strikeouts": e.isin(*codes.K_EVENTS), "runs_allowed": c("runs")})
    return log.select(*KEY, "at_bats", "hits", "on_base", "pitches", "strikeouts", "runs_allowed")


@query("e22_revealed_prefix", f"""
r AS (SELECT * FROM (SELECT *, row_number() OVER ({G}) AS ordinal FROM log) WHERE ordinal <= 100)
SELECT game_pk, at_bat_number, pitch_number, ordinal, lead(outs_when_up) OVER g AS next_outs, lead(home_score) OVER g AS next_home_score FROM r WINDOW g AS ({G})""")
def _e22(t):
    w = K.in_cluster()
    return ordered.revealed(t.log, K, 100).select(*KEY, "ordinal", F.lead("outs_when_up").over(w).alias("next_outs"), F.lead("home_score").over(w).alias("next_home_score"))


@query("e23_observed_context", f"""
d AS (SELECT pitcher, pitch_type, game_date, sum(release_speed) AS s, count(release_speed) AS n FROM log GROUP BY 1, 2, 3),
b AS (SELECT pitcher, pitch_type, game_date, coalesce(sum(n) OVER w, 0) AS bn, sum(s) OVER w AS bs FROM d WINDOW w AS (PARTITION BY pitcher, pitch_type ORDER BY game_date RANGE BETWEEN INTERVAL 9 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)),
p AS (SELECT *, count(*) OVER (PARTITION BY game_pk, pitcher ORDER BY at_bat_number, pitch_number {PRIOR}) AS prior_events,
  dense_rank() OVER (PARTITION BY game_pk, pitcher, batter ORDER BY at_bat_number) AS times_facing, count(release_speed) OVER r AS recent_n, avg(release_speed) OVER r AS recent_mean FROM log
  WINDOW r AS (PARTITION BY game_pk, pitcher, pitch_type ORDER BY at_bat_number, pitch_number ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT p.game_pk, p.at_bat_number, p.pitch_number, prior_events, times_facing, recent_n, recent_mean, CAST(bn AS BIGINT) AS base_n, CASE WHEN bn > 0 THEN bs / bn END AS base_mean, recent_mean - CASE WHEN bn > 0 THEN bs / bn END AS delta
FROM p LEFT JOIN b ON b.pitcher = p.pitcher AND b.pitch_type IS NOT DISTINCT FROM p.pitch_type AND b.game_date = p.game_date""", doubles=["recent_mean", "base_mean", "delta"])
def _e23(t):
    out = ordered.recent_vs_trailing(t.log, K, "pitch_type", "release_speed", 5, 9)
    return out.select(*KEY, "prior_events", "times_facing", "recent_n", "recent_mean", "base_n", "base_mean", "delta")


@query("c05_asof_profile", """
d AS (SELECT pitcher, pitch_type, game_date, count(*) AS n, coalesce(sum(release_speed), 0) AS s, count(release_speed) AS m FROM log WHERE pitch_type IS NOT NULL GROUP BY 1, 2, 3),
q AS (SELECT game_pk, at_bat_number, pitch_number, pitcher, pitch_type, game_date FROM log WHERE pitch_type IS NOT NULL)
SELECT q.game_pk, q.at_bat_number, q.pitch_number, CAST(sum(n) AS DOUBLE) AS prof_n, CAST(sum(s) AS DOUBLE) AS prof_sum, CAST(sum(m) AS DOUBLE) AS prof_m FROM q LEFT JOIN d ON d.pitcher = q.pitcher AND d.pitch_type = q.pitch_type AND d.game_date < q.game_date GROUP BY 1, 2, 3""",
  doubles=["prof_n", "prof_sum", "prof_m"])
def _c05(t):
    log = t.log.where("pitch_type is not null")
    hist = asof.daily_sums(log, ["pitcher", "pitch_type"], "game_date", {
        "prof_n": F.lit(1), "prof_sum": F.coalesce("release_speed", F.lit(0.0)), "prof_m": c("release_speed").isNotNull().cast("int")})
    out = asof.asof_profile(log.select(*KEY, "pitcher", "pitch_type", "game_date"), hist, ["pitcher", "pitch_type"], "game_date", ["prof_n", "prof_sum", "prof_m"])
    return out.select(*KEY, "prof_n", "prof_sum", "prof_m")


@query("c06_exact_predecessor", f"""
g AS (SELECT *, row_number() OVER ({W}) AS rn FROM log WHERE k % 10 <> 0)
SELECT game_pk, at_bat_number, pitch_number, CASE WHEN lag(pitch_number) OVER w = pitch_number - 1 THEN coalesce(lag(pitch_type) OVER w, 'UNKNOWN') ELSE 'UNKNOWN' END AS previous_pitch_type,
  coalesce(lag(pitch_number) OVER w = pitch_number - 1, false) AS previous_valid FROM g WINDOW w AS ({W})""")
def _c06(t):
    """Projected log with gaps: an excluded event leaves its successor without a predecessor."""
    return ordered.exact_predecessor(t.log.where("k % 10 <> 0"), K, "pitch_type").select(*KEY, "previous_pitch_type", "previous_valid")


@query("c13_trailing_workload", """
d AS (SELECT pitcher, game_date, count(DISTINCT game_pk) AS g, count(*) AS n FROM log GROUP BY 1, 2)
SELECT pitcher, game_date, CAST(coalesce(sum(g) OVER w, 0) AS BIGINT) AS appearances, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS events FROM d
WINDOW w AS (PARTITION BY pitcher ORDER BY game_date RANGE BETWEEN INTERVAL 5 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def _c13(t):
    return asof.trailing_workload(t.log, K, 5)


@query("d24_profile_export", """
SELECT o AS origin, pitcher, pitch_type, CAST(count(*) AS DOUBLE) AS n, CAST(coalesce(sum(release_speed), 0) AS DOUBLE) AS speed_sum, CAST(count(release_speed) AS DOUBLE) AS speed_n
FROM log, (VALUES (DATE '2024-01-10'), (DATE '2024-01-20'), (DATE '2024-01-30')) v(o) WHERE game_date < o GROUP BY ALL""", doubles=["n", "speed_sum", "speed_n"])
def _d24(t):
    return asof.profile_export(t.log, K, ["pitcher", "pitch_type"], ["2024-01-10", "2024-01-20", "2024-01-30"], {
        "n": F.lit(1), "speed_sum": F.coalesce("release_speed", F.lit(0.0)), "speed_n": c("release_speed").isNotNull().cast("int")})
