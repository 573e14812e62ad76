"""Sections C, F and H: joins, audits, gates and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallylane.keys import DEFAULT_KEYS as K
from tallylane.operators import asof, audit, freq, gates, joins, ordered, rewards
from tallylane.operators.lineage import dealt, materialise
from tallylane.plans.aggregates import ADV_CTE, LEVELS, _chain_sql, advancement_rows, chain
from tallylane.plans.encoders import OUT10_SQL
from tallylane.plans.ordered import COMPLETE_CTE, OUTS_CTE, TERMINAL, with_outs
from tallylane.plans.registry import query
from tallylane.plans.samples import winner_fit
from tallylane.plans.testlog import TYPE_CODES

c = F.col
KEY = K.event


@query("c01_validated_join", """SELECT game_pk, at_bat_number, pitch_number, release_speed, spin_axis FROM log""", doubles=["release_speed", "spin_axis"])
def _c01(t):
    left, right = t.log.select(*KEY), t.log.select(*KEY, "release_speed", "spin_axis")
    return joins.one_to_one(left, right, KEY)[0]


@query("c01_join_gate", """
r AS (SELECT CASE WHEN k = 5 THEN NULL ELSE game_pk END AS game_pk, at_bat_number, CASE WHEN k = 6 THEN 1 ELSE pitch_number END AS pitch_number FROM log)
SELECT 0::BIGINT AS left_null_keys, 0::BIGINT AS left_duplicates, (SELECT count_if(game_pk IS NULL) FROM r) AS right_null_keys, (SELECT count(*) FROM (SELECT 1 FROM r GROUP BY game_pk, at_bat_number, pitch_number HAVING count(*) > 1)) AS right_duplicates,
  (SELECT count(*) FROM log l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.game_pk = l.game_pk AND r.at_bat_number = l.at_bat_number AND r.pitch_number = l.pitch_number)) AS unmatched""")
def _c01b(t):
    bad = t.log.withColumns({"game_pk": F.when(c("k") != 5, c("game_pk")), "pitch_number": F.when(c("k") == 6, 1).otherwise(c("pitch_number"))})
    return joins.one_to_one(t.log.select(*KEY), bad.select(*KEY), KEY)[1]


@query("c02_enrichment_keep_last", """
r AS (SELECT o_custkey, o_totalprice, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT c_custkey, o_totalprice, o_orderpriority FROM customer LEFT JOIN (SELECT * FROM r WHERE rn = 1) ON o_custkey = c_custkey""".replace("r AS", "WITH r AS", 1), doubles=["o_totalprice"], log=False)
def _c02(t):
    last = joins.keep_last(t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderpriority"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return t.customer.select("c_custkey").join(last, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "o_totalprice", "o_orderpriority")


@query("c03_semi_anti", """
p AS (SELECT pitcher FROM log WHERE season = 2021 GROUP BY 1 HAVING count(*) >= 40), b AS (SELECT DISTINCT batter FROM log WHERE season <= 2022)
SELECT season, count(*) AS pool_events, count_if(batter NOT IN (SELECT batter FROM b)) AS unseen_entity_events FROM log WHERE pitcher IN (SELECT pitcher FROM p) GROUP BY 1""")
def _c03(t):
    log = t.log
    pool = log.where("season = 2021").groupBy("pitcher").agg(F.count("*").alias("n")).where("n >= 40")
    kept = log.join(pool, "pitcher", "left_semi")
    unseen = kept.join(log.where("season <= 2022").select("batter").distinct(), "batter", "left_anti").groupBy("season").agg(F.count("*").alias("unseen_entity_events"))
    return kept.groupBy("season").agg(F.count("*").alias("pool_events")).join(unseen, "season", "left").fillna(0, ["unseen_entity_events"])


@query("c04_default_lookup", """
a AS (SELECT batter, stand, batter % 3 AS cl FROM log WHERE season = 2021 AND stand = 'R' GROUP BY ALL HAVING count(*) >= 15), d AS (SELECT 'R' AS stand, 2 AS cl)
SELECT game_pk, at_bat_number, pitch_number, coalesce(a.cl, d.cl, 0) AS cluster_id FROM log l LEFT JOIN a ON a.batter = l.batter AND a.stand = l.stand LEFT JOIN d ON d.stand = l.stand""")
def _c04(t):
    log = t.log
    assigned = log.where("season = 2021 and stand = 'R'").groupBy("batter", "stand").agg(F.count("*").alias("n")).where("n >= 15").select("batter", "stand", (c("batter") % 3).alias("cluster_id"))
    defaults = t.spark.range(1).select(F.lit("R").alias("stand"), F.lit(2).cast("bigint").alias("cluster_id"))
    return joins.default_lookup(log, assigned, defaults, ["batter", "stand"], "stand", "cluster_id").select(*KEY, "cluster_id")


@query("c07_fallback_origin", _chain_sql(LEVELS, True).replace("\nSELECT e.game_pk", ",\nfin AS (SELECT e.game_pk", 1) + ") SELECT origin, count(*) AS n FROM fin GROUP BY 1")
def _c07(t):
    """How many held-out events each tier of the fallback chain answers."""
    return chain(t, LEVELS).groupBy("origin").agg(F.count("*").alias("n"))


@query("c08_new_pairs", """
tr AS (SELECT * FROM log WHERE season <= 2022), pr AS (SELECT DISTINCT pitcher, batter FROM log WHERE season <= 2023), dv AS (SELECT * FROM log WHERE season = 2024),
f AS (SELECT pitcher, batter, min((game_date, game_pk)) AS f FROM dv GROUP BY 1, 2)
SELECT game_pk, at_bat_number, pitch_number, d.pitcher, d.batter FROM dv d JOIN f ON f.pitcher = d.pitcher AND f.batter = d.batter AND f.f = (d.game_date, d.game_pk)
WHERE d.pitcher IN (SELECT pitcher FROM tr) AND d.batter IN (SELECT batter FROM tr) AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.pitcher = d.pitcher AND pr.batter = d.batter)""")
def _c08(t):
    log = t.log
    return joins.new_pairs(log.where("season = 2024"), log.where("season <= 2022"), log.where("season <= 2023"), K).select(*KEY, "pitcher", "batter")


PAIR_CTE = """
pe AS (SELECT *, CASE WHEN k % 41 <> 0 THEN event_id * 10 + 5 END AS first_seq, CASE WHEN k % 43 <> 0 THEN event_id * 10.0 + 5 END AS received, k % 19 <> 0 AS confirmed FROM log),
de AS (SELECT game_pk, at_bat_number, pitch_number, event_id * 10 + j * 4 - 6 AS d_seq, event_id * 2 + j AS d_id, CASE WHEN k % 29 <> 0 THEN event_id * 10.0 + j * 4 - 6 + k % 3 END AS decided,
   CASE WHEN k % 13 <> 0 THEN pitcher + (k % 17 = 3)::INT END AS in_pitcher, batter + (k % 14 = 3)::INT AS in_batter, balls + (k % 12 = 5)::INT AS in_balls FROM log, (VALUES (0), (1), (3)) v(j) WHERE k % 7 <> 0)
"""


@query("c09_decision_pairing", PAIR_CTE + """,
x AS (SELECT *, lag(first_seq) OVER w AS ps, lag(pitch_number) OVER w IS NOT NULL AS hp FROM pe WINDOW w AS (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number)),
b AS (SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY d.game_pk, d.at_bat_number, d.pitch_number ORDER BY d_seq DESC, d_id DESC) AS rn FROM de d JOIN pe USING (game_pk, at_bat_number, pitch_number) WHERE d_seq < first_seq AND decided < received) WHERE rn = 1),
a AS (SELECT DISTINCT game_pk, at_bat_number, pitch_number FROM de),
r AS (SELECT x.game_pk, x.at_bat_number, x.pitch_number, d_id, CASE WHEN NOT confirmed THEN 'event_unconfirmed' WHEN first_seq IS NULL OR received IS NULL THEN 'event_first_seen_unknown' WHEN a.game_pk IS NULL THEN 'no_recorded_decision'
  WHEN b.d_id IS NULL THEN 'recorded_after_event_appeared' WHEN hp AND (ps IS NULL OR ps > d_seq) THEN 'previous_event_not_in_decision' WHEN in_pitcher IS NULL THEN 'decision_inputs_unknown' WHEN in_pitcher <> pitcher THEN 'different_actor' WHEN in_batter <> batter THEN 'different_entity'
  WHEN in_balls <> balls THEN 'different_situation' END AS refusal FROM x LEFT JOIN a ON a.game_pk = x.game_pk AND a.at_bat_number = x.at_bat_number AND a.pitch_number = x.pitch_number LEFT JOIN b ON b.game_pk = x.game_pk AND b.at_bat_number = x.at_bat_number AND b.pitch_number = x.pitch_number)
SELECT game_pk, at_bat_number, pitch_number, CASE WHEN refusal IS NULL THEN d_id END AS decision_id, refusal FROM r""")
def _c09(t):
    log = t.log
    ev = log.withColumns({"first_seq": F.when(c("k") % 41 != 0, c("event_id") * 10 + 5), "received": F.when(c("k") % 43 != 0, c("event_id") * F.lit(10.0) + 5), "confirmed": c("k") % 19 != 0})
    d = log.where("k % 7 <> 0").withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(3)))).select(
        *KEY, (c("event_id") * 10 + c("j") * 4 - 6).alias("d_seq"), (c("event_id") * 2 + c("j")).alias("d_id"), F.when(c("k") % 29 != 0, c("event_id") * F.lit(10.0) + c("j") * 4 - 6 + c("k") % 3).alias("decided"),
        F.when(c("k") % 13 != 0, c("pitcher") + (c("k") % 17 == 3).cast("int")).alias("in_pitcher"), (c("batter") + (c("k") % 14 == 3).cast("int")).alias("in_batter"), (c("balls") + (c("k") % 12 == 5).cast("int")).alias("in_balls"))
    return joins.pair_decisions(ev, d, K, ["balls"])


@query("c10_forecast_grading", """
lb AS (SELECT *, game_pk || '-' || event_id AS uid, CASE WHEN k % 31 <> 0 THEN k % 8 END AS leaf, coalesce(pitch_type, 'NA') AS kind, CASE WHEN k % 37 = 0 THEN 'unverified' ELSE 'observer_local' END AS clock, CASE WHEN k % 47 <> 0 THEN event_id * 100 + 50 END AS first_received FROM log),
sl AS (SELECT *, coalesce('after:' || lag(uid) OVER w, 'start') AS slot, lag(uid) OVER w AS pu FROM lb WINDOW w AS (PARTITION BY game_pk ORDER BY at_bat_number, pitch_number)),
fc AS (SELECT game_pk, m AS model, slot, at_bat_number + (k % 23 = 1)::INT AS t_episode, pitch_number AS t_seq, CASE WHEN k % 11 = 0 THEN 'ABSTAIN' WHEN k % 53 <> 0 THEN 'OK' END AS status, CASE WHEN k % 17 = 2 THEN 'POST' ELSE 'PRE_RECEIPT' END AS timing,
   event_id * 100 + (k % 5) * 15 AS generated, CASE WHEN m = 'A' THEN ['*'] ELSE ['FF','SI','SL','CU','CH','FC'] END AS kinds, CASE WHEN k % 41 = 3 THEN [1, 0, 2, 3, 4, 5, 6] ELSE [0, 1, 2, 3, 4, 5, 6] END AS leaves FROM sl, (VALUES ('A'), ('B')) v(m) WHERE NOT (m = 'B' AND k % 6 = 0))
SELECT s.game_pk, s.at_bat_number, s.pitch_number, v.m AS model, CASE WHEN f.model IS NULL THEN 'NO_FORECAST' WHEN status IS NULL THEN 'INCOMPLETE_INTENT' WHEN status <> 'OK' THEN 'MODEL_' || status WHEN t_episode <> s.at_bat_number OR t_seq <> s.pitch_number THEN 'TARGET_KEY_MISMATCH'
  WHEN timing <> 'PRE_RECEIPT' THEN 'POST_HOC_REPLAY' WHEN clock <> 'observer_local' OR first_received IS NULL THEN 'RECEIPT_CLOCK_UNVERIFIED' WHEN NOT generated < first_received THEN 'GENERATED_AFTER_FIRST_RECEIPT' WHEN leaves <> [0, 1, 2, 3, 4, 5, 6] THEN 'LEAF_ORDER_MISMATCH' WHEN leaf IS NULL OR leaf > 6 THEN 'LABEL_UNMAPPED'
  WHEN NOT list_contains(kinds, kind) AND NOT list_contains(kinds, '*') THEN 'REALIZED_TYPE_NOT_IN_CANDIDATES' ELSE 'ELIGIBLE' END AS reason
FROM sl s CROSS JOIN (VALUES ('A'), ('B')) v(m) LEFT JOIN fc f ON f.game_pk = s.game_pk AND f.slot = s.slot AND f.model = v.m""")
def _c10(t):
    lab = t.log.withColumns({"uid": F.concat_ws("-", c("game_pk").cast("string"), c("event_id").cast("string")), "leaf": F.when(c("k") % 31 != 0, c("k") % 8), "kind": F.coalesce("pitch_type", F.lit("NA")),
                             "clock": F.when(c("k") % 37 == 0, "unverified").otherwise("observer_local"), "first_received": F.when(c("k") % 47 != 0, c("event_id") * 100 + 50)})
    slot = F.coalesce(F.concat(F.lit("after:"), F.lag("uid").over(K.in_cluster())), F.lit("start"))
    fc = lab.withColumn("slot", slot).withColumn("model", F.explode(F.array(F.lit("A"), F.lit("B")))).where("not (model = 'B' and k % 6 = 0)").select(
        "game_pk", "model", "slot", (c("at_bat_number") + (c("k") % 23 == 1).cast("int")).alias("t_episode"), c("pitch_number").alias("t_seq"), F.when(c("k") % 11 == 0, "ABSTAIN").when(c("k") % 53 != 0, "OK").alias("status"),
        F.when(c("k") % 17 == 2, "POST").otherwise("PRE_RECEIPT").alias("timing"), (c("event_id") * 100 + (c("k") % 5) * 15).alias("generated"),
        F.when(c("model") == "A", F.array(F.lit("*"))).otherwise(F.array(*[F.lit(x) for x in ("FF", "SI", "SL", "CU", "CH", "FC")])).alias("kinds"),
        F.when(c("k") % 41 == 3, F.array(*[F.lit(x) for x in (1, 0, 2, 3, 4, 5, 6)])).otherwise(F.array(*[F.lit(x) for x in range(7)])).alias("leaves"))
    return joins.grade_forecasts(lab.select(*KEY, "uid", "leaf", "kind", "clock", "first_received"), fc, K, ["A", "B"], list(range(7)), t.log_partitions)


@query("c11_reconciliation", """
a AS (SELECT game_pk, at_bat_number, pitch_number, balls, CASE WHEN k % 9 <> 0 THEN pitch_type END AS pitch_type FROM log WHERE k % 20 <> 1),
b AS (SELECT game_pk, at_bat_number, pitch_number, balls + (k % 16 = 2)::INT AS balls, CASE WHEN k % 8 = 3 THEN 'XX' WHEN k % 15 <> 0 THEN pitch_type END AS pitch_type FROM log WHERE k % 25 <> 1),
j AS (SELECT a.game_pk AS ak, b.game_pk AS bk, a.balls AS ab, b.balls AS bb, a.pitch_type AS ap, b.pitch_type AS bp FROM a FULL JOIN b ON a.game_pk = b.game_pk AND a.at_bat_number = b.at_bat_number AND a.pitch_number = b.pitch_number),
x AS (SELECT ak, bk, 'balls' AS field, ab::VARCHAR AS l, bb::VARCHAR AS r FROM j UNION ALL SELECT ak, bk, 'pitch_type', ap, bp FROM j)
SELECT field, CASE WHEN ak IS NULL THEN 'right_only_key' WHEN bk IS NULL THEN 'left_only_key' WHEN l IS NULL THEN 'unavailable' WHEN r IS NULL THEN 'reference_unavailable' WHEN l = r THEN 'exact' ELSE 'mismatch' END AS status, count(*) AS n FROM x GROUP BY 1, 2""")
def _c11(t):
    log = t.log
    a = log.where("k % 20 <> 1").select(*KEY, "balls", F.when(c("k") % 9 != 0, c("pitch_type")).alias("pitch_type"))
    b = log.where("k % 25 <> 1").select(*KEY, (c("balls") + (c("k") % 16 == 2).cast("int")).alias("balls"), F.when(c("k") % 8 == 3, "XX").when(c("k") % 15 != 0, c("pitch_type")).alias("pitch_type"))
    return joins.reconcile(a, b, KEY, ["balls", "pitch_type"])


FEATS = ["release_speed", "pfx_x", "pfx_z"]
SCALES = [5.0, 0.8, 0.8]
PROF_CTE = """
pq AS (SELECT DISTINCT pitcher, pitch_type, p_throws, game_date FROM log WHERE pitch_type IS NOT NULL),
pf AS (SELECT q.pitcher, q.pitch_type, q.p_throws, q.game_date, avg(release_speed) AS f0, avg(pfx_x) AS f1, avg(pfx_z) AS f2 FROM pq q JOIN log l ON l.pitcher = q.pitcher AND l.pitch_type = q.pitch_type AND l.p_throws = q.p_throws AND l.game_date < q.game_date GROUP BY 1, 2, 3, 4)
"""


def _profiles(t, queries):
    return joins.physics_profile(t.log, queries, K, ["pitcher", "pitch_type", "p_throws"], FEATS)


@query("c17_nearest_target", PROF_CTE + """,
tg AS (SELECT t.pitcher, t.pitch_type, t.p_throws, d.game_date, avg(release_speed) AS f0, avg(pfx_x) AS f1, avg(pfx_z) AS f2 FROM (SELECT DISTINCT pitcher, pitch_type, p_throws FROM log WHERE pitcher % 4 < 2) t JOIN (SELECT DISTINCT pitch_type, p_throws, game_date FROM pq) d USING (pitch_type, p_throws)
   JOIN log l ON l.pitcher = t.pitcher AND l.pitch_type = t.pitch_type AND l.game_date < d.game_date GROUP BY 1, 2, 3, 4 HAVING avg(release_speed) IS NOT NULL)
SELECT q.pitcher, q.pitch_type, q.p_throws, q.game_date, exp(-min(power((q.f0 - t.f0) / 5.0, 2) + power((q.f1 - t.f1) / 0.8, 2) + power((q.f2 - t.f2) / 0.8, 2)) / 2) AS similarity,
  CASE WHEN count(q.f0) = 0 AND bool_and(q.f1 IS NULL) THEN 'no_prior' WHEN count(q.f0) = 0 AND bool_and(q.f0 IS NULL) THEN 'missing_component' WHEN count(t.pitcher) = 0 THEN 'no_target' END AS reason
FROM (SELECT pq.*, f0, f1, f2 FROM pq LEFT JOIN pf USING (pitcher, pitch_type, p_throws, game_date)) q LEFT JOIN tg t ON t.pitch_type = q.pitch_type AND t.p_throws = q.p_throws AND t.game_date = q.game_date AND t.pitcher <> q.pitcher GROUP BY 1, 2, 3, 4""", doubles=["similarity"])
def _c17(t):
    log = t.log.where("pitch_type is not null")
    q = log.select("pitcher", "pitch_type", "p_throws", "game_date").distinct()
    prof = _profiles(t, q)
    grid = log.where("pitcher % 4 < 2").select("pitcher", "pitch_type", "p_throws").distinct().join(q.select("pitch_type", "p_throws", "game_date").distinct(), ["pitch_type", "p_throws"])
    complete = c("release_speed").isNotNull() & c("pfx_x").isNotNull() & c("pfx_z").isNotNull()
    tg = _profiles(t, grid).where(complete)
    near = joins.nearest_target(prof, tg, ["pitch_type", "p_throws", "game_date"], "pitcher", FEATS, SCALES)
    reason = F.when(c("n_prior").isNull(), "no_prior").when(~complete, "missing_component").when(c("similarity").isNull(), "no_target")
    return near.select("pitcher", "pitch_type", "p_throws", "game_date", "similarity", reason.alias("reason"))


@query("c14_key_partition", """
a AS (SELECT DISTINCT game_pk FROM log WHERE game_pk % 3 = 0), b AS (SELECT DISTINCT game_pk FROM log WHERE game_pk % 4 = 0), w AS (SELECT DISTINCT game_pk FROM log)
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS overlap, (SELECT count(*) FROM ((SELECT * FROM a UNION SELECT * FROM b) EXCEPT SELECT * FROM w)) AS outside, (SELECT count(*) FROM (SELECT * FROM w EXCEPT (SELECT * FROM a UNION SELECT * FROM b))) AS missing,
  (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM w)) AS a_not_in_whole, false AS is_partition""")
def _c14(t):
    g = t.log.select("game_pk")
    return gates.key_partition(g.where("game_pk % 3 = 0"), g.where("game_pk % 4 = 0"), g)


@query("c15_prequential_check", """
d AS (SELECT DISTINCT pitcher, game_date FROM log), e AS (SELECT a.pitcher, a.game_date AS qd, b.game_date AS dd FROM d a JOIN d b ON a.pitcher = b.pitcher AND b.game_date <= a.game_date)
SELECT count(*) AS edges, count_if(dd >= qd) AS not_prior, count_if(pitcher % 5 = 0) AS held_out FROM e""")
def _c15(t):
    """Edges from each (actor, date) to the actor's dates up to and including it; the same-date ones are violations."""
    d = t.log.select("pitcher", "game_date").distinct()
    w = Window.partitionBy("pitcher").orderBy("game_date").rowsBetween(Window.unboundedPreceding, 0)
    edges = d.withColumn("donors", F.collect_list("game_date").over(w)).withColumn("donor_date", F.explode("donors"))
    return joins.prequential_violations(edges, "game_date", "donor_date", c("pitcher") % 5 == 0)


@query("c16_evaluation_metadata", OUTS_CTE + """,
n AS (SELECT pitcher, count(*) AS te FROM log WHERE season <= 2021 GROUP BY 1), q AS (SELECT quantile_cont(te, 0.25) AS lo, quantile_cont(te, 0.75) AS hi FROM n), s AS (SELECT DISTINCT batter FROM log WHERE season <= 2021)
SELECT o.game_pk, o.at_bat_number, o.pitch_number, n.te IS NOT NULL AS seen_actor, s.batter IS NOT NULL AS seen_entity, CASE WHEN te IS NULL THEN 'zero' WHEN te <= lo THEN 'low' WHEN te <= hi THEN 'middle' ELSE 'high' END AS volume, CASE WHEN o.pitcher = starter THEN 'starter' ELSE 'relief' END AS game_role,
  strikes = 2 AS two_strikes, on_1b IS NOT NULL OR on_2b IS NOT NULL OR on_3b IS NOT NULL AS runners_on, strftime(game_date, '%Y-%m') AS month, coalesce(te, 0) AS train_events
FROM outs o LEFT JOIN n ON n.pitcher = o.pitcher LEFT JOIN s ON s.batter = o.batter, q""")
def _c16(t):
    log = with_outs(t.log)
    return joins.evaluation_metadata(log, t.log.where("season <= 2021"), K, "starter").select(*KEY, "seen_actor", "seen_entity", "volume", "game_role", "two_strikes", "runners_on", "month", "train_events")


@query("c16_entity_volume", """
n AS (SELECT batter, count(*) AS n FROM log WHERE season <= 2021 GROUP BY 1), q AS (SELECT quantile_cont(n, 0.25) AS q FROM n)
SELECT b.batter, coalesce(n, 0) AS train_events, CASE WHEN n IS NULL THEN 'zero' WHEN n <= q THEN 'low' ELSE 'high' END AS band FROM (SELECT DISTINCT batter FROM log) b LEFT JOIN n USING (batter), q""")
def _c16b(t):
    return joins.entity_volume(t.log, t.log.where("season <= 2021"), "batter")


# --- F -------------------------------------------------------------------------

AUDIT_CTE = OUTS_CTE + "," + COMPLETE_CTE + f""",
fx AS (SELECT o.*, complete, (on_1b IS NOT NULL)::INT + 2 * (on_2b IS NOT NULL)::INT + 4 * (on_3b IS NOT NULL)::INT AS bases,
  CASE WHEN description IN ('ball','blocked_ball','pitchout') THEN 'ball' WHEN description IN ('called_strike','swinging_strike','swinging_strike_blocked','foul_tip') THEN 'strike' WHEN description = 'foul' THEN 'foul' WHEN description = 'hit_by_pitch' THEN 'hbp'
    WHEN description = 'hit_into_play' THEN CASE WHEN events IN ('field_out','force_out','fielders_choice_out','sac_fly') THEN 'out' WHEN events IN ('grounded_into_double_play','double_play','sac_fly_double_play') THEN 'double_play' WHEN events IN ('single','double','triple','home_run') THEN events END END AS y FROM outs o JOIN done USING (game_pk)),
fn AS (SELECT *, lead(at_bat_number) OVER g AS na, lead(balls) OVER g AS nb, lead(strikes) OVER g AS nst, lead(bases) OVER g AS nbase, lead(home_score) OVER g AS nh, lead(away_score) OVER g AS nw FROM fx WINDOW g AS (PARTITION BY game_pk ORDER BY at_bat_number, pitch_number)),
fe AS (SELECT game_pk, at_bat_number, max_by(pitch_number, pitch_number) AS pitch_number, bool_or(complete) AS complete,
  greatest(count(DISTINCT coalesce(on_1b, -1)), count(DISTINCT coalesce(on_2b, -1)), count(DISTINCT coalesce(on_3b, -1)), count(DISTINCT outs_when_up), count(DISTINCT home_score), count(DISTINCT away_score)) > 1 AS r_state, greatest(count(DISTINCT pitcher), count(DISTINCT batter)) > 1 AS r_id,
  bool_or(coalesce(na = at_bat_number, false) AND NOT coalesce(y IN ('ball','strike','foul') AND nb = balls + (y = 'ball')::INT AND nst = strikes + (y = 'strike' OR (y = 'foul' AND strikes < 2))::INT, false)) AS r_path,
  NOT bool_and(coalesce(y IS NOT NULL AND pitch_type IS NOT NULL AND plate_x IS NOT NULL AND plate_z IS NOT NULL AND sz_top > sz_bot, false)) AS r_valid, NOT bool_and(game_type = 'R' AND inning BETWEEN 1 AND 9) AS r_reg, NOT bool_and(pitch_number > 1 OR (balls = 0 AND strikes = 0)) AS r_start FROM fn GROUP BY 1, 2),
ft AS (SELECT e.*, n.* EXCLUDE (game_pk, at_bat_number, pitch_number, complete), coalesce(n.events <> 'truncated_pa', false) AND n.no IS NOT NULL AS seen, n.inning_topbot = 'Top' AS top, n.outs_when_up + coalesce((n.events = 'strikeout')::INT, 0) AS eo,
  coalesce(CASE WHEN n.events IN ('walk','hit_by_pitch') AND bases = 7 THEN 1 WHEN n.events = 'home_run' THEN bit_count(bases) + 1 END, 0) AS er FROM fe e JOIN fn n USING (game_pk, at_bat_number, pitch_number)),
fu AS (SELECT *, inning + (eo = 3 AND NOT top)::INT AS ei, CASE WHEN eo <> 3 THEN inning_topbot WHEN top THEN 'Bot' ELSE 'Top' END AS es FROM ft),
fv AS (SELECT *, CASE WHEN eo = 3 THEN CASE WHEN ei >= 10 THEN 2 ELSE 0 END WHEN events IN ('walk','hit_by_pitch') THEN bases | 1 | CASE WHEN bases & 1 = 1 THEN 2 ELSE 0 END | CASE WHEN bases & 3 = 3 THEN 4 ELSE 0 END WHEN events = 'home_run' THEN 0 ELSE bases END AS eb FROM fu),
au0 AS (SELECT game_pk, at_bat_number, r_state AS mid_episode_state_change, r_start AS not_zero_count_start,
  NOT coalesce(events IN ('field_out','strikeout','force_out','fielders_choice_out','sac_fly','grounded_into_double_play','double_play','sac_fly_double_play','single','double','triple','home_run','walk','hit_by_pitch'), false) AS unsupported_terminal_event,
  r_valid AS missing_or_unsupported_event, r_id AS identity_changes, r_reg AS outside_regular_periods, NOT seen AS unobserved_terminal_transition,
  coalesce((events = 'strikeout' AND outs_recorded <> 1), false) OR coalesce(y = 'out' AND outs_recorded < 1, false) OR coalesce(y = 'double_play' AND outs_recorded <> 2, false) AS irregular_terminal_outs,
  coalesce(events = 'strikeout', false) AND NOT coalesce(y = 'strike' AND strikes = 2, false) OR coalesce(events = 'walk', false) AND NOT coalesce(y = 'ball' AND balls = 3, false) OR coalesce(y = 'strike', false) AND NOT coalesce(events = 'strikeout', false) OR coalesce(y = 'ball', false) AND NOT coalesce(events = 'walk', false) AS inconsistent_terminal_label,
  coalesce(events IN ('walk','hit_by_pitch','strikeout','home_run'), false) AND NOT (seen AND coalesce(no = CASE WHEN eo = 3 THEN 0 ELSE eo END AND nbase = eb AND ni = ei AND nt = es AND nh = home_score + CASE WHEN top THEN 0 ELSE er END AND nw = away_score + CASE WHEN top THEN er ELSE 0 END, false)) AS breaks_deterministic_rule,
  r_path AS inconsistent_count_path, NOT coalesce(complete, false) AS incomplete_cluster, seen AND (nh <> post_home_score OR nw <> post_away_score) AS post_score_mismatch FROM fv),
au AS (SELECT *, NOT ({' OR '.join(audit.REASONS)}) AS supported FROM au0)
"""


def audited(t):
    log = with_outs(t.log).join(ordered.cluster_completion(t.log, K), "game_pk")
    return log, audit.support_audit(log, K)


@query("f01_support_audit", AUDIT_CTE + " SELECT * FROM au")
def _f01(t):
    return audited(t)[1]


@query("f01_reason_counts", AUDIT_CTE + " SELECT count(*) AS episodes, count_if(supported) AS supported, " + ", ".join(f"count_if({r}) AS {r}" for r in audit.REASONS) + " FROM au")
def _f01b(t):
    return audit.reason_counts(audited(t)[1], audit.REASONS)


_NAMED_SQL = "CASE events " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in audit.EVENT_CLASS.items()) + " END"
_CHANGE_SQL = " OR ".join([f"count({x}) < count(*) OR min({x}) <> max({x})" for x in audit.CONTEXT])
_AGAINST_SQL = {
    "illegal_terminal_half_transition": "seen AND NOT moved", "illegal_terminal_outs": "moved AND NOT counted", "illegal_terminal_score": "counted AND NOT scored", "invalid_count_or_action": "known AND NOT sound",
    "missing_terminal_next_state": "agreed AND NOT seen", "nonconsecutive_pitch_sequence": "pitch_number <> i_",
    "nonterminal_count_or_event_mismatch": "sound AND NOT last_ AND (end_ IS NOT NULL OR nb <> balls + (y_ = 0)::INT OR ns <> least(2, strikes + (y_ IN (1, 2))::INT))",
    "not_zero_count_start": "i_ = 1 AND (balls <> 0 OR strikes <> 0)", "observed_action_outside_common_support": "sound AND NOT ok_", "support_unavailable": "sound AND mask IS NULL",
    "post_score_next_state_mismatch": "scored AND (post_home_score <> nh OR post_away_score <> na)", "terminal_boundary_invalid": "coalesce(events <> 'truncated_pa', false) <> last_",
    "terminal_label_mismatch": "sound AND last_ AND NOT agreed", "unmapped_outcome": "NOT known"}


_ACTIONS_SQL = "[" + ", ".join(f"'{x}'" for x in TYPE_CODES) + "]"
TRAJECTORY_CTE = AUDIT_CTE + f""",
su AS (SELECT pitcher, bit_or(1::BIGINT << (list_position({_ACTIONS_SQL}, pitch_type) - 1)::INT) AS mask FROM (SELECT pitcher, pitch_type FROM log WHERE pitch_type IS NOT NULL AND pitcher % 7 <> 6 GROUP BY 1, 2 HAVING count(*) >= 12) GROUP BY 1),
t0 AS (SELECT log.*, {OUT10_SQL} AS y_, row_number() OVER w AS i_, lead(pitch_number) OVER w IS NULL AS last_, lead(balls) OVER w AS nb, lead(strikes) OVER w AS ns,
  CASE WHEN on_1b > 0 THEN 1 ELSE 0 END + CASE WHEN on_2b > 0 THEN 2 ELSE 0 END + CASE WHEN on_3b > 0 THEN 4 ELSE 0 END AS _bases,
  lead(inning) OVER g AS ni, lead(inning_topbot) OVER g AS nt, lead(outs_when_up) OVER g AS no, lead(home_score) OVER g AS nh, lead(away_score) OVER g AS na
  FROM log WINDOW w AS (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number), g AS (PARTITION BY game_pk ORDER BY at_bat_number, pitch_number)),
t1 AS (SELECT t0.*, mask, (mask >> (list_position({_ACTIONS_SQL}, pitch_type) - 1)::INT) & 1 = 1 AS ok_, CASE WHEN y_ = 0 AND balls = 3 THEN 'walk' WHEN y_ = 1 AND strikes = 2 THEN 'strikeout' WHEN y_ >= 3 THEN ['out', 'single', 'double', 'triple', 'home_run', 'hbp', 'double_play'][y_ - 2] END AS end_, {_NAMED_SQL} AS named
  FROM t0 LEFT JOIN su USING (pitcher)),
t2 AS (SELECT *, y_ >= 0 AS known, y_ >= 0 AND balls BETWEEN 0 AND 3 AND strikes BETWEEN 0 AND 2 AND pitch_type IS NOT NULL AS sound, ni = inning AND nt = inning_topbot AS same_,
  (inning_topbot = 'Top' AND ni = inning AND nt = 'Bot') OR (inning_topbot <> 'Top' AND ni = inning + 1 AND nt = 'Top') AS flip FROM t1),
t3 AS (SELECT *, sound AND last_ AND end_ IS NOT NULL AND end_ IS NOT DISTINCT FROM named AS agreed FROM t2),
t4 AS (SELECT *, agreed AND ni IS NOT NULL AS seen, CASE WHEN same_ THEN no - outs_when_up ELSE 3 - outs_when_up END AS dout FROM t3),
t5 AS (SELECT *, seen AND (same_ OR (flip AND no = 0)) AS moved FROM t4),
t6 AS (SELECT *, moved AND dout BETWEEN 0 AND 3 - outs_when_up AND coalesce(dout = CASE WHEN end_ IN ('out', 'strikeout') THEN 1 WHEN end_ = 'double_play' THEN 2 END, true) AS counted FROM t5),
t7 AS (SELECT *, counted AND least(nh - home_score, na - away_score) >= 0 AND greatest(nh - home_score, na - away_score) <= 4 AND CASE WHEN inning_topbot = 'Top' THEN nh - home_score ELSE na - away_score END = 0 AS scored FROM t6),
t8 AS (SELECT game_pk, at_bat_number, min_by(pitcher, i_) AS pitcher, coalesce(arg_max_null(named, i_), 'unknown') AS terminal_class, count(*) AS n_events, coalesce({_CHANGE_SQL}, false) AS mid_pa_context_change,
  {', '.join(f'coalesce(bool_or({x}), false) AS {name}' for name, x in _AGAINST_SQL.items())} FROM t7 GROUP BY 1, 2),
t9 AS (SELECT t8.*, NOT coalesce(supported, false) AS source_unsupported_pa FROM t8 LEFT JOIN au USING (game_pk, at_bat_number)),
t10 AS (SELECT game_pk, at_bat_number, pitcher, terminal_class, n_events, NOT ({' OR '.join(audit.TRAJECTORY_REASONS)}) AS retained,
  concat_ws('|', {', '.join(f"CASE WHEN {r} THEN '{r}' END" for r in audit.TRAJECTORY_REASONS)}) AS reasons FROM t9)
"""


def policy_support(t):
    """Actions with twelve events of an actor; one actor in seven has no support at all."""
    pairs = t.log.where("pitch_type is not null and pitcher % 7 <> 6").groupBy("pitcher", "pitch_type").count().where("count >= 12")
    return audit.support_masks(pairs, "pitcher", "pitch_type", TYPE_CODES)


def trajectories(t):
    return audit.trajectory_audit(t.log, policy_support(t), audited(t)[1], K, "pitch_type", TYPE_CODES, t.log_partitions)


@query("f02_trajectory_audit", TRAJECTORY_CTE + "SELECT * FROM t10")
def _f02a(t):
    return trajectories(t)


@query("f02_transitions", TRAJECTORY_CTE + """
SELECT game_pk, at_bat_number, pitch_number, pitch_type AS action, list_position(""" + _ACTIONS_SQL + """, pitch_type)::BIGINT - 1 AS action_number, mask, coalesce(lead(mask) OVER w, 0) AS next_mask, row_number() OVER w AS position,
  coalesce(lead(pitch_number) OVER w, -1) AS next_seq, lead(pitch_number) OVER w IS NULL AS done, CASE WHEN lead(pitch_number) OVER w IS NULL THEN terminal_class END AS terminal_event
FROM log JOIN (SELECT game_pk, at_bat_number, terminal_class FROM t10 WHERE retained) USING (game_pk, at_bat_number) JOIN su USING (pitcher) WINDOW w AS (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number)""")
def _f02(t):
    return audit.transitions(t.log, trajectories(t), policy_support(t), K, "pitch_type", TYPE_CODES, t.log_partitions)


_STATE_SQL = ", ".join(rewards.STATE)
_NEXT_SQL = ", ".join(f"next_{x}" for x in rewards.STATE)
SUCCESSOR_CTE = f"""
sh AS (SELECT event, bases, outs_when_up, out_delta, to_bases, adv_runs, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY event, bases, outs_when_up) AS BIGINT) AS cell FROM aok GROUP BY event, bases, outs_when_up, out_delta, to_bases, adv_runs),
ep AS (SELECT game_pk, at_bat_number, inning, inning_topbot, outs_when_up, CASE WHEN on_1b > 0 THEN 1 ELSE 0 END + CASE WHEN on_2b > 0 THEN 2 ELSE 0 END + CASE WHEN on_3b > 0 THEN 4 ELSE 0 END AS bases, home_score, away_score, terminal_class AS event
  FROM log JOIN (SELECT game_pk, at_bat_number, terminal_class FROM t10 WHERE retained) USING (game_pk, at_bat_number) WHERE pitch_number = 1),
pr AS (SELECT DISTINCT {_STATE_SQL}, event FROM ep),
ru AS (SELECT pr.*, CASE WHEN cell IS NULL THEN 1.0::DOUBLE ELSE 5.0::DOUBLE / (cell + 5) END AS weight,
    CASE WHEN event = 'double_play' AND outs_when_up < 2 AND bases % 2 = 1 THEN 2 WHEN event IN ('out', 'strikeout', 'double_play') THEN 1 ELSE 0 END AS out_delta,
    CASE WHEN event IN ('walk', 'hbp') THEN [1, 3, 3, 7, 5, 7, 7, 7][bases + 1] WHEN event = 'double_play' AND outs_when_up < 2 AND bases % 2 = 1 THEN bases - 1 WHEN event = 'single' THEN (bases * 2 + 1) % 8 WHEN event = 'double' THEN (bases * 4 + 2) % 8 WHEN event = 'triple' THEN 4 WHEN event = 'home_run' THEN 0 ELSE bases END AS to_bases,
    CASE WHEN event IN ('walk', 'hbp') THEN (bases = 7)::INT WHEN event = 'single' THEN bases // 4 WHEN event = 'double' THEN bases // 4 + bases // 2 % 2 WHEN event IN ('triple', 'home_run') THEN bases // 4 + bases // 2 % 2 + bases % 2 + (event = 'home_run')::INT ELSE 0 END AS adv_runs
  FROM pr LEFT JOIN (SELECT DISTINCT event, bases, outs_when_up, cell FROM sh) USING (event, bases, outs_when_up)),
al AS (SELECT {_STATE_SQL}, event, weight, out_delta, to_bases, adv_runs FROM ru UNION ALL SELECT {_STATE_SQL}, event, (n / (cell + 5.0))::DOUBLE, out_delta, to_bases, adv_runs FROM pr JOIN sh USING (event, bases, outs_when_up)),
sc AS (SELECT *, outs_when_up + out_delta AS o_, home_score + CASE WHEN inning_topbot = 'Bot' THEN adv_runs ELSE 0 END AS h_, away_score + CASE WHEN inning_topbot = 'Top' THEN adv_runs ELSE 0 END AS a_ FROM al),
st AS (SELECT *, CASE WHEN inning_topbot = 'Bot' AND inning >= 9 AND h_ > a_ THEN 'walkoff' WHEN o_ < 3 THEN 'on' WHEN inning >= 9 AND CASE WHEN inning_topbot = 'Top' THEN h_ > a_ ELSE a_ > h_ END THEN 'end' ELSE 'turn' END AS k_ FROM sc),
nx AS (SELECT {_STATE_SQL}, event, weight, CASE WHEN k_ = 'turn' AND inning_topbot = 'Bot' THEN inning + 1 ELSE inning END AS next_inning, CASE WHEN k_ <> 'turn' THEN inning_topbot WHEN inning_topbot = 'Top' THEN 'Bot' ELSE 'Top' END AS next_inning_topbot,
    CASE WHEN k_ = 'turn' THEN 0 ELSE least(o_, 2) END AS next_outs_when_up, CASE k_ WHEN 'turn' THEN CASE WHEN inning + (inning_topbot = 'Bot')::INT >= 10 THEN 2 ELSE 0 END WHEN 'end' THEN 0 ELSE to_bases END AS next_bases,
    CASE WHEN k_ = 'walkoff' AND event <> 'home_run' THEN least(h_, a_ + 1) ELSE h_ END AS next_home_score, a_ AS next_away_score, CASE WHEN k_ = 'walkoff' OR (k_ = 'end' AND inning_topbot = 'Top') THEN 'home' WHEN k_ = 'end' THEN 'away' END AS winner FROM st),
sx AS (SELECT {_STATE_SQL}, event, {_NEXT_SQL}, winner, sum(weight) AS probability FROM nx GROUP BY ALL)
"""


def retained_episodes(t, kept=None):
    """Initial state and terminal class of every retained episode (`kept`, if the audit is at hand)."""
    kept = trajectories(t).where("retained") if kept is None else kept
    bases = sum((F.when(c(f"on_{i}b") > 0, 1 << i - 1).otherwise(0) for i in (2, 3)), F.when(c("on_1b") > 0, 1).otherwise(0))
    first = t.log.where("pitch_number = 1").withColumn("bases", bases).select(*K.episode_key, *rewards.STATE)
    return dealt(first, K.episode_key, t.log_partitions).join(dealt(kept.select(*K.episode_key, "terminal_class"), K.episode_key, t.log_partitions), K.episode_key).select(*K.episode_key, *rewards.STATE, c("terminal_class").alias("event"))


def advancement_shares(t):
    return freq.advancement(advancement_rows(t), ["event", "bases", "outs_when_up"], ["out_delta", "to_bases", "adv_runs"])


def lead_value():
    """A given value of the home side: logistic in its lead over the root of the half periods left."""
    left = F.greatest(2 * (9 - c("inning")) + (c("inning_topbot") == "Top").cast("int") + (3 - c("outs_when_up")) / 3, F.lit(0.35))
    return 1 / (1 + F.exp(-(c("home_score") - c("away_score")) / F.sqrt(left + 0.5)))


@query("f03_successors", TRAJECTORY_CTE + ", " + ADV_CTE + ", " + SUCCESSOR_CTE + "SELECT * FROM sx", doubles=["probability"])
def _f03s(t):
    return rewards.successors(retained_episodes(t).select(*rewards.STATE, "event").distinct(), advancement_shares(t), 5.0)


@query("f03_terminal_rewards", TRAJECTORY_CTE + ", " + ADV_CTE + ", " + SUCCESSOR_CTE + f""",
va AS (SELECT *, CASE winner WHEN 'home' THEN 1.0 WHEN 'away' THEN 0.0 ELSE 1 / (1 + exp(-(next_home_score - next_away_score) / sqrt(greatest(2 * (9 - next_inning) + (next_inning_topbot = 'Top')::INT + (3 - next_outs_when_up) / 3.0::DOUBLE, 0.35) + 0.5))) END AS ph FROM sx),
rw AS (SELECT {_STATE_SQL}, event, sum(probability * CASE WHEN inning_topbot = 'Top' THEN ph ELSE 1 - ph END) AS reward FROM va GROUP BY ALL)
SELECT game_pk, at_bat_number, event, reward FROM ep JOIN rw USING ({_STATE_SQL}, event)""", doubles=["reward"])
def _f03(t):
    """Expected value after each retained episode for the side that defends, under a given value of states."""
    return rewards.terminal_rewards(retained_episodes(t), advancement_shares(t), lead_value(), K.episode_key, partitions=t.log_partitions)


@query("f03_fitted_rewards")
def _f03f(t):
    """The same under the fitted winner model."""
    return fitted_rewards(t, retained_episodes(t))


def fitted_rewards(t, episodes):
    fitted, names = winner_fit(t)
    value = rewards.fitted_value(fitted.coefficients, fitted.intercept, names)
    return rewards.terminal_rewards(episodes, advancement_shares(t), value, K.episode_key, partitions=t.log_partitions)


@query("f03_reward_check", TRAJECTORY_CTE + "SELECT count(*) AS episodes, 0::BIGINT AS outside, 0::BIGINT AS missing FROM t10 WHERE retained")
def _f03c(t):
    """Fitted rewards are probabilities, one for each retained episode."""
    kept = materialise(trajectories(t).where("retained").select(*K.episode_key, "terminal_class"))
    n = kept.join(fitted_rewards(t, retained_episodes(t, kept)), K.episode_key, "left")
    return n.agg(F.count("*").alias("episodes"), F.count_if((c("reward") < 0) | (c("reward") > 1) | F.isnan("reward")).alias("outside"), F.count_if(c("reward").isNull()).alias("missing"))


@query("f04_score_mismatch", """
s AS (SELECT *, lead(home_score) OVER g AS nh, lead(away_score) OVER g AS na FROM log WINDOW g AS (PARTITION BY game_pk ORDER BY at_bat_number, pitch_number))
SELECT game_pk, at_bat_number, pitch_number, nh < home_score OR na < away_score AS decreased, nh <> post_home_score OR na <> post_away_score AS mismatch FROM s WHERE nh <> post_home_score OR na <> post_away_score OR nh < home_score OR na < away_score""")
def _f04(t):
    w = K.in_cluster()
    x = t.log.withColumns({"nh": F.lead("home_score").over(w), "na": F.lead("away_score").over(w)})
    x = x.withColumns({"decreased": (c("nh") < c("home_score")) | (c("na") < c("away_score")), "mismatch": (c("nh") != c("post_home_score")) | (c("na") != c("post_away_score"))})
    return x.where("mismatch or decreased").select(*KEY, "decreased", "mismatch")


# Fates in the order in which they are decided; the first seven leave the denominator of the shares.
FATES = ("excluded_null_game_key", "excluded_null_or_invalid_key", "excluded_non_registered_game_type", "excluded_date_outside_source_range", "excluded_nonpositive_order_key", "excluded_duplicate_key", "conflicting_duplicate_key",
         "quarantined_multi_date_game", "excluded_invalid_state", "excluded_missing_handedness", "excluded_unmapped_label", "excluded_bip_missing_bb_type", "excluded_nonbip_with_bb_type", "excluded_bip_unknown_bb_type")
CONTENT = ["pit", "bl", "strikes", "outs_when_up", "sd", "bb", "description", "events", "pitch_type", "batter"]
BB_TYPES = ("ground_ball", "line_drive", "fly_ball", "popup")

FATE_CTE = f"""
dr AS (SELECT *, CASE WHEN k % 93 <> 5 THEN game_pk END AS gp, CASE WHEN k % 90 = 1 THEN NULL ELSE pitcher END AS pit, CASE WHEN k = 98 THEN 0 ELSE at_bat_number END AS ab, CASE WHEN k = 41 THEN 9 ELSE balls END AS bl, CASE WHEN k = 42 THEN NULL ELSE stand END AS sd,
  CASE WHEN k = 43 THEN 'bunt' WHEN k = 46 THEN 'popup' ELSE bb_type END AS bb FROM log),
du AS (SELECT *, 0 AS copy FROM dr UNION ALL SELECT *, 1 FROM dr WHERE k = 77 UNION ALL SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN NULL ELSE bl END AS bl), 1 FROM dr WHERE k = 78),
dm AS (SELECT *, min(CAST(ts AS DATE)) OVER (PARTITION BY gp) <> max(CAST(ts AS DATE)) OVER (PARTITION BY gp) AS multi, CASE WHEN gp IS NULL THEN 'excluded_null_game_key' WHEN pit IS NULL THEN 'excluded_null_or_invalid_key' WHEN game_type <> 'R' THEN 'excluded_non_registered_game_type'
  WHEN game_date < DATE '2024-01-02' THEN 'excluded_date_outside_source_range' WHEN ab <= 0 OR pitch_number <= 0 THEN 'excluded_nonpositive_order_key' END AS early FROM du),
dd AS (SELECT *, early IS NULL AND row_number() OVER q > 1 AS dup, early IS NULL AND count(DISTINCT ROW(pit, bl, strikes, outs_when_up, sd, bb, description, events, pitch_type, batter)) OVER (PARTITION BY gp, ab, pitch_number, early IS NULL) > 1 AS differ, {OUT10_SQL} AS y10_ FROM dm WINDOW q AS (PARTITION BY gp, ab, pitch_number, early IS NULL ORDER BY event_id, copy)),
fate AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN differ THEN 'conflicting_duplicate_key' WHEN dup THEN 'excluded_duplicate_key'
  WHEN multi THEN 'quarantined_multi_date_game' WHEN bl NOT BETWEEN 0 AND 3 OR strikes NOT BETWEEN 0 AND 2 OR outs_when_up NOT BETWEEN 0 AND 2 OR inning IS NULL OR home_score IS NULL OR away_score IS NULL THEN 'excluded_invalid_state'
  WHEN sd IS NULL THEN 'excluded_missing_handedness' WHEN y10_ < 0 THEN 'excluded_unmapped_label'
  WHEN description = 'hit_into_play' AND bb IS NULL THEN 'excluded_bip_missing_bb_type' WHEN description <> 'hit_into_play' AND bb IS NOT NULL THEN 'excluded_nonbip_with_bb_type'
  WHEN description = 'hit_into_play' AND bb NOT IN {BB_TYPES} THEN 'excluded_bip_unknown_bb_type' ELSE 'accepted' END AS fate FROM dd),
den AS (SELECT count(*) FILTER (fate NOT IN {FATES[:7]}) AS d FROM fate)
"""


@query("f05_row_fates", FATE_CTE + """
SELECT fate, count(*) AS n, max(d) AS denominator, count(*) / max(d) AS share, CASE WHEN fate IN ('excluded_unmapped_label', 'excluded_invalid_state') THEN count(*) > 0.005 * greatest(max(d), 1) ELSE fate = 'conflicting_duplicate_key' END AS stop FROM fate, den GROUP BY 1""", doubles=["share"])
def _f05(t):
    from tallylane.functions import codes
    raw = t.log.withColumns({"gp": F.when(c("k") % 93 != 5, c("game_pk")), "pit": F.when(c("k") % 90 != 1, c("pitcher")), "ab": F.when(c("k") == 98, 0).otherwise(c("at_bat_number")), "bl": F.when(c("k") == 41, 9).otherwise(c("balls")), "sd": F.when(c("k") != 42, c("stand")),
                             "bb": F.when(c("k") == 43, "bunt").when(c("k") == 46, "popup").otherwise(c("bb_type"))})
    raw = raw.withColumn("copy", F.explode(F.when(c("k").isin(77, 78), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    raw = raw.withColumn("bl", F.when(~((c("k") == 78) & (c("copy") == 1) & (c("event_id") % 2 == 0)), c("bl")))
    early = [("excluded_null_game_key", c("gp").isNull()), ("excluded_null_or_invalid_key", c("pit").isNull()), ("excluded_non_registered_game_type", c("game_type") != "R"),
             ("excluded_date_outside_source_range", c("game_date") < F.lit("2024-01-02").cast("date")), ("excluded_nonpositive_order_key", (c("ab") <= 0) | (c("pitch_number") <= 0))]
    played = c("description") == "hit_into_play"
    late = [("quarantined_multi_date_game", c("multi")),
            ("excluded_invalid_state", ~(c("bl").between(0, 3) & c("strikes").between(0, 2) & c("outs_when_up").between(0, 2)) | c("inning").isNull() | c("home_score").isNull() | c("away_score").isNull()),
            ("excluded_missing_handedness", c("sd").isNull()), ("excluded_unmapped_label", codes.outcome10(c("description"), c("events"), c("strikes")) < 0),
            ("excluded_bip_missing_bb_type", played & c("bb").isNull()), ("excluded_nonbip_with_bb_type", ~played & c("bb").isNotNull()), ("excluded_bip_unknown_bb_type", played & ~F.coalesce(c("bb").isin(*BB_TYPES), F.lit(True)))]
    day, game = F.to_date("ts"), Window.partitionBy("gp")
    raw = raw.withColumn("multi", F.min(day).over(game) != F.max(day).over(game))
    fates = audit.row_fates(raw, early, ("excluded_duplicate_key", "conflicting_duplicate_key", ["gp", "ab", "pitch_number"], ["event_id", "copy"], CONTENT), late)
    return audit.fate_census(fates, {"excluded_unmapped_label": 0.005, "excluded_invalid_state": 0.005, "conflicting_duplicate_key": 0.0}, FATES[:7])


SELECTION_CTE = AUDIT_CTE + f""",
zb AS (SELECT game_date, batter, CASE WHEN event_id % 13 <> 0 THEN sz_top + (event_id % 9) / 100.0 END AS zt, CASE WHEN batter % 10 <> 3 THEN sz_bot + (event_id % 5) / 100.0 END AS zl FROM log),
ob AS (SELECT d.batter, d.game_date, quantile_cont(zt, 0.5) AS ot, quantile_cont(zl, 0.5) AS ol FROM (SELECT DISTINCT batter, game_date FROM log) d JOIN zb z ON z.batter = d.batter AND z.game_date < d.game_date GROUP BY 1, 2),
lb AS (SELECT d.game_date, quantile_cont(zt, 0.5) AS lt, quantile_cont(zl, 0.5) AS ll FROM (SELECT DISTINCT game_date FROM log) d JOIN zb z ON z.game_date < d.game_date GROUP BY 1),
rp AS (SELECT d.pitcher, d.game_date, pitch_type, count(*) AS n FROM (SELECT DISTINCT pitcher, game_date FROM log) d JOIN log z ON z.pitcher = d.pitcher AND z.game_date < d.game_date AND z.game_date >= d.game_date - 90 WHERE pitch_type IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 20),
rr AS (SELECT pitcher, game_date, string_agg(pitch_type || ':' || n, '|' ORDER BY list_position({_ACTIONS_SQL}, pitch_type)) AS rep FROM rp GROUP BY 1, 2),
ep AS (SELECT game_pk, at_bat_number, min_by(batter, pitch_number) AS batter, min(game_date) AS game_date, count(*) AS n_events FROM log GROUP BY 1, 2),
cd AS (SELECT ep.*, p.pitcher, p.pitcher % 2 = 0 AS inc, coalesce(rep, '') AS repertoire, coalesce(ol, ll) AS zone_bottom, coalesce(ot, lt) AS zone_top FROM ep JOIN (SELECT DISTINCT game_pk, at_bat_number, pitcher FROM log) p USING (game_pk, at_bat_number)
  LEFT JOIN rr ON rr.pitcher = p.pitcher AND rr.game_date = ep.game_date LEFT JOIN ob ON ob.batter = ep.batter AND ob.game_date = ep.game_date LEFT JOIN lb ON lb.game_date = ep.game_date),
ag AS (SELECT cd.*, concat_ws('|', {", ".join(f"CASE WHEN {r} THEN '{r}' END" for r in audit.REASONS)}, CASE WHEN repertoire = '' THEN 'no_supported_prior_repertoire' END, CASE WHEN NOT coalesce(zone_top > zone_bottom, false) THEN 'missing_prior_zone_bounds' END) AS reasons FROM cd JOIN au USING (game_pk, at_bat_number)),
rk AS (SELECT pitcher, game_pk, row_number() OVER (PARTITION BY pitcher ORDER BY game_date, game_pk) AS kk FROM (SELECT DISTINCT pitcher, game_pk, game_date FROM ag WHERE reasons = '' AND inc)),
se AS (SELECT ag.game_pk, at_bat_number, ag.pitcher, n_events, CASE WHEN NOT inc THEN 'not_in_cohort' WHEN reasons <> '' THEN string_split(reasons, '|')[1] WHEN kk > 3 THEN 'beyond_cluster_limit' ELSE 'selected' END AS reason, reasons, repertoire, zone_bottom, zone_top
  FROM ag LEFT JOIN rk ON rk.pitcher = ag.pitcher AND rk.game_pk = ag.game_pk)
"""


def selection(t):
    """Episodes of the even-numbered actors; zone bounds vary by event, and some are unknown."""
    zones = t.log.withColumns({"sz_top": F.when(c("event_id") % 13 != 0, c("sz_top") + c("event_id") % 9 / 100), "sz_bot": F.when(c("batter") % 10 != 3, c("sz_bot") + c("event_id") % 5 / 100)})
    return audit.select_episodes(zones, audited(t)[1], K, t.log.where("pitcher % 2 = 0"), 3, TYPE_CODES)


@query("f06_episode_selection", SELECTION_CTE + "SELECT * FROM se", doubles=["zone_bottom", "zone_top"])
def _f06(t):
    return selection(t)


@query("f06_selection_coverage", SELECTION_CTE + """,
pc AS (SELECT pitcher, game_pk, count(*) AS n, count_if(reasons = '') AS ok, bool_or(reason = 'selected') AS taken FROM se WHERE reason <> 'not_in_cohort' GROUP BY 1, 2)
SELECT pitcher, count(*) AS clusters, sum(n) AS episodes, sum(ok) AS supported, count_if(taken) AS selected_clusters, coalesce(sum(n) FILTER (taken), 0) AS selected_episodes, coalesce(sum(ok) FILTER (taken), 0) AS selected_supported FROM pc GROUP BY 1""")
def _f06c(t):
    return audit.selection_coverage(selection(t), K)


# --- H, A10 ----------------------------------------------------------------------

@query("h01_union_seasons", "SELECT season, count(*) AS n FROM log GROUP BY 1")
def _h01(t):
    seasons = [r.season for r in t.log.select("season").distinct().collect()]
    parts = [t.log.where(c("season").eqNullSafe(s)) for s in sorted(seasons)]
    return reduce(DataFrame.unionByName, parts).groupBy("season").agg(F.count("*").alias("n"))


@query("h02_set_operations", """
a AS (SELECT pitcher, batter FROM log WHERE season <= 2022), b AS (SELECT pitcher, batter FROM log WHERE season > 2022)
SELECT 'both' AS kind, pitcher, batter FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_early', pitcher, batter FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def _h02(t):
    a, b = t.log.where("season <= 2022").select("pitcher", "batter"), t.log.where("season > 2022").select("pitcher", "batter")
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.subtract(b).withColumn("kind", F.lit("only_early")))


@query("h03_keep_first_last", """
f AS (SELECT *, row_number() OVER (PARTITION BY batter ORDER BY event_id) AS a, row_number() OVER (PARTITION BY batter ORDER BY event_id DESC) AS z FROM log)
SELECT 'first' AS kind, batter, event_id FROM f WHERE a = 1 UNION ALL SELECT 'last', batter, event_id FROM f WHERE z = 1""")
def _h03(t):
    b = t.log.select("batter", "event_id")
    return joins.keep_first(b, ["batter"], ["event_id"]).withColumn("kind", F.lit("first")).unionByName(joins.keep_last(b, ["batter"], ["event_id"]).withColumn("kind", F.lit("last")))


@query("h04_total_order", "SELECT season, pitcher, count(*) AS n FROM log GROUP BY 1, 2")
def _h04(t):
    n = t.log.groupBy("season", "pitcher").agg(F.count("*").alias("n"))
    return n.repartitionByRange("season", c("n").desc(), "pitcher").sortWithinPartitions("season", c("n").desc(), "pitcher")


@query("h05_top_k_per_group", """
n AS (SELECT pitcher, pitch_type, count(*) AS n FROM log WHERE pitch_type IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY pitcher ORDER BY n DESC, pitch_type) AS rank FROM n)
SELECT * FROM r WHERE rank <= 3""")
def _h05(t):
    n = t.log.where("pitch_type is not null").groupBy("pitcher", "pitch_type").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("pitcher").orderBy(c("n").desc(), "pitch_type"))).where("rank <= 3")


@query("h06_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", log=False)
def _h06(t):
    return gates.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("a10_ingest_census", """
r AS (SELECT CASE WHEN k = 5 THEN NULL ELSE game_pk END AS game_pk, at_bat_number, CASE WHEN k = 6 THEN 1 ELSE pitch_number END AS pitch_number, game_type, game_date FROM log)
SELECT count(*) AS rows, count_if(game_pk IS NULL) AS null_key, count_if(game_type <> 'R') AS wrong_type, count_if(game_date > DATE '2024-01-28') AS wrong_date, (SELECT count(*) FROM (SELECT 1 FROM r GROUP BY game_pk, at_bat_number, pitch_number HAVING count(*) > 1)) AS duplicate_keys FROM r""")
def _a10(t):
    bad = t.log.withColumns({"game_pk": F.when(c("k") != 5, c("game_pk")), "pitch_number": F.when(c("k") == 6, 1).otherwise(c("pitch_number"))})
    return gates.ingest_census(bad, KEY, {"wrong_type": c("game_type") != "R", "wrong_date": c("game_date") > F.lit("2024-01-28").cast("date")})


# --- C12 ---------------------------------------------------------------------------

@query("c12_donor_transfer", """
lb AS (SELECT *, least(greatest(CASE WHEN description IN ('ball','intent_ball','pitchout','automatic_ball') THEN 0 WHEN events IS NULL THEN 1 ELSE 2 END, 0), 2) AS y3 FROM log WHERE pitch_type IS NOT NULL AND release_speed IS NOT NULL),
q AS (SELECT DISTINCT pitch_type, p_throws, stand, game_date, pitcher FROM lb),
ph AS (SELECT q.pitcher, q.pitch_type, q.p_throws, q.game_date, avg(release_speed) AS f0, avg(pfx_x) AS f1 FROM (SELECT DISTINCT pitcher, pitch_type, p_throws, game_date FROM q) q JOIN lb l ON l.pitcher = q.pitcher AND l.pitch_type = q.pitch_type AND l.p_throws = q.p_throws AND l.game_date < q.game_date GROUP BY 1, 2, 3, 4),
sc AS (SELECT q.pitch_type, q.p_throws, q.game_date, stddev_pop(release_speed) AS s0, stddev_pop(pfx_x) AS s1 FROM (SELECT DISTINCT pitch_type, p_throws, game_date FROM q) q JOIN lb l ON l.pitch_type = q.pitch_type AND l.p_throws = q.p_throws AND l.game_date < q.game_date GROUP BY 1, 2, 3),
dn AS (SELECT d.pitch_type, d.p_throws, d.stand, d.game_date, l.pitcher, count(*) AS n, count_if(y3 = 0) AS c0, count_if(y3 = 1) AS c1, count_if(y3 = 2) AS c2, date_diff('day', max(l.game_date), d.game_date) AS age, avg(release_speed) AS dummy FROM (SELECT DISTINCT pitch_type, p_throws, stand, game_date FROM q) d JOIN lb l ON l.pitch_type = d.pitch_type AND l.p_throws = d.p_throws AND l.stand = d.stand AND l.game_date < d.game_date GROUP BY 1, 2, 3, 4, 5),
dp AS (SELECT dn.*, p.f0, p.f1 FROM dn JOIN (SELECT x.pitch_type, x.p_throws, x.game_date, l.pitcher, avg(release_speed) AS f0, avg(pfx_x) AS f1 FROM (SELECT DISTINCT pitch_type, p_throws, game_date FROM q) x JOIN lb l ON l.pitch_type = x.pitch_type AND l.p_throws = x.p_throws AND l.game_date < x.game_date GROUP BY 1, 2, 3, 4) p ON p.pitch_type = dn.pitch_type AND p.p_throws = dn.p_throws AND p.game_date = dn.game_date AND p.pitcher = dn.pitcher),
j AS (SELECT q.*, dp.pitcher AS dpit, dp.n, dp.n / (dp.n + 20.0) * power(2.0, -dp.age / 365.0) AS w, exp(-(power((dp.f0 - ph.f0) / sc.s0, 2) + power((dp.f1 - ph.f1) / sc.s1, 2)) / 2) AS sim, (c0 + 1 / 3.0) / (n + 1) AS r0, (c1 + 1 / 3.0) / (n + 1) AS r1, (c2 + 1 / 3.0) / (n + 1) AS r2, ph.f0 IS NULL OR s0 IS NULL OR s0 <= 1e-8 OR s1 <= 1e-8 AS ab
  FROM q LEFT JOIN ph USING (pitcher, pitch_type, p_throws, game_date) LEFT JOIN sc USING (pitch_type, p_throws, game_date) LEFT JOIN dp ON dp.pitch_type = q.pitch_type AND dp.p_throws = q.p_throws AND dp.stand = q.stand AND dp.game_date = q.game_date AND dp.pitcher <> q.pitcher),
g AS (SELECT pitch_type, p_throws, stand, game_date, pitcher, bool_or(ab) AS ab, coalesce(sum(w), 0) AS w, coalesce(sum(n), 0) AS n, sum(w * r0) AS g0, sum(w * r1) AS g1, sum(w * r2) AS g2, sum(w * sim) AS ws, sum(w * sim * r0) AS s0, sum(w * sim * r1) AS s1, sum(w * sim * r2) AS s2 FROM j GROUP BY ALL)
SELECT pitch_type, p_throws, stand, game_date, pitcher, """ + ", ".join(f"CASE WHEN w > 0 THEN g{i} / w ELSE 0 END AS generic{i}, CASE WHEN ab THEN CASE WHEN w > 0 THEN g{i} / w ELSE 0 END WHEN ws > 0 THEN s{i} / ws ELSE 0 END AS similar{i}" for i in range(3)) + ", ln(1 + n) AS donor_log_n, w <= 0 AS no_donor, ab AS similarity_abstain FROM g",
  doubles=[f"{a}{i}" for a in ("generic", "similar") for i in range(3)] + ["donor_log_n"])
def _c12(t):
    """Outcome rates borrowed from all other actors of the stratum, generic and by physical similarity."""
    feats = ["release_speed", "pfx_x"]
    y = F.when(c("description").isin("ball", "intent_ball", "pitchout", "automatic_ball"), 0).when(c("events").isNull(), 1).otherwise(2)
    log = t.log.where("pitch_type is not null and release_speed is not null").withColumn("y3", y)
    kind, stratum = ["pitch_type", "p_throws"], ["pitch_type", "p_throws", "stand"]
    q = log.select(*stratum, "game_date", "pitcher").distinct()
    sums = {"_n": F.lit(1), **{f"_s{i}": c(f) for i, f in enumerate(feats)}, **{f"_q{i}": c(f) * c(f) for i, f in enumerate(feats)}}
    by_actor = asof.daily_sums(log, [*kind, "pitcher"], "game_date", sums)
    own_q = q.select(*kind, "pitcher", "game_date").distinct()
    own = asof.asof_profile(own_q, by_actor, [*kind, "pitcher"], "game_date", list(sums)).select(*own_q.columns, *[(c(f"_s{i}") / c("_n")).alias(f"own_{f}") for i, f in enumerate(feats)])
    kd = q.select(*kind, "game_date").distinct()
    by_kind = by_actor.groupBy(*kind, "game_date").agg(*[F.sum(n).alias(n) for n in sums])
    scale = asof.asof_profile(kd, by_kind, kind, "game_date", list(sums)).select(
        *kd.columns, *[F.sqrt(F.greatest(c(f"_q{i}") / c("_n") - (c(f"_s{i}") / c("_n")) * (c(f"_s{i}") / c("_n")), F.lit(0.0))).alias(f"scale_{f}") for i, f in enumerate(feats)])
    counts = {**{f"n{i}": F.when(c("y3") == i, 1).otherwise(0) for i in range(3)}}
    hist = asof.daily_sums(log, [*stratum, "pitcher"], "game_date", counts)
    # the donor profile valid on each date of its stratum: one as-of pick per (stratum, donor, date)
    grid = log.select(*stratum, "pitcher").distinct().join(q.select(*stratum, "game_date").distinct(), stratum)
    don = asof.asof_profile(grid, hist.withColumn("_day", F.lit(0.0)), [*stratum, "pitcher"], "game_date", [*counts]).where("n0 is not null")
    w = Window.partitionBy(*stratum, "pitcher").orderBy(F.unix_date("game_date")).rangeBetween(Window.unboundedPreceding, -1)
    seen = hist.select(*stratum, "pitcher", "game_date", F.unix_date("game_date").cast("bigint").alias("_d"))
    last = grid.join(seen, [*stratum, "pitcher", "game_date"], "left").withColumn("last_day", F.max("_d").over(w)).drop("_d")
    don = don.join(last, [*stratum, "pitcher", "game_date"]).join(own_profile(t, by_actor, grid, kind, sums, feats), [*kind, "pitcher", "game_date"])
    rows = q.join(own, [*kind, "pitcher", "game_date"], "left").join(scale, [*kind, "game_date"], "left").withColumn("day", F.unix_date("game_date").cast("bigint"))
    rows = rows.withColumn("abstain", c("own_release_speed").isNull() | ~F.coalesce((c("scale_release_speed") > 1e-8) & (c("scale_pfx_x") > 1e-8), F.lit(False)))
    out = joins.donor_transfer(rows, don, [*stratum, "game_date"], "pitcher", feats, 20.0, 365.0, 3)
    return out.select(*stratum, "game_date", "pitcher", *[f"{a}{i}" for i in range(3) for a in ("generic", "similar")], "donor_log_n", "no_donor", "similarity_abstain")


def own_profile(t, by_actor, grid, kind, sums, feats):
    keys = grid.select(*kind, "pitcher", "game_date").distinct()
    prof = asof.asof_profile(keys, by_actor, [*kind, "pitcher"], "game_date", list(sums)).where("_n is not null")
    return prof.select(*keys.columns, *[(c(f"_s{i}") / c("_n")).alias(f) for i, f in enumerate(feats)])
