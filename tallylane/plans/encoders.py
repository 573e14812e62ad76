"""Section B: encoders, predicates and numeric features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallylane.functions import codes, features, probs, states
from tallylane.keys import DEFAULT_KEYS as K
from tallylane.operators import encode
from tallylane.plans.registry import query

c = F.col
KEY = ["game_pk", "at_bat_number", "pitch_number"]

GROUP_SQL = """CASE WHEN pitch_type IN ('FF','FA') THEN 0 WHEN pitch_type = 'SI' THEN 1 WHEN pitch_type = 'FC' THEN 2
  WHEN pitch_type IN ('SL','SV') THEN 3 WHEN pitch_type = 'ST' THEN 4 WHEN pitch_type IN ('CU','KC','CS') THEN 5
  WHEN pitch_type = 'CH' THEN 6 WHEN pitch_type IN ('FS','FO') THEN 7 WHEN pitch_type IN ('KN','SC','EP') THEN 8 ELSE -1 END"""
OUT11_SQL = """CASE WHEN events IN ('strikeout','strikeout_double_play') THEN 3 WHEN events IN ('walk','intent_walk') THEN 4
  WHEN description = 'hit_by_pitch' THEN 5
  WHEN description = 'hit_into_play' THEN CASE events WHEN 'single' THEN 6 WHEN 'double' THEN 7 WHEN 'triple' THEN 8 WHEN 'home_run' THEN 9 ELSE 10 END
  WHEN description IN ('ball','blocked_ball','automatic_ball','intent_ball','pitchout') THEN 0
  WHEN description IN ('called_strike','swinging_strike','swinging_strike_blocked','foul_tip','bunt_foul_tip','missed_bunt','automatic_strike') THEN 1
  WHEN description IN ('foul','foul_bunt','foul_pitchout') THEN 2 ELSE -1 END"""
OUT10_SQL = """CASE WHEN description IN ('ball','blocked_ball','pitchout','intent_ball') THEN 0
  WHEN description IN ('called_strike','swinging_strike','swinging_strike_blocked','missed_bunt','foul_tip','bunt_foul_tip') OR (description = 'foul_bunt' AND strikes = 2) THEN 1
  WHEN description IN ('foul','foul_bunt') THEN 2 WHEN description = 'hit_by_pitch' THEN 8
  WHEN description = 'hit_into_play' THEN CASE
    WHEN events IN ('field_out','force_out','fielders_choice_out','sac_fly','sac_bunt') THEN 3
    WHEN events IN ('double_play','grounded_into_double_play','sac_fly_double_play','sac_bunt_double_play') THEN 9
    WHEN events = 'single' THEN 4 WHEN events = 'double' THEN 5 WHEN events = 'triple' THEN 6 WHEN events = 'home_run' THEN 7 ELSE -1 END
  ELSE -1 END"""
BASE_OUT_SQL = "outs_when_up * 8 + CASE WHEN on_1b > 0 THEN 1 ELSE 0 END + CASE WHEN on_2b > 0 THEN 2 ELSE 0 END + CASE WHEN on_3b > 0 THEN 4 ELSE 0 END"
ZN_SQL = "CASE WHEN sz_top > sz_bot THEN (plate_z - sz_bot) / (sz_top - sz_bot) END"
LOC_SQL = f"""CASE WHEN plate_x IS NULL OR plate_z IS NULL THEN -1 ELSE
  (CASE WHEN {ZN_SQL} >= 1.0 THEN 4 WHEN {ZN_SQL} >= CAST(2.0 AS DOUBLE) / 3.0 THEN 3 WHEN {ZN_SQL} >= CAST(1.0 AS DOUBLE) / 3.0 THEN 2 WHEN {ZN_SQL} >= 0 THEN 1 ELSE 0 END) * 5 +
  (CASE WHEN plate_x >= CAST(0.83 AS DOUBLE) THEN 4 WHEN plate_x >= CAST(0.28 AS DOUBLE) THEN 3 WHEN plate_x >= CAST(-0.28 AS DOUBLE) THEN 2 WHEN plate_x >= CAST(-0.83 AS DOUBLE) THEN 1 ELSE 0 END) END"""
# log rows with ids, used by many SQL counterparts
IDS_CTE = f"""
ids0 AS (
  SELECT *, {GROUP_SQL} AS pitch_id, {LOC_SQL} AS loc_id, {OUT11_SQL} AS outcome_id, {OUT10_SQL} AS y10,
    balls * 3 + strikes AS count_id, {BASE_OUT_SQL} AS base_out_id FROM log),
ids AS (
  SELECT *, CASE WHEN pitch_id >= 0 AND loc_id >= 0 THEN pitch_id * 25 + loc_id ELSE -1 END AS action_id,
    outcome_id >= 3 AS terminal, count_id * 24 + base_out_id AS state_id FROM ids0)
"""


@query("b01_code_group", "SELECT game_pk, at_bat_number, pitch_number, pitch_type, " + GROUP_SQL + " AS group_id FROM log")
def _b01(t):
    return t.log.select(*KEY, "pitch_type", codes.group_id(c("pitch_type")).alias("group_id"))


@query("b02_outcome11", f"SELECT game_pk, at_bat_number, pitch_number, {OUT11_SQL} AS outcome_id FROM log")
def _b02(t):
    return t.log.select(*KEY, codes.outcome11(c("description"), c("events")).alias("outcome_id"))


@query("b03_outcome10_held", f"""SELECT game_pk, at_bat_number, pitch_number, {OUT10_SQL} AS label,
  CASE WHEN {OUT10_SQL} < 0 THEN CASE WHEN description = 'hit_into_play' THEN CASE WHEN coalesce(events, '') = '' THEN 'hit_into_play_events_null' ELSE 'hit_into_play_events_unmapped' END
    WHEN coalesce(description, '') = '' THEN 'description_null' ELSE 'description_unmapped' END END AS held_reason FROM log""")
def _b03(t):
    a = (c("description"), c("events"), c("strikes"))
    return t.log.select(*KEY, codes.outcome10(*a).alias("label"), codes.held_reason(*a).alias("held_reason"))


@query("b04_leaf_and_fate", f"""
b AS (SELECT *, {OUT10_SQL} AS y, coalesce(bb_type, 'None') AS bb, coalesce(events, '') AS e FROM log),
l AS (SELECT *, CASE WHEN y = 0 THEN 0 WHEN y = 2 THEN 1 WHEN y = 8 THEN 2
    WHEN y = 1 THEN CASE WHEN description IN ('swinging_strike', 'swinging_strike_blocked') THEN 3 ELSE 4 END
    WHEN y >= 3 THEN CASE WHEN bb = 'ground_ball' THEN 5 ELSE 6 END ELSE -1 END AS leaf,
  e IN ('single','double','triple','home_run','field_out','force_out','fielders_choice_out','sac_fly','sac_bunt','double_play','grounded_into_double_play','sac_fly_double_play','sac_bunt_double_play') AS core FROM b)
SELECT game_pk, at_bat_number, pitch_number, leaf,
  CASE WHEN description = 'hit_into_play' AND e = 'catcher_interf' THEN 'ABSTAIN_BIP_CATCHER_INTERF'
    WHEN description = 'hit_into_play' AND bb = 'None' THEN 'ABSTAIN_BIP_MISSING_BB_TYPE'
    WHEN description = 'hit_into_play' AND core THEN CASE WHEN bb = 'ground_ball' THEN 'LEAF5' ELSE 'LEAF6' END
    WHEN description = 'hit_into_play' THEN CASE WHEN bb = 'ground_ball' THEN 'HYPOTHESIS_LEAF5_GB_BIP_OUTCOME_DEPENDENT' ELSE 'HYPOTHESIS_LEAF6_NONGB_BIP_OUTCOME_DEPENDENT' END
    WHEN description IN ('ball','blocked_ball','pitchout','intent_ball') THEN 'LEAF0' WHEN description = 'foul' OR (description = 'foul_bunt' AND strikes <> 2) THEN 'LEAF1'
    WHEN description = 'hit_by_pitch' THEN 'LEAF2' WHEN description IN ('swinging_strike', 'swinging_strike_blocked') THEN 'LEAF3'
    WHEN description IN ('called_strike','foul_tip','bunt_foul_tip','missed_bunt','foul_bunt') THEN 'LEAF4'
    WHEN description IN ('automatic_ball','automatic_strike') THEN CASE WHEN pitch_type IS NOT NULL OR release_speed IS NOT NULL THEN 'ABSTAIN_AUTOMATIC_WITH_TRACKING' ELSE 'NOT_A_PITCH_AUTOMATIC' END
    ELSE 'ABSTAIN_UNKNOWN_DESCRIPTION' END AS fate FROM l""")
def _b04(t):
    tracked = c("pitch_type").isNotNull() | c("release_speed").isNotNull()
    return t.log.select(
        *KEY, codes.leaf7(c("description"), c("events"), c("strikes"), c("bb_type")).alias("leaf"),
        codes.row_fate(c("description"), c("events"), c("strikes"), c("bb_type"), tracked).alias("fate"))


@query("b05_count_base_out", f"""
e AS (SELECT *, balls * 3 + strikes AS count_id, {BASE_OUT_SQL} AS base_out_id FROM log)
SELECT game_pk, at_bat_number, pitch_number, count_id, base_out_id, count_id // 3 AS balls, count_id % 3 AS strikes,
  base_out_id // 8 AS outs, on_1b IS NOT NULL AS r1, on_2b IS NOT NULL AS r2, on_3b IS NOT NULL AS r3 FROM e""")
def _b05(t):
    enc = t.log.select(*KEY, states.count_id(c("balls"), c("strikes")).alias("count_id"),
                       states.base_out_id(c("outs_when_up"), c("on_1b"), c("on_2b"), c("on_3b")).alias("base_out_id"))
    return enc.withColumns({"balls": states.idiv(c("count_id"), 3), "strikes": c("count_id") % 3, **states.decode_base_out(c("base_out_id"))})


@query("b06_state_id", f"""
p AS (SELECT *, lag(pitch_id) OVER (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number) AS pp FROM ids),
s AS (SELECT *, batter % 6 AS cl, CASE WHEN coalesce(pp, -1) < 0 THEN 0 ELSE pp // 3 + 1 END AS cx FROM p),
z AS (SELECT *, ((count_id * 24 + base_out_id) * 6 + cl) * 4 + cx AS sid FROM s)
SELECT game_pk, at_bat_number, pitch_number, sid AS state_id, sid // 24 // 24 AS d_count, sid // 24 % 24 AS d_base_out,
  sid // 4 % 6 AS d_cluster, sid % 4 AS d_context, count_id BETWEEN 0 AND 11 AND base_out_id BETWEEN 0 AND 23 AND cl BETWEEN 0 AND 5 AND cx BETWEEN 0 AND 3 AS in_range FROM z""".replace("p AS", IDS_CTE + ", p AS", 1))
def _b06(t):
    log = t.ids.withColumn("cluster_id", c("batter") % 6)
    log = encode.previous_context(log, K, "family")
    args = (c("count_id"), c("base_out_id"), c("cluster_id"), 6, c("context_id"), 4)
    out = log.withColumn("in_range", states.state_in_range(*args)).withColumn("state_id", states.state_id(*args))
    d = states.decode_state(c("state_id"), 6, 4)
    return out.select(*KEY, "state_id", "in_range", d["count_id"].alias("d_count"), d["base_out_id"].alias("d_base_out"),
                      d["cluster_id"].alias("d_cluster"), d["context_id"].alias("d_context"))


@query("b07_location_grid", IDS_CTE + """
SELECT game_pk, at_bat_number, pitch_number, loc_id, action_id,
  CASE WHEN loc_id >= 0 THEN [-1.105, -0.555, 0.0, 0.555, 1.105][loc_id % 5 + 1] END AS centre_x,
  CASE WHEN loc_id >= 0 THEN (loc_id // 5 * 2 - 1) / CAST(6 AS DOUBLE) END AS centre_z FROM ids""", doubles=["centre_x", "centre_z"])
def _b07(t):
    log = t.ids
    x, z = states.cell_centre(F.greatest(c("loc_id"), F.lit(0)))
    known = c("loc_id") >= 0
    return log.select(*KEY, "loc_id", "action_id", F.when(known, x).alias("centre_x"), F.when(known, z).alias("centre_z"))


@query("b08_previous_context", IDS_CTE + """,
p AS (SELECT *, lag(pitch_id) OVER w AS pp, lag(loc_id) OVER w AS pl FROM ids WINDOW w AS (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number))
SELECT game_pk, at_bat_number, pitch_number, CASE WHEN coalesce(pp, -1) < 0 THEN 0 ELSE pp // 3 + 1 END AS family,
  CASE WHEN coalesce(pp, -1) < 0 OR coalesce(pl, -1) < 0 THEN 0 ELSE 1 + pp // 3 * 2 + CASE WHEN pl // 5 BETWEEN 1 AND 3 AND pl % 5 BETWEEN 1 AND 3 THEN 1 ELSE 0 END END AS family_zone FROM p""")
def _b08(t):
    log = t.ids
    log = encode.previous_context(log, K, "family", "family")
    log = encode.previous_context(log, K, "family_zone", "family_zone")
    return log.select(*KEY, "family", "family_zone")


@query("b09_rule_mask_census", IDS_CTE + """,
n AS (SELECT count_id, outcome_id, count(*) AS n FROM ids WHERE outcome_id >= 0 GROUP BY ALL),
r AS (SELECT ci AS count_id, oi AS outcome_id, ci // 3 AS b, ci % 3 AS s FROM range(12) a(ci), range(11) o(oi))
SELECT r.count_id, r.outcome_id, CASE r.outcome_id WHEN 0 THEN b < 3 WHEN 4 THEN b = 3 WHEN 1 THEN s < 2 WHEN 3 THEN s = 2 ELSE true END AS allowed,
  CASE WHEN r.outcome_id = 0 AND b < 3 THEN (b + 1) * 3 + s WHEN r.outcome_id = 1 AND s < 2 THEN b * 3 + s + 1 WHEN r.outcome_id = 2 THEN b * 3 + least(s + 1, 2) END AS next_count_id,
  coalesce(n, 0) AS n FROM r LEFT JOIN n USING (count_id, outcome_id)""")
def _b09(t):
    """How many log rows sit in each (count, outcome) cell of the rule table."""
    seen = t.ids.where("outcome_id >= 0").groupBy("count_id", "outcome_id").agg(F.count("*").alias("n"))
    rules = states.count_outcome_table(t.spark)
    return seen.join(rules, ["count_id", "outcome_id"], "right").fillna(0, ["n"])


@query("b10_dimension_usage", IDS_CTE + """,
n AS (SELECT action_id, count(*) AS n FROM ids WHERE action_id >= 0 GROUP BY 1)
SELECT a AS action_id, a // 25 AS group_id, a % 25 AS loc_id, a % 25 // 5 AS z_row, a % 5 AS x_col, coalesce(n, 0) AS n
FROM range(225) r(a) LEFT JOIN n ON n.action_id = a""")
def _b10(t):
    """Every action of the generated dimension with its use in the log."""
    n = t.ids.where("action_id >= 0").groupBy("action_id").agg(F.count("*").alias("n"))
    return n.join(states.actions_table(t.spark), "action_id", "right").fillna(0, ["n"])


_TERMINAL_FROM = 3


@query("b10_outcome_usage", IDS_CTE + f""",
n AS (SELECT outcome_id, count(*) AS n, count(DISTINCT pitch_type) AS kinds FROM ids WHERE outcome_id >= 0 GROUP BY 1)
SELECT o AS outcome_id, ({list(codes.OUTCOME11)})[o + 1] AS name, o >= {_TERMINAL_FROM} AS terminal, CASE o WHEN 0 THEN 'ball' WHEN 1 THEN 'strike' WHEN 2 THEN 'foul' END AS count_rule, coalesce(n, 0) AS n, coalesce(kinds, 0) AS kinds
FROM range(11) r(o) LEFT JOIN n ON n.outcome_id = o""")
def _b10o(t):
    """Every outcome of the generated dimension with its use in the log."""
    n = t.ids.where("outcome_id >= 0").groupBy("outcome_id").agg(F.count("*").alias("n"), F.count_distinct("pitch_type").alias("kinds"))
    return n.join(states.outcomes_table(t.spark), "outcome_id", "right").fillna(0, ["n", "kinds"])


@query("b11_physical_channels", """SELECT game_pk, at_bat_number, pitch_number, plate_x * CASE WHEN stand = 'L' THEN -1.0 ELSE 1.0 END AS x,
  """ + ZN_SQL + """ AS zn, coalesce(effective_speed, release_speed) AS speed, release_spin_rate AS spin,
  sin(radians(spin_axis)) AS axis_sin, cos(radians(spin_axis)) AS axis_cos,
  pfx_x * CASE WHEN stand = 'L' THEN -1.0 ELSE 1.0 END AS move_x, pfx_z AS move_z FROM log""",
  doubles=["x", "zn", "speed", "spin", "axis_sin", "axis_cos", "move_x", "move_z"])
def _b11(t):
    return t.log.select(*KEY, *[e.alias(n) for n, e in features.physical_channels().items()])


TRAIN = "season <= 2022"


@query("b12_impute_standardise", """
tr AS (SELECT median(plate_x) AS fx, median(release_speed) AS fs FROM log WHERE season <= 2022),
st AS (SELECT avg(coalesce(plate_x, fx)) AS mx, greatest(stddev_pop(coalesce(plate_x, fx)), 1e-6) AS sx,
   avg(coalesce(release_speed, fs)) AS ms, greatest(stddev_pop(coalesce(release_speed, fs)), 1e-6) AS ss FROM log, tr WHERE season <= 2022)
SELECT game_pk, at_bat_number, pitch_number, (coalesce(plate_x, fx) - mx) / sx AS plate_x_z, (coalesce(release_speed, fs) - ms) / ss AS release_speed_z
FROM log, tr, st""", doubles=["plate_x_z", "release_speed_z"])
def _b12(t):
    cols = ["plate_x", "release_speed"]
    log = t.log
    params = features.fit_scaler(log.where(TRAIN), cols)
    return features.apply_scaler(log.select(*KEY, *cols), params, cols).drop(*cols)


@query("b13_hinge_basis", """
tr AS (SELECT median(pfx_x) AS f FROM log WHERE season <= 2022),
st AS (SELECT avg(coalesce(pfx_x, f)) AS m, greatest(stddev_pop(coalesce(pfx_x, f)), 1e-8) AS s FROM log, tr WHERE season <= 2022),
z AS (SELECT game_pk, at_bat_number, pitch_number, season, greatest(-8.0, least(8.0, (coalesce(pfx_x, f) - m) / s)) AS pfx_x_z FROM log, tr, st),
q AS (SELECT quantile_cont(pfx_x_z, 0.25) AS q1, quantile_cont(pfx_x_z, 0.5) AS q2, quantile_cont(pfx_x_z, 0.75) AS q3 FROM z WHERE season <= 2022)
SELECT game_pk, at_bat_number, pitch_number, pfx_x_z, greatest(pfx_x_z - q1, 0) AS pfx_x_z_h1, greatest(pfx_x_z - q2, 0) AS pfx_x_z_h2, greatest(pfx_x_z - q3, 0) AS pfx_x_z_h3 FROM z, q""",
  doubles=["pfx_x_z", "pfx_x_z_h1", "pfx_x_z_h2", "pfx_x_z_h3"])
def _b13(t):
    log = t.log
    params = features.fit_scaler(log.where(TRAIN), ["pfx_x"], 1e-8)
    z = features.apply_scaler(log.select(*KEY, "season", "pfx_x"), params, ["pfx_x"], clip=features.HINGE_CLIP)
    return features.hinges(z, z.where(TRAIN), "pfx_x_z").drop("season", "pfx_x")


@query("b14_quantile_bucketise", """
q AS (SELECT quantile_cont(release_speed, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS e FROM log WHERE season <= 2022)
SELECT game_pk, at_bat_number, pitch_number, CASE WHEN release_speed IS NULL THEN 0 ELSE 1 + len(list_filter(e, lambda x: x <= release_speed)) END AS bucket FROM log, q""")
def _b14(t):
    log = t.log
    return features.bucketise(log.select(*KEY, "release_speed"), log.where(TRAIN), "release_speed", 8, "bucket").drop("release_speed")


@query("b15_temporal_split", """
s AS (SELECT *, CASE WHEN game_date < DATE '2024-01-08' THEN 'history' WHEN game_date <= DATE '2024-01-18' THEN 'train' WHEN game_date <= DATE '2024-01-24' THEN 'calibration' ELSE 'dev' END AS split,
  pitcher % 5 = 0 AS held FROM log),
m AS (SELECT *, CASE WHEN game_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-15' AND NOT held THEN 'FIT'
   WHEN game_date BETWEEN DATE '2024-01-16' AND DATE '2024-01-20' AND NOT held THEN 'SELECT'
   WHEN game_date BETWEEN DATE '2024-01-21' AND DATE '2024-01-25' AND NOT held THEN 'CAL'
   WHEN game_date BETWEEN DATE '2024-01-26' AND DATE '2024-01-31' AND held THEN 'EVAL' END AS role FROM s)
SELECT 'split' AS kind, split AS label, count(*) AS n, count(DISTINCT game_pk) AS games FROM m GROUP BY split
UNION ALL SELECT 'role', coalesce(role, 'none'), count(*), count(DISTINCT game_pk) FROM m GROUP BY role
UNION ALL SELECT 'fold' || f, CASE WHEN day(game_date) <= f - 6 THEN 'train' WHEN day(game_date) <= f - 4 THEN 'earlystop' WHEN day(game_date) <= f - 2 THEN 'temperature' WHEN day(game_date) <= f THEN 'blend' ELSE 'dev' END, count(*), count(DISTINCT game_pk)
  FROM m, (VALUES (16), (24)) v(f) WHERE day(game_date) <= f + 6 GROUP BY 1, 2""")
def _b15(t):
    log = encode.date_split(t.log, "game_date", [("history", "2024-01-07"), ("train", "2024-01-18"), ("calibration", "2024-01-24")], "dev")
    log = encode.role_masks(log, "game_date", {"FIT": ("2024-01-01", "2024-01-15"), "SELECT": ("2024-01-16", "2024-01-20"),
                                              "CAL": ("2024-01-21", "2024-01-25"), "EVAL": ("2024-01-26", "2024-01-31")}, c("pitcher") % 5 == 0)
    fold = encode.rolling_folds(log, "game_date", {
        f"fold{f}": [("train", f"2024-01-{f - 6:02d}"), ("earlystop", f"2024-01-{f - 4:02d}"), ("temperature", f"2024-01-{f - 2:02d}"), ("blend", f"2024-01-{f:02d}"), ("dev", f"2024-01-{f + 6:02d}")]
        for f in (16, 24)})
    aggs = (F.count("*").alias("n"), F.countDistinct("game_pk").alias("games"))
    parts = [log.groupBy(F.lit("split").alias("kind"), c("split").alias("label")).agg(*aggs),
             log.groupBy(F.lit("role").alias("kind"), F.coalesce("role", F.lit("none")).alias("label")).agg(*aggs),
             fold.groupBy(c("fold").alias("kind"), c("part").alias("label")).agg(*aggs)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("b16_eligibility_bitmask", f"""
f AS (SELECT *, {OUT10_SQL} < 0 AS f0, k % 23 = 0 AS f1, pitch_type IS NULL AS f2, plate_x IS NULL AS f3, plate_z IS NULL AS f4, balls NOT BETWEEN 0 AND 3 AS f5, strikes NOT BETWEEN 0 AND 2 AS f6 FROM log),
b AS (SELECT *, f0::INT + f1::INT * 2 + f2::INT * 4 + f3::INT * 8 + f4::INT * 16 + f5::INT * 32 + f6::INT * 64 AS bits FROM f)
SELECT bits AS reason_bits, count(*) AS n, count(DISTINCT game_pk) AS games, bits = 0 AS eligible FROM b GROUP BY bits""")
def _b16(t):
    flags = encode.eligibility_flags(c("k") % 23 != 0)
    return encode.reason_bits(t.log, flags).groupBy("reason_bits").agg(
        F.count("*").alias("n"), F.countDistinct("game_pk").alias("games")).withColumn("eligible", c("reason_bits") == 0)


@query("b17_winner_design", """
b AS (SELECT *, home_score - away_score AS diff, CASE WHEN inning_topbot = 'Bot' THEN 1.0 ELSE 0.0 END AS bot,
   (on_1b IS NOT NULL)::INT AS o1, (on_2b IS NOT NULL)::INT AS o2, (on_3b IS NOT NULL)::INT AS o3 FROM log),
s AS (SELECT *, CAST(2 * bot - 1 AS DOUBLE) AS sg, sqrt(greatest(CAST(2 * (9 - inning) + (1 - bot) AS DOUBLE) + (3 - outs_when_up) / CAST(3 AS DOUBLE), 0.35) + 0.5) AS sc FROM b)
SELECT game_pk, at_bat_number, pitch_number, CAST(1 AS DOUBLE) AS w0, diff / sc AS w1, CAST(diff AS DOUBLE) AS w2, CAST(bot AS DOUBLE) AS w3, inning / CAST(9 AS DOUBLE) AS w4, outs_when_up / CAST(3 AS DOUBLE) AS w5,
  bot * outs_when_up / CAST(3 AS DOUBLE) AS w6, CASE WHEN inning >= 9 THEN CAST(1 AS DOUBLE) ELSE 0 END AS w7, sg / sc AS w8, sg * outs_when_up / (3 * sc) AS w9,
  o1 * sg / sc AS w10, o2 * sg / sc AS w11, o3 * sg / sc AS w12,
  o1 * sg * (3 - outs_when_up) / (3 * sc) AS w13, o2 * sg * (3 - outs_when_up) / (3 * sc) AS w14, o3 * sg * (3 - outs_when_up) / (3 * sc) AS w15 FROM s""",
  doubles=[f"w{i}" for i in range(16)])
def _b17(t):
    return t.log.select(*KEY, *[e.alias(n) for n, e in features.winner_design().items()])


@query("b18_coarse_mass", IDS_CTE + """,
n AS (SELECT pitcher, count_id, action_id, count(*) AS n FROM ids WHERE action_id >= 0 GROUP BY ALL),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY pitcher, count_id) AS pi,
   action_id // 25 * 9 + (CASE WHEN action_id % 25 // 5 <= 1 THEN 0 WHEN action_id % 25 // 5 = 2 THEN 1 ELSE 2 END) * 3 + (CASE WHEN action_id % 5 <= 1 THEN 0 WHEN action_id % 5 = 2 THEN 1 ELSE 2 END) AS coarse FROM n)
SELECT pitcher, count_id, action_id, coarse, pi, sum(pi) OVER (PARTITION BY pitcher, count_id, coarse) AS coarse_mass FROM p""", doubles=["pi", "coarse_mass"])
def _b18(t):
    log = t.ids.where("action_id >= 0")
    pi = encode.action_shares(log, ["pitcher", "count_id"], "action_id")
    return encode.coarse_mass(pi, ["pitcher", "count_id"])


@query("b19_value_lookup", IDS_CTE + """,
q AS (SELECT pitcher, count_id, action_id, avg(runs) AS q FROM ids WHERE action_id >= 0 GROUP BY ALL)
SELECT game_pk, at_bat_number, pitch_number, q.q FROM ids LEFT JOIN q USING (pitcher, count_id, action_id)""", doubles=["q"])
def _b19(t):
    log = t.ids
    table = log.where("action_id >= 0").groupBy("pitcher", "count_id", "action_id").agg(F.avg("runs").alias("q"))
    return encode.snap_lookup(log, table, ["pitcher", "count_id"]).select(*KEY, "q")


@query("b20_leaf_composition", f"""
n AS (SELECT p_throws, y, count(*) AS n, avg(CASE WHEN description IN ('swinging_strike','swinging_strike_blocked') THEN 1.0 ELSE 0.0 END) AS w, avg(CASE WHEN bb_type = 'ground_ball' THEN 1.0 ELSE 0.0 END) AS g
  FROM (SELECT *, {OUT10_SQL} AS y FROM log) WHERE y >= 0 GROUP BY ALL),
h AS (SELECT p_throws, sum(n) AS tot, sum(CASE WHEN y = 1 THEN w * n END) / sum(CASE WHEN y = 1 THEN n END) AS q, sum(CASE WHEN y IN (3,4,5,6,7,9) THEN g * n END) / sum(CASE WHEN y IN (3,4,5,6,7,9) THEN n END) AS r FROM n GROUP BY 1),
p AS (SELECT p_throws, y, n / tot AS p, q, r FROM n JOIN h USING (p_throws)),
l AS (SELECT p_throws, 0 AS leaf, p AS m FROM p WHERE y = 0 UNION ALL SELECT p_throws, 1, p FROM p WHERE y = 2 UNION ALL SELECT p_throws, 2, p FROM p WHERE y = 8
  UNION ALL SELECT p_throws, 3, p * q FROM p WHERE y = 1 UNION ALL SELECT p_throws, 4, p * (1 - q) FROM p WHERE y = 1
  UNION ALL SELECT p_throws, 5, p * r FROM p WHERE y IN (3,4,5,6,7,9) UNION ALL SELECT p_throws, 6, p * (1 - r) FROM p WHERE y IN (3,4,5,6,7,9))
SELECT p_throws, leaf, sum(m) AS mass, true AS coherent FROM l GROUP BY 1, 2""", doubles=["mass"])
def _b20(t):
    p = encode.outcome_vectors(t.log.withColumn("y", codes.outcome10(c("description"), c("events"), c("strikes"))), ["p_throws"])
    return p.withColumn("leaves", probs.leaves7(c("p"), c("whiff"), c("ground"))).select(
        "p_throws", F.posexplode("leaves").alias("leaf", "mass"), probs.valid(c("leaves"), 7, 1e-9).alias("coherent")).withColumn("leaf", c("leaf").cast("bigint"))


@query("b21_location_basis", "SELECT game_pk, at_bat_number, pitch_number, " + ", ".join(
    ["greatest(-5.0, least(5.0, plate_x)) AS bx", "plate_z - 2.5 AS bz", "plate_x * plate_x AS bx2", "(plate_z - 2.5) * (plate_z - 2.5) AS bz2", "plate_x * (plate_z - 2.5) AS bxz"]
    + [f"exp(-(power(plate_x - ({mx}), 2) + power(plate_z - {mz}, 2)) / (2 * 0.65 * 0.65)) AS rbf{3 * j + i}" for j, mz in enumerate((1.5, 2.5, 3.5)) for i, mx in enumerate((-0.83, 0.0, 0.83))]
    + ["1 / (1 + exp(-(0.83 - plate_x) / 0.15)) AS in_right", "1 / (1 + exp(-(plate_x + 0.83) / 0.15)) AS in_left", "1 / (1 + exp(-(plate_z - 1.5) / 0.15)) AS above_low", "1 / (1 + exp(-(3.5 - plate_z) / 0.15)) AS below_high",
       "CASE WHEN plate_x < CAST(-0.83 AS DOUBLE) THEN 9 WHEN plate_x > CAST(0.83 AS DOUBLE) THEN 10 WHEN plate_z < 1.5 THEN 11 WHEN plate_z > 3.5 THEN 12 ELSE greatest(0, least(2, trunc((plate_z - 1.5) / 2 * 3)::INT)) * 3 + greatest(0, least(2, trunc((plate_x + CAST(0.83 AS DOUBLE)) / CAST(1.66 AS DOUBLE) * 3)::INT)) END AS cell"])
    + " FROM log WHERE plate_x IS NOT NULL AND plate_z IS NOT NULL",
    doubles=["bx", "bz", "bx2", "bz2", "bxz", *[f"rbf{i}" for i in range(9)], "in_right", "in_left", "above_low", "below_high"])
def _b21(t):
    located = t.log.where("plate_x is not null and plate_z is not null")
    basis = features.location_basis(c("plate_x"), c("plate_z"))
    return located.select(*KEY, *[e.alias(n) for n, e in basis.items()], features.location_cell(c("plate_x"), c("plate_z")).alias("cell"))


@query("b22_legality_conditioning", f"""
n AS (SELECT count_id, y10, count(*) AS n FROM ids WHERE y10 >= 0 GROUP BY ALL),
g AS (SELECT ci AS count_id, yi AS y10 FROM range(12) a(ci), range(10) b(yi)),
p AS (SELECT g.count_id, g.y10, (coalesce(n, 0) + 1) / (sum(coalesce(n, 0) + 1) OVER (PARTITION BY g.count_id)) AS p FROM g LEFT JOIN n USING (count_id, y10)),
r AS (SELECT DISTINCT count_id, outs_when_up = 2 OR (on_1b IS NULL AND on_2b IS NULL AND on_3b IS NULL) AS impossible FROM ids),
j AS (SELECT r.count_id, impossible, y10, CASE WHEN impossible AND y10 = 9 THEN 0 ELSE p END AS p FROM r JOIN p USING (count_id))
SELECT count_id, impossible, y10 AS class, p / sum(p) OVER (PARTITION BY count_id, impossible) AS p FROM j""".replace("n AS", IDS_CTE + ", n AS", 1), doubles=["p"])
def _b22(t):
    log = t.ids.withColumn("impossible", (c("outs_when_up") == 2) | (c("on_1b").isNull() & c("on_2b").isNull() & c("on_3b").isNull()))
    p = encode.count_vectors(log.where("y10 >= 0"), ["count_id"], "y10", 10, pseudo=1.0)
    rows = log.select("count_id", "impossible").distinct().join(p, "count_id")
    legal = rows.withColumn("p", probs.zero_class(c("p"), 9, c("impossible")))
    return legal.select("count_id", "impossible", F.posexplode("p").alias("class", "p")).withColumn("class", c("class").cast("bigint"))


@query("b23_value_decomposition", """
v AS (SELECT game_pk, at_bat_number, pitch_number, CASE WHEN k % 13 <> 0 THEN k / 100.0 END AS ref, CASE WHEN k % 7 <> 0 THEN vi % 100 / 100.0 END AS plan,
   CASE WHEN k % 5 <> 0 THEN vi * 3 % 100 / 100.0 END AS exec, CASE WHEN k % 11 <> 0 THEN vi * 7 % 100 / 100.0 END AS obs FROM log),
d AS (SELECT *, 100 * (obs - ref) AS total, 100 * (plan - ref) AS strategy, 100 * (exec - plan) AS execution, 100 * (obs - exec) AS outcome FROM v),
e AS (SELECT *, total IS NOT NULL AND strategy IS NOT NULL AND execution IS NOT NULL AND outcome IS NOT NULL AS complete, abs(strategy) + abs(execution) + abs(outcome) AS den FROM d)
SELECT game_pk, at_bat_number, pitch_number, total, strategy, execution, outcome,
  CASE WHEN complete THEN 0.0 WHEN total IS NOT NULL THEN total - coalesce(strategy, 0) - coalesce(execution, 0) - coalesce(outcome, 0) END AS unallocated,
  CASE WHEN complete THEN 'complete' WHEN total IS NOT NULL THEN 'partial' ELSE 'unavailable' END AS status,
  CASE WHEN complete AND den > 1e-9 THEN abs(strategy) / den END AS strategy_share, CASE WHEN complete AND den > 1e-9 THEN abs(execution) / den END AS execution_share,
  CASE WHEN complete AND den > 1e-9 THEN abs(outcome) / den END AS outcome_share FROM e""",
  doubles=["total", "strategy", "execution", "outcome", "unallocated", "strategy_share", "execution_share", "outcome_share"])
def _b23(t):
    v = t.log.selectExpr(*KEY, "case when k % 13 <> 0 then k / 100.0D end as ref", "case when k % 7 <> 0 then vi % 100 / 100.0D end as plan",
                         "case when k % 5 <> 0 then vi * 3 % 100 / 100.0D end as exec", "case when k % 11 <> 0 then vi * 7 % 100 / 100.0D end as obs")
    parts = encode.value_decomposition(c("ref"), c("plan"), c("exec"), c("obs"))
    return v.select(*KEY, *[e.alias(n) for n, e in parts.items()])
