"""Section D: run expectancy, seasons, frequency tables and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallylane.functions import codes, probs
from tallylane.keys import DEFAULT_KEYS as K
from tallylane.operators import aggs, asof, encode, freq
from tallylane.plans.encoders import IDS_CTE, OUT10_SQL
from tallylane.plans.ordered import OUTS_CTE, STYLE_CTE, TERMINAL, terminal, with_outs
from tallylane.plans.registry import query

c = F.col

EP_CTE = IDS_CTE + """,
ep0 AS (SELECT game_pk, at_bat_number, min_by(inning, pitch_number) AS inning, min_by(inning_topbot, pitch_number) AS side, min_by(base_out_id, pitch_number) AS b0, min_by(bat_score, pitch_number) AS s0,
  max_by(base_out_id, pitch_number) AS b1, max_by(outcome_id, pitch_number) AS oid, max_by(bat_score, pitch_number) AS sb, max_by(post_bat_score, pitch_number) AS sa, count(*) AS n_events FROM ids GROUP BY 1, 2),
ep1 AS (SELECT *, max(sa) OVER (PARTITION BY game_pk, inning, side) AS he, max(inning) OVER (PARTITION BY game_pk) AS lp,
  last_value(side) OVER (PARTITION BY game_pk ORDER BY at_bat_number ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ls FROM ep0),
ep AS (SELECT *, CASE WHEN lead(inning) OVER g = inning AND lead(side) OVER g = side THEN lead(b0) OVER g END AS nb FROM ep1 WHERE NOT (inning = lp AND side = ls) WINDOW g AS (PARTITION BY game_pk ORDER BY at_bat_number)),
re AS (SELECT b AS base_out_id, coalesce(avg(he - s0), 0) AS re, count(he) AS n FROM range(24) r(b) LEFT JOIN ep ON ep.b0 = b GROUP BY 1)
"""


def _episodes(t):
    return aggs.expectancy_episodes(t.ids, K)


@query("d03_run_expectancy", EP_CTE + " SELECT * FROM re", doubles=["re"])
def _d03(t):
    return aggs.run_expectancy(_episodes(t))


@query("d04_delta_expectancy", EP_CTE + """,
d AS (SELECT oid, b1, coalesce(r2.re, 0) + sa - sb - r1.re AS delta FROM ep JOIN re r1 ON r1.base_out_id = b1 LEFT JOIN re r2 ON r2.base_out_id = nb WHERE oid >= 3)
SELECT o AS outcome_id, b AS base_out_id, avg(delta) AS delta, count(delta) AS n FROM range(3, 11) x(o), range(24) y(b) LEFT JOIN d ON oid = o AND b1 = b GROUP BY 1, 2""", doubles=["delta"])
def _d04(t):
    ep = _episodes(t)
    return aggs.delta_expectancy(aggs.expectancy_change(ep, aggs.run_expectancy(ep)))


@query("d05_episode_rewards", EP_CTE + """,
pa AS (SELECT e.*, CASE WHEN lead(inning) OVER g = inning AND lead(side) OVER g = side THEN lead(b0) OVER g END AS nb2 FROM ep0 e WINDOW g AS (PARTITION BY game_pk ORDER BY at_bat_number)),
na AS (SELECT game_pk, at_bat_number, count(DISTINCT pitcher) AS n_actors FROM log GROUP BY 1, 2)
SELECT game_pk, at_bat_number, n_events, n_actors, sa - s0 AS runs, coalesce(r2.re, 0) + sa - s0 - r1.re AS delta_re FROM pa JOIN na USING (game_pk, at_bat_number) JOIN re r1 ON r1.base_out_id = b0 LEFT JOIN re r2 ON r2.base_out_id = nb2""", doubles=["delta_re"])
def _d05(t):
    log = t.ids
    out = aggs.episode_rewards(log, K, aggs.run_expectancy(aggs.expectancy_episodes(log, K)))
    return out.select("game_pk", "at_bat_number", "n_events", "n_actors", "runs", "delta_re")


SEASON_CTE = """
f0 AS (SELECT game_pk, at_bat_number, min_by(inning, pitch_number) AS inning, min_by(inning_topbot, pitch_number) AS side, min_by(outs_when_up, pitch_number) AS o, min_by(pitcher, pitch_number) AS pitcher, min_by(season, pitch_number) AS season FROM log GROUP BY 1, 2),
f1 AS (SELECT *, CASE WHEN lead(inning) OVER g = inning AND lead(side) OVER g = side THEN lead(o) OVER g - o ELSE 3 - o END AS outs,
  (inning = 1 AND row_number() OVER (PARTITION BY game_pk, inning, side ORDER BY at_bat_number) = 1)::INT AS st FROM f0 WINDOW g AS (PARTITION BY game_pk ORDER BY at_bat_number)),
f2 AS (SELECT pitcher, season, CAST(sum(outs) AS BIGINT) AS outs, count(DISTINCT game_pk) AS clusters, CAST(sum(st) AS BIGINT) AS starts FROM f1 GROUP BY 1, 2),
f3 AS (SELECT pitcher, season, count(*) AS events, count(pitch_type) AS events_coded FROM log GROUP BY 1, 2),
seas AS (SELECT f3.*, coalesce(outs, 0) AS outs, coalesce(clusters, 0) AS clusters, coalesce(starts, 0) AS starts, coalesce(outs, 0) / CAST(3 AS DOUBLE) AS ip FROM f3 LEFT JOIN f2 USING (pitcher, season))
"""


@query("d01_actor_season", SEASON_CTE + " SELECT * FROM seas", doubles=["ip"])
def _d01(t):
    return aggs.season_table(t.log, K, "season")


@query("d02_qualification_pool", SEASON_CTE + """
SELECT pitcher, count_if(ip >= 6) AS seasons_qualified, count(DISTINCT season) AS seasons_present, CAST(sum(events) AS BIGINT) AS events_total, sum(ip) AS ip_total, CAST(sum(starts) AS BIGINT) AS starts_total,
  """ + ", ".join(f"coalesce(bool_or(ip >= 6) FILTER (season = {s}), false) AS q{s}" for s in range(2021, 2025)) + " FROM seas GROUP BY 1 HAVING count_if(ip >= 6) > 0", doubles=["ip_total"])
def _d02(t):
    return aggs.qualification_pool(aggs.season_table(t.log, K, "season"), "pitcher", "season", range(2021, 2025), 6.0)


@query("d02_threshold_sweep", SEASON_CTE + """
SELECT CAST(th AS DOUBLE) AS threshold, season, count(DISTINCT pitcher) AS actors FROM seas, (VALUES (3), (5), (8), (12)) v(th) WHERE ip >= th GROUP BY GROUPING SETS ((th, season), (th))""")
def _d02b(t):
    return aggs.threshold_sweep(aggs.season_table(t.log, K, "season"), "pitcher", "season", [3, 5, 8, 12])


def _rate(num, den):
    return f"count_if({num}) / greatest(count_if({den}), 1)"


_SW = "description IN ('swinging_strike','swinging_strike_blocked','foul','foul_tip','hit_into_play','missed_bunt','foul_bunt','bunt_foul_tip')"
_STYLE_RATES = ["k_rate", "bb_rate", "swing_rate", "chase_rate", "contact_rate", "gb_rate", "fb_rate", "hard_rate", "avg_launch_angle", "avg_launch_speed"]


@query("d06_style_table", "SELECT batter, stand, count(*) AS n_events, count(events) AS n_pa, " + ", ".join([
    _rate("events IN ('strikeout','strikeout_double_play')", "events IS NOT NULL") + " AS k_rate", _rate("events IN ('walk','intent_walk')", "events IS NOT NULL") + " AS bb_rate",
    f"avg(CASE WHEN {_SW} THEN 1.0 ELSE 0.0 END) AS swing_rate", _rate(f"{_SW} AND zone >= 11", "zone >= 11") + " AS chase_rate",
    _rate("description IN ('foul','foul_tip','hit_into_play','foul_bunt','bunt_foul_tip')", _SW) + " AS contact_rate",
    _rate("bb_type = 'ground_ball'", "description = 'hit_into_play'") + " AS gb_rate", _rate("bb_type IN ('fly_ball','popup')", "description = 'hit_into_play'") + " AS fb_rate",
    _rate("description = 'hit_into_play' AND launch_speed >= 95", "description = 'hit_into_play'") + " AS hard_rate", "avg(launch_angle) AS avg_launch_angle", "CAST(sum(CAST(launch_speed AS DECIMAL(24, 6))) AS DOUBLE) / nullif(count(launch_speed), 0) AS avg_launch_speed"]) + " FROM log GROUP BY 1, 2",
  doubles=_STYLE_RATES)
def _d06(t):
    return aggs.style_table(t.log, ["batter", "stand"])


LINE_CTE = """
ln0 AS (SELECT batter, season, count(*) AS pa, count_if(events IN ('strikeout','strikeout_double_play')) AS k, count_if(events IN ('walk','intent_walk')) AS bb, count_if(events = 'hit_by_pitch') AS hbp,
  count_if(events IN ('sac_fly','sac_fly_double_play')) AS sf, count_if(events NOT IN ('walk','intent_walk','hit_by_pitch','sac_fly','sac_fly_double_play','sac_bunt','sac_bunt_double_play','catcher_interf')) AS ab,
  count_if(events IN ('single','double','triple','home_run')) AS h, count_if(events = 'home_run') AS hr, sum(CASE events WHEN 'single' THEN 1 WHEN 'double' THEN 2 WHEN 'triple' THEN 3 WHEN 'home_run' THEN 4 ELSE 0 END) AS tb
  FROM log WHERE events IS NOT NULL AND events <> 'truncated_pa' GROUP BY 1, 2),
line AS (SELECT batter, season, pa, k / pa AS k_pct, hr / pa AS hr_pct, CASE WHEN ab > 0 THEN tb / ab ELSE 0 END - CASE WHEN ab > 0 THEN h / ab ELSE 0 END AS iso, CASE WHEN ab > 0 THEN h / ab ELSE 0 END AS avg,
  CASE WHEN ab + bb + hbp + sf > 0 THEN (h + bb + hbp) / (ab + bb + hbp + sf) ELSE 0 END + CASE WHEN ab > 0 THEN tb / ab ELSE 0 END AS ops FROM ln0)
"""


@query("d07_season_line", LINE_CTE + " SELECT * FROM line", doubles=list(aggs.LINE_COLUMNS))
def _d07(t):
    return aggs.season_line(t.log, ["batter", "season"])


@query("d08_previous_season", LINE_CTE + """,
lm AS (SELECT season + 1 AS season, """ + ", ".join(f"CASE WHEN count_if(pa >= 3) > 0 THEN avg({x}) FILTER (pa >= 3) ELSE avg({x}) END AS l_{x}" for x in aggs.LINE_COLUMNS) + """ FROM line GROUP BY 1)
SELECT r.batter, r.season, """ + ", ".join(f"coalesce(p.{x}, l_{x}, 0) AS prev_{x}" for x in aggs.LINE_COLUMNS) + """, p.batter IS NULL AS prev_missing
FROM (SELECT DISTINCT batter, season FROM log) r LEFT JOIN line p ON p.batter = r.batter AND p.season + 1 = r.season AND p.pa >= 3 LEFT JOIN lm ON lm.season = r.season""", doubles=[f"prev_{x}" for x in aggs.LINE_COLUMNS])
def _d08(t):
    log = t.log
    return aggs.previous_season(log.select("batter", "season").distinct(), aggs.season_line(log, ["batter", "season"]), "batter", "season", 3)


@query("d09_transition_counts", IDS_CTE + " SELECT pitcher, state_id, action_id, outcome_id, count(*) AS n FROM ids WHERE action_id >= 0 AND outcome_id >= 0 GROUP BY ALL")
def _d09(t):
    return freq.transition_counts(t.ids, "pitcher")


@query("d09_repertoire", IDS_CTE + " SELECT pitcher, pitch_id, count(*) AS n, count(*) >= 12 AS supported FROM ids WHERE action_id >= 0 AND outcome_id >= 0 GROUP BY ALL")
def _d09b(t):
    return freq.repertoire(t.ids, "pitcher", 12)


def _lvl(name, counts, keys, prior, prior_keys, alpha):
    """SQL of one smoothing level in long form, over the cells of `prior`."""
    on = " AND ".join(f"n.{k} = q.{k}" for k in keys + ["o"])
    return f"""{name}_n AS (SELECT {', '.join(keys)}, o, sum(n) AS n FROM cells GROUP BY ALL), {name}_t AS (SELECT {', '.join(keys)}, sum(n) AS t FROM cells GROUP BY ALL),
{name}_r AS (SELECT q.*, (coalesce(n.n, 0) + {alpha} * q.{prior}) / (coalesce(t.t, 0) + {alpha}) * m AS v FROM {counts} q LEFT JOIN {name}_n n ON {on} LEFT JOIN {name}_t t ON {' AND '.join(f't.{k} = q.{k}' for k in keys)}),
{name} AS (SELECT * EXCLUDE (v), CASE WHEN sum(v) OVER w > 0 THEN v / sum(v) OVER w ELSE 0 END AS {name} FROM {name}_r WINDOW w AS (PARTITION BY pitcher, state_id, action_id))"""


DIRICHLET_CTE = IDS_CTE + """,
cells AS (SELECT pitcher, state_id, action_id, count_id AS c, pitch_id AS g, outcome_id AS o, count(*) AS n FROM ids WHERE action_id >= 0 AND outcome_id >= 0 GROUP BY ALL),
rp AS (SELECT pitcher, g FROM cells GROUP BY 1, 2 HAVING sum(n) >= 12),
req AS (SELECT pitcher, state_id, action_id, c, g, o, (CASE o WHEN 0 THEN c // 3 < 3 WHEN 4 THEN c // 3 = 3 WHEN 1 THEN c % 3 < 2 WHEN 3 THEN c % 3 = 2 ELSE true END)::INT AS m
  FROM (SELECT DISTINCT pitcher, state_id, action_id, c, g FROM cells) JOIN rp USING (pitcher, g), range(11) r(o)),
bc AS (SELECT c, o, sum(n) AS n FROM cells GROUP BY 1, 2),
b0 AS (SELECT req.*, coalesce(bc.n, 0) * m AS bn FROM req LEFT JOIN bc ON bc.c = req.c AND bc.o = req.o),
base AS (SELECT * EXCLUDE (bn), CASE WHEN sum(bn) OVER w > 0 THEN bn / sum(bn) OVER w ELSE m / sum(m) OVER w END AS base FROM b0 WINDOW w AS (PARTITION BY pitcher, state_id, action_id)),
""" + ",\n".join([
    _lvl("lca", "base", ["c", "action_id"], "base", None, 20.0), _lvl("l0", "lca", ["state_id", "action_id"], "lca", None, 20.0),
    _lvl("lcg", "l0", ["c", "g"], "base", None, 20.0), _lvl("l1", "lcg", ["pitcher", "c", "g"], "lcg", None, 40.0)]) + """,
mx0 AS (SELECT *, l0 * (l1 / greatest(lcg, 1e-9)) * m AS mv FROM l1),
mx AS (SELECT * EXCLUDE (mv), CASE WHEN sum(mv) OVER w > 0 THEN mv / sum(mv) OVER w ELSE 0 END AS mp FROM mx0 WINDOW w AS (PARTITION BY pitcher, state_id, action_id)),
""" + _lvl("l2", "mx", ["pitcher", "state_id", "action_id"], "mp", None, 40.0)


def dirichlet(t, levels=None):
    log = t.ids
    return freq.dirichlet_table(log, None, "pitcher", 20.0, 40.0, 12, levels=levels)


@query("d10_dirichlet_smoothing", DIRICHLET_CTE + " SELECT pitcher, state_id, action_id, o AS outcome_id, l2 AS p FROM l2", doubles=["p"])
def _d10(t):
    out = dirichlet(t).select("pitcher", "state_id", "action_id", F.posexplode(F.array(*[f"p{i}" for i in range(11)])).alias("outcome_id", "p"))
    return out.withColumn("outcome_id", c("outcome_id").cast("bigint"))


def _beh_sql(fold):
    f = ", game_pk % 5 AS fold" if fold else ""
    names = {"g": ["g"], "al": [], "pg": ["pitcher", "g"], "p": ["pitcher"], "pcg": ["pitcher", "c", "g"], "pc": ["pitcher", "c"], "psg": ["pitcher", "s", "g"], "ps": ["pitcher", "s"],
             "gl": ["g", "l"], "pgl": ["pitcher", "g", "l"], "pcgl": ["pitcher", "c", "g", "l"]}

    fk = ["fold"] if fold else []

    def level(name, keys):
        if not fold:
            return f"t_{name} AS (SELECT {', '.join(keys) or '1 AS one'}, sum(n) AS n FROM k GROUP BY ALL)"
        cols = ", ".join([*keys, "fold"])
        part = f"PARTITION BY {', '.join(keys)}" if keys else ""
        return f"t_{name} AS (SELECT {cols}, sum(sum(n)) OVER ({part}) - sum(n) AS n FROM k GROUP BY {cols})"

    lv = ",\n".join(level(n, k) for n, k in names.items())
    joins = " ".join(f"LEFT JOIN t_{n} ON " + (" AND ".join(f"t_{n}.{x} = k.{x}" for x in [*k, *fk]) or "true") for n, k in names.items())
    cols = ", ".join(f"coalesce(t_{n}.n, 0) AS k_{n}" for n in names)

    def mix(n, tot, prior):
        return f"(k_{n} + 10.0 * {prior}) / (k_{tot} + 10.0)"

    kind = mix("psg", "ps", mix("pcg", "pc", mix("pg", "p", "(k_g / k_al)")))
    place = mix("pcgl", "pcg", mix("pgl", "pg", mix("gl", "g", "(1.0 / 25)")))
    return IDS_CTE + f""",
k AS (SELECT pitcher, state_id AS s, count_id AS c, pitch_id AS g, loc_id AS l{f}, count(*) AS n FROM ids WHERE action_id >= 0 GROUP BY ALL),
{lv},
kk AS (SELECT k.*, {cols} FROM k {joins})
SELECT pitcher, s AS state_id, c AS count_id, g AS pitch_id, l AS loc_id{', fold' if fold else ''}, g * 25 + l AS action_id, n, (CAST({kind} AS DOUBLE) * CAST({place} AS DOUBLE) + 1e-6) / (1 + 225 * 1e-6) AS pb FROM kk"""


@query("d11_behaviour_policy", _beh_sql(False), doubles=["pb"])
def _d11(t):
    return freq.behaviour_probability(t.ids, "pitcher", 10.0)


@query("d12_crossfit_logged", _beh_sql(True), doubles=["pb"])
def _d12(t):
    return freq.behaviour_probability(t.ids, "pitcher", 10.0, fold=c("game_pk") % 5)


# --- frequency chains -----------------------------------------------------------

COUNT_KEYS = ["balls", "strikes", "stand", "p_throws"]
LEVELS = [(COUNT_KEYS, 50.0), ([*COUNT_KEYS, "pitch_type"], 50.0), ([*COUNT_KEYS, "pitch_type", "pitcher"], 100.0)]
CONTEXT_LEVELS = LEVELS[:2] + [([*COUNT_KEYS, "pitch_type", "outs_when_up", "bases"], 100.0), ([*COUNT_KEYS, "pitch_type", "outs_when_up", "bases", "pitcher"], 100.0)]
FAMILY_LEVELS = [(COUNT_KEYS, 50.0), ([*COUNT_KEYS, "family"], 50.0)]

FREQ_BASE = f"""
lab AS (SELECT *, {OUT10_SQL} AS y, (on_1b IS NOT NULL)::INT + 2 * (on_2b IS NOT NULL)::INT + 4 * (on_3b IS NOT NULL)::INT AS bases,
  CASE WHEN pp IN ('FF','FA','SI','FC') THEN 'fast' WHEN pp IN ('SL','SV','ST','CU','KC','CS') THEN 'breaking' WHEN pp IN ('CH','FS','FO') THEN 'off' WHEN pp IS NULL THEN 'NONE' ELSE 'other' END AS family
  FROM (SELECT *, lag(pitch_type) OVER (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number) AS pp FROM log)),
tr AS (SELECT * FROM lab WHERE season <= 2022 AND y >= 0 AND pitch_type IS NOT NULL),
p0 AS (SELECT y, (SELECT count(*) FROM tr WHERE tr.y = r.y) + 1 AS n FROM range(10) r(y)), l0 AS (SELECT y, n / (SELECT sum(n) FROM p0) AS p FROM p0)
"""


def _chain_sql(levels, select):
    sql, prev, prev_keys = FREQ_BASE, "l0", []
    for i, (keys, s) in enumerate(levels, 1):
        ks = ", ".join(keys)
        on = " AND ".join([f"q.{k} = k.{k}" for k in prev_keys] + ["q.y = r.y"])
        sql += f""",
n{i} AS (SELECT {ks}, y, count(*) AS n FROM tr GROUP BY ALL), k{i} AS (SELECT {ks}, count(*) AS t FROM tr GROUP BY ALL),
l{i} AS (SELECT {', '.join('k.' + k for k in keys)}, r.y, (coalesce(n.n, 0) + {s} * q.p) / (k.t + {s}) AS p FROM k{i} k CROSS JOIN range(10) r(y) JOIN {prev} q ON {on} LEFT JOIN n{i} n ON {' AND '.join(f'n.{k} = k.{k}' for k in keys)} AND n.y = r.y)"""
        prev, prev_keys = f"l{i}", keys
    joins = " ".join(f"LEFT JOIN l{i} ON l{i}.y = e.y AND " + " AND ".join(f"l{i}.{k} = e.{k}" for k in keys) for i, (keys, _) in enumerate(levels, 1))
    depth = len(levels)
    p = "coalesce(" + ", ".join(f"l{i}.p" for i in range(depth, -1, -1)) + ")"
    origin = "CASE " + " ".join(f"WHEN l{i}.p IS NOT NULL THEN {i}" for i in range(depth, 0, -1)) + " ELSE 0 END"
    return sql + f"""
SELECT e.game_pk, e.at_bat_number, e.pitch_number, {origin} AS origin, {p} AS p_y FROM (SELECT * FROM lab WHERE y >= 0 AND season > 2022) e JOIN l0 ON l0.y = e.y {joins}""" if select else sql


def labelled(t):
    """Log rows with the ten-class label, base mask and previous family."""
    prev = F.lag("pitch_type").over(K.in_episode())
    fam = (F.when(prev.isin("FF", "FA", "SI", "FC"), "fast").when(prev.isin("SL", "SV", "ST", "CU", "KC", "CS"), "breaking").when(prev.isin("CH", "FS", "FO"), "off")
           .when(prev.isNull(), "NONE").otherwise("other"))
    return t.log.withColumns({"y": codes.outcome10(c("description"), c("events"), c("strikes")), "family": fam,
                              "bases": c("on_1b").isNotNull().cast("int") + 2 * c("on_2b").isNotNull().cast("int") + 4 * c("on_3b").isNotNull().cast("int")}).where("y >= 0")


def chain(t, levels):
    lab = labelled(t)
    tables = freq.frequency_chain(lab.where("season <= 2022 and pitch_type is not null"), levels, "y", 10)
    return freq.chain_lookup(lab.where("season > 2022"), tables, [k for k, _ in levels])


def _chain_query(levels):
    def run(t):
        return chain(t, levels).select("game_pk", "at_bat_number", "pitch_number", "origin", probs.at(c("p"), c("y")).alias("p_y"))
    return run


query("d13_count_baseline", _chain_sql(LEVELS[:1], True), doubles=["p_y"])(_chain_query(LEVELS[:1]))
query("d14_type_frequency", _chain_sql(LEVELS, True), doubles=["p_y"])(_chain_query(LEVELS))
query("d15_context_frequency", _chain_sql(CONTEXT_LEVELS, True), doubles=["p_y"])(_chain_query(CONTEXT_LEVELS))
query("d16_family_frequency", _chain_sql(FAMILY_LEVELS, True), doubles=["p_y"])(_chain_query(FAMILY_LEVELS))


CLONE_CTE = """
bl AS (SELECT *, coalesce(lag(pitch_type) OVER (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number), '<START>') AS prev FROM log),
bt AS (SELECT * FROM bl WHERE season <= 2022 AND pitch_type IS NOT NULL),
bq AS (SELECT * FROM bl WHERE season > 2022 AND pitch_type IS NOT NULL),
bna AS (SELECT pitcher, pitch_type, count(*) AS n FROM bt GROUP BY 1, 2), bnl AS (SELECT pitch_type, count(*) AS n FROM bt GROUP BY 1),
bka AS (SELECT pitcher, coalesce(sum(n) FILTER (n >= 5), 0) AS s FROM bna GROUP BY 1),
bcell AS (SELECT b.pitcher, balls, strikes, stand, prev, b.pitch_type, count(*) AS n FROM bt b JOIN bna a ON a.pitcher = b.pitcher AND a.pitch_type = b.pitch_type AND a.n >= 5 GROUP BY ALL),
btot AS (SELECT pitcher, balls, strikes, stand, prev, sum(n) AS s FROM bcell GROUP BY ALL),
bj AS (SELECT q.*, ka.s IS NULL AS fallback, CASE WHEN ka.s IS NULL THEN coalesce(bnl.n, 0) ELSE coalesce(bna.n, 0) END AS n, CASE WHEN ka.s IS NULL THEN (SELECT coalesce(sum(n) FILTER (n >= 5), 0) FROM bnl) ELSE ka.s END AS size,
   coalesce(bcell.n, 0) AS own, coalesce(btot.s, 0) AS tot FROM bq q LEFT JOIN bka ka ON ka.pitcher = q.pitcher LEFT JOIN bna ON bna.pitcher = q.pitcher AND bna.pitch_type = q.pitch_type LEFT JOIN bnl ON bnl.pitch_type = q.pitch_type
   LEFT JOIN bcell ON bcell.pitcher = q.pitcher AND bcell.balls = q.balls AND bcell.strikes = q.strikes AND bcell.stand = q.stand AND bcell.prev = q.prev AND bcell.pitch_type = q.pitch_type
   LEFT JOIN btot ON btot.pitcher = q.pitcher AND btot.balls = q.balls AND btot.strikes = q.strikes AND btot.stand = q.stand AND btot.prev = q.prev),
clone AS (SELECT *, n >= 5 AND size > 0 AS observed_supported, CASE WHEN n >= 5 AND size > 0 THEN n / size WHEN size > 0 THEN 0 END AS p_frequency,
   CASE WHEN n >= 5 AND size > 0 THEN (own + 20 * n / size) / (tot + 20) WHEN size > 0 THEN 0 END AS p_clone FROM bj)
"""


def clone(t):
    log = t.log.withColumn("prev", F.coalesce(F.lag("pitch_type").over(K.in_episode()), F.lit("<START>"))).where("pitch_type is not null")
    return freq.behaviour_clone(log.where("season <= 2022"), log.where("season > 2022"), "pitcher", ["balls", "strikes", "stand", "prev"], "pitch_type", 20.0, 5)


@query("d17_behaviour_clone", CLONE_CTE + " SELECT game_pk, at_bat_number, pitch_number, fallback, observed_supported, p_frequency, p_clone FROM clone", doubles=["p_frequency", "p_clone"])
def _d17(t):
    return clone(t).select("game_pk", "at_bat_number", "pitch_number", "fallback", "observed_supported", "p_frequency", "p_clone")


def advancement_rows(t):
    """Terminal events with a legal observed successor: outs added, bases after, runs."""
    from tallylane.operators import ordered
    log = t.log.withColumn("bases", c("on_1b").isNotNull().cast("int") + 2 * c("on_2b").isNotNull().cast("int") + 4 * c("on_3b").isNotNull().cast("int"))
    nxt = ["outs_when_up", "bases", "home_score", "away_score", "inning", "inning_topbot"]
    x = ordered.next_state(log, K, nxt, terminal()).where("next_inning is not null")
    e = c("events")
    x = x.withColumns({
        "event": F.when(e.isin("field_out", "force_out", "fielders_choice_out", "sac_fly"), "out").when(e.isin("grounded_into_double_play", "double_play", "sac_fly_double_play"), "double_play").when(e.isin("single", "double", "triple"), e),
        "same": (c("next_inning") == c("inning")) & (c("next_inning_topbot") == c("inning_topbot")),
        "bot": c("inning_topbot") == "Bot",
        "adv_runs": F.when(c("inning_topbot") == "Bot", c("next_home_score") - c("home_score")).otherwise(c("next_away_score") - c("away_score"))})
    x = x.withColumn("out_delta", F.when(c("same"), c("next_outs_when_up") - c("outs_when_up")).otherwise(3 - c("outs_when_up")))
    flip = (~c("bot") & (c("next_inning") == c("inning")) & (c("next_inning_topbot") == "Bot")) | (c("bot") & (c("next_inning") == c("inning") + 1) & (c("next_inning_topbot") == "Top"))
    walkoff = c("bot") & (c("inning") >= 9) & (c("next_home_score") > c("next_away_score"))
    legal = (c("event").isNotNull() & c("adv_runs").between(0, 4) & ~walkoff & (c("same") | flip) & c("out_delta").between(0, 3) & (c("out_delta") <= 3 - c("outs_when_up"))
             & ((c("event") != "double_play") | (c("out_delta") == 2)) & ((c("event") != "out") | (c("out_delta") == 1)))
    return x.where(legal).withColumn("to_bases", F.when(c("same"), c("next_bases")).otherwise(0))


ADV_CTE = f"""
ax AS (SELECT *, (on_1b IS NOT NULL)::INT + 2 * (on_2b IS NOT NULL)::INT + 4 * (on_3b IS NOT NULL)::INT AS bases FROM log),
ay AS (SELECT *, lead(outs_when_up) OVER g AS no, lead(bases) OVER g AS nb, lead(home_score) OVER g AS nh, lead(away_score) OVER g AS na, lead(inning) OVER g AS ni, lead(inning_topbot) OVER g AS nt FROM ax WINDOW g AS (PARTITION BY game_pk ORDER BY at_bat_number, pitch_number)),
az AS (SELECT *, CASE WHEN events IN ('field_out','force_out','fielders_choice_out','sac_fly') THEN 'out' WHEN events IN ('grounded_into_double_play','double_play','sac_fly_double_play') THEN 'double_play' WHEN events IN ('single','double','triple') THEN events END AS event,
  ni = inning AND nt = inning_topbot AS same, CASE WHEN inning_topbot = 'Bot' THEN nh - home_score ELSE na - away_score END AS adv_runs,
  CASE WHEN ni = inning AND nt = inning_topbot THEN no - outs_when_up ELSE 3 - outs_when_up END AS out_delta FROM ay WHERE {TERMINAL} AND ni IS NOT NULL),
aok AS (SELECT *, CASE WHEN same THEN nb ELSE 0 END AS to_bases FROM az WHERE event IS NOT NULL AND adv_runs BETWEEN 0 AND 4 AND NOT (inning_topbot = 'Bot' AND inning >= 9 AND nh > na)
  AND (same OR (inning_topbot = 'Top' AND ni = inning AND nt = 'Bot') OR (inning_topbot = 'Bot' AND ni = inning + 1 AND nt = 'Top')) AND out_delta BETWEEN 0 AND 3 - outs_when_up
  AND (event <> 'double_play' OR out_delta = 2) AND (event <> 'out' OR out_delta = 1))
"""


@query("d18_advancement", ADV_CTE + """
SELECT event, bases, outs_when_up, out_delta, to_bases, adv_runs, count(*) AS n, CAST(sum(count(*)) OVER w AS BIGINT) AS cell, count(*) / (sum(count(*)) OVER w + 5.0) AS share
FROM aok GROUP BY event, bases, outs_when_up, out_delta, to_bases, adv_runs WINDOW w AS (PARTITION BY event, bases, outs_when_up)""", doubles=["share"])
def _d18(t):
    """Share leaves five pseudo-observations for the rule-based fallback."""
    out = freq.advancement(advancement_rows(t), ["event", "bases", "outs_when_up"], ["out_delta", "to_bases", "adv_runs"])
    return out.withColumn("share", c("n") / (c("cell") + 5.0))


@query("d19_type_leaf", """
lf AS (SELECT pitch_type, CASE WHEN y = 0 THEN 0 WHEN y = 2 THEN 1 WHEN y = 8 THEN 2 WHEN y = 1 THEN CASE WHEN description IN ('swinging_strike','swinging_strike_blocked') THEN 3 ELSE 4 END
   WHEN y >= 3 THEN CASE WHEN coalesce(bb_type, 'None') = 'ground_ball' THEN 5 ELSE 6 END END AS leaf FROM (SELECT *, """ + OUT10_SQL + """ AS y FROM log) WHERE y >= 0 AND season <= 2022 AND pitch_type IS NOT NULL),
n AS (SELECT pitch_type, leaf, count(*) AS n FROM lf GROUP BY 1, 2)
SELECT k.pitch_type, r.leaf, (coalesce(n.n, 0) + 0.5) / (k.t + 3.5) AS p FROM (SELECT pitch_type, count(*) AS t FROM lf GROUP BY 1) k CROSS JOIN range(7) r(leaf) LEFT JOIN n ON n.pitch_type = k.pitch_type AND n.leaf = r.leaf""", doubles=["p"])
def _d19(t):
    leaf = codes.leaf7(c("description"), c("events"), c("strikes"), c("bb_type"))
    fit = t.log.withColumn("leaf", leaf).where("leaf >= 0 and season <= 2022 and pitch_type is not null")
    out = freq.additive_share(fit, ["pitch_type"], "leaf", 7, 0.5).select("pitch_type", F.posexplode("p").alias("leaf", "p"))
    return out.withColumn("leaf", c("leaf").cast("bigint"))


POOL_CTE = FREQ_BASE + """,
pt AS (SELECT *, pitcher % 4 AS grp FROM tr),
ga AS (SELECT y, (SELECT count(*) FROM pt WHERE pt.y = r.y) / (SELECT count(*) FROM pt) AS p FROM range(10) r(y)),
gc AS (SELECT k.grp, k.t, r.y, coalesce(n.n, 0) / k.t AS p FROM (SELECT grp, count(*) AS t FROM pt GROUP BY 1) k CROSS JOIN range(10) r(y) LEFT JOIN (SELECT grp, y, count(*) AS n FROM pt GROUP BY 1, 2) n ON n.grp = k.grp AND n.y = r.y),
gi AS (SELECT k.pitcher, k.t, r.y, coalesce(n.n, 0) / k.t AS p FROM (SELECT pitcher, count(*) AS t FROM pt GROUP BY 1 HAVING count(*) >= 40) k CROSS JOIN range(10) r(y) LEFT JOIN (SELECT pitcher, y, count(*) AS n FROM pt GROUP BY 1, 2) n ON n.pitcher = k.pitcher AND n.y = r.y),
b1 AS (SELECT a.pitcher, ga.y, CASE WHEN gc.p IS NULL THEN ga.p ELSE gc.t / (gc.t + 500.0) * gc.p + 500.0 / (gc.t + 500.0) * ga.p END AS p FROM (SELECT DISTINCT pitcher FROM log) a CROSS JOIN ga LEFT JOIN gc ON gc.grp = a.pitcher % 4 AND gc.y = ga.y)
"""


@query("d20_partial_pooling", POOL_CTE + """
SELECT b1.pitcher, b1.y AS class, CASE WHEN gi.p IS NULL THEN b1.p ELSE gi.t / (gi.t + 200.0) * gi.p + 200.0 / (gi.t + 200.0) * b1.p END AS p FROM b1 LEFT JOIN gi ON gi.pitcher = b1.pitcher AND gi.y = b1.y""", doubles=["p"])
def _d20(t):
    fit = labelled(t).where("season <= 2022 and pitch_type is not null").withColumn("grp", c("pitcher") % 4)
    cells = freq.class_cells(fit, ["pitcher", "grp"], "y", 10)

    def table(by, name):
        n = freq.roll_up(cells, by, 10)
        return n.select(*by, freq.shrink(10, 0.0, 0.0).alias(f"p_{name}"), freq.count_total(10).alias(f"n_{name}"))

    rows = t.log.select("pitcher").distinct().withColumn("grp", c("pitcher") % 4)
    out = freq.with_row(rows, table([], "all")).join(table(["grp"], "grp"), "grp", "left").join(table(["pitcher"], "own").where("n_own >= 40"), "pitcher", "left")
    blended = freq.partial_pool(out, "p_all", [("p_grp", "n_grp", 500.0), ("p_own", "n_own", 200.0)])
    return out.select("pitcher", F.posexplode(blended).alias("class", "p")).withColumn("class", c("class").cast("bigint"))


@query("d21_support_census", """
SELECT p_throws, stand, season, count(*) AS events, count(DISTINCT game_pk) AS clusters, count(DISTINCT pitcher) AS actors, count(DISTINCT game_pk) >= 10 AND count(*) >= 500 AS supported
FROM log GROUP BY GROUPING SETS ((p_throws), (stand), (season), (p_throws, stand), (p_throws, season))""")
def _d21(t):
    return aggs.support_census(t.log, [["p_throws"], ["stand"], ["season"], ["p_throws", "stand"], ["p_throws", "season"]], K, 500, 10)


@query("d22_group_report", CLONE_CTE + """,
g AS (SELECT *, p_throws AS role FROM clone)
SELECT role, pitcher, count(*) AS requested, count(DISTINCT game_pk) AS clusters, count_if(observed_supported) AS n_supported, avg(CASE WHEN observed_supported THEN -ln(p_clone) END) AS conditional_nll,
  CASE WHEN count_if(observed_supported) = count(*) THEN avg(CASE WHEN observed_supported THEN -ln(p_clone) END) END AS full_nll FROM g GROUP BY GROUPING SETS ((), (role), (role, pitcher))""", doubles=["conditional_nll", "full_nll"])
def _d22(t):
    return aggs.group_report(clone(t).withColumn("role", c("p_throws")), "role", "pitcher", "game_pk", "p_clone", "observed_supported")


_CONC = ["observed_hhi", "advised_hhi", "observed_max", "advised_max", "observed_entropy", "advised_entropy", "total_variation"]


@query("d23_concentration", """
r AS (SELECT pitcher, balls, strikes, pitch_type AS obs, ['FF','SI','SL','CU','CH'][vi % 5 + 1] AS adv FROM log WHERE pitch_type IS NOT NULL),
t AS (SELECT pitcher, balls, strikes, count(*) AS n, count_if(obs = adv) AS m FROM r GROUP BY 1, 2, 3),
u AS (SELECT pitcher, balls, strikes, code, sum(a) AS a, sum(b) AS b FROM (SELECT pitcher, balls, strikes, obs AS code, 1 AS a, 0 AS b FROM r UNION ALL SELECT pitcher, balls, strikes, adv, 0, 1 FROM r) GROUP BY 1, 2, 3, 4),
s AS (SELECT u.*, n, m, a / n AS sa, b / n AS sb FROM u JOIN t USING (pitcher, balls, strikes))
SELECT pitcher, balls, strikes, max(n) AS events, sum(sa * sa) AS observed_hhi, sum(sb * sb) AS advised_hhi, max(sa) AS observed_max, max(sb) AS advised_max, -sum(CASE WHEN sa > 0 THEN sa * ln(sa) ELSE 0 END) AS observed_entropy,
  -sum(CASE WHEN sb > 0 THEN sb * ln(sb) ELSE 0 END) AS advised_entropy, sum(abs(sa - sb)) / 2 AS total_variation, max(m) AS matches FROM s GROUP BY 1, 2, 3""", doubles=_CONC)
def _d23(t):
    adv = F.element_at(F.array(*[F.lit(x) for x in ("FF", "SI", "SL", "CU", "CH")]), (c("vi") % 5 + 1).cast("int"))
    return aggs.concentration(t.log.where("pitch_type is not null").withColumn("advised", adv), ["pitcher", "balls", "strikes"], "pitch_type", "advised")


@query("d25_profile_refresh", STYLE_CTE.replace("FROM log),\nsd", "FROM (SELECT game_pk, batter, game_date, description, events, is_last, launch_angle FROM log WHERE game_date < DATE '2024-01-25' UNION ALL SELECT NULL, batter, DATE '2024-01-25', '', NULL, false, NULL FROM (SELECT DISTINCT batter FROM log WHERE game_date < DATE '2024-01-25' UNION ALL SELECT -1))),\nsd") + """,
ls AS (SELECT batter, max(game_date) AS last_seen FROM log WHERE game_date < DATE '2024-01-25' GROUP BY 1)
SELECT batter, contact_prior, swing_prior, walk_prior, strikeout_prior, isolated_power_prior, groundball_prior, (contact_weight + swing_weight + walk_weight + strikeout_weight + isolated_power_weight + groundball_weight) / 6 AS reliability, last_seen,
  (contact_weight + swing_weight + walk_weight + strikeout_weight + isolated_power_weight + groundball_weight) / 6 < 0.2 AS low_reliability, coalesce(date_diff('day', last_seen, DATE '2024-01-25') > 7, false) AS stale, last_seen IS NULL AS unknown
FROM style LEFT JOIN ls USING (batter) WHERE game_date = DATE '2024-01-25'""", doubles=[f"{s}_prior" for s in asof.STYLES] + ["reliability"])
def _d25(t):
    return asof.refresh_profiles(t.log, K, terminal(), "2024-01-25", unknown=-1, low=0.2, stale_days=7)


@query("d26_reference_card", """
f AS (SELECT pitcher, stand, balls, strikes, pitch_type, count(*) AS n FROM log WHERE pitch_type IS NOT NULL GROUP BY ALL),
s AS (SELECT pitcher, stand, balls, strikes, sum(n) AS t FROM f GROUP BY ALL), w AS (SELECT pitcher, stand, pitch_type, sum(n) AS n FROM f GROUP BY ALL), ws AS (SELECT pitcher, stand, sum(n) AS t FROM w GROUP BY ALL),
u AS (SELECT f.*, 'cell' AS scope FROM f JOIN s USING (pitcher, stand, balls, strikes) WHERE t >= 15
  UNION ALL SELECT s.pitcher, s.stand, s.balls, s.strikes, w.pitch_type, CAST(w.n AS BIGINT), 'broad' FROM s JOIN ws USING (pitcher, stand) JOIN w USING (pitcher, stand) WHERE s.t < 15 AND ws.t >= 15),
a AS (SELECT *, CAST(sum(n) OVER c AS BIGINT) AS tot FROM u WINDOW c AS (PARTITION BY pitcher, stand, balls, strikes)),
b AS (SELECT *, n * 100 // tot AS fl, n * 100 % tot AS rm FROM a),
d AS (SELECT *, 100 - sum(fl) OVER c AS lft, count(*) OVER (PARTITION BY pitcher, stand, balls, strikes ORDER BY rm DESC, n DESC) AS used, row_number() OVER (PARTITION BY pitcher, stand, balls, strikes ORDER BY n DESC, pitch_type) AS rank FROM b WINDOW c AS (PARTITION BY pitcher, stand, balls, strikes))
SELECT pitcher, stand, balls, strikes, pitch_type, n, scope, fl + CASE WHEN rm > 0 AND used <= lft THEN 1 ELSE 0 END AS percent, rank, n / tot AS share FROM d WHERE n / tot >= 0.05 AND rank <= 4""", doubles=["share"])
def _d26(t):
    return aggs.reference_card(t.log.where("pitch_type is not null"), ["pitcher", "stand", "balls", "strikes"], ["pitcher", "stand"], "pitch_type", 15, 0.05, 4)


ZONES = [(i + 3 * j + 1, x, z) for j, z in enumerate((1.9, 2.5, 3.1)) for i, x in enumerate((-0.55, 0.0, 0.55))]
_ZV = ", ".join(f"({i}, {x}, {z})" for i, x, z in ZONES)
KERNEL_CTE = f"""
kz AS (SELECT pitcher, pitch_type, zone, avg(w) AS mass, sum(w) * sum(w) / sum(w * w) AS ess, count(*) AS draws FROM (SELECT pitcher, pitch_type, z.zone, exp(-(power(plate_x - tx, 2) + power(plate_z - tz, 2)) / (2 * 0.5 * 0.5)) AS w
   FROM log, (VALUES {_ZV}) z(zone, tx, tz) WHERE plate_x IS NOT NULL AND pitch_type IS NOT NULL) GROUP BY ALL)
"""


def kernel(t):
    return aggs.kernel_zones(t.log.where("plate_x is not null and pitch_type is not null"), ["pitcher", "pitch_type"], "plate_x", "plate_z", ZONES, 0.5, 3.0, 0.02)


@query("d27_kernel_zones", KERNEL_CTE + " SELECT *, ess >= 3 AND mass >= 0.02 AS supported FROM kz", doubles=["mass", "ess"])
def _d27(t):
    return kernel(t)


@query("d27_best_zone", KERNEL_CTE + " SELECT pitcher, pitch_type, zone, mass, ess FROM (SELECT *, row_number() OVER (PARTITION BY pitcher, pitch_type ORDER BY mass DESC, zone DESC) AS rn FROM kz WHERE ess >= 3 AND mass >= 0.02) WHERE rn = 1", doubles=["mass", "ess"])
def _d27b(t):
    return aggs.best_zone(kernel(t), ["pitcher", "pitch_type"])


@query("d28_operational_counters", """
SELECT event_type AS model, CASE WHEN k % 10 = 0 THEN 'ABSTAIN' WHEN k % 10 = 1 THEN 'INCOMPLETE' ELSE 'OK' END AS status, CASE WHEN vi % 7 = 0 THEN 'POST' ELSE 'PRE_RECEIPT' END AS timing, count(*) AS n, median(value) AS p50, max(value) AS max_latency
FROM (SELECT event_type, value, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS vi FROM events) GROUP BY 1, 2, 3""", doubles=["p50", "max_latency"])
def _d28(t):
    e = t.events.selectExpr("event_type as model", "value", "cast(regexp_extract(props, '[0-9]+', 0) as bigint) as k", "cast(round(value * 100) as bigint) as vi").withColumns({
        "status": F.when(c("k") % 10 == 0, "ABSTAIN").when(c("k") % 10 == 1, "INCOMPLETE").otherwise("OK"), "timing": F.when(c("vi") % 7 == 0, "POST").otherwise("PRE_RECEIPT")})
    return aggs.operational_counters(e, ["model", "status", "timing"], "value")


@query("d29_sample_weights", """
r AS (SELECT *, 1 + CASE WHEN pitcher % 7 = 0 THEN 1.5 ELSE 0.5 * (vi % 100) / 100.0 END AS raw FROM log),
w AS (SELECT *, raw / (SELECT avg(raw) FROM r) AS w FROM r),
e AS (SELECT sum(w) * sum(w) / sum(w * w) / count(*) AS ef, sum(w) AS t FROM w),
s AS (SELECT 'actor' AS id, pitcher::VARCHAR AS v, sum(w) AS s FROM w GROUP BY 2 UNION ALL SELECT 'entity', batter::VARCHAR, sum(w) FROM w GROUP BY 2 UNION ALL SELECT 'code', pitch_type, sum(w) FROM w GROUP BY 2),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, v) AS rn FROM s)
SELECT id, ef AS ess_fraction, max(s) / t AS max_mass, sum(s) FILTER (rn <= 10) / t AS top10_mass FROM k, e GROUP BY id, ef, t""", doubles=["ess_fraction", "max_mass", "top10_mass"])
def _d29(t):
    w = aggs.sample_weights(t.log, c("pitcher") % 7 == 0, (c("vi") % 100) / 100.0, 1.5, 0.5)
    return aggs.mass_audit(w, {"actor": "pitcher", "entity": "batter", "code": "pitch_type"})


@query("d30_exposure_ranking", OUTS_CTE + """,
st AS (SELECT *, CASE WHEN season <= 2022 THEN 'train' ELSE 'dev' END AS period FROM outs WHERE pitcher = starter),
ag AS (SELECT pitcher, period, count(DISTINCT game_pk) AS starts, sum(outs_recorded) AS outs, count(DISTINCT batter) AS opp, count(DISTINCT game_pk * 1000 + at_bat_number) AS pas FROM st GROUP BY 1, 2),
wd AS (SELECT pitcher, CAST(coalesce(sum(outs) FILTER (period = 'train'), 0) AS BIGINT) AS train_outs, CAST(coalesce(sum(outs) FILTER (period = 'dev'), 0) AS BIGINT) AS dev_outs, CAST(coalesce(sum(starts) FILTER (period = 'train'), 0) AS BIGINT) AS train_starts,
  CAST(coalesce(sum(opp) FILTER (period = 'dev'), 0) AS BIGINT) AS dev_opponents, CAST(coalesce(sum(pas) FILTER (period = 'dev'), 0) AS BIGINT) AS dev_episodes FROM ag GROUP BY 1),
el AS (SELECT * FROM wd WHERE train_outs > 0 AND dev_outs >= 10),
rk AS (SELECT *, (rank() OVER (ORDER BY train_outs) + (count(*) OVER (PARTITION BY train_outs) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER () AS train_pct, (rank() OVER (ORDER BY dev_outs) + (count(*) OVER (PARTITION BY dev_outs) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER () AS dev_pct FROM el),
ss AS (SELECT DISTINCT pitcher, game_date, game_pk, fielding_team FROM st), sq AS (SELECT pitcher, count_if(coalesce(p <> fielding_team, false)) AS team_changes FROM (SELECT *, lag(fielding_team) OVER (PARTITION BY pitcher ORDER BY game_date, game_pk, fielding_team) AS p FROM ss) GROUP BY 1)
SELECT rk.*, least(train_pct, dev_pct) AS balanced, team_changes FROM rk JOIN sq USING (pitcher)""", doubles=["train_pct", "dev_pct", "balanced"])
def _d30(t):
    starts = with_outs(t.log).where("pitcher = starter").withColumn("period", F.when(c("season") <= 2022, "train").otherwise("dev"))
    return aggs.exposure_ranking(starts, K, "period", "fielding_team", "outs_recorded", 10)


@query("d31_cell_support", """
tr AS (SELECT * FROM log WHERE season <= 2022), n AS (SELECT balls, strikes, pitch_type, pitcher, count(*) AS n FROM tr WHERE pitch_type IS NOT NULL GROUP BY ALL),
j AS (SELECT CASE WHEN l.season <= 2022 THEN 'train' ELSE 'dev' END AS side, coalesce(n.n, 0) AS s FROM log l LEFT JOIN n USING (balls, strikes, pitch_type, pitcher) WHERE l.pitch_type IS NOT NULL)
SELECT side, count(*) AS events, count_if(s = 0) AS unseen, count_if(s <= 2) AS le_2, count_if(s <= 5) AS le_5, count_if(s <= 10) AS le_10, min(s)::DOUBLE AS q0, quantile_cont(s, 0.25) AS q1, quantile_cont(s, 0.5) AS q2, quantile_cont(s, 0.75) AS q3, max(s)::DOUBLE AS q4 FROM j GROUP BY 1""", doubles=[f"q{i}" for i in range(5)])
def _d31(t):
    log = t.log.where("pitch_type is not null").withColumn("side", F.when(c("season") <= 2022, "train").otherwise("dev"))
    return aggs.cell_support(log.where("season <= 2022"), log, ["balls", "strikes", "pitch_type", "pitcher"], "side")


@query("d31_cell_sizes", "SELECT size, count(*) AS cells FROM (SELECT count(*) AS size FROM log WHERE season <= 2022 AND pitch_type IS NOT NULL GROUP BY balls, strikes, pitch_type, pitcher) GROUP BY 1")
def _d31b(t):
    return aggs.singleton_cells(t.log.where("season <= 2022 and pitch_type is not null"), ["balls", "strikes", "pitch_type", "pitcher"])
