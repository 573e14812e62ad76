"""Sections A and J: sources, versions, and live-data intake."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylane.keys import DEFAULT_KEYS as K
from tallylane.operators.lineage import shared_folder
from tallylane.plans.registry import Tables, query
from tallylane.sources import game_feed, log_io
from tallylane.streaming import release, state, views

c = F.col
KEY = K.event
EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stored_version(t: Tables, columns) -> str:
    """A new version of the log in the shared folder, with a folder for each season."""
    path = f"{shared_folder(t.spark)}/version-{uuid.uuid4().hex}"
    log_io.write_version(t.log.select("season", *columns), path, "season")
    return path


@query("a01_season_scan", "SELECT event_id, pitcher, pitch_type FROM log")
def _a01(t):
    path = stored_version(t, ["event_id", "pitcher", "pitch_type", "release_speed"])
    return log_io.scan(t.spark, log_io.partition_folders(t.spark, path, "season"), ["event_id", "pitcher", "pitch_type"])


@query("a02_predicate_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate <= TIMESTAMP '1997-06-30' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)", doubles=["o_totalprice"], log=False)
def _a02(t):
    early = log_io.scan(t.spark, [f"{t.sf_dir}/orders.parquet"], ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"], "o_orderdate <= timestamp '1997-06-30'")
    return log_io.scan_keys(early, t.customer.where("c_custkey % 3 = 0").select(c("c_custkey").alias("o_custkey")), ["o_custkey"]).drop("o_orderdate")


_TYPED = """WITH s AS (SELECT o_orderkey::VARCHAR || CASE WHEN o_orderkey % 50 = 0 THEN '.5' ELSE '' END AS o_orderkey, CASE WHEN o_orderkey % 40 = 0 THEN 'n/a' ELSE o_totalprice::VARCHAR END AS o_totalprice, o_orderpriority FROM orders)"""


def _typed(t):
    raw = t.orders.select(
        F.concat(c("o_orderkey").cast("string"), F.when(c("o_orderkey") % 50 == 0, ".5").otherwise("")).alias("o_orderkey"),
        F.when(c("o_orderkey") % 40 == 0, "n/a").otherwise(c("o_totalprice").cast("string")).alias("o_totalprice"), "o_orderpriority")
    return log_io.apply_types(raw)


@query("a03_typed_columns", _TYPED + " SELECT CAST(trunc(TRY_CAST(o_orderkey AS DOUBLE)) AS BIGINT) AS o_orderkey, TRY_CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderpriority FROM s", doubles=["o_totalprice"], log=False)
def _a03(t):
    return _typed(t)[0]


@query("a03_type_gate", _TYPED + " SELECT count_if(TRY_CAST(o_orderkey AS DOUBLE) <> floor(TRY_CAST(o_orderkey AS DOUBLE))) AS o_orderkey, count_if(TRY_CAST(o_totalprice AS DOUBLE) IS NULL) AS o_totalprice, 0::BIGINT AS o_orderpriority FROM s", log=False)
def _a03b(t):
    return _typed(t)[1]


@query("a04_batch_normalise", "SELECT game_pk, at_bat_number, pitch_number, CAST(ts AS DATE) AS ts FROM log WHERE game_type = 'R'")
def _a04(t):
    return log_io.normalise(t.log.select(*KEY, "game_type", "ts"), K, "game_type", "R", "ts").drop("game_type")


@query("a05_permissive_union", """SELECT event_id, CASE WHEN season <= 2022 THEN pitch_type END AS pitch_type, CASE WHEN season > 2022 THEN release_speed END AS release_speed FROM log""", doubles=["release_speed"])
def _a05(t):
    a = t.log.where("season <= 2022").select("event_id", "pitch_type", F.lit(None).alias("release_speed"))
    b = t.log.where("season > 2022").select("event_id", "release_speed")
    return log_io.permissive_union([a, b])


DIGEST_COLS = ["game_pk", "at_bat_number", "pitch_number", "pitch_type", "description", "events", "pitcher", "batter"]
MANIFEST_CTE = """
mh AS (SELECT *, ('0x' || substr(sha256(concat_ws('|', """ + ", ".join(f"coalesce({x}::VARCHAR, '~')" for x in DIGEST_COLS) + """)), 1, 12))::BIGINT AS h FROM log),
mn AS (SELECT season, count(*) AS rows, count(*) - count(DISTINCT event_id) AS duplicate_keys, min(game_date) AS first_date, max(game_date) AS last_date, CAST(sum(h) AS VARCHAR) AS digest FROM mh GROUP BY 1)
"""


@query("a06_manifest", MANIFEST_CTE + " SELECT * FROM mn")
def _a06(t):
    """The manifest of a version that was written, read back from its season folders."""
    path = stored_version(t, ["game_date", *DIGEST_COLS])
    return log_io.manifest(t.spark.read.parquet(path).withColumn("season", c("season").cast("bigint")), "season", K, DIGEST_COLS)


@query("a07_verify_version", MANIFEST_CTE + """
SELECT season, 'different_rows' AS problem FROM mn WHERE season = 2022 UNION ALL SELECT season, 'different_digest' FROM mn WHERE season = 2022 UNION ALL SELECT season, 'not_in_manifest' FROM mn WHERE season = 2024 UNION ALL SELECT 2030, 'missing_in_data'""")
def _a07(t):
    """The stored manifest disagrees on one season, lacks one and lists one that does not exist."""
    m = log_io.manifest(t.log, "season", K, DIGEST_COLS)
    stored = m.where("season <> 2024").withColumns({"rows": F.when(c("season") == 2022, c("rows") + 1).otherwise(c("rows")), "digest": F.when(c("season") == 2022, F.concat("digest", F.lit("7"))).otherwise(c("digest"))})
    extra = m.where("season = 2021").withColumn("season", F.lit(2030).cast("bigint"))
    return log_io.verify(stored.unionByName(extra), m, "season", ["rows", "duplicate_keys", "digest"])


def feed_documents(t) -> DataFrame:
    """One nested document per cluster, as a live feed would deliver it (a cluster is bounded)."""
    call = F.when(c("is_ball"), "B").when(c("description").isin("foul", "foul_bunt"), "F").when(c("is_strike"), "S").otherwise("X")
    log = t.log.withColumns({"is_ball": c("description").isin("ball", "intent_ball", "pitchout", "automatic_ball"),
                             "is_strike": c("description").isin("called_strike", "swinging_strike", "swinging_strike_blocked", "foul_tip", "automatic_strike")})
    ev = F.struct(c("pitch_number").alias("number"), call.alias("call"), c("pitch_type").alias("code"), F.when(c("k") % 3 == 0, c("pitcher")).alias("pitcher"), "runs", F.when(c("is_last") & (c("k") % 20 < 11), 1).otherwise(0).cast("bigint").alias("out"))
    play = log.groupBy("game_pk", "at_bat_number").agg(F.min("inning_topbot").alias("half"), F.min("pitcher").alias("pitcher"), F.min("batter").alias("batter"), F.sort_array(F.collect_list(ev)).alias("playEvents"))
    plays = F.sort_array(F.collect_list(F.struct(c("at_bat_number").alias("atBat"), "half", "pitcher", "batter", "playEvents")))
    return play.groupBy("game_pk").agg(F.to_json(F.struct(c("game_pk").alias("game"), plays.alias("plays"))).alias("body"))


@query("a08_feed_flatten", """
f AS (SELECT *, CASE WHEN description IN ('ball','intent_ball','pitchout','automatic_ball') THEN 'B' WHEN description IN ('foul','foul_bunt') THEN 'F' WHEN description IN ('called_strike','swinging_strike','swinging_strike_blocked','foul_tip','automatic_strike') THEN 'S' ELSE 'X' END AS call,
  CASE WHEN is_last AND k % 20 < 11 THEN 1 ELSE 0 END AS out FROM log)
SELECT game_pk, at_bat_number, pitch_number, pitcher, pitch_type AS code, CAST(least(3, coalesce(sum((call = 'B')::INT) OVER p, 0)) AS BIGINT) AS balls_before, CAST(least(2, coalesce(sum((call IN ('S', 'F'))::INT) OVER p, 0)) AS BIGINT) AS strikes_before,
  CAST(coalesce(sum(out) OVER g, 0) AS BIGINT) AS outs_total_before, CAST(coalesce(sum(CASE WHEN inning_topbot = 'Top' THEN runs ELSE 0 END) OVER g, 0) AS BIGINT) AS away_before, CAST(coalesce(sum(CASE WHEN inning_topbot = 'Bot' THEN runs ELSE 0 END) OVER g, 0) AS BIGINT) AS home_before
FROM f WINDOW p AS (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g AS (PARTITION BY game_pk ORDER BY at_bat_number, pitch_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _a08(t):
    return log_io.flatten_feed(feed_documents(t), K).select(*KEY, "pitcher", "code", "balls_before", "strikes_before", "outs_total_before", "away_before", "home_before")


#: Movements of an event by its k: runner (as an offset to the batter's id), and from base to base; - is none, x an out, H home.
MOVES = {0: (0, "-1"), 1: (1, "12"), 2: (2, "2H"), 3: (3, "1x"), 4: (0, "-23"), 5: (4, "3H"), 6: (0, "-x")}
BASE_NAMES = {"1": "1B", "2": "2B", "3": "3B", "H": "score"}


def game_documents(t) -> DataFrame:
    """A nested feed of every cluster in the provider's form: pitches, automatic calls, substitutions, steals, movements listed by runner."""
    index = c("pitch_number") * 3

    def movement(at, runner, a, b):
        text = F.lit(None).cast("string")
        return F.struct(
            F.struct(F.lit(BASE_NAMES.get(a)).cast("string").alias("start") if a in BASE_NAMES else text.alias("start"), F.lit(BASE_NAMES[b]).alias("end") if b in BASE_NAMES else text.alias("end"), F.lit(b == "x").alias("isOut")).alias("movement"),
            F.struct(at.alias("playIndex"), F.struct((c("batter") + runner).alias("id")).alias("runner")).alias("details"))

    moves = [F.when(c("k") % 10 == r, F.array(*[movement(index + 1, who, a, b) for a, b in zip(path, path[1:])])) for r, (who, path) in MOVES.items()]
    steal = F.when(c("k") % 16 == 7, F.array(movement(index + 2, 1, "1", "2")))
    count = F.struct((c("k") % 4).alias("balls"), (c("k") % 3).alias("strikes"))
    no_count = F.struct(F.when(c("k") % 2 == 0, F.lit(1)).cast("long").alias("balls"), F.lit(None).cast("long").alias("strikes"))
    none = F.lit(None)

    def event(at, pitch, kind, name, player, call, counted):
        details = F.struct(name.cast("string").alias("eventType"), F.struct(call.cast("string").alias("code")).alias("call"), F.struct(F.when(pitch, c("pitch_type")).alias("code")).alias("type"))
        data = F.when(pitch, F.struct(c("release_speed").alias("startSpeed"), F.struct((c("k") / 4.0).alias("breakHorizontal"), (c("k") / 8.0).alias("breakVerticalInduced")).alias("breaks")))
        return F.struct(at.alias("index"), pitch.alias("isPitch"), kind.alias("type"), F.struct(player.cast("long").alias("id")).alias("player"), details.alias("details"), counted.alias("count"), data.alias("pitchData"))

    called = c("k") % 40 != 39
    codes = F.element_at(F.array(*[F.lit(x) for x in ("B", "C", "F", "X", "S", "*B", "zz")]), (c("k") % 7 + 1).cast("int"))
    swap = F.when(c("k") % 25 == 9, F.array(event(index, F.lit(False), F.lit("action"), F.lit(game_feed.SUBSTITUTION), c("pitcher") + 1000, none, no_count)))
    thrown = F.array(event(index + 1, called, F.when(called, "pitch").otherwise("no_pitch"), none, none, F.when(called, codes).otherwise("VB"), count))
    stolen = F.when(c("k") % 16 == 7, F.array(event(index + 2, F.lit(False), F.lit("action"), F.lit("stolen_base_2b"), none, none, no_count)))
    empty = thrown.getItem(0)
    rows = t.log.withColumns({
        "_events": F.concat(F.coalesce(swap, F.filter(F.array(empty), lambda x: F.lit(False))), thrown, F.coalesce(stolen, F.filter(F.array(empty), lambda x: F.lit(False)))),
        "_moves": F.concat(F.coalesce(*moves, F.array().cast("array<struct<movement:struct<start:string,end:string,isOut:boolean>,details:struct<playIndex:bigint,runner:struct<id:bigint>>>>")), F.coalesce(steal, F.array().cast("array<struct<movement:struct<start:string,end:string,isOut:boolean>,details:struct<playIndex:bigint,runner:struct<id:bigint>>>>")))})
    play = rows.groupBy("game_pk", "at_bat_number").agg(
        F.min(c("inning") + c("game_pk") % 2).alias("inning"), F.min("inning_topbot").alias("side"), F.min("batter").alias("batter"), F.min("stand").alias("stand"),
        F.coalesce(F.max_by(F.when(c("k") % 25 == 9, c("pitcher") + 1000), F.when(c("k") % 25 == 9, c("pitch_number"))), F.min("pitcher")).alias("pitcher"), F.max_by("events", "pitch_number").alias("event"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pitch_number", "_events"))), lambda x: x["_events"])).alias("playEvents"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pitch_number", "_moves"))), lambda x: x["_moves"])).alias("runners"))
    shape = F.struct(
        F.struct((c("at_bat_number") - 1).alias("atBatIndex"), "inning", (c("side") == "Top").alias("isTopInning"), (c("at_bat_number") % 9 != 0).alias("isComplete")).alias("about"),
        F.struct(F.struct(c("pitcher").alias("id")).alias("pitcher"), F.struct(F.lit("R").alias("code")).alias("pitchHand"), F.struct(c("batter").alias("id")).alias("batter"), F.struct(c("stand").alias("code")).alias("batSide")).alias("matchup"),
        F.struct(c("event").alias("eventType"), c("event").alias("description")).alias("result"), "runners", "playEvents")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at_bat_number", shape.alias("p")))), lambda x: x["p"])
    game = play.groupBy("game_pk").agg(ordered.alias("allPlays"))
    head = F.struct(F.struct(c("game_pk").alias("pk"), F.when(c("game_pk") % 3 == 0, "F").otherwise("R").alias("type")).alias("game"), F.struct(F.lit("2025-04-03").alias("officialDate")).alias("datetime"))
    return game.select(F.to_json(F.struct(head.alias("gameData"), F.struct(F.struct("allPlays").alias("plays")).alias("liveData"))).alias("body"))


def _moves_sql():
    """One row for each group of movements: writes to the bases, outs, runs."""
    def group(cond, at, offset, path):
        start, end = path[0], path[-1]
        writes = []
        for b in "123":
            if end == b:
                writes.append(f"batter + {offset}")
            else:
                writes.append("-9" if start == b else "NULL")
        return f"SELECT game_pk, at_bat_number, period, inning_topbot, pitch_number * 3 + {at} AS idx, 1 AS kind, NULL::BIGINT AS pitch_number, {', '.join(f'({w})::BIGINT AS w{b}' for w, b in zip(writes, '123'))}, {int(end == 'x')} AS outs, {int(end == 'H')} AS runs FROM g0 WHERE {cond}"

    return " UNION ALL ".join([group(f"k % 10 = {r}", 1, who, path) for r, (who, path) in MOVES.items()] + [group("k % 16 = 7", 2, 1, "12")])


REPLAY_SQL = f"""
g0 AS (SELECT *, inning + game_pk % 2 AS period FROM log),
mv AS ({_moves_sql()}),
al AS (SELECT * FROM mv UNION ALL SELECT game_pk, at_bat_number, period, inning_topbot, pitch_number * 3 + 1, 0, pitch_number, NULL, NULL, NULL, 0, 0 FROM g0),
sb AS (SELECT *, {', '.join(f'last_value(w{b} IGNORE NULLS) OVER h AS b{b}' for b in '123')}, least(coalesce(sum(outs) OVER h, 0), 3)::BIGINT AS outs_when_up,
  coalesce(sum(CASE WHEN inning_topbot = 'Bot' THEN runs ELSE 0 END) OVER g, 0)::BIGINT AS home_score, coalesce(sum(CASE WHEN inning_topbot = 'Top' THEN runs ELSE 0 END) OVER g, 0)::BIGINT AS away_score,
  sum(CASE WHEN inning_topbot = 'Bot' THEN runs ELSE 0 END) OVER (PARTITION BY game_pk)::BIGINT AS all_home, sum(CASE WHEN inning_topbot = 'Top' THEN runs ELSE 0 END) OVER (PARTITION BY game_pk)::BIGINT AS all_away
  FROM al WINDOW h AS (PARTITION BY game_pk, period, inning_topbot ORDER BY at_bat_number, idx, kind, pitch_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g AS (PARTITION BY game_pk ORDER BY at_bat_number, idx, kind, pitch_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pm AS (SELECT game_pk, at_bat_number, any_value(inning_topbot) AS inning_topbot, coalesce(max_by(pitcher + 1000, pitch_number) FILTER (k % 25 = 9), min(pitcher)) AS matchup, max(pitch_number) FILTER (k % 25 = 9) AS last_swap, max(pitch_number) AS last_pitch FROM log GROUP BY 1, 2),
pb AS (SELECT *, lag(matchup) OVER (PARTITION BY game_pk, inning_topbot ORDER BY at_bat_number) AS before FROM pm),
ct AS (SELECT game_pk, at_bat_number, pitch_number * 3 AS idx, (CASE WHEN k % 2 = 0 THEN 1 END)::BIGINT AS balls, NULL::BIGINT AS strikes, pitcher + 1000 AS known FROM log WHERE k % 25 = 9
  UNION ALL SELECT game_pk, at_bat_number, pitch_number * 3 + 1, k % 4, k % 3, CASE WHEN last_swap IS NULL OR last_swap * 3 <= pitch_number * 3 + 1 THEN matchup END FROM log JOIN pm USING (game_pk, at_bat_number)
  UNION ALL SELECT game_pk, at_bat_number, pitch_number * 3 + 2, CASE WHEN k % 2 = 0 THEN 1 END, NULL, NULL FROM log WHERE k % 16 = 7),
cb AS (SELECT game_pk, at_bat_number, idx, coalesce(last_value(balls IGNORE NULLS) OVER w, 0) AS balls, coalesce(last_value(strikes IGNORE NULLS) OVER w, 0) AS strikes, last_value(known IGNORE NULLS) OVER w AS known FROM ct WINDOW w AS (PARTITION BY game_pk, at_bat_number ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
on_ AS (SELECT *, CASE WHEN b1 <> -9 THEN b1 END AS on_1b, CASE WHEN b2 <> -9 THEN b2 WHEN b2 IS NULL AND game_pk % 3 <> 0 AND period >= 10 THEN -1 END AS on_2b, CASE WHEN b3 <> -9 THEN b3 END AS on_3b, coalesce(lead(home_score) OVER g, all_home) AS post_home_score, coalesce(lead(away_score) OVER g, all_away) AS post_away_score FROM sb WHERE kind = 0 WINDOW g AS (PARTITION BY game_pk ORDER BY at_bat_number, pitch_number))
SELECT game_pk, at_bat_number, pitch_number, CASE WHEN last_swap * 3 > pitch_number * 3 + 1 THEN coalesce(known, before, matchup) ELSE matchup END AS pitcher, cb.balls, cb.strikes, on_.outs_when_up, on_.on_1b, on_.on_2b, on_.on_3b,
  (on_.on_1b IS NOT NULL)::INT + 2 * (on_.on_2b IS NOT NULL)::INT + 4 * (on_.on_3b IS NOT NULL)::INT AS bases, on_.home_score, on_.away_score, on_.post_home_score, on_.post_away_score,
  CASE WHEN k % 40 = 39 THEN 'automatic_ball' ELSE ['ball', 'called_strike', 'foul', 'hit_into_play', 'swinging_strike', 'blocked_ball', 'unmapped:zz'][k % 7 + 1] END AS description,
  CASE WHEN pitch_number = last_pitch AND at_bat_number % 9 <> 0 THEN coalesce(events, 'truncated_pa') END AS events, CASE WHEN k % 40 <> 39 THEN -k / 48.0 END AS pfx_x
FROM on_ JOIN log l USING (game_pk, at_bat_number, pitch_number) JOIN pb USING (game_pk, at_bat_number) JOIN cb ON cb.game_pk = on_.game_pk AND cb.at_bat_number = on_.at_bat_number AND cb.idx = on_.idx"""


@query("a08_feed_replay", REPLAY_SQL, doubles=["pfx_x"])
def _a08r(t):
    """State of the game before every pitch, replayed from nested documents."""
    flat = game_feed.flatten_game_feed(game_documents(t), K)
    return flat.select(*KEY, "pitcher", "balls", "strikes", "outs_when_up", "on_1b", "on_2b", "on_3b", "bases", "home_score", "away_score", "post_home_score", "post_away_score", "description", "events", "pfx_x")


# --- J: every source row is a delivery; some are delivered again, corrected, late or malformed ------

def deliveries(events: DataFrame) -> DataFrame:
    """Live deliveries of a cluster, derived row by row so that a stream can use it.

    Copy 0 is the first delivery; copy 1 repeats it, corrects it, moves it or arrives with an old stamp.
    """
    e = events.select("event_id", F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("k"), F.expr("cast(round(value * 100) as bigint)").alias("vi"),
                      F.expr("event_id div 216").alias("game_pk"), F.expr("event_id % 216 div 4 + 1").alias("at_bat_number"), F.expr("event_id % 4 + 1").alias("pitch_number"))
    d = e.withColumn("copy", F.explode(F.when(c("k") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    x = F.expr
    return d.withColumns({
        "seq": x("event_id * 4 + copy * (1 + 8 * (k % 3))"),
        "received": x("event_id * 10 + copy * 25 - case when k % 50 = 49 then 40 else 0 end"),
        "event": x("case when k % 37 <> 36 then event_id * 10 - k % 30 - copy * 5 end"),
        "stamp": x("case when k % 24 <> 8 then event_id * 10 + copy * case when k % 16 = 0 then -20 when k % 16 = 12 then 0 else 5 end end"),
        "rank": x("case when k = 99 then 2 else 1 end"),
        "sha": x("sha2(concat(event_id, ':', case when copy = 1 and k % 8 <> 0 then 1 else 0 end), 256)"),
        "provider_id": x("concat('p', event_id - case when copy = 1 and k % 20 = 4 then 1 else 0 end)"),
        "malformed": x("case when k = 71 then 'malformed_item' end"),
        "revision": x("1 + copy - case when k % 28 = 16 then 1 else 0 end * copy"),
    })


#: What the steps read; every column that goes to a Python task costs as much as the step itself.
SLOT_INPUT = ["game_pk", "seq", "event", "received", "stamp", "rank", "sha"]
REVISION_INPUT = ["game_pk", "seq", "provider_id", "at_bat_number", "pitch_number", "sha", "stamp", "malformed", "received", "revision"]
INTAKE_INPUT = ["game_pk", "seq", "provider_id", "at_bat_number", "pitch_number", "sha", "received", "revision"]


def delivery_stream(t: Tables) -> DataFrame:
    raw = log_io.snapshot_stream(t.spark, t.sf_dir, EVENT_SCHEMA, glob="events.parquet")
    return deliveries(raw)


def slots(t: Tables) -> DataFrame:
    return state.run_to_table(state.fold(delivery_stream(t).select(SLOT_INPUT), ["game_pk"], "seq", state.slot_step, state.SLOT_SCHEMA, late="outcome"), t.spark)


@query("a09_snapshot_stream", "SELECT event_id, event_type FROM events", log=False)
def _a09(t):
    raw = log_io.snapshot_stream(t.spark, t.sf_dir, EVENT_SCHEMA, glob="events.parquet").select("event_id", "event_type")
    return state.run_to_table(raw, t.spark)


@query("j01_slot_state")
def _j01(t):
    return slots(t)


def ledger(t):
    return state.run_to_table(state.fold(delivery_stream(t).select(REVISION_INPUT), ["game_pk"], "seq", state.revision_step, state.REVISION_SCHEMA, late="outcome"), t.spark)


@query("j02_revision_ledger")
def _j02(t):
    return ledger(t)


DELIVERY_CTE = """WITH dl0 AS (SELECT event_id, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS vi, event_id // 216 AS game_pk, event_id % 216 // 4 + 1 AS at_bat_number, event_id % 4 + 1 AS pitch_number, ts FROM events),
dl AS (SELECT *, event_id * 4 + copy * (1 + 8 * (k % 3)) AS seq, event_id * 10 + copy * 25 - CASE WHEN k % 50 = 49 THEN 40 ELSE 0 END AS received, CASE WHEN k % 37 <> 36 THEN event_id * 10 - k % 30 - copy * 5 END AS event,
  sha256(event_id || ':' || CASE WHEN copy = 1 AND k % 8 <> 0 THEN 1 ELSE 0 END) AS sha, 'p' || (event_id - CASE WHEN copy = 1 AND k % 20 = 4 THEN 1 ELSE 0 END) AS provider_id FROM dl0, (VALUES (0), (1)) v(copy) WHERE copy = 0 OR k % 4 = 0)
"""


@query("j03_admission")
def _j03(t):
    shown = deliveries(t.events).where("copy = 0").select("game_pk", "at_bat_number", "pitch_number", "sha")
    return views.admission(shown, ledger(t), KEY)


@query("j04_event_intake")
def _j04(t):
    return state.run_to_table(state.fold(delivery_stream(t).select(INTAKE_INPUT), ["game_pk"], "seq", state.intake_step, state.INTAKE_SCHEMA, late="status"), t.spark)


@query("j05_frozen_context", """
v AS (SELECT game_pk, at_bat_number, pitch_number, pitcher, event_id AS token, CASE WHEN k % 45 = 44 THEN 'unknown' WHEN k % 45 = 43 THEN 'incomplete' ELSE 'accepted' END AS st FROM log),
b AS (SELECT *, row_number() OVER (PARTITION BY game_pk ORDER BY at_bat_number, pitch_number) AS i FROM v),
u AS (SELECT *, max(CASE WHEN st = 'unknown' THEN i END) OVER (PARTITION BY game_pk ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS un, list(CASE WHEN st = 'accepted' THEN {'i': i, 't': token} END) OVER (PARTITION BY game_pk, pitcher ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h0 FROM b),
h AS (SELECT *, list_filter(h0, lambda x: x IS NOT NULL) AS h FROM u),
l AS (SELECT *, h[greatest(len(h) - 31, 1):] AS w FROM h),
z AS (SELECT *, un IS NOT NULL AND NOT coalesce(len(w) = 32 AND un < w[1].i AND un < i - 1, false) AS blocked FROM l)
SELECT token AS decision_id, CASE WHEN blocked THEN 'prior_quality_unknown' END AS abstain, CASE WHEN NOT blocked THEN coalesce(array_to_string(list_transform(w, lambda x: x.t), ','), '') END AS context FROM z""")
def _j05(t):
    log = t.log
    last = F.when(c("k") % 45 == 44, "unknown").when(c("k") % 45 == 43, "incomplete").otherwise("accepted")
    versions = log.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        *KEY, "pitcher", "version", F.when((c("version") == 1) & (c("k") % 10 == 3), "unknown").otherwise(last).alias("status"), c("event_id").alias("token"))
    queries = log.select(*KEY, "pitcher", c("event_id").alias("decision_id"))
    out = views.frozen_context(versions, queries, "game_pk", "pitcher", ["at_bat_number", "pitch_number"], 32)
    return out.select("decision_id", "abstain", F.array_join(F.transform("context", lambda x: x.cast("string")), ",").alias("context"))


@query("j06_delayed_release", DELIVERY_CTE + """,
s AS (SELECT game_pk, event, seq FROM dl WHERE event IS NOT NULL), r AS (SELECT event_id AS request_id, game_pk, event_id * 10 - 50 * (1 + k % 3) AS t FROM dl0 WHERE k % 5 = 0)
SELECT request_id, r.game_pk, max_by(s.seq, (s.event, s.seq)) AS released_seq, max(s.event) AS released_event FROM r LEFT JOIN s ON s.game_pk = r.game_pk AND s.event <= r.t GROUP BY 1, 2""", log=False)
def _j06(t):
    d = deliveries(t.events)
    snaps = d.where("event is not null").select("game_pk", "event", "seq")
    viewers = d.where("copy = 0 and k % 5 = 0").select("game_pk", c("event_id").alias("request_id"), (c("event_id") * 10).alias("now"), (50 * (1 + c("k") % 3)).alias("delay"))
    return views.delayed_release(snaps, viewers, "game_pk", "delay", "now")


#: Seconds added to the deliveries' clock, as a watermark begins at the epoch and some of their times lie before it.
EPOCH = 1_000_000


@query("j06_release_stream", DELIVERY_CTE + """,
s AS (SELECT game_pk, event, seq FROM dl WHERE event IS NOT NULL), r AS (SELECT event_id AS request_id, game_pk, event_id * 10 - 50 * (1 + k % 3) AS t FROM dl0 WHERE k % 5 = 0),
m AS (SELECT greatest((SELECT max(event) FROM s), (SELECT max(t) FROM r)) - 200 AS mark)
SELECT request_id, r.game_pk, max_by(s.seq, (s.event, s.seq)) AS released_seq, max(s.event) AS released_event FROM r LEFT JOIN s ON s.game_pk = r.game_pk AND s.event <= r.t WHERE r.t <= (SELECT mark FROM m) GROUP BY 1, 2""", log=False)
def _j06s(t):
    """The same as a stream: requests whose release time the watermark has passed, answered by event-time timers."""
    d = delivery_stream(t)
    snaps = d.where("event is not null").select("game_pk", F.timestamp_seconds(c("event") + EPOCH).alias("at"), "seq")
    viewers = d.where("copy = 0 and k % 5 = 0").select("game_pk", c("event_id").alias("request_id"), F.timestamp_seconds(c("event_id") * 10 - 50 * (1 + c("k") % 3) + EPOCH).alias("at"))
    name, before = "spark.sql.streaming.stateStore.providerClass", t.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    t.spark.conf.set(name, release.PROVIDER)
    try:
        out = state.run_to_table(release.delayed_release_stream(snaps, viewers, "game_pk", "200 seconds"), t.spark)
    finally:
        t.spark.conf.set(name, before)
    return out.select("request_id", c("cluster").alias("game_pk"), "released_seq", F.expr(f"released_at div 1000 - {EPOCH}").alias("released_event"))


@query("j07_feed_lag", """
WITH w AS (SELECT date_trunc('hour', ts) AS start, count(*) AS n, avg(value) AS mean_lag, max(value) AS max_lag FROM events GROUP BY 1)
SELECT start, n, mean_lag, max_lag, CASE WHEN start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE THEN 'closed' ELSE 'open' END AS status FROM w UNION ALL SELECT NULL, 0, NULL, NULL, 'late'""", doubles=["mean_lag", "max_lag"], log=False)
def _j07(t):
    """Windows that the watermark closed, those still open at the end of the input, and the number of rows that came too late."""
    raw = log_io.snapshot_stream(t.spark, t.sf_dir, EVENT_SCHEMA, glob="events.parquet").withColumn("ts", c("ts").cast("timestamp"))
    out = views.lag_report(raw, t.events.withColumn("ts", c("ts").cast("timestamp")), "ts", "value", "1 hour", "10 minutes")
    return out.withColumn("start", c("start").cast("timestamp_ntz"))


@query("j08_recommendation_ledger", DELIVERY_CTE + """,
r AS (SELECT game_pk || ':' || (at_bat_number // 2) AS decision_id, seq, sha256((k % 3)::VARCHAR) AS sha FROM dl),
f AS (SELECT *, first_value(sha) OVER (PARTITION BY decision_id ORDER BY seq) AS fs, row_number() OVER (PARTITION BY decision_id ORDER BY seq) AS rn, row_number() OVER (PARTITION BY decision_id, sha ORDER BY seq) AS sn FROM r)
SELECT decision_id, seq, CASE WHEN rn = 1 THEN 'first' WHEN sha = fs THEN 'duplicate' ELSE 'conflict' END AS outcome, sha FROM f WHERE rn = 1 OR sha = fs OR sn = 1""", log=False)
def _j08(t):
    d = delivery_stream(t).select("game_pk", F.concat_ws(":", c("game_pk").cast("string"), F.expr("at_bat_number div 2").cast("string")).alias("decision_id"), "seq", F.sha2((c("k") % 3).cast("string"), 256).alias("sha"))
    return state.run_to_table(state.fold(d, ["decision_id"], "seq", state.ledger_step, state.LEDGER_SCHEMA, late="outcome", within=["game_pk"]), t.spark)


@query("j09_timeline_audit", DELIVERY_CTE + """,
s AS (SELECT game_pk, at_bat_number, pitch_number, copy AS snap, sha AS v, provider_id FROM dl)
SELECT game_pk, at_bat_number, pitch_number, min_by(v, snap) AS first_value, max_by(v, snap) AS last_value, max(CASE WHEN snap = 1 THEN v END) AS final_value, count(DISTINCT provider_id) AS providers, min_by(v, snap) <> max_by(v, snap) AS changed, count(DISTINCT provider_id) > 1 AS conflict, max(CASE WHEN snap = 1 THEN v END) IS NULL AS missing_from_final FROM s GROUP BY 1, 2, 3""", log=False)
def _j09(t):
    return views.timeline_audit(deliveries(t.events), KEY, "copy", "sha", "provider_id", 1)


@query("j10_stale_policy")
def _j10(t):
    """Refused deliveries by reason: stale snapshots, and quarantined revisions."""
    a = slots(t).groupBy(F.lit("snapshot").alias("kind"), c("outcome").alias("reason")).agg(F.count("*").alias("n"))
    return a.unionByName(ledger(t).groupBy(F.lit("revision").alias("kind"), F.coalesce("reason", "outcome").alias("reason")).agg(F.count("*").alias("n")))


@query("j11_label_snapshot")
def _j11(t):
    l = ledger(t)
    last = views.latest_accepted(l, KEY).select(*KEY, c("sha").alias("last_sha"), "revision", "first_received")
    return last.join(views.latest_accepted(l, KEY, first=True).select(*KEY, c("sha").alias("first_sha")), KEY)
