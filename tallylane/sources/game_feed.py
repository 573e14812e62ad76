"""Nested game feeds to one row per pitch, with the state of the game before it.

Runner movements are not listed in order of time but by runner, and some changes of runner are not listed at all, so
bases are tracked by base: a group of movements (one play index) clears each runner's first base and fills the last
one.  Each group so becomes a row that writes to some bases; the runner on a base before a pitch is the last
write before it in its half, found by a window.  Outs and scores are running sums over the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylane.keys import LogKeys

c = F.col

# --- Fixed values: the feed's call codes and the log's descriptions, batter events, and their names for bases ---
CALLS = {
    "B": "ball", "*B": "blocked_ball", "C": "called_strike", "S": "swinging_strike", "W": "swinging_strike_blocked",
    "T": "foul_tip", "F": "foul", "L": "foul_bunt", "M": "missed_bunt", "O": "bunt_foul_tip",
    "X": "hit_into_play", "D": "hit_into_play", "E": "hit_into_play", "Y": "hit_into_play", "J": "hit_into_play",
    "Z": "hit_into_play", "H": "hit_by_pitch", "P": "pitchout", "I": "intent_ball", "R": "foul_pitchout",
    "Q": "swinging_pitchout", "V": "automatic_ball", "VC": "automatic_ball", "VP": "automatic_ball",
    "VS": "automatic_ball", "VB": "automatic_ball", "A": "automatic_strike", "AC": "automatic_strike", "AB": "automatic_strike"}
BATTER_EVENTS = (
    "field_out", "strikeout", "force_out", "fielders_choice_out", "fielders_choice", "sac_fly", "sac_bunt",
    "grounded_into_double_play", "double_play", "sac_fly_double_play", "sac_bunt_double_play",
    "strikeout_double_play", "triple_play", "single", "double", "triple", "home_run", "walk", "intent_walk",
    "hit_by_pitch", "field_error", "catcher_interf")
BASES = ("1B", "2B", "3B")
SUBSTITUTION, AUTOMATIC_FROM = "pitching_substitution", 10
# ----------------------------------------------------------------------------

#: Runner id of the automatic runner, whom the feed does not list, and play index of movements without one: last in their play.
AUTOMATIC_RUNNER, LATE = -1, 1_000_000

SCHEMA = """gameData struct<game: struct<pk: bigint, type: string>, datetime: struct<officialDate: string>, players: map<string, struct<pitchHand: struct<code: string>>>>,
  liveData struct<plays: struct<allPlays: array<struct<
    about: struct<atBatIndex: bigint, inning: bigint, isTopInning: boolean, isComplete: boolean>,
    matchup: struct<pitcher: struct<id: bigint>, pitchHand: struct<code: string>, batter: struct<id: bigint>, batSide: struct<code: string>>,
    result: struct<eventType: string, description: string>,
    runners: array<struct<movement: struct<`start`: string, `end`: string, isOut: boolean>, details: struct<playIndex: bigint, runner: struct<id: bigint>>>>,
    playEvents: array<struct<`index`: bigint, isPitch: boolean, type: string, player: struct<id: bigint>, details: struct<eventType: string, call: struct<code: string>, type: struct<code: string>>,
      count: struct<balls: bigint, strikes: bigint>, pitchData: struct<startSpeed: double, extension: double, strikeZoneTop: double, strikeZoneBottom: double, coordinates: struct<pX: double, pZ: double>,
        breaks: struct<spinRate: double, spinDirection: double, breakHorizontal: double, breakVerticalInduced: double>>>>>>>>"""


def _plays(docs: DataFrame, keys: LogKeys, body: str) -> DataFrame:
    doc = docs.select(F.from_json(body, SCHEMA).alias("d")).select("d.gameData", "d.liveData")
    plays = doc.select(
        c("gameData.game.pk").alias(keys.cluster), c("gameData.game.type").alias("game_type"), c("gameData.datetime.officialDate").cast("date").alias(keys.date), c("gameData.players").alias("_players"),
        F.posexplode("liveData.plays.allPlays").alias("_play", "p"))
    plays = plays.withColumns({
        keys.episode: c("p.about.atBatIndex") + 1, keys.period: c("p.about.inning"), keys.side: F.when(c("p.about.isTopInning"), "Top").otherwise("Bot"),
        "_complete": F.coalesce("p.about.isComplete", F.lit(True)), "_matchup": c("p.matchup.pitcher.id")})
    # who ended the defence's play before: a clash of teams is impossible, as the batting side names the other one
    return plays.withColumn("_before", F.lag("_matchup").over(Window.partitionBy(keys.cluster, keys.side).orderBy("_play")))


def _movements(plays: DataFrame, keys: LogKeys) -> DataFrame:
    """One row for each group of movements: what it writes to the bases, its outs and runs."""
    where = [keys.cluster, "_play", keys.period, keys.side, "_index"]
    each = plays.select(keys.cluster, "_play", keys.period, keys.side, F.posexplode("p.runners").alias("_at", "r"))
    each = each.select(*where[:-1], F.coalesce("r.details.playIndex", F.lit(LATE)).alias("_index"), c("r.details.runner.id").alias("_runner"), "_at", c("r.movement.start").alias("_start"), c("r.movement.end").alias("_end"), F.coalesce("r.movement.isOut", F.lit(False)).alias("_out"))
    chain = each.groupBy(*where, "_runner").agg(F.min("_at").alias("_at"), F.min_by("_start", "_at").alias("_first"), F.max_by("_end", "_at").alias("_last"), F.bool_or("_out").alias("_gone"), F.count_if("_out").alias("_outs"))
    writes = [
        F.when(F.bool_or(F.coalesce((c("_first") == b) | (~c("_gone") & (c("_last") == b)), F.lit(False))), F.struct(F.max_by(F.when(~c("_gone") & (c("_last") == b), c("_runner")), F.when(~c("_gone") & (c("_last") == b), c("_at"))).alias("runner"))).alias(f"_w{i}")
        for i, b in enumerate(BASES, 1)]
    return chain.groupBy(*where).agg(*writes, F.sum("_outs").alias("_outs"), F.count_if(~c("_gone") & (c("_last") == "score")).alias("_runs"))


def _events(plays: DataFrame, keys: LogKeys) -> DataFrame:
    """Play events with the count before them, the pitch number and the actor; only pitches and automatic calls stay."""
    ev = plays.select("*", F.posexplode("p.playEvents").alias("_at", "e")).withColumns({
        "_index": F.coalesce("e.index", F.lit(0)), "_pitch": F.coalesce(c("e.isPitch"), F.lit(False)) | F.coalesce((c("e.type") == "no_pitch") & c("e.details.call.code").isNotNull(), F.lit(False)),
        "_sub": F.coalesce(c("e.details.eventType") == SUBSTITUTION, F.lit(False))})
    play = Window.partitionBy(keys.cluster, "_play").orderBy("_at")
    before, after, whole = play.rowsBetween(Window.unboundedPreceding, -1), play.rowsBetween(1, Window.unboundedFollowing), play.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ev = ev.withColumn("_later", F.coalesce(F.max(F.when(c("_sub"), c("_index"))).over(whole) > c("_index"), F.lit(False)))
    known = F.when(c("_sub"), c("e.player.id")).when(c("_pitch") & ~c("_later"), c("_matchup"))
    known = ev.withColumn("_known", known)
    return known.withColumns({
        keys.seq: F.sum(c("_pitch").cast("bigint")).over(play), "_final": F.coalesce(F.sum(c("_pitch").cast("bigint")).over(after), F.lit(0)) == 0,
        "balls": F.coalesce(F.last("e.count.balls", True).over(before), F.lit(0)), "strikes": F.coalesce(F.last("e.count.strikes", True).over(before), F.lit(0)),
        keys.actor: F.when(c("_later"), F.coalesce(F.last("_known", True).over(before), c("_before"), c("_matchup"))).otherwise(c("_matchup"))}).where("_pitch")


def flatten_game_feed(docs: DataFrame, keys: LogKeys, body: str = "body", effective_speed: bool = True) -> DataFrame:
    """One row per pitch or automatic call of every game document.

    Before it: count, outs and bases of the half, scores; behind it: scores up to the next row.  The actor is who was in the game
    at that pitch, also where another took over within the episode.  In regular games a half of the tenth period or later begins with a
    runner on second.  `effective_speed` takes the release speed in its place, else it is missing.  A game is one
    document and its rows one window, so it is bounded.
    """
    plays = _plays(docs, keys, body)
    pitches = _events(plays, keys)
    order = [keys.cluster, "_play", keys.period, keys.side, "_index"]
    none = {f"_w{i}": F.lit(None).cast("struct<runner: bigint>") for i in (1, 2, 3)} | {"_outs": F.lit(0).cast("long"), "_runs": F.lit(0).cast("long")}
    rows = pitches.select(*order, F.lit(0).alias("_kind"), keys.seq, *[v.alias(n) for n, v in none.items()])
    moves = _movements(plays, keys).select(*order, F.lit(1).alias("_kind"), F.lit(None).cast("long").alias(keys.seq), *none)
    both = rows.unionByName(moves)
    prior = (Window.unboundedPreceding, -1)
    half = Window.partitionBy(*keys.half).orderBy("_play", "_index", "_kind", keys.seq).rowsBetween(*prior)
    game = Window.partitionBy(keys.cluster).orderBy("_play", "_index", "_kind", keys.seq)

    def runs(side: str) -> Column:
        return F.when(c(keys.side) == side, c("_runs")).otherwise(0)

    state = both.withColumns({
        **{f"_b{i}": F.last(f"_w{i}", True).over(half) for i in (1, 2, 3)}, "outs_when_up": F.least(F.coalesce(F.sum("_outs").over(half), F.lit(0)), F.lit(3)),
        **{f"{name}_score": F.coalesce(F.sum(runs(side)).over(game.rowsBetween(*prior)), F.lit(0)) for name, side in (("home", "Bot"), ("away", "Top"))},
        **{f"_all_{name}": F.sum(runs(side)).over(Window.partitionBy(keys.cluster)) for name, side in (("home", "Bot"), ("away", "Top"))}})
    state = state.where("_kind = 0").withColumns({f"post_{name}_score": F.coalesce(F.lead(f"{name}_score").over(game), c(f"_all_{name}")) for name in ("home", "away")})
    x = pitches.join(state.select(keys.cluster, "_play", keys.seq, "_b1", "_b2", "_b3", "outs_when_up", "home_score", "away_score", "post_home_score", "post_away_score"), [keys.cluster, "_play", keys.seq])

    automatic = (c("game_type") == "R") & (c(keys.period) >= AUTOMATIC_FROM)
    on = {i: F.when(c(f"_b{i}").isNotNull(), c(f"_b{i}.runner")) for i in (1, 2, 3)}
    on[2] = F.when(c("_b2").isNotNull(), c("_b2.runner")).when(automatic, F.lit(AUTOMATIC_RUNNER).cast("long"))
    code, pitch = c("e.details.call.code"), "e.pitchData"
    last = c("_final") & c("_complete")
    described = F.coalesce(F.create_map(*[F.lit(v) for kv in CALLS.items() for v in kv])[code], F.concat(F.lit("unmapped:"), F.coalesce(code, F.lit("None"))))
    hand = F.when(c(keys.actor) == c("_matchup"), c("p.matchup.pitchHand.code")).otherwise(c("_players")[F.concat(F.lit("ID"), c(keys.actor))]["pitchHand"]["code"])
    x = x.withColumns({f"on_{i}b": on[i] for i in (1, 2, 3)})
    return x.select(
        *keys.event, keys.date, "game_type", keys.actor, c("p.matchup.batter.id").alias(keys.entity), hand.alias("p_throws"), c("p.matchup.batSide.code").alias("stand"), keys.period, keys.side,
        "balls", "strikes", "outs_when_up", "on_1b", "on_2b", "on_3b", sum((F.when(c(f"on_{i}b").isNotNull(), 1 << i - 1).otherwise(0) for i in (2, 3)), c("on_1b").isNotNull().cast("int")).alias("bases"),
        "home_score", "away_score", "post_home_score", "post_away_score", c("e.details.type.code").alias("pitch_type"), described.alias("description"), code.alias("call_code"),
        F.when(last, F.when(c("p.result.eventType").isin(*BATTER_EVENTS), c("p.result.eventType")).otherwise("truncated_pa")).alias("events"), F.when(last, c("p.result.description")).alias("des"),
        c(f"{pitch}.startSpeed").alias("release_speed"), c(f"{pitch}.extension").alias("release_extension"), (c(f"{pitch}.startSpeed") if effective_speed else F.lit(None).cast("double")).alias("effective_speed"),
        c(f"{pitch}.breaks.spinRate").alias("release_spin_rate"), c(f"{pitch}.breaks.spinDirection").alias("spin_axis"), (-c(f"{pitch}.breaks.breakHorizontal") / 12).alias("pfx_x"), (c(f"{pitch}.breaks.breakVerticalInduced") / 12).alias("pfx_z"),
        c(f"{pitch}.coordinates.pX").alias("plate_x"), c(f"{pitch}.coordinates.pZ").alias("plate_z"), c(f"{pitch}.strikeZoneTop").alias("sz_top"), c(f"{pitch}.strikeZoneBottom").alias("sz_bot"))
