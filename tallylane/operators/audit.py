"""Audits of episode structure: named reasons per row or per episode."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylane.functions import codes
from tallylane.keys import LogKeys
from tallylane.operators import ordered, prior
from tallylane.operators.lineage import dealt, materialise

c = F.col

# --- Fixed values -----------------------------------------------------------
SUPPORTED_EVENTS = ("field_out", "strikeout", "force_out", "fielders_choice_out", "sac_fly", "grounded_into_double_play", "double_play", "sac_fly_double_play",
                    "single", "double", "triple", "home_run", "walk", "hit_by_pitch")
STATE_COLUMNS = ("outs_when_up", "on_1b", "on_2b", "on_3b", "home_score", "away_score")
# ----------------------------------------------------------------------------


def simple_outcome() -> Column:
    """Label used by the support audit; in-play events map to their base result."""
    d, e = c("description"), c("events")
    hit = F.when(e.isin("field_out", "force_out", "fielders_choice_out", "sac_fly"), "out").when(e.isin("grounded_into_double_play", "double_play", "sac_fly_double_play"), "double_play").when(e.isin(*codes.HIT_EVENTS), e)
    return (F.when(d.isin("ball", "blocked_ball", "pitchout"), "ball").when(d.isin("called_strike", *codes.WHIFF, "foul_tip"), "strike").when(d == "foul", "foul").when(d == "hit_by_pitch", "hbp").when(d == "hit_into_play", hit))


def support_audit(log: DataFrame, keys: LogKeys) -> DataFrame:
    """One row per episode with a flag per reason, and `supported` when none is set.

    The log needs interval outs and a `complete` flag of its cluster.  All flags come from
    cluster windows and one aggregation per episode.
    """
    w, last = keys.in_cluster(), keys.seq
    bases = c("on_1b").isNotNull().cast("int") + 2 * c("on_2b").isNotNull().cast("int") + 4 * c("on_3b").isNotNull().cast("int")
    x = log.withColumns({"_y": simple_outcome(), "_bases": bases})
    nxt = {n: F.lead(n).over(w) for n in (keys.episode, "balls", "strikes", "outs_when_up", "_bases", "home_score", "away_score", keys.period, keys.side)}
    x = x.withColumns({f"_n_{n}": e for n, e in nxt.items()})
    same = c(f"_n_{keys.episode}") == c(keys.episode)
    b1 = c("balls") + (c("_y") == "ball").cast("int")
    s1 = c("strikes") + ((c("_y") == "strike") | ((c("_y") == "foul") & (c("strikes") < 2))).cast("int")
    ok_path = c("_y").isin("ball", "strike", "foul") & (c("_n_balls") == b1) & (c("_n_strikes") == s1)
    valid = (c("_y").isNotNull() & c("pitch_type").isNotNull() & c("plate_x").isNotNull() & c("plate_z").isNotNull() & (c("sz_top") > c("sz_bot")) & c("balls").between(0, 3) & c("strikes").between(0, 2))
    regular = (c("game_type") == "R") & c(keys.period).between(1, 9)
    tail = ["events", "_y", "balls", "strikes", "outs_when_up", "outs_recorded", "_bases", "home_score", "away_score", keys.period, keys.side, "post_home_score", "post_away_score"] + [f"_n_{n}" for n in nxt]

    # least and greatest value instead of distinct counts, which would multiply the rows by the columns counted
    def differs(col):
        return F.coalesce(F.min(col) != F.max(col), F.lit(False))

    def changed(col):
        return differs(col) | ((F.count(col) > 0) & (F.count(col) < F.count("*")))

    ep = x.groupBy(*keys.episode_key).agg(
        F.max_by(F.struct(*tail), last).alias("t"), F.min_by(F.struct("balls", "strikes"), last).alias("f"), F.max("complete").alias("_complete"),
        F.greatest(*[changed(s).cast("int") for s in STATE_COLUMNS]).alias("_state"), F.greatest(*[differs(s).cast("int") for s in (keys.actor, keys.entity)]).alias("_identity"),
        F.max((F.coalesce(same, F.lit(False)) & ~F.coalesce(ok_path, F.lit(False))).cast("int")).alias("_path"), F.min(F.coalesce(valid, F.lit(False)).cast("int")).alias("_valid"), F.min(regular.cast("int")).alias("_regular"))
    t = c("t")
    e, y = t["events"], t["_y"]
    terminal = F.coalesce(e != "truncated_pa", F.lit(False))
    seen = terminal & t["_n_outs_when_up"].isNotNull()
    top = t[keys.side] == "Top"
    base = t["_bases"]
    award = e.isin("walk", "hit_by_pitch")
    forced = base.bitwiseOR(1).bitwiseOR(F.when(base.bitwiseAND(1) == 1, 2).otherwise(0)).bitwiseOR(F.when(base.bitwiseAND(3) == 3, 4).otherwise(0))
    runs = F.when(award & (base == 7), 1).when(e == "home_run", F.bit_count(base) + 1).otherwise(0)
    outs = t["outs_when_up"] + (e == "strikeout").cast("int")
    ended = outs == 3
    period = t[keys.period] + (ended & ~top).cast("int")
    side = F.when(~ended, t[keys.side]).when(top, "Bot").otherwise("Top")
    to = F.when(ended, F.when(period >= 10, 2).otherwise(0)).when(award, forced).when(e == "home_run", 0).otherwise(base)
    matches = ((t["_n_outs_when_up"] == F.when(ended, 0).otherwise(outs)) & (t["_n__bases"] == to) & (t[f"_n_{keys.period}"] == period) & (t[f"_n_{keys.side}"] == side)
               & (t["_n_home_score"] == t["home_score"] + F.when(top, 0).otherwise(runs)) & (t["_n_away_score"] == t["away_score"] + F.when(top, runs).otherwise(0)))
    bad_label = (((e == "strikeout") & ~F.coalesce((y == "strike") & (t["strikes"] == 2), F.lit(False))) | ((e == "walk") & ~F.coalesce((y == "ball") & (t["balls"] == 3), F.lit(False)))
                 | ((y == "strike") & ~F.coalesce(e == "strikeout", F.lit(False))) | ((y == "ball") & ~F.coalesce(e == "walk", F.lit(False))))
    flags: Mapping[str, Column] = {
        "mid_episode_state_change": c("_state") == 1, "not_zero_count_start": ~((c("f.balls") == 0) & (c("f.strikes") == 0)), "unsupported_terminal_event": ~F.coalesce(e.isin(*SUPPORTED_EVENTS), F.lit(False)),
        "missing_or_unsupported_event": c("_valid") == 0, "identity_changes": c("_identity") == 1, "outside_regular_periods": c("_regular") == 0, "unobserved_terminal_transition": ~seen,
        "irregular_terminal_outs": ((e == "strikeout") & (t["outs_recorded"] != 1)) | ((y == "out") & (t["outs_recorded"] < 1)) | ((y == "double_play") & (t["outs_recorded"] != 2)),
        "inconsistent_terminal_label": bad_label, "breaks_deterministic_rule": e.isin("walk", "hit_by_pitch", "strikeout", "home_run") & ~(seen & F.coalesce(matches, F.lit(False))),
        "inconsistent_count_path": c("_path") == 1, "incomplete_cluster": ~F.coalesce(c("_complete"), F.lit(False)),
        "post_score_mismatch": seen & ((t["_n_home_score"] != t["post_home_score"]) | (t["_n_away_score"] != t["post_away_score"]))}
    out = ep.select(*keys.episode_key, *[F.coalesce(f, F.lit(False)).alias(n) for n, f in flags.items()])
    return out.withColumn("supported", ~F.exists(F.array(*list(flags)), lambda v: v))


REASONS = ("mid_episode_state_change", "not_zero_count_start", "unsupported_terminal_event", "missing_or_unsupported_event", "identity_changes", "outside_regular_periods", "unobserved_terminal_transition",
           "irregular_terminal_outs", "inconsistent_terminal_label", "breaks_deterministic_rule", "inconsistent_count_path", "incomplete_cluster", "post_score_mismatch")


def reason_counts(audit: DataFrame, reasons: Sequence[str]) -> DataFrame:
    return audit.agg(F.count("*").alias("episodes"), F.count_if("supported").alias("supported"), *[F.count_if(r).alias(r) for r in reasons])


# Terminal classes of recorded events, and the reasons of the trajectory audit.
EVENT_CLASS = {
    "field_out": "out", "force_out": "out", "fielders_choice_out": "out", "sac_fly": "out", "sac_bunt": "out", "other_out": "out", "out": "out",
    "grounded_into_double_play": "double_play", "double_play": "double_play", "sac_fly_double_play": "double_play", "single": "single", "double": "double", "triple": "triple",
    "home_run": "home_run", "walk": "walk", "intent_walk": "walk", "hit_by_pitch": "hbp", "hbp": "hbp", "strikeout": "strikeout"}
TRAJECTORY_REASONS = (
    "illegal_terminal_half_transition", "illegal_terminal_outs", "illegal_terminal_score", "invalid_count_or_action", "mid_pa_context_change", "missing_terminal_next_state",
    "nonconsecutive_pitch_sequence", "nonterminal_count_or_event_mismatch", "not_zero_count_start", "observed_action_outside_common_support", "post_score_next_state_mismatch",
    "source_unsupported_pa", "support_unavailable", "terminal_boundary_invalid", "terminal_label_mismatch", "unmapped_outcome")
CONTEXT = ("pitcher", "batter", "stand", "p_throws", "inning", "inning_topbot", "outs_when_up", "_bases", "home_score", "away_score")


def action_number(action: str, actions: Sequence[str]) -> Column:
    """Place of an action in the vocabulary, from 0; null outside."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in actions]), c(action)), F.lit(0).cast("long")) - 1


def support_masks(support: DataFrame, actor: str, action: str, actions: Sequence[str]) -> DataFrame:
    """Each actor's supported actions as a bit set, bit i for action i."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), action_number(action, actions).cast("int"))
    return support.groupBy(actor).agg(F.coalesce(F.bit_or(bit), F.lit(0).cast("long")).alias("mask"))


def trajectory_audit(log: DataFrame, masks: DataFrame, source: DataFrame, keys: LogKeys, action: str, actions: Sequence[str], partitions: int | None = None) -> DataFrame:
    """One row per episode: its terminal class, its length, whether it is kept as transitions, and all reasons against it.

    `masks` (support_masks) are the actions that a policy may be compared on, `source` the episodes' own support flag.
    Each reason is a condition on one event beside its neighbours in the episode and the cluster; one aggregation
    collects them.  A condition is asked only where those before it hold (label, then count and action, then
    the terminal, then what follows it).  Episodes meet their flag in `partitions`, if given.
    """
    w, cluster = keys.in_episode(), keys.in_cluster()
    label = codes.outcome10(c("description"), c("events"), c("strikes"))
    names = F.array(*[F.lit(x) for x in codes.OUTCOME10])
    rows = log.withColumns({
        "_y": label, "_i": F.row_number().over(w), "_last": F.lead(keys.seq).over(w).isNull(), "_nb": F.lead("balls").over(w), "_ns": F.lead("strikes").over(w),
        "_bases": sum((F.when(c(f"on_{i}b") > 0, 1 << i - 1).otherwise(0) for i in (2, 3)), F.when(c("on_1b") > 0, 1).otherwise(0)),
        **{f"_to_{x}": F.lead(x).over(cluster) for x in (keys.period, keys.side, "outs_when_up", "home_score", "away_score")}})
    # one row for each actor: sent to the tasks, as a join by actor would move the whole log to as many tasks as there are actors
    rows = rows.join(F.broadcast(masks), keys.actor, "left").withColumn("_a", action_number(action, actions).cast("int"))
    rows = rows.withColumn("_ok", F.expr("shiftright(mask, _a) & 1 = 1"))
    rows = rows.withColumn("_end", F.when((c("_y") == 0) & (c("balls") == 3), "walk").when((c("_y") == 1) & (c("strikes") == 2), "strikeout").when(c("_y") >= 3, F.get(names, c("_y").cast("int"))))
    rows = rows.withColumn("_named", codes.lookup(c("events"), EVENT_CLASS))

    known = c("_y") >= 0
    sound = known & c("balls").between(0, 3) & c("strikes").between(0, 2) & c("_a").isNotNull()
    agreed = sound & c("_last") & c("_end").isNotNull() & c("_end").eqNullSafe(c("_named"))
    seen = agreed & c(f"_to_{keys.period}").isNotNull()
    top = c(keys.side) == "Top"
    same = (c(f"_to_{keys.period}") == c(keys.period)) & (c(f"_to_{keys.side}") == c(keys.side))
    flip = (top & (c(f"_to_{keys.period}") == c(keys.period)) & (c(f"_to_{keys.side}") == "Bot")) | (~top & (c(f"_to_{keys.period}") == c(keys.period) + 1) & (c(f"_to_{keys.side}") == "Top"))
    moved = seen & (same | (flip & (c("_to_outs_when_up") == 0)))
    outs = F.when(same, c("_to_outs_when_up") - c("outs_when_up")).otherwise(3 - c("outs_when_up"))
    fixed_outs = F.when(c("_end").isin("out", "strikeout"), 1).when(c("_end") == "double_play", 2)
    counted = moved & outs.between(0, 3 - c("outs_when_up")) & F.coalesce(outs == fixed_outs, F.lit(True))
    home, away = c("_to_home_score") - c("home_score"), c("_to_away_score") - c("away_score")
    scored = counted & (F.least(home, away) >= 0) & (F.greatest(home, away) <= 4) & (F.when(top, home).otherwise(away) == 0)
    terminal = F.coalesce(c("events") != "truncated_pa", F.lit(False))
    against = {
        "nonconsecutive_pitch_sequence": c(keys.seq) != c("_i"), "not_zero_count_start": (c("_i") == 1) & ((c("balls") != 0) | (c("strikes") != 0)),
        "terminal_boundary_invalid": terminal != c("_last"), "unmapped_outcome": ~known, "invalid_count_or_action": known & ~sound,
        "observed_action_outside_common_support": sound & ~c("_ok"), "support_unavailable": sound & c("mask").isNull(),
        "nonterminal_count_or_event_mismatch": sound & ~c("_last") & (c("_end").isNotNull() | (c("_nb") != c("balls") + (c("_y") == 0).cast("int")) | (c("_ns") != F.least(F.lit(2), c("strikes") + c("_y").isin(1, 2).cast("int")))),
        "terminal_label_mismatch": sound & c("_last") & ~agreed, "missing_terminal_next_state": agreed & ~seen, "illegal_terminal_half_transition": seen & ~moved,
        "illegal_terminal_outs": moved & ~counted, "illegal_terminal_score": counted & ~scored,
        "post_score_next_state_mismatch": scored & ((c("post_home_score") != c("_to_home_score")) | (c("post_away_score") != c("_to_away_score")))}
    change = [F.count(x) < F.count("*") for x in CONTEXT] + [F.min(x) != F.max(x) for x in CONTEXT]
    ep = rows.groupBy(*keys.episode_key).agg(
        F.min_by(keys.actor, "_i").alias(keys.actor), F.coalesce(F.max_by("_named", "_i"), F.lit("unknown")).alias("terminal_class"), F.count("*").alias("n_events"),
        F.coalesce(reduce(lambda a, b: a | b, change), F.lit(False)).alias("mid_pa_context_change"), *[F.coalesce(F.bool_or(x), F.lit(False)).alias(name) for name, x in against.items()])
    flag = dealt(source.select(*keys.episode_key, "supported"), keys.episode_key, partitions)
    ep = dealt(ep, keys.episode_key, partitions).join(flag, keys.episode_key, "left").withColumn("source_unsupported_pa", ~F.coalesce("supported", F.lit(False)))
    reasons = F.array_compact(F.array(*[F.when(c(name), F.lit(name)) for name in TRAJECTORY_REASONS]))
    return ep.select(*keys.episode_key, keys.actor, "terminal_class", "n_events", (F.size(reasons) == 0).alias("retained"), F.array_join(reasons, "|").alias("reasons"))


def transitions(log: DataFrame, audit: DataFrame, masks: DataFrame, keys: LogKeys, action: str, actions: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Events of retained episodes (trajectory_audit) with position, action number, support masks here and at the next event (0 at
    the end), next sequence number, done flag, and the terminal class where done.  `partitions` as for the audit.
    """
    kept = dealt(log, keys.episode_key, partitions).join(audit.where("retained").select(*keys.episode_key, "terminal_class"), keys.episode_key).join(F.broadcast(masks), keys.actor)
    w = keys.in_episode()
    nxt = F.lead(keys.seq).over(w)
    return kept.select(
        *keys.event, c(action).alias("action"), action_number(action, actions).alias("action_number"), "mask", F.coalesce(F.lead("mask").over(w), F.lit(0)).alias("next_mask"),
        F.row_number().over(w).alias("position"), F.coalesce(nxt, F.lit(-1)).alias("next_seq"), nxt.isNull().alias("done"), F.when(nxt.isNull(), c("terminal_class")).alias("terminal_event"))


def _first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first condition that holds (or is unknown), else null."""
    return F.coalesce(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in rules])


def row_fates(raw: DataFrame, early: Sequence[tuple[str, Column]], repeated: tuple[str, str, Sequence[str], Sequence[str], Sequence[str]], late: Sequence[tuple[str, Column]]) -> DataFrame:
    """First matching reason of an ordered list, else `accepted`.

    Between the early and the late reasons, rows that repeat a key get a name of `repeated` (identical, conflicting, key,
    order, content): the first where all rows of the key have equal content, except for the first row by `order`; the
    second, on every row of the key, where contents differ, as no rule says which to keep (a census cap of 0 stops there).
    Only rows without an early reason count, so that an excluded row cannot displace a good one.  Keys are summed before
    they meet the rows again, so a key with many rows is not gathered in one task.
    """
    identical, conflicting, key, order, content = repeated
    live = raw.withColumn("_early", _first_reason(early))
    body, at = F.struct(*content), F.struct(*order)
    again = live.where("_early is null").groupBy(*key).agg(F.count("*").alias("_rows"), F.min(at).alias("_first"), F.min(body).alias("_low"), F.max(body).alias("_high"))
    again = again.where("_rows > 1").select(*[c(k).alias(f"_key{i}") for i, k in enumerate(key)], "_first", (~c("_low").eqNullSafe(c("_high"))).alias("_differ"))
    same = reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"_key{i}")) for i, k in enumerate(key)]) & c("_early").isNull()
    fate = F.coalesce(c("_early"), F.when(c("_differ"), F.lit(conflicting)).when(~at.eqNullSafe(c("_first")) & c("_differ").isNotNull(), F.lit(identical)), _first_reason(late), F.lit("accepted"))
    return live.join(again, same, "left").withColumn("fate", fate).drop("_early", "_first", "_differ", *[f"_key{i}" for i in range(len(key))])


def fate_census(fates: DataFrame, caps: Mapping[str, float], outside: Sequence[str]) -> DataFrame:
    """Rows per fate, their share of all rows that have none of the fates `outside`, and a stop flag where a share exceeds its cap."""
    per = fates.groupBy("fate").agg(F.count("*").alias("n"))
    total = per.agg(F.coalesce(F.sum(F.when(~c("fate").isin(*outside), c("n"))), F.lit(0)).alias("denominator"))
    cap = F.coalesce(*[F.when(c("fate") == name, F.lit(share)) for name, share in caps.items()])
    stop = F.coalesce(c("n") > cap * F.greatest(c("denominator"), F.lit(1)), F.lit(False))
    return per.join(F.broadcast(total)).withColumn("share", c("n") / c("denominator")).withColumn("stop", stop)


def select_episodes(log: DataFrame, audit: DataFrame, keys: LogKeys, cohort: DataFrame, max_clusters: int, kinds: Sequence[str], kind: str = "pitch_type",
                    days: int = 90, least: int = 20, low: str = "sz_bot", high: str = "sz_top") -> DataFrame:
    """Every pair of an episode and an actor in it, with its reasons (`|`-joined) and the first reason for not being selected.

    An episode of the cohort is supported where the audit has no reason against it, its actor has kinds seen `least` times
    in the `days` days before (`repertoire`), and the prior medians of `low` and `high` of its first entity (else of all
    entities) are known and in order.  Selected are the supported episodes of an actor's first `max_clusters` clusters by date
    that have any.  Priors see strictly earlier dates of the whole log, before any selection.
    """
    first = F.min_by(F.struct(keys.entity, keys.date), keys.seq)
    ep = log.groupBy(*keys.episode_key).agg(first.alias("_start"), F.count("*").alias("n_events"), F.collect_set(keys.actor).alias("_actors"))  # the actors of one episode
    # read by several branches; as tables of one row for each episode they keep the plans of the branches apart
    ep = materialise(ep.select(*keys.episode_key, "n_events", "_start.*", F.explode("_actors").alias(keys.actor)))
    x = ep.join(audit, keys.episode_key).join(cohort.select(keys.actor).distinct().withColumn("_in", F.lit(True)), keys.actor, "left")
    x = x.join(prior.recent_repertoire(log, ep, keys.actor, keys.date, kind, kinds, days, least), [keys.actor, keys.date], "left")
    x = x.join(prior.prior_bounds(log, ep, keys.entity, keys.date, [low, high]), [keys.entity, keys.date], "left")
    bottom, top = c(f"prior_{low}"), c(f"prior_{high}")
    extra = {"no_supported_prior_repertoire": F.coalesce("repertoire", F.lit("")) == "", "missing_prior_zone_bounds": ~F.coalesce(top > bottom, F.lit(False))}
    against = F.array_compact(F.array(*[F.when(c(r), F.lit(r)) for r in REASONS], *[F.when(cond, F.lit(name)) for name, cond in extra.items()]))
    x = materialise(x.select(*ep.columns, "_in", "repertoire", bottom, top, against.alias("_against")))
    # rank clusters per actor on the small distinct table, not on episodes
    able = x.where(c("_in") & (F.size("_against") == 0)).select(keys.actor, keys.date, keys.cluster).distinct()
    rank = able.withColumn("_k", F.row_number().over(Window.partitionBy(keys.actor).orderBy(keys.date, keys.cluster))).select(keys.actor, keys.cluster, "_k")
    x = x.join(rank, [keys.actor, keys.cluster], "left")
    reason = F.when(c("_in").isNull(), "not_in_cohort").when(F.size("_against") > 0, F.get("_against", F.lit(0))).when(c("_k") > max_clusters, "beyond_cluster_limit").otherwise("selected")
    return x.select(*keys.episode_key, keys.actor, "n_events", reason.alias("reason"), F.array_join("_against", "|").alias("reasons"), F.coalesce("repertoire", F.lit("")).alias("repertoire"), bottom.alias("zone_bottom"), top.alias("zone_top"))


def selection_coverage(selection: DataFrame, keys: LogKeys) -> DataFrame:
    """Per cohort actor: clusters, episodes and supported episodes, and those of the selected clusters."""
    per = selection.where("reason <> 'not_in_cohort'").groupBy(keys.actor, keys.cluster).agg(
        F.count("*").alias("n"), F.count_if(c("reasons") == "").alias("ok"), F.bool_or(c("reason") == "selected").alias("taken"))
    taken = {n: F.coalesce(F.sum(F.when(c("taken"), c(x))), F.lit(0)).alias(n) for n, x in (("selected_episodes", "n"), ("selected_supported", "ok"))}
    return per.groupBy(keys.actor).agg(F.count("*").alias("clusters"), F.sum("n").alias("episodes"), F.sum("ok").alias("supported"), F.count_if("taken").alias("selected_clusters"), *taken.values())
