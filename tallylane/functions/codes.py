"""Code vocabularies and the label expressions built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
GROUP_NAMES = ("FF", "SI", "FC", "SL", "ST", "CU", "CH", "FS", "OT")
CODE_GROUPS = {
    "FF": 0, "FA": 0, "SI": 1, "FC": 2, "SL": 3, "SV": 3, "ST": 4, "CU": 5, "KC": 5, "CS": 5,
    "CH": 6, "FS": 7, "FO": 7, "KN": 8, "SC": 8, "EP": 8,
}
OUTCOME11 = ("ball", "strike", "foul", "K", "BB", "HBP", "1B", "2B", "3B", "HR", "in_play_out")
OUTCOME10 = ("ball", "strike", "foul", "out", "single", "double", "triple", "home_run", "hbp", "double_play")
BALL_DESCRIPTIONS = ("ball", "blocked_ball", "automatic_ball", "intent_ball", "pitchout")
STRIKE_DESCRIPTIONS = ("called_strike", "swinging_strike", "swinging_strike_blocked", "foul_tip", "bunt_foul_tip", "missed_bunt", "automatic_strike")
FOUL_DESCRIPTIONS = ("foul", "foul_bunt", "foul_pitchout")
K_EVENTS = ("strikeout", "strikeout_double_play")
BB_EVENTS = ("walk", "intent_walk")
HIT_EVENTS = ("single", "double", "triple", "home_run")
BALL10 = ("ball", "blocked_ball", "pitchout", "intent_ball")
STRIKE10 = ("called_strike", "swinging_strike", "swinging_strike_blocked", "missed_bunt", "foul_tip", "bunt_foul_tip")
OUT10 = ("field_out", "force_out", "fielders_choice_out", "sac_fly", "sac_bunt")
DOUBLE_PLAY10 = ("double_play", "grounded_into_double_play", "sac_fly_double_play", "sac_bunt_double_play")
SWING = ("swinging_strike", "swinging_strike_blocked", "foul", "foul_tip", "hit_into_play", "missed_bunt", "foul_bunt", "bunt_foul_tip")
CONTACT = ("foul", "foul_tip", "hit_into_play", "foul_bunt", "bunt_foul_tip")
WHIFF = ("swinging_strike", "swinging_strike_blocked")
BATTED_TYPES = ("ground_ball", "line_drive", "fly_ball", "popup")
MISSING_BATTED = ("None", "nan", "")
AUTOMATIC = ("automatic_ball", "automatic_strike")
UNUSUAL = ("swinging_pitchout", "foul_pitchout")
LEAF_DESCRIPTIONS = (
    ("ball", "blocked_ball", "pitchout", "intent_ball"),
    ("foul",),
    ("hit_by_pitch",),
    ("swinging_strike", "swinging_strike_blocked"),
    ("called_strike", "foul_tip", "bunt_foul_tip", "missed_bunt"),
)
CORE_IN_PLAY_EVENTS = HIT_EVENTS + OUT10 + DOUBLE_PLAY10
EVENT_OUTS = {
    "field_out": 1, "strikeout": 1, "force_out": 1, "fielders_choice_out": 1, "sac_fly": 1, "sac_bunt": 1,
    "grounded_into_double_play": 2, "double_play": 2, "strikeout_double_play": 2, "sac_fly_double_play": 2,
    "triple_play": 3,
}
# ----------------------------------------------------------------------------


def lookup(code: Column, table: dict, default=None) -> Column:
    """Literal map lookup; codes outside the table give `default`."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(entries, code)
    return found if default is None else F.coalesce(found, F.lit(default))


def group_id(code: Column) -> Column:
    """Code to group id; excluded, unknown or null codes give -1."""
    return F.when(code.isNull(), -1).otherwise(lookup(code, CODE_GROUPS, -1)).cast("bigint")


def outcome11(description: Column, event: Column) -> Column:
    """Eleven-class outcome; terminal events win over the description; unknown is -1."""
    hit = F.when(event == "single", 6).when(event == "double", 7).when(event == "triple", 8).when(event == "home_run", 9).otherwise(10)
    return (
        F.when(event.isin(*K_EVENTS), 3)
        .when(event.isin(*BB_EVENTS), 4)
        .when(description == "hit_by_pitch", 5)
        .when(description == "hit_into_play", hit)
        .when(description.isin(*BALL_DESCRIPTIONS), 0)
        .when(description.isin(*STRIKE_DESCRIPTIONS), 1)
        .when(description.isin(*FOUL_DESCRIPTIONS), 2)
        .otherwise(-1)
        .cast("bigint")
    )


def outcome10(description: Column, event: Column, strikes: Column) -> Column:
    """Ten-class outcome; -1 when the row has no label."""
    in_play = F.when(event.isin(*OUT10), 3).when(event.isin(*DOUBLE_PLAY10), 9)
    for i, name in enumerate(HIT_EVENTS):
        in_play = in_play.when(event == name, 4 + i)
    return (
        F.when(description.isin(*BALL10), 0)
        .when(description.isin(*STRIKE10) | ((description == "foul_bunt") & (strikes == 2)), 1)
        .when(description.isin("foul", "foul_bunt"), 2)
        .when(description == "hit_by_pitch", 8)
        .when(description == "hit_into_play", in_play.otherwise(-1))
        .otherwise(-1)
        .cast("bigint")
    )


def held_reason(description: Column, event: Column, strikes: Column) -> Column:
    """Why a row has no ten-class label; null when it has one."""
    return F.when(
        outcome10(description, event, strikes) < 0,
        F.when(description == "hit_into_play", F.when(F.coalesce(event, F.lit("")) == "", "hit_into_play_events_null").otherwise("hit_into_play_events_unmapped"))
        .when(F.coalesce(description, F.lit("")) == "", "description_null")
        .otherwise("description_unmapped"),
    )


def leaf7(description: Column, event: Column, strikes: Column, batted: Column) -> Column:
    """Seven coherent leaves from the ten-class label and the two binary heads; -1 without a label."""
    y = outcome10(description, event, strikes)
    return (
        F.when(y == 0, 0).when(y == 2, 1).when(y == 8, 2)
        .when(y == 1, F.when(description.isin(*WHIFF), 3).otherwise(4))
        .when(y >= 3, F.when(F.coalesce(batted, F.lit("None")) == "ground_ball", 5).otherwise(6))
        .otherwise(-1)
        .cast("bigint")
    )


def row_fate(description: Column, event: Column, strikes: Column, batted: Column, tracked: Column) -> Column:
    """Exactly one fate per row, highest-priority rule first."""
    d, e = F.coalesce(description, F.lit("")), F.coalesce(event, F.lit(""))
    b = F.coalesce(batted, F.lit("None"))
    missing, known = b.isin(*MISSING_BATTED), b.isin(*BATTED_TYPES)
    in_play, core, ground = d == "hit_into_play", e.isin(*CORE_IN_PLAY_EVENTS), b == "ground_ball"
    leaf = F.when(d == "foul_bunt", F.when(strikes == 2, 4).otherwise(1))
    for i, names in enumerate(LEAF_DESCRIPTIONS):
        leaf = leaf.when(d.isin(*names), i)
    return (
        F.when(in_play & (e == "catcher_interf"), "ABSTAIN_BIP_CATCHER_INTERF")
        .when(in_play & missing, "ABSTAIN_BIP_MISSING_BB_TYPE")
        .when(in_play & ~known, "ABSTAIN_BIP_UNREGISTERED_BB_TYPE")
        .when(in_play & core, F.when(ground, "LEAF5").otherwise("LEAF6"))
        .when(in_play, F.when(ground, "HYPOTHESIS_LEAF5_GB_BIP_OUTCOME_DEPENDENT").otherwise("HYPOTHESIS_LEAF6_NONGB_BIP_OUTCOME_DEPENDENT"))
        .when(leaf.isNotNull(), F.when(missing, F.concat(F.lit("LEAF"), leaf.cast("string"))).otherwise("ABSTAIN_NONBIP_WITH_BB_TYPE"))
        .when(d.isin(*UNUSUAL), "ABSTAIN_UNUSUAL_PITCHOUT")
        .when(d.isin(*AUTOMATIC), F.when(tracked, "ABSTAIN_AUTOMATIC_WITH_TRACKING").otherwise("NOT_A_PITCH_AUTOMATIC"))
        .otherwise("ABSTAIN_UNKNOWN_DESCRIPTION")
    )


def implied_outs(event: Column) -> Column:
    return F.when(event.isNull(), 0).otherwise(lookup(event, EVENT_OUTS, 0)).cast("bigint")
