"""Terminal rewards: expectation of a continuation value over an empirical successor distribution.

A successor is where the game stands after an episode's terminal event.  Observed successors of the same (event, bases,
outs) carry their share of the cell, a rule-based successor the prior's; the state's period, side and
score then follow by the rules of the game.  All of it is column arithmetic over distinct (state, event) pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylane.functions import features
from tallylane.operators.lineage import dealt, materialise

c = F.col
STATE = ("inning", "inning_topbot", "outs_when_up", "bases", "home_score", "away_score")

# --- Fixed values: last regular period, base taken by the automatic runner (second) after it, bases a hit is worth ---
REGULAR, AUTOMATIC_RUNNER = 9, 2
HIT_BASES = {"single": 1, "double": 2, "triple": 3, "home_run": 4}
# ----------------------------------------------------------------------------


def rule_successor(event: Column, bases: Column, outs: Column) -> dict[str, Column]:
    """Outs, bases after and runs by rule: hits move all runners by their own bases, outs hold them, walks push.

    A double play takes the runner from first, if there is one and fewer than two outs; else it is an ordinary out.
    """
    moved = {name: F.shiftleft(bases, n).bitwiseOR(1 << n - 1) for name, n in HIT_BASES.items()}
    pushed = bases.bitwiseOR(1).bitwiseOR(F.when(bases.bitwiseAND(1) == 1, 2).otherwise(0)).bitwiseOR(F.when(bases.bitwiseAND(3) == 3, 4).otherwise(0))
    walk, double_play = event.isin("walk", "hbp"), (event == "double_play") & (outs < 2) & (bases.bitwiseAND(1) == 1)
    hit = F.coalesce(*[F.when(event == name, to) for name, to in moved.items()])
    return {
        "out_delta": F.when(double_play, 2).when(event.isin("out", "strikeout", "double_play"), 1).otherwise(0),
        "to_bases": F.when(walk, pushed).when(double_play, bases.bitwiseAND(6)).when(hit.isNotNull(), hit.bitwiseAND(7)).otherwise(bases),
        "adv_runs": F.when(walk, (bases == 7).cast("int")).when(hit.isNotNull(), F.bit_count(F.shiftright(hit, 3))).otherwise(0)}


def advance(df: DataFrame) -> DataFrame:
    """Columns of STATE (as next_*) and `winner` (home, away or null) after out_delta, to_bases and adv_runs.

    A third out changes sides; from the tenth period on a side starts with a runner on second.  The home side wins at once when it
    leads in its half of the ninth period or later (only a home run counts all its runs), or when it leads after the other's half;
    the away side when it leads after a whole such period.
    """
    top, late = c("inning_topbot") == "Top", c("inning") >= REGULAR
    home = c("home_score") + F.when(top, 0).otherwise(c("adv_runs"))
    away = c("away_score") + F.when(top, c("adv_runs")).otherwise(0)
    outs = c("outs_when_up") + c("out_delta")
    walkoff = ~top & late & (home > away)
    over = ~walkoff & (outs >= 3)
    decided = over & late & F.when(top, home > away).otherwise(away > home)
    turned = over & ~decided
    period = c("inning") + (turned & ~top).cast("int")
    return df.withColumns({
        "next_inning": period, "next_inning_topbot": F.when(~turned, c("inning_topbot")).when(top, "Bot").otherwise("Top"),
        "next_outs_when_up": F.when(turned, 0).otherwise(F.least(outs, F.lit(2))),
        "next_bases": F.when(turned, F.when(period > REGULAR, AUTOMATIC_RUNNER).otherwise(0)).when(decided, 0).otherwise(c("to_bases")),
        "next_home_score": F.when(walkoff & (c("event") != "home_run"), F.least(home, away + 1)).otherwise(home), "next_away_score": away,
        "winner": F.when(walkoff | (decided & top), "home").when(decided, "away")})


def successors(pairs: DataFrame, shares: DataFrame, prior: float) -> DataFrame:
    """Distinct successors of (state, event) pairs with their probability.

    `shares` has event, bases, outs_when_up, out_delta, to_bases, adv_runs, n and cell: at most a few thousand rows, as
    bases, outs and runs are bounded.  The rule's successor has `prior` pseudo-observations beside a cell, and is certain without one.
    """
    cells = shares.select("event", "bases", "outs_when_up", "cell").distinct()
    by_rule = pairs.join(F.broadcast(cells), ["event", "bases", "outs_when_up"], "left").withColumn("weight", F.coalesce(prior / (c("cell") + prior), F.lit(1.0))).drop("cell")
    by_rule = by_rule.withColumns(rule_successor(c("event"), c("bases"), c("outs_when_up")))
    seen = pairs.join(F.broadcast(shares), ["event", "bases", "outs_when_up"]).withColumn("weight", c("n") / (c("cell") + prior)).drop("n", "cell")
    out = advance(seen.unionByName(by_rule.where("weight > 0").select(*seen.columns)))
    return out.groupBy(*STATE, "event", *[f"next_{x}" for x in STATE], "winner").agg(F.sum("weight").alias("probability"))


def terminal_rewards(episodes: DataFrame, shares: DataFrame, home_value: Column, by: Sequence[str], prior: float = 5.0, partitions: int | None = None) -> DataFrame:
    """Columns `by`, event and reward: the expected value for the side that defends at the episode's start.

    `episodes` has STATE and event; `home_value` is an expression over a successor's STATE columns.  Each distinct
    (state, event) is valued once.  Episodes meet their values in `partitions`, if given: without it, the tasks that sum over
    successors also sort and join, and each of these steps holds memory of its own.
    """
    episodes = materialise(episodes)  # read for the pairs and for the rows
    pairs = episodes.select(*STATE, "event").distinct()
    found = successors(pairs, shares, prior)
    after = found.select(*[c(x).alias(f"_{x}") for x in STATE], "event", "winner", "probability", *[c(f"next_{x}").alias(x) for x in STATE])
    p_home = F.when(c("winner").isNull(), home_value).otherwise((c("winner") == "home").cast("double"))
    value = F.when(c("_inning_topbot") == "Top", p_home).otherwise(1 - p_home)
    valued = after.withColumn("_v", c("probability") * value).groupBy(*[f"_{x}" for x in STATE], "event").agg(F.sum("_v").alias("reward"))
    on = [*STATE, "event"]
    valued = dealt(valued.withColumnsRenamed({f"_{x}": x for x in STATE}), on, partitions)
    return dealt(episodes, on, partitions).join(valued, on).select(*by, "event", "reward")


def fitted_value(coefficients: Sequence[float], intercept: float, names: Sequence[str]) -> Column:
    """Home side's probability to win by a fitted logistic model over `winner_design`, as an expression over STATE columns."""
    design = features.winner_design(lambda i: c("bases").bitwiseAND(1 << i) > 0)
    terms = [design[name] * float(x) for name, x in zip(names, coefficients, strict=True)]
    return 1 / (1 + F.exp(-(sum(terms, F.lit(float(intercept))))))
