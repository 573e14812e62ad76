"""Encoders that need more than one row, and column groups built from several encoders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylane.functions import codes, probs, states
from tallylane.keys import LogKeys

c = F.col
SHARE_EPSILON = 1e-9


def add_ids(log: DataFrame, keys: LogKeys) -> DataFrame:
    """Attach type, location, action, outcome, count, base/out and state ids."""
    first = log.withColumns({
        "pitch_id": codes.group_id(c("pitch_type")),
        "loc_id": states.loc_id(c("plate_x"), states.z_norm(c("plate_z"), c("sz_bot"), c("sz_top"))),
        "outcome_id": codes.outcome11(c("description"), c("events")),
        "y10": codes.outcome10(c("description"), c("events"), c("strikes")),
        "count_id": states.count_id(c("balls"), c("strikes")),
        "base_out_id": states.base_out_id(c("outs_when_up"), c("on_1b"), c("on_2b"), c("on_3b")),
    })
    return first.withColumns({
        "action_id": states.action_id(c("pitch_id"), c("loc_id")),
        "terminal": c("outcome_id") >= 3,
        "state_id": c("count_id") * states.N_BASE_OUT + c("base_out_id"),
    })


def previous_context(log: DataFrame, keys: LogKeys, kind: str, output: str = "context_id") -> DataFrame:
    """Context of the previous action of the same episode; 0 for the first event."""
    w = keys.in_episode()
    return log.withColumn(output, states.action_context(F.lag("pitch_id").over(w), F.lag("loc_id").over(w), kind))


def date_split(df: DataFrame, date: str, bounds: Sequence[tuple[str, str]], default: str, output: str = "split") -> DataFrame:
    """Label rows by the first inclusive upper date they do not exceed."""
    expr = None
    for name, last in bounds:
        cond = c(date) <= F.lit(last).cast("date")
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return df.withColumn(output, expr.otherwise(default))


def role_masks(df: DataFrame, date: str, roles: Mapping[str, tuple[str, str]], held_out: Column, evaluation: str = "EVAL") -> DataFrame:
    """One role per row by date range; held-out actors only enter the evaluation role."""
    spans = sorted(roles.values())
    if any(a[1] >= b[0] for a, b in zip(spans, spans[1:])):
        raise ValueError("overlapping data roles")
    expr = None
    for name, (lo, hi) in roles.items():
        cond = c(date).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")) & (held_out if name == evaluation else ~held_out)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return df.withColumn("role", expr)


def rolling_folds(df: DataFrame, date: str, folds: Mapping[str, Sequence[tuple[str, str]]]) -> DataFrame:
    """Repeat every row once per rolling-origin fold it belongs to; rows after a fold's end drop out of it."""
    entries = []
    for name, parts in folds.items():
        part = None
        for label, last in parts:
            cond = c(date) <= F.lit(last).cast("date")
            part = F.when(cond, label) if part is None else part.when(cond, label)
        entries.append(F.struct(F.lit(name).alias("fold"), part.alias("part")))
    out = df.withColumn("_f", F.explode(F.array(*entries)))
    return out.withColumns({"fold": c("_f.fold"), "part": c("_f.part")}).drop("_f").where("part is not null")


def eligibility_flags(supported: Column) -> dict[str, Column]:
    """Seven exclusion reasons, in bit order."""
    return {
        "unmapped_outcome": codes.outcome10(c("description"), c("events"), c("strikes")) < 0,
        "unsupported_episode": ~F.coalesce(supported, F.lit(False)),
        "missing_type": c("pitch_type").isNull(),
        "missing_plate_x": c("plate_x").isNull(),
        "missing_plate_z": c("plate_z").isNull(),
        "invalid_balls": ~F.coalesce(c("balls").between(0, 3), F.lit(False)),
        "invalid_strikes": ~F.coalesce(c("strikes").between(0, 2), F.lit(False)),
    }


def reason_bits(df: DataFrame, flags: Mapping[str, Column], output: str = "reason_bits") -> DataFrame:
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags.values())), F.lit(0))
    return df.withColumn(output, bits.cast("bigint"))


def action_shares(df: DataFrame, by: Sequence[str], action: str) -> DataFrame:
    """Observed share of every action inside a group."""
    n = df.groupBy(*by, action).agg(F.count("*").alias("n"))
    return n.withColumn("pi", c("n") / F.sum("n").over(Window.partitionBy(*by))).drop("n")


def coarse_mass(policy: DataFrame, by: Sequence[str], action: str = "action_id", prob: str = "pi") -> DataFrame:
    """Mass of the coarse group each action belongs to."""
    out = policy.withColumn("coarse", states.coarse_group(c(action)))
    return out.withColumn("coarse_mass", F.sum(prob).over(Window.partitionBy(*by, "coarse")))


def snap_lookup(log: DataFrame, table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Value of the cell a continuous location falls in."""
    return log.join(table, [*by, "action_id"], "left")


def count_vectors(df: DataFrame, by: Sequence[str], label: str, n_classes: int, pseudo: float = 0.0) -> DataFrame:
    """Per group the class counts as an array (plus pseudo-counts), normalised; `n` is the raw total."""
    counts = df.groupBy(*by).agg(*[F.count(F.when(c(label) == i, 1)).cast("double").alias(f"_n{i}") for i in range(n_classes)])
    n = sum((c(f"_n{i}") for i in range(1, n_classes)), c("_n0"))
    return counts.select(*by, n.cast("bigint").alias("n"), F.array(*[(c(f"_n{i}") + pseudo) / (n + pseudo * n_classes) for i in range(n_classes)]).alias("p"))


def outcome_vectors(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ten-class distribution with the two conditional head rates, for labelled rows."""
    lab = df.where("y >= 0")
    rates = lab.groupBy(*by).agg(
        F.avg(F.when(c("y") == 1, c("description").isin(*codes.WHIFF).cast("double"))).alias("whiff"),
        F.avg(F.when(c("y").isin(*probs.IN_PLAY_CLASSES), (F.coalesce("bb_type", F.lit("None")) == "ground_ball").cast("double"))).alias("ground"))
    return count_vectors(lab, by, "y", 10).join(rates, list(by))


def value_decomposition(ref: Column, plan: Column, execution: Column, observed: Column) -> dict[str, Column]:
    """Telescoping contrasts in points; a missing stage stays null and its part is left unallocated."""
    total, strategy = 100 * (observed - ref), 100 * (plan - ref)
    delivery, outcome = 100 * (execution - plan), 100 * (observed - execution)
    parts = (strategy, delivery, outcome)
    complete = total.isNotNull() & strategy.isNotNull() & delivery.isNotNull() & outcome.isNotNull()
    zero = F.lit(0.0)
    given = sum((F.coalesce(p, zero) for p in parts), zero)
    den = sum((F.abs(p) for p in parts), zero)
    stable = complete & (den > SHARE_EPSILON)
    return {
        "total": total, "strategy": strategy, "execution": delivery, "outcome": outcome,
        "unallocated": F.when(complete, zero).when(total.isNotNull(), total - given),
        "status": F.when(complete, "complete").when(total.isNotNull(), "partial").otherwise("unavailable"),
        "strategy_share": F.when(stable, F.abs(strategy) / den),
        "execution_share": F.when(stable, F.abs(delivery) / den),
        "outcome_share": F.when(stable, F.abs(outcome) / den),
    }
