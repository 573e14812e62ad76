"""Integer codecs for counts, base/out situations and states, and the tables they span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylane.functions import codes

# --- Fixed values -----------------------------------------------------------
N_COUNTS, N_BASE_OUT, N_OUTCOMES, N_ACTIONS = 12, 24, 11, 225
MAX_CLUSTERS = 8
CONTEXT_SIZES = {"none": 1, "family": 4, "family_zone": 7}
X_EDGES = (-0.83, -0.28, 0.28, 0.83)
Z_EDGES = (0.0, 1.0 / 3.0, 2.0 / 3.0, 1.0)
# ----------------------------------------------------------------------------


def idiv(a: Column, n: int) -> Column:
    return F.floor(a / F.lit(n)).cast("bigint")


def count_id(balls: Column, strikes: Column) -> Column:
    return balls * 3 + strikes


def base_out_id(outs: Column, *runners: Column) -> Column:
    """outs * 8 plus one bit per occupied base; a runner is an id, null when the base is empty."""
    mask = sum((F.when(r > 0, 1 << i).otherwise(0) for i, r in enumerate(runners)), F.lit(0))
    return (outs * 8 + mask).cast("bigint")


def decode_base_out(b: Column) -> dict[str, Column]:
    m = b % 8
    return {"outs": idiv(b, 8), "r1": m.bitwiseAND(1) > 0, "r2": m.bitwiseAND(2) > 0, "r3": m.bitwiseAND(4) > 0}


def state_id(count: Column, base_out: Column, cluster: Column, k: int, context: Column | None = None, c: int = 1) -> Column:
    context = F.lit(0) if context is None else context
    return ((((count * N_BASE_OUT) + base_out) * k + cluster) * c + context).cast("bigint")


def state_in_range(count: Column, base_out: Column, cluster: Column, k: int, context: Column, c: int) -> Column:
    return (
        count.between(0, N_COUNTS - 1) & base_out.between(0, N_BASE_OUT - 1)
        & cluster.between(0, k - 1) & context.between(0, c - 1)
    )


def decode_state(s: Column, k: int, c: int = 1) -> dict[str, Column]:
    cb = idiv(s, c * k)
    return {"count_id": idiv(cb, N_BASE_OUT), "base_out_id": cb % N_BASE_OUT, "cluster_id": idiv(s, c) % k, "context_id": s % c}


def digitize(x: Column, edges) -> Column:
    """Number of edges at or below x, so a value on an edge falls in the upper bin."""
    return sum(((x >= F.lit(e)).cast("bigint") for e in edges), F.lit(0).cast("bigint"))


def z_norm(z: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (z - low) / (high - low))


def loc_id(x: Column, zn: Column) -> Column:
    """Cell of the 5 x 5 grid, -1 when the location is unknown."""
    return F.when(x.isNull() | zn.isNull(), -1).otherwise(digitize(zn, Z_EDGES) * 5 + digitize(x, X_EDGES)).cast("bigint")


def action_id(group: Column, loc: Column) -> Column:
    return F.when((group >= 0) & (loc >= 0), group * 25 + loc).otherwise(-1).cast("bigint")


def _centre(i: Column, edges) -> Column:
    mids = [edges[0] - (edges[1] - edges[0]) / 2]
    mids += [(a + b) / 2 for a, b in zip(edges[:-1], edges[1:])]
    mids += [edges[-1] + (edges[-1] - edges[-2]) / 2]
    return F.element_at(F.array(*[F.lit(m) for m in mids]), (i + 1).cast("int"))


def cell_centre(loc: Column) -> tuple[Column, Column]:
    return _centre(loc % 5, X_EDGES), _centre(idiv(loc, 5), Z_EDGES)


def in_zone(loc: Column) -> Column:
    return idiv(loc, 5).between(1, 3) & (loc % 5).between(1, 3)


def action_context(group: Column, loc: Column, kind: str) -> Column:
    """Context left behind by an action: its family, optionally crossed with in/out of zone."""
    if kind == "none":
        return F.lit(0).cast("bigint")
    family = idiv(group, 3) + 1
    if kind == "family":
        return F.when(F.coalesce(group, F.lit(-1)) < 0, 0).otherwise(family).cast("bigint")
    absent = (F.coalesce(group, F.lit(-1)) < 0) | (F.coalesce(loc, F.lit(-1)) < 0)
    return F.when(absent, 0).otherwise(1 + (family - 1) * 2 + in_zone(loc).cast("bigint")).cast("bigint")


def coarse_group(action: Column) -> Column:
    """225 actions to 81 groups: nine types by a 3 x 3 grid."""
    def third(i):
        return F.when(i <= 1, 0).when(i == 2, 1).otherwise(2)
    loc = action % 25
    return (idiv(action, 25) * 9 + third(idiv(loc, 5)) * 3 + third(loc % 5)).cast("bigint")


def outcome_allowed(count: Column, outcome: Column) -> Column:
    """Rule mask: which outcomes a count admits."""
    balls, strikes = idiv(count, 3), count % 3
    return (
        F.when(outcome == 0, balls < 3).when(outcome == 4, balls == 3)
        .when(outcome == 1, strikes < 2).when(outcome == 3, strikes == 2).otherwise(F.lit(True))
    )


def allowed_sql(count: str) -> list[str]:
    """`outcome_allowed` of every outcome as SQL text over a count column: text is parsed at once, where columns are built call by call."""
    rules = {0: f"{count} div 3 < 3", 4: f"{count} div 3 = 3", 1: f"{count} % 3 < 2", 3: f"{count} % 3 = 2"}
    return [rules.get(i, "true") for i in range(N_OUTCOMES)]


def next_count(count: Column, outcome: Column) -> Column:
    """Count after a non-terminal outcome; null when terminal or not allowed."""
    balls, strikes = idiv(count, 3), count % 3
    return (
        F.when((outcome == 0) & (balls < 3), (balls + 1) * 3 + strikes)
        .when((outcome == 1) & (strikes < 2), balls * 3 + strikes + 1)
        .when(outcome == 2, balls * 3 + F.least(strikes + 1, F.lit(2)))
        .cast("bigint")
    )


# --- generated dimension tables (sizes fixed by the codecs above) -------------

def states_table(spark: SparkSession, k: int, c: int = 1) -> DataFrame:
    s = F.col("state_id")
    return spark.range(N_COUNTS * N_BASE_OUT * k * c).withColumnRenamed("id", "state_id").withColumns(decode_state(s, k, c))


def actions_table(spark: SparkSession) -> DataFrame:
    a = F.col("action_id")
    return spark.range(N_ACTIONS).withColumnRenamed("id", "action_id").withColumns({
        "group_id": idiv(a, 25), "loc_id": a % 25, "z_row": idiv(a % 25, 5), "x_col": a % 5})


def outcomes_table(spark: SparkSession) -> DataFrame:
    o = F.col("outcome_id")
    return spark.range(N_OUTCOMES).withColumnRenamed("id", "outcome_id").withColumns({
        "name": F.element_at(F.array(*[F.lit(n) for n in codes.OUTCOME11]), (o + 1).cast("int")),
        "terminal": o >= 3,
        "count_rule": F.when(o == 0, "ball").when(o == 1, "strike").when(o == 2, "foul")})


def count_outcome_table(spark: SparkSession) -> DataFrame:
    """12 x 11 rows: is the outcome allowed at the count, and which count follows."""
    n = F.col("id")
    return spark.range(N_COUNTS * N_OUTCOMES).select(idiv(n, N_OUTCOMES).alias("count_id"), (n % N_OUTCOMES).alias("outcome_id")).withColumns({
        "allowed": outcome_allowed(F.col("count_id"), F.col("outcome_id")),
        "next_count_id": next_count(F.col("count_id"), F.col("outcome_id"))})
