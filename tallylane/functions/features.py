"""Numeric feature expressions and train-only scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylane.functions.quantiles import exact_quantiles, with_row
from tallylane.functions.states import z_norm

# --- Fixed values -----------------------------------------------------------
CELL_CENTRES_X = (-0.83, 0.0, 0.83)
CELL_CENTRES_Z = (1.5, 2.5, 3.5)
RBF_WIDTH = 0.65
EDGE_SOFTNESS = 0.15
HINGE_CLIP = 8.0
# ----------------------------------------------------------------------------


def physical_channels() -> dict[str, Column]:
    """Mirror left-handed rows, prefer effective speed, expand the angle."""
    side = F.when(F.col("stand") == "L", F.lit(-1.0)).otherwise(F.lit(1.0))
    angle = F.radians(F.pmod(F.col("spin_axis"), F.lit(360.0)))
    return {
        "x": F.col("plate_x") * side,
        "zn": z_norm(F.col("plate_z"), F.col("sz_bot"), F.col("sz_top")),
        "speed": F.coalesce("effective_speed", "release_speed"),
        "spin": F.col("release_spin_rate"),
        "axis_sin": F.sin(angle),
        "axis_cos": F.cos(angle),
        "move_x": F.col("pfx_x") * side,
        "move_z": F.col("pfx_z"),
    }


def fit_scaler(train: DataFrame, columns: Sequence[str], floor: float = 1e-6) -> DataFrame:
    """One row: per column the median fill, and mean / population std after filling."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(x).alias("name"), F.col(x).cast("double").alias("value")) for x in columns])).alias("_x")).select("_x.*")
    medians = exact_quantiles(long, "value", [0.5], ["name"])
    fills = medians.agg(*[F.coalesce(F.max(F.when(F.col("name") == x, F.col("q")[0])), F.lit(0.0)).alias(f"fill_{x}") for x in columns])
    filled = with_row(train.select(*columns), fills)
    stats = []
    for c in columns:
        v = F.coalesce(F.col(c), F.col(f"fill_{c}"))
        stats += [F.max(f"fill_{c}").alias(f"fill_{c}"), F.avg(v).alias(f"mean_{c}"), F.greatest(F.stddev_pop(v), F.lit(floor)).alias(f"scale_{c}")]
    return filled.agg(*stats)


def apply_scaler(df: DataFrame, params: DataFrame, columns: Sequence[str], suffix: str = "_z", clip: float | None = None) -> DataFrame:
    out = with_row(df, params)
    for c in columns:
        z = (F.coalesce(F.col(c), F.col(f"fill_{c}")) - F.col(f"mean_{c}")) / F.col(f"scale_{c}")
        if clip is not None:
            z = F.greatest(F.lit(-clip), F.least(F.lit(clip), z))
        out = out.withColumn(c + suffix, z)
    return out.drop(*params.columns)


def hinges(df: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """Piecewise-linear basis of a scaled column with knots at the train quartiles."""
    knots = exact_quantiles(train, column, [0.25, 0.5, 0.75]).select(F.col("q").alias("_knots"))
    out = with_row(df, knots)
    for i in range(3):
        out = out.withColumn(f"{column}_h{i + 1}", F.greatest(F.col(column) - F.col("_knots")[i], F.lit(0.0)))
    return out.drop("_knots")


def hinge_table(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`hinges` of many columns at once: all knots come from one pass over `train`."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(x).alias("name"), F.col(x).alias("value")) for x in columns])).alias("_x")).select("_x.*")
    knots = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["name"]).agg(*[F.max(F.when(F.col("name") == x, F.col("q"))).alias(f"_knots_{x}") for x in columns])
    parts = {f"{x}_h{i + 1}": F.greatest(F.col(x) - F.col(f"_knots_{x}")[i], F.lit(0.0)) for x in columns for i in range(3)}
    return with_row(df, knots).withColumns(parts).drop(*[f"_knots_{x}" for x in columns])


def bucketise(df: DataFrame, fit: DataFrame, column: str, bins: int, output: str) -> DataFrame:
    """0 for missing, otherwise 1 + number of fit quantile edges at or below the value."""
    edges = exact_quantiles(fit, column, [k / bins for k in range(1, bins)]).select(F.col("q").alias("_edges"))
    v = F.col(column)
    above = F.aggregate("_edges", F.lit(0), lambda acc, e: acc + (v >= e).cast("int"))
    return with_row(df, edges).withColumn(output, F.when(v.isNull() | F.isnan(v), 0).otherwise(1 + above).cast("bigint")).drop("_edges")


def location_basis(x: Column, z: Column) -> dict[str, Column]:
    """Five polynomial terms, nine radial terms, four soft edges."""
    def clip(v):
        return F.greatest(F.lit(-5.0), F.least(F.lit(5.0), v))

    def sigmoid(v):
        return 1 / (1 + F.exp(-v))

    cx, cz = clip(x), clip(z - 2.5)
    out = {"bx": cx, "bz": cz, "bx2": cx * cx, "bz2": cz * cz, "bxz": cx * cz}
    i = 0
    for mz in CELL_CENTRES_Z:
        for mx in CELL_CENTRES_X:
            out[f"rbf{i}"] = F.exp(-((x - mx) * (x - mx) + (z - mz) * (z - mz)) / (2 * RBF_WIDTH * RBF_WIDTH))
            i += 1
    for name, v in (("in_right", F.lit(0.83) - x), ("in_left", x + 0.83), ("above_low", z - 1.5), ("below_high", F.lit(3.5) - z)):
        out[name] = sigmoid(v / EDGE_SOFTNESS)
    return out


def location_cell(x: Column, z: Column) -> Column:
    """3 x 3 cells inside the zone, four outside regions with the horizontal ones first."""
    def part(v):
        return F.greatest(F.lit(0), F.least(F.lit(2), v.cast("int")))

    inside = part((z - 1.5) / 2 * 3) * 3 + part((x + 0.83) / 1.66 * 3)
    return F.when(x < -0.83, 9).when(x > 0.83, 10).when(z < 1.5, 11).when(z > 3.5, 12).otherwise(inside).cast("bigint")


def winner_design(occupied=lambda i: F.col(("on_1b", "on_2b", "on_3b")[i]).isNotNull()) -> dict[str, Column]:
    """Sixteen features of a game situation for the final-winner model; `occupied` tells whether base i (from 0) is."""
    inning, outs = F.col("inning").cast("double"), F.col("outs_when_up").cast("double")
    bot = (F.col("inning_topbot") == "Bot").cast("double")
    diff = (F.col("home_score") - F.col("away_score")).cast("double")
    left = F.greatest(2 * (9 - inning) + (1 - bot) + (3 - outs) / 3, F.lit(0.35))
    sign, scale = 2 * bot - 1, F.sqrt(left + 0.5)
    out = {
        "w0": F.lit(1.0), "w1": diff / scale, "w2": diff, "w3": bot, "w4": inning / 9, "w5": outs / 3,
        "w6": bot * outs / 3, "w7": (inning >= 9).cast("double"), "w8": sign / scale, "w9": sign * outs / (3 * scale),
    }
    for i in range(3):
        on = occupied(i).cast("double")
        out[f"w{10 + i}"] = on * sign / scale
        out[f"w{13 + i}"] = on * sign * (3 - outs) / (3 * scale)
    return out
