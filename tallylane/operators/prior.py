"""Exact order statistics of a value over strictly earlier dates, for each key and date.

The values of a key grow with every date, so a sort for each date would be quadratic and a list in one task unbounded.
Here distinct values get ranks, and the ranks are read digit by digit from the top, as in a wavelet tree: a question
(key, date, k) stands at a node, that is at the digits found so far.  Running counts of the next digit over the earlier
dates of the node say which digit the k-th value has, and how many values to skip before it.  Each digit costs one
aggregation and one window; a window partition holds one row for each date of a node, never one for each value, so a
key that owns all rows is no hot spot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallylane.functions.quantiles import cumulative_counts
from tallylane.operators.lineage import materialise

c = F.col
BITS = 4
FAN = 1 << BITS


def ranked_values(rows: DataFrame, value: str) -> DataFrame:
    """Distinct non-null values (NaN counts as null) with dense ranks from 0."""
    v = c(value).cast("double")
    distinct = rows.select(v.alias("_v")).where(c("_v").isNotNull() & ~F.isnan("_v")).distinct()
    return cumulative_counts(distinct.withColumn("_one", F.lit(1)), "_v", "_one").select("_v", c("below").cast("bigint").alias("_rank"))


def prior_quantile(rows: DataFrame, questions: DataFrame, by: Sequence[str], date: str, value: str, share: float = 0.5) -> DataFrame:
    """`questions` (key, date) with `n`, the values of that key on earlier dates, and `q`, their interpolated quantile.

    Null and NaN values are not counted; `q` is null and `n` is 0 where no earlier value is known.  Null keys form one key,
    rows without a date are never earlier, and a question without a date has no answer.  Repeated questions are answered once.
    """
    by = list(by)
    ranks = materialise(ranked_values(rows, value))
    top = ranks.agg(F.max("_rank")).first()[0] or 0
    digits = max(1, -(-int(top).bit_length() // BITS))
    counted = rows.where(c(date).isNotNull()).withColumn("_v", c(value).cast("double")).groupBy(*by, date, "_v").agg(F.count("*").alias("_n"))
    cells = materialise(counted.join(ranks, "_v").select(*by, date, "_rank", "_n"))

    asked = questions.select(*by, date).distinct()
    total = _before(cells.groupBy(*by, date).agg(F.sum("_n").alias("_n")), asked, by, date, ["_n"])
    at = (c("_n") - 1) * F.lit(float(share))
    open_ = total.where("_n > 0").select(
        *by, date, c("_n").alias("_all"), (at - F.floor(at)).alias("_part"), F.lit(0).cast("bigint").alias("_node"),
        F.explode(F.array(F.struct(F.lit(0).alias("_which"), F.floor(at).alias("_k")), F.struct(F.lit(1).alias("_which"), F.ceil(at).alias("_k")))).alias("_ask"))
    open_ = open_.select(*by, date, "_all", "_part", "_node", "_ask.*")
    for step in range(digits):
        shift = BITS * (digits - 1 - step)
        here = cells.select(*by, date, F.shiftright("_rank", shift + BITS).alias("_node"), F.shiftright("_rank", shift).bitwiseAND(FAN - 1).alias("_digit"), "_n")
        names = [f"_c{j}" for j in range(FAN)]
        nodes = here.groupBy(*by, "_node", date).agg(*[F.sum(F.when(c("_digit") <= j, c("_n")).otherwise(0)).alias(x) for j, x in enumerate(names)])
        found = _before(nodes, open_, [*by, "_node"], date, names)
        # counts up to digit j grow with j: the digit is the number of those that do not reach beyond k
        digit = sum(((c(x) <= c("_k")).cast("bigint") for x in names[1:]), (c(names[0]) <= c("_k")).cast("bigint"))
        skipped = F.greatest(F.lit(0), *[F.when(c(x) <= c("_k"), c(x)).otherwise(0) for x in names])
        open_ = found.select(*by, date, "_all", "_part", "_which", (c("_node") * FAN + digit).alias("_node"), (c("_k") - skipped).alias("_k"))
    ends = open_.join(ranks, c("_node") == c("_rank")).groupBy(*by, date).agg(
        F.max("_all").alias("n"), F.max("_part").alias("_part"), *[F.max(F.when(c("_which") == i, c("_v"))).alias(f"_v{i}") for i in (0, 1)])
    ends = ends.select(*by, date, "n", (c("_v0") + (c("_v1") - c("_v0")) * c("_part")).alias("q"))
    none = total.where("_n = 0").select(*by, date, c("_n").alias("n"), F.lit(None).cast("double").alias("q"))
    return ends.unionByName(none)


def _before(counts: DataFrame, questions: DataFrame, by: Sequence[str], date: str, names: Sequence[str]) -> DataFrame:
    """`questions` with the sums of `counts` over the earlier dates of their key, by stacking both and a range frame."""
    stacked = questions.where(c(date).isNotNull()).withColumn("_asks", F.lit(True)).unionByName(counts.withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.unix_date(date)).rangeBetween(Window.unboundedPreceding, -1)
    sums = {x: F.coalesce(F.sum(F.when(~c("_asks"), c(x))).over(w), F.lit(0)) for x in names}
    return stacked.withColumns(sums).where("_asks").drop("_asks")


def recent_repertoire(log: DataFrame, questions: DataFrame, actor: str, date: str, kind: str, kinds: Sequence[str], days: int, least: int) -> DataFrame:
    """`questions` (actor, date) with `repertoire`: `kind:count` of the kinds seen at least `least` times in the `days` days before.

    Kinds outside `kinds` do not count.  Counts are first summed by actor and date, so a window holds one row for each date.
    """
    names = [f"_t{i}" for i in range(len(kinds))]
    counts = log.where(c(date).isNotNull()).groupBy(actor, date).agg(*[F.count_if(c(kind) == k).alias(n) for k, n in zip(kinds, names, strict=True)])
    stacked = questions.select(actor, date).where(c(date).isNotNull()).distinct().withColumn("_asks", F.lit(True)).unionByName(counts.withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(actor).orderBy(F.unix_date(date)).rangeBetween(-days, -1)
    sums = stacked.withColumns({n: F.coalesce(F.sum(n).over(w), F.lit(0)) for n in names}).where("_asks")
    seen = F.array_compact(F.array(*[F.when(c(n) >= least, F.concat(F.lit(f"{k}:"), c(n).cast("string"))) for k, n in zip(kinds, names, strict=True)]))
    return sums.select(actor, date, F.array_join(seen, "|").alias("repertoire"))


def prior_bounds(log: DataFrame, questions: DataFrame, entity: str, date: str, columns: Sequence[str]) -> DataFrame:
    """`questions` (entity, date) with the prior median of each column: the entity's own, else that of all entities, else null."""
    asked = questions.select(entity, date).distinct()
    value = F.explode(F.array(*[F.struct(F.lit(x).alias("_name"), c(x).cast("double").alias("_value")) for x in columns]))

    def spread(df: DataFrame, *more) -> DataFrame:
        """Each row for its own entity and for all entities together."""
        both = df.select(c(entity).alias("_who"), c(date).alias("_at"), *more).withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False))))
        return both.withColumn("_who", F.when(c("_own"), c("_who")))

    values = spread(log, value.alias("_x")).select("_own", "_who", "_at", "_x.*")
    wanted = spread(asked, F.explode(F.array(*[F.lit(x) for x in columns])).alias("_name"))
    found = materialise(prior_quantile(values, wanted, ["_name", "_own", "_who"], "_at", "_value").where("q is not null"))

    def wide(own: bool, prefix: str, by: list) -> DataFrame:
        part = found.where(c("_own") == own)
        return part.groupBy(*by).agg(*[F.max(F.when(c("_name") == x, c("q"))).alias(prefix + x) for x in columns])

    mine = wide(True, "_own_", [c("_who").alias(entity), c("_at").alias(date)])
    league = wide(False, "_all_", [c("_at").alias(date)])
    out = asked.join(mine, [entity, date], "left").join(league, date, "left")
    return out.select(entity, date, *[F.coalesce(f"_own_{x}", f"_all_{x}").alias(f"prior_{x}") for x in columns])
