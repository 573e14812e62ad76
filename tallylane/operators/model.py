"""Clustering, calibration and small linear models on spark.ml and grid aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Matrices
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylane.functions import features, probs
from tallylane.functions.quantiles import with_row
from tallylane.operators.lineage import materialise

c = F.col

# Fixed value: partitions that a pass of an optimiser reads as one.
JOINED = 8


def _assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def side_clusters(table: DataFrame, side: str, sides: Sequence[str], id_col: str, cols: Sequence[str], per_side: int, eligible: Column, order_by: str, seed: int = 42) -> DataFrame:
    """k-means per side on standardised features, numbered by a centre coordinate; ineligible rows get
    the cluster whose centre is nearest the mean."""
    out = None
    pos = list(cols).index(order_by)
    for i, s in enumerate(sides):
        part = table.where(c(side) == s)
        complete = eligible & ~F.exists(F.array(*[c(x).isNull() for x in cols]), lambda v: v)
        fit_rows = _assemble(part.where(complete), cols, "raw")
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(fit_rows)
        z = scaler.transform(fit_rows)
        model = KMeans(k=per_side, seed=seed + i, maxIter=50, initSteps=5).fit(z)
        centres = [list(map(float, v)) for v in model.clusterCenters()]
        order = sorted(range(len(centres)), key=lambda j: centres[j][pos])
        rank = {j: k for k, j in enumerate(order)}
        default = rank[min(range(len(centres)), key=lambda j: sum(x * x for x in centres[j]))]
        remap = F.create_map(*[F.lit(x) for j, k in rank.items() for x in (j, k)])
        own = model.transform(z).select(id_col, side, (remap[c("prediction")] + i * per_side).cast("bigint").alias("cluster_id"), F.lit(False).alias("is_default"))
        rest = part.where(~F.coalesce(complete, F.lit(False))).select(id_col, side, F.lit(i * per_side + default).cast("bigint").alias("cluster_id"), F.lit(True).alias("is_default"))
        both = own.unionByName(rest)
        out = both if out is None else out.unionByName(both)
    return out


def soft_clusters(snapshots: DataFrame, rates: Sequence[str], weights: Sequence[str], entity: str, k: int, order_by: str, seed: int = 42) -> DataFrame:
    """Weighted k-means on profile snapshots (equal entity weight times evidence) and soft membership:
    radial softmax with a bandwidth fitted on the snapshots, shrunk to uniform by missing evidence."""
    # read for counts, moments, starts, bandwidth and result: derived once, not once for each
    snapshots = materialise(snapshots)
    evidence = sum((c(w) for w in weights[1:]), c(weights[0])) / len(weights)
    n = snapshots.groupBy(entity).agg(F.count("*").alias("_n"))
    x = snapshots.join(n, entity).withColumn("_e", evidence).withColumn("_w", c("_e") / c("_n"))
    stats = x.agg(*[(F.sum(c("_w") * c(r)) / F.sum("_w")).alias(f"_m_{r}") for r in rates], *[F.sum(c("_w") * c(r) * c(r)).alias(f"_q_{r}") for r in rates], F.sum("_w").alias("_all_w"))
    x = with_row(x, stats)
    z = [f"_z_{r}" for r in rates]
    x = x.withColumns({f"_z_{r}": (c(r) - c(f"_m_{r}")) / F.greatest(F.sqrt(F.greatest(c(f"_q_{r}") / c("_all_w") - c(f"_m_{r}") * c(f"_m_{r}"), F.lit(0.0))), F.lit(0.01)) for r in rates})
    vec = _assemble(x, z)
    model = KMeans(k=k, seed=seed, weightCol="_w", maxIter=100).fit(vec.where("_w > 0"))
    pos = list(rates).index(order_by)
    centres = sorted(([float(v) for v in m] for m in model.clusterCenters()), key=lambda m: m[pos])

    def dist(m):
        return sum(((c(f) - v) * (c(f) - v) for f, v in zip(z[1:], m[1:])), (c(z[0]) - m[0]) * (c(z[0]) - m[0]))

    vec = vec.withColumns({f"_d{i}": dist(m) for i, m in enumerate(centres)})
    near = F.least(*[f"_d{i}" for i in range(len(centres))]) if len(centres) > 1 else c("_d0")
    band = vec.agg(F.greatest(F.sum(c("_w") * near) / F.sum("_w"), F.lit(0.25)).alias("_b"))
    vec = with_row(vec, band).withColumn("_near", near)
    vec = vec.withColumns({f"_x{i}": F.exp(-(c(f"_d{i}") - c("_near")) / (2 * c("_b"))) for i in range(len(centres))})
    s = sum((c(f"_x{i}") for i in range(1, len(centres))), c("_x0"))
    member = F.array(*[c("_e") * c(f"_x{i}") / s + (1 - c("_e")) / len(centres) for i in range(len(centres))])
    return vec.select(*snapshots.columns, member.alias("membership"))


def actor_clusters(log: DataFrame, actor: str, means: Sequence[str], shares: dict[str, Column], k: int, seed: int = 42) -> DataFrame:
    """k-means of actors on mean measures and shares, median-imputed and standardised."""
    prof = log.groupBy(actor).agg(*[F.avg(m).alias(m) for m in means], *[F.avg(s.cast("double")).alias(n) for n, s in shares.items()])
    cols = [*means, *shares]
    z = features.apply_scaler(prof, features.fit_scaler(prof, cols, 1e-8), cols)
    vec = _assemble(z, [f"{x}_z" for x in cols])
    return KMeans(k=k, seed=seed, maxIter=100).fit(vec).transform(vec).select(actor, c("prediction").cast("bigint").alias("cluster_id"))


def winner_model(design: DataFrame, label: str, cols: Sequence[str], non_negative: Sequence[str], reg: float):
    """Regularised logistic model whose score coefficients cannot be negative.

    Equal rows are fitted as one with their number as its weight: game states repeat, so every pass of the optimiser is over
    the distinct ones.
    """
    design = design.groupBy(*cols, label).agg(F.count("*").cast("double").alias("_rows"))
    lower = [0.0 if x in non_negative else float("-inf") for x in cols]
    lr = LogisticRegression(labelCol=label, featuresCol="features", weightCol="_rows", regParam=reg, maxIter=100, standardization=False, lowerBoundsOnCoefficients=Matrices.dense(1, len(cols), lower))
    return lr.fit(_assemble(design, cols))


def log_loss(scored: DataFrame, p: str, label: str, weight: str | None = None) -> float:
    """Mean of -log of the probability of the row's own class; a class the model does not know has the floor."""
    own = F.coalesce(F.get(c(p), c(label).cast("int")), F.lit(0.0))
    w = F.lit(1.0) if weight is None else c(weight)
    return scored.agg(F.sum(-w * F.log(F.greatest(own, F.lit(probs.NLL_FLOOR)))) / F.sum(w)).first()[0]


def fit_partitions(partitions: int, cores: int) -> int:
    """Partitions of an optimiser's pass: JOINED of the rows' own in each, but one for each core at least (if there are as many)."""
    return min(partitions, max(cores, -(-partitions // JOINED)))


def outcome_model(train: DataFrame, stop: DataFrame, cols: Sequence[str], label: str, weight: str | None = None, reg: float = 1e-4, budgets: Sequence[int] = (5, 10, 20, 40, 80), tolerance: float = 1e-5):
    """Multinomial logistic model over all classes of `train`, stopped early on the rows of `stop`.

    The optimiser follows the same path whatever its budget of iterations, so fits with growing budgets are points of one
    path.  Budgets grow until the loss on `stop` no longer falls by `tolerance`, or the fit has converged before; the best
    one is kept.  Rows may be weighted (weights are divided by their mean).  Returns the model and one
    (budget, iterations, loss on `stop`) for each fit.  Every pass of the optimiser is a job over all partitions, so several small
    ones are read as one.
    """
    rows, held = _assemble(train, cols).select("features", label, *([weight] if weight else [])), _assemble(stop, cols)
    rows = rows.coalesce(fit_partitions(rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism)).persist()
    try:
        if weight:
            mean = rows.agg(F.avg(weight)).first()[0]
            rows = rows.withColumn(weight, c(weight) / mean)
        best, history = None, []
        for budget in budgets:
            lr = LogisticRegression(labelCol=label, featuresCol="features", family="multinomial", regParam=reg, maxIter=budget, standardization=False)
            model = (lr.setWeightCol(weight) if weight else lr).fit(rows)
            loss = log_loss(model.transform(held).withColumn("_p", vector_to_array("probability")), "_p", label)
            taken = model.summary.totalIterations
            history.append((budget, taken, loss))
            better = best is None or loss < best[1] - tolerance
            if better:
                best = (model, loss)
            if not better or taken < budget:
                break
    finally:
        rows.unpersist()
    return best[0], history


def predict(model, df: DataFrame, cols: Sequence[str], output: str = "p") -> DataFrame:
    return model.transform(_assemble(df, cols)).withColumn(output, vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")


def grid_fit(df: DataFrame, loss, low: float, high: float, by: Sequence[str] = (), rounds: int = 3, points: int = 9) -> DataFrame:
    """One-dimensional bounded minimisation of a mean row loss by successive grids.

    Each round explodes rows over the grid of its group and takes one aggregate; the next
    grid spans the neighbours of the best point.  Grids are tiny tables carried lazily, so
    the rounds form one plan.
    """
    by = list(by)
    span = (df.select(*by).distinct() if by else df.agg(F.count("*").alias("_rows"))).withColumns({"_lo": F.lit(float(low)), "_hi": F.lit(float(high))})
    best = None
    for _ in range(rounds):
        grid = span.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: c("_lo") + (c("_hi") - c("_lo")) * i / (points - 1))))
        grid = grid.select(*by, "_lo", "_hi", "t")
        per = grid.groupBy(*by).agg(F.sort_array(F.collect_list("t")).alias("_ts"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi")) if by else grid.agg(F.sort_array(F.collect_list("t")).alias("_ts"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        rows = df.join(F.broadcast(per), by) if by else with_row(df, per)
        scored = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("t", c("_ts")[c("_i")])
        means = scored.groupBy(*by, "_i").agg(F.avg(loss(c("t"))).alias("nll"), F.max("t").alias("t"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        best = means.groupBy(*by).agg(F.min_by(F.struct("t", "nll", "_lo", "_hi"), F.struct("nll", "t")).alias("_b")).select(*by, "_b.*")
        step = (c("_hi") - c("_lo")) / (points - 1)
        span = best.select(*by, F.greatest(c("t") - step, F.lit(float(low))).alias("_lo"), F.least(c("t") + step, F.lit(float(high))).alias("_hi"))
    return best.select(*by, c("t").alias("best"), "nll")


def upper_edges(boundaries: Sequence[float], predictions: Sequence[float]) -> list[tuple[float, float]]:
    """Right edge and value of each block of a fitted step function."""
    edges: dict[float, float] = {}
    for x, y in zip(boundaries, predictions, strict=True):
        edges[float(y)] = max(float(x), edges.get(float(y), float(x)))
    return sorted((x, y) for y, x in edges.items())


def step_value(x: Column, edges: Sequence[tuple[float, float]]) -> Column:
    """Value of the first block whose right edge is at or above x: in a gap, the block above; beyond all, the last."""
    blocks = F.array(*[F.struct(F.lit(a).alias("edge"), F.lit(b).alias("value")) for a, b in edges])
    above = F.filter(blocks, lambda block: block["edge"] >= x)
    return F.when(F.size(above) > 0, above[0]["value"]).otherwise(F.lit(edges[-1][1]))


def isotonic_classes(fit: DataFrame, apply: DataFrame, p: str, y: str, n_classes: int) -> DataFrame:
    """Isotonic regression per class with a step lookup on the fitted blocks, clipped and renormalised.

    spark.ml keeps a fitted model on the driver; only its blocks' right edges go into the plan.
    """
    out = apply
    for k in range(n_classes):
        rows = fit.select(probs.at(c(p), k).alias("x"), (c(y) == k).cast("double").alias("label"))
        m = IsotonicRegression(featuresCol="x", labelCol="label").fit(rows)
        found = step_value(probs.at(c(p), k), upper_edges(m.boundaries, m.predictions))
        out = out.withColumn(f"_k{k}", F.greatest(F.least(found, F.lit(1 - 1e-6)), F.lit(1e-6)))
    s = sum((c(f"_k{k}") for k in range(1, n_classes)), c("_k0"))
    return out.withColumn(f"{p}_iso", F.array(*[c(f"_k{k}") / s for k in range(n_classes)])).drop(*[f"_k{k}" for k in range(n_classes)])


def score_batches(df: DataFrame, predict_fn, schema: str) -> DataFrame:
    """Batch scoring hook: `predict_fn(pandas frame) -> pandas frame` over Arrow batches."""
    def run(batches):
        for pdf in batches:
            yield predict_fn(pdf)

    return df.mapInPandas(run, schema)
