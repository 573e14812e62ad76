"""Smoothed conditional frequency tables, kept sparse.

A table is long: one row per observed cell.  A cell's prior is the next coarser
level, so smoothing is a chain of aggregates and equi-joins; nothing of the size
actors x states x actions is ever built.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylane.functions import probs, states
from tallylane.functions.quantiles import with_row
from tallylane.operators.lineage import materialise

c = F.col


# --- tiered means and lookups -------------------------------------------------

def tiered_means(train: DataFrame, tiers: Sequence[Sequence[str]], values: Sequence[str], minimum: Sequence[int]) -> list[DataFrame]:
    """Mean of each value per tier (cells below the minimum are dropped), most specific first, then the global row."""
    out = []
    for by, least in zip(tiers, minimum):
        out.append(train.groupBy(*by).agg(*[F.avg(v).alias(f"_m_{v}") for v in values], F.count("*").alias("_n")).where(c("_n") >= least).drop("_n"))
    out.append(train.agg(*[F.avg(v).alias(f"_m_{v}") for v in values]))
    return out


def tiered_lookup(df: DataFrame, tables: Sequence[DataFrame], tiers: Sequence[Sequence[str]], values: Sequence[str]) -> DataFrame:
    """`ref_*` from the most specific tier that has the key; `origin` counts down to 0 = global."""
    out = df
    for i, (table, by) in enumerate(zip(tables, tiers)):
        out = out.join(table.withColumnsRenamed({f"_m_{v}": f"_t{i}_{v}" for v in values}), list(by), "left")
    top = len(tiers)
    out = with_row(out, tables[-1].withColumnsRenamed({f"_m_{v}": f"_t{top}_{v}" for v in values}))
    probe = values[0]
    origin = reduce(lambda acc, i: acc.when(c(f"_t{i}_{probe}").isNotNull(), top - i), range(1, top), F.when(c(f"_t0_{probe}").isNotNull(), top)).otherwise(0)
    out = out.withColumns({"origin": origin.cast("bigint"), **{f"ref_{v}": F.coalesce(*[c(f"_t{i}_{v}") for i in range(top + 1)]) for v in values}})
    return out.drop(*[f"_t{i}_{v}" for i in range(top + 1) for v in values])


# --- class-count tables ---------------------------------------------------------

def class_cells(df: DataFrame, by: Sequence[str], label: str, n_classes: int) -> DataFrame:
    """One row per group with count columns n0..n{k-1}; the finest level, from which coarser ones are summed."""
    return df.groupBy(*by).agg(*[F.expr(f"cast(count_if({label} = {i}) AS double) AS n{i}") for i in range(n_classes)])


def roll_up(cells: DataFrame, by: Sequence[str], n_classes: int) -> DataFrame:
    """Count columns of a coarser level."""
    g = cells.groupBy(*by) if by else cells.groupBy()
    return g.agg(*[F.expr(f"sum(n{i}) AS n{i}") for i in range(n_classes)])


def count_total(n_classes: int) -> Column:
    return sum((c(f"n{i}") for i in range(1, n_classes)), c("n0"))


def shrink(n_classes: int, prior: str | float, strength: float) -> Column:
    """(n_i + strength * prior_i) / (N + strength) as an array, from the count columns.

    Built element by element so the total is one shared subexpression of generated code.
    """
    den = count_total(n_classes) + float(strength)
    return F.array(*[(c(f"n{i}") + strength * (c(prior)[i] if isinstance(prior, str) else F.lit(prior))) / den for i in range(n_classes)])


def frequency_chain(train: DataFrame, levels: Sequence[tuple[Sequence[str], float]], label: str, n_classes: int, pseudo: float = 1.0) -> list[DataFrame]:
    """Smoothed class probabilities per level, coarsest (global) first.

    Keys of consecutive levels are nested, so each cell finds its parent by an equi-join.
    The raw rows are aggregated once, to the finest level.
    """
    finest = list(dict.fromkeys(k for by, _ in levels for k in by))
    cells = materialise(class_cells(train, finest, label, n_classes))
    tables = [roll_up(cells, [], n_classes).select(shrink(n_classes, 1.0 / n_classes, pseudo * n_classes).alias("p"))]
    parent_keys: list[str] = []
    for by, strength in levels:
        counts = roll_up(cells, list(by), n_classes)
        parent = tables[-1].withColumnRenamed("p", "_prior")
        joined = counts.join(parent, parent_keys) if parent_keys else with_row(counts, parent)
        tables.append(joined.select(*by, shrink(n_classes, "_prior", strength).alias("p")))
        parent_keys = list(by)
    return tables


def chain_lookup(df: DataFrame, tables: Sequence[DataFrame], levels: Sequence[Sequence[str]], output: str = "p") -> DataFrame:
    """Most specific probability vector available for every row, with the level it came from (0 = global).

    The levels are looked up once for each distinct key of the rows, and the rows are joined with the
    result once, on all keys: coarse keys, of which few exist, never place the rows.
    """
    keys = list(dict.fromkeys(k for by in levels for k in by))
    out = with_row(df.select(*keys).distinct(), tables[0].withColumnRenamed("p", "_p0"))
    for i, by in enumerate(levels, 1):
        out = out.join(tables[i].withColumnRenamed("p", f"_p{i}"), list(by), "left")
    depth = len(levels)
    origin = F.lit(0)
    for i in range(1, depth + 1):
        origin = F.when(c(f"_p{i}").isNotNull(), i).otherwise(origin)
    found = out.select(*[c(k).alias(f"_k_{k}") for k in keys], F.coalesce(*[c(f"_p{i}") for i in range(depth, -1, -1)]).alias(output), origin.cast("bigint").alias("origin"))
    same = reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"_k_{k}")) for k in keys])
    return df.join(found, same).drop(*[f"_k_{k}" for k in keys])


def transition_counts(log: DataFrame, actor: str) -> DataFrame:
    return log.where("action_id >= 0 and outcome_id >= 0").groupBy(actor, "state_id", "action_id", "outcome_id").agg(F.count("*").alias("n"))


def repertoire(log: DataFrame, actor: str, minimum: int) -> DataFrame:
    return log.where("action_id >= 0 and outcome_id >= 0").groupBy(actor, "pitch_id").agg(F.count("*").alias("n")).withColumn("supported", c("n") >= minimum)


# --- hierarchical Dirichlet smoothing -------------------------------------------

EPS = "1e-9D"
K = states.N_OUTCOMES
#: 1 for outcomes that the count `_c` allows, else 0.
MASK = [f"cast({rule} AS double)" for rule in states.allowed_sql("_c")]
UNIFORM = [f"{m} / ({' + '.join(MASK)})" for m in MASK]

# Levels have one column for each outcome (cell0 to cell10 and so on), so that all arithmetic is generated code.  It is
# written as SQL text: a hundred columns are parsed in one call.


def _cols(*names: str) -> list[str]:
    return [f"{name}{i}" for name in names for i in range(K)]


def _sum(columns: Sequence[str]) -> str:
    return " + ".join(columns)


def _put(df: DataFrame, name: str, exprs: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Outcome columns of a new level beside the columns there are, without `drop`."""
    return df.selectExpr(*[f"`{x}`" for x in df.columns if x not in drop], *[f"{e} AS {name}{i}" for i, e in enumerate(exprs)])


def _shares(df: DataFrame, name: str, exprs: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Expressions as shares of their sum, all zero where the sum is.  Each line is one projection, as a column used twice is not computed twice."""
    out = _put(df, "_x", exprs, drop)
    out = out.selectExpr("*", f"{_sum(_cols('_x'))} AS _t")
    return _put(out, name, [f"CASE WHEN _t > 0 THEN {x} / _t ELSE 0D END" for x in _cols("_x")], ["_t", *_cols("_x")])


def _towards(df: DataFrame, name: str, prior: str, strength: float, drop: Sequence[str] = ()) -> DataFrame:
    """Shares of the counts n0.. plus `strength` pseudo-counts of the prior, over the allowed outcomes; the counts go."""
    return _shares(df, name, [f"(n{i} + {strength}D * {prior}{i}) * {m}" for i, m in enumerate(MASK)], [*_cols("n"), *drop])


def dirichlet_levels(log: DataFrame, actor: str, alpha: float, alpha_actor: float, count_of_state: Column | None = None) -> dict[str, DataFrame]:
    """Observed cells and the smoothed levels above them, each on its own keys.

    League: base (count) -> first (count, action) -> cell (state, action), and kind (count, type).  Actor: own (actor, count, type), whose
    shares over the league's are a tilt of the league's cell.  Codes outside the codecs are left out, so that the
    league's levels have at most 12, 2,700, 64,800 and 108 rows, and may be broadcast.  Counts of coarse levels are sums of finer ones.
    """
    count = states.idiv(c("state_id"), states.N_BASE_OUT) if count_of_state is None else count_of_state
    # codes are checked on the cells: in a filter of the rows, each comparison would repeat the expressions that make the codes
    cells = materialise(class_cells(log, [actor, "state_id", "action_id"], "outcome_id", K))
    known = c("action_id").between(0, states.N_ACTIONS - 1) & c("state_id").between(0, states.N_COUNTS * states.N_BASE_OUT - 1) & (count_total(K) > 0)
    cells = cells.where(known).withColumns({"_c": count, "_g": states.idiv(c("action_id"), 25)})
    state = roll_up(cells, ["_c", "state_id", "action_id"], K)
    action = roll_up(state, ["_c", "action_id"], K)
    kind = roll_up(action.withColumn("_g", states.idiv(c("action_id"), 25)), ["_c", "_g"], K)
    base = _put(roll_up(kind, ["_c"], K), "_m", [f"n{i} * {m}" for i, m in enumerate(MASK)], _cols("n")).selectExpr("*", f"{_sum(_cols('_m'))} AS _s")
    base = _shares(base, "base", [f"CASE WHEN _s > 0 THEN _m{i} ELSE {m} END" for i, m in enumerate(MASK)], ["_s", *_cols("_m")])
    first = _towards(action.join(F.broadcast(base), "_c"), "first", "base", alpha, _cols("base"))
    cell = _towards(state.join(F.broadcast(first), ["_c", "action_id"]), "cell", "first", alpha, ["_c", *_cols("first")])
    kind = _towards(kind.join(F.broadcast(base), "_c"), "kind", "base", alpha, _cols("base"))
    own = _towards(roll_up(cells, [actor, "_c", "_g"], K).join(F.broadcast(kind), ["_c", "_g"]), "own", "kind", alpha_actor)
    own = _put(own, "tilt", [f"own{i} / greatest(kind{i}, {EPS})" for i in range(K)], _cols("own", "kind"))
    return {"cells": cells, "base": base, "first": first, "cell": cell, "kind": kind, "own": own}


def _with_cell(df: DataFrame, levels: dict[str, DataFrame]) -> DataFrame:
    """The league's cell of any state and action; a level without data equals its prior."""
    out = df.join(F.broadcast(levels["cell"].select("state_id", "action_id", *_cols("cell")).toDF("state_id", "action_id", *_cols("_cell"))), ["state_id", "action_id"], "left")
    out = out.join(F.broadcast(levels["first"]), ["_c", "action_id"], "left").join(F.broadcast(levels["base"]), "_c", "left")
    return _put(out, "cell", [f"coalesce(_cell{i}, first{i}, base{i}, {u})" for i, u in enumerate(UNIFORM)], _cols("_cell", "first", "base"))


def _with_tilt(df: DataFrame, levels: dict[str, DataFrame], actor: str) -> DataFrame:
    """The tilt of any actor, count and type; without the actor's own data it is that of the league's shares over themselves."""
    own = levels["own"].select(actor, "_c", "_g", *_cols("tilt")).toDF(actor, "_c", "_g", *_cols("_tilt"))
    out = df.join(own, [actor, "_c", "_g"], "left")
    out = out.join(F.broadcast(levels["kind"]), ["_c", "_g"], "left").join(F.broadcast(levels["base"]), "_c", "left")
    out = _put(out, "_own", [f"coalesce(kind{i}, base{i}, {u})" for i, u in enumerate(UNIFORM)], _cols("kind", "base"))
    return _put(out, "tilt", [f"coalesce(_tilt{i}, _own{i} / greatest(_own{i}, {EPS}))" for i in range(K)], _cols("_tilt", "_own"))


def valid_types(cells: DataFrame, actor: str, minimum: int) -> DataFrame:
    return cells.groupBy(actor, "_g").agg(F.expr(f"sum({_sum(_cols('n'))}) AS _rep")).where(c("_rep") >= minimum).drop("_rep")


def dirichlet_table(log: DataFrame, request: DataFrame | None, actor: str, alpha: float, alpha_actor: float, minimum: int, count_of_state: Column | None = None, levels: dict[str, DataFrame] | None = None) -> DataFrame:
    """Smoothed outcome distribution p0..p10 for the requested (actor, state, action) cells (None: the observed ones).

    Cells whose type the actor used fewer than `minimum` times are not valid and left out.  A level without data equals
    its prior.  Observed cells have all levels, so that they take two joins, one of them with a bounded table.  `levels` are
    the log's `dirichlet_levels`, where they are at hand.
    """
    levels = levels or dirichlet_levels(log, actor, alpha, alpha_actor, count_of_state)
    cells, count = levels["cells"], states.idiv(c("state_id"), states.N_BASE_OUT) if count_of_state is None else count_of_state
    valid = valid_types(cells, actor, minimum)
    if request is None:
        out = cells.join(valid, [actor, "_g"]).join(F.broadcast(levels["cell"]), ["state_id", "action_id"]).join(levels["own"], [actor, "_c", "_g"])
    else:
        need = request.select(actor, "state_id", "action_id").distinct().withColumns({"_c": count, "_g": states.idiv(c("action_id"), 25)})
        out = need.join(valid, [actor, "_g"]).join(cells.drop("_c", "_g"), [actor, "state_id", "action_id"], "left").fillna(0.0, _cols("n"))
        out = _with_tilt(_with_cell(out, levels), levels, actor)
    out = out.selectExpr("*", f"cast({_sum(_cols('n'))} AS bigint) AS n_obs")
    out = _shares(out, "prior", [f"cell{i} * tilt{i} * {m}" for i, m in enumerate(MASK)], _cols("cell", "tilt"))
    return _towards(out, "p", "prior", alpha_actor).select(actor, "state_id", "action_id", *_cols("p"), "n_obs")


def dirichlet_factors(log: DataFrame, actor: str, alpha: float, alpha_actor: float, minimum: int, levels: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same distribution over all states and valid actions, as its factors: no (actor, state, action) grid is written out.

    Returns the league's cells (state, action, p: the whole grid of 64,800 rows), the actors' tilts
    (actor, count, type, tilt: valid types in all 12 counts), and the actors' own counts (actor, state, action, n).
    p of a cell = shares of (n + alpha_actor * shares of (league p * tilt)) over the allowed outcomes.
    """
    levels = levels or dirichlet_levels(log, actor, alpha, alpha_actor)
    n_states = states.N_COUNTS * states.N_BASE_OUT
    grid = log.sparkSession.range(n_states * states.N_ACTIONS).selectExpr(f"id div {states.N_ACTIONS} AS state_id", f"id % {states.N_ACTIONS} AS action_id", f"id div {states.N_ACTIONS * states.N_BASE_OUT} AS _c")
    league = _with_cell(grid, levels).select("state_id", "action_id", F.array(*_cols("cell")).alias("p"))
    kinds = valid_types(levels["cells"], actor, minimum).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(states.N_COUNTS - 1).cast("long"))))
    tilts = _with_tilt(kinds, levels, actor).select(actor, c("_c").alias("count_id"), c("_g").alias("pitch_id"), F.array(*_cols("tilt")).alias("tilt"))
    own = levels["cells"].select(actor, "state_id", "action_id", F.array(*_cols("n")).alias("n")).toDF(actor, "state_id", "action_id", "n")
    return league, tilts, own


# --- factored behaviour policy ----------------------------------------------------

def _with_bounded_level(df: DataFrame, cells: DataFrame, keys: Sequence[str], name: str, fold: str | None) -> DataFrame:
    """Attach the count of a level without an actor, over the other folds if there are folds.

    Such a level has at most 225 rows (and as many for each fold): it is broadcast.
    """
    by = [*keys, *([fold] if fold else [])]
    own = cells.groupBy(*by).agg(F.sum("n").alias("_own"))
    total = F.sum("_own").over(Window.partitionBy(*keys))
    level = own.select(*by, (total - c("_own") if fold else c("_own")).alias(name))
    return df.join(F.broadcast(level), by, "left") if by else with_row(df, level)


def behaviour_probability(log: DataFrame, actor: str, alpha: float, floor: float = 1e-6, fold: Column | None = None) -> DataFrame:
    """pi(type | actor, state) * pi(cell | actor, count, type) of every logged cell.

    With `fold`, each cell is scored with counts of all other folds: totals minus own
    counts, one pass instead of one fit per fold.
    """
    f = None if fold is None else "fold"
    keys = [actor, "state_id", "count_id", "pitch_id", "loc_id"] + ([f] if f else [])
    rows = log.where("action_id >= 0")
    if f:
        rows = rows.withColumn(f, fold)
    cells = materialise(rows.groupBy(*keys).agg(F.count("*").cast("double").alias("n")))
    # one partitioning by actor serves all its levels; an actor has at most states x actions x folds cells
    out = cells.repartition(actor)
    levels = {
        "g": ["pitch_id"], "_all": [], "pg": [actor, "pitch_id"], "p": [actor],
        "pcg": [actor, "count_id", "pitch_id"], "pc": [actor, "count_id"],
        "psg": [actor, "state_id", "pitch_id"], "ps": [actor, "state_id"],
        "gl": ["pitch_id", "loc_id"], "pgl": [actor, "pitch_id", "loc_id"], "pcgl": [actor, "count_id", "pitch_id", "loc_id"]}
    for name, by in levels.items():
        if actor in by:
            own = F.sum("n").over(Window.partitionBy(*by, f)) if f else F.lit(0.0)
            out = out.withColumn(f"k_{name}", F.sum("n").over(Window.partitionBy(*by)) - own)
        else:
            out = _with_bounded_level(out, cells, by, f"k_{name}", f)

    def mix(n, total, prior):
        return (c(f"k_{n}") + alpha * prior) / (c(f"k_{total}") + alpha)

    kind = mix("psg", "ps", mix("pcg", "pc", mix("pg", "p", c("k_g") / c("k__all"))))
    place = mix("pcgl", "pcg", mix("pgl", "pg", mix("gl", "g", F.lit(1.0 / 25))))
    pb = (kind * place + floor) / (1 + states.N_ACTIONS * floor)
    return out.select(*keys, (c("pitch_id") * 25 + c("loc_id")).alias("action_id"), c("n").cast("bigint").alias("n"), pb.alias("pb"))


# --- other frequency models -------------------------------------------------------

def behaviour_clone(train: DataFrame, queries: DataFrame, actor: str, context: Sequence[str], action: str, prior: float, minimum: int) -> DataFrame:
    """Probability of each query's action: context counts over the actor's supported actions plus
    `prior` pseudo-counts of the actor's own mix; unknown actors use the league's."""
    n_actor = train.groupBy(actor, action).agg(F.count("*").alias("_na"))
    n_league = train.groupBy(action).agg(F.count("*").alias("_nl"))
    known = n_actor.groupBy(actor).agg(F.coalesce(F.sum(F.when(c("_na") >= minimum, c("_na"))), F.lit(0)).alias("_sa"))
    league = n_league.agg(F.coalesce(F.sum(F.when(c("_nl") >= minimum, c("_nl"))), F.lit(0)).alias("_sl"))
    cells = train.groupBy(actor, *context, action).agg(F.count("*").alias("_nc"))
    legal = cells.join(n_actor.where(c("_na") >= minimum).drop("_na"), [actor, action], "left_semi")
    totals = legal.groupBy(actor, *context).agg(F.sum("_nc").alias("_sc"))
    out = queries.join(known, actor, "left").join(n_actor, [actor, action], "left").join(n_league, action, "left")
    out = with_row(out, league).join(legal, [actor, *context, action], "left").join(totals, [actor, *context], "left")
    zero = F.lit(0)
    fallback = c("_sa").isNull()
    n = F.when(fallback, F.coalesce("_nl", zero)).otherwise(F.coalesce("_na", zero))
    size = F.when(fallback, c("_sl")).otherwise(c("_sa"))
    ok = (n >= minimum) & (size > 0)
    freq = F.when(ok, n / size).when(size > 0, 0.0)
    own = F.when(fallback, zero).otherwise(F.coalesce("_nc", zero))
    total = F.when(fallback, zero).otherwise(F.coalesce("_sc", zero))
    bc = F.when(ok, (own + prior * freq) / (total + prior)).when(size > 0, 0.0)
    return out.withColumns({"fallback": fallback, "observed_supported": ok, "p_frequency": freq, "p_clone": bc}).drop("_sa", "_na", "_nl", "_sl", "_nc", "_sc")


def advancement(terminals: DataFrame, by: Sequence[str], outcome: Sequence[str]) -> DataFrame:
    """Share of every observed successor inside its cell, with the cell size."""
    n = terminals.groupBy(*by, *outcome).agg(F.count("*").alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("cell"))
    return n.join(total, list(by))


def additive_share(df: DataFrame, by: Sequence[str], label: str, n_classes: int, alpha: float) -> DataFrame:
    """(n + alpha) / (N + k * alpha) per group."""
    counts = roll_up(class_cells(df, by, label, n_classes), by, n_classes)
    return counts.select(*by, shrink(n_classes, 1.0 / n_classes, alpha * n_classes).alias("p"))


def partial_pool(df: DataFrame, base: str, layers: Sequence[tuple[str, str, float]]) -> Column:
    """Move `base` towards each layer's vector by n / (n + tau); a missing layer leaves it alone.

    Each layer is (vector column, size column, tau), coarser first.
    """
    out = c(base)
    for p, n, tau in layers:
        w = c(n) / (c(n) + F.lit(float(tau)))
        out = F.when(c(p).isNull(), out).otherwise(probs.blend(c(p), out, w))
    return out
