"""Policies over sparse long value tables (actor, state, action, q)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylane.functions import states

c = F.col


def reward_next(delta: DataFrame) -> DataFrame:
    """Reward (minus expectancy change) and next state for every (state, outcome): 288 x 11 rows."""
    spark = delta.sparkSession
    i = c("id")
    grid = spark.range(states.N_COUNTS * states.N_BASE_OUT * states.N_OUTCOMES).select(states.idiv(i, states.N_OUTCOMES).alias("state_id"), (i % states.N_OUTCOMES).alias("outcome_id"))
    grid = grid.withColumns({"base_out_id": c("state_id") % states.N_BASE_OUT, "_nc": states.next_count(states.idiv(c("state_id"), states.N_BASE_OUT), c("outcome_id"))})
    out = grid.join(F.broadcast(delta.select("outcome_id", "base_out_id", "delta")), ["outcome_id", "base_out_id"], "left")
    return out.select("state_id", "outcome_id", F.coalesce(-c("delta"), F.lit(0.0)).alias("reward"), F.coalesce(c("_nc") * states.N_BASE_OUT + c("base_out_id"), F.lit(-1)).alias("next_state"))


def reward_arrays(rewards: DataFrame, n_actions: int) -> tuple[np.ndarray, np.ndarray]:
    """Reward (state, outcome) and next state, collected: states x outcomes rows, and x actions where the
    next state depends on the action (a column action_id).  Terminal outcomes have next state -1."""
    names = ["state_id", "outcome_id", "reward", "next_state"] + (["action_id"] if "action_id" in rewards.columns else [])
    rows = rewards.select(*names).toPandas()
    n, k = int(rows["state_id"].max()) + 1, int(rows["outcome_id"].max()) + 1
    reward, after = np.zeros((n, k)), np.full((n, k) if len(names) == 4 else (n, n_actions, k), -1, np.int64)
    reward[rows["state_id"], rows["outcome_id"]] = rows["reward"]
    after[tuple(rows[x] for x in (["state_id", "outcome_id"] if len(names) == 4 else ["state_id", "action_id", "outcome_id"]))] = rows["next_state"]
    if (after >= n).any():
        raise ValueError("a next state lies outside the states")
    return reward, after


def backup(p: np.ndarray, reward: np.ndarray, after: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Q (state, action) from outcome shares p (state, action, outcome) and the states' values."""
    gain = np.where(after >= 0, v[after], 0.0)
    if after.ndim == 2:
        return np.matmul(p, (reward + gain)[:, :, None])[:, :, 0]
    return (p * (reward[:, None, :] + gain)).sum(axis=2)


def iterate(p: np.ndarray, reward: np.ndarray, after: np.ndarray, value_of, tol: float = 1e-9, max_iter: int = 200) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Q, V, the number of sweeps and the last change; a change of `tol` or more after `max_iter` sweeps means not converged."""
    v = np.zeros(len(p))
    for sweep in range(1, max_iter + 1):
        q = backup(p, reward, after, v)
        new = value_of(q)
        change, v = float(np.abs(new - v).max()), new
        if change < tol:
            break
    return q, v, sweep, change


#: Value of a state from its actions' Q.
VALUES = {"optimal": lambda q: q.max(axis=1), "uniform": lambda q: q.mean(axis=1)}


def solve(factors: tuple[DataFrame, DataFrame, DataFrame], rewards: DataFrame, actor: str, alpha_actor: float, value: str = "optimal", tol: float = 1e-9, max_iter: int = 200) -> DataFrame:
    """Q and V per actor over all states and valid actions, from the factors of `freq.dirichlet_factors`.

    The league's cells and the rewards are bounded by the codecs (64,800 and 3,168 rows) and go to every task;
    an actor's probabilities are put together there, never as rows.  Columns: actor, state_id, action_id, q, v,
    n_actions, sweeps, change, for the actions that the actor has used in a state and the best one.
    """
    league, tilts, own = factors
    rows = league.toPandas()
    n_states, n_actions = states.N_COUNTS * states.N_BASE_OUT, states.N_ACTIONS
    cell = np.zeros((n_states, n_actions, states.N_OUTCOMES))
    cell[rows["state_id"], rows["action_id"]] = np.stack(rows["p"].to_numpy())
    reward, after = reward_arrays(rewards, n_actions)
    count = np.arange(n_states) // states.N_BASE_OUT
    names = [actor, "state_id", "action_id", "q", "v", "n_actions", "sweeps", "change"]

    def one(tilted, used):
        if not len(tilted):
            return tilted.iloc[:0].reindex(columns=names)
        tilt = np.zeros((states.N_COUNTS, n_actions // 25, states.N_OUTCOMES))
        tilt[tilted["count_id"], tilted["pitch_id"]] = np.stack(tilted["tilt"].to_numpy())
        valid = np.flatnonzero(np.isin(np.arange(n_actions) // 25, tilted["pitch_id"].unique()))
        p = cell[:, valid] * tilt[count][:, valid // 25]
        p /= p.sum(axis=2, keepdims=True)
        used = used[used["action_id"].isin(valid)]
        at = used["state_id"].to_numpy(), np.searchsorted(valid, used["action_id"].to_numpy())
        if len(used):
            # outcomes that a count does not allow have no share in the league's cell
            p[at] = alpha_actor * p[at] + np.stack(used["n"].to_numpy()) * (cell[used["state_id"], used["action_id"]] > 0)
            p[at] /= p[at].sum(axis=1, keepdims=True)
        q, v, sweeps, change = iterate(p, reward, after if after.ndim == 2 else after[:, valid], VALUES[value], tol, max_iter)
        shown = np.zeros(q.shape, bool)
        shown[at] = True
        shown[np.arange(len(q)), q.argmax(axis=1)] = True
        s, a = np.nonzero(shown)
        out = {actor: tilted[actor].iloc[0], "state_id": s, "action_id": valid[a], "q": q[s, a], "v": v[s], "n_actions": len(valid), "sweeps": sweeps, "change": change}
        return pd.DataFrame(out, columns=names)

    return tilts.groupBy(actor).cogroup(own.groupBy(actor)).applyInPandas(one, f"{actor} bigint, state_id bigint, action_id bigint, q double, v double, n_actions bigint, sweeps bigint, change double")


def _share(df: DataFrame, by: Sequence[str], weight: Column, output: str) -> DataFrame:
    w = Window.partitionBy(*by)
    out = df.withColumn("_w", weight)
    return out.withColumn(output, F.when(F.sum("_w").over(w) > 0, c("_w") / F.sum("_w").over(w)).otherwise(0.0)).drop("_w")


def relax(q: DataFrame, by: Sequence[str], method: str, temperature: float = 0.05, top_k: int = 5, output: str = "pi") -> DataFrame:
    """softmax / topk (ties at the k-th value kept) / greedy / uniform over the valid actions of a state."""
    w = Window.partitionBy(*by)
    if method == "softmax":
        weight = F.exp((c("q") - F.max("q").over(w)) / temperature)
    elif method == "topk":
        weight = (F.rank().over(w.orderBy(c("q").desc())) <= top_k).cast("double")
    elif method == "greedy":
        weight = (c("q") >= F.max("q").over(w)).cast("double")
    elif method == "uniform":
        weight = F.lit(1.0)
    else:
        raise ValueError(f"unknown method {method!r}")
    return _share(q, by, weight, output)


def tilt(table: DataFrame, by: Sequence[str], tau: float, support: Column | None = None, output: str = "pe") -> DataFrame:
    """pb * exp(q / tau) on the support, renormalised."""
    ok = F.lit(True) if support is None else support
    top = F.max(F.when(ok, c("q"))).over(Window.partitionBy(*by))
    return _share(table, by, F.when(ok, c("pb") * F.exp((c("q") - top) / tau)).otherwise(0.0), output)


def restrict(policy: DataFrame, support: DataFrame, by: Sequence[str], action: str = "action_id", prob: str = "pi") -> DataFrame:
    """Keep supported actions and renormalise inside the state."""
    kept = policy.join(support, [*by, action], "left_semi")
    w = Window.partitionBy(*by)
    return kept.withColumn(prob, F.when(F.sum(prob).over(w) > 0, c(prob) / F.sum(prob).over(w)).otherwise(0.0))
