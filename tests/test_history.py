"""As-of features must not see the future, and must not depend on input order."""

import pandas as pd
from pyspark.sql import functions as F

from tallylane.keys import DEFAULT_KEYS as K
from tallylane.operators import asof, ordered
from tallylane.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def terminal():
    return F.coalesce(F.col("is_last") & (F.col("events") != "truncated_pa"), F.lit(False))


def rows(df, order):
    return df.orderBy(*order).toPandas()


def test_style_history_ignores_the_future(spark):
    log = Tables(spark, SF).log
    cut = "2024-01-15"
    changed = log.withColumn("description", F.when(F.col("game_date") >= cut, "hit_into_play").otherwise(F.col("description")))
    a = rows(asof.style_history(log, K, terminal()).where(F.col("game_date") <= cut), ["batter", "game_date"])
    b = rows(asof.style_history(changed, K, terminal()).where(F.col("game_date") <= cut), ["batter", "game_date"])
    pd.testing.assert_frame_equal(a, b)


def test_context_ignores_later_events_and_input_order(spark):
    log = Tables(spark, SF).log
    base = ordered.actor_context(log, K, ["event_id"], 8).select("event_id", "context")
    shuffled = ordered.actor_context(log.orderBy(F.sha2(F.col("event_id").cast("string"), 256)), K, ["event_id"], 8).select("event_id", "context")
    a, b = rows(base, ["event_id"]), rows(shuffled, ["event_id"])
    assert a["context"].tolist() == b["context"].tolist()
    assert all(t["event_id"] < e for e, ctx in zip(a["event_id"], a["context"]) for t in ctx)


def test_long_history_with_a_hot_entity(spark):
    """One entity owns a third of all episodes; compare with a plain loop."""
    log = Tables(spark, SF).log.withColumn("batter", F.when(F.col("at_bat_number") % 3 == 0, 1).otherwise(F.col("at_bat_number") + 10).cast("bigint"))
    got = {(r["game_pk"], r["at_bat_number"]): list(r["tokens"]) for r in asof.long_history(log, K, "event_id", 16).collect()}
    ev = log.select("game_pk", "at_bat_number", "pitch_number", "game_date", "batter", "event_id").toPandas().sort_values(["game_date", "game_pk", "at_bat_number", "pitch_number"])
    for (g, ab), part in ev.groupby(["game_pk", "at_bat_number"]):
        own = ev[ev.batter == part.batter.iloc[0]]
        dated = own[own.game_date < part.game_date.iloc[0]].event_id.tolist()
        here = own[(own.game_pk == g) & (own.at_bat_number < ab)].event_id.tolist()
        assert got[g, ab] == (dated + here)[-16:]
