"""An event log derived from the `events` table.

Clusters are blocks of 216 consecutive event ids: 18 half-periods of 12 events,
each with three episodes of 3, 4 and 5 events.  The keys are plain arithmetic on
`event_id`, so the only shuffle is one hash partitioning by cluster, and every
window partition holds at most 216 rows whatever the size of the table or the
skew of `user_id`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Type code by k % 16 (the last slot is null); events of a partition, whose sorts take about 2 KB of memory for each.
TYPE_CODES = ["FF", "FA", "SI", "FC", "SL", "SV", "ST", "CU", "KC", "CS", "CH", "FS", "FO", "KN", "PO"]
PARTITION_EVENTS = 50_000


def log_partitions(spark: SparkSession, n_events: int) -> int | None:
    """Partitions of at most about PARTITION_EVENTS events each, or None where the session's cores already divide the log so far.

    A number that is given is kept: without one, adaptive execution joins the session's partitions until there is one for each core,
    and a task's events grow with the table.
    """
    n = -(-n_events // PARTITION_EVENTS)
    return n if n > spark.sparkContext.defaultParallelism else None


def by_cluster(keyed: DataFrame, n_events: int) -> DataFrame:
    """Rows hashed by cluster, in as many partitions as the number of events asks for."""
    n = log_partitions(keyed.sparkSession, n_events)
    return keyed.repartition("game_pk") if n is None else keyed.repartition(n, "game_pk")


def event_log(events: DataFrame) -> DataFrame:
    e = F.expr
    keyed = events.select(
        "event_id", "ts", "user_id", "event_type",
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("k"),
        e("cast(round(value * 100) as bigint)").alias("vi"),
        e("event_id div 216").alias("game_pk"),
        e("(event_id % 216) div 12").alias("half"),
        e("event_id % 12").alias("q"),
    ).withColumns({
        "slot": e("case when q < 3 then 0 when q < 7 then 1 else 2 end").cast("bigint"),
        "pitch_number": e("q - case when q < 3 then 0 when q < 7 then 3 else 7 end + 1"),
        "is_last": e("q in (2, 6, 11)"),
    }).withColumns({
        "at_bat_number": e("half * 3 + slot + 1"),
        "inning": e("half div 2 + 1"),
        "inning_topbot": e("case when half % 2 = 0 then 'Top' else 'Bot' end"),
        "outs_when_up": e("slot"),
        "pitcher": e("(game_pk * 7 + (half % 2) * 3 + (half div 12) * 5) % 40 + 100"),
        "events": e("""case when not is_last then null
            when k % 20 < 6 then 'field_out' when k % 20 = 6 then 'grounded_into_double_play'
            when k % 20 = 7 then 'sac_fly' when k % 20 < 11 then 'strikeout' when k % 20 < 13 then 'walk'
            when k % 20 = 13 then 'hit_by_pitch' when k % 20 < 16 then 'single' when k % 20 = 16 then 'double'
            when k % 20 = 17 then 'triple' when k % 20 = 18 then 'home_run'
            when k = 99 then 'truncated_pa' when k = 79 then 'catcher_interf' else 'field_error' end"""),
    }).withColumn("description", e("""case
            when is_last and k % 20 in (8, 9, 10) then case when k = 28 then 'foul_bunt' when k % 3 = 0 then 'called_strike' else 'swinging_strike' end
            when is_last and k % 20 in (11, 12) then case when k = 92 then 'automatic_ball' else 'ball' end
            when is_last and k % 20 = 13 then 'hit_by_pitch'
            when is_last and k = 99 then 'ball'
            when is_last then 'hit_into_play'
            when event_type in ('click', 'purchase') then case when k = 50 then 'intent_ball' when k = 51 then 'pitchout' else 'ball' end
            when event_type = 'view' then case when k % 10 = 7 then 'foul_tip' else 'called_strike' end
            when event_type = 'error' then case when k = 33 then 'foul_bunt' else 'foul' end
            when k = 44 then 'unlisted' when k = 45 then 'automatic_strike'
            when k % 10 = 9 then 'swinging_strike_blocked' else 'swinging_strike' end"""))
    keyed = keyed.withColumns({
        "runs": e("case when events = 'home_run' then 1 + k % 3 when events in ('single', 'double', 'triple') then k % 2 else 0 end"),
        "is_ball": e("cast(description in ('ball', 'intent_ball', 'pitchout', 'automatic_ball') as bigint)"),
        "is_strike": e("cast(description in ('called_strike', 'swinging_strike', 'swinging_strike_blocked', 'foul_tip', 'foul', 'foul_bunt', 'automatic_strike') as bigint)"),
        "pitch_type": F.element_at(F.array(*[F.lit(c) for c in TYPE_CODES], F.lit(None).cast("string")), (F.col("k") % 16 + 1).cast("int")),
    })
    game = Window.partitionBy("game_pk")
    game_prior = game.orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    pa = Window.partitionBy("game_pk", "at_bat_number").orderBy("pitch_number")
    pa_prior = pa.rowsBetween(Window.unboundedPreceding, -1)
    log = by_cluster(keyed, events.count()).withColumns({
        "game_date": F.to_date(F.min("ts").over(game)),
        "away_run": F.coalesce(F.sum(e("case when half % 2 = 0 then runs else 0 end")).over(game_prior), F.lit(0)),
        "home_run_": F.coalesce(F.sum(e("case when half % 2 = 1 then runs else 0 end")).over(game_prior), F.lit(0)),
        "k0": F.first("k").over(pa),
        "u0": F.first("user_id").over(pa),
        "balls": F.least(F.lit(3), F.coalesce(F.sum("is_ball").over(pa_prior), F.lit(0))),
        "strikes": F.least(F.lit(2), F.coalesce(F.sum("is_strike").over(pa_prior), F.lit(0))),
    }).withColumns({
        "batter": e("case when (game_pk + at_bat_number) % 37 = 0 then user_id else u0 end"),
        "mask": e("case when k % 23 = 0 then k else k0 end % 8"),
    })
    return log.selectExpr(
        "event_id", "ts", "user_id", "event_type", "k", "vi", "game_pk", "at_bat_number", "pitch_number",
        "game_date", "2021 + cast(day(game_date) as bigint) div 8 as season",
        "case when game_pk % 11 = 10 then 'S' else 'R' end as game_type",
        "concat('T', game_pk % 6) as home_team", "concat('T', (game_pk + 1 + (game_pk div 6) % 5) % 6) as away_team",
        "half", "inning", "inning_topbot", "outs_when_up", "is_last", "pitcher", "concat('P', pitcher) as player_name", "batter",
        "case when batter % 3 = 0 then 'L' else 'R' end as stand", "case when pitcher % 4 = 0 then 'L' else 'R' end as p_throws",
        "balls", "strikes", "description", "events", "pitch_type", "runs",
        "case when mask % 2 = 1 then batter + 1 end as on_1b", "case when mask div 2 % 2 = 1 then batter + 2 end as on_2b",
        "case when mask div 4 = 1 then batter + 3 end as on_3b",
        "home_run_ - case when k = 13 and home_run_ > 0 then 1 else 0 end as home_score", "away_run as away_score",
        "home_run_ + case when half % 2 = 1 then runs else 0 end as post_home_score",
        "away_run + case when half % 2 = 0 then runs else 0 end as post_away_score",
        "case when half % 2 = 0 then away_run else home_run_ end as bat_score",
        "case when half % 2 = 0 then home_run_ else away_run end as fld_score",
        "case when half % 2 = 0 then away_run else home_run_ end + runs as post_bat_score",
        "case when k % 17 <> 0 then (vi % 401) / 100.0D - 2.0D end as plate_x",
        "case when k % 17 <> 0 then (vi * 7 % 500) / 100.0D - 0.5D end as plate_z",
        "3.3D + (batter % 7) / 20.0D as sz_top", "1.5D + (batter % 5) / 20.0D as sz_bot",
        "case when k % 19 <> 0 then 78.0D + (vi * 3 % 220) / 10.0D end as release_speed",
        "case when k % 7 <> 0 then 78.0D + (vi * 5 % 220) / 10.0D end as effective_speed",
        "1800.0D + vi * 11 % 900 as release_spin_rate", "cast(vi * 13 % 360 as double) as spin_axis",
        "(vi * 17 % 300) / 100.0D - 1.5D as pfx_x", "(vi * 19 % 300) / 100.0D - 1.5D as pfx_z",
        "vi % 14 + 1 as zone",
        "case when description = 'hit_into_play' then 60.0D + (vi * 23 % 550) / 10.0D end as launch_speed",
        "case when description = 'hit_into_play' and k % 13 <> 0 then cast(vi * 29 % 90 - 30 as double) end as launch_angle",
        """case when description = 'hit_into_play' and k <> 60 then case when vi * 29 % 90 - 30 < 10 then 'ground_ball'
             when vi * 29 % 90 - 30 < 25 then 'line_drive' when vi * 29 % 90 - 30 < 50 then 'fly_ball' else 'popup' end end as bb_type""",
    )


LOG_CTE = """
raw0 AS (
  SELECT event_id, ts, user_id, event_type,
    CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS vi,
    event_id // 216 AS game_pk, (event_id % 216) // 12 AS half, event_id % 12 AS q
  FROM events),
raw1 AS (
  SELECT *, CAST(CASE WHEN q < 3 THEN 0 WHEN q < 7 THEN 1 ELSE 2 END AS BIGINT) AS slot,
    q - CASE WHEN q < 3 THEN 0 WHEN q < 7 THEN 3 ELSE 7 END + 1 AS pitch_number, q IN (2, 6, 11) AS is_last FROM raw0),
raw2 AS (
  SELECT *, half * 3 + slot + 1 AS at_bat_number, half // 2 + 1 AS inning,
    CASE WHEN half % 2 = 0 THEN 'Top' ELSE 'Bot' END AS inning_topbot, slot AS outs_when_up,
    (game_pk * 7 + (half % 2) * 3 + (half // 12) * 5) % 40 + 100 AS pitcher,
    CASE WHEN NOT is_last THEN NULL
      WHEN k % 20 < 6 THEN 'field_out' WHEN k % 20 = 6 THEN 'grounded_into_double_play'
      WHEN k % 20 = 7 THEN 'sac_fly' WHEN k % 20 < 11 THEN 'strikeout' WHEN k % 20 < 13 THEN 'walk'
      WHEN k % 20 = 13 THEN 'hit_by_pitch' WHEN k % 20 < 16 THEN 'single' WHEN k % 20 = 16 THEN 'double'
      WHEN k % 20 = 17 THEN 'triple' WHEN k % 20 = 18 THEN 'home_run'
      WHEN k = 99 THEN 'truncated_pa' WHEN k = 79 THEN 'catcher_interf' ELSE 'field_error' END AS events,
    CASE
      WHEN is_last AND k % 20 IN (8, 9, 10) THEN CASE WHEN k = 28 THEN 'foul_bunt' WHEN k % 3 = 0 THEN 'called_strike' ELSE 'swinging_strike' END
      WHEN is_last AND k % 20 IN (11, 12) THEN CASE WHEN k = 92 THEN 'automatic_ball' ELSE 'ball' END
      WHEN is_last AND k % 20 = 13 THEN 'hit_by_pitch'
      WHEN is_last AND k = 99 THEN 'ball'
      WHEN is_last THEN 'hit_into_play'
      WHEN event_type IN ('click', 'purchase') THEN CASE WHEN k = 50 THEN 'intent_ball' WHEN k = 51 THEN 'pitchout' ELSE 'ball' END
      WHEN event_type = 'view' THEN CASE WHEN k % 10 = 7 THEN 'foul_tip' ELSE 'called_strike' END
      WHEN event_type = 'error' THEN CASE WHEN k = 33 THEN 'foul_bunt' ELSE 'foul' END
      WHEN k = 44 THEN 'unlisted' WHEN k = 45 THEN 'automatic_strike'
      WHEN k % 10 = 9 THEN 'swinging_strike_blocked' ELSE 'swinging_strike' END AS description
  FROM raw1),
raw3 AS (
  SELECT *, CASE WHEN events = 'home_run' THEN 1 + k % 3 WHEN events IN ('single', 'double', 'triple') THEN k % 2 ELSE 0 END AS runs,
    CAST(description IN ('ball', 'intent_ball', 'pitchout', 'automatic_ball') AS BIGINT) AS is_ball,
    CAST(description IN ('called_strike', 'swinging_strike', 'swinging_strike_blocked', 'foul_tip', 'foul', 'foul_bunt', 'automatic_strike') AS BIGINT) AS is_strike,
    ['FF','FA','SI','FC','SL','SV','ST','CU','KC','CS','CH','FS','FO','KN','PO',NULL][k % 16 + 1] AS pitch_type
  FROM raw2),
raw4 AS (
  SELECT *, CAST(min(ts) OVER (PARTITION BY game_pk) AS DATE) AS game_date,
    CAST(coalesce(sum(CASE WHEN half % 2 = 0 THEN runs ELSE 0 END) OVER gp, 0) AS BIGINT) AS away_run,
    CAST(coalesce(sum(CASE WHEN half % 2 = 1 THEN runs ELSE 0 END) OVER gp, 0) AS BIGINT) AS home_run_,
    first_value(k) OVER pa AS k0, first_value(user_id) OVER pa AS u0,
    least(3, CAST(coalesce(sum(is_ball) OVER pp, 0) AS BIGINT)) AS balls, least(2, CAST(coalesce(sum(is_strike) OVER pp, 0) AS BIGINT)) AS strikes
  FROM raw3
  WINDOW gp AS (PARTITION BY game_pk ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    pa AS (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number),
    pp AS (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
raw5 AS (
  SELECT *, CASE WHEN (game_pk + at_bat_number) % 37 = 0 THEN user_id ELSE u0 END AS batter,
    CASE WHEN k % 23 = 0 THEN k ELSE k0 END % 8 AS mask FROM raw4),
log AS (
  SELECT event_id, ts, user_id, event_type, k, vi, game_pk, at_bat_number, pitch_number,
    game_date, 2021 + day(game_date) // 8 AS season, CASE WHEN game_pk % 11 = 10 THEN 'S' ELSE 'R' END AS game_type,
    'T' || (game_pk % 6) AS home_team, 'T' || ((game_pk + 1 + (game_pk // 6) % 5) % 6) AS away_team,
    half, inning, inning_topbot, outs_when_up, is_last, pitcher, 'P' || pitcher AS player_name, batter,
    CASE WHEN batter % 3 = 0 THEN 'L' ELSE 'R' END AS stand, CASE WHEN pitcher % 4 = 0 THEN 'L' ELSE 'R' END AS p_throws,
    balls, strikes, description, events, pitch_type, runs,
    CASE WHEN mask % 2 = 1 THEN batter + 1 END AS on_1b, CASE WHEN mask // 2 % 2 = 1 THEN batter + 2 END AS on_2b,
    CASE WHEN mask // 4 = 1 THEN batter + 3 END AS on_3b,
    home_run_ - CASE WHEN k = 13 AND home_run_ > 0 THEN 1 ELSE 0 END AS home_score, away_run AS away_score,
    home_run_ + CASE WHEN half % 2 = 1 THEN runs ELSE 0 END AS post_home_score,
    away_run + CASE WHEN half % 2 = 0 THEN runs ELSE 0 END AS post_away_score,
    CASE WHEN half % 2 = 0 THEN away_run ELSE home_run_ END AS bat_score,
    CASE WHEN half % 2 = 0 THEN home_run_ ELSE away_run END AS fld_score,
    CASE WHEN half % 2 = 0 THEN away_run ELSE home_run_ END + runs AS post_bat_score,
    CASE WHEN k % 17 <> 0 THEN (vi % 401) / CAST(100.0 AS DOUBLE) - CAST(2.0 AS DOUBLE) END AS plate_x,
    CASE WHEN k % 17 <> 0 THEN (vi * 7 % 500) / CAST(100.0 AS DOUBLE) - CAST(0.5 AS DOUBLE) END AS plate_z,
    CAST(3.3 AS DOUBLE) + (batter % 7) / CAST(20.0 AS DOUBLE) AS sz_top, CAST(1.5 AS DOUBLE) + (batter % 5) / CAST(20.0 AS DOUBLE) AS sz_bot,
    CASE WHEN k % 19 <> 0 THEN CAST(78.0 AS DOUBLE) + (vi * 3 % 220) / CAST(10.0 AS DOUBLE) END AS release_speed,
    CASE WHEN k % 7 <> 0 THEN CAST(78.0 AS DOUBLE) + (vi * 5 % 220) / CAST(10.0 AS DOUBLE) END AS effective_speed,
    CAST(1800.0 AS DOUBLE) + vi * 11 % 900 AS release_spin_rate, CAST(vi * 13 % 360 AS DOUBLE) AS spin_axis,
    (vi * 17 % 300) / CAST(100.0 AS DOUBLE) - CAST(1.5 AS DOUBLE) AS pfx_x, (vi * 19 % 300) / CAST(100.0 AS DOUBLE) - CAST(1.5 AS DOUBLE) AS pfx_z,
    vi % 14 + 1 AS zone,
    CASE WHEN description = 'hit_into_play' THEN CAST(60.0 AS DOUBLE) + (vi * 23 % 550) / CAST(10.0 AS DOUBLE) END AS launch_speed,
    CASE WHEN description = 'hit_into_play' AND k % 13 <> 0 THEN CAST(vi * 29 % 90 - 30 AS DOUBLE) END AS launch_angle,
    CASE WHEN description = 'hit_into_play' AND k <> 60 THEN CASE WHEN vi * 29 % 90 - 30 < 10 THEN 'ground_ball'
      WHEN vi * 29 % 90 - 30 < 25 THEN 'line_drive' WHEN vi * 29 % 90 - 30 < 50 THEN 'fly_ball' ELSE 'popup' END END AS bb_type
  FROM raw5)
"""
