"""Aggregate tables: run expectancy, seasons, qualification, reports and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylane.functions import codes, states
from tallylane.functions.quantiles import cumulative_counts, exact_quantiles, with_row
from tallylane.keys import LogKeys
from tallylane.operators import ordered

c = F.col

# --- Fixed values -----------------------------------------------------------
TERMINAL_OUTCOMES = tuple(range(3, 11))
NOT_AN_APPEARANCE = ("truncated_pa",)
NO_AT_BAT = ("walk", "intent_walk", "hit_by_pitch", "sac_fly", "sac_fly_double_play", "sac_bunt", "sac_bunt_double_play", "catcher_interf")
SAC_FLY = ("sac_fly", "sac_fly_double_play")
# ----------------------------------------------------------------------------


# --- run expectancy -----------------------------------------------------------

def expectancy_episodes(log: DataFrame, keys: LogKeys, drop_last_half: bool = True) -> DataFrame:
    """Episodes with start/end state, runs and runs to the end of the half."""
    ep = ordered.episodes(log, keys, ["base_out_id", "bat_score"], ["base_out_id", "outcome_id", "bat_score", "post_bat_score"], [keys.period, keys.side])
    half, whole = Window.partitionBy(*keys.half), Window.partitionBy(keys.cluster)
    order = whole.orderBy(keys.episode).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ep = ep.withColumns({
        "half_end": F.max("last_post_bat_score").over(half),
        "_lp": F.max(keys.period).over(whole), "_ls": F.last(keys.side).over(order)})
    ep = ep.withColumn("in_last_half", (c(keys.period) == c("_lp")) & (c(keys.side) == c("_ls"))).drop("_lp", "_ls")
    if drop_last_half:
        ep = ep.where(~c("in_last_half"))
    nxt = Window.partitionBy(keys.cluster).orderBy(keys.episode)
    same = (F.lead(keys.period).over(nxt) == c(keys.period)) & (F.lead(keys.side).over(nxt) == c(keys.side))
    return ep.withColumns({"runs_to_end": (c("half_end") - c("first_bat_score")).cast("double"), "next_base_out": F.when(same, F.lead("first_base_out_id").over(nxt))})


def run_expectancy(ep: DataFrame) -> DataFrame:
    """Mean runs to the end of the half by start state, all 24 states (0 without a sample)."""
    seen = ep.groupBy(c("first_base_out_id").alias("base_out_id")).agg(F.avg("runs_to_end").alias("re"), F.count("*").alias("n"))
    grid = ep.sparkSession.range(states.N_BASE_OUT).withColumnRenamed("id", "base_out_id")
    return seen.join(grid, "base_out_id", "right").fillna(0.0, ["re"]).fillna(0, ["n"])


def expectancy_change(ep: DataFrame, table: DataFrame) -> DataFrame:
    """Attach the change of expectancy over the play (the 24-row table is broadcast)."""
    t = F.broadcast(table.select(c("base_out_id").alias("_b"), c("re").alias("_re")))
    out = ep.join(t.withColumnsRenamed({"_b": "last_base_out_id", "_re": "re_here"}), "last_base_out_id", "left")
    out = out.join(t.withColumnsRenamed({"_b": "next_base_out", "_re": "re_next"}), "next_base_out", "left")
    return out.withColumn("delta", F.coalesce("re_next", F.lit(0.0)) + (c("last_post_bat_score") - c("last_bat_score")) - c("re_here"))


def delta_expectancy(changed: DataFrame) -> DataFrame:
    """Mean change by terminal outcome and state over the full 8 x 24 grid, null without a sample."""
    seen = changed.where(c("last_outcome_id") >= 3).groupBy(c("last_outcome_id").alias("outcome_id"), c("last_base_out_id").alias("base_out_id")).agg(F.avg("delta").alias("delta"), F.count("*").alias("n"))
    i = c("id")
    grid = changed.sparkSession.range(len(TERMINAL_OUTCOMES) * states.N_BASE_OUT).select((states.idiv(i, states.N_BASE_OUT) + 3).alias("outcome_id"), (i % states.N_BASE_OUT).alias("base_out_id"))
    return seen.join(grid, ["outcome_id", "base_out_id"], "right").fillna(0, ["n"])


def episode_rewards(log: DataFrame, keys: LogKeys, table: DataFrame) -> DataFrame:
    """Realised change of expectancy per episode from its first event, with event and actor counts."""
    ep = ordered.episodes(log, keys, ["base_out_id", "bat_score", keys.actor], ["post_bat_score", "outcome_id"], [keys.period, keys.side])
    actors = log.groupBy(*keys.episode_key).agg(F.countDistinct(keys.actor).alias("n_actors"))
    nxt = Window.partitionBy(keys.cluster).orderBy(keys.episode)
    same = (F.lead(keys.period).over(nxt) == c(keys.period)) & (F.lead(keys.side).over(nxt) == c(keys.side))
    ep = ep.join(actors, keys.episode_key).withColumns({"_nb": F.when(same, F.lead("first_base_out_id").over(nxt)), "runs": c("last_post_bat_score") - c("first_bat_score")})
    t = F.broadcast(table.select(c("base_out_id").alias("_b"), c("re").alias("_re")))
    ep = ep.join(t.withColumnsRenamed({"_b": "first_base_out_id", "_re": "_here"}), "first_base_out_id", "left").join(t.withColumnsRenamed({"_b": "_nb", "_re": "_next"}), "_nb", "left")
    return ep.withColumn("delta_re", F.coalesce("_next", F.lit(0.0)) + c("runs") - c("_here")).drop("_nb", "_here", "_next")


# --- seasons --------------------------------------------------------------------

def season_table(log: DataFrame, keys: LogKeys, season: str) -> DataFrame:
    """Actor x season: events, events with a code, outs, clusters, starts."""
    first = ordered.episodes(log, keys, ["outs_when_up", keys.actor], ["outs_when_up"], [keys.period, keys.side, season])
    nxt = Window.partitionBy(keys.cluster).orderBy(keys.episode)
    same = (F.lead(keys.period).over(nxt) == c(keys.period)) & (F.lead(keys.side).over(nxt) == c(keys.side))
    half = Window.partitionBy(*keys.half).orderBy(keys.episode)
    first = first.withColumns({
        "outs": F.when(same, F.lead("first_outs_when_up").over(nxt) - c("first_outs_when_up")).otherwise(3 - c("first_outs_when_up")),
        "start": ((c(keys.period) == 1) & (F.row_number().over(half) == 1)).cast("int")})
    ep = first.groupBy(c(f"first_{keys.actor}").alias(keys.actor), season).agg(F.sum("outs").alias("outs"), F.countDistinct(keys.cluster).alias("clusters"), F.sum("start").alias("starts"))
    ev = log.groupBy(keys.actor, season).agg(F.count("*").alias("events"), F.count("pitch_type").alias("events_coded"))
    out = ev.join(ep, [keys.actor, season], "left").fillna(0, ["outs", "clusters", "starts"])
    return out.withColumn("ip", c("outs") / 3.0)


def qualification_pool(table: DataFrame, actor: str, season: str, seasons: Sequence[int], minimum: float) -> DataFrame:
    """Actors that reach the minimum in any season, with one flag per season."""
    q = table.withColumn("_q", c("ip") >= minimum)
    flags = [F.coalesce(F.max(F.when(c(season) == s, c("_q"))), F.lit(False)).alias(f"q{s}") for s in seasons]
    out = q.groupBy(actor).agg(
        F.count_if("_q").alias("seasons_qualified"), F.countDistinct(season).alias("seasons_present"), F.sum("events").alias("events_total"),
        F.sum("ip").alias("ip_total"), F.sum("starts").alias("starts_total"), *flags)
    return out.where("seasons_qualified > 0")


def threshold_sweep(table: DataFrame, actor: str, season: str, thresholds: Sequence[float]) -> DataFrame:
    """How many actors pass each threshold, per season and in any season (season null)."""
    t = table.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds]))).where(c("ip") >= c("threshold"))
    return t.groupingSets([["threshold", season], ["threshold"]], "threshold", season).agg(F.countDistinct(actor).alias("actors"))


def style_table(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ten guarded style rates per entity and side.

    Speeds have decimals that doubles only come near: they are summed as decimals, so that their mean does not depend on the order
    of the rows (as doubles only where one of a group is no number of up to 18 digits before the point).
    """
    d, e = c("description"), c("events")
    swing, contact = d.isin(*codes.SWING), d.isin(*codes.CONTACT)
    out_zone = F.coalesce(c("zone") >= 11, F.lit(False))
    in_play = d == "hit_into_play"

    def n(cond):
        return F.sum(F.coalesce(cond, F.lit(False)).cast("int"))

    def rate(num, den):
        return n(num) / F.greatest(n(den), F.lit(1))

    pa, exact, known = e.isNotNull(), c("launch_speed").try_cast("decimal(24,6)"), F.count("launch_speed")
    speed = F.when(F.count(exact) == known, F.sum(exact).cast("double") / F.nullif(known, F.lit(0).cast("long"))).otherwise(F.avg("launch_speed"))
    return log.groupBy(*by).agg(
        F.count("*").alias("n_events"), n(pa).alias("n_pa"),
        rate(e.isin(*codes.K_EVENTS), pa).alias("k_rate"), rate(e.isin(*codes.BB_EVENTS), pa).alias("bb_rate"),
        F.avg(F.coalesce(swing, F.lit(False)).cast("double")).alias("swing_rate"), rate(swing & out_zone, out_zone).alias("chase_rate"),
        rate(contact, swing).alias("contact_rate"), rate(c("bb_type") == "ground_ball", in_play).alias("gb_rate"),
        rate(c("bb_type").isin("fly_ball", "popup"), in_play).alias("fb_rate"), rate(in_play & (c("launch_speed") >= 95), in_play).alias("hard_rate"),
        F.avg("launch_angle").alias("avg_launch_angle"), speed.alias("avg_launch_speed"))


def season_line(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Batting line of the last recorded event per episode: PA, K%, HR%, ISO, AVG, OPS."""
    e = c("events")
    ev = log.where(e.isNotNull() & ~e.isin(*NOT_AN_APPEARANCE))
    tb = F.when(e == "single", 1).when(e == "double", 2).when(e == "triple", 3).when(e == "home_run", 4).otherwise(0)
    s = ev.groupBy(*by).agg(
        F.count("*").alias("pa"), F.count_if(e.isin(*codes.K_EVENTS)).alias("k"), F.count_if(e.isin(*codes.BB_EVENTS)).alias("bb"), F.count_if(e == "hit_by_pitch").alias("hbp"),
        F.count_if(e.isin(*SAC_FLY)).alias("sf"), F.count_if(~e.isin(*NO_AT_BAT)).alias("ab"), F.count_if(tb > 0).alias("h"), F.count_if(e == "home_run").alias("hr"), F.sum(tb).alias("tb"))
    avg = F.when(c("ab") > 0, c("h") / c("ab")).otherwise(0.0)
    slg = F.when(c("ab") > 0, c("tb") / c("ab")).otherwise(0.0)
    den = c("ab") + c("bb") + c("hbp") + c("sf")
    obp = F.when(den > 0, (c("h") + c("bb") + c("hbp")) / den).otherwise(0.0)
    return s.select(*by, "pa", (c("k") / c("pa")).alias("k_pct"), (c("hr") / c("pa")).alias("hr_pct"), (slg - avg).alias("iso"), avg.alias("avg"), (obp + slg).alias("ops"))


LINE_COLUMNS = ("k_pct", "hr_pct", "iso", "avg", "ops")


def previous_season(rows: DataFrame, line: DataFrame, entity: str, season: str, min_pa: int) -> DataFrame:
    """Last season's line when it has enough appearances, else that season's qualified mean, with a missing flag."""
    past = line.withColumn(season, c(season) + 1)
    own = past.where(c("pa") >= min_pa).select(entity, season, *[c(x).alias(f"_o_{x}") for x in LINE_COLUMNS])
    any_q = F.max((c("pa") >= min_pa).cast("int"))
    mean = past.groupBy(season).agg(*[
        F.when(any_q == 1, F.avg(F.when(c("pa") >= min_pa, c(x)))).otherwise(F.avg(x)).alias(f"_l_{x}") for x in LINE_COLUMNS])
    out = rows.join(own, [entity, season], "left").join(F.broadcast(mean), season, "left")
    missing = c(f"_o_{LINE_COLUMNS[0]}").isNull()
    return out.select(*rows.columns, *[F.coalesce(f"_o_{x}", f"_l_{x}", F.lit(0.0)).alias(f"prev_{x}") for x in LINE_COLUMNS], missing.alias("prev_missing"))


# --- support, concentration, cards ------------------------------------------------

def support_census(df: DataFrame, sets: Sequence[Sequence[str]], keys: LogKeys, min_events: int, min_clusters: int) -> DataFrame:
    """Events, clusters and actors for every level of every grouping set, with a reporting gate."""
    cols = list(dict.fromkeys(x for s in sets for x in s))
    out = df.groupingSets([list(s) for s in sets], *cols).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("events"), F.countDistinct(keys.cluster).alias("clusters"), F.countDistinct(keys.actor).alias("actors"))
    return out.withColumn("supported", (c("clusters") >= min_clusters) & (c("events") >= min_events)).drop("_g")


def group_report(df: DataFrame, role: str, actor: str, cluster: str, p: str, supported: str) -> DataFrame:
    """Overall x role x actor: conditional action NLL over supported rows, and the counts behind it."""
    loss = F.when(c(supported), -F.log(c(p)))
    out = df.groupingSets([[], [role], [role, actor]], role, actor).agg(
        F.count("*").alias("requested"), F.countDistinct(cluster).alias("clusters"), F.count_if(supported).alias("n_supported"), F.avg(loss).alias("conditional_nll"))
    return out.withColumn("full_nll", F.when(c("n_supported") == c("requested"), c("conditional_nll")))


def concentration(df: DataFrame, by: Sequence[str], observed: str, advised: str) -> DataFrame:
    """Observed against advised mix: HHI, maximum share, entropy, total variation, matches."""
    both = df.withColumn("_m", (c(observed) == c(advised)).cast("int"))
    pairs = both.groupBy(*by, observed, advised).agg(F.count("*").alias("_n"), F.sum("_m").alias("_m"))
    long = pairs.withColumn("_x", F.explode(F.array(
        F.struct(F.col(observed).alias("code"), c("_n").alias("a"), F.lit(0).cast("bigint").alias("b")),
        F.struct(F.col(advised).alias("code"), F.lit(0).cast("bigint").alias("a"), c("_n").alias("b"))))).select(*by, "_m", "_x.*")
    per = long.groupBy(*by, "code").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.when(c("a") > 0, c("_m")).otherwise(0)).alias("_m"))
    w = Window.partitionBy(*by)
    per = per.withColumns({"_t": F.sum("a").over(w)}).withColumns({"sa": c("a") / c("_t"), "sb": c("b") / c("_t")})

    def entropy(s):
        return -F.sum(F.when(c(s) > 0, c(s) * F.log(c(s))).otherwise(0.0))

    return per.groupBy(*by).agg(
        F.max("_t").alias("events"), F.sum(c("sa") * c("sa")).alias("observed_hhi"), F.sum(c("sb") * c("sb")).alias("advised_hhi"),
        F.max("sa").alias("observed_max"), F.max("sb").alias("advised_max"), entropy("sa").alias("observed_entropy"), entropy("sb").alias("advised_entropy"),
        (F.sum(F.abs(c("sa") - c("sb"))) / 2).alias("total_variation"), F.sum("_m").alias("matches"))


def whole_percents(counts: DataFrame, by: Sequence[str], item: str, n: str = "n") -> DataFrame:
    """Integer percents by largest remainder; equal counts always get equal percents, so a tie that
    would be split by the last points gets none of them."""
    w = Window.partitionBy(*by)
    out = counts.withColumn("_t", F.sum(n).over(w)).withColumns({"_f": F.floor(c(n) * 100 / c("_t")), "_r": (c(n) * 100) % c("_t")})
    order = w.orderBy(c("_r").desc(), c(n).desc())
    out = out.withColumns({"_left": 100 - F.sum("_f").over(w)})
    # the default range frame counts whole tie groups up to and including this one
    out = out.withColumn("_used", F.count("*").over(order))
    ok = (c("_r") > 0) & (c("_used") <= c("_left"))
    return out.withColumn("percent", (c("_f") + ok.cast("int")).cast("bigint")).drop("_t", "_f", "_r", "_left", "_used")


def reference_card(log: DataFrame, cell: Sequence[str], broad: Sequence[str], item: str, minimum: int, min_share: float, max_items: int) -> DataFrame:
    """Top items of every cell with whole percents; a small cell falls back to the broader one."""
    fine = log.groupBy(*cell, item).agg(F.count("*").alias("n"))
    size = fine.groupBy(*cell).agg(F.sum("n").alias("_cell"))
    wide = fine.groupBy(*broad, item).agg(F.sum("n").alias("n"))
    wide_size = wide.groupBy(*broad).agg(F.sum("n").alias("_broad"))
    small = size.where(c("_cell") < minimum).join(wide_size, list(broad)).where(c("_broad") >= minimum)
    own = fine.join(size.where(c("_cell") >= minimum), list(cell)).select(*cell, item, "n", F.lit("cell").alias("scope"))
    lent = small.join(wide, list(broad)).select(*cell, item, "n", F.lit("broad").alias("scope"))
    card = whole_percents(own.unionByName(lent), list(cell), item)
    total = Window.partitionBy(*cell)
    card = card.withColumns({"_t": F.sum("n").over(total), "rank": F.row_number().over(total.orderBy(c("n").desc(), item))})
    return card.withColumn("share", c("n") / c("_t")).where((c("share") >= min_share) & (c("rank") <= max_items)).drop("_t")


def kernel_zones(draws: DataFrame, by: Sequence[str], x: str, z: str, zones: Sequence[tuple[int, float, float]], sigma: float, min_ess: float, min_mass: float) -> DataFrame:
    """Gaussian mass and effective sample size of pooled draws around every zone target.

    The zones are a literal array (a handful of rows), so each draw is expanded and
    aggregated map-side; weights are relative to the closest draw as usual for ESS,
    which cancels in the ratio.
    """
    z_arr = F.array(*[F.struct(F.lit(i).alias("zone"), F.lit(tx).alias("tx"), F.lit(tz).alias("tz")) for i, tx, tz in zones])
    d = draws.withColumn("_z", F.explode(z_arr)).select(*by, x, z, "_z.*")
    w = F.exp(-((c(x) - c("tx")) * (c(x) - c("tx")) + (c(z) - c("tz")) * (c(z) - c("tz"))) / (2 * sigma * sigma))
    out = d.withColumn("_w", w).groupBy(*by, "zone").agg(F.avg("_w").alias("mass"), (F.sum("_w") * F.sum("_w") / F.sum(c("_w") * c("_w"))).alias("ess"), F.count("*").alias("draws"))
    return out.withColumn("supported", (c("ess") >= min_ess) & (c("mass") >= min_mass))


def best_zone(zones: DataFrame, by: Sequence[str]) -> DataFrame:
    return zones.where("supported").groupBy(*by).agg(F.max_by(F.struct("zone", "mass", "ess"), F.struct("mass", "zone")).alias("_b")).select(*by, "_b.*")


def sample_weights(df: DataFrame, target: Column, similarity: Column, alpha: float, beta: float) -> DataFrame:
    """1 + alpha on target rows, 1 + beta * similarity elsewhere, scaled to mean 1."""
    raw = df.withColumn("_raw", 1 + F.when(target, F.lit(alpha)).otherwise(beta * similarity))
    mean = raw.agg(F.avg("_raw").alias("_mean"))
    return with_row(raw, mean).withColumn("weight", c("_raw") / c("_mean")).drop("_raw", "_mean")


def mass_audit(weighted: DataFrame, ids: Mapping[str, str], weight: str = "weight") -> DataFrame:
    """Effective sample share, and the largest and top-ten mass per id column."""
    total = weighted.agg((F.sum(weight) * F.sum(weight) / F.sum(c(weight) * c(weight)) / F.count("*")).alias("ess_fraction"), F.sum(weight).alias("_t"))
    parts = None
    for name, col in ids.items():
        shares = weighted.groupBy(c(col).cast("string").alias("_id")).agg(F.sum(weight).alias("_s"))
        top = shares.orderBy(c("_s").desc(), "_id").limit(10).agg(F.max("_s").alias("_max"), F.sum("_s").alias("_top"))
        row = with_row(top, total).select(F.lit(name).alias("id"), "ess_fraction", (c("_max") / c("_t")).alias("max_mass"), (c("_top") / c("_t")).alias("top10_mass"))
        parts = row if parts is None else parts.unionByName(row)
    return parts


def average_percent_rank(df: DataFrame, value: str, output: str, by: Sequence[str] = ()) -> DataFrame:
    """Average-tie percent rank from counts per distinct value, so ties cost one row."""
    per = cumulative_counts(df.groupBy(*by, value).agg(F.count("*").alias("_c")), value, "_c", by)
    per = per.select(*by, value, ((c("below") + (c("_c") + 1) / 2.0) / c("total")).alias(output))
    return df.join(per, [*by, value])


def cell_support(train: DataFrame, rows: DataFrame, cell: Sequence[str], side: str) -> DataFrame:
    """How much training support each evaluated row has in its cell, per side, with quantiles."""
    sizes = train.groupBy(*cell).agg(F.count("*").alias("_n"))
    joined = rows.join(sizes, list(cell), "left").withColumn("support", F.coalesce("_n", F.lit(0)))
    counts = joined.groupBy(side).agg(
        F.count("*").alias("events"), F.count_if(c("support") == 0).alias("unseen"),
        *[F.count_if(c("support") <= k).alias(f"le_{k}") for k in (2, 5, 10)])
    q = exact_quantiles(joined.select(side, "support"), "support", [0, 0.25, 0.5, 0.75, 1], [side])
    return counts.join(q.select(side, *[c("q")[i].alias(f"q{i}") for i in range(5)]), side)


def singleton_cells(train: DataFrame, cell: Sequence[str]) -> DataFrame:
    """How many cells hold exactly n events."""
    return train.groupBy(*cell).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("cells"))


def operational_counters(df: DataFrame, by: Sequence[str], latency: str) -> DataFrame:
    """Counts and median / maximum latency per group."""
    q = exact_quantiles(df.select(*by, latency), latency, [0.5], by)
    n = df.groupBy(*by).agg(F.count("*").alias("n"), F.max(latency).alias("max_latency"))
    return n.join(q.select(*by, c("q")[0].alias("p50")), list(by), "left")


def exposure_ranking(starts: DataFrame, keys: LogKeys, period: str, team: str, outs: str, min_dev_outs: int) -> DataFrame:
    """Per actor and period: outs, starts, opponents, episodes; average-tie percent ranks among the
    eligible, the smaller of the two as balanced score, and observed team changes."""
    def in_period(name, col):
        return F.when(c(period) == name, col)

    wide = starts.groupBy(keys.actor).agg(
        F.coalesce(F.sum(in_period("train", c(outs))), F.lit(0)).alias("train_outs"), F.coalesce(F.sum(in_period("dev", c(outs))), F.lit(0)).alias("dev_outs"),
        F.countDistinct(in_period("train", c(keys.cluster))).alias("train_starts"), F.countDistinct(in_period("dev", c(keys.entity))).alias("dev_opponents"),
        F.countDistinct(in_period("dev", F.struct(*keys.episode_key))).alias("dev_episodes"))
    eligible = wide.where((c("train_outs") > 0) & (c("dev_outs") >= min_dev_outs))
    ranked = average_percent_rank(average_percent_rank(eligible, "train_outs", "train_pct"), "dev_outs", "dev_pct")
    seq = starts.select(keys.actor, keys.date, keys.cluster, team).distinct()
    w = Window.partitionBy(keys.actor).orderBy(keys.date, keys.cluster, team)
    changes = seq.withColumn("_p", F.lag(team).over(w)).groupBy(keys.actor).agg(F.count_if(c("_p") != c(team)).alias("team_changes"))
    return ranked.join(changes, keys.actor).withColumn("balanced", F.least("train_pct", "dev_pct"))
