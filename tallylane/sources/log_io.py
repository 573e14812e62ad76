"""Reading, normalising, versioning and verifying event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallylane.keys import LogKeys

c = F.col

# --- Fixed values: column names that are not doubles --------------------------
INT_SUFFIXES = ("key", "_id", "_pk", "_number", "linenumber")
STRING_NAMES = ("description", "events", "pitch_type", "stand", "p_throws", "home_team", "away_team")
STRING_SUFFIXES = ("status", "priority", "flag", "type", "name", "comment")
DATE_SUFFIXES = ("date",)
# --------------------------------------------------------------------------------


def scan(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], where: str | None = None) -> DataFrame:
    """Union of Parquet files with projection and predicate left to the reader."""
    df = spark.read.parquet(*paths).select(*columns)
    return df if where is None else df.where(where)


def partition_folders(spark: SparkSession, path: str, name: str) -> list[str]:
    """The folders of a partitioned table, one for each value there is."""
    values = spark.read.parquet(path).select(name).distinct().collect()
    return [f"{path}/{name}={v}" for v in sorted(r[0] for r in values if r[0] is not None)]


def scan_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in a key set of any size."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def column_type(name: str) -> str:
    n = name.lower()
    if n.endswith(DATE_SUFFIXES):
        return "timestamp"
    if n in STRING_NAMES or n.endswith(STRING_SUFFIXES):
        return "string"
    return "bigint" if n.endswith(INT_SUFFIXES) else "double"


def apply_types(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cast columns by name; the gate counts values that do not fit (an integer column with a fraction is an error)."""
    out, checks = [], []
    for n in df.columns:
        kind = column_type(n)
        value = c(n).try_cast(kind)
        bad = c(n).isNotNull() & value.isNull()
        if kind == "bigint":
            number = c(n).try_cast("double")
            bad = c(n).isNotNull() & (number.isNull() | (number != F.floor(number)))
            value = number.try_cast("bigint")
        out.append(value.alias(n))
        checks.append(F.count_if(bad).alias(n))
    return df.select(*out), df.agg(*checks)


def normalise(df: DataFrame, keys: LogKeys, type_col: str, keep: str, date: str) -> DataFrame:
    """Keep one type, truncate the date, sort inside partitions by key."""
    out = df.where(c(type_col) == keep).withColumn(date, F.to_date(date))
    return out.repartition(keys.cluster).sortWithinPartitions(*keys.event)


def permissive_union(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column missing (or all-null, untyped) in one part takes another part's type."""
    types: dict[str, str] = {}
    for p in parts:
        for n, t in p.dtypes:
            if t != "void":
                types.setdefault(n, t)
    cast = [p.select(*[(c(n).cast(types[n]) if t == "void" and n in types else c(n)).alias(n) for n, t in p.dtypes]) for p in parts]
    out = cast[0]
    for p in cast[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def row_digest(columns: Sequence[str]):
    """48-bit number of a row's content."""
    text = F.concat_ws("|", *[F.coalesce(c(x).cast("string"), F.lit("~")) for x in columns])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint")


def manifest(df: DataFrame, season: str, keys: LogKeys, columns: Sequence[str]) -> DataFrame:
    """Per season: rows, duplicate keys, date range and an order-insensitive content digest.

    The digest is the sum of the rows' 48-bit digests as text; a decimal sum cannot overflow.
    """
    per_key = df.withColumn("_h", row_digest(columns)).groupBy(season, *keys.event).agg(F.count("*").alias("_c"), F.sum(c("_h").cast("decimal(20,0)")).alias("_h"), F.min(keys.date).alias("_a"), F.max(keys.date).alias("_b"))
    return per_key.groupBy(season).agg(
        F.sum("_c").alias("rows"), F.count_if(c("_c") > 1).alias("duplicate_keys"), F.min("_a").alias("first_date"), F.max("_b").alias("last_date"), F.sum("_h").cast("string").alias("digest"))


def write_version(df: DataFrame, path: str, season: str) -> None:
    """Write a new version partitioned by season; an existing version is refused."""
    df.write.partitionBy(season).mode("errorifexists").parquet(path)


def verify(stored: DataFrame, actual: DataFrame, season: str, fields: Sequence[str]) -> DataFrame:
    """Problems between a stored manifest and the data: missing, unexpected, or different fields."""
    a = stored.select(season, F.struct(*fields).alias("_s"))
    b = actual.select(season, F.struct(*fields).alias("_a"))
    both = a.join(b, season, "full_outer")
    checks = F.array_compact(F.array(
        F.when(c("_a").isNull(), F.lit("missing_in_data")), F.when(c("_s").isNull(), F.lit("not_in_manifest")),
        *[F.when(c("_a").isNotNull() & c("_s").isNotNull() & ~c("_s")[f].eqNullSafe(c("_a")[f]), F.lit(f"different_{f}")) for f in fields]))
    return both.select(season, F.explode(checks).alias("problem"))


FEED_SCHEMA = """game bigint, plays array<struct<atBat: bigint, half: string, pitcher: bigint, batter: bigint,
  playEvents: array<struct<number: bigint, call: string, code: string, pitcher: bigint, runs: bigint, out: bigint>>>>"""


def flatten_feed(docs: DataFrame, keys: LogKeys, body: str = "body") -> DataFrame:
    """Nested feed documents to one row per event, with the count, outs and score before it.

    A document is one cluster, so the running state is a window inside the cluster.
    """
    doc = docs.select(F.from_json(body, FEED_SCHEMA).alias("d"))
    plays = doc.select(c("d.game").alias(keys.cluster), F.explode("d.plays").alias("p"))
    ev = plays.select(keys.cluster, c("p.atBat").alias(keys.episode), c("p.half").alias(keys.side), c("p.batter").alias(keys.entity), c("p.pitcher").alias("_play_actor"), F.posexplode("p.playEvents").alias("position", "e"))
    ev = ev.select(keys.cluster, keys.episode, c("e.number").alias(keys.seq), keys.side, keys.entity, F.coalesce("e.pitcher", "_play_actor").alias(keys.actor), c("e.call").alias("call"), c("e.code").alias("code"), c("e.runs").alias("runs"), c("e.out").alias("out"))
    prior = (Window.unboundedPreceding, -1)
    pa, game = keys.in_episode().rowsBetween(*prior), keys.in_cluster().rowsBetween(*prior)

    def before(cond, w):
        return F.coalesce(F.sum(cond.cast("bigint")).over(w), F.lit(0))

    return ev.withColumns({
        "balls_before": F.least(before(c("call") == "B", pa), F.lit(3)), "strikes_before": F.least(before(c("call").isin("S", "F"), pa), F.lit(2)),
        "outs_total_before": before(c("out"), game), "away_before": before(F.when(c(keys.side) == "Top", c("runs")).otherwise(0), game), "home_before": before(F.when(c(keys.side) == "Bot", c("runs")).otherwise(0), game)})


def snapshot_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", glob: str | None = None, files_per_trigger: int = 1) -> DataFrame:
    """Directory of recorded snapshot files as a stream, oldest first."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.format(fmt).load(path)
