"""Registry of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylane.keys import DEFAULT_KEYS
from tallylane.operators import encode
from tallylane.plans.testlog import LOG_CTE, event_log, log_partitions

# shifts values that sit on a rounding tie to the same side in both engines
TIE = 1e-9

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_PLANS: dict[tuple, DataFrame] = {}


class Tables:
    """Parquet tables of one directory as attributes; `log` is the derived event log."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def log(self) -> DataFrame:
        return self._plan("log", lambda: event_log(self.events))

    @property
    def log_partitions(self) -> int | None:
        """Partitions of the log, or None where the session's are enough."""
        return self._plan("log_partitions", lambda: log_partitions(self.spark, self.events.count()))

    @property
    def ids(self) -> DataFrame:
        """The log with encoded ids."""
        return self._plan("ids", lambda: encode.add_ids(self.log, DEFAULT_KEYS))

    def _plan(self, name: str, build: Callable[[], DataFrame | int | None]):
        """Reuse the lazy plan (no data) or the number of partitions of a session and directory; building it costs driver time."""
        key = (id(self.spark), self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _PLANS:
            _PLANS[key] = build()
        return _PLANS[key]


def log_sql(body: str) -> str:
    """Prefix a SELECT (or further `name AS (...)` CTEs ending in one) with the log CTEs."""
    body = body.strip()
    glue = "" if body[:6].upper() == "SELECT" else ","
    return f"WITH {LOG_CTE}{glue}\n{body}"


def query(name: str, sql: str | None = None, doubles: Sequence[str] = (), log: bool = True):
    """Register a query; `doubles` are rounded to six places on both sides."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(Tables(spark, sf_dir))
            if doubles:
                out = out.withColumns({c: F.round(F.col(c) + TIE, 6) + F.lit(0.0) for c in doubles})
            return out

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            text = log_sql(sql) if log else sql
            if doubles:
                rounded = ", ".join(f"round({c} + {TIE}, 6) + 0.0 AS {c}" for c in doubles)
                text = f"SELECT * REPLACE ({rounded}) FROM (\n{text}\n)"
            ORACLES[name] = text
        return fn

    return wrap
