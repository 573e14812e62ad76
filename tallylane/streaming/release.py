"""Delayed release as a stream: event-time timers answer requests, and state leaves as the watermark passes.

Snapshots and requests of a cluster are one stream, ordered by the time they are about: a snapshot's event time, a
request's release time (its clock less the viewer's delay).  A request is answered when the watermark has passed its
time, as no snapshot before it can still come; what is kept of the snapshots is then the newest at or before the watermark
and those behind it.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

c = F.col
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Release(StatefulProcessor):
    """State of a cluster: snapshots by event time (the largest seq of each), open requests, and the time of its one timer.

    A call to the state store costs far more than a row, so a cluster's state is one packed value, read and written once
    in a call, and there is one timer for the earliest open request, which answers all that are due.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "snapshots binary, requests binary, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        snapshots, requests, timer = self._load()
        for frame in rows:
            for kind, at, number in zip(frame["kind"].tolist(), (frame["at"].astype("datetime64[us]").astype("int64") // 1000).tolist(), frame["number"].tolist(), strict=True):
                if kind == "request":
                    requests[number] = at
                elif at not in snapshots or snapshots[at] < number:
                    snapshots[at] = number
        self._store(snapshots, requests, self._set_timer(requests, timer))
        yield self._frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, mark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        snapshots, requests, timer = self._load()
        # what lies at the watermark is due as well: rows at it or behind it are dropped
        ready: dict[int, list[int]] = {}
        for number, at in requests.items():
            if at <= mark:
                ready.setdefault(at, []).append(number)
        times, out = sorted(snapshots), []
        for i, at in enumerate(sorted(ready)):
            if i:
                del times[:max(bisect_right(times, at) - 1, 0)]
            known = bisect_right(times, at)
            newest = times[known - 1] if known else None
            out += [(number, snapshots.get(newest), newest, len(times)) for number in ready[at]]
        requests = {number: at for number, at in requests.items() if at > mark}
        # open requests lie behind the watermark, as do the snapshots still to come
        del times[:max(bisect_right(times, mark) - 1, 0)]
        self._store({at: snapshots[at] for at in times}, requests, self._set_timer(requests, None if timer == due else timer))
        yield self._frame(key, out)

    def _set_timer(self, requests: dict[int, int], timer: int | None) -> int | None:
        """Have one timer, at the earliest open request; it fires when the watermark has passed its time."""
        first = min(requests.values(), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        return first

    def _load(self) -> tuple[dict[int, int], dict[int, int], int | None]:
        found = self.held.get()
        if found is None:
            return {}, {}, None
        snapshots, requests = (dict(struct.iter_unpack("<qq", bytes(x))) for x in found[:2])
        return snapshots, requests, found[2]

    def _store(self, snapshots: dict[int, int], requests: dict[int, int], timer: int | None) -> None:
        self.held.update((*(b"".join(struct.pack("<qq", *x) for x in pairs.items()) for pairs in (snapshots, requests)), timer))

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(key, rows: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(rows, columns=["request_id", "released_seq", "released_at", "held"])
        found.insert(0, "cluster", key[0])
        return found.astype({"cluster": "int64", "request_id": "int64", "released_seq": "Int64", "released_at": "Int64", "held": "int64"})


def delayed_release_stream(snapshots: DataFrame, viewers: DataFrame, cluster: str, watermark: str) -> DataFrame:
    """Answers (cluster, request_id, released_seq, released_at in milliseconds, held snapshots) of both streams.

    `snapshots` has cluster, at (timestamp) and seq, `viewers` cluster, at (timestamp: clock less delay) and request_id.  Rows behind
    the watermark are dropped.  The session needs the RocksDB state store (PROVIDER).
    """
    both = snapshots.select(c(cluster).alias("cluster"), "at", F.lit("snapshot").alias("kind"), c("seq").alias("number")).unionByName(
        viewers.select(c(cluster).alias("cluster"), "at", F.lit("request").alias("kind"), c("request_id").alias("number")))
    return both.withWatermark("at", watermark).groupBy("cluster").transformWithStateInPandas(
        Release(), "cluster bigint, request_id bigint, released_seq bigint, released_at bigint, held bigint", "Append", "EventTime")
