"""Key columns of an event log, and the windows that follow from them.

A log row is one *event*.  Events form *episodes*, episodes form *clusters*
(a cluster is bounded: one contest, one session).  Every window used by the
library is partitioned by a cluster, an episode, or runs over rows that were
aggregated per (entity, date) first, so no task ever receives an unbounded
group of raw events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Window, WindowSpec

PRIOR = (Window.unboundedPreceding, -1)


@dataclass(frozen=True)
class LogKeys:
    cluster: str = "game_pk"
    episode: str = "at_bat_number"
    seq: str = "pitch_number"
    actor: str = "pitcher"
    entity: str = "batter"
    date: str = "game_date"
    period: str = "inning"
    side: str = "inning_topbot"

    @property
    def event(self) -> list[str]:
        return [self.cluster, self.episode, self.seq]

    @property
    def episode_key(self) -> list[str]:
        return [self.cluster, self.episode]

    @property
    def half(self) -> list[str]:
        return [self.cluster, self.period, self.side]

    def in_cluster(self, *extra: str) -> WindowSpec:
        """Events of one cluster (and the extra keys) in log order."""
        return Window.partitionBy(self.cluster, *extra).orderBy(self.episode, self.seq)

    def in_episode(self) -> WindowSpec:
        return Window.partitionBy(*self.episode_key).orderBy(self.seq)

    def whole_episode(self) -> WindowSpec:
        return Window.partitionBy(*self.episode_key)

    def whole_cluster(self, *extra: str) -> WindowSpec:
        return Window.partitionBy(self.cluster, *extra)


DEFAULT_KEYS = LogKeys()
