"""The alert rules on a stream: stretches of a source, continued from batch to batch.

As in :mod:`netstate.operators.alerts`, ends of quiet runs cut a segment into stretches with at most one alert each. A batch
is worked on as arrays: run lengths, candidates and ends of its windows at once, then one step for each stretch. What goes
on into the next batch is the open stretch and the stages that are still blocked, whatever the length of the stream.
"""
from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netstate.config import BENIGN, Options
from netstate.functions.levels import LEVELS, level_of, level_rank

HOT = LEVELS.index("WARNING") + 1


def run_lengths(flags: np.ndarray, carried: int) -> np.ndarray:
    """For each place, how many flags in a row are set up to it; ``carried`` were before the first place."""
    place = np.arange(len(flags))
    return place - np.maximum.accumulate(np.where(flags, -1 - carried, place))


@dataclass
class Watch:
    """What a source carries on: its runs, the alert of the open stretch and the last blocked position of each stage."""

    segment: int = -1
    alerts: int = 0
    above: int = 0
    quiet: int = 0
    blocked: dict[str, int] = field(default_factory=dict)
    rank: int = 0
    stages: list[str] = field(default_factory=list)                  # of the open alert; empty where there is none

    def feed(self, rows: pd.DataFrame, options: Options) -> list[tuple]:
        """Events (segment, pos, time, type, alert_id, severity, stage) of further windows of one segment, in order."""
        segment = int(rows["segment"].iloc[0])
        if segment != self.segment:
            self.segment, self.above, self.quiet, self.blocked, self.stages = segment, 0, 0, {}, []
        pos, rank, stage = (rows[c].to_numpy() for c in ("pos", "rank", "stage"))
        hot = rank >= HOT
        above, quiet = run_lengths(hot, self.above), run_lengths(rows["quiet"].to_numpy(), self.quiet)
        ready = np.flatnonzero(above >= options.persistence)
        ends = np.flatnonzero(quiet == options.clear_windows).tolist()
        events, start = [], 0

        def event(at: int, kind: str, severity: str | None = None, name: str | None = None):
            events.append((segment, int(pos[at]), rows["timestamp"].iloc[at], kind, self.alerts, severity, name))

        for end in [*ends, len(pos)]:
            inside = start
            if not self.stages:
                free = (j for j in ready[np.searchsorted(ready, start):].tolist()
                        if j < end and self.blocked.get(stage[j], -1) < pos[j])
                opening = next(free, None)
                if opening is not None:
                    self.alerts, self.rank, self.stages = self.alerts + 1, int(rank[opening]), [stage[opening]]
                    event(opening, "opened", LEVELS[self.rank - 1], stage[opening])
                    inside = opening + 1
            if self.stages:
                mine = np.flatnonzero(hot[inside:end]) + inside
                worse = mine[rank[mine] > self.rank]
                if len(worse):
                    self.rank = int(rank[worse[0]])
                    event(worse[0], "escalated", LEVELS[self.rank - 1])
                self.stages = list(dict.fromkeys([*self.stages, *(s for s in stage[mine] if s != BENIGN)]))
                if end < len(pos):
                    event(end, "closed")
                    self.blocked |= {s: int(pos[end]) + options.cooldown_windows for s in self.stages}
                    self.stages = []
            start = end + 1
        self.above, self.quiet = int(above[-1]), int(quiet[-1])
        self.blocked = {s: until for s, until in self.blocked.items() if until > pos[-1]}
        return events


EVENT_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("segment", T.IntegerType()),
    T.StructField("pos", T.LongType()), T.StructField("time", T.TimestampNTZType()),
    T.StructField("type", T.StringType()), T.StructField("alert_id", T.LongType()),
    T.StructField("severity", T.StringType()), T.StructField("stage", T.StringType())])


class AlertProcessor(StatefulProcessor):
    """One value state a source. Its windows of a micro-batch are put in order, five narrow columns each."""

    def __init__(self, options: Options):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("watch", "json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.saved.get()
        watch = Watch(**json.loads(stored[0])) if stored else Watch()
        batch = pd.concat([r.drop(columns="source") for r in rows]).sort_values(["segment", "pos"])
        out = [(key[0], *e) for _, part in batch.groupby("segment") for e in watch.feed(part, self.options)]
        self.saved.update((json.dumps(asdict(watch)),))
        yield pd.DataFrame(out, columns=EVENT_SCHEMA.names)

    def close(self) -> None:
        pass


def stream_alerts(scored: DataFrame, threshold: float, options: Options) -> DataFrame:
    """Alert events of a stream of scored windows (source, segment, pos, timestamp, risk, headline_stage).

    The windows of a source come in order of time from micro-batch to micro-batch, as :func:`stream_grid` emits them.
    """
    rows = scored.select(
        "source", "segment", "pos", "timestamp", level_rank(level_of(F.col("risk"), threshold, options)).cast("int").alias("rank"),
        (F.col("risk") < options.clear_ratio * threshold).alias("quiet"), F.col("headline_stage").alias("stage"))
    return rows.groupBy("source").transformWithStateInPandas(
        AlertProcessor(options), outputStructType=EVENT_SCHEMA, outputMode="append", timeMode="none")
