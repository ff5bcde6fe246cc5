"""Live durations: starts and ends of a run paired as they arrive, in any order.

State is kept by run: the events that wait for the watermark, and the starts in force. An event
is looked at when the watermark has passed it, so all events before it that are not later than
the delay are there; the pairs are those of `telemetry.chain_durations` and
`telemetry.retriever_durations`. A run that is quiet for `idle` seconds of event time gives its
state up; an end that comes after that has no start.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusatlas.operators import telemetry as T

PAIRS = "run bigint, event_id bigint, kind string, duration_sec double"
_MICROS = 1_000_000
IDLE_SECONDS = 86_400


class PairDurations(StatefulProcessor):
    """Waiting events, the starts in force, and one timer for the next thing to do."""

    def __init__(self, idle_seconds: int):
        self.idle = idle_seconds * _MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, event_id bigint, kind string")
        # Microseconds of the last chain start, first model start, last retriever start and last event.
        self.starts = handle.getValueState("starts", "chain bigint, model bigint, retriever bigint, seen bigint")

    def _set_timer(self, at: int) -> None:
        """A single timer for a run; timers count milliseconds."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer(-(-at // 1_000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for part in rows:
            for at, event_id, kind in zip(part["at"], part["event_id"], part["kind"]):
                self.waiting.appendValue((int(at), int(event_id), str(kind)))
                earliest = int(at) if earliest is None else min(earliest, int(at))
        if earliest is not None:
            waiting = min(int(row[0]) for row in self.waiting.get())
            # At the earliest after the current watermark, since a timer in the past is none.
            self._set_timer(max(waiting, timerValues.getCurrentWatermarkInMs() * 1_000 + 1_000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1_000
        events = sorted((int(r[0]), int(r[1]), str(r[2])) for r in self.waiting.get())
        ready, later = [e for e in events if e[0] <= passed], [e for e in events if e[0] > passed]
        held = self.starts.get()
        chain, model, retriever, seen = held if held is not None else (None, None, None, 0)
        out = []
        for at, event_id, kind in ready:
            if at - seen > self.idle:
                # Given up before, whether the timer has come to it or not.
                chain = model = retriever = None
            seen = at
            if kind == T.CHAIN_START:
                chain = at
            elif kind == T.MODEL_START:
                model = at if model is None else model
            elif kind == T.RETRIEVER_START:
                retriever = at
            else:
                start = retriever if kind == T.RETRIEVER_END else model if chain is None else chain
                out.append((key[0], event_id, kind, None if start is None else (at - start) / _MICROS))
        if not later and not ready and passed >= seen + self.idle:
            self.waiting.clear()
            self.starts.clear()
        else:
            self.starts.update((chain, model, retriever, seen))
            if later:
                self.waiting.put(later)
                self._set_timer(later[0][0])
            else:
                self.waiting.clear()
                self._set_timer(seen + self.idle)
        if out:
            yield pd.DataFrame(out, columns=["run", "event_id", "kind", "duration_sec"]).astype({"duration_sec": "float64"})

    def close(self) -> None:
        pass


def live_durations(events: DataFrame, delay: str, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """`(run, event_id, kind, duration_sec)` of every end, once the watermark has passed it.

    `events` is a stream of `(run, event_id, ts, kind)`; events later than `delay` are not seen.
    Needs the RocksDB state store.
    """
    kinds = (T.CHAIN_START, T.MODEL_START, T.CHAIN_END, T.MODEL_END, T.RETRIEVER_START, T.RETRIEVER_END)
    told = events.where(F.col("kind").isin(*kinds)).withWatermark("ts", delay).select(
        F.col("run").cast("bigint").alias("run"), F.col("event_id").cast("bigint").alias("event_id"), "ts", "kind",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
    )
    return told.groupBy("run").transformWithStateInPandas(
        statefulProcessor=PairDurations(idle_seconds), outputStructType=PAIRS, outputMode="Append", timeMode="EventTime",
    )
