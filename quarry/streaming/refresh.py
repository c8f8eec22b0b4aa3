"""When to fold again: a touched subject is due once it has been quiet for a while."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.streaming.membership import stateful

#: due: seconds.
DUE = "subject string, due long, touches long"


class Debounce(StatefulProcessor):
    """By subject: the bursts that are not due yet (first, last, touches), and a timer behind the earliest of them.

    A burst is settled by the watermark alone: until it has passed the due time, a touch that
    is late may still lengthen the burst or make one of two.
    """

    def __init__(self, quiet: int):
        self.quiet = quiet * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, touches long")

    def _merged(self, bursts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        for first, last, n in sorted(bursts):
            if out and first - out[-1][1] <= self.quiet:
                first, last, n = out[-1][0], max(last, out[-1][1]), out.pop()[2] + n
            out.append((first, last, n))
        return out

    def _held(self) -> list[tuple[int, int, int]]:
        return [tuple(b) for b in self.open.get()] if self.open.exists() else []

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        bursts = before = self._held()
        for frame in rows:
            bursts = self._merged(bursts + [(t, t, 1) for t in (int(t.timestamp() * 1000) for t in frame["at"])])
        if before:
            self.handle.deleteTimer(min(last for _, last, _ in before) + self.quiet)
        self.open.put(bursts)
        self.handle.registerTimer(bursts[0][1] + self.quiet)
        yield self._rows(key, [])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        bursts, mark = self._held(), timerValues.getCurrentWatermarkInMs()
        left = [b for b in bursts if b[1] + self.quiet > mark]
        if left:
            self.open.put(left)
            self.handle.registerTimer(left[0][1] + self.quiet)
        else:
            self.open.clear()
        yield self._rows(key, [(last + self.quiet, n) for _, last, n in bursts if last + self.quiet <= mark])

    def _rows(self, key: Any, due: list[tuple[int, int]]) -> pd.DataFrame:
        rows = pd.DataFrame([(key[0], ms // 1000, n) for ms, n in due], columns=["subject", "due", "touches"])
        return rows.astype({"subject": "object", "due": "int64", "touches": "int64"})

    def close(self) -> None:
        pass


def due(touches: DataFrame, quiet: int, late: str = "1 hour") -> DataFrame:
    """subject, due, touches from a stream (subject, at): each burst of touches once, ``quiet`` seconds behind its last.

    A timer of event time fires when the watermark, ``late`` behind the newest
    touch, has passed it; touches that come later than that are part of no burst.
    """
    stateful(touches.sparkSession)
    rows = touches.select("subject", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("subject").transformWithStateInPandas(Debounce(quiet), DUE, "append", "EventTime")
