"""Stateful streams that take rows in the order of event time, however they arrive.

Rows wait in a buffer of their key until the watermark has passed them; then a timer hands them to a step in order. A key
that has nothing waiting is forgotten once ``keep`` has gone by since its last row, so that state ends with its use. Rows that
come behind the watermark are left out by Spark. These streams need the RocksDB state store (``STATE_STORE``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: (numbers kept for the key, time in microseconds, value) -> (numbers to keep, the row's result)
Step = Callable[[list[int], int, int], tuple[list[int], tuple]]


def _fires(micros: int) -> int:
    """The millisecond at which the watermark has passed a time."""
    return -(-micros // 1000)


class InOrder(StatefulProcessor):
    """Hands (at, n) of each key to a step in the order of time; equal times by n."""

    def __init__(self, step: Step, columns: list[str], keep_micros: int):
        self.step, self.columns, self.keep = step, columns, keep_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, n long")
        self.kept = handle.getValueState("kept", "numbers array<long>, last long")

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns)

    def _set_timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(_fires(at))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(t.value // 1000, int(n)) for pdf in rows for t, n in zip(pdf["at"], pdf["n"], strict=True)]
        first = min(new)[0]
        if self.waiting.exists():
            first = min(first, min(r[0] for r in self.waiting.get()))
        self.waiting.appendList(new)
        self._set_timer(first)
        yield self._rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted((r[0], r[1]) for r in self.waiting.get()) if self.waiting.exists() else []
        ripe = [r for r in held if _fires(r[0]) <= passed]
        numbers, last = (list(self.kept.get()[0]), self.kept.get()[1]) if self.kept.exists() else ([], None)
        out = []
        for at, n in ripe:
            # what an idle key had kept is gone, whether or not its timer has come to it
            numbers, result = self.step(numbers if last is not None and at - last < self.keep else [], at, n)
            out.append((*key, pd.Timestamp(at, unit="us"), *result))
            last = at
        left = held[len(ripe) :]
        if left:
            self.waiting.put(left)
            self._set_timer(left[0][0])
        else:
            self.waiting.clear()
        if last is not None and _fires(last + self.keep) <= passed:
            self.kept.clear()
        elif last is not None:
            self.kept.update((numbers, last))
            if not left:
                self._set_timer(last + self.keep)
        yield self._rows(out)

    def close(self) -> None:
        pass


def throttle(requests: DataFrame, limit: int, seconds: float, late: str = "0 seconds") -> DataFrame:
    """requests(key, at) -> key, at, admitted: at most ``limit`` admitted ones in a window, all of them where it is 0."""
    width = round(seconds * 1_000_000)

    def step(live: list[int], at: int, n: int) -> tuple[list[int], tuple]:
        live = [t for t in live if t > at - width]
        good = not limit or len(live) < limit
        return ([*live, at] if good and limit else live), (good,)

    timed = requests.select("key", "at", F.lit(1).cast("long").alias("n")).withWatermark("at", late)
    return timed.groupBy("key").transformWithStateInPandas(InOrder(step, ["key", "at", "admitted"], width), "key long, at timestamp, admitted boolean", "append", "eventTime")


def source_health(runs: DataFrame, history: int = 5, least_mean: float = 10.0, late: str = "0 seconds", idle_days: float = 30.0) -> DataFrame:
    """runs(source_name, run_at, n) -> the columns of the batch form. A source without a run for so many days begins anew."""

    def step(kept: list[int], at: int, n: int) -> tuple[list[int], tuple]:
        zeros, counts = (kept[0], kept[1:]) if kept else (0, [])
        mean = sum(counts) / len(counts) if counts else 0.0
        zeros = zeros + 1 if n == 0 else 0
        status = "healthy" if zeros == 0 else "degraded" if zeros == 1 else "failing"
        return [zeros, *[*counts, n][-history:]], (n, mean, zeros, status, mean > least_mean and n == 0)

    names = ["source_name", "run_at", "n", "historic_avg", "consecutive_zeros", "status", "alert"]
    schema = "source_name string, run_at timestamp, n long, historic_avg double, consecutive_zeros long, status string, alert boolean"
    timed = runs.select("source_name", F.col("run_at").alias("at"), "n").withWatermark("at", late)
    return timed.groupBy("source_name").transformWithStateInPandas(InOrder(step, names, round(idle_days * 86_400e6)), schema, "append", "eventTime")
