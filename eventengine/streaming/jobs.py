"""Streaming jobs over landed files."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tables import EventTable


def landed(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """One pass over all that has landed since the last: ``merge(batch, batch_id)`` must be idempotent in batch_id."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_into(stream: DataFrame, table: EventTable, name: str, checkpoint: str):
    """One pass that upserts canonical rows with ordinal into the stored table, each batch exactly once, however often it is
    replayed: the table's commit holds the batch's number. Late rows and rows seen before are merged into what is stored."""
    return ingest(stream, lambda batch, batch_id: table.load(batch, name, batch_id), checkpoint)


HEALTH = "source_name string, run_at timestamp, n long, historic_avg double, consecutive_zeros long, status string, alert boolean"


def source_health(runs: DataFrame, history: int = 5, least_mean: float = 10.0) -> DataFrame:
    """runs(source_name, run_at, n) -> the columns of the batch form; state: the last counts and the zeros in a row."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts, zeros = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(pdfs)).sort_values("run_at")
        out = []
        for at, n in zip(rows["run_at"], rows["n"], strict=True):
            mean = sum(counts) / len(counts) if counts else 0.0
            zeros = zeros + 1 if n == 0 else 0
            status = "healthy" if zeros == 0 else "degraded" if zeros == 1 else "failing"
            out.append((key[0], at, n, mean, zeros, status, bool(mean > least_mean and n == 0)))
            counts = [*counts, int(n)][-history:]
        state.update((counts, zeros))
        yield pd.DataFrame(out, columns=["source_name", "run_at", "n", "historic_avg", "consecutive_zeros", "status", "alert"])

    return runs.groupBy("source_name").applyInPandasWithState(step, HEALTH, "counts array<long>, zeros long", "append", GroupStateTimeout.NoTimeout)


def throttle(requests: DataFrame, limit: int, seconds: float) -> DataFrame:
    """requests(key, at) -> key, at, admitted; state: the admitted times in the window. A limit of 0 is none."""
    width = pd.Timedelta(seconds=seconds)

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = deque(pd.Timestamp(t, unit="us") for t in state.get[0]) if state.exists else deque()
        rows = pd.concat(list(pdfs)).sort_values("at")
        ok = []
        for at in rows["at"]:
            while live and live[0] <= at - width:
                live.popleft()
            ok.append(not limit or len(live) < limit)
            if ok[-1] and limit:
                live.append(at)
        state.update(([t.value // 1000 for t in live],))
        yield pd.DataFrame({"key": key[0], "at": rows["at"].to_numpy(), "admitted": ok})

    return requests.groupBy("key").applyInPandasWithState(step, "key long, at timestamp, admitted boolean", "live array<long>", "append", GroupStateTimeout.NoTimeout)


def live_popularity(signals: DataFrame, late: str = "1 day") -> DataFrame:
    """event_id -> users interested so far; a user counts once for an event within the watermark."""
    known = signals.where(F.col("event_id").isNotNull() & F.col("signal_type").isin("save", "click", "external_ticket_click"))
    once = known.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["user_id", "event_id"])
    return once.groupBy("event_id").agg(F.count("*").alias("people_interested"))


def live_profiles(weighed: DataFrame, half_life_days: float = 30.0) -> DataFrame:
    """weighed(user_id, tag, created_at, weight) -> user_id, tag, score, at: the decayed sum up to the newest signal.

    Decay is exponential, so that the sum at one time gives the sum at any later one.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        score, at = (state.get[0], pd.Timestamp(state.get[1], unit="us")) if state.exists else (0.0, None)
        for t, w in pd.concat(list(pdfs)).sort_values("created_at")[["created_at", "weight"]].itertuples(index=False):
            newest = t if at is None else max(t, at)
            aged = lambda x, since: x * 0.5 ** ((newest - since).total_seconds() / 86_400 / half_life_days)
            score = (aged(score, at) if at is not None else 0.0) + aged(w, t)
            at = newest
        state.update((score, at.value // 1000))
        yield pd.DataFrame({"user_id": [key[0]], "tag": [key[1]], "score": [score], "at": [at]})

    return weighed.groupBy("user_id", "tag").applyInPandasWithState(step, "user_id long, tag string, score double, at timestamp", "score double, at long", "update", GroupStateTimeout.NoTimeout)


def counts_by_window(runs: DataFrame, late: str = "6 hours", width: str = "6 hours", slide: str | None = None) -> DataFrame:
    """Rows of each source by tumbling or sliding windows of event time."""
    w = F.window("run_at", width, slide) if slide else F.window("run_at", width)
    return runs.withWatermark("run_at", late).groupBy(w.alias("w"), "source_name").agg(F.sum("n").alias("n")).select("source_name", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class Lifecycle(StatefulProcessor):
    """Emits an event as past when event time is a day beyond its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "title string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            last = pdf.iloc[-1]
            end = last["end_at"] if not pd.isna(last["end_at"]) else last["start_at"]
            self.seen.update((str(last["title"]),))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int((pd.Timestamp(end) + pd.Timedelta(hours=24)).timestamp() * 1000))
        yield pd.DataFrame({"id": pd.Series(dtype="int64"), "title": pd.Series(dtype="str"), "status": pd.Series(dtype="str")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        title = self.seen.get()[0]
        self.seen.clear()
        yield pd.DataFrame({"id": [key[0]], "title": [title], "status": ["past"]})

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """events(id, title, start_at, end_at, seen_at) -> those that are past; time is ``seen_at``."""
    timed = events.withWatermark("seen_at", late)
    return timed.groupBy("id").transformWithStateInPandas(Lifecycle(), "id long, title string, status string", "append", "eventTime")
