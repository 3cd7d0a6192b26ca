"""Health of sources from their runs: canaries and status in batch. The streaming form is in ``streaming``."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .resolve import sessions


def run_health(runs: DataFrame, history: int = 5, least_mean: float = 10.0) -> DataFrame:
    """runs(source_name, run_at, n) with historic_avg (of up to ``history`` runs before), consecutive_zeros, status, alert."""
    order = Window.partitionBy("source_name").orderBy("run_at")
    before = order.rowsBetween(-history, -1)
    island = F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = runs.withColumn("historic_avg", F.coalesce(F.avg("n").over(before), F.lit(0.0))).withColumn("__island", island)
    zeros = F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).over(Window.partitionBy("source_name", "__island").orderBy("run_at").rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("consecutive_zeros", zeros).drop("__island")
    status = F.when(F.col("consecutive_zeros") == 0, "healthy").when(F.col("consecutive_zeros") == 1, "degraded").otherwise("failing")
    return out.withColumn("status", status).withColumn("alert", (F.col("historic_avg") > least_mean) & (F.col("n") == 0))


def latest(health: DataFrame) -> DataFrame:
    pick = F.max_by(F.struct("n", "status", "consecutive_zeros"), "run_at")
    rows = health.groupBy("source_name").agg(F.max("run_at").alias("last_run_at"), pick.alias("x"))
    return rows.select("source_name", "last_run_at", F.col("x.n").alias("last_event_count"), "x.status", "x.consecutive_zeros")


def report(registered: DataFrame, stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """All registered, stored and fresh sources, each with the newer of its states; 'unknown' without any."""
    state = stored.withColumn("__rank", F.lit(0)).unionByName(fresh.withColumn("__rank", F.lit(1)))
    columns = [c for c in stored.columns if c != "source_name"]
    pick = F.max_by(F.struct(*columns), F.struct("last_run_at", "__rank"))
    newest = state.groupBy("source_name").agg(pick.alias("x")).select("source_name", "x.*")
    names = registered.select("source_name").union(newest.select("source_name")).distinct()
    return names.join(newest, "source_name", "left").withColumn("status", F.coalesce("status", F.lit("unknown")))


def replace_keyed(stored: DataFrame, fresh: DataFrame, key: str = "source_name") -> DataFrame:
    """stored with the rows of fresh in the place of those with the same key."""
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def counts(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count("*").alias("sources"), F.sum("last_event_count").alias("events"))


def run_counts(rows: DataFrame, registered: DataFrame) -> DataFrame:
    """Rows of each registered source, 0 where a run brought none."""
    n = rows.groupBy("source_name").agg(F.count("*").alias("n"))
    return registered.select("source_name").distinct().join(n, "source_name", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def baseline_drop(daily: DataFrame, days: int = 14, share: float = 0.2) -> DataFrame:
    """daily(source_name, day, n) with the mean of the ``days`` before and whether the day fell by more than ``share``."""
    mean = F.avg("n").over(Window.partitionBy("source_name").orderBy("day").rowsBetween(-days, -1))
    return daily.withColumn("baseline", mean).withColumn("alert", F.coalesce(F.col("n") < (1 - share) * F.col("baseline"), F.lit(False)))


def quota(snapshots: DataFrame, least_active: int = 1) -> DataFrame:
    """snapshots(source_name, key_id, status, at) -> keys by their latest status, and whether too few are active."""
    last = snapshots.groupBy("source_name", "key_id").agg(F.max_by("status", "at").alias("status"))
    out = last.groupBy("source_name").agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") != "active").alias("inactive"))
    return out.withColumn("alert", F.col("active") <= least_active)


def throttle(requests: DataFrame, limit: int, seconds: float) -> DataFrame:
    """requests(key, at, …) with ``admitted``: at most ``limit`` admitted ones in any ``seconds``; refused ones do not count.
    A limit of 0 admits all; so are requests without a key or a time.

    A pause of ``seconds`` empties a key's window, so that runs between pauses are streamed in the order of time, each
    holding at most ``limit`` admitted times. Requests at one time are taken in the order of their other columns.
    """
    micros = int(seconds * 1e6)
    rest = [c for c in requests.columns if c not in ("key", "at")]
    runs = sessions(requests.withColumnRenamed("at", "start_at"), ["key"], timedelta(seconds=seconds)).withColumn("t", F.unix_micros("start_at"))
    rows = runs.repartition("key", "session").sortWithinPartitions("key", "session", "t", *rest).select("key", F.col("start_at").alias("at"), *rest, "session", "t")
    schema = T.StructType([requests.schema["key"], requests.schema["at"], *(requests.schema[c] for c in rest), T.StructField("admitted", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, live = None, deque()
        for batch in batches:
            admitted = []
            for key, session, t in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if (key, session) != of:
                    of, live = (key, session), deque()
                while live and live[0] <= t - micros:
                    live.popleft()
                admitted.append(limit <= 0 or len(live) < limit)
                if admitted[-1] and limit > 0:
                    live.append(t)
            kept = batch.num_columns - 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(admitted, pa.bool_())], [*batch.schema.names[:kept], "admitted"])

    keyless = requests.where("key is null or at is null").withColumn("admitted", F.lit(True))
    return rows.mapInArrow(run, schema).select(*requests.columns, "admitted").unionByName(keyless)
