"""Streams agree with their batch forms."""

import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventengine.operators import health
from eventengine.streaming import jobs, ordered


def landed(spark, rows, schema, parts=3):
    path = tempfile.mkdtemp(prefix="spark-")
    n = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * n : (k + 1) * n], schema).coalesce(1).write.mode("append").parquet(path)
    return jobs.landed(spark, path, spark.createDataFrame([], schema).schema, 1)


def result(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"SELECT * FROM {name}").collect()


T0 = datetime(2026, 1, 1)


def test_source_health(spark):
    counts = [20, 30, 0, 0, 25, 11, 40, 0, 50, 12, 0, 0]
    rows = [(s, T0 + timedelta(hours=i), n if s == "a" else n // 5) for i, n in enumerate(counts) for s in ("a", "b")]
    schema = "source_name string, run_at timestamp, n long"
    got = result(spark, jobs.source_health(landed(spark, rows, schema)), "health")
    want = health.run_health(spark.createDataFrame(rows, schema)).collect()
    key = lambda r: (r["source_name"], r["run_at"], r["n"], round(r["historic_avg"], 9), r["consecutive_zeros"], r["status"], r["alert"])
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert any(r["alert"] for r in want)


def test_throttle(spark):
    rows = [(k, T0 + timedelta(seconds=7 * i + k)) for i in range(40) for k in (1, 2)]
    schema = "key long, at timestamp"
    got = result(spark, jobs.throttle(landed(spark, rows, schema), 3, 60.0), "throttle")
    want = health.throttle(spark.createDataFrame(rows, schema), 3, 60.0).collect()
    as_set = lambda x: {(r["key"], r["at"], r["admitted"]) for r in x}
    assert as_set(got) == as_set(want)
    assert 0 < sum(r["admitted"] for r in want) < len(rows)


def test_live_profiles(spark):
    rows = [(1, "#a", T0 + timedelta(days=i), float(1 + i % 3)) for i in range(12)]
    got = result(spark, jobs.live_profiles(landed(spark, rows, "user_id long, tag string, created_at timestamp, weight double")), "profiles", "update")
    last = max(got, key=lambda r: r["at"])
    want = sum(w * 0.5 ** ((rows[-1][2] - t).days / 30) for _, _, t, w in rows)
    assert last["score"] == pytest.approx(want)


def test_live_popularity(spark):
    rows = [(u, e, "save", T0 + timedelta(minutes=u)) for u in range(10) for e in (1, 2)] * 2 + [(99, 1, "onboarding", T0)]
    got = result(spark, jobs.live_popularity(landed(spark, rows, "user_id long, event_id long, signal_type string, created_at timestamp")), "pop", "complete")
    assert {(r["event_id"], r["people_interested"]) for r in got} == {(1, 10), (2, 10)}


def test_windows(spark):
    rows = [("a", T0 + timedelta(hours=i), 1) for i in range(24)]
    got = result(spark, jobs.counts_by_window(landed(spark, rows, "source_name string, run_at timestamp, n long")), "win")
    assert {r["n"] for r in got} == {6} and len(got) >= 2


def test_ingest_is_incremental(spark):
    path, ckpt, seen = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-"), []
    schema = spark.createDataFrame([], "x long").schema

    def merge(batch, batch_id):
        seen.extend(r["x"] for r in batch.collect())

    for lot in ([1, 2], [3]):
        spark.createDataFrame([(x,) for x in lot], schema).coalesce(1).write.mode("append").parquet(path)
        jobs.ingest(jobs.landed(spark, path, schema), merge, ckpt).awaitTermination(60)
    assert sorted(seen) == [1, 2, 3]


def test_lifecycle(spark):
    """An event is past once later ones show that a day has gone by since its end; one that is put off is not."""
    day = timedelta(days=1)
    rows = [(1, "ends", T0, T0 + timedelta(hours=2), T0), (2, "open end", T0, None, T0), (3, "put off", T0, None, T0), (3, "put off", T0 + 9 * day, None, T0 + timedelta(hours=1)), (4, "clock", T0 + 20 * day, None, T0 + 3 * day), (4, "clock", T0 + 20 * day, None, T0 + 3 * day)]
    stream = jobs.lifecycle(landed(spark, rows, "id long, title string, start_at timestamp, end_at timestamp, seen_at timestamp", parts=6))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = {(r["id"], r["title"], r["status"]) for r in result(spark, stream, "lifecycle")}
    assert got == {(1, "ends", "past"), (2, "open end", "past")}


def shuffled(rows, seed=3, reach=6):
    """Rows a few places from where they belong."""
    rng = random.Random(seed)
    return [r for _, r in sorted(enumerate(rows), key=lambda x: x[0] + rng.uniform(0, reach))]


def states(spark, checkpoint):
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "kept").load().count(), spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "waiting").load().count()


def run_ordered(spark, stream, name):
    spark.conf.set(*ordered.STATE_STORE)
    ckpt = tempfile.mkdtemp(prefix="spark-")
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.sql(f"SELECT * FROM {name}").collect(), ckpt


def test_late_requests_are_taken_in_order(spark):
    """Shuffled requests are judged as in the batch form, and idle keys leave nothing behind."""
    rows = [(k, T0 + timedelta(seconds=7 * i + k)) for i in range(40) for k in (1, 2)]
    end = [(99, T0 + timedelta(hours=5))]
    schema = "key long, at timestamp"
    got, ckpt = run_ordered(spark, ordered.throttle(landed(spark, shuffled(rows) + end, schema, 4), 3, 60.0, "2 minutes"), "ordered_throttle")
    want = health.throttle(spark.createDataFrame(rows, schema), 3, 60.0).collect()
    as_list = lambda x: sorted((r["key"], r["at"], r["admitted"]) for r in x if r["key"] != 99)
    assert as_list(got) == as_list(want) and 0 < sum(r["admitted"] for r in want) < len(rows)
    # only the row that moved the watermark still waits
    assert states(spark, ckpt) == (0, 1)


def test_no_limit_admits_all(spark):
    rows = [(1, T0 + timedelta(seconds=i)) for i in range(12)]
    schema = "key long, at timestamp"
    got = result(spark, jobs.throttle(landed(spark, rows, schema), 0, 60.0), "unlimited")
    assert len(got) == 12 and all(r["admitted"] for r in got)
    got, _ = run_ordered(spark, ordered.throttle(landed(spark, rows, schema), 0, 60.0), "ordered_unlimited")
    assert len(got) == 12 and all(r["admitted"] for r in got)


def test_late_runs_are_taken_in_order(spark):
    counts = [20, 30, 0, 0, 25, 11, 40, 0, 50, 12, 0, 0]
    rows = [(s, T0 + timedelta(hours=i), n if s == "a" else n // 5) for i, n in enumerate(counts) for s in ("a", "b")]
    schema = "source_name string, run_at timestamp, n long"
    end = [("c", T0 + timedelta(days=90), 1)]
    got, ckpt = run_ordered(spark, ordered.source_health(landed(spark, shuffled(rows) + end, schema, 4), late="8 hours"), "ordered_health")
    want = health.run_health(spark.createDataFrame(rows, schema)).collect()
    key = lambda r: (r["source_name"], r["run_at"], r["n"], round(r["historic_avg"], 9), r["consecutive_zeros"], r["status"], r["alert"])
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert states(spark, ckpt) == (0, 1)
