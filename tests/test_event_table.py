"""The stored table: what a batch rewrites, who wins a version, and streams that are late or replayed."""

import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_resolve import BASE, event, frame

from eventengine.operators import tables
from eventengine.operators.tables import Conflict, Entry, EventTable
from eventengine.schema import CANON
from eventengine.streaming import jobs


def fresh(spark, rows_per_file=10):
    return EventTable(spark, f"{tempfile.mkdtemp(prefix='spark-')}/events", rows_per_file)


def days(n, first=0, **more):
    """An event a day, far apart."""
    return [event(k, f"Show number {k}", 1440 * (first + k), **more) for k in range(n)]


def titles(table, version=None):
    return sorted((r["title"], r["start_at"], r["description"], r["status"]) for r in table.read(version).collect())


def test_batches_beyond_the_instants_of_pandas(spark):
    table, at = fresh(spark), [{"start_at": datetime(y, 3, 1, 20)} for y in (2262, 2434)]
    table.load(frame(spark, [event(k, f"Show number {k}", **a) for k, a in enumerate(at)]))
    told = table.load(frame(spark, [event(k, f"Show number {k}", description="d", **a) for k, a in enumerate(at)]))
    assert (told.inserted, told.updated, told.deduped) == (0, 2, 0)
    assert titles(table) == [(f"Show number {k}", a["start_at"], "d", "scheduled") for k, a in enumerate(at)]


def test_files_are_found_however_far_apart_their_starts_lie(spark):
    """A span of half a million years has more buckets of two hours than a list can hold; files are found as by all pairs."""
    hour, rng = 3600, random.Random(3)
    spans = [(-9_000_000_000_000, 9_000_000_000_000)] + [(lo * hour, (lo + rng.choice([0, 1, 3, 50, 900])) * hour) for lo in rng.sample(range(-5_000, 5_000), 60)]
    asked = [rng.randint(-6_000, 6_000) * hour for _ in range(25)]
    at = lambda c: F.timestamp_seconds(F.col(c)).alias(c)
    manifest = spark.createDataFrame([(f"f{k}", *s) for k, s in enumerate(spans)], "file string, min_start long, max_start long").select("file", at("min_start"), at("max_start"))
    found = fresh(spark)._reached(manifest, spark.createDataFrame([(a,) for a in asked], "start_at long").select(at("start_at")))
    b = tables.BUCKET
    want = [f"f{k}" for k, (low, high) in enumerate(spans) if any(low // b - 1 <= a // b <= high // b + 1 for a in asked)]
    assert sorted(r["file"] for r in found.select("file").collect()) == sorted(want) and 1 < len(want) < len(spans)


def test_a_batch_rewrites_the_files_it_touches(spark):
    table = fresh(spark)
    told = table.load(frame(spark, days(60)))
    assert (told.version, told.inserted, told.updated, told.files_rewritten) == (1, 60, 0, 0)
    before = {r["file"]: r for r in table.manifest().collect()}
    assert len(before) >= 6 and sum(r["rows"] for r in before.values()) == 60
    was = titles(table)
    # one known row with news, one without, and one that is new
    batch = [event(0, "Show number 33", 1440 * 33 + 20, description="more is known now"), event(1, "Show number 7", 1440 * 7), event(2, "A new one", 1440 * 50 + 600)]
    told = table.load(frame(spark, batch))
    assert (told.inserted, told.updated, told.skipped, told.files_rewritten) == (1, 1, 1, 1) and told.files_read <= 3
    after = {r["file"] for r in table.manifest().collect()}
    assert len(set(before) - after) == 1, "all other files are taken over by name"
    rows = table.read().collect()
    assert len(rows) == 61 and len({r["id"] for r in rows}) == 61 and max(r["id"] for r in rows) == 61
    assert {r["description"] for r in rows} == {None, "more is known now"}
    assert titles(table, 1) == was, "readers of the old version are undisturbed"
    for r in table.manifest().collect():
        own = spark.read.parquet(f"{table.base}/data/{r['file']}").agg(F.count("*"), F.min("start_at"), F.max("start_at"), F.min("id"), F.max("id")).first()
        assert tuple(own) == (r["rows"], r["min_start"], r["max_start"], r["min_id"], r["max_id"])


def test_reads_open_the_files_of_a_time_range(spark):
    table = fresh(spark)
    table.load(frame(spark, days(60)))
    low, high = BASE + timedelta(days=20), BASE + timedelta(days=25)
    found = table.read(low=low, high=high)
    assert sorted(r["title"] for r in found.collect()) == sorted(f"Show number {k}" for k in range(20, 26))
    assert len(found.inputFiles()) <= 2 < len(table.read().inputFiles())


def test_the_second_writer_of_a_version_reads_again(spark):
    """Between writing and committing another writer commits an update of the same row: both updates are in the end there."""
    table = fresh(spark)
    table.load(frame(spark, days(20)))
    other = EventTable(spark, table.base, 10)
    calls = []

    def meanwhile():
        calls.append(1)
        if len(calls) == 1:
            other.load(frame(spark, [event(0, "Show number 5", 1440 * 5, description="from the other"), event(1, "Of the other", 77)]))

    told = table.load(frame(spark, [event(0, "Show number 5", 1440 * 5, venue_name="from this one"), event(1, "Of this one", 99_999)]), before_commit=meanwhile)
    assert told.version == 3 and len(calls) == 2
    rows = {r["title"]: r for r in table.read().collect()}
    assert (rows["Show number 5"]["description"], rows["Show number 5"]["venue_name"]) == ("from the other", "from this one")
    assert {"Of the other", "Of this one"} <= set(rows) and len(rows) == 22 and len({r["id"] for r in rows.values()}) == 22
    with pytest.raises(Conflict):
        table.commit(Entry(3, "x", {}))
    assert table.versions() == [1, 2, 3] and table.entry().manifest != "x"
    with pytest.raises(Conflict):
        table.load(frame(spark, days(1)), retries=0, before_commit=lambda: other.load(frame(spark, days(1, first=70))))


def known(rows):
    """What of a row doesn't depend on the order in which ids were given."""
    return sorted((r["title"], r["start_at"], r["description"] or "", r["venue_name"] or "", r["status"], tuple(r["tags"]), r["source_tier"]) for r in rows)


def lots():
    first = [event(0, "Jazz in the Park", description="short"), event(1, "Open Mic", 300), event(2, "Late Show", 2_000, source_tier=3)]
    # seen again with more to say, cancelled, moved by a better source; and a new one
    second = [event(3, "Jazz in the Park", 30, description="short, and now a good deal longer than it was before", status="cancelled"), event(4, "Late Show", 1_960, source_tier=1, venue_name="The Hall"), event(5, "Brunch", 4_000)]
    # late: a row older than all, a status that may not fall back, another with news
    third = [event(6, "Early Bird", -900), event(7, "Jazz in the Park", 10, status="scheduled", venue_name="The Park"), event(8, "Open Mic", 290, tags=["#open"]), event(9, "Brunch", 4_060, status="postponed", tags=["#eat"])]
    return [first, second, third]


def test_late_and_replayed_batches_end_in_the_same_table(spark):
    path, ckpt, table = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-"), fresh(spark)
    schema = frame(spark, []).schema
    told = []
    load = table.load
    table.load = lambda *a, **b: told.append(load(*a, **b))
    for lot in lots():
        frame(spark, lot).coalesce(1).write.mode("append").parquet(path)
        jobs.ingest_into(jobs.landed(spark, path, schema, 1), table, "feed", ckpt).awaitTermination(240)
    assert [(t.version, t.applied) for t in told] == [(1, True), (2, True), (3, True)]
    got = known(table.read().collect())
    # a replay after a crash: numbers that the table holds already
    for number, lot in enumerate(lots()):
        assert not load(frame(spark, lot), "feed", number).applied
    assert table.entry().version == 3 and known(table.read().collect()) == got
    at_once = fresh(spark)
    at_once.load(frame(spark, [r for lot in lots() for r in lot]))
    assert known(at_once.read().collect()) == got
    by = {r[0]: r for r in got}
    assert by["Jazz in the Park"][4] == "cancelled", "a status only escalates"
    assert by["Late Show"][1] == BASE + timedelta(minutes=1_960) and by["Brunch"][4] == "postponed" and len(got) == 5


def test_streams_have_numbers_of_their_own(spark):
    table = fresh(spark)
    assert table.load(frame(spark, days(2)), "a", 4).applied and table.load(frame(spark, days(2, first=9)), "b", 0).applied
    assert not table.load(frame(spark, days(2)), "a", 3).applied and not table.load(frame(spark, []), "b", 0).applied
    assert table.entry().streams == {"a": 4, "b": 0}


def test_compaction_keeps_the_rows(spark):
    table = fresh(spark)
    for k in range(4):
        table.load(frame(spark, [event(0, f"Lone show {k}", 3_000 * k)]))
    was, files = titles(table), table.manifest().count()
    assert table.compact(10) == files == 4 and table.manifest().count() == 1 and titles(table) == was
    assert table.compact(10) == 0 and titles(table, 3) == was[:3]
    told = table.load(frame(spark, [event(0, "Lone show 2", 6_000, description="news")]))
    assert (told.updated, told.inserted, told.files_rewritten) == (1, 0, 1)


def test_empty_table_and_batch(spark):
    table = fresh(spark)
    assert table.read().count() == 0 and table.read().columns == ["id", *CANON.fieldNames()] and table.entry().version == 0
    told = table.load(frame(spark, []))
    assert (told.applied, told.inserted) == (True, 0) and table.read().count() == 0
    assert table.load(frame(spark, days(1))).inserted == 1 and table.read(low=datetime(2030, 1, 1)).count() == 0


def test_a_file_with_a_moved_row_is_found_at_its_new_start(spark):
    """A merge that changes a start changes the file's range in the manifest."""
    table = fresh(spark)
    table.load(frame(spark, [event(0, "Show", source_tier=3)]))
    table.load(frame(spark, [event(0, "Show", 119, source_tier=1, venue_name="x")]))
    told = table.load(frame(spark, [event(0, "Show", 230, source_tier=1, description="news of the moved one")]))
    assert (told.updated, told.inserted) == (1, 0)
    (r,) = table.read().collect()
    assert r["start_at"] == BASE + timedelta(minutes=119)


def test_versions_as_folders_still_work(spark, tmp_path):
    tables.write_version(tables.by_start_date(frame(spark, days(3))), str(tmp_path), 1, "start_date")
    assert tables.read_version(spark, str(tmp_path), 1).where("start_date = '2026-05-02'").count() == 1
