"""The stored text index against the search that stems every text."""

import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventengine.functions import text
from eventengine.operators import search
from eventengine.operators.textindex import TextIndex, body

NOW = datetime(2026, 7, 11, 9)
SCHEMA = "id long, title string, description string, start_at timestamp, status string, lat double, lon double, location_confidence double"
WORDS = "concert concerts dancing dances dance dancer live lives living music musical night nights the of free freely cafés café party parties".split()


def made(spark, n, seed=1, first=0):
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k)) or None
    rows = [(first + i, say(rng.randint(1, 4)), say(rng.randint(0, 6)), NOW + timedelta(minutes=rng.randint(0, 40) * 15), "scheduled", 37.77 + rng.random() / 50, -122.42 + rng.random() / 50, 0.9) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def fresh(spark):
    return TextIndex(spark, f"{tempfile.mkdtemp(prefix='spark-')}/index", 16)


def ids(df):
    return sorted(r["id"] for r in df.collect())


QUERIES = ["dance", "dancing nights", "concert", "freely living", "Parties", "café", "nothing", "the of", "", "musical concerts party"]


def test_lookups_equal_stemming_every_text(spark):
    events, index = made(spark, 300), fresh(spark)
    index.add(events.select("id", body(events).alias("body")))
    found = {q: ids(index.lookup(q)) for q in QUERIES}
    assert found == {q: ids(events.where(search.matches_all(q))) for q in QUERIES}
    assert found["dance"] == ids(index.lookup("dances")) and len(found["dance"]) > 50 and not found["the of"] and not found[""]
    many = index.lookup_each(spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string"))
    assert sorted(map(tuple, many.collect())) == sorted((k, i) for k, q in enumerate(QUERIES) for i in found[q])


def test_later_batches_replace_texts(spark):
    events, index = made(spark, 120), fresh(spark)
    index.add(events.select("id", body(events).alias("body")), 0)
    # a third get other words, some lose theirs, some are new
    other = made(spark, 160, seed=2).where("id % 3 = 0 or id >= 120").withColumn("title", F.when(F.col("id") % 9 == 0, F.lit("the")).otherwise(F.col("title"))).withColumn("description", F.when(F.col("id") % 9 != 0, F.col("description")))
    assert index.add(other.select("id", body(other).alias("body")), 1)
    assert not index.add(other.select("id", F.lit("dance").alias("body")), 1), "a batch that is replayed does nothing"
    now = events.join(other, "id", "left_anti").unionByName(other)
    want = {q: ids(now.where(search.matches_all(q))) for q in QUERIES}
    assert {q: ids(index.lookup(q)) for q in QUERIES} == want
    assert index.compact() == 2 and len(index.segments()) == 1 and index.compact() == 0
    assert {q: ids(index.lookup(q)) for q in QUERIES} == want
    index.add(spark.createDataFrame([(5, "dancing")], "id long, body string"), 2)
    assert ids(index.lookup("dance concert")) == [i for i in want["musical concerts party"] if i == -1] + [i for i in ids(now.where(search.matches_all("dance concert"))) if i != 5]
    assert 5 in ids(index.lookup("dance"))


def test_a_search_opens_few_postings_and_runs_no_python(spark):
    events, index = made(spark, 200), fresh(spark)
    index.add(events.select("id", body(events).alias("body")))
    page = search.search(events, NOW - timedelta(days=1), q="dancing", index=index, limit=200)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    scan = next(x for x in plan.split("\n") if "PartitionFilters" in x and "bucket" in x)
    assert "bucket" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and "In(term" in scan or "EqualTo(term" in scan
    assert ids(page) == ids(search.search(events, NOW - timedelta(days=1), q="dancing", limit=200))


def test_a_batch_added_meanwhile_survives_compaction(spark, monkeypatch):
    index, other = fresh(spark), None
    for k in range(2):
        index.add(spark.createDataFrame([(k, f"concert number{k}")], "id long, body string"))
    other = TextIndex(spark, index.base, 16)
    write = index._write

    def late(*args):
        other.add(spark.createDataFrame([(1, "party"), (9, "concert")], "id long, body string"))
        return write(*args)

    monkeypatch.setattr(index, "_write", late)
    index.compact()
    assert ids(index.lookup("concert")) == [0, 9] and ids(index.lookup("party")) == [1] and len(index.segments()) == 2


def test_terms_of_the_index(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "The dancers danced; dancing!"), (4, "ÉCOLE école x")], "id long, body string")
    index = fresh(spark)
    index.add(docs)
    assert ids(index.lookup("école")) == [4] and ids(index.lookup("dance")) == ids(docs.where(F.array_contains(text.stems(F.col("body")), "danc")))
    assert fresh(spark).lookup("dance").count() == 0


@pytest.mark.parametrize("sort_by", ["date", "distance"])
def test_pages_by_key_are_the_whole_order(spark, sort_by):
    """Pages that continue after the last row, joined, are the whole order, ties included."""
    events = made(spark, 90, seed=5)
    events = events.unionByName(events.withColumn("id", F.col("id") + 1000))  # ties in start and distance
    where = {"lat": 37.78, "lng": -122.41, "radius_miles": 3.0, "sort_by": sort_by} if sort_by == "distance" else {}
    whole = [r["id"] for r in search.search(events, NOW - timedelta(days=1), limit=200, **where).collect()]
    pages, after = [], None
    while True:
        rows = search.search(events, NOW - timedelta(days=1), limit=37, after=after, **where).collect()
        if not rows:
            break
        pages += [r["id"] for r in rows]
        after = search.place_of(rows[-1], sort_by)
    assert pages == whole and len(whole) == 180
    plan = search.search(events, NOW - timedelta(days=1), limit=5, after=after, **where)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    with pytest.raises(ValueError):
        search.search(events, NOW, after=after, offset=3, **where)
    with pytest.raises(ValueError):
        search.search(events, NOW, lat=1.0)
