"""Events along a space-filling curve: ranges of keys and what a radius reads."""

import math
import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventengine.operators import layout, search

NOW = datetime(2026, 7, 11, 9)


def key(lat, lon):
    """Bit by bit."""
    x = min(max(math.floor((lon + 180) / 360 * 2**layout.BITS), 0), 2**layout.BITS - 1)
    y = min(max(math.floor((lat + 90) / 180 * 2**layout.BITS), 0), 2**layout.BITS - 1)
    return sum(((x >> i & 1) << 2 * i) | ((y >> i & 1) << 2 * i + 1) for i in range(layout.BITS))


def test_keys_bit_by_bit(spark):
    rng = random.Random(2)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0), (37.7749, -122.4194)]
    got = spark.createDataFrame(points, "lat double, lon double").select("lat", "lon", layout.place(F.col("lat"), F.col("lon")).alias("k")).collect()
    assert all(r["k"] == key(r["lat"], r["lon"]) for r in got)
    assert spark.range(1).select(layout.place(F.lit(None).cast("double"), F.lit(1.0)).alias("k")).first()["k"] is None


@pytest.mark.parametrize("lat, lon", [(37.7749, -122.4194), (0.0, 0.0), (0.001, 179.999), (-45.0, -179.9999), (89.95, 10.0), (-89.0, 100.0), (60.0, 0.0)])
@pytest.mark.parametrize("metres", [50.0, 3_000.0, 200_000.0])
def test_ranges_hold_the_circle(lat, lon, metres):
    rng = random.Random(7)
    found = layout.ranges_within(lat, lon, metres)
    assert 0 < len(found) <= layout.RANGES and all(a <= b for a, b in found) and all(x[1] + 1 < y[0] for x, y in zip(found, found[1:], strict=False))
    for _ in range(300):
        turn, r = rng.uniform(0, 2 * math.pi), metres * math.sqrt(rng.random())
        # a step on the sphere with degrees that are a little too long
        p = lat + math.degrees(r * math.cos(turn) / 6_400_000)
        if abs(p) >= 90:
            continue
        q = (lon + math.degrees(r * math.sin(turn) / 6_400_000 / max(math.cos(math.radians(max(abs(p), abs(lat)))), 1e-6)) * 0.99 + 180) % 360 - 180 if abs(lat) < 89.5 else rng.uniform(-180, 180)
        assert any(a <= key(p, q) <= b for a, b in found)
    if abs(lat) < 80 and metres < 10_000:
        assert sum(b - a + 1 for a, b in found) < 1e-5 * 4**layout.BITS


def scanned(df):
    """Rows that the scan has given out, after a run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            found += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
    return found


@pytest.fixture(scope="module")
def stored(spark):
    rng = random.Random(3)
    rows = [(i, f"Event {i}", NOW + timedelta(minutes=rng.randint(1, 9_999)), 37.2 + rng.random(), -122.9 + rng.random(), rng.choice([0.3, 0.9])) for i in range(20_000)]
    # a third at one point, as at a large venue, and some without a point
    rows += [(100_000 + i, "Same place", NOW + timedelta(minutes=i), 37.7749, -122.4194, 0.9) for i in range(10_000)] + [(200_000, "Nowhere", NOW + timedelta(1), None, None, 0.9)]
    events = spark.createDataFrame(rows, "id long, title string, start_at timestamp, lat double, lon double, location_confidence double")
    plain, placed = (tempfile.mkdtemp(prefix="spark-") for _ in range(2))
    events.write.mode("overwrite").parquet(plain)
    layout.by_place(events).write.mode("overwrite").option("parquet.block.size", 32_768).option("parquet.page.row.count.limit", 500).option("parquet.block.size.row.check.min", 10).parquet(placed)
    return spark.read.parquet(plain), spark.read.parquet(placed)


@pytest.mark.parametrize("lat, lng, miles", [(37.5, -122.5, 1.0), (37.9, -122.2, 3.0), (37.7749, -122.4194, 0.2), (37.2, -122.9, 2.0)])
def test_a_radius_reads_few_row_groups(spark, stored, lat, lng, miles):
    plain, placed = stored
    find = lambda df, **more: search.search(df, NOW, lat=lat, lng=lng, radius_miles=miles, sort_by="distance", limit=200, **more)
    want = [(r["id"], r["distance_miles"]) for r in find(plain).collect()]
    got = find(placed)
    assert [(r["id"], r["distance_miles"]) for r in got.collect()] == want and want
    read, there = scanned(layout.near(placed, lat, lng, miles * 1609.34).select("id")), placed.count()
    crowd = 10_000 if (lat, miles) == (37.7749, 0.2) else 0
    assert read <= crowd + 0.15 * there
