from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventengine.functions import geo, money, similarity, text, timex


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value, price, free",
    [("Free entry", 0.0, True), ("$15", 15.0, False), ("$ 12.50 at the door, free before 9", 12.5, False), ("sold out", None, False), (None, None, False)],
)
def test_price(spark, value, price, free):
    p, f = money.parse_price(F.lit(value).cast("string"))
    r = spark.range(1).select(p.alias("p"), f.alias("f")).first()
    assert (r["p"], r["f"]) == (price, free)


@pytest.mark.parametrize(
    "value, want",
    [
        ("2026-03-02 8pm", datetime(2026, 3, 2, 20)),
        ("Mar 14 7:15 pm", datetime(2026, 3, 14, 19, 15)),
        ("March 2, 2027", datetime(2027, 3, 2, 19)),
        ("Feb 30", None),
        ("12am doors", datetime(2026, 1, 10, 0)),
        ("doors 12am", None),
        ("", None),
    ],
)
def test_flexible_datetime(spark, value, want):
    c = F.from_utc_timestamp(timex.flexible_datetime(F.lit(value), F.lit(date(2026, 1, 10))), timex.TZ)
    assert one(spark, c) == want


@pytest.mark.parametrize(
    "value, first, last",
    [
        ("Feb 14–Mar 28, 2026", date(2026, 2, 14), date(2026, 3, 28)),
        ("Mar 7–31, 2026", date(2026, 3, 7), date(2026, 3, 31)),
        ("Nov 14, 2025–Jan 10, 2027", date(2025, 11, 14), date(2027, 1, 10)),
        ("Dec 20–Jan 15, 2026", date(2026, 12, 20), date(2027, 1, 15)),
        ("someday", None, None),
    ],
)
def test_date_range(spark, value, first, last):
    a, b = timex.date_range(F.lit(value), F.lit(date(2026, 1, 1)))
    r = spark.range(1).select(F.from_utc_timestamp(a, timex.TZ).alias("a"), F.from_utc_timestamp(b, timex.TZ).alias("b")).first()
    assert (r["a"] and r["a"].date(), r["b"] and r["b"].date()) == (first, last)
    if last:
        assert (r["b"].hour, r["b"].minute) == (23, 59)


@pytest.mark.parametrize(
    "label, start, end",
    [
        ("tonight", datetime(2026, 3, 7, 18), datetime(2026, 3, 8, 3)),
        ("tomorrow", datetime(2026, 3, 8, 10), datetime(2026, 3, 9, 2)),
        # 02:00 does not exist that night
        ("this_saturday", datetime(2026, 3, 7, 10), datetime(2026, 3, 8, 3)),
        ("this_weekend", datetime(2026, 3, 7, 10), datetime(2026, 3, 8, 23, 59)),
        ("this_friday", datetime(2026, 3, 13, 10), datetime(2026, 3, 14, 2)),
    ],
)
def test_windows_cross_the_clock_change(spark, label, start, end):
    # Saturday noon; the clocks change in the night
    now = F.to_utc_timestamp(F.lit("2026-03-07 12:00:00").cast("timestamp"), timex.TZ)
    a, b = timex.window_of(F.lit(label), now)
    r = spark.range(1).select(F.from_utc_timestamp(a, timex.TZ).alias("a"), F.from_utc_timestamp(b, timex.TZ).alias("b")).first()
    assert (r["a"], r["b"]) == (start, end)


def test_weekend_preset_on_a_saturday_is_the_next_one(spark):
    now = F.to_utc_timestamp(F.lit("2026-03-07 12:00:00").cast("timestamp"), timex.TZ)
    a, _ = timex.preset_window("this_weekend", now)
    assert one(spark, F.from_utc_timestamp(a, timex.TZ)) == datetime(2026, 3, 13, 17)


@pytest.mark.parametrize(
    "tags, want",
    [(["#Jazz ", "live music", " ", "#Jazz"], ["#Jazz", "#livemusic"]), ([], []), (["#"], [])],
)
def test_profile_tags(spark, tags, want):
    df = spark.createDataFrame([(tags,)], "t array<string>")
    assert df.select(text.profile_tags(F.col("t")).alias("x")).first()["x"] == want


def test_onboarding_tags(spark):
    got = one(spark, text.onboarding_tags(F.lit("I love jazz music with friends")))
    assert got == ["#Love", "#LoveJazz", "#Jazz", "#JazzMusic", "#Music"]


def test_intents(spark):
    rows = [("Date night tonight in Oakland", "date_night", "oakland", "tonight"), ("guests visiting, this weekend on Sunday", "out_of_town_guests", None, "this_sunday"), ("", "general_night_out", None, "upcoming_week")]
    df = spark.createDataFrame([(p,) for p, *_ in rows], "p string")
    got = df.select("p", text.intent(F.col("p")).alias("i"), text.geography(F.col("p")).alias("g"), text.timeframe_label(F.col("p")).alias("l")).collect()
    assert {tuple(r) for r in got} == set(rows)


@pytest.mark.parametrize(
    "a, b, metres, within",
    [
        # degrees of the meridian and the equator on the ellipsoid, and a long line between two known cities
        ((0.0, 0.0), (1.0, 0.0), 110_574.389, 0.5), ((0.0, 0.0), (0.0, 1.0), 111_319.491, 0.5), ((45.0, 7.0), (45.01, 7.0), 1_111.318, 0.05), ((60.0, 7.0), (60.0, 7.01), 558.000, 0.05),
        ((37.7749, -122.4194), (37.7749, -122.4194), 0.0, 0.0), ((0.0, 179.995), (0.0, -179.995), 1_113.195, 0.05),
    ],
)
def test_distance(spark, a, b, metres, within):
    m = one(spark, geo.distance_m(*map(F.lit, (*a, *b))))
    assert abs(m - metres) <= within


@pytest.mark.parametrize("lat, lon", [(37.77, -122.42), (64.1, -21.9), (0.0, 179.999), (-54.8, -179.9999), (80.0, 10.0)])
def test_cells_and_boxes_hold_the_circle(spark, lat, lon):
    """Points around a circle of a mile are in its cells and its box, wherever it is."""
    import math

    points = []
    for k in range(72):
        for share in (0.5, 0.999):
            d = share * geo.MILE_M / 111_400
            x = lon + d * math.sin(k / 36 * math.pi) / math.cos(math.radians(lat))
            points.append((lat + d * math.cos(k / 36 * math.pi), (x + 180) % 360 - 180))
    df = spark.createDataFrame(points, "lat double, lon double").where(geo.distance_m(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) <= geo.MILE_M)
    cells = {tuple(c) for c in spark.range(1).select(geo.cells_within(F.lit(lat), F.lit(lon), geo.MILE_M).alias("c")).first()["c"]}
    rows = df.select(geo.cell(F.col("lat"), F.col("lon")).alias("c"), geo.in_box(F.col("lat"), F.col("lon"), lat, lon, geo.MILE_M).alias("ok")).collect()
    assert len(rows) > 60 and all(r["ok"] and tuple(r["c"]) in cells for r in rows)


def test_wkt_round_trip(spark):
    lat, lon = geo.read_wkt(geo.point_wkt(F.lit(37.5), F.lit(-122.25)))
    r = spark.range(1).select(lat.alias("a"), lon.alias("b")).first()
    assert (r["a"], r["b"]) == (37.5, -122.25)


def slow_ratio(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
    return 200.0 * m[-1][-1] / (len(a) + len(b)) if a or b else 100.0


@settings(max_examples=200, deadline=None)
@given(st.text("abc d", max_size=12), st.text("abc d", max_size=12))
def test_indel_ratio_is_exact(a, b):
    assert similarity.indel_ratio(a, b) == pytest.approx(slow_ratio(a, b))


def test_token_set_ratio():
    assert similarity.token_set_ratio("Comedy Night", "Free Sunday Comedy Night") == 100.0
    assert similarity.token_set_ratio("", "x") == 0.0
    assert similarity.token_set_ratio("band one band two", "band two band one") == 100.0
