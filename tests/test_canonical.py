from datetime import datetime

import pytest
from pyspark.sql import functions as F

from eventengine.functions import money, text, timex
from eventengine.operators import quality, tables
from eventengine.sources import canonical



def now():
    return F.lit("2026-03-05 20:00:00").cast("timestamp")



def local(spark, a, b):
    r = spark.range(1).select(F.from_utc_timestamp(a, timex.TZ).alias("a"), F.from_utc_timestamp(b, timex.TZ).alias("b")).first()
    return r["a"], r["b"]


@pytest.mark.parametrize(
    "value, start, end",
    [
        ("Sat: Mar 14 (10pm-4am)", datetime(2026, 3, 14, 22), datetime(2026, 3, 15, 4)),
        ("Fri: Apr 3", datetime(2026, 4, 3, 20), datetime(2026, 4, 3, 23, 59)),
        ("Dec 31 9:30pm-11pm", datetime(2026, 12, 31, 21, 30), datetime(2026, 12, 31, 23)),
        ("someday", None, None),
    ],
)
def test_listing_range(spark, value, start, end):
    assert local(spark, *timex.listing_range(F.lit(value), now())) == (start, end)


@pytest.mark.parametrize(
    "full, day, start, end",
    [
        ("Tonight 7:30 pm to 10 pm", "Tonight", datetime(2026, 3, 5, 19, 30), datetime(2026, 3, 5, 22)),
        ("Sunday, March 29, 2026 - 10 pm - 2 am", "Sunday, March 29, 2026", datetime(2026, 3, 29, 22), datetime(2026, 3, 30, 2)),
        ("no time", "Tomorrow", datetime(2026, 3, 6), None),
        ("8 pm", "some day", None, None),
    ],
)
def test_page_times(spark, full, day, start, end):
    assert local(spark, *timex.page_times(F.lit(full), F.lit(day), now())) == (start, end)


@pytest.mark.parametrize(
    "texts, want",
    [
        (("| Cost:", "x | Cost: FREE | $1 Beer"), (0.0, "USD", True)),
        (("Cost: $12.50*",), (12.5, "USD", False)),
        (("free-form jazz", None), (0.0, "USD", True)),
        (("nothing",), (None, None, False)),
    ],
)
def test_cost_fields(spark, texts, want):
    got = spark.range(1).select(money.cost_fields(*[F.lit(t).cast("string") for t in texts]).alias("c")).select("c.*").first()
    assert tuple(got) == want


def test_address_and_venue(spark):
    v, a = text.venue_after_dash(F.lit("A long night — The Room, 12 Main St. More"))
    r = spark.range(1).select(text.street_address(F.lit("Mar 1 | Venue | 12 Main Street, Some Town, CA 94100 | x")).alias("s"), v.alias("v"), a.alias("a")).first()
    assert (r["s"], r["v"], r["a"]) == ("12 Main Street, Some Town, CA 94100", "The Room", "12 Main St")


def test_candidates_to_canonical_rows(spark, tmp_path):
    venues = spark.createDataFrame([("the cave", 37.1, -122.1, 0)], "name string, lat double, lon double, ordinal int")
    cities = spark.createDataFrame([("Oakland", 37.8, -122.3)], "name string, lat double, lon double")
    rows = [
        (0, 0, "https://x.example/e/1/", "Night", "Mar 14 10pm-4am", "The Cave (San Mateo)", "$10"),
        (0, 1, "https://x.example/e/2", "Other", "Mar 15", "Unknown Hall (Oakland)", "free"),
        (0, 2, "https://x.example/e/3", "Secret", "Mar 16", "TBA", None),
        (0, 3, "https://x.example/e/4", "Undated", "soon", "The Cave", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, pos int, url string, title string, when_text string, venue_name string, price_text string")
    out = canonical.canonical(df, canonical.SourceRules("s", 3, "listing"), now(), venues, cities)
    got = {r["source_event_id"]: r for r in out.collect()}
    assert set(got) == {"1", "2", "3"}
    assert (got["1"]["location"], got["1"]["location_confidence"], float(got["1"]["price"])) == ("POINT(-122.1 37.1)", 0.9, 10.0)
    assert (got["2"]["location"], got["2"]["location_confidence"], got["2"]["is_free"]) == ("POINT(-122.3 37.8)", 0.5, True)
    assert got["3"]["venue_name"] is None and got["3"]["location_confidence"] == 0.3
    good, bad = quality.normalize(out)
    assert (good.count(), bad.count()) == (3, 0)
    tables.write_version(tables.by_start_date(good), str(tmp_path), 1, "start_date")
    assert tables.read_version(spark, str(tmp_path), 1).where("start_date = date'2026-03-15'").count() == 1


def test_detail_pages(spark):
    df = spark.createDataFrame([(0, "https://x.example/a", "Fair", "Sunday, March 8, 2026 11 am | Hall | 1 Oak Road, Town, CA | Cost: FREE", "Sunday, March 8, 2026", "| Cost:"), (1, "u", "Undated", "11 am", "x", "")], "doc_id long, url string, title string, detail_text string, date_text string, cost_text string")
    (r,) = canonical.detail_pages(df, now()).collect()
    assert (r["raw_address"], r["is_free"], r["start_at"]) == ("1 Oak Road, Town, CA", True, datetime(2026, 3, 8, 18))
