"""Small tables through operators that no query runs."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventengine.operators import digest, health, profile, quality, rank, social
from eventengine.sources import canonical, documents, markup, payloads
from eventengine.sources.registry import SourceRegistry
from eventengine.functions import text, timex

T0 = datetime(2026, 6, 1)


def test_health_report(spark):
    state = "source_name string, status string, last_event_count long, consecutive_zeros long, last_run_at timestamp"
    stored = spark.createDataFrame([("a", "healthy", 5, 0, T0), ("b", "failing", 0, 3, T0)], state)
    fresh = spark.createDataFrame([("b", "healthy", 9, 0, T0 + timedelta(hours=1)), ("a", "degraded", 0, 1, T0 - timedelta(hours=1))], state)
    names = spark.createDataFrame([("a",), ("b",), ("new",)], "source_name string")
    rows = health.report(names, stored, fresh)
    assert {r["source_name"]: (r["status"], r["last_event_count"]) for r in rows.collect()} == {"a": ("healthy", 5), "b": ("healthy", 9), "new": ("unknown", None)}
    assert {r["status"]: (r["sources"], r["events"]) for r in health.counts(rows).collect()} == {"healthy": (2, 14), "unknown": (1, None)}
    assert sorted((r["source_name"], r["status"]) for r in health.replace_keyed(stored, fresh).collect()) == [("a", "degraded"), ("b", "healthy")]
    batch = spark.createDataFrame([("a",), ("a",)], "source_name string")
    assert {r["source_name"]: r["n"] for r in health.run_counts(batch, names).collect()} == {"a": 2, "b": 0, "new": 0}


def test_folders_and_invites(spark):
    folders = spark.createDataFrame([(1, 10, T0), (2, 11, T0 + timedelta(days=1)), (3, 12, T0)], "folder_id long, owner_id long, updated_at timestamp")
    members = spark.createDataFrame([(2, 10), (99, 10)], "folder_id long, user_id long")
    assert [(r["user_id"], r["folder_id"]) for r in social.my_folders(folders, members).where("user_id = 10").collect()] == [(10, 2), (10, 1)]
    asks = spark.createDataFrame([(10, 1), (10, 2), (10, 3), (11, 1)], "user_id long, folder_id long")
    assert {tuple(r) for r in social.allowed(asks, folders, members).select("user_id", "folder_id").collect()} == {(10, 1), (10, 2)}
    token = "abcdefgh-_012345"
    invites = spark.createDataFrame([(token + "a", 3, T0, 14, False), (token + "b", 3, T0, 0, False), (token + "c", 3, T0, 1, False), (token + "d", 3, T0, 14, True), ("short", 3, T0, 14, False), (token + "é", 3, T0, 14, False)], "token string, folder_id long, created_at timestamp, ttl_days int, revoked boolean")
    accepts = spark.createDataFrame([(token + x, u) for x, u in (("a", 10), ("a", 12), ("b", 13), ("c", 14), ("d", 15), ("é", 16), ("zz", 17))] + [("short", 18)], "token string, user_id long")
    got = social.accept(invites, accepts, folders, members, F.lit(T0 + timedelta(days=1)))
    assert {(r["folder_id"], r["user_id"]) for r in got.collect()} == {(3, 10), (3, 13)}, "the owner, the late, the revoked and the ill-formed get nothing"


def test_recorded_signals(spark):
    events = spark.createDataFrame([(1,)], "id long")
    rows = [(1, "save", 1, None, T0), (1, "save", 9, None, T0), (1, "click", 1, None, T0), (1, "odd", 1, None, T0), (1, "onboarding", None, " live music ", T0)]
    got = profile.record_signals(spark.createDataFrame(rows, "user_id long, signal_type string, event_id long, vibe_tag string, created_at timestamp"), events).collect()
    assert sorted((r["signal_type"], r["weight"], r["vibe_tag"]) for r in got) == [("click", 1.0, None), ("onboarding", 6.0, "#livemusic"), ("save", 5.0, None)]


def test_intents_add_to_profiles(spark):
    requests = spark.createDataFrame([(1, 5, "date_night"), (2, 6, "bar_crawl")], "request_id long, user_id long, intent string")
    own = spark.createDataFrame([(5, "#jazz", 1.5), (5, "#rock", 2.0)], "user_id long, tag string, score double")
    got = {(r["request_id"], r["tag"]): r["score"] for r in profile.with_intent(requests, own).collect()}
    assert got[(1, "#jazz")] == 3.5 and got[(1, "#rock")] == 2.0 and got[(2, "#nightlife")] == 5.0 and (2, "#jazz") not in got


def test_yields_and_shares(spark):
    rows = spark.createDataFrame([("a", True, True, True), ("a", False, False, False), ("b", False, True, None)], "source_name string, is_event boolean, llm_extracted boolean, private_location boolean")
    assert {r["source_name"]: (r["n"], r["events"], r["share"]) for r in quality.event_yield(rows, "source_name").collect()} == {"a": (2, 1, 0.5), "b": (1, 0, 0.0)}
    assert {r["source_name"]: r["model_share"] for r in quality.extracted_share(rows).collect()} == {"a": 0.5, "b": 1.0}
    assert {r["source_name"]: (r["private_locations"], r["n"]) for r in quality.private_locations(rows).collect()} == {"a": (1, 2), "b": (0, 1)}


def test_flat_payloads(spark):
    nested = "title string, description string, start_time timestamp, end_time timestamp, source struct<source_id:string,source_record_id:string,source_url:string>, location struct<venue_name:string,address_line1:string,lat:double,lon:double,location_confidence:double>, category_tags array<string>, vibe_tags array<string>, offers struct<price_min:double,currency:string,is_free:boolean>, image_url string, status string, organizer struct<name:string>, social_signals struct<attendee_count:int>"
    row = ("T", None, T0, None, ("s", "r", "u"), ("V", "A", 37.5, -122.25, 0.9), ["c"], ["#t"], (12.5, "USD", False), None, "unknown", ("O",), (7,))
    (r,) = quality.flatten_canonical(spark.createDataFrame([row], nested), 2).collect()
    assert (r["status"], r["location"], float(r["price"]), r["source_tier"], r["organizer_name"], r["attendee_count"]) == ("scheduled", "POINT(-122.25 37.5)", 12.5, 2, "O", 7)


def test_landed_pages_and_nested_payloads(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>one\ntwo</p>")
    (r,) = documents.html_pages(spark, str(tmp_path)).collect()
    assert r["url"].endswith("a.html") and r["body"] == "<p>one\ntwo</p>"
    bodies = spark.createDataFrame([(1, '{"data":{"keywordSearch":{"edges":[{"node":{"id":"1","title":"T"}},{"node":{"id":"2"}}]}}}'), (2, "[]"), (3, '{"data":{"children":[{"data":{"id":"p","title":"Post"}}]}}')], "doc_id long, body string")
    assert [(r["doc_id"], r["id"], r["title"]) for r in documents.graph_nodes(bodies, "struct<id:string,title:string>").orderBy("id").collect()] == [(1, "1", "T"), (1, "2", None)]
    assert [(r["doc_id"], r["title"]) for r in documents.listing_children(bodies, "struct<id:string,title:string>").collect()] == [(3, "Post")]


@pytest.mark.parametrize("topics, kind", [(["a", " b ", "a"], "array<string>"), ([("a",), ("b",), ("a",)], "array<struct<name:string>>")])
def test_group_events(spark, topics, kind):
    schema = f"doc_id long, pos int, id string, title string, name string, dateTime string, eventUrl string, link string, venue_name string, venue_lat double, venue_lng double, topics {kind}"
    rows = [(1, 0, "e", None, " Meet ", "2026-06-01T19:00:00-07:00", None, "https://x.example", "V", None, None, topics), (1, 1, "f", "No time", None, None, "u", None, None, 1.0, 2.0, topics)]
    (r,) = payloads.group_events(spark.createDataFrame(rows, schema), 37.0, -122.0).collect()
    assert (r["title"], r["start_at"], r["external_url"], r["lat"], r["tags"], r["location_confidence"]) == ("Meet", datetime(2026, 6, 2, 2), "https://x.example", 37.0, ["a", "b"], 0.85)


def test_annotated_hints(spark):
    posts = spark.createDataFrame([(1, "x", T0), (2, "y", T0), (3, "z", T0)], "doc_id long, text string, posted_at timestamp")
    notes = spark.createDataFrame([(1, True, 0.5, "t" * 200, "v"), (2, True, 0.49, "b", None), (3, False, 0.9, "c", None)], "doc_id long, is_event boolean, confidence double, title string, venue_name string")
    (r,) = payloads.annotated_hints(posts, notes).collect()
    assert (r["doc_id"], len(r["title"]), r["confidence"]) == (1, 120, 0.5)


@pytest.mark.parametrize(
    "said, want",
    [
        ("Big party 8pm tonite", ("Big party 8pm tonite", None, datetime(2026, 3, 5, 4))),
        ("Any plans this friday 8pm? Something at The Den.", None),
        ("Gig at The Blue Room next wednesday", ("Gig at The Blue Room next wednesday", "The Blue Room", datetime(2026, 3, 12, 2))),
        ("Drinks at Zeitgeist. Tomorrow", ("Drinks at Zeitgeist", "Zeitgeist", datetime(2026, 3, 6, 3))),
        ("Show 12am friday", ("Show 12am friday", None, datetime(2026, 3, 6, 8))),
        ("nothing here", None), (None, None),
    ],
)
def test_post_hints(spark, said, want):
    # Wednesday, noon local time
    rows = payloads.post_hints(spark.createDataFrame([(0, said, datetime(2026, 3, 4, 20))], "doc_id long, text string, posted_at timestamp")).collect()
    assert [(r["title"], r["venue_name"], r["start_at"]) for r in rows] == ([want] if want else [])


def test_dated_cards(spark):
    lines = ["Line-up", "Sunday, June 14", "Headliner at 2pm", "with Some Support", "Lottery opens June 1 @ 10am", "Saturday, June 21", "Wrong weekday", "Sunday, June 28", "Second Act", "Featuring Others", "tickets from 10 am"]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "doc_id long, pos int, line string")
    got = markup.dated_cards(df, F.lit(2026)).orderBy("pos").collect()
    assert [(str(r["day"]), r["title"], r["time_text"], r["other_acts"]) for r in got] == [("2026-06-14", "Headliner at 2pm", "2pm", "Some Support"), ("2026-06-28", "Second Act", None, "Others")]


def test_deep_json_is_walked_whole(spark):
    deep = '{"x":[' * 150 + '{"name":"Deep","start_at":"2026-06-01","url":"deep"}' + "]}" * 150
    (r,) = markup.embedded_state(spark.createDataFrame([(0, f'<script id="__NEXT_DATA__">{deep}</script>')], "doc_id long, body string"), "https://x.example").collect()
    assert r["title"] == "Deep"
    ld = '{"@graph":[' * 150 + '{"@type":"MusicEvent","name":"Low","url":"https://x.example/e/1?q=1","location":{"name":"V"}}' + "]}" * 150
    (r,) = markup.json_ld(spark.createDataFrame([(0, f'<script type="application/ld+json">{ld}</script>')], "doc_id long, body string")).collect()
    assert (r["name"], r["url"]) == ("Low", "https://x.example/e/1")


def test_a_failing_source_leaves_the_others(spark):
    registry = SourceRegistry()
    registry.register("good", lambda d: d.select("doc_id"))
    registry.register("typo", lambda d: d.select("no_such_column"))
    registry.register("late", lambda d: d.select(F.raise_error(F.lit("broken page")).cast("long").alias("doc_id")))
    docs = spark.createDataFrame([(1, "good"), (2, "late"), (3, "Good ")], "doc_id long, source_name string")
    rows, failed = registry.collect_each(docs)
    assert sorted(r["doc_id"] for r in rows.collect()) == [1, 3] and set(failed) == {"typo", "late"}


def test_dates_of_links_and_issues(spark):
    venues, cities = spark.createDataFrame([], "name string, lat double, lon double, ordinal int"), spark.createDataFrame([], "name string, lat double, lon double")
    rows = spark.createDataFrame([(0, 0, "https://x.example/events/2026/3/12/show", "A", "8pm (doors)", None, T0), (0, 1, "https://x.example/show", "B", "Mar 20 9pm", "TBA", T0), (0, 2, "https://x.example/other", "C", "9pm", None, T0)], "doc_id long, pos int, url string, title string, when_text string, venue_name string, issued_at timestamp")
    as_of = F.lit("2026-03-05 20:00:00").cast("timestamp")
    got = {r["title"]: r for r in canonical.canonical(rows.drop("issued_at"), canonical.SourceRules("s", 2, dates="url"), as_of, venues, cities).collect()}
    assert {t: r["start_at"] for t, r in got.items()} == {"A": datetime(2026, 3, 13, 3), "B": datetime(2026, 3, 21, 4)}, "without a date, no event"
    assert got["B"]["private_location"] and not got["A"]["private_location"]
    issue = rows.withColumn("when_text", F.lit("January 3 @ 8pm")).withColumn("issued_at", F.lit("2026-12-20 20:00:00").cast("timestamp"))
    (r, *_) = canonical.canonical(issue, canonical.SourceRules("s", 2, dates="issue", explicit_date=True), as_of, venues, cities).collect()
    assert r["start_at"] == datetime(2027, 1, 4, 4), "a date long before its issue is the next year's"


@pytest.mark.parametrize("said, want", [("June 12 @ 8pm", True), ("on 2026-06-12", True), ("Sept. 3", True), ("in May we rest", False), ("12 June", False), ("late 8pm", False)])
def test_explicit_dates(spark, said, want):
    assert spark.range(1).select(timex.explicit_date(F.lit(said)).alias("x")).first()["x"] is want


@pytest.mark.parametrize(
    "day, clock, want",
    [
        ("2026-06-14", "8:30 PM", datetime(2026, 6, 15, 3, 30)), ("Sat Jun 14", None, datetime(2026, 6, 15, 2)), ("Jan 3, 2027", "doors 12am", datetime(2027, 1, 3, 8)), ("Dec 31", "noon", datetime(2027, 1, 1, 3)),
        # no day, no instant, whatever the time; nor for a day that is none or a month that is spelled out
        (None, "8pm", None), ("", "8pm", None), ("tonight", "8pm", None), ("2026-02-30", "8pm", None), ("Feb 30", "8pm", None), ("Xyz 12", None, None), ("June 14", "8pm", None),
        # clocks go forward on 8 March at two and back on 1 November at two
        ("Mar 8", "1:59am", datetime(2026, 3, 8, 9, 59)), ("Mar 8", "2:30am", datetime(2026, 3, 8, 10, 30)), ("Mar 8", "3am", datetime(2026, 3, 8, 10)), ("Nov 1", "1:30am", datetime(2026, 11, 1, 8, 30)), ("Nov 1", "2am", datetime(2026, 11, 1, 10)),
    ],
)
def test_instants_of_cards(spark, day, clock, want):
    got = spark.range(1).select(timex.card_instant(F.lit(day).cast("string"), F.lit(clock).cast("string"), F.lit("2026-05-01").cast("date")).alias("x")).first()["x"]
    assert got == want


def test_stored_rows_and_payloads(spark):
    from decimal import Decimal

    from eventengine.schema import CANON

    full = {"title": "T", "start_at": T0, "source_name": "s", "source_tier": 1, "location": "POINT(1 2)", "categories": ["c"], "tags": ["#t"], "price": Decimal("5.00"), "status": "postponed", "attendee_count": 7, "location_confidence": 0.9, "is_free": True, "description": "d"}
    row = lambda **more: tuple((full | more).get(f) for f in CANON.fieldNames())
    stored = spark.createDataFrame([(1, *row()), (2, *row(tags=None, categories=None))], f"id long, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in CANON.fields)}")
    out = {r["id"]: r for r in quality.to_payload(stored).collect()}
    assert tuple(out[1])[1:] == row() and (out[2]["tags"], out[2]["categories"]) == ([], [])
    # there and back: a payload of the row itself leaves the row as it is
    kind = f"struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in CANON.fields)}>"
    cases = {"same": row(), "bare": row(status=None, tags=None, attendee_count=None, location_confidence=0.0, is_free=None, description=None), "worse": row(status="cancelled", title="New"), "better": row(status="scheduled", price=None), "odd": row(status="odd")}
    pairs = spark.createDataFrame([(k, row(), v) for k, v in cases.items()], f"k string, stored {kind}, payload {kind}")
    got = {r["k"]: r for r in quality.apply_payload(pairs).collect()}
    assert tuple(got["same"])[1:] == row()
    assert [got["bare"][c] for c in ("status", "tags", "attendee_count", "location_confidence", "is_free", "description")] == ["postponed", [], 0, 1.0, False, None]
    assert [(got[k]["status"], got[k]["title"], got[k]["price"]) for k in ("worse", "better", "odd")] == [("cancelled", "New", Decimal("5.00")), ("postponed", "T", None), ("postponed", "T", Decimal("5.00"))]


def test_texts_of_models(spark):
    say = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert say(text.model_tags(F.lit("- live music, #Jazz | * late night\n•food,# ,,live  music,one,two"))) == ["#livemusic", "#Jazz", "#latenight", "#food", "#one"]
    assert say(text.model_tags(F.lit(None).cast("string"))) == []
    assert say(text.json_object(F.lit('Sure! {"a": {"b": 1}} Hope it helps'))) == '{"a": {"b": 1}}'
    assert [say(text.json_object(F.lit(x).cast("string"))) for x in ("no braces", "{broken", "{a} and {b}", None)] == [None] * 4


def test_the_scorer_without_a_cap(spark):
    events = spark.createDataFrame([(1, ["#a", "#b", "#c"]), (2, ["#d"])], "id long, tags array<string>")
    preferred = spark.createDataFrame([(7, "#A"), (7, "b")], "user_id long, tag string")
    profile_ = spark.createDataFrame([(7, "#c", 3.0)], "user_id long, tag string, score double")
    score = lambda capped: {(r["user_id"], r["id"]): (r["vibe_score"], r["matched_tags"]) for r in rank.tag_scores(events, preferred, profile_, capped=capped).collect()}
    assert score(True) == {(7, 1): (100.0, ["#a", "#b", "#c"])} and score(False) == {(7, 1): (230.0, ["#a", "#b", "#c"])}


def test_a_digest_is_one_file_in_order(spark, tmp_path):
    lines = spark.createDataFrame([(k, f"line {k}") for k in range(30)], "n int, line string").repartition(5)
    digest.write_digest(lines, f"{tmp_path}/digest")
    (part,) = (tmp_path / "digest").glob("part-*")
    assert part.read_text().splitlines() == [f"line {k}" for k in range(30)]
