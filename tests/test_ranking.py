"""Ranking, digests and itineraries against rules written down by hand."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventengine.functions import geo, stem, text, timex
from eventengine.operators import digest, geocode, health, itinerary, rank, search
from eventengine.plans import queries

NOW = datetime(2026, 7, 11, 9)
EVENT = "id long, title string, start_at timestamp, created_at timestamp, categories array<string>, tags array<string>, is_free boolean, price decimal(10,2), venue_name string, external_url string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ev(i, days=1, age_hours=72, category="c", tags=(), **more):
    row = {"id": i, "title": f"Event {i}", "start_at": NOW + timedelta(days=days), "created_at": NOW - timedelta(hours=age_hours), "categories": [category] if category else [], "tags": list(tags), "is_free": False, "price": None, "venue_name": "Room", "external_url": None}
    return tuple((row | more).values())


def test_rank_without_user(spark):
    def order(rows, counts):
        got = rank.rank_without_user(spark.createDataFrame(rows, EVENT), spark.createDataFrame(counts, "event_id long, people_interested long"), F.lit(NOW))
        return [r["id"] for r in got.collect()]

    assert order([ev(2), ev(1)], [(1, 10), (2, 0)]) == [1, 2], "more people first"
    assert order([ev(2, age_hours=720), ev(1, age_hours=1)], []) == [1, 2], "newer first"
    assert order([ev(1, days=2), ev(3), ev(2)], [(1, 5), (2, 5), (3, 5)]) == [2, 3, 1], "sooner, then the lower id"
    assert order([ev(1, age_hours=720), ev(2, age_hours=1)], [(1, 7)]) == [2, 1], "25 + 70 is less than 100 + 0"


@pytest.mark.parametrize(
    "more, piece",
    [
        ({"is_free": True}, " · Room · Free"), ({"price": 78}, " · Room · $78"), ({"price": 7.5}, " · $7.50"), ({}, " · price TBA"), ({"price": 0}, " · $0"), ({"venue_name": None}, " · TBA · price TBA"),
        ({"external_url": "https://x.example/1"}, " · [link](https://x.example/1)"), ({"tags": ["#a", "#b", "#c"]}, " · _#a #b_"), ({}, "- **Event 1** — Sun Jul 12 2:00am · "),
    ],
)
def test_digest_lines(spark, more, piece):
    from decimal import Decimal

    more = {k: Decimal(str(v)) if k == "price" else v for k, v in more.items()}
    ranked = spark.createDataFrame([ev(1, **more)], EVENT).withColumn("total_score", F.lit(1.0))
    lines = [r["line"] for r in digest.digest_lines(ranked, NOW).orderBy("n").collect()]
    assert lines[:3] == ["# Events digest — 2026-07-11", "_Window: next 7 days_", ""] and len(lines) == 6
    assert piece in lines[3] and (not more.get("is_free") or "$" not in lines[3])


def test_digest_of_nothing_and_of_many(spark):
    none = spark.createDataFrame([], EVENT).withColumn("total_score", F.lit(1.0))
    assert digest.EMPTY_NOTE in [r["line"] for r in digest.digest_lines(none, NOW).collect()]
    many = spark.createDataFrame([ev(i) for i in range(30)], EVENT).withColumn("total_score", F.lit(100.0) - F.col("id"))
    lines = [r["line"] for r in digest.digest_lines(many, NOW, top=3, fallback=True).orderBy("n").collect()]
    assert [x.split("**")[1] for x in lines if x.startswith("- ")] == ["Event 0", "Event 1", "Event 2"] and digest.FALLBACK_NOTE in lines


def test_user_digest(spark):
    rows = spark.createDataFrame([ev(1, tags=["#a"]), ev(2, tags=["#b"], age_hours=1), ev(3, tags=["#a", "#b"], category="d"), ev(4, days=9, tags=["#a"])], EVENT)
    users = spark.createDataFrame([(1, ["#A"]), (2, [])], "user_id long, preferred_vibes array<string>")
    signals = spark.createDataFrame([], "user_id long, event_id long, signal_type string, vibe_tag string, created_at timestamp, weight double")

    def titles(user):
        lines = [r["line"] for r in digest.user_digest(rows, users, signals, user, NOW).orderBy("n").collect()]
        return [x.split("**")[1] for x in lines if x.startswith("- ")], digest.FALLBACK_NOTE in lines

    # 1 and 3 match; 2 does not, but is newer; 4 is outside the window
    assert titles(1) == (["Event 1", "Event 3", "Event 2"], False)
    assert titles(2) == titles(None) == titles(77) == (["Event 2", "Event 1", "Event 3"], True)


def brute_best(events, likes, profile, counts, least):
    """The rule over all events of one user: score, order, penalty for the category before, order again."""
    def score(e):
        tags = {t.lower() for t in e["tags"]}
        raw = 100 * len(tags & likes) + 10 * sum(profile.get(t, 0) for t in tags)
        age = (NOW - e["created_at"]).total_seconds() / 3600
        fresh = 100 if age <= 24 else 75 if age <= 48 else 50 if age <= 168 else 25
        return min(raw, 100.0), round(0.5 * min(raw, 100.0) + 0.25 * min(10 * counts.get(e["id"], 0), 100) + 0.15 * fresh + 10, 9)

    scored = sorted(((score(e)[1], e, score(e)[0]) for e in events), key=lambda x: (-x[0], x[1]["start_at"], x[1]["id"]))
    final, before = [], None
    for total, e, vibe in scored:
        category = e["categories"][0] if e["categories"] else None
        final.append((total - (10 if category is not None and category == before else 0), e, vibe))
        before = category
    final.sort(key=lambda x: (-x[0], x[1]["start_at"], x[1]["id"]))
    return final


@pytest.mark.parametrize("categories, least, seed", [(["a", "b", "c"], 5, 1), (["a"], 3, 2), (["a", None], 4, 3), (list("abcdefgh"), 60, 4)])
def test_best_matches_equal_brute_force(spark, categories, least, seed):
    """With one category alone nearly all are penalised, so that the search goes deeper and deeper."""
    rng = random.Random(seed)
    tags = ["#a", "#b", "#c", "#d", "#e"]
    rows = [ev(i, days=rng.randint(1, 6), age_hours=rng.choice([1, 30, 100, 900]), category=rng.choice(categories), tags=rng.sample(tags, rng.randint(0, 3))) for i in range(400)]
    likes = {u: set(rng.sample(tags, rng.randint(0, 2))) for u in range(12)}
    weights = {u: {t: float(rng.randint(1, 4)) for t in rng.sample(tags, rng.randint(0, 2))} for u in range(12)}
    counts = {i: rng.randint(0, 12) for i in range(0, 400, 3)}
    df = spark.createDataFrame(rows, EVENT)
    got = {}
    best = rank.best_matches(
        df, spark.createDataFrame([(u, t) for u, ts in likes.items() for t in ts], "user_id long, tag string"), spark.createDataFrame([(u, t, w) for u, ts in weights.items() for t, w in ts.items()], "user_id long, tag string, score double"),
        spark.createDataFrame(list(counts.items()), "event_id long, people_interested long"), F.lit(NOW), least,
    )
    for r in best.collect():
        got.setdefault(r["user_id"], []).append((r["rank"], r["id"], round(r["total_score"], 6), r["vibe_score"]))
    events = [r.asDict() for r in df.collect()]
    for u in range(12):
        want = [(e["id"], round(total, 6), vibe) for total, e, vibe in brute_best(events, likes[u], weights[u], counts, least) if vibe > 0][:least]
        assert [x[1:] for x in sorted(got.get(u, []))] == want
        assert [x[0] for x in sorted(got.get(u, []))] == list(range(1, len(want) + 1))


def test_one_category_stops_near_the_limit(spark, monkeypatch):
    """Where all but the first are penalised, the score bound ends the search as soon as totals have fallen by the penalty."""
    rng = random.Random(11)
    rows = [ev(i, age_hours=rng.choice([1, 30, 100, 900]), category="same", tags=["#a"] if i % 2 else []) for i in range(3_000)]
    counts = {i: rng.randint(0, 10) if i % 50 < 2 else 0 for i in range(3_000)}
    df = spark.createDataFrame(rows, EVENT)
    likes = spark.createDataFrame([(u, "#a") for u in range(20)], "user_id long, tag string")
    none, interest = spark.createDataFrame([], "user_id long, tag string, score double"), spark.createDataFrame(list(counts.items()), "event_id long, people_interested long")
    read, keep = {"common": [], "head": []}, rank.written

    def seen(frame, name):
        out = keep(frame, name)
        if name in read:
            read[name].append(out.count())
        return out

    monkeypatch.setattr(rank, "written", seen)
    got = sorted(rank.best_matches(df, likes, none, interest, F.lit(NOW), 25).where("user_id = 3").collect(), key=lambda r: r["rank"])
    events = [r.asDict() for r in df.collect()]
    brute = brute_best(events, {"#a"}, {}, counts, 25)
    assert [(r["id"], round(r["total_score"], 6)) for r in got] == [(e["id"], round(t, 6)) for t, e, v in brute if v > 0][:25]
    one_user = rank.score_events(df, likes.where("user_id = 3"), none, interest, F.lit(NOW), 25).collect()
    assert [r["id"] for r in one_user] == [e["id"] for _, e, _ in brute[:25]]
    assert read["common"] == [164] and max(read["head"]) <= 264, "all rows were read before"


def test_matches_of_many_lists_are_read_by_depth_not_by_list(spark, monkeypatch):
    """Users who like all of 60 lists alike meet a few times ``depth`` matches in all, not that many of each list."""
    rng = random.Random(5)
    rows = [ev(i, days=rng.randint(1, 6), age_hours=rng.choice([1, 30, 100, 900]), category=rng.choice(["a", "b"]), tags=["#x", f"#t{i % 60}"] if i % 9 else []) for i in range(3_600)]
    df, counts = spark.createDataFrame(rows, EVENT), {i: rng.randint(0, 12) for i in range(0, 3_600, 3)}
    likes, none = spark.createDataFrame([(u, "#x") for u in range(3)], "user_id long, tag string"), spark.createDataFrame([], "user_id long, tag string, score double")
    reached, keep = [], rank.written

    def seen(frame, name):
        out = keep(frame, name)
        if name == "marks":
            lists = out.where("user_id = 1").groupBy("list").agg(F.max("n").alias("n"))
            reached.append(lists.agg(F.sum(2 * F.col("n") - 1)).first()[0])
        return out

    monkeypatch.setattr(rank, "written", seen)
    best = rank.best_matches(df, likes, none, spark.createDataFrame(list(counts.items()), "event_id long, people_interested long"), F.lit(NOW), 25)
    got = [(r["id"], round(r["total_score"], 6)) for r in sorted(best.where("user_id = 1").collect(), key=lambda r: r["rank"])]
    want = brute_best([r.asDict() for r in df.collect()], {"#x"}, {}, counts, 25)
    assert got == [(e["id"], round(t, 6)) for t, e, v in want if v > 0][:25]
    assert reached and all(n <= 3 * 41 * 4**k for k, n in enumerate(reached))


def test_score_events_of_one_user(spark):
    rng = random.Random(7)
    rows = [ev(i, days=rng.randint(1, 6), age_hours=rng.choice([1, 30, 100, 900]), category="same", tags=rng.sample(["#a", "#b"], rng.randint(0, 1))) for i in range(300)]
    df = spark.createDataFrame(rows, EVENT)
    likes, none = spark.createDataFrame([(1, "#a")], "user_id long, tag string"), spark.createDataFrame([], "user_id long, tag string, score double")
    got = rank.score_events(df, likes, none, spark.createDataFrame([], "event_id long, people_interested long"), F.lit(NOW), 6).collect()
    want = brute_best([r.asDict() for r in df.collect()], {"#a"}, {}, {}, 6)[:6]
    assert [(r["id"], round(r["total_score"], 6)) for r in got] == [(e["id"], round(t, 6)) for t, e, _ in want]


def test_match_scores_are_whole_and_half_even(spark):
    got = [one(spark, F.bround(F.lit(x)).cast("int")) for x in (72.5, 73.5, 71.49, 50.0)]
    assert got == [72, 74, 71, 50]


# itineraries

STOP = "request_id long, stop_no int, kind string, event_id long, title string, start_at timestamp, end_at timestamp, venue_name string, address string, lat double, lon double, location_confidence double, external_url string, travel_buffer_minutes_before int"
EIGHT = datetime(2026, 8, 9, 3)  # 20:00 local time


def stops(spark, *rows):
    base = {"request_id": 1, "stop_no": 1, "kind": "main_event", "event_id": 7, "title": "A concert", "start_at": EIGHT, "end_at": None, "venue_name": "The Hall", "address": "1 Main St", "lat": 37.5, "lon": -122.25, "location_confidence": 0.9, "external_url": "https://x.example/t", "travel_buffer_minutes_before": 30}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], STOP)


def test_links_of_stops(spark):
    far = {"venue_name": None, "address": None, "lat": None, "lon": None}
    got = itinerary.enrich(stops(spark, {}, {"stop_no": 2} | far, {"stop_no": 3, "location_confidence": 0.4}, {"stop_no": 4, "lat": None, "lon": None, "address": None})).orderBy("stop_no").collect()
    assert got[0]["map_url"] == "https://www.google.com/maps/search/?api=1&query=37.5%2C-122.25"
    assert got[0]["directions_url"] == "https://www.google.com/maps/dir/?api=1&destination=37.5%2C-122.25&travelmode=driving", "the first stop routes from the phone"
    assert got[0]["food_url"] == "https://www.google.com/maps/search/restaurants/@37.5,-122.25,16z" and got[0]["parking_url"].startswith("https://www.google.com/maps/search/parking/@")
    assert [got[1][c] for c in ("map_url", "directions_url", "food_url", "drinks_url", "parking_url")] == [None] * 5
    assert got[2]["directions_url"].endswith("destination=The%20Hall%2C%201%20Main%20St&travelmode=driving&origin=37.5%2C-122.25"), "doubtful points yield to words; the origin is the last stop with a place"
    assert got[3]["drinks_url"] == "https://www.google.com/maps/search/?api=1&query=bars%20near%20The%20Hall"


def test_itinerary_text(spark):
    titles = spark.createDataFrame([(1, "Date night", "https://x.example/p/1"), (2, "Night out", None)], "request_id long, title string, share_url string")
    rows = itinerary.enrich(stops(spark, {"stop_no": 2}, {"stop_no": 1, "kind": "pre_event_drink", "title": "A drink", "start_at": EIGHT - timedelta(hours=2), "end_at": EIGHT - timedelta(hours=1), "travel_buffer_minutes_before": 0}))
    body = {r["request_id"]: r["body"] for r in itinerary.render(rows, titles).collect()}
    lines = body[1].split("\n")
    assert lines[:5] == ["Date night", "", "1. 6:00 PM–7:00 PM · Before", "   A drink", "   The Hall — 1 Main St"]
    assert "2. 8:00 PM · Main event" in lines and "   Leave ~30 min ahead" in lines and "Leave ~0" not in body[1]
    assert lines.index("   Tickets: https://x.example/t") < lines.index("2. 8:00 PM · Main event") and lines[-2:] == ["", "Full plan: https://x.example/p/1"]
    order = [x.strip().split(":")[0] for x in lines[lines.index("2. 8:00 PM · Main event") + 4 : -2]]
    assert order == ["Tickets", "Directions", "Parking", "Food nearby", "Drinks nearby"]
    assert body[2] == "Night out\n\nNo stops yet."


@pytest.mark.parametrize("intent, place, at, want", [("date_night", "mission", EIGHT, "Date night in Mission — Sat, Aug 8"), ("bar_crawl", None, None, "Bar crawl"), ("odd", "south bay", None, "Your plan in South Bay")])
def test_itinerary_titles(spark, intent, place, at, want):
    assert one(spark, itinerary.title(F.lit(intent), F.lit(place).cast("string"), F.lit(at).cast("timestamp"))) == want


def test_stop_labels(spark):
    assert one(spark, text.label_of(F.lit("late_night_snack"), itinerary.STOP_LABELS)) == "After" and one(spark, text.label_of(F.lit("coffee_stop"), itinerary.STOP_LABELS)) == "Coffee stop"


def test_snapshots_survive_their_events(spark):
    events = spark.createDataFrame([(7, "A concert", EIGHT, None, "The Hall", "1 Main St", 37.5, -122.25, 0.9, "u")], "id long, title string, start_at timestamp, end_at timestamp, venue_name string, raw_address string, lat double, lon double, location_confidence double, external_url string")
    wanted = spark.createDataFrame([(1, 1, "main_event", 7, -5), (1, 2, "late_night_snack", 99, 30)], "request_id long, stop_no int, kind string, event_id long, travel_buffer_minutes_before int")
    frozen, unknown = itinerary.snapshot(wanted, events)
    assert [r["event_id"] for r in unknown.collect()] == [99]
    kept = spark.createDataFrame(frozen.collect(), frozen.schema)  # the events table is not read again
    (r,) = itinerary.rehydrate(kept).collect()
    assert (r["title"], r["travel_buffer_minutes_before"]) == ("A concert", 0) and r["map_url"].endswith("37.5%2C-122.25")


def test_planned_stops_follow_the_rules(spark, sf_dir):
    """Every planned main event lies in its window and hours, and every support near it, on the right side of it."""
    ev_, req = queries.canon_events(spark, sf_dir), queries._requests(spark, sf_dir)
    parsed = {r["request_id"]: r for r in itinerary.parse_intents(req, queries.as_of()).collect()}
    events = {r["id"]: r for r in ev_.withColumn("hour", timex.local_hour(F.col("start_at"))).collect()}
    by = {}
    for r in queries.QUERIES["itineraries"](spark, sf_dir).collect():
        by.setdefault(r["request_id"], {})[r["kind"]] = events[r["event_id"]]
    assert by
    for request, found in by.items():
        p, main = parsed[request], found["main_event"]
        low, high = itinerary.ANCHOR_HOURS[p["intent"]]
        trusted = [e for e in events.values() if e["source_tier"] <= 2 and p["window_start"] <= e["start_at"] <= p["window_end"] and (p["geography"] is None or any(p["geography"] in (e[c] or "").lower() for c in ("venue_name", "raw_address", "title")))]
        assert main["id"] in {e["id"] for e in trusted}
        assert low <= main["hour"] <= high or not any(low <= e["hour"] <= high for e in trusted)
        for kind, e in found.items():
            if kind != "main_event":
                gap = (e["start_at"] - main["start_at"]).total_seconds() / 60
                assert e["source_tier"] >= 3 and (gap <= -30 if kind == "pre_event_drink" else gap >= 30)


# places, words, requests


def test_points_from_binary_text(spark):
    import struct

    for order, mark in (("<", 1), (">", 0)):
        for lon, lat in ((-122.4194, 37.7749), (0.0, -0.5), (1e-9, 179.25), (-0.1, 2.0**-1030)):
            raw = struct.pack(f"{order}BIIdd", mark, 0x20000001, 4326, lon, lat).hex()
            a, b = geo.read_ewkb(F.lit(raw))
            r = spark.range(1).select(a.alias("lat"), b.alias("lon")).first()
            assert (r["lat"], r["lon"]) == (lat, lon)
    for bad in ("", "zz", "0101000020e6100000", None):
        a, b = geo.read_ewkb(F.lit(bad).cast("string"))
        assert spark.range(1).select(a.alias("lat"), b.alias("lon")).first() == (None, None)


def test_venues_equal_brute_force(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randint(1, 7)))
    names = sorted({word() for _ in range(80)} | {"The Blue Room", "x", ""})
    entries = [(word(), float(i), -float(i), i) for i in range(60)] + [("blue room", 99.0, -99.0, 60), ("THE BLUE ROOM ANNEX", 98.0, -98.0, 61), ("", 1.0, 1.0, 62)]
    got = {r["venue_name"]: r["lat"] for r in geocode.resolve_venues(spark.createDataFrame([(n,) for n in names], "venue_name string"), spark.createDataFrame(entries, "name string, lat double, lon double, ordinal int")).collect()}
    want = {}
    for n in names:
        v = n.strip().lower()
        hits = [(g.strip().lower() != v, o, lat) for g, lat, _, o in entries if v and g.strip() and (g.strip().lower() in v or v in g.strip().lower())]
        if hits:
            want[n] = min(hits)[2]
    assert got == want and len(want) > 20


@pytest.mark.parametrize("blurb, venue, address", [("June 12 @ 8pm — The Room, 12 Main St. $5", "The Room", "12 Main St"), ("8pm-the den, upstairs", "the den", "upstairs"), ("no dash", None, None), ("late – , ", None, None), (None, None, None)])
def test_venue_after_a_dash(spark, blurb, venue, address):
    a, b = text.venue_after_dash(F.lit(blurb).cast("string"))
    assert tuple(spark.range(1).select(a.alias("a"), b.alias("b")).first()) == (venue, address)


PORTER = {
    "consigned": "consign", "consignment": "consign", "consistency": "consist", "knackeries": "knackeri", "knaves": "knave", "knightly": "knight", "generously": "generous", "communication": "communic", "happy": "happi",
    "hopping": "hop", "hoping": "hope", "running": "run", "parties": "parti", "party": "parti", "ties": "tie", "cries": "cri", "gas": "gas", "kiwis": "kiwi", "relational": "relat", "agreed": "agre", "plastered": "plaster",
    "bled": "bled", "sized": "size", "falling": "fall", "filing": "file", "say": "say", "by": "by", "sensibility": "sensibl", "formative": "format", "goodness": "good", "adjustable": "adjust", "replacement": "replac",
    "adoption": "adopt", "rate": "rate", "cease": "ceas", "controlling": "control", "skies": "sky", "dying": "die", "inning": "inning", "enjoy": "enjoy", "exceed": "exceed", "naïve": "naïve",
}


def test_stems():
    assert {w: stem.stem(w) for w in PORTER} == PORTER


def test_full_text_meets_other_forms_of_a_word(spark):
    docs = spark.createDataFrame([(1, "Running parties in the park"), (2, "A run"), (3, None)], "id long, body string")
    asked = spark.createDataFrame([(1, "run"), (2, "the party ran"), (3, "parks run"), (4, "the")], "query_id long, query string")
    got = {(r["query_id"], r["id"]) for r in search.full_text(search.inverted_index(docs, "id", "body"), asked, "id").collect()}
    assert got == {(1, 1), (1, 2), (3, 1)}
    events = spark.createDataFrame([(1, "Running parties", "in the park")], "id long, title string, description string")
    assert events.where(search.matches_all("party run")).count() == 1 and events.where(search.matches_all("party ran")).count() == 0


def test_throttle_equals_a_plain_one(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), NOW + timedelta(seconds=rng.randint(0, 900)), n) for n in range(300)] + [(3, NOW + timedelta(seconds=s), 1_000 + s) for s in (0, 1, 2)] + [(4, NOW + timedelta(seconds=s), 2_000 + s) for s in (0, 30, 61)]
    df = spark.createDataFrame(rows, "key long, at timestamp, n long")

    def plain(limit):
        out, live = {}, {}
        for key, at, n in sorted(rows, key=lambda r: (r[1], r[2])):
            held = live[key] = [t for t in live.get(key, []) if t > at - timedelta(seconds=60)]
            out[n] = key is None or limit == 0 or len(held) < limit
            if out[n]:
                held.append(at)
        return out

    for limit in (0, 1, 2):
        got = {r["n"]: r["admitted"] for r in health.throttle(df, limit, 60.0).collect()}
        assert got == plain(limit)
    one_a_minute = plain(1)
    assert [one_a_minute[2_000 + s] for s in (0, 30, 61)] == [True, False, True]
