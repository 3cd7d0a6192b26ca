import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from eventengine.operators import resolve, tables
from eventengine.plans import queries
from eventengine.schema import CANON

BASE = datetime(2026, 5, 1, 19)


def event(ordinal, title, minutes=0, **more):
    row = {f: None for f in CANON.fieldNames()} | {
        "title": title, "start_at": BASE + timedelta(minutes=minutes), "source_name": "s", "source_tier": 2, "location": "POINT(-122.4 37.7)",
        "categories": [], "tags": [], "status": "scheduled", "attendee_count": 0, "location_confidence": 1.0, "is_free": False,
    }
    return {"ordinal": ordinal} | row | more


def frame(spark, rows):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("ordinal", T.LongType()), *CANON.fields])
    return spark.createDataFrame([tuple(r[f] for f in schema.fieldNames()) for r in rows], schema)


def deduped(spark, *rows):
    return sorted(resolve.dedupe(frame(spark, rows)).collect(), key=lambda r: r["ordinal"])


def test_near_equal_titles_merge(spark):
    (r,) = deduped(spark, event(0, "Jazz in the Park", description="long description", tags=["#a"]), event(1, "Jazz in the Park!", 50, tags=["#b"]))
    assert r["start_at"] == BASE and r["tags"] == ["#a", "#b"] and r["members"] == 2 and r["title"] == "Jazz in the Park!"


@pytest.mark.parametrize("minutes, n", [(120, 1), (181, 2)])
def test_two_hours(spark, minutes, n):
    assert len(deduped(spark, event(0, "Same Show"), event(1, "Same Show", minutes))) == n


def test_lower_tier_owns_the_times(spark):
    late = {"end_at": BASE + timedelta(hours=3)}
    for rows in ([event(0, "Show", source_tier=3), event(1, "Show", 30, source_tier=1, **late)], [event(0, "Show", 30, source_tier=1, **late), event(1, "Show", source_tier=3)]):
        (r,) = deduped(spark, *rows)
        assert r["start_at"] == BASE + timedelta(minutes=30) and r["end_at"] == late["end_at"] and r["source_tier"] == 1


def test_status_escalates(spark):
    (r,) = deduped(spark, event(0, "Show", status="cancelled"), event(1, "Show"))
    assert r["status"] == "cancelled"


def test_venue_needs_tokens_and_url_needs_time(spark):
    venue = {"venue_name": "The Hall (Town) house"}
    assert len(deduped(spark, event(0, "Aye, Bee, Cee", venue_name="the hall"), event(1, "Cee, Aye, Bee", **venue))) == 1
    assert len(deduped(spark, event(0, "Quiet Piano Recital", **venue), event(1, "Drum and Bass", **venue))) == 2
    url = {"external_url": "https://x.example/calendar/"}
    assert len(deduped(spark, event(0, "One", **url), event(1, "Two", 30, external_url="https://x.example/calendar"))) == 1
    assert len(deduped(spark, event(0, "One", **url), event(1, "Two", 24 * 60, **url))) == 2


# The rule of two rows and of merging, written down once more for the tests: plain dynamic programming and plain dictionaries.


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_ratio(a, b):
    return 200 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def plain_token_set(a, b):
    a, b = set(a.split()), set(b.split())
    both, left, right = " ".join(sorted(a & b)), " ".join(sorted(a - b)), " ".join(sorted(b - a))
    if not a or not b:
        return 0.0
    if both and not (left and right):
        return 100.0
    one, two = (both + " " + left).strip(), (both + " " + right).strip()
    return max([plain_ratio(one, two)] + ([plain_ratio(both, one), plain_ratio(both, two)] if both else []))


def plain_score(a, b):
    x, y = a["title"].strip().lower(), b["title"].strip().lower()
    return plain_ratio(x, y) if x and y else 0.0, plain_token_set(a["title"], b["title"])


def plain_duplicate(a, b):
    if abs((a["start_at"] - b["start_at"]).total_seconds()) > 7200:
        return False
    urls = [(r["external_url"] or "").strip().rstrip("/") for r in (a, b)]
    venues = [(r["venue_name"] or "").partition("(")[0].strip().lower() for r in (a, b)]
    ratio, tokens = plain_score(a, b)
    return urls[0] != "" and urls[0] == urls[1] or ratio > 85 or venues[0] != "" and venues[0] == venues[1] and tokens >= 60


def plain_merge(a, b):
    out = dict(a)
    ends = [r["end_at"] for r in (a, b) if r["end_at"]]
    if a["source_tier"] == b["source_tier"]:
        out["start_at"], out["end_at"] = min(a["start_at"], b["start_at"]), max(ends) if ends else None
    else:
        best, rest = sorted((a, b), key=lambda r: r["source_tier"])
        out["start_at"], out["end_at"] = best["start_at"], best["end_at"] or rest["end_at"]
    for f in ("title", "description", "external_url", "venue_name"):
        if (b[f] or "").strip() and len(b[f].strip()) > len((a[f] or "").strip()):
            out[f] = b[f]
    order = ["scheduled", "postponed", "cancelled", "past"]
    out["status"] = max(a["status"], b["status"], key=order.index)
    out["source_tier"] = min(a["source_tier"], b["source_tier"])
    out["tags"] = list(dict.fromkeys([*a["tags"], *b["tags"]]))
    out["price"] = min((p for p in (a["price"], b["price"]) if p is not None), default=None)
    out["attendee_count"] = max(a["attendee_count"], b["attendee_count"])
    out["is_free"] = a["is_free"] or b["is_free"]
    return out


def plain_dedupe(batch):
    out = []
    for r in batch:
        k = next((k for k, e in enumerate(out) if plain_duplicate(e, r)), None)
        if k is None:
            out.append(r | {"members": 1})
        else:
            out[k] = plain_merge(out[k], r) | {"ordinal": out[k]["ordinal"], "members": out[k]["members"] + 1}
    return out


SHOWN = ["ordinal", "title", "description", "start_at", "end_at", "source_tier", "venue_name", "external_url", "status", "tags", "price", "attendee_count", "is_free", "members"]


def shown(r, fields=SHOWN):
    return tuple(tuple(r[f]) if isinstance(r[f], list) else float(r[f]) if f == "price" and r[f] is not None else r[f] for f in fields)


def random_event(rng, ordinal, minutes):
    title = rng.choice(["Jazz Night", "Jazz Nights", "Jaz Night", "Comedy Hour", "Comedy Hours Special", "Open Mic", "jazz night ", "Night Jazz Hour", "Hour Comedy"])
    return event(
        ordinal, title, minutes, venue_name=rng.choice([None, "A", "B (x)", "b"]), external_url=rng.choice([None, "u/1", "u/2/", " u/2"]), source_tier=rng.randint(1, 3), description=rng.choice([None, "short", "a longer one"]),
        status=rng.choice(["scheduled", "scheduled", "cancelled", "postponed"]), tags=rng.sample(["#a", "#b", "#c"], rng.randint(0, 2)), price=rng.choice([None, Decimal(5), Decimal(12)]), attendee_count=rng.randint(0, 9),
        end_at=rng.choice([None, BASE + timedelta(minutes=minutes + 90)]), is_free=rng.random() < 0.2,
    )


def test_random_batches_equal_a_plain_fold(spark):
    rng = random.Random(5)
    rows, batches = [], []
    for b in range(40):
        batch = [random_event(rng, b * 100 + k, b * 60 * 48 + rng.randint(0, 400)) for k in range(rng.randint(2, 12))]
        rows += batch
        batches.append(batch)
    got = sorted(shown(r) for r in resolve.dedupe(frame(spark, rows)).collect())
    assert got == sorted(shown(r) for batch in batches for r in plain_dedupe(batch))


def test_stored_matches_equal_brute_force(spark):
    rng = random.Random(8)
    stored = [random_event(rng, k, rng.randint(0, 3_000)) for k in range(150)]
    incoming = [random_event(rng, k, rng.randint(0, 3_000)) for k in range(150)]
    want = {}
    for r in incoming:
        hits = [(-max(plain_score(r, s)), s["ordinal"]) for s in stored if plain_duplicate(r, s)]
        if hits:
            want[r["ordinal"]] = min(hits)[1]
    got = {r["ordinal"]: r["id"] for r in resolve.match_stored(frame(spark, incoming), frame(spark, stored).withColumnRenamed("ordinal", "id")).collect()}
    assert got == want and len(want) > 50


def test_a_crowded_venue_compares_distinct_titles(spark, monkeypatch):
    """Where all rows share a venue and few titles recur, ratios are worked out for pairs of titles, not of rows."""
    names = ["Jazz Night", "Night of Jazz", "Open Mic", "Comedy Hour", "Hour of Comedy and Jazz"]
    stored = [event(k, names[k % 5], 30 * k, venue_name="The Hall") for k in range(400)]
    incoming = [event(k, names[k % 4], 30 * k + 7, venue_name="the hall (big room)") for k in range(400)]
    kept, keep = {}, resolve.written

    def seen(frame, name):
        kept[name] = keep(frame, name)
        return kept[name]

    monkeypatch.setattr(resolve, "written", seen)
    got = {r["ordinal"]: r["id"] for r in resolve.match_stored(frame(spark, incoming), frame(spark, stored).withColumnRenamed("ordinal", "id")).collect()}
    want = {}
    for r in incoming:
        hits = [(-max(plain_score(r, s)), s["ordinal"]) for s in stored if plain_duplicate(r, s)]
        if hits:
            want[r["ordinal"]] = min(hits)[1]
    assert got == want and kept["spoken"].count() <= 20


def test_similar_titles_equal_brute_force(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcde f") for _ in range(rng.randint(1, 24))).strip() for _ in range(60)]
    edited = ["".join(c for c in t if rng.random() > 0.08) + rng.choice(["", "", "x", " b"]) for t in base for _ in range(3)]
    rows = [(rng.randint(0, 1), t) for t in [*base, *edited, "", " ", "a", "ab", "abc", "abcd"]]
    got = {(r["k"], r["a"], r["b"]) for r in resolve.similar_titles(spark.createDataFrame(rows, "k int, title string"), ["k"]).collect()}
    by = {k: sorted({t.strip().lower() for g, t in rows if g == k} - {""}) for k in (0, 1)}
    want = {(k, a, b) for k, ts in by.items() for a in ts for b in ts if a < b and plain_ratio(a, b) > 85}
    assert got == want and len(want) > 60


def test_queries_over_the_tables_equal_brute_force(spark, sf_dir):
    """deduplicated_events by the plain fold over nights, which no cluster crosses."""
    good, _ = queries.quality.normalize(queries._payloads(spark, sf_dir))
    rows = sorted((r.asDict() for r in good.select("ordinal", *CANON.fieldNames()).collect()), key=lambda r: r["ordinal"])
    nights = {}
    for r in rows:
        nights.setdefault((r["start_at"] - timedelta(hours=12)).date(), []).append(r)
    want = sorted((e["ordinal"], e["title"], e["start_at"], e["source_tier"], e["members"]) for night in nights.values() for e in plain_dedupe(night))
    got = sorted(tuple(r) for r in queries.QUERIES["deduplicated_events"](spark, sf_dir).collect())
    assert got == want and len(got) < len(rows)
    # upserts: deduplicated rows a quarter of an hour later, each against the best of the even ones
    later = [e | {"start_at": e["start_at"] + timedelta(minutes=15)} for night in nights.values() for e in plain_dedupe([r | {"end_at": None} for r in night])]
    stored = [r for r in rows if r["ordinal"] % 2 == 0]
    best = {}
    for e in later:
        hits = [(-max(plain_score(e, s)), s["ordinal"]) for s in stored if plain_duplicate(e, s)]
        best[e["ordinal"]] = min(hits)[1] if hits else None
    actions = queries.QUERIES["upsert_actions"](spark, sf_dir).collect()
    assert {r["ordinal"]: r["id"] for r in actions if r["action"] != "insert"} == {k: v for k, v in best.items() if v is not None}
    fresh = sorted(r["ordinal"] for r in actions if r["action"] == "insert")
    assert fresh == sorted(k for k, v in best.items() if v is None)
    top = max(r["ordinal"] for r in stored)
    assert [r["id"] for r in sorted(actions, key=lambda r: r["ordinal"]) if r["action"] == "insert"] == list(range(top + 1, top + 1 + len(fresh)))


def test_load_batch_writes_the_next_version(spark, tmp_path):
    base = f"{tmp_path}/events"
    tables.write_version(frame(spark, [event(5, "Known Show", description="d"), event(9, "Other")]).withColumnRenamed("ordinal", "id"), base, 1)
    rows = [event(0, "Known Show", 10, description="d"), event(1, "Other", venue_name="new venue"), event(2, "Fresh", 600), event(3, "Fresh", 610)]
    (told,) = tables.load_batch(frame(spark, rows), base, 1).collect()
    assert told.asDict() == {"inserted": 1, "updated": 1, "skipped": 1, "deduped": 1}
    assert {r["id"]: r["venue_name"] for r in tables.read_version(spark, base, 2).collect()} == {5: None, 9: "new venue", 10: None}


def test_upsert(spark):
    stored = frame(spark, [event(5, "Known Show", description="d"), event(9, "Other")]).withColumnRenamed("ordinal", "id")
    incoming = frame(spark, [event(0, "Known Show", 10, description="d"), event(1, "Other", venue_name="new venue"), event(2, "Fresh", 600)])
    table, actions = resolve.upsert(incoming, stored)
    assert {(r["ordinal"], r["action"], r["id"]) for r in actions.collect()} == {(0, "skip", 5), (1, "update", 9), (2, "insert", 10)}
    got = {r["id"]: r["venue_name"] for r in table.collect()}
    assert got == {5: None, 9: "new venue", 10: None}


def test_empty_batch(spark):
    assert resolve.dedupe(frame(spark, [])).count() == 0


@pytest.mark.parametrize("year", [1600, 2263, 4500])
def test_instants_beyond_those_of_pandas(spark, year):
    at = {"start_at": datetime(year, 5, 1, 19), "end_at": datetime(year, 5, 1, 23)}
    late = {"start_at": datetime(year, 5, 1, 20), "end_at": None}
    (r,) = deduped(spark, event(0, "Far Show", **at), event(1, "Far Show", **late))
    assert (r["start_at"], r["end_at"], r["members"]) == (at["start_at"], at["end_at"], 2)
    stored = frame(spark, [event(5, "Far Show", **at), event(6, "Other")]).withColumnRenamed("ordinal", "id")
    table, actions = resolve.upsert(frame(spark, [event(0, "Far Show", description="d", **late)]), stored)
    assert [(r["id"], r["action"]) for r in actions.collect()] == [(5, "update")]
    assert {r["id"]: (r["start_at"], r["end_at"], r["description"]) for r in table.collect()} == {5: (at["start_at"], at["end_at"], "d"), 6: (BASE, None, None)}


def test_mark_past(spark):
    df = frame(spark, [event(0, "a"), event(1, "b", end_at=BASE + timedelta(days=3)), event(2, "c", status="cancelled")])
    got = resolve.mark_past(df, F.lit(BASE + timedelta(hours=25)))
    assert [r["status"] for r in got.orderBy("ordinal").collect()] == ["past", "scheduled", "cancelled"]


def test_a_long_component_meets_only_rows_close_in_time(monkeypatch):
    rows = [event(k, f"night {k:04d}", 60 * k, venue_name="hall", end_at=None) for k in range(2_000)]
    random.Random(5).shuffle(rows)
    met, rule = [0], resolve.is_duplicate

    def counted(a, b):
        met[0] += 1
        return rule(a, b)

    monkeypatch.setattr(resolve, "is_duplicate", counted)
    held = resolve.Representatives()
    for row in rows:
        held.add(row)
    assert met[0] <= 6 * len(rows)
    monkeypatch.undo()
    mixed = [random_event(rng, k, rng.randint(0, 3_000)) for rng in [random.Random(6)] for k in range(400)]
    held = resolve.Representatives()
    for row in mixed:
        held.add(row)
    assert [shown(r) for r in held.rows] == [shown(r) for r in plain_dedupe(mixed)]


def test_a_representative_that_moves_is_found_at_its_new_start():
    held = resolve.Representatives()
    # the first tier's start replaces the representative's, two hours on; a third row is close to the new start only
    for row in (event(0, "Same Show", 0, source_tier=3), event(1, "Same Show", 120, source_tier=1), event(2, "Same Show", 240)):
        held.add(row)
    (r,) = held.rows
    assert r["members"] == 3 and r["ordinal"] == 0 and r["start_at"] == BASE + timedelta(minutes=120)


def test_sides_that_grow_are_not_broadcast(spark, monkeypatch):
    """Numbered rows are few bytes in a file, so that Spark would build a broadcast of a million of them on the driver."""
    plans, keep = {}, resolve.written

    def seen(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(resolve, "written", seen)
    rows = frame(spark, [event(k, f"Show {k % 3}", 40 * k) for k in range(12)])
    resolve.changes(rows, rows.withColumnRenamed("ordinal", "id"))
    assert {"sessions", "edges", "label", "incoming", "matches"} <= plans.keys()
    assert not [name for name in ("sessions", "label", "incoming") for plan in plans[name] if "BroadcastHashJoin" in plan]
