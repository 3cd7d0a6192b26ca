"""Itineraries: prompts to intents, anchors, supports around them, stops with links and text; many requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text, timex
from .profile import with_intent
from .rank import components, penalised, tag_scores
from .scratch import written

# Fixed values.
ANCHOR_HOURS = {"date_night": (17, 23), "bar_crawl": (17, 23), "general_night_out": (17, 23), "out_of_town_guests": (9, 23)}
STOP_LABELS = {"pre_event_drink": "Before", "main_event": "Main event", "late_night_snack": "After"}
INTENT_LABELS = {"date_night": "Date night", "out_of_town_guests": "Showing guests around", "bar_crawl": "Bar crawl", "general_night_out": "Night out"}
TRUSTED = 0.7
MAPS, NEARBY_ZOOM = "https://www.google.com/maps", 16
NEARBY = {"food_url": "restaurants", "drinks_url": "bars", "parking_url": "parking"}


def parse_intents(prompts: DataFrame, as_of: Column, tz: str = timex.TZ) -> DataFrame:
    """prompts(request_id, prompt, …) with intent, geography, label, window_start, window_end."""
    p = F.col("prompt")
    label = text.timeframe_label(p)
    start, end = timex.window_of(label, as_of, tz)
    return prompts.withColumns({"intent": text.intent(p), "geography": text.geography(p), "label": label, "window_start": start, "window_end": end})


def _place() -> Column:
    """Venue, address or title holds the geography; none asks for nothing."""
    return F.col("geography").isNull() | F.coalesce(F.expr("venue_name ILIKE concat('%', geography, '%') OR raw_address ILIKE concat('%', geography, '%') OR title ILIKE concat('%', geography, '%')"), F.lit(False))


def _days(start: Column, end: Column) -> Column:
    return F.sequence(start.cast("date"), end.cast("date"))


def in_windows(requests: DataFrame, events: DataFrame) -> DataFrame:
    """Pairs with the event's start in the request's window: an equi-join on the UTC day, then the bounds."""
    by_day = requests.withColumn("__day", F.explode(_days(F.col("window_start"), F.col("window_end"))))
    return by_day.join(events.withColumn("__day", F.col("start_at").cast("date")), "__day").where(F.col("start_at").between(F.col("window_start"), F.col("window_end"))).drop("__day")


def anchors(requests: DataFrame, events: DataFrame, profiles: DataFrame, preferred: DataFrame, counts: DataFrame, as_of: Column, limit: int = 25, tz: str = timex.TZ) -> DataFrame:
    """request_id -> the anchor: of the earliest ``limit`` trusted events in the window (in the intent's hours, or at any
    hour where none is), the best by score."""
    limit = min(max(limit, 3), 100)
    near = in_windows(requests, events.where("source_tier <= 2")).where(_place())
    low, high = (F.create_map(*[F.lit(x) for k, v in ANCHOR_HOURS.items() for x in (k, v[i])]) for i in (0, 1))
    fits = timex.local_hour(F.col("start_at"), tz).between(F.element_at(low, F.col("intent")), F.element_at(high, F.col("intent")))
    near = near.withColumn("__fits", F.coalesce(fits, F.lit(True)).cast("int"))
    whole = Window.partitionBy("request_id")
    near = near.withColumn("__any", F.max("__fits").over(whole)).where("__fits = __any")
    early = Window.partitionBy("request_id").orderBy("start_at", "id")
    few = near.withColumn("__n", F.row_number().over(early)).where(F.col("__n") <= limit).drop("__n", "__fits", "__any")
    felt = with_intent(requests, profiles)
    vibe = tag_scores(few.select("id", "tags").dropDuplicates(["id"]), preferred, felt, "request_id")
    pairs = few.join(vibe, ["request_id", "id"], "left").withColumn("vibe_score", F.coalesce("vibe_score", F.lit(0.0)))
    scored = penalised(components(pairs, counts, as_of), ["request_id"])
    best = Window.partitionBy("request_id").orderBy(F.desc("total_score"), "start_at", "id")
    return scored.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")


def supports(chosen: DataFrame, events: DataFrame, limit: int | None = 25, radius: float = 0.5, wider: float = 1.0) -> DataFrame:
    """request_id and the supporting events near its anchor: a join on the grid cell and the UTC day, so that a crowded place
    is met a day at a time, exact distance, the wider circle only for requests without any in the smaller one; the earliest
    ``limit``, or all without a limit."""
    a = chosen.select("request_id", "window_start", "window_end", F.col("id").alias("anchor_id"), F.col("start_at").alias("anchor_start"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    a = a.where("a_lat is not null and a_lon is not null").withColumn("__cell", F.explode(geo.cells_within(F.col("a_lat"), F.col("a_lon"), wider * geo.MILE_M)))
    a = a.withColumn("__day", F.explode(_days(F.col("window_start"), F.col("window_end"))))
    s = events.where("source_tier >= 3 and lat is not null and lon is not null").withColumns({"__cell": geo.cell(F.col("lat"), F.col("lon")), "__day": F.col("start_at").cast("date")})
    near = a.join(s, ["__cell", "__day"]).where((F.col("id") != F.col("anchor_id")) & F.col("start_at").between(F.col("window_start"), F.col("window_end")))
    near = near.withColumn("__m", geo.distance_m(F.col("lat"), F.col("lon"), F.col("a_lat"), F.col("a_lon"))).where(F.col("__m") <= wider * geo.MILE_M)
    least = F.min("__m").over(Window.partitionBy("request_id"))
    near = near.withColumn("__least", least).where((F.col("__m") <= radius * geo.MILE_M) | (F.col("__least") > radius * geo.MILE_M))
    near = near.drop("__cell", "__day", "__least", "__m")
    early = Window.partitionBy("request_id").orderBy("start_at", "id")
    return near if limit is None else near.withColumn("__n", F.row_number().over(early)).where(F.col("__n") <= limit).drop("__n")


def sequence(chosen: DataFrame, near: DataFrame) -> DataFrame:
    """request_id, stop_no, kind, event_id, title, start_at, travel_buffer_minutes_before: the latest support half an hour
    or more before the anchor, the anchor, the earliest one half an hour or more after it."""
    half = F.expr("INTERVAL 30 MINUTES")
    event = F.struct(F.col("id").alias("event_id"), "title", "start_at", "end_at", "venue_name", F.col("raw_address").alias("address"), "lat", "lon", "location_confidence", "external_url")
    before, after = F.col("start_at") <= F.col("anchor_start") - half, F.col("start_at") >= F.col("anchor_start") + half
    ends = near.groupBy("request_id").agg(
        F.max_by(event, F.when(before, F.struct("start_at", "id"))).alias("pre"), F.min_by(event, F.when(after, F.struct("start_at", "id"))).alias("post")
    )
    stop = lambda kind, e, buffer, order: F.struct(F.lit(order).alias("o"), F.lit(kind).alias("kind"), e.alias("e"), F.lit(buffer).alias("buffer"))
    whole = chosen.select("request_id", event.alias("main")).join(ends, "request_id", "left")
    stops = F.filter(F.array(stop("pre_event_drink", F.col("pre"), 0, 0), stop("main_event", F.col("main"), 30, 1), stop("late_night_snack", F.col("post"), 30, 2)), lambda s: s["e"].isNotNull())
    rows = whole.select("request_id", F.posexplode(stops).alias("p", "s"))
    return rows.select("request_id", (F.col("p") + 1).alias("stop_no"), "s.kind", "s.e.*", F.col("s.buffer").alias("travel_buffer_minutes_before"))


def _point() -> Column:
    return F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string")))


def waypoint() -> Column:
    """Trusted coordinates, else venue and address, else whatever coordinates there are."""
    label = F.nullif(F.concat_ws(", ", F.nullif(F.col("venue_name"), F.lit("")), F.nullif(F.col("address"), F.lit(""))), F.lit(""))
    return F.when(F.coalesce(F.col("location_confidence"), F.lit(0.0)) >= TRUSTED, F.coalesce(_point(), label)).otherwise(F.coalesce(label, _point()))


def nearby_url(term: str) -> Column:
    """A search for a term around the stop: by coordinates, else near its address or venue in words."""
    anchor = F.coalesce(F.nullif(F.col("address"), F.lit("")), F.nullif(F.col("venue_name"), F.lit("")))
    around = F.concat(F.lit(f"{MAPS}/search/{term}/@"), _point(), F.lit(f",{NEARBY_ZOOM}z"))
    return F.coalesce(around, F.concat(F.lit(f"{MAPS}/search/?api=1&query="), text.quote_query(F.concat(F.lit(f"{term} near "), anchor))))


def enrich(stops: DataFrame) -> DataFrame:
    """stops with map, directions and nearby links; a route starts at the last earlier stop that can be located, or where
    the phone is. A stop without a location has none."""
    order = Window.partitionBy("request_id").orderBy("stop_no").rowsBetween(Window.unboundedPreceding, -1)
    named = stops.withColumn("waypoint", waypoint()).withColumn("origin", F.last(F.col("waypoint"), ignorenulls=True).over(order))
    maps = F.concat(F.lit(f"{MAPS}/search/?api=1&query="), text.quote_query(F.col("waypoint")))
    origin = F.coalesce(F.concat(F.lit("&origin="), text.quote_query(F.col("origin"))), F.lit(""))
    route = F.concat(F.lit(f"{MAPS}/dir/?api=1&destination="), text.quote_query(F.col("waypoint")), F.lit("&travelmode=driving"), origin)
    return named.withColumns({"map_url": maps, "directions_url": route} | {c: nearby_url(term) for c, term in NEARBY.items()})


def render(stops: DataFrame, titles: DataFrame, tz: str = timex.TZ) -> DataFrame:
    """Enriched stops and titles(request_id, title and, where there is one, share_url) -> request_id, body: the plan as
    plain text, stops in order."""
    title_row = titles if "share_url" in titles.columns else titles.withColumn("share_url", F.lit(None).cast("string"))
    until = F.coalesce(F.concat(F.lit("–"), timex.local_clock(F.col("end_at"), tz)), F.lit(""))
    head = F.concat(F.col("stop_no").cast("string"), F.lit(". "), timex.local_clock(F.col("start_at"), tz), until, F.lit(" · "), text.label_of(F.col("kind"), STOP_LABELS))
    ahead = F.when(F.col("travel_buffer_minutes_before") > 0, F.concat(F.lit("Leave ~"), F.col("travel_buffer_minutes_before").cast("string"), F.lit(" min ahead")))
    links = [("Tickets", "external_url"), ("Directions", "directions_url"), ("Parking", "parking_url"), ("Food nearby", "food_url"), ("Drinks nearby", "drinks_url")]
    more = [F.col("title"), text.location_label(F.col("venue_name"), F.col("address")), ahead, *[F.concat(F.lit(f"{name}: "), F.nullif(F.col(c), F.lit(""))) for name, c in links]]
    block = F.concat(F.lit("\n"), head, F.lit("\n"), F.array_join(F.transform(F.array_compact(F.array(*more)), lambda x: F.concat(F.lit("   "), x)), "\n"))
    blocks = stops.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("stop_no", block.alias("block")))).alias("x"))
    rows = title_row.join(blocks, "request_id", "left")
    body = F.when(F.col("x").isNull(), F.concat("title", F.lit("\n\nNo stops yet."))).otherwise(F.concat("title", F.lit("\n"), F.array_join(F.transform("x", lambda r: r["block"]), "\n"), F.coalesce(F.concat(F.lit("\n\nFull plan: "), "share_url"), F.lit(""))))
    return rows.select("request_id", body.alias("body"))


def title(intent: Column, geography: Column, starts_at: Column, tz: str = timex.TZ) -> Column:
    """'Date night in Mission — Sat, Aug 8'; place and day where there are any."""
    labels = F.create_map(*[F.lit(x) for kv in INTENT_LABELS.items() for x in kv])
    place, day = F.concat(F.lit(" in "), F.initcap(F.nullif(geography, F.lit("")))), F.concat(F.lit(" — "), timex.local_day(starts_at, tz))
    return F.concat(F.coalesce(F.element_at(labels, intent), F.lit("Your plan")), F.coalesce(place, F.lit("")), F.coalesce(day, F.lit("")))


def titles(requests: DataFrame, stops: DataFrame, tz: str = timex.TZ) -> DataFrame:
    """Parsed requests and their stops -> request_id, title; the day is that of the first stop."""
    first = stops.groupBy("request_id").agg(F.min_by("start_at", "stop_no").alias("starts_at"))
    return requests.select("request_id", "intent", "geography").join(first, "request_id", "left").select("request_id", title(F.col("intent"), F.col("geography"), F.col("starts_at"), tz).alias("title"))


def plan(requests: DataFrame, events: DataFrame, profiles: DataFrame, preferred: DataFrame, counts: DataFrame, as_of: Column, limit: int = 25, tz: str = timex.TZ) -> DataFrame:
    """requests(request_id, user_id, prompt) -> stops."""
    # written, so that the windows are worked out once and not wherever they are compared
    parsed = written(parse_intents(requests, as_of, tz), "intents")
    chosen = written(anchors(parsed, events, profiles, preferred, counts, as_of, limit, tz), "anchors")
    return sequence(chosen, supports(chosen, events, limit))


FROZEN = ["title", "start_at", "end_at", "venue_name", "address", "lat", "lon", "location_confidence", "external_url"]


def snapshot(wanted: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """wanted(request_id, stop_no, kind, event_id, travel_buffer_minutes_before) -> (request_id, stops as one nested column;
    rows of unknown events)."""
    known = wanted.join(events.withColumnRenamed("raw_address", "address").select(F.col("id").alias("event_id"), *FROZEN), "event_id")
    stop = F.struct("stop_no", "kind", "event_id", F.greatest(F.coalesce("travel_buffer_minutes_before", F.lit(0)), F.lit(0)).alias("travel_buffer_minutes_before"), *FROZEN)
    frozen = known.groupBy("request_id").agg(F.array_sort(F.collect_list(stop)).alias("stops"))
    return frozen, wanted.join(events.select(F.col("id").alias("event_id")), "event_id", "left_anti")


def rehydrate(snapshots: DataFrame) -> DataFrame:
    """Links worked out anew from what was frozen, whatever has become of the events."""
    return enrich(snapshots.select("request_id", F.explode("stops").alias("s")).select("request_id", "s.*"))
