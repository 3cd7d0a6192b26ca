"""Search over stored events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text, timex
from . import layout
from .textindex import TextIndex

# Fixed values.
LOCATION_PRESETS = {"sf": "san francisco", "oakland": "oakland", "san_jose": "san jose"}


def keyword(word: str) -> Column:
    """Venue, address or title holds the word, whatever the case."""
    return F.coalesce(F.col("venue_name").ilike(f"%{word}%"), F.lit(False)) | F.coalesce(F.col("raw_address").ilike(f"%{word}%"), F.lit(False)) | F.col("title").ilike(f"%{word}%")


def has_tag(tag: str) -> Column:
    return F.array_contains("tags", tag)


def in_category(part: str) -> Column:
    return F.exists("categories", lambda c: F.lower(c).contains(part.lower()))


def matches_all(query: str) -> Column:
    """Title and description hold every word of the query."""
    doc = text.stems(F.concat_ws(" ", "title", "description"))
    asked = text.stems(F.lit(query))
    return (F.size(asked) > 0) & (F.size(F.array_except(asked, doc)) == 0)


def inverted_index(docs: DataFrame, key: str, body: str) -> DataFrame:
    """term, key: for many queries over many texts."""
    return docs.select(key, F.explode(text.stems(F.col(body))).alias("term"))


def full_text(index: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """queries(query_id, query) -> query_id, key of the texts that hold all of a query's terms."""
    terms = queries.select("query_id", F.explode(text.stems(F.col("query"))).alias("term"))
    need = terms.groupBy("query_id").agg(F.count("*").alias("need"))
    hits = index.join(terms, "term").groupBy("query_id", key).agg(F.count("*").alias("got"))
    return hits.join(need, "query_id").where("got = need").select("query_id", key)


def people_interested(signals: DataFrame) -> DataFrame:
    """event_id -> distinct users that saved, clicked or went for tickets."""
    return signals.where(F.col("event_id").isNotNull() & F.col("signal_type").isin("save", "click", "external_ticket_click")).groupBy("event_id").agg(F.countDistinct("user_id").alias("people_interested"))


def place_of(row, sort_by: str = "date") -> tuple:
    """Where the page after a row (of a page of :func:`search` in the same order) begins."""
    return (row["metres"] if sort_by == "distance" else row["start_at"], row["id"])


def search(
    events: DataFrame,
    as_of: datetime,
    signals: DataFrame | None = None,
    q: str | None = None,
    lat: float | None = None,
    lng: float | None = None,
    radius_miles: float | None = None,
    min_location_confidence: float = 0.5,
    vibe_tag: str | None = None,
    time_preset: str | None = None,
    location_preset: str | None = None,
    start_at: datetime | None = None,
    end_at: datetime | None = None,
    include_past: bool = False,
    sort_by: str = "date",
    status: str | None = None,
    limit: int = 25,
    offset: int = 0,
    index: TextIndex | None = None,
    after: tuple | None = None,
) -> DataFrame:
    """A page of events with distance_miles (with a point) and people_interested (with signals); ties go to the lower id.

    With ``index``, a stored one of these events, texts are met by its postings instead of being stemmed for the query.
    ``after``, in place of an offset, is what :func:`place_of` says of the last row of the page before: then a page costs
    the same wherever it stands.
    """
    given = [x is not None for x in (lat, lng, radius_miles)]
    if any(given) and not all(given):
        raise ValueError("lat, lng and radius_miles go together")
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit is 1 to 200, offset not negative")
    now = F.lit(as_of).cast("timestamp")
    out = events if include_past else events.where(F.col("start_at") >= now)
    if q:
        out = out.where(matches_all(q)) if index is None else out.join(index.lookup(q), "id", "left_semi")
    if status is not None:
        out = out.where(F.col("status") == status)
    preset = timex.preset_window(time_preset, now) if time_preset else (None, None)
    low = F.lit(start_at).cast("timestamp") if start_at else preset[0]
    high = F.lit(end_at).cast("timestamp") if end_at else preset[1]
    if low is not None:
        out = out.where(F.col("start_at") >= low)
    if high is not None:
        out = out.where(F.col("start_at") <= high)
    if vibe_tag:
        out = out.where(has_tag(vibe_tag))
    if location_preset:
        out = out.where(keyword(LOCATION_PRESETS[location_preset]))
    order = [F.asc("start_at"), F.asc("id")]
    if all(given):
        metres = geo.distance_m(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lng))
        reach = radius_miles * geo.MILE_M
        # of a table laid out by place, the scan reads the ranges around the point only
        out = layout.near(out, lat, lng, reach) if "place" in out.columns else out
        out = out.where(geo.in_box(F.col("lat"), F.col("lon"), lat, lng, reach)).withColumn("__m", metres)
        out = out.where((F.col("__m") <= reach) & (F.col("location_confidence") >= min_location_confidence))
        if sort_by == "distance":
            order = [F.asc("__m"), F.asc("id")]
    if after is not None:
        if offset:
            raise ValueError("a page is given by an offset or by what it comes after")
        at = F.col("__m") if all(given) and sort_by == "distance" else F.col("start_at")
        place, number = F.lit(after[0]).cast("double" if all(given) and sort_by == "distance" else "timestamp"), F.lit(after[1])
        # the first comparison alone reaches the scan
        out = out.where((at >= place) & ((at > place) | (F.col("id") > number)))
    page = out.orderBy(*order).offset(offset).limit(limit)
    if all(given) and sort_by == "distance":
        page = page.withColumn("metres", F.col("__m"))
    if all(given):
        page = page.withColumn("distance_miles", geo.miles(F.col("__m"))).drop("__m")
    if signals is not None:
        # only the page's events are counted
        few = signals.join(page.select(F.col("id").alias("event_id")), "event_id", "left_semi")
        page = page.join(people_interested(few).withColumnRenamed("event_id", "id"), "id", "left").withColumn("people_interested", F.coalesce("people_interested", F.lit(0)))
    return page
