"""From candidates of a source to flat canonical payloads: one set of parameters for each source, the same columns for all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, money, text, timex
from ..operators import geocode


@dataclass(frozen=True)
class SourceRules:
    """How a source writes its rows. ``dates``: 'listing', 'flexible', 'range', 'iso', 'page', 'url' (the day of
    the link's path) or 'issue' (of a newsletter, against its date)."""

    name: str
    tier: int
    dates: str = "flexible"
    tz: str = timex.TZ
    named_confidence: float = geocode.NAMED
    popularity_full: float = 100.0
    snippet: int | None = None
    explicit_date: bool = False


def times(rules: SourceRules, when: Column, as_of: Column, url: Column | None = None) -> tuple[Column, Column]:
    """Start and end by the rule of the source; ``as_of`` is the time of the crawl, or of the issue of a newsletter."""
    today = F.from_utc_timestamp(as_of, rules.tz).cast("date")
    none = F.lit(None).cast("timestamp")
    if rules.dates == "listing":
        return timex.listing_range(when, as_of, rules.tz)
    if rules.dates == "range":
        return timex.date_range(when, today, rules.tz)
    if rules.dates == "iso":
        return timex.iso_instant(when, rules.tz), none
    if rules.dates == "page":
        return timex.page_times(when, when, as_of, rules.tz)
    if rules.dates == "url":
        # the path's date, with the time of the text; without one, a date in the text
        day, clock = timex.date_in_url(url), F.regexp_extract(when, rf"(?i){timex.CLOCK}", 0)
        start = F.when(day.isNotNull(), timex.flexible_datetime(F.concat_ws(" ", day.cast("string"), clock), day, rules.tz)).when(timex.explicit_date(when), timex.flexible_datetime(when, today, rules.tz))
        return start, timex.end_of_range(when, start, rules.tz)
    start = timex.flexible_datetime(when, today, rules.tz)
    if rules.dates == "issue":
        # a date long before its issue means the next year
        local = F.from_utc_timestamp(start, rules.tz)
        start = F.to_utc_timestamp(F.timestamp_add("DAY", F.datediff(timex.roll_year(local.cast("date"), today), local), local), rules.tz)
    return start, timex.end_of_range(when, start, rules.tz)


def canonical(candidates: DataFrame, rules: SourceRules, as_of: Column, venues: DataFrame, cities: DataFrame) -> DataFrame:
    """candidates(doc_id, pos, url, title, when_text, venue_name and, where there are any, description, price_text, city,
    raw_address, votes, organizer, image_url, tags, lat, lon, issued_at) -> payloads for ``operators.quality.normalize``.

    A row without a date of its own is dropped, never given one; a TBA venue is private and gets no coordinates of its own.
    """
    optional = {"description": "string", "price_text": "string", "city": "string", "raw_address": "string", "votes": "int", "organizer": "string", "image_url": "string", "tags": "array<string>", "lat": "double", "lon": "double", "issued_at": "timestamp"}
    rows = candidates.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in candidates.columns})
    if rules.explicit_date:
        rows = rows.where(timex.explicit_date(F.col("when_text")))
    private = F.coalesce(F.upper(F.trim("venue_name")) == "TBA", F.lit(False))
    start, end = times(rules, F.col("when_text"), F.coalesce("issued_at", as_of), F.col("url"))
    rows = rows.withColumns({"private_location": private, "start_at": start, "end_at": end, "venue_name": F.when(~private, text.blank_to_null(F.col("venue_name"))), "city": F.coalesce("city", text.city_in_parentheses(F.col("venue_name")))})
    placed = geocode.geocode(rows.where("start_at is not null"), venues, cities, named=rules.named_confidence)
    price, free = money.parse_price(F.col("price_text"))
    description = text.blank_to_null(F.col("description"))
    return placed.select(
        text.blank_to_null(F.col("title")).alias("title"), (text.snippet(description, rules.snippet) if rules.snippet else description).alias("description"), "start_at", "end_at",
        F.lit(rules.name).alias("source_name"), F.lit(rules.tier).alias("source_tier"), text.last_segment(F.col("url")).alias("source_event_id"), F.col("url").alias("external_url"), "venue_name", "raw_address",
        geo.point_wkt(F.col("lat"), F.col("lon")).alias("location"), F.array().cast("array<string>").alias("categories"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), price.alias("price"),
        F.when(price.isNotNull(), "USD").alias("currency"), "image_url", F.lit("scheduled").alias("status"), F.col("organizer").alias("organizer_name"), F.coalesce("votes", F.lit(0)).alias("attendee_count"),
        "location_confidence", free.alias("is_free"), "private_location", money.popularity_share(F.coalesce("votes", F.lit(0)), rules.popularity_full).alias("popularity"),
    )


def detail_pages(pages: DataFrame, as_of: Column, tz: str = timex.TZ) -> DataFrame:
    """pages(doc_id, url, title, detail_text, date_text, cost_text) -> doc_id, title, url, address, cost and times; those
    without a date go."""
    start, end = timex.page_times(F.col("detail_text"), F.col("date_text"), as_of, tz)
    cost = money.cost_fields(F.col("cost_text"), F.col("detail_text"))
    out = pages.select("doc_id", text.blank_to_null(F.col("title")).alias("title"), "url", text.street_address(F.col("detail_text")).alias("raw_address"), start.alias("start_at"), end.alias("end_at"), cost.alias("c"))
    return out.where("title is not null and start_at is not null").select("doc_id", "title", "url", "raw_address", "start_at", "end_at", "c.*")
