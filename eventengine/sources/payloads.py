"""Canonical fields from nested payloads and free text posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, text, timex

LISTING = (
    "struct<id:string,name:string,url:string,info:string,dates:struct<start:struct<dateTime:string,localDate:string,localTime:string>,timezone:string,status:struct<code:string>>,"
    "priceRanges:array<struct<min:double,max:double,currency:string>>,images:array<struct<url:string,width:int,height:int>>,"
    "classifications:array<struct<segment:struct<name:string>,genre:struct<name:string>,subGenre:struct<name:string>,type:struct<name:string>,subType:struct<name:string>>>,"
    "_embedded:struct<venues:array<struct<name:string,address:struct<line1:string>,city:struct<name:string>,state:struct<stateCode:string>,postalCode:string,location:struct<latitude:string,longitude:string>>>,"
    "attractions:array<struct<name:string>>>>"
)


def class_names(c: Column) -> Column:
    parts = F.flatten(F.transform(F.coalesce(c, F.array()), lambda x: F.array(*[x[k]["name"] for k in ("segment", "genre", "subGenre", "type", "subType")])))
    return text.ordered_distinct(parts)


def best_image(images: Column) -> Column:
    """URL of the largest picture, the first of equal ones."""
    start = F.struct(F.lit(-1).cast("bigint").alias("area"), F.lit(None).cast("string").alias("url"))

    def step(acc, x):
        area = (F.coalesce(x["width"], F.lit(0)) * F.coalesce(x["height"], F.lit(0))).cast("bigint")
        return F.when((area > acc["area"]) & x["url"].isNotNull(), F.struct(area.alias("area"), x["url"].alias("url"))).otherwise(acc)

    return F.aggregate(images, start, step, lambda acc: acc["url"])


def listing_start(dates: Column) -> Column:
    """dateTime, or local date and time (19:00 without one) in the named zone, or UTC."""
    zone = F.coalesce(dates["timezone"], F.lit("UTC"))
    local = F.try_to_timestamp(F.concat_ws(" ", dates["start"]["localDate"], F.coalesce(dates["start"]["localTime"], F.lit("19:00:00"))))
    return F.coalesce(F.try_to_timestamp(dates["start"]["dateTime"]), F.to_utc_timestamp(local, zone))


def listings(items: DataFrame) -> DataFrame:
    """items(doc_id, pos, item) of paged listings -> flat fields; those without a name, start or coordinates go."""
    e, v = F.col("item"), F.get(F.col("item")["_embedded"]["venues"], F.lit(0))
    price = F.get(e["priceRanges"], F.lit(0))
    lat, lon = v["location"]["latitude"].try_cast("double"), v["location"]["longitude"].try_cast("double")
    rows = items.select(
        "doc_id", "pos",
        text.blank_to_null(e["name"]).alias("title"), e["info"].alias("description"), listing_start(e["dates"]).alias("start_at"), e["id"].alias("source_event_id"), e["url"].alias("external_url"),
        v["name"].alias("venue_name"), text.join_address(v["address"]["line1"], v["city"]["name"], v["state"]["stateCode"], v["postalCode"]).alias("raw_address"),
        lat.alias("lat"), lon.alias("lon"), geo.point_wkt(lat, lon).alias("location"), class_names(e["classifications"]).alias("categories"),
        text.ordered_distinct(F.transform(F.coalesce(e["_embedded"]["attractions"], F.array()), lambda a: a["name"])).alias("tags"),
        price["min"].cast("decimal(10,2)").alias("price"), price["currency"].alias("currency"), best_image(e["images"]).alias("image_url"), text.normal_status(e["dates"]["status"]["code"]).alias("status"),
    )
    return rows.where("title is not null and start_at is not null and location is not null")


def topic_names(nodes: DataFrame, column: str = "topics") -> Column:
    """Topics given as strings or as objects with a name."""
    element = nodes.schema[column].dataType.elementType
    return F.transform(column, lambda x: x["name"]) if isinstance(element, T.StructType) else F.col(column)


def group_events(nodes: DataFrame, lat: float, lon: float) -> DataFrame:
    """nodes(id, title, name, dateTime, eventUrl, link, venue_name, venue_lat, venue_lng, topics) -> flat fields."""
    venue = text.blank_to_null(F.col("venue_name"))
    return nodes.select(
        "doc_id", "pos", F.col("id").alias("source_event_id"), text.first_text(F.col("title"), F.col("name")).alias("title"), timex.iso_instant(F.col("dateTime")).alias("start_at"),
        text.first_text(F.col("eventUrl"), F.col("link")).alias("external_url"), venue.alias("venue_name"), F.coalesce("venue_lat", F.lit(lat)).alias("lat"), F.coalesce("venue_lng", F.lit(lon)).alias("lon"),
        text.ordered_distinct(topic_names(nodes)).alias("tags"), F.when(venue.isNotNull(), 0.85).otherwise(0.6).alias("location_confidence"),
    ).where("title is not null and start_at is not null")


# Where a first sentence ends, what stands behind 'at' as a venue, and a clock time.
SENTENCE_END = r"(?<=[.!?])\s"
VENUE_AFTER_AT = r"\bat\s+([A-Z][A-Za-z0-9&' .-]{2,80}?)(?=\s+(?:this|next|on|tonight|tomorrow)\b|[,.!]|$)"
POST_CLOCK = r"\b(\d{1,2})(?::(\d{2}))?\s*(am|pm)\b"
TITLE_CHARS = 120


def post_hints(posts: DataFrame, tz: str = timex.TZ) -> DataFrame:
    """posts(doc_id, text, posted_at) -> doc_id, title, venue_name, start_at: posts that announce, with a venue or a time.

    A post that begins with a question is a request. A weekday counts from the posting date ('next' adds a week on the same
    weekday), then 'tomorrow'; else it is the posting date. 19:00 without a time.
    """
    t = text.collapse(F.coalesce("text", F.lit("")))
    low = F.lower(t)
    question = F.get(F.split(t, SENTENCE_END, 2), F.lit(0)).endswith("?")
    venue = F.nullif(F.regexp_replace(F.trim(F.regexp_extract(t, VENUE_AFTER_AT, 1)), "[.,]+$", ""), F.lit(""))
    posted = F.from_utc_timestamp("posted_at", tz).cast("date")
    weekday = F.coalesce(*[F.when(low.contains(d), i) for i, d in enumerate(text.WEEKDAYS)])
    day = F.when(weekday.isNotNull(), timex.relative_weekday(weekday, posted, low.contains("next "))).when(low.contains("tomorrow"), F.date_add(posted, 1)).otherwise(posted)
    part = lambda k: F.nullif(F.regexp_extract(low, POST_CLOCK, k), F.lit(""))
    hour, half = part(1).cast("int"), part(3)
    hour = F.when(hour.isNull(), 19).when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
    local = F.try_make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), hour, F.coalesce(part(2).cast("int"), F.lit(0)), F.lit(0))
    title = F.trim(F.substring(F.substring_index(t, ".", 1), 1, TITLE_CHARS))
    rows = posts.where(~question & (venue.isNotNull() | low.rlike(POST_CLOCK)) & (title != ""))
    return rows.select("doc_id", title.alias("title"), venue.alias("venue_name"), F.to_utc_timestamp(local.cast("timestamp"), tz).alias("start_at"))


def annotated_hints(posts: DataFrame, annotations: DataFrame, least: float = 0.5) -> DataFrame:
    """Posts that an annotations table (doc_id, is_event, confidence, title, venue_name) takes for events."""
    few = annotations.where(F.col("is_event") & (F.col("confidence") >= least)).select("doc_id", F.substring("title", 1, 120).alias("title"), "venue_name", "confidence")
    return posts.select("doc_id", "posted_at").join(few, "doc_id")
