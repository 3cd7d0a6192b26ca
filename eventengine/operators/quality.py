"""Normalising, validating and measuring canonical rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, money, text, timex
from ..schema import CANON


def flatten_canonical(nested: DataFrame, source_tier: int) -> DataFrame:
    """Nested canonical events -> flat payload; status 'unknown' becomes 'scheduled', a point needs both coordinates."""
    status = F.when(F.col("status") == "unknown", "scheduled").otherwise(F.col("status"))
    return nested.select(
        "title",
        "description",
        F.col("start_time").alias("start_at"),
        F.col("end_time").alias("end_at"),
        F.col("source.source_id").alias("source_name"),
        F.lit(source_tier).alias("source_tier"),
        F.col("source.source_record_id").alias("source_event_id"),
        F.col("source.source_url").alias("external_url"),
        F.col("location.venue_name").alias("venue_name"),
        F.col("location.address_line1").alias("raw_address"),
        geo.point_wkt(F.col("location.lat"), F.col("location.lon")).alias("location"),
        F.col("category_tags").alias("categories"),
        F.col("vibe_tags").alias("tags"),
        F.col("offers.price_min").cast("decimal(10,2)").alias("price"),
        F.col("offers.currency").alias("currency"),
        "image_url",
        status.alias("status"),
        F.col("organizer.name").alias("organizer_name"),
        F.col("social_signals.attendee_count").alias("attendee_count"),
        F.col("location.location_confidence").alias("location_confidence"),
        F.col("offers.is_free").alias("is_free"),
    )


def to_payload(stored: DataFrame) -> DataFrame:
    """Stored rows -> payloads: the canonical columns, lists never null."""
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("categories", "tags")}
    return stored.withColumns(lists).select(*(c for c in stored.columns if c not in CANON.fieldNames()), *CANON.fieldNames())


def apply_payload(pairs: DataFrame, stored: str = "stored", payload: str = "payload") -> DataFrame:
    """pairs with two structs of canonical columns -> the stored columns as the payload leaves them: all of them its own,
    lists and numbers with their defaults, but the status, which only escalates."""
    old, new = (lambda c: F.col(f"{stored}.{c}")), (lambda c: F.col(f"{payload}.{c}"))
    severity = F.create_map(*[F.lit(x) for kv in text.STATUS_SEVERITY.items() for x in kv])
    rank = lambda status: F.coalesce(F.try_element_at(severity, status), F.lit(0))
    said = F.coalesce(new("status"), F.lit("scheduled"))
    # a count or a confidence of zero is none given
    own = {
        "categories": F.coalesce(new("categories"), F.array().cast("array<string>")), "tags": F.coalesce(new("tags"), F.array().cast("array<string>")), "attendee_count": F.coalesce(new("attendee_count"), F.lit(0)),
        "location_confidence": F.coalesce(F.nullif(new("location_confidence"), F.lit(0.0)), F.lit(1.0)), "is_free": F.coalesce(new("is_free"), F.lit(False)), "status": F.when(rank(said) > rank(old("status")), said).otherwise(old("status")),
    }
    rest = [c for c in pairs.columns if c not in (stored, payload)]
    return pairs.select(*rest, *[own.get(c, new(c)).alias(c) for c in CANON.fieldNames()])


def reject_reason(oldest: Column | None = None) -> Column:
    """Why a payload cannot be a canonical row; null when it can. ``oldest``: starts before it are rejected too."""
    blank = lambda c: text.blank_to_null(F.col(c)).isNull()
    out = F.when(blank("title"), "title").when(F.col("start_at").isNull(), "start_at").when(blank("location"), "location").when(blank("source_name"), "source_name").when(F.col("source_tier").isNull(), "source_tier").when(F.col("status").isNotNull() & blank("status"), "status")
    return out if oldest is None else out.when(F.col("start_at") < oldest, "too_old")


def normalize(payloads: DataFrame, oldest: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Payloads -> (canonical rows with their other columns, rejected rows with a reason)."""
    judged = payloads.withColumn("reject_reason", reject_reason(oldest))
    good = judged.where("reject_reason is null").drop("reject_reason")
    clean = {
        "title": F.trim("title"),
        "source_name": F.trim("source_name"),
        "location": F.trim("location"),
        "status": F.lower(F.trim(F.coalesce("status", F.lit("scheduled")))),
        **{c: text.blank_to_null(F.col(c)) for c in ("description", "source_event_id", "external_url", "venue_name", "raw_address", "image_url", "organizer_name")},
        "categories": text.ordered_distinct(F.col("categories")),
        "tags": text.ordered_distinct(F.col("tags")),
        "price": F.col("price").try_cast("decimal(10,2)"),
        "currency": text.currency(F.col("currency")),
        "attendee_count": money.safe_count(F.col("attendee_count")),
        "location_confidence": money.confidence(F.col("location_confidence")),
        "is_free": F.coalesce(F.col("is_free").cast("boolean"), F.lit(False)),
    }
    rest = [c for c in good.columns if c not in CANON.fieldNames()]
    return good.withColumns(clean).select(*CANON.fieldNames(), *rest), judged.where("reject_reason is not null")


def source_counts(good: DataFrame, rejected: DataFrame) -> DataFrame:
    """Published and rejected rows of each source."""
    both = good.select("source_name", F.lit(1).alias("p"), F.lit(0).alias("r")).unionByName(rejected.select("source_name", F.lit(0).alias("p"), F.lit(1).alias("r")))
    return both.groupBy("source_name").agg(F.count("*").alias("ingested"), F.sum("p").alias("published"), F.sum("r").alias("rejected"))


def completeness(rows: DataFrame, by: str = "source_name") -> DataFrame:
    """Shares of rows with a price, a link, an organiser."""
    share = lambda c: F.avg(F.col(c).isNotNull().cast("double"))
    return rows.groupBy(by).agg(share("price").alias("with_price"), share("external_url").alias("with_link"), share("organizer_name").alias("with_organizer"))


def volume_by_weekday(rows: DataFrame, tz: str = timex.TZ) -> DataFrame:
    return rows.groupBy(F.weekday(F.from_utc_timestamp("start_at", tz)).alias("weekday")).agg(F.count("*").alias("n"))


def private_locations(rows: DataFrame, by: str = "source_name") -> DataFrame:
    """Rows of each source whose place is told to guests only."""
    return rows.groupBy(by).agg(F.count_if("private_location").alias("private_locations"), F.count("*").alias("n"))


def event_yield(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("is_event").cast("int")).alias("events"), F.avg(F.col("is_event").cast("double")).alias("share"))


def extracted_share(rows: DataFrame, by: str = "source_name") -> DataFrame:
    return rows.groupBy(by).agg(F.avg(F.col("llm_extracted").cast("double")).alias("model_share"))
