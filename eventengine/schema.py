"""Schemas of the tables that operators pass between them."""

from __future__ import annotations

from pyspark.sql import types as T

CANON = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("start_at", T.TimestampType()),
        T.StructField("end_at", T.TimestampType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("source_tier", T.IntegerType()),
        T.StructField("source_event_id", T.StringType()),
        T.StructField("external_url", T.StringType()),
        T.StructField("venue_name", T.StringType()),
        T.StructField("raw_address", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("categories", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("price", T.DecimalType(10, 2)),
        T.StructField("currency", T.StringType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("organizer_name", T.StringType()),
        T.StructField("attendee_count", T.IntegerType()),
        T.StructField("location_confidence", T.DoubleType()),
        T.StructField("is_free", T.BooleanType()),
    ]
)
CANDIDATE = "doc_id long, pos int, url string, title string, when_text string, venue_name string, price_text string, votes int"
