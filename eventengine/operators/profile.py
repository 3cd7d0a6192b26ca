"""Behavioural profiles of users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money, text

# Baseline of each intent.
INTENT_PROFILES = {
    "date_night": {"#date": 5.0, "#chill": 3.0, "#jazz": 2.0, "#film": 2.0, "#art": 2.0, "#livemusic": 1.0},
    "general_night_out": {"#nightout": 5.0, "#highenergy": 4.0, "#social": 3.0, "#nightlife": 3.0, "#comedy": 2.0, "#livemusic": 1.0},
    "bar_crawl": {"#nightlife": 5.0, "#latenight": 4.0, "#highenergy": 3.0, "#social": 3.0, "#foodanddrink": 2.0},
    "out_of_town_guests": {"#outdoors": 4.0, "#art": 3.0, "#livemusic": 2.0, "#social": 2.0, "#intellectual": 2.0, "#festival": 1.0},
}


def signal_tags(signals: DataFrame, events: DataFrame) -> DataFrame:
    """signals with tags: their own tag, or else those of their event."""
    tags = events.select(F.col("id").alias("event_id"), F.col("tags").alias("__tags"))
    own = F.when(F.coalesce(F.trim("vibe_tag"), F.lit("")) != "", F.array("vibe_tag")).otherwise(F.coalesce("__tags", F.array().cast("array<string>")))
    return signals.join(tags, "event_id", "left").withColumn("signal_tags", text.profile_tags(own)).drop("__tags")


def profiles(signals: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """user_id, tag, score: weights of the signals, halved every thirty days, summed by tag."""
    weighed = signal_tags(signals, events).withColumn("w", F.col("weight") * money.decay(F.col("created_at"), as_of)).where("w > 0")
    return weighed.select("user_id", "w", F.explode("signal_tags").alias("t")).groupBy("user_id", F.lower("t").alias("tag")).agg(F.sum("w").alias("score"))


def intent_profiles(spark) -> DataFrame:
    return spark.createDataFrame([(i, t, s) for i, tags in INTENT_PROFILES.items() for t, s in tags.items()], "intent string, tag string, score double")


def with_intent(requests: DataFrame, user_profiles: DataFrame) -> DataFrame:
    """requests(request_id, user_id, intent) -> request_id, tag, score: the user's profile on top of the intent's."""
    base = requests.join(F.broadcast(intent_profiles(requests.sparkSession)), "intent").select("request_id", "tag", "score")
    own = requests.join(user_profiles, "user_id").select("request_id", "tag", "score")
    return base.unionByName(own).groupBy("request_id", "tag").agg(F.sum("score").alias("score"))


def record_signals(actions: DataFrame, events: DataFrame) -> DataFrame:
    """actions(user_id, signal_type, event_id, vibe_tag, created_at) -> signals: known types of known events, tags normalised."""
    known = actions.join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi").unionByName(actions.where("event_id is null"))
    tag = F.get(text.profile_tags(F.array("vibe_tag")), F.lit(0))
    return known.withColumn("weight", money.signal_weight(F.col("signal_type"))).where("weight > 0").withColumn("vibe_tag", tag)


def accumulated(actions: DataFrame, kind: str, column: str) -> DataFrame:
    """user_id, values of ``column`` in first-seen order, from the actions of one kind."""
    first = actions.where((F.col("signal_type") == kind) & F.col(column).isNotNull()).groupBy("user_id", column).agg(F.min("created_at").alias("at"))
    listed = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", column))).alias("x"))
    return listed.select("user_id", F.transform("x", lambda r: r[column]).alias("values"))
