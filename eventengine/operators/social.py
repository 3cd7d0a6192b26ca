"""Folders that groups vote on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money, timex


def current_votes(log: DataFrame) -> DataFrame:
    """log(item_id, user_id, value, at) -> the last vote of each user on each item, as +1 or -1."""
    last = log.groupBy("item_id", "user_id").agg(F.max_by("value", "at").alias("value"))
    return last.withColumn("value", money.vote_sign(F.col("value")))


def scores(votes: DataFrame) -> DataFrame:
    return votes.groupBy("item_id").agg(F.sum("value").alias("vote_score"))


def board(items: DataFrame, events: DataFrame, votes: DataFrame) -> DataFrame:
    """items(folder_id, item_id, event_id) with title and vote_score, best first; items of unknown events go."""
    rows = items.join(events.select(F.col("id").alias("event_id"), "title", "start_at"), "event_id").join(scores(votes), "item_id", "left")
    return rows.withColumn("vote_score", F.coalesce("vote_score", F.lit(0))).orderBy("folder_id", F.desc("vote_score"), "title", "item_id")


def visible(folders: DataFrame, members: DataFrame) -> DataFrame:
    """folders(folder_id, owner_id, updated_at), members(folder_id, user_id) -> user_id, folder_id, each once: owned or joined."""
    owned = folders.select(F.col("owner_id").alias("user_id"), "folder_id")
    return owned.union(members.join(folders.select("folder_id"), "folder_id", "left_semi").select("user_id", "folder_id")).distinct()


def allowed(asks: DataFrame, folders: DataFrame, members: DataFrame) -> DataFrame:
    """asks(user_id, folder_id) of owners and members only."""
    return asks.join(visible(folders, members), ["user_id", "folder_id"], "left_semi")


def my_folders(folders: DataFrame, members: DataFrame) -> DataFrame:
    return visible(folders, members).join(folders, "folder_id").orderBy("user_id", F.desc("updated_at"), "folder_id")


def valid_token(token: Column) -> Column:
    """Sixteen characters or more, letters, digits, - and _ only."""
    return F.coalesce(token.rlike(r"^[A-Za-z0-9_-]{16,}$"), F.lit(False))


def accept(invites: DataFrame, accepts: DataFrame, folders: DataFrame, members: DataFrame, as_of: Column) -> DataFrame:
    """accepts(token, user_id) of live invites -> new memberships; owners and members get none."""
    until = timex.expires_at(F.col("created_at"), F.col("ttl_days"))
    live = invites.where(~F.coalesce("revoked", F.lit(False)) & (until.isNull() | (until > as_of)) & valid_token(F.col("token")))
    asked = accepts.join(live.select("token", "folder_id"), "token").select("folder_id", "user_id").distinct()
    return asked.join(visible(folders, members), ["folder_id", "user_id"], "left_anti")
