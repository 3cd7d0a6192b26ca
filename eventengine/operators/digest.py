"""Text digests of the best events."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, timex
from .profile import profiles
from .rank import rank_without_user, score_events
from .search import people_interested

# Fixed values.
FALLBACK_NOTE = "_(ranked by freshness+popularity — no user signals)_"
EMPTY_NOTE = "_No events found in this window._"
SHOWN_TAGS = 2


def event_line(tz: str = timex.TZ) -> Column:
    """'- **Title** — Sat Aug 8 7:30pm · The Room · $15 · [link](…) · _#a #b_'; no venue is TBA, no link and no tags are left out."""
    empty = F.array().cast("array<string>")
    matched = F.coalesce("matched_tags", empty)
    tags = F.slice(F.when(F.size(matched) > 0, matched).otherwise(F.coalesce("tags", empty)), 1, SHOWN_TAGS)
    venue = F.coalesce(F.nullif(F.col("venue_name"), F.lit("")), F.lit("TBA"))
    link = F.concat(F.lit("[link]("), F.nullif(F.col("external_url"), F.lit("")), F.lit(")"))
    shown = F.when(F.size(tags) > 0, F.concat(F.lit("_"), F.array_join(tags, " "), F.lit("_")))
    head = F.concat(F.lit("**"), "title", F.lit("** — "), timex.local_when(F.col("start_at"), tz))
    return F.concat(F.lit("- "), F.concat_ws(" · ", head, venue, text.price_label(F.col("is_free"), F.col("price")), link, shown))


def digest_lines(ranked: DataFrame, generated_at: datetime, days: int = 7, top: int = 15, fallback: bool = False, tz: str = timex.TZ) -> DataFrame:
    """ranked(total_score, start_at, id, title, venue_name, is_free, price, external_url, tags and, where there are any,
    matched_tags) -> n, line: heading, window, the best ``top`` events or a note that there are none, the note of a ranking
    without a user, and the footer."""
    rows = ranked if "matched_tags" in ranked.columns else ranked.withColumn("matched_tags", F.array().cast("array<string>"))
    best = rows.orderBy(F.desc("total_score"), "start_at", "id").limit(top)
    # at most ``top`` rows are put together
    listed = best.agg(F.collect_list(F.struct((-F.col("total_score")).alias("s"), "start_at", "id", event_line(tz).alias("line"))).alias("x"))
    found = F.transform(F.array_sort("x"), lambda r: r["line"])
    body = F.when(F.size("x") > 0, found).otherwise(F.array(F.lit(EMPTY_NOTE)))
    head = [f"# Events digest — {generated_at.date().isoformat()}", f"_Window: next {days} days_", ""]
    tail = ["", FALLBACK_NOTE] if fallback else []
    whole = F.concat(F.array(*map(F.lit, head)), body, F.array(*map(F.lit, [*tail, "", "_Generated from the events table_"])))
    return listed.select(F.posexplode(whole).alias("n", "line"))


def user_digest(events: DataFrame, users: DataFrame, signals: DataFrame, user_id: int | None, generated_at: datetime, days: int = 7, top: int = 15, tz: str = timex.TZ) -> DataFrame:
    """The digest of the events of the next ``days``: the best for a user, or by freshness and popularity for none, an
    unknown one, or one without preferences and profile."""
    now = F.lit(generated_at).cast("timestamp")
    window = events.where(F.col("start_at").between(now, F.lit(generated_at + timedelta(days=days)).cast("timestamp")))
    counts = people_interested(signals)
    if user_id is not None:
        user = users.where(F.col("user_id") == user_id)
        preferred = user.select("user_id", F.explode("preferred_vibes").alias("tag"))
        profile = profiles(signals.where(F.col("user_id") == user_id), events, now).join(user.select("user_id"), "user_id", "left_semi")
        if not (preferred.isEmpty() and profile.isEmpty()):
            return digest_lines(score_events(window, preferred, profile, counts, now, top), generated_at, days, top, tz=tz)
    return digest_lines(rank_without_user(window, counts, now), generated_at, days, top, fallback=True, tz=tz)


def write_digest(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).sortWithinPartitions("n").select("line").write.mode("overwrite").text(path)
