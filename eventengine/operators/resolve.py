"""Entity resolution: duplicates within a batch, matches against the stored table, upserts, lifecycle.

Rule for two rows: starts at most two hours apart, and the same URL, or a title similarity above 85, or the same venue and
a token-set similarity of at least 60. A cluster is folded in input order against an evolving representative, so that the
work is cut first into groups that no cluster can cross: time sessions (gaps of more than two hours), and in them the
connected components of same URL, similar title, same venue. Each component is folded in one task.

Sides that grow with the rows are merged: few bytes in a file, such as those of numbered rows, can be more on the driver than
a broadcast may take.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import similarity, text
from ..functions.text import STATUS_SEVERITY
from ..schema import CANON
from . import titles
from .scratch import written

WINDOW = timedelta(hours=2)
EPOCH = datetime(1970, 1, 1)
MICRO = timedelta(microseconds=1)
TITLE_OVER, TOKENS_FROM = titles.OVER, 60.0
RICHER = ["title", "description", "external_url", "venue_name", "raw_address", "image_url", "location", "source_event_id", "currency", "source_name", "organizer_name"]


def sessions(rows: DataFrame, by: list[str] | None = None, gap: timedelta = WINDOW) -> DataFrame:
    """rows with ``session``: the start of the run of rows without a gap. Runs are found from distinct start hours first,
    so that no task sees more than a day of distinct starts."""
    by = by or []
    micros = int(gap.total_seconds() * 1e6)
    starts = rows.select(*by, "start_at").distinct()
    at = F.unix_micros("start_at")
    day = F.floor(at / F.lit(86_400_000_000)).alias("__day")
    edges = starts.groupBy(*by, day).agg(F.max(at).alias("__last"))
    # the last start of the latest earlier day with starts: one row a day
    before = edges.withColumn("__before", F.lag("__last").over(Window.partitionBy(*by or [F.lit(0)]).orderBy("__day"))).select(*by, "__day", "__before")
    inside = Window.partitionBy(*by, "__day").orderBy("start_at")
    marked = starts.withColumn("__day", day).withColumn("__prev", F.lag(at).over(inside)).join(before.hint("merge"), [*by, "__day"])
    opens = marked.withColumn("__open", F.coalesce(at - F.coalesce("__prev", "__before") > micros, F.lit(True)))
    first = opens.withColumn("__s", F.max(F.when(F.col("__open"), at)).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # a day that begins inside a session takes it from the days before
    last_open = opens.groupBy(*by, "__day").agg(F.max(F.when(F.col("__open"), at)).alias("__lo"))
    carried = last_open.withColumn("__carry", F.max("__lo").over(Window.partitionBy(*by or [F.lit(0)]).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))).select(*by, "__day", "__carry")
    named = first.join(carried.hint("merge"), [*by, "__day"]).select(*by, "start_at", F.coalesce("__s", "__carry").alias("session"))
    return rows.join(named.hint("merge"), [*by, "start_at"])


def similar_titles(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows(key, title) -> key, a, b: pairs of distinct titles within ``key`` with a similarity above the threshold."""
    return titles.similar(rows.select(*key, titles.title_key(F.col("title")).alias("t")), None, key)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(id), edges(u, v) -> id, component: least label passed along the edges, with jumps, until nothing changes."""
    both = written(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    label = written(nodes.select("id", F.col("id").alias("component")), "label")
    while True:
        near = both.join(label.select(F.col("id").alias("v"), "component").hint("merge"), "v").groupBy("u").agg(F.min("component").alias("m"))
        now = label.join(near.hint("merge"), F.col("id") == F.col("u"), "left").select("id", F.least("component", F.coalesce("m", "component")).alias("c"), F.col("component").alias("was"))
        now = written(now, "label")
        up = now.select(F.col("id").alias("c"), F.col("c").alias("top"))
        jumped = written(now.join(up.hint("merge"), "c", "left").select("id", F.coalesce("top", "c").alias("component"), "was"), "label")
        if not jumped.where("component <> was").head(1):
            return jumped.select("id", "component")
        label = jumped.select("id", "component")


def duplicate_groups(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rows(ordinal, …) -> ordinal, component: groups that no cluster can cross."""
    by = by or []
    cut = written(sessions(rows.select("ordinal", *by, "title", "venue_name", "external_url", "start_at"), by), "sessions")
    key = [*by, "session"]
    pairs = similar_titles(cut, key)
    named = cut.select(*key, "ordinal", titles.title_key(F.col("title")).alias("t"))
    least = named.groupBy(*key, "t").agg(F.min("ordinal").alias("v"))
    stars = [named.join(least.hint("merge"), [*key, "t"]).select(F.col("ordinal").alias("u"), "v")]
    for name, value in (("url", text.url_key(F.col("external_url"))), ("venue", F.nullif(text.venue_key(F.col("venue_name")), F.lit("")))):
        own = cut.select(*key, "ordinal", value.alias(name)).where(F.col(name).isNotNull())
        stars.append(own.join(own.groupBy(*key, name).agg(F.min("ordinal").alias("v")).hint("merge"), [*key, name]).select(F.col("ordinal").alias("u"), "v"))
    alike = pairs.join(least.select(*key, F.col("t").alias("a"), F.col("v").alias("u")).hint("merge"), [*key, "a"]).join(least.select(*key, F.col("t").alias("b"), "v").hint("merge"), [*key, "b"]).select("u", "v")
    edges = alike
    for s in stars:
        edges = edges.unionByName(s)
    return components(cut.select(F.col("ordinal").alias("id")), edges).select(F.col("id").alias("ordinal"), "component")


def _micros(at: datetime | int) -> int:
    """Microseconds since the epoch. Inside tasks instants are such numbers: pandas ends in 2262 and datetime in 9999."""
    return at if isinstance(at, int) else (at - EPOCH) // MICRO


TIMES = [f.name for f in CANON.fields if isinstance(f.dataType, T.TimestampType)]
#: The canonical columns as tasks have them.
INSIDE = [T.StructField(f.name, T.LongType()) if f.name in TIMES else f for f in CANON.fields]


def _inside(of: str = "") -> list[Column]:
    """The canonical columns, or those of a struct, with instants as microseconds."""
    return [F.unix_micros(F.col(of + c)).alias(c) if c in TIMES else F.col(of + c).alias(c) for c in CANON.fieldNames()]


def _outside(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.timestamp_micros(F.col(c)) for c in TIMES})


def _missing(v) -> bool:
    return v is None or (isinstance(v, float) and v != v) or (isinstance(v, str) and not v.strip()) or (hasattr(v, "__len__") and not isinstance(v, str) and len(v) == 0)


def _none(v):
    return None if _missing(v) else v


def is_duplicate(a: dict, b: dict) -> bool:
    if abs(_micros(a["start_at"]) - _micros(b["start_at"])) > WINDOW // MICRO:
        return False
    left, right = ((x.get("external_url") or "").strip().rstrip("/") for x in (a, b))
    if left and left == right:
        return True
    if similarity.title_ratio(a["title"], b["title"]) > TITLE_OVER:
        return True
    venue, other = ((x.get("venue_name") or "").split("(")[0].strip().casefold() for x in (a, b))
    return bool(venue) and venue == other and similarity.token_set_ratio(a["title"], b["title"]) >= TOKENS_FROM


def merge(a: dict, b: dict) -> dict:
    """The representative a, with what b adds: lower tier's times, richer texts, escalated status, unions, extremes."""
    out = dict(a)
    ends = [e for e in (_none(a["end_at"]), _none(b["end_at"])) if e is not None]
    if a["source_tier"] == b["source_tier"]:
        out["start_at"], out["end_at"] = min(a["start_at"], b["start_at"]), max(ends, default=None)
    else:
        first, second = (a, b) if a["source_tier"] < b["source_tier"] else (b, a)
        end = _none(first["end_at"])
        out["start_at"], out["end_at"] = first["start_at"], end if end is not None else _none(second["end_at"])
    for f in RICHER:
        left, right = a.get(f), b.get(f)
        out[f] = left if _missing(right) else right if _missing(left) or len(right.strip()) > len(left.strip()) else left
    out["status"] = max(a["status"], b["status"], key=lambda s: STATUS_SEVERITY.get(s, 0))
    out["source_tier"] = min(a["source_tier"], b["source_tier"])
    for f in ("categories", "tags"):
        out[f] = list(dict.fromkeys(x for side in (a[f], b[f]) if side is not None for x in side if x))
    prices = [p for p in (_none(a["price"]), _none(b["price"])) if p is not None]
    out["price"] = min(prices, default=None)
    out["attendee_count"] = max(int(_none(x["attendee_count"]) or 0) for x in (a, b))
    out["location_confidence"] = max(float(_none(x["location_confidence"]) or 1.0) for x in (a, b))
    out["is_free"] = bool(_none(a["is_free"])) or bool(_none(b["is_free"]))
    return out


class Representatives:
    """The folded rows of one component in the order of their firsts, found by two-hour buckets of their starts, so that a
    row meets only those that are close in time, however long the component is."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.places: dict[int, set[int]] = {}

    def _bucket(self, row: dict) -> int:
        return _micros(row["start_at"]) // (WINDOW // MICRO)

    def add(self, row: dict) -> None:
        """Fold a row into the first representative that it repeats, or make it one."""
        at = self._bucket(row)
        for k in sorted(k for b in (at - 1, at, at + 1) for k in self.places.get(b, ())):
            e = self.rows[k]
            if is_duplicate(e, row):
                self.rows[k] = merge(e, row) | {"ordinal": e["ordinal"], "members": e["members"] + 1}
                was, now = self._bucket(e), self._bucket(self.rows[k])
                if was != now:
                    self.places[was].remove(k)
                    self.places.setdefault(now, set()).add(k)
                return
        self.places.setdefault(at, set()).add(len(self.rows))
        self.rows.append(row | {"members": 1})


FOLDED = T.StructType([T.StructField("ordinal", T.LongType()), *INSIDE, T.StructField("members", T.IntegerType())])
CHANGED = T.StructType([T.StructField("id", T.LongType()), *INSIDE])


def dedupe(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Canonical rows with ordinal -> one row for each cluster, with the ordinal of its first and the number of its members."""
    placed = rows.select("ordinal", *CANON.fieldNames()).join(duplicate_groups(rows, by).hint("merge"), "ordinal")
    kind = to_arrow_schema(FOLDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # components come one after another, in input order; only the representatives of one are held
        of, held = None, Representatives()
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                component = row.pop("component")
                if component != of:
                    done += held.rows
                    of, held = component, Representatives()
                held.add(row)
            yield pa.RecordBatch.from_pylist(done, kind)
        yield pa.RecordBatch.from_pylist(held.rows, kind)

    return _outside(placed.repartition("component").sortWithinPartitions("component", "ordinal").select("component", "ordinal", *_inside()).mapInArrow(run, FOLDED))


def match_stored(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming(ordinal), stored(id) -> ordinal, id: the best stored row by the duplicate rule, least id on ties.

    Starts are put into two-hour buckets; a stored row stands in its bucket, an incoming one looks into three. Within a
    bucket rows meet by the same URL, a similar title, or the same venue and titles whose tokens are alike, three equi-joins.
    Ratios are worked out once for each pair of distinct titles, however many rows of a venue have them.
    """
    width = int(WINDOW.total_seconds())
    bucket = F.floor(F.unix_seconds("start_at") / width)
    url, venue = text.url_key(F.col("external_url")).alias("url"), F.nullif(text.venue_key(F.col("venue_name")), F.lit("")).alias("venue")
    fields = ["title", "start_at", url, venue, titles.title_key(F.col("title")).alias("t")]
    left = written(incoming.select("ordinal", *fields, F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket")), "incoming")
    right = written(stored.select("id", *fields, bucket.alias("bucket")).toDF("id", "s_title", "s_start_at", "url", "venue", "t", "bucket"), "stored")
    alike = titles.similar(left, right, ["bucket"])
    close = F.abs(F.unix_micros("start_at") - F.unix_micros("s_start_at")) <= width * 1_000_000
    # of a venue's rows only distinct titles meet, each pair of titles once over all buckets and venues
    own, other = left.select("bucket", "venue", "title").distinct(), right.select("bucket", "venue", "s_title").distinct()
    spoken = own.join(other.hint("merge"), ["bucket", "venue"]).select("title", "s_title").distinct()
    spoken = written(spoken.withColumn("tokens", similarity.token_set_similarity("title", "s_title")).where(F.col("tokens") >= TOKENS_FROM).select("title", "s_title"), "spoken")
    by_title = left.join(alike.withColumnRenamed("a", "t").hint("merge"), ["bucket", "t"]).join(right.select("bucket", F.col("t").alias("b"), "id", "s_title", "s_start_at").hint("merge"), ["bucket", "b"])
    by_url = left.join(right.select("bucket", "url", "id", "s_title", "s_start_at").hint("merge"), ["bucket", "url"])
    by_venue = left.join(spoken, "title").join(right.select("bucket", "venue", "id", "s_title", "s_start_at").hint("merge"), ["bucket", "venue", "s_title"])
    found = [m.where(close).select("ordinal", "id", "title", "s_title") for m in (by_title, by_url, by_venue)]
    hit = written(found[0].unionByName(found[1]).unionByName(found[2]).distinct(), "hits")
    ratios = hit.select("title", "s_title").distinct().withColumn("best", F.greatest(similarity.title_similarity("title", "s_title"), similarity.token_set_similarity("title", "s_title")))
    scored = hit.join(ratios.select(F.col("title").alias("x"), F.col("s_title").alias("y"), "best"), F.col("title").eqNullSafe(F.col("x")) & F.col("s_title").eqNullSafe(F.col("y")))
    return scored.groupBy("ordinal").agg(F.min_by("id", F.struct((-F.col("best")).alias("b"), "id")).alias("id"))


def has_news(old: str = "o", new: str = "n") -> Column:
    """Whether an incoming row says something significant that the stored one lacks."""
    o, n = (lambda c: F.col(f"{old}.{c}")), (lambda c: F.col(f"{new}.{c}"))
    empty = F.array().cast("array<string>")
    blank = lambda c, kind: text.blank_to_null(c).isNull() if kind == "string" else c.isNull()
    kinds = {"description": "string", "external_url": "string", "venue_name": "string", "raw_address": "string", "image_url": "string", "end_at": "", "price": "", "currency": "string"}
    out = F.lit(False)
    for c, kind in kinds.items():
        out = out | (blank(o(c), kind) & ~blank(n(c), kind))
    for c in ("categories", "tags"):
        out = out | (F.size(F.array_except(F.coalesce(n(c), empty), F.coalesce(o(c), empty))) > 0)
    longer = F.coalesce(F.length(F.trim(n("description"))) > F.length(F.trim(o("description"))) + 30, F.lit(False))
    out = out | (longer & (similarity.title_similarity(o("description"), n("description")) < 95))
    return out | F.coalesce(F.abs(F.unix_micros(n("start_at")) - F.unix_micros(o("start_at"))) > 1_800_000_000, F.lit(False))


def changes(incoming: DataFrame, stored: DataFrame, top: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changed stored rows, inserted rows, ordinal -> action and id).

    All incoming rows are matched to the table as it was; several that hit one stored row are folded in their order; rows
    that hit none are deduplicated once more and inserted with ids after the largest, which ``top`` (one row) holds where
    ``stored`` is a part of the table only.
    """
    clean = written(dedupe(incoming).select("ordinal", *CANON.fieldNames()), "incoming")
    pairs = written(match_stored(clean, stored), "matches")
    o = stored.select("id", F.struct(*CANON.fieldNames()).alias("o"))
    n = clean.select("ordinal", F.struct(*CANON.fieldNames()).alias("n"))
    judged = written(pairs.join(n.hint("merge"), "ordinal").join(o.hint("merge"), "id").withColumn("news", has_news()), "judged")

    kind = to_arrow_schema(CHANGED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the news of a stored row come one after another, in input order; only what it has become is held
        of, row = None, {}
        for batch in batches:
            done = []
            for met in batch.to_pylist():
                if met["id"] != of:
                    if of is not None:
                        done.append(row)
                    of, row = met["id"], met["o"] | {"id": met["id"]}
                row = merge(row, met["n"])
            yield pa.RecordBatch.from_pylist(done, kind)
        yield pa.RecordBatch.from_pylist([row] if of is not None else [], kind)

    news = judged.where("news").select("id", "ordinal", F.struct(*_inside("o.")).alias("o"), F.struct(*_inside("n.")).alias("n"))
    changed = _outside(news.repartition("id").sortWithinPartitions("id", "ordinal").mapInArrow(run, CHANGED))
    fresh = clean.join(pairs.hint("merge"), "ordinal", "left_anti")
    top = F.broadcast(stored.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("top")) if top is None else top)
    rank = fresh.select("ordinal").repartitionByRange("ordinal").sortWithinPartitions("ordinal").withColumn("part", F.spark_partition_id())
    rank = written(rank.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("ordinal"))), "rank")
    counts = rank.groupBy("part").agg(F.count("*").alias("c"))
    before = counts.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("b"))
    ids = rank.join(before, "part").crossJoin(top).select("ordinal", (F.col("top") + F.col("b") + F.col("k")).alias("id"))
    inserted = fresh.join(ids.hint("merge"), "ordinal").select("id", *CANON.fieldNames())
    actions = judged.select("ordinal", "id", F.when(F.col("news"), "update").otherwise("skip").alias("action")).unionByName(ids.select("ordinal", "id", F.lit("insert").alias("action")))
    return changed, inserted, actions


def upsert(incoming: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the new stored table, ordinal -> action and id); see :func:`changes`."""
    changed, inserted, actions = changes(incoming, stored)
    news = actions.where("action = 'update'").select("id").distinct()
    kept = stored.select("id", *CANON.fieldNames()).join(news.hint("merge"), "id", "left_anti")
    return kept.unionByName(changed).unionByName(inserted), actions


def summarize(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def mark_past(events: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Scheduled events are past a day after their end, or their start where they have none."""
    over = F.timestamp_add("HOUR", F.lit(hours), F.coalesce("end_at", "start_at")) < as_of
    return events.withColumn("status", F.when((F.col("status") == "scheduled") & over, "past").otherwise(F.col("status")))


def unseen(rows: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("source_name", "source_event_id")) -> DataFrame:
    """Rows whose key the known table lacks: an idempotent load."""
    return rows.join(known.select(*keys), list(keys), "left_anti")
