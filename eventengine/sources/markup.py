"""Extractors from markup. Layouts are parameters; documents are (doc_id, body, …), results have doc_id and pos.

Splits and patterns run as Spark functions. Walking JSON of unknown depth, offsets of anchors and character references
need Python; these are Arrow-batched.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text, timex

#: The character references that stand for a line feed.
LINE_FEED = r"&(?:#0*10(?![0-9]);?|#[xX]0*[aA](?![0-9a-fA-F]);?|NewLine;)"
VISIBLE = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->"


@pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) else None)


def capped(rows: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` rows of each document."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where(F.col("__n") <= cap).drop("__n")


def first_seen(rows: DataFrame, *key: str) -> DataFrame:
    """Of rows with the same key in a document, the first."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", *key).orderBy("pos"))).where("__n = 1").drop("__n")


def group1(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, tags off; null without one."""
    return F.nullif(text.strip_tags(F.regexp_extract(c, pattern, group)), F.lit(""))


def href(c: Column, base: str = "") -> Column:
    """The first link, absolute."""
    raw = F.nullif(F.regexp_extract(c, r"""(?is)href\s*=\s*["']([^"']+)["']""", 1), F.lit(""))
    return F.when(raw.rlike("^https?://"), raw).when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).when(raw.startswith("/"), F.concat(F.lit(base.rstrip("/")), raw)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), raw))


def blocks(docs: DataFrame, opening: str, keep: Column | None = None) -> DataFrame:
    """doc_id, pos, block: the body cut before each match of an opening pattern; what stands before the first goes."""
    parts = F.split("body", f"(?is)(?={opening})")
    rows = docs.select("doc_id", F.posexplode(parts).alias("pos", "block")).where(F.col("block").rlike(f"(?is)^{opening}"))
    return rows if keep is None else rows.where(keep)


def table_rows(docs: DataFrame, base: str = "") -> DataFrame:
    """Rows with two cells or more: when_text, title, url (from the title's cell), price_text; blank ones go."""
    rows = docs.select("doc_id", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)).alias("pos", "row"))
    cells = rows.withColumn("c", F.regexp_extract_all("row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1)).where(F.size("c") >= 2)
    cell = lambda i: F.nullif(text.strip_tags(F.get("c", F.lit(i))), F.lit(""))
    out = cells.select("doc_id", "pos", cell(0).alias("when_text"), cell(1).alias("event_text"), href(F.get("c", F.lit(1)), base).alias("url"), cell(2).alias("price_text"))
    out = out.where("when_text is not null and event_text is not null")
    title, venue = text.event_at_venue(F.col("event_text"))
    return out.select("doc_id", "pos", "url", title.alias("title"), "when_text", venue.alias("venue_name"), "price_text")


def votes(c: Column) -> Column:
    """A count that is labelled as votes, never a stray number."""
    tries = [r"(?is)(\d+)\s*(?:votes?|upvotes?)\b", r"(?is)\bvotes?\s*[:=]\s*(\d+)", r"""(?is)data-votes\s*=\s*["'](\d+)["']"""]
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")).try_cast("int") for p in tries])


def cards(docs: DataFrame, opening: str, fields: dict[str, str], base: str = "", cap: int = 80) -> DataFrame:
    """One row for each card; ``fields`` has a pattern with one group for each column. Cards without a title or a link go,
    and so do later cards of a link."""
    rows = blocks(docs, opening)
    out = rows.select("doc_id", "pos", href(F.col("block"), base).alias("url"), *[group1(F.col("block"), p).alias(name) for name, p in fields.items()], votes(F.col("block")).alias("votes"))
    return capped(first_seen(out.where("title is not null and url is not null"), "url"), cap)


def schema_org(docs: DataFrame, base: str = "", cap: int = 60) -> DataFrame:
    """Blocks of items typed as events: title, start_text (needed), venue_name, url; a link and date once."""
    prop = lambda b, p: F.coalesce(group1(b, rf"""(?is)itemprop\s*=\s*["']{p}["'][^>]*content\s*=\s*["']([^"']+)["']"""), group1(b, rf"""(?is)itemprop\s*=\s*["']{p}["'][^>]*>(.*?)<"""))
    rows = blocks(docs, r"""<[a-z]+\b[^>]*itemtype\s*=\s*["']https?://schema\.org/[A-Za-z]*Event["']""")
    b = F.col("block")
    out = rows.select("doc_id", "pos", href(b, base).alias("url"), prop(b, "name").alias("title"), prop(b, "startDate").alias("start_text"), prop(b, "location").alias("venue_name"))
    return capped(first_seen(out.where("title is not null and start_text is not null"), "url", "start_text"), cap)




def _rows(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields.items()]))


_S, _D = T.StringType(), T.DoubleType()
_EVENT = _rows(name=_S, start=_S, end=_S, url=_S, venue=_S, lat=_D, lon=_D, organizer=_S)


def _named(x) -> str | None:
    x = x[0] if isinstance(x, list) and x else x
    return x.get("name") if isinstance(x, dict) else x if isinstance(x, str) else None


def _number(x) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def _objects_in(value, keys: tuple[str, ...] | None = None):
    """All objects in a JSON value, an outer one before its inner ones, in order; below objects only under ``keys`` if given."""
    todo = [value]
    while todo:
        value = todo.pop()
        if isinstance(value, list):
            todo.extend(reversed(value))
        elif isinstance(value, dict):
            yield value
            todo.extend(reversed([value[k] for k in keys if k in value] if keys else list(value.values())))


def _events_in(value):
    for o in _objects_in(value, ("itemListElement", "@graph", "item")):
        kind = o.get("@type")
        if any(isinstance(k, str) and k.endswith("Event") for k in (kind if isinstance(kind, list) else [kind])):
            place = o.get("location")
            place = place[0] if isinstance(place, list) and place else place
            place = place if isinstance(place, dict) and place.get("@type") != "VirtualLocation" else {}
            geo = place.get("geo") if isinstance(place.get("geo"), dict) else {}
            yield {"name": _named(o), "start": o.get("startDate"), "end": o.get("endDate"), "url": o.get("url"), "venue": place.get("name"), "lat": _number(geo.get("latitude")), "lon": _number(geo.get("longitude")), "organizer": _named(o.get("organizer"))}


@pandas_udf(_EVENT)
def ldjson_events(scripts: pd.Series) -> pd.Series:
    def one(items) -> list[dict]:
        out = []
        for s in items if items is not None else []:
            try:
                out += [{k: v if v is None or isinstance(v, float) else str(v) for k, v in e.items()} for e in _events_in(json.loads(html.unescape(s) if "&quot;" in s else s))]
            except (ValueError, RecursionError):
                continue
        return out

    return scripts.map(one)


def json_ld(docs: DataFrame, url_part: str = "/e/", cap: int = 60) -> DataFrame:
    """Events of JSON-LD scripts with an event link (its query dropped) and a place: coordinates or a venue."""
    scripts = F.regexp_extract_all("body", F.lit(r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1)
    rows = docs.select("doc_id", F.posexplode(ldjson_events(scripts)).alias("pos", "e")).select("doc_id", "pos", "e.*")
    good = rows.where(F.col("url").contains(url_part) & F.col("name").isNotNull() & (F.col("venue").isNotNull() | (F.col("lat").isNotNull() & F.col("lon").isNotNull())))
    return capped(first_seen(good.withColumn("url", text.drop_query(F.col("url"))), "url"), cap)


def _hits(value):
    for o in _objects_in(value):
        name = o.get("name") or o.get("title")
        start = o.get("start_at") or o.get("startDate") or o.get("start")
        url = o.get("url") or o.get("slug")
        if all(isinstance(x, str) and x for x in (name, start, url)):
            yield {"name": name, "start": start, "url": url}


@pandas_udf(_rows(name=_S, start=_S, url=_S))
def state_events(scripts: pd.Series) -> pd.Series:
    def one(items) -> list[dict]:
        out = []
        for s in items if items is not None else []:
            try:
                out += list(_hits(json.loads(s)))
            except (ValueError, RecursionError):
                continue
        return out

    return scripts.map(one)


def embedded_state(docs: DataFrame, base: str, cap: int = 50) -> DataFrame:
    """Objects with a name, a start and a link anywhere in a page's embedded JSON state; the first of each link."""
    scripts = F.regexp_extract_all("body", F.lit(r"""(?is)<script\b[^>]*(?:id\s*=\s*["']__NEXT_DATA__["']|type\s*=\s*["']application/json["'])[^>]*>(.*?)</script>"""), 1)
    rows = docs.select("doc_id", F.posexplode(state_events(scripts)).alias("pos", "e")).select("doc_id", "pos", F.col("e.name").alias("title"), F.col("e.start").alias("start_text"), F.col("e.url").alias("u"))
    url = F.when(F.col("u").rlike("^https?://"), F.col("u")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace("u", "^/+", "")))
    return capped(first_seen(rows.withColumn("url", url).drop("u"), "url"), cap)


_ANCHOR = re.compile(r"""<a\b[^>]*href\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>""", re.IGNORECASE | re.DOTALL)


#: Characters of pages in a slice of an Arrow batch, and rows in a batch of links: what a task's Python holds.
SLICE, LINKS = 1 << 20, 1_000


def _slices(batch: pa.RecordBatch, sizes: pa.Array) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``SLICE`` in all, one row at least."""
    first = held = 0
    for k, size in enumerate(sizes.to_pylist()):
        if k > first and held + (size or 0) > SLICE:
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += size or 0
    if first < batch.num_rows:
        yield batch.slice(first)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for part in _slices(batch, pc.binary_length(batch.column(1))):
            for doc_id, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for pos, m in enumerate(_ANCHOR.finditer(body or "")):
                    yield {"doc_id": doc_id, "pos": pos, "url": m.group(1), "label": m.group(2), "context": body[max(0, m.start() - 200) : m.end() + 300]}


def link_batches(batches: Iterator[pa.RecordBatch], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, body) -> batches of at most ``LINKS`` links, however many a batch of pages has."""
    rows = _links(batches)
    while some := list(islice(rows, LINKS)):
        yield pa.RecordBatch.from_pylist(some, kind)


def anchor_contexts(docs: DataFrame) -> DataFrame:
    """doc_id, pos, url, label and context of each link: the text from 200 characters before it to 300 behind."""
    kind = T.StructType([docs.schema["doc_id"], T.StructField("pos", T.IntegerType()), *[T.StructField(c, _S) for c in ("url", "label", "context")]])
    arrow = to_arrow_schema(kind)
    return docs.select("doc_id", "body").mapInArrow(lambda batches: link_batches(batches, arrow), kind)


def anchors(docs: DataFrame, stop_words: list[str], least: int = 5) -> DataFrame:
    """All links with a label that is no navigation, the first of each URL in a document, and fields of the text around them."""
    out = anchor_contexts(docs).select("doc_id", "pos", "url", text.strip_tags(F.col("label")).alias("title"), text.strip_tags(F.col("context")).alias("context"))
    out = out.where((F.length("title") >= least) & ~F.lower("title").isin([s.lower() for s in stop_words]))
    return first_seen(context_fields(out), "url")


def context_fields(rows: DataFrame) -> DataFrame:
    c = F.col("context")
    pick = lambda p: F.nullif(F.trim(F.regexp_extract(c, p, 1)), F.lit(""))
    return rows.withColumns(
        {
            "when_text": pick(r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.? \d{1,2}(?:, \d{4})?)"),
            "attendees": pick(r"\+\s?(\d+)\b").try_cast("int"),
            "venue_name": pick(r"@ ([^,|\n]{2,80})"),
            "organizer": pick(r"\bBy ([A-Z][^,|\n]{1,80})"),
        }
    )


def headings(docs: DataFrame, stop_words: list[str], low: int = 10, high: int = 150, cap: int = 50) -> DataFrame:
    """Headings of levels 2 to 4 of middling length; the first of those that begin alike."""
    rows = docs.select("doc_id", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<h[2-4]\b[^>]*>(.*?)</h[2-4]>"), 1)).alias("pos", "h"))
    out = rows.select("doc_id", "pos", text.strip_tags(F.col("h")).alias("title")).where(F.length("title").between(low, high) & ~F.lower("title").isin([s.lower() for s in stop_words]))
    return capped(first_seen(out.withColumn("__k", F.lower(F.substring("title", 1, 60))), "__k").drop("__k"), cap)


def with_fallback(rows: DataFrame, fallback: DataFrame, fewer_than: int = 1) -> DataFrame:
    """rows, and of documents with fewer than that many, the fallback's rows too."""
    enough = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") >= fewer_than).select("doc_id")
    return rows.unionByName(fallback.join(enough, "doc_id", "left_anti"), allowMissingColumns=True)


def heading_sections(docs: DataFrame, cap: int = 50) -> DataFrame:
    """Text from one heading to the next, with a link in either."""
    rows = blocks(docs, r"<h[2-4]\b")
    b = F.col("block")
    head = r"(?is)^<h[2-4]\b[^>]*>(.*?)</h[2-4]>"
    out = rows.select("doc_id", "pos", group1(b, head).alias("title"), href(b).alias("url"), text.strip_tags(F.regexp_replace(b, head, " ")).alias("blurb"))
    return capped(out.where("title is not null and url is not null"), cap)


def text_blocks(docs: DataFrame, cap: int = 50) -> DataFrame:
    """Blocks of plain text between blank lines, of two lines or more, with a URL: first line as title, bare URLs left out."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.replace("body", F.lit("\r\n"), F.lit("\n")), r"\n\s*\n")).alias("pos", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rest = F.filter(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), lambda x: ~x.rlike(r"^https?://\S+$"))
    out = rows.withColumn("lines", lines).where((F.size("lines") >= 2) & F.col("block").rlike(r"https?://\S+"))
    return capped(out.select("doc_id", "pos", F.get("lines", F.lit(0)).alias("title"), F.regexp_extract("block", r"(https?://[^\s>)\]]+)", 1).alias("url"), F.array_join(rest, " ").alias("blurb")), cap)


def visible_lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line: what a reader sees, line by line."""
    bare = F.regexp_replace(F.regexp_replace("body", VISIBLE, "\n"), r"(?s)<[^>]+>", "\n")
    # no reference spans lines, so that Python sees single lines, and of these the ones that may hold one
    rows = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace(bare, LINE_FEED, "\n"), "\n")).alias("pos", "line")).where(F.col("line").rlike(r"\S"))
    plain = F.coalesce(unescape(F.when(F.contains("line", F.lit("&")), F.col("line"))), F.col("line"))
    return rows.withColumn("line", text.collapse(plain)).where("line <> ''")


def dated_segments(lines: DataFrame, date_pattern: str, drop_pattern: str | None = None) -> DataFrame:
    """lines(doc_id, pos, line) -> doc_id, pos, date_text, body: each line that is a date, with the lines up to the next."""
    rows = lines if drop_pattern is None else lines.where(~F.col("line").rlike(drop_pattern))
    is_date = F.col("line").rlike(date_pattern)
    segment = F.sum(is_date.cast("int")).over(Window.partitionBy("doc_id").orderBy("pos"))
    marked = rows.withColumn("__d", is_date).withColumn("__s", segment).where("__s > 0")
    grouped = marked.groupBy("doc_id", "__s").agg(F.min("pos").alias("pos"), F.max(F.when(F.col("__d"), F.col("line"))).alias("date_text"), F.array_sort(F.collect_list(F.when(~F.col("__d"), F.struct("pos", "line")))).alias("x"))
    return grouped.select("doc_id", "pos", "date_text", F.transform("x", lambda r: r["line"]).alias("body")).where(F.size("body") > 0)


# Fixed values of dated cards: lines of a card that may tell its time, other acts, and lines that are no part of one.
CARD_LINES = 2
OTHER_ACTS = r"(?i)^(?:with|featuring)\s+(.+)"
NO_CARD = r"(?i)^(?:lottery|sold out|table sales|on sale)"


def dated_cards(lines: DataFrame, year: Column) -> DataFrame:
    """lines(doc_id, pos, line) -> doc_id, pos, day, title, time_text, other_acts: the cards between lines such as 'Sunday,
    June 14'. A line whose weekday is not that of its day in the year begins a card that is dropped; the time is looked for
    in a card's first ``CARD_LINES`` lines only, as the last card runs to the end of the page."""
    dated = rf"(?i)^(?:{'|'.join(text.WEEKDAYS)}),\s*[a-z]+\s+\d{{1,2}}\b"
    cards = dated_segments(lines, dated, NO_CARD).withColumn("day", timex.date_line(F.col("date_text"), year)).where("day is not null")
    own = F.array_join(F.slice("body", 1, CARD_LINES), "\n")
    time_text = F.nullif(F.regexp_extract(own, r"(?i)\b\d{1,2}(?::\d{2})?\s*(?:am|pm)\b", 0), F.lit(""))
    acts = F.filter(F.transform(F.slice("body", 2, 1 << 30), lambda x: F.regexp_extract(x, OTHER_ACTS, 1)), lambda x: x != "")
    return cards.select("doc_id", "pos", "day", F.get("body", F.lit(0)).alias("title"), time_text.alias("time_text"), F.get(acts, F.lit(0)).alias("other_acts"))


def br_cells(docs: DataFrame, opening: str, cell: str) -> DataFrame:
    """Blocks with the parts of one cell between line breaks."""
    rows = blocks(docs, opening)
    parts = F.transform(F.split(F.regexp_extract("block", cell, 1), r"(?i)<br\s*/?>"), text.strip_tags)
    return rows.select("doc_id", "pos", href(F.col("block")).alias("url"), F.filter(parts, lambda x: x != "").alias("parts")).where(F.size("parts") > 0)


def title_range_scan(docs: DataFrame, cap: int = 40) -> DataFrame:
    """Lines of a title, a date range and a place."""
    p = r"(?m)^(.{3,120}?)\s*\n\s*([A-Z][a-z]{2} \d{1,2}\s*[–-]\s*(?:[A-Z][a-z]{2} )?\d{1,2}(?:, \d{4})?)\s*\n\s*(.{2,120})$"
    g = [F.regexp_extract_all("body", F.lit(p), i) for i in (1, 2, 3)]
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip(*[x.alias(n) for x, n in zip(g, ("title", "when_text", "venue_name"), strict=True)])).alias("pos", "z"))
    return capped(rows.select("doc_id", "pos", "z.*"), cap)


def is_event_url(url: Column, nav: list[str]) -> Column:
    """One path segment that is no number, no ``wp-`` and no navigation."""
    slug = F.lower(F.regexp_extract(url, r"^https?://[^/]+/([^/?#]+)/?(?:[?#].*)?$", 1))
    return (slug != "") & ~slug.rlike(r"^\d+$") & ~slug.startswith("wp-") & ~slug.isin(nav)


def page_fields(docs: DataFrame) -> DataFrame:
    """doc_id, title, h1, n_links, body text of whole pages."""
    bare = F.regexp_replace("body", VISIBLE, " ")
    return docs.select(
        "doc_id", group1(F.col("body"), r"(?is)<title[^>]*>(.*?)</title>").alias("title"), group1(F.col("body"), r"(?is)<h1[^>]*>(.*?)</h1>").alias("h1"), F.size(F.regexp_extract_all("body", F.lit(r"""(?i)<a\b[^>]*href"""), 0)).alias("n_links"), text.strip_tags(bare).alias("text")
    )
