"""Queries by name, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, money, text, timex
from ..operators import digest, geocode, health, itinerary, layout, profile, quality, rank, resolve, scratch, search, social, tables, textindex
from ..schema import CANON
from ..sources import markup, payloads
from ..streaming import jobs
from .bindings import AS_OF, CANON_SQL, INTEREST_SQL, RUNS_SQL, SIGNALS_SQL, VIBES, as_of, canon_events, source_runs, table, user_signals, users

NOW = datetime.fromisoformat(AS_OF)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
def _dist(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Metres on the ellipsoid, as in functions.geo."""
    b1, b2 = (f"atan({1 - geo.FLAT!r}::DOUBLE * tan(radians({x})))" for x in (lat1, lat2))
    h = f"least(pow(sin(({b2} - {b1}) / 2), 2) + cos({b1}) * cos({b2}) * pow(sin(radians({lon2} - {lon1}) / 2), 2), 1.0::DOUBLE)"
    a = f"(2 * asin(sqrt({h})))"
    x = f"({a} - sin({a})) * pow(sin(({b1} + {b2}) / 2) * cos(({b2} - {b1}) / 2), 2) / (1 - {h})"
    y = f"({a} + sin({a})) * pow(cos(({b1} + {b2}) / 2) * sin(({b2} - {b1}) / 2), 2) / {h}"
    return f"CASE WHEN {h} = 0 THEN 0.0::DOUBLE ELSE {geo.EARTH_M!r}::DOUBLE * ({a} - {geo.FLAT / 2!r}::DOUBLE * ({x} + {y})) END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""
    WITH {CANON_SQL}, {SIGNALS_SQL}, {INTEREST_SQL},
    near AS (SELECT *, {_dist("lat", "lon", "37.7749::DOUBLE", "-122.4194::DOUBLE")} AS m FROM canon WHERE start_at >= TIMESTAMP '{AS_OF}')
    SELECT id, title, venue_name, round_even(m / 1609.34, 2) AS distance_miles, coalesce(people_interested, 0) AS people_interested
    FROM (SELECT * FROM near WHERE m <= 2 * 1609.34 AND location_confidence >= 0.5 ORDER BY m, id LIMIT 200) LEFT JOIN pop ON event_id = id
""")
def search_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of upcoming events within two miles, nearest first: a top-k report."""
    page = search.search(canon_events(spark, sf_dir), NOW, user_signals(spark, sf_dir), lat=37.7749, lng=-122.4194, radius_miles=2.0, sort_by="distance", limit=200)
    return page.select("id", "title", "venue_name", "distance_miles", "people_interested")


@query(f"""
    WITH {CANON_SQL}
    SELECT id, title, start_at FROM canon
    WHERE start_at >= TIMESTAMP '2024-02-01 19:00:00' AND start_at >= TIMESTAMP '2024-02-03 01:00:00' AND start_at <= TIMESTAMP '2024-02-05 14:00:00' AND list_contains(tags, '#red')
    ORDER BY start_at, id LIMIT 100
""")
def search_by_preset_and_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(canon_events(spark, sf_dir), NOW, time_preset="this_weekend", vibe_tag="#red", limit=100).select("id", "title", "start_at")


@query(f"""
    WITH {CANON_SQL}
    SELECT id, title FROM canon WHERE start_at >= TIMESTAMP '2024-02-10 00:00:00' AND start_at <= TIMESTAMP '2024-03-10 00:00:00'
      AND status = 'scheduled' AND list_contains(string_split(lower(concat_ws(' ', title, description)), ' '), 'red') ORDER BY start_at, id LIMIT 200 OFFSET 3
""")
def search_by_text_and_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(canon_events(spark, sf_dir), NOW, q="red", start_at=datetime(2024, 2, 10), end_at=datetime(2024, 3, 10), status="scheduled", include_past=True, limit=200, offset=3).select("id", "title")


@query(f"WITH {CANON_SQL} SELECT id FROM canon WHERE venue_name ILIKE '%00007%' OR raw_address ILIKE '%00007%' OR title ILIKE '%00007%'")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon_events(spark, sf_dir).where(search.keyword("00007")).select("id")


@query(f"WITH {CANON_SQL} SELECT id, categories[1] AS category FROM canon WHERE len(list_filter(categories, lambda c: contains(lower(c), 'eco'))) > 0")
def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon_events(spark, sf_dir).where(search.in_category("Eco")).select("id", F.get("categories", F.lit(0)).alias("category"))


@query(SQL["search_by_distance"])
def search_laid_out_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same page from the events sorted along a space-filling curve: the scan reads the ranges around the point."""
    path = scratch.folder(spark, "placed")
    layout.by_place(canon_events(spark, sf_dir)).write.parquet(path)
    page = search.search(spark.read.parquet(path), NOW, user_signals(spark, sf_dir), lat=37.7749, lng=-122.4194, radius_miles=2.0, sort_by="distance", limit=200)
    return page.select("id", "title", "venue_name", "distance_miles", "people_interested")


_ASKED = ", ".join(f"('{v[1:]}')" for v in VIBES)


@query(f"""
    WITH {CANON_SQL}, q AS (SELECT * FROM (VALUES {_ASKED}) AS t(word))
    SELECT word, id FROM canon JOIN q ON list_contains(string_split(lower(concat_ws(' ', title, description)), ' '), word)
""")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that hold each of some words, from a stored index in whose second batch all texts are replaced."""
    index = textindex.TextIndex(spark, scratch.folder(spark, "index"))
    ev = canon_events(spark, sf_dir)
    index.add(ev.select("id", F.col("venue_name").alias("body")), 0)
    index.add(ev.select("id", textindex.body(ev).alias("body")), 1)
    asked = spark.createDataFrame([(v[1:], v[1:]) for v in VIBES], "query_id string, query string")
    return index.lookup_each(asked).select(F.col("query_id").alias("word"), "id")


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(f"""
    WITH w AS (SELECT doc_id, unnest(list_distinct(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'))) AS word FROM documents)
    SELECT word, count(*) AS docs FROM w WHERE word <> '' AND word NOT IN ({_STOP}) GROUP BY word
""")
def text_index_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents before stemming, by document frequency."""
    words = table(spark, sf_dir, "documents").select(F.explode(text.terms(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("docs"))


@query()
def text_index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index of the documents by English stems, by document frequency."""
    return search.inverted_index(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("docs"))


@query(f"WITH np AS (SELECT count(*) AS n FROM part), {SIGNALS_SQL}, {INTEREST_SQL} SELECT * FROM pop")
def people_interested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.people_interested(user_signals(spark, sf_dir))


_PROFILE_SQL = f"""
    tagged AS (SELECT user_id, weight * pow(0.5, greatest(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(sig.created_at), 0) / 86400e6 / 30.0) AS w, CASE WHEN vibe_tag IS NOT NULL THEN [vibe_tag] ELSE list_distinct(tags) END AS ts FROM sig LEFT JOIN canon ON id = sig.event_id),
    prof AS (SELECT user_id, lower(t) AS tag, sum(w) AS score FROM (SELECT user_id, w, unnest(ts) AS t FROM tagged WHERE w > 0) GROUP BY ALL)"""


@query(f"WITH {CANON_SQL}, {SIGNALS_SQL}, {_PROFILE_SQL} SELECT user_id, tag, round(score, 6) AS score FROM prof")
def decayed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profiles(user_signals(spark, sf_dir), canon_events(spark, sf_dir), as_of()).withColumn("score", F.round("score", 6))


_VIBES = ", ".join(f"'{v}'" for v in VIBES)
_SCORED_SQL = f"""
    usr AS (SELECT DISTINCT user_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE [{_VIBES}][user_id % 8 + 1] END AS vibe FROM events),
    tag AS (SELECT DISTINCT id, unnest(tags) AS t FROM canon WHERE start_at >= TIMESTAMP '{AS_OF}'),
    hit AS (SELECT p.user_id, tag.id, sum(p.score) AS w FROM prof p JOIN tag ON tag.t = p.tag GROUP BY ALL),
    lik AS (SELECT u.user_id, tag.id, count(*) AS n FROM usr u JOIN tag ON tag.t = u.vibe GROUP BY ALL),
    act AS (SELECT user_id FROM usr WHERE vibe IS NOT NULL UNION SELECT user_id FROM prof),
    raw AS (
        SELECT a.user_id, c.id, c.start_at, c.categories[1] AS cat, coalesce(lik.n, 0) AS n, coalesce(hit.w, 0.0) AS w, least(coalesce(people_interested, 0) * 10.0, 100.0) AS pop,
               CASE WHEN age <= 24 THEN 100.0 WHEN age <= 48 THEN 75.0 WHEN age <= 168 THEN 50.0 ELSE 25.0 END AS fresh
        FROM act a CROSS JOIN (SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 3600e6 AS age FROM canon WHERE start_at >= TIMESTAMP '{AS_OF}') c
        LEFT JOIN hit ON hit.user_id = a.user_id AND hit.id = c.id LEFT JOIN lik ON lik.user_id = a.user_id AND lik.id = c.id LEFT JOIN pop ON pop.event_id = c.id
    ),
    tot AS (SELECT *, CASE WHEN n = 0 AND w <= 0 THEN 0.0 ELSE least(n * 100.0 + w * 10.0, 100.0) END AS vibe FROM raw),
    tot2 AS (SELECT *, round(vibe * 0.5 + pop * 0.25 + fresh * 0.15 + 10.0, 9) AS total FROM tot),
    pen AS (SELECT *, total - CASE WHEN cat = lag(cat) OVER (PARTITION BY user_id ORDER BY total DESC, start_at, id) THEN 10.0 ELSE 0.0 END AS final FROM tot2)"""


@query(f"""
    WITH {CANON_SQL}, {SIGNALS_SQL}, {INTEREST_SQL}, {_PROFILE_SQL}, {_SCORED_SQL}
    SELECT user_id, id, rank, CAST(round_even(final, 0) AS INT) AS match_score, round(final, 4) AS total_score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY final DESC, start_at, id) AS rank FROM pen WHERE vibe > 0) WHERE rank <= 25
""")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 25 events of each user, exact: the penalty sees every upcoming event."""
    rows = rank.recommend(canon_events(spark, sf_dir), users(spark, sf_dir), user_signals(spark, sf_dir), as_of(), limit=25)
    return rows.select("user_id", "id", F.col("rank").cast("long").alias("rank"), "match_score", F.round("total_score", 4).alias("total_score"))


@query(f"""
    WITH {CANON_SQL}, {SIGNALS_SQL}, {INTEREST_SQL}
    SELECT id, CAST(least(coalesce(people_interested, 0) * 10.0, 100.0) + CASE WHEN age <= 24 THEN 100.0 WHEN age <= 48 THEN 75.0 WHEN age <= 168 THEN 50.0 ELSE 25.0 END AS DOUBLE) AS total_score
    FROM (SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 3600e6 AS age FROM canon) LEFT JOIN pop ON event_id = id
""")
def rank_without_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rank_without_user(canon_events(spark, sf_dir), search.people_interested(user_signals(spark, sf_dir)), as_of()).select("id", "total_score")


@query(f"""
    WITH {CANON_SQL},
    pairs AS (
        SELECT a.id AS anchor_id, b.id AS id, {_dist("b.lat", "b.lon", "a.lat", "a.lon")} AS m, a.start_at AS a_start, b.start_at AS b_start
        FROM canon a JOIN canon b ON b.id <> a.id AND b.source_tier >= 3 AND CAST(a.start_at AS DATE) = CAST(b.start_at AS DATE) WHERE a.source_tier <= 2
    ),
    near AS (SELECT *, min(m) OVER (PARTITION BY anchor_id) AS least_m FROM pairs WHERE m <= 1609.34)
    SELECT anchor_id, count(*) AS n, min(id) AS first_id FROM near WHERE m <= 804.67 OR least_m > 804.67 GROUP BY anchor_id
""")
def supports_near_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every trusted event, the supporting events of its day within half a mile, or else within one."""
    ev = canon_events(spark, sf_dir)
    day = F.date_trunc("day", "start_at")
    chosen = ev.where("source_tier <= 2").withColumns({"request_id": F.col("id"), "window_start": day, "window_end": day + F.expr("INTERVAL '1' DAY") - F.expr("INTERVAL '0.000001' SECOND")})
    near = itinerary.supports(chosen, ev, limit=None)
    return near.groupBy(F.col("request_id").alias("anchor_id")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' turns of conversations as prompts, some of them with keywords added."""
    added = F.array(*[F.lit(x) for x in ("date night tonight in sf", "bar crawl this weekend", "visiting guests tomorrow", "something on sunday", "", "anything in oakland")])
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    key = F.col("conv_id") * 1000 + F.col("turn")
    prompt = F.concat_ws(" ", "text", F.get(added, (F.col("conv_id") % 6).cast("int")))
    return rows.select(key.alias("request_id"), (F.col("conv_id") % 150).alias("user_id"), prompt.alias("prompt"))


@query("""
    WITH p AS (SELECT conv_id * 1000 + turn AS request_id, lower(trim(concat_ws(' ', text, ['date night tonight in sf', 'bar crawl this weekend', 'visiting guests tomorrow', 'something on sunday', '', 'anything in oakland'][conv_id % 6 + 1]))) AS x FROM conversations WHERE role = 'user')
    SELECT request_id,
        CASE WHEN contains(x, 'date night') THEN 'date_night' WHEN contains(x, 'out-of-town') OR contains(x, 'visiting') OR contains(x, 'guests') THEN 'out_of_town_guests' WHEN contains(x, 'bar crawl') THEN 'bar_crawl' ELSE 'general_night_out' END AS intent,
        CASE WHEN contains(x, 'oakland') THEN 'oakland' WHEN contains(x, 'san francisco') THEN 'san francisco' WHEN contains(x, 'sf') THEN 'sf' WHEN contains(x, 'berkeley') THEN 'berkeley' WHEN contains(x, 'mission') THEN 'mission' WHEN contains(x, 'soma') THEN 'soma' WHEN contains(x, 'south bay') THEN 'south bay' WHEN contains(x, 'san jose') THEN 'san jose' END AS geography,
        CASE WHEN contains(x, 'tonight') THEN 'tonight' WHEN contains(x, 'tomorrow') THEN 'tomorrow' WHEN contains(x, 'monday') THEN 'this_monday' WHEN contains(x, 'tuesday') THEN 'this_tuesday' WHEN contains(x, 'wednesday') THEN 'this_wednesday' WHEN contains(x, 'thursday') THEN 'this_thursday' WHEN contains(x, 'friday') THEN 'this_friday' WHEN contains(x, 'saturday') THEN 'this_saturday' WHEN contains(x, 'sunday') THEN 'this_sunday' WHEN contains(x, 'this weekend') THEN 'this_weekend' ELSE 'upcoming_week' END AS label
    FROM p
""")
def prompt_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itinerary.parse_intents(_requests(spark, sf_dir), as_of()).select("request_id", "intent", "geography", "label")


@query()
def itineraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned stops of every prompt, with links."""
    ev, sig = canon_events(spark, sf_dir), user_signals(spark, sf_dir)
    req = _requests(spark, sf_dir)
    prof = profile.profiles(sig, ev, as_of())
    likes = req.join(users(spark, sf_dir), "user_id").select("request_id", F.explode("preferred_vibes").alias("tag"))
    stops = itinerary.plan(req, ev, prof, likes, search.people_interested(sig), as_of())
    return itinerary.enrich(stops).select("request_id", "stop_no", "kind", "event_id", "map_url", "directions_url")


@query(f"""
    WITH {RUNS_SQL},
    h AS (SELECT *, coalesce(avg(n) OVER (PARTITION BY source_name ORDER BY run_at ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0.0) AS historic_avg, count_if(n > 0) OVER (PARTITION BY source_name ORDER BY run_at ROWS UNBOUNDED PRECEDING) AS isl FROM runs),
    z AS (SELECT *, count_if(n = 0) OVER (PARTITION BY source_name, isl ORDER BY run_at ROWS UNBOUNDED PRECEDING) AS consecutive_zeros FROM h)
    SELECT source_name, run_at, n, historic_avg, consecutive_zeros, CASE WHEN consecutive_zeros = 0 THEN 'healthy' WHEN consecutive_zeros = 1 THEN 'degraded' ELSE 'failing' END AS status, historic_avg > 10 AND n = 0 AS alert FROM z
""")
def source_run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.run_health(source_runs(spark, sf_dir))


@query(f"""
    WITH {RUNS_SQL}, d AS (SELECT source_name, strftime(run_at, '%Y-%m-%d') AS day, CAST(sum(n) AS BIGINT) AS n FROM runs GROUP BY ALL)
    SELECT source_name, day, n, round(baseline, 9) AS baseline, coalesce(n < 0.8 * baseline, false) AS alert FROM (SELECT *, avg(n) OVER (PARTITION BY source_name ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS baseline FROM d)
""")
def baseline_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = source_runs(spark, sf_dir).groupBy("source_name", F.date_format("run_at", "yyyy-MM-dd").alias("day")).agg(F.sum("n").alias("n"))
    return health.baseline_drop(daily).withColumn("baseline", F.round("baseline", 9))


@query("""
    WITH RECURSIVE r AS (SELECT user_id AS key, ts AS "at", event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s AS (
        SELECT key, "at", event_id, n, true AS admitted, ["at"] AS live FROM r WHERE n = 1
        UNION ALL
        SELECT key, "at", event_id, n, len(before) < 5, CASE WHEN len(before) < 5 THEN list_append(before, "at") ELSE before END
        FROM (SELECT r.*, list_filter(s.live, lambda t: t > r."at" - INTERVAL 1 HOUR) AS before FROM s JOIN r ON r.key = s.key AND r.n = s.n + 1)
    )
    SELECT key, "at", event_id, admitted FROM s
""")
def admitted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user under a limit of five admitted ones an hour."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), "event_id")
    return health.throttle(rows, 5, 3600.0)


@query(f"""
    WITH {CANON_SQL}, v AS (SELECT event_id % np.n AS item_id, user_id, arg_max(value, (ts, event_id)) AS value FROM events, np GROUP BY ALL)
    SELECT id % 20 AS folder_id, id AS item_id, title, coalesce(s, 0) AS vote_score FROM canon LEFT JOIN (SELECT item_id, CAST(sum(CASE WHEN value >= 10 THEN 1 ELSE -1 END) AS BIGINT) AS s FROM v GROUP BY item_id) ON item_id = id
""")
def folder_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.broadcast(table(spark, sf_dir, "part").agg(F.count("*").alias("n_items")))
    log = table(spark, sf_dir, "events").crossJoin(items).select((F.col("event_id") % F.col("n_items")).alias("item_id"), "user_id", F.when(F.col("value") >= 10, 1).otherwise(-1).alias("value"), F.struct("ts", "event_id").alias("at"))
    ev = canon_events(spark, sf_dir)
    items = ev.select((F.col("id") % 20).alias("folder_id"), F.col("id").alias("item_id"), F.col("id").alias("event_id"))
    return social.board(items, ev, social.current_votes(log)).select("folder_id", "item_id", "title", "vote_score")


@query("""
    WITH f AS (SELECT o_orderkey AS folder_id, o_custkey AS owner_id FROM orders), m AS (SELECT l_orderkey AS folder_id, l_suppkey AS user_id FROM lineitem)
    SELECT DISTINCT user_id, folder_id FROM (SELECT owner_id AS user_id, folder_id FROM f UNION ALL SELECT user_id, folder_id FROM m WHERE folder_id IN (SELECT folder_id FROM f))
""")
def visible_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as folders of customers, line items as members."""
    folders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("folder_id"), F.col("o_custkey").alias("owner_id"))
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("folder_id"), F.col("l_suppkey").alias("user_id"))
    return social.visible(folders, members)


@query(f"""
    WITH {CANON_SQL} SELECT id, CASE WHEN coalesce(end_at, start_at) + INTERVAL 24 HOUR < TIMESTAMP '2024-02-20 00:00:00' THEN 'past' ELSE status END AS status FROM canon
""")
def mark_past(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.mark_past(canon_events(spark, sf_dir), F.lit("2024-02-20 00:00:00").cast("timestamp")).select("id", "status")


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = canon_events(spark, sf_dir)
    blank = lambda c, n: F.when(F.col("id") % n == 0, " ").otherwise(F.col(c))
    rows = ev.withColumns({"ordinal": F.col("id"), "location": geo.point_wkt(F.col("lat"), F.col("lon")), "title": blank("title", 97), "source_name": blank("source_name", 89), "currency": F.lit(" usdollar "), "image_url": F.lit(None).cast("string"), "organizer_name": F.lit(None).cast("string")})
    return rows.withColumn("location", F.when(F.col("id") % 83 == 0, F.lit(None)).otherwise(F.col("location")))


@query(f"""
    WITH {CANON_SQL} SELECT CASE WHEN id % 97 = 0 THEN 'title' WHEN id % 83 = 0 THEN 'location' WHEN id % 89 = 0 THEN 'source_name' ELSE 'published' END AS reason, count(*) AS n FROM canon GROUP BY ALL
""")
def normalised_and_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = quality.normalize(_payloads(spark, sf_dir))
    return good.select(F.lit("published").alias("reason")).unionByName(bad.select(F.col("reject_reason").alias("reason"))).groupBy("reason").agg(F.count("*").alias("n"))


@query()
def deduplicated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event folded with its duplicates."""
    good, _ = quality.normalize(_payloads(spark, sf_dir))
    return resolve.dedupe(good.select("ordinal", *CANON.fieldNames())).select("ordinal", "title", "start_at", "source_tier", "members")


@query()
def upsert_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event, a quarter of an hour later and with another price, against the stored table of the even ones."""
    good, _ = quality.normalize(_payloads(spark, sf_dir))
    good = good.select("ordinal", *CANON.fieldNames())
    stored = good.where(F.col("ordinal") % 2 == 0).withColumnRenamed("ordinal", "id")
    incoming = good.withColumn("start_at", F.timestamp_seconds(F.unix_seconds("start_at") + 900))
    return resolve.upsert(incoming, stored)[1]


@query(f"""
    WITH {CANON_SQL}
    SELECT row_number() OVER (ORDER BY id % 2, id) AS id, title, description, TIMESTAMP '{AS_OF}' + to_seconds(id * 10800) AS start_at, status FROM canon
""")
def loaded_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table after two batches and a replay: events three hours apart, first the even ones without descriptions,
    then all of them with."""
    ev = canon_events(spark, sf_dir).withColumns({"location": geo.point_wkt(F.col("lat"), F.col("lon")), "start_at": F.timestamp_seconds(F.unix_seconds(as_of()) + F.col("id") * 10800), "end_at": F.lit(None).cast("timestamp"), "ordinal": F.col("id")})
    good, _ = quality.normalize(ev.withColumns({"currency": F.lit("USD"), "image_url": F.lit(None).cast("string"), "organizer_name": F.lit(None).cast("string")}))
    table_ = tables.EventTable(spark, scratch.folder(spark, "stored"), 10_000)
    table_.load(good.where(F.col("ordinal") % 2 == 0).withColumn("description", F.lit(None).cast("string")), "feed", 0)
    table_.load(good, "feed", 1)
    table_.load(good, "feed", 1)
    return table_.read().select("id", "title", "description", "start_at", "status")


@query(f"""
    WITH {CANON_SQL}
    SELECT a.id AS id, count(*) AS same_venue_within_2h FROM canon a JOIN canon b ON a.venue_name = b.venue_name AND a.id <> b.id AND abs(epoch_us(a.start_at) - epoch_us(b.start_at)) <= 7200000000 GROUP BY a.id
""")
def interval_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every event, the number of those at its venue that start within two hours, by a window over their starts."""
    ev = canon_events(spark, sf_dir).select("id", "venue_name", F.unix_micros("start_at").alias("at"))
    near = Window.partitionBy("venue_name").orderBy("at").rangeBetween(-7_200_000_000, 7_200_000_000)
    return ev.withColumn("same_venue_within_2h", F.count("*").over(near) - 1).where("same_venue_within_2h > 0").select("id", "same_venue_within_2h")


@query(f"""
    WITH {CANON_SQL}
    SELECT id, lower(trim(string_split(venue_name, '(')[1])) AS venue_key, regexp_replace(trim(external_url), '/+$', '') AS url_key,
           CASE WHEN is_free THEN 'Free' WHEN price IS NULL THEN 'price TBA' WHEN price = floor(price) THEN '$' || CAST(CAST(price AS BIGINT) AS VARCHAR) ELSE '$' || printf('%.2f', price) END AS price_label,
           least(attendee / 500.0, 1.0) AS popularity, 'POINT(' || lon || ' ' || lat || ')' AS location
    FROM (SELECT *, CAST(id % 50 AS INT) AS attendee FROM canon)
""")
def row_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = canon_events(spark, sf_dir)
    return ev.select("id", text.venue_key(F.col("venue_name")).alias("venue_key"), text.url_key(F.col("external_url")).alias("url_key"), text.price_label(F.col("is_free"), F.col("price")).alias("price_label"), money.popularity_share(F.col("attendee_count"), 500.0).alias("popularity"), geo.point_wkt(F.col("lat"), F.col("lon")).alias("location"))


@query(f"""
    WITH {CANON_SQL},
    -- summer time runs from the second Sunday of March to the first Sunday of November, switching at 10:00 and 09:00 UTC
    y AS (
        SELECT year, m + to_days(CAST((7 - isodow(m)) % 7 + 7 AS INT)) + INTERVAL 10 HOUR AS summer, n + to_days(CAST((7 - isodow(n)) % 7 AS INT)) + INTERVAL 9 HOUR AS winter
        FROM (SELECT year, make_timestamp(year, 3, 1, 0, 0, 0.0) AS m, make_timestamp(year, 11, 1, 0, 0, 0.0) AS n FROM (SELECT DISTINCT year(start_at) AS year FROM canon))
    ),
    l AS (SELECT id, start_at, start_at - CASE WHEN start_at >= summer AND start_at < winter THEN INTERVAL 7 HOUR ELSE INTERVAL 8 HOUR END AS local FROM canon JOIN y ON year = year(start_at))
    SELECT id, extract(hour FROM local) AS local_hour, isodow(local) - 1 AS weekday, start_at + INTERVAL 3 DAY AS expires_at,
           strftime(local, '%a %b %-d ') || lower(strftime(local, '%-I:%M%p')) AS said_when, strftime(local, '%-I:%M %p') AS said_time, strftime(local, '%a, %b %-d') AS said_day
    FROM l
""")
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local hours, weekdays and labels of all starts, over the changes of the clock."""
    at = F.col("start_at")
    local = [timex.local_hour(at).cast("long").alias("local_hour"), F.weekday(F.from_utc_timestamp(at, timex.TZ)).cast("long").alias("weekday"), timex.expires_at(at, F.lit(3)).alias("expires_at")]
    return canon_events(spark, sf_dir).select("id", *local, timex.local_when(at).alias("said_when"), timex.local_clock(at).alias("said_time"), timex.local_day(at).alias("said_day"))


@query("""
    SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y-%m-%d') || ' 20:30', '%Y-%m-%d %H:%M') AS local_start, month(o_orderdate) AS month FROM orders
""")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written as listings write them, and parsed back to local wall-clock time."""
    rows = table(spark, sf_dir, "orders")
    written = F.concat(F.date_format("o_orderdate", "MMM d, yyyy"), F.lit(" 8:30 PM"))
    instant = timex.flexible_datetime(written, F.lit("2024-01-01").cast("date"))
    return rows.select("o_orderkey", F.from_utc_timestamp(instant, timex.TZ).alias("local_start"), F.month("o_orderdate").cast("long").alias("month"))


@query("""
    WITH g AS (SELECT p_name AS title, count(*) AS n FROM part GROUP BY p_name) SELECT a.title AS a, b.title AS b, a.n * b.n AS pairs FROM g a JOIN g b ON a.title < b.title AND levenshtein(a.title, b.title) <= 3
""")
def near_titles_by_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct titles at most three edits apart: the native prefilter of title similarity."""
    g = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("title")).agg(F.count("*").alias("n"))
    # an equi-key: titles this near share a length class, or a neighbouring one
    band = F.floor(F.length("title") / 4)
    left = g.select(F.col("title").alias("a"), F.col("n").alias("na"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    right = g.select(F.col("title").alias("b"), F.col("n").alias("nb"), band.alias("band"))
    return left.join(right, "band").where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b") <= 3)).select("a", "b", (F.col("na") * F.col("nb")).alias("pairs"))


@query("""
    WITH RECURSIVE t AS (SELECT DISTINCT p_type AS session, lower(trim(p_name)) AS t FROM part),
    p AS (SELECT DISTINCT x.t AS a, y.t AS b FROM t x JOIN t y ON x.session = y.session AND x.t < y.t AND x.t <> ''),
    -- common subsequences of the first i characters of a with each beginning of b
    c AS (
        SELECT a, b, 0 AS i, list_transform(range(len(b) + 1), lambda k: 0) AS d FROM p
        UNION ALL
        SELECT a, b, i + 1, list_prepend(0, list_transform(range(1, len(b) + 1), lambda j: list_max(m[1:j])))
        FROM (SELECT *, list_transform(range(1, len(b) + 1), lambda k: CASE WHEN b[k] = a[i + 1] THEN d[k] + 1 ELSE d[k + 1] END) AS m FROM c WHERE i < len(a))
    ),
    r AS (SELECT a, b FROM c WHERE i = len(a) AND 200.0 * d[len(b) + 1] / (len(a) + len(b)) > 85)
    SELECT x.session, r.a, r.b FROM r JOIN t x ON x.t = r.a JOIN t y ON y.t = r.b AND y.session = x.session
""")
def similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("session"), F.col("p_name").alias("title"))
    return resolve.similar_titles(rows, ["session"])


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", F.col("html").alias("body"))


@query(r"""
    SELECT page_id AS doc_id, len(regexp_extract_all(html, '(?i)<a\b[^>]*href')) AS n_links,
           nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '') AS h1
    FROM pages
""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.page_fields(_pages(spark, sf_dir)).select("doc_id", F.col("n_links").cast("long").alias("n_links"), "h1")


@query()
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.visible_lines(_pages(spark, sf_dir))


@query()
def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.anchors(_pages(spark, sf_dir), ["home", "about"]).select("doc_id", "pos", "url", "title")


@query(r"""SELECT page_id AS doc_id, string_split(url, '?')[1] AS clean_url, regexp_extract(regexp_replace(string_split(url, '?')[1], '/+$', ''), '([^/]*)$', 1) AS record_id FROM pages""")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = text.drop_query(F.col("url"))
    return _pages(spark, sf_dir).select("doc_id", clean.alias("clean_url"), text.last_segment(clean).alias("record_id"))


@query()
def post_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' turns as posts that may announce something."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    begin = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Show at The Hall number "), F.col("conv_id").cast("string"), F.lit(" this saturday 8pm. "))).otherwise(F.lit(""))
    posts = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.concat(begin, F.col("text")).alias("text"), as_of().alias("posted_at"))
    return payloads.post_hints(posts)


@query(r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(text, '([A-Za-z][A-Za-z0-9'']+)') AS ws FROM documents) SELECT doc_id, len(ws) AS n FROM w
""")
def onboarding_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"([A-Za-z][A-Za-z0-9']+)"), 1)).cast("long").alias("n"))


@query(r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '([A-Za-z][A-Za-z0-9'']+)') AS ws FROM documents),
    x AS (SELECT doc_id, i, ws[i] AS word, ws[i + 1] AS nxt FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
    -- title case: parts between digits and apostrophes begin with a capital
    u AS (
        SELECT word, regexp_replace(array_to_string(list_transform(regexp_extract_all(word, '[A-Za-z]+|[^A-Za-z]+'), lambda p: upper(left(p, 1)) || lower(substr(p, 2))), ''), '[^A-Za-z0-9]', '', 'g') AS titled
        FROM (SELECT word FROM x UNION SELECT nxt FROM x WHERE nxt IS NOT NULL)
    ),
    o AS (SELECT x.doc_id, x.i, '#' || a.titled AS one, '#' || a.titled || b.titled AS two FROM x JOIN u a ON a.word = x.word LEFT JOIN u b ON b.word = x.nxt WHERE length(x.word) >= 4 AND lower(x.word) NOT IN ('with', 'from', 'that', 'this', 'there', 'about', 'would') AND length(a.titled) > 1),
    f AS (SELECT doc_id, tag, min(place) AS place FROM (SELECT doc_id, one AS tag, 2 * i AS place FROM o UNION ALL SELECT doc_id, two, 2 * i + 1 FROM o WHERE two IS NOT NULL) GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS r FROM f)
    SELECT d.doc_id, coalesce(g.tags, []) AS tags FROM documents d LEFT JOIN (SELECT doc_id, list(tag ORDER BY place) AS tags FROM k WHERE r <= 5 GROUP BY doc_id) g ON g.doc_id = d.doc_id
""")
def onboarding_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.onboarding_tags(F.col("text")).alias("tags"))


@query(f"""
    WITH {CANON_SQL} SELECT source_name, avg(CAST(price IS NOT NULL AS DOUBLE)) AS with_price, avg(CAST(external_url IS NOT NULL AS DOUBLE)) AS with_link, CAST(0.0 AS DOUBLE) AS with_organizer FROM canon GROUP BY source_name
""")
def source_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.completeness(canon_events(spark, sf_dir).withColumn("organizer_name", F.lit(None).cast("string")))


@query(f"WITH {CANON_SQL} SELECT isodow(start_at) - 1 AS weekday, count(*) AS n FROM canon GROUP BY ALL")
def volume_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.volume_by_weekday(canon_events(spark, sf_dir), tz="UTC").withColumn("weekday", F.col("weekday").cast("long"))


@query(f"""
    WITH {RUNS_SQL}, h AS (SELECT source_name, arg_max(n, run_at) AS n FROM runs GROUP BY source_name) SELECT source_name, n AS last_event_count FROM h
""")
def latest_source_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.latest(health.run_health(source_runs(spark, sf_dir))).select("source_name", "last_event_count")


@query(f"""
    WITH {CANON_SQL}, {SIGNALS_SQL} SELECT user_id, list(event_id ORDER BY first_at, event_id) AS saved FROM (SELECT user_id, event_id, min(created_at) AS first_at FROM sig WHERE signal_type = 'save' GROUP BY ALL) GROUP BY user_id
""")
def saved_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.accumulated(user_signals(spark, sf_dir), "save", "event_id").withColumnRenamed("values", "saved")


@query(f"""
    WITH {CANON_SQL}, {SIGNALS_SQL}, {INTEREST_SQL},
    best AS (
        SELECT *, row_number() OVER (ORDER BY total DESC, start_at, id) AS r FROM (
            SELECT *, least(coalesce(people_interested, 0) * 10.0, 100.0) + CASE WHEN age <= 24 THEN 100.0 WHEN age <= 48 THEN 75.0 WHEN age <= 168 THEN 50.0 ELSE 25.0 END AS total
            FROM (SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 3600e6 AS age FROM canon WHERE start_at BETWEEN TIMESTAMP '{AS_OF}' AND TIMESTAMP '{AS_OF}' + INTERVAL 7 DAY) LEFT JOIN pop ON event_id = id)
    ),
    l AS (
        SELECT CAST(r + 2 AS INT) AS n, '- **' || title || '** — ' || strftime(start_at - INTERVAL 8 HOUR, '%a %b %-d ') || lower(strftime(start_at - INTERVAL 8 HOUR, '%-I:%M%p')) || ' · ' || venue_name || ' · '
            || CASE WHEN is_free THEN 'Free' WHEN price = floor(price) THEN '$' || CAST(CAST(price AS BIGINT) AS VARCHAR) ELSE '$' || printf('%.2f', price) END || ' · [link](' || external_url || ') · _' || array_to_string(tags[1:2], ' ') || '_' AS line
        FROM best WHERE r <= 15
    )
    SELECT * FROM l UNION ALL SELECT 0, '# Events digest — 2024-02-01' UNION ALL SELECT 1, '_Window: next 7 days_' UNION ALL SELECT 2, ''
    UNION ALL SELECT 3, '_No events found in this window._' WHERE NOT EXISTS (SELECT 1 FROM l)
    UNION ALL SELECT CAST(greatest(count(*), 1) + 3 AS INT), '' FROM l UNION ALL SELECT CAST(greatest(count(*), 1) + 4 AS INT), '{digest.FALLBACK_NOTE}' FROM l
    UNION ALL SELECT CAST(greatest(count(*), 1) + 5 AS INT), '' FROM l UNION ALL SELECT CAST(greatest(count(*), 1) + 6 AS INT), '_Generated from the events table_' FROM l
""")
def event_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of the week's fifteen best events, without a user: a top-k report."""
    return digest.user_digest(canon_events(spark, sf_dir), users(spark, sf_dir), user_signals(spark, sf_dir), None, NOW)


@query(f"WITH {CANON_SQL} SELECT id FROM canon WHERE id NOT IN (SELECT c_custkey FROM customer)")
def unseen_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a keyed table, of customers, lacks: the idempotent load."""
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return resolve.unseen(canon_events(spark, sf_dir).select("id"), known, ("id",))


def _streamed(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream has written when all that has landed is through; updates replace what they update in the last batch."""
    out, schema = scratch.folder(spark, name), stream.schema
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch.folder(spark, f"{name}-state")).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
    else:
        writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(schema).parquet(out)


@query(SQL["source_run_health"])
def streamed_source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful stream over landed runs, equal to its batch form."""
    path = scratch.folder(spark, "runs")
    runs = source_runs(spark, sf_dir).withColumn("run_at", F.col("run_at").cast("timestamp"))
    runs.repartition("source_name").write.parquet(path)
    return _streamed(spark, jobs.source_health(jobs.landed(spark, path, runs.schema)), "health")


@query(SQL["people_interested"])
def streamed_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users of each event from the signal stream; the watermark covers the log."""
    path = scratch.folder(spark, "signals")
    signals = user_signals(spark, sf_dir)
    signals.write.parquet(path)
    stream = jobs.live_popularity(jobs.landed(spark, path, signals.schema), "60 days")
    return _streamed(spark, stream, "popularity", "complete")


@query(f"WITH {CANON_SQL} SELECT id, least(cast(id % 50 AS INT) * 1.0 / 100.0, 1.0) AS votes_share, (id % 12) % 12 + CASE WHEN id % 2 = 0 THEN 12 ELSE 0 END AS hour24, CASE WHEN id % 3 >= 1 THEN 1 ELSE -1 END AS vote FROM canon")
def number_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = canon_events(spark, sf_dir)
    k = F.col("id")
    half = F.when(k % 2 == 0, "pm").otherwise("am")
    return ev.select("id", money.popularity_share(F.col("attendee_count"), 100.0).alias("votes_share"), timex.hour24(k % 12, half).alias("hour24"), money.vote_sign(k % 3).alias("vote"))


@query("""
    SELECT l_shipmode AS source_name, count(*) AS ingested, count(*) FILTER (l_quantity > 1) AS published, count(*) FILTER (l_quantity <= 1) AS rejected FROM (SELECT 'lines' || (l_linenumber % 5) AS l_shipmode, l_quantity FROM lineitem) GROUP BY l_shipmode
""")
def published_and_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("lines"), (F.col("l_linenumber") % 5).cast("string")).alias("source_name"), "l_quantity")
    return quality.source_counts(rows.where("l_quantity > 1"), rows.where("l_quantity <= 1"))


@query("""
    WITH s AS (SELECT o_custkey % 7 AS src, o_orderkey % 40 AS key_id, arg_max(CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'spent' END, o_orderkey) AS status FROM orders GROUP BY ALL)
    SELECT src AS source_name, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status <> 'active') AS inactive, count(*) FILTER (status = 'active') <= 1 AS alert FROM s GROUP BY src
""")
def key_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as snapshots of keys: the last status of each, by source."""
    snaps = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("source_name"), (F.col("o_orderkey") % 40).alias("key_id"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("spent").alias("status"), F.col("o_orderkey").alias("at"))
    return health.quota(snaps)


@query(f"""
    WITH {CANON_SQL},
    g AS (SELECT lower(CASE WHEN s_suppkey % 5 = 0 THEN 'The ' || s_name || ' Hall' WHEN s_suppkey % 5 = 1 THEN right(s_name, 9) WHEN s_suppkey % 5 = 4 THEN 'shut ' || s_suppkey ELSE s_name END) AS g, s_suppkey AS o, s_suppkey / 100.0 AS la, -s_suppkey / 100.0 AS lo FROM supplier),
    n AS (SELECT DISTINCT lower(venue_name) AS v FROM canon),
    m AS (SELECT v, arg_min(struct_pack(la := la, lo := lo), (v <> g, o)) AS x FROM n JOIN g ON contains(v, g) OR contains(g, v) GROUP BY v),
    c AS (SELECT lower(n_name) AS c, CAST(n_nationkey AS DOUBLE) AS la, CAST(n_nationkey + 100 AS DOUBLE) AS lo FROM nation),
    e AS (SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE venue_name END AS venue, CASE WHEN id % 3 = 0 THEN n_name END AS city, CASE WHEN id % 13 = 0 THEN lat END AS lat, CASE WHEN id % 13 = 0 THEN lon END AS lon FROM canon JOIN nation ON n_nationkey = id % 25)
    SELECT id, CAST(coalesce(e.lat, x.la, c.la, 37.7749) AS DOUBLE) AS lat, CAST(coalesce(e.lon, x.lo, c.lo, -122.4194) AS DOUBLE) AS lon,
           CAST(CASE WHEN e.lat IS NOT NULL OR x IS NOT NULL THEN 0.9 WHEN venue IS NOT NULL THEN 0.5 WHEN c.la IS NOT NULL THEN 0.4 ELSE 0.3 END AS DOUBLE) AS location_confidence
    FROM e LEFT JOIN m ON m.v = lower(venue) LEFT JOIN c ON c.c = lower(city)
""")
def geocoded_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a gazetteer, under their names, longer ones, parts of them or other ones; nations as cities; events with and
    without a venue, a city, a point."""
    s, k = F.col("s_name"), F.col("s_suppkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("The "), s, F.lit(" Hall"))).when(k % 5 == 1, F.expr("right(s_name, 9)")).when(k % 5 == 4, F.concat(F.lit("shut "), k.cast("string"))).otherwise(s)
    known = table(spark, sf_dir, "supplier").select(name.alias("name"), (k / 100.0).alias("lat"), (-k / 100.0).alias("lon"), k.alias("ordinal"))
    nations = table(spark, sf_dir, "nation")
    cities = nations.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("lat"), (F.col("n_nationkey") + 100).cast("double").alias("lon"))
    i = F.col("id")
    rows = canon_events(spark, sf_dir).join(nations, i % 25 == F.col("n_nationkey")).select("id", F.when(i % 11 != 0, F.col("venue_name")).alias("venue_name"), F.when(i % 3 == 0, F.col("n_name")).alias("city"), F.when(i % 13 == 0, F.col("lat")).alias("lat"), F.when(i % 13 == 0, F.col("lon")).alias("lon"))
    return geocode.geocode(rows, known, cities).select("id", "lat", "lon", "location_confidence")
