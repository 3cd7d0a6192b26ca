"""Logical tables of the engine over the given ones, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 19:00:00"
VIBES = ["#red", "#blue", "#small", "#widget", "#gear", "#ring", "#large", "#bolt"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    local = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(local) if local else df


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def canon_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as events at suppliers as venues: ten events a night, starts packed into evenings."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    n_parts = F.broadcast(part.agg(F.count("*").alias("n_parts")))
    n_supp = F.broadcast(supplier.agg(F.count("*").alias("n_supp")))
    p = part.crossJoin(n_parts).crossJoin(n_supp).withColumn("s_key", F.floor(F.col("p_partkey") / 3) % F.col("n_supp"))
    k = F.col("p_partkey")
    base = F.unix_seconds(as_of())
    start = F.timestamp_seconds(base + ((k * 37) % F.floor(F.col("n_parts") / 10)) * 86400 + (k % 5) * 1800)
    s = F.col("s_suppkey")
    return p.join(supplier, F.col("s_key") == F.col("s_suppkey")).select(
        k.alias("id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("description"), F.array("p_type").alias("categories"),
        F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("#"), w)).alias("tags"), F.col("p_retailprice").alias("price"), (F.col("p_size") % 3 + 1).cast("int").alias("source_tier"),
        F.col("s_name").alias("venue_name"), F.concat(F.col("p_brand"), F.lit(" street")).alias("raw_address"), start.alias("start_at"), F.timestamp_seconds(F.unix_seconds(start) + 7200).alias("end_at"),
        F.timestamp_seconds(base - 2 * 86400 + 5 * 3600 - (k % 240) * 3600).alias("created_at"), (F.lit(37.7749) + ((s * 7) % 23 - 11) * 0.004).alias("lat"), (F.lit(-122.4194) + ((s * 11) % 29 - 14) * 0.004).alias("lon"),
        F.lit("scheduled").alias("status"), F.when(k % 4 == 0, 0.3).otherwise(0.9).alias("location_confidence"), (k % 7 == 0).alias("is_free"), F.concat(F.lit("https://example.com/e/"), (k % 1500).cast("string")).alias("external_url"),
        F.concat(F.lit("src"), (k % 6).cast("string")).alias("source_name"), k.cast("string").alias("source_event_id"), (k % 50).cast("int").alias("attendee_count"),
    )


CANON_SQL = f"""
    np AS (SELECT count(*) AS n FROM part), ns AS (SELECT count(*) AS n FROM supplier),
    canon AS (
        SELECT p_partkey AS id, p_name AS title, concat_ws(' ', p_name, p_type, p_brand) AS description, [p_type] AS categories,
               list_transform(string_split(p_name, ' '), lambda w: '#' || w) AS tags, p_retailprice AS price, CAST(p_size % 3 + 1 AS INT) AS source_tier,
               s_name AS venue_name, p_brand || ' street' AS raw_address,
               TIMESTAMP '{AS_OF}' + to_seconds(((p_partkey * 37) % (np.n // 10)) * 86400 + (p_partkey % 5) * 1800) AS start_at,
               TIMESTAMP '{AS_OF}' + to_seconds(((p_partkey * 37) % (np.n // 10)) * 86400 + (p_partkey % 5) * 1800 + 7200) AS end_at,
               TIMESTAMP '{AS_OF}' - to_seconds(2 * 86400 - 5 * 3600 + (p_partkey % 240) * 3600) AS created_at,
               CAST(37.7749 AS DOUBLE) + ((s_suppkey * 7) % 23 - 11) * CAST(0.004 AS DOUBLE) AS lat, CAST(-122.4194 AS DOUBLE) + ((s_suppkey * 11) % 29 - 14) * CAST(0.004 AS DOUBLE) AS lon,
               'scheduled' AS status, CAST(CASE WHEN p_partkey % 4 = 0 THEN 0.3 ELSE 0.9 END AS DOUBLE) AS location_confidence, p_partkey % 7 = 0 AS is_free,
               'https://example.com/e/' || (p_partkey % 1500) AS external_url, 'src' || (p_partkey % 6) AS source_name
        FROM part, np, ns JOIN supplier ON s_suppkey = (p_partkey // 3) % ns.n
    )"""


def user_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as signals; errors weigh nothing and go."""
    from ..functions import money

    ev, n = table(spark, sf_dir, "events"), F.broadcast(table(spark, sf_dir, "part").agg(F.count("*").alias("n_parts")))
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.create_map(*[F.lit(x) for kv in {"click": "click", "view": "save", "purchase": "external_ticket_click", "signup": "onboarding", "error": "error"}.items() for x in kv])
    rows = ev.crossJoin(n).select(
        "user_id", F.element_at(kind, F.col("event_type")).alias("signal_type"), F.when(F.col("event_type") != "signup", (F.col("event_id") * 7 + k) % F.col("n_parts")).alias("event_id"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit(" tag "), (k % 10).cast("string"))).alias("vibe_tag"), F.col("ts").alias("created_at"),
    )
    return rows.withColumn("weight", money.signal_weight(F.col("signal_type"))).where("weight > 0")


SIGNALS_SQL = """
    sig AS (
        SELECT user_id, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'save' WHEN 'purchase' THEN 'external_ticket_click' WHEN 'signup' THEN 'onboarding' END AS signal_type,
               CASE WHEN event_type <> 'signup' THEN (event_id * 7 + k) % np.n END AS event_id, CASE WHEN event_type = 'signup' THEN '#tag' || (k % 10) END AS vibe_tag, ts AS created_at,
               CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 5.0 WHEN 'purchase' THEN 10.0 WHEN 'signup' THEN 6.0 END::DOUBLE AS weight
        FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error'), np
    )"""

INTEREST_SQL = """
    pop AS (SELECT event_id, count(DISTINCT user_id) AS people_interested FROM sig WHERE event_id IS NOT NULL AND signal_type <> 'onboarding' GROUP BY event_id)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(v) for v in VIBES])
    return table(spark, sf_dir, "events").select("user_id").distinct().withColumn("preferred_vibes", F.when(F.col("user_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.get(names, (F.col("user_id") % 8).cast("int")))))


def source_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each event type in each hour of the log: runs, some of them empty."""
    ev = table(spark, sf_dir, "events")
    hours = ev.agg(F.date_trunc("hour", F.min("ts")).alias("a"), F.date_trunc("hour", F.max("ts")).alias("b")).select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("run_at"))
    kinds = ev.select(F.col("event_type").alias("source_name")).distinct()
    n = ev.groupBy(F.col("event_type").alias("source_name"), F.date_trunc("hour", "ts").alias("run_at")).agg(F.count("*").alias("n"))
    # a handful of types times the hours: the size of the result
    grid = hours.withColumn("k", F.lit(1)).join(kinds.withColumn("k", F.lit(1)), "k").drop("k")
    return grid.join(n, ["source_name", "run_at"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


RUNS_SQL = """
    runs AS (
        SELECT source_name, run_at, coalesce(n, 0) AS n
        FROM (SELECT DISTINCT event_type AS source_name FROM events)
        CROSS JOIN (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS run_at FROM events)
        LEFT JOIN (SELECT event_type AS source_name, date_trunc('hour', ts) AS run_at, count(*) AS n FROM events GROUP BY ALL) USING (source_name, run_at)
    )"""
