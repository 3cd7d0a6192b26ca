"""Coordinates from names of venues and cities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CENTROID = (37.7749, -122.4194)
PIECE = 4
# Confidence of a place by how it was found; fixed values.
RESOLVED, NAMED, CITY, DEFAULT = 0.9, 0.5, 0.4, 0.3


def _pieces(c: Column, n: int) -> Column:
    """All runs of n characters."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>"))


def holding(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """inner(s) and outer(b), distinct strings that are not empty -> s, b where b holds s.

    Each s looks for its rarest run of up to ``PIECE`` characters among those of the b; only what shares it is compared.
    """
    runs = F.array_distinct(F.flatten(F.array(*[_pieces(F.col("b"), n) for n in range(1, PIECE + 1)])))
    ours = outer.select("b", F.explode(runs).alias("piece"))
    common = ours.groupBy("piece").agg(F.count("*").alias("n"))
    own = F.when(F.length("s") >= PIECE, F.array_distinct(_pieces(F.col("s"), PIECE))).otherwise(F.array("s"))
    asked = inner.select("s", F.explode(own).alias("piece")).join(common, "piece", "left")
    # a run that no b has rules its s out
    rare = asked.groupBy("s").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))
    return rare.join(ours, "piece").where(F.expr("instr(b, s) > 0")).select("s", "b")


def resolve_venues(names: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """names(venue_name) and gazetteer(name, lat, lon, ordinal) -> venue_name, lat, lon; both sides may grow.

    Equal names win; else the first entry, by ordinal, that holds the name or is held by it.
    """
    first = F.min_by(F.struct("lat", "lon", "ordinal"), "ordinal")
    known = gazetteer.select(F.lower(F.trim("name")).alias("g"), "lat", "lon", "ordinal").where("g <> ''").groupBy("g").agg(first.alias("x"))
    wanted = names.select("venue_name", F.lower(F.trim("venue_name")).alias("v")).distinct().where("v <> ''")
    keys = wanted.select("v").distinct()
    exact = keys.join(known, F.col("v") == F.col("g")).select("v", "x")
    open_keys = keys.join(exact.select("v"), "v", "left_anti")
    entries = known.select(F.col("g").alias("b"))
    held = holding(open_keys.select(F.col("v").alias("s")), entries).select(F.col("s").alias("v"), F.col("b").alias("g"))
    holds = holding(known.select(F.col("g").alias("s")), open_keys.select(F.col("v").alias("b"))).select(F.col("b").alias("v"), F.col("s").alias("g"))
    near = held.unionByName(holds).join(known, "g").groupBy("v").agg(F.min_by("x", "x.ordinal").alias("x"))
    return wanted.join(exact.unionByName(near), "v").select("venue_name", "x.lat", "x.lon")


def geocode(rows: DataFrame, venues: DataFrame, cities: DataFrame, default: tuple[float, float] = CENTROID, named: float = NAMED) -> DataFrame:
    """rows(venue_name, city, lat, lon) with coordinates: own, the venue's, the city's, the default; and location_confidence."""
    v = resolve_venues(rows.select("venue_name"), venues).select(F.col("venue_name").alias("__v"), F.col("lat").alias("v_lat"), F.col("lon").alias("v_lon"))
    c = cities.groupBy(F.lower(F.trim("name")).alias("__c")).agg(F.min(F.struct("lat", "lon")).alias("x")).select("__c", F.col("x.lat").alias("c_lat"), F.col("x.lon").alias("c_lon"))
    out = rows.join(v, F.col("venue_name") == F.col("__v"), "left").join(c, F.lower(F.trim("city")) == F.col("__c"), "left")
    own = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    conf = F.when(own | F.col("v_lat").isNotNull(), RESOLVED).when(F.coalesce(F.trim("venue_name"), F.lit("")) != "", named).when(F.col("c_lat").isNotNull(), CITY).otherwise(DEFAULT)
    lat = F.when(own, F.col("lat")).otherwise(F.coalesce("v_lat", "c_lat", F.lit(default[0])))
    lon = F.when(own, F.col("lon")).otherwise(F.coalesce("v_lon", "c_lon", F.lit(default[1])))
    return out.withColumn("location_confidence", conf).withColumn("lat", lat).withColumn("lon", lon).drop("__v", "__c", "v_lat", "v_lon", "c_lat", "c_lon")
