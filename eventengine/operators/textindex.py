"""A stored text index: postings in segments, one a batch, and a log of the segments that are live.

A posting is a stem and the id of a text that holds it. A segment holds the postings of a batch's texts, in folders by a
hash of the stem and sorted by it, and the batch's ids. A search knows its stems, so that it opens the folders of these only
and, in them, the row groups that may hold them; texts are stemmed when they are written, never when they are searched. A
text that comes again, changed, is in a later segment, which hides its postings in earlier ones; one that comes without
words is gone. ``compact`` folds the live postings into one segment.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .scratch import written
from .tables import Conflict, Entry, VersionLog

BUCKETS = 256
POSTING = "term string, id long, bucket int"


def body(events: DataFrame) -> Column:
    """What of an event is searched."""
    return F.concat_ws(" ", events["title"], events["description"])


class TextIndex(VersionLog):
    """An index of texts by their English stems."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS):
        super().__init__(spark, base)
        self.buckets = buckets

    def segments(self, entry: Entry | None = None) -> list[str]:
        """Names of the live segments, the oldest first."""
        entry = entry or self.entry()
        return entry.manifest.split(",") if entry.manifest else []

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _write(self, postings: DataFrame, ids: DataFrame) -> str:
        name = uuid.uuid4().hex
        placed = postings.withColumn("bucket", self._bucket(F.col("term")))
        # a common stem's postings are split: rows of a bucket go to as many tasks as Spark finds right
        placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{self.base}/segments/{name}/postings")
        ids.write.parquet(f"{self.base}/segments/{name}/ids")
        return name

    def _published(self, make) -> None:
        """Commit what ``make`` gives for the last entry: (its live segments) -> the live segments."""
        while True:
            last = self.entry()
            try:
                return self.commit(Entry(last.version + 1, ",".join(make(self.segments(last))), last.streams))
            except Conflict:
                continue

    def add(self, docs: DataFrame, batch: int | None = None, stream: str = "") -> bool:
        """Index docs(id, body), each in place of what the index holds of its id; a batch that it holds already does nothing."""
        if batch is not None and self.entry().streams.get(stream, -1) >= batch:
            return False
        docs = written(docs.select(F.col("id").cast("long").alias("id"), "body"), "docs")
        name = self._write(docs.select("id", F.explode(text.stems(F.col("body"))).alias("term")), docs.select("id").distinct())
        while True:
            last = self.entry()
            if batch is not None and last.streams.get(stream, -1) >= batch:
                return False
            streams = last.streams if batch is None else last.streams | {stream: batch}
            try:
                self.commit(Entry(last.version + 1, ",".join([*self.segments(last), name]), streams))
                return True
            except Conflict:
                continue

    def _each(self, kind: str, schema: str, segments: list[str]) -> DataFrame:
        """What the segments hold, with their numbers."""
        out = self.spark.createDataFrame([], f"{schema}, segment int")
        for k, name in enumerate(segments):
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.base}/segments/{name}/{kind}").withColumn("segment", F.lit(k)))
        return out

    def _live(self, found: DataFrame, segments: list[str]) -> DataFrame:
        """found(id, segment) less those that a later segment replaces."""
        if len(segments) < 2:
            return found
        later = self._each("ids", "id long", segments).where("segment > 0").select(F.col("id").alias("i"), F.col("segment").alias("s"))
        return found.join(later, (F.col("id") == F.col("i")) & (F.col("s") > F.col("segment")), "left_anti")

    def terms_of(self, query: str) -> list[str]:
        """A query's stems; the only text that a search stems."""
        return sorted(self.spark.range(1).select(text.stems(F.lit(query)).alias("x")).first()["x"])

    def lookup(self, query: str) -> DataFrame:
        """id of each text that holds all of the query's stems; none for a query without any."""
        terms, segments = self.terms_of(query), self.segments()
        if not terms:
            return self.spark.createDataFrame([], "id long")
        buckets = sorted(r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(self._bucket(F.col("t"))).distinct().collect())
        hits = self._each("postings", POSTING, segments).where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        # a text's stems are all in one segment, each once
        whole = hits.groupBy("id", "segment").agg(F.count("*").alias("n")).where(F.col("n") == len(terms))
        return self._live(whole.select("id", "segment"), segments).select("id")

    def lookup_each(self, queries: DataFrame) -> DataFrame:
        """queries(query_id, query) -> query_id, id: many queries at a time, met by an equi-join on the stem."""
        segments = self.segments()
        terms = written(queries.select("query_id", F.explode(text.stems(F.col("query"))).alias("term")), "terms")
        terms = terms.withColumn("bucket", self._bucket(F.col("term")))
        need = terms.groupBy("query_id").agg(F.count("*").alias("need"))
        hits = self._each("postings", POSTING, segments).join(terms, ["bucket", "term"])
        whole = hits.groupBy("query_id", "id", "segment").agg(F.count("*").alias("got")).join(need, "query_id").where("got = need")
        return self._live(whole.select("query_id", "id", "segment"), segments).select("query_id", "id")

    def compact(self) -> int:
        """Fold all segments into one; tells how many there were."""
        old = self.segments()
        if len(old) < 2:
            return 0
        live = written(self._live(self._each("ids", "id long", old), old), "live")
        name = self._write(self._each("postings", POSTING, old).join(live, ["id", "segment"], "left_semi").select("term", "id"), live.select("id"))
        # what has been added since comes after
        self._published(lambda now: [name, *now[len(old) :]] if now[: len(old)] == old else now)
        return len(old)
