"""The stored table of events: immutable files, a manifest for each version, optimistic commits.

A version is a manifest: one row for each data file with its number of rows and the least and greatest start and id in it.
Data files are never changed. A batch reads the files whose starts lie within two hours of its own, rewrites those of them
that hold a row it updates, adds a file range of what it inserts, and commits a manifest that names the new files in place of
the rewritten ones; all other files are taken over by name. So the cost of a batch follows what it touches, and readers of an
older version are never disturbed.

A commit is the exclusive creation of the next version's entry in the log, by a rename that fails where the entry is there
already (as HDFS guarantees). The writer that fails reads the new version, works its batch out anew against it and tries
again. An entry also holds the number of the last batch of each stream, in the same atomic step, so that a batch that is
replayed after a crash changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CANON
from . import resolve
from .scratch import written

STORED = T.StructType([T.StructField("id", T.LongType()), *CANON.fields])
MANIFEST = "file string, rows long, min_start timestamp, max_start timestamp, min_id long, max_id long"
#: Seconds of a bucket in which files and batches meet.
BUCKET = int(resolve.WINDOW.total_seconds())


def write_version(df: DataFrame, base: str, version: int, partition_by: str | None = None) -> str:
    path = f"{base.rstrip('/')}/v={version}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return path


def by_start_date(events: DataFrame) -> DataFrame:
    """events with start_date, the partition column that time filters prune."""
    return events.withColumn("start_date", F.col("start_at").cast("date"))


def read_version(spark: SparkSession, base: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/v={version}")


class Conflict(Exception):
    """Another writer has committed the version first."""


@dataclass
class Entry:
    """A version: where its manifest is, and the last batch of each stream that it holds."""

    version: int = 0
    manifest: str | None = None
    streams: dict[str, int] = field(default_factory=dict)


@dataclass
class Told:
    """What a batch did; ``applied`` is false where the table held it already."""

    version: int
    applied: bool
    inserted: int = 0
    updated: int = 0
    skipped: int = 0
    deduped: int = 0
    files_read: int = 0
    files_rewritten: int = 0


class VersionLog:
    """Versions under ``base``, a path that all executors share: each an entry that is created once, by one writer."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        log = self._path("log")
        if not self._fs().exists(log):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs().listStatus(log) if f.getPath().getName().isdigit())

    def entry(self, version: int | None = None) -> Entry:
        """The entry of a version, or of the last one; version 0 is the empty table."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return Entry()
        said = self.spark.read.text(f"{self.base}/log/{version:020d}").first()[0]
        return Entry(version, **json.loads(said))

    def commit(self, entry: Entry) -> None:
        """Make the entry the version of its number, or raise Conflict where there is one."""
        jvm, gateway = self._jvm, self.spark.sparkContext._gateway
        temp, final = self._path(f"log/.{uuid.uuid4().hex}"), self._path(f"log/{entry.version:020d}")
        out = self._fs().create(temp, False)
        try:
            out.write(bytearray(json.dumps({"manifest": entry.manifest, "streams": entry.streams}).encode()))
        finally:
            out.close()
        options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(temp, final, options)
        except Exception as e:
            self._fs().delete(temp, False)
            if self._fs().exists(final):
                raise Conflict(f"version {entry.version} is there") from e
            raise


class EventTable(VersionLog):
    """Stored events: id and the canonical columns."""

    def __init__(self, spark: SparkSession, base: str, rows_per_file: int = 1_000_000):
        super().__init__(spark, base)
        self.rows_per_file = rows_per_file

    # reading

    def manifest(self, version: int | None = None) -> DataFrame:
        entry = self.entry(version)
        if entry.manifest is None:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.base}/manifests/{entry.manifest}")

    def _files(self, manifest: DataFrame) -> list[str]:
        """Names only; Spark's own reader holds them on the driver as well."""
        return sorted(r["file"] for r in manifest.select("file").collect())

    def _rows(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(*[f"{self.base}/data/{f}" for f in files])

    def read(self, version: int | None = None, low: datetime | None = None, high: datetime | None = None) -> DataFrame:
        """The rows of a version (else of the last one), with start_at from ``low`` to ``high``; other files aren't opened."""
        manifest = self.manifest(version)
        if low is not None:
            manifest = manifest.where(F.col("max_start") >= F.lit(low))
        if high is not None:
            manifest = manifest.where(F.col("min_start") <= F.lit(high))
        rows = self._rows(self._files(manifest))
        rows = rows if low is None else rows.where(F.col("start_at") >= F.lit(low))
        return rows if high is None else rows.where(F.col("start_at") <= F.lit(high))

    # writing

    def _write(self, rows: DataFrame) -> DataFrame:
        """rows as new files in ranges of start_at -> their rows of a manifest."""
        name = uuid.uuid4().hex
        path = f"{self.base}/data/{name}"
        rows = written(rows.select(*STORED.fieldNames()), "rows")
        parts = max(1, -(-rows.count() // self.rows_per_file))
        ranged = rows.repartitionByRange(parts, "start_at", "id").sortWithinPartitions("start_at", "id")
        ranged.write.option("maxRecordsPerFile", self.rows_per_file).parquet(path)
        new = self.spark.read.schema(STORED).parquet(path).withColumn("file", F.concat(F.lit(f"{name}/"), F.col("_metadata.file_name")))
        of = lambda f, c: f(c).alias(f"{f.__name__}_{c.removesuffix('_at')}")
        return new.groupBy("file").agg(F.count("*").alias("rows"), of(F.min, "start_at"), of(F.max, "start_at"), of(F.min, "id"), of(F.max, "id"))

    def _commit_files(self, last: Entry, kept: DataFrame, new: DataFrame, streams: dict[str, int]) -> Entry:
        name = uuid.uuid4().hex
        kept.select("file", "rows", "min_start", "max_start", "min_id", "max_id").unionByName(new).coalesce(1).write.parquet(f"{self.base}/manifests/{name}")
        entry = Entry(last.version + 1, name, streams)
        self.commit(entry)
        return entry

    def _reached(self, manifest: DataFrame, incoming: DataFrame) -> DataFrame:
        """Of a manifest, the files that may hold a match of an incoming row, found by buckets of two hours.

        A file's span is not spread over its buckets, which are many where starts lie far apart: it lies in two nodes, at
        most, of the level whose nodes are as wide as it is, and asked buckets meet it there."""
        at = lambda c: F.floor(F.unix_seconds(c) / BUCKET)
        asked = incoming.select(F.explode(F.sequence(at("start_at") - 1, at("start_at") + 1)).alias("bucket")).distinct()
        spans = manifest.select("file", at("min_start").alias("low"), at("max_start").alias("high")).withColumn("level", F.length(F.bin(F.col("high") - F.col("low"))))
        node = lambda c: F.expr(f"shiftright({c}, level)").alias("node")
        spans = spans.withColumn("node", F.explode(F.array_distinct(F.array(node("low"), node("high")))))
        # there are 64 levels at most
        asked = asked.crossJoin(F.broadcast(spans.select("level").distinct())).select("bucket", "level", node("bucket"))
        met = spans.join(asked, ["level", "node"]).where(F.col("bucket").between(F.col("low"), F.col("high")))
        return manifest.join(met.select("file").distinct(), "file", "left_semi")

    def _attempt(self, incoming: DataFrame, stream: str | None, batch: int | None, before_commit: Callable[[], None] | None) -> Told:
        last = self.entry()
        if stream is not None and last.streams.get(stream, -1) >= batch:
            return Told(last.version, False)
        streams = last.streams if stream is None else last.streams | {stream: batch}
        manifest = written(self.manifest(last.version), "manifest")
        near = self._files(self._reached(manifest, incoming))
        stored = self._rows(near)
        placed = stored.select("id", F.concat_ws("/", F.element_at(F.split("_metadata.file_path", "/"), -2), "_metadata.file_name").alias("file")) if near else None
        top = manifest.agg(F.coalesce(F.max("max_id"), F.lit(0)).alias("top"))
        changed, inserted, actions = resolve.changes(incoming, stored, top)
        changed, inserted, actions = written(changed, "changed"), written(inserted, "inserted"), written(actions, "actions")
        touched = sorted(r["file"] for r in placed.join(changed.select("id").hint("merge"), "id", "left_semi").select("file").distinct().collect()) if near else []
        kept = self._rows(touched).join(changed.select("id").hint("merge"), "id", "left_anti")
        count = {r["action"]: r["n"] for r in resolve.summarize(actions).collect()}
        told = Told(last.version + 1, True, count.get("insert", 0), count.get("update", 0), count.get("skip", 0), incoming.count() - sum(count.values()), len(near), len(touched))
        new = self._write(kept.unionByName(changed).unionByName(inserted))
        if before_commit:
            before_commit()
        self._commit_files(last, manifest.where(~F.col("file").isin(touched)) if touched else manifest, new, streams)
        return told

    def load(self, incoming: DataFrame, stream: str | None = None, batch: int | None = None, retries: int = 10, before_commit: Callable[[], None] | None = None) -> Told:
        """Upsert canonical rows with ordinal. With a stream's name and a batch number, a batch that the table holds already
        does nothing; numbers of a stream rise. ``before_commit`` is called between writing and committing."""
        incoming = written(incoming.select("ordinal", *CANON.fieldNames()), "batch")
        for left in reversed(range(retries + 1)):
            try:
                return self._attempt(incoming, stream, batch, before_commit)
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def compact(self, least_rows: int, retries: int = 10) -> int:
        """Write files of fewer than ``least_rows`` rows anew in ranges of start; tells how many went. Rows stay as they are."""
        for left in reversed(range(retries + 1)):
            last = self.entry()
            manifest = written(self.manifest(last.version), "manifest")
            small = self._files(manifest.where(F.col("rows") < least_rows))
            if len(small) < 2:
                return 0
            try:
                self._commit_files(last, manifest.where(F.col("rows") >= least_rows), self._write(self._rows(small)), last.streams)
                return len(small)
            except Conflict:
                if not left:
                    raise
        raise AssertionError


def load_batch(incoming: DataFrame, base: str, version: int) -> DataFrame:
    """Upsert canonical rows with ordinal into a version of the table, write the next version, and tell in one row what
    was inserted, updated and skipped, and how many rows repeated others of the batch. The same call writes the same."""
    table, actions = resolve.upsert(incoming, read_version(incoming.sparkSession, base, version))
    actions = written(actions, "actions")
    write_version(table, base, version + 1)
    count = lambda kind: F.count_if(F.col("action") == kind)
    total = incoming.agg(F.count("*").alias("n"))
    told = actions.agg(count("insert").alias("inserted"), count("update").alias("updated"), count("skip").alias("skipped"), F.count("*").alias("acted"))
    return told.crossJoin(total).select("inserted", "updated", "skipped", (F.col("n") - F.col("acted")).alias("deduped"))
