"""Reading landed documents: pages, JSON payloads, mail; and incremental reads."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def html_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file below path: url, body."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("body"))


def tagged(pages: dict[str, DataFrame]) -> DataFrame:
    """Documents of several kinds as one table with ``kind``."""
    out = None
    for kind, df in pages.items():
        one = df.withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def json_items(payloads: DataFrame, path: str, schema: str, body: str = "body") -> DataFrame:
    """payloads(doc_id, body) -> doc_id, pos, item: the list at a dotted path of each payload; odd or missing lists are empty."""
    parts = path.split(".")
    ddl = f"array<{schema}>"
    for p in reversed(parts):
        ddl = f"struct<`{p}`:{ddl}>"
    parsed = F.from_json(F.col(body), ddl, {"mode": "PERMISSIVE"})
    for p in parts:
        parsed = parsed[p]
    return payloads.select("doc_id", F.posexplode(parsed).alias("pos", "item")).where("item is not null")


def graph_nodes(payloads: DataFrame, node_schema: str, path: str = "data.keywordSearch.edges") -> DataFrame:
    return json_items(payloads, path, f"struct<node:{node_schema}>").select("doc_id", "pos", "item.node.*")


def listing_children(payloads: DataFrame, child_schema: str, path: str = "data.children") -> DataFrame:
    return json_items(payloads, path, f"struct<data:{child_schema}>").select("doc_id", "pos", "item.data.*")


def _part(message, kind: str) -> str | None:
    for part in message.walk():
        if part.get_content_type() == kind and not part.is_multipart():
            try:
                return part.get_content()
            except (LookupError, UnicodeDecodeError):
                data = part.get_payload(decode=True)
                return data.decode("utf-8", "replace") if data else None
    return None


def mail(files: DataFrame) -> DataFrame:
    """binaryFile rows(path, content) -> path, sender, sent_at, subject, html, plain: the first body of each kind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                m = email.message_from_bytes(bytes(content), policy=email.policy.default)
                sender = email.utils.parseaddr(str(m.get("From", "")))[1].lower() or None
                try:
                    sent = email.utils.parsedate_to_datetime(str(m.get("Date")))
                    sent = pd.Timestamp(sent).tz_convert("UTC").tz_localize(None) if sent.tzinfo else pd.Timestamp(sent)
                except (TypeError, ValueError):
                    sent = pd.NaT
                rows.append((path, sender, sent, str(m.get("Subject", "")) or None, _part(m, "text/html"), _part(m, "text/plain")))
            yield pd.DataFrame(rows, columns=["path", "sender", "sent_at", "subject", "html", "plain"])

    return files.select("path", "content").mapInPandas(run, "path string, sender string, sent_at timestamp, subject string, html string, plain string")


def allowed_senders(messages: DataFrame, allow: DataFrame) -> DataFrame:
    """messages of senders whose address, domain or a parent domain is in allow(entry): equi-joins on each suffix."""
    domain = F.substring_index("sender", "@", -1)
    labels = F.split(domain, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = messages.where("sender is not null").select("sender", F.explode(F.concat(F.array("sender"), suffixes)).alias("key")).distinct()
    good = keys.join(allow.select(F.lower(F.trim("entry")).alias("key")), "key", "left_semi").select("sender").distinct()
    return messages.join(good, "sender", "left_semi")


def since(rows: DataFrame, column: str, mark: datetime | None) -> DataFrame:
    """All rows without a mark, else those changed at or after it. The next mark is the start of this run."""
    return rows if mark is None else rows.where(F.col(column) >= F.lit(mark).cast("timestamp"))


def crawl_days(spark: SparkSession, first: Column, days: int = 10, prefix: str = "") -> DataFrame:
    """day, url of each local day of the horizon."""
    day = F.explode(F.sequence(first, F.date_add(first, days - 1)))
    return spark.range(1).select(day.alias("day")).select("day", F.concat(F.lit(prefix), F.date_format("day", "/yyyy/MM/dd/")).alias("url"))


def list_column(c: Column) -> Column:
    return F.from_json(c, "array<string>")


def list_text(c: Column) -> Column:
    return F.to_json(c)
