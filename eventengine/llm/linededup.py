"""Line dedup by fingerprints of short runs of lines, with Spark functions only.

A text's lines are split at ``\\n``; blank lines are left out of the comparison and never removed by themselves. A line is
compared trimmed, in lower case, with runs of white space as one space. A span is a run of neighbouring lines of at least
``MIN_WORDS`` words that would have fewer without its first line, or without its last: a line of so many words alone, short
lines together. The hash of each span is a fingerprint. The earliest place of a fingerprint, by (doc_id, text hash, line),
is the source of all its later places, and these are removed.

Each line of a repeated run of ``MIN_WORDS`` words or more is in such a span within the run, so that exactly the lines of
these runs go, wherever the earlier places of their parts are. With ``window`` over 1, only the least of each ``window``
neighbouring fingerprints is kept, and runs may be missed. The earliest place of a line is never removed.

Defined results: text null: stays null, nothing removed. doc_id null: left alone, and no source. Rows repeated with the
same doc_id and text count once and get the same result; rows that share a doc_id but not the text are documents of their
own. Extra columns pass through, whatever their names; where one is called ``removed_lines``, the operator's own column is
``removed_lines_``. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import cut, free, grown, keyed

WINDOW, MIN_LINES, MIN_WORDS = 1, 2, 8


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " ")))


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, at (numbers of the lines with words), hash and words of each; once for each document."""
    split = F.split(F.col("text"), "\n", -1)
    full = F.filter(F.transform(split, lambda x, i: F.struct(_normal(x).alias("line"), i.alias("i"))), lambda x: x["line"] != "")
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), full.alias("full"))
    rows = rows.select(
        "doc_id",
        "text_hash",
        F.transform("full", lambda x: x["i"]).alias("at"),
        F.transform("full", lambda x: F.xxhash64(x["line"])).alias("hashes"),
        F.transform("full", lambda x: F.size(F.split(x["line"], " "))).alias("words"),
    )
    return rows.where(F.size("at") > 0).dropDuplicates(["doc_id", "text_hash"])


def fingerprints(lines: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, pos, fp, at: the spans, by the first one's place among the lines with words, and the numbers of their lines."""
    ahead = [F.slice(c, F.col("pos") + 1, min_words).alias(c) for c in ("hashes", "words", "at")]
    rows = lines.select("*", F.posexplode("hashes").alias("pos", "h")).select("doc_id", "text_hash", "pos", *ahead)
    total, spans = F.lit(0), []
    for n in range(1, min_words + 1):
        last = F.get("words", F.lit(n - 1))
        total = total + last
        # past the end the total is null
        short = total - F.greatest(F.get("words", F.lit(0)), last) < min_words
        spans.append(F.when((total >= min_words) & short, F.struct(F.xxhash64(F.slice("hashes", 1, n)).alias("fp"), F.slice("at", 1, n).alias("at"))))
    rows = rows.select("doc_id", "text_hash", "pos", F.explode(F.array_compact(F.array(*spans))).alias("s")).select("doc_id", "text_hash", "pos", "s.fp", "s.at")
    if window == 1:
        return rows
    placed = rows.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("pos", "at", "fp"))).alias("p"))
    by_hash = F.transform("p", lambda x: F.struct(x["fp"].alias("fp"), x["pos"].alias("pos"), x["at"].alias("at")))
    placed = placed.select("doc_id", "text_hash", by_hash.alias("p"))
    minima = F.transform(F.sequence(F.lit(1), F.greatest(F.size("p") - window + 1, F.lit(1))), lambda i: F.array_min(F.slice(F.col("p"), i, window)))
    return placed.select("doc_id", "text_hash", F.explode(F.array_distinct(minima)).alias("m")).select("doc_id", "text_hash", "m.pos", "m.fp", "m.at")


def repeated_spans(docs: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """documents -> doc_id, text_hash, pos, at, src(doc_id, text_hash, pos): the spans to remove; lines from 0."""
    # written before it is joined, so that Spark can split the join of a very common fingerprint
    marks = cut(fingerprints(line_table(docs), window, min_words), "spans")
    place = F.struct("doc_id", "text_hash", "pos")
    first = cut(marks.groupBy("fp").agg(F.min(place).alias("src"), F.count("*").alias("n")).where("n > 1").select("fp", "src"), "sources")
    return marks.join(grown(first), "fp").where(place > F.col("src")).select("doc_id", "text_hash", "pos", "at", "src")


def _without_lines(docs: DataFrame, window: int, min_words: int) -> DataFrame:
    """documents -> row (as it came, but for the text) and gone (numbers of the removed lines, sorted)."""
    spans = repeated_spans(docs, window, min_words)
    found = spans.select(F.col("doc_id").alias("did"), F.col("text_hash").alias("th"), F.explode(F.transform("at", lambda x, k: F.struct((F.col("pos") + k).alias("pos"), x.alias("line")))).alias("x"))
    found = found.groupBy("did", "th").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    # blank lines between removed lines go with them
    before = lambda k: F.get("xs", k - 1)
    since = lambda x, k: F.when(before(k)["pos"] == x["pos"] - 1, before(k)["line"] + 1).otherwise(x["line"])
    gone = cut(found.select("did", "th", F.flatten(F.transform("xs", lambda x, k: F.sequence(since(x, k), x["line"]))).alias("gone")), "removed")
    joined = keyed(docs).join(grown(gone), ["did", "th"], "left")
    # lines with their numbers, less the removed numbers: set operations hash, so that the work grows with the lines only
    lines = F.split("row.text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.array_join(F.get(F.transform(F.array(lines), lambda x: F.transform(left, lambda i: F.get(x, i))), F.lit(0)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(text)
    return joined.select(F.col("row").withField("text", text).alias("row"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """documents -> the same rows and columns, text without the removed lines, and removed_lines (numbers, sorted)."""
    return _without_lines(docs, window, min_words).select("row.*", F.col("gone").alias(free(docs, "removed_lines")))


def without_repeats(docs: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, columns as they came, each text without its removed lines."""
    return _without_lines(docs, window, min_words).select("row.*")
