"""Host-level quality rules, with Spark functions only.

Each document is held against rules of its own; failures are aggregated by host, a host's rate is shrunk towards the
corpus by an empirical beta prior, and the verdict on the host is joined back to its documents.

Prior: with host rates of mean m and variance v (each host weighted by its documents), the beta prior has strength
s = m(1 - m)/v - 1, held within 1 and ``MAX_STRENGTH``, and the shrunk rate of a host is (failures + s m)/(n + s). A host is
rejected when that rate is above ``MAX_RATE`` and its own rate is above the corpus's, so that it is judged by its own failures.

Defined results: text null: no words, so the base rules fail. source null: a host of its own. doc_id null: a row as any.
Repeated rows count each. Extra columns are ignored (or kept by :func:`keep_good`, whatever their names). No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import cut

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
MAX_RATE, MAX_STRENGTH = 0.5, 1000.0
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once for a row, wherever use needs it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _covered(grams: Column) -> Column:
    """Words in windows whose hash occurs twice or more: place, hash pairs in the order of hashes."""
    ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def count(s: Column) -> Column:
        same = F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"]), x["i"])), lambda i: i.isNotNull())
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(F.array_sort(same), start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(WINDOW))).alias("n")), lambda acc: acc["n"])

    return _let(ordered, count)


def repeat_words(hashes: Column, n: Column) -> Column:
    """Words in ``WINDOW``-word windows found twice or more. Texts without a repeated window stop at the distinct count."""
    grams = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    some = _let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), _covered(g)).otherwise(0))
    return F.when(n >= WINDOW, some).otherwise(0)


def counts(text: Column) -> Column:
    """The struct of the five counts of a text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")

    def of(hashes: Column) -> Column:
        n = F.size(hashes)
        return F.struct(n.cast("long").alias("n_words"), repeat_words(hashes, n).cast("long").alias("n_repeat_words"))

    return F.struct(
        _let(F.transform(words, lambda w: F.xxhash64(w)), of).alias("w"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )


def measured(docs: DataFrame) -> DataFrame:
    """docs(row with text and source) -> row, m (the struct of counts) and failed, the base verdict."""
    failed = (F.col("m.w.n_words") < MIN_WORDS) | (100 * F.col("m.w.n_repeat_words") > REPEAT_PERCENT * F.col("m.w.n_words"))
    return docs.select("row", counts(F.col("row.text")).alias("m")).withColumn("failed", failed)


def host_verdicts(rows: DataFrame) -> DataFrame:
    """rows(host, failed) -> host, rate (shrunk), rejected. One row for each host."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("f"))
    prior = hosts.agg((F.sum("f") / F.sum("n")).alias("m"), (F.sum(F.col("f") * F.col("f") / F.col("n")) / F.sum("n")).alias("m2"))
    prior = prior.select("m", F.greatest(F.col("m2") - F.col("m") * F.col("m"), F.lit(1e-12)).alias("v"))
    prior = prior.select("m", F.least(F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(1.0)), F.lit(MAX_STRENGTH)).alias("s"))
    rate = (F.col("f") + F.col("s") * F.col("m")) / (F.col("n") + F.col("s"))
    # the prior is one row
    return hosts.crossJoin(F.broadcast(prior)).select("host", rate.alias("rate"), ((rate > MAX_RATE) & (F.col("f") > F.col("m") * F.col("n"))).alias("rejected"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, the counts, base_failed, kept, host, host_rate; a row for each row."""
    m = measured(docs.select(F.struct("doc_id", "text", "source").alias("row")))
    rows = cut(m.select("row.doc_id", F.col("row.source").alias("host"), "m.w.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.w.n_repeat_words", F.col("failed").alias("base_failed")), "rules")
    hosts = cut(host_verdicts(rows.select("host", F.col("base_failed").alias("failed"))), "hosts").withColumnRenamed("host", "h")
    joined = rows.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left")
    return joined.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).alias("kept"), "host", F.round("rate", 9).alias("host_rate"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, columns as they came. Texts are measured once, and written with their verdicts."""
    rows = cut(measured(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))).select("row", "failed"), "measured")
    hosts = cut(host_verdicts(rows.select(F.col("row.source").alias("host"), "failed")), "hosts")
    return rows.where("not failed").join(hosts.where("rejected").select("host"), F.col("row.source").eqNullSafe(F.col("host")), "left_anti").select("row.*")
