"""Jaccard join of documents by the product of the document by n-gram incidence matrix with its transpose.

A row of the matrix is a distinct set of n-grams (documents with equal sets are one row), a column an n-gram's hash. The
matrix is worked on in two blocks of columns, the hashes up to ``LOW`` and those above. A set of n needs ``ceil(t * n)``
n-grams in common with any partner, so two partners that take their n - ceil(t * n) + 1 first n-grams by hash meet in a column
of these; only this part of the matrix, and of larger sets the rest of the low block, is spread out. Columns of one row are
dropped. Sizes then bound what is left:

- a set whose low n-grams in shared columns and all its high ones don't add up to ceil(t * n) has no partner, and goes;
- pairs of sets in columns of up to ``CROWD`` rows are multiplied out, and their overlaps are added up; a pair goes unless the
  overlap so far, what crowded columns can add, and the smaller of the two high parts reach the overlap that the sizes need;
- in the order of low columns that aren't crowded, crowded ones, and high ones, most sets have so many of the first kind that
  they meet their partners there; the others are looked for in as many of their crowded columns as this order asks for;
- sets that remain in crowded columns get the first bound again, counting n-grams in sets of other components only, with a
  second part of the matrix, up to ``MIDDLE``, spread out for them alone.

What remains is confirmed on full sets, and links make components. Of a set's candidates the best goes first, and of the rest
only those not connected by then are confirmed. In a crowded column pairs are never multiplied out all against all: a round
multiplies the column's rows with a few of them, the centres, drops pairs whose parities over blocks of columns differ in more
places than two partners differ in n-grams, confirms, and merges components, until the rows are connected or all pairs of unconnected ones of fitting sizes have
been confirmed or refused. So no link is lost, and a large group of
near copies costs about as many pairs as it has members.

Defined results: text null or without words: n_shingles 0, linked with nothing. doc_id null: linked with nothing,
component_id null. Rows that share a doc_id but not the text are linked by their own texts. Extra columns are ignored,
whatever their names. Repeated rows get the same result. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components, joined
from .minhash import shingle_set, verified
from .words import WordHashes
from .work import cut, forget, grown, step

SHINGLE = 5
#: 100 * intersection >= THRESHOLD * union
THRESHOLD = 80
#: Ends of the low block of columns and of the second part, in hashes of 63 bits.
LOW, MIDDLE = 1 << 61, 1 << 62
#: Rows of a column that are multiplied with each other; columns of more are crowded.
CROWD = 16
#: Words of the sketch whose bits say which blocks of columns hold an odd number of a set's n-grams.
PARITY = [f"odd{k}" for k in range(8)]
#: Centres of a crowded column in the second round; each further round takes as many times more.
CENTRES = 128


def _sets(texts: pa.Array, cache: WordHashes, n: int) -> Iterator[np.ndarray]:
    """Sorted columns of each text's set, as numbers of 63 bits; two n-grams of a text on one column are one."""
    for text in texts:
        yield np.unique(shingle_set(text.as_py(), cache, n) >> np.uint64(1)).view(np.int64)


def _least(n: np.ndarray | int, threshold: int):
    """The smallest overlap of a set of n with any partner."""
    return -(-threshold * n // 100)


def rows_of(docs: DataFrame, threshold: int = THRESHOLD, n: int = SHINGLE) -> DataFrame:
    """documents -> doc_id, th (hash of the text), n_shingles, set_key (digest of the set; null when empty), low (n-grams in
    the low block), columns (the part that is spread out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, keys, lows, taken = [], [], [], []
                for found in (shingle_set(t.as_py(), cache, n) for t in part.column(2)):
                    sizes.append(size := len(found))
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()) if size else None)
                    found = (found >> np.uint64(1)).view(np.int64)
                    lows.append(low := int(np.searchsorted(found, LOW)))
                    taken.append(found[: max(low, size - _least(size, threshold) + 1)])
                ends = np.cumsum([0, *map(len, taken)]).astype(np.int32)
                columns = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*taken, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(lows, pa.int32()), columns], ["doc_id", "th", "n_shingles", "set_key", "low", "columns"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, n_shingles long, set_key binary, low int, columns array<long>")


def _second_part(texts: DataFrame, n: int) -> DataFrame:
    """texts(rep, text, comp) -> rep, comp, key: the n-grams between LOW and MIDDLE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for rep, comp, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _sets(batch.column(2), cache, n), strict=True):
                some = found[np.searchsorted(found, LOW) : np.searchsorted(found, MIDDLE)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), x, np.int64)) for x in (rep, comp)] + [pa.array(some)], ["rep", "comp", "key"])

    return texts.select("rep", "comp", "text").mapInArrow(run, "rep long, comp long, key long")


def _parities(texts: DataFrame, n: int) -> DataFrame:
    """texts(rep, text) -> rep and the columns ``PARITY``: whether the n-grams of the set in each of 512 equal blocks of all
    columns are odd in number, a bit for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            odd = np.array([np.bincount(found >> 54, minlength=512) & 1 for found in _sets(batch.column(1), cache, n)], np.uint8).reshape(-1, 512)
            words = np.packbits(odd, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(len(PARITY)))], ["rep", *PARITY])

    return texts.select("rep", "text").mapInArrow(run, ", ".join(f"{c} long" for c in ("rep", *PARITY)))


def multiplied(cells: DataFrame, threshold: int) -> DataFrame:
    """cells(key, rep, n, high, crowded) of columns that are not crowded -> a, b, overlap: the pairs that the bounds leave.

    ``high`` are the n-grams of the row's set above LOW, ``crowded`` its low cells in crowded columns.
    """
    row = F.struct("rep", "n", "high", "crowded")
    columns = cells.groupBy("key").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    one = columns.select("key", "rows", F.posexplode("rows").alias("at", "x"))
    pairs = one.select("key", "x", F.explode(F.slice("rows", F.col("at") + 2, CROWD)).alias("y"))
    pairs = pairs.where(100 * F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n"))
    # what of the overlap lies outside the columns multiplied here, for a pair of equal rows always the same
    rest = F.least("x.crowded", "y.crowded") + F.least("x.high", "y.high")
    pairs = pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), (F.col("x.n") + F.col("y.n")).alias("sizes"), rest.alias("rest"), (F.col("key") < LOW).cast("int").alias("one"))
    summed = pairs.groupBy("a", "b", "sizes", "rest").agg(F.sum("one").alias("overlap"))
    return summed.where((100 + threshold) * (F.col("overlap") + F.col("rest")) >= threshold * F.col("sizes")).select("a", "b", "overlap")


def _labelled(docs: DataFrame, threshold: int, shingle: int) -> DataFrame:
    """documents -> doc_id, n_shingles, component_id; a row for each row."""
    found = cut(rows_of(docs, threshold, shingle), "rows")
    classes = found.where("set_key is not null and doc_id is not null").groupBy("set_key")
    classes = classes.agg(F.min(F.struct("doc_id", "th")).alias("least"), F.first("columns").alias("columns"), F.first("n_shingles").alias("n"), F.first("low").alias("low"))
    # numbered as they are written, so that the numbers stand; equal sets have equal columns
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    labelled = cut(found.select("doc_id", "n_shingles", "set_key"), "labelled")
    forget(found)

    spread = classes.select("rep", F.explode("columns").alias("key"))
    # what is counted by column is written before it is joined, so that Spark can split the join of a crowded column
    shared = step(spread.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "columns")
    whole, classes = classes, cut(classes.drop("columns"), "classes")
    sizes = classes.select("rep", "n", (F.col("n") - F.col("low")).alias("high"), "least.doc_id", "least.th")
    of_set = Window.partitionBy("rep").orderBy("key")
    every = of_set.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = F.sum((F.col("key") < LOW).cast("int")).over(every)
    cells = spread.join(grown(shared), "key").withColumn("met", met).join(grown(sizes.select("rep", "n", "high")), "rep")
    some = cut(cells.where(100 * (F.col("met") + F.col("high")) >= threshold * F.col("n")).select("key", "rep", "n", "high"), "cells")
    for done in (whole, shared):
        forget(done)
    counts = step(some.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "columns")
    crowd = F.col("c") > CROWD
    kept = some.join(grown(counts), "key").withColumn("crowded", F.sum((crowd & (F.col("key") < LOW)).cast("int")).over(every))
    kept = cut(kept.withColumn("place", F.sum(crowd.cast("int")).over(of_set.rowsBetween(Window.unboundedPreceding, Window.currentRow))), "cells")
    for done in (some, counts):
        forget(done)
    # low columns that aren't crowded come first in a set's order, then the crowded ones: few sets need these to meet a partner
    first = F.col("n") - F.ceil(F.col("n") * threshold / F.lit(100)) + 1 - (F.col("n") - F.col("high") - F.col("crowded"))
    needed = cut(kept.where(crowd & (F.col("place") <= first)).select("key", "rep", "n"), "needed")
    few = kept.where(~crowd).select("key", "rep", "n", "high", "crowded")
    candidates = cut(multiplied(few, threshold), "candidates")

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    ends = candidates.select(F.col("a").alias("rep")).unionByName(candidates.select(F.col("b").alias("rep"))).unionByName(needed.select("rep")).distinct()
    wanted = sizes.select("rep", "doc_id", "th").join(grown(ends), "rep", "left_semi")
    # the text of the least document of a class, once where its row is repeated
    texts = cut(plain.join(grown(wanted), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("rep", "text"), "texts")

    best = candidates.groupBy("b").agg(F.max_by("a", F.struct("overlap", -F.col("a"))).alias("a")).select("a", "b")
    links = step(verified(best, texts, threshold, shingle), "links")
    comps = components(links)
    named = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    apart = candidates.join(grown(named("a")), "a", "left").join(grown(named("b")), "b", "left")
    apart = apart.where(F.coalesce("a_component", "a") != F.coalesce("b_component", "b")).join(grown(best), ["a", "b"], "left_anti").select("a", "b")
    more = step(verified(step(apart, "apart"), texts, threshold, shingle), "links")
    if not more.isEmpty():
        comps = joined(comps, more)

    def open_columns(members: DataFrame) -> DataFrame:
        """Of the members with their components, those in columns where two are unconnected."""
        known = members.join(grown(comps.withColumnRenamed("node", "rep")), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
        still = step(known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "open")
        return step(known.join(grown(still), "key"), "members")

    members = open_columns(needed)
    if not members.isEmpty():
        # the bound of single sets again, over the low block and a second part that is spread out for these sets; an n-gram
        # counts that is in sets of two components
        own = members.groupBy("rep").agg(F.first("comp").alias("comp"))
        low = kept.where(F.col("key") < LOW).select("key", "rep").join(grown(own), "rep")
        part = cut(_second_part(texts.join(grown(own), "rep"), shingle).unionByName(low), "part")
        shared = step(part.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", F.lit(1).alias("met")), "columns")
        again = part.join(grown(shared), "key", "left").groupBy("rep").agg(F.sum(F.coalesce("met", F.lit(0))).alias("met"), F.sum((F.col("key") >= LOW).cast("int")).alias("second"))
        chosen = sizes.select("rep", "n", "high", F.col("doc_id").alias("d")).join(grown(again), "rep").where(100 * (F.col("met") + F.col("high") - F.col("second")) >= threshold * F.col("n"))
        chosen = step(chosen.select("rep", "d"), "chosen")
        forget(part)
        odd = _parities(texts.join(grown(chosen), "rep", "left_semi"), shingle)
        members = open_columns(members.drop("comp").join(grown(step(chosen.join(grown(odd), "rep"), "parities")), "rep"))
    centres = 1
    while not members.isEmpty():
        slot = F.pmod(F.xxhash64("rep", F.lit(centres)), F.lit(centres))
        heads = step(members.withColumn("slot", slot).groupBy("key", "slot").agg(F.min_by(F.struct("rep", "n", "comp", *PARITY), F.struct("d", "rep")).alias("c")), "centres")
        possible = (
            (F.col("comp") != F.col("c.comp"))
            & (100 * F.least("n", "c.n") >= threshold * F.greatest("n", "c.n"))
            # an n-gram of one set alone changes the parity of one block, so that the sets differ in so many at least
            & ((100 + threshold) * sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"c.{c}"))) for c in PARITY) <= (100 - threshold) * (F.col("n") + F.col("c.n")))
        )
        pairs = members.join(grown(heads.select("key", "c")), "key").where(possible).select(F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b")).distinct()
        more = step(verified(pairs, texts, threshold, shingle), "links")
        if not more.isEmpty():
            comps = joined(comps, more)
        done = heads.select("key", F.col("c.rep").alias("rep"))
        members, centres = open_columns(members.drop("comp").join(grown(done), ["key", "rep"], "left_anti")), centres * CENTRES

    placed = classes.select("set_key", "rep", "least.doc_id").join(grown(comps.withColumnRenamed("node", "rep")), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    placed = step(placed.select("set_key", "comp", "doc_id"), "placed")
    least = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    label = step(placed.join(grown(least), "comp").select("set_key", "component_id"), "labels")
    found = labelled.join(grown(label), "set_key", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def linked(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """documents -> doc_id, n_shingles, component_id; a row for each row."""
    return _labelled(docs, threshold, shingle)
