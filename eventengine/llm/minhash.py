"""Near-duplicates by circulant MinHash.

Two permutations of the 32-bit universe make all signature coordinates: the first scatters the shingles, the second is
read at circularly shifted places, once for each coordinate. Bands of coordinates propose pairs, and the full shingle
sets decide. With 32 bands of 5, a pair at the threshold of 0.85 shares no band with a probability under 1e-8, one at 0.80
under 4e-6.

Documents with equal sets form one class, a node with a number of its own; only classes are banded. In a bucket, pairs are
never emitted all against all: a round takes a few centres, pairs them with the members not yet connected to them, verifies,
and merges components; a bucket is done when its members are connected or each unconnected pair has been verified or ruled
out by a bound on its intersection. So no link is lost, and a large group of copies costs about as many pairs as it has
members.

Defined results: text null or without words: n_shingles 0, linked with nothing, kept. doc_id null: linked with nothing,
component_id null, kept. A document is a doc_id with a text: repeated rows get the same result, and rows that share a doc_id
but not the text are linked by their own texts only. Extra columns are ignored (or kept by :func:`keep_one`, whatever their
names). No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components, joined
from .words import WordHashes, hash_words, mix, ngrams, split_words
from .work import cut, grown, keyed

BANDS, ROWS = 32, 5
SHINGLE = 5
#: 100 * intersection >= THRESHOLD * union
THRESHOLD = 85
#: Centres of a bucket in the second round; each further round takes as many times more.
CENTRES = 128
#: Shingles handled at a time in numpy, so that they stay in the CPU's cache.
BLOCK = 1 << 14


def _permute(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def shingle_set(text: str | None, cache: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(ngrams(hash_words(split_words(text), cache), n))


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """A row of coordinates for each of the (non-empty) sets."""
    out = np.empty((len(sets), coordinates), np.uint32)
    at = 0
    while at < len(sets):
        to, total = at, 0
        while to < len(sets) and (to == at or total + len(sets[to]) <= BLOCK):
            total += len(sets[to])
            to += 1
        starts = np.cumsum([0, *(len(s) for s in sets[at : to - 1])])
        scattered = _permute((np.concatenate(sets[at:to]) >> np.uint64(32)).astype(np.uint32) ^ np.uint32(0x5BD1E995))
        for k in range(coordinates):
            out[at:to, k] = np.minimum.reduceat(_permute(scattered + np.uint32(k)), starts)
        at = to
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(rows):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return acc.view(np.int64)


def features(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """documents -> doc_id, th (hash of the text), n_shingles, set_key (digest of the set; null when empty), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(t, cache, shingle) for t in part.column(2).to_pylist()]
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(signatures(full, bands * rows), bands, rows)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "th", "n_shingles", "set_key", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, n_shingles long, set_key binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: int, shingle: int) -> DataFrame:
    """pairs(a, b) of nodes whose full sets reach the threshold. texts(rep, text) holds each node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, of, last = WordHashes(), None, None
        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            good = []
            for i in range(batch.num_rows):
                if (key := a[i].as_py()) != of:
                    of, last = key, shingle_set(ta[i].as_py(), cache, shingle)
                other = shingle_set(tb[i].as_py(), cache, shingle)
                both = len(np.intersect1d(last, other, assume_unique=True))
                good.append(100 * both >= threshold * (len(last) + len(other) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["u", "v"])

    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    rows = pairs.join(grown(right), "b").join(grown(left), "a").select("a", "b", "ta", "tb")
    return rows.mapInArrow(run, "u long, v long")


def _shingles(texts: DataFrame, shingle: int) -> DataFrame:
    """texts(rep, text) -> rep, hash; a row for each element of a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for rep, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingle_set(text.as_py(), cache, shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), rep, np.int64)), pa.array(found)], ["rep", "hash"])

    return texts.mapInArrow(run, "rep long, hash long")


def linkable(members: DataFrame, texts: DataFrame, threshold: int, shingle: int) -> DataFrame:
    """members(rep, n) that may still reach the threshold with another member -> rep, n, shared.

    A shingle that no other member has is in no intersection, so ``shared``, the size of a set without these, bounds each
    intersection; a member with 100 * shared < threshold * n has no partner.
    """
    own = members.select("rep", "n").distinct()
    sets = cut(_shingles(texts.join(grown(own.select("rep")), "rep", "left_semi"), shingle), "shingles")
    common = sets.groupBy("hash").agg(F.count("*").alias("df")).where("df > 1").select("hash")
    shared = sets.join(grown(common), "hash").groupBy("rep").agg(F.count("*").alias("shared"))
    return cut(own.join(grown(shared), "rep").where(F.col("shared") * 100 >= F.col("n") * threshold), "linkable")


def _labelled(docs: DataFrame, threshold: int, bands: int, rows: int, shingle: int) -> DataFrame:
    """documents -> doc_id, th, n_shingles, component_id (null without a set or an id); a row for each row."""
    feat = cut(features(docs, bands, rows, shingle), "minhash")
    least = F.min(F.struct("doc_id", "th"))
    classes = feat.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(least.alias("least"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    # numbered as they are written, so that the numbers stand; equal sets have equal bands
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    buckets = classes.select("rep", F.col("least.doc_id").alias("d"), "n", F.explode("bands").alias("key"))
    # what is counted by bucket is written before it is joined, so that Spark can split the join of a large bucket
    crowded = cut(buckets.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "crowded")
    active = cut(buckets.join(grown(crowded), "key").select("key", "rep", "d", "n"), "buckets")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    wanted = classes.select("rep", "least.doc_id", "least.th").join(grown(active.select("rep").distinct()), "rep", "left_semi")
    # the text of the least document of a class, once where its row is repeated
    texts = cut(plain.join(grown(wanted), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("rep", "text"), "texts")

    # first round: one centre for each bucket, its earliest document, as copies mostly come after what they are copies of
    heads = cut(active.groupBy("key").agg(F.min(F.struct("d", "rep", "n")).alias("head")).select("key", F.col("head.rep").alias("a"), F.col("head.n").alias("an")), "centres")
    pairs = active.join(grown(heads), "key").where(F.col("rep") != F.col("a")).where(100 * F.least("n", "an") >= threshold * F.greatest("n", "an"))
    pairs = pairs.select("a", F.col("rep").alias("b")).distinct()
    links = cut(verified(pairs, texts, threshold, shingle), "found")
    comps = components(links)

    def open_buckets(members: DataFrame) -> DataFrame:
        """Of the members with their components, those in buckets where two are unconnected."""
        named = members.join(grown(comps.withColumnRenamed("node", "rep")), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
        still = cut(named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "open")
        return cut(named.join(grown(still), "key"), "members")

    members = open_buckets(active)
    if not members.isEmpty():
        able = linkable(members, texts, threshold, shingle)
        codes = F.transform("bands", lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int"))
        few = classes.select("rep", F.col("least.doc_id").alias("d"), "bands").join(grown(able), "rep")
        members = open_buckets(few.select("rep", "d", "n", "shared", codes.alias("codes"), F.posexplode("bands").alias("band", "key")))
    centres = CENTRES
    while not members.isEmpty():
        slot = F.pmod(F.xxhash64("rep", F.lit(centres)), F.lit(centres))
        mine = ["rep", "d", "n", "shared", "comp", "codes"]
        placed = members.withColumn("slot", slot)
        heads = cut(placed.groupBy("key", "slot").agg(F.min_by(F.struct(*mine), F.struct("d", "rep")).alias("c")), "centres")
        first = heads.select("key", "slot", F.col("c.rep").alias("first"))
        members = cut(placed.join(grown(first), ["key", "slot"]).withColumn("is_centre", F.col("rep") == F.col("first")).drop("slot", "first"), "members")
        least = F.least(F.col("shared"), F.col("c.shared"))
        possible = (
            (F.col("comp") != F.col("c.comp"))
            # two centres meet once
            & (~F.col("is_centre") | (F.col("c.rep") < F.col("rep")))
            & (100 * F.least("n", "c.n") >= threshold * F.greatest("n", "c.n"))
            & (100 * least >= threshold * (F.col("n") + F.col("c.n") - least))
            # a pair comes from the first of the bands that it shares
            & (F.array_position(F.zip_with("codes", "c.codes", lambda x, y: x == y), True) == F.col("band") + 1)
        )
        pairs = members.join(grown(heads.select("key", "c")), "key").where(possible).select(F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b")).distinct()
        found = cut(verified(pairs, texts, threshold, shingle), "found")
        if not found.isEmpty():
            comps = joined(comps, found)
        members, centres = open_buckets(members.where("not is_centre").drop("comp", "is_centre")), centres * CENTRES

    placed = classes.select("set_key", "rep", "least.doc_id").join(grown(comps.withColumnRenamed("node", "rep")), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    placed = cut(placed.select("set_key", "comp", "doc_id"), "placed")
    named = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    label = cut(placed.join(grown(named), "comp").select("set_key", "component_id"), "labels")
    found = feat.select("doc_id", "th", "n_shingles", "set_key").join(grown(label), "set_key", "left")
    return found.select("doc_id", "th", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """documents -> doc_id, n_shingles, component_id, kept; a row for each row."""
    component = F.coalesce("component_id", "doc_id")
    return _labelled(docs, threshold, bands, rows, shingle).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The documents, one row of each group of near-duplicates: that with the smallest doc_id, then the least hash of the
    text; of rows that repeat both, any one. Rows without words or without an id stay. Columns as they came."""
    found = cut(_labelled(docs, threshold, BANDS, ROWS, SHINGLE).where("component_id is not null"), "labelled")
    first = cut(found.groupBy("component_id").agg(F.min(F.struct("doc_id", "th")).alias("first")), "firsts").select("first.doc_id", "first.th", F.lit(True).alias("first"))
    # each document once, with whether it is the first of its group
    verdict = cut(found.select("doc_id", "th").distinct().join(grown(first), ["doc_id", "th"], "left").select(F.col("doc_id").alias("did"), "th", F.coalesce("first", F.lit(False)).alias("first")), "verdicts")
    rows = keyed(docs).join(grown(verdict), ["did", "th"], "left")
    again = F.row_number().over(Window.partitionBy("did", "th").orderBy("did"))
    return rows.where("first is null or first").withColumn("again", again).where("first is null or again = 1").select("row.*")
