"""Hard negatives by Four-Russians scoring.

Vectors become whole numbers, ``floor(256 * x)``. Candidates are stored in blocks as packed bit planes: for each plane of the
two's complement and each group of eight dimensions one byte. For each anchor and group a table of 256 holds the sum of every
subset of the anchor's eight components, so that a plane's share of a score is one lookup a group; the planes are shifted
and added from the highest (the sign) down. Scores are full and exact; no candidate is left out.

A first pass finds each anchor's best rows of its own label, a second one, with these scores known, the rows of other labels
inside each positive's window. Blocks of anchors meet blocks of candidates in a join on the block's number: a task holds one
of each, and passes on no more rows of a pair of blocks than the result may need. Both blocks are of fixed size, so that
the memory of a task does not grow; the work is anchors times candidates, as every candidate is scored.

Defined results: rows with a null id, a null label, a null vector, a null or non-finite component, no components, or a
component whose whole number needs more than ``BITS`` bits take no part; so all scores fit 64 bits. Vectors of
another length than the anchor's are no candidates. Rows equal in id, label and whole numbers count once; other rows of an
anchor's own id are no candidates for it; each row of a shared id is an anchor for itself. Ties go to the smaller vec_id.
Extra columns are ignored, whatever their names. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import cut, forget, grown

#: Rows of a block of candidates, anchors of a block, anchors scored at a time.
ROWS, ANCHORS, AT_A_TIME = 8192, 1024, 64
#: Components up to which a block holds so many rows.
WIDE = 256
#: Bits of a whole number, with its sign.
BITS = 28
GROUP = 8
POSITIVES, NEGATIVES = 5, 10
#: A negative's score, in hundredths of the positive's.
LOW, HIGH = 30, 90


def pack(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers (rows x dims) -> bytes (planes x groups x rows), the lowest plane first, the sign's plane last."""
    rows, dims = numbers.shape
    planes = int(max(numbers.max(initial=0), ~numbers.min(initial=0))).bit_length() + 1
    padded = np.zeros((rows, -(-dims // GROUP) * GROUP), np.int64)
    padded[:, :dims] = numbers
    return np.stack([np.packbits((padded >> b & 1).astype(np.uint8), axis=1, bitorder="little").T for b in range(planes)])


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Whole numbers (anchors x dims) -> tables (groups x 256 x anchors): the sum of each subset of eight components."""
    n, dims = anchors.shape
    padded = np.zeros((n, -(-dims // GROUP) * GROUP), np.int64)
    padded[:, :dims] = anchors
    parts = padded.reshape(n, -1, GROUP).transpose(1, 2, 0)
    tables = np.zeros((parts.shape[0], 1 << GROUP, n), np.int64)
    for d in range(GROUP):
        tables[:, 1 << d : 2 << d] = tables[:, : 1 << d] + parts[:, d, None]
    return tables


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Inner products (rows x anchors) of packed candidates and anchors given as tables."""
    high, groups, rows = planes.shape
    # half the width where no sum can leave it
    most = int(np.abs(tables).max(axis=1).sum(axis=0).max(initial=0)) << high
    tables = tables.astype(np.int32) if most < 1 << 31 else tables
    total = np.zeros((rows, tables.shape[2]), tables.dtype)
    for b in range(high - 1, -1, -1):
        total <<= 1
        for g in range(groups):
            if b == high - 1:
                total -= tables[g][planes[b, g]]
            else:
                total += tables[g][planes[b, g]]
    return total


def usable(embeddings: DataFrame, column: str = "embedding", flip: int | None = 7, labels: int = 10) -> DataFrame:
    """vec_id, label, dim, nums (array<int>) of the rows that take part, each once; where vec_id is divisible by ``flip``
    the label is the next of so many ``labels``."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(column).cast("array<double>").alias("vec"))
    limit = float(1 << (BITS - 1))
    # beyond the largest number, 256 * x is infinite, and fails too
    fits = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (x * 256 >= -limit) & (x * 256 < limit))
    rows = rows.where("vec_id is not null and label is not null and vec is not null").where((F.size("vec") > 0) & fits)
    label = F.when(F.col("vec_id") % flip == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")) if flip else F.col("label")
    rows = rows.select("vec_id", label.alias("label"), F.size("vec").alias("dim"), F.transform("vec", lambda x: F.floor(x * 256).cast("int")).alias("nums"))
    return rows.dropDuplicates(["vec_id", "label", "nums"])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _parts(rows: DataFrame, size: int) -> int:
    """Blocks into which the rows of one length go: ``size`` rows of ``WIDE`` components, or as many fewer longer ones."""
    weight = F.count("*") * F.greatest(F.first("dim"), F.lit(WIDE)) / WIDE
    return int(rows.groupBy("dim").agg(weight.alias("c")).agg(F.coalesce(F.max("c"), F.lit(0.0))).collect()[0][0] // size) + 1


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows(vec_id, label, dim, nums) -> dim, block, n, ids, labels, planes: candidates in blocks of about ``size``, by label."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["label", "vec_id"], ignore_index=True)
        planes = pack(_matrix(pdf["nums"]))
        one = {"dim": int(pdf["dim"].iloc[0]), "block": int(pdf["block"].iloc[0]), "n": len(pdf), "ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "labels": pdf["label"].to_numpy(np.int64).tobytes(), "high": planes.shape[0], "planes": planes.tobytes()}
        return pd.DataFrame([one])

    at = F.pmod(F.xxhash64("nums", "vec_id", "label"), F.lit(_parts(rows, size))).cast("int")
    rows = rows.withColumn("block", at)
    return rows.groupBy("dim", "block").applyInPandas(run, "dim int, block int, n int, ids binary, labels binary, high int, planes binary")


def _met(anchors: DataFrame, candidates: DataFrame, size: int) -> DataFrame:
    """Each block of anchors (dim, ablock, as_: the anchors' structs) with each block of candidates of its length."""
    at = F.pmod(F.xxhash64("akey"), F.lit(_parts(anchors, size))).cast("int")
    own = F.struct(*[c for c in anchors.columns if c != "dim"])
    groups = anchors.groupBy("dim", at.alias("ablock")).agg(F.collect_list(own).alias("as_"))
    shards = candidates.select("dim", "block")
    # which candidates there are is met by number first, then the blocks themselves are dealt by number
    wide = groups.join(grown(shards), "dim")
    return wide.join(grown(candidates), ["dim", "block"]).select("dim", "as_", "n", "ids", "labels", "high", "planes")


def _block(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(r.planes, np.uint8).reshape(r.high, -(-r.dim // GROUP), r.n)
    return np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64), planes


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by score descending, then id."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.nonzero(score >= least)[0]
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some].astype(np.int64)))[:k]]


def positives(anchors: DataFrame, candidates: DataFrame, k: int = POSITIVES, size: int = ANCHORS) -> DataFrame:
    """anchors(akey, vec_id, label, dim, nums) -> akey, positive_id, positive_score: the k first others of the label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                ids, labels, planes = _block(r)
                by_label: dict[int, list] = {}
                for a in r.as_:
                    by_label.setdefault(a["label"], []).append(a)
                for label, group in by_label.items():
                    lo, hi = np.searchsorted(labels, [label, label + 1])
                    if lo == hi:
                        continue
                    mine, own = np.ascontiguousarray(planes[:, :, lo:hi]), ids[lo:hi]
                    for at in range(0, len(group), AT_A_TIME):
                        some = group[at : at + AT_A_TIME]
                        found = scores(mine, subset_sums(np.array([a["nums"] for a in some], np.int64)))
                        out = []
                        for j, a in enumerate(some):
                            other = np.nonzero(own != a["vec_id"])[0]
                            first = other[_first(found[other, j], own[other], k)]
                            out.append(pd.DataFrame({"akey": a["akey"], "positive_id": own[first], "positive_score": found[first, j].astype(np.int64)}))
                        yield pd.concat(out)

    found = _met(anchors, candidates, size).mapInPandas(run, "akey long, positive_id long, positive_score long")
    order = Window.partitionBy("akey").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def negatives(anchors: DataFrame, candidates: DataFrame, k: int = NEGATIVES, low: int = LOW, high: int = HIGH, size: int = ANCHORS) -> DataFrame:
    """anchors(akey, vec_id, label, dim, nums, marks: array of positive scores) -> akey, mark, rank, negative_id,
    negative_score: for each mark the k first rows of other labels inside its window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                ids, labels, planes = _block(r)
                for at in range(0, len(r.as_), AT_A_TIME):
                    some = r.as_[at : at + AT_A_TIME]
                    found = scores(planes, subset_sums(np.array([a["nums"] for a in some], np.int64)))
                    out = []
                    for j, a in enumerate(some):
                        marks = [int(m) for m in a["marks"]]
                        score = found[:, j]
                        # -(-x // 100) is x / 100 rounded up
                        least = min(-(-low * m // 100) for m in marks)
                        near = np.nonzero((score >= least) & (labels != a["label"]) & (ids != a["vec_id"]))[0]
                        near = near[np.lexsort((ids[near], -score[near].astype(np.int64)))]
                        inside = score[near]
                        for m in marks:
                            start = np.searchsorted(-inside.astype(np.int64), -(high * m // 100))
                            first = near[start : start + k]
                            first = first[score[first] >= -(-low * m // 100)]
                            if len(first):
                                out.append(pd.DataFrame({"akey": a["akey"], "mark": m, "negative_id": ids[first], "negative_score": score[first].astype(np.int64)}))
                    if out:
                        yield pd.concat(out)

    found = _met(anchors, candidates, size).mapInPandas(run, "akey long, mark long, negative_id long, negative_score long")
    order = Window.partitionBy("akey", "mark").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, every: int = 100, column: str = "embedding", flip: int | None = 7, block_rows: int = ROWS, block_anchors: int = ANCHORS) -> DataFrame:
    """embeddings -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are the rows with
    vec_id divisible by ``every``."""
    rows = cut(usable(embeddings, column, flip), "whole")
    candidates = cut(blocks(rows, block_rows), "planes")
    # numbered as they are written, so that the numbers stand
    anchors = cut(rows.where(F.col("vec_id") % every == 0).withColumn("akey", F.monotonically_increasing_id()), "anchors")
    best = cut(positives(anchors, candidates, size=block_anchors), "positives")
    marks = best.groupBy("akey").agg(F.collect_set("positive_score").alias("marks"))
    found = cut(negatives(anchors.join(grown(marks), "akey"), candidates, size=block_anchors), "negatives")
    for done in (rows, candidates):
        forget(done)
    own = best.join(grown(anchors.select("akey", F.col("vec_id").alias("anchor_id"))), "akey")
    pairs = own.join(grown(found.withColumnRenamed("mark", "positive_score")), ["akey", "positive_score"])
    return pairs.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
