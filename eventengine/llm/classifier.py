"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of letters (of any script, as bytes above 127), runs of digits and runs of marks, with A-Z in lower case;
they are found and hashed in numpy, over the bytes of a text. Unigrams and bigrams hash into 2**BITS weights, and a text is
the vector of their counts at length one. Training takes labelled documents, about ``SAMPLE`` of them at most (those with
the least hash of doc_id, whole texts), through one task; the weights have a fixed size. Scoring is a sparse dot product in
tasks, over whole texts.

Defined results: text null or without tokens: scored by the bias alone. doc_id null: never learned from, scored as any.
Several labels of one document: the highest. Several texts of one doc_id: the least is learned from, each row is scored. No
labels: weights of zero, score 0.5. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import mix

BITS = 18
SAMPLE = 8_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-5
#: Of each byte: 0 white space, 1 letter, 2 digit, 3 mark.
_KIND = np.array([0 if b <= 32 or b == 127 else 1 if chr(b).isalpha() or b > 127 else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)
#: Random factors of bytes, and odd ones of places in a token; the places repeat after 256.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_PLACE = mix(np.arange(1001, 1257, dtype=np.uint64)) | np.uint64(1)


def token_hashes(text: str | None) -> np.ndarray:
    """A hash for each token, in order."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8) if text else np.zeros(0, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    kind = _KIND[raw]
    starts = np.concatenate([[0], np.nonzero(kind[1:] != kind[:-1])[0] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(starts, append=len(raw)))
    sums = np.add.reduceat(_BYTE[raw] * _PLACE[place & 255], starts)
    return mix(sums[kind[starts] != 0])


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices (the last one is the bias) and values of a text."""
    h = token_hashes(text)
    grams = np.concatenate([h, (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]]) if len(h) else h
    placed = np.sort((grams >> np.uint64(64 - BITS)).astype(np.uint32))
    first = np.nonzero(np.diff(placed, prepend=np.uint32(0xFFFFFFFF)))[0]
    at, values = placed[first].astype(np.int64), np.diff(first, append=len(placed)).astype(np.float64)
    if len(values):
        values /= np.sqrt((values * values).sum())
    return np.append(at, 1 << BITS), np.append(values, 1.0)


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0))))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes in the given order, by per-coordinate updates."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, y in rows:
            w = weights(at)
            g = (sigmoid((w * x).sum()) - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from the labelled documents outside the held-out third."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(remainder(F.col("doc_id")) != 1)
    own = own.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(label).cast("int").alias("__y"))
    total = own.count()
    share = min(1.0, sample / max(total, 1))
    order = F.xxhash64("__id", F.lit(7))
    picked = own.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col("doc_id").cast("long").alias("__doc"), "text").join(F.broadcast(picked), F.col("__doc") == F.col("__id"))
    # one row for each picked document, however often its id is repeated
    rows = rows.groupBy("__id", "__y").agg(F.min("text").alias("text")).select("__y", "text", order.alias("__o")).repartition(1).sortWithinPartitions("__o", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(*features(t), y) for b in batches for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([ftrl(seen).tobytes()], pa.binary())], ["weights"])

    found = rows.mapInArrow(run, "weights binary").collect()  # one row of a fixed size
    return np.frombuffer(found[0]["weights"]) if found else np.zeros((1 << BITS) + 1)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """documents -> doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                scores = []
                for text in part.column(1).to_pylist():
                    at, x = features(text)
                    scores.append(sigmoid((w[at] * x).sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """documents, labels -> doc_id, held_out, score, predicted; a row for each document."""
    scored = score(docs, train(docs, labels, label))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
