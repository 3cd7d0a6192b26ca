"""Substring dedup by hashing lines and passages.

Units are normalised (words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case), their digests grouped globally, the earliest
occurrence by (doc_id, text hash, place) is kept, and the rest is removed; spans name the original offsets. There are two kinds of
unit. Lines of at least ``MIN_LINE_WORDS`` words are the plain form of the method. Repeated passages mostly begin and end
inside longer lines, where hashes of whole lines cannot meet, so that windows of ``GRAM`` words, chosen by winnowing, are
units too: any repeated passage of ``MIN_WORDS`` words holds one. What the digests propose is compared word by word with
the earliest occurrence and extended both ways; runs of whole lines count from ``MIN_LINE_WORDS`` words, passages from ``MIN_WORDS`` words up.

Defined results: text null: stays null, no spans. doc_id null: left alone, and no source. A document is a doc_id with a
text: rows that repeat both count once and get the same result, rows that share a doc_id but not the text are documents of
their own, earlier and later by the hashes of their texts. Extra columns pass through, whatever their names; where one is
called ``spans``, the operator's own column is ``spans_``. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WordHashes, hash_words, ngrams, split_words
from .work import cut, forget, free, grown, keyed

MIN_LINE_WORDS = 20
MIN_WORDS = 50
GRAM = 25
SPANS = "array<struct<start:int,end:int,src_doc_id:bigint,src_start:int>>"


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the minima of all windows, the last of equal ones; with fewer hashes than a window, the least of all.

    A hash is the minimum of some window if the greatest of the minima of its windows equals it.
    """
    if not len(h):
        return np.empty(0, np.int64)
    window = min(window, len(h))
    low = np.uint64((1 << 20) - 1)
    keys = (h & ~low) | (low - (np.arange(len(h), dtype=np.uint64) & low))
    least = _sliding(keys, window, np.minimum, ~np.uint64(0))
    edge = np.zeros(window - 1, np.uint64)
    return np.nonzero(_sliding(np.concatenate([edge, least, edge]), window, np.maximum, np.uint64(0)) == keys)[0]


def _sliding(x: np.ndarray, window: int, pick: np.ufunc, neutral: np.uint64) -> np.ndarray:
    """pick over each window, from running picks forwards and backwards within blocks of its length."""
    if window == 1:
        return x
    blocks = np.append(x, np.full(-len(x) % window, neutral)).reshape(-1, window)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - window + 1
    return pick(back[:n], ahead[window - 1 : window - 1 + n])


def units(docs: DataFrame, gram: int = GRAM, min_words: int = MIN_WORDS, min_line: int = MIN_LINE_WORDS) -> DataFrame:
    """docs(doc_id, th, text) -> doc_id, th, pos (number of the first word), digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, hashes, places, digests = [], [], [], []
                for doc_id, th, text in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    words, counts = [], []
                    for line in (text or "").split("\n"):
                        found = split_words(line)
                        words += found
                        counts.append(len(found))
                    h = hash_words(words, cache)
                    ends = np.cumsum(counts)
                    long_lines = [(e - n, e) for e, n in zip(ends.tolist(), counts, strict=True) if n >= min_line]
                    got = [xxhash.xxh3_64_intdigest(h[a:b].tobytes(), 1) for a, b in long_lines]
                    where = [a for a, _ in long_lines]
                    if len(h) >= min_words:
                        grams = ngrams(h, gram)
                        chosen = winnow(grams, min_words - gram + 1)
                        where += chosen.tolist()
                        got += grams[chosen].tolist()
                    ids.append(np.full(len(where), doc_id, np.int64))
                    hashes.append(np.full(len(where), th, np.int64))
                    places.append(np.array(where, np.int32))
                    digests.append(np.array(got, np.uint64).view(np.int64))
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, hashes, places, digests)], ["doc_id", "th", "pos", "digest"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, pos int, digest long")


def _runs(own: np.ndarray, src: np.ndarray, shift: int, anchors: list[int], least: int) -> list[tuple[int, int]]:
    """Word runs [a, b) of own that equal src at a - shift, hold an anchor and have ``least`` words."""
    lo, hi = max(0, shift), min(len(own), len(src) + shift)
    same = own[lo:hi] == src[lo - shift : hi - shift]
    breaks = np.concatenate([[-1], np.nonzero(~same)[0], [len(same)]]) + lo
    out = set()
    for p in anchors:
        k = np.searchsorted(breaks, p, "right")
        a, b = int(breaks[k - 1]) + 1, int(breaks[k]) if k < len(breaks) else hi
        if a <= p < b and b - a >= least:
            out.add((a, b))
    return sorted(out)


def _matches(rows: DataFrame, min_words: int, min_line: int) -> DataFrame:
    """rows(doc_id, th, text, src_doc_id, src_th, src_text, seeds) -> doc_id, th, start, end, src_doc_id, src_start in characters."""

    def words_of(text: str, cache: WordHashes):
        data = text.encode("utf-8", "surrogatepass")
        raw = np.frombuffer(data, np.uint8)
        inside = np.concatenate([[False], ~((raw == 32) | ((raw >= 9) & (raw <= 13))), [False]])
        edges = np.nonzero(inside[1:] != inside[:-1])[0]
        spans = edges.reshape(-1, 2)
        # bytes to characters: continuation bytes do not count
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        line = np.searchsorted(np.nonzero(raw == 10)[0], spans[:, 0])
        return hash_words(data.lower().split(), cache), chars[spans], line

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, of, src = WordHashes(), None, None
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(i) for i in range(7)]
            for i in range(batch.num_rows):
                doc_id, th, text, src_id, src_th, src_text, seeds = (c[i].as_py() for c in columns)
                if (src_id, src_th) != of:
                    of, src = (src_id, src_th), words_of(src_text, cache)
                own = src if (doc_id, th) == of else words_of(text, cache)
                by_shift: dict[int, list[int]] = {}
                for seed in seeds:
                    by_shift.setdefault(seed["shift"], []).append(seed["pos"])
                spans = set()
                for shift, anchors in by_shift.items():
                    spans.update((a, b, shift) for a, b in _runs(own[0], src[0], shift, anchors, min(min_words, min_line)))
                for a, b, shift in spans:
                    if b - a < min_words:
                        # short of a passage, only whole lines count
                        lines = own[2]
                        a, b = (x for x in (np.searchsorted(lines, lines[a]) if a == 0 or lines[a - 1] != lines[a] else np.searchsorted(lines, lines[a], "right"), np.searchsorted(lines, lines[b - 1], "right") if b == len(lines) or lines[b] != lines[b - 1] else np.searchsorted(lines, lines[b - 1])))
                        if b - a < min_line:
                            continue
                    out.append((doc_id, th, int(own[1][a][0]), int(own[1][b - 1][1]), src_id, int(src[1][a - shift][0])))
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "th", "start", "end", "src_doc_id", "src_start"), r, strict=True)) for r in out], pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("src_doc_id", pa.int64()), ("src_start", pa.int32())]))

    return rows.select("doc_id", "th", "text", "src_doc_id", "src_th", "src_text", "seeds").mapInArrow(run, "doc_id long, th long, start int, end int, src_doc_id long, src_start int")


def repeated_spans(docs: DataFrame, gram: int = GRAM, min_words: int = MIN_WORDS, min_line: int = MIN_LINE_WORDS) -> DataFrame:
    """documents -> doc_id, th (hash of the text), start, end, src_doc_id, src_start: character spans that repeat an earlier place."""
    plain = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    found = cut(units(plain, gram, min_words, min_line), "units")
    place = F.struct("doc_id", "th", "pos")
    first = cut(found.groupBy("digest").agg(F.min(place).alias("src"), F.count("*").alias("n")).where("n > 1").select("digest", "src"), "sources")
    later = found.join(grown(first), "digest").where(place > F.col("src"))
    seed = F.struct(F.col("pos"), (F.col("pos") - F.col("src.pos")).alias("shift"))
    seeds = cut(later.groupBy("doc_id", "th", F.col("src.doc_id").alias("src_doc_id"), F.col("src.th").alias("src_th")).agg(F.collect_set(seed).alias("seeds")), "seeds")
    forget(found)
    wanted = seeds.select("doc_id", "th").union(seeds.select("src_doc_id", "src_th")).distinct()
    texts = cut(plain.join(grown(wanted), ["doc_id", "th"], "left_semi").groupBy("doc_id", "th").agg(F.min("text").alias("text")), "texts")
    sources = texts.toDF("src_doc_id", "src_th", "src_text")
    rows = seeds.join(grown(texts), ["doc_id", "th"]).join(grown(sources), ["src_doc_id", "src_th"])
    return _matches(rows, min_words, min_line)


def _without_spans(docs: DataFrame, gram: int, min_words: int, min_line: int) -> DataFrame:
    """documents -> row (as it came, but for the text) and spans."""
    spans = repeated_spans(docs, gram, min_words, min_line)
    # a span that several sources have is the earliest one's
    spans = spans.groupBy("doc_id", "th", "start", "end").agg(F.min(F.struct("src_doc_id", "src_start")).alias("src"))
    span = F.struct("start", "end", "src.src_doc_id", "src.src_start")
    by_doc = cut(spans.groupBy(F.col("doc_id").alias("did"), "th").agg(F.array_sort(F.collect_list(span)).alias("spans")), "spans")
    joined = keyed(docs).join(grown(by_doc), ["did", "th"], "left")
    # what stands between the spans, in order; spans may overlap
    old = F.col("row.text")
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("kept"))

    def step(acc, span):
        piece = F.substring(old, acc["at"] + 1, F.greatest(span["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), F.when(span["start"] > acc["at"], F.concat(acc["kept"], F.array(piece))).otherwise(acc["kept"]).alias("kept"))

    text = F.aggregate("spans", state, step, lambda acc: F.concat(F.array_join(acc["kept"], ""), F.substring(old, acc["at"] + 1, F.length(old))))
    text = F.when(F.col("spans").isNull(), old).otherwise(text)
    return joined.select(F.col("row").withField("text", text).alias("row"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def dedup_substrings(docs: DataFrame, gram: int = GRAM, min_words: int = MIN_WORDS, min_line: int = MIN_LINE_WORDS) -> DataFrame:
    """documents -> the same rows and columns, text without the repeated spans, and spans (original offsets, sorted)."""
    return _without_spans(docs, gram, min_words, min_line).select("row.*", F.col("spans").alias(free(docs, "spans")))


def without_repeats(docs: DataFrame, gram: int = GRAM, min_words: int = MIN_WORDS, min_line: int = MIN_LINE_WORDS) -> DataFrame:
    """The documents, columns as they came, each text without its repeated spans."""
    return _without_spans(docs, gram, min_words, min_line).select("row.*")
