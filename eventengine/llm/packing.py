"""Packing by Karmarkar-Karp multiway differencing.

Documents are tokenised in blocks of a bounded number of ids, as their partitions bring them. Within a block, runs of
``CAPACITY`` ids of long documents fill sequences of their own; what is left is put into k windows by differencing:
partial partitions, the most uneven first, are merged with their loads in opposite order, which leaves windows that are
nearly equal. k begins at the least count that can hold the ids and rises whenever a window exceeds the capacity.
What a partition has over when it ends is no whole block: its pieces stay open, and their lengths, without the ids, are
packed by differencing in blocks across partitions, so that padding does not grow with the number of partitions.
Blocks are numbered, and a table of windows per block turns block-wise into global sequence numbers.

Ids come from the tokenizers library's file, word by word through a bounded cache: the normaliser and the pre-tokeniser of
that file work on each run between white space by itself, so that this gives the ids of the whole text.

Defined results: text null: as the empty text, so that the document has its end id alone. Repeated rows are documents of
their own. doc_id null: packed as any. Extra columns are ignored. No rows: no rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .work import cut, grown

CAPACITY = 4096
END_ID = 2
#: Ids in a block, beyond those of its last document.
BLOCK_IDS = 256 * CAPACITY
CACHE = 400_000
_CONTROLS = "\x1c\x1d\x1e\x1f\x85"
_SPACE = re.compile(r"[ \t\n\r]+")
#: Latin letters, each of them one character whatever its case and normal form; and ASCII marks that start no contraction.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: piece: numbers the open pieces, null for placed ones
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, block long, window long, offset long, piece long"
#: Blocks across partitions have numbers from here on.
SECOND = 1 << 62


def _byte_letters() -> dict[int, int]:
    """How byte-level BPE writes each byte as a letter: printable ones as themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class WordIds(dict):
    """A run between white space -> its ids, as little-endian unsigned 32-bit numbers.

    The pre-tokeniser parts plain words from the marks behind them; each part then goes to the BPE model as it is. All else
    takes the whole way through the tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.parts: dict[str, bytes] = {}

    def part(self, text: str) -> bytes:
        ids = self.parts.get(text)
        if ids is None:
            if len(self.parts) >= CACHE:
                self.parts.clear()
            written = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
            self.parts[text] = ids = b"".join([self.bytes_of[x.id] for x in self.model.tokenize(written)])
        return ids

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        core = word.rstrip(_MARKS)
        if len(word) <= 64 and (core.isalpha() if core.isascii() else _LATIN.fullmatch(core)):
            ids = self.part(core.lower())
            if len(core) < len(word):
                ids += self.part(word[len(core) :])
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for each worker process, so that its cache outlives a task."""
    return WordIds(path)


def tokens(text: str | None, words: WordIds, end_id: int = END_ID) -> bytes:
    """The ids of a text and the end id, as little-endian unsigned 32-bit numbers."""
    text = text or ""
    # str.split() parts at a few controls too, which are no white space to the tokenizer
    runs = text.split() if not any(c in text for c in _CONTROLS) else [w for w in _SPACE.split(text) if w]
    return b"".join([*map(words.__getitem__, runs), end_id.to_bytes(4, "little")])


def _difference(sizes: list[int], k: int) -> list[list[int]]:
    """The items of each of k windows, by largest differencing."""
    tie = count()
    # a partial partition: loads in descending order, zeros left out, with the items of each
    heap = [(-size, next(tie), [size], [[i]]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, la, ia = heapq.heappop(heap)
        _, _, lb, ib = heapq.heappop(heap)
        free = k - len(la) - len(lb)
        if free >= 0:
            loads, items = la + lb, ia + ib
        else:
            # the -free smallest of each side meet, in opposite order
            m = -free
            loads = la[: len(la) - m] + lb[: len(lb) - m] + [x + y for x, y in zip(la[len(la) - m :], reversed(lb[len(lb) - m :]), strict=True)]
            items = ia[: len(ia) - m] + ib[: len(ib) - m] + [x + y for x, y in zip(ia[len(ia) - m :], reversed(ib[len(ib) - m :]), strict=True)]
        order = sorted(range(len(loads)), key=loads.__getitem__, reverse=True)
        loads, items = [loads[i] for i in order], [items[i] for i in order]
        if len(loads) == k and loads[-1]:
            base = loads[-1]
            loads = [x - base for x in loads]  # only differences matter from here on
        heapq.heappush(heap, (-(loads[0] - (loads[-1] if len(loads) == k else 0)), next(tie), loads, items))
    return heap[0][3] if heap else []


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Items of each window; no window exceeds the capacity, and no item may."""
    k = -(-sum(sizes) // capacity)
    while k < len(sizes):
        found = _difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return found
        k += max(1, k // 200)
    return [[i] for i in range(len(sizes))]


def pack_block(docs: list[tuple[int | None, bytes]], capacity: int = CAPACITY, last: bool = False) -> Iterator[tuple]:
    """(doc_id, start, length, ids, doc_tokens, window, offset, piece) of the pieces of one block; of a partition's last one
    all that fill no window stay open, numbered, without window and offset."""
    window, rest = 0, []
    for d, (doc_id, data) in enumerate(docs):
        n, at = len(data) // 4, 0
        while n - at >= capacity:
            yield doc_id, at, capacity, data[4 * at : 4 * (at + capacity)], n, window, 0, None
            window, at = window + 1, at + capacity
        if at < n:
            rest.append((d, at, n - at))

    def piece(i: int, *place: int | None) -> tuple:
        d, at, length = rest[i]
        doc_id, data = docs[d]
        return doc_id, at, length, data[4 * at : 4 * (at + length)], len(data) // 4, *place

    if last:
        yield from (piece(i, None, None, i) for i in range(len(rest)))
        return
    for members in windows([r[2] for r in rest], capacity):
        offset = 0
        for i in members:
            yield piece(i, window, offset, None)
            offset += rest[i][2]
        window += 1


def pack_blocks(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, block_ids: int = BLOCK_IDS) -> DataFrame:
    """documents -> pieces with their block and window, and open ones. No shuffle; ``tokenizer_path`` must be readable on
    every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block, docs, held = word_ids(tokenizer_path), 0, [], 0
        part = None

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            rows = list(pack_block(docs, capacity, last))
            for at in range(0, len(rows), 1024):
                c = list(zip(*rows[at : at + 1024], strict=True))
                c.insert(5, [(part << 32) + block] * len(c[0]))
                c[-1] = [None if i is None else (part << 32) + i for i in c[-1]]
                names = ["doc_id", "start", "length", "ids", "doc_tokens", "block", "window", "offset", "piece"]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "ids" else pa.int64()) for n, x in zip(names, c, strict=True)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                few = batch.slice(at, 512)
                for doc_id, text, p in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), few.column(2).to_pylist(), strict=True):
                    part = p
                    docs.append((doc_id, tokens(text, words)))
                    held += len(docs[-1][1]) // 4
                    if held >= block_ids:
                        yield from out(False)
                        block, docs, held = block + 1, [], 0
        if docs:
            yield from out(True)

    return docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, PIECES)


def _placed(pieces: DataFrame, capacity: int, block_ids: int) -> DataFrame:
    """open pieces -> piece, block, window, offset, from their lengths alone."""
    open_ = pieces.select("piece", "length")
    many = open_.agg(F.coalesce(F.sum("length"), F.lit(0))).collect()[0][0]
    group = F.pmod(F.xxhash64("piece"), F.lit(max(1, round(many / block_ids))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece", ignore_index=True)
        lengths, pieces, out = pdf["length"].tolist(), pdf["piece"].tolist(), []
        for window, members in enumerate(windows(lengths, capacity)):
            starts = np.cumsum([0, *(lengths[i] for i in members)])
            out += [(pieces[i], SECOND + int(pdf["g"].iloc[0]), window, int(at)) for i, at in zip(members, starts, strict=False)]
        return pd.DataFrame(out, columns=["piece", "block", "window", "offset"])

    return open_.withColumn("g", group).groupBy("g").applyInPandas(run, "piece long, block long, window long, offset long")


def number_sequences(pieces: DataFrame, capacity: int = CAPACITY, block_ids: int = BLOCK_IDS) -> DataFrame:
    """pieces with sequence_id, gapless from 0 in the order of blocks, instead of block, window and piece.

    Blocks are few, one for about a million ids: their running sum is the only thing that one task sees whole.
    """
    written = cut(pieces, "pieces")
    left = written.where("piece is not null")
    found = cut(_placed(left, capacity, block_ids), "placed")
    placed = left.drop("block", "window", "offset").join(grown(found), "piece").select(*written.columns)
    placed = written.where("piece is null").unionByName(placed)
    blocks = written.where("piece is null").select("block", "window").unionByName(found.select("block", "window")).groupBy("block").agg((F.max("window") + 1).alias("windows"))
    before = F.coalesce(F.sum("windows").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = cut(blocks.select("block", before.alias("first")), "blocks")
    return placed.join(first, "block").withColumn("sequence_id", F.col("first") + F.col("window")).drop("block", "window", "first", "piece")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """documents -> doc_id, start, length, ids, doc_tokens, offset, sequence_id of each piece."""
    return number_sequences(pack_blocks(docs, tokenizer_path, capacity), capacity)
