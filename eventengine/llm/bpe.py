"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are cut before encoding at boundaries that the pattern respects too: before an ASCII space or line break that
follows a character which is no white space. A match never runs over such a place, and nothing before it looks past it
but white space does, so that the ids are those of the whole text. A single match of great length (a word of a million
letters, a million blanks) would cost the library the square of its length, and white space of that length its stack; the
pattern finds the matches of such a part, and the merges of a long one are found with a heap.

Defined results: text null: as the empty text, no ids. Extra columns pass through. No rows: no rows.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters from which a text is cut, and the longest run without a boundary that the library gets as it is.
CUT, LONG = 100_000, 2_000
#: White space as the pattern and the library know it; Python's own also counts four control characters.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_BOUNDARY = re.compile(f"(?<=[^{_SPACE}])(?=[ \\n])")
_LONG_RUN = re.compile(f"[^{_SPACE}]{{{LONG}}}|[{_SPACE}]{{{LONG}}}")


@lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one match: the pair of least rank first, the leftmost of equal ones."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []

    def offer(i: int) -> None:
        if (j := end[i]) < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heap.append((r, i, end[j])) if building else heapq.heappush(heap, (r, i, end[j]))

    building = True
    for i in range(n):
        offer(i)
    heapq.heapify(heap)
    building = False
    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != to:
            continue
        j = end[i]
        alive[j] = False
        end[i] = to
        if to < n:
            prev[to] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def pieces(text: str, size: int = CUT) -> list[str]:
    """The text in parts of about ``size`` characters, cut at safe boundaries only."""
    out, at = [], 0
    while len(text) - at > size and (m := _BOUNDARY.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def encode_text(text: str, enc: tiktoken.Encoding, pattern: regex.Pattern) -> list[int]:
    ids: list[int] = []
    for part in pieces(text):
        if _LONG_RUN.search(part):
            for m in pattern.finditer(part):
                found = m.group()
                ids += merge_long(found.encode("utf-8"), enc._mergeable_ranks) if len(found) > LONG else enc.encode_ordinary(found)
        else:
            ids += enc.encode_ordinary(part)
    return ids


def _added(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def encode(df: DataFrame, ranks_path: str, pattern: str, column: str = "text", into: str = "ids") -> DataFrame:
    """df with ``into``, the ids of each text as array<int>. ``ranks_path`` must be readable on every executor."""
    schema = _added(df, into, T.ArrayType(T.IntegerType()))
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pat = encoding(ranks_path, pattern), regex.compile(pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [encode_text(t or "", enc, pat) for t in part.column(at).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.fromiter((x for row in ids for x in row), np.int32, int(ends[-1]))
                kept = [(n, c) for n, c in zip(part.schema.names, part.columns, strict=True) if n != into]
                yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [*(n for n, _ in kept), into])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """df with ``into``, the raw bytes of each row's ids; these need not be UTF-8 where ids were cut."""
    schema = _added(df, into, T.BinaryType())
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                data = [None if x is None else enc.decode_bytes(x) for x in part.column(at).to_pylist()]
                kept = [(n, c) for n, c in zip(part.schema.names, part.columns, strict=True) if n != into]
                yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(data, pa.binary())], [*(n for n, _ in kept), into])

    return df.mapInArrow(run, schema)
