"""Chat formatting with prefix trees of tokens.

Each turn is written as ``<|role|>``, a line break, the text, ``<|end|>`` and a line break. Inside texts ``%`` becomes
``%25`` and ``<|`` becomes ``%3C|``, so that no text can hold a control string and reading back is exact. Head, text and end
of a turn are encoded each by itself with a byte-level BPE, so that loss masks end where tokens end.

Conversations of equal content are one leaf. Leaves are ordered by the hashes of their turns, so that those sharing
initial turns are neighbours, range partitioned, and merged into prefix trees: the tokens of shared turns are emitted once,
depth first. A tree is closed beyond ``TREE_TOKENS`` tokens; the next one emits the turns it needs again. Each token has a
position id that continues its parent's, and each node (a turn) its interval in the tree's stream and the intervals of its
ancestors that it may attend to; loss falls on the texts of assistant turns.

Defined results: text or role null: empty. Turns with the same number: by role, then text. turn null: first. conv_id null:
a conversation. Extra columns are ignored. No rows: no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .bpe import encode_text, encoding
from .work import cut

TREE_TOKENS = 1 << 15
#: Leaves that a task's Python takes out of an Arrow batch at a time.
LEAVES = 64
#: Parquet options of tables of conversations and trees. A reader takes 4,096 rows of a row group at once, and a tree is a
#: row of a quarter of a megabyte: row groups of 8 MiB, looked at every few rows, bound what a task holds.
GROUPS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 4}
LEARNED = "assistant"
END = "<|end|>\n"
_TURN = re.compile(r"<\|([^|]*)\|>\n(.*?)<\|end\|>\n", re.DOTALL)
_ESCAPED = re.compile("%3C|%7C|%0A|%25")
NODE = "struct<parent:int,start:int,end:int,loss_start:int,loss_end:int,attends:array<struct<start:int,end:int>>>"
TREE = f"tree_id long, ids array<int>, positions array<int>, nodes array<{NODE}>, leaves array<struct<leaf:string,node:int>>"
BACK = "leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return text.replace("%", "%25").replace("<|", "%3C|")


def escape_role(role: str) -> str:
    return role.replace("%", "%25").replace("|", "%7C").replace("<", "%3C").replace("\n", "%0A")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {"%3C": "<", "%7C": "|", "%0A": "\n", "%25": "%"}[m.group()], text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


class Tree:
    """One prefix tree under construction; leaves arrive in the order of their paths."""

    def __init__(self, ids_of) -> None:
        self.ids_of = ids_of
        self.ids: list[int] = []
        self.positions: list[int] = []
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.path: list[tuple[tuple[str, str], int]] = []

    def add(self, leaf: str, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(self.path), len(turns)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for role, text in turns[shared:]:
            parent = self.path[-1][1] if self.path else -1
            attends: list[dict] = []
            if self.path:
                above = self.nodes[parent]
                attends = [dict(x) for x in above["attends"]]
                if attends and attends[-1]["end"] == above["start"]:
                    attends[-1]["end"] = above["end"]
                else:
                    attends.append({"start": above["start"], "end": above["end"]})
            head, body, end = self.ids_of(f"<|{escape_role(role)}|>\n"), self.ids_of(escape(text)), self.ids_of(END)
            start, place = len(self.ids), sum(x["end"] - x["start"] for x in attends)
            for part in (head, body, end):
                self.ids += part
            self.positions += range(place, place + len(self.ids) - start)
            begin, learned = start + len(head), role == LEARNED
            self.nodes.append({"parent": parent, "start": start, "end": len(self.ids), "loss_start": begin if learned else -1, "loss_end": begin + len(body) if learned else -1, "attends": attends})
            self.path.append(((role, text), len(self.nodes) - 1))
        self.leaves.append({"leaf": leaf, "node": self.path[-1][1]})


def conversations_of(rows: DataFrame) -> DataFrame:
    """rows by turn -> conv_id, turns (role, text in order), leaf (digest of the content)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    whole = whole.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    # lengths keep the digest of different turns apart
    mark = F.array_join(F.transform("turns", lambda x: F.concat(F.length(x["role"]), F.lit(":"), F.length(x["text"]), F.lit(":"), x["role"], x["text"])), "")
    return whole.withColumn("leaf", F.sha2(mark, 256))


def build_trees(leaves: DataFrame, ranks_path: str, pattern: str, tree_tokens: int = TREE_TOKENS) -> DataFrame:
    """leaves(leaf, turns), each once -> trees. ``ranks_path`` must be readable on every executor."""
    path = F.transform("turns", lambda x: F.xxhash64(x["role"], x["text"]))
    ordered = leaves.select("leaf", "turns", path.alias("path")).repartitionByRange("path", "leaf").sortWithinPartitions("path", "leaf")

    kind = to_arrow_schema(T.StructType.fromDDL(TREE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pat = encoding(ranks_path, pattern), regex.compile(pattern)
        ids_of = lambda text: encode_text(text, enc, pat)
        tree, number, part = Tree(ids_of), 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"tree_id": (part << 32) + number, "ids": tree.ids, "positions": tree.positions, "nodes": tree.nodes, "leaves": tree.leaves}], kind)

        for row in _rows(batches, LEAVES):
            part = row["part"]
            if len(tree.ids) > tree_tokens:
                yield out()
                tree, number = Tree(ids_of), number + 1
            tree.add(row["leaf"], [(t["role"], t["text"]) for t in row["turns"]])
        if tree.leaves:
            yield out()

    return ordered.select("leaf", "turns", F.spark_partition_id().alias("part")).mapInArrow(run, TREE)


def _rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[dict]:
    """The rows of the batches, of which ``size`` are Python objects at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            yield from batch.slice(k, size).to_pylist()


def _within(lists: pa.ListArray, k: int) -> slice:
    return slice(lists.offsets[k].as_py(), lists.offsets[k + 1].as_py())


def digest_batches(batches: Iterator[pa.RecordBatch], kind: pa.Schema, ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Batches of (ids, nodes, leaves) -> a batch of digests for each tree; one tree at a time is Python objects."""
    enc = encoding(ranks_path, pattern)
    numbers = lambda rows, *names: [rows.field(n).to_numpy() for n in names]
    for batch in batches:
        all_ids, all_nodes, all_leaves = batch.columns
        spans_of = all_nodes.values.field("attends")
        tokens, (above_start, above_end) = all_ids.values.to_numpy(), numbers(spans_of.values, "start", "end")
        columns = numbers(all_nodes.values, "parent", "start", "end", "loss_start", "loss_end")
        for k in range(batch.num_rows):
            ids, own = tokens[_within(all_ids, k)].tolist(), _within(all_nodes, k)
            parent, start, end, loss_start, loss_end = (c[own].tolist() for c in columns)
            text_of = lambda a, b: enc.decode_bytes(ids[a:b]).decode("utf-8")  # noqa: B023, E731
            rows = []
            for leaf in all_leaves.values[_within(all_leaves, k)].to_pylist():
                at = leaf["node"]
                above = _within(spans_of, own.start + at)
                spans = [*zip(above_start[above].tolist(), above_end[above].tolist(), strict=True), (start[at], end[at])]
                formatted = "".join(text_of(a, b) for a, b in spans)
                losses = []
                while at >= 0:
                    if loss_start[at] >= 0:
                        losses.append(unescape(text_of(loss_start[at], loss_end[at])))
                    at = parent[at]
                loss = "".join(reversed(losses))
                turns = read_turns(formatted)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((leaf["leaf"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)


def read_back(trees: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """trees -> leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the tokens alone."""
    kind = to_arrow_schema(T.StructType.fromDDL(BACK))
    return trees.select("ids", "nodes", "leaves").mapInArrow(lambda batches: digest_batches(batches, kind, ranks_path, pattern), BACK)


def format_chats(rows: DataFrame, ranks_path: str, pattern: str, tree_tokens: int = TREE_TOKENS) -> tuple[DataFrame, DataFrame]:
    """conversations by turn -> (trees; conv_id, leaf of each conversation)."""
    whole = cut(conversations_of(rows), "conversations", **GROUPS)
    leaves = whole.groupBy("leaf").agg(F.first("turns").alias("turns"))
    return build_trees(cut(leaves, "leaves", **GROUPS), ranks_path, pattern, tree_tokens), whole.select("conv_id", "leaf")
