"""Conversation structure repair by secondary-sorted streaming.

Rows are dealt by conversation and sorted by turn, and streamed in Arrow batches; only a few numbers are carried from row to
row and from batch to batch, whatever the length of a conversation. A first stream runs from the last turn to the first, with
the least cost of repairing what follows for each state of the grammar ``(s?(ua)+)?`` of role initials. For each row it
leaves one byte, the best edit for each of the four states, and spills these bytes in blocks to a table. A second stream runs
forward, takes each block just before the rows it belongs to, and writes the edits. Of edits of equal cost the bytes name the
one with the least letter, so that the string of edits is the least of the cheapest. Equal rows are counted before they are
dealt, so that a row repeated without end is one row of the streams.

A conversation's edits are one sequence, and its digest one run over its text, so a conversation is streamed by one task; it
isn't gathered there, and the streams hold one block of edits (and, in the digest, the string of edits) beside a batch.

Defined results: null roles and texts are one space. Rows of a conversation go by turn, null first, then role, then text.
conv_id null: a conversation. Rows equal in all four are repeats, one after another. Roles with other initials than s, u
and a fit nowhere and are changed or deleted. A blank role has a blank initial, an empty one none. Extra columns are ignored,
whatever their names. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import cut, grown

DELETE, REROLE, INSERT, CUT_OFF = 3, 2, 2, 1
#: Edits in the order of their letters.
LETTERS = "DIKR"
#: States of the grammar: nothing yet, after a system turn, after a user turn, after an assistant turn.
_STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_FILLED = (2, 2, 3, 2)
_FILLER = ("user", "user", "assistant", "user")
#: What is left to pay at a conversation's end, and the roles to add.
_END = (0, 2 * INSERT, INSERT, 0)
#: Rows whose edits are spilled together.
BLOCK = 1 << 16
_SPACE = " \t\n\x0b\x0c\r"
EDITS = "conv_id long, seq long, edit string, fault string, turn long, was string, role string, text string"
DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@lru_cache(maxsize=1 << 14)
def best(after: tuple[int, ...], initial: str, doomed: bool, cut_off: bool) -> tuple[tuple[int, ...], int]:
    """The costs from a row on for each state, less the least, and the states' edits in two bits each; ``after`` has the costs of what follows."""
    ways = []
    for state in range(4):
        way = {"D": DELETE + after[state]}
        if not doomed:
            way["R"] = REROLE + cut_off * CUT_OFF + after[_FILLED[state]]
            if initial in _STEPS[state]:
                way["K"] = cut_off * CUT_OFF + after[_STEPS[state][initial]]
        ways.append(way)
    costs = [min(way.values()) for way in ways]
    for _ in range(2):  # an added turn may call for one more
        costs = [min(costs[s], INSERT + costs[_FILLED[s]]) for s in range(4)]
    edits = 0
    for state, way in enumerate(ways):
        way["I"] = INSERT + costs[_FILLED[state]]
        edits |= LETTERS.index(min(k for k, v in way.items() if v == costs[state])) << 2 * state
    least = min(costs)
    return tuple(c - least for c in costs), edits


def counted(rows: DataFrame) -> DataFrame:
    """rows by turn -> conv_id, turn, role, text, copies, dup (role and text stood in an earlier turn), blank, cut_off."""
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    # written before it is joined, so that Spark can split the join of a conversation that says one thing all the time
    once = cut(plain.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("said", F.unhex(F.md5("text"))), "turns")
    first = once.groupBy("conv_id", "role", "said").agg(F.max(F.col("turn").isNull()).alias("bare"), F.min("turn").alias("least"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("said").alias("s"), "bare", "least")
    both = once.join(grown(first), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("said") == F.col("s")))
    ending = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    dup = F.col("turn").isNotNull() & (F.col("bare") | (F.col("turn") > F.col("least")))
    return both.select("conv_id", "turn", "role", "text", "copies", dup.alias("dup"), (ending == "").alias("blank"), (~ending.isin(".", "!", "?")).alias("cut_off"))


def _streamed(rows: DataFrame, order: list[Column]) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(*order)


def choices(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """counted rows -> conv_id, turn, role, text, edits: a row for each block, with what its first row is known by; the
    bytes go from its first row to its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, costs, edits, at = None, _END, bytearray(), None
        for batch in batches:
            out: list[tuple] = []
            # texts are looked at only where a block ends
            ids, turns, roles, texts, dups, blanks, cuts = (batch.column(i) for i in range(7))
            for i, row in enumerate(zip(ids.to_pylist(), roles.to_pylist(), dups.to_pylist(), blanks.to_pylist(), cuts.to_pylist(), strict=True)):
                if edits and (row[0] != conv or len(edits) >= block):
                    out.append((conv, *at(), bytes(reversed(edits))))
                    edits = bytearray()
                    if row[0] != conv:
                        costs = _END
                conv = row[0]
                costs, made = best(costs, row[1][:1], row[2] or row[3], row[4])
                edits.append(made)
                at = lambda t=turns, r=roles, x=texts, i=i: (t[i].as_py(), r[i].as_py(), x[i].as_py())
            if out:
                yield _batch(out, found)
        if edits:
            yield _batch([(conv, *at(), bytes(reversed(edits)))], found)

    found = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edits", pa.binary())])
    order = [F.col("conv_id"), F.desc_nulls_last("turn"), F.desc("role"), F.desc("text")]
    return _streamed(rows.select("conv_id", "turn", "role", "text", "dup", "blank", "cut_off"), order).mapInArrow(run, "conv_id long, turn long, role string, text string, edits binary")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows by turn (conv_id, turn, role, text) -> the edits, with the repaired turns: conv_id, seq (from 0), edit (K, R, D
    or I), fault (blank, duplicate, truncated or none), turn, was (the role before), role, text.

    Rows of a conversation are in one partition, in their order. Those with edit D are gone from the repaired conversation.
    """
    rows = cut(counted(rows), "counted")
    spilled = cut(choices(rows, block), "choices")
    marks = rows.select("conv_id", "turn", "role", "text", "copies", "dup", "blank", "cut_off", F.lit(None).cast("binary").alias("edits"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("copies", "long"), ("dup", "boolean"), ("blank", "boolean"), ("cut_off", "boolean"))]
    both = marks.unionByName(spilled.select("conv_id", "turn", "role", "text", *empty, "edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, state, seq, edits, at = None, False, 0, 0, b"", 0
        out: list[tuple] = []

        def put(edit: str, fault: str, turn: int | None, was: str | None, role: str, text: str) -> None:
            nonlocal seq
            out.append((conv, seq, edit, fault, turn, was, role, text))
            seq += 1

        def add() -> None:
            nonlocal state
            put("I", "", None, None, _FILLER[state], "")
            state = _FILLED[state]

        def end() -> None:
            nonlocal state, seq
            while state in (1, 2):
                add()
            state = seq = 0

        for batch in batches:
            for c, turn, role, text, copies, dup, blank, cut_off, more in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not begun or c != conv:
                    end()
                    conv, begun = c, True
                if more is not None:
                    edits, at = more, 0
                    continue
                made, at = edits[at], at + 1
                while (edit := LETTERS[made >> 2 * state & 3]) == "I":
                    add()
                put(edit, "blank" if blank else "duplicate" if dup else "truncated" if cut_off else "", turn, role, _FILLER[state] if edit == "R" else role, text)
                state = state if edit == "D" else _FILLED[state] if edit == "R" else _STEPS[state][role[:1]]
                for _ in range(copies - 1):
                    put("D", "blank" if blank else "duplicate", turn, role, role, text)
                    if len(out) >= 4096:
                        yield _batch(out, found)
                        out.clear()
            if out:
                yield _batch(out, found)
                out.clear()
        end()
        if out:
            yield _batch(out, found)

    found = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), *((c, pa.string()) for c in ("edit", "fault")), ("turn", pa.int64()), *((c, pa.string()) for c in ("was", "role", "text"))])
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("edits").isNull()]
    return _streamed(both, order).mapInArrow(run, EDITS)


class _Sums:
    """What is said of one conversation, row by row."""

    def __init__(self) -> None:
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.illegal = self.cost = self.turns = 0
        self.least = self.most = self.last = None
        self.audit, self.sha, self.any = bytearray(), hashlib.sha256(), False

    def add(self, edit: str, fault: str, turn: int | None, was: str | None, role: str, text: str) -> None:
        self.audit += edit.encode()
        if edit != "D":
            self.sha.update(f"{chr(10) * self.any}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.any = True
        self.cost += {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[edit] + (fault == "truncated" and edit != "D") * CUT_OFF
        if edit == "I":
            return
        self.faults[fault] += 1
        if self.last is not None:
            self.illegal += self.last + was[:1] not in ("su", "ua", "au")
        self.last = was[:1]
        if turn is not None and turn != self.most:
            self.turns, self.most = self.turns + 1, turn
            self.least = turn if self.least is None else self.least

    def row(self, conv: int | None) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        f = self.faults
        return conv, gaps, f["blank"], f["duplicate"], f["truncated"], self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest()


def digests(edits: DataFrame) -> DataFrame:
    """repaired() -> a row for each conversation that has edits: gaps, counts of faults, illegal neighbours, cost, audit and
    the digest of the repaired conversation. Reads the edits as they are streamed, with no shuffle between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sums = None, None
        for batch in batches:
            out = []
            for c, _, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if sums is None or c != conv:
                    if sums is not None:
                        out.append(sums.row(conv))
                    conv, sums = c, _Sums()
                sums.add(*row)
            if out:
                yield _batch(out, found)
        if sums is not None:
            yield _batch([sums.row(conv)], found)

    found = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return edits.mapInArrow(run, DIGEST)


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with faults of known kinds, by crc32 of ``conv_id:turn``, null being one space: 0 of 20 drops a row, 1
    empties its text, 2 takes its full stops, question and exclamation marks, 3 repeats it, 4 gives it to the user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", part("conv_id"), part("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(kind == 4, "user").otherwise(part("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), copies))).drop("col")


def audit(rows: DataFrame, after: DataFrame) -> DataFrame:
    """The digest of each conversation of ``rows`` after ``after``, what was left of them, has been repaired."""
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = cut(digests(repaired(after)), "digests")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    both = every.join(grown(found.withColumnRenamed("conv_id", "c")), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return both.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
