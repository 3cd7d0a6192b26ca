"""Sharding over fixed virtual slots.

A record's id and text hash into one of ``SLOTS`` virtual slots, for good; equal rows are told apart by their number among
those of their part of the input, so that a record repeated without end fills many slots. Bytes are aggregated per slot,
and a slot-to-shard map says where a slot lives. The map is a table of versions in a folder, each a folder of its own: a run
reads the last version, edits it where the shards have grown uneven, and publishes the edited one as the next version;
without any, the slots are dealt round as version 0. A version is published by a rename that fails where it is there
already: the later of two writers reads that version and edits it in turn. A map has as many rows as there are slots,
whatever the input, so that it may pass through the driver and be broadcast.

An edit moves (or exchanges) slots between the fullest and the emptiest shard only, until all are within ``SLACK`` of the
mean or no move helps any more; all other slots stay. Where there are shards that the map does not know yet, slots move
into these and nowhere else.

Law: ``bytes``. Shards get sizes as near to equal as whole slots allow.

Defined results: text null: 16 bytes, crc32 of the empty text. doc_id null: a slot by size and crc32 of the text, as any.
Rows that share an id go by their texts, repeated rows are rows of their own, and both may lie in different shards. Extra columns are ignored, whatever their names. No rows: no rows, and a map of version 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .work import cut, grown, publish

SLOTS = 16_384
SHARDS = 40
OVERHEAD = 16
#: Shards this near to the mean, as a share of it, are left as they are.
SLACK = 0.001
MAP = "version int, slot int, shard int, bytes long"


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: slots dealt round."""
    return [s % shards for s in range(slots)]


def _exchange(give: np.ndarray, take: np.ndarray, gap: int, want: float) -> tuple[int, int] | None:
    """Places of a slot to give and of one to take back (-1 for none), sizes sorted, whose difference is within the gap and
    nearest to what is wanted."""
    back = np.concatenate([[0], take])
    at, best = np.searchsorted(back, give - want), None
    for k in (np.clip(at - 1, 0, len(back) - 1), np.clip(at, 0, len(back) - 1)):
        moved = give - back[k]
        off = np.where((moved > 0) & (moved < gap), np.abs(moved - want), np.inf)
        i = int(np.argmin(off))
        if np.isfinite(off[i]) and (best is None or off[i] < best[0]):
            best = (float(off[i]), i, int(k[i]) - 1)
    return None if best is None else best[1:]


def rebalance(slot_map: list[int], sizes: dict[int, int], shards: int, slack: float = SLACK) -> list[int]:
    """The map edited for these sizes. Slots of shards beyond ``shards`` go to the emptiest ones. With shards that the map
    does not know, slots move into these only."""
    edited, new = list(slot_map), sorted(set(range(shards)) - set(slot_map))
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    homeless = []
    for slot, size in sorted(sizes.items()):
        (held[edited[slot]] if edited[slot] < shards else homeless).append((size, slot))
    filled = [sum(b for b, _ in h) for h in held]
    for slot, shard in enumerate(edited):
        if shard >= shards and slot not in sizes:
            edited[slot] = slot % shards
    for size, slot in sorted(homeless, reverse=True):
        lo = int(np.argmin(filled))
        held[lo].append((size, slot))
        filled[lo] += size
        edited[slot] = lo
    for h in held:
        h.sort()
    mean, stuck = sum(filled) / shards, set(new)
    while len(stuck) < shards:
        hi = max((k for k in range(shards) if k not in stuck), key=filled.__getitem__)
        lo = min(new or range(shards), key=filled.__getitem__)
        above, below = filled[hi] - mean, mean - filled[lo]
        if max(above, below) <= slack * mean or (new and below <= slack * mean):
            break
        take = [] if new else [b for b, _ in held[lo]]
        found = _exchange(np.array([b for b, _ in held[hi]]), np.array(take), filled[hi] - filled[lo], max(min(above, below), 0)) if held[hi] else None
        if found is None:
            stuck.add(hi)
            continue
        moves = [(hi, lo, held[hi][found[0]])] + ([(lo, hi, held[lo][found[1]])] if found[1] >= 0 else [])
        for a, b, moved in moves:
            held[a].remove(moved)
            held[b].append(moved)
            filled[a] -= moved[0]
            filled[b] += moved[0]
            edited[moved[1]] = b
        held[hi].sort()
        held[lo].sort()
        stuck = set(new)
    return edited


def read_maps(spark: SparkSession, folder: str) -> DataFrame:
    """All versions of the map in a folder; no rows where there is none yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(MAP).option("recursiveFileLookup", True).parquet(folder) if there else spark.createDataFrame([], MAP)


def last_map(spark: SparkSession, folder: str) -> tuple[int, list[int]] | None:
    """The number and the shards by slot of the last version; a bounded number of rows."""
    maps = read_maps(spark, folder)
    version = maps.agg(F.max("version")).collect()[0][0]
    if version is None:
        return None
    rows = sorted(maps.where(F.col("version") == version).select("slot", "shard").collect())
    if [r["slot"] for r in rows] != list(range(len(rows))):
        raise ValueError(f"version {version} of the map in {folder} has not one row for each slot")
    return version, [r["shard"] for r in rows]


def store_map(spark: SparkSession, folder: str, version: int, slot_map: list[int], sizes: dict[int, int]) -> bool:
    """Publish a version, as one file; False where that version is there already."""
    rows = [(version, s, shard, sizes.get(s, 0)) for s, shard in enumerate(slot_map)]
    made = cut(spark.createDataFrame(rows, MAP).coalesce(1), "map").inputFiles()[0].rsplit("/", 1)[0]
    return publish(spark, made, f"{folder.rstrip('/')}/{version:010d}")


def current_map(spark: SparkSession, folder: str, sizes: dict[int, int], shards: int, slots: int, slack: float) -> tuple[int, list[int]]:
    """The last version of the map, edited and published as the next one where these sizes call for it."""
    while True:
        stored = last_map(spark, folder)
        if stored is None:
            store_map(spark, folder, 0, first_map(shards, slots), {})
            continue
        version, slot_map = stored
        edited = rebalance(slot_map, sizes, shards, slack)
        if edited == slot_map:
            return stored
        if store_map(spark, folder, version + 1, edited, sizes):
            return version + 1, edited


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """documents -> doc_id, size, text_crc32, virtual_slot, part, at (the place in the input)."""
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text) + OVERHEAD).cast("long"), F.crc32(F.encode(text, "UTF-8"))
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    # of equal rows, those of one part at most meet in a window
    again = F.row_number().over(Window.partitionBy("doc_id", "size", "text_crc32", "part").orderBy("at"))
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", again), F.lit(slots)).cast("int"))


def shard(docs: DataFrame, folder: str, shards: int = SHARDS, slots: int = SLOTS, slack: float = SLACK) -> DataFrame:
    """documents -> doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    The maps are read from and published in ``folder``. ``slot`` numbers the rows of a shard from 0, without gaps: those of
    each written part are numbered by themselves, and start where the shard's rows of the parts before end.
    """
    spark = docs.sparkSession
    # parts and the order in them stand once they are written
    rows = cut(sized(docs, slots), "sized")
    sizes = {r["virtual_slot"]: r["bytes"] for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()}
    version, _ = current_map(spark, folder, sizes, shards, slots, slack)
    where = read_maps(spark, folder).where(F.col("version") == version).select(F.col("slot").alias("virtual_slot"), "shard")
    placed = rows.join(F.broadcast(where), "virtual_slot")
    counts = cut(placed.groupBy("shard", "part").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    k = F.row_number().over(Window.partitionBy("shard", "part").orderBy("at"))
    numbered = placed.withColumn("k", k).join(grown(starts), ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("k") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"))
