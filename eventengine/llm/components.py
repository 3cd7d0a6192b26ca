"""Connected components of a table of links, by stars of each task's links, hooks between roots, and jumps to the parent's parent."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import forget, grown, step

#: Nodes whose links a task joins up at a time.
BLOCK = 1 << 18


def _stars(links: DataFrame) -> DataFrame:
    """links(u, v) -> u, v: in place of a task's links, its nodes with the smallest that they reach in these, so that a hot
    node has few rows left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := above.get(x)) is not None:
                if (z := above.get(y)) is not None:
                    above[x] = z
                x = y
            return x

        def stars() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(above), pa.int64()), pa.array([top(x) for x in above], pa.int64())], ["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (a := top(u)) != (b := top(v)):
                    above[max(a, b)] = min(a, b)
            if len(above) >= BLOCK:
                yield stars()
                above.clear()
        if above:
            yield stars()

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def _hooked(stars: DataFrame) -> DataFrame:
    """Each node u with the smallest v above it, or with itself if none is; further nodes above it are hooked to that v.

    ``deep``: u has nodes above and below; ``open``: that, or it had several above.
    """
    ends = stars.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("top")), F.struct(F.col("v").alias("u"), F.lit(None).cast("long").alias("top")))).alias("e")).select("e.*")
    found = ends.groupBy("u").agg(F.collect_set("top").alias("tops"), F.max(F.col("top").isNull()).alias("below")).withColumn("v", F.array_min("tops"))
    deep = F.col("below") & F.col("v").isNotNull()
    own = F.struct(F.col("u").alias("u"), F.coalesce("v", "u").alias("v"), deep.alias("deep"), (deep | (F.size("tops") > 1)).alias("open"))
    hook = lambda t: F.struct(t.alias("u"), F.col("v").alias("v"), F.lit(False).alias("deep"), F.lit(True).alias("open"))
    return found.select(F.explode(F.concat(F.array(own), F.transform(F.filter("tops", lambda t: t != F.col("v")), hook))).alias("e")).select("e.*")


def components(links: DataFrame) -> DataFrame:
    """links(u long, v long) -> (node, component), written: each linked node with the smallest node it reaches.

    A round takes one shuffle by nodes and, from the second on, the join of the jump, in which Spark can split a hot node; the
    roots that the tasks found above a node are gathered, at most one for each block of links. Nothing but the end of the
    rounds reaches the driver. No link: no row.
    """
    edges = step(_hooked(_stars(links.where("u <> v"))), "links")
    while not edges.where("open").isEmpty():
        over = edges.where("deep").select(F.col("u").alias("v"), F.col("v").alias("top"))
        jumped = edges.where("u <> v").join(grown(over), "v", "left").select("u", F.coalesce("top", "v").alias("v"))
        before, edges = edges, step(_hooked(_stars(jumped)), "links")
        forget(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps(node, component) as :func:`components` returns them, with further links -> the same of all links."""
    return components(comps.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links))
