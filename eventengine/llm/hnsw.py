"""Nearest neighbours by a hierarchical navigable small-world graph per shard.

Equal vectors are indexed once. Shards hold up to about ``SHARD_ROWS`` distinct vectors and ``SHARD_BYTES``; each becomes a graph, stored as
flat arrays in a row of the index table. Blocks of queries meet every shard's row, and the shards' results are merged.
Nearness is the inner product; inside a shard vectors get one more component that gives all the same length, so that the
graph is built on angles whatever the norms. Scores are inner products of the original vectors, in double precision.

Defined results: vectors null, zero, or holding null or non-finite components, and rows without vec_id, take no part;
vectors of other lengths than the query's are no candidates. Repeated rows of a vec_id and vector count once; several vectors
of one vec_id are each asked for themselves, and none is a candidate for its own id. Ties go to the smaller vec_id. Extra
columns are ignored, whatever their names. No rows: no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import cut

M, EF_BUILD, EF_SEARCH = 16, 64, 128
SHARD_ROWS, SHARD_BYTES = 8192, 1 << 26
QUERY_BLOCK = 2048
K = 20


class Graph:
    """Vectors (rows of equal length), top layer first in ``layers``: each a flat neighbour array of fixed width, -1 for none."""

    def __init__(self, vectors: np.ndarray, m: int = M):
        self.v, self.m = np.ascontiguousarray(vectors, np.float32), m
        self.layers: list[np.ndarray] = []  # [0] is the ground layer
        self.sizes: list[np.ndarray] = []
        self.entry = -1

    def _search(self, q: np.ndarray, enter: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ef nearest found, as (similarity, node), ascending."""
        links, v = self.layers[layer], self.v
        seen = np.zeros(len(v), bool)
        seen[[n for _, n in enter]] = True
        todo = [(-s, n) for s, n in enter]
        best = list(enter)
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            s, n = heapq.heappop(todo)
            if -s < best[0][0] and len(best) >= ef:
                break
            near = links[n]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            sims = v[near] @ q
            if len(best) >= ef:
                good = sims > best[0][0]
                near, sims = near[good], sims[good]
            for x, k in zip(sims.tolist(), near.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (x, k))
                elif x > best[0][0]:
                    heapq.heapreplace(best, (x, k))
                else:
                    continue
                heapq.heappush(todo, (-x, k))
        return sorted(best)

    def _choose(self, found: list[tuple[float, int]], width: int) -> list[int]:
        """Of the nearest (ascending), those that are nearer to the point than to one already chosen; then the rest."""
        nodes = np.array([n for _, n in reversed(found)])
        sims = np.array([s for s, _ in reversed(found)])
        if len(nodes) <= width:
            return nodes.tolist()
        between = self.v[nodes] @ self.v[nodes].T
        chosen, spare = [], []
        for i in range(len(nodes)):
            if len(chosen) == width:
                break
            (spare if chosen and between[i, chosen].max() > sims[i] else chosen).append(i)
        chosen += spare[: width - len(chosen)]
        return nodes[chosen].tolist()

    def _link(self, a: int, b: int, layer: int) -> None:
        links, size = self.layers[layer], self.sizes[layer]
        if size[a] < links.shape[1]:
            links[a, size[a]] = b
            size[a] += 1
            return
        near = np.append(links[a], b)
        sims = self.v[near] @ self.v[a]
        order = np.argsort(sims)
        kept = self._choose([(float(sims[i]), int(near[i])) for i in order], links.shape[1])
        links[a, : len(kept)] = kept
        size[a] = len(kept)

    def build(self, ef: int = EF_BUILD, seed: int = 11) -> Graph:
        n = len(self.v)
        levels = (-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(self.m)).astype(int) if n else np.zeros(0, int)
        for layer in range(int(levels.max(initial=-1)) + 1):
            self.layers.append(np.full((n, self.m * (2 if layer == 0 else 1)), -1, np.int32))
            self.sizes.append(np.zeros(n, np.int32))
        top = -1
        for i in range(n):
            q, level = self.v[i], int(levels[i])
            if self.entry < 0:
                self.entry, top = i, level
                continue
            enter = [(float(self.v[self.entry] @ q), self.entry)]
            for layer in range(top, level, -1):
                enter = self._search(q, enter, 1, layer)[-1:]
            for layer in range(min(level, top), -1, -1):
                enter = self._search(q, enter, ef, layer)
                for b in self._choose(enter, self.m):
                    self._link(i, b, layer)
                    self._link(b, i, layer)
            if level > top:
                self.entry, top = i, level
        return self

    def nearest(self, q: np.ndarray, k: int, ef: int = EF_SEARCH) -> list[int]:
        if self.entry < 0:
            return []
        q = q.astype(np.float32)
        enter = [(float(self.v[self.entry] @ q), self.entry)]
        for layer in range(len(self.layers) - 1, 0, -1):
            enter = self._search(q, enter, 1, layer)[-1:]
        return [n for _, n in reversed(self._search(q, enter, max(ef, k), 0))][:k]

    def flat(self) -> tuple[bytes, bytes, int]:
        """Neighbours of all layers, the nodes of each upper layer first, and where to enter."""
        upper = []
        for links in self.layers[1:]:
            nodes = np.nonzero(links[:, 0] >= 0)[0].astype(np.int32)
            upper += [np.array([len(nodes)], np.int32), nodes, links[nodes].ravel()]
        ground = self.layers[0].ravel().astype(np.int32) if self.layers else np.zeros(0, np.int32)
        return ground.tobytes(), np.concatenate([np.array([len(self.layers)], np.int32), *upper]).tobytes(), self.entry

    @classmethod
    def of_flat(cls, vectors: np.ndarray, ground: bytes, upper: bytes, entry: int, m: int = M) -> Graph:
        g = cls(vectors, m)
        g.entry = entry
        n, flat = len(vectors), np.frombuffer(upper, np.int32)
        g.layers = [np.frombuffer(ground, np.int32).reshape(n, 2 * m)]
        at = 1
        for _ in range(int(flat[0]) - 1):
            count = int(flat[at])
            nodes = flat[at + 1 : at + 1 + count]
            links = np.full((n, m), -1, np.int32)
            links[nodes] = flat[at + 1 + count : at + 1 + count * (m + 1)].reshape(count, m)
            g.layers.append(links)
            at += 1 + count * (m + 1)
        return g


def _even(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more component, so that all have the length of the longest."""
    squares = (vectors * vectors).sum(axis=1)
    return np.hstack([vectors, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]])


def usable(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, vec (array<double>), dim, vkey (digest of the vector) of the rows that take part, each once."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vec"))
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("vec_id is not null and vec is not null").where(whole & F.exists("vec", lambda x: x != 0))
    return rows.select("vec_id", "vec", F.size("vec").alias("dim"), F.md5(F.col("vec").cast("string").cast("binary")).alias("vkey")).dropDuplicates(["vec_id", "vkey"])


def build_index(distinct: DataFrame, shards: int) -> DataFrame:
    """distinct(vkey, vec, dim) -> a row for each shard: dim, shard, vkeys, vectors, ground, upper, entry."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vkey")
        vectors = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        ground, upper, entry = Graph(_even(vectors)).build().flat()
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "vkeys": [pdf["vkey"].tolist()], "vectors": [vectors.tobytes()], "ground": [ground], "upper": [upper], "entry": [entry]})

    rows = distinct.withColumn("shard", F.pmod(F.xxhash64("vkey"), F.lit(shards)).cast("int"))
    return rows.repartition(4 * shards, "dim", "shard").groupBy("dim", "shard").applyInPandas(run, "dim int, shard int, vkeys array<string>, vectors binary, ground binary, upper binary, entry int")


def search(index: DataFrame, queries: DataFrame, shards: int, k: int) -> DataFrame:
    """queries(vkey, vec, dim) against each shard -> qkey, vkey, score: k of each shard, those without themselves too."""
    block = F.pmod(F.xxhash64("vkey", F.lit(3)), F.lit(max(1, -(-queries.count() // QUERY_BLOCK)))).cast("int")
    blocks = queries.groupBy("dim", block.alias("block")).agg(F.collect_list(F.struct("vkey", "vec")).alias("qs"))
    blocks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    n = 4 * shards
    rows = blocks.repartition(n, "dim", "shard").join(index.repartition(n, "dim", "shard"), ["dim", "shard"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                vectors = np.frombuffer(r.vectors).reshape(-1, r.dim)
                graph = Graph.of_flat(_even(vectors), r.ground, r.upper, r.entry)
                keys = np.array(r.vkeys, object)
                for at in range(0, len(r.qs), 256):
                    out = []
                    for q in r.qs[at : at + 256]:
                        vec = np.asarray(q["vec"], np.float64)
                        found = graph.nearest(np.append(vec, 0.0), k)
                        out.append(pd.DataFrame({"qkey": q["vkey"], "vkey": keys[found], "score": (vectors[found] * vec).sum(axis=1)}))
                    yield pd.concat(out)

    return rows.select("dim", "qs", "vkeys", "vectors", "ground", "upper", "entry").mapInPandas(run, "qkey string, vkey string, score double")


def nearest(embeddings: DataFrame, every: int = 20, k: int = K, shard_rows: int = SHARD_ROWS, column: str = "embedding") -> DataFrame:
    """embeddings -> query_id, rank, vec_id, score: for each row with vec_id divisible by ``every`` its k nearest others."""
    rows = cut(usable(embeddings, column), "vectors")
    distinct = cut(rows.groupBy("vkey").agg(F.min("dim").alias("dim"), F.min_by("vec", "vec_id").alias("vec")), "distinct")
    n, dim = distinct.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).collect()[0]
    shards = max(1, -(-n // min(shard_rows, max(SHARD_BYTES // (8 * dim), 1))))
    index = cut(build_index(distinct, shards), "index")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("vkey").alias("qkey"))
    queries = cut(distinct.join(asked.select(F.col("qkey").alias("vkey")).distinct(), "vkey", "left_semi"), "queries")
    # a shard's k + 1 best, of which one may be the query's own vector
    found = cut(search(index, queries, shards, k + 1), "found")
    # of equal vectors, only the k + 1 with the smallest ids can be among the nearest
    some = rows.select("vkey", "vec_id").withColumn("r", F.row_number().over(Window.partitionBy("vkey").orderBy("vec_id"))).where(F.col("r") <= k + 1).drop("r")
    order = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    merged = found.join(some, "vkey").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("qkey", "r", "vec_id", "score")
    lists = cut(merged.groupBy("qkey").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near")), "merged")
    own = asked.join(lists, "qkey").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), "x.vec_id", "x.score")
