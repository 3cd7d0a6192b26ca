"""Pairs of similar titles, found by shared rare bigrams and never by all pairs.

Rule: insert/delete similarity above ``OVER``, that is a distance d with d < (1 - OVER/100)(m + n) for lengths m and n. As
n is at most m + d, d is under 0.15/0.85 * 2m = ``REACH`` m. One insertion or deletion changes at most two bigrams of a title
(with a mark at both ends), so that titles at distance d lack at most 2d of each other's bigrams. Ordered from the rarest
bigram to the commonest, two such titles share one of their first 2d + 1. Only titles that do so meet; lengths, Spark's
bounded edit distance and the exact ratio then decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity

OVER = 85.0
REACH = 2 * (1 - OVER / 100) / (OVER / 100)


def title_key(title: Column) -> Column:
    return F.lower(F.trim(title))


def _bigrams(t: Column) -> Column:
    marked = F.concat(F.lit("\x02"), t, F.lit("\x03"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(marked) - 1), lambda i: F.substring(marked, i, 2)))


def _prefixes(titles: DataFrame, rarity: DataFrame, key: list[str]) -> DataFrame:
    """titles(key, t) -> key, t, gram: the rarest bigrams of each, as many as the rule needs."""
    grams = titles.select(*key, "t", F.explode(_bigrams(F.col("t"))).alias("gram")).join(rarity, "gram")
    ordered = grams.groupBy(*key, "t").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("x"))
    return ordered.select(*key, "t", F.explode(F.slice("x", 1, 2 * F.floor(F.length("t") * REACH).cast("int") + 1)).alias("x")).select(*key, "t", "x.gram")


def similar(left: DataFrame, right: DataFrame | None, key: list[str]) -> DataFrame:
    """left(key, t) and right(key, t), titles in lower case and trimmed -> key, a, b: similar ones with the same key.

    Without ``right``, the pairs within ``left``, each once and none of equal titles.
    """
    own = left.where("t <> ''").select(*key, "t").distinct()
    other = own if right is None else right.where("t <> ''").select(*key, "t").distinct()
    both = own.select("t") if right is None else own.select("t").union(other.select("t"))
    rarity = both.distinct().select(F.explode(_bigrams(F.col("t"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    met = _prefixes(own, rarity, key).withColumnRenamed("t", "a").join(_prefixes(other, rarity, key).withColumnRenamed("t", "b").hint("merge"), [*key, "gram"])
    bound = F.ceil(F.lit(1 - OVER / 100) * (F.length("a") + F.length("b"))).cast("int")
    near = met.where((F.col("a") < F.col("b")) if right is None else F.lit(True)).where(F.abs(F.length("a") - F.length("b")) < bound).select(*key, "a", "b").distinct()
    # the insert/delete distance is at least the edit distance
    return near.where(F.levenshtein("a", "b") < bound).where(similarity.title_similarity("a", "b") > OVER)
