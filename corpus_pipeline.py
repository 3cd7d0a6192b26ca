"""The corpus pipeline: quality rules, line dedup, near-dedup, substring dedup, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventengine.llm import linededup, minhash, packing, quality_rules, substring
from eventengine.llm.work import cut, table

#: Near copies of the corpus share 0.8 of their shingles or more; op 1 has a threshold of its own.
NEAR = 80


def _rewritten(docs: DataFrame, cleaned: DataFrame) -> DataFrame:
    """cleaned with the columns of docs; n_chars, where there is one, follows the text."""
    counted = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned
    return counted.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Null texts and texts without words are rejected; a null source is a host of its
    own; repeated rows count, and stay or go, each for itself."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go from the texts. Null texts and rows without doc_id stay as they are; rows equal in
    doc_id and text get the same text."""
    return _rewritten(docs, linededup.without_repeats(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the smallest doc_id, then the least hash of the text, and one of rows
    equal in both. Null texts, texts without words and rows without doc_id stay."""
    return minhash.keep_one(docs, NEAR)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of lines and passages go from the texts. Null texts and rows without doc_id stay as they are; rows
    equal in doc_id and text get the same text."""
    return _rewritten(docs, substring.without_repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences. A null text is the end id alone; rows without doc_id and repeated rows are
    packed as any."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near_duplicates), ("substring dedup", substrings), ("packing", pack)]

#: Near-dedup and packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
