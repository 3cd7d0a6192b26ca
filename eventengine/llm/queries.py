"""One query for each operator of this subpackage, over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, classifier, hardneg, hnsw, linededup, minhash, ngramjoin, packing, quality_rules, repair, sharding, substring
from .work import cut, shared_dir, table

SAID = "</s>[INST] ok [/INST]"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map's versions stay as a table in the shared folder; an input's next run reads and edits the last one."""
    maps = f"{shared_dir(spark)}/slot-map-{hashlib.md5(sf_dir.encode()).hexdigest()}"
    return sharding.shard(table(spark, sf_dir, "documents"), maps)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path, pattern).select("doc_id", "ids")
    both = bpe.decode(ids, path, pattern)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.pack_blocks(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.number_sequences(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op6_winnowed_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op7_sharded_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op8_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op9_prefix_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAID).alias("text"))
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    trees, convs = chat.format_chats(rows.unionByName(more), ranks, pattern)
    digests = cut(chat.read_back(cut(trees, "trees", **chat.GROUPS), ranks, pattern), "digests")
    return convs.join(digests, "leaf").drop("leaf")


def op10_line_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents"))



def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.linked(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.audit(rows, repair.damaged(rows))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.mine(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_virtual_slot_sharding,
        op3_quality_classifier,
        op4_byte_bpe,
        op5_differencing_packing,
        op6_winnowed_line_dedup,
        op7_sharded_hnsw,
        op8_host_quality_rules,
        op9_prefix_tree_chat,
        op10_line_passage_dedup,
        op11_ngram_jaccard_join,
        op12_conversation_repair,
        op13_hard_negatives,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op9_prefix_tree_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || txt || chr(10), '' ORDER BY turn NULLS FIRST, role, txt)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(txt) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN txt END, '' ORDER BY turn NULLS FIRST, role, txt), '')) AS loss_sha256,
               CAST(sum(length(replace(replace(replace(replace(role, '%', '%25'), '|', '%7C'), '<', '%3C'), chr(10), '%0A')) + 5
                   + length(replace(replace(txt, '%', '%25'), '<|', '%3C|')) + 8) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    "op13_hard_negatives": r"""
        WITH v AS (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS n
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
                   CAST(list_sum(list_transform(list_zip(a.n, b.n), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.n) = len(b.n) WHERE a.vec_id % 100 = 0
        ),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ),
        n AS (
            SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS r
            FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
            WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        )
        SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 10
    """,
    "op8_host_quality_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS txt, source AS host FROM documents),
        w AS (SELECT rid, list_filter(string_split_regex(txt, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
        g AS (
            SELECT rid, i, array_to_string(list_slice(words, i, i + 7), ' ') AS gram
            FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
        ),
        rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
        cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY rid),
        ln AS (SELECT rid, unnest(string_split(txt, chr(10))) AS line FROM d),
        dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
        m AS (
            SELECT d.rid, doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
                   CAST(length(regexp_replace(txt, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                   CAST(length(txt) - length(regexp_replace(txt, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
            FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid)
        ),
        f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
        h AS (SELECT host, count(*) AS n, sum(CAST(base_failed AS INT)) AS f FROM f GROUP BY host),
        p0 AS (SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS m2 FROM h),
        p AS (SELECT m, least(greatest(m * (1 - m) / greatest(m2 - m * m, 1e-12) - 1, 1.0), 1000.0) AS s FROM p0),
        v AS (SELECT host, (f + s * m) / (n + s) AS rate, f > m * n AS worse FROM h, p)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT (rate > 0.5 AND worse) AS kept, f.host AS host, round(rate, 9) AS host_rate
        FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host
    """,
}
