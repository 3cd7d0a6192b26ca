import base64
import hashlib
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventengine.llm import bpe, packing
from eventengine.llm.queries import op4_byte_bpe, op5_differencing_packing

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORD_PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def enc():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op4_equals_the_library(spark, sf_dir, corpus, enc):
    for r in op4_byte_bpe(spark, sf_dir).collect():
        text = corpus[r["doc_id"]] or ""
        ids = enc.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.text("ab'sé 1\n\t\r\xa0 _-.漢", max_size=80), st.integers(1, 6))
def test_cuts_change_nothing(text, size):
    enc = bpe.encoding(PATH, PATTERN)
    parts = bpe.pieces(text, size)
    assert "".join(parts) == text
    assert [x for p in parts for x in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


@settings(max_examples=80, deadline=None)
@given(st.text("abcdeéthing", min_size=1, max_size=60))
def test_long_merges_equal_the_library(word):
    enc = bpe.encoding(PATH, PATTERN)
    want = [x for m in regex.findall(PATTERN, word) for x in enc.encode_ordinary(m)]
    assert [x for m in regex.findall(PATTERN, word) for x in bpe.merge_long(m.encode(), enc._mergeable_ranks)] == want


def test_very_long_texts(enc):
    pat = regex.compile(PATTERN)
    word = "abc" * 100_000
    assert enc.decode(bpe.encode_text(word, enc, pat)) == word
    prose = "many words, 12 numbers\n" * 20_000
    assert bpe.encode_text(prose, enc, pat) == enc.encode_ordinary(prose)


@pytest.mark.parametrize("space", [" ", "\n", " \n\t\u3000\r"])
def test_long_white_space_equals_the_library(enc, space):
    pat, run = regex.compile(PATTERN), (space * 5_000)[:5_000]
    for text in (f"{run}word x", f"a b{run}word", f"word{run}", run, f"a{run}.", f"a{run}\x1cb", f"{run}1 {run}"):
        assert bpe.encode_text(text, enc, pat) == enc.encode_ordinary(text)


@cache
def merged(run):
    return bpe.merge_long(run.encode(), bpe.encoding(PATH, PATTERN)._mergeable_ranks)


@pytest.mark.parametrize("text, space", [(t, s) for s in (" ", "\n") for t in ("{}two", "one{}", "one 1{}two three", "{}")] + [("one 1{}two three", " \n")])
def test_two_million_blanks_and_breaks(enc, text, space):
    """All but the last of a run before a word are one match by the pattern's rule."""
    run = (space * 2_000_000)[:2_000_000]
    whole, (before, after) = text.format(run), text.split("{}")
    ids = bpe.encode_text(whole, enc, regex.compile(PATTERN))
    assert enc.decode_bytes(ids) == whole.encode()
    right = enc.encode_ordinary(run[-1] + after) if after else []
    assert ids == enc.encode_ordinary(before) + merged(run[:-1] if after else run) + right


def test_long_white_space_in_spark(docs_of):
    blank = " " * 1_200_000
    df = docs_of([(1, f"a{blank}b"), (2, "\n" * 1_200_000 + "c")])
    rows = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert {r["doc_id"]: bytes(r["decoded"]) for r in rows} == {r["doc_id"]: r["text"].encode() for r in df.collect()}


def test_bpe_edge_cases(docs_of):
    df = docs_of([(1, None), (2, ""), (2, ""), (3, "<|endoftext|> a")])
    rows = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted((r["doc_id"], bytes(r["decoded"])) for r in rows) == [(1, b""), (2, b""), (2, b""), (3, b"<|endoftext|> a")]
    assert 50256 not in [x for r in rows for x in r["ids"]]
    assert bpe.encode(docs_of([]), PATH, PATTERN).count() == 0
    out = bpe.encode(df, PATH, PATTERN)
    assert out.columns == [*[c for c in df.columns if c != "ids"], "ids"]


# packing


def check_pieces(rows, texts, ids_of=None, capacity=packing.CAPACITY):
    tok = Tokenizer.from_file(WORD_PATH)
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in texts.items():
        ids, at = [*tok.encode(text or "", add_special_tokens=False).ids, packing.END_ID], 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            data = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (zlib.crc32(data) == r["ids_crc32"]) if ids_of is None else bytes(r[ids_of]) == data
            at += r["length"]
        assert at == len(ids)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= capacity
    assert sorted(seqs) == list(range(len(seqs)))
    return seqs


def test_op5_packs_all_ids(spark, sf_dir, corpus):
    rows = op5_differencing_packing(spark, sf_dir).collect()
    seqs = check_pieces(rows, corpus)
    padding = 1 - sum(r["length"] for r in rows) / packing.CAPACITY / len(seqs)
    assert padding < 0.05


@pytest.mark.parametrize("parts", [1, 8, 200])
def test_padding_does_not_follow_the_partitions(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(parts)
    pieces = packing.number_sequences(packing.pack_blocks(docs, WORD_PATH).withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    rows = pieces.collect()
    seqs = check_pieces(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert 1 - sum(r["length"] for r in rows) / packing.CAPACITY / len(seqs) < 0.02


def test_blocks_across_partitions(docs_of):
    """Full blocks, tails of partitions, and several blocks of tails."""
    texts = {i: " ".join(f"w{i * j % 977}" for j in range(i % 90)) for i in range(600)}
    pieces = packing.number_sequences(packing.pack_blocks(docs_of(texts.items()).repartition(7), WORD_PATH, 256, 4096), 256, 4096)
    rows = pieces.collect()
    seqs = check_pieces(rows, texts, "ids", 256)
    assert 1 - sum(r["length"] for r in rows) / 256 / len(seqs) < 0.12


def test_packing_edge_cases(docs_of):
    texts = {1: None, 2: "", 3: " \n ", 4: "ÀÉ’s İstanbul x\x1cy <|endoftext|> ﬁ", 5: "word " * 30_000, 6: "x" * 5_000}
    rows = packing.pack(docs_of(texts.items()), WORD_PATH).collect()
    check_pieces(rows, texts, "ids")
    assert packing.pack(docs_of([]), WORD_PATH).count() == 0
    twice = packing.pack(docs_of([(1, "a"), (1, "a"), (None, "b")]), WORD_PATH).collect()
    assert len(twice) == 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60))
def test_windows_hold_each_item_once(sizes):
    got = packing.windows(sizes, 60)
    assert sorted(i for w in got for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 60 for w in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=8, max_size=60), st.integers(2, 6))
def test_differencing_is_near_equal(sizes, k):
    loads = [sum(sizes[i] for i in w) for w in packing._difference(sizes, k)]
    assert sum(loads) == sum(sizes) and len(loads) <= k
    assert max(loads) - min([*loads, *[0] * (k - len(loads))]) <= max(sizes)


@settings(max_examples=60, deadline=None)
@given(st.text("abÉ'sß1 \n\t  ́İΣ_", max_size=60))
def test_ids_word_by_word(text):
    tok = Tokenizer.from_file(WORD_PATH)
    got = np.frombuffer(packing.tokens(text, packing.WordIds(WORD_PATH)), "<u4").tolist()
    assert got == [*tok.encode(text, add_special_tokens=False).ids, packing.END_ID]
