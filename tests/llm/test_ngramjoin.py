import numpy as np
import pytest

from eventengine.llm import ngramjoin
from eventengine.llm.minhash import shingle_set
from eventengine.llm.words import WordHashes

from test_minhash import brute


def got(docs):
    return sorted(map(tuple, ngramjoin.linked(docs).collect()))


def want(texts):
    return sorted((i, n, c) for i, (n, c, _) in brute(texts, 80).items())


def test_equals_brute_force_on_the_table(spark, sf_dir, corpus):
    assert got(spark.read.parquet(f"{sf_dir}/documents.parquet")) == want(corpus)


def copies(seed, many, length, most, words=10_000):
    """Copies of one text with up to ``most`` words exchanged for one of 40 others."""
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(words)}" for _ in range(length)]
    out = []
    for _ in range(many):
        w = list(base)
        for p in rng.choice(length, int(rng.integers(0, most)), replace=False):
            w[p] = f"e{rng.integers(40)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("crowd", [2, 500])
def test_large_group_of_near_copies(docs_of, monkeypatch, crowd):
    """Some are linked to the base only, some to each other only, some not at all; in crowded columns and in others."""
    monkeypatch.setattr(ngramjoin, "CROWD", crowd)
    texts = dict(enumerate(copies(3, 150, 120, 9)))
    found = want(texts)
    assert len({c for _, _, c in found}) > 5
    assert got(docs_of(texts.items())) == found


@pytest.mark.parametrize("crowd", [3])
def test_passage_in_many_documents(docs_of, monkeypatch, crowd):
    """A passage and a first half that many texts share link only those that are near copies beside."""
    monkeypatch.setattr(ngramjoin, "CROWD", crowd)
    rng = np.random.default_rng(5)
    draw = lambda n: [f"v{rng.integers(3000)}" for _ in range(n)]
    passage, half = draw(60), draw(45)
    texts = {}
    for i in range(80):
        own = draw(int(rng.integers(5, 150)))
        texts[i] = " ".join([*own, *passage, *draw(10)] if i % 3 else [*half, *own[:60]])
    for i in range(80, 110):
        w = texts[i - 80].split()
        for p in rng.choice(len(w), int(rng.integers(1, 4)), replace=False):
            w[p] = "changed"
        texts[i] = " ".join(w)
    assert got(docs_of(texts.items())) == want(texts)


def test_at_the_threshold(docs_of):
    """Sizes and overlaps around 80 in 100, of equal and of different sizes, by words that stand at the end."""
    texts, base = {}, [f"b{i}" for i in range(104)]
    for k in range(15, 35):
        texts[2 * k] = " ".join([*(f"k{k}{w}" for w in base), *(f"x{k}{i}" for i in range(k))])
        texts[2 * k + 1] = " ".join(f"k{k}{w}" for w in base)
        texts[2 * k + 1000] = " ".join([*(f"k{k}{w}" for w in base), *(f"y{k}{i}" for i in range(20))])
    assert got(docs_of(texts.items())) == want(texts)


def test_nulls_short_and_repeated_rows(docs_of):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (7, None), (8, "a b c d e"), (9, "a b c d e"), (9, "a b c d e"), (None, "one two"), (None, None)]
    found = sorted(map(tuple, ngramjoin.linked(docs_of(rows)).collect()), key=repr)
    assert found == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 0, 7), (8, 1, 8), (9, 1, 8), (9, 1, 8), (None, 1, None), (None, 0, None)], key=repr)


def test_clashing_names_empty_table_and_long_text(clashing, docs_of):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long), (2, long + " end"), (3, "short"), (4, "x" * 300_000)]
    assert [r[2] for r in got(clashing(rows))] == [1, 1, 3, 4]
    assert got(docs_of([(1, "a")]).limit(0)) == []


def test_a_shared_id(docs_of):
    """Each text of an id has its own links; the id reaches what any of them reaches."""
    a, b = copies(7, 1, 80, 1)[0], copies(8, 1, 80, 1)[0]
    rows = [(5, a), (5, b), (6, a + " more"), (3, b + " more")]
    assert got(docs_of(rows)) == [(3, 77, 3), (5, 76, 3), (5, 76, 5), (6, 77, 5)]


def test_partners_meet_in_a_column():
    """Of two sets at the threshold, the parts that are spread out have a column in common, whatever their words."""
    rng, cache = np.random.default_rng(9), WordHashes()
    for _ in range(200):
        n = int(rng.integers(5, 300))
        m = int(rng.integers(-(-80 * n // 100), n + 1))
        both = -(-80 * (n + m) // 180)
        if both > m:
            continue
        words = [f"w{rng.integers(10**9)}" for _ in range(n + m - both)]
        sets = [words[:n], words[n - both :]]
        parts = []
        for w in sets:
            found = np.sort(np.unique([shingle_set(x, cache)[0] for x in w]) >> np.uint64(1)).view(np.int64)
            low = int(np.searchsorted(found, ngramjoin.LOW))
            parts.append(set(found[: max(low, len(found) - -(-80 * len(found) // 100) + 1)].tolist()))
        assert parts[0] & parts[1]
