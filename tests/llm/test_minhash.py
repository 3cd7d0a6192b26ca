import re
from collections import defaultdict

import numpy as np
import pytest

from eventengine.llm import minhash
from eventengine.llm.components import components
from eventengine.llm.words import WordHashes


def sets_of(texts, n=5):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    return out


def brute(texts, threshold=85):
    sets, parent = sets_of(texts), {i: i for i in texts}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            near[x].add(i)
    for a, b in {(a, b) for group in near.values() for a in group for b in group if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= threshold * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in texts}


def got(docs):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())


def test_equals_brute_force_on_the_table(spark, sf_dir, corpus):
    rows = got(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert rows == sorted((i, *v) for i, v in brute(corpus).items())


def test_group_of_near_copies(docs_of):
    """Copies with edits of their own: some are linked to the base only, some to each other only, some not at all."""
    rng = np.random.default_rng(3)
    words = [f"w{rng.integers(10_000)}" for _ in range(120)]
    texts = {}
    for i in range(150):
        w = list(words)
        for p in rng.choice(len(w), int(rng.integers(0, 7)), replace=False):
            w[p] = f"e{rng.integers(40)}"
        texts[i] = " ".join(w)
    assert got(docs_of(texts.items())) == sorted((i, *v) for i, v in brute(texts).items())


def test_edge_cases(docs_of):
    long = " ".join(f"t{i % 977}" for i in range(60_000))
    texts = {1: None, 2: "", 3: " \n\t ", 4: "One two", 5: "one\x0bTWO", 6: "one two three", 7: long, 8: long + " end", 9: "É one two three four five", 10: "é one two three four five"}
    rows = got(docs_of(texts.items()))
    assert rows == sorted((i, *v) for i, v in brute(texts).items())
    by = {r[0]: r for r in rows}
    assert by[1] == (1, 0, 1, True) and by[5][2] == 4 and by[8][2] == 7
    assert by[10][2] == 10, "only A-Z are lower-cased"


def test_repeated_and_null_ids(docs_of):
    rows = minhash.near_duplicates(docs_of([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in rows) == [(-1, -1, True), (3, 3, True), (3, 3, True), (5, 3, False)]


def test_texts_that_share_an_id(docs_of):
    """Each text is linked for itself, in any order of the rows."""
    a, b = "a b c d e f", "g h i j k l"
    rows = [(5, a), (5, b), (6, a), (7, b), (8, a), (9, "x y z w v"), (9, b), (9, "q r s t u")]
    want = [(5, 5), (5, 5), (6, 5), (7, 5), (8, 5), (9, 5), (9, 9), (9, 9)]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        assert sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs_of(order)).collect()) == want


def test_keep_one_of_repeated_rows(docs_of, clashing):
    a, b = "a b c d e f", "g h i j k l"
    rows = [(1, a), (1, a), (2, a), (3, b), (3, a), (None, a), (None, a), (4, ""), (4, ""), (5, None)]
    kept = minhash.keep_one(docs_of(rows)).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept) == [(-1, a), (-1, a), (1, a), (3, b), (4, ""), (4, ""), (5, "")]
    df = clashing(rows)
    out = minhash.keep_one(df)
    assert out.columns == df.columns and sorted(r["rep"] for r in out.collect()) == sorted(f"rep-{i}" for i in ("?", "?", 1, 3, 4, 4, 5))
    assert len(got(df)) == len(rows) if all(i for i, _ in rows) else minhash.near_duplicates(df).count() == len(rows)


def test_empty_table(docs_of):
    assert got(docs_of([])) == []
    assert minhash.keep_one(docs_of([])).count() == 0


def test_keep_one_keeps_columns(docs_of):
    df = docs_of([(2, "a b c d e f"), (1, "a b c d e f"), (4, "")])
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 2_000).astype(np.uint64)
    a, b = np.unique(base[:1_800]), np.unique(base[200:])
    sa, sb = minhash.signatures([a, b], 512)
    assert abs((sa == sb).mean() - 0.8) < 0.06


def test_permutation_is_a_bijection():
    x = np.arange(1 << 20, dtype=np.uint32)
    assert len(np.unique(minhash._permute(x.copy()))) == len(x)


def test_short_sets_differ_from_longer_ones():
    cache = WordHashes()
    assert len(minhash.shingle_set("a b", cache)) == 1
    assert minhash.shingle_set("a b", cache)[0] != minhash.shingle_set("a b c", cache)[0]


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i + 1, i) for i in range(40)], [(9, i) for i in range(9)] + [(20, 21)]])
def test_components(spark, links):
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else top(parent[x])

    for u, v in links:
        if u != v:
            a, b = top(u), top(v)
            parent[max(a, b)] = min(a, b)
    rows = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert sorted(map(tuple, rows)) == sorted((x, top(x)) for x in list(parent))


def test_components_take_few_tasks(spark):
    """A hot node, a chain and a lattice over 64 partitions that stay as many: no more tasks than a few shuffles have."""
    links = [(2_000 - i % 7, i) for i in range(1_900)] + [(i + 1, i) for i in range(3_000, 3_200)] + [(4_000 + (i * 37) % 211, 4_000 + i) for i in range(211)]
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    sc, group = spark.sparkContext, "components-tasks"
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup(group, group)
        rows = components(spark.createDataFrame(links, "u long, v long").repartition(16)).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    parent = {x: x for e in links for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = top(u), top(v)
        parent[max(a, b)] = min(a, b)
    linked = {x for u, v in links if u != v for x in (u, v)}
    assert sorted(map(tuple, rows)) == sorted((x, top(x)) for x in linked)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    assert tasks < 1_200, tasks
