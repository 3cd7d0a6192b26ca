import numpy as np
import pytest

from eventengine.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, every=100):
    kept = set()
    for i, vec, label in rows:
        if i is None or label is None or not vec or any(x is None or not np.isfinite(x) or not -(1 << 27) <= x * 256 < 1 << 27 for x in vec):
            continue
        kept.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(256 * x)) for x in vec)))
    out = []
    for i, label, vec in kept:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vec, w, strict=True)), j, m == label) for j, m, w in kept if j != i and len(w) == len(vec))
        for p, j, _ in [s for s in scored if s[2]][:5]:
            inside = [s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(i, j, r, k, -p, -n) for r, (n, k, _) in enumerate(inside, 1)]
    return sorted(out)


def got(df, **settings):
    return sorted(map(tuple, hardneg.mine(df, **settings).collect()))


def vectors(seed, n, dim=20, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in rng.normal(0, spread, dim)], int(rng.integers(3))) for i in range(n)]


def test_scores_are_inner_products():
    rng = np.random.default_rng(1)
    for dims, top in ((1, 3), (7, 200), (8, 200), (64, 1 << 27), (65, 1 << 20)):
        a, b = (rng.integers(-top, top, (n, dims)) for n in (9, 50))
        found = hardneg.scores(hardneg.pack(b), hardneg.subset_sums(a))
        assert (found == b @ a.T).all()
    assert hardneg.pack(np.array([[-1], [0]])).shape[0] == 1
    sums = hardneg.subset_sums(np.array([[1, 2, 4, 8, 16, 32, 64, 128]]))
    assert sums[0, :, 0].tolist() == list(range(256))


@pytest.mark.parametrize("settings", [{}, {"block_rows": 16, "block_anchors": 2}])
def test_equals_brute_force(spark, settings):
    rows = vectors(2, 400)
    assert got(spark.createDataFrame(rows, SCHEMA), every=10, **settings) == plain(rows, 10)


def test_ties_repeats_and_lengths(spark):
    rows = vectors(3, 120, dim=3, spread=0.02) + vectors(4, 60, dim=2, spread=0.02)
    rows += rows[:30] + [(i, v, 1) for i, v, _ in rows[5:40]]
    assert got(spark.createDataFrame(rows, SCHEMA), every=10) == plain(rows, 10)


def test_what_takes_no_part(spark):
    rows = vectors(5, 100)
    bad = [(None, [1.0] * 20, 1), (100, None, 1), (200, [1.0] * 20, None), (300, [None] + [1.0] * 19, 1), (400, [float("nan")] * 20, 1), (500, [float("inf")] * 20, 1), (600, [1e300] * 20, 1), (700, [], 1), (800, [600_000.0] * 20, 0)]
    assert got(spark.createDataFrame(rows + bad, SCHEMA), every=20) == plain(rows, 20)


def test_zeros_and_large_numbers(spark):
    rows = [(i, [0.0] * 9, i % 2) for i in range(8)] + [(100 + i, [5e5 * (-1) ** i, *[1.0 * i] * 8], i % 3) for i in range(40)]
    assert got(spark.createDataFrame(rows, SCHEMA), every=2) == plain(rows, 2)


def test_one_label_and_no_rows(spark):
    df = spark.createDataFrame([(i, v, 1) for i, v, _ in vectors(6, 50)], SCHEMA)
    assert got(df.where("vec_id % 7 <> 0"), every=10) == []
    assert got(df.limit(0)) == []


def test_clashing_columns(spark):
    rows = vectors(7, 80)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA + ", akey string, dim string, nums string")
    assert got(df, every=10) == plain(rows, 10)
