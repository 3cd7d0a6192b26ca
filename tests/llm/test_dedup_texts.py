import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from eventengine.llm import linededup, substring

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


# substring dedup


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=60), st.integers(1, 9))
def test_winnowing_selects_from_every_window(values, window):
    h = np.array(values, np.uint64) << np.uint64(40)
    chosen = set(substring.winnow(h, window).tolist())
    want = set()
    for i in range(len(h) - min(window, len(h)) + 1 if len(h) else 0):
        part = values[i : i + window]
        want.add(i + max(k for k, v in enumerate(part) if v == min(part)))
    assert chosen == want


def passage(seed, n=60):
    rng = np.random.default_rng(seed)
    return [f"p{rng.integers(5_000)}" for _ in range(n)]


def noise(seed, n=40):
    rng = np.random.default_rng(1_000 + seed)
    return [f"n{rng.integers(10**9)}" for _ in range(n)]


def cleaned(docs):
    return {r["doc_id"]: r for r in substring.dedup_substrings(docs).collect()}


def test_passages_inside_lines_go_from_all_but_the_first(docs_of):
    p = " ".join(passage(1))
    texts = {i: " ".join(noise(2 * i)) + " " + p.upper() + " " + " ".join(noise(2 * i + 1)) for i in range(6)}
    got = cleaned(docs_of(texts.items()))
    assert got[0]["spans"] == [] and got[0]["text"] == texts[0]
    for i in range(1, 6):
        (s,) = got[i]["spans"]
        assert texts[i][s["start"] : s["end"]] == p.upper() and s["src_doc_id"] == 0
        assert texts[0][s["src_start"] :].startswith(p.upper())
        assert got[i]["text"] == texts[i][: s["start"]] + texts[i][s["end"] :]


def test_repeats_of_the_table(spark, sf_dir, corpus):
    """Every window of 51 words that stands earlier goes (but for few whose fingerprint has another source); nothing else."""
    got = cleaned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    seen, found, missed = set(), 0, 0
    for i in sorted(corpus):
        spots = [m.span() for m in WORDS.finditer(corpus[i])]
        words = [low(corpus[i][a:b]) for a, b in spots]
        gone = np.zeros(len(corpus[i]) + 1, bool)
        for s in got[i]["spans"]:
            gone[s["start"] : s["end"]] = True
            here = [low(w) for w in WORDS.findall(corpus[i][s["start"] : s["end"]])]
            there = [low(w) for w in WORDS.findall(corpus[s["src_doc_id"]][s["src_start"] :])][: len(here)]
            assert here == there and (s["src_doc_id"], s["src_start"]) < (i, s["start"]) and len(here) >= substring.MIN_LINE_WORDS
        for k in range(len(words) - 50):
            gram = tuple(words[k : k + 51])
            if gram in seen:
                found += 1
                missed += not gone[spots[k][0] : spots[k + 50][1]].all()
            seen.add(gram)
    assert found > 100 and missed <= 0.002 * found


def test_whole_lines_and_repeats_within_a_document(docs_of):
    line = " ".join(noise(7, 25))
    texts = {1: f"{line}\nshort line\nthe end", 2: f"other start\n  {line.upper()}\nshort line", 3: " ".join(passage(5, 55) + passage(6, 30) + passage(5, 55))}
    got = cleaned(docs_of(texts.items()))
    assert got[1]["spans"] == []
    assert got[2]["text"] == "other start\n  ", "the next line, equal too, goes with it"
    (s,) = got[3]["spans"]
    assert s["src_doc_id"] == 3 and s["src_start"] == 0 and got[3]["text"].split() == passage(5, 55) + passage(6, 30)


def test_substring_edge_cases(docs_of):
    p = " ".join(passage(9))
    long = "é " * 50_000
    df = docs_of([(1, None), (2, ""), (None, p), (4, p), (5, p), (5, p), (6, "one word"), (7, long)])
    rows = substring.dedup_substrings(df).collect()
    assert len(rows) == 8
    by = {(r["doc_id"], r["text"]): r["spans"] for r in rows}
    assert by[(1, None)] == [] and by[(2, "")] == [] and by[(None, p)] == [] and by[(4, p)] == []
    assert [r["text"] for r in rows if r["doc_id"] == 5] == ["", ""]
    assert [r["text"] for r in rows if r["doc_id"] == 6] == ["one word"]
    assert substring.dedup_substrings(docs_of([])).count() == 0
    assert substring.dedup_substrings(df).columns == [*df.columns, "spans"]


def test_texts_that_share_an_id_are_documents_of_their_own(docs_of):
    p, z = " ".join(passage(11)), " ".join(noise(12, 90))
    rows = [(1, p), (5, p), (5, z), (5, z), (7, f"{z} {p}"), (5, "")]
    got = sorted((r["doc_id"], r["text"], [(s["start"], s["end"], s["src_doc_id"]) for s in r["spans"]]) for r in substring.dedup_substrings(docs_of(rows)).collect())
    assert got == sorted([(1, p, []), (5, "", [(0, len(p), 1)]), (5, z, []), (5, z, []), (7, " ", [(0, len(z), 5), (len(z) + 1, len(z) + 1 + len(p), 1)]), (5, "", [])])


def test_substring_dedup_with_clashing_names(clashing):
    p = " ".join(passage(13))
    df = clashing([(1, p), (2, p + " tail"), (None, p)])
    out = substring.dedup_substrings(df)
    assert out.columns == [*df.columns, "spans_"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[2]["text"] == " tail" and got[2]["spans"] == "spans-2" and [s["src_doc_id"] for s in got[2]["spans_"]] == [1]
    assert {r["doc_id"]: (r["row"], r["th"]) for r in substring.without_repeats(df).collect()} == {i: (f"row-{i or '?'}", f"th-{i or '?'}") for i in (1, 2, None)}


# line dedup


def brute_lines(texts):
    """Document -> number and normal form of each line with words."""
    full = {i: [(n, re.sub(r"[\x20\x09-\x0D]+", " ", line).strip().lower()) for n, line in enumerate(t.split("\n"))] for i, t in texts.items()}
    return {i: [(n, x) for n, x in rows if x] for i, rows in full.items()}


def deduped(docs):
    return {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}


def lines(seed, n):
    return [" ".join(noise(100 * seed + k, 6)) for k in range(n)]


def test_runs_go_from_later_documents(docs_of):
    a, b = lines(1, 5), lines(2, 4)
    texts = {1: "\n".join(a), 2: "\n".join([*b[:2], *[x.upper() + "  " for x in a[1:4]], *b[2:]]), 3: "\n".join([*lines(3, 2), a[2], *lines(4, 2)]), 4: "\n".join(a)}
    got = deduped(docs_of(texts.items()))
    assert got[1]["removed_lines"] == [] and got[1]["text"] == texts[1]
    assert got[2]["removed_lines"] == [2, 3, 4] and got[2]["text"] == "\n".join(b)
    assert got[3]["removed_lines"] == [], "a line alone is no run"
    assert got[4]["text"] == ""


def test_every_run_of_three_lines_is_found(docs_of, spark, sf_dir, corpus):
    """The guarantee: of each repeated run of window + 1 lines, at least a fingerprint's two lines go; the first place stays."""
    got = deduped(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    seen, runs = set(), 0
    full = brute_lines(corpus)
    for i in sorted(corpus):
        rows = full[i]
        for k in range(len(rows) - linededup.WINDOW):
            run = rows[k : k + linededup.WINDOW + 1]
            key = tuple(x for _, x in run)
            if key in seen and min(len(a.split()) + len(b.split()) for a, b in zip(key, key[1:], strict=False)) >= linededup.MIN_WORDS:
                runs += 1
                assert sum(n in got[i]["removed_lines"] for n, _ in run) >= linededup.MIN_LINES
            seen.add(key)
    assert runs > 20
    left = Counter(x for i in corpus for n, x in full[i] if n not in set(got[i]["removed_lines"]))
    assert set(left) == {x for i in corpus for _, x in full[i]}, "each line is still somewhere"


def repeated_lines(texts, least=linededup.MIN_WORDS):
    """Document -> numbers of the lines in runs of so many words or more that stand earlier, by definition."""
    full, seen, gone = brute_lines(texts), set(), {i: set() for i in texts}
    for i in sorted(texts):
        rows = full[i]
        for k in range(len(rows)):
            # a repeated run's lines are in its shortest parts of enough words, none longer than that many lines
            for n in range(1, min(2 * least, len(rows) - k) + 1):
                key = tuple(x for _, x in rows[k : k + n])
                if sum(len(x.split()) for x in key) >= least and key in seen:
                    gone[i] |= {m for m, _ in rows[k : k + n]}
                seen.add(key)
    return gone


def without_blanks(got, texts):
    return {i: {n for n in got[i]["removed_lines"] if texts[i].split("\n")[n].strip()} for i in texts}


def test_removed_lines_equal_brute_force_on_the_table(spark, sf_dir, corpus):
    """Every repeated run of MIN_WORDS words, of one line or of several, and nothing else."""
    got = deduped(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert without_blanks(got, corpus) == repeated_lines(corpus)


def test_every_pair_of_lines_is_found(docs_of):
    """Of many runs of exactly two lines between other lines, all go."""
    pairs = {k: lines(20 + k, 2) for k in range(40)}
    texts = {1: "\n".join(x for k in pairs for x in [*lines(100 + k, 1), *pairs[k]]), 2: "\n".join(x for k in pairs for x in [*lines(200 + k, 2), *pairs[k]])}
    docs = docs_of(texts.items())
    got = deduped(docs)
    assert got[1]["removed_lines"] == []
    assert got[2]["removed_lines"] == [n for n in range(160) if n % 4 >= 2]
    fewer = {r["doc_id"]: r["removed_lines"] for r in linededup.dedup_lines(docs, window=3).collect()}
    assert fewer[1] == [] and set(fewer[2]) < set(got[2]["removed_lines"])


def test_long_lines_alone_are_found(docs_of):
    """A long line goes wherever it repeats, a whole text of one line too; short lines go together only."""
    rule = "all rights reserved by the owners of this page"
    texts = {1: "\n".join([*lines(30, 1), rule, *lines(31, 1)]), 2: "\n".join([*lines(32, 1), rule.upper(), *lines(33, 1)]), 3: rule, 4: "two words\nat first\nthen more of it", 5: "a start\ntwo words\n\nat first\nthen more of it\nan end", 6: "two words\nat first"}
    got = deduped(docs_of(texts.items()))
    assert {i: got[i]["removed_lines"] for i in texts} == {1: [], 2: [1], 3: [0], 4: [], 5: [1, 2, 3, 4], 6: []}
    assert got[3]["text"] == ""


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "a b c", "d e f g h", "a b c d e f g", "a b c d e f g h", "", "  "]), max_size=14), min_size=1, max_size=6))
def test_removed_lines_equal_brute_force(docs_of, rows):
    texts = {i: "\n".join(r) for i, r in enumerate(rows)}
    assert without_blanks(deduped(docs_of(texts.items())), texts) == repeated_lines(texts)


def test_repeats_within_a_document(docs_of):
    a = lines(8, 3)
    got = deduped(docs_of([(1, "\n".join([*a, "middle line here", *a]))]))
    assert got[1]["removed_lines"] == [4, 5, 6]


def test_line_edge_cases(docs_of):
    t = "\n".join(lines(9, 4))
    rows = linededup.dedup_lines(docs_of([(1, None), (2, ""), (None, t), (4, t), (4, t), (5, "\n\n" + t), (6, "x\ny\nx\ny")])).collect()
    got = sorted((r["doc_id"] or -1, r["text"], tuple(r["removed_lines"])) for r in rows if r["text"] is not None)
    assert got == sorted([(2, "", ()), (-1, t, ()), (4, t, ()), (4, t, ()), (5, "\n", (2, 3, 4, 5)), (6, "x\ny\nx\ny", ())])
    assert sum(r["text"] is None for r in rows) == 1
    assert linededup.dedup_lines(docs_of([])).count() == 0


def test_line_dedup_of_shared_ids_and_long_texts(docs_of):
    a, z = "\n".join(lines(14, 4)), "\n".join(lines(15, 4))
    many = "\n".join(f"line number {k} of a very long text with words" for k in range(60_000))
    rows = linededup.dedup_lines(docs_of([(1, a), (5, a), (5, z), (8, many), (9, many + "\nand an end of its own, long enough to count")])).collect()
    got = sorted((r["doc_id"], len(r["removed_lines"]), r["text"]) for r in rows)
    assert got == sorted([(1, 0, a), (5, 4, ""), (5, 0, z), (8, 0, many), (9, 60_000, "and an end of its own, long enough to count")])


def test_line_dedup_with_clashing_names(clashing):
    a = "\n".join(lines(16, 4))
    df = clashing([(1, a), (2, a + "\nmore"), (None, a)])
    out = linededup.dedup_lines(df)
    assert out.columns == [*df.columns, "removed_lines_"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert (got[2]["text"], got[2]["removed_lines"], got[2]["removed_lines_"]) == ("more", "removed_lines-2", [0, 1, 2, 3])
    assert linededup.without_repeats(df).columns == df.columns


def test_line_dedup_is_native(docs_of):
    plan = linededup.dedup_lines(docs_of([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
