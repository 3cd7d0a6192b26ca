import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from eventengine.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "", ("x", "u"): "u"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain(convs, rows):
    """A forward search over whole edit strings, for each state of the grammar the cheapest and least."""
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for conv in set(convs):
        mine = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            left = re.sub("[\x20\x09-\x0d]", "", text)
            faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
            seen.add((role, text))
        step = lambda state, c: {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, c))
        best = {"0": (0, "", ())}

        def filled(best):
            for _ in range(3):
                for state, (cost, edits, turns) in list(best.items()):
                    for role in ("user", "assistant"):
                        if to := step(state, role[0]):
                            new = (cost + 2, edits + "I", (*turns, f"{role}:"))
                            if to not in best or new[:2] < best[to][:2]:
                                best[to] = new
            return best

        best = filled(best)
        for (_, _, role, text), fault in zip(mine, faults, strict=True):
            new = {}

            def offer(state, *what):
                if state and (state not in new or what[:2] < new[state][:2]):
                    new[state] = what

            for state, (cost, edits, turns) in best.items():
                offer(state, cost + 3, edits + "D", turns)
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    offer(step(state, role[:1]) if role else None, cost + more, edits + "K", (*turns, f"{role}:{text}"))
                    for to in ("user", "assistant"):
                        offer(step(state, to[0]), cost + 2 + more, edits + "R", (*turns, f"{to}:{text}"))
            best = filled(new)
        cost, edits, turns = min((v for k, v in best.items() if k in "0a"), key=lambda v: v[:2])
        have = [r[1] for r in mine if r[1] is not None]
        gaps = max(have) - min(have) + 1 - len(set(have)) if have else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        said = hashlib.sha256("\n".join(turns).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, said)
    return out


def got(spark, rows, after=None):
    df = spark.createDataFrame(rows, SCHEMA)
    found = repair.audit(df, repair.damaged(df) if after is None else spark.createDataFrame(after, SCHEMA)).collect()
    assert len(found) == len({r[0] for r in rows})
    return {r[0]: tuple(r[1:]) for r in found}


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    found = {r[0]: tuple(r[1:]) for r in queries.op12_conversation_repair(spark, sf_dir).collect()}
    assert found == plain([r[0] for r in rows], damage(rows))
    assert any(set("DIKR") & set(v[6]) - {"K"} for v in found.values())


def random_rows(seed, n, convs=12):
    rng = random.Random(seed)
    texts = ["Yes.", "No!  \n", "so", " ", "", "what?\t", "x . y", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "Ultra", None]
    return [(rng.choice([*range(convs), None]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_random_rows(spark, seed):
    rows = random_rows(seed, 260)
    assert got(spark, rows) == plain([r[0] for r in rows], damage(rows))


def test_undamaged_ties_and_repeats(spark):
    rows = random_rows(9, 200, convs=30)
    after = [(c, t, r or "u", x or " ") for c, t, r, x in rows] * 2
    assert got(spark, rows, after) == plain([r[0] for r in rows], after)


def test_blocks_and_batches(spark):
    """A long conversation over many blocks and Arrow batches has the edits of a plain search."""
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b.", f"c{t}.", f"d{t}", ""])) for t in range(400)]
    rows += [(8, 0, "user", "hi."), (8, 1, "assistant", "ho.")]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        edits = repair.repaired(df, block=7).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain([7, 8], rows)
    for conv in (7, 8):
        mine = sorted((r for r in edits if r["conv_id"] == conv), key=lambda r: r["seq"])
        assert [r["seq"] for r in mine] == list(range(len(mine)))
        assert "".join(r["edit"] for r in mine) == want[conv][6]
        text = "\n".join(f"{r['role']}:{r['text']}" for r in mine if r["edit"] != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == want[conv][7]
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in mine if r["edit"] != "D"))


def test_spilled_bytes_are_one_a_row(spark):
    rows = spark.range(1000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat(id, '.') as text")
    spilled = repair.choices(repair.counted(rows), block=300).collect()
    assert sorted(len(r["edits"]) for r in spilled) == [100, 300, 300, 300]


def test_repeated_without_end(spark):
    rows = spark.range(20_000).selectExpr("1L as conv_id", "0L as turn", "'user' as role", "'hi.' as text")
    r = repair.audit(rows, rows).collect()[0]
    assert (r["duplicate"], r["illegal"], r["audit"]) == (19_999, 19_999, "K" + "D" * 19_999 + "I")
    assert r["cost"] == 3 * 19_999 + 2


def test_empty_and_extra_columns(spark):
    assert repair.audit(*[spark.createDataFrame([], SCHEMA)] * 2).collect() == []
    rows = spark.createDataFrame([(1, 0, "user", "a.", "x", 1), (1, 1, "assistant", "b.", "y", 2)], SCHEMA + ", edits string, copies int")
    r = repair.audit(rows, rows).collect()[0]
    assert (r["audit"], r["cost"]) == ("KK", 0)
    r = repair.audit(rows, rows.limit(0)).collect()[0]
    assert (r["audit"], r["cost"], r["repaired_sha256"]) == ("", 0, hashlib.sha256(b"").hexdigest())
