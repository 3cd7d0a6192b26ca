import pytest

from eventengine.plans.queries import QUERIES, SQL
from helpers import duck, rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_itineraries_are_sequenced(spark, sf_dir):
    got = QUERIES["itineraries"](spark, sf_dir).collect()
    assert got
    by = {}
    for r in got:
        by.setdefault(r["request_id"], []).append((r["stop_no"], r["kind"]))
    order = ["pre_event_drink", "main_event", "late_night_snack"]
    for stops in by.values():
        stops.sort()
        assert [n for n, _ in stops] == list(range(1, len(stops) + 1))
        assert sorted((k for _, k in stops), key=order.index) == [k for _, k in stops]
        assert "main_event" in [k for _, k in stops]


def test_prompts_are_whole_texts(spark, tmp_path):
    """Keywords past the fortieth character of a turn count."""
    far = "please look through everything on the list for us " + "and more " * 30
    turns = [(4, 0, "user", far + "then a bar crawl in Oakland tonight"), (10, 0, "user", far), (4, 1, "assistant", "a date night in berkeley")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["request_id"]: (r["intent"], r["geography"], r["label"]) for r in QUERIES["prompt_intents"](spark, str(tmp_path)).collect()}
    assert got == {4000: ("bar_crawl", "oakland", "tonight"), 10000: ("general_night_out", None, "upcoming_week")}


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
