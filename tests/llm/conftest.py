import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with an extra column whose name operators use themselves."""

    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + (", rep string, ids string" if extra else "")
        return spark.createDataFrame([(i, t, "en", s, len(t or ""), *(("x", "y") if extra else ())) for i, t, s in (r if len(r) == 3 else (*r, "src0") for r in rows)], schema)

    return make


#: Names that operators use themselves.
OWN = "rep ids th did row spans removed_lines gone failed m host first again start end src seeds __gone __id __hash __spans __failed __m __doc".split()


@pytest.fixture(scope="session")
def clashing(docs_of):
    """docs_of with columns of all those names, each with values of its own."""
    from pyspark.sql import functions as F

    def make(rows):
        df = docs_of(rows, extra=False)
        return df.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in OWN])

    return make


@pytest.fixture(scope="session")
def corpus(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
