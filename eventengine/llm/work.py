"""Reading inputs and cutting lineage, shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks a core that write the table of a step.
WAVES = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A temporary one is set only for a local master that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Write df to the shared folder and read it back: the plan ends there, and a lost executor costs a reread only.
    ``options`` are the Parquet writer's."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def step(df: DataFrame, name: str) -> DataFrame:
    """cut() for the tables of iterative steps, written by at most ``WAVES`` tasks a core: a file for each shuffle partition
    would cost more than their rows."""
    return cut(df.coalesce(WAVES * df.sparkSession.sparkContext.defaultParallelism), name)


def grown(df: DataFrame) -> DataFrame:
    """A join side that grows with the input: merged, never broadcast, so that plans are the same at every size."""
    return df.hint("merge")


def free(taken: DataFrame, name: str) -> str:
    """name, or name with as many underscores as keep it apart from the columns of ``taken``, in any case of letters."""
    names = {c.lower() for c in taken.columns}
    while name.lower() in names:
        name += "_"
    return name


def keyed(docs: DataFrame) -> DataFrame:
    """docs as did (doc_id as a long), th (hash of the text) and row, a struct of all columns: no name of docs can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("did"), F.xxhash64("text").alias("th"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def forget(df: DataFrame) -> None:
    """Delete what cut() wrote for df, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def publish(spark: SparkSession, made: str, name: str) -> bool:
    """Give the folder ``made`` its final name, by a rename that fails where the name is taken; False if it is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    old, new = jvm.org.apache.hadoop.fs.Path(made), jvm.org.apache.hadoop.fs.Path(name)
    fs, free_ = new.getFileSystem(conf), spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    fs.mkdirs(new.getParent())
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(old, new, free_)
    except Exception:
        if not fs.exists(new):
            raise
        fs.delete(old, True)
        return False
    return True
