"""What the corpus operators share: scratch tables, word rules and table access."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: anything between ASCII blanks.
BLANK_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where the session names none: a temporary folder in local mode, else the warehouse,
    which a cluster shares."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/quire-scratch"
    if not named:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, *, name: str = "t") -> DataFrame:
    """Writes df as a table of the shared scratch folder and reads it back: the lineage ends there, lost executors or not."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the folder belongs to the cluster
        pass


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def count_words(c: Column) -> Column:
    """The number of words between ASCII blanks as a long; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(BLANK_WORD)), F.lit(0)).cast("long")
