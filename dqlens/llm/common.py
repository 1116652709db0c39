"""What the operators share: reading tables, cutting lineage, words, bounded broadcasts, row numbers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words; a word is a run of anything else.
SPACE = "[\\x20\\x09-\\x0D]"
SPACE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Rows up to which a side with a few narrow columns is broadcast.
BROADCAST_ROWS = 100_000


#: Rows that go to Python at once: long texts make larger batches too large for an executor.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Batches for Python are made smaller for the session, unless it has a size of its own."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":
        spark.conf.set(batch, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Unset, it is an error on a cluster, and a temporary folder in local mode (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(sc, "_dqlens_shared", None)
        if not path:
            local = tempfile.mkdtemp(prefix="dqlens-")
            atexit.register(shutil.rmtree, local, True)
            path = sc._dqlens_shared = f"file://{local}"
    return path


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/dqlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._dqlens_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables made by cut() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_dqlens_path", None):
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def n_words(text: Column) -> Column:
    """Their number, without building them: every run of other characters becomes one."""
    blank = F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS[1:], " " * (len(SPACE_CHARS) - 1))
    return F.size(F.array_remove(F.split(blank, " "), "")).cast("long")


def bounded(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salt: int = 64, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df joined with a table that has one row for each key, nulls of a key being equal.

    The table is counted first. Up to limit rows it is broadcast; beyond, df's keys are
    salted and the table's rows repeated for each salt, so that a hot key is dealt out.
    """
    right = small.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], *[c for c in small.columns if c not in on])
    cond = None
    for i, c in enumerate(on):
        e = F.col(c).eqNullSafe(F.col(f"__k{i}"))
        cond = e if cond is None else cond & e
    keys = [f"__k{i}" for i in range(len(on))]
    if small.count() <= limit:
        return df.join(F.broadcast(right), cond, how).drop(*keys)
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    left = df.withColumn("__s", F.pmod(F.xxhash64(*df.columns), F.lit(salt)).cast("int"))
    return left.join(right, cond & (F.col("__s") == F.col("__salt")), how).drop(*keys, "__s", "__salt")


def numbered(df: DataFrame, keys: list[str], order: list, bucket: Column, name: str, size: Column | None = None, total: str | None = None) -> DataFrame:
    """df with the number of each row inside its key (from 0), in the order of bucket and then of order.

    A bucket should hold a bounded number of rows of a key. Counts of the buckets are summed up in
    a narrow window, and rows are numbered inside their bucket only, so no task gets a whole key.
    With size, total becomes the sum of the sizes of the rows before.
    """
    df = df.withColumn("__b", bucket)
    by = [*keys, "__b"]
    n, s = F.count(F.lit(1)).alias("__n"), F.sum(size if size is not None else F.lit(0)).alias("__z")
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*by).agg(n, s).select(*by, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__z").over(before), F.lit(0)).alias("__z0"))
    right = counts.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(by)], "__n0", "__z0")
    cond = None
    for i, c in enumerate(by):
        e = F.col(c).eqNullSafe(F.col(f"__c{i}"))
        cond = e if cond is None else cond & e
    w = Window.partitionBy(*by).orderBy(*order)
    # sizes of exploded rows are estimated far too low, so a broadcast is ruled out
    out = df.join(right.hint("merge"), cond).withColumn(name, F.col("__n0") + F.row_number().over(w) - 1)
    if size is not None:
        out = out.withColumn(total, F.col("__z0") + F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.drop("__b", "__n0", "__z0", *[f"__c{i}" for i in range(len(by))])
