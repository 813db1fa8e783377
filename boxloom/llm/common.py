"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: The six characters that count as white space in every contract here.
SPACE = r"[\x20\x09-\x0D]"


#: Words of a bitmap.
WORDS = 1 << 16


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``.

    Only a local session, as in tests, may go without it and gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: its size is known to whoever joins it."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def marked(rows: DataFrame, hashes: DataFrame, col: str, out: str) -> DataFrame:
    """Adds ``out``: false where the long ``col`` is surely none of those in ``hashes`` (one column).

    The test is a bitmap of ``64 * WORDS`` bits, so what is broadcast has ``WORDS`` rows at most, however many hashes
    there are; with very many of them it only lets more rows through.
    """
    h = F.col(hashes.columns[0])
    word = lambda c: F.pmod(F.shiftright(c, 6), F.lit(WORDS))
    bit = lambda c: c.bitwiseAND(F.lit(63)).cast("int")
    bits = hashes.groupBy(word(h).alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(h))).alias("__bits"))
    got = rows.withColumn("__w", word(F.col(col))).join(F.broadcast(bits), F.col("__w") == F.col("__word"), "left")
    return got.withColumn(out, F.coalesce(F.call_function("getbit", F.col("__bits"), bit(F.col(col))) == 1, F.lit(False))).drop("__w", "__word", "__bits")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def prefix_sums(df: DataFrame, group: list[str], bucket: str, value: str, out: str) -> DataFrame:
    """Exclusive prefix sums over few rows: one for each group and bucket.

    ``df`` must already be aggregated to (group, bucket); the window sees at most as many
    rows of a group as there are buckets, however many rows the group had before.
    """
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def join_nulls(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equality join in which nulls equal nulls; the right side's keys are left out."""
    right = right.withColumnsRenamed({k: f"__right_{k}" for k in on})
    same = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in on]
    return left.join(right, same, how).drop(*[f"__right_{k}" for k in on])
