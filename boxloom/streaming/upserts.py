"""A translation memory as a table that is changed in place, batch by batch.

Under one path, ``data/v7/bucket=3`` holds a bucket of the memory as batch 7 left it, and ``manifest/v7`` says of every bucket
which batch wrote it last.  A batch reads and writes the buckets of its own keys only; then its manifest, which
appears as a whole, makes the new state visible.  A repeated batch starts from the manifest before it and so changes nothing.
Data that neither the newest manifest nor the one before it names are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import memory

#: Buckets of a new memory; a memory keeps the number that it began with.
BUCKETS = 64


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions under a folder that were written to the end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    done = lambda n: files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and done(n))


def _manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """bucket to version; at most as many rows as there are buckets."""
    return {r.bucket: r.version for r in spark.read.parquet(f"{path}/manifest/v{version}").collect()}


def _read(spark: SparkSession, path: str, places: dict[int, int]) -> DataFrame | None:
    if not places:
        return None
    return spark.read.parquet(*[f"{path}/data/v{v}/bucket={b}" for b, v in sorted(places.items())])


def read_memory(spark: SparkSession, path: str) -> DataFrame | None:
    """The memory as the last whole batch left it; none before the first."""
    versions = _versions(spark, f"{path}/manifest")
    return _read(spark, path, {b: v for b, v in _manifest(spark, path, versions[-1]).items() if b >= 0}) if versions else None


def upsert_batch(rows: DataFrame, path: str, version: int, buckets: int = BUCKETS) -> None:
    """Adds a batch of rows (see ``memory.merge``) as version ``version``, which must rise."""
    spark = rows.sparkSession
    earlier = [v for v in _versions(spark, f"{path}/manifest") if v < version]
    places = _manifest(spark, path, earlier[-1]) if earlier else {-1: buckets}
    number = places[-1]  # the number of buckets stands in a row of its own
    bucket = F.pmod(F.xxhash64(*memory.KEY), F.lit(number)).cast("int")
    new = memory.merge(rows)
    touched = [r.bucket for r in new.select(bucket.alias("bucket")).distinct().collect()]
    old = _read(spark, path, {b: places[b] for b in touched if b in places})
    merged = new if old is None else memory.upsert(old, rows)
    merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v{version}")
    after = places | dict.fromkeys(touched, version)
    spark.createDataFrame(list(after.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v{version}")
    # a repeat of this batch still needs the state before it
    named = {(b, v) for places in (after, places) for b, v in places.items() if b >= 0}
    fs = spark._jvm.org.apache.hadoop.fs
    for v in _versions(spark, f"{path}/data"):
        folder = fs.Path(f"{path}/data/v{v}")
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for s in files.listStatus(folder) if v < version else []:
            name = s.getPath().getName()
            if name.startswith("bucket=") and (int(name[7:]), v) not in named:
                files.delete(s.getPath(), True)
    for v in earlier[:-1]:
        folder = fs.Path(f"{path}/manifest/v{v}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def upsert_memory(rows: DataFrame, path: str, buckets: int = BUCKETS):
    """A streaming query that keeps a translation memory under ``path``."""
    return rows.writeStream.foreachBatch(lambda df, version: upsert_batch(df, path, version, buckets))
