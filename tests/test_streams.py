"""Stream jobs give what their batch forms give."""

import tempfile
from pathlib import Path

from boxloom.operators import memory
from boxloom.sources.views import view
from boxloom.streaming import telemetry, upserts

from .conftest import DATA


def stream(spark, df):
    folder = tempfile.mkdtemp(prefix="spark-stream-")
    df.write.parquet(f"{folder}/in")
    return folder, spark.readStream.schema(df.schema).parquet(f"{folder}/in")


def test_throughput(spark):
    events = view(spark, DATA, "v_events")
    folder, s = stream(spark, events)
    telemetry.throughput(s).writeStream.format("memory").queryName("rate").outputMode("complete").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("rate").collect())) == sorted(map(tuple, telemetry.throughput(events).collect()))


def test_memory_snapshots(spark):
    rows = view(spark, DATA, "v_tm")
    folder, s = stream(spark, rows.repartition(3))
    s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = upserts.upsert_memory(s, f"{folder}/memory", 7).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.lastProgress["batchId"] >= 2
    assert entries(upserts.read_memory(spark, f"{folder}/memory")) == entries(memory.merge(rows))


def entries(df):
    return sorted(tuple(r[c] for c in (*memory.KEY, "frequency", "translation", "last_seq")) for r in df.collect())


def test_memory_batches(spark):
    """Repeats change nothing, untouched buckets stay where they are, old versions go."""
    rows, path = view(spark, DATA, "v_tm"), tempfile.mkdtemp(prefix="spark-memory-")
    assert upserts.read_memory(spark, path) is None
    for k in range(4):
        upserts.upsert_batch(rows.where(f"seq % 4 = {k}"), path, k, 5)
        upserts.upsert_batch(rows.where(f"seq % 4 = {k}"), path, k, 5)
        assert entries(upserts.read_memory(spark, path)) == entries(memory.merge(rows.where(f"seq % 4 <= {k}")))
    one = rows.orderBy("seq").limit(1)
    upserts.upsert_batch(one, path, 4)
    manifest = upserts._manifest(spark, path, 4)
    versions = [v for b, v in manifest.items() if b >= 0]
    assert manifest[-1] == 5 and versions.count(4) == 1 and {*versions} <= {0, 1, 2, 3, 4} and len(versions) > 2
    assert entries(upserts.read_memory(spark, path)) == entries(memory.merge(rows.union(one)))
    upserts.upsert_batch(rows.limit(0), path, 5)
    assert entries(upserts.read_memory(spark, path)) == entries(memory.merge(rows.union(one)))
    kept = {p.parent.name + "/" + p.name for p in Path(path).glob("data/v*/bucket=*")}
    assert len(kept) == len(versions) and {p.name for p in Path(path).glob("manifest/*")} == {"v4", "v5"}
