"""Lost workers, ordered events and key pools: streams against batch forms, batch forms against plain loops."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from boxloom.operators import ledger
from boxloom.sources.views import view
from boxloom.streaming import stateful, telemetry

from .conftest import DATA


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(stateful.STORE[0])
    spark.conf.set(*stateful.STORE)
    yield spark
    spark.conf.set(stateful.STORE[0], before)


def replay(spark, rows, form, name, parts=3):
    """All rows that a stream over ``rows``, in micro-batches by time, gives; a last event moves the watermark on."""
    folder = tempfile.mkdtemp(prefix="spark-stream-")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    lo, hi = rows.agg(F.min("ts"), F.max("ts")).first()
    step = (hi - lo) / parts
    for k in range(parts):
        part = rows.where((F.col("ts") >= F.lit(lo + k * step)) & ((F.col("ts") < F.lit(lo + (k + 1) * step)) | F.lit(k == parts - 1)))
        part.coalesce(1).write.parquet(f"{folder}/in/{k}")
    # files are taken one by one in the order of their age
    s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    q = form(s).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def with_end(rows, days):
    """One more event of a job of its own, so long after the others that their watermark passes everything."""
    last = rows.orderBy(F.desc("ts")).limit(1)
    return rows.unionByName(last.withColumns({"ts": F.col("ts") + F.expr(f"INTERVAL {days} DAYS"), "event_id": F.lit(10**9).cast("long"), "job_id": F.lit(-1).cast("long")}))


def test_lost_workers_on_a_stream(rocks):
    events = view(rocks, DATA, "v_events").where("job_id % 5 = 0")
    got = replay(rocks, with_end(events, 10), lambda s: stateful.lost_workers(s), "lost").where("job_id >= 0")
    end = events.agg(F.max("ts")).first()[0]
    want = telemetry.lost_spells(events, str(end.replace(year=end.year + 1)))
    key = lambda df: sorted((r.job_id, r.attempts, str(r["at"]), r.status) for r in df.collect())
    assert key(got) == key(want) and {r.status for r in want.collect()} == {"failed", "queued"}


def test_lost_spells_end_where_lost_workers_look(spark):
    """A job is lost at a moment if its last spell has begun and nothing came after."""
    events, now = view(spark, DATA, "v_events").where("ts <= TIMESTAMP_NTZ'2024-01-15 00:00:00'"), "2024-01-15 00:00:00"
    last = events.groupBy("job_id").agg(F.max("ts").alias("seen"))
    spells = telemetry.lost_spells(events, now).join(last, "job_id").where("at > seen")
    key = lambda df: sorted((r.job_id, r.attempts, r.status) for r in df.collect())
    assert key(spells) == key(telemetry.lost_workers(events, now))


@pytest.mark.parametrize("gap, lost", [(60_000_000, False), (60_000_001, False), (60_000_002, True)])
def test_lease_boundary(spark, gap, lost):
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("us"))
    events = spark.createDataFrame([(1, 1, 0, "started"), (1, 2, gap, "completed")], "job_id long, event_id long, us long, kind string").select("job_id", "event_id", at.cast("timestamp_ntz").alias("ts"), "kind")
    assert telemetry.lost_spells(events, "2030-01-01 00:00:00").count() == lost


def test_events_in_order_on_a_stream(rocks):
    events = view(rocks, DATA, "v_events").where("job_id % 5 = 1").select("job_id", "event_id", "ts", "kind")
    twice = events.union(events.where("event_id % 3 = 0"))
    got = replay(rocks, with_end(twice, 10), stateful.ordered_events, "in_order").where("job_id >= 0")
    key = lambda df: sorted((r.job_id, r.seq, r.event_id, r.kind) for r in df.collect())
    assert key(got) == key(ledger.ordered_events(events))


def plain_pool(calls, failures=3, cooldown=60.0, limited=120.0):
    """calls: (provider, key, at, seq, outcome, custom)."""
    pools = {}
    for p, k, at, _, outcome, custom in sorted(calls, key=lambda c: (c[2], c[3])):
        n, until, _ = pools.get((p, k), (0, 0.0, 0))
        if until and at >= until:
            n, until = 0, 0.0
        if outcome == "ok":
            n, until = 0, 0.0
        else:
            n += 1
            if outcome == "limited" or n >= failures:
                until = at + (custom or (limited if outcome == "limited" else cooldown))
        pools[p, k] = (n, until, at)
    return {(*k, *v) for k, v in pools.items()}


@pytest.mark.parametrize("failures, parts", [(3, 1), (3, 40), (1, 17), (5, 40)])
def test_key_states_of_hot_keys(spark, failures, parts):
    rnd = random.Random(failures + parts)
    calls, at = [], 0.0
    for seq in range(1200):
        at += rnd.choice([0.0, 1.0, 20.0, 60.0, 61.5])
        key = rnd.choice(["hot"] * 8 + ["a", "b", None])
        calls.append(("p", key, at, seq, rnd.choice(["ok", "failed", "failed", "failed", "limited"]), rnd.choice([None, None, 0.0, 200.0, 1.0])))
    df = spark.createDataFrame(calls, "provider string, key string, at double, seq long, outcome string, custom double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r) for r in ledger.key_states(df, failures=failures).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_pool(calls, failures)


def test_key_states_on_a_stream(rocks):
    outcome = F.element_at(F.array(*map(F.lit, ("ok", "failed", "failed", "failed", "limited"))), (F.col("event_id") * 7 % 5 + 1).cast("int"))
    ts = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("event_id") * 700_000)
    calls = view(rocks, DATA, "v_events").where("job_id < 8").select((F.col("job_id") % 2).alias("provider"), F.col("job_id").alias("key"), ts.alias("ts"), "event_id", outcome.alias("outcome"), F.when(F.col("event_id") % 4 == 0, 5.0).alias("custom"))
    last = calls.orderBy(F.desc("ts")).limit(1).withColumns({"ts": F.col("ts") + F.expr("INTERVAL 1 DAY"), "event_id": F.lit(10**9).cast("long"), "key": F.lit(-1).cast("long")})
    got = {}
    for r in sorted(replay(rocks, calls.unionByName(last), stateful.key_states, "pool").where("key >= 0").collect(), key=lambda r: r.ts):
        got[r.key] = (r.failures, r.cooldown_until)
    rows = [(r.provider, r.key, r.ts.timestamp(), r.event_id, r.outcome, r.custom) for r in calls.collect()]
    # a day later every cooldown has lapsed
    want = {k: (0, None) if until else (n, None) for _, k, n, until, _ in plain_pool(rows)}
    assert want and got == want
    assert any(r.cooldown_until for r in rocks.table("pool").collect())


def test_lost_workers_by_the_clock_on_the_wall(rocks):
    """One batch of events, then silence: the timer alone finds the lost job."""
    folder = tempfile.mkdtemp(prefix="spark-stream-")
    rows = rocks.createDataFrame([(1, 1, "submitted"), (1, 2, "started"), (2, 3, "started"), (2, 4, "completed")], "job_id long, event_id long, kind string").withColumn("ts", F.current_timestamp())
    rows.coalesce(1).write.parquet(f"{folder}/in")
    s = rocks.readStream.schema(rows.schema).parquet(f"{folder}/in")
    q = stateful.lost_workers(s, silence=1, lease=2, clock="wall").writeStream.format("memory").queryName("silent").option("checkpointLocation", f"{folder}/c").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            q.awaitTermination(1)
            if rocks.table("silent").count():
                break
        assert [(r.job_id, r.attempts, r.status) for r in rocks.table("silent").collect()] == [(1, 1, "queued")]
    finally:
        q.stop()
