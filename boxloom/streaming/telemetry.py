"""Pipeline telemetry: windowed jobs over an event stream, each also usable on a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.scan import running

LATE = "10 minutes"


def timed(events: DataFrame) -> DataFrame:
    """Event time as a timestamp, with a watermark on streams."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", LATE) if events.isStreaming else e


def throughput(events: DataFrame, width: str = "60 seconds", step: str = "10 seconds") -> DataFrame:
    """Completions per sliding window."""
    done = timed(events).where("kind = 'completed'").groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("completed"))
    return done.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "completed")


def status_totals(events: DataFrame, width: str = "1 hour") -> DataFrame:
    e = timed(events).groupBy(F.window("ts", width).alias("w"))
    e = e.agg(F.count_if(F.col("kind") == "completed").alias("completed"), F.count_if(F.col("kind") == "failed").alias("failed"), F.round(F.avg("latency_ms"), 6).alias("mean_latency"))
    return e.select(F.col("w.start").alias("start"), "completed", "failed", "mean_latency")


def recent_errors(events: DataFrame, k: int = 20) -> DataFrame:
    return events.where("kind = 'failed'").orderBy(F.desc("ts"), F.desc("event_id")).limit(k).select("event_id", "job_id", F.substring("props", 1, 200).alias("message"))


def latest_state(events: DataFrame, now: str | None = None) -> DataFrame:
    """Per job the last event's kind; also its progress (four decimals), where events have one, and the seconds
    since the job's first event (two decimals) up to its end, or for open jobs up to ``now``, where that is given."""
    more = ["progress"] if "progress" in events.columns else []
    s = events.groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "kind", *more)).alias("s"), F.min("ts").alias("began"))
    cols = [F.round("s.progress", 4).alias("progress")] * len(more)
    if now is not None:
        until = F.when(F.col("s.kind").isin("completed", "failed"), F.col("s.ts")).otherwise(F.expr(f"to_timestamp_ntz('{now}')"))
        micros = F.timestamp_diff("MICROSECOND", F.col("began"), until)
        cols.append(F.round(micros / 1e6, 2).alias("elapsed"))
    return s.select("job_id", F.col("s.kind").alias("kind"), F.col("s.event_id").alias("event_id"), *cols)


#: Completions of a job that a window holds besides those before them.
STRETCH = 1024


def moving_latency(events: DataFrame, n: int = 50) -> DataFrame:
    """Mean of the last n completions of a job.

    A job's completions are numbered and cut in stretches; each stretch also gets the n - 1 before it.
    """
    done = events.where("kind = 'completed'").select("event_id", "job_id", "ts", "latency_ms")
    done = running(done, ["job_id"], F.date_trunc("day", "ts"), ["ts", "event_id"], {"k": ("count", F.lit(1))})
    stretch = max(STRETCH, n)
    own = F.floor(F.col("k") / stretch)
    both = F.when(F.col("k") % stretch > stretch - n, F.array(own, own + 1)).otherwise(F.array(own))
    w = Window.partitionBy("job_id", "stretch").orderBy("k").rowsBetween(-(n - 1), 0)
    e = done.withColumn("stretch", F.explode(both)).withColumn("mean", F.round(F.avg("latency_ms").over(w), 6))
    return e.where(F.col("stretch") == own).select("event_id", "job_id", "mean")


def pending(events: DataFrame) -> DataFrame:
    """Started less finished, never below zero: x_t = s_t - min(0, min over i <= t of s_i)."""
    step = F.when(F.col("kind") == "started", 1).when(F.col("kind").isin("completed", "failed"), -1).otherwise(0)
    at = [["job_id"], F.date_trunc("day", "ts"), ["ts", "event_id"]]
    e = running(running(events.select("event_id", "job_id", "ts", "kind"), *at, {"s": ("sum", step)}), *at, {"low": ("min", F.col("s"))})
    return e.select("event_id", "job_id", (F.col("s") - F.least(F.lit(0), F.col("low"))).alias("pending"))


def lost_workers(jobs: DataFrame, now: str, max_attempts: int = 3, silence: int = 45, lease: int = 60) -> DataFrame:
    """Jobs in work whose lease has run out and whose last heartbeat, if any, is old: failed when attempts are
    used up, else queued.  A start and each heartbeat grant ``lease`` seconds."""
    beat = F.max(F.when(F.col("kind") == "heartbeat", F.col("ts"))).alias("beat")
    e = jobs.groupBy("job_id").agg(F.count_if(F.col("kind") == "started").alias("attempts"), F.max_by("kind", F.struct("ts", "event_id")).alias("kind"), F.max("ts").alias("seen"), beat)
    since = lambda c: F.timestamp_diff("MICROSECOND", F.col(c), F.expr(f"to_timestamp_ntz('{now}')")) / 1e6
    lost = (since("seen") > lease) & F.coalesce(since("beat") > silence, F.lit(True))
    return e.where(F.col("kind").isin("started", "heartbeat") & lost).select("job_id", "attempts", F.when(F.col("attempts") >= max_attempts, "failed").otherwise("queued").alias("status"))


def lost_spells(events: DataFrame, now: str, max_attempts: int = 3, silence: int = 45, lease: int = 60) -> DataFrame:
    """Each time up to ``now`` that a job in work was lost: job_id, attempts so far, at (a microsecond after its lease and
    silence have passed) and the status it got; jobs that were heard of again may be lost again."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = events.select("job_id", "kind", micros.alias("us"), F.count_if(F.col("kind") == "started").over(past).alias("attempts"), F.max(F.when(F.col("kind") == "heartbeat", micros)).over(past).alias("beat"), F.lead(micros).over(w).alias("next"))
    at = F.greatest(F.col("us") + lease * 1_000_000, F.coalesce(F.col("beat") + silence * 1_000_000, F.lit(0))) + 1
    lost = e.where(F.col("kind").isin("started", "heartbeat")).withColumn("at", at).where((F.col("at") < F.col("next")) | F.col("next").isNull() & (F.col("at") <= F.unix_micros(F.to_timestamp(F.lit(now)))))
    status = F.when(F.col("attempts") >= max_attempts, "failed").otherwise("queued")
    return lost.select("job_id", "attempts", F.timestamp_micros("at").cast("timestamp_ntz").alias("at"), status.alias("status"))


def first_use(events: DataFrame, key: str) -> DataFrame:
    """The first good use of each one-time ticket; on a stream, later ones within the watermark go.

    A use is good before the ticket's ``expires_at`` and in the ticket's project (``project_id`` is
    ``ticket_project``), where events have these columns.
    """
    if "expires_at" in events.columns:
        events = events.where("ts < expires_at")
    if "ticket_project" in events.columns:
        events = events.where(F.col("project_id").eqNullSafe(F.col("ticket_project")))
    if events.isStreaming:
        return timed(events).dropDuplicatesWithinWatermark([key])
    first = F.row_number().over(Window.partitionBy(key).orderBy("ts", "event_id"))
    return events.withColumn("__k", first).where("__k = 1").drop("__k")
