"""Running totals of hot keys against plain loops."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from boxloom.operators import accounts, ledger
from boxloom.streaming import telemetry


@pytest.fixture(scope="module")
def events(spark):
    rnd, rows = random.Random(5), []
    for n in range(600):
        at = datetime(2024, 1, 1) + timedelta(hours=rnd.randrange(2000))
        rows.append((n, rnd.choice([1] * 6 + [2, None]), at, rnd.choice(["started", "completed", "failed", "heartbeat"]), float(rnd.randrange(1000))))
    return rows, spark.createDataFrame(rows, "event_id long, job_id long, ts timestamp_ntz, kind string, latency_ms double")


def by_job(rows):
    jobs = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        jobs[r[1]].append(r)
    return jobs


def test_pending(events):
    rows, df = events
    want = {}
    for job in by_job(rows).values():
        n = 0
        for r in job:
            n = max(0, n + (r[3] == "started") - (r[3] in ("completed", "failed")))
            want[r[0]] = n
    assert {r.event_id: r.pending for r in telemetry.pending(df).collect()} == want


@pytest.mark.parametrize("n, stretch", [(50, 64), (5, 5), (3, 1024)])
def test_moving_latency(events, monkeypatch, n, stretch):
    monkeypatch.setattr(telemetry, "STRETCH", stretch)
    rows, df = events
    want = {}
    for job in by_job([r for r in rows if r[3] == "completed"]).values():
        for k, r in enumerate(job):
            last = [x[4] for x in job[max(0, k - n + 1) : k + 1]]
            want[r[0]] = sum(last) / len(last)
    assert {r.event_id: r["mean"] for r in telemetry.moving_latency(df, n).collect()} == pytest.approx(want, abs=1e-6)


def test_sequences(events):
    rows, df = events
    want = {r[0]: k for job in by_job(rows).values() for k, r in enumerate(job)}
    assert {r.event_id: r.seq for r in accounts.sequenced(df, "job_id", ["ts", "event_id"], F.date_trunc("day", "ts")).collect()} == want
    assert {r.event_id: r.seq for r in ledger.ordered_events(df.union(df.where("event_id % 3 = 0"))).collect()} == want


def test_stacked_expiry_and_uses(spark):
    rnd = random.Random(6)
    rows = [(k, rnd.choice([1, 1, 1, 2]), date(2024, 1, 1) + timedelta(days=rnd.randrange(900)), rnd.randrange(1, 90)) for k in range(300)]
    df = spark.createDataFrame(rows, "redemption_id long, user_id long, redeemed_on date, duration_days int")
    until, want = {}, {}
    for k, user, day, days in sorted(rows, key=lambda r: (r[2], r[0])):
        until[user] = max(until.get(user, day), day) + timedelta(days=days)
        want[k] = until[user]
    assert {r.redemption_id: r.expires_on for r in accounts.stacked_expiry(df).collect()} == want
    uses = accounts.valid_uses(df.selectExpr("*", "user_id AS code_id", "CAST(NULL AS DATE) AS expires_on", "40 AS allowed", "redemption_id % 5 = 0 AS revoked"))
    good = defaultdict(list)
    for k, user, day, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if k % 5:
            good[user].append(k)
    assert {(r.redemption_id, r.use) for r in uses.collect()} == {(k, n + 1) for ks in good.values() for n, k in enumerate(ks[:40])}
