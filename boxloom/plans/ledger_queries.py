"""Queries on sessions, orders, patches, decisions and key pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ledger, memory
from ..streaming import telemetry
from .registry import query

query("b2_owned_pages", "SELECT page_id, project_id, updated_at FROM v_pages WHERE project_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")(
    lambda t: ledger.owned_pages(t.v_pages, t.customer.select(F.col("c_custkey").alias("project_id"), F.col("c_nationkey").alias("owner_id")), 3).select("page_id", "project_id", "updated_at"))
query("c2_recent_sessions", """WITH s AS (SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)
  SELECT event_id AS session_id, coalesce(c_name, 'Unknown') AS name, CASE WHEN ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-30 22:00:00' THEN 'online' ELSE 'offline' END AS status FROM s LEFT JOIN customer ON c_custkey = user_id AND c_nationkey <> 4""")(
    lambda t: ledger.recent_sessions(
        t.events.select(F.col("event_id").alias("session_id"), "user_id", F.col("ts").alias("created_at"), F.expr("ts + INTERVAL 1 HOUR").alias("expires_at")),
        t.customer.where("c_nationkey <> 4").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name")), "2024-01-30 22:00:00"))
query("f11_revoked_families", "SELECT event_id, job_id AS family, bool_or(kind = 'failed' AND event_id % 9 = 0) OVER (PARTITION BY job_id) AS revoked FROM v_events")(
    lambda t: ledger.revoked_families(t.v_events.select("event_id", F.col("job_id").alias("family"), F.expr("kind = 'failed' AND event_id % 9 = 0").alias("spent"))).select("event_id", "family", "revoked"))
query("f5_explicit_order", "SELECT page_id, block_id, row_number() OVER (PARTITION BY page_id ORDER BY block_id) AS position FROM v_blocks WHERE block_index <> 2")(
    lambda t: ledger.explicit_order(t.v_blocks, t.v_blocks.where("block_index <> 2").repartition("page_id").groupBy("page_id").agg(F.concat(F.array(F.lit("gone")), F.array_sort(F.collect_list("block_id"))).alias("ids"))))
query("b18_patched", "SELECT block_id, CASE WHEN block_index = 1 THEN x + 10 ELSE x END AS x, CASE WHEN block_index = 1 AND page_id % 2 = 0 THEN 'new' ELSE translation END AS translation, width FROM v_blocks")(
    lambda t: ledger.patched(t.v_blocks, t.v_blocks.where("block_index = 1").selectExpr("block_id", "x + 10 AS x", "CASE WHEN page_id % 2 = 0 THEN 'new' END AS translation")).select("block_id", "x", "translation", "width"))
query("c12_curated", "SELECT page_id, count(*) AS boxes FROM v_blocks WHERE page_id % 3 <> block_index % 3 GROUP BY 1")(
    lambda t: ledger.curated(t.v_blocks, t.v_blocks.where("page_id % 3 <> block_index % 3")))
query("h3_steps", """WITH a AS (SELECT page_id, list_filter([CASE WHEN page_id % 2 = 0 THEN 'inpaint' END, CASE WHEN page_id % 3 = 0 THEN 'paint' END, 'ocr'], lambda x: x IS NOT NULL) AS asked FROM v_pages)
  SELECT page_id, array_to_string(list_filter(asked, lambda x: x <> 'paint'), ',') AS steps, CASE WHEN page_id % 3 = 0 THEN 'paint' ELSE '' END AS unknown FROM a""")(
    lambda t: ledger.steps(t.v_pages.withColumn("asked", F.expr("filter(array(CASE WHEN page_id % 2 = 0 THEN 'inpaint' END, CASE WHEN page_id % 3 = 0 THEN 'paint' END, 'ocr'), x -> x IS NOT NULL)")), ("detect", "ocr", "inpaint"))
    .select("page_id", F.array_join("steps", ",").alias("steps"), F.array_join("unknown", ",").alias("unknown")))
query("e14_evidence_counts", r"SELECT count(*) FILTER (turn % 13 <> 0 AND regexp_matches(coalesce(text, ''), '[\p{L}\p{N}]')) AS updated, count(*) FILTER (NOT (turn % 13 <> 0 AND regexp_matches(coalesce(text, ''), '[\p{L}\p{N}]'))) AS review, 0::BIGINT AS pruned FROM conversations")(
    lambda t: ledger.evidence_counts(t.conversations.select(*[c.alias(k) for k, c in tx.evidence(F.col("text"), F.col("turn") % 13 == 0).items()])))

_DECISION = """event_id, ts, CASE event_id % 4 WHEN 0 THEN 'user_preference' WHEN 1 THEN 'system_wrong' WHEN 2 THEN 'other' END AS change_reason, concat('t', CAST(job_id % 3 AS STRING)) AS suggested, concat('t', CAST(event_id % 3 AS STRING)) AS selected, kind AS suggested_lines, CASE WHEN event_id % 2 = 0 THEN props END AS final_lines"""
query("a9_decisions", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'user_preference' WHEN 1 THEN 'system_wrong' ELSE 'suggested' END AS change_reason, CASE WHEN event_id % 2 = 0 THEN props ELSE kind END AS final_lines FROM v_events")(
    lambda t: ledger.decisions(_decided(t)).select("event_id", "change_reason", "final_lines"))
query("a9_decision_lines", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'user_preference' WHEN 1 THEN 'system_wrong' ELSE 'suggested' END AS change_reason, CASE WHEN event_id % 2 = 0 THEN props ELSE kind END AS final_lines FROM v_events WHERE event_id % 10 <> 7")(
    lambda t: ledger.read_decisions(ledger.decision_lines(_decided(t)).select(F.when(F.get_json_object("value", "$.event_id").cast("long") % 10 == 7, F.expr("substring(value, 1, 20)")).otherwise(F.col("value")).alias("value")),
        "event_id long, change_reason string, suggested_lines string, final_lines string").select("event_id", "change_reason", "final_lines"))
query("l8_decision_counts", f"""WITH d AS (SELECT {_DECISION} FROM v_events) SELECT date_trunc('hour', ts)::TIMESTAMP AS start, CASE WHEN change_reason IN ('user_preference', 'system_wrong') THEN change_reason ELSE 'suggested' END AS change_reason, suggested, selected, count(*) AS n FROM d GROUP BY ALL""")(
    lambda t: ledger.decision_counts(_decided(t)).withColumn("start", F.col("start").cast("timestamp_ntz")))
query("l7_ordered_events", "WITH d AS (SELECT DISTINCT event_id, job_id, ts, kind FROM (SELECT * FROM v_events UNION ALL SELECT * FROM v_events WHERE event_id % 4 = 0)) SELECT event_id, job_id, kind, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) - 1 AS seq FROM d")(
    lambda t: ledger.ordered_events(t.v_events.union(t.v_events.where("event_id % 4 = 0"))).select("event_id", "job_id", "kind", "seq"))
query("l4_lost_workers", """WITH j AS (SELECT job_id, count(*) FILTER (kind = 'started') AS attempts, arg_max(kind, (ts, event_id)) AS kind, max(ts) AS seen, max(ts) FILTER (kind = 'heartbeat') AS beat FROM v_events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1)
  SELECT job_id, attempts, CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END AS status FROM j WHERE kind IN ('started', 'heartbeat') AND seen + INTERVAL 60 SECOND < TIMESTAMP '2024-01-15 00:00:00' AND (beat IS NULL OR beat + INTERVAL 45 SECOND < TIMESTAMP '2024-01-15 00:00:00')""")(
    lambda t: telemetry.lost_workers(t.v_events.where("ts <= TIMESTAMP_NTZ'2024-01-15 00:00:00'"), "2024-01-15 00:00:00"))
query("c14_sound_words", """WITH q AS (SELECT DISTINCT substring(p_name, 1, 3) AS query FROM part), d AS (SELECT p_type AS orig, lower(p_brand) AS romaji, p_name AS meaning, p_partkey AS ord FROM part UNION ALL SELECT p_name, p_type, p_type, p_partkey + 1000000000 FROM part)
  SELECT query, arg_min(meaning, ord) AS meaning FROM q JOIN d ON contains(lower(orig), lower(query)) OR lower(romaji) = lower(query) GROUP BY 1""")(
    lambda t: memory.first_meaning(
        t.part.select(F.col("p_type").alias("orig"), F.lower("p_brand").alias("romaji"), F.col("p_name").alias("meaning"), F.col("p_partkey").alias("ord"))
        .union(t.part.select("p_name", "p_type", "p_type", F.col("p_partkey") + 1000000000)),
        t.part.select(F.substring("p_name", 1, 3).alias("query")).distinct()))


def _decided(t):
    d = t.v_events
    reason = F.expr("CASE event_id % 4 WHEN 0 THEN 'user_preference' WHEN 1 THEN 'system_wrong' WHEN 2 THEN 'other' END")
    return d.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), reason.alias("change_reason"), F.expr("concat('t', CAST(job_id % 3 AS STRING))").alias("suggested"),
        F.expr("concat('t', CAST(event_id % 3 AS STRING))").alias("selected"), F.col("kind").alias("suggested_lines"), F.expr("CASE WHEN event_id % 2 = 0 THEN props END").alias("final_lines"),
    )


def _calls(t):
    outcome = F.when(F.col("kind") == "failed", "failed").when((F.col("kind") == "started") & (F.col("latency_ms") > 90), "limited").when(F.col("kind") == "started", "failed").otherwise("ok")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    # the keys' calls lie days apart; a tenth of a millisecond a call brings them close
    return t.v_events.select((F.col("job_id") % 4).alias("provider"), F.col("job_id").alias("key"), (at / 10_000).alias("at"), F.col("event_id").alias("seq"), outcome.alias("outcome"), F.when(F.col("event_id") % 11 == 0, 15.5).alias("custom"))


_WALK = """WITH RECURSIVE c AS (SELECT job_id AS key, epoch_us(ts) / 1e6 / 10000 AS s, CASE WHEN kind = 'failed' THEN 'failed' WHEN kind = 'started' AND latency_ms > 90 THEN 'limited' WHEN kind = 'started' THEN 'failed' ELSE 'ok' END AS outcome,
    CASE WHEN event_id % 11 = 0 THEN 15.5::DOUBLE END AS custom, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY job_id) AS total FROM v_events),
  w AS (SELECT key, s, k, total, CASE WHEN outcome = 'ok' THEN 0 ELSE 1 END AS n, CASE WHEN outcome = 'limited' THEN s + coalesce(custom, 120) ELSE 0::DOUBLE END AS until FROM c WHERE k = 1
    UNION ALL SELECT c.key, c.s, c.k, c.total, CASE WHEN outcome = 'ok' THEN 0 WHEN until > 0 AND c.s >= until THEN 1 ELSE n + 1 END,
      CASE WHEN outcome = 'ok' THEN 0 WHEN outcome = 'limited' THEN c.s + coalesce(custom, 120) WHEN until > 0 AND c.s >= until THEN 0 WHEN n + 1 >= 3 THEN c.s + coalesce(custom, 60) ELSE until END
    FROM w JOIN c ON c.key = w.key AND c.k = w.k + 1)"""
query("l5_key_states", f"{_WALK} SELECT key % 4 AS provider, key, n::BIGINT AS failures, until AS cooldown_until, s AS last_seen FROM w WHERE k = total")(lambda t: ledger.key_states(_calls(t)))
query("e16_pool_health", f"{_WALK} SELECT key % 4 AS provider, count(*) AS total, count(*) FILTER (until <= 170665.7) AS active, count(*) FILTER (until > 170665.7) AS cooling, count(*) FILTER (until <= 170665.7) = count(*) AS all_healthy FROM w WHERE k = total GROUP BY 1")(
    lambda t: ledger.pool_health(ledger.key_states(_calls(t)), 170665.7))
query("l4_lost_spells", """WITH e AS (SELECT job_id, kind, ts, count(*) FILTER (kind = 'started') OVER w AS attempts, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS next FROM v_events WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
  SELECT job_id, attempts, ts + INTERVAL 60 SECOND + INTERVAL 1 MICROSECOND AS at, CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END AS status FROM e WHERE kind IN ('started', 'heartbeat') AND ts + INTERVAL 60 SECOND + INTERVAL 1 MICROSECOND < coalesce(next, TIMESTAMP '2024-01-30 00:00:00.000001')""")(
    lambda t: telemetry.lost_spells(t.v_events, "2024-01-30 00:00:00"))
query("c4_orphan_folders", "SELECT count(DISTINCT storage_key) AS folders, coalesce(sum(byte_size), 0)::BIGINT AS bytes, floor(coalesce(sum(byte_size), 0) / 1048576 * 10 + 0.5::DOUBLE) / 10 AS mb FROM v_assets WHERE split_part(storage_key, '/', 2) NOT IN (SELECT page_id::VARCHAR FROM v_pages WHERE page_id % 4 > 0)")(
    lambda t: ledger.orphan_folders(t.v_assets.select(F.col("storage_key").alias("path"), "byte_size"), t.v_pages.where("page_id % 4 > 0").select(F.col("page_id").alias("project_id"))))
