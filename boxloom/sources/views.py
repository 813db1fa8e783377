"""The supplied tables seen as pages, text boxes, benchmark rows, events and accounts.

Each statement is plain SQL over one table, so that the same text serves Spark and the SQL that
results are checked against.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_BLOCK_ID = "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING))"

#: Thai consonants, vowel signs and tone marks, U+0E2E to U+0E50.
_THAI = "".join(map(chr, range(0x0E2E, 0x0E51)))

VIEWS = {
    "v_blocks": f"""SELECT l_orderkey AS page_id, l_linenumber AS block_index, {_BLOCK_ID} AS block_id,
        CAST((l_partkey * 37 + l_linenumber * 91) % 900 AS DOUBLE) AS x,
        CAST((l_partkey * 11 + l_suppkey * 53 + l_linenumber * 127) % 1300 AS DOUBLE) AS y,
        20 + l_quantity * 4 AS width, CAST(18 + (l_partkey * 7 + l_suppkey) % 110 AS DOUBLE) AS height,
        CAST(20 + (l_partkey * 13 + l_linenumber) % 80 AS DOUBLE) / 100 AS confidence,
        CASE l_returnflag WHEN 'A' THEN 'bubble' WHEN 'N' THEN 'narrative' ELSE 'sfx' END AS balloon_type,
        CASE WHEN l_partkey % 7 = 0 THEN '  ' ELSE concat('src ', CAST(l_partkey AS STRING)) END AS source_text,
        CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE concat('tr ', CAST(l_suppkey AS STRING), repeat(' word', CAST(l_quantity AS INT) % 12)) END AS translation
        FROM lineitem""",
    "v_qa": f"""SELECT l_orderkey AS page_id, l_linenumber AS block_index, {_BLOCK_ID} AS block_id,
        20 + l_quantity * 4 AS width, CAST(18 + (l_partkey * 7 + l_suppkey) % 110 AS DOUBLE) AS height,
        CASE WHEN l_linenumber % 3 = 0 THEN l_quantity * 6 - 8 END AS smart_width, CASE WHEN l_linenumber % 4 = 0 THEN CAST(l_suppkey % 90 AS DOUBLE) END AS smart_height,
        CASE WHEN l_partkey % 4 = 0 THEN CAST(0 AS DOUBLE) WHEN l_partkey % 4 = 1 THEN CAST(8 + l_partkey % 30 AS DOUBLE) END AS font_size,
        CAST(20 + (l_partkey * 13 + l_linenumber) % 80 AS DOUBLE) / 100 AS confidence,
        CASE WHEN l_partkey % 7 = 0 THEN '  ' ELSE concat('src ', CAST(l_partkey AS STRING)) END AS source_text,
        CASE WHEN l_suppkey % 3 = 0 THEN ' ' ELSE concat(CASE WHEN l_partkey % 5 = 0 THEN concat(' ', substring('{_THAI}', CAST(1 + l_partkey % {len(_THAI)} AS INT), 1)) ELSE 'tr ' END,
          CAST(l_suppkey AS STRING), repeat(CASE WHEN l_linenumber % 2 = 0 THEN '\n word' ELSE ' word' END, CAST(l_quantity AS INT) % 12)) END AS translation
        FROM lineitem""",
    "v_paths": """SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 3 = 0 THEN concat('src/', CAST(o_orderkey AS STRING)) END AS source_image_path,
        concat('tmp/', CAST(o_orderkey AS STRING)) AS inpainted_image_path, CASE WHEN o_orderkey % 4 = 0 THEN concat('out/', CAST(o_orderkey AS STRING)) END AS rendered_image_path FROM orders""",
    "v_stored": f"""SELECT {_BLOCK_ID} AS asset_id, l_suppkey AS owner_id, concat(CASE l_linenumber % 3 WHEN 0 THEN 'src/' WHEN 1 THEN 'out/' ELSE 'tmp/' END, CAST(l_orderkey AS STRING)) AS storage_key,
        CAST(l_quantity * 1000 AS BIGINT) AS byte_size, CASE l_returnflag WHEN 'R' THEN 'deleted' WHEN 'A' THEN 'uploading' ELSE 'active' END AS status,
        CAST(l_shipdate AS DATE) AS created_on, CASE WHEN l_suppkey % 5 = 0 THEN CAST(l_shipdate AS DATE) + CAST(l_partkey % 900 AS INT) END AS retained_until FROM lineitem""",
    "v_results": f"""SELECT CASE WHEN l_partkey % 13 = 0 THEN {_BLOCK_ID} END AS asset_id FROM lineitem""",
    "v_attempts": """SELECT o_orderkey AS redemption_id, o_custkey AS user_id, o_orderkey % 50 AS code_id, CAST(o_orderdate AS DATE) AS redeemed_on, o_orderkey % 50 % 9 = 4 AS revoked,
        CASE WHEN o_orderkey % 50 % 4 = 1 THEN CAST('1993-01-01' AS DATE) + CAST(o_orderkey % 50 * 40 AS INT) END AS expires_on, CAST(3 + o_orderkey % 50 * 2 AS INT) AS allowed FROM orders""",
    "v_projects": """SELECT c_custkey AS project_id, CASE c_custkey % 4 WHEN 1 THEN 'bubble' WHEN 2 THEN 'sfx' WHEN 3 THEN 'none' END AS default_template_id,
        CASE WHEN c_custkey % 7 = 0 THEN 'old' ELSE CAST(c_custkey % 5 AS STRING) END AS policy_version FROM customer""",
    "v_templates": """SELECT p_partkey % 40 AS project_id, CASE CAST(floor(p_partkey / 40) AS INT) WHEN 0 THEN 'bubble' WHEN 1 THEN 'sfx' ELSE concat('t', CAST(CAST(floor(p_partkey / 40) AS INT) AS STRING)) END AS template_id,
        CAST(p_partkey % 17 AS INT) AS ord, p_size % 3 <> 0 AS valid, CASE p_size % 4 WHEN 0 THEN 'Kanit, Tahoma,Kanit' WHEN 1 THEN '' WHEN 2 THEN ' Arial ,None' END AS font_stack, concat('F', CAST(p_size % 5 AS STRING)) AS font_family,
        CASE WHEN p_size % 5 <> 0 THEN concat('#', substring(md5(p_name), 1, 6)) END AS color_hex, p_size % 2 = 0 AS bold, CASE WHEN p_size % 3 = 1 THEN true END AS italic, CASE WHEN p_size % 2 = 1 THEN CAST(p_size + 10 AS DOUBLE) END AS font_size,
        CASE WHEN p_size % 4 <> 1 THEN '#00ff00' END AS stroke_color, p_size % 7 <> 0 AS stroke_enabled, CASE WHEN p_size % 6 <> 5 THEN CAST(p_size % 6 AS DOUBLE) END AS stroke_width, p_size % 8 <> 3 AS auto_font_size FROM part""",
    "v_pages": """SELECT o_orderkey AS page_id, o_custkey AS project_id, CAST(1000 + o_orderkey % 3 * 100 AS INT) AS width,
        CAST(1400 + o_orderkey % 5 * 700 AS INT) AS height,
        CASE WHEN o_orderstatus = 'F' THEN concat('clean/', CAST(o_orderkey AS STRING)) END AS inpainted_image_path,
        o_orderdate AS updated_at FROM orders""",
    "v_tm": """SELECT p_partkey AS seq, p_type AS source_text, p_name AS translation,
        CASE WHEN p_size % 2 = 0 THEN 'ja' ELSE 'ko' END AS source_language, 'th' AS target_language FROM part""",
    "v_events": """SELECT event_id, ts, user_id AS job_id, CASE event_type WHEN 'signup' THEN 'submitted' WHEN 'view' THEN 'started'
        WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'heartbeat' END AS kind, value AS latency_ms, props FROM events""",
    "v_bench": """SELECT event_id AS record_id, CASE WHEN event_id % 3 = 0 THEN 'bbox' WHEN event_id % 3 = 1 THEN 'v15' ELSE 'v16' END AS engine,
        event_type AS balloon_type, CASE WHEN user_id % 5 = 0 THEN 'square' ELSE 'round' END AS archetype,
        CASE WHEN user_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split, value > 20 AS success, event_id % 4 <> 0 AS has_gt,
        CASE WHEN value > 20 THEN NULL WHEN event_id % 2 = 0 THEN 'contour_too_small' ELSE NULL END AS fallback_reason,
        value AS elapsed_ms, CAST(event_id * 7919 % 1000 AS DOUBLE) / 1000 AS mask_iou, CAST(event_id * 31 % 1000 AS DOUBLE) / 1000 AS precision,
        CAST(event_id * 577 % 1000 AS DOUBLE) / 1000 AS utilization, CAST(event_id * 113 % 1000 AS DOUBLE) / 1000 AS containment FROM events""",
    "v_redemptions": """SELECT o_orderkey AS redemption_id, o_custkey AS user_id, o_orderkey % 50 AS code_id,
        CAST(o_orderdate AS DATE) AS redeemed_on, CAST(1 + o_orderkey % 90 AS INT) AS duration_days FROM orders""",
    "v_assets": f"""SELECT {_BLOCK_ID} AS asset_id, l_suppkey AS owner_id, concat('clean/', CAST(l_orderkey AS STRING)) AS storage_key,
        CAST(l_quantity * 1000 AS BIGINT) AS byte_size,
        CASE l_returnflag WHEN 'R' THEN 'deleted' WHEN 'A' THEN 'uploading' ELSE 'active' END AS status, l_shipdate AS created_at FROM lineitem""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views, or a supplied table itself."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = re.sub(r"FROM (\w+)$", r"FROM {table}", VIEWS[name])
    table = re.search(r"FROM (\w+)$", VIEWS[name])[1]
    return spark.sql(sql, table=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def with_views(sql: str) -> str:
    """The statement with the views that it names in front, as common table expressions."""
    used = [f"{n} AS ({v})" for n, v in VIEWS.items() if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    body, start = sql.strip(), "WITH "
    if body[:15].upper() == "WITH RECURSIVE ":
        body, start = "WITH " + body[15:], "WITH RECURSIVE "
    return start + ", ".join(used) + (f", {body[5:]}" if body[:5].upper() == "WITH " else f" {body}")
