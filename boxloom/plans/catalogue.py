"""Every registered query over the supplied tables, with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import accounts, audit, benchmark, boxes, corpus, lines, memory, planning
from ..sources.shared import shared_folder
from ..streaming import telemetry, upserts
from . import exchange_queries, greedy_queries, intake_queries, layout_queries, ledger_queries, style_queries  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES, query, split_list  # noqa: F401


def _blank(c: str) -> str:
    return f"trim(coalesce({c}, '')) = ''"


_PLACED = "placed AS (SELECT b.*, p.project_id, p.width AS page_width, p.height AS page_height FROM v_blocks b JOIN v_pages p USING (page_id))"
_IX = "greatest(0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y))"
_PAIRS = f"""pairs AS (SELECT a.page_id, a.block_id AS a_block_id, b.block_id AS b_block_id, {_IX} AS s, greatest(1, a.width * a.height) AS aa, greatest(1, b.width * b.height) AS ba
  FROM v_blocks a JOIN v_blocks b ON a.page_id = b.page_id AND (a.block_index < b.block_index OR a.block_index = b.block_index AND a.block_id < b.block_id))"""

# --- projections and gates

query("b1_scope_filter", "SELECT block_id, b.page_id FROM v_blocks b JOIN v_pages p USING (page_id) WHERE p.project_id % 10 = 3")(
    lambda t: t.v_blocks.join(t.v_pages.where("project_id % 10 = 3").select("page_id"), "page_id", "left_semi").select("block_id", "page_id"))
query("b3_asset_listing", "SELECT asset_id, owner_id, created_at FROM v_assets WHERE status <> 'deleted'")(
    lambda t: t.v_assets.where("status <> 'deleted'").orderBy(F.desc("created_at"), "asset_id").select("asset_id", "owner_id", "created_at"))
query("b4_drop_blank_renumber", f"SELECT page_id, block_id, row_number() OVER (PARTITION BY page_id ORDER BY block_index, block_id) - 1 AS number FROM v_blocks WHERE NOT ({_blank('source_text')} AND {_blank('translation')})")(
    lambda t: planning.kept_and_numbered(t.v_blocks))
query("b5_size_gate", "SELECT block_id, width, height FROM v_blocks WHERE width >= 30 AND height >= 25 AND width * height >= 800")(
    lambda t: boxes.size_gate(t.v_blocks).select("block_id", "width", "height"))
query("b6_expand", f"""WITH {_PLACED}, e AS (SELECT *, CASE WHEN balloon_type = 'bubble' THEN 1.0 ELSE 1.03 END::DOUBLE AS r, CASE WHEN balloon_type = 'bubble' THEN 2 ELSE 10 END AS p FROM placed),
  c AS (SELECT block_id, greatest(0, x + width / 2 - (width * r + p) / 2) AS x1, least(page_width, x + width / 2 + (width * r + p) / 2) AS x2, greatest(0, y + height / 2 - (height * r + p) / 2) AS y1, least(page_height, y + height / 2 + (height * r + p) / 2) AS y2 FROM e)
  SELECT block_id, x1 AS x, y1 AS y, greatest(4, x2 - x1) AS width, greatest(4, y2 - y1) AS height FROM c""")(
    lambda t: boxes.expanded(t.placed).select("block_id", *boxes.BOX))
query("b7_margin", f"""WITH {_PLACED}, c AS (SELECT block_id, greatest(0, x - 10) AS x1, least(page_width, x + width + 10) AS x2, greatest(0, y - 10) AS y1, least(page_height, y + height + 10) AS y2 FROM placed)
  SELECT block_id, x1 AS x, y1 AS y, x2 - x1 AS width, y2 - y1 AS height FROM c""")(
    lambda t: boxes.with_margin(t.placed).select("block_id", *boxes.BOX))
query("b13_page_box_gate", f"WITH {_PLACED} SELECT block_id, CASE WHEN width < 18 OR height < 18 THEN 'too_small' WHEN width > 0.97 * page_width AND height > 0.97 * page_height THEN 'covers_page' END AS reason FROM placed")(
    lambda t: boxes.gate_reason(t.placed).select("block_id", "reason"))
query("b14_clip", f"""WITH {_PLACED}, c AS (SELECT block_id, block_index = 6 AS bad, greatest(0, trunc(x)::INT) AS x, greatest(0, trunc(y)::INT) AS y, trunc(width)::INT AS w, trunc(height)::INT AS h, page_width, page_height FROM placed),
  d AS (SELECT block_id, bad, x, y, least(w, page_width - x) AS width, least(h, page_height - y) AS height FROM c)
  SELECT block_id, CASE WHEN NOT bad THEN x END AS x, CASE WHEN NOT bad THEN y END AS y, CASE WHEN NOT bad THEN width END AS width, CASE WHEN NOT bad THEN height END AS height, CASE WHEN bad THEN 'malformed_bbox' WHEN width <= 0 OR height <= 0 THEN 'zero_area' END AS reason FROM d""")(
    lambda t: boxes.clipped(t.placed.withColumn("height", F.when(F.col("block_index") != 6, F.col("height")))).select("block_id", *boxes.BOX, "reason"))
query("b16_tiers", "SELECT CASE WHEN mask_iou >= 0.85 THEN 'HIGH' WHEN mask_iou >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS tier, count(*) AS n FROM v_bench GROUP BY 1")(
    lambda t: benchmark.tier_counts(t.v_bench))
query("a6_label_lines", f"""WITH {_PLACED}, u AS (SELECT page_id, block_id, least(1, greatest(0, (x + width / 2) / page_width)) AS a, least(1, greatest(0, (y + height / 2) / page_height)) AS b, least(1, greatest(0, width / page_width)) AS c, least(1, greatest(0, height / page_height)) AS d FROM placed)
  SELECT page_id, block_id, printf('0 %.6f %.6f %.6f %.6f', a, b, c, d) AS line FROM u""")(
    lambda t: boxes.label_lines(t.placed))

# --- joins

query("c1_blocks_pages", "SELECT block_id, project_id FROM v_blocks JOIN v_pages USING (page_id)")(lambda t: t.placed.select("block_id", "project_id"))
_GONE = """gone AS (SELECT * FROM v_stored WHERE (status = 'deleted' OR (status = 'uploading' AND created_on < DATE '1996-06-14') OR retained_until < DATE '1996-06-15')
  AND storage_key NOT IN (SELECT source_image_path FROM v_paths WHERE source_image_path IS NOT NULL) AND storage_key NOT IN (SELECT rendered_image_path FROM v_paths WHERE rendered_image_path IS NOT NULL)
  AND asset_id NOT IN (SELECT asset_id FROM v_results WHERE asset_id IS NOT NULL))"""
query("c3_unreferenced_assets", f"WITH {_GONE} SELECT asset_id, byte_size FROM gone")(
    lambda t: accounts.unreferenced(t.v_stored, t.v_paths, t.v_results, "1996-06-15").select("asset_id", "byte_size"))
query("c5_rivals", """SELECT a.page_id, a.block_id, coalesce('[' || string_agg(concat('{"x":', b.x, ',"y":', b.y, ',"width":', b.width, ',"height":', b.height, '}'), ',' ORDER BY b.block_index, b.block_id) FILTER (b.block_id IS NOT NULL) || ']', '[]') AS rivals
  FROM v_blocks a LEFT JOIN v_blocks b ON a.page_id = b.page_id AND a.block_id <> b.block_id AND b.width > 0 AND b.height > 0 GROUP BY 1, 2""")(
    lambda t: boxes.rivals(t.v_blocks).select("page_id", "block_id", F.to_json("rivals").alias("rivals")))
query("c7_pair_iou", f"""WITH {_PAIRS}, ar AS (SELECT page_id, block_id, width * height AS area FROM v_blocks) SELECT p.page_id, a_block_id, b_block_id, s / (x.area + y.area - s + 0.000001::DOUBLE) AS iou
  FROM pairs p JOIN ar x ON x.page_id = p.page_id AND x.block_id = a_block_id JOIN ar y ON y.page_id = p.page_id AND y.block_id = b_block_id WHERE s > 0""")(
    lambda t: boxes.pair_iou(t.v_blocks))
query("c6_shared_regions", f"""WITH {_PAIRS}, fixed AS (SELECT block_id FROM v_blocks WHERE block_index % 5 IN (1, 3)), hit AS (SELECT * FROM pairs WHERE s / least(aa, ba) >= 0.55 AND a_block_id NOT IN (SELECT * FROM fixed) AND b_block_id NOT IN (SELECT * FROM fixed)), ids AS (SELECT a_block_id AS block_id FROM hit UNION SELECT b_block_id FROM hit)
  SELECT v.block_id, i.block_id IS NOT NULL AS shared, CASE WHEN i.block_id IS NULL THEN x ELSE x + width * 0.045::DOUBLE END AS x, CASE WHEN i.block_id IS NULL THEN width ELSE greatest(4, width * 0.91::DOUBLE) END AS width, CASE WHEN i.block_id IS NULL THEN confidence ELSE least(0.72::DOUBLE, confidence) END AS confidence FROM v_blocks v LEFT JOIN ids i USING (block_id)""")(
    lambda t: boxes.shared_regions(t.v_blocks.withColumn("source", F.element_at(F.array(*map(F.lit, ("smart_balloon", "manual", "balloon_interior", "locked_detector_box", "base"))), (F.col("block_index") % 5 + 1).cast("int")))).select("block_id", "shared", "x", "width", "confidence"))
query("c7_pair_overlaps", f"WITH {_PAIRS} SELECT page_id, a_block_id, b_block_id, s / greatest(1, aa + ba - s) AS iou, s / least(aa, ba) AS smaller_overlap FROM pairs WHERE s > 0")(
    lambda t: boxes.pair_overlaps(t.v_blocks))
_TILES = """side AS (SELECT page_id, width, height, least(width, height) AS th, greatest(1, trunc(least(width, height) * 0.8)::INT) AS st FROM v_pages),
  tiles AS (SELECT page_id, width AS tile_width, th AS tile_height, k, CASE WHEN k < n THEN k * st ELSE height - th END AS top FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM (SELECT *, ceil((height - th) / st::DOUBLE)::BIGINT AS n FROM side)))"""
_IN = """held AS (SELECT * FROM v_blocks JOIN tiles USING (page_id) WHERE (y >= top AND y + height <= top + tile_height) OR least(y + height, top + tile_height) - greatest(y, top) >= 0.5 * height)"""
query("d1_tiles", f"WITH {_TILES} SELECT page_id, tile_width, tile_height, k, top FROM tiles")(lambda t: boxes.tiles(t.v_pages))
query("c8_boxes_in_tiles", f"WITH {_TILES}, {_IN} SELECT page_id, k, block_id FROM held")(lambda t: boxes.in_tiles(t.v_blocks, boxes.tiles(t.v_pages)).select("page_id", "k", "block_id"))
query("d2_tile_labels", f"""WITH {_TILES}, {_IN} SELECT page_id, k, block_id, CASE balloon_type WHEN 'bubble' THEN 0 ELSE 1 END AS class, least(1, greatest(0, (x + width / 2) / tile_width)) AS cx,
  least(1, greatest(0, (y - top + height / 2) / tile_height)) AS cy, least(1, greatest(0, width / tile_width)) AS w, least(1, greatest(0, height / tile_height)) AS h FROM held""")(
    lambda t: boxes.tile_labels(t.v_blocks, boxes.tiles(t.v_pages)))
query("d4_empty_tiles", f"WITH {_TILES}, {_IN} SELECT page_id, k FROM tiles t WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.page_id = t.page_id AND h.k = t.k)")(
    lambda t: boxes.empty_tiles(t.v_blocks, boxes.tiles(t.v_pages)).select("page_id", "k"))
_SHADED = "CAST((page_id * 7 + k * 13) % 40 AS DOUBLE) AS deviation, CASE WHEN page_id % 7 = 0 THEN 'val' ELSE 'train' END AS split"
query("d4_background", f"""WITH {_TILES}, {_IN}, e AS (SELECT page_id, k, {_SHADED} FROM tiles t WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.page_id = t.page_id AND h.k = t.k)),
  r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5(concat_ws('-', '42', page_id, k)), page_id, k) AS n FROM e WHERE deviation > 15) SELECT page_id, k, deviation, split FROM r WHERE n <= CASE split WHEN 'val' THEN 65 ELSE 360 END""")(
    lambda t: boxes.background_tiles(boxes.empty_tiles(t.v_blocks, boxes.tiles(t.v_pages)).selectExpr("page_id", "k", *split_list(_SHADED))))
query("d5_page_last_wins", "SELECT page_id, max_by(block_id, block_id) AS block_id FROM v_blocks GROUP BY page_id")(
    lambda t: corpus.last_wins(t.v_blocks.select("page_id", "block_id"), "page_id", "block_id").select("page_id", "block_id"))
query("d6_hash_split", "SELECT page_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'dev' ELSE 'test' END AS split FROM (SELECT page_id, ('0x' || substring(md5(CAST(project_id AS VARCHAR)), 1, 12))::BIGINT / pow(16, 12) AS u FROM v_pages)")(
    lambda t: t.v_pages.select("page_id", corpus.split(F.col("project_id")).alias("split")))
query("d7_exact_share", "SELECT page_id, CASE WHEN row_number() OVER (PARTITION BY project_id ORDER BY md5('42-' || page_id), page_id) <= floor(count(*) OVER (PARTITION BY project_id) * 0.15) THEN 'val' ELSE 'train' END AS split FROM v_pages")(
    lambda t: corpus.exact_share(t.v_pages, "page_id").select("page_id", "split"))
query("d8_capped_round_robin", "SELECT page_id, project_id, round FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY page_id) AS round FROM v_pages) WHERE round <= 3")(
    lambda t: corpus.capped(t.v_pages, "page_id", 3).select("page_id", "project_id", "round"))
query("d11_cleaning_report", f"WITH {_PLACED} SELECT CASE WHEN width < 18 OR height < 18 THEN 'too_small' WHEN width > 0.97 * page_width AND height > 0.97 * page_height THEN 'covers_page' ELSE 'kept' END AS reason, count(*) AS n FROM placed GROUP BY 1")(
    lambda t: boxes.gate_reason(t.placed).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n")))
query("c13_memory_lookup", """WITH m AS (SELECT source_text, source_language, target_language, count(*) AS frequency, max_by(translation, seq) AS translation, max(seq) AS last_seq FROM v_tm GROUP BY ALL),
  q AS (SELECT DISTINCT p_type AS query_id, trim(CASE length(p_type) % 4 WHEN 0 THEN substring(p_type, 3, 7) WHEN 1 THEN p_type WHEN 2 THEN substring(p_type, 4, 2) ELSE substring(p_type, 6, 6) END) AS query, CASE length(p_type) % 3 WHEN 0 THEN 'ko' WHEN 1 THEN 'auto' END AS wanted FROM part),
  h AS (SELECT query_id, m.*, source_text = query AS exact, row_number() OVER (PARTITION BY query_id ORDER BY frequency DESC, last_seq DESC, source_text, source_language, target_language) AS rank FROM q JOIN m ON query <> '' AND contains(lower(source_text), lower(query)) AND (wanted IS NULL OR wanted = 'auto' OR wanted = source_language))
  SELECT query_id, rank, source_text, source_language, target_language, translation, frequency, exact FROM h WHERE rank <= 5""")(
    lambda t: memory.lookup(memory.merge(t.v_tm), t.part.selectExpr("p_type AS query_id", "CASE length(p_type) % 4 WHEN 0 THEN substring(p_type, 3, 7) WHEN 1 THEN p_type WHEN 2 THEN substring(p_type, 4, 2) ELSE substring(p_type, 6, 6) END AS query", "CASE length(p_type) % 3 WHEN 0 THEN 'ko' WHEN 1 THEN 'auto' END AS source_language", "'th' AS target_language").distinct()))
query("c15_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")(
    lambda t: accounts.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"]))
query("c15_orphans", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")(
    lambda t: accounts.orphans(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), t.lineitem, "l_orderkey").select(F.col("l_orderkey").alias("o_orderkey")))
query("c16_uncached_boxes", """WITH k AS (SELECT block_id, md5(concat_ws('_', page_id, x::INT, y::INT, width::INT, height::INT)) AS key, block_index FROM v_blocks)
  SELECT block_id, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE block_index = 1)""")(
    lambda t: (lambda k: k.join(k.where("block_index = 1").select("key").distinct(), "key", "left_anti").select("block_id", "key"))(
        t.v_blocks.select("block_id", "block_index", F.md5(F.concat_ws("_", "page_id", *[F.col(c).cast("int") for c in boxes.BOX])).alias("key"))))
query("c9_exact_text_match", """WITH r AS (SELECT conv_id, turn, regexp_replace(text, '\\s+', '', 'g') AS norm FROM conversations WHERE role = 'user'),
  k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, norm ORDER BY turn) AS k FROM r), d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, norm ORDER BY -turn) AS k2 FROM r)
  SELECT k.conv_id AS project_id, k.turn AS record_id, d.turn AS block_id FROM k JOIN d ON k.conv_id = d.conv_id AND k.norm = d.norm AND k.k = d.k2""")(
    lambda t: (lambda c: lines.match_by_text(c.withColumn("seq", F.col("turn")).withColumn("record_id", F.col("turn")), c.withColumn("seq", -F.col("turn")).withColumn("block_id", F.col("turn"))))(
        t.conversations.where("role = 'user'").select(F.col("conv_id").alias("project_id"), "turn", F.col("text").alias("source_text"))))

# --- benchmark aggregation

_STAT = """count(*) AS n, count(*) FILTER (success AND has_gt) AS n_scored, round(avg(success::INT), 6) AS success_rate, round(avg(mask_iou) FILTER (success AND has_gt), 6) AS mean_iou,
  round(avg("precision") FILTER (success AND has_gt), 6) AS mean_precision, round(avg(utilization) FILTER (success AND has_gt), 6) AS mean_utilization, round(avg(containment) FILTER (success AND has_gt), 6) AS mean_containment,
  round(median(mask_iou) FILTER (success AND has_gt), 6) AS median_iou, round(quantile_cont(elapsed_ms, 0.5), 6) AS p50, round(quantile_cont(elapsed_ms, 0.95), 6) AS p95"""
query("e1_e2_rollup", f"""WITH s AS (SELECT 'overall' AS scope, NULL AS eng, NULL AS value, * FROM v_bench UNION ALL SELECT 'engine', engine, NULL, * FROM v_bench UNION ALL SELECT 'type', engine, balloon_type, * FROM v_bench
  UNION ALL SELECT 'split', engine, split, * FROM v_bench UNION ALL SELECT 'archetype', engine, archetype, * FROM v_bench WHERE success) SELECT scope, eng AS engine, value, {_STAT} FROM s GROUP BY 1, 2, 3""")(
    lambda t: benchmark.rollup(t.v_bench))
query("e3_failure_reasons", "SELECT engine, coalesce(fallback_reason, 'unknown') AS reason, count(*) AS n FROM v_bench WHERE NOT success GROUP BY 1, 2")(lambda t: benchmark.failure_reasons(t.v_bench))
query("e3_top_reason", "WITH f AS (SELECT engine, coalesce(fallback_reason, 'unknown') AS reason, count(*) AS n FROM v_bench WHERE NOT success GROUP BY 1, 2) SELECT engine, reason, n FROM f QUALIFY row_number() OVER (PARTITION BY engine ORDER BY n DESC, reason DESC) = 1")(
    lambda t: benchmark.top_reason(t.v_bench))
query("e4_pivot", "SELECT balloon_type, " + ", ".join(f"round(avg(mask_iou) FILTER (success AND has_gt AND engine = '{e}'), 6) AS {e}" for e in ("bbox", "v15", "v16")) + " FROM v_bench GROUP BY 1")(
    lambda t: benchmark.pivoted(t.v_bench, "balloon_type", ["bbox", "v15", "v16"]))
query("e5_run_counts", "SELECT count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) FILTER (success AND has_gt) AS scored FROM v_bench")(lambda t: benchmark.counts(t.v_bench))
query("e6_sweep", "SELECT split, round(avg(elapsed_ms), 6) AS mean_all, round(avg(elapsed_ms) FILTER (mask_iou >= 0.85), 6) AS mean_high FROM v_bench GROUP BY 1")(lambda t: benchmark.sweep(t.v_bench, "split"))
query("e17_type_counts", "SELECT split, balloon_type, count(*) AS n FROM v_bench GROUP BY 1, 2")(lambda t: t.v_bench.groupBy("split", "balloon_type").agg(F.count("*").alias("n")))
query("f13_worst", "SELECT record_id, engine, mask_iou FROM v_bench WHERE success AND has_gt ORDER BY mask_iou, record_id, engine LIMIT 10")(lambda t: benchmark.worst(t.v_bench))

# --- audit

_ISSUES = """s AS (SELECT *, trim(source_text) = '' AS ns, ltrim(translation, ' ' || chr(10)) AS tr, CASE WHEN smart_width > 10 THEN smart_width ELSE width END AS w, CASE WHEN smart_height > 10 THEN smart_height ELSE height END AS h,
    CASE WHEN coalesce(font_size, 0) = 0 THEN 24 ELSE font_size END AS size, list_filter(list_transform(string_split(translation, chr(10)), lambda x: length(trim(x))), lambda n: n > 0) AS ls FROM v_qa),
  b AS (SELECT *, tr = '' AS nt, CASE WHEN len(ls) > 0 AND w > 0 AND h > 0 THEN greatest((list_max(ls) * (size * 0.55::DOUBLE) - w) / w, (len(ls) * (size * 1.25::DOUBLE) - h) / h) END AS over FROM s),
  issues AS (SELECT page_id, block_id, 'UNTRANSLATED_BUBBLE' AS code, 'warning' AS severity, '' AS detail FROM b WHERE NOT ns AND nt
  UNION ALL SELECT page_id, block_id, 'EMPTY_BLOCK', 'info', '' FROM b WHERE ns AND nt
  UNION ALL SELECT page_id, block_id, 'LOW_OCR_CONFIDENCE', 'info', CAST(trunc(confidence * 100)::INT AS VARCHAR) FROM b WHERE NOT ns AND confidence > 0 AND confidence < 0.45
  UNION ALL SELECT page_id, block_id, 'TEXT_OVERFLOW', 'warning', CAST(trunc(over * 100)::INT AS VARCHAR) FROM b WHERE over > 0.15
  UNION ALL SELECT page_id, block_id, 'THAI_FLOATING_DIACRITIC', 'warning', '' FROM b WHERE unicode(tr) IN (3633, 3636, 3637, 3638, 3639, 3640, 3641, 3642, 3655, 3656, 3657, 3658, 3659, 3660, 3661, 3662)
  UNION ALL SELECT page_id, NULL, 'MISSING_INPAINT_IMAGE', 'warning', '' FROM v_pages WHERE inpainted_image_path IS NULL AND page_id IN (SELECT page_id FROM b WHERE NOT nt))"""
_PAGE = f"""{_ISSUES}, n AS (SELECT page_id, count(*) AS blocks FROM v_qa GROUP BY 1), i AS (SELECT page_id, count(*) AS issues, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM issues GROUP BY 1),
  r AS (SELECT page_id, project_id, coalesce(blocks, 0) AS blocks, coalesce(issues, 0) AS issues, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(infos, 0) AS infos, coalesce(issues, 0) = 0 AS is_clean FROM v_pages LEFT JOIN n USING (page_id) LEFT JOIN i USING (page_id))"""
query("i1_i6_issues", f"WITH {_ISSUES} SELECT page_id, block_id, code, severity, detail FROM issues")(lambda t: audit.issues(t.v_qa, t.v_pages))
query("e7_page_audit", f"WITH {_PAGE} SELECT * FROM r")(lambda t: audit.page_rollup(t.v_qa, t.v_pages))
query("e8_project_audit", f"""WITH {_PAGE} SELECT project_id, count(*) AS pages, sum(blocks)::BIGINT AS blocks, sum(issues)::BIGINT AS issues, sum(errors)::BIGINT AS errors, sum(warnings)::BIGINT AS warnings, sum(infos)::BIGINT AS infos,
  count(*) FILTER (is_clean) AS clean_pages, count(*) FILTER (NOT is_clean) AS pages_with_issues FROM r GROUP BY 1""")(lambda t: audit.project_rollup(t.v_qa, t.v_pages))

# --- memory and accounts

_MERGED = "m AS (SELECT source_text, source_language, target_language, count(*) AS frequency, max_by(translation, seq) AS translation, max(seq) AS last_seq FROM v_tm GROUP BY ALL)"
query("e9_memory_merge", f"WITH {_MERGED} SELECT * FROM m")(lambda t: memory.merge(t.v_tm))
query("e9_memory_upsert", f"WITH {_MERGED} SELECT * FROM m")(lambda t: memory.upsert(memory.merge(t.v_tm.where("seq % 2 = 0")), t.v_tm.where("seq % 2 = 1")))
query("l9_memory_batches", f"WITH {_MERGED} SELECT * FROM m")(lambda t: _in_batches(t.v_tm))
query("e9_memory_project", """SELECT source_text, source_language, target_language, count(*) AS frequency, arg_max(translation, seq) AS translation, max(seq) AS last_seq, arg_max(p, seq) FILTER (p IS NOT NULL) AS project_id
  FROM (SELECT *, CASE WHEN seq % 3 = 1 THEN seq % 50 END AS p FROM v_tm) GROUP BY 1, 2, 3""")(
    lambda t: (lambda r: memory.upsert(memory.merge(r.where("seq <= 90")), r.where("seq > 90")))(t.v_tm.withColumn("project_id", F.when(F.col("seq") % 3 == 1, F.col("seq") % 50))))
query("e10_memory_export", f"WITH {_MERGED} SELECT * FROM m WHERE source_language = 'ja'")(lambda t: memory.export(memory.merge(t.v_tm), "ja"))
query("e11_storage", """WITH u AS (SELECT owner_id, coalesce(sum(byte_size) FILTER (status <> 'deleted'), 0)::BIGINT AS used, coalesce(sum(byte_size) FILTER (status = 'uploading'), 0)::BIGINT AS more FROM v_assets GROUP BY 1)
  SELECT owner_id, used, more, used + more > 2000000 AS over_quota FROM u""")(
    lambda t: accounts.storage(t.v_assets, t.v_assets.where("status = 'uploading'"), 2_000_000))
query("e12_active_jobs", "SELECT job_id, count(*) AS active, count(*) >= 2 AS over_quota FROM v_events WHERE kind IN ('submitted', 'started') GROUP BY 1")(
    lambda t: t.v_events.where("kind IN ('submitted', 'started')").groupBy("job_id").agg(F.count("*").alias("active")).withColumn("over_quota", F.col("active") >= 2))
query("e13_counters", """SELECT (SELECT count(DISTINCT user_id) FROM v_redemptions) AS users, (SELECT count(*) FROM v_events WHERE kind = 'submitted' AND ts + INTERVAL 240 HOUR > TIMESTAMP '2024-01-20 00:00:00') AS sessions, (SELECT count(DISTINCT code_id) FROM v_redemptions) AS codes""")(
    lambda t: accounts.counters(t.v_redemptions.select("user_id"), t.v_events.where("kind = 'submitted'").select(F.expr("ts + INTERVAL 240 HOUR").alias("expires_at")), t.v_redemptions.select("code_id"), "2024-01-20 00:00:00"))
query("e15_purge_totals", f"WITH {_GONE} SELECT count(*) AS purged, coalesce(sum(byte_size), 0)::BIGINT AS bytes FROM gone")(
    lambda t: accounts.purge_totals(t.v_stored, t.v_paths, t.v_results, "1996-06-15"))
query("e18_reorder_summary", "SELECT count(DISTINCT page_id) AS pages, count(*) AS blocks FROM v_blocks")(lambda t: t.v_blocks.agg(F.countDistinct("page_id").alias("pages"), F.count("*").alias("blocks")))
query("f10_valid_uses", "SELECT redemption_id, code_id, use FROM (SELECT *, row_number() OVER (PARTITION BY code_id ORDER BY redeemed_on, redemption_id) AS use FROM v_attempts WHERE NOT revoked AND (expires_on IS NULL OR expires_on > redeemed_on)) WHERE use <= allowed")(
    lambda t: accounts.valid_uses(t.v_attempts).select("redemption_id", "code_id", "use"))
query("f9_stacked_expiry", """WITH s AS (SELECT *, sum(duration_days) OVER (PARTITION BY user_id ORDER BY redeemed_on, redemption_id ROWS UNBOUNDED PRECEDING) AS s, redeemed_on - DATE '1970-01-01' AS d FROM v_redemptions)
  SELECT redemption_id, user_id, DATE '1970-01-01' + CAST(s + max(d - (s - duration_days)) OVER (PARTITION BY user_id ORDER BY redeemed_on, redemption_id ROWS UNBOUNDED PRECEDING) AS INT) AS expires_on FROM s""")(
    lambda t: accounts.stacked_expiry(t.v_redemptions))
query("f12_top_orders", "SELECT page_id, project_id, updated_at FROM v_pages ORDER BY updated_at DESC, page_id DESC LIMIT 100")(
    lambda t: t.v_pages.orderBy(F.desc("updated_at"), F.desc("page_id")).limit(100).select("page_id", "project_id", "updated_at"))

# --- windows and order

_C = "x + width / 2 AS cx, y + height / 2 AS cy"
query("f1_reading_order", """WITH m AS (SELECT *, greatest(30, 0.8::DOUBLE * coalesce(avg(height) FILTER (height > 0) OVER (PARTITION BY page_id), 50)) AS band FROM v_blocks)
  SELECT block_id, row_number() OVER (PARTITION BY page_id ORDER BY floor(y / band), -(x + width / 2), block_index, block_id) AS "order" FROM m""")(
    lambda t: boxes.reading_order(t.v_blocks).select("block_id", "order"))
query("f2_scroll_order", 'SELECT block_id, row_number() OVER (PARTITION BY page_id ORDER BY y, x, block_index, block_id) - 1 AS "order" FROM v_blocks')(
    lambda t: boxes.scroll_order(t.v_blocks).select("block_id", "order"))
query("f4_flow_lines", f"""WITH o AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY y, x, block_index, block_id) - 1 AS from_order, {_C} FROM v_blocks),
  l AS (SELECT *, lead(cx) OVER w AS nx, lead(cy) OVER w AS ny FROM o WINDOW w AS (PARTITION BY page_id ORDER BY from_order))
  SELECT page_id, from_order, round(cx, 1) AS x1, round(cy, 1) AS y1, round(nx, 1) AS x2, round(ny, 1) AS y2 FROM l WHERE nx IS NOT NULL""")(
    lambda t: boxes.flow_lines(boxes.scroll_order(t.v_blocks)))
query("f6_bubble_numbers", "SELECT block_id, row_number() OVER (PARTITION BY project_id ORDER BY page_id, block_index, block_id) AS bubble FROM v_blocks JOIN v_pages USING (page_id)")(
    lambda t: accounts.sequenced(t.placed, "project_id", ["page_id", "block_index", "block_id"], F.col("page_id")).select("block_id", (F.col("seq") + 1).alias("bubble")))
query("f7_event_sequence", "SELECT event_id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) - 1 AS seq FROM v_events")(
    lambda t: accounts.sequenced(t.v_events, "job_id", ["ts", "event_id"], F.date_trunc("day", "ts")).select("event_id", "job_id", "seq"))
query("f8_first_per_key", "SELECT event_id, job_id, kind FROM v_events QUALIFY row_number() OVER (PARTITION BY job_id, kind ORDER BY ts, event_id) = 1")(
    lambda t: accounts.first_per_key(t.v_events, ["job_id", "kind"], ["ts", "event_id"]).select("event_id", "job_id", "kind"))
query("f15_moving_latency", "SELECT event_id, job_id, round(avg(latency_ms) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS 49 PRECEDING), 6) AS mean FROM v_events WHERE kind = 'completed'")(
    lambda t: telemetry.moving_latency(t.v_events))
query("f16_pending", """WITH s AS (SELECT *, sum(CASE WHEN kind = 'started' THEN 1 WHEN kind IN ('completed', 'failed') THEN -1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM v_events)
  SELECT event_id, job_id, (s - least(0, min(s) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)))::BIGINT AS pending FROM s""")(lambda t: telemetry.pending(t.v_events))

# --- grouped maps per page: no SQL form


# --- sets

query("h1_changed_keys", "SELECT DISTINCT page_id AS id FROM (SELECT page_id FROM v_blocks UNION ALL SELECT page_id FROM v_pages)")(
    lambda t: t.v_blocks.select(F.col("page_id").alias("id")).union(t.v_pages.select("page_id")).distinct())
query("h2_missing_pages", "SELECT page_id FROM v_pages EXCEPT SELECT page_id FROM v_blocks")(lambda t: t.v_pages.select("page_id").join(t.v_blocks.select("page_id").distinct(), "page_id", "left_anti"))

# --- text

_LINES = r"""ln AS (SELECT doc_id AS file_id, unnest(range(0, len(s))) AS line_no, unnest(s) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n|\r', chr(10), 'g'), chr(10)) AS s FROM documents))"""
query("a10_lines", f"WITH {_LINES} SELECT file_id, line_no, line FROM ln")(lambda t: lines.lines_of(t.documents, "doc_id", "text"))
query("a10_format", rf"""WITH {_LINES} SELECT file_id, CASE WHEN bool_or(regexp_matches(line, '^# (ID:|Bubble [0-9]+)')) THEN 'labelled' WHEN bool_or(starts_with(line, '//')) THEN 'slash' WHEN bool_or(contains(line, chr(9))) THEN 'tsv' ELSE 'alternating' END AS format, count(*) AS lines FROM ln GROUP BY 1""")(
    lambda t: lines.file_format(lines.lines_of(t.documents, "doc_id", "text")))
# a file's lines: about every fourth file has paragraphs of one line, and some files hold marks
_MARKED = r"""mk AS (SELECT file_id, line_no, CASE WHEN file_id % 4 = 0 AND line_no % 2 = 1 THEN ' ' WHEN (file_id + line_no) % 9 = 4 THEN '[[SMART_BALLOON_SPATIAL shape=ellipse aspect=1.5 w=30 h=20 target_lines=2 max_lines=4]]'
  WHEN file_id % 3 = 1 THEN concat(CASE WHEN (file_id + line_no) % 7 = 6 THEN '' ELSE '// ' END, CASE WHEN line_no % 2 = 1 THEN 'ก ' ELSE '' END, line) ELSE line END AS line FROM ln)"""
_PARAS = rf"""{_LINES}, {_MARKED}, bl AS (SELECT *, regexp_matches(line, '^[\s\p{{Z}}]*$') AS blank FROM mk), st AS (SELECT *, NOT blank AND coalesce(lag(blank) OVER (PARTITION BY file_id ORDER BY line_no), true) AS starts FROM bl),
  pa AS (SELECT file_id, line_no, regexp_replace(line, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS line, sum(starts::INT) OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS para, blank FROM st),
  pl AS (SELECT *, row_number() OVER (PARTITION BY file_id, para ORDER BY line_no) - 1 AS place, count(*) OVER (PARTITION BY file_id, para) AS n, starts_with(line, '[[SMART_BALLOON_SPATIAL shape=') AS hint FROM pa WHERE NOT blank)"""


def _marked(t):
    return lines.lines_of(t.documents, "doc_id", "text").selectExpr("file_id", "line_no", _MARKED[_MARKED.index("CASE") : _MARKED.index(" AS line FROM ln")] + " AS line")


query("k3_alternating", rf"""WITH {_PARAS}, si AS (SELECT *, max(place) OVER (PARTITION BY file_id) = 0 AS single FROM pl),
  re AS (SELECT *, CASE WHEN single THEN para // 2 ELSE para END AS record, CASE WHEN single THEN para % 2 ELSE place END AS spot FROM si)
  SELECT file_id, min(line_no) AS line_no, max(line) FILTER (spot = 0) AS source, max(line) FILTER (spot = 1 AND hint) AS layout, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (spot > 0 AND NOT (spot = 1 AND hint)), '') AS translation, count(*) = 1 AS error FROM re GROUP BY file_id, record""")(
    lambda t: lines.alternating(_marked(t)))
query("k4_slash", rf"""WITH {_PARAS}, cl AS (SELECT *, starts_with(line, '//') AS slash, CASE WHEN starts_with(line, '//') THEN regexp_replace(substring(line, 3), '^[\s\p{{Z}}]+', '') ELSE line END AS clean FROM pl),
  th AS (SELECT *, regexp_matches(clean, '[\x{{0E00}}-\x{{0E7F}}]') AS thai, bool_or(place = 1 AND hint) OVER (PARTITION BY file_id, para) AS middle FROM cl),
  fo AS (SELECT *, CASE WHEN n = 2 OR (n = 3 AND middle) THEN 'pair' WHEN n > 2 AND n % 2 = 0 AND bool_and(slash AND thai = (place % 2 = 1)) OVER (PARTITION BY file_id, para) THEN 'turns' ELSE 'run' END AS form FROM th),
  -- for each line the last line before it, in its paragraph, that is no layout line
  la AS (SELECT f.*, (SELECT max_by(g.slash AND NOT g.thai, g.line_no) FROM fo g WHERE g.file_id = f.file_id AND g.para = f.para AND g.line_no < f.line_no AND NOT g.hint) AS foreign_before FROM fo f),
  op AS (SELECT *, CASE form WHEN 'pair' THEN place = 0 WHEN 'turns' THEN place % 2 = 0 ELSE slash AND NOT hint AND NOT (coalesce(foreign_before, false) AND thai) END AS opens FROM la),
  rc AS (SELECT *, sum(opens::INT) OVER (PARTITION BY file_id, para ORDER BY line_no) AS record, min(line_no) OVER (PARTITION BY file_id, para) AS first FROM op),
  gr AS (SELECT file_id, record, CASE WHEN record = 0 THEN min(first) ELSE min(line_no) FILTER (opens) END AS line_no, max(clean) FILTER (opens) AS source,
    arg_max(line, line_no) FILTER (hint AND NOT opens AND (form = 'run' OR (form = 'pair' AND n = 3))) AS layout,
    string_agg(clean, chr(10) ORDER BY line_no) FILTER (NOT opens AND NOT (hint AND (form = 'run' OR (form = 'pair' AND n = 3)))) AS translation FROM rc GROUP BY file_id, para, record)
  SELECT file_id, line_no, row_number() OVER (PARTITION BY file_id ORDER BY line_no, record) AS bubble, source, layout, coalesce(translation, '') AS translation FROM gr WHERE record > 0 OR translation IS NOT NULL""")(
    lambda t: lines.slashed(_marked(t)))
query("j3_evidence", r"""SELECT conv_id, turn, CASE WHEN turn % 13 = 0 THEN 'needs_review' WHEN NOT regexp_matches(coalesce(text, ''), '[\p{L}\p{N}]') THEN 'reject' ELSE 'confirmed' END AS status,
  CASE WHEN turn % 13 = 0 THEN 'ocr_failed' WHEN regexp_matches(coalesce(text, ''), '^[\s\p{Z}]*$') THEN 'empty_ocr' WHEN NOT regexp_matches(coalesce(text, ''), '[\p{L}\p{N}]') THEN 'punctuation_only' ELSE 'valid_text' END AS reason FROM conversations""")(
    lambda t: t.conversations.select("conv_id", "turn", *[c.alias(k) for k, c in tx.evidence(F.col("text"), F.col("turn") % 13 == 0).items()]))
query("j5_script", rf"SELECT doc_id, CASE WHEN regexp_matches(text, '{tx.THAI}') THEN 'th' WHEN regexp_matches(text, '{tx.KANA_HAN}') THEN 'ja' WHEN regexp_matches(text, '{tx.HANGUL}') THEN 'ko' ELSE 'en' END AS script FROM documents")(
    lambda t: t.documents.select("doc_id", tx.script(F.col("text")).alias("script")))
query("j6_normal_lines", r"""SELECT item_id, regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\s\p{Z}]+', ' ', 'g'))), chr(10)), '^\n+|\n+$', '', 'g') AS text FROM benchmark""")(
    lambda t: t.benchmark.select("item_id", tx.normal_lines(F.col("text")).alias("text")))
query("j8_strip_tags", r"""SELECT seq, regexp_replace(regexp_replace(s, '(\s*\{[^{}]+\}\s*)+$', ''), '\s+$', '') AS text FROM (SELECT seq, translation || CASE WHEN seq % 3 = 0 THEN ' {shout} {soft}' WHEN seq % 3 = 1 THEN '{x' ELSE ' {a}' END AS s FROM v_tm)""")(
    lambda t: t.v_tm.select("seq", tx.without_tags(F.concat("translation", F.when(F.col("seq") % 3 == 0, " {shout} {soft}").when(F.col("seq") % 3 == 1, "{x").otherwise(" {a}"))).alias("text")))
_SIGNALS = {"exclaims": "[!！]", "asks": "[?？]", "katakana": r"[\u30A0-\u30FF]", "capital_runs": "[A-Z]{2,}", "thai": r"[\u0E00-\u0E7F]"}
query("j10_signals", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{v}')) AS {k}" for k, v in {"exclaims": "!|！", "asks": r"\?|？", "katakana": r"[\x{30A0}-\x{30FF}]", "capital_runs": "[A-Z][A-Z]+", "thai": r"[\x{0E00}-\x{0E7F}]"}.items()) + r", length(s) AS length, length(s) <= 6 AS short, length(s) <= 3 AS very_short FROM (SELECT *, regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS s FROM documents)")(
    lambda t: t.documents.select("doc_id", *[F.regexp_count("text", F.lit(v)).alias(k) for k, v in _SIGNALS.items()], F.length(tx.strip(F.col("text"))).alias("length"), (F.length(tx.strip(F.col("text"))) <= 6).alias("short"), (F.length(tx.strip(F.col("text"))) <= 3).alias("very_short")))
query("j11_luminance", """WITH h AS (SELECT p_partkey, substring(md5(p_name), 1, 6) AS h FROM part), c AS (SELECT p_partkey, ('0x' || substring(h, 1, 2))::INT / 255 AS r, ('0x' || substring(h, 3, 2))::INT / 255 AS g, ('0x' || substring(h, 5, 2))::INT / 255 AS b FROM h)
  SELECT p_partkey, round(r * 0.2126 + g * 0.7152 + b * 0.0722, 6) AS luminance, round(CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE 1 - least(r, g, b) / greatest(r, g, b) END, 6) AS saturation FROM c""")(
    lambda t: (lambda h: t.part.select("p_partkey", F.round(tx.luminance(h), 6).alias("luminance"), F.round(tx.saturation(h), 6).alias("saturation")))(F.concat(F.lit("#"), F.substring(F.md5("p_name"), 1, 6))))
query("j21_target_check", rf"SELECT seq, regexp_matches(translation, '{tx.THAI}') AS is_thai FROM v_tm")(lambda t: t.v_tm.select("seq", F.regexp_like("translation", F.lit(tx.THAI)).alias("is_thai")))

# --- streaming operators, over the stored events

query("l1_throughput", """WITH w AS (SELECT unnest(range(0, 6)) AS k, ts FROM v_events WHERE kind = 'completed'), s AS (SELECT time_bucket(INTERVAL 10 SECOND, ts) - k * INTERVAL 10 SECOND AS start FROM w)
  SELECT start::TIMESTAMP AS start, start::TIMESTAMP + INTERVAL 60 SECOND AS "end", count(*) AS completed FROM s GROUP BY 1, 2""")(
    lambda t: telemetry.throughput(t.v_events).select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "completed"))
query("l2_status_totals", """SELECT date_trunc('hour', ts)::TIMESTAMP AS start, count(*) FILTER (kind = 'completed') AS completed, count(*) FILTER (kind = 'failed') AS failed, round(avg(latency_ms), 6) AS mean_latency FROM v_events GROUP BY 1""")(
    lambda t: telemetry.status_totals(t.v_events).withColumn("start", F.col("start").cast("timestamp_ntz")))
query("l3_recent_errors", "SELECT event_id, job_id, substring(props, 1, 200) AS message FROM v_events WHERE kind = 'failed' ORDER BY ts DESC, event_id DESC LIMIT 20")(lambda t: telemetry.recent_errors(t.v_events))
query("l6_latest_state", """WITH s AS (SELECT job_id, arg_max(kind, (ts, event_id)) AS kind, arg_max(event_id, (ts, event_id)) AS event_id, min(ts) AS began, max(ts) AS seen FROM v_events GROUP BY 1)
  SELECT job_id, kind, event_id, round(CAST(event_id % 997 AS DOUBLE) / 997, 4) AS progress, round((epoch_us(CASE WHEN kind IN ('completed', 'failed') THEN seen ELSE TIMESTAMP '2024-02-01 00:00:00' END) - epoch_us(began)) / 1000000.0::DOUBLE, 2) AS elapsed FROM s""")(
    lambda t: telemetry.latest_state(t.v_events.withColumn("progress", F.expr("CAST(event_id % 997 AS DOUBLE) / 997")), "2024-02-01 00:00:00"))
_TICKETS = "SELECT *, event_id % 3 AS project_id, job_id % 3 AS ticket_project"
query("l10_first_use", f"WITH e AS ({_TICKETS}, TIMESTAMP '2024-01-05 00:00:00' + INTERVAL 1 DAY * (job_id % 25)::INT AS expires_at FROM v_events) SELECT event_id, job_id FROM e WHERE ts < expires_at AND project_id = ticket_project QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) = 1")(
    lambda t: telemetry.first_use(t.v_events.selectExpr("*", "event_id % 3 AS project_id", "job_id % 3 AS ticket_project", "TIMESTAMP_NTZ'2024-01-05 00:00:00' + make_dt_interval(CAST(job_id % 25 AS INT)) AS expires_at"), "job_id").select("event_id", "job_id"))

# --- planning

query("m1_stage_plan", f"""WITH b AS (SELECT page_id, bool_or({_blank('source_text')}) AS open FROM v_blocks GROUP BY 1)
  SELECT page_id, concat_ws(',', CASE WHEN open IS NULL THEN 'detect' END, CASE WHEN coalesce(open, true) THEN 'ocr' END, CASE WHEN inpainted_image_path IS NULL THEN 'inpaint' END) AS stages FROM v_pages LEFT JOIN b USING (page_id)""")(
    lambda t: planning.stage_plan(t.v_blocks, t.v_pages))
query("m3_ocr_targets", f"SELECT page_id, block_id FROM (SELECT *, {_blank('source_text')} AS open, count(*) FILTER ({_blank('source_text')}) OVER (PARTITION BY page_id) AS n FROM v_blocks) WHERE n = 0 OR open")(
    lambda t: planning.ocr_targets(t.v_blocks))


def _in_batches(rows):
    """A memory that takes its rows in three batches, the second of them twice."""
    path = f"{shared_folder(rows.sparkSession).rstrip('/')}/memory-{uuid.uuid4().hex}"
    for version in (0, 1, 1, 2):
        upserts.upsert_batch(rows.where(F.col("seq") % 3 == version), path, version)
    found = upserts.read_memory(rows.sparkSession, path)
    return rows.sparkSession.createDataFrame([], memory.merge(rows).schema) if found is None else found.select(memory.merge(rows).columns)
