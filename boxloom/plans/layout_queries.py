"""Queries on the layout of boxes.  What the tables lack is derived from them by the same SQL on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import boxes, corpus, layout
from .registry import query, split_list


def _derived(columns: str, source: str) -> str:
    return f"SELECT *, {columns} FROM {source}"


_REGION = """CASE WHEN block_index % 3 = 0 THEN x + 5 END AS smart_x, CASE WHEN block_index % 3 = 0 THEN y + 3 END AS smart_y, CASE WHEN block_index % 3 = 0 THEN width - 20 END AS smart_width, CASE WHEN block_index % 3 = 0 THEN height - 12 END AS smart_height,
  CASE WHEN page_id % 2 = 0 THEN x - 1 END AS meta_x, y - 1 AS meta_y, width - 22 AS meta_width, height - 16 AS meta_height, confidence * 2 - CAST(0.5 AS DOUBLE) AS meta_confidence, CASE WHEN page_id % 4 = 0 THEN 'smart_balloon' WHEN page_id % 8 = 2 THEN 'manual' END AS meta_source"""
_FROM_OWN = "x, y, greatest(1, width) AS width, greatest(1, height) AS height, 0::DOUBLE AS confidence, 'bbox' AS source"


def _region_sql(smart: bool) -> str:
    on = "true" if smart else "false"
    keep = "true" if smart else "coalesce(meta_source, '') NOT IN ('smart_balloon', 'smart_balloon_v15')"
    return f"""WITH r AS ({_derived(_REGION, 'v_blocks')}), u AS (SELECT *, coalesce({on} AND smart_x IS NOT NULL AND smart_width > 10 AND smart_height > 10, false) AS s, coalesce(meta_x IS NOT NULL AND meta_width >= 4 AND meta_height >= 4 AND {keep}, false) AS m FROM r)
      SELECT block_id, smart_x AS x, smart_y AS y, smart_width AS width, smart_height AS height, 0.95::DOUBLE AS confidence, 'smart_balloon' AS source FROM u WHERE s
      UNION ALL SELECT block_id, meta_x, meta_y, meta_width, meta_height, greatest(0, least(1, meta_confidence)), coalesce(meta_source, 'metadata') FROM u WHERE NOT s AND m
      UNION ALL SELECT block_id, {_FROM_OWN} FROM u WHERE NOT s AND NOT m"""


def _regions(t, smart: bool):
    return layout.effective_region(t.v_blocks.selectExpr("*", *split_list(_REGION)), smart).select("block_id", "region.*")


query("b9_effective_region", _region_sql(True))(lambda t: _regions(t, True))
query("b10_region_without_smart", _region_sql(False))(lambda t: _regions(t, False))

query("b8_class_selection", "SELECT block_id, balloon_type FROM v_blocks WHERE balloon_type = 'bubble'")(
    lambda t: t.v_blocks.where(F.col("balloon_type") == layout.chosen_class(["bubble", "narrative", "sfx"])).select("block_id", "balloon_type"))

_CROP = """CAST((page_id * 7 + block_index * 13) % 120 AS DOUBLE) AS contrast, CAST((page_id * 3 + block_index) % 50 AS DOUBLE) / 5000 AS edge_density, CAST((page_id + block_index) % 6 AS INT) AS elements, CAST((page_id * 5 + block_index) % 40 AS DOUBLE) AS brightness_sd"""
query("b12_crop_reasons", f"""WITH c AS ({_derived(_CROP, 'v_blocks')}) SELECT block_id, CASE WHEN least(width, height) < 18 THEN 'too_small' WHEN width / height > 8 OR width / height < 0.12::DOUBLE THEN 'extreme_aspect_ratio' WHEN contrast < 35 THEN 'low_contrast' WHEN edge_density < 0.002::DOUBLE THEN 'low_edge_density'
  WHEN elements < CASE WHEN width > 55 THEN 3 ELSE 1 END AND NOT (least(width, height) >= 50 AND brightness_sd > 20) THEN 'insufficient_text_elements' END AS reason FROM c""")(
    lambda t: layout.crop_reason(t.v_blocks.selectExpr("*", *split_list(_CROP))).select("block_id", "reason"))

_MASK = """width * height * CAST((page_id + block_index) % 40 AS DOUBLE) / 40 AS covered_area, width * height * CAST((page_id * 3 + block_index) % 36 AS DOUBLE) AS mask_area"""
query("b15_mask_gate", f"""WITH m AS ({_derived(_MASK, 'v_blocks')}), g AS (SELECT block_id, CASE WHEN covered_area / greatest(1, width * height) < 0.85::DOUBLE THEN 'bbox_cover' WHEN mask_area / greatest(1, width * height) < 1.15::DOUBLE THEN 'area_too_small' WHEN mask_area / greatest(1, width * height) > 30 THEN 'area_too_large' ELSE 'accepted' END AS reason FROM m)
  SELECT block_id, reason = 'accepted' AS accepted, reason FROM g""")(
    lambda t: layout.mask_gate(t.v_blocks.selectExpr("*", *split_list(_MASK))).select("block_id", "accepted", "reason"))

_AUTO = """CASE WHEN block_index % 4 > 0 THEN 'auto_detection' END AS layer_origin, CASE WHEN page_id % 5 = 0 THEN balloon_type END AS detected_type, CASE WHEN page_id % 3 = 0 THEN 'manual' END AS region_source"""
query("m2_prunable", f"""WITH a AS ({_derived(_AUTO, 'v_blocks')}) SELECT page_id, block_id FROM a WHERE (layer_origin IS NOT NULL OR detected_type IS NOT NULL) AND region_source IS NULL AND trim(source_text) = '' AND trim(translation) = ''""")(
    lambda t: layout.prunable(t.v_blocks.selectExpr("*", *split_list(_AUTO))).select("page_id", "block_id"))

query("c20_font_style", """SELECT block_id, CASE balloon_type WHEN 'sfx' THEN 800 ELSE 400 END AS weight, false AS italic, 1.35::DOUBLE AS line_height, CASE balloon_type WHEN 'sfx' THEN 1 ELSE 0 END::DOUBLE AS spacing,
  round(greatest(11, least(36, sqrt(width * height / (greatest(1, length(translation)) * 1.8::DOUBLE)))), 6) AS font_size, CASE balloon_type WHEN 'sfx' THEN 'Kanit' ELSE 'Prompt' END AS family FROM v_blocks""")(
    lambda t: layout.font_style(t.v_blocks.withColumn("text", F.col("translation"))).select("block_id", "family", "weight", "italic", "line_height", "spacing", F.round("font_size", 6).alias("font_size")))

_LINED = "replace(translation, ' word', concat(chr(10), 'word')) AS lined, CASE WHEN page_id % 2 = 0 THEN 'ja' ELSE 'en' END AS lang"
query("j4_font_estimate", f"""WITH l AS ({_derived(_LINED, 'v_blocks')}), n AS (SELECT *, len(list_filter(string_split(lined, chr(10)), lambda s: trim(s) <> ''))::DOUBLE AS n, length(trim(replace(lined, chr(10), '')))::DOUBLE AS c FROM l), p AS (SELECT *, greatest(1, c / nullif(n, 0)) AS a FROM n)
  SELECT block_id, CASE WHEN n > 0 AND c > 0 THEN round(greatest(12, least(120, CASE lang WHEN 'ja' THEN least(width / n * 0.85::DOUBLE, height / a * 0.95::DOUBLE) ELSE least(height / n * 0.85::DOUBLE, width / a * 0.95::DOUBLE) END)), 6) END AS font_size FROM p""")(
    lambda t: t.v_blocks.selectExpr("*", *split_list(_LINED)).select("block_id", F.round(layout.font_estimate(F.col("lined"), F.col("lang"), F.col("width"), F.col("height")), 6).alias("font_size")))

_HINT = """g AS (SELECT *, floor(greatest(20, width) / greatest(20, height) * 100 + 0.5::DOUBLE) / 100 AS aspect, greatest(1, least(8, floor(greatest(20, height) * 0.85::DOUBLE / 30)::INT)) AS max_lines, CASE WHEN trim(translation) <> '' THEN translation ELSE source_text END AS txt FROM v_blocks),
  s AS (SELECT *, CASE balloon_type WHEN 'sfx' THEN 'free' WHEN 'narrative' THEN 'rectangle' ELSE CASE WHEN aspect >= 1.4::DOUBLE THEN 'wide_oval' WHEN aspect <= 0.75 THEN 'tall_oval' WHEN aspect BETWEEN 0.85::DOUBLE AND 1.15::DOUBLE THEN 'round_bubble' ELSE 'ellipse' END END AS shape, length(replace(txt, ' ', '')) AS u FROM g),
  n AS (SELECT *, greatest(1, least(max_lines, CASE WHEN u > 0 THEN ceil(u / greatest(4, greatest(20, width) * CASE shape WHEN 'rectangle' THEN 0.92::DOUBLE ELSE 0.78::DOUBLE END / (42 * 0.52::DOUBLE))) ELSE 3 END))::INT AS target_lines FROM s),
  h AS (SELECT *, CASE WHEN shape IN ('free', 'rectangle') THEN 'Uniform' WHEN target_lines >= 3 THEN 'Short-Long-Long-Short' ELSE 'Short-Long' END AS pattern FROM n)"""
query("j14_spatial_hint", f"""WITH {_HINT} SELECT block_id, shape, aspect, target_lines, max_lines, pattern, concat('[[SMART_BALLOON_SPATIAL shape=', shape, ' aspect=', aspect, ' w=', trunc(greatest(20, width))::INT, ' h=', trunc(greatest(20, height))::INT, ' target_lines=', target_lines, ' max_lines=', max_lines, ' pattern=', pattern, ']]') AS tag FROM h""")(
    lambda t: layout.spatial_hint(t.v_blocks).select("block_id", "shape", "aspect", "target_lines", "max_lines", "pattern", "tag"))
query("j15_read_hint", f"""WITH {_HINT} SELECT block_id, shape, aspect, trunc(greatest(20, width))::INT AS width, trunc(greatest(20, height))::INT AS height, target_lines, max_lines, pattern FROM h""")(
    lambda t: layout.spatial_hint(t.v_blocks).select("block_id", *[c.alias(k) for k, c in layout.read_hint(F.col("tag")).items()]))

# three layouts for each block: one to three lines
_WIDTHS = "transform(sequence(1, candidate), i -> CAST(1 + (page_id * 31 + block_index * 17 + CAST(x AS BIGINT) * i) % 97 AS DOUBLE))"
query("f14_best_layout", """WITH c AS (SELECT *, unnest([1, 2, 3]) AS candidate FROM v_blocks),
  w AS (SELECT *, list_transform(range(1, candidate + 1), lambda i: (1 + (page_id * 31 + block_index * 17 + x::BIGINT * i) % 97)::DOUBLE) AS ws FROM c),
  a AS (SELECT *, list_max(ws) AS m, list_sum(ws) / candidate AS mean, balloon_type = 'bubble' AS rnd, list_transform(range(0, candidate), lambda i: sin(3.141592653589793::DOUBLE * (i + 0.5::DOUBLE) / candidate)) AS arc FROM w),
  s AS (SELECT block_id, candidate, (30 - 4 * candidate) * 25.0::DOUBLE - CASE WHEN height < candidate * 20 THEN 10000 + (candidate * 20 - height) * 100 ELSE 0 END
    - CASE WHEN candidate = 1 THEN 0 WHEN rnd THEN 350 * list_sum(list_transform(range(1, candidate + 1), lambda i: abs(ws[i] / m - arc[i] / list_max(arc)))) / candidate ELSE 300 * sqrt(list_sum(list_transform(ws, lambda v: (v - mean) * (v - mean))) / candidate) / mean END
    - CASE WHEN candidate > 1 AND ws[candidate] / (list_sum(ws[1:candidate - 1]) / (candidate - 1)) < 0.3::DOUBLE THEN 300 ELSE 0 END
    - CASE WHEN rnd THEN abs(m / (candidate * 20) - width / height) * 50 ELSE 0 END AS score FROM a)
  SELECT block_id, candidate, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY round(score, 6) DESC, candidate) = 1""")(
    lambda t: layout.best_candidate(_candidates(t)).select("block_id", "candidate", "score"))


def _candidates(t):
    c = t.v_blocks.withColumn("candidate", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("widths", F.expr(_WIDTHS))
    tall = (F.col("candidate") * 20).cast("double")
    over = F.when(F.col("height") < tall, tall - F.col("height"))
    size = (F.lit(30) - F.col("candidate") * 4).cast("double")
    return c.withColumn("score", layout.layout_score(size, F.col("widths"), tall, over, F.col("width"), F.col("height"), F.col("balloon_type")))


query("a8_oversize", """WITH p AS (SELECT project_id, width, count(*) AS n, count(*) FILTER (height > 3500) AS o, max(height) AS t FROM v_pages GROUP BY ALL)
  SELECT project_id, sum(n)::BIGINT AS images, sum(o)::BIGINT AS oversize, max(t) AS max_height, 3500 AS split_height, arg_max(width, n * 100000 - width) AS common_width FROM p GROUP BY 1""")(
    lambda t: layout.oversize(t.v_pages, "project_id", 3500))

query("d3_clamped_tile_labels", """WITH side AS (SELECT page_id, width, height, least(width, height) AS th, greatest(1, trunc(least(width, height) * 0.8)::INT) AS st FROM v_pages),
  tiles AS (SELECT page_id, width AS tw, th, k, CASE WHEN k < n THEN k * st ELSE height - th END AS top FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM (SELECT *, ceil((height - th) / st::DOUBLE)::BIGINT AS n FROM side))),
  held AS (SELECT *, y >= top AND y + height <= top + th AS whole FROM v_blocks JOIN tiles USING (page_id) WHERE (y >= top AND y + height <= top + th) OR least(y + height, top + th) - greatest(y, top) >= 0.5 * height),
  c AS (SELECT *, CASE WHEN whole THEN y - top ELSE greatest(0, y - top) END AS a FROM held), d AS (SELECT *, CASE WHEN whole THEN height ELSE least(th - a, height) END AS b FROM c)
  SELECT page_id, k, block_id, greatest(0.001::DOUBLE, least(0.999::DOUBLE, (x + width / 2) / tw)) AS cx, greatest(0.001::DOUBLE, least(0.999::DOUBLE, (a + b / 2) / th)) AS cy, greatest(0.001::DOUBLE, least(0.999::DOUBLE, width / tw)) AS w, greatest(0.001::DOUBLE, least(0.999::DOUBLE, b / th)) AS h FROM d WHERE whole OR b >= 15""")(
    lambda t: layout.clamped_tile_labels(boxes.in_tiles(t.v_blocks, boxes.tiles(t.v_pages))))

_SIZED = "CASE WHEN block_index = 2 THEN 0 ELSE width END AS w2"
_RECORDS = f"""p AS (SELECT b.*, project_id, row_number() OVER (PARTITION BY page_id ORDER BY block_index, block_id) - 1 AS idx, {_SIZED.replace('ELSE width', 'ELSE b.width')} FROM v_blocks b JOIN v_pages USING (page_id)), v AS (SELECT *, count(*) OVER (PARTITION BY page_id) - 1 AS rivals FROM p WHERE w2 > 0 AND height > 0),
  h AS (SELECT *, ('0x' || substring(md5(CAST(project_id AS VARCHAR)), 1, 12))::BIGINT / pow(16, 12) AS u FROM v),
  m AS (SELECT printf('%s_%d_b%03d', substring(project_id::VARCHAR, 1, 12), page_id, idx) AS record_id, balloon_type, rivals, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'dev' ELSE 'test' END AS split, project_id, page_id, idx FROM h WHERE balloon_type IN ('bubble', 'sfx'))"""


def _records(t, limit: int | None = None):
    return corpus.manifest(t.placed.withColumn("width", F.expr(_SIZED.removesuffix(" AS w2"))), ("bubble", "sfx"), limit)


query("d9_manifest", f"WITH {_RECORDS} SELECT record_id, balloon_type, rivals, split FROM m")(lambda t: _records(t).select("record_id", "balloon_type", "rivals", "split"))
query("d9_first", f"WITH {_RECORDS} SELECT record_id, split FROM m ORDER BY project_id, page_id, idx LIMIT 500")(lambda t: _records(t, 500).select("record_id", "split"))
query("d9_counts", f"WITH {_RECORDS} SELECT 'split' AS kind, split AS value, count(*) AS records FROM m GROUP BY 2 UNION ALL SELECT 'type', balloon_type, count(*) FROM m GROUP BY 2")(lambda t: corpus.manifest_counts(_records(t)))

_SPEC_A = """block_id, x, y, width, height, height / 3 AS font_size, CAST(1.25 AS DOUBLE) AS line_height, CASE WHEN balloon_type = 'sfx' THEN true END AS bold, CASE WHEN page_id % 2 = 0 THEN 'center' END AS text_align,
  CASE WHEN page_id % 3 > 0 THEN '#AABB0C' END AS color_hex, split(translation, ' ') AS explicit_lines, balloon_type AS resolved_postscript_name, CAST(0.005 AS DOUBLE) AS tracking, CASE WHEN page_id % 2 = 0 THEN false END AS italic,
  CASE WHEN block_index % 2 = 0 THEN CAST(0.5 AS DOUBLE) END AS stroke_width, CASE WHEN page_id % 4 = 1 THEN '#FF0000' END AS stroke_color, CASE WHEN page_id % 4 = 2 THEN 'left' END AS horizontal_align, 'top' AS vertical_align, CASE WHEN page_id % 10 > 0 THEN 'ltr' END AS writing_direction"""
_SPEC_B = """block_id, x + block_index AS x, y, width, height, height / 3 + CAST(page_id % 4 AS DOUBLE) / 200 AS font_size, CAST(1.25 AS DOUBLE) AS line_height, page_id % 7 = 0 AS bold, CASE WHEN page_id % 4 = 0 THEN 'center' ELSE '' END AS text_align,
  CASE WHEN page_id % 5 = 0 THEN 'aabb0d' ELSE 'aabb0c' END AS color_hex, split(CASE WHEN page_id % 6 = 0 THEN concat(translation, ' x') WHEN page_id % 6 = 1 THEN concat(translation, 'x') ELSE translation END, ' ') AS explicit_lines,
  CASE WHEN page_id % 5 = 1 THEN '' ELSE balloon_type END AS font_postscript_name, page_id % 9 = 0 AS italic, CAST(page_id % 2 AS DOUBLE) / 2 AS stroke_width, CASE WHEN page_id % 2 = 1 THEN '#ff0000' ELSE '' END AS stroke_color,
  CASE WHEN page_id % 4 = 2 THEN 'center' END AS horizontal_align, CASE WHEN page_id % 8 = 0 THEN 'middle' ELSE 'top' END AS vertical_align, CASE WHEN page_id % 10 > 1 THEN 'ltr' END AS writing_direction, CASE WHEN page_id % 11 = 0 THEN CAST(2.5 AS DOUBLE) END AS rotation_deg"""
_EXACT = {
    "explicit_lines": ("a.explicit_lines", "b.explicit_lines"), "line_count": ("len(a.explicit_lines)", "len(b.explicit_lines)"), "font_postscript": ("nullif(a.resolved_postscript_name, '')", "nullif(b.font_postscript_name, '')"),
    "bold": ("coalesce(a.bold, false)", "b.bold"), "italic": ("coalesce(a.italic, false)", "b.italic"), "stroke_color": ("lower(coalesce(a.stroke_color, ''))", "b.stroke_color"),
    "text_align": ("coalesce(a.text_align, a.horizontal_align)", "coalesce(nullif(b.text_align, ''), b.horizontal_align)"), "vertical_align": ("a.vertical_align", "b.vertical_align"), "writing_direction": ("a.writing_direction", "b.writing_direction"),
}
_DIFFERS = {f: f"{x} IS DISTINCT FROM {y}" for f, (x, y) in _EXACT.items()} | {
    "font_size": "abs(a.font_size - b.font_size) > 0.01::DOUBLE", "line_height": "abs(a.line_height - b.line_height) > 0.01", "tracking": "false", "color_hex": "lower(replace(a.color_hex, '#', '')) <> b.color_hex",
    "stroke_width": "abs(coalesce(a.stroke_width, 0) - b.stroke_width) > 0.01", "rotation_deg": "b.rotation_deg IS NOT NULL",
    "center": "greatest(abs(a.x + a.width / 2 - (b.x + b.width / 2)), abs(a.y + a.height / 2 - (b.y + b.height / 2))) > greatest(2, 0.01::DOUBLE * greatest(a.width, a.height, 1))",
}
_IN_TURN = ("explicit_lines", "line_count", "font_postscript", "font_size", "line_height", "tracking", "bold", "italic", "color_hex", "stroke_width", "stroke_color", "text_align", "vertical_align", "writing_direction", "rotation_deg", "center")
query("c18_spec_differences", f"""WITH a AS (SELECT {_SPEC_A} FROM v_blocks WHERE block_index <> 3), b AS (SELECT {_SPEC_B} FROM v_blocks WHERE block_index <> 4)
  SELECT coalesce(a.block_id, b.block_id) AS block_id, CASE WHEN a.block_id IS NULL OR b.block_id IS NULL THEN 'block' ELSE concat_ws(',', {", ".join(f"CASE WHEN {_DIFFERS[f]} THEN '{f}' END" for f in _IN_TURN)}) END AS mismatches FROM a FULL JOIN b ON a.block_id = b.block_id""")(
    lambda t: layout.spec_differences(t.v_blocks.where("block_index <> 3").selectExpr(*map(str.strip, split_list(_SPEC_A))), t.v_blocks.where("block_index <> 4").selectExpr(*map(str.strip, split_list(_SPEC_B)))))

# --- wording

_SOURCE = "CASE WHEN doc_id % 2 = 0 THEN 'ja' ELSE 'en' END"
query("j1_clean_text", rf"""WITH d AS (SELECT doc_id, doc_id % 2 = 0 AS cjk, replace(text, chr(13), '') AS s FROM documents)
  SELECT doc_id, translate(CASE WHEN cjk THEN regexp_replace(s, '[\s\x0B\p{{Z}}]+', '', 'g') ELSE regexp_replace(regexp_replace(s, '[\s\x0B\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g') END, ',.?!:;()', '，。？！：；（）') AS text FROM d""")(
    lambda t: t.documents.select("doc_id", tx.clean_recognised(F.col("text"), F.expr(_SOURCE), wide=True).alias("text")))
query("j20_keep_wording", r"""SELECT block_id, regexp_replace(CASE WHEN replace(translation, ' ', '') = replace(n, ' ', '') THEN translation ELSE n END, '[\r\n]+', '', 'g') AS text FROM (SELECT *, CASE WHEN page_id % 2 = 0 THEN replace(translation, ' ', '') ELSE concat(translation, ' x') END AS n FROM v_blocks)""")(
    lambda t: t.v_blocks.withColumn("n", F.expr("CASE WHEN page_id % 2 = 0 THEN replace(translation, ' ', '') ELSE concat(translation, ' x') END")).select("block_id", tx.kept_wording(F.col("translation"), F.col("n")).alias("text")))
query("j16_dictionary", "SELECT DISTINCT word, length(word) AS letters FROM (SELECT trim(unnest(string_split(text, ' '))) AS word FROM benchmark) WHERE length(word) >= 2")(
    lambda t: tx.dictionary(t.benchmark.select(F.explode(F.split("text", " ")).alias("word"))))
_LOG = "CASE event_id % 5 WHEN 0 THEN 'RESOURCE_EXHAUSTED' WHEN 1 THEN concat('Individual quota reached. Resets in ', CAST(event_id % 60 AS STRING), 'm 3s. ', props) WHEN 2 THEN 'HTTP 429 Too Many Requests' ELSE props END"
query("j18_quota_errors", f"""SELECT event_id, CASE WHEN event_id % 5 = 1 THEN concat('Individual quota reached (Resets in ', event_id % 60, 'm 3s)') WHEN event_id % 5 = 2 THEN 'HTTP 429 Rate Limit Exceeded' ELSE 'Individual quota reached' END AS reason FROM v_events WHERE event_id % 5 < 3""")(
    lambda t: t.v_events.select("event_id", tx.quota_reason(F.expr(_LOG)).alias("reason")).where("reason IS NOT NULL"))
query("j2_noise_lines", r"""WITH l AS (SELECT doc_id AS file_id, unnest(range(0, len(s))) AS line_no, unnest(s) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n|\r', chr(10), 'g'), chr(10)) AS s FROM documents)),
  n AS (SELECT file_id, line_no, regexp_replace(CASE line_no % 3 WHEN 0 THEN concat('// ', line, ' /') WHEN 1 THEN concat('」 ', line, '「') ELSE '(「…」~)' END, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS s FROM l)
  SELECT file_id, line_no, CASE WHEN s = '(「…」~)' THEN s ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '^[/\\]+[\s\p{Z}]*', ''), '[\s\p{Z}]*[/\\]+$', ''), '^[」\s\p{Z}]+', ''), '[「\s\p{Z}]+$', ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') END AS text FROM n""")(
    lambda t: _noisy(t))
_TAGGED = "concat(translation, CASE seq % 5 WHEN 0 THEN ' {shout} { soft }' WHEN 1 THEN '{soft}' WHEN 2 THEN ' {other}' WHEN 3 THEN ' {soft} x' ELSE '' END)"
query("j7_tags", "SELECT seq, CASE WHEN seq % 5 = 2 THEN translation || ' {other}' WHEN seq % 5 = 3 THEN translation || ' {soft} x' ELSE translation END AS text, CASE WHEN seq % 5 < 2 THEN 't_soft' END AS role, CASE WHEN seq % 5 < 2 THEN 'soft' END AS label, seq % 5 = 0 AS repeated FROM v_tm")(
    lambda t: t.v_tm.select("seq", *[c.alias(k) for k, c in tx.trailing_tag(F.expr(_TAGGED), {"shout": "t_shout", "soft": "t_soft"}).items()]))
query("j17_rule_hits", """WITH w AS (SELECT unnest(string_split(lower(text), ' ')) AS token FROM documents), n AS (SELECT token, count(*) AS n FROM w GROUP BY 1), r AS (SELECT * FROM (VALUES ('forward', 'un'), ('forward', 'ge'), ('backward', 'en'), ('compound', 'schl')) v(kind, part))
  SELECT kind, part, sum(n)::BIGINT AS hits, count(*) AS tokens FROM n, r WHERE CASE kind WHEN 'forward' THEN starts_with(token, part) AND length(token) > length(part) WHEN 'backward' THEN suffix(token, part) AND length(token) > length(part) ELSE contains(token, part) END GROUP BY 1, 2""")(
    lambda t: tx.rule_hits(t.documents.select(F.explode(F.split(F.lower("text"), " ")).alias("token")), [("forward", "un"), ("forward", "ge"), ("backward", "en"), ("compound", "schl")]))


def _noisy(t):
    from ..operators.lines import lines_of

    dirty = F.expr("CASE line_no % 3 WHEN 0 THEN concat('// ', line, ' /') WHEN 1 THEN concat('」 ', line, '「') ELSE '(「…」~)' END")
    return lines_of(t.documents, "doc_id", "text").select("file_id", "line_no", tx.without_noise(dirty).alias("text"))

_SPEC = """page_id % 17 = 0 AS overflow, page_id % 13 = 0 AS font_fallback, CASE WHEN block_index = 2 THEN 'FONT_TOO_SMALL' WHEN block_index = 3 THEN 'TEXT_OVERFLOW' ELSE 'MINOR' END AS issue, CASE WHEN page_id % 5 = 0 THEN 'BAD' END AS code, confidence + CAST(0.2 AS DOUBLE) AS lc, CAST((page_id * 7 + block_index) % 20 AS DOUBLE) / 20 AS sc"""
query("j13_decision", f"""WITH s AS ({_derived(_SPEC, 'v_blocks')}) SELECT block_id, CASE WHEN overflow OR issue = 'TEXT_OVERFLOW' OR font_fallback OR lc < 0.9::DOUBLE OR issue = 'FONT_TOO_SMALL' OR code IS NOT NULL THEN 'NEEDS_REVIEW' WHEN sc < 0.9::DOUBLE THEN 'DEFAULTED' ELSE 'AUTO_APPLIED' END AS status,
  CASE WHEN overflow OR issue = 'TEXT_OVERFLOW' THEN 'TEXT_OVERFLOW' WHEN font_fallback THEN 'FONT_FALLBACK' WHEN lc < 0.9::DOUBLE THEN CASE issue WHEN 'FONT_TOO_SMALL' THEN 'FONT_TOO_SMALL,LOW_LAYOUT_CONFIDENCE' ELSE 'LOW_LAYOUT_CONFIDENCE' END WHEN issue = 'FONT_TOO_SMALL' THEN issue WHEN code IS NOT NULL THEN code WHEN sc < 0.9::DOUBLE THEN 'LOW_STYLE_CONFIDENCE' ELSE 'CONSTRAINTS_OK' END AS reasons FROM s""")(
    lambda t: layout.decision(t.v_blocks.selectExpr("*", *split_list(_SPEC)).withColumns({"issues": F.array("issue"), "error_codes": F.expr("filter(array(code), x -> x IS NOT NULL)"), "layout_confidence": F.col("lc"), "style_confidence": F.col("sc")}))
    .select("block_id", "status", F.array_join("reasons", ",").alias("reasons")))
