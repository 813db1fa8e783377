"""Queries on style and on what decides a layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import style
from .registry import query, split_list

# signs of all kinds, spread over the boxes
_SEEN = """b.*, p.height AS page_height, CASE WHEN block_index % 2 = 0 THEN balloon_type WHEN block_index % 5 = 3 THEN 'emphasis' END AS detected_type, CASE block_index % 4 WHEN 0 THEN 'vertical_rl' END AS text_direction,
  CASE b.block_index % 3 WHEN 0 THEN '#801010' WHEN 1 THEN '#fafafa' END AS source_color, CASE WHEN x > 450 THEN 'fallback_bbox' ELSE 'smart_balloon' END AS region_source, CASE WHEN y > 700 THEN CAST(2 AS DOUBLE) END AS source_stroke_width"""
_TEXTS = """CASE b.block_index % 6 WHEN 0 THEN 'ドカーン' ELSE source_text END AS source_text, CASE CAST(y AS BIGINT) % 5 WHEN 0 THEN 'BAM' WHEN 1 THEN concat(translation, '!') WHEN 2 THEN 'no!!' ELSE translation END AS translation"""
_NAMES = "block_id, block_index, balloon_type, x, y, b.width, b.height, " + _SEEN.split("b.*, ")[1] + ", " + _TEXTS


def _seen(t, names: str = _NAMES):
    """What is said of blocks alone; the rest is their pages'."""
    return t.v_blocks.alias("b").selectExpr("page_id", *[c for c in map(str.strip, split_list(names)) if not c.startswith("p.")])


def _pages(t):
    return t.v_pages.selectExpr("page_id", "height AS page_height", "project_id")


_JUDGED = f"""s AS (SELECT {_NAMES} FROM v_blocks b JOIN v_pages p ON b.page_id = p.page_id),
  g AS (SELECT *, coalesce(nullif(translation, ''), source_text) AS text, coalesce(detected_type, balloon_type) AS kind, round(width / greatest(height, 1), 4) AS aspect FROM s),
  h AS (SELECT *, CASE kind WHEN 'bubble' THEN 1 WHEN 'narrative' THEN 2 WHEN 'emphasis' THEN 3 WHEN 'sfx' THEN 4 END AS mapped, detected_type IS NOT NULL AS seen, length(text) - length(replace(text, '!', '')) AS loud, length(trim(text)) <= 6 AS short,
      block_index % 6 = 0 AS kata, coalesce(source_color = '#801010', false) AS dark, coalesce(source_color = '#fafafa', false) AND (length(trim(text)) <= 6 OR kind = 'sfx') AS light,
      coalesce(source_stroke_width > 0.5, false) AS outline, round(y / page_height, 4) < 0.12 AND aspect > 1.8 AS top, region_source = 'fallback_bbox' AS fb, coalesce(text_direction = 'vertical_rl', false) AS vert, regexp_matches(text, '[A-Z][A-Z]') AS caps FROM g),
  c AS (SELECT *, [round(0.35 + CASE WHEN mapped = 1 THEN CASE WHEN seen THEN 0.35 ELSE 0.12 END ELSE 0 END - CASE WHEN loud >= 2 THEN 0.15 ELSE 0 END, 6)::DOUBLE,
      round(0.15 + CASE WHEN mapped = 2 THEN CASE WHEN seen THEN 0.35 ELSE 0.12 END ELSE 0 END + CASE WHEN aspect > 2.2 AND height < 80 THEN 0.25 ELSE 0 END + CASE WHEN top THEN 0.15 ELSE 0 END, 6)::DOUBLE,
      round(0.10 + CASE WHEN mapped = 3 THEN CASE WHEN seen THEN 0.35 ELSE 0.12 END ELSE 0 END + CASE WHEN loud >= 2 THEN 0.55 WHEN loud = 1 THEN 0.22 ELSE 0 END + CASE WHEN dark THEN 0.22 ELSE 0 END, 6)::DOUBLE,
      round(0.10 + CASE WHEN mapped = 4 THEN CASE WHEN seen THEN 0.35 ELSE 0.12 END ELSE 0 END + CASE WHEN aspect < 0.55 AND short THEN 0.2 ELSE 0 END + CASE WHEN caps AND short THEN 0.3 ELSE 0 END + CASE WHEN kata THEN 0.35 ELSE 0 END + CASE WHEN light THEN 0.2 ELSE 0 END + CASE WHEN outline AND short THEN 0.15 ELSE 0 END, 6)::DOUBLE] AS sc,
      list_filter([CASE WHEN mapped IS NOT NULL THEN concat(CASE WHEN seen THEN 'DETECTOR_' ELSE 'LEGACY_OR_MANUAL_' END, upper(kind)) END, CASE WHEN aspect > 2.2 AND height < 80 THEN 'WIDE_SHORT_BOX' END, CASE WHEN aspect < 0.55 AND short THEN 'TALL_SHORT_TEXT' END, CASE WHEN fb THEN 'LAYOUT_REGION_FALLBACK' END,
        CASE WHEN loud >= 2 THEN 'MULTI_EXCLAMATION' WHEN loud = 1 THEN 'EXCLAMATION' END, CASE WHEN caps AND short THEN 'LATIN_UPPER_SHORT' END, CASE WHEN kata THEN 'KATAKANA_SFX' END, CASE WHEN dark THEN 'SATURATED_DARK_COLOR' END, CASE WHEN light THEN 'LIGHT_GLYPH_COLOR' END,
        CASE WHEN outline AND short THEN 'HAS_OUTLINE' END, 'HEURISTIC_UNCALIBRATED', CASE WHEN top THEN 'TOP_PAGE_BANNER' END, CASE WHEN vert THEN 'VERTICAL_ORIENTATION' END], lambda r: r IS NOT NULL) AS told FROM h),
  m AS (SELECT *, list_max(sc) AS best, round(list_max(sc) - list_reverse_sort(sc)[2], 6) AS margin, ['dialogue', 'narration', 'emphasis', 'sfx'][list_position(sc, list_max(sc))] AS role FROM c)"""
query("j12_style", f"""WITH {_JUDGED}
  SELECT block_id, role, CASE WHEN role = 'emphasis' OR loud >= 2 THEN 'shout' WHEN role = 'narration' THEN 'soft' ELSE 'normal' END AS intensity, CASE WHEN vert THEN 'vertical' ELSE 'horizontal' END AS orientation, outline AS has_outline,
    round(greatest(0.05, least(0.89, 0.40 + least(0.35, best * 0.30) + least(0.12, margin * 0.35) - CASE WHEN fb THEN 0.12 ELSE 0 END + CASE WHEN seen AND margin > 0.15 THEN 0.06 ELSE 0 END - CASE WHEN len(told) <= 2 THEN 0.08 ELSE 0 END - CASE WHEN source_color IS NULL THEN 0.05 ELSE 0 END)), 4) AS confidence,
    array_to_string(told, ',') || CASE WHEN source_color IS NULL THEN ',NO_SOURCE_COLOR_EVIDENCE' ELSE '' END AS reason_codes FROM m""")(
    lambda t: style.judged(_seen(t), pages=_pages(t)).withColumn("reason_codes", F.array_join("reason_codes", ",")))

# templates of every fifth project, some of which a box has already
_OWN = "project_id, template_id, ord, CASE WHEN template_id = 'sfx' THEN 'SFX' WHEN ord % 3 = 0 THEN 'narrative' WHEN ord % 3 = 1 THEN 'bubble' END AS balloon_type, CASE WHEN ord % 4 = 2 THEN '{ตะโกน}' END AS semantic_tag"
_HAS = "CASE b.block_index % 3 WHEN 0 THEN 'sfx' WHEN 1 THEN 't2' END AS text_template_id, p.project_id"
_PLACE = "CASE WHEN template_id = r THEN 0 WHEN template_id = CASE r WHEN 'dialogue' THEN 'bubble' ELSE r END THEN 1 WHEN CASE r WHEN 'dialogue' THEN coalesce(lower(balloon_type), '') IN ('bubble', 'dialogue', '') WHEN 'narration' THEN coalesce(lower(balloon_type), '') IN ('narrative', 'narration') WHEN 'sfx' THEN coalesce(lower(balloon_type), '') = 'sfx' ELSE coalesce(semantic_tag, '') LIKE '%ตะโกน%' END THEN 2 ELSE 3 END"
query("j12_templates", f"""WITH {_JUDGED.replace(_NAMES, _NAMES + ', ' + _HAS)}, o AS (SELECT {_OWN} FROM v_templates), ps AS (SELECT project_id, r, arg_min(template_id, ({_PLACE}, ord, template_id)) AS pick FROM o CROSS JOIN (SELECT unnest(['dialogue', 'narration', 'emphasis', 'sfx']) AS r) GROUP BY 1, 2),
  j AS (SELECT m.*, coalesce(pick, 'bubble') AS pick, o.template_id AS has, CASE lower(o.balloon_type) WHEN 'bubble' THEN 'dialogue' WHEN 'narrative' THEN 'narration' WHEN 'sfx' THEN 'sfx' END AS speaks FROM m LEFT JOIN ps ON m.project_id = ps.project_id AND m.role = ps.r LEFT JOIN o ON m.project_id = o.project_id AND m.text_template_id = o.template_id),
  k AS (SELECT *, has IS NOT NULL AND (has = CASE role WHEN 'dialogue' THEN 'bubble' ELSE role END OR has = pick OR coalesce(speaks = role, false)) AS keeps FROM j)
  SELECT block_id, CASE WHEN keeps THEN has ELSE pick END AS suggested_template,
    round(greatest(0.05, least(0.89, 0.40 + least(0.35, best * 0.30) + least(0.12, margin * 0.35) - CASE WHEN fb THEN 0.12 ELSE 0 END + CASE WHEN seen AND margin > 0.15 THEN 0.06 ELSE 0 END - CASE WHEN len(told) + keeps::INT <= 2 THEN 0.08 ELSE 0 END - CASE WHEN source_color IS NULL THEN 0.05 ELSE 0 END)), 4) AS confidence,
    array_to_string(told, ',') || CASE WHEN keeps THEN ',KEEP_EXISTING_TEMPLATE' ELSE '' END || CASE WHEN source_color IS NULL THEN ',NO_SOURCE_COLOR_EVIDENCE' ELSE '' END AS reason_codes FROM k""")(
    lambda t: style.judged(_seen(t, _NAMES + ", " + _HAS), t.v_templates.selectExpr(*[c.strip() for c in split_list(_OWN)]), _pages(t)).select("block_id", "suggested_template", "confidence", F.array_join("reason_codes", ",").alias("reason_codes")))

query("j19_fingerprint", """SELECT block_id, sha256(concat_ws('|', 'PS-' || balloon_type, 'f1', printf('%.4f', height / 3), replace(translation, ' ', '|'), printf('%.4f', width / 7), '', CASE WHEN block_index % 2 = 0 THEN 'true' ELSE 'false' END, '', '#000000', '2', '', '', '', '', '', '', '', '', printf('%.4f', x / 11), '', '')) AS render_fingerprint FROM v_blocks""")(
    lambda t: style.render_fingerprint(t.v_blocks.select("block_id", F.concat(F.lit("PS-"), "balloon_type").alias("font_postscript_name"), F.lit("f1").alias("font_fingerprint"), (F.col("height") / 3).alias("font_size"), F.split("translation", " ").alias("explicit_lines"), (F.col("width") / 7).alias("line_height"), (F.col("block_index") % 2 == 0).alias("bold"), F.lit("#000000").alias("color_hex"), F.lit(2).alias("stroke_width"), (F.col("x") / 11).alias("rotation_deg"))).select("block_id", "render_fingerprint"))

_SIGNED = [("translation", None), ("width", "%.2f"), ("height", "%.2f"), ("x", "%.2f"), ("y", "%.2f"), ("confidence", "%.4f"), ("balloon_type", None)]
query("c19_stale", """WITH s AS (SELECT *, block_index % 7 AS k FROM v_blocks) SELECT block_id, CASE k WHEN 1 THEN 'stale' WHEN 2 THEN 'schema' WHEN 3 THEN 'engine' ELSE 'changed' END AS reason FROM s WHERE k IN (1, 2, 3) OR (k = 4 AND x % 2 = 0)""")(
    lambda t: style.stale_specs(_specs(t), t.v_blocks, _SIGNED, "v2", "e9"))


def _specs(t):
    """Specs of the boxes as they were: some marked, some of other versions, some boxes have moved since."""
    k = F.col("block_index") % 7
    old = t.v_blocks.withColumn("x", F.when((k == 4) & (F.col("x") % 2 == 0), F.col("x") + 1).otherwise(F.col("x"))).withColumns({"e": F.lit("e9"), "s": F.lit("v2")})
    return old.select("block_id", F.when(k == 1, "stale").otherwise("ready").alias("layout_status"), F.when(k == 2, "v1").otherwise("v2").alias("schema_version"), F.when(k == 3, None).otherwise("e9").alias("engine_version"), style.fingerprint([*_SIGNED, ("e", None), ("s", None)]).alias("source_signature"))
