"""Queries on what comes in: manifests, files, answers, templates, imports, cuts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intake, templates
from . import exchange_queries
from .registry import query, split_list

_RECORD = "record_id string, page_id long, width double"
query("a2_manifest", """SELECT CAST(page_id AS VARCHAR) AS path, 2 * row_number() OVER (PARTITION BY page_id ORDER BY block_index, block_id) - 1 AS line_no, CASE WHEN block_index = 4 THEN concat(page_id, ': line ', 2 * row_number() OVER (PARTITION BY page_id ORDER BY block_index, block_id) - 1, ' is no valid record') END AS error,
  CASE WHEN block_index <> 4 THEN block_id END AS record_id, CASE WHEN block_index NOT IN (2, 4) THEN width END AS width FROM v_blocks""")(
    lambda t: intake.read_manifest(_files(t), _RECORD, strict=False).select("path", "line_no", "error", "record_id", "width"))


def _files(t):
    """A manifest for each page, with blank lines between and a bad line now and then."""
    b = t.v_blocks.select("page_id", "block_index", F.col("block_id").alias("record_id"), F.when(F.col("block_index") != 2, F.col("width")).alias("width"))
    line = F.when(F.col("block_index") == 4, '{"record_id": "cut').otherwise(F.to_json(F.struct("record_id", "page_id", "width"), {"ignoreNullFields": "false"}))
    b = b.select("page_id", F.struct("block_index", "record_id", line.alias("line")).alias("r"))
    return b.groupBy(F.col("page_id").cast("string").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n \n").alias("value"))


_HEADS = ("89504E470D0A1A0A", "FFD8FF", "524946460000000057454250", "424D", "38425053", "47494638")
_NAMES = ("image/png", "image/jpeg", "image/webp", "image/bmp", "image/vnd.adobe.photoshop")
query("a7_assets", f"""WITH f AS (SELECT doc_id, CASE doc_id % 7 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_NAMES))} END AS kind, CASE WHEN doc_id % 7 = 6 THEN 0 ELSE octet_length(encode(text)) + (CASE doc_id % 7 {' '.join(f"WHEN {k} THEN {len(v) // 2}" for k, v in enumerate(_HEADS))} END) END AS size,
    CASE WHEN doc_id % 5 = 1 THEN 'image/jpg' WHEN doc_id % 5 = 2 THEN 'image/png' END AS declared, 1000 + doc_id * 37 % 20000 AS w, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 8000 END AS h FROM documents WHERE text IS NOT NULL)
  SELECT doc_id AS path, kind AS media_type, CAST(size AS INT) AS byte_size, CASE WHEN size = 0 THEN 'empty' WHEN kind IS NULL THEN 'unknown_signature' WHEN declared <> kind AND NOT (declared = 'image/jpg' AND kind = 'image/jpeg') THEN 'declared_mismatch'
    WHEN kind <> 'image/vnd.adobe.photoshop' AND (h = 0 OR w * h > 120000000) THEN 'too_many_pixels' END AS reason FROM f""")(
    lambda t: intake.checked_assets(_assets(t)).select("path", "media_type", "byte_size", "reason"))


def _assets(t):
    """Texts behind the first bytes of picture files."""
    k = F.col("doc_id") % 7
    head = F.lit(None)
    for n, h in enumerate(_HEADS):
        head = F.when(k == n, h).otherwise(head)
    d = t.documents.where("text is not null")
    declared = F.when(F.col("doc_id") % 5 == 1, "image/jpg").when(F.col("doc_id") % 5 == 2, "image/png")
    content = F.when(k == 6, F.unhex(F.lit(""))).otherwise(F.concat(F.unhex(head), F.col("text").cast("binary")))
    return d.select(F.col("doc_id").alias("path"), content.alias("content"), declared.alias("declared"), (1000 + F.col("doc_id") * 37 % 20000).alias("width"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(8000).alias("height"))


_BUILTIN = [("bubble", 0, "Tahoma", "Tahoma", "#101010", False, False, 24.0, "#ffffff", True, 2.0, True), ("sfx", 1, "Impact", "Impact", "#ff0000", True, False, 40.0, "#000000", True, 4.0, False)]
_FIELDS = "template_id string, ord int, font_stack string, font_family string, color_hex string, bold boolean, italic boolean, font_size double, stroke_color string, stroke_enabled boolean, stroke_width double, auto_font_size boolean"


def _resolved(t):
    return templates.resolved_templates(t.v_projects, t.v_templates, t.v_projects.sparkSession.createDataFrame(_BUILTIN, _FIELDS))


_SQL_BUILTIN = "VALUES " + ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in _BUILTIN)
_RESOLVED = f"""bi({', '.join(f.split()[0] for f in _FIELDS.split(', '))}) AS ({_SQL_BUILTIN}), own AS (SELECT * EXCLUDE (valid) FROM v_templates WHERE valid),
  rs AS (SELECT own.* FROM own JOIN v_projects USING (project_id) UNION ALL BY NAME SELECT p.project_id, bi.* FROM v_projects p CROSS JOIN bi WHERE p.project_id NOT IN (SELECT project_id FROM own))"""
query("b19_templates", f"WITH {_RESOLVED} SELECT project_id, template_id, ord, bold FROM rs")(lambda t: _resolved(t).select("project_id", "template_id", "ord", "bold"))
query("b19_default", """SELECT project_id, (SELECT template_id FROM v_templates t WHERE t.project_id = p.project_id AND valid ORDER BY template_id <> coalesce(default_template_id, 'bubble'), ord, template_id LIMIT 1) AS template_id FROM v_projects p""")(
    lambda t: templates.default_template(t.v_projects, t.v_templates))
_STYLED = """*, CASE block_index % 3 WHEN 0 THEN 'bubble' WHEN 1 THEN 'sfx' ELSE 't2' END AS template_id, CASE WHEN block_index % 2 = 0 THEN '' WHEN block_index % 3 = 0 THEN '#000000' ELSE '#ABCDEF' END AS color_hex, CASE WHEN width > 100 THEN '#123456' END AS detected_color,
  CASE WHEN height > 60 THEN x > 400 END AS detected_bold, CASE WHEN height < 40 THEN true END AS detected_italic, CASE WHEN y > 900 THEN '#0000ff' WHEN y > 600 THEN '#000000' END AS detected_stroke, CASE WHEN x > 500 THEN CAST(0 AS DOUBLE) WHEN x > 200 THEN CAST(3 AS DOUBLE) END AS detected_stroke_width, CAST(20 AS DOUBLE) AS font_size"""
query("b20_applied", f"""WITH {_RESOLVED}, pl AS (SELECT b.*, p.project_id FROM v_blocks b JOIN v_pages p USING (page_id)), bs AS (SELECT {_STYLED} FROM pl),
  j AS (SELECT b.*, coalesce(nullif(b.color_hex, ''), detected_color) AS seen, r.font_stack, r.font_family, r.color_hex AS tc, r.bold, r.italic, r.font_size AS ts, r.stroke_color, r.stroke_enabled, r.stroke_width, r.auto_font_size FROM bs b JOIN rs r USING (project_id, template_id)),
  k AS (SELECT *, seen IS NOT NULL AND seen <> '#000000' AS hc, detected_stroke = '#0000ff' AS hs, CASE coalesce(font_stack, font_family) WHEN 'Kanit, Tahoma,Kanit' THEN 'Kanit,Tahoma' WHEN '' THEN 'Tahoma' WHEN ' Arial ,None' THEN 'Arial' ELSE coalesce(font_stack, font_family) END AS stack FROM j)
  SELECT block_id, string_split(stack, ',')[1] AS font_family, stack AS font_stack, CASE WHEN hc THEN seen ELSE coalesce(tc, color_hex) END AS color_hex, coalesce(detected_bold, bold) AS bold, coalesce(detected_italic, italic, false) AS italic, coalesce(ts, font_size) AS font_size,
    CASE WHEN auto_font_size THEN 'auto' ELSE 'fixed' END AS font_size_mode, CASE WHEN coalesce(hs, false) THEN detected_stroke ELSE coalesce(stroke_color, '#ffffff') END AS stroke_color,
    CASE WHEN coalesce(hs, false) THEN CASE WHEN detected_stroke_width > 0 THEN detected_stroke_width ELSE 2 END WHEN stroke_enabled THEN coalesce(stroke_width, 0) ELSE 0 END AS stroke_width,
    concat_ws(',', CASE WHEN hc THEN 'ai_vision' ELSE 'template' END, CASE WHEN detected_bold IS NULL THEN 'template' ELSE 'ai_vision' END, CASE WHEN detected_italic IS NULL THEN 'template' ELSE 'ai_vision' END, CASE WHEN coalesce(hs, false) THEN 'ai_vision' ELSE 'template' END) AS sources FROM k""")(
    lambda t: templates.apply_templates(t.placed.selectExpr(*[c.strip() for c in split_list(_STYLED)]), _resolved(t)).select(
        "block_id", "font_family", F.array_join("font_stack", ",").alias("font_stack"), "color_hex", "bold", "italic", "font_size", "font_size_mode", "stroke_color", "stroke_width",
        F.concat_ws(",", *[F.col("effect_sources")[k] for k in ("color", "bold", "italic", "stroke")]).alias("sources")))


_LOCKED = "block_id, CASE WHEN block_index % 2 = 0 THEN 'locked_detector_box' ELSE 'manual' END AS region_source, CASE WHEN block_index % 4 = 0 THEN concat('ctx', block_id) END AS context"
query("b11_migrated", f"""WITH b AS (SELECT p.project_id, {_LOCKED} FROM v_blocks v JOIN v_pages p USING (page_id)), o AS (SELECT project_id FROM v_projects WHERE coalesce(TRY_CAST(policy_version AS INT), 0) < 3)
  SELECT project_id, block_id, CASE WHEN context IS NULL THEN 'redetect' ELSE 'restored' END AS action, context AS region FROM b WHERE region_source = 'locked_detector_box' AND project_id IN (SELECT project_id FROM o)""")(
    lambda t: templates.migrated(t.v_projects, _locked(t), 3))
query("b11_counts", f"""WITH b AS (SELECT p.project_id, {_LOCKED} FROM v_blocks v JOIN v_pages p USING (page_id)) SELECT project_id, count(*) AS affected, count(*) FILTER (context IS NULL) AS redetect FROM b JOIN v_projects USING (project_id)
  WHERE region_source = 'locked_detector_box' AND coalesce(TRY_CAST(policy_version AS INT), 0) < 3 GROUP BY 1""")(
    lambda t: templates.migration_counts(templates.migrated(t.v_projects, _locked(t), 3)))


def _locked(t):
    return t.placed.selectExpr("project_id", *split_list(_LOCKED))


_IN_LIST = {
    "color_hex": "'#a0'", "stroke_color_hex": "'red'", "stroke_width_px": "block_index * 1.5::DOUBLE", "gradient_colors": """'["#1","#2"]'""", "gradient": """'{"angle":90}'""", "drop_shadow": "NULL::VARCHAR", "outer_glow": "NULL::VARCHAR",
    "inner_shadow": "NULL::VARCHAR", "bold": "block_index % 2 = 1", "italic": "page_id % 2 = 0",
}
query("c17_boxes", f"""SELECT page_id AS answer_id, concat('box_', block_index, '_', replace(block_id, '-', 'x')) AS box_id, concat('t ', balloon_type) AS text, CASE WHEN page_id % 3 = 0 THEN 'bubble' ELSE balloon_type END AS balloon_type,
  {", ".join(f"CASE WHEN page_id % 3 <> 0 THEN {v} END AS {k}" for k, v in _IN_LIST.items())} FROM v_blocks""")(
    lambda t: intake.matched_boxes(_answers(t)))


def _answers(t):
    """For each page an answer: a list, a list between fences, or lines; ids with a mark in front, and in capitals.  Lists have odd items too."""
    b = t.v_blocks.select("page_id", "block_index", F.concat(F.lit("box_"), F.col("block_index").cast("string"), F.lit("_"), F.replace("block_id", F.lit("-"), F.lit("x"))).alias("box"), F.concat(F.lit("t "), "balloon_type").alias("text"), F.initcap("balloon_type").alias("balloon_type"))
    more = {"color_hex": F.lit("#a0"), "stroke_color_hex": F.lit(""), "stroke_color": F.lit("red"), "stroke_width_px": F.lit(0), "stroke_width": F.col("block_index") * F.lit(1.5), "gradient_colors": F.array(F.lit("#1"), F.lit("#2")), "gradient": F.struct(F.lit(90).alias("angle"))}
    more |= {"drop_shadow": F.lit("none"), "bold": F.col("block_index") % 2, "italic": F.when(F.col("page_id") % 2 == 0, "no").otherwise("")}
    item = F.struct(F.concat(F.lit("`SOME_BOX:"), F.upper("box"), F.lit("`")).alias("box_id"), "text", "balloon_type", *[v.alias(k) for k, v in more.items()])
    line = F.concat(F.lit("box_id: "), "box", F.lit(" | "), "text")
    per = b.groupBy("page_id").agg(F.regexp_replace(F.to_json(F.collect_list(item)), r"\]$", F.lit(', "note", 3, null, {"box_id": "x", "text": 5}]')).alias("list"), F.array_join(F.collect_list(line), "\n").alias("lines"), F.collect_set("box").alias("expected"))
    k = F.col("page_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("Here they are:\n"), "lines")).when(k == 1, F.col("list")).otherwise(F.concat(F.lit("Sure!\n```json\n"), "list", F.lit("\n```")))
    return per.select(F.col("page_id").alias("answer_id"), raw.alias("raw"), "expected")


_UPDATE = """block_id, CASE WHEN block_index % 2 = 0 THEN concat(translation, chr(10), ' ', chr(10), 'more') ELSE translation END AS text, translation AS layout_text, CASE WHEN block_index % 4 = 0 THEN 'oval' END AS hint, CASE WHEN block_index % 3 = 1 THEN 'soft' END AS role, 'Soft' AS role_label, '{soft}' AS role_tag, concat(translation, '{soft}') AS raw, 't_soft' AS role_template"""
query("k6_metadata", f"""WITH u AS (SELECT {_UPDATE} FROM v_blocks), m AS (SELECT block_id, list_filter(['own=1', CASE WHEN several THEN 'line_break_source=ai_preferred' END, CASE WHEN several THEN concat('ai_preferred_lines=["', CASE WHEN trim(layout_text) <> '' THEN concat(layout_text, '","') ELSE '' END, 'more"]') END, CASE WHEN several THEN concat('ai_layout_text=', layout_text) END,
    CASE WHEN hint IS NOT NULL THEN 'ai_layout_hint=oval' END, CASE WHEN role IS NOT NULL THEN 'semantic_role=soft' END, CASE WHEN role IS NOT NULL THEN 'semantic_role_label=Soft' END, CASE WHEN role IS NOT NULL THEN 'semantic_role_source=ai_translation_import_tag' END, CASE WHEN role IS NOT NULL THEN 'semantic_role_tag={{soft}}' END,
    CASE WHEN role IS NOT NULL THEN 'semantic_role_confidence=1.0' END, CASE WHEN role IS NOT NULL THEN concat('semantic_role_raw_translation=', raw) END, CASE WHEN role IS NOT NULL THEN 'semantic_role_template_id=t_soft' END], lambda x: x IS NOT NULL) AS l
  FROM (SELECT *, contains(text, chr(10)) AND trim(layout_text) <> '' AS several FROM u)) SELECT block_id, array_to_string(list_sort(l), ';') AS metadata FROM m""")(
    lambda t: intake.import_metadata(t.v_blocks.selectExpr(*split_list(_UPDATE)).withColumn("metadata", F.create_map(*map(F.lit, ("own", "1", "line_break_source", "old", "semantic_role", "old", "ai_layout_hint", "old"))))).select(
        "block_id", F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("metadata")))

# no SQL: order decides, or wordings are compared letter by letter
query("c10_likeness")(lambda t: intake.match_by_likeness(_imported(t), _wordings(t)))
query("c11_in_order")(lambda t: exchange_queries.found_in_order(t))
# cut by cut: the nearest row outside all boxes is the target itself, an end of its window, or next to a box
query("d10_cuts", """WITH RECURSIVE p AS (SELECT g.page_id, g.height, coalesce(list(struct_pack(lo := greatest(0, b.y::BIGINT - 30), hi := least(g.height, b.y::BIGINT + b.height::BIGINT + 30))) FILTER (b.y IS NOT NULL), []) AS boxes FROM v_pages g LEFT JOIN v_blocks b USING (page_id) GROUP BY ALL),
  w AS (SELECT page_id, height, boxes, [0::BIGINT] AS cuts, 1000::BIGINT AS goal FROM p WHERE height > 1000
    UNION ALL SELECT page_id, height, boxes, list_append(cuts, cut), cut + 1000 FROM (SELECT *, greatest(coalesce(near[1].c, goal), cuts[-1] + 400) AS cut
      FROM (SELECT *, list_sort(list_transform(list_filter([goal, lo, hi - 1] || list_transform(boxes, lambda x: x.lo - 1) || list_transform(boxes, lambda x: x.hi),
          lambda c: c >= lo AND c < hi AND len(list_filter(boxes, lambda x: x.lo <= c AND c < x.hi)) = 0), lambda c: {d: abs(c - goal), c: c})) AS near
        FROM (SELECT *, greatest(100, goal - 250) AS lo, least(height - 100, goal + 250) AS hi FROM w WHERE goal < height - 400))))
  SELECT page_id, CAST(list_append(cuts, height) AS INTEGER[]) AS cuts FROM w WHERE goal >= height - 400 UNION ALL SELECT page_id, CAST([0, height] AS INTEGER[]) FROM p WHERE height <= 1000""")(lambda t: intake.cut_plan(t.v_pages, t.v_blocks, 1000, 400))


def _wordings(t):
    """Texts of a project: the first words of the turns of a conversation."""
    return t.conversations.where("role = 'user'").select(F.col("conv_id").alias("project_id"), F.col("turn").alias("block_id"), F.col("turn").alias("seq"), F.col("text").alias("source_text"))


def _imported(t):
    """The same with slips: every third as it was, every third with letters changed, every third cut."""
    k, text = F.col("seq") / 2 % 3, F.col("source_text")
    slips = F.when(k == 0, F.upper(text)).when(k == 1, F.translate(text, "ae", "ea")).otherwise(F.expr("substring(source_text, 1, cast(length(source_text) * 0.8 as int))"))
    return _wordings(t).select("project_id", F.col("block_id").alias("record_id"), (-F.col("seq")).alias("seq"), F.when(F.col("project_id") % 4 == 0, text).otherwise(slips).alias("source_text"))

