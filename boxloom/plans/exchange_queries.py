"""Queries on exchange files."""

from __future__ import annotations

from pyspark.sql import Row, Window, functions as F

from ..operators import exchange, intake
from .registry import query, split_list

_ORDER = "ORDER BY block_index, block_id"
query("a5_snapshot", f"""SELECT page_id, '[' || string_agg(concat('{{"block_id":"', block_id, '","bbox":[', x, ',', y, ',', width, ',', height, '],"type":"', balloon_type, '","confidence":', confidence, '}}'), ',' {_ORDER}) || ']' AS balloons FROM v_blocks GROUP BY 1""")(
    lambda t: exchange.snapshot(t.v_blocks))
query("a1_read_snapshot", f"SELECT page_id, row_number() OVER (PARTITION BY page_id {_ORDER}) - 1 AS idx, block_id, x, y, width, height, balloon_type, confidence FROM v_blocks")(
    lambda t: exchange.read_snapshot(exchange.snapshot(t.v_blocks)))
query("a3_document", f"""SELECT page_id, '[' || string_agg(concat('{{"block_index":', block_index, ',"block_id":"', block_id, '","x":', x, CASE WHEN block_index <> 2 THEN concat(',"width":', width) ELSE '' END, ',"translation":"', translation, '"}}'), ',' {_ORDER}) || ']' AS document FROM v_blocks GROUP BY 1""")(
    lambda t: exchange.document(_partial(t)))
query("a3_projects", f"""WITH b AS (SELECT page_id, string_agg(concat('{{"id":"', block_id, '","block_index":', block_index, ',"x":', x, ',"y":', y, ',"width":', width, ',"height":', height, ',"source_text":"', source_text, '","translation":', CASE WHEN translation = '' THEN 'null' ELSE concat('"', translation, '"') END, ',"balloon_type":"', balloon_type, '","confidence":', confidence, ',"extra_metadata":{{', CASE WHEN block_index = 1 THEN '"k":"v"' ELSE '' END, '}}}}'), ',' {_ORDER}) AS t FROM v_blocks GROUP BY 1)
  SELECT project_id, concat('{{"id":', project_id, ',"pages":[', string_agg(concat('{{"id":', page_id, ',"width":', width, ',"height":', height, ',"inpainted_image_path":', coalesce('"' || inpainted_image_path || '"', 'null'), ',"text_blocks":[', coalesce(t, ''), ']}}'), ',' ORDER BY page_id), ']}}') AS document FROM v_pages LEFT JOIN b USING (page_id) GROUP BY 1""")(
    lambda t: exchange.project_documents(t.v_blocks.withColumns({"translation": F.nullif("translation", F.lit("")), "extra_metadata": F.when(F.col("block_index") == 1, F.create_map(F.lit("k"), F.lit("v")))}), t.v_pages))
query("a4_restore", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY page_id {_ORDER}) - 1 AS idx FROM v_blocks)
  SELECT CASE WHEN block_index = 3 THEN md5(concat_ws('/', page_id, idx, block_id)) ELSE block_id END AS block_id, page_id, block_index, x, 0::DOUBLE AS y, CASE WHEN block_index = 2 THEN 100 ELSE width END AS width, 50::DOUBLE AS height, 'NotoSansThai' AS font_family, 'bubble' AS balloon_type, '' AS source_text, translation FROM r""")(
    lambda t: exchange.restore(exchange.document(_partial(t)), t.v_blocks.where("block_index = 3"))
    .select("block_id", "page_id", "block_index", "x", "y", "width", "height", "font_family", "balloon_type", "source_text", "translation"))

_BUBBLE = "b AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY page_id, block_index, block_id) AS bubble FROM v_blocks JOIN v_pages USING (page_id))"
query("a11_export_ocr", f"WITH {_BUBBLE} SELECT project_id, bubble, concat('//', trim(source_text)) AS text FROM b")(
    lambda t: exchange.export_text(t.placed, "ocr", {"word": "t"}))
query("a11_export_both", f"WITH {_BUBBLE} SELECT project_id, bubble, concat('# Bubble ', bubble, chr(10), '{exchange.SOURCE_MARK}', source_text, chr(10), '{exchange.TRANSLATION_MARK}', translation, chr(10)) AS text FROM b")(
    lambda t: exchange.export_text(t.placed.withColumn("translation", F.concat("translation", F.lit(" {soft} "))), "both", {"soft": "t_soft"}))
query("a11_export_layout", f"WITH {_BUBBLE} SELECT project_id, bubble, concat(source_text, chr(10), '[[', balloon_type, ']]', CASE WHEN translation <> '' THEN concat(chr(10), translation, ' x') ELSE concat(chr(10), 'x') END, chr(10)) AS text FROM b")(
    lambda t: exchange.export_text(t.placed.withColumns({"layout": F.concat(F.lit("[["), "balloon_type", F.lit("]]")), "translation": F.concat(F.when(F.col("translation") != "", F.concat("translation", F.lit("\n"))).otherwise(""), F.lit("x {soft} "))}), "ai_layout", {"soft": "t_soft"}))

_TABS = "concat_ws(chr(9), CASE WHEN p_partkey % 3 < 2 THEN p_type ELSE '1' END, CASE WHEN p_partkey % 3 <> 0 THEN concat(' ', p_brand) END, CASE WHEN p_partkey % 3 = 2 THEN p_type END, CASE WHEN p_partkey % 3 <> 1 THEN concat('a', chr(92), 'n', p_name) END, CASE WHEN p_partkey % 6 = 5 THEN 'more' END)"
query("k2_tabs", """WITH r AS (SELECT p_size AS file_id, p_partkey AS line_no, p_partkey % 3 AS m, p_type, p_brand, p_name FROM part), c AS (SELECT *, count(*) OVER (PARTITION BY file_id ORDER BY line_no) AS n FROM r)
  SELECT file_id, line_no, CASE m WHEN 2 THEN p_brand END AS block_id, p_type AS source, CASE m WHEN 0 THEN concat('a', chr(10), p_name) WHEN 1 THEN p_brand ELSE concat('a', chr(10), p_name, CASE WHEN line_no % 6 = 5 THEN concat(chr(9), 'more') ELSE '' END) END AS translation, CASE WHEN m < 2 THEN n END::BIGINT AS position, NULL::VARCHAR AS error FROM c""")(
    lambda t: exchange.read_tabs(t.part.select(F.col("p_size").alias("file_id"), F.col("p_partkey").alias("line_no"), F.expr(_TABS.replace("chr(92)", "char(92)").replace("chr(9)", "char(9)")).alias("line"))))


_HINT = "[[SMART_BALLOON_SPATIAL shape=ellipse aspect=1.5 w=30 h=20 target_lines=2 max_lines=4]]"


def _partial(t):
    return t.v_blocks.selectExpr("page_id", "block_id", "block_index", "x", "CASE WHEN block_index <> 2 THEN width END AS width", "translation")


def _numbered(t):
    bubble = F.row_number().over(Window.partitionBy("project_id").orderBy("page_id", "block_index", "block_id"))
    return t.placed.withColumn("bubble", bubble).select("project_id", "block_id", "bubble", "source_text", "translation")


def _file(t):
    """The project's export, as the lines of one file."""
    e = exchange.export_text(t.placed, "both", {"soft": "t_soft"})
    numbered = F.transform(F.split("text", "\n"), lambda line, k: F.struct(k.alias("k"), line.alias("line")))
    hint = F.when(F.col("bubble") % 4 == 1, F.array(F.struct(F.lit(5).alias("k"), F.lit(f" {_HINT}").alias("line")))).otherwise(F.slice(numbered, 1, 0))
    e = e.select(F.col("project_id").alias("file_id"), "bubble", F.explode(F.concat(numbered, hint)).alias("at"))
    return e.select("file_id", (F.col("bubble") * 10 + F.col("at.k")).alias("line_no"), "at.line")


query("k1_labelled", f"WITH {_BUBBLE} SELECT project_id AS file_id, bubble * 10 AS line_no, NULL::VARCHAR AS block_id, bubble::INT AS bubble, nullif(trim(source_text), '') AS source, trim(translation) AS translation, CASE WHEN bubble % 4 = 1 THEN '{_HINT}' END AS layout FROM b")(
    lambda t: exchange.read_labelled(_file(t)))

# records that name their block by id, by wording or by place; some name none, some name one again
_RECORD = """project_id, CAST(bubble AS BIGINT) AS record_no, CASE bubble % 3 WHEN 0 THEN CASE WHEN bubble % 9 = 0 THEN 'gone' ELSE block_id END END AS block_id,
  CASE WHEN bubble % 3 = 1 THEN CASE WHEN bubble % 7 = 0 THEN 'else' ELSE nullif(trim(source_text), '') END WHEN bubble % 6 = 3 THEN 'other words' END AS source,
  CAST(CASE WHEN bubble % 11 = 0 THEN bubble - 1 WHEN bubble % 13 = 0 THEN 1000000 ELSE bubble END AS INT) AS bubble, CASE WHEN bubble % 5 = 0 THEN ' ' ELSE concat('ก ', translation) END AS translation, 'th' AS target"""
# record by record: the blocks of a project as a list, and the places in it that were taken
_FOUND = f"""{_BUBBLE}, r AS (SELECT *, CASE WHEN block_id IS NOT NULL THEN 'id' WHEN source IS NOT NULL THEN 'source' ELSE 'bubble' END AS way, replace(coalesce(source, ''), ' ', '') AS norm FROM (SELECT {_RECORD} FROM b)),
  p AS (SELECT project_id, list(struct_pack(id := block_id, norm := replace(source_text, ' ', '')) ORDER BY bubble) AS own FROM b GROUP BY project_id),
  w AS (SELECT project_id, own, 0::BIGINT AS k, [0::BIGINT] AS taken, 0::BIGINT AS pos, false AS again FROM p
    UNION ALL SELECT project_id, own, record_no, list_append(taken, pos), pos, way <> 'source' AND pos > 0 AND list_contains(taken, pos)
    FROM (SELECT w.project_id, own, taken, record_no, way, CASE way WHEN 'id' THEN coalesce(list_position(list_transform(own, lambda x: x.id), r.block_id), 0) WHEN 'bubble' THEN CASE WHEN r.bubble <= len(own) THEN r.bubble ELSE 0 END
      ELSE coalesce(list_position(list_transform(own, lambda x, i: x.norm = r.norm AND NOT list_contains(taken, i)), true), 0) END::BIGINT AS pos FROM w JOIN r ON r.project_id = w.project_id AND r.record_no = w.k + 1)),
  a AS (SELECT r.project_id, record_no, way, norm, translation, again, CASE WHEN pos > 0 THEN own[pos].id END AS found, CASE WHEN pos > 0 THEN pos END AS pos, CASE WHEN pos > 0 THEN own[pos].norm END AS now_norm FROM w JOIN r ON r.project_id = w.project_id AND r.record_no = w.k),
  found AS (SELECT project_id, record_no, found AS block_id, pos AS bubble, translation, CASE WHEN found IS NULL THEN CASE way WHEN 'source' THEN 'warning' ELSE 'error' END WHEN again THEN 'error' WHEN trim(translation) = '' THEN 'skip' WHEN norm <> '' AND norm <> now_norm THEN 'warning' ELSE 'ok' END AS status, found IS NOT NULL AND NOT again AND trim(translation) <> '' AS will_import FROM a)"""


def _found(t):
    b = _numbered(t)
    return intake.resolved_in_order(b.selectExpr(*split_list(_RECORD)), b)


def found_in_order(t):
    """Records of _RECORD, whose wording has a slip now and then."""
    b = _numbered(t)
    slips = F.when(F.col("record_no") % 4 == 1, F.concat("source", F.lit("x"))).otherwise(F.col("source"))
    return intake.resolved_in_order(b.selectExpr(*split_list(_RECORD)).withColumn("source", slips), b).drop("translation")


query("c11_resolved", f"WITH RECURSIVE {_FOUND} SELECT project_id, record_no, block_id, bubble, status, will_import FROM found")(lambda t: _found(t).drop("translation"))
query("c11_summary", f"WITH RECURSIVE {_FOUND} SELECT project_id, " + ", ".join(f"count(*) FILTER (status = '{k}') AS {k}" for k in ("ok", "warning", "error", "skip")) + ", count(*) AS total, count(*) FILTER (will_import) AS importable FROM found GROUP BY 1")(
    lambda t: exchange.import_summary(_found(t)))
query("k5_importable", f"WITH RECURSIVE {_FOUND} SELECT project_id, block_id, translation FROM found ANTI JOIN (SELECT DISTINCT project_id FROM found WHERE status = 'error') USING (project_id) WHERE will_import")(
    lambda t: exchange.importable(_found(t)).select("project_id", "block_id", "translation"))

query("b17_cleared", "SELECT block_id, '' AS translation, CASE WHEN block_index % 2 = 0 THEN 'kept,layout_region' ELSE 'layout_region' END AS keys FROM v_blocks")(
    lambda t: exchange.cleared(t.v_blocks.withColumn("metadata", F.expr("map('layout_region', 'r', 'semantic_role', balloon_type, CASE WHEN block_index % 2 = 0 THEN 'kept' ELSE 'ai_layout_text' END, 'v')")))
    .select("block_id", "translation", F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("keys")))
query("j9_tag_map", """WITH own AS (SELECT c_custkey AS project_id, CASE c_nationkey % 3 WHEN 0 THEN 't_soft' ELSE concat('x', c_nationkey) END AS template_id, CASE c_nationkey % 4 WHEN 0 THEN 'shout' WHEN 1 THEN ' ' ELSE c_mktsegment END AS label FROM customer)
  SELECT project_id, trim(label) AS label, template_id FROM own WHERE trim(label) <> '' AND NOT (template_id = 't_soft' AND label = 'shout')
  UNION ALL SELECT project_id, 'soft', 't_soft' FROM own WHERE template_id <> 't_soft' UNION ALL SELECT project_id, 'shout', 't_shout' FROM own WHERE label <> 'shout' OR template_id = 't_soft'""")(
    lambda t: exchange.tag_map([Row(template_id="t_soft", label="soft", ord=0), Row(template_id="t_shout", label="shout", ord=1)], t.customer.selectExpr(
        "c_custkey AS project_id", "CASE c_nationkey % 3 WHEN 0 THEN 't_soft' ELSE concat('x', c_nationkey) END AS template_id", "CASE c_nationkey % 4 WHEN 0 THEN 'shout' WHEN 1 THEN ' ' ELSE c_mktsegment END AS label", "0 AS ord")))
