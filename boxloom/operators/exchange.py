"""Exchange files: annotation snapshots, project documents, text export and tab-separated import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from ..functions.text import THAI, blank, squeezed, strip, trailing_tag
from .lines import LAYOUT

#: The marks in front of source and translation.
SOURCE_MARK, TRANSLATION_MARK = "[คำต้นฉบับ]: ", "[คำแปลไทย]: "
#: What a restored block has where the document says nothing.
DEFAULTS = {"x": 0.0, "y": 0.0, "width": 100.0, "height": 50.0, "rotation_deg": 0.0, "font_family": "NotoSansThai", "font_size": 20.0, "text_color": "#000000", "direction": "horizontal", "alignment": "center", "balloon_type": "bubble", "confidence": 1.0}
BLOCK = "struct<block_id:string,block_index:int," + ",".join(f"{k}:{'double' if isinstance(v, float) else 'string'}" for k, v in DEFAULTS.items()) + ",source_text:string,translation:string>"


def snapshot(blocks: DataFrame) -> DataFrame:
    """page_id and balloons: the page's boxes in order, as JSON of id, bbox, type and confidence."""
    item = F.struct("block_id", F.array("x", "y", "width", "height").alias("bbox"), F.col("balloon_type").alias("type"), "confidence")
    row = F.struct("block_index", F.col("block_id").alias("id"), item.alias("item"))
    per = blocks.groupBy("page_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return per.select("page_id", F.to_json(F.transform("rows", lambda r: r["item"])).alias("balloons"))


def read_snapshot(pages: DataFrame) -> DataFrame:
    """The boxes of snapshots with their position; pages without boxes go."""
    kind = "array<struct<block_id:string,bbox:array<double>,type:string,confidence:double>>"
    b = pages.select("page_id", F.posexplode(F.from_json("balloons", kind)).alias("idx", "b"))
    return b.select("page_id", "idx", "b.block_id", *[F.get("b.bbox", F.lit(k)).alias(n) for k, n in enumerate(("x", "y", "width", "height"))], F.col("b.type").alias("balloon_type"), "b.confidence")


def document(blocks: DataFrame) -> DataFrame:
    """page_id and document: the page's blocks in order as JSON, without null fields."""
    b = blocks.withColumn("__item", F.struct("block_index", F.col("block_id"), *[c for c in blocks.columns if c in DEFAULTS or c in ("source_text", "translation")]))
    per = b.groupBy("page_id").agg(F.array_sort(F.collect_list("__item")).alias("items"))
    return per.select("page_id", F.to_json("items").alias("document"))


#: What a project's document says of a page and of a block, in order.
PAGE_FIELDS = ("page_number", "name", "width", "height", "source_image_path", "inpainted_image_path", "rendered_image_path", "status")
BLOCK_FIELDS = ("block_index", "x", "y", "width", "height", "rotation_deg", "source_text", "translation", "font_family", "font_size", "color_hex", "bold", "italic", "text_direction", "text_align", "balloon_type", "confidence")


def project_documents(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """project_id and document: its pages in order, each with its blocks in order, as JSON with null fields.

    Fields that the tables lack are left out; a null ``extra_metadata`` (a map) is written as an empty one.  A task
    gathers one project, since that is one document.
    """
    said = lambda df, names: [F.col(c) for c in names if c in df.columns]
    none = F.create_map().cast("map<string,string>")
    more = [F.coalesce("extra_metadata", none).alias("extra_metadata")] if "extra_metadata" in blocks.columns else []
    block = F.struct(F.col("block_id").alias("id"), *said(blocks, BLOCK_FIELDS), *more)
    page = lambda *texts: F.struct(F.col("page_id").alias("id"), *said(pages, PAGE_FIELDS), *texts)
    number = "page_number" if "page_number" in pages.columns else "id"

    def in_order(items: Column, first: str) -> Column:
        # maps have no order, so items are ordered by their number and id alone
        at = lambda item: F.struct(item[first], item["id"])
        return F.array_sort(items, lambda a, b: F.when(at(a) < at(b), -1).when(at(a) > at(b), 1).otherwise(0))

    # dealt as they are: lists that each reader had gathered would be larger, and sorted by page on its disk
    dealt = blocks.select("page_id", "block_id", *said(blocks, BLOCK_FIELDS), *[c for c in ("extra_metadata",) if more]).repartition("page_id")
    per_page = dealt.groupBy("page_id").agg(in_order(F.collect_list(block), "block_index").alias("text_blocks"))
    p = pages.join(per_page, "page_id", "left")
    nothing = F.array().cast(per_page.schema["text_blocks"].dataType)
    p = p.select("project_id", page(F.coalesce("text_blocks", nothing).alias("text_blocks")).alias("page")).repartition("project_id")
    per = p.groupBy("project_id").agg(in_order(F.collect_list("page"), number).alias("pages"))
    return per.select("project_id", F.to_json(F.struct(F.col("project_id").alias("id"), "pages"), {"ignoreNullFields": "false"}).alias("document"))


def read_snapshot_files(spark: SparkSession, glob: str) -> DataFrame:
    """path, project_id, page_id, image and balloons (JSON, for ``read_snapshot``) of the snapshot files.

    Files that are no JSON are left out, as are pages without an image or boxes.  A file that names no project
    is of the project whose folder holds the file's folder.
    """
    box = "struct<block_id:string,bbox:array<double>,type:string,confidence:double>"
    schema = f"project_id string, pages array<struct<page_id:string,image:string,balloons:array<{box}>>>, __bad string"
    f = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "__bad").json(glob)
    f = f.select(F.col("_metadata.file_path").alias("path"), "*").where("__bad is null")
    own = F.coalesce("project_id", F.get(F.reverse(F.split("path", "/")), F.lit(2)))
    p = f.select("path", own.alias("project_id"), F.explode("pages").alias("p")).where("p.image <> '' and size(p.balloons) > 0")
    return p.select("path", "project_id", "p.page_id", "p.image", F.to_json("p.balloons").alias("balloons"))


def restore(documents: DataFrame, existing: DataFrame) -> DataFrame:
    """Blocks of documents, with defaults where they say nothing; ids that exist already are issued anew.

    A new id is the digest of page and old id, so that a repeated restore gives the same.
    """
    b = documents.select("page_id", F.posexplode(F.from_json("document", f"array<{BLOCK}>")).alias("idx", "b"))
    known = existing.select("block_id").distinct().withColumn("__known", F.lit(True))
    b = b.select("page_id", "idx", F.col("b.block_id").alias("block_id"), "b").join(known, "block_id", "left")
    anew = F.col("__known").isNotNull() | F.col("block_id").isNull()
    fields = [F.coalesce(F.col(f"b.{k}"), F.lit(v)).alias(k) for k, v in DEFAULTS.items()]
    issued = F.md5(F.concat_ws("/", F.col("page_id").cast("string"), F.col("idx").cast("string"), "block_id"))
    return b.select("page_id", F.when(anew, issued).otherwise(F.col("block_id")).alias("block_id"), F.coalesce("b.block_index", F.lit(1)).alias("block_index"), *fields, F.coalesce("b.source_text", F.lit("")).alias("source_text"), F.coalesce("b.translation", F.lit("")).alias("translation"))


def export_text(blocks: DataFrame, mode: str, tags: dict[str, str]) -> DataFrame:
    """project_id, bubble and text: one entry for each block, in the project's order.

    Entries stay rows, so that a project of any size is written by sorting within partitions;
    a reader joins them by line breaks.  ``blocks`` carry their page's project_id, and for the mode ai_layout
    the column layout, a line on how the text is laid out.
    """
    if mode not in ("ocr", "translation", "both", "ai_layout"):
        raise ValueError(f"unknown export mode: {mode}")
    flat = F.translate(F.coalesce("source_text", F.lit("")), "\r\n", "  ")
    bubble = F.row_number().over(Window.partitionBy("project_id").orderBy("page_id", "block_index", "block_id"))
    b = blocks.withColumn("bubble", bubble)
    if mode == "ocr":
        return b.select("project_id", "bubble", F.concat(F.lit("//"), strip(flat)).alias("text"))
    told = trailing_tag(F.col("translation"), tags)["text"]
    if mode == "ai_layout":
        one = F.replace(F.replace(told, F.lit("\r\n"), F.lit(" ")), F.lit("\n"), F.lit(" "))
        return b.select("project_id", "bubble", F.concat_ws("\n", flat, "layout", F.nullif(one, F.lit("")), F.lit("")).alias("text"))
    lines = [F.concat(F.lit("# Bubble "), F.col("bubble").cast("string"))]
    if mode == "both":
        lines.append(F.concat(F.lit(SOURCE_MARK), flat))
    lines.append(F.concat(F.lit(TRANSLATION_MARK), told))
    return b.select("project_id", "bubble", F.concat_ws("\n", *lines, F.lit("")).alias("text"))


def read_tabs(lines: DataFrame) -> DataFrame:
    """Records of tab-separated lines: block_id, source, translation, position, error.

    Four columns or more hold an id in the second and a source in the third, two hold source and
    translation, whose position counts the file's records so far; any other number is an error
    that names the line.  Blank lines and those that start with # are no records.
    """
    t = lines.where((strip(F.col("line")) != "") & ~F.startswith(strip(F.col("line")), F.lit("#"))).withColumn("c", F.split("line", "\t"))
    n = F.size("c")
    good = (n >= 4) | (n == 2)
    so_far = F.sum(F.when(good, 1).otherwise(0)).over(Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    source = strip(F.when(n >= 4, F.get("c", F.lit(2))).when(n == 2, F.get("c", F.lit(0))))
    told = F.when(n >= 4, F.array_join(F.slice("c", F.lit(4), F.greatest(n, F.lit(4)) - 3), "\t")).when(n == 2, F.get("c", F.lit(1)))
    return t.select(
        "file_id", "line_no", F.when(n >= 4, strip(F.get("c", F.lit(1)))).alias("block_id"), F.nullif(source, F.lit("")).alias("source"), strip(F.replace(told, F.lit("\\n"), F.lit("\n"))).alias("translation"),
        F.when(n == 2, so_far).alias("position"), F.when(~good, F.concat(F.lit("line "), (F.col("line_no") + 1).cast("string"), F.lit(": expected 2 or 4 columns"))).alias("error"),
    )


def read_labelled(lines: DataFrame) -> DataFrame:
    """Records of labelled lines: file_id, line_no, block_id, bubble, source, translation, layout.

    ``# ID:`` or ``# Bubble n`` opens a record.  The last source mark gives the source.  The
    translation starts at the last translation mark, or else below the first mark, and goes on with
    each further line that is neither blank, comment, mark nor layout line.  The last layout line is kept.
    """
    s, is_kind = F.col("s"), lambda *k: F.col("kind").isin(*k)
    by_id, by_bubble = F.startswith(s, F.lit("# ID:")), F.startswith(s, F.lit("#")) & F.regexp_like(s, F.lit(r"(?i)^#\s*Bubble\s+\d+"))
    is_source, is_told = F.startswith(s, F.lit("[คำต้นฉบับ]:")), F.startswith(s, F.lit("[")) & F.regexp_like(s, F.lit(r"^\[(คำแปลไทย|คำแปล)\]:"))
    kind = (
        F.when(by_id, "id").when(by_bubble, "bubble").when(is_source, "source").when(is_told, "translation")
        .when(F.startswith(s, F.lit("[[")) & F.regexp_like(s, F.lit(LAYOUT)), "layout").when((s == "") | F.startswith(s, F.lit("#")), "none").otherwise("plain")
    )
    # each line is sorted with the one text that counts; empty lines do not count, and are told without a look at their kind
    said = F.when(is_kind("plain"), F.col("line")).when(is_kind("bubble"), F.regexp_extract(s, r"(\d+)", 1)).when(is_kind("layout"), s).when(~is_kind("none"), strip(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)))
    r = lines.where("line <> ''").withColumn("s", strip(F.col("line"))).withColumn("kind", kind).select("file_id", "line_no", "kind", said.alias("said"))
    before = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    opens, marks = is_kind("id", "bubble"), is_kind("source", "translation")
    # one sort: a record and whether it has had a mark are known from the lines before
    r = r.withColumns({"record": F.count_if(opens).over(before), "opened": F.max(F.when(opens, F.col("line_no"))).over(before), "marked": F.max(F.when(marks, F.col("line_no"))).over(before)})
    r = r.where("record > 0 AND kind <> 'none'").where(~is_kind("plain") | (F.col("marked") > F.col("opened")))
    of = lambda *k: F.when(is_kind(*k), F.col("line_no"))
    per = r.groupBy("file_id", "record").agg(
        F.min(of("id", "bubble")).alias("line_no"),
        F.max(F.when(is_kind("id"), F.col("said"))).alias("block_id"),
        F.max(F.when(is_kind("bubble"), F.col("said").cast("int"))).alias("bubble"),
        F.max_by("said", of("source")).alias("source"),
        F.max(of("translation")).alias("told_at"),
        F.array_sort(F.collect_list(F.when(is_kind("translation", "plain"), F.struct("line_no", F.col("said").alias("t"))))).alias("told"),
        F.max_by("said", of("layout")).alias("layout"),
    )
    told = F.filter("told", lambda x: F.col("told_at").isNull() | (x["line_no"] >= F.col("told_at")))
    text = strip(F.array_join(F.transform(told, lambda x: x["t"]), "\n"))
    return per.select("file_id", "line_no", "block_id", "bubble", F.nullif("source", F.lit("")).alias("source"), text.alias("translation"), "layout")


def judged_records(every: DataFrame, strict: bool = False) -> DataFrame:
    """Status and will_import of records with what they found.

    ``every`` has project_id, record_no, way (id, source or bubble), norm, translation, target, found, at, now_norm
    and again (an earlier record took the block).
    """
    differs = (F.col("norm") != "") & (F.col("norm") != F.col("now_norm"))
    foreign = F.startswith(F.lower("target"), F.lit("th")) & ~F.regexp_like("translation", F.lit(THAI))
    lost, told = F.col("found").isNull(), ~blank(F.col("translation"))
    status = (
        F.when(lost & (F.col("way") == "source"), "warning").when(lost | F.col("again"), "error").when(differs & F.lit(strict), "error")
        .when(~told, "skip").when(differs | F.coalesce(foreign, F.lit(False)), "warning").otherwise("ok")
    )
    goes = ~lost & ~F.col("again") & told & ~F.coalesce(foreign, F.lit(False)) & ~(differs & F.lit(strict))
    return every.select("project_id", "record_no", F.col("found").alias("block_id"), F.col("at").alias("bubble"), "translation", status.alias("status"), goes.alias("will_import"))


def importable(found: DataFrame) -> DataFrame:
    """The records to import: none of a project with any error.  The records are made once; only what can decide is brought together."""
    kept = found.where("will_import or status = 'error'")
    bad = F.bool_or(F.col("status") == "error").over(Window.partitionBy("project_id"))
    return kept.withColumn("__bad", bad).where("will_import and (project_id is null or not __bad)").drop("__bad")


def import_summary(found: DataFrame) -> DataFrame:
    kinds = [F.count_if(F.col("status") == k).alias(k) for k in ("ok", "warning", "error", "skip")]
    return found.groupBy("project_id").agg(*kinds, F.count("*").alias("total"), F.count_if("will_import").alias("importable"))


#: What goes when a block's translation is cleared.
LAYOUT_KEYS = ("typesetting_spec", "suggested_spec_id", "suggested_spec_revision", "suggested_explicit_lines", "suggested_template_id", "text_template_id", "manual_font_size")
LINE_KEYS = ("line_break_source", "ai_preferred_lines", "ai_layout_hint", "ai_layout_text")
SEMANTIC_KEYS = ("semantic_role", "semantic_role_label", "semantic_role_source", "semantic_role_tag", "semantic_role_confidence", "semantic_role_raw_translation", "semantic_role_template_id")


def cleared(blocks: DataFrame) -> DataFrame:
    """Blocks without translation and without its keys in the map ``metadata``."""
    gone = LAYOUT_KEYS + LINE_KEYS + SEMANTIC_KEYS
    return blocks.withColumns({"translation": F.lit(""), "metadata": F.map_filter("metadata", lambda k, v: ~k.isin(*gone))})


def tag_map(builtin: list[Row], own: DataFrame) -> DataFrame:
    """label and template_id per project: its own templates replace those of the same id and win a label.

    ``builtin`` is the library's short list of template_id, label, ord; ``own`` has project_id too.  Of equal labels the last wins,
    where a replaced template keeps its place.
    """
    few = F.array(*[F.struct(F.lit(r.template_id).alias("template_id"), F.lit(r.label).alias("base"), F.lit(r.ord).alias("base_ord")) for r in builtin])
    every = own.select("project_id").distinct().select("project_id", F.inline(few))
    both = every.join(own, ["project_id", "template_id"], "full")
    place = F.struct(F.col("base_ord").isNull().alias("new"), F.coalesce("base_ord", "ord").alias("ord"), "template_id")
    label = strip(F.when(F.col("ord").isNotNull(), F.coalesce("label", F.lit(""))).otherwise(F.col("base")))
    rows = both.select("project_id", label.alias("label"), "template_id", place.alias("place")).where("label <> ''")
    return rows.groupBy("project_id", "label").agg(F.max_by("template_id", "place").alias("template_id"))
