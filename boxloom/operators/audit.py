"""Quality audit: one row per issue of a block or page, and roll-ups.

Blocks have source_text, translation, confidence, width, height, smart_width, smart_height and
font_size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import blank, strip

#: Thai vowel signs and tone marks that need a consonant before them.
FLOATING = "ัิีึืฺุู็่้๊๋์ํ๎"
#: Line height and letter width as shares of the font size, and the size where none is set.
LINE, LETTER, SIZE = 1.25, 0.55, 24.0
#: The share by which text may be larger than its box.
TOLERANCE = 0.15


def _measured(blocks: DataFrame) -> DataFrame:
    """Adds the lengths of the translation's lines; exploded from an array of one, so that rules do not each make them again."""
    lengths = F.filter(F.transform(F.split("translation", "\n"), lambda x: F.length(strip(x))), lambda n: n > 0)
    return blocks.withColumn("__lengths", F.explode(F.array(lengths)))


def overflow() -> Column:
    """By which share the translation's lines are taller, or its longest line wider, than the box; for blocks as ``_measured``.

    A smart side of more than 10 stands for the side of the box; null where there is no text or no box.
    """
    width = F.when(F.col("smart_width") > 10, F.col("smart_width")).otherwise(F.col("width"))
    height = F.when(F.col("smart_height") > 10, F.col("smart_height")).otherwise(F.col("height"))
    size = F.coalesce(F.nullif("font_size", F.lit(0.0)), F.lit(SIZE))
    lengths = F.col("__lengths")
    over = F.greatest((F.array_max(lengths) * (size * LETTER) - width) / width, (F.size(lengths) * (size * LINE) - height) / height)
    return F.when((F.size(lengths) > 0) & (width > 0) & (height > 0), over)


def rules() -> list[tuple[Column, str, str, Column]]:
    """(broken, code, severity, detail) of each rule on one block."""
    no_source, no_text, conf, none = blank(F.col("source_text")), blank(F.col("translation")), F.col("confidence"), F.lit("")
    percent = lambda c: F.floor(c * 100).cast("int").cast("string")
    return [
        (~no_source & no_text, "UNTRANSLATED_BUBBLE", "warning", none),
        (no_source & no_text, "EMPTY_BLOCK", "info", none),
        (~no_source & (conf > 0) & (conf < 0.45), "LOW_OCR_CONFIDENCE", "info", percent(conf)),
        (overflow() > TOLERANCE, "TEXT_OVERFLOW", "warning", percent(overflow())),
        (F.substring(strip(F.col("translation")), 1, 1).isin(*FLOATING), "THAI_FLOATING_DIACRITIC", "warning", none),
    ]


def block_issues(blocks: DataFrame) -> DataFrame:
    """page_id, block_id, code, severity, detail of each broken rule."""
    found = F.array(*[F.when(r, F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), d.alias("detail"))) for r, c, s, d in rules()])
    return _measured(blocks).select("page_id", "block_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("page_id", "block_id", "i.*")


def _bare() -> Column:
    return F.coalesce("inpainted_image_path", F.lit("")) == ""


def page_issues(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages with a translation and no cleaned image."""
    some = blocks.groupBy("page_id").agg(F.bool_or(~blank(F.col("translation"))).alias("translated")).where("translated")
    bare = pages.where(_bare()).join(some, "page_id")
    return bare.select("page_id", F.lit(None).cast("string").alias("block_id"), F.lit("MISSING_INPAINT_IMAGE").alias("code"), F.lit("warning").alias("severity"), F.lit("").alias("detail"))


def issues(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    return block_issues(blocks).unionByName(page_issues(blocks, pages))


def page_rollup(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page: blocks, issues by severity, is_clean.  Blocks are read and counted once."""
    level = lambda s: sum((F.count_if(F.coalesce(r, F.lit(False))) for r, _, severity, _ in rules() if severity == s), F.lit(0).cast("long"))
    n = _measured(blocks).groupBy("page_id").agg(F.count("*").alias("blocks"), level("error").alias("errors"), level("warning").alias("w"), level("info").alias("infos"), F.bool_or(~blank(F.col("translation"))).alias("translated"))
    out = pages.select("page_id", "project_id", _bare().alias("bare")).join(n, "page_id", "left").na.fill(0, ["blocks", "errors", "w", "infos"])
    warnings = F.col("w") + F.when(F.col("bare") & F.col("translated"), 1).otherwise(0)
    out = out.withColumn("warnings", warnings).withColumn("issues", F.col("errors") + F.col("warnings") + F.col("infos"))
    return out.select("page_id", "project_id", "blocks", "issues", "errors", "warnings", "infos", (F.col("issues") == 0).alias("is_clean"))


def project_rollup(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    p = page_rollup(blocks, pages)
    total = {c: F.sum(c).alias(c) for c in ("blocks", "issues", "errors", "warnings", "infos")}
    return p.groupBy("project_id").agg(F.count("*").alias("pages"), *total.values(), F.count_if("is_clean").alias("clean_pages"), F.count_if(~F.col("is_clean")).alias("pages_with_issues"))
