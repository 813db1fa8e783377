"""What remains to be done for each page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import blank

STAGES = ("detect", "ocr", "inpaint")


def stage_plan(blocks: DataFrame, pages: DataFrame, requested: tuple[str, ...] = STAGES) -> DataFrame:
    """page_id and its stages: only those that are requested and still needed, in order."""
    b = blocks.groupBy("page_id").agg(F.bool_or(blank(F.col("source_text"))).alias("open"))
    p = pages.select("page_id", "inpainted_image_path").join(b, "page_id", "left")
    need = {"detect": F.col("open").isNull(), "ocr": F.coalesce("open", F.lit(True)), "inpaint": F.col("inpainted_image_path").isNull()}
    steps = F.array(*[F.when(need[s], s) for s in STAGES if s in requested])
    return p.select("page_id", F.array_join(F.filter(steps, lambda s: s.isNotNull()), ",").alias("stages"))


def ocr_targets(blocks: DataFrame) -> DataFrame:
    """Per page the blocks without source text, or all where none lacks it."""
    per = blocks.groupBy("page_id").agg(F.count_if(blank(F.col("source_text"))).alias("open"))
    return blocks.join(per, "page_id").where((F.col("open") == 0) | blank(F.col("source_text"))).select("page_id", "block_id")


def kept_and_numbered(blocks: DataFrame) -> DataFrame:
    """Without wholly blank blocks, numbered again from 0."""
    some = blocks.where(~(blank(F.col("source_text")) & blank(F.col("translation"))))
    return some.select("page_id", "block_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("block_index", "block_id")) - 1).alias("number"))
