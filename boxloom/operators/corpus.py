"""Splits, caps and de-duplication of corpora by page or project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def hash_share(c: Column) -> Column:
    """The first 12 hex digits of the md5 as a share of 16**12."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def split(c: Column) -> Column:
    u = hash_share(c)
    return F.when(u < 0.70, "train").when(u < 0.85, "dev").otherwise("test")


def exact_share(rows: DataFrame, key: str, share: float = 0.15, seed: str = "42") -> DataFrame:
    """Adds split: val for exactly floor(share * n) rows per project, by hash order, else train."""
    order = F.md5(F.concat_ws("-", F.lit(seed), F.col(key).cast("string")))
    w = Window.partitionBy("project_id")
    rank = F.row_number().over(w.orderBy(order, key))
    return rows.withColumn("split", F.when(rank <= F.floor(F.count("*").over(w) * share), "val").otherwise("train"))


def capped(rows: DataFrame, key: str, cap: int) -> DataFrame:
    """At most ``cap`` rows per project; round gives the interleaved order with the project."""
    return rows.withColumn("round", F.row_number().over(Window.partitionBy("project_id").orderBy(key))).where(F.col("round") <= cap)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r"), F.min(order).alias("position")).select("r.*", "position")


def manifest(blocks: DataFrame, types: tuple[str, ...] | None = None, limit: int | None = None) -> DataFrame:
    """Valid boxes with record_id, rivals and split; positions and rivals count boxes of every type on the page.

    ``blocks`` carry their page's project_id.  ``types`` keeps some balloon types only, ``limit`` the first records
    by project, page and position.
    """
    page = Window.partitionBy("page_id")
    at = F.row_number().over(page.orderBy("block_index", "block_id")) - 1
    valid = blocks.withColumn("__at", at).where((F.col("width") > 0) & (F.col("height") > 0))
    project = F.col("project_id").cast("string")
    records = valid.withColumns({
        "record_id": F.format_string("%s_%s_b%03d", F.substring(project, 1, 12), F.col("page_id").cast("string"), F.col("__at")),
        "rivals": F.count("*").over(page) - 1, "split": split(F.col("project_id")),
    })
    records = records if types is None else records.where(F.coalesce("balloon_type", F.lit("bubble")).isin(*types))
    records = records if limit is None else records.orderBy("project_id", "page_id", "__at").limit(limit)
    return records.drop("__at")


def manifest_counts(records: DataFrame) -> DataFrame:
    """Records by split and by type: kind (split or type), value, records."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("split", "split"), ("type", "balloon_type"))])
    return records.select(F.inline(kinds)).groupBy("kind", "value").agg(F.count("*").alias("records"))
