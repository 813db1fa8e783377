"""Aggregation of benchmark rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Ranges into which a group's values are dealt to find its quantiles.
RANGES = 1024
#: What rows may measure besides mask_iou.
MEASURES = ("precision", "utilization", "containment")


def scored() -> Column:
    return F.col("success") & F.col("has_gt")


def quantiles(values: DataFrame, asked: dict[str, float]) -> DataFrame:
    """s, and per name in ``asked`` the exact quantile of x in the group s, linear between neighbours.

    No group is gathered: values are counted in equal ranges, the ranges that hold the wanted ranks are found from
    these counts, and only values of these ranges are then counted one by one.
    """
    v = values.where("x is not null")
    ends = v.groupBy("s").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    share = F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RANGES)
    v = v.join(ends, "s").withColumn("range", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(RANGES - 1), share)).otherwise(0).cast("int"))
    per = v.groupBy("s", "n", "range").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = [(name, p * (F.col("n") - 1)) for name, p in asked.items()]
    ranks = [F.struct(F.lit(name).alias("name"), (F.floor(x) + k).alias("rank"), (x - F.floor(x) if k else 1 - (x - F.floor(x))).alias("weight")) for name, x in at for k in (0, 1)]
    wanted = per.withColumn("before", before).select("s", "range", "before", "held", F.inline(F.array(*ranks)))
    wanted = wanted.where((F.col("weight") > 0) & (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("held")))
    near = v.join(wanted.select("s", "range").distinct(), ["s", "range"], "left_semi").groupBy("s", "range", "x").agg(F.count("*").alias("c"))
    near = near.withColumn("upto", F.sum("c").over(Window.partitionBy("s", "range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    place = F.col("rank") - F.col("before")
    hit = near.join(wanted, ["s", "range"]).where((place < F.col("upto")) & (place >= F.col("upto") - F.col("c")))
    return hit.groupBy("s").agg(*[F.sum(F.when(F.col("name") == name, F.col("x") * F.col("weight"))).alias(name) for name in asked])


def rollup(rows: DataFrame) -> DataFrame:
    """Scopes overall, engine, engine and type, engine and archetype (successes), engine and split.

    Means of the ``MEASURES`` that rows have are given too.
    """
    scope = lambda name, engine, value: F.struct(F.lit(name).alias("scope"), engine.alias("engine"), value.alias("value"))
    none, e = F.lit(None).cast("string"), F.col("engine")
    scopes = F.array(scope("overall", none, none), scope("engine", e, none), scope("type", e, F.col("balloon_type")), scope("split", e, F.col("split")), F.when(F.col("success"), scope("archetype", e, F.col("archetype"))))
    return _grouped(rows, scopes)


def _grouped(rows: DataFrame, scopes: Column) -> DataFrame:
    more = [m for m in MEASURES if m in rows.columns]
    each = rows.select("success", "has_gt", "mask_iou", "elapsed_ms", *more, F.explode(F.filter(scopes, lambda s: s.isNotNull())).alias("s"))
    mean = lambda c: F.round(F.avg(F.when(scored(), F.col(c))), 6)
    stats = each.groupBy("s").agg(
        F.count("*").alias("n"), F.count_if(scored()).alias("n_scored"), F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"),
        mean("mask_iou").alias("mean_iou"), *[mean(m).alias(f"mean_{m}") for m in more])
    iou = quantiles(each.select("s", F.when(scored(), F.col("mask_iou")).alias("x")), {"median_iou": 0.5})
    late = quantiles(each.select("s", F.col("elapsed_ms").alias("x")), {"p50": 0.5, "p95": 0.95})
    both = stats.join(iou, "s", "left").join(late, "s", "left")
    late_cols = [F.round(F.coalesce(p, F.lit(0.0)), 6).alias(p) for p in ("p50", "p95")]
    return both.select("s.*", *stats.drop("s").columns, F.round("median_iou", 6).alias("median_iou"), *late_cols)


def failure_reasons(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("success")).groupBy("engine", F.coalesce("fallback_reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))


def top_reason(rows: DataFrame) -> DataFrame:
    f = failure_reasons(rows)
    return f.groupBy("engine").agg(F.max_by("reason", F.struct("n", "reason")).alias("reason"), F.max("n").alias("n"))


def pivoted(rows: DataFrame, by: str, engines: list[str]) -> DataFrame:
    """One column per engine: the scored rows' mean."""
    return rows.groupBy(by).pivot("engine", engines).agg(F.round(F.avg(F.when(scored(), F.col("mask_iou"))), 6))


def counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if(scored()).alias("scored"))


def worst(rows: DataFrame, k: int = 10) -> DataFrame:
    return rows.where(scored()).orderBy("mask_iou", "record_id", "engine").limit(k).select("record_id", "engine", "mask_iou")


def tier(score: Column) -> Column:
    return F.when(score >= 0.85, "HIGH").when(score >= 0.70, "MEDIUM").otherwise("LOW")


def tier_counts(rows: DataFrame) -> DataFrame:
    n = rows.groupBy(tier(F.col("mask_iou")).alias("tier")).agg(F.count("*").alias("n"))
    return n


def sweep(rows: DataFrame, param: str) -> DataFrame:
    high = F.when(tier(F.col("mask_iou")) == "HIGH", F.col("elapsed_ms"))
    return rows.groupBy(param).agg(F.round(F.avg("elapsed_ms"), 6).alias("mean_all"), F.round(F.avg(high), 6).alias("mean_high"))
