"""Translation memory: merge, export, look-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import blank, strip

KEY = ("source_text", "source_language", "target_language")


def merge(rows: DataFrame) -> DataFrame:
    """One entry per (trimmed source, languages): frequency, the last translation by seq, and the last
    project that is given (``project_id``, if rows have it).  Null and empty languages are Japanese and Thai."""
    r = rows.where(~blank(F.col("source_text")) & ~blank(F.col("translation"))).withColumns({"source_text": strip(F.col("source_text")), "translation": strip(F.col("translation"))})
    r = r.withColumns({"source_language": F.coalesce(F.nullif("source_language", F.lit("")), F.lit("ja")), "target_language": F.coalesce(F.nullif("target_language", F.lit("")), F.lit("th"))})
    project = [F.max_by("project_id", F.when(F.col("project_id").isNotNull(), F.struct("seq", "project_id"))).alias("project_id")] if "project_id" in rows.columns else []
    return r.groupBy(*KEY).agg(F.count("*").alias("frequency"), F.max_by("translation", F.struct("seq", "translation")).alias("translation"), F.max("seq").alias("last_seq"), *project)


def upsert(memory: DataFrame, rows: DataFrame) -> DataFrame:
    """The memory after the rows: frequencies add up, newer translations and given projects win."""
    new = merge(rows)
    if "project_id" in memory.columns and "project_id" not in new.columns:
        new = new.withColumn("project_id", F.lit(None).cast(memory.schema["project_id"].dataType))
    project = ["project_id"] if "project_id" in new.columns else []
    both = memory.select(*KEY, "frequency", "translation", "last_seq", *project).unionByName(new)
    last = [F.max_by("project_id", F.when(F.col("project_id").isNotNull(), F.col("last_seq"))).alias("project_id")] if project else []
    return both.groupBy(*KEY).agg(F.sum("frequency").alias("frequency"), F.max_by("translation", "last_seq").alias("translation"), F.max("last_seq").alias("last_seq"), *last)


def export(memory: DataFrame, source: str = "auto", target: str = "auto") -> DataFrame:
    for c, v in (("source_language", source), ("target_language", target)):
        memory = memory if v == "auto" else memory.where(F.col(c) == v)
    return memory.orderBy(F.desc("frequency"), *KEY)


def containing(entries: DataFrame, column: str, asked: DataFrame) -> DataFrame:
    """Entries whose column contains the query, ignoring case, once for each such query.

    They meet by pieces of up to three letters, never by comparing all with all: a query waits at the one of its
    pieces that the fewest entries hold.
    """
    pieces = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))
    m = entries.withColumn("low", F.lower(column))
    every = F.array_distinct(F.concat(*[F.when(F.length("low") >= n, pieces(F.col("low"), n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)]))
    m = m.withColumn("piece", F.explode(every))
    q = asked.withColumn("want", F.lower("query")).where(F.length("want") > 0)
    wanted = F.when(F.length("want") >= 3, pieces(F.col("want"), 3)).otherwise(F.array("want"))
    each = q.select("want").distinct().select("want", F.explode(wanted).alias("piece"))
    held = m.join(each.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
    # a piece that no entry holds rules its query out, so it counts as the rarest
    rarest = each.join(held, "piece", "left").groupBy("want").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))
    return m.join(q.join(rarest, "want"), "piece").where(F.contains("low", "want"))


def first_meaning(dictionary: DataFrame, asked: DataFrame) -> DataFrame:
    """Per query the meaning of the first entry (by ord) that contains it, or whose romaji it is.

    Equal spellings keep their first entry only, before they meet the queries.
    """
    first = lambda c: dictionary.groupBy(F.lower(c).alias(c)).agg(F.min(F.struct("ord", "meaning")).alias("first"))
    inside = containing(first("orig"), "orig", asked).select("query", "first")
    same = asked.join(first("romaji"), F.lower("query") == F.col("romaji")).select("query", "first")
    return inside.union(same).groupBy("query").agg(F.min("first").alias("f")).select("query", F.col("f.meaning").alias("meaning"))


def lookup(memory: DataFrame, asked: DataFrame, limit: int = 5) -> DataFrame:
    """Entries whose source contains the trimmed query, ignoring case; exact ones flagged.

    ``asked`` has query_id, query and perhaps source_language and target_language, of which null, an empty
    text and ``auto`` stand for any.
    """
    asked = asked.withColumn("query", strip(F.col("query")))
    kinds = [c for c in ("source_language", "target_language") if c in asked.columns]
    hit = containing(memory, "source_text", asked.withColumnsRenamed({c: f"__{c}" for c in kinds}))
    for c in kinds:
        hit = hit.where(F.coalesce(F.col(f"__{c}"), F.lit("")).isin("", "auto") | (F.col(c) == F.col(f"__{c}")))
    hit = hit.withColumn("exact", F.col("source_text") == F.col("query"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("frequency"), F.desc("last_seq"), *KEY))
    return hit.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", *KEY, "translation", "frequency", "exact")
