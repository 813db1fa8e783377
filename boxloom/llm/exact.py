"""Exact duplicates: skew-safe combining in two salted steps.

``group_copies`` first lets each task combine its own copies (Spark's partial aggregation),
then merges each (digest, salt) group, then the few salt winners of a digest.  The grouping
keys hold the whole normalised text at every step, so rows meet only when their full contents
are equal; the digest in front of it keeps comparisons short.  Documents then find their group
by digest alone, which is exact for every digest that stands for one content.  Digests that
stand for several (collisions) are joined on the whole content instead.  A digest that more than
one in ``HOT`` of all rows share (there are fewer than ``HOT`` such) is joined in ``SALTS`` parts.

Null texts count as empty.  Ties go to the smallest doc_id.  Rows whose doc_id is null lose
every tie and report a null keep_id only if nobody else is in their group.  Repeated rows are
separate members of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, checkpoint, text_or_empty

#: Copies of one content are merged in so many independent parts before they meet.
SALTS = 64
#: The share of all rows, as one in so many, from which a digest's rows are dealt to several tasks.
HOT = 1000


def normalised(col: Column) -> Column:
    return F.regexp_replace(col, SPACE + "+", "")


def sha256(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    text = text_or_empty(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), F.length(text).alias("len"), normalised(text).alias("norm"))
    return keyed.select("id", "len", digest(F.col("norm")).alias("digest"), "norm")


def group_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """One row for each distinct normalised content: digest, norm, best (len, id), n."""
    # the longest text, then the smallest id: order by (len, -id), nulls lowest
    best = F.max(F.struct("len", (-F.col("id")).alias("neg_id")))
    salted = (
        _keyed(docs, id_col, text_col, digest)
        .groupBy("digest", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"), "norm")
        .agg(best.alias("best"), F.count("*").alias("n"))
    )
    return salted.groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest, len.

    ``kept`` is true for exactly the rows that tie with the winner on (length, id).
    """
    groups = group_copies(docs, id_col, text_col, digest)
    winners = checkpoint(
        groups.select(
            "digest",
            (-F.col("best.neg_id")).alias("keep_id"),
            F.col("best.len").alias("keep_len"),
            F.col("n").alias("group_size"),
            F.xxhash64("norm").alias("h"),
        )
    )
    contents = winners.groupBy("digest").agg(F.count("*").alias("contents"), F.first("keep_id").alias("keep_id"), F.first("keep_len").alias("keep_len"), F.first("group_size").alias("group_size"))
    shared = contents.where("contents > 1")
    rows = _keyed(docs, id_col, text_col, digest)
    total = contents.agg(F.sum("group_size")).first()[0] or 0
    hot = F.broadcast(contents.where((F.col("contents") == 1) & (F.col("group_size") * HOT > total)).select(F.col("digest").alias("hot")))
    # which part a row falls in is of no account, since each part has the winner
    salt = F.when(F.col("hot").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = rows.select("id", "len", "digest").join(hot, F.col("digest") == F.col("hot"), "left").withColumn("salt", salt).drop("hot")
    parts = F.when(F.col("group_size") * HOT > total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    single = dealt.join(contents.where("contents = 1").drop("contents").withColumn("salt", F.explode(parts)), ["digest", "salt"]).drop("salt")
    if not shared.isEmpty():
        several = groups.join(shared.select("digest"), "digest", "left_semi").select(
            "digest", "norm", (-F.col("best.neg_id")).alias("keep_id"), F.col("best.len").alias("keep_len"), F.col("n").alias("group_size")
        )
        single = single.unionByName(rows.join(several, ["digest", "norm"]).drop("norm"))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("keep_len"))
    return single.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "digest", "len")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, one for each distinct normalised text.

    Rows that agree in id, length and content with the winner are repeats of it; the one with
    the smallest hash of all its columns stays.  Each task first combines its own repeats, and
    rows are dealt once, by keys that the winners share.
    """
    # nulls get a value of their own, so that grouping and join use one exchange
    i = [F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id"), F.col(id_col).isNull().alias("__null")]
    keys = ["__id", "__null", "__len", "__digest"]
    decided = exact_duplicates(docs, id_col, text_col).where("kept").select(*i, F.col("len").alias("__len"), F.col("digest").alias("__digest")).distinct()
    text = text_or_empty(text_col)
    hashed = F.xxhash64(*[c for c, t in docs.dtypes if "map<" not in t])
    rows = docs.select(*i, F.length(text).alias("__len"), sha256(normalised(text)).alias("__digest"), F.struct(*docs.columns).alias("__row"), hashed.alias("__hash"))
    one = rows.groupBy(*keys).agg(F.min_by("__row", "__hash").alias("__row"))
    return one.join(decided, keys, "left_semi").select("__row.*")
