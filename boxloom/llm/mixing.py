"""Mixing sources to target weights along a low-discrepancy schedule.

The golden-ratio sequence u_j = frac((j+1)/phi) is mapped through the cumulative target shares,
so that slot j names a source and any run of slots holds the sources in proportion.  A source's
documents lie in a fixed shuffled order, end to end, repeated for at most ``MAX_EPOCHS`` epochs,
and are cut into blocks of ``BLOCK`` words; the k-th slot of a source takes its k-th block.  A
source leaves the schedule when its target is met; blocks that a source still lacks when the
sequence ends follow in slots after it.  Only DataFrame functions are used.

Hot sources: positions within a source are two-level prefix sums, over buckets of the shuffle
order (aggregated before they meet) and inside one (source, bucket), so that no task sees a
whole source.  Slot ranks are found in the same way over runs of slots.

Null texts have size 0 and take no words.  A null source is a source of its own, after all
others.  Repeated rows are separate documents that share a place in the shuffled order.  An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, checkpoint, prefix_sums

#: Words in a block.
BLOCK = 64
#: No document is used more often than this.
MAX_EPOCHS = 3
#: The weights of the sources in code-point order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: 1/phi, and frac(2**20 / phi): two factors keep u_j exact for long schedules.
GOLDEN = 0.6180339887498949
GOLDEN_20 = (2**20 * 11400714819323198485 % 2**64) / 2**64
#: Hex digits of the shuffle key that make a bucket.
BUCKET_DIGITS = 3
#: Grid cells of the unit interval.
GRID = 4096
#: Slots in one run.
RUN = 1 << 16


def words(col: str) -> Column:
    """How many runs of other characters than the six white-space ones."""
    # a run begins where a non-space character follows a space or the start
    return F.coalesce(F.regexp_count(F.col(col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> also place, weight, target, and the bounds lo, hi of its share.

    Shares go by weight, but none above ``max_epochs`` times its source's size; what is over is
    shared again among the others.  Sorted by cap over weight the capped sources are a prefix,
    so running sums give the fixed point at once.  The windows run over one row per source.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", weight)
    s = s.withColumn("cap", F.col("source_size").cast("double") * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("ratio", "place")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0))).cast("double")
    # the level if exactly the sources before this one are capped
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("total", total).withColumn("level", level)
    # the first source whose cap is not below its level sets it for all that follow
    s = s.withColumn("final", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "place", "level"))).over(Window.partitionBy(F.lit(0)))["level"])
    target = F.when(F.col("ratio") <= F.col("final"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("final")))
    s = s.withColumn("target", F.coalesce(target, F.col("cap")))
    upto = Window.partitionBy(F.lit(0)).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.greatest(F.sum("target").over(Window.partitionBy(F.lit(0))), F.lit(1e-300))
    s = s.withColumn("hi", F.sum("target").over(upto) / whole)
    by_place = Window.partitionBy(F.lit(0)).orderBy("place")
    # each share begins where the one before ends, and the last is open above
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(by_place), F.lit(0.0)))
    s = s.withColumn("hi", F.when(F.lead("hi").over(by_place).isNull(), F.lit(2.0)).otherwise(F.col("hi")))
    return s.select("source", "place", "source_size", "weight", "target", "lo", "hi", "total")


def schedule(spark, shares: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, place, rank: the source of each slot, and the how-manieth slot of it this is.

    Every source has a slot for each block of its target: small shares may hold no, or too few,
    points of the sequence, so what they lack is appended, one source after the other.

    ``shares`` has one row per source.  Slots find their share by an equality join on a grid
    cell of u, over which they spread evenly whatever the shares are.
    """
    head = shares.agg(F.ceil(F.max("total") / block).alias("blocks"), F.count("*").alias("sources")).first()
    length = int(head["blocks"] or 0) + 4 * head["sources"]
    slots = spark.range(length).withColumnRenamed("id", "slot")
    j = F.col("slot") + 1
    x = F.shiftright(j, 20) * GOLDEN_20 + (j % (1 << 20)) * GOLDEN
    slots = slots.select("slot", (x - F.floor(x)).alias("u")).withColumn("cell", F.floor(F.col("u") * GRID))
    last = F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1))
    cells = shares.where("lo < hi").select("place", "lo", "hi", F.explode(F.sequence(F.least(F.floor(F.col("lo") * GRID), F.lit(GRID - 1)), last)).alias("cell"))
    slots = slots.join(cells, "cell").where("lo <= u and u < hi").select("slot", "place", F.floor(F.col("slot") / RUN).alias("run"))
    runs = checkpoint(slots.groupBy("place", "run").agg(F.count("*").alias("n")))
    before = prefix_sums(runs, ["place"], "run", "n", "before")
    ranked = slots.withColumn("in_run", F.row_number().over(Window.partitionBy("place", "run").orderBy("slot")) - 1)
    ranked = ranked.join(before.drop("n"), ["place", "run"]).select("slot", "place", (F.col("before") + F.col("in_run")).alias("rank"))
    have = F.coalesce("have", F.lit(0))
    need = F.ceil(F.floor(F.col("target") + 0.5) / block)
    short = shares.join(runs.groupBy("place").agg(F.sum("n").alias("have")), "place", "left").select("place", have.alias("have"), need.alias("need")).where("have < need")
    # one row per source
    earlier = Window.partitionBy(F.lit(0)).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    short = short.withColumn("at", F.coalesce(F.sum(F.col("need") - F.col("have")).over(earlier), F.lit(0)) + length)
    more = short.select("place", "have", "at", F.explode(F.sequence("have", F.col("need") - 1)).alias("rank"))
    return ranked.unionByName(more.select((F.col("at") + F.col("rank") - F.col("have")).alias("slot"), "place", "rank"))


def placed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, size, and the document's first word in its source's shuffled stream."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(text_col).alias("size"), F.xxhash64(text_col).alias("text_hash"), key.alias("key"))
    d = checkpoint(d.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)))
    before = prefix_sums(d.groupBy("source", "bucket").agg(F.sum("size").alias("n")), ["source"], "bucket", "n", "before")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = d["source"].eqNullSafe(before["source"]) & (d["bucket"] == before["bucket"])
    return d.join(before.drop("n"), same).select("id", d["source"], "size", "text_hash", (F.col("before") + F.col("inside")).alias("start"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, max_epochs: int = MAX_EPOCHS, weights=WEIGHTS):
    """The documents with their targets, and the pieces that the schedule takes of them.

    Returns (docs, pieces): docs has id, source, size, place, source_size, target, start;
    pieces has slot, place, rank, start (of the document), epoch, id, words.
    """
    spark = docs.sparkSession
    d = checkpoint(placed(docs, id_col, text_col, source_col))
    shares = checkpoint(targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs))
    # one row per source: small by the count of sources
    t = shares.select(F.col("source").alias("src"), "place", "source_size", "target")
    d = d.join(t, d["source"].eqNullSafe(t["src"])).drop("src")
    stop = F.floor(F.col("target") + 0.5).cast("long")
    # a document's words lie at start + epoch * source_size; cut that at block bounds and the target
    e = (
        d.where("size > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
        .withColumn("from", F.col("start") + F.col("epoch") * F.col("source_size"))
        .withColumn("to", F.least(F.col("from") + F.col("size"), stop))
        .where("from < to")
    )
    e = e.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    cut = F.least("to", (F.col("rank") + 1) * block) - F.greatest("from", F.col("rank") * block)
    pieces = e.select("id", "place", "rank", "start", "epoch", "size", cut.cast("long").alias("words"))
    slots = schedule(spark, shares, block)
    return d, pieces.join(slots, ["place", "rank"])


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words, repeats counted)."""
    d, pieces = mix(docs, id_col, text_col, source_col, **kw)
    # repeated rows have a place each in the stream, so (place, start, size) tells documents apart
    got = pieces.groupBy("place", "start", "size").agg(F.sum("words").alias("got"))
    out = d.join(got, ["place", "start", "size"], "left")
    return out.select(F.col("id").alias(id_col), "source", "size", "text_hash", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The input's columns; each document as often as the mix takes it.

    That is the words taken over its size, rounded: all but one document of a source are taken
    whole.  Rows that agree in id, source and text share evenly, rounded up.
    """
    t = taken(docs, id_col, text_col, source_col, **kw)
    times = F.floor(F.sum("taken") / F.max("size") + 0.5)
    t = t.where("size > 0").groupBy(F.col(id_col).alias("__id"), F.col("source").alias("__source"), F.col("text_hash").alias("__hash")).agg(F.ceil(times / F.count("*")).cast("int").alias("__times"))
    rows = docs.withColumn("__text", F.xxhash64(text_col))
    same = rows[id_col].eqNullSafe(t["__id"]) & rows[source_col].eqNullSafe(t["__source"]) & (rows["__text"] == t["__hash"])
    return rows.join(t.where("__times > 0"), same).withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
