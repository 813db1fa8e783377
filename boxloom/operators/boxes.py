"""Box operators: gates, joins within a page, tiles, label lines, and reading order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as g

BOX = ("x", "y", "width", "height")


def _box(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in BOX}


def size_gate(blocks: DataFrame, width: float = 30, height: float = 25, area: float = 800) -> DataFrame:
    return blocks.where((F.col("width") >= width) & (F.col("height") >= height) & (F.col("width") * F.col("height") >= area))


def on_pages(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks with their page's project and size (page_width, page_height)."""
    p = pages.select("page_id", "project_id", F.col("width").alias("page_width"), F.col("height").alias("page_height"))
    return blocks.join(p, "page_id")


def expanded(blocks: DataFrame) -> DataFrame:
    """Bubbles grow by 2 pixels, other kinds by 3 % and 10 pixels."""
    snug = F.col("balloon_type").isin("balloon", "bubble")
    ratio, pad = F.when(snug, 1.0).otherwise(1.03), F.when(snug, 2.0).otherwise(10.0)
    return blocks.withColumns(g.expand(_box(), F.col("page_width"), F.col("page_height"), ratio, pad))


def with_margin(blocks: DataFrame, by: float = 10) -> DataFrame:
    """Only expands; unknown page sizes count as 2000 by 3000."""
    width, height = F.coalesce("page_width", F.lit(2000)), F.coalesce("page_height", F.lit(3000))
    return blocks.withColumns(g.margin(_box(), width, height, by))


def gate_reason(blocks: DataFrame) -> DataFrame:
    """Adds reason: why a box is dropped from a corpus, or null."""
    small = (F.col("width") < 18) | (F.col("height") < 18)
    whole = (F.col("width") > 0.97 * F.col("page_width")) & (F.col("height") > 0.97 * F.col("page_height"))
    return blocks.withColumn("reason", F.when(small, "too_small").when(whole, "covers_page"))


def clipped(blocks: DataFrame) -> DataFrame:
    """Whole pixels within the page, and reason: malformed_bbox where a number is missing, zero_area where nothing is left."""
    x, y = F.greatest(F.lit(0), F.col("x").cast("int")), F.greatest(F.lit(0), F.col("y").cast("int"))
    w = F.least(F.col("width").cast("int"), F.col("page_width") - x)
    h = F.least(F.col("height").cast("int"), F.col("page_height") - y)
    whole = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("width").isNotNull() & F.col("height").isNotNull()
    box = {k: F.when(whole, v) for k, v in {"x": x, "y": y, "width": w, "height": h}.items()}
    return blocks.withColumns({**box, "reason": F.when(~whole, "malformed_bbox").when((w <= 0) | (h <= 0), "zero_area")})


#: Side of the cells in which boxes of a page meet, in pixels.
CELL = 512


def pairs(blocks: DataFrame) -> DataFrame:
    """Unordered pairs of boxes of one page that meet, a_ before b_ by (block_index, block_id).

    Boxes meet in the cells of a grid that they cover, so that a page with very many boxes is not compared all with
    all; a pair counts in the one cell that holds the upper left corner of what both cover.
    """
    cell = lambda c: F.floor(c / CELL)
    covered = lambda c, d: F.explode(F.sequence(cell(F.col(c)), cell(F.col(c) + F.col(d))))
    b = blocks.where((F.col("width") > 0) & (F.col("height") > 0)).select("page_id", "block_id", "block_index", *BOX)
    b = b.withColumn("cell_x", covered("x", "width")).withColumn("cell_y", covered("y", "height"))
    on = ["page_id", "cell_x", "cell_y"]
    side = lambda p: b.select(*on, *[F.col(c).alias(f"{p}_{c}") for c in ("block_id", "block_index", *BOX)])
    corner = (cell(F.greatest("a_x", "b_x")) == F.col("cell_x")) & (cell(F.greatest("a_y", "b_y")) == F.col("cell_y"))
    return side("a").join(side("b"), on).where(F.struct("a_block_index", "a_block_id") < F.struct("b_block_index", "b_block_id")).where(corner).drop("cell_x", "cell_y")


def pair_iou(blocks: DataFrame) -> DataFrame:
    """Pairs that meet, with the overlap over the union, where a sliver in the divisor keeps it from zero."""
    area = lambda p: F.greatest(F.lit(0.0), F.col(f"{p}_width")) * F.greatest(F.lit(0.0), F.col(f"{p}_height"))
    side = lambda c, d: F.greatest(F.lit(0.0), F.least(F.col(f"a_{c}") + F.col(f"a_{d}"), F.col(f"b_{c}") + F.col(f"b_{d}")) - F.greatest(f"a_{c}", f"b_{c}"))
    shared = side("x", "width") * side("y", "height")
    return pairs(blocks).withColumn("s", shared).where("s > 0").select("page_id", "a_block_id", "b_block_id", (F.col("s") / (area("a") + area("b") - F.col("s") + 1e-6)).alias("iou"))


def pair_overlaps(blocks: DataFrame) -> DataFrame:
    return pairs(blocks).select("page_id", "a_block_id", "b_block_id", g.iou("a_", "b_").alias("iou"), g.smaller_overlap("a_", "b_").alias("smaller_overlap")).where("smaller_overlap > 0")


def shared_regions(blocks: DataFrame, limit: float = 0.55) -> DataFrame:
    """Boxes that share most of the smaller one with another become inset base boxes.

    Boxes whose column ``source`` (if there is one) says manual or locked_detector_box take no part.
    """
    free = blocks.where(~F.coalesce("source", F.lit("")).isin("manual", "locked_detector_box")) if "source" in blocks.columns else blocks
    hit = pair_overlaps(free).where(F.col("smaller_overlap") >= limit)
    ids = hit.select("page_id", F.col("a_block_id").alias("block_id")).union(hit.select("page_id", "b_block_id")).distinct().withColumn("shared", F.lit(True))
    b = blocks.join(ids, ["page_id", "block_id"], "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    inset = {"x": F.col("x") + F.col("width") * 0.045, "y": F.col("y") + F.col("height") * 0.055, "width": F.greatest(F.lit(4.0), F.col("width") * 0.91), "height": F.greatest(F.lit(4.0), F.col("height") * 0.89), "confidence": F.least(F.lit(0.72), F.col("confidence"))}
    return b.withColumns({k: F.when(F.col("shared"), v).otherwise(F.col(k)) for k, v in inset.items()})


def rivals(blocks: DataFrame) -> DataFrame:
    """For each block the other boxes of its page with positive sides, as an array in page order.

    A page's boxes are gathered once and each block leaves itself out, so no pairs are shuffled.
    """
    box = F.struct("block_index", "block_id", *BOX)
    per = blocks.groupBy("page_id").agg(F.array_sort(F.collect_list(F.when((F.col("width") > 0) & (F.col("height") > 0), box))).alias("boxes"))
    others = F.filter("boxes", lambda b: b["block_id"] != F.col("block_id"))
    return blocks.join(per, "page_id").select("page_id", "block_id", F.transform(others, lambda b: F.struct(*[b[c].alias(c) for c in BOX])).alias("rivals"))


def tiles(pages: DataFrame) -> DataFrame:
    """Vertical tiles of page width, 80 % apart, the last flush with the bottom."""
    side = F.least("width", "height")
    stride = F.greatest(F.lit(1), (side * 0.8).cast("int"))
    n = F.ceil((F.col("height") - side) / stride)
    t = pages.select("page_id", "width", "height", side.alias("tile_height"), stride.alias("stride"), n.alias("n"))
    t = t.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    top = F.when(F.col("k") < F.col("n"), F.col("k") * F.col("stride")).otherwise(F.col("height") - F.col("tile_height"))
    return t.select("page_id", F.col("width").alias("tile_width"), "tile_height", "k", top.cast("long").alias("top"))


def in_tiles(blocks: DataFrame, t: DataFrame) -> DataFrame:
    """Boxes with the tiles that hold at least half of their height."""
    j = blocks.join(t, "page_id")
    low, high = F.greatest("y", "top"), F.least(F.col("y") + F.col("height"), F.col("top") + F.col("tile_height"))
    inside = (F.col("y") >= F.col("top")) & (F.col("y") + F.col("height") <= F.col("top") + F.col("tile_height"))
    return j.where(inside | (high - low >= 0.5 * F.col("height")))


def unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def tile_labels(blocks: DataFrame, t: DataFrame) -> DataFrame:
    """Centre and size of boxes relative to their tiles, each within 0 and 1."""
    j = in_tiles(blocks, t)
    return j.select(
        "page_id", "k", "block_id", F.when(F.col("balloon_type") == "bubble", 0).otherwise(1).alias("class"),
        unit((F.col("x") + F.col("width") / 2) / F.col("tile_width")).alias("cx"),
        unit((F.col("y") - F.col("top") + F.col("height") / 2) / F.col("tile_height")).alias("cy"),
        unit(F.col("width") / F.col("tile_width")).alias("w"), unit(F.col("height") / F.col("tile_height")).alias("h"),
    )


def empty_tiles(blocks: DataFrame, t: DataFrame) -> DataFrame:
    return t.join(in_tiles(blocks, t).select("page_id", "k").distinct(), ["page_id", "k"], "left_anti")


#: How much the brightness of a background tile varies, and the most tiles of each split.
VARIED, MOST_BACKGROUND = 15.0, {"train": 360, "val": 65}


def background_tiles(empty: DataFrame, most: dict[str, int] = MOST_BACKGROUND, seed: str = "42") -> DataFrame:
    """Tiles without boxes that are no plain colour, at most so many of each split, in hash order.

    ``empty`` has page_id, k, deviation (of the brightness) and split.  Each split is a distributed top-k.
    """
    order = F.md5(F.concat_ws("-", F.lit(seed), F.col("page_id").cast("string"), F.col("k").cast("string")))
    good = empty.where(F.col("deviation") > VARIED).withColumn("__order", order)
    first = [good.where(F.col("split") == s).orderBy("__order", "page_id", "k").limit(n) for s, n in most.items()]
    return reduce(DataFrame.unionByName, first).drop("__order")


def label_lines(blocks: DataFrame) -> DataFrame:
    """One training label per box of a page: class 0, centre and size with six decimals."""
    ok = blocks.where("page_width > 0 and page_height > 0")
    parts = [(F.col("x") + F.col("width") / 2) / F.col("page_width"), (F.col("y") + F.col("height") / 2) / F.col("page_height"), F.col("width") / F.col("page_width"), F.col("height") / F.col("page_height")]
    return ok.select("page_id", "block_id", F.format_string("0 %.6f %.6f %.6f %.6f", *[unit(p) for p in parts]).alias("line"))


def reading_order(blocks: DataFrame, right_to_left: bool = True) -> DataFrame:
    """Rows by bands of 0.8 mean heights, then across; numbers from 1."""
    mean = F.avg(F.when(F.col("height") > 0, F.col("height"))).over(Window.partitionBy("page_id"))
    band = F.floor(F.col("y") / F.greatest(F.lit(30.0), 0.8 * F.coalesce(mean, F.lit(50.0))))
    centre = F.col("x") + F.col("width") / 2
    across = -centre if right_to_left else centre
    b = blocks.withColumn("band", band).withColumn("across", across)
    return b.withColumn("order", F.row_number().over(Window.partitionBy("page_id").orderBy("band", "across", "block_index", "block_id"))).drop("band", "across")


def scroll_order(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("order", F.row_number().over(Window.partitionBy("page_id").orderBy("y", "x", "block_index", "block_id")) - 1)


def flow_lines(ordered: DataFrame) -> DataFrame:
    """Lines from the centre of each block to that of the next, one decimal."""
    w = Window.partitionBy("page_id").orderBy("order")
    c = ordered.withColumn("cx", F.col("x") + F.col("width") / 2).withColumn("cy", F.col("y") + F.col("height") / 2)
    c = c.withColumn("to_x", F.lead("cx").over(w)).withColumn("to_y", F.lead("cy").over(w))
    return c.where("to_x is not null").select("page_id", F.col("order").alias("from_order"), F.round("cx", 1).alias("x1"), F.round("cy", 1).alias("y1"), F.round("to_x", 1).alias("x2"), F.round("to_y", 1).alias("y2"))
