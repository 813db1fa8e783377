"""Line-based exchange files: one row per (file_id, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import THAI, squeezed, strip


def lines_of(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Line breaks normalised, lines numbered from 0."""
    text = F.regexp_replace(text_col, "\r\n|\r", "\n")
    return files.select(F.col(id_col).alias("file_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """Non-blank lines with the number of their paragraph, from 0, and their place in it."""
    w = Window.partitionBy("file_id").orderBy("line_no")
    b = lines.withColumn("blank", strip(F.col("line")) == "")
    starts = ~F.col("blank") & F.coalesce(F.lag("blank").over(w), F.lit(True))
    b = b.withColumn("starts", starts).withColumn("para", F.sum(F.col("starts").cast("int")).over(w) - 1).where("not blank")
    return b.withColumn("place", F.row_number().over(Window.partitionBy("file_id", "para").orderBy("line_no")) - 1).select("file_id", "line_no", "para", "place", "line")


def file_format(lines: DataFrame) -> DataFrame:
    """labelled, slash, tsv or alternating: the first whose mark occurs."""
    has = lambda p: F.bool_or(F.regexp_like("line", F.lit(p)))
    f = F.when(has(r"^# (ID:|Bubble [0-9]+)"), "labelled").when(has("^//"), "slash").when(has("\t"), "tsv").otherwise("alternating")
    return lines.groupBy("file_id").agg(f.alias("format"), F.count("*").alias("lines"))


#: Fixed form of a line that says how a text is laid out.
LAYOUT = r"^\[\[([A-Z]+_LAYOUT|SMART_BALLOON_SPATIAL)\s+shape=[a-z_]+\s+(aspect=[0-9.]+\s+w=\d+\s+h=\d+\s+)?target_lines=\d+\s+max_lines=\d+(\s+pattern=[A-Za-z-]+)?\]\]$"


def _joined(rows: Column) -> Column:
    """The lines of collected (line_no, line) in order."""
    return F.array_join(F.transform(F.array_sort(rows), lambda x: x["line"]), "\n")


def alternating(lines: DataFrame) -> DataFrame:
    """file_id, line_no, source, layout, translation, error of each record.

    Where every paragraph of a file is one line, neighbours pair up, and an odd one out is an error.
    Otherwise each paragraph is a record: source, perhaps a layout line, translation; one line alone is an error.
    """
    p = paragraphs(lines).withColumn("line", strip(F.col("line")))
    single = F.max("place").over(Window.partitionBy("file_id")) == 0
    p = p.withColumn("single", single)
    p = p.withColumns({"record": F.when(F.col("single"), F.floor(F.col("para") / 2)).otherwise(F.col("para")), "at": F.when(F.col("single"), F.col("para") % 2).otherwise(F.col("place"))})
    is_layout = (F.col("at") == 1) & F.regexp_like("line", F.lit(LAYOUT))
    told = F.collect_list(F.when((F.col("at") > 0) & ~is_layout, F.struct("line_no", "line")))
    per = p.groupBy("file_id", "record").agg(F.min("line_no").alias("line_no"), F.max(F.when(F.col("at") == 0, F.col("line"))).alias("source"), F.max(F.when(is_layout, F.col("line"))).alias("layout"), told.alias("told"), (F.max("at") == 0).alias("error"))
    return per.select("file_id", "line_no", "source", "layout", _joined(F.col("told")).alias("translation"), "error")


def slashed(lines: DataFrame) -> DataFrame:
    """file_id, line_no, bubble, source, layout, translation of the records of files with // lines.

    A paragraph of two lines is a pair; so are three with a layout line in the middle.  Longer ones of nothing but //
    lines in which other and Thai texts take turns are pairs too.  In all others a // line opens a
    record, unless it is Thai and follows a // line that is not; what does not open belongs to the record before.
    """
    within = Window.partitionBy("file_id", "para")
    s = strip(F.col("line"))
    p = paragraphs(lines).select("file_id", "para", "place", "line_no", s.alias("line")).withColumn("slash", F.startswith("line", F.lit("//")))
    p = p.withColumns({"clean": F.when(F.col("slash"), strip(F.substring("line", 3, 1 << 30))).otherwise(F.col("line")), "hint": F.regexp_like("line", F.lit(LAYOUT))})
    p = p.withColumns({"thai": F.regexp_like("clean", F.lit(THAI)), "n": F.count("*").over(within), "first": F.min("line_no").over(within)})
    turns = F.bool_and(F.col("slash") & (F.col("thai") == (F.col("place") % 2 == 1))).over(within) & (F.col("n") % 2 == 0)
    middle = F.bool_or((F.col("place") == 1) & F.col("hint")).over(within)
    p = p.withColumn("form", F.when((F.col("n") == 2) | ((F.col("n") == 3) & middle), "pair").when((F.col("n") > 2) & turns, "turns").otherwise("run"))
    # the line before that is no layout line
    before = within.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(~F.col("hint"), F.struct("slash", "thai")), True).over(before)
    p = p.withColumn("last", last)
    follows = F.coalesce(F.col("last.slash") & ~F.col("last.thai"), F.lit(False)) & F.col("thai")
    opens = F.when(F.col("form") == "pair", F.col("place") == 0).when(F.col("form") == "turns", F.col("place") % 2 == 0).otherwise(F.col("slash") & ~F.col("hint") & ~follows)
    p = p.withColumn("opens", opens).withColumn("record", F.sum(F.col("opens").cast("int")).over(within.orderBy("line_no")))
    text = F.when(F.col("form") == "run", ~F.col("hint")).otherwise((F.col("form") == "turns") | (F.col("place") != 1) | (F.col("n") == 2))
    told = F.collect_list(F.when(~F.col("opens") & text, F.struct("line_no", F.col("clean").alias("line"))))
    hints = F.when(F.col("hint") & ~F.col("opens") & ~text, F.col("line"))
    per = p.groupBy("file_id", "para", "record").agg(
        F.min(F.when(F.col("opens"), F.col("line_no")).otherwise(F.when(F.col("record") == 0, F.col("first")))).alias("line_no"),
        F.max(F.when(F.col("opens"), F.col("clean"))).alias("source"), F.max_by(hints, F.when(hints.isNotNull(), F.col("line_no"))).alias("layout"), told.alias("told"),
    ).where("record > 0 or size(told) > 0")
    bubble = F.row_number().over(Window.partitionBy("file_id").orderBy("line_no", "record"))
    return per.select("file_id", "line_no", bubble.alias("bubble"), "source", "layout", strip(_joined(F.col("told"))).alias("translation"))


def match_by_text(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """The k-th record of a wording in a project takes the k-th block of it.

    Both sides have project_id, source_text and an order column seq; blocks also block_id.
    """

    def ranked(df: DataFrame) -> DataFrame:
        df = df.withColumn("norm", squeezed(F.col("source_text")))
        return df.withColumn("k", F.row_number().over(Window.partitionBy("project_id", "norm").orderBy("seq")))

    return ranked(records).select("project_id", "norm", "k", "record_id").join(ranked(blocks).select("project_id", "norm", "k", "block_id"), ["project_id", "norm", "k"]).select("project_id", "record_id", "block_id")
