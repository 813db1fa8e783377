"""What comes in from outside: manifests, stored files, answers of models, imported texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import squeezed, strip
from .exchange import SEMANTIC_KEYS, judged_records

#: The largest file and picture that are taken.
MOST_BYTES, MOST_PIXELS = 100 * 1024 * 1024, 120_000_000


def manifest_lines(records: DataFrame) -> DataFrame:
    """One JSON line for each record, for ``write.text``."""
    return records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value"))


def read_manifest(files: DataFrame, schema: str, strict: bool = True) -> DataFrame:
    """The records of (path, value) whole files; blank lines are left out.

    A bad line is an error that names path and line: it fails the job, or, without ``strict``,
    is a row whose only other columns are line_no and error.
    """
    lines = files.select("path", F.posexplode(F.split("value", "\n")).alias("k", "line")).where(strip(F.col("line")) != "")
    parsed = F.from_json("line", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    r = lines.select("path", (F.col("k") + 1).alias("line_no"), parsed.alias("r"))
    told = F.concat("path", F.lit(": line "), F.col("line_no").cast("string"), F.lit(" is no valid record"))
    error = F.when(F.col("r.__bad").isNotNull() | F.col("r").isNull(), F.raise_error(told).cast("string") if strict else told)
    return r.select("path", "line_no", error.alias("error"), "r.*").drop("__bad")


def load_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_manifest(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"), schema)


def media_type(content: Column) -> Column:
    """By the first bytes; null for anything that is not taken."""
    head = F.hex(F.substring(content, 1, 12))
    starts = lambda x: F.startswith(head, F.lit(x))
    return (
        F.when(starts("89504E470D0A1A0A"), "image/png").when(starts("FFD8FF"), "image/jpeg").when(starts("52494646") & F.endswith(head, F.lit("57454250")) & (F.length(head) == 24), "image/webp")
        .when(starts("424D"), "image/bmp").when(starts("38425053"), "image/vnd.adobe.photoshop")
    )


def checked_assets(files: DataFrame) -> DataFrame:
    """path, media_type, byte_size, sha256 and why a file is rejected (null if it is not).

    ``files`` is what the binaryFile reader gives (path, content), with declared (a media type or null)
    and width and height (null where they are not known; a PNG's are read from its header).
    """
    size, kind = F.length("content"), media_type(F.col("content"))
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("long")
    side = lambda c, at: F.coalesce(F.col(c).cast("long"), F.when((F.col("media_type") == "image/png") & (F.col("byte_size") >= 24), number(at)))
    f = files.withColumns({"media_type": kind, "byte_size": size}).withColumns({"w": side("width", 17), "h": side("height", 21)})
    alias = (F.col("declared") == "image/jpg") & (F.col("media_type") == "image/jpeg")
    reason = (
        F.when(F.col("byte_size") == 0, "empty").when(F.col("byte_size") > MOST_BYTES, "too_large").when(F.col("media_type").isNull(), "unknown_signature")
        .when((F.coalesce("declared", F.lit("")) != "") & (F.col("declared") != F.col("media_type")) & ~alias, "declared_mismatch")
        .when((F.col("media_type") != "image/vnd.adobe.photoshop") & ((F.col("w") <= 0) | (F.col("h") <= 0) | (F.col("w") * F.col("h") > MOST_PIXELS)), "too_many_pixels")
    )
    return f.select("path", "media_type", "byte_size", F.sha2("content", 256).alias("sha256"), reason.alias("reason"))


def _truth(v: Column) -> Column:
    """Whether a JSON value is one that counts: not null, false, zero or empty."""
    return F.coalesce(~F.regexp_like(F.to_json(v), F.lit(r'^(?:null|false|""|\{\}|\[\]|-?0+(?:\.0*)?(?:[eE][-+]?[0-9]+)?)$')), F.lit(False))


#: What an answer says of a box besides its text and type, as JSON or as a value.
SAID = ("color_hex", "stroke_color_hex", "stroke_width_px", "gradient_colors", "gradient", "drop_shadow", "outer_glow", "inner_shadow", "bold", "italic")
#: The keys of an item that are read.
_ITEM = ("box_id", "id", "text", "ocr", "balloon_type", "stroke_color", "stroke_width", *SAID)


def _said(item: Column) -> dict[str, Column]:
    either = lambda a, b: F.when(_truth(item[a]), item[a]).otherwise(item[b])
    word = lambda v: F.try_variant_get(v, "$", "string")
    record = lambda j: F.when(F.startswith(j, F.lit("{")), j)
    return {
        "color_hex": word(item["color_hex"]), "stroke_color_hex": word(either("stroke_color_hex", "stroke_color")), "stroke_width_px": F.try_variant_get(either("stroke_width_px", "stroke_width"), "$", "double"),
        "gradient_colors": F.nullif(F.to_json(item["gradient_colors"]), F.lit("null")), **{k: record(F.to_json(item[k])) for k in ("gradient", "drop_shadow", "outer_glow", "inner_shadow")},
        "bold": _truth(item["bold"]), "italic": _truth(item["italic"]),
    }


def matched_boxes(answers: DataFrame) -> DataFrame:
    """answer_id, box_id, text, balloon_type and the fields of ``SAID``: what answers of models say of the boxes that were asked for.

    ``answers`` has answer_id, raw and expected (the ids).  An answer is JSON (one item or a list), in whole or between
    fences, or else lines of id and text; the first of these that gives a box counts.  Items that are no objects, or whose text
    is none, are passed over.  Boxes are found by id and never by place: the same id, an id within the other either way, or
    the first two parts of one; the smallest id of several.  The last item of a box counts.  Lines give text alone.
    """
    # by answer, as its boxes are brought together below; answers are small beside the work on them, so partitions are not merged
    parts = int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers = answers.where("answer_id is not null").repartition(parts, "answer_id").select("answer_id", "expected", strip(F.col("raw")).alias("raw"))
    fences = F.regexp_extract_all("raw", F.lit(r"(?s)```(?i:json)?\s*(.*?)```"), F.lit(1))
    # the last way is that by lines
    bodies = F.concat(F.array("raw"), fences, F.array("raw"))
    tries = answers.select("answer_id", "expected", F.posexplode(bodies).alias("way", "body"), (F.size(fences) + 1).alias("by_lines"))
    # a run of letters is tried once, from its start
    form = r"(?i)(?:(?<![a-z])[a-z]++_BOX:|box_id\s*[:=]\s*)([A-Za-z0-9_-]+)\s*(?:\||\t|:|-)+\s*(.*)$"
    keys = "struct<" + ",".join(f"{k}:variant" for k in _ITEM) + ">"
    v = F.try_parse_json(F.when(F.col("way") == 0, F.col("body")).when(F.col("way") < F.col("by_lines"), strip(F.col("body"))))
    # an item's keys are taken out at once; what is no object gives null
    read = lambda i: F.struct(F.try_variant_get(i, "$", keys).alias("i"), F.lit(None).cast("string").alias("line"))
    listed = F.transform(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v")), read)
    lines = F.transform(F.split("body", r"\r\n|\r|\n"), lambda x: F.struct(F.lit(None).cast(keys).alias("i"), x.alias("line")))
    entries = tries.withColumn("v", v).select("answer_id", "expected", "way", F.posexplode(F.when(F.col("way") == F.col("by_lines"), lines).otherwise(listed)).alias("at", "e"))
    items = entries.select("answer_id", "expected", "way", "at", "e.i", "e.line").where("i is not null or line is not null")
    of = lambda key: F.col("i")[key]
    word = lambda v: F.try_variant_get(v, "$", "string")
    either = lambda line, item: F.when(F.col("line").isNotNull(), line).otherwise(item)
    told = F.coalesce(of("text"), of("ocr"))
    text = either(F.regexp_replace(strip(F.regexp_extract("line", form, 2)), "^[`\"]+|[`\"]+$", ""), F.when(F.schema_of_variant(told) == "STRING", word(told)))
    found = items.select(
        "answer_id", "expected", "way", "at", either(F.regexp_extract("line", form, 1), F.when(_truth(of("box_id")), word(of("box_id"))).otherwise(word(of("id")))).alias("named"), F.explode(F.array(strip(text))).alias("text"), "line", "i",
    ).where("text <> ''")
    kind = either(F.lit("bubble"), F.lower(F.when(_truth(of("balloon_type")), word(of("balloon_type"))).otherwise("bubble")))
    said = {k: F.when(F.col("line").isNull(), c) for k, c in _said(F.col("i")).items()}
    found = found.select("answer_id", "expected", "way", "at", "named", "text", kind.alias("balloon_type"), *[c.alias(k) for k, c in said.items()])
    name = F.upper(strip(F.regexp_replace(F.regexp_replace(strip(F.coalesce("named", F.lit(""))), "^[`\"']+|[`\"']+$", ""), "(?i)[a-z]+_BOX:", "")))
    # exploded, so that they are made once and not for every id that the name is compared with
    found = found.withColumn("name", F.explode(F.array(name))).where("name <> ''")
    two = lambda x: F.array_join(F.slice(F.split(F.upper(x), "_"), 1, 2), "_")
    same = F.filter("expected", lambda x: F.upper(x) == F.col("name"))
    close = F.filter("expected", lambda x: F.contains(F.col("name"), F.upper(x)) | F.contains(F.upper(x), F.col("name")) | (F.contains(x, F.lit("_")) & F.contains(F.col("name"), two(x))))
    found = found.withColumn("box_id", F.explode(F.array(F.coalesce(F.array_min(same), F.array_min(close))))).where("box_id is not null")
    # a box's first way and the last item there; of these, the boxes of the first way that gives the answer anything
    last = F.max_by(F.struct("text", "balloon_type", *SAID), F.struct(-F.col("way"), F.col("at")))
    per = found.groupBy("answer_id", "box_id").agg(F.min("way").alias("way"), last.alias("r"))
    per = per.withColumn("first", F.min("way").over(Window.partitionBy("answer_id")))
    return per.where("way = first").select("answer_id", "box_id", "r.*")


def import_metadata(updates: DataFrame) -> DataFrame:
    """Adds to updates the metadata after an import.

    ``updates`` has metadata (a map of strings), text, layout_text, hint, and role, role_label, role_tag, raw and
    role_template.  Several non-blank lines are recorded as preferred, a layout hint and a role likewise;
    what an import does not say is taken out.
    """
    lines = F.filter(F.split("text", r"\r\n|\r|\n"), lambda x: strip(x) != "")
    several, hint, role = F.size(lines) > 1, F.coalesce("hint", F.lit("")) != "", F.coalesce("role", F.lit("")) != ""
    gone = ("line_break_source", "ai_preferred_lines", "ai_layout_text", "ai_layout_hint", *SEMANTIC_KEYS)
    kept = F.map_filter("metadata", lambda k, v: ~k.isin(*gone))
    none = F.lit(None).cast("map<string,string>")
    pairs = lambda said, d: F.when(said, F.create_map(*[x for k, v in d.items() for x in (F.lit(k), v)])).otherwise(F.coalesce(none, F.create_map().cast("map<string,string>")))
    line_keys = pairs(several, {"line_break_source": F.lit("ai_preferred"), "ai_preferred_lines": F.to_json(lines), "ai_layout_text": F.col("layout_text")})
    hint_keys = pairs(hint, {"ai_layout_hint": F.col("hint")})
    role_keys = pairs(role, {"semantic_role": F.col("role"), "semantic_role_label": F.col("role_label"), "semantic_role_source": F.lit("ai_translation_import_tag"), "semantic_role_tag": F.col("role_tag"), "semantic_role_confidence": F.lit("1.0"), "semantic_role_raw_translation": F.col("raw"), "semantic_role_template_id": F.col("role_template")})
    return updates.withColumn("metadata", F.map_concat(kept, line_keys, hint_keys, role_keys))


#: How alike two wordings must be, by how much the best must lead, and from where it need not.
ALIKE, LEAD, SURE = 0.72, 0.06, 0.90


def _most_alike(norm: str, texts: list[str], counts: list[Counter], free: np.ndarray, sizes: np.ndarray) -> tuple[int, float]:
    """The free text that is most alike and its ratio, or -1; upper bounds rule out most before they are compared."""
    n, own = len(norm), Counter(norm)
    bound = 2 * np.minimum(n, sizes) / np.maximum(1, n + sizes)
    best = second = (0.0, -1)
    matcher = SequenceMatcher(autojunk=False)
    matcher.set_seq2(norm)
    for k in sorted(np.flatnonzero(free & (sizes > 0) & (bound >= ALIKE - LEAD)).tolist(), key=lambda k: -bound[k]):
        if bound[k] < max(second[0], ALIKE - LEAD):
            break
        if 2 * sum((own & counts[k]).values()) / (n + sizes[k]) < max(second[0], ALIKE - LEAD):
            continue
        matcher.set_seq2(texts[k])
        matcher.set_seq1(norm)
        found = matcher.ratio(), k
        if found > best:
            best, second = found, best
        elif found > second:
            second = found
    sure = best[0] >= ALIKE and (best[0] - second[0] >= LEAD - 1e-12 or best[0] >= SURE)
    return (best[1], best[0]) if sure else (-1, best[0])


class _Wordings:
    """A project's blocks in order, each of which is taken once."""

    def __init__(self, texts: list[str]):
        self.texts, self.sizes, self.free = texts, np.array([len(t) for t in texts], int), np.ones(len(texts), bool)
        self.counts: list[Counter] = []
        # wordings that no free block is like; as free blocks only get fewer, none ever will be
        self.unlike: set[str] = set()
        self.places: dict[str, list[int]] = {}
        for k in range(len(texts) - 1, -1, -1):
            self.places.setdefault(texts[k], []).append(k)

    def take(self, norm: str) -> tuple[int, float]:
        """The first free block of the wording, else the one that is most alike, and how much; -1 if there is none."""
        if not norm or norm in self.unlike:
            return -1, 0.0
        same = self.places.get(norm, [])
        while same and not self.free[same[-1]]:
            same.pop()
        if same:
            k, ratio = same[-1], 1.0
        else:
            self.counts = self.counts or [Counter(t) for t in self.texts]
            k, ratio = _most_alike(norm, self.texts, self.counts, self.free, self.sizes)
            if ratio < ALIKE:
                self.unlike.add(norm)
        if k >= 0:
            self.free[k] = False
        return k, ratio


def _record_by_record(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """Records with found, at and now_norm of the block that each is for, whether an earlier record took it (again), and ratio.

    ``records`` has project_id, no, way (id, source or bubble), asked, bubble, norm and more; ``blocks`` project_id, found, at,
    now_norm.  A task reads sorted rows, a project's blocks before its records, and holds the blocks of one project at a time.
    """
    rows = blocks.select("project_id", F.lit(False).alias("__record"), "found", "at", "now_norm").unionByName(records.withColumn("__record", F.lit(True)), allowMissingColumns=True)
    # numbered by a window, which holds Spark to whole projects in a task: a repartition() that a union of two sides dealt alike seems
    # to make needless is left out, and then each side's partitions are merged by their own sizes
    in_order = Window.partitionBy("project_id").orderBy("__record", F.asc_nulls_last("at"), F.asc_nulls_last("no"))
    rows = rows.withColumn("__nth", F.row_number().over(in_order))
    types, read = dict(rows.dtypes), ("project_id", "__record", "found", "at", "now_norm", "no", "way", "asked", "bubble", "norm")
    kept, names = records.columns, ("found", "at", "now_norm", "again", "ratio")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, words, ids, places, texts, by_id = None, None, [], [], [], {}
        for batch in batches:
            out = []
            for p, is_record, i, at, text, no, way, asked, bubble, norm in zip(*[batch.column(c).to_pylist() for c in read], strict=True):
                if p != project:
                    project, words, ids, places, texts = p, None, [], [], []
                if not is_record:
                    ids.append(i), places.append(at), texts.append(text)
                    continue
                if words is None:
                    words, by_id = _Wordings(texts), {}
                    for k, i in enumerate(ids):
                        by_id.setdefault(i, k)
                again, ratio = False, None
                if way == "source":
                    k, ratio = words.take(norm)
                else:
                    number = bubble or no
                    k = by_id.get(asked, -1) if way == "id" else number - 1 if 1 <= number <= len(ids) else -1
                    if k >= 0:
                        again = not words.free[k]
                        words.free[k] = False
                out.append((ids[k], places[k], texts[k], again, ratio) if k >= 0 else (None, None, None, again, ratio))
            own = [batch.column(c).filter(batch.column("__record")) for c in kept]
            kinds = [*[batch.schema.field(c).type for c in names[:3]], pa.bool_(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array([r[n] for r in out], t) for n, t in enumerate(kinds)]], [*kept, *names])

    types |= {"again": "boolean", "ratio": "double"}
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in (*kept, *names)))


def match_by_likeness(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """project_id, record_id, block_id, ratio of the records that find a block.

    In file order a record takes the first free block of its project with its wording, white space aside,
    else the free block that is most alike, if it is alike enough and clearly the best.  As a block
    is used once, a project's records depend on each other: one task handles one project, with texts of its blocks.
    Both sides have project_id, source_text and seq; records record_id, blocks block_id.
    """
    none = F.lit(None)
    norm = _wording(F.col("source_text"))
    # an alias makes a column of its own, where both sides come from one table
    b = blocks.select(F.col("project_id").alias("project_id"), F.col("block_id").alias("found"), F.col("seq").alias("at"), norm.alias("now_norm"))
    r = records.select("project_id", "record_id", F.col("seq").alias("no"), F.lit("source").alias("way"), none.cast("string").alias("asked"), none.cast("int").alias("bubble"), norm.alias("norm"))
    return _record_by_record(r, b).where("now_norm is not null").select("project_id", "record_id", F.col("found").alias("block_id"), "ratio")


def _wording(c: Column) -> Column:
    return F.regexp_replace(squeezed(c), "\ufeff", "")


def resolved_in_order(records: DataFrame, blocks: DataFrame, strict: bool = False) -> DataFrame:
    """Records with the block they are for, status (ok, warning, error, skip) and will_import, record by record in file order.

    A record names its block by block_id, else by source, else by bubble.  ``records`` has project_id, record_no, block_id,
    source, bubble, translation and target; ``blocks`` has project_id, block_id, bubble, source_text.  A source that differs is
    a warning, or with ``strict`` an error.  A wording goes to its first block that no earlier record took in any way, else to a free block that is much
    alike; a record without id and source means the block at its bubble, or at its own number.  As records of a
    project depend on each other, one task handles one project, with its blocks' texts.
    """
    way = F.when(F.col("block_id").isNotNull(), "id").when(F.coalesce("source", F.lit("")) != "", "source").otherwise("bubble")
    norm = F.coalesce(_wording(F.col("source")), F.lit(""))
    r = records.where("project_id is not null and record_no is not null").select("project_id", F.col("record_no").alias("no"), way.alias("way"), F.col("block_id").alias("asked"), "bubble", norm.alias("norm"), "translation", "target")
    b = blocks.select(F.col("project_id").alias("project_id"), F.col("block_id").alias("found"), F.col("bubble").alias("at"), F.coalesce(_wording(F.col("source_text")), F.lit("")).alias("now_norm"))
    return judged_records(_record_by_record(r, b).withColumnRenamed("no", "record_no"), strict)


#: Pixels kept around a box, and from the ends of a page; the smallest chunk.
CUT_MARGIN, FROM_ENDS, LEAST_CHUNK = 30, 100, 800


def page_cuts(height: int, boxes: np.ndarray, target: int, least: int = LEAST_CHUNK) -> list[int]:
    """Where a tall page is cut: near multiples of the target, outside every box, the upper of two equally near."""
    if height <= target:
        return [0, height]
    low = np.maximum(0, boxes[:, 0].astype(np.int64) - CUT_MARGIN)
    high = np.minimum(height, boxes[:, 0].astype(np.int64) + boxes[:, 1].astype(np.int64) + CUT_MARGIN)
    window, cuts, at = int(target * 0.25), [0], target
    while at < height - least:
        first, last = max(FROM_ENDS, at - window), min(height - FROM_ENDS, at + window)
        best = at
        if first < last:
            meets = (low < last) & (high > first)
            shut = np.zeros(last - first, bool)
            for a, b in zip(low[meets], high[meets], strict=True):
                shut[max(a, first) - first : b - first] = True
            open_ = np.flatnonzero(~shut) + first
            if len(open_):
                best = int(open_[np.argmin(np.abs(open_ - at))])
        best = max(best, cuts[-1] + least) if best <= cuts[-1] + least else best
        cuts.append(best)
        at = best + target
    return [*cuts, height]


def cut_plan(pages: DataFrame, blocks: DataFrame, target: int = 2500, least: int = LEAST_CHUNK) -> DataFrame:
    """page_id, cuts: the chosen heights, from 0 to the page's own.  One task holds the boxes of some pages."""
    per = blocks.groupBy("page_id").agg(F.collect_list(F.array("y", "height")).alias("boxes"))

    @F.pandas_udf("array<int>")
    def cuts(heights: pd.Series, boxes: pd.Series) -> pd.Series:
        return pd.Series([page_cuts(int(h), np.array([list(x) for x in b] if b is not None and len(b) else np.zeros((0, 2))), target, least) for h, b in zip(heights, boxes, strict=True)])

    return pages.join(per, "page_id", "left").select("page_id", cuts("height", "boxes").alias("cuts"))
