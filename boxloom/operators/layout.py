"""Layout of text in boxes: regions, gates over measured crops, fonts, spatial hints, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import THAI, blank, strip

SIDES = ("x", "y", "width", "height")
CJK = ("ja", "zh", "ko")
SMART_SOURCES = ("smart_balloon", "smart_balloon_v15")


def effective_region(blocks: DataFrame, smart: bool = True) -> DataFrame:
    """Adds region: the smart box, else the stored one, else the block's own box.

    Reads smart_x.. and meta_x.., meta_confidence, meta_source beside the block's box.  Null,
    infinite or tiny stored boxes count as missing; a stored confidence is kept within 0 and 1.
    """
    box = lambda p: [F.col(p + s).cast("double").alias(s) for s in SIDES]
    whole = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    use_smart = F.lit(smart) & F.col("smart_x").isNotNull() & (F.col("smart_width") > 10) & (F.col("smart_height") > 10)
    use_meta = (F.col("meta_width") >= 4) & (F.col("meta_height") >= 4)
    for s in SIDES:
        use_meta &= whole(F.col(f"meta_{s}").cast("double"))
    if not smart:
        use_meta &= ~F.coalesce(F.col("meta_source").isin(*SMART_SOURCES), F.lit(False))
    meta_confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("meta_confidence", F.lit(0.0))))
    own = [F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.greatest(F.lit(1.0), F.col("width")).alias("width"), F.greatest(F.lit(1.0), F.col("height")).alias("height")]
    region = (
        F.when(use_smart, F.struct(*box("smart_"), F.lit(0.95).alias("confidence"), F.lit("smart_balloon").alias("source")))
        .when(use_meta, F.struct(*box("meta_"), meta_confidence.alias("confidence"), F.coalesce("meta_source", F.lit("metadata")).alias("source")))
        .otherwise(F.struct(*own, F.lit(0.0).alias("confidence"), F.lit("bbox").alias("source")))
    )
    return blocks.withColumn("region", region)


def crop_reason(crops: DataFrame) -> DataFrame:
    """Adds reason: the first rule that a crop fails, or null.

    Reads width, height, contrast, edge_density, elements, brightness_sd.  Large crops with too
    few elements stay when their brightness varies.
    """
    aspect = F.col("width") / F.col("height")
    few = F.col("elements") < F.when(F.col("width") > 55, 3).otherwise(1)
    rescued = (F.col("width") >= 50) & (F.col("height") >= 50) & (F.col("brightness_sd") > 20)
    reason = (
        F.when((F.col("width") < 18) | (F.col("height") < 18), "too_small").when((aspect > 8) | (aspect < 0.12), "extreme_aspect_ratio")
        .when(F.col("contrast") < 35, "low_contrast").when(F.col("edge_density") < 0.002, "low_edge_density").when(few & ~rescued, "insufficient_text_elements")
    )
    return crops.withColumn("reason", reason)


def mask_gate(masks: DataFrame, cover: float = 0.85, low: float = 1.15, high: float = 30.0) -> DataFrame:
    """Adds accepted and reason from covered_area, mask_area and the box's area."""
    area = F.greatest(F.lit(1.0), F.col("width") * F.col("height"))
    ratio = F.col("mask_area") / area
    reason = F.when(F.col("covered_area") / area < cover, "bbox_cover").when(ratio < low, "area_too_small").when(ratio > high, "area_too_large")
    return masks.withColumns({"accepted": reason.isNull(), "reason": F.coalesce(reason, F.lit("accepted"))})


def chosen_class(configured: list[str]) -> str | None:
    """The class that detections are narrowed to; None keeps all."""
    return next((c for c in ("text", "balloon", "bubble") if c in configured), None)


def prunable(blocks: DataFrame) -> DataFrame:
    """Automatic blocks without any text whose region nobody placed by hand."""
    auto = (F.col("layer_origin") == "auto_detection") | (F.coalesce("detected_type", F.lit("")) != "")
    placed = F.coalesce("region_source", F.lit("")) == "manual"
    return blocks.where(F.coalesce(auto, F.lit(False)) & ~placed & blank(F.col("source_text")) & blank(F.col("translation")))


#: The first choice of a font for each script and kind of box.
FAMILIES = {
    "th": {"shout": "Prompt", "bubble": "Prompt", "thought": "Sarabun", "narration": "Sarabun", "whisper": "Sarabun", "sfx": "Kanit", "system": "Prompt"},
    "en": {"shout": "CCWildWords", "bubble": "CCWildWords", "thought": "Anime Ace", "narration": "Helvetica", "whisper": "Anime Ace", "sfx": "Impact", "system": "Arial"},
    "ja": {"shout": "MS Gothic", "bubble": "MS Mincho", "thought": "MS Mincho", "narration": "MS Mincho", "whisper": "MS Gothic", "sfx": "MS Gothic", "system": "MS Gothic"},
}


def font_style(blocks: DataFrame, script: str = "th") -> DataFrame:
    """Family, weight, slant, line height, spacing and size by kind of box; unknown kinds count as bubbles,
    other scripts as Thai where the text has Thai letters, else as Latin."""
    kind = F.lower(strip(F.coalesce("balloon_type", F.lit("bubble"))))
    thai = F.regexp_like(F.coalesce("text", F.lit("")), F.lit(THAI)) if script not in FAMILIES else F.lit(script == "th")
    used = F.lit(script) if script in FAMILIES else F.when(thai, "th").otherwise("en")
    families = F.create_map(*[F.lit(x) for s, own in FAMILIES.items() for k, f in own.items() for x in (f"{s}/{k}", f)])
    family = F.coalesce(F.try_element_at(families, F.concat(used, F.lit("/"), kind)), F.try_element_at(families, F.concat(used, F.lit("/bubble"))))
    soft = kind.isin("thought", "whisper")
    height = F.when(kind == "shout", 1.15).when(soft, 1.30).when(kind == "sfx", 1.0).otherwise(1.25)
    letters = F.greatest(F.lit(1), F.length(F.coalesce("text", F.lit(""))))
    size = F.sqrt(F.col("width") * F.col("height") / (letters * F.lit(1.8).cast("double")))
    return blocks.withColumns({
        "weight": F.when(kind == "shout", 700).when(soft, 300).when(kind == "narration", 500).when(kind == "sfx", 800).otherwise(400),
        "italic": soft, "line_height": F.greatest(height, F.when(thai, 1.35).otherwise(0.0)), "family": family,
        "spacing": F.when(kind == "shout", -0.5).when(kind == "sfx", 1.0).otherwise(0.0),
        "font_size": F.greatest(F.lit(11.0), F.least(F.lit(36.0), size)),
    })


def font_estimate(text: Column, language: Column, width: Column, height: Column) -> Column:
    """Size of the source's letters from its lines and box, 12 to 120; null without letters."""
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: strip(x) != "")).cast("double")
    letters = F.length(strip(F.replace(text, F.lit("\n"), F.lit("")))).cast("double")
    per_line = F.greatest(F.lit(1.0), letters / F.nullif(lines, F.lit(0.0)))
    along = F.least(width / lines * 0.85, height / per_line * 0.95)
    across = F.least(height / lines * 0.85, width / per_line * 0.95)
    size = F.when(language.isin(*CJK), along).otherwise(across)
    return F.when((lines > 0) & (letters > 0), F.greatest(F.lit(12.0), F.least(F.lit(120.0), size)))


def spatial_hint(blocks: DataFrame, least: float = 24.0, preferred: float = 42.0) -> DataFrame:
    """Adds shape, aspect, target_lines, max_lines, pattern and the tag that carries them.

    The aspect is rounded half up.  Visible letters exclude white space and combining marks.
    """
    w, h = F.greatest(F.lit(20.0), F.col("width")), F.greatest(F.lit(20.0), F.col("height"))
    kind = F.lower(F.coalesce("balloon_type", F.lit("bubble")))
    aspect = F.floor(w / h * 100 + 0.5) / 100
    shape = (
        F.when(kind.isin("sfx", "free"), "free").when(kind.isin("narrative", "caption", "box", "rectangle"), "rectangle")
        .when(F.col("aspect") >= 1.4, "wide_oval").when(F.col("aspect") <= 0.75, "tall_oval").when(F.col("aspect").between(0.85, 1.15), "round_bubble").otherwise("ellipse")
    )
    most = F.greatest(F.lit(1), F.least(F.lit(8), F.floor(h * 0.85 / (least * 1.25)).cast("int")))
    text = F.when(~blank(F.col("translation")), F.col("translation")).otherwise(F.coalesce("source_text", F.lit("")))
    letters = F.length(F.regexp_replace(text, r"[\s\p{Z}\p{M}]", ""))
    per_line = F.greatest(F.lit(4.0), w * F.when(F.col("shape") == "rectangle", 0.92).otherwise(0.78) / F.greatest(F.lit(1.0), F.lit(preferred * 0.52)))
    want = F.when(letters > 0, F.ceil(letters / per_line)).otherwise(3)
    target = F.greatest(F.lit(1), F.least(F.col("max_lines"), want)).cast("int")
    pattern = F.when(F.col("shape").isin("free", "rectangle"), "Uniform").when(F.col("target_lines") >= 3, "Short-Long-Long-Short").otherwise("Short-Long")
    tag = F.concat(
        F.lit("[[SMART_BALLOON_SPATIAL shape="), "shape", F.lit(" aspect="), F.col("aspect").cast("string"), F.lit(" w="), w.cast("int").cast("string"), F.lit(" h="), h.cast("int").cast("string"),
        F.lit(" target_lines="), F.col("target_lines").cast("string"), F.lit(" max_lines="), F.col("max_lines").cast("string"), F.lit(" pattern="), "pattern", F.lit("]]"),
    )
    return blocks.withColumn("aspect", aspect).withColumns({"shape": shape, "max_lines": most}).withColumn("target_lines", target).withColumn("pattern", pattern).withColumn("tag", tag)


#: Fixed form of the tag.
SPATIAL = r"\[\[SMART_BALLOON_SPATIAL\s+shape=([a-z_]+)\s+aspect=([0-9.]+)\s+w=(\d+)\s+h=(\d+)\s+target_lines=(\d+)\s+max_lines=(\d+)(?:\s+pattern=([A-Za-z-]+))?\]\]"


def read_hint(tag: Column) -> dict[str, Column]:
    """The parts of a spatial tag; all null where there is none."""
    found = F.regexp_like(tag, F.lit(SPATIAL))
    part = lambda k, kind: F.when(found, F.regexp_extract(tag, SPATIAL, k)).cast(kind)
    pattern = F.when(found, F.coalesce(F.nullif(F.regexp_extract(tag, SPATIAL, 7), F.lit("")), F.lit("Uniform")))
    return {"shape": part(1, "string"), "aspect": part(2, "double"), "width": part(3, "int"), "height": part(4, "int"), "target_lines": part(5, "int"), "max_lines": part(6, "int"), "pattern": pattern}


def layout_score(font_size: Column, widths: Column, text_height: Column, overflow: Column, width: Column, height: Column, kind: Column) -> Column:
    """Quality of a line layout, higher is better.

    ``widths`` holds the width of each line; ``overflow`` is null where the text fits.
    """
    n, widest = F.size(widths), F.array_max(widths)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    round_shape = kind.isin("bubble", "ellipse", "oval")
    arc = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.sin(F.lit(3.141592653589793) * (i + 0.5) / n))
    off = total(F.zip_with(widths, arc, lambda w, a: F.abs(w / widest - a / F.array_max(arc)))) / n
    mean = total(widths) / n
    spread = F.sqrt(total(F.transform(widths, lambda w: (w - mean) * (w - mean))) / n) / mean
    uneven = F.when((n > 1) & (widest > 0), F.when(round_shape, off * 350.0).otherwise(spread * 300.0)).otherwise(0.0)
    before = total(F.slice(widths, F.lit(1), F.greatest(n - 1, F.lit(1)))) / F.greatest(n - 1, F.lit(1))
    orphan = F.when((n > 1) & (before > 0) & (F.element_at(widths, -1) / before < 0.30), 300.0).otherwise(0.0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    aspect = F.when(round_shape, F.abs(ratio(widest, text_height) - ratio(width, height)) * 50.0).otherwise(0.0)
    score = font_size * 25.0 - F.when(overflow.isNotNull(), overflow * 100.0 + 10000.0).otherwise(0.0) - uneven - orphan - aspect
    return F.when(F.coalesce(n, F.lit(0)) <= 0, -99999.0).otherwise(score)


def best_candidate(candidates: DataFrame) -> DataFrame:
    """Per block the candidate with the best score, to six decimals; ties to the smaller one."""
    rank = F.row_number().over(Window.partitionBy("block_id").orderBy(F.desc("score"), "candidate"))
    return candidates.withColumn("score", F.round("score", 6)).withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def oversize(pages: DataFrame, key: str, threshold: int = 20000) -> DataFrame:
    """Per folder: images, how many are too high, the greatest height, the commonest width (ties: the smaller)."""
    per = pages.groupBy(key, "width").agg(F.count("*").alias("n"), F.count_if(F.col("height") > threshold).alias("over"), F.max("height").alias("top"))
    return per.groupBy(key).agg(
        F.sum("n").alias("images"), F.sum("over").alias("oversize"), F.max("top").alias("max_height"),
        F.lit(min(5000, threshold)).alias("split_height"), F.max_by("width", F.struct("n", -F.col("width"))).alias("common_width"),
    )


def clamped_tile_labels(held: DataFrame, least: float = 15.0) -> DataFrame:
    """Labels of one class for boxes in tiles, kept above the tile's top edge and within 0.001 to 0.999.

    ``held`` has the boxes with their tile's k, top, tile_width and tile_height.  The part above
    the tile is not taken off the height.
    """
    y = F.col("y") - F.col("top")
    inside = (y >= 0) & (F.col("y") + F.col("height") <= F.col("top") + F.col("tile_height"))
    at = F.when(inside, y).otherwise(F.greatest(F.lit(0.0), y))
    high = F.when(inside, F.col("height")).otherwise(F.least(F.col("tile_height") - at, F.col("height")))
    unit = lambda c: F.greatest(F.lit(0.001), F.least(F.lit(0.999), c))
    rows = held.withColumns({"__at": at, "__high": high, "__in": inside}).where(F.col("__in") | (F.col("__high") >= least))
    return rows.select(
        "page_id", "k", "block_id", unit((F.col("x") + F.col("width") / 2) / F.col("tile_width")).alias("cx"), unit((F.col("__at") + F.col("__high") / 2) / F.col("tile_height")).alias("cy"),
        unit(F.col("width") / F.col("tile_width")).alias("w"), unit(F.col("__high") / F.col("tile_height")).alias("h"),
    )


#: Texts of a specification that are equal or not, as they follow each other in one text.
_MARKS = ("font_postscript", "stroke_color", "text_align", "vertical_align", "writing_direction", "color_hex")


def _safe(part: Column) -> Column:
    """The text without line breaks; different texts, null among them, stay different."""
    return F.coalesce(F.replace(F.replace(part, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\\0"))


def spec_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per block of either side: the names of the fields that differ, comma-joined; missing: ``block``.

    Numbers may be 0.01 apart, centres 2 pixels or 1 % of the first spec's larger side.  Fields that a side has not got are null.
    Null is false for ``bold`` and ``italic``, zero for tracking, stroke width and rotation, empty for the stroke's colour and
    no line for ``explicit_lines``; colours are compared where both sides have one, font and line heights must be there.

    Both sides are shuffled whole, so rows hold only what is compared, and that in few columns: centres for boxes, one text for
    the lines and one for the other texts, a part to a line.
    """

    def named(d: DataFrame, n: str) -> DataFrame:
        has = lambda c: F.col(c) if c in d.columns else F.lit(None)
        number = lambda c: F.coalesce(has(c).cast("double"), F.lit(0.0))
        word = lambda c, other=None: F.coalesce(F.nullif(has(c).cast("string"), F.lit("")), has(other).cast("string") if other else F.lit(None).cast("string"))
        numbers = {
            "center_x": number("x") + number("width") / 2, "center_y": number("y") + number("height") / 2, "font_size": has("font_size").cast("double"), "line_height": has("line_height").cast("double"), **{c: number(c) for c in ("tracking", "stroke_width", "rotation_deg")},
            **({"allowed": F.greatest(F.lit(2.0), F.greatest(number("width"), number("height"), F.lit(1.0)) * 0.01)} if n == "a" else {}),
        }
        flags = {c: F.coalesce(has(c).cast("boolean"), F.lit(False)) for c in ("bold", "italic")}
        marks = {
            "font_postscript": word("font_postscript_name", "resolved_postscript_name"), "stroke_color": F.lower(F.coalesce(has("stroke_color").cast("string"), F.lit(""))), "text_align": word("text_align", "horizontal_align"),
            "vertical_align": has("vertical_align").cast("string"), "writing_direction": has("writing_direction").cast("string"), "color_hex": F.lower(F.regexp_replace(F.coalesce(has("color_hex"), F.lit("")), "^#+", "")),
        }
        lines = F.coalesce(has("explicit_lines").cast("array<string>"), F.array().cast("array<string>"))
        # a break before each line, so that no line and one empty line differ
        text = F.concat_ws("\n", F.when(F.size(lines) > 0, ""), F.transform(lines, _safe))
        return d.select("block_id", *[v.alias(f"{n}_{k}") for k, v in (numbers | flags).items()], F.concat_ws("\n", *[_safe(marks[k]) for k in _MARKS]).alias(f"{n}_marks"), text.alias(f"{n}_lines"))

    both = named(a, "a").join(named(b, "b"), "block_id", "full")
    gap = lambda f: F.abs(F.col(f"a_{f}") - F.col(f"b_{f}"))
    far = lambda f: (f, F.coalesce(gap(f) > 0.01, F.lit(True)))
    mark = lambda n, f: F.substring_index(F.substring_index(f"{n}_marks", "\n", _MARKS.index(f) + 1), "\n", -1)
    other = lambda f: (f, mark("a", f) != mark("b", f))
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    lines = F.col("a_lines") != F.col("b_lines")
    differs = [
        ("explicit_lines", lines), ("line_count", lines & (breaks("a_lines") != breaks("b_lines"))), other("font_postscript"), *map(far, ("font_size", "line_height", "tracking")), *[(f, F.col(f"a_{f}") != F.col(f"b_{f}")) for f in ("bold", "italic")],
        ("color_hex", (mark("a", "color_hex") != "") & (mark("b", "color_hex") != "") & (mark("a", "color_hex") != mark("b", "color_hex"))),
        far("stroke_width"), *map(other, ("stroke_color", "text_align", "vertical_align", "writing_direction")), far("rotation_deg"),
        ("center", (gap("center_x") > F.col("a_allowed")) | (gap("center_y") > F.col("a_allowed"))),
    ]
    names = F.concat_ws(",", *[F.when(c, F.lit(f)) for f, c in differs])
    return both.select("block_id", F.when(F.col("a_marks").isNull() | F.col("b_marks").isNull(), "block").otherwise(names).alias("mismatches"))

#: Findings that a person has to look at.
HARD = ("TEXT_OVERFLOW", "FONT_TOO_SMALL", "FONT_BELOW_PROJECT_MINIMUM", "UNBALANCED_LINES", "LAYOUT_REGION_FALLBACK", "FONT_UNAVAILABLE", "FONT_FALLBACK")


def decision(specs: DataFrame, floor: float = 0.90) -> DataFrame:
    """Adds status and reasons (an array) of a layout: applied, default style, or for review.

    Reads overflow, font_fallback, issues and error_codes (arrays), layout_confidence, style_confidence.
    """
    hard = F.filter("issues", lambda i: i.isin(*HARD))
    over = F.col("overflow") | F.array_contains("issues", "TEXT_OVERFLOW")
    unsure = F.col("layout_confidence") < floor
    reasons = (
        F.when(over, F.array(F.lit("TEXT_OVERFLOW"))).when(F.col("font_fallback"), F.array(F.lit("FONT_FALLBACK")))
        .when(unsure, F.concat(hard, F.array(F.lit("LOW_LAYOUT_CONFIDENCE")))).when(F.size(hard) > 0, hard).when(F.size("error_codes") > 0, F.col("error_codes"))
    )
    low = F.col("style_confidence") < floor
    soft = F.when(low, F.array(F.lit("LOW_STYLE_CONFIDENCE"))).otherwise(F.array(F.lit("CONSTRAINTS_OK")))
    status = F.when(reasons.isNotNull(), "NEEDS_REVIEW").when(low, "DEFAULTED").otherwise("AUTO_APPLIED")
    return specs.withColumns({"status": status, "reasons": F.coalesce(reasons, soft)})
