"""The role of a text from what is seen of it, and fingerprints of what decides its layout."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import luminance, saturation, strip

#: The roles in order, what each starts from, and which type of box speaks for which.
BASE = {"dialogue": 0.35, "narration": 0.15, "emphasis": 0.10, "sfx": 0.10}
ROLE_OF = {"bubble": "dialogue", "narrative": "narration", "narration": "narration", "sfx": "sfx", "emphasis": "emphasis"}


#: The template that goes with each role, and the mark of a shouted one.
TEMPLATE_OF = {"dialogue": "bubble", "narration": "narration", "emphasis": "emphasis", "sfx": "sfx"}
SHOUTED = "ตะโกน"


def role_templates(templates: DataFrame) -> DataFrame:
    """project_id and, per role, the template for it: of that name, else the role's usual one, else the first that
    suits, else the first.  ``templates`` has project_id, template_id, ord, balloon_type and semantic_tag."""
    kind, name = F.lower(F.coalesce("balloon_type", F.lit(""))), F.col("template_id")
    suits = {
        "dialogue": kind.isin("bubble", "dialogue", ""), "narration": kind.isin("narrative", "narration"), "sfx": kind == "sfx",
        "emphasis": F.contains(F.lower(name), F.lit("emphasis")) | F.contains(F.coalesce("semantic_tag", F.lit("")), F.lit(SHOUTED)),
    }
    place = lambda r: F.when(name == r, 0).when(name == TEMPLATE_OF[r], 1).when(suits[r], 2).otherwise(3)
    return templates.groupBy("project_id").agg(*[F.min_by("template_id", F.struct(place(r), F.col("ord"), name)).alias(r) for r in BASE])


#: What else is told by a bit behind those of the signs.
_FLAGS = ("seen", "outlined", "plain")


def judged(blocks: DataFrame, templates: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """block_id, role, intensity, orientation, has_outline, confidence and reason_codes, and with ``templates``
    (see ``role_templates``) suggested_template; blocks then have project_id and text_template_id, which is
    kept where it suits the role.

    ``blocks`` has source_text, translation, detected_type, balloon_type, text_direction, source_color,
    y, width, height, region_source, source_stroke_width and page_height.  Signs add to the scores of roles;
    the highest wins, the first listed of equals.  With ``pages`` (page_id, page_height, project_id) blocks have page_id
    instead of the last two.  What is seen of a block is one number before blocks are dealt out, and the templates of
    roles are joined to the pages, which are fewer.
    """
    text = F.coalesce(F.nullif("translation", F.lit("")), F.col("source_text"), F.lit(""))
    source = F.coalesce("source_text", F.lit(""))
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    kind = F.lower(F.coalesce(F.nullif("detected_type", F.lit("")), F.nullif("balloon_type", F.lit("")), F.lit("bubble")))
    seen = F.coalesce(F.col("detected_type") != "", F.lit(False))
    loud, short = count(text, "[!！]"), F.length(strip(text)) <= 6
    aspect = F.round(F.col("width") / F.greatest("height", F.lit(1.0)), 4)
    dark = F.coalesce((saturation(F.col("source_color")) > 0.45) & (luminance(F.col("source_color")) < 0.55), F.lit(False))
    light = F.coalesce(luminance(F.col("source_color")) > 0.85, F.lit(False)) & (short | (kind == "sfx"))
    outline = F.coalesce(F.col("source_stroke_width") > 0.5, F.lit(False))
    katakana = (count(source, r"[\u30A0-\u30FF]") >= 2) & (short | (F.length(strip(source)) <= 6))
    fallback = F.coalesce(F.col("region_source") == "fallback_bbox", F.lit(False))
    vertical = F.startswith(F.lower(F.coalesce("text_direction", F.lit(""))), F.lit("vertical"))
    # condition, what it adds to which roles, its reason; in order.  A banner is seen only beside its page
    signs: list[tuple[Column, dict[str, float], str]] = [
        *[((kind == k) & seen, {r: 0.35}, f"DETECTOR_{k.upper()}") for k, r in ROLE_OF.items()],
        *[((kind == k) & ~seen, {r: 0.12}, f"LEGACY_OR_MANUAL_{k.upper()}") for k, r in ROLE_OF.items()],
        ((aspect > 2.2) & (F.col("height") < 80), {"narration": 0.25}, "WIDE_SHORT_BOX"),
        ((aspect < 0.55) & short, {"sfx": 0.2}, "TALL_SHORT_TEXT"),
        (fallback, {}, "LAYOUT_REGION_FALLBACK"),
        (loud >= 2, {"emphasis": 0.55, "dialogue": -0.15}, "MULTI_EXCLAMATION"),
        (loud == 1, {"emphasis": 0.22}, "EXCLAMATION"),
        ((count(text, "[A-Z]{2,}") >= 1) & short, {"sfx": 0.3}, "LATIN_UPPER_SHORT"),
        (katakana, {"sfx": 0.35}, "KATAKANA_SFX"),
        (dark, {"emphasis": 0.22}, "SATURATED_DARK_COLOR"),
        (light, {"sfx": 0.2}, "LIGHT_GLYPH_COLOR"),
        (outline & short, {"sfx": 0.15}, "HAS_OUTLINE"),
        (F.lit(True), {}, "HEURISTIC_UNCALIBRATED"),
        (F.lit(False), {"narration": 0.15}, "TOP_PAGE_BANNER"),
        (vertical, {}, "VERTICAL_ORIENTATION"),
    ]
    place = {reason: k for k, (_, _, reason) in enumerate(signs)} | {f: len(signs) + k for k, f in enumerate(_FLAGS)}
    bits = reduce(add, [F.when(c, 1 << k).otherwise(0) for k, c in enumerate([*[c for c, _, _ in signs], seen, outline, F.col("source_color").isNull()])])
    own = [] if templates is None else ["text_template_id"]
    own += ["page_id"] if pages is not None else ["page_height", *(["project_id"] if templates is not None else [])]
    b = blocks.select("block_id", bits.alias("signs"), F.when(aspect > 1.8, F.col("y")).alias("wide_y"), *own)
    if templates is not None and pages is not None:
        pages = pages.join(role_templates(templates), "project_id", "left")
    elif templates is not None:
        b = b.join(role_templates(templates), "project_id", "left")
    b = b if pages is None else b.join(pages, "page_id")
    top = F.coalesce((F.col("page_height") > 0) & (F.round(F.col("wide_y") / F.col("page_height"), 4) < 0.12), F.lit(False))
    b = b.withColumn("signs", F.col("signs") + F.when(top, 1 << place["TOP_PAGE_BANNER"]).otherwise(0))

    has = lambda *which: F.col("signs").bitwiseAND(F.lit(sum(1 << place[w] for w in which))) != 0
    score = {r: F.lit(x) for r, x in BASE.items()}
    for _, adds, reason in signs:
        for r, v in adds.items():
            score[r] = score[r] + F.when(has(reason), v).otherwise(0.0)
    scores = F.array(*[F.round(score[r], 6) for r in BASE])
    best, ranked = F.array_max("scores"), F.sort_array("scores", False)
    role = F.element_at(F.array(*map(F.lit, BASE)), F.array_position("scores", best).cast("int"))
    more, keeps = [], F.lit(False)
    if templates is not None:
        per_role = lambda d: F.create_map(*[x for r in BASE for x in (F.lit(r), d(r))])[F.col("role")]
        b = b.withColumn("scores", scores).withColumn("role", role)
        b = b.select("block_id", "signs", "project_id", "text_template_id", F.coalesce(per_role(F.col), F.lit("bubble")).alias("suggested"))
        theirs = templates.select("project_id", F.col("template_id").alias("text_template_id"), F.coalesce("balloon_type", F.lit("")).alias("own_type"))
        b = b.join(theirs, ["project_id", "text_template_id"], "left")
    # made of the number once more, which is less than to deal them out
    b = b.withColumn("scores", scores).withColumn("role", role)
    if templates is not None:
        speaks = F.create_map(*[F.lit(x) for p in ROLE_OF.items() for x in p])[F.lower("own_type")]
        suits = (F.col("text_template_id") == per_role(lambda r: F.lit(TEMPLATE_OF[r]))) | (F.col("text_template_id") == F.col("suggested")) | F.coalesce(speaks == F.col("role"), F.lit(False))
        b = b.withColumn("keeps", F.col("own_type").isNotNull() & suits)
        keeps, more = F.col("keeps"), [F.when(F.col("keeps"), F.col("text_template_id")).otherwise(F.col("suggested")).alias("suggested_template")]
    told = F.filter(F.array(*[F.when(has(reason), reason) for _, _, reason in signs], F.when(keeps, "KEEP_EXISTING_TEMPLATE")), lambda x: x.isNotNull())
    b = b.withColumn("told", told)
    mapped = has(*[r for _, _, r in signs if r.startswith(("DETECTOR_", "LEGACY_OR_MANUAL_"))])
    margin = F.round(best - F.get(ranked, F.lit(1)), 6)
    conf = 0.40 + F.least(F.lit(0.35), best * 0.30) + F.least(F.lit(0.12), margin * 0.35)
    conf = conf - F.when(has("LAYOUT_REGION_FALLBACK"), 0.12).otherwise(0) + F.when(has("seen") & mapped & (margin > 0.15), 0.06).otherwise(0)
    conf = conf - F.when(F.size("told") <= 2, 0.08).otherwise(0) - F.when(has("plain"), 0.05).otherwise(0)
    intensity = F.when((F.col("role") == "emphasis") | has("MULTI_EXCLAMATION"), "shout").when(F.col("role") == "narration", "soft").otherwise("normal")
    return b.select(
        "block_id", "role", intensity.alias("intensity"), F.when(has("VERTICAL_ORIENTATION"), "vertical").otherwise("horizontal").alias("orientation"), has("outlined").alias("has_outline"),
        F.greatest(F.lit(0.05), F.least(F.lit(0.89), F.round(conf, 4))).alias("confidence"), F.when(has("plain"), F.concat("told", F.array(F.lit("NO_SOURCE_COLOR_EVIDENCE")))).otherwise(F.col("told")).alias("reason_codes"), *more,
    )


def _formatted(c: str, f: str) -> Column:
    """A number by its format; whole ones, zero apart (it has a sign), are written without a look at the format, which is slow."""
    v, zeros = F.col(c).cast("double"), re.fullmatch(r"%\.([1-9])f", f)
    if not zeros:
        return F.format_string(f, v)
    whole = (v != 0) & (F.abs(v) < 1e15) & (v == v.try_cast("long").cast("double"))
    return F.when(whole, F.concat(v.try_cast("long").cast("string"), F.lit("." + "0" * int(zeros[1])))).otherwise(F.format_string(f, v))


def fingerprint(fields: list[tuple[str, str | None]]) -> Column:
    """The SHA-256 of columns in order, joined by bars: numbers by their format, others as text, null as nothing."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(_formatted(c, f) if f else F.col(c).cast("string"), F.lit("")) for c, f in fields]), 256)


#: What a rendered text depends on, in order, with the formats of numbers.
RENDERED = [
    ("font_postscript_name", None), ("font_fingerprint", None), ("font_size", "%.4f"), ("explicit_lines", None), ("line_height", "%.4f"), ("tracking", "%.4f"), ("bold", None), ("italic", None), ("color_hex", None), ("stroke_width", None), ("stroke_color", None),
    ("outline_glow_radius", None), ("outline_glow_color", None), ("outline_glow_opacity", None), ("gradient", None), ("text_align", None), ("vertical_align", None), ("writing_direction", None), ("rotation_deg", "%.4f"), ("layout_region", None), ("padding", None),
]


def render_fingerprint(specs: DataFrame) -> DataFrame:
    """Adds render_fingerprint; fields that specs lack are empty, and lists are joined by bars."""
    have = dict(specs.dtypes)
    parts = []
    for c, f in RENDERED:
        value = F.lit("") if c not in have else F.array_join(c, "|") if have[c].startswith("array") else F.format_string(f, F.col(c).cast("double")) if f else F.col(c).cast("string")
        parts.append(F.coalesce(value, F.lit("")))
    return specs.withColumn("render_fingerprint", F.sha2(F.concat_ws("|", *parts), 256))


def stale_specs(specs: DataFrame, blocks: DataFrame, fields: list[tuple[str, str | None]], schema_version: str, engine_version: str) -> DataFrame:
    """block_id and reason of the specs that no longer hold: marked stale, of another schema or engine
    version, or with a signature that the block's fields (and the versions) do not give now.

    ``specs`` has block_id, layout_status, schema_version, engine_version and source_signature.
    """
    now = blocks.withColumns({"__engine": F.lit(engine_version), "__schema": F.lit(schema_version)})
    now = now.select("block_id", fingerprint([*fields, ("__engine", None), ("__schema", None)]).alias("signature"))
    s = specs.join(now, "block_id", "left")
    reason = (
        F.when(F.col("layout_status") == "stale", "stale").when(~F.col("schema_version").eqNullSafe(F.lit(schema_version)), "schema").when(~F.col("engine_version").eqNullSafe(F.lit(engine_version)), "engine")
        .when(F.col("signature").isNull(), "no_block").when(~F.col("source_signature").eqNullSafe(F.col("signature")), "changed")
    )
    return s.select("block_id", reason.alias("reason")).where("reason is not null")
