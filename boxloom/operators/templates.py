"""Text templates of projects, their use on blocks, and the layout policy's migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip

#: Colours that count as not detected.
PLAIN = ("#000000", "#111111", "")
PLAIN_STROKE = ("#000000", "")


def resolved_templates(projects: DataFrame, templates: DataFrame, builtin: DataFrame) -> DataFrame:
    """project_id and the columns of its templates: its own valid ones, or all built-in ones if it has none.

    ``templates`` has project_id, template_id, ord, valid and more columns, ``builtin`` all of these but
    project_id and valid; it is the library's short list.
    """
    own = templates.where("valid").drop("valid")
    without = projects.select("project_id").join(own.select("project_id").distinct(), "project_id", "left_anti").withColumn("__all", F.lit(1))
    given = without.join(builtin.withColumn("__all", F.lit(1)), "__all").drop("__all")
    return projects.select("project_id").join(own, "project_id").unionByName(given.select(own.columns))


def default_template(projects: DataFrame, templates: DataFrame) -> DataFrame:
    """project_id, template_id: the one that the project's setting names, or ``bubble``, if it is valid;
    else its first valid one; null if it has none."""
    wanted = F.coalesce(F.nullif("default_template_id", F.lit("")), F.lit("bubble"))
    own = templates.where("valid").select("project_id", "template_id", "ord")
    p = projects.select("project_id", wanted.alias("wanted")).join(own, "project_id", "left")
    first = F.min(F.struct((F.col("template_id") != F.col("wanted")).alias("other"), "ord", "template_id"))
    return p.groupBy("project_id").agg(first["template_id"].alias("template_id"))


def _detected(color: Column, plain: tuple[str, ...]) -> Column:
    return F.coalesce(F.startswith(color, F.lit("#")) & ~F.lower(color).isin(*plain), F.lit(False))


def apply_templates(blocks: DataFrame, templates: DataFrame) -> DataFrame:
    """Blocks with the style of their template, where what was detected in the image comes first.

    ``blocks`` has project_id, template_id, color_hex, detected_color, detected_bold, detected_italic,
    detected_stroke, detected_stroke_width and font_size.  The sources of colour, bold, italic and
    stroke are in the map ``effect_sources``.
    """
    t = templates.select("project_id", "template_id", *[F.col(c).alias(f"t_{c}") for c in templates.columns if c not in ("project_id", "template_id")])
    b = blocks.join(t, ["project_id", "template_id"])
    stack = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("t_font_stack", "t_font_family", F.lit("")), ","), strip), lambda x: (x != "") & (x != "None")))
    color = F.coalesce(F.nullif("color_hex", F.lit("")), F.col("detected_color"))
    has_color, has_stroke = _detected(color, PLAIN), _detected(F.col("detected_stroke"), PLAIN_STROKE)
    source = lambda seen: F.when(seen, "ai_vision").otherwise("template")
    effects = [F.lit("color"), source(has_color), F.lit("bold"), source(F.col("detected_bold").isNotNull()), F.lit("italic"), source(F.col("detected_italic").isNotNull()), F.lit("stroke"), source(has_stroke)]
    width = F.when(has_stroke, F.when(F.col("detected_stroke_width") > 0, F.col("detected_stroke_width")).otherwise(2.0))
    auto = F.coalesce("t_auto_font_size", F.lit(True))
    return b.select(
        "block_id", "template_id", F.coalesce(F.get(stack, F.lit(0)), F.lit("Tahoma")).alias("font_family"), F.when(F.size(stack) > 0, stack).otherwise(F.array(F.lit("Tahoma"))).alias("font_stack"),
        F.when(has_color, color).otherwise(F.coalesce("t_color_hex", "color_hex", F.lit("#000000"))).alias("color_hex"),
        F.coalesce("detected_bold", "t_bold", F.lit(False)).alias("bold"), F.coalesce("detected_italic", "t_italic", F.lit(False)).alias("italic"),
        F.coalesce("t_font_size", "font_size").alias("font_size"), F.when(auto, "auto").otherwise("fixed").alias("font_size_mode"),
        F.when(has_stroke, F.col("detected_stroke")).otherwise(F.coalesce("t_stroke_color", F.lit("#ffffff"))).alias("stroke_color"),
        F.coalesce(width, F.when(F.coalesce("t_stroke_enabled", F.lit(True)), F.coalesce("t_stroke_width", F.lit(0.0))), F.lit(0.0)).alias("stroke_width"),
        F.create_map(*effects).alias("effect_sources"),
    )


def migrated(projects: DataFrame, blocks: DataFrame, version: int) -> DataFrame:
    """project_id, block_id, action of the blocks that a migration to ``version`` touches.

    Only projects below it are touched, and of these blocks whose region came from the locked
    box: those with a saved context get it back (``restored``), the others are ``redetect``.
    """
    old = projects.where(F.coalesce(F.col("policy_version").try_cast("int"), F.lit(0)) < version).select("project_id")
    touched = blocks.where("region_source = 'locked_detector_box'").join(old, "project_id", "left_semi")
    return touched.select("project_id", "block_id", F.when(F.col("context").isNotNull(), "restored").otherwise("redetect").alias("action"), F.col("context").alias("region"))


def migration_counts(touched: DataFrame) -> DataFrame:
    return touched.groupBy("project_id").agg(F.count("*").alias("affected"), F.count_if(F.col("action") == "redetect").alias("redetect"))

