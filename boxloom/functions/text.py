"""Text rules as column expressions.  White space means any Unicode space."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

THAI, KANA_HAN, HANGUL = r"[฀-๿]", r"[぀-ヿ一-鿿]", r"[가-힯]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def blank(c: Column) -> Column:
    return ~F.regexp_like(F.coalesce(c, F.lit("")), F.lit(r"[^\s\p{Z}]"))


def squeezed(c: Column) -> Column:
    """Without any white space or byte-order mark, for comparing wordings."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\p{Z}﻿]+", "")


def normal_lines(c: Column) -> Column:
    """Each line collapsed and trimmed, line breaks kept, ends trimmed."""
    lines = F.transform(F.split(c, "\n"), lambda x: strip(F.regexp_replace(x, r"[\s\p{Z}]+", " ")))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$", "")


def script(c: Column) -> Column:
    """th, ja, ko or en: the first script that occurs."""
    return F.when(F.regexp_like(c, F.lit(THAI)), "th").when(F.regexp_like(c, F.lit(KANA_HAN)), "ja").when(F.regexp_like(c, F.lit(HANGUL)), "ko").otherwise("en")


def without_tags(c: Column) -> Column:
    """Without the ``{tag}`` groups at the end."""
    return F.regexp_replace(F.regexp_replace(c, r"(\s*\{[^{}]+\}\s*)+$", ""), r"\s+$", "")


def channels(hex6: Column) -> list[Column]:
    """Red, green and blue of ``#rgb`` or ``#rrggbb``, from 0 to 1; null for anything else."""
    h = F.lower(F.regexp_replace(hex6, "^#", ""))
    h = F.when(F.regexp_like(h, F.lit("^[0-9a-f]{3}$")), F.regexp_replace(h, "(.)", "$1$1")).when(F.regexp_like(h, F.lit("^[0-9a-f]{6}$")), h)
    return [F.conv(F.substring(h, k, 2), 16, 10).cast("double") / 255 for k in (1, 3, 5)]


def luminance(hex6: Column) -> Column:
    r, g, b = channels(hex6)
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def saturation(hex6: Column) -> Column:
    """The share by which the weakest channel is below the strongest; zero for black."""
    c = channels(hex6)
    return F.when(F.greatest(*c) == 0, 0.0).otherwise((F.greatest(*c) - F.least(*c)) / F.greatest(*c))


def evidence(text: Column, failed: Column) -> dict[str, Column]:
    """status and reason of recognised text: does it hold a letter or digit?"""
    some = F.regexp_like(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]"))
    status = F.when(failed, "needs_review").when(blank(text), "reject").when(~some, "reject").otherwise("confirmed")
    reason = F.when(failed, "ocr_failed").when(blank(text), "empty_ocr").when(~some, "punctuation_only").otherwise("valid_text")
    return {"status": status, "reason": reason}


#: ASCII punctuation and its full-width forms.
NARROW, WIDE = ",.?!:;()", "，。？！：；（）"
#: Signs that make up a noise line.
NOISE = r"""()（）\[\]【】/\\|_\-.~`'"“”‘’·・=><「」『』《》"""
_SPACE = r"[\s\p{Z}]"


def clean_recognised(text: Column, language: Column, breaks: bool = True, spaces: bool = True, wide: bool = False, readings: bool = False) -> Column:
    """Recognised text without line breaks; CJK text without spaces, other text with single ones.

    ``readings`` drops kana in brackets after a CJK character, ``wide`` turns punctuation full-width.
    """
    cjk = language.isin("ja", "zh", "ko")
    if readings:
        text = F.regexp_replace(text, r"(?<=[一-鿿])(?:（[ぁ-んァ-ヶ]+）|\([ぁ-んァ-ヶ]+\))", "")
    if breaks:
        text = F.replace(text, F.lit("\r"), F.lit(""))
        text = F.when(cjk, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(strip(F.regexp_replace(text, f"{_SPACE}+", " ")))
    if spaces:
        text = F.when(cjk, F.regexp_replace(text, f"{_SPACE}+", "")).otherwise(text)
    return F.translate(text, NARROW, WIDE) if wide else text


def without_noise(line: Column) -> Column:
    """Empty where a line holds only noise signs; else without slashes and stray brackets at its ends."""
    t = strip(F.coalesce(line, F.lit("")))
    bare = t
    for pattern in (rf"^[/\\]+{_SPACE}*", rf"{_SPACE}*[/\\]+$", r"^[」\s\p{Z}]+", r"[「\s\p{Z}]+$"):
        bare = F.regexp_replace(bare, pattern, "")
    return F.when(F.regexp_like(t, F.lit(rf"^[{NOISE}\s\p{{Z}}]+$")), "").otherwise(strip(bare))


def kept_wording(existing: Column, new: Column) -> Column:
    """The existing wording where both agree but for white space, else the new; without line breaks."""
    return F.regexp_replace(F.when(squeezed(existing) == squeezed(new), existing).otherwise(new), r"[\r\n]+", "")


def dictionary(words: DataFrame) -> DataFrame:
    """word, letters: trimmed words of two letters or more, once each; readers order by letters, then word."""
    return words.select(strip(F.col("word")).alias("word")).where(F.length("word") >= 2).distinct().withColumn("letters", F.length("word"))


def quota_reason(log: Column) -> Column:
    """Why a log line tells of a spent quota, or null."""
    told = F.regexp_like(log, F.lit("Individual quota reached|429 Too Many Requests|Quota exceeded|RESOURCE_EXHAUSTED"))
    wait = strip(F.regexp_extract(log, r"(?i)Resets in\s+([^.\n]+)", 1))
    reason = F.when(wait != "", F.concat(F.lit("Individual quota reached (Resets in "), wait, F.lit(")"))).when(F.contains(log, F.lit("429")), "HTTP 429 Rate Limit Exceeded").otherwise("Individual quota reached")
    return F.when(told, reason)


def trailing_tag(value: Column, roles: dict[str, str]) -> dict[str, Column]:
    """text without the known ``{tag}`` groups at its end; role and label of the last; repeated: several."""
    one = r"\{\s*(" + "|".join(re.escape(k) for k in sorted(roles, key=len, reverse=True)) + r")\s*\}"
    v = F.regexp_replace(F.coalesce(value, F.lit("")), f"{_SPACE}+$", "")
    tail = F.regexp_extract(v, rf"((?:{_SPACE}*{one}{_SPACE}*)+)$", 1)
    label = F.nullif(F.regexp_extract(tail, rf"{one}{_SPACE}*$", 1), F.lit(""))
    role = F.element_at(F.create_map(*[F.lit(x) for kv in roles.items() for x in kv]), label)
    return {"text": F.regexp_replace(v, rf"(?:{_SPACE}*{one}{_SPACE}*)+$", ""), "role": role, "label": label, "repeated": F.regexp_count(tail, F.lit(one)) > 1}


def rule_hits(tokens: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """kind, part, hits, tokens: how often word rules apply.  Equal tokens are counted before the rules."""
    c, applies = F.col("token"), []
    for kind, part in rules:
        longer, p = F.length(c) > len(part), F.lit(part)
        test = {"forward": F.startswith(c, p) & longer, "backward": F.endswith(c, p) & longer, "compound": F.contains(c, p)}[kind]
        applies.append(F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(part).alias("part"))))
    n = tokens.groupBy("token").agg(F.count("*").alias("n"))
    hit = n.select("n", F.explode(F.filter(F.array(*applies), lambda r: r.isNotNull())).alias("r"))
    return hit.groupBy("r.kind", "r.part").agg(F.sum("n").alias("hits"), F.count("*").alias("tokens"))
