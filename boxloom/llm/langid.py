"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of labelled text.  A text is
compressed whole once per language, in blocks of ``BLOCK`` bytes that each start from the fresh
dictionary, and the language that leaves the fewest bytes in all wins.  The margin is the share
by which the runner-up is longer; a narrow one is a rejection.  As a dictionary saves a number
of bytes that hardly grows with what follows it, one block for a long text would let the margin
shrink with the length; over blocks it does not.

Training takes whole labelled texts: of each language the ``SAMPLE_DOCS`` documents with the smallest md5 of
their id (so any order of rows gives the same), and of these those of an eighth of ``SAMPLE_CHARS`` characters or
less, in that order, while they fit in ``SAMPLE_CHARS`` together; only the shortest if all are longer.  Documents that
repeat an id count as one, with the greatest of their texts.  Prediction reads nothing but the text, and all of it.

Null texts and texts without a letter are ``und`` with score 0, and rejected.  Ties go to the
language with more labelled documents, with score 0, and are rejected.  With no labelled text at all
everything is ``und``; with one language its score is 1 wherever there is a letter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

SAMPLE_DOCS = 256
SAMPLE_CHARS = 96 << 10
LEVEL = 5
#: Bytes that one fresh dictionary serves.
BLOCK = 1 << 14
#: Margins below this are rejected.
MARGIN = 0.002
UNDETERMINED = "und"
_OTHER = re.compile(r"[\W\d_]+")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = SAMPLE_DOCS, chars_per_lang: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """The dictionaries, the language with most documents first.  Only ids and labels are sorted; the texts of the chosen rows follow."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    key = F.md5(F.concat_ws("-", F.lit("sample"), F.col("id").cast("string")))
    ids = labelled.groupBy("lang", "id").agg(F.count("*").alias("n")).withColumn("key", key)
    few = ids
    for digits in (2, 4):
        few = _near_first(few, docs_per_lang, digits)
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("k") <= docs_per_lang)
    # docs_per_lang rows of a language at most
    few = F.broadcast(few.select(F.col("lang").alias("of"), F.col("id").alias("one"), "key"))
    texts = labelled.join(few, (F.col("lang") == F.col("of")) & F.col("id").eqNullSafe(F.col("one"))).groupBy("lang", "key").agg(F.max("text").alias("text"))
    size = F.length("text")
    short = size <= chars_per_lang // 8
    lang = Window.partitionBy("lang")
    upto = F.sum(F.when(short, size)).over(lang.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    least = F.row_number().over(lang.orderBy(size, "key"))
    texts = texts.withColumns({"fits": short & (upto <= chars_per_lang), "some": F.bool_or(short).over(lang), "least": least})
    by_lang: dict[str, list[str]] = {}
    for r in texts.where("fits or not some and least = 1").select("lang", "key", "text").orderBy("lang", "key").collect():
        by_lang.setdefault(r["lang"], []).append(letters(r["text"]))
    n = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row per language
    return {k: " ".join(v).encode("utf-8", "surrogatepass") for k, v in sorted(by_lang.items(), key=lambda x: (-n[x[0]], x[0]))}


def _near_first(ids: DataFrame, n: int, digits: int) -> DataFrame:
    """The rows up to the first leading digits of the key at which a language has n rows, or all of them.

    Rows are counted by these digits, so a language's rows are never brought together; what is broadcast is a row
    for each language, as is the model itself.
    """
    per = ids.groupBy("lang", F.substring("key", 1, digits).alias("lead")).agg(F.count("*").alias("held"))
    upto = F.sum("held").over(Window.partitionBy("lang").orderBy("lead"))
    cut = per.withColumn("upto", upto).where(F.col("upto") >= n).groupBy(F.col("lang").alias("of")).agg(F.min("lead").alias("cut"))
    near = ids.join(F.broadcast(cut), F.col("lang") == F.col("of"), "left")
    return near.where(F.col("cut").isNull() | (F.substring("key", 1, digits) <= F.col("cut"))).drop("of", "cut")


def letters(text: str) -> str:
    return _OTHER.sub(" ", text.lower())


class Classifier:
    """One per task."""

    def __init__(self, model: dict[str, bytes], level: int = LEVEL):
        self.by_lang = []
        for lang, sample in model.items():
            d = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by_lang.append((lang, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False)))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.by_lang or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        if len(self.by_lang) == 1:
            return self.by_lang[0][0], 1.0
        raw = letters(text).encode("utf-8", "surrogatepass")
        parts = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
        # the frame around an empty text is no evidence
        (first, k), (second, _) = sorted((sum(len(c.compress(p)) - 9 for p in parts), k) for k, (_, c) in enumerate(self.by_lang))[:2]
        return self.by_lang[k][0], max(0.0, min(1.0, (second - first) / max(second, 1)))


def identify(docs: DataFrame, model: dict[str, bytes], text_col: str = "text", out: str = "lang_id", level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """Adds ``out``: a struct of lang_pred, score (the margin) and rejected."""

    @F.pandas_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(model, level)
        for s in texts:
            found = pd.DataFrame([classifier.predict(t) for t in s], columns=["lang_pred", "score"])
            yield found.assign(rejected=(found.lang_pred == UNDETERMINED) | (found.score < margin))

    return docs.withColumn(out, run(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that no model is trained on."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2
