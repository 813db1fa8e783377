"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is cut by the vocabulary's pattern; each match is encoded by itself.  The library sees a
match as characters that stand for its bytes (one character per byte), so every token is a run
of bytes, and its offsets within the match give byte positions, which are mapped back to
characters.  Matches repeat, so a task encodes each one once and keeps the result while the
table is small; a full table is dropped, never the text.

Decoding reverses the table of byte characters and joins bytes, so characters that are split
between tokens come out whole; bytes that are no UTF-8 become U+FFFD in ``decode_text`` only.

Null texts count as empty and have no tokens.  Texts are encoded whole, whatever their length.
Special tokens' names are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .common import text_or_empty

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Encoded matches that a task remembers, and the longest match that it does.
REMEMBERED, LONGEST = 600_000, 64


@lru_cache(1)
def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Codec:
    """One per task."""

    def __init__(self, vocabulary: str = VOCABULARY, ranks: str = RANKS):
        path = public_tokenizers.path(vocabulary)
        self.model = Tokenizer.from_file(path)
        self.model.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)  # a match is not cut again
        self.model.encode_special_tokens = True
        self.match = regex.compile(public_tokenizers.PATTERN).findall
        with open(public_tokenizers.path(ranks), "rb") as f:
            by_bytes = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        with open(path, encoding="utf-8") as f:
            named = json.load(f)["model"]["vocab"]
        self.bytes_of = [b""] * (max(named.values()) + 1)
        self.rank_of = np.full(len(self.bytes_of), -1, np.int64)
        for name, i in named.items():
            # the end-of-text name has no rank; it never comes out of an ordinary text
            if (b := bytes(byte_of[c] for c in name)) in by_bytes:
                self.bytes_of[i], self.rank_of[i] = b, by_bytes[b]
        self.of_rank = {int(r): self.bytes_of[i] for i, r in enumerate(self.rank_of) if r >= 0}
        self.known: dict[str, bytes] = {}

    def _learn(self, matches: list[str]) -> None:
        e = self.model.encode(matches, is_pretokenized=True, add_special_tokens=False)
        ranks = self.rank_of[e.ids].astype("<u4")
        ends = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(matches)), "right") * 4
        raw, start = ranks.tobytes(), 0
        for m, end in zip(matches, ends.tolist(), strict=True):
            self.known[m] = raw[start:end]
            start = end

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        found = self.match(text)
        if len(self.known) > REMEMBERED:
            self.known = {}
        if new := list({m for m in found if m not in self.known}):
            self._learn(new)
        ids = b"".join(map(self.known.__getitem__, found))
        for m in new:
            if len(m) > LONGEST:
                del self.known[m]
        return ids

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.of_rank.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: str, ids: bytes) -> list[int]:
        """The character in which each token begins: whole characters before its first byte."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        sizes = np.array([len(self.of_rank[i]) for i in np.frombuffer(ids, "<u4").tolist()], np.int64)
        starts = np.cumsum(sizes) - sizes
        return character[starts].tolist() if len(starts) else []


def encode(docs: DataFrame, text_col: str = "text", out: str = "ids", vocabulary: str = VOCABULARY, ranks: str = RANKS, offsets: bool = False) -> DataFrame:
    """Adds ``out`` (the ids), or with ``offsets`` a struct of ids and character offsets."""

    @F.pandas_udf("struct<ids:array<int>,offsets:array<int>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(vocabulary, ranks)
        for s in texts:
            ids = [codec.encode(t) for t in s]
            ints = [np.frombuffer(i, "<u4").astype(np.int32) for i in ids]
            yield pd.DataFrame({"ids": ints, "offsets": [codec.offsets(t, i) if offsets else [] for t, i in zip(s, ids, strict=True)]})

    both = docs.withColumn(out, run(text_or_empty(text_col)))
    return both if offsets else both.withColumn(out, F.col(out)["ids"])


def decode(docs: DataFrame, ids_col: str = "ids", out: str = "decoded", vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """Adds ``out``, the bytes of the ids; null ids give null."""

    @F.pandas_udf("binary")
    def run(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(vocabulary, ranks)
        for s in ids:
            yield pd.Series([None if i is None else codec.decode(np.asarray(i, "<u4").tobytes()) for i in s])

    return docs.withColumn(out, run(ids_col))


def decode_text(docs: DataFrame, ids_col: str = "ids", out: str = "decoded", **kw) -> DataFrame:
    """Like ``decode``, but as text, with U+FFFD for bytes that are no UTF-8."""

    @F.pandas_udf("string")
    def as_text(raw: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else bytes(b).decode("utf-8", "replace") for b in raw])

    return decode(docs, ids_col, out, **kw).withColumn(out, as_text(out))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: both directions in one pass over the texts."""

    @F.pandas_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(vocabulary, ranks)
        for s in texts:
            ids = [codec.encode(t) for t in s]
            yield pd.DataFrame(
                {
                    "n_tokens": [len(i) // 4 for i in ids],
                    "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                    "decoded_sha256": [hashlib.sha256(codec.decode(i)).hexdigest() for i in ids],
                }
            )

    return docs.select(F.col(id_col), run(text_or_empty(text_col)).alias("r")).select(id_col, "r.*")
