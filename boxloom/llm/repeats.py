"""Removal of every byte that a 100-byte string with an earlier occurrence covers.

The method asked for is external induced suffix sorting with disk-backed priority queues; README
says why it is not used.  What takes its place keeps the idea of sorting suffixes outside memory, but
lets Spark's external sort do it, and only for the suffixes that can matter:

1. Each window of ``LENGTH`` bytes has an anchor: the ``K``-byte string in it with the smallest
   hash, the first of equals.  Equal windows have equal anchors at equal places, so windows
   only need comparing under one anchor.  A run of windows with one anchor is a context.
2. Each task settles equal contexts among its own documents, all but the first of which are
   repeats.  The others are sorted by (anchor, content, document, start), and all but the first of
   equal contexts are repeats.  An anchor with one content needs nothing more.
3. Where an anchor has several contents, the bytes of each one's first occurrence are dealt by anchor
   and sorted by (anchor, document, start), and all but the first of equal windows are repeats.

Within a task and among windows, hashes only bring together what may be equal, and bytes decide.
Contexts of different tasks are equal if 146 bits agree: 64 of the anchor, 64 and 18 more of the content.
Anchors with more than ``HOT`` contents are dealt by window instead, which no number of different
contents under one anchor can make hot.  Every pass streams over sorted partitions and holds
a bounded part, and of a string that goes on beyond it the different contents.

Null texts are empty.  Rows that agree in id and text are one document, as neither starts
earlier; rows that agree in the id only are ordered by a hash of their texts.  Null ids come
before all others.  Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_or_empty

LENGTH = 100
K = 32
#: Bytes of a segment; positions within it take 20 bits.
SEGMENT = 1 << 20
#: Contexts that are compared under one anchor, before they are dealt by window.
HOT = 1 << 12
#: Bytes that are compared at a time, and contexts that a task collects before it settles them.
SHARD = 1 << 21
SETTLE = 200_000
#: Windows of one packed run.
MOST = 1 << 24
#: Flags of a packed run of windows.
SETTLED, HOT_FLAG = 1, 2
#: Starts take 36 bits, counts 25.  Contexts need 7 bits of these, and carry a second hash in the upper 18.
EXTRA = 9
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)


class Hashes:
    """Hashes of all substrings of a segment, from running sums modulo 2**64."""

    _up = _down = np.ones(1, np.uint64)

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        if len(Hashes._up) <= n:
            Hashes._up, Hashes._down = np.full((2, n * 5 // 4 + 1), _BASE, np.uint64)
            Hashes._down[:] = _INVERSE
            Hashes._up[0] = Hashes._down[0] = 1
            Hashes._up, Hashes._down = np.cumprod(Hashes._up), np.cumprod(Hashes._down)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * Hashes._up[:n])])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * Hashes._down[starts]
        h ^= h >> np.uint64(31)
        h *= _MIX
        return h ^ (h >> np.uint64(29))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def contexts(raw: np.ndarray, length: int = LENGTH, k: int = K):
    """anchor hash, content hash, 18 bits of another, first window start and number of windows of each context."""
    out = []
    for base in range(0, max(len(raw) - length + 1, 0), SEGMENT - length):
        seg = raw[base : base + SEGMENT]
        h = Hashes(seg)
        n = len(seg) - k + 1
        at = np.arange(n)
        x = h.of(at, at + k)
        v = (x & ~np.uint64(SEGMENT - 1)) | at.astype(np.uint64)
        least = (_sliding_min(v, length - k + 1) & np.uint64(SEGMENT - 1)).astype(np.int64)
        least = least[: SEGMENT - length]  # later windows belong to the next segment
        first = np.flatnonzero(np.diff(least, prepend=-1))
        count = np.diff(first, append=len(least))
        content = h.of(first, first + count - 1 + length)
        # a second hash, of the parts before and after the middle
        half = first + (count - 1 + length) // 2
        extra = (h.of(first, half) * _MIX ^ h.of(half, first + count - 1 + length)) * _MIX >> np.uint64(46)
        out.append((x[least[first]].view(np.int64), content.view(np.int64), extra.astype(np.int64), first + base, count))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def packed(start: np.ndarray, count: np.ndarray, flags=0) -> np.ndarray:
    """A run of windows: its first start, how many, and flags."""
    return start << 27 | count << 2 | flags


def _start(at: np.ndarray) -> np.ndarray:
    return at >> 27


def _count(at: np.ndarray) -> np.ndarray:
    return at >> 2 & (1 << 25) - 1


def _expanded(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run, end to end."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` (8 or more) bytes from a are those from b, row by row."""
    words = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), 0, (1,))
    out = np.ones(len(a), bool)
    for k in range(0, len(a), 1 << 15):
        part = slice(k, k + (1 << 15))
        for step in range(0, int(size[part].max()), 8):
            at = np.minimum(step, size[part] - 8)
            out[part] &= words[a[part] + at] == words[b[part] + at]
    return out


def firsts(raw: np.ndarray, at: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each string, the row of the first string equal to it; rows come in their order."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    begins = np.append(True, h[1:] != h[:-1])
    lead = order[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
    rest = order[~begins]
    lead = lead[~begins]
    same = size[rest] == size[lead]
    same[same] = same_bytes(raw, at[rest[same]], at[lead[same]], size[rest[same]])
    out = np.arange(len(at))
    out[rest[same]] = lead[same]
    if not same.all():  # equal hashes of different strings
        known: dict[bytes, int] = {}
        for k in np.sort(rest[~same]).tolist():
            out[k] = known.setdefault(raw[at[k] : at[k] + size[k]].tobytes(), k)
    return out


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _longs(b: pa.RecordBatch, n: int) -> list[np.ndarray]:
    return [b.column(k).to_numpy(zero_copy_only=False) for k in range(n)]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, content, doc, mark, at of the contexts of (doc, mark, text)."""
    for b in batches:
        docs, marks = _longs(b, 2)
        parts, raws, held, base = [], [], 0, 0
        for k, text in enumerate(b.column(2)):
            raw = _bytes(text.as_py())
            anchor, content, extra, start, count = contexts(raw)
            if len(anchor):
                parts.append((anchor, content, extra, np.full(len(anchor), docs[k]), np.full(len(anchor), marks[k]), start, count, start + base))
                raws.append(raw)
                held, base = held + len(anchor), base + len(raw)
            if parts and (held > SETTLE or k + 1 == b.num_rows):
                yield _settled(parts, raws)
                parts, raws, held, base = [], [], 0, 0
        if parts:
            yield _settled(parts, raws)


def _settled(parts: list, raws: list) -> pa.RecordBatch:
    """The contexts of some documents; all but the first of equal ones are settled.

    Settled contexts only pass through what follows, so they are dealt by a hash of their place.
    """
    anchor, content, extra, doc, mark, start, count, place = (np.concatenate(c) for c in zip(*parts, strict=True))
    raw = np.concatenate(raws)
    order = np.lexsort((start, mark, doc))
    anchor, content, extra, doc, mark, start, count, place = (c[order] for c in (anchor, content, extra, doc, mark, start, count, place))
    first = firsts(raw, place, count + LENGTH - 1, content ^ anchor)
    own = (doc == doc[first]) & (mark == mark[first]) & (start == start[first])
    settled = ~own
    spread = (start.view(np.uint64) * _MIX) ^ doc.view(np.uint64)
    anchor = np.where(settled, spread.view(np.int64), anchor)
    # rows that repeat a whole document say nothing new
    keep = settled | (first == np.arange(len(first)))
    at = packed(start, count, settled * SETTLED) | np.where(settled, 0, extra << EXTRA)
    return _batch(["anchor", "content", "doc", "mark", "at"], [c[keep] for c in (anchor, np.where(settled, 0, content), doc, mark, at)])


def _batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contexts sorted by (anchor, content): the repeats, settled, and the first of each content
    of an anchor that has several."""
    names = ["anchor", "doc", "mark", "at"]
    last = lead = None  # the content before; where its first context is
    held, hot = None, None  # the first contexts of the newest anchor, or the anchor itself if it is hot
    for b in batches:
        anchor, content, doc, mark, at = _longs(b, 5)
        settled = at & SETTLED > 0
        if settled.any():
            yield _batch(names, [np.zeros(settled.sum(), np.int64), doc[settled], mark[settled], at[settled]])
            anchor, content, doc, mark, at = (c[~settled] for c in (anchor, content, doc, mark, at))
        if not len(anchor):
            continue
        extra = at >> EXTRA & (1 << 18) - 1
        at = at ^ extra << EXTRA
        begins = np.append(True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]) | (extra[1:] != extra[:-1]))
        begins[0] = (anchor[0], content[0], extra[0]) != last
        last = anchor[-1], content[-1], extra[-1]
        heads, run = np.flatnonzero(begins), np.cumsum(begins) - 1
        first = [doc[heads], mark[heads], at[heads]]
        if run[0] < 0:
            first, run = [np.append(x, c) for x, c in zip(lead, first, strict=True)], run + 1
        lead = [c[-1] for c in first]
        repeat = ~begins & ((doc != first[0][run]) | (mark != first[1][run]) | (at != first[2][run]))
        yield _batch(names, [np.zeros(repeat.sum(), np.int64), doc[repeat], mark[repeat], at[repeat] | SETTLED])
        rows = [c[heads] for c in (anchor, doc, mark, at)]
        if held is not None:
            rows = [np.append(x, y) for x, y in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        run = np.cumsum(np.append(True, rows[0][1:] != rows[0][:-1])) - 1
        size = np.bincount(run)
        is_hot = size > HOT
        if hot is not None and rows[0][0] == hot:
            is_hot[0] = True
        hot = rows[0][-1] if is_hot[-1] else None
        newest = (run == run[-1]) & (hot is None)
        held = [c[newest] for c in rows]
        out = ((size > 1) | is_hot)[run] & ~newest
        rows[3] = rows[3] | is_hot[run] * HOT_FLAG
        yield _batch(names, [c[out] for c in rows])
    if held is not None and len(held[0]) > 1:
        yield _batch(names, held)


def _cut_out(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of some strings, end to end."""
    return raw[_expanded(start, size)]


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, doc, mark, at, bytes of the contexts that (doc, mark, text, found) lists."""
    names = ["key", "doc", "mark", "at", "bytes"]
    before = None
    for b in batches:
        docs, marks = _longs(b, 2)
        parts, held = [], 0
        for k, (text, found) in enumerate(zip(b.column(2), b.column(3), strict=True)):
            if (docs[k], marks[k]) == before:  # a row that repeats the last one
                continue
            before = docs[k], marks[k]
            at, one = np.unique(found.values.field("at").to_numpy(zero_copy_only=False), return_index=True)
            key = found.values.field("anchor").to_numpy(zero_copy_only=False)[one]
            raw = _bytes(text.as_py())
            hot = at & HOT_FLAG > 0
            if hot.any():
                every = _expanded(_start(at[hot]), _count(at[hot]))
                hashes = np.concatenate([_window_hashes(raw, every[k : k + SEGMENT]) for k in range(0, len(every), SEGMENT)])
                key, at = np.append(key[~hot], hashes), np.append(at[~hot], packed(every, 1))
            settled = at & SETTLED > 0
            if settled.any():
                # settled ones only pass through: neighbours as one, dealt by a hash of the document
                runs = _merged(_start(at[settled]), _count(at[settled])) | SETTLED
                own = np.array([docs[k]], np.int64).view(np.uint64) * _MIX
                key, at = np.append(key[~settled], np.repeat((own ^ own >> np.uint64(29)).view(np.int64), len(runs))), np.append(at[~settled], runs)
                settled = at & SETTLED > 0
            size = np.where(settled, 0, LENGTH - 1 + _count(at))
            for low in range(0, len(at), 1 << 14):
                part = slice(low, low + (1 << 14))
                data = _cut_out(raw, _start(at[part]), size[part])
                parts.append((key[part], np.full(len(at[part]), docs[k]), np.full(len(at[part]), marks[k]), at[part], size[part], data))
                held += len(data)
                if held > SHARD:
                    yield _batch(names, _with_bytes(parts))
                    parts, held = [], 0
        if parts:
            yield _batch(names, _with_bytes(parts))


def _merged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Runs of windows, in order, with those that follow each other made one."""
    begins = np.flatnonzero(np.append(True, start[1:] != start[:-1] + count[:-1]))
    total = np.add.reduceat(count, begins)
    # a count has 25 bits
    pieces = -(-total // MOST)
    first = np.repeat(start[begins], pieces) + (_expanded(np.zeros(len(pieces), np.int64), pieces) * MOST)
    return packed(first, np.minimum(np.repeat(start[begins] + total, pieces) - first, MOST))


def _window_hashes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    data = _cut_out(raw, starts, np.full(len(starts), LENGTH))
    h = np.zeros(len(starts), np.uint64)
    # what this leaves out if the length is no multiple of four only makes keys less even
    for column in data.reshape(-1, LENGTH)[:, : LENGTH // 4 * 4].copy().view("<u4").T:
        h = (h ^ column) * _MIX
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _with_bytes(parts: list) -> list:
    *columns, size, data = (np.concatenate(c) for c in zip(*parts, strict=True))
    ends = np.append(0, np.cumsum(size)).astype(np.int32)
    return [*columns, pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, mark, at of the repeats among strings sorted by (key, doc, mark, at)."""
    held: list[list[np.ndarray]] = []
    size = 0
    for b in batches:
        strings = b.column(4)
        ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
        data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(strings) else np.zeros(0, np.uint8)
        held.append([*_longs(b, 4), np.diff(ends).astype(np.int64), data])
        size += len(data)
        if size > SHARD:
            out, rest = _repeats(*(np.concatenate(c) for c in zip(*held, strict=True)))
            yield out
            held, size = [rest], 0
    if held:
        yield _repeats(*(np.concatenate(c) for c in zip(*held, strict=True)))[0]


def _repeats(key, doc, mark, at, size, data) -> tuple[pa.RecordBatch, list[np.ndarray]]:
    """The repeats among the strings, and the different strings of the last key."""
    settled = size == 0
    done = doc[settled], mark[settled], at[settled]
    key, doc, mark, at, size = (c[~settled] for c in (key, doc, mark, at, size))
    if not len(key):
        return _batch(["doc", "mark", "at"], list(done)), [key, doc, mark, at, size, data]
    place, start, count = np.cumsum(size) - size, _start(at), _count(at)
    hashes = Hashes(data)
    first = firsts(data, place, size, hashes.of(place, place + size).view(np.int64) ^ key)
    again = (doc != doc[first]) | (mark != mark[first]) | (start != start[first])
    head = np.flatnonzero(first == np.arange(len(first)))
    # windows of the different strings of keys that have several
    many = np.append(False, key[head][1:] == key[head][:-1])
    many |= np.append(many[1:], False)
    h = head[many]
    row, windows = np.repeat(h, count[h]), _expanded(place[h], count[h])
    starts = _expanded(start[h], count[h])
    f = firsts(data, windows, np.full(len(windows), LENGTH), hashes.of(windows, windows + LENGTH).view(np.int64) ^ key[row]) if len(windows) else windows
    r = np.flatnonzero((doc[row] != doc[row[f]]) | (mark[row] != mark[row[f]]) | (starts != starts[f]))
    # neighbouring windows of one string make one run
    begins = np.flatnonzero(np.append(True, (row[r][1:] != row[r][:-1]) | (np.diff(r) != 1))) if len(r) else r
    runs = packed(starts[r[begins]], np.diff(np.append(begins, len(r))))
    out = [np.concatenate(c) for c in zip(done, (doc[again], mark[again], at[again]), (doc[row[r[begins]]], mark[row[r[begins]]], runs), strict=True)]
    last = head[key[head] == key[-1]]
    return _batch(["doc", "mark", "at"], out), [key[last], doc[last], mark[last], at[last], size[last], _cut_out(data, place[last], size[last])]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, doc, mark, text: doc and mark stand for the document in all that follows.

    The mark is a hash of the text where ids repeat or are null, and zero, which compresses
    better, where none do.
    """
    text = text_or_empty(text_col)
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    unique = docs.groupBy(doc.alias("doc")).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    mark = F.lit(0).cast("long") if unique else F.xxhash64(text)
    return docs.select(F.col(id_col).alias("id"), doc.alias("doc"), mark.alias("mark"), text.alias("text"))


def repeats(rows: DataFrame) -> DataFrame:
    """doc, mark, at: the runs of windows to remove (see ``packed``).

    ``rows`` comes from ``keyed``.  Texts are dealt by (doc, mark) with all their columns, just
    as ``remove_repeats`` needs them again, so that Spark reuses that one exchange.
    """
    found = rows.select("doc", "mark", "text").where(F.octet_length("text") >= LENGTH).mapInArrow(_contexts, "anchor long, content long, doc long, mark long, at long")
    found = found.repartition("anchor").sortWithinPartitions("anchor", "content", F.shiftright("at", EXTRA).bitwiseAND(F.lit((1 << 18) - 1)), "doc", "mark", "at").mapInArrow(_met, "anchor long, doc long, mark long, at long")
    found = found.groupBy("doc", "mark").agg(F.collect_list(F.struct("at", "anchor")).alias("found"))
    strings = rows.join(found, ["doc", "mark"]).select("doc", "mark", "text", "found", "id").mapInArrow(_strings, "key long, doc long, mark long, at long, bytes binary")
    return strings.repartition("key").sortWithinPartitions("key", "doc", "mark", "at").mapInArrow(_compared, "doc long, mark long, at long")


def _cut(text: str, ats) -> tuple[np.ndarray, int, bytes]:
    raw = _bytes(text)
    gone = np.zeros(len(raw) + 1, np.int32)
    if ats is not None and len(ats):
        at = np.asarray(ats, np.int64)
        np.add.at(gone, _start(at), 1)
        np.add.at(gone, _start(at) + _count(at) - 1 + LENGTH, -1)
    covered = np.cumsum(gone[:-1]) > 0
    spans = int(np.count_nonzero(np.diff(covered.astype(np.int8), prepend=0) == 1))
    return covered, spans, raw[~covered].tobytes()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 [, kept (bytes)]."""
    rows = keyed(docs, id_col, text_col)
    ranges = repeats(rows).groupBy("doc", "mark").agg(F.collect_list("at").alias("ats"))
    kept = ",kept:binary" if keep_bytes else ""

    @F.pandas_udf(f"struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string{kept}>")
    def run(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        out = []
        for t, ats in zip(texts, lists, strict=True):
            covered, spans, rest = _cut(t, ats)
            out.append((len(covered), len(covered) - len(rest), spans, hashlib.sha256(rest).hexdigest()) + ((rest,) if keep_bytes else ()))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes)

    return rows.join(ranges, ["doc", "mark"], "left").select(F.col("id").alias(id_col), run("text", "ats").alias("r")).select(id_col, "r.*")
