"""Order-dependent box consolidation.

The greedy rules depend on what was kept before, so they have no join form.  But boxes act on each other only where they
come near, whatever grows meanwhile: where a stripe across the page is free of boxes, those on both sides never
meet.  Pages with more than ``PAGE`` boxes are cut along such stripes, across and along in turn (``scan.parted``), and each
piece is worked on by itself, so that no task needs a page.  How finely a page is cut changes no result.

Spark brings each piece's boxes together in order; a task streams over its pieces.  Within a piece, boxes find each other in
the cells of a grid.  Null pages are one page; a box with a null side stays as it is and meets none, a null confidence is the least.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import stored
from .scan import parted, running

BOX = ["x", "y", "width", "height"]
#: Boxes of a page, from which it is cut, and of a piece, from which a grid pays.
PAGE, GRID = 2_000, 24
#: Cuts: across the page, along it, and again.
CUTS = ("y", "x", "y", "x")

#: Works on lists of boxes [x, y, width, height], confidences and types, which it may change; gives the rows that stay, in order.
Rule = Callable[[list, list, list], list]


def pieces(blocks: DataFrame, margin: float, cuts: tuple[str, ...] = CUTS, most: int | None = None) -> DataFrame:
    """Adds ``__piece`` (null on pages that are whole), such that boxes of different pieces lie more than ``margin`` apart."""
    large = blocks.groupBy("page_id").agg(F.count("*").alias("n")).where(F.col("n") > (PAGE if most is None else most)).select(F.col("page_id").alias("__page"))
    whole = blocks.withColumn("__piece", F.lit(None).cast("string"))
    if large.isEmpty():
        return whole
    same = F.col("page_id").eqNullSafe(F.col("__page"))
    cut = whole.join(large, same, "left_semi")
    for axis in cuts:
        side = F.greatest(F.lit(0.0), F.col({"x": "width", "y": "height"}[axis]))
        cut = parted(cut, ["page_id", "__piece"], F.col(axis), F.col(axis) + side, margin, "__part")
        cut = cut.withColumn("__piece", F.concat_ws("/", F.coalesce("__piece", F.lit("")), F.col("__part").cast("string"))).drop("__part")
        # each cut reads its rows several times
        cut = stored(cut)
    return whole.join(large, same, "left_anti").unionByName(cut)


def per_piece(blocks: DataFrame, order: list[str | Column], rule: Rule) -> DataFrame:
    """Runs a rule on the boxes of each (page_id, __piece), in the given order; adds ``order``, the place among those that stay."""
    names = blocks.columns

    def worked(rows: pa.Table) -> pa.RecordBatch:
        column = lambda c, none: rows[c].to_pylist() if c in names else [none] * rows.num_rows
        boxes = [list(b) for b in zip(*(rows[c].cast(pa.float64()).to_pylist() for c in BOX))]
        conf, types, ends = column("confidence", 0.0), column("balloon_type", None), [*_ends(rows), rows.num_rows]
        stay, places = [], []
        for a, b in zip([0, *ends[:-1]], ends):
            full = [k for k in range(a, b) if None not in boxes[k]]
            part, c, t = [boxes[k] for k in full], [-1.0 if conf[k] is None else conf[k] for k in full], [types[k] for k in full]
            kept = rule(part, c, t)
            for k, *changed in zip(full, part, c, t):
                boxes[k], conf[k], types[k] = changed[0], conf[k] if conf[k] is None and changed[1] < 0 else changed[1], changed[2]
            kept = [full[k] for k in kept] + [k for k in range(a, b) if None in boxes[k]]
            stay += kept
            places += range(len(kept))
        out = rows.take(stay)
        changed = {c: [boxes[k][j] for k in stay] for j, c in enumerate(BOX)} | {"confidence": [conf[k] for k in stay], "balloon_type": [types[k] for k in stay]}
        for c, v in changed.items():
            if c in names:
                out = out.set_column(names.index(c), c, pa.array(v, pa.float64() if c in BOX else None).cast(rows.schema.field(c).type))
        return out.append_column("order", pa.array(places, pa.int32())).combine_chunks().to_batches() or []

    return _streamed(blocks, order, worked)


def _streamed(blocks: DataFrame, order: list[str | Column], worked: Callable) -> DataFrame:
    """Brings each (page_id, __piece) together in the given order; ``worked`` adds ``order`` to a table of some of them, each whole."""
    schema = blocks.withColumn("order", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        for b in batches:
            if not b.num_rows:
                continue
            if parts and _key(parts[-1], -1) != _key(b, 0):
                yield from worked(pa.Table.from_batches(parts))
                parts = []
            ends = _ends(b)
            if len(ends):
                yield from worked(pa.Table.from_batches([*parts, b.slice(0, ends[-1])]))
                b, parts = b.slice(ends[-1]), []
            if b.num_rows:
                parts.append(b)
        if parts:
            yield from worked(pa.Table.from_batches(parts))

    return blocks.repartition("page_id", "__piece").sortWithinPartitions("page_id", "__piece", *order).mapInArrow(run, schema)


def _key(b: pa.RecordBatch, at: int) -> tuple:
    at = at % b.num_rows
    return b["page_id"][at].as_py(), b["__piece"][at].as_py()


def _ends(rows) -> list[int]:
    """Where a new page or piece begins."""
    return (np.flatnonzero(_new_keys(rows)[1:]) + 1).tolist()


def _new_keys(rows) -> np.ndarray:
    """Whether the page or piece is not the one before."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in ("page_id", "__piece"):
        now, last = rows[c].slice(1), rows[c].slice(0, max(rows.num_rows - 1, 0))
        same = pc.or_(pc.fill_null(pc.equal(now, last), False), pc.and_(pc.is_null(now), pc.is_null(last)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return new


def _applied(blocks: DataFrame, order: list[str | Column], rule: Rule, margin: float) -> DataFrame:
    return per_piece(pieces(blocks, margin), order, rule).drop("__piece", "order")


class Near:
    """Finds the boxes that may meet one, by the cells of a grid; of few boxes, all."""

    def __init__(self, boxes: list, margin: float = 0.0):
        self.margin, self.all = margin, range(len(boxes)) if len(boxes) < GRID else None
        self.side = max(1.0, 2 * sum(b[2] + b[3] for b in boxes) / max(2 * len(boxes), 1) + margin)
        self.cells: dict = defaultdict(list)

    def span(self, b: list, margin: float = 0.0) -> tuple:
        return tuple(int(v // self.side) for v in (b[0] - margin, b[0] + max(b[2], 0) + margin, b[1] - margin, b[1] + max(b[3], 0) + margin))

    def over(self, b: list, old: tuple | None = None, margin: float = 0.0) -> Iterator[tuple]:
        """The cells that a box covers, without those of a smaller span."""
        x0, x1, y0, y1 = self.span(b, margin)
        for y in range(y0, y1 + 1):
            if old and old[2] <= y <= old[3]:
                yield from ((x, y) for x in range(x0, old[0]))
                yield from ((x, y) for x in range(old[1] + 1, x1 + 1))
            else:
                yield from ((x, y) for x in range(x0, x1 + 1))

    def add(self, k: int, b: list, old: tuple | None = None) -> None:
        if self.all is None:
            for cell in self.over(b, old):
                self.cells[cell].append(k)

    def found(self, b: list, old: tuple | None = None) -> set:
        return {k for cell in self.over(b, old, self.margin) if cell in self.cells for k in self.cells[cell]}


def _shared(a: list, b: list) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return w * h if w > 0 and h > 0 else 0.0


def _union(a: list, b: list) -> list:
    x, y = min(a[0], b[0]), min(a[1], b[1])
    return [x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y]


def first_wins(blocks: DataFrame, limit: float = 0.82) -> DataFrame:
    """Drops a box whose intersection over union with a kept earlier one reaches ``limit`` (above 0)."""

    def rule(boxes: list, conf: list, types: list) -> list:
        near, kept = Near(boxes), []
        for k, b in enumerate(boxes):
            for j in kept if near.all else near.found(b):
                s = _shared(b, boxes[j])
                if s and s / max(1.0, b[2] * b[3] + boxes[j][2] * boxes[j][3] - s) >= limit:
                    break
            else:
                kept.append(k)
                near.add(k, b)
        return kept

    return _applied(blocks, ["block_index", "block_id"], rule, 0.0)


def suppress(blocks: DataFrame, limit: float = 0.5) -> DataFrame:
    """Strongest first; a box goes if a kept one of its type overlaps it too much.

    Bubbles that nearly share their columns grow the kept one to the union instead, and later
    boxes are measured against the grown one.
    """

    def rule(boxes: list, conf: list, types: list) -> list:
        near, kept, place = Near(boxes), [], {}
        for k, b in enumerate(boxes):
            mine = max(1.0, b[2] * b[3])
            for j in kept if near.all else sorted(near.found(b), key=place.__getitem__):
                a = boxes[j]
                if types[j] != types[k] or not (s := _shared(a, b)):
                    continue
                other = max(1.0, a[2] * a[3])
                if s / max(1.0, mine + other - s) > limit or s / min(mine, other) > 0.30:
                    along = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
                    if types[k] in ("balloon", "bubble") and along / max(1e-9, min(a[2], b[2])) > 0.75 and min(conf[j], conf[k]) >= 0.25:
                        boxes[j] = _union(a, b)
                        near.add(j, boxes[j], near.span(a))
                    break
            else:
                place[k] = len(kept)
                kept.append(k)
                near.add(k, b)
        return kept

    return _applied(blocks, [F.desc("confidence"), "block_index", "block_id"], rule, 0.0)


def _absorb(k: int, boxes: list, free: list, near: Near, meets, taken) -> None:
    """Box k grows over free boxes that it meets, in their order, once through; again while it grows, if ``taken`` says so."""
    waiting = set(near.all[k + 1 :]) if near.all else near.found(boxes[k])
    again = True
    while again:
        heap, again, at = sorted(j for j in waiting if free[j]), False, -1
        while heap:
            j = heapq.heappop(heap)
            if j <= at or not free[j]:
                continue
            at = j
            if meets(boxes[k], boxes[j]):
                old = near.span(boxes[k], near.margin)
                boxes[k] = _union(boxes[k], boxes[j])
                free[j] = False
                again = taken(k, j)
                if not near.all:
                    for n in near.found(boxes[k], old) - waiting:
                        if free[n]:
                            waiting.add(n)
                            if n > j:
                                heapq.heappush(heap, n)


def _merged(blocks: DataFrame, meets, margin: float) -> DataFrame:
    def rule(boxes: list, conf: list, types: list) -> list:
        free, near, out = [True] * len(boxes), Near(boxes, margin), []
        for k, b in enumerate(boxes):
            near.add(k, b)

        def taken(k: int, j: int) -> bool:
            if conf[j] > conf[k]:
                conf[k], types[k] = conf[j], types[j]
            return True

        for k in range(len(boxes)):
            if free[k]:
                free[k] = False
                _absorb(k, boxes, free, near, meets, taken)
                out.append(k)
        return out

    return _applied(blocks, ["y", "x", "block_index", "block_id"], rule, margin)


def merge_near(blocks: DataFrame, distance: float = 20) -> DataFrame:
    """Absorbs boxes within ``distance`` of the growing hull on both axes, until none is left."""

    def meets(a: list, b: list) -> bool:
        return max(a[0], b[0]) - min(a[0] + a[2], b[0] + b[2]) <= distance and max(a[1], b[1]) - min(a[1] + a[3], b[1] + b[3]) <= distance

    return _merged(blocks, meets, distance)


def merge_overlapping(blocks: DataFrame, limit: float = 0.25) -> DataFrame:
    """As ``merge_near``, for boxes that share ``limit`` of the smaller one or of their union."""
    limit = max(0.25, limit)

    def meets(a: list, b: list) -> bool:
        s = _shared(a, b)
        mine, other = max(1.0, a[2] * a[3]), max(1.0, b[2] * b[3])
        return s / min(mine, other) >= limit or s / max(1.0, mine + other - s) >= limit

    return _merged(blocks, meets, 0.0)


def merge_padded(blocks: DataFrame, margin: int = 35) -> DataFrame:
    """Boxes that meet once ``margin`` is put around them (never above zero) become one, pass after pass, until none do.

    In a pass a box grows over all later ones that it meets on the way.  Sides are whole numbers.
    """

    def meets(a: list, b: list) -> bool:
        return all(max(0, a[d] - margin) <= b[d] + b[d + 2] + margin and max(0, b[d] - margin) <= a[d] + a[d + 2] + margin for d in (0, 1))

    def rule(boxes: list, conf: list, types: list) -> list:
        boxes[:] = [[float(int(v)) for v in b] for b in boxes]
        rows = list(range(len(boxes)))
        while True:
            now = [boxes[k] for k in rows]
            # the clamp at zero only makes boxes meet less
            free, near, stay = [True] * len(now), Near(now, 2 * margin), []
            for k, b in enumerate(now):
                near.add(k, b)
            for k in range(len(now)):
                if free[k]:
                    free[k] = False
                    _absorb(k, now, free, near, meets, lambda k, j: False)
                    stay.append(k)
            for k, b in zip(rows, now):
                boxes[k] = b
            if len(stay) == len(rows):
                return stay if rows == list(range(len(boxes))) else rows
            rows = [rows[k] for k in stay]

    # whole numbers are up to one below
    return _applied(blocks, ["block_index", "block_id"], rule, 2 * margin + 2)


def row_clusters(blocks: DataFrame, near: float = 60, right_to_left: bool = True) -> DataFrame:
    """Adds order, from 0: boxes by y join the first row whose running mean y is near.

    A row's mean never lies below its last box, so a page is cut wherever the next y is more than ``near`` away.
    """

    def rows_of(ys: list) -> Iterator[int]:
        """The row of each box, given their y in order."""
        rows, active = [], []
        for y in ys:
            # a row that has fallen behind is never joined again
            active = [r for r in active if y - r[0] / r[1] <= near]
            if not active:
                active.append([0.0, 0, len(rows)])
                rows.append(active[0])
            active[0][0] += y
            active[0][1] += 1
            yield active[0][2]

    def placed(rows: pa.Table) -> pa.RecordBatch:
        n = rows.num_rows
        x, y = (rows[c].cast(pa.float64()).to_numpy() for c in ("x", "y"))
        none = np.any([rows[c].is_null().to_numpy() for c in ("x", "y", "width")], axis=0)
        new = _new_keys(rows)
        page, full = np.cumsum(new), np.flatnonzero(~none)
        part = np.zeros(n, np.int64)
        if len(full):
            fy, fp = y[full], page[full]
            # what begins far below the one before begins a row; a stretch no longer than ``near`` is one row
            begins = np.append(True, (fp[1:] != fp[:-1]) | ~(fy[1:] - fy[:-1] <= near))
            start = np.flatnonzero(begins)
            stretch = np.cumsum(begins) - 1
            row = np.zeros(len(full), np.int64)
            for k in np.unique(stretch[~begins & ~(fy - fy[start[stretch]] <= near)]):
                a, b = start[k], start[k + 1] if k + 1 < len(start) else len(full)
                row[a:b] = list(rows_of(fy[a:b].tolist()))
            # of stretches, then rows
            part[full] = stretch * (int(row.max()) + 1) + row
        by_x = np.where(none, 0.0, -x if right_to_left else x)
        stay = np.lexsort((np.arange(n), by_x, part, none, page))
        begin = np.flatnonzero(new)
        out = rows.take(pa.array(stay))
        return out.append_column("order", pa.array((np.arange(n) - begin[page - 1]).astype(np.int32))).combine_chunks().to_batches() or []

    cut = blocks.drop("order")
    # heights do not matter: pieces are cut by y alone
    flat = cut.withColumn("__height", F.col("height")).withColumn("height", F.lit(0.0))
    cut = pieces(flat, near, ("y",)).withColumn("height", F.col("__height")).drop("__height")
    # no box goes, so that pieces can be counted before
    each = cut.where("__piece IS NOT NULL").groupBy("page_id", "__piece").agg(F.count("*").alias("__n"), F.min("y").alias("__y"))
    before = running(each, ["page_id"], F.floor(F.col("__y") / 1024), ["__y"], {"__before": ("sum", F.col("__n"))}, inclusive=False)
    before = before.select(F.col("page_id").alias("__page"), F.col("__piece").alias("__name"), F.coalesce("__before", F.lit(0)).alias("__before"))
    done = _streamed(cut, ["y", "x", "block_index", "block_id"], placed)
    out = done.join(before, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("__piece") == F.col("__name")), "left")
    return out.withColumn("order", (F.col("order") + F.coalesce("__before", F.lit(0))).cast("int")).drop("__page", "__name", "__before", "__piece")
