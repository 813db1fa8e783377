"""Queries of the order-dependent box rules.  Their SQL walks each page box by box."""

from __future__ import annotations

from ..operators import boxes, consolidate
from .registry import query

_BOXES = ["page_id", "block_id", "block_index", "balloon_type", "confidence", *boxes.BOX]


def _list(order: str, columns: list[str], where: str = "v_blocks") -> str:
    """Pages with their boxes as a list, in order."""
    fields = ", ".join(f"{c} := {c}" for c in columns[1:])
    return f"p AS (SELECT page_id, list(struct_pack({fields}) ORDER BY {order}) AS b FROM {where} GROUP BY page_id)"


def _shared(a: str, b: str) -> str:
    side = lambda c, d: f"greatest(0, least({a}.{c} + {a}.{d}, {b}.{c} + {b}.{d}) - greatest({a}.{c}, {b}.{c}))"
    return f"({side('x', 'width')} * {side('y', 'height')})"


def _iou(a: str, b: str, floor: str) -> str:
    """``floor`` wraps an area."""
    area = lambda o: floor.format(f"{o}.width * {o}.height")
    return f"({_shared(a, b)} / greatest(1, {area(a)} + {area(b)} - {_shared(a, b)}))"


def _smaller(a: str, b: str) -> str:
    return f"({_shared(a, b)} / least(greatest(1, {a}.width * {a}.height), greatest(1, {b}.width * {b}.height)))"


def _union(a: str, b: str, columns: list[str], **other: str) -> str:
    own = {
        "x": f"least({a}.x, {b}.x)", "y": f"least({a}.y, {b}.y)",
        "width": f"greatest({a}.x + {a}.width, {b}.x + {b}.width) - least({a}.x, {b}.x)", "height": f"greatest({a}.y + {a}.height, {b}.y + {b}.height) - least({a}.y, {b}.y)",
    } | other
    return "struct_pack(" + ", ".join(f"{c} := {own.get(c, f'{a}.{c}')}" for c in columns[1:]) + ")"


def _walk(order: str, columns: list[str], hit: str, changed: str) -> str:
    """Keeps a box unless it hits a kept one ``a``; then the first of these becomes ``changed``."""
    return f"""WITH RECURSIVE {_list(order, columns)},
  w AS (SELECT page_id, b, 1 AS k, b[:0] AS kept FROM p
    UNION ALL SELECT page_id, b, k + 1, CASE WHEN pos = 0 THEN list_append(kept, o) ELSE kept[:pos - 1] || [{changed}] || kept[pos + 1:] END
    FROM (SELECT *, kept[pos] AS a FROM (SELECT *, coalesce(list_position(list_transform(kept, lambda a: {hit}), true), 0) AS pos FROM (SELECT *, b[k] AS o FROM w WHERE k <= len(b)))))
  SELECT page_id, unnest(kept, recursive := true) FROM w WHERE k > len(b)"""


def _grow(order: str, columns: list[str], meets: str, union: str, again: bool, source: str = "v_blocks") -> str:
    """Each free box in turn becomes a hull ``h`` and takes free boxes ``o`` that it meets; while it grows once more (``again``), or
    else page after page until no box is taken."""
    repeat, done = ("grown", "TRUE") if again else ("FALSE", "NOT merged")
    return f"""WITH RECURSIVE {_list(order, columns, source)},
  w AS (SELECT page_id, b, list_transform(b, lambda x: false) AS used, 0 AS k, 0 AS j, b[1] AS h, false AS grown, false AS merged, b[:0] AS kept, false AS done FROM p
    UNION ALL SELECT page_id, CASE act WHEN 'page' THEN kept ELSE b END,
      CASE act WHEN 'page' THEN list_transform(kept, lambda x: false) WHEN 'seed' THEN list_transform(used, lambda u, i: u OR i = seed) WHEN 'take' THEN list_transform(used, lambda u, i: u OR i = j) ELSE used END,
      CASE act WHEN 'seed' THEN seed WHEN 'out' THEN 0 WHEN 'page' THEN 0 ELSE k END, CASE act WHEN 'seed' THEN 1 WHEN 'again' THEN 1 ELSE j + 1 END,
      CASE act WHEN 'seed' THEN b[seed] WHEN 'take' THEN {union} ELSE h END, act = 'take' OR act = 'skip' AND grown, CASE act WHEN 'take' THEN true WHEN 'page' THEN false ELSE merged END,
      CASE act WHEN 'out' THEN list_append(kept, h) WHEN 'page' THEN b[:0] ELSE kept END, act = 'end'
    FROM (SELECT *, CASE WHEN k = 0 AND seed > 0 THEN 'seed' WHEN k = 0 AND ({done}) THEN 'end' WHEN k = 0 THEN 'page' WHEN j > len(b) AND {repeat} THEN 'again' WHEN j > len(b) THEN 'out' WHEN NOT used[j] AND {meets} THEN 'take' ELSE 'skip' END AS act
      FROM (SELECT *, coalesce(list_position(used, false), 0) AS seed, b[j] AS o FROM w WHERE NOT done)))
  SELECT page_id, unnest(kept, recursive := true) FROM w WHERE done"""


_IN_ORDER, _DOWN = "block_index, block_id", "y, x, block_index, block_id"
_PLAIN = [c for c in _BOXES if c not in ("balloon_type", "confidence")]
_BEST = {c: f"CASE WHEN o.confidence > h.confidence THEN o.{c} ELSE h.{c} END" for c in ("confidence", "balloon_type")}
_FLOOR = "greatest(1, {})"
_GROWS = "o.balloon_type IN ('balloon', 'bubble') AND (least(a.x + a.width, o.x + o.width) - greatest(a.x, o.x)) / greatest(1e-9, least(a.width, o.width)) > 0.75 AND least(a.confidence, o.confidence) >= 0.25"

query("g1_suppress", _walk(f"confidence DESC, {_IN_ORDER}", _BOXES, f"a.balloon_type = o.balloon_type AND ({_iou('a', 'o', _FLOOR)} > 0.5 OR {_smaller('a', 'o')} > 0.30)", f"CASE WHEN {_GROWS} THEN {_union('a', 'o', _BOXES)} ELSE a END"))(
    lambda t: consolidate.suppress(t.v_blocks.select(*_BOXES)))
query("g2_merge_near", _grow(_DOWN, _BOXES, "greatest(h.x, o.x) - least(h.x + h.width, o.x + o.width) <= 20 AND greatest(h.y, o.y) - least(h.y + h.height, o.y + o.height) <= 20", _union("h", "o", _BOXES, **_BEST), True))(
    lambda t: consolidate.merge_near(t.v_blocks.select(*_BOXES)))
query("g3_merge_overlapping", _grow(_DOWN, _BOXES, f"({_smaller('h', 'o')} >= 0.25 OR {_iou('h', 'o', _FLOOR)} >= 0.25)", _union("h", "o", _BOXES, **_BEST), True))(
    lambda t: consolidate.merge_overlapping(t.v_blocks.select(*_BOXES)))
_MEETS = " AND ".join(f"greatest(0, h.{c} - 35) <= o.{c} + o.{d} + 35 AND greatest(0, o.{c} - 35) <= h.{c} + h.{d} + 35" for c, d in (("x", "width"), ("y", "height")))
query("g4_padded", _grow(_IN_ORDER, _BOXES, _MEETS, _union("h", "o", _BOXES), False, "(SELECT * REPLACE (trunc(x) AS x, trunc(y) AS y, trunc(width) AS width, trunc(height) AS height) FROM v_blocks)"))(
    lambda t: consolidate.merge_padded(t.v_blocks.select(*_BOXES)))
query("g5_first_wins", _walk(_IN_ORDER, _PLAIN, f"{_iou('a', 'o', '{}')} >= 0.82", "a"))(lambda t: consolidate.first_wins(t.v_blocks.select(*_PLAIN)))
# lines of a page: the sum of their boxes' y and how many these are; line: which one each box joined
query("f3_row_clusters", f"""WITH RECURSIVE {_list(_DOWN, _PLAIN)},
  w AS (SELECT page_id, b, 1 AS k, [{{s: b[1].y, n: 0}}][:0] AS lines, [0][:0] AS line FROM p
    UNION ALL SELECT page_id, b, k + 1, CASE WHEN pos = 0 THEN list_append(lines, {{s: b[k].y, n: 1}}) ELSE list_transform(lines, lambda l, i: CASE WHEN i = pos THEN {{s: l.s + b[k].y, n: l.n + 1}} ELSE l END) END,
      list_append(line, CASE WHEN pos = 0 THEN len(lines) + 1 ELSE pos END)
    FROM (SELECT *, coalesce(list_position(list_transform(lines, lambda l: abs(l.s / l.n - b[k].y) <= 60), true), 0) AS pos FROM w WHERE k <= len(b))),
  u AS (SELECT page_id, unnest(b) AS o, unnest(line) AS line, unnest(range(len(b))) AS k FROM w WHERE k > len(b))
  SELECT page_id, {", ".join(f"o.{c} AS {c}" for c in _PLAIN[1:])}, CAST(row_number() OVER (PARTITION BY page_id ORDER BY line, o.x DESC, k) - 1 AS INTEGER) AS "order" FROM u""")(
    lambda t: consolidate.row_clusters(t.v_blocks.select(*_PLAIN)))
