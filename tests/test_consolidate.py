"""Greedy box rules on pages that are cut, against plain loops over whole pages."""

import random

import pytest
from pyspark.sql import functions as F

from boxloom.operators import consolidate as c
from boxloom.operators.scan import parted, running

SCHEMA = "page_id long, block_id string, block_index int, balloon_type string, confidence double, x double, y double, width double, height double"


def shared(a, b):
    return max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))


def union(a, b):
    x, y = min(a[0], b[0]), min(a[1], b[1])
    return (x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y)


def plain_first_wins(rows, limit):
    kept = []
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        b = r[5:]
        if not any(shared(b, k[5:]) / max(1, b[2] * b[3] + k[7] * k[8] - shared(b, k[5:])) >= limit for k in kept):
            kept.append(r)
    return kept


def plain_suppress(rows, limit=0.5):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[2], r[1])):
        b, mine = r[5:], max(1, r[7] * r[8])
        for n, k in enumerate(kept):
            a, other = k[5:], max(1, k[7] * k[8])
            s = shared(a, b)
            if k[3] == r[3] and (s / max(1, mine + other - s) > limit or s / min(mine, other) > 0.3):
                if r[3] == "bubble" and (min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) / max(1e-9, min(a[2], b[2])) > 0.75 and min(k[4], r[4]) >= 0.25:
                    kept[n] = (*k[:5], *union(a, b))
                break
        else:
            kept.append(r)
    return kept


def plain_merge(rows, meets):
    rows = sorted(rows, key=lambda r: (r[6], r[5], r[2], r[1]))
    used, out = [False] * len(rows), []
    for k, r in enumerate(rows):
        if used[k]:
            continue
        used[k] = grown = True
        while grown:
            grown = False
            for j, o in enumerate(rows):
                if not used[j] and meets(r[5:], o[5:]):
                    best = o if o[4] > r[4] else r
                    r = (*r[:3], best[3], best[4], *union(r[5:], o[5:]))
                    used[j] = grown = True
        out.append(r)
    return out


def near(a, b):
    return max(a[0], b[0]) - min(a[0] + a[2], b[0] + b[2]) <= 20 and max(a[1], b[1]) - min(a[1] + a[3], b[1] + b[3]) <= 20


def overlapping(a, b):
    s, mine, other = shared(a, b), max(1, a[2] * a[3]), max(1, b[2] * b[3])
    return s / min(mine, other) >= 0.25 or s / max(1, mine + other - s) >= 0.25


def plain_padded(rows, m=35):
    rows = [(*r[:5], *(float(int(v)) for v in r[5:])) for r in sorted(rows, key=lambda r: (r[2], r[1]))]
    while True:
        out, used = [], [False] * len(rows)
        for k, r in enumerate(rows):
            if used[k]:
                continue
            for j in range(k + 1, len(rows)):
                a, b = r[5:], rows[j][5:]
                if not used[j] and all(max(0, a[d] - m) <= b[d] + b[d + 2] + m and max(0, b[d] - m) <= a[d] + a[d + 2] + m for d in (0, 1)):
                    r, used[j] = (*r[:5], *union(a, b)), True
            out.append(r)
        if len(out) == len(rows):
            return out
        rows = out


def plain_rows(rows, reach=60):
    lines = []
    for r in sorted(rows, key=lambda r: (r[6], r[5], r[2], r[1])):
        line = next((n for n in lines if abs(sum(o[6] for o in n) / len(n) - r[6]) <= reach), None)
        lines.append([r]) if line is None else line.append(r)
    return [r for n in lines for r in sorted(n, key=lambda r: -r[5])]


RULES = {
    "first_wins": (lambda df: c.first_wins(df, 0.2), lambda r: plain_first_wins(r, 0.2)),
    "suppress": (c.suppress, plain_suppress),
    "merge_near": (c.merge_near, lambda r: plain_merge(r, near)),
    "merge_overlapping": (c.merge_overlapping, lambda r: plain_merge(r, overlapping)),
    "merge_padded": (c.merge_padded, plain_padded),
}


def some_pages(seed):
    rnd, rows = random.Random(seed), []
    for page, n, tall in ((1, 150, 6000), (2, 90, 900), (None, 60, 3000), (3, 1, 10), (4, 8, 300)):
        for k in range(n):
            rows.append((page, f"b{k}", k % 50, rnd.choice(["bubble", "sfx"]), rnd.randrange(100) / 100, float(rnd.randrange(-40, 900)), float(rnd.randrange(tall)), float(rnd.randrange(0, 200)), float(rnd.randrange(5, 120))))
    return rows


@pytest.mark.parametrize("name", RULES)
@pytest.mark.parametrize("page, grid", [(5, 2), (10**6, 10**6)])
def test_rules(spark, monkeypatch, name, page, grid):
    monkeypatch.setattr(c, "PAGE", page)
    rows = some_pages(len(name))
    ours, plain = RULES[name]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    # the grid's bound goes to tasks with the rule's module, so small values are set by a rule of a patched class
    monkeypatch.setattr(c.Near, "__init__", _init(grid))
    got = sorted((tuple(r) for r in ours(df).collect()), key=str)
    want = sorted((r for p in {r[0] for r in rows} for r in plain([r for r in rows if r[0] == p])), key=str)
    assert got == want


def _init(grid):
    def init(self, boxes, margin=0.0):
        from collections import defaultdict

        self.margin, self.all = margin, range(len(boxes)) if len(boxes) < grid else None
        self.side, self.cells = 50.0, defaultdict(list)

    return init


@pytest.mark.parametrize("name", RULES)
def test_rules_with_grid_in_one_process(spark, monkeypatch, name):
    """The rule itself, with grids of several sizes, on one page."""
    rows = [r for r in some_pages(7) if r[0] == 1]
    ours, plain = RULES[name]
    taken = []

    def apply(blocks, order, rule, margin):
        taken.append(rule)

    monkeypatch.setattr(c, "_applied", apply)
    ours(None)
    keys = {"first_wins": lambda r: (r[2], r[1]), "merge_padded": lambda r: (r[2], r[1]), "suppress": lambda r: (-r[4], r[2], r[1])}
    rows.sort(key=keys.get(name, lambda r: (r[6], r[5], r[2], r[1])))
    for grid in (2, 10**6):
        monkeypatch.setattr(c, "GRID", grid)
        boxes, conf, types = [list(r[5:]) for r in rows], [r[4] for r in rows], [r[3] for r in rows]
        got = [(*rows[k][:3], types[k], conf[k], *boxes[k]) for k in taken[0](boxes, conf, types)]
        assert sorted(got) == sorted(plain(rows))


@pytest.mark.parametrize("page", [5, 10**6])
def test_row_clusters(spark, monkeypatch, page):
    monkeypatch.setattr(c, "PAGE", page)
    rows = some_pages(3)
    got = c.row_clusters(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    for p in {r[0] for r in rows}:
        mine = sorted((r for r in got if r.page_id == p), key=lambda r: r.order)
        assert [r.order for r in mine] == list(range(len(mine)))
        assert [tuple(r)[:9] for r in mine] == plain_rows([r for r in rows if r[0] == p])


def test_row_clusters_once(spark):
    """Boxes go through Python once; null sides come last, a long stretch is walked, a short one is one row."""
    ys = [0.0, 50.0, 60.0, 100.0, 125.0, 400.0, None, 460.0]
    rows = [(page, str(k), k, "sfx", 0.5, float(k % 3), y, 9.0, 9.0) for page in (None, 1) for k, y in enumerate(ys)]
    out = c.row_clusters(spark.createDataFrame(rows, SCHEMA))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    for page in (None, 1):
        mine = sorted((r for r in out.collect() if r.page_id == page), key=lambda r: r.order)
        # the mean of 0, 50 and 60 is 36.7, so 100 opens a row, which 125 joins
        assert [(r.order, r.block_id) for r in mine] == list(enumerate(["2", "1", "0", "4", "3", "5", "7", "6"]))


def test_null_sides_meet_nothing(spark):
    rows = [(None, "a", 0, "sfx", None, 0.0, 0.0, 9.0, 9.0), (None, "b", 1, "sfx", 0.5, 0.0, 0.0, 9.0, 9.0), (None, "c", 2, "sfx", 0.5, None, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.block_id for r in c.first_wins(df).collect()} == {"a", "c"}
    assert {(r.block_id, r.confidence) for r in c.merge_near(df).collect()} == {("a", 0.5), ("c", 0.5)}
    assert c.suppress(df.limit(0)).count() == 0


def test_large_page(spark):
    """A page of 30,000 boxes in 5,000 heaps."""
    df = spark.range(30_000).select(
        F.lit(1).cast("long").alias("page_id"), F.col("id").cast("string").alias("block_id"), F.col("id").cast("int").alias("block_index"), F.lit("bubble").alias("balloon_type"), F.lit(0.5).alias("confidence"),
        (F.col("id") % 50 * 100.0).alias("x"), (F.floor(F.col("id") % 5000 / 50) * 100.0 + F.floor(F.col("id") / 5000)).alias("y"), F.lit(50.0).alias("width"), F.lit(50.0).alias("height"))
    assert c.merge_near(df).count() == c.suppress(df).count() == 5000
    assert c.merge_padded(df).count() == 1


def test_running_and_parted(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([1, None, 2]), rnd.choice([None, float(rnd.randrange(400))]), n, rnd.randrange(-5, 9)) for n in range(200)]
    df = spark.createDataFrame(rows, "k int, t double, n int, v int")
    got = running(df, ["k"], F.floor(F.col("t") / 50), [F.col("t").asc_nulls_first(), "n"], {"s": ("sum", F.col("v")), "m": ("min", F.col("v")), "c": ("count", F.col("t"))}).collect()
    before = running(df, ["k"], F.floor(F.col("t") / 50), [F.col("t").asc_nulls_first(), "n"], {"s": ("sum", F.col("v"))}, inclusive=False).collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    for k in (1, 2, None):
        past = []
        for r in sorted((r for r in rows if r[0] == k), key=key):
            assert next(b.s for b in before if b.n == r[2]) == (sum(p[3] for p in past) if past else None)
            past.append(r)
            g = next(g for g in got if g.n == r[2])
            assert (g.s, g.m, g.c) == (sum(p[3] for p in past), min(p[3] for p in past), sum(p[1] is not None for p in past))
    spans = [(1, float(a), float(a + w), n) for n, (a, w) in enumerate([(0, 10), (5, 3), (12, 1), (30, 0), (30, 4000), (4031, 1), (4034, 2), (4034, 0)])]
    cut = parted(spark.createDataFrame(spans, "k int, a double, b double, n int"), ["k"], F.col("a"), F.col("b"), 2.0, "part").orderBy("n").collect()
    assert [r.part for r in cut] == [0.0, 0.0, 0.0, 30.0, 30.0, 30.0, 30.0, 30.0]
    cut = parted(spark.createDataFrame(spans, "k int, a double, b double, n int"), ["k"], F.col("a"), F.col("b"), 0.5, "part").orderBy("n").collect()
    assert [r.part for r in cut] == [0.0, 0.0, 12.0, 30.0, 30.0, 4031.0, 4034.0, 4034.0]
