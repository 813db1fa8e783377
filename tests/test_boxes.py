"""Page rules on small cases, and against a plain transcription on random pages."""

import random

from boxloom.operators import accounts, boxes, consolidate, lines, memory, planning

COLUMNS = "page_id long, block_id string, block_index int, balloon_type string, confidence double, x double, y double, width double, height double"


def page(spark, *rows):
    return spark.createDataFrame([(1, str(k), k, *r) for k, r in enumerate(rows)], COLUMNS)


def ids(df):
    return [r.block_id for r in df.collect()]


def test_suppression_keeps_the_strongest(spark):
    a, b = ("text", 0.93, 120.0, 140.0, 560.0, 304.0), ("text", 0.71, 95.0, 80.0, 620.0, 430.0)
    kept = consolidate.suppress(page(spark, a, b)).collect()
    assert [(r.block_id, r.x, r.width) for r in kept] == [("0", 120.0, 560.0)]


def test_suppression_isolates_types(spark):
    assert len(ids(consolidate.suppress(page(spark, ("text", 0.93, 120.0, 140.0, 560.0, 304.0), ("bubble", 0.89, 90.0, 70.0, 640.0, 450.0))))) == 2


def test_bubbles_grow(spark):
    kept = consolidate.suppress(page(spark, ("bubble", 0.9, 0.0, 0.0, 100.0, 100.0), ("bubble", 0.8, 0.0, 50.0, 100.0, 100.0))).collect()
    assert [(r.y, r.height) for r in kept] == [(0.0, 150.0)]


def test_reading_orders(spark):
    p = page(spark, ("bubble", 1.0, 600.0, 100.0, 200.0, 100.0), ("bubble", 1.0, 150.0, 120.0, 200.0, 100.0), ("bubble", 1.0, 400.0, 800.0, 250.0, 120.0))
    assert ids(consolidate.row_clusters(p).orderBy("order")) == ["0", "1", "2"]
    assert ids(boxes.scroll_order(p).orderBy("order")) == ["0", "1", "2"]
    first = boxes.flow_lines(boxes.scroll_order(p)).orderBy("from_order").first()
    assert first.x1 == 700.0 and first.from_order == 0


def test_merge_and_first_wins_match_a_transcription(spark):
    rng = random.Random(4)
    rows = []
    for p in range(60):
        for k in range(rng.randint(1, 9)):
            rows.append((p, f"{p}-{k}", k, "text", 0.5, float(rng.randint(0, 200)), float(rng.randint(0, 200)), float(rng.randint(5, 90)), float(rng.randint(5, 90))))
    df = spark.createDataFrame(rows, COLUMNS)

    def gap(a, b, d):
        return all(max(a[i], b[i]) - min(a[i] + a[i + 2], b[i] + b[i + 2]) <= d for i in (0, 1))

    want = 0
    for p in range(60):
        todo = sorted((r[6], r[5], r[2], r) for r in rows if r[0] == p)
        todo = [list(t[3][5:9]) for t in todo]
        while todo:
            hull, want, grew = todo.pop(0), want + 1, True
            while grew:
                grew = False
                for b in list(todo):
                    if gap(hull, b, 20):
                        x, y = min(hull[0], b[0]), min(hull[1], b[1])
                        hull = [x, y, max(hull[0] + hull[2], b[0] + b[2]) - x, max(hull[1] + hull[3], b[1] + b[3]) - y]
                        todo.remove(b)
                        grew = True
    assert consolidate.merge_near(df, 20).count() == want

    def iou(a, b):
        w, h = (max(0, min(a[i] + a[i + 2], b[i] + b[i + 2]) - max(a[i], b[i])) for i in (0, 1))
        return w * h / max(1, a[2] * a[3] + b[2] * b[3] - w * h)

    kept = []
    for r in rows:
        if not any(k[0] == r[0] and iou(k[5:9], r[5:9]) >= 0.3 for k in kept):
            kept.append(r)
    assert set(ids(consolidate.first_wins(df, 0.3))) == {k[1] for k in kept}


def test_stacked_expiry_matches_the_loop(spark):
    rng, rows = random.Random(2), []
    for u in range(20):
        for k in range(rng.randint(1, 8)):
            rows.append((u * 100 + k, u, f"2024-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", rng.randint(1, 60)))
    df = spark.createDataFrame(rows, "redemption_id long, user_id long, redeemed_on string, duration_days int").selectExpr("redemption_id", "user_id", "CAST(redeemed_on AS DATE) AS redeemed_on", "duration_days")
    import datetime as dt

    want, end = {}, {}
    for i, u, d, n in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        day = dt.date.fromisoformat(d)
        end[u] = max(end.get(u, day), day) + dt.timedelta(n)
        want[i] = end[u]
    assert {r.redemption_id: r.expires_on for r in accounts.stacked_expiry(df).collect()} == want


def test_memory_counts_repeats(spark):
    rows = spark.createDataFrame([(1, " a ", "x", None, None), (2, "a", "y", "ja", "th"), (3, " ", "z", "ja", "th")], "seq long, source_text string, translation string, source_language string, target_language string")
    assert [(r.source_text, r.frequency, r.translation) for r in memory.merge(rows).collect()] == [("a", 2, "y")]


def test_alternating_file(spark):
    f = spark.createDataFrame([(1, "a\r\n\r\nb\r\rc")], "id long, text string")
    got = lines.alternating(lines.lines_of(f, "id", "text")).orderBy("line_no").collect()
    assert [(r.source, r.translation, r.error) for r in got] == [("a", "b", False), ("c", "", True)]


def test_empty_tables(spark):
    none = page(spark).limit(0)
    assert consolidate.suppress(none).count() == consolidate.row_clusters(none).count() == 0
    assert planning.kept_and_numbered(none.withColumns({"source_text": none.block_id, "translation": none.block_id})).count() == 0
