"""What comes in and how it is styled, on small cases and against plain loops."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from boxloom.operators import audit, accounts, consolidate, intake, lines, style, templates
from boxloom.plans import catalogue
from pyspark.sql import functions as F

from .conftest import DATA

QA = "page_id long, block_id string, source_text string, translation string, confidence double, width double, height double, smart_width double, smart_height double, font_size double"


def codes(spark, *, source="hello", translation="ok", confidence=0.9, width=100.0, height=100.0, smart_width=None, smart_height=None, font_size=None):
    df = spark.createDataFrame([(1, "b", source, translation, confidence, width, height, smart_width, smart_height, font_size)], QA)
    return {(r.code, r.detail) for r in audit.block_issues(df).collect()}


def test_audit_rules(spark):
    assert codes(spark) == set()
    assert codes(spark, translation=" ") == {("UNTRANSLATED_BUBBLE", "")}
    assert codes(spark, source=None, translation="") == {("EMPTY_BLOCK", "")}
    assert codes(spark, confidence=0.44) == {("LOW_OCR_CONFIDENCE", "44")} and codes(spark, confidence=0.0) == codes(spark, confidence=0.45) == codes(spark, confidence=None) == set()
    # ten letters of 13.2 in a box of 100, 32 per cent too wide; blank lines do not count
    assert codes(spark, translation="abcdefghij\n \nxy") == {("TEXT_OVERFLOW", "32")}
    assert codes(spark, translation="abcdefghij", smart_width=200.0) == set() and codes(spark, translation="abcdefghij", smart_width=10.0) == {("TEXT_OVERFLOW", "32")}
    assert codes(spark, translation="a\nb\nc\nd", height=100.0) == {("TEXT_OVERFLOW", "20")} and codes(spark, translation="a\nb\nc\nd", font_size=12.0) == set()
    assert codes(spark, translation="abcdefghij", font_size=0.0) == {("TEXT_OVERFLOW", "32")} and codes(spark, translation="abcdefghij", width=0.0) == set()


def test_audit_floating_signs(spark):
    bad = [0x0E31, *range(0x0E34, 0x0E3B), *range(0x0E47, 0x0E4F)]
    assert len(bad) == 16 and set(map(ord, audit.FLOATING)) == set(bad)
    for c in range(0x0E2E, 0x0E51):
        assert (("THAI_FLOATING_DIACRITIC", "") in codes(spark, translation=f" {chr(c)}")) == (c in bad) if c in (0x0E30, 0x0E31, 0x0E32, 0x0E4C, 0x0E50) else True


def test_page_rollup_counts_missing_image(spark):
    blocks = spark.createDataFrame([(1, "a", "x", "y", 0.9, 100.0, 100.0, None, None, None), (2, "b", "x", "", 0.4, 100.0, 100.0, None, None, None)], QA)
    pages = spark.createDataFrame([(1, 7, None), (2, 7, ""), (3, 7, "clean")], "page_id long, project_id long, inpainted_image_path string")
    got = {r.page_id: (r.blocks, r.issues, r.warnings, r.infos, r.is_clean) for r in audit.page_rollup(blocks, pages).collect()}
    assert got == {1: (1, 1, 1, 0, False), 2: (1, 2, 1, 1, False), 3: (0, 0, 0, 0, True)}


def text(spark, s):
    return lines.lines_of(spark.createDataFrame([(1, s)], "id long, t string"), "id", "t")


def test_alternating(spark):
    rec = lambda s: [(r.line_no, r.source, r.layout, r.translation, r.error) for r in lines.alternating(text(spark, s)).orderBy("line_no").collect()]
    assert rec("a\n\nb\n\nc\n\nd\n") == [(0, "a", None, "b", False), (4, "c", None, "d", False)]
    assert rec("a\n\nb\n\nc") == [(0, "a", None, "b", False), (4, "c", None, "", True)]
    tag = "[[SMART_BALLOON_SPATIAL shape=oval aspect=1.2 w=3 h=4 target_lines=1 max_lines=2]]"
    assert rec(f"a\n{tag}\nb\n c \n\nd\n\ne\nf") == [(0, "a", tag, "b\nc", False), (5, "d", None, "", True), (7, "e", None, "f", False)]


def test_slashed(spark):
    rec = lambda s: [(r.bubble, r.source, r.translation, r.layout) for r in lines.slashed(text(spark, s)).orderBy("bubble").collect()]
    tag = "[[SMART_BALLOON_SPATIAL shape=oval aspect=1.2 w=3 h=4 target_lines=1 max_lines=2]]"
    assert rec("//one\n//สอง\n\n// two\nthree") == [(1, "one", "สอง", None), (2, "two", "three", None)]
    assert rec(f"//one\n{tag}\n//สอง") == [(1, "one", "สอง", tag)]
    assert rec("//a\n//ก\n//b\n//ข") == [(1, "a", "ก", None), (2, "b", "ข", None)]
    assert rec("//a\n//b\n//c") == [(1, "a", "", None), (2, "b", "", None), (3, "c", "", None)]
    assert rec(f"x\n//a\n{tag}\n//ก\nmore\n//b") == [(1, None, "x", None), (2, "a", "ก\nmore", tag), (3, "b", "", None)]


def test_purge(spark):
    assets = spark.createDataFrame([(k, key, 10, status, "2024-01-10" if k == 4 else "2024-01-01", "2024-01-05" if k == 6 else None) for k, key, status in [(1, "s", "deleted"), (2, "r", "deleted"), (3, "i", "deleted"), (4, "n", "uploading"), (5, "o", "uploading"), (6, "k", "active"), (7, "j", "deleted"), (8, "a", "active")]], "asset_id long, storage_key string, byte_size long, status string, created_on string, retained_until string").withColumns({c: F.col(c).cast("date") for c in ("created_on", "retained_until")})
    pages = spark.createDataFrame([("s", "i", "r")], "source_image_path string, inpainted_image_path string, rendered_image_path string")
    results = spark.createDataFrame([(7,), (None,)], "asset_id long")
    # the cleaned image is not asked, so its asset goes; a fresh upload and a job's result stay
    assert {r.asset_id for r in accounts.unreferenced(assets, pages, results, "2024-01-10").collect()} == {3, 5, 6}
    assert tuple(accounts.purge_totals(assets, pages, results, "2024-01-10").first()) == (3, 30)
    assert tuple(accounts.purge_totals(assets, pages, results, "2024-01-10", dry_run=True).first()) == (0, 0)


def test_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, 2.5)], "record_id string, page_id long, width double")
    intake.manifest_lines(df.coalesce(1)).write.text(f"{tmp_path}/m")
    got = intake.load_manifest(spark, f"{tmp_path}/m", "record_id string, page_id long, width double")
    assert sorted((r.record_id, r.page_id, r.width) for r in got.collect()) == [("a", 1, None), ("b", 2, 2.5)]
    bad = spark.createDataFrame([("f", '{"record_id":"a"}\n\n{"record_id":')], "path string, value string")
    with pytest.raises(Exception, match="f: line 3 is no valid record"):
        intake.read_manifest(bad, "record_id string").collect()


def test_assets(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (20_000).to_bytes(4, "big") + (7_000).to_bytes(4, "big")
    cases = [(b"", None, "empty"), (b"GIF89a", None, "unknown_signature"), (b"\xff\xd8\xff0", "image/jpg", None), (b"\xff\xd8\xff0", "image/png", "declared_mismatch"), (png, None, "too_many_pixels"), (b"RIFF0000WEBP", None, None), (b"RIFF0000WAVE", None, "unknown_signature"), (b"8BPS", "", None)]
    df = spark.createDataFrame([(str(k), c, d, None, None) for k, (c, d, _) in enumerate(cases)], "path string, content binary, declared string, width long, height long")
    assert [r.reason for r in intake.checked_assets(df).orderBy("path").collect()] == [r for *_, r in cases]


def test_answers(spark):
    ids = ["pa_b1_x", "pa_b10_x", "pb_b2"]
    cases = {
        1: ('[{"box_id":"HOST_BOX:PA_B1_X","text":" one ","balloon_type":"SFX"},{"id":"pb_b2","ocr":"two"},{"box_id":"zz","text":"no"}]', {("pa_b1_x", "one", "sfx"), ("pb_b2", "two", "bubble")}),
        2: ('Sure\n```json\n{"box_id":"pb_b2-extra","text":"t"}\n```', {("pb_b2", "t", "bubble")}),
        3: ("HOST_BOX:pa_b10_x | `ten`\nbox_id = pb_b2 : \nnoise", {("pa_b10_x", "ten", "bubble")}),
        4: ("nothing", set()),
    }
    df = spark.createDataFrame([(k, raw, ids) for k, (raw, _) in cases.items()], "answer_id long, raw string, expected array<string>")
    got = intake.matched_boxes(df).collect()
    assert {k: {(r.box_id, r.text, r.balloon_type) for r in got if r.answer_id == k} for k in cases} == {k: v for k, (_, v) in cases.items()}


def test_likeness_against_a_plain_loop(spark):
    rng = random.Random(4)
    words = ["neko", "inu", "tori", "sakana", "mizu", "hi", "kaze", "yama"]
    blocks, records = [], []
    for p in range(6):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(25)]
        blocks += [(p, f"b{k}", k, t) for k, t in enumerate(texts)]
        for k in range(25):
            t = rng.choice(texts)
            records.append((p, f"r{k}", k, "".join(c if rng.random() > 0.08 else rng.choice("xyz ") for c in t) if k % 3 else t))
    want = []
    squeeze = lambda s: "".join(s.split())
    for p in range(6):
        used = set()
        own = [(b, squeeze(t)) for q, b, _, t in blocks if q == p]
        for q, r, _, t in records:
            if q != p or not (n := squeeze(t)):
                continue
            free = [(b, x) for b, x in own if b not in used]
            hit = next((b for b, x in free if x == n), None)
            if hit is None:
                scored = sorted(((SequenceMatcher(None, n, x, autojunk=False).ratio(), k, b) for k, (b, x) in enumerate(free) if x), key=lambda s: s[0])
                if scored and scored[-1][0] >= 0.72 and (scored[-1][0] - (scored[-2][0] if len(scored) > 1 else 0) >= 0.06 - 1e-12 or scored[-1][0] >= 0.90):
                    # of equally good ones the last in order counts
                    hit = scored[-1][2]
            if hit:
                used.add(hit)
                want.append((p, r, hit))
    side = lambda rows, name: spark.createDataFrame(rows, f"project_id long, {name} string, seq int, source_text string")
    got = intake.match_by_likeness(side(records, "record_id"), side(blocks, "block_id")).collect()
    assert sorted((r.project_id, r.record_id, r.block_id) for r in got) == sorted(want)


def plain_cuts(height, boxes, target, least):
    if height <= target:
        return [0, height]
    cuts, at, window = [0], target, int(target * 0.25)
    while at < height - least:
        low, high = max(100, at - window), min(height - 100, at + window)
        free = [y for y in range(low, high) if not any(max(0, int(a) - 30) <= y < min(height, int(a) + int(h) + 30) for a, h in boxes)] if low < high else []
        best = min(free, key=lambda y: abs(y - at)) if free else at
        cuts.append(cuts[-1] + least if best <= cuts[-1] + least else best)
        at = cuts[-1] + target
    return [*cuts, height]


def test_cuts():
    rng = random.Random(8)
    for _ in range(300):
        height, target = rng.randint(300, 6000), rng.choice([600, 1000, 2500])
        boxes = [(rng.uniform(-20, height), rng.uniform(0, 500)) for _ in range(rng.randint(0, 12))]
        least = rng.choice([100, 400, 800])
        assert intake.page_cuts(height, np.array(boxes).reshape(-1, 2), target, least) == plain_cuts(height, boxes, target, least)


def plain_padded(boxes, m):
    rects = [[max(0, x - m), max(0, y - m), x + w + m, y + h + m, x, y, w, h] for x, y, w, h in boxes]
    again = True
    while again:
        again, out, gone = False, [], set()
        for i, r in enumerate(rects):
            if i in gone:
                continue
            for j in range(i + 1, len(rects)):
                q = rects[j]
                if j not in gone and r[2] >= q[0] and q[2] >= r[0] and r[3] >= q[1] and q[3] >= r[1]:
                    x, y = min(r[4], q[4]), min(r[5], q[5])
                    w, h = max(r[4] + r[6], q[4] + q[6]) - x, max(r[5] + r[7], q[5] + q[7]) - y
                    r, again = [max(0, x - m), max(0, y - m), x + w + m, y + h + m, x, y, w, h], True
                    gone.add(j)
            out.append(r)
        rects = out
    return sorted(tuple(r[4:]) for r in rects)


def test_padded_regions_against_a_plain_loop(spark):
    rng = random.Random(2)
    pages = {p: [(rng.randint(-40, 900), rng.randint(-40, 900), rng.randint(5, 200), rng.randint(5, 200)) for _ in range(rng.randint(1, 14))] for p in range(60)}
    rows = [(p, str(k), k, "bubble", 0.5, *map(float, b)) for p, bs in pages.items() for k, b in enumerate(bs)]
    got = consolidate.merge_padded(spark.createDataFrame(rows, "page_id long, block_id string, block_index int, balloon_type string, confidence double, x double, y double, width double, height double")).collect()
    assert {p: sorted((int(r.x), int(r.y), int(r.width), int(r.height)) for r in got if r.page_id == p) for p in pages} == {p: plain_padded(b, 35) for p, b in pages.items()}


def plain_overlap(boxes, limit):
    boxes, out = [list(b) for b in boxes], []
    free = [True] * len(boxes)
    for k in range(len(boxes)):
        if not free[k]:
            continue
        free[k], grown = False, True
        while grown:
            grown = False
            for j in range(len(boxes)):
                if free[j]:
                    a, b = boxes[k], boxes[j]
                    s = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
                    if s / max(1, min(a[2] * a[3], b[2] * b[3])) >= limit or s / max(1, a[2] * a[3] + b[2] * b[3] - s) >= limit:
                        x, y = min(a[0], b[0]), min(a[1], b[1])
                        boxes[k] = [x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y]
                        free[j], grown = False, True
        out.append(tuple(boxes[k]))
    return sorted(out)


def test_overlapping_boxes_against_a_plain_loop(spark):
    rng = random.Random(6)
    pages = {p: sorted(((float(rng.randint(0, 400)), float(rng.randint(0, 400)), float(rng.randint(20, 200)), float(rng.randint(20, 200))) for _ in range(rng.randint(1, 12))), key=lambda b: (b[1], b[0])) for p in range(60)}
    rows = [(p, f"{k:02d}", k, "bubble", 0.5, *b) for p, bs in pages.items() for k, b in enumerate(bs)]
    got = consolidate.merge_overlapping(spark.createDataFrame(rows, "page_id long, block_id string, block_index int, balloon_type string, confidence double, x double, y double, width double, height double")).collect()
    assert {p: sorted((r.x, r.y, r.width, r.height) for r in got if r.page_id == p) for p in pages} == {p: plain_overlap(b, 0.25) for p, b in pages.items()}


def test_default_template(spark):
    projects = spark.createDataFrame([(1, None), (2, "x"), (3, "gone"), (4, "x")], "project_id long, default_template_id string")
    own = spark.createDataFrame([(1, "a", 0, True), (1, "bubble", 1, True), (2, "x", 5, True), (2, "a", 0, True), (3, "a", 0, False), (3, "b", 1, True), (5, "q", 0, True)], "project_id long, template_id string, ord int, valid boolean")
    assert {r.project_id: r.template_id for r in templates.default_template(projects, own).collect()} == {1: "bubble", 2: "x", 3: "b", 4: None}


def test_style_ties_go_to_the_first(spark):
    row = (("b", "", "", None, "odd", None, None, 0.0, 50.0, 50.0, "", None, None), ("c", "x", "STOP!!", "sfx", "bubble", "vertical", "#800000", 0.0, 30.0, 90.0, "", 1.0, 100.0))
    df = spark.createDataFrame(row, "block_id string, source_text string, translation string, detected_type string, balloon_type string, text_direction string, source_color string, y double, width double, height double, region_source string, source_stroke_width double, page_height double")
    b, c = style.judged(df).orderBy("block_id").collect()
    assert (b.role, b.reason_codes, b.confidence) == ("dialogue", ["HEURISTIC_UNCALIBRATED", "NO_SOURCE_COLOR_EVIDENCE"], 0.445)
    # emphasis .10 + .55 + .22, sfx .10 + .35 + .2 + .3 + .15
    assert (c.role, c.intensity, c.orientation, c.has_outline) == ("sfx", "shout", "vertical", True)
    assert c.reason_codes[:2] == ["DETECTOR_SFX", "TALL_SHORT_TEXT"]


@pytest.mark.parametrize("name", ["c10_likeness", "d10_cuts", "g4_padded"])
def test_rows_only_queries_cover_their_tables(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_answers_are_read_once(spark):
    rows = [(1, '[{"id":"a_1","text":"x","balloon_type":"SFX"}]\n', ["a_1", "a_2"]), (2, 'so:\n```json\n[]\n```\n```\n{"id":"a_2","text":" y "}\n```\nBOX_BOX: a_1 | z', ["a_2", "a_1"]), (3, "box_id: a_1 | one\nbox_id: a_1 | `two`\nnote", ["a_1"]), (4, "null", ["a_1"])]
    got = intake.matched_boxes(spark.createDataFrame(rows, "answer_id long, raw string, expected array<string>"))
    assert sorted((r.answer_id, r.box_id, r.text, r.balloon_type, r.bold) for r in got.collect()) == [(1, "a_1", "x", "sfx", False), (2, "a_2", "y", "bubble", False), (3, "a_1", "two", "bubble", None)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Join" not in plan and plan.count("parseJson") + plan.count("parse_json") <= 1
