"""Rules of boxes, roll-ups, imports, styles and workers, on small cases and against plain loops."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from boxloom.functions import text
from boxloom.operators import accounts, benchmark, boxes, exchange, intake, layout, ledger, memory, style
from boxloom.streaming import telemetry

HINT = "[[SMART_BALLOON_SPATIAL shape=ellipse aspect=1.5 w=30 h=20 target_lines=2 max_lines=4]]"


def test_boxes_meet_once_across_cells(spark):
    rng = random.Random(3)
    rows = [(p, f"b{k}", k, rng.uniform(-700, 1500), rng.uniform(-100, 4000), rng.choice([-5.0, 0.0, 30.0, 300.0, 2500.0]), rng.choice([20.0, 600.0])) for p in range(3) for k in range(40)]
    got = boxes.pair_iou(spark.createDataFrame(rows, "page_id long, block_id string, block_index int, x double, y double, width double, height double")).collect()
    want = {}
    for p, i, a, x, y, w, h in rows:
        for q, j, b, x2, y2, w2, h2 in rows:
            if p == q and a < b and min(w, w2) > 0:
                s = max(0, min(x + w, x2 + w2) - max(x, x2)) * max(0, min(y + h, y2 + h2) - max(y, y2))
                if s > 0:
                    want[p, i, j] = s / (w * h + w2 * h2 - s + 1e-6)
    assert len(got) == len(want) and {(r.page_id, r.a_block_id, r.b_block_id): r.iou for r in got} == pytest.approx(want)


def test_quantiles_are_exact(spark):
    rng = random.Random(5)
    groups = {"one": [7.0], "same": [2.0] * 50, "wide": [rng.gauss(0, 1) ** 3 for _ in range(500)], "far": [0.001 * k for k in range(300)] + [1e12], "two": [1.0, 4.0]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").selectExpr("named_struct('g', g, 'n', CAST(NULL AS STRING)) AS s", "x")
    got = {r.s.g: (r.q5, r.q50, r.q95) for r in benchmark.quantiles(df, {"q5": 0.05, "q50": 0.5, "q95": 0.95}).collect()}

    def plain(xs, p):
        xs, at = sorted(xs), p * (len(xs) - 1)
        low = int(at)
        return xs[low] + (xs[min(low + 1, len(xs) - 1)] - xs[low]) * (at - low)

    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g] == pytest.approx([plain(xs, p) for p in (0.05, 0.5, 0.95)])


def test_rollup_of_no_rows(spark):
    schema = "engine string, balloon_type string, split string, archetype string, success boolean, has_gt boolean, mask_iou double, elapsed_ms double"
    assert benchmark.rollup(spark.createDataFrame([], schema)).count() == 0


def test_lookup_trims_and_filters_languages(spark):
    m = spark.createDataFrame([("Neko wa", "ja", "th", "cat", 3, 1), ("neko", "ko", "th", "cat2", 5, 2), ("inu", "ja", "th", "dog", 9, 3)], "source_text string, source_language string, target_language string, translation string, frequency long, last_seq long")
    asked = spark.createDataFrame([(1, " neko ", "auto"), (2, "neko", "ja"), (3, "", None), (4, "zzneko", None), (5, "n", ""), (6, "NEKO", "ko")], "query_id int, query string, source_language string")
    got = sorted((r.query_id, r.rank, r.translation, r.exact) for r in memory.lookup(m, asked).collect())
    assert got == [(1, 1, "cat2", True), (1, 2, "cat", False), (2, 1, "cat", False), (5, 1, "dog", False), (5, 2, "cat2", False), (5, 3, "cat", False), (6, 1, "cat2", False)]


def test_layout_lines_of_labelled_files(spark):
    text = ["# ID: a", "[คำต้นฉบับ]: s", HINT, "told", "[[no layout]]", "# Bubble 2", "[คำแปลไทย]: x", HINT]
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(text)], "file_id int, line_no int, line string")
    got = {r.line_no: (r.translation, r.layout) for r in exchange.read_labelled(lines).collect()}
    assert got == {0: ("told\n[[no layout]]", HINT), 5: ("x", HINT)}


def test_layout_export(spark):
    b = spark.createDataFrame([(1, 1, 0, "a", "s\nt", "one\r\ntwo {soft}", HINT), (1, 1, 1, "b", None, " ", HINT)], "project_id int, page_id int, block_index int, block_id string, source_text string, translation string, layout string")
    got = [r.text for r in exchange.export_text(b, "ai_layout", {"soft": "t"}).orderBy("bubble").collect()]
    assert got == [f"s t\n{HINT}\none two\n", f"\n{HINT}\n"]


def test_malformed_boxes(spark):
    b = spark.createDataFrame([(1.5, -3.0, 10.0, None), (1.5, -3.0, 10.0, 4.9), (99.0, 0.0, 5.0, 5.0)], "x double, y double, width double, height double").selectExpr("*", "100 AS page_width", "50 AS page_height")
    got = [tuple(r) for r in boxes.clipped(b).select("x", "y", "width", "height", "reason").collect()]
    assert got == [(None, None, None, None, "malformed_bbox"), (1, 0, 10, 4, None), (99, 0, 1, 5, None)]


def test_background_tiles(spark):
    t = spark.range(60).selectExpr("id AS page_id", "0L AS k", "CAST(id AS DOUBLE) AS deviation", "IF(id % 3 = 0, 'val', 'train') AS split")
    got = boxes.background_tiles(t, {"train": 10, "val": 100}).collect()
    assert min(r.deviation for r in got) > 15 and sum(r.split == "train" for r in got) == 10 and sum(r.split == "val" for r in got) == 14


def test_lost_workers_need_a_lapsed_lease_and_an_old_heartbeat(spark):
    at = lambda s: f"2024-01-01 00:0{s // 60}:{s % 60:02d}"
    rows = [(1, 0, "started", at(0)), (1, 1, "heartbeat", at(50)), (2, 2, "started", at(0)), (3, 3, "started", at(50)), (4, 4, "started", at(0)), (4, 5, "completed", at(1))]
    rows += [(5, 6 + k, "started", at(k)) for k in range(3)]
    jobs = spark.createDataFrame(rows, "job_id int, event_id int, kind string, ts string").selectExpr("job_id", "event_id", "kind", "CAST(ts AS TIMESTAMP_NTZ) AS ts")
    found = lambda now: sorted((r.job_id, r.status) for r in telemetry.lost_workers(jobs, now).collect())
    assert found("2024-01-01 00:01:30") == [(2, "queued"), (5, "failed")]
    assert found("2024-01-01 00:01:51") == [(1, "queued"), (2, "queued"), (3, "queued"), (5, "failed")]


def test_progress_and_elapsed(spark):
    rows = [(1, 1, "started", "2024-01-01 00:00:00.5", 0.1), (1, 2, "completed", "2024-01-01 00:00:02.128", 0.123456), (2, 3, "started", "2024-01-01 00:00:01", None)]
    e = spark.createDataFrame(rows, "job_id int, event_id int, kind string, ts string, progress double").selectExpr("job_id", "event_id", "kind", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "progress")
    got = {r.job_id: (r.kind, r.progress, r.elapsed) for r in telemetry.latest_state(e, "2024-01-01 00:00:05").collect()}
    assert got == {1: ("completed", 0.1235, 1.63), 2: ("started", None, 4.0)}


def test_decision_lines_on_files(spark, tmp_path):
    e = spark.createDataFrame([("a", "nonsense", "x", None), ("b", "accepted", "x", "y")], "block_id string, change_reason string, suggested_lines string, final_lines string")
    for _ in range(2):
        ledger.decision_lines(e).write.mode("append").text(str(tmp_path / "log"))
    (tmp_path / "log" / "bad.txt").write_text("{cut\n[1]\n")
    got = ledger.read_decisions(spark.read.text(str(tmp_path / "log")), "block_id string, change_reason string, suggested_lines string, final_lines string").collect()
    assert sorted(map(tuple, got)) == [("a", "suggested", "x", "x")] * 2 + [("b", "accepted", "x", "y")] * 2


def test_fonts_by_script(spark):
    b = spark.createDataFrame([("shout", "กา"), ("shout", "go"), (None, "go"), ("odd", "go")], "balloon_type string, text string").selectExpr("*", "150D AS width", "100D AS height")
    pick = lambda s: [(r.family, r.line_height) for r in layout.font_style(b, s).collect()]
    assert pick("th") == [("Prompt", 1.35)] * 4
    assert pick("ja") == [("MS Gothic", 1.15), ("MS Gothic", 1.15), ("MS Mincho", 1.25), ("MS Mincho", 1.25)]
    assert pick("ko") == [("Prompt", 1.35), ("CCWildWords", 1.15), ("CCWildWords", 1.25), ("CCWildWords", 1.25)]


def test_templates_of_roles(spark):
    rows = [(1, "plain", 0, "bubble", None), (1, "loud", 1, "x", "{ตะโกน}"), (1, "narration", 2, "zz", None), (2, "odd", 3, "zz", None), (2, "first", 1, "zz", None)]
    got = {r.project_id: (r.dialogue, r.narration, r.emphasis, r.sfx) for r in style.role_templates(spark.createDataFrame(rows, "project_id int, template_id string, ord int, balloon_type string, semantic_tag string")).collect()}
    assert got == {1: ("plain", "narration", "loud", "plain"), 2: ("first",) * 4}


def test_import_in_order_against_a_plain_loop(spark):
    rng = random.Random(11)
    words = ["neko", "inu", "tori", "sakana", "mizu", "kaze"]
    blocks, records = [], []
    for p in range(5):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(20)]
        blocks += [(p, f"b{k}", k + 1, t) for k, t in enumerate(texts)]
        for k in range(1, 31):
            t = rng.choice(texts)
            slip = "".join(c if rng.random() > 0.07 else rng.choice("xyz") for c in t)
            records.append((p, k, rng.choice([None, None, None, f"b{rng.randint(0, 22)}"]), rng.choice([None, t, slip]), rng.choice([None, 0, k, 99]), rng.choice(["ก", " ", "plain"]), rng.choice(["th", None])))
    want = {}
    squeeze = lambda s: "".join((s or "").split())
    for p in range(5):
        own, used = [(b, squeeze(t)) for q, b, _, t in blocks if q == p], set()
        for q, n, asked, source, bubble, told, target in records:
            if q != p:
                continue
            if asked:
                hit = asked if asked in dict(own) else None
            elif source:
                free = [(b, x) for b, x in own if b not in used]
                hit = next((b for b, x in free if x == squeeze(source)), None)
                if hit is None:
                    scored = sorted(((SequenceMatcher(None, squeeze(source), x, autojunk=False).ratio(), k, b) for k, (b, x) in enumerate(free)), key=lambda s: s[0])
                    if scored and scored[-1][0] >= 0.72 and (scored[-1][0] - (scored[-2][0] if len(scored) > 1 else 0) >= 0.06 - 1e-12 or scored[-1][0] >= 0.90):
                        hit = scored[-1][2]
                if hit is None:
                    want[p, n] = (None, "warning", False)
                    continue
            else:
                at = bubble or n
                hit = own[at - 1][0] if 1 <= at <= len(own) else None
            if hit is None or hit in used:
                want[p, n] = (hit, "error", False)
                continue
            used.add(hit)
            status = "warning" if source and squeeze(source) != dict(own)[hit] else "ok"
            goes = bool(told.strip())
            if not goes:
                status = "skip"
            elif target == "th" and told == "plain":
                status, goes = "warning", False
            want[p, n] = (hit, status, goes)
    r = spark.createDataFrame(records, "project_id int, record_no int, block_id string, source string, bubble int, translation string, target string")
    b = spark.createDataFrame(blocks, "project_id int, block_id string, bubble int, source_text string")
    got = {(x.project_id, x.record_no): (x.block_id, x.status, x.will_import) for x in intake.resolved_in_order(r, b).collect()}
    assert got == want


def test_snapshot_files(spark, tmp_path):
    def put(project, text):
        (tmp_path / project / "training").mkdir(parents=True)
        (tmp_path / project / "training" / "balloons.json").write_text(text)

    box = '{"block_id": "b", "bbox": [1, 2, 3, 4.5], "type": "sfx", "confidence": 0.5}'
    put("one", '{\n"pages": [{"page_id": "p1", "image": "a.png", "balloons": [%s]},\n {"page_id": "p2", "image": "", "balloons": [%s]}, {"page_id": "p3", "image": "c.png", "balloons": []}]}' % (box, box))
    put("two", '{"project_id": "named", "pages": [{"page_id": "p4", "image": "d.png", "balloons": [%s, %s]}]}' % (box, box))
    put("cut", '{"pages": [')
    found = exchange.read_snapshot_files(spark, str(tmp_path / "*" / "training" / "balloons.json"))
    assert sorted((r.project_id, r.page_id, r.image) for r in found.collect()) == [("named", "p4", "d.png"), ("one", "p1", "a.png")]
    assert sorted((r.page_id, r.idx, r.x, r.height, r.balloon_type) for r in exchange.read_snapshot(found).collect()) == [("p1", 0, 1.0, 4.5, "sfx"), ("p4", 0, 1.0, 4.5, "sfx"), ("p4", 1, 1.0, 4.5, "sfx")]


def test_answers_with_odd_items_and_looks(spark):
    raw = '[{"box_id":"A_1","text":"x","bold":1,"italic":"no","stroke_color":"red","stroke_width":"2.5","gradient":{"angle":9},"drop_shadow":"none","gradient_colors":[]}, "note", null, 3, {"id":"b_2","text":null,"ocr":"lost"}, {"id":"b_2","text":5}, {"id":"c_3","ocr":" kept ","color_hex":"#1","bold":0,"balloon_type":""}]'
    got = {r.box_id: r for r in intake.matched_boxes(spark.createDataFrame([(1, raw, ["a_1", "b_2", "c_3"])], "answer_id long, raw string, expected array<string>")).collect()}
    assert set(got) == {"a_1", "c_3"}
    a, c = got["a_1"], got["c_3"]
    assert (a.text, a.balloon_type, a.bold, a.italic, a.stroke_color_hex, a.stroke_width_px, a.gradient, a.drop_shadow, a.gradient_colors) == ("x", "bubble", True, True, "red", 2.5, '{"angle":9}', None, "[]")
    assert (c.text, c.color_hex, c.bold, c.balloon_type, c.gradient) == ("kept", "#1", False, "bubble", None)


def test_specs_take_null_for_false_and_zero(spark):
    a = spark.createDataFrame([("s", 12.0, 1.2, None, None, None, None), ("t", None, 1.2, True, ["a"], "#FF", "")], "block_id string, font_size double, line_height double, bold boolean, explicit_lines array<string>, stroke_color string, text_align string")
    b = spark.createDataFrame([("s", 12.01, 1.2, False, [], "", 0.0, 0.0, None), ("t", None, 1.3, False, ["a", "b"], "#ff", 1.0, 0.5, "left")], "block_id string, font_size double, line_height double, bold boolean, explicit_lines array<string>, stroke_color string, stroke_width double, rotation_deg double, horizontal_align string")
    got = {r.block_id: r.mismatches for r in layout.spec_differences(a, b).collect()}
    assert got == {"s": "", "t": "explicit_lines,line_count,font_size,line_height,bold,stroke_width,text_align,rotation_deg"}


def test_specs_tell_odd_texts_apart(spark):
    odd = [None, [], [""], ["", ""], [None], ["\\0"], ["\n"], ["\\n"], ["a", "b"], ["a\nb"], ["a\\", "b"], ["a", "\\b"], [None, ""]]
    fonts = [None, "0", "\\0", "\n", "\\n", "x\ncenter", "\\\\0"]
    cases = [(x, y, None, None) for x in odd for y in odd] + [(None, None, f, g) for f in fonts for g in fonts]
    schema = "block_id string, explicit_lines array<string>, font_postscript_name string, font_size double, line_height double"
    a = spark.createDataFrame([(f"k{k}", x, f, 9.0, 1.2) for k, (x, _, f, _) in enumerate(cases)], schema)
    b = spark.createDataFrame([(f"k{k}", y, g, 9.0, 1.2) for k, (_, y, _, g) in enumerate(cases)], schema)
    got = {r.block_id: r.mismatches for r in layout.spec_differences(a, b).collect()}
    want = [(["explicit_lines"] if (x or []) != (y or []) else []) + (["line_count"] if len(x or []) != len(y or []) else []) + (["font_postscript"] if f != g else []) for x, y, f, g in cases]
    assert got == {f"k{k}": ",".join(w) for k, w in enumerate(want)}


def shuffled_bytes(node) -> int:
    """Of a plan that has run: the bytes of the rows in its shuffles, before they are compressed."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return shuffled_bytes(node.executedPlan())
    if node.nodeName().endswith("QueryStage"):
        return shuffled_bytes(node.plan())
    own = node.metrics().apply("dataSize").value() if node.nodeName() == "Exchange" else 0
    return own + sum(shuffled_bytes(node.children().apply(k)) for k in range(node.children().size()))


def test_specs_are_shuffled_as_short_rows(spark):
    from boxloom.plans import catalogue

    from .conftest import DATA

    out = catalogue.QUERIES["c18_spec_differences"](spark, DATA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = len(out.collect())
        size = shuffled_bytes(out._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < size < 450 * rows


def test_judged_blocks_are_shuffled_as_short_rows(spark):
    from boxloom.plans import catalogue

    from .conftest import DATA

    for name, most in (("j12_style", 120), ("j12_templates", 240)):
        out = catalogue.QUERIES[name](spark, DATA)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            rows = len(out.collect())
            size = shuffled_bytes(out._jdf.queryExecution().executedPlan())
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert 0 < size < most * rows


def test_blocks_are_judged_alike_with_and_without_pages(spark):
    pages = spark.createDataFrame([(1, 100.0, 7), (2, 0.5, 8), (3, None, None)], "page_id long, page_height double, project_id long")
    templates = spark.createDataFrame([(7, "sfx", 0, "SFX", None), (7, "n", 1, "narrative", None), (7, "z", 2, None, "ตะโกน")], "project_id long, template_id string, ord int, balloon_type string, semantic_tag string")
    kinds, has = ["bubble", "NARRATIVE", "narration", "sfx", "emphasis", "odd", "", None], ["sfx", "n", "z", "gone", None]
    rows = [(f"{p}-{k}-{h}-{d}", p, "ドカ", "" if k % 2 else "words of a tale" if k % 4 else "STOP!!", d, kinds[k], "Vertical" if k == 2 else None, None if k % 3 else "#800000", 5.0, 90.0, 30.0 + 60 * (k % 2), "fallback_bbox" if h else None, None if k else 1.0, has[h]) for p in (1, 2, 3) for k in range(8) for h in range(5) for d in (None, "sfx")]
    blocks = spark.createDataFrame(rows, "block_id string, page_id long, source_text string, translation string, detected_type string, balloon_type string, text_direction string, source_color string, y double, width double, height double, region_source string, source_stroke_width double, text_template_id string")
    told = lambda df: sorted((r.asDict() for r in df.collect()), key=lambda r: r["block_id"])
    joined = blocks.join(pages, "page_id")
    got = told(style.judged(blocks, templates, pages))
    assert len(got) == len(rows) and got == told(style.judged(joined, templates))
    assert [{k: v for k, v in r.items() if k not in ("suggested_template", "confidence", "reason_codes")} for r in got] == [{k: v for k, v in r.items() if k not in ("confidence", "reason_codes")} for r in told(style.judged(joined))]
    by_id = {r["block_id"]: r for r in got}
    # narration .15 + .12 + .25 + .15, sfx .10 + .35
    read = lambda i: (by_id[i]["role"], by_id[i]["suggested_template"], "TOP_PAGE_BANNER" in by_id[i]["reason_codes"], "KEEP_EXISTING_TEMPLATE" in by_id[i]["reason_codes"])
    assert [read("1-2-4-None"), read("1-2-1-None"), read("2-2-1-None")] == [("narration", "n", True, False), ("narration", "n", True, True), ("narration", "bubble", False, False)]
    assert {r["suggested_template"] for r in got} == {"sfx", "n", "z", "bubble"}


def test_a_code_ends_at_its_moment(spark):
    rows = [(k, 1, f"2024-05-01 {at}", "2024-05-01 12:00:00", 9, False) for k, at in enumerate(("11:59:59", "12:00:00", "12:00:01"))]
    uses = spark.createDataFrame(rows, "redemption_id long, code_id long, redeemed_on string, expires_on string, allowed int, revoked boolean").selectExpr("redemption_id", "code_id", "CAST(redeemed_on AS TIMESTAMP) AS redeemed_on", "CAST(expires_on AS TIMESTAMP) AS expires_on", "allowed", "revoked")
    assert [r.redemption_id for r in accounts.valid_uses(uses).collect()] == [0]


def test_all_white_space_is_trimmed(spark):
    words = spark.createDataFrame([("　ab\n",), ("\tc ",), ("ab",)], "word string")
    assert [(r.word, r.letters) for r in text.dictionary(words).collect()] == [("ab", 2)]
    entries = spark.createDataFrame([("a", "b", "", None, 1), ("a", "c", "ja", "", 2)], "source_text string, translation string, source_language string, target_language string, seq long")
    assert [tuple(r)[:5] for r in memory.merge(entries).collect()] == [("a", "ja", "th", 2, "c")]


def test_signs_of_a_role_are_looked_for_once(spark):
    from boxloom.plans import catalogue

    from .conftest import DATA

    for name in ("j12_style", "j12_templates"):
        plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.lower().count("regexp_count") + plan.lower().count("regexp_extract_all") <= 8


def test_numbers_of_fingerprints(spark):
    """Whole numbers, which are written without the slow format, look as the format writes them."""
    values = [0.0, -0.0, 3.0, -3.0, 2.5, -0.001, 1e15, 1e20, -1e300, 123456789.0, 0.125, float("nan"), float("inf"), None]
    for f in ("%.2f", "%.4f"):
        c = style._formatted("v", f)
        got = spark.createDataFrame([(v,) for v in values], "v double").select(c.alias("a"), F.format_string(f, "v").alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got] and "CASE WHEN" in c._jc.toString()
