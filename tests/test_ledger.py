"""Key pools, patches, restores, tags and texts on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from boxloom.functions import text as tx
from boxloom.operators import exchange, intake, layout, ledger, memory


def plain_state(calls):
    failures, until, at = 0, 0.0, 0.0
    for at, outcome in calls:
        if until and at >= until:
            failures, until = 0, 0.0
        if outcome == "ok":
            failures, until = 0, 0.0
        else:
            failures += 1
            until = at + 120 if outcome == "limited" else at + 60 if failures >= 3 else until
    return failures, until, at


def test_key_states_walk_like_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(k % 2, k, float(at), at, rng.choice(["ok", "failed", "failed", "limited"])) for k in range(12) for at in sorted(rng.sample(range(1, 900), 40))]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        states = ledger.key_states(spark.createDataFrame(rows, "provider int, key int, at double, seq long, outcome string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r["key"]: (r["failures"], r["cooldown_until"], r["last_seen"]) for r in states}
    want = {k: plain_state(sorted((at, o) for _, key, at, _, o in rows if key == k)) for k in range(12)}
    assert got == want and len(states) == 12
    health = ledger.pool_health(spark.createDataFrame(states), 500.0).collect()
    assert sum(r["total"] for r in health) == 12 and all(r["active"] + r["cooling"] == r["total"] for r in health)


def test_key_states_of_no_calls(spark):
    assert ledger.key_states(spark.createDataFrame([], "provider int, key int, at double, seq long, outcome string")).count() == 0


def test_a_patch_for_an_unknown_block_fails_the_batch(spark):
    blocks = spark.createDataFrame([("a", 1.0, "t"), ("b", 2.0, None)], "block_id string, x double, translation string")
    ok = spark.createDataFrame([("a", None, "n")], "block_id string, x double, translation string")
    assert sorted(map(tuple, ledger.patched(blocks, ok).select("block_id", "x", "translation").collect())) == [("a", 1.0, "n"), ("b", 2.0, None)]
    with pytest.raises(Exception, match="unknown block"):
        ledger.patched(blocks, ok.union(spark.createDataFrame([("z", 5.0, "n")], ok.schema))).collect()


def test_restore_gives_defaults_and_new_ids(spark):
    docs = spark.createDataFrame([(1, '[{"block_id":"a","x":3.5},{"block_id":"b","block_index":4,"font_size":30.0},{}]'), (2, "[]"), (3, None)], "page_id int, document string")
    got = {r["block_index"]: r for r in exchange.restore(docs, spark.createDataFrame([("b",)], "block_id string")).where("block_id != 'a'").collect()}
    back = exchange.restore(docs, spark.createDataFrame([("b",)], "block_id string"))
    assert back.count() == 3 and back.select("block_id").distinct().count() == 3
    assert got[4]["block_id"] != "b" and got[4]["font_size"] == 30.0 and got[4]["width"] == 100.0 and got[4]["font_family"] == "NotoSansThai"
    assert back.where("block_id = 'a'").first()["x"] == 3.5 and back.where("block_id = 'a'").first()["font_size"] == 20.0


def test_tabs_name_bad_lines(spark):
    lines = spark.createDataFrame([(1, 0, "# note"), (1, 1, "src\ttr\\nnext"), (1, 2, "a\tb\tc"), (1, 3, " "), (1, 4, "n\tid\ts\tt\tu"), (1, 5, "\ttr")], "file_id int, line_no int, line string")
    got = {r["line_no"]: r for r in exchange.read_tabs(lines).collect()}
    assert sorted(got) == [1, 2, 4, 5]
    assert got[1]["translation"] == "tr\nnext" and got[1]["position"] == 1 and got[5]["position"] == 3 and got[5]["source"] is None
    assert got[2]["error"].startswith("line 3") and got[4]["block_id"] == "id" and got[4]["translation"] == "t\tu"


def test_export_has_no_unknown_mode(spark):
    with pytest.raises(ValueError):
        exchange.export_text(spark.range(1), "pdf", {"a": "b"})


@pytest.mark.parametrize("value,text,label,repeated", [
    ("hi {soft}", "hi", "soft", False), ("hi {shout} { soft } ", "hi", "soft", True), ("hi {other}", "hi {other}", None, False),
    ("{soft}", "", "soft", False), ("hi {soft} there", "hi {soft} there", None, False), (None, "", None, False), ("a {other} {shout}", "a {other}", "shout", False),
])
def test_trailing_tags(spark, value, text, label, repeated):
    t = spark.createDataFrame([(value,)], "v string").select(*[c.alias(k) for k, c in tx.trailing_tag(F.col("v"), {"soft": "s", "shout": "x"}).items()]).first()
    assert (t["text"], t["label"], t["repeated"]) == (text, label, repeated)
    assert t["role"] == {"soft": "s", "shout": "x", None: None}[label]


@pytest.mark.parametrize("value,want", [("(「…", "(「…"), ("(「」) ~", ""), ("// hi /", "hi"), ("」 hi「", "hi"), (None, ""), ("", ""), ("a/b", "a/b")])
def test_noise(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(tx.without_noise(F.col("v"))).first()[0] == want


def test_recognised_text(spark):
    clean = lambda v, lang, **k: spark.createDataFrame([(v, lang)], "v string, l string").select(tx.clean_recognised(F.col("v"), F.col("l"), **k)).first()[0]
    assert clean("漢字（かな）です\r\nか", "ja", readings=True) == "漢字ですか"
    assert clean("a \r\n b,　c", "en") == "a b, c"
    assert clean("a b!", "zh", wide=True) == "ab！"
    assert clean(None, "ja") is None


def test_first_meaning_prefers_dictionary_order(spark):
    d = spark.createDataFrame([("ドドド", "dododo", "rumble", 2), ("ドン", "don", "bang", 1), ("バン", "ド", "x", 0)], "orig string, romaji string, meaning string, ord int")
    asked = spark.createDataFrame([("ド",), ("DON",), ("zz",)], "query string")
    assert {tuple(r) for r in memory.first_meaning(d, asked).collect()} == {("ド", "x"), ("DON", "bang")}


def test_layout_score_of_no_lines_and_regions_of_nan(spark):
    none = spark.createDataFrame([([], 1)], "w array<double>, k int").select(layout.layout_score(F.lit(20.0), F.col("w"), F.lit(10.0), F.lit(None).cast("double"), F.lit(5.0), F.lit(5.0), F.lit("bubble")))
    assert none.first()[0] == -99999.0
    r = spark.createDataFrame([(1.0, 2.0, 0.0, 9.0, None, None, None, None, float("nan"), 1.0, 50.0, 50.0, 2.0, "manual")],
                              "x double, y double, width double, height double, smart_x double, smart_y double, smart_width double, smart_height double, meta_x double, meta_y double, meta_width double, meta_height double, meta_confidence double, meta_source string")
    got = layout.effective_region(r).first()["region"]
    assert (got["x"], got["width"], got["source"], got["confidence"]) == (1.0, 1.0, "bbox", 0.0)


def test_labelled_records(spark):
    text = ["stray", "# Bubble 3: x", "[คำต้นฉบับ]: src", "under", "# note", "", "more {soft}", "# ID: b-7", "ignored", "[คำต้นฉบับ]: old", "[คำต้นฉบับ]: new", "[คำแปล]: first", "[คำแปลไทย]: told", "[[SMART_BALLOON_SPATIAL shape=ellipse target_lines=2 max_lines=4]]", "next", "# bubble 4"]
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(text)], "file_id int, line_no int, line string")
    got = {r["line_no"]: (r["block_id"], r["bubble"], r["source"], r["translation"]) for r in exchange.read_labelled(lines).collect()}
    assert got == {1: (None, 3, "src", "under\nmore {soft}"), 7: ("b-7", None, "new", "told\nnext"), 15: (None, 4, None, "")}


def test_records_find_their_blocks(spark):
    blocks = spark.createDataFrame([(1, "a", 1, "x y"), (1, "b", 2, "x  y"), (1, "c", 3, None), (2, "d", 1, "z")], "project_id int, block_id string, bubble int, source_text string")
    rows = [
        (1, 1, None, "xy", None, "ก", "th"), (1, 2, None, "x y", None, "plain", "th"), (1, 3, None, "x y", None, "ก", "th"), (1, 4, "a", None, None, "ก", "th"),
        (1, 5, None, None, 3, " ", "th"), (1, 6, None, None, 9, "ก", None), (1, 7, "nope", None, None, "ก", "th"), (2, 1, "d", "other", None, "text", None),
    ]
    records = spark.createDataFrame(rows, "project_id int, record_no int, block_id string, source string, bubble int, translation string, target string")
    found = intake.resolved_in_order(records, blocks)
    got = {(r["project_id"], r["record_no"]): (r["block_id"], r["status"], r["will_import"]) for r in found.collect()}
    assert got == {
        (1, 1): ("a", "ok", True), (1, 2): ("b", "warning", False), (1, 3): (None, "warning", False), (1, 4): ("a", "error", False),
        (1, 5): ("c", "skip", False), (1, 6): (None, "error", False), (1, 7): (None, "error", False), (2, 1): ("d", "warning", True),
    }
    assert [r["block_id"] for r in exchange.importable(found).collect()] == ["d"]
    assert exchange.importable(intake.resolved_in_order(records, blocks, strict=True)).count() == 0


def test_decision_counts_on_a_stream(spark, tmp_path):
    rows = [(k, f"2024-01-01 0{k % 3}:10:00", ["accepted", "odd", None][k % 3], "s", "t", "one", None) for k in range(9)]
    events = spark.createDataFrame(rows, "event_id int, ts string, change_reason string, suggested string, selected string, suggested_lines string, final_lines string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = ledger.decision_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("decided").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = sorted(map(tuple, spark.table("decided").collect()))
    finally:
        q.stop()
    assert got == sorted(map(tuple, ledger.decision_counts(events).collect())) and sum(r[-1] for r in got) == 9


def test_tag_map_replaces_templates_and_labels(spark):
    from pyspark.sql import Row

    builtin = [Row(template_id="p", label="soft", ord=0), Row(template_id="q", label="loud", ord=1)]
    own = spark.createDataFrame([(1, "p", "calm", 0), (1, "z", "loud", 1), (2, "w", None, 0)], "project_id int, template_id string, label string, ord int")
    got = {tuple(r) for r in exchange.tag_map(builtin, own).collect()}
    assert got == {(1, "calm", "p"), (1, "loud", "z"), (2, "soft", "p"), (2, "loud", "q")}


def test_a_block_that_an_id_took_is_not_found_again(spark):
    blocks = spark.createDataFrame([(1, "a", 1, "same"), (1, "b", 2, "same")], "project_id long, block_id string, bubble int, source_text string")
    records = spark.createDataFrame([(1, 1, "a", None, 1, "ก one", "th"), (1, 2, None, "same", 2, "ก two", "th")], "project_id long, record_no long, block_id string, source string, bubble int, translation string, target string")
    found = intake.resolved_in_order(records, blocks)
    assert [(r.block_id, r.status) for r in found.orderBy("record_no").collect()] == [("a", "ok"), ("b", "ok")]
    assert exchange.importable(found).count() == 2


def test_records_are_matched_once_and_many_projects_share_a_call(spark):
    blocks = spark.createDataFrame([(p, f"b{p}-{k}", k, f"text {p} {k}") for p in range(30) for k in (1, 2, 3)], "project_id long, block_id string, bubble int, source_text string")
    records = blocks.selectExpr("project_id", "CAST(bubble AS BIGINT) AS record_no", "CASE WHEN project_id % 3 = 0 AND bubble = 2 THEN 'gone' END AS block_id", "source_text AS source", "bubble", "'ก' AS translation", "'th' AS target")
    goes = exchange.importable(intake.resolved_in_order(records, blocks))
    plan = goes._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and plan.count("MapInArrow") == 1
    assert sorted((r.project_id, r.block_id) for r in goes.collect()) == sorted((p, f"b{p}-{k}") for p in range(30) if p % 3 for k in (1, 2, 3))


def test_labelled_lines_are_sorted_once(spark):
    """One window tells records and marks; earlier translation marks and what stood below them go, lines before any mark too."""
    text = ["x", "# ID: a", "early", "[คำแปล]: one", "gone", "[คำต้นฉบับ]: src", "[คำแปลไทย]: two", "more", "", "# note", None, "end", "# bubble 12 x", "[คำต้นฉบับ]: s1", "plain", "[คำต้นฉบับ]: s2"]
    out = exchange.read_labelled(spark.createDataFrame([(f, k, t) for f in (1, None) for k, t in enumerate(text)], "file_id int, line_no int, line string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    want = [(1, "a", None, "src", "two\nmore\nend"), (12, None, 12, "s2", "plain")]
    for f in (1, None):
        assert sorted(tuple(r)[1:6] for r in out.collect() if r.file_id == f) == want


def test_project_documents_are_dealt_flat(spark):
    """Blocks are dealt as rows, not as lists gathered before; null numbers come first."""
    blocks = spark.createDataFrame([(1, "b", 2, 1.0), (1, "a", 2, 2.0), (1, "c", None, 3.0)], "page_id int, block_id string, block_index int, x double")
    pages = spark.createDataFrame([(1, 7, 5), (2, 7, 4)], "page_id int, project_id int, page_number int")
    out = exchange.project_documents(blocks, pages)
    assert out._jdf.queryExecution().sparkPlan().toString().count("REPARTITION_BY_COL") == 2
    assert out.collect()[0].document == (
        '{"id":7,"pages":[{"id":2,"page_number":4,"text_blocks":[]},{"id":1,"page_number":5,"text_blocks":[{"id":"c","block_index":null,"x":3.0},'
        '{"id":"a","block_index":2,"x":2.0},{"id":"b","block_index":2,"x":1.0}]}]}')


def test_explicit_orders_are_settled_by_the_sort_that_joins_them(spark):
    rng = random.Random(11)
    blocks = [(p, f"b{k}") for p in range(5) for k in range(30)] + [(4, "b3")]
    lists = [(p, [rng.choice(["gone", f"b{rng.randrange(40)}"]) for _ in range(60)]) for p in range(4)] + [(4, ["b3"]), (9, ["b1"])]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = ledger.explicit_order(spark.createDataFrame(blocks, "page_id long, block_id string"), spark.createDataFrame(lists, "page_id long, ids array<string>"))
        got = sorted(map(tuple, placed.collect()))
        plan = placed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    last = {(p, b): k for p, ids in lists for k, b in enumerate(ids)}
    assert got == sorted((*key, last[key]) for key in blocks if key in last) and [r for r in got if r[0] == 4] == [(4, "b3", 0)] * 2
    final = plan.partition("Initial Plan")[0]
    assert "HashAggregate" not in final and final.count("Sort [") == 2
