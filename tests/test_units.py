"""Exact values of the operators on small tables."""

import pytest
from pyspark.sql import functions as F

from scorelake.functions import rhythm, text as tx
from scorelake.operators import matching as m
from scorelake.operators import pages, problems, reports, rerun, scores, splits, textlines, tuning

BOX = "sample_id string, layer string, box_idx int, kind string, x1 double, y1 double, x2 double, y2 double"


def boxes(spark, *rows):
    return spark.createDataFrame([("a", "L3", i, k, *map(float, b)) for i, (k, b) in enumerate(rows)], BOX)


def test_box_matching(spark):
    gt = boxes(spark, ("", (0, 0, 10, 10)))
    pred = boxes(spark, ("", (100, 100, 110, 110)), ("", (0, 0, 10, 10)))
    r = m.box_metrics(gt, pred).first()
    assert (r.tp, r.fp, r.fn, r.mean_iou) == (1, 1, 0, 1.0)
    half = m.box_edges(gt, boxes(spark, ("", (5, 0, 15, 10))), ["sample_id"], 0.01).first()
    assert half.w == pytest.approx(1 / 3)


def test_count_and_zero_rules(spark):
    df = spark.createDataFrame([(4, 3), (0, 0), (0, 2), (2, 0)], "n_gt int, n_pred int")
    rows = {(r.n_gt, r.n_pred): r for r in m.count_metrics(df).collect()}
    assert (rows[4, 3].tp, rows[4, 3].fp, rows[4, 3].fn, rows[4, 3].abs_delta) == (3, 0, 1, 1)
    assert rows[0, 0].f1 == 1.0 and rows[0, 2].f1 == 0.0 and rows[2, 0].f1 == 0.0


def test_sequences(spark):
    seq = lambda s: spark.createDataFrame([("a", i, t) for i, t in enumerate(s)], "sample_id string, pos int, token string")
    r = m.sequence_metrics(seq("123"), seq("193")).first()
    assert r.lcs == 2 and r.f1 > 0.5


def row_and_lines(spark, left, right, xs):
    row = spark.createDataFrame([(0, 0, float(left), 40.0, float(right), 90.0)], "page_id int, system_idx int, x1 double, y1 double, x2 double, y2 double")
    lines = spark.createDataFrame([(0, 0, i, float(x)) for i, x in enumerate(xs)], "page_id int, system_idx int, split_idx int, x double")
    return row, lines


def test_split_algebra(spark):
    row, lines = row_and_lines(spark, 0, 200, [50, 52, 100])
    assert [r.x for r in splits.normalize_splits(lines, row).orderBy("x").collect()] == [51.0, 100.0]
    row, lines = row_and_lines(spark, 20, 400, [100, 200, 300])
    got = splits.derive_measures(row, lines).orderBy("measure_idx").collect()
    assert [(r.x1, r.x2) for r in got] == [(20.0, 100.0), (100.0, 200.0), (200.0, 300.0), (300.0, 400.0)]
    whole = splits.derive_measures(row, lines.where("false")).collect()
    assert [r.measure_source for r in whole] == ["whole_line"]
    row, lines = row_and_lines(spark, 20, 380, [40, 140, 240, 360])
    inner = splits.interior_splits(splits.as_lines(lines), row.withColumn("n_measures", F.lit(3)))
    assert sorted(r.x for r in inner.collect()) == [140.0, 240.0]


def test_move_is_clamped(spark):
    row, lines = row_and_lines(spark, 0, 400, [100, 200, 300])
    edits = spark.createDataFrame([(0, 0, 1, "move", "s1", 390.0)], "page_id int, system_idx int, edit_idx int, op string, split_id string, x double")
    got = splits.edit_splits(lines, edits, row).orderBy("x").collect()
    assert [(r.x, r.source) for r in got] == [(100.0, "detect"), (292.0, "user"), (300.0, "detect")]


def test_line_classes(spark):
    text = ["Title: 小星星", "1=C 4/4 tempo 80", "1 1 5 5 | 6 6 5 -", "一闪一闪亮晶晶", "来源: issue #29", "音高序列 1 1 5 5 6 6 5"]
    items = [(0, i, t, 10.0, 40.0 * i, 300.0, 40.0 * i + 30) for i, t in enumerate(text)]
    df = spark.createDataFrame(items, "page_id int, item_idx int, text string, x1 double, y1 double, x2 double, y2 double")
    kinds = [r.kind for r in textlines.classify_items(df).orderBy("item_idx").collect()]
    assert kinds == ["title", "meta", "pitch", "lyrics", "footer", "annotation"]


def test_lines_to_notes(spark):
    lines = spark.createDataFrame([(0, 0, "1 2 - | 0 3."), (0, 1, "5 - - - 6")], "page_id int, line_no int, text string")
    got = textlines.parse_lines_to_notes(lines).orderBy("measure_no", "note_idx").collect()
    assert [(r.measure_no, r.pitch, r.duration, r.dots) for r in got] == [
        (1, "1", "quarter", 0), (1, "2", "half", 0), (2, None, "quarter", 0), (2, "3", "quarter", 1), (3, "5", "whole", 0), (3, "6", "quarter", 0),
    ]


def test_text_helpers(spark):
    df = spark.createDataFrame([("　１｜２l 3 ",)], "t string").select(tx.plain_bars(tx.plain(F.col("t"))))
    assert df.first()[0] == "1|2 | 3"


def test_rhythm(spark):
    df = spark.createDataFrame([("4/4",), ("6/8",), ("x",)], "m string").select(rhythm.meter_capacity(F.col("m")))
    assert [r[0] for r in df.collect()] == [4.0, 3.0, 4.0]
    midi = spark.range(1).select(
        rhythm.midi_number(F.lit("1"), F.lit(0), F.lit("C")), rhythm.midi_number(F.lit("1"), F.lit(1), F.lit("1=Bb")),
        rhythm.midi_number(F.lit("4"), F.lit(0), F.lit("G"), F.lit("sharp")), rhythm.midi_hz(F.lit(69)),
    ).first()
    assert tuple(midi) == (60, 82, 73, 440.0)


def test_problems(spark):
    scores_ = spark.createDataFrame([("s",)], "score_id string")
    measures = spark.createDataFrame(
        [("s", 1, "structure_l3", "under", 2.0, 4.0), ("s", 2, "structure_l3", "ok", 0.0, 4.0)],
        "score_id string, measure_no int, source string, status string, beats double, capacity double",
    )
    notes = spark.createDataFrame(
        [("s", 1, 0, "1", False, 0.4, None, "geometry", "structure_l5")],
        "score_id string, measure_no int, note_idx int, pitch string, is_rest boolean, confidence double, ocr_score double, pitch_from string, note_source string",
    )
    regions = spark.createDataFrame([("s", 0, "title", "Song 123")], "score_id string, item_idx int, kind string, text string")
    got = problems.collect_problems(scores_, measures, notes, regions).orderBy("seq").collect()
    assert [(r.seq, r.kind) for r in got] == [
        (1, "meter_under"), (2, "geometry_pitch"), (3, "low_confidence"), (4, "empty_measure"), (5, "layout_pollution")
    ]
    assert got[0].message == "measure 1 is too short: 2.0/4.0 beats" and got[2].message == "note 1 of measure 1 [1] was read with confidence 0.40"


def test_splice_keeps_hand_edits(spark):
    base = spark.createDataFrame([("s", i + 1, t) for i, t in enumerate("12347")], "score_id string, measure_no int, tag string")
    patch = spark.createDataFrame([("s", 1, "6"), ("s", 2, "6")], "score_id string, measure_no int, tag string")
    crops = spark.createDataFrame([("s", 2, 3, 0.0, 0.0, 9.0, 9.0, 100, 100)], "score_id string, measure_from int, measure_to int, x1 double, y1 double, x2 double, y2 double, image_width int, image_height int")
    got = scores.splice_measures(base, patch, crops).orderBy("measure_no").collect()
    assert "".join(r.tag for r in got) == "16647" and [r.measure_no for r in got] == [1, 2, 3, 4, 5]


def test_loss_and_grids(spark):
    gt = boxes(spark, ("", (0, 0, 10, 10)), ("", (20, 0, 30, 10)))
    assert tuning.layer_loss(m.box_metrics(gt, gt)).first().loss == pytest.approx(0.0)
    grid = [r.value for r in tuning.param_grid(spark, 64, 16, 8).orderBy("trial").collect()]
    assert grid == [16.0, 24.0, 32.0, 40.0, 48.0, 56.0, 64.0]
    assert tuning.linspace_grid(spark, 16, 64, 40).count() == 40 and tuning.linspace_grid(spark, 16, 64, 40, most=13).count() == 13
    space = {"a": {"type": "float", "low": 1, "high": 2}, "b": {"type": "int", "low": 3, "high": 5}, "c": {"type": "bool"}}
    one, two = (sorted(map(str, tuning.sample_params(spark, space, 20, 42, {"a": 9.0}).collect())) for _ in range(2))
    assert one == two and len(one) == 20
    for r in tuning.sample_params(spark, space, 20, 42).where("trial > 0").collect():
        assert 1 <= r.params["a"] < 2 and r.params["b"] in (3.0, 4.0, 5.0) and r.params["c"] in (0.0, 1.0)


def test_params_overlay(spark):
    d = spark.createDataFrame([("l3", {"w": 24.0, "g": 18.0})], "layer string, params map<string,double>")
    o = spark.createDataFrame([("l3", {"w": 30.0, "z": 1.0})], "layer string, params map<string,double>")
    assert tuning.effective_params(d, o).first().params == {"w": 30.0, "g": 18.0}


def test_baseline_diff(spark):
    f = lambda rows: spark.createDataFrame(rows, "layer string, mean_f1 double")
    got = {r.layer: r.status for r in reports.diff_baselines(f([("L1", 0.9), ("L2", 0.5), ("L3", 0.4)]), f([("L1", 0.8), ("L2", 0.6), ("L3", 0.4)])).collect()}
    assert got == {"L1": "improved", "L2": "regressed", "L3": "unchanged"}


def test_gate(spark):
    rows = spark.createDataFrame(
        [("a", "x", None, 10, 10, 8, 1, True, True), ("b", "x", None, 10, 12, 6, None, True, False)],
        "sample_id string, subset string, error string, gt_n int, pred_n int, lcs int, bars_err int, key_ok boolean, time_ok boolean",
    )
    s = reports.accuracy_summary(rows)
    assert reports.gate(s, "x", 0.6).first().passed and not reports.gate(s, "x", 0.9).first().passed
    assert not reports.gate(s, "missing", 0.1).first().passed


def test_new_box_takes_its_place(spark):
    item = lambda i, layer, *b: (0, i, layer, f"{layer}-{i}", f"n{i}", "", *map(float, b), 0.9)
    items = spark.createDataFrame(
        [item(0, "L2", 0, 100, 400, 160), item(1, "L2", 0, 200, 400, 260), item(2, "L3", 0, 100, 100, 160), item(3, "L3", 0, 200, 400, 260), item(4, "L3", 110, 100, 390, 160)],
        "page_id int, item_idx int, layer string, id string, label string, kind string, x1 double, y1 double, x2 double, y2 double, confidence double",
    )
    bars = spark.createDataFrame([], "page_id int, system int, line_idx int, x double, id string, source string, confidence double")
    size = spark.createDataFrame([(0, 400, 400)], "page_id int, width int, height int")
    out = pages.rebuild_pages(items, bars, size)
    got = out["measures"].orderBy("global_no").collect()
    assert [(r.global_no, r.system_idx, r.x1) for r in got] == [(1, 0, 0.0), (2, 0, 110.0), (3, 1, 0.0)]
    assert [r.role for r in out["regions"].collect()] == ["score"]


def test_open_measures_join_once(spark):
    row = lambda s, i, closed, seg: (0, s, i, closed, seg, "whole_line" if seg == "open_trailing" else "l3_barline", 0.0, 9.0, 0.0, 0.7)
    data = [row(0, 0, True, "x"), row(0, 1, False, "open_trailing"), row(1, 0, False, "open_trailing"), row(2, 0, True, "x"), row(2, 1, True, "x")]
    df = spark.createDataFrame(data, "page_id int, system_idx int, measure_idx int, closed boolean, segment string, measure_source string, barline_x_left double, barline_x_right double, system_x1 double, confidence double")
    got = sorted((r.system_idx, r.measure_idx, r.cross_line) for r in rerun.merge_open_measures(df).collect())
    # row 1 gives its only measure to row 0, so it has none to take from row 2
    assert got == [(0, 0, False), (0, 1, True), (2, 0, False), (2, 1, False)]


def test_scores_from_items(spark):
    """Staff gate, both fallbacks, meta before all lines, lyrics, and a page without digits."""
    box = lambda page, i, text, y: (page, i, text, 0.9, 10.0, float(y), 400.0, float(y + 20))
    rows = [
        box("a", 0, "Title: Song 12", 0), box("a", 1, "1=D 3/4", 60), box("a", 2, "1 2 3 | 4 5 6 |", 300), box("a", 3, "春天来了啊啊", 340),
        box("a", 4, "7 1 2", 380), box("a", 5, "Page 1", 990),
        ("b", 0, "note 5", 0.9, None, None, None, None), ("b", 1, "x 6", 0.9, None, None, None, None),
        ("c", 0, "no digits here", 0.9, None, None, None, None), ("c", 1, "", 0.9, None, None, None, None), ("c", 2, None, 0.9, None, None, None, None),
    ]
    items = spark.createDataFrame(rows, "page_id string, item_idx int, text string, score double, x1 double, y1 double, x2 double, y2 double")
    got = textlines.scores_from_items(items)
    pages = {r.page_id: r for r in got["pages"].collect()}
    assert {p: r.mode for p, r in pages.items()} == {"a": "score", "b": "score", "c": "ocr_only"}
    assert (pages["a"].key, pages["a"].time_signature, pages["a"].title) == ("D", "3/4", "Song 12")
    notes = sorted(tuple(r) for r in got["notes"].select("page_id", "measure_no", "note_idx", "pitch", "lyric").collect())
    a = [n for n in notes if n[0] == "a"]
    assert [(n[1], n[2], n[3]) for n in a] == [(m, i, p) for m, bar in enumerate(["123", "456", "712"], 1) for i, p in enumerate(bar)]
    assert [n[4] for n in a] == [*"春天来了啊啊", None, None, None]
    assert [n[3] for n in notes if n[0] == "b"] == ["5", "6"]


def test_edit_batches_that_run_twice(spark, tmp_path):
    """A micro-batch that runs again, or again after a crash between its two writes, changes nothing."""
    from scorelake.operators.pages import apply_edits
    from scorelake.streaming.jobs import PageEdits

    items = spark.createDataFrame(
        [(p, i, "L3", f"id{i}", "lab", "score", 0.0, 0.0, 50.0, 50.0, 1.0) for p in (1, 2, 3) for i in range(3)],
        "page_id int, item_idx int, layer string, id string, label string, kind string, x1 double, y1 double, x2 double, y2 double, confidence double",
    )
    pages = spark.createDataFrame([(p, 100, 100) for p in (1, 2, 3)], "page_id int, width int, height int")
    edit = "page_id int, edit_idx int, id string, layer string, label string, x1 double, y1 double, x2 double, y2 double"
    batches = [
        [(1, 0, "id0", "", "", 1.0, 1.0, 9.0, 9.0), (2, 1, "", "L3", "lab", 5.0, 5.0, 30.0, 30.0)],
        [(1, 2, "", "L3", "lab", 7.0, 7.0, 60.0, 60.0), (1, 3, "id1", "", "", 2.0, 2.0, 2.0, 2.0)],
    ]
    read = lambda df: sorted(tuple(r) for r in df.select("page_id", "item_idx", "x1", "y1", "x2", "y2", "edited").collect())
    state = PageEdits(items, pages, str(tmp_path))
    assert read(state.current(0)) == read(items.withColumn("edited", (items.page_id < 0)))
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, edit)
        df.write.mode("overwrite").parquet(f"{tmp_path}/log/batch={n}")  # as far as a crashed try came
        state.take(df, n)
        once = read(state.current(n + 1))
        state.take(df, n)
        assert read(state.current(n + 1)) == once
        assert once == read(apply_edits(items, spark.createDataFrame(sum(batches[: n + 1], []), edit), pages))
    assert read(state.current(1)) == read(apply_edits(items, spark.createDataFrame(batches[0], edit), pages))
