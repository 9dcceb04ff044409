"""Steps whose disk, memory or time must not outgrow the input."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scorelake.catalog import QUERIES
from scorelake.operators import placement as pl
from scorelake.plans import greedy, skew, spatial


def boxes(spark, n, keys, seed, side=200):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        x, y = float(rnd.randrange(900)), float(rnd.randrange(900))
        data.append((rnd.randrange(keys), i, x, y, x + rnd.randrange(1, side), y + rnd.randrange(1, side)))
    return spark.createDataFrame(data, "page_id int, i int, x1 double, y1 double, x2 double, y2 double")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sets(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_boxes_of_ordinary_pages_are_not_cut_into_tiles(spark, monkeypatch):
    a, b = boxes(spark, 300, 6, 1), boxes(spark, 300, 6, 2)
    few = spatial.touching(a, b, ["page_id"], tile=16.0, pad=2.0)
    assert "Generate" not in plan_of(few)
    points = a.withColumns({"px": F.col("x1"), "py": F.col("y1")})
    assert "Generate" not in plan_of(spatial.near(points, b, ["page_id"], tile=16.0))
    got = sets(few, "page_id", "l.i", "r.i")
    monkeypatch.setattr(spatial, "MEET_ROWS", 90)  # some of the pages go through tiles
    assert got and got == sets(spatial.touching(a, b, ["page_id"], tile=16.0, pad=2.0), "page_id", "l.i", "r.i")


@pytest.mark.parametrize("limit", [0, 90])
def test_placement_of_ordinary_pages_equals_that_of_crowded_ones(spark, monkeypatch, limit):
    a, b = boxes(spark, 300, 6, 3, 60), boxes(spark, 40, 6, 4, 300)
    a = a.withColumnsRenamed({"i": "r"}).withColumn("stated", F.when(F.col("r") % 5 == 0, F.col("r") % 60))
    items = a.select("page_id", F.col("r").alias("item_idx"), F.concat(F.lit("L"), F.col("r") % 5 + 1).alias("layer"),
                     F.when(F.col("r") % 3 == 0, "score").otherwise("x").alias("kind"), F.lit("").alias("label"), "x1", "y1", "x2", "y2")
    host = b.withColumnRenamed("i", "h")
    slots = b.select("page_id", F.col("i").alias("note_idx"), F.lit("pitch").alias("kind"), "x1", "y1", "x2", "y2")

    def all_of():
        return [
            sets(pl.assign_to_systems(a, host, row="r", host="h"), "page_id", "r", "h"),
            sets(pl.assign_by_penalty(a, host, row="r", host="h"), "page_id", "r", "h"),
            sets(pl.assign_to_measures(a, host, row="r", host="h", stated="stated"), "page_id", "r", "h"),
            sets(pl.bind_glyphs(a.withColumnRenamed("stated", "stated_idx"), slots, keys=["page_id"], row="r"), "page_id", "r", "note_idx"),
            sets(pl.parent_of(items), "page_id", "item_idx", "parent"),
        ]

    few = all_of()
    monkeypatch.setattr(spatial, "MEET_ROWS", limit)
    monkeypatch.setattr(pl, "MEET_ROWS", limit)
    assert few == all_of()


def test_walk_of_whole_keys_equals_the_walk_edge_by_edge(monkeypatch):
    rnd = random.Random(5)
    rows = sorted({(rnd.randrange(40), rnd.randrange(4), rnd.randrange(4)): rnd.random() for _ in range(600)}.items(), key=lambda r: (r[0][0], r[1]))
    batch = pa.RecordBatch.from_pydict({"k": [r[0][0] for r in rows], "gi": [r[0][1] for r in rows], "pi": [[r[0][2]] for r in rows], "w": [r[1] for r in rows]})
    want, used = [], set()
    for i, ((k, g, p), _) in enumerate(rows):
        if ("g", k, g) not in used and ("p", k, p) not in used:
            used |= {("g", k, g), ("p", k, p)}
            want.append(i)
    assert greedy._take_whole(batch, ["k"], 0, len(rows)) == want
    monkeypatch.setattr(greedy, "ROUNDS", 1)  # the rest one by one
    assert greedy._take_whole(batch, ["k"], 0, len(rows)) == want


def test_written_page_tables_are_packed_and_read_by_column(spark):
    from scorelake.plans.lineage import cut, written

    bands = boxes(spark, 2000, 50, 6).withColumn("role", F.lit("underline"))
    kept = written(bands)
    assert sets(kept, *bands.columns) == sets(bands, *bands.columns)
    assert "ReadSchema: struct<page_id:int>" in plan_of(kept.select("page_id"))
    assert "ReadSchema" not in plan_of(cut(bands).select("page_id"))


def test_bands_are_ranked_without_the_columns_no_step_reads(spark, monkeypatch):
    from scorelake.adapters import view
    from scorelake.operators import bands as bd

    seen = []
    monkeypatch.setattr(bd, "written", lambda df: seen.append(df.columns) or df)
    bd.melody_anchors(bd.classify_bands(view(spark, "/root/testdata/sf0.001", "bands"))).schema
    assert not {"n_square", "n_comps", "staff_score", "role"} & set(seen[0])


def test_notes_of_pages_are_worked_out_once(spark, monkeypatch):
    """Hints, packing, numbering and lyrics read the written notes, not the whole chain of steps again."""
    from scorelake.catalog.textlines import ocr_items
    from scorelake.operators import textlines as tl

    seen, real = [], tl.written
    monkeypatch.setattr(tl, "written", lambda df: seen.append(set(df.columns)) or real(df))
    items = ocr_items(spark, "/root/testdata/sf0.001").where("page_id < 10")
    out = tl.scores_from_items(items)
    shape = {"page_id", "measure_no", "note_idx", "pitch", "is_rest", "duration", "dots"}
    assert seen.count(shape) == 2  # the notes of the pages, and with those of bare digits
    assert out["notes"].count() > 0


def test_notes_of_lines_are_split_after_the_only_shuffle(spark):
    """A line is one row until its measures are numbered; no token is dealt out or sorted."""
    from scorelake.operators import textlines as tl

    lines = spark.createDataFrame(
        [(0, 0, "- . | 1 x - 2 -.. || | 0"), (0, 1, "no notes | -"), (0, 2, "| 7 . - . - 3"), (1, 5, "4—–5")], "page_id int, line_no int, text string"
    )
    out = tl.parse_lines_to_notes(lines)
    assert plan_of(out).count("Exchange hashpartitioning") == 1
    assert sets(out, "page_id", "line_no", "measure_no", "note_idx", "is_rest", "duration", "dots") == [
        (0, 0, 1, 0, False, "half", 0), (0, 0, 1, 1, False, "half", 2), (0, 0, 2, 0, True, "quarter", 0),
        (0, 2, 3, 0, False, "half", 2), (0, 2, 3, 1, False, "quarter", 0), (1, 5, 1, 0, False, "half", 1), (1, 5, 1, 1, False, "quarter", 0),
    ]
    assert sorted(r.pitch or "" for r in out.collect()) == ["", "1", "2", "3", "4", "5", "7"]


def test_tokens_of_score_documents_need_no_shuffle(spark):
    from scorelake.sources import documents as dc

    note = lambda p, more="": f'{{"pitch":{p}{more}}}'
    part = lambda *bars: '{"measures":[' + ",".join(f'{{"number":{i},"notes":{b}}}' for i, b in enumerate(bars)) + "]}"
    docs = spark.createDataFrame([
        (1, '{"parts":[' + part("[" + note('"1"', ',"accidental":"sharp"') + "]", "null", "[" + note("null", ',"is_rest":true') + "," + note('"5"') + "]") + "," + part("[" + note('"7"') + "]") + "]}"),
        (2, '{"parts":[' + part("[" + note('"1"') + "]") + '],"extra":{"eval":{"pitch_sequence":["3","4"]}}}'),
        (3, "{}"), (4, "no json"),
    ], "doc_id int, doc string")
    out = dc.score_tables(docs)["tokens"]
    assert "Exchange" not in plan_of(out)
    assert sets(out, "score_id", "pos", "token") == [(1, 0, "1#"), (1, 1, "5"), (2, 0, "3"), (2, 1, "4")]


def test_notes_of_a_score_are_dealt_out_once(spark):
    from scorelake.adapters import view
    from scorelake.sources import documents as dc

    sf = "/root/testdata/sf0.001"
    out = dc.score_documents(view(spark, sf, "scores"), view(spark, sf, "score_notes"))
    assert plan_of(out).count("Exchange hashpartitioning") == 1  # that of the notes; so few scores are broadcast


def test_truth_documents_are_read_once_for_all_layers(spark):
    from scorelake.sources import documents as dc

    b = '"x1":1,"y1":2,"x2":3,"y2":4'
    docs = spark.createDataFrame([
        (1, f'{{"layers":{{"l1":{{"regions":[{{"role":"score","box":{{{b}}}}}]}},"L2":{{"systems":[{{{b}}}]}}}},"l3_measures":[{{"x1":"no"}},{{"rect":{{{b}}}}}]}}'),
        (2, f'{{"l\\u0034_notes":[{{"kind":"lyric","b\\u006fx":{{{b}}}}}]}}'),  # names written with escapes
        (3, f'{{"layers":{{"L1":{{"regions":[]}}}},"l1_regions":[{{{b}}}]}}'), (4, "no json"),
    ], "doc_id int, doc string")
    out, _ = dc.ground_truth_geometry(docs)
    assert "Union" not in plan_of(out)
    assert sets(out, "sample_id", "layer", "box_idx", "label", "kind", "x1", "y2") == [
        (1, "L1", 0, "score", "score", 1.0, 4.0), (1, "L2", 0, "sys0", "system", 1.0, 4.0), (1, "L3", 1, "m2", "measure", 1.0, 4.0),
        (2, "L4", 0, "n0", "lyric", 1.0, 4.0), (3, "L1", 0, "region", "region", 1.0, 4.0),
    ]


@pytest.mark.parametrize("name", ["assemble_scores", "collect_problems"])
def test_rows_of_a_task_do_not_grow_with_the_tables(spark, monkeypatch, name):
    sf = "/root/testdata/sf0.001"
    few = QUERIES[name](spark, sf)
    assert "REPARTITION_BY_NUM" not in plan_of(few)
    monkeypatch.setattr(skew, "TASK_ROWS", 500)
    many = QUERIES[name](spark, sf)
    assert "REPARTITION_BY_NUM" in plan_of(many)
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))


def test_notes_of_pages_are_not_dealt_out_again(spark, monkeypatch):
    """Lines are dealt out; packing, rebalancing and numbering take the notes of a page where they are, and hot pages give the same rows."""
    from scorelake.catalog.textlines import ocr_items
    from scorelake.operators import scores as sc
    from scorelake.operators import textlines as tl

    lines = tl.lines_from_items(ocr_items(spark, "/root/testdata/sf0.001").where("page_id < 12")).localCheckpoint()
    meta = tl.page_meta(lines)
    columns = ("page_id", "line_no", "measure_no", "note_idx", "pitch", "is_rest", "duration", "dots")
    out = tl.parse_pages(lines, meta)
    steps = plan_of(out)
    assert "MapInArrow" in steps and "SortMergeJoin" not in steps
    assert steps.count("Exchange hashpartitioning") == 2  # the lines, once for each kind of page
    got = sorted(map(str, out.select(*columns).collect()))
    monkeypatch.setattr(tl, "SCAN_ROWS", 200)
    assert got and got == sorted(map(str, tl.parse_pages(lines, meta).select(*columns).collect()))


def test_rebalance_walk_equals_plain_python(spark, monkeypatch):
    from scorelake.operators import scores as sc

    rnd, beats, data, want = random.Random(7), {"whole": 4.0, "half": 2.0, "quarter": 1.0, "eighth": 0.5}, [], set()
    for s in range(30):
        cap, last = rnd.choice([3.0, 4.0, 0.0, None]), 0
        for m in range(1, rnd.randrange(2, 6)):
            first, no, acc = last + 1, last + 1, 0.0
            mine = [rnd.choice(list(beats)) for _ in range(rnd.randrange(1, 9))]
            over = bool(cap) and len(mine) > 1 and sum(map(beats.get, mine)) > cap + 0.35
            for i, d in enumerate(mine):
                if over and acc > 0 and acc + beats[d] > cap:
                    no, acc = no + 1, 0.0
                data.append((s, m, i, d, 0, cap))
                want.add((s, m, i, no if over else first))
                last, acc = no if over else first, acc + beats[d]
                if over and acc >= cap:
                    no, acc = no + 1, 0.0
    df = spark.createDataFrame(data, "score_id int, measure_no int, note_idx int, duration string, dots int, capacity double").repartition(7)
    columns = ("score_id", "measure_no", "note_idx", "new_measure_no")
    assert set(sets(sc.rebalance(df), *columns)) == want
    monkeypatch.setattr(skew, "TASK_ROWS", 50)  # dealt out to more tasks than the session's
    out = sc.rebalance(df)
    assert "REPARTITION_BY_NUM" in plan_of(out) and set(sets(out, *columns)) == want
    monkeypatch.setattr(sc, "SCAN_ROWS", 12)  # most scores are hot
    placed = sc.rebalance(df, place="at")
    assert set(sets(placed, *columns)) == want
    assert sets(placed, *columns, "at") == sets(out.withColumn("at", F.expr("row_number() over (partition by score_id, new_measure_no order by note_idx) - 1")), *columns, "at")


def test_texts_are_searched_once_for_their_classes_and_bars(spark, monkeypatch):
    from scorelake.operators import textlines as tl

    seen, real = [], tl.written
    monkeypatch.setattr(tl, "written", lambda df: seen.append(df.columns) or real(df))
    items = spark.createDataFrame(
        [(1, 0, "1 2 3|4", 0.0, 0.0, 70.0, 9.0), (1, 1, "Title: x", 0.0, 9.0, 9.0, 30.0), (2, 0, None, None, None, None, None), (2, 1, chr(0x1D11E) + "123", 0.0, 0.0, 50.0, 9.0)],
        "page_id int, item_idx int, text string, x1 double, y1 double, x2 double, y2 double",
    )
    out = tl.classify_items(items)
    assert len(seen) == 1 and "rlike" not in plan_of(out).lower() and "regexp" not in plan_of(out).lower()
    assert sets(out, "page_id", "item_idx", "kind") == [(1, 0, "pitch"), (1, 1, "title"), (2, 1, "pitch")]
    bars = spark.createDataFrame([(1, 20.0), (1, 40.0), (1, 41.0), (2, 10.0), (2, 25.0)], "page_id int, x double")
    out = tl.inject_bars(items, bars)
    assert len(seen) == 2 and "regexp" not in plan_of(out).lower() and "split(" not in plan_of(out).lower()
    assert sets(out.where("text is not null"), "page_id", "item_idx", "text") == [
        (1, 0, "1  | 2  | 3 | 4"), (1, 1, "Title: x"), (2, 1, chr(0x1D11E) + " | 1 | 23"),
    ]


def test_words_are_found_as_by_the_plain_patterns(spark):
    from scorelake.functions import text as tx

    words = ["音高序列", "PITCH  sequence", "pİtch", "gt", "xgt", "ground-truth", "子集", "来源", "授权", "CC0", "copyright", "©", "ıssue #", "iſſue#", "generate-eval",
             "SCRIPTS/", "Key", "key", "tİme", "tempo", "bpm", "拍号", "调 ：", "调:", "速度", "1 = c", "1=G", "time  signature", "Title", "ſample", "样例", "eval e1", "标题", "示意",
             "1 2|3", " 1·2 ", "　", "", "   7", "12 x", " a ", "a \n"]
    df = spark.createDataFrame([(a + w + b,) for w in words for a in ("", "t ", "ke", "　") for b in ("", " e", "\n")], "t string")
    t = F.col("t")
    for group in tx.BEGIN_OF:
        assert df.where(tx.names(t, group) != t.rlike(group)).collect() == []
    assert df.where(tx.is_pure(t) != tx.squeezed(t).rlike(tx.PURE_TOKENS)).collect() == []
    assert df.where(tx.trimmed(t) != tx.strip(t)).collect() == []


def test_lines_and_boxes_of_a_sweep_are_worked_out_once(spark, monkeypatch):
    from scorelake.operators import tuning as tu

    seen, real = [], tu.written
    monkeypatch.setattr(tu, "written", lambda df: seen.append(df.columns) or real(df))
    out = QUERIES["param_sweep"](spark, "/root/testdata/sf0.001")
    assert [c[0] for c in seen] == ["page_id", "trial", "trial", "page_id"]  # rows, thinned lines, boxes, true boxes
    assert "events.parquet" not in plan_of(out) and "array_sort" not in plan_of(out)
    assert out.count() > 0


@pytest.mark.parametrize("name", ["param_sweep", "sweep_summary"])
def test_a_sweep_broadcasts_its_grid_and_no_table(spark, monkeypatch, name):
    from scorelake.operators import tuning as tu

    plans = []
    for step in ("written", "cut"):
        monkeypatch.setattr(tu, step, lambda df, real=getattr(tu, step): plans.append(plan_of(df)) or real(df))
    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    plans += [plan_of(out)] if name == "param_sweep" else []  # the summary's last join broadcasts its one row
    joins = [line for plan in plans for line in plan.split("\n") if "BroadcastHashJoin" in line]
    assert joins and all("_part" in line and "BuildRight" in line for line in joins)


def test_packed_tables_are_merged_and_few_keys_broadcast(spark):
    from scorelake.plans.lineage import written

    table = written(spark.range(1000).withColumn("v", F.lit(1)))
    other = spark.range(1000)
    assert "SortMergeJoin" in plan_of(table.join(other, "id")) and "SortMergeJoin" in plan_of(other.join(table.where("v = 1"), "id"))
    assert "BroadcastHashJoin" in plan_of(table.join(skew.small(other, 1000), "id"))


# most exchanges in a plan of the query
EXCHANGES = {"system_boxes": 16, "label_bands": 4, "role_y_ranges": 4, "own_bands": 3}


@pytest.mark.parametrize("name", EXCHANGES)
def test_bands_are_dealt_out_by_page_once_a_step(spark, monkeypatch, name):
    from scorelake.catalog import bands as cb
    from scorelake.operators import bands as bd

    plans = []
    for module in (cb, bd):
        monkeypatch.setattr(module, "written", lambda df, real=module.written: plans.append(plan_of(df)) or real(df))
    plans.append(plan_of(QUERIES[name](spark, "/root/testdata/sf0.001")))
    assert max(plan.count("Exchange ") for plan in plans) <= EXCHANGES[name]


def test_long_pages_give_the_bands_that_ordinary_ones_do(spark):
    from scorelake.adapters import view
    from scorelake.operators import bands as bd
    from scorelake.plans.lineage import written

    bands = bd.classify_bands(view(spark, "/root/testdata/sf0.001", "bands")).where("page_id < 160")
    bands, page = written(bands), ["page_id"]

    def results(hot):
        anchors = written(bd.melody_anchors(bands, hot=hot))
        modes = written(bd.layout_mode_vote(bands, anchors, hot=hot))
        gaps = written(bd.adaptive_gap(bands, hot=hot))
        own = written(bd.own_bands(bands, anchors, modes, gaps, keep=[c for c in bands.columns if c not in ("page_id", "band_idx")], hot=hot))
        plain = bd.own_bands(bands, anchors, modes, gaps, hot=hot)
        assert sets(plain, "page_id", "band_idx", "owner") == sets(own, "page_id", "band_idx", "owner")
        roles = bd.label_bands(own, modes, hot=hot)
        return [sets(df, *sorted(df.columns)) for df in (anchors, modes, gaps, roles)]

    some = skew.measure(bands, page, 30)
    assert 0 < some.n < bands.select(*page).distinct().count()
    assert results(skew.Hot(("page_id",), 2048)) == results(some)


def test_pages_are_rebuilt_where_no_table_is_small_enough_to_broadcast(spark):
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    rebuilt = lambda: sets(QUERIES["rebuild_pages"](spark, "/root/testdata/sf0.001"), "page_id", "part", "path")
    want = rebuilt()
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert rebuilt() == want  # a union of two tables once met a join in twice as many partitions
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_items_meet_their_edits_in_one_join(spark):
    from scorelake.operators import pages as pg

    items = spark.createDataFrame(
        [(p, i, f"L{i % 3 + 1}", [f"i{i}", None, ""][i % 3 if i > 5 else 0], ["a", "b", None, ""][i % 4], 0.0, 0.0, 9.0 + i, 9.0) for p in (1, 2, 3) for i in range(12)],
        "page_id int, item_idx int, layer string, id string, label string, x1 double, y1 double, x2 double, y2 double",
    )
    edits = spark.createDataFrame(
        [(p, k, [f"i{k % 7}", "", None, "no"][k % 4], ["L1", "L2", "", None][k % 4 if k > 3 else 0], ["a", "b", "a"][k % 3], 5.0 + k, 1.0, 1.0, 50.0 + k) for p in (1, 2, 4) for k in range(12)],
        "page_id int, edit_idx int, id string, layer string, label string, x1 double, y1 double, x2 double, y2 double",
    )
    sizes = spark.createDataFrame([(p, 100, 100) for p in (1, 2, 3, 4)], "page_id int, width int, height int")
    some = skew.Hot(("page_id",), 1, spark.createDataFrame([(1,), (3,)], "page_id int"), 2)
    plain = pg.apply_edits(items, edits, sizes)
    assert sum("Join" in line for line in plan_of(plain).split("\n")) == 2  # edits with the sizes, items with the edits
    columns = [*items.columns, "edited"]
    got = [sorted(map(str, df.select(*columns).collect())) for df in (plain, pg.apply_edits(items, edits, sizes, hot=some))]
    assert got[0] == got[1] and len(got[0]) == 36 and any("edited=True" in r for r in got[0])


def test_tables_stacked_are_dealt_out_by_no_key(spark):
    from scorelake.plans.lineage import stacked

    count = lambda n: spark.range(n).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    both = stacked(count(100), count(50))
    total = both.where("k is not null").groupBy("k").agg(F.sum("n").alias("n"))
    assert plan_of(total).count("Exchange ") == 3
    assert sum(n for _, n in sets(total, "k", "n")) == 150 and both.count() == 14


def test_items_of_pages_are_counted_once_for_their_scores(spark, monkeypatch):
    from scorelake.operators import textlines as tl

    seen, real = [], tl.measure
    monkeypatch.setattr(tl, "measure", lambda df, keys, limit: seen.append(limit) or real(df, keys, limit))
    items = spark.createDataFrame(
        [(1, 0, "Key: G 4/4", 0.0, 0.0, 70.0, 9.0), (1, 1, "1 2 3 4|5 6", 0.0, 40.0, 70.0, 60.0), (2, 0, "12", 0.0, 0.0, 9.0, 9.0)],
        "page_id int, item_idx int, text string, x1 double, y1 double, x2 double, y2 double",
    )
    notes = tl.scores_from_items(items)["notes"]
    assert seen.count(skew.FOLD_ROWS) == 1 and notes.where("page_id = 1").count() == 6
