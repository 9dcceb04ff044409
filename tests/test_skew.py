"""Hot-key paths give the same rows as the ordinary ones, and as plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from scorelake.functions.lcs import common_length
from scorelake.operators import bands, labels, matching, rerun, scores, splits, textlines
from scorelake.operators.sequences import long_lcs
from scorelake.plans import skew, spatial
from scorelake.plans.spatial import near, touching


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def close(a, b):
    return len(a) == len(b) and all(x == pytest.approx(y) for x, y in zip(a, b))


def plain_lcs(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(line[j] + 1 if x == y else max(line[j + 1], new[j]))
        line = new
    return line[-1]


def test_lcs_bits():
    r = random.Random(1)
    for _ in range(200):
        a = [r.choice("1234") for _ in range(r.randint(0, 30))]
        b = [r.choice("1234") for _ in range(r.randint(0, 30))]
        assert common_length(a, b) == plain_lcs(a, b)


def test_long_lcs(spark):
    r = random.Random(2)
    g, p, want = [], [], {}
    for s in range(3):
        a = [r.choice("1234") for _ in range(r.randint(20, 60))]
        b = [r.choice("1234") for _ in range(r.randint(20, 60))]
        want[s] = plain_lcs(a, b)
        g += [(s, i, t) for i, t in enumerate(a)]
        p += [(s, i, t) for i, t in enumerate(b)]
    schema = "sample_id int, pos int, token string"
    out = long_lcs(spark.createDataFrame(g, schema), spark.createDataFrame(p, schema), ["sample_id"], block=16)
    assert {x.sample_id: x.lcs for x in out.collect()} == want


def test_ordered(spark):
    r = random.Random(3)
    data = [(0 if r.random() < 0.7 else r.randint(1, 40), r.randint(0, 1000), i, r.randint(0, 9)) for i in range(5000)]
    df = spark.createDataFrame(data, "k int, a int, i int, v int")
    v = F.col("v")
    what = dict(number="n", sums={"s": v}, maxima={"m": v}, lags={"g": v}, leads={"d": v})
    cold = skew.ordered(df, ["k"], ["a", "i"], **what, hot=skew.Hot(("k",), 1))
    hot = skew.measure(df, ["k"], 200)
    assert hot.table is not None
    assert rows(cold) == rows(skew.ordered(df, ["k"], ["a", "i"], **what, hot=hot).select(cold.columns))


def some_boxes(spark, r, n, pages=4):
    data = []
    for s in range(pages):
        for i in range(n):
            x, y = r.randint(0, 120), r.randint(0, 60)
            data.append((s, "L1", i, "k", float(x), float(y), float(x + r.randint(10, 50)), float(y + 20)))
    schema = "sample_id int, layer string, box_idx int, kind string, x1 double, y1 double, x2 double, y2 double"
    return spark.createDataFrame(data, schema)


def test_match_boxes(spark):
    r = random.Random(4)
    gt, pred = some_boxes(spark, r, 30), some_boxes(spark, r, 30)
    hot = skew.measure(gt, ["sample_id", "layer"], 10)
    a = rows(matching.match_boxes(gt, pred, iou=0.2))
    assert len(a) > 20 and a == rows(matching.match_boxes(gt, pred, iou=0.2, hot=hot))
    b = rows(matching.mean_best_iou(gt, pred, ["sample_id"]))
    hot = skew.measure(gt, ["sample_id"], 10)
    assert close(b, rows(matching.mean_best_iou(gt, pred, ["sample_id"], hot=hot)))


def plain_xs(gt, pred, limit):
    pred, used, n = sorted(pred), set(), 0
    for x in sorted(gt):
        free = [(abs(p - x), i) for i, p in enumerate(pred) if i not in used and abs(p - x) <= limit]
        if free:
            used.add(min(free)[1])
            n += 1
    return n


def test_match_xs(spark):
    r = random.Random(5)
    g = [(s, float(r.randint(0, 200))) for s in range(5) for _ in range(40)]
    p = [(s, float(r.randint(0, 200))) for s in range(5) for _ in range(40)]
    gt, pred = (spark.createDataFrame(d, "sample_id int, x double") for d in (g, p))
    a = matching.match_xs(gt, pred, max_dist=4)
    want = {s: plain_xs([x for k, x in g if k == s], [x for k, x in p if k == s], 4) for s in range(5)}
    assert {x.sample_id: x.tp for x in a.collect()} == want
    hot = skew.measure(gt.unionByName(pred), ["sample_id"], 10)
    assert close(rows(a, "sample_id", "tp", "mean_abs_dist"), rows(matching.match_xs(gt, pred, max_dist=4, hot=hot), "sample_id", "tp", "mean_abs_dist"))


def plain_thin(xs, gap):
    out = []
    for x in sorted(xs):
        if out and x - out[-1] < gap:
            out[-1] = 0.5 * (out[-1] + x)
        else:
            out.append(x)
    return out


def test_thin_lines(spark):
    r = random.Random(6)
    data = [(s, i, float(r.randint(0, 400))) for s in range(4) for i in range(60)]
    df = splits.as_lines(spark.createDataFrame(data, "page_id int, split_idx int, x double"))
    a = rows(splits.thin_lines(df, ["page_id"], 6.0), "page_id", "split_idx", "x")
    want = [(s, i, x) for s in range(4) for i, x in enumerate(plain_thin([d[2] for d in data if d[0] == s], 6.0))]
    assert close(a, sorted(want))
    hot = skew.measure(df, ["page_id"], 10)
    assert close(a, rows(splits.thin_lines(df, ["page_id"], 6.0, hot=hot), "page_id", "split_idx", "x"))


def plain_pack(beats, cap):
    bar, acc, out = 1, 0.0, []
    for b in beats:
        if acc > 0 and acc + b > cap + 1e-6:
            bar, acc = bar + 1, 0.0
        out.append(bar)
        acc += b
        if acc >= cap - 1e-6:
            bar, acc = bar + 1, 0.0
    return out


def test_pack_by_meter(spark):
    from scorelake.functions.rhythm import BEATS

    r = random.Random(7)
    names = list(BEATS)
    data = [(s, i // 7, i, r.choice(names), r.randint(0, 2), 3.0 if s % 2 else 4.0) for s in range(3) for i in range(400)]
    df = spark.createDataFrame(data, "score_id int, measure_no int, note_idx int, duration string, dots int, capacity double")
    a = rows(scores.pack_by_meter(df), "score_id", "note_idx", "bar_no")
    factor = {0: 1.0, 1: 1.5, 2: 1.75}
    want = []
    for s in range(3):
        beats = [BEATS[d[3]] * factor[d[4]] for d in data if d[0] == s]
        want += [(s, i, b) for i, b in enumerate(plain_pack(beats, 3.0 if s % 2 else 4.0))]
    assert a == sorted(want)
    hot = skew.measure(df.where("score_id > 0"), ["score_id"], 100)
    assert a == rows(scores.pack_by_meter(df, hot=hot), "score_id", "note_idx", "bar_no")


def test_peaks_rows_and_merges(spark):
    r = random.Random(8)
    heat = spark.createDataFrame([(s, i, r.randint(0, 20) / 20) for s in range(3) for i in range(120)], "page_id int, pos int, value double")
    hot = skew.measure(heat, ["page_id"], 10)
    peaks = labels.local_peaks(heat, ["page_id"])
    assert rows(labels.nms_1d(peaks, ["page_id"], 3)) == rows(labels.nms_1d(peaks, ["page_id"], 3, hot=hot))
    data = [(s, i, "1 2", float(r.randint(0, 50)), float(y := r.randint(0, 900)), 60.0, float(y + r.randint(10, 40))) for s in range(3) for i in range(80)]
    items = spark.createDataFrame(data, "page_id int, item_idx int, text string, x1 double, y1 double, x2 double, y2 double")
    assert rows(textlines.cluster_rows(items)) == rows(textlines.cluster_rows(items, hot=hot))
    assert rows(labels.merge_overlaps(items.drop("item_idx", "text"))) == rows(labels.merge_overlaps(items.drop("item_idx", "text"), hot=hot))
    flat = items.select("page_id", F.col("y1").alias("x1"), F.lit(0.0).alias("y1"), (F.col("y1") + 4 + F.col("x1") / 9).alias("x2"), F.lit(20.0).alias("y2"))
    assert rows(bands.merge_fragments(flat)) == rows(bands.merge_fragments(flat, hot=hot))
    cand = items.select("page_id", F.col("item_idx").alias("band_idx"), F.col("y1").cast("int").alias("y0"), F.col("x1").alias("score"), F.lit(9.0).alias("min_sep"))
    assert rows(bands.space_anchors(cand)) == rows(bands.space_anchors(cand, hot=hot))


def test_in_order_choice(spark):
    r = random.Random(9)
    point = lambda n: [(s, i, float(r.randint(0, 300)), float(r.randint(0, 300))) for s in range(2) for i in range(n)]
    for n_mine, n_theirs in ((25, 18), (15, 22)):
        mine, theirs = (spark.createDataFrame(point(n), "page_id int, item_idx int, px double, py double") for n in (n_mine, n_theirs))
        a = rows(rerun._in_order(mine, theirs), "page_id", "item_idx", "draft_idx")
        assert a == rows(rerun._propose(mine, theirs, 32.0), "page_id", "item_idx", "draft_idx")
        assert len(a) == 2 * min(n_mine, n_theirs)


def test_tiles(spark):
    r = random.Random(10)
    box = lambda i: (0, i, float(x := r.randint(-200, 900)), float(y := r.randint(-200, 900)), float(x + r.randint(0, 200)), float(y + r.randint(0, 90)))
    left, right = [box(i) for i in range(60)], [box(i) for i in range(60)]
    schema = "page_id int, i int, x1 double, y1 double, x2 double, y2 double"
    L, R = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = rows(touching(L, R, ["page_id"], tile=50.0, pad=5.0), "l.i", "r.i")
    meets = lambda a, b: a[2] - 5 <= b[4] and b[2] <= a[4] + 5 and a[3] - 5 <= b[5] and b[3] <= a[5] + 5
    assert got == sorted((a[1], b[1]) for a in left for b in right if meets(a, b))
    pts = L.select("page_id", "i", F.col("x1").alias("px"), F.col("y1").alias("py"))
    dx = F.greatest(F.lit(0.0), F.col("r.x1") - F.col("l.px"), F.col("l.px") - F.col("r.x2"))
    dy = F.greatest(F.lit(0.0), F.col("r.y1") - F.col("l.py"), F.col("l.py") - F.col("r.y2"))
    best = near(pts, R, ["page_id"], tile=16.0).groupBy(F.col("l.i").alias("i")).agg(F.min(dx + dy).alias("d"))
    edge = lambda a, b: max(0, b[2] - a[2], a[2] - b[4]) + max(0, b[3] - a[3], a[3] - b[5])
    assert rows(best) == sorted((a[1], float(min(edge(a, b) for b in right))) for a in left)


@pytest.mark.parametrize("first", ["constant", "text"])
def test_segments_cut_the_whole_order_key(spark, first):
    """A hot key whose first order column is constant or a text still falls into many even segments."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(100).alias("k"),
        (F.lit(1) if first == "constant" else F.concat(F.lit("t"), (F.col("id") % 3).cast("string"))).alias("a"), F.col("id").alias("i"),
    )
    hot = skew.measure(df, ["k"], 5_000)
    assert hot.n == 1
    sizes = [r["count"] for r in skew.segments(df, hot, ["a", "i"]).where("k = 100").groupBy("_seg").count().collect()]
    assert len(sizes) > 100 and max(sizes) < 54_000 / 50
    plain = skew.Hot(("k",), 10**9)
    how = dict(number="n", sums={"s": F.col("i")}, lags={"p": F.col("i")})
    assert rows(skew.ordered(df, ["k"], ["a", "i"], hot=hot, **how)) == rows(skew.ordered(df, ["k"], ["a", "i"], hot=plain, **how))


def test_wide_boxes_meet_by_key(spark):
    """A page-wide box and one of 10**7 pixels give the same pairs as a plain comparison, and no tiles without end."""
    r = random.Random(12)
    make = lambda n: [(k, i, x, y, x + r.choice([5.0, 40.0, 3000.0]), y + r.choice([5.0, 200.0])) for k in (1, 2) for i in range(n)
                      for x, y in [(r.uniform(0, 4000), r.uniform(0, 3000))]]
    left, right = make(30) + [(1, 99, 0.0, 0.0, 1e7, 1e7)], make(30) + [(2, 98, -1e7, 0.0, 1e7, 50.0), (1, 97, 0.0, 0.0, 1e7, 1e7)]
    schema = "k int, i int, x1 double, y1 double, x2 double, y2 double"
    got = touching(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], tile=16.0, pad=2.0)
    want = sorted((a[0], a[1], b[1]) for a in left for b in right
                  if a[0] == b[0] and a[2] - 2 <= b[4] and b[2] <= a[4] + 2 and a[3] - 2 <= b[5] and b[3] <= a[5] + 2)
    assert sorted((x.k, x.l.i, x.r.i) for x in got.collect()) == want


def test_infinite_boxes_are_left_out(spark):
    df = spark.createDataFrame([("p", "L2", 0, 0.0, 0.0, float("inf"), 9.0), ("p", "L2", 1, 0.0, 0.0, 9.0, 9.0)],
                               "sample_id string, layer string, box_idx int, x1 double, y1 double, x2 double, y2 double").withColumn("kind", F.lit(""))
    assert [(x.gt_idx, x.pred_idx) for x in matching.match_boxes(df, df).collect()] == [(1, 1)]


def test_rows_without_measures_part_their_neighbours(spark):
    row = lambda s: ("p", s, 0, False, "open_trailing", "whole_line", None, None, 0.0, 0.7)
    schema = ("page_id string, system_idx int, measure_idx int, closed boolean, segment string, measure_source string, "
              "barline_x_left double, barline_x_right double, system_x1 double, confidence double")
    got = rerun.merge_open_measures(spark.createDataFrame([row(0), row(2), row(3)], schema)).collect()
    assert sorted((x.system_idx, x.cross_line) for x in got) == [(0, False), (2, True)]


def test_no_default_drops_rows(spark):
    from scorelake.operators import problems

    schema = "score_id string, measure_no int, source string, status string, beats double, capacity double"
    measures = spark.createDataFrame([("s", 1, "layout", "ok", 4.0, 4.0)], schema)
    notes = spark.createDataFrame([("s", 1, 0, "1", False, 0.9, None, "ocr", None)], "score_id string, measure_no int, note_idx int, "
                                  "pitch string, is_rest boolean, confidence double, ocr_score double, pitch_from string, note_source string")
    regions = spark.createDataFrame([("s", i, "title", f"{i} " + "x" * 100) for i in range(40)], "score_id string, item_idx int, kind string, text string")
    warnings = spark.createDataFrame([("s", i, "fine" if i < 20 else "L2 failed " + "y" * 300) for i in range(40)], "score_id string, warn_idx int, text string")
    scores_ = spark.createDataFrame([("s",)], "score_id string")
    got = problems.collect_problems(scores_, measures, notes, regions, warnings).collect()
    assert sum(r.kind == "layout_pollution" for r in got) == 40 and sum(r.kind == "other" for r in got) == 20
    assert max(len(r.message) for r in got) > 300
    capped = problems.collect_problems(scores_, measures, notes, regions, warnings, max_polluted=12, max_warnings=8).collect()
    assert len(capped) == 12


def plain_pairs(edges):
    truths, guesses, out = set(), set(), []
    for w, g, p in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        if g not in truths and p not in guesses:
            truths.add(g)
            guesses.add(p)
            out.append((g, p))
    return sorted(out)


BOX = "sample_id string, layer string, box_idx int, kind string, x1 double, y1 double, x2 double, y2 double"


def count_jobs(spark, run):
    sc = spark.sparkContext
    sc.setJobGroup("counted", "counted")
    out = run()
    n = len(sc.statusTracker().getJobIdsForGroup("counted"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    return out, n


@pytest.mark.parametrize("shape", ["pile", "chain"])
def test_crowds_of_boxes_in_a_fixed_number_of_jobs(spark, shape):
    """Thousands of equal boxes, or boxes that each overlap the next, take no job more than others."""
    def make(n, shift):
        step = 0.0 if shape == "pile" else 7.0
        return spark.range(n).select(
            F.lit("p").alias("sample_id"), F.lit("L3").alias("layer"), F.col("id").cast("int").alias("box_idx"), F.lit("").alias("kind"),
            (F.col("id") * step + shift).alias("x1"), F.lit(0.0).alias("y1"), (F.col("id") * step + shift + 10).alias("x2"), F.lit(10.0).alias("y2"),
        )

    n = 1500 if shape == "pile" else 10_000
    many, jobs = count_jobs(spark, lambda: matching.match_boxes(make(n, 0.0), make(n, 2.0), iou=0.2).collect())
    assert len(many) == n and all(r.gt_idx == r.pred_idx for r in many)
    assert jobs <= 12  # the count of the keys, and the exchanges of one query


def test_crowded_keys_are_dealt_out_by_component(spark, monkeypatch):
    from scorelake.plans import greedy

    r = random.Random(31)
    make = lambda: [("p", "L3", i, "", x, y, x + r.choice([4.0, 9.0]), y + 6.0) for i in range(50) for x, y in [(float(r.randint(0, 60)), float(r.randint(0, 30)))]]
    gt, pred = make(), make()
    L, R = spark.createDataFrame(gt, BOX), spark.createDataFrame(pred, BOX)

    def iou(a, b):
        w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
        both = max(w, 0) * max(h, 0)
        return both / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - both)

    want = plain_pairs([(iou(a, b), a[2], b[2]) for a in gt for b in pred if iou(a, b) >= 0.1])
    for limit in (greedy.WALK_BOXES, 60):
        monkeypatch.setattr(greedy, "WALK_BOXES", limit)
        assert rows(matching.match_boxes(L, R, iou=0.1), "gt_idx", "pred_idx") == want


def test_components(spark):
    from scorelake.plans.components import components

    links = [(i, i + 1) for i in range(40)] + [(400, 401), (401, 402), (500, 500)] + [(600, i) for i in range(601, 640)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 400 for i in (400, 401, 402)}, 500: 500, **{i: 600 for i in range(600, 640)}}


def test_nearest_among_boxes_of_any_size(spark):
    """Boxes of 10**7 pixels and without end cost a few rows and are found; so are points that aren't finite."""
    r = random.Random(32)
    inf = float("inf")
    make = lambda i, size: (0, i, x := r.uniform(-9e4, 9e4), y := r.uniform(-2e3, 2e3), x + r.uniform(0, size), y + r.uniform(0, size / 9))
    right = [make(i, r.choice([0, 5, 70, 900, 20_000])) for i in range(120)] + [make(200, 1e7), (1, 201, 5e6, 0.0, inf, 9.0), (1, 202, -1e9, -1e7, 1e7, -5e6)]
    points = [(k, i, r.uniform(-2e5, 2e5), r.uniform(-9e3, 9e3)) for k in (0, 1, 2) for i in range(60)] + [(1, 99, inf, 0.0), (0, 98, 1e12, -1e12)]
    R = spark.createDataFrame(right, "k int, i int, x1 double, y1 double, x2 double, y2 double")
    L = spark.createDataFrame(points, "k int, i int, px double, py double")
    dx = F.greatest(F.lit(0.0), F.col("r.x1") - F.col("l.px"), F.col("l.px") - F.col("r.x2"))
    dy = F.greatest(F.lit(0.0), F.col("r.y1") - F.col("l.py"), F.col("l.py") - F.col("r.y2"))
    got = near(L, R, ["k"], tile=16.0).groupBy("k", F.col("l.i").alias("i")).agg(F.min(dx + dy).alias("d")).collect()
    edge = lambda a, b: max(0, b[2] - a[2], a[2] - b[4]) + max(0, b[3] - a[3], a[3] - b[5])
    want = {(a[0], a[1]): min(edge(a, b) for b in right if b[0] == a[0]) for a in points if a[0] < 2}
    assert {(x.k, x.i): x.d for x in got if x.i != 99} == pytest.approx({k: v for k, v in want.items() if k[1] != 99})
    assert {(x.k, x.i) for x in got} == set(want)
    listed = spatial._cells(R.select("k", F.struct(*R.columns).alias("r")), 16.0)
    assert max(x["count"] for x in listed.groupBy("r.i").count().collect()) <= 4 * (spatial.LEVELS + 1)


def test_heat_of_the_nearest_centre(spark):
    import math

    r = random.Random(9)
    centres = [(k, r.choice([r.uniform(-9, 60), float(r.randint(0, 49)), 25.0])) for k in range(4) for _ in range(r.randint(1, 40))]
    centres += [(7, None), (8, float("nan")), (9, 1e300), (9, -1e300), (10, 12.5)]
    df = spark.createDataFrame(centres, "k int, center double")
    got = {(x.k, x.pos): x.value for x in labels.build_heat(df, ["k"], 50, 1.5).collect()}
    real = [(k, c) for k, c in centres if c is not None and not math.isnan(c)]
    want = {(k, p): max([math.exp(-0.5 * ((p - c) / 1.5) ** 2) if abs(p - c) < 1e9 else 0.0 for j, c in real if j == k], default=0.0) for k in {k for k, _ in centres} for p in range(50)}
    assert got == pytest.approx(want)
    both = labels.build_heat(df, ["k"], 50, 1.5, all_keys=spark.createDataFrame([(1,), (99,)], "k int"), clip=True)
    assert {x.k for x in both.collect() if x.value == 0} >= {99} and both.count() == 100
