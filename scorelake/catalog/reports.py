"""Queries of the report and sweep families."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scorelake.adapters import view
from scorelake.catalog.base import big, greedy_sql, iou_sql, prf_sql, query, r6
from scorelake.catalog.matching import COUNTS, IOU, LCS, PAIRS, edges_sql
from scorelake.catalog.splits import fold_sql
from scorelake.operators import matching as m
from scorelake.operators import reports as rp
from scorelake.operators import tuning as tu
from scorelake.plans.lineage import checkpoint_folder
from scorelake.sources import sinks

METRICS = PAIRS + ",\n" + COUNTS + f",\nscored AS (SELECT *, {prf_sql()} FROM metrics)"


def _metrics(spark, sf):
    gt, pred = view(spark, sf, "gt_boxes"), view(spark, sf, "pred_boxes")
    return m.box_metrics(gt, pred, iou=IOU)


@query(
    "batch_report",
    METRICS + """ SELECT layer, round(avg(f1), 5) AS mean_f1, count(*) AS n_layer, CAST(sum(tp) AS BIGINT) AS tp,
       CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
       (SELECT count(DISTINCT sample_id) FROM scored) AS n_samples FROM scored GROUP BY layer""",
)
def q_batch_report(spark, sf):
    out = rp.batch_report(_metrics(spark, sf))
    return out.select("layer", F.round("mean_f1", 5).alias("mean_f1"), *big("n_layer", "tp", "fp", "fn", "n_samples"))


@query(
    "report_matrix",
    METRICS + " SELECT sample_id, max(CASE WHEN layer = 'L1' THEN f1 END) AS L1, max(CASE WHEN layer = 'L2' THEN f1 END) AS L2 FROM scored GROUP BY sample_id",
)
def q_report_matrix(spark, sf):
    return rp.report_matrix(_metrics(spark, sf), ["L1", "L2"]).select("sample_id", *r6("L1", "L2"))


# samples = users, every event is a box; some samples lack the truth of some layers
E4_BOXES = """SELECT user_id AS sample_id, concat('L', CAST(event_id % 4 + 1 AS VARCHAR(4))) AS layer, event_id AS box_idx,
  CASE WHEN event_type = 'click' THEN '' WHEN event_type = 'view' THEN 'pitch' ELSE 'lyric' END AS kind,
  CAST((event_id * 53) % 300 + {dx} AS DOUBLE) AS x1, CAST((event_id % 5) * 20 AS DOUBLE) AS y1,
  CAST((event_id * 53) % 300 + {dx} + 30 + event_id % 40 AS DOUBLE) AS x2, CAST((event_id % 5) * 20 + 30 AS DOUBLE) AS y2 FROM {events}"""
E4_G = E4_BOXES.replace("{dx}", "0")
E4_P = E4_BOXES.replace("{dx}", "event_id % 11 - 5") + " WHERE event_id % 6 <> 0"
E4_GT = "SELECT * FROM ({q}) q WHERE NOT ((layer = 'L1' AND sample_id % 3 = 0) OR (layer = 'L2' AND sample_id % 4 = 0) OR (layer = 'L3' AND sample_id % 5 = 0) OR (layer = 'L4' AND sample_id % 2 = 0))"
E4_XS = "SELECT page_id AS sample_id, x FROM {x}"
E4_GX = E4_XS + " WHERE page_id % 7 <> 0"
E4_SAMPLES = """SELECT DISTINCT user_id AS sample_id, CAST(user_id % 9 AS BIGINT) AS gt_measures,
  CASE WHEN user_id % 8 = 0 THEN NULL ELSE CAST(user_id % 6 AS BIGINT) END AS gt_systems,
  CASE WHEN user_id % 10 = 0 THEN NULL ELSE CAST(user_id % 11 AS BIGINT) END AS pred_measures,
  CASE WHEN user_id % 12 = 0 THEN NULL ELSE CAST(user_id % 5 AS BIGINT) END AS pred_systems FROM {events}"""
E4_GTOK = "SELECT * FROM {t} WHERE sample_id % 11 <> 0"
E4_PTOK = "SELECT * FROM {t} WHERE sample_id % 22 <> 0"


def _e4(spark, sf):
    v = lambda n: view(spark, sf, n)
    events = spark.read.parquet(f"{sf}/events.parquet")
    gtb = spark.sql(E4_GT.replace("({q})", "{q}"), q=spark.sql(E4_G, events=events))
    samples = spark.sql(E4_SAMPLES, events=events)
    return rp.compare_samples(
        samples, gtb, spark.sql(E4_P, events=events),
        spark.sql(E4_GX, x=v("gt_xs")), spark.sql(E4_XS, x=v("pred_xs")),
        spark.sql(E4_GTOK, t=v("gt_tokens")), spark.sql(E4_PTOK, t=v("pred_tokens")), iou=0.3,
    )


E4_SQL = f"""WITH RECURSIVE samples AS ({E4_SAMPLES.replace('{events}', 'events')}),
gb0 AS ({E4_GT.replace('{q}', E4_G.replace('{events}', 'events'))}),
pb0 AS ({E4_P.replace('{events}', 'events')}),
gb AS (SELECT * FROM gb0 WHERE sample_id IN (SELECT sample_id FROM samples)
  UNION ALL SELECT sample_id, 'L4_pitch', box_idx, kind, x1, y1, x2, y2 FROM gb0 WHERE layer = 'L4' AND kind IN ('', 'pitch') AND sample_id IN (SELECT sample_id FROM samples)),
pb AS (SELECT * FROM pb0 WHERE sample_id IN (SELECT sample_id FROM samples)
  UNION ALL SELECT sample_id, 'L4_pitch', box_idx, kind, x1, y1, x2, y2 FROM pb0 WHERE layer = 'L4' AND kind IN ('', 'pitch') AND sample_id IN (SELECT sample_id FROM samples)),
gk AS (SELECT DISTINCT sample_id, layer FROM gb),
edges AS (SELECT * FROM (SELECT g.sample_id, g.layer, g.box_idx AS gi, p.box_idx AS pi, {iou_sql()} AS w
  FROM gb g JOIN pb p ON g.sample_id = p.sample_id AND g.layer = p.layer AND g.x1 < p.x2 AND p.x1 < g.x2
  WHERE g.layer <> 'L1' OR g.kind = '' OR p.kind = '' OR g.kind = p.kind) e WHERE w >= 0.3),
{greedy_sql(['sample_id', 'layer'], '-w, gi, pi')},
bc AS (SELECT k.sample_id, k.layer, (SELECT count(*) FROM gb WHERE gb.sample_id = k.sample_id AND gb.layer = k.layer) AS n_gt,
  (SELECT count(*) FROM pb WHERE pb.sample_id = k.sample_id AND pb.layer = k.layer) AS n_pred FROM gk k),
bh AS (SELECT sample_id, layer, count(*) AS tp FROM walk WHERE taken GROUP BY 1, 2),
gx AS ({E4_GX.replace('{x}', '{v:gt_xs}')}), px AS ({E4_XS.replace('{x}', '{v:pred_xs}')}),
gl AS (SELECT sample_id, list(x ORDER BY x) AS gs FROM gx GROUP BY 1),
pl AS (SELECT sample_id, list(x ORDER BY x) AS ps FROM px GROUP BY 1),
xw AS (SELECT gl.sample_id, gs, coalesce(ps, []) AS ps, len(coalesce(ps, [])) AS np, 0 AS k, 0 AS tp FROM gl LEFT JOIN pl ON gl.sample_id = pl.sample_id
  UNION ALL SELECT sample_id, gs, CASE WHEN best IS NULL THEN ps ELSE ps[:best.i - 1] || ps[best.i + 1:] END, np, k + 1, CASE WHEN best IS NULL THEN tp ELSE tp + 1 END
  FROM (SELECT w.*, list_min(list_filter(list_transform(range(1, len(ps) + 1), lambda i: {{'d': abs(ps[i] - gs[k + 1]), 'i': i}}), lambda c: c.d <= 12)) AS best
        FROM xw w WHERE k < len(gs)) s),
gt AS ({E4_GTOK.replace('{t}', '{v:gt_tokens}')}), pt AS ({E4_PTOK.replace('{t}', '{v:pred_tokens}')}),
ga AS (SELECT sample_id, list(token ORDER BY pos) AS ta FROM gt GROUP BY 1), pa AS (SELECT sample_id, list(token ORDER BY pos) AS tb FROM pt GROUP BY 1),
tk AS (SELECT coalesce(ga.sample_id, pa.sample_id) AS sample_id, coalesce(ta, []) AS ta, coalesce(tb, []) AS tb FROM ga FULL JOIN pa ON ga.sample_id = pa.sample_id),
lw AS (SELECT sample_id, ta, tb, 0 AS k, list_transform(range(0, len(tb) + 1), lambda i: 0) AS dp FROM tk
  UNION ALL SELECT sample_id, ta, tb, k + 1, list_reduce(list_transform(range(1, len(tb) + 1), lambda j: [CASE WHEN tb[j] = ta[k + 1] THEN dp[j] + 1 ELSE dp[j + 1] END]),
     lambda acc, c: list_append(acc, greatest(c[1], acc[len(acc)])), [0]) FROM lw WHERE k < len(ta)),
f AS (SELECT s.*, (SELECT count(*) FROM gb WHERE gb.sample_id = s.sample_id AND layer = 'L1') AS g1, (SELECT count(*) FROM pb WHERE pb.sample_id = s.sample_id AND layer = 'L1') AS p1,
  (SELECT count(*) FROM gb WHERE gb.sample_id = s.sample_id AND layer = 'L2') AS g2, (SELECT count(*) FROM pb WHERE pb.sample_id = s.sample_id AND layer = 'L2') AS p2,
  (SELECT count(*) FROM gb WHERE gb.sample_id = s.sample_id AND layer = 'L3') AS g3, (SELECT count(*) FROM pb WHERE pb.sample_id = s.sample_id AND layer = 'L3') AS p3,
  (SELECT count(*) FROM gb WHERE gb.sample_id = s.sample_id AND layer = 'L4') AS g4, (SELECT count(*) FROM pb WHERE pb.sample_id = s.sample_id AND layer = 'L4_pitch') AS p4,
  (SELECT count(*) FROM gx WHERE gx.sample_id = s.sample_id) AS gxn, (SELECT count(*) FROM px WHERE px.sample_id = s.sample_id) AS pxn,
  (SELECT count(*) FROM gt WHERE gt.sample_id = s.sample_id) AS gtn, (SELECT count(*) FROM pt WHERE pt.sample_id = s.sample_id) AS ptn FROM samples s),
cnt AS (SELECT sample_id, 'L1' AS layer, 1 AS n_gt, least(1, p1) AS n_pred FROM f WHERE g1 = 0
  UNION ALL SELECT sample_id, 'L2', coalesce(gt_systems, p2), CASE WHEN gt_systems IS NULL THEN p2 ELSE coalesce(pred_systems, p2) END FROM f WHERE g2 = 0
  UNION ALL SELECT sample_id, 'L3', gt_measures, coalesce(pred_measures, p3) FROM f WHERE g3 = 0
  UNION ALL SELECT sample_id, 'L3_barlines', 0, pxn FROM f WHERE gxn = 0 AND pxn > 0
  UNION ALL SELECT sample_id, 'L4', gtn, p4 FROM f WHERE g4 = 0 AND gtn > 0),
al AS (SELECT c.sample_id, c.layer, 'iou' AS mode, n_gt, n_pred, coalesce(tp, 0) AS tp FROM bc c LEFT JOIN bh h ON c.sample_id = h.sample_id AND c.layer = h.layer
  UNION ALL SELECT sample_id, layer, 'count', n_gt, n_pred, least(n_gt, n_pred) FROM cnt
  UNION ALL SELECT sample_id, 'L3_barlines', 'x_distance', len(gs), np, tp FROM xw WHERE k = len(gs)
  UNION ALL SELECT sample_id, 'L5', 'sequence', len(ta), len(tb), dp[len(dp)] FROM lw WHERE k = len(ta)),
am AS (SELECT sample_id, layer, mode, CAST(n_gt AS BIGINT) AS n_gt, CAST(n_pred AS BIGINT) AS n_pred, CAST(tp AS BIGINT) AS tp,
  CAST(n_pred - tp AS BIGINT) AS fp, CAST(n_gt - tp AS BIGINT) AS fn FROM al)
SELECT *, {prf_sql()} FROM am
UNION ALL SELECT sample_id, 'L4', 'unavailable', 0, 0, 0, 0, 0, 0.0, 0.0, 0.0 FROM f WHERE g4 = 0 AND gtn = 0
UNION ALL SELECT sample_id, 'L5', 'unavailable', 0, 0, 0, 0, 0, 0.0, 0.0, 0.0 FROM f WHERE gtn = 0 AND ptn = 0"""


BASIS = """CASE WHEN mode = 'iou' THEN 'boxes' WHEN mode = 'x_distance' THEN 'positions' WHEN mode = 'sequence' THEN 'tokens' WHEN mode = 'unavailable' THEN 'none'
  WHEN layer = 'L1' THEN 'presence' WHEN layer = 'L3_barlines' THEN 'prediction' WHEN layer = 'L4' THEN 'tokens'
  WHEN layer = 'L2' AND s.gt_systems IS NULL THEN 'self' WHEN layer = 'L3' AND coalesce(s.gt_measures, 0) = 0 THEN 'zero_truth' ELSE 'stated' END"""
E4_HEAD, E4_TAIL = E4_SQL.split("\nSELECT *, ")
E4_BASIS = f"""{E4_HEAD},
m AS (SELECT *, {E4_TAIL}),
b AS (SELECT m.*, {BASIS} AS basis FROM m JOIN samples s ON s.sample_id = m.sample_id)"""


@query(
    "comparison_warnings",
    f"""{E4_BASIS}
SELECT sample_id, list(layer || ': ' || CASE basis {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in rp.WARNINGS.items())} END ORDER BY layer) AS warnings
FROM b WHERE basis IN ('presence', 'self', 'zero_truth', 'none') GROUP BY sample_id""",
)
def q_comparison_warnings(spark, sf):
    return rp.comparison_warnings(_e4(spark, sf))


@query("compare_samples", E4_BASIS + " SELECT sample_id, layer, mode, basis, n_gt, n_pred, tp, fp, fn, precision, recall, f1 FROM b")
def q_compare_samples(spark, sf):
    return _e4(spark, sf).select(
        "sample_id", "layer", "mode", "basis", "n_gt", "n_pred", "tp", "fp", "fn", *r6("precision", "recall", "f1")
    )


ACC = f"""WITH s AS (SELECT *, pred_n - lcs AS fp, gt_n - lcs AS fn FROM {{v:accuracy_rows}}),
t AS (SELECT *, CASE WHEN lcs + fp > 0 THEN lcs / (lcs + fp) WHEN fn = 0 THEN 1.0 ELSE 0.0 END AS p,
             CASE WHEN lcs + fn > 0 THEN lcs / (lcs + fn) WHEN fp = 0 THEN 1.0 ELSE 0.0 END AS r FROM s),
u AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM t),
a AS (SELECT CASE WHEN grouping(subset) = 1 THEN 'ALL' ELSE subset END AS subset, count(*) AS n,
  count(*) FILTER (error IS NULL) AS ok,
  avg(f) FILTER (error IS NULL) AS f1_avg, avg(r) FILTER (error IS NULL) AS recall_avg, avg(p) FILTER (error IS NULL) AS precision_avg,
  sum(lcs) FILTER (error IS NULL) / greatest(1, sum(gt_n) FILTER (error IS NULL)) AS rw,
  sum(lcs) FILTER (error IS NULL) / greatest(1, sum(pred_n) FILTER (error IS NULL)) AS pw,
  avg(CAST(key_ok AS INT)) FILTER (error IS NULL) AS key_accuracy, avg(CAST(time_ok AS INT)) FILTER (error IS NULL) AS time_accuracy,
  avg(bars_err) FILTER (error IS NULL) AS mean_abs_bar_error
  FROM u GROUP BY GROUPING SETS ((), (subset))),
summary AS (SELECT *, CASE WHEN rw + pw > 0 THEN 2 * rw * pw / (rw + pw) ELSE 0.0 END AS f1w FROM a)
"""
ACC_COLS = ("f1_avg", "recall_avg", "precision_avg", "f1_weighted", "recall_weighted", "key_accuracy", "time_accuracy", "mean_abs_bar_error")


@query(
    "accuracy_summary",
    ACC + """SELECT subset, n, ok, round(f1_avg, 6) AS f1_avg, round(recall_avg, 6) AS recall_avg, round(precision_avg, 6) AS precision_avg,
  round(f1w, 6) AS f1_weighted, round(rw, 6) AS recall_weighted, round(key_accuracy, 6) AS key_accuracy,
  round(time_accuracy, 6) AS time_accuracy, round(mean_abs_bar_error, 6) AS mean_abs_bar_error FROM summary""",
)
def q_accuracy(spark, sf):
    return rp.accuracy_summary(view(spark, sf, "accuracy_rows")).select("subset", "n", "ok", *r6(*ACC_COLS))


@query(
    "accuracy_gate",
    ACC + """SELECT 'en' AS subset, CAST(0.2 AS DOUBLE) AS min_f1, round((SELECT f1w FROM summary WHERE subset = 'en'), 6) AS actual_f1,
  (SELECT n - ok FROM summary WHERE subset = 'ALL') AS errors,
  (SELECT f1w FROM summary WHERE subset = 'en') + 1e-9 >= 0.2 AND (SELECT n - ok FROM summary WHERE subset = 'ALL') = 0 AS passed""",
)
def q_gate(spark, sf):
    out = rp.gate(rp.accuracy_summary(view(spark, sf, "accuracy_rows")), "en", 0.2)
    return out.select("subset", "min_f1", *r6("actual_f1"), *big("errors"), "passed")


# engine = trial layer name; errors from the trials themselves, every seventh unknown
ENGINES = """SELECT trial AS sample_id, layer AS engine, trial % 5 AS count_error,
  CASE WHEN trial % 5 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS exact,
  CASE WHEN trial % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(trial % 23 AS DOUBLE) END AS mean_abs_dist FROM {t}"""


@query(
    "engine_ab",
    f"WITH e AS ({ENGINES.replace('{t}', '{v:trials}')}) "
    "SELECT engine, round(avg(count_error), 6) AS mean_count_error, round(avg(exact), 6) AS mean_exact, "
    "round(avg(mean_abs_dist) FILTER (NOT isnan(mean_abs_dist)), 6) AS mean_abs_x_error, count(*) AS n FROM e GROUP BY engine",
)
def q_engine_ab(spark, sf):
    out = rp.engine_ab(spark.sql(ENGINES, t=view(spark, sf, "trials")))
    return out.select("engine", *r6("mean_count_error", "mean_exact", "mean_abs_x_error"), "n")


DIFF = """SELECT layer, avg(f) AS mean_f1 FROM (SELECT concat('L', CAST(trial % 7 AS VARCHAR(4))) AS layer, {f} AS f FROM {t} WHERE trial % 7 <> {skip}) q GROUP BY layer"""


@query(
    "diff_baselines",
    f"""WITH c AS ({DIFF.replace('{t}', '{v:trials}').replace('{f}', 'CAST(trial % 11 AS DOUBLE)').replace('{skip}', '3')}),
b AS ({DIFF.replace('{t}', '{v:trials}').replace('{f}', 'CAST(trial % 9 AS DOUBLE)').replace('{skip}', '5')}),
d AS (SELECT coalesce(c.layer, b.layer) AS layer, coalesce(c.mean_f1, 0) - coalesce(b.mean_f1, 0) AS delta FROM c FULL JOIN b ON c.layer = b.layer)
SELECT layer, round(delta, 6) AS delta, CASE WHEN delta > 1e-6 THEN 'improved' WHEN delta < -1e-6 THEN 'regressed' ELSE 'unchanged' END AS status FROM d""",
)
def q_diff(spark, sf):
    t = view(spark, sf, "trials")
    one = lambda f, skip: spark.sql(DIFF.replace("{f}", f).replace("{skip}", skip), t=t)
    out = rp.diff_baselines(one("CAST(trial % 11 AS DOUBLE)", "3"), one("CAST(trial % 9 AS DOUBLE)", "5"))
    return out.select("layer", *r6("delta"), "status")


@query(
    "best_trial",
    "SELECT layer, arg_min(trial, (loss, trial)) AS trial, min(loss) AS loss, "
    "arg_min(min_width, (loss, trial)) AS min_width FROM {v:trials} GROUP BY layer",
)
def q_best_trial(spark, sf):
    return tu.best_trial(view(spark, sf, "trials")).select("layer", "trial", "loss", "min_width")


CURVE = """SELECT o_orderstatus AS run, CAST(o_custkey % 50 AS INT) AS epoch,
  CASE WHEN o_orderkey % 6 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(o_custkey % 31 AS DOUBLE) END AS train_loss,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(o_orderkey % 29 AS DOUBLE) END AS val_loss FROM {orders}"""


@query(
    "training_curve",
    f"""WITH h AS ({CURVE.replace('{orders}', 'orders')}),
e AS (SELECT run, epoch, avg(train_loss) FILTER (NOT isnan(train_loss)) AS tl, avg(val_loss) FILTER (NOT isnan(val_loss)) AS vl FROM h GROUP BY 1, 2),
b AS (SELECT run, arg_min(epoch, (vl, epoch)) AS best FROM e WHERE vl IS NOT NULL GROUP BY run)
SELECT e.run, epoch, round(tl, 6) AS train_loss, round(vl, 6) AS val_loss, epoch = best AS is_best FROM e JOIN b ON e.run = b.run""",
)
def q_curve(spark, sf):
    out = rp.training_curve(spark.sql(CURVE, orders=spark.read.parquet(f"{sf}/orders.parquet")))
    return out.select("run", "epoch", *r6("train_loss", "val_loss"), "is_best")


@query(
    "layer_loss",
    METRICS + """, t AS (SELECT *, 1.0 * (1.0 - CASE WHEN tp > 0 THEN mean_iou ELSE 0 END) + 0.5 * least(1.0, abs(n_pred - n_gt) / greatest(n_gt, 1))
  + 0.35 * (fn / greatest(n_gt, 1)) + 0.25 * CASE WHEN n_pred > 0 THEN fp / n_pred WHEN n_gt = 0 THEN 0.0 ELSE 1.0 END AS loss FROM scored)
SELECT sample_id, layer, round(loss, 6) AS loss, round(greatest(0.0, 1.0 - loss), 6) AS score FROM t""",
)
def q_layer_loss(spark, sf):
    return tu.layer_loss(_metrics(spark, sf)).select("sample_id", "layer", *r6("loss", "score"))


# Lines of a page = predicted positions, truth = measures between true positions
SWEEP = [(0, 8.0, 24.0), (1, 16.0, 16.0), (2, 32.0, 40.0), (3, 4.0, 8.0)]


def _sweep(spark, sf):
    systems, lines = view(spark, sf, "systems"), view(spark, sf, "pred_xs")
    from scorelake.operators.splits import derive_measures

    truth = derive_measures(systems, view(spark, sf, "gt_xs"), min_width=24.0).select(
        "page_id", (F.col("system_idx").cast("bigint") * (1 << 31) + F.col("measure_idx")).alias("box_idx"),
        "x1", "y1", "x2", "y2",
    )
    grid = spark.createDataFrame(SWEEP, "trial long, min_gap double, min_width double")
    return tu.param_sweep(lines, systems, truth, grid)


def _segments_sql(name: str, src: str, width: str) -> str:
    return f"""{name}_e AS (SELECT DISTINCT q.trial, s.page_id, s.system_idx, s.x1, s.y1, s.x2, s.y2, q.w, q.x FROM {{v:systems}} s JOIN ({src}) q
  ON q.page_id = s.page_id AND q.system_idx = s.system_idx WHERE q.x IN (s.x1, s.x2) OR (q.x > s.x1 + 1e-6 AND q.x < s.x2 - 1e-6)),
{name}_n AS (SELECT *, lead(x) OVER p AS r, count(*) OVER (PARTITION BY trial, page_id, system_idx) AS n FROM {name}_e WINDOW p AS (PARTITION BY trial, page_id, system_idx ORDER BY x)),
{name}_k AS (SELECT *, row_number() OVER (PARTITION BY trial, page_id, system_idx ORDER BY x) - 1 AS mi FROM {name}_n WHERE n > 2 AND r IS NOT NULL AND r - x >= w),
{name} AS (SELECT trial, page_id, CAST(system_idx AS BIGINT) * 1000000 + mi AS box_idx, x AS x1, y1, r AS x2, y2 FROM {name}_k
  UNION ALL SELECT g.trial, s.page_id, CAST(s.system_idx AS BIGINT) * 1000000, s.x1, s.y1, s.x2, s.y2 FROM {{v:systems}} s CROSS JOIN grid g
  WHERE NOT EXISTS (SELECT 1 FROM {name}_k k WHERE k.trial = g.trial AND k.page_id = s.page_id AND k.system_idx = s.system_idx))"""


_ENDS = " UNION ALL SELECT trial, page_id, system_idx, {w} AS w, x1 FROM {v:systems} CROSS JOIN grid UNION ALL SELECT trial, page_id, system_idx, {w}, x2 FROM {v:systems} CROSS JOIN grid"
SWEEP_SQL = (
    "WITH RECURSIVE grid AS (SELECT * FROM (VALUES "
    + ", ".join(f"(CAST({t} AS BIGINT), CAST({g} AS DOUBLE), CAST({w} AS DOUBLE))" for t, g, w in SWEEP)
    + ") v(trial, min_gap, min_width)),\n"
    + fold_sql(
        "SELECT g.trial, g.min_gap, t.page_id, t.system_idx, t.split_idx, t.x, 'detect' AS source, CAST(0.7 AS DOUBLE) AS confidence "
        "FROM {v:pred_xs} t CROSS JOIN grid g WHERE t.x > 1e-6 AND t.x < 1000 - 1e-6",
        "r.min_gap", "trial, page_id, system_idx",
    ).replace("SELECT trial, page_id, system_idx, k, n, 0 AS line", "SELECT trial, page_id, system_idx, k, n, 0 AS line")
    + ",\n" + _segments_sql("pb", "SELECT l.trial, l.page_id, l.system_idx, g.min_width AS w, l.x FROM lines l JOIN grid g ON g.trial = l.trial"
                            + _ENDS.replace("{w}", "min_width"), "w")
    + ",\n" + _segments_sql("gb", "SELECT g.trial, t.page_id, t.system_idx, 24 AS w, t.x FROM {v:gt_xs} t CROSS JOIN grid g" + _ENDS.replace("{w}", "24"), "w")
    + f""",
edges AS (SELECT * FROM (SELECT g.trial, g.page_id, g.box_idx AS gi, p.box_idx AS pi, {iou_sql()} AS w FROM gb g JOIN pb p
  ON g.trial = p.trial AND g.page_id = p.page_id AND g.x1 < p.x2 AND p.x1 < g.x2 AND g.y1 < p.y2 AND p.y1 < g.y2) e WHERE w >= 0.5),
"""
    + greedy_sql(["trial", "page_id"], "-w, gi, pi").replace("walk", "walk3").replace("ranked", "ranked3")
    + """,
n AS (SELECT trial, page_id, sum(g) AS n_gt, sum(1 - g) AS n_pred FROM (SELECT trial, page_id, 1 AS g FROM gb UNION ALL SELECT trial, page_id, 0 FROM pb) q GROUP BY 1, 2),
h AS (SELECT trial, page_id, count(*) AS tp, avg(w) AS mi FROM walk3 WHERE taken GROUP BY 1, 2),
j AS (SELECT n.*, coalesce(tp, 0) AS tp, coalesce(mi, 0) AS mi, n_pred - coalesce(tp, 0) AS fp, n_gt - coalesce(tp, 0) AS fn FROM n LEFT JOIN h ON n.trial = h.trial AND n.page_id = h.page_id),
l AS (SELECT *, (1.0 - mi) + 0.5 * least(1.0, abs(n_pred - n_gt) / greatest(n_gt, 1)) + 0.35 * fn / greatest(n_gt, 1)
  + 0.25 * CASE WHEN n_pred > 0 THEN fp / n_pred WHEN n_gt = 0 THEN 0.0 ELSE 1.0 END AS loss FROM j)
"""
)


@query(
    "param_sweep",
    SWEEP_SQL + "SELECT trial, page_id, CAST(n_gt AS BIGINT) AS n_gt, CAST(n_pred AS BIGINT) AS n_pred, CAST(tp AS BIGINT) AS tp, round(loss, 6) AS loss FROM l",
)
def q_sweep(spark, sf):
    return _sweep(spark, sf).select("trial", "page_id", *big("n_gt", "n_pred", "tp"), *r6("loss"))


@query(
    "sweep_summary",
    SWEEP_SQL + """, p AS (SELECT trial, avg(loss) AS loss, CAST(sum(tp) AS BIGINT) AS tp FROM l GROUP BY trial)
SELECT trial, round(loss, 6) AS loss, tp, trial = (SELECT arg_min(trial, (loss, trial)) FROM p) AS is_best,
  loss - (SELECT loss FROM p WHERE trial = 0) <= 1e-12 AS improved FROM p""",
)
def q_sweep_summary(spark, sf):
    return tu.sweep_summary(_sweep(spark, sf)).select("trial", *r6("loss"), *big("tp"), "is_best", "improved")


MANIFEST = """SELECT doc_id AS pos, concat('E', CAST(doc_id AS VARCHAR(20))) AS id, lang AS subset,
  CASE WHEN doc_id % 4 = 0 THEN 'pending' ELSE 'ready' END AS status FROM {documents}"""


@query(
    "manifest_stats",
    f"""WITH m AS ({MANIFEST.replace('{documents}', 'documents')})
SELECT CASE WHEN grouping(subset) = 1 THEN 'ALL' ELSE subset END AS subset, count(*) AS entries,
  count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status <> 'ready') AS pending FROM m GROUP BY GROUPING SETS ((), (subset))""",
)
def q_manifest_stats(spark, sf):
    return rp.manifest_stats(spark.sql(MANIFEST, documents=spark.read.parquet(f"{sf}/documents.parquet")))


# Layers are return flags
DEFAULTS = "SELECT l_returnflag AS layer, map('iou', min(l_discount), 'gap', max(l_quantity), 'pad', CAST(count(*) AS DOUBLE)) AS params FROM {l} GROUP BY l_returnflag"
OVERRIDES = """SELECT l_returnflag AS layer, map('gap', avg(l_linenumber), 'other', max(l_tax)) AS params FROM {l} WHERE l_returnflag < 'R' GROUP BY l_returnflag"""


@query(
    "effective_params",
    """WITH d AS (SELECT l_returnflag AS layer, min(l_discount) AS iou, max(l_quantity) AS gap, count(*) AS pad, avg(l_linenumber) AS own FROM lineitem GROUP BY l_returnflag)
SELECT layer, 'iou' AS name, round(iou, 6) AS value FROM d UNION ALL SELECT layer, 'pad', CAST(pad AS DOUBLE) FROM d
UNION ALL SELECT layer, 'gap', round(CASE WHEN layer < 'R' THEN own ELSE gap END, 6) FROM d""",
)
def q_effective_params(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    as_double = lambda df: df.select("layer", F.col("params").cast("map<string,double>").alias("params"))
    out = tu.effective_params(as_double(spark.sql(DEFAULTS, l=lines)), as_double(spark.sql(OVERRIDES, l=lines)))
    return out.select("layer", F.explode("params").alias("name", "value")).withColumn("value", F.round("value", 6))


# Two baselines, of which one is saved again from other lines; metrics by layer
BASE = "SELECT l_returnflag AS layer, round(avg(l_discount), 6) AS mean_f1 FROM {l} WHERE {w} GROUP BY l_returnflag"


@query(
    "saved_baselines",
    f"""SELECT 'main' AS name, * FROM ({BASE.format(l='lineitem', w="l_linenumber > 3")})
UNION ALL SELECT 'other', * FROM ({BASE.format(l='lineitem', w="l_linenumber < 3")})""",
)
def q_saved_baselines(spark, sf):
    """A baseline that is saved again replaces itself and leaves the other."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    path = f"{checkpoint_folder(spark)}/baselines-{uuid.uuid4().hex}"
    report = lambda w: spark.sql(BASE.replace("{w}", w), l=lines)
    for name, w in (("main", "l_linenumber = 1"), ("other", "l_linenumber < 3"), ("main", "l_linenumber > 3")):
        sinks.save_baseline(report(w), name, path)
    read = lambda name: sinks.load_baseline(spark, name, path).select(F.lit(name).alias("name"), "layer", "mean_f1")
    return read("main").unionByName(read("other"))


@query(
    "saved_best_params",
    "SELECT l_returnflag AS layer, round(CASE WHEN l_returnflag < 'R' THEN avg(l_linenumber) ELSE max(l_quantity) END, 6) AS gap, count(*) AS n FROM lineitem GROUP BY l_returnflag",
)
def q_saved_best_params(spark, sf):
    """Parameters saved for some layers leave those of the others; metrics are written by layer and counted."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    place = f"{checkpoint_folder(spark)}/params-{uuid.uuid4().hex}"
    for sql in (DEFAULTS, OVERRIDES):
        rows = spark.sql(sql, l=lines)
        sinks.save_best_params(rows.select("layer", F.col("params").cast("map<string,double>").alias("params")), f"{place}/best")
    sinks.write_metrics(lines.select(F.col("l_returnflag").alias("layer"), F.col("l_discount").alias("f1")), f"{place}/metrics")
    best = spark.read.parquet(f"{place}/best").select("layer", F.round(F.col("params")["gap"], 6).alias("gap"))
    n = spark.read.parquet(f"{place}/metrics").groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    return best.join(n, "layer")
