"""Queries of the matching family."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.adapters import view
from scorelake.catalog.base import big, greedy_sql, iou_sql, prf_sql, query, r6
from scorelake.operators import matching as m

IOU = 0.2


def edges_sql(iou: float = IOU, kind: str = "true", keys: str = "sample_id, layer") -> str:
    return f"""edges AS (
  SELECT {keys}, gi, pi, w FROM (
    SELECT g.sample_id, g.layer, g.box_idx AS gi, p.box_idx AS pi, {iou_sql()} AS w
    FROM {{v:gt_boxes}} g JOIN {{v:pred_boxes}} p ON g.sample_id = p.sample_id AND g.layer = p.layer
    WHERE {kind}) e WHERE w >= {iou})"""


PAIRS = f"WITH RECURSIVE {edges_sql()},\n{greedy_sql(['sample_id', 'layer'], '-w, gi, pi')}"

COUNTS = """counts AS (
  SELECT sample_id, layer, CAST(sum(g) AS BIGINT) AS n_gt, CAST(sum(1 - g) AS BIGINT) AS n_pred FROM (
    SELECT sample_id, layer, 1 AS g FROM {v:gt_boxes} UNION ALL SELECT sample_id, layer, 0 FROM {v:pred_boxes}) b
  GROUP BY 1, 2),
hits AS (SELECT sample_id, layer, count(*) AS tp, avg(w) AS mean_iou FROM walk WHERE taken GROUP BY 1, 2),
metrics AS (
  SELECT c.sample_id, c.layer, n_gt, n_pred, coalesce(tp, 0) AS tp, n_pred - coalesce(tp, 0) AS fp,
         n_gt - coalesce(tp, 0) AS fn, coalesce(mean_iou, 0.0) AS mean_iou
  FROM counts c LEFT JOIN hits h ON c.sample_id = h.sample_id AND c.layer = h.layer)"""


def _sides(spark, sf):
    return view(spark, sf, "gt_boxes"), view(spark, sf, "pred_boxes")


@query(
    "match_boxes",
    PAIRS + " SELECT sample_id, layer, gi AS gt_idx, pi AS pred_idx, round(w, 6) AS iou FROM walk WHERE taken",
)
def q_match_boxes(spark, sf):
    gt, pred = _sides(spark, sf)
    return m.match_boxes(gt, pred, iou=IOU).select("sample_id", "layer", "gt_idx", "pred_idx", *r6("iou"))


@query(
    "match_boxes_same_kind",
    f"WITH RECURSIVE {edges_sql(0.5, 'g.kind = p.kind')},\n"
    + greedy_sql(["sample_id", "layer"], "-w, gi, pi")
    + " SELECT sample_id, layer, gi AS gt_idx, pi AS pred_idx, round(w, 6) AS iou FROM walk WHERE taken",
)
def q_match_boxes_same_kind(spark, sf):
    gt, pred = _sides(spark, sf)
    return m.match_boxes(gt, pred, iou=0.5, same_kind=True).select(
        "sample_id", "layer", "gt_idx", "pred_idx", *r6("iou")
    )


@query(
    "match_errors",
    PAIRS
    + """ SELECT sample_id, layer, 'tp' AS outcome, gi AS gt_idx, pi AS pred_idx, round(w, 6) AS iou FROM walk WHERE taken
UNION ALL SELECT sample_id, layer, 'fp', NULL, box_idx, NULL FROM {v:pred_boxes} p WHERE NOT EXISTS (
  SELECT 1 FROM walk w WHERE taken AND w.sample_id = p.sample_id AND w.layer = p.layer AND w.pi = p.box_idx)
UNION ALL SELECT sample_id, layer, 'fn', box_idx, NULL, NULL FROM {v:gt_boxes} g WHERE NOT EXISTS (
  SELECT 1 FROM walk w WHERE taken AND w.sample_id = g.sample_id AND w.layer = g.layer AND w.gi = g.box_idx)""",
)
def q_match_errors(spark, sf):
    gt, pred = _sides(spark, sf)
    pairs = m.match_boxes(gt, pred, iou=IOU)
    return m.match_errors(gt, pred, pairs).select(
        "sample_id", "layer", "outcome", "gt_idx", "pred_idx", *r6("iou")
    )


@query(
    "box_metrics",
    PAIRS + ",\n" + COUNTS
    + f" SELECT sample_id, layer, n_gt, n_pred, tp, fp, fn, round(mean_iou, 6) AS mean_iou, {prf_sql()} FROM metrics",
)
def q_box_metrics(spark, sf):
    gt, pred = _sides(spark, sf)
    return m.box_metrics(gt, pred, iou=IOU).select(
        "sample_id", "layer", *big("n_gt", "n_pred", "tp", "fp", "fn"),
        *r6("mean_iou", "precision", "recall", "f1"),
    )


@query(
    "count_metrics",
    f"""WITH g AS (SELECT sample_id, count(*) AS n FROM {{v:gt_boxes}} GROUP BY 1),
p AS (SELECT sample_id, count(*) AS n FROM {{v:pred_boxes}} GROUP BY 1),
c AS (SELECT coalesce(g.sample_id, p.sample_id) AS sample_id, coalesce(g.n, 0) AS n_gt, coalesce(p.n, 0) AS n_pred
      FROM g FULL JOIN p ON g.sample_id = p.sample_id),
d AS (SELECT *, least(n_gt, n_pred) AS tp, greatest(0, n_pred - n_gt) AS fp, greatest(0, n_gt - n_pred) AS fn FROM c)
SELECT sample_id, n_gt, n_pred, tp, fp, fn, abs(n_pred - n_gt) AS abs_delta, {prf_sql()} FROM d""",
)
def q_count_metrics(spark, sf):
    gt, pred = _sides(spark, sf)
    out = m.count_metrics(m.side_counts(gt, pred, ["sample_id"]))
    return out.select(
        "sample_id", *big("n_gt", "n_pred", "tp", "fp", "fn", "abs_delta"), *r6("precision", "recall", "f1")
    )


def xs_sql(keys: str, dist: str, tail: str) -> str:
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    ks = ", ".join(f"w.{k}" for k in keys.split(", "))
    gk = ", ".join(f"coalesce(g.{k}, p.{k}) AS {k}" for k in keys.split(", "))
    return f"""WITH RECURSIVE g AS (SELECT {keys}, list(x ORDER BY x) AS gs FROM {{v:gt_xs}} GROUP BY ALL),
p AS (SELECT {keys}, list(x ORDER BY x) AS ps FROM {{v:pred_xs}} GROUP BY ALL),
sides AS (SELECT {gk}, coalesce(gs, []) AS gs, coalesce(ps, []) AS ps FROM g FULL JOIN p ON {on('g', 'p')}),
walk AS (
  SELECT {keys}, gs, ps, 0 AS k, 0 AS tp, CAST(0 AS DOUBLE) AS dist FROM sides
  UNION ALL
  SELECT {ks.replace('w.', 's.')}, gs, CASE WHEN best IS NULL THEN ps ELSE ps[:best.i - 1] || ps[best.i + 1:] END, k + 1,
         CASE WHEN best IS NULL THEN tp ELSE tp + 1 END, CASE WHEN best IS NULL THEN dist ELSE dist + best.d END
  FROM (SELECT w.*, list_min(list_filter(list_transform(range(1, len(ps) + 1),
               lambda i: {{'d': abs(ps[i] - gs[k + 1]), 'i': i}}), lambda c: c.d <= {dist})) AS best
        FROM walk w WHERE k < len(gs)) s),
done AS (SELECT {ks}, len(s.gs) AS n_gt, len(s.ps) AS n_pred, w.tp, w.dist FROM walk w JOIN sides s ON {on('w', 's')}
         WHERE w.k = len(w.gs)),
m AS (SELECT *, n_pred - tp AS fp, n_gt - tp AS fn FROM done)
SELECT {keys}, CAST(n_gt AS BIGINT) AS n_gt, CAST(n_pred AS BIGINT) AS n_pred, CAST(tp AS BIGINT) AS tp,
       CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       round(CASE WHEN tp > 0 THEN dist / tp END, 6) AS mean_abs_dist,
       CAST(abs(n_pred - n_gt) AS BIGINT) AS count_error,
       CASE WHEN n_pred = n_gt THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact, {tail} FROM m"""


def _xs_out(df, *keys):
    return df.select(
        *keys, *big("n_gt", "n_pred", "tp", "fp", "fn"), *r6("mean_abs_dist"), *big("count_error"),
        "exact", *r6("precision", "recall", "f1"),
    )


@query("match_xs", xs_sql("page_id, system_idx", "12", prf_sql()))
def q_match_xs(spark, sf):
    out = m.match_xs(view(spark, sf, "gt_xs"), view(spark, sf, "pred_xs"), ["page_id", "system_idx"])
    return _xs_out(out, "page_id", "system_idx")


@query("match_xs_page_scope", xs_sql("page_id", "20", prf_sql()))
def q_match_xs_page(spark, sf):
    # tolerance by row width: max(12, 2 % of 1000)
    out = m.match_xs(
        view(spark, sf, "gt_xs"), view(spark, sf, "pred_xs"), ["page_id"],
        max_dist=F.greatest(F.lit(12.0), 0.02 * F.lit(1000.0)),
    )
    return _xs_out(out, "page_id")


@query(
    "mean_best_iou",
    f"""WITH RECURSIVE e0 AS (
  SELECT g.sample_id, g.layer, g.box_idx AS gi, p.box_idx AS pi, {iou_sql()} AS w
  FROM {{v:gt_boxes}} g JOIN {{v:pred_boxes}} p ON g.sample_id = p.sample_id AND g.layer = p.layer),
edges AS (SELECT * FROM e0 WHERE w > 0),
{greedy_sql(['sample_id', 'layer'], 'gi, -w, pi')},
{COUNTS}
SELECT sample_id, layer, n_gt, n_pred,
       round(CASE WHEN n_gt > 0 THEN mean_iou * tp / n_gt ELSE 0.0 END, 6) AS mean_iou FROM metrics""",
)
def q_mean_best_iou(spark, sf):
    gt, pred = _sides(spark, sf)
    out = m.mean_best_iou(gt, pred, ["sample_id", "layer"])
    return out.select("sample_id", "layer", *big("n_gt", "n_pred"), *r6("mean_iou"))


LCS = """WITH RECURSIVE a AS (SELECT sample_id, list(token ORDER BY pos) AS ta FROM {v:gt_tokens} GROUP BY 1),
b AS (SELECT sample_id, list(token ORDER BY pos) AS tb FROM {v:pred_tokens} GROUP BY 1),
sides AS (SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, coalesce(ta, []) AS ta, coalesce(tb, []) AS tb
          FROM a FULL JOIN b ON a.sample_id = b.sample_id),
walk AS (
  SELECT sample_id, ta, tb, 0 AS k, list_transform(range(0, len(tb) + 1), lambda i: 0) AS dp FROM sides
  UNION ALL
  SELECT sample_id, ta, tb, k + 1,
    list_reduce(list_transform(range(1, len(tb) + 1), lambda j: [CASE WHEN tb[j] = ta[k + 1] THEN dp[j] + 1 ELSE dp[j + 1] END]),
                lambda acc, c: list_append(acc, greatest(c[1], acc[len(acc)])), [0])
  FROM walk WHERE k < len(ta)),
lcs AS (SELECT sample_id, CAST(len(ta) AS BIGINT) AS n_gt, CAST(len(tb) AS BIGINT) AS n_pred,
               CAST(dp[len(dp)] AS BIGINT) AS tp FROM walk WHERE k = len(ta)),
m AS (SELECT *, n_pred - tp AS fp, n_gt - tp AS fn FROM lcs)
"""


@query("sequence_metrics", LCS + f"SELECT sample_id, n_gt, n_pred, tp AS lcs, fp, fn, {prf_sql()} FROM m")
def q_sequence_metrics(spark, sf):
    out = m.sequence_metrics(view(spark, sf, "gt_tokens"), view(spark, sf, "pred_tokens"))
    return out.select("sample_id", *big("n_gt", "n_pred", "lcs", "fp", "fn"), *r6("precision", "recall", "f1"))
