"""Queries of the label family and of layout samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.adapters import view
from scorelake.catalog.base import big, query, r6
from scorelake.catalog.splits import measures_sql
from scorelake.operators import labels as lb
from scorelake.operators import placement as pl
from scorelake.operators import problems as pr
from scorelake.operators import splits as s

LEN = 64


@query(
    "train_val_counts",
    """SELECT part, n FROM (SELECT 'val' AS part, greatest(1, CAST(floor(count(*) * 0.25) AS BIGINT)) AS n FROM documents
UNION ALL SELECT 'train', count(*) - greatest(1, CAST(floor(count(*) * 0.25) AS BIGINT)) FROM documents) q""",
)
def q_k1(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("sample_id"))
    return lb.train_val_split(docs, seed=7).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


# centres of the lines of a row in label positions (multiples of 1/16 keep both sides equal)
CENTERS = f"SELECT page_id, system_idx, CAST(floor(x * {LEN - 1} / 1000 * 16) AS DOUBLE) / 16 AS center FROM {{x}}"
HEAT = f"""c AS (SELECT DISTINCT * FROM ({CENTERS.replace('{x}', '{v:gt_xs}')}) q WHERE center > 0 AND center < {LEN - 1}),
k AS (SELECT DISTINCT page_id, system_idx FROM {{v:gt_xs}}),
heat AS (SELECT k.page_id, k.system_idx, CAST(p AS INT) AS pos, coalesce(max(exp(-0.5 * power((p - center) / 1.5, 2))), 0) AS value
  FROM k CROSS JOIN range({LEN}) r(p) LEFT JOIN c ON c.page_id = k.page_id AND c.system_idx = k.system_idx GROUP BY 1, 2, 3)"""


def _heat(spark, sf):
    xs = view(spark, sf, "gt_xs")
    return lb.build_heat(spark.sql(CENTERS, x=xs), ["page_id", "system_idx"], LEN, 1.5, all_keys=xs, clip=True)


@query("build_heat", f"WITH {HEAT} SELECT page_id, system_idx, pos, round(value, 6) AS value FROM heat")
def q_k4(spark, sf):
    return _heat(spark, sf).select("page_id", "system_idx", "pos", *r6("value"))


def peaks_sql(gap: int, prom: float) -> str:
    return f"""pk0 AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM rh WINDOW w AS (PARTITION BY page_id, system_idx ORDER BY pos)),
pk AS (SELECT page_id, system_idx, pos, value FROM pk0 WHERE value >= {prom} AND value >= a AND value >= b),
pq AS (SELECT *, row_number() OVER (PARTITION BY page_id, system_idx ORDER BY value DESC, pos DESC) AS k FROM pk),
nw AS (SELECT page_id, system_idx, k, pos, value, true AS taken, [pos] AS kept FROM pq WHERE k = 1
  UNION ALL SELECT q.page_id, q.system_idx, q.k, q.pos, q.value, len(list_filter(w.kept, lambda z: abs(z - q.pos) < {gap})) = 0,
    CASE WHEN len(list_filter(w.kept, lambda z: abs(z - q.pos) < {gap})) = 0 THEN list_append(w.kept, q.pos) ELSE w.kept END
  FROM nw w JOIN pq q ON q.page_id = w.page_id AND q.system_idx = w.system_idx AND q.k = w.k + 1)"""


RH = "rh AS (SELECT page_id, system_idx, pos, round(value, 6) AS value FROM heat)"


def _rounded(spark, sf):
    return _heat(spark, sf).withColumn("value", F.round("value", 6))


@query("local_peaks", f"WITH RECURSIVE {HEAT}, {RH}, {peaks_sql(3, 0.28)} SELECT page_id, system_idx, pos, value FROM pk")
def q_f13(spark, sf):
    return lb.local_peaks(_rounded(spark, sf), ["page_id", "system_idx"], min_prominence=0.28).select("page_id", "system_idx", "pos", "value")


@query("nms_1d", f"WITH RECURSIVE {HEAT}, {RH}, {peaks_sql(5, 0.28)} SELECT page_id, system_idx, pos, value FROM nw WHERE taken")
def q_g5(spark, sf):
    keys = ["page_id", "system_idx"]
    return lb.nms_1d(lb.local_peaks(_rounded(spark, sf), keys, min_prominence=0.28), keys, 5).select(*keys, "pos", "value")


@query(
    "decode_splits",
    f"""WITH RECURSIVE {HEAT}, {RH}, {peaks_sql(3, 0.28)}, d AS (SELECT w.page_id, w.system_idx, w.pos, s.x1 + w.pos / {LEN - 1} * (s.x2 - s.x1) AS x, s.x1, s.x2 FROM nw w
  JOIN {{v:systems}} s ON s.page_id = w.page_id AND s.system_idx = w.system_idx WHERE taken)
SELECT page_id, system_idx, pos, round(x, 6) AS x FROM d WHERE x > x1 + 1 AND x < x2 - 1""",
)
def q_k6x(spark, sf):
    out = lb.decode_splits(_rounded(spark, sf), view(spark, sf, "systems"), ["page_id", "system_idx"], LEN)
    return out.select("page_id", "system_idx", "pos", *r6("x"))


YH = "SELECT page_id, 0 AS system_idx, CAST(((y1 + y2) / 2) % 64 AS DOUBLE) AS center FROM {i} WHERE layer IN ('L2', 'L3') AND page_id % 32 <> 0"
YHEAT = f"""c AS (SELECT DISTINCT * FROM ({YH.replace('{i}', '{v:items}')}) q), k AS (SELECT DISTINCT page_id, 0 AS system_idx FROM {{v:items}}),
heat AS (SELECT k.page_id, k.system_idx, CAST(p AS INT) AS pos, coalesce(max(exp(-0.5 * power((p - center) / 2.0, 2))), 0) AS value
  FROM k CROSS JOIN range({LEN}) r(p) LEFT JOIN c ON c.page_id = k.page_id GROUP BY 1, 2, 3)"""


@query(
    "decode_systems",
    f"""WITH RECURSIVE {YHEAT}, {RH}, {peaks_sql(3, 0.22)}, kp AS (SELECT page_id, pos FROM nw WHERE taken),
gp AS (SELECT page_id, median(d) AS g FROM (SELECT page_id, lead(pos) OVER (PARTITION BY page_id ORDER BY pos) - pos AS d FROM kp) q GROUP BY 1),
hf AS (SELECT kp.page_id, pos / 63 * 1200.0 AS cy, least(greatest(coalesce(g / 63 * 1200.0 * 0.35, 1200 * 0.09 * 0.5), 36), 144) AS half FROM kp JOIN gp ON gp.page_id = kp.page_id),
bx AS (SELECT page_id, greatest(0, cy - half) AS y1, least(1200, cy + half) AS y2 FROM hf
  UNION ALL SELECT page_id, 600.0 - 1200 * 0.09 * 0.5, 600.0 + 1200 * 0.09 * 0.5 FROM (SELECT DISTINCT page_id FROM {{v:items}}) q WHERE page_id NOT IN (SELECT page_id FROM kp)),
bq AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y1, y2) AS k FROM bx),
mw AS (SELECT page_id, k, 0 AS line, y1, y2 FROM bq WHERE k = 1
  UNION ALL SELECT q.page_id, q.k, CASE WHEN q.y1 < w.y2 - 0.3 * (w.y2 - w.y1) THEN w.line ELSE w.line + 1 END,
    CASE WHEN q.y1 < w.y2 - 0.3 * (w.y2 - w.y1) THEN least(w.y1, q.y1) ELSE q.y1 END, CASE WHEN q.y1 < w.y2 - 0.3 * (w.y2 - w.y1) THEN greatest(w.y2, q.y2) ELSE q.y2 END
  FROM mw w JOIN bq q ON q.page_id = w.page_id AND q.k = w.k + 1)
SELECT page_id, CAST(line AS INT) AS system_idx, round(arg_max(y1, k), 4) AS y1, round(arg_max(y2, k), 4) AS y2 FROM mw GROUP BY 1, 2""",
)
def q_k6y(spark, sf):
    items = view(spark, sf, "items")
    heat = lb.build_heat(spark.sql(YH, i=items).drop("system_idx"), ["page_id"], LEN, 2.0, all_keys=items).withColumn("value", F.round("value", 6))
    pages = items.select("page_id", F.lit(1000).alias("width"), F.lit(1200).alias("height")).distinct()
    out = lb.decode_systems(heat, pages, LEN)
    return out.select("page_id", "system_idx", F.round("y1", 4).alias("y1"), F.round("y2", 4).alias("y2"))


MO = "SELECT page_id, item_idx, x1, x2, y1 / 2 AS y1, y1 / 2 + 20 + CAST(item_idx % 60 AS DOUBLE) AS y2 FROM {i} WHERE layer IN ('L2', 'L3', 'L4')"


@query(
    "merge_overlaps",
    f"""WITH RECURSIVE b AS ({MO.replace('{i}', '{v:items}')}), q AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y1, y2, x1, x2) AS k FROM b),
w AS (SELECT page_id, k, 0 AS line, x1, y1, x2, y2 FROM q WHERE k = 1
  UNION ALL SELECT q.page_id, q.k, CASE WHEN q.y1 < w.y2 - 0.3 * (w.y2 - w.y1) THEN w.line ELSE w.line + 1 END,
    CASE WHEN q.y1 < w.y2 - 0.3 * (w.y2 - w.y1) THEN w.x1 ELSE q.x1 END, CASE WHEN q.y1 < w.y2 - 0.3 * (w.y2 - w.y1) THEN least(w.y1, q.y1) ELSE q.y1 END,
    CASE WHEN q.y1 < w.y2 - 0.3 * (w.y2 - w.y1) THEN w.x2 ELSE q.x2 END, CASE WHEN q.y1 < w.y2 - 0.3 * (w.y2 - w.y1) THEN greatest(w.y2, q.y2) ELSE q.y2 END
  FROM w JOIN q ON q.page_id = w.page_id AND q.k = w.k + 1)
SELECT page_id, CAST(line AS INT) AS system_idx, arg_max(x1, k) AS x1, arg_max(y1, k) AS y1, arg_max(x2, k) AS x2, arg_max(y2, k) AS y2 FROM w GROUP BY 1, 2""",
)
def q_f11(spark, sf):
    return lb.merge_overlaps(spark.sql(MO, i=view(spark, sf, "items")))


@query(
    "clip_neighbours",
    """WITH b AS (SELECT page_id, system_idx, y1 - 30 AS y1, y2 + 30 AS y2, y1 - CAST(page_id % 40 AS DOUBLE) AS c1, y2 + CAST(page_id % 30 AS DOUBLE) AS c2 FROM {v:systems}),
n AS (SELECT *, lag(y2) OVER w AS py2, lag(c2) OVER w AS pc2, lead(y1) OVER w AS ny1, lead(c1) OVER w AS nc1 FROM b WINDOW w AS (PARTITION BY page_id ORDER BY system_idx))
SELECT page_id, system_idx, CASE WHEN py2 > y1 THEN CASE WHEN c1 >= pc2 THEN least(greatest((py2 + y1) / 2, pc2), c1) ELSE (py2 + y1) / 2 END ELSE y1 END AS y1,
  CASE WHEN y2 > ny1 THEN CASE WHEN nc1 >= c2 THEN least(greatest((y2 + ny1) / 2, c2), nc1) ELSE (y2 + ny1) / 2 END ELSE y2 END AS y2 FROM n""",
)
def q_clip(spark, sf):
    b = view(spark, sf, "systems").withColumns(
        {
            "c_y1": F.col("y1") - (F.col("page_id") % 40), "c_y2": F.col("y2") + (F.col("page_id") % 30),
            "y1": F.col("y1") - 30, "y2": F.col("y2") + 30,
        }
    )
    return lb.clip_neighbours(b).select("page_id", "system_idx", "y1", "y2")


@query(
    "uniform_measures",
    """WITH s AS (SELECT *, 1 + page_id % 5 AS n FROM {v:systems})
SELECT page_id, system_idx, CAST(i AS INT) AS measure_idx, round(x1 + i * (x2 - x1) / n, 6) AS x1, round(x1 + (i + 1) * (x2 - x1) / n, 6) AS x2 FROM s, unnest(range(0, n)) AS u(i)""",
)
def q_f14(spark, sf):
    out = lb.uniform_measures(view(spark, sf, "systems").withColumn("n_measures", 1 + F.col("page_id") % 5))
    return out.select("page_id", "system_idx", "measure_idx", *r6("x1", "x2"))


@query(
    "split_wide_boxes",
    """WITH b AS (SELECT page_id, item_idx, x1, x1 + (x2 - x1) * 2 AS x2, y1, y2 - CAST(item_idx % 20 AS DOUBLE) AS y2 FROM {v:items} WHERE layer <> 'L2'),
m AS (SELECT page_id, coalesce(median(y2 - y1) FILTER (y2 - y1 >= 8), 20) AS m FROM b GROUP BY 1),
w AS (SELECT b.*, greatest(22.0, 1.15 * m) AS mw FROM b JOIN m ON m.page_id = b.page_id),
n AS (SELECT *, CASE WHEN x2 - x1 <= mw * 1.25 THEN 1 ELSE greatest(2, CAST(ceil((x2 - x1) / mw) AS INT)) END AS n FROM w)
SELECT page_id, item_idx, CAST(i AS INT) AS slot, round(x1 + i * (x2 - x1) / n, 5) AS x1, round(CASE WHEN i = n - 1 THEN x2 ELSE x1 + (i + 1) * (x2 - x1) / n END, 5) AS x2 FROM n, unnest(range(0, n)) AS u(i)""",
)
def q_wide(spark, sf):
    b = view(spark, sf, "items").where("layer <> 'L2'").withColumns(
        {"x2": F.col("x1") + (F.col("x2") - F.col("x1")) * 2, "y2": F.col("y2") - F.col("item_idx") % 20}
    )
    out = lb.split_wide_boxes(b, keys=["page_id"])
    return out.select("page_id", "item_idx", "slot", F.round("x1", 5).alias("x1"), F.round("x2", 5).alias("x2"))


@query(
    "choose_splits",
    "WITH RECURSIVE "
    + measures_sql("{v:gt_xs}", "60")
    + """,
ms AS (SELECT * FROM measures WHERE (page_id + system_idx) % 4 <> 0),
prs AS (SELECT page_id, system_idx, x2, lead(x1) OVER (PARTITION BY page_id, system_idx ORDER BY (x1 + x2) / 2, measure_idx) AS b FROM ms),
"""
    + "bxq AS (SELECT page_id, system_idx, 0.5 * (x2 + b) AS x, row_number() OVER (PARTITION BY page_id, system_idx ORDER BY 0.5 * (x2 + b)) AS k FROM prs WHERE b IS NOT NULL),\n"
    + "bxs AS (SELECT page_id, system_idx, x FROM bxq),\n"
    + """lq AS (SELECT *, row_number() OVER (PARTITION BY page_id, system_idx ORDER BY x, split_idx) AS k FROM {v:pred_xs}),
lwk AS (SELECT page_id, system_idx, k, 0 AS line, x FROM lq WHERE k = 1
  UNION ALL SELECT q.page_id, q.system_idx, q.k, CASE WHEN q.x - w.x >= 4 THEN w.line + 1 ELSE w.line END, CASE WHEN q.x - w.x >= 4 THEN q.x ELSE 0.5 * (w.x + q.x) END
  FROM lwk w JOIN lq q ON q.page_id = w.page_id AND q.system_idx = w.system_idx AND q.k = w.k + 1),
ll AS (SELECT page_id, system_idx, line, arg_max(x, k) AS x FROM lwk GROUP BY 1, 2, 3),
nm AS (SELECT s.page_id, s.system_idx, s.x1 AS lft, s.x2 AS rgt, (SELECT count(*) FROM ms WHERE ms.page_id = s.page_id AND ms.system_idx = s.system_idx) AS m FROM {v:systems} s),
inf AS (SELECT l.*, n.m, n.lft, n.rgt, count(*) OVER p AS c, min(l.x) OVER p AS lo, max(l.x) OVER p AS hi FROM ll l JOIN nm n ON n.page_id = l.page_id AND n.system_idx = l.system_idx
  WINDOW p AS (PARTITION BY l.page_id, l.system_idx)),
br AS (SELECT page_id, system_idx, x FROM inf WHERE CASE WHEN m >= 1 AND c = m + 1 THEN x <> lo AND x <> hi ELSE x > lft + 2 AND x < rgt - 2
  AND NOT (m >= 2 AND c = m AND abs(lo - lft) <= abs(hi - rgt) AND abs(lo - lft) < 40 AND x = lo)
  AND NOT (m >= 2 AND c = m AND NOT (abs(lo - lft) <= abs(hi - rgt) AND abs(lo - lft) < 40) AND abs(hi - rgt) < 40 AND x = hi) END),
ch AS (SELECT n.page_id, n.system_idx, CASE WHEN m = 0 THEN CASE WHEN nb > 0 THEN 'barlines' ELSE 'measures' END WHEN nb = m - 1 THEN 'barlines'
  WHEN nx > 0 AND nx = m - 1 THEN 'measures' WHEN nx > 0 THEN 'measures_fallback' ELSE 'barlines_unmatched' END AS src FROM (
  SELECT nm.*, (SELECT count(*) FROM br WHERE br.page_id = nm.page_id AND br.system_idx = nm.system_idx) AS nb,
    (SELECT count(*) FROM bxs WHERE bxs.page_id = nm.page_id AND bxs.system_idx = nm.system_idx) AS nx FROM nm) n)
SELECT br.page_id, br.system_idx, round(x, 6) AS x, src AS split_source FROM br JOIN ch ON ch.page_id = br.page_id AND ch.system_idx = br.system_idx WHERE src LIKE 'barlines%'
UNION ALL SELECT b.page_id, b.system_idx, round(x, 6), src FROM bxs b JOIN ch ON ch.page_id = b.page_id AND ch.system_idx = b.system_idx WHERE src LIKE 'measures%'""",
)
def q_choose(spark, sf):
    systems = view(spark, sf, "systems")
    boxes = s.derive_measures(systems, view(spark, sf, "gt_xs"), min_width=60.0).where("(page_id + system_idx) % 4 <> 0")
    out = s.choose_splits(view(spark, sf, "pred_xs"), boxes, systems)
    return out.select("page_id", "system_idx", *r6("x"), "split_source")


# Rows name their system by id, by index, by neither, or wrongly
ROWS = """SELECT page_id AS sample_id, system_idx AS row_idx, CASE WHEN page_id % 3 = 0 THEN concat('sys', CAST(system_idx AS VARCHAR(4))) WHEN page_id % 3 = 1 THEN 'x' END AS system_id,
  CASE WHEN page_id % 5 = 0 THEN 99 ELSE CAST((system_idx + 1) % 4 AS INT) END AS system_index FROM {s}"""
SYS = """SELECT page_id AS sample_id, system_idx AS position, concat('sys', CAST(system_idx AS VARCHAR(4))) AS system_id, system_idx AS system_index, x1, y1,
  CASE WHEN page_id % 11 = 0 THEN x1 - 5 ELSE x2 END AS x2, y2 FROM {s} WHERE (page_id + system_idx) % 7 <> 0"""
RESOLVE = f"""r AS ({ROWS.replace('{s}', '{v:systems}')}), y AS ({SYS.replace('{s}', '{v:systems}')}),
rs AS (SELECT r.sample_id, r.row_idx, coalesce(a.position, b.position, c.position) AS position, CASE WHEN a.position IS NOT NULL THEN 'id' WHEN b.position IS NOT NULL THEN 'index'
  WHEN c.position IS NOT NULL THEN 'position' ELSE 'none' END AS match FROM r LEFT JOIN y a ON a.sample_id = r.sample_id AND a.system_id = r.system_id
  LEFT JOIN y b ON b.sample_id = r.sample_id AND b.system_index = r.system_index LEFT JOIN y c ON c.sample_id = r.sample_id AND c.position = r.row_idx)"""


def _rows(spark, sf):
    v = view(spark, sf, "systems")
    systems = spark.sql(SYS, s=v)
    return systems, pl.resolve_parent(spark.sql(ROWS, s=v), systems)


@query("resolve_parent", f"WITH {RESOLVE} SELECT * FROM rs")
def q_d13(spark, sf):
    return _rows(spark, sf)[1].select("sample_id", "row_idx", "position", "match")


C1_SQL = f"""WITH {RESOLVE}, p AS (SELECT DISTINCT page_id AS sample_id, CASE WHEN page_id % 13 = 0 THEN NULL ELSE '0.1' END AS version, CASE WHEN page_id % 17 = 0 THEN 0 ELSE 1000 END AS width FROM {{v:systems}}),
sp AS (SELECT t.page_id AS sample_id, t.system_idx AS row_idx, t.split_idx, t.x, rs.match, y.x1 AS l, y.x2 AS r, lag(t.x) OVER (PARTITION BY t.page_id, t.system_idx ORDER BY t.split_idx) AS px
  FROM {{v:gt_xs}} t JOIN rs ON rs.sample_id = t.page_id AND rs.row_idx = t.system_idx JOIN y ON y.sample_id = rs.sample_id AND y.position = rs.position),
lg AS (SELECT *, lag(y1) OVER (PARTITION BY sample_id ORDER BY position) AS py FROM y WHERE x2 >= x1)
SELECT sample_id, 'sample' AS path, 'error' AS level, 'version_missing' AS rule FROM p WHERE version IS NULL
UNION ALL SELECT sample_id, 'sample', 'error', 'width' FROM p WHERE width = 0
UNION ALL SELECT sample_id, 'sample', 'error', 'score_region_missing' FROM p WHERE sample_id % 19 = 0
UNION ALL SELECT sample_id, 'sample', 'error', 'systems_empty' FROM p WHERE sample_id NOT IN (SELECT sample_id FROM y)
UNION ALL SELECT sample_id, concat('systems[', position, ']'), 'error', 'x_order' FROM y WHERE x2 < x1
UNION ALL SELECT sample_id, concat('systems[', position, ']'), 'warning', 'not_sorted_by_y' FROM lg WHERE y1 + 1e-3 < py
UNION ALL SELECT sample_id, concat('rows[', row_idx, ']'), 'error', 'no_parent_system' FROM rs WHERE match = 'none' AND sample_id IN (SELECT sample_id FROM y)
UNION ALL SELECT sample_id, concat('rows[', row_idx, ']'), 'warning', 'parent_by_position' FROM rs WHERE match = 'position'
UNION ALL SELECT sample_id, concat('rows[', row_idx, '].splits[', split_idx, ']'), 'error', 'not_interior' FROM sp WHERE x <= l + 1e-6 OR x >= r - 1e-6
UNION ALL SELECT sample_id, concat('rows[', row_idx, '].splits[', split_idx, ']'), 'error', 'gap' FROM sp WHERE x - px < 1
UNION ALL SELECT sample_id, concat('rows[', row_idx, '].splits[', split_idx, ']'), 'error', 'not_sorted' FROM sp WHERE x < px - 1e-9"""


@query("validate_layouts", C1_SQL)
def q_c1(spark, sf):
    systems, rows = _rows(spark, sf)
    v = view(spark, sf, "systems")
    samples = v.select(
        F.col("page_id").alias("sample_id"), F.when(F.col("page_id") % 13 != 0, "0.1").alias("version"),
        F.when(F.col("page_id") % 17 == 0, 0).otherwise(1000).alias("width"), F.lit(1200).alias("height"),
    ).distinct()
    regions = samples.where("sample_id % 19 <> 0").select(
        "sample_id", F.lit(0).alias("region_idx"), F.lit("score").alias("role"),
        *[F.lit(x).alias(n) for n, x in (("x1", 0.0), ("y1", 0.0), ("x2", 1000.0), ("y2", 1200.0))],
    )
    splits = view(spark, sf, "gt_xs").withColumnsRenamed({"page_id": "sample_id", "system_idx": "row_idx"})
    none = splits.where("false").select(
        "sample_id", "row_idx", F.lit(0).alias("measure_idx"), *[F.lit(0.0).alias(n) for n in ("x1", "y1", "x2", "y2")]
    )
    return pr.validate_layouts(samples, regions, systems, rows, splits, none).select("sample_id", "path", "level", "rule")


CROP = f"""WITH {RESOLVE}, f AS (SELECT rs.*, y.x1, y.y1, y.x2, y.y2 FROM rs JOIN y ON y.sample_id = rs.sample_id AND y.position = rs.position WHERE match IN ('id', 'index')),
c AS (SELECT *, greatest(0, CAST(trunc(x1 - 0.02 * (x2 - x1)) AS INT)) AS a, greatest(0, CAST(trunc(y1 - 0.05 * (y2 - y1)) AS INT)) AS b,
  least(1000, CAST(trunc(x2 + 0.02 * (x2 - x1)) AS INT)) AS c, least(1200, CAST(trunc(y2 + 0.05 * (y2 - y1)) AS INT)) AS d FROM f)
SELECT sample_id, row_idx, a AS crop_x1, b AS crop_y1, c AS crop_x2, d AS crop_y2, round(x2 * (512 / 1000), 6) AS x2 FROM c WHERE c > a AND d > b"""


@query("crop_rows", CROP)
def q_k5(spark, sf):
    v = view(spark, sf, "systems")
    systems, rows = spark.sql(SYS, s=v), spark.sql(ROWS, s=v)
    samples = v.select(F.col("page_id").alias("sample_id"), F.lit(1000).alias("width"), F.lit(1200).alias("height")).distinct()
    out = lb.crop_rows(rows, systems, samples)
    return out.select("sample_id", "row_idx", "crop_x1", "crop_y1", "crop_x2", "crop_y2", *r6("x2"))
