"""Queries of the split-line family."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.adapters import view
from scorelake.catalog.base import big, query, r6
from scorelake.operators import splits as s

K = "page_id, system_idx"


def fold_sql(rows: str, gap: str, keys: str = K, average: bool = True) -> str:
    """CTEs walking ``rows`` (keys, x, split_idx, source, confidence) line by line.

    ``lines`` is the result; the state is the open line, closed lines are emitted.
    """
    ks = ", ".join(f"r.{k.strip()}" for k in keys.split(","))
    on = " AND ".join(f"r.{k.strip()} = w.{k.strip()}" for k in keys.split(","))
    x = "0.5 * (w.x + r.x)" if average else "w.x"
    src = "CASE WHEN 'user' IN (w.source, r.source) THEN 'user' ELSE w.source END" if average else "w.source"
    conf = "greatest(w.confidence, r.confidence)" if average else "w.confidence"
    return f"""sorted AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY x, split_idx) AS k,
                 count(*) OVER (PARTITION BY {keys}) AS n FROM ({rows}) q),
walk AS (
  SELECT {keys}, k, n, 0 AS line, x, source, confidence FROM sorted WHERE k = 1
  UNION ALL
  SELECT {ks}, r.k, r.n, CASE WHEN r.x - w.x >= {gap} THEN w.line + 1 ELSE w.line END,
         CASE WHEN r.x - w.x >= {gap} THEN r.x ELSE {x} END,
         CASE WHEN r.x - w.x >= {gap} THEN r.source ELSE {src} END,
         CASE WHEN r.x - w.x >= {gap} THEN r.confidence ELSE {conf} END
  FROM walk w JOIN sorted r ON {on} AND r.k = w.k + 1),
lines AS (SELECT {keys}, line AS split_idx, arg_max(x, k) AS x, arg_max(source, k) AS source,
                 arg_max(confidence, k) AS confidence FROM walk GROUP BY ALL)"""


def inside_sql(gap: str = "8") -> str:
    return (
        "SELECT t.page_id, t.system_idx, t.split_idx, t.x, t.source, t.confidence FROM {v:gt_xs} t "
        "JOIN {v:systems} s ON t.page_id = s.page_id AND t.system_idx = s.system_idx "
        f"WHERE s.x2 > s.x1 + {gap} AND t.x > s.x1 + 1e-6 AND t.x < s.x2 - 1e-6"
    )


NORMAL = "WITH RECURSIVE " + fold_sql(inside_sql(), "8")


@query(
    "normalize_splits",
    NORMAL + " SELECT page_id, system_idx, CAST(split_idx AS INT) AS split_idx, round(x, 6) AS x, source, confidence FROM lines",
)
def q_normalize(spark, sf):
    out = s.normalize_splits(view(spark, sf, "gt_xs"), view(spark, sf, "systems"))
    return out.select("page_id", "system_idx", "split_idx", *r6("x"), "source", "confidence")


MEASURES = """edges AS (
  SELECT DISTINCT s.page_id, s.system_idx, s.x1, s.y1, s.x2, s.y2, e.x FROM {v:systems} s
  JOIN (SELECT page_id, system_idx, x FROM {src} UNION ALL SELECT page_id, system_idx, x1 FROM {v:systems}
        UNION ALL SELECT page_id, system_idx, x2 FROM {v:systems}) e
    ON e.page_id = s.page_id AND e.system_idx = s.system_idx
  WHERE e.x IN (s.x1, s.x2) OR (e.x > s.x1 + 1e-6 AND e.x < s.x2 - 1e-6)),
nexts AS (SELECT *, lead(x) OVER (PARTITION BY page_id, system_idx ORDER BY x) AS r,
                 count(*) OVER (PARTITION BY page_id, system_idx) AS n FROM edges),
kept AS (SELECT *, row_number() OVER (PARTITION BY page_id, system_idx ORDER BY x) - 1 AS measure_idx
         FROM nexts WHERE n > 2 AND r IS NOT NULL AND r - x >= {w}),
measures AS (
  SELECT page_id, system_idx, CAST(measure_idx AS INT) AS measure_idx, x AS x1, y1, r AS x2, y2,
         CAST(0.75 AS DOUBLE) AS confidence, '{tag}' AS measure_source FROM kept
  UNION ALL
  SELECT page_id, system_idx, 0, x1, y1, x2, y2, CAST(0.25 AS DOUBLE), 'whole_line' FROM {v:systems} s
  WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.page_id = s.page_id AND k.system_idx = s.system_idx))"""


def measures_sql(src: str, w: str, tag: str = "l3_split") -> str:
    return MEASURES.replace("{src}", src).replace("{w}", w).replace("{tag}", tag)


BOX = "round(x1, 6) AS x1, y1, round(x2, 6) AS x2, y2"


@query(
    "derive_measures",
    "WITH " + measures_sql("{v:gt_xs}", "24")
    + f" SELECT page_id, system_idx, measure_idx, {BOX}, confidence, measure_source FROM measures",
)
def q_derive(spark, sf):
    out = s.derive_measures(view(spark, sf, "systems"), view(spark, sf, "gt_xs"), min_width=24.0)
    return out.select(
        "page_id", "system_idx", "measure_idx", *r6("x1"), "y1", *r6("x2"), "y2", "confidence", "measure_source"
    )


@query(
    "derive_all_measures",
    "WITH RECURSIVE " + fold_sql(inside_sql("2"), "2") + ",\n" + measures_sql("lines", "0", "measure_derived")
    + f" SELECT page_id, system_idx, measure_idx, {BOX}, measure_source FROM measures",
)
def q_derive_all(spark, sf):
    out = s.derive_all_measures(view(spark, sf, "systems"), view(spark, sf, "gt_xs"))
    return out.select("page_id", "system_idx", "measure_idx", *r6("x1"), "y1", *r6("x2"), "y2", "measure_source")


@query(
    "splits_from_measures",
    "WITH RECURSIVE " + measures_sql("{v:gt_xs}", "24") + """,
pairs AS (SELECT page_id, system_idx, x2, lead(x1) OVER (PARTITION BY page_id, system_idx ORDER BY (x1 + x2) / 2, measure_idx) AS b
          FROM measures),
"""
    + fold_sql(
        "SELECT p.page_id, p.system_idx, 0 AS split_idx, 0.5 * (p.x2 + b) AS x, 'migrate' AS source, CAST(0.7 AS DOUBLE) AS confidence "
        "FROM pairs p JOIN {v:systems} s ON p.page_id = s.page_id AND p.system_idx = s.system_idx "
        "WHERE b IS NOT NULL AND 0.5 * (p.x2 + b) > s.x1 + 1e-6 AND 0.5 * (p.x2 + b) < s.x2 - 1e-6",
        "30",
    )
    + " SELECT page_id, system_idx, CAST(split_idx AS INT) AS split_idx, round(x, 6) AS x, source FROM lines",
)
def q_from_measures(spark, sf):
    systems = view(spark, sf, "systems")
    measures = s.derive_measures(systems, view(spark, sf, "gt_xs"), min_width=24.0)
    out = s.splits_from_measures(measures, systems, min_gap=30.0)
    return out.select("page_id", "system_idx", "split_idx", *r6("x"), "source")


# a row's declared number of boxes: its distinct positions, one more, or one less
N_MEASURES = (
    "SELECT page_id, system_idx, CAST(0 AS DOUBLE) AS x1, CAST(1000 AS DOUBLE) AS x2, "
    "count(*) + page_id % 3 - 1 AS n_measures FROM {t} GROUP BY page_id, system_idx"
)


@query(
    "interior_splits",
    "WITH RECURSIVE "
    + fold_sql("SELECT page_id, system_idx, split_idx, x, source, confidence FROM {v:gt_xs}", "4")
    + ",\nrws AS (" + N_MEASURES.format(t="{v:gt_xs}") + """),
info AS (SELECT l.*, r.n_measures AS m, r.x1 AS lft, r.x2 AS rgt,
  count(*) OVER p AS c, min(l.x) OVER p AS lo, max(l.x) OVER p AS hi
  FROM lines l JOIN rws r ON l.page_id = r.page_id AND l.system_idx = r.system_idx
  WINDOW p AS (PARTITION BY l.page_id, l.system_idx))
SELECT page_id, system_idx, round(x, 6) AS x FROM info WHERE CASE
  WHEN m >= 1 AND c = m + 1 THEN x <> lo AND x <> hi
  ELSE x > lft + 2 AND x < rgt - 2
    AND NOT (m >= 2 AND c = m AND abs(lo - lft) <= abs(hi - rgt) AND abs(lo - lft) < 40 AND x = lo)
    AND NOT (m >= 2 AND c = m AND NOT (abs(lo - lft) <= abs(hi - rgt) AND abs(lo - lft) < 40) AND abs(hi - rgt) < 40 AND x = hi)
  END""",
)
def q_interior(spark, sf):
    xs = view(spark, sf, "gt_xs")
    rows = xs.groupBy("page_id", "system_idx").agg(
        F.lit(0.0).alias("x1"), F.lit(1000.0).alias("x2"),
        (F.count(F.lit(1)) + F.col("page_id") % 3 - 1).alias("n_measures"),
    )
    return s.interior_splits(xs, rows).select("page_id", "system_idx", *r6("x"))


@query(
    "attach_nearest",
    """WITH c AS (
  SELECT t.page_id, t.system_idx, t.x, p.split_idx AS raw_idx, p.x AS raw_x,
         row_number() OVER (PARTITION BY t.page_id, t.system_idx, t.x ORDER BY abs(p.x - t.x), p.split_idx) AS k
  FROM (SELECT DISTINCT page_id, system_idx, x FROM {v:gt_xs}) t
  JOIN {v:pred_xs} p ON p.page_id = t.page_id AND p.system_idx = t.system_idx AND abs(p.x - t.x) <= 8)
SELECT t.page_id, t.system_idx, t.split_idx, t.x, c.raw_idx, c.raw_x FROM {v:gt_xs} t
LEFT JOIN c ON c.page_id = t.page_id AND c.system_idx = t.system_idx AND c.x = t.x AND c.k = 1""",
)
def q_attach(spark, sf):
    raw = view(spark, sf, "pred_xs").withColumnRenamed("split_idx", "raw_idx")
    out = s.attach_nearest(view(spark, sf, "gt_xs"), raw)
    return out.select(
        "page_id", "system_idx", "split_idx", "x", F.col("raw.raw_idx").alias("raw_idx"), F.col("raw.x").alias("raw_x")
    )


# edits: delete or move lines s1 / s2 of some rows, insert one into others
EDITS = """SELECT page_id, system_idx, CAST(1 AS BIGINT) AS edit_idx, CASE WHEN page_id % 2 = 0 THEN 'move' ELSE 'delete' END AS op,
       concat('s', CAST(1 + page_id % 2 AS VARCHAR(4))) AS split_id, CAST(100 + page_id % 500 AS DOUBLE) AS x FROM {s}
UNION ALL SELECT page_id, system_idx, CAST(2 AS BIGINT), 'insert', 'new', CAST(300 + page_id % 400 AS DOUBLE) FROM {s} WHERE page_id % 3 = 0"""


@query(
    "edit_splits",
    "WITH RECURSIVE edits AS (" + EDITS.replace("{s}", "{v:systems}") + "),\n"
    + fold_sql(inside_sql(), "8")
    + """,
nb AS (SELECT l.*, concat('s', CAST(split_idx AS VARCHAR)) AS sid,
  coalesce(lag(x) OVER p, 0) + 8 AS lo, coalesce(lead(x) OVER p, 1000) - 8 AS hi FROM lines l
  WINDOW p AS (PARTITION BY page_id, system_idx ORDER BY x)),
ed AS (SELECT nb.*, e.op, e.x AS tgt FROM nb LEFT JOIN edits e ON e.page_id = nb.page_id AND e.system_idx = nb.system_idx
       AND e.split_id = nb.sid AND e.op IN ('move', 'delete')),
mixed AS (
  SELECT page_id, system_idx, CAST(split_idx AS BIGINT) AS split_idx,
    CASE WHEN op = 'move' AND hi > lo THEN greatest(lo, least(hi, tgt)) ELSE x END AS x,
    CASE WHEN op = 'move' AND hi > lo THEN 'user' ELSE source END AS source,
    CASE WHEN op = 'move' AND hi > lo THEN 1.0 ELSE confidence END AS confidence
  FROM ed WHERE op IS NULL OR op <> 'delete'
  UNION ALL SELECT page_id, system_idx, 1000000000 + edit_idx, x, 'user', 1.0 FROM edits WHERE op = 'insert'),
"""
    + fold_sql("SELECT * FROM mixed WHERE x > 1e-6 AND x < 1000 - 1e-6", "8").replace("sorted AS", "sorted2 AS")
    .replace("FROM sorted WHERE", "FROM sorted2 WHERE").replace("JOIN sorted r", "JOIN sorted2 r")
    .replace("walk AS", "walk2 AS").replace("FROM walk w", "FROM walk2 w").replace("FROM walk GROUP", "FROM walk2 GROUP")
    .replace("lines AS", "lines2 AS")
    + " SELECT page_id, system_idx, CAST(split_idx AS INT) AS split_idx, round(x, 6) AS x, source, confidence FROM lines2",
)
def q_edit(spark, sf):
    systems = view(spark, sf, "systems")
    edits = spark.sql(EDITS, s=systems)
    out = s.edit_splits(view(spark, sf, "gt_xs"), edits, systems)
    return out.select("page_id", "system_idx", "split_idx", *r6("x"), "source", "confidence")
