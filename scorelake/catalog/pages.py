"""Queries of the page family: placement, reading order, edits and overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.adapters import view
from scorelake.catalog.base import big, query, r6
from scorelake.operators import pages as pg
from scorelake.operators import placement as pl
from scorelake.operators import reports as rp

CX, CY = "(x1 + x2) / 2", "(y1 + y2) / 2"


def layer_sql(layer: str, rid: str) -> str:
    return f"SELECT page_id, item_idx AS {rid}, x1, y1, x2, y2, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy FROM {{v:items}} WHERE layer = '{layer}'"


def _layer(spark, sf, layer, rid):
    return view(spark, sf, "items").where(F.col("layer") == layer).withColumnRenamed("item_idx", rid)


BEST = "SELECT page_id, {r} AS {r}, {h} FROM (SELECT *, row_number() OVER (PARTITION BY page_id, {r} ORDER BY {o}) AS k FROM c) q WHERE k = 1"

D4_SQL = (
    f"WITH m AS ({layer_sql('L3', 'measure_id')}), s AS ({layer_sql('L2', 'system_idx')}),\n"
    """c AS (SELECT m.page_id, m.measure_id, s.system_idx,
  m.cx BETWEEN s.x1 - 8 AND s.x2 + 8 AND m.cy BETWEEN s.y1 - 8 AND s.y2 + 8 AS inside,
  greatest(0, least(s.y2, m.y2) - greatest(s.y1, m.y1)) AS ov, abs(s.cy - m.cy) AS dy, (s.x2-s.x1)*(s.y2-s.y1) AS area
  FROM m JOIN s ON m.page_id = s.page_id)
"""
    + BEST.format(
        r="measure_id", h="system_idx",
        o="CASE WHEN inside THEN 0 WHEN ov > 2 THEN 1 ELSE 2 END, CASE WHEN inside THEN area WHEN ov > 2 THEN -ov ELSE 0 END, dy, system_idx",
    )
)


@query("assign_to_systems", D4_SQL)
def q_d4(spark, sf):
    return pl.assign_to_systems(_layer(spark, sf, "L3", "measure_id"), _layer(spark, sf, "L2", "system_idx")).select(
        "page_id", "measure_id", "system_idx"
    )


@query(
    "assign_by_penalty",
    f"WITH m AS ({layer_sql('L3', 'measure_id')}), s AS ({layer_sql('L2', 'system_idx')}),\n"
    """c AS (SELECT m.page_id, m.measure_id, s.system_idx,
  CASE WHEN m.cy BETWEEN s.y1 - 2 AND s.y2 + 2 THEN 0.0 ELSE least(abs(m.cy - s.y1), abs(m.cy - s.y2)) + 1000 END
  + CASE WHEN m.cx < s.x1 OR m.cx > s.x2 THEN least(abs(m.cx - s.x1), abs(m.cx - s.x2)) ELSE 0.0 END AS pen
  FROM m JOIN s ON m.page_id = s.page_id)
"""
    + BEST.format(r="measure_id", h="system_idx", o="pen, system_idx"),
)
def q_d5(spark, sf):
    return pl.assign_by_penalty(_layer(spark, sf, "L3", "measure_id"), _layer(spark, sf, "L2", "system_idx")).select(
        "page_id", "measure_id", "system_idx"
    )


STATED = "CASE WHEN n.note_id % 3 = 0 THEN n.note_id END"


@query(
    "assign_to_measures",
    f"WITH n AS ({layer_sql('L4', 'note_id')}), m AS ({layer_sql('L3', 'global_no')}),\n"
    """c AS (SELECT n.page_id, n.note_id, m.global_no,
  n.cx BETWEEN m.x1 - 2 AND m.x2 + 2 AND n.cy BETWEEN m.y1 - 2 AND m.y2 + 2 AS inside, abs(m.cx - n.cx) + abs(m.cy - n.cy) AS d
  FROM n JOIN m ON n.page_id = m.page_id)
"""
    + BEST.format(r="note_id", h="global_no", o="CASE WHEN inside THEN 0 ELSE 1 END, CASE WHEN inside THEN 0 ELSE d END, global_no"),
)
def q_d6(spark, sf):
    notes = _layer(spark, sf, "L4", "note_id").withColumn("stated_no", F.lit(None).cast("bigint"))
    return pl.assign_to_measures(notes, _layer(spark, sf, "L3", "global_no")).select("page_id", "note_id", "global_no")


@query(
    "bind_glyphs",
    f"WITH g AS ({layer_sql('L5', 'glyph_id')}), n AS ({layer_sql('L4', 'note_idx')} AND kind IN ('pitch', 'score')),\n"
    """c AS (SELECT g.page_id, g.glyph_id, n.note_idx, abs(n.cx - g.cx) + abs(n.cy - g.cy) AS d FROM g JOIN n ON g.page_id = n.page_id)
"""
    + BEST.format(r="glyph_id", h="note_idx", o="d, note_idx"),
)
def q_d7(spark, sf):
    notes = _layer(spark, sf, "L4", "note_idx").where(F.col("kind").isin("pitch", "score")).withColumn("kind", F.lit("pitch"))
    glyphs = _layer(spark, sf, "L5", "glyph_id").withColumn("stated_idx", F.lit(None).cast("bigint"))
    return pl.bind_glyphs(glyphs, notes, keys=["page_id"]).select("page_id", "glyph_id", "note_idx")


@query(
    "point_to_measure",
    f"WITH p AS ({layer_sql('L5', 'point_id')}), m AS ({layer_sql('L3', 'measure_idx')}),\n"
    """c0 AS (SELECT p.page_id, p.point_id, m.measure_idx, power(greatest(0, m.x1 - p.cx, p.cx - m.x2), 2) + power(greatest(0, m.y1 - p.cy, p.cy - m.y2), 2) AS d
  FROM p JOIN m ON p.page_id = m.page_id), c AS (SELECT * FROM c0 WHERE d <= 14400)
"""
    + BEST.format(r="point_id", h="measure_idx", o="d, CASE WHEN d = 0 THEN measure_idx ELSE -measure_idx END"),
)
def q_d9(spark, sf):
    points = _layer(spark, sf, "L5", "point_id").selectExpr("page_id", "point_id", f"{CX} AS x", f"{CY} AS y")
    return pl.point_to_measure(points, _layer(spark, sf, "L3", "measure_idx"), snap=120.0).select(
        "page_id", "point_id", "measure_idx"
    )


@query(
    "rect_to_measure_range",
    f"WITH p AS ({layer_sql('L5', 'rect_id')}), m0 AS ({layer_sql('L3', 'measure_id')}),\n"
    """m AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY measure_id) - 1 AS i FROM m0),
h AS (SELECT p.page_id, p.rect_id, min(i) + 1 AS a, max(i) + 1 AS b FROM p JOIN m ON p.page_id = m.page_id
  AND NOT (p.x2 < m.x1 - 2 OR p.x1 > m.x2 + 2 OR p.y2 < m.y1 - 2 OR p.y1 > m.y2 + 2) GROUP BY ALL),
d AS (SELECT p.page_id, p.rect_id, i, power(greatest(0, m.x1 - p.cx, p.cx - m.x2), 2) + power(greatest(0, m.y1 - p.cy, p.cy - m.y2), 2) AS d
  FROM p JOIN m ON p.page_id = m.page_id),
b AS (SELECT page_id, rect_id, arg_min(i, (d, CASE WHEN d = 0 THEN i ELSE -i END)) + 1 AS i FROM d WHERE d <= 1600 GROUP BY ALL)
SELECT p.page_id, p.rect_id, CAST(coalesce(h.a, b.i, 1) AS BIGINT) AS "from", CAST(coalesce(h.b, b.i, 1) AS BIGINT) AS "to" FROM p
LEFT JOIN h ON h.page_id = p.page_id AND h.rect_id = p.rect_id LEFT JOIN b ON b.page_id = p.page_id AND b.rect_id = p.rect_id""",
)
def q_d10(spark, sf):
    from scorelake.plans.skew import ordered

    m = ordered(_layer(spark, sf, "L3", "measure_id"), ["page_id"], ["measure_id"], number="_n")
    m = m.withColumn("measure_idx", F.col("_n") - 1)
    return pl.rect_to_measure_range(_layer(spark, sf, "L5", "rect_id"), m).select("page_id", "rect_id", *big("from", "to"))


@query(
    "parent_of",
    """WITH i AS (SELECT *, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy,
    CASE layer WHEN 'L2' THEN 'L1' WHEN 'L3' THEN 'L2' WHEN 'L4' THEN 'L3' WHEN 'L5' THEN 'L4' END AS up FROM {v:items}),
sc AS (SELECT DISTINCT page_id FROM i WHERE layer = 'L1' AND kind = 'score'),
h AS (SELECT * FROM i WHERE layer <> 'L1' OR kind = 'score' OR page_id NOT IN (SELECT page_id FROM sc)),
c AS (SELECT i.page_id, i.item_idx, h.item_idx AS parent, i.cx BETWEEN h.x1 - 2 AND h.x2 + 2 AND i.cy BETWEEN h.y1 - 2 AND h.y2 + 2 AS inside,
  (h.x2-h.x1)*(h.y2-h.y1) AS area, power(h.cx - i.cx, 2) + power(h.cy - i.cy, 2) AS d FROM i JOIN h ON i.page_id = h.page_id AND i.up = h.layer),
b AS (SELECT page_id, item_idx, arg_min(parent, (CASE WHEN inside THEN 0 ELSE 1 END, CASE WHEN inside THEN area ELSE d END, parent)) AS parent FROM c GROUP BY 1, 2)
SELECT i.page_id, i.item_idx, i.layer, coalesce(b.parent, i.item_idx) AS parent FROM i LEFT JOIN b ON b.page_id = i.page_id AND b.item_idx = i.item_idx""",
)
def q_d22(spark, sf):
    return pl.parent_of(view(spark, sf, "items")).select("page_id", "item_idx", "layer", "parent")


EDITS = """SELECT page_id, item_idx AS edit_idx, CASE WHEN item_idx % 3 = 0 THEN '' ELSE id END AS id, layer, label,
  x1 + CAST(item_idx % 5 AS DOUBLE) - 2 AS x1, y1 AS y1, x2 - 100 AS x2, y2 + CAST(item_idx % 7 AS DOUBLE) AS y2
  FROM {i} WHERE item_idx % 5 < 2"""
NORM = """SELECT page_id, edit_idx, id, layer, label, a AS x1, b AS y1, CASE WHEN c - a < 4 THEN least(1000, a + 4) ELSE c END AS x2,
  CASE WHEN d - b < 4 THEN least(1200, b + 4) ELSE d END AS y2 FROM (
  SELECT *, greatest(0, least(x1, x2)) AS a, greatest(0, least(y1, y2)) AS b, least(1000, greatest(x1, x2)) AS c, least(1200, greatest(y1, y2)) AS d FROM e) q"""


def page_sizes(items):
    return items.select("page_id", F.lit(1000).alias("width"), F.lit(1200).alias("height")).distinct()


APPLY_EDITS_SQL = (
    f"""WITH e AS ({EDITS.replace('{i}', '{v:items}')}), n AS ({NORM}),
a AS (SELECT page_id, id, arg_max({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}, edit_idx) AS b FROM n WHERE id <> '' GROUP BY 1, 2),
l AS (SELECT page_id, layer, label, arg_max({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}, edit_idx) AS b FROM n GROUP BY 1, 2, 3)
SELECT i.page_id, i.item_idx, coalesce(a.b.x1, l.b.x1, i.x1) AS x1, coalesce(a.b.y1, l.b.y1, i.y1) AS y1,
  coalesce(a.b.x2, l.b.x2, i.x2) AS x2, coalesce(a.b.y2, l.b.y2, i.y2) AS y2, a.b IS NOT NULL OR l.b IS NOT NULL AS edited
FROM {{v:items}} i LEFT JOIN a ON a.page_id = i.page_id AND a.id = i.id
LEFT JOIN l ON l.page_id = i.page_id AND l.layer = i.layer AND l.label = i.label"""
)


@query("apply_edits", APPLY_EDITS_SQL)
def q_d8(spark, sf):
    items = view(spark, sf, "items")
    out = pg.apply_edits(items, spark.sql(EDITS, i=items), page_sizes(items))
    return out.select("page_id", "item_idx", "x1", "y1", "x2", "y2", "edited")


DRAFT = """SELECT page_id, item_idx, layer, CASE WHEN item_idx % 11 = 0 THEN concat(id, 'new') ELSE id END AS id, label, kind,
  x1 + CASE WHEN item_idx % 4 = 0 THEN 0.25 WHEN item_idx % 4 = 1 THEN 3.0 ELSE 0.0 END AS x1, y1, x2, y2 FROM {i}"""


@query(
    "diff_layouts",
    f"""WITH d AS ({DRAFT.replace('{i}', '{v:items}')}),
o AS (SELECT page_id, id, arg_max(x1, item_idx) AS ox1, arg_max(y1, item_idx) AS oy1, arg_max(x2, item_idx) AS ox2, arg_max(y2, item_idx) AS oy2 FROM {{v:items}} GROUP BY 1, 2)
SELECT d.page_id, d.item_idx AS edit_idx, d.id, d.layer, d.label, d.x1, d.y1, d.x2, d.y2 FROM d LEFT JOIN o ON o.page_id = d.page_id AND o.id = d.id
WHERE o.id IS NULL OR abs(x1-ox1) > 0.5 OR abs(y1-oy1) > 0.5 OR abs(x2-ox2) > 0.5 OR abs(y2-oy2) > 0.5""",
)
def q_d20(spark, sf):
    items = view(spark, sf, "items")
    return pg.diff_layouts(items, spark.sql(DRAFT, i=items))


ORDER_SQL = f"""WITH m0 AS ({layer_sql('L3', 'measure_id')}), a AS ({D4_SQL}),
s AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY round(cy, 1), round(cx, 1), system_idx) - 1 AS no FROM ({layer_sql('L2', 'system_idx')}) q),
g AS (SELECT m0.page_id, m0.measure_id, s.no, row_number() OVER (PARTITION BY m0.page_id ORDER BY s.no, round(m0.cx, 1), round(m0.cy, 1), m0.measure_id) AS global_no
  FROM m0 JOIN a ON a.page_id = m0.page_id AND a.measure_id = m0.measure_id JOIN s ON s.page_id = a.page_id AND s.system_idx = a.system_idx)
SELECT page_id, measure_id, CAST(no AS INT) AS system_idx, CAST(global_no AS INT) AS global_no,
  CAST(row_number() OVER (PARTITION BY page_id, no ORDER BY global_no) - 1 AS INT) AS measure_idx FROM g"""


@query("reading_order", ORDER_SQL)
def q_f1(spark, sf):
    systems = _layer(spark, sf, "L2", "system_idx")
    found = _layer(spark, sf, "L3", "measure_id")
    placed = found.join(pl.assign_to_systems(found, systems), ["page_id", "measure_id"])
    _, m = pg.reading_order(systems, placed.withColumn("measure_idx", F.col("measure_id")))
    return m.select("page_id", "measure_id", "system_idx", "global_no", "measure_idx")


BARS = """SELECT page_id, CAST(item_idx % 3 AS INT) AS system, item_idx AS line_idx, x1 AS x, '' AS id, 'detect' AS source,
  CAST(0.5 AS DOUBLE) AS confidence FROM {i} WHERE layer = 'L5'"""


@query("rebuild_pages")
def q_f16(spark, sf):
    items = view(spark, sf, "items")
    out = pg.rebuild_pages(items, spark.sql(BARS, i=items), page_sizes(items))
    tall = lambda name, *cols: out[name].select(
        "page_id", F.lit(name).alias("part"), F.concat_ws("/", *[F.col(c).cast("string") for c in cols]).alias("path")
    )
    parts = tall("regions", "role", "item_idx")
    for part in (
        tall("systems", "system_idx"), tall("splits", "system_idx", "split_idx"), tall("measures", "system_idx", "global_no"),
        tall("notes", "global_no", "note_idx"), tall("glyphs", "global_no", "note_idx", "glyph_id"),
    ):
        parts = parts.unionByName(part)
    return parts


@query(
    "page_extent",
    "SELECT page_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM {v:items} GROUP BY page_id",
)
def q_e12(spark, sf):
    return rp.page_extent(view(spark, sf, "items"))


@query(
    "kind_histogram",
    "SELECT page_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("score", "title", "key_time", "lyric", "pitch"))
    + " FROM {v:items} GROUP BY page_id",
)
def q_e10(spark, sf):
    return rp.kind_histogram(view(spark, sf, "items"), "page_id", ["score", "title", "key_time", "lyric", "pitch"])


@query(
    "page_summary",
    """SELECT page_id, count(*) FILTER (layer = 'L2') AS n_systems, count(*) FILTER (layer = 'L3') AS n_measures,
  count(*) FILTER (layer = 'L4') AS n_notes, count(*) FILTER (layer = 'L5') AS n_glyphs FROM {v:items} GROUP BY page_id""",
)
def q_e11(spark, sf):
    items = view(spark, sf, "items")
    one = lambda layer: items.where(F.col("layer") == layer)
    return rp.page_summary(items, systems=one("L2"), measures=one("L3"), notes=one("L4"), glyphs=one("L5"))


@query(
    "boxes_from_items",
    "SELECT page_id AS sample_id, layer, item_idx AS box_idx, label, kind, x1, y1, x2, y2 FROM {v:items}",
)
def q_a4(spark, sf):
    return pg.boxes_from_items(view(spark, sf, "items"))


ROUTE_L = "SELECT page_id, CAST(item_idx % 5 AS INT) AS system, item_idx AS line_idx, x1 AS x FROM {i} WHERE layer = 'L5'"
ROUTE_S = "SELECT page_id, CAST(floor(y1 / 100) AS INT) AS system_idx, max(concat('l2-sys', CAST(CAST(floor(y1 / 100) AS INT) % 7 + 2 AS VARCHAR(8)))) AS system_id FROM {i} WHERE layer = 'L2' GROUP BY page_id, CAST(floor(y1 / 100) AS INT)"


@query(
    "route_lines",
    f"""WITH l AS ({ROUTE_L.replace('{i}', '{v:items}')}), s AS ({ROUTE_S.replace('{i}', '{v:items}')}),
t AS (SELECT *, CAST(regexp_extract(system_id, 'sys([0-9]+)', 1) AS INT) AS stated FROM s),
u AS (SELECT page_id, system_idx, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.page_id = t.page_id AND l.system = t.stated) THEN stated ELSE system_idx END AS system FROM t)
SELECT l.page_id, l.line_idx, l.x, u.system_idx FROM l JOIN u ON l.page_id = u.page_id AND l.system = u.system""",
)
def q_d17(spark, sf):
    items = view(spark, sf, "items")
    out = pl.route_lines(spark.sql(ROUTE_L, i=items), spark.sql(ROUTE_S, i=items))
    return out.select("page_id", "line_idx", "x", "system_idx")


@query(
    "pin_layers",
    """WITH u AS (SELECT page_id, layer, item_idx, x1 + 5 AS x1, y1, x2 + 5 AS x2, y2 FROM {v:items} WHERE item_idx % 2 = 0 AND layer IN ('L1', 'L2', 'L3'))
SELECT i.page_id, i.layer, i.item_idx, coalesce(u.x1, i.x1) AS x1, coalesce(u.x2, i.x2) AS x2, u.x1 IS NOT NULL AS pinned
FROM {v:items} i LEFT JOIN u ON u.page_id = i.page_id AND u.layer = i.layer AND u.item_idx = i.item_idx""",
)
def q_f19(spark, sf):
    items = view(spark, sf, "items").withColumn("path", F.col("item_idx").cast("string"))
    user = items.where("item_idx % 2 = 0").withColumns({"x1": F.col("x1") + 5, "x2": F.col("x2") + 5})
    return pg.pin_layers(items, user, "L3").select("page_id", "layer", "item_idx", "x1", "x2", "pinned")


REG = "SELECT page_id, item_idx AS region_idx, kind AS role, x1, y1, x2, y2, confidence FROM {i} WHERE layer = 'L1' AND {c}"


@query(
    "merge_regions",
    f"""WITH r AS ({REG.replace('{i}', '{v:items}').replace('{c}', 'item_idx % 3 <> 0')}), n AS ({REG.replace('{i}', '{v:items}').replace('{c}', 'item_idx % 3 <> 1')}),
a AS (SELECT page_id, role, max_by({{'x1': x1, 'y1': y1}}, region_idx) AS b FROM r WHERE role IN ('title', 'key_time', 'score') AND page_id IN (SELECT page_id FROM n) GROUP BY 1, 2),
l AS (SELECT page_id, role, max_by({{'x1': x1, 'y1': y1}}, region_idx) AS b FROM n WHERE role IN ('title', 'key_time', 'score') GROUP BY 1, 2),
m AS (SELECT coalesce(a.page_id, l.page_id) AS page_id, coalesce(a.role, l.role) AS role,
  CASE WHEN coalesce(a.role, l.role) = 'score' THEN coalesce(l.b, a.b) ELSE coalesce(a.b, l.b) END AS b FROM a FULL JOIN l ON a.page_id = l.page_id AND a.role = l.role)
SELECT page_id, role, b.x1 AS x1, b.y1 AS y1 FROM m UNION ALL SELECT page_id, role, x1, y1 FROM r WHERE page_id NOT IN (SELECT page_id FROM m)""",
)
def q_i3(spark, sf):
    items = view(spark, sf, "items")
    one = lambda c: spark.sql(REG.replace("{c}", c), i=items)
    return pg.merge_regions(one("item_idx % 3 <> 0"), one("item_idx % 3 <> 1")).select("page_id", "role", "x1", "y1")


@query("export_layouts")
def q_f4b(spark, sf):
    from scorelake.operators.exports import export_layouts

    items = view(spark, sf, "items")
    out = export_layouts(items, spark.sql(BARS, i=items))
    tall = lambda name, *cols: out[name].select(
        "page_id", F.lit(name).alias("part"), F.concat_ws("/", *[F.col(c).cast("string") for c in cols]).alias("path")
    )
    return (
        tall("regions", "role", "leads").unionByName(tall("systems", "system_idx", "system_id"))
        .unionByName(tall("splits", "system_idx", "split_idx", "source")).unionByName(tall("measures", "system_idx", "measure_idx"))
    )


OV_M = "SELECT score_id AS page_id, measure_no AS global_no, 0 AS system_idx, measure_no AS measure_idx, CAST(measure_no * 10 AS DOUBLE) AS x1, CAST(0 AS DOUBLE) AS y1, CAST(measure_no * 10 + 9 AS DOUBLE) AS x2, CAST(9 AS DOUBLE) AS y2, CASE WHEN source = 'layout' THEN 'l3_split' ELSE 'whole_line' END AS measure_source, CAST(0.5 AS DOUBLE) AS confidence FROM {m}"
OV_N = "SELECT score_id AS page_id, measure_no AS global_no, 0 AS system_idx, measure_no AS measure_idx, note_idx, CASE WHEN pitch_from = 'mixed' THEN 'chord' ELSE 'pitch' END AS kind, pitch, is_rest, CASE WHEN note_idx % 6 = 0 THEN NULL ELSE duration END AS duration, dots, octave, dots AS underlines, sustain_dashes, pitch_from, CASE WHEN note_idx % 3 = 0 THEN '' ELSE duration END AS ocr_text, ocr_score, CAST(0 AS DOUBLE) AS x1, CAST(0 AS DOUBLE) AS y1, CAST(5 AS DOUBLE) AS x2, CAST(5 AS DOUBLE) AS y2, CAST(0.5 AS DOUBLE) AS confidence FROM {n}"


def _overlay(spark, sf):
    m = spark.sql(OV_M, m=view(spark, sf, "score_measures"))
    n = spark.sql(OV_N, n=view(spark, sf, "score_notes"))
    regions = view(spark, sf, "items").where("layer = 'L1'").withColumnsRenamed({"kind": "role", "item_idx": "region_idx"})
    return regions, view(spark, sf, "systems").withColumn("confidence", F.lit(0.5)), m, n


@query(
    "overlay_items",
    f"""WITH m AS ({OV_M.replace('{m}', '{v:score_measures}')}), n AS ({OV_N.replace('{n}', '{v:score_notes}')})
SELECT page_id, 'L1' AS layer, concat('l1-', kind) AS id, kind AS label, NULL AS pitch FROM {{v:items}} WHERE layer = 'L1'
UNION ALL SELECT page_id, 'L2', concat('l2-sys', system_idx), concat('row ', system_idx + 1), NULL FROM {{v:systems}}
UNION ALL SELECT page_id, 'L3', concat('l3-m', global_no), concat('m', global_no, CASE WHEN measure_source = 'l3_split' THEN '' ELSE '/' || measure_source END), NULL FROM m
UNION ALL SELECT page_id, 'L4', concat('l4-m', global_no, '-', kind, note_idx), concat(CASE WHEN kind = 'pitch' THEN 'n' ELSE 'c' END, note_idx + 1), NULL FROM n
UNION ALL SELECT page_id, 'L5', concat('l5-m', global_no, '-n', note_idx), CASE WHEN duration IS NULL THEN '?' ELSE concat(coalesce(pitch, CASE WHEN is_rest THEN '0' ELSE '?' END),
  CASE WHEN underlines <> 0 THEN concat('_', underlines) ELSE '' END, repeat('.', least(2, dots)), CASE WHEN octave > 0 THEN concat('@+', octave) WHEN octave < 0 THEN concat('@', octave) ELSE '' END,
  CASE WHEN sustain_dashes <> 0 THEN '-' ELSE '' END, CASE WHEN pitch_from = 'geometry' THEN '~' ELSE '' END) END, pitch FROM n WHERE kind = 'pitch'""",
)
def q_f17b(spark, sf):
    return pg.overlay_items(*_overlay(spark, sf)).select("page_id", "layer", "id", "label", "pitch")


@query(
    "boxes_from_layout",
    f"""WITH m AS ({OV_M.replace('{m}', '{v:score_measures}')}), n AS ({OV_N.replace('{n}', '{v:score_notes}')})
SELECT page_id AS sample_id, 'L1' AS layer, kind AS label, kind FROM {{v:items}} WHERE layer = 'L1' UNION ALL SELECT page_id, 'L2', concat('sys', system_idx), 'system' FROM {{v:systems}}
UNION ALL SELECT page_id, 'L3', concat('m', measure_idx), 'measure' FROM m UNION ALL SELECT page_id, 'L4', concat(kind, note_idx), kind FROM n""",
)
def q_a4b(spark, sf):
    r, s, m, n = _overlay(spark, sf)
    return pg.boxes_from_layout(r, s, m, n).select("sample_id", "layer", "label", "kind")


@query(
    "recognition_facts",
    f"""WITH n AS ({OV_N.replace('{n}', '{v:score_notes}')}) SELECT page_id, measure_idx, note_idx, coalesce(nullif(ocr_text, ''), pitch, '') AS text, CASE WHEN pitch IS NOT NULL THEN 'pitch' ELSE 'other' END AS kind, ocr_score AS score FROM n""",
)
def q_f17c(spark, sf):
    return pg.recognition_facts(_overlay(spark, sf)[3]).select("page_id", "measure_idx", "note_idx", "text", "kind", "score")


@query("clear_below", "SELECT page_id, item_idx, layer FROM {v:items} WHERE layer IN ('L1', 'L2', 'L3')")
def q_f19_clear(spark, sf):
    return pg.clear_below(view(spark, sf, "items"), "L3").select("page_id", "item_idx", "layer")
