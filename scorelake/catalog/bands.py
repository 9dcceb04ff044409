"""Queries of the band family and of re-run merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.adapters import view
from scorelake.catalog.base import big, query, r6
from scorelake.catalog.pages import layer_sql
from scorelake.operators import bands as bd
from scorelake.operators import rerun as rr
from scorelake.plans.lineage import written
from scorelake.plans.skew import FOLD_ROWS, measure

ROLE = """CASE WHEN h <= 12 AND (n_wide >= 1 OR n_digitish <= 2) THEN 'underline' WHEN h <= 10 THEN 'underline'
  WHEN n_digitish >= 3 AND h BETWEEN 12 AND 80 THEN CASE WHEN (med_ch >= 22 AND h >= 16 AND staff_score >= 0.35 AND n_digitish >= 5)
    OR (med_ch >= 26 AND h >= 28 AND staff_score >= 0.35) OR (med_ch >= 24 AND h >= 20 AND n_digitish >= 8) THEN 'pitch' ELSE 'secondary' END
  WHEN n_comps >= 6 AND h BETWEEN 12 AND 60 THEN 'secondary' WHEN staff_score >= 0.35 AND h BETWEEN 14 AND 80 THEN CASE WHEN med_ch >= 20 THEN 'pitch' ELSE 'secondary' END
  WHEN h < 14 THEN 'underline' ELSE 'noise' END"""
B = f"b AS (SELECT *, {ROLE} AS role FROM (SELECT *, greatest(1, y1 - y0) AS h FROM {{v:bands}}) q)"
MED = "md AS (SELECT page_id, coalesce(median(h) FILTER (role <> 'underline'), 32) AS med_h FROM b GROUP BY 1)"
GAP = """gp AS (SELECT page_id, quantile_cont(g::DOUBLE, 0.4) FILTER (g >= 0) AS p40, quantile_cont(g::DOUBLE, 0.75) FILTER (g >= 0) AS p75 FROM (
  SELECT page_id, y0 - lag(y1) OVER (PARTITION BY page_id ORDER BY y0, band_idx) AS g FROM b) q GROUP BY 1),
gap AS (SELECT gp.page_id, med_h, CASE WHEN p40 IS NULL THEN greatest(48.0, 2.6 * med_h) ELSE
  least(greatest(CASE WHEN p75 > p40 * 1.9 AND p75 > 60 THEN least(greatest(p40 * 1.5, 1.85 * med_h, 48.0), 0.72 * p75) ELSE greatest(p40 * 1.5, 1.85 * med_h, 48.0) END, 48.0), greatest(greatest(48.0, 2.6 * med_h), 110.0)) END AS max_gap
  FROM gp JOIN md ON md.page_id = gp.page_id)"""


def _bands(spark, sf):
    return bd.classify_bands(view(spark, sf, "bands"))


@query("classify_bands", f"WITH {B} SELECT page_id, band_idx, role FROM b")
def q_c6(spark, sf):
    return _bands(spark, sf).select("page_id", "band_idx", "role")


@query("adaptive_gap", f"WITH {B}, {MED}, {GAP} SELECT page_id, med_h, round(max_gap, 6) AS max_gap FROM gap")
def q_e15(spark, sf):
    return bd.adaptive_gap(_bands(spark, sf)).select("page_id", "med_h", *r6("max_gap"))


SCORED = """r0 AS (SELECT b.*, med_h, n_narrow::DOUBLE / greatest(n_digitish, 1) AS nr, n_square::DOUBLE / greatest(n_digitish, 1) AS sr, greatest(med_h, 1.0) AS m1 FROM b JOIN md ON md.page_id = b.page_id),
r1 AS (SELECT *, CASE WHEN role <> 'underline' AND n_digitish >= 4 AND h >= greatest(12.0, med_h * 0.45) AND NOT (sr >= 0.42 AND n_square >= 8 AND n_square >= n_narrow * 0.85 AND nr < 0.72)
    AND NOT (med_ch < m1 * 0.70 AND n_narrow < 12 AND sr > 0.15 AND nr < 0.80) THEN
    (med_ch * 1.25::DOUBLE + n_narrow * 2.0::DOUBLE + n_digitish * 0.35::DOUBLE + staff_score * 30.0::DOUBLE + h * 0.35::DOUBLE + nr * 22.0::DOUBLE - n_square * 1.4::DOUBLE - sr * 28.0::DOUBLE)
    * CASE WHEN role = 'pitch' THEN 1.06::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN med_ch < m1 * 0.82 AND nr < 0.75 THEN 0.62::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN sr >= 0.30 AND nr < 0.85 THEN 0.70::DOUBLE ELSE 1.0::DOUBLE END END AS s1,
  CASE WHEN role <> 'underline' AND n_digitish >= 3 AND NOT (sr >= 0.5 AND n_square >= 8) THEN med_ch * 0.6::DOUBLE + staff_score * 40.0::DOUBLE + h * 0.25::DOUBLE + n_narrow * 1.5::DOUBLE - n_square * 0.4::DOUBLE - n_square * 0.8::DOUBLE END AS s2 FROM r0),
r2 AS (SELECT *, CASE WHEN count(s1) OVER (PARTITION BY page_id) > 0 THEN s1 ELSE s2 END AS score FROM r1),
r3 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, y0, band_idx) AS rk, count(*) OVER (PARTITION BY page_id) AS n, max(score) OVER (PARTITION BY page_id) AS mx FROM r2 WHERE score IS NOT NULL),
r4 AS (SELECT page_id, median(med_ch) AS tp FROM r3 WHERE rk <= greatest(2, n // 3) GROUP BY 1),
r5 AS (SELECT r3.*, score >= mx * 0.55 AS nm, score >= mx * 0.55 AND med_ch >= tp * 0.84 AS tl FROM r3 JOIN r4 ON r4.page_id = r3.page_id),
r6 AS (SELECT *, count(*) FILTER (tl) OVER (PARTITION BY page_id) AS nt, count(*) FILTER (nm) OVER (PARTITION BY page_id) AS nn FROM r5),
cd AS (SELECT *, greatest(28.0, med_h * 1.55) AS sep, row_number() OVER (PARTITION BY page_id ORDER BY y0, band_idx) AS k FROM r6 WHERE CASE WHEN nt >= 2 THEN tl WHEN nn > 0 THEN nm ELSE rk = 1 END),
aw AS (SELECT page_id, k, [{'y': y0, 'b': band_idx, 's': score}] AS a FROM cd WHERE k = 1
  UNION ALL SELECT c.page_id, c.k, CASE WHEN c.y0 - w.a[-1].y >= c.sep THEN list_append(w.a, {'y': c.y0, 'b': c.band_idx, 's': c.score})
    WHEN c.score > w.a[-1].s * 1.06 THEN list_append(w.a[:len(w.a) - 1], {'y': c.y0, 'b': c.band_idx, 's': c.score}) ELSE w.a END FROM aw w JOIN cd c ON c.page_id = w.page_id AND c.k = w.k + 1),
an AS (SELECT page_id, unnest(arg_max(a, k)).b AS band_idx FROM aw GROUP BY page_id)"""
ANCHORS = f"WITH RECURSIVE {B}, {MED}, {GAP}, {SCORED}"


@query("melody_anchors", ANCHORS + " SELECT page_id, band_idx FROM an")
def q_g6(spark, sf):
    return bd.melody_anchors(_bands(spark, sf))


MODE = """aa AS (SELECT b.*, row_number() OVER w AS no, lead(y0) OVER w AS ny0, lead(band_idx) OVER w AS nb FROM (SELECT b.* FROM b JOIN an ON an.page_id = b.page_id AND an.band_idx = b.band_idx) b
  WINDOW w AS (PARTITION BY page_id ORDER BY y0, band_idx)),
ob AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM an WHERE an.page_id = b.page_id AND an.band_idx = b.band_idx)),
vt AS (SELECT aa.page_id, aa.band_idx, count(*) FILTER (o.y1 <= aa.y0 + 2 AND aa.y0 - o.y1 <= greatest(48.0, 2.2 * med_h)) AS na,
  count(*) FILTER (o.y0 >= aa.y1 - 2 AND o.y0 < coalesce(aa.ny0, aa.y1 + 10000) - 4 AND o.y0 - aa.y1 <= greatest(60.0, 3.8 * med_h)) AS nb
  FROM aa JOIN md ON md.page_id = aa.page_id JOIN ob o ON o.page_id = aa.page_id AND o.role <> 'underline' GROUP BY 1, 2),
vs AS (SELECT page_id, count(*) FILTER (na > 0) AS va, count(*) FILTER (na = 0 AND nb > 0) AS vb FROM vt GROUP BY 1),
mode AS (SELECT md.page_id, CASE WHEN coalesce(va, 0) = 0 AND coalesce(vb, 0) = 0 THEN 'pitch_only' WHEN coalesce(va, 0) > coalesce(vb, 0) THEN 'chord_above' ELSE 'chord_below' END AS layout_mode FROM md LEFT JOIN vs ON vs.page_id = md.page_id)"""


@query("layout_mode_vote", f"{ANCHORS}, {MODE} SELECT page_id, layout_mode FROM mode")
def q_e17(spark, sf):
    b = _bands(spark, sf)
    return bd.layout_mode_vote(b, bd.melody_anchors(b))


OWN = """mids AS (SELECT a.page_id, a.band_idx AS up, a.nb AS low, a.y1 AS a1, a.ny0 AS n0, o.band_idx, o.y0, o.y1, o.h, o.role, m.layout_mode AS mode, d.med_h,
  row_number() OVER (PARTITION BY a.page_id, a.band_idx ORDER BY o.y0, o.band_idx) AS t FROM aa a JOIN ob o ON o.page_id = a.page_id AND o.y0 >= a.y1 - 3 AND o.y1 <= a.ny0 + 3
  JOIN mode m ON m.page_id = a.page_id JOIN md d ON d.page_id = a.page_id WHERE a.nb IS NOT NULL),
sq AS (SELECT page_id, up, t, y0 - coalesce(lag(y1) OVER (PARTITION BY page_id, up ORDER BY t), a1) AS g FROM mids WHERE mode <> 'chord_below'
  UNION ALL SELECT page_id, up, max(t) + 1, arg_max(n0 - y1, t) FROM mids WHERE mode <> 'chord_below' GROUP BY 1, 2),
ct AS (SELECT page_id, up, arg_max(t, (g, -t)) AS c FROM sq GROUP BY 1, 2),
cl AS (SELECT page_id, band_idx, CASE WHEN n0 - y1 <= greatest(10.0, 0.5 * med_h) AND y1 <= n0 + 2 AND (role = 'underline' OR h <= greatest(12.0, 0.45 * med_h)) THEN low ELSE up END AS owner FROM mids WHERE mode = 'chord_below'
  UNION ALL SELECT m.page_id, m.band_idx, CASE WHEN m.t < ct.c THEN m.up ELSE m.low END FROM mids m JOIN ct ON ct.page_id = m.page_id AND ct.up = m.up WHERE mode <> 'chord_below'),
fr AS (SELECT o.* FROM ob o WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.page_id = o.page_id AND cl.band_idx = o.band_idx)),
ov AS (SELECT f.page_id, f.band_idx, arg_min(a.band_idx, a.no) AS owner FROM fr f JOIN aa a ON a.page_id = f.page_id AND f.y1 > a.y0 AND f.y0 < a.y1 GROUP BY 1, 2),
en AS (SELECT page_id, arg_min(band_idx, no) AS fb, arg_min(y0, no) AS fy, arg_max(band_idx, no) AS lb, arg_max(y1, no) AS ly FROM aa GROUP BY 1),
ou AS (SELECT f.page_id, f.band_idx, CASE WHEN f.y1 <= fy AND fy - f.y1 <= greatest(max_gap, 2.4 * med_h, 70.0) * CASE WHEN layout_mode = 'chord_below' THEN 0.6 ELSE 1 END THEN fb
  WHEN f.y1 > fy AND f.y0 >= ly AND f.y0 - ly <= greatest(max_gap, 4.2 * med_h, 120.0) THEN lb END AS owner FROM fr f JOIN en ON en.page_id = f.page_id JOIN gap ON gap.page_id = f.page_id JOIN mode ON mode.page_id = f.page_id
  WHERE NOT EXISTS (SELECT 1 FROM ov WHERE ov.page_id = f.page_id AND ov.band_idx = f.band_idx)),
own AS (SELECT page_id, band_idx, band_idx AS owner FROM aa UNION ALL SELECT * FROM cl UNION ALL SELECT * FROM ov UNION ALL SELECT * FROM ou WHERE owner IS NOT NULL)"""


def _owned(spark, sf, keep=()):
    b = written(_bands(spark, sf))
    hot = measure(b, ["page_id"], FOLD_ROWS)
    anchors = written(bd.melody_anchors(b, hot=hot))
    modes = written(bd.layout_mode_vote(b, anchors, hot=hot))
    return hot, modes, bd.own_bands(b, anchors, modes, written(bd.adaptive_gap(b, hot=hot)), keep=keep, hot=hot)


@query("own_bands", f"{ANCHORS}, {MODE}, {OWN} SELECT page_id, band_idx, owner FROM own")
def q_d18(spark, sf):
    return _owned(spark, sf)[2]


LABEL = """oc AS (SELECT own.owner, b.*, m.layout_mode, med_ch * 1.3::DOUBLE + n_narrow * 2.2::DOUBLE + n_digitish * 0.35::DOUBLE + staff_score * 22.0::DOUBLE + h * 0.35::DOUBLE + n_narrow::DOUBLE / greatest(n_digitish, 1) * 25.0::DOUBLE
  - n_square * 1.8::DOUBLE - n_square::DOUBLE / greatest(n_digitish, 1) * 30.0::DOUBLE + CASE WHEN role = 'pitch' THEN 6.0::DOUBLE ELSE 0.0::DOUBLE END AS sc FROM own JOIN b ON b.page_id = own.page_id AND b.band_idx = own.band_idx JOIN mode m ON m.page_id = b.page_id),
pb AS (SELECT page_id, owner, arg_max(band_idx, (sc, -y0, -band_idx)) AS pi, arg_max(y0, (sc, -y0, -band_idx)) AS py0, arg_max(y1, (sc, -y0, -band_idx)) AS py1 FROM oc WHERE role <> 'underline' GROUP BY 1, 2),
lb AS (SELECT oc.*, pi, py0, py1, role <> 'underline' AND oc.y0 >= py1 - 2 AND band_idx <> pi AS below FROM oc LEFT JOIN pb ON pb.page_id = oc.page_id AND pb.owner = oc.owner),
fb AS (SELECT page_id, owner, arg_min(band_idx, (y0, band_idx)) AS f FROM lb WHERE below GROUP BY 1, 2),
labelled AS (SELECT lb.page_id, lb.owner, band_idx, y0, y1, h, med_ch, n_narrow, layout_mode, CASE WHEN role = 'underline' THEN role WHEN band_idx = pi THEN 'pitch' WHEN below THEN CASE WHEN layout_mode = 'chord_above' THEN 'lyric' WHEN band_idx = f THEN 'chord' ELSE 'lyric' END
  WHEN y1 <= py0 + 2 THEN 'chord' ELSE 'secondary' END AS role FROM lb LEFT JOIN fb ON fb.page_id = lb.page_id AND fb.owner = lb.owner)"""


LABELLED = ("y0", "y1", "n_digitish", "n_narrow", "n_square", "med_ch", "staff_score", "role")


def _labelled(spark, sf):
    hot, modes, own = _owned(spark, sf, LABELLED)
    return bd.label_bands(own, modes, hot=hot)


@query("label_bands", f"{ANCHORS}, {MODE}, {OWN}, {LABEL} SELECT page_id, owner, band_idx, role FROM labelled")
def q_f18(spark, sf):
    return _labelled(spark, sf).select("page_id", "owner", "band_idx", "role")


PAGES = "SELECT DISTINCT page_id, 2800 AS height, 10 AS x0, 990 AS x1 FROM {b}"


@query(
    "system_boxes",
    f"""{ANCHORS}, {MODE}, {OWN}, {LABEL},
sy AS (SELECT page_id, owner, bool_or(role = 'lyric') AS ly, count(*) FILTER (role <> 'underline') AS n, max({{'y': y0, 'h': h, 'c': med_ch, 'n': n_narrow}}) FILTER (role = 'pitch') AS p FROM labelled GROUP BY 1, 2),
sm AS (SELECT page_id, median(p.h) AS mh, median(p.c) AS mc FROM sy GROUP BY 1),
ok AS (SELECT sy.page_id, sy.owner FROM sy JOIN sm ON sm.page_id = sy.page_id WHERE p IS NOT NULL AND NOT (p.y < 0.18 * 2800 AND p.c < greatest(18.0, 0.78 * mc) AND p.h < 0.85 * mh AND NOT ly AND n <= 2)
  AND NOT (n = 1 AND p.c < 0.80 * mc AND p.h < 0.80 * mh AND p.y < 0.22 * 2800) AND NOT (p.n < 6 AND p.c < 0.75 * mc AND NOT ly AND p.y < 0.25 * 2800)),
g AS (SELECT l.page_id, l.owner, min(y0) AS a, max(y1) AS z, count(*) FILTER (role = 'pitch') AS np, count(*) FILTER (role = 'chord') AS nc, count(*) FILTER (role = 'lyric') AS nl, max(layout_mode) AS mo
  FROM labelled l JOIN ok ON ok.page_id = l.page_id AND ok.owner = l.owner GROUP BY 1, 2),
pd AS (SELECT *, greatest(4, CAST(trunc(0.12 * (z - a)) AS INT)) AS t0, greatest(6, CAST(trunc(0.18 * (z - a)) AS INT)) AS b0 FROM g)
SELECT page_id, owner, CAST(greatest(0, a - CASE WHEN mo = 'chord_above' THEN greatest(t0, 8) ELSE t0 END) AS DOUBLE) AS y1, CAST(least(2800, z + CASE WHEN mo = 'chord_below' THEN greatest(b0, 10) ELSE b0 END) AS DOUBLE) AS y2,
  np AS n_pitch, nc AS n_chord, nl AS n_lyric FROM pd""",
)
def q_e18(spark, sf):
    lab = written(_labelled(spark, sf))
    pages = spark.sql(PAGES, b=lab).join(lab.select("page_id", "layout_mode").distinct(), "page_id")
    out = bd.system_boxes(bd.drop_weak_systems(lab.drop("layout_mode"), pages), pages)
    return out.select("page_id", "owner", "y1", "y2", "n_pitch", "n_chord", "n_lyric")


@query(
    "role_y_ranges",
    f"""{ANCHORS}, {MODE}, {OWN}, {LABEL} SELECT page_id, owner, """
    + ", ".join(f"min(y0) FILTER (role = '{r}') AS {r}_y0, max(y1) FILTER (role = '{r}') AS {r}_y1" for r in ("pitch", "chord", "lyric", "underline"))
    + " FROM labelled GROUP BY page_id, owner",
)
def q_e19(spark, sf):
    return bd.role_y_ranges(_labelled(spark, sf))


C7 = """t0 AS (SELECT *, greatest(1, y1 - y0) AS h, 2800 AS hh FROM {v:bands}),
tm AS (SELECT page_id, coalesce(median(h) FILTER (staff_score >= 0.45 AND h BETWEEN 14 AND 70), greatest(24.0, 2800 * 0.015)) AS m FROM t0 GROUP BY 1),
t1 AS (SELECT t0.*, m, y0 <= 0.28 * hh AND (h >= greatest(28.0, 1.25 * m) OR (med_ch >= greatest(24.0, 1.1 * m) AND n_comps >= 6) OR (y0 < 0.12 * hh AND n_digitish <= 8 AND staff_score < 0.5 AND h >= greatest(18.0, 0.7 * m))) AS title,
  staff_score >= 0.45 OR (h BETWEEN 16 AND 70 AND n_digitish >= 5 AND abs(h - m) <= 0.55 * m) AS staff FROM t0 JOIN tm ON tm.page_id = t0.page_id),
t2 AS (SELECT *, lead(y0) OVER (PARTITION BY page_id ORDER BY y0, band_idx) AS nx FROM t1 WHERE staff),
t3 AS (SELECT page_id, min(y0) FILTER (NOT (title AND y0 < 0.16 * hh) AND (coalesce(nx - y1 < 4.5 * m, false) OR (y0 >= 0.10 * hh AND NOT title))) AS s1, min(y0) FILTER (y0 >= 0.12 * hh) AS s2, min(y0) AS s3 FROM t2 GROUP BY 1),
t4 AS (SELECT t1.page_id, coalesce(max(s1), max(s2), max(s3), min(y0) FILTER (y0 >= 0.08 * hh AND NOT title), min(y0)) AS sy FROM t1 LEFT JOIN t3 ON t3.page_id = t1.page_id GROUP BY 1),
t5 AS (SELECT t1.*, sy FROM t1 JOIN t4 ON t4.page_id = t1.page_id),
t6 AS (SELECT *, row_number() OVER w AS k, lag(y1) OVER w AS p, first(h) OVER w AS fh FROM t5 WHERE y1 <= sy + 2 AND (title OR y0 < 0.12 * hh) WINDOW w AS (PARTITION BY page_id ORDER BY y0, band_idx)),
t7 AS (SELECT page_id, min(k) FILTER (k > 1 AND NOT (y0 - p <= 28 AND (title OR h >= fh * 0.5))) AS st FROM t6 GROUP BY 1),
t8 AS (SELECT t6.page_id, arg_max(y1, k) AS ty FROM t6 JOIN t7 ON t7.page_id = t6.page_id WHERE st IS NULL OR k < st GROUP BY 1),
t9 AS (SELECT page_id, max(y1) FILTER (y1 > sy AND y0 <= 2800 * 0.96) AS la, max(sy) AS sy FROM t5 GROUP BY 1)"""


@query(
    "page_header",
    f"""WITH {C7} SELECT t9.page_id, CAST(CASE WHEN ty IS NOT NULL THEN least(sy, ty + 16) WHEN sy > 224 THEN greatest(112, least(sy, 504)) ELSE 84 END AS INT) AS title_y1, sy AS score_y0,
  CAST(least(2800, greatest(coalesce(greatest(la, sy + 8), sy + 8) + 4, 2688)) AS INT) AS score_y1 FROM t9 LEFT JOIN t8 ON t8.page_id = t9.page_id""",
)
def q_c7(spark, sf):
    b = view(spark, sf, "bands")
    return bd.page_header(b, spark.sql(PAGES, b=b))


FRAG = "SELECT page_id, x1, y1 / 20 AS y1, x2, y1 / 20 + 18 + CAST(item_idx % 9 AS DOUBLE) AS y2 FROM {i} WHERE layer <> 'L2'"


@query(
    "merge_fragments",
    f"""WITH RECURSIVE f AS ({FRAG.replace('{i}', '{v:items}')}), q AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY x1, y1, x2, y2) AS k FROM f),
w AS (SELECT page_id, k, 0 AS line, x1, y1, x2, y2 FROM q WHERE k = 1
  UNION ALL SELECT page_id, k, CASE WHEN j THEN line ELSE line + 1 END, CASE WHEN j THEN least(x1, a1) ELSE a1 END, CASE WHEN j THEN least(y1, b1) ELSE b1 END, CASE WHEN j THEN greatest(x2, a2) ELSE a2 END, CASE WHEN j THEN greatest(y2, b2) ELSE b2 END FROM (
    SELECT q.page_id, q.k, w.line, w.x1, w.y1, w.x2, w.y2, q.x1 AS a1, q.y1 AS b1, q.x2 AS a2, q.y2 AS b2, abs((w.y1 + w.y2) / 2 - (q.y1 + q.y2) / 2) <= 0.55 * least(w.y2 - w.y1, q.y2 - q.y1)
      AND (least(w.x2, q.x2) - greatest(w.x1, q.x1) > 0.45 * least(w.x2 - w.x1, q.x2 - q.x1) OR q.x1 - w.x2 <= greatest(2.0, 0.12 * least(w.y2 - w.y1, q.y2 - q.y1))) AS j
    FROM w JOIN q ON q.page_id = w.page_id AND q.k = w.k + 1) z)
SELECT page_id, arg_max(x1, k) AS x1, arg_max(y1, k) AS y1, arg_max(x2, k) AS x2, arg_max(y2, k) AS y2 FROM w GROUP BY page_id, line""",
)
def q_g7(spark, sf):
    return bd.merge_fragments(spark.sql(FRAG, i=view(spark, sf, "items")))


GAPS = "SELECT page_id, system_idx, split_idx AS gap_idx, x AS x_left, x + 1 + CAST(split_idx % 13 AS DOUBLE) AS x_right FROM {x}"


@query(
    "soft_gap_lines",
    f"""WITH RECURSIVE g AS ({GAPS.replace('{x}', '{v:gt_xs}')}), r AS (SELECT *, row_number() OVER (PARTITION BY page_id, system_idx ORDER BY x_right - x_left DESC, gap_idx) AS k FROM g),
q AS (SELECT page_id, system_idx, (x_left + x_right) / 2 AS x, row_number() OVER (PARTITION BY page_id, system_idx ORDER BY (x_left + x_right) / 2, gap_idx) AS k FROM r),
w AS (SELECT page_id, system_idx, k, 0 AS line, x FROM q WHERE k = 1 UNION ALL SELECT q.page_id, q.system_idx, q.k, CASE WHEN q.x - w.x >= 36 THEN line + 1 ELSE line END, CASE WHEN q.x - w.x >= 36 THEN q.x ELSE 0.5 * (w.x + q.x) END
  FROM w JOIN q ON q.page_id = w.page_id AND q.system_idx = w.system_idx AND q.k = w.k + 1)
SELECT page_id, system_idx, CAST(line AS INT) AS split_idx, round(arg_max(x, k), 6) AS x FROM w GROUP BY page_id, system_idx, line""",
)
def q_g8(spark, sf):
    out = bd.soft_gap_lines(spark.sql(GAPS, x=view(spark, sf, "gt_xs")), min_gap=60.0)
    return out.select("page_id", "system_idx", "split_idx", *r6("x"))


DRAFT = """SELECT page_id, item_idx, layer, CASE WHEN item_idx % 7 = 0 THEN concat(id, 'u') ELSE id END AS id, label, kind, x1 + CAST(item_idx % 9 AS DOUBLE) AS x1, y1 + 2 AS y1, x2 + CAST(item_idx % 9 AS DOUBLE) AS x2, y2 + 2 AS y2
  FROM {i} WHERE layer <> 'L3' OR item_idx % 5 <> 0"""


@query(
    "merge_rerun_by_id",
    f"""WITH d AS ({DRAFT.replace('{i}', '{v:items}')}), m AS (SELECT page_id, id, arg_max({{'x1': x1, 'y1': y1}}, item_idx) AS b FROM d GROUP BY 1, 2)
SELECT i.page_id, i.item_idx, CASE WHEN layer IN ('L1', 'L2') THEN coalesce(m.b.x1, x1) ELSE x1 END AS x1, CASE WHEN layer IN ('L1', 'L2') THEN coalesce(m.b.y1, y1) ELSE y1 END AS y1 FROM {{v:items}} i LEFT JOIN m ON m.page_id = i.page_id AND m.id = i.id""",
)
def q_d21(spark, sf):
    items = view(spark, sf, "items").drop("confidence")
    return rr.merge_rerun(spark.sql(DRAFT, i=items), items, "L2").select("page_id", "item_idx", "x1", "y1")


@query(
    "merge_rerun_measures",
    f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY measure_id) AS k FROM ({layer_sql('L3', 'measure_id')}) q),
dl AS (SELECT page_id, list({{'i': item_idx, 'x': (x1 + x2) / 2, 'y': (y1 + y2) / 2, 'x1': x1}} ORDER BY item_idx) AS ds FROM ({DRAFT.replace('{i}', '{v:items}')}) d WHERE layer = 'L3' GROUP BY 1),
w AS (SELECT page_id, 0 AS k, ds, CAST(NULL AS BIGINT) AS rid, CAST(NULL AS DOUBLE) AS x1 FROM dl
  UNION ALL SELECT z.page_id, z.k, list_filter(z.ds, lambda q: q.i <> coalesce(z.b.i, -1)), z.rid, coalesce(z.b.x1, z.x1) FROM (
    SELECT r.page_id, r.k, w.ds, r.measure_id AS rid, r.x1, list_min(list_transform(w.ds, lambda q: {{'d': (q.x - r.cx) * (q.x - r.cx) + (q.y - r.cy) * (q.y - r.cy), 'i': q.i, 'x1': q.x1}})) AS b
    FROM w JOIN r ON r.page_id = w.page_id AND r.k = w.k + 1) z)
SELECT page_id, rid AS item_idx, x1 FROM w WHERE k > 0
UNION ALL SELECT page_id, measure_id, x1 FROM r WHERE page_id NOT IN (SELECT page_id FROM dl)
UNION ALL SELECT page_id, q.i, q.x1 FROM (SELECT page_id, unnest(arg_max(ds, k)) AS q FROM w GROUP BY 1) z""",
)
def q_d21m(spark, sf):
    items = view(spark, sf, "items").drop("confidence")
    return rr.merge_rerun(spark.sql(DRAFT, i=items), items, "L3").where("layer = 'L3'").select("page_id", "item_idx", "x1")


OPEN = """SELECT page_id, system_idx, CAST(i AS INT) AS measure_idx, (page_id + system_idx) % 4 <> 0 AS closed, CASE WHEN (page_id + system_idx) % 4 = 0 THEN 'open_trailing' ELSE 'x' END AS segment,
  CASE WHEN (page_id + i) % 3 = 0 THEN 'whole_line' ELSE 'l3_barline' END AS measure_source, CASE WHEN (page_id + i) % 5 = 0 THEN NULL ELSE CAST(30 * i AS DOUBLE) END AS barline_x_left,
  CAST(100 + i AS DOUBLE) AS barline_x_right, CAST(0 AS DOUBLE) AS system_x1, CAST(0.75 AS DOUBLE) AS confidence
  FROM {s} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) k WHERE (i = 0 OR (page_id + system_idx) % 3 <> 0) AND (page_id + system_idx) % 11 <> 5"""


@query(
    "merge_open_measures",
    f"""WITH RECURSIVE o AS ({OPEN.replace('{s}', '{v:systems}')}),
r AS (SELECT page_id, system_idx, count(*) AS n, arg_min({{'i': measure_idx, 'closed': closed, 'src': measure_source, 'bl': barline_x_left, 'x1': system_x1, 'conf': confidence}}, measure_idx) AS f,
  arg_max({{'i': measure_idx, 'closed': closed, 'seg': segment, 'src': measure_source, 'br': barline_x_right}}, measure_idx) AS l FROM o GROUP BY 1, 2),
q AS (SELECT *, row_number() OVER p AS k, lead(system_idx) OVER p AS ns, lead(f) OVER p AS nf FROM r WINDOW p AS (PARTITION BY page_id ORDER BY system_idx)),
c AS (SELECT *, coalesce(ns = system_idx + 1, false)
  AND (NOT l.closed OR l.br IS NULL OR l.seg = 'open_trailing')
  AND (l.seg = 'open_trailing' OR l.src IN ('whole_line', 'fallback_gap') OR NOT (l.br IS NOT NULL AND l.closed))
  AND NOT (NOT (nf.src = 'whole_line' OR nf.bl IS NULL OR abs(nf.bl - nf.x1) < 12) AND nf.src = 'l3_barline' AND nf.bl IS NOT NULL AND nf.closed) AS j FROM q),
w AS (SELECT page_id, system_idx, k, ns, nf, l, j AS t FROM c WHERE k = 1
  UNION ALL SELECT c.page_id, c.system_idx, c.k, c.ns, c.nf, c.l, c.j AND NOT (c.n = 1 AND w.t) FROM w JOIN c ON c.page_id = w.page_id AND c.k = w.k + 1),
m AS (SELECT o.*, t.nf, t.ns FROM o LEFT JOIN (SELECT * FROM w WHERE t) t ON t.page_id = o.page_id AND t.system_idx = o.system_idx AND t.l.i = o.measure_idx
  WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.t AND w.page_id = o.page_id AND w.ns = o.system_idx AND w.nf.i = o.measure_idx))
SELECT page_id, system_idx, CAST(row_number() OVER (PARTITION BY page_id, system_idx ORDER BY measure_idx) - 1 AS INT) AS measure_idx,
  CASE WHEN ns IS NULL THEN closed ELSE coalesce(nf.closed, true) END AS closed, CASE WHEN ns IS NULL THEN measure_source ELSE 'cross_line' END AS measure_source,
  ns IS NOT NULL AS cross_line, ns AS joined_system, CASE WHEN ns IS NULL THEN confidence ELSE least(confidence, nf.conf, 0.55) END AS confidence FROM m""",
)
def q_f12(spark, sf):
    out = rr.merge_open_measures(spark.sql(OPEN, s=view(spark, sf, "systems")))
    return out.select("page_id", "system_idx", "measure_idx", "closed", "measure_source", "cross_line", "joined_system", "confidence")


SLOT_M = "SELECT user_id AS page_id, CAST(day(ts) - 1 AS INT) AS d, count(*) AS n_notes FROM {events} GROUP BY user_id, day(ts)"


@query(
    "layout_slots",
    f"""WITH m0 AS ({SLOT_M.replace('{events}', 'events')}), m AS (SELECT page_id, n_notes, row_number() OVER (PARTITION BY page_id ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY page_id) AS n FROM m0),
p AS (SELECT page_id, count(*) AS r FROM {{v:systems}} GROUP BY 1),
s AS (SELECT m.*, ntile(4) OVER (PARTITION BY m.page_id ORDER BY i) AS q4, r FROM m JOIN p ON p.page_id = m.page_id),
t AS (SELECT *, CASE WHEN i < (n % r) * (n // r + 1) THEN i // (n // r + 1) ELSE n % r + (i - (n % r) * (n // r + 1)) // (n // r) END AS row_no FROM s),
u AS (SELECT *, greatest(4.0, 1000.0 * n_notes / sum(n_notes) OVER (PARTITION BY page_id, row_no)) AS w, max(i) OVER (PARTITION BY page_id, row_no) AS la FROM t),
v AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY page_id, row_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM u)
SELECT page_id, CAST(i AS INT) AS measure_idx, CAST(row_no AS INT) AS row_no, round(x, 5) AS x1, round(CASE WHEN i = la THEN 1000 ELSE x + w END, 5) AS x2 FROM v""",
)
def q_f10(spark, sf):
    from scorelake.plans.skew import ordered

    m = ordered(spark.sql(SLOT_M, events=spark.read.parquet(f"{sf}/events.parquet")), ["page_id"], ["d"], number="_n")
    m = m.select("page_id", (F.col("_n") - 1).alias("measure_idx"), "n_notes")
    rows = ordered(view(spark, sf, "systems"), ["page_id"], ["system_idx"], number="_n").withColumn("row_no", F.col("_n") - 1)
    pages = rows.select("page_id", F.lit(1000).alias("width")).distinct()
    out = rr.layout_slots(m, rows, pages)
    r5 = [F.round(c, 5).alias(c) for c in ("x1", "x2")]
    return out.select("page_id", "measure_idx", "row_no", *r5)


SHAPE_BANDS = "SELECT DISTINCT page_id, CAST(page_id % 700 AS DOUBLE) AS pitch_y0, CAST(page_id % 700 + 300 AS DOUBLE) AS pitch_y1 FROM {i}"


@query(
    "note_shapes",
    f"""WITH b AS ({SHAPE_BANDS.replace('{i}', '{v:items}')})
SELECT i.page_id, item_idx FROM {{v:items}} i JOIN b ON b.page_id = i.page_id
WHERE x2 - x1 >= 4 AND y2 - y1 >= 6 AND abs((y1 + y2) / 2 - (pitch_y0 + pitch_y1) * 0.5) <= greatest(pitch_y1 - pitch_y0, 1) * 0.55""",
)
def q_c9(spark, sf):
    items = view(spark, sf, "items")
    return bd.note_shapes(items, spark.sql(SHAPE_BANDS, i=items), ["page_id"]).select("page_id", "item_idx")
