"""Queries of the score family."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.adapters import view
from scorelake.catalog.base import big, query, r6
from scorelake.functions import rhythm
from scorelake.operators import problems as pr
from scorelake.operators import reports as rp
from scorelake.operators import scores as sc
from scorelake.plans.skew import dealt

BEATS = (
    "(CASE duration WHEN 'whole' THEN 4.0 WHEN 'half' THEN 2.0 WHEN 'quarter' THEN 1.0 WHEN 'eighth' THEN 0.5 WHEN 'sixteenth' THEN 0.25 "
    "WHEN 'thirty_second' THEN 0.125 ELSE 1.0 END * CASE WHEN dots >= 2 THEN 1.75 WHEN dots = 1 THEN 1.5 ELSE 1.0 END)::DOUBLE"
)
CAP = "(CASE time_signature WHEN '4/4' THEN 4.0 WHEN '3/4' THEN 3.0 ELSE 3.0 END)::DOUBLE"


def _v(spark, sf, *names):
    return [view(spark, sf, n) for n in names]


@query(
    "assign_ties",
    """WITH a AS (SELECT *, sustain_dashes > 0 AND lead(pitch IS NOT NULL OR is_rest) OVER w IS NOT DISTINCT FROM true AS st FROM {v:score_notes}
  WINDOW w AS (PARTITION BY score_id, measure_no ORDER BY note_idx)),
b AS (SELECT *, lag(st) OVER (PARTITION BY score_id, measure_no ORDER BY note_idx) AS pv FROM a)
SELECT score_id, measure_no, note_idx, CASE WHEN st THEN 'start' WHEN pv THEN 'stop' END AS tie FROM b""",
)
def q_ties(spark, sf):
    return sc.assign_ties(view(spark, sf, "score_notes")).select("score_id", "measure_no", "note_idx", "tie")


METER = f"""t AS (SELECT score_id, measure_no, sum({BEATS}) AS b, count(*) AS n FROM {{v:score_notes}} GROUP BY 1, 2),
mc AS (SELECT m.score_id, m.measure_no, m.source, {CAP} AS capacity, coalesce(t.b, 0) AS b, coalesce(t.n, 0) AS n FROM {{v:score_measures}} m
  JOIN {{v:scores}} s ON s.score_id = m.score_id LEFT JOIN t ON t.score_id = m.score_id AND t.measure_no = m.measure_no),
checked AS (SELECT *, CASE WHEN b > capacity + 0.35 THEN 'over' WHEN b < capacity - 0.35 AND n > 0 THEN 'under' ELSE 'ok' END AS status FROM mc)"""


@query(
    "meter_check",
    f"WITH {METER} SELECT score_id, measure_no, capacity, round(b, 3) AS beats, CAST(n AS BIGINT) AS n_notes, status FROM checked"
    .replace("JOIN {v:scores} s", "LEFT JOIN (SELECT * FROM {v:scores} WHERE score_id % 23 <> 0) s")
    .replace(f"{CAP} AS capacity", f"CAST(CASE WHEN s.score_id IS NULL THEN 4 ELSE {CAP} END AS DOUBLE) AS capacity"),
)
def q_meter(spark, sf):
    m, n, s = _v(spark, sf, "score_measures", "score_notes", "scores")
    s = s.where("score_id % 23 <> 0")  # scores without a meter row
    return sc.meter_check(m, n, s).select("score_id", "measure_no", "capacity", "beats", *big("n_notes"), "status")


@query(
    "soft_fit",
    f"""WITH n AS (SELECT n.*, {CAP} AS cap, {BEATS} AS b, dots = 0 AND duration_from IN ('default', 'underline', 'meter_fit') AS plain
  FROM {{v:score_notes}} n JOIN {{v:scores}} s ON s.score_id = n.score_id),
t AS (SELECT score_id, measure_no, sum(b) AS t0, sum(CASE WHEN plain AND duration = 'quarter' THEN 0.5 ELSE b END) AS t1 FROM n GROUP BY 1, 2),
o AS (SELECT n.score_id, n.measure_no, n.note_idx, n.duration AS was, n.duration_from AS src, CASE WHEN t0 > cap + 0.35 AND t1 > cap + 0.35 AND plain AND duration IN ('quarter', 'eighth') THEN 'sixteenth'
  WHEN t0 > cap + 0.35 AND plain AND duration = 'quarter' THEN 'eighth' ELSE duration END AS duration FROM n JOIN t ON t.score_id = n.score_id AND t.measure_no = n.measure_no)
SELECT score_id, measure_no, note_idx, duration, CASE WHEN duration <> was THEN 'meter_fit' ELSE src END AS duration_from FROM o""",
)
def q_soft_fit(spark, sf):
    n, s = _v(spark, sf, "score_notes", "scores")
    return sc.soft_fit(n, s).select("score_id", "measure_no", "note_idx", "duration", "duration_from")


TONIC = "(CASE key WHEN 'G' THEN 67 WHEN 'Bb' THEN 70 WHEN '1=F#' THEN 66 ELSE 60 END)"
DEGREE = "(CASE pitch WHEN '1' THEN 0 WHEN '2' THEN 2 WHEN '3' THEN 4 WHEN '4' THEN 5 WHEN '5' THEN 7 WHEN '6' THEN 9 ELSE 11 END)"


@query(
    "melody_timeline",
    f"""WITH n AS (SELECT n.*, {BEATS} AS b, greatest(80.0, {BEATS} * 60000.0 / coalesce(s.tempo_bpm, 80)) AS ms, s.key FROM {{v:score_notes}} n JOIN {{v:scores}} s ON s.score_id = n.score_id),
t AS (SELECT *, coalesce(sum(b) OVER w, 0) AS ob, coalesce(sum(ms) OVER w, 0) AS om FROM n
  WINDOW w AS (PARTITION BY score_id ORDER BY measure_no, note_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, CASE WHEN pitch IS NOT NULL THEN greatest(0, least(127, {TONIC} + {DEGREE} + octave * 12
  + CASE accidental WHEN 'sharp' THEN 1 WHEN 'flat' THEN -1 ELSE 0 END)) END AS midi FROM t)
SELECT score_id, measure_no, note_idx, round(ob, 6) AS onset_beat, round(om, 4) AS onset_ms, round(ms, 4) AS duration_ms, CAST(midi AS INT) AS midi,
  round(440 * power(2, (midi - 69) / 12.0), 4) AS hz FROM m""",
)
def q_timeline(spark, sf):
    n, s = _v(spark, sf, "score_notes", "scores")
    out = sc.melody_timeline(n, s)
    r4 = [F.round(c, 4).alias(c) for c in ("onset_ms", "duration_ms", "hz")]
    return out.select("score_id", "measure_no", "note_idx", *r6("onset_beat"), *r4, F.col("midi").cast("int").alias("midi"))


def pack_sql(src: str, keys: str, order: str) -> str:
    on = " AND ".join(f"r.{k.strip()} = w.{k.strip()}" for k in keys.split(","))
    rk = ", ".join(f"r.{k.strip()}" for k in keys.split(","))
    bar = "CASE WHEN w.acc > 0 AND w.acc + r.b > r.cap + 1e-6 THEN w.nxt + 1 ELSE w.nxt END"
    acc = "CASE WHEN w.acc > 0 AND w.acc + r.b > r.cap + 1e-6 THEN r.b ELSE w.acc + r.b END"
    return f"""q AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS k FROM ({src}) z),
walk AS (
  SELECT {keys}, k, note_idx, 1 AS bar_no, CASE WHEN b >= cap - 1e-6 THEN 2 ELSE 1 END AS nxt, CASE WHEN b >= cap - 1e-6 THEN 0 ELSE b END AS acc FROM q WHERE k = 1
  UNION ALL
  SELECT {rk}, r.k, r.note_idx, {bar}, CASE WHEN {acc} >= r.cap - 1e-6 THEN {bar} + 1 ELSE {bar} END, CASE WHEN {acc} >= r.cap - 1e-6 THEN 0 ELSE {acc} END
  FROM walk w JOIN q r ON {on} AND r.k = w.k + 1)"""


PACK_SRC = f"SELECT n.score_id, n.measure_no, n.note_idx, {BEATS} AS b, {CAP} AS cap FROM {{v:score_notes}} n JOIN {{v:scores}} s ON s.score_id = n.score_id"


def _with_capacity(spark, sf):
    n, s = _v(spark, sf, "score_notes", "scores")
    n = dealt(n, ["score_id"], n.count())
    return n.join(s.select("score_id", rhythm.meter_capacity(F.col("time_signature")).alias("capacity")), "score_id")


@query(
    "pack_by_meter",
    "WITH RECURSIVE " + pack_sql(PACK_SRC, "score_id", "measure_no, note_idx") + " SELECT score_id, note_idx, CAST(bar_no AS INT) AS bar_no FROM walk",
)
def q_pack(spark, sf):
    return sc.pack_by_meter(_with_capacity(spark, sf)).select("score_id", "note_idx", "bar_no")


@query(
    "rebalance",
    f"""WITH RECURSIVE src AS ({PACK_SRC}), t AS (SELECT score_id, measure_no, sum(b) > max(cap) + 0.35 AND count(*) > 1 AS over FROM src GROUP BY 1, 2),
"""
    + pack_sql("SELECT src.* FROM src JOIN t ON t.score_id = src.score_id AND t.measure_no = src.measure_no WHERE over", "score_id, measure_no", "note_idx")
    + """,
p AS (SELECT score_id, measure_no, note_idx, bar_no FROM walk UNION ALL SELECT src.score_id, src.measure_no, note_idx, 1 FROM src JOIN t ON t.score_id = src.score_id AND t.measure_no = src.measure_no WHERE NOT over)
SELECT score_id, measure_no, note_idx, CAST(dense_rank() OVER (PARTITION BY score_id ORDER BY measure_no, bar_no) AS INT) AS new_measure_no FROM p""",
)
def q_rebalance(spark, sf):
    return sc.rebalance(_with_capacity(spark, sf)).select("score_id", "measure_no", "note_idx", "new_measure_no")


SYL = """SELECT o_orderkey AS score_id, CAST(i AS BIGINT) AS syl_idx, concat('syl', CAST(i AS VARCHAR(4))) AS text
  FROM {orders} CROSS JOIN (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) x WHERE o_custkey % 4 + 1 >= i"""
SYLQ = f"""WITH y AS ({SYL.replace('{orders}', 'orders')}),
a AS (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY measure_no, note_idx) AS n FROM {{v:score_notes}} WHERE NOT is_rest),
w AS (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY syl_idx) AS n FROM y)
"""


def _syllables(spark, sf):
    return spark.sql(SYL, orders=spark.read.parquet(f"{sf}/orders.parquet"))


@query(
    "align_lyrics",
    SYLQ + """SELECT a.score_id, a.note_idx, w.text AS lyric FROM a LEFT JOIN w ON w.score_id = a.score_id AND w.n = a.n
UNION ALL SELECT score_id, note_idx, NULL FROM {v:score_notes} WHERE is_rest""",
)
def q_lyrics(spark, sf):
    return sc.align_lyrics(view(spark, sf, "score_notes"), _syllables(spark, sf))[0].select("score_id", "note_idx", "lyric")


@query(
    "lyric_leftovers",
    SYLQ + "SELECT w.score_id, w.syl_idx, w.text FROM w WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.score_id = w.score_id AND a.n = w.n)",
)
def q_leftovers(spark, sf):
    return sc.align_lyrics(view(spark, sf, "score_notes"), _syllables(spark, sf))[1].select("score_id", "syl_idx", "text")


NOTE_EDITS = """SELECT score_id, measure_no, CASE WHEN note_idx % 6 = 2 THEN note_idx + 1 ELSE note_idx END AS note_idx, note_idx AS edit_idx,
  CASE note_idx % 6 WHEN 0 THEN 'patch' WHEN 1 THEN 'patch' WHEN 2 THEN CASE WHEN note_idx % 5 = 0 THEN 'measure' ELSE 'append' END ELSE 'remove' END AS op,
  CASE WHEN note_idx % 6 = 0 AND note_idx % 4 = 0 THEN '6' END AS pitch,
  CASE WHEN note_idx % 6 = 1 THEN true WHEN note_idx % 6 = 0 THEN false END AS is_rest,
  CASE WHEN note_idx % 5 = 0 THEN 'half' END AS duration, CAST(NULL AS INT) AS octave FROM {n} WHERE note_idx % 6 < 4"""


@query(
    "apply_note_edits",
    f"""WITH e AS ({NOTE_EDITS.replace('{n}', '{v:score_notes}')}),
g AS (SELECT n.score_id, n.measure_no, count(*) FILTER (e.score_id IS NULL) AS keep, min(n.note_idx) AS first FROM {{v:score_notes}} n
  LEFT JOIN e ON e.score_id = n.score_id AND e.measure_no = n.measure_no AND e.note_idx = n.note_idx AND e.op = 'remove' GROUP BY 1, 2),
k AS (SELECT n.* FROM {{v:score_notes}} n JOIN g ON g.score_id = n.score_id AND g.measure_no = n.measure_no
  WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.score_id = n.score_id AND e.measure_no = n.measure_no AND e.note_idx = n.note_idx AND e.op = 'remove' AND (g.keep > 0 OR n.note_idx <> g.first)))
SELECT score_id, measure_no, CAST(row_number() OVER (PARTITION BY score_id, measure_no ORDER BY fresh, note_idx) - 1 AS BIGINT) AS note_idx, pitch, is_rest, duration FROM (
SELECT k.score_id, k.measure_no, k.note_idx, 0 AS fresh, CASE WHEN p.is_rest THEN NULL WHEN NOT p.is_rest THEN coalesce(p.pitch, k.pitch, '1') ELSE coalesce(p.pitch, k.pitch) END AS pitch,
  coalesce(p.is_rest, k.is_rest) AS is_rest, coalesce(p.duration, k.duration) AS duration FROM k
  LEFT JOIN e p ON p.op = 'patch' AND p.score_id = k.score_id AND p.measure_no = k.measure_no AND p.note_idx = k.note_idx
UNION ALL SELECT score_id, measure_no, edit_idx, 1, coalesce(pitch, '1'), false, coalesce(duration, 'quarter') FROM e WHERE op = 'append'
UNION ALL SELECT e.score_id, m + CAST(row_number() OVER (PARTITION BY e.score_id ORDER BY edit_idx) AS INT), edit_idx, 1, coalesce(pitch, '1'), false, coalesce(duration, 'quarter')
  FROM e JOIN (SELECT score_id, max(measure_no) AS m FROM {{v:score_notes}} GROUP BY 1) x ON x.score_id = e.score_id WHERE op = 'measure') q""",
)
def q_note_edits(spark, sf):
    n = view(spark, sf, "score_notes")
    return sc.apply_note_edits(n, spark.sql(NOTE_EDITS, n=n)).select(
        "score_id", "measure_no", "note_idx", "pitch", "is_rest", "duration"
    )


BASE_M = "SELECT DISTINCT score_id, measure_no, concat('b', CAST(measure_no AS VARCHAR(4))) AS tag FROM {m}"
PATCH_M = "SELECT o_orderkey AS score_id, CAST(i AS INT) AS measure_no, concat('p', CAST(i AS VARCHAR(4))) AS tag FROM {orders} CROSS JOIN (SELECT 1 AS i UNION ALL SELECT 2) x WHERE o_orderkey % 3 <> 0 AND (i = 1 OR o_orderkey % 2 = 0)"
CROPS = """SELECT o_orderkey AS score_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 3 AS INT) END AS measure_from,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 3 + o_custkey % 2 AS INT) END AS measure_to,
  CAST(o_custkey % 500 AS DOUBLE) AS x1, CAST(o_custkey % 300 AS DOUBLE) AS y1, CAST(o_custkey % 500 + 20 + o_custkey % 450 AS DOUBLE) AS x2,
  CAST(o_custkey % 300 + 30 + o_custkey % 600 AS DOUBLE) AS y2, 1000 AS image_width, 1000 AS image_height FROM {orders}"""


@query(
    "splice_measures",
    f"""WITH b0 AS ({BASE_M.replace('{m}', '{v:score_measures}')}), p0 AS ({PATCH_M.replace('{orders}', 'orders')}), c0 AS ({CROPS.replace('{orders}', 'orders')}),
n AS (SELECT score_id, count(*) AS np FROM p0 GROUP BY 1),
c AS (SELECT c0.*, 3 AS nb, np, (x2-x1)*(y2-y1)/1e6 AS ar, (x2-x1)/1000 AS wf, (y2-y1)/1000 AS hf FROM c0 JOIN n ON n.score_id = c0.score_id),
-- three measures on a square page: two per line, two lines
f AS (SELECT *, least(2, CAST(floor(least(0.9999, (y1 + 0.5)/1000) * 2) * 2 + floor(least(0.9999, (x1 + 0.5)/1000) * 2) AS INT)) AS s0,
  least(2, CAST(floor(least(0.9999, (y2 - 0.5)/1000) * 2) * 2 + floor(least(0.9999, (x2 - 0.5)/1000) * 2) AS INT)) AS l0,
  least(2, CAST(floor(least(0.9999, (y1 + y2)/2000) * 2) * 2 + floor(least(0.9999, (x1 + x2)/2000) * 2) AS INT)) AS m0 FROM c),
g AS (SELECT *, least(3, greatest(s0 + 1, l0 + 1)) AS e0 FROM f),
h AS (SELECT *, ar >= 0.4 OR (wf >= 0.65 AND hf >= 0.4) OR (wf >= 0.85 AND hf >= 0.28) OR e0 - s0 >= 3 OR (ar >= 0.28 AND e0 - s0 >= 2) AS whole FROM g),
i AS (SELECT score_id, np, CASE WHEN measure_from IS NOT NULL THEN least(measure_from - 1, 3) WHEN whole THEN 0 WHEN wf < 0.22 AND hf < 0.22 THEN m0 ELSE s0 END AS s,
  CASE WHEN measure_from IS NOT NULL THEN least(measure_to, 3) WHEN whole THEN 3 WHEN wf < 0.22 AND hf < 0.22 THEN least(3, m0 + 1) ELSE e0 END AS e FROM h)
SELECT b0.score_id, CAST(CASE WHEN i.s IS NULL OR measure_no <= i.s THEN measure_no ELSE measure_no + np - (e - s) END AS INT) AS measure_no, tag, false AS from_crop FROM b0
  LEFT JOIN i ON i.score_id = b0.score_id WHERE i.s IS NULL OR measure_no <= i.s OR measure_no > i.e
UNION ALL SELECT p0.score_id, CAST(s + measure_no AS INT), tag, true FROM p0 JOIN i ON i.score_id = p0.score_id""",
)
def q_splice(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    base = spark.sql(BASE_M, m=view(spark, sf, "score_measures"))
    out = sc.splice_measures(base, spark.sql(PATCH_M, orders=orders), spark.sql(CROPS, orders=orders))
    return out.select("score_id", "measure_no", "tag", "from_crop")


REG = """SELECT o_orderkey AS score_id, CAST(i AS INT) AS item_idx, CASE i % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'lyrics' ELSE 'pitch' END AS kind,
  concat(o_orderpriority, ' ', CAST(i AS VARCHAR(4))) AS text FROM {orders} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) x WHERE o_custkey % 3 = 0"""
WARN = """SELECT o_orderkey AS score_id, CAST(i AS INT) AS warn_idx, CASE i % 4 WHEN 0 THEN 'L2 fallback to page' WHEN 1 THEN 'L5 meter check failed' WHEN 2 THEN 'all fine'
  ELSE 'L3 Failed' END AS text FROM {orders} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 7 UNION ALL SELECT 8
  UNION ALL SELECT 11 UNION ALL SELECT 12 UNION ALL SELECT 15 UNION ALL SELECT 16) x WHERE o_custkey % 5 = 0"""
J1_SQL = f"""WITH {METER}, reg AS ({REG.replace('{orders}', 'orders')}), wrn AS ({WARN.replace('{orders}', 'orders')}),
nn AS (SELECT n.*, coalesce(confidence, ocr_score) AS conf FROM {{v:score_notes}} n),
allp AS (
  SELECT score_id, 1 AS stage, measure_no AS measure, 0 AS early, 0 AS spot, 0 AS rule, CASE status WHEN 'over' THEN 'meter_over' ELSE 'meter_under' END AS kind,
    CASE status WHEN 'over' THEN 'error' ELSE 'warning' END AS severity, NULL::BIGINT AS note_index, NULL::DOUBLE AS confidence FROM checked WHERE status <> 'ok'
  UNION ALL SELECT score_id, 1, measure_no, 0, 0, 1, 'empty_measure', 'warning', NULL, NULL FROM checked WHERE n = 0
  UNION ALL SELECT score_id, 1, measure_no, 1, note_idx, 2, 'geometry_pitch', 'info', note_idx, coalesce(conf, 0.62) FROM nn WHERE pitch_from = 'geometry'
  UNION ALL SELECT score_id, 1, measure_no, 1, note_idx, 3, 'low_confidence', 'warning', note_idx, conf FROM nn WHERE conf < 0.55 AND NOT is_rest
  UNION ALL SELECT score_id, 2, NULL, 1, item_idx, 0, 'layout_pollution', 'info', NULL, NULL FROM reg WHERE kind IN ('title', 'lyrics')
  UNION ALL SELECT score_id, 3, NULL, 1, warn_idx, 0, 'other', 'info', NULL, NULL FROM (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY warn_idx) AS k FROM wrn) w
    WHERE warn_idx % 4 IN (0, 3)),
problems AS (SELECT score_id, CAST(row_number() OVER (PARTITION BY score_id ORDER BY stage, coalesce(measure, 0), early, spot, rule) AS INT) AS seq, kind, severity,
  CAST(measure AS BIGINT) AS measure, note_index, confidence FROM allp)
"""


def _problems(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    m, n, s = _v(spark, sf, "score_measures", "score_notes", "scores")
    checked = sc.meter_check(m, n, s)
    notes = n.withColumn("note_source", F.lit("recognize"))
    return pr.collect_problems(s, checked, notes, spark.sql(REG, orders=orders), spark.sql(WARN, orders=orders))


@query("collect_problems", J1_SQL + "SELECT score_id, seq, kind, severity, measure, note_index, confidence FROM problems")
def q_problems(spark, sf):
    return _problems(spark, sf).select("score_id", "seq", "kind", "severity", "measure", "note_index", "confidence")


@query(
    "problem_summary",
    J1_SQL + """SELECT score_id, count(*) AS n_problems, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds,
  count(DISTINCT measure) FILTER (measure >= 1) AS n_measures FROM problems GROUP BY score_id""",
)
def q_problem_summary(spark, sf):
    out = rp.problem_summary(_problems(spark, sf))
    return out.withColumn("kinds", F.array_join("kinds", ","))


@query(
    "validate_scores",
    """WITH s AS (SELECT score_id, key, CASE WHEN score_id % 3 = 0 THEN '4-4' ELSE time_signature END AS ts FROM {v:scores}),
n AS (SELECT score_id, measure_no, note_idx, CASE WHEN note_idx % 5 = 0 THEN '9' WHEN note_idx % 7 = 0 THEN NULL ELSE pitch END AS pitch, is_rest, octave * 2 AS octave FROM {v:score_notes}),
p AS (SELECT *, concat('measures[', measure_no, '].notes[', note_idx, ']') AS path FROM n)
SELECT score_id, 'score' AS path, 'error' AS level, 'key_missing' AS rule FROM s WHERE coalesce(key, '') = ''
UNION ALL SELECT score_id, 'score', 'error', 'time_signature' FROM s WHERE ts = '4-4'
UNION ALL SELECT score_id, path, 'error', 'rest_with_pitch' FROM p WHERE is_rest AND pitch IS NOT NULL
UNION ALL SELECT score_id, path, 'error', 'pitch_missing' FROM p WHERE NOT is_rest AND pitch IS NULL
UNION ALL SELECT score_id, path, 'error', 'pitch_domain' FROM p WHERE pitch = '9'
UNION ALL SELECT score_id, path, 'error', 'octave_domain' FROM p WHERE octave NOT BETWEEN -3 AND 3""",
)
def q_validate_scores(spark, sf):
    m, n, s = _v(spark, sf, "score_measures", "score_notes", "scores")
    s = s.withColumns(
        {"schema_version": F.lit("0.1"), "time_signature": F.when(F.col("score_id") % 3 == 0, "4-4").otherwise(F.col("time_signature"))}
    )
    n = n.withColumns(
        {
            "pitch": F.when(F.col("note_idx") % 5 == 0, "9").when(F.col("note_idx") % 7 == 0, F.lit(None)).otherwise(F.col("pitch")),
            "octave": F.col("octave") * 2,
        }
    )
    return pr.validate_scores(s, m, n)


@query(
    "pitch_tokens",
    """SELECT score_id, note_idx, concat(pitch, CASE accidental WHEN 'sharp' THEN '#' WHEN 'flat' THEN 'b' ELSE '' END) AS token
FROM {v:score_notes} WHERE NOT is_rest AND pitch IS NOT NULL""",
)
def q_tokens(spark, sf):
    return sc.pitch_tokens(view(spark, sf, "score_notes")).select("score_id", "note_idx", "token")


@query(
    "assemble_scores",
    """WITH m AS (SELECT * FROM {v:score_measures} WHERE score_id % 9 <> 0), n AS (
  SELECT *, row_number() OVER (PARTITION BY score_id, measure_no ORDER BY note_idx) - 1 AS i FROM {v:score_notes} WHERE is_rest OR pitch IN ('1','2','3','4','5','6','7'))
SELECT m.score_id, m.measure_no, CAST(n.i AS INT) AS note_idx, n.pitch, n.is_rest, n.duration, 'structure_l3' AS source FROM m LEFT JOIN n ON n.score_id = m.score_id AND n.measure_no = m.measure_no
UNION ALL SELECT score_id, 1, 0, '1', false, 'quarter', 'structure_empty_placeholder' FROM {v:scores} WHERE score_id % 9 = 0""",
)
def q_assemble(spark, sf):
    m, n, s = _v(spark, sf, "score_measures", "score_notes", "scores")
    as_page = lambda df: df.withColumnsRenamed({"score_id": "page_id", "measure_no": "global_no"})
    m = as_page(m.where("score_id % 9 <> 0")).withColumns(
        {"system_idx": F.lit(0), "measure_idx": F.col("global_no"), "measure_source": F.lit("l3_split")}
    )
    out = sc.assemble_scores(as_page(s), m, as_page(n).withColumn("kind", F.lit("pitch")))
    return out.select("score_id", "measure_no", "note_idx", "pitch", "is_rest", "duration", "source")


ARBITRATE = """SELECT score_id, note_idx, CASE note_idx % 10 WHEN 0 THEN concat(coalesce(pitch, ''), '.') WHEN 1 THEN '0' WHEN 2 THEN concat('主 ', coalesce(pitch, '')) WHEN 3 THEN '' WHEN 4 THEN concat(coalesce(pitch, ''), coalesce(pitch, ''), 'x12')
  WHEN 5 THEN NULL WHEN 6 THEN '〇' WHEN 7 THEN concat(coalesce(pitch, ''), ' 2') WHEN 8 THEN concat('x', coalesce(pitch, '')) ELSE pitch END AS ocr_text,
  CASE WHEN note_idx % 7 = 0 THEN NULL ELSE ocr_score END AS ocr_score, CASE WHEN note_idx % 3 = 0 THEN NULL ELSE CAST(1 + note_idx % 7 AS VARCHAR(4)) END AS geom_pitch,
  CAST(note_idx % 4 AS INT) AS underlines, dots, octave, sustain_dashes FROM {n}"""


@query(
    "arbitrate_pitch",
    f"""WITH n AS (SELECT *, coalesce(trim(ocr_text), '') AS t FROM ({ARBITRATE.replace('{n}', '{v:score_notes}')}) q),
k AS (SELECT *, regexp_extract(t, '(^|\\s)([1-70〇零])(\\s|$)', 2) AS tok, regexp_extract(t, '[1-7]') AS inn FROM n),
d AS (SELECT *, CASE WHEN tok BETWEEN '1' AND '7' THEN tok WHEN tok = '' AND length(t) <= 4 AND inn <> '' THEN inn END AS dig,
  tok IN ('0', '〇', '零') OR (tok = '' AND contains(t, '0') AND inn = '') AS rst, regexp_matches(t, '^[1-70][._·• -]{{0,2}}$') AS cln FROM k),
f AS (SELECT *, CASE WHEN cln AND dig IS NOT NULL AND (ocr_score IS NULL OR ocr_score >= 0.45) THEN
    CASE WHEN geom_pitch IS NOT NULL AND geom_pitch <> dig AND coalesce(ocr_score < 0.72, false) THEN 'geometry' ELSE 'ocr' END
  WHEN geom_pitch IS NOT NULL THEN 'geometry' WHEN dig IS NOT NULL THEN 'ocr' WHEN rst THEN 'rest' ELSE 'none' END AS src FROM d)
SELECT score_id, note_idx, CASE src WHEN 'geometry' THEN geom_pitch WHEN 'ocr' THEN dig END AS pitch, src = 'rest' AS is_rest, CASE src WHEN 'rest' THEN 'ocr' ELSE src END AS pitch_from,
  CASE WHEN src = 'geometry' AND coalesce(ocr_text, '') = '' THEN concat('geom:', geom_pitch) ELSE ocr_text END AS ocr_text,
  round(CAST(least(0.95, CASE WHEN src = 'none' THEN 0.35 WHEN coalesce(ocr_score, 0) <> 0 THEN least(0.92, greatest(CASE WHEN src IN ('ocr', 'rest') THEN 0.78 ELSE 0.55 END, ocr_score))
    WHEN src IN ('ocr', 'rest') THEN 0.78 ELSE 0.55 END + 0.04 * underlines + 0.03 * dots + 0.03 * abs(octave) + 0.02 * sustain_dashes) AS DOUBLE), 6) AS confidence FROM f""",
)
def q_arbitrate(spark, sf):
    out = sc.arbitrate_pitch(spark.sql(ARBITRATE, n=view(spark, sf, "score_notes")))
    return out.select("score_id", "note_idx", "pitch", "is_rest", "pitch_from", "ocr_text", *r6("confidence"))


META_PATCH = "SELECT score_id, CASE WHEN score_id % 3 = 0 THEN '' ELSE 'D' END AS key, '2/4' AS time_signature, CAST(score_id % 90 AS DOUBLE) AS tempo_bpm FROM {s} WHERE score_id % 4 <> 0"


@query(
    "merge_score_meta",
    f"""WITH p AS ({META_PATCH.replace('{s}', '{v:scores}')})
SELECT s.score_id, coalesce(nullif(s.key, ''), p.key, s.key) AS key, coalesce(nullif(s.time_signature, ''), p.time_signature) AS time_signature, coalesce(s.tempo_bpm, p.tempo_bpm) AS tempo_bpm
FROM {{v:scores}} s LEFT JOIN p ON p.score_id = s.score_id""",
)
def q_score_meta(spark, sf):
    s = view(spark, sf, "scores")
    return sc.merge_score_meta(s, spark.sql(META_PATCH, s=s)).select("score_id", "key", "time_signature", "tempo_bpm")
