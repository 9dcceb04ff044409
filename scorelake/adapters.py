"""Driver tables seen as domain tables.

Each view is one SQL text that both Spark and DuckDB accept; only integer
arithmetic and columns of the given tables are used, so a view is the same table
on both sides. ``{name}`` stands for a driver table, ``{v:name}`` for a view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_YMD = "(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate))"
_IDX = f"((CAST(l_linenumber AS BIGINT) * 300000000 + l_partkey) * 100000000 + {_YMD})"


def _box(x1: str, y1: str, w: str, h: str) -> str:
    return (
        f"CAST({x1} AS DOUBLE) AS x1, CAST({y1} AS DOUBLE) AS y1, "
        f"CAST({x1} + {w} AS DOUBLE) AS x2, CAST({y1} + {h} AS DOUBLE) AS y2"
    )


_QTY = "CAST(floor(l_quantity) AS BIGINT)"
_GX, _GY = "(l_partkey % 6) * 8", "(l_linenumber % 3) * 12"

VIEWS = {
    # truth and predicted boxes: sample = order, two layers, crowded on purpose
    "gt_boxes": f"""
SELECT l_orderkey AS sample_id, concat('L', CAST(l_suppkey % 2 + 1 AS VARCHAR(4))) AS layer,
       {_IDX} AS box_idx, l_returnflag AS kind, {_box(_GX, _GY, f'10 + {_QTY}', '16')}
FROM {{lineitem}}""",
    "pred_boxes": f"""
SELECT l_orderkey AS sample_id, concat('L', CAST(l_suppkey % 2 + 1 AS VARCHAR(4))) AS layer,
       {_IDX} AS box_idx, CASE WHEN l_partkey % 13 = 0 THEN 'X' ELSE l_returnflag END AS kind,
       {_box(f'{_GX} + (l_partkey % 17) - 8', f'{_GY} + (l_linenumber % 5) * 2 - 4', f'10 + {_QTY}', '16')}
FROM {{lineitem}} WHERE (l_partkey + l_linenumber) % 9 <> 0
UNION ALL
SELECT l_orderkey, concat('L', CAST(l_suppkey % 2 + 1 AS VARCHAR(4))), {_IDX} + 50000000, l_returnflag,
       {_box('500 + l_partkey % 50', _GY, '20', '16')}
FROM {{lineitem}} WHERE (l_partkey + l_linenumber) % 11 = 0""",
    # rows of a page and the vertical line positions in them
    "systems": """
SELECT DISTINCT user_id AS page_id, CAST(day(ts) % 4 AS INT) AS system_idx,
       CAST(0 AS DOUBLE) AS x1, CAST((day(ts) % 4) * 100 AS DOUBLE) AS y1,
       CAST(1000 AS DOUBLE) AS x2, CAST((day(ts) % 4) * 100 + 60 AS DOUBLE) AS y2
FROM {events}""",
    "gt_xs": """
SELECT user_id AS page_id, CAST(day(ts) % 4 AS INT) AS system_idx, event_id AS split_idx,
       CAST((event_id * 37) % 1000 AS DOUBLE) AS x,
       CASE WHEN event_id % 10 = 0 THEN 'user' ELSE event_type END AS source,
       CAST(event_id % 8 AS DOUBLE) / 8 AS confidence
FROM {events}""",
    "pred_xs": """
SELECT user_id AS page_id, CAST(day(ts) % 4 AS INT) AS system_idx, event_id AS split_idx,
       CAST((event_id * 37) % 1000 + (event_id % 7) - 3 AS DOUBLE) AS x
FROM {events} WHERE event_id % 9 <> 0""",
    # token sequences per sample
    "gt_tokens": """
SELECT user_id AS sample_id, event_id AS pos, event_type AS token FROM {events}""",
    "pred_tokens": """
SELECT user_id AS sample_id, event_id AS pos, CASE WHEN event_id % 7 = 0 THEN 'view' ELSE event_type END AS token
FROM {events} WHERE event_id % 9 <> 0""",
    # notes of a score; order of notes = note_idx
    "score_notes": f"""
SELECT l_orderkey AS score_id, CAST(1 + l_linenumber % 3 AS INT) AS measure_no, {_IDX} AS note_idx,
       CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE CAST(l_linenumber AS VARCHAR(4)) END AS pitch,
       CASE WHEN l_partkey % 7 = 0 THEN 'sharp' WHEN l_partkey % 11 = 0 THEN 'flat' END AS accidental,
       CAST(l_suppkey % 5 - 2 AS INT) AS octave,
       CASE {_QTY} % 6 WHEN 0 THEN 'whole' WHEN 1 THEN 'half' WHEN 2 THEN 'quarter'
            WHEN 3 THEN 'eighth' WHEN 4 THEN 'sixteenth' ELSE 'thirty_second' END AS duration,
       CAST(l_suppkey % 3 AS INT) AS dots, l_partkey % 10 = 0 AS is_rest,
       CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(l_partkey % 100 AS DOUBLE) / 100 END AS confidence,
       CAST(l_suppkey % 100 AS DOUBLE) / 100 AS ocr_score,
       CASE l_partkey % 3 WHEN 0 THEN 'geometry' WHEN 1 THEN 'ocr' ELSE 'mixed' END AS pitch_from,
       CASE l_suppkey % 4 WHEN 0 THEN 'dash' WHEN 1 THEN 'underline' ELSE 'default' END AS duration_from,
       CAST(CASE WHEN l_suppkey % 4 = 0 THEN l_linenumber % 3 ELSE 0 END AS INT) AS sustain_dashes
FROM {{lineitem}}""",
    "scores": """
SELECT o_orderkey AS score_id, concat('Score ', CAST(o_orderkey AS VARCHAR(20))) AS title,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'C' WHEN '2-HIGH' THEN 'G' WHEN '3-MEDIUM' THEN 'Bb'
            WHEN '5-LOW' THEN '1=F#' ELSE '' END AS key,
       CASE o_orderstatus WHEN 'F' THEN '4/4' WHEN 'O' THEN '3/4' ELSE '6/8' END AS time_signature,
       CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(40 + o_custkey % 160 AS DOUBLE) END AS tempo_bpm
FROM {orders}""",
    # measures declared per score: three per order, so that some stay empty
    "score_measures": """
SELECT o_orderkey AS score_id, CAST(m AS INT) AS measure_no,
       CASE WHEN (o_orderkey + m) % 5 = 0 THEN 'placeholder' ELSE 'layout' END AS source
FROM {orders} CROSS JOIN (SELECT 1 AS m UNION ALL SELECT 2 UNION ALL SELECT 3) ms""",
    # annotation items of a page: page = eight consecutive orders, layer by line number
    "items": f"""
SELECT l_orderkey - l_orderkey % 8 AS page_id, {_IDX} * 8 + l_orderkey % 8 AS item_idx,
       CASE l_linenumber WHEN 1 THEN 'L1' WHEN 2 THEN 'L2' WHEN 3 THEN 'L3' WHEN 4 THEN 'L3'
            WHEN 5 THEN 'L4' WHEN 6 THEN 'L4' ELSE 'L5' END AS layer,
       concat('id', CAST(l_orderkey % 8 AS VARCHAR(4)), '-', CAST(l_linenumber AS VARCHAR(4)), '-',
              CAST(l_partkey AS VARCHAR(20))) AS id,
       concat('lab', CAST(l_suppkey % 10 AS VARCHAR(4))) AS label,
       CASE l_partkey % 5 WHEN 0 THEN 'score' WHEN 1 THEN 'title' WHEN 2 THEN 'key_time' WHEN 3 THEN 'lyric'
            ELSE 'pitch' END AS kind,
       CAST((l_partkey * 7) % 900 AS DOUBLE) AS x1,
       CAST((l_suppkey * 11 + (l_orderkey % 8) * 100) % 1100 AS DOUBLE) AS y1,
       CAST((l_partkey * 7) % 900 + CASE WHEN l_linenumber = 2 THEN 400 ELSE 20 + {_QTY} END AS DOUBLE) AS x2,
       CAST((l_suppkey * 11 + (l_orderkey % 8) * 100) % 1100 + CASE WHEN l_linenumber = 2 THEN 70 ELSE 30 END AS DOUBLE) AS y2,
       CAST(l_partkey % 100 AS DOUBLE) / 100 AS confidence
FROM {{lineitem}}""",
    # horizontal bands of a page with their glyph counts
    "bands": f"""
SELECT l_orderkey - l_orderkey % 8 AS page_id, {_IDX} * 8 + l_orderkey % 8 AS band_idx,
       CAST(((l_orderkey % 8) * 7 + l_linenumber) * 45 + l_partkey % 12 AS INT) AS y0,
       CAST(((l_orderkey % 8) * 7 + l_linenumber) * 45 + l_partkey % 12 + 8 + l_suppkey % 40 AS INT) AS y1,
       CAST(l_partkey % 15 AS INT) AS n_digitish, CAST(l_suppkey % 14 AS INT) AS n_narrow,
       CAST(floor(l_partkey / 7) AS INT) % 12 AS n_square, CAST(l_partkey % 2 AS INT) AS n_wide,
       CAST(l_partkey % 15 + 2 AS INT) AS n_comps, CAST(14 + l_suppkey % 25 AS DOUBLE) AS med_ch,
       CAST(l_partkey % 8 AS DOUBLE) / 8 AS staff_score
FROM {{lineitem}}""",
    "trials": """
SELECT o_orderkey AS trial, o_orderstatus AS layer, floor(o_totalprice) / 1048576 AS loss,
       CAST(o_custkey % 97 AS DOUBLE) AS min_width
FROM {orders}""",
    # per-sample accuracy rows with a subset and an error flag
    "accuracy_rows": """
SELECT d.doc_id AS sample_id, d.lang AS subset,
       CASE WHEN d.doc_id % 17 = 0 THEN 'failed' END AS error,
       d.n_chars % 200 AS gt_n, (d.n_chars * 7 + d.doc_id) % 180 AS pred_n,
       least(d.n_chars % 200, (d.n_chars * 7 + d.doc_id) % 180) % 90 AS lcs,
       CASE WHEN d.doc_id % 6 = 0 THEN NULL ELSE d.n_chars % 5 END AS bars_err,
       coalesce(l.quality, 0) = 1 AS key_ok, coalesce(l.toxic, 0) = 0 AS time_ok
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
}


def _views_in(text: str) -> list[str]:
    return re.findall(r"\{v:(\w+)\}", text)


def tables_of(text: str) -> list[str]:
    return [t for t in TABLES if "{" + t + "}" in text]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables_of(text)})


def with_views(text: str) -> str:
    """DuckDB form of a query: its views become leading common table expressions."""
    names = list(dict.fromkeys(_views_in(text)))
    body = re.sub(r"\{v:(\w+)\}", r"v_\1", text)
    ctes = []
    for n in names:
        sql = VIEWS[n]
        for t in TABLES:
            sql = sql.replace("{" + t + "}", t)
        ctes.append(f"v_{n} AS MATERIALIZED ({sql})")
    head = body.lstrip()
    if head.upper().startswith("WITH RECURSIVE"):
        rest = head[len("WITH RECURSIVE"):]
        return "WITH RECURSIVE " + ",\n".join([*ctes, rest.strip()])
    if head.upper().startswith("WITH"):
        return "WITH " + ",\n".join([*ctes, head[4:].strip()])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + head
