"""Queries of the document family: JSON round trips over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.adapters import view
from scorelake.catalog.base import query, r6
from scorelake.catalog.reports import MANIFEST
from scorelake.functions.rhythm import NAMED_LENGTHS
from scorelake.sources import documents as dc
from scorelake.sources import inputs as inp


def _docs(spark, sf, table, text):
    mark = "{" + table + "}"
    escaped = mark.join(part.replace("{", "{{").replace("}", "}}") for part in text.split(mark))
    return spark.sql(escaped, **{table: spark.read.parquet(f"{sf}/{table}.parquet")})


@query(
    "score_round_trip",
    """SELECT score_id, measure_no, CAST(row_number() OVER (PARTITION BY score_id, measure_no ORDER BY note_idx) - 1 AS INT) AS note_idx, pitch, octave, duration, dots, is_rest
FROM {v:score_notes}""",
)
def q_a2(spark, sf):
    docs = dc.score_documents(view(spark, sf, "scores"), view(spark, sf, "score_notes"))
    return dc.score_tables(docs)["notes"].select("score_id", "measure_no", "note_idx", "pitch", "octave", "duration", "dots", "is_rest")


@query(
    "score_tokens",
    """SELECT score_id, CAST(row_number() OVER (PARTITION BY score_id ORDER BY measure_no, note_idx) - 1 AS INT) AS pos,
  concat(pitch, CASE accidental WHEN 'sharp' THEN '#' WHEN 'flat' THEN 'b' ELSE '' END) AS token FROM {v:score_notes} WHERE NOT is_rest AND pitch IS NOT NULL""",
)
def q_a2_tokens(spark, sf):
    docs = dc.score_documents(view(spark, sf, "scores"), view(spark, sf, "score_notes"))
    return dc.score_tables(docs)["tokens"].select("score_id", "pos", "token")


@query(
    "structure_round_trip",
    """SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY item_idx) - 1 AS INT) AS item_idx, layer, id, label, kind, x1, y1, x2, y2 FROM {v:items}""",
)
def q_a4(spark, sf):
    items = dc.structure_tables(dc.structure_documents(view(spark, sf, "items")))["items"]
    return items.select("page_id", "item_idx", "layer", "id", "label", "kind", "x1", "y1", "x2", "y2")


# truth documents in four shapes: nested or flat layers, boxes in place, in box or in rect
GT_DOC = """SELECT o_orderkey AS doc_id, CASE o_orderkey % 4
  WHEN 0 THEN concat('{"layers":{"L1":{"regions":[{"role":"score","box":', b, '}]},"L3":{"barlines":[', CAST(o_custkey AS VARCHAR(20)), ',"x"]}}}')
  WHEN 1 THEN concat('{"l2_systems":[{"label":"a","rect":', b, '},{"x1":1,"y1":2,"x2":"no","y2":4}]}')
  WHEN 2 THEN concat('{"layers":{"l4":{"notes":[', b, ',{"kind":"lyric","box":{"rect":', b, '}}]}},"l3_barlines":[', CAST(o_custkey AS VARCHAR(20)), '.5]}')
  ELSE concat('{"layers":{"L3":{"measures":[]}},"l3_measures":[{"box":', b, '}]}') END AS doc
  FROM (SELECT *, concat('{"x1":', CAST(o_custkey AS VARCHAR(20)), ',"y1":2,"x2":', CAST(o_custkey + 10 AS VARCHAR(20)), ',"y2":9}') AS b FROM {orders}) q"""


@query(
    "ground_truth_geometry",
    """WITH o AS (SELECT o_orderkey AS sample_id, CAST(o_custkey AS DOUBLE) AS x1, CAST(o_custkey + 10 AS DOUBLE) AS x2, o_orderkey % 4 AS m FROM orders)
SELECT sample_id, 'L1' AS layer, 0 AS box_idx, 'score' AS label, 'score' AS kind, x1, x2 FROM o WHERE m = 0
UNION ALL SELECT sample_id, 'L2', 0, 'a', 'system', x1, x2 FROM o WHERE m = 1
UNION ALL SELECT sample_id, 'L4', 0, 'n0', 'pitch', x1, x2 FROM o WHERE m = 2 UNION ALL SELECT sample_id, 'L4', 1, 'n1', 'lyric', x1, x2 FROM o WHERE m = 2
UNION ALL SELECT sample_id, 'L3', 0, 'm1', 'measure', x1, x2 FROM o WHERE m = 3""",
)
def q_a4c(spark, sf):
    boxes, _ = dc.ground_truth_geometry(_docs(spark, sf, "orders", GT_DOC))
    return boxes.select("sample_id", "layer", "box_idx", "label", "kind", "x1", "x2")


@query(
    "ground_truth_xs",
    """SELECT o_orderkey AS sample_id, 0 AS x_idx, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS DOUBLE) ELSE o_custkey + 0.5::DOUBLE END AS x FROM orders WHERE o_orderkey % 4 IN (0, 2)""",
)
def q_a4x(spark, sf):
    return dc.ground_truth_geometry(_docs(spark, sf, "orders", GT_DOC))[1]


LAYOUT_DOC = """SELECT o_orderkey AS doc_id, concat('{"layout_schema_version":"0.1","id":"S', CAST(o_orderkey AS VARCHAR(20)), '","image":{"width":640,"height":800},',
  '"l1":{"score_region":{"x1":0,"y1":1,"x2":640,"y2":790}},"l2":{"systems":[{"id":"l2-sys0","index":0,"bbox":{"x1":10,"y1":20,"x2":600,"y2":80}}]},',
  '"l3":{"rows":[{"system_id":"l2-sys0","splits":[', CAST(o_custkey % 500 + 20 AS VARCHAR(20)), ',{"x":', CAST(o_custkey % 500 + 60 AS VARCHAR(20)), '.5,"source":"user"}]}]}}') AS doc FROM {orders}"""


@query(
    "layout_splits",
    """SELECT concat('S', o_orderkey) AS sample_id, 0 AS row_idx, 0 AS split_idx, CAST(o_custkey % 500 + 20 AS DOUBLE) AS x, NULL AS source FROM orders
UNION ALL SELECT concat('S', o_orderkey), 0, 1, o_custkey % 500 + 60.5::DOUBLE, 'user' FROM orders""",
)
def q_a3(spark, sf):
    return dc.layout_tables(_docs(spark, sf, "orders", LAYOUT_DOC))["splits"].select("sample_id", "row_idx", "split_idx", "x", "source")


PROJECT_DOC = """SELECT o_orderkey AS doc_id, CASE o_orderkey % 4
  WHEN 0 THEN '{"kind":"score-project","score":{"schema_version":"0.1","key":"G","parts":[]},"structure":{"items":[]}}'
  WHEN 1 THEN '{"kind":"score-project","score":{"schema_version":"0.1","key":"D"}}' WHEN 2 THEN '{"schema_version":"0.1","key":"F","parts":[]}' ELSE '{"other":1}' END AS doc FROM {orders}"""


@query(
    "project_quarantine",
    """SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 1 THEN 'project' WHEN 2 THEN 'score' ELSE 'unknown' END AS form,
  CASE o_orderkey % 4 WHEN 3 THEN 'not a project or score' ELSE 'no structure' END AS reason FROM orders WHERE o_orderkey % 4 <> 0""",
)
def q_a5(spark, sf):
    return dc.project_tables(_docs(spark, sf, "orders", PROJECT_DOC))[2]


@query(
    "project_scores",
    "SELECT o_orderkey AS score_id, CASE o_orderkey % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'D' ELSE 'F' END AS key FROM orders WHERE o_orderkey % 4 <> 3",
)
def q_a5s(spark, sf):
    scores, _, _ = dc.project_tables(_docs(spark, sf, "orders", PROJECT_DOC))
    return dc.score_tables(scores)["scores"].select("score_id", "key")


DIGITAL_DOC = """SELECT o_orderkey AS doc_id, concat('{"Title":"T","KeySignature":"1=', CASE o_orderkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'b♭' ELSE 'F#' END, '","Tempo":"', CASE o_orderkey % 2 WHEN 0 THEN '3/4' ELSE '6/8 90 BPM' END,
  '","Measures":[{"LyricText":"la li","MelodyNotes":[{"Type":0,"Pitch":', CAST(o_custkey % 10 AS VARCHAR(4)), ',"Octave":1,"Underlines":', CAST(o_custkey % 3 AS VARCHAR(4)), ',"Dashes":', CAST(o_custkey % 4 AS VARCHAR(4)),
  ',"Dotted":', CASE o_custkey % 2 WHEN 0 THEN 'true' ELSE 'false' END, '},{"Type":1},{"Type":0,"Pitch":', CAST(o_custkey % 6 + 1 AS VARCHAR(4)), '.5}]}]}') AS doc FROM {orders}"""
LENGTHS = f"[{', '.join(str(row) for row in NAMED_LENGTHS)}]"


@query(
    "digital_notes",
    f"""WITH o AS (SELECT o_orderkey AS score_id, o_custkey AS c, (CASE o_custkey % 3 WHEN 2 THEN 0.25 WHEN 1 THEN 0.5 ELSE 1.0 END + o_custkey % 4) * CASE o_custkey % 2 WHEN 0 THEN 1.5 ELSE 1 END AS b FROM orders),
l AS (SELECT o.*, list_min(list_transform(range(1, 10), lambda i: {{'d': abs(t[i][1] - b), 'i': i, 'n': t[i][2], 'k': t[i][3]}})) AS m FROM o, (SELECT {LENGTHS} AS t) z)
SELECT score_id, 0 AS note_idx, CASE WHEN c % 10 > 0 THEN CAST(least(7, c % 10) AS VARCHAR) END AS pitch, NULL AS accidental, c % 10 = 0 AS is_rest, m.n AS duration, m.k AS dots, CASE WHEN c % 10 > 0 THEN 'la' END AS lyric FROM l
UNION ALL SELECT score_id, 1, NULL, NULL, true, 'quarter', 0, NULL FROM l
UNION ALL SELECT score_id, 2, CAST(c % 6 + 1 AS VARCHAR), 'sharp', false, 'quarter', 0, CASE WHEN c % 10 > 0 THEN 'li' ELSE 'la' END FROM l""",
)
def q_a6(spark, sf):
    notes = dc.digital_scores(_docs(spark, sf, "orders", DIGITAL_DOC))["notes"]
    return notes.select("score_id", "note_idx", "pitch", "accidental", "is_rest", "duration", "dots", "lyric")


@query(
    "digital_scores",
    """SELECT o_orderkey AS score_id, CASE o_orderkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'Bb' ELSE 'F#' END AS key, CASE o_orderkey % 2 WHEN 0 THEN '3/4' ELSE '6/8' END AS time_signature,
  CASE o_orderkey % 2 WHEN 1 THEN 90.0::DOUBLE END AS tempo_bpm, 1 AS measure_count FROM orders""",
)
def q_a6s(spark, sf):
    return dc.digital_scores(_docs(spark, sf, "orders", DIGITAL_DOC))["scores"].select("score_id", "key", "time_signature", "tempo_bpm", "measure_count")


OCR_DOC = """SELECT o_orderkey AS doc_id, CASE o_orderkey % 2
  WHEN 0 THEN concat('[[[[[1,2],[', CAST(o_custkey + 5 AS VARCHAR(20)), ',2],[9,8],[1,8]],["', o_orderpriority, '",0.5]],[[[0,0],[1,1]],[" ",0.9]]]]')
  ELSE concat('[{"rec_texts":["', o_orderpriority, '","b"],"rec_scores":[0.25],"dt_polys":[[[3,4],[', CAST(o_custkey + 7 AS VARCHAR(20)), ',20]]]}]') END AS doc FROM {orders}"""


@query(
    "ocr_items",
    """SELECT o_orderkey AS page_id, 0 AS item_idx, o_orderpriority AS text, CASE o_orderkey % 2 WHEN 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS score, CASE o_orderkey % 2 WHEN 0 THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END AS x1,
  CASE o_orderkey % 2 WHEN 0 THEN greatest(o_custkey + 5, 9)::DOUBLE ELSE greatest(o_custkey + 7, 3)::DOUBLE END AS x2 FROM orders
UNION ALL SELECT o_orderkey, 1, 'b', NULL, NULL, NULL FROM orders WHERE o_orderkey % 2 = 1""",
)
def q_a7(spark, sf):
    return inp.ocr_items(_docs(spark, sf, "orders", OCR_DOC)).select("page_id", "item_idx", "text", "score", "x1", "x2")


@query("page_hashes", "SELECT page_id, sha256(html) AS sha256 FROM pages")
def q_a8(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.encode("html", "utf-8").alias("content"))
    return inp.image_facts(pages).select("page_id", "sha256")


@query("duplicate_documents", "SELECT sha256(text) AS sha256, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def q_a8d(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    facts = inp.image_facts(docs.select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content")))
    return inp.duplicate_images(facts).select("sha256", "copies")


UP = """SELECT id, 'G' AS key, '3/4' AS time_signature, CAST(pos AS INT) AS measure_count, array('1') AS pitch_sequence, 'i' AS image, 'g' AS gt, 't' AS title, pos AS import_idx FROM {m} WHERE pos % 3 = 0"""


@query(
    "upsert_manifest",
    f"""WITH m AS ({MANIFEST.replace('{documents}', 'documents')})
SELECT id, CASE WHEN pos % 3 = 0 THEN 'ready' ELSE status END AS status, CASE WHEN pos % 3 = 0 THEN 'G' END AS key, CASE WHEN pos % 3 = 0 THEN CAST(pos AS INT) END AS measure_count FROM m""",
)
def q_d24(spark, sf):
    m = _docs(spark, sf, "documents", MANIFEST)
    null = lambda t: F.lit(None).cast(t)
    full = m.withColumns({c: null("string") for c in ("key", "time_signature", "image", "gt", "title")} | {"measure_count": null("int"), "pitch_sequence": null("array<string>")})
    return inp.upsert_manifest(full, spark.sql(UP, m=m)).select("id", "status", "key", "measure_count")


@query(
    "select_entries",
    f"""WITH m AS ({MANIFEST.replace('{documents}', 'documents')}), s AS (SELECT *, row_number() OVER (ORDER BY pos) AS k FROM m WHERE subset = 'en')
SELECT pos, id FROM s WHERE k <= 100 AND status = 'ready'""",
)
def q_a1(spark, sf):
    m = _docs(spark, sf, "documents", MANIFEST).withColumns({"manifest": F.lit("m"), "gt": F.col("id")})
    return inp.select_entries(m, subset="en", limit=100).select("pos", "id")


@query(
    "select_all_entries",
    f"""WITH m AS ({MANIFEST.replace('{documents}', 'documents')}) SELECT pos, id FROM m WHERE status = 'ready'""",
)
def q_a1_all(spark, sf):
    m = _docs(spark, sf, "documents", MANIFEST).withColumns({"manifest": F.lit("m"), "gt": F.col("id")})
    return inp.select_entries(m).select("pos", "id")


@query(
    "missing_files",
    f"""WITH m AS ({MANIFEST.replace('{documents}', 'documents')})
SELECT id AS sample_id, concat('gt missing: gt/', id) AS error FROM m WHERE pos NOT IN (SELECT doc_id FROM labels)""",
)
def q_a1_missing(spark, sf):
    m = _docs(spark, sf, "documents", MANIFEST).withColumn("gt", F.concat(F.lit("gt/"), "id"))
    files = spark.read.parquet(f"{sf}/labels.parquet").select(F.concat(F.lit("gt/E"), F.col("doc_id").cast("string")).alias("path"))
    return inp.missing_files(m, files)


@query(
    "last_epochs",
    """SELECT layer AS run, count(*) AS epochs, max(trial) AS epoch, arg_max(loss, trial) AS train_loss FROM {v:trials} GROUP BY layer""",
)
def q_a9(spark, sf):
    history = view(spark, sf, "trials").select(F.col("layer").alias("run"), F.col("trial").alias("epoch"), F.col("loss").alias("train_loss"))
    return inp.last_epochs(history)
