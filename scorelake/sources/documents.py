"""Score, layout, annotation and project documents to flat tables.

A document table is (doc_id, doc): one JSON text per row, from files or from any
column. Schemas are explicit; what cannot be read becomes null and is dropped where
the contract says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions import box, rhythm, text as tx
from scorelake.operators.scores import pitch_tokens, sounding_pitch
from scorelake.plans.skew import ordered

BOX = "struct<x1:string,y1:string,x2:string,y2:string>"
NOTE = (
    "struct<pitch:string,octave:int,duration:string,dots:int,accidental:string,is_rest:boolean,lyric:string,tie:string,"
    "extra:struct<confidence:double,ocr_score:double,pitch_from:string,source:string,sustain_dashes:int>>"
)
SCORE = (
    "schema_version string, title string, key string, time_signature string, tempo_bpm double, "
    f"parts array<struct<id:string,name:string,measures:array<struct<number:int,notes:array<{NOTE}>,"
    "extra:struct<source:string,meter_status:string,meter_capacity:double,meter_beats:double>>>>>, "
    "extra struct<eval:struct<pitch_sequence:array<string>,measure_count:int,system_count:int,n_systems:int>>"
)
STRUCTURE = (
    f"items array<struct<layer:string,id:string,label:string,kind:string,confidence:double,pitch:string,duration:string,"
    f"underlines:int,octave:int,box:{BOX}>>, "
    "barlines array<struct<system:string,x:string,y1:double,y2:double,id:string,source:string,confidence:double>>, "
    "summary struct<width:int,height:int,key:string,time_signature:string,title:string>"
)


def read_documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """One row per file below ``path``; the id is the folder for ``layout.json`` files,
    else the file name without its endings."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    name = F.input_file_name()
    file = F.regexp_extract(name, r"([^/]+)$", 1)
    folder = F.regexp_extract(name, r"([^/]+)/[^/]+$", 1)
    doc_id = F.when(file == "layout.json", folder).otherwise(F.regexp_extract(file, r"^([^.]+)", 1))
    return df.select(doc_id.alias("doc_id"), name.alias("path"), F.col("value").alias("doc"))


def _num(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def _once(c: Column) -> Column:
    """A column that is worked out once a row: as the row of a list of one it is not copied into the filters and columns above."""
    return F.explode(F.array(c))


def score_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """A2: scores, measures, notes and evaluation tokens of score documents.

    A stated pitch sequence overrides the notes; stated counts override the measures.
    Tokens and the measure count come from the first part.
    """
    s = docs.select("doc_id", _once(F.from_json("doc", SCORE)).alias("s"))
    ev = F.col("s.extra.eval")
    scores = s.select(
        F.col("doc_id").alias("score_id"), "s.schema_version", "s.title", "s.key", "s.time_signature", "s.tempo_bpm",
        F.coalesce(ev["measure_count"], F.when(F.size("s.parts") > 0, F.size(F.col("s.parts")[0]["measures"])), F.lit(0)).alias("measure_count"),
        F.coalesce(ev["system_count"], ev["n_systems"]).alias("system_count"),
    )
    parts = s.select("doc_id", F.posexplode("s.parts").alias("part_idx", "p"))
    meas = parts.select("doc_id", "part_idx", F.posexplode("p.measures").alias("m_pos", "m"))
    measures = meas.select(
        F.col("doc_id").alias("score_id"), "part_idx", "m_pos", F.col("m.number").alias("measure_no"),
        F.col("m.extra.source").alias("source"), F.col("m.extra.meter_status").alias("status"),
        F.col("m.extra.meter_capacity").alias("capacity"), F.col("m.extra.meter_beats").alias("beats"),
    )
    notes = meas.select("doc_id", "part_idx", "m_pos", F.col("m.number").alias("measure_no"), F.posexplode("m.notes").alias("note_idx", "n"))
    notes = notes.select(
        F.col("doc_id").alias("score_id"), "part_idx", "m_pos", "measure_no", "note_idx",
        "n.pitch", "n.accidental", F.coalesce("n.octave", F.lit(0)).alias("octave"), F.coalesce("n.duration", F.lit("quarter")).alias("duration"),
        F.coalesce("n.dots", F.lit(0)).alias("dots"), F.coalesce("n.is_rest", F.lit(False)).alias("is_rest"), "n.lyric", "n.tie",
        F.col("n.extra.confidence").alias("confidence"), F.col("n.extra.ocr_score").alias("ocr_score"),
        F.col("n.extra.pitch_from").alias("pitch_from"), F.col("n.extra.source").alias("note_source"),
        F.col("n.extra.sustain_dashes").alias("sustain_dashes"),
    )
    # tokens of a document are made in its own row: it is read once, and nothing is dealt out or joined
    melody = F.flatten(F.transform(F.col("s.parts")[0]["measures"], lambda m: F.coalesce(m["notes"], F.array())))
    sung = F.filter(melody, lambda n: sounding_pitch(n["is_rest"], n["pitch"]))
    derived = F.transform(sung, lambda n: rhythm.pitch_token(n["pitch"], n["accidental"]))
    chosen = F.when(F.size(ev["pitch_sequence"]) > 0, ev["pitch_sequence"]).otherwise(derived)
    tokens = s.select(F.col("doc_id").alias("score_id"), F.posexplode(chosen).alias("pos", "token"))
    return {"scores": scores, "measures": measures, "notes": notes, "tokens": tokens}


def score_documents(scores: DataFrame, notes: DataFrame) -> DataFrame:
    """A2, inverse: one JSON text per score from flat tables (one melody part)."""
    note = F.struct("note_idx", "pitch", "octave", "duration", "dots", "accidental", "is_rest")
    # a document is one value, so its rows meet by the score at once, for both levels and the scores
    m = notes.repartition("score_id").groupBy("score_id", "measure_no").agg(F.array_sort(F.collect_list(note)).alias("notes"))
    body = F.struct(F.col("measure_no").alias("number"), F.transform("notes", lambda n: n.dropFields("note_idx")).alias("notes"))
    p = m.groupBy("score_id").agg(F.array_sort(F.collect_list(body)).alias("measures"))
    out = scores.join(p, "score_id", "left")
    empty = F.coalesce("measures", F.array())
    doc = F.struct(
        F.lit("0.1").alias("schema_version"), "title", "key", "time_signature", "tempo_bpm",
        F.array(F.struct(F.lit("P1").alias("id"), F.lit("melody").alias("name"), empty.alias("measures"))).alias("parts"),
    )
    return out.select(F.col("score_id").alias("doc_id"), F.to_json(doc).alias("doc"))


def structure_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """A4: annotation payloads to items, bar lines and page sizes.

    Items with an unknown layer or a box that is not four numbers are dropped, and so
    are bar lines without a numeric x.
    """
    s = docs.select(F.col("doc_id").alias("page_id"), F.from_json("doc", STRUCTURE).alias("s"))
    items = s.select("page_id", F.posexplode("s.items").alias("item_idx", "i")).select(
        "page_id", "item_idx", "i.layer", "i.id", F.coalesce("i.label", F.lit("")).alias("label"),
        F.coalesce("i.kind", F.lit("")).alias("kind"), "i.confidence", "i.pitch", "i.duration", "i.underlines", "i.octave",
        *[_num(f"i.box.{c}").alias(c) for c in box.SIDES],
    ).where(F.col("layer").isin("L1", "L2", "L3", "L4", "L5") & box.valid())
    bars = s.select("page_id", F.posexplode("s.barlines").alias("line_idx", "b")).select(
        "page_id", "line_idx", F.coalesce(F.col("b.system").try_cast("int"), F.lit(-1)).alias("system"), _num("b.x").alias("x"),
        "b.y1", "b.y2", "b.id", "b.source", "b.confidence",
    ).where(F.col("x").isNotNull())
    pages = s.select("page_id", "s.summary.*")
    return {"items": items, "barlines": bars, "pages": pages}


def structure_documents(items: DataFrame) -> DataFrame:
    """A4, inverse: one annotation payload per page."""
    item = F.struct("item_idx", "layer", "id", "label", "kind", "confidence", F.struct(*box.SIDES).alias("box"))
    g = items.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("i"))
    return g.select(
        F.col("page_id").alias("doc_id"),
        F.to_json(F.struct(F.transform("i", lambda r: r.dropFields("item_idx")).alias("items"))).alias("doc"),
    )


def _at(c: str, *path: str) -> Column:
    """``get_json_object`` for texts that hold all names of the path; a name is written with escapes only beside a backslash."""
    named = F.lit(True)
    for p in path:
        named = named & F.col(c).contains(p)
    return F.when(named | F.col(c).contains("\\"), F.get_json_object(c, ".".join(("$", *path))))


def _path(doc: str, *paths: tuple[str, ...]) -> Column:
    """First of several paths that holds something (an empty list counts as nothing)."""
    return F.coalesce(*[F.nullif(_at(doc, *p), F.lit("[]")) for p in paths])


def ground_truth_geometry(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Truth boxes and bar xs in nested or flat form, with default labels.

    Boxes may sit in the element, in ``box`` or in ``rect``; a layer without valid boxes
    is absent. Returns (boxes, xs) keyed by sample_id. A document is read once for all layers.
    """
    layers = {
        "L1": ("regions", "l1_regions"), "L2": ("systems", "l2_systems"),
        "L3": ("measures", "l3_measures"), "L4": ("notes", "l4_notes"),
    }
    found = F.array(*[
        F.struct(F.lit(layer).alias("layer"), _path("doc", ("layers", layer, inner), ("layers", layer.lower(), inner), (flat,)).alias("src"))
        for layer, (inner, flat) in layers.items()
    ])
    e = docs.select(F.col("doc_id").alias("sample_id"), F.explode(found).alias("f")).select("sample_id", "f.layer", "f.src")
    e = e.where(F.col("src").isNotNull())
    e = e.select("sample_id", "layer", F.posexplode(F.from_json("src", "array<string>")).alias("box_idx", "e"))
    e = e.select("*", _once(F.coalesce(_at("e", "box"), F.col("e"))).alias("o"))
    e = e.select("*", _once(F.coalesce(_at("o", "rect"), F.col("o"))).alias("b"))
    e = e.select("*", _once(F.struct(*[_num(_at("b", c)).alias(c) for c in box.SIDES])).alias("v"))
    idx, of = F.col("box_idx"), lambda values: F.coalesce(*[F.when(F.col("layer") == k, v) for k, v in values.items()])
    own = _at("e", "label")
    role = F.coalesce(_at("e", "role"), _at("e", "kind"), F.lit("region"))
    label = {
        "L1": role, "L2": F.coalesce(own, F.concat(F.lit("sys"), idx)), "L3": F.coalesce(own, F.concat(F.lit("m"), idx + 1)),
        "L4": F.coalesce(own, F.concat(F.lit("n"), idx)),
    }
    kind = {"L1": role, "L2": F.lit("system"), "L3": F.lit("measure"), "L4": F.coalesce(_at("e", "kind"), F.lit("pitch"))}
    out = e.select(
        "sample_id", "layer", "box_idx", of(label).alias("label"), of(kind).alias("kind"),
        *[F.col(f"v.{c}").alias(c) for c in box.SIDES],
    ).where(box.valid())
    src = _path("doc", ("layers", "L3", "barlines"), ("layers", "l3", "barlines"), ("l3_barlines",))
    xs = docs.select(F.col("doc_id").alias("sample_id"), F.posexplode(F.from_json(src, "array<string>")).alias("x_idx", "v"))
    xs = xs.select("sample_id", "x_idx", _num("v").alias("x")).where(F.col("x").isNotNull())
    return out, xs


LAYOUT = (
    "layout_schema_version string, id string, image struct<path:string,width:int,height:int,sha256:string>, "
    f"l1 struct<regions:array<struct<role:string,box:{BOX},confidence:double>>,score_region:{BOX},title:{BOX},key_time:{BOX}>, "
    f"l2 struct<systems:array<struct<id:string,index:int,bbox:{BOX},box:{BOX},confidence:double>>>, "
    f"l3 struct<rows:array<struct<system_id:string,system_index:int,splits:array<string>,measures:array<struct<box:{BOX}>>>>>"
)


def layout_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """A3: layout samples to samples, regions, systems, rows, splits and measures.

    A split may be a number or an object with ``x``.
    """
    d = docs.select("doc_id", F.from_json("doc", LAYOUT).alias("d"))
    sid = F.coalesce("d.id", F.col("doc_id").cast("string")).alias("sample_id")
    sides = lambda p: [_num(f"{p}.{c}").alias(c) for c in box.SIDES]
    samples = d.select(
        sid, F.col("d.layout_schema_version").alias("version"), F.col("d.image.width").alias("width"),
        F.col("d.image.height").alias("height"), F.col("d.image.sha256").alias("sha256"),
    )
    named = F.array(
        *[F.struct(F.lit(r).alias("role"), F.col(f"d.l1.{c}").alias("box"), F.lit(None).cast("double").alias("confidence"))
          for r, c in (("score", "score_region"), ("title", "title"), ("key_time", "key_time"))]
    )
    listed = F.coalesce("d.l1.regions", F.array())
    extra = F.filter(named, lambda n: n["box"].isNotNull() & ~F.exists(listed, lambda r: F.lower(r["role"]) == n["role"]))
    regions = d.select(sid, F.posexplode(F.concat(listed, extra)).alias("region_idx", "r")).select(
        "sample_id", "region_idx", F.lower("r.role").alias("role"), *sides("r.box"), F.col("r.confidence").alias("confidence")
    )
    systems = d.select(sid, F.posexplode("d.l2.systems").alias("position", "s")).withColumn("b", F.coalesce("s.bbox", "s.box")).select(
        "sample_id", "position", F.coalesce("s.id", F.concat(F.lit("sys"), F.col("position"))).alias("system_id"),
        F.coalesce("s.index", "position").alias("system_index"), *sides("b"), F.col("s.confidence").alias("confidence"),
    )
    raw = d.select(sid, F.posexplode("d.l3.rows").alias("row_idx", "r"))
    rows = raw.select("sample_id", "row_idx", "r.system_id", "r.system_index")
    v = F.col("v")
    splits = raw.select("sample_id", "row_idx", F.posexplode("r.splits").alias("split_idx", "v")).select(
        "sample_id", "row_idx", "split_idx", F.coalesce(_num(v), _num(F.get_json_object(v, "$.x"))).alias("x"),
        F.get_json_object(v, "$.id").alias("split_id"), F.get_json_object(v, "$.source").alias("source"),
        _num(F.get_json_object(v, "$.confidence")).alias("confidence"),
    )
    measures = raw.select("sample_id", "row_idx", F.posexplode("r.measures").alias("measure_idx", "m")).select(
        "sample_id", "row_idx", "measure_idx", *sides("m.box")
    )
    return {"samples": samples, "regions": regions, "systems": systems, "rows": rows, "splits": splits, "measures": measures}


def project_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A5: (score documents, annotation documents, quarantine) of project files.

    A file is a wrapped project (``kind`` ending in -project with a score) or a bare
    score; anything else, and a project without annotation when layouts are wanted, is
    listed in the quarantine with its reason.
    """
    at = lambda p: F.get_json_object("doc", p)
    wrapped = F.coalesce(at("$.kind"), F.lit("")).endswith("-project") & at("$.score").startswith("{")
    bare = at("$.schema_version").isNotNull() & at("$.parts").isNotNull()
    form = F.when(wrapped, "project").when(bare, "score").otherwise("unknown")
    d = docs.withColumn("form", form)
    scores = d.where(F.col("form") != "unknown").select("doc_id", F.when(F.col("form") == "project", at("$.score")).otherwise(F.col("doc")).alias("doc"))
    has = F.coalesce(at("$.structure"), F.lit("")).startswith("{")
    structures = d.where((F.col("form") == "project") & has).select("doc_id", at("$.structure").alias("doc"))
    reason = F.when(F.col("form") == "unknown", "not a project or score").when(~has, "no structure")
    return scores, structures, d.select("doc_id", "form", reason.alias("reason")).where(F.col("reason").isNotNull())


DIGITAL = (
    "Title string, KeySignature string, Tempo string, Bpm string, Measures array<struct<LyricText:string,LyricSyllables:array<string>,"
    "MelodyNotes:array<struct<Type:int,Pitch:string,Octave:int,Underlines:int,Dashes:int,Dotted:boolean,Accidental:string>>>>"
)


def degree_columns() -> dict[str, Column]:
    """Degree, accidental, octave and rest of a numeric digital-source note."""
    c = F.col
    pf = c("Pitch").try_cast("double")
    near = F.abs(pf - F.bround(pf, 0)) < 0.05
    raw = F.when(near, F.bround(pf, 0)).otherwise(F.when(pf < 0, F.ceil(pf)).otherwise(F.floor(pf))).cast("int")
    rest = F.coalesce(c("Type") == 1, F.lit(False)) | pf.isNull() | (raw == 0)
    stated = F.when(c("Accidental") == "1", "sharp").when(c("Accidental").isin("-1", "2", "flat"), "flat")
    acc = F.coalesce(stated, F.when(~near, F.when(pf - raw > 0, "sharp").otherwise("flat")))
    degree = F.greatest(F.lit(1), F.least(F.lit(7), raw)).cast("string")
    return {
        "pitch": F.when(~rest, degree), "accidental": F.when(~rest, acc),
        "octave": F.when(rest, 0).otherwise(F.coalesce("Octave", F.lit(0))), "is_rest": rest,
    }


def length_columns() -> dict[str, Column]:
    """Duration and dots from underlines, dashes and the dot of a digital note."""
    c = F.col
    ul = F.coalesce("Underlines", F.lit(0))
    base = F.when(ul >= 2, 0.25).when(ul == 1, 0.5).otherwise(1.0)
    beats = (base + F.coalesce("Dashes", F.lit(0))) * F.when(F.coalesce("Dotted", F.lit(False)), 1.5).otherwise(1.0)
    best = rhythm.nearest_length(beats)
    return {"duration": best["duration"], "dots": best["dots"]}


def key_of(text: Column) -> Column:
    """Key named by a digital source, C when none."""
    t = F.coalesce(text, F.lit(""))
    solfa = F.regexp_extract(tx.strip(t), r"1\s*=\s*([A-Ga-g][b#♭♯]?)", 1)
    any_ = F.regexp_extract(t, r"([A-Ga-g][b#]?)", 1)
    k = F.when(solfa != "", solfa).otherwise(any_)
    k = F.replace(F.replace(k, F.lit("♭"), F.lit("b")), F.lit("♯"), F.lit("#"))
    return F.when(k == "", "C").otherwise(F.concat(F.upper(F.substring(k, 1, 1)), F.substr(k, F.lit(2))))


def digital_scores(docs: DataFrame) -> dict[str, DataFrame]:
    """Digital source documents to scores, measures, notes (with lyrics) and tokens."""
    d = docs.select("doc_id", F.from_json("doc", DIGITAL).alias("d"))
    tempo = F.coalesce("d.Tempo", F.lit(""))
    meter = F.regexp_extract(tempo, r"(\d+)\s*/\s*(\d+)", 0)
    bpm = F.coalesce(F.col("d.Bpm").try_cast("double"), F.regexp_extract(tempo, r"(?i)(\d+)\s*BPM", 1).try_cast("double"))
    scores = d.select(
        F.col("doc_id").alias("score_id"), F.coalesce("d.Title", F.col("doc_id").cast("string")).alias("title"),
        key_of(F.col("d.KeySignature")).alias("key"),
        F.when(meter == "", "4/4").otherwise(F.regexp_replace(meter, r"\s+", "")).alias("time_signature"),
        bpm.alias("tempo_bpm"), F.coalesce(F.size("d.Measures"), F.lit(0)).alias("measure_count"),
    )
    m = d.select(F.col("doc_id").alias("score_id"), F.posexplode("d.Measures").alias("_m", "m"))
    m = m.withColumn("measure_no", F.col("_m") + 1)
    keys = ["score_id", "measure_no"]
    n = m.select(*keys, F.posexplode("m.MelodyNotes").alias("note_idx", "n")).select(*keys, "note_idx", "n.*")
    n = n.select(*keys, "note_idx", *[c.alias(k) for k, c in (degree_columns() | length_columns()).items()])
    listed = F.filter("m.LyricSyllables", lambda s: F.trim(s) != "")
    given = F.size("m.LyricSyllables") > 0
    spoken = F.filter(F.split(F.trim(F.coalesce("m.LyricText", F.lit(""))), r"\s+"), lambda s: s != "")
    words = m.select(*keys, F.posexplode(F.when(given, listed).otherwise(spoken)).alias("_w", "lyric"))
    sung = ordered(n.where(~F.col("is_rest")), keys, ["note_idx"], number="_k").withColumn("_w", F.col("_k") - 1).drop("_k")
    notes = sung.join(words, keys + ["_w"], "left").drop("_w").unionByName(n.where("is_rest").withColumn("lyric", F.lit(None).cast("string")))
    return {"scores": scores, "measures": m.select(*keys), "notes": notes, "tokens": pitch_tokens(notes)}
