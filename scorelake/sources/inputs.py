"""Manifests, recogniser output, images, tuning trials, training runs, generated pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions import box
from scorelake.plans.skew import ordered

ENTRY = (
    "struct<id:string,subset:string,image:string,gt:string,key:string,time_signature:string,measure_count:int,"
    "pitch_sequence:array<string>,synthetic:boolean,license:string,status:string,title:string>"
)


def manifest_entries(docs: DataFrame) -> DataFrame:
    """A1: entries of manifest documents with their position."""
    e = docs.select("doc_id", F.from_json("doc", f"entries array<{ENTRY}>").alias("m"))
    return e.select(F.col("doc_id").alias("manifest"), F.posexplode("m.entries").alias("pos", "e")).select("manifest", "pos", "e.*")


def select_entries(
    entries: DataFrame, *, subset: str | None = None, limit: int | None = None, order: str = "batch"
) -> DataFrame:
    """A1: entries a run looks at. ``batch`` applies subset, limit, then ready; ``accuracy``
    applies ready, subset, then limit. Entries without truth path are skipped."""
    batch = order == "batch"
    status = F.col("status")
    ready = (F.coalesce(status, F.lit("")).isin("", "ready")) if batch else F.coalesce(status == "ready", F.lit(False))
    out = entries if batch else entries.where(ready)
    if subset is not None:
        out = out.where(F.col("subset") == subset)
    if limit is not None:
        out = ordered(out, ["manifest"], ["pos"], number="_n").where(F.col("_n") <= max(0, limit)).drop("_n")
    return (out.where(ready) if batch else out).where(F.coalesce("gt", F.lit("")) != "")


def missing_files(entries: DataFrame, files: DataFrame, column: str = "gt") -> DataFrame:
    """A1: error rows of entries whose file is not in the listing ``files(path)``."""
    gone = entries.join(files.select(F.col("path").alias(column)), column, "left_anti")
    return gone.select(F.col("id").alias("sample_id"), F.concat(F.lit(f"{column} missing: "), column).alias("error"))


def upsert_manifest(manifest: DataFrame, imported: DataFrame) -> DataFrame:
    """Imported rows overwrite entries by id and make them ready."""
    names = ["key", "time_signature", "measure_count", "pitch_sequence", "image", "gt", "title"]
    new = imported.groupBy("id").agg(F.max_by(F.struct(*names), "import_idx").alias("_i"))
    out = manifest.join(new, "id", "left")
    hit = F.col("_i").isNotNull()
    return out.withColumns(
        {n: F.when(hit, F.col(f"_i.{n}")).otherwise(F.col(n)) for n in names}
        | {"status": F.when(hit, "ready").otherwise(F.col("status"))}
    ).drop("_i")


def ocr_items(docs: DataFrame) -> DataFrame:
    """Recogniser output, list of (polygon, (text, score)) or arrays per field, to items.

    A polygon becomes its outer box; blank text is dropped, a missing polygon leaves the
    box null.
    """
    doc = F.col("doc")
    first = F.when(F.get_json_object(doc, "$[0]").isNotNull(), F.get_json_object(doc, "$[0]")).otherwise(doc)
    d = docs.select(F.col("doc_id").alias("page_id"), first.alias("d"))
    by_line = F.col("d").startswith("[")
    lines = d.where(by_line).select("page_id", F.posexplode(F.from_json("d", "array<string>")).alias("item_idx", "l"))
    rec = F.get_json_object("l", "$[1]")
    pair = rec.startswith("[")
    lines = lines.select(
        "page_id", "item_idx", F.when(pair, F.get_json_object(rec, "$[0]")).otherwise(rec).alias("text"),
        F.when(pair, F.get_json_object(rec, "$[1]")).try_cast("double").alias("score"), F.get_json_object("l", "$[0]").alias("poly"),
    )
    pick = lambda *names: F.coalesce(*[F.nullif(F.get_json_object("d", f"$.{n}"), F.lit("[]")) for n in names])
    arr = lambda c: F.from_json(c, "array<string>")
    z = F.arrays_zip(arr(pick("rec_texts", "texts")).alias("t"), arr(pick("rec_scores", "scores")).alias("s"), arr(pick("dt_polys", "rec_polys", "boxes")).alias("p"))
    cols = d.where(~by_line).select("page_id", F.posexplode(z).alias("item_idx", "z")).select(
        "page_id", "item_idx", F.col("z.t").alias("text"), F.col("z.s").try_cast("double").alias("score"), F.col("z.p").alias("poly")
    )
    both = lines.unionByName(cols).withColumn("text", F.trim("text")).where(F.coalesce("text", F.lit("")) != "")
    p = F.from_json("poly", "array<array<double>>")
    side = lambda pick, i: pick(F.transform(p, lambda q: q[i]))
    return both.select(
        "page_id", "item_idx", "text", "score",
        side(F.array_min, 0).alias("x1"), side(F.array_min, 1).alias("y1"), side(F.array_max, 0).alias("x2"), side(F.array_max, 1).alias("y2"),
    )


def decode_data_urls(df: DataFrame, column: str) -> DataFrame:
    """Image bytes and format of data-URL payloads; null when the URL is not one."""
    pattern = r"(?is)^data:image/(png|jpeg|jpg|webp|gif);base64,(.+)$"
    url = F.trim(column)
    fmt = F.lower(F.regexp_extract(url, pattern, 1))
    return df.withColumns(
        {
            "content": F.when(fmt != "", F.try_to_binary(F.regexp_extract(url, pattern, 2), F.lit("base64"))),
            "format": F.when(fmt.isin("jpeg", "jpg"), "jpg").when(fmt != "", fmt),
        }
    )


def image_facts(df: DataFrame) -> DataFrame:
    """Hash and, for PNG, width and height from the header of ``content``."""
    head = F.hex(F.substring("content", 1, 24))
    png = F.startswith(head, F.lit("89504E470D0A1A0A")) & (F.length("content") >= 24)
    number = lambda at: F.conv(F.substring(head, at, 8), 16, 10).cast("bigint")
    return df.withColumns(
        {
            "sha256": F.sha2("content", 256),
            "width": F.when(png, number(33)), "height": F.when(png, number(41)),
        }
    )


def image_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Every image file below ``path`` with its hash and PNG size (no pixels kept)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return image_facts(files.select("path", "length", "content")).drop("content")


def duplicate_images(inventory: DataFrame) -> DataFrame:
    """Copies per hash; the group itself is never collected, only counted."""
    groups = inventory.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path"))
    return groups.where("copies > 1")


TRIAL = (
    "trial bigint, params map<string,double>, loss double, score double, mean_iou double, tp int, fp int, fn int, elapsed_ms double"
)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Tuning trials from JSON lines; the layer is the file name up to the first dot."""
    df = spark.read.schema(TRIAL + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return df.withColumn("layer", F.regexp_extract(F.input_file_name(), r"([^/.]+)[^/]*$", 1))


def run_history(docs: DataFrame) -> DataFrame:
    """Epoch rows of training histories; NaN becomes null."""
    schema = "array<struct<epoch:int,train_loss:double,val:struct<loss:double,l2_mean_iou:double,l3_split_count_mae:double,l3_split_count_exact:double,l3_mean_abs_x_error:double>>>"
    opts = {"allowNonNumericNumbers": "true"}
    h = docs.select(F.col("doc_id").alias("run"), F.explode(F.from_json("doc", schema, opts)).alias("h"))
    clean = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    return h.select(
        "run", "h.epoch", clean(F.col("h.train_loss")).alias("train_loss"), clean(F.col("h.val.loss")).alias("val_loss"),
        *[clean(F.col(f"h.val.{c}")).alias(c) for c in ("l2_mean_iou", "l3_split_count_mae", "l3_split_count_exact", "l3_mean_abs_x_error")],
    )


def last_epochs(history: DataFrame, mtimes: DataFrame | None = None) -> DataFrame:
    """Epochs and last epoch per run, newest run first when times are given."""
    cols = [c for c in history.columns if c not in ("run", "epoch")]
    out = history.groupBy("run").agg(F.count(F.lit(1)).alias("epochs"), F.max_by(F.struct("epoch", *cols), "epoch").alias("l")).select("run", "epochs", "l.*")
    return out if mtimes is None else out.join(mtimes, "run").orderBy(F.desc("mtime"), "run")


def synthetic_layouts(spark: SparkSession, n: int, seed: int = 0, *, width: int = 640, height: int = 800) -> dict[str, DataFrame]:
    """A10: exact page geometry: 3-6 rows of 3-5 equal measures per page, from hashes of
    (seed, page), so any page can be regenerated alone."""
    draw = lambda name, lo, hi: (F.pmod(F.xxhash64(F.lit(seed), F.col("page_id"), F.lit(name)), F.lit(hi - lo + 1)) + lo).cast("int")
    pages = spark.range(n).select(
        F.col("id").alias("page_id"), F.lit(width).alias("width"), F.lit(height).alias("height"),
    ).withColumns({"n_systems": draw("rows", 3, 6), "per_row": draw("measures", 3, 5)})
    w, h = float(width), float(height)
    y0, y1, mx = h * 0.12, h * 0.92, w * 0.06
    ns = F.col("n_systems")
    band = F.least(F.lit(70.0), F.lit(y1 - y0) / (ns + 1) * 0.7)
    gap = (F.lit(y1 - y0) - ns * band) / (ns + 1)
    sys = pages.withColumn("system_idx", F.explode(F.sequence(F.lit(0), ns - 1)))
    top = F.lit(y0) + gap + F.col("system_idx") * (band + gap)
    systems = sys.select(
        "page_id", "system_idx", F.concat(F.lit("l2-sys"), F.col("system_idx")).alias("system_id"), F.lit(mx).alias("x1"),
        top.alias("y1"), F.lit(w - mx).alias("x2"), (top + band).alias("y2"), F.lit(1.0).alias("confidence"), "per_row",
    )
    usable = w - 2 * mx
    splits = systems.withColumn("split_idx", F.explode(F.sequence(F.lit(1), F.col("per_row") - 1))).select(
        "page_id", "system_idx", (F.col("split_idx") - 1).alias("split_idx"),
        (F.lit(mx) + F.col("split_idx") * F.lit(usable) / F.col("per_row")).alias("x"),
        F.concat_ws("-", F.concat(F.lit("s"), F.col("system_idx")), F.col("split_idx") - 1).alias("split_id"),
        F.lit("synth").alias("source"), F.lit(1.0).alias("confidence"),
    )
    region = lambda role, a, b, c, d: F.struct(F.lit(role).alias("role"), F.lit(a).alias("x1"), F.lit(b).alias("y1"), F.lit(c).alias("x2"), F.lit(d).alias("y2"))
    regions = pages.select(
        "page_id", F.explode(F.array(region("title", w * 0.2, h * 0.04, w * 0.8, h * 0.09), region("score", 0.0, y0, w, y1))).alias("r")
    ).select("page_id", "r.*")
    return {"pages": pages, "regions": regions, "systems": systems.drop("per_row"), "splits": splits}


def recognize_images(
    images: DataFrame, recognize: Callable[[bytes], dict], *, rows_per_batch: int | None = None
) -> DataFrame:
    """M1: run a user's recogniser over image rows (sample_id, content).

    ``recognize`` returns JSON texts ``score`` and ``structure``; an exception becomes an
    error row. Images stream through Arrow batches; the function is set up once per task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sid, content in zip(pdf["sample_id"], pdf["content"]):
                try:
                    got = recognize(bytes(content))
                    out.append((sid, got.get("score"), got.get("structure"), None))
                except Exception as exc:  # a failed page must not fail the run
                    out.append((sid, None, None, f"recognize failed: {exc}"))
            yield pd.DataFrame(out, columns=["sample_id", "score", "structure", "error"])

    kind = dict(images.dtypes)["sample_id"]
    return images.select("sample_id", "content").mapInPandas(
        run, f"sample_id {kind}, score string, structure string, error string"
    )
