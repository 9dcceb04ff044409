"""Annotation items and bar lines to layout training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions import box
from scorelake.operators.placement import assign_by_penalty, route_lines
from scorelake.operators.splits import attach_nearest, choose_splits, derive_all_measures
from scorelake.plans.lineage import written
from scorelake.plans.skew import FOLD_ROWS, SCAN_ROWS, measure, ordered, within

ROLES = ("title", "key_time", "score", "other")


def region_role():
    """Role of an L1 item from its kind, else from its label."""
    kind, label = F.lower(F.coalesce("kind", F.lit(""))), F.lower(F.coalesce("label", F.lit("")))
    out = F.lit(None).cast("string")
    for role in reversed(ROLES):
        out = F.when((kind == role) | label.contains(role), role).otherwise(out)
    meta = kind.contains("key") | kind.contains("time") | kind.contains("meta")
    return F.coalesce(out, F.when(meta, "key_time"), F.nullif(kind, F.lit("")), F.lit("other"))


def export_layouts(items: DataFrame, barlines: DataFrame) -> dict[str, DataFrame]:
    """Regions (first of a role leads), rows in reading order, chosen interior lines
    with the metadata of their nearest bar, and measures derived from the lines.

    Items are (page_id, item_idx, layer, id, label, kind, box, confidence); bar lines
    (page_id, system, line_idx, x, id, source, confidence).
    """
    hot = measure(items, ["page_id"], SCAN_ROWS)
    items = items.where(box.valid()).withColumns(box.ordered_corners())
    l1 = items.where("layer = 'L1'").withColumn("role", region_role())
    lead = l1.groupBy("page_id", "role").agg(F.min("item_idx").alias("_first"))
    regions = l1.join(lead, ["page_id", "role"]).select(
        "page_id", F.col("item_idx").alias("region_idx"), "role", *box.SIDES, "confidence",
        (F.col("role").isin("title", "key_time", "score") & (F.col("item_idx") == F.col("_first"))).alias("leads"),
    )
    l2 = ordered(items.where("layer = 'L2'"), ["page_id"], ["y1", "x1", "item_idx"], number="_n", hot=hot)
    systems = written(
        l2.select(
            "page_id", (F.col("_n") - 1).alias("system_idx"),
            F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("l2-sys"), (F.col("_n") - 1).cast("string"))).alias("system_id"),
            *box.SIDES, "confidence",
        )
    )
    l3 = items.where("layer = 'L3'").select("page_id", F.col("item_idx").alias("measure_id"), *box.SIDES)
    measures = l3.join(assign_by_penalty(l3, systems), ["page_id", "measure_id"]).withColumnRenamed("measure_id", "measure_idx")
    measures = written(measures)
    raw = written(
        route_lines(barlines.where(F.col("x").isNotNull()), systems).select(
            "page_id", "system_idx", F.col("line_idx").alias("raw_idx"), "x", "id", "source", "confidence"
        )
    )
    keys = ["page_id", "system_idx"]
    folds = measure(raw.select(*keys).unionByName(measures.select(*keys)), keys, FOLD_ROWS)
    chosen = written(choose_splits(raw.select(*keys, "x", F.col("raw_idx").alias("split_idx")), measures, systems, hot=folds))
    lines = ordered(chosen, keys, ["x"], number="_n", hot=within(folds, chosen, keys)).withColumn("split_idx", F.col("_n") - 1).drop("_n")
    lines = attach_nearest(lines, raw, keys)
    fallback = F.when(F.col("split_source").startswith("bar"), F.col("split_source")).otherwise("migrate")
    near = F.col("raw").isNotNull()
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    splits = lines.select(
        *keys, "split_idx", "x", "split_source",
        F.coalesce(text("raw.id"), F.concat_ws("-", F.concat(F.lit("s"), F.col("system_idx").cast("string")), F.col("split_idx").cast("string"))).alias("split_id"),
        F.when(near, F.coalesce(text("raw.source"), fallback)).otherwise(fallback).alias("source"),
        F.when(near, F.col("raw.confidence")).alias("confidence"),
    )
    splits = written(splits)
    return {
        "regions": regions,
        "systems": systems,
        "splits": splits,
        "measures": derive_all_measures(systems, splits.select(*keys, "x"), keys, hot=folds),
    }
