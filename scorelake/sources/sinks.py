"""Writers for layout samples, reports, baselines, trials and parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions import box


def layout_documents(
    samples: DataFrame, regions: DataFrame, systems: DataFrame, splits: DataFrame, measures: DataFrame
) -> DataFrame:
    """One layout JSON per sample from its layer tables (keys ``sample_id``,
    ``system_idx``); the parts of one page are its document."""
    b = F.struct(*box.SIDES)
    r = regions.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("region_idx", "role", b.alias("box")))).alias("regions"))
    s = systems.groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("system_idx").alias("index"), F.col("system_id").alias("id"), b.alias("bbox")))).alias("systems")
    )
    keys = ["sample_id", "system_idx"]
    x = splits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", F.col("split_id").alias("id"), "source"))).alias("splits"))
    m = measures.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("measure_idx", b.alias("box")))).alias("measures"))
    rows = systems.select(*keys, "system_id").join(x, keys, "left").join(m, keys, "left")
    row = F.struct(F.col("system_idx").alias("system_index"), "system_id", F.coalesce("splits", F.array()).alias("splits"), F.coalesce("measures", F.array()).alias("measures"))
    rows = rows.groupBy("sample_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    d = samples.join(r, "sample_id", "left").join(s, "sample_id", "left").join(rows, "sample_id", "left")
    doc = F.struct(
        F.lit("0.1").alias("layout_schema_version"), F.col("sample_id").cast("string").alias("id"),
        F.struct("width", "height").alias("image"), F.struct("regions").alias("l1"), F.struct("systems").alias("l2"), F.struct("rows").alias("l3"),
    )
    return d.select(F.col("sample_id").alias("doc_id"), F.to_json(doc).alias("doc"))


def write_layouts(documents: DataFrame, verdicts: DataFrame, path: str) -> None:
    """Write layout documents (doc_id, doc as JSON text) as Parquet; refused as a whole when any is invalid."""
    bad = verdicts.where(~F.col("ok"))
    if not bad.isEmpty():
        some = [r["sample_id"] for r in bad.select("sample_id").limit(5).collect()]
        raise ValueError(f"layout validation failed, e.g. {some}")
    documents.write.mode("overwrite").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Per-sample metrics partitioned by layer, so one layer reads alone."""
    metrics.write.mode("overwrite").partitionBy("layer").parquet(path)


def save_baseline(report: DataFrame, name: str, path: str) -> None:
    """A named baseline (mean F1 per layer); saving a name again replaces only it."""
    out = report.select("layer", "mean_f1", F.lit(name).alias("name"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").parquet(path)


def load_baseline(spark: SparkSession, name: str, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("name") == name).drop("name")


def append_trials(trials: DataFrame, path: str) -> None:
    """Trials as JSON lines, appended."""
    trials.write.mode("append").json(path)


def save_best_params(best: DataFrame, path: str) -> None:
    """Best parameters per layer (layer, params), replacing only those layers."""
    best.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer").parquet(path)
