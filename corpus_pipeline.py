"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import contamination, near, packing, passages, quality
from scorelake.llm.exchange import scratch, written
from scorelake.llm.queries import n_words, page_reviews

#: No SQL: the classifier, the signatures and the packing can't be expressed; tests/llm compares with brute force.
ORACLE_SQL = None


def _digest(*parts: str) -> Column:
    """A key of 128 bits of rows that are alike in ``parts``; null counts as empty."""
    return F.unhex(F.md5(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts))))


def _pages(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("page_id"), "text")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labels that aren't held out."""
    rows = docs.withColumn("__key", _digest("doc_id", "text"))  # the verdict hangs on the text, the label on the id
    reviews = page_reviews(spark, sf_dir).withColumnRenamed("page_id", "doc_id")
    reviews = rows.select("doc_id", "__key").distinct().join(reviews, "doc_id").select(F.col("__key").alias("page_id"), "accepted")
    graded = quality.grade_pages(_pages(rows, "__key"), reviews).filter("predicted = 1")
    return rows.join(graded.select(F.col("page_id").alias("__key")).distinct(), "__key", "left_semi").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the one of the smallest id. Ids may repeat or be null, so rows are numbered."""
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "pipeline-rows")
    classes = near.near_duplicates(_pages(rows, "__row")).withColumnRenamed("page_id", "__row").join(rows.select("__row", "doc_id"), "__row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))
    kept = classes.groupBy("class_id").agg(first.alias("first")).select("first.__row")
    return rows.join(kept, "__row", "left_semi").select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that repeat. Untouched texts stay as they are; a document that loses every word goes."""
    rows = docs.withColumn("__key", _digest("text"))  # equal texts lose the same words
    kept = passages.remove_repeated_passages(_pages(rows, "__key")).filter("n_removed > 0")
    cut = kept.select(F.col("page_id").alias("__key"), F.col("text").alias("__text")).dropDuplicates(["__key"])
    joined = rows.join(cut, "__key", "left").filter("__text is null or __text <> ''")
    text = F.coalesce("__text", "text")
    n_chars = F.when(F.col("__text").isNull(), F.col("n_chars")).otherwise(F.length("__text").cast("long"))
    return joined.withColumns({"n_chars": n_chars, "text": text}).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    samples = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumnRenamed("item_id", "sample_id")
    rows = docs.withColumn("__key", _digest("text"))
    leaks = contamination.find_leaks(_pages(rows, "__key"), samples).select(F.col("page_id").alias("__key")).distinct()
    return rows.join(leaks, "__key", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in the training sequences."""
    sizes = docs.select(F.col("doc_id").alias("score_id"), n_words(F.col("text")).alias("n_tokens"))
    return packing.pack_sequences(sizes).withColumnRenamed("score_id", "doc_id")


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
