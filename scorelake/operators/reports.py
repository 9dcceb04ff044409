"""Roll-ups: layered comparison, batch and accuracy reports, gates and baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.operators.matching import (
    box_metrics,
    count_metrics,
    match_xs,
    prf,
    sequence_metrics,
)

METRIC = (
    "sample_id", "layer", "mode", "n_gt", "n_pred", "tp", "fp", "fn", "mean_iou",
    "precision", "recall", "f1",
)


#: What a count rests on where the truth has no geometry, and what a reader of the figure has to know.
WARNINGS = {
    "presence": "the truth has no boxes; only whether any was predicted counts",
    "self": "the truth states no number; the prediction is compared with itself",
    "zero_truth": "the truth states no measures",
    "none": "the truth has nothing to compare with",
}


def _metric_rows(df: DataFrame, basis: str | None = None) -> DataFrame:
    if "mean_iou" not in df.columns:
        df = df.withColumn("mean_iou", F.lit(0.0))
    if basis is not None:
        df = df.withColumn("basis", F.lit(basis))
    counts = [F.col(c).cast("bigint").alias(c) for c in ("n_gt", "n_pred", "tp", "fp", "fn")]
    return df.select("sample_id", "layer", "mode", *counts, "mean_iou", "precision", "recall", "f1", "basis")


def compare_samples(
    samples: DataFrame,
    gt_boxes: DataFrame,
    pred_boxes: DataFrame,
    gt_xs: DataFrame,
    pred_xs: DataFrame,
    gt_tokens: DataFrame,
    pred_tokens: DataFrame,
    *,
    iou: float = 0.5,
    max_dist: float = 12.0,
) -> DataFrame:
    """One metric row per (sample, layer), each layer in the best mode its truth allows.

    ``samples`` lists every sample with ``gt_measures, gt_systems, pred_measures,
    pred_systems`` (counts, null when not declared). A layer with truth boxes is
    matched by overlap, otherwise counts, line positions, tokens or nothing serve. ``basis`` tells what a
    figure rests on: ``boxes``, ``positions``, ``tokens``, a ``stated`` number, ``tokens`` of the truth for its notes, the ``prediction`` alone, or
    one of the keys of ``WARNINGS``.
    """
    pitch = F.coalesce(F.nullif("kind", F.lit("")), F.lit("pitch")) == "pitch"

    def sides(df: DataFrame) -> DataFrame:
        also = df.where((F.col("layer") == "L4") & pitch).withColumn("layer", F.lit("L4_pitch"))
        return df.where(F.col("layer").isin("L1", "L2", "L3", "L4")).unionByName(also)

    gt, pred = sides(gt_boxes), sides(pred_boxes)
    tags = ("L1", "L2", "L3", "L4", "L4_pitch")

    def per_sample(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy("sample_id").agg(
            *[F.count_if(F.col("layer") == t).alias(f"{p}_{t}") for t in tags]
        )

    def size_of(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("sample_id").agg(F.count(F.lit(1)).alias(name))

    flags = samples
    for part in (
        per_sample(gt, "g"), per_sample(pred, "p"), size_of(gt_xs, "g_xs"), size_of(pred_xs, "p_xs"),
        size_of(gt_tokens, "g_tok"), size_of(pred_tokens, "p_tok"),
    ):
        flags = flags.join(part, "sample_id", "left")
    flags = flags.fillna(0, [c for c in flags.columns if c[:2] in ("g_", "p_")])

    known = gt.select("sample_id", "layer").distinct()
    boxes = box_metrics(
        gt.join(known, ["sample_id", "layer"], "left_semi"),
        pred.join(known, ["sample_id", "layer"], "left_semi"),
        iou=iou,
        same_kind=F.col("layer") == "L1",
    )
    c = F.col
    row = lambda when, layer, basis, g, p: F.when(
        when,
        F.struct(
            F.lit(layer).alias("layer"), F.lit("count").alias("mode"), basis.alias("basis"),
            g.cast("bigint").alias("n_gt"), p.cast("bigint").alias("n_pred"),
        ),
    )
    p_sys = F.coalesce(c("pred_systems"), c("p_L2"))
    p_meas = F.coalesce(c("pred_measures"), c("p_L3"))
    one, zero = F.lit(1), F.lit(0)
    no_l4 = c("g_L4") == 0
    counted = flags.select(
        "sample_id",
        F.explode(
            F.array_compact(
                F.array(
                    row(c("g_L1") == 0, "L1", F.lit("presence"), one, F.least(one, c("p_L1"))),
                    row(c("g_L2") == 0, "L2", F.when(c("gt_systems").isNull(), "self").otherwise("stated"), F.coalesce(c("gt_systems"), c("p_L2")),
                        F.when(c("gt_systems").isNotNull(), p_sys).otherwise(c("p_L2"))),
                    row(c("g_L3") == 0, "L3", F.when(F.coalesce(c("gt_measures"), zero) == 0, "zero_truth").otherwise("stated"), F.coalesce(c("gt_measures"), zero), p_meas),
                    row((c("g_xs") == 0) & (c("p_xs") > 0), "L3_barlines", F.lit("prediction"), zero, c("p_xs")),
                    row(no_l4 & (c("g_tok") > 0), "L4", F.lit("tokens"), c("g_tok"), c("p_L4_pitch")),
                )
            )
        ).alias("m"),
    ).select("sample_id", "m.*")
    nothing = flags.select(
        "sample_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(no_l4 & (c("g_tok") == 0), "L4"),
                    F.when((c("g_tok") == 0) & (c("p_tok") == 0), "L5"),
                )
            )
        ).alias("layer"),
    ).select(
        "sample_id", "layer", F.lit("unavailable").alias("mode"),
        *[F.lit(0).cast("bigint").alias(n) for n in ("n_gt", "n_pred", "tp", "fp", "fn")],
        *[F.lit(0.0).alias(n) for n in ("mean_iou", "precision", "recall", "f1")],
    )
    with_xs = gt_xs.select("sample_id").distinct()
    bars = match_xs(
        gt_xs, pred_xs.join(with_xs, "sample_id", "left_semi"), ["sample_id"], max_dist=max_dist
    ).withColumn("layer", F.lit("L3_barlines"))
    tokens = sequence_metrics(gt_tokens, pred_tokens).withColumn("layer", F.lit("L5"))
    out = _metric_rows(boxes, "boxes")
    for part, basis in ((count_metrics(counted), None), (bars, "positions"), (tokens, "tokens"), (nothing, "none")):
        out = out.unionByName(_metric_rows(part, basis))
    return out


def comparison_warnings(compared: DataFrame) -> DataFrame:
    """(sample_id, warnings) for the samples of ``compare_samples`` with figures that rest on no real truth, by layer."""
    said = F.create_map(*[F.lit(x) for pair in WARNINGS.items() for x in pair])[F.col("basis")]
    rows = compared.where(said.isNotNull()).select("sample_id", F.struct("layer", F.concat_ws(": ", "layer", said).alias("text")).alias("w"))
    found = rows.groupBy("sample_id").agg(F.array_sort(F.collect_list("w")).alias("w"))  # a sample has six layers at most
    return found.select("sample_id", F.transform("w", lambda w: w["text"]).alias("warnings"))


def batch_report(metrics: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """E5: mean F1 and counts per layer; samples that failed only count as samples."""
    rows = metrics.select("sample_id", "layer", "f1", "tp", "fp", "fn")
    if errors is not None:
        rows = rows.unionByName(errors.select("sample_id"), allowMissingColumns=True)
    # one pass gives the layers and, as the roll-up's total, the samples
    sums = ["tp", "fp", "fn"]
    agg = rows.rollup("layer").agg(
        F.grouping("layer").alias("_all"),
        F.avg("f1").alias("mean_f1"),
        F.count("f1").alias("n_layer"),
        *[F.sum(c).alias(c) for c in sums],
        F.count_distinct("sample_id").alias("_ids"),
    )
    layer = F.struct("layer", "mean_f1", "n_layer", *sums)
    few = agg.groupBy().agg(  # one row per layer
        F.collect_list(F.when((F.col("_all") == 0) & F.col("layer").isNotNull(), layer)).alias("r"),
        F.max(F.when(F.col("_all") == 1, F.col("_ids"))).alias("n_samples"),
    )
    return few.select(F.explode("r").alias("r"), "n_samples").select("r.*", "n_samples")


def report_matrix(metrics: DataFrame, layers: Sequence[str]) -> DataFrame:
    """F1 of each layer side by side, one row per sample."""
    return metrics.groupBy("sample_id").pivot("layer", list(layers)).agg(F.first("f1"))


def accuracy_summary(rows: DataFrame) -> DataFrame:
    """Overall and per subset: mean and length-weighted scores, hit rates, bar error.

    Rows carry ``subset, error, gt_n, pred_n, lcs, bars_err, key_ok, time_ok``; rows
    with an error are counted but not scored.
    """
    tp = F.col("lcs")
    scored = rows.withColumns(prf(tp, F.col("pred_n") - tp, F.col("gt_n") - tp))
    good = F.col("error").isNull()
    scored = scored.withColumn("subset", F.coalesce("subset", F.lit("?")))
    mean = lambda c: F.coalesce(F.avg(F.when(good, c)), F.lit(0.0))
    total = lambda c: F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0))
    floor1 = lambda c: F.when(c == 0, 1).otherwise(c)
    out = scored.rollup("subset").agg(
        F.grouping("subset").alias("_all"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(good).alias("ok"),
        mean(F.col("f1")).alias("f1_avg"),
        mean(F.col("recall")).alias("recall_avg"),
        mean(F.col("precision")).alias("precision_avg"),
        (total("lcs") / floor1(total("gt_n"))).alias("recall_weighted"),
        (total("lcs") / floor1(total("pred_n"))).alias("_pw"),
        mean(F.col("key_ok").cast("double")).alias("key_accuracy"),
        mean(F.col("time_ok").cast("double")).alias("time_accuracy"),
        F.avg(F.when(good, F.col("bars_err"))).alias("mean_abs_bar_error"),
    )
    r, p = F.col("recall_weighted"), F.col("_pw")
    return out.select(
        F.when(F.col("_all") == 1, "ALL").otherwise(F.col("subset")).alias("subset"),
        "n", "ok", "f1_avg", "recall_avg", "precision_avg",
        F.when(r + p > 0, 2 * r * p / (r + p)).otherwise(0.0).alias("f1_weighted"),
        "recall_weighted", "key_accuracy", "time_accuracy", "mean_abs_bar_error",
    )


def gate(summary: DataFrame, subset: str, min_f1: float) -> DataFrame:
    """Pass when the subset reaches ``min_f1`` and no sample of the run failed."""
    want = "ALL" if subset.lower() in ("all", "*") else subset
    hit = F.col("subset") == want
    out = summary.agg(
        F.max(F.when(hit, F.coalesce(F.nullif("f1_weighted", F.lit(0.0)), "f1_avg"))).alias("f"),
        F.max(F.when(F.col("subset") == "ALL", F.col("n") - F.col("ok"))).alias("errors"),
    )
    return out.select(
        F.lit(subset).alias("subset"),
        F.lit(float(min_f1)).alias("min_f1"),
        F.coalesce("f", F.lit(0.0)).alias("actual_f1"),
        F.coalesce("errors", F.lit(0)).alias("errors"),
        (F.col("f").isNotNull() & (F.col("f") + 1e-9 >= min_f1) & (F.coalesce("errors", F.lit(0)) == 0)).alias("passed"),
    )


def engine_ab(metrics: DataFrame) -> DataFrame:
    """Per engine mean count error, exact rate and position error (missing skipped)."""
    return metrics.groupBy("engine").agg(
        F.avg("count_error").alias("mean_count_error"),
        F.avg("exact").alias("mean_exact"),
        F.avg(F.nanvl("mean_abs_dist", F.lit(None).cast("double"))).alias("mean_abs_x_error"),
        F.count(F.lit(1)).alias("n"),
    )


def engine_ab_wide(metrics: DataFrame, engines: Sequence[str]) -> DataFrame:
    """E7, wide: one row per sample, position error of each engine side by side."""
    return (
        metrics.groupBy("sample_id").pivot("engine", list(engines))
        .agg(F.first("count_error").alias("count_error"), F.first("mean_abs_dist").alias("x_error"))
    )


def diff_baselines(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Change of mean F1 per layer; a missing side counts as 0."""
    cur = current.select("layer", F.col("mean_f1").alias("_c"))
    base = baseline.select("layer", F.col("mean_f1").alias("_b"))
    delta = F.coalesce("_c", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))
    return cur.join(base, "layer", "full_outer").select(
        "layer",
        delta.alias("delta"),
        F.when(delta > 1e-6, "improved").when(delta < -1e-6, "regressed").otherwise("unchanged").alias("status"),
    )


def kind_histogram(df: DataFrame, key: str, kinds: Sequence[str]) -> DataFrame:
    """How often each kind occurs per page (or score)."""
    return df.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def page_extent(boxes: DataFrame, key: str = "page_id") -> DataFrame:
    """Outer box of everything on a page."""
    return boxes.groupBy(key).agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")
    )


def page_summary(pages: DataFrame, **layers: DataFrame) -> DataFrame:
    """Rows of each layer table per page, pages without rows kept.

    ``pitched`` counts note rows that carry a pitch when ``notes`` is given.
    """
    out = pages.select("page_id").distinct()
    for name, df in layers.items():
        aggs = [F.count(F.lit(1)).alias(f"n_{name}")]
        if "pitch" in df.columns:
            aggs.append(F.count("pitch").alias("n_pitched"))
        out = out.join(df.groupBy("page_id").agg(*aggs), "page_id", "left")
    return out.fillna(0)


def training_curve(history: DataFrame) -> DataFrame:
    """Means per (run, epoch) with NaN skipped; the best epoch has the first least loss."""
    clean = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    epochs = history.groupBy("run", "epoch").agg(
        F.avg(clean("train_loss")).alias("train_loss"), F.avg(clean("val_loss")).alias("val_loss")
    )
    best = epochs.groupBy("run").agg(
        F.min_by("epoch", F.when(F.col("val_loss").isNotNull(), F.struct("val_loss", "epoch"))).alias("best_epoch")
    )
    return epochs.join(best, "run").withColumn("is_best", F.col("epoch") == F.col("best_epoch"))


def problem_summary(problems: DataFrame) -> DataFrame:
    """Count, distinct kinds (sorted) and distinct measures of a score's problems."""
    return problems.groupBy("score_id").agg(
        F.count(F.lit(1)).alias("n_problems"),
        F.sort_array(F.collect_set("kind")).alias("kinds"),  # at most the fixed kinds
        F.count_distinct(F.when(F.col("measure") >= 1, F.col("measure"))).alias("n_measures"),
    )


def manifest_stats(manifest: DataFrame) -> DataFrame:
    """Entries, ready and pending ones, per subset and overall."""
    out = manifest.withColumn("subset", F.coalesce("subset", F.lit("?"))).rollup("subset").agg(
        F.grouping("subset").alias("_all"),
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("status") == "ready").alias("ready"),
        F.count_if(F.coalesce(F.col("status"), F.lit("")) != "ready").alias("pending"),
    )
    return out.select(
        F.when(F.col("_all") == 1, "ALL").otherwise(F.col("subset")).alias("subset"),
        "entries", "ready", "pending",
    )
