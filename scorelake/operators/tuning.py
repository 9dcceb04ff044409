"""Parameter grids, layer loss and sweeps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions import box
from scorelake.operators.matching import box_metrics
from scorelake.operators.splits import derive_measures, normalize_splits
from scorelake.plans.lineage import cut, merged, written
from scorelake.plans.skew import FOLD_ROWS, Hot, attach_row, measure, small

GRID_PARTS = 4  # parts that rows are dealt to when they meet a grid
WEIGHTS = {"w_iou": 1.0, "w_cnt": 0.5, "w_fn": 0.35, "w_fp": 0.25}


def param_grid(spark: SparkSession, start: float, stop: float, step: float) -> DataFrame:
    """K3: inclusive grid with a guard against float drift, values rounded to 6 digits."""
    if step <= 0:
        raise ValueError("step must be above 0")
    lo, hi = min(start, stop), max(start, stop)
    n = int((hi - lo) / step + 1e-9) + 1
    return spark.range(n).select(
        F.col("id").alias("trial"), F.round(F.lit(lo) + F.col("id") * F.lit(step), 6).alias("value")
    )


def linspace_grid(spark: SparkSession, start: float, stop: float, trials: int, *, most: int | None = None) -> DataFrame:
    """K3, second form: ``trials`` evenly spaced values (at most ``most``), rounded to 2 digits."""
    n = max(1, trials if most is None else min(trials, most))
    gap = (stop - start) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select(
        (F.col("id") + 1).alias("trial"), F.round(F.lit(start) + F.col("id") * F.lit(gap), 2).alias("value")
    )


def sample_params(
    spark: SparkSession,
    space: Mapping[str, Mapping],
    trials: int,
    seed: int,
    fixed: Mapping[str, float] | None = None,
) -> DataFrame:
    """K2: uniform draws per parameter over a fixed base; trial 0 is the base itself.

    A draw depends only on (seed, trial, name), so any part of the table can be
    recomputed alone.
    """
    fixed = dict(fixed or {})
    df = spark.range(1, max(trials, 1)).withColumnRenamed("id", "trial")
    values = {k: F.lit(float(v)) for k, v in fixed.items()}
    for name, spec in space.items():
        bits = F.pmod(F.xxhash64(F.lit(seed), F.col("trial"), F.lit(name)), F.lit(1 << 53))
        u = bits / F.lit(float(1 << 53))
        kind = spec.get("type", "float")
        if kind == "bool":
            values[name] = F.when(u < 0.5, 0.0).otherwise(1.0)
        else:
            lo = float(spec.get("low", 0.0))
            hi = float(spec.get("high", lo))
            values[name] = F.floor(u * (hi - lo + 1) + lo).cast("double") if kind == "int" else u * (hi - lo) + lo
    entries = lambda vs: F.map_from_entries(
        F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in vs.items()])
    )
    base = spark.range(1).select(
        F.col("id").alias("trial"), entries({k: F.lit(float(v)) for k, v in fixed.items()} or {"_": F.lit(None)}).alias("params")
    )
    drawn = df.select("trial", entries(values or {"_": F.lit(None)}).alias("params"))
    return base.unionByName(drawn)


def effective_params(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """Defaults per layer overlaid by overrides; unknown names are ignored."""
    return defaults.join(overrides.withColumnRenamed("params", "_o"), "layer", "left").select(
        "layer",
        F.transform_values(
            "params", lambda k, v: F.coalesce(F.try_element_at(F.col("_o"), k), v)
        ).alias("params"),
    )


def layer_loss(metrics: DataFrame, **weights: float) -> DataFrame:
    """Loss and score per row of box metrics."""
    w = WEIGHTS | weights
    n_gt, n_pred = F.col("n_gt"), F.col("n_pred")
    floor = F.greatest(n_gt, F.lit(1))
    count = F.least(F.lit(1.0), F.abs(n_pred - n_gt) / floor)
    fp_rate = F.when(n_pred > 0, F.col("fp") / n_pred).otherwise(F.when(n_gt == 0, 0.0).otherwise(1.0))
    hit = F.when(F.col("tp") > 0, F.col("mean_iou")).otherwise(0.0)
    loss = (
        F.lit(w["w_iou"]) * (1.0 - hit)
        + F.lit(w["w_cnt"]) * count
        + F.lit(w["w_fn"]) * (F.col("fn") / floor)
        + F.lit(w["w_fp"]) * fp_rate
    )
    return metrics.withColumn("loss", loss).withColumn("score", F.greatest(F.lit(0.0), 1.0 - F.col("loss")))


def _for_trials(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Every row of ``df`` with every trial of ``grid``: a hash join by a part of the trials.

    A grid of few rows is broadcast, a large one is shuffled; ``df`` is never broadcast.
    """
    part = F.pmod(F.hash("trial"), F.lit(GRID_PARTS))
    return merged(df).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(GRID_PARTS - 1)))).join(
        grid.withColumn("_part", part), "_part"
    ).drop("_part")


def _box_number(measures: DataFrame) -> Column:
    """A measure's place on its page, as one number where that sorts like the pair, which the matching walk takes much faster."""
    if dict(measures.dtypes)["system_idx"] not in ("tinyint", "smallint", "int"):
        return F.struct("system_idx", "measure_idx")
    return F.col("system_idx").cast("bigint") * (1 << 31) + F.col("measure_idx")


def param_sweep(
    candidates: DataFrame,
    systems: DataFrame,
    truth: DataFrame,
    grid: DataFrame,
    *,
    iou: float = 0.5,
    hot: Hot | None = None,
    **weights: float,
) -> DataFrame:
    """Loss and F1 of every (trial, page): thin lines, derive measures, match, score.

    ``candidates`` (page_id, system_idx, x, ...) are detected lines, ``systems`` the
    rows, ``truth`` measure boxes (page_id, box_idx, box). ``grid`` carries ``trial,
    min_gap, min_width`` and may have any number of rows.
    """
    grid = grid.select(F.col("trial").cast("bigint").alias("trial"), F.col("min_gap").cast("double").alias("min_gap"),
                       F.col("min_width").cast("double").alias("min_width"))
    keys = ["trial", "page_id", "system_idx"]
    grid = small(grid, grid.count())
    spread = lambda df: _for_trials(df, grid)
    hot = hot or measure(candidates, ["page_id", "system_idx"], FOLD_ROWS)
    # each table is read by several later steps: thinning reads the rows, measures and matching the lines and boxes
    rows = spread(written(systems.select("page_id", "system_idx", *box.SIDES)))
    lines = spread(candidates).drop("min_gap", "min_width")
    thin = normalize_splits(lines, rows, keys, min_gap=F.col("min_gap"), hot=_over(hot, keys, rows))
    thin = written(thin.select(*keys, "x"))
    boxes = derive_measures(rows, thin, keys, min_width=F.col("min_width"), hot=_over(hot, keys, rows))
    pred = boxes.select(
        "trial", "page_id",
        _box_number(boxes).alias("box_idx"),
        F.lit("").alias("kind"), *box.SIDES,
    )
    pred = written(pred)
    gt = spread(written(truth.select("page_id", "box_idx", *box.SIDES))).select("trial", "page_id", "box_idx", F.lit("").alias("kind"), *box.SIDES)
    metrics = box_metrics(gt, pred, ["trial", "page_id"], iou=iou, tile=256.0)
    return layer_loss(metrics, **weights)


def _over(hot: Hot, keys: list[str], rows: DataFrame) -> Hot:
    """Hot pages are hot in every trial."""
    if hot.table is None:
        return Hot(tuple(keys), hot.limit)
    trials = rows.select("trial", *hot.keys).join(hot.table, list(hot.keys), "left_semi").distinct()
    return Hot(tuple(keys), hot.limit, trials, trials.count())


def sweep_summary(losses: DataFrame, *, objective: str = "loss") -> DataFrame:
    """Mean loss, score and F1 per trial over pages, marked against trial 0.

    ``improved`` keeps the permissive rule (not worse than the baseline);
    ``strictly_improved`` is the plain one.
    """
    per = losses.groupBy("trial").agg(
        F.avg("loss").alias("loss"), F.avg("score").alias("score"), F.avg("f1").alias("f1"),
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
    )
    sign = 1 if objective == "loss" else -1
    goal = sign * F.col(objective)
    per = cut(per)  # one row per trial
    few = per.agg(
        F.min_by("trial", F.struct(goal.alias("g"), F.col("trial"))).alias("best"),
        F.max(F.when(F.col("trial") == 0, goal)).alias("base"),
    )
    out = attach_row(per, few)
    better = goal - F.col("base")
    return out.select(
        *per.columns,
        (F.col("trial") == F.col("best")).alias("is_best"),
        (better <= 1e-12).alias("improved"),
        (better < -1e-12).alias("strictly_improved"),
    )


def best_trial(trials: DataFrame, *, objective: str = "loss", by: str | None = "layer") -> DataFrame:
    """H2: the trial with the best objective, the first one on a tie."""
    sign = 1 if objective == "loss" else -1
    pick = F.min_by(F.struct(*[c for c in trials.columns if c != by]), F.struct(sign * F.col(objective), F.col("trial")))
    grouped = trials.groupBy(by) if by else trials.groupBy()
    return grouped.agg(pick.alias("b")).select(*([by] if by else []), "b.*")
