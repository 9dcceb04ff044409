"""Prediction-to-truth matching of boxes, line positions and token sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions import box
from scorelake.functions.lcs import lcs_length
from scorelake.operators.sequences import long_lcs
from scorelake.plans.greedy import WALK_BOXES, crowded, greedy_pairs
from scorelake.plans.lineage import merged
from scorelake.plans.skew import FOLD_ROWS, Hot, islands, measure
from scorelake.plans.spatial import dense, touching

SEQUENCE_TOKENS = 65_536  # tokens of one sample that one LCS call may take


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1; an empty side is perfect only if the other is empty too."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.when(fn == 0, 1.0).otherwise(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.when(fp == 0, 1.0).otherwise(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return {"precision": p, "recall": r, "f1": f1}


def box_edges(
    gt: DataFrame,
    pred: DataFrame,
    keys: Sequence[str],
    iou: float,
    same_kind: Column | bool = False,
    tile: float = 64.0,
    hot: Hot | None = None,
) -> DataFrame:
    """Candidate pairs (gi, pi, w) with overlap of at least ``iou`` (> 0)."""
    if iou <= 0:
        raise ValueError("the overlap threshold must be above 0")
    cols = list(dict.fromkeys([*keys, "box_idx", "kind", *box.SIDES]))
    sound = lambda df: df.select(*cols).where(box.valid())
    pairs = touching(sound(gt), sound(pred), keys, tile=tile, hot=hot)
    if same_kind is not False:
        named = (F.coalesce("l.kind", F.lit("")) != "") & (F.coalesce("r.kind", F.lit("")) != "")
        rule = F.lit(True) if same_kind is True else same_kind
        pairs = pairs.where(~(rule & named & (F.col("l.kind") != F.col("r.kind"))))
    return pairs.select(
        *keys,
        F.col("l.box_idx").alias("gi"),
        F.col("r.box_idx").alias("pi"),
        box.iou("l", "r").alias("w"),
    ).where(F.col("w") >= iou)


def _walks(gt: DataFrame, pred: DataFrame, keys: list[str], met: Hot) -> Hot:
    """The keys too large for one walk, from those too large to meet by the key."""
    return met.above(WALK_BOXES) or crowded(gt, pred, keys)


def match_boxes(
    gt: DataFrame,
    pred: DataFrame,
    keys: Sequence[str] = ("sample_id", "layer"),
    *,
    iou: float = 0.5,
    same_kind: Column | bool = False,
    tile: float = 64.0,
    hot: Hot | None = None,
) -> DataFrame:
    """Greedy one-to-one pairs by falling overlap, ties by truth then prediction index."""
    keys, met = list(keys), dense(gt, pred, keys)
    edges = box_edges(gt, pred, keys, iou, same_kind, tile, met).withColumn("_o", -F.col("w"))
    pairs = greedy_pairs(edges, keys, ["_o", "gi", "pi"], hot or _walks(gt, pred, keys, met))
    return pairs.withColumnsRenamed({"gi": "gt_idx", "pi": "pred_idx", "w": "iou"})


def match_errors(
    gt: DataFrame, pred: DataFrame, pairs: DataFrame, keys: Sequence[str] = ("sample_id", "layer")
) -> DataFrame:
    """One row per true positive, false positive and false negative box."""
    keys = list(keys)
    none = F.lit(None)
    tp = pairs.select(*keys, F.lit("tp").alias("outcome"), "gt_idx", "pred_idx", "iou")
    fp = pred.select(*keys, F.col("box_idx").alias("pred_idx")).join(
        pairs.select(*keys, "pred_idx"), keys + ["pred_idx"], "left_anti"
    )
    fn = gt.select(*keys, F.col("box_idx").alias("gt_idx")).join(
        pairs.select(*keys, "gt_idx"), keys + ["gt_idx"], "left_anti"
    )
    gt_type, pred_type = dict(pairs.dtypes)["gt_idx"], dict(pairs.dtypes)["pred_idx"]
    fp = fp.select(
        *keys, F.lit("fp").alias("outcome"), none.cast(gt_type).alias("gt_idx"), "pred_idx",
        none.cast("double").alias("iou"),
    )
    fn = fn.select(
        *keys, F.lit("fn").alias("outcome"), "gt_idx", none.cast(pred_type).alias("pred_idx"),
        none.cast("double").alias("iou"),
    )
    return tp.unionByName(fp).unionByName(fn)


def side_counts(gt: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key on each side, keys of either side kept, in one aggregation."""
    both = gt.select(*keys, F.lit(1).alias("g")).unionByName(
        pred.select(*keys, F.lit(0).alias("g"))
    )
    return both.groupBy(*keys).agg(
        F.count_if(F.col("g") == 1).alias("n_gt"), F.count_if(F.col("g") == 0).alias("n_pred")
    )


def box_metrics(
    gt: DataFrame,
    pred: DataFrame,
    keys: Sequence[str] = ("sample_id", "layer"),
    *,
    pairs: DataFrame | None = None,
    **options,
) -> DataFrame:
    """D1 + E1: counts, mean overlap and precision/recall/F1 per key."""
    keys = list(keys)
    if pairs is None:
        pairs = match_boxes(gt, pred, keys, **options)
    hits = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tp"), F.avg("iou").alias("mean_iou")
    )
    out = merged(side_counts(gt, pred, keys)).join(hits, keys, "left")
    out = out.withColumns(
        {"tp": F.coalesce("tp", F.lit(0)), "mean_iou": F.coalesce("mean_iou", F.lit(0.0))}
    ).withColumns({"fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_gt") - F.col("tp")})
    return out.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn"))).withColumn(
        "mode", F.lit("iou")
    )


def count_metrics(df: DataFrame, n_gt: str = "n_gt", n_pred: str = "n_pred") -> DataFrame:
    """Agreement of two counts per row."""
    g, p = F.col(n_gt), F.col(n_pred)
    zero = F.lit(0)
    out = df.withColumns(
        {
            "tp": F.least(g, p),
            "fp": F.greatest(zero, p - g),
            "fn": F.greatest(zero, g - p),
            "abs_delta": F.abs(p - g),
        }
    )
    return out.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def match_xs(
    gt: DataFrame,
    pred: DataFrame,
    keys: Sequence[str] = ("sample_id",),
    *,
    max_dist: float | Column = 12.0,
    hot: Hot | None = None,
) -> DataFrame:
    """Truth positions in ascending order take the nearest free predicted position.

    The result depends only on how often each position occurs, so positions are
    pre-aggregated to (x, copies) before the shuffle; a key with very many
    distinct positions is cut wherever neighbours are more than ``max_dist``
    apart, where no match can cross. ``max_dist`` may be a column over the keys.
    """
    keys = list(keys)
    limit = F.lit(float(max_dist)) if not isinstance(max_dist, Column) else max_dist
    both = gt.select(*keys, "x", F.lit(1).alias("g")).unionByName(
        pred.select(*keys, "x", F.lit(0).alias("g"))
    )
    both = both.where(F.col("x").isNotNull() & ~F.isnan("x"))
    spots = both.groupBy(*keys, "x").agg(F.sum("g").alias("g"), F.sum(1 - F.col("g")).alias("p"))
    spots = spots.withColumn("_lim", limit)
    hot = hot or measure(spots, keys, FOLD_ROWS)
    part = keys
    if hot.table is not None:
        spots = islands(spots, keys, ["x"], F.col("x"), F.col("x"), F.col("_lim"))
        part = keys + ["_island"]
    lists = spots.groupBy(*part).agg(
        F.array_sort(F.collect_list(F.when(F.col("g") > 0, F.struct("x", F.col("g").alias("n"))))).alias("gs"),
        F.array_sort(F.collect_list(F.when(F.col("p") > 0, F.struct("x", F.col("p").alias("n"))))).alias("ps"),
        F.max("_lim").alias("_lim"),
    )
    free = "array<struct<x:double,n:bigint>>"

    whole = F.lit(0).cast("bigint")
    empty = F.array().cast("array<struct<d:double,x:double,n:bigint>>")

    def let(value, use):
        """Evaluate ``value`` once inside a lambda."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def take(acc, g):
        inside = F.filter(acc["free"], lambda p: F.abs(p["x"] - g["x"]) <= F.col("_lim"))
        ranked = F.array_sort(
            F.transform(
                inside,
                lambda p: F.struct(F.abs(p["x"] - g["x"]).alias("d"), p["x"].alias("x"), p["n"].alias("n")),
            )
        )
        got = F.aggregate(
            ranked,
            F.struct(g["n"].alias("need"), empty.alias("got")),
            lambda s, c: F.struct(
                (s["need"] - F.least(s["need"], c["n"])).alias("need"),
                F.when(
                    s["need"] > 0,
                    F.concat(
                        s["got"],
                        F.array(
                            F.struct(
                                c["d"].alias("d"), c["x"].alias("x"), F.least(s["need"], c["n"]).alias("n")
                            )
                        ),
                    ),
                ).otherwise(s["got"]).alias("got"),
            ),
            lambda s: s["got"],
        )

        def left(t):
            """Free copies after ``t`` is taken; used-up positions are gone."""
            near = F.transform(
                F.filter(acc["free"], lambda p: F.exists(t, lambda u: u["x"] == p["x"])),
                lambda p: F.struct(
                    p["x"].alias("x"),
                    (p["n"] - F.aggregate(F.filter(t, lambda u: u["x"] == p["x"]), whole, lambda a, u: a + u["n"])).alias("n"),
                ),
            )
            rest = F.filter(acc["free"], lambda p: ~F.exists(t, lambda u: u["x"] == p["x"]))
            return F.concat(rest, F.filter(near, lambda p: p["n"] > 0)).cast(free)

        return let(
            got,
            lambda t: F.when(F.size(t) == 0, acc).otherwise(
                F.struct(
                    left(t).alias("free"),
                    (acc["tp"] + F.aggregate(t, whole, lambda a, u: a + u["n"])).alias("tp"),
                    (acc["dist"] + F.aggregate(t, F.lit(0.0), lambda a, u: a + u["d"] * u["n"])).alias("dist"),
                )
            ),
        )

    start = F.struct(F.col("ps").cast(free).alias("free"), F.lit(0).cast("bigint").alias("tp"), F.lit(0.0).alias("dist"))
    done = lists.withColumn("m", F.aggregate("gs", start, take))
    n_of = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, t: a + t["n"])
    out = done.select(
        *keys, n_of("gs").alias("n_gt"), n_of("ps").alias("n_pred"), "m.tp", F.col("m.dist").alias("dist")
    )
    if part != keys:
        out = out.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n_gt", "n_pred", "tp", "dist")])
    out = out.withColumns(
        {
            "fp": F.col("n_pred") - F.col("tp"),
            "fn": F.col("n_gt") - F.col("tp"),
            "mean_abs_dist": F.when(F.col("tp") > 0, F.col("dist") / F.col("tp")),
            "count_error": F.abs(F.col("n_pred") - F.col("n_gt")),
            "exact": F.when(F.col("n_pred") == F.col("n_gt"), 1.0).otherwise(0.0),
        }
    ).drop("dist")
    return out.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn"))).withColumn(
        "mode", F.lit("x_distance")
    )


def mean_best_iou(
    gt: DataFrame,
    pred: DataFrame,
    keys: Sequence[str] = ("sample_id",),
    *,
    tile: float = 64.0,
    hot: Hot | None = None,
) -> DataFrame:
    """D3: each truth box in order takes its best free prediction; mean over truth boxes."""
    keys = list(keys)
    tiny = 5e-324  # any overlap above zero
    met = dense(gt, pred, keys)
    edges = box_edges(gt, pred, keys, tiny, False, tile, met).withColumn("_o", -F.col("w"))
    pairs = greedy_pairs(edges, keys, ["gi", "_o", "pi"], hot or _walks(gt, pred, keys, met))
    total = pairs.groupBy(*keys).agg(F.sum("w").alias("_sum"))
    out = side_counts(gt, pred, keys).join(total, keys, "left")
    mean = F.when(F.col("n_gt") > 0, F.coalesce("_sum", F.lit(0.0)) / F.col("n_gt")).otherwise(0.0)
    return out.withColumn("mean_iou", mean).drop("_sum")


def sequence_metrics(
    gt: DataFrame,
    pred: DataFrame,
    keys: Sequence[str] = ("sample_id",),
    *,
    hot: Hot | None = None,
) -> DataFrame:
    """Longest common token subsequence per key, scored as precision/recall/F1.

    Inputs are token rows (keys, pos, token). Samples longer than
    ``SEQUENCE_TOKENS`` go through the blocked form, others through one Arrow call.
    """
    keys = list(keys)
    both = gt.select(*keys, "pos", "token", F.lit(1).alias("g")).unionByName(
        pred.select(*keys, "pos", "token", F.lit(0).alias("g"))
    )
    hot = hot or measure(both, keys, SEQUENCE_TOKENS)
    ordinary, long = both, None
    if hot.table is not None:
        tagged = hot.tag(both)
        ordinary = tagged.where(~F.col("_hot")).drop("_hot")
        long = long_lcs(
            tagged.where("_hot").where("g = 1").drop("_hot", "g"),
            tagged.where("_hot").where("g = 0").drop("_hot", "g"),
            keys,
        )
    token = F.struct("pos", "token")
    lists = ordinary.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("g") == 1, token))).alias("a"),
        F.array_sort(F.collect_list(F.when(F.col("g") == 0, token))).alias("b"),
    )
    out = lists.select(
        *keys,
        F.size("a").cast("bigint").alias("n_gt"),
        F.size("b").cast("bigint").alias("n_pred"),
        lcs_length(F.col("a.token"), F.col("b.token")).alias("lcs"),
    )
    if long is not None:
        out = out.unionByName(long)
    out = out.withColumns(
        {"tp": F.col("lcs"), "fp": F.col("n_pred") - F.col("lcs"), "fn": F.col("n_gt") - F.col("lcs")}
    )
    return out.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn"))).withColumn(
        "mode", F.lit("sequence")
    )
