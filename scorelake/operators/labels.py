"""Training tables: splits of samples, heat labels, peaks and their decoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions import box
from scorelake.operators.placement import resolve_parent
from scorelake.operators.problems import first_n
from scorelake.operators.splits import as_lines, derive_measures, normalize_splits
from scorelake.plans.skew import FOLD_ROWS, Hot, attach_row, islands, measure, ordered


def train_val_split(samples: DataFrame, *, ratio: float = 0.25, seed: int = 0, key: str = "sample_id") -> DataFrame:
    """K1: ``part`` train or val; val gets max(1, int(n * ratio)) samples when n > 1.

    Samples are ranked by a seeded hash. The rank needs no global sort: samples are
    counted per hash bucket, only the bucket that holds the border is ranked.
    """
    buckets = 1 << 16
    h = F.xxhash64(F.col(key), F.lit(seed))
    s = samples.withColumn("_h", h).withColumn("_b", F.floor(F.pmod(F.shiftrightunsigned("_h", 48), F.lit(buckets))).cast("int"))
    per = s.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))  # at most ``buckets`` rows
    hist = per.groupBy().agg(F.array_sort(F.collect_list(F.struct("_b", "_c"))).alias("q"), F.sum("_c").alias("n"))
    n_val = F.when(F.col("n") > 1, F.greatest(F.lit(1), F.floor(F.col("n") * ratio))).otherwise(0)
    walk = F.aggregate(
        "q", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(-1).alias("b"), F.lit(0).cast("bigint").alias("need")),
        lambda a, r: F.when(a["b"] >= 0, a).otherwise(
            F.struct(
                (a["seen"] + r["_c"]).alias("seen"),
                F.when(a["seen"] + r["_c"] >= F.col("n_val"), r["_b"]).otherwise(-1).alias("b"),
                (F.col("n_val") - a["seen"]).alias("need"),
            )
        ),
    )
    border = hist.withColumn("n_val", n_val).withColumn("w", walk).select("n_val", F.col("w.b").alias("_cut"), F.col("w.need").alias("_need"))
    s = attach_row(s, border)
    edge = s.where(F.col("_b") == F.col("_cut"))
    edge = ordered(edge, ["_b"], ["_h", key], number="_k")
    inside = edge.where((F.col("_k") <= F.col("_need")) & (F.col("n_val") > 0)).select(key, F.lit(True).alias("_in"))
    out = s.join(inside, key, "left")
    val = (F.col("n_val") > 0) & ((F.col("_b") < F.col("_cut")) | F.coalesce("_in", F.lit(False)))
    return out.withColumn("part", F.when(val, "val").otherwise("train")).drop("_h", "_b", "_cut", "_need", "n_val", "_in")


def build_heat(
    centers: DataFrame, keys: Sequence[str], length: int, sigma: float, *, all_keys: DataFrame | None = None, clip: bool = False
) -> DataFrame:
    """K4: per key the largest Gaussian of any centre at every position, as rows
    (keys, pos, value). ``centers`` carry ``center`` in positions (null and NaN are none); ``clip`` drops
    centres at or beyond the ends.

    Only the nearest centre counts, so each fills the positions up to the middle to its neighbours. Of the centres between two
    positions the outer two can be nearest to any, which bounds what a key brings to its window by twice its length.
    """
    keys = list(keys)
    c = centers.select(*keys, F.col("center").cast("double").alias("center"))
    if clip:
        c = c.where((F.col("center") > 0) & (F.col("center") < length - 1))
    every = (c if all_keys is None else all_keys).select(*keys).distinct()
    cell = F.greatest(F.lit(-1), F.least(F.floor("center"), F.lit(length)))
    spots = c.where(F.col("center").isNotNull() & ~F.isnan("center")).groupBy(*keys, cell.alias("_cell"))
    spots = spots.agg(F.array_distinct(F.array(F.min("center"), F.max("center"))).alias("_c")).select(*keys, F.explode("_c").alias("center"))
    spots = every.join(spots, keys, "left")
    by = Window.partitionBy(*keys).orderBy("center")
    middle = lambda a, b: F.least(F.lit(length), F.greatest(F.lit(0), F.floor((a + b) / 2) + 1))  # the first position nearer to b
    last, next_ = F.lag("center").over(by), F.lead("center").over(by)
    low = F.when(last.isNull(), 0).otherwise(middle(last, F.col("center")))
    high = F.when(next_.isNull(), length).otherwise(middle(F.col("center"), next_)) - 1
    spots = spots.withColumns({"_low": low, "_high": high}).where("_low <= _high")
    z = (F.col("pos") - F.col("center")) / sigma
    pos = spots.withColumn("pos", F.explode(F.sequence(F.col("_low").cast("int"), F.col("_high").cast("int"))))
    return pos.select(*keys, "pos", F.coalesce(F.exp(z * z * -0.5), F.lit(0.0)).alias("value"))


def heat_arrays(heat: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K4: the heat of a key as one array of the fixed label length."""
    keys = list(keys)
    rows = heat.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("r"))
    return rows.select(*keys, F.transform("r", lambda r: r["value"].cast("float")).alias("heat"))


def local_peaks(heat: DataFrame, keys: Sequence[str], *, min_prominence: float = 0.25, hot: Hot | None = None) -> DataFrame:
    """inner positions at least as high as both neighbours and the threshold."""
    h = ordered(heat, keys, ["pos"], lags={"_a": F.col("value")}, leads={"_b": F.col("value")}, hot=hot)
    v = F.col("value")
    return h.where((v >= min_prominence) & (v >= F.col("_a")) & (v >= F.col("_b"))).drop("_a", "_b")


def nms_1d(
    peaks: DataFrame, keys: Sequence[str], min_gap: float | Column, *, hot: Hot | None = None
) -> DataFrame:
    """Keep a peak when no kept peak is nearer than ``min_gap``; by falling value,
    then falling position. Peaks a gap apart never meet, so long keys are cut there."""
    keys = list(keys)
    gap = F.lit(float(min_gap)) if not isinstance(min_gap, Column) else min_gap
    hot = hot or measure(peaks, keys, FOLD_ROWS)
    df = peaks.select(*keys, "pos", "value", gap.alias("_gap"))
    part = keys
    if hot.table is not None:
        df = islands(df, keys, ["pos"], F.col("pos"), F.col("pos"), F.col("_gap"), inclusive=True)
        part = keys + ["_island"]
    row = F.struct((-F.col("value")).alias("v"), (-F.col("pos")).alias("p"))
    lists = df.groupBy(*part).agg(F.array_sort(F.collect_list(row)).alias("r"), F.max("_gap").alias("_gap"))
    kept = F.aggregate(
        "r", F.array().cast(f"array<{dict(df.select(row.alias('x')).dtypes)['x']}>"),
        lambda acc, r: F.when(
            F.forall(acc, lambda k: F.abs(k["p"] - r["p"]) >= F.col("_gap")), F.concat(acc, F.array(r))
        ).otherwise(acc),
    )
    out = lists.select(*keys, F.explode(kept).alias("k"))
    return out.select(*keys, (-F.col("k.p")).alias("pos"), (-F.col("k.v")).alias("value"))


def merge_overlaps(
    boxes: DataFrame, keys: Sequence[str] = ("page_id",), *, share: float = 0.3, hot: Hot | None = None
) -> DataFrame:
    """rows that reach more than ``share`` of the height into the (grown) row before
    them join it. Long pages are cut where a row starts below all rows before it."""
    keys = list(keys)
    hot = hot or measure(boxes, keys, FOLD_ROWS)
    df, part = boxes, keys
    if hot.table is not None:
        df = islands(df, keys, ["y1", "y2", "x1", "x2"], F.col("y1"), F.col("y2"), F.lit(0.0), inclusive=True)
        part = keys + ["_island"]
    row = F.struct("y1", "y2", "x1", "x2")
    lists = df.groupBy(*part).agg(F.array_sort(F.collect_list(row)).alias("r"))

    def join(acc, b):
        last = F.element_at(acc, -1)
        meets = b["y1"] < last["y2"] - (last["y2"] - last["y1"]) * share
        grown = F.struct(
            F.least(last["y1"], b["y1"]).alias("y1"), F.greatest(last["y2"], b["y2"]).alias("y2"),
            last["x1"].alias("x1"), last["x2"].alias("x2"),
        )
        return F.when(
            (F.size(acc) > 0) & meets, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))
        ).otherwise(F.concat(acc, F.array(b)))

    empty = F.array().cast("array<struct<y1:double,y2:double,x1:double,x2:double>>")
    out = lists.select(*keys, F.explode(F.aggregate("r", empty, join)).alias("b")).select(*keys, "b.x1", "b.y1", "b.x2", "b.y2")
    return ordered(out, keys, ["y1", "y2", "x1"], number="_n", hot=hot).withColumn("system_idx", F.col("_n") - 1).drop("_n")


def clip_neighbours(
    boxes: DataFrame, keys: Sequence[str] = ("page_id",), *, hot: Hot | None = None
) -> DataFrame:
    """overlapping neighbour rows meet at the midpoint, moved out of their contents.

    Boxes carry ``system_idx`` and the y range of their content (``c_y1, c_y2``).
    """
    b = ordered(
        boxes, keys, ["system_idx"],
        lags={"_p": F.struct("y1", "y2", "c_y1", "c_y2")}, leads={"_n": F.struct("y1", "y2", "c_y1", "c_y2")}, hot=hot,
    )

    def border(low_y2: Column, low_c2: Column, high_y1: Column, high_c1: Column) -> Column:
        mid = (low_y2 + high_y1) * 0.5
        return F.when(high_c1 >= low_c2, F.least(F.greatest(mid, low_c2), high_c1)).otherwise(mid)

    c = F.col
    top = F.when(c("_p.y2") > c("y1"), border(c("_p.y2"), c("_p.c_y2"), c("y1"), c("c_y1"))).otherwise(c("y1"))
    bottom = F.when(c("y2") > c("_n.y1"), border(c("y2"), c("c_y2"), c("_n.y1"), c("_n.c_y1"))).otherwise(c("y2"))
    return b.withColumns({"_t": top, "_b": bottom}).withColumns({"y1": c("_t"), "y2": c("_b")}).drop("_t", "_b", "_p", "_n")


def crop_rows(
    rows: DataFrame, systems: DataFrame, samples: DataFrame, *, page: tuple[int, int] = (384, 512), max_rows: int | None = None
) -> DataFrame:
    """K5: padded crop of each line row and its row box in model space.

    With ``max_rows`` only the first rows of a sample count; rows without system or area
    are skipped.
    """
    head = first_n(rows, "sample_id", "row_idx", max_rows)
    found = resolve_parent(head, systems, ordinal_fallback=False)
    out = found.join(systems.select("sample_id", "position", *box.SIDES), ["sample_id", "position"]).join(
        samples.select("sample_id", "width", "height"), "sample_id"
    )
    c, w, h = F.col, F.col("width"), F.col("height")
    px, py = (c("x2") - c("x1")) * 0.02, (c("y2") - c("y1")) * 0.05
    whole = lambda v: v.cast("int")  # towards zero
    sx, sy = F.lit(page[1]) / F.greatest(F.lit(1), w), F.lit(page[0]) / F.greatest(F.lit(1), h)
    return out.select(
        "sample_id", "row_idx", "position",
        F.greatest(F.lit(0), whole(c("x1") - px)).alias("crop_x1"), F.greatest(F.lit(0), whole(c("y1") - py)).alias("crop_y1"),
        F.least(w, whole(c("x2") + px)).alias("crop_x2"), F.least(h, whole(c("y2") + py)).alias("crop_y2"),
        (c("x1") * sx).alias("x1"), (c("y1") * sy).alias("y1"), (c("x2") * sx).alias("x2"), (c("y2") * sy).alias("y2"),
    ).where("crop_x2 > crop_x1 AND crop_y2 > crop_y1")


def decode_systems(heat: DataFrame, pages: DataFrame, length: int, *, min_prominence: float = 0.22, band: float = 0.09, margin: float = 0.02) -> DataFrame:
    """K6: row boxes from a y heat: peaks, half height .35 of the median spacing within
    3-12 % of the page, strong overlaps merged; a page without peaks gets its middle band."""
    keys = ["page_id"]
    bound = Hot(("page_id",), FOLD_ROWS) if length <= FOLD_ROWS else measure(heat, keys, FOLD_ROWS)  # one value per position
    peaks = nms_1d(local_peaks(heat, keys, min_prominence=min_prominence, hot=bound), keys, max(3, length // 40), hot=bound)
    span = max(1, length - 1)
    nxt = ordered(peaks, keys, ["pos"], leads={"_b": F.col("pos")}, hot=bound)
    gap = nxt.groupBy(*keys).agg(F.median(F.col("_b") - F.col("pos")).alias("_gap"))
    h, w = F.col("height").cast("double"), F.col("width").cast("double")
    half = F.coalesce(F.col("_gap") / span * h * 0.35, h * band * 0.5)
    half = F.least(F.greatest(half, h * 0.03), h * 0.12)
    cy = F.col("pos") / span * h
    boxes = peaks.join(gap, keys, "left").join(pages, keys).select(
        *keys, (w * margin).alias("x1"), F.greatest(F.lit(0.0), cy - half).alias("y1"),
        (w - w * margin).alias("x2"), F.least(h, cy + half).alias("y2"),
    )
    middle = pages.join(peaks.select(*keys).distinct(), keys, "left_anti").select(
        *keys, (w * margin).alias("x1"), F.greatest(F.lit(0.0), h * 0.5 - h * band * 0.5).alias("y1"),
        (w - w * margin).alias("x2"), F.least(h, h * 0.5 + h * band * 0.5).alias("y2"),
    )
    return merge_overlaps(boxes.unionByName(middle), keys, hot=bound)


def decode_splits(heat: DataFrame, rows: DataFrame, keys: Sequence[str], length: int, *, min_prominence: float = 0.28) -> DataFrame:
    """K6: line positions of a row from its x heat."""
    keys = list(keys)
    bound = Hot(tuple(keys), FOLD_ROWS) if length <= FOLD_ROWS else measure(heat, keys, FOLD_ROWS)  # one value per position
    peaks = nms_1d(local_peaks(heat, keys, min_prominence=min_prominence, hot=bound), keys, max(3, length // 32), hot=bound)
    width = F.greatest(F.lit(1e-3), F.col("x2") - F.col("x1"))
    x = F.col("x1") + F.col("pos") / max(1, length - 1) * width
    return peaks.join(rows.select(*keys, "x1", "x2"), keys).withColumn("x", x).where(
        (F.col("x") > F.col("x1") + 1) & (F.col("x") < F.col("x2") - 1)
    ).select(*keys, "pos", "x")


def layout_from_boxes(systems: DataFrame, xs: DataFrame, *, min_gap: float = 6.0, min_width: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """K7: decoded row boxes and line positions to normalised lines and measures."""
    lines = normalize_splits(as_lines(xs), systems, min_gap=min_gap)
    return lines, derive_measures(systems, lines, min_width=min_width)


def uniform_measures(systems: DataFrame, n: str | int = "n_measures") -> DataFrame:
    """``n`` equal measures per row."""
    count = F.col(n) if isinstance(n, str) else F.lit(n)
    at = F.explode(F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)))
    w = F.greatest(F.lit(0.0), F.col("x2") - F.col("x1"))
    out = systems.withColumn("_n", count).withColumn("measure_idx", at)
    i = F.col("measure_idx")
    return out.withColumns(
        {"_a": F.col("x1") + i * w / F.col("_n"), "_z": F.col("x1") + (i + 1) * w / F.col("_n")}
    ).withColumns({"x1": F.col("_a"), "x2": F.col("_z"), "confidence": F.lit(0.35), "measure_source": F.lit("uniform")}).drop("_a", "_z", "_n")


def split_wide_boxes(boxes: DataFrame, *, keys: Sequence[str] = ("page_id", "system_idx", "measure_idx")) -> DataFrame:
    """boxes wider than a note (1.15 median height, 22 px at least, 25 % slack) cut
    into equal slots, two or more."""
    keys = list(keys)
    h = F.col("y2") - F.col("y1")
    med = boxes.groupBy(*keys).agg(F.coalesce(F.median(F.when(h >= 8, h)), F.lit(20.0)).alias("_m"))
    out = boxes.join(med, keys).withColumn("_w", F.greatest(F.lit(22.0), F.col("_m") * 1.15))
    w = F.col("x2") - F.col("x1")
    n = F.when(w <= F.col("_w") * 1.25, 1).otherwise(F.greatest(F.lit(2), F.ceil(w / F.col("_w")))).cast("int")
    out = out.withColumn("_n", n).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    step = w / F.col("_n")
    return out.withColumns(
        {
            "_a": F.col("x1") + F.col("slot") * step,
            "_z": F.when(F.col("slot") == F.col("_n") - 1, F.col("x2")).otherwise(F.col("x1") + (F.col("slot") + 1) * step),
        }
    ).withColumns({"x1": F.col("_a"), "x2": F.col("_z")}).drop("_a", "_z", "_n", "_w", "_m")
