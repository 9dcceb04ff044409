"""Joins between boxes that share a key.

Both sides carry ``x1, y1, x2, y2``. The boxes of a key of few rows meet by the key, each
box as one row. On crowded keys a pair is formed only inside a tile both boxes cover, so a
crowded page is spread over its tiles and distant boxes of one page never meet.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.plans.lineage import merged
from scorelake.plans.skew import Hot, attach_row, measure

MEET_ROWS = 1_024  # rows of one key, both sides together, up to which its boxes meet by the key
WIDE = 64  # tiles along one side from which a box is not cut into tiles
LEVELS = 6  # nearest search: tile sizes tile * 4**level, then the whole key
STEP = 4

Side = Callable[[str], Column]
Join = Callable[[DataFrame, DataFrame], DataFrame]


def _span(lo: Column, hi: Column, tile: float | Column) -> Column:
    lo = F.floor(lo / tile)
    return F.sequence(lo, F.greatest(lo, F.floor(hi / tile)))


def dense(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Hot:
    """The keys with too many boxes to meet by the key, from the key columns of both sides."""
    return measure(left.select(*keys).unionByName(right.select(*keys)), keys, MEET_ROWS)


def met(left: DataFrame, right: DataFrame, keys: list[str], where: Callable[[Side, Side], Column] | None = None) -> DataFrame:
    """All pairs (``l``, ``r``) of a key; columns stay flat in the join, so it carries only those read after it."""
    name = lambda side, c: c if c in keys else f"_{side}_{c}"
    flat = lambda df, side: df.select(*[F.col(c).alias(name(side, c)) for c in df.columns])
    of = lambda side: lambda c: F.col(name(side, c))
    pairs = merged(flat(left, "l")).join(flat(right, "r"), keys)
    if where is not None:
        pairs = pairs.where(where(of("l"), of("r")))
    row = lambda df, side: F.struct(*[F.col(name(side, c)).alias(c) for c in df.columns]).alias(side)
    return pairs.select(*keys, row(left, "l"), row(right, "r"))


def by_key(left: DataFrame, right: DataFrame, hot: Hot, few: Join, many: Join) -> DataFrame:
    """``few`` on the ordinary keys, ``many`` on the hot ones."""
    if hot.table is None:
        return few(left, right)
    left, right = hot.tag(left), hot.tag(right)
    part = lambda df, h: df.where(F.col("_hot") == h).drop("_hot")
    return few(part(left, False), part(right, False)).unionByName(many(part(left, True), part(right, True)))


def touching(
    left: DataFrame, right: DataFrame, keys: Sequence[str], *, tile: float = 64.0, pad: float = 0.0, hot: Hot | None = None
) -> DataFrame:
    """Pairs (``l``, ``r``) of boxes that meet once the left box is padded by ``pad``.

    ``hot``: the keys (or some of their columns) to be cut into tiles, by default those of :func:`dense`.
    """
    keys = list(keys)

    def meet(l: Side, r: Side) -> Column:
        return (
            (l("x1") - pad <= r("x2")) & (r("x1") <= l("x2") + pad) & (l("y1") - pad <= r("y2")) & (r("y1") <= l("y2") + pad)
        )

    hot = hot or dense(left, right, keys)
    return met(left, right, keys, meet) if hot.table is None else _touching_tiles(left, right, keys, tile, pad, hot)


def _touching_tiles(left: DataFrame, right: DataFrame, keys: list[str], tile: float, pad: float, hot: Hot) -> DataFrame:
    """Each pair comes out once: only in the tile of the common corner. A box of more than
    ``WIDE`` tiles along a side (most of what a page holds touches it) is met by its key
    instead: level 1 holds the wide left boxes, level 2 the wide right ones. Level 3 holds
    the boxes of ordinary keys.
    """
    l = hot.tag(left.select(*keys, F.struct(*left.columns).alias("l")))
    r = hot.tag(right.select(*keys, F.struct(*right.columns).alias("r")))
    lx, ly = F.col("l.x1") - pad, F.col("l.y1") - pad
    cell = lambda lv, x=None, y=None: F.struct(
        F.lit(lv).alias("_lv"), (F.lit(0).cast("bigint") if x is None else x).alias("_tx"),
        (F.lit(0).cast("bigint") if y is None else y).alias("_ty"),
    )

    def tiled(df: DataFrame, x1: Column, y1: Column, x2: Column, y2: Column, wide_in: list[int], small_in: int) -> DataFrame:
        wide = ~((x2 - x1 <= WIDE * tile) & (y2 - y1 <= WIDE * tile))  # also if a side is infinite or no number
        grid = F.flatten(F.transform(_span(x1, x2, tile), lambda x: F.transform(_span(y1, y2, tile), lambda y: cell(0, x, y))))
        cells = F.when(wide, F.array(*[cell(lv) for lv in wide_in])).otherwise(F.concat(grid, F.array(cell(small_in))))
        cells = F.when(F.col("_hot"), cells).otherwise(F.array(cell(3)))
        return df.withColumn("_c", F.explode(cells)).select("*", "_c.*").drop("_c", "_hot")

    l = tiled(l, lx, ly, F.col("l.x2") + pad, F.col("l.y2") + pad, [1], 2)
    r = tiled(r, F.col("r.x1"), F.col("r.y1"), F.col("r.x2"), F.col("r.y2"), [1, 2], 1)
    corner = (F.col("_tx") == F.floor(F.greatest(lx, F.col("r.x1")) / tile)) & (
        F.col("_ty") == F.floor(F.greatest(ly, F.col("r.y1")) / tile)
    )
    return (
        l.join(r, keys + ["_lv", "_tx", "_ty"])
        .where(
            (lx <= F.col("r.x2"))
            & (F.col("r.x1") <= F.col("l.x2") + pad)
            & (ly <= F.col("r.y2"))
            & (F.col("r.y1") <= F.col("l.y2") + pad)
            & ((F.col("_lv") > 0) | corner)
        )
        .drop("_lv", "_tx", "_ty")
    )


def _level(x1: Column, y1: Column, x2: Column, y2: Column, tile: float) -> Column:
    """The finest level on which a box covers 2x2 tiles at most; ``LEVELS`` (the whole key) if there is none."""
    side, out = F.greatest(x2 - x1, y2 - y1), F.lit(LEVELS)
    for level in reversed(range(LEVELS)):
        out = F.when(side <= float(tile) * STEP**level, level).otherwise(out)
    return out


def _size(tile: float) -> Column:
    return F.lit(float(tile)) * F.pow(F.lit(float(STEP)), F.col("_lv"))


def _cells(boxes: DataFrame, tile: float) -> DataFrame:
    """The tiles of a box from its own level up, 2x2 at most on each; ``_own``: on its own level."""
    level = _level(F.col("r.x1"), F.col("r.y1"), F.col("r.x2"), F.col("r.y2"), tile)
    if "_hot" in boxes.columns:  # boxes of ordinary keys live on the level of the whole key
        level = F.when(F.col("_hot"), level).otherwise(LEVELS)
    out = boxes.withColumn("_at", level).drop("_hot")
    out = out.withColumn("_lv", F.explode(F.sequence("_at", F.lit(LEVELS))))
    whole, one = F.col("_lv") == LEVELS, F.array(F.lit(0).cast("bigint"))
    out = out.withColumn("_tx", F.explode(F.when(whole, one).otherwise(_span(F.col("r.x1"), F.col("r.x2"), _size(tile)))))
    out = out.withColumn("_ty", F.explode(F.when(whole, one).otherwise(_span(F.col("r.y1"), F.col("r.y2"), _size(tile)))))
    return out.withColumn("_own", F.col("_lv") == F.col("_at")).drop("_at")


def near(
    left: DataFrame, right: DataFrame, keys: Sequence[str], *, tile: float = 64.0, hot: Hot | None = None
) -> DataFrame:
    """Pairs (``l``, ``r``) that are sure to hold the nearest right box of each left point.

    The left point is (``px``, ``py``); distance is any norm of the edge distances
    between the larger of the two (max) and their sum. ``hot`` as in :func:`touching`.
    """
    keys = list(keys)
    hot = hot or dense(left, right, keys)
    return met(left, right, keys) if hot.table is None else _near_tiles(left, right, keys, tile, hot)


def _near_tiles(left: DataFrame, right: DataFrame, keys: list[str], tile: float, hot: Hot) -> DataFrame:
    """Points and boxes of ordinary keys meet on the level of the whole key.

    Of the others, a box lives on the finest level where it covers at most 2x2 tiles and is listed from there up, so its rows
    don't grow with its size, and one without end belongs to the whole key. The finest level whose 3x3 tiles around the point
    hold a listed box bounds the distance by four tiles, so the 3x3 tiles one level up hold every box listed there that can be
    nearer; larger ones are met around the point on their own levels, as far as any box lives there. Tiles are pre-aggregated,
    each with its eight neighbours, so a point asks for one tile a level; the whole key is searched only when all levels are
    empty, or for a point that isn't finite.
    """
    l = hot.tag(left).select(*keys, "_hot", F.struct(*left.columns).alias("l"), F.col("px").alias("_px"), F.col("py").alias("_py"))
    r = hot.tag(right.select(*keys, F.struct(*right.columns).alias("r")))
    cells = _cells(r, tile)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spot = [*keys, "_lv", "_tx", "_ty"]

    def tiles(df: DataFrame, by: Column) -> DataFrame:
        """The tile of the point, or each of the nine tiles around it, on the level ``_lv``."""
        whole = F.col("_lv") == LEVELS
        x = F.when(whole, 0).otherwise(F.floor(F.col("_px") / _size(tile)) + by["i"])
        y = F.when(whole, 0).otherwise(F.floor(F.col("_py") / _size(tile)) + by["j"])
        return df.withColumns({"_tx": x.cast("bigint"), "_ty": y.cast("bigint")})

    taken = cells.where(F.col("_lv") < LEVELS).select(*spot).distinct().withColumn("_d", F.explode(around))
    taken = taken.select(*keys, "_lv", (F.col("_tx") + F.col("_d.i")).alias("_tx"), (F.col("_ty") + F.col("_d.j")).alias("_ty")).distinct()
    finite = F.col("_hot") & (F.abs("_px") < float("inf")) & (F.abs("_py") < float("inf"))
    probe = l.withColumn("_lv", F.explode(F.when(finite, F.sequence(F.lit(0), F.lit(LEVELS - 1))).otherwise(F.array(F.lit(LEVELS))))).drop("_hot")
    found = tiles(probe, F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))).join(taken.withColumn("_hit", F.lit(True)), spot, "left")
    level = found.groupBy(*keys, "l", "_px", "_py").agg(F.least(F.coalesce(F.min(F.when(F.col("_hit"), F.col("_lv"))) + 1, F.lit(LEVELS)), F.lit(LEVELS)).alias("_lv"))
    # levels on which boxes live that the search above doesn't list
    homes = attach_row(level, cells.where("_own and _lv > 1").agg(F.array_sort(F.collect_set("_lv")).alias("_homes")))
    wanted = F.concat(
        F.array(F.struct("_lv", F.lit(False).alias("_own"))),
        F.transform(F.filter("_homes", lambda h: h > F.col("_lv")), lambda h: F.struct(h.alias("_lv"), F.lit(True).alias("_own"))),
    )
    asked = homes.withColumn("_w", F.explode(wanted)).select(*keys, "l", "_px", "_py", "_w.*")
    asked = asked.withColumn("_d", F.explode(F.when(F.col("_lv") == LEVELS, F.slice(around, 1, 1)).otherwise(around)))
    asked = tiles(asked, F.col("_d")).drop("_d")
    listed = cells.withColumn("_own", F.explode(F.when(F.col("_own") & (F.col("_lv") > 1), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    return asked.join(listed, [*spot, "_own"]).select(*keys, "l", "r")
