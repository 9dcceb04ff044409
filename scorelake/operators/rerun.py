"""Joining a re-run with a user's draft, measures across lines, and display slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions import box
from scorelake.operators.pages import RANK, item_key
from scorelake.plans.lineage import cut
from scorelake.plans.skew import FOLD_ROWS, Hot, measure, ordered
from scorelake.plans.spatial import near, touching

PAGE = ["page_id"]


def merge_rerun(draft: DataFrame, response: DataFrame, from_layer: str, *, tile: float = 128.0) -> DataFrame:
    """Response items with the draft's geometry where the user owns it.

    At and above ``from_layer`` the draft box of the same id wins; below it an L5 item
    takes the box of its L4 slot. For L3 the response order rules, see
    :func:`merge_measures`. Items are rows (page_id, item_idx, layer, id, label, kind, box).
    """
    if from_layer == "L3":
        return merge_measures(draft, response, tile=tile)
    sides = F.struct(*box.SIDES)
    top = [k for k, v in RANK.items() if v <= RANK[from_layer]]
    mine = draft.groupBy(*PAGE, item_key().alias("key")).agg(F.max_by(F.struct(*box.SIDES, "label", "kind"), "item_idx").alias("d"))
    out = response.withColumn("key", item_key()).join(mine, PAGE + ["key"], "left")
    if from_layer in ("L4", "L5"):
        m = r"(?i)^l4-m(\d+)-(?:pitch|chord|lyric)?(\d+)$"
        slot = draft.where((F.col("layer") == "L4") & F.col("id").rlike(m)).withColumn(
            "key", F.concat(F.lit("l5-m"), F.regexp_extract("id", m, 1), F.lit("-n"), F.regexp_extract("id", m, 2))
        )
        slot = slot.groupBy(*PAGE, "key").agg(F.max_by(sides, "item_idx").alias("s"))
        out = out.join(slot, PAGE + ["key"], "left")
    else:
        out = out.withColumn("s", F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>"))
    own = F.col("layer").isin(*top)
    low = (F.col("layer") == "L5") & ~own
    take = lambda n: F.when(own, F.coalesce(f"d.{n}", n)).when(low, F.coalesce(f"s.{n}", n)).otherwise(F.col(n))
    out = out.withColumns(
        {n: take(n) for n in box.SIDES}
        | {"label": F.when(own, F.coalesce(F.nullif("d.label", F.lit("")), "label")).otherwise(F.col("label")),
           "kind": F.when(own, F.coalesce("d.kind", "kind")).otherwise(F.col("kind"))}
    )
    return out.drop("key", "d", "s")


def _in_order(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Each response box in order takes the nearest free draft box of its page."""
    point = F.struct("item_idx", "px", "py")
    lists = lambda df, name: df.groupBy(*PAGE).agg(F.array_sort(F.collect_list(point)).alias(name))
    both = lists(theirs, "rs").join(lists(mine, "ds"), PAGE)
    kind = dict(mine.dtypes)["item_idx"]
    pair = f"array<struct<item_idx:{dict(theirs.dtypes)['item_idx']},draft_idx:{kind}>>"

    def step(acc, r):
        near_by = F.transform(
            acc["free"],
            lambda d: F.struct(
                ((d["px"] - r["px"]) * (d["px"] - r["px"]) + (d["py"] - r["py"]) * (d["py"] - r["py"])).alias("d"),
                d["item_idx"].alias("i"),
            ),
        )
        best = F.array_min(near_by)
        use = lambda b: F.struct(
            F.filter(acc["free"], lambda d: d["item_idx"] != b["i"]).alias("free"),
            F.concat(acc["out"], F.array(F.struct(r["item_idx"].alias("item_idx"), b["i"].alias("draft_idx")))).alias("out"),
        )
        return F.element_at(F.transform(F.array(best), lambda b: F.when(b.isNull(), acc).otherwise(use(b))), 1)

    start = F.struct(F.col("ds").alias("free"), F.array().cast(pair).alias("out"))
    got = F.aggregate("rs", start, step, lambda s: s["out"])
    return both.select(*PAGE, F.explode(got).alias("p")).select(*PAGE, "p.item_idx", "p.draft_idx")


def _propose(mine: DataFrame, theirs: DataFrame, tile: float) -> DataFrame:
    """In-order choice on crowded pages by proposals.

    Every response without a box asks for the nearest draft box that is free or held by a
    later response; a draft box keeps the earliest asker. Askers that lose ask again, until
    nobody asks. Free boxes are found through the tile pyramid, held ones only within the
    distance of the nearest free one.
    """
    mine, theirs = cut(mine), cut(theirs)
    held = mine.select(*PAGE, F.col("item_idx").alias("draft_idx"), F.lit(None).cast(dict(theirs.dtypes)["item_idx"]).alias("item_idx"), "px", "py")
    held = cut(held)
    at = lambda df: df.withColumns({"x1": F.col("px"), "x2": F.col("px"), "y1": F.col("py"), "y2": F.col("py")})
    dx, dy = F.col("r.px") - F.col("l.px"), F.col("r.py") - F.col("l.py")
    dist = dx * dx + dy * dy
    wishes = lambda pairs: pairs.select(
        *PAGE, F.col("l.item_idx").alias("item_idx"), F.struct(dist.alias("d"), F.col("r.draft_idx").alias("draft_idx")).alias("c")
    )
    best_of = lambda w: w.groupBy(*PAGE, "item_idx").agg(F.min("c").alias("c"))
    given_up = None
    while True:
        asks = theirs.join(held.where("item_idx IS NOT NULL"), PAGE + ["item_idx"], "left_anti")
        if given_up is not None:
            asks = asks.join(given_up, PAGE + ["item_idx"], "left_anti")
        asks = cut(asks)
        if asks.isEmpty():
            break
        free = at(held.where("item_idx IS NULL"))
        a = best_of(wishes(near(asks, free, PAGE, tile=tile)))
        a = cut(asks.join(a, PAGE + ["item_idx"], "left"))
        busy = at(held.where("item_idx IS NOT NULL").withColumnRenamed("item_idx", "holder"))
        reach = F.sqrt("c.d")
        ring = a.where("c IS NOT NULL").withColumns(
            {"x1": F.col("px") - reach, "x2": F.col("px") + reach, "y1": F.col("py") - reach, "y2": F.col("py") + reach}
        ).drop("c")
        late = F.col("r.holder") > F.col("l.item_idx")
        b = touching(ring, busy, PAGE, tile=tile).where(late)
        # pages without a free box: only askers earlier than the last holder still have a chance
        last = busy.groupBy(*PAGE).agg(F.max("holder").alias("_last"))
        lost = a.where("c IS NULL").drop("c").join(last, PAGE).where(F.col("item_idx") < F.col("_last")).drop("_last")
        w = lost.select(*PAGE, F.struct(*lost.columns).alias("l")).join(busy.select(*PAGE, F.struct(*busy.columns).alias("r")), PAGE).where(late)
        wish = best_of(a.where("c IS NOT NULL").select(*PAGE, "item_idx", "c").unionByName(wishes(b)).unionByName(wishes(w)))
        wish = cut(wish.select(*PAGE, "item_idx", F.col("c.draft_idx").alias("draft_idx")))
        none = asks.select(*PAGE, "item_idx").join(wish, PAGE + ["item_idx"], "left_anti")
        given_up = cut(none if given_up is None else given_up.unionByName(none))
        best = wish.groupBy(*PAGE, "draft_idx").agg(F.min("item_idx").alias("_new"))
        held = cut(held.join(best, PAGE + ["draft_idx"], "left").withColumn("item_idx", F.coalesce("_new", "item_idx")).drop("_new"))
    return held.where("item_idx IS NOT NULL").select(*PAGE, "item_idx", "draft_idx")


def merge_measures(draft: DataFrame, response: DataFrame, *, tile: float = 128.0) -> DataFrame:
    """Response measures in order take the nearest free draft box; left-over draft
    boxes are inserted and all measures renumbered by their centres.

    Ordinary pages are folded over their bounded measure lists; crowded pages use
    :func:`_propose`, which gives the same pairs.
    """
    centre = lambda df: df.where("layer = 'L3'").select(*PAGE, "item_idx", box.cx().alias("px"), box.cy().alias("py"))
    mine, theirs = centre(draft), centre(response)
    hot = measure(mine.select(*PAGE).unionByName(theirs.select(*PAGE)), PAGE, FOLD_ROWS)
    tag = lambda df, want: hot.tag(df).where(F.col("_hot") == want).drop("_hot")
    taken = _in_order(tag(mine, False), tag(theirs, False))
    if hot.table is not None:
        taken = taken.unionByName(_propose(tag(mine, True), tag(theirs, True), tile))
    taken = cut(taken)
    free = mine.join(taken.select(*PAGE, F.col("draft_idx").alias("item_idx")), PAGE + ["item_idx"], "left_anti")
    d = draft.select(*PAGE, F.col("item_idx").alias("draft_idx"), F.struct(*box.SIDES).alias("d"))
    out = response.join(taken.join(d, PAGE + ["draft_idx"]).select(*PAGE, "item_idx", "d"), PAGE + ["item_idx"], "left")
    by_id = draft.where(F.col("layer").isin("L1", "L2")).groupBy(*PAGE, item_key().alias("key")).agg(
        F.max_by(F.struct(*box.SIDES), "item_idx").alias("u")
    )
    out = out.withColumn("key", item_key()).join(by_id, PAGE + ["key"], "left")
    upper = F.col("layer").isin("L1", "L2")
    out = out.withColumns(
        {s: F.when(upper, F.coalesce(f"u.{s}", s)).otherwise(F.coalesce(f"d.{s}", s)) for s in box.SIDES}
    ).drop("d", "u", "key")
    orphans = draft.join(free.select(*PAGE, "item_idx"), PAGE + ["item_idx"], "left_semi").withColumn("layer", F.lit("L3"))
    grown = orphans.select(*PAGE).distinct().withColumn("_grown", F.lit(True))
    l3 = out.where("layer = 'L3'").withColumn("_o", F.lit(0)).unionByName(
        orphans.select(*out.columns).withColumns({"kind": F.lit("measure"), "_o": F.lit(1)})
    ).join(grown, PAGE, "left")
    l3 = ordered(l3, PAGE, [box.cy(), box.cx(), F.col("_o"), F.col("item_idx")], number="_n")
    no = F.col("_n").cast("string")
    l3 = l3.withColumns(
        {"label": F.when(F.col("_grown"), F.concat(F.lit("m"), no)).otherwise(F.col("label")),
         "id": F.when(F.col("_grown"), F.concat(F.lit("l3-m"), no)).otherwise(F.col("id"))}
    ).drop("_n", "_grown", "_o")
    return out.where("layer <> 'L3'").unionByName(l3.select(*out.columns))


def merge_open_measures(measures: DataFrame, *, hot: Hot | None = None) -> DataFrame:
    """the open last measure of a row joined with the open first measure of the next.

    Measures carry ``system_idx, measure_idx, closed, segment, measure_source,
    barline_x_left, barline_x_right, system_x1, confidence``. Only rows with consecutive
    ``system_idx`` are neighbours, so a row without measures parts those beside it. A row
    that loses its only measure cannot pass one on, so joins alternate along a chain of
    one-measure rows.
    """
    c = F.col
    keys = PAGE + ["system_idx"]
    row = F.struct("measure_idx", "closed", "segment", "measure_source", "barline_x_left", "barline_x_right", "system_x1", "confidence")
    rows = measures.groupBy(*keys).agg(
        F.min_by(row, "measure_idx").alias("first"), F.max_by(row, "measure_idx").alias("last"), F.count(F.lit(1)).alias("n")
    )
    rows = ordered(rows, PAGE, ["system_idx"], number="_no", leads={"nf": c("first"), "ns": c("system_idx"), "nn": c("n")}, hot=hot)
    soft = c("last.segment") == "open_trailing"
    is_open = (~c("last.closed")) | c("last.barline_x_right").isNull() | soft
    stub = soft | c("last.measure_source").isin("whole_line", "fallback_gap") | ~(c("last.barline_x_right").isNotNull() & c("last.closed"))
    f_open = (c("nf.measure_source") == "whole_line") | c("nf.barline_x_left").isNull() | (F.abs(c("nf.barline_x_left") - c("nf.system_x1")) < 12)
    f_solid = ~f_open & (c("nf.measure_source") == "l3_barline") & c("nf.barline_x_left").isNotNull() & c("nf.closed")
    beside = c("ns") == c("system_idx") + 1
    joins = F.coalesce(c("nf").isNotNull() & beside & F.coalesce(is_open, F.lit(True)) & stub & ~F.coalesce(f_solid, F.lit(False)), F.lit(False))
    rows = rows.withColumn("_j", joins)
    rows = ordered(rows, PAGE, ["system_idx"], lags={"_pj": c("_j")}, hot=hot)
    linked = (c("n") == 1) & F.coalesce("_pj", F.lit(False))
    rows = rows.withColumn("_s", F.when(~linked, c("_no")))
    rows = ordered(rows, PAGE, ["system_idx"], maxima={"_before": c("_s")}, hot=hot)
    start = F.coalesce("_s", "_before")
    done = rows.where(c("_j") & ((c("_no") - start) % 2 == 0))
    gone = done.select(*PAGE, c("ns").alias("system_idx"), c("nf.measure_idx").alias("measure_idx"))
    kept = done.select(
        *keys, c("last.measure_idx").alias("measure_idx"), F.struct(c("nf.closed").alias("closed"), c("nf.confidence").alias("conf"), c("ns").alias("with")).alias("j")
    )
    out = measures.join(gone, keys + ["measure_idx"], "left_anti").join(kept, keys + ["measure_idx"], "left")
    hit = c("j").isNotNull()
    out = out.withColumns(
        {
            "measure_id": F.when(hit, F.substring(F.hex(F.xxhash64("page_id", "system_idx", "measure_idx")), 1, 8)),
            "cross_line": hit, "joined_system": c("j.with"),
            "measure_source": F.when(hit, "cross_line").otherwise(c("measure_source")),
            "closed": F.when(hit, F.coalesce("j.closed", F.lit(True))).otherwise(c("closed")),
            "confidence": F.when(hit, F.least("confidence", "j.conf", F.lit(0.55))).otherwise(c("confidence")),
        }
    ).drop("j")
    out = ordered(out, keys, ["measure_idx"], number="_n")
    return out.withColumn("measure_idx", c("_n") - 1).drop("_n")


def layout_slots(measures: DataFrame, rows: DataFrame, pages: DataFrame, *, hot: Hot | None = None) -> DataFrame:
    """display boxes of n measures over the text rows of a page.

    Early rows are fuller; widths follow the note counts. Measures carry ``measure_idx``
    (0-based) and ``n_notes``, rows ``row_no`` and their box, pages ``width``.
    """
    c = F.col
    per = rows.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("r"), F.min("x1").alias("a"), F.max("x2").alias("b"))
    n = measures.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"))
    per = per.join(n, PAGE).join(pages.select("page_id", "width"), PAGE)
    pad = F.greatest(F.lit(4.0), (c("b") - c("a")) * 0.02)
    per = per.withColumns({"sx1": F.greatest(F.lit(0.0), c("a") - pad), "sx2": F.least(F.when(c("width") > 0, c("width").cast("double")).otherwise(c("b") + pad), c("b") + pad)})
    m = measures.join(per, PAGE)
    base, rem, i = F.floor(c("n") / c("r")), c("n") % c("r"), c("measure_idx")
    full = rem * (base + 1)
    row = F.when(i < full, F.floor(i / (base + 1))).otherwise(rem + F.floor(F.try_divide(i - full, base)))
    m = m.withColumns({"row_no": row.cast("int"), "w": F.when(c("n_notes") > 0, c("n_notes")).otherwise(1)})
    key = PAGE + ["row_no"]
    sums = m.groupBy(*key).agg(F.sum("w").alias("ws"), F.max("measure_idx").alias("_last"))
    m = m.join(sums, key)
    slot = F.greatest(F.lit(4.0), F.greatest(F.lit(8.0), c("sx2") - c("sx1")) * (c("w") / c("ws")))
    m = ordered(m.withColumn("slot", slot), key, ["measure_idx"], sums={"_x": c("slot")})
    y = rows.select(*key, c("y1").alias("ry1"), c("y2").alias("ry2"))
    m = m.join(y, key)
    pad_y = F.greatest(F.lit(6.0), (c("ry2") - c("ry1")) * 0.35)
    left = c("sx1") + c("_x")
    return m.select(
        *PAGE, "measure_idx", "row_no", left.alias("x1"), F.greatest(F.lit(0.0), c("ry1") - pad_y).alias("y1"),
        F.when(i == c("_last"), c("sx2")).otherwise(left + c("slot")).alias("x2"), (c("ry2") + pad_y).alias("y2"),
    )
