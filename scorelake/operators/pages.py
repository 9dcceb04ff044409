"""Page layouts: edits, reading order, rebuild, overlays and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions import box
from scorelake.operators.placement import assign_to_measures, assign_to_systems, bind_glyphs
from scorelake.operators.splits import derive_measures, normalize_splits, splits_from_measures
from scorelake.plans.lineage import merged, written
from scorelake.plans.skew import FOLD_ROWS, SCAN_ROWS, Hot, apart, measure, ordered

ROLES = ("title", "key_time", "score", "other")
RANK = {"L1": 1, "L2": 2, "L3": 3, "L4": 4, "L5": 5}


def apply_edits(items: DataFrame, edits: DataFrame, pages: DataFrame, *, hot: Hot | None = None) -> DataFrame:
    """Boxes replaced by id, else by (layer, label); the last edit wins.

    Edits are put on the page first: corners ordered, clamped, 4 px at least. A page of few items and edits is a task's
    work: its edits come to its items as maps, so items are dealt out once.
    """
    size = pages.select("page_id", "width", "height")
    hot = hot or edited_rows(items, edits)
    e = merged(edits).join(size, "page_id")
    e = e.withColumn("b", F.struct(*[c.alias(n) for n, c in box.on_page(F.col("width"), F.col("height")).items()]))
    return apart(hot, _edited_by_maps, _edited_by_keys, items, e.select("page_id", "edit_idx", "id", "layer", "label", "b"))


def edited_rows(items: DataFrame, edits: DataFrame) -> Hot:
    """The pages of too many items and edits for one task."""
    return measure(items.select("page_id").unionByName(edits.select("page_id")), ["page_id"], FOLD_ROWS)


def _is_named() -> Column:
    return F.coalesce(F.col("id"), F.lit("")) != ""


def _is_labelled() -> Column:
    return (F.coalesce(F.col("layer"), F.lit("")) != "") & (F.coalesce(F.col("label"), F.lit("")) != "")


def _edited(df: DataFrame, new: Column) -> DataFrame:
    return df.withColumns({s: F.coalesce(new[s], F.col(s)) for s in box.SIDES} | {"edited": new.isNotNull()}).drop("_bi", "_bl")


def _edited_by_maps(items: DataFrame, edits: DataFrame) -> DataFrame:
    name = lambda i, la, lb: F.struct(i.alias("i"), la.alias("la"), lb.alias("lb"))
    none = F.lit(None).cast("string")
    by_id, by_label = name(F.col("id"), none, none), name(none, F.col("layer"), F.col("label"))
    names = F.filter(F.array(F.when(_is_named(), by_id), F.when(_is_labelled(), by_label)), lambda n: n.isNotNull())
    last = edits.withColumn("k", F.explode(names)).groupBy("page_id", "k").agg(F.max_by("b", "edit_idx").alias("b"))
    of = lambda only, key: F.map_from_entries(F.collect_list(F.when(only, F.struct(key, "b"))))
    last = last.groupBy("page_id").agg(
        of(F.col("k.i").isNotNull(), F.col("k.i")).alias("_bi"), of(F.col("k.i").isNull(), F.struct("k.la", "k.lb")).alias("_bl")
    )
    at = lambda m, key: F.try_element_at(F.col(m), key)
    label = F.when(_is_labelled(), F.struct(F.col("layer").alias("la"), F.col("label").alias("lb")))
    out = _edited(merged(items).join(last, "page_id", "left"), F.coalesce(at("_bi", F.col("id")), at("_bl", label)))
    return out.select(*items.columns, "edited")


def _edited_by_keys(items: DataFrame, edits: DataFrame) -> DataFrame:
    last = lambda df, *by: df.groupBy("page_id", *by).agg(F.max_by("b", "edit_idx").alias("b"))
    by_id = last(edits.where(_is_named()), "id").withColumnRenamed("b", "_bi")
    by_label = last(edits.where(_is_labelled()), "layer", "label").withColumnRenamed("b", "_bl")
    out = items.join(by_id, ["page_id", "id"], "left").join(by_label, ["page_id", "layer", "label"], "left")
    return _edited(out, F.coalesce("_bi", "_bl")).select(*items.columns, "edited")


def item_key() -> Column:
    return F.coalesce(F.nullif("id", F.lit("")), F.concat_ws("-", "layer", "label"))


def diff_layouts(base: DataFrame, draft: DataFrame, *, eps: float = 0.5) -> DataFrame:
    """Items that are new or moved by more than ``eps``, as an edit table."""
    old = base.groupBy("page_id", item_key().alias("key")).agg(
        F.max_by(F.struct(*box.SIDES), "item_idx").alias("old")
    )
    moved = F.lit(False)
    for s in box.SIDES:
        moved = moved | (F.abs(F.col(s) - F.col(f"old.{s}")) > eps)
    return (
        draft.withColumn("key", item_key())
        .join(old, ["page_id", "key"], "left")
        .where(F.col("old").isNull() | moved)
        .select("page_id", F.col("item_idx").alias("edit_idx"), F.col("key").alias("id"), "layer", "label", *box.SIDES)
    )


def reading_order(
    systems: DataFrame, measures: DataFrame, *, hot: Hot | None = None
) -> tuple[DataFrame, DataFrame]:
    """rows top to bottom, measures left to right, one running number per page.

    Centres are compared at one decimal; ties keep the incoming order. Systems carry
    ``system_idx``, measures ``system_idx, measure_idx``; both come back renumbered.
    """
    hot = hot or measure(measures.select("page_id").unionByName(systems.select("page_id")), ["page_id"], SCAN_ROWS)
    y, x = F.bround(box.cy(), 1), F.bround(box.cx(), 1)
    s = ordered(systems, ["page_id"], [y, x, F.col("system_idx")], number="_no", hot=hot)
    s = s.withColumn("_no", F.col("_no") - 1)
    m = measures.join(s.select("page_id", "system_idx", F.col("_no").alias("_sys")), ["page_id", "system_idx"])
    m = ordered(m, ["page_id"], [F.col("_sys"), x, y, F.col("measure_idx")], number="global_no", hot=hot)
    first = m.groupBy("page_id", "system_idx").agg(F.min("global_no").alias("_first"))
    m = m.join(first, ["page_id", "system_idx"])
    m = m.withColumns({"measure_idx": F.col("global_no") - F.col("_first"), "system_idx": F.col("_sys")})
    return s.withColumn("system_idx", F.col("_no")).drop("_no"), m.drop("_sys", "_first")


def boxes_from_items(items: DataFrame) -> DataFrame:
    """A4: boxes by layer; rows with a bad box or an unknown layer are dropped."""
    return items.where(F.col("layer").isin(*RANK) & box.valid()).select(
        F.col("page_id").alias("sample_id"), "layer", F.col("item_idx").alias("box_idx"),
        F.coalesce("label", F.lit("")).alias("label"), F.coalesce("kind", F.lit("")).alias("kind"), *box.SIDES,
    )


def boxes_from_layout(
    regions: DataFrame, systems: DataFrame, measures: DataFrame, notes: DataFrame
) -> DataFrame:
    """The same boxes from layer tables; a note without kind is a pitch.

    ``box_idx`` is the index path of the box, which sorts like the nested lists.
    """
    sys_no = F.col("system_idx").cast("string")
    meas_no = F.col("measure_idx").cast("string")
    kind = F.coalesce(F.nullif("kind", F.lit("")), F.lit("pitch"))
    path = lambda *parts: F.array(*[F.col(c).cast("bigint") for c in parts])  # compares in reading order
    part = lambda df, layer, idx, label, k: df.select(
        F.col("page_id").alias("sample_id"), F.lit(layer).alias("layer"), idx.alias("box_idx"),
        label.alias("label"), k.alias("kind"), *box.SIDES,
    )
    return (
        part(regions, "L1", path("region_idx"), F.col("role"), F.col("role"))
        .unionByName(part(systems, "L2", path("system_idx"), F.concat(F.lit("sys"), sys_no), F.lit("system")))
        .unionByName(
            part(measures, "L3", path("system_idx", "measure_idx"), F.concat(F.lit("m"), meas_no), F.lit("measure"))
        )
        .unionByName(
            part(notes, "L4", path("system_idx", "measure_idx", "note_idx"),
                 F.concat(kind, F.col("note_idx").cast("string")), kind)
        )
    )


def overlay_items(
    regions: DataFrame, systems: DataFrame, measures: DataFrame, notes: DataFrame
) -> DataFrame:
    """Annotation items L1-L5 with their ids and labels from layer tables.

    Measures carry ``global_no``; notes their measure's ``global_no``, ``note_idx`` and
    the glyph columns (null when a slot has no glyph).
    """
    text = lambda c: F.col(c).cast("string")
    g = text("global_no")
    base = lambda df, layer, id_, label, kind, *more: df.select(
        "page_id", F.lit(layer).alias("layer"), id_.alias("id"), label.alias("label"), kind.alias("kind"),
        *box.SIDES, "confidence", *more,
    )
    none = [F.lit(None).cast("string").alias("pitch"), F.lit(None).cast("string").alias("duration")]
    l1 = base(regions, "L1", F.concat(F.lit("l1-"), "role"), F.col("role"), F.col("role"), *none)
    l2 = base(
        systems, "L2", F.concat(F.lit("l2-sys"), text("system_idx")),
        F.concat(F.lit("row "), (F.col("system_idx") + 1).cast("string")), F.lit("system"), *none,
    )
    plain = F.coalesce("measure_source", F.lit("")).isin("", "l3_barline", "l3_split")
    l3 = base(
        measures, "L3", F.concat(F.lit("l3-m"), g),
        F.concat(F.lit("m"), g, F.when(plain, "").otherwise(F.concat(F.lit("/"), "measure_source"))),
        F.lit("measure_derived"), *none,
    )
    kind = F.coalesce("kind", F.lit("pitch"))
    no = (F.col("note_idx") + 1).cast("string")
    l4 = base(
        notes, "L4", F.concat(F.lit("l4-m"), g, F.lit("-"), kind, text("note_idx")),
        F.concat(F.when(kind == "pitch", "n").otherwise(F.substring(kind, 1, 1)), no),
        F.when(kind == "pitch", "note_roi").when(kind == "chord", "chord").otherwise("lyric"), *none,
    )
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    mark = F.concat(
        F.coalesce("pitch", F.when(F.col("is_rest"), "0").otherwise("?")),
        F.when(count("underlines") != 0, F.concat(F.lit("_"), text("underlines"))).otherwise(""),
        F.repeat(F.lit("."), F.least(F.lit(2), count("dots"))),
        F.when(count("octave") != 0, F.format_string("@%+d", count("octave"))).otherwise(""),
        F.when(count("sustain_dashes") != 0, "-").otherwise(""),
        F.when(F.col("pitch_from") == "geometry", "~").otherwise(""),
    )
    slots = notes.where(kind == "pitch")
    l5 = base(
        slots, "L5", F.concat(F.lit("l5-m"), g, F.lit("-n"), text("note_idx")),
        F.when(F.col("duration").isNull(), "?").otherwise(mark), F.lit("glyph"), "pitch", "duration",
    )
    out = l1
    for part in (l2, l3, l4, l5):
        out = out.unionByName(part)
    return out


def recognition_facts(notes: DataFrame) -> DataFrame:
    """One region row per note slot: recognised text else pitch, and its kind."""
    text = F.coalesce(F.nullif("ocr_text", F.lit("")), F.nullif("pitch", F.lit("")), F.lit(""))
    pitched = F.coalesce("pitch", F.lit("")) != ""
    return notes.select(
        "page_id", "system_idx", "measure_idx", "note_idx", text.alias("text"),
        F.when(pitched, "pitch").otherwise("other").alias("kind"),
        pitched.alias("is_hint"), F.col("ocr_score").alias("score"), *box.SIDES,
    )


def merge_regions(rule: DataFrame, learned: DataFrame) -> DataFrame:
    """Title and key_time from the rules, score from the model, else whichever exists.

    Pages without learned regions keep their rule regions as they are.
    """
    has = learned.select("page_id").distinct()
    b = lambda n: F.struct(*box.SIDES, "confidence").alias(n)
    # a later region of a role replaces the earlier one
    one = lambda df, n: df.where(F.col("role").isin("title", "key_time", "score")).groupBy("page_id", "role").agg(
        F.max_by(F.struct(*box.SIDES, "confidence"), "region_idx").alias(n)
    )
    both = one(rule.join(has, "page_id", "left_semi"), "a").join(one(learned, "b"), ["page_id", "role"], "full_outer")
    pick = F.when(F.col("role") == "score", F.coalesce("b", "a")).otherwise(F.coalesce("a", "b"))
    merged = both.select("page_id", "role", pick.alias("m")).select("page_id", "role", "m.*")
    kept = rule.join(merged.select("page_id").distinct(), "page_id", "left_anti")
    return merged.unionByName(kept.select("page_id", "role", *box.SIDES, "confidence"))


def pin_layers(recomputed: DataFrame, user: DataFrame, from_layer: str) -> DataFrame:
    """boxes at and above ``from_layer`` from the user table, lower ones recomputed.

    Rows of both tables meet on (page_id, layer, path), the index path of the box.
    """
    mine = user.where(F.col("layer").isin(*[k for k, v in RANK.items() if v <= RANK[from_layer]]))
    mine = mine.select("page_id", "layer", "path", F.struct(*box.SIDES).alias("_u"))
    out = recomputed.join(mine, ["page_id", "layer", "path"], "left")
    return out.withColumns(
        {s: F.coalesce(F.col(f"_u.{s}"), F.col(s)) for s in box.SIDES} | {"pinned": F.col("_u").isNotNull()}
    ).drop("_u")


def clear_below(items: DataFrame, from_layer: str) -> DataFrame:
    """rows of the layers a re-run will recompute are removed."""
    return items.where(F.col("layer").isin(*[k for k, v in RANK.items() if v <= RANK[from_layer]]))


def page_regions(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Regions of the L1 items, with the whole page where no score region is marked."""
    name = F.lower(F.coalesce(F.nullif("kind", F.lit("")), F.nullif("label", F.lit("")), F.lit("other")))
    size = pages.select("page_id", "width", "height")
    found = items.where(F.col("layer") == "L1").join(size, "page_id")
    found = found.select(
        "page_id", "item_idx", F.when(name.isin(*ROLES), name).otherwise("other").alias("role"),
        *[c.alias(n) for n, c in box.on_page(F.col("width"), F.col("height")).items()],
        F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.8)).alias("confidence"),
    )
    bare = size.join(found.where(F.col("role") == "score").select("page_id"), "page_id", "left_anti")
    return found.unionByName(
        bare.select(
            "page_id", F.lit(None).cast("bigint").alias("item_idx"), F.lit("score").alias("role"),
            F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("width").cast("double").alias("x2"),
            F.col("height").cast("double").alias("y2"), F.lit(0.4).alias("confidence"),
        )
    )


def rebuild_pages(
    items: DataFrame, barlines: DataFrame, pages: DataFrame, edits: DataFrame | None = None
) -> dict[str, DataFrame]:
    """F16: edited items and bar lines to consistent layer tables.

    Regions, rows in reading order, measures from bar lines where a row has any (else
    their own boxes), notes placed into measures and glyphs bound to note slots. The
    page key is measured once; every step below inherits the answer. Each layer is
    written to the checkpoint folder before the next one reads it several times.
    """
    if edits is not None:
        items = written(apply_edits(items, edits, pages))
    hot = measure(items, ["page_id"], SCAN_ROWS)
    size = pages.select("page_id", "width", "height")

    def layer(name: str, fallback: float) -> DataFrame:
        found = items.where(F.col("layer") == name).join(size, "page_id")
        return found.withColumns(
            box.on_page(F.col("width"), F.col("height"))
            | {"confidence": F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(fallback))}
        ).drop("width", "height")

    rows = ordered(layer("L2", 0.8), ["page_id"], ["y1", "x1", "item_idx"], number="_n", hot=hot)
    rows = written(rows.select("page_id", (F.col("_n") - 1).alias("system_idx"), "id", *box.SIDES, "confidence"))
    found = layer("L3", 0.75).select("page_id", F.col("item_idx").alias("measure_id"), *box.SIDES, "confidence")
    placed = written(found.join(assign_to_systems(found, rows), ["page_id", "measure_id"]))
    rows, boxes = reading_order(rows, placed.withColumnRenamed("measure_id", "measure_idx"), hot=hot)
    rows, boxes = written(rows), written(boxes)

    keys = ["page_id", "system_idx"]
    lines = barlines.where(F.col("x").isNotNull()).select(
        "page_id", F.col("system").alias("system_idx"), "x",
        F.coalesce("source", F.lit("user")).alias("source"),
        F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        F.coalesce("id", F.lit("")).alias("split_id"), F.col("line_idx").alias("split_idx"),
    )
    lines_hot = measure(lines.select(*keys).unionByName(placed.select(*keys)), keys, FOLD_ROWS)
    barred = lines.select(*keys).distinct()
    split_a = written(normalize_splits(lines, rows, min_gap=6.0, hot=lines_hot))
    with_bars = rows.join(barred, keys, "left_semi")
    derived = derive_measures(with_bars, split_a, min_width=8.0, source="user_splits", hot=lines_hot)
    kept = boxes.join(barred, keys, "left_anti")
    split_b = splits_from_measures(
        kept.withColumns({"barline_x_left": F.col("x1"), "barline_x_right": F.col("x2")}), rows,
        min_gap=6.0, hot=lines_hot,
    )
    shape = ["page_id", "system_idx", "measure_idx", *box.SIDES, "confidence", "measure_source"]
    measures = derived.select(*shape).unionByName(
        kept.withColumn("measure_source", F.lit("user_structure")).select(*shape)
    )
    measures = written(ordered(measures, ["page_id"], ["system_idx", "measure_idx"], number="global_no", hot=hot))

    number = lambda pattern, group: F.regexp_extract("id", pattern, group).try_cast("int")
    l4 = r"(?i)^l4-m(\d+)-[a-z]*(\d+)$"
    kind = F.lower(F.coalesce("kind", F.lit("")))
    in_id = F.lower(F.regexp_extract("id", r"(?i)^l4-m\d+-(pitch|chord|lyric)\d+$", 1))
    notes = layer("L4", 0.7).select(
        "page_id", F.col("item_idx").alias("note_id"), number(l4, 1).alias("stated_no"),
        F.when(kind == "chord", "chord").when(kind.isin("lyric", "lyrics"), "lyric")
        .when(kind.isin("note_roi", "pitch", "note"), "pitch").when(in_id != "", in_id).otherwise("pitch").alias("kind"),
        *box.SIDES, "confidence",
    )
    notes = notes.join(assign_to_measures(notes, measures), ["page_id", "note_id"])
    notes_hot = measure(items.where(F.col("layer") == "L4"), ["page_id"], SCAN_ROWS)
    by_measure = notes_hot if notes_hot.table is None else measure(notes, ["page_id", "global_no"], SCAN_ROWS)
    by_measure = Hot(("page_id", "global_no"), SCAN_ROWS, by_measure.table, by_measure.n)
    notes = ordered(notes, ["page_id", "global_no"], ["x1", "y1", "note_id"], number="_n", hot=by_measure)
    notes = written(notes.withColumn("note_idx", F.col("_n") - 1).drop("_n", "stated_no"))

    l5 = r"(?i)^l5-m(\d+)-n(\d+)$"
    glyphs = layer("L5", 0.6).select(
        "page_id", F.col("item_idx").alias("glyph_id"), number(l5, 1).alias("stated_no"),
        number(l5, 2).alias("stated_idx"), *box.SIDES,
    )
    hosts = assign_to_measures(glyphs, measures, row="glyph_id")
    bound = bind_glyphs(written(glyphs.join(hosts, ["page_id", "glyph_id"])), notes)
    return {
        "regions": page_regions(items, pages),
        "systems": rows,
        "splits": split_a.unionByName(split_b),
        "measures": measures,
        "notes": notes,
        "glyphs": bound,
    }
