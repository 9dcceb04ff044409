"""Score tables: rhythm checks, timelines, packing, lyrics, edits and splices."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions import rhythm, text as tx
from scorelake.plans.greedy import _breaks
from scorelake.plans.lineage import cut
from scorelake.plans.skew import SCAN_ROWS, Hot, dealt, measure, ordered, segments, within

EPS = 0.35  # beats a bar may miss or exceed its meter
ORDER = ("measure_no", "note_idx")


def beats() -> Column:
    return rhythm.note_beats(F.col("duration"), F.col("dots"))


def sounding() -> Column:
    return F.col("pitch").isNotNull() | F.col("is_rest")


def assign_ties(notes: DataFrame, keys: Sequence[str] = ("score_id", "measure_no")) -> DataFrame:
    """``start`` on a held note with a next note, ``stop`` on the note after it."""
    keys = list(keys)
    hot = measure(notes, keys, SCAN_ROWS)
    held = F.coalesce("sustain_dashes", F.lit(0)) > 0
    out = ordered(notes, keys, ["note_idx"], leads={"_next": sounding()}, hot=hot)
    out = out.withColumn("_start", held & F.coalesce("_next", F.lit(False)))
    out = ordered(out, keys, ["note_idx"], lags={"_prev": F.col("_start")}, hot=hot)
    tie = F.when(F.col("_start"), "start").when(F.coalesce("_prev", F.lit(False)), "stop")
    return out.withColumn("tie", tie).drop("_next", "_start", "_prev")


def meter_check(
    measures: DataFrame, notes: DataFrame, meters: DataFrame, *, eps: float = EPS, key: str = "score_id"
) -> DataFrame:
    """beats of each measure against its meter; ``under`` only when it has notes.

    A score without a meter row counts four beats."""
    total = notes.groupBy(key, "measure_no").agg(
        F.sum(F.when(sounding(), beats()).otherwise(0.0)).alias("_b"), F.count(F.lit(1)).alias("n_notes")
    )
    meter = meters.select(key, rhythm.meter_capacity(F.col("time_signature")).alias("capacity"))
    rows = notes.count() + measures.count()
    out = measures.join(dealt(meter, [key], rows), key, "left").join(dealt(total, [key, "measure_no"], rows), [key, "measure_no"], "left")
    out = out.withColumn("capacity", F.coalesce("capacity", F.lit(4.0)))
    b, n, cap = F.coalesce("_b", F.lit(0.0)), F.coalesce("n_notes", F.lit(0)), F.col("capacity")
    return out.withColumns(
        {
            "beats": F.round(b, 3),
            "n_notes": n,
            "status": F.when(b > cap + eps, "over").when((b < cap - eps) & (n > 0), "under").otherwise("ok"),
        }
    ).drop("_b")


def soft_fit(notes: DataFrame, meters: DataFrame, *, eps: float = EPS, key: str = "score_id") -> DataFrame:
    """F8: in overfull measures plain quarters become eighths and, if that is not
    enough, plain eighths sixteenths; lengths taken from dashes stay. A score without a
    meter row counts four beats."""
    plain = (F.col("dots") == 0) & F.coalesce("duration_from", F.lit("default")).isin("default", "underline", "meter_fit")
    quarter = plain & (F.col("duration") == "quarter")
    first = F.when(quarter, rhythm.BEATS["eighth"]).otherwise(beats())
    totals = notes.groupBy(key, "measure_no").agg(F.sum(beats()).alias("_t0"), F.sum(first).alias("_t1"))
    meter = meters.select(key, rhythm.meter_capacity(F.col("time_signature")).alias("_cap"))
    totals = totals.join(meter, key, "left").withColumn("_cap", F.coalesce("_cap", F.lit(4.0)))
    out = notes.join(totals, [key, "measure_no"])
    over0, over1 = F.col("_t0") > F.col("_cap") + eps, F.col("_t1") > F.col("_cap") + eps
    eighth = plain & F.col("duration").isin("quarter", "eighth")
    new = F.when(over0 & over1 & eighth, "sixteenth").when(over0 & quarter, "eighth").otherwise(F.col("duration"))
    return out.withColumns(
        {"_new": new, "duration_from": F.when(new != F.col("duration"), "meter_fit").otherwise(F.col("duration_from"))}
    ).withColumn("duration", F.col("_new")).drop("_new", "_t0", "_t1", "_cap")


def melody_timeline(
    notes: DataFrame, scores: DataFrame, *, with_accidentals: bool = True, hot: Hot | None = None
) -> DataFrame:
    """onset in beats and ms (each note lasts 80 ms at least), MIDI number and pitch
    in Hz of every note, in order; tempo 80 when none is given, and key C without a score row."""
    s = scores.select("score_id", "key", rhythm.beat_ms(F.col("tempo_bpm")).alias("_ms"))
    hot = hot or measure(notes, ["score_id"], SCAN_ROWS)
    out = notes.join(s, "score_id", "left").withColumn("beats", beats())
    out = out.withColumns({"_ms": F.coalesce("_ms", rhythm.beat_ms(F.lit(None).cast("double"))), "key": F.coalesce("key", F.lit("C"))})
    out = out.withColumn("duration_ms", F.greatest(F.lit(80.0), F.col("beats") * F.col("_ms")))
    out = ordered(
        out, ["score_id"], ORDER, sums={"onset_beat": F.col("beats"), "onset_ms": F.col("duration_ms")}, hot=hot
    )
    midi = rhythm.midi_number(
        F.col("pitch"), F.col("octave"), F.col("key"), F.col("accidental") if with_accidentals else None
    )
    midi = F.when(F.col("pitch").isNotNull() & ~F.col("is_rest"), midi)
    return out.withColumns({"midi": midi, "hz": rhythm.midi_hz(midi)}).drop("_ms", "key")


def _walk(notes: DataFrame, keys: list[str], inner: list[str], order: list[str], bar: str, place: str) -> DataFrame:
    """Bars of the notes in one walk over sorted partitions, which remembers one bar: ``bar`` from 1, and the ``place`` in it from 0.

    Notes carry ``_b, _cap, _packs`` and are dealt out by ``keys``. Another value of ``inner`` opens a bar; notes without
    ``_packs`` open and close none.
    """
    spare = ("_b", "_cap", "_packs")
    rows = notes.sortWithinPartitions(*keys, *inner, *order)
    kept = [c for c in rows.columns if c not in spare]
    schema = T.StructType([rows.schema[c] for c in kept]).add(bar, "integer").add(place, "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = group = None
        no, last, at, acc = 1, 0, -1, 0.0  # the open bar, that of the note before, its place there, the fill of the open bar
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, np.int8)
            new[_breaks(batch, inner)] = 1
            new[_breaks(batch, keys)] = 2
            first = tuple(batch.column(c)[0].as_py() for c in keys), tuple(batch.column(c)[0].as_py() for c in inner)
            new[0] = 2 if first[0] != key else first[1] != group
            key, group = (tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in by) for by in (keys, inner))
            bars, places = [], []
            for opens, b, cap, packs in zip(new.tolist(), *(batch.column(c).to_pylist() for c in spare), strict=True):
                if opens:
                    last, acc = 0 if opens == 2 else last, 0.0
                    no = last + 1
                if packs and acc > 0 and acc + b > cap + 1e-6:
                    no, acc = no + 1, 0.0
                at = at + 1 if no == last and opens != 2 else 0
                last = no
                bars.append(no)
                places.append(at)
                if packs:
                    acc += b
                    if acc >= cap - 1e-6:
                        no, acc = no + 1, 0.0
            columns = [*(batch.column(c) for c in kept), pa.array(bars, pa.int32()), pa.array(places, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def _pack_hot(notes: DataFrame, keys: list[str], order: list[str], hot: Hot) -> DataFrame:
    """Bars of hot keys, segment by segment in parallel.

    The fill of an open bar is a multiple of 1/32 beat below the capacity, so what a
    segment does is a small table: for every fill it may start with, the fill it ends
    with and the bars it closes. The tables are chained in one tiny scan per key and
    each segment then runs once more from its true start. Both passes stream over
    sorted partitions and hold one state vector.
    """
    grid = float(rhythm.BEAT_GRID)
    n = len(keys)

    def states(cap):
        import numpy as np

        return np.arange(0.0, max(cap, 1 / grid), 1 / grid)

    def advance(acc, bars, b, cap):
        import numpy as np

        fresh = (acc > 0) & (acc + b > cap + 1e-6)
        bars = bars + fresh
        at = bars
        acc = np.where(fresh, b, acc + b)
        full = acc >= cap - 1e-6
        return np.where(full, 0.0, acc), bars + full, at

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        now, acc, bars, out = None, None, None, []

        def close():
            if now is not None:
                out.append((*now, [int(round(a * grid)) for a in acc], [int(x) for x in bars]))

        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                key = row[: n + 1]
                if key != now:
                    close()
                    now, acc = key, states(row[-1])
                    bars = np.zeros(len(acc), dtype="int64")
                acc, bars, _ = advance(acc, bars, row[-2], row[-1])
            if len(out) > 256:
                yield pd.DataFrame(out, columns=names)
                out = []
        close()
        yield pd.DataFrame(out, columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, acc, bars = None, 0.0, 0
        for pdf in batches:
            got = []
            for row in pdf.itertuples(index=False, name=None):
                key = row[: n + 1]
                if key != now:
                    now, acc, bars = key, row[-2], row[-1]
                b, cap = row[-4], row[-3]
                fresh = acc > 0 and acc + b > cap + 1e-6
                bars += fresh
                got.append(bars)
                acc = b if fresh else acc + b
                if acc >= cap - 1e-6:
                    acc, bars = 0.0, bars + 1
            yield pdf.iloc[:, list(range(n)) + list(range(n + 1, len(pdf.columns) - 4))].assign(
                bar_no=pd.Series(got, index=pdf.index, dtype="int32")
            )

    names = [*keys, "_seg", "_end", "_closed"]
    segs = segments(notes, hot, order)
    kinds = {c: t for c, t in segs.dtypes}
    key_types = ", ".join(f"{c} {kinds[c]}" for c in [*keys, "_seg"])
    sort = [*keys, "_seg", *order]
    flat = segs.select(*keys, "_seg", *order, F.col("_b").alias("b"), "capacity")
    moves = cut(
        flat.sortWithinPartitions(*sort)
        .select(*keys, "_seg", "b", "capacity")
        .mapInPandas(tables, f"{key_types}, _end array<int>, _closed array<bigint>")
    )
    row = F.struct("_seg", "_end", "_closed")
    chain = moves.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("m"))  # <= SEGMENTS rows
    zero = F.struct(F.lit(0).alias("at"), F.lit(1).cast("bigint").alias("bar"), F.array().cast("array<struct<_seg:int,acc:double,bar:bigint>>").alias("out"))
    starts = F.aggregate(
        "m", zero,
        lambda s, m: F.struct(
            m["_end"][s["at"]].alias("at"),
            (s["bar"] + m["_closed"][s["at"]]).alias("bar"),
            F.concat(s["out"], F.array(F.struct(m["_seg"].alias("_seg"), (s["at"] / grid).alias("acc"), s["bar"].alias("bar")))).alias("out"),
        ),
        lambda s: s["out"],
    )
    starts = chain.select(*keys, F.explode(starts).alias("s")).select(*keys, "s.*")
    out_types = ", ".join(f"{c} {kinds[c]}" for c in [*keys, *order])
    return (
        flat.join(starts, [*keys, "_seg"])
        .repartition(*keys, "_seg")
        .sortWithinPartitions(*sort)
        .select(*keys, "_seg", *order, "b", "capacity", "acc", "bar")
        .mapInPandas(run, f"{out_types}, bar_no int")
    )


def pack_by_meter(
    notes: DataFrame,
    keys: Sequence[str] = ("score_id",),
    order: Sequence[str] = ORDER,
    *,
    hot: Hot | None = None,
    place: str | None = None,
) -> DataFrame:
    """Next-fit packing of a note stream into bars; adds ``bar_no`` from 1.

    Notes carry ``duration, dots, capacity``. A full bar closes at once, a note that
    does not fit opens a new bar, the last bar may stay incomplete. ``place`` names a
    column for a note's place in its bar, from 0.
    """
    keys, order = list(keys), list(order)
    cap = F.when(F.col("capacity") > 0, F.col("capacity")).otherwise(4.0)
    notes = notes.dropna(subset=[*keys, *order])
    hot = hot or measure(notes, keys, SCAN_ROWS)

    def few(df: DataFrame) -> DataFrame:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        df = df.withColumns({"_b": beats(), "_cap": F.max(cap).over(whole), "_packs": F.lit(True)})
        return _walk(df, keys, [], order, "bar_no", place or "_place")

    def many(df: DataFrame) -> DataFrame:
        slim = df.select(*keys, *order, beats().alias("_b"), cap.alias("capacity"))
        out = df.join(_pack_hot(slim, keys, order, hot), keys + order)
        return _placed(out, [*keys, "bar_no"], order, place or "_place")

    return _by_size(notes, hot, few, many).drop("_place")


def _placed(notes: DataFrame, keys: list[str], order: list[str], place: str) -> DataFrame:
    """Hot scores: the place of a note among those of ``keys``, from 0."""
    return ordered(notes, keys, order, number=place).withColumn(place, F.col(place) - 1)


def _by_size(notes: DataFrame, hot: Hot, few: Callable[[DataFrame], DataFrame], many: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``few`` on the notes of ordinary keys, ``many`` on those of hot ones."""
    if hot.table is None:
        return few(notes)
    tagged = hot.tag(notes)
    return few(tagged.where("NOT _hot").drop("_hot")).unionByName(many(tagged.where("_hot").drop("_hot")))


def rebalance(notes: DataFrame, *, eps: float = EPS, hot: Hot | None = None, place: str | None = None) -> DataFrame:
    """Measures above capacity + eps with more than one note are repacked, then all
    measures renumbered; short measures are left alone. Adds ``new_measure_no``, and
    ``place`` as :func:`pack_by_meter`."""
    keys = ["score_id", "measure_no"]
    notes = notes.dropna(subset=keys)
    if hot is None:
        hot = measure(notes, ["score_id"], SCAN_ROWS)
        notes = dealt(notes, ["score_id"], notes.count())
    overfull = (F.col("_t") > F.col("_cap") + eps) & (F.col("_n") > 1) & (F.col("_cap") > 0)

    def few(df: DataFrame) -> DataFrame:
        # the notes of one measure, where a whole score is dealt to a task
        peers = Window.partitionBy("score_id").orderBy("measure_no").rangeBetween(Window.currentRow, Window.currentRow)
        df = df.withColumn("_b", beats())
        df = df.withColumns({"_t": F.sum("_b").over(peers), "_n": F.count(F.lit(1)).over(peers), "_cap": F.max("capacity").over(peers)})
        df = df.withColumn("_packs", F.coalesce(overfull, F.lit(False))).drop("_t", "_n")
        return _walk(df, ["score_id"], ["measure_no"], ["note_idx"], "new_measure_no", place or "_place")

    def many(df: DataFrame) -> DataFrame:
        per = df.groupBy(*keys).agg(
            F.sum(beats()).alias("_t"), F.count(F.lit(1)).alias("_n"), F.max("capacity").alias("_cap")
        )
        over = per.where(overfull).select(*keys)
        packed = pack_by_meter(df.join(over, keys, "left_semi"), keys, ["note_idx"], hot=within(hot, df, keys))
        kept = df.join(over, keys, "left_anti").withColumn("bar_no", F.lit(1))
        parts = packed.unionByName(kept)
        sizes = parts.groupBy(*keys).agg(F.max("bar_no").alias("_bars"))
        sizes = ordered(sizes, ["score_id"], ["measure_no"], sums={"_off": F.col("_bars")}, hot=hot)
        out = parts.join(sizes.drop("_bars"), keys)
        out = out.withColumn("new_measure_no", (F.col("_off") + F.col("bar_no")).cast("int")).drop("_off", "bar_no")
        return _placed(out, ["score_id", "new_measure_no"], ["note_idx"], place or "_place")

    return _by_size(notes, hot, few, many).drop("_place")


def align_lyrics(
    notes: DataFrame,
    syllables: DataFrame,
    keys: Sequence[str] = ("score_id",),
    order: Sequence[str] = ORDER,
    *,
    hot: Hot | None = None,
) -> tuple[DataFrame, DataFrame]:
    """N-th syllable to n-th sounding note; returns the notes and the leftovers.

    Syllables carry ``syl_idx, text``.
    """
    keys = list(keys)
    sung = ordered(notes.where(~F.col("is_rest")), keys, order, number="_n", hot=hot)
    words = ordered(syllables, keys, ["syl_idx"], number="_n")
    with_text = sung.join(words.select(*keys, "_n", F.col("text").alias("lyric")), keys + ["_n"], "left")
    rests = notes.where("is_rest").withColumn("lyric", F.lit(None).cast("string"))
    left = words.join(sung.select(*keys, "_n"), keys + ["_n"], "left_anti").drop("_n")
    return with_text.drop("_n").unionByName(rests), left


def apply_note_edits(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """Patch, append and remove notes, and append measures.

    Edits: ``op`` patch / append / remove / measure with ``score_id, measure_no, note_idx,
    edit_idx`` and the fields ``pitch, is_rest, duration, octave`` (null = keep). A rest
    loses its pitch, an un-rested note without pitch becomes 1; removing never empties
    a measure. The last edit of a note wins. Appended notes follow the others of their
    measure, ``measure`` opens one behind the last with a single note; the notes of every
    measure are numbered from 0 anew.
    """
    keys = ["score_id", "measure_no", "note_idx"]
    fields = ("pitch", "is_rest", "duration", "octave")
    last = edits.where(F.col("op") == "patch").groupBy(*keys).agg(
        F.max_by(F.struct(*fields), "edit_idx").alias("e")
    )
    gone = edits.where(F.col("op") == "remove").select(*keys).distinct()
    sizes = notes.join(gone.withColumn("_gone", F.lit(1)), keys, "left").groupBy("score_id", "measure_no").agg(
        F.count_if(F.col("_gone").isNull()).alias("_keep"), F.min("note_idx").alias("_first")
    )
    doomed = gone.join(sizes, ["score_id", "measure_no"]).where(
        (F.col("_keep") > 0) | (F.col("note_idx") != F.col("_first"))
    )
    out = notes.join(doomed.select(*keys), keys, "left_anti").join(last, keys, "left")
    rest = F.coalesce("e.is_rest", "is_rest")
    pitch = F.coalesce("e.pitch", "pitch")
    out = out.withColumns(
        {
            "_p": F.when(F.col("e.is_rest"), F.lit(None).cast("string"))
            .when(~F.col("e.is_rest") & pitch.isNull(), "1").otherwise(pitch),
            "_r": rest,
            "duration": F.coalesce("e.duration", "duration"),
            "octave": F.coalesce("e.octave", "octave"),
        }
    ).withColumns({"pitch": F.col("_p"), "is_rest": F.col("_r")}).drop("_p", "_r", "e")
    last_no = notes.groupBy("score_id").agg(F.max("measure_no").alias("_last"))
    opened = ordered(edits.where(F.col("op") == "measure"), ["score_id"], ["edit_idx"], number="_k")
    opened = opened.join(last_no, "score_id", "left").withColumn(
        "measure_no", (F.coalesce("_last", F.lit(0)) + F.col("_k")).cast(dict(notes.dtypes)["measure_no"])
    ).drop("_last", "_k")
    new = edits.where(F.col("op") == "append").unionByName(opened).select(
        *keys, F.coalesce("pitch", F.lit("1")).alias("pitch"), F.lit(False).alias("is_rest"),
        F.coalesce("duration", F.lit("quarter")).alias("duration"), F.coalesce("octave", F.lit(0)).alias("octave"),
        F.col("edit_idx").alias("_e"),
    )
    out = out.withColumn("_e", F.lit(None).cast(dict(edits.dtypes)["edit_idx"])).unionByName(new, allowMissingColumns=True)
    place = [F.col("_e").isNotNull().alias("_new"), F.coalesce(F.col("_e"), F.col("note_idx"))]
    out = ordered(out, ["score_id", "measure_no"], place, number="_n")
    return out.withColumn("note_idx", (F.col("_n") - 1).cast(dict(notes.dtypes)["note_idx"])).drop("_e", "_n")


def arbitrate_pitch(notes: DataFrame) -> DataFrame:
    """Pitch of a note read twice, by text recognition and from its shape.

    Notes carry ``ocr_text, ocr_score, geom_pitch, underlines, dots, octave,
    sustain_dashes``; ``pitch, is_rest, pitch_from, ocr_text, confidence`` are set. A text
    that is one clean digit wins from score .45 on, unless the shape says otherwise and
    the score is below .72; then comes the shape, then any digit or rest in the text. The numbers are fixed values of the rule.
    """
    c = F.col
    t = F.coalesce(tx.plain(c("ocr_text")), F.lit(""))
    token = F.regexp_extract(t, r"(?:^|\s)([1-70〇零])(?=\s|$)", 1)
    inner = F.regexp_extract(t, r"[1-7]", 0)
    digit = F.when(token.rlike("[1-7]"), token).when((token == "") & (F.length(t) <= 4) & (inner != ""), inner)
    rest = token.isin("0", "〇", "零") | ((token == "") & t.contains("0") & (inner == ""))
    clean = t.rlike(r"^[1-70]([._\-·• ]{0,2})$")
    out = notes.withColumns({"_t": t, "_digit": digit, "_rest": rest, "_clean": clean & digit.isNotNull()})
    geom, score = F.nullif("geom_pitch", F.lit("")), c("ocr_score")
    sure = c("_clean") & (score.isNull() | (score >= 0.45))
    beaten = geom.isNotNull() & (geom != c("_digit")) & (score < 0.72)
    source = (
        F.when(sure & F.coalesce(beaten, F.lit(False)), "geometry").when(sure, "ocr").when(geom.isNotNull(), "geometry")
        .when(c("_digit").isNotNull(), "ocr").when(c("_rest"), "rest").otherwise("none")
    )
    out = out.withColumn("_from", source)
    base = F.when(c("_from").isin("ocr", "rest"), 0.78).otherwise(0.55)
    base = F.when(score != 0, F.least(F.lit(0.92), F.greatest(base, score))).otherwise(base)
    extra = 0.04 * c("underlines") + 0.03 * c("dots") + 0.03 * F.abs("octave") + 0.02 * c("sustain_dashes")
    named = F.when((c("_from") == "geometry") & (F.coalesce("ocr_text", F.lit("")) == ""), F.concat(F.lit("geom:"), geom))
    return out.withColumns(
        {
            "pitch": F.when(c("_from") == "geometry", geom).when(c("_from") == "ocr", c("_digit")),
            "is_rest": c("_from") == "rest",
            "pitch_from": F.when(c("_from") == "rest", "ocr").otherwise(c("_from")),
            "confidence": F.least(F.lit(0.95), F.when(c("_from") == "none", 0.35).otherwise(base) + extra),
            "ocr_text": F.coalesce(named, "ocr_text"),
        }
    ).drop("_t", "_digit", "_rest", "_clean", "_from")


def _measure_at(n: Column, x: Column, y: Column, w: Column, h: Column, per_line: Column) -> Column:
    """0-based measure under a point in row-major order."""
    frac = lambda v, size: F.greatest(F.lit(0.0), F.least(F.lit(0.9999), v / size))
    rows = F.greatest(F.lit(1), F.ceil(n / per_line))
    row = F.least(rows - 1, F.floor(frac(y, h) * rows))
    col = F.least(per_line - 1, F.floor(frac(x, w) * per_line))
    at = F.greatest(F.lit(0), F.least(n - 1, row * per_line + col))
    return F.when(n <= 1, F.lit(0)).otherwise(at)


def measures_per_line(n: Column, w: Column, h: Column) -> Column:
    """Guess of measures per row from count and page shape."""
    guess = F.bround(F.sqrt(F.greatest(F.lit(1), n) * F.greatest(F.lit(0.5), w / h)), 0)
    return F.when(n <= 1, F.lit(1)).otherwise(F.greatest(F.lit(2), F.least(F.lit(8), guess, n))).cast("int")


def is_large_crop(w: Column, h: Column) -> Column:
    """The crop ``x1..y2`` covers most of the page."""
    c = F.col
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    cw, ch = F.greatest(F.lit(0.0), c("x2") - c("x1")), F.greatest(F.lit(0.0), c("y2") - c("y1"))
    area, wf, hf = unit(cw * ch / (w * h)), unit(cw / w), unit(ch / h)
    return (area >= 0.40) | ((wf >= 0.65) & (hf >= 0.40)) | ((wf >= 0.85) & (hf >= 0.28))


def with_crop_window(crops: DataFrame, n: Column, w: Column, h: Column) -> DataFrame:
    """``_start, _end`` (0-based, half open) of the base measures a crop replaces.

    Each step is a column that later steps read several times, so its expression stands
    in the generated code once.
    """
    c = F.col
    crops = crops.withColumns({"_n": n, "_w": w, "_h": h})
    n, w, h = c("_n"), c("_w"), c("_h")
    crops = crops.withColumn("_line", F.greatest(F.lit(1), F.least(measures_per_line(n, w, h), n)))
    at = lambda x, y: _measure_at(n, x, y, w, h, c("_line"))
    crops = crops.withColumns(
        {
            "_first": at((c("x1") + c("x1") + 1) / 2, (c("y1") + c("y1") + 1) / 2),
            "_last": at((F.greatest(c("x1"), c("x2") - 1) + c("x2")) / 2, (F.greatest(c("y1"), c("y2") - 1) + c("y2")) / 2),
            "_mid": at((c("x1") + c("x2")) / 2, (c("y1") + c("y2")) / 2),
        }
    )
    start, mid = c("_first"), c("_mid")
    crops = crops.withColumn("_to", F.least(n, F.greatest(start + 1, c("_last") + 1)))
    end = c("_to")
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    area = unit((c("x2") - c("x1")) * (c("y2") - c("y1")) / (w * h))
    wf, hf = unit((c("x2") - c("x1")) / w), unit((c("y2") - c("y1")) / h)
    most = (end - start >= F.greatest(F.lit(1), F.ceil(n * 0.75))) | (
        (area >= 0.28) & (end - start >= F.greatest(F.lit(2), F.floor(n / 2)))
    )
    crops = crops.withColumns({"_tiny": (wf < 0.22) & (hf < 0.22), "_whole": is_large_crop(w, h) | most})
    zero = F.lit(0)
    return crops.withColumns(
        {
            "_start": F.when(n <= 0, zero).when(c("_whole"), zero).when(c("_tiny"), mid).otherwise(start).cast("int"),
            "_end": F.when(n <= 0, zero).when(c("_whole"), n).when(c("_tiny"), F.least(n, mid + 1)).otherwise(end).cast("int"),
        }
    ).drop("_n", "_w", "_h", "_line", "_first", "_last", "_mid", "_to", "_tiny", "_whole")


def splice_measures(base: DataFrame, patch: DataFrame, crops: DataFrame, *, key: str = "score_id") -> DataFrame:
    """Replace a window of base measures by the patch, keep and renumber the rest.

    ``crops`` has one row per score: ``measure_from, measure_to`` (1-based inclusive,
    null = estimate) and the crop ``x1..y2`` on an ``image_width`` x ``image_height`` page.
    A score without patch measures stays as it is. New numbers are arithmetic.
    """
    b = ordered(base, [key], ["measure_no"], number="_pos")
    p = ordered(patch, [key], ["measure_no"], number="_pos")
    n_base = base.groupBy(key).agg(F.count(F.lit(1)).alias("_nb"))
    n_patch = patch.groupBy(key).agg(F.count(F.lit(1)).alias("_np"))
    win = crops.join(n_patch, key).join(n_base, key, "left").withColumn("_nb", F.coalesce("_nb", F.lit(0)).cast("int"))
    h = F.greatest(F.lit(1), F.col("image_height"))
    w = F.when(F.col("image_width") > 0, F.col("image_width")).otherwise(h)
    n = F.col("_nb")
    win = with_crop_window(win, n, w, h)
    start, end = F.col("_start"), F.col("_end")
    given = F.col("measure_from").isNotNull() | F.col("measure_to").isNotNull()
    f0 = F.coalesce("measure_from", F.lit(1))
    t0 = F.coalesce("measure_to", f0)
    gs = F.greatest(F.lit(0), F.least(f0 - 1, n))
    ge = F.greatest(gs, F.least(t0, n))
    ge = F.when((ge == gs) & (gs < n), gs + 1).otherwise(ge)
    win = win.select(
        key, F.when(given, gs).otherwise(start).alias("_s"), F.when(given, ge).otherwise(end).alias("_e"), "_np"
    )
    out = b.join(win, key, "left")
    shift = F.when(F.col("_pos") > F.col("_e"), F.col("_np") - (F.col("_e") - F.col("_s"))).otherwise(0)
    kept = out.where(F.col("_s").isNull() | (F.col("_pos") <= F.col("_s")) | (F.col("_pos") > F.col("_e")))
    kept = kept.withColumns(
        {
            "measure_no": F.when(F.col("_s").isNull(), F.col("measure_no")).otherwise(F.col("_pos") + shift).cast("int"),
            "from_crop": F.lit(False), "crop_index": F.lit(None).cast("int"),
        }
    )
    new = p.join(win, key).withColumns(
        {
            "measure_no": (F.col("_s") + F.col("_pos")).cast("int"),
            "from_crop": F.lit(True), "crop_index": F.col("_pos") - 1,
        }
    )
    spare = ("_pos", "_s", "_e", "_np")
    return kept.drop(*spare).unionByName(new.drop(*spare), allowMissingColumns=True)


def merge_score_meta(base: DataFrame, patch: DataFrame) -> DataFrame:
    """Key, meter and tempo of the base win unless they are empty."""
    text = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}"), F.col(c))
    p = patch.select("score_id", *[F.col(c).alias(f"_{c}") for c in ("key", "time_signature", "tempo_bpm")])
    return base.join(p, "score_id", "left").withColumns(
        {"key": text("key"), "time_signature": text("time_signature"), "tempo_bpm": F.coalesce("tempo_bpm", "_tempo_bpm")}
    ).drop("_key", "_time_signature", "_tempo_bpm")


def assemble_scores(pages: DataFrame, measures: DataFrame, notes: DataFrame) -> DataFrame:
    """one score measure per layout measure in reading order, empty ones kept.

    Only pitch slots with a glyph (``duration`` set) that is a rest or a degree 1-7 give
    notes. A page without measures gets one placeholder measure with degree 1. One row
    per note; empty measures have one row without note.
    """
    kind = F.coalesce("kind", F.lit("pitch"))
    degree = F.col("pitch").isin(*list("1234567"))
    n = notes.where((kind == "pitch") & F.col("duration").isNotNull() & (F.col("is_rest") | degree)).select(
        "page_id", "global_no", F.col("note_idx").alias("slot_idx"),
        F.when(~F.col("is_rest"), F.col("pitch")).alias("pitch"), "is_rest", "duration", "dots",
        F.when(F.col("is_rest"), 0).otherwise(F.coalesce("octave", F.lit(0))).alias("octave"),
        "confidence", "pitch_from",
    )
    hot = measure(notes, ["page_id", "global_no"], SCAN_ROWS)
    rows = notes.count() + measures.count()
    n = ordered(dealt(n, ["page_id", "global_no"], rows), ["page_id", "global_no"], ["slot_idx"], number="_n", hot=hot)
    n = n.withColumn("note_idx", F.col("_n") - 1).drop("_n", "slot_idx")
    filled = measures.select("page_id", "global_no", "system_idx", "measure_idx", "measure_source").join(
        n, ["page_id", "global_no"], "left"
    ).withColumn("source", F.lit("structure_l3"))
    bare = pages.select("page_id").join(measures.select("page_id").distinct(), "page_id", "left_anti").select(
        "page_id", F.lit(1).alias("global_no"), F.lit("1").alias("pitch"), F.lit(False).alias("is_rest"),
        F.lit("quarter").alias("duration"), F.lit(0).alias("dots"), F.lit(0).alias("octave"),
        F.lit(0).alias("note_idx"), F.lit("structure_empty_placeholder").alias("source"),
    )
    return filled.unionByName(bare, allowMissingColumns=True).withColumnsRenamed(
        {"page_id": "score_id", "global_no": "measure_no"}
    )


def sounding_pitch(is_rest: Column, pitch: Column) -> Column:
    return ~F.coalesce(is_rest, F.lit(False)) & (F.coalesce(pitch, F.lit("")) != "")


def pitch_tokens(notes: DataFrame) -> DataFrame:
    """Token rows of the sounding notes (degree with sharp or flat mark)."""
    return notes.where(sounding_pitch(F.col("is_rest"), F.col("pitch"))).withColumn(
        "token", rhythm.pitch_token(F.col("pitch"), F.col("accidental"))
    )
