"""Benchmark decontamination by template windows.

A text becomes a template: numbers, names and units turn into typed placeholders, all other words into lower case.
Windows of the template are hash-joined with those of the evaluation samples, so a question whose figures or names were
changed still matches. What stood in the placeholders is kept beside the window; a match counts only as far as
the same value of the sample always meets the same value of the page. Windows without any placeholder are joined
too, so a copy is found in any case and punctuation, whatever its words are taken for.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.arrays import buffers, mix, pieces, prefix_hashes, span_hashes
from scorelake.llm.exchange import written

#: Words that are units right after a number. Fixed values.
UNITS = (
    *("mm", "cm", "m", "km", "g", "kg", "mg", "t", "ml", "cl", "l", "s", "sec", "second", "seconds", "min", "minute", "minutes"),
    *("h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "hz", "khz", "mhz", "bpm", "db"),
    *("meter", "meters", "metre", "metres", "kilometers", "miles", "mile", "inch", "inches", "feet", "foot", "kg", "grams", "liters"),
    *("dollars", "dollar", "euro", "euros", "cents", "percent", "degrees", "beats", "bars", "notes", "usd", "eur"),
)
#: Bits of the filter that decides which windows of pages are shuffled; its size doesn't hang on the benchmark.
FILTER_BITS = 1 << 23
#: Shortest sample, in words, that is also looked for as a template; shorter ones only as they are.
LEAST_WORDS = 4
#: Words that are numbers. Fixed values.
NUMBER_WORDS = (
    *("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen"),
    *("sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"),
    *("hundred", "thousand", "million", "billion", "dozen"),
)
#: Of how many words of a template one at least has to be literal.
LITERAL_OF = 4
SLICE_BYTES = 2 << 20
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
#: Code points by class: between words, digits of numbers, letters of words, letters of scripts without spaces (each a word),
#: and those that count as absent (soft hyphens, joiners).
BREAK, DIGIT, LETTER, SINGLE, ABSENT = 0, 1, 2, 3, 4
#: Scripts without spaces: Thai, Lao, Tibetan, Burmese, Khmer, kana, bopomofo, Han. Fixed ranges.
UNSPACED = (
    *((0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3005, 0x3007)),
    *((0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)),
    *((0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x323AF)),
)
#: The reading whose windows make the core of a sample, and the one that takes sentence openers for names.
NAMES, OPENERS = 2, 3
#: In the place of a window's size: a span with a fixed number of literal words.
RUN = 0


@functools.cache
def _code_points() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its class, lower case, whether it is a capital, whether it ends a sentence."""
    n = 0x110000
    kind = np.full(n, LETTER, np.int8)
    classes = {"P": BREAK, "S": BREAK, "Z": BREAK, "C": BREAK, "Nd": DIGIT, "Cf": ABSENT, "Cn": LETTER, "Co": LETTER}
    for c in range(0x20000):
        name = unicodedata.category(chr(c))
        kind[c] = classes.get(name, classes.get(name[0], LETTER))
    kind[0x200B] = BREAK  # a space without width
    kind[0xE0000:0xE0080] = ABSENT
    for a, b in UNSPACED:
        kind[a : b + 1][kind[a : b + 1] == LETTER] = SINGLE
    lower, capital, stop = np.arange(n, dtype=np.uint32), np.zeros(n, bool), np.zeros(n, bool)
    for c in range(0x20000):
        low = chr(c).casefold()
        low = low if len(low) == 1 else chr(c).lower()[0]
        if low != chr(c):
            lower[c], capital[c] = ord(low), chr(c).lower() != chr(c)
    stop[[ord(c) for c in ".!?:;\n\u2026\u3002\uff01\uff1f\uff1a\uff1b\u2028\u2029"]] = True
    return kind, lower, capital, stop


def _decoded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of some UTF-8 texts and where each text begins among them."""
    try:
        joined = data.tobytes().decode()
        ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    except UnicodeDecodeError:
        parts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        joined, ends = "".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), ends


def _word_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(span_hashes(prefix_hashes(mix(points.astype(np.uint64), 3) | np.uint64(1)), start, end))


@functools.cache
def _expansions() -> tuple[np.ndarray, np.ndarray]:
    """By code point, the row of its folded form among those of several letters (sharp s, ligatures), or -1; those rows, with zeros."""
    which, forms = np.full(0x110000, -1, np.int16), []
    for c in range(0x20000):
        if len(low := chr(c).casefold()) > 1:
            which[c] = len(forms)
            forms.append([ord(x) for x in low.ljust(3, "\0")])
    return which, np.array(forms, np.uint32)


def _expanded(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``points`` and ``offsets`` with every code point that folds to several letters replaced by these."""
    which, forms = _expansions()
    at = np.flatnonzero(which[points] >= 0)
    if not len(at):
        return points, offsets
    form = forms[which[points[at]]]
    length = np.ones(len(points), np.int64)
    length[at] = (form > 0).sum(axis=1)
    place = np.concatenate([[0], np.cumsum(length)])
    out = np.repeat(points, length)
    for k in range(3):
        has = form[:, k] > 0
        out[place[at[has]] + k] = form[has, k]
    return out, place[offsets]


@functools.cache
def _listed(words: tuple[str, ...]) -> np.ndarray:
    points = [np.array([ord(c) for c in u], np.uint32) for u in words]
    return np.sort([_word_hashes(p, np.array([0]), np.array([len(p)]))[0] for p in points])


def _among(values: np.ndarray, words: tuple[str, ...]) -> np.ndarray:
    """Which hashes of words are those of ``words``."""
    known = _listed(words)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Stream:
    """One reading of the words of some texts. By token: ``text`` (row), ``word`` (its first word), ``kind``, ``value`` (hash of
    the words) and ``sign`` (hash of the reading); ``new`` marks the tokens that the reading before took otherwise."""

    def __init__(self, n: int, text: np.ndarray, word: np.ndarray, kind: np.ndarray, value: np.ndarray, new: np.ndarray | None) -> None:
        self.text, self.word, self.kind, self.value = text, word, kind, value
        self.first = np.searchsorted(text, np.arange(n + 1))
        self.sign = np.where(kind == LITERAL, value, mix(kind.astype(np.uint64), 17))
        self.literal = np.concatenate([[0], np.cumsum(kind == LITERAL)])
        self.new = None if new is None else np.concatenate([[0], np.cumsum(new)])

    def telling(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which spans of tokens hold enough literal ones to be compared."""
        return LITERAL_OF * (self.literal[end] - self.literal[at]) >= end - at

    def windows(self, size: int, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First and behind last tokens of all windows of ``size`` tokens of one text that are literal enough and, unless
        ``every``, that the reading before doesn't have."""
        at = np.flatnonzero(self.text[size - 1 :] == self.text[: max(0, len(self.text) - size + 1)])
        if not every and self.new is not None:
            at = at[self.new[at + size] > self.new[at]]
        at = at[self.telling(at, at + size)]
        return at, at + size

    def runs(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """First and behind last tokens of the shortest spans with ``words`` literal tokens, under the same conditions."""
        place = np.flatnonzero(self.kind == LITERAL)
        at, end = place[: max(0, len(place) - words + 1)], place[words - 1 :] + 1
        inside = self.text[at] == self.text[end - 1]
        if self.new is not None:
            inside &= self.new[end] > self.new[at]
        at, end = at[inside], end[inside]
        whole = self.telling(at, end)
        return at[whole], end[whole]


class Template:
    """The words of some texts and their readings: all words literal; numbers and units typed; names typed as well; capitalised
    words that open a sentence typed as names, too."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        kinds, lower, capitals, stops = _code_points()
        points, offsets = _expanded(*_decoded(data, offsets))
        there = kinds[points] != ABSENT
        points, offsets = points[there], np.concatenate([[0], np.cumsum(there)])[offsets]
        n = len(points)
        kind = kinds[points]
        digit = kind == DIGIT
        joint = np.zeros(n, bool)  # a point or comma between two digits belongs to the number
        if n > 2:
            joint[1:-1] = ((points[1:-1] == 0x2E) | (points[1:-1] == 0x2C)) & digit[:-2] & digit[2:]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        joint[:-1] &= ~edge[1:n]
        joint &= ~edge[:n]
        kind[joint] = DIGIT
        begin = kind > 0
        begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == SINGLE) | edge[1:n]
        close = kind > 0
        close[:-1] &= (kind[1:] != kind[:-1]) | (kind[1:] == SINGLE) | edge[1:n]
        start, end = np.flatnonzero(begin), np.flatnonzero(close) + 1
        self.n = len(offsets) - 1
        self.first = np.searchsorted(start, offsets)
        self.text = np.repeat(np.arange(self.n), np.diff(self.first))
        self.value = _word_hashes(lower[points], start, end)
        number = kind[start] == DIGIT
        before = np.zeros(len(start), bool)
        before[1:] = self.text[1:] == self.text[:-1]
        # a capital makes a name unless the word begins a sentence: a stop stands between it and the word before
        ends = np.concatenate([[0], np.cumsum(stops[points] & ~joint)])
        opens = ~before
        opens[1:] |= ends[start[1:]] > ends[end[:-1]]
        number |= _among(self.value, NUMBER_WORDS)
        unit = _among(self.value, UNITS)
        unit[1:] &= number[:-1]
        unit &= before
        self.numbers = np.where(number, NUMBER, np.where(unit, UNIT, LITERAL)).astype(np.int8)
        self.capital, self.opens = capitals[points[start]] & (self.numbers == LITERAL), opens

    def streams(self) -> list[Stream]:
        name = self.capital & ~self.opens
        readings = [
            (np.zeros(len(self.value), np.int8), None),
            (self.numbers, self.numbers != LITERAL),
            (np.where(name, np.int8(NAME), self.numbers), name),
            (np.where(self.capital, np.int8(NAME), self.numbers), self.capital & self.opens),
        ]
        return [self._stream(*r) for r in readings]

    def _stream(self, kind: np.ndarray, new: np.ndarray | None) -> Stream:
        """Names that follow each other within a sentence are one token, as names may have any number of words."""
        name = kind == NAME
        later = np.zeros(len(kind), bool)
        later[1:] = name[1:] & name[:-1] & ~self.opens[1:]
        word = np.flatnonzero(~later)
        end = np.append(word[1:], len(kind)) if len(word) else word
        value = self.value[word]
        several = end - word > 1
        value[several] = mix(span_hashes(prefix_hashes(self.value), word[several], end[several]), 5)
        return Stream(self.n, self.text[word], word, kind[word], value, None if new is None else new[word])


_WINDOW = [
    *(T.StructField("hash", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("word", T.IntegerType())),
    *(T.StructField("slots", T.ArrayType(T.LongType())), T.StructField("size", T.IntegerType())),
    *(T.StructField("literal", T.BooleanType()), T.StructField("core", T.BooleanType())),
]


def _windows_of(texts: DataFrame, id_col: str, text_col: str, window: int, literals: int, sizes: Sequence[int] | None, wanted) -> DataFrame:
    """(id, hash, at, word, slots, size, literal, core) of the windows of all readings. ``at`` counts the tokens of the reading,
    ``word`` those of the text; ``literal``: of the first reading; ``core``: a window of the reading NAMES begins at this word.
    ``sizes``: of the windows, 0 for spans of ``literals`` literal words, or None for these and one size by text (the samples).
    ``wanted``: a broadcast filter, or None for all windows."""
    rows = texts.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = T.StructType([rows.schema[id_col], *_WINDOW])

    def found(streams: list[Stream]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(number of the reading, size, first token, behind last token, hash) of the windows."""
        for i, stream in enumerate(streams):
            count = np.diff(stream.first)
            least = 1 if i == 0 else LEAST_WORDS
            for size in sizes if sizes is not None else [RUN, *np.unique(np.minimum(count[count >= least], window)).tolist()]:
                if size == RUN:
                    at, end = stream.runs(literals)
                    yield i, size, at, end, mix(span_hashes(prefix_hashes(stream.sign), at, end), 40)
                    continue
                if sizes is None and i == OPENERS and size < window:
                    continue  # 'What is the capital of France?' isn't 'Rome is the capital of Italy.'
                at, end = stream.windows(size)
                if sizes is None:
                    right = np.minimum(count, window)[stream.text[at]] == size
                    at, end = at[right], end[right]
                yield i, size, at, end, mix(span_hashes(prefix_hashes(stream.sign), at, end), 40 + size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "__text", SLICE_BYTES):
                template = Template(*buffers(piece.column("__text")))
                streams = template.streams()
                core = np.zeros(len(template.value), bool)
                if sizes is None:
                    names = streams[NAMES]
                    count = np.minimum(np.diff(names.first), window)
                    for size in np.unique(count[count >= LEAST_WORDS]).tolist():
                        at = names.windows(size, every=True)[0]
                        core[names.word[at[count[names.text[at]] == size]]] = True
                for i, size, at, end, hashes in found(streams):
                    stream = streams[i]
                    if wanted is not None:
                        near = _passes(wanted.value, hashes)
                        at, end, hashes = at[near], end[near], hashes[near]
                    if not len(at):
                        continue
                    text = stream.text[at]
                    open_ = stream.kind != LITERAL
                    before = np.concatenate([[0], np.cumsum(open_)])
                    n_slots = before[end] - before[at]
                    values = stream.value[open_].view(np.int64)
                    ends = np.concatenate([[0], np.cumsum(n_slots)])
                    pick = np.arange(ends[-1]) + np.repeat(before[at] - ends[:-1], n_slots)
                    arrays = [
                        piece.column(0).take(pa.array(text)),
                        pa.array(hashes.view(np.int64)),
                        pa.array((at - stream.first[text]).astype(np.int32)),
                        pa.array((stream.word[at] - template.first[text]).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[pick])),
                        pa.array(np.full(len(at), size, np.int32)),
                        pa.array(np.full(len(at), i == 0)),
                        pa.array(core[stream.word[at]]),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)


def _filter(windows: DataFrame) -> np.ndarray:
    """Two bits for each hash, from its lower and its upper half modulo FILTER_BITS. At most FILTER_BITS / 64 rows come to the
    driver, whatever the benchmark."""
    halves = windows.select(F.explode(F.array("hash", F.expr("shiftrightunsigned(hash, 32)"))).alias("hash"))
    bit = F.pmod(F.col("hash"), F.lit(FILTER_BITS))
    words = halves.select((bit / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(hash, {FILTER_BITS}) % 64 as int))").alias("bit"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        out[row.word] = row.bits
    return out.view(np.uint64)


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    def has(half: np.ndarray) -> np.ndarray:
        bit = half & np.uint64(FILTER_BITS - 1)  # equals pmod, as FILTER_BITS is a power of two
        return (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0

    out = has(hashes)
    out[out] = has(hashes[out] >> np.uint64(32))
    return out


def find_leaks(
    page_texts: DataFrame,
    eval_samples: DataFrame,
    window: int = 8,
    coverage: float = 0.5,
    consistency: float = 0.8,
    page_col: str = "page_id",
    sample_col: str = "sample_id",
    text_col: str = "text",
    run: int = 13,
) -> DataFrame:
    """Pages whose recognised text holds an evaluation sample, verbatim or with other numbers, names or units.

    ``page_texts``: (``page_id``, ``text``); ``eval_samples``: (``sample_id``, ``text``); other columns are dropped. Words are
    runs of letters or of digits, and the single letters of scripts without spaces, so punctuation and case don't matter; a sample of fewer than ``window`` words is
    looked for as a whole, one of fewer than four words only verbatim. A window counts as found if all its words stand on
    the page, or the same template; a template without a literal word in four isn't compared. Number words count as numbers. A capital within a
    sentence makes a name, one that opens a sentence makes both a word and a name (only a word in samples of fewer than
    ``window`` words); names that follow each other are one.

    Returns one row for each page and sample: (page_id, sample_id, n_windows, n_matched, coverage, consistency, exact) where
    ``n_matched`` of the sample's ``n_windows`` windows stand on the page, a share of ``coverage`` or more (of all its windows, or of
    those whose template is compared, whichever share is larger), and of the sample's
    placeholder values met there a share of ``consistency`` or more always meets one and the same value of the page (1
    without placeholders, and if ``coverage`` is reached by equal words alone). A pair with less ``coverage`` counts as well if a
    run with ``run`` literal words of the sample stands on the page, whatever the sample's length (``consistency`` is then that of
    the run, if larger). ``exact`` says that all of them meet themselves.
    Null and empty texts have no windows. Repeated rows
    count once. Null ids are left out. Empty tables give an empty result. The filter and the joins take a benchmark of any size.
    """
    spark = page_texts.sparkSession
    samples = eval_samples.filter(F.col(sample_col).isNotNull())
    asked = _windows_of(samples, sample_col, text_col, window, run, None, None)
    renamed = {"word": "sample_word", "at": "sample_at", "slots": "asked", sample_col: "sample_id"}
    asked = written(asked.select(*(F.col(c).alias(renamed.get(c, c)) for c in asked.columns)), "leaks-samples")
    sizes = [r.size for r in asked.select("size").distinct().collect()]  # at most `window` + 1 of them
    wanted = spark.sparkContext.broadcast(_filter(asked))
    pages = page_texts.filter(F.col(page_col).isNotNull())
    found = _windows_of(pages, page_col, text_col, window, run, sorted(sizes), wanted).select(F.col(page_col).alias("page_id"), "hash", "at", "slots")
    met = written(found.join(asked, "hash"), "leaks-windows")

    key = ["page_id", "sample_id"]
    short = F.col("size") != RUN
    total = asked.filter(short).groupBy("sample_id").agg(F.countDistinct("sample_word").alias("words"), F.countDistinct(F.when(F.col("core"), F.col("sample_word"))).alias("cores"))
    # of a run, the share of its own values that meet one value of the page
    steady = "size(filter(array_distinct(asked), x -> size(array_distinct(filter(slots, (s, i) -> asked[i] = x))) = 1))"
    steady = F.when(~short, F.coalesce(F.expr(f"try_divide({steady}, size(array_distinct(asked)))"), F.lit(1.0)))
    marks = {"n": short, "n_core": short & F.col("core"), "n_literal": short & F.col("literal")}
    words = met.groupBy(*key, "sample_word").agg(F.max(steady).alias("run"), *(F.max(c).alias(k) for k, c in marks.items()))
    pairs = words.groupBy(*key).agg(F.max("run").alias("run"), *(F.count_if(k).alias(k) for k in marks))

    def share(part: str, of: str):
        return F.struct(F.coalesce(F.expr(f"try_divide({part}, {of})"), F.lit(0.0)).alias("share"), F.col(of).alias("of"), F.col(part).alias("part"))

    pairs = pairs.join(total, "sample_id").withColumn("best", F.greatest(share("n", "words"), share("n_core", "cores")))
    pairs = pairs.withColumn("same", F.col("n_literal") / F.col("words") >= coverage)
    pairs = pairs.filter((F.col("best.share") >= coverage) | (F.col("run") >= consistency))
    pairs = pairs.select(*key, "same", "run", F.col("best.of").alias("n_windows"), F.col("best.part").alias("n_matched"), F.col("best.share").alias("coverage"))

    # on one diagonal the windows of a copy follow each other, so its values are told from those of another copy
    zipped = F.explode(F.arrays_zip("asked", "slots")).alias("slot")
    slots = met.join(pairs.select(*key), key, "left_semi")
    slots = slots.select(*key, (F.col("at") - F.col("sample_at")).alias("shift"), zipped)
    values = slots.groupBy(*key, "shift", "slot.asked").agg(F.min("slot.slots").alias("low"), F.max("slot.slots").alias("high"))
    agreed = values.groupBy(*key).agg(
        F.avg((F.col("low") == F.col("high")).cast("double")).alias("consistency"),
        F.min((F.col("low") == F.col("asked")) & (F.col("high") == F.col("asked"))).alias("exact"),
    )
    out = pairs.join(agreed, key, "left").withColumns(
        {"consistency": F.when(F.col("same"), 1.0).otherwise(F.greatest(F.coalesce("consistency", F.lit(1.0)), "run")), "exact": F.coalesce("exact", F.lit(True))}
    )
    return out.filter(F.col("consistency") >= consistency).select(
        F.col("page_id").alias(page_col), F.col("sample_id").alias(sample_col), "n_windows", "n_matched", "coverage", "consistency", "exact"
    )
