"""Substring deduplication by word windows, with difference-cover anchors.

Only windows that begin at cover positions of a text are compared first. The cover holds every difference modulo
its period, so two equal windows of ``window`` words, wherever they stand, share an aligned anchor: at some shift below
the period both have a cover position, and from there ``window - period + 1`` words are equal. Windows around an anchor
that occurs twice are then extended to their full length and compared by 128 bits of two independent hashes of all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scorelake.llm.arrays import Words, covered, mix, strings
from scorelake.llm.exchange import (
    Chunk,
    Keys,
    answer,
    answers_of,
    ask,
    bucket_count,
    chunks_of,
    shared_keys,
    shared_pairs,
    with_answers,
    write_chunks,
    written,
)

#: Perfect difference covers: every number modulo the period is a difference of two members. Fixed values.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
#: Words of an anchor at least; shorter ones would be common phrases.
ANCHOR_WORDS = 12


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The sparsest cover whose anchors for windows of ``window`` words are long enough; (1, (0,)) takes all positions."""
    fits = [p for p in COVERS if window - p + 1 >= ANCHOR_WORDS]
    return (max(fits), COVERS[max(fits)]) if fits else (1, (0,))


class _Passages:
    """The words of a chunk with its anchors, candidate windows and repeated windows."""

    def __init__(self, chunk: Chunk, window: int) -> None:
        self.window, self.period = window, cover_for(window)[0]
        self.chunk, self.words = chunk, Words(chunk.data, chunk.offsets)
        self.hashes = self.words.hashes(0)

    def anchors(self, buckets: int) -> Keys:
        cover = np.zeros(self.period, bool)
        cover[list(cover_for(self.window)[1])] = True
        at, hashes = self.words.windows(self.window - self.period + 1, self.hashes)
        place = at - self.words.first[:-1][self.words.text[at]] if len(at) else at
        taken = cover[place % self.period]
        self.at = at[taken]
        return Keys(mix(hashes[taken], 1), buckets)

    def extended(self, buckets: int, answers: dict) -> Keys:
        """The full windows around the anchors that occur again, in this chunk or another."""
        keys = self.anchors(buckets)
        again = self.at[(keys.count[keys.which] > 1) | keys.marked(answers)]
        # an anchor belongs to the windows that begin at most period - 1 words before it
        before = np.concatenate([[0], np.cumsum(np.bincount(again, minlength=len(self.words) + self.period))])
        starts, hashes = self.words.windows(self.window, self.hashes)
        held = before[starts + self.period] > before[starts]
        self.starts = starts[held]
        check = self.words.windows(self.window, self.words.hashes(1))[1]
        return Keys(mix(hashes[held], 2), buckets, check[held])

    def repeated(self, buckets: int, first: dict, second: dict) -> np.ndarray:
        """For each word, whether a window that occurs again covers it."""
        keys = self.extended(buckets, first)
        again = self.starts[(keys.count[keys.which] > 1) | keys.marked(second)]
        return covered(again, self.window, len(self.words))

    def without(self, removed: np.ndarray, kind: pa.DataType) -> pa.Array:
        """The texts as their kept words, joined by one space."""
        return strings(*self.words.joined(np.flatnonzero(~removed)), kind)


def remove_repeated_passages(page_texts: DataFrame, window: int = 35, page_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """Take passages that stand in the recognised texts more than once out of all of them.

    ``page_texts``: (``page_id`` of any type, ``text``), one row per page; other columns are dropped. Words are maximal
    runs of characters other than 0x20 and 0x09-0x0D, taken unchanged. A word goes if it lies in ``window`` consecutive
    words of its text that also start anywhere else, in the same text or another; all are judged on the input.

    Returns (page_id, n_words, n_removed, text), text being the kept words joined by one space. A null or empty text has
    no words and stays as an empty text. Texts of fewer than ``window`` words lose nothing. A page that is listed twice
    counts as two texts. An empty table gives an empty result. One text has to fit a task's memory (about 40 times its size).
    Windows are compared by 128 bits: two hashes of all their words' bytes, mixed without a polynomial, so that words built to
    collide under one are nothing special to it. Of n windows about ``n ** 2 / 2 ** 129`` pairs can be taken for equal by
    accident, 1e-11 for 1e14 windows.
    """
    chunks = write_chunks(page_texts, page_col, text_col, "passages")
    buckets = bucket_count(chunks, 64 << 20)

    def anchors(_: int, chunk: Chunk, row: dict) -> Iterator[tuple[int, bytes]]:
        yield from _Passages(chunk, window).anchors(buckets).questions()

    def extended(_: int, chunk: Chunk, row: dict) -> Iterator[tuple[int, bytes]]:
        yield from _Passages(chunk, window).extended(buckets, answers_of(row, "anchors")).questions()

    first = written(answer(ask(chunks, anchors), shared_keys), "passages-anchors")
    known = with_answers(chunks, first, "anchors")
    second = written(answer(ask(known, extended), shared_pairs), "passages-windows")
    known = with_answers(known, second, "windows")

    schema = T.StructType(
        [
            T.StructField(page_col, page_texts.schema[page_col].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField(text_col, T.StringType()),
        ]
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk, row in chunks_of(batches):
            texts = _Passages(chunk, window)
            removed = texts.repeated(buckets, answers_of(row, "anchors"), answers_of(row, "windows"))
            gone = np.concatenate([[0], np.cumsum(removed)])[texts.words.first]
            yield pa.RecordBatch.from_arrays(
                [chunk.ids, pa.array(np.diff(texts.words.first)), pa.array(np.diff(gone)), texts.without(removed, pa.string())],
                names=schema.names,
            )

    return known.mapInArrow(keep, schema)
