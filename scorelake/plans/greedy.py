"""One-to-one matching in a total order of the candidate edges.

Box matching by overlap, in-order matching by distance and best-remaining matching are the same problem: walk the edges
in a fixed order and take an edge when both ends are free. The edges of a key are sorted on disk and walked as a stream, so a
task remembers the ends that are taken but never holds the edges, however many a pile of boxes has. What a key's walk
decides in one connected component doesn't touch another, so the hot keys are dealt out by component.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.plans.components import components
from scorelake.plans.lineage import cut
from scorelake.plans.skew import Hot, measure

#: Boxes of one key, on both sides together, whose edges one task may walk.
WALK_BOXES = 200_000
#: Rounds in which the edges of whole keys are taken side by side.
ROUNDS = 64


def _breaks(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Rows whose key is another than that of the row before."""
    new = np.zeros(max(batch.num_rows - 1, 0), bool)
    for name in keys:
        codes = batch.column(name).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new |= codes[1:] != codes[:-1]
    return np.flatnonzero(new) + 1


def _ends(column: pa.Array) -> list:
    """The ends of edges as values that a set can hold."""
    return [repr(x) for x in column.to_pylist()] if pa.types.is_nested(column.type) else column.to_pylist()


def _take(batch: pa.RecordBatch, a: int, b: int, truths: set, guesses: set) -> list[int]:
    """Walk the edges from ``a`` to ``b`` of one key, one by one."""
    g, p = (_ends(batch.column(c).slice(a, b - a)) for c in ("gi", "pi"))
    taken = []
    for i in range(b - a):
        if g[i] not in truths and p[i] not in guesses:
            truths.add(g[i])
            guesses.add(p[i])
            taken.append(a + i)
    return taken


def _codes(batch: pa.RecordBatch, side: str, key: np.ndarray, a: int, b: int) -> np.ndarray:
    """Numbers of the ends, another one in every key."""
    column = batch.column(side).slice(a, b - a)
    if pa.types.is_nested(column.type):
        column = pa.array(_ends(column))
    codes = column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.unique(key * (int(codes.max()) + 1) + codes, return_inverse=True)[1]


def _take_whole(batch: pa.RecordBatch, keys: list[str], a: int, b: int) -> list[int]:
    """Walk the edges of whole keys at once: an edge that comes first at both its ends is taken in any
    walk, and the edges of its ends go. What is left after ``ROUNDS`` (chains of edges) is walked one by one."""
    if a == b:
        return []
    key = np.zeros(batch.num_rows, np.int64)
    key[_breaks(batch, keys)] = 1
    key = np.cumsum(key)[a:b]
    g, p = _codes(batch, "gi", key, a, b), _codes(batch, "pi", key, a, b)
    left, taken = np.arange(b - a), []
    busy_g, busy_p = np.zeros(g.max() + 1, bool), np.zeros(p.max() + 1, bool)
    first_g, first_p = np.empty(len(busy_g), np.int64), np.empty(len(busy_p), np.int64)
    for _ in range(ROUNDS):
        if not len(left):
            break
        back = left[::-1]
        first_g[g[back]], first_p[p[back]] = back, back  # the last value written stays, which is the first edge
        new = left[(first_g[g[left]] == left) & (first_p[p[left]] == left)]
        taken += new.tolist()
        busy_g[g[new]], busy_p[p[new]] = True, True
        left = left[~(busy_g[g[left]] | busy_p[p[left]])]
    for i in left.tolist():
        if not busy_g[g[i]] and not busy_p[p[i]]:
            busy_g[g[i]], busy_p[p[i]] = True, True
            taken.append(i)
    return [a + i for i in sorted(taken)]


def _walk(edges: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    by = [*order, *(c for c in ("gi", "pi") if c not in order)]
    columns = [*keys, "gi", "pi", "w"]
    rows = edges.withColumn("w", F.col("w").cast("double")).repartition(*keys).sortWithinPartitions(*keys, *by).select(*columns)
    schema = T.StructType([rows.schema[c] for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, truths, guesses = None, set(), set()
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = [0, *_breaks(batch, keys).tolist(), batch.num_rows]
            a, b = ends[1], ends[-2]  # whole keys lie between; the first key may go on from the batch before, the last one into the next
            key = tuple(batch.column(c)[0].as_py() for c in keys)
            if key != last:
                truths, guesses = set(), set()
            taken = _take(batch, 0, a, truths, guesses)
            if b >= a:
                taken += _take_whole(batch, keys, a, b)
                truths, guesses = set(), set()
                taken += _take(batch, b, batch.num_rows, truths, guesses)
            last = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in keys)
            yield pa.RecordBatch.from_arrays([pc.take(x, pa.array(taken, pa.int64())) for x in batch.columns], names=columns)

    return rows.mapInArrow(run, schema)


def crowded(gt: DataFrame, pred: DataFrame, keys: Sequence[str]) -> Hot:
    """The keys with too many boxes for one walk, from the key columns of both sides."""
    return measure(gt.select(*keys).unionByName(pred.select(*keys)), keys, WALK_BOXES)


def greedy_pairs(edges: DataFrame, keys: Sequence[str], order: Sequence[str], hot: Hot) -> DataFrame:
    """Pairs (gi, pi, w) taken from ``edges`` in ``order``, ties by (gi, pi). ``hot``: the keys of ``crowded``."""
    keys, order = list(keys), list(order)
    if hot.table is None:
        return _walk(edges, keys, order)
    edges = hot.tag(edges)
    node = lambda side: F.xxhash64(*keys, F.lit(side), F.col(side))  # equal hashes only join components, which is harmless
    heavy = cut(edges.where("_hot").drop("_hot").withColumns({"_a": node("gi"), "_b": node("pi")}))
    label = components(heavy, "_a", "_b").select(F.col("node").alias("_a"), F.col("label").alias("_part"))
    heavy = heavy.join(label, "_a").drop("_a", "_b")
    cold = edges.where(~F.col("_hot")).drop("_hot").withColumn("_part", F.lit(0).cast("bigint"))
    return _walk(cold.unionByName(heavy), [*keys, "_part"], order).drop("_part")
