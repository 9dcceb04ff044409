"""Product codes of vectors with exact integer arithmetic.

Components become integers, and all distances are exact: integers are cut into limbs so small that a float64 matrix
product of limbs has no rounding (every sum of products stays below 2**53), and the products are put together in int64.
So codes, codebooks and errors are the same on every machine and with any number of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.exchange import written
from scorelake.plans.skew import attach_row

#: Vectors compared with the codebooks at a time.
BLOCK = 512
#: Integers from this size on can't be squared and summed within 64 bits.
LARGEST = 1 << 27
#: Tables of label sums up to this counted size are broadcast.
BROADCAST_LABELS = 10_000


@dataclass(frozen=True)
class VectorCodes:
    """``codes``: (vec_id, label, code, error, label_error); ``codebooks``: int64 of shape (parts, entries, components)."""

    codes: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all entries' components as decimal numbers, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def limbs(values: np.ndarray, width: int) -> list[np.ndarray]:
    """Float64 arrays whose sum with weights 2 ** (width * i) is ``values``; all but the last lie in [0, 2 ** width)."""
    out, rest = [], values
    while len(out) == 0 or rest.any():
        if ((rest >= -(1 << width)) & (rest < (1 << width))).all():
            return [*out, rest.astype(np.float64)]
        out.append((rest & ((1 << width) - 1)).astype(np.float64))
        rest = rest >> width
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for int64 arrays by float64 products of limbs, exact as long as the result fits 64 bits."""
    width = (53 - max(a.shape[-1] - 1, 1).bit_length()) // 2
    out = np.zeros((*a.shape[:-1], b.shape[-1]), np.int64)
    for i, x in enumerate(limbs(a, width)):
        for j, y in enumerate(limbs(b, width)):
            out += np.matmul(x, y).astype(np.int64) << np.int64(width * (i + j))
    return out


def nearest(parts: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First nearest entry of each part and its squared distance. ``parts``: (n, parts, components), both int64."""
    by_part = np.ascontiguousarray(parts.transpose(1, 0, 2))
    squares = (codebooks**2).sum(axis=2)[:, None, :] - 2 * exact_products(by_part, np.ascontiguousarray(codebooks.transpose(0, 2, 1)))
    code = squares.argmin(axis=2)  # the first of several least ones
    least = np.take_along_axis(squares, code[:, :, None], axis=2)[:, :, 0] + (by_part**2).sum(axis=2)
    return code.T, least.T


def _blocks(batch: pa.RecordBatch, shape: tuple[int, int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, row behind the last, and the integer parts of the rows between."""
    column = batch.column("parts")
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, *shape)
    for at in range(0, len(values), BLOCK):
        yield at, min(at + BLOCK, len(values)), values[at : at + BLOCK]


def _integers(vectors: DataFrame, names: tuple[str, str, str], parts: int, scale: float) -> tuple[DataFrame, int]:
    """(vec_id, label, parts): usable vectors as integers, with zeros up to a multiple of ``parts``; and the components of a part."""
    ident, vector, label = (F.col(c) for c in names)
    rows = vectors.select(ident.alias("vec_id"), label.alias("label"), F.transform(vector.cast("array<double>"), lambda x: x * scale).alias("x"))
    usable = F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)) & (F.size("x") > 0)
    rows = rows.filter(F.coalesce(usable, F.lit(False)))
    sizes = rows.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    common = sizes.agg(F.max(F.struct("rows", "n"))["n"]).first()[0] or 0
    width = -(-common // parts)
    whole = F.transform("x", lambda x: F.floor(x).cast("long"))
    padded = F.concat(whole, F.array_repeat(F.lit(0).cast("long"), parts * width - common))
    return written(rows.filter(F.size("x") == common).select("vec_id", "label", padded.alias("parts")), "codes-vectors"), width


def _sums(vectors: DataFrame, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of each entry: their componentwise sums and their number. What comes to the driver has the codebooks' size."""
    shape = codebooks.shape
    slots = shape[0] * shape[1] * (shape[2] + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((shape[0], shape[1], shape[2] + 1), np.int64)
        for batch in batches:
            for _, _, block in _blocks(batch, (shape[0], shape[2])):
                code = nearest(block, codebooks)[0]
                row = np.concatenate([block, np.ones((*block.shape[:2], 1), np.int64)], axis=2)
                np.add.at(total, (np.arange(shape[0])[None, :], code), row)
        used = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.ravel()[used])], names=["slot", "total"])

    found = vectors.select("parts").mapInArrow(run, "slot bigint, total bigint").groupBy("slot").agg(F.sum("total").alias("total"))
    out = np.zeros(slots, np.int64)
    for row in found.collect():
        out[row.slot] = row.total
    out = out.reshape(shape[0], shape[1], shape[2] + 1)
    return out[:, :, :-1], out[:, :, -1]


def vector_codes(
    vectors: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> VectorCodes:
    """Compress vectors to one byte per part, by codebooks that are trained on all of them.

    Scores and pages hold no vectors of their own, so this operator is general. ``vectors``: (``vec_id``, ``embedding``
    array of numbers, ``label``); other columns are dropped. Each component x becomes floor(``scale`` * x). A vector is cut into ``parts`` (zeros
    are added behind it if its length is no multiple) and each part goes to the nearest entry of its position's codebook, by
    squared distance, the first at a tie. Codebooks start as the parts of the ``entries`` (256 at most) smallest vec_ids, ascending (null last;
    repeated ids by their components) and are replaced ``rounds`` times by the floored means of their parts; entries without
    parts stay.

    Left out are vectors that are null or empty, hold null, NaN or infinite components or such whose integer is 2**27 or more in size, or
    have another length than most (at a tie the longer ones stay). With fewer vectors than ``entries`` there are as many
    entries as vectors. Repeated rows are coded each. Without vectors the codes are empty, and so are the codebooks.

    ``codes``: (vec_id, label, code binary, error, label_error), ``error`` being the squared distances summed over the parts
    and ``label_error`` its sum over the vectors with an equal label (those without together). Floating labels count as Spark's grouping counts them.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("entries must be 1 to 256 and parts positive")
    whole, width = _integers(vectors, (id_col, vector_col, label_col), parts, scale)
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).collect()
    codebooks = np.array([r.parts for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if first else 0):
        total, count = _sums(whole, codebooks)
        used = count > 0
        codebooks[used] = total[used] // count[used][:, None]  # numpy's division floors

    schema = whole.select("vec_id", "label").schema.add("code", "binary").add("error", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, block in _blocks(batch, (parts, width)):
                code, error = nearest(block, codebooks)
                raw = code.astype(np.uint8).tobytes()
                codes = pa.array([raw[parts * i : parts * (i + 1)] for i in range(len(code))], pa.binary())
                arrays = [batch.column("vec_id").slice(at, to - at), batch.column("label").slice(at, to - at), codes, pa.array(error.sum(axis=1))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    coded = written(whole.mapInArrow(run, schema), "codes-rows")
    # by label, then back to its rows: a label may hold any share of them
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "codes-labels")
    known = sums.filter("label is not null")
    known = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    none = sums.filter("label is null").agg(F.max("label_error").alias("without"))
    out = attach_row(coded.join(known, "label", "left"), none)
    columns = [F.col("vec_id").alias(id_col), F.col("label").alias(label_col), "code", "error", F.coalesce("label_error", "without").alias("label_error")]
    return VectorCodes(out.select(*columns), codebooks)
