"""Best-fit packing into sequences of several permitted lengths.

Sequences are dealt to shards of bounded size by a hash. In a shard, from the longest to the shortest, each goes into the
open bin with the least room left that still holds it. If none does, a bin is opened at the capacity of least cost: its
price less what its remaining room is worth, which is the room that sequences still to come can fill, at the cheapest
price of a token. At the end each bin shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.exchange import written

#: Copies of one row that are numbered at a time.
COPIES = 1 << 16
PACKED = ("bin_id", "capacity", "used", "piece", "first_token", "n_tokens", "place")


def best_fit(sizes: np.ndarray, capacities: Sequence[int], overhead: float) -> tuple[np.ndarray, np.ndarray]:
    """Bin number of each size, and the capacity of each bin. ``sizes``: descending, each within the largest capacity."""
    capacities = sorted(capacities)
    unit = min((c + overhead) / c for c in capacities)
    # by room: how many tokens the sequences that fit it hold altogether, among those still to come
    order = np.sort(sizes)
    total = np.concatenate([[0], np.cumsum(order)])
    bins, room, content = np.empty(len(sizes), np.int64), [], []
    open_: dict[int, list[int]] = {}  # bins by the room they have left
    mask = 0  # the keys of open_ as bits
    for i, size in enumerate(sizes.tolist()):
        above = mask >> size
        if above:
            left = size + (above & -above).bit_length() - 1
            b = open_[left].pop()
            if not open_[left]:
                mask &= ~(1 << left)
        else:
            coming = len(sizes) - i - 1  # the smallest ones, order[:coming]

            def price(c: int, size: int = size, coming: int = coming) -> tuple[float, int]:
                rest = c - size
                usable = min(rest, int(total[min(coming, int(np.searchsorted(order, rest, "right")))]))
                return c + overhead - unit * usable, c

            left = min((c for c in capacities if c >= size), key=price)
            b = len(room)
            room.append(left)
            content.append(0)
        left -= size
        content[b] += size
        bins[i] = b
        if left:
            open_.setdefault(left, []).append(b)
            mask |= 1 << left
    used = np.array(content, np.int64)
    return bins, np.array(capacities)[np.searchsorted(capacities, used)] if len(used) else used


def pack_sequences(
    score_tokens: DataFrame,
    capacities: Sequence[int] = (512, 1024, 2048, 4096),
    overhead: float = 16.0,
    separator: int = 1,
    shard_rows: int = 2000,
    score_col: str = "score_id",
    tokens_col: str = "n_tokens",
) -> DataFrame:
    """Pack the token sequences of scores into training sequences of the lengths ``capacities``.

    ``score_tokens``: (``score_id``, ``n_tokens``), one row per score; other columns are dropped. Each sequence ends with
    ``separator`` further tokens; one that is longer than the largest capacity is cut into pieces of that length and a rest.
    A training sequence of length c costs c + ``overhead``. A shard holds about ``shard_rows`` pieces; their number
    follows the input, and which shard a piece goes to hangs on its score, its count, its piece and the number of its copy only.

    Returns one row per piece: (score_id, bin_id, capacity, used, piece, first_token, n_tokens, place): the bin, its
    permitted length after downsizing, the tokens in it, and the piece's number, first token, length (with separator)
    and place in the bin. Null and negative counts stand for no tokens: with a separator such a score takes one place,
    without one it gives no row. A score that is listed several times (null, too) is packed as often; such rows are numbered and spread over
    the shards. An empty table gives an empty result.
    """
    if not capacities or min(capacities) < 1 or separator < 0:
        raise ValueError("capacities must be positive and the separator not negative")
    most = max(capacities)
    size = F.greatest(F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)), F.lit(0)) + separator
    # equal rows are counted, written once, and numbered again: a score that very many rows name doesn't meet in one shard
    sizes = score_tokens.select(F.col(score_col), size.alias("__size")).filter("__size > 0")
    sizes = written(sizes.groupBy(score_col, "__size").agg(F.count(F.lit(1)).alias("__copies")), "packing-sizes")
    first = F.col("__block") * COPIES
    pieces = (
        sizes.withColumn("__block", F.explode(F.sequence(F.lit(0), F.expr(f"(__copies - 1) div {COPIES}"))))
        .withColumn("__copy", F.explode(F.sequence(first, F.least(first + COPIES, "__copies") - 1)))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"cast((__size - 1) div {most} as int)"))))
        .withColumn("first_token", F.col("piece").cast("long") * most)
        .withColumn("n_tokens", F.least(F.lit(most), F.col("__size") - F.col("first_token")).cast("long"))
    )
    total = sizes.agg(F.coalesce(F.sum(F.ceil(F.col("__size") / most) * F.col("__copies")), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // shard_rows))
    schema = score_tokens.select(score_col).schema
    for name in PACKED:
        schema = schema.add(name, "integer" if name == "piece" else "long")
    kept = [score_col, "piece", "first_token", "n_tokens"]

    def pack(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        # the ties are ordered too, so that a task that runs again packs alike
        order = [("n_tokens", "descending"), *((c, "ascending") for c in ("__key", "piece", "first_token"))]
        table = table.sort_by(order)
        sizes = table.column("n_tokens").to_numpy()
        bins, capacity = best_fit(sizes, capacities, overhead)
        by_bin = np.argsort(bins, kind="stable")
        before = np.cumsum(sizes[by_bin]) - sizes[by_bin]
        first = np.searchsorted(bins[by_bin], np.arange(len(capacity)))
        place = np.empty(len(sizes), np.int64)
        place[by_bin] = before - before[first][bins[by_bin]]
        used = np.bincount(bins, weights=sizes, minlength=len(capacity)).astype(np.int64)
        columns = {score_col: table.column(score_col), "bin_id": pa.array((np.int64(shard) << 32) + bins)}
        columns |= {"capacity": pa.array(capacity[bins].astype(np.int64)), "used": pa.array(used[bins])}
        columns |= {c: table.column(c) for c in kept[1:]} | {"place": pa.array(place)}
        return pa.table(columns)

    dealt = pieces.withColumn("__key", F.xxhash64(score_col, "__size", "piece", "__copy")).drop("__size", "__copies", "__block", "__copy")
    dealt = dealt.withColumn("shard", F.pmod(F.col("__key"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(pack, schema)
