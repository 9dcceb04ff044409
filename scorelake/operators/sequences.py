"""Common subsequences of token streams too long for one task."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.plans.lineage import cut
from scorelake.plans.skew import ordered

BLOCK = 16_384


@F.pandas_udf(
    T.StructType([T.StructField("v", T.BinaryType()), T.StructField("c", T.BinaryType())])
)
def _block(a: pd.Series, b: pd.Series, v: pd.Series, c: pd.Series) -> pd.DataFrame:
    """One block of the length table: edge bits in, edge bits out.

    ``v`` holds the row differences at the left edge (1 = no gain), ``c`` the
    column gains at the top edge; the carry of the addition is the gain below.
    """
    vs, cs = [], []
    for ta, tb, left, top in zip(a, b, v, c):
        size = len(ta)
        full = (1 << size) - 1
        where: dict = {}
        for i, token in enumerate(ta):
            where[token] = where.get(token, 0) | (1 << i)
        row = full if left is None else int.from_bytes(left, "little")
        gains = 0 if top is None else int.from_bytes(top, "little")
        out = 0
        for j, token in enumerate(tb):
            hits = row & where.get(token, 0)
            total = row + hits + ((gains >> j) & 1)
            if total >> size:
                out |= 1 << j
            row = (total | (row - hits)) & full
        vs.append(row.to_bytes(size // 8 + 1, "little"))
        cs.append(out.to_bytes(len(tb) // 8 + 1, "little"))
    return pd.DataFrame({"v": vs, "c": cs})


def _blocks(tokens: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    rows = ordered(tokens, keys, ["pos"], number="_n")
    rows = rows.withColumn(name, F.floor((F.col("_n") - 1) / size).cast("int"))
    lists = rows.groupBy(*keys, name).agg(F.array_sort(F.collect_list(F.struct("_n", "token"))).alias("t"))
    return cut(lists.select(*keys, name, F.col("t.token").alias(f"t_{name}")))


def long_lcs(
    gt: DataFrame, pred: DataFrame, keys: Sequence[str], *, block: int = BLOCK
) -> DataFrame:
    """(keys, n_gt, n_pred, lcs) of long token streams by diagonals of bounded blocks.

    Blocks of one diagonal are independent tasks; only their edge bits move on to
    the next diagonal, through the checkpoint folder.
    """
    keys = list(keys)
    a, b = _blocks(gt, keys, block, "i"), _blocks(pred, keys, block, "j")
    sizes = (
        a.groupBy(*keys).agg(F.sum(F.size("t_i")).alias("n_gt"), F.lit(0).cast("bigint").alias("n_pred"))
        .unionByName(
            b.groupBy(*keys).agg(F.sum(F.size("t_j")).alias("n_pred"), F.lit(0).cast("bigint").alias("n_gt"))
        )
        .groupBy(*keys)
        .agg(F.sum("n_gt").alias("n_gt"), F.sum("n_pred").alias("n_pred"))
    )
    last = a.agg(F.max("i")).first()[0], b.agg(F.max("j")).first()[0]
    edge = None
    if None not in last:
        left = a.select(*keys, "i", F.lit(None).cast("binary").alias("v"))
        top = b.select(*keys, "j", F.lit(None).cast("binary").alias("c"))
        edge = top
        for d in range(sum(last) + 1):
            now = (
                a.join(left, keys + ["i"])
                .withColumn("j", F.lit(d) - F.col("i"))
                .join(b.join(top, keys + ["j"]), keys + ["j"])
                .withColumn("o", _block("t_i", "t_j", "v", "c"))
            )
            now = cut(now.select(*keys, "i", "j", "o.v", "o.c"))
            left = cut(
                left.join(now, keys + ["i"], "left_anti").unionByName(now.select(*keys, "i", "v"))
            )
            top = cut(
                top.join(now, keys + ["j"], "left_anti").unionByName(now.select(*keys, "j", "c"))
            )
        edge = top
    if edge is None:
        return sizes.withColumn("lcs", F.lit(0).cast("bigint"))
    bits = F.aggregate(
        F.split(F.hex("c"), ""),
        F.lit(0).cast("bigint"),
        lambda acc, h: acc + F.when(h == "", 0).otherwise(F.bit_count(F.conv(h, 16, 10).try_cast("int"))),
    )
    found = edge.groupBy(*keys).agg(F.sum(F.coalesce(bits, F.lit(0))).alias("lcs"))
    return sizes.join(found, keys, "left").withColumn("lcs", F.coalesce("lcs", F.lit(0).cast("bigint")))
