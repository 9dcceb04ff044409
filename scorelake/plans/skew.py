"""Hot-key detection and ordered scans that survive a hot key.

A page, score or user may hold a large share of all rows. Every operator that
would put one key's rows into one task first *measures* the keys: one
map-side-combined count over the key columns only. When no key is above the
limit the plan stays a plain window or a bounded per-key array; otherwise the
hot keys are cut into ordered segments that become tasks of their own, and the
segment totals are carried over.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scorelake.plans.lineage import cut

SCAN_ROWS = 1_000_000  # rows of one key that one window task may take
FOLD_ROWS = 2_048  # rows of one key that one array fold may take
SEGMENTS = 512  # segments a hot key is cut into; a power of two
SAMPLE = 16  # sampled rows of a hot key for each segment
TASK_ROWS = 250_000  # rows that one task of a join or scan of ordinary keys may take
LITERAL_KEYS = 32  # hot keys up to this number are tagged by a plain condition
BROADCAST_KEYS = 10_000  # hot-key lists up to this counted size are broadcast


@dataclass(frozen=True)
class Hot:
    """Keys above ``limit`` rows; ``table`` is None when there are none. ``few``: the keys and
    their rows on the driver, unless there are too many."""

    keys: tuple[str, ...]
    limit: int
    table: DataFrame | None = None
    n: int = 0
    few: tuple[Row, ...] = ()

    def above(self, limit: int) -> Hot | None:
        """The keys above a larger limit, where that is known without another count."""
        if self.table is None:
            return Hot(self.keys, limit)
        if not self.few:
            return None
        return _listed(self.table.sparkSession, self.keys, limit, [r for r in self.few if r[-1] > limit], self.table.schema)

    def tag(self, df: DataFrame, name: str = "_hot") -> DataFrame:
        """Add a boolean column telling the rows of hot keys."""
        if self.table is None:
            return df.withColumn(name, F.lit(False))
        if 0 < len(self.few) <= LITERAL_KEYS and all(isinstance(v, (int, str)) for r in self.few for v in r):
            one = lambda r: reduce(and_, [F.col(k) == F.lit(v) for k, v in zip(self.keys, r)])
            return df.withColumn(name, F.coalesce(reduce(or_, map(one, self.few)), F.lit(False)))
        return df.join(
            small(self.table.withColumn(name, F.lit(True)), self.n), list(self.keys), "left"
        ).withColumn(name, F.coalesce(name, F.lit(False)))


def small(df: DataFrame, n: int) -> DataFrame:
    """Broadcast ``df`` only when its counted size allows it."""
    return F.broadcast(df) if n <= BROADCAST_KEYS else df


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row."""
    one = row.withColumn("__one", F.lit(1))
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(one), "__one").drop("__one")


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df`` dealt out by ``keys`` to tasks of about ``TASK_ROWS`` of the ``rows`` that meet in the next step.

    The session's number of shuffle partitions does not grow with the tables, so the sorts of one task would. Where that number
    is large enough the plan stays as it is. The other side of a join follows the larger number.
    """
    tasks = -(-rows // TASK_ROWS)
    if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(tasks, *keys)


def measure(df: DataFrame, keys: Sequence[str], limit: int) -> Hot:
    """Find the keys with more than ``limit`` rows (one pass over the key columns)."""
    return counted(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), keys, limit)


def counted(counts: DataFrame, keys: Sequence[str], limit: int) -> Hot:
    """Like :func:`measure`, from a table of the keys and their ``_rows``."""
    keys = list(keys)
    heavy = counts.select(*keys, "_rows").where(F.col("_rows") > limit)
    few = heavy.limit(BROADCAST_KEYS + 1).collect()
    if len(few) <= BROADCAST_KEYS:  # a list that is broadcast anyway
        return _listed(counts.sparkSession, tuple(keys), limit, few, counts.select(*keys).schema)
    table = cut(heavy.select(*keys))
    return Hot(tuple(keys), limit, table, table.count())


def _listed(spark: SparkSession, keys: tuple[str, ...], limit: int, few: list[Row], schema: StructType) -> Hot:
    """``few``: the hot keys, each with its rows in the last place."""
    if not few:
        return Hot(keys, limit)
    return Hot(keys, limit, spark.createDataFrame([tuple(r)[:-1] for r in few], schema), len(few), tuple(few))


def within(hot: Hot, df: DataFrame, keys: Sequence[str]) -> Hot:
    """The same question for finer ``keys`` of ``df``: none is hot when no coarse key is."""
    if hot.table is None:
        return Hot(tuple(keys), hot.limit)
    return measure(df, keys, hot.limit)


def apart(hot: Hot, few: Callable[..., DataFrame], many: Callable[..., DataFrame], *tables: DataFrame) -> DataFrame:
    """``few`` on the rows of ordinary keys, which one task takes whole, ``many`` on those of hot ones."""
    if hot.table is None:
        return few(*tables)
    tagged = [hot.tag(t) for t in tables]
    part = lambda h: [t.where(F.col("_hot") == h).drop("_hot") for t in tagged]
    return few(*part(False)).unionByName(many(*part(True)))


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def segments(df: DataFrame, hot: Hot, order: Sequence[str | Column]) -> DataFrame:
    """Add ``_seg``: 0 for ordinary keys, an ordered segment number for hot ones.

    Cut points are values of the whole order key (of any types), taken from a sample by
    hash of about ``SAMPLE`` rows per segment of each hot key, so every segment is a
    contiguous range of the order, also where its first columns hardly vary. Any cut
    points give the right result; they only balance the tasks.
    """
    keys = list(hot.keys)
    by = [c.alias(f"o{i}") for i, c in enumerate(_columns(order))]
    hot_rows = df.join(small(hot.table, hot.n), keys, "left_semi").select(*keys, F.struct(*by).alias("_o"))
    counts = hot_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    share = F.lit(float(SEGMENTS * SAMPLE)) / F.col("_rows")
    taken = F.pmod(F.xxhash64("_o"), F.lit(1 << 30)) < share * (1 << 30)
    sample = hot_rows.join(small(counts, hot.n), keys).where(taken).groupBy(*keys).agg(
        F.array_sort(F.collect_list("_o")).alias("_s")  # about SEGMENTS * SAMPLE rows
    )
    step = F.size("_s") / F.lit(float(SEGMENTS))
    pick = lambda i: F.get("_s", F.floor(i * step).cast("int"))
    cuts = cut(sample.select(*keys, F.transform(F.sequence(F.lit(1), F.lit(SEGMENTS - 1)), pick).alias("_cuts")))
    own = F.struct(*by)
    halves = F.array(*[F.lit(SEGMENTS >> k) for k in range(1, SEGMENTS.bit_length())])
    below = F.aggregate(  # binary search: how many cut points lie at or before the row
        halves, F.lit(0), lambda at, h: at + F.when(F.get("_cuts", at + h - 1) <= own, h).otherwise(0)
    )
    return (
        df.join(small(cuts, hot.n), keys, "left")
        .withColumn("_seg", F.when(F.col("_cuts").isNull(), 0).otherwise(below))
        .drop("_cuts")
        .repartition(*keys, "_seg")
    )


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    *,
    number: str | None = None,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    leads: Mapping[str, Column] | None = None,
    hot: Hot | None = None,
) -> DataFrame:
    """Running values per key in ascending ``order`` (a total order within a key).

    ``number`` is the 1-based row number; ``sums`` and ``maxima`` run over the rows
    *before* the current one (0 and null at the start); ``lags`` and ``leads`` take
    the neighbouring row. With hot keys the scan runs per (key, segment), the
    per-segment totals are scanned in a second, tiny window, and added back.
    """
    keys = list(keys)
    sums, maxima, lags, leads = (dict(m or {}) for m in (sums, maxima, lags, leads))
    by = _columns(order)
    hot = hot or measure(df, keys, SCAN_ROWS)
    split = hot.table is not None
    if split:
        df = segments(df, hot, order).withColumnRenamed("_seg", "__seg")
    part = keys + (["__seg"] if split else [])
    win = Window.partitionBy(*part).orderBy(*by)
    before = win.rowsBetween(Window.unboundedPreceding, -1)
    new = {n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()}
    new |= {n: F.max(c).over(before) for n, c in maxima.items()}
    new |= {n: F.lag(c).over(win) for n, c in lags.items()}
    new |= {n: F.lead(c).over(win) for n, c in leads.items()}
    if number or split:
        new[number or "__rn"] = F.row_number().over(win)
    if not split:
        return df.withColumns(new)
    rn = number or "__rn"
    key = F.struct(*by)
    totals = [F.count(F.lit(1)).alias("__rows")]
    totals += [F.sum(c).alias(f"__s_{n}") for n, c in sums.items()]
    totals += [F.max(c).alias(f"__m_{n}") for n, c in maxima.items()]
    totals += [F.max_by(F.struct(c.alias("v")), key).alias(f"__l_{n}") for n, c in lags.items()]
    totals += [F.min_by(F.struct(c.alias("v")), key).alias(f"__d_{n}") for n, c in leads.items()]
    wk = Window.partitionBy(*keys).orderBy("__seg")
    wb = wk.rowsBetween(Window.unboundedPreceding, -1)
    carry = df.groupBy(*keys, "__seg").agg(*totals)
    carry = carry.select(
        *keys,
        "__seg",
        F.col("__rows"),
        F.coalesce(F.sum("__rows").over(wb), F.lit(0)).alias("__before"),
        *[F.coalesce(F.sum(f"__s_{n}").over(wb), F.lit(0)).alias(f"__s_{n}") for n in sums],
        *[F.max(f"__m_{n}").over(wb).alias(f"__m_{n}") for n in maxima],
        *[F.lag(f"__l_{n}").over(wk)["v"].alias(f"__l_{n}") for n in lags],
        *[F.lead(f"__d_{n}").over(wk)["v"].alias(f"__d_{n}") for n in leads],
    )
    out = df.withColumns(new).join(carry, keys + ["__seg"], "left")
    fix = {n: F.col(n) + F.col(f"__s_{n}") for n in sums}
    fix |= {n: F.greatest(n, f"__m_{n}") for n in maxima}
    fix |= {n: F.when(F.col(rn) == 1, F.col(f"__l_{n}")).otherwise(F.col(n)) for n in lags}
    fix |= {
        n: F.when(F.col(rn) == F.col("__rows"), F.col(f"__d_{n}")).otherwise(F.col(n)) for n in leads
    }
    if number:
        fix[number] = (F.col(number) + F.col("__before")).cast("int")
    out = out.withColumns(fix)
    spare = [c for c in out.columns if c in ("__seg", "__rows", "__before", "__rn")]
    spare += [c for c in out.columns if c[:4] in ("__s_", "__m_", "__l_", "__d_")]
    return out.drop(*spare)


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    at: Column,
    reach: Column,
    gap: Column,
    *,
    name: str = "_island",
    hot: Hot | None = None,
    inclusive: bool = False,
) -> DataFrame:
    """Number the stretches of a sorted sequence that cannot influence each other.

    A row opens a stretch when ``at`` lies more than ``gap`` (at least ``gap`` when
    ``inclusive``) beyond the largest ``reach`` of all rows before it.
    """
    keys = list(keys)
    hot = hot or measure(df, keys, SCAN_ROWS)
    df = ordered(df, keys, order, maxima={"_far": reach}, hot=hot)
    step = at - F.col("_far")
    opens = F.when(step >= gap if inclusive else step > gap, 1).otherwise(0)
    df = df.withColumn("_open", opens).drop("_far")
    df = ordered(df, keys, order, sums={name: F.col("_open")}, hot=hot)
    return df.withColumn(name, F.col(name) + F.col("_open")).drop("_open")
