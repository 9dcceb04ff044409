"""Registry of the queries over the driver tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.adapters import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return wrap


def r6(*names: str) -> list[Column]:
    """Doubles rounded for comparison, under their own names."""
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def big(*names: str) -> list[Column]:
    """Whole numbers as bigint, under their own names."""
    return [F.col(n).cast("bigint").alias(n) for n in names]


def prf_sql(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    p = f"(CASE WHEN {tp}+{fp} > 0 THEN CAST({tp} AS DOUBLE)/({tp}+{fp}) WHEN {fn} = 0 THEN 1.0 ELSE 0.0 END)"
    r = f"(CASE WHEN {tp}+{fn} > 0 THEN CAST({tp} AS DOUBLE)/({tp}+{fn}) WHEN {fp} = 0 THEN 1.0 ELSE 0.0 END)"
    f1 = f"(CASE WHEN {p}+{r} > 0 THEN 2*{p}*{r}/({p}+{r}) ELSE 0.0 END)"
    return (
        f"round(CAST({p} AS DOUBLE),6) AS precision, round(CAST({r} AS DOUBLE),6) AS recall, "
        f"round(CAST({f1} AS DOUBLE),6) AS f1"
    )


def greedy_sql(keys: list[str], order: str, edges: str = "edges") -> str:
    """CTEs ``ranked, walk``: edges (keys, gi, pi, w) walked in ``order`` with used lists."""
    k = ", ".join(keys)
    rk = ", ".join(f"r.{c}" for c in keys)
    on = " AND ".join(f"r.{c} = u.{c}" for c in keys)
    busy = "(list_contains(u.ug, r.gi) OR list_contains(u.up, r.pi))"
    return f"""ranked AS (SELECT {k}, gi, pi, w, row_number() OVER (PARTITION BY {k} ORDER BY {order}) AS k FROM {edges}),
walk AS (
  SELECT {k}, k, gi, pi, w, true AS taken, [gi] AS ug, [pi] AS up FROM ranked WHERE k = 1
  UNION ALL
  SELECT {rk}, r.k, r.gi, r.pi, r.w, NOT {busy},
         CASE WHEN {busy} THEN u.ug ELSE list_append(u.ug, r.gi) END,
         CASE WHEN {busy} THEN u.up ELSE list_append(u.up, r.pi) END
  FROM walk u JOIN ranked r ON {on} AND r.k = u.k + 1)"""


def iou_sql(g: str = "g", p: str = "p") -> str:
    iw = f"greatest(0.0, least({g}.x2,{p}.x2) - greatest({g}.x1,{p}.x1))"
    ih = f"greatest(0.0, least({g}.y2,{p}.y2) - greatest({g}.y1,{p}.y1))"
    ga, pa = f"({g}.x2-{g}.x1)*({g}.y2-{g}.y1)", f"({p}.x2-{p}.x1)*({p}.y2-{p}.y1)"
    return f"(CASE WHEN {iw}*{ih} > 0 THEN {iw}*{ih} / ({ga} + {pa} - {iw}*{ih}) ELSE 0.0 END)"
