"""Running totals along an order over all rows, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import free

#: Ranges that the order is cut into, one less of bounds coming to the driver.
RANGES = 256


def running(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over a row and all before it by ``key``.

    The order is cut into ranges at the keys of RANGES - 1 rows of least hash, the only ones that
    come to the driver. Each range has a window of its own; the totals of ranges, RANGES rows at
    most, are added up in one small window and joined to them. Keys should be distinct: of rows
    with equal keys any may count as first. Null keys come before all others. An empty table gives
    an empty one. ``rows`` is read once for the bounds and twice for the result.
    """
    at, before = free(rows, "_range"), free(rows, "_before")
    picked = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).orderBy(F.xxhash64("k"), "k").limit(RANGES - 1).collect()
    bounds = sorted({r["k"] for r in picked})
    spot = F.size(F.filter(F.lit(bounds), lambda b: b <= F.col(key))) + F.col(key).isNotNull().cast("int") if bounds else F.lit(0)
    dealt = rows.withColumn(at, spot)
    totals = dealt.groupBy(at).agg(F.sum(value).alias("total"))
    earlier = W.orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(at, F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias(before))
    within = W.partitionBy(at).orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = dealt.withColumn(name, F.sum(value).over(within)).join(F.broadcast(starts), at)
    return summed.withColumn(name, F.col(name) + F.col(before)).drop(at, before)
