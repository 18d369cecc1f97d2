"""One piece for each code within a photo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import free


def resolve(results: DataFrame, photo: str = "photo_id", order: str = "piece_ord") -> DataFrame:
    """Of the results of one photo with one code, the most confident keeps it; of equal ones the first.

    The others lose code and confidence and get the method ``conflict``; their raw text and angle
    stay. Results without a code, null or empty, are untouched and spread over partitions, so
    that they form no large group.
    """
    has = F.coalesce(F.col("code"), F.lit("")) != ""
    ranked = W.partitionBy(photo, "code", F.when(has, F.lit(0)).otherwise(F.col(order))).orderBy(F.desc("confidence"), order)
    name = free(results, "_lost")
    out = results.withColumn(name, has & (F.row_number().over(ranked) > 1))
    lost = F.col(name)
    changed = {"code": F.when(~lost, F.col("code")), "confidence": F.when(lost, F.lit(0.0)).otherwise(F.col("confidence")), "method": F.when(lost, F.lit("conflict")).otherwise(F.col("method"))}
    return out.withColumns(changed).drop(name)
