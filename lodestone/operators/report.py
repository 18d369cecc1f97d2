"""Calibration and benchmark reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions.text import percent
from .order import running


def confidence_distribution(pieces: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(n, low, q25, mid, high, unsure) of recognized pieces' confidences, quartiles by place in sorted order.

    The values at places n // 4 and n // 2 come from running counts of distinct values, cut into
    ranges: no task sorts all pieces, or all values.
    """
    hit = pieces.where(F.coalesce("code", F.lit("")) != "")
    counts = hit.groupBy("confidence").agg(F.count("*").alias("c"))
    runs = running(counts, "confidence", F.col("c"), "upto")
    n = counts.agg(F.sum("c").alias("n"))
    at = lambda d: F.min(F.when(F.col("upto") > F.floor(F.col("n") / d), F.col("confidence")))
    unsure = F.sum(F.when(F.col("confidence") < settings.enough, F.col("c")))
    found = runs.join(F.broadcast(n), how="cross").agg(F.sum("c").alias("n"), F.min("confidence").alias("low"), at(4).alias("q25"), at(2).alias("mid"), F.max("confidence").alias("high"), unsure.alias("unsure"))
    return found.na.fill(0, ["n", "unsure"])


def prefix_coverage(pieces: DataFrame) -> DataFrame:
    """(prefix, n, low, high) of recognized codes."""
    hit = pieces.where(F.coalesce("code", F.lit("")) != "").select(F.split_part("code", F.lit("-"), F.lit(1)).alias("prefix"), F.split_part("code", F.lit("-"), F.lit(2)).cast("int").alias("number"))
    return hit.groupBy("prefix").agg(F.count("*").alias("n"), F.min("number").alias("low"), F.max("number").alias("high"))


def conflict_detail(before: DataFrame, after: DataFrame) -> DataFrame:
    """(photo_id, piece_id, code, confidence, kept_piece, kept_confidence) of pieces that lost their code to another.

    ``before`` and ``after`` are results on both sides of resolve(); the code is the one lost.
    """
    lost = after.where("method = 'conflict'").select("photo_id", "piece_id").join(before.select("photo_id", "piece_id", "code", "confidence"), ["photo_id", "piece_id"])
    kept = after.where(F.coalesce("code", F.lit("")) != "").select("photo_id", "code", F.col("piece_id").alias("kept_piece"), F.col("confidence").alias("kept_confidence"))
    return lost.join(kept, ["photo_id", "code"], "left").select("photo_id", "piece_id", "code", "confidence", "kept_piece", "kept_confidence")


def tuning_advice(pieces: DataFrame) -> DataFrame:
    """(photo_id, total, conflicts, sweeps, advice, low_rate): what to look at first in each photo.

    In order: no pieces at all; conflicts, or sweeps, of two and a tenth of the pieces; else normal.
    """
    counts = pieces.groupBy("photo_id").agg(F.count("piece_id").alias("total"), F.count_if(F.col("method") == "conflict").alias("conflicts"), F.count_if(F.col("method") == "sweep").alias("sweeps"), F.count_if(F.coalesce("code", F.lit("")) != "").alias("hit"))
    many = F.greatest(F.lit(2.0), F.col("total") * 0.1)
    advice = F.when(F.col("total") == 0, "no_pieces").when(F.col("conflicts") >= many, "conflicts").when(F.col("sweeps") >= many, "sweeps").otherwise("normal")
    return counts.select("photo_id", "total", "conflicts", "sweeps", advice.alias("advice"), ((F.col("total") > 0) & (F.col("hit") < 0.7 * F.col("total"))).alias("low_rate"))


def benchmark_report(pieces: DataFrame, seconds: float, photo: str | None = None) -> DataFrame:
    """One row: the photo, totals, rate, given seconds and seconds a piece, methods and sorted codes as JSON.

    The report lists the codes of one photo's pieces, so they meet in one value; nothing else
    does. Without pieces the rates are 0.
    """
    total, hit = F.count("*"), F.count_if(F.coalesce("code", F.lit("")) != "")
    by_method = pieces.groupBy("method").agg(total.alias("n"), hit.alias("hit"), F.collect_list(F.nullif("code", F.lit(""))).alias("codes"))
    methods = F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "n"))))
    sums = by_method.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("hit"), F.lit(0)).alias("recognized"), methods.alias("methods"), F.array_sort(F.flatten(F.collect_list("codes"))).alias("codes"))
    share = lambda part, digits: F.round(F.coalesce(F.try_divide(part, F.col("total")), F.lit(0.0)), digits)
    row = sums.withColumns({"photo": F.lit(photo), "rate": share(F.col("recognized"), 4), "shown": percent(F.col("recognized"), F.col("total")), "seconds": F.round(F.lit(float(seconds)), 1), "seconds_per_piece": share(F.lit(float(seconds)), 3)})
    return row.select(F.to_json(F.struct("photo", "total", "recognized", "rate", "shown", "seconds", "seconds_per_piece", "methods", "codes")).alias("report"))
