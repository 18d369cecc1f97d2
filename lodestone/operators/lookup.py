"""Looking codes up in the index, and counts over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize


def recognized(pieces: DataFrame) -> DataFrame:
    """Pieces with a code; empty codes are none."""
    return pieces.where(F.coalesce("code", F.lit("")) != "")


def unrecognized(pieces: DataFrame) -> DataFrame:
    """Pieces without a code."""
    return pieces.where(F.coalesce("code", F.lit("")) == "")


def photo_order(photo_id: Column) -> Column:
    """Photos are ordered by their file names."""
    return F.concat(photo_id, F.lit(".json"))


def hits(queries: DataFrame, pieces: DataFrame, query_col: str = "query") -> DataFrame:
    """(query, code, photo_id, piece_id and further columns of the piece) for queries that find something.

    Queries are normalised as recognized text is, but never matched to similar codes. The first
    piece by photo and place is found; the first of each code is picked before the join.
    """
    asked = queries.select(F.col(query_col).alias("query"), normalize(F.col(query_col)).alias("code"))
    payload = [c for c in pieces.columns if c != "code"]
    first = recognized(pieces).groupBy("code").agg(F.min_by(F.struct(*payload), F.struct(photo_order(F.col("photo_id")), "piece_ord")).alias("p"))
    return asked.join(first, "code").select("query", "code", "p.*")


def missed(queries: DataFrame, pieces: DataFrame, query_col: str = "query") -> DataFrame:
    """(query, code) for queries that find nothing, once each time they are asked."""
    asked = queries.select(F.col(query_col).alias("query"), normalize(F.col(query_col)).alias("code"))
    return asked.join(recognized(pieces).select("code").distinct(), "code", "left_anti").select("query", "code")


def misses(queries: DataFrame, pieces: DataFrame, query_col: str = "query") -> DataFrame:
    """(query, code, photo_id, n, piece_ids) for queries that find nothing: where unrecognized pieces are left.

    ``piece_ids`` joins a photo's unrecognized pieces in order, photos without such being left
    out. Each query without a hit meets each photo, as the answer asks, so this is for few
    queries; for many, take missed() and left_over(), whose answer is the same for all of them.
    """
    return missed(queries, pieces, query_col).join(left_over(pieces), how="cross").select("query", "code", "photo_id", "n", "piece_ids")


def left_over(pieces: DataFrame) -> DataFrame:
    """(photo_id, n, piece_ids) of photos with unrecognized pieces."""
    return unrecognized(pieces).groupBy("photo_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.struct("piece_ord", "piece_id")))["piece_id"], ",").alias("piece_ids"))


def photo_stats(photos: DataFrame, pieces: DataFrame) -> DataFrame:
    """(photo_id, total, recognized, unrecognized, rate) for every photo, those without pieces included."""
    counts = pieces.groupBy("photo_id").agg(F.count("*").alias("total"), F.count_if(F.coalesce("code", F.lit("")) != "").alias("recognized"))
    out = photos.select("photo_id").join(counts, "photo_id", "left").na.fill(0, ["total", "recognized"])
    return out.select("photo_id", "total", "recognized", (F.col("total") - F.col("recognized")).alias("unrecognized"), F.when(F.col("total") > 0, F.round(F.col("recognized") / F.col("total"), 4)).alias("rate"))


def method_counts(pieces: DataFrame) -> DataFrame:
    """(method, n)."""
    return pieces.groupBy("method").agg(F.count("*").alias("n"))


def library_totals(stats: DataFrame) -> DataFrame:
    """One row (photos, total, recognized, unrecognized, rate) over photo_stats(); zeros and a null rate for none."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "recognized", "unrecognized")]
    rate = F.when(F.col("total") > 0, F.round(F.col("recognized") / F.col("total"), 4))
    return stats.agg(F.count("*").alias("photos"), *sums).withColumn("rate", rate)


def first_by_position(pieces: DataFrame, code: str) -> DataFrame:
    """Each photo's first piece of a code as given, trimmed and in upper case: its columns as they are."""
    found = pieces.where(F.col("code") == F.lit(code.strip().upper()))
    return found.groupBy("photo_id").agg(F.min_by(F.struct(*found.columns), "piece_ord").alias("p")).select("p.*")
