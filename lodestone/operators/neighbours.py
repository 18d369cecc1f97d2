"""Boxes near one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions.geometry import crop_window, overlaps

#: Pixels to a side of a grid cell.
CELL = 256


def _cells(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The grid cells that a half-open window touches; none for an empty one."""
    along = lambda lo, hi: F.when(lo < hi, F.sequence(F.floor(lo / CELL), F.floor((hi - 1) / CELL)))
    return F.flatten(F.transform(along(x0, x1), lambda i: F.transform(along(y0, y1), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def in_windows(boxes: DataFrame, width: int, height: int, settings: Settings = SETTINGS) -> DataFrame:
    """(photo_id, piece_ord, neighbour) of pieces whose box reaches into another's crop window.

    ``boxes`` has (photo_id, piece_ord, x, y, w, h). Boxes and windows meet by grid cells of a
    photo, so that a photo of very many pieces is dealt over tasks and only what is near meets; a
    pair is kept in the one cell that holds the upper left corner of what the two share. Rows with
    a null in the box have no neighbours; neither has a box without width or height.
    """
    window = crop_window(*(F.col(c) for c in "xywh"), F.lit(width), F.lit(height), settings=settings)
    a = boxes.select("photo_id", "piece_ord", window.alias("c")).select("photo_id", "piece_ord", "c.x0", "c.y0", "c.x1", "c.y1")
    a = a.select("*", F.explode(_cells(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))).alias("cell"))
    b = boxes.select("photo_id", F.col("piece_ord").alias("neighbour"), "x", "y", "w", "h")
    b = b.select("*", F.explode(_cells(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))).alias("cell"))
    corner = F.struct(F.floor(F.greatest("x", "x0") / CELL).alias("i"), F.floor(F.greatest("y", "y0") / CELL).alias("j"))
    met = overlaps(*(F.col(c) for c in ("x", "y", "w", "h", "x0", "y0", "x1", "y1"))) & (F.col("cell") == corner)
    return a.join(b, ["photo_id", "cell"]).where(met & (F.col("piece_ord") != F.col("neighbour"))).select("photo_id", "piece_ord", "neighbour")
