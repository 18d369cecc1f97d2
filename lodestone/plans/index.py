"""From photos to the index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..operators import kernels
from ..operators.recognize import Recognizer, cascade, finder
from ..operators.resolve import resolve
from ..operators.vocabulary import snap
from ..schema import DETECTION
from ..sources.library import nested
from ..sources.scratch import stored

PARTS = "photo_id string, piece_id long, x int, y int, w int, h int, area double, contour array<array<int>>, height int, width int, data binary"


#: Finds of a piece, as DETECTION has them.
FINDS = "array<struct<pass: string, seq: int, angle: int, det_ord: int, text: string, score: double, poly: array<array<int>>>>"
READ = PARTS.replace("height int, width int, data binary", f"finds {FINDS}")


def _pieces(image: np.ndarray, settings: Settings) -> Iterator[tuple[tuple, np.ndarray]]:
    """(piece_id, box, area, contour) of each piece found, with its crop, neighbours painted over; one crop is in memory at a time."""
    found = kernels.extract_contours(image, settings)
    boxes = np.array([kernels.contour_bbox(c) for c in found]).reshape(-1, 4)
    for i, c in enumerate(found):
        x, y, w, h = boxes[i]
        gap = np.abs(2 * (boxes[:, :2] - [x, y]) + boxes[:, 2:] - [w, h]) - boxes[:, 2:] - [w, h]
        near = [found[j] for j in np.flatnonzero((gap < 2 * settings.pad).all(1)) if j != i]
        yield (i, *kernels.contour_bbox(c), kernels.contour_area(c), c.tolist()), kernels.crop_piece(image, c, near, settings)


def segment(images: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """A row for each piece found: its box, area, contour, and its crop with neighbours painted over. Crops of one photo are handed on together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)
                rows = [(r.photo_id, *part, *crop.shape[:2], crop.tobytes()) for part, crop in _pieces(image, settings)]
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in PARTS.split(", ")])

    return images.select("photo_id", "height", "width", "data").mapInPandas(run, PARTS)


def segment_and_read(images: DataFrame, factory: Callable[[], Recognizer], settings: Settings = SETTINGS) -> DataFrame:
    """A row for each piece found: its box, area, contour and ``finds``, what the passes that it needs read of it. Crops never leave the task that cuts them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finds = finder(factory, settings)
        names = [f.name for f in DETECTION][2:]
        for batch in batches:
            for r in batch.itertuples():
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)
                rows = [(r.photo_id, *part, [dict(zip(names, f, strict=True)) for f in finds(crop)]) for part, crop in _pieces(image, settings)]
                yield pd.DataFrame(rows, columns=["photo_id", "piece_id", "x", "y", "w", "h", "area", "contour", "finds"])

    return images.select("photo_id", "height", "width", "data").mapInPandas(run, READ)


def build_index(images: DataFrame, factory: Callable[[], Recognizer], created_at: str, settings: Settings = SETTINGS) -> DataFrame:
    """Photos with their pieces: segmented, read in passes, matched to codes, unique within the photo.

    ``factory`` makes the recognizer in each worker; ``created_at`` is the time to record. Pieces
    and their finds are stored, so that no image is segmented or read twice; crops are not.
    """
    parts = stored(segment_and_read(images, factory, settings), "parts")
    found = parts.select("photo_id", "piece_id", F.explode("finds").alias("d")).select("photo_id", "piece_id", "d.*")
    named = snap(found.withColumnRenamed("text", "raw_text"), "raw_text", settings=settings)
    results = cascade(parts, named, settings).withColumn("piece_ord", F.col("piece_id"))
    unique = resolve(results)
    # Contours are many times the size of their files, by which Spark would broadcast them through the driver.
    pieces = parts.drop("finds").join(unique.hint("merge"), ["photo_id", "piece_id"]).withColumn("piece_id", F.col("piece_id").cast("int"))
    photos = images.select("photo_id", "image_path", "width", "height", F.lit(created_at).alias("created_at"))
    return nested(photos, pieces)
