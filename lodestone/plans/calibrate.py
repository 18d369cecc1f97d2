"""Pictures by which settings are judged: what each step of segmentation made of a photo."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..operators import kernels

#: Crops shown of a photo, the first ones by position: a sample to look at, nothing is computed from it.
CROPS = 12
#: Line colours (BGR) of blobs before and pieces after splitting.
BLOBS, SPLIT = (0, 255, 255), (255, 0, 255)


def overlay(image: np.ndarray, contours: list[np.ndarray], colour: tuple[int, int, int]) -> np.ndarray:
    """The image with the contours drawn on it, two pixels wide."""
    out = image.copy()
    for c in contours:
        out[kernels.outline(image.shape[:2], c, 2) > 0] = colour
    return out


def pictures(image: np.ndarray, settings: Settings = SETTINGS) -> Iterator[tuple[str, np.ndarray]]:
    """Names and pictures: 01_mask, 02_blobs, 03_split and crops/000 on, up to CROPS of them."""
    mask = kernels.build_mask(image, settings)
    yield "01_mask", np.repeat(mask[..., None], 3, 2)
    blobs = kernels.find_blobs(mask, settings)
    yield "02_blobs", overlay(image, blobs, BLOBS)
    found = kernels.split_blobs(image.shape[:2], blobs, settings)
    yield "03_split", overlay(image, found, SPLIT)
    for i, c in enumerate(found[:CROPS]):
        yield f"crops/{i:03d}", kernels.crop_piece(image, c, found[:i] + found[i + 1 :], settings)


def artefacts(images: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(photo_id, name, height, width, png): pictures() of every photo."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)
                rows = [(r.photo_id, name, *p.shape[:2], kernels.png(p)) for name, p in pictures(image, settings)]
                yield pd.DataFrame(rows, columns=["photo_id", "name", "height", "width", "png"])

    return images.select("photo_id", "height", "width", "data").mapInPandas(run, "photo_id string, name string, height int, width int, png binary")


def unrecognized(images: DataFrame, pieces: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(photo_id, name, height, width, png): 04_unrecognized, each photo with its pieces without a code lit.

    ``pieces`` has (photo_id, code, contour); a photo's contours meet in its row. A photo whose
    pieces all have codes, or that has none, is dim throughout.
    """
    left = pieces.where(F.coalesce("code", F.lit("")) == "").groupBy("photo_id").agg(F.collect_list("contour").alias("left"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)
                lit = [] if r.left is None else [np.stack(c) for c in r.left]
                shown = kernels.png(kernels.highlight(image, lit, True, settings))
                yield pd.DataFrame([(r.photo_id, "04_unrecognized", r.height, r.width, shown)], columns=["photo_id", "name", "height", "width", "png"])

    both = images.select("photo_id", "height", "width", "data").join(left, "photo_id", "left")
    return both.mapInPandas(run, "photo_id string, name string, height int, width int, png binary")
