"""Photos as tables of pixels in BGR bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stem


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(photo_id, image_path, height, width, data) of the readable images of a file or folder; a path that is not there fails."""
    found = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return found.where("nChannels = 3").select(stem(F.col("origin")).alias("photo_id"), F.col("origin").alias("image_path"), "height", "width", "data")


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the files that are no images."""
    return spark.read.format("image").load(path).select("image.*").where("height < 0").select(F.col("origin").alias("image_path"))
