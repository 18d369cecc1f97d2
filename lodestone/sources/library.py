"""The library of photos and their pieces: JSON files in and out, photos with pieces nested or flat, rows replaced by photo."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.order import running
from ..schema import PHOTO
from .store import exists


def scan_json(spark: SparkSession, path: str) -> DataFrame:
    """Each JSON file of a folder as a row, with ``file`` and ``bad``: whether it is broken or lacks what a photo must have.

    Photo fields and each piece's id, contour, box and area must be there. Confidence, method and
    pieces may be absent, and become 0, ``none`` and empty; code, raw text and angle become null.
    A folder that does not exist has no rows.
    """
    schema = T.StructType([*PHOTO.fields, T.StructField("_bad", T.StringType())])
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([*PHOTO.fields, T.StructField("file", T.StringType()), T.StructField("bad", T.BooleanType())]))
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.json").json(path)
    named = read.withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1))
    needed = [F.col(c).isNotNull() for c in ("photo_id", "image_path", "width", "height", "created_at")]
    whole = F.forall(F.coalesce("pieces", F.array().cast(PHOTO["pieces"].dataType)), lambda p: p["piece_id"].isNotNull() & p["contour"].isNotNull() & p["bbox"].isNotNull() & p["area"].isNotNull())
    ok = F.col("_bad").isNull() & whole
    for c in needed:
        ok = ok & c
    fixed = F.transform(F.coalesce("pieces", F.array().cast(PHOTO["pieces"].dataType)), lambda p: p.withField("confidence", F.coalesce(p["confidence"], F.lit(0.0))).withField("method", F.coalesce(p["method"], F.lit("none"))))
    return named.select(*[c for c in PHOTO.names if c != "pieces"], fixed.alias("pieces"), "file", (~ok).alias("bad"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """Good photos in order of their files, with ``photo_ord``. Of two files with one photo_id the later one's content counts, at the first one's place."""
    good = scan_json(spark, path).where("NOT bad")
    by_id = W.partitionBy("photo_id")
    kept = good.withColumns({"place": F.min("file").over(by_id), "last": F.max("file").over(by_id)}).where("file = last")
    ranked = running(kept.select("photo_id", "place"), "place", F.lit(1), "photo_ord").drop("place")
    return kept.drop("file", "bad", "place", "last").join(ranked, "photo_id")


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """Names of the files that load() leaves out."""
    return scan_json(spark, path).where("bad").select("file")


def flat(photos: DataFrame, *more: str) -> DataFrame:
    """A row for each piece, with its place and its box in columns, and ``more`` columns of its photo."""
    rows = photos.select("photo_id", *more, F.posexplode("pieces").alias("piece_ord", "p"))
    box = [F.get("p.bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")]
    return rows.select("photo_id", F.col("piece_ord").cast("long").alias("piece_ord"), "p.piece_id", *box, "p.area", "p.code", "p.confidence", "p.raw_text", "p.method", "p.angle", "p.contour", *more)


def nested(photos: DataFrame, pieces: DataFrame) -> DataFrame:
    """The inverse of flat(): ``photos`` (without pieces) with their pieces in order; photos without any have none."""
    piece = F.struct("piece_id", "contour", F.array("x", "y", "w", "h").alias("bbox"), "area", "code", "confidence", "raw_text", "method", "angle")
    rows = pieces.groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct("piece_ord", piece.alias("p"))))["p"].alias("pieces"))
    return photos.join(rows, "photo_id", "left").withColumn("pieces", F.coalesce("pieces", F.array().cast(PHOTO["pieces"].dataType)))


def to_json(photos: DataFrame) -> DataFrame:
    """(photo_id, json): each photo as the text of its file; null fields are written."""
    return photos.select("photo_id", F.to_json(F.struct(*PHOTO.names), {"ignoreNullFields": "false"}).alias("json"))


def from_json(texts: DataFrame) -> DataFrame:
    """The inverse of to_json()."""
    return texts.select(F.from_json("json", PHOTO).alias("r")).select("r.*")


def export_json(photos: DataFrame, path: str) -> None:
    """A JSON file for each photo, as scan_json() reads them; null fields are written."""
    photos.select(*PHOTO.names).write.option("maxRecordsPerFile", 1).option("ignoreNullFields", "false").json(path)


def upsert(old: DataFrame, new: DataFrame, key: str = "photo_id") -> DataFrame:
    """Rows of ``new``, and those of ``old`` with none of its keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def without(old: DataFrame, ids: DataFrame, key: str = "photo_id") -> DataFrame:
    """Rows of ``old`` whose key is not among ``ids``."""
    return old.join(ids.select(key).distinct(), key, "left_anti").select(*old.columns)
