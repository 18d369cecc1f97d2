"""Schemas of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

POINTS = T.ArrayType(T.ArrayType(T.IntegerType()))
PIECE = T.StructType(
    [
        T.StructField("piece_id", T.IntegerType()),
        T.StructField("contour", POINTS),
        T.StructField("bbox", T.ArrayType(T.IntegerType())),
        T.StructField("area", T.DoubleType()),
        T.StructField("code", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("raw_text", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("angle", T.IntegerType()),
    ]
)
PHOTO = T.StructType(
    [
        T.StructField("photo_id", T.StringType()),
        T.StructField("image_path", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("pieces", T.ArrayType(PIECE)),
    ]
)
DETECTION = T.StructType(
    [
        T.StructField("photo_id", T.StringType()),
        T.StructField("piece_id", T.LongType()),
        T.StructField("pass", T.StringType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("angle", T.IntegerType()),
        T.StructField("det_ord", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("poly", POINTS),
    ]
)
CODE = T.StructType([T.StructField("code", T.StringType()), T.StructField("photo_id", T.StringType()), T.StructField("piece_ord", T.LongType())])
