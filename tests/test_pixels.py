"""Neighbourhoods of pixels in tables against whole images in numpy, across the squares in which they are looked at."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestone import adapters, queries
from lodestone.operators import kernels as K
from lodestone.operators import pixels as P

H, W = 150, 201


def table(spark, images):
    rows = [(n, j, i, int(m[j, i])) for n, m in images.items() for j in range(m.shape[0]) for i in range(m.shape[1])]
    return spark.createDataFrame(rows, "image string, y int, x int, v int")


def grids(df):
    found: dict = {}
    for r in df.collect():
        assert (r["y"], r["x"]) not in found.setdefault(r["image"], {})
        found[r["image"]][r["y"], r["x"]] = r["v"]
    return found


def test_blur_and_morphology_across_squares(spark):
    some = np.random.default_rng(5)
    images = {"a": some.integers(0, 256, (H, W)).astype(np.uint8), None: some.integers(0, 256, (3, 4)).astype(np.uint8)}
    pixels = table(spark, {"a": images["a"]})
    blurred, rows = grids(P.blur(pixels, H, W)), K.blur(images["a"])
    assert blurred["a"] == {(j, i): rows[j, i] for j in range(H) for i in range(W)}
    for ours, theirs in ((P.erode, K.erode), (P.dilate, K.dilate), (P.open_close, lambda m: K.erode(K.dilate(K.dilate(K.erode(m)))))):
        got = grids(ours(table(spark, images)))
        for n, m in images.items():
            want = theirs(m)
            assert got[n] == {(j, i): want[j, i] for j in range(m.shape[0]) for i in range(m.shape[1])}, n


def test_missing_null_and_repeated_pixels(spark):
    rows = [(1, 0, 0, 7), (1, 0, 0, 5), (1, 0, 1, None), (1, 9, 9, None), (1, 0, 2, 9), (1, -70, 5, 3), (1, -70, 6, 4)]
    got = grids(P.erode(spark.createDataFrame(rows, "image long, y long, x long, v int").orderBy("v")))[1]
    assert got == {(0, 0): 5, (0, 1): 5, (0, 2): 5, (9, 9): None, (-70, 5): 3, (-70, 6): 3}
    assert P.open_close(spark.createDataFrame([], "image long, y int, x int, v int")).count() == 0


def test_pixels_are_neither_broadcast_nor_multiplied(spark):
    """Sizes of tables of exploded pixels are guessed far too low, so that a join with them was broadcast."""
    plan = queries.gaussian_blur(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange") == 1
    plan = P.open_close(adapters.pixels(spark, "/root/testdata/sf0.001").withColumn("v", F.col("v") * 1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
