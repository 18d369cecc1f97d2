"""The closed perspective map against a linear solve."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import geometry as G


def solved(quad, w, h):
    rows, right = [], []
    for (x, y), (u, v) in zip([(0, 0), (w, 0), (w, h), (0, h)], quad):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.linalg.solve(rows, right)


def test_quads(spark):
    some = np.random.default_rng(4)
    quads = [((np.array([[0, 0], [60, 0], [60, 40], [0, 40]]) + some.integers(-12, 13, (4, 2))).tolist(), int(w), int(h)) for w, h in some.integers(5, 90, (60, 2))]
    df = spark.createDataFrame(quads, "quad array<array<int>>, w int, h int").withColumn("by", G.homography(F.col("quad"), F.col("w"), F.col("h")))
    rows = df.select("quad", "w", "h", "by", *[G.mapped(F.col("by"), x, y).alias(n) for n, x, y in (("p0", F.lit(0), F.lit(0)), ("p1", F.col("w"), F.lit(0)), ("p2", F.col("w"), F.col("h")), ("p3", F.lit(0), F.col("h")))]).collect()
    for r in rows:
        assert np.allclose([r["by"][k] for k in "abcdefgh"], solved(r["quad"], r["w"], r["h"]), atol=1e-9)
        assert np.allclose([(r[f"p{i}"]["x"], r[f"p{i}"]["y"]) for i in range(4)], r["quad"], atol=1e-9)


def test_no_solution(spark):
    bad = [(None, 4, 4), ([], 4, 4), ([[0, 0], [1, 0], [1, 1]], 4, 4), ([[0, 0], [1, 1], [2, 2], [3, 3]], 4, 4), ([[0, 0], [4, 0], [4, 4], [0, 4]], 0, 4), ([[0, 0], [4, 0], [4, 4], [0, 4]], None, 4)]
    df = spark.createDataFrame(bad, "quad array<array<int>>, w int, h int")
    assert df.where(G.homography(F.col("quad"), F.col("w"), F.col("h")).isNotNull()).count() == 0
