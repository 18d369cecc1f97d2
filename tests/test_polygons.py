"""Polygons, highlights, resampling and crops of pixel tables against the kernels of whole images."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.config import SETTINGS
from lodestone.operators import kernels, pixels, polygons

SHAPES = {
    "square": [[3, 2], [12, 2], [12, 9], [3, 9]],
    "bow": [[2, 2], [14, 11], [14, 2], [2, 11]],
    "notched": [[1, 1], [18, 3], [9, 7], [17, 13], [2, 12], [7, 6]],
    "beyond": [[-4, -3], [6, -5], [25, 9], [4, 19]],
    "line": [[3, 3], [15, 8]],
    "point": [[5, 5]],
}
SIZE = (15, 20)


def grid(spark, pictures):
    """(image, y, x, b, g, r) of {name: pixels}."""
    rows = [(n, y, x, *map(int, p[y, x])) for n, p in pictures.items() for y in range(p.shape[0]) for x in range(p.shape[1])]
    return spark.createDataFrame(rows, "image string, y int, x int, b int, g int, r int")


def whole(rows, shape, channels="bgr"):
    out = np.full((*shape, len(channels)), -1, int)
    for r in rows:
        out[r["y"], r["x"]] = [r[c] for c in channels]
    return out


def noise(seed, shape):
    return np.random.default_rng(seed).integers(0, 256, (*shape, 3)).astype(np.uint8)


def test_runs_are_the_filled_shapes(spark):
    more = {f"some{i}": np.random.default_rng(i).integers(-3, 24, (3 + i % 6, 2)).tolist() for i in range(12)}
    shapes = SHAPES | more
    df = spark.createDataFrame([*shapes.items(), ("none", None), ("empty", []), ("broken", [[1, None], [None, 4]])], "k string, contour array<array<int>>")
    runs, bands = polygons.covered(df, "k").collect(), polygons.merged(polygons.bordering(df, F.lit(3), "k"), "k").collect()
    for found, of in ((runs, lambda c: kernels.fill(SIZE, c)), (bands, lambda c: kernels.outline(SIZE, c, 3))):
        masks = {k: np.zeros(SIZE, int) for k in shapes}
        for r in found:
            if 0 <= r["y"] < SIZE[0]:
                masks[r["k"]][r["y"], max(0, r["x0"]) : max(0, r["x1"] + 1)] += 1
        assert all(np.array_equal(masks[k], of(np.array(c, np.int32)) > 0) for k, c in shapes.items())


def test_highlight_pixel_by_pixel(spark):
    asked = {"one": ["notched"], "two": ["square", "bow"], "none": [], "edge": ["beyond"], "hint": ["line", "point"]}
    pictures = {n: noise(i, SIZE) for i, n in enumerate(asked)}
    rows = [(n, i, SHAPES[s], 2, n == "hint") for n, names in asked.items() for i, s in enumerate(names)]
    targets = spark.createDataFrame([*rows, ("one", 7, None, 2, None)], "image string, piece_id int, contour array<array<int>>, thickness int, unknown boolean")
    table = grid(spark, pictures).withColumns({"note": F.lit("kept"), "runs": F.lit(1)})
    lit = polygons.highlighted(table, targets)
    assert lit.columns == table.columns and lit.count() == table.count()
    for n, names in asked.items():
        got = whole(lit.where(F.col("image") == n).collect(), SIZE)
        assert np.array_equal(got, kernels.highlight(pictures[n], [np.array(SHAPES[s], np.int32) for s in names], n == "hint")), n
    assert polygons.highlighted(table.limit(0), targets).count() == 0
    # Pictures without a name are one picture, whose targets have none either.
    unnamed = polygons.highlighted(table.where("image = 'one'").withColumn("image", F.lit(None).cast("string")), targets.where("image = 'one'").withColumn("image", F.lit(None).cast("string")))
    assert np.array_equal(whole(unnamed.collect(), SIZE), kernels.highlight(pictures["one"], [np.array(SHAPES["notched"], np.int32)]))


@pytest.mark.parametrize("size", [(15, 20), (4, 7), (31, 33), (40, 9), (1, 1), (15, 60), (2, 20)])
def test_resampling(spark, size):
    picture = noise(3, SIZE)
    sized = grid(spark, {"a": picture}).withColumns({"height": F.lit(SIZE[0]), "width": F.lit(SIZE[1]), "to_height": F.lit(size[0]), "to_width": F.lit(size[1])})
    made = whole(pixels.resampled(sized, ("image",), ("b", "g", "r")).collect(), size)
    known = kernels.resize(picture, size[1], size[0]).astype(int)
    # The kernel adds up rounded products: it may round what is all but a half the other way.
    assert abs(made - known).max() <= 1 and (made != known).mean() < 0.02


def test_flat_pictures_stay_flat_and_bad_sizes_give_nothing(spark):
    flat = np.full((*SIZE, 3), 201, np.uint8)
    table = grid(spark, {"a": flat}).withColumns({"height": F.lit(SIZE[0]), "width": F.lit(SIZE[1])})
    for h, w in ((7, 9), (33, 47)):
        made = pixels.resampled(table.withColumns({"to_height": F.lit(h), "to_width": F.lit(w)}), ("image",), ("b", "g", "r")).collect()
        assert len(made) == h * w and {tuple(r[c] for c in "bgr") for r in made} == {(201, 201, 201)}
    for h in (0, None):
        assert pixels.resampled(table.withColumns({"to_height": F.lit(h).cast("int"), "to_width": F.lit(4)}), ("image",), ("b", "g", "r")).count() == 0


def test_crops(spark):
    shape = (40, 50)
    picture = noise(8, shape)
    contours = [[[12, 10], [24, 11], [22, 22], [11, 20]], [[24, 9], [40, 12], [38, 25], [27, 20]], [[20, 14], [30, 14], [30, 18], [20, 18]], [[2, 30], [9, 30], [9, 38], [2, 38]]]
    rows = [("a", i, c, *shape) for i, c in enumerate(contours)]
    pieces = spark.createDataFrame([*rows, ("a", 9, [], *shape), ("a", 10, None, *shape)], "image string, piece_id int, contour array<array<int>>, height int, width int")
    made = polygons.crops(grid(spark, {"a": picture}), pieces, edge=30, channels=("b", "g", "r"))
    assert {r["piece_id"] for r in made.select("piece_id").distinct().collect()} == {0, 1, 2, 3}
    for i, c in enumerate(contours):
        others = [np.array(o, np.int32) for j, o in enumerate(contours) if j != i]
        known = kernels.crop_piece(picture, np.array(c, np.int32), others, SETTINGS, 30).astype(int)
        got = whole(made.where(F.col("piece_id") == i).collect(), known.shape[:2])
        assert abs(got - known).max() <= 1 and (got != known).mean() < 0.02
