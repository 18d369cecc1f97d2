"""Images in tiles against whole images in numpy; flooding and splitting of touching shapes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import kernels as K
from lodestone.operators import tiles as T

H, W = 26, 37


def disc(cy, cx, r, shape=(H, W)):
    y, x = np.mgrid[: shape[0], : shape[1]]
    return (y - cy) ** 2 + (x - cx) ** 2 <= r * r


@pytest.fixture(scope="module")
def images():
    some = np.random.default_rng(3)
    snake = np.zeros((H, W), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    return {
        "sparse": some.random((H, W)) < 0.4, "dense": some.random((H, W)) < 0.95, "none": np.zeros((H, W), bool), "all": np.ones((H, W), bool),
        "snake": snake, "discs": disc(12, 8, 6) | disc(12, 18, 6) | disc(12, 28, 6) | disc(23, 4, 2), None: disc(5, 5, 4) | disc(20, 30, 3),
    }


@pytest.fixture(scope="module", params=[2, 7, 64])
def cut(request, spark, images):
    rows = [(n, j, i, int(m[j, i]), "t") for n, m in images.items() for j in range(H) for i in range(W)]
    pixels = spark.createDataFrame(rows, "image string, y int, x int, v int, data string")
    return T.stored(T.cut(pixels, F.col("v"), side=request.param), "tiles"), request.param


def test_components_are_those_of_the_whole_image(cut, images):
    tiles, side = cut
    got = T.component_table(tiles, side).collect()
    for name, mask in images.items():
        count, labels = K.components(mask)
        want = set()
        for i in range(1, count + 1):
            y, x = np.nonzero(labels == i)
            want.add(((int(y[0]) << 32) + int(x[0]) + 1, len(y), 1, int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1))
        found = [tuple(r[c] for c in ("component", "n", "tag", "x", "y", "w", "h")) for r in got if r["image"] == name]
        assert set(found) == want and len(found) == count, name


def test_distances_are_those_of_the_whole_image(cut, images):
    tiles, side = cut
    got = {(r["image"], r["y"], r["x"]): r["v"] for r in T.pixels_of(T.distances(tiles, side), side=side).collect()}
    for name, mask in images.items():
        want = np.rint(K.depth(mask.astype(np.uint8)) * 10_000)
        assert np.array_equal([[got[name, j, i] for i in range(W)] for j in range(H)], want), name


def test_peaks(cut):
    tiles, side = cut
    if side > 2:
        got = {(r["image"], r["component"]): r["peaks"] for r in T.peaks(tiles.where("image = 'discs' OR image IS NULL"), side).collect()}
        first = lambda y, x: (y << 32) + x + 1
        assert got == {("discs", first(6, 8)): 3, ("discs", first(21, 4)): 1, (None, first(1, 5)): 1, (None, first(17, 30)): 1}


def test_pixels_far_apart_repeated_or_null(spark):
    rows = [("a", 0, 0, 5), ("a", 0, 0, None), ("a", 1, 1, 1), ("a", 2**30, 2**30, 3), ("a", 2**30, 2**30 + 1, 3), ("a", 9, 9, None), ("a", 3, 3, 0)]
    tiles = T.cut(spark.createDataFrame(rows, "image string, y int, x int, v int"), F.col("v"), side=2)
    got = {(r["component"], r["n"], r["tag"], r["w"], r["h"]) for r in T.component_table(tiles, 2).collect()}
    assert got == {(1, 2, 5, 2, 2), ((2**30 << 32) + 2**30 + 1, 2, 3, 2, 1)}
    shown = T.component_table(tiles, 2).select(T.spot_y(F.col("component")), T.spot_x(F.col("component"))).collect()
    assert {tuple(r) for r in shown} == {(0, 0), (2**30, 2**30)}
    assert T.component_table(tiles.limit(0), 2).count() == T.distances(tiles.limit(0), 2).count() == T.peaks(tiles.limit(0), 2).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, None)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100 + i, 100) for i in range(9)], [((i * 37) % 101, (i * 53) % 97) for i in range(70)]])
def test_union(spark, edges):
    near: dict = {}
    for a, b in edges:
        if b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def least(v):
        seen, todo = {v}, [v]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        return min(seen)

    got = {r["node"]: r["root"] for r in T.union(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: least(v) for v in near}


@pytest.mark.parametrize(("dy", "dx"), [(0, 20), (20, 0), (14, 14), (0, 21), (12, -17)])
def test_touching_discs_part_half_way(dy, dx):
    a, b = (40, 40), (40 + dy, 40 + dx)
    mask = disc(*a, 12, (90, 90)) | disc(*b, 12, (90, 90))
    deep = K.depth(mask.astype(np.uint8))
    _, cores = K.components(deep > 0.8 * deep.max())
    labels = K.flood(deep, cores, mask)
    assert np.array_equal(labels > 0, mask)
    y, x = np.nonzero(mask)
    away = np.hypot(y - a[0], x - a[1]) - np.hypot(y - b[0], x - b[1])
    sure = np.abs(away) > 2
    # Two pixels beyond the middle line a pixel is that of the nearer centre.
    assert ((labels[y, x][sure] == labels[a]) == (away[sure] < 0)).all()


def test_flooding_leaves_out_what_no_marker_reaches():
    mask = disc(10, 10, 5) | disc(10, 28, 5)
    markers = np.zeros((H, W), np.int32)
    markers[10, 10] = 4
    labels = K.flood(K.depth(mask.astype(np.uint8)), markers, mask)
    assert np.array_equal(labels, np.where(disc(10, 10, 5), 4, 0))
    assert not K.flood(np.zeros((3, 3)), np.zeros((3, 3), np.int32), np.ones((3, 3), bool)).any()


def knobbed(shape, y, x, size, knob):
    """A square piece with a knob on its right and below and notches on its left and above."""
    out = np.zeros(shape, bool)
    out[y : y + size, x : x + size] = True
    half = size // 2
    out |= disc(y + half, x + size + knob // 2, knob, shape) | disc(y + size + knob // 2, x + half, knob, shape)
    return out & ~disc(y + half, x, knob, shape) & ~disc(y, x + half, knob, shape)


def test_pieces_with_knobs_stay_whole():
    photo, boxes = np.full((260, 380, 3), 20, np.uint8), []
    for j in range(2):
        for i in range(3):
            one = knobbed((260, 380), 30 + 110 * j, 30 + 115 * i, 56 + 2 * i, 9)
            photo[one] = (235, 233, 228)
            ys, xs = np.nonzero(one)
            boxes.append((int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1))
    found = [K.contour_bbox(c) for c in K.extract_contours(photo)]
    assert len(found) == 6
    assert all(max(abs(p - q) for p, q in zip(a, b)) <= 2 for a, b in zip(sorted(found), sorted(boxes)))


def test_blobs_are_traced_within_their_boxes():
    mask = (np.random.default_rng(5).random((60, 80)) < 0.35).astype(np.uint8) * 255
    count, labels = K.components(mask)
    boxes = K.boxes_of(count, labels)
    for i in range(1, count + 1):
        y, x = np.nonzero(labels == i)
        assert boxes[i - 1] == (slice(y.min(), y.max() + 1), slice(x.min(), x.max() + 1))
    whole = [K.trace(labels == i) for i in range(1, count + 1)]
    middle = K.median_area(whole)
    want = [c.tolist() for c in whole if K.contour_area(c) >= K.SETTINGS.least_area * middle]
    assert [c.tolist() for c in K.find_blobs(mask)] == want
