"""Pixel operators on drawn images."""

from __future__ import annotations

import io

import numpy as np
import pytest

from lodestone.operators import kernels as K

BRIGHT = (235, 233, 228)


def canvas(h=240, w=320):
    rng = np.random.default_rng(42)
    return (18 + rng.integers(0, 12, (h, w, 3))).astype(np.uint8)


def disc(image, x, y, r):
    yy, xx = np.mgrid[: image.shape[0], : image.shape[1]]
    image[(xx - x) ** 2 + (yy - y) ** 2 <= r * r] = BRIGHT
    return image


def test_separate_discs():
    image = canvas()
    for x in (60, 160, 260):
        for y in (60, 180):
            disc(image, x, y, 30)
    found = K.extract_contours(image)
    assert len(found) == 6
    assert all(abs(K.contour_area(c) - np.pi * 900) < 150 for c in found)


def test_touching_discs_are_split():
    image = canvas()
    for x, y in ((50, 50), (150, 50), (250, 50)):
        disc(image, x, y, 25)
    for x in (100, 142, 184):
        disc(image, x, 170, 25)
    assert len(K.find_blobs(K.build_mask(image))) == 4
    assert len(K.extract_contours(image)) == 6


def test_a_lone_touching_pair_is_two():
    image = disc(disc(canvas(), 110, 120, 40), 172, 120, 40)
    assert len(K.extract_contours(image)) == 2


def test_specks_and_empty_images():
    image = disc(disc(disc(disc(canvas(), 60, 60, 28), 160, 60, 28), 250, 150, 28), 30, 200, 4)
    assert len(K.extract_contours(image)) == 3
    assert K.extract_contours(np.zeros((60, 60, 3), np.uint8)) == []


def test_edges_and_boxes():
    image = disc(np.zeros((80, 80, 3), np.uint8), 3, 3, 25)
    (only,) = K.extract_contours(image)
    assert K.crop_piece(image, only).size
    square = np.zeros((20, 20), np.uint8)
    square[5:15, 4:12] = 255
    c = K.trace(square)
    assert K.contour_bbox(c) == (4, 5, 8, 10) and K.contour_area(c) == 7 * 9 and len(c) == 4


@pytest.mark.parametrize("seed", range(5))
def test_components_against_flooding(seed):
    mask = (np.random.default_rng(seed).random((25, 31)) < 0.4).astype(np.uint8)
    n, labels = K.components(mask)
    left, count = mask.copy(), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if left[y, x]:
            count += 1
            stack, own = [(y, x)], labels[y, x]
            while stack:
                j, i = stack.pop()
                if 0 <= j < 25 and 0 <= i < 31 and left[j, i]:
                    left[j, i] = 0
                    assert labels[j, i] == own
                    stack += [(j + a, i + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    assert n == count


def test_depth_is_near_the_true_distance():
    mask = np.zeros((41, 41), np.uint8)
    mask[1:-1, 1:-1] = 255
    assert abs(K.depth(mask)[20, 20] - 20) < 0.5


def test_crop_paints_neighbours_only():
    image = disc(disc(canvas(), 100, 100, 30), 165, 100, 30)
    a, b = K.extract_contours(image)
    crop = K.crop_piece(image, a, [b])
    assert max(crop.shape[:2]) == 512
    assert (K.crop_piece(image, a, [a]) == K.crop_piece(image, a)).all()
    before = image.copy()
    K.highlight(image, [a])
    assert (image == before).all()


def test_rotation_and_deskew():
    image = canvas(40, 100)
    assert K.rotate_expand(image, 360) is image
    turned = K.rotate_expand(image, 90)
    assert turned.shape[:2] == (100, 40)
    assert K.rotate_expand(image, 45)[0, 0].tolist() == [128, 128, 128]
    assert K.deskew(image, [[10, 10], [90, 10], [90, 35], [10, 35]]).shape[:2] == (25, 80)
    assert K.deskew(image, [[10, 5], [20, 5], [20, 35], [10, 35]]).shape[:2] == (10, 30)


def test_highlight_and_png():
    image = np.full((60, 80, 3), 255, np.uint8)
    lit = K.highlight(image, [np.array([[20, 20], [50, 20], [50, 40], [20, 40]])])
    assert lit[30, 35].tolist() == [255, 255, 255] and 60 < lit[5, 5, 0] < 255 and lit[20, 30].tolist() == [255, 0, 255]
    assert (K.highlight(image, []) < 255).all()
    assert K.png(lit).startswith(b"\x89PNG") and K.thumbnail(image, np.array([[20, 20], [50, 20], [50, 40]])).shape[1] == 200
    with pytest.raises(ValueError):
        K.png(image[:0])
    io.BytesIO(K.png(lit))
