"""Running totals, boxes in windows, reports and calibration pictures against plain Python."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import kernels, lookup, order, report
from lodestone.operators.neighbours import in_windows
from lodestone.plans import calibrate, index


@pytest.mark.parametrize("kind", ["string", "double"])
def test_running_totals(spark, kind):
    keys = random.Random(3).sample(range(100_000), 3000)
    rows = [(str(k) if kind == "string" else k / 7, k % 50) for k in keys] + [(None, 9)]
    found = order.running(spark.createDataFrame(rows, f"k {kind}, v long").withColumn("_range", F.lit(1)), "k", F.col("v"), "upto")
    assert found.columns.count("_range") == 1
    total, expected = 0, {}
    for k, v in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        total += v
        expected[k] = total
    assert {r["k"]: r["upto"] for r in found.collect()} == expected


def test_running_totals_of_few_rows(spark):
    empty = spark.createDataFrame([], "k string, v long")
    assert order.running(empty, "k", F.lit(1), "n").collect() == []
    nulls = spark.createDataFrame([(None, 2)], "k string, v long")
    assert [r["n"] for r in order.running(nulls, "k", F.col("v"), "n").collect()] == [2]


def test_distribution_of_many_confidences(spark):
    values = [i / 4999 for i in random.Random(5).sample(range(5000), 3777)]
    pieces = spark.createDataFrame([("A-1", v) for v in values] + [(None, 0.0), ("", 0.5)], "code string, confidence double")
    r, s = report.confidence_distribution(pieces).first(), sorted(values)
    assert tuple(r) == (3777, s[0], s[3777 // 4], s[3777 // 2], s[-1], sum(v < 0.9 for v in s))
    assert tuple(report.confidence_distribution(pieces.where("code is null")).first()) == (0, None, None, None, None, 0)


def test_boxes_of_a_crowded_photo(spark):
    rng = random.Random(11)
    boxes = [("hot", i, rng.randrange(3900), rng.randrange(2900), rng.choice([1, 30, 255, 256, 700]), rng.choice([1, 40, 300])) for i in range(500)]
    boxes += [("other", 0, 10, 10, 50, 50), ("other", 1, 10, 10, 50, 50), ("other", 2, None, 1, 2, 3), ("flat", 0, 5, 5, 0, 4), ("flat", 1, 0, 0, 20, 20)]
    found = [tuple(r) for r in in_windows(spark.createDataFrame(boxes, "photo_id string, piece_ord long, x int, y int, w int, h int"), 4000, 3000).collect()]
    expected = set()
    for p, i, x, y, w, h in boxes:
        for q, j, x2, y2, w2, h2 in boxes:
            if p == q and i != j and None not in (x, x2) and w2 and h2:
                if x2 < min(4000, x + w + 6) and y2 < min(3000, y + h + 6) and x2 + w2 > max(0, x - 6) and y2 + h2 > max(0, y - 6):
                    expected.add((p, i, j))
    assert set(found) == expected and len(found) == len(expected)


def test_the_report_of_a_run(spark):
    kinds = "code string, method string"
    made = report.benchmark_report(spark.createDataFrame([("A-2", "direct"), ("A-10", "line"), (None, "none"), ("", "none")], kinds), 3.456, "desk").first()[0]
    assert json.loads(made) == {"photo": "desk", "total": 4, "recognized": 2, "rate": 0.5, "shown": "50.0%", "seconds": 3.5, "seconds_per_piece": 0.864, "methods": {"direct": 1, "line": 1, "none": 2}, "codes": ["A-10", "A-2"]}
    nothing = json.loads(report.benchmark_report(spark.createDataFrame([], kinds), 1).first()[0])
    assert (nothing["total"], nothing["rate"], nothing["seconds_per_piece"], nothing["codes"]) == (0, 0.0, 0.0, [])


def test_totals_and_first_by_position(spark):
    pieces = spark.createDataFrame([("a", 3, "A-1", 1), ("a", 2, "A-1", 2), ("b", 0, "a-1", 3), ("b", 1, None, 4)], "photo_id string, piece_ord long, code string, extra int")
    assert [tuple(r) for r in lookup.first_by_position(pieces, " a-1 ").collect()] == [("a", 2, "A-1", 2)]
    assert tuple(lookup.library_totals(lookup.photo_stats(pieces.select("photo_id").distinct(), pieces)).first()) == (2, 4, 3, 1, 0.75)
    none = pieces.where("1 = 0")
    assert tuple(lookup.library_totals(lookup.photo_stats(none.select("photo_id"), none)).first()) == (0, 0, 0, 0, None)


def crowd() -> np.ndarray:
    """Fifteen discs with less than a margin between them."""
    image = np.full((150, 240, 3), 20, np.uint8)
    y, x = np.mgrid[:150, :240]
    for k in range(15):
        image[(x - 24 - 44 * (k % 5)) ** 2 + (y - 26 - 46 * (k // 5)) ** 2 <= 20**2] = 230
    return image


def test_crops_are_those_with_all_neighbours_given(spark):
    image = crowd()
    table = spark.createDataFrame([("p", *image.shape[:2], bytearray(image.tobytes()))], "photo_id string, height int, width int, data binary")
    found = kernels.extract_contours(image)
    assert len(found) == 15
    for r in index.segment(table).collect():
        i = r["piece_id"]
        assert bytes(r["data"]) == kernels.crop_piece(image, found[i], found[:i] + found[i + 1 :]).tobytes()


def test_calibration_pictures(spark):
    image = crowd()
    table = spark.createDataFrame([("p", *image.shape[:2], bytearray(image.tobytes())), ("all", *image.shape[:2], bytearray(image.tobytes()))], "photo_id string, height int, width int, data binary")
    shown = {r["name"]: r for r in calibrate.artefacts(table).where("photo_id = 'p'").collect()}
    assert sorted(shown) == ["01_mask", "02_blobs", "03_split", *(f"crops/{i:03d}" for i in range(12))]
    drawn = dict(calibrate.pictures(image))
    assert {tuple(c) for c in drawn["02_blobs"].reshape(-1, 3)} > {calibrate.BLOBS} and not (drawn["03_split"] == calibrate.BLOBS).all(-1).any()
    assert all(bytes(shown[n]["png"]) == kernels.png(p) for n, p in drawn.items())
    contours = kernels.extract_contours(image)
    pieces = spark.createDataFrame([("p", None, contours[0].tolist()), ("p", "A-1", contours[1].tolist()), ("all", "A-1", contours[0].tolist())], "photo_id string, code string, contour array<array<int>>")
    lit = {r["photo_id"]: bytes(r["png"]) for r in calibrate.unrecognized(table, pieces).collect()}
    assert lit == {"p": kernels.png(kernels.highlight(image, [contours[0]], True)), "all": kernels.png(kernels.highlight(image, [], True))}


def test_resizing_keeps_flat_colours_and_means():
    flat = np.full((7, 11, 3), (10, 100, 200), np.uint8)
    assert (kernels.resize(flat, 30, 20) == (10, 100, 200)).all() and kernels.resize(flat, 3, 2).shape == (2, 3, 3)
    checks = np.kron(np.array([[0, 200], [100, 50]], np.uint8), np.ones((4, 4), np.uint8))[..., None].repeat(3, 2)
    assert kernels.resize(checks, 2, 2)[..., 0].tolist() == [[0, 200], [100, 50]]
