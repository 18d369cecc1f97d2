"""What keeps tasks, shuffles and memory small on larger tables."""

from __future__ import annotations

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from lodestone import adapters, queries
from lodestone.operators import kernels as K
from lodestone.operators import tiles
from lodestone.operators.recognize import payload
from lodestone.plans import calibrate, index


def test_photos_are_dealt_by_their_number(spark):
    assert adapters.dealt(spark.range(1000), adapters.PHOTOS).rdd.getNumPartitions() == 32
    assert queries.segment_photos(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 8


def test_crops_are_not_stored(spark, tmp_path):
    """A photo's crops are several times its size, and readers of stored tables take thousands of rows at once."""
    made = index.segment_and_read(adapters.coded_photos(spark, "/root/testdata/sf0.001"), adapters.DrawnCodes)
    assert "data" not in made.columns and "finds" in made.columns
    row = made.where("piece_id = 0").first()
    assert row["finds"][0]["pass"] == "direct" and row["finds"][0]["seq"] == 0


def test_blobs_are_found_once(monkeypatch):
    image = np.full((60, 60, 3), 20, np.uint8)
    image[20:40, 20:40] = 230
    calls = []
    whole = K.build_mask
    monkeypatch.setattr(K, "build_mask", lambda *a: calls.append(1) or whole(*a))
    assert len(list(calibrate.pictures(image))) == 4 and len(calls) == 1


def test_payloads_are_parsed_once_a_row(spark):
    """Within the loop over finds the JSON was parsed anew for each, so that long lists took the square of their length."""
    made = payload(spark.createDataFrame([('{"rec_texts": ["a", 5, "b"], "rec_scores": [0.5, 1, 0.25, 3], "dt_polys": [[[1.9, 2]]]}',), ('{"res": {"rec_texts": [], "rec_scores": []}}',)], "payload string"))
    assert [tuple(r)[1:] for r in made.collect()] == [(0, "a", 0.5, [[1, 2]]), (2, "b", 0.25, None)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Generate")[1].split("\n")[0].count("from_json") == 1


def test_detections_stay_where_they_are_until_joined_by_piece(spark):
    """Matched texts are few and broadcast; detections, sixteen a piece, are not shuffled by their texts, of which some are much more frequent than others."""
    plan = queries.cascade(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_raw" not in plan and "BroadcastHashJoin [_raw" in plan


def test_images_of_tiles_are_dealt_before_they_are_drawn(spark):
    plan = queries.touching(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(image" in plan and "REPARTITION_BY_NUM" in plan.split("Generate")[-1]


def test_a_task_of_pixels_holds_few_grids_however_many_there_are(spark, monkeypatch):
    """Through the passes too: pixels stay in the partition in which their image was dealt, so that its sorts have a bound."""
    monkeypatch.setattr(adapters, "GRIDS", 8)
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    made = queries.morph_open_close(spark, "/root/testdata/sf0.001")
    sizes = made.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("image").alias("grids")).collect()
    assert made.rdd.getNumPartitions() == max(8, -(-n // 8)) > 8
    assert sum(r["grids"] for r in sizes) == n and max(r["grids"] for r in sizes) <= 32


def test_pixels_stay_where_they_are_when_thresholds_are_too_many_to_broadcast(spark, monkeypatch):
    """Larger tables join by sorting. That needs no other dealing than by image, so a task's sorts are of as few grids."""
    monkeypatch.setattr(adapters, "GRIDS", 8, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = queries.morph_open_close(spark, "/root/testdata/sf0.001")
        plan = made._jdf.queryExecution().executedPlan().toString()
        sizes = made.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("image").alias("grids"), F.count("*").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert "ENSURE_REQUIREMENTS" not in plan
    assert len(sizes) > 8 and max(r["grids"] for r in sizes) <= 32 and all(r["n"] == 64 * r["grids"] for r in sizes)


def test_a_turned_crop_is_computed_in_small_parts_where_its_pixels_differ():
    """The same samples as by doubles over the whole canvas, which held some hundred bytes a pixel and took ten times as long."""

    def plainly(image, angle, gray):
        h, w = image.shape[:2]
        s, c = np.sin(np.radians(angle)), np.cos(np.radians(angle))
        new_w, new_h = int(h * abs(s) + w * abs(c)), int(h * abs(c) + w * abs(s))
        y, x = np.mgrid[:new_h, :new_w]
        dx, dy = x - new_w / 2, y - new_h / 2
        x, y = c * dx - s * dy + w / 2, s * dx + c * dy + h / 2
        x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
        fx, fy = (x - x0)[..., None], (y - y0)[..., None]
        wide = np.full((3 * h, 3 * w, 3), float(gray))
        wide[h : 2 * h, w : 2 * w] = image
        at = lambda j, i: wide[np.clip(j + h, 0, 3 * h - 1), np.clip(i + w, 0, 3 * w - 1)]
        top, low = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx, at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
        return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)

    noise = np.random.default_rng(2).integers(0, 256, (90, 130, 3), dtype=np.uint8)
    disc = np.full((100, 80, 3), 20, np.uint8)
    disc[np.hypot(*(np.mgrid[:100, :80] - np.array([[[50]], [[40]]]))) < 30] = (235, 210, 220)
    for image in (noise, disc):
        for angle in (30, 90, 135, 180, 330):
            assert np.array_equal(K.rotate_expand(image, angle), plainly(image, angle, 128)), angle
    piece = K.resize(disc, 410, 512)
    tracemalloc.start()
    K.rotate_expand(piece, 30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * 410 * 512


def test_photos_are_drawn_once_for_their_rows(spark):
    """What a piece takes from its photo goes along with it, instead of a join of the photos with themselves, both sides of which were computed."""
    plan = queries.build_photos(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_tiles_are_not_broadcast(spark, monkeypatch):
    """Their files are so much smaller than what they hold that Spark took them for small tables, which pass through the driver whole."""
    plans = []
    whole = tiles.stored
    shown = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(tiles, "stored", lambda df, name: whole(shown(df), name))
    shown(queries.tile_peaks(spark, "/root/testdata/sf0.001"))
    joined = [p for p in plans if "Join" in p]
    assert len(joined) > 5 and all("SortMergeJoin" in p and "Broadcast" not in p for p in joined)


def test_contours_are_not_broadcast(spark):
    """As tiles: 168 MB of pieces with their contours were, for 12,000 photos."""
    plan = queries.build_photos(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    wide = [j for j in plan.toString().split("\n") if "Join" in j and "rightHint=(strategy=merge)" in j]
    assert len(wide) == 1
