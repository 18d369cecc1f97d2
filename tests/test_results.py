"""Uniqueness, passes, lookups and the library's files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.operators import lookup, recognize
from lodestone.operators.resolve import resolve
from lodestone.sources import library, store
from lodestone.streaming.upsert import follow, latest

RESULT = "photo_id string, piece_ord long, piece_id int, code string, confidence double, raw_text string, method string, angle int"


def results(spark, rows):
    return spark.createDataFrame([("p", i, i, c, f, "raw", "direct", 0) for i, (c, f) in enumerate(rows)], RESULT)


def test_the_most_confident_keeps_the_code_and_the_first_of_equals(spark):
    got = resolve(results(spark, [("B-403", 0.6), ("B-403", 0.95), ("B-403", 0.95), (None, 0.0), ("", 0.0), ("", 0.0), ("A-1", 0.4)])).orderBy("piece_ord").collect()
    assert [r["code"] for r in got] == [None, "B-403", None, None, "", "", "A-1"]
    assert [r["method"] for r in got] == ["conflict", "direct", "conflict", "direct", "direct", "direct", "direct"]
    assert got[0]["confidence"] == 0 and got[0]["raw_text"] == "raw" and got[0]["angle"] == 0


def test_same_code_in_other_photos_stays(spark):
    rows = results(spark, [("A-1", 0.5)])
    assert resolve(rows.unionByName(rows.withColumn("photo_id", F.lit("q")))).where("code = 'A-1'").count() == 2


DETECTED = "photo_id string, piece_id long, pass string, seq int, angle int, det_ord int, raw_text string, snapped string, score double, poly array<array<int>>"


def run_cascade(spark, rows):
    quad = [[0, 0], [9, 0], [9, 4], [0, 4]]
    made = spark.createDataFrame([("p", 0, p, s, s * 30, o, c or "?", c, f, quad if q else None) for p, s, o, c, f, q in rows], DETECTED)
    return recognize.cascade(spark.createDataFrame([("p", 0)], "photo_id string, piece_id long"), made).first()


def test_a_sure_direct_read_stands(spark):
    r = run_cascade(spark, [("direct", 0, 0, "A-1", 0.9, True), ("line", 0, 0, "A-2", 0.99, False), ("sweep", 0, 0, "A-3", 1.0, False)])
    assert (r["code"], r["method"], r["angle"]) == ("A-1", "direct", 0)


def test_the_line_needs_a_quad(spark):
    rows = [("direct", 0, 0, "A-1", 0.5, False), ("line", 0, 0, "A-2", 0.95, False), ("sweep", 1, 0, "A-3", 0.7, False)]
    assert run_cascade(spark, rows)["code"] == "A-3"
    assert run_cascade(spark, [("direct", 0, 1, None, 0.2, True), *rows])["code"] == "A-2"


def test_a_sweep_stops_when_certain_and_replaces_only_if_better(spark):
    r = run_cascade(spark, [("direct", 0, 0, "A-1", 0.6, False), ("sweep", 0, 0, "A-2", 0.99, False), ("sweep", 1, 0, "A-3", 1.0, False)])
    assert (r["code"], r["confidence"]) == ("A-2", 0.99)
    assert run_cascade(spark, [("direct", 0, 0, "A-1", 0.6, False), ("sweep", 0, 0, "A-2", 0.6, False)])["method"] == "direct"


def test_low_scores_and_no_codes_give_nothing(spark):
    r = run_cascade(spark, [("direct", 0, 0, "A-1", 0.349, False), ("direct", 0, 1, None, 0.9, False)])
    assert (r["code"], r["confidence"], r["method"], r["raw_text"]) == (None, 0.0, "none", None)
    assert run_cascade(spark, [("direct", 0, 0, "A-1", 0.35, False), ("direct", 0, 1, "A-2", 0.35, False)])["code"] == "A-1"


def test_lookups(spark):
    pieces = spark.createDataFrame([("a", 0, 0, "A-1"), ("a", 1, 1, None), ("a-b", 0, 0, "A-1"), ("b", 0, 0, ""), ("b", 1, 1, "B-403")], "photo_id string, piece_ord long, piece_id int, code string")
    asked = spark.createDataFrame([("a001",), (" b-403 ",), ("D-777",), ("!!!",)], "query string")
    # Photos are ordered by file name: a-b.json stands before a.json.
    assert {(r["code"], r["photo_id"]) for r in lookup.hits(asked, pieces).collect()} == {("A-1", "a-b"), ("B-403", "b")}
    assert {(r["code"], r["photo_id"], r["n"], r["piece_ids"]) for r in lookup.misses(asked, pieces).collect()} == {(c, p, 1, i) for c in ("D-777", "!!!") for p, i in (("a", "1"), ("b", "0"))}
    stats = {r["photo_id"]: (r["total"], r["recognized"]) for r in lookup.photo_stats(spark.createDataFrame([("a",), ("none",)], "photo_id string"), pieces).collect()}
    assert stats == {"a": (2, 1), "none": (0, 0)}


def photo(name, code="A-1", **more):
    piece = {"piece_id": 0, "contour": [[0, 0], [10, 0], [10, 10]], "bbox": [0, 0, 11, 11], "area": 50.0, "code": code, "confidence": 0.9, "raw_text": code, "method": "direct", "angle": 0}
    return {"photo_id": name, "image_path": "/x", "width": 10, "height": 20, "created_at": "2026-01-01T00:00:00", "pieces": [piece]} | more


def test_library_files(spark, tmp_path):
    assert library.load(spark, str(tmp_path / "none")).count() == 0
    files = {"a.json": photo("a"), "a-b.json": photo("a-b"), "z.json": photo("a", "A-2"), "part.json": photo("p", pieces=[{"piece_id": 1, "contour": [], "bbox": [0, 0, 1, 1], "area": 0}]), "lack.json": {"photo_id": "q"}, "odd.json": photo("o", pieces=[{"piece_id": 1}])}
    for name, content in files.items():
        (tmp_path / name).write_text(json.dumps(content, indent=2, ensure_ascii=False))
    (tmp_path / "broken.json").write_text("{")
    photos = library.load(spark, str(tmp_path))
    assert [r["photo_id"] for r in photos.orderBy("photo_ord").collect()] == ["a-b", "a", "p"]
    pieces = {r["photo_id"]: r for r in library.flat(photos).collect()}
    assert pieces["a"]["code"] == "A-2" and pieces["p"]["confidence"] == 0 and pieces["p"]["method"] == "none"
    assert {r["file"] for r in library.quarantined(spark, str(tmp_path)).collect()} == {"lack.json", "odd.json", "broken.json"}


def test_index_replaces_by_photo(spark, tmp_path):
    index = str(tmp_path / "index")
    rows = lambda *p: library.from_json(spark.createDataFrame([(json.dumps(x),) for x in p], "json string"))
    assert store.open_index(spark, index).count() == 0
    store.save(rows(photo("a"), photo("左上角")), index)
    store.save(rows(photo("a", "A-9")), index)
    assert {(r["photo_id"], r["pieces"][0]["code"]) for r in store.open_index(spark, index).collect()} == {("a", "A-9"), ("左上角", "A-1")}
    assert store.delete(spark, index, "左上角") and not store.delete(spark, index, "none")
    assert [r["photo_id"] for r in store.open_index(spark, index).collect()] == ["a"]


def test_a_stream_keeps_the_latest(spark, tmp_path):
    source, index = str(tmp_path / "in"), str(tmp_path / "index")
    made = library.from_json(spark.createDataFrame([(json.dumps(photo("a", c, created_at=t)),) for c, t in (("A-1", "2026-01-01"), ("A-2", "2026-01-02"))], "json string"))
    assert latest(made).count() == 1
    made.write.parquet(source)
    query = follow(spark.readStream.schema(made.schema).parquet(source), index, str(tmp_path / "state"))
    query.awaitTermination()
    assert [r["pieces"][0]["code"] for r in store.open_index(spark, index).collect()] == ["A-2"]


def test_payload(spark):
    rows = [json.dumps({"res": {"rec_texts": ["a", 3, "b"], "rec_scores": [0.5, 0.6], "dt_polys": [[[1.0, 2.0]]]}}), json.dumps({"rec_texts": ["c"], "rec_scores": [1.0]}), "{}", None]
    got = recognize.payload(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k int, payload string")).collect()
    assert [(r["k"], r["text"], r["score"], r["poly"]) for r in got] == [(0, "a", 0.5, [[1, 2]]), (1, "c", 1.0, None)]
