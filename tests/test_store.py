"""The index on disk against a plain dictionary of photos; what readers see while saves go wrong."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.plans.service import Service
from lodestone.schema import PHOTO
from lodestone.sources import store


def photo(name, *codes):
    pieces = [dict(piece_id=i, contour=[[i, 0], [i, 3], [i + 2, 3]], bbox=[i, 0, 3, 4], area=3.0, code=c, confidence=0.5, raw_text=c, method="direct", angle=0) for i, c in enumerate(codes)]
    return dict(photo_id=name, image_path=f"/in/{name}", width=9, height=9, created_at="2026-01-01", pieces=pieces)


def rows(spark, *photos):
    return spark.createDataFrame(list(photos), PHOTO)


def seen(spark, path):
    """{photo: codes} of the photos, after a check that the table of codes says the same."""
    now = store.current(spark, path)
    found = {r["photo_id"]: tuple(p["code"] for p in r["pieces"]) for r in now.photos().collect()}
    told = {(r["code"], r["photo_id"], r["piece_ord"]) for r in now.codes().collect()}
    assert told == {(c, p, i) for p, codes in found.items() for i, c in enumerate(codes) if c}
    return found


def test_saves_and_deletes_in_any_order(spark, tmp_path):
    some, path, known = random.Random(5), f"file://{tmp_path}/index", {}
    assert seen(spark, path) == {} and not store.delete(spark, path, "a")
    for _ in range(5):
        new = {some.choice(["a", "b", "c", "d/e", "左", "x=1", None]): tuple(some.choice(["A-1", "A-2", "B-300", "", None]) for _ in range(some.randrange(4))) for _ in range(3)}
        store.save(rows(spark, *(photo(p, *c) for p, c in new.items())), path, 3)
        known |= new
        assert seen(spark, path) == known
        gone = some.choice(["a", "b", "none"])
        assert store.delete(spark, path, gone) == (known.pop(gone, 0) != 0)
        assert seen(spark, path) == known
    store.save(rows(spark), path)
    assert seen(spark, path) == known and store.current(spark, path).buckets == 3


def test_one_question_reads_one_bucket(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    store.save(rows(spark, *(photo(f"p{i}", f"A-{i + 1}", f"A-{i + 2}") for i in range(40))), path, 8)
    now = store.current(spark, path)
    assert len(now.folders["photos"]) == len(now.folders["codes"]) == 8
    for found, whole in ((now.codes("A-7"), now.codes()), (now.photos("p7"), now.photos())):
        assert {f.split("/")[-2] for f in found.inputFiles()} < {f.split("/")[-2] for f in whole.inputFiles()} and len({f.split("/")[-2] for f in found.inputFiles()}) == 1
    assert {(r["photo_id"], r["piece_ord"]) for r in now.codes("A-7").collect()} == {("p5", 1), ("p6", 0)}
    assert [r["photo_id"] for r in now.photos("p7").collect()] == ["p7"] and now.photos("none").count() == now.codes("none").count() == 0
    assert {r["photo_id"] for r in now.photos_of(spark.createDataFrame([("p3",), ("p9",), ("p3",), (None,)], "photo_id string")).collect()} == {"p3", "p9"}
    found, row = Service(spark, path).query(" a7 ")
    assert found and (row.first()["photo_id"], row.first()["piece_ord"], row.first()["query"]) == ("p5", 1, " a7 ")
    found, row = Service(spark, path).query("D-999")
    assert not found and row.count() == 0


def test_a_save_that_fails_is_not_seen(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    store.save(rows(spark, photo("a", "A-1"), photo("b", "A-2")), path, 2)
    broken = rows(spark, photo("a", "A-9"), photo("c", "A-3")).withColumn("width", F.when(F.col("photo_id") == "c", F.raise_error(F.lit("broken"))).otherwise(F.col("width")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        store.save(broken, path)
    assert seen(spark, path) == {"a": ("A-1",), "b": ("A-2",)}


def test_readers_keep_their_version_and_late_writers_fail(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    store.save(rows(spark, photo("a", "A-1"), photo("b", "A-2")), path, 2)
    before = store.current(spark, path)
    store.save(rows(spark, photo("a", "A-5")), path)
    assert {r["code"] for r in before.codes().collect()} == {"A-1", "A-2"}
    with pytest.raises(store.Conflict):
        store._publish(before, before.folders)
    assert seen(spark, path) == {"a": ("A-5",), "b": ("A-2",)}
    store.save(rows(spark, photo("b", "A-6")), path)
    assert store.vacuum(spark, path, 1) > 0 and store.vacuum(spark, path, 1) == 0
    assert seen(spark, path) == {"a": ("A-5",), "b": ("A-6",)}
