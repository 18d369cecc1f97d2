"""A stream of photo versions that come late: the newest stays."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.schema import PHOTO
from lodestone.sources import library, store
from lodestone.streaming.upsert import follow, latest, newer


def photo(name, at, note):
    return (name, f"/in/{note}", 10, 10, at, [])


@pytest.fixture
def feed(spark, tmp_path):
    def put(*rows, batch):
        frame = spark.createDataFrame([dict(photo_id=p, image_path=i, width=w, height=h, created_at=at, pieces=x) for p, i, w, h, at, x in rows], PHOTO)
        frame.coalesce(1).write.parquet(f"{tmp_path}/in{batch}")
        stream = spark.readStream.schema(PHOTO).parquet(f"{tmp_path}/in{batch}")
        follow(stream, f"file://{tmp_path}/index", f"{tmp_path}/state{batch}").awaitTermination()
        return {r["photo_id"]: r["image_path"] for r in store.open_index(spark, f"file://{tmp_path}/index").collect()}

    return put


def test_late_and_repeated_versions(feed):
    assert feed(photo("a", "2026-02", "a2"), photo("b", None, "b0"), photo("c", "2026-01", "c1"), batch=0) == {"a": "/in/a2", "b": "/in/b0", "c": "/in/c1"}
    # Older ones lose, one of the same time replaces, one with a time beats one without.
    assert feed(photo("a", "2026-01", "a1"), photo("b", "2025-01", "b1"), photo("c", "2026-01", "c1b"), batch=1) == {"a": "/in/a2", "b": "/in/b1", "c": "/in/c1b"}
    assert feed(photo("a", None, "a0"), photo("b", None, "b0b"), photo("d", None, "d0"), batch=2) == {"a": "/in/a2", "b": "/in/b1", "c": "/in/c1b", "d": "/in/d0"}
    assert feed(photo("a", "2026-01", "a1"), photo("a", "2026-03", "a3"), photo("a", None, "a0"), batch=3)["a"] == "/in/a3"


def test_latest_and_newer(spark):
    rows = spark.createDataFrame([("a", None, 1), ("b", "2", 2), ("b", "1", 3), ("b", None, 4), (None, "1", 5)], "photo_id string, created_at string, v int")
    assert {(r["photo_id"], r["v"]) for r in latest(rows).collect()} == {("a", 1), ("b", 2), (None, 5)}
    old = spark.createDataFrame([("a", None), ("b", "2")], "photo_id string, created_at string")
    assert {r["v"] for r in newer(rows, old).collect()} == {1, 2, 5}
    assert newer(rows.limit(0), old).count() == 0 and newer(rows, old.limit(0)).count() == 5
    assert newer(rows.withColumn("more", F.lit(1)), old).columns == [*rows.columns, "more"]
