"""The index on disk: photos, and a table of their codes, in hash buckets under numbered manifests.

``data`` holds buckets, which are written once and never changed; a manifest names those that make
up one version. A save writes the buckets that it changes, and then one manifest, so readers see
all of it or nothing, and a save that fails leaves only files that nobody reads. Of two saves at
once the later fails with Conflict and may be repeated. A manifest is as long as there are buckets,
whatever the number of photos; photo ids may be null.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CODE, PHOTO

#: How many buckets an index that is new has; a bucket should be some tasks' work.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another save published its version first."""


def _place(spark: SparkSession, path: str):
    """A path and the store that it is in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    p, store = _place(spark, path)
    return store.exists(p)


def _names(spark: SparkSession, path: str) -> list[str]:
    p, store = _place(spark, path)
    return [s.getPath().getName() for s in store.listStatus(p)] if store.exists(p) else []


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in _names(spark, f"{path}/manifests") if n.isdigit())


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def codes_of(photos: DataFrame) -> DataFrame:
    """(code, photo_id, piece_ord) of each piece with a code that is not empty."""
    rows = photos.select("photo_id", F.posexplode("pieces").alias("piece_ord", "p"))
    return rows.where("p.code != ''").select(F.col("p.code").alias("code"), "photo_id", F.col("piece_ord").cast("long").alias("piece_ord"))


@dataclass(frozen=True)
class Version:
    """One version of the index, which stays as it is while others are saved."""

    spark: SparkSession
    path: str
    number: int
    buckets: int
    folders: dict[str, dict[int, str]]

    def _read(self, kind: str, numbers=None) -> DataFrame:
        held = self.folders[kind]
        paths = [f"{self.path}/{held[b]}" for b in (held if numbers is None else numbers) if b in held]
        schema = PHOTO if kind == "photos" else CODE
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket_of(self, key: str | None) -> int:
        return self.spark.range(1).select(_bucket(F.lit(key).cast("string"), self.buckets)).first()[0]

    def photos(self, *photo_id: str | None) -> DataFrame:
        """All photos, or those of one id, for which one bucket is read."""
        return self._one("photos", "photo_id", *photo_id)

    def codes(self, *code: str) -> DataFrame:
        """(code, photo_id, piece_ord) of all coded pieces, or those of one code, for which one bucket is read."""
        return self._one("codes", "code", *code)

    def photos_of(self, ids: DataFrame) -> DataFrame:
        """The photos whose ids are among ``ids`` (photo_id); only the buckets that these fall into are read."""
        met = {r[0] for r in ids.select(_bucket(F.col("photo_id"), self.buckets)).distinct().collect()}
        named = ids.select(F.col("photo_id").alias("_id")).distinct()
        return self._read("photos", sorted(met)).join(named, F.col("photo_id").eqNullSafe(F.col("_id")), "left_semi")

    def _one(self, kind: str, key: str, *value: str | None) -> DataFrame:
        if not value:
            return self._read(kind)
        return self._read(kind, [self.bucket_of(value[0])]).where(F.col(key).eqNullSafe(F.lit(value[0]).cast("string")))


def current(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Version:
    """The latest version; an empty one, of so many buckets, where there is none."""
    path = path.rstrip("/")
    numbers = _versions(spark, path)
    if not numbers:
        return Version(spark, path, 0, buckets, {"photos": {}, "codes": {}})
    told = json.loads(spark.read.text(f"{path}/manifests/{numbers[-1]:08d}", wholetext=True).first()[0])
    folders = {kind: {int(b): f for b, f in told[kind].items()} for kind in ("photos", "codes")}
    return Version(spark, path, numbers[-1], told["buckets"], folders)


def _write(rows: DataFrame, now: Version, kind: str) -> dict[int, str]:
    """Rows written in their buckets, sorted by their keys; the folders that came to be. Large buckets are divided among tasks, small ones share one."""
    key = "photo_id" if kind == "photos" else "code"
    folder = f"data/{kind}-{uuid.uuid4().hex}"
    dealt = rows.withColumn("bucket", _bucket(F.col(key), now.buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", key)
    dealt.write.partitionBy("bucket").parquet(f"{now.path}/{folder}")
    return {int(n.split("=")[1]): f"{folder}/{n}" for n in _names(now.spark, f"{now.path}/{folder}") if n.startswith("bucket=")}


def _merged(now: Version, kind: str, touched: set[int], gone: DataFrame, fresh: dict[int, str]) -> dict[int, str]:
    """A kind's folders with fresh ones, after the rows of photos that are gone have been left out of the touched buckets."""
    both = sorted(touched & set(now.folders[kind]))
    out = now.folders[kind] | {b: f for b, f in fresh.items() if b not in both}
    if both:
        named = gone.select(F.col("photo_id").alias("_id")).distinct()
        kept = now._read(kind, both).join(named, F.col("photo_id").eqNullSafe(F.col("_id")), "left_anti")
        added = Version(now.spark, now.path, 0, now.buckets, {kind: fresh})._read(kind, both)
        out = {b: f for b, f in out.items() if b not in both} | _write(kept.unionByName(added), now, kind)
    return out


def _publish(now: Version, folders: dict[str, dict[int, str]]) -> None:
    spark = now.spark
    hidden, store = _place(spark, f"{now.path}/manifests/.{uuid.uuid4().hex}")
    target, _ = _place(spark, f"{now.path}/manifests/{now.number + 1:08d}")
    stream = store.create(hidden, False)
    try:
        stream.write(json.dumps({"buckets": now.buckets, **folders}).encode())
    finally:
        stream.close()
    if store.exists(target) or not store.rename(hidden, target):
        store.delete(hidden, False)
        raise Conflict(f"version {now.number + 1} of {now.path} is there already")


def _change(now: Version, gone: DataFrame, touched: set[int], fresh: dict[int, str]) -> None:
    """Publish the version in which fresh folders of photos have come and the photos of ``gone``, which are in touched buckets, have left."""
    came = Version(now.spark, now.path, 0, now.buckets, {"photos": fresh})._read("photos")
    named = gone.select(F.col("photo_id").alias("_id")).distinct()
    left = now._read("photos", sorted(touched)).join(named, F.col("photo_id").eqNullSafe(F.col("_id")), "left_semi")
    stale = {r[0] for r in codes_of(left).select(_bucket(F.col("code"), now.buckets)).distinct().collect()}
    codes = _write(codes_of(came), now, "codes")
    _publish(now, {"photos": _merged(now, "photos", touched, gone, fresh), "codes": _merged(now, "codes", stale | set(codes), gone, codes)})


def save(photos: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write photos to the index; those already there with the same ids are replaced, others stay. ``buckets`` counts for a new index."""
    now = current(photos.sparkSession, path, buckets)
    fresh = _write(photos.select(*PHOTO.names), now, "photos")
    if fresh:
        came = Version(now.spark, now.path, 0, now.buckets, {"photos": fresh})._read("photos")
        _change(now, came, set(fresh), fresh)


def delete(spark: SparkSession, path: str, photo_id: str) -> bool:
    """Drop a photo; false if there is none."""
    now = current(spark, path)
    found = now.photos(photo_id).select("photo_id")
    if found.isEmpty():
        return False
    _change(now, spark.createDataFrame([(photo_id,)], "photo_id string"), {now.bucket_of(photo_id)}, {})
    return True


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The photos of the latest version; empty where there is none."""
    return current(spark, path).photos()


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the latest versions, and the folders that those kept do not name; how many folders went.

    Not while a save runs: its folders are in no version yet.
    """
    path = path.rstrip("/")
    numbers = _versions(spark, path)
    needed: set[str] = set()
    for n in numbers[-max(1, keep) :]:
        told = json.loads(spark.read.text(f"{path}/manifests/{n:08d}", wholetext=True).first()[0])
        needed |= {f.split("/")[1] for kind in ("photos", "codes") for f in told[kind].values()}
    unneeded = [n for n in _names(spark, f"{path}/data") if n not in needed]
    for name in [*(f"manifests/{n:08d}" for n in numbers[: -max(1, keep)]), *(f"data/{n}" for n in unneeded)]:
        p, store = _place(spark, f"{path}/{name}")
        store.delete(p, True)
    return len(unneeded)
