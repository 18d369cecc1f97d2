"""What a client of the index calls. Tables in, tables or bytes out; no transport."""

from __future__ import annotations

import uuid
from pathlib import PurePath

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions.text import name_error, normalize, photo_name
from ..operators import kernels, lookup
from ..sources import library, store
from ..sources.images import read_images
from .index import build_index


class Invalid(ValueError):
    """A request that names something it may not."""


class Missing(LookupError):
    """A request for something that is not there."""


class Service:
    """The index in one folder, and uploaded photos in another, ``photos``, which is beside it unless given."""

    def __init__(self, spark: SparkSession, index: str, factory=None, settings: Settings = SETTINGS, photos: str | None = None):
        self.spark, self.index, self.factory, self.settings = spark, index, factory, settings
        self.uploads = (photos or f"{index.rstrip('/')}-photos").rstrip("/")

    def photos(self) -> DataFrame:
        return store.open_index(self.spark, self.index)

    def pieces(self) -> DataFrame:
        return library.flat(self.photos())

    def check_name(self, name: str) -> str:
        """The trimmed name, or an Invalid with what is wrong with it."""
        row = self.spark.range(1).select(name_error(F.lit(name), self.settings).alias("error"), F.regexp_replace(F.lit(name), r"(?U)^\s+|\s+$", "").alias("name")).first()
        if row["error"]:
            raise Invalid(row["error"])
        return row["name"]

    def ingest(self, path: str, created_at: str, photo_id: str | None = None) -> DataFrame:
        """Index the photo at a path; a name is checked before the image is read. The summary's row."""
        name = self.check_name(photo_id) if photo_id else None
        images = read_images(self.spark, path)
        if images.isEmpty():
            raise Invalid("unreadable")
        named = images.withColumn("photo_id", photo_name(F.lit(name), F.col("image_path")))
        built = build_index(named, self.factory, created_at, self.settings)
        store.save(built, self.index)
        return self.summary().join(named.select("photo_id"), "photo_id", "left_semi")

    def upload(self, data: bytes, filename: str | None, created_at: str, photo_id: str | None = None) -> DataFrame:
        """Store the bytes of an image, in place of an earlier copy of that name, and index it. The summary's row.

        Without a photo id, or with an empty one, the file's stem names it, or else a random one. A name is checked before
        the bytes are decoded, and bytes that are no image leave what is stored as it is.
        """
        name = self.check_name(photo_id or PurePath(filename or "").stem or uuid.uuid4().hex[:8])
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        came, kept = (jvm.org.apache.hadoop.fs.Path(x) for x in (f"{self.uploads}/incoming/{uuid.uuid4().hex}", f"{self.uploads}/{name}.image"))
        disk = came.getFileSystem(conf)
        stream = disk.create(came, True)
        try:
            stream.write(data)
        finally:
            stream.close()
        try:
            if read_images(self.spark, came.toString()).isEmpty():
                raise Invalid("unreadable")
            disk.delete(kept, False)
            disk.rename(came, kept)
        finally:
            disk.delete(came, False)
        return self.ingest(kept.toString(), created_at, name)

    def summary(self) -> DataFrame:
        """(photo_id, total, recognized, unrecognized, rate, created_at) of every photo."""
        photos = self.photos()
        return lookup.photo_stats(photos, library.flat(photos)).join(photos.select("photo_id", "created_at"), "photo_id")

    def delete(self, photo_id: str) -> None:
        if not store.delete(self.spark, self.index, photo_id):
            raise Missing(photo_id)

    def query(self, code: str) -> tuple[bool, DataFrame]:
        """Whether a code is found, with its piece's row, or else the rows of unrecognized pieces by photo. A hit reads a bucket of codes and one of photos."""
        asked = self.spark.range(1).select(F.lit(code).alias("query"))
        now = store.current(self.spark, self.index)
        plain = asked.select(normalize(F.col("query"))).first()[0]
        first = None if plain is None else lookup.hits(asked, now.codes(plain)).first()
        if first is None:
            return False, lookup.misses(asked, library.flat(now.photos()))
        row = library.flat(now.photos(first["photo_id"])).where(F.col("piece_ord") == first["piece_ord"])
        return True, row.select(F.lit(code).alias("query"), "code", *[c for c in row.columns if c != "code"])

    def _image(self, photo_id: str) -> np.ndarray:
        """A photo's own picture."""
        row = store.current(self.spark, self.index).photos(photo_id).select("image_path").first()
        found = row and read_images(self.spark, row["image_path"]).first()
        if not found:
            raise Missing(photo_id)
        return np.frombuffer(found["data"], np.uint8).reshape(found["height"], found["width"], 3)

    def highlight(self, code: str, photo_id: str | None = None) -> bytes:
        """PNG of the photo with the code's piece lit; on a miss, of the given photo with its unrecognized pieces."""
        found, rows = self.query(code)
        if found:
            row = rows.first()
            return kernels.png(kernels.highlight(self._image(row["photo_id"]), [np.array(row["contour"])], False, self.settings))
        if photo_id is None:
            raise Missing(code)
        left = lookup.unrecognized(library.flat(store.current(self.spark, self.index).photos(photo_id))).orderBy("piece_ord").select("contour").collect()
        return kernels.png(kernels.highlight(self._image(photo_id), [np.array(r["contour"]) for r in left], True, self.settings))

    def thumbnail(self, code: str, size: int | None = None) -> bytes:
        """PNG of the code's piece."""
        found, rows = self.query(code)
        if not found:
            raise Missing(code)
        row = rows.first()
        return kernels.png(kernels.thumbnail(self._image(row["photo_id"]), np.array(row["contour"]), self.settings, size))
