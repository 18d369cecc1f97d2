"""Keeping the index up with a stream of photos: the latest version of each replaces what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.scratch import stored
from ..sources.store import current, save


def latest(photos: DataFrame, key: str = "photo_id", order: str = "created_at") -> DataFrame:
    """The row of each key with the largest order, equal rows counting once; a null order comes before all others, and of equal orders any one counts."""
    rest = [c for c in photos.columns if c != key]
    top = photos.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order)).alias("r"))
    return top.select(key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*photos.columns)


def newer(photos: DataFrame, old: DataFrame, key: str = "photo_id", order: str = "created_at") -> DataFrame:
    """Rows of ``photos`` that are not older than the row of ``old`` with their key; a null order is older than any other. Keys of ``old`` are distinct."""
    known = old.select(F.col(key).alias("_key"), F.struct(F.col(order).alias("o")).alias("_old"))
    fresh = F.col("_old").isNull() | (F.struct(F.col(order).alias("o")) >= F.col("_old"))
    return photos.join(known, F.col(key) == F.col("_key"), "left").where(fresh).select(*photos.columns)


def follow(stream: DataFrame, index: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write a stream of photos to the index, the newest version of each replacing what is there.

    Versions may come late and in any order: one older than the index's own changes nothing, nor
    does a batch that is repeated. What a batch brings is stored before it is written, as the index
    is read for it, of which only the buckets that its photos fall into.
    """

    def put(batch: DataFrame, number: int) -> None:
        fresh = stored(latest(batch), "fresh")
        old = current(batch.sparkSession, index).photos_of(fresh.select("photo_id")).select("photo_id", "created_at")
        save(newer(fresh, old), index)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if once else writer).start()
