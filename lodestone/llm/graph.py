"""Connected components of an edge table, without collecting nodes or groups anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b), root being the smallest node it reaches.

    Alternates large-star and small-star steps until the edges form stars. Each step is two
    joins on the node whose build side is an aggregate; a node with very many edges is only
    ever the probe side, whose partitions adaptive execution splits. Each round is written to
    the shared folder; the last round's table stays there for as long as the result is read.
    Self-edges and repeated edges are allowed; null ends are dropped. ``rows`` is about how many
    edges there are, where that is known.
    """
    spark = edges.sparkSession
    kept = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = stored(kept, "edges", rows), None
    sign = _sign(now)
    while sign != before:
        if sign[0] == 0:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = stored(small.select("e.a", "e.b").where("a <> b").distinct(), "edges", 2 * sign[0])
        before, sign = sign, _sign(after)
        discard(spark, now)
        now = after
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _sign(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(row)
