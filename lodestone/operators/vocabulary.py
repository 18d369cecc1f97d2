"""The closed vocabulary of codes, and matching recognized text to it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions.columns import free
from ..functions.costs import CANONICAL, CONFUSED
from ..functions.text import normalize
from ..sources.scratch import stored

#: Texts of up to so many are broadcast with their codes, some 10 MB.
FEW_TEXTS = 100_000


def codes(spark: SparkSession, settings: Settings = SETTINGS) -> DataFrame:
    """(ord, prefix, number, code, len, digits), in vocabulary order."""
    ranges = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for p, lo, hi in settings.ranges])
    rows = spark.range(1, numPartitions=1).select(F.explode(ranges).alias("r")).select("r.prefix", F.explode(F.sequence("r.lo", "r.hi")).alias("number"))
    code = F.concat("prefix", F.lit("-"), F.col("number").cast("string"))
    before, ord_ = 0, F.lit(None).cast("int")
    for p, lo, hi in settings.ranges:
        ord_ = F.when(F.col("prefix") == p, F.col("number") - lo + before).otherwise(ord_)
        before += hi - lo + 1
    return rows.select(ord_.alias("ord"), "prefix", "number", code.alias("code"), F.length(code).alias("len"), (F.length(code) - 2).alias("digits"))


def prefix_of(number: Column, settings: Settings = SETTINGS) -> Column:
    """The prefix whose range a number lies in, or null."""
    out = F.lit(None).cast("string")
    for p, lo, hi in settings.ranges:
        out = F.when(number.between(lo, hi), F.lit(p)).otherwise(out)
    return out


def number_pattern(low: int, high: int) -> str:
    """A regular expression of the whole numbers from low (1 or more) to high, in blocks of equal leading digits."""
    blocks = []
    while low <= high:
        k = 0
        while low % 10 ** (k + 1) == 0 and low + 10 ** (k + 1) - 1 <= high:
            k += 1
        blocks.append(f"{low // 10**k}" + "[0-9]" * k)
        low += 10**k
    return "|".join(blocks)


def is_valid(code: Column, settings: Settings = SETTINGS) -> Column:
    """Whether a text is a code of the vocabulary; false for null. Only ASCII digits count as digits.

    One regular expression, so that long expressions for the text are computed once.
    """
    ranges = "|".join(f"{p}-(?:{number_pattern(lo, hi)})" for p, lo, hi in settings.ranges)
    return F.coalesce(code.rlike(rf"\A(?:{ranges})\z"), F.lit(False))


class Matcher:
    """Nearest codes by numpy over the whole vocabulary at once."""

    def __init__(self, settings: Settings = SETTINGS):
        self.s = settings
        self.codes = [f"{p}-{n}" for p, lo, hi in settings.ranges for n in range(lo, hi + 1)]
        fold = str.maketrans(CONFUSED, CANONICAL)
        self.fold = fold
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({len(c) for c in self.codes}):
            at = [i for i, c in enumerate(self.codes) if len(c) == n]
            plain = np.array([[ord(x) for x in self.codes[i]] for i in at], np.int64)
            self.by_length[n] = np.array(at), plain, np.array([[ord(x) for x in self.codes[i].translate(fold)] for i in at], np.int64)

    def costs(self, text: str, n: int) -> np.ndarray:
        """Cost of reading ``text`` for each code of length n."""
        s = self.s
        _, plain, folded = self.by_length[n]
        read, near = [ord(x) for x in text], [ord(x) for x in text.translate(self.fold)]

        def swap(i: int, j: int) -> np.ndarray:
            return np.where(plain[:, j] == read[i], 0, np.where(folded[:, j] == near[i], s.confused, s.replaced))

        if len(text) == n:
            return sum((swap(i, i) for i in range(n)), np.zeros(len(plain), np.int64))
        above = [np.full(len(plain), j * s.dropped) for j in range(n + 1)]
        for i in range(len(text)):
            row = [above[0] + s.spurious]
            for j in range(n):
                row.append(np.minimum(np.minimum(above[j + 1] + s.spurious, row[j] + s.dropped), above[j] + swap(i, j)))
            above = row
        return above[n]

    def snap(self, text: str, cap: int) -> tuple[str | None, int | None]:
        """(code, cost) of a normalised text that is no code itself; a null cost is infinite."""
        s = self.s
        if not text:
            return None, None
        least = {n: s.spurious * (len(text) - n) if len(text) > n else s.dropped * (n - len(text)) for n in self.by_length}
        if min(least.values()) > cap + s.margin:
            return None, min(least.values())
        near = [n for n, c in least.items() if c <= cap + s.margin]
        at = np.concatenate([self.by_length[n][0] for n in near])
        cost = np.concatenate([self.costs(text, n) for n in near])
        best = int(cost.min())
        if (cost < best + s.margin).sum() > 1:
            return None, best
        code = self.codes[int(at[cost.argmin()])]
        return (code if best <= min(cap, s.per_digit * (len(code) - 2)) else None), best


def _matched(texts: DataFrame, limit: int, settings: Settings) -> DataFrame:
    """The rows, whose last column is ``text`` (normalised, without nulls), with ``code`` and ``cost``.

    Codes are told by looking them up; other texts are matched, each once a worker as far as its
    cache goes, against the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(settings)
        codes, near = set(own.codes), lru_cache(100_000)(lambda t: own.snap(t, limit))
        for batch in batches:
            got = [(t, 0) if t in codes else near(t) for t in batch.column("text").to_pylist()]
            added = [pa.array([c for c, _ in got], pa.string()), pa.array([d for _, d in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "code", "cost"])

    spark = texts.sparkSession
    # Few bytes but much work for each: dealt over all cores, which adaptive merging of small partitions would undo.
    dealt = texts.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.mapInArrow(run, ", ".join([*(f"`{c}` string" for c in texts.columns), "code string", "cost long"]))


def snap_distinct(texts: DataFrame, text_col: str = "text", cap: int | None = None, settings: Settings = SETTINGS) -> DataFrame:
    """(text, code, cost) for each distinct text of a column of normalised texts; nulls are left out.

    ``cost`` is in hundredths and null where infinite; ``code`` is null where there is no match,
    where two are too close to tell, or where the best costs more than its length allows.
    """
    found = texts.select(F.col(text_col).alias("text")).where("text IS NOT NULL").distinct()
    return _matched(found, settings.max_distance if cap is None else cap, settings)


def snap(rows: DataFrame, raw_col: str, cap: int | None = None, settings: Settings = SETTINGS) -> DataFrame:
    """``rows`` with ``text`` (normalised), ``snapped`` and ``cost``, in place of any of these names. Null texts get nulls.

    Each distinct raw text is normalised and matched once, stored, and joined back by itself: by
    broadcast where there are at most FEW_TEXTS, so that rows stay where they are, else by a
    shuffle, in which a text that many rows share is left to adaptive skew handling. ``rows`` is
    read twice.
    """
    raw = free(rows, "_raw")
    named = rows.select(F.col(raw_col).alias(raw)).where(F.col(raw).isNotNull()).distinct().withColumn("text", normalize(F.col(raw)))
    known = _matched(named, settings.max_distance if cap is None else cap, settings).withColumnRenamed("code", "snapped")
    known = stored(known, "texts")
    known = F.broadcast(known) if known.count() <= FEW_TEXTS else known
    return rows.withColumn(raw, F.col(raw_col)).drop("text", "snapped", "cost").join(known, raw, "left").drop(raw)
