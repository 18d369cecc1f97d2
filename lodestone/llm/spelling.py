"""Spelling variants: near words found through wildcard groups and deletions, without making pairs of a group."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, stored, trimmed

#: Words are runs of these Latin-1 characters, ASCII capitals being lower-cased before.
RUNS = re.compile(rb"[a-z\xC0-\xFF]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Stands for the replaced character in a group's key; no word may have it.
WILD = "*"
#: Distinct words that a task counts before it hands them on.
HELD = 500_000


def runs(text: str | None) -> list[bytes]:
    """The words of a text in Latin-1: its maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased; none for null."""
    return RUNS.findall((text or "").encode("latin-1", "replace").translate(LOWER))


def dented(words: list[bytes], salt: str, modulus: int = 97) -> list[bytes]:
    """``words`` with, where ``modulus`` divides the checksum of ``salt``, a colon and the word in UTF-8, one character less: that at checksum modulo length."""
    before, out = crc32(f"{salt}:".encode("utf-8", "surrogatepass")), list(words)
    for i, w in enumerate(words):
        mark = crc32(w if w.isascii() else w.decode("latin-1").encode(), before)
        if not mark % modulus:
            at = mark % len(w)
            out[i] = w[:at] + w[at + 1 :]
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, modulus: int | None = 97) -> DataFrame:
    """(word, n) of the words of whole texts: those long enough that occur often enough in all texts together.

    With a ``modulus``, words are dented by their document's id (a null id being an empty text).
    Words are counted within tasks, at most HELD distinct ones at a time, then over all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "part"])

        counts: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = runs(text.as_py())
                counts.update(w for w in (dented(words, doc or "", modulus) if modulus else words) if len(w) >= least_length)
                if len(counts) > HELD:
                    yield told(counts)
                    counts = Counter()
        yield told(counts)

    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    parts = texts.mapInArrow(lambda batches: trimmed(run(batches)), "word string, part long")
    return parts.groupBy("word").agg(F.sum("part").alias("n")).where(F.col("n") >= least_count)


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n, n_near, best): for each distinct word of (word, n) how many words are near, and of these the most frequent.

    Near words differ by exactly one inserted, deleted or replaced code point; ``best`` is
    struct(minus n, word), the least of which is the most frequent and of ties the first in
    code-point order; null where none is near. ``vocab`` is read four times and should be stored.

    Words that differ by a replacement share exactly one group of (position, prefix, suffix); each
    member gets the group's size and its two best words, of which at most one is itself. A deletion
    turns a word into a shorter one, which the vocabulary has or not: a word has no more deletions
    than letters. Both kinds are added up by word at once, so no pairs of a group are ever made.
    A group has as many rows as there are letters at most, and is a window's partition.
    """
    rank = F.struct((-F.col("n")).alias("minus"), F.col("word").alias("word"))
    cuts = F.sequence(F.lit(1), F.length("word"))

    def without(at: Column, filler: str) -> Column:
        return F.concat(F.substring(F.col("word"), F.lit(1), at - 1), F.lit(filler), F.substring(F.col("word"), at + 1, F.length("word")))

    wild = vocab.where(F.length("word") > 0).select("word", "n", F.explode(F.transform(cuts, lambda at: without(at, WILD))).alias("key"))
    group = W.partitionBy("key")
    ordered = group.orderBy(F.desc("n"), "word")
    whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    members = wild.select("word", F.count("*").over(group).alias("size"), F.first(rank).over(whole).alias("top"), F.nth_value(rank, 2).over(whole).alias("second")).where("size > 1")
    other = F.when(F.col("top.word") == F.col("word"), F.col("second")).otherwise(F.col("top"))
    replaced = members.select("word", (F.col("size") - 1).alias("near"), other.alias("best"))

    shorter = F.array_distinct(F.transform(cuts, lambda at: without(at, "")))
    cut = vocab.where(F.length("word") > 0).select(F.col("word").alias("long"), F.col("n").alias("n_long"), F.explode(shorter).alias("word"))
    met = cut.join(vocab, "word")
    of_long = F.struct(F.col("long").alias("word"), rank.alias("best"))
    of_short = F.struct(F.col("word").alias("word"), F.struct((-F.col("n_long")).alias("minus"), F.col("long").alias("word")).alias("best"))
    indels = met.select(F.explode(F.array(of_long, of_short)).alias("link")).select("link.word", F.lit(1).cast("long").alias("near"), "link.best")

    nothing = F.lit(None).cast("struct<minus: bigint, word: string>")
    links = replaced.unionByName(indels).withColumn("n", F.lit(None).cast("long"))
    all_ = vocab.select("word", F.lit(0).cast("long").alias("near"), nothing.alias("best"), "n").unionByName(links)
    return all_.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word that forms lead to, starting from word.

    Words must be distinct and forms free of circles. Each round replaces every pointer by its
    target's pointer, so that rounds grow with the logarithm of the longest chain.
    """
    spark = forms.sparkSession
    now = stored(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("to"), F.lit(True).alias("moved")), "pointers")
    while not now.where("moved").isEmpty():
        ahead = now.select(F.col("word").alias("at"), F.col("to").alias("next"))
        then = now.join(ahead, F.col("to") == F.col("at"), "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"))
        last, now = now, stored(then, "pointers")
        discard(spark, last)
    return now.select("word", F.col("to").alias("root"))


def variants(vocab: DataFrame, ratio: float = 2.0) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a vocabulary (word, n) of distinct words.

    A word's form is its best near word, if that occurs ``ratio`` times as often or more; the root
    is where forms lead to, the word itself if it has none. Null words are left out.
    """
    vocab = stored(vocab.where(F.col("word").isNotNull()).select("word", "n"), "vocabulary")
    best = F.col("best")
    near = near_words(vocab)
    enough = -best["minus"] >= F.lit(ratio) * F.col("n")
    found = stored(near.select("word", "n", "n_near", F.when(enough, best["word"]).alias("form"), F.when(enough, -best["minus"]).alias("form_n")), "near_words")
    ends = roots(found)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 13 over all of ``documents``; a null doc_id counts as an empty text."""
    return variants(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")))
