"""The quality classifier: statistics, trees and traversal in plain Python; labels that were held out."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import boosted as B

DATA = "/root/testdata/sf0.01"


def plain(text):
    """The same statistics, one text and one word at a time."""
    text = text or ""
    if not text:
        return [0.0] * len(B.STATS)

    def kind(c):
        tests = (c.isupper(), c.isalpha(), c.isdigit(), c.isspace() and c not in "\n\r", c in "\n\r", c in B.MARKS, c in B.SHOUTS, c in B.STOPS)
        return next((i for i, t in enumerate(tests) if t), 8)

    kinds = Counter(map(kind, text))
    out = [math.log1p(len(text)), 0.0] + [kinds[k] / len(text) for k in range(len(B.KINDS))]
    words = text.split()
    if not words:
        return out + [0.0] * (len(B.STATS) - len(out))
    n, lengths, counts = len(words), [len(w) for w in words], Counter(words)
    out[1] = math.log1p(n)
    mean = sum(lengths) / n
    triples = list(zip(words, words[1:], words[2:]))
    lines = [x for x in text.replace("\r", "\n").split("\n") if x.split()]
    many = lambda xs: sum(Counter(xs)[x] > 1 for x in xs) / max(1, len(xs))
    return out + [
        mean,
        math.sqrt(max(0, sum(x * x for x in lengths) / n - mean * mean)),
        math.log1p(max(lengths)),
        sum(len(w) > 1 and any(c.isupper() for c in w) and not any(kind(c) == 1 for c in w) for w in words) / n,
        sum(not any(kind(c) < 2 for c in w) for w in words) / n,
        sum(kind(w[-1]) in (5, 6) for w in words) / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1),
        many(triples),
        many(lines),
        math.log1p(n / max(1, len(lines))),
    ]


TEXTS = [
    None, "", " ", "\n\n", "one", "A", "AB cd!! ÄÖ", "a b c a b c a b c", "x x x x", "line one\nline one\nother\n\nline one", "#$% | && 12 3.5 <b>", "日本語 текст 😀 a b　c",
    "word " * 400, "lone \ud800 surrogate", "tab\tand\x0bmore\r\nlines\r\n", "x" * 5000, "Same Same\nsame same", "!", "é" * 3 + "\n" + "é" * 3,
]


def test_statistics_of_texts_together_are_those_of_each(monkeypatch):
    want = np.array([plain(t) for t in TEXTS])
    assert np.allclose(B.statistics(TEXTS), want, atol=1e-9)
    assert B.statistics([]).shape == (0, len(B.STATS))
    monkeypatch.setattr(B, "SLICE", 7)
    assert np.allclose(B.statistics(TEXTS), want, atol=1e-9)


def walk(model, row):
    """One row through each tree, node by node."""
    total, inner = model.base, model.feature.shape[1]
    for f, t, v in zip(model.feature, model.threshold, model.value):
        at = 0
        while at < inner:
            at = 2 * at + (1 if row[f[at]] <= t[at] else 2)
        total += v[at - inner]
    return total


def test_trees_learn_and_flat_traversal_is_the_walk():
    some = np.random.default_rng(1)
    rows = np.round(some.normal(size=(3000, 5)), 2)
    labels = ((rows[:, 0] > 0.3) ^ (rows[:, 3] < -0.2)).astype(float)
    model = B.train(rows[:2000], labels[:2000])
    assert np.allclose(model.margins(rows[:200]), [walk(model, r) for r in rows[:200]])
    assert ((model.scores(rows[2000:]) >= 0.5) == labels[2000:]).mean() > 0.97
    # The order of rows does not matter, and rows may repeat.
    mixed = some.permutation(2000)
    assert np.array_equal(B.train(rows[mixed], labels[mixed]).value, model.value)


def test_the_first_split_is_the_best_one():
    some = np.random.default_rng(2)
    rows, labels = some.integers(0, 9, (300, 3)).astype(float), some.integers(0, 2, 300).astype(float)
    model = B.train(rows, labels, trees=1, depth=1)
    p = (labels.sum() + 1) / 302
    g, h = p - labels, np.full(300, p * (1 - p))

    def gain(f, t):
        left = rows[:, f] <= t
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        return part(left) + part(~left) - part(np.ones(300, bool))

    best = max(gain(f, t) for f in range(3) for t in range(8))
    assert math.isclose(gain(model.feature[0, 0], model.threshold[0, 0]), best)


def test_few_labels_or_of_one_kind():
    assert B.train(np.zeros((0, 2)), np.zeros(0)).scores(np.zeros((3, 2))).tolist() == [0.5] * 3
    assert (B.train(np.ones((20, 2)), np.ones(20)).scores(np.ones((1, 2))) > 0.9).all()


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "good words here", 7), (1, "good words here", 7), (2, "BAD!! ***", 7), (None, None, 7), (3, "", 7), (4, "x" * 100_000, 7)], "doc_id long, text string, label long")
    labels = spark.createDataFrame([(1, 1, 1.0), (1, 0, 0.0), (2, 0, 0.0), (2, 0, 0.0), (None, 1, 1.0), (3, None, 0.0), (4, 7, 0.0), (9, 1, 1.0)], "doc_id long, quality int, stats double")
    model = B.fit(docs, labels)
    got = docs.select("*", B.score(F.col("text"), model).alias("stats")).collect()
    assert len(got) == 6 and all(0 <= r["stats"] <= 1 for r in got)
    none = B.fit(docs, labels.limit(0))
    assert {r[0] for r in docs.select(B.score(F.col("text"), none)).collect()} == {0.5}
    assert docs.limit(0).select(B.score(F.col("text"), model)).count() == 0
    assert B.fit(docs.limit(0), labels).feature.shape[0] == 0


def test_held_out_accuracy_and_form(spark):
    got = B.op11_quality(spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs)
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in got)
    tested = [r for r in got if r["held_out"] and r["doc_id"] in label]
    assert len(tested) > 100 and sum(r["predicted"] == label[r["doc_id"]] for r in tested) / len(tested) >= 0.97


def test_held_out_labels_are_not_learned(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    docs.withColumns({"lang": F.lit("xx"), "source": F.lit("s")}).write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("quality", F.when(fold == 1, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(f"{tmp_path}/labels.parquet")
    show = lambda folder: {r["doc_id"]: round(r["score"], 9) for r in B.op11_quality(spark, folder).collect()}
    assert show(str(tmp_path)) == show(DATA)
