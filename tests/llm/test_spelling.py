"""Spelling variants against brute force over all pairs."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import spelling as S

DATA = "/root/testdata/sf0.001"


def near(a, b):
    """Whether exactly one inserted, deleted or replaced character parts two words."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def expected(counts, ratio=2):
    mates = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(mates[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(mates[w]), counts[form[w]] if form[w] is not None else None) for w, n in counts.items()}


def words_of(rows):
    counts = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 5
    return {w: n for w, n in counts.items() if n >= 3}


def test_the_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in S.op13_spelling(spark, DATA).collect()} == expected(words_of(rows))


VOCABULARIES = [
    {"aaaaa": 3, "aaaa": 6, "aaa": 12, "aa": 24, "a": 48},
    {"abcde": 3, "xbcde": 6, "xbcdz": 12, "xbcyz": 24, "xwcyz": 48, "xwvyz": 96, "uwvyz": 200, "other": 5},
    {"colour": 10, "color": 10, "colors": 4, "colours": 9, "cölour": 2, "Colour": 5},
    {f"word{chr(97 + i)}": 5 for i in range(26)},
    {"same": 1},
    {},
]


@pytest.mark.parametrize("counts", VOCABULARIES)
def test_vocabularies(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in S.variants(df).collect()} == expected(counts)


@settings(max_examples=4, deadline=None)
@given(st.dictionaries(st.text("abà", min_size=1, max_size=5), st.integers(1, 60), max_size=60))
def test_any_small_vocabulary(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in S.variants(df).collect()} == expected(counts)


def test_a_hot_group_makes_no_pairs(spark):
    """Ten thousand words that differ in one place: the rows made stay in proportion to the letters."""
    counts = {"ab" + chr(0x4E00 + i) + "de": 3 + i % 5 for i in range(10_000)}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: r for r in S.near_words(vocab).collect()}
    top = min(counts, key=lambda w: (-counts[w], w))
    second = min((w for w in counts if w != top), key=lambda w: (-counts[w], w))
    assert len(got) == 10_000 and all(r["n_near"] == 9_999 for r in got.values())
    assert all(r["best"]["word"] == (second if w == top else top) for w, r in got.items())


def test_odd_tables(spark):
    rows = [(None, "Words words WORDS"), (1, None), (2, ""), (3, "x" * 200_000 + " words"), (3, "x" * 200_000 + " 12words"), (4, "x" * 200_000), (5, "naïve naïve naïve ÀÉÎ ×÷ƒ"), (6, "😀wordsıwords")]
    docs = spark.createDataFrame([(a, b, "w", 1) for a, b in rows], "doc_id long, text string, word string, n int")
    assert {r["word"]: r["n"] for r in S.vocabulary(docs).collect()} == words_of(rows)
    assert S.vocabulary(docs.limit(0)).count() == 0 and S.variants(S.vocabulary(docs.limit(0))).count() == 0
    assert {r["word"] for r in S.vocabulary(docs, modulus=None, least_count=5).collect()} == {"words"}
    nulls = spark.createDataFrame([(None, 4), ("aword", 4)], "word string, n long")
    assert [r["word"] for r in S.variants(nulls).collect()] == ["aword"]


def test_counts_are_handed_on_in_parts(monkeypatch, spark):
    rows = [(i, f"alpha beta{chr(97 + i % 26)} gamma") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(S, "HELD", 4)
    assert {r["word"]: r["n"] for r in S.vocabulary(docs).collect()} == words_of(rows)
