"""Language models: exact code lengths against a plain count, accuracy on what was held out."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid as L

TEXTS = {"aa": ["abracadabra", "aaa bbb"], "bb": ["the cat é sat", "on\nthe mat", ""]}


def plain_bits(texts, data, order):
    """Code length by walking each byte's contexts."""
    counts = defaultdict(Counter)
    for t in texts:
        b = L.START * order + t.encode()
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[b[i - k : i]][b[i]] += 1
    total, b = 0.0, L.START * order + data
    for i in range(order, len(b)):
        p = 1 / 256
        for k in range(order + 1):
            c = counts[b[i - k : i]]
            n, d = sum(c.values()), len(c)
            if n:
                p = c[b[i]] / (n + d) if b[i] in c else p * d / (n + d)
        total -= math.log2(p)
    return total


@pytest.mark.parametrize("table_mb", [0, 64])
@pytest.mark.parametrize("order", [1, 2, 3])
def test_code_lengths(order, table_mb, monkeypatch):
    model = L.train(TEXTS, order, table_mb)
    assert isinstance(L.Coder(model).costs, L.Dense if table_mb else L.Sparse)
    data = [b"", b"abra", "the é mat".encode(), bytes(range(256)), b"zz the cat" * 3]
    got = L.Coder(model).lengths(data)
    for i, d in enumerate(data):
        for j, lang in enumerate(model.languages):
            assert got[i, j] == pytest.approx(plain_bits(TEXTS[lang], d, order), rel=1e-5, abs=1e-6)
    monkeypatch.setattr(L, "CHUNK", 7)
    assert L.Coder(model).lengths(data) == pytest.approx(got, rel=1e-6)


def test_many_languages_without_a_table_lose_no_context():
    texts = {f"l{i:02}": [f"{chr(97 + i % 26)}{chr(98 + i % 7)} the {i * 37} cat" * 3, chr(200 + i) * 4] for i in range(40)}
    data = [b"the cat 37", "ÈÉ ab".encode(), texts["l07"][0].encode()]
    small, large = (L.Coder(L.train(texts, 3, mb)).lengths(data) for mb in (0, 512))
    assert small == pytest.approx(large, rel=1e-4)
    assert small[2].argmin() == 7


def test_the_sample_is_bounded_in_bytes(spark):
    rows = [(i, f"{i} " + "abc " * 5000, "aa", None) for i in range(60)] + [(100 + i, f"xyz {i}", "bb", None) for i in range(60)]
    model = L.fit(docs(spark, rows), total_mb=1, order=1)
    seen = {lang: int(of[0][1].sum()) for lang, of in zip(model.languages, model.counts, strict=True)}
    assert 0 < seen["aa"] < 1.5 * (1 << 19) and seen["bb"] == sum(len(f"xyz {i}") for i in range(60))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_nulls_blanks_and_no_training(spark):
    rows = [(i, t, lang, "x") for i, (lang, t) in enumerate([("aa", "abra abra"), ("bb", "the cat"), ("bb", None), (None, "abra"), ("aa", ""), ("aa", "12 !?")])] + [(None, "the mat", "bb", None)]
    model = L.fit(docs(spark, rows), order=2)
    got = docs(spark, rows).select("doc_id", L.predict(F.col("text"), model).alias("p")).collect()
    assert {r["doc_id"]: r["p"]["lang"] for r in got} == {0: "aa", 1: "bb", 2: "und", 3: "aa", 4: "und", 5: "und", None: "bb"}
    assert all(0 <= r["p"]["score"] <= 1 for r in got)
    none = L.fit(docs(spark, []))
    assert none.languages == () and docs(spark, rows).select(L.predict(F.col("text"), none).alias("p")).where("p.lang <> 'und'").count() == 0
    assert L.fit(docs(spark, [(1, "x", None, None)])).languages == ()


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{data}/documents.parquet'").fetchall())
    rows = L.op8_langid(spark, data).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows) and len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.98 * len(held) > 100


def test_all_languages_are_learned_whatever_their_number_and_length(spark):
    """Three hundred languages, each of words of its own, one with long texts only, one in one row of many."""
    import random

    some = random.Random(11)
    words = {f"l{k:03}": ["".join(some.choices("abcdefghijklmnopqrstuvwxyzäöüéñ", k=6)) for _ in range(12)] for k in range(300)}
    say = lambda lang, n: " ".join(some.choices(words[lang], k=n))
    rows = [(k * 10 + i, say(lang, 40), lang, None) for k, lang in enumerate(words) for i in range(2 if k != 7 else 0)]
    rows += [(5000 + i, say("l007", 12_000), "l007", None) for i in range(3)] + [(9000, "zyzzy qwqwq zyzzy qwqwq", "only", None)]
    model = L.fit(docs(spark, rows), order=2)
    assert set(model.languages) == {*words, "only"}
    asked = [(k, say(lang, 25), lang, None) for k, lang in enumerate(words)] + [(999, "qwqwq zyzzy qwqwq", "only", None)]
    got = docs(spark, asked).select("lang", L.predict(F.col("text"), model).alias("p")).collect()
    assert all(r["p"]["lang"] == r["lang"] for r in got) and len(got) == 301


def test_a_language_has_a_text_in_the_sample_even_if_none_is_chosen(spark):
    rows = [(i, "abc def " * 200, "aa", None) for i in range(40)] + [(100 + i, f"xyz {i} uvw " * 300, "bb", None) for i in range(40)] + [(500, "", "cc", None)]
    model = L.fit(docs(spark, rows), total_mb=0, order=1)
    assert {"aa", "bb"} <= set(model.languages)


def test_tables_are_made_in_their_place_and_texts_scored_in_small_parts():
    """Copies of the whole table, and of costs of half a million bytes at once, took several times what a worker keeps."""
    import tracemalloc

    import numpy as np

    some = np.random.default_rng(5)
    model = L.train({lang: [some.integers(97, 123, 30_000, np.uint8).tobytes().decode()] for lang in ("aa", "bb", "cc", "dd")})
    tracemalloc.start()
    try:
        own = L.Coder(model)
        table = own.costs.cost.nbytes + own.costs.place.nbytes
        assert isinstance(own.costs, L.Dense) and tracemalloc.get_traced_memory()[1] < 2 * table
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        own.lengths([b"abcdefgh" * 1000] * 200)
        assert tracemalloc.get_traced_memory()[1] - before < 20 << 20
    finally:
        tracemalloc.stop()


def test_a_worker_never_holds_the_tables_of_two_models(monkeypatch):
    import gc
    import weakref

    alive = []

    class Watched(L.Coder):
        def __init__(self, model):
            gc.collect()
            alive.append(sum(r() is not None for r in made))
            super().__init__(model)
            made.append(weakref.ref(self))

    made = []
    monkeypatch.setattr(L, "Coder", Watched)
    first, second = L.train(TEXTS, 2), L.train(TEXTS, 1)
    assert L.coder(first) is L.coder(first)
    L.coder(second)
    assert alive == [0, 0]
