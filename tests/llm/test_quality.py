"""Quality: statistics against plain Python, determinants against numpy, small and odd groups."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import quality as Q

WORD = re.compile("[^\x20\x09-\x0d]+")
KIND = "doc_id long, text string, lang string, source string, n_words string"


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    runs = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for i in range(len(w) - 2):
        if runs[w[i], w[i + 1], w[i + 2]] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_statistics(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "a", "a a a", "a a a a", "x y z x y z", "l\nl\n\n \nl\r\nm", "#*$ %&|<> é　\xa0", " ".join(f"w{i % 4000}" for i in range(30_000)), "ab " * 20_000]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "é#", "\t", "\x0b", "d e f "]) for _ in range(rng.randint(0, 150))) for _ in range(150)]
    rows = spark.createDataFrame([(i, t, None, None, "clash") for i, t in enumerate(texts)], KIND)
    got = {r["doc_id"]: tuple(r["_quality"][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in Q.measure(rows).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_very_many_words_take_the_other_path(spark, monkeypatch):
    monkeypatch.setattr(Q, "PLACE_BITS", 4)
    texts = ["a b c " * 9, "a b c d a b c", " ".join(f"w{i % 29}" for i in range(80))]
    got = [r["_quality"]["n_repeat_words"] for r in Q.measure(spark.createDataFrame([(i, t, None, None, "") for i, t in enumerate(texts)], KIND)).orderBy("doc_id").collect()]
    assert got == [plain(t)[4] for t in texts]


def test_chi_squared():
    assert abs(Q.chi2_quantile(0.975, 5) - 12.8325) < 1e-3 and abs(Q.chi2_cdf(7.0, 7) - 0.5711) < 1e-3


def vectors(texts):
    out = []
    for t in texts:
        n, c, s, d, r, _ = plain(t)
        lines = len([x for x in t.split("\n") if WORD.search(x)])
        out.append([np.log(n), np.log(c / n), np.sqrt(s / n), np.sqrt(d / lines), np.sqrt(r / n)])
    return np.array(out)


def brute(x, share=0.75, steps=4):
    """The same estimates in numpy."""
    floors = np.diag(np.square(Q.FLOORS))
    mid = lambda a: np.sort(a, 0)[(len(a) + 1) // 2 - 1]
    m = mid(x)
    s = np.diag((1.4826 * mid(abs(x - m))) ** 2) + floors
    dist = lambda: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
    for _ in range(steps):
        step = np.floor(Q.STEPS * np.log2(dist() + 1e-3))
        counts = sorted(Counter(step).items())
        total, last = 0, None
        for value, c in counts:
            if total < np.ceil(share * len(x)):
                last = value
            total += c
        part = x[step <= last]
        m, s = part.mean(0), share / Q.chi2_cdf(Q.chi2_quantile(share, 5), 7) * np.cov(part.T, bias=True) + floors
    part = x[dist() <= Q.chi2_quantile(0.975, 5)]
    m, s = part.mean(0), 0.975 / Q.chi2_cdf(Q.chi2_quantile(0.975, 5), 7) * np.cov(part.T, bias=True) + floors
    return dist()


def test_outliers_against_numpy(spark):
    rng = random.Random(2)
    texts = []
    for i in range(240):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(rng.randint(60, 400))]
        if i % 8 == 0:
            words = [w + rng.choice(["###", "$$$"]) for w in words]
        texts.append(" ".join(w + ("\n" if rng.random() < 0.1 else "") for w in words))
    rows = spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", "") for i, t in enumerate(texts)], KIND)
    kept = {r["doc_id"]: r["_kept"] for r in Q.judge(Q.measure(rows)).collect()}
    cut = Q.chi2_quantile(1 - 1e-9, 5)
    for k in (0, 1):
        ids = [i for i in range(240) if i % 2 == k]
        d = brute(vectors([texts[i] for i in ids]))
        assert all(kept[i] == (v <= cut) for i, v in zip(ids, d, strict=True) if abs(v - cut) > 0.01 * cut)
    assert not any(kept[i] for i in range(0, 240, 8)) and sum(kept.values()) >= 205


def test_small_groups_base_failures_and_empty_tables(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good, None, None, ""), (1, good, None, None, ""), (2, None, "en", "a", ""), (3, "short", "en", "a", ""), (4, good, "xx", '{"}', "")]
    got = Q.judge(Q.measure(spark.createDataFrame(rows, KIND)))
    assert sorted((r["doc_id"], r["_kept"]) for r in got.collect()) == [(1, True), (1, True), (2, False), (3, False), (4, True)]
    assert "n_words" in got.columns
    assert Q.judge(Q.measure(spark.createDataFrame([], KIND))).count() == 0
    assert Q.judge(Q.measure(spark.createDataFrame(rows[2:4], KIND))).where(F.col("_kept")).count() == 0
