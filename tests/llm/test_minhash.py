"""One-permutation MinHash: likeness, determinism, densification and the next document."""

from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import minhash as M


def jaccard(a, b, width=5):
    def of(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    a, b = of(a), of(b)
    return len(a & b) / max(1, len(a | b))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(order):
        t, n = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        out.append((doc, len(t), t[: len(t) - half] + n[:half]))
    return out


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_next_and_edited_text(spark, buckets, monkeypatch):
    rng = random.Random(buckets)
    rows = [(i * i, " ".join(rng.choices(["ä", "🙂b", "ccc", "\n", "d"], k=rng.randint(0, 40)))) for i in range(60)] + [(7, None), (-5, ""), (None, "null id"), (10**12, "far")]
    spark.conf.set("spark.sql.shuffle.partitions", str(buckets))
    got = M.compare_next(docs(spark, rows)).select("id", "n_chars", "edited").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows), key=key)


def test_one_row_and_none(spark):
    assert M.compare_next(docs(spark, [(3, "a b")])).select("id", "edited", "near_next").collect() == [(3, "a a", 1.0)]
    assert M.compare_next(docs(spark, [])).count() == 0
    assert M.compare_next(docs(spark, [(None, None)])).select("n_chars", "edited").collect() == [(0, "")]


def test_likeness_follows_jaccard(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 40, 300, 1500]))]
        v = list(w)
        for _ in range(len(v) * (i % 10) // 60):
            v[rng.randrange(len(v))] = "x" + str(rng.random())
        rows.append((i, " ".join(w), " ".join(v)))
    table = spark.createDataFrame(rows, "i int, a string, b string")
    near = {r["i"]: r["n"] for r in table.select("i", M.likeness(M.codes(F.col("a")), M.codes(F.col("b"))).alias("n")).collect()}
    off = [near[i] - jaccard(a, b) for i, a, b in rows]
    assert max(map(abs, off)) < 0.16 and abs(sum(off) / len(off)) < 0.015


def test_fingerprints_depend_on_the_words_alone(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    values = ["", None, " ", "a", "A", "a  b", "a\tb", "a b c d e f", long, long]
    codes = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(M.packed(M.codes(F.col("v")))).collect()]
    assert all(len(c) == 2 * M.BINS and set(c) <= set("0123456789abcdef") for c in codes)
    assert codes[0] == codes[1] == codes[2] == "00" * M.BINS
    assert codes[3] == codes[4] and codes[5] == codes[6] and codes[8] == codes[9] and len(set(codes)) == 5


def slow_fingerprint(text, width=5, seed=42):
    """The fingerprint in plain Python, every bin on its own."""

    def long_hash(values, last=42):
        for v in values:
            last = xxhash.xxh64_intdigest(v, last)
        return last

    number = lambda x, size=8: (x & (1 << 8 * size) - 1).to_bytes(size, "little")
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    w = [long_hash([x.encode(), number(seed, 4)]) for x in lower.split(" ") if x]
    if not w:
        return "00" * M.BINS
    runs = [long_hash(map(number, w[i : i + width])) for i in range(len(w) - width + 1)]
    if not runs:
        acc = seed
        for x in w:
            acc = long_hash([number(acc), number(x)])
        runs = [acc]
    bins = {}
    for h in runs:
        bins[h >> 56] = min(h, bins.get(h >> 56, h))
    out = []
    for b in range(M.BINS):
        order = [t[b] for t in M._probes() if t[b] in bins]
        if b in bins:
            from_ = b
        elif order:
            from_ = order[0]
        else:
            spot = lambda j: (j + 128) % 256
            signed = lambda x: x - (1 << 64) if x >> 63 else x
            rank = {signed((long_hash([number(spot(j), 4), number(b, 4)]) << 8 & (1 << 64) - 1) | spot(j)): j for j in bins}
            from_ = rank[min(rank)]
        out.append(bins[from_] & 255)
    return bytes(out).hex()


def test_against_plain_python(spark):
    rng = random.Random(9)
    values = [" ".join(rng.choices([f"W{i}" for i in range(3000)], k=n)) for n in (1, 2, 4, 5, 6, 7, 9, 12, 20, 33, 60, 120, 300, 900, 4000)] + [None, "", "\x0b \t", "a\x0bB\nc  d é Ü 🙂 g", "x " * 500]
    table = spark.createDataFrame(list(enumerate(values)), "i int, v string").withColumn("c", M.codes(F.col("v")))
    got = {r["i"]: r["p"] for r in table.select("i", M.packed(F.col("c")).alias("p")).collect()}
    assert got == {i: slow_fingerprint(v) for i, v in enumerate(values)}
    pairs = table.select("i", "c").crossJoin(table.select(F.col("i").alias("j"), F.col("c").alias("d"))).select("i", "j", M.likeness(F.col("c"), F.col("d")).alias("n"))
    for r in pairs.collect():
        a, b = (bytes.fromhex(got[r[k]]) for k in "ij")
        same = sum(x == y for x, y in zip(a, b, strict=True)) / M.BINS
        assert abs(r["n"] - max(0.0, (same - 1 / 256) / (1 - 1 / 256))) < 1e-12


def test_clashing_names_stay(spark):
    rows = spark.createDataFrame([(1, "a b", 5, 6, 7), (2, "c d", 8, 9, 10)], "doc_id long, text string, _slot int, _to int, _some int")
    got = M.with_next(rows, "doc_id", ["text"])
    assert got.columns == [*rows.columns, "next_text"]
    assert sorted(map(tuple, got.collect())) == [(1, "a b", 5, 6, 7, "c d"), (2, "c d", 8, 9, 10, "a b")]
