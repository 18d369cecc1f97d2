"""SimHash: fingerprints, covering masks, links and groups against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
import xxhash

from lodestone.llm import simhash as S

KIND = "doc_id long, text string, fp string, component string"


def plain(text, width=3):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_set_of_bits(radius):
    masks = S.covering_masks(radius)
    rng = random.Random(radius)
    sets = combinations(range(64), radius) if radius < 3 else (rng.sample(range(64), 3) for _ in range(5000))
    assert len(masks) == 2 ** (radius + 1) - 1
    assert all(any(not any(m >> b & 1 for b in bits) for m in masks) for bits in sets)
    assert all(30 <= m.bit_count() <= 48 for m in masks)


def grouped(rows):
    """Smallest id reachable over links of two bits or fewer, by comparing all pairs."""
    fps = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if find(k) == find(i) and d is not None]
        out.append((doc, f"{fps[i]:016x}", min(ids) if ids else None))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], KIND)
    got = [(r["id"], r["fp"], r["component"]) for r in S.near_copies(docs).withColumn("fp", S.hex16(S.F.col("fp"))).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(grouped(rows), key=key)


def test_groups_against_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(400)]
    rows = []
    for i in range(120):
        w = list(base) if i % 3 else [f"w{rng.randrange(3000)}" for _ in range(60)]
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"new{rng.randrange(9)}"
        rows.append((1000 - i, " ".join(w)))
    check(spark, rows)


def test_nulls_blanks_repeats_and_long_texts(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    check(spark, [(5, None), (4, ""), (9, " \t\n"), (7, "one"), (7, "one"), (3, "One"), (None, "two words"), (None, None), (2, "É é \x0b a"), (1, "　a b"), (8, long), (6, long)])
    check(spark, [(None, "x y z"), (None, "x y z")])
    empty = S.near_copies(spark.createDataFrame([], KIND))
    assert empty.count() == 0


def test_links_over_chains_and_stars(spark):
    chain = [1 << i for i in range(0, 64)]
    fps = [0, *chain, *[a | b for a, b in zip(chain, chain[1:], strict=False)], 0x7777777777777777]
    got = S.components(S.links(spark.createDataFrame([(S._signed(f),) for f in fps], "fp long"))).collect()
    linked = {f for f in fps for g in fps if f != g and (f ^ g).bit_count() <= 2}
    assert {r["node"] & (1 << 64) - 1 for r in got} == linked
    assert len({r["root"] for r in got}) == 1
    with pytest.raises(ValueError):
        S.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_components_of_a_long_path(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.sql("SELECT 500L AS a, 500L AS b UNION ALL SELECT 600L, 601L UNION ALL SELECT 601L, 600L"))
    got = {r["node"]: r["root"] for r in S.components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 600: 600, 601: 600}


def test_one_of_each_keeps_columns_and_the_smallest(spark):
    docs = spark.createDataFrame([(3, "a b c d", "p", "q"), (1, "a b c d", "r", "s"), (1, "a b c d", "r", "s"), (None, "e f g h", "t", "u"), (9, None, None, None)], KIND)
    got = S.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["fp"] or "") for r in got.collect()) == [(0, "t"), (1, "r"), (9, "")]


def test_similar_texts_of_any_likeness(spark):
    """Pairs well over the likeness go to one group, pairs under it never do, however near their fingerprints."""
    rng = random.Random(9)
    rows, groups = [], {}
    for g in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(400)]
        for c in range(3):
            w = list(base)
            for _ in range((0, 3, 5)[c]):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(w), "x", "y"))
            groups.setdefault(g, []).append(len(rows) - 1)
        shuffled = list(base)
        rng.shuffle(shuffled)
        rows.append((len(rows), " ".join(shuffled), "x", "y"))
        groups[f"s{g}"] = [len(rows) - 1]
    docs = spark.createDataFrame(rows, KIND)
    kept = {r["doc_id"] for r in S.one_of_each(docs).collect()}
    assert all(min(ids) in kept for ids in groups.values())
    assert len(kept) <= len(groups) + 3


def test_one_of_each_is_exact(spark):
    """Groups linked by pairs of a likeness of 0.8 or more, as brute force over all pairs finds them, around a passage that half of the texts share."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for g in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((8, 50, 120)))]
        base = base + passage if g % 2 else base
        for c in range(6):
            w = list(base)
            for _ in range(rng.randrange(len(w) // 20 + 1) if c else 0):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(w), "x", "y"))
    rows += [(len(rows), None, "x", "y"), (len(rows) + 1, " ", "x", "y")]
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in ((r[1] or "") for r in rows)]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        union = len(sets[i] | sets[j])
        if 5 * len(sets[i] & sets[j]) >= 4 * union:
            x, y = sorted((top(i), top(j)))
            root[y] = x
    kept = {r["doc_id"] for r in S.one_of_each(spark.createDataFrame(rows, KIND)).collect()}
    assert kept == {top(i) for i in range(len(rows))}
    assert len(kept) < 300


def test_fingerprints_give_candidates(spark):
    """Texts near by their fingerprints are held against each other exactly, whatever their bands."""
    base = [f"w{i}" for i in range(3000)]
    other = [f"v{i}" for i in range(3000)]
    rows = [(1, " ".join(base), "x", "y"), (2, " ".join([*base, "end"]), "x", "y"), (3, " ".join(other), "x", "y"), (4, None, "x", "y")]
    fps = S.simhashes(iter(r[1] for r in rows), 3, 42).tolist()
    assert (fps[0] ^ fps[1]).bit_count() <= 2 < (fps[0] ^ fps[2]).bit_count()
    nodes = spark.createDataFrame([(i, 5 if f else 0, [], S._signed(f)) for i, f in enumerate(fps)], "node long, n int, keys array<long>, fp long")
    keys = {r["node"]: r["keys"] for r in S.with_fingerprints(nodes).collect()}
    assert keys[0] == keys[1] != keys[2] and len(keys[2]) == 1 and keys[3] == []
    assert {r["doc_id"] for r in S.one_of_each(spark.createDataFrame(rows, KIND)).collect()} == {1, 3, 4}
