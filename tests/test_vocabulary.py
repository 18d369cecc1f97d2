"""Normalising, costs and matching, against plain Python and known pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import costs, text
from lodestone.operators import vocabulary
from lodestone.operators.vocabulary import Matcher

GROUPS = ("0OD", "1IL", "8B", "5S", "2Z", "6G", "9Q")


def swap(a: str, b: str) -> int:
    return 0 if a == b else 40 if any(a in g and b in g for g in GROUPS) else 100


def plain_distance(t: str, c: str) -> int:
    """By recursion over all alignments; equal lengths place by place."""
    if len(t) == len(c):
        return sum(map(swap, t, c))

    def go(i: int, j: int) -> int:
        if i == 0 or j == 0:
            return 150 * i + 100 * j
        return min(go(i - 1, j) + 150, go(i, j - 1) + 100, go(i - 1, j - 1) + swap(t[i - 1], c[j - 1]))

    return go(len(t), len(c))


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def spellings(code: str, rng: random.Random) -> list[str]:
    """Ways to write a code that normalising undoes: dashes, white space, case, padding, no dash."""
    prefix, number = code.split("-")
    white = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    out = [f"{prefix}{d}{number}" for d in text.DASHES] + [f"{prefix}-{number.zfill(n)}" for n in range(len(number), 7)]
    out += [prefix + number, prefix + number.zfill(4), code.lower()]
    out += [w + prefix.lower() + w + "-" + number[:1] + w + number[1:] + w for w in white]
    return out + [rng.choice(white).join(rng.choice(out)) for _ in range(5)]


def test_spellings_of_a_code_are_normalised(spark):
    rng = random.Random(11)
    rows = [(raw, code) for code in rng.sample(Matcher().codes, 12) for raw in spellings(code, rng)]
    got = spark.createDataFrame(rows, "raw string, code string").withColumn("n", text.normalize(F.col("raw"))).where("n <> code").collect()
    assert got == [] and one(spark, text.normalize, None) is None


def test_other_texts_only_lose_white_space_and_case(spark):
    rng = random.Random(12)
    raws = ["".join(rng.choices("abXY ?!é#", k=rng.randint(0, 9))) for _ in range(60)] + ["z" + "4" * n for n in (5, 6, 9)]
    got = spark.createDataFrame([(r,) for r in raws], "raw string").select("raw", text.normalize(F.col("raw")).alias("n")).collect()
    assert all(r["n"] == r["raw"].replace(" ", "").upper() for r in got)


def test_valid_codes_are_those_of_the_vocabulary(spark):
    codes = {r["code"] for r in vocabulary.codes(spark).collect()}
    assert len(codes) == 1000
    rng = random.Random(13)
    odd = [change(c) for c in rng.sample(sorted(codes), 20) for change in (str.lower, lambda c: c.replace("-", "-0"), lambda c: c.replace("-", ""), lambda c: c[0] + c, lambda c: c + "\n", lambda c: c[:2] + "x" + c[2:], lambda c: c[:2])]
    tried = [*codes, *(f"{p}-{n}" for p in "ABCDE" for n in range(0, 1005, 7)), *odd, "", None]
    got = spark.createDataFrame([(t,) for t in tried], "c string").select("c", vocabulary.is_valid(F.col("c")).alias("ok")).collect()
    assert all(r["ok"] == (r["c"] in codes) for r in got)


def test_distance_matches_recursion(spark):
    rng = random.Random(1)
    letters = "ABCD-0123456789OILSZGQ"
    pairs = [("".join(rng.choices(letters, k=rng.randint(0, 7))), "".join(rng.choices(letters, k=rng.randint(1, 6)))) for _ in range(300)]
    got = spark.createDataFrame(pairs, "t string, c string").select("t", "c", costs.distance(F.col("t"), F.col("c")).alias("d")).collect()
    assert [r["d"] for r in got] == [plain_distance(t, c) for t, c in pairs]


def test_matcher_against_brute_force():
    own = Matcher()
    rng = random.Random(2)
    for _ in range(60):
        t = list(rng.choice(own.codes))
        for _ in range(rng.randint(1, 2)):
            t[rng.randrange(len(t))] = rng.choice("0123456789OILB-")
        t = "".join(t)
        if t in own.codes:
            continue
        ranked = sorted((plain_distance(t, c), i) for i, c in enumerate(own.codes) if (150 * (len(t) - len(c)) if len(t) > len(c) else 100 * (len(c) - len(t))) <= 225)
        best, second = ranked[0], ranked[1]
        code = own.codes[best[1]]
        expected = code if second[0] - best[0] >= 25 and best[0] <= min(200, 70 * (len(code) - 2)) else None
        assert own.snap(t, 200) == (expected, best[0])


def misread(code: str, rng: random.Random) -> str:
    """A code with one or two mistakes: a confused or other character, one too many or too few."""
    out = list(code)
    for _ in range(rng.randint(1, 2)):
        i = rng.randrange(len(out))
        group = next((g for g in GROUPS if out[i] in g), "?@")
        out[i : i + 1] = rng.choice([[rng.choice(group)], [rng.choice("XR7@")], [out[i], out[i]], []]) if len(out) > 1 else out[i : i + 1]
    return "".join(out)


def test_snapped_texts_against_all_codes(spark):
    rng = random.Random(14)
    own = Matcher()
    reads = {text.normal_form(misread(rng.choice(own.codes), rng)) for _ in range(80)}
    expected = {"": (None, None), None: (None, None)}
    for t in reads - {""}:
        if t in own.codes:
            expected[t] = (t, 0)
            continue
        near = [(c, plain_distance(t, c)) for c in own.codes if (150 * (len(t) - len(c)) if len(t) > len(c) else 100 * (len(c) - len(t))) <= 225]
        (code, best), second = min(near, key=lambda x: x[1]), sorted(d for _, d in near)[1]
        expected[t] = (code if second - best >= 25 and best <= min(200, 70 * (len(code) - 2)) else None, best)
    got = vocabulary.snap(spark.createDataFrame([(t,) for t in expected], "raw string"), "raw").collect()
    assert {r["raw"]: (r["snapped"], r["cost"]) for r in got} == expected
    assert len({code for code, _ in expected.values()}) > 10


@pytest.mark.parametrize("name, error", [("2", None), ("左上角", None), ("  2  ", None), ("x" * 40, None), ("CON.txt", None), ("", "empty"), (" \t", "empty"), ("x" * 41, "long"), ("..", "dots"), ("a/b", "illegal"), ("a\\b", "illegal"), ("a\x01b", "control"), ("Com1", "reserved"), ("nul", "reserved")])
def test_photo_names(spark, name, error):
    assert one(spark, text.name_error, name) == error


@pytest.mark.parametrize("path, stem", [("/a/b.jpg", "b"), ("a.jpg.jpg", "a.jpg"), (".x", ".x"), ("x.", "x."), ("/d.e/f", "f")])
def test_stem(spark, path, stem):
    assert one(spark, text.stem, path) == stem
