"""Reading a crop no more often than its result needs, and the one-pass cascade over what was read."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.config import SETTINGS
from lodestone.functions.text import normal_form, normalize
from lodestone.operators import recognize
from lodestone.operators.vocabulary import Matcher, snap

QUAD = [[2, 2], [30, 2], [30, 10], [2, 10]]


class Scripted:
    """Reads what it is told, call by call, and counts its calls."""

    def __init__(self, reads, lines=None):
        self.reads, self.lines, self.calls = list(reads), list(lines or ()), []
        if lines is not None:
            self.read_line = self._line

    def read(self, image):
        self.calls.append("read")
        return self.reads.pop(0) if self.reads else []

    def _line(self, image):
        self.calls.append("line")
        return self.lines.pop(0)


def tried(own, everything=False):
    matcher = Matcher()
    matched = lambda raw: normal_form(raw) in set(matcher.codes) or matcher.snap(normal_form(raw), SETTINGS.max_distance)[0] is not None
    return [(name, seq) for name, seq, _, _ in recognize.passes(own, np.zeros((40, 40, 3), np.uint8), matched, everything=everything)]


def test_a_sure_direct_read_is_one_call():
    own = Scripted([[("b-300", 0.95, QUAD)]], [("b-300", 0.99)])
    assert tried(own) == [("direct", 0)] and own.calls == ["read"]


def test_a_good_line_is_three_calls_at_most():
    own = Scripted([[("b-300", 0.5, QUAD)]], [("x", 0.99), ("b-301", 0.92)])
    assert tried(own) == [("direct", 0), ("line", 0), ("line", 1)] and own.calls == ["read", "line", "line"]
    own = Scripted([[("b-300", 0.5, QUAD)]], [("b-301", 0.995), ("b-302", 0.9)])
    assert tried(own) == [("direct", 0), ("line", 0)]


def test_turns_end_with_a_certain_one():
    own = Scripted([[("?", 0.99, None)], [], [("c-600", 0.95, None)], [("c-601", 0.99, None)]])
    assert tried(own) == [("direct", 0), ("sweep", 0), ("sweep", 1), ("sweep", 2)]
    assert len(tried(Scripted([[("b-300", 0.95, QUAD)]], [("x", 0.1)] * 2), everything=True)) == 3 + len(SETTINGS.angles)


def test_a_recognizer_that_fails_finds_nothing():
    class Broken:
        def read(self, image):
            raise RuntimeError

    assert len(tried(Broken())) == 1 + len(SETTINGS.angles)


@pytest.mark.parametrize("seed", range(3))
def test_early_exits_lose_no_result(spark, seed):
    rng = np.random.default_rng(seed)
    score = lambda: float(rng.choice([0.2, 0.5, 0.9, 0.95, 0.99, 1.0]))
    text = lambda: str(rng.choice(["b-300", "B-3O1", "c-700", "??", "A-IO"]))
    rows = {False: [], True: []}
    for piece in range(40):
        reads = [[(text(), score(), QUAD if rng.random() < 0.5 else None) for _ in range(rng.integers(0, 3))] for _ in range(1 + len(SETTINGS.angles))]
        lines = [(text(), score()) for _ in SETTINGS.orientations]
        matcher = Matcher()
        matched = lambda raw: normal_form(raw) in set(matcher.codes) or matcher.snap(normal_form(raw), SETTINGS.max_distance)[0] is not None  # noqa: E731, B023
        for everything in rows:
            by_angle = Scripted(reads, lines)
            # What a turn finds depends on its angle, not on how many calls came before.
            turns = iter(reads[1:])
            for name, seq, angle, _ in recognize.passes(by_angle, np.zeros((40, 40, 3), np.uint8), matched, everything=everything):
                found = reads[0] if name == "direct" else [(*lines[seq], None)] if name == "line" else next(turns)
                rows[everything] += [("p", piece, name, seq, angle, i, t, s, p) for i, (t, s, p) in enumerate(found)]
    pieces = spark.range(40).select(F.lit("p").alias("photo_id"), F.col("id").alias("piece_id"))
    kind = "photo_id string, piece_id long, pass string, seq int, angle int, det_ord int, raw_text string, score double, poly array<array<int>>"
    got = [sorted(map(tuple, recognize.cascade(pieces, snap(spark.createDataFrame(r, kind), "raw_text")).collect())) for r in rows.values()]
    assert got[0] == got[1] and len(rows[False]) < len(rows[True])


def test_normal_form_equals_the_column(spark):
    values = ["b 403", " a–0012 ", "A1", "a-IO", "ß1", "x　7", "12345", "A-00", "", "d_9", " c− 08"]
    table = spark.createDataFrame([(v,) for v in values], "v string").select("v", normalize(F.col("v")).alias("n"))
    assert {r["v"]: r["n"] for r in table.collect()} == {v: normal_form(v) for v in values}
