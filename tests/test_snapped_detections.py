"""Recognition queries over detections that are matched to the nearest code, against plain Python."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestone import adapters as A
from lodestone import queries as Q
from lodestone.functions.text import normalize
from lodestone.operators.vocabulary import Matcher


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Events of all eleven kinds, A-10 read as A-IO among them, and their detections with codes by brute force."""
    folder = str(tmp_path_factory.mktemp("reads"))
    ids = [*range(0, 120), *range(995, 1010), 9 + 1000 * 3, 9 + 1000 * 7]
    pq.write_table(pa.table({"event_id": pa.array(ids, pa.int64()), "user_id": pa.array([i % 60 for i in ids], pa.int64())}), f"{folder}/events.parquet")
    rows = [r.asDict() for r in A.detections(spark, folder).withColumn("t", normalize(A.F.col("raw_text"))).collect()]
    own = Matcher()
    codes = set(own.codes)
    for r in rows:
        costs = sorted((cost, code) for n in own.by_length for code, cost in zip((own.codes[i] for i in own.by_length[n][0]), own.costs(r["t"], n).tolist(), strict=True)) if r["t"] else []
        fits = bool(costs) and costs[1][0] - costs[0][0] >= 25 and costs[0][0] <= min(200, 70 * (len(costs[0][1]) - 2))
        r["code"] = r["t"] if r["t"] in codes else costs[0][1] if fits else None
    return folder, rows


def best(rows):
    fit = [r for r in rows if r["code"] and r["score"] >= 0.35]
    return max(fit, key=lambda r: (r["score"], -r["det_ord"])) if fit else None


def swept(rows):
    top = None
    for seq in sorted({r["seq"] for r in rows}):
        b = best([r for r in rows if r["seq"] == seq])
        if b and (top is None or b["score"] > top["score"]):
            top = b
        if b and b["score"] >= 0.99:
            break
    return top


def by_piece(rows, name):
    out = {}
    for r in rows:
        if r["pass"] == name:
            out.setdefault((r["photo_id"], r["piece_id"]), []).append(r)
    return out


def shown(b):
    return b and (b["code"], b["score"], b["raw_text"])


def test_misread_codes_are_snapped(spark, data):
    folder, rows = data
    misread = {r["raw_text"] for r in rows if r["code"] and r["code"] != r["t"]}
    assert {r["code"] for r in rows if r["raw_text"] == "A-IO"} == {"A-10"} and len(misread) > 5


@pytest.mark.parametrize(("query", "name", "pick"), [("best_detection", "direct", best), ("line_sweep", "line", swept), ("angle_sweep", "sweep", swept)])
def test_passes(spark, data, query, name, pick):
    folder, rows = data
    expected = {k: shown(pick(v)) for k, v in by_piece(rows, name).items() if pick(v)}
    got = {(r["photo_id"], r["piece_id"]): (r["code"], r["confidence"], r["raw_text"]) for r in Q.QUERIES[query](spark, folder).collect()}
    assert got == expected


def test_cascade(spark, data):
    folder, rows = data
    direct, line, sweep = (by_piece(rows, n) for n in ("direct", "line", "sweep"))
    expected = {}
    for k in direct:
        now, method = best(direct[k]), "direct"
        score = lambda b: b["score"] if b else 0.0
        if score(now) < 0.9:
            other = swept(line[k])
            if any(r["poly"] for r in direct[k]) and score(other) > score(now):
                now, method = other, "line"
            other = swept(sweep[k])
            if score(now) < 0.9 and score(other) > score(now):
                now, method = other, "sweep"
        expected[k] = (now and now["code"], score(now), now and now["raw_text"], method if now else "none")
    got = {(r["photo_id"], r["piece_id"]): (r["code"], r["confidence"], r["raw_text"], r["method"]) for r in Q.QUERIES["cascade"](spark, folder).collect()}
    assert got == expected
