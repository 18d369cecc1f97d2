"""Results from detections: passes in order of cost, each only for pieces that the ones before left open."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions.columns import free, let
from ..functions.text import normal_form
from ..schema import DETECTION

PIECE_KEY = ("photo_id", "piece_id")


class Recognizer(Protocol):
    """What reads text from a crop: (text, score, poly or None) for each find. ``read_line(crop)`` may be offered too."""

    def read(self, image: np.ndarray) -> list[tuple[str, float, list[list[int]] | None]]: ...


_loaded: dict[tuple[str, str], Recognizer | None] = {}


def loaded(factory: Callable[[], Recognizer]) -> Recognizer | None:
    """This process's recognizer, made once by a factory of that name; a failure to make it is remembered."""
    key = (factory.__module__, factory.__qualname__)
    if key not in _loaded:
        try:
            _loaded[key] = factory()
        except Exception:  # noqa: BLE001 a recognizer may fail in any way; its pieces stay unread
            _loaded[key] = None
    return _loaded[key]


Find = tuple[str, float, list[list[int]] | None]


def passes(own: Recognizer, image: np.ndarray, matched: Callable[[str], bool], settings: Settings = SETTINGS, everything: bool = False) -> Iterator[tuple[str, int, int, list[Find]]]:
    """(pass, seq, angle, finds) of a crop, read no more often than its result needs.

    A direct read that is sure enough ends it; else the line, if a quad was found, is read in its
    orientations until one is certain, which ends it if sure enough; else the crop is turned until
    a read is certain. ``matched`` tells whether a text has a code. With ``everything`` all reads are
    made. A call that fails finds nothing.
    """
    from .kernels import Sampler, deskew, rotate_expand

    def attempt(call: Callable, *args) -> list[Find]:
        try:
            return list(call(*args))
        except Exception:  # noqa: BLE001 a recognizer may fail in any way
            return []

    def best(found: list[Find]) -> float:
        return max((float(s) for t, s, _ in found if isinstance(t, str) and s >= settings.least_score and matched(t)), default=0.0)

    direct = attempt(own.read, image)
    yield "direct", 0, 0, direct
    sure = best(direct)
    if sure >= settings.enough and not everything:
        return
    quads = [(s, -i, p) for i, (_, s, p) in enumerate(direct) if p]
    if quads and hasattr(own, "read_line"):
        line, top = deskew(image, max(quads)[2], settings), 0.0
        for k, turn in enumerate(settings.orientations):
            found = attempt(lambda im: [(*own.read_line(im), None)], np.ascontiguousarray(line[::-1, ::-1] if turn == 180 else line))
            yield "line", k, turn, found
            top = max(top, best(found))
            if top >= settings.certain and not everything:
                break
        if max(sure, top) >= settings.enough and not everything:
            return
    sampler = Sampler(image, settings.fill)
    for k, angle in enumerate(settings.angles):
        found = attempt(own.read, rotate_expand(image, angle, settings.fill, sampler))
        yield "sweep", k, angle, found
        if best(found) >= settings.certain and not everything:
            return


def finder(factory: Callable[[], Recognizer], settings: Settings = SETTINGS, everything: bool = False) -> Callable[[np.ndarray], list[tuple]]:
    """What gives a crop's finds as DETECTION has them, without the piece's key; for use in a worker."""
    from .vocabulary import Matcher

    own, matcher = loaded(factory), Matcher(settings)
    codes, known = set(matcher.codes), lru_cache(100_000)(lambda t: matcher.snap(t, settings.max_distance)[0] is not None)

    def matched(raw: str) -> bool:
        text = normal_form(raw)
        return text in codes or known(text)

    def finds(image: np.ndarray) -> list[tuple]:
        if own is None:
            return []
        return [(name, seq, angle, i, t, float(s), p) for name, seq, angle, found in passes(own, image, matched, settings, everything) for i, (t, s, p) in enumerate(found) if isinstance(t, str)]

    return finds


def detect(crops: DataFrame, factory: Callable[[], Recognizer], settings: Settings = SETTINGS, everything: bool = False) -> DataFrame:
    """Detections of the passes that each crop (photo_id, piece_id, height, width, data as BGR bytes) needs, or of all.

    The recognizer is made once a process. Where it fails on a crop, the crop has no detections.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finds = finder(factory, settings, everything)
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.itertuples():
                rows.extend((r.photo_id, r.piece_id, *f) for f in finds(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)))
            yield pd.DataFrame(rows, columns=[f.name for f in DETECTION])

    return crops.mapInPandas(run, DETECTION)


#: What a recognizer's JSON holds.
LISTS = ("rec_texts", "rec_scores", "dt_polys")
POLYS = "array<array<array<double>>>"


def payload(frame: DataFrame, json_col: str = "payload") -> DataFrame:
    """``frame`` with det_ord, text, score and poly from a recognizer's JSON, a row for each find: its lists zipped as far as the first two go.

    The lists stand in ``rec_texts``, ``rec_scores`` and ``dt_polys``, at the top or below ``res``;
    texts that are no strings are skipped and points become integers.
    """
    read = F.from_json(json_col, "res struct<rec_texts: array<variant>, rec_scores: array<double>, dt_polys: array<array<array<double>>>>, rec_texts array<variant>, rec_scores array<double>, dt_polys array<array<array<double>>>")

    # The JSON is parsed once a row, not once for each of its finds, and what follows is no loop over its lists.
    parsed, n, at, d = (free(frame, c) for c in ("_parsed", "_n", "_at", "_d"))
    lists = let(read, lambda r: F.struct(*[F.coalesce(r["res"][c], r[c]).alias(c) for c in LISTS]))
    texts, scores, polys = (F.col(f"{parsed}.{c}") for c in LISTS)
    zipped = F.arrays_zip(texts, scores, F.coalesce(polys, F.array().cast(POLYS)))
    found = frame.withColumn(parsed, lists).withColumn(n, F.least(F.size(texts), F.size(scores))).select(*frame.columns, n, F.posexplode(zipped).alias(at, d))
    kept = found.where((F.col(at) < F.col(n)) & (F.schema_of_variant(F.col(d)["rec_texts"]) == "STRING"))
    poly = F.transform(F.col(d)["2"], lambda p: F.transform(p, lambda x: x.cast("int")))
    return kept.select(*frame.columns, F.col(at).alias("det_ord"), F.variant_get(F.col(d)["rec_texts"], "$", "string").alias("text"), F.col(d)["rec_scores"].alias("score"), poly.alias("poly"))


def best_detection(detections: DataFrame, keys: tuple[str, ...] = (*PIECE_KEY, "pass", "seq"), settings: Settings = SETTINGS) -> DataFrame:
    """Of each group, the detection with a ``snapped`` code and the highest score, the first of equals; scores under the least are none."""
    fit = detections.where((F.col("score") >= settings.least_score) & (F.coalesce(F.col("snapped"), F.lit("")) != ""))
    best = fit.groupBy(*keys).agg(F.max_by(F.struct("snapped", "score", "raw_text", "angle"), F.struct("score", -F.col("det_ord"))).alias("b"))
    return best.select(*keys, F.col("b.snapped").alias("code"), F.col("b.score").alias("confidence"), "b.raw_text", "b.angle")


def best_poly(detections: DataFrame, keys: tuple[str, ...] = PIECE_KEY) -> DataFrame:
    """Of each group, the quad of the highest score, the first of equals, whatever its text."""
    some = detections.where("poly IS NOT NULL")
    return some.groupBy(*keys).agg(F.max_by("poly", F.struct("score", -F.col("det_ord"))).alias("poly"))


def swept(best: DataFrame, keys: tuple[str, ...] = PIECE_KEY, settings: Settings = SETTINGS) -> DataFrame:
    """The best of a pass's turns (column ``seq``), taken in order until one is certain; the first of equals.

    That is the first certain turn, where there is one, else the best of all: one aggregate by key.
    """
    top = best.groupBy(*keys).agg(F.max_by(F.struct("code", "confidence", "raw_text", "angle"), _turn(F.col("confidence"), settings)).alias("b"))
    return top.select(*keys, "b.code", "b.confidence", "b.raw_text", "b.angle")


def _turn(score: Column, settings: Settings) -> Column:
    """What orders the turns of a sweep: the first certain one above all, others by their score, then by their place."""
    certain = score >= settings.certain
    return F.struct(certain.alias("certain"), F.when(certain, -F.col("seq")).alias("first"), score.alias("score"), (-F.col("seq")).alias("seq"))


def cascade(pieces: DataFrame, detections: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(photo_id, piece_id, code, confidence, raw_text, method, angle) for each of ``pieces``.

    ``detections`` holds passes direct, line and sweep, with ``snapped`` and ``raw_text``. The
    direct read stands if it is sure enough; else the line read replaces it if better, given a
    quad; if that is not sure enough either, the sweep replaces what there is if better. The
    result may still be unsure, or nothing. Detections are read once and aggregated by piece in
    one exchange, with the best of each pass as one of the aggregates.
    """
    keys = list(PIECE_KEY)
    fit = (F.col("score") >= settings.least_score) & (F.coalesce(F.col("snapped"), F.lit("")) != "")
    within = F.struct(_turn(F.col("score"), settings).alias("turn"), (-F.col("det_ord")).alias("det_ord"))

    def top(name: str) -> Column:
        found = F.struct(F.col("score").alias("confidence"), F.col("snapped").alias("code"), "raw_text", "angle", F.lit(name).alias("method"))
        return F.max_by(found, F.when(fit & (F.col("pass") == name), within)).alias(name)

    quad = F.bool_or((F.col("pass") == "direct") & F.col("poly").isNotNull()).alias("quad")
    joined = pieces.select(*keys).join(detections.groupBy(*keys).agg(top("direct"), top("line"), top("sweep"), quad), keys, "left")
    conf = lambda c: F.coalesce(c["confidence"], F.lit(0.0))
    d, ln, sw = F.col("direct"), F.col("line"), F.col("sweep")
    sure = conf(d) >= settings.enough
    second = F.when(~sure & F.coalesce("quad", F.lit(False)) & (conf(ln) > conf(d)), ln).otherwise(d)
    two = joined.select(*keys, "sweep", second.alias("two"))
    final = F.when((conf(F.col("two")) < settings.enough) & (conf(sw) > conf(F.col("two"))), sw).otherwise(F.col("two"))
    out = two.select(*keys, final.alias("r"))
    r = F.col("r")
    return out.select(*keys, r["code"].alias("code"), conf(r).alias("confidence"), r["raw_text"].alias("raw_text"), F.coalesce(r["method"], F.lit("none")).alias("method"), r["angle"].alias("angle"))
