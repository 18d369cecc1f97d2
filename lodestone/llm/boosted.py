"""A quality classifier: histogram gradient-boosted trees over statistics of whole texts."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import trimmed
from .langid import remainder

#: Characters by kind; a character is of the first kind that fits.
KINDS = ("upper", "letter", "digit", "space", "line", "mark", "shout", "stop", "other")
MARKS, SHOUTS, STOPS = "#*$%&|<>{}[]~^_=+\\/@", "!?", ".,;:'\"()-"
#: The statistics of a text, in the order of statistics().
STATS = (
    "log_chars", "log_words", *(f"{k}_rate" for k in KINDS), "mean_word", "sd_word", "longest_word", "caps_words", "bare_words", "marked_words",
    "distinct_words", "top_word", "same_as_last", "repeated_triples", "repeated_lines", "words_a_line",
)
UPPER, LETTER, SPACE, LINE, MARK, SHOUT = (KINDS.index(k) for k in ("upper", "letter", "space", "line", "mark", "shout"))
#: Code points that are looked at together.
SLICE = 1 << 20


@lru_cache(1)
def _kinds() -> np.ndarray:
    """The kind of each code point."""

    def kind(c: str) -> int:
        if c.isupper():
            return 0
        if c.isalpha():
            return 1
        if c.isdigit():
            return 2
        if c in "\n\r":
            return 4
        return 3 if c.isspace() else 5 if c in MARKS else 6 if c in SHOUTS else 7 if c in STOPS else 8

    return np.fromiter((kind(chr(i)) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    return edges[::2], edges[1::2] - edges[::2]


def _hashes(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the code points of each run."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(lengths.max(), 0x9E3779B97F4A7C15, np.uint64))
    return np.add.reduceat(powers[place] * (points[place + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)), first)


def _again(codes: np.ndarray) -> np.ndarray:
    """Whether each value occurs twice or more."""
    if not len(codes):
        return np.zeros(0, bool)
    codes = pd.factorize(codes)[0]
    return np.bincount(codes)[codes] > 1


def _statistics(texts: list[str]) -> np.ndarray:
    """Statistics of some texts at once: all their characters stand in one array, each text closed by a newline."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes + 1)
    kinds = _kinds()[points]
    made = np.zeros((len(STATS), n))
    by_kind = np.bincount(np.repeat(np.arange(n) * len(KINDS), sizes + 1) + kinds, minlength=n * len(KINDS)).reshape(n, -1)
    by_kind[:, LINE] -= 1
    made[2 : 2 + len(KINDS)] = by_kind.T / np.maximum(sizes, 1)
    spaced = (kinds == SPACE) | (kinds == LINE)
    starts, lengths = _runs(~spaced)
    made[0] = np.log1p(sizes)
    if not len(starts):
        return made.T
    of = np.searchsorted(ends, starts, "right")
    total = np.bincount(of, minlength=n)
    some = np.maximum(total, 1)

    def mean(values: np.ndarray, of: np.ndarray = of, by: np.ndarray = some) -> np.ndarray:
        return np.bincount(of, values, n) / by

    def within(kind: int) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(kinds == kind, dtype=np.int64)])
        return upto[starts + lengths] - upto[starts]

    upper, lower, last = within(UPPER), within(LETTER), kinds[starts + lengths - 1]
    # A word's code tells its text, too, so that what repeats does so within one text.
    codes, distinct = pd.factorize(_hashes(points, starts, lengths))
    codes, distinct = pd.factorize(of * len(distinct) + codes)
    codes, uses, whose = codes.astype(np.int64), np.bincount(codes), np.zeros(len(distinct), np.int64)
    whose[codes] = of
    top, longest = np.zeros(n), np.zeros(n)
    np.maximum.at(top, whose, uses)
    np.maximum.at(longest, of, lengths)
    pairs = pd.factorize(codes[:-1] * len(distinct) + codes[1:])[0].astype(np.int64)
    triple = np.flatnonzero(of[2:] == of[:-2])
    begins, sizes_of = _runs(kinds != LINE)
    full = np.add.reduceat(~spaced, begins, dtype=np.int64) > 0
    begins, sizes_of = begins[full], sizes_of[full]
    home = np.searchsorted(ends, begins, "right")
    lines = np.maximum(np.bincount(home, minlength=n), 1)
    made[1] = np.log1p(total)
    made[2 + len(KINDS) :] = (
        mean(lengths),
        np.sqrt(np.maximum(0, mean(lengths.astype(float) ** 2) - mean(lengths) ** 2)),
        np.log1p(longest),
        mean((lengths > 1) & (upper > 0) & (lower == 0)),
        mean(upper + lower == 0),
        mean((last == MARK) | (last == SHOUT)),
        np.bincount(whose, minlength=n) / some,
        top / some,
        mean(codes[1:] == codes[:-1], of[1:], np.maximum(total - 1, 1)),
        mean(_again((pairs[:-1] * len(distinct) + codes[2:])[triple]), of[:-2][triple], np.maximum(total - 2, 1)),
        mean(_again(home * (1 << 32) + (_hashes(points, begins, sizes_of) >> np.uint64(32)).astype(np.int64)), home, lines),
        np.log1p(total / lines),
    )
    return made.T


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of STATS for each whole text; null texts are empty ones, whose statistics are all 0.

    Words are runs between white space; words and lines are told apart by hashes. Rates are shares
    of characters or of words; a triple is three words in a row, a line what line ends part and
    has a word. Texts go through in slices of about SLICE characters, a longer one alone.
    """
    made, held, size = [np.zeros((0, len(STATS)))], [], 0
    for text in texts:
        if held and size + len(text or "") > SLICE:
            made.append(_statistics(held))
            held, size = [], 0
        held.append(text or "")
        size += len(held[-1])
    if held:
        made.append(_statistics(held))
    return np.concatenate(made)


@dataclass(frozen=True)
class Model:
    """Trees of one depth as arrays: (trees, inner nodes) of features and thresholds, (trees, leaves) of values.

    The children of node i are 2i + 1, where the feature is at most the threshold, and 2i + 2.
    """

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """Log odds of label 1 for rows of statistics, all rows and trees a level at a time."""
        trees, inner = self.feature.shape
        at, tree = np.zeros((len(rows), trees), np.int64), np.arange(trees)
        line = np.arange(len(rows))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            at = 2 * at + 1 + (rows[line, self.feature[tree, at]] > self.threshold[tree, at])
        return self.base + self.value[tree, at - inner].sum(1)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(rows)))


def train(rows: np.ndarray, labels: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Model:
    """Boosted trees for labels 0 and 1 under logistic loss.

    Statistics become at most ``bins`` ranges at their quantiles; a level of a tree is chosen from
    the sums of gradients and curvatures by node, statistic and range. Of equally good splits the
    first counts; a child needs ``least`` of curvature. Without rows, or with labels of one kind,
    every score is near the labels' smoothed share (0.5 without rows).
    """
    labels = labels.astype(np.float64)
    order = np.lexsort([labels, *rows.T[::-1]]) if len(rows) else np.arange(0)
    rows, labels = rows[order], labels[order]
    inner, width = (1 << depth) - 1, rows.shape[1]
    share = (labels.sum() + 1) / (len(labels) + 2)
    base = float(np.log(share / (1 - share)))
    if not len(rows) or labels.min() == labels.max():
        trees = 0
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)] if trees else []
    ranges = np.stack([np.searchsorted(e, rows[:, f]) for f, e in enumerate(edges)], 1) if trees else np.zeros((0, width), np.int64)
    flat = np.arange(width) * bins + ranges
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    margin = np.full(len(rows), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = p - labels, p * (1 - p)
        at = np.zeros(len(rows), np.int64)
        for level in range(depth):
            nodes, first = 1 << level, (1 << level) - 1
            key = (((at - first) * width * bins)[:, None] + flat).ravel()
            sums = [np.bincount(key, np.repeat(v, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(2) for v in (slope, curve)]
            (left, low), (all_, mass) = sums, [s[:, :, -1:] for s in sums]
            gain = left**2 / (low + l2) + (all_ - left) ** 2 / (mass - low + l2) - all_**2 / (mass + l2)
            gain[(low < least) | (mass - low < least)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for node, (f, b) in enumerate(zip(best // bins, best % bins, strict=True)):
                if gain[node, f, b] > 1e-9:
                    feature[t, first + node], threshold[t, first + node] = f, edges[f][b]
            at = 2 * at + 1 + (rows[np.arange(len(rows)), feature[t, at]] > threshold[t, at])
        leaf = at - inner
        value[t] = -rate * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, curve, inner + 1) + l2)
        margin += value[t][leaf]
    return Model(base, feature, threshold, value)


def measured(text: Column) -> Column:
    """statistics() of a text column as an array of doubles."""

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from trimmed(pd.Series(list(statistics(texts.tolist())), dtype=object) for texts in batches)

    return of(text)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = 1 << 16, **options) -> Model:
    """A model from a bounded sample of labelled documents.

    The bound: about ``rows`` ids, those of least hash, chosen among all with a label of 0 or 1.
    Several labels of one id count as their majority, 1 in a tie; of several documents of one id
    the one with the least statistics counts. Null ids and other labels are not used. Only ids,
    labels and statistics of the sample, no texts, reach the driver, which grows the trees; the
    ids are small enough to be broadcast.
    """
    label = F.col(label_col).cast("double")
    known = labels.where(label.isin(0.0, 1.0) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label) >= 0.5).cast("double").alias("label"))
    spot = F.xxhash64(F.col("id").cast("string")).bitwiseAND(F.lit((1 << 32) - 1)) / F.lit(float(1 << 32))
    chosen = known.where(spot < F.lit(min(1.0, rows / max(1, known.count()))))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    found = texts.select("id", "label", measured(F.col("text")).alias("stats")).groupBy("id", "label").agg(F.min("stats").alias("stats")).select("label", "stats").toArrow()
    stats = found["stats"].combine_chunks().flatten().to_numpy() if len(found) else np.zeros(0)
    return train(stats.reshape(len(found), len(STATS)), found["label"].to_numpy(), **options)


def score(text: Column, model: Model) -> Column:
    """The probability of label 1 of each whole text, from 0 to 1; null texts count as empty ones."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from trimmed(pd.Series(model.scores(statistics(texts.tolist()))) for texts in batches)

    return of(text)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 11 over all of ``documents``: learns from two folds of three, scores all rows.

    A null doc_id is in no fold: it is not held out and has no label.
    """
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.coalesce(remainder(F.col("doc_id"), 3), F.lit(-1))
    model = fit(docs, labels.where(fold != 1))
    found = docs.select("doc_id", (fold == 1).alias("held_out"), score(F.col("text"), model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
