"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import trimmed

UNKNOWN = "und"
#: Stands before every text, so that its first bytes have contexts too.
START = b"\n"
#: Bytes scored at once for up to four languages, and texts held as bytes at once.
CHUNK = 1 << 17
SLICE = 256
LETTER = re.compile(r"[A-Za-z]")


@dataclass(frozen=True)
class Model:
    """Frozen counts: for each language and order the distinct (context and next symbol, count).

    ``alphabet`` holds the bytes seen; the symbol of a byte is 1 more than its place there, and 0
    stands for every byte never seen, which all have the same probability. A context of k symbols
    is a number of k digits to the base len(alphabet) + 1, its latest symbol last.
    """

    languages: tuple[str, ...]
    order: int
    alphabet: bytes
    counts: tuple[tuple[tuple[np.ndarray, np.ndarray], ...], ...]
    table_mb: int

    def __hash__(self) -> int:
        return hash((self.languages, self.order, self.alphabet, len(self.counts)))

    def __eq__(self, other) -> bool:
        return isinstance(other, Model) and (self.languages, self.order, self.alphabet) == (other.languages, other.order, other.alphabet) and all(np.array_equal(x, y) for a, b in zip(self.counts, other.counts, strict=True) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))


def train(texts: dict[str, list[str]], order: int = 3, table_mb: int = 64) -> Model:
    """Count contexts of up to ``order`` bytes in the texts of each language."""
    data = {k: [START * order + t.encode("utf-8", "surrogatepass") for t in v] for k, v in sorted(texts.items())}
    alphabet = bytes(sorted(set().union(START, *(set(t) for v in data.values() for t in v))))
    base, symbol = len(alphabet) + 1, symbols(alphabet)
    counts = []
    for parts in data.values():
        s = symbol[np.frombuffer(b"".join(parts), np.uint8)]
        own = np.ones(len(s), bool)  # not the bytes put before a text
        ends = np.cumsum([0, *map(len, parts)])[:-1]
        for i in range(order):
            own[ends + i] = False
        at = np.flatnonzero(own)
        key = s[at].copy()
        of = [np.unique(key, return_counts=True)]
        for k in range(1, order + 1):
            key = key + s[at - k] * base**k
            of.append(np.unique(key, return_counts=True))
        counts.append(tuple(of))
    return Model(tuple(data), order, alphabet, tuple(counts), table_mb)


def symbols(alphabet: bytes) -> np.ndarray:
    """The symbol of each byte."""
    out = np.zeros(256, np.int64)
    out[np.frombuffer(alphabet, np.uint8)] = 1 + np.arange(len(alphabet))
    return out


class Coder:
    """Code lengths of whole texts under a model, exactly, whatever the size of its trees.

    A symbol seen c times after a context that was seen n times, before d different symbols, has
    probability c / (n + d); for any other the escape d / (n + d) times its probability after the
    context without its oldest symbol; after no context at all, 1/256 for every byte. Where tables
    of all contexts and symbols fit the model's ``table_mb``, costs stand ready in them (Dense);
    else only what was seen is held and the rest is added up from it (Sparse).
    """

    def __init__(self, model: Model):
        self.order, self.base, self.symbol, langs = model.order, len(model.alphabet) + 1, symbols(model.alphabet), len(model.languages)
        contexts = sum(len(_contexts(model, k)) for k in range(self.order + 1))
        need = 4 * (contexts * self.base * langs + self.base**self.order)
        self.costs = Dense(model) if need <= model.table_mb << 20 else Sparse(model)
        #: Bytes scored at once, fewer the more languages they are scored for.
        self.langs, self.chunk = langs, max(1, CHUNK * 4 // max(4, langs))

    def bits(self, data: bytes) -> np.ndarray:
        """(bytes, languages): code lengths of each byte but the first ``order``."""
        s = self.symbol[np.frombuffer(data, np.uint8)]
        n, k = len(s), self.order
        ctx = np.zeros(n - k, np.int64)
        for i in range(k):
            ctx *= self.base
            ctx += s[i : n - k + i]
        return self.costs.of(ctx, s[k:])

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): code length in bits of each whole text."""
        out = np.zeros((len(texts), self.langs))
        k, i = self.order, 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= self.chunk):
                size += len(texts[j]) + k
                j += 1
            if size > 2 * self.chunk:  # one very long text, in parts that overlap by a context
                data = START * k + texts[i]
                for lo in range(0, len(texts[i]), self.chunk):
                    out[i] += self.bits(data[lo : lo + self.chunk + k]).sum(0, dtype=np.float64)
            else:
                data = b"".join([START * k + t for t in texts[i:j]])
                cost = self.bits(data)
                begin = np.cumsum([0, *(len(t) + k for t in texts[i:j])])
                whole = np.zeros((len(cost) + 1, self.langs))
                np.cumsum(cost, 0, out=whole[1:])
                # The costs of text t are those at begin[t] to begin[t + 1] - k: what follows belongs to the next one's start.
                out[i:j] = whole[begin[1:] - k] - whole[begin[:-1]]
            i = j
        return out


def _contexts(model: Model, k: int) -> np.ndarray:
    """The contexts of k symbols of all languages in order."""
    base = len(model.alphabet) + 1
    return np.unique(np.concatenate([c[k][0] // base for c in model.counts]))


def _seen(model: Model, k: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Of order k: the contexts of all languages in order; for each language and context n + d, and d; (place of the context, symbol, count) by language."""
    base = len(model.alphabet) + 1
    now = _contexts(model, k)
    total, kinds = np.zeros((2, len(model.languages), len(now)), np.int64)
    each = []
    for lang, of in enumerate(model.counts):
        key, c = of[k]
        at = np.searchsorted(now, key // base)
        kinds[lang] = np.bincount(at, minlength=len(now))
        total[lang] = np.bincount(at, c, len(now)) + kinds[lang]
        each.append((at, key % base, c))
    return now, np.stack((total, kinds)), each


class Dense:
    """The cost of every symbol after every context, in one table, which is made in its place: beside it stand only the orders below the highest."""

    def __init__(self, model: Model):
        order, base, langs = model.order, len(model.alphabet) + 1, len(model.languages)
        likely, nodes = np.full((1, base, langs), 1 / 256, np.float32), np.zeros(1, np.int64)
        ends = np.cumsum([len(_contexts(model, k)) for k in range(order + 1)])
        cost, offset, place = np.empty((ends[-1], base, langs), np.float32), 0, np.zeros(base**order, np.int32)
        for k in range(order + 1):
            now, (total, kinds), each = _seen(model, k)
            p = cost[offset : ends[k]]
            np.take(likely, np.searchsorted(nodes, now % base ** (k - 1)) if k else np.zeros(1, np.int64), 0, out=p, mode="clip")
            for lang, (at, s, c) in enumerate(each):
                p[:, :, lang] *= np.where(total[lang] > 0, kinds[lang] / np.maximum(total[lang], 1), 1).astype(np.float32)[:, None]
                p[at, s, lang] = c / total[lang][at]
            place.reshape(-1, base**k)[:, now] = offset + np.arange(len(now), dtype=np.int32)
            likely, nodes, offset = p.copy() if k < order else p, now, ends[k]
            np.negative(np.log2(p, out=p), out=p)
        self.base, self.place, self.cost = base, place, cost.reshape(-1, langs)

    def of(self, ctx: np.ndarray, s: np.ndarray) -> np.ndarray:
        at = self.place[ctx].astype(np.int64) * self.base
        at += s
        return self.cost[at]


class Sparse:
    """By order: the escape costs of contexts, and the costs of the symbols that some language has after them."""

    def __init__(self, model: Model):
        self.order, self.base, self.langs = model.order, len(model.alphabet) + 1, len(model.languages)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(self.order + 1):
            now, (total, kinds), each = _seen(model, k)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / np.maximum(total, 1)), 0).T.astype(np.float32)
            pairs = np.unique(np.concatenate([c[k][0] for c in model.counts]))
            ctx, s = pairs // self.base, pairs % self.base
            cost = escape[np.searchsorted(now, ctx)] + self._upto(k - 1, ctx % self.base ** max(0, k - 1), s)
            for lang, (at, s, c) in enumerate(each):
                cost[np.searchsorted(pairs, now[at] * self.base + s), lang] = -np.log2(c / total[lang][at])
            self.levels.append((now, escape, pairs, cost.astype(np.float32)))

    def _upto(self, k: int, ctx: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Costs of symbols after contexts of k symbols, by the levels there are."""
        out, left = np.zeros((len(s), self.langs)), np.arange(len(s))
        for level in range(k, -1, -1):
            now, escape, pairs, cost = self.levels[level]
            own = ctx[left] % self.base**level
            key = own * self.base + s[left]
            at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
            hit = pairs[at] == key
            out[left[hit]] += cost[at[hit]]
            left, own = left[~hit], own[~hit]
            at = np.minimum(np.searchsorted(now, own), len(now) - 1)
            out[left] += escape[at] * (now[at] == own)[:, None]
        out[left] += 8.0
        return out

    def of(self, ctx: np.ndarray, s: np.ndarray) -> np.ndarray:
        return self._upto(self.order, ctx, s)


_HELD: dict[Model, Coder] = {}


def coder(model: Model) -> Coder:
    """This process's tables. Those of another model go before these are made, so that a worker which lives on never has both."""
    if model not in _HELD:
        _HELD.clear()
        _HELD[model] = Coder(model)
    return _HELD[model]


def has_letter(text: str) -> bool:
    """Whether any character is a letter in Unicode's sense."""
    return bool(LETTER.search(text)) or any(map(str.isalpha, text))


def predict(text: Column, model: Model) -> Column:
    """struct(lang, score): the language of the shortest code, ties by name, and its posterior over equal priors.

    Whole texts are scored. Null texts, texts without a letter, and all texts under a model
    without languages give ``und`` and 0.
    """

    @F.arrow_udf("lang string, score double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = coder(model) if model.languages else None

        def told_by(texts: pa.Array) -> pa.Array:
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for lo in range(0, len(texts), SLICE):
                values = texts.slice(lo, SLICE).to_pylist()
                told = [i for i, t in enumerate(values) if t is not None and own is not None and has_letter(t)]
                if told:
                    bits = own.lengths([values[i].encode("utf-8", "surrogatepass") for i in told])
                    some = lo + np.array(told)
                    lang[some] = np.array(model.languages, object)[bits.argmin(1)]
                    score[some] = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang", "score"])

        yield from trimmed(map(told_by, batches))

    return of(text)


def remainder(id_: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(id_.cast("string").cast("binary")) % folds


#: Characters of the one text that every language has in its sample.
LEAST = 1024


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 400, longest: int = 1 << 16, total_mb: int = 64, order: int = 3) -> Model:
    """A model of all languages that rows are labelled with, from a bounded sample of these rows.

    The bound: about ``rows`` rows for each language, and some ``total_mb`` MB in all, of which
    each language has an equal part. Of a text of more than ``longest`` bytes, or more than that
    part, the beginning is the sample. Rows are chosen by a hash of their ids and texts, and equal
    texts count once; where none is chosen, LEAST characters of one are. Rows with null text or
    language are not used. An empty table gives a model without languages. The driver gets a row
    for each language besides the sample.
    """
    labelled = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    spot = F.xxhash64(F.coalesce("id", F.lit("")), "text").bitwiseAND(F.lit((1 << 32) - 1)) / F.lit(float(1 << 32))
    size = F.least(F.octet_length("text"), F.lit(longest)).cast("long")
    found = labelled.select("lang", size.alias("bytes")).groupBy("lang").agg(F.count("*").alias("count"), F.sum("bytes").alias("bytes")).collect()
    found.sort(key=lambda r: r["lang"])
    if not found:
        return Model((), order, START, (), 1)
    part = (total_mb << 20) / len(found)
    most = int(min(longest, max(4 * LEAST, part)))
    shares = [(r["lang"], min(1.0, 1.2 * rows / r["count"], max(1.0 / r["count"], part / max(1, r["bytes"])))) for r in found]
    share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in shares for x in pair]), F.col("lang")), F.lit(0.0))
    begin = F.when(F.octet_length("text") <= most, F.col("text")).otherwise(F.left("text", F.lit(most // 4)))
    chosen = labelled.select("lang", "text", spot.alias("spot")).where(F.col("spot") < share).select("lang", begin.alias("text"), "spot")
    texts: dict[str, dict[str, None]] = {r["lang"]: {} for r in found}
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["spot"], r["text"])):
        if len(texts[r["lang"]]) < rows:
            texts[r["lang"]][r["text"]] = None
    bare = [lang for lang, own in texts.items() if not any(own)]
    if bare:
        one = labelled.where(F.col("lang").isin(bare) & (F.col("text") != "")).select("lang", F.struct(spot.alias("spot"), F.left("text", F.lit(LEAST)).alias("part")).alias("one"))
        for r in one.groupBy("lang").agg(F.min("one").alias("one")).collect():
            texts[r["lang"]][r["one"]["part"]] = None
    return train({k: list(v) for k, v in texts.items() if v}, order)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 8 over all of ``documents``: learns from four folds, predicts all rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.coalesce(remainder(F.col("doc_id")), F.lit(-1))
    model = fit(docs.where(fold != 0))
    found = docs.select("doc_id", (fold == 0).alias("held_out"), predict(F.col("text"), model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
