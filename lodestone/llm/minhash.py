"""One-permutation MinHash fingerprints, densified and packed to low-order bits, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free, let, words

#: Words of a shingle, bins of a fingerprint, and bits kept of each bin.
WIDTH, BINS, BITS = 5, 256, 8
#: Fixed probes of an empty bin; where all find empty bins, its choice is made among all filled ones at once.
PROBES = 16
LOW = (1 << 56) - 1
#: Ranges of the next-row join are taken together to so many rows a task, while every core has one.
TASK_ROWS = 8192
#: Bytes of a fingerprint in one long.
LANES = 8


def shingles(text: Column, width: int = WIDTH, seed: int = 42) -> Column:
    """Hashes of the runs of ``width`` words, A-Z in lower case; of fewer words, one of them all; of none, none."""
    text = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hashed = F.transform(words(text), lambda w: F.xxhash64(w, F.lit(seed)))
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
    whole = lambda h: F.array(F.aggregate(h, F.lit(seed).cast("long"), lambda acc, x: F.xxhash64(acc, x)))
    return let(hashed, lambda h: F.when(F.size(h) >= width, runs(h)).when(F.size(h) > 0, whole(h)).otherwise(F.array().cast("array<bigint>")))


def codes(text: Column, width: int = WIDTH, seed: int = 42) -> Column:
    """The fingerprint of a text, array<bigint>: the low-order bytes of each bin's least shingle hash, LANES bins to a long.

    Each shingle is hashed once; the top byte of its hash is its bin and the rest its rank there.
    An empty bin takes the value of a filled one by optimal densification: it tries bins in an
    order that depends on its own number alone, so that two texts choose alike and each filled bin
    is as likely. The first PROBES come from fixed tables, and mostly one of few is filled. Where
    none is, as in texts of few words, the filled bin of the least hash together with the empty
    bin's number is taken. A text without words gives all zeros.
    """
    # One value above all others for each bin makes bins that got no shingle stand out.
    none = F.lit([_signed(b << 56 | LOW) for b in range(BINS)])

    def least(order: Column) -> Column:
        """The least hash of each bin in turn: the first of each in an unsigned order, whose bins are all there."""
        bin_of = lambda x: F.shiftrightunsigned(x, 56)
        return F.filter(order, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(order, i - 1))))

    def value(x: Column) -> Column:
        """What is kept of a bin's hash; null for an empty bin."""
        return F.when(x.bitwiseAND(F.lit(LOW)) != F.lit(LOW), x.bitwiseAND(F.lit((1 << BITS) - 1)))

    def dense(kept: Column) -> Column:
        """The values by bin with empty bins filled. ``kept`` runs as the sorted hashes do: from bin 128 on, then from 0."""
        place = [(b + BINS // 2) % BINS for b in range(BINS)]
        filled = F.filter(F.transform(kept, lambda v, i: F.when(v.isNotNull(), i)), lambda i: i.isNotNull())

        def chosen(i: Column, from_: Column) -> Column:
            ranked = F.transform(from_, lambda j: F.shiftleft(F.xxhash64(j, i), 8).bitwiseOR(j.cast("long")))
            return F.get(kept, F.array_min(ranked).bitwiseAND(F.lit(BINS - 1)).cast("int"))

        tables = [[place[j] for j in table] for table in _probes()]
        fill = lambda at, i, from_: F.coalesce(F.get(kept, at), *[F.get(kept, F.get(F.lit(t), i)) for t in tables], chosen(i, from_))
        return let(filled, lambda f: F.transform(F.lit(place), lambda at, i: fill(at, i, f)))

    def pack(bins: Column) -> Column:
        """BINS values as longs, the first bin of each in its top byte."""

        def lane(k: Column) -> Column:
            out = F.shiftleft(F.get(bins, k), 64 - BITS)
            for i in range(1, LANES):
                out = out.bitwiseOR(F.shiftleft(F.get(bins, k + i), 64 - BITS * (i + 1)))
            return out

        return F.transform(F.lit(list(range(0, BINS, LANES))), lane)

    def of(h: Column) -> Column:
        kept = let(F.sort_array(F.concat(h, none)), lambda order: F.transform(least(order), value))
        return let(let(kept, dense), pack)

    zeros = F.array_repeat(F.lit(0).cast("bigint"), BINS // LANES)
    return let(shingles(text, width, seed), lambda h: F.when(F.size(h) > 0, of(h)).otherwise(zeros))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _probes() -> list[list[int]]:
    """PROBES bins for each bin, by a fixed mixing function."""

    def mix(x: int) -> int:
        x = (x ^ x >> 16) * 0x7FEB352D & 0xFFFFFFFF
        x = (x ^ x >> 15) * 0x846CA68B & 0xFFFFFFFF
        return x ^ x >> 16

    return [[mix(t << 16 | i) % BINS for i in range(BINS)] for t in range(1, PROBES + 1)]


def packed(code: Column) -> Column:
    """A fingerprint as lower-case hexadecimal digits, two for each bin."""
    return F.lower(F.array_join(F.transform(code, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1, of two fingerprints: equal bins, less those equal by chance in BITS bits."""

    def folded(values: Column, by: int) -> Column:
        return F.transform(values, lambda x: x.bitwiseOR(F.shiftrightunsigned(x, by)))

    # Of the bytes of two longs' difference, the lowest bit is made to stand for the whole byte.
    other = folded(folded(folded(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), 4), 2), 1)
    differ = F.aggregate(other, F.lit(0), lambda n, x: n + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101))))
    same = F.lit(1.0) - differ / F.lit(float(BINS))
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (same - chance) / (1 - chance))


def with_next(rows: DataFrame, id_col: str, columns: list[str], buckets: int | None = None) -> DataFrame:
    """``rows`` with ``next_<c>`` of the row that follows by descending id, the first after the last.

    Ids (integers) are cut at quantiles, and each interval in equal parts, into as many ranges as
    there are shuffle partitions; only the bounds, at most 1024 numbers, come to the driver. Rows
    move once, to their range; the rows with each range's largest id also go to the range before
    it, so that each range has what follows its last row. Null ids come last. Equal ids are
    ordered by their columns. A single row follows itself.
    """
    spark = rows.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts, parts = min(n, 1024), -(-n // min(n, 1024))
    key = F.col(id_col).cast("long")
    bounds = rows.select(F.percentile_approx(key, [i / cuts for i in range(1, cuts)] or [0.5], 10 * cuts).alias("q"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    lo, hi = bounds["lo"], bounds["hi"]
    edges = sorted({lo, *(bounds["q"] or [])}) if lo is not None else [0]
    hi = 0 if hi is None else hi
    ends = [*edges[1:], hi + 1]
    at = F.size(F.filter(F.lit(edges[1:]) if edges[1:] else F.array().cast("array<bigint>"), lambda e: e <= key)).cast("long")
    start, end = F.get(F.lit(edges), at.cast("int")), F.get(F.lit(ends), at.cast("int"))
    inner = F.least(F.lit(parts - 1), F.floor((key - start) * parts / F.greatest(F.lit(1), end - start)))
    # Ranges count from the largest ids on; rows without an id are the last range's.
    last = len(edges) * parts
    slot = F.coalesce(F.lit(last - 1) - (at * parts + inner), F.lit(last)).cast("long")
    at_, to, some = (free(rows, x) for x in ("_slot", "_to", "_some"))
    dealt = rows.withColumn(at_, slot)
    tops = dealt.groupBy(F.col(at_).alias("slot")).agg(F.max(key).alias("top"), F.count("*").alias("rows")).orderBy("slot").collect()
    if not tops:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    before = {r["slot"]: tops[i - 1]["slot"] for i, r in enumerate(tops)}
    first = {r["slot"]: r["top"] for r in tops}
    pairs = F.create_map(*[F.lit(x) for s in before for x in (s, before[s])])
    heads = F.create_map(*[F.lit(x) for s in first for x in (s, first[s])]) if all(v is not None for v in first.values()) else F.create_map(*[F.lit(x) for s, v in first.items() if v is not None for x in (s, v)] or [F.lit(-1).cast("long"), F.lit(-1).cast("long")])
    leads = F.try_element_at(heads, F.col(at_)).eqNullSafe(key)
    own = F.struct(F.col(at_).alias("s"), F.lit(False).alias("g"))
    ahead = F.struct(F.try_element_at(pairs, F.col(at_)).alias("s"), F.lit(True).alias("g"))
    spread = dealt.withColumn(to, F.explode(F.when(leads, F.array(own, ahead)).otherwise(F.array(own))))
    order = W.partitionBy(f"{to}.s").orderBy(f"{to}.g", key.desc_nulls_last(), *columns)
    out = spread.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns], F.lead(F.lit(True)).over(order).alias(some))
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(r["rows"] for r in tops) // TASK_ROWS))
    return out.where(~F.col(f"{to}.g")).drop(at_, to, some).coalesce(tasks)


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many, or all, of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(next_text, F.lit(1), half))


def compare_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited, code, edited_code, near_edited, near_next) for every row.

    Null texts are empty. Whole texts are fingerprinted, each once before rows are dealt by id;
    the code then moves with its text.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    coded = base.withColumn("code", codes(F.col("text")))
    both = with_next(coded, "id", ["text", "code"])
    changed = both.select("id", F.length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("next_text")).alias("edited"), "code", "next_code")
    done = changed.withColumn("edited_code", codes(F.col("edited")))
    return done.select("id", "n_chars", "edited", "code", "edited_code", likeness(F.col("code"), F.col("edited_code")).alias("near_edited"), likeness(F.col("code"), F.col("next_code")).alias("near_next"))


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 2 over all of ``documents``."""
    found = compare_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("code")).alias("fingerprint"),
        packed(F.col("edited_code")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
