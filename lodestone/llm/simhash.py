"""SimHash fingerprints and near copies by covering locality-sensitive hashing; near copies of an exact likeness."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, files_for, free, stored, trimmed
from .graph import components

BITS = 64
#: Shingle hashes that are counted at once.
CHUNK = 1 << 18


def shingle_hashes(text: str, width: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words of the text, A-Z in lower case, joined by one space.

    A text of fewer words gives one shingle of them all; a text of none gives none.
    """
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    n = max(1, len(w) - width + 1)
    runs = zip(*(w[i : i + n] for i in range(width)), strict=True) if len(w) >= width else [w]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(seed)), np.uint64, n)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For consecutive groups of hashes of the given positive sizes: bits set in over half of a group.

    Eight bits, one of each byte, are counted in one addition; byte lanes hold up to 255.
    """
    blocks = -(-sizes // 255)
    first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    at = np.repeat(begin - 255 * first, blocks) + 255 * np.arange(blocks.sum())
    counts = np.empty((len(at), 8, 8), np.int64)
    lane = np.uint64(0x0101010101010101)
    for s in range(8):
        counts[:, :, s] = np.add.reduceat((hashes >> np.uint64(s)) & lane, at).astype("<u8").view(np.uint8).reshape(-1, 8)
    total = np.add.reduceat(counts.reshape(-1, 64), first, axis=0)
    return np.packbits(2 * total > sizes[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def simhashes(texts: Iterator[str | None], width: int, seed: int) -> np.ndarray:
    """A fingerprint for each text, zero for those without words."""
    out: list[np.ndarray] = []
    held: list[np.ndarray] = []
    load = 0

    def flush() -> None:
        sizes = np.array([len(x) for x in held], np.int64)
        done = np.zeros(len(held), np.uint64)
        if sizes.any():
            done[sizes > 0] = majority(np.concatenate(held), sizes[sizes > 0])
        out.append(done)
        held.clear()

    for text in texts:
        held.append(shingle_hashes(text or "", width, seed))
        load += len(held[-1])
        if load >= CHUNK:
            flush()
            load = 0
    flush()
    return np.concatenate(out)


def fingerprint(text: Column, width: int = 3, seed: int = 42) -> Column:
    """The 64-bit SimHash of a text column as a long. Null and wordless texts give zero."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from trimmed(pd.Series(simhashes(iter(texts), width, seed).astype(np.int64)) for texts in batches)

    return of(text)


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2**(radius+1)-1 masks, of which at least one is zero on any ``radius`` given bits.

    Bit i has the vector 1 + i mod (2**(radius+1)-1) over GF(2), of radius+1 coordinates; mask v
    keeps the bits whose vectors have an odd product with v. Any ``radius`` vectors leave a
    non-zero v orthogonal to them all, so that mask v drops those bits: two fingerprints that
    differ in no other bits agree under it.
    """
    n = 2 ** (radius + 1) - 1
    vectors = [1 + i % n for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fingerprints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) edges that connect the distinct fingerprints ``fp`` as all pairs within ``radius`` do.

    ``radius`` is 1 or 2. Fingerprints are dealt to a table for each covering mask by their kept
    bits. Those who share a bucket are then met, within it, on the fingerprints reached by
    turning at most one of the bits which the mask drops: two that differ in one or two bits
    share such a point, and all who share one differ in two at most. A point has at most
    ``BITS`` + 1 neighbours, so that its set is bounded, no pairs are made and no bucket is cut.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    masks = covering_masks(radius)
    fps = fingerprints.select("fp").distinct()
    tables = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(masks)])).alias("t")).select("fp", "t.*")
    shared = tables.groupBy("v", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("v", "key")
    met = tables.join(shared, ["v", "key"]).select("fp", "v")
    turned = F.array(*[F.array(F.lit(0), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks])
    points = met.select("fp", F.explode(turned[F.col("v")]).alias("turn")).select("fp", F.col("fp").bitwiseXOR(F.col("turn")).alias("point"))
    stars = points.groupBy("point").agg(F.collect_set("fp").alias("near")).where(F.size("near") > 1)
    return stars.select(F.array_min("near").alias("b"), F.explode("near").alias("a")).where("a <> b").select("a", "b").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """(id, fp, component): a row for each row of ``docs`` with the smallest id that its fingerprint reaches.

    Rows whose texts are null or have no words share the fingerprint zero and are linked like any
    others. Repeated rows stay; a component whose ids are all null is null; an empty table gives
    no rows. Other columns of ``docs`` are not read, so their names cannot clash. Texts are read
    once; all that follows runs on fingerprints written to the shared folder.
    """
    return grouped(stored(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), width, seed).alias("fp")), "simhash"), radius)


def grouped(marked: DataFrame, radius: int = 2) -> DataFrame:
    """(id, fp, component) of rows (id, fp), whose table should be stored, as it is read three times."""
    fps = marked.groupBy("fp").agg(F.min("id").alias("least"))
    n = marked.count()
    roots = components(links(fps, radius), n)
    of = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = of.groupBy("root").agg(F.min("least").alias("component"))
    labels = of.join(smallest, "root").select("fp", "component")
    return marked.join(labels, "fp").select("id", "fp", "component").coalesce(files_for(marked.sparkSession, n))


#: Near copies are sought by so many bands of so many least hashes: of pairs as alike as 0.8, one in 130,000 shares no
#: band; of pairs as alike as 0.3, as texts with a long passage in common, one in 90 shares one.
BANDS, ROWS = 50, 7
#: Tables of up to so many row ids are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 2_000_000
_FACTORS = [(0x9E3779B97F4A7C15 * (2 * k + 1) ^ 0xD6E8FEB86659FD93 * (k + 1) << 1) & (1 << 64) - 1 | 1 for k in range(BANDS * ROWS)]


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Other hashes from given ones: a 64-bit finaliser after an offset for each k."""
    x = h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int, seed: int) -> np.ndarray:
    """The distinct shingle hashes of a text in order."""
    return np.unique(shingle_hashes(text or "", width, seed))


def set_marks(texts: Iterator[str | None], width: int, seed: int) -> pd.DataFrame:
    """(digest, n, keys) for each text: a digest of its set of shingles, the set's size, and BANDS keys of ROWS least hashes each; a set of none has no keys."""
    digests: list[bytes] = []
    sizes: list[int] = []
    keys: list[np.ndarray] = []
    held: list[np.ndarray] = []
    load = 0

    def flush() -> None:
        some = [x for x in held if len(x)]
        found = iter(())
        if some:
            whole = np.concatenate(some)
            begin = np.concatenate(([0], np.cumsum([len(x) for x in some])[:-1]))
            bands = np.empty((len(some), BANDS), np.uint64)
            for band in range(BANDS):
                key = np.full(len(some), band, np.uint64)
                for k in range(band * ROWS, (band + 1) * ROWS):
                    key = _mixed(key ^ np.minimum.reduceat(whole * np.uint64(_FACTORS[k]), begin), k)
                bands[:, band] = key
            found = iter(bands.astype(np.int64))
        keys.extend(next(found) if len(x) else np.empty(0, np.int64) for x in held)
        held.clear()

    for text in texts:
        own = shingle_set(text, width, seed)
        digests.append(xxhash.xxh3_128_digest(own.tobytes()))
        sizes.append(len(own))
        held.append(own)
        load += len(own)
        if load >= CHUNK:
            flush()
            load = 0
    flush()
    return pd.DataFrame({"digest": digests, "n": np.array(sizes, np.int32), "keys": keys})


def _few(ids: DataFrame) -> DataFrame:
    """A stored table of row ids, to be broadcast if it is small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def sets_of(texts: DataFrame, ids: DataFrame, width: int, seed: int) -> DataFrame:
    """(row, s): the sets of shingles, made anew from whole texts (row, text), of the rows in the stored table ``ids``; stored."""

    @F.pandas_udf("array<long>")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from trimmed(pd.Series([shingle_set(t, width, seed).astype(np.int64) for t in some]) for some in batches)

    return stored(texts.join(_few(ids), "row", "left_semi").select("row", shingles(F.col("text")).alias("s")), "sets")


def alike(tried: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """Those of the pairs (a, b) of row ids, a stored table, whose sets (row, s) have a Jaccard likeness of ``likeness`` or more; stored."""
    both = tried.join(sets.select(F.col("row").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("row").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    linked = both.where(common / (F.size("sa") + F.size("sb") - common) >= likeness).select("a", "b")
    # Sets are joined in all partitions; what is found is dealt to few files afterwards.
    return stored(linked.repartition(files_for(tried.sparkSession, tried.count())), "links")


#: Shingles are told apart by how many of the sets hold them: from each of these numbers up to the next.
HOLDERS = (2, 4, 16, 64)


def shared_counts(sets: DataFrame) -> DataFrame:
    """(node, c0, c1, ..): of the shingles of each set (row, s), how many are in so many of the sets, by HOLDERS.

    Shingles that no other set has count nowhere; sets of such alone are left out.
    """
    each = sets.select("row", F.explode("s").alias("s"))
    holders = each.groupBy("s").agg(F.count("*").alias("h")).where("h > 1")
    ends = (*HOLDERS[1:], 1 << 62)
    return each.join(holders, "s").groupBy(F.col("row").alias("node")).agg(*[F.count_if((F.col("h") >= lo) & (F.col("h") < hi)).alias(f"c{i}") for i, (lo, hi) in enumerate(zip(HOLDERS, ends, strict=True))])


def similar(texts: DataFrame, nodes: DataFrame, width: int, likeness: float, seed: int) -> DataFrame:
    """(node, root) of the nodes (node, n, keys) that have others of ``likeness`` or more: groups linked by such pairs.

    Nodes of one key make a bucket. Each is first held against one of its bucket, another for
    each band, so that large groups of copies become one group at the cost of their size. Then the
    pairs of a bucket that are in different groups yet are held against each other, but for those
    that their sizes and counts of shingles rule out: of the shingles that so many such nodes hold,
    two sets have no more in common than the lesser of their counts, and of those that one alone
    holds, none. Only pairs that reach the exact likeness are linked. ``texts`` has (row, text), rows naming nodes.
    """
    spark = texts.sparkSession
    # A node is in some few buckets that it shares; that sets the number of files alone.
    some = 8 * nodes.count()
    each = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = each.groupBy("key").count().where("count > 1").select("key")
    buckets = stored(each.join(shared, "key"), "buckets", some)
    firsts = buckets.groupBy("key").agg(F.min_by(F.struct("node", "n"), F.xxhash64("node", "key")).alias("first"))
    ratio = lambda x, y: F.least(x, y) / F.greatest(x, y) >= likeness
    stars = buckets.join(firsts, "key").where((F.col("node") != F.col("first.node")) & ratio(F.col("n"), F.col("first.n")))
    tried = stored(stars.select(F.least("node", "first.node").alias("a"), F.greatest("node", "first.node").alias("b")).distinct(), "tried", some)
    ends = stored(tried.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "ends", 2 * tried.count())
    sets = sets_of(texts, ends, width, seed)
    begun = alike(tried, sets, likeness)
    discard(spark, tried, ends, sets)

    at_first = components(begun, begun.count())
    rooted = buckets.join(at_first, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    still = stored(rooted.join(mixed, "key"), "open", some)
    discard(spark, buckets, at_first)
    ends = stored(still.select(F.col("node").alias("row")).distinct(), "ends", still.count())
    sets = sets_of(texts, ends, width, seed)
    counts = [f"c{i}" for i in range(len(HOLDERS))]
    enough = sum((F.col(c) for c in counts[1:]), F.col(counts[0])) / F.col("n") >= likeness
    most = stored(still.join(shared_counts(sets), "node").where(enough), "open", still.count())

    # Only nodes outside a bucket's largest group meet the rest of it; a pair is met once, in the first bucket that it shares.
    sizes = most.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("major"))
    lists = most.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    dealt = most.join(lists, "node").join(sizes, "key").select("key", "node", "n", "root", "major", "keys", *counts)
    others = dealt.drop("major").select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "root", "keys", *counts)])
    common = sum((F.least(c, f"{c}_b") for c in counts[1:]), F.least(counts[0], f"{counts[0]}_b"))
    apart = (F.col("root") != F.col("root_b")) & ((F.col("root_b") == F.col("major")) | (F.col("node") < F.col("node_b")))
    can = apart & ratio(F.col("n"), F.col("n_b")) & (common / (F.col("n") + F.col("n_b") - common) >= likeness)
    once = F.get(F.array_intersect("keys", "keys_b"), F.lit(0)) == F.col("mine.key")
    met = dealt.where("root <> major").alias("mine").join(others.alias("rest"), (F.col("mine.key") == F.col("rest.key")) & can & once)
    met = met.select(F.least("node", "node_b").alias("node"), F.greatest("node", "node_b").alias("node_b"))
    tried = stored(met.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct(), "tried", some)
    rest = alike(tried, sets, likeness)
    links = begun.unionByName(rest)
    roots = components(links, links.count())
    discard(spark, still, most, tried, ends, sets, begun, rest)
    return roots


def with_fingerprints(nodes: DataFrame) -> DataFrame:
    """(node, n, keys) of nodes (node, n, keys, fp), with one key more: that of all fingerprints that links() connects to a node's. Nodes without shingles get none."""
    some = nodes.where("n > 0")
    linked = components(links(some), nodes.count()).select(F.col("node").alias("fp"), "root")
    key = F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "fp"))
    return nodes.join(linked, "fp", "left").select("node", "n", F.when(F.col("n") > 0, F.array_append("keys", key)).otherwise(F.col("keys")).alias("keys"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, likeness: float = 0.8, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their group of near copies, one for each group.

    Groups are linked by pairs whose sets of ``width``-word shingles have a Jaccard likeness of
    ``likeness`` (0.8 or more) at least. Candidates are the texts whose SimHash fingerprints reach one
    another by steps of two or fewer bits, as operator 1 links them, and, since most pairs of that
    likeness are further apart, those that share a band of least hashes. Texts of equal sets, and null and wordless ones, are of
    one group. Null ids come after all others; of rows with equal ids one stays, which is the first
    as the table was written to the shared folder. Columns stay as they are.
    """

    @F.pandas_udf("digest binary, n int, keys array<long>")
    def marks(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from trimmed(set_marks(iter(texts), width, seed) for texts in batches)

    mark, row, fp = free(docs, "_mark"), free(docs, "_row"), free(docs, "_bits")
    full = stored(docs.withColumns({mark: marks(F.col(text_col)), fp: fingerprint(F.col(text_col), seed=seed), row: F.monotonically_increasing_id()}), "marked")
    n = full.count()
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    of = full.select(F.col(f"{mark}.digest").alias("digest"), rank.alias("rank"), F.col(row).alias("row"))
    least = of.groupBy("digest").agg(F.min("rank").alias("rank")).select("rank", F.col("rank.row").alias("node"))
    nodes = stored(least.join(full.select(F.col(row).alias("node"), f"{mark}.n", f"{mark}.keys", F.col(fp).alias("fp")), "node"), "nodes", n)
    roots = similar(full.select(F.col(row).alias("row"), F.col(text_col).alias("text")), with_fingerprints(nodes), width, likeness, seed)
    first = nodes.select("node", "rank").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias(row))
    gone = stored(full.select(row).join(first, row, "left_anti"), "gone", n)
    discard(docs.sparkSession, nodes, roots)
    return full.join(_few(gone), row, "left_anti").select(*docs.columns)


def hex16(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 1 over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_copies(docs)
    return found.select(F.col("id").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
