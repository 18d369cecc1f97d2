"""Documents cut into token pieces and packed into sequences by the sum-of-squares rule."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_chars
from .common import stored, trimmed

CAPACITY = 2048
#: Pieces that one task packs, about; a task holds only its open sequences, whatever it gets.
SHARD = 1 << 15


@lru_cache(2)
def encoder(path: str) -> Callable[[str], bytes]:
    """This process's encoder of a ``tokenizers`` file: a text's ids as little-endian unsigned 32-bit integers.

    Strings of special tokens are plain text. Where the file is a plain byte-level BPE whose ids
    follow the order of its merges, so that ids are ranks, the same merges run in tiktoken, which
    takes a quarter of the time; any other file is left to the tokenizers library.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(path, encoding="utf-8") as f:
        ranks = ranks_of(json.load(f))
    if ranks is not None:
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: own.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def ranks_of(spec: dict) -> dict[bytes, int] | None:
    """Rank of each byte string, if the file's ids are ranks under the usual pre-token pattern; else None."""
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    odd = spec.get("normalizer") or model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("byte_fallback") or model.get("ignore_merges")
    if odd or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    byte_of = {c: b for b, c in enumerate(byte_chars())}
    special = {x["content"] for x in spec.get("added_tokens", []) if x.get("special")}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    plain = sorted(ranks.values()) == list(range(256 + len(merges))) and all(ranks[bytes([b])] < 256 for b in range(256))
    return ranks if plain and all(model["vocab"][x + y] == 256 + i for i, (x, y) in enumerate(merges)) else None


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of full length but the first, which has the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids) for every row: its token ids and then ``end_id``, cut to capacity.

    ``ids`` are little-endian unsigned 32-bit integers. Null and empty texts give one piece with
    the end id alone. Rows with equal or null ids are documents of their own.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path)
        for batch in batches:
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary()]

            def made(rows: list[tuple], types: list = types) -> pa.RecordBatch:
                columns = zip(*rows, strict=True) if rows else [()] * 5
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "piece", "start", "length", "ids"])

            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(text.as_py() or "") + end
                rows += [(doc, piece, s, n, ids[4 * s : 4 * (s + n)]) for piece, (s, n) in enumerate(cuts(len(ids) // 4, capacity))]
                held += len(ids)
                if held > 16 << 20:
                    yield made(rows)
                    rows, held = [], 0
            yield made(rows)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda batches: trimmed(run(batches)), f"id {kind}, piece int, start long, length long, ids binary")


class SumOfSquares:
    """Open sequences by what they have left; add() says where an item goes: (sequence, offset).

    Of all sequences that fit, an item goes where the sum over gaps of the squared number of open
    sequences with that gap becomes smallest, the smaller gap on a tie; a new one is opened only
    when none fits. Full sequences are closed and no longer count.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[int]] = {}
        self.made = 0

    def add(self, size: int) -> tuple[int, int]:
        full = self.capacity
        here = self.count[size:full]
        used = here > 0
        if used.any():
            # The change of the sum when gap h becomes h - size; closed sequences aren't counted.
            change = 2 * (self.count[: full - size] - here) + 2
            if used[0]:
                change[0] = 1 - 2 * here[0]
            at = np.flatnonzero(used)
            gap = size + int(at[change[at].argmin()])
            seq = self.open[gap].pop()
            self.count[gap] -= 1
        else:
            gap, seq = full, self.made
            self.made += 1
        if gap > size:
            self.count[gap - size] += 1
            self.open.setdefault(gap - size, []).append(seq)
        return seq, full - gap


def place(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``pieces`` (with a column ``length``, 1 to capacity) with their sequence_id and offset, in place of any such columns.

    Rows are dealt by the hash of all their columns to so many shards that each has about
    ``shard`` rows, and each shard is packed on its own, longest first; what is lost is the few
    open sequences that each shard ends with. The order within a shard is fixed by all columns,
    so that a task that runs again gives the same result. ``pieces`` is read twice.
    """
    pieces = pieces.drop("sequence_id", "offset")
    n = max(1, -(-pieces.count() // shard))
    names = [c for c in pieces.columns if c != "length"]
    dealt = pieces.repartition(n, F.xxhash64(*pieces.columns)).sortWithinPartitions(F.desc("length"), *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, base = SumOfSquares(capacity), TaskContext.get().partitionId() << 40
        for batch in batches:
            got = [packer.add(size) for size in batch.column("length").to_pylist()]
            added = [pa.array([base + x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def assemble(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from token_pieces() and place() of them, joined on id and piece.

    A sequence holds ``capacity`` tokens at most, which bounds what is gathered for each.
    """
    whole = pieces.select("id", "piece", "ids").join(placed.select("id", "piece", "sequence_id", "offset"), ["id", "piece"])
    parts = whole.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): every row's pieces and their places.

    Null and empty texts are documents of one token; an empty table gives no rows; repeated rows
    are packed each. Other columns are not read. Token ids are not moved: only their checksum is
    kept, in a table in the shared folder.
    """
    pieces = token_pieces(docs, id_col, text_col, path, capacity)
    light = stored(pieces.select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return place(light, capacity, shard)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 4 over all of ``documents``."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
