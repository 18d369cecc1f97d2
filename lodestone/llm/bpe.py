"""Byte-level BPE through a sentencepiece model that is written straight from a rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed
from .pretoken import ChunkCache

RANKS = "byte_bpe_50k.tiktoken"


@lru_cache(1)
def byte_chars() -> list[str]:
    """A visible character for each byte: itself where it is printable in Latin-1, else the next free one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank. Ranks must be 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f))))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks are not consecutive")
    return [t for _, t in pairs]


def mapped(data: bytes) -> str:
    """Bytes as the characters that stand for them."""
    return data.decode("latin-1").translate(_latin())


@lru_cache(1)
def _latin() -> dict[int, str]:
    return dict(enumerate(byte_chars()))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _message(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model, serialised, whose piece ids are the ranks of the given tokens.

    Fields of sentencepiece_model.proto: a piece has piece 1, score 2 (a float), type 3 (1 normal,
    2 unknown); the trainer's specification is 2 with model_type 3 (2: BPE), vocab_size 4,
    unk_id 40, bos_id 41, eos_id 42, pad_id 43; the normaliser's is 3 with name 1,
    add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5. The unknown piece comes
    last, as the format demands one; all 256 bytes have pieces, so that it never occurs.
    """
    out = [_message(1, _message(1, mapped(t).encode()) + _varint(2 << 3 | 5) + np.float32(-rank).astype("<f4").tobytes() + _number(3, 1)) for rank, t in enumerate(tokens)]
    unknown, none = len(tokens), (1 << 64) - 1
    out.append(_message(1, _message(1, b"<unk>") + _varint(2 << 3 | 5) + np.float32(0).tobytes() + _number(3, 2)))
    out.append(_message(2, _number(3, 2) + _number(4, unknown + 1) + _number(40, unknown) + _number(41, none) + _number(42, none) + _number(43, none)))
    out.append(_message(3, _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)))
    return b"".join(out)


class Codec:
    """encode() and decode() of one rank file and pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.tokens = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.cache = ChunkCache(self._chunks)

    def _chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk, its pre-tokens encoded one by one."""
        parts = [self.find(c) for c in chunks]
        got = iter(self.model.encode([mapped(p.encode("utf-8", "surrogatepass")) for of in parts for p in of], num_threads=1))
        return [[i for _ in of for i in next(got)] for of in parts]

    def encode(self, text: str) -> np.ndarray:
        """Ids as the rank file's own merging gives them, special tokens being plain text."""
        return np.frombuffer(self.cache.ids(text), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; not always whole characters."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist()])


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """This process's codec."""
    return Codec(path, pattern)


def _paths(path: str | None, pattern: str | None) -> tuple[str, str]:
    return path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids) for every row, ids an array of int. Null and empty texts have no ids.

    Repeated rows stay, an empty table gives no rows, other columns are not read.
    """
    found = _paths(path, pattern)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*found)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                got = [own.encode(t.as_py() or "") for t in part.column(1)]
                ends = np.cumsum([0, *map(len, got)])
                values = np.concatenate(got).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], ["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda batches: trimmed(run(batches)), f"id {kind}, ids array<int>")


def decode(coded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The table with a binary column ``data``, decoded from its column ``ids``; null ids give no bytes."""
    found = _paths(path, pattern)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*found)
        for batch in batches:
            data = [own.decode(np.asarray(x.values)) if x.is_valid else b"" for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*batch.schema.names, "data"])

    return coded.mapInArrow(lambda batches: trimmed(run(batches)), f"{fields}, data binary")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 6 over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = decode(encode(docs))
    return both.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
