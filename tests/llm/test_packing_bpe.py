"""Packing and BPE against the public libraries themselves."""

from __future__ import annotations

import base64
import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, packing

DATA = "/root/testdata/sf0.001/documents.parquet"
ODD = "aé ñ  \n\t\r\x0b\x1c\x85 　'sS¼²٣漢字🙂‍<|endoftext|>_-.9 "


def odd_texts(n=400):
    rng = random.Random(4)
    return ["", " ", "  x ", "\n\n", "<|endoftext|>", "x" * 30_000, "é" * 5000, *("".join(rng.choices(ODD, k=rng.randint(0, 60))) for _ in range(n))]


def texts():
    return [t for (t,) in duckdb.sql(f"SELECT text FROM '{DATA}'").fetchall()]


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return lambda t: own.encode(t, add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizers_library(library):
    own = packing.encoder(P.path("byte_bpe_50k.json"))
    for t in odd_texts() + texts():
        assert np.frombuffer(own(t), "<u4").tolist() == library(t)


def test_other_files_go_to_the_tokenizers_library():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    assert np.frombuffer(packing.encoder(path)("Hello there"), "<u4").tolist() == Tokenizer.from_file(path).encode("Hello there", add_special_tokens=False).ids


@pytest.mark.parametrize("n, expected", [(1, [(0, 1)]), (4, [(0, 4)]), (5, [(0, 1), (1, 4)]), (8, [(0, 4), (4, 4)]), (9, [(0, 1), (1, 4), (5, 4)])])
def test_cuts(n, expected):
    assert packing.cuts(n, 4) == expected


def slow_place(sizes, capacity):
    """The same rule by trying every open sequence."""
    left, out = [], []
    for s in sizes:
        best = None
        for g in sorted({g for g in left if g >= s}):
            after = list(left)
            after[after.index(g)] -= s
            counts = {}
            for v in after:
                if v:
                    counts[v] = counts.get(v, 0) + 1
            total = sum(c * c for c in counts.values())
            if best is None or total < best[0]:
                best = total, g
        if best is None:
            out.append(capacity)
            left.append(capacity - s)
        else:
            out.append(best[1])
            left[left.index(best[1])] -= s
    return out, len(left)


@pytest.mark.parametrize("seed", range(6))
def test_sum_of_squares_against_trying_all(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 20) for _ in range(120)]
    own = packing.SumOfSquares(20)
    got = [own.add(s) for s in sizes]
    gaps, made = slow_place(sizes, 20)
    assert [20 - offset for _, offset in got] == gaps and own.made == made


def test_packing_keeps_every_token_and_wastes_little(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(900, None, ""), (901, "", ""), (901, "", ""), (None, "null id", ""), (902, "word " * 9000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = packing.pack(docs, capacity=512, shard=10_000).toPandas()
    want = {}
    for doc, t, _ in rows:
        want.setdefault(doc, []).append([*library(t or ""), 0])
    for doc, lists in want.items():
        own = got[got.id.isna()] if doc is None else got[got.id == doc]
        assert own.length.sum() == sum(map(len, lists)) and (own.piece == 0).sum() == len(lists)
        if len(lists) == 1:
            for r in own.itertuples():
                part = np.array(lists[0][r.start : r.start + r.length], "<u4").tobytes()
                assert zlib.crc32(part) == r.ids_crc32 and (r.length == 512 or r.piece == 0)
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= 512
    assert got.sequence_id.nunique() <= 1.01 * -(-got.length.sum() // 512) + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_assembled_sequences(spark, library):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts()[:30])], "doc_id long, text string")
    pieces = packing.token_pieces(docs, capacity=256).checkpoint()
    placed = packing.place(pieces.select("id", "piece", "length"), 256)
    whole = packing.assemble(pieces, placed).select(F.length("ids").alias("n")).collect()
    assert sum(r["n"] for r in whole) == 4 * sum(len(library(t)) + 1 for t in texts()[:30]) and max(r["n"] for r in whole) <= 4 * 256


def test_bpe_round_trip_against_tiktoken(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.RANKS), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t, "clash") for i, t in enumerate([*odd_texts(), *texts()])] + [(-1, None, "")]
    both = bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string")))
    for r in both.collect():
        t = next(x for i, x, _ in rows[r["id"] :] if i == r["id"]) or "" if r["id"] >= 0 else ""
        assert r["ids"] == own.encode_ordinary(t) and bytes(r["data"]) == t.encode()
    assert bpe.encode(spark.createDataFrame(rows[:0], "doc_id long, text string, ids string")).count() == 0


def test_the_model_is_a_valid_file_and_another_vocabulary_works():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.Codec(path, P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in odd_texts(100):
        assert own.encode(t).tolist() == other.encode_ordinary(t)
    assert own.model.get_piece_size() == len(ranks) + 1 and own.model.unk_id() == len(ranks)
    assert hashlib.sha256(b"".join(bytes([b]) for b in range(256))).digest() == hashlib.sha256(own.decode(np.array([ranks[bytes([b])] for b in range(256)]))).digest()


def test_the_cache_may_be_small():
    own = bpe.Codec(P.path(bpe.RANKS), P.PATTERN)
    own.cache.entries, own.cache.patience = 3, 2
    full = bpe.Codec(P.path(bpe.RANKS), P.PATTERN)
    assert all((own.encode(t) == full.encode(t)).all() for t in texts()[:20])
