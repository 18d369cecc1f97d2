"""Drifted files and their rewrite: the chain bit by bit, lost attempts, and the whole query by brute force."""

from __future__ import annotations

import hashlib
import math
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import migrate as M

DATA = "/root/testdata/sf0.001"
NAMES = "client_id master_id source updated_at name email city nation_id segment balance".split()
TARGET = M.with_ids(pa.schema([("a", pa.int64()), ("b", pa.string()), ("c", pa.float64()), ("d", pa.string())]))
ROWS = {"a": [1, None, 3], "b": ["x", "", None], "c": [0.5, None, -2.25], "d": ["p", "q", None]}


def drifted(bits):
    fields = [f for f in TARGET if not (bits & M.ABSENT and f.name == "d")]
    if bits & M.REORDERED:
        fields = fields[:1] + fields[:0:-1]
    data = [pa.array(ROWS[f.name], pa.float32() if bits & M.NARROW and f.name == "c" else f.type) for f in fields]
    names = [{"a": "b", "b": "a"}.get(f.name, f.name) if bits & M.RENAMED else f.name for f in fields]
    return pa.Table.from_arrays(data, schema=pa.schema([f.with_name(n).with_type(x.type) for f, n, x in zip(fields, names, data)]))


@pytest.mark.parametrize("bits", range(16))
def test_every_drift_is_told_and_undone(bits):
    table = drifted(bits)
    assert M.drift(table.schema, TARGET) == bits
    made = M.chain(bits, TARGET, {"d": "none"})(table)
    assert made.schema.equals(TARGET, check_metadata=True)
    assert made.to_pydict() == {**ROWS, **({"d": ["none"] * 3} if bits & M.ABSENT else {})}


@pytest.mark.parametrize("bit", [M.RENAMED, M.REORDERED, M.ABSENT, M.NARROW])
def test_a_transform_undoes_its_own_bit_only(bit):
    make = next(step for on, step in M.TRANSFORMS if on & bit)
    for bits in range(16):
        if bits & bit and not (bit == M.REORDERED and bits & M.ABSENT):
            left = M.drift(make(TARGET, {})(drifted(bits)).schema, TARGET)
            assert not left & bit and not left & ~bits & ~M.REORDERED


def test_fields_that_cannot_be_placed_are_errors():
    for bad in (pa.schema([("a", pa.int64())]), pa.schema([TARGET.field(0), TARGET.field(0).with_name("z")]), pa.schema([pa.field("z", pa.string(), metadata={M.ID: b"77"})])):
        with pytest.raises(ValueError):
            M.drift(bad, TARGET)


def test_files_of_any_drift(spark, tmp_path, monkeypatch):
    paths = []
    for bits in range(16):
        paths.append(f"{tmp_path}/in/f{bits}.parquet")
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        pq.write_table(drifted(bits), paths[-1])
    before = open(paths[0], "rb").read()
    # An attempt that was lost left its part; one that got to the end left its file, as did one of other contents.
    os.makedirs(f"{tmp_path}/in.parts")
    open(f"{tmp_path}/in.parts/f3-evolved.parquet.1", "wb").write(b"cut")
    open(f"{tmp_path}/in/f3-evolved.parquet", "wb").write(b"cut")
    files = spark.createDataFrame([(p, i, "x") for i, p in enumerate(paths)] + [(None, -1, "n"), (paths[5], 5, "again")], "path string, n int, drifted string")
    done = M.rewrite(files, TARGET, {"d": "none"})
    got = {(r["n"], r["drifted"]): r for r in done.collect()}
    assert len(got) == 18 and got[-1, "n"]["final_path"] is None and got[5, "again"]["drift"] == 5
    assert sorted(os.listdir(f"{tmp_path}/in")) == sorted(os.path.basename(got[i, "x"]["final_path"]) for i in range(16))
    for i in range(16):
        r = got[i, "x"]
        assert r["drift"] == i and r["rewritten"] == (i > 0)
        table = pq.read_table(r["final_path"])
        assert table.schema.equals(TARGET, check_metadata=True) and table.to_pydict()["c"] == ROWS["c"]
    assert open(paths[0], "rb").read() == before and got[0, "x"]["final_path"] == paths[0]
    # Run again over the final files: nothing is left to do.
    again = M.rewrite(done.where("final_path IS NOT NULL").select(F.col("final_path").alias("path")), TARGET)
    assert again.where("rewritten OR drift != 0").count() == 0
    assert M.rewrite(files.limit(0), TARGET).count() == 0


def test_a_rewrite_holds_no_more_than_a_batch(monkeypatch, spark, tmp_path):
    table = pa.Table.from_arrays([pa.array(range(5000), pa.int64()), pa.array(["v"] * 5000), pa.array([1.0] * 5000, pa.float32()), pa.array(["w"] * 5000)], schema=pa.schema([f.with_type(pa.float32()) if f.name == "c" else f for f in TARGET]))
    pq.write_table(table, f"{tmp_path}/big.parquet", row_group_size=700)
    monkeypatch.setattr(M, "BATCH", 512)
    sizes, apply = [], M.chain(M.NARROW, TARGET, {})
    out = M.Writer(f"{tmp_path}/out/big.parquet", TARGET, 1)
    for part in M.stream_batches(f"{tmp_path}/big.parquet"):
        sizes.append(len(part))
        out.write(apply(pa.Table.from_batches([part], table.schema)))
    out.close()
    assert max(sizes) <= 512 and pq.read_table(f"{tmp_path}/out/big.parquet").column("a").to_pylist() == list(range(5000))


def test_numbers_follow_the_order(spark):
    rows = [(i % 7 if i % 5 else None, "t" if i % 2 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, range string, at int").repartition(5)
    got, n = M.numbered(df, F.col("a"), F.col("range"), F.col("at"))
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert n == 500
    assert [tuple(r)[:3] for r in sorted(got.collect(), key=lambda r: r["r"])] == sorted(rows, key=lambda r: (key(r[:1]), r[1] is not None, r[2]))
    assert sorted(r["r"] for r in M.numbered(df, F.lit(1))[0].collect()) == list(range(500))
    empty, none = M.numbered(df.limit(0), F.col("a"))
    assert none == 0 and empty.count() == 0


def expected(rows):
    """The contract by brute force over rows of ``clients``, times in microseconds."""
    text = lambda r: "" if r[0] is None else str(r[0])
    rows = sorted(rows, key=lambda r: (zlib.crc32(text(r).encode()), -1 if r[0] is None else r[0]))
    k, out = 1 + len(rows) // 1000, []
    for no in range(-(-len(rows) // k)):
        part, v = [list(r) for r in rows[no * k : (no + 1) * k]], zlib.crc32(f"7:{no}".encode()) % 24
        v = 0 if v > 15 else v
        for r in part:
            if v & 4:
                r[6], r[7] = "none", -1
            if v & 8 and r[9] is not None:
                r[9] = float(np.float32(r[9]))
        show = lambda x: "?" if x is None else str(math.floor(x * 1048576)) if isinstance(x, float) else str(x)
        start = [{"name": "email", "email": "name"}.get(c, c) if v & 1 else c for c in NAMES if not (v & 4 and c in ("nation_id", "city"))]
        start = start[:1] + start[:0:-1] if v & 2 else start
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((no, v, len(part), sum(x is None for r in part for x in r), sha(",".join(show(r[0]) for r in part)), sha("\n".join("|".join(map(show, r)) for r in part)), ",".join(start), ",".join(NAMES), v > 0))
    return out


COLUMNS = "file_no version n_rows n_nulls ids_sha256 rows_sha256 start_columns columns rewritten".split()


def check(spark, folder):
    clients = spark.read.parquet(f"{folder}/clients.parquet")
    rows = [tuple(r) for r in clients.withColumn("updated_at", F.unix_micros(F.col("updated_at").cast("timestamp"))).select(NAMES).collect()]
    got = M.op12_migrate(spark, folder).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == expected(rows)
    assert all(r["drift"] == r["version"] for r in got)
    if got:
        where = got[0]["path"].rsplit("/", 1)[0].removeprefix("file:")
        assert sorted(os.listdir(where)) == sorted(r["path"].rsplit("/", 1)[1] for r in got)
        for r in got[:20]:
            schema = pq.read_schema(r["path"].removeprefix("file:"))
            assert [M.field_id(f) for f in schema] == list(range(1, 11)) and schema.field("nation_id").type == pa.int64()


def test_the_query(spark):
    check(spark, DATA)


def test_the_query_on_odd_clients(spark, tmp_path):
    clients = spark.read.parquet(f"{DATA}/clients.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None, None, None, None, None, None)] * 1 + [(5_000_000_000, 1, "é|x", None, "n\nm", "", "c", 3, "s" * 10_000, float("1e15"))] * 3, clients.schema)
    clients.unionByName(odd).write.parquet(f"{tmp_path}/a/clients.parquet")
    check(spark, f"{tmp_path}/a")
    clients.limit(0).write.parquet(f"{tmp_path}/b/clients.parquet")
    check(spark, f"{tmp_path}/b")


def test_cells():
    assert M._cells(pa.array([1.5, None, -0.1, float("inf"), float("nan")])) == ["1572864", "?", str(math.floor(-0.1 * 1048576)), "inf", "nan"]
    assert M._cells(pa.array(["a", None, ""])) == ["a", "?", ""] and M._cells(pa.array([1, None])) == ["1", "?"]
