"""The pipeline's stages, on small rows and as a whole; the registered queries that SQL can express."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline as C
from lodestone.llm.queries import QUERIES, SQL

KIND = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "conversations", "benchmark", "labels")


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    start, before = docs.count(), docs
    for name, stage in C.STAGES[:-1]:
        after = stage(spark, before, DATA).checkpoint()
        assert after.columns == docs.columns and after.exceptAll(before).count() == 0, name
        before = after
    assert 0.4 * start < before.count() < start
    assert before.select("text").distinct().count() == before.count()
    packed = C.STAGES[-1][1](spark, before, DATA)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in before.select("doc_id").collect()}
    assert C.run(spark, DATA).count() == packed.count()


def test_what_each_stage_drops(spark):
    prose = [" ".join(f"{w}{i * j % 7}{'aeiou'[j % 5]}" for j, w in enumerate("the of and to in that is was he for it with as his on be at by had not".split() * 5)) for i in range(1, 5)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(prose)] + [(10, prose[0], "en", "s", 0), (11, "12345 " * 90, "en", "s", 0), (12, None, "en", "s", 0), (13, "too short", None, None, None), (14, "again and again " * 40, "en", "s", 0)]
    docs = spark.createDataFrame(rows, KIND)
    told = C.language(spark, docs, DATA)
    assert {r["doc_id"] for r in told.collect()} == {0, 1, 2, 3, 10, 13, 14}
    good = C.rules(spark, told, DATA)
    assert {r["doc_id"] for r in good.collect()} == {0, 1, 2, 3, 10}
    assert {r["doc_id"] for r in C.near_copies(spark, good, DATA).collect()} == {0, 1, 2, 3}


def test_clashing_names_stay(spark):
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, "en", "s", 0, "a", "b", "c"), (1, text, "en", "s", 0, "a", "b", "c"), (2, text + " more", "en", "s", 0, None, None, None)], KIND + ", _told string, _quality string, _fp string")
    docs = docs.withColumns({"_row": docs.doc_id, "_kept": docs.doc_id, "_k": docs.doc_id, "_g": docs.doc_id, "fp": docs.doc_id})
    for _, stage in C.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == docs.columns and after.exceptAll(docs).count() == 0
        docs = after
    assert docs.count() in (1, 2) and docs.where("doc_id = 1").count() == 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], KIND)
    for _, stage in C.STAGES:
        assert stage(spark, docs, DATA).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, DATA).toArrow().to_pydict(), db.sql(SQL[name]).to_arrow_table().to_pydict()
    rows = lambda t: sorted(map(str, zip(*(t[c] for c in sorted(t)), strict=True)))
    assert sorted(ours) == sorted(theirs) and rows(ours) == rows(theirs)
