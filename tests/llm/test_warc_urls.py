"""WARC archives read back and damaged; URL rules, the filter and the join."""

from __future__ import annotations

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from lodestone.llm import urls as U
from lodestone.llm import warc as W

KIND = "page_id long, url string, html string, digest string"


def expected(rows, least=100):
    first = {}
    for i, _, h, _ in rows:
        d = (h or "").encode()
        if len(d) >= least and i is not None:
            first[d] = min(i, first.get(d, i))
    out = []
    for i, _, h, _ in rows:
        d = (h or "").encode()
        to = first.get(d)
        to = None if to == i else to
        out.append((i, len(d), hashlib.sha256(d).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    big, text = "é" * 200_000, "same payload " * 20
    rows = [(5, "http://a", text, "c"), (3, "http://b\r\nX: y", text, None), (9, None, text, ""), (1, "u", None, ""), (2, "u", "", ""), (4, "u", "short", ""), (6, "u", "short", ""), (7, "u", big, ""), (8, "u", big, ""), (3, "again", text, ""), (10, "u", "a\r\n\r\nb" * 40, ""), (None, "n", text, "")]
    archives = W.write(spark.createDataFrame(rows, KIND).repartition(3), f"file://{tmp_path}/out")
    got = W.read(archives).collect()
    show = lambda r: (r["id"] and int(r["id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] and int(r["refers_to"]))
    assert sorted(map(show, got), key=str) == expected(rows)
    whole = {r["id"]: bytes(r["payload"]) for r in got if r["payload"] is not None}
    assert whole["7"] == big.encode() and whole["10"] == b"a\r\n\r\nb" * 40
    assert sum(r["records"] for r in archives.collect()) == len(rows)
    assert W.read(W.write(spark.createDataFrame([], KIND), f"file://{tmp_path}/none")).count() == 0


def test_files_are_plain_gzip_with_a_member_for_each_record(tmp_path):
    made = [W.record(b"response", [(b"WARC-Record-ID", b"<urn:x>")], b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * n) for n in (0, 5, 300_000)]
    data = b"".join(made)
    for size in (1, 7, 1 << 18):
        if size > 1 or len(data) < 5000:
            assert len(list(W.members(io.BytesIO(data), size))) == 3
    assert [len(b) - 19 for _, b in W.read_records(io.BytesIO(data))] == [0, 5, 300_000]
    assert gzip.decompress(data).count(b"WARC/1.1") == 3


@pytest.mark.parametrize("damage", ["cut", "flip", "digest", "length", "plain"])
def test_damage_is_found(damage):
    good = W.record(b"response", [(b"WARC-Payload-Digest", b"sha256:" + hashlib.sha256(b"body").hexdigest().encode())], b"HTTP/1.1 200 OK\r\n\r\nbody")
    text = gzip.decompress(good)
    bad = {"cut": good[:-9], "flip": gzip.compress(text.replace(b"body", b"bodx")), "digest": gzip.compress(text.replace(b"WARC-Payload-Digest: sha256:", b"WARC-Payload-Digest: sha256:0")), "length": gzip.compress(text.replace(b"Content-Length: 2", b"Content-Length: 1")), "plain": b"not gzip at all"}[damage]
    with pytest.raises(W.BadRecord):
        list(W.read_records(io.BytesIO(bad)))


URLS = [("http://A.Example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"), ("x://example.net/eng", "example.net", "/eng", "net/", "block"), ("h://b.net", "b.net", "", None, "allow"), ("h://b.net?x=/", "b.net", "", None, "allow"), ("h://bnet/", "bnet", "/", None, "allow"), ("h://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), ("h://myexample.com/de/", "myexample.com", "/de/", None, "allow"), ("h://x.org/fr/a#b", "x.org", "/fr/a", "org/fr/", "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("a://b.com/c://d.net/", "b.com", "/c://d.net/", None, "allow"), ("h://É.ORG/fr/\nx", "É.org", "/fr/\nx", "org/fr/", "allow"), ("http://www.Bad.com/p/?utm_source=q&b=2&a=1", "www.bad.com", "/p/", None, "block"), ("http://bad.com/p?a=1&b=3", "bad.com", "/p", None, "allow")]


def test_rules_and_listing(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, (u, *_) in enumerate(URLS)] * 2, "page_id long, url string, verdict string")
    listing = spark.createDataFrame([("https://bad.com:443/p?b=2&a=1#frag",), (None,), ("h://b.net/x",)], "url string")
    got = U.judge(pages, listing).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == URLS[r["id"]][1:]
    assert U.judge(pages, listing.limit(0)).where("listed").count() == 0
    assert U.judge(pages.limit(0), listing).count() == 0


def test_of_rules_of_one_length_the_first_wins(spark):
    page = spark.createDataFrame([("a.com", "/x/1")], "h string, p string")
    for rules in ([("block", "a.com", "/x/"), ("allow", "a.com", "/x/")], [("allow", "com", "/x/1"), ("block", "a.com", "/x")]):
        name, action = U.rule(F.col("h"), F.col("p"), rules)
        assert tuple(page.select(name, action).first()) == (rules[0][1] + rules[0][2], rules[0][0])


def test_clashing_names_stay_and_old_verdicts_go(spark):
    rows = spark.createDataFrame([("k1", "n", "w", 1, True, True), ("k2", "n", "w", 2, True, None), (None, "n", "w", 3, True, None)], "key string, name string, w0 string, block int, _maybe boolean, Listed boolean")
    got = U.listed(rows, "key", spark.createDataFrame([("k2",)], "w0 string"), "w0")
    assert got.columns == ["key", "name", "w0", "block", "_maybe", "listed"]
    assert sorted(map(tuple, got.collect()), key=str) == [("k1", "n", "w", 1, True, False), ("k2", "n", "w", 2, True, True), (None, "n", "w", 3, True, False)]


def test_the_list_is_no_test_of_hosts(spark):
    got = U.op10_urls(spark, "/root/testdata/sf0.1").where(F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, U.LISTED_HOSTS)))).groupBy("listed").count().collect()
    assert {r["listed"] for r in got} == {True, False} and min(r["count"] for r in got) > 5


@pytest.mark.parametrize("rate", [0.01, 0.999])
def test_listed_against_a_set(spark, rate):
    """Even a filter that passes nearly everything gives exact results."""
    names = [f"k{i}" for i in range(500)]
    rows = [(f"k{i}" if i % 7 else None,) for i in range(0, 2000, 3)] + [("k3",)] * 300
    got = U.listed(spark.createDataFrame(rows, "key string"), "key", spark.createDataFrame([(n,) for n in names], "n string"), "n", rate).collect()
    assert len(got) == len(rows) and all(r["listed"] == (r["key"] in names) for r in got)


def test_the_filter_passes_all_keys_and_few_others(spark):
    keys = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("k"))
    n = U.bits_for(5000)
    sieve = {r["block"]: [r[f"w{i}"] for i in range(8)] for r in U.bloom(keys, "k", n).collect()}
    tried = spark.range(10_000).select(F.concat(F.lit("u"), "id").alias("k")).select("k", U._block(F.col("k"), n).alias("b"), F.array(*U._words(F.col("k"), 7)).alias("w")).collect()
    passed = [all(x & m == m for x, m in zip(sieve.get(r["b"], [0] * 8), r["w"], strict=True)) for r in tried]
    assert all(passed[:5000]) and sum(passed[5000:]) < 250
