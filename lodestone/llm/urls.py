"""URL rules, and a blocked Bloom filter before an exact join for listed URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

#: (action, host, path) rules of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Query parameters that do not tell pages apart; those starting with utm_ don't either.
TRACKING = ("ref", "fbclid", "gclid")
#: Host labels of which the query's list holds pages: single ones, not all.
LISTED_HOSTS = ("spam-farm", "cheap-pills", "free-bets", "adult-x")
#: First digits of the MD5 of the canonical URLs among these that were reported.
REPORTED = "01234567"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without trailing slashes or index page, and the remaining query in order; null without a host.

    Scheme, user, port 80 or 443 and fragment are dropped, as are tracking parameters.
    """
    name = F.regexp_replace(F.regexp_replace(host(url), r"^.*@", ""), r":(?:80|443)?$", "")
    name = F.regexp_replace(name, r"^www\.", "")
    place = F.regexp_replace(F.regexp_replace(path(url), r"/index\.html?$", "/"), r"/+$", "")
    asked = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(asked, "&"), lambda p: ~(p.startswith("utm_") | F.split_part(p, F.lit("="), F.lit(1)).isin(*TRACKING)) & (p != ""))), "&")
    return F.when(name != "", F.concat(name, place, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(name, action) of the longest rule that fits, by host and path together; null where none does.

    A rule fits its host and all subdomains, if the path starts with the rule's. Of two of one
    length the first wins.
    """
    name = action = F.lit(None).cast("string")
    # The last that fits is taken: the longest, and of equals the first given.
    for act, h, p in sorted(reversed(tuple(rules)), key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def bits_for(n: int, rate: float = 0.01) -> int:
    """Blocks of 512 bits for n keys: about 12 bits a key at one in a hundred, doubled for each square of it."""
    import math

    return max(1, math.ceil(n * 1.44 * math.log2(1 / rate) * 1.25 / 512))


def _words(key: Column, hashes: int) -> list[Column]:
    """The eight 64-bit words of a key's block mask: ``hashes`` bits, each from nine bits of a second hash."""
    h = F.xxhash64(key, F.lit(1))
    spots = [F.shiftrightunsigned(h, 9 * i).bitwiseAND(F.lit(511)) for i in range(hashes)]
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), s.bitwiseAND(F.lit(63)).cast("int")) for s in spots]
    out = []
    for w in range(8):
        word = F.lit(0).cast("long")
        for s, b in zip(spots, bit, strict=True):
            word = word.bitwiseOR(F.when(F.shiftrightunsigned(s, 6) == w, b).otherwise(F.lit(0).cast("long")))
        out.append(word)
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(blocks).cast("long"))


def bloom(keys: DataFrame, key: str, blocks: int, hashes: int = 7) -> DataFrame:
    """A blocked Bloom filter as a table: (block, w0 to w7), at most ``blocks`` rows of 72 bytes."""
    at = keys.select(_block(F.col(key), blocks).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(_words(F.col(key), hashes))])
    return at.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])


#: Filters of up to so many blocks (of 72 bytes, 36 MB) are broadcast; larger ones are joined by block.
BROADCAST_BLOCKS = 1 << 19


def listed(urls: DataFrame, key: str, listing: DataFrame, listing_key: str, rate: float = 0.01, hashes: int = 7, to: str = "listed") -> DataFrame:
    """``urls`` with a boolean column ``to``, in place of any of that name: whether its ``key`` is among ``listing_key``. Null keys are not listed.

    The list is made distinct and put in a blocked Bloom filter sized for it; rows that the filter
    can't exclude, and only those, go through an exact hash join with the list.
    """
    kept = [F.col(f"`{c}`") for c in urls.columns if c.lower() != to.lower()]
    name, block, may = (free(urls, x) for x in ("_name", "_block", "_maybe"))
    masks = [free(urls, f"_w{i}") for i in range(8)]
    names = listing.select(F.col(listing_key).alias(name)).where(F.col(name).isNotNull()).distinct()
    blocks = bits_for(names.count(), rate)
    sieve = bloom(names, name, blocks, hashes).select(F.col("block").alias(block), *[F.col(f"w{i}").alias(m) for i, m in enumerate(masks)])
    sieve = F.broadcast(sieve) if blocks <= BROADCAST_BLOCKS else sieve
    tried = urls.withColumn(block, _block(F.col(key), blocks)).join(sieve, block, "left")
    maybe = F.col(key).isNotNull()
    for own, m in zip(masks, _words(F.col(key), hashes), strict=True):
        maybe = maybe & (F.coalesce(F.col(own), F.lit(0)).bitwiseAND(m) == m)
    probe = tried.withColumn(may, maybe)
    # Only possible hits are joined; nulls are none, and are not gathered anywhere.
    hits = probe.where(F.col(may)).join(names, F.col(key) == F.col(name), "left").select(*kept, F.col(name).isNotNull().alias(to))
    return hits.unionByName(probe.where(~F.col(may)).select(*kept, F.lit(False).alias(to)))


def judge(pages: DataFrame, listing: DataFrame, id_col: str = "page_id", url_col: str = "url", listing_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, listed) for every row: the rule's action, else block just if its canonical URL is listed.

    ``listing`` holds raw URLs in ``listing_col``. Null URLs and those without ``://`` have empty host and path, no rule, and
    are allowed. Repeated rows stay, an empty table gives no rows, an empty list blocks nothing.
    """
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("id"), host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canonical"))
    found = listed(base, "canonical", listing.select(canonical(F.col(listing_col)).alias("name")), "name")
    name, action = rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return found.select("id", "host", "path", name.alias("rule"), verdict.alias("verdict"), "listed")


def op10_urls(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 10 over all of ``pages``.

    The list holds single URLs of LISTED_HOSTS, those reported, as REPORTED says. It has them in
    another spelling than the pages do, and no other page of these hosts is on it.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    own = canonical(F.col("url"))
    bad = F.arrays_overlap(F.split(host(F.col("url")), r"\."), F.array(*map(F.lit, LISTED_HOSTS)))
    reported = pages.where(bad & F.substring(F.md5(own.cast("binary")), 1, 1).isin(*REPORTED))
    listing = reported.select(F.concat(F.lit("HTTPS://WWW."), own, F.lit("#reported")).alias("url"))
    return judge(pages, listing).withColumnRenamed("id", "page_id")


#: DuckDB SQL of op10_urls.
OP10_SQL = r"""
WITH base AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '') AS asked
  FROM pages
), named AS (
  SELECT *,
    regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(?:80|443)?$', ''), '^www\.', '') AS name,
    regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '/+$', '') AS place,
    array_to_string(list_sort(list_filter(string_split(asked, '&'), lambda p: NOT (starts_with(p, 'utm_') OR split_part(p, '=', 1) IN ('ref', 'fbclid', 'gclid')) AND p <> '')), '&') AS kept
  FROM base
), canon AS (
  SELECT *, CASE WHEN name <> '' THEN name || place || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical FROM named
), listing AS (
  SELECT DISTINCT canonical FROM canon
  WHERE canonical IS NOT NULL AND list_has_any(string_split(host, '.'), ['spam-farm', 'cheap-pills', 'free-bets', 'adult-x']) AND left(md5(canonical), 1) <= '7'
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM canon
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN canonical IN (SELECT canonical FROM listing) THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(canonical IN (SELECT canonical FROM listing), FALSE) AS listed
FROM ruled
"""
