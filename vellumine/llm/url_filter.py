"""Exact URL filtering by a cascade of Bloom filters over the corpus's own keys.

A rule is a host followed by a path prefix, written as one string ("example.net/en/"); a listed host is a rule
without a path. A url has few keys that a rule could equal: each suffix of its host at a label boundary, with
each path prefix of a length that some rule has. All distinct keys of the corpus are the universe. Level 0 of a
cascade holds the listed keys, level 1 the other keys that level 0 lets through, level 2 the listed keys that
level 1 lets through, and so on until a level lets nothing through. Over the universe, membership is then exact:
the first level that rejects a key decides, by whether its number is odd or even. Pages are judged without a
join, by the key hashes and the filters' bits alone.

Building works on a written table of key hashes, one Spark job for each level; the driver gets only the bits, at
most MAX_BYTES of them. Beyond that size the same keys are looked up by a join instead (`judge(..., max_bytes)`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.common import column_name, lower_ascii, table, written

#: The most bytes of filters that are broadcast.
MAX_BYTES = 64 << 20

ALLOW, BLOCK = "allow", "block"

#: The query's rules.
RULES = (("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW))

#: The query's listed hosts: what the method itself blocks where no rule speaks.
LISTED = tuple(f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null or where there is no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def candidate_keys(host: Column, path: Column, path_lengths: Sequence[int], most_labels: int) -> Column:
    """The keys of a url that a rule could equal, longest first within a host suffix.

    No rule or listed host has more than most_labels labels, so longer suffixes of a host equal none; without that bound
    the suffixes of a host of very many labels would add up to the square of its length.
    """
    labels = F.slice(F.reverse(F.split(host, r"\.", -1)), 1, most_labels)
    labels = F.reverse(labels)
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    heads = F.filter(
        F.array(*[F.when(F.length(path) >= k, F.substr(path, F.lit(1), F.lit(k))) for k in sorted(path_lengths, reverse=True)]),
        lambda p: p.isNotNull(),
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.concat(s, p))))


def _spread(h1: np.ndarray, h2: np.ndarray, level: int, hashes: int, bits: int) -> np.ndarray:
    """The bits of each key at a level, one row for each hash function."""
    step = (h2 ^ np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) | np.uint64(1)
    with np.errstate(over="ignore"):
        at = h1[None, :] + np.arange(1, hashes + 1, dtype=np.uint64)[:, None] * step[None, :]
        at ^= at >> np.uint64(31)
        at *= np.uint64(0xBF58476D1CE4E5B9)
        at ^= at >> np.uint64(29)
    return at % np.uint64(bits)


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its size in bits, its number of hash functions and its 64-bit words."""

    bits: int
    hashes: int
    words: np.ndarray

    def has(self, h1: np.ndarray, h2: np.ndarray, number: int) -> np.ndarray:
        at = _spread(h1, h2, number, self.hashes, self.bits)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


@dataclass(frozen=True)
class Cascade:
    """Filters of alternating polarity; exact for every key of the universe that it was built over."""

    levels: tuple[Level, ...]

    @property
    def bytes(self) -> int:
        return sum(x.words.nbytes for x in self.levels)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Membership of the keys with these two 64-bit hashes."""
        out, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
        for number, level in enumerate(self.levels):
            passed = level.has(h1[open_], h2[open_], number)
            out[open_[~passed]] = number % 2 == 1
            open_ = open_[passed]
        out[open_] = len(self.levels) % 2 == 1
        return out


def _sized(n: int, rate: float) -> tuple[int, int]:
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return 64 * math.ceil(bits / 64), max(1, round(bits / max(n, 1) * math.log(2)) if n * 20 > bits else math.ceil(-math.log2(rate)))


class TooLarge(Exception):
    """The filters would be larger than the given bound."""


def _bits_set(keys: DataFrame, level: int, hashes: int, bits: int) -> np.ndarray:
    """The words of a filter that holds `keys`: positions are set by word on the executors; the driver gets the words."""

    def positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = _spread(pdf["h1"].to_numpy(np.int64).view(np.uint64), pdf["h2"].to_numpy(np.int64).view(np.uint64), level, hashes, bits).ravel()
            bit = np.left_shift(np.uint64(1), at & np.uint64(63))
            yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "bit": bit.view(np.int64)})

    words = np.zeros(bits // 64, np.int64)
    found = keys.select("h1", "h2").mapInPandas(positions, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    words[found["word"].to_numpy()] = found["bit"].to_numpy()
    return words.view(np.uint64)


def build_cascade(universe: DataFrame, listed: str, max_bytes: int = MAX_BYTES) -> Cascade:
    """The cascade of the keys of `universe` (h1 long, h2 long, and the boolean column `listed`) that are listed.

    universe should be a written table: it is read once for each level. Raises TooLarge beyond max_bytes.
    """
    counts = universe.groupBy(listed).count().collect()
    n = {bool(r[0]): r[1] for r in counts}
    inside, outside = n.get(True, 0), n.get(False, 0)
    levels: list[Level] = []
    if not inside:
        return Cascade(())
    rate, size = max(1e-9, min(0.5, inside / (math.sqrt(2) * max(outside, 1)))), inside
    while size:
        number = len(levels)
        bits, hashes = _sized(size, rate)
        if sum(x.words.nbytes for x in levels) + bits // 8 > max_bytes:
            raise TooLarge(f"{bits // 8} bytes at level {number}")
        holds = number % 2 == 0
        entered = _passing(universe.filter(F.col(listed) == holds), levels, from_level=holds)
        levels.append(Level(bits, hashes, _bits_set(entered, number, hashes, bits)))
        size = _passing(universe.filter(F.col(listed) == (not holds)), levels, from_level=not holds).count()
        rate = 0.5
    return Cascade(tuple(levels))


def _passing(keys: DataFrame, levels: list[Level], from_level: bool) -> DataFrame:
    """The keys that every filter of the other polarity lets through (their own always do)."""
    others = [(i, x) for i, x in enumerate(levels) if (i % 2 == 0) != from_level]

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h1, h2 = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
            ok = np.ones(len(pdf), bool)
            for number, level in others:
                ok &= level.has(h1, h2, number)
            yield pdf[ok]

    return keys.select("h1", "h2").mapInPandas(keep, "h1 long, h2 long") if others else keys.select("h1", "h2")


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    listed: DataFrame | None = None,
    url: str = "url",
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: (host and path prefix as one string, "allow" or "block"); the longest that fits decides. Where none
    fits, a page is blocked if its host or a parent domain is among `listed` (one string column of hosts), else
    allowed. Null urls and urls without "://" have empty host and path and are allowed. Repeated rows stay as
    they are; an empty table gives an empty result. Columns of pages that share a name with a new one are
    replaced by it; all others stay.
    """
    spark = pages.sparkSession
    wrong = [v for _, v in rules if v not in (ALLOW, BLOCK)]
    if wrong:
        raise ValueError(f"a rule's verdict is allow or block, not {wrong[0]}")
    split_at = lambda rule: rule.find("/") if "/" in rule else len(rule)
    lengths = sorted({0, *(len(r) - split_at(r) for r, _ in rules)})
    host, path = host_and_path(F.col(url))
    own, hidden = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")], column_name(pages, "keys")
    most = max([1, *(r[: split_at(r)].count(".") + 1 for r, _ in rules)])
    if listed is not None:
        most = max(most, listed.agg(F.max(F.size(F.split(F.col(listed.columns[0]), r"\.", -1)))).first()[0] or 1)
    keyed = pages.withColumns({"host": host, "path": path}).withColumn(hidden, candidate_keys(F.col("host"), F.col("path"), lengths, most))

    known = spark.createDataFrame([(r, v == ALLOW, False) for r, v in rules], "key string, allowed boolean, on_list boolean").distinct()
    if listed is not None:
        hosts = listed.select(lower_ascii(F.col(listed.columns[0])).alias("key")).filter(F.col("key").isNotNull())
        known = known.unionByName(hosts.select("key", F.lit(None).cast("boolean").alias("allowed"), F.lit(True).alias("on_list")))
    known = known.groupBy("key").agg(F.bool_or("allowed").alias("allowed"), F.bool_or("on_list").alias("on_list"))
    distinct = keyed.select(F.explode(hidden).alias("key")).distinct()
    universe = distinct.join(known, "key", "left").select(
        "key",
        F.xxhash64("key").alias("h1"),
        F.xxhash64("key", F.lit("second")).alias("h2"),
        F.col("allowed").isNotNull().alias("is_rule"),
        F.coalesce("allowed", F.lit(False)).alias("is_allow"),
        F.coalesce("on_list", F.lit(False)).alias("is_listed"),
    )
    universe = written(universe, "url-keys")
    try:
        left = max_bytes
        cascades = []
        for c in ("is_rule", "is_allow", "is_listed"):
            cascades.append(build_cascade(universe, c, left))
            left -= cascades[-1].bytes
    except TooLarge:
        return _judged_by_join(keyed, universe, hidden, own)
    at = spark.sparkContext.broadcast(cascades)

    @F.pandas_udf("array<byte>")
    def flags(h1: pd.Series, h2: pd.Series) -> pd.Series:
        sizes = h1.map(len).to_numpy()
        a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64).view(np.uint64) for x in (h1, h2))
        bits = sum(c.has(a, b).astype(np.int8) << i for i, c in enumerate(at.value))
        return pd.Series(np.split(bits, np.cumsum(sizes)[:-1]) if len(sizes) else [])

    h1 = F.transform(hidden, lambda k: F.xxhash64(k))
    h2 = F.transform(hidden, lambda k: F.xxhash64(k, F.lit("second")))
    marked = keyed.withColumn(f"{hidden}_f", flags(h1, h2))
    hits = F.filter(F.zip_with(hidden, f"{hidden}_f", lambda k, f: F.struct(F.length(k).alias("n"), k.alias("key"), f.alias("f"))), lambda x: x["f"] > 0)
    return _verdict(marked.withColumn(f"{hidden}_h", hits), f"{hidden}_h", own)


def _verdict(marked: DataFrame, hits: str, own: list[str]) -> DataFrame:
    """Rule and verdict from the keys found; their flags are 1: a rule, 2: an allowing rule, 4: a listed host."""
    best = F.array_max(F.filter(hits, lambda x: x["f"].bitwiseAND(F.lit(1)) > 0))
    on_list = F.exists(hits, lambda x: x["f"].bitwiseAND(F.lit(4)) > 0)
    verdict = (
        F.when(best["f"].bitwiseAND(F.lit(2)) > 0, F.lit(ALLOW))
        .when(best["f"].isNotNull(), F.lit(BLOCK))
        .when(on_list, F.lit(BLOCK))
        .otherwise(F.lit(ALLOW))
    )
    return marked.select(*own, "host", "path", best["key"].alias("rule"), verdict.alias("verdict"))


def _judged_by_join(keyed: DataFrame, universe: DataFrame, keys: str, own: list[str]) -> DataFrame:
    """The same verdicts through a join on the keys, for filters too large to broadcast."""
    hit = universe.filter("is_rule or is_listed").select(
        F.col("key").alias("_key"),
        (F.col("is_rule").cast("int") + 2 * F.col("is_allow").cast("int") + 4 * F.col("is_listed").cast("int")).alias("_f"),
    )
    row = keyed.withColumn("_row", F.struct(*[F.col(c) for c in keyed.columns if c != keys])).withColumn("_id", F.monotonically_increasing_id())
    row = written(row.select("_id", "_row", keys), "url-rows")
    found = (
        row.select("_id", F.explode(keys).alias("_key"))
        .join(hit, "_key")
        .groupBy("_id")
        .agg(F.collect_set(F.struct(F.length("_key").alias("n"), F.col("_key").alias("key"), F.col("_f").alias("f"))).alias("_hits"))
    )
    joined = row.join(found, "_id", "left").withColumn("_hits", F.coalesce("_hits", F.array().cast("array<struct<n:int,key:string,f:int>>")))
    return _verdict(joined.select("_row.*", "_hits"), "_hits", own)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(h,) for h in LISTED], "host string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, listed).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op1_url_filter": op1_url_filter}

_HOSTS = ", ".join(f"('{h}')" for h in LISTED)
_RULES = ", ".join(f"('{r}', '{v}')" for r, v in RULES)
ORACLES = {
    "op1_url_filter": rf"""
        with rules(rule, verdict) as (values {_RULES}), listed(name) as (values {_HOSTS}),
        cut as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
        parts as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from cut),
        urls as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from parts),
        kinds as (select distinct host, left(path, 4) as head from urls),
        fits as (select host, head, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
                 from kinds join rules on (host = split_part(rule, '/', 1) or host like '%.' || split_part(rule, '/', 1))
                                      and starts_with(head, substr(rule, position('/' in rule)))
                 group by host, head),
        bad as (select distinct host from kinds join listed on host = name or host like '%.' || name)
        select page_id, u.host, path, rule, coalesce(verdict, case when b.host is not null then 'block' else 'allow' end) as verdict
        from urls u left join fits f on u.host = f.host and left(u.path, 4) = f.head left join bad b on b.host = u.host""",
}
