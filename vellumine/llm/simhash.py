"""SimHash near-duplicates by pivot distance tables.

A text's fingerprint has a bit for each of 64 positions: set if it is set in more than half the hashes of the text's
shingles. Documents with one fingerprint are a class from the start; all that follows works on distinct fingerprints.

The pivot table holds the Hamming distances (coordinates) of each distinct fingerprint to fixed reference fingerprints
(pivots); it is written once and travels with the fingerprints. By the triangle inequality, two fingerprints at distance
D or less differ by D at most in every coordinate. And of B blocks of their bits they agree in B - D or more, where
their distances to the pivots within the block are equal too. So fingerprints meet by a key made of the block coordinates
of each choice of B - D blocks: no pair within the radius is missed. Within a key, pairs whose largest coordinate
difference exceeds D are discarded, one coordinate after another, and the survivors are verified.

A key with more than GROUP fingerprints is not compared in one task: its members agree in the key's bits, so they are
dealt again by the block coordinates of the remaining bits in which they differ (one of D + 1 parts must be equal), as
often as needed. So every group shrinks each time. With D such bits or fewer it holds 2 to the power of D distinct
fingerprints at most, and is compared whatever GROUP is. From each key, a task emits a spanning forest of the links, not all pairs.
Components are found by a distributed algorithm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.common import column_name, discard, table, written
from vellumine.llm.components import connected_components

#: Shingle length in words, seed of the shingles' XXH64, and the largest distance of a link.
SHINGLE, SEED, RADIUS = 3, 42, 3

#: Pivots of the whole table, and how many of them make the block coordinates of a key.
PIVOTS, KEY_PIVOTS = 16, 24

#: The most fingerprints of one key that a task compares; pairs that are held before they are folded into a forest.
GROUP, HELD = 4096, 1 << 20

_PIVOTS = np.random.default_rng(20240229).integers(0, 1 << 64, size=max(PIVOTS, KEY_PIVOTS), dtype=np.uint64)
_ALL = (1 << 64) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    parts = [b" ".join(x) for x in zip(*(words[k:] for k in range(shingle)), strict=False)] or [b" ".join(words)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), parts), np.uint64, len(parts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every document."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select("doc_id", of(F.col("text")).alias("fingerprint"))


def parts_of(free: int, parts: int) -> list[int]:
    """The set bits of `free`, in order, as `parts` masks of sizes as equal as can be."""
    bits = [i for i in range(64) if free >> i & 1]
    cuts = [round(k * len(bits) / parts) for k in range(parts + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _mixed(key: np.ndarray, more: np.ndarray) -> np.ndarray:
    key = (key ^ more) * np.uint64(0x9E3779B97F4A7C15)
    return key ^ (key >> np.uint64(32))


def deal(prints: np.ndarray, keys: np.ndarray, free: np.ndarray, parts: int, same: int) -> tuple[np.ndarray, ...]:
    """(key, print, bits still free, row) for each choice of `same` of `parts` parts of the free bits, by block coordinates."""
    out = []
    for mask in np.unique(free):
        rows = np.flatnonzero(free == mask)
        masks = parts_of(int(mask), parts)
        x = prints[rows]
        codes = []
        for m in masks:
            code = np.zeros(len(x), np.uint64)
            for p in _PIVOTS[:KEY_PIVOTS]:
                code = _mixed(code, np.bitwise_count((x ^ p) & np.uint64(m)).astype(np.uint64) + np.uint64(1))
            codes.append(code)
        for number, chosen in enumerate(combinations(range(parts), same)):
            key = _mixed(keys[rows], np.full(len(x), number + 1, np.uint64))
            left = int(mask)
            for c in chosen:
                key = _mixed(key, codes[c])
                left &= ~masks[c] & _ALL
            out.append((key, x, np.full(len(x), left, np.uint64), rows))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (*(np.zeros(0, np.uint64),) * 3, np.zeros(0, np.int64))


def _blocks(n: int, radius: int) -> int:
    """The least number of blocks (5 at least, for a radius of 3) for which a fingerprint meets 64 others or fewer by chance."""
    b = radius + 2
    while b < 16 and comb(b, radius) * n / 2 ** (64 * (b - radius) / b) > 64:
        b += 1
    return b


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node linked to each of n nodes by the pairs."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def links_within(keys: np.ndarray, prints: np.ndarray, at_pivots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of prints, of the links between prints of one key; keys are sorted, at_pivots has a row of coordinates for each."""
    n = len(keys)
    coordinates = at_pivots.T.copy()
    ends = np.searchsorted(keys, keys, side="right")
    root, held, size = np.arange(n), [], 0
    at, step = np.arange(n), 0
    while True:
        step += 1
        at = at[at + step < ends[at]]
        if not len(at):
            break
        i = at
        for c in coordinates:
            i = i[np.abs(c[i] - c[i + step]) <= radius]
        i = i[np.bitwise_count(prints[i] ^ prints[i + step]) <= radius]
        if len(i):
            held.append((i, i + step))
            size += len(i)
        if size > HELD:
            held, size = [(np.flatnonzero(root != np.arange(n)), root[root != np.arange(n)]), *held], 0
            root, held = _forest(*(np.concatenate(x) for x in zip(*held, strict=True)), n), []
    if held:
        held.append((np.flatnonzero(root != np.arange(n)), root[root != np.arange(n)]))
        root = _forest(*(np.concatenate(x) for x in zip(*held, strict=True)), n)
    linked = np.flatnonzero(root != np.arange(n))
    return prints[linked], prints[root[linked]]


def pivot_table(distinct: DataFrame) -> DataFrame:
    """print and its distances to the pivots (one byte each), for the distinct fingerprints (one column, long)."""
    source = distinct.columns[0]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[source].to_numpy(np.int64).view(np.uint64)
            at = np.bitwise_count(x[:, None] ^ _PIVOTS[None, :PIVOTS]).astype(np.int8)
            yield pd.DataFrame({"print": pdf[source], "at": [row.tobytes() for row in at]})

    return written(distinct.mapInPandas(measure, "print long, at binary"), "simhash-pivots")


def links(distinct: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """a, b: links between the distinct fingerprints (one column, long) that connect all that are within the radius.

    Keys of more than `group` fingerprints (any number from 1 on) are dealt again.
    """
    pivots = pivot_table(distinct)
    blocks = _blocks(pivots.count(), radius)

    def dealt(how):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                at = pdf["at"].to_numpy()
                key, x, free, row = how(*(pdf[c].to_numpy(np.int64).view(np.uint64) if c in pdf else None for c in ("print", "key", "free")))
                yield pd.DataFrame({"key": key.view(np.int64), "print": x.view(np.int64), "free": free.view(np.int64), "at": at[row]})

        return run

    def first(x, key, free):
        return deal(x, np.zeros(len(x), np.uint64), np.full(len(x), _ALL, np.uint64), blocks, blocks - radius)

    def again(x, key, free):
        return deal(x, key, free, radius + 1, 1)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf])
            whole = pdf["key"].to_numpy() != pdf["key"].to_numpy()[-1] if len(pdf) else np.zeros(0, bool)
            rest = pdf[~whole]
            yield _links(pdf[whole], radius)
        if rest is not None:
            yield _links(rest, radius)

    schema = "key long, print long, free long, at binary"
    rows = written(pivots.mapInPandas(dealt(first), schema), "simhash-keys")
    found = None
    while True:
        vary = F.bit_or("print").bitwiseAND(F.bitwise_not(F.bit_and("print")))  # dealing by bits that are equal in all would part nobody
        large = rows.groupBy("key").agg(F.count("*").alias("many"), F.bit_or("free").bitwiseAND(vary).alias("vary"))
        large = written(large.filter((F.col("many") > group) & (F.bit_count("vary") > radius)).select("key", "vary"), "simhash-large")
        any_large = bool(large.limit(1).count())
        small = rows.join(large, "key", "left_anti") if any_large else rows
        part = small.select("key", "print", "at").repartition("key").sortWithinPartitions("key").mapInPandas(compare, "a long, b long")
        part = written(part.distinct(), "simhash-links")
        found = part if found is None else found.unionByName(part)
        if not any_large:
            discard(pivots, rows, large)
            return found
        open_ = rows.join(large, "key").select("key", "print", F.col("free").bitwiseAND(F.col("vary")).alias("free"), "at")
        before, rows = rows, written(open_.mapInPandas(dealt(again), schema), "simhash-keys")
        discard(before, large)


def _links(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    at = np.frombuffer(b"".join(pdf["at"]), np.int8).reshape(len(pdf), PIVOTS)
    a, b = links_within(pdf["key"].to_numpy(), pdf["print"].to_numpy(np.int64).view(np.uint64), at, radius)
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (long), component_id: the smallest doc_id that links reach, of every document.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows with a null doc_id belong to their
    component but never name it; a component of such rows alone has a null id. Repeated rows stay; an empty table
    gives an empty result; further columns of docs are ignored.
    """
    prints = written(fingerprints(docs, shingle), "simhash-prints")
    classes = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = written(connected_components(links(classes.select("fingerprint"), radius)), "simhash-roots")
    linked = classes.join(roots, classes.fingerprint == roots.node).select("fingerprint", "component", "first")
    smallest = written(linked.groupBy("component").agg(F.min("first").alias("least")), "simhash-least")
    named = linked.join(smallest, "component").select(F.col("fingerprint").alias("_print"), "least")
    all_ = classes.join(named, classes.fingerprint == F.col("_print"), "left").select(F.col("fingerprint").alias("_print"), F.coalesce("least", "first").alias("component_id"))
    all_ = written(all_, "simhash-named")
    return prints.join(all_, prints.fingerprint == all_._print, "left").select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """docs without near-duplicates: of each component one row, with all columns of docs.

    That is the row with the smallest doc_id, null after all others; of several rows with that doc_id, one whose text
    has the smallest hash. A component is named by its smallest fingerprint, so neither null nor repeated doc_ids mix
    components: rows of one doc_id with unlike texts are judged apart.
    """
    hashes = [F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")]
    key = ["doc_id", "h", "g"]
    rows = docs.select("doc_id", "text")
    prints = written(fingerprints(rows.select(F.struct("doc_id", *hashes).alias("doc_id"), "text"), shingle), "simhash-prints").select("doc_id.*", "fingerprint")
    classes = written(prints.groupBy(*key, "fingerprint").agg(F.count("*").alias("n")), "simhash-classes")
    roots = written(connected_components(links(classes.select("fingerprint").distinct(), radius)), "simhash-roots")
    named = classes.join(roots, classes.fingerprint == roots.node, "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = F.min(F.struct(F.isnull("doc_id").alias("no_id"), *key, "n")).alias("x")
    first = written(named.groupBy("component").agg(least).select("component", "x.*"), "simhash-first")

    one, many, id_, h, g = (column_name(docs, c) for c in ("component", "n", "id", "h", "g"))
    first = first.select(F.col("component").alias(one), F.col("n").alias(many), F.col("doc_id").alias(id_), F.col("h").alias(h), F.col("g").alias(g))
    same = docs["doc_id"].eqNullSafe(first[id_]) & (F.xxhash64(docs["text"]) == first[h]) & (F.xxhash64(F.lit(1), docs["text"]) == first[g])
    kept = written(docs.join(first, same).select(*[docs[c] for c in docs.columns], one, many), "simhash-kept")
    once, rest = kept.filter(F.col(many) == 1), kept.filter(F.col(many) > 1)
    row = F.struct(*docs.columns)
    chosen = rest.groupBy(one).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_row")).select("_row.*")
    return once.select(*docs.columns).unionByName(chosen.select(*docs.columns))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash": op3_simhash}
ORACLES: dict[str, str] = {}
