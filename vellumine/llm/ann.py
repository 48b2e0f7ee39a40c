"""Nearest neighbours by an inverted file with product-quantised residuals and exact reranking.

Fitted on a bounded sample: coarse centroids, and for each of PARTS slices of the residuals (vector minus centroid) a
codebook. Every vector is in the list of its nearest centroid, with its residual as PARTS code bytes. A query visits
the lists of its nearest centroids; there, a table of squared distances from each slice of its residual to each
codeword gives the approximate distance of every code by PARTS look-ups. The best RERANK of a block are measured
exactly, in double precision, on the original vectors; then so is every other vector that the approximate distance less
the vector's own quantisation error does not put beyond the last one needed. So within the visited lists nothing is
missed, however many vectors share a code. How many lists a query visits is calibrated on the sample, by the lists that
hold the true neighbours of some of its vectors within the sample, for a target recall; neighbours in a sample are
farther apart than in the table, so that errs on the side of more lists. A query whose lists hold too few rows visits
further ones until they hold enough.

Equal vectors are one class with its k + 1 smallest ids, as no query needs more of them; so a vector that a third of
all rows have costs one row. Lists are split into blocks of bounded size, and the queries of a list into blocks too; a
block of vectors meets a block of queries in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.llm.common import table, written

#: The most vectors that the index is fitted on, the most lists, slices of a residual, codewords of a slice.
SAMPLE, MOST_LISTS, PARTS, CODEWORDS = 20_000, 1024, 16, 256

#: Sampled vectors on which the number of lists and the cosine are calibrated, and the recall that each aims at.
CALIBRATION, TARGET_RECALL, TARGET_COSINE = 200, 0.97, 0.98

#: Candidates of a block that are measured first; the least and most rows of a block; queries of a block.
RERANK, LEAST_BLOCK, MOST_BLOCK, QUERY_BLOCK = 32, 256, 8192, 2048

#: Queries that are compared together, and pairs that are measured together.
TOGETHER, PAIRS = 64, 1 << 16

NEIGHBOURS = 10


@dataclass(frozen=True)
class Index:
    """What is fitted: centroids, codebooks by slice, lists to visit, and the cosine that bounds distances by codes."""

    centroids: np.ndarray
    books: list[np.ndarray]
    probes: int
    cosine: float = 1.0

    def away(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of each vector to the centroids, less the vector's own square."""
        return (self.centroids**2).sum(axis=1)[None, :] - 2 * x @ self.centroids.T

    def nearest_lists(self, x: np.ndarray, many: int = 1) -> np.ndarray:
        d = self.away(x)
        if many == 1:
            return d.argmin(axis=1)[:, None]
        many = min(many, len(self.centroids))
        return np.argpartition(d, many - 1, axis=1)[:, :many]

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        parts = np.array_split(x - self.centroids[lists], len(self.books), axis=1)
        return np.stack([_nearest(p, b) for p, b in zip(parts, self.books, strict=True)], axis=1).astype(np.uint8)

    def lists_with(self, x: np.ndarray, held: np.ndarray, needed: np.ndarray) -> list[np.ndarray]:
        """The lists that each vector visits: the nearest `probes`, or as many as hold `needed` rows (held: rows of a list)."""
        d, out = self.away(x), list(self.nearest_lists(x, self.probes))
        for i, n in enumerate(needed):
            if held[out[i]].sum() < n:
                order = np.argsort(d[i], kind="stable")
                out[i] = order[: max(self.probes, np.searchsorted(held[order].cumsum(), n) + 1)]
        return out

    def decoded(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What codes stand for."""
        return self.centroids[lists] + np.concatenate([b[codes[:, s]] for s, b in enumerate(self.books)], axis=1).astype(np.float64)

    def errors(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The distance of each vector to what its code stands for."""
        return np.sqrt(((x - self.decoded(lists, codes)) ** 2).sum(axis=1))

    def may_be_within(self, last: np.ndarray | float, root: np.ndarray, error: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """Whether vectors at `root` by their codes, with these errors, may be as near as `last`."""
        possible = ~(np.abs(root - error) - slack > last) | ~np.isfinite(root)
        likely = ~(np.sqrt(np.maximum(root**2 + error**2 - 2 * self.cosine * root * error, 0.0)) - slack > last)
        return possible & (likely | (last < error / 2))

    def measured(self, q: np.ndarray, number: int, x: np.ndarray, codes: np.ndarray, error: np.ndarray, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of each query to the vectors of a list, infinite where codes rule them out, and the needed-th least of each.

        The best by their codes are measured first, then all that may still be as near as the last one needed.
        """
        tables, about = self.tables(q.astype(np.float32), number), np.zeros((len(q), len(x)), np.float32)
        for s in range(codes.shape[1]):
            about += tables[:, s, :][:, codes[:, s]]
        exact = np.full(about.shape, np.inf)

        def measure(rows: np.ndarray, cols: np.ndarray) -> None:
            for a in range(0, len(rows), PAIRS):
                r, c = rows[a : a + PAIRS], cols[a : a + PAIRS]
                exact[r, c] = np.sqrt(((x[c] - q[r]) ** 2).sum(axis=1))

        def last() -> np.ndarray:
            found = np.zeros(len(q))
            for n in np.unique(needed):
                found[needed == n] = np.partition(exact[needed == n], n - 1, axis=1)[:, n - 1]
            return found

        many = min(max(RERANK, int(needed.max())), len(x))
        best = np.argpartition(about, many - 1, axis=1)[:, :many]
        measure(np.repeat(np.arange(len(q)), many), best.ravel())
        if many < len(x):
            root, size = np.sqrt(about.astype(np.float64)), np.sqrt((self.centroids[number].astype(np.float64) ** 2).sum())
            slack = 1e-5 * (root + error) + 1e-6 * (size + np.sqrt((q**2).sum(axis=1)))[:, None]  # single precision
            measure(*np.nonzero(np.isinf(exact) & self.may_be_within(last()[:, None], root, error, slack)))
        return exact, last()

    def tables(self, q: np.ndarray, number: int) -> np.ndarray:
        """Squared distances of each query's residual in this list to the codewords: queries, slices, codewords."""
        out = np.full((len(q), len(self.books), CODEWORDS), np.inf, np.float32)
        for s, (p, b) in enumerate(zip(np.array_split(q - self.centroids[number], len(self.books), axis=1), self.books, strict=True)):
            out[:, s, : len(b)] = ((p[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres**2).sum(axis=1)[None, :]
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (half - 2 * x[at : at + 4096] @ centres.T).argmin(axis=1)
    return out


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        order, n = np.argsort(at, kind="stable"), np.bincount(at, minlength=len(centres))
        full = np.flatnonzero(n)
        centres[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0) / n[full, None]
    return centres


def fit(sample: np.ndarray, n: int, k: int = NEIGHBOURS, target: float = TARGET_RECALL) -> Index:
    """An index for n vectors, fitted on the sample (one row each)."""
    x, rng = sample.astype(np.float32), np.random.default_rng(7)
    lists = int(max(1, min(MOST_LISTS, round(math.sqrt(n)), len(x))))
    centroids = _kmeans(x, lists, 10, rng)
    at = _nearest(x, centroids)
    parts = min(PARTS, x.shape[1])
    books = [_kmeans(np.ascontiguousarray(p), min(CODEWORDS, len(x)), 8, rng) for p in np.array_split(x - centroids[at], parts, axis=1)]
    queries = rng.permutation(len(x))[:CALIBRATION]
    d = (x**2).sum(axis=1)[None, :] - 2 * x[queries] @ x.T
    d[np.arange(len(queries)), queries] = np.inf
    k = min(k, max(1, len(x) - 1))
    true = np.argpartition(d, k - 1, axis=1)[:, :k]
    away = (centroids**2).sum(axis=1)[None, :] - 2 * x[queries] @ centroids.T
    place = np.argsort(np.argsort(away, axis=1), axis=1)
    needed = np.sort(place[np.arange(len(queries))[:, None], at[true]].ravel())
    probes = int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)]) + 1 if len(x) > 1 else 1
    index = Index(centroids, books, probes)
    if len(x) < 2:
        return index
    coded = index.decoded(at[true.ravel()], index.encode(x[true.ravel()], at[true.ravel()]))
    asked, found = np.repeat(x[queries], k, axis=0).astype(np.float64), x[true.ravel()].astype(np.float64)
    u, e = asked - coded, found - coded
    error = np.sqrt((e**2).sum(axis=1))
    apart = np.sqrt(((asked - found) ** 2).sum(axis=1)) >= error / 2
    cosines = (u * e).sum(axis=1)[apart] / np.maximum(np.sqrt((u**2).sum(axis=1)) * error, 1e-30)[apart]
    return replace(index, cosine=float(np.clip(np.quantile(cosines, TARGET_COSINE), 0.0, 1.0)) if len(cosines) else 1.0)


def valid_vectors(vectors: DataFrame, id_: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and vec of the rows that take part.

    Out are null ids, vectors that are null, all zero, or hold a null, NaN or infinite component, and vectors of
    another length than the most frequent one (of two as frequent, the longer).
    """
    v = F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = vectors.select(F.col(id_).cast("long").alias("vec_id"), v.alias("vec")).filter(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("vec", lambda x: x != 0)
    )
    size = ok.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return ok.filter(F.size("vec") == (size["n"] if size else 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def search(vectors: DataFrame, is_query, k: int = NEIGHBOURS, target: float = TARGET_RECALL, id_: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors found for each query, nearest first, ties to the smaller id.

    is_query: a condition on vec_id. All rows but those with the query's own id are candidates. score is the Euclidean
    distance in double precision. Rows alike in id and vector count once. An empty table, or one without queries, gives
    an empty result; other columns of vectors are ignored.
    """
    spark = vectors.sparkSession
    rows = written(valid_vectors(vectors, id_, embedding), "ann-vectors")
    order = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    classes = few.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = written(classes, "ann-classes")
    n = classes.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    sample = _matrix(classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vec").toPandas()["vec"])
    index = spark.sparkContext.broadcast(fit(sample, n, k, target))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(pdf["vec"])
            if len(x):
                at = index.value.nearest_lists(x.astype(np.float32))[:, 0]
                codes = index.value.encode(x.astype(np.float32), at)
                yield pd.DataFrame({"list": at, "rep": pdf["rep"], "vec": list(x), "codes": [c.tobytes() for c in codes], "error": index.value.errors(x, at, codes), "ids": pdf["ids"]})

    def visiting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(pdf["vec"])
            if len(x):
                at = index.value.lists_with(x.astype(np.float32), held, k + pdf["own"].to_numpy())
                many = [len(a) for a in at]
                yield pd.DataFrame({"list": np.concatenate(at), "query_id": np.repeat(pdf["vec_id"].to_numpy(), many), "own": np.repeat(pdf["own"].to_numpy(), many), "query": [q for q, m in zip(x, many, strict=True) for _ in range(m)]})

    file = written(classes.mapInPandas(listed, "list int, rep long, vec array<double>, codes binary, error double, ids array<long>"), "ann-index")
    held = np.zeros(MOST_LISTS, np.int64)
    for r in file.groupBy("list").agg(F.sum(F.size("ids")).alias("n")).collect():  # MOST_LISTS rows at most
        held[r["list"]] = r["n"]
    held = held[: len(index.value.centroids)]
    asked = rows.filter(is_query).distinct().withColumn("own", F.count("*").over(Window.partitionBy("vec_id")))
    visits = written(asked.mapInPandas(visiting, "list int, query_id long, own long, query array<double>"), "ann-visits")

    block = int(min(MOST_BLOCK, max(LEAST_BLOCK, n // 64)))
    blocks_of = lambda df, size: df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias("b"))
    sizes = blocks_of(file, block).withColumnRenamed("b", "vb").join(blocks_of(visits, QUERY_BLOCK).withColumnRenamed("b", "qb"), "list")
    sizes = F.broadcast(written(sizes, "ann-blocks"))  # MOST_LISTS rows at most
    left = file.join(sizes, "list").select("list", F.pmod(F.xxhash64("rep"), "vb").cast("int").alias("v"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), "vec", "codes", "error", "ids")
    right = visits.join(sizes, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("vb") - 1)).alias("v"), F.pmod(F.xxhash64("query_id"), "qb").cast("int").alias("q"), "query_id", "own", "query")

    def compare(key: tuple, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=["query_id", "score", "ids"])]
        if len(mine) and len(theirs):
            x, q = _matrix(mine["vec"]), _matrix(theirs["query"])
            codes = np.stack([np.frombuffer(c, np.uint8) for c in mine["codes"]])
            ids, error = mine["ids"].to_numpy(), mine["error"].to_numpy()
            asked_by, own = theirs["query_id"].to_numpy(), theirs["own"].to_numpy()
            for at in range(0, len(q), TOGETHER):
                some = slice(at, at + TOGETHER)
                needed = np.minimum(k + own[some], len(x))  # the query's own rows may be among them
                exact, last = index.value.measured(q[some], key[0], x, codes, error, needed)
                rows, cols = np.nonzero(exact <= last[:, None])
                out.append(pd.DataFrame({"query_id": asked_by[some][rows], "score": exact[rows, cols], "ids": ids[cols]}))
        return pd.concat(out[1:] or out)

    found = left.groupBy("list", "v", "q").cogroup(right.groupBy("list", "v", "q")).applyInPandas(compare, "query_id long, score double, ids array<long>")
    pairs = found.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("query_id <> vec_id").distinct()
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op2_nearest": op2_nearest}
ORACLES: dict[str, str] = {}
