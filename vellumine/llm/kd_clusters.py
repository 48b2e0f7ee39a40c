"""Centroid clustering in exact integers, by kd-tree filtering.

Each partition's vectors are cut into blocks, and each block becomes a kd-tree: halves along the widest side of the
box, down to leaves of at most LEAF vectors. A tree's vectors, boxes and integer sums are one row of a written table, so
that all rounds read trees and none reads the vectors again.

A round takes the centroids down each tree. Of the centroids left at a node, one that is strictly farther from every
point of its box than another one is dominated and dropped: seen from the centroid nearest to the box's middle, the
corner that lies farthest in the other's direction decides. A node with one centroid left is assigned as a whole, by its
count and sums; leaves with several are measured vector by vector. All of it is integer arithmetic, so ties are seen as
such and go to the smaller number, and the result does not depend on partitions, blocks or the order of rows.

A partition hands on one count and one sum a centroid and component; they are added up by Spark, and the driver gets
k times as many numbers as a vector has components. The state between rounds is the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.common import discard, table, written

#: Vectors of a tree, and of a leaf at most.
BLOCK, LEAF = 8192, 32

#: Components reach from -LIMIT to LIMIT, so that a squared distance is a long for up to 512 components.
LIMIT = 2**26

#: Elements of the largest temporary array, and the largest integers that doubles hold exactly.
_CHUNK, _EXACT = 2**21, 2**52


@dataclass(frozen=True)
class Tree:
    """Vectors in the tree's order, and by level the boxes and sums of its nodes; node i of a level has children 2i, 2i+1."""

    points: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.low) - 1

    def bounds(self, level: int) -> np.ndarray:
        """Where the nodes of a level begin, and the end."""
        return (len(self.points) * np.arange(2**level + 1)) >> level


def _depth(n: int) -> int:
    depth = 0
    while n > LEAF << depth:
        depth += 1
    return depth


def build(points: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of the points (rows, int64), and the order it puts them in."""
    n, order, depth = len(points), np.arange(len(points)), _depth(len(points))
    for level in range(depth):
        starts, halves = (n * np.arange(2**level + 1)) >> level, (n * np.arange(2 ** (level + 1) + 1)) >> (level + 1)
        for i in range(2**level):
            a, b = starts[i], starts[i + 1]
            inside = points[order[a:b]]
            side = inside[:, int(np.argmax(inside.max(axis=0) - inside.min(axis=0)))]
            order[a:b] = order[a:b][np.argpartition(side, halves[2 * i + 1] - a)]
    points = points[order]
    starts = (n * np.arange(2**depth)) >> depth
    low, high, sums = [np.minimum.reduceat(points, starts)], [np.maximum.reduceat(points, starts)], [np.add.reduceat(points, starts)]
    for _ in range(depth):
        low.insert(0, np.minimum(low[0][::2], low[0][1::2]))
        high.insert(0, np.maximum(high[0][::2], high[0][1::2]))
        sums.insert(0, sums[0][::2] + sums[0][1::2])
    return Tree(points, low, high, sums), order


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T, exact: by doubles where every partial sum is an integer that they hold, else by integers."""
    if x.size and y.size and float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1] < _EXACT:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x @ y.T


def _undominated(low: np.ndarray, high: np.ndarray, centroids: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of the centroids left at each node (a row of flags a node), those that no other one strictly dominates in its box."""
    squares = (centroids**2).sum(axis=1)
    middle = (low + high).astype(np.float64)
    near = np.where(left, squares[None, :] - middle @ centroids.T.astype(np.float64), np.inf).argmin(axis=1)
    out = left.copy()
    step = max(1, _CHUNK // max(1, centroids.size))
    for at in range(0, len(low), step):
        rows = slice(at, at + step)
        away = centroids[None, :, :] - centroids[near[rows]][:, None, :]
        reach = np.where(away > 0, away * high[rows][:, None, :], away * low[rows][:, None, :]).sum(axis=2)
        out[rows] &= squares[None, :] - squares[near[rows]][:, None] - 2 * reach <= 0
    return out


def assign(tree: Tree, centroids: np.ndarray, whole: Callable[[int, int, int], None]) -> tuple[np.ndarray, np.ndarray]:
    """Points that no node settles, and their nearest centroids; whole(level, node, centroid) is called for settled nodes."""
    k, active, left, open_ = len(centroids), np.zeros(1, np.int64), np.ones((1, len(centroids)), bool), []
    for level in range(tree.depth + 1):
        left = _undominated(tree.low[level][active], tree.high[level][active], centroids, left)
        single = left.sum(axis=1) == 1
        for i in np.flatnonzero(single):
            whole(level, int(active[i]), int(left[i].argmax()))
        active, left = active[~single], left[~single]
        if level == tree.depth:
            ends = tree.bounds(level)
            open_ = [np.arange(ends[i], ends[i + 1]) for i in active]
        else:
            active, left = np.stack([2 * active, 2 * active + 1], axis=1).ravel(), np.repeat(left, 2, axis=0)
    if not open_:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    allowed = np.repeat(left, [len(x) for x in open_], axis=0)
    rows = np.concatenate(open_)
    distance = (centroids**2).sum(axis=1)[None, :] - 2 * _product(tree.points[rows], centroids)
    return rows, np.where(allowed, distance, np.iinfo(np.int64).max).argmin(axis=1) if k else rows


def totals(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and componentwise sum of the vectors of each centroid."""
    counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)

    def whole(level: int, node: int, c: int) -> None:
        ends = tree.bounds(level)
        counts[c] += ends[node + 1] - ends[node]
        sums[c] += tree.sums[level][node]

    rows, at = assign(tree, centroids, whole)
    np.add.at(sums, at, tree.points[rows])
    return counts + np.bincount(at, minlength=len(centroids)), sums


def nearest(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroid and squared distance of every point, in the tree's order."""
    cluster = np.zeros(len(tree.points), np.int64)

    def whole(level: int, node: int, c: int) -> None:
        ends = tree.bounds(level)
        cluster[ends[node] : ends[node + 1]] = c

    rows, at = assign(tree, centroids, whole)
    cluster[rows] = at
    return cluster, ((tree.points - centroids[cluster]) ** 2).sum(axis=1)


def kept_vectors(vectors: DataFrame, scale: int, size: int, id_: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v: floor(scale * x) of each component x, of the vectors of exactly `size` components, none of them null
    or non-finite. Others, and null vectors, are left out; rows with a null id or a repeated one take part like any."""
    x = F.col(embedding).cast("array<double>")
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    kept = vectors.filter((F.size(embedding) == size) & fine)
    return kept.select(F.col(id_).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * float(scale)).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def trees(vectors: DataFrame, size: int) -> DataFrame:
    """The kd-trees of kept_vectors() rows, one row a tree, made where the vectors lie."""

    def made(ids: list[pa.Array], points: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(points)
        if np.abs(x).max() > LIMIT:
            raise ValueError(f"a scaled component lies beyond {LIMIT}, so squared distances may not be longs")
        tree, order = build(x)
        small = np.min_scalar_type(-1 - int(np.abs(x).max()))  # the magnitude and one more, so that both signs fit
        levels = lambda arrays, kind: np.concatenate(arrays).astype(kind).tobytes()
        return pa.RecordBatch.from_pydict({
            "ids": pa.array([pa.concat_arrays(ids).take(pa.array(order)).to_pylist()], pa.list_(pa.int64())),
            "kind": pa.array([small.str]), "points": pa.array([tree.points.astype(small).tobytes()], pa.binary()),
            "low": pa.array([levels(tree.low, small)], pa.binary()), "high": pa.array([levels(tree.high, small)], pa.binary()),
            "sums": pa.array([levels(tree.sums, np.int64)], pa.binary()),
        })

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, n = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                ids.append(piece.column("vec_id"))
                points.append(_matrix(piece.column("v"), size))
                n += piece.num_rows
                if n >= BLOCK:
                    yield made(ids, points)
                    ids, points, n = [], [], 0
        if n:
            yield made(ids, points)

    return vectors.mapInArrow(blocks, "ids array<long>, kind string, points binary, low binary, high binary, sums binary")


def _read(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, Tree]]:
    for i in range(batch.num_rows):
        ids = batch.column("ids")[i].values
        kind = np.dtype(batch.column("kind")[i].as_py())
        flat = lambda name, k: np.frombuffer(batch.column(name)[i].as_buffer(), k).astype(np.int64).reshape(-1, size)  # noqa: B023, E731
        cuts = np.cumsum([2**level for level in range(_depth(len(ids)))])
        yield ids, Tree(flat("points", kind), np.split(flat("low", kind), cuts), np.split(flat("high", kind), cuts), np.split(flat("sums", np.int64), cuts))


def next_centroids(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid that has vectors becomes their componentwise floor(sum / count); others stay."""
    k, size = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            for _, tree in _read(batch, size):
                n, s = totals(tree, centroids)
                counts += n
                sums += s
        full = np.flatnonzero(counts)
        if len(full):
            both = np.concatenate([counts[full, None], sums[full]], axis=1)
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(full, pa.int32()), "sums": pa.array(both.tolist(), pa.list_(pa.int64()))})

    found = forest.mapInArrow(partial, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "value"))
    added = found.groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    sums = {(r["cluster"], r["at"]): int(r["value"]) for r in added.collect()}  # k * (size + 1) numbers
    out = centroids.copy()
    for c in range(k):
        if n := sums.get((c, 0)):
            out[c] = [sums[c, d] // n for d in range(1, size + 1)]
    return out


def assigned(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    size = centroids.shape[1]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _read(batch, size):
                cluster, distance = nearest(tree, centroids)
                yield pa.RecordBatch.from_pydict({"vec_id": ids, "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distance, pa.int64())})

    return forest.mapInArrow(label, "vec_id long, cluster int, distance long")


def first_centroids(vectors: DataFrame, k: int, seed: str, size: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `seed:vec_id`, in its order; of equal ids by components, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), size)


def cluster(vectors: DataFrame, k: int, rounds: int, seed: str = "1", scale: int = 64, size: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    vectors has vec_id and embedding; other columns are ignored. Which vectors are kept, and how they become integers, is
    kept_vectors()'s rule. Fewer kept vectors than k give as many clusters; none give no rows. A scaled component beyond
    LIMIT is an error, as distances would leave the range of a long.
    """
    spark, kept = vectors.sparkSession, kept_vectors(vectors, scale, size)
    centroids = first_centroids(kept, k, seed, size)
    forest = written(trees(kept, size), "kd-trees")
    for _ in range(rounds):
        centroids = next_centroids(forest, centroids)
    rows = written(assigned(forest, centroids), "kd-assigned")
    discard(forest)
    # at most k rows
    inertia = {r["cluster"]: int(r["total"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    facts = [(c, n, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in sorted(inertia.items())]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


#: What the query asks for.
CLUSTERS, ROUNDS = 16, 3


def op11_kd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"), CLUSTERS, ROUNDS)


QUERIES = {"op11_kd_clusters": op11_kd_clusters}


def _round(number: int) -> str:
    """SQL of one round: distances to the centroids of c{number}, the nearest, and the next centroids."""
    return f"""
        n{number} as (
          select p.vec_id, p.rid, min(struct_pack(distance := d, cluster := cluster)) as best
          from (select v.vec_id, v.rid, c.cluster, sum((v.x - c.x) * (v.x - c.x))::bigint as d from v join c{number} c using (dim) group by all) p group by all),
        s{number} as (select best.cluster as cluster, dim, sum(x)::bigint as total, count(*)::bigint as n from v join n{number} using (rid) group by all),
        c{number + 1} as (select c.cluster, c.dim, case when n is null then c.x else (total - ((total % n) + n) % n) // n end as x
                          from c{number} c left join s{number} s on c.cluster = s.cluster and c.dim = s.dim),"""


ORACLES = {
    "op11_kd_clusters": f"""
        with k as (select vec_id, row_number() over () as rid, embedding from embeddings
                   where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
        v as (select vec_id, rid, unnest(range(1, 65)) as dim, unnest(list_transform(embedding, lambda x: floor(64 * x::double)::bigint)) as x from k),
        f as (select rid, row_number() over (order by sha256('1:' || vec_id)) - 1 as cluster from k order by cluster limit {CLUSTERS}),
        c0 as (select cluster, dim, x from v join f using (rid)),
        {"".join(_round(i) for i in range(ROUNDS + 1))}
        h as (select cluster, sha256(string_agg(x::varchar, ',' order by dim)) as centroid_sha256 from c{ROUNDS} group by cluster),
        a as (select vec_id, best.cluster as cluster, best.distance as distance from n{ROUNDS})
        select vec_id, cluster::int as cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
               (sum(distance) over ())::bigint as inertia, centroid_sha256
        from a join h using (cluster)""",
}
