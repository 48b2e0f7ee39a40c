import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumine.llm import kd_clusters as m


def brute(rows, k, rounds, scale=64, size=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at) if a == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, c, d in out if c == n) for n in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia), sha[c]) for i, c, d in out), key=repr)


def clustered(n, size, seed, repeats=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, size))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + 0.1 * rng.normal(size=size)]) for i in range(n)]
    return rows + [(n + i, rows[0][1]) for i in range(repeats)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def result(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def test_equals_brute_force_with_copies_and_vectors_left_out(spark):
    rows = clustered(300, 64, 1, repeats=150)
    odd = [(1000, None), (1001, []), (1002, [0.0] * 63), (1003, [0.0] * 65), (1004, [None] + [0.0] * 63), (1005, [float("nan")] + [0.0] * 63), (1006, [float("-inf")] * 64)]
    more = [(3, rows[7][1]), (3, rows[3][1]), (None, rows[9][1]), (2000, [0.0] * 64), (2001, [-0.001] * 64)]
    df = frame(spark, rows + odd + more).repartition(5).withColumn("cluster", F.lit("own")).withColumn("Distance", F.lit(None).cast("int"))
    assert result(m.cluster(df, 16, 3)) == brute(rows + more, 16, 3)


def test_ties_go_to_the_smaller_number_and_equal_centroids_stay(spark):
    rows = [(i, [float(i % 3), float(i % 2)]) for i in range(60)]
    df = frame(spark, rows)
    assert result(m.cluster(df, 16, 3, size=2)) == brute(rows, 16, 3, size=2)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = clustered(5, 64, 2)
    assert result(m.cluster(frame(spark, rows), 16, 3)) == brute(rows, 16, 3)
    assert m.cluster(frame(spark, []), 16, 3).count() == 0
    assert m.cluster(frame(spark, [(1, None)]), 16, 3).schema == m.cluster(frame(spark, rows), 16, 3).schema


def test_the_query_over_its_table(spark):
    from vellumine.llm.common import table

    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    assert result(m.op11_kd_clusters(spark, sf)) == brute(rows, 16, 3)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 400), st.integers(1, 4), st.integers(1, 20), st.integers(1, 30), st.integers(0, 2**31))
def test_filtering_equals_measuring_everything(n, size, k, width, seed):
    rng = np.random.default_rng(seed)
    points, centroids = rng.integers(-width, width + 1, (n, size)), rng.integers(-width, width + 1, (k, size))
    tree, order = m.build(points)
    assert sorted(order) == list(range(n)) and (tree.points == points[order]).all()
    d = ((tree.points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    cluster, distance = m.nearest(tree, centroids)
    assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    counts, sums = m.totals(tree, centroids)
    assert (counts == np.bincount(cluster, minlength=k)).all()
    assert all((sums[c] == tree.points[cluster == c].sum(axis=0)).all() for c in range(k))


def test_nodes_are_settled_as_wholes_where_vectors_are_clustered():
    rng, settled = np.random.default_rng(3), []
    centres = rng.integers(-1000, 1000, (8, 16))
    tree, _ = m.build(np.concatenate([c + rng.integers(-20, 21, (500, 16)) for c in centres]))
    rows, _ = m.assign(tree, centres, lambda level, node, c: settled.append(level))
    assert len(rows) < 0.1 * len(tree.points) and min(settled) < tree.depth


def test_large_components_are_exact_up_to_the_limit(spark):
    points = np.array([[m.LIMIT] * 64, [-m.LIMIT] * 64, [m.LIMIT - 1] * 64])
    tree, order = m.build(points)
    cluster, distance = m.nearest(tree, points[:2])
    got = {int(o): (int(c), int(d)) for o, c, d in zip(order, cluster, distance)}
    assert got == {0: (0, 0), 1: (1, 0), 2: (0, 64)}
    with pytest.raises(Exception, match="beyond"):
        m.cluster(frame(spark, [(1, [1e30] * 64)]), 2, 1)
