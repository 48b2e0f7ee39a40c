import numpy as np
from pyspark.sql import functions as F

from vellumine.llm import ann


def brute(rows, query, k=10):
    q = rows[query]
    near = sorted((float(np.sqrt(((v - q) ** 2).sum())), i) for i, v in rows.items() if i != query)
    return near[:k]


def test_recall_on_the_test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    got = {}
    for r in ann.search(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in [i for i in rows if i % 100 == 0]:
        near = brute(rows, q)
        assert [x[0] for x in got[q]] == list(range(1, 11))
        for _, i, s in got[q]:
            assert abs(s - np.sqrt(((rows[i] - rows[q]) ** 2).sum())) < 1e-12
        hits += len({i for _, i in near} & {i for _, i, _ in got[q]})
    assert hits >= 0.9 * 10 * len(got)


def test_copies_ties_and_invalid_vectors(spark):
    rng = np.random.default_rng(0)
    common = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, common) for i in range(0, 400)] + [(i, [float(x) for x in rng.normal(size=4)]) for i in range(400, 500)]
    bad = [(500, None), (600, [0.0] * 4), (700, [1.0, None, 1.0, 1.0]), (800, [1.0, float("nan"), 1.0, 1.0]), (900, [float("inf"), 1.0, 1.0, 1.0]), (1000, [1.0, 2.0]), (None, common), (0, common)]
    table = spark.createDataFrame([(*r, "own") for r in rows + bad], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in ann.search(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert sorted(got) == [0, 100, 200, 300, 400]
    for q in (0, 100, 200, 300):
        assert got[q] == [(0.0, i) for i in range(12) if i != q][:10]


def test_few_or_no_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(table, F.col("vec_id") == 0).collect()] == [(0, 1, 1)]
    assert ann.search(table.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.search(table, F.col("vec_id") == 9).count() == 0


def test_groups_of_near_copies(spark):
    """Members of a group share their codes, so only exact distances tell its nearest ones apart."""
    rng = np.random.default_rng(5)
    groups = [rng.normal(size=16) + 1e-4 * rng.normal(size=(n, 16)) for n in (100, 150, 1000, 5000)]
    x = np.concatenate([*groups, rng.normal(size=(14_000, 16))])
    asked = [0, 50, 100, 175, 249, 250, 700, 1249, 1250, 3000, 6249]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(table, F.col("vec_id").isin(asked)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert len(got[q] & set(np.argsort(d)[:10].tolist())) >= 9


def test_lists_with_few_rows_and_ids_with_many_vectors(spark):
    index = ann.Index(np.array([[0.0], [10.0], [11.0], [40.0]], np.float32), [], 1)
    held, x = np.array([50, 2, 3, 90]), np.array([[10.1], [0.2], [41.0]], np.float32)
    assert [a.tolist() for a in index.lists_with(x, held, np.array([11, 11, 500]))] == [[1, 2, 0], [0], [3, 2, 1, 0]]
    rows = [(0, [float(i), 1.0]) for i in range(30)] + [(i, [float(i), 500.0]) for i in range(1, 15)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(table, F.col("vec_id") == 0).filter("rank is not null").collect()
    assert len(got) == 10 and all(r["query_id"] == 0 and r["vec_id"] != 0 for r in got)
