import pytest
from pyspark.sql import functions as F

from vellumine.llm import mixing as m


def slow_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if 3 * sizes[s] < left * weight[s] / total}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        open_ -= over
    return target


def rows_of(spark):
    texts = lambda n, k: " ".join(["w"] * (1 + (n * 7 + k) % 23))
    rows = [(i, texts(i, k), s) for k, (s, n) in enumerate([("a", 5), ("B", 60), (None, 40), ("é", 200), ("z", 3), ("zz", 90)]) for i in range(1000 * k, 1000 * k + n)]
    return spark.createDataFrame([*rows, (1, None, "a"), (None, "x y", "a"), (2, "", "a")], "doc_id long, text string, source string")


def mix(rows):
    return m.mix(rows, m.edge_thresholds(rows, m.thresholds(rows)))


def test_many_copies_of_a_row_meet_the_target_too(spark):
    text = lambda n: " ".join(["w"] * n)
    rows = [(1, text(100), "a")] * 400 + [(10 + i, text(37 + i), "a") for i in range(10)] + [(500 + i, text(90), "b") for i in range(300)] + [(7, text(11), None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    out = mix(m.numbered(m.sized(docs))).withColumn("taken", F.col("size") * F.col("copies"))
    by = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest")).collect()
    assert len(by) == 3
    for r in by:
        assert abs(r["taken"] - r["target"]) <= r["largest"] / 2 + 1e-9
    assert m.mixed(docs).agg(F.sum(m.n_words(F.col("text")))).first()[0] == sum(r["taken"] for r in by)
    counts = lambda df: sorted((r["doc_id"], r["taken"], r["count"]) for r in df.groupBy("doc_id", "taken").count().collect())
    again = mix(m.numbered(m.sized(docs.repartition(3)))).withColumn("taken", F.col("size") * F.col("copies"))
    assert counts(out) == counts(again)


def test_targets_and_taken_words(spark):
    rows = m.numbered(m.sized(rows_of(spark)))
    out = mix(rows).withColumn("taken", F.col("size") * F.col("copies")).toPandas()
    by = out.groupby("source", dropna=False).agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), largest=("size", "max"))
    sizes = {None if s != s else s: int(v) for s, v in by["size"].items()}
    expected = slow_targets(sizes)
    for s, r in by.iterrows():
        assert r["size"] == r["source_size"]
        assert r["target"] == pytest.approx(expected[None if s != s else s])
        assert abs(r["taken"] - r["target"]) <= r["largest"] / 2 + 1e-9
    assert (out["taken"] <= 3 * out["size"]).all()
    again = mix(rows).withColumn("taken", F.col("size") * F.col("copies")).toPandas()
    key = ["source", "hash"]
    assert out.sort_values(key)["taken"].tolist() == again.sort_values(key)["taken"].tolist()


def test_mixed_keeps_columns_and_repeats_documents(spark):
    docs = rows_of(spark).withColumn("copies", F.lit("own")).withColumn("target", F.lit(None).cast("int"))
    got = m.mixed(docs)
    assert got.columns == docs.columns
    rows = m.numbered(m.sized(docs))
    words = mix(rows).agg(F.sum(F.col("size") * F.col("copies"))).first()[0]
    assert got.agg(F.sum(m.n_words(F.col("text")))).first()[0] == words


def test_empty_tables_and_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert m.mixed(docs).count() == 0
    docs = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert m.mixed(docs).count() == 0
