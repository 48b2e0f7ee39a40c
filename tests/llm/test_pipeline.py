from pyspark.sql import functions as F

import corpus_pipeline as c
from test_simhash import slow_one_of_each
from vellumine.llm import mixing
from vellumine.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in c.STAGES:
        docs = written(stage(spark, docs, SF), "test-stage")
        seen[name] = docs
        if name != c.STAGES[-1][0]:
            assert docs.columns == columns
    clean, reduced, single, mixed, packed = seen.values()
    assert reduced.count() == clean.count() >= single.count()
    assert reduced.filter(F.col("n_chars") != F.length("text")).count() == 0
    assert single.select("doc_id").distinct().count() == single.count()
    assert mixed.select("doc_id").distinct().join(single, "doc_id", "left_anti").count() == 0
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    pieces = packed.filter("piece = 0").count()
    assert pieces == mixed.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    """Every stage against its input, row for row: the near-duplicates by brute force, the mix by its own counts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    ids = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 5 == 1, F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    docs = docs.withColumn("doc_id", ids.cast("long"))
    lone = "a lone and harmless note on the early history of the village mill that no other document repeats"
    more = spark.createDataFrame([(None, lone, "en", "notes", len(lone))], "doc_id long, text string, lang string, source string, n_chars long")
    docs.select(more.columns).unionByName(more).select([F.col(x).cast(docs.schema[x].dataType) for x in docs.columns]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    before, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in c.STAGES:
        after = written(stage(spark, before, str(tmp_path)), "test-stage")
        seen[name] = before, after
        before = after
    raw, clean = map(rows, seen["toxicity"])
    assert (None, lone) in clean and all(clean.count(x) == raw.count(x) for x in clean)
    assert sorted(str(i) for i, _ in clean) == sorted(str(i) for i, _ in rows(seen["line dedup"][1]))
    reduced, single = map(rows, seen["simhash near-dedup"])
    expected = slow_one_of_each(reduced)
    assert len(single) == len(expected) and all(any(x in e for x in single) for e in expected)
    mixed = rows(seen["source mixing"][1])
    sized = mixing.numbered(mixing.sized(seen["simhash near-dedup"][1]))
    copies = mixing.mix(sized, mixing.edge_thresholds(sized, mixing.thresholds(sized)))
    assert len(mixed) == copies.agg(F.sum("copies")).first()[0] and set(mixed) <= set(single)
    packed = seen["best-fit packing"][1]
    assert packed.filter("piece = 0").count() == len(mixed)
    assert sorted(str(r["doc_id"]) for r in packed.filter("piece = 0").collect()) == sorted(str(i) for i, _ in mixed)
