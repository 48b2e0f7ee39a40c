from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vellumine.operators import intervals, log, store
from vellumine.sources import files


def test_interval_union(spark):
    rows = [(1, 24240, 24264), (1, 24260, 24300), (1, 24310, 24320), (2, 5, 9), (2, 9, 12), (3, 0, 13)]
    df = spark.createDataFrame(rows, "k int, a int, b int")
    got = {r["k"]: (r["covered"], r["t"]) for r in intervals.union_length(df, ["k"], "a", "b").withColumn("t", intervals.months_text(F.col("covered"))).collect()}
    assert got == {1: (70, "5y 10m"), 2: (7, "7 Months"), 3: (13, "1 Years")}


def test_latest_pivot_and_empty_conditions(spark):
    df = spark.createDataFrame([(1, "a", "x", 1, False), (1, "a", "y", 2, True), (1, "b", None, 3, None), (2, "c", "z", 1, False)], "k int, f string, v string, n int, is_deleted boolean")
    assert store.live(df).count() == 3 and df.filter(store.all_of([])).count() == 4
    assert {(r["k"], r["f"]): r["v"] for r in store.latest_by(df, ["k", "f"], ["n"]).collect()} == {(1, "a"): "y", (1, "b"): None, (2, "c"): "z"}
    assert {r["k"]: (r["a"], r["c"]) for r in store.pivot_fields(df, "k", "f", "v", ("a", "c"), "n").collect()} == {1: ("y", None), 2: (None, "z")}


def test_cascade_and_matching(spark):
    parent = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    child = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, None)], "cid int, pid int")
    marked = store.cascade(parent, [(child, "pid", "cid", "id")], F.col("id") == 1, "id")
    assert [r["cid"] for r in marked[1].filter("hit").orderBy("cid").collect()] == [10, 11]
    stored = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h1"), (3, "a", "h3")], "id int, name string, hash string")
    batch = spark.createDataFrame([("a", "h9"), ("z", "h1"), ("z", "h9"), (None, None)], "name string, hash string")
    got = [r["matched_id"] for r in store.match_name_or_hash(batch, stored, "name", "hash", "id").collect()]
    assert sorted(got, key=str) == sorted([3, 2, None, None], key=str)
    assert store.duplicates(stored, ["hash"]).count() == 1
    assert store.orphans(child, "pid", parent, "id").count() == 1


def test_pages_are_disjoint(spark):
    df = spark.range(25)
    pages = [[r["id"] for r in store.page(df, [F.desc("id")], 10, n).collect()] for n in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [10, 10, 5, 0] and sum(pages, []) == list(range(24, -1, -1))


def test_files(spark, tmp_path):
    for name in ("a.pdf", "B.DOCX", ".hidden.pdf", "~$lock.docx", "c.txt"):
        (tmp_path / name).write_bytes(b"\x00\x01some printable run\x02abc\x00" if name == "a.pdf" else b"x")
    found = files.discover(spark, str(tmp_path)).orderBy("name").collect()
    assert [r["name"] for r in found] == ["B.DOCX", "a.pdf"] and found[1]["media_type"] == "application/pdf"
    runs = files.discover(spark, str(tmp_path)).filter("name = 'a.pdf'").select(files.printable_runs(F.col("content")).alias("x")).first()["x"]
    assert runs == ["some printable run"]
    out = tmp_path / "json"
    out.mkdir()
    (out / "one.json").write_text('{"name": "n",\n "status": "success"}')
    (out / "bad.json").write_text("{")
    (out / "manifest.json").write_text('{"name": "m"}')
    schema = StructType([StructField("name", StringType()), StructField("status", StringType())])
    rows = files.read_records(spark, str(out), schema)
    assert [r["name"] for r in rows.collect()] == ["n"]
    assert tuple(files.manifest(rows).first()) == (1, 1, 0)


def test_saving_children_retires_what_the_batch_lacks(spark, tmp_path):
    schema = "doc int, page int, text string, is_deleted boolean"
    stored = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", None), (1, 3, "c", True), (2, 1, "z", False)], schema)
    batch = spark.createDataFrame([(1, 1, "a2"), (1, 4, "d")], "doc int, page int, text string")
    saved = store.replacing(batch, stored, "doc", ["page"])
    assert sorted(map(tuple, saved.collect())) == [(1, 1, "a2", False), (1, 2, "b", True), (1, 4, "d", False)]
    folder = str(tmp_path / "log")
    log.append(stored, folder, 1)
    log.append(saved, folder, 2)
    assert sorted((r.doc, r.page, r.text) for r in log.current(spark, folder, ["doc", "page"]).collect()) == [(1, 1, "a2"), (1, 4, "d"), (2, 1, "z")]


def test_catalog_grows_once(spark):
    catalog = spark.createDataFrame([("a", 1, False), ("b", 2, True)], "name string, id long, is_deleted boolean")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), (None,)], "name string")
    new = store.catalog_additions(wanted, catalog, ["name"])
    assert sorted(r.name for r in new.collect()) == ["b", "c"]
    both = catalog.unionByName(new.withColumn("is_deleted", F.lit(False)))
    assert store.catalog_additions(wanted, both, ["name"]).count() == 0


def test_record_filters_and_lookup(spark):
    rows = [("x/a b.json", False, "Software", 80.0), ("x/b.json", None, None, None), ("x/c.json", True, "SOFTWARE", 90.0)]
    df = spark.createDataFrame(rows, "path string, is_deleted boolean, overall_profile string, score double")
    names = lambda d: sorted(r.path[2:-5] for r in d.collect())
    assert names(files.select_records(df)) == ["a b", "b"] and names(files.select_records(df, include_deleted=True)) == ["a b", "b", "c"]
    assert names(files.select_records(df, "soft", 70.0)) == ["a b"] and names(files.select_records(df, None, 0.0)) == ["a b", "b"]
    assert names(files.by_stem(df, "../y/a b")) == ["a b"] and names(files.by_stem(df, "zz")) == []
