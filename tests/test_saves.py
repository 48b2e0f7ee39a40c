import pytest
from pyspark.sql import functions as F

from vellumine.operators import log, pages, store
from vellumine.plans import relational

SF = "/root/testdata/sf0.001"


def batch(spark, docs, lines, stored=None):
    docs = spark.createDataFrame([(d, f"n{d}") for d in docs], "doc int, name string")
    lines = spark.createDataFrame(lines, "doc int, line int, text string")
    return log.document_batch(docs, {"lines": (lines, ["line"])}, {} if stored is None else {"lines": stored}, "doc")


def lines_of(spark, folder):
    return sorted((r["doc"], r["line"], r["text"]) for r in log.saved(spark, folder, "lines", ["doc", "line"]).collect())


def test_a_save_is_seen_as_a_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/log"
    log.save(batch(spark, [1, 2], [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]), folder, 0)
    before = lines_of(spark, folder)
    stored = log.saved(spark, folder, "lines", ["doc", "line"])
    second = batch(spark, [1, 3], [(3, 0, "x")], stored)
    whole, done = log.append, []

    def failing(rows, where, seq):
        if done:
            raise OSError("lost")
        done.append(where)
        whole(rows, where, seq)

    monkeypatch.setattr(log, "append", failing)
    with pytest.raises(OSError):
        log.save(second, folder, 1)
    assert done and lines_of(spark, folder) == before
    assert sorted(r["doc"] for r in log.saved(spark, folder, "documents", ["doc"]).collect()) == [1, 2]
    monkeypatch.setattr(log, "append", whole)
    log.save(second, folder, 1)  # again, over what was left; document 1 has no lines any more
    assert lines_of(spark, folder) == [(2, 0, "c"), (3, 0, "x")]
    with pytest.raises(ValueError, match="committed"):
        log.save(second, folder, 1)


def test_a_deletion_is_restored_as_it_was(spark):
    rows = spark.createDataFrame(
        [(1, 0, "a", False, 0), (1, 1, "b", True, 1), (1, 0, "a", True, 2), (2, 0, "c", True, 2), (2, 0, "new", False, 3), (3, 0, "d", True, 2)], "doc int, line int, text string, is_deleted boolean, seq long"
    )
    back = log.restored(rows, ["doc", "line"], 2, spark.createDataFrame([(1,), (2,), (1,)], "doc int"), ["doc"])
    assert [tuple(r) for r in back.select("doc", "line", "text", "is_deleted").collect()] == [(1, 0, "a", False)]


def test_saving_a_parent_without_children_retires_all_of_them(spark):
    stored = spark.createDataFrame([(1, 0, "a", False), (1, 1, "b", None), (2, 0, "c", False), (1, 2, "old", True)], "doc int, line int, text string, is_deleted boolean")
    empty = spark.createDataFrame([], "doc int, line int, text string")
    out = store.replacing(empty, stored, "doc", ["line"], spark.createDataFrame([(1,), (9,)], "doc int"))
    assert sorted((r["doc"], r["line"], r["is_deleted"]) for r in out.collect()) == [(1, 0, True), (1, 1, True)]


def test_a_page_of_a_list_reads_values_of_its_keys_alone(spark):
    plan = relational.list_latest_page(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # between the scan of the lines and the pivot stands a semi join with the page's keys, and so for the orders
    aggregates = plan.split("Aggregate")
    assert plan.count("LeftSemi") >= 2 and all("LeftSemi" in part for part in aggregates[1:])


def test_boxes_of_fields(spark):
    layers = [
        (1, 1, 0, "Jane Doe", 10.0, 10.0, 50.0, 8.0), (1, 1, 1, "mail: jane@doe.org", 10.0, 20.0, 90.0, 8.0), (1, 1, 2, None, 0.0, 0.0, 500.0, 500.0), (1, 1, 3, "", 0.0, 0.0, 500.0, 500.0),
        (1, 2, 0, "Skills: Spark and", 5.0, 5.0, 40.0, 8.0), (1, 2, 1, "Python", 5.0, 15.0, 20.0, 8.0), (1, 2, 2, "other", 300.0, 15.0, 20.0, 8.0), (2, 4, 0, "only page", 1.0, 2.0, 3.0, 4.0),
    ]
    fields = [
        (1, "name", ["jane doe"], 1), (1, "skills", ["Spark and Python", "xx"], 1), (1, "words", ["python unknown spark"], 1), (1, "none", ["zzz"], 2), (1, "off", ["zzz"], 7), (1, "empty", [], 2),
        (1, "null", None, 2), (2, "name", ["only page here"], 1), (3, "name", ["x y z"], 1),
    ]
    layers = spark.createDataFrame(layers, "doc int, page int, layer int, text string, x double, y double, width double, height double")
    fields = spark.createDataFrame(fields, "doc int, field string, terms array<string>, fallback int")
    got = {(r["doc"], r["field"]): (r["page"], r["x"], r["y"], r["width"], r["height"]) for r in pages.assign_boxes(fields, layers, "doc").collect()}
    none = (None,) * 4
    assert got == {
        (1, "name"): (1, 10.0, 10.0, 90.0, 18.0), (1, "skills"): (2, 5.0, 5.0, 40.0, 18.0), (1, "words"): (2, 5.0, 5.0, 40.0, 18.0), (1, "none"): (2, *none), (1, "off"): (1, *none),
        (1, "empty"): (2, *none), (1, "null"): (2, *none), (2, "name"): (4, 1.0, 2.0, 3.0, 4.0), (3, "name"): (None, *none),
    }


def test_matches_of_the_same_project_only(spark):
    stored = spark.createDataFrame([(1, "p", "a", "h1"), (2, "q", "a", "h1"), (3, "p", "b", "h2")], "id int, project string, name string, hash string")
    batch = spark.createDataFrame([("p", "a", "h2"), ("q", "a", "h2"), ("r", "a", "h1"), (None, "a", "h1")], "project string, name string, hash string")
    got = {r["project"]: r["matched_id"] for r in store.match_name_or_hash(batch, stored, "name", "hash", "id", ["project"]).collect()}
    assert got == {"p": 3, "q": 2, "r": None, None: None}


def test_layouts_are_written_as_json(spark, tmp_path):
    import json

    from vellumine.sources import files

    schema = "file_stem string, pages array<struct<page:int,size:array<double>,layers:array<struct<type:string,text:string,box:array<double>>>>>"
    rows = [("a", [(1, [595.0, 842.0], [("text", "x [1,2] y", [1.0, 2.5]), ("line", None, [0.0])])]), ("b", [])]
    files.write_layers(spark.createDataFrame(rows, schema), str(tmp_path / "layers"))
    texts = {p.parent.name: p.read_text() for p in (tmp_path / "layers").glob("*/*.txt")}
    assert sorted(texts) == ["document=a_layers", "document=b_layers"]
    assert json.loads(texts["document=a_layers"]) == [{"page": 1, "size": [595.0, 842.0], "layers": [{"type": "text", "text": "x [1, 2] y", "box": [1.0, 2.5]}, {"type": "line", "box": [0.0]}]}]
    assert '"size":[595.0, 842.0]' in texts["document=a_layers"] and '\n{"type"' in texts["document=a_layers"]


def test_found_files_leave_out_the_folder_of_results(spark, tmp_path):
    from vellumine.sources import files

    for name in ("b.pdf", "A.docx", "out/c.pdf", "sub/B.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found = files.in_order(files.discover(spark, str(tmp_path), True, ["out"]))
    assert [r["name"] for r in found.collect()] == ["A.docx", "b.pdf", "B.pdf"]


def test_advice(spark):
    from vellumine.functions import scoring

    names = "name string, summary string, error_message string, n_emails int, n_phones int, n_profiles int, n_skills int, n_experience int, n_education int, n_projects int, has_highlights boolean"
    rows = [("Ann Lee", "a summary of more than thirty characters", None, 1, 1, 1, 9, 1, 1, 1, True), (None,) * 2 + ("bad",) + (None,) * 8]
    df = spark.createDataFrame(rows, names)
    first, second = df.select(*[c.alias(k) for k, c in scoring.advice(df).items()]).collect()
    assert first["suggestions"] == [] and len(first["praise"]) == 4 and first["praise"][0] == scoring.PRAISE["email"]
    assert second["praise"] == [] and second["suggestions"] == [scoring.ADVICE[k] for k in ("name", "email", "phone", "links")]
