import numpy as np
from pyspark.sql import functions as F

from vellumine.functions import insights
from vellumine.functions.positions import positions
from vellumine.functions.skills import Words
from vellumine.operators import log, pages


def test_log_of_batches(spark, tmp_path):
    folder, other = str(tmp_path / "log"), str(tmp_path / "compact")
    rows = lambda *r: spark.createDataFrame(list(r), "id int, field string, value string")
    now = lambda **kw: {(r["id"], r["field"]): r["value"] for r in log.current(spark, folder, ["id", "field"], **kw).collect()}
    log.append(rows((1, "name", "a"), (1, "role", "b"), (2, "name", "c")), folder, 0)
    log.append(rows((1, "name", "A")), folder, 1)
    assert now() == {(1, "name"): "A", (1, "role"): "b", (2, "name"): "c"}
    before, gone = now(), spark.createDataFrame([(1,)], "id int")
    log.append(log.flagged(log.current(spark, folder, ["id", "field"]), gone, ["id"], True), folder, 2)
    assert now() == {(2, "name"): "c"} and now(include_deleted=True) == before
    log.append(log.flagged(log.current(spark, folder, ["id", "field"], include_deleted=True), gone, ["id"], False), folder, 3)
    assert now() == before
    log.compacted(spark, folder, ["id", "field"], other)
    assert {(r["id"], r["field"]): r["value"] for r in log.current(spark, other, ["id", "field"]).collect()} == before


def test_page_matches(spark):
    doc_pages = spark.createDataFrame([(1, 1, "alpha beta"), (1, 2, "gamma Delta epsilon"), (1, 3, "delta epsilon"), (2, 1, "gamma")], "doc int, page int, text string")
    terms = spark.createDataFrame([(1, "Gamma delta"), (1, "beta alpha zeta"), (1, "none"), (2, "alpha"), (3, "gamma")], "doc int, term string")
    got = {(r["doc"], r["term"]): r["page"] for r in pages.match_pages(terms, doc_pages, "doc").collect()}
    assert got == {(1, "Gamma delta"): 2, (1, "beta alpha zeta"): 1, (1, "none"): None, (2, "alpha"): None, (3, "gamma"): None}


def test_reading_order(spark):
    blocks = [(0, 0, 100, "title"), (55, 12, 95, "right 1"), (5, 10, 45, "left 1"), (5, 20, 45, "left 2"), (55, 22, 95, "right 2"), (0, 40, 100, "bar"), (5, 50, 45, "left 3"), (55, 45, 95, "right 3")]
    df = spark.createDataFrame([(1, 1, 100.0, float(a), float(b), float(c), t) for a, b, c, t in blocks], "doc int, page int, width double, x0 double, y0 double, x1 double, text string").withColumn("y1", F.col("y0") + 5)
    assert pages.reading_order(df, "doc").first()["text"].split("\n") == ["title", "left 1", "left 2", "right 1", "right 2", "bar", "left 3", "right 3"]
    one = np.array([10.0]), np.array([0.0]), np.array([90.0])
    assert pages.order_of_blocks(*one, 100.0).tolist() == [0]


def test_insights_and_defaults(spark):
    """A notice in weeks is none of the stated forms (days, months, immediately, ready to join), so the default stands."""
    rows = spark.createDataFrame([("Notice Period - 2 weeks; Expected CTC: 9 lpa",), ("Notice Period - 2 months; Expected CTC: 9 lpa",)], "t string").select(*[c.alias(n) for n, c in insights.insights(F.col("t")).items()]).collect()
    assert [tuple(r) for r in rows] == [(n, "9 lpa", "9 lpa", "Not Specified", "Fresher") for n in ("Negotiable", "2 months")]


def test_positions_in_brackets(spark):
    df = spark.createDataFrame([(1, "Acme Ltd (Senior Developer) 03/2015 - 04/2019\n- One")], "id int, t string")
    (job,) = positions(df, "id", "t", Words(roles=("developer",), companies=("ltd",))).collect()
    assert (job["role"], job["company"]) == ("Senior Developer", "Acme Ltd")
