import re
from itertools import permutations

from pyspark.sql import functions as F

from vellumine.llm import filter_audit as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text, doc_id, first):
    text = text or ""
    words = WORD.findall(text)
    out = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
    return out | {"E": doc_id is not None and first.get(text) is not None and doc_id > first[text]}


def brute(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    rows = [(s or "", fails(t, i, first), i is not None and i in good, i is not None and i in toxic) for i, t, s in docs]
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                failing = [r for r in own if r[1][f]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(sum(r[1].values()) == 1 for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone), f,
                ]
        for v in out.values():
            if isinstance(v[-1], str):
                v[-1] = shapley[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def run(spark, docs, labels):
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("PART", F.lit("own")).withColumn("a", F.lit(1))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = m.with_labels(m.with_repeats(m.written(m.verdicts(docs), "t")), labels)
    out = m.audit(rows, m.FILTERS, "part", m.LOST)
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in out.collect()}


def documents():
    fine = " ".join(f"w{i}" for i in range(60))
    texts = [
        fine, fine + " #", fine.upper(), "SHORT", "", None, "a " * 60, fine + " é", "one two|three", "\x0b\x0c \t", " ".join(f"w{i % 30}" for i in range(90)), "word " * 200_000 + "X" * 60_000 + "%",
        " ".join(f"w{i}" for i in range(60)),
    ]
    rows = [(i, texts[i % len(texts)], ["s", "t", None, ""][i % 4]) for i in range(80)]
    return rows + [(500 + i, "same text", "s") for i in range(120)] + [(None, fine, "s"), (None, "", None), (3, texts[3], "t"), (3, fine, "t"), (-5, "x", "only")]


LABELS = [(0, 1, 0), (1, 0, 1), (2, 1, 1), (3, None, 1), (3, 1, None), (None, 1, 1), (510, 1, 0), (510, 1, 0), (9999, 1, 1)]


def test_equals_applying_every_order(spark):
    assert run(spark, documents(), LABELS) == brute(documents(), LABELS)


def test_hot_digests_are_looked_up_like_others(spark):
    rows = m.written(spark.createDataFrame([(i, b"h" if i < 50 else bytes([i])) for i in range(60)] + [(60, bytes([55]))], "doc_id long, digest binary"), "t")
    facts = rows.groupBy("digest").agg(F.min("doc_id").alias("f"), F.count("*").alias("n")).filter("n > 1")
    for hot in (1, 2, 4096):
        got = {(r["doc_id"], r["f"]) for r in m.with_facts(rows, m.written(facts, "t"), "digest", "n", hot).collect()}
        assert got == {(i, 0 if i < 50 else 55 if i in (55, 60) else None) for i in range(61)}


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [(1, None, None)], []) == brute([(1, None, None)], [])


def test_each_set_of_filters_is_executed_once(spark):
    rows = spark.createDataFrame([("p", i % 2 == 0, i % 3 == 0, i % 5 == 0) for i in range(30)], "part string, x boolean, y boolean, z boolean")
    edges = m.edges(rows, ["x", "y", "z"], "part", [])
    assert edges.select("state").distinct().count() == 7 and edges.count() == 12
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_the_query_over_its_table(spark):
    from vellumine.llm.common import table

    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in table(spark, sf, "labels").select("doc_id", "quality", "toxic").collect()]
    got = m.op12_filter_audit(spark, sf)
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in got.collect()} == brute(docs, labels)
    assert dict(got.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(names, "bigint")
