import math
import random
import re

from pyspark.sql import functions as F

from vellumine.llm import line_dedup as d


def slow(rows):
    """The removed line numbers of each row; rows in corpus order."""
    lines = []
    for k, text in enumerate(rows):
        for pos, line in enumerate((text or "").split("\n")):
            words = {w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w}
            if words:
                lines.append((k, pos, words))
    out = [[] for _ in rows]
    for i, (k, pos, words) in enumerate(lines):
        if any(5 * len(words & w) >= 4 * len(words | w) for _, _, w in lines[:i]):
            out[k].append(pos)
    return out


def corpus(seed, many=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Éa", "THE", "the"] * 5
    lines = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 9, 10, 30, 120]))] for _ in range(40)]
    rows = []
    for _ in range(many):
        text = []
        for _ in range(rng.randrange(0, 7)):
            line = list(rng.choice(lines))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            rng.random() < 0.2 and rng.shuffle(line)
            text.append(rng.choice([" ", "  ", "\t", "\r "]).join(line) if rng.random() < 0.2 else " ".join(line))
        rows.append("\n".join(text))
    return rows


def test_equals_brute_force(spark):
    for seed, how in enumerate([{}, {"buckets": 6, "hot": 3, "family": 2}]):
        rows = corpus(seed)
        df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(rows)], "doc_id long, text string, removed string")
        got = {r["doc_id"]: list(r["removed"]) for r in d.removed_lines(df, **how).collect()}
        assert got == dict(enumerate(slow(rows)))
        texts = {r["doc_id"]: r["text"] for r in d.dedup(df, **how).collect()}
        for k, gone in enumerate(slow(rows)):
            assert texts[k] == "\n".join(x for i, x in enumerate(rows[k].split("\n")) if i not in gone)


def test_nulls_repeats_long_lines_and_empty_tables(spark):
    long_ = " ".join(f"t{k}" for k in range(5000))
    rows = [(1, None), (2, ""), (3, "a b c\n\nA  b c"), (3, "a b c\n\nA  b c"), (None, "own line here"), (4, "own line here\nnew"), (5, long_), (6, long_ + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.lit(0))
    out = d.dedup(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, None), (2, ""), (3, "a b c\n"), (3, "a b c\n"), (None, "own line here"), (4, "new"), (5, long_), (6, "")], key=str)
    assert d.removed_lines(df.limit(0)).count() == 0


def test_small_families_are_not_settled_first(spark, monkeypatch):
    rows = ["a b c d e f g h i j k" + x for x in ("", " l", " m", " l m n o p")] + [f"u{k} v{k} w{k}" for k in range(30)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    asked = []
    monkeypatch.setattr(d, "word_lists", lambda *x, f=d.word_lists: asked.append(1) or f(*x))
    for family, times in ((2, 1), (1, 1)):
        asked.clear()
        got = {r["doc_id"]: list(r["removed"]) for r in d.removed_lines(df, family=family).collect()}
        assert got == dict(enumerate(slow(rows))) and len(asked) == times


def test_frequent_words_meet_by_pairs(spark):
    rng = random.Random(5)
    rows = [" ".join(rng.choice(["a", "b", "c", "d", "e", "f", "g", "h"]) for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for hot in (0, 20, 1 << 14):
        got = {r["doc_id"]: list(r["removed"]) for r in d.removed_lines(df, hot=hot).collect()}
        assert got == dict(enumerate(slow(rows)))


def test_large_family_of_near_copies_costs_no_square(spark):
    """20,000 distinct lines like the first: all go, and hardly any pair of them is left for the join on words."""
    base = [f"word{k}" for k in range(40)]
    rows = [(0, " ".join(base))] + [(k, " ".join(base[: k % 40] + [f"own{k}"] + base[k % 40 + 1 :])) for k in range(1, 20_001)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = d.removed_lines(df).agg(F.sum(F.size("removed")).alias("n"), F.min(F.when(F.size("removed") == 0, F.col("doc_id"))).alias("kept")).first()
    assert (got["n"], got["kept"]) == (20_000, 0)
    sets = d.word_sets(d.lines_of(df), d.rarity(df))
    classes = sets.select(*d.ordered("doc_id", "doc", "pos"), "n", "sketch", "half", "prefix")
    settled = d.family_pairs(classes).select("doc", "line").distinct().count()
    assert settled >= 19_000


def test_repeated_rows_all_come_back(spark):
    df = spark.createDataFrame([(1, "a b c d e\nx")] * 3 + [(2, "a b c d e f\nx")] * 2 + [(3, None)] * 2, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_lines"], tuple(r["removed"])) for r in d.removed_lines(df).collect())
    assert got == [(1, 2, ())] * 3 + [(2, 2, (0, 1))] * 2 + [(3, 0, ())] * 2


def test_ranks_are_short_and_codes_of_words_are_plain_longs(spark):
    """Each word of the corpus looks its rank up and is sorted by its code, so both must be in the cheap form."""
    df = spark.createDataFrame([(1, "a b\na b c")], "doc_id long, text string")
    ranks = d.rarity(df, 6)
    assert ranks.schema["v"].dataType.elementType.typeName() == "short" and len(ranks.first()["v"]) == 64
    assert not d.word_sets(d.lines_of(df), ranks, 6).schema["prefix"].dataType.containsNull


def test_lambda_functions_read_plain_splits(spark):
    """What a lambda reads is evaluated without generated code or sharing: each line was put in lower case six times."""
    df = spark.createDataFrame([(1, "a b\na b c")], "doc_id long, text string")
    plan = d.word_sets(d.lines_of(df), d.rarity(df, 6), 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(") == 1 and "transform(array_remove(" not in plan
    assert not re.search(r"Project [^\n]*, ranks#", plan)  # or each row would hold all ranks


def test_words_are_counted_in_lower_case(spark):
    df = spark.createDataFrame([(1, "Word WORD\tword\nword"), (2, None)], "doc_id long, text string")
    slot = df.limit(1).select(d._low(F.xxhash64(F.lit("word")), 6)).first()[0]
    assert d.rarity(df, 6).first()["v"][slot] == int(256 * math.log2(5))


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a b\na b")], "doc_id long, text string")
    plan = d.removed_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_settled_lines_are_early_ones_only_and_of_one_join(spark):
    """They were shuffled and sorted with the open lines once more, in a join of their own."""
    df = spark.createDataFrame(list(enumerate(corpus(7))), "doc_id long, text string")
    sets = d.word_sets(d.lines_of(df), d.rarity(df, 6), 6, 3).filter("n > 0").dropDuplicates(["h1"])
    classes = d.written(sets.select(*d.ordered("doc_id", "doc", "pos"), "n", "sketch", "half", "prefix"), "classes")
    every = {tuple(r) for r in d.candidates(d.prefix_rows(classes.withColumn("settled", F.lit(False)))).collect()}
    marked = d.candidates(d.prefix_rows(classes.withColumn("settled", F.when(F.col("doc") % 2 == 0, True))))
    assert {tuple(r) for r in marked.collect()} == {r for r in every if r[1] % 2} != every
    assert marked._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_only_documents_with_lines_to_verify_are_cut_into_lines(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"a{k} b\nc d") for k in range(1000)] + [(None, "e f"), (7, "g h")], "doc_id long, text string")
    lines = d.lines_of(df).filter("doc_id = 7 and pos = 0 or doc_id is null").select(*d.ordered("doc_id", "doc", "pos"))
    cut = []
    monkeypatch.setattr(d, "lines_of", lambda docs, f=d.lines_of: cut.append(docs.count()) or f(docs))
    assert sorted(len(r["words"]) for r in d.word_lists(df, lines).collect()) == [2, 2, 2]
    assert len(cut) == 1 and 3 <= cut[0] < 100
