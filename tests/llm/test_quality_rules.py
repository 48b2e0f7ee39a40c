from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from vellumine.llm import quality_rules as q


def slow_repeated(words):
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)})


def field(seed=3):
    rng = np.random.default_rng(seed)
    return q.Field(rng.normal(size=(q.N_VALUES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))


def weight(f, values, path):
    return f.first[path[0]] + sum(f.emit[v, y].sum() for v, y in zip(values, path)) + sum(f.step[a, b] for a, b in zip(path, path[1:]))


def sequences():
    rng = np.random.default_rng(5)
    return [np.stack([rng.integers(0, n, k) for n in q.SIZES], axis=1) + q.STARTS for k in (1, 6, 3, 0, 8, 6)]


def test_viterbi_finds_the_best_path():
    f = field()
    for values, path in zip(sequences(), q.viterbi(f, sequences()), strict=True):
        if len(values):
            best = max(product((0, 1), repeat=len(values)), key=lambda p: weight(f, values, p))
            assert tuple(path) == best


def test_forward_backward_sums_over_all_paths():
    f, seqs = field(), [s for s in sequences() if len(s)]
    padded, sizes = q._padded(seqs, 0)
    marginal, pairs = q._expected(f.emit[padded].sum(axis=2), sizes, f.step, f.first)
    expected_pairs = np.zeros((2, 2))
    for row, s in enumerate(seqs):
        paths = list(product((0, 1), repeat=len(s)))
        p = np.exp([weight(f, s, x) for x in paths])
        p /= p.sum()
        for k in range(len(s)):
            assert np.isclose(marginal[row, k, 1], sum(w for w, x in zip(p, paths) if x[k]))
        for w, x in zip(p, paths):
            for a, b in zip(x, x[1:]):
                expected_pairs[a, b] += w
    assert np.allclose(pairs, expected_pairs)


def test_base_counts():
    text = "a b c d e\nx #1 | y\na b c d e f a b c d e\n\n \nx #1 | y\nÄÖ"
    n, chars, symbols, dup, repeated = q.base_counts(text, text.split("\n"))
    words = text.split()
    assert (n, chars, symbols, dup) == (len(words), sum(map(len, words)), 4, 1)
    assert repeated == slow_repeated(words)
    rng = np.random.default_rng(0)
    for size in (0, 4, 5, 6, 40, 300):
        w = [b"w%d" % x for x in rng.integers(0, 3, size)]
        assert q.repeated_words(w) == slow_repeated(w)


def test_judges_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-2, ""), (-3, "word " * 9)], "doc_id long, text string")
    clashing = docs.unionByName(odd).withColumn("N_WORDS", F.lit("own"))
    out = q.judged(clashing, q.fit(docs)).toPandas()
    assert len(out) == 1004 and not out[out.doc_id < 0].kept.any()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = out[~out.base_failed].merge(labels, on="doc_id")
    assert both[both.quality == 1].kept.mean() > 0.98 and both[both.quality == 0].kept.mean() < 0.1
    assert q.judged(docs.limit(0), q.fit(docs.limit(0))).count() == 0


def test_notices_on_lines_of_any_length():
    at = len(q.SIZES) - 2
    footer, prose = "we use cookies and care for your privacy " * 60, "the mill stood by the river for years " * 60
    seen = [int(q.line_features([t])[0][0, at] - q.STARTS[at]) for t in (footer, prose, prose + "under copyright", "under copyright")]
    assert seen == [1, 0, 0, 1]


def test_whole_documents_train_the_field(spark, monkeypatch):
    monkeypatch.setattr(q, "train", lambda samples: samples)
    text = "\n".join(f"this is line number {i} of a long text." for i in range(600))
    ((values, labels),) = q.fit(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert len(values) == len(labels) == 600
    place = values[:, -1] - q.STARTS[-1]
    assert place[0] == 0 and place[-1] == 2 and (place[1:-1] == 1).all()


def test_the_sample_is_bounded_by_lines_and_takes_one_document_in_any_case(spark):
    docs = spark.createDataFrame([(i, "\n".join(["a line of some words here."] * 10)) for i in range(20)] + [(99, "x\n" * 5000)], "doc_id long, text string")
    assert q.sampled(docs, 1000, 60).count() == 6
    assert q.sampled(docs, 1000, 100_000).count() == 21
    assert q.sampled(docs.filter("doc_id = 99"), 1000, 60).count() == 1
    assert q.sampled(docs.limit(0), 10, 10).count() == 0


def test_a_text_of_very_many_lines_stays_within_memory():
    import tracemalloc

    lines = ["a line of some six words.", "### | | | !!", "other"] * 100_000
    values, _, labels = q.line_features(lines)
    field = q.Field(np.zeros((q.N_VALUES, 2)), np.zeros((2, 2)), np.zeros(2))
    short = [values[:4]] * 255
    tracemalloc.start()
    paths = q.viterbi(field, [values, *short])
    assert tracemalloc.get_traced_memory()[1] < 60e6 and len(paths[0]) == len(lines)
    tracemalloc.stop()
    tracemalloc.start()
    q.train([(values[:40_000], labels[:40_000]), *[(v, labels[:4]) for v in short]], epochs=1)
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()
