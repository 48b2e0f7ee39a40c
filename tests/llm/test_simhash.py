import numpy as np
import xxhash

from vellumine.llm import simhash as s
from vellumine.llm.components import connected_components


def slow_fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for w in "\t\n\v\f\r":
        t = t.replace(w, " ")
    w = [x for x in t.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_fingerprints():
    for t in ("", None, "One", "a B", "x y z", "É é\u00a0É word\tnext\x0bLine  end", "the cat sat on the mat " * 30):
        assert s.fingerprint(t) == slow_fingerprint(t)


def test_components_of_fingerprints_equal_brute_force_even_when_keys_are_dealt_again(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 64, 12, dtype=np.uint64)]
    prints = {0, *base}
    for b in base[:4]:
        for _ in range(20):
            x = b
            for bit in rng.integers(0, 64, rng.integers(1, 7)):
                x ^= 1 << int(bit)
            prints.add(x)
    expected = slow_components(sorted(prints))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "p long")
    for group in (4096, 8):
        found = {r["node"]: r["component"] for r in connected_components(s.links(df, group=group)).collect()}
        groups = {}
        for p in prints:
            groups.setdefault(found.get(signed(p), signed(p)), set()).add(p)
        slow = {}
        for p in prints:
            slow.setdefault(expected[p], set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, slow.values()))


def test_few_free_bits_end_for_any_group(spark):
    df = spark.createDataFrame([(x,) for x in range(8)], "p long")
    for group in (1, 2):
        found = {r["node"]: r["component"] for r in connected_components(s.links(df, group=group)).collect()}
        assert found == dict.fromkeys(range(8), 0)


def test_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    rows = [(1, None), (2, ""), (9, " \n ")]
    for k in range(40):
        text = [str(w) for w in rng.choice(words, 120)]
        for j in range(3):
            rows.append((10 + 3 * k + j, " ".join(text)))
            text[int(rng.integers(0, 120))] = "New"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = s.op3_simhash(spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    prints = {i: slow_fingerprint(t) for i, t in rows}
    root, least = slow_components(sorted(set(prints.values()))), {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()} == {(i, f"{p:016x}", least[root[p]]) for i, p in prints.items()}
    assert len(set(least.values())) < len(set(prints.values()))


def test_nulls_repeats_and_empty_tables(spark):
    text = "some words that make up a text of a fair length for a test"
    rows = [(5, text), (3, text), (3, text), (None, text), (9, None), (8, ""), (7, "another thing altogether, this one"), (None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string")
    got = [(r["doc_id"], r["component_id"]) for r in s.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (9, 8), (8, 8), (7, 7), (None, 8)], key=str)
    kept = s.one_of_each(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 8]
    assert s.near_duplicates(df.limit(0)).count() == 0


def test_long_chains_of_links_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(300, 300), (400, 500), (500, 400)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {400: 400, 500: 400}


def slow_one_of_each(rows):
    """The (doc_id, text) that stay: of each component of fingerprints the smallest id, nulls last, then any of its texts."""
    root = slow_components(sorted({slow_fingerprint(t) for _, t in rows}))
    groups = {}
    for i, t in rows:
        groups.setdefault(root[slow_fingerprint(t)], []).append((i is None, i or 0, t))
    return [{(None if none else i, t) for none, i, t in g if (none, i) == min(x[:2] for x in g)} for g in groups.values()]


def test_one_row_of_each_component_with_null_and_repeated_ids(spark):
    words = np.random.default_rng(3).permutation([f"w{i}" for i in range(400)])
    a, b, c, d, e, f = (" ".join(words[k * 40 : k * 40 + 40]) for k in range(6))
    rows = [(3, a), (5, a), (5, b), (None, c), (None, d), (None, d), (None, d.upper()), (None, e), (8, e), (9, f), (9, f.upper()), (9, f), (None, None)]
    for rows_ in (rows, [(5, b), (5, a), (3, a)], [(3, b), (5, b), (5, a)]):
        kept = [(r["doc_id"], r["text"]) for r in s.one_of_each(spark.createDataFrame([(*r, 1) for r in rows_], "doc_id long, text string, n int")).collect()]
        expected = slow_one_of_each(rows_)
        assert len(kept) == len(expected) and all(any(k in e for k in kept) for e in expected)
    empty = spark.createDataFrame([], "doc_id long, text string, n int")
    assert s.one_of_each(empty).count() == 0
