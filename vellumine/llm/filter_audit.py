"""What filters remove in every order, by depth-first execution of their permutation trie.

n filters have n! orders. An order is a path in a trie, and which rows survive a prefix depends only on the set of its
filters; so of the trie's prefixes one for each set is executed. The walk goes depth-first: the survivors of a prefix
are a persisted DataFrame, made by applying one more filter to their parent's, and one aggregation over them counts
what every next filter removes. Counts of a set that was reached before are taken from what its first visit wrote. At
most n frames are persisted at a time, and each is let go when all below it is counted.

Rows move only for aggregations by part, combined on the map side, so a part with a third of all rows costs no more
than others. The filters' verdicts on a text are computed once and written without it. A lost executor costs the blocks
it persisted: Spark makes them again from the written verdicts.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.common import SPACE, discard, new_path, table, with_facts, written

_COUNTS = ("kept", "removed")


def _name(state: frozenset[str], filters: Sequence[str]) -> str:
    return "-".join(["applied", *[f for f in filters if f in state]])


def edges(rows: DataFrame, filters: Sequence[str], part: str, lost: Sequence[str]) -> DataFrame:
    """part, state (the filters applied before), filter, kept, removed and one count for each column of `lost`.

    rows holds a boolean column for each filter, true where it fails, and one for each of `lost`. Parts of which nothing
    is left in a state have no row there.
    """
    spark = rows.sparkSession
    folder = new_path(spark, "audit-edges")
    counted: set[frozenset[str]] = set()

    def visit(state: frozenset[str], survivors: DataFrame) -> None:
        counted.add(state)
        following = [f for f in filters if f not in state]
        if not following:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        sums = {"_n": F.count("*")}
        for f in following:
            sums |= {f"_{f}": F.count_if(F.col(f))} | {f"_{f}_{x}": F.count_if(F.col(f) & F.col(x)) for x in lost}
        by_part = survivors.groupBy(part).agg(*[c.alias(k) for k, c in sums.items()])
        edge = [
            F.struct(F.lit(f).alias("filter"), (F.col("_n") - F.col(f"_{f}")).alias("kept"), F.col(f"_{f}").alias("removed"), *[F.col(f"_{f}_{x}").alias(x) for x in lost])
            for f in following
        ]
        by_part.select(part, F.explode(F.array(*edge)).alias("_edge")).select(part, "_edge.*").write.parquet(f"{folder}/state={_name(state, filters)}")
        for f in following:
            if state | {f} not in counted:
                visit(state | {f}, survivors.filter(~F.col(f)))
        survivors.unpersist()

    visit(frozenset(), rows)
    counts = ", ".join(f"`{c}` long" for c in (*_COUNTS, *lost))
    return spark.read.schema(f"`{part}` string, filter string, {counts}, state string").parquet(folder)


def audit(rows: DataFrame, filters: Sequence[str], part: str = "part", lost: Sequence[str] = ()) -> DataFrame:
    """One row for each part, each order of the filters and each step of it.

    Columns: part, filter_order (the filters' names, joined), step (from 1), filter, kept, removed, redundant (failing
    the filter, removed earlier), unique_fails (failing this filter only), the `lost` columns (removed here, where true)
    and shapley (rows that the filter removes, summed over all orders). rows: a string column of parts, without nulls,
    and boolean columns without nulls. The filters' names are distinct; a table without rows gives none. The result has
    n * n! rows a part, and 2**n sets are executed: a handful of filters, not dozens.
    """
    n = len(filters)
    rows = rows.select(part, *filters, *lost)
    spark = rows.sparkSession
    found = edges(rows, filters, part, lost)
    alone = lambda f: F.col(f) & ~F.greatest(*[F.col(x) for x in filters if x != f], F.lit(False), F.lit(False))
    totals = rows.groupBy(part).agg(*[F.count_if(F.col(f)).alias(f"_fails_{f}") for f in filters], *[F.count_if(alone(f)).alias(f"_only_{f}") for f in filters])
    sets = [frozenset(c) for size in range(n) for c in combinations(filters, size)]
    every = [
        F.struct(F.lit(_name(s, filters)).alias("state"), F.lit(f).alias("filter"), F.lit(factorial(len(s)) * factorial(n - 1 - len(s))).cast("long").alias("_orders"), F.col(f"_fails_{f}").alias("_fails"), F.col(f"_only_{f}").alias("unique_fails"))
        for s in sets
        for f in filters
        if f not in s
    ]
    all_edges = totals.select(part, F.explode(F.array(*every)).alias("_edge")).select(part, "_edge.*")
    filled = all_edges.join(found, [part, "state", "filter"], "left").fillna(0, [*_COUNTS, *lost])
    filled = written(filled.withColumn("redundant", F.col("_fails") - F.col("removed")), "audit-filled")
    share = filled.groupBy(part, "filter").agg(F.sum(F.col("removed") * F.col("_orders")).alias("shapley"))
    steps = [("".join(o), k + 1, _name(frozenset(o[:k]), filters), f) for o in permutations(filters) for k, f in enumerate(o)]
    # n * n! rows, whatever the table's size
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, state string, filter string"))
    out = filled.join(share, [part, "filter"]).join(steps, ["state", "filter"])
    return out.select(part, "filter_order", "step", "filter", *_COUNTS, "redundant", "unique_fails", *lost, "shapley")


def verdicts(docs: DataFrame) -> DataFrame:
    """part, doc_id, digest of the text, and what the filters of texts say: true where the document fails.

    A: under 50 words; B: fewer than 65 distinct words in 100; C: over 5 capitals A-Z in 100 code points; D: holds a mark
    of `#$%&*|`. A null text is empty, a null source the empty part. Each text is split once, on the JVM.
    """
    text = F.coalesce("text", F.lit(""))
    words = docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"), F.array_remove(F.split(text, SPACE), "").alias("_words")
    )
    n = F.size("_words")
    capitals = F.length("_text") - F.length(F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return words.select(
        "part", "doc_id", F.unhex(F.sha2("_text", 256)).alias("digest"),
        (n < 50).alias("A"),
        (F.lit(100) * F.size(F.array_distinct("_words")) < n * 65).alias("B"),
        (capitals.cast("long") * 100 > F.length("_text").cast("long") * 5).alias("C"),
        (F.length(F.translate("_text", "#$%&*|", "")) < F.length("_text")).alias("D"),
    )


def with_repeats(rows: DataFrame) -> DataFrame:
    """rows with E: whether a smaller doc_id has the same digest. A null doc_id is neither smaller nor larger than any.

    Only digests of two rows or more have a fact to look up; the most frequent ones are looked up without a shuffle.
    """
    facts = rows.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    facts = written(facts, "audit-repeats")
    return with_facts(rows, facts, "digest", "_n").withColumn("E", F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))).drop("_first", "_n")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good_lost (a label of that doc_id has quality 1) and toxic_lost (one has toxic 1). Null ids have none."""
    marks = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good_lost"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic_lost"))
    none = rows.filter("doc_id is null").select("*", F.lit(False).alias("good_lost"), F.lit(False).alias("toxic_lost"))
    return rows.filter("doc_id is not null").join(marks, "doc_id", "left").fillna(False, ["good_lost", "toxic_lost"]).unionByName(none)


FILTERS, LOST = "ABCDE", ("good_lost", "toxic_lost")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = written(verdicts(table(spark, sf_dir, "documents")), "audit-verdicts")
    rows = with_labels(with_repeats(judged), table(spark, sf_dir, "labels"))
    rows = written(rows.select("part", *FILTERS, *LOST), "audit-rows")
    discard(judged)
    out = audit(rows, FILTERS, "part", LOST)
    return out.select("part", "filter_order", "step", *_COUNTS, "redundant", "unique_fails", *LOST, "shapley")


QUERIES = {"op12_filter_audit": op12_filter_audit}

ORACLES = {
    "op12_filter_audit": r"""
        with d as (select coalesce(source, '') as part, doc_id, coalesce(text, '') as text from documents),
        w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as earliest from d),
        l as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
        r as (select part, len(words) < 50 as a, 100 * len(list_distinct(words)) < 65 * len(words) as b,
                     100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d,
                     coalesce(w.doc_id > earliest, false) as e, coalesce(good, false) as good, coalesce(toxic, false) as toxic
              from w left join l on w.doc_id = l.doc_id),
        f as (select part, good, toxic, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as mask, count(*) as n from r group by all),
        k as (select unnest(['A', 'B', 'C', 'D', 'E']) as name, unnest([1, 2, 4, 8, 16]) as bit),
        o as (select k1.name || k2.name || k3.name || k4.name || k5.name as filter_order, [k1.bit, k2.bit, k3.bit, k4.bit, k5.bit] as bits
              from k k1, k k2, k k3, k k4, k k5
              where len(list_distinct([k1.bit, k2.bit, k3.bit, k4.bit, k5.bit])) = 5),
        s as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as before
              from o, (select unnest([1, 2, 3, 4, 5]) as step)),
        x as (select part, filter_order, step, bit,
                     sum(n) filter (mask & before = 0 and mask & bit = 0) as kept, sum(n) filter (mask & before = 0 and mask & bit <> 0) as removed,
                     sum(n) filter (mask & before <> 0 and mask & bit <> 0) as redundant, sum(n) filter (mask = bit) as unique_fails,
                     sum(n) filter (mask & before = 0 and mask & bit <> 0 and good) as good_lost, sum(n) filter (mask & before = 0 and mask & bit <> 0 and toxic) as toxic_lost
              from f, s group by all)
        select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
               coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
               coalesce(sum(removed) over (partition by part, bit), 0)::bigint as shapley
        from x""",
}
