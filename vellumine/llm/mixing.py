"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash. A source whose target is t times its size takes all its documents floor(t)
times, and once more those whose hash lies below a threshold; the documents taken at least once, twice and three
times are thus nested. A threshold is found without sorting: words are summed by source and hash bucket, the bucket
in which the budget runs out is found from at most 2**BITS sums for each source, and only the rows of that bucket
are summed again, by the next BITS bits, until it holds a single document. Sums are combined on the map side, so a
source with a third of all rows costs no more than any other. The last document is taken if that comes nearer to
the target, so a source is off by half a document at most.

Rows alike in doc_id and text share a hash. If the budget runs out among such rows, as many of them are taken as come
nearest to the target: which ones is settled by a second threshold, on a hash of the row's number in the written table.
As they are alike, reruns agree on what the mix holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.llm.common import table, written

#: The hash has LEVELS * BITS bits; each level of refinement splits a bucket in 2**BITS.
BITS, LEVELS = 10, 6

#: Weights by the rank of the source, repeating, and the most times that a document is taken.
WEIGHTS, MOST = (5, 2, 1), 3


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash(*columns: Column) -> Column:
    """60 bits of the MD5 of the columns, the same in every run and engine."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def ranked(totals: DataFrame) -> DataFrame:
    """totals with rank (from 0) of its source by code point, null last, without one task that holds all rows."""
    sorted_ = totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    sorted_ = written(sorted_, "mix-sources")
    counts = sorted_.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return sorted_.withColumn("_at", within).join(starts, "_part").select(*totals.columns, (F.col("_start") + F.col("_at") - 1).alias("rank"))


def with_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """totals (source, source_size) with target: shares by weight of all words, none above `most` times its size.

    What exceeds a cap is shared again by weight among the others. Every round is one aggregation over the sources
    that gives three numbers; a source once capped stays so, and the rounds end when no more are.
    """
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = written(ranked(totals).withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most), "mix-weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    left, heavy, capped = total, None, -1
    above = F.lit(False)
    while True:
        row = sources.agg(
            F.sum(F.when(above, F.col("cap")).otherwise(F.lit(0))).alias("caps"),
            F.sum(F.when(above, F.lit(0)).otherwise(F.col("weight"))).alias("weights"),
            F.count_if(above).alias("n"),
        ).first()
        if row["n"] == capped:
            break
        capped, left, heavy = row["n"], total - (row["caps"] or 0), row["weights"] or 0
        above = above | (F.col("cap") < F.col("weight") * F.lit(float(left)) / F.lit(float(max(heavy, 1))))
    share = F.col("weight") * F.lit(float(left)) / F.lit(float(max(heavy, 1)))
    return sources.select("source", "source_size", F.when(F.col("cap") < share, F.col("cap").cast("double")).otherwise(share).alias("target"))


def _refined(sized: DataFrame, state: DataFrame, name: str) -> tuple[DataFrame, int]:
    """state with the bucket of sized (source, size, hash) in which each source's budget runs out, and its bits.

    state: source, budget, prefix, before (words below the bucket), words and docs (of the bucket), and more columns.
    """
    own = [c for c in state.columns if c not in ("prefix", "before", "words", "docs")]
    state = written(state, f"{name}-0")
    done = 0
    for level in range(1, LEVELS + 1):
        if not state.filter((F.col("docs") > 1) & (F.col("budget") > 0)).limit(1).count():
            break
        shift = BITS * (LEVELS - level)
        kept = state.select(F.col("source").alias("_source"), "prefix", "before", "budget").filter("budget > 0")
        inside = F.shiftright("hash", shift + BITS) == F.col("prefix")
        sums = (
            sized.join(kept, sized.source.eqNullSafe(kept._source) & inside)
            .groupBy("source", F.shiftright("hash", shift).alias("bucket"))
            .agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
            .filter("words > 0")
        )
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("prior", F.coalesce(F.sum("words").over(running), F.lit(0)))
        edge = (
            sums.join(kept, sums.source.eqNullSafe(kept._source))
            .filter((F.col("before") + F.col("prior") <= F.col("budget")) & (F.col("before") + F.col("prior") + F.col("words") > F.col("budget")))
            .select(F.col("source").alias("_source"), F.struct(F.col("bucket"), (F.col("before") + F.col("prior")).alias("before"), "words", "docs").alias("_edge"))
        )
        state = written(
            state.join(edge, state.source.eqNullSafe(edge._source), "left").select(
                *own,
                F.coalesce("_edge.bucket", F.shiftleft("prefix", BITS)).alias("prefix"),
                F.coalesce("_edge.before", "before").alias("before"),
                F.coalesce("_edge.words", "words").alias("words"),
                F.coalesce("_edge.docs", F.lit(0)).alias("docs"),
            ),
            f"{name}-{level}",
        )
        done = level
    return state, BITS * (LEVELS - done)


def _nearest(budget: Column, words: Column, docs: Column) -> Column:
    """How many of `docs` documents alike, `words` in all, come nearest to the budget."""
    each = words / docs
    return F.when((docs > 0) & (words > 0), F.greatest(F.lit(0), F.least(docs, F.ceil((budget * 2 - each) / (each * 2))))).otherwise(F.lit(0)).cast("long")


def thresholds(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """For each source of sized (source, size, hash): source, source_size, target, whole copies, the threshold below which a
    document's hash gives it one copy more, and edge and extra: so many of the rows with the hash `edge` get one more too."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    target = with_targets(totals, weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = target.withColumn("whole", whole).withColumns({
        "budget": F.col("target") - F.col("whole") * F.col("source_size"),
        "prefix": F.lit(0).cast("long"),
        "before": F.lit(0).cast("long"),
        "words": F.col("source_size"),
        "docs": F.lit(2).cast("long"),
    })
    state, shift = _refined(sized, state, "mix-state")
    # a bucket with one document holds its hash alone, whatever bits are open; with more, all bits are used up
    fits = F.when(F.col("budget") > 0, _nearest(F.col("budget") - F.col("before"), F.col("words"), F.col("docs"))).otherwise(F.lit(0))
    whole_bucket = fits >= F.greatest("docs", F.lit(1))
    limit = F.when(F.col("budget") > 0, F.shiftleft(F.col("prefix") + whole_bucket.cast("long"), shift)).otherwise(F.lit(0))
    parted = (F.col("docs") > 1) & (fits > 0) & ~whole_bucket
    return state.select("source", "source_size", "target", "whole", limit.alias("threshold"), F.when(parted, F.col("prefix")).alias("edge"), F.when(parted, fits).otherwise(F.lit(0)).alias("extra"))


def edge_thresholds(sized: DataFrame, limits: DataFrame) -> DataFrame:
    """limits with edge_threshold: of the rows with the hash `edge`, those whose row_hash lies below it are the `extra` ones."""
    parted = limits.filter("extra > 0").select(F.col("source").alias("_source"), "edge")
    rows = sized.join(parted, sized.source.eqNullSafe(parted._source) & (sized.hash == parted.edge)).select("source", F.lit(1).alias("size"), F.col("row_hash").alias("hash"))
    state = limits.withColumns({
        "budget": F.col("extra").cast("double"), "prefix": F.lit(0).cast("long"), "before": F.lit(0).cast("long"), "words": F.col("extra"), "docs": F.when(F.col("extra") > 0, 2).otherwise(0).cast("long"),
    })
    state, shift = _refined(rows, state, "mix-edge")
    return state.select(*limits.columns, F.when(F.col("extra") > 0, F.shiftleft("prefix", shift)).otherwise(F.lit(0)).alias("edge_threshold"))


def mix(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """docs (source, hash, row_hash and more) with source_size, target and copies: how often the mix takes each row.

    limits has one row for each source (edge_thresholds()); Spark broadcasts it if it is small enough, and no row moves.
    """
    lim = limits.select(F.col("source").alias("_source"), "source_size", "target", "whole", "threshold", "edge", "edge_threshold")
    out = docs.join(lim, docs.source.eqNullSafe(lim._source), "left")
    more = (F.col("hash") < F.col("threshold")) | F.coalesce((F.col("hash") == F.col("edge")) & (F.col("row_hash") < F.col("edge_threshold")), F.lit(False))
    return out.withColumn("copies", F.col("whole") + more.cast("long")).drop("_source", "whole", "threshold", "edge", "edge_threshold")


def sized(docs: DataFrame) -> DataFrame:
    """source, size and hash of each document. Null texts have size 0; a null source is a source of its own."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("hash"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows as a written table with row_hash, a hash of the number that each row got when it was written."""
    return written(rows.withColumn("row_hash", row_hash(F.monotonically_increasing_id())), "mix-sized")


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken, with the columns of docs.

    Where only some of the rows alike in doc_id and text are taken once more, one of them (the last by its columns) stands for
    all that are, as its texts are theirs. An empty table gives an empty mix.
    """
    limits = thresholds(written(sized(docs).select("source", "size", "hash"), "mix-sized"), weights, most)
    limits = written(limits, "mix-limits")
    lim = limits.select(F.col("source").alias("_source"), "whole", "threshold", "edge", "extra")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", row_hash(F.col("doc_id"), F.col("text")).alias("hash"))
    rows = rows.join(lim, rows.source.eqNullSafe(lim._source))
    copies = F.col("whole") + (F.col("hash") < F.col("threshold")).cast("long")
    taken = rows.withColumn("copies", copies).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies")))
    more = rows.filter("extra > 0 and hash = edge").groupBy("_source", "extra").agg(F.max_by("row", F.to_json("row")).alias("row"))
    return taken.select("row.*").unionByName(more.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "extra"))).select("row.*"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(sized(table(spark, sf_dir, "documents")))
    out = mix(rows, edge_thresholds(rows, thresholds(rows)))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op4_mix_sources": op4_mix_sources}

ORACLES = {
    "op4_mix_sources": r"""
        with d as (
          select doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end as size,
                 ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')), 1, 15))::bigint as hash
          from documents),
        s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from d group by source),
        w as (select *, case rank % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 3 * source_size as cap from s),
        o as (select *, row_number() over (order by cap / weight, rank) as k from w),
        l as (select *, (sum(source_size) over ())::bigint as total,
                     coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0)::bigint as caps,
                     (sum(weight) over (order by k rows between current row and unbounded following))::bigint as heavy from o),
        f as (select total - caps as rest, heavy from l where cap >= weight * (total - caps)::double / heavy::double order by k limit 1),
        t as (select source, source_size, case when cap < weight * rest::double / heavy::double then cap::double else weight * rest::double / heavy::double end as target
              from w, f),
        b as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from t),
        h as (select d.source, d.hash, sum(size) as words, count(*) as docs from d where size > 0 group by d.source, d.hash),
        c as (select h.source, h.hash, h.words / h.docs as each, b.target - b.whole * b.source_size as budget,
                     coalesce(sum(words) over (partition by h.source order by hash rows between unbounded preceding and 1 preceding), 0) as prior
              from h join b on h.source is not distinct from b.source),
        x as (select source, hash, greatest(0, ceil((2 * (budget - prior) - each) / (2 * each))) as extra from c),
        n as (select *, row_number() over (partition by source, hash) as copy from d)
        select d.doc_id, d.size::bigint as size, b.source_size, b.target,
               (d.size * (b.whole + case when d.copy <= x.extra then 1 else 0 end))::bigint as taken
        from n d join b on d.source is not distinct from b.source
        left join x on x.source is not distinct from d.source and x.hash = d.hash""",
}
