"""Project statistics: status counts, most frequent terms, average confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.sources.tables import table


def top_terms(rows: DataFrame, terms: str, limit: int = 20) -> DataFrame:
    """The most frequent elements of the array column `terms`; ties go to the smaller term.

    The count is combined on the map side, and the top-k needs no global sort.
    """
    return (
        rows.select(F.explode(terms).alias("term"))
        .filter(F.col("term") != "")
        .groupBy("term")
        .agg(F.count("*").alias("frequency"))
        .orderBy(F.desc("frequency"), F.asc("term"))
        .limit(limit)
    )


def stats_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.lower("text"), r"[ \n]+").alias("words")
    return top_terms(table(spark, sf_dir, "documents").select(words), "words")


def stats_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per status of each project: orders of a nation, over its customers."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    is_status = lambda *s: F.count_if(F.col("o_orderstatus").isin(*s))
    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .groupBy("c_nationkey")
        .agg(F.count("*").alias("total"), is_status("F").alias("processed"), is_status("O").alias("processing"), is_status("P").alias("review"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("project"), "total", "processed", "processing", "review")
    )


def stats_avg_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The average quality of labelled documents per language, rounded; null where none is labelled."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n_docs"), F.count("quality").alias("n_labelled"), F.round(F.avg("quality"), 4).alias("avg_quality"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_top_terms(spark, sf_dir)


QUERIES = {"stats_top_terms": stats_top_terms, "stats_status_counts": stats_status_counts, "stats_avg_confidence": stats_avg_confidence}

ORACLES = {
    "stats_top_terms": """
        select term, count(*) as frequency
        from (select unnest(regexp_split_to_array(lower(text), '[ \\n]+')) as term from documents)
        where term <> '' group by term order by frequency desc, term limit 20""",
    "stats_status_counts": """
        select n_name as project, count(*) as total,
               count(*) filter (o_orderstatus = 'F') as processed,
               count(*) filter (o_orderstatus = 'O') as processing,
               count(*) filter (o_orderstatus = 'P') as review
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
        group by n_name""",
    "stats_avg_confidence": """
        select lang, count(*) as n_docs, count(quality) as n_labelled, round(avg(quality), 4) as avg_quality
        from documents left join labels using (doc_id) group by lang""",
}
