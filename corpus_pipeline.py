"""The corpus pipeline: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the shared folder and read
again as the next stage's docs. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import line_dedup, mixing, packing, simhash, toxicity
from vellumine.llm.common import table, written

#: The tokenizer file and the id that ends a document.
TOKENIZER, END_ID = "word_bpe_49k.json", 1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier does not reject."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat or nearly repeat an earlier one; n_chars follows the text."""
    return line_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, packed into sequences."""
    cut = packing.pieces(docs, public_tokenizers.path(TOKENIZER), END_ID)
    rows = written(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pack-pieces")
    return packing.pack(rows).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("best-fit packing", pack),
]

#: Weak supervision, SimHash and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
