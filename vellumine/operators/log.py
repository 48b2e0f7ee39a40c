"""An append-only store: every save, edit, deletion and restoration is a batch of rows; the latest row of a key counts.

Parquet has no MERGE. A batch is written beside the others with a sequence number, so that readers see all of it or
nothing, a failed write leaves the store as it was, and a restored row is exactly the one that was deleted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators.store import latest_by, live, replacing


def append(batch: DataFrame, folder: str, seq: int) -> None:
    """Adds a batch of rows; those without is_deleted are live."""
    if "is_deleted" not in batch.columns:
        batch = batch.withColumn("is_deleted", F.lit(False))
    batch.write.mode("overwrite").parquet(f"{folder}/seq={seq}")


def current(spark: SparkSession, folder: str, keys: Sequence[str], include_deleted: bool = False) -> DataFrame:
    """The latest row of each key; without deleted ones unless they are asked for."""
    rows = latest_by(spark.read.parquet(folder), list(keys), ["seq"])
    return rows if include_deleted else live(rows)


def flagged(rows: DataFrame, keys: DataFrame, on: Sequence[str], deleted: bool) -> DataFrame:
    """The rows of these keys with the deletion flag set as given: the batch that deletes or restores them."""
    return rows.join(keys.select(*on).distinct(), list(on), "left_semi").drop("seq").withColumn("is_deleted", F.lit(deleted))


def visible(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """The rows of committed batches. seq is the folder that a batch lies in, so only their folders are read; commits has
    one row a batch and is compacted with its tables, so it is left to Spark's own size check whether it is broadcast."""
    return rows.join(commits.select("seq").distinct(), "seq", "left_semi")


def save(batch: dict[str, DataFrame], folder: str, seq: int) -> None:
    """Saves one batch to several tables as a whole: the tables' rows first, each in a folder of its own, the commit last.

    A failure before the commit leaves rows that no reader sees; saving the same seq again overwrites them. A seq that is
    committed is not saved again.
    """
    spark = next(iter(batch.values())).sparkSession
    if spark.read.schema("tables string, seq long").parquet(_made(spark, f"{folder}/commits")).filter(F.col("seq") == seq).limit(1).count():
        raise ValueError(f"batch {seq} is committed already")
    for name, rows in batch.items():
        append(rows, f"{folder}/{name}", seq)
    spark.range(1).select(F.lit(",".join(sorted(batch))).alias("tables")).write.mode("overwrite").parquet(f"{folder}/commits/seq={seq}")


def _made(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return folder


def saved(spark: SparkSession, folder: str, name: str, keys: Sequence[str], include_deleted: bool = False) -> DataFrame:
    """The latest committed row of each key of one of the tables."""
    commits = spark.read.schema("tables string, seq long").parquet(f"{folder}/commits")
    rows = latest_by(visible(spark.read.parquet(f"{folder}/{name}"), commits), list(keys), ["seq"])
    return rows if include_deleted else live(rows)


def document_batch(docs: DataFrame, children: dict[str, tuple[DataFrame, Sequence[str]]], stored: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """The rows of one save of whole documents: the documents, and for each table of children what the save brings and what
    it retires, of all saved documents, also of those that come without any.

    children: name -> (rows, the columns that tell a child of a document); stored: name -> the live rows before.
    """
    out = {"documents": docs.withColumn("is_deleted", F.lit(False))}
    for name, (rows, keys) in children.items():
        out[name] = replacing(rows, stored[name], key, keys, docs) if name in stored else rows.withColumn("is_deleted", F.lit(False))
    return out


def restored(rows: DataFrame, on: Sequence[str], deletion: int, keys: DataFrame, by: Sequence[str]) -> DataFrame:
    """The batch that restores what one deletion took: the rows that batch `deletion` wrote as deleted, for these keys,
    unless a later batch has written them again. rows is the whole log, with seq and is_deleted; on tells a row of the
    table, by a row of keys."""
    newest = latest_by(rows, list(on), ["seq"])
    return flagged(newest.filter((F.col("seq") == deletion) & F.col("is_deleted")), keys, by, False)


def compacted(spark: SparkSession, folder: str, keys: Sequence[str], target: str) -> None:
    """The current rows, deleted ones included, as a store of one batch in a new folder."""
    append(current(spark, folder, keys, include_deleted=True).drop("seq"), target, 0)
