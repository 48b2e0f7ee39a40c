"""What several operators share: the cluster's shared folder, written intermediate tables, word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.sources.tables import table  # noqa: F401  (re-exported for the queries)

#: Words are the runs of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where the session sets none and all runs in one process on one machine, as in tests, a temporary folder takes its
    place; on a cluster that is an error, since each executor would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/vellumine/{name}-{uuid.uuid4().hex}"


#: Settings while a table is written. Spark deletes the job's shuffle files when it ends, not at some later garbage
#: collection, and reads Parquet and hands Python texts in batches of fewer rows, as each batch is held several times in
#: memory, and the reader's column of 4096 long texts is one large array.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.parquet.columnarReaderBatchSize": "1000"}


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so a lost executor costs no recomputation.

    Nothing reads the shuffle files of the job that wrote it, so they go at once.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written() tables that no later step reads. Only what lies in this package's part of the shared folder goes."""
    for df in tables:
        spark = df.sparkSession
        own = f"{shared_dir(spark).rpartition('://')[2]}/vellumine/"
        for folder in {path.rpartition("/")[0] for path in df.inputFiles()}:
            if own in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more than one row in so many is hot; so there are fewer hot keys than this.
HOT_KEYS = 4096


def with_facts(rows: DataFrame, facts: DataFrame, key: str, n: str, hot: int = HOT_KEYS) -> DataFrame:
    """rows with the columns of facts, null where there is no fact; facts has one row a key and, as `n`, the key's rows.

    Hot keys are fewer than `hot`, whatever the tables' size: their facts are broadcast, and their rows stay where they
    are. The other rows are joined by a shuffle in which no key has more than one row in `hot`. facts is a written table;
    keys are not null.
    """
    total = facts.agg(F.sum(n)).first()[0] or 0
    heavy = F.broadcast(facts.filter(F.col(n) * hot > total))
    light = facts.filter(F.col(n) * hot <= total)
    rest = rows.join(F.broadcast(facts.filter(F.col(n) * hot > total).select(key)), key, "left_anti")
    return rows.join(heavy, key).unionByName(rest.join(light, key, "left"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def column_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores in front until df has no column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
