"""Documents that arrive in a folder, extracted as they come and appended to the store as batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from vellumine.operators import log


def ingest(spark: SparkSession, arrivals: str, schema: StructType, extract: Callable[[DataFrame], DataFrame], store: str, checkpoint: str) -> StreamingQuery:
    """Appends extract(new JSON records) to the log in `store`, one batch for each trigger, until all arrivals are read.

    A batch that is run again after a failure replaces itself, as its number is its sequence number; so each record
    counts once. Records that do not fit the schema are dropped.
    """
    rows = spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(arrivals)
    save = lambda batch, number: log.append(extract(batch), store, number)
    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
