import json

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vellumine.functions import text
from vellumine.operators import log
from vellumine.streaming.ingest import ingest


def test_arrivals_are_extracted_once(spark, tmp_path):
    arrivals = tmp_path / "in"
    arrivals.mkdir()
    schema = StructType([StructField("name", StringType()), StructField("text", StringType())])
    extract = lambda d: d.select("name", F.array_join(text.emails(F.col("text")), ",").alias("emails"))
    run = lambda: ingest(spark, str(arrivals), schema, extract, str(tmp_path / "store"), str(tmp_path / "checkpoint")).awaitTermination()
    put = lambda name, body: (arrivals / f"{name}.json").write_text(json.dumps({"name": name, "text": body}))
    put("a", "x@y.org")
    run()
    put("b", "none")
    run()
    run()
    got = {r["name"]: r["emails"] for r in log.current(spark, str(tmp_path / "store"), ["name"]).collect()}
    assert got == {"a": "x@y.org", "b": ""}
