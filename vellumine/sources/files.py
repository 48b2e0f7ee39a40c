"""Documents as files: discovery, JSON scan and sink, inventory. All through Spark's own readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellumine.functions.geometry import layout_json

#: Endings of the documents that are taken, and their media types.
MEDIA_TYPES = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword", "json": "application/json", "txt": "text/plain",
    "rtf": "application/rtf",
}
DOCUMENTS = ("pdf", "docx", "doc")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def media_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(known, ending(path)), F.lit("application/octet-stream"))


def is_document(path: Column) -> Column:
    """A supported ending, and neither hidden nor an editor's lock file."""
    return ending(path).isin(*DOCUMENTS) & ~file_name(path).rlike(r"^(\.|~\$)")


def discover(spark: SparkSession, folder: str, recursive: bool = False, without: Sequence[str] = ()) -> DataFrame:
    """path, name, bytes, kilobytes, sha256, media_type, content of the documents in a folder, but for those in folders named in
    `without`, such as the one that results go to. Nothing is ordered: in_order() gives the order of names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).filter(is_document(F.col("path")))
    for part in without:
        files = files.filter(~F.contains("path", F.lit(f"/{part}/")))
    return files.select(
        "path", file_name(F.col("path")).alias("name"), F.col("length").alias("bytes"), F.round(F.col("length") / 1024, 2).alias("kilobytes"),
        F.sha2("content", 256).alias("sha256"), media_type(F.col("path")).alias("media_type"), "content",
    )


def in_order(found: DataFrame) -> DataFrame:
    """Found documents by name in lower case, then path."""
    return found.orderBy(F.lower("name"), "path")


def printable_runs(content: Column, least: int = 11) -> Column:
    """Runs of printable ASCII of at least `least` characters with a letter in them, of a binary column."""
    runs = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(r"[\x20-\x7E]{4,}"), F.lit(0))
    return F.filter(runs, lambda x: (F.length(x) >= least) & x.rlike("[A-Za-z]"))


def read_records(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """JSON records of a folder, one in each file; broken files and the manifest are left out."""
    name = schema.fields[0].name
    rows = spark.read.schema(schema.add("_broken", "string")).option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(folder)
    rows = rows.withColumn("path", F.input_file_name())
    return rows.filter(F.col("_broken").isNull() & (file_name(F.col("path")) != "manifest.json") & F.col(name).isNotNull()).drop("_broken")


def write_records(df: DataFrame, folder: str, private: tuple[str, ...] = ("embedding", "entities")) -> None:
    """df as JSON lines without the private columns."""
    df.drop(*private).write.mode("overwrite").json(folder)


def write_layers(pages: DataFrame, folder: str, stem_: str = "file_stem") -> None:
    """The layout of each document as one JSON document, a row each, in a folder for each stem: pages has the stem and `pages`, an
    array of structs of a document's pages and layers."""
    pages.select(F.concat(F.col(stem_), F.lit("_layers")).alias("document"), layout_json(F.col("pages")).alias("value")).write.mode("overwrite").partitionBy("document").text(folder)


def manifest(items: DataFrame, status: str = "status") -> DataFrame:
    """One row: counters of a batch. items has status."""
    good = F.col(status).isin("success", "partial")
    return items.agg(F.count("*").alias("total_files_found"), F.count_if(good).alias("total_success"), F.count_if(~good).alias("total_failed"))


def select_records(df: DataFrame, profile: str | None = None, least_score: float | None = None, include_deleted: bool = False) -> DataFrame:
    """Records (is_deleted, overall_profile, score) that are not deleted, whose profile holds the given text in any case,
    and whose score, 0 if missing, reaches the least; conditions that are not given let all pass."""
    kept = F.lit(True) if include_deleted else ~F.coalesce("is_deleted", F.lit(False))
    if profile:
        kept = kept & F.coalesce(F.contains(F.lower("overall_profile"), F.lit(profile.lower())), F.lit(False))
    if least_score is not None:
        kept = kept & (F.coalesce(F.col("score").cast("double"), F.lit(0.0)) >= least_score)
    return df.filter(kept)


def resolved_files(wanted: DataFrame, known: DataFrame, files: DataFrame, key: str, folders: Sequence[str], records: str) -> DataFrame:
    """wanted (key, document_id, file_name) with path, shown and media_type of the file that each request means; null for none.

    The first that applies: the file that the document's record (known: document_id, file_name, file_url) points to; a file of
    the asked or recorded name in one of the folders, the first folder first; one of the same stem, whatever its case; the
    document's JSON record in the folder `records`. files has path and folder.

    Each request is a few keys with their level, and all of them meet all files by one equi-join; the least level wins. So
    files are shuffled once, not once a level, and a request never sees a file that none of its keys names.
    """
    known = known.groupBy("document_id").agg(F.max(F.struct("file_name", "file_url")).alias("_k"))
    asked = wanted.join(known, "document_id", "left").select(key, F.coalesce("file_name", "_k.file_name").alias("_name"), F.col("_k.file_url").alias("_url"))
    bare = F.lower(stem(F.col("_name")))
    wished = (F.concat(F.lit("path:"), "_url"), F.concat(F.lit("name:"), file_name(F.col("_name"))), F.concat(F.lit("stem:"), bare), F.concat(F.lit("json:"), stem(F.col("_name")), F.lit(".json")))
    keys = F.array(*[F.struct(F.lit(level).alias("level"), k.alias("k")) for level, k in enumerate(wished, 1)])
    asked = asked.select(key, "_name", F.explode(keys).alias("a")).select(key, "_name", "a.level", "a.k").filter("k is not null")
    own = file_name(F.col("path"))
    place = F.array_position(F.array(*map(F.lit, folders)), F.col("folder"))
    in_folder, is_record = place > 0, F.col("folder") == records
    offers = F.array(
        F.concat(F.lit("path:"), "path"), F.when(in_folder, F.concat(F.lit("name:"), own)), F.when(in_folder, F.concat(F.lit("stem:"), F.lower(stem(F.col("path"))))), F.when(is_record, F.concat(F.lit("json:"), own))
    )
    offered = files.select("path", place.alias("place"), F.explode(offers).alias("k")).filter("k is not null")
    # per key the first file, before requests meet it: however many files share a stem, a request meets one
    offered = offered.groupBy("k").agg(F.min(F.struct("place", "path")).alias("f")).select("k", "f.path")
    best = asked.join(offered, "k").groupBy(key).agg(F.min(F.struct("level", "path", "_name")).alias("b"))
    shown = F.when(F.col("b.level") <= 2, F.coalesce("b._name", file_name(F.col("b.path")))).otherwise(file_name(F.col("b.path")))
    found = best.select(key, F.col("b.level").alias("level"), F.col("b.path").alias("path"), shown.alias("shown"), media_type(F.col("b.path")).alias("media_type"))
    return wanted.select(key).join(found, key, "left")


def by_stem(df: DataFrame, wanted: str, path: str = "path") -> DataFrame:
    """The records of the file of that stem; folders and characters that no file name holds are taken out of it first."""
    bare = "".join("_" if c in '<>:"|?*' else c for c in wanted.replace("\\", "/").rsplit("/", 1)[-1]).strip()
    return df.filter(stem(F.col(path)) == bare)


def failed_records(df: DataFrame, path: str, error: str) -> DataFrame:
    """For the rows with an error: file_name, file_stem, status, name (the stem), empty lists, error_message."""
    none = F.array().cast("array<string>")
    return df.filter(F.col(error).isNotNull()).select(
        file_name(F.col(path)).alias("file_name"), stem(F.col(path)).alias("file_stem"), F.lit("failed").alias("status"), stem(F.col(path)).alias("name"),
        *[none.alias(c) for c in ("contact_no", "email", "skills", "education", "experience")], F.col(error).alias("error_message"),
    )
