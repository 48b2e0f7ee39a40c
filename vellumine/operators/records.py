"""Calls that a record service makes, each as one plan: details of documents, edits of profiles, statistics of projects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions import notes as N
from vellumine.functions.skills import EDITABLE, editable
from vellumine.operators.store import latest_by, live


def details(docs: DataFrame, versions: DataFrame, values: DataFrame, key: str, by: str, profiles: DataFrame | None = None, blocks: DataFrame | None = None, include_deleted: bool = False) -> DataFrame:
    """docs (key and more) with everything known of them: by (the newest live version), fields and trace (maps by field), and
    profile (the newest live one, as a struct).

    versions: key, by; values: by, field, value, confidence, block_id; profiles: key, id and more; blocks: block_id, text. All
    but docs may have is_deleted. Values are joined with the asked documents' versions before they are aggregated; documents
    without a version, values or a profile have nulls there. trace has the confidence of each field and the text of its block.
    """
    lives = lambda df: live(df) if "is_deleted" in df.columns else df
    asked = docs if include_deleted else lives(docs)
    newest = lives(versions).join(asked.select(key), key, "left_semi").groupBy(key).agg(F.max(by).alias(by))
    known = lives(values).join(newest.select(by), by, "left_semi")
    if blocks is not None:
        known = known.join(blocks.select("block_id", F.col("text").alias("_text")), "block_id", "left")
    text = F.col("_text") if blocks is not None else F.lit(None).cast("string")
    entries = lambda item: F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", item))))
    wide = known.groupBy(by).agg(entries(F.col("value")).alias("fields"), entries(F.struct("confidence", text.alias("text"))).alias("trace"))
    out = asked.join(newest, key, "left").join(wide, by, "left").select(*asked.columns, by, "fields", "trace")
    if profiles is None:
        return out
    own = latest_by(lives(profiles).join(asked.select(key), key, "left_semi"), [key], ["id"])
    return out.join(own.select(key, F.struct(*[c for c in own.columns if c not in (key, "is_deleted")]).alias("profile")), key, "left")


def edited(profiles: DataFrame, updates: DataFrame, key: str, as_of: Column) -> DataFrame:
    """The batch of rows that edits save: for each key with updates, a new row with the allowed fields replaced, and found.

    profiles: key and the editable fields as strings; updates: key, changes (a map), author. A note goes in front of the notes,
    as a JSON list, and replaces an older one of the same text. Keys without a profile give a row with found = false and what
    the changes say; changes of other fields, and null ones, change nothing.
    """
    changes = updates.select(key, "author", editable(F.col("changes")).alias("_new"))
    rows = changes.join(profiles.withColumn("found", F.lit(True)), key, "left")
    new = lambda f: F.try_element_at("_new", F.lit(f))
    note = F.struct(F.md5(new("notes")).alias("id"), F.coalesce("author", F.lit("system")).alias("author"), new("notes").alias("text"), as_of.cast("string").alias("date"))
    noted = F.when(new("notes").isNotNull(), F.to_json(N.prepend_note(N.parse_notes(F.col("notes"), as_of), note))).otherwise(F.col("notes"))
    fields = [(noted if f == "notes" else F.coalesce(new(f), F.col(f))).alias(f) for f in EDITABLE]
    return rows.select(key, *fields, F.coalesce("found", F.lit(False)).alias("found"), F.array_sort(F.map_keys("_new")).alias("changed"))


def project_statistics(projects: DataFrame, docs: DataFrame, versions: DataFrame, key: str, by: str, statuses: Sequence[str]) -> DataFrame:
    """projects (project_id, name) with the live documents of each, their number by status, live versions and mean confidence.

    docs: key, project_id, status; versions: key, by, confidence. Versions are reduced to one row a document before they meet
    their project, so the join that follows moves as many rows as there are documents. Projects without documents have zeros.
    """
    seen = live(versions).groupBy(key).agg(F.count("*").alias("_n"), F.sum("confidence").alias("_sum"), F.count("confidence").alias("_known"))
    joined = live(docs).join(seen, key, "left").groupBy("project_id")
    counts = joined.agg(
        F.count("*").alias("documents"), *[F.count_if(F.col("status") == s).alias(f"status_{s.lower()}") for s in statuses], F.coalesce(F.sum("_n"), F.lit(0)).alias("versions"),
        (F.sum("_sum") / F.nullif(F.sum("_known"), F.lit(0))).alias("mean_confidence"),
    )
    return projects.join(counts, "project_id", "left").fillna(0, ["documents", "versions", *[f"status_{s.lower()}" for s in statuses]])
