"""Notes of a record: a JSON list, or plain text, as structs, newest first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTE = "struct<id:string,author:string,text:string,date:string>"


def parse_notes(raw: Column, as_of: Column, author: str = "system") -> Column:
    """The notes of a JSON list; plain text is one note of the given day; nothing gives no note."""
    listed = F.from_json(raw, f"array<{NOTE}>")
    plain = F.array(F.struct(F.md5(raw).alias("id"), F.lit(author).alias("author"), F.trim(raw).alias("text"), as_of.cast("string").alias("date")))
    is_list = F.ltrim(raw).startswith("[") & listed.isNotNull()
    nothing = raw.isNull() | (F.trim(raw) == "")
    return F.when(nothing, F.array().cast(f"array<{NOTE}>")).when(is_list, listed).otherwise(plain)


def prepend_note(notes: Column, note: Column) -> Column:
    """The note in front of the notes, without an older one of the same text."""
    return F.concat(F.array(note), F.filter(notes, lambda n: n["text"] != note["text"]))


def decoded(value: Column) -> Column:
    """A JSON-encoded value as its text: a string without its quotes, anything else as it stands."""
    return F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"), value)
