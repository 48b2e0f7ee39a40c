"""What page-parsing models write: texts between tags of corners and a class, read into aligned arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.functions.skills import stripped

#: The grammar of an element: corner, text, corner, class.
_NUMBER = r"([0-9]+(?:[.][0-9]+)?)"
ELEMENT = rf"(?s)<x_{_NUMBER}><y_{_NUMBER}>(.*?)<x_{_NUMBER}><y_{_NUMBER}><class_([^>]+)>"

#: Control tokens that models leave in texts.
TOKENS = ("<tbc>", "\\<|unk|\\>", "\\unknown")


def without_artifacts(text: Column) -> Column:
    """Without control tokens, three or more line breaks as two, trimmed; empty for null."""
    text = F.coalesce(text, F.lit(""))
    for token in TOKENS:
        text = F.replace(text, F.lit(token), F.lit(""))
    return stripped(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def elements(output: Column) -> Column:
    """Structs of class, box (four doubles) and text for each element, in order; those without text are left out."""
    found = F.regexp_extract_all(F.coalesce(output, F.lit("")), F.lit(ELEMENT), F.lit(0))
    part = lambda x, k: F.regexp_extract(x, ELEMENT, k)
    box = lambda x: F.array(*[part(x, k).cast("double") for k in (1, 2, 4, 5)])
    made = F.transform(found, lambda x: F.struct(part(x, 6).alias("class"), box(x).alias("box"), without_artifacts(part(x, 3)).alias("text")))
    return F.filter(made, lambda e: e["text"] != "")


def faults(output: Column) -> Column:
    """What stands between and around the elements: pieces that no element explains, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(output, F.lit("")), ELEMENT), stripped), lambda x: x != "")


def aligned(output: Column) -> dict[str, Column]:
    """classes, boxes and texts as arrays of one length, and the faults."""
    e = elements(output)
    return {"classes": e["class"], "boxes": e["box"], "texts": e["text"], "faults": faults(output)}


def clean_extracted(text: Column) -> Column:
    """Extracted text without control characters, with plain line ends, single blanks, trimmed lines and no two blank lines in
    a row; empty for null."""
    steps = (
        (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""),
        (r"\r\n|\r", "\n"),
        (r"[ \t]+", " "),
        (r"(?m)^[\s&&[^\n]]+|[\s&&[^\n]]+$", ""),
        (r"\n{3,}", "\n\n"),
    )
    text = F.coalesce(text, F.lit(""))
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return stripped(text)
