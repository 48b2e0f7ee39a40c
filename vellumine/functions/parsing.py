"""Similarity of names and paragraphs as projects: small pure functions, and Arrow functions over them."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def indel_ratio(a: str, b: str) -> float:
    """Similarity from 0 to 100: twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.lower().split())), " ".join(sorted(b.lower().split())))


#: Names that are alike but never the same.
NEVER_SAME_PAIRS = (
    ("java", "javascript"), ("c", "c++"), ("c", "c#"), ("c++", "c#"), ("javascript", "typescript"), ("sql", "nosql"), ("react", "react native"),
    ("angular", "angularjs"), ("html", "html5"), ("css", "css3"), ("python", "cython"), ("r", "rust"), ("ruby", "rust"),
)
NEVER_SAME = {frozenset(p) for p in NEVER_SAME_PAIRS}


def _letters(text: str) -> int:
    """A bit for each letter that occurs."""
    bits = 0
    for c in text:
        bits |= 1 << (ord(c) & 63)
    return bits


def fuzzy_distinct(values: Sequence[str], least: float = 88.0) -> list[str]:
    """values without those alike to an earlier one that stays; names of three characters or fewer must be equal.

    Lengths and letters that the other lacks bound the ratio; only pairs that may reach it are compared.
    """
    out: list[str] = []
    kept: list[tuple[str, str, int]] = []
    for v in values:
        low = v.lower()
        text = " ".join(sorted(low.split()))
        bits, n = _letters(text), len(text)
        for w, other, letters in kept:
            if low == w:
                break
            if min(len(v), len(w)) <= 3 or frozenset((low, w)) in NEVER_SAME:
                continue
            shared = min(n - (bits & ~letters).bit_count(), len(other) - (letters & ~bits).bit_count())
            if 200.0 * shared >= least * (n + len(other)) and indel_ratio(text, other) >= least:
                break
        else:
            if v:
                out.append(v)
                kept.append((low, text, bits))
    return out


def projects(text: str | None) -> list[dict]:
    """Paragraphs as projects: name, description, and at most eight technologies named after `Technologies:`."""
    out = []
    for block in re.split(r"\n\s*\n+", text or ""):
        lines = [x.strip() for x in block.split("\n") if x.strip()]
        if not lines:
            continue
        used = next((m[1] for x in lines if (m := re.match(r"(?i)(?:technologies|tech stack|tools)\s*:\s*(.+)", x))), "")
        body = [x for x in lines[1:] if not re.match(r"(?i)(?:technologies|tech stack|tools)\s*:", x)]
        out.append({"name": lines[0].lstrip("-*• "), "description": " ".join(body) or None, "technologies": [t.strip() for t in re.split("[,;|]", used) if t.strip()][:8]})
    return out


def arrow(function: Callable, kind: str) -> Callable[[Column], Column]:
    """The function, value by value over Arrow batches, as a column function of the given type."""
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([function(v if v is None or isinstance(v, str) else list(v)) for v in values], dtype=object)

    return lambda column: F.pandas_udf(run, kind)(column)


fuzzy_distinct_of = arrow(lambda v: fuzzy_distinct(v or []), "array<string>")
projects_of = arrow(projects, "array<struct<name:string,description:string,technologies:array<string>>>")
