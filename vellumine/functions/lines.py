"""What single lines of a profile are: bullets, date ranges, places, names of roles, companies, degrees and schools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.functions import text as T
from vellumine.functions.skills import Words, lines_of, stripped, whole_word

#: Marks that open a bullet.
BULLETS = "-•*"

_POINT = rf"(?:\b[0-9]{{1,2}}[/-][0-9]{{2,4}}\b|(?:{'|'.join(T.MONTHS)})[a-z]*[.]?,?\s*[0-9]{{4}}|\b(?:19|20)[0-9]{{2}}\b)"

#: A written range of dates; a line that ends in the middle of one; a line that goes on with it.
RANGE = rf"(?i)(?:from\s+)?{_POINT}\s*(?:[-–—~]|to|till|until)\s*(?:{_POINT}|current|present|ongoing|till date)"
_MONTH = rf"(?:{'|'.join(T.MONTHS)})[a-z]*[.]?"
RANGE_CUT, RANGE_GOES_ON = rf"(?i)(?:{_MONTH}\s*|[-–—~]\s*|\bto\s*)$", rf"(?i)^(?:(?:{_MONTH}\s*)?(?:19|20)[0-9]{{2}}\b|present|current)"

#: A length of time alone, as in `3 years`.
DURATION = r"(?i)^[0-9]+\s*(?:years?|yrs?|months?|m)$"


def text_lines(text: Column) -> Column:
    """The lines of a text without white space around them and without empty ones; none for null."""
    return F.filter(F.transform(lines_of(F.coalesce(text, F.lit(""))), stripped), lambda x: x != "")


def edged(value: Column, marks: str = r"\s,|\-–—") -> Column:
    """Without these marks around it."""
    return F.btrim(value, F.lit(marks.replace(r"\s", T.WHITE).replace("\\", "")))


def unbulleted(line: Column) -> Column:
    """Without bullets and white space in front."""
    return F.ltrim(line, F.lit(BULLETS + T.WHITE))


def is_bullet(line: Column) -> Column:
    return F.substring(line, 1, 1).isin(*BULLETS)


def n_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"\S+"))


def dated(line: Column) -> Column:
    """Whether a line holds a written range of dates; every one has a digit, which is looked for first."""
    return line.rlike("[0-9]") & line.rlike(RANGE)


def any_of(parts: tuple[str, ...]) -> str:
    """A pattern for any of the literal parts that tries each common beginning once; it tells whether there is one, not which."""
    heads: dict[str, list[str]] = {}
    for p in parts:
        heads.setdefault(p[:1], []).append(p[1:])
    if "" in heads:
        return ""
    quoted = lambda c: c if c.isalnum() or c == " " else f"[{c}]"
    branches = [quoted(c) + any_of(tuple(rest)) for c, rest in heads.items()]
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def is_sentence(line: Column) -> Column:
    """Six words or more that end in a full stop."""
    return F.endswith(line, F.lit(".")) & (n_words(line) >= 6)


def holds(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether any of the parts occurs anywhere, in any case; false for null."""
    return F.coalesce(F.lower(text).rlike(any_of(parts)), F.lit(False)) if parts else F.lit(False)


def names(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words occurs as a word of its own, in any case; false for null."""
    return holds(text, words) & F.lower(text).rlike(whole_word(words)) if words else F.lit(False)


def is_place(text: Column, words: Words) -> Column:
    """Whether all words of a text, or the text as a whole, are known places."""
    if not words.places:
        return F.lit(False)
    bare = stripped(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))
    known = T.let(bare, lambda b: F.coalesce((b != "") & (b.isin(*words.places) | F.forall(F.split(b, " "), lambda w: w.isin(*words.places))), F.lit(False)))
    return holds(text, tuple(p.split(" ")[0] for p in words.places)) & known


#: What marks a degree, a school, and what cannot be a degree though it looks like one.
DEGREE = (
    r"(?i)\b(?:b\.?tech|b\.?e\.?|b\.?sc\.?|bca|bba|b\.?com\.?|b\.?a\.?|bachelors?|m\.?tech|m\.?e\.?|m\.?sc\.?|mca|mba|m\.?com\.?|m\.?a\.?|masters?|m\.?s\.?|ph\.?d|doctorate"
    r"|diploma|polytechnic|pgpm|pgdm|pgdbm|pgd|class\s+(?:xii|xi|x|12th|10th)|standard\s+(?:xii|xi|x|12th|10th)|10th|12th|hsc|ssc|intermediate|matriculation"
    r"|senior\s+secondary|higher\s+secondary|high\s+school|secondary\s+school|cbse|icse|associate\s+degree|post\s*graduate|undergraduate)\b"
)
SCHOOL = (
    r"(?i)\b(?:university|college|institut(?:e|ion)|school|academy|campus|vidyalaya|vidyapeeth|mahavidyalaya|faculty\s+of|board\s+of|department\s+of"
    r"|kendriya\s+vidyalaya|jnv|dps|dav|iit|nit|bits|iiit|mit|stanford|harvard|oxford|cambridge|state\s+board|central\s+board)\b"
)
NO_SCHOOL = ("name of institute", "target institute", "whether from", "name of school", "name of college", "type of institute", "iso exams in school")
NO_DEGREE = (
    "ms office", "ms project", "autocad", "catia", "solidworks", "python", "java ", "experienced in", "proficient in", "msc-adams", "adams", "hypermesh", "ls-dyna", "ls dyna", "ansa",
    "ansys", "matlab", "simulink", "meshworks", "primer", "animator", "creo", "nx", "unigraphics", "name of institute", "target institute", "whether from", "full time /part time",
    "capture other", "gap after", "preparation", "revenue accountability", "reporting to", "current organization", "recruiter comments", "reasons for change", "location applied", "native location",
)

#: A grade, in any of its spellings, and the words that make a line a score.
GRADE = (
    r"(?i)\b[0-9.]+\s*(?:CGPA|GPA|Grade|%)|(?:CGPA|GPA|Grade|Percentage|Marks)[\s:=–—\-]*[0-9.]+(?:\s*/\s*[0-9.]+)?%?|\b[0-9]{1,2}(?:[.][0-9]{1,2})?\s*%|\b[0-9][.][0-9]{1,2}\s*/\s*10(?:[.]0)?"
)
SCORE = r"(?i)\b(?:score|grade|marks|cgpa|gpa|percentage|percentile|air|rank)\b"
YEAR_SPAN = r"(?i)\b(?:19|20)[0-9]{2}\b(?:\s*(?:[-–—~]|to)\s*(?:(?:19|20)[0-9]{2}\b|[0-9]{2}\b|present|current))?"


def no_degree(text: Column) -> Column:
    """Whether a text is a range of dates, a score, a tool, a form's label or a number rather than a degree; true for null."""
    counted = text.rlike("[0-9]") & (text.rlike(SCORE) | text.rlike(r"\b[0-9]+(?:[.][0-9]+)?\s*%") | text.rlike(RANGE))
    bad = counted | holds(text, NO_DEGREE) | text.rlike(r"(?i)^(?:[0-9\s\-/.,–—~()]|to)+$")
    return F.coalesce((F.length(stripped(text)) < 2) | bad, F.lit(True))


def is_degree(text: Column) -> Column:
    return F.coalesce(text.rlike(DEGREE), F.lit(False)) & ~no_degree(text)


def is_school(text: Column) -> Column:
    return F.coalesce(text.rlike(SCHOOL), F.lit(False)) & ~holds(text, NO_SCHOOL)
