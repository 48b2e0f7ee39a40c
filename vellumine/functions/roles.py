"""The role and the primary fields of a profile: ranked evidence, of which the best that passes its tests decides.

Every source gives candidates as structs of level, place and value; those that fail a test are left out, and the first of the
least level is the answer. So a rejected candidate makes room for the next one of its level, then for the next level, in one expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.functions import lines as L
from vellumine.functions import text as T
from vellumine.functions.insights import role_from_file
from vellumine.functions.skills import Words, stripped

#: What makes a line a role, headers that are none, titles in tables, what cells around them must not hold.
ROLE_TERMS = (
    "engineer", "developer", "designer", "architect", "analyst", "consultant", "manager", "specialist", "lead", "scientist", "draftsman", "technician", "programmer", "administrator", "officer",
    "executive", "full stack", "fullstack", "intern", "trainee", "associate",
)
ROLE_WORDS = ("engineer", "developer", "designer", "architect", "analyst", "consultant", "manager", "specialist", "lead", "scientist", "draftsman")
HEADER_PARTS = ("summary", "skills", "experience", "education", "curriculum", "resume", "biodata")
TITLES = "Engineer|Developer|Designer|Architect|Analyst|Consultant|Manager|Specialist|Scientist|Lead"
FULL_TITLES = f"{TITLES}|Administrator|Executive"
CELL_LABELS = ("designation", "role", "position", "job title")
CELL_TITLES = ("manager", "engineer", "developer", "analyst", "architect", "specialist", "consultant")
NO_CELL = ("what", "how", "year", "cgpa", "percentage", "experience", "notice")
NO_NAME = ("github", "linkedin", "http", ".com", "www.")

#: The role that a domain's terms suggest, the first domain that occurs counts.
DOMAIN_ROLES = {
    "Mechanical Design Engineer": ("actcad", "autocad", "solidworks", "catia", "creo", "ansys", "sheet metal"),
    "Software Engineer": ("python", "fastapi", "react", "django", "java", "full stack", "fullstack", "node.js", "backend"),
    "Civil Engineer": ("staad", "revit", "civil 3d", "etabs", "bim", "structural"),
    "Electrical Engineer": ("plc", "scada", "substation", "switchgear", "power systems"),
    "Data Scientist": ("machine learning", "deep learning", "data science", "tensorflow", "pytorch"),
}

PHONE_IN_TEXT = r"(?:\+?[0-9]{1,3}[\s-]?)?(?:[6-9][0-9]{9}|\b[0-9]{5}[\s-]?[0-9]{5}\b)"

_CANDIDATES = "array<struct<level:int,place:int,value:string>>"


def titled(value: Column) -> Column:
    """A cleaned field in title case."""
    return T.let(T.clean_field(value), T.title_case)


def without_notes(role: Column) -> Column:
    """Without brackets that hold a year, `present` or a company."""
    return L.edged(F.regexp_replace(role, r"(?i)\([^)]*(?:[0-9]{4}|present|current|ltd|pvt|inc)[^)]*\)", ""), r"\s,\-–—")


def _ranked(level: int, values: Column, test) -> Column:
    """The values of an array that pass, as candidates of the level in their order."""
    made = F.transform(values, lambda v, i: F.struct(F.lit(level).alias("level"), i.alias("place"), v.alias("value")))
    return F.coalesce(F.filter(made, lambda c: F.coalesce(c["value"].isNotNull() & test(c["value"]), F.lit(False))), F.array().cast(_CANDIDATES)).cast(_CANDIDATES)


def best(*levels: Column) -> Column:
    """The value of the least candidate: the first of the first level that has any. Later levels are not computed then."""
    return F.coalesce(*[F.get(level, F.lit(0))["value"] for level in levels])


def header_lines(text: Column, name: Column | None, words: Words) -> Column:
    """The first eight lines without those that are a name, a contact, a header, a place or a degree."""
    lines = F.transform(F.slice(L.text_lines(text), 1, 8), lambda x: L.edged(x, r"•*\s|:\-"))
    n = F.lower(F.coalesce(name, F.lit(""))) if name is not None else F.lit("")
    low = F.lower
    own = lambda x: (n != "") & (F.contains(low(x), n) | F.contains(n, low(x)))
    other = lambda x: (F.contains(x, F.lit("@")) & x.rlike(T.EMAIL)) | (x.rlike("[0-9]") & x.rlike(T.PHONE)) | L.holds(x, HEADER_PARTS) | L.holds(x, words.stop) | L.is_place(x, words) | x.rlike(L.DEGREE)
    return F.filter(lines, lambda x: (F.length(x) >= 3) & ~own(x) & ~other(x))


def _looks_like_title(x: Column) -> Column:
    return L.holds(x, ROLE_TERMS) & F.length(x).between(3, 60) & ~x.rlike("[.?!]$")


def _of_summary(summary: Column, name: Column | None, at_start: bool) -> Column:
    """The title that a summary begins with, or the first one that goes on with what the person has."""
    pattern = rf"(?i)^(?:an?\s+)?([A-Z][A-Za-z0-9\s/&-]+?(?:{FULL_TITLES}))\b" if at_start else rf"(?i)(?:an?\s+)?([A-Za-z\s/&-]+?(?:{TITLES}))\s+(?:with|having|over|[0-9]+|who|specializing)"
    found = stripped(F.regexp_replace(F.regexp_extract(stripped(summary), pattern, 1), r"(?i)^.*?\b(?:is|as|working\s+as)\s+(?:an?\s+)?", ""))
    if name is None:
        return found
    rest = stripped(F.regexp_replace(F.substring(found, F.length(name) + 1, F.length(found)), r"(?i)^\s*(?:is|as|working\s+as)\s+(?:an?\s+)?", ""))
    return F.when((name != "") & F.startswith(F.lower(found), F.lower(name)), rest).otherwise(found)


def _cells(rows: Column) -> Column:
    """Of a table's rows, in order: the cell after a label, and cells that hold a title."""

    def of_row(r: Column) -> Column:
        after = lambda c, i: F.when(L.holds(c, CELL_LABELS) & F.length(stripped(F.get(r, i + 1))).between(3, 60), stripped(F.get(r, i + 1)))
        title = lambda c: F.when(L.holds(c, CELL_TITLES) & (F.length(c) < 50) & ~L.holds(c, NO_CELL), c)
        return F.flatten(F.transform(r, lambda c, i: F.array(after(c, i), title(stripped(c)))))

    return F.filter(F.flatten(F.transform(rows, of_row)), lambda c: c.isNotNull())


def domain_role(text: Column) -> Column:
    role = F.lit(None).cast("string")
    for name, terms in reversed(DOMAIN_ROLES.items()):
        role = F.when(L.holds(text, terms), F.lit(name)).otherwise(role)
    return role


def role(text: Column, words: Words, name: Column | None = None, roles: Column | None = None, summary: Column | None = None, rows: Column | None = None, file_name: Column | None = None) -> Column:
    """The role of a profile: of its header lines, its positions (most recent first), its summary, its tables (rows: an array
    of rows of cells), its file name, or the domain of its terms, in that order; null for none. Nulls give no candidate."""
    none = F.array().cast("array<string>")
    titles = F.transform(F.filter(header_lines(text, name, words), _looks_like_title), lambda x: titled(without_notes(x)))
    held = F.transform(F.filter(F.coalesce(roles, none) if roles is not None else none, lambda r: ~r.rlike(L.DEGREE)), lambda r: titled(without_notes(r)))
    said = F.array(*[titled(_of_summary(summary, name, s)) for s in (True, False)]) if summary is not None else none
    cells = F.transform(_cells(rows), titled) if rows is not None else none
    long_ = lambda v: F.length(v) >= 3
    return best(
        _ranked(1, titles, long_), _ranked(2, held, long_), _ranked(3, said, lambda v: F.length(v).between(3, 60)), _ranked(4, cells, lambda v: v != ""),
        _ranked(5, F.array(role_from_file(file_name)) if file_name is not None else none, long_), _ranked(6, F.array(domain_role(text)), long_),
    )


def primary_name(names: Column, file_name: Column) -> Column:
    """The first name that is neither a file's nor an address, else the one that the file name states."""
    good = lambda v: ~F.startswith(F.lower(v), F.lit("document")) & ~F.lower(v).isin("resume", "cv", "") & ~L.holds(v, NO_NAME)
    return best(_ranked(1, F.transform(names, lambda x: F.trim(x)), good), _ranked(2, F.array(T.name_from_file(file_name)), good))


def primary_email(emails: Column) -> Column:
    return best(_ranked(1, F.transform(emails, lambda x: F.trim(x)), lambda v: v != ""))


def primary_phone(phones: Column, text: Column) -> Column:
    """The first phone that is not blank, else the first number that the text shows."""
    shown = F.array(F.trim(F.regexp_extract(text, PHONE_IN_TEXT, 0)))
    return best(_ranked(1, F.transform(phones, lambda x: F.trim(x)), lambda v: v != ""), _ranked(2, shown, lambda v: v != ""))


def primary_role(stated: Column, roles: Column, text: Column, summary: Column, cells: Column, file_name: Column, skills: Column) -> Column:
    """The stated role, else the first of positions, header lines, summary, table cells, file name, or the domain of skills."""
    lines = F.filter(F.slice(L.text_lines(text), 1, 8), lambda x: ~L.holds(x, HEADER_PARTS) & L.names(x, ROLE_WORDS) & F.length(x).between(3, 60) & ~x.rlike("[.?!]$"))
    clean = lambda xs: F.transform(xs, lambda x: T.title_case(without_notes(x)))
    opening = F.element_at(F.split(F.trim(summary), "\n"), 1)
    first_line = F.when(L.holds(opening, ROLE_WORDS) & (F.length(opening) < 60) & ~opening.rlike("[.]$"), T.title_case(opening))
    said = F.array(*[T.title_case(_of_summary(summary, None, s)) for s in (True, False)], first_line)
    titles = F.filter(F.transform(cells, lambda x: F.trim(x)), lambda c: L.holds(c, CELL_TITLES) & (F.length(c) < 50) & ~L.holds(c, NO_CELL))
    long_ = lambda v: F.length(v) >= 3
    return best(
        _ranked(1, clean(F.array(stated)), long_), _ranked(2, clean(roles), long_), _ranked(3, clean(lines), long_), _ranked(4, said, lambda v: F.length(v).between(3, 59)),
        _ranked(5, F.transform(titles, T.title_case), long_), _ranked(6, F.array(role_from_file(file_name)), long_), _ranked(7, F.array(domain_role(F.array_join(skills, " "))), long_),
    )
