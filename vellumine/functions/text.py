"""Text cleaning and extraction as column expressions; patterns are the same in Java's and RE2's dialect where they can be."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: letters, digits and underscores of any script (spelt out, as \w differs between engines).
WORD = r"[\p{L}\p{N}_]+"

#: White space, as \s has it.
WHITE = " \t\n\x0b\f\r"

#: What counts as an e-mail address, a phone number, a link, and a profile on either site.
EMAIL = r"(?i)[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE = r"(?:\+?91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}|(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}|0?[6-9]\d{9}"
LINK = r"(?i)https?://(?:www\.)?[-a-zA-Z0-9@:%._+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b(?:[-a-zA-Z0-9()@:%_+.~#?&/=]*)"
LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?(?:linkiedin|linkedin)\.com/in/([a-zA-Z0-9_-]+)"
GITHUB = r"(?i)(?:https?://)?(?:www\.)?github\.com/([a-zA-Z0-9_-]+)"

#: Endings that make an address a file name, the site's own pages, years that make ten digits two years.
FILE_ENDINGS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".pdf", ".docx", ".doc")
RESERVED = ("topics", "features", "pricing", "explore")
YEARS = ("2018", "2019", "2020", "2021", "2022", "2023", "2024", "2025", "2026")


def blank_to_null(value: Column) -> Column:
    """Without blanks around it; null if nothing is left."""
    return let(F.trim(value), lambda v: F.when(v != "", v))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def paragraphs(text: Column, separator: str = r"\n\s*\n+") -> Column:
    """Trimmed parts between blank lines (or another separator), without empty ones."""
    return F.filter(F.transform(F.split(text, separator), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def ordered_distinct(values: Column) -> Column:
    """Distinct elements in the order of their first occurrence."""
    return F.array_distinct(values)


def emails(text: Column) -> Column:
    """Addresses in lower case, in order, once each, without trailing punctuation and without file names."""
    found = F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda x: F.regexp_replace(F.lower(x), r"[.,;)]+$", ""))
    return F.array_distinct(F.filter(found, lambda x: ~x.rlike("(?:" + "|".join(FILE_ENDINGS).replace(".", "[.]") + ")$")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def each(df: DataFrame, items: str, *keep: str) -> DataFrame:
    """keep, number (from 1) and item for each element of the array column `items`.

    An outer explosion with a filter behind it: for a plain one the optimizer puts a test of the array below it, and so
    computes what makes the array once more.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias("number", "item")).filter("number is not null")
    return rows.withColumn("number", F.col("number") + 1)


def kept_rows(df: DataFrame, test: Callable[[Column], Column]) -> DataFrame:
    """The rows of df that pass the test of their struct; unlike a filter's, its condition is not pushed below what makes the columns."""
    row = F.filter(F.array(F.struct(*df.columns)), lambda r: F.coalesce(test(r), F.lit(False)))
    return df.select(F.explode_outer(row).alias("r")).filter("r is not null").select("r.*")


def first_of_each(pairs: Column) -> Column:
    """Of structs of a key and an item: the items whose key stands nowhere earlier, in order; by two sorts, not pairwise."""
    keyed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("place"), p["item"].alias("item"))))
    first = let(keyed, lambda a: F.filter(a, lambda x, i: (i == 0) | (x["key"] != F.get(a, i - 1)["key"])))
    return F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["place"].alias("place"), x["item"].alias("item")))), lambda x: x["item"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def phones(text: Column, most: int = 4) -> Column:
    """Numbers of 10 to 15 digits, more than two of them different and not two years, once for each sequence of digits in its
    first spelling."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), lambda x: F.struct(digits(x).alias("key"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("item")))
    years = lambda k: (F.length(k) == 10) & F.substring(k, F.lit(1), F.lit(2)).isin("19", "20") & F.substring(k, F.lit(5), F.lit(4)).isin(*YEARS)
    good = F.filter(found, lambda p: F.length(p["key"]).between(10, 15) & (F.size(F.array_distinct(F.split(p["key"], ""))) > 2) & ~years(p["key"]))
    return F.slice(first_of_each(good), 1, most)


def links(text: Column) -> Column:
    """Addresses of pages in order, once each, without trailing punctuation."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(0)), lambda x: F.regexp_replace(x, r"[.,;)]+$", "")))


def profile_links(text: Column) -> dict[str, Column]:
    """linkedin and github: the canonical address of the first profile on either site; null for none or a page of the site's."""
    person, user = F.regexp_extract(text, LINKEDIN, 1), F.regexp_extract(text, GITHUB, 1)
    return {
        "linkedin": F.when(person != "", F.concat(F.lit("https://www.linkedin.com/in/"), person)),
        "github": F.when((user != "") & ~F.lower(user).isin(*RESERVED), F.concat(F.lit("https://github.com/"), user)),
    }


def title_case(text: Column) -> Column:
    """Every run of letters with its first one in upper case and the others in lower case, whatever parts the runs."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), F.initcap), "")


def clean_field(text: Column) -> Column:
    """Without delimiters and marks around it, blanks collapsed; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(text, r"[*_`#]+", ""), r"\s{2,}|[\t\n\x0B\f\r]", " ")
    return let(F.btrim(bare, F.lit(f"{WHITE},;:|-")), lambda v: F.when(v != "", v))


def found(text: Column, pattern: str) -> Column:
    """What the pattern finds first; null for nothing, and for a match of no characters."""
    return let(F.regexp_extract(text, pattern, 0), lambda v: F.when(v != "", v))


def clean_text(text: Column) -> Column:
    """The steps of text cleaning that patterns can express, in order: invisible characters, quotes, dashes, hyphenation,
    bullets, page markers, blanks, blank lines."""
    steps = (
        (r"[\x{200B}\x{200C}\x{200D}\x{FEFF}\x{AD}]", ""),
        (r"[\x{2018}\x{2019}]", "'"),
        (r"[\x{201C}\x{201D}]", '"'),
        (r" *[\x{2013}\x{2014}] *", " - "),
        (r"([a-z])-\n([a-z])", "$1$2"),
        (r"(?m)^[ \t]*[\x{2022}\x{25CF}\x{27A2}\x{25AA}*][ \t]*", "- "),
        (r"(?mi)^[ \t]*(?:page[ \t]+[0-9]+(?:[ \t]+of[ \t]+[0-9]+)?|-[ \t]*[0-9]+[ \t]*-)[ \t]*$", ""),
        (r"[ \t]+", " "),
        (r"\n{3,}", "\n\n"),
    )
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")


def safe_file_name(name: Column) -> Column:
    """Characters that file systems forbid become underscores; `document` if nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, r'[<>:"/\\|?*]', "_")), F.lit("")), F.lit("document"))


def name_from_file(name: Column) -> Column:
    """A person's name from a file name: without annotations, years and marks; camel case split; five words at most."""
    bare = F.regexp_replace(file_stem(name), r"\[.*$", "")
    bare = F.regexp_replace(bare, r"--.*$", "")
    bare = F.regexp_replace(bare, r"(?i)[_ \-]+(?:resume|cv|ask|updated|final|fwd|profile)\b.*$|(?i)_(?:resume|cv|ask|updated|final)(?:_.*|$)", "")
    bare = F.regexp_replace(bare, "([a-z])([A-Z])", "$1 $2")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[_\-0-9.]+", " "), r"\s+", " ")
    words = F.slice(F.filter(F.split(F.trim(bare), " "), lambda w: w != ""), 1, 5)
    return F.nullif(F.initcap(F.array_join(words, " ")), F.lit(""))


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_MONTH_NAME, _NOW = "(?:" + "|".join(MONTHS) + ")[a-z]*", "present|current|now|till date|today|ongoing"


def partial_date(text: Column) -> Column:
    """`YYYY` or `YYYY-MM` of a written date (`Jan 2021`, `06/2018`, `2018-06`, `2021`, `'19`); null if it is none."""
    number = lambda m: F.lpad(m, 2, "0")
    named, slashed, dashed = rf"^({_MONTH_NAME})[ ,.']*([0-9]{{4}})$", r"^([0-9]{1,2})[/.]([0-9]{4})$", r"^([0-9]{4})[-/.]([0-9]{1,2})$"

    def read(t: Column) -> Column:
        month = F.floor((F.instr(F.lit(" ".join(MONTHS)), F.substring(t, 1, 3)) + 3) / 4).cast("string")
        return (
            F.when(t.rlike("^[0-9]{4}$"), t)
            .when(t.rlike(named), F.concat(F.regexp_extract(t, named, 2), F.lit("-"), number(month)))
            .when(t.rlike(slashed), F.concat(F.regexp_extract(t, slashed, 2), F.lit("-"), number(F.regexp_extract(t, slashed, 1))))
            .when(t.rlike(dashed), F.concat(F.regexp_extract(t, dashed, 1), F.lit("-"), number(F.regexp_extract(t, dashed, 2))))
            .when(t.rlike("^'[0-9]{2}$"), F.concat(F.lit("20"), F.substring(t, 2, 2)))
        )

    return let(F.lower(F.trim(text)), read)


def date_range(text: Column, single_as: str = "end") -> dict[str, Column]:
    """start, end, is_current of a written duration; a single date is the end, the start or both, as single_as says."""
    dates = _dates(text, single_as)
    return {k: dates[k] for k in ("start", "end", "is_current")}


def _dates(text: Column, single_as: str) -> Column:
    """Struct of start, end and is_current of a written duration, which is matched once."""
    one = rf"(?:{_MONTH_NAME}[ ,.']*[0-9]{{4}}|[0-9]{{1,2}}[/.][0-9]{{4}}|[0-9]{{4}}[/.][0-9]{{1,2}}|[0-9]{{4}}|'[0-9]{{2}})"
    both = rf"^({one}) *(?:-|~|to|till|until) *({one}|{_NOW})$"
    since, until = rf"^(?:since|from) +({one})$", rf"^(?:until|till) +({one})$"

    def read(t: Column, first: Column, last: Column) -> Column:
        ranged = first != ""
        now = F.coalesce(last.rlike(f"^(?:{_NOW})$") | t.rlike(since), F.lit(False))
        start = F.when(ranged, partial_date(first)).when(t.rlike(since), partial_date(F.regexp_extract(t, since, 1)))
        end = F.when(ranged, partial_date(last)).when(t.rlike(until), partial_date(F.regexp_extract(t, until, 1)))
        if single_as in ("start", "both"):
            start = F.coalesce(start, F.when(~ranged, partial_date(t)))
        if single_as in ("end", "both"):
            end = F.coalesce(end, F.when(~ranged, partial_date(t)))
        return F.struct(start.alias("start"), end.alias("end"), now.alias("is_current"))

    ends = lambda t: F.struct(t.alias("t"), *[F.regexp_extract(t, both, k).alias(c) for k, c in ((1, "a"), (2, "b"))])
    return let(let(F.trim(F.lower(text)), ends), lambda p: read(p["t"], p["a"], p["b"]))


def shown_range(text: Column, start: Column, end: Column, is_current: Column) -> Column:
    """How a parsed duration is written: `start - Present`, `start - end`, the one date there is, else the text itself."""
    return F.coalesce(F.when(is_current, F.concat(start, F.lit(" - Present"))), F.concat(start, F.lit(" - "), end), end, start, F.trim(text))


def parsed_range(text: Column, single_as: str = "end") -> Column:
    """Struct of start, end, is_current and shown of a written duration, with dashes of any length and a leading `from`; the
    second of two years may lack its century (`2010-12`)."""

    def parsed(t: Column) -> Column:
        return let(_dates(F.regexp_replace(F.regexp_replace(t, "[–—]", "-"), r"(?i)^from\s+", ""), single_as), lambda d: shown(t, d))

    def shown(t: Column, d: Column) -> Column:
        parts = [d[k].alias(k) for k in ("start", "end", "is_current")]
        return F.struct(*parts, shown_range(t, d["start"], d["end"], d["is_current"]).alias("shown"))

    return let(F.regexp_replace(text, r"\b(19|20)([0-9]{2})\s*[-–—]\s*([0-9]{2})$", "$1$2 - $1$3"), parsed)


def normal_skill(skill: Column, aliases: dict[str, str]) -> Column:
    """The canonical spelling of a skill: by alias, else short capitals and inner capitals as they are, else title case."""
    bare = F.regexp_replace(F.trim(skill), r"\s+", " ")
    known = F.element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), F.regexp_replace(F.lower(bare), r"[\s._\-]+", ""))
    as_is = ((F.length(bare) <= 5) & (bare == F.upper(bare))) | bare.rlike("[a-z][A-Z]")
    return F.coalesce(known, F.when(as_is, bare).otherwise(F.initcap(bare)))


def dictionary_hits(text: Column, terms: tuple[str, ...]) -> Column:
    """The terms of a dictionary that occur as whole words, in order."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}+#]+", " "), F.lit(" "))
    return F.filter(F.array(*[F.lit(t) for t in sorted(terms)]), lambda t: F.contains(padded, F.concat(F.lit(" "), t, F.lit(" "))))
