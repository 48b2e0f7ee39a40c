"""Degrees, read from the lines of a text: a line that names one opens a block, blocks become records, and records that
name the same degree are merged.

Like positions, blocks are cut from the array of a document's lines and read where they lie, and a document's records stay in
one array until they are merged, in their order. So a text is read once, and neither lines nor records are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions import lines as L
from vellumine.functions import text as T
from vellumine.functions.skills import Words, stripped

#: Streams of schools, what a broken degree goes on with, names that stand for a missing degree.
STREAM = r"(?i)\b(science\s+stream|commerce\s+stream|arts\s+stream|science|commerce|arts|hsc|ssc|12th|10th|intermediate|matriculation|higher\s+secondary|senior\s+secondary)\b"
GOES_ON = ("engineering", "technology", "sciences", "science", "studies")
SCHOOL_PARTS, SCHOOL_DEGREE, ANY_DEGREE = ("college", "junior", "school", "vidyalaya", "jnv"), "Higher Secondary / Intermediate", "Degree"
NO_RECORD = (
    "gap after", "preparation", "capture other", "recruiter comments", "reasons for change", "msc-adams", "name of institute", "target institute", "current location", "software/language",
    "proficiency", "summary sheet", "recruitment questionnaire",
)
NO_INSTITUTION = ("name of institute", "target institute (y/n)", "target institute", "whether from target institute", "iso exams in school", "none")

#: A line of an institution, a dash, a degree, its field, and what follows a comma.
MISPLACED = (
    r"(?im)^([^\n\r]+?(?:Institute(?:\s+of\s+Technology)?|University|College|NIT|IIT|BITS|Polytechnic)[^\n\r]*?)\s*[-–—]\s*"
    r"(B\.?\s*Tech|B\.?\s*E|M\.?\s*Tech|M\.?\s*S|M\.?\s*B\.?\s*A|Bachelor|Master|Diploma|B\.?\s*Sc|M\.?\s*Sc)\b([^\n\r,]*)(?:,\s*([^\n\r]+))?"
)

_TAIL = r"(?i)(?:CGPA|GPA|Grade|Graduated|Marks|Percentage)[\s:]*.*"
_SPLIT = r"(?i)[,|–—]|\s+(?:from|at)\s+"
_YEARS = r"(?i)(?:from\s+)?\b(?:19|20)[0-9]{2}\b(?:\s*(?:[-–—]|to)\s*(?:\b(?:19|20)[0-9]{2}\b|Present|Current))?"

RECORD = "array<struct<degree:string,institution:string,duration:string,start_date:string,end_date:string,details:string>>"


def _first(values: Column, test=None) -> Column:
    return F.get(values if test is None else F.filter(values, test), F.lit(0))


def degree_blocks(lines: Column) -> Column:
    """The lines parted before each one that names a degree; what stands before the first one is a block too."""
    opens = F.filter(F.transform(lines, lambda x, i: F.when((i == 0) | x.rlike(L.DEGREE), i)), lambda i: i.isNotNull())
    return T.let(opens, lambda o: F.transform(o, lambda i, k: F.slice(lines, i + 1, F.coalesce(F.get(o, k + 1), F.size(lines)) - i)))


def _span(line: Column) -> Column:
    """The first range of dates or years in a line; every one has a digit, which is looked for first."""
    return F.when(line.rlike("[0-9]"), F.coalesce(T.found(line, L.RANGE), T.found(line, L.YEAR_SPAN)))


def _record(b: Column, words: Words) -> Column:
    """The record (as an element of RECORD) of a block of lines, null where it tells nothing."""
    degree_only = lambda x: L.is_degree(x) & ~L.is_school(x)
    school_only = lambda x: L.is_school(x) & ~L.is_degree(x)
    long_ = lambda parts: F.filter(parts, lambda x: F.length(x) >= 3)
    bare = lambda x: L.edged(F.regexp_replace(x, _TAIL, ""))
    yearless = lambda x: L.edged(F.regexp_replace(F.regexp_replace(x, _TAIL, ""), _YEARS, ""))
    split = lambda x: F.split(x, _SPLIT)
    many = F.size(b) >= 2
    score = lambda d: d.rlike(L.SCORE) | d.rlike(r"\b[0-9]+(?:[.][0-9]+)?%")

    def parts() -> Column:
        """What the lines hold: parts of lines by whether they are degrees or schools alone, the first span, and grades."""
        by_kind = lambda x: F.struct(x.alias("x"), degree_only(x).alias("degree"), school_only(x).alias("school"))
        pieces = lambda: F.flatten(F.transform(long_(F.transform(b, yearless)), lambda x: F.concat(F.transform(split(x), stripped), F.array(x))))
        named = lambda: stripped(F.element_at(F.split(_first(b, lambda x: x.rlike(L.DEGREE)), "[|]"), 1))
        first = lambda xs, kind: _first(xs, lambda p: p[kind])["x"]

        def held(xs: Column) -> Column:
            own = F.struct(first(xs, "degree").alias("d"), first(xs, "school").alias("s"))
            # pieces without years only where the parts of lines leave something open
            more = lambda o: T.let(F.transform(pieces(), by_kind), lambda ys: F.struct(F.coalesce(o["d"], first(ys, "degree"), named()).alias("d"), F.coalesce(o["s"], first(ys, "school")).alias("s")))
            return T.let(own, lambda o: F.when(o["d"].isNotNull() & o["s"].isNotNull(), o).otherwise(more(o)))

        grades = F.filter(F.transform(b, lambda x: F.when(x.rlike("[0-9.]"), T.found(x, L.GRADE))), lambda x: x.isNotNull())
        found = T.let(F.transform(long_(F.transform(F.flatten(F.transform(b, split)), bare)), by_kind), held)
        return F.struct(found.alias("o"), _first(F.transform(b, _span), lambda x: x.isNotNull()).alias("duration"), F.array_distinct(grades).alias("grades"))

    def filled(x: Column) -> Column:
        """A degree or school that is missing, from lines that may be one."""
        d, s = x["o"]["d"], x["o"]["s"]
        lone = lambda y: (y != s) & (L.n_words(y) <= 8) & ~L.is_school(y) & ~L.no_degree(y) & ~L.is_place(y, words)
        place = lambda y: (y != d) & (L.n_words(y) <= 8) & ~L.is_degree(y)
        degree, school = F.coalesce(d, F.when(s.isNotNull() & many, _first(b, lone))), F.coalesce(s, F.when(d.isNotNull() & many, _first(b, place)))
        return F.struct(degree.alias("d"), school.alias("s"), x["duration"].alias("duration"), x["grades"].alias("grades"))

    def judged(x: Column) -> Column:
        """Without a degree that is none: a score counts as a grade, a range of dates as the duration."""
        d = x["d"]
        bad = d.isNotNull() & L.no_degree(d)
        stream = _first(F.transform(b, lambda y: F.regexp_extract(y, STREAM, 1)), lambda y: (y != "") & ~L.no_degree(y))
        return T.let(bad, lambda no: F.struct(
            F.coalesce(F.when(~no, d), F.when(x["s"].isNotNull(), F.initcap(stream))).alias("d"), x["s"].alias("s"),
            F.coalesce(x["duration"], F.when(no & ~score(d) & d.rlike(L.RANGE), d)).alias("duration"),
            F.when(no & score(d), F.array_distinct(F.array_append(x["grades"], d))).otherwise(x["grades"]).alias("grades"),
        ))

    def went_on(x: Column) -> Column:
        """With a line of its own that the degree goes on with, anywhere in the block, else the line after the degree's."""
        d = x["d"]
        alone = lambda word: F.exists(b, lambda y: F.lower(y) == word) & ~L.holds(d, (word,))
        after = _first(F.filter(F.transform(b, lambda y, i: F.when(F.contains(y, d), F.get(b, i + 1))), lambda y: F.lower(y).isin(*GOES_ON)))
        rest = F.when(many, F.when(alone("engineering"), F.lit("Engineering")).when(alone("technology"), F.lit("Technology")).otherwise(after))
        whole = T.let(rest, lambda r: F.when(r.isNotNull(), F.concat_ws(" ", d, r)).otherwise(d))
        clean = T.let(T.clean_field(F.regexp_replace(whole, r":-\s*", " - ")), lambda c: F.when(~L.no_degree(c), c))
        return F.struct(clean.alias("d"), T.clean_field(x["s"]).alias("s"), _dated(x["duration"]).alias("span"), x["grades"].alias("grades"))

    def shown(x: Column) -> Column:
        s, span = x["s"], x["span"]
        default = F.when(L.holds(s, SCHOOL_PARTS), F.lit(SCHOOL_DEGREE)).otherwise(F.lit(ANY_DEGREE))
        details = T.let(F.array_join(x["grades"], "; "), lambda v: F.when(v != "", v))
        return F.struct(
            F.coalesce(x["d"], F.when(s.isNotNull(), default)).alias("degree"), s.alias("institution"), *[span[c].alias(c) for c in ("duration", "start_date", "end_date")], details.alias("details"),
        )

    return T.let(T.let(T.let(T.let(parts(), filled), judged), went_on), shown)


def _dated(duration: Column) -> Column:
    """Struct of the shown duration, start_date and end_date of a written one; a year alone is the end, `2019-21` spans a century's years."""
    d = T.parsed_range(duration)
    return F.struct(d["shown"].alias("duration"), d["start"].alias("start_date"), d["end"].alias("end_date"))


def misplaced(text: Column) -> Column:
    """Records (as RECORD) of lines that name an institution, a dash and a degree, the last line first."""
    group = lambda x, k: F.regexp_extract(x, MISPLACED, k)

    def record(x: Column) -> Column:
        tail = group(x, 4)
        field = L.edged(group(x, 3), r"\s,\-–—")
        dates = _dated(_span(tail))
        notes = F.array(F.nullif(F.regexp_extract(tail, L.GRADE, 0), F.lit("")), F.when(L.holds(tail, ("first division",)), F.lit("First Division")))
        return F.struct(
            T.clean_field(F.concat_ws(" ", stripped(group(x, 2)), F.nullif(field, F.lit("")))).alias("degree"), T.clean_field(group(x, 1)).alias("institution"),
            *[dates[c].alias(c) for c in ("duration", "start_date", "end_date")],
            F.nullif(F.array_join(F.filter(notes, lambda n: n.isNotNull()), "; "), F.lit("")).alias("details"),
        )

    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MISPLACED), F.lit(0))
    return F.reverse(F.filter(F.transform(found, record), lambda r: r["institution"].isNotNull() & ~L.no_degree(r["degree"]))).cast(RECORD)


def _merged_pair(a: Column, b: Column) -> Column:
    """Record a filled from b; of two degrees the longer, of two details both unless one holds the other."""
    both = F.when(F.contains(a["details"], b["details"]), a["details"]).otherwise(F.concat_ws("; ", a["details"], b["details"]))
    fill = [F.coalesce(a[c], b[c]).alias(c) for c in ("institution", "duration", "start_date", "end_date")]
    degree = F.when(F.length(b["degree"]) > F.length(a["degree"]), b["degree"]).otherwise(a["degree"])
    return F.struct(degree.alias("degree"), *fill, F.nullif(F.coalesce(both, F.lit("")), F.lit("")).alias("details"))


def merged(records: Column) -> Column:
    """Records without those that name no degree, merged in their order: into the first earlier one whose degree is the same
    or, from 5 characters on, holds the other, if their institutions do not differ."""

    # what is compared is brought to lower case once a record, not once a pair
    keyed = lambda r: F.struct(r.alias("r"), F.lower(r["degree"]).alias("x"), F.lower(r["institution"]).alias("s"))
    kind = f"array<struct<r:{RECORD[6:-1]},x:string,s:string>>"

    def fits(a: Column, b: Column) -> Column:
        x, y, s, t = a["x"], b["x"], a["s"], b["s"]
        inside = (F.contains(x, y) & (F.length(y) >= 5)) | (F.contains(y, x) & (F.length(x) >= 5))
        return (s.isNull() | t.isNull() | (s == t)) & ((x == y) | inside)

    def add(done: Column, r: Column) -> Column:
        at = F.array_position(F.transform(done, lambda a: F.coalesce(fits(a, r), F.lit(False))), True).cast("int")
        return T.let(at, lambda k: F.when(k == 0, F.concat(done, F.array(r))).otherwise(F.transform(done, lambda a, i: F.when(i == k - 1, keyed(_merged_pair(a["r"], r["r"]))).otherwise(a))))

    named = F.transform(records, lambda r: F.when(~F.lower(r["institution"]).isin(*NO_INSTITUTION) | r["institution"].isNull(), r).otherwise(r.withField("institution", F.lit(None).cast("string"))))
    kept = F.filter(named, lambda r: F.coalesce(~L.no_degree(r["degree"]) & ~L.holds(r["degree"], NO_RECORD), F.lit(False)))
    return F.aggregate(F.transform(kept.cast(RECORD), lambda r: keyed(r)).cast(kind), F.array().cast(kind), add, lambda done: F.transform(done, lambda k: k["r"]))


def held_degrees(section: Column, words: Words, text: Column | None = None) -> Column:
    """The degrees that an education part tells, in order, as RECORD; misplaced ones of the whole text, if it is given, come first
    unless the part already has them."""
    none = F.array().cast(RECORD)
    own = T.let(L.text_lines(section), lambda a: T.let(degree_blocks(a), lambda o: F.transform(o, lambda b: _record(b, words)))).cast(RECORD)
    if text is None:
        return merged(F.coalesce(own, none))

    def both(own: Column, more: Column) -> Column:
        inside = lambda value, field: F.exists(own, lambda r: F.coalesce(F.contains(F.lower(r[field]), F.lower(value)), F.lit(False)))
        return F.concat(F.filter(more, lambda m: ~inside(m["institution"], "institution") & ~inside(m["degree"], "degree")), own)

    all_ = T.let(F.struct(F.coalesce(own, none).alias("own"), F.coalesce(misplaced(text), none).alias("more")), lambda x: both(x["own"], x["more"]))
    return T.let(all_, merged)


def degrees(docs: DataFrame, id_: str, section: str, words: Words, text: str | None = None) -> DataFrame:
    """One row for each degree of a document: id_, number (from 1), degree, institution, duration, start_date, end_date,
    details. section names the column of the education part; text, if given, that of the whole text, whose misplaced degrees
    come first unless the part already has them. Null and empty texts have none.
    """
    rows = docs.select(F.col(id_), held_degrees(F.col(section), words, F.col(text) if text else None).alias("_all"))
    return T.each(rows, "_all", id_).select(id_, "number", "item.*")
