"""Entities in tables: what a table lists is inferred from its header row, columns are found by their names, rows become records.

A table is an array of rows, a row an array of cells. Everything happens within the row that holds the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions import lines as L
from vellumine.functions import text as T
from vellumine.functions.skills import Words, stripped, valid_skill

#: Parts of the names of columns.
PROJECT, TECH, ABOUT = ("project",), ("tech", "tool", "stack", "skill", "language"), ("desc", "detail", "role", "summary")
PROJECT_NAME, BESIDE_TITLE = ("project", "title", "name"), ("tech", "tool", "stack", "desc", "role", "skill", "language")
DEGREE, DEGREE_HINT = ("degree", "qualification", "exam", "course"), ("degree", "qualification", "exam", "course", "education")
SCHOOL, YEAR, SCORE = ("institution", "college", "university", "school", "board"), ("year", "duration", "period", "passing"), ("percentage", "percent", "cgpa", "gpa", "grade", "score", "marks")
COMPANY, COMPANY_NAME, ROLE = ("company", "organization", "employer"), ("company", "organization", "employer", "firm"), ("designation", "role", "position", "title")
TIME_HINT, TIME = ("duration", "year", "period"), ("duration", "period", "dates", "year")
NO_PROJECT = ("project", "project name", "title", "projects")

RECORD = "struct<title:string,organisation:string,duration:string,start_date:string,end_date:string,is_current:boolean,details:string,items:array<string>>"


def _any(header: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(header, lambda c: L.holds(c, parts))


def _at(header: Column, parts: tuple[str, ...], default: int) -> Column:
    """The number of the first column whose name holds one of the parts."""
    return F.coalesce(F.nullif(F.array_position(F.transform(header, lambda c: L.holds(c, parts)), True).cast("int"), F.lit(0)) - 1, F.lit(default))


def table_kind(header: Column) -> Column:
    """project, education or experience by the names of the columns; null for none of them."""
    project = _any(header, PROJECT) | ((F.size(header) >= 2) & _any(header, ("title",)) & _any(header, BESIDE_TITLE))
    education = _any(header, DEGREE_HINT) | _any(header, SCHOOL)
    experience = _any(header, COMPANY) | (_any(header, ROLE) & _any(header, TIME_HINT))
    return F.when(project, "project").when(education, "education").when(experience, "experience")


def table_entities(df: DataFrame, id_: str, table: str, words: Words) -> DataFrame:
    """id_, number (of the row, from 1), kind, title, organisation, duration, start_date, end_date, is_current, details, items.

    A project has its description as details and its technologies, those that are skills, as items; a degree its school as
    organisation and its score as details. Tables without rows below the header, of no kind, and null ones have none;
    missing cells are empty.
    """
    rows = df.select(id_, F.col(table).alias("t")).withColumn("h", F.transform(F.get("t", F.lit(0)), lambda c: F.lower(stripped(F.coalesce(c, F.lit(""))))))
    places = {
        "project": (_at(F.col("h"), PROJECT_NAME, 0), F.lit(-1), F.lit(-1), _at(F.col("h"), ABOUT, -1), _at(F.col("h"), TECH, -1)),
        "education": (_at(F.col("h"), DEGREE, 0), _at(F.col("h"), SCHOOL, 1), _at(F.col("h"), YEAR, -1), _at(F.col("h"), SCORE, -1), F.lit(-1)),
        "experience": (_at(F.col("h"), ROLE, 0), _at(F.col("h"), COMPANY_NAME, 1), _at(F.col("h"), TIME, -1), F.lit(-1), F.lit(-1)),
    }
    rows = rows.withColumn("kind", table_kind(F.col("h")))
    chosen = F.lit(None)
    for kind, columns in places.items():
        chosen = F.when(F.col("kind") == kind, F.array(*columns)).otherwise(chosen)
    rows = rows.withColumn("at", chosen.cast("array<int>")).withColumn("body", F.when(F.col("kind").isNotNull(), F.slice("t", 2, F.size("t"))))
    cell = lambda i: stripped(F.coalesce(F.when(F.get("at", F.lit(i)) >= 0, F.get("item", F.get("at", F.lit(i)))), F.lit("")))
    cells = T.each(rows, "body", id_, "kind", "at").select(id_, "kind", "number", *[cell(i).alias(c) for i, c in enumerate(("title", "organisation", "duration", "details", "items"))])
    project, degree = F.col("kind") == "project", F.col("kind") == "education"
    named = F.when(project, (F.col("title") != "") & ~F.lower("title").isin(*NO_PROJECT)).otherwise((F.col("title") != "") | (F.col("organisation") != ""))
    cells = cells.select(
        id_, "number", "kind", named.alias("_named"), F.coalesce(T.clean_field(F.col("title")), F.when(degree, F.lit("Degree"))).alias("title"), T.clean_field(F.col("organisation")).alias("organisation"),
        T.parsed_range(T.blank_to_null(F.col("duration"))).alias("d"), T.clean_field(F.col("details")).alias("details"),
        F.filter(F.transform(F.split("items", "[,;|]"), stripped), lambda s: valid_skill(s, words)).alias("items"),
    )
    dates = (F.col("d.shown").alias("duration"), F.col("d.start").alias("start_date"), F.col("d.end").alias("end_date"), F.coalesce("d.is_current", F.lit(False)).alias("is_current"))
    out = cells.select(id_, "number", "kind", "title", "organisation", *dates, "details", "items", "_named")
    return T.kept_rows(out, lambda r: r["_named"]).drop("_named")
