"""Arithmetic of intervals and boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_length(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """covered: the length of the union of each key's intervals; touching and overlapping ones merge."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opens = df.withColumn("_reach", F.max(end).over(before)).withColumn("_new", F.coalesce(F.col(start) > F.col("_reach"), F.lit(True)).cast("int"))
    islands = opens.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy(*keys, "_island").agg((F.max(end) - F.min(start)).alias("_span"))
    return spans.groupBy(*keys).agg(F.sum("_span").alias("covered"))


def months_text(months: Column) -> Column:
    """Months in words: below a year `n Months`, a remainder of two or more as `Ny Mm`, else `N Years`; null for none."""
    years, rest = F.floor(months / 12).cast("long"), (months % 12).cast("long")
    return (
        F.when(months < 12, F.concat(months.cast("long").cast("string"), F.lit(" Months")))
        .when(rest >= 2, F.concat(years.cast("string"), F.lit("y "), rest.cast("string"), F.lit("m")))
        .otherwise(F.concat(years.cast("string"), F.lit(" Years")))
    )


def total_experience(items: DataFrame, keys: Sequence[str], as_of: Column) -> DataFrame:
    """experience: the time that each key's items cover, in words; null where no item tells one.

    items has start_date and end_date (`YYYY` or `YYYY-MM`; a start without a month is January, an end December),
    is_current and duration. A current item, or one that lasts to the present, ends in as_of (a date). An item without
    usable dates counts by the years and months of its duration, from month 0 on, so that such items overlap.
    """
    number = lambda c, pattern, group: F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))
    date = lambda c: F.struct(*[number(F.trim(c), r"^([0-9]{4})(?:-([0-9]{1,2}))?", k).cast("int").alias(n) for k, n in ((1, "y"), (2, "m"))])
    current = F.coalesce("is_current", F.lit(False)) | F.coalesce(F.lower("duration").contains("present"), F.lit(False))
    years, months = number(F.col("duration"), r"(?i)([0-9]+(?:[.][0-9]+)?)\s*(?:years?|yrs?)", 1).cast("double"), number(F.col("duration"), r"(?i)([0-9]+)\s*(?:months?|m\b)", 1).cast("double")
    # the texts are parsed once a row, in a step of their own; what follows is arithmetic
    parsed = items.select(*keys, date(F.col("start_date")).alias("_s"), date(F.col("end_date")).alias("_e"), current.alias("_now"), F.floor(years * 12 + F.coalesce(months, F.lit(0.0))).cast("int").alias("_lasting"))
    month = lambda d, missing: F.col(f"{d}.y") * 12 + F.coalesce(f"{d}.m", F.lit(missing))
    start, end = month("_s", 1), F.when(F.col("_now"), F.year(as_of) * 12 + F.month(as_of)).otherwise(month("_e", 12))
    timed = parsed.select(*keys, "_lasting", start.alias("_start"), end.alias("_end"))
    dated = F.coalesce((F.col("_start") > 0) & (F.col("_end") >= F.col("_start")), F.lit(False))
    lasting = F.col("_lasting") > 0
    spans = timed.select(*keys, F.when(dated, F.col("_start")).when(lasting, 0).alias("_from"), F.when(dated, F.col("_end")).when(lasting, F.col("_lasting")).alias("_to"))
    return union_length(spans, keys, "_from", "_to").select(*keys, months_text(F.when(F.col("covered") > 0, F.col("covered"))).alias("experience"))


def box_union(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The smallest box around the boxes (x, y, width, height) of each key, to two places."""
    right, bottom = F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))
    left, top = F.min("x"), F.min("y")
    return df.groupBy(*keys).agg(
        F.round(left, 2).alias("x"), F.round(top, 2).alias("y"),
        F.round(F.greatest(right - left, F.lit(0.0)), 2).alias("width"), F.round(F.greatest(bottom - top, F.lit(0.0)), 2).alias("height"),
    )
