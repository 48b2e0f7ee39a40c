"""Layout geometry as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard page sizes in points, by name, and how far a page may be off.
PAGE_SIZES = {"A4": (595, 842), "Letter": (612, 792), "Legal": (612, 1008), "A3": (842, 1191), "A5": (420, 595)}
TOLERANCE = 3.0

#: Widths of characters by class, in parts of the font size.
NARROW, WIDE, NARROW_WIDTH, WIDE_WIDTH, UPPER_WIDTH, OTHER_WIDTH, BOLD = "iljtf.,;:'|!()[] ", "mwMW@%", 0.3, 0.85, 0.65, 0.5, 1.08


def page_size(width: Column, height: Column) -> Column:
    """[width, height] of the standard size that a page has, upright or turned; else its own, rounded to even. A literal, not a join."""
    near = lambda a, b: F.abs(a - F.lit(float(b))) <= TOLERANCE
    size = F.lit(None).cast("array<int>")
    for w, h in PAGE_SIZES.values():
        for a, b in ((w, h), (h, w)):
            size = F.coalesce(size, F.when(near(width, a) & near(height, b), F.array(F.lit(a), F.lit(b))))
    return F.coalesce(size, F.array(F.bround(width).cast("int"), F.bround(height).cast("int")))


def text_width(text: Column, size: Column, bold: Column) -> Column:
    """The width of a run by character classes, to two places."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    narrow, wide = count("[" + re.sub(r"([^A-Za-z ])", r"\\\1", NARROW) + "]"), count("[" + "".join(WIDE) + "]")
    upper = count("[A-LN-VX-Z]")
    other = F.length(text) - narrow - wide - upper
    width = (narrow * NARROW_WIDTH + wide * WIDE_WIDTH + upper * UPPER_WIDTH + other * OTHER_WIDTH) * size
    return F.round(width * F.when(bold, BOLD).otherwise(1.0), 2)


def hex_colour(red: Column, green: Column, blue: Column) -> Column:
    """#rrggbb, or #rgb where each pair repeats a digit."""
    pair = lambda c: F.lower(F.lpad(F.hex(F.least(F.greatest(c.cast("int"), F.lit(0)), F.lit(255)).cast("long")), 2, "0"))
    full = F.concat(pair(red), pair(green), pair(blue))
    return F.concat(F.lit("#"), F.when(full.rlike(r"^(.)\1(.)\2(.)\3$"), F.regexp_replace(full, "(.).", "$1")).otherwise(full))


def coordinate(c: Column) -> Column:
    """A coordinate as text: whole if within 0.05 of a whole number, else to one place."""
    return F.when(F.abs(c - F.round(c)) <= 0.05, F.round(c).cast("long").cast("string")).otherwise(F.format_string("%.1f", F.round(c, 1)))


def shape_kind(width: Column, height: Column) -> Column:
    return F.when((width <= 4) | (height <= 4), "line").otherwise("rectangle")


def unletterbox(box: Column, page_width: Column, page_height: Column, canvas: tuple[int, int]) -> Column:
    """A box of relative corners on a canvas that holds the page letterboxed, in page points, clamped, to one place."""
    w, h = canvas
    scale = F.least(F.lit(float(w)) / page_width, F.lit(float(h)) / page_height)
    left, top = (w - page_width * scale) / 2, (h - page_height * scale) / 2
    fit = lambda v, pad, span, most: F.round(F.least(F.greatest((v * span - pad) / scale, F.lit(0.0)), most), 1)
    x, y = lambda i: fit(F.element_at(box, i), left, F.lit(float(w)), page_width), lambda i: fit(F.element_at(box, i), top, F.lit(float(h)), page_height)
    return F.array(x(1), y(2), x(3), y(4))


def layout_json(pages: Column) -> Column:
    """Pages with their layers as indented JSON in which lists of numbers, and lists that begin with a text, stand on one line.

    pages is an array of structs; null members are left out. A layer, a page and the whole each begin a line of their own.
    """
    text = F.to_json(pages)
    numbers, mixed = r"\[\s*(-?[0-9.eE+-]+(?:,\s*-?[0-9.eE+-]+)*)\s*\]", r"\[(\"[^\"]+\"(?:,(?:\"[^\"]+\"|-?[0-9.eE+-]+))*)\]"
    spaced = lambda c, pattern: F.array_join(F.transform(F.regexp_extract_all(c, F.lit(rf"{pattern}|[^\[]+|\["), F.lit(0)), lambda x: F.when(x.rlike(rf"^{pattern}$"), F.regexp_replace(x, ",", ", ")).otherwise(x)), "")
    return F.regexp_replace(spaced(spaced(text, numbers), mixed), r"\{\"(page|type)\"", "\n{\"$1\"")
