"""Matching terms to pages, and the reading order of a page's blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.operators.intervals import box_union


def match_pages(terms: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """terms (key, term) with page: the first page that holds the term; else the page with most of its words, if that is
    at least half of them and at least one (ties to the earlier page); else null.

    Terms meet pages of their own document only, by an equi-join on key.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("term"), r"\s+"), lambda w: w != ""))
    joined = terms.join(pages.select(key, "page", F.lower("text").alias("_text")), key, "left")
    shared = F.size(F.array_intersect(words, F.split("_text", r"\s+")))
    holds = F.contains("_text", F.lower("term"))
    enough = shared >= F.greatest(F.lit(1), F.floor(F.size(words) / 2).cast("int"))
    scored = joined.withColumn("_score", F.when(holds, 1_000_000).when(enough, shared))
    return scored.groupBy(key, "term").agg(F.max_by("page", F.when(F.col("_score").isNotNull(), F.struct(F.col("_score"), -F.col("page")))).alias("page"))


def assign_boxes(fields: DataFrame, layers: DataFrame, key: str) -> DataFrame:
    """fields (key, field, terms, fallback) with page and box: where a document shows each of its fields.

    The page is the first one whose text holds the first term that any page holds; else the one that holds most words of one
    term, at least half of them (ties to the earlier term, then page); else the fallback page if the document has it, else
    the first. The box is the union of the boxes of that page's layers that hold a term, lie within one, or hold a word of
    one; null for none. Terms and words below three characters are left out. layers: key, page, layer (its place in reading
    order), text, x, y, width, height.

    A field meets the pages and layers of its own document only. Its terms are one row each, so that fields with many terms
    are spread; what is chosen for a field is one aggregation with a map side.
    """
    low = F.lower(F.trim("term"))
    words = F.array_distinct(F.filter(F.split(low, r"\s+"), lambda w: F.length(w) >= 3))
    terms = fields.select(key, "field", F.posexplode("terms").alias("_i", "term")).filter(F.length(F.trim("term")) >= 3).select(key, "field", "_i", low.alias("_term"), words.alias("_words"))
    texts = layers.filter("text is not null").groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct("layer", F.lower("text").alias("t")))).alias("_l"))
    texts = texts.select(key, "page", F.array_join(F.transform("_l", lambda x: x["t"]), " ").alias("_text"))
    met = terms.join(texts, key).withColumn("_n", F.size(F.filter("_words", lambda w: F.contains("_text", w))))
    held = F.when(F.contains("_text", F.col("_term")), F.struct("_i", "page"))
    enough = (F.size("_words") > 0) & (F.col("_n") >= F.greatest(F.lit(1), F.floor(F.size("_words") / 2)))
    most = F.when(enough, F.struct((-F.col("_n")).alias("n"), F.col("_i"), F.col("page")))
    found = met.groupBy(key, "field").agg(F.min(held).alias("_held"), F.min(most).alias("_most")).select(key, "field", F.coalesce("_held.page", "_most.page").alias("_found"))
    known = layers.groupBy(key).agg(F.collect_set("page").alias("_pages"), F.min("page").alias("_first"))
    placed = fields.select(key, "field", "fallback").join(found, [key, "field"], "left").join(known, key, "left")
    default = F.when(F.array_contains("_pages", F.col("fallback")), F.col("fallback")).otherwise(F.col("_first"))
    placed = placed.select(key, "field", F.coalesce("_found", default).alias("page"))
    near = terms.join(placed, [key, "field"]).join(layers.filter("text is not null and text <> ''").select(key, "page", F.lower("text").alias("_text"), "x", "y", "width", "height"), [key, "page"])
    near = near.filter(F.contains("_text", F.col("_term")) | F.contains("_term", F.col("_text")) | F.exists("_words", lambda w: F.contains("_text", w)))
    return placed.join(box_union(near, [key, "field"]), [key, "field"], "left")


def order_of_blocks(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, width: float, bins: int = 100) -> np.ndarray:
    """The reading order of blocks: columns left to right between blocks that span the page, each top to bottom.

    Column gaps are stretches of the middle of the page (15 to 85 %) that no block narrower than 70 % of it covers.
    """
    full = (x1 - x0) >= 0.7 * width
    covered = np.zeros(bins, bool)
    for a, b in zip(x0[~full], x1[~full], strict=True):
        covered[max(0, int(a / width * bins)) : min(bins, int(np.ceil(b / width * bins)))] = True
    middle = np.arange(int(0.15 * bins), int(0.85 * bins))
    free = middle[~covered[middle]]
    cuts = [g.mean() / bins * width for g in np.split(free, np.flatnonzero(np.diff(free) > 1) + 1) if len(g)] if len(free) and covered.any() else []
    breaks = np.sort(y0[full])
    region = np.searchsorted(breaks, y0, side="right") * 2 - full
    column = np.where(full, 0, np.searchsorted(cuts, (x0 + x1) / 2))
    return np.lexsort((x0, y0, column, region))


def reading_order(blocks: DataFrame, key: str) -> DataFrame:
    """blocks (key, page, width, x0, y0, x1, text) as one text for each page, in reading order."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        order = order_of_blocks(pdf["x0"].to_numpy(float), pdf["y0"].to_numpy(float), pdf["x1"].to_numpy(float), float(pdf["width"].iloc[0]))
        return pd.DataFrame({key: pdf[key].iloc[:1], "page": pdf["page"].iloc[:1], "text": ["\n".join(pdf["text"].iloc[order])]})

    return blocks.groupBy(key, "page").applyInPandas(one, f"{key} {blocks.schema[key].dataType.simpleString()}, page {blocks.schema['page'].dataType.simpleString()}, text string")
