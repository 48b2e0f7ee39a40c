"""Operators over an attribute-value store with soft deletion: live rows, latest versions, pivots, cascades, upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(conditions: Sequence[Column]) -> Column:
    """The conjunction; true for no conditions."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def live(df: DataFrame, flag: str = "is_deleted") -> DataFrame:
    """Rows that are not deleted; a null flag counts as live."""
    return df.filter(~F.coalesce(flag, F.lit(False)))


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key: one aggregation, combined on the map side, no sort and no window."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def pivot_fields(df: DataFrame, key: str, field: str, value: str, fields: Sequence[str], order: str) -> DataFrame:
    """One row for each key with a column for each field: the value of the largest `order`; null where it is missing."""
    columns = [F.max_by(F.when(F.col(field) == f, F.col(value)), F.when(F.col(field) == f, F.col(order))).alias(f) for f in fields]
    return df.filter(F.col(field).isin(*fields)).groupBy(key).agg(*columns)


def page(df: DataFrame, order: Sequence[Column], size: int, number: int = 1) -> DataFrame:
    """Rows of one page, numbered from 1; an order that ends in a unique key makes pages disjoint."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def wide_page(keys: DataFrame, key: str, order: Sequence[Column], size: int, number: int, latest: DataFrame, at: Sequence[str], values: DataFrame, by: str, field: str, value: str, fields: Sequence[str]) -> DataFrame:
    """One page of a list, keys first: the wide rows are made for that page's keys alone.

    keys is the narrow table that filters have already acted on; only its page is sorted out (at most `size` rows, which are
    broadcast). latest (key, by, ...) gives a key's newest row by `at`, values (by, field, value, and `at` order) its
    attributes; both are read through semi joins with the page's keys before anything is aggregated, so that no pivot or
    latest row is computed for what the page does not show.
    """
    shown = F.broadcast(page(keys, order, size, number))
    newest = latest_by(latest.join(shown.select(key), key, "left_semi"), [key], at)
    few = F.broadcast(newest)  # one row a key of the page
    wide = values.join(few.select(by), by, "left_semi").filter(F.col(field).isin(*fields)).groupBy(by)
    wide = wide.agg(*[F.max_by(F.when(F.col(field) == f, F.col(value)), F.when(F.col(field) == f, F.col("_at"))).alias(f"field_{f.lower()}") for f in fields])
    return shown.join(few, key, "left").join(wide, by, "left").orderBy(*order)


def search_keys(docs: DataFrame, key: str, versions: DataFrame, by: str, values: DataFrame, name: str, text_fields: Sequence[str], query: str, array_field: str, wanted: Sequence[str]) -> DataFrame:
    """The rows of docs that a search finds: whose name, or one of the text fields of its latest version, holds the query (in
    any case, wildcards literal), and whose array field, a JSON array, holds all wanted items.

    versions (key, by) is narrow: its latest rows are one aggregation of two columns. values (by, field, value) is filtered
    first and then joined by keys alone; the OR of name and fields is a left join with the keys that the fields found.
    """
    newest = versions.groupBy(key).agg(F.max(by).alias(by))
    holds = lambda c: F.contains(F.lower(c), F.lit(query.lower()))
    of_document = lambda test: values.filter(test).select(by).join(newest, by).select(key).distinct()
    found = of_document(F.col("field").isin(*text_fields) & holds(F.col("value"))).withColumn("_found", F.lit(True))
    rows = docs.join(found, key, "left").filter(holds(F.col(name)) | F.col("_found").isNotNull()).drop("_found")
    if wanted:
        items = F.from_json("value", "array<string>")
        rows = rows.join(of_document((F.col("field") == array_field) & all_of([F.array_contains(items, w) for w in wanted])), key, "left_semi")
    return rows


def total_pages(total: Column, size: int) -> Column:
    """Pages of `size` rows; 0 for a size that is not positive."""
    return F.ceil(total / size).cast("long") if size > 0 else F.lit(0).cast("long")


def cascade(parent: DataFrame, chain: Sequence[tuple[DataFrame, str, str, str]], hit: Column, key: str) -> list[DataFrame]:
    """parent and its descendants, each with the boolean column `hit`: rows that a change of the hit parents reaches.

    chain: (child, its foreign key, its own key, "parent key"). Keys of hit rows go down as left joins of distinct keys.
    """
    out = [parent.withColumn("hit", F.coalesce(hit, F.lit(False)))]
    keys = out[0].filter("hit").select(F.col(key).alias("_key")).distinct()
    for child, foreign, own, _ in chain:
        marked = child.join(keys.withColumn("hit", F.lit(True)), child[foreign] == F.col("_key"), "left").drop("_key")
        marked = marked.withColumn("hit", F.coalesce("hit", F.lit(False)))
        out.append(marked)
        keys = marked.filter("hit").select(F.col(own).alias("_key")).distinct()
    return out


def match_name_or_hash(batch: DataFrame, stored: DataFrame, name: str, hash_: str, id_: str, within: Sequence[str] = ()) -> DataFrame:
    """batch with matched_id: the newest stored row of that name or that hash, null if there is none; of the same project, if
    within names the columns that tell it.

    An OR of two equalities would be a nested-loop join; two equi-joins and a maximum are not.
    """
    own = [F.col(c).alias(f"_{c}") for c in within]
    by_name = stored.groupBy(*own, F.col(name).alias("_name")).agg(F.max(id_).alias("_by_name"))
    by_hash = stored.groupBy(*own, F.col(hash_).alias("_hash")).agg(F.max(id_).alias("_by_hash"))
    same = all_of([F.col(c) == F.col(f"_{c}") for c in within])
    joined = batch.join(by_name, same & (F.col(name) == F.col("_name")), "left").drop(*[f"_{c}" for c in within])
    joined = joined.join(by_hash, same & (F.col(hash_) == F.col("_hash")), "left")
    return joined.withColumn("matched_id", F.greatest("_by_name", "_by_hash")).select(*batch.columns, "matched_id")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, foreign: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent is missing."""
    return child.join(parent.select(F.col(key).alias("_key")), F.col(foreign) == F.col("_key"), "left_anti")


def catalog_additions(wanted: DataFrame, catalog: DataFrame, keys: Sequence[str], id_: str = "id") -> DataFrame:
    """keys and an id for each distinct wanted entry without a live row in the catalog: the batch to append.

    The id is a hash of the keys, so that tasks need not agree on a counter, and saving the same batch again adds nothing
    new. Entries with a null key are none.
    """
    known = live(catalog).select(*keys)
    fresh = wanted.select(*keys).dropna(subset=list(keys)).distinct().join(known, list(keys), "left_anti")
    return fresh.select(*keys, F.xxhash64(*keys).alias(id_))


def replacing(batch: DataFrame, stored: DataFrame, parent: str, keys: Sequence[str], parents: DataFrame | None = None) -> DataFrame:
    """The rows that save a batch of children: the batch itself as live rows, and as deleted ones the live stored rows of
    the saved parents that the batch lacks. parents holds the ids of all parents that are saved, also of those that have no
    children any more; without it, they are those of the batch. Other parents keep theirs. keys, with the parent, tell a
    child."""
    columns = [c for c in batch.columns if c != "is_deleted"]
    saved = (batch if parents is None else parents).select(parent).distinct()
    stale = live(stored).select(*columns).join(saved, parent, "left_semi").join(batch.select(parent, *keys), [parent, *keys], "left_anti")
    return batch.select(*columns, F.lit(False).alias("is_deleted")).unionByName(stale.select(*columns, F.lit(True).alias("is_deleted")))


def newest_live(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest live row of each key, such as the latest document of an exact file name in a project."""
    return latest_by(live(df), keys, order)
