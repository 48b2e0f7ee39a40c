"""Saves, catalogues and lookups of documents over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import log, pages, store
from vellumine.sources import files
from vellumine.sources.tables import table


def save_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages: the conversations that mention a comma are saved again with new texts and without their last turn,
    which leaves some without any; counts and deletions by conversation."""
    stored = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lit(None).cast("boolean").alias("is_deleted"))
    last = stored.groupBy("conv_id").agg(F.max("turn").alias("last"), F.max(F.contains("text", F.lit(","))).alias("again"))
    batch = stored.join(last.filter("again"), "conv_id").filter("turn < last").select("conv_id", "turn", F.concat(F.lit("new "), "text").alias("text"))
    saved = store.replacing(batch, stored, "conv_id", ["turn"], last.filter("again"))
    return saved.groupBy("conv_id").agg(F.count_if(~F.col("is_deleted")).alias("n_live"), F.count_if("is_deleted").alias("n_retired"), F.max(F.when(F.col("is_deleted"), F.col("turn"))).alias("retired_turn"))


def catalog_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields (source, lang) of documents that the catalogue lacks; it has those of toxic documents, non-English ones deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    catalog = docs.join(toxic, "doc_id", "left_semi").select("source", "lang", (F.col("lang") != "en").alias("is_deleted"))
    return store.catalog_additions(docs, catalog, ["source", "lang"]).select("source", "lang")


def newest_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest document of each text that no label calls toxic, with its size."""
    toxic = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("is_deleted"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"), "n_chars").join(toxic, "doc_id", "left")
    return store.newest_live(docs, ["digest"], ["doc_id"]).select("digest", "doc_id", "n_chars")


def records_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live records with `N` in their language's name and 500 characters or more."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("is_deleted"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("overall_profile"), F.col("n_chars").alias("score"))
    return files.select_records(docs.join(labels, "doc_id", "left"), "N", 500.0).select("doc_id", "score")


def failed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for pages whose url has a query, as failed documents."""
    pages = table(spark, sf_dir, "pages").select("url", F.when(F.contains("url", F.lit("?")), F.lit("has a query")).alias("error"))
    return files.failed_records(pages, "url", "error").select("file_name", "file_stem", "status", F.size("skills").alias("n_skills"), "error_message")


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def documents_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole saves as batches of a log: all documents with their lines (0); the English ones again, with new lines and
    without the last (1); empty saves of all that were begun and never committed (2); the toxic ones are deleted (3), and
    those of them that a label calls good restored (4). What a reader sees of each document."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "lang", "text")
    labels = table(spark, sf_dir, "labels")
    toxic, good = labels.filter("toxic = 1").select("doc_id"), labels.filter("quality = 1").select("doc_id")
    head, english = docs.select("doc_id", "lang"), docs.filter("lang = 'en'").select("doc_id", "lang", F.split("text", "\n").alias("l"))
    shorter = english.select("doc_id", F.posexplode(F.slice("l", 1, F.size("l") - 1)).alias("line", "text")).withColumn("text", F.concat(F.lit("new "), "text"))
    first = log.document_batch(head, {"lines": (_lines(docs), ["line"])}, {}, "doc_id")
    second = log.document_batch(english.select("doc_id", "lang"), {"lines": (shorter, ["line"])}, {"lines": first["lines"]}, "doc_id")
    lost = log.document_batch(head, {"lines": (_lines(docs).filter("false"), ["line"])}, {"lines": first["lines"]}, "doc_id")
    commits = spark.createDataFrame([(0,), (1,), (3,), (4,)], "seq long")

    def numbered(rows: DataFrame, seq: int) -> DataFrame:
        return rows.withColumn("seq", F.lit(seq).cast("long"))

    def state(name: str, on: list[str]) -> DataFrame:
        rows = log.visible(reduce(DataFrame.unionByName, [numbered(b[name], seq) for seq, b in enumerate((first, second, lost))]), commits)
        rows = rows.unionByName(numbered(log.flagged(store.live(store.latest_by(rows, on, ["seq"])), toxic, ["doc_id"], True), 3))
        return store.latest_by(rows.unionByName(numbered(log.restored(rows, on, 3, good, ["doc_id"]), 4)), on, ["seq"])

    lines = state("lines", ["doc_id", "line"]).groupBy("doc_id").agg(
        F.count_if(~F.col("is_deleted")).alias("n_lines"), F.count_if("is_deleted").alias("n_gone"), F.max(F.when(~F.col("is_deleted"), F.md5("text"))).alias("digest")
    )
    return state("documents", ["doc_id"]).select("doc_id", "seq", "is_deleted").join(lines, "doc_id", "left")


def field_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document shows four fields: its beginning, words 10 to 14 or word 20 of it, its last two words, and words that
    no text holds. Lines are layers, five to a page."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text", F.split(F.regexp_replace("text", "[ \t\n\r]+", " "), " ").alias("w"))
    some = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    layers = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("layer", "text")).select(
        "doc_id", (F.floor(F.col("layer") / 5) + 1).cast("int").alias("page"), "layer", "text", (F.col("layer") % 3 * 10 + 0.5).alias("x"), (F.col("layer") * 12.25).alias("y"),
        (F.length("text") * 5.5).alias("width"), F.lit(10.0).alias("height"),
    )
    wanted = {"start": F.array(F.substring("text", 1, 60)), "middle": F.array(some(10, 5), some(20, 1)), "end": F.array(F.array_join(F.slice(F.reverse("w"), 1, 2), " ")), "none": F.array(F.lit("zzyzx qqxyq"))}
    fields = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), t.alias("terms"), F.lit(2 if k == "none" else 1).alias("fallback")) for k, t in wanted.items()])).alias("f")).select("doc_id", "f.*")
    return pages.assign_boxes(fields, layers, "doc_id")


QUERIES = {f.__name__: f for f in (documents_saved, field_boxes, save_pages, catalog_missing, newest_live, records_selected, failed_records)}

ORACLES = {
    "documents_saved": """
        with d as (select doc_id, lang = 'en' as en, string_split(text, chr(10)) as l, doc_id in (select doc_id from labels where toxic = 1) as toxic,
                          doc_id in (select doc_id from labels where quality = 1) as good from documents where text is not null)
        select doc_id, (case when toxic and good then 4 when toxic then 3 when en then 1 else 0 end)::bigint as seq, toxic and not good as is_deleted,
               (case when toxic and not good then 0 when en then len(l) - 1 else len(l) end)::bigint as n_lines,
               (case when toxic and not good then len(l) when en then 1 else 0 end)::bigint as n_gone,
               case when toxic and not good then null when en then list_max(list_transform(l[1:len(l) - 1], lambda x: md5('new ' || x))) else list_max(list_transform(l, lambda x: md5(x))) end as digest
        from d""",
    "field_boxes": """
        with d as (select doc_id, text, string_split(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' ') as w, string_split(text, chr(10)) as l from documents where text is not null),
        y as (select doc_id, unnest(range(0, len(l))) as layer, unnest(l) as text from d),
        p as (select doc_id, layer // 5 + 1 as page, lower(string_agg(text, ' ' order by layer)) as text from y group by all),
        f as (select doc_id, 'start' as field, 0 as i, left(text, 60) as term, 1 as fallback from d
              union all select doc_id, 'middle', 0, array_to_string(w[10:14], ' '), 1 from d union all select doc_id, 'middle', 1, array_to_string(w[20:20], ' '), 1 from d
              union all select doc_id, 'end', 0, array_to_string(list_reverse(w)[1:2], ' '), 1 from d union all select doc_id, 'none', 0, 'zzyzx qqxyq', 2 from d),
        t as (select doc_id, field, i, lower(trim(term)) as term, list_distinct(list_filter(string_split_regex(lower(trim(term)), '[ \\t\\n\\r]+'), lambda x: length(x) >= 3)) as words from f where length(trim(term)) >= 3),
        m as (select t.doc_id, field, i, page, contains(p.text, term) as held, len(list_filter(words, lambda x: contains(p.text, x))) as n, len(words) as many from t join p on t.doc_id = p.doc_id),
        r as (select doc_id, field, page, row_number() over (partition by doc_id, field order by held desc, case when held then 0 else -n end, i, page) as rank from m
              where held or (many > 0 and n >= greatest(1, many // 2))),
        k as (select doc_id, max(page) as last from p group by doc_id),
        c as (select f.doc_id, f.field, coalesce(r.page, case when any_value(fallback) <= any_value(last) then any_value(fallback) else 1 end) as page
              from f join k using (doc_id) left join r on r.doc_id = f.doc_id and r.field = f.field and rank = 1 group by f.doc_id, f.field, r.page),
        b as (select c.doc_id, c.field, layer % 3 * 10 + 0.5 as x, layer * 12.25 as y, length(y.text) * 5.5 as width
              from c join t on c.doc_id = t.doc_id and c.field = t.field join y on y.doc_id = c.doc_id and y.layer // 5 + 1 = c.page
              where y.text <> '' and (contains(lower(y.text), term) or contains(term, lower(y.text)) or len(list_filter(words, lambda x: contains(lower(y.text), x))) > 0))
        select doc_id, field, c.page::int as page, min(x)::double as x, min(y)::double as y, (max(x + width) - min(x))::double as width, (max(y + 10) - min(y))::double as height
        from c left join b using (doc_id, field) group by doc_id, field, c.page""",
    "save_pages": """
        with c as (select *, max(turn) over (partition by conv_id) as last, bool_or(contains(text, ',')) over (partition by conv_id) as again from conversations)
        select conv_id, count(*) filter (turn < last) as n_live, count(*) filter (turn = last) as n_retired, max(turn) filter (turn = last) as retired_turn
        from c where again group by conv_id""",
    "catalog_missing": """select distinct source, lang from documents d where source is not null and lang is not null
        and not exists (select 1 from documents e join labels l using (doc_id) where l.toxic = 1 and e.lang = 'en' and e.source = d.source and e.lang = d.lang)""",
    "newest_live": """select md5(text) as digest, max(doc_id) as doc_id, arg_max(n_chars, doc_id) as n_chars from documents left join labels using (doc_id) where coalesce(toxic, 0) <> 1 group by md5(text)""",
    "records_selected": "select doc_id, n_chars as score from documents left join labels using (doc_id) where coalesce(toxic, 0) <> 1 and lang ilike '%n%' and n_chars >= 500",
    "failed_records": r"""with p as (select string_split(url, '/')[-1] as file_name from pages where contains(url, '?'))
        select file_name, regexp_replace(file_name, '\.[^.]*$', '') as file_stem, 'failed' as status, 0 as n_skills, 'has a query' as error_message from p""",
}
