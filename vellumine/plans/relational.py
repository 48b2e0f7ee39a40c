"""Listing, search, details, lifecycle and validation over the driver's tables.

nation stands for projects, customer for documents, orders for their extractions, events for attribute values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import intervals, store
from vellumine.sources.tables import table

EVENT_FIELDS = ("view", "click", "purchase", "signup", "error", "login")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their project, their latest extraction, and its attributes as columns."""
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    latest = store.latest_by(orders, ["o_custkey"], ["o_orderkey"])
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_quantity").alias("l_at"), "l_returnflag", "l_quantity")
    wide = store.pivot_fields(lines, "l_orderkey", "l_returnflag", "l_quantity", ("A", "N", "R"), "l_at")
    joined = customers.join(nations, customers.c_nationkey == nations.n_nationkey).join(latest, customers.c_custkey == latest.o_custkey, "left")
    return joined.join(wide, joined.o_orderkey == wide.l_orderkey, "left").select(
        F.col("c_custkey").alias("document_id"), F.col("c_name").alias("file_name"), F.col("n_name").alias("project"),
        F.col("o_orderkey").alias("extraction_id"), F.coalesce("o_orderstatus", F.lit("Active")).alias("status"), F.col("o_totalprice").alias("score"),
        F.col("A").alias("field_a"), F.col("N").alias("field_n"), F.col("R").alias("field_r"),
    )


def list_latest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 2 of the documents, newest first, with project, latest extraction and attributes: keys first, so that orders and
    lines are read for the page's 50 documents alone."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("project"))
    keys = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("file_name"), "project")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("extraction_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("score"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("extraction_id"), F.struct("l_linenumber", "l_quantity").alias("_at"), "l_returnflag", "l_quantity")
    out = store.wide_page(keys, "document_id", [F.desc("document_id")], 50, 2, orders, ["extraction_id"], lines, "extraction_id", "l_returnflag", "l_quantity", ("A", "N", "R"))
    return out.withColumn("status", F.coalesce("status", F.lit("Active")))


def _profiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, two extractions of each, and their attributes: a first line as full_name, a JSON array of words as skills.
    The older extraction knows only the first of the skills, so a search that took it would find other documents."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "source", "lang", "text")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)))
    both = docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("version"), F.substring_index("text", "\n", 1).alias("name"), words.alias("w"), "lang")
    both = both.withColumn("extraction_id", F.col("doc_id") * 2 + F.col("version"))
    skills = F.to_json(F.when(F.col("version") == 1, F.col("w")).otherwise(F.slice("w", 1, 1)))
    values = both.select("extraction_id", F.explode(F.map_from_arrays(F.array(F.lit("full_name"), F.lit("skills"), F.lit("lang")), F.array("name", skills, "lang"))).alias("field", "value"))
    return docs.select("doc_id", "source"), both.select("doc_id", "extraction_id", "version"), values.withColumn("_at", F.lit(1))


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search of text and skills: the page 2 of 20 live documents, newest first, of those whose source or name holds `rc1`
    in any case and whose latest skills hold both words. Keys first; names, skills and languages of the page alone are made."""
    docs, versions, values = _profiles(spark, sf_dir)
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    docs = docs.join(toxic, "doc_id", "left_anti")
    keys = store.search_keys(docs, "doc_id", versions, "extraction_id", values, "source", ("full_name",), "rc1", "skills", ("the", "of"))
    page = store.wide_page(keys, "doc_id", [F.desc("doc_id")], 20, 2, versions, ["extraction_id"], values, "extraction_id", "field", "value", ("full_name", "skills", "lang"))
    return page.select("doc_id", "source", "extraction_id", F.col("field_full_name").alias("full_name"), F.size(F.from_json("field_skills", "array<string>")).alias("n_skills"), F.col("field_lang").alias("lang"))


def list_filtered_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and pages of the list under filters, which act before any limit; a null score counts as 0."""
    wanted = store.all_of([F.col("status").isin("O", "Active"), F.coalesce("score", F.lit(0.0)) >= 0.0, F.contains(F.lower("project"), F.lit("a"))])
    return _listed(spark, sf_dir).filter(wanted).agg(F.count("*").alias("total")).select("total", store.total_pages(F.col("total"), 50).alias("total_pages"))


def search_text_or_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose source contains a string (wildcards in it are literal) or that a label marks as toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct().withColumn("_hit", F.lit(True))
    return docs.join(toxic, "doc_id", "left").filter(F.expr("source ilike '%c1!_%' escape '!' or source ilike '%RC1%'") | F.col("_hit").isNotNull()).select("doc_id", "source")


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("kinds"))


def search_skills_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(F.lit("click"), F.lit("purchase"))
    return _kinds(spark, sf_dir).filter(F.forall(wanted, lambda s: F.array_contains("kinds", s))).select("user_id", F.array_join("kinds", ",").alias("kinds"))


def search_skills_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any of the terms, whatever their case."""
    return _kinds(spark, sf_dir).filter(F.exists("kinds", lambda k: F.lower(k).isin("signup", "error"))).select("user_id", F.array_join("kinds", ",").alias("kinds"))


def detail_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of each record as columns: the newest value of each field, null where it has none."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return store.pivot_fields(events, "user_id", "event_type", "value", EVENT_FIELDS, "event_id")


def field_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store as an append-only log: the latest value of each (record, field) wins."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return store.latest_by(events, ["user_id", "event_type"], ["event_id"])


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return customers, [(orders, "o_custkey", "o_orderkey", "c_custkey"), (lines, "l_orderkey", "l_orderkey", "o_orderkey")]


def _counts(parts: list[DataFrame], kept: Column, name: str) -> DataFrame:
    out = None
    for level, df in zip(("document", "extraction", "value"), parts, strict=True):
        one = df.agg(F.count("*").alias("total"), F.count_if(kept).alias(name)).select(F.lit(level).alias("level"), "total", name)
        out = one if out is None else out.unionByName(one)
    return out


def soft_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, chain = _chain(spark, sf_dir)
    return _counts(store.cascade(customers, chain, F.col("c_mktsegment") == "BUILDING", "c_custkey"), ~F.col("hit"), "live")


def hard_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after deletion: anti joins down the chain of foreign keys."""
    customers, chain = _chain(spark, sf_dir)
    left = [customers.filter("c_custkey % 10 <> 0")]
    for child, foreign, _, key in chain:
        left.append(child.join(left[-1].select(F.col(key).alias("_key")).distinct(), child[foreign] == F.col("_key"), "left_semi"))
    return _counts(left, F.lit(True), "left")


def restore_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted and restored again: what another deletion took stays deleted."""
    customers, chain = _chain(spark, sf_dir)
    building, tenth = F.col("c_mktsegment") == "BUILDING", F.col("c_custkey") % 10 == 0
    return _counts(store.cascade(customers, chain, (building | tenth) & ~building, "c_custkey"), ~F.col("hit"), "live")


def upsert_name_or_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth document as a batch against the others: updated if its source and language or its text is stored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("name"), F.md5("text").alias("hash"))
    batch, stored = docs.filter("doc_id % 4 = 0"), docs.filter("doc_id % 4 <> 0")
    matched = store.match_name_or_hash(batch, stored, "name", "hash", "doc_id")
    return matched.select("doc_id", "matched_id", F.when(F.col("matched_id").isNull(), "created").otherwise("updated").alias("action"))


def validate_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of keys, references and value domains, one row for each check."""
    orders, lines, customers = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    count = lambda name, df: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
    checks = [
        count("orders key is unique", store.duplicates(orders, ["o_orderkey"])),
        count("line key is unique", store.duplicates(lines, ["l_orderkey", "l_linenumber"])),
        count("order has a customer", store.orphans(orders, "o_custkey", customers, "c_custkey")),
        count("line has an order", store.orphans(lines, "l_orderkey", orders, "o_orderkey")),
        count("status is known", orders.filter(~F.col("o_orderstatus").isin("F", "O"))),
        count("quantity is at most 40", lines.filter("l_quantity > 40")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a batch and one list of its sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    status = F.when(F.col("n_chars") >= 500, "success").when(F.col("n_chars") >= 100, "partial").otherwise("failed")
    return docs.withColumn("status", status).groupBy("source").agg(
        F.count("*").alias("total_found"), F.count_if(F.col("status").isin("success", "partial")).alias("total_success"),
        F.count_if(F.col("status") == "failed").alias("total_failed"), F.round(F.sum("n_chars") / 1024, 2).alias("size_kb"),
    )


def manifest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory of sources against extractions, by document: in both, not extracted, or without a source."""
    source, done = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id").distinct()
    both = source.withColumn("s", F.lit(1)).join(done.withColumn("d", F.lit(1)), "doc_id", "full_outer")
    state = F.when(F.col("d").isNull(), "pending").when(F.col("s").isNull(), "source missing").otherwise("extracted")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def total_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of each user's intervals (hours from the event, as long as its value says), in hours and in words."""
    start = F.floor(F.unix_timestamp("ts") / 3600).cast("long")
    spans = table(spark, sf_dir, "events").select("user_id", start.alias("a"), (start + F.floor(F.abs("value") / 10).cast("long") + 1).alias("b"))
    return intervals.union_length(spans, ["user_id"], "a", "b").select("user_id", "covered", intervals.months_text(F.col("covered")).alias("text"))


def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three entries of each record as `flag at part (quantity)`, joined by bars; no sort beyond a record."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_quantity")
    entry = F.concat("l_returnflag", F.lit(" at "), F.col("l_partkey").cast("string"), F.lit(" ("), F.col("l_quantity").cast("int").cast("string"), F.lit(")"))
    rows = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", entry.alias("entry")))).alias("x"))
    return rows.select("l_orderkey", F.array_join(F.transform(F.slice("x", 1, 3), lambda x: x["entry"]), " | ").alias("summary"))


def embedding_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norm, and the first and last component of each vector at unit length, to six places; a zero vector stays."""
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = lambda i: F.round(F.element_at(v, i) / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0), 5)
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", norm.alias("norm")).select("vec_id", F.round("norm", 5).alias("norm"), unit(1).alias("head"), unit(-1).alias("tail"))


def embedding_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label, component by component, to five places."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("component", "x"))
    return rows.groupBy("label", "component").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    boxes = lines.select("l_orderkey", F.col("l_linenumber").cast("double").alias("x"), F.col("l_quantity").alias("y"), (F.col("l_discount") * 100).alias("width"), (F.col("l_tax") * 100).alias("height"))
    return intervals.box_union(boxes, ["l_orderkey"])


def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each page in order, as one text."""
    turns = table(spark, sf_dir, "conversations")
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return rows.select("conv_id", F.size("x").cast("long").alias("layers"), F.array_join(F.transform("x", lambda t: F.concat(t["turn"].cast("string"), F.lit(":"), t["role"])), ",").alias("layout"))


def notes_prepend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new note in front of each record's notes, newest first; an older note of the same text goes."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    notes = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role")), asc=False).alias("x"))
    kept = F.filter(F.transform("x", lambda n: n["role"]), lambda t: t != "system")
    return notes.select("conv_id", F.array_join(F.concat(F.array(F.lit("system")), kept), "|").alias("notes"))


QUERIES = {
    f.__name__: f
    for f in (
        list_latest_page, search_documents, list_filtered_total, search_text_or_exists, search_skills_all, search_skills_any, detail_wide, field_upsert_latest, soft_delete_cascade, hard_delete_cascade,
        restore_cascade, upsert_name_or_hash, validate_constraints, manifest_summary, manifest_status, total_experience, profile_summary, embedding_l2, embedding_mean_pool, bbox_union, page_layout, notes_prepend,
    )
}

_LISTED = """
  latest as (select o_custkey, max_by(o_orderkey, o_orderkey) as o_orderkey, max_by(o_orderstatus, o_orderkey) as o_orderstatus, max_by(o_totalprice, o_orderkey) as o_totalprice from orders group by o_custkey),
  wide as (select l_orderkey, max_by(l_quantity, {'n': l_linenumber, 'q': l_quantity}) filter (l_returnflag = 'A') as a, max_by(l_quantity, {'n': l_linenumber, 'q': l_quantity}) filter (l_returnflag = 'N') as n, max_by(l_quantity, {'n': l_linenumber, 'q': l_quantity}) filter (l_returnflag = 'R') as r
           from lineitem group by l_orderkey),
  listed as (select c_custkey as document_id, c_name as file_name, n_name as project, o_orderkey as extraction_id, coalesce(o_orderstatus, 'Active') as status, o_totalprice as score, a as field_a, n as field_n, r as field_r
             from customer join nation on c_nationkey = n_nationkey left join latest on o_custkey = c_custkey left join wide on l_orderkey = o_orderkey)"""

_CASCADE = """
  with c as (select c_custkey, {hit} as hit from customer),
  o as (select o_orderkey, coalesce(c.hit, false) as hit from orders left join c on o_custkey = c_custkey),
  l as (select coalesce(o.hit, false) as hit from lineitem left join o on l_orderkey = o_orderkey)
  select 'document' as level, count(*) as total, count(*) filter (not hit) as live from c
  union all select 'extraction', count(*), count(*) filter (not hit) from o union all select 'value', count(*), count(*) filter (not hit) from l"""

_KINDS = "select user_id, array_to_string(kinds, ',') as kinds from (select user_id, list_sort(list(distinct event_type)) as kinds from events group by user_id)"

ORACLES = {
    "search_documents": r"""
        with d as (select doc_id, source, lang, text, list_distinct(regexp_extract_all(lower(text), '[\p{L}]+')) as w from documents
                   where text is not null and doc_id not in (select doc_id from labels where toxic = 1)),
        f as (select * from d where (contains(lower(source), 'rc1') or contains(lower(string_split(text, chr(10))[1]), 'rc1')) and list_contains(w, 'the') and list_contains(w, 'of')
              order by doc_id desc limit 20 offset 20)
        select doc_id, source, doc_id * 2 + 1 as extraction_id, string_split(text, chr(10))[1] as full_name, len(w)::int as n_skills, lang from f""",
    "list_latest_page": f"with {_LISTED} select * from listed order by document_id desc limit 50 offset 50",
    "list_filtered_total": f"with {_LISTED}, t as (select count(*) as total from listed where status in ('O', 'Active') and coalesce(score, 0) >= 0 and contains(lower(project), 'a')) select total, ceil(total / 50.0)::bigint as total_pages from t",
    "search_text_or_exists": "select doc_id, source from documents d where source ilike '%c1!_%' escape '!' or source ilike '%RC1%' or exists (select 1 from labels l where l.doc_id = d.doc_id and toxic = 1)",
    "search_skills_all": f"{_KINDS} where list_has_all(kinds, ['click', 'purchase'])",
    "search_skills_any": f"{_KINDS} where list_has_any(list_transform(kinds, lambda k: lower(k)), ['signup', 'error'])",
    "detail_wide": "select user_id, " + ", ".join(f"max_by(value, event_id) filter (event_type = '{f}') as \"{f}\"" for f in EVENT_FIELDS) + " from events where event_type in (" + ", ".join(f"'{f}'" for f in EVENT_FIELDS) + ") group by user_id",
    "field_upsert_latest": "select user_id, event_type, max_by(value, event_id) as value, max(event_id) as event_id from events group by user_id, event_type",
    "soft_delete_cascade": _CASCADE.format(hit="c_mktsegment = 'BUILDING'"),
    "restore_cascade": _CASCADE.format(hit="c_custkey % 10 = 0 and c_mktsegment <> 'BUILDING'"),
    "hard_delete_cascade": """
        with c as (select * from customer where c_custkey % 10 <> 0), o as (select * from orders where o_custkey in (select c_custkey from c)), l as (select * from lineitem where l_orderkey in (select o_orderkey from o))
        select 'document' as level, count(*) as total, count(*) as "left" from c union all select 'extraction', count(*), count(*) from o union all select 'value', count(*), count(*) from l""",
    "upsert_name_or_hash": """
        with d as (select doc_id, source || '/' || lang as name, md5(text) as hash from documents),
        s as (select * from d where doc_id % 4 <> 0),
        n as (select name, max(doc_id) as id from s group by name), h as (select hash, max(doc_id) as id from s group by hash),
        m as (select d.doc_id, greatest(n.id, h.id) as matched_id from d left join n on n.name = d.name left join h on h.hash = d.hash where d.doc_id % 4 = 0)
        select doc_id, matched_id, case when matched_id is null then 'created' else 'updated' end as action from m""",
    "validate_constraints": """
        select 'orders key is unique' as "check", count(*) as violations from (select o_orderkey from orders group by 1 having count(*) > 1)
        union all select 'line key is unique', count(*) from (select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(*) > 1)
        union all select 'order has a customer', count(*) from orders where o_custkey not in (select c_custkey from customer)
        union all select 'line has an order', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)
        union all select 'status is known', count(*) from orders where o_orderstatus not in ('F', 'O')
        union all select 'quantity is at most 40', count(*) from lineitem where l_quantity > 40""",
    "manifest_summary": "select source, count(*) as total_found, count(*) filter (n_chars >= 100) as total_success, count(*) filter (n_chars < 100) as total_failed, round(sum(n_chars) / 1024.0, 2)::double as size_kb from documents group by source",
    "manifest_status": """
        with s as (select doc_id from documents), d as (select distinct doc_id from labels)
        select case when d.doc_id is null then 'pending' when s.doc_id is null then 'source missing' else 'extracted' end as state, count(*) as n from s full join d on s.doc_id = d.doc_id group by 1""",
    "total_experience": """
        with e as (select user_id, floor(epoch(ts) / 3600)::bigint as a, floor(epoch(ts) / 3600)::bigint + floor(abs(value) / 10)::bigint + 1 as b from events),
        r as (select *, max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) as reach from e),
        i as (select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by user_id order by a, b rows unbounded preceding) as island from r),
        c as (select user_id, sum(span)::bigint as covered from (select user_id, island, max(b) - min(a) as span from i group by 1, 2) group by 1)
        select user_id, covered, case when covered < 12 then covered || ' Months' when covered % 12 >= 2 then (covered // 12) || 'y ' || (covered % 12) || 'm' else (covered // 12) || ' Years' end as text from c""",
    "profile_summary": """
        select l_orderkey, array_to_string(list_slice(list(l_returnflag || ' at ' || l_partkey || ' (' || l_quantity::int || ')' order by l_linenumber, l_returnflag || ' at ' || l_partkey || ' (' || l_quantity::int || ')'), 1, 3), ' | ') as summary
        from lineitem group by l_orderkey""",
    "embedding_l2": """
        with v as (select vec_id, embedding::double[] as e from embeddings), n as (select *, sqrt(list_sum(list_transform(e, lambda x: x * x))) as s from v)
        select vec_id, round(s, 5) as norm, round(e[1] / case when s > 0 then s else 1 end, 5) as head, round(e[-1] / case when s > 0 then s else 1 end, 5) as tail from n""",
    "embedding_mean_pool": "select label, pos as component, round(avg(x::double), 5) as mean from (select label, unnest(embedding) as x, (generate_subscripts(embedding, 1) - 1)::int as pos from embeddings) group by label, pos",
    "bbox_union": """
        select l_orderkey, round(min(l_linenumber)::double, 2) as x, round(min(l_quantity), 2) as y,
               round(greatest(max(l_linenumber + l_discount * 100) - min(l_linenumber), 0), 2) as width, round(greatest(max(l_quantity + l_tax * 100) - min(l_quantity), 0), 2) as height
        from lineitem group by l_orderkey""",
    "page_layout": "select conv_id, count(*) as layers, string_agg(turn || ':' || role, ',' order by turn, role) as layout from conversations group by conv_id",
    "notes_prepend": "select conv_id, array_to_string(list_prepend('system', list_filter(list(role order by turn desc, role desc), lambda r: r <> 'system')), '|') as notes from conversations group by conv_id",
}
