r"""Secrets in texts, told from copied examples by corpus-wide ownership frequency.

Three kinds of base candidates (assignments, access keys, hexadecimal runs) are always reported. Beyond them, long runs of
letters, digits and `+/_=-` are candidates (kind `opaque`), each by the hash of its value. The corpus decides on them: by
hash, the distinct repositories and owners that hold it are counted. A value of many owners is an example that was copied;
one that belongs to a single owner, in few repositories, and looks live is reported as a secret too. Base candidates get the
same counts, so a user sees which of them are examples.

Looking live means: enough distinct characters, letters of both cases and digits, and no placeholder word.

Texts are scanned once, whole, and never move: what is written is spans and 128-bit hashes. The counts are three
aggregations, combined on the map side, so a value that a third of all documents hold is one row a partition; on the way
back such values are looked up without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.common import table, with_facts, written

#: Fixed values of the base kinds: pattern, the group whose length counts, its least length. A-Z and a-z alone are letters.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": (ASSIGN, 2, 8), "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]+", 0, 32)}

#: What else is a candidate, and when it looks live: least distinct characters, and words that make it a placeholder.
OPAQUE, LEAST_DISTINCT = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", 12
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "placeholder", "redacted", "xxxx", "your")

#: A value of more owners is a copied example, one of more repositories a shared constant of its owner.
MOST_OWNERS, MOST_REPOSITORIES = 1, 3

KINDS = (*BASE, "opaque")

# {32,} finds the runs that + finds and the least length keeps; assignments must be found before they are measured, as a
# match that is too short still covers its characters.
_PATTERNS = {"assign": re.compile(ASSIGN, re.ASCII), "access": re.compile(r"AKIA[A-Z0-9]{12,}"), "hex": re.compile(r"[0-9a-f]{32,}")}
_OPAQUE, _PLACEHOLDER = re.compile(OPAQUE), re.compile("|".join(PLACEHOLDERS), re.ASCII | re.IGNORECASE)

_HIT = pa.struct([("start", pa.int64()), ("order", pa.int32()), ("end", pa.int64()), ("digest", pa.binary()), ("live", pa.bool_())])


def looks_live(value: str) -> bool:
    mixed = any("a" <= c <= "z" for c in value) and any("A" <= c <= "Z" for c in value) and any("0" <= c <= "9" for c in value)
    return mixed and len(set(value)) >= LEAST_DISTINCT and not _PLACEHOLDER.search(value)


def hits(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, place of the kind in KINDS, end, value) of every candidate, by start; opaque ones overlap no base candidate."""
    text, found = text or "", []
    for order, (kind, pattern) in enumerate(_PATTERNS.items()):
        _, group, least = BASE[kind]
        found += [(m.start(), order, m.end(), m.group(group)) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    found.sort()
    base, at, reach = list(found), 0, 0
    for m in _OPAQUE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start():
            found.append((m.start(), len(BASE), m.end(), m.group()))
    return sorted(found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            [{"start": s, "order": o, "end": e, "digest": hashlib.sha256(v.encode()).digest()[:16], "live": looks_live(v)} for s, o, e, v in hits(t.as_py())]
            for t in batch.column("text")
        ]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "owner", "repository")), pa.array(rows, pa.list_(_HIT))], names=["id", "owner", "repository", "hits"])


def ownership(candidates: DataFrame) -> DataFrame:
    """digest, owners, repositories and n, the rows that hold it. A null owner or repository counts as one of its own."""
    by_repository = candidates.groupBy("digest", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("digest", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))


def secrets(docs: DataFrame, id_: str = "doc_id", owner: Sequence[str] = ("source",), repository: Sequence[str] = ("source", "lang")) -> DataFrame:
    """doc_id (or id_) and spans, one row for each row of docs.

    spans is an array, by start and then kind, of structs: start, order (place in KINDS), end (code points, exclusive),
    owners and repositories (how many hold the value), live (whether it looks so), reported (base candidates, and opaque
    ones that are live and of one owner). owner and repository name the columns that tell them; a repository belongs to
    its owner. Null and empty texts have no spans. Repeated rows are rows of their own; other columns are ignored.
    """
    key = lambda names: F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    rows = docs.select(F.col(id_).alias("id"), key(owner).alias("owner"), key(repository).alias("repository"), "text")
    kind = docs.schema[id_].dataType.simpleString()
    found = rows.mapInArrow(_scan, f"id {kind}, owner string, repository string, hits array<struct<start:long,order:int,end:long,digest:binary,live:boolean>>")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "secret-hits")
    candidates = found.select("row", "id", "owner", "repository", F.explode("hits").alias("hit")).select("row", "id", "owner", "repository", "hit.*")
    facts = written(ownership(candidates), "secret-owners")
    known = with_facts(candidates.drop("owner", "repository"), facts, "digest", "n")
    owned = F.col("live") & (F.col("owners") <= MOST_OWNERS) & (F.col("repositories") <= MOST_REPOSITORIES)
    span = F.struct("start", "order", "end", "owners", "repositories", "live", ((F.col("order") < len(BASE)) | owned).alias("reported"))
    some = known.groupBy("row", "id").agg(F.sort_array(F.collect_list(span)).alias("spans")).select("id", "spans")
    none = found.filter(F.size("hits") == 0).select("id", F.array().cast(some.schema["spans"].dataType).alias("spans"))
    return some.unionByName(none).withColumnRenamed("id", id_)


def written_spans(spans: Column) -> Column:
    """`kind:start:end` of the spans, joined by commas."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["order"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    of_kind = lambda i: F.size(F.filter("spans", lambda s: s["order"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{kind}") for i, kind in enumerate(BASE)]
    reported = F.filter("spans", lambda s: s["reported"])
    return found.select(
        "doc_id", *counts, F.sha2(written_spans(base), 256).alias("base_sha256"), written_spans(reported).alias("spans"),
        F.size(F.filter(reported, lambda s: s["order"] == len(BASE))).cast("long").alias("n_owned"),
        F.size(F.filter(base, lambda s: s["owners"] > MOST_OWNERS)).cast("long").alias("n_copied"),
    )


QUERIES = {"op13_secret_scan": op13_secret_scan}

#: Spans by what lies between matches. RE2 folds case beyond A-Z, so the letters of the names are classes of their own.
_NAME = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_SQL = {
    "assign": rf"""(?:{_NAME})[""'']?\x20*[:=]\x20*[""'']?[A-Za-z0-9+/_.=-]+""".replace('""', '"'),
    "access": "AKIA[A-Z0-9]{12,}",
    "hex": "[0-9a-f]{32,}",
}
_VALUE = rf"""^(?:{_NAME})[""'']?\x20*[:=]\x20*[""'']?([A-Za-z0-9+/_.=-]+)$""".replace('""', '"')


def _found(order: int, kind: str) -> str:
    return rf"""
        select rid, {order} as kind, i, m[i] as match, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint as start
        from (select rid, m, p, unnest(range(1, len(m) + 1)) as i
              from (select rid, regexp_extract_all(text, '{_SQL[kind]}') as m, string_split_regex(text, '{_SQL[kind]}') as p from d) where len(m) > 0)"""


ORACLES = {
    "op13_secret_scan": rf"""
        with d as (select row_number() over () as rid, doc_id, source, lang, coalesce(text, '') as text from documents),
        f as ({" union all ".join(_found(i, k) for i, k in enumerate(_SQL))}),
        b as (select rid, kind, start, start + length(match) as ends,
                     case kind when 0 then regexp_extract(match, '{_VALUE}', 1) else match end as value from f),
        base as (select * from b where kind > 0 or length(value) >= 8),
        w as (select rid, i, m[i] as match, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint as start
              from (select rid, m, p, unnest(range(1, len(m) + 1)) as i
                    from (select rid, regexp_extract_all(text, '[A-Za-z0-9+/_=-]+') as m, string_split_regex(text, '[A-Za-z0-9+/_=-]+') as p from d))),
        o as (select rid, start, start + length(match) as ends, match as value from w
              where length(match) >= 20 and not exists (select 1 from base where base.rid = w.rid and base.start < w.start + length(w.match) and base.ends > w.start)),
        c as (select rid, kind, start, ends, value from base union all select rid, 3, start, ends, value from o),
        n as (select value, count(distinct coalesce(source, '<null>')) as owners, count(distinct coalesce(source, '<null>') || '/' || coalesce(lang, '<null>')) as repositories
              from c join d using (rid) group by value),
        k as (select c.*, owners, kind < 3 or (owners <= {MOST_OWNERS} and repositories <= {MOST_REPOSITORIES} and regexp_matches(value, '[a-z]') and regexp_matches(value, '[A-Z]')
                     and regexp_matches(value, '[0-9]') and len(list_distinct(string_split(value, ''))) >= {LEAST_DISTINCT} and not regexp_matches(value, '(?i){"|".join(PLACEHOLDERS)}')) as reported,
                     ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || start || ':' || ends as name
              from c join n using (value)),
        t as (select rid, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
                     string_agg(name, ',' order by start, kind) filter (kind < 3) as base, string_agg(name, ',' order by start, kind) filter (reported) as spans,
                     count(*) filter (kind = 3 and reported) as n_owned, count(*) filter (kind < 3 and owners > {MOST_OWNERS}) as n_copied
              from k group by rid)
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
               coalesce(spans, '') as spans, coalesce(n_owned, 0) as n_owned, coalesce(n_copied, 0) as n_copied
        from d left join t using (rid)""",
}
