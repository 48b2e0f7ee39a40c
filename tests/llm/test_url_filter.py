import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumine.llm import url_filter as u

URLS = [
    "http://a.example.net/en/x?q", "https://EXAMPLE.net/de/", "http://b.org/fr/1#t", "http://b.org/fr", "http://x.com", "ftp://net/", "http://net", None, "", "no scheme/net/",
    "http://sub.example.com/de/", "http://sub.example.com/dex", "http://example.com?x=/de/", "http://m.spam-farm.example.org/en/1", "://a.net/", "http://a.net:80/", "http://xnet/", "http://.net/x", "a://b://c.net/",
]


def brute(url, rules, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k]), rest[k:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    under = lambda h: host == h or host.endswith("." + h)
    fits = [(len(r), r, v) for r, v in rules if under(r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if any(under(h) for h in listed) else "allow"


@pytest.mark.parametrize("bound", [u.MAX_BYTES, 0])
def test_judges_like_brute_force_by_filters_and_by_join(spark, bound):
    rows = [(i, x, "old") for i, x in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, VERDICT string")
    listed = spark.createDataFrame([(h,) for h in u.LISTED], "host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in u.judge(pages, u.RULES, listed, max_bytes=bound).collect()}
    assert got == {i: brute(x, u.RULES, u.LISTED) for i, x, _ in rows}


def test_hosts_of_very_many_labels(spark):
    rows = [(0, "http://" + "a." * 20_000 + "example.net/en/1"), (1, "http://" + "b." * 20_000 + u.LISTED[0] + "/"), (2, "http://" + "c." * 20_000 + "d/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = spark.createDataFrame([(h,) for h in u.LISTED], "host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in u.judge(pages, u.RULES, listed).collect()}
    assert got == {i: brute(x, u.RULES, u.LISTED) for i, x in rows}


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert u.judge(pages).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(6000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit("b")).alias("h2"), (F.col("id") % 40 == 0).alias("on"))
    rows = keys.toPandas()
    cascade = u.build_cascade(keys, "on")
    assert len(cascade.levels) > 1
    has = cascade.has(rows["h1"].to_numpy().view(np.uint64), rows["h2"].to_numpy().view(np.uint64))
    assert (has == rows["on"].to_numpy()).all()
    assert cascade.bytes < 6000
    with pytest.raises(u.TooLarge):
        u.build_cascade(keys, "on", max_bytes=8)
