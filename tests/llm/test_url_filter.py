import re

import pytest

from postloom.llm import url_filter as U
from postloom.llm.queries_urls import RULES
from postloom.llm.url_filter import bloom_filter, maybe_listed, repeated_urls, url_filter

URLS = [
    "https://a.org/x", "http://EXAMPLE.org/es/1?q", "http://sub.example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/", "http://org/", "http://org",
    "http://x.com/fr/1", "http://x.com/de/1#a", "http://com/de/", "http://x.com/frx", "http://x.net/a.html", "http://www.x.net/a/", "http://m.x.net/a?b=c", "https://x.net/a/index.html",
    "http://y.net/only", "http://y.net", "ftp://y.net#x", "no scheme", "", None, "://", "http://É.org/é?x", "a://b://c/d", "http://z.net/%41", "http://h.com:80/de/x", "x.org://net/y",
]


def parts(u):
    if not u or "://" not in u:
        return "", ""
    rest = u[u.index("://") + 3 :]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def key(host, path):
    return re.sub(r"^(www|m)\.", "", host) + re.sub("/+$", "", re.sub(r"(/index)?\.html?$", "", path))


def brute(urls, listed):
    out = []
    for i, u in enumerate(urls):
        host, path = parts(u)
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        verdict = best.verdict if best else "block" if host and key(host, path) in listed else "allow"
        out.append((i, host, path, best and best.host + best.path, verdict))
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", [1, 1 << 16])
def test_against_brute_force(spark, rows_of, monkeypatch, blocks):
    monkeypatch.setattr(U, "MAX_BLOCKS", blocks)  # one block: nearly all are possible hits, the result stays
    urls = URLS + [f"http://h{k % 50}.net/p{k % 7}" for k in range(400)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    keys = [key(*parts(u)) for u in urls if parts(u)[0]]
    listed = {k for k in keys if keys.count(k) > 1}
    table = repeated_urls(df)
    assert {r.url_key for r in table.collect()} == listed
    assert rows_of(url_filter(df, RULES, table).drop("possible_hit")) == brute(urls, listed)


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    from pyspark.sql import functions as F

    listed = spark.range(20000).select(F.concat(F.lit("in"), "id").alias("url_key")).cache()
    bloom = bloom_filter(listed)
    n = U._n_blocks(listed)
    ask = listed.withColumn("on", F.lit(1)).union(spark.range(20000).select(F.concat(F.lit("out"), "id"), F.lit(0)))
    got = ask.withColumn("block", U._block(F.col("url_key"), n)).join(bloom, "block", "left").groupBy("on").agg(
        F.avg(F.coalesce(maybe_listed(F.col("url_key"), F.col("words")), F.lit(False)).cast("int")).alias("hits"))
    share = {r.on: r.hits for r in got.collect()}
    assert share[1] == 1.0 and share[0] < 0.02


def test_edges(spark, rows_of):
    rows = [(1, "http://x.net/a", "b"), (1, "http://x.net/a", "b"), (None, "http://x.net/b", None), (2, None, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, block string")
    empty = repeated_urls(df).limit(0)
    assert rows_of(url_filter(df, RULES, empty).select("page_id", "verdict")) == sorted([(1, "allow")] * 2 + [(None, "allow"), (2, "allow")], key=repr)
    assert rows_of(url_filter(df, [], repeated_urls(df)).select("page_id", "verdict")) == sorted([(1, "block")] * 2 + [(None, "allow"), (2, "allow")], key=repr)
    assert rows_of(url_filter(df.limit(0), RULES, empty)) == []
