from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from foliant.llm.urls import ORACLES, QUERIES, RULES, filter_urls, fit_urls, lexical_features, op1_url_filters, parsed, seed_labels

URLS = [
    None, "", "no scheme", "http://", "https://WWW.Example.COM/en/7?x=1#y", "http://example.com/en/12", "http://badexample.com/en/7", "http://a.example.net/de/8", "http://net/de/8",
    "http://example.org/es/1", "http://example.org/fr/1", "ftp://x.y?q=http://z.com/en/", "http://h#frag/en/", "http://ÉX.com/en/é", "http://h.com:80/en/", "a://b://c.com/en/x", "http://x.com\n/en/",
    "http://" + "a" * 50_000 + ".com/en/" + "1/" * 20_000,
]


def split(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[1]), default=(None, None))


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "h", "p", 1.0) for i, u in enumerate(urls)], "page_id int, url string, host string, path string, entropy double")


@pytest.fixture(scope="module")
def model(spark):
    good = [(f"http://site{i % 30}.example.com/en/{i}", 0) for i in range(300)]
    bad = [(f"http://m.casino-win{i % 3}.example.org/en/{i}?a=1&b=2", 1) for i in range(60)]
    return fit_urls(spark.createDataFrame(good + bad + [(None, 0), ("x", None)], "url string, label int"))


def test_rules_and_parts(spark, model):
    found = filter_urls(frame(spark, URLS), "url", RULES, model, "page_id", "host", "path").toDF("page_id", "h0", "p0", "host", "path", "rule", "verdict", "score").orderBy("page_id").collect()
    assert len(found) == len(URLS)
    for row, url in zip(found, URLS):
        host, path = split(url)
        verdict, name = rule(host, path)
        assert (row["host"], row["path"], row["rule"]) == (host, path, name)
        assert row["verdict"] == (verdict or ("block" if row["score"] >= 0.5 else "allow"))


def test_trees_tell_hosts_apart(spark, model):
    urls = ["http://site7.example.com/fr/9", "http://m.casino-win1.example.org/fr/77?a=1&b=2"]
    scores = [r["score"] for r in filter_urls(frame(spark, urls), "url", (), model, "page_id").orderBy("page_id").collect()]
    assert scores[0] < 0.5 <= scores[1]


def test_accuracy_on_urls_and_hosts_that_were_held_out(spark, small):
    pages = spark.read.parquet(small.replace("sf0.001", "sf0.1") + "/pages.parquet")
    labelled = parsed(pages, "url").select("url", "host", seed_labels().alias("label"))
    for key, least in (("url", 0.99), ("host", 0.95)):
        part = F.pmod(F.xxhash64(key), F.lit(4))
        model = fit_urls(labelled.where(part != 0))
        held = labelled.where(part == 0)
        judged = filter_urls(held, "url", (), model, "label").select("label", (F.col("score") >= 0.5).cast("int").alias("found")).collect()
        right = sum(r["label"] == r["found"] for r in judged) / len(judged)
        assert right >= least, (key, right, len(judged), sum(r["label"] for r in judged))


def test_rules_equal_their_sql(spark, small):
    import duckdb

    connection = duckdb.connect()
    connection.execute(f"create view pages as select * from '{small}/pages.parquet'")
    found = sorted(map(tuple, QUERIES["url_rules"](spark, small).collect()))
    assert found == sorted(connection.execute(ORACLES["url_rules"]).fetchall())


def test_features(spark):
    own = lexical_features(parsed(frame(spark, ["http://a-b.c.com/x/1?p=1&q=2", ""]), "url", "page_id")).orderBy("kept.page_id").collect()
    url = "http://a-b.c.com/x/1?p=1&q=2"
    shares = [url.count(c) / len(url) for c in set(url)]
    assert own[0]["entropy"] == pytest.approx(-sum(p * math.log2(p) for p in shares))
    assert (own[0]["host_depth"], own[0]["path_depth"], own[0]["parameters"], own[0]["hyphens"]) == (2, 2, 2, 1)
    assert own[0]["digit_ratio"] == pytest.approx(3 / len(url)) and own[1]["entropy"] == 0


def test_without_labels_all_is_allowed(spark):
    model = fit_urls(spark.createDataFrame([], "url string, label int"))
    assert {r["verdict"] for r in filter_urls(frame(spark, ["http://a.fr/x"]), "url", RULES, model, "page_id").collect()} == {"allow"}
    assert filter_urls(frame(spark, ["x"]).limit(0), "url", RULES, model, "page_id").isEmpty()


def test_repeated_urls_do_not_crowd_out_the_others(spark):
    columns = "url string, label int"
    plain = [(f"http://host{i}.example.{'com' if i % 2 else 'net'}/p/{i}", i % 2) for i in range(60)]
    first = spark.createDataFrame(plain, columns).orderBy(F.xxhash64("url")).first()
    hot = plain + [(first["url"], first["label"])] * 500
    one, other = (fit_urls(spark.createDataFrame(rows, columns), most=40) for rows in (plain, hot))
    assert one.base == other.base
    assert sorted(map(tuple, one.statistics.collect())) == sorted(map(tuple, other.statistics.collect()))


def test_no_python_in_the_plan(spark, small):
    frame = op1_url_filters(spark, small)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert frame.count() == spark.read.parquet(f"{small}/pages.parquet").count()
    hosts = parsed(spark.read.parquet(f"{small}/pages.parquet"), "url")
    assert hosts.select(F.sum(seed_labels())).first()[0] > 0
