import pytest
from pyspark.sql import functions as F

from casemill.llm import url_filter

URLS = [
    ("http://A.Example.NET/en/x", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("https://b.net/", "b.net", "/", "net/", "block"),
    ("https://b.net", "b.net", "", None, None),
    ("http://notnet/", "notnet", "/", None, None),
    ("http://x.example.com/de/1?a=b", "x.example.com", "/de/1", "example.com/de/", "block"),
    ("http://badexample.com/de/1", "badexample.com", "/de/1", None, None),
    ("ftp://h.org/fr/#top", "h.org", "/fr/", "org/fr/", "allow"),
    ("http://h.org?x=/fr/", "h.org", "", None, None),
    ("no scheme.net/", "", "", None, None),
    (None, "", "", None, None),
    ("http://net/a://b", "net", "/a://b", "net/", "block"),
    ("http://ÄÖ.net/é", "ÄÖ.net", "/é", "net/", "block"),
]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "r") for i, u in enumerate(URLS)], "page_id int, url string, rule string")
    found = sorted(url_filter.judged(pages, trees=2, depth=2).collect(), key=lambda r: r.page_id)
    for row, (_, host, path, rule, verdict) in zip(found, URLS):
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == verdict or verdict is None and row.verdict == row.by_trees in ("allow", "block")


def test_entropy(spark):
    texts = ["aabb", "abcd", "aaaa", "é" * 3 + "x" * 3, "a", "a" * 2000 + "b" * 2000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, u string").orderBy("i")
    found = [r.e for r in df.select(url_filter._entropy(F.col("u")).alias("e")).collect()]
    assert found == pytest.approx([1, 2, 0, 1, 0, 1])


def test_trees_learn_the_labelled_urls(spark):
    hosts = ["cheap-win-99.net", "news.example.net", "spam-7.net", "b.example.com", "c.org"]
    paths = ["/en/", "/de/", "/fr/"]
    rows = [(i, f"http://h{i % 7}.{hosts[i % 5]}{paths[i % 3]}{i}") for i in range(400)]
    found = url_filter.judged(spark.createDataFrame(rows, "page_id int, url string")).where("rule is not null")
    wrong = found.where("verdict <> by_trees").count()
    assert wrong <= 0.05 * found.count()


def test_without_labels_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/")], "page_id int, url string")
    assert [r.verdict for r in url_filter.judged(pages).collect()] == ["allow", "allow"]
    assert url_filter.judged(pages.limit(0)).count() == 0
