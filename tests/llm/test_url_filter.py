import pytest

from flowmill.llm import url_filter
from flowmill.llm.queries import OP7_SQL, URL_RULES, op7_url_filter
from tests.oracle import compare

URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/x", "http://example.com", "http://example.com/", "http://example.com/en", "http://example.com/en/", "http://www.Example.COM/en/1?q=/es/", "http://a.www.example.com/en/2",
    "http://notexample.com/en/2", "http://x.net/es/1", "http://net/fr/#x", "http://x.net/de/", "http://x.org/en/", "a://b://c.com/en/", "http://com/x", "http://.com/", "http://x.com./en/", "http://ÄÖ.com/Ä", "x://h#/en/", "x://h.net?/es/", "http://u@example.com:80/en/", "http://example.com/en//x\ny",
    "http://x.Äb.com/q", "http://x.äb.com/q", "http://a.b.com/very/long/path/1", "http://a.b.com/x", "http://x.b.com/en",
]


def brute(url, rules, default="allow"):
    host, path = url_filter.split_url(url)
    fits = []
    for verdict, rule in rules:
        h, p = url_filter.split_rule(rule)
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h) + len(p), len(h), verdict == "block", rule, verdict))
    best = max(fits, default=(0, 0, 0, None, default))
    return (host, path, best[3], best[4])


RULES = [*URL_RULES, ("block", "example.com/e"), ("allow", "example.com/en/1"), ("block", "/x"), ("allow", "example.com/en//"), ("block", "net/es/1"), ("allow", "net/es/1"), ("block", "h/"), ("block", "x.Äb.com/"), ("allow", "a.b.com/"), ("block", "b.com/very/long/path/"), ("allow", "b.com/en"), ("block", "x.b.com")]


@pytest.mark.parametrize("rules", [list(URL_RULES), RULES, []])
@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_both_ways_equal_brute_force(spark, rules, limit):
    pages = spark.createDataFrame([(k, u, "mine", "v") for k, u in enumerate(URLS)] + [(0, None, "mine", "v")], "page_id long, url string, host string, verdict string")
    got = url_filter.filter_urls(pages, rules, max_broadcast_bytes=limit) if rules or limit else url_filter.filter_urls(pages, rules)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((k, *brute(u, rules))) for k, u in [*enumerate(URLS), (0, None)])


def test_empty_table_and_query(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(pages, URL_RULES).count() == 0
    with pytest.raises(ValueError, match="verdict"):
        url_filter.filter_urls(pages, [("maybe", "x/")])
    compare(spark, "/root/testdata/sf0.001", op7_url_filter, OP7_SQL)
