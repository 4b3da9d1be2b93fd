from gleanframe.llm import url_filter

URLS = [
    ("https://a.example.org/es/x", "example.org/es/", "block"),
    ("http://EXAMPLE.org/en/12?q#f", "example.org/en/1", "block"),
    ("http://example.org/en/2", "org/", "allow"),
    ("http://notexample.org/es/1", "org/", "allow"),
    ("http://x.com/de/1", "com/de/", "block"),
    ("http://x.com/fr/1", "com/fr/", "allow"),
    ("http://x.com/it/1", None, "allow"),
    ("http://example.org", None, "allow"),
    ("http://example.org:80/es/", None, "allow"),
    ("no url", None, "allow"),
    ("", None, "allow"),
    (None, None, "allow"),
    ("ftp://x.com?://y.org/es/", None, "allow"),
    ("http://example.org/" + "es/" * 20_000, "example.org/es/", "block"),
    ("http://" + "a." * 5_000 + "example.org/es/", "example.org/es/", "block"),
]


def test_longest_rule_wins(spark):
    rows = [(i, u, "own") for i, (u, _, _) in enumerate(URLS)] * 2 + [(None, URLS[0][0], "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = url_filter.filter_urls(pages, url_filter.rule_table(spark, url_filter.RULES)).collect()
    assert len(got) == len(rows)
    for row in got:
        assert (row.rule, row.verdict) == URLS[row.page_id or 0][1:], row


def test_host_and_path(spark):
    pages = spark.createDataFrame([(1, "HTTP://A.bÉ/P?q://"), (2, "x://h#f")], "page_id long, url string")
    rows = pages.select(url_filter.url_host(pages.url), url_filter.url_path(pages.url)).collect()
    assert [tuple(r) for r in rows] == [("a.bÉ", "/P"), ("h", "")]


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    rules = url_filter.rule_table(spark, url_filter.RULES)
    assert url_filter.filter_urls(pages, rules.limit(0), default="block").first().verdict == "block"
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_block_wins_between_equal_rules(spark):
    rules = url_filter.rule_table(spark, [("block", "x.org", "/"), ("allow", "x.org", "/"), ("allow", None, "/"), (None, "y.org", None)])
    pages = spark.createDataFrame([(1, "http://x.org/"), (2, "http://y.org")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {1: ("x.org/", "block"), 2: ("y.org", "allow")}
