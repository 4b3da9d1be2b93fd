from gleanframe.llm import dom, extraction

PAGE = """<!DOCTYPE html><html><head><title>{n}</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/a">menu {n}</a></li></ul></nav><!-- note {n} -->
<div class="ad-box">Buy {n}</div><div class="content"><article><h1>Title&nbsp;{n}</h1>
<p>First <b>bold</b>{n}<br>line &amp; more &lt;x&gt; &bogus; 1 < 2
<p>Second   paragraph {n}.<aside>aside {n}</aside><ul><li>point {n}</ul>
<form><label>Name</label><input></form><div class="share-buttons">Share {n}</div></article>
<section id="comments"><article class="comment"><p>Reader says {n}, at great length, much more than the article itself does,
over and over and over and over and over and over and over and over and over and over again.</article></section></div>
<div class="sidebar">Side {n}</div><div id="cookie_notice">We use cookies</div><footer>&copy; {n}</footer></body></html>"""


def text(n):
    return f"Title {n} First bold{n} line & more <x> &bogus; 1 < 2 Second paragraph {n}. point {n}"


def pages(spark, rows):
    made = spark.createDataFrame(rows, "page_id long, url string, html string, nodes string, host string")
    return made.selectExpr("*", "'own' AS wrapper_host", "'own' AS Plan_Host", "'own' AS wrapper_blocks")


def test_article_without_what_surrounds_it(spark):
    rows = [(i, f"http://h{i % 3}.org/{i}", PAGE.format(n=i), "own", "own") for i in range(30)]
    got = extraction.extract(pages(spark, rows)).collect()
    assert len(got) == 30
    for r in got:
        assert (r.text, r.n_chars) == (text(r.page_id), len(text(r.page_id)))
        assert r.nodes == "own" and r.host == "own" and r.url == f"http://h{r.page_id % 3}.org/{r.page_id}"


def test_wrapper_of_pages_without_telling_names(spark):
    """Nothing but the alignment tells constant nodes from slots here."""
    page = "<body><div class=x1><p>Always the same line</div><div class=y><h2>Head {n}</h2><p>{t}<div class=z>Same note</div></div><div class=w>Same end</div>"
    rows = [(i, "http://a.b/", page.format(n=i, t=f"Story number {i} " * 9), "", "") for i in range(8)]
    for r in extraction.extract(pages(spark, rows)).collect():
        assert r.text == f"Head {r.page_id} " + " ".join([f"Story number {r.page_id}"] * 9)


def test_odd_pages(spark):
    rows = [
        (1, "http://o.org/", None, "", ""),
        (2, None, "", "", ""),
        (3, "nowhere", "plain text &amp more", "", ""),
        (4, "http://o.org/", "<article><p>cut off <b>here</b> <i", "", ""),
        (5, "http://o.org/", "<article>open <!-- never closed", "", ""),
        (6, "http://o.org/", "<article>a<script>never closed", "", ""),
        (7, "http://o.org/", "<div>" * 3_000 + "deep" + "</div>" * 3_000, "", ""),
        (8, "http://o.org/", "<article><p>" + "word " * 200_000 + "</article>", "", ""),
        (8, "http://o.org/", "<article>twice</article>", "", ""),
        (None, "http://o.org/", "<article title='a>b\"'>no id</article>", "", ""),
    ]
    got = sorted(extraction.extract(pages(spark, rows)).collect(), key=lambda r: (r.page_id or 99, r.n_chars))
    assert [r.text for r in got][:7] == ["", "", "plain text & more", "cut off here", "open", "a", "deep"]
    assert [r.text for r in got][7:] == ["twice", " ".join(["word"] * 200_000), "no id"]
    assert extraction.extract(pages(spark, []).limit(0)).count() == 0


def test_equal_pages_and_small_hosts_keep_their_text(spark):
    rows = [(i, "http://same.org/", PAGE.format(n=1), "", "") for i in range(9)] + [(99, "http://one.org/", PAGE.format(n=2), "", "")]
    got = {r.page_id: r.text for r in extraction.extract(pages(spark, rows)).collect()}
    assert got == {i: text(1) for i in range(9)} | {99: text(2)}


def test_tree_matching():
    a, _ = dom.parse("<div><p>1</p><h2>2</h2><ul><li>3</ul></div>")
    b, _ = dom.parse("<div><h2>2</h2><section>x</section><ul><li>3</ul></div>")
    partners = dom.align(a, b)
    assert {a[x].label for x in partners} == {"page", "div", "h2", "ul", "li"}
    assert all(a[x].label == b[y].label for x, y in partners.items())


SHELL = (
    "<html><body {body}><div class='site-menu'><a href='/'>Home {n}</a></div><div {wrapper}><article {article}><h1>Head {n}</h1>"
    "<p>Story number {n} tells of {n} things at some length.</p></article></div><div class='right-sidebar'>Side {n}</div></body></html>"
)


def test_words_of_page_wrappers_and_articles_lose_nothing(spark):
    shells = [
        ("class='right-sidebar'", "", ""),
        ("class='no-sidebar'", "", ""),
        ("", "class='page has-menu'", ""),
        ("", "class='page menu'", ""),
        ("", "class='page' data-role='menu' data-id='footer'", ""),
        ("", "", "class='post comments-open'"),
        ("", "", "class='post search'"),
        ("", "", "id='legal-news'"),
        ("", "", "aria-hidden='false' data-role='alert'"),
        ("", "", "title='class=menu'"),
    ]
    rows = [
        (100 * k + i, f"http://h{k}.org/{i}", SHELL.format(n=i, body=body, wrapper=wrapper, article=article), "", "")
        for k, (body, wrapper, article) in enumerate(shells)
        for i in (1, 2, 3, 4, 5, 6)
    ]
    for r in extraction.extract(pages(spark, rows)).collect():
        n = r.page_id % 100
        assert r.text == f"Head {n} Story number {n} tells of {n} things at some length.", shells[r.page_id // 100]


def test_marks_are_whole_tokens():
    def mark(token):
        return extraction.marks(token, extraction.NO_CONTENT_WORDS)

    assert mark(".right-sidebar") == "sidebar" and mark(".share-buttons") == "share" and mark("@search") == "search"
    assert mark(".related-posts") == "related" and mark(".cookie-notice") == "notice"
    assert not any(map(mark, [".no-sidebar", ".has-menu", ".comments-open", ".legal-news", ".post"]))


def test_constant_blocks_among_siblings_of_one_label_are_template(spark):
    story = "Story number {n} tells of {n} things, at a length that leaves no doubt about what the page is for."
    bodies = [
        "<div>Always the same menu</div><div>" + story + "</div><div>Always the same end</div>",
        "<div id=block1>Always the same menu</div><div id=block2>" + story + "</div><div id=block3>Same end</div>",
        "<article><p>" + story + "</p><p>The same note under all.</p></article>",
    ]
    rows = [(100 * k + n, f"http://h{k}.org/", body.format(n=n), "", "") for k, body in enumerate(bodies) for n in range(8)]
    # Copies of a page do not make its text template.
    rows += [(100 * k + 1, f"http://h{k}.org/", body.format(n=1), "", "") for k, body in enumerate(bodies)] * 30
    got = extraction.extract(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == story.format(n=r.page_id % 100)
