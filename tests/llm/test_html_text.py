import html
import re

from gavelspark.llm import html_text
from gavelspark.llm.queries import ALL

PAGES = "page_id long, url string, html string, text string, path string"


def reference_text(source):
    """The article of a page of the test data: what stands between its block tags."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", source, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", body)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br>" in p else "", p)).split()) for p in parts]
    return "\n\n".join(p for p in parts if p)


def test_pages_of_the_test_data(spark):
    folder = "/root/testdata/sf0.001"
    source = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    found = ALL["op7_html_extraction"](spark, folder).collect()
    assert len(found) == len(source)
    for r in found:
        assert r.url == source[r.page_id].url and r.n_chars == len(r.text)
        assert r.text == reference_text(source[r.page_id].html)


def text_of(source):
    page = html_text.Page(source)
    return page.text(page.best()) if page.best() is not None else ""


def test_boilerplate_goes():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page">
    <header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">We use cookies, many of them, for all.</div>
    <div id=main-content><div class="sideBar"><p>Other stories you may like</p></div>
    <article class="post-123"><header><h1>Head&nbsp;line</h1></header><p>First &amp; <b>bold</b>
    words<br>here.<p>Second one<!-- hidden --> of <a href="/y">two</a> lines<script>var t = "</p><p>no";</script>.</p>
    <form><p>Sign up</p><input name=a></form><aside>Side</aside><ul><li>item one<li>item two</ul>
    <div class="ad"><p>Buy now and here and there</p></div><table><tr><td>a<td>b</table>
    <section id="comments"><p>Great post, I liked all of it very much indeed, so much text in here!</p></section></article></div>
    <footer>(c)</footer></body></html>"""
    assert text_of(page) == "Head line\n\nFirst & bold words here.\n\nSecond one of two lines.\n\nitem one\n\nitem two\n\na\n\nb"


def test_broken_markup():
    assert text_of("") == ""
    assert text_of("just text") == "just text"
    assert text_of("<p>a < b and <b>c<p>d") == "a < b and c\n\nd"
    assert text_of("<div><p>x<!-- never ends <p>y") == "x"
    assert text_of("<div>x<script>never ends <p>y") == "x"
    assert text_of("<p>one</div></p>two &amp &lt;b&gt; &#233;&#x20AC;") == "one\n\ntwo & <b> é€"
    assert text_of("<a href='" + "<a x=\"" * 20000).count("<a x") >= 0
    assert len(text_of("<p>" + "word " * 200000)) == 999999


def test_host_votes_decide(spark):
    rich = "<body><div class='c{0}'><p>Story {0} with a good number of words in it.</p><p>And more.</p></div><div class='x'><p>{1}</p><p>.</p></div></body>"
    rows = [(k, "http://A.com/1", rich.format(k, "tail"), None, None) for k in range(9)]
    rows += [(50, "https://a.com", rich.format(7, "a much longer tail than the story itself, so alone it would win over it, by far"), "", ""),
             (51, None, "<p>no host</p>", "", ""), (52, "x", None, "", ""), (53, "http://a.com/?q", "<p>other layout</p>", "", ""), (None, "http://b.com", "<p>no id", "", ""),
             (1, "http://A.com/1", rich.format(1, "tail"), None, None)]
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    got = sorted(((r.page_id, r.text) for r in html_text.extracted(pages).collect()), key=str)
    story = lambda k: f"Story {k} with a good number of words in it.\n\nAnd more."
    want = [(k, story(k)) for k in [*range(9), 1]] + [(50, story(7)), (51, "no host"), (52, ""), (53, "other layout"), (None, "no id")]
    assert got == sorted(want, key=str)
    assert html_text.extracted(spark.createDataFrame([], PAGES)).count() == 0


def paragraphs(name, count, size):
    return [f"{name} {k} ".ljust(size, "x") for k in range(count)]


def marked(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_the_whole_article_counts():
    lead, body, more = paragraphs("lead", 1, 200), paragraphs("body", 5, 200), paragraphs("more", 5, 180)
    links = "<div class=list><p><a href=x>Another story</a></p><p><a href=y>One more story of the day</a></p></div>"
    whole = "\n\n".join(["Headline", *lead, *body])
    for outer in ("article", "main", "div class=post"):
        end = outer.split()[0]
        page = f"<body><div id=top>A line</div><{outer}><h1>Headline</h1>{marked(lead)}<div class=body>{marked(body)}</div></{end}>{links}</body>"
        assert text_of(page) == whole
        page = f"<body><div id=top>A line</div><{outer}><div class=a>{marked(body)}</div><div class=b>{marked(more)}</div></{end}>{links}</body>"
        assert text_of(page) == "\n\n".join([*body, *more])
    assert text_of(f"<body>{links}<h1>Headline</h1>{marked(lead)}<div class=body>{marked(body)}</div></body>").endswith(whole)
    assert text_of(f"<div class=wrap><div class=body>{marked(body)}</div>{links}<div class=x>short</div></div>") == "\n\n".join(body)


def test_a_host_keeps_headline_and_lead(spark):
    page = "<body><article><h1>Head {0}</h1>" + marked(paragraphs("lead", 1, 200)) + "<div class=body>" + marked(paragraphs("body", 5, 200)) + "</div></article></body>"
    pages = spark.createDataFrame([(k, "http://a.com/1", page.format(k), None, None) for k in range(4)], PAGES)
    want = "\n\n".join([*paragraphs("lead", 1, 200), *paragraphs("body", 5, 200)])
    assert {r.page_id: r.text for r in html_text.extracted(pages).collect()} == {k: f"Head {k}\n\n{want}" for k in range(4)}


def test_a_boilerplate_word_is_not_enough():
    body = paragraphs("body", 5, 200)
    whole = "\n\n".join(["Headline", *body])
    inner = f"<h1>Headline</h1>{marked(body)}"
    for outer in ("main class='with-banner'", "article class='post has-comments'", "article class=comments", "div class='content no-header'", "div class='hasSidebar'",
                  "div class=sidebar-left", "div class=page-with-widget", "section id=post-share"):
        assert text_of(f"<body><p>Site</p><{outer}>{inner}</{outer.split()[0]}></body>").endswith(whole)
    for outer in ("has-sidebar", "sidebar", "page-comments"):
        assert text_of(f"<body class='{outer}'>{inner}</body>") == whole
    header = "<header class=entry-header><h1 class=page-header>Headline</h1></header>"
    junk = "<div class=site-banner>Buy</div><div class=post-share>Share this</div><div class='comments-area'>" + marked(paragraphs("comment", 9, 300)) + "</div>"
    assert text_of(f"<body><article class=post>{header}{marked(body)}{junk}<div class='text no-border'><p>End</p></div></article></body>") == whole + "\n\nEnd"


def test_two_templates_of_a_host(spark):
    body = paragraphs("body", 3, 100)
    first = f"<html><body><div>{marked(body)}</div></body></html>"
    second = f"<html><body><div><p>Just a line</p></div><section class=story>{marked(body[::-1])}</section></body></html>"
    rows = [(k, "http://a.com/1", first if k % 3 else second, None, None) for k in range(9)]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {k: "\n\n".join(body if k % 3 else body[::-1]) for k in range(9)}


def test_a_tag_that_never_closes_costs_one_pass():
    import time

    for pairs in (28, 10_000):
        page = "<article><p>" + "Words of the story go on here. " * 20 + "</p><div class=\"a" + '""' * pairs + " <p>Last words.</p></article>"
        started = time.perf_counter()
        got = text_of(page)
        assert time.perf_counter() - started < 1.0
        assert got.startswith("Words of the story") and got.endswith("Last words.")
    assert text_of("<p>a</p><a b=\"c>\" x <p>y</p>").endswith("y")
    assert text_of("<p title=\"x > y\">z</p>") == "z"
