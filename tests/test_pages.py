"""DOM, Markdown, relevance and JavaScript-need cases written by hand."""

import pytest
from pyspark.sql import functions as F

from crawlframe.functions import html as H
from crawlframe.functions.dom import Page
from crawlframe.functions.render import to_markdown
from crawlframe.operators import graph as G
from crawlframe.operators.parse import decode_pages, parse_pages
from crawlframe.plans import jobs as J


def clean(html):
    p = Page(html)
    p.clean()
    lo, hi = p.main()
    return p.to_html(lo, hi)


def markdown(html):
    p = Page(html)
    lo, hi = p.main()
    return [x.strip() for x in to_markdown(p, lo, hi).split("\n") if x.strip()]


def test_title_meta_links():
    p = Page(
        '<title> A &amp; B </title><meta name="keywords" content="K"><meta name="description" content="D">'
        '<a href="/x">1</a><a>2</a><iframe src="/f"></iframe><script>var u = "<a href=\'/no\'>"</script>'
    )
    assert p.first_text("title") == " A & B "
    assert p.meta("keywords") == "K" and p.meta("description") == "D" and p.meta("none") == ""
    assert p.hrefs() == ["/x", "/f"]
    assert Page("<p>none").first_text("title") is None


def test_clean_drops_by_tag_class_and_id():
    out = clean(
        '<body><nav>n</nav><div class="x header-AD">a</div><p id="main-nav">b</p><p class="reading">c</p>'
        '<div> <span></span></div><a href="/q" title="t">link</a><img src="i"><p>kept</p></body>'
    )
    assert out == '<body><a title="t">link</a><p>kept</p></body>'


def test_unclosed_tags_and_entities():
    assert clean("<article><p>a<b>b<p>c &lt; &copy;</article>") == (
        "<article><p>a<b>b<p>c &lt; ©</p></b></p></article>"
    )
    assert Page("<p>" * 5000 + "deep").text() == "deep"
    assert Page("a&#146;b&#x77ff;&#233; &nosuch; &#xffffffff;").text() == "a’b矿é".replace("矿", "\u77ff") + " &nosuch \ufffd"


@pytest.mark.parametrize(
    "html, tag",
    [
        ("<main>m</main><article>a</article>", "<main>"),
        ("<main> </main><article>a</article>", "<article>"),
        ('<div role="main">r</div><div class="content">c</div>', '<div role="main">'),
        ('<div class="page content">c</div><div id="content">i</div>', '<div class="page content">'),
        ("<body><div>" + "x" * 501 + "</div><div>y</div></body>", "<div>x"),
        ("<body><div>short</div></body>", "<body>"),
        ("<p>no body</p>", "<p>"),
    ],
)
def test_main_content(html, tag):
    p = Page(html)
    lo, hi = p.main()
    assert p.to_html(lo, hi).startswith(tag)


def test_markdown_blocks():
    assert markdown(
        "<body><h2>Head</h2><p>one<br>two</p><ul><li>a</li><li>b<ol><li>c</li></ol></li></ul>"
        "<blockquote>q</blockquote><hr><pre>x\n y</pre><p>k <em>e</em> <strong>s</strong> <code>c</code></p></body>"
    ) == ["## Head", "one", "two", "* a", "* b", "1. c", "> q", "* * *", "x", "y", "k _e_ **s** `c`"]


def test_markdown_table_and_escapes():
    assert markdown(
        "<body><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table><p>1. x</p><p>- y</p><p>a &lt; b</p></body>"
    ) == ["A| B", "---|---", "1| 2", "1\\. x", "\\- y", "a < b"]


def page(title, *lines):
    body = "".join(f"<p>{x}</p>" for x in lines)
    return f"<html><head><title>{title}</title></head><body>{body}</body></html>"


RELEVANT = [
    page("铁矿勘探年报", "钻孔十二个，矿产资源储量上升。", "地质勘探队年底收工。"),
    page("矿山环境治理", "矿产资源开采之后要恢复植被。", "地质调查数据已经公开。"),
    page("金矿地质调查", "矿区开采许可已经批准，勘探范围扩大。"),
]
OFF_TOPIC = [
    page("周末电影院", "晚上八点放映两部喜剧片。"),
    page("阳台种花", "月季每周浇水两次。"),
    page("火车时刻", "早班车六点十分开出。"),
]


@pytest.mark.parametrize("preset", ["spider", "collector"])
def test_relevance(spark, preset):
    rows = [(f"https://e{i}.com/", h) for i, h in enumerate(RELEVANT + OFF_TOPIC)]
    df = spark.createDataFrame(rows, "url string, html string")
    got = {r.url: r.relevant for r in J.parsed_relevance(df, preset).collect()}
    assert [got[u] for u, _ in rows] == [True] * 3 + [False] * 3
    vetoed = J.parsed_relevance(df, preset, blacklist=["e0.com"]).filter("relevant").count()
    assert vetoed == 2


def test_unreadable_page_counts_as_relevant(spark):
    df = spark.createDataFrame([("u", None)], "url string, html string")
    assert J.parsed_relevance(df).first().relevant is True


def test_keyword_straddles_copies(spark):
    """A word formed by the end of one title copy and the start of the next counts as matched."""
    df = spark.createDataFrame([("u", "<title>ba</title>")], "url string, html string")
    r = J.parsed_relevance(df, keywords=["ab"], title_words=["zz"]).first().relevance
    assert (r.matched, r.score, r.title_hits) == (1, 0, 0)


def test_needs_js(spark):
    rows = [
        ("https://a.org/plain", page("Opening hours", "We open at nine.")),
        ("https://b.org/one", '<main></main><script>ReactDOM.createRoot(document.body); ReactDOM.render(tree, document.body);</script><script src="react.js"></script>'),
        ("https://c.org/two", "<section><span>正在加载</span></section>"),
        ("https://d.org/three", '<main></main><script src="lib/vue.js"></script>'),
        ("https://e.com/Admin/x", "<p>plain</p>"),
    ]
    df = spark.createDataFrame(rows, "url string, html string").select("url", H.js_reason("url", "html").alias("r"))
    assert [r.r for r in df.collect()] == [None, "script-react", "placeholder", "script-vue", "url"]


def test_links_from_dom_and_entities(spark):
    html = '<a href="/a?x=1&amp;y=2#z">1</a><a href=\'b.html\'>2</a><a href="/c.pdf">3</a><iframe src="//o.com/f"></iframe><a href="/a?x=1&y=2">4</a>'
    df = spark.createDataFrame([("http://h.com/d/p", html)], "url string, html string")
    parsed = parse_pages(df, ["hrefs"]).select(H.resolve_links("url", F.col("hrefs")).alias("l"))
    assert sorted(parsed.first().l) == ["http://h.com/a?x=1&y=2", "http://h.com/d/b.html", "http://o.com/f"]


def test_decode(spark):
    text = "矿产资源勘探开发与地质调查工作，自然资源管理"
    rows = [
        (1, bytearray(text.encode("gbk")), "text/html; charset=GBK", "ISO-8859-1"),
        (2, bytearray(text.encode("gb18030")), "text/html", "ISO-8859-1"),
        (3, bytearray(text.encode("utf-8")), "text/html; charset=no-such", "ISO-8859-1"),
        (4, bytearray(b"plain"), "text/html", "ISO-8859-1"),
        (5, None, "text/html", "ISO-8859-1"),
    ]
    df = spark.createDataFrame(rows, "id int, body binary, content_type string, original_charset string")
    got = {r.id: (r.html, r.charset) for r in decode_pages(df).collect()}
    assert got == {1: (text, "gbk"), 2: (text, "gb2312"), 3: (text, "no-such"), 4: ("plain", "ISO-8859-1"), 5: (None, None)}


def test_repair_keeps_the_files_own_signs(spark, tmp_path):
    from crawlframe.sources import files as IO

    (tmp_path / "a.html").write_bytes("own � sign ".encode() + b"bad \xff\xfe byte" + " 矿".encode())
    (tmp_path / "b.html").write_bytes("clean � text".encode())
    got = {r.file_name: r.html for r in IO.read_html_dir(spark, str(tmp_path)).collect()}
    assert got == {"a.html": "own � sign bad  byte 矿", "b.html": "clean � text"}


def test_topic_gate_can_be_left_out(spark):
    rows = [("http://a.com/x", "<title>食谱</title><p>more than ten characters</p><a href='/y'>l</a>", 200, None, "text/html"),
            ("http://a.com/z", "<p>more than ten characters</p>", 500, None, "text/html")]
    df = spark.createDataFrame(rows, "url string, html string, status_code int, error_type string, content_type string")
    on = {r.url: r for r in J.judge_fetches(df).collect()}
    off = {r.url: r for r in J.judge_fetches(df, topic_gate=False).collect()}
    assert on["http://a.com/x"].op == "failed" and off["http://a.com/x"].op == "success"
    assert off["http://a.com/x"].links == ["http://a.com/y"] and off["http://a.com/x"].title == "食谱"
    assert on["http://a.com/z"].op == off["http://a.com/z"].op == "failed"


def test_page_to_markdown_outcomes(spark):
    body = "".join(f"<p>矿产资源管理，地质勘探工作第{i}段，内容充实。more words here to read {i}</p>" for i in range(20))
    rows = [("http://h.com/good", f"<article>{body}</article>"), ("http://h.com/short", "<p>x</p>"),
            ("http://h.com/blank", " 　\n"), ("http://h.com/old", body)]
    df = spark.createDataFrame(rows, "url string, html string")
    from crawlframe.functions import urls as U

    old = df.filter("url like '%old'").select(U.md_filename(U.page_filename("url")).alias("md_name"))
    got = {r.url.rsplit("/", 1)[1]: r for r in J.pages_to_markdown(df, old).collect()}
    assert {k: r.outcome for k, r in got.items()} == {"good": "success", "short": "skipped", "blank": "failed", "old": "existing"}
    assert got["short"].reason.startswith("内容长度不足：1字符") and "HTML文件为空" in got["blank"].reason
    assert got["good"].clean_markdown.count("\n") == 19 and got["good"].quality > 40


def test_collect_follows_only_good_pages(spark):
    def page(url, text, links, status=200, ctype="text/html", err=None):
        body = "".join(f'<a href="{x}">l</a>' for x in links)
        return url, f"<title>{text}</title>{body}", status, err, ctype

    topic = "地质 矿产 资源 安全"
    rows = [
        page("http://a.com/", topic, ["/1", "/2", "/3", "http://bad.com/"]),
        page("http://a.com/1", topic, ["/4"]),
        page("http://a.com/2", "美食", ["/5"]),
        page("http://a.com/3", topic, ["/6"], status=500),
        page("http://a.com/4", topic, ["/7", "/"]),
        page("http://bad.com/", topic, ["/8"]),
    ]
    df = spark.createDataFrame(rows, "url string, html string, status_code int, error_type string, content_type string")
    seeds = spark.createDataFrame([("http://a.com/",), ("http://bad.com/",), ("nonsense",)], "url string")
    got = {r.url.replace("http://a.com/", "/"): (r.depth, r.status) for r in J.collect_urls(df, seeds, 1, blacklist=["bad.com"]).collect()}
    assert got == {
        "/": (0, "success"), "/1": (1, "success"), "/2": (1, "failed"), "/3": (1, "failed"), "/4": (2, "pending"),
    }


def test_second_run_finds_its_output(spark):
    """What a run wrote is `existing` for the next; rejected pages are tried again."""
    from crawlframe.session import scratch
    from crawlframe.sources import files as IO

    body = "".join(f"<p>矿产资源管理，地质勘探工作第{i}段，内容充实。more words here to read {i}</p>" for i in range(20))
    rows = [(f"http://h.com/{i}", f"<article>{body}</article>") for i in range(5)] + [("http://h.com/short", "<p>x</p>")]
    df = spark.createDataFrame(rows, "url string, html string")
    path = scratch(spark, "corpus")
    first = J.pages_to_markdown(df, IO.read_markdown(spark, path))
    assert IO.write_markdown(first, path, "one") and not IO.write_markdown(first, path, "one")
    again = J.pages_to_markdown(df, IO.read_markdown(spark, path))
    assert {r.outcome: r["count"] for r in again.groupBy("outcome").count().collect()} == {"existing": 5, "skipped": 1}
    assert IO.write_markdown(again, path, "two") and set(IO.committed(spark, path)) == {"one", "two"}
    first.filter("outcome = 'success'").write.parquet(f"{path}/data/half")  # a writer that died before its manifest
    assert IO.read_markdown(spark, path).count() == 5
    bad = IO.rejects(again).collect()
    assert [r.outcome for r in bad] == ["skipped"] and bad[0].rejected_at is not None
    forced = J.pages_to_markdown(df, IO.read_markdown(spark, path), force=True).filter("outcome = 'success'")
    assert all(r.md_name.endswith("_1.md") for r in forced.collect())


def test_pages_of_one_name_are_tried_in_turn(spark):
    body = "<article>" + "".join(f"<p>矿产资源管理，地质勘探工作第{i}段，内容充实。more words here to read {i}</p>" for i in range(20))
    rows = [
        (1, "u1", "a.md", "<p>thin</p>"), (2, "u2", "a.md", " "), (3, "u3", "a.md", body), (4, "u4", "a.md", body + "x"),
        (5, "u5", "b.md", body), (6, "u6", "b.md", "<p>thin</p>"), (7, "u7", "c.md", "<p>thin</p>"), (8, "u8", "c.md", None),
        (9, "u9", "d.md", body), (9, "u9", "d.md", body), (9, "u9", "d.md", body), (10, "u10", "e.md", "<p>x</p>"), (10, "u10", "e.md", "<p>x</p>"),
        (11, "u11", "old.md", body), (11, "u11", "old.md", body), (12, None, "f.md", body), (13, "u13", "g.md", body), (14, "u13", "g.md", body),
    ]
    df = spark.createDataFrame(rows, "k int, url string, nm string, html string")
    old = spark.createDataFrame([("old.md",)], "md_name string")
    out = J.pages_to_markdown(df, old, name=F.col("nm"))
    got = sorted((r.k, r.outcome) for r in out.collect())
    assert got == [
        (1, "skipped"), (2, "failed"), (3, "success"), (4, "existing"), (5, "success"), (6, "existing"), (7, "skipped"), (8, "failed"),
        (9, "existing"), (9, "existing"), (9, "success"), (10, "skipped"), (10, "skipped"), (11, "existing"), (11, "existing"),
        (12, "success"), *got[-2:]]
    assert sorted(o for k, o in got if k > 12) == ["existing", "success"]
    made = out.filter("outcome = 'success'")
    assert made.count() == made.select("md_name").distinct().count() == 5


def test_links_of_untidy_pages(spark):
    html = (
        "<a href='/single'>1</a><a href=/bare>2</a><a title='a > b' href=\"/after\">3</a><!-- <a href='/hidden'>x</a> -->"
        "<a href='/x?a=1&amp;b=2'>4</a><iframe src='/frame'></iframe>"
    )
    df = spark.createDataFrame([("http://a.com/", html)], "url string, html string")
    want = {"single", "bare", "after", "x?a=1&b=2", "frame"}
    assert {r.dst for r in G.page_links(df).collect()} == {f"http://a.com/{w}" for w in want}
    known = spark.createDataFrame([("http://a.com/", 2)], "url string, depth int")
    assert {(r.dst, r.depth) for r in G.link_edges(df, known).collect()} == {(f"http://a.com/{w}", 3) for w in want}


def test_parse_keeps_carried_columns(spark):
    from datetime import datetime

    old = datetime(1500, 1, 2, 3, 4, 5)
    rows = [(2**53 + 1, old, [1, None], "<title>a</title>"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "k long, t timestamp_ntz, n array<int>, html string")
    got = parse_pages(df, ["title"]).collect()
    assert [tuple(r) for r in got] == [(2**53 + 1, old, [1, None], "a"), (None, None, None, None)]


def test_stray_end_tags_cost_nothing():
    import time

    from crawlframe.functions.dom import Page

    start = time.perf_counter()
    Page("<p>" * 100_000 + "</x>" * 100_000)
    assert time.perf_counter() - start < 8


def test_title_after_a_long_head(spark):
    html = "<head>" + "<meta name='x'>" * 500 + "<title>late</title></head>"
    df = spark.createDataFrame([(html,)], "html string")
    r = df.select(H.title_regex("html").alias("a"), H.title_regex("html", 5000).alias("b")).first()
    assert (r.a, r.b) == ("late", "无标题")
