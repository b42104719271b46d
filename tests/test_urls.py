"""URL expressions against the standard library and against fixed cases."""

from urllib.parse import urljoin, urlparse

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlframe import rules
from crawlframe.functions import text as X
from crawlframe.functions import urls as U

SEGMENT = st.sampled_from(["a", "b.html", "..", ".", "", "c d", "矿", "...", "x:y", ".h"])
PATH = st.lists(SEGMENT, min_size=1, max_size=6).map("/".join)
QUERY = st.sampled_from(["", "?q=1", "?a=/../b", "?x?y"])
FRAGMENT = st.sampled_from(["", "#top", "#a/../b"])
BASE = st.builds(
    lambda s, h, p, q, f: f"{s}://{h}/{p}{q}{f}",
    st.sampled_from(["http", "https", "HTTP"]), st.sampled_from(["h.com", "u@h.com:80", "sub.h.org"]), PATH, QUERY, FRAGMENT,
)
REF = st.one_of(
    st.builds(lambda p, q, f: p + q + f, PATH, QUERY, FRAGMENT),
    st.builds(lambda p, q: "/" + p + q, PATH, QUERY),
    st.builds(lambda p: "//o.net/" + p, PATH),
    BASE, st.sampled_from(["", "#f", "?z", "mailto:a@b", "javascript:x()"]),
)


def reference(base, ref):
    return urlparse(urljoin(base, ref))._replace(fragment="").geturl()


def ordinary(base, ref):
    """Left out: an address without authority after its scheme, which no page can be fetched from."""
    return not ref.startswith("//") or urlparse(ref).netloc != ""


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(BASE, REF), min_size=200, max_size=400))
def test_join_like_the_library(spark, pairs):
    pairs = [p for p in pairs if ordinary(*p)]
    df = spark.createDataFrame(pairs, "b string, r string").select("b", "r", U.url_join("b", "r").alias("j"))
    for b, r, j in df.collect():
        assert j == reference(b, r), (b, r)


def one(spark, expr, *values):
    rows = spark.createDataFrame([(v,) for v in values], "u string").select(expr(F.col("u")).alias("r")).collect()
    return [r[0] for r in rows]


def test_normalize(spark):
    got = spark.range(1).select(U.url_join(F.lit("https://example.com"), F.lit("/path"))).first()[0]
    assert got == "https://example.com/path"
    assert one(spark, U.normalize_url, "https://example.com/page#fragment") == ["https://example.com/page"]


def test_valid(spark):
    assert one(spark, U.is_valid_url, "https://example.com", "http://example.com", "ftp://example.com", "invalid-url") == [
        True, True, False, False]


def test_should_crawl(spark):
    # One address per rule family: static endings, interface paths, download marks, and what no rule names.
    good = ["http://h1.test/", "http://h1.test/garden/rose", "https://h2.test/a.html?x=png", "http://h3.test/cook.php?id=4"]
    bad = ["http://h1.test/pic/A.WebP", "http://h1.test/lib/x.js", "http://h1.test/v2/json/list", "http://h1.test/get?q=1&download=2",
           "http://h1.test/feed/rss/"]
    assert one(spark, U.should_crawl, *good, *bad) == [True] * len(good) + [False] * len(bad)
    assert one(spark, lambda u: U.url_hint(u)["gate"], *good, *bad) == [True] * (len(good) + len(bad))
    assert one(spark, U.should_crawl, None) == [False]


def test_absolute_filter_agrees(spark):
    """The one-pattern filter for normalised addresses gives what its parts give."""
    urls = ["http://h.com/a.pdf", "http://h.com/a.pdf?x", "http://h.com/a.pdf;v", "http://h.com/a;b.pdf", "http://h.com",
            "http://h.pdf", "http://h.com/x.PDF", "http://h.com/d.pdf/", "http://h.com/?f=a.pdf", "https://h.com/download.php",
            "http://h.com/a.b/c;d.pdf/e", "ftp://h.com/a"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    for u, a, b in df.select("u", U.is_crawlable_absolute(F.col("u")), U.is_valid_url("u") & U.should_crawl("u")).collect():
        assert a == b, u


def test_blacklist(spark):
    # A rule stands for each way to match: in the host, in the path, at the end, in the middle of another word.
    rule = rules.BLACKLIST[0]
    cases = {
        f"https://{rule}/": True, f"http://h.test/{rule.upper()}": True, f"http://h.test/?next={rule}": True, f"http://pre{rule}post.test/": True,
        "http://h.test/plain": False, "": False,
    }
    only = [rule]
    assert one(spark, lambda u: U.is_blacklisted(u, only), *cases) == list(cases.values())
    assert one(spark, lambda u: U.is_blacklisted(u, []), *cases) == [False] * len(cases)
    for r in rules.BLACKLIST:
        assert r == r.lower()
    every = [f"http://h.test/{r}" for r in rules.BLACKLIST]
    assert all(one(spark, U.is_blacklisted, *every))
    many = only + [f"never-{i}-seen" for i in range(100)]
    assert one(spark, lambda u: U.is_blacklisted(u, many), *cases) == list(cases.values())


def test_page_filename(spark):
    long = "http://h.com/" + "x" * 300 + ".html"
    got = one(spark, U.page_filename, "http://h.com:80/", "http://h.com/a/b.c.html?x", "http://h.com/x/", long)
    assert [g[8:] for g in got[:3]] == ["_h_com_80.html", "_b.c.html", "_x.html"]
    assert len(got[3]) == 200 and got[3].endswith("x.html")


def test_size_labels(spark):
    sizes = [0, 5, 1023, 1024, 1280, 1331, 1536, 1048575, 1310720, 5 << 30]
    df = spark.createDataFrame([(s,) for s in sizes], "s long").select(X.size_label("s"), X.size_label_short("s"))
    long, short = zip(*[tuple(r) for r in df.collect()])

    def plain(n):
        for unit, name in [(1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB")]:
            if n >= unit:
                return f"{n / unit:.1f} {name}"
        return f"{n} B"

    assert list(long) == [plain(s) for s in sizes]
    assert short[4] == "1.25 KB" and short[3] == "1 KB" and short[9] == "5 GB"


def test_lone_bracket_is_not_a_url(spark):
    df = spark.createDataFrame([("http://[bad/x",), ("http://bad]/x",), ("http://[::1]/x",), ("http://a.com/[x",)], "u string")
    got = df.select(U.is_valid_url("u").alias("v"), U.should_crawl("u").alias("s"), U.is_crawlable_absolute(F.col("u")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(False,) * 3, (False,) * 3, (True,) * 3, (True,) * 3]
