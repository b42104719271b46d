"""Registered queries over pages: titles, links, relevance, JS need, Markdown."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from crawlframe import rules
from crawlframe.functions import html as H
from crawlframe.functions import markdown as M
from crawlframe.functions import relevance as R
from crawlframe.functions import urls as U
from crawlframe.functions.text import strip
from crawlframe.operators import graph as G
from crawlframe.operators import reports as RP
from crawlframe.operators.parse import parse_pages
from crawlframe.plans import jobs as J
from crawlframe.plans import views as V
from crawlframe.plans.q_urls import PAGE_BLACKLIST, lit, part, s_any, s_should, s_valid
from crawlframe.plans.registry import query
from crawlframe.sources import files as IO

# Words that occur in the test pages.
WORDS = ["the", "ing", "tion", "que", "der", "para"]
TITLE_WORDS = ["the", "que"]

# --- links -----------------------------------------------------------------------

_RAW = "SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS ref FROM pages"


def s_full(base: str, ref: str) -> str:
    """Absolute form of the references the test pages use: rooted paths and full URLs."""
    return (
        f"CASE WHEN {ref} LIKE '/%' THEN concat({part(base, 1)}, '://', {part(base, 2)}, "
        f"regexp_replace({ref}, '#.*$', '')) ELSE regexp_replace({ref}, '#.*$', '') END"
    )


LINKS_SQL = f"""SELECT DISTINCT page_id, url AS src, dst FROM
    (SELECT page_id, url, {s_full('url', 'ref')} AS dst FROM ({_RAW}) r) f
    WHERE {s_valid('dst')} AND {s_should('dst', PAGE_BLACKLIST)}"""


@query("links", "", LINKS_SQL)
def links(spark, d):
    return G.page_links(V.pages(spark, d), blacklist=PAGE_BLACKLIST, keep=["page_id"])


@query("links_dom", "", LINKS_SQL)
def links_dom(spark, d):
    parsed = parse_pages(V.pages(spark, d), ["hrefs"])
    return G.page_links(parsed, F.col("hrefs"), PAGE_BLACKLIST, keep=["page_id"])


@query("link_counts", "", f"SELECT page_id, url, count(dst) AS n_links FROM pages LEFT JOIN ({LINKS_SQL}) l USING (page_id) GROUP BY ALL")
def link_counts(spark, d):
    n = F.size(H.resolve_links("url", F.col("hrefs"), PAGE_BLACKLIST)).cast("long")
    return parse_pages(V.pages(spark, d), ["hrefs"]).select("page_id", "url", n.alias("n_links"))


_SCRIPT = (
    "<script>go(\"https://s{i}.example.com/a.html\"); go('http://s{i}.example.com/b.htm');"
    " go('https://s{i}.example.com/api/c.html'); go(\"https://s{i}.example.com/d.php\");</script>\n"
    "var home = \"https://s{i}.example.com/dir/"
)


@query("js_urls", "", """
    SELECT page_id, unnest([concat('https://s', page_id, '.example.com/a.html'), concat('http://s', page_id, '.example.com/b.htm'),
                            concat('https://s', page_id, '.example.com/dir/')]) AS js_url FROM pages""")
def js_urls(spark, d):
    script = F.replace(F.lit(_SCRIPT), F.lit("{i}"), F.col("page_id").cast("string"))
    p = V.pages(spark, d).select("page_id", "url", F.concat("html", script, F.lit("\n")).alias("html"))
    return p.select("page_id", F.explode(H.js_urls("url", "html")).alias("js_url"))


# --- titles and texts -------------------------------------------------------------

_TITLE = "regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)"


def s_unescape(t: str) -> str:
    for entity, ch in [("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                       ("&nbsp;", " "), ("&#39;", "''"), ("&amp;", "&")]:
        t = f"replace({t}, '{entity}', '{ch}')"
    return t


# The page with a semicolon after every entity that lacks one (twice, for adjacent ones).
_ENTITY = "'&(amp|copy|middot|quot|lt|gt)([^a-zA-Z0-9;])', '&\\1;\\2', 'g'"
_HTML = f"regexp_replace(regexp_replace(html, {_ENTITY}), {_ENTITY})"
_TITLE_DOM = f"regexp_extract({_HTML}, '(?i)<title[^>]*>([^<]+)</title>', 1)"
_H1_DOM = f"regexp_replace(regexp_extract({_HTML}, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"
_HEAD_ONLY = "regexp_replace(regexp_replace({}, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"


@query("page_title", "", f"SELECT page_id, CASE WHEN {_TITLE} = '' THEN '无标题' ELSE trim({_TITLE}) END AS title FROM pages")
def page_title(spark, d):
    return V.pages(spark, d).select("page_id", H.title_regex("html").alias("title"))


@query("page_title_dom", "", f"SELECT page_id, {s_unescape(f'trim({_TITLE_DOM})')} AS title FROM pages")
def page_title_dom(spark, d):
    return parse_pages(V.pages(spark, d), ["title"]).select("page_id", "title")


@query("page_text", "", f"SELECT page_id, lower({s_unescape(_HEAD_ONLY.format(_HTML))}) AS page_text FROM pages")
def page_text(spark, d):
    return parse_pages(V.pages(spark, d).select("page_id", "html"), ["page_text"])


@query("heading_text", "", f"""
    SELECT page_id, lower(concat({s_unescape(_H1_DOM)}, ' ')) AS heading_text FROM pages""")
def heading_text(spark, d):
    return parse_pages(V.pages(spark, d).select("page_id", "html"), ["heading_text"])


@query("meta_text", "", """
    SELECT page_id, concat('mine ', page_id, CASE WHEN page_id % 2 = 0 THEN ' about rocks & ores ' ELSE ' ' END) AS meta_text FROM pages""")
def meta_text(spark, d):
    i = F.col("page_id").cast("string")
    extra = F.concat(
        F.lit('<META name="keywords" content="Mine '), i, F.lit('">'),
        F.when(F.col("page_id") % 2 == 0, '<meta name="description" content="About rocks &amp; ores">').otherwise(""),
        F.lit('<meta name="keywords" content="second is not read">'),
    )
    p = V.pages(spark, d).select("page_id", F.concat(extra, "html").alias("html"))
    return parse_pages(p, ["meta_text"])


@query("main_content", "", f"""
    SELECT page_id, md5({s_unescape(_HEAD_ONLY.format(f"regexp_extract({_HTML}, '(?s)<article[^>]*>(.*)</article>', 1)"))}) AS text_md5 FROM pages""")
def main_content(spark, d):
    return parse_pages(V.pages(spark, d).select("page_id", "html"), ["main_text"]).select(
        "page_id", F.md5("main_text").alias("text_md5")
    )


_ARTICLE = f"regexp_extract({_HTML}, '(?s)<article>(.*)</article>', 1)"


def s_count(text: str, piece: str) -> str:
    return f"((length({text}) - length(replace({text}, '{piece}', ''))) // {len(piece)})"


# On the test pages every unclosed <b> sits in an unclosed <p>; both end with the article.
@query("clean_html", "", f"""
    SELECT page_id, concat('<article>', replace(replace(replace(replace(replace({_ARTICLE}, '<br>', '<br/>'), '&quot;', '"'), '&amp;', chr(1)), '&', '&amp;'), chr(1), '&amp;'),
        repeat('</b></p>', {s_count(_ARTICLE, '<b>')} - {s_count(_ARTICLE, '</b>')}), '</article>') AS clean_html FROM pages""")
def clean_html(spark, d):
    return parse_pages(V.pages(spark, d).select("page_id", "html"), ["clean_html"])


# Markdown of an article: its first entity behind an opened mark stands off by a blank, and marks
# that stay open are closed at its end, each on a line of its own.
_OPENED = f"regexp_replace({_ARTICLE}, '(<b>[^<&]*[^<&\\s])(&[a-z]+;)', '\\1 \\2', 'g')"
_LINED = "replace(" * 6 + _OPENED + "".join(
    f", '{tag}', {text})" for tag, text in (("<h1>", "'# '"), ("</h1>", "chr(10)"), ("<p>", "chr(10)"), ("</p>", "chr(10)"),
                                            ("<br>", "chr(10)"), ("<b>", "'**'")))
_MD_TEXT = s_unescape(f"concat({_LINED}, repeat(concat(chr(10), '**'), {s_count(_ARTICLE, '<b>')} - {s_count(_ARTICLE, '</b>')}))")
_MD_PAGES = f"SELECT page_id AS doc_id, {_MD_TEXT} AS text FROM pages"


@query("page_markdown", "", f"""
    SELECT page_id, len(ls) AS n_lines, md5(array_to_string(ls, chr(10))) AS text_md5
    FROM (SELECT doc_id AS page_id, list_filter(list_transform(string_split(text, chr(10)),
            lambda x: regexp_replace(x, '^{rules.WS}+|{rules.WS}+$', '', 'g')), lambda x: x <> '') AS ls FROM ({_MD_PAGES}) m) l""")
def page_markdown(spark, d):
    md = parse_pages(V.pages(spark, d).select("page_id", "html"), ["markdown"])
    lines = F.filter(F.transform(F.split("markdown", "\n"), strip), lambda x: x != "")
    return md.select(
        "page_id", F.size(lines).cast("long").alias("n_lines"), F.md5(F.array_join(lines, "\n")).alias("text_md5")
    )


# --- relevance ---------------------------------------------------------------------

def regex_texts(pages):
    """Lower-case title, heading and body text cut out by patterns, without the DOM."""
    title = F.lower(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    heading = F.lower(F.concat(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), F.lit(" ")))
    body = F.regexp_replace(F.regexp_replace(H.without_scripts("html"), r"(?s)<!--.*?-->", ""), "<[^>]*>", "")
    return pages.select(
        "page_id", "url", title.alias("title_text"), F.lit("").alias("meta_text"),
        heading.alias("heading_text"), F.lower(body).alias("page_text"),
    )


_TEXTS = """SELECT page_id, url, lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title_text, '' AS meta_text,
        lower(concat(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), ' ')) AS heading_text,
        lower(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'),
                             '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')) AS page_text
    FROM pages"""


def _n(text: str, word: str) -> str:
    return f"((length({text}) - length(replace({text}, {word}, ''))) // length({word}))"


_HITS = f"""SELECT t.*, w AS keyword, 5 * {_n('title_text', 'w')} + 3 * {_n('meta_text', 'w')}
        + 2 * {_n('heading_text', 'w')} + {_n('page_text', 'w')} AS kw_score
    FROM ({_TEXTS}) t JOIN (SELECT unnest([{', '.join(lit(w) for w in WORDS)}]) AS w) k
    ON contains(concat(repeat(title_text, 5), repeat(heading_text, 2), page_text), w)"""

_SCORES = f"""SELECT t.page_id, t.url, count(h.keyword)::INT AS matched, coalesce(sum(h.kw_score), 0)::BIGINT AS score,
        (SELECT count(*) FROM (SELECT unnest([{', '.join(lit(w) for w in TITLE_WORDS)}]) AS w) tw
         WHERE contains(t.title_text, tw.w))::INT AS title_hits
    FROM ({_TEXTS}) t LEFT JOIN ({_HITS}) h USING (page_id) GROUP BY t.page_id, t.url, t.title_text"""


@query("keyword_hits", "", f"SELECT page_id, keyword, kw_score::BIGINT AS score FROM ({_HITS}) h")
def keyword_hits(spark, d):
    t = regex_texts(V.pages(spark, d))
    hits = R.keyword_hits("title_text", "meta_text", "heading_text", "page_text", WORDS)
    return t.select("page_id", F.explode(hits).alias("h")).select("page_id", "h.keyword", "h.score")


@query("relevance_score", "", f"SELECT page_id, matched, score, title_hits FROM ({_SCORES}) s")
def relevance_score(spark, d):
    r = J.relevance(regex_texts(V.pages(spark, d)), keywords=WORDS, title_words=TITLE_WORDS)
    return r.select("page_id", "relevance.*")


@query("relevant_pages", "", f"""
    SELECT page_id, matched >= 2 OR score >= 3 OR title_hits >= 1 AS spider,
           (matched >= 3 OR score >= 5 OR title_hits >= 2) AND NOT {s_any('lower(url)', PAGE_BLACKLIST)} AS collector
    FROM ({_SCORES}) s""")
def relevant_pages(spark, d):
    r = J.relevance(regex_texts(V.pages(spark, d)), keywords=WORDS, title_words=TITLE_WORDS)
    return r.select(
        "page_id", F.col("relevant").alias("spider"),
        R.is_relevant(F.col("relevance"), "collector", U.is_blacklisted("url", PAGE_BLACKLIST)).alias("collector"),
    )


@query("relevance_presets", "", f"""
    WITH t AS (SELECT page_id, url, lower({s_unescape(_TITLE_DOM)}) AS title_text, lower({s_unescape(_HEAD_ONLY.format(_HTML))}) AS page_text,
        lower(concat({s_unescape(_H1_DOM)}, ' ')) AS heading_text FROM pages),
    h AS (SELECT page_id, count(*) AS matched, sum(5 * {_n('title_text', 'w')} + 2 * {_n('heading_text', 'w')} + {_n('page_text', 'w')}) AS score
          FROM t JOIN (SELECT unnest([{', '.join(lit(w) for w in rules.COLLECTOR_KEYWORDS)}]) AS w) k
          ON contains(concat(repeat(title_text, 5), repeat(heading_text, 2), page_text), w) GROUP BY page_id)
    SELECT page_id, coalesce(matched, 0)::INT AS matched, coalesce(score, 0)::BIGINT AS score,
           coalesce(matched >= 3 OR score >= 5, false) AS relevant FROM t LEFT JOIN h USING (page_id)""")
def relevance_presets(spark, d):
    r = J.parsed_relevance(V.pages(spark, d), "collector")
    return r.select("page_id", "relevance.matched", "relevance.score", "relevant")


# --- JavaScript need -----------------------------------------------------------------

# Marks put at the end of pages by number; the last leaves the page as it is.
_MARKS = [
    '<script src="/static/REACT.js"></script>', "<script>new  Vue({})</script>", "<NoScript>off</NoScript>",
    "<div class='x' id='app'>x</div>", '<img data-src="a">', '<div class="main container x"> \n </div>',
    '<div id="page-content"></div>', "<p>正在加载</p>", "<div></div>" * 11, "<section> </section>" * 6 + "<div></div>" * 4,
    "<script>var loading = 1;</script>", "<style>.spinner{}</style><b>ok</b>", "<img loading=\"lazy\">", "",
]
_REASONS = ["script-react", "new-vue", "noscript", "id-app", "data-src", "empty-container", "empty-content",
            "placeholder", "placeholder", None, None, None, "lazy-loading", None]


def marked_pages(spark, d):
    marks = F.array(*[F.lit(m) for m in _MARKS])
    i = (F.col("page_id") % len(_MARKS) + 1).cast("int")
    u = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/Dashboard/x"))).otherwise(F.col("url"))
    return V.pages(spark, d).select("page_id", u.alias("url"), F.concat("html", F.element_at(marks, i)).alias("html"))


_MARKED = f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat(url, '/Dashboard/x') ELSE url END AS url,
    concat(html, list_extract([{', '.join(lit(m) for m in _MARKS)}], CAST(page_id % {len(_MARKS)} + 1 AS INT))) AS html FROM pages"""


def _re(p: str) -> str:
    return lit("(?i)" + p)


_BARE = "regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g')"
_PLACEHOLDER = f"""(regexp_matches({_BARE}, '(?i)loading|loader|spinner|正在加载|加载中')
    OR len(regexp_extract_all({_BARE}, '(?i)<div[^>]*>\\s*</div>|<section[^>]*>\\s*</section>|<article[^>]*>\\s*</article>')) > 10)"""
_JS_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(html, {_re(p)}) THEN '{n}'" for n, _, p in rules.JS_HTML_PATTERNS
) + f" WHEN {_PLACEHOLDER} THEN 'placeholder' WHEN regexp_matches(lower(url), '/spa/|/app/|/dashboard/|/admin/') THEN 'url' END"


@query("needs_js", "", f"SELECT page_id, {_JS_CASE} IS NOT NULL AS needs_js, {_JS_CASE} AS js_reason FROM ({_MARKED}) m")
def needs_js(spark, d):
    return marked_pages(spark, d).select("page_id", H.js_reason("url", "html").alias("js_reason")).withColumn(
        "needs_js", F.col("js_reason").isNotNull()
    )


@query("placeholder_pages", "", f"SELECT page_id, {_PLACEHOLDER} AS placeholder FROM ({_MARKED}) m")
def placeholder_pages(spark, d):
    return marked_pages(spark, d).select("page_id", H.has_placeholder("html").alias("placeholder"))


@query("choose_content", "", f"""
    SELECT page_id, md5(CASE WHEN use THEN concat('<!-- rendered -->', html) ELSE html END) AS content_md5, use AS rendered
    FROM (SELECT *, {_JS_CASE} IS NOT NULL AND page_id % 4 <> 0 AS use FROM ({_MARKED}) m) u""")
def choose_content(spark, d):
    rendered = F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("<!-- rendered -->"), "html"))
    c = H.choose_content(F.col("html"), rendered, F.col("url"))
    return marked_pages(spark, d).select("page_id", c.alias("c")).select(
        "page_id", F.md5("c.content").alias("content_md5"), "c.rendered"
    )


@query("page_facts", "", f"""
    SELECT p.page_id, p.url, sha256(html) AS content_hash, octet_length(encode(html))::INT AS content_size,
           'text/html' AS content_type, coalesce(n, 0)::INT AS extracted_urls_count
    FROM pages p LEFT JOIN (SELECT page_id, count(*) AS n FROM ({LINKS_SQL}) l GROUP BY page_id) c USING (page_id)""")
def page_facts(spark, d):
    found = H.resolve_links("url", F.col("hrefs"), PAGE_BLACKLIST)
    return parse_pages(V.pages(spark, d), ["hrefs"], keep_html=True).select(
        "page_id", "url", H.page_facts("html", F.lit("text/html"), found).alias("f")
    ).select("page_id", "url", "f.*")


# --- Markdown text ---------------------------------------------------------------------

# Lines put around a document's own lines, by document number.
_NAV_LINES = ["首页 > 新闻", "更多", "| --- | --- |", "a || b", ">> next", "  　", "矿产资源管理，地质勘探。", "导航", "----", "更多新闻内容介绍"]


def nav_documents(spark, d):
    lines = F.array(*[F.lit(x) for x in _NAV_LINES])
    i = (F.col("doc_id") % len(_NAV_LINES) + 1).cast("int")
    return V.table(spark, d, "documents").select(
        "doc_id", F.concat(F.element_at(lines, i), F.lit("\n \t\n"), "text", F.lit("\n"), F.element_at(lines, -i)).alias("text")
    )


_NAV_DOCS = f"""SELECT doc_id, concat(list_extract(ls, i), chr(10), ' ', chr(9), chr(10), text, chr(10),
        list_extract(ls, {len(_NAV_LINES)} + 1 - i)) AS text
    FROM (SELECT doc_id, text, CAST(doc_id % {len(_NAV_LINES)} + 1 AS INT) AS i,
                 [{', '.join(lit(x) for x in _NAV_LINES)}] AS ls FROM documents) n"""

_WS = rules.WS


def s_strip(t: str) -> str:
    return f"regexp_replace({t}, '^{_WS}+|{_WS}+$', '', 'g')"


NAV_PATTERNS = [re.escape(t).replace("\\-", "-") for t in rules.NAV_TEXTS] + [p for _, p in rules.NAV_REGEXES]
_ANY_NAV = "|".join(f"(?:{p})" for p in NAV_PATTERNS)
def s_filtered(src: str) -> str:
    """A (doc_id, text) source without navigation lines."""
    return f"""SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT (
        line = '' OR regexp_matches(line, {lit(_ANY_NAV)}) OR line IN ({', '.join(lit(x) for x in rules.NAV_EXACT_LINES)})
        OR regexp_matches(line, {lit(rules.NAV_RULE_LINE)})
        OR (length(line) <= 5 AND {s_any('line', rules.NAV_SHORT_WORDS)}))), '') AS text
    FROM (SELECT doc_id, {s_strip('unnest(string_split(text, chr(10)))')} AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM ({src}) nd) ln GROUP BY doc_id"""


_FILTERED = s_filtered(_NAV_DOCS)


@query("nav_filter", "", f"SELECT doc_id, md5(text) AS text_md5, length(text) AS n_chars FROM ({_FILTERED}) f")
def nav_filter(spark, d):
    t = nav_documents(spark, d).select("doc_id", M.filter_nav("text").alias("t"))
    return t.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


def s_quality(src: str) -> str:
    """Scores of a (doc_id, text) source whose text is stripped."""
    hits = " + ".join(f"regexp_matches(text, {lit(p)})::INT" for p in NAV_PATTERNS)
    words = " + ".join(f"contains(text, {lit(w)})::INT" for w in rules.DOMAIN_WORDS)
    return f"""SELECT *, length_score + structure_score + content_score + nav_score + domain_score AS total FROM (
        SELECT doc_id, text_length, keyword_count::INT AS keyword_count,
            CASE WHEN text_length = 0 THEN 0.0::DOUBLE ELSE least(20.0::DOUBLE, text_length / 50.0::DOUBLE) END AS length_score,
            CASE WHEN text_length = 0 THEN 0.0::DOUBLE ELSE structure END AS structure_score,
            substantial_ratio * 30.0::DOUBLE AS content_score, substantial_ratio,
            CASE WHEN text_length = 0 THEN 0.0::DOUBLE ELSE greatest(0, 20 - 5 * nav_hits)::DOUBLE END AS nav_score,
            least(10, 2 * keyword_count)::DOUBLE AS domain_score
        FROM (SELECT doc_id, length(text)::INT AS text_length, {words} AS keyword_count, {hits} AS nav_hits,
                (5 * ((contains(text, '。') OR contains(text, '.'))::INT + contains(text, chr(10))::INT
                 + (len(string_split_regex(text, '{_WS}+')) > 10)::INT + regexp_matches(text, '[：，；、]')::INT))::DOUBLE AS structure,
                CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '{rules.SUBSTANTIAL_CLASS}'))::DOUBLE / length(text)
                     ELSE 0.0::DOUBLE END AS substantial_ratio
              FROM ({src}) s0) s1) s2"""


_DOCS = f"SELECT doc_id, {s_strip('text')} AS text FROM documents"


@query("doc_quality", "", f"""SELECT doc_id, total, length_score, structure_score, content_score, nav_score, domain_score,
    text_length, substantial_ratio, keyword_count FROM ({s_quality(_DOCS)}) q""")
def doc_quality(spark, d):
    return V.table(spark, d, "documents").select("doc_id", M.quality("text").alias("q")).select("doc_id", "q.*")


def s_gated(src: str) -> str:
    """Outcome and reason of a (doc_id, text) source of filtered texts."""
    return f"""SELECT doc_id, text_length, total,
    CASE WHEN text_length < 200 OR total < 40 THEN 'skipped' ELSE 'success' END AS outcome,
    CASE WHEN text_length < 200 THEN concat('内容长度不足：', text_length, '字符 < 200字符')
         WHEN total < 40 THEN concat('内容质量不达标：', printf('%.1f', total), '分 < 40分') END AS reason
    FROM ({s_quality(src)}) q"""


_GATED = s_gated(_FILTERED)
_MD_FILTERED = s_filtered(_MD_PAGES)
_MD_GATED = f"""SELECT f.doc_id AS page_id, f.text, g.total, g.outcome, g.reason
    FROM ({_MD_FILTERED}) f JOIN ({s_gated(_MD_FILTERED)}) g USING (doc_id)"""


@query("quality_gate", "", f"SELECT doc_id, outcome, reason FROM ({_GATED}) g")
def quality_gate(spark, d):
    g = F.inline(F.array(M.assess("text")))
    return nav_documents(spark, d).select("doc_id", g).select("doc_id", "outcome", "reason")


@query("clean_markdown", "", f"""
    SELECT doc_id, md5(f.text) AS text_md5 FROM ({_FILTERED}) f JOIN ({_GATED}) g USING (doc_id) WHERE g.outcome = 'success'""")
def clean_markdown(spark, d):
    t = nav_documents(spark, d).select("doc_id", F.inline(F.array(M.assess("text"))))
    return t.filter("outcome = 'success'").select("doc_id", F.md5("clean").alias("text_md5"))


@query("md_summary", "", f"""
    SELECT count(*) AS total, count(*) FILTER (outcome = 'success') AS success, count(*) FILTER (outcome = 'failed') AS failed,
           count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'existing') AS existing
    FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN 'existing' WHEN doc_id % 11 = 0 THEN 'failed' ELSE outcome END AS outcome FROM ({_GATED}) g) o""")
def md_summary(spark, d):
    docs = nav_documents(spark, d).select(
        F.col("doc_id"), F.concat("doc_id", F.lit(".md")).alias("md_name"),
        (F.col("doc_id") % 11 == 0).alias("empty"), F.col("text").alias("markdown"),
    )
    old = V.table(spark, d, "documents").filter("doc_id % 9 = 0").select(F.concat("doc_id", F.lit(".md")).alias("md_name"))
    done = IO.gate_markdown(IO.skip_existing(docs, old)).select("outcome")
    kept = docs.select("md_name").join(old, "md_name", "left_semi").select(F.lit("existing").alias("outcome"))
    return RP.md_summary(done.unionByName(kept))
