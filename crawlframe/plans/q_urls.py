"""Registered queries over URLs, names and small text values."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlframe import rules
from crawlframe.functions import fetch as FT
from crawlframe.functions import text as X
from crawlframe.functions import urls as U
from crawlframe.operators import dedup as D
from crawlframe.operators import lookup as L
from crawlframe.operators.parse import decode_pages
from crawlframe.plans import views as V
from crawlframe.plans.registry import query


# --- SQL pieces ------------------------------------------------------------------

def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def part(u: str, n: int) -> str:
    return f"regexp_extract({u}, '{_SPLIT}', {n})"


def s_path(u: str) -> str:
    return f"regexp_replace({part(u, 3)}, ';[^/]*$', '')"


def s_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def s_ext(u: str, extensions) -> str:
    return f"regexp_matches(lower({s_path(u)}), '\\.({'|'.join(extensions)})$')"


def s_valid(u: str) -> str:
    return f"(lower({part(u, 1)}) IN ('http', 'https') AND {part(u, 2)} <> '')"


def s_should(u: str, blacklist=None) -> str:
    ok = f"NOT {s_ext(u, rules.STATIC_EXTENSIONS)} AND NOT {s_any(f'lower({u})', rules.API_PATTERNS)}"
    return ok + (f" AND NOT {s_any(f'lower({u})', blacklist)}" if blacklist else "")


# Rules for the test pages, added to the default list.
PAGE_BLACKLIST = rules.BLACKLIST + ["spam-farm", "cheap-pills", "utm_", ".html"]


def flag(name: str, column, sql_column: str):
    """A query that gives one computed value per URL shape; `column` makes the expression."""

    @query(name, "url_variants", f"SELECT page_id, k, url, {sql_column} AS flag FROM url_variants")
    def run(spark, d):
        return V.url_variants(spark, d).select("page_id", "k", "url", column().alias("flag"))

    return run


flag("valid_urls", lambda: U.is_valid_url("url"), s_valid("url"))
flag("doc_ext_filter", lambda: U.is_document_file("url"), s_ext("url", rules.DOCUMENT_EXTENSIONS))
flag("static_ext_filter", lambda: U.is_static_file("url"), s_ext("url", rules.STATIC_EXTENSIONS))
flag("api_filter", lambda: U.is_api_or_download("url"), s_any("lower(url)", rules.API_PATTERNS))
flag("blacklist_flag", lambda: U.is_blacklisted("url", PAGE_BLACKLIST), s_any("lower(url)", PAGE_BLACKLIST))
flag("should_crawl", lambda: U.should_crawl("url", PAGE_BLACKLIST), s_should("url", PAGE_BLACKLIST))
flag("should_crawl_spider", lambda: U.should_crawl("url"), s_should("url"))
flag(
    "url_needs_js", lambda: U.url_needs_js("url"),
    f"NOT {s_ext('url', rules.JS_URL_STATIC_EXTENSIONS)} AND {s_any('lower(url)', rules.JS_URL_WORDS)}",
)
flag(
    "allowed_domains", lambda: U.in_domains("url", ["example.com", "ththat.example.net"]),
    "(" + " OR ".join(
        f"lower({part('url', 2)}) = {lit(d)} OR ends_with(lower({part('url', 2)}), {lit('.' + d)})"
        for d in ("example.com", "ththat.example.net")
    ) + ")",
)


@query("url_hint", "url_variants", f"""
    SELECT page_id, k, {s_any('lower(url)', rules.URL_HINT_WORDS['spider'])} AS spider_hit,
           {s_any('lower(url)', rules.URL_HINT_WORDS['collector'])} AS collector_hit,
           {s_any('lower(url)', rules.INSTITUTION_MARKS)} AS inst_hit, true AS gate
    FROM url_variants""")
def url_hint(spark, d):
    spider, collector = U.url_hint("url", "spider"), U.url_hint("url", "collector")
    return V.url_variants(spark, d).select(
        "page_id", "k", spider["kw_hit"].alias("spider_hit"), collector["kw_hit"].alias("collector_hit"),
        spider["inst_hit"].alias("inst_hit"), spider["gate"].alias("gate"),
    )


# References tried on every page, with the absolute form the check expects:
# {s} scheme, {h} host, {p} path, {q} query with its mark, {d} folder of the page.
_REFS = [
    ("", "{s}://{h}{p}{q}"),
    ("#part", "{s}://{h}{p}{q}"),
    ("?only=query", "{s}://{h}{p}?only=query"),
    ("/abs/path?x=1#y", "{s}://{h}/abs/path?x=1"),
    ("rel/page.html", "{s}://{h}{d}rel/page.html"),
    ("./here", "{s}://{h}{d}here"),
    ("../../../../top", "{s}://{h}/top"),
    ("/a/./b/../c/", "{s}://{h}/a/c/"),
    ("/a/b/..", "{s}://{h}/a/"),
    ("//other.example/x", "{s}://other.example/x"),
    ("http://fixed.example/k/../m", "http://fixed.example/k/../m"),
    ("mailto:someone@example.com", "mailto:someone@example.com"),
    ("javascript:void(0)", "javascript:void(0)"),
]


def _page_part(n: int) -> str:
    return part("url", n)


_FILL = (
    "replace(replace(replace(replace(replace(want, '{s}', sch), '{h}', host), '{p}', pth), '{q}', qry), '{d}', dir)"
)


@query("normalize_url", "", f"""
    SELECT page_id, ref, {_FILL} AS full_url
    FROM (SELECT page_id, {_page_part(1)} AS sch, {_page_part(2)} AS host, {_page_part(3)} AS pth,
                 CASE WHEN {_page_part(4)} <> '' THEN concat('?', {_page_part(4)}) ELSE '' END AS qry,
                 regexp_extract({_page_part(3)}, '^(.*/)', 1) AS dir
          FROM pages) p,
         (VALUES {', '.join(f'({lit(r)}, {lit(w)})' for r, w in _REFS)}) v(ref, want)""")
def normalize_url(spark, d):
    refs = F.array(*[F.lit(r) for r, _ in _REFS])
    p = V.pages(spark, d).select("page_id", "url", F.explode(refs).alias("ref"))
    return p.select("page_id", "ref", U.url_join("url", "ref").alias("full_url"))


@query("html_gate", "attempts_v", f"""
    SELECT event_id, content_type, u AS url,
           (regexp_matches(content_type, 'text/html|application/xhtml\\+xml|application/xml|text/xml')
            OR (trim(content_type) = '' AND ({s_path('lower(u)')} = ''
                OR regexp_matches({s_path('lower(u)')}, '(/|\\.html|\\.htm)$')))) AS is_html,
           contains(content_type, 'text/html') AS strict_html
    FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN concat(url, '/') WHEN event_id % 3 = 1 THEN concat(url, '.HTML')
                         ELSE url END AS u FROM attempts_v) a""")
def html_gate(spark, d):
    k = F.col("event_id") % 3
    u = F.when(k == 0, F.concat("url", F.lit("/"))).when(k == 1, F.concat("url", F.lit(".HTML"))).otherwise(F.col("url"))
    a = V.attempts_v(spark, d).withColumn("url", u)
    return a.select(
        "event_id", "content_type", "url", U.is_html("content_type", "url").alias("is_html"),
        U.is_html("content_type", "url", strict=True).alias("strict_html"),
    )


_LAST = f"regexp_extract({s_path('url')}, '([^/]+)/*$', 1)"
_PAGE_NAME = f"""regexp_replace(concat(substr(md5(url), 1, 8), '_',
    CASE WHEN {_LAST} = '' THEN regexp_replace({part('url', 2)}, '[:.]', '_', 'g')
         ELSE regexp_replace({_LAST}, '\\.[^.]*$', '') END, '.html'), '[<>:"/\\\\|?*]', '_', 'g')"""


@query("page_filename", "url_variants", f"""
    SELECT page_id, k, name AS file_name, replace(name, '.html', '_metadata.json') AS metadata_name
    FROM (SELECT page_id, k, {_PAGE_NAME} AS name FROM url_variants) n""")
def page_filename(spark, d):
    name = U.page_filename("url")
    return V.url_variants(spark, d).select(
        "page_id", "k", name.alias("file_name"), U.metadata_filename(name).alias("metadata_name")
    )


_SITE = f"""substr(CASE WHEN trim({s_path('url')}, '/') <> ''
    THEN concat(replace({part('url', 2)}, ':', '_'), '_', regexp_replace(trim({s_path('url')}, '/'), '[/\\\\]', '_', 'g'))
    ELSE replace({part('url', 2)}, ':', '_') END, 1, 150)"""


@query("site_filename", "url_variants", f"""
    WITH named AS (SELECT DISTINCT url, {_SITE} AS stem FROM url_variants),
    ranked AS (SELECT url, stem, row_number() OVER (PARTITION BY stem ORDER BY substr(md5(url), 1, 3), url) AS r
               FROM named)
    SELECT url, CASE WHEN r = 1 THEN concat(stem, '.html') ELSE concat(stem, '_', r - 1, '.html') END AS file_name
    FROM ranked""")
def site_filename(spark, d):
    return D.site_filenames(V.url_variants(spark, d).select("url").distinct()).select("url", "file_name")


def _s_md(base: str) -> str:
    clean = f"trim(regexp_replace(regexp_replace({base}, '[^\\p{{L}}\\p{{N}}_\\-]', '_', 'g'), '_+', '_', 'g'), '_')"
    return f"concat(CASE WHEN {clean} = '' THEN 'page' ELSE {clean} END, '.md')"


_STEM = f"regexp_replace({_PAGE_NAME}, '\\.html$', '')"
_BASE = f"""CASE WHEN {_LAST} NOT IN ('', 'index') THEN {_LAST}
    WHEN {_LAST} = '' AND contains({part('url', 2)}, '.')
    THEN split_part({part('url', 2)}, '.', length({part('url', 2)}) - length(replace({part('url', 2)}, '.', '')))
    ELSE 'given' END"""


@query("md_filename", "url_variants", f"""
    SELECT page_id, k, {_s_md(_STEM)} AS from_file, {_s_md(_BASE)} AS from_url FROM url_variants""")
def md_filename(spark, d):
    return V.url_variants(spark, d).select(
        "page_id", "k", U.md_filename(U.page_filename("url")).alias("from_file"),
        U.md_filename(F.lit("dir/given.html"), "url").alias("from_url"),
    )


@query("fetch_outcome", "attempts_v", f"""
    WITH a AS (SELECT *, CAST(event_id % 40 AS INT) AS n_chars, event_id % 5 <> 0 AS relevant FROM attempts_v),
    m AS (SELECT *, CASE
        WHEN error_type = 'timeout' THEN '请求超时 (30秒)'
        WHEN status_code <> 200 THEN concat('HTTP ', status_code)
        WHEN NOT regexp_matches(content_type, 'text/html|application/xml') THEN concat('非HTML内容类型: ', content_type)
        WHEN n_chars < 10 THEN 'HTML内容为空或过短'
        WHEN NOT relevant THEN '页面内容与目标主题不相关' END AS error_message FROM a)
    SELECT event_id, CASE WHEN error_message IS NULL THEN 'success' ELSE 'failed' END AS status, error_message FROM m""")
def fetch_outcome(spark, d):
    c = FT.classify_fetch(
        F.col("url"), F.col("status_code"), F.col("error_type"), F.col("content_type"),
        (F.col("event_id") % 40).cast("int"), F.col("event_id") % 5 != 0,
    )
    return V.attempts_v(spark, d).select("event_id", c.alias("c")).select("event_id", "c.status", "c.error_message")


@query("fetch_outcome_collector", "attempts_v", """
    SELECT event_id, CASE WHEN error_type IS NULL AND status_code = 200 AND NOT contains(content_type, 'text/html')
                     THEN 'ignored' WHEN m IS NULL THEN 'success' ELSE 'failed' END AS status, m AS error_message
    FROM (SELECT *, CASE WHEN error_type IS NOT NULL THEN 'Request Exception: read timed out'
                         WHEN status_code <> 200 THEN concat('HTTP ', status_code)
                         WHEN NOT contains(content_type, 'text/html') THEN NULL
                         WHEN event_id % 5 = 0 THEN '页面内容与目标主题不相关' END AS m FROM attempts_v) x""")
def fetch_outcome_collector(spark, d):
    c = FT.classify_fetch(
        F.col("url"), F.col("status_code"), F.col("error_type"), F.col("content_type"),
        F.lit(100), F.col("event_id") % 5 != 0, detail=F.lit("read timed out"), strict=True,
    )
    return V.attempts_v(spark, d).select("event_id", c.alias("c")).select("event_id", "c.status", "c.error_message")


@query("header_charset", "attempts_v", """
    SELECT event_id, nullif(trim(regexp_extract(lower(h), 'charset=([^;]*)', 1)), '') AS charset
    FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN content_type
            WHEN 1 THEN concat('Text/HTML; Charset= GBK-', event_id, ' ; x=1') ELSE 'text/html; charset=' END AS h
          FROM attempts_v) a""")
def header_charset(spark, d):
    k = F.col("event_id") % 3
    made = F.concat(F.lit("Text/HTML; Charset= GBK-"), F.col("event_id").cast("string"), F.lit(" ; x=1"))
    h = F.when(k == 0, F.col("content_type")).when(k == 1, made).otherwise("text/html; charset=")
    return V.attempts_v(spark, d).select("event_id", X.header_charset(h).alias("charset"))


_CHINESE = "矿产资源勘探开发与地质调查工作"


# All bytes of all pages. Chinese in front of a page decides for UTF-8, whatever the header says; pages of ASCII
# come also with Chinese in GB2312 bytes, or plain, which leaves them to the response's own charset.
_ASCII_ONLY = "regexp_matches(html, '^[\\x00-\\x7F]*$')"


@query("decode_pages", "", f"""
    SELECT page_id, CASE WHEN ascii AND page_id % 3 = 1 THEN 'gb2312' WHEN ascii AND page_id % 3 = 2 THEN 'latin-1' ELSE 'utf-8' END AS charset,
        md5(CASE WHEN ascii AND page_id % 3 = 2 THEN html ELSE concat('{_CHINESE}', html) END) AS text_md5
    FROM (SELECT page_id, html, {_ASCII_ONLY} AS ascii FROM pages) p""")
def decode_pages_query(spark, d):
    k = F.col("page_id") % 3
    plain = F.col("html").rlike(r"^[\x00-\x7F]*$")
    own = F.encode("html", "UTF-8")
    front = F.when(plain & (k == 1), F.lit(bytearray(_CHINESE.encode("gb2312")))).when(
        plain & (k == 2), F.lit(bytearray())).otherwise(F.lit(bytearray(_CHINESE.encode())))
    raw = V.pages(spark, d).select(
        "page_id", F.concat(front, own).alias("body"),
        F.when(k == 0, "text/html; charset=latin-1").otherwise("text/html").alias("content_type"),
        F.lit("latin-1").alias("original_charset"),
    )
    return decode_pages(raw).select("page_id", "charset", F.md5("html").alias("text_md5"))


@query("size_label", "", """
    SELECT o_orderkey, size,
           CASE WHEN size < 1024 THEN concat(size, ' B') WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0)
                WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576.0)
                ELSE printf('%.1f GB', size / 1073741824.0) END AS size_label
    FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey * 37 + o_orderkey % 1500 AS BIGINT) AS size FROM orders) o""")
def size_label(spark, d):
    k = F.col("o_orderkey")
    o = V.table(spark, d, "orders").select("o_orderkey", (k * k * 37 + k % 1500).cast("long").alias("size"))
    return o.select("o_orderkey", "size", X.size_label("size").alias("size_label"))


@query("size_label_short", "", """
    SELECT o_orderkey, CASE WHEN size < 1024 THEN concat(size, ' B')
        ELSE concat(regexp_replace(concat(h // 100, '.', lpad(CAST(h % 100 AS VARCHAR), 2, '0')), '\\.?0+$', ''), unit) END AS size_label
    FROM (SELECT *, CASE WHEN size < 1048576 THEN (size * 100 + 512) // 1024
                         WHEN size < 1073741824 THEN (size * 100 + 524288) // 1048576
                         ELSE (size * 100 + 536870912) // 1073741824 END AS h,
                    CASE WHEN size < 1048576 THEN ' KB' WHEN size < 1073741824 THEN ' MB' ELSE ' GB' END AS unit
          FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey * 37 + o_orderkey % 1500 AS BIGINT) AS size FROM orders) o) s""")
def size_label_short(spark, d):
    k = F.col("o_orderkey")
    o = V.table(spark, d, "orders").select("o_orderkey", (k * k * 37 + k % 1500).cast("long").alias("size"))
    return o.select("o_orderkey", X.size_label_short("size").alias("size_label"))


_LOG_WORDS = ["[info] request", "ERROR in", "job failed", "Warning: slow", "warn", "success after error", "completed"]


def log_lines(events):
    """Log lines made from events; the words cover every level."""
    words = F.array(*[F.lit(w) for w in _LOG_WORDS])
    i = (F.col("event_id") % len(_LOG_WORDS) + 1).cast("int")
    line = F.concat(F.element_at(words, i), F.lit(" "), F.col("props"), F.lit(" #"), F.col("event_id").cast("string"))
    return events.select("event_id", line.alias("line"))


LOG_LINES_SQL = f"""SELECT event_id, concat(list_extract([{', '.join(lit(w) for w in _LOG_WORDS)}],
    CAST(event_id % {len(_LOG_WORDS)} + 1 AS INT)), ' ', props, ' #', event_id) AS line FROM events"""
LOG_LEVEL_SQL = """CASE WHEN regexp_matches(upper(line), 'ERROR|FAILED') THEN 'error'
    WHEN regexp_matches(upper(line), 'WARN') THEN 'warning'
    WHEN regexp_matches(upper(line), 'SUCCESS|COMPLETED') THEN 'success' ELSE 'info' END"""


@query("log_level", "", f"SELECT event_id, line, {LOG_LEVEL_SQL} AS level FROM ({LOG_LINES_SQL}) l")
def log_level(spark, d):
    return log_lines(V.table(spark, d, "events")).withColumn("level", X.log_level("line"))


@query("iso_times", "", """
    SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                     ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso, strftime(ts, '%Y%m%d_%H%M%S') AS stamp
    FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN date_trunc('second', CAST(ts AS TIMESTAMP))
                           ELSE CAST(ts AS TIMESTAMP) END AS ts FROM events) e""")
def iso_times(spark, d):
    k = F.col("event_id") % 4
    ts = F.col("ts").cast("timestamp")
    t = F.when(k == 0, F.lit(None).cast("timestamp")).when(k == 1, F.date_trunc("second", ts)).otherwise(ts)
    e = V.table(spark, d, "events").select("event_id", t.alias("t"))
    return e.select("event_id", X.iso_ts("t").alias("iso"), X.stamp("t").alias("stamp"))


@query("blacklist_join", "", f"""
    WITH r AS (SELECT DISTINCT concat('/', lower(substr(c_name, length(c_name) - 2, 3))) AS rule FROM customer
               UNION SELECT unnest([{', '.join(lit(x) for x in PAGE_BLACKLIST)}]))
    SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM r WHERE contains(lower(p.url), r.rule))""")
def blacklist_join(spark, d):
    return L.drop_blacklisted(V.pages(spark, d).select("page_id", "url"), "url", _rule_table(spark, d))


def _rule_table(spark, d):
    """The page blacklist and rules drawn from customer names."""
    c = V.table(spark, d, "customer")
    drawn = c.select(F.concat(F.lit("/"), F.lower(F.substr("c_name", F.length("c_name") - 2, F.lit(3)))).alias("rule"))
    fixed = spark.createDataFrame([(x,) for x in PAGE_BLACKLIST], "rule string")
    return drawn.unionByName(fixed).distinct()


@query("blacklist_matches", "", f"""
    WITH r AS (SELECT DISTINCT concat('/', lower(substr(c_name, length(c_name) - 2, 3))) AS rule FROM customer
               UNION SELECT unnest([{', '.join(lit(x) for x in PAGE_BLACKLIST)}]))
    SELECT page_id, rule FROM pages p JOIN r ON contains(lower(p.url), r.rule)""")
def blacklist_matches(spark, d):
    # A limit of zero inline rules takes the equi-join over text pieces.
    low = V.pages(spark, d).select("page_id", F.lower("url").alias("low"))
    return L.substring_matches(low, "low", "page_id", _rule_table(spark, d), inline_rules=0)


@query("allowed_domain_join", "", f"""
    WITH dom AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS domain FROM pages WHERE page_id % 5 = 0)
    SELECT page_id, url FROM pages p WHERE EXISTS (SELECT 1 FROM dom
        WHERE lower({part('p.url', 2)}) = lower(domain) OR ends_with(lower({part('p.url', 2)}), concat('.', lower(domain))))""")
def allowed_domain_join(spark, d):
    p = V.pages(spark, d).select("page_id", "url")
    domains = p.filter("page_id % 5 = 0").select(U.authority("url").alias("domain")).distinct()
    return L.in_allowed_domains(p, "url", domains)
