"""Registered queries over stored state: automaton rules, visited set, bucketed frontier, live rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlframe.operators import graph as G
from crawlframe.operators import lookup as L
from crawlframe.operators import topk as T
from crawlframe.operators.frontier import FRONTIER_COLUMNS
from crawlframe.operators.grams import GramIndex, search
from crawlframe.plans import views as V
from crawlframe.plans.q_frontier import _bfs_sql, _now, _numbered, _start, candidates, shown, stored_files, updates
from crawlframe.plans.q_io import incoming
from crawlframe.plans.registry import CHECKS, query
from crawlframe.session import scratch
from crawlframe.sources.frontier_store import FrontierStore
from crawlframe.sources.name_registry import NameRegistry

# --- many rules over whole texts -----------------------------------------------------

_WORD_RULES = "SELECT DISTINCT regexp_extract(text, '[a-z]{3,}') AS rule FROM documents"


def word_rules(spark, d):
    """A word of every document as a rule."""
    return V.table(spark, d, "documents").select(F.regexp_extract("text", "[a-z]{3,}", 0).alias("rule"))


@query("blacklist_texts", "", f"""
    SELECT page_id, rule FROM pages JOIN ({_WORD_RULES}) r ON rule <> '' AND contains(html, rule)""")
def blacklist_texts(spark, d):
    return L.substring_matches(V.pages(spark, d), "html", "page_id", word_rules(spark, d))


@query("blacklist_clean", "", f"""
    SELECT page_id FROM pages WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT concat(rule, ' ', rule) AS rule
        FROM ({_WORD_RULES}) w WHERE rule <> '') r WHERE contains(lower(html), r.rule))""")
def blacklist_clean(spark, d):
    twice = word_rules(spark, d).filter("rule <> ''").select(F.concat("rule", F.lit(" "), "rule").alias("rule"))
    return L.drop_blacklisted(V.pages(spark, d).select("page_id", "html"), "html", twice).select("page_id")


# --- contained search ------------------------------------------------------------------

# File names of all lengths: whole ones, ones no path holds, and short ones with a wildcard.
_NAMES = """names AS (SELECT regexp_extract(html_file_path, '([^/]*)$', 1) AS file_name FROM urls_v WHERE html_file_path IS NOT NULL AND depth <> 2
    UNION ALL SELECT concat('stray_', page_id, '.html') FROM pages
    UNION ALL SELECT DISTINCT concat(upper(substr(html_file_path, 10, 4)), '_') FROM urls_v WHERE html_file_path IS NOT NULL AND depth = 2)"""


@query("files_contained", "urls_v", f"""WITH {_NAMES}
    SELECT file_name, coalesce(min(u.url), concat('file://', file_name)) AS url
    FROM names LEFT JOIN urls_v u ON u.html_file_path ILIKE concat('%', file_name, '%') GROUP BY file_name""")
def files_contained(spark, d):
    u = V.urls_v(spark, d)
    short = u.filter("html_file_path IS NOT NULL AND depth = 2").select(
        F.concat(F.upper(F.substring("html_file_path", 10, 4)), F.lit("_")).alias("file_name")).distinct()
    return L.files_with_stored_url(stored_files(spark, d).unionByName(short), u)


def indexed(spark, d):
    u = V.urls_v(spark, d).filter("status = 'success'")
    return u, GramIndex.build(u, "url", ["url", "title"], scratch(spark, "grams"))


@query("search_indexed", "", CHECKS["search_pages"])
def search_indexed(spark, d):
    u, index = indexed(spark, d)
    return T.search_pages(search(u, "url", ["url", "title"], "C1_.ex", index), "C1_.ex")


@query("search_indexed_titles", "urls_v", """
    SELECT url, title FROM urls_v WHERE status = 'success' AND (url ILIKE '%o/1%7_%' OR title ILIKE '%o/1%7_%' OR url ILIKE '%URGENT%' OR title ILIKE '%URGENT%')""")
def search_indexed_titles(spark, d):
    u, index = indexed(spark, d)
    both = [search(u, "url", ["url", "title"], k, index).select("url", "title") for k in ("o/1%7_", "URGENT")]
    return both[0].unionByName(both[1]).distinct()


# --- levels over the stored visited set ------------------------------------------------


@query("bfs_stored", "", _bfs_sql(4))
def bfs_stored(spark, d):
    return _numbered(G.expand_collector(V.edges_v(spark, d), _start(spark, d), 3, stored=True)).select("node", "source", "depth")


# --- the bucketed frontier ----------------------------------------------------------------


def store(spark, d):
    return FrontierStore.create(spark, scratch(spark, "store"), V.urls_v(spark, d), 16)


@query("add_urls_stored", "", CHECKS["add_urls"])
def add_urls_stored(spark, d):
    s = store(spark, d)
    s.add_urls(candidates(spark, d), _now())
    return shown(s.read())


@query("apply_updates_stored", "", CHECKS["apply_updates"])
def apply_updates_stored(spark, d):
    s = store(spark, d)
    s.apply_updates(updates(spark, d))
    return shown(s.read())


@query("import_stored", "", CHECKS["import_frontier"])
def import_stored(spark, d):
    s = store(spark, d)
    s.import_rows(incoming(spark, d).select(*FRONTIER_COLUMNS, "row_id"), "row_id")
    return shown(s.read())


@query("stale_stored", "urls_v", """
    SELECT url, CASE WHEN status = 'crawling' AND created_time < TIMESTAMP '2000-01-01 00:30:00' - INTERVAL 1 HOUR
        THEN 'pending' ELSE status END AS status FROM urls_v""")
def stale_stored(spark, d):
    s = store(spark, d)
    s.reset_stale(_now())
    return s.read().select("url", "status")


@query("stats_kept", "", f"SELECT status, count(*) AS n FROM ({CHECKS['apply_updates']}) u GROUP BY status")
def stats_kept(spark, d):
    s = store(spark, d)
    s.apply_updates(updates(spark, d))
    return s.status_counts()


@query("daily_kept", "", f"""
    SELECT strftime(date, '%Y-%m-%d') AS date, sum(a)::BIGINT AS urls_added, sum(c)::BIGINT AS urls_crawled,
           sum(f)::BIGINT AS urls_failed, sum(p)::BIGINT AS pages_saved
    FROM (SELECT created_time::TIMESTAMP::DATE AS date, 1 AS a, 0 AS c, 0 AS f, 0 AS p FROM ({CHECKS['apply_updates']}) u
          UNION ALL SELECT crawled_time::TIMESTAMP::DATE, 0, (status = 'success')::INT, (status = 'failed')::INT,
                           (status = 'success' AND html_file_path IS NOT NULL)::INT FROM ({CHECKS['apply_updates']}) v
          WHERE crawled_time IS NOT NULL) x
    GROUP BY date HAVING sum(a) + sum(c) + sum(f) > 0""")
def daily_kept(spark, d):
    s = store(spark, d)
    s.apply_updates(updates(spark, d))
    return s.daily_stats().withColumn("date", F.date_format("date", "yyyy-MM-dd"))


# --- names over batches -----------------------------------------------------------------


def site_pages(spark, d):
    """Pages of few stems, in two batches."""
    k = F.col("page_id")
    return V.pages(spark, d).select("page_id", "url", F.concat(F.lit("site"), (k % 9).cast("string")).alias("stem"))


@query("names_registered", "", """
    WITH p AS (SELECT page_id, url, concat('site', page_id % 9) AS stem, page_id % 2 AS half FROM pages),
    r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY half, substr(md5(url), 1, 3), url) - 1 AS n FROM p)
    SELECT stem, url, CASE WHEN n = 0 THEN stem ELSE concat(stem, '_', n) END AS name FROM r""")
def names_registered(spark, d):
    reg = NameRegistry(spark, scratch(spark, "names"), 8)
    rows = site_pages(spark, d)
    reg.assign(rows.filter("page_id % 2 = 0"), "even")
    reg.assign(rows, "all")  # the even pages keep their names
    return reg.names()
