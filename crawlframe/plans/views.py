"""Input views of the registered queries, as DataFrames and as SQL.

Both forms of a view give the same rows; FIXTURES.md describes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.operators.ranking import running_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark, d) -> DataFrame:
    return table(spark, d, "pages")


# URL shapes made from every page: {u} its URL, {h} its host, {i} its number.
URL_TEMPLATES = [
    "{u}", "http://{h}/files/report{i}.PDF", "https://{h}/a{i}/b.zip;v=2", "http://{h}/img/{i}.jpeg?x=.html",
    "https://{h}/style{i}.css#top", "http://{h}/api/data/{i}", "http://{h}/x?download={i}",
    "https://{h}/x.html?a={i}&download=2", "http://{h}/mining/site{i}", "https://{h}/app/react/{i}",
    "http://{h}/search?q=vue{i}", "https://www.{h}.gov.cn/x{i}", "http://{h}/ads.{i}/",
    "http://{h}/game/torrent{i}", "http://{h}/page{i}", "https://{h}/index{i}.htm", "http://{h};p{i}.pdf",
    "http://{h}:8080/p{i}/", "ftp://{h}/{i}", "HTTP://{h}/UP{i}.html", "mailto:u{i}@{h}", "plain text {i}",
    "//{h}/{i}.html", "https://{h}", "http://{h}/download.php?id={i}", "https://{h}/dir{i}/",
    "https://sub.{h}/矿产/地质{i}", "http://{h}/a|b<{i}>.tar.gz", "https:///nohost{i}",
]


def url_variants(spark, d) -> DataFrame:
    """(page_id, k, url): each page in every URL shape."""
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    shapes = F.array(*[F.lit(t) for t in URL_TEMPLATES])
    p = pages(spark, d).select("page_id", "url", host.alias("h"))
    x = p.select("page_id", "url", "h", F.posexplode(shapes).alias("k", "t"))
    u = F.replace("t", F.lit("{u}"), F.col("url"))
    u = F.replace(u, F.lit("{h}"), F.col("h"))
    u = F.replace(u, F.lit("{i}"), F.col("page_id").cast("string"))
    return x.select("page_id", "k", u.alias("url"))


def urls_v(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    st = (
        F.when(key % 10 == 0, "crawling").when(F.col("o_orderstatus") == "P", "pending")
        .when(F.col("o_orderstatus") == "O", "success").otherwise("failed")
    )
    text = key.cast("string")
    host = F.concat(F.lit("https://c"), F.col("o_custkey").cast("string"), F.lit(".example.com/"))
    at = F.col("o_orderdate").cast("timestamp")
    return o.withColumn("st", st).select(
        F.concat(host, F.lit("o/"), text).alias("url"),
        host.alias("source_url"),
        F.col("st").alias("status"),
        (key % 4).cast("int").alias("depth"),
        F.when((F.col("st") == "success") & (key % 5 != 0), F.col("o_orderpriority")).alias("title"),
        F.when(
            F.col("st") == "success",
            F.concat(F.lit("webpages/"), F.substring(F.md5(text), 1, 8), F.lit("_"), text, F.lit(".html")),
        ).alias("html_file_path"),
        at.alias("created_time"),
        F.when(F.col("st").isin("success", "failed") & (key % 11 != 0), at + F.expr("INTERVAL '1' DAY"))
        .alias("crawled_time"),
        F.when(F.col("st") == "failed", F.concat(F.lit("HTTP "), (400 + key % 5).cast("string")))
        .alias("error_message"),
    )


def _event_url() -> F.Column:
    return F.concat(
        F.lit("https://h"), (F.col("user_id") % 7).cast("string"),
        F.lit(".example.com/p/"), F.col("user_id").cast("string"),
    )


def log_columns(events: DataFrame) -> DataFrame:
    """The crawl log of an events table, batch or stream."""
    t, seq = F.col("event_type"), F.col("event_id")
    op = (
        F.when(t.isin("signup", "click"), "add").when(t == "view", "crawling")
        .when(t == "purchase", "success").otherwise("failed")
    )
    url = _event_url()
    return events.select(
        seq.alias("seq"), F.col("ts").cast("timestamp").alias("ts"), url.alias("url"), op.alias("op"),
        (seq % 4).cast("int").alias("depth"),
        F.concat(F.lit("https://h"), (seq % 5).cast("string"), F.lit(".example.com/")).alias("source_url"),
        F.when((op == "success") & (seq % 13 != 0), F.col("props")).alias("title"),
        F.when((op == "success") & (seq % 13 != 0),
               F.concat(F.lit("webpages/"), F.substring(F.md5(url), 1, 8), F.lit(".html")))
        .alias("html_file_path"),
        F.when(op == "failed", F.col("props")).alias("error_message"),
    )


def log_v(spark, d) -> DataFrame:
    return log_columns(table(spark, d, "events"))


def edges_v(spark, d) -> DataFrame:
    """Link graph over page numbers: three links per page."""
    p = table(spark, d, "pages").select("page_id")
    steps = "array(struct(3 AS a, 1 AS b), struct(5 AS a, 2 AS b), struct(7 AS a, 3 AS b))"
    return p.sparkSession.sql(
        f"""SELECT page_id AS src, (page_id * m.a + m.b) % (SELECT count(*) FROM {{p}}) AS dst
            FROM (SELECT page_id, explode({steps}) AS m FROM {{p}})""",
        p=p,
    )


def attempts_v(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    t = F.col("event_type")
    e = running_index(e, ["user_id"], "event_id", "nth")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), _event_url().alias("url"),
        (F.col("user_id") % 3).alias("run_id"),
        F.when(t.isin("view", "purchase"), 200).when(t == "click", 404).when(t == "signup", 503)
        .alias("status_code"),
        F.when(t == "error", "timeout").alias("error_type"),
        F.element_at(
            F.array(*[F.lit(x) for x in ("text/html; charset=utf-8", "application/xml", "image/png", "")]),
            (F.col("event_id") % 4 + 1).cast("int"),
        ).alias("content_type"),
        (F.col("nth") % 5).cast("int").alias("attempt"),
    )


# --- the same views for the check database ------------------------------------

_TEMPLATE_ROWS = ", ".join(
    "({}, '{}')".format(i, t.replace("'", "''")) for i, t in enumerate(URL_TEMPLATES)
)

SQL = {
    "url_variants": f"""
        SELECT page_id, k, replace(replace(replace(t, '{{u}}', url), '{{h}}', h),
                                   '{{i}}', CAST(page_id AS VARCHAR)) AS url
        FROM (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h FROM pages) p,
             (VALUES {_TEMPLATE_ROWS}) s(k, t)""",
    "urls_v": """
        SELECT concat('https://c', o_custkey, '.example.com/o/', o_orderkey) AS url,
               concat('https://c', o_custkey, '.example.com/') AS source_url,
               st AS status, CAST(o_orderkey % 4 AS INT) AS depth,
               CASE WHEN st = 'success' AND o_orderkey % 5 <> 0 THEN o_orderpriority END AS title,
               CASE WHEN st = 'success' THEN concat('webpages/', substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8),
                                                    '_', o_orderkey, '.html') END AS html_file_path,
               CAST(o_orderdate AS TIMESTAMP) AS created_time,
               CASE WHEN st IN ('success', 'failed') AND o_orderkey % 11 <> 0
                    THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY END AS crawled_time,
               CASE WHEN st = 'failed' THEN concat('HTTP ', 400 + o_orderkey % 5) END AS error_message
        FROM (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN 'crawling' WHEN o_orderstatus = 'P' THEN 'pending'
                             WHEN o_orderstatus = 'O' THEN 'success' ELSE 'failed' END AS st FROM orders) t""",
    "log_v": """
        SELECT seq, ts, url, op, CAST(seq % 4 AS INT) AS depth,
               concat('https://h', seq % 5, '.example.com/') AS source_url,
               CASE WHEN op = 'success' AND seq % 13 <> 0 THEN props END AS title,
               CASE WHEN op = 'success' AND seq % 13 <> 0
                    THEN concat('webpages/', substr(md5(url), 1, 8), '.html') END AS html_file_path,
               CASE WHEN op = 'failed' THEN props END AS error_message
        FROM (SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS ts, props,
                     concat('https://h', user_id % 7, '.example.com/p/', user_id) AS url,
                     CASE event_type WHEN 'signup' THEN 'add' WHEN 'click' THEN 'add' WHEN 'view' THEN 'crawling'
                                     WHEN 'purchase' THEN 'success' ELSE 'failed' END AS op
              FROM events) e""",
    "edges_v": """
        SELECT p.page_id AS src, (p.page_id * m.a + m.b) % n.n AS dst
        FROM pages p CROSS JOIN (SELECT count(*) AS n FROM pages) n
        CROSS JOIN (VALUES (3, 1), (5, 2), (7, 3)) m(a, b)""",
    "attempts_v": """
        SELECT event_id, CAST(ts AS TIMESTAMP) AS ts,
               concat('https://h', user_id % 7, '.example.com/p/', user_id) AS url, user_id % 3 AS run_id,
               CASE WHEN event_type IN ('view', 'purchase') THEN 200 WHEN event_type = 'click' THEN 404
                    WHEN event_type = 'signup' THEN 503 END AS status_code,
               CASE WHEN event_type = 'error' THEN 'timeout' END AS error_type,
               CASE event_id % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/xml'
                                 WHEN 2 THEN 'image/png' ELSE '' END AS content_type,
               CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id)) % 5 AS INT) AS attempt
        FROM events""",
}


def with_views(names: str, body: str) -> str:
    """`body` preceded by the named views as common table expressions."""
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in names.split())
    return f"WITH {ctes}\n{body.strip()}" if names else body.strip()
