"""End-to-end jobs composed of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe import rules
from crawlframe.functions import fetch as FT
from crawlframe.functions import html as H
from crawlframe.functions import relevance as R
from crawlframe.functions import urls as U
from crawlframe.functions.text import strip
from crawlframe.operators import frontier as FR
from crawlframe.operators import graph as G
from crawlframe.operators.parse import parse_pages
from crawlframe.session import broadcast_if_small, cut_lineage
from crawlframe.sources import files as IO


def url_filter(df: DataFrame, url: str = "url", domains: list[str] | None = None,
               extra: Column | None = None) -> DataFrame:
    """First item stage: valid, not a document, inside the allowed domains."""
    ok = U.is_valid_url(url) & ~U.is_document_file(url)
    if domains:
        ok = ok & U.in_domains(url, domains)
    if extra is not None:
        ok = ok & extra
    return df.filter(F.coalesce(ok, F.lit(False)))


def relevance(pages: DataFrame, preset: str = "spider", keywords: list[str] | None = None,
              title_words: list[str] | None = None, blacklist: list[str] | None = None) -> DataFrame:
    """Pages with their relevance features and verdict, from the parsed page.

    Needs columns title_text, meta_text, heading_text and page_text in lower case.
    """
    p = rules.RELEVANCE_PRESETS[preset]
    hits = R.keyword_hits(
        "title_text", "meta_text", "heading_text", "page_text", keywords or p["keywords"]
    )
    staged = pages.withColumn("hits", hits)
    feats = R.relevance_features(F.col("hits"), F.col("title_text"), title_words or p["title_words"])
    staged = staged.withColumn("relevance", feats)
    bad = U.is_blacklisted("url", blacklist) if blacklist else None
    return staged.withColumn("relevant", R.is_relevant(F.col("relevance"), preset, bad))


def parsed_relevance(pages: DataFrame, preset: str = "spider", **kw) -> DataFrame:
    """`relevance` over raw HTML pages (url, html)."""
    texts = ["title_text", "page_text", "meta_text", "heading_text"]
    return relevance(parse_pages(pages, texts), preset, **kw)


def crawl_step(pages: DataFrame, frontier: DataFrame, blacklist: list[str] | None = None) -> DataFrame:
    """New frontier rows found on fetched pages, with the least source and depth.

    A link lies one level below the page it was read on; a page that the
    frontier does not know counts as a start page (depth 0).
    """
    known = frontier.groupBy(F.col("url").alias("src")).agg(F.min("depth").alias("_d"))
    links = G.page_links(pages, blacklist=blacklist).join(known, "src", "left")
    candidates = links.select(
        F.col("dst").alias("url"), F.col("src").alias("source_url"),
        (F.coalesce("_d", F.lit(0)) + 1).alias("depth"),
    )
    return FR.new_urls(frontier, candidates)


def judge_fetches(fetched: DataFrame, preset: str = "spider", strict: bool = False,
                  keywords: list[str] | None = None, title_words: list[str] | None = None,
                  blacklist: list[str] | None = None, topic_gate: bool = True) -> DataFrame:
    """Fetched pages with their outcome and, for good ones, their links.

    Needs url, html, status_code, error_type, content_type. Pages that fail an
    earlier gate are not parsed: their text is left out before the Python stage.
    Without `topic_gate` every page that was read is a good one.
    """
    n_chars = F.length(strip(F.coalesce("html", F.lit(""))))
    gate = FT.classify_fetch(
        F.col("url"), F.col("status_code"), F.col("error_type"), F.col("content_type"),
        n_chars, F.lit(True), strict=strict,
    )
    rows = fetched.select("url", "html", gate.alias("gate")).select("url", "html", "gate.*")
    if strict and blacklist:
        # The collector never asks for such a page, so it gets no mark either.
        banned = U.is_blacklisted("url", blacklist)
        rows = rows.withColumn("status", F.when(banned, "ignored").otherwise(F.col("status"))).withColumn(
            "error_message", F.when(~banned, F.col("error_message"))
        )
    rows = rows.withColumn("html", F.when(F.col("status") == "success", F.col("html")))
    texts = ["title_text", "page_text", "meta_text", "heading_text"] if topic_gate else []
    parsed = parse_pages(rows, ["title", "hrefs", *texts])
    judged = relevance(parsed, preset, keywords, title_words) if topic_gate else parsed.withColumn("relevant", F.lit(True))
    on_topic = (F.col("status") == "success") & F.col("relevant")
    off_topic = (F.col("status") == "success") & ~F.col("relevant")
    return judged.select(
        "url",
        F.when(off_topic, "failed").otherwise(F.col("status")).alias("op"),
        F.when(off_topic, rules.MSG_OFF_TOPIC).otherwise(F.col("error_message")).alias("error_message"),
        F.when(on_topic, F.col("title")).alias("title"),
        F.when(on_topic, H.resolve_links("url", F.col("hrefs"), blacklist)).alias("links"),
    )


def spider_round(fetched: DataFrame, frontier: DataFrame, now: Column, max_depth: int,
                 **judge) -> DataFrame:
    """The frontier after one round of fetches.

    Outcomes are marked on their URLs and the links of good pages above
    `max_depth` are added. The judged pages are written once, for both uses.
    """
    judged = cut_lineage(judge_fetches(fetched, **judge))
    path = F.concat(F.lit("webpages/"), U.page_filename("url"))
    marks = judged.filter(F.col("op") != "ignored").select(
        "url", F.lit(1).alias("seq"), "op", "title",
        F.when(F.col("op") == "success", path).alias("html_file_path"), "error_message", now.alias("ts"),
    )
    known = frontier.filter(F.col("depth") < max_depth).select("url", "depth")
    found = judged.filter(F.col("links").isNotNull()).join(known, "url").select(
        F.explode("links").alias("dst"), F.col("url").alias("source_url"), (F.col("depth") + 1).alias("depth")
    ).withColumnRenamed("dst", "url")
    return FR.add_urls(FR.apply_updates(frontier, marks), found, now)


def collect_urls(fetched: DataFrame, seeds: DataFrame, max_depth: int, **judge) -> DataFrame:
    """URLs reached level by level from the valid, not blacklisted seeds, with
    depth, source and outcome.

    Only pages that are read as text/html, fetched and on topic pass their links
    on. URLs beyond the last level, or without a fetch, stay pending.
    """
    judged = cut_lineage(judge_fetches(fetched, preset="collector", strict=True, **judge))
    edges = judged.filter(F.col("links").isNotNull()).select(
        F.col("url").alias("src"), F.explode("links").alias("dst")
    )
    wanted = U.is_valid_url("url") & ~U.is_blacklisted("url", judge.get("blacklist") or [])
    start = seeds.filter(wanted).select(F.col("url").alias("node"))
    reached = G.expand_collector(edges, start, max_depth)
    outcome = judged.select(F.col("url").alias("node"), "op", "error_message")
    seen = F.col("op").isin("success", "failed") & (F.col("depth") <= max_depth)
    return reached.join(outcome, "node", "left").select(
        F.col("node").alias("url"), F.col("source").alias("source_url"), "depth",
        F.when(seen, F.col("op")).otherwise("pending").alias("status"),
        F.when(seen, F.col("error_message")).alias("error_message"),
    )


def _keys(named: DataFrame) -> DataFrame:
    """One narrow row per distinct page row: its name, what it is made of, and how often it occurs.

    `_order` sorts the pages of a name (by URL, then content); the text is only hashed.
    """
    carried = [c for c in named.columns if c not in ("html", "_id")]
    order = F.struct("url", "_hash", "_id")
    return cut_lineage(named.groupBy("_id").agg(
        *[F.any_value(c).alias(c) for c in carried], F.count(F.lit(1)).alias("_n")).withColumn("_order", order))


def _gated(named: DataFrame, keys: DataFrame, some: DataFrame, min_length: int, min_quality: float,
           columns: list[str]) -> DataFrame:
    """Outcomes of the pages in `some` (of `keys`), one row per distinct page; written, for they are read twice."""
    # Whichever list is shorter meets the pages; within the bound of a broadcast their text stays in place.
    if some.count() <= keys.count() / 2:
        todo = named.join(broadcast_if_small(some.select("_id")), "_id", "left_semi")
    else:
        rest = cut_lineage(keys.join(some.select("_id"), "_id", "left_anti").select("_id"))
        todo = named.join(broadcast_if_small(rest), "_id", "left_anti")
    todo = todo.withColumn("empty", strip(F.coalesce("html", F.lit(""))) == "")
    done = IO.gate_markdown(parse_pages(todo, ["markdown"]), min_length, min_quality)
    done = done.join(some.select("_id", "_n", "_order"), "_id")
    done = done.select(*columns, "_id", "_n", "_order")
    return cut_lineage(done.filter("_n = 1").unionByName(done.filter("_n > 1").dropDuplicates(["_id"])))


def _existing(rows: DataFrame, columns: list[str]) -> DataFrame:
    made = {"outcome": F.lit("existing"), "reason": F.lit(None).cast("string"),
            "clean_markdown": F.lit(None).cast("string"), "quality": F.lit(None).cast("double")}
    return rows.select(*[made[c].alias(c) if c in made else F.col(c) for c in columns])


def pages_to_markdown(pages: DataFrame, existing: DataFrame, min_length: int = 200,
                      min_quality: float = 40, force: bool = False, name: Column | None = None) -> DataFrame:
    """Pages (url, html) to outcomes and clean Markdown; one row per page row.

    Pages of one output name (`name`, by default made from the URL) are tried in the
    order of their URLs until one succeeds; the others are `existing`, as are repeated
    rows of a page that succeeded. That takes two passes however many pages a name
    has: its first page, and all others where that one failed. Pages that need no work
    are told apart by narrow rows before the parse, so Python never reads them. With
    `force` all pages are processed and clashing names get a suffix.
    """
    made = U.md_filename(U.page_filename("url")) if name is None else name
    named = pages.withColumn("md_name", made)
    if force:
        todo = named.withColumn("empty", strip(F.coalesce("html", F.lit(""))) == "")
        return IO.unique_md_names(IO.gate_markdown(parse_pages(todo, ["markdown"]), min_length, min_quality), existing)
    columns = [*[c for c in named.columns if c != "html"], "outcome", "reason", "clean_markdown", "quality"]
    named = named.withColumn("_hash", F.sha2(F.coalesce("html", F.lit("")), 256))
    rest = [c for c in named.columns if c != "html"]
    named = named.withColumn("_id", F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256))
    keys = _keys(named)
    open_ = keys.join(existing.select("md_name").distinct(), "md_name", "left_anti")
    first = open_.groupBy("md_name").agg(F.min("_order").alias("_least"))
    one = cut_lineage(open_.join(first.select(F.col("_least._id").alias("_id")), "_id", "left_semi"))
    done = _gated(named, keys, one, min_length, min_quality, columns)
    tried = one
    thin = done.filter("outcome <> 'success'").select("md_name")
    others = cut_lineage(open_.join(thin, "md_name", "left_semi").join(one.select("_id"), "_id", "left_anti"))
    if not others.isEmpty():
        more = _gated(named, keys, others, min_length, min_quality, columns)
        best = more.filter("outcome = 'success'").groupBy(F.col("md_name").alias("_name")).agg(F.min("_order").alias("_best"))
        more = more.join(best, F.col("md_name") == F.col("_name"), "left")
        late = F.coalesce(F.col("_order") > F.col("_best"), F.lit(False))
        more = more.withColumn("_late", late).drop("_name", "_best")
        done = done.unionByName(more.filter("not _late").drop("_late")).unionByName(
            _existing(more.filter("_late"), [*columns, "_id", "_n", "_order"]).select(*done.columns))
        tried = one.unionByName(others)
    # Repeated rows: the output of a success exists for its copies, a failure is theirs too.
    copies = done.filter("_n > 1").withColumn("_copy", F.explode(F.sequence(F.lit(2), F.col("_n"))))
    failed = copies.filter("outcome <> 'success'").select(*columns)
    served = _existing(copies.filter("outcome = 'success'"), columns)
    left = keys.join(tried.select("_id"), "_id", "left_anti")
    left = _existing(left.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))), columns)
    return done.select(*columns).unionByName(failed).unionByName(served).unionByName(left)
