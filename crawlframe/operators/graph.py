"""Link edges and depth-limited expansion over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.functions import html as H
from crawlframe.operators.parse import parse_pages
from crawlframe.operators.visited import Visited
from crawlframe.session import cut_lineage


def page_links(
    pages: DataFrame, hrefs: Column | None = None, blacklist: list[str] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per page and distinct crawlable link (`src`, `dst`, kept columns).

    References come from the parsed page; give `hrefs` where it is parsed already.
    """
    if hrefs is None:
        pages = parse_pages(pages.select(*dict.fromkeys(["url", "html", *(keep or [])])), ["hrefs"])
        hrefs = F.col("hrefs")
    links = H.resolve_links("url", hrefs, blacklist)
    return pages.select(
        *(keep or []), F.col("url").alias("src"), F.explode(links).alias("dst")
    )


def link_edges(pages: DataFrame, frontier: DataFrame, max_depth: int | None = None,
               hrefs: Column | None = None, blacklist: list[str] | None = None) -> DataFrame:
    """Edges (src, dst, depth of dst) of the pages the frontier knows.

    Pages meet their depth before links are exploded: the join moves page rows,
    not edges. With `max_depth`, pages at that depth add no links.
    """
    known = frontier.select("url", "depth")
    if max_depth is not None:
        known = known.filter(F.col("depth") < max_depth)
    if hrefs is None:
        pages = parse_pages(pages.select("url", "html"), ["hrefs"])
        hrefs = F.col("hrefs")
    links = pages.select("url", H.resolve_links("url", hrefs, blacklist).alias("links"))
    return links.join(known, "url").select(
        F.col("url").alias("src"), F.explode("links").alias("dst"),
        (F.col("depth") + 1).alias("depth"),
    )


#: Edges up to which a level is compared with all found nodes in one join, instead of through the stored set.
SMALL_EDGES = 1_000_000


def expand(
    edges: DataFrame, seeds: DataFrame, levels: int, expandable: DataFrame | None = None,
    stored: bool | None = None,
) -> DataFrame:
    """Nodes reached from `seeds` (column `node`) in at most `levels` steps.

    Gives (node, source, depth): the first level that finds a node wins, and of
    its finders the smallest. `expandable` (column `node`) names the nodes whose
    links are followed; the gate is applied to the edges once, before the loop.

    Edges are written once and each level is written before the next: a lost
    executor re-reads files. With `stored` (the default beyond SMALL_EDGES) the nodes
    found so far are a bucketed table with a Bloom filter, which no level moves.
    """
    if expandable is not None:
        gate = expandable.select(F.col("node").alias("src")).distinct()
        edges = edges.join(gate, "src", "left_semi")
    edges = cut_lineage(edges.select("src", "dst"))
    node_type = edges.schema["dst"].dataType
    start = seeds.select(F.col("node").cast(node_type).alias("node")).distinct().select(
        "node", F.lit(None).cast(node_type).alias("source"), F.lit(0).alias("depth"))
    if stored is None:
        stored = edges.count() > SMALL_EDGES
    return _expand_stored(edges, start, levels) if stored else _expand_joined(edges, start, levels)


def _finds(edges: DataFrame, level: DataFrame) -> DataFrame:
    """What a level's nodes link to, with the smallest of them."""
    return edges.join(level.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node"), "src")


def _expand_joined(edges: DataFrame, start: DataFrame, levels: int) -> DataFrame:
    level = cut_lineage(start)
    seen = level
    for depth in range(1, levels + 1):
        found = _finds(edges, level).groupBy("node").agg(F.min("src").alias("source"))
        level = cut_lineage(
            found.join(seen.select("node"), "node", "left_anti").select(
                "node", "source", F.lit(depth).alias("depth")
            )
        )
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def _expand_stored(edges: DataFrame, start: DataFrame, levels: int) -> DataFrame:
    spark = edges.sparkSession
    seen = Visited(spark, edges.count())
    try:
        level = cut_lineage(seen.dealt(start))
        for depth in range(levels + 1):
            seen.add(level)
            if depth == levels:
                break
            # Each node is reduced to one row before and after it is dealt out by slot.
            first = _finds(edges, level).groupBy("node").agg(F.min("src").alias("source")).withColumn(
                "depth", F.lit(depth + 1))
            level = seen.unseen(seen.dealt(first))
            if level.isEmpty():
                break
        return seen.nodes()
    finally:
        seen.close()


def expand_collector(edges, seeds, max_depth: int, expandable=None, stored: bool | None = None) -> DataFrame:
    """Levels 0..max_depth are all expanded, so stored depths reach max_depth + 1."""
    return expand(edges, seeds, max_depth + 1, expandable, stored)


def expand_spider(edges, seeds, max_depth: int, expandable=None, stored: bool | None = None) -> DataFrame:
    """Only pages above max_depth add links, so stored depths reach max_depth."""
    return expand(edges, seeds, max_depth, expandable, stored)
