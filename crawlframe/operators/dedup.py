"""Duplicate removal: seeds, suffixed names, equal contents, clashing file names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.functions import urls as U
from crawlframe.operators.ranking import salted_rank
from crawlframe.session import broadcast_if_small, cut_lineage


def distinct_seeds(seeds: DataFrame, url: str = "url", pos: str = "pos") -> DataFrame:
    """First position of each http(s) seed; the order of first sight is `pos`."""
    return (
        seeds.filter(U.has_http_prefix(url))
        .groupBy(F.col(url).alias("url"))
        .agg(F.min(pos).alias("pos"))
    )


def drop_suffix_duplicates(files: DataFrame, name: str = "md_name") -> DataFrame:
    """Without the `_1.md` files; names that end so by themselves go too."""
    return files.filter(~F.col(name).rlike(r"_1\.md$"))


def suffix_report(files: DataFrame, name: str = "md_name") -> DataFrame:
    dup = F.col(name).rlike(r"_1\.md$")
    return files.agg(F.count_if(dup).alias("removed"), F.count_if(~dup).alias("remaining"))


def content_dedup(pages: DataFrame, content: str = "html") -> DataFrame:
    """One row per distinct content: its hash, smallest URL and number of copies.

    The content is hashed before the shuffle and never travels itself.
    """
    return (
        pages.select("url", F.sha2(content, 256).alias("content_hash"))
        .groupBy("content_hash")
        .agg(F.min("url").alias("url"), F.count(F.lit(1)).alias("copies"))
    )


def keep_first_content(pages: DataFrame, content: str = "html") -> DataFrame:
    """One page per content, that of the smallest URL; rows that are repeated stay once.

    The losers are found on hashes and URLs and taken out by an anti-join. Their list is
    written and measured: within the bound of a broadcast no text moves. Only rows
    repeated with URL and content are regrouped with their text.
    """
    hashed = pages.withColumn("content_hash", F.sha2(content, 256))
    rows = cut_lineage(hashed.groupBy("content_hash", "url").agg(F.count(F.lit(1)).alias("_n")))
    best = rows.groupBy(F.col("content_hash").alias("_hash")).agg(
        F.min(F.struct("url")).alias("_first"), F.count(F.lit(1)).alias("_urls")).filter("_urls > 1")
    lost = rows.join(best, F.col("content_hash").eqNullSafe(F.col("_hash"))).filter(
        ~F.col("url").eqNullSafe(F.col("_first.url"))).select(F.col("url").alias("_u"), F.col("content_hash").alias("_h"))
    same = F.col("url").eqNullSafe(F.col("_u")) & F.col("content_hash").eqNullSafe(F.col("_h"))
    kept = hashed.join(broadcast_if_small(cut_lineage(lost)), same, "left_anti")
    often = broadcast_if_small(cut_lineage(rows.filter("_n > 1").select(F.col("url").alias("_u"), F.col("content_hash").alias("_h"))))
    again = kept.join(often, same, "left_semi").dropDuplicates(["url", "content_hash"])
    return kept.join(often, same, "left_anti").unionByName(again)


def site_filenames(df: DataFrame, url: str = "url", rendered: str | None = None) -> DataFrame:
    """A distinct file name per URL row: the site name, `_1`, `_2`, ... on clashes.

    Only clashing rows are ranked and written; all others are read off at the end as
    they are. A suffixed name may in turn meet another URL's own name; such names are
    ranked again until all differ, which in practice takes one round.
    """
    stem = U.site_stem(url, F.col(rendered) if rendered else None)
    plain = df.withColumn("_stem", stem)
    moved = None
    clashes = cut_lineage(_repeated(plain.select("_stem")))
    while not clashes.isEmpty():
        met = plain.join(clashes, "_stem", "left_semi")
        plain = plain.join(clashes, "_stem", "left_anti")
        rest = None
        if moved is not None:
            met = met.unionByName(moved.join(clashes, "_stem", "left_semi"))
            rest = moved.join(clashes, "_stem", "left_anti")
        ranked = salted_rank(met, ["_stem"], url, "_rank")
        named = ranked.withColumn("_stem", F.when(F.col("_rank") == 1, F.col("_stem")).otherwise(
            F.concat("_stem", F.lit("_"), (F.col("_rank") - 1).cast("string")))).drop("_rank")
        moved = cut_lineage(named if rest is None else named.unionByName(rest))
        # A new name can clash with another new one or with a name that was never touched.
        names = moved.select("_stem").distinct()
        clashes = cut_lineage(_repeated(moved.select("_stem")).unionByName(
            plain.select("_stem").distinct().join(names, "_stem", "left_semi")).distinct())
    done = plain if moved is None else plain.unionByName(moved)
    return done.withColumn("file_name", F.concat("_stem", F.lit(".html"))).drop("_stem")


def _repeated(names: DataFrame) -> DataFrame:
    return names.groupBy("_stem").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_stem")
