"""Joins by key, by host and by contained text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.functions import urls as U
from crawlframe.functions.text import basename
from crawlframe.operators.grams import contained_join
from crawlframe.operators.matching import contained, rule_groups, without_hits

# Rule lists up to this length are matched as literals, in the row and without Python.
INLINE_RULES = 64


def substring_matches(
    texts: DataFrame, text: str, key: str, rules: DataFrame, rule: str = "rule",
    inline_rules: int = INLINE_RULES,
) -> DataFrame:
    """Distinct (key, rule) pairs where the text contains the rule.

    A short rule list (counted) is matched in place by built-in functions, a
    longer one by an automaton in one Arrow pass over the texts per bounded group
    of rules. Texts are not moved; only the pairs found are made distinct.
    """
    base = texts.select(F.col(key), F.col(text).alias("_text"))
    pairs = None
    for words in rule_groups(rules, rule):
        if len(words) <= inline_rules:
            hits = F.filter(F.array(*map(F.lit, words)).cast("array<string>"), lambda w: F.contains("_text", w))
            found = base.select(key, F.explode(hits).alias(rule))
        else:
            found = contained(base, "_text", key, words, rule)
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs.distinct()


def drop_blacklisted(df: DataFrame, url: str, rules: DataFrame, rule: str = "rule",
                     inline_rules: int = INLINE_RULES) -> DataFrame:
    """Rows whose lower-case URL contains no rule; rows stay in their partitions."""
    for words in rule_groups(rules, rule):
        if len(words) <= inline_rules:
            df = df.filter(~F.coalesce(U.is_blacklisted(url, words), F.lit(False)))
        else:
            df = without_hits(df, F.lower(url), words)
    return df


def host_suffixes(host: Column) -> Column:
    """The host and every domain above it: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def in_allowed_domains(df: DataFrame, url: str, domains: DataFrame, domain: str = "domain") -> DataFrame:
    """Rows whose host lies in a listed domain, as an equi-join over host suffixes.

    Each distinct host is looked up once, then joined back; no row meets the
    whole domain list.
    """
    host = F.lower(U.authority(url))
    hosts = df.select(host.alias("_host")).filter(F.col("_host") != "").distinct()
    listed = domains.select(F.lower(domain).alias("_suffix")).distinct()
    ok = (
        hosts.select("_host", F.explode(host_suffixes(F.col("_host"))).alias("_suffix"))
        .join(listed, "_suffix", "left_semi")
        .select("_host").distinct()
    )
    return df.withColumn("_host", host).join(ok, "_host", "left_semi").drop("_host")


def files_with_url(files: DataFrame, frontier: DataFrame, name: str = "file_name") -> DataFrame:
    """Each file with the smallest URL stored under its name, else `file://name`."""
    stored = (
        frontier.filter(F.col("html_file_path").isNotNull())
        .groupBy(F.lower(basename("html_file_path")).alias("_name"))
        .agg(F.min("url").alias("url"))
    )
    return (
        files.withColumn("_name", F.lower(name))
        .join(stored, "_name", "left")
        .withColumn("url", F.coalesce("url", F.concat(F.lit("file://"), F.col(name))))
        .drop("_name")
    )


def files_with_stored_url(files: DataFrame, frontier: DataFrame, name: str = "file_name") -> DataFrame:
    """Each file with the smallest URL whose stored path contains its name, else `file://name`.

    The name is searched without regard to case, and `%` and `_` in it are
    wildcards, as a stored path is looked up with ILIKE.
    """
    stored = frontier.filter(F.col("html_file_path").isNotNull()).groupBy("html_file_path").agg(F.min("url").alias("url"))
    pairs = contained_join(files, name, stored, "html_file_path")
    first = pairs.groupBy(F.col(name).alias("_name")).agg(F.min("url").alias("url"))
    return (
        files.join(first, F.col(name) == F.col("_name"), "left")
        .withColumn("url", F.coalesce("url", F.concat(F.lit("file://"), F.col(name))))
        .drop("_name")
    )


def with_file_exists(frontier: DataFrame, files: DataFrame, name: str = "file_name") -> DataFrame:
    """The frontier with the stored file's base name and whether that file exists.

    Rows without a file, usually half of them, are dealt out by their URL; as equal keys
    of the join they would all lie in one task.
    """
    names = files.select(F.col(name).alias("_file"), F.xxhash64(name).alias("_file_hash")).distinct()
    named = frontier.withColumn("html_file", basename("html_file_path")).withColumn("_dealt", F.xxhash64(F.coalesce("html_file", "url")))
    return (
        named.join(names, (F.col("html_file") == F.col("_file")) & (F.col("_dealt") == F.col("_file_hash")), "left")
        .withColumn("file_exists", F.col("_file").isNotNull())
        .drop("_file", "_file_hash", "_dealt")
    )
