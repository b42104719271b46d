"""Topical relevance from title, meta, heading and body text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlframe import rules
from crawlframe.functions.text import as_col, count_of, let


def weighted_text(title: Column, meta: Column, heading: Column, text: Column) -> Column:
    """Copies by weight, back to back; a word may straddle two copies."""
    return F.concat(F.repeat(title, 5), F.repeat(meta, 3), F.repeat(heading, 2), text)


def keyword_hits(title, meta, heading, text, keywords: list[str]) -> Column:
    """array<struct(keyword, score)> of the keywords found in the weighted text.

    The texts must be lower case already; the word list is a literal array. A
    page that could not be read has NULL texts and gets NULL.
    """
    title, meta, heading, text = map(as_col, (title, meta, heading, text))
    whole = weighted_text(title, meta, heading, text)
    words = F.array(*[F.lit(k) for k in keywords])
    found = let(whole, lambda w: F.filter(words, lambda k: F.contains(w, k)))
    hits = F.transform(
        found,
        lambda k: F.struct(
            k.alias("keyword"),
            (
                5 * count_of(title, k) + 3 * count_of(meta, k)
                + 2 * count_of(heading, k) + count_of(text, k)
            ).cast("long").alias("score"),
        ),
    )
    return F.when(text.isNotNull(), hits)


def relevance_features(hits: Column, title: Column, title_words: list[str]) -> Column:
    """struct(matched, score, title_hits) from `keyword_hits`."""
    score = F.aggregate(hits, F.lit(0).cast("long"), lambda acc, h: acc + h["score"])
    words = F.array(*[F.lit(w) for w in title_words])
    features = F.struct(
        F.size(hits).alias("matched"),
        score.alias("score"),
        F.size(F.filter(words, lambda w: F.contains(title, w))).alias("title_hits"),
    )
    return F.when(hits.isNotNull(), features)


def is_relevant(features: Column, preset: str = "spider", blacklisted: Column | None = None) -> Column:
    """Any threshold of the preset is enough; missing features count as relevant."""
    p = rules.RELEVANCE_PRESETS[preset]
    hit = (
        (features["matched"] >= p["min_matched"])
        | (features["score"] >= p["min_score"])
        | (features["title_hits"] >= p["min_title"])
    )
    hit = F.coalesce(hit, F.lit(True))
    return hit if blacklisted is None else hit & ~blacklisted
