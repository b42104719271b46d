"""Markdown text: navigation filter, cleaning, quality score and gate.

Each function binds its text once (`let`), because a text column used sixty
times in one expression would otherwise be computed sixty times.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlframe import rules
from crawlframe.functions.text import as_col, contains_any, let, strip


# Ten words, each with blanks after it, at the start of a stripped text: an
# eleventh follows. The match never backs up and ends within the first words.
_ELEVEN_WORDS = "^(?:[^" + rules.WS[1:] + "++" + rules.WS + "++){10}"


def _total(tests: list[Column]) -> Column:
    """How many tests hold."""
    return reduce(lambda a, b: a + b, [x.cast("int") for x in tests])


def _nav_regexes(c: Column) -> list[Column]:
    # The plain search comes first: few texts hold its word, and only those are matched.
    return [c.contains(word) & c.rlike(pattern) for word, pattern in rules.NAV_REGEXES]


def _has_chinese(c: Column) -> Column:
    return c.rlike(r"[\x{4e00}-\x{9fff}]")


def _is_symbol_line(line: Column) -> Column:
    """What makes a line navigation without a Chinese word."""
    symbols = [x for x in rules.NAV_TEXTS if x.isascii()]
    return (
        (line == "")
        | contains_any(line, symbols)
        | reduce(lambda a, b: a | b, _nav_regexes(line))
        | line.rlike(rules.NAV_RULE_LINE)
    )


def _is_nav_line(line: Column) -> Column:
    words = [x for x in rules.NAV_TEXTS if not x.isascii()]
    return (
        _is_symbol_line(line)
        | contains_any(line, words)
        | line.isin(*rules.NAV_EXACT_LINES)
        | ((F.length(line) <= 5) & contains_any(line, rules.NAV_SHORT_WORDS))
    )


def filter_nav(text: Column | str) -> Column:
    """Stripped lines that are neither blank nor navigation, joined again.

    One look for any Chinese letter saves other texts the search for each word.
    """

    def kept(t: Column) -> Column:
        lines = F.transform(F.split(t, "\n"), strip)
        chinese = F.filter(lines, lambda x: ~_is_nav_line(x))
        other = F.filter(lines, lambda x: ~_is_symbol_line(x))
        return F.array_join(F.when(_has_chinese(t), chinese).otherwise(other), "\n")

    return let(as_col(text), kept)


def clean_markdown(text: Column | str) -> Column:
    """The filtered text; no blank line is left after the filter."""
    return strip(filter_nav(F.coalesce(as_col(text), F.lit(""))))


def _facts(t: Column) -> Column:
    """What the scores are made of; `t` is stripped."""
    has = [
        contains_any(t, ["。", "."]),
        t.contains("\n"),
        t.rlike(_ELEVEN_WORDS),
        contains_any(t, ["：", "，", "；", "、"]),
    ]
    symbols = [t.contains(x) for x in rules.NAV_TEXTS if x.isascii()] + _nav_regexes(t)
    nav_words = [t.contains(x) for x in rules.NAV_TEXTS if not x.isascii()]
    domain_words = [t.contains(w) for w in rules.DOMAIN_WORDS]
    counts = F.struct(_total(nav_words).alias("nav"), _total(domain_words).alias("domain"))
    none = F.struct(F.lit(0).alias("nav"), F.lit(0).alias("domain"))
    found = F.when(_has_chinese(t), counts).otherwise(none)
    return let(found, lambda w: F.struct(
        F.length(t).alias("n"),
        (F.length(t) - F.length(F.regexp_replace(t, rules.SUBSTANTIAL_CLASS + "+", ""))).alias("solid"),
        _total(has).alias("signs"),
        (_total(symbols) + w["nav"]).alias("nav"),
        w["domain"].alias("words"),
    ))


def _scores(f: Column) -> Column:
    n, blank = f["n"], f["n"] == 0
    length = F.least(F.lit(20.0), n / F.lit(50.0))
    structure = F.when(blank, 0.0).otherwise(5.0 * f["signs"])
    ratio = F.when(blank, 0.0).otherwise(f["solid"] / n)
    content = ratio * 30.0
    nav = F.when(blank, 0.0).otherwise(F.greatest(F.lit(0), 20 - 5 * f["nav"]).cast("double"))
    domain = F.least(F.lit(10), 2 * f["words"]).cast("double")
    return F.struct(
        (length + structure + content + nav + domain).alias("total"),
        length.alias("length_score"),
        structure.alias("structure_score"),
        content.alias("content_score"),
        nav.alias("nav_score"),
        domain.alias("domain_score"),
        n.alias("text_length"),
        ratio.alias("substantial_ratio"),
        f["words"].alias("keyword_count"),
    )


def quality(text: Column | str) -> Column:
    """Quality from 0 to 100 with its parts; blank text scores 0."""
    stripped = strip(F.coalesce(as_col(text), F.lit("")))
    return let(let(stripped, _facts), _scores)


def gate(length: Column, total: Column, min_length: int = 200, min_quality: float = 40) -> Column:
    """struct(outcome, reason): length is tested before quality."""
    short = length < min_length
    poor = total < min_quality
    short_text = F.concat(
        F.lit("内容长度不足："), length.cast("string"), F.lit(f"字符 < {min_length}字符")
    )
    poor_text = F.concat(
        F.lit("内容质量不达标："), F.format_string("%.1f", total), F.lit(f"分 < {min_quality}分")
    )
    return F.struct(
        F.when(short | poor, "skipped").otherwise("success").alias("outcome"),
        F.when(short, short_text).when(poor, poor_text).alias("reason"),
    )


def assess(text: Column | str, min_length: int = 200, min_quality: float = 40) -> Column:
    """struct(clean, quality, outcome, reason) of raw Markdown."""

    def judge(clean: Column) -> Column:
        def with_gate(q: Column) -> Column:
            return let(
                gate(q["text_length"], q["total"], min_length, min_quality),
                lambda g: F.struct(
                    clean.alias("clean"), q["total"].alias("quality"),
                    g["outcome"].alias("outcome"), g["reason"].alias("reason"),
                ),
            )

        return let(quality(clean), with_gate)

    return let(clean_markdown(text), judge)
