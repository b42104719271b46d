"""Small text, size, time and log-line expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe import rules


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, also inside another lambda."""
    return F.transform(F.array(value), body)[0]


def spare(df: DataFrame) -> str:
    """A prefix that no column of `df` has, for the names an operator uses inside."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def strip(c: Column) -> Column:
    """Trim Unicode whitespace on both sides."""
    return F.trim(c, F.lit(rules.WS_CHARS))


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether `c` holds one of the words.

    A few words become a chain of code-generated searches, many a literal array,
    which keeps the expression tree flat.
    """
    words = list(words)
    if not words:
        return F.lit(False)
    if len(words) > 64:
        return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def count_of(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of `word` in `text`."""
    return F.floor((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word))


def size_label(size: Column | str) -> Column:
    """Byte size with one decimal; ties go to the even digit, as in printf.

    The quotient is taken in integers, so no double rounding can creep in.
    """
    size = as_col(size).cast("long")

    def tenths(unit: int, name: str) -> Column:
        whole = F.floor(size * 10 / F.lit(unit)).cast("long")
        rest = size * 10 - whole * unit
        up = (rest * 2 > unit) | ((rest * 2 == unit) & (whole % 2 == 1))
        t = whole + up.cast("long")
        return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"),
                        F.lit(f" {name}"))

    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, tenths(1024, "KB"))
        .when(size < 1024**3, tenths(1024**2, "MB"))
        .otherwise(tenths(1024**3, "GB"))
    )


def size_label_short(size: Column | str) -> Column:
    """Byte size with up to two decimals, trailing zeros dropped; ties go up."""
    size = as_col(size).cast("long")

    def hundredths(unit: int, name: str) -> Column:
        h = F.floor((size * 100 + unit // 2) / F.lit(unit)).cast("long")
        frac = F.lpad((h % 100).cast("string"), 2, "0")
        text = F.concat(F.floor(h / 100).cast("string"), F.lit("."), frac)
        return F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit(f" {name}"))

    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, hundredths(1024, "KB"))
        .when(size < 1024**3, hundredths(1024**2, "MB"))
        .otherwise(hundredths(1024**3, "GB"))
    )


def log_level(line: Column | str) -> Column:
    """error / warning / success / info, the first mark found winning."""
    up = F.upper(as_col(line))
    return (
        F.when(contains_any(up, ["ERROR", "FAILED"]), "error")
        .when(contains_any(up, ["WARNING", "WARN"]), "warning")
        .when(contains_any(up, ["SUCCESS", "COMPLETED"]), "success")
        .otherwise("info")
    )


def iso_ts(ts: Column | str) -> Column:
    """ISO text; the fraction is written only where there is one. NULL stays NULL."""
    ts = as_col(ts)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, whole).otherwise(frac)


def stamp(ts: Column | str) -> Column:
    """The `yyyymmdd_HHMMSS` stamp used in snapshot names."""
    return F.date_format(as_col(ts), "yyyyMMdd_HHmmss")


def or_default(c: Column | str, default: str) -> Column:
    """`default` for NULL and for empty text."""
    c = as_col(c)
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(c)


def header_charset(content_type: Column | str) -> Column:
    """Text after `charset=` up to `;`; NULL where the header names none."""
    low = F.lower(as_col(content_type))
    found = strip(F.regexp_extract(low, r"charset=([^;]*)", 1))
    return F.when(found != "", found)


def basename(path: Column | str) -> Column:
    return F.regexp_extract(as_col(path), r"([^/]*)$", 1)
