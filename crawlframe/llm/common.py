"""What the training-data operators share: query registry, words, hashes, fitting columns."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.functions.text import let

QUERIES: dict[str, Callable] = {}
CHECKS: dict[str, str] = {}

#: A word of every contract here; `bytes.split()` and Java's and DuckDB's regex agree on it.
WORD = r"[^\x20\x09-\x0D]+"
#: Lower-cases A-Z and nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame, with its check SQL if there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, made: Iterable[str]) -> list[str]:
    """The columns of `df` that no column in `made` replaces (names compared without case)."""
    taken = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in taken]


def cols(names: Iterable[str]) -> list[Column]:
    """Columns by their plain names, dots and blanks included."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def given(df: DataFrame, names: Iterable[str]) -> Column:
    """The columns `names` of `df` as one, called __given, so that their names meet no inner ones."""
    return F.struct(*cols(names)).alias("__given")


def restored(names: Iterable[str]) -> list[Column]:
    """What `given` packed, as columns again."""
    return [F.col("__given")[n].alias(n) for n in names]


def split_of(doc_id: str = "doc_id", parts: int = 5) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


#: Numbers that are run through together.
RUN = 256


def running(numbers: Column, combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """Of an array of longs: what `combine` (associative, with `zero` neutral) makes of those before each one.

    Appending to an array copies it, so runs of `RUN` numbers are gone through
    first and then the runs: linear for arrays of any practical length.
    """
    empty = F.array().cast("array<bigint>")
    start = F.struct(F.lit(zero).cast("bigint").alias("all"), empty.alias("before"))

    def step(acc: Column, value: Column) -> Column:
        return F.struct(combine(acc["all"], value).alias("all"), F.concat(acc["before"], F.array(acc["all"])).alias("before"))

    def joined(runs: Column) -> Column:
        firsts = F.aggregate(runs, start, lambda acc, r: step(acc, r["all"]), lambda acc: acc["before"])
        return let(firsts, lambda first: F.flatten(F.transform(
            runs, lambda r, i: F.transform(r["before"], lambda b: combine(first[i], b)))))

    def gone(values: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")),
                          lambda k: F.aggregate(F.slice(values, k * RUN + 1, F.lit(RUN)), start, step))
        return F.when(F.size(values) > 0, let(cut, joined)).otherwise(empty)

    return let(numbers, gone)


def running_sums(numbers: Column) -> Column:
    """Of an array of longs: the sum of what stands before each one."""
    return running(numbers, lambda a, b: a + b, 0)


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text, A-Z lower-cased; none for null."""
    return text.translate(LOWER).split() if text else []


def text_bytes(column) -> list[bytes | None]:
    """An Arrow text column as Python bytes, without decoding it."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def crc_long(values: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(values, "<u4").tobytes())
