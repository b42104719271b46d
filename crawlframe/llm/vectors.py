"""What the operators on embeddings share: Arrow lists as matrices, exact sums of any size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.llm.common import cols

#: An exact sum travels as digits of this many bits, each a long.
DIGIT = 40
SUM_SCHEMA = "row int, col int, digit int, value bigint"


def usable(vector: Column, width: int | None = None) -> Column:
    """Whether a vector is there, holds only finite numbers, and has `width` of them (at least one without it)."""
    finite = F.forall(vector, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    size = F.size(vector) == width if width is not None else F.size(vector) > 0
    return F.coalesce(vector.isNotNull() & size & finite, F.lit(False))


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the rows that `usable` takes, and where in `column` these rows stand."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    there = np.asarray(column.is_valid())
    if pa.types.is_fixed_size_list(column.type):
        starts = (np.arange(n) + column.offset) * column.type.list_size
        sizes = np.full(n, column.type.list_size)
    else:
        offsets = np.asarray(column.offsets)
        starts, sizes = offsets[:-1], np.diff(offsets)
    at = np.flatnonzero(there & (sizes == width))
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes NaN
    x = values[starts[at, None] + np.arange(width)] if len(at) else np.zeros((0, width))
    good = np.isfinite(x).all(axis=1)
    return x[good], at[good]


def floors(x: np.ndarray, scale: int, limit: float) -> np.ndarray:
    """floor(scale * x) for a power of two `scale`: longs where all lie within `limit`, else Python integers."""
    if not x.size or np.abs(x).max() < limit / scale:
        return np.floor(x * scale).astype(np.int64)
    out = np.empty(x.shape, dtype=object)
    for at, v in np.ndenumerate(x):
        out[at] = int(Fraction(float(v)) * scale // 1)
    return out


def digits(row: int, col: int, value: int) -> Iterator[tuple[int, int, int, int]]:
    """`value` as rows of SUM_SCHEMA; the last digit has the sign."""
    value, k = int(value), 0
    while not -(1 << 62) < value < 1 << 62:
        yield row, col, k, value & ((1 << DIGIT) - 1)
        value >>= DIGIT
        k += 1
    yield row, col, k, value


def sum_batch(sums: Iterable[tuple[int, int, int]]) -> pa.RecordBatch:
    """A batch of SUM_SCHEMA with the given (row, col, value)."""
    flat = [d for s in sums for d in digits(*s)]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([f[i] for f in flat], kind) for i, kind in enumerate(kinds)], ["row", "col", "digit", "value"])


def total(parts: DataFrame) -> dict[tuple[int, int], int]:
    """The exact sum per (row, col) of rows of SUM_SCHEMA; only one row per digit reaches the driver."""
    out: dict[tuple[int, int], int] = {}
    by_digit = parts.groupBy("row", "col", "digit").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    for r in by_digit.collect():
        out[r["row"], r["col"]] = out.get((r["row"], r["col"]), 0) + (int(r["value"]) << DIGIT * r["digit"])
    return out


def as_long(value: int) -> int:
    """`value`, or the nearest long."""
    return max(-(1 << 63), min((1 << 63) - 1, int(value)))


def made_names(made: str) -> list[str]:
    """The column names of a DDL string."""
    return [m.split()[0] for m in made.split(", ")]


def extended(df: DataFrame, keep: list[str], made: str) -> T.StructType:
    """The schema of `df`'s columns `keep` followed by the columns `made` (a DDL string)."""
    kept = df.select(*cols(keep)).schema.fields
    return T.StructType([*kept, *T.StructType.fromDDL(made).fields])
