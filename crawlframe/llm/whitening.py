"""Embedding whitening from exact integer covariances, by bit-sliced scatter.

Entries become integers. The distinct integer vectors are kept once, packed into
the fewest bytes that hold their entries, and written to the shared folder. A
task takes them in blocks: each dimension is shifted by its least value in the
block, its bit planes are packed across the block's rows into 64-bit words, and
the counts of set bits in the AND of two planes, weighted by the planes' powers
of two, are the block's exact cross-products; the shift is then taken back. A
task gives one row per pair of dimensions, so nothing that moves or reaches the
driver grows with the table (width x width sums). The sums are centred as
integers, n * sum(x x') - sum(x) sum(x)', divided once, and decomposed by eigh.

Defined cases: null vectors, empty ones and those with null or non-finite entries
give no rows; neither do widths other than the most frequent one (of equally
frequent ones the larger). Repeated vectors weigh once but each row is returned. Components
without variance have no unit scale and are left out, so a table with fewer than two
distinct vectors, or an empty one, gives no rows. An integer beyond a long is held at its bound; a
deviation beyond a long is held there too, and `deviation_exact` has it as a
decimal. Extra columns pass through, those named like a result are replaced, and
the vector column is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.llm.common import cols, query, table, without
from crawlframe.llm.vectors import SUM_SCHEMA, as_long, extended, floors, made_names, matrix, sum_batch, total, usable
from crawlframe.session import scratch, ship_package

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Vectors whose planes are sliced together; 64 words a plane.
BLOCK = 4_096
MADE = ("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, "
        "deviation_exact decimal(38,0)")
#: Bytes an entry may take, in the order in which they are tried.
SIZES = (1, 2, 4, 8)
#: Entries stay below this, so that one more bit fits a long.
BOUND = 1 << 62


def entries(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * c) of the usable rows, held within longs; the offset, which no covariance sees, comes later."""
    x, at = matrix(column, width)
    y = floors(x, scale, float(BOUND))
    if y.dtype == object:
        y = np.clip(y, -BOUND, BOUND - 1).astype(np.int64)
    return y, at


def packed(y: np.ndarray) -> list[bytes]:
    """Each row in the fewest bytes an entry; equal rows, and only they, give equal bytes."""
    low, high = (y.min(axis=1), y.max(axis=1)) if len(y) else (np.zeros(0), np.zeros(0))
    out: list[bytes] = [b""] * len(y)
    left = np.ones(len(y), dtype=bool)
    for size in SIZES:
        edge = 1 << (8 * size - 1)
        now = left & (low >= -edge) & (high <= edge - 1)
        left &= ~now
        raw, step = y[now].astype(f"<i{size}").tobytes(), size * y.shape[1]
        for k, at in enumerate(np.flatnonzero(now)):
            out[at] = raw[k * step:(k + 1) * step]
    return out


def unpacked(keys: list[bytes], width: int) -> np.ndarray:
    y = np.empty((len(keys), width), dtype=np.int64)
    sizes = np.array([len(k) // width for k in keys])
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        y[own] = np.frombuffer(b"".join(keys[i] for i in own), dtype=f"<i{size}").reshape(len(own), width)
    return y


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """Packed vectors as matrices of at most BLOCK rows."""
    held: list[bytes] = []
    for b in batches:
        held += b.column(0).to_pylist()
        while len(held) >= BLOCK:
            yield unpacked(held[:BLOCK], width)
            held = held[BLOCK:]
    if held:
        yield unpacked(held, width)


def scatter(y: np.ndarray) -> np.ndarray:
    """Exact cross-products y'y (Python integers) from the bit planes of y."""
    n, width = y.shape
    shift = y.min(axis=0)
    u = y - shift  # from 0 up, in 63 bits
    deep = [max(1, int(v).bit_length()) for v in u.max(axis=0)]
    planes = np.zeros((sum(deep), -(-n // 64) * 64), dtype=np.uint8)
    weight = np.zeros((width, sum(deep)), dtype=object)
    at = 0
    for d, bits in enumerate(deep):
        for b in range(bits):
            planes[at, :n] = u[:, d] >> b & 1
            weight[d, at] = 1 << b
            at += 1
    words = np.packbits(planes, axis=1).view(np.uint64)
    counts = np.zeros((at, at), dtype=np.int64)
    for p in range(at):
        counts[p, p:] = np.bitwise_count(words[p] & words[p:]).sum(axis=1, dtype=np.int64)
    counts += np.triu(counts, 1).T
    if 2 * max(deep) + n.bit_length() < 62:  # all sums fit a long
        weight = weight.astype(np.int64)
    product = (weight @ counts @ weight.T).astype(object)
    sums, base = u.sum(axis=0, dtype=object), shift.astype(object)
    back = np.outer(sums, base)
    return product + back + back.T + n * np.outer(base, base)


def _spectrum(vectors: DataFrame, width: int) -> tuple[int, list[int], np.ndarray, float]:
    """Of packed vectors: how many, their sums, their covariance, its trace."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ones, products = 0, np.zeros(width, dtype=object), np.zeros((width, width), dtype=object)
        for y in blocks(batches, width):
            n, ones, products = n + len(y), ones + y.sum(axis=0, dtype=object), products + scatter(y)
        yield sum_batch([(-1, -1, n), *[(-1, d, ones[d]) for d in range(width)],
                         *[(i, j, products[i, j]) for i in range(width) for j in range(i, width)]])

    got = total(vectors.mapInArrow(sums, SUM_SCHEMA))
    n = got.get((-1, -1), 0)
    ones = [got.get((-1, d), 0) for d in range(width)]
    cov = np.zeros((width, width))
    trace = 0
    for i in range(width):
        for j in range(i, width):
            centred = n * got.get((i, j), 0) - ones[i] * ones[j]
            cov[i, j] = cov[j, i] = centred / (n * n) if n else 0.0  # integers divide to the nearest double
            trace += centred if i == j else 0
    return n, ones, cov, trace / (n * n) if n else 0.0


def centred(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """y - sums / n, exact but for the last rounding of each entry."""
    whole, rest = zip(*[divmod(s, n) for s in sums])
    if max(map(abs, whole)) >= BOUND:
        return np.array([[float(v) for v in row] for row in y.astype(object) - np.array(whole, dtype=object)]) - [
            r / n for r in rest]
    return (y - np.array(whole, dtype=np.int64)).astype(np.float64) - np.array([r / n for r in rest])


def deviations(y: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The exact sum of (n * y - sums)^2 of each row."""
    width = y.shape[1]
    big = int(max(abs(int(y.min())), abs(int(y.max())))) if y.size else 0
    wide = y.astype(object) if width * big * max(big, *map(abs, sums), 1) >= BOUND else y
    squares = (wide * wide).sum(axis=1).tolist()
    cross = (wide @ np.array(sums, dtype=wide.dtype)).tolist()
    rest = sum(s * s for s in sums)
    return [n * n * q - 2 * n * p + rest for q, p in zip(squares, cross)]


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, width: int | None = None) -> DataFrame:
    """A row of MADE per usable row of `vectors` and component, besides the columns but the vector.

    The fit list (each distinct vector once) is written packed; the identity
    error is measured on it by a further pass, not derived from the fit.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    (vec,) = cols([embedding])
    keep = without(vectors, [embedding, *made_names(MADE)])
    schema = extended(vectors, keep, MADE)
    if width is None:
        most = vectors.where(usable(vec)).groupBy(F.size(vec).alias("w")).count()
        top = most.orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
        if not top:
            return spark.createDataFrame([], schema)
        width = top[0]["w"]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, _ = entries(b.column(0), width, scale)
            yield pa.RecordBatch.from_arrays([pa.array(list(dict.fromkeys(packed(y))), pa.binary())], ["key"])

    path = scratch(spark, "whitening")
    vectors.select(vec).mapInArrow(keys, "key binary").distinct().write.parquet(path)
    fit = spark.read.parquet(path)
    n, sums, cov, trace = _spectrum(fit, width)
    if n < 2 or not trace > 0:
        return spark.createDataFrame([], schema)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    take = int(min(components, (e > e[0] * width * np.finfo(float).eps).sum()))
    axes = u[:, :take] / np.sqrt(e[:take])
    explained = (e[:take] / trace).tolist()

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(take), np.zeros((take, take))
        for y in blocks(batches, width):
            w = centred(y, n, sums) @ axes
            one, two = one + w.sum(axis=0), two + w.T @ w
        flat = [(i, j, float(two[i, j])) for i in range(take) for j in range(take)]
        flat += [(-1, j, float(one[j])) for j in range(take)]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in flat], kind) for k, kind in enumerate(
            (pa.int32(), pa.int32(), pa.float64()))], ["row", "col", "value"])

    parts = fit.mapInArrow(products, "row int, col int, value double").groupBy("row", "col").agg(F.sum("value").alias("s"))
    got = {(r["row"], r["col"]): r["s"] / n for r in parts.collect()}
    error = max(abs(got[i, j] - got[-1, i] * got[-1, j] - (i == j)) for i in range(take) for j in range(take))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, at = entries(b.column(len(keep)), width, scale)
            w = centred(y, n, sums) @ axes
            far = [v for v in deviations(y, n, sums) for _ in range(take)]
            rows = b.take(pa.array(np.repeat(at, take)))
            m = len(far)
            yield pa.RecordBatch.from_arrays([
                *[rows.column(i) for i in range(len(keep))],
                pa.array(np.tile(np.arange(1, take + 1), len(at)), pa.int32()), pa.array(np.full(m, n), pa.int64()),
                pa.array([as_long(v) for v in far], pa.int64()), pa.array(w.ravel(), pa.float64()),
                pa.array(explained * len(at), pa.float64()), pa.array(np.full(m, error), pa.float64()),
                pa.array([Decimal(v) if v < 10 ** 38 else None for v in far], pa.decimal128(38, 0))], names=schema.names)

    return vectors.select(*cols(keep), vec).mapInArrow(project, schema)


@query("op12_whitening")
def op12(spark, d) -> DataFrame:
    return whiten(table(spark, d, "embeddings").select("vec_id", "embedding"))
