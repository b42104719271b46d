"""Centroid clustering (Lloyd's rounds on integer vectors) with the threshold algorithm as nearest-centroid search.

Each dimension has its list of centroids sorted by their value there. A search
enters every list at the vector's value and walks outward, always to the nearer
side. A centroid met for the first time in any list gets its exact distance. The
values that the lists have reached bound all centroids not met yet: once the sum
of the squared frontier distances strictly exceeds the best exact distance, no
other centroid can be as near, ties included, and the search stops. All vectors of a
batch walk at once; those that are done leave.

Vectors are read again in each round instead of being kept: turning them into
integers costs less than writing them. A task adds up its vectors per cluster and
gives one row per cluster and dimension, so a cluster that holds most rows is no
hot key; only these sums reach the driver (clusters x dimensions numbers, whatever
the table's size). Sums are exact integers of any size. When a round changes no
centroid the remaining rounds could not either, and are left out.

Defined cases: null vectors, other widths than `width`, and vectors with null or
non-finite components give no row; repeated rows count each; of equal start
hashes the smaller vector comes first; fewer vectors than `clusters` give fewer
centroids; an empty table gives no rows; a null id is hashed as empty text.
Integers beyond 2^27 are computed with Python integers, and a distance or an
inertia beyond a long is given as the largest long. Extra columns pass through,
those named like a result are replaced, and the vector column is dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.llm.common import cols, query, table, without
from crawlframe.llm.vectors import SUM_SCHEMA, as_long, extended, floors, made_names, matrix, sum_batch, total, usable
from crawlframe.session import ship_package

SCALE, WIDTH, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, 3
#: Integers below this keep a squared distance over 64 dimensions within a long.
SMALL = float(1 << 27)
#: Cells of the distance table that is searched at once.
CELLS = 1 << 21
MADE = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


class Lists:
    """The centroids, and per dimension their order and their sorted values."""

    def __init__(self, centroids: np.ndarray):
        self.at = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.sorted = np.take_along_axis(centroids, self.order, axis=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each row's nearest centroid; of equally near ones the smaller number."""
        if x.dtype != self.at.dtype:  # Python integers on one side only
            return Lists(self.at.astype(object)).nearest(x.astype(object))
        step = max(1, CELLS // max(1, self.at.size))
        parts = [self._walk(x[i:i + step]) for i in range(0, len(x), step)] or [self._walk(x)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, dims = x.shape
        k = len(self.at)
        far = (1 << 62) if x.dtype == np.int64 else 4 * dims * (
            max(1, *(int(abs(v).max()) for v in (x, self.at) if v.size)) ** 2) + 1
        best, who = np.full(n, far, dtype=x.dtype), np.full(n, k)
        met = np.zeros((n, k), dtype=bool)
        right = np.empty((n, dims), dtype=np.int64)  # the next list place on this side, and on the left
        for d in range(dims):
            right[:, d] = np.searchsorted(self.sorted[:, d], x[:, d])
        left = right - 1
        every = np.arange(dims)
        live = np.arange(n)
        for _ in range(k):  # after k steps all lists are walked to both ends
            v, lo, hi = x[live], left[live], right[live]
            down = np.where(lo >= 0, v - self.sorted[np.maximum(lo, 0), every], far)
            up = np.where(hi < k, self.sorted[np.minimum(hi, k - 1), every] - v, far)
            go_left = (down <= up).astype(bool)
            frontier = np.where(go_left, down, up)
            named = self.order[np.where(go_left, lo, hi), every]
            left[live], right[live] = lo - go_left, hi + ~go_left
            fresh = np.zeros((len(live), k), dtype=bool)
            fresh[np.arange(len(live))[:, None], named] = True
            fresh &= ~met[live]
            met[live] |= fresh
            r, c = np.nonzero(fresh)
            exact = np.full((len(live), k), far, dtype=x.dtype)
            exact[r, c] = ((v[r] - self.at[c]) ** 2).sum(axis=1)
            first = exact.argmin(axis=1)  # the smaller number of equals
            found = exact[np.arange(len(live)), first]
            better = ((found < best[live]) | ((found == best[live]) & (first < who[live]))).astype(bool)
            best[live[better]], who[live[better]] = found[better], first[better]
            live = live[((frontier ** 2).sum(axis=1) <= best[live]).astype(bool)]
            if not len(live):
                break
        return who, best


def _integers(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    x, at = matrix(column, width)
    return floors(x, scale, SMALL), at


def _table(rows: list[list[int]]) -> np.ndarray:
    small = all(-SMALL < v < SMALL for r in rows for v in r)
    return np.array(rows, dtype=np.int64 if small else object)


def _round(vectors: DataFrame, centroids: np.ndarray, width: int, scale: int) -> tuple[list[list[int]], list[int]]:
    """The next centroids, and each present cluster's summed distances."""
    k = len(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        added: dict[tuple[int, int], int] = {}
        for b in batches:
            x, _ = _integers(b.column(0), width, scale)
            who, far = lists.nearest(x)
            for c in np.unique(who):
                own = x[who == c]
                for col, v in [*enumerate(own.sum(axis=0)), (width, len(own)), (width + 1, sum(far[who == c].tolist()))]:
                    added[int(c), col] = added.get((int(c), col), 0) + int(v)
        yield sum_batch((r, c, v) for (r, c), v in added.items())

    got = total(vectors.mapInArrow(sums, SUM_SCHEMA))
    after = [[got.get((c, d), 0) // got[c, width] for d in range(width)] if (c, width) in got
             else [int(v) for v in centroids[c]] for c in range(k)]
    return after, [got.get((c, width + 1), 0) for c in range(k)]


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS,
            rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """The usable rows of `vectors` without the vector, with the columns of MADE.

    Centroids start as the vectors with the smallest sha256 of `seed:id`. Each
    of `rounds` rounds assigns all vectors and moves every non-empty centroid
    to the floor of its vectors' mean; a last assignment follows.
    """
    ship_package(vectors.sparkSession)
    vec, key = cols([embedding, vec_id])
    only = vectors.select(vec)
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    first = vectors.where(usable(vec, width)).select(rank.alias("h"), vec.alias("v")).orderBy("h", "v").limit(clusters)
    start = [r["v"] for r in first.collect()]
    keep = without(vectors, [embedding, *made_names(MADE)])
    schema = extended(vectors, keep, MADE)
    if not start:
        return vectors.sparkSession.createDataFrame([], schema)
    now = _table([[int(v) for v in row] for row in floors(np.array(start, dtype=np.float64), scale, SMALL)])
    settled = None
    for _ in range(rounds):
        after, far = _round(only, now, width, scale)
        if _same(now, after):
            settled = far  # these are the sums of the last assignment too
            break
        now = _table(after)
    far = settled if settled is not None else _round(only, now, width, scale)[1]
    each = [as_long(v) for v in far]
    whole = as_long(sum(far))
    names = [hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest() for row in now]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(now)
        for b in batches:
            x, at = _integers(b.column(len(keep)), width, scale)
            who, dist = lists.nearest(x)
            kept = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([
                *[kept.column(i) for i in range(len(keep))], pa.array(who, pa.int32()),
                pa.array([as_long(v) for v in dist.tolist()], pa.int64()),
                pa.array([each[c] for c in who], pa.int64()), pa.array([whole] * len(who), pa.int64()),
                pa.array([names[c] for c in who], pa.string())], names=schema.names)

    return vectors.select(*cols(keep), vec).mapInArrow(assign, schema)


def _same(now: np.ndarray, after: list[list[int]]) -> bool:
    return [[int(v) for v in row] for row in now] == after


def _sql(rounds: int = ROUNDS) -> str:
    assign = """
a{i} AS MATERIALIZED (SELECT rid, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
  SELECT rid, k, list_sum([((x[j] - m[j]) * (x[j] - m[j]))::HUGEINT FOR j IN range(1, {w})]) AS d FROM x, c{i})
  GROUP BY rid)"""
    move = """,
c{n} AS MATERIALIZED (SELECT c{i}.k, coalesce(s.m, c{i}.m) AS m FROM c{i} LEFT JOIN (
  SELECT k, list((t - ((t % n + n) % n)) // n ORDER BY j) AS m FROM (
    SELECT k, j, sum(x[j])::HUGEINT AS t, count(*)::HUGEINT AS n FROM a{i} JOIN x USING (rid), range(1, {w}) r(j)
    GROUP BY k, j) GROUP BY k) s USING (k)),"""
    w = WIDTH + 1
    steps = "".join(assign.format(i=i, w=w) + move.format(i=i, n=i + 1, w=w) for i in range(rounds))
    return f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {WIDTH}),
x AS MATERIALIZED (SELECT rid, vec_id, [CAST(floor(y * {SCALE}) AS HUGEINT) FOR y IN e] AS x FROM v
  WHERE len([1 FOR y IN e IF y IS NOT NULL AND isfinite(y)]) = {WIDTH}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS m FROM (
  SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM x ORDER BY h, x LIMIT {CLUSTERS})),{steps}
{assign.format(i=rounds, w=w)}
SELECT vec_id, CAST(k AS INT) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN x USING (rid) JOIN c{rounds} USING (k)"""


@query("op11_centroids", sql=_sql())
def op11(spark, d) -> DataFrame:
    return cluster(table(spark, d, "embeddings").select("vec_id", "embedding"))
