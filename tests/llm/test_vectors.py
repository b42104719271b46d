"""Centroid clustering and whitening against plain computations."""

import hashlib
import math
import random

import numpy as np
import pytest
from conftest import SF_DIR

from crawlframe.llm import centroids, vectors, whitening
from crawlframe.llm.common import QUERIES

SCHEMA = ("vec_id long, embedding array<double>, cluster string, n string, whitened string, component string, row int, "
          "col int, digit int, value long, key binary, h string, v int, w int, s int, `count` int, `odd name` string")
EXTRA = ("x",) * 4 + (1, 2, 3, 4, b"k", "h", 5, 6, 7, 8, "odd")


def data(n=300, width=64, seed=1):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(width)]) for i in range(n)]
    return rows + [rows[-1], rows[-1], (None, rows[1][1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, e, *EXTRA) for i, e in rows], SCHEMA)


BAD = [(901, None), (902, []), (903, [1.0]), (904, [None] + [0.1] * 63), (905, [float("nan")] + [0.1] * 63),
       (906, [float("-inf")] + [0.1] * 63)]


def brute_clusters(rows, k=8, rounds=10):
    x = [(i, [math.floor(1024 * c) for c in e]) for i, e in rows]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    at = [v for _, v in sorted((name(i), v) for i, v in x)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in x]
        for j in range(len(at)):
            mine = [v for (_, v), o in zip(x, own) if o == j]
            if mine:
                at[j] = [sum(c) // len(mine) for c in zip(*mine)]
    got = [(i, *near(v)[::-1]) for i, v in x]
    inertia = [sum(d for _, c, d in got if c == j) for j in range(len(at))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((-1 if i is None else i), c, d, inertia[c], sum(inertia), sha[c]) for i, c, d in got)


def clusters(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia,
                   r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("rows", [data(), data(5), [(i, [0.25] * 64) for i in range(20)],
                                  [(i, [1e30 * (i % 3), 1e300] + [i * 0.1] * 62) for i in range(15)]])
def test_clusters_match_brute_force(spark, rows):
    got = clusters(centroids.cluster(frame(spark, rows + BAD)))
    want = [tuple(vectors.as_long(v) if isinstance(v, int) else v for v in w) for w in brute_clusters(rows)]
    assert got == want


def test_cluster_keeps_extra_columns_and_empty_tables(spark):
    out = centroids.cluster(frame(spark, data(20)))
    assert [c for c in out.columns if c in SCHEMA and c != "cluster"][:3] == ["vec_id", "n", "whitened"]
    assert out.where("`odd name` = 'odd' and value = 4").count() == 23
    assert centroids.cluster(frame(spark, [])).count() == 0
    assert centroids.cluster(frame(spark, BAD)).count() == 0


def test_threshold_search_equals_full_search():
    rng = np.random.default_rng(3)
    for k, dims, spread in [(1, 3, 9), (8, 64, 300), (60, 2, 5), (40, 4, 1000)]:
        at = rng.integers(-spread, spread, (k, dims))
        x = rng.integers(-spread, spread, (500, dims))
        who, far = centroids.Lists(at).nearest(x)
        full = ((x[:, None] - at[None]) ** 2).sum(2)
        assert (who == full.argmin(1)).all() and (far == full.min(1)).all()
        big, dist = centroids.Lists(at.astype(object) * 10 ** 30).nearest(x.astype(object) * 10 ** 30)
        assert (big == who).all() and [d // 10 ** 60 for d in dist] == far.tolist()


def test_scatter_is_exact():
    rng = np.random.default_rng(4)
    for n, width, spread in [(1, 1, 1), (63, 3, 2), (64, 5, 100), (500, 7, 1 << 20), (130, 3, 1 << 60)]:
        y = rng.integers(-spread, spread, (n, width))
        want = y.astype(object).T @ y.astype(object)
        assert (whitening.scatter(y) == want).all()


def test_packing_of_vectors_is_a_key():
    y = np.array([[1, -128], [1, 127], [1, 128], [-129, 0], [1 << 40, 3], [1, -128]])
    keys = whitening.packed(y)
    assert keys[0] == keys[5] and len(set(keys)) == 5
    assert (whitening.unpacked(keys, 2) == y).all()


def brute_whiten(rows):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in e] for _, e in rows], dtype=object)
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, s = len(fit), fit.sum(0)
    d = n * fit - s
    cov = np.array((d.T @ d), dtype=float) / n ** 3
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    w = np.array([[float(v) / n for v in row] for row in n * x - s]) @ u / np.sqrt(e)
    return n, ((n * x - s) ** 2).sum(1), w, e / np.trace(cov)


def test_whitening_matches_brute_force(spark):
    rows = [(i, [v * (1 + d) for d, v in enumerate(e)]) for i, e in data(200)]
    got = whitening.whiten(frame(spark, rows + BAD)).collect()
    n, deviation, w, explained = brute_whiten(rows)
    assert len(got) == 16 * len(rows)
    by = {}
    for r in got:
        assert r.n == n and 0 <= r.identity_error < 1e-9 and abs(r.explained - explained[r.component - 1]) < 1e-12
        assert r.deviation == int(r.deviation_exact) and r["odd name"] == "odd"
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r.whitened
    sign = None
    for (i, _), far, want in zip(rows, deviation, w):
        mine = np.array([by[i, far][c] for c in range(1, 17)])
        sign = np.sign(mine * want) if sign is None else sign
        assert np.allclose(mine * sign, want, atol=1e-8)


def test_whitening_of_degenerate_tables(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, BAD[:2])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [0.5] * 3), (2, [0.5] * 3)])).count() == 0
    out = whitening.whiten(frame(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [2.0])]))
    assert sorted((r.vec_id, r.component, r.n) for r in out.collect()) == [(1, 1, 2), (2, 1, 2), (3, 1, 2)]
    huge = whitening.whiten(frame(spark, [(i, [1e300 * i, -1e30, 0.1 * i]) for i in range(4)]))
    assert all(r.identity_error < 1e-4 for r in huge.collect()) and huge.count() >= 4


def test_whitening_query(spark):
    d = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").toPandas()
    rows = [(r.vec_id, [float(v) for v in r.embedding]) for r in d.itertuples()]
    n, deviation, w, explained = brute_whiten(rows)
    got = QUERIES["op12_whitening"](spark, SF_DIR).toPandas().sort_values(["vec_id", "component"])
    order = np.argsort([i for i, _ in rows])
    assert (got.n == n).all() and got.identity_error.max() < 1e-9
    assert got.deviation.to_numpy().reshape(-1, 16)[:, 0].tolist() == [deviation[i] for i in order]
    mine = got.whitened.to_numpy().reshape(-1, 16)
    assert np.allclose(np.abs(mine), np.abs(w[order]), atol=1e-8)
    assert np.allclose(got.explained.to_numpy().reshape(-1, 16), explained, atol=1e-12)


def test_sums_of_any_size(spark):
    values = [3, -1, 1 << 62, -(1 << 62), 10 ** 60, -(10 ** 60) + 5, 10 ** 100]
    flat = [d for k, v in enumerate(values) for d in vectors.digits(0, k % 2, v)]
    got = vectors.total(spark.createDataFrame(flat, vectors.SUM_SCHEMA))
    assert got == {(0, k): sum(values[k::2]) for k in (0, 1)}
