"""Which lists a query visits, and recall against brute force with all 4,096 lists."""

import numpy as np
from pyspark.sql import functions as F

from crawlframe.llm import postings


def test_lists_within_a_ratio():
    rng = np.random.default_rng(2)
    c = rng.standard_normal((600, 8))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    g, x = postings.Graph(c), c[:40] + 0.1
    many = np.full(600, 250)
    for ratio in (1.0, 1.5, 100.0):
        for q, (ids, dist) in zip(x, g.within(x, ratio, 2, many, 84)):
            full = np.sort(((c - q) ** 2).sum(1))
            assert len(ids) == len(set(ids)) >= 2 and (np.diff(dist) >= 0).all()
            if ratio == 100.0:
                assert len(ids) == 600  # no cap
            elif len(ids) > 2:
                assert abs(len(ids) - (full <= ratio ** 2 * full[0] + 1e-12).sum()) <= 0.1 * len(ids)
    # Nearly empty lists: it goes on until 21 vectors are sure to be found.
    assert all(len(ids) >= 84 for ids, _ in g.within(x, 1.0, 2, np.ones(600, int), 84))
    assert all(len(ids) == 600 for ids, _ in g.within(x, 1.0, 2, np.zeros(600, int), 84))


def test_recall_with_all_lists(spark, monkeypatch):
    monkeypatch.setattr(postings, "LISTS", 32)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((16_384, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    made = []
    fit = postings.fit_centroids
    monkeypatch.setattr(postings, "fit_centroids", lambda s, n: made.append(n) or fit(s, n))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = postings.nearest(d, F.col("vec_id") % 512 == 0).toPandas()
    assert made == [4096]
    hits = 0
    for q in range(0, len(x), 512):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(got[got.query_id == q].vec_id))
    recall = hits / (20 * 32)
    print("recall", recall)
    assert recall >= 0.9
