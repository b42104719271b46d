"""Near copies of the pipeline's stage against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline as CP
from crawlframe.llm import near_copies


def jaccard(a, b):
    a, b = (set(zip(*(t.split()[i:] for i in range(5)))) for t in (a, b))
    return len(a & b) / len(a | b)


def changed(text, rnd, n):
    w = text.split()
    for at in rnd.sample(range(len(w)), n):
        w[at] = f"new{rnd.randrange(10**9)}"
    return " ".join(w)


def brute(rows):
    root = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if i < j and jaccard(a, b) >= 0.8:
                x, y = root[i], root[j]
                root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    return sorted(set(root.values()))


@pytest.mark.parametrize("task, bits", [(1024, 1 << 27), (3, 0)])
def test_stage_drops_what_all_pairs_drop(spark, monkeypatch, task, bits):
    monkeypatch.setattr(near_copies, "TASK", task)
    monkeypatch.setattr(near_copies, "BITS", bits)
    rnd = random.Random(5)
    rows = []
    for k in range(12):
        first = " ".join(f"w{rnd.randrange(3000)}" for _ in range(300))
        rows.append((len(rows), first))
        for _ in range(5):  # from one word changed to far below the limit, some only over another copy
            rows.append((len(rows), changed(rnd.choice(rows[6 * k:])[1], rnd, rnd.choice([1, 3, 5, 6, 8, 20]))))
    line = " ".join(f"menu{i}" for i in range(8))
    for _ in range(2):  # clean texts with one line many times
        rows.append((len(rows), " ".join([line] * 60 + [f"own{rnd.randrange(10**6)}" for _ in range(60)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in CP.drop_near_copies(spark, docs, "").collect())
    want = brute(rows)
    assert got == want and 12 < len(want) < len(rows)
    assert {len(rows) - 2, len(rows) - 1} <= set(got)


def copies(n, share, seed):
    """Texts of 400 words that share a part with each other: any two have about the same similarity."""
    rnd = random.Random(seed)
    base = [f"b{rnd.randrange(10**6)}" for _ in range(400)]
    return [" ".join(base[:int(400 * share)] + [f"x{rnd.randrange(10**9)}" for _ in range(400 - int(400 * share))]) for _ in range(n)]


@pytest.mark.parametrize("share, classes", [(0.87, 2_000), (0.91, 1)])
def test_two_thousand_copies_around_the_limit(spark, share, classes):
    texts = copies(2_000, share, 3)
    assert (jaccard(texts[0], texts[1]) >= 0.8) == (classes == 1) and jaccard(texts[0], texts[1]) > 0.72
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    narrow = docs.selectExpr("doc_id", "xxhash64(text) AS _key", "text")
    marked = near_copies.marks(narrow)
    found = near_copies.links(narrow, marked)
    assert found.count() <= 25 * len(texts)  # a link per node and key at most, not one per pair
    assert near_copies.keep_one(docs).count() == classes


def test_task_gives_a_forest():
    texts = copies(60, 0.95, 4)
    sets = [near_copies.shingles(t.encode()) for t in texts]
    sigs = np.array([near_copies.signature(x) for x in sets])
    fp = np.arange(60)
    a, b = near_copies.forest(fp, fp, np.zeros(60, int), sigs, sets)
    assert len(a) == 59
    a, b = near_copies.forest(fp, fp // 30, np.zeros(60, int), sigs, sets)
    assert len(a) == 1
    a, b = near_copies.forest(fp, fp, fp % 2, sigs, sets)
    assert len(a) == 59 and all((x - y) % 2 for x, y in zip(a, b))


def test_recall_at_the_limit():
    rnd = random.Random(12)
    hit = n = 0
    for k in range(300):  # pairs from 0.8 up to about 0.9
        one = copies(1, 1.0, k)[0]
        two = changed(one, rnd, rnd.choice([6, 7, 8, 9]))
        x, y = (near_copies.shingles(t.encode()) for t in (one, two))
        if jaccard(one, two) >= 0.8:
            n += 1
            hit += (near_copies.signature(x) == near_copies.signature(y)).reshape(near_copies.BANDS, near_copies.ROWS).all(axis=1).any()
    assert n > 150 and hit >= 0.99 * n


def test_signatures_estimate_similarity():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 5000, np.uint64))
    a, b = near_copies.signature(x[:4500]), near_copies.signature(x[500:])
    assert abs((a == b).mean() - 0.8) < 0.15


def test_null_ids_of_one_class_leave_one_row(spark):
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(None, text), (None, text + " more"), (None, ""), (None, None)], "doc_id long, text string")
    assert CP.drop_near_copies(spark, docs, "").count() == 2


def test_simhash_finds_candidates_of_its_own(spark):
    """Close texts are candidates by SimHash; a line that rules two texts makes them candidates, but no near copies."""
    rnd = random.Random(8)
    long_ = [" ".join(f"w{rnd.randrange(9000)}" for _ in range(2_000)) for _ in range(6)]
    line = " ".join(f"menu{i}" for i in range(9))
    texts = [*long_, *(t + " more" for t in long_), *(" ".join([line] * 60 + [f"own{rnd.randrange(10**6)}" for _ in range(60)]) for _ in range(2))]
    docs = spark.createDataFrame([*enumerate(texts), (99, None), (98, "")], "doc_id long, text string")
    marked = near_copies.marks(docs.selectExpr("doc_id", "xxhash64(text) AS _key", "text"))
    node = {r.doc_id: r.fingerprint for r in marked.collect()}
    pairs = {(r.a, r.b) for r in near_copies.ring_pairs(marked).collect()}
    found = [i for i in range(6) if tuple(sorted((node[i], node[i + 6]))) in pairs]
    assert len(found) >= 4 and tuple(sorted((node[12], node[13]))) in pairs
    assert sorted(r.doc_id for r in CP.drop_near_copies(spark, docs, "").collect()) == [0, 1, 2, 3, 4, 5, 12, 13, 98]
