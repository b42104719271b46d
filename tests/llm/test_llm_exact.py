"""Operators against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import SF_DIR
from pyspark.sql import functions as F

from crawlframe.llm import kd_shards, packing, postings, ppm, secret_scan, simhash, suffix_dedup, toxicity
from crawlframe.llm.common import LOWER, QUERIES
from crawlframe.session import scratch

TOKEN = re.compile("[^\\x20\\x09-\\x0D]+")


def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas()


# --- toxicity ------------------------------------------------------------------------

def brute_segments(v):
    """A segment is maximal if all its proper parts score less and nothing that holds it is such."""
    n = len(v)
    pre = np.concatenate([[0], np.cumsum(v)])
    good = [(a, b) for a in range(n) for b in range(a, n)
            if all(pre[a] < pre[k] for k in range(a + 1, b + 2)) and all(pre[k] < pre[b + 1] for k in range(a, b + 1))]
    return sorted((a, b) for a, b in good if not any((c, d) != (a, b) and c <= a and b <= d for c, d in good))


def test_maximal_segments():
    rnd = random.Random(1)
    for _ in range(300):
        v = [rnd.choice([-3, -2, -1, 1, 2, 4]) + rnd.random() for _ in range(rnd.randrange(12))]
        got = toxicity.maximal_segments(v)
        assert sorted((a, b) for a, b, _ in got) == brute_segments(v)
        assert all(abs(sum(v[a:b + 1]) - s) < 1e-9 for a, b, s in got)


def test_toxicity_learns_planted_words(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        text = [rnd.choice(words) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            text[30:30] = ["vile", "foul", "vile"]
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    for i, y in labels:
        assert (got[i].tox_score >= 0.5) == bool(y)
        if y:
            assert [(s["first"], s["last"]) for s in got[i].tox_segments] == [(30, 32)]


# --- near duplicates -----------------------------------------------------------------

def brute_fingerprint(text):
    w = TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w)] if len(w) < 3 else [" ".join(w[i:i + 3]) for i in range(len(w) - 2)]
    count = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for j in range(64):
            count[j] += h >> j & 1
    return sum(1 << j for j in range(64) if 2 * count[j] > len(grams))


def brute_components(nodes, near):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if near(a, b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in nodes}


def test_simhash_query(spark):
    d = docs(spark)
    want = {i: brute_fingerprint(t) for i, t in zip(d.doc_id, d.text)}
    ids = sorted(want)
    roots = brute_components(ids, lambda a, b: (want[a] ^ want[b]).bit_count() <= 2)
    got = QUERIES["op5_simhash"](spark, SF_DIR).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {i: (want[i], roots[i]) for i in ids}


@pytest.mark.parametrize("join,task", [(32, 4096), (1, 4096), (1, 3)])
def test_pigeonring_links_every_path(spark, monkeypatch, join, task):
    """All three ways through a bucket, on fingerprints that crowd together."""
    monkeypatch.setattr(simhash, "JOIN", join)
    monkeypatch.setattr(simhash, "TASK", task)
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(6)]
    fps = list({b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(4))) for b in base for _ in range(40)})
    d = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fingerprint long")
    from crawlframe.llm.components import components

    got = {r.node: r.root for r in components(simhash.links(d)).collect()}
    nodes = [simhash._signed(f) for f in fps]
    want = brute_components(sorted(nodes), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {n: got.get(n, n) for n in nodes} == want


def test_components_of_a_path(spark):
    from crawlframe.llm.components import components

    order = list(range(200))
    random.Random(1).shuffle(order)
    d = spark.createDataFrame([*zip(order, order[1:]), (None, 1), (5, 5)], "a long, b long")
    assert {r.root for r in components(d).collect()} == {0}


# --- packing -------------------------------------------------------------------------

def test_packing_query(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.word_bpe())
    got = defaultdict(list)
    rows = QUERIES["op1_packing"](spark, SF_DIR).collect()
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    total = 0
    for i, t in zip(*(docs(spark)[c] for c in ("doc_id", "text"))):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        assert sorted(got[i]) == [(k, s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes()))
                                  for k, s in enumerate(range(0, len(ids), 2048))]
    assert len({r.sequence_id for r in rows}) <= -(-total // 2048) + 1


def test_word_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(packing.word_bpe()), packing.WordTokens(packing.word_bpe(), 5, 5)
    for t in ["Don't STOP İstanbul ſtraße x²½ <|endoftext|>a b<|startoftext|>", "ΑΣ ΣΑΣ é é 中文", "a\x1cd\x85e \x0bf\xa0g",
              "it's we'll THEY'D 12ab3 ___--!!", "ﬁ ＡＢ 😀👍🏽 ‍ x", "\x00 a\x00b", ""]:
        assert np.frombuffer(own.encode(t.encode()), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_best_fit_packs_tightly():
    rng = np.random.default_rng(1)
    p = packing.Packing(rng.integers(1, 2049, 3000), 2048, rng)
    pop = p.evolve([p.start(0.0), p.start(0.05)], 6)
    for bins in pop:
        assert p.fills(bins).max() <= 2048
    assert -p.fitness(pop[0])[0] <= p.bound * 1.02


# --- language model ------------------------------------------------------------------

def test_ppm_against_a_plain_trie(spark):
    rnd = random.Random(3)
    text = lambda abc, n: "".join(rnd.choice(abc) for _ in range(n))
    train = [text("abcab é", rnd.randrange(60)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(train + [text("abCdz ", 30) for _ in range(5)] + [""])] + [(99, None)]
    count = [defaultdict(Counter) for _ in range(6)]
    full = lambda t: ppm.START * 5 + (t or "").encode().translate(LOWER) + ppm.END
    for _, t in rows[:30]:
        s = full(t)
        for i in range(5, len(s)):
            count[5][s[i - 5:i]][s[i]] += 1
    for j in range(4, -1, -1):
        for ctx, c in count[j + 1].items():
            for x in c:
                count[j][ctx[1:]][x] += 1

    def prob(ctx, x):
        gone, p = set(), 1.0
        for j in range(5, -1, -1):
            c = {k: n for k, n in count[j].get(ctx[5 - j:], {}).items() if k not in gone}
            if x in c:
                return p * (c[x] - 0.5) / sum(c.values())
            if c:
                p *= 0.5 * len(c) / sum(c.values())
            gone |= set(count[j].get(ctx[5 - j:], {}))
        return p / (256 - len(gone))

    assert abs(sum(prob(b"zzabc", x) for x in range(256)) - 1) < 1e-9
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.score(d, F.col("doc_id") < 30).collect()}
    words = {i: [*TOKEN.findall((t or "").lower()), "\n"] for i, t in rows}
    seen = Counter(w for i, t in rows[:30] for w in words[i])
    total = sum(seen.values())
    for i, t in rows:
        s = full(t)
        assert abs(got[i].score - sum(math.log10(prob(s[k - 5:k], s[k])) for k in range(5, len(s)))) < 1e-9
        base = sum(math.log10((seen[w] + 0.5) / (total + 0.5 * (len(seen) + 1))) for w in words[i])
        assert abs(got[i].base_score - base) < 1e-9 and got[i].train_tokens == total
        assert (got[i].n_tokens, got[i].n_known) == (len(words[i]), sum(seen[w] > 0 for w in words[i]))


def test_ppm_sends_packed_rows(spark, monkeypatch):
    """Blocks and buckets change no score, and a block sends one row to a bucket, not one per gram."""
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["stone", "Berg", "矿产", "run", "x" * 9]) + str(r.randrange(50)) for _ in range(80))) for i in range(40)]
    d = spark.createDataFrame([*rows, (40, None), (41, ""), (2, rows[2][1])], "doc_id long, text string").repartition(3, "doc_id")
    d.write.parquet(path := scratch(spark, "ppm-test"))
    d, train = spark.read.parquet(path), F.col("doc_id") % 3 > 0
    plain = sorted(ppm.score(d, train).collect())
    monkeypatch.setattr(ppm, "BLOCK", 4000)
    monkeypatch.setattr(ppm, "BUCKET", 2000)
    made = []
    monkeypatch.setattr(ppm, "scratch", lambda s, name: made.append(scratch(s, name)) or made[-1])
    cut = sorted(ppm.score(d, train).collect())
    assert [x[:5] for x in cut] == [x[:5] for x in plain] and len(cut) == 43
    assert np.allclose([x[5:] for x in cut], [x[5:] for x in plain], rtol=1e-12)
    sent = spark.read.parquet(made[0]).where("kind = 0").select("block", "bucket", "packed", "counts").collect()
    buckets = {x.bucket for x in sent}
    assert len({x.block for x in sent}) > 3 and len(buckets) > 5
    assert len(sent) == len({(x.block, x.bucket) for x in sent})
    grams = sum(len(ppm.steps(x.packed)) for x in sent)
    assert grams > 10 * len(sent) and sum(len(x.packed) + len(x.counts) for x in sent) < 10 * grams


# --- nearest neighbours --------------------------------------------------------------

def brute_nearest(ids, x, q, k):
    s = postings.products(x[q:q + 1], x)[0]
    s[q] = -np.inf
    top = np.lexsort((ids, -s))[:k]
    return list(zip(range(1, k + 1), ids[top].tolist(), s[top].tolist()))


def test_postings_with_copies_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(postings, "PAGE", 50)
    monkeypatch.setattr(postings, "LISTS", 0.6)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    x[200:420] = x[200]  # a third of all rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1020, [0.0] * 8), (1040, [1.0] * 7 + [float("nan")]), (1060, [1.0] * 7 + [None]), (None, [1.0] * 8), (1080, [1.0] * 5)]
    d = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in postings.nearest(d, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ids, full = np.arange(600), x.astype(np.float64)
    assert sorted(got) == list(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        want = brute_nearest(ids, full, q, 20)
        assert [r for r, *_ in sorted(found)] == list(range(1, 21))
        hits += len({v for _, v, _ in found} & {v for _, v, _ in want})
        assert all(s == full[v].astype(float) @ full[q] or abs(s - full[v] @ full[q]) < 1e-12 for _, v, s in found)
    assert hits >= 0.95 * 20 * len(got)


def test_postings_recall_on_the_table(spark):
    t = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.array(t.embedding.tolist(), np.float64), t.vec_id.to_numpy()
    got = QUERIES["op6_postings"](spark, SF_DIR).toPandas()
    hit = sum(len({v for _, v, _ in brute_nearest(ids, x, int(np.searchsorted(ids, q)), 20)} & set(f.vec_id)) for q, f in got.groupby("query_id"))
    assert hit >= 0.9 * len(got)


# --- passages ------------------------------------------------------------------------

def brute_passages(rows):
    count = Counter(b[i:i + 400] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - 399))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if count[b[k:k + 400]] > 1:
                gone[k:k + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("kinds", [20_000, 3])
def test_passages(spark, monkeypatch, kinds):
    """Both ways of comparing contexts, with self-overlap, copies and passages at the length's edge."""
    monkeypatch.setattr(suffix_dedup, "KINDS", kinds)
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    shared = [text(n) for n in (400, 401, 450, 800, 399, 1200)]
    rows = [(i, text(rnd.randrange(900)) + rnd.choice(shared) + text(rnd.randrange(500)) + rnd.choice(shared)[rnd.randrange(60):]) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "a" * 1500), (103, "a" * 401), (104, "ab" * 700 + text(30) + "ab" * 300), (107, text(500)),
             (107, text(500)), (108, rows[3][1]), (108, rows[3][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeated(d).select("doc_id", "n_bytes", "n_removed", F.size("removed"), F.sha2("kept", 256)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_passages(rows)


def brute_passage_words(rows):
    """Words of a row that a run of 51 words covers which a row with another id or text has too."""
    held = defaultdict(set)
    split = [(t or "").split() for _, t in rows]
    for row, w in zip(rows, split):
        for k in range(len(w) - 50):
            held[tuple(w[k:k + 51])].add(row)
    out = []
    for (i, _), w in zip(rows, split):
        covered = set()
        for k in range(len(w) - 50):
            if len(held[tuple(w[k:k + 51])]) > 1:
                covered |= set(range(k, k + 51))
        out.append((i, len(covered)))
    return sorted(out, key=str)


@pytest.mark.parametrize("kinds,part", [(20_000, 1 << 20), (3, 40)])
def test_passage_words(spark, monkeypatch, kinds, part):
    """Passages of over 50 words under 400 bytes, at the length's edge, beside copies and repeats in one document."""
    monkeypatch.setattr(suffix_dedup, "KINDS", kinds)
    monkeypatch.setattr(suffix_dedup, "WORD_PART", part)
    rnd = random.Random(6)
    text = lambda n: [rnd.choice(["ab", "cde", "fgh", "éa", "ij"]) + rnd.choice("klmnop") for _ in range(n)]
    shared = [text(n) for n in (50, 51, 52, 60, 130)]
    blank = lambda w: "".join(x + rnd.choice([" ", "\n", " \t"]) for x in w)
    rows = [(i, blank(text(rnd.randrange(90)) + shared[i % 5] + text(rnd.randrange(1, 60)) + rnd.choice(shared)[rnd.randrange(3):]))
            for i in range(40)]
    once, copy = text(60), " ".join(text(80))
    rows += [(100, None), (101, ""), (102, "a " * 150), (103, " ".join(once + text(9) + once)), (104, copy), (105, copy),
             (107, " ".join(text(70))), (108, "a " * 51), (None, " ".join(text(3) + shared[1]))]
    rows.append(rows[-3])  # the same row again is no other document
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeated(d).select("doc_id", "n_passage_words", "n_removed").collect()
    assert sorted(((r[0], r[1]) for r in got), key=str) == brute_passage_words(rows)
    assert any(r.n_passage_words and not r.n_removed for r in got)


def test_passage_parts_and_deceiving_hashes(spark, monkeypatch):
    """Texts cut into parts, and a hash that makes everything look equal."""
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    rnd = random.Random(8)
    a = bytes(rnd.randrange(97, 100) for _ in range(3000))
    covered = set()
    for _, p, s0, s1 in suffix_dedup.contexts(a):
        assert all(s <= p <= s + 400 - 64 for s in (s0, s1))
        covered |= set(range(s0, s1 + 1))
    assert covered == set(range(2601))
    x = np.frombuffer(a, np.uint8)
    at, size, group = np.arange(0, 900, 10), np.full(90, 50), np.repeat(np.arange(9), 10)
    true = suffix_dedup._sort_plainly(a, at, size, group)
    assert [v.tolist() for v in suffix_dedup.sort_suffixes(x, at, size, group)] == [v.tolist() for v in true]
    monkeypatch.setattr(suffix_dedup, "LETTERS", np.zeros(256, np.uint64))
    assert [v.tolist() for v in suffix_dedup.sort_suffixes(x, at, size, group)] == [v.tolist() for v in true]


# --- secrets, shards -----------------------------------------------------------------

def test_redaction(spark):
    rows = [(1, "é Secret : 'abc' token=\"qQ8zX0pL2mN4bV6cR9tY7uI\" end", 3), (2, "no secret here", 14), (3, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in secret_scan.redact(d).collect()}
    assert got == {1: ("é Secret : 'abc' [SECRET]\" end", 30), 2: rows[1][1:], 3: (None, None)}


def test_shards_are_even_and_gapless(spark):
    rows = [(i, "x" * (i % 37), "en", "hot" if i % 3 else f"s{i}") for i in range(2000)]
    got = kd_shards.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 80
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
