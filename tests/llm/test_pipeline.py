"""The whole pipeline on a small table, each stage's effect recomputed plainly on what went into it."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as CP
from crawlframe.llm import mixing, packing

WORDS = ["stone", "river", "cloud", "garden", "letter", "window", "market", "silver", "harbour", "winter", "music", "paper"]
VILE = ["vile", "wretch", "scum", "filth"]


def table(spark, folder):
    rnd = random.Random(21)
    prose = lambda n: " ".join(rnd.choice(WORDS) + str(rnd.randrange(60)) for _ in range(n))
    docs, labels = [], []
    for i in range(240):
        text = prose(rnd.randrange(40, 160))
        bad = i % 6 == 0
        if bad:
            text = " ".join([text[:len(text) // 2], *rnd.choices(VILE, k=6), text[len(text) // 2:]])
        if i % 7 == 1:
            text += f" token=abc{i}def"
        docs.append((i, text, ["en", "de", None][i % 3], f"src{i % 5}", len(text)))
        labels.append((i, 1, int(bad)))
    for i in range(240, 300):  # copies of clean texts: as they are, or with a word more
        j, more = rnd.choice([k for k in range(240) if k % 6 and k % 7 != 1]), i % 2
        docs.append((i, docs[j][1] + (" more" if more else ""), "en", "src0", docs[j][4] + 5 * more))
    docs += [(300, None, None, None, None), (301, "", "en", "src1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def jaccard(a, b):
    a, b = (set(zip(*(t.split()[k:] for k in range(5)))) for t in (a, b))
    return len(a & b) / max(1, len(a | b))


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipe"))
    docs = table(spark, folder)
    seen, now = [], spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(CP.STAGES):
        path = f"{folder}/{k}"
        stage(spark, now, folder).write.parquet(path)
        now = spark.read.parquet(path)
        seen.append(now.toPandas())
    whole = CP.run(spark, folder).toPandas()
    return docs, seen, whole


def test_toxic_texts_go_and_others_stay(run):
    docs, seen, _ = run
    kept = set(seen[0].doc_id)
    clean = {i for i, t, *_ in docs if not (t and any(v in t for v in VILE))}
    assert clean <= kept and len(kept - clean) <= 2


def test_one_of_each_class_stays(run):
    before, after = run[1][0], run[1][1]
    rows = sorted((i, t or "") for i, t in zip(before.doc_id, before.text))
    root = {i: i for i, _ in rows}
    for a, (i, t) in enumerate(rows):
        for j, u in rows[a + 1:]:
            if t == u or (t and u and jaccard(t, u) >= 0.8):
                x, y = root[i], root[j]
                root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    assert sorted(after.doc_id) == sorted(set(root.values()))


def test_secrets_are_replaced_and_nothing_else(run):
    before, after = (dict(zip(p.doc_id, p.text)) for p in (run[1][1], run[1][2]))
    assert set(before) == set(after)
    for i, t in before.items():
        want = t if t is None else re.sub(r"token=[A-Za-z0-9]+", "[SECRET]", t)
        assert after[i] == want or (t is None and after[i] is None)
    sizes = dict(zip(run[1][2].doc_id, run[1][2].n_chars))
    assert all(t is None or sizes[i] == len(t) for i, t in after.items() if "SECRET" in (t or ""))


def test_mixture_takes_its_budget_once(spark, run):
    before, after = run[1][2], run[1][3]
    assert after.doc_id.is_unique and set(after.doc_id) <= set(before.doc_id)
    count = lambda texts: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts if t)
    whole, taken = count(before.text), count(after.text)
    longest = max(count([t]) for t in before.text)
    leaves = before.groupby([before.source.fillna(""), before.lang.fillna("")]).ngroups
    assert int(whole * CP.SHARE) - leaves <= taken <= whole * CP.SHARE + leaves * longest
    again = mixing.mix(spark.createDataFrame(before[["doc_id", "text", "lang", "source"]].astype(object).where(before.notna(), None),
                                             "doc_id long, text string, lang string, source string"), share=CP.SHARE, epochs=CP.EPOCHS)
    assert {r.doc_id for r in again.select("doc_id").collect()} == set(after.doc_id)


def test_packed_pieces_are_the_tokens_of_the_texts(run):
    texts, packed = dict(zip(run[1][3].doc_id, run[1][3].text)), run[1][4]
    tok = Tokenizer.from_file(packing.word_bpe())
    assert set(packed.doc_id) == set(texts)
    for i, pieces in packed.groupby("doc_id"):
        ids = [*tok.encode(texts[i] or "", add_special_tokens=False).ids, packing.END]
        pieces = pieces.sort_values("piece")
        assert pieces.length.sum() == len(ids)
        for p in pieces.itertuples():
            part = np.array(ids[p.start:p.start + p.length], "<u4")
            assert p.ids_crc32 == zlib.crc32(part.tobytes())
    for _, own in packed.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= packing.CAPACITY


def test_run_is_the_stages_in_order(run):
    _, seen, whole = run
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a, b = (p[key].sort_values(key).reset_index(drop=True) for p in (whole, seen[-1]))
    assert a.equals(b)
