"""Null, empty, long, repeated and clashing input for every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as CP
from crawlframe.llm import kd_shards, line_rules, mixing, near_copies, packing, postings, ppm, secret_scan, simhash, suffix_dedup, toxicity

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string, piece int, "
    "length long, size long, shard int, kept boolean, tox_score double, base_spans string, sequence_id long"
)


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(["alpha", "beta", "gamma.", "delta", "épsilon", "zeta\n", "eta"]) + str(rnd.randrange(50)) for _ in range(n))


def rows():
    texts = [(1, prose(1, 80)), (2, prose(1, 80)), (3, None), (4, ""), (5, "one"), (6, prose(6, 30_000)), (7, prose(7, 90)),
             (7, prose(7, 90)), (None, prose(8, 60)), (None, None), (9, " \n\t "), (10, "password=abcdef123 " + prose(9, 60))]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"src{k}", None, 0.5, "x", 1, 2, 3, 4, True, 0.1, "y", 5)
            for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LABELS = "doc_id long, quality int, toxic int"


def all_ops(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (5, None, None), (None, 1, 1)], LABELS)
    yield "toxicity", toxicity.score(docs, toxicity.fit(docs, labels))
    yield "simhash", simhash.classes(simhash.fingerprints(docs))
    yield "secrets", secret_scan.scan(docs)
    yield "redact", secret_scan.redact(docs)
    yield "ppm", ppm.score(docs, F.coalesce(F.col("doc_id"), F.lit(0)) < 6)
    yield "lines", line_rules.quality(docs)
    yield "suffix", suffix_dedup.remove_repeated(docs)
    yield "shards", kd_shards.shard(docs)


def test_messy_rows_keep_their_number(spark, messy):
    for name, out in all_ops(spark, messy):
        assert out.count() == len(rows()), name


INNER = ("__given __t __id __tie __piece __node __next __at __before __host __text __lines __key __gone __domain __lang __source __epoch "
         "__tokens __bucket __full __part __edge __start __l __h _text _key _i _k _fp _root _least _forest node root key h w n fp m id text_key "
         "kept removed spans want anchor kind gid list page").split()


def test_any_extra_column_name(spark):
    texts = [(1, prose(1, 80)), (2, prose(1, 80)), (3, None), (4, ""), (5, prose(5, 90) + " token=abc123")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in INNER)
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", 1, *INNER) for i, t in texts], schema)
    for name, out in all_ops(spark, docs):
        assert out.count() == len(texts), name
    tokens = packing.token_pieces(docs, packing.word_bpe())
    passed = {
        "mix": mixing.mix(docs, share=1.0, epochs=1), "keep_one": simhash.keep_one(docs), "near": near_copies.keep_one(docs),
        "shard": kd_shards.shard(docs), "clean": line_rules.clean(docs), "quality": line_rules.quality(docs), "scan": secret_scan.scan(docs),
        "redact": secret_scan.redact(docs), "print": simhash.fingerprints(docs), "pieces": tokens, "classes": simhash.classes(simhash.fingerprints(docs))}
    for name, out in passed.items():
        made = {"mix": mixing.MADE, "clean": line_rules.MADE, "quality": line_rules.MADE}.get(name, [])
        row = out.orderBy("doc_id").first()
        for n in INNER:
            if n not in made:
                assert row[n] == n, (name, n)
    assert packing.pack(tokens.select("doc_id", "piece", "start", "length", "ids_crc32")).count() == len(texts)


def test_empty_tables(spark, empty):
    for name, out in all_ops(spark, empty):
        assert out.count() == 0, name
    assert packing.pack(packing.token_pieces(empty, packing.word_bpe())).count() == 0
    assert mixing.mix(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert postings.nearest(none, F.lit(True)).count() == 0


def test_packing_messy(messy):
    out = packing.pack(packing.token_pieces(messy, packing.word_bpe())).collect()
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sum(r.length == 1 for r in out) == 4  # null, empty and blank texts hold the end only
    assert sum(r.piece == 0 for r in out) == len(rows())


def test_mixing_messy(messy):
    taken = mixing.mix(messy, share=1.0, epochs=1)
    # With the whole budget every document of a leaf that has tokens is in, repeated rows both.
    assert taken.where("doc_id = 7").count() == 2
    assert taken.agg(F.sum("__tokens")).first()[0] == messy.agg(F.sum(mixing.token_count(F.col("text")))).first()[0]


def test_keep_one_messy(messy):
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 1 in ids and 2 not in ids and ids.count(7) == 1 and 3 in ids and 4 not in ids


def test_stages_keep_columns(spark, messy, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs = messy.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in CP.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert CP.STAGES[-1][1](spark, docs, str(tmp_path)).where("piece = 0").count() == docs.count()
