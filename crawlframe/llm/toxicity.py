"""Toxicity by maximal-scoring segments of token log-odds.

Learning takes labelled rows in two parts. The larger part gives each word a
log-odds score: its share of toxic occurrences under a Dirichlet prior whose
mean is the share of the word's leading letters, which in turn has the overall
share as prior mean. Words without clear evidence are neutral and cost `DRIFT`.
The other part calibrates: an extreme-value (Gumbel) law of the best segment of
clean texts, as a function of their length, and a logistic curve over the
evidence of all significant segments.

Scoring scans each whole text once and finds every maximal segment in linear
time. Defined cases: null and empty texts have no segment and get the score of
no evidence; without labelled rows, or with one class only, every score is the
share of toxic labels seen (0 if none); repeated rows are scored alike.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.llm.common import cols, query, split_of, table, text_bytes, without, words
from crawlframe.session import cut_lineage, ship_package

#: Most labelled rows that the classifier is fitted on, and most words it keeps.
FIT_ROWS, LEXICON = 20_000, 50_000
#: Leading letters that words share a prior by; pseudo-counts of both priors.
STEM, PRIOR = 4, 2.0
#: Cost of a neutral word inside a segment; segments need a negative mean score.
DRIFT = 0.25
MADE = ["tox_score", "tox_segments", "tox_p_value"]


@dataclass
class ToxicModel:
    """Bounded: at most `LEXICON` words and stems with their scores, and five numbers."""

    scores: dict[bytes, float] = field(default_factory=dict)
    stems: dict[bytes, float] = field(default_factory=dict)
    lam: float = 1.0
    log_k: float = 0.0
    bias: float = 0.0
    slope: float = 0.0
    known: bool = False


def maximal_segments(values: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a score list as (first, last, score), in linear time.

    Every open segment holds the totals before and after it and a link to the
    nearest earlier segment that starts from a lower total, so that a search
    never visits a segment twice.
    """
    open_: list[tuple[int, float, float, int, int]] = []  # first, before, after, link, last
    total = 0.0
    for i, v in enumerate(values):
        before, total = total, total + v
        if v <= 0:
            continue
        first, j = i, len(open_) - 1
        while True:
            while j >= 0 and open_[j][1] >= before:
                j = open_[j][3]
            if j < 0 or open_[j][2] >= total:
                open_.append((first, before, total, j, i))
                break
            first, before, _, link, _ = open_[j]
            del open_[j:]
            j = link
    return [(a, z, after - before) for a, before, after, _, z in open_]


def _strip(word: bytes) -> bytes:
    return word.strip(b".,;:!?\"'()[]{}*#$%&|<>")


def segments(text: bytes | None, model: ToxicModel) -> tuple[list[tuple[int, int, float]], int]:
    """Maximal segments as (first word, last word, score), and the number of words."""
    tokens = words(text)
    at, values = [], []
    get, stem = model.scores.get, model.stems.get
    last = -1
    for i, w in enumerate(tokens):
        s = get(w)
        if s is None:
            w = _strip(w)
            s = get(w)
            if s is None:
                s = stem(w.decode("utf-8", "replace")[:STEM].encode())
                if s is None:
                    continue
        if last >= 0 and i - last > 1:
            at.append(last + 1)
            values.append(-DRIFT * (i - last - 1))
        at.append(i)
        values.append(s)
        last = i
    return [(at[a], at[z], s) for a, z, s in maximal_segments(values)], len(tokens)


def evidence(found: list[tuple[int, int, float]], n: int, model: ToxicModel) -> tuple[float, float]:
    """(-log p of the best segment, log1p of the summed evidence of the significant ones)."""
    if not found:
        return 0.0, 0.0
    log_e = [model.log_k + math.log(max(n, 1)) - model.lam * s for _, _, s in found]
    best = min(log_e)
    p = -math.expm1(-math.exp(min(best, 50.0)))
    neg = -math.log(p) if p > 1e-300 else -best
    return neg, math.log1p(sum(-x for x in log_e if x < 0))


def _sample(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """At most `FIT_ROWS` labelled rows, taken by a hash of the id: (doc_id, y, part)."""
    rows = labels.where(F.col(label).isin(0, 1)).select(
        F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"),
        F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("fit")), F.lit(1 << 20)).alias("_h"),
    ).where("_id IS NOT NULL").groupBy("_id", "_h").agg(F.max("_y").alias("_y"))
    n = rows.count()
    if n > FIT_ROWS:
        rows = rows.where(F.col("_h") < int((1 << 20) * 0.97 * FIT_ROWS / n)).limit(FIT_ROWS)
    return rows.select("_id", "_y", (F.col("_h") % 4 == 0).alias("_late"))


def _count_words(batches: Iterator) -> Iterator:
    """Per task: in how many texts of either class each word and each stem occurs."""
    import pyarrow as pa

    seen: Counter = Counter()

    def out():
        keys = list(seen)
        return pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.bool_()), pa.array([k[1] for k in keys], pa.binary()),
            pa.array([k[2] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64()),
        ], ["stem", "word", "y", "n"])

    for b in batches:
        for text, y in zip(text_bytes(b.column(0)), b.column(1).to_pylist()):
            own = {_strip(w) for w in words(text)} - {b""}
            seen.update((False, w, y) for w in own)
            seen.update((True, s, y) for s in {w.decode("utf-8", "replace")[:STEM].encode() for w in own})
        if len(seen) > 400_000:
            yield out()
            seen.clear()
    if seen:
        yield out()


def _lexicon(docs: DataFrame, n_toxic: int, n_all: int) -> ToxicModel:
    ship_package(docs.sparkSession)
    counts = docs.mapInArrow(_count_words, "stem boolean, word binary, y int, n bigint")
    counts = counts.groupBy("stem", "word").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum("n").alias("n")
    ).where("n >= 3")
    counts = cut_lineage(counts)  # read twice below; the sample bounds its size
    share = n_toxic / n_all
    # A word is kept if chance would hardly give so uneven a count to any of all words (Chernoff
    # bound against the number of words), and if its rate differs from the share by half a unit.
    t, n = F.col("t").cast("double"), F.col("n").cast("double")
    kl = F.when(t > 0, t * F.log(t / (n * share))).otherwise(0.0) + F.when(
        t < n, (n - t) * F.log((n - t) / (n * (1 - share)))).otherwise(0.0)
    rate = (t + PRIOR * share) / (n + PRIOR)
    effect = F.abs(F.log(rate / (1 - rate)) - math.log(share / (1 - share)))
    strong = counts.withColumn("kl", kl).where((F.col("kl") >= 4) & (effect >= 0.5))
    sizes = counts.agg(F.count(F.lit(1))).first()[0]
    rows = strong.where(F.col("kl") >= math.log(max(sizes, 1))).orderBy(
        F.col("kl").desc(), "stem", "word").limit(LEXICON).collect()
    base = math.log(share / (1 - share))
    model = ToxicModel(known=True)

    def score(t: float, n: float, mean: float) -> float:
        rate = (t + PRIOR * mean) / (n + PRIOR)
        return math.log(rate / (1 - rate)) - base

    means = {}
    for r in rows:
        if r["stem"]:
            word = bytes(r["word"])
            means[word] = (r["t"] + PRIOR * share) / (r["n"] + PRIOR)
            model.stems[word] = score(r["t"], r["n"], share) - DRIFT
    for r in rows:
        if not r["stem"]:
            word = bytes(r["word"])
            mean = means.get(word.decode("utf-8", "replace")[:STEM].encode(), share)
            model.scores[word] = score(r["t"], r["n"], mean) - DRIFT
    return model


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic") -> ToxicModel:
    """Fit on at most `FIT_ROWS` labelled rows; `labels` must hold training rows only.

    Only that bounded sample of labels is broadcast. What reaches the driver is
    the lexicon (at most `LEXICON` entries) and, twice, two numbers per sampled id.
    """
    spark = docs.sparkSession
    sample = _sample(labels, doc_id, label)
    picked = sample.collect()
    early = [r for r in picked if not r["_late"]]
    n1, n = sum(r["_y"] for r in early), len(early)
    share = sum(r["_y"] for r in picked) / len(picked) if picked else 0.0
    if not 0 < n1 < n:
        return ToxicModel(bias=share)
    bounded = spark.createDataFrame([tuple(r) for r in picked], sample.schema)
    joined = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(
        F.broadcast(bounded), "_id")
    model = _lexicon(joined.where("NOT _late").select("_text", "_y"), n1, n)

    def held(measure) -> list:
        """(y, x, n) of the late rows, `x` being what `measure` makes of a text's segments; one row per sampled id."""
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                found = [segments(t, model) for t in text_bytes(b.column(0))]
                yield pa.RecordBatch.from_arrays([
                    b.column(1), b.column(2), pa.array([measure(f, m) for f, m in found], pa.float64()),
                    pa.array([m for _, m in found], pa.int64())], ["id", "y", "x", "n"])

        kind = joined.schema["_id"].dataType.simpleString()
        rows = joined.where("_late").select("_text", "_id", "_y").mapInArrow(run, f"id {kind}, y int, x double, n bigint")
        # An id may stand for several rows; the one with the least figures stands for it.
        return rows.groupBy("id").agg(F.min(F.struct("y", "n", "x")).alias("m")).select("m.*").orderBy("y", "n", "x").collect()

    best = held(lambda found, _: max((s for *_, s in found), default=0.0))
    clean = [(r["x"], math.log(max(r["n"], 1))) for r in best if r["y"] == 0]
    if clean:
        s = np.array([x for x, _ in clean])
        # Floor on the spread: clean texts may hold no positive word at all.
        model.lam = float(np.clip(math.pi / (max(s.std(), 0.3) * math.sqrt(6)), 0.2, 4.0))
        model.log_k = float(model.lam * s.mean() - np.mean([x for _, x in clean]) - 0.5772)
    rows = held(lambda found, n: float(evidence(found, n, model)[1]))
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
    model.bias, model.slope = _logistic(x, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Bias and slope by Newton steps; the ridge keeps separable data finite."""
    if not len(x):
        return 0.0, 1.0
    w = np.zeros(2)
    a = np.column_stack([np.ones_like(x), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (y - p) - ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def score(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """`docs` with tox_score, tox_segments (first and last word, score) and tox_p_value.

    Columns of these names in `docs` are replaced; all others pass untouched.
    """
    ship_package(docs.sparkSession)
    keep = without(docs, MADE)
    at = [c.lower() for c in keep].index(text.lower()) if text.lower() in [c.lower() for c in keep] else None
    sent = docs.select(*cols(keep))
    if at is None:
        raise ValueError(f"no column {text}")
    piece = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()),
                          T.StructField("score", T.DoubleType())])
    schema = T.StructType([*sent.schema.fields, T.StructField("tox_score", T.DoubleType()),
                           T.StructField("tox_segments", T.ArrayType(piece)),
                           T.StructField("tox_p_value", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
        for b in batches:
            scores, spans, ps = [], [], []
            for t in text_bytes(b.column(at)):
                if not model.known:
                    scores.append(model.bias)
                    spans.append([])
                    ps.append(1.0)
                    continue
                found, n = segments(t, model)
                neg, x = evidence(found, n, model)
                scores.append(1 / (1 + math.exp(-max(-60.0, min(60.0, model.bias + model.slope * x)))))
                limit = model.log_k + math.log(max(n, 1))
                spans.append([{"first": a, "last": z, "score": s} for a, z, s in found if limit < model.lam * s])
                ps.append(math.exp(-neg))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(scores, pa.float64()), pa.array(spans, kind), pa.array(ps, pa.float64())],
                names=[*b.schema.names, *MADE])

    return sent.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Fit on the rows outside the held-out fifth (id checksum modulo 5 is 0)."""
    return fit(docs, labels.where(split_of() != 0))


def drop_toxic(docs: DataFrame, model: ToxicModel, limit: float = 0.5) -> DataFrame:
    """The rows scored below `limit`, with the columns of `docs`."""
    return score(docs, model).where(F.col("tox_score") < limit).select(*cols(docs.columns))


@query("op4_toxicity")
def op4(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    model = train(docs, table(spark, d, "labels"))
    done = score(docs.select("doc_id", "text"), model)
    return done.select(
        "doc_id", (split_of() == 0).alias("held_out"), F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.5).cast("int").alias("predicted"),
        F.size("tox_segments").cast("long").alias("n_segments"), F.col("tox_p_value").alias("p_value"),
    )
