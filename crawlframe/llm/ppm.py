"""Language-model scores by prediction by partial matching over bytes.

The model is a byte-context trie of order `ORDER`, pretrained on all training
documents. A text is the symbols of its UTF-8 bytes, A-Z lower-cased, and one
end mark. A symbol is predicted in its longest context; where that context has
not seen it, an escape (method D: half a count per symbol seen) leads to the
next shorter one, in which the symbols of the longer context are excluded. In
shorter contexts a symbol counts once per longer context it was seen in (update
exclusion). Below order zero the symbols never seen are equally likely. The
probabilities of all symbols in a context sum to one.

The trie is a table of (context, symbol) counts and is never in one place.
Runs of rows of an input partition are blocks; a block lists its distinct
grams, and counts are summed over blocks. Both passes over the texts must see
the same partitions, as reads of a stored table do; if not, the job fails. All contexts that end in the same two
bytes form a group, which holds everything needed above order one; orders one
and zero have at most 65,536 counts and are sent along. Groups are dealt to
buckets: a block sends one row to each bucket, its grams there and their counts
packed, and the row goes back with the log probabilities packed. Words and their
counts go the same way.

Defined cases: a null text is the empty text, of one symbol and one token;
repeated rows are scored alike; without training rows all symbols are equally
likely; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.llm.common import LOWER, query, split_of, table, text_bytes
from crawlframe.session import scratch, ship_package

ORDER = 5
#: Neither byte occurs in UTF-8: the context before a text, and its end.
START, END = b"\xfe", b"\xff"
ALPHABET = 256
#: Bytes of text in a block, and of a chunk that is sorted at once.
BLOCK, CHUNK = 24 << 20, 2 << 20
#: Buckets of groups and of words: one for so many bytes of text, up to a number that keeps a block's rows long.
BUCKET, BUCKETS = 8 << 20, 1024


def chunks(texts: list[bytes | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(text numbers, part numbers, grams): parts of texts, at most 60,000 and about CHUNK bytes at a time.

    A gram is a context and its symbol as one number, six bytes wide. Long
    texts are cut; a part starts with the context that its first symbol needs.
    """
    owner: list[int] = []
    pieces: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        body = (text or b"").translate(LOWER) + END
        for at in range(0, len(body), CHUNK):
            context = (START * ORDER + body[:at])[-ORDER:] if at < ORDER else body[at - ORDER:at]
            owner.append(i)
            pieces.append(context + body[at:at + CHUNK])
            size += len(pieces[-1])
            if size >= CHUNK or len(owner) >= 60_000:
                yield owner, *_grams(pieces)
                owner, pieces, size = [], [], 0
    if owner:
        yield owner, *_grams(pieces)


def _grams(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint64)
    two = x[:-1] << np.uint64(8) | x[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    six = four[:-2] << np.uint64(16) | two[4:]
    sizes = np.array([len(p) for p in pieces])
    part = np.repeat(np.arange(len(pieces)), sizes)[ORDER:]
    first = np.cumsum(sizes) - sizes
    at = np.arange(len(part)) + ORDER
    inside = at - first[part] >= ORDER
    return part[inside], six[inside]


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of all lists in order, and the sum of each one's counts."""
    g, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(g, kind="stable")
    g, n = g[order], n[order]
    at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    return g[at], (np.add.reduceat(n, at) if len(at) else n)


def pack(values: np.ndarray) -> bytes:
    """Numbers of eight bytes, compressed byte by byte: all lowest ones first."""
    return zlib.compress(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def turned(grams: np.ndarray) -> np.ndarray:
    """Grams with their group, the two bytes before the symbol, moved to the front."""
    g = grams
    return (g >> np.uint64(8) & np.uint64(0xFFFF)) << np.uint64(32) | (g >> np.uint64(24)) << np.uint64(8) | g & np.uint64(255)


def turned_back(keys: np.ndarray) -> np.ndarray:
    k = keys
    return (k >> np.uint64(8) & np.uint64(0xFFFFFF)) << np.uint64(24) | (k >> np.uint64(32)) << np.uint64(8) | k & np.uint64(255)


def dealt(grams: np.ndarray, counts: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, steps from one turned gram to the next, counts) of a block, packed."""
    keys = turned(grams)
    bucket = ((keys >> np.uint64(32)) * np.uint64(0x9E3779B1) >> np.uint64(16) & np.uint64(0xFFFF)) % np.uint64(buckets)
    order = np.argsort(bucket << np.uint64(48) | keys)
    keys, bucket, counts = keys[order], bucket[order], counts[order]
    ends = [*(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
    for a, z in zip([0, *ends], ends):
        yield int(bucket[a]), pack(np.diff(keys[a:z], prepend=np.uint64(0))), pack(counts[a:z].astype(np.uint64))


def steps(packed: bytes) -> np.ndarray:
    """The turned grams of a row that `dealt` made."""
    return np.cumsum(unpack(packed), dtype=np.uint64)


def dealt_words(words: dict[bytes, int], buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, words, counts) of a block, packed."""
    lists: dict[int, list[bytes]] = {}
    for w in sorted(words):
        lists.setdefault(zlib.crc32(w) % buckets, []).append(w)
    for bucket, ws in lists.items():
        yield bucket, zlib.compress(b"\n".join(ws), 1), pack(np.fromiter((words[w] for w in ws), np.uint64, len(ws)))


def word_counts(words: bytes, counts: bytes) -> Iterator[tuple[bytes, int]]:
    """The words of a row that `dealt_words` made, with counts in their order."""
    return zip(zlib.decompress(words).split(b"\n"), unpack(counts).tolist())


def sum_words(rows: list[tuple[bytes, bytes]]) -> tuple[list[bytes], int, int]:
    """Of the rows (words, counts) of all blocks in a bucket: per row the counts of all blocks; tokens and distinct words counted."""
    total: dict[bytes, int] = {}
    for row in rows:
        for w, n in word_counts(*row):
            total[w] = total.get(w, 0) + n
    out = []
    for words, _ in rows:
        ws = zlib.decompress(words).split(b"\n")
        out.append(pack(np.fromiter((total[w] for w in ws), np.uint64, len(ws))))
    return out, sum(total.values()), sum(n > 0 for n in total.values())


def count_block(texts: list[bytes | None], train: list[bool]) -> tuple[np.ndarray, np.ndarray, Counter]:
    """Distinct grams of a block with their training counts, and the same for its words."""
    grams, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    learned = np.array(train, bool)
    pending: list[np.ndarray] = []
    weights: list[np.ndarray] = []

    for owner, part, g in chunks(texts):
        key = np.sort(g << np.uint64(1) | learned[np.array(owner)][part].astype(np.uint64))
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        runs = np.diff(np.r_[at, len(key)])
        key = key[at]
        pending.append(key >> np.uint64(1))
        weights.append(runs * (key & np.uint64(1)).astype(np.int64))
        if len(pending) >= 4:
            grams, counts = merged([grams, *pending], [counts, *weights])
            pending, weights = [], []
    grams, counts = merged([grams, *pending], [counts, *weights])
    words: Counter = Counter()
    for text, learn in zip(texts, train):
        w = (text or b"").translate(LOWER).split()
        if learn:
            words.update(w)
        else:
            for x in w:
                words.setdefault(x, 0)
    return grams, counts, words


class Level:
    """Counts of one order within a group: sorted (context, symbol) keys and their contexts' sums."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        ctx = keys >> np.uint64(8)
        self.at = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]]) if len(keys) else np.zeros(0, int)
        self.ctx = ctx[self.at]
        self.total = np.add.reduceat(counts, self.at) if len(keys) else counts
        self.kinds = np.diff(np.r_[self.at, len(keys)])

    def shorter(self, bits: int) -> Level:
        """The next lower order, where a symbol counts once per longer context."""
        keys, n = np.unique(self.keys & np.uint64((1 << bits) - 1), return_counts=True)
        return Level(keys, n.astype(np.int64))

    def excluded(self, lower: np.ndarray) -> np.ndarray:
        """Per context, the sum of the lower order's counts over the symbols seen here."""
        return np.add.reduceat(lower, self.at) if len(self.keys) else lower

    def find(self, values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(among, values), max(len(among) - 1, 0))
        return at, (among[at] == values if len(among) else np.zeros(len(values), bool))


def log_probabilities(grams: np.ndarray, counts: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log10 P(symbol | context) of all grams of one group (contexts ending in the same two bytes).

    `grams` is sorted, `counts` are training counts, zero for grams to be
    scored only; `one` holds the counts of order one by (last byte, symbol).
    """
    seen = counts > 0
    levels = [Level(grams[seen], counts[seen])]
    for order in range(ORDER - 1, 1, -1):
        levels.append(levels[-1].shorter(8 * (order + 1)))
    zero = (one > 0).sum(axis=0)
    last = int(grams[0] >> np.uint64(8)) & 255
    out = np.zeros(len(grams))
    todo = np.arange(len(grams))
    less_total, less_kinds = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)

    def settle(count, total, kinds, there):
        """Score those whose symbol is seen, add the escape of the others; return who is left."""
        nonlocal todo, less_total, less_kinds
        hit = there & (count > 0)
        out[todo[hit]] += np.log10((count[hit] - 0.5) / total[hit])
        escape = there & ~hit & (total > 0)
        out[todo[escape]] += np.log10(0.5 * kinds[escape] / total[escape])
        todo, less_total, less_kinds = todo[~hit], less_total[~hit], less_kinds[~hit]
        return ~hit

    for i, level in enumerate(levels):
        order = ORDER - i
        key = grams[todo] & np.uint64((1 << 8 * (order + 1)) - 1)
        c, there = level.find(key >> np.uint64(8), level.ctx)
        k, known = level.find(key, level.keys)
        n = len(todo)
        pick = lambda a, at, ok: np.where(ok, a[at], 0) if len(a) else np.zeros(n, np.int64)  # noqa: B023,E731
        total = pick(level.total, c, there) - less_total
        kinds = pick(level.kinds, c, there) - less_kinds
        # What the next order must leave out: the symbols that this context has seen.
        if i + 1 < len(levels):
            below = levels[i + 1]
            lower = below.counts[below.find(level.keys & np.uint64((1 << 8 * order) - 1), below.keys)[0]] if len(
                level.keys) else level.counts
        else:
            lower = one[last][(level.keys & np.uint64(255)).astype(int)]
        gone = level.excluded(lower)
        left = settle(pick(level.counts, k, known), total, kinds, there)
        less_total = np.where(there, pick(gone, c, there), 0)[left]
        less_kinds = np.where(there, pick(level.kinds, c, there), 0)[left]
        if not len(todo):
            return out
    symbol = (grams[todo] & np.uint64(255)).astype(int)
    present = np.full(len(todo), one[last].sum() > 0)
    left = settle(one[last][symbol], one[last].sum() - less_total, (one[last] > 0).sum() - less_kinds, present)
    symbol = symbol[left]
    if one[last].sum() > 0:
        less_total = np.full(len(todo), zero[one[last] > 0].sum())
        less_kinds = np.full(len(todo), (one[last] > 0).sum())
    present = np.full(len(todo), zero.sum() > 0)
    settle(zero[symbol], zero.sum() - less_total, (zero > 0).sum() - less_kinds, present)
    out[todo] -= math.log10(ALPHABET - int((zero > 0).sum())) if len(todo) else 0.0
    return out


def score_bucket(rows: list[tuple[bytes, bytes]], one: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
    """Of the rows (grams, counts) of all blocks in a bucket: per row which log probability each gram has, and these."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pending: list[np.ndarray] = []
    weights: list[np.ndarray] = []
    size = 0
    for packed, n in rows:
        pending.append(steps(packed))
        weights.append(unpack(n).astype(np.int64))
        size += len(pending[-1])
        if size > max(CHUNK, len(keys)):
            keys, counts = merged([keys, *pending], [counts, *weights])
            pending, weights, size = [], [], 0
    keys, counts = merged([keys, *pending], [counts, *weights])
    group = keys >> np.uint64(32)
    ends = [*(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
    logs = np.zeros(len(keys))
    for a, z in zip([0, *ends], ends):
        logs[a:z] = log_probabilities(turned_back(keys[a:z]), counts[a:z], one)
    for packed, _ in rows:
        values, which = np.unique(logs[np.searchsorted(keys, steps(packed))], return_inverse=True)
        yield pack(which.astype(np.uint64)), values.tobytes()


def score_block(texts: list, grams: np.ndarray, logs: np.ndarray, words: dict, end: int, total: int, kinds: int) -> tuple:
    """Per text: tokens, known tokens, base score, model score."""
    score = np.zeros(len(texts))
    for owner, part, g in chunks(texts):
        key = np.sort(g << np.uint64(16) | part.astype(np.uint64))
        value = key >> np.uint64(16)
        at = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        place = np.minimum(np.searchsorted(grams, value[at]), len(grams) - 1)
        if not np.array_equal(grams[place], value[at]):
            raise ValueError("rows changed their partitions between two reads; write the table and read it from there")
        logp = logs[place]
        sums = np.bincount((key & np.uint64(0xFFFF)).astype(np.int64), np.repeat(logp, np.diff(np.r_[at, len(key)])),
                           len(owner))
        np.add.at(score, np.array(owner), sums)
    tokens, known, base = [], [], []
    log_all = math.log10(total + 0.5 * (kinds + 1))
    for text in texts:
        w = (text or b"").translate(LOWER).split()
        c = np.fromiter((words[x] for x in w), np.int64, len(w))
        tokens.append(len(w) + 1)
        known.append(int((c > 0).sum()) + int(end > 0))
        base.append(float(np.log10(c + 0.5).sum() + math.log10(end + 0.5) - (len(w) + 1) * log_all))
    return tokens, known, base, score


def score(docs: DataFrame, train, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all rows.

    `train` is the condition that a row is learnt from. The counts are written
    to the shared folder once; texts are counted where they are read and
    shuffled once, to meet their block's log probabilities.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    ship_package(spark)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 6
    whole, rows, learnt = slim.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1)), F.count_if("train")).first()
    # A block is a run of rows of one input partition: the row's number without its last bits.
    bits = math.ceil(math.log2(max(1, BLOCK * rows // max(whole, 1))))
    buckets = min(BUCKETS, max(1, whole // BUCKET))
    slim = slim.withColumn("block", F.shiftright(F.monotonically_increasing_id(), bits))

    def count(batches: Iterator) -> Iterator:
        block, texts, learn = None, [], []

        def told():
            grams, counts, words = count_block(texts, learn)
            pairs = np.unique(grams[counts > 0] & np.uint64(0xFFFFFF))
            sent = [*((0, *x) for x in dealt(grams, counts, buckets)), *((1, *x) for x in dealt_words(words, buckets))]
            m, k = len(sent), len(pairs)
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in sent] + [2] * k, pa.int32()), pa.array(np.full(m + k, block), pa.int64()),
                *(pa.concat_arrays([pa.array([x[i] for x in sent], kind), pa.nulls(k, kind)])
                  for i, kind in ((1, pa.int32()), (2, pa.binary()), (3, pa.binary()))),
                pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(pairs.astype(np.int64))])],
                ["kind", "block", "bucket", "packed", "counts", "pair"])

        for b in batches:
            for text_, train_, at in zip(text_bytes(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if at != block and texts:
                    yield from told()
                    texts, learn = [], []
                block = at
                texts.append(text_)
                learn.append(train_)
        if texts:
            yield from told()

    path = scratch(spark, "ppm-counts")
    slim.select("text", "train", "block").mapInArrow(
        count, "kind int, block bigint, bucket int, packed binary, counts binary, pair bigint").write.partitionBy("kind").parquet(path)
    told_ = spark.read.schema("block bigint, bucket int, packed binary, counts binary, pair bigint, kind int").parquet(path)

    pairs = told_.where("kind = 2").select("pair").distinct().groupBy(
        F.col("pair").bitwiseAND(0xFFFF).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 65,536 rows
    one = np.zeros((256, 256), np.int64)
    for r in pairs:
        one[r["p"] >> 8, r["p"] & 255] = r["n"]

    def model(t):
        made = list(score_bucket(list(zip(t["packed"].to_pylist(), t["counts"].to_pylist())), one))
        return pa.table({"block": t["block"], "packed": t["packed"], "which": pa.array([x[0] for x in made], pa.binary()),
                         "logs": pa.array([x[1] for x in made], pa.binary())})

    def add(t):
        made, tokens, kinds = sum_words(list(zip(t["packed"].to_pylist(), t["counts"].to_pylist())))
        rest = [0] * (len(made) - 1)
        return pa.table({"block": t["block"], "packed": t["packed"], "counts": pa.array(made, pa.binary()),
                         "tokens": pa.array([tokens, *rest], pa.int64()), "kinds": pa.array([kinds, *rest], pa.int64())})

    logs = told_.where("kind = 0").select("block", "bucket", "packed", "counts").groupBy("bucket").applyInArrow(
        model, "block bigint, packed binary, which binary, logs binary")
    path = scratch(spark, "ppm-words")
    kept = "block bigint, packed binary, counts binary, tokens bigint, kinds bigint"
    told_.where("kind = 1").select("block", "bucket", "packed", "counts").groupBy("bucket").applyInArrow(add, kept).write.parquet(path)
    words = spark.read.schema(kept).parquet(path)
    total, kinds = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    total, kinds = total + learnt, kinds + int(learnt > 0)
    none = F.lit(None).cast("binary")
    asked = logs.select("*", none.alias("counts")).unionByName(
        words.select("block", "packed", none.alias("which"), none.alias("logs"), "counts"))

    def finish(key, left, right):
        texts = text_bytes(left["text"].combine_chunks())
        sent = right.filter(right["logs"].is_valid())
        g = np.concatenate([np.zeros(0, np.uint64), *(turned_back(steps(x)) for x in sent["packed"].to_pylist())])
        v = np.concatenate([np.zeros(0), *(np.frombuffer(x)[unpack(w).astype(np.int64)] for w, x in zip(
            sent["which"].to_pylist(), sent["logs"].to_pylist()))])
        order = np.argsort(g)
        told = right.filter(right["counts"].is_valid())
        known = {w: n for row in zip(told["packed"].to_pylist(), told["counts"].to_pylist()) for w, n in word_counts(*row)}
        tokens, found, base, scores = score_block(texts, g[order], v[order], known, learnt, total, kinds)
        return pa.table({
            "doc_id": left["doc_id"], "held_out": pa.array([not x for x in left["train"].to_pylist()]),
            "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(found, pa.int64()),
            "train_tokens": pa.array(np.full(len(texts), total), pa.int64()),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(scores, pa.float64())})

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(
        finish, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                "base_score double, score double")


@query("op2_ppm")
def op2(spark, d) -> DataFrame:
    return score(table(spark, d, "documents"), split_of() != 1)
