"""Near copies by the Jaccard similarity of their sets of word shingles, each link verified.

Texts with one set of shingles are one node. Candidates are the links of the nodes' SimHash
fingerprints (pigeonring chains before the Hamming check, see `simhash`), and, for what lies
further apart than its two bits, nodes in common MinHash buckets. A node has `BANDS` keys, each made of
`ROWS` MinHash values; nodes that share a key are a bucket. Two sets of similarity
0.8 share a bucket with probability 1 - (1 - 0.8 ** 5) ** 25 = 0.99995; a 64-bit
SimHash differs there in 10 bits on average and up to about 18, too many for keys
that tell unrelated texts apart.

First all nodes of a bucket are compared with one of it, which takes as many pairs as
rows: the one whose buckets hold the most nodes, since the text that copies were made
from shares more keys with them than they do with each other. Buckets whose nodes are then
still in different components are searched whole, in tasks of at most two pieces of `TASK`
nodes and `BYTES` of shingles. A task gets signatures and shingle sets, verifies there, and
gives only links that join two components, so at most one per node, however many pairs lie
below the limit. Every pair that links is verified on the shingle sets, so the classes
are those of all pairs that share a bucket.

Defined cases: null and empty texts have the empty set and are one node; a text
of fewer words than a shingle is one shingle; repeated rows fall into one class; a
null id takes part. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.llm import simhash
from crawlframe.llm.common import text_bytes, words
from crawlframe.llm.components import components
from crawlframe.session import cut_lineage, ship_package

SIZE, SIMILAR = 5, 0.8
BANDS, ROWS = 25, 5
#: Nodes and bytes of shingles of a piece of a bucket; a task takes two.
TASK, BYTES = 1024, 16 << 20
#: Bytes of bit rows up to which a task counts common shingles by bits, otherwise pair by pair.
BITS = 32 << 20
#: How far below the limit the share of equal MinHash values may be (over five standard deviations).
SLACK = 0.2
_RNG = np.random.default_rng(11)
MIX = _RNG.integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
MIX[1] |= np.uint64(1)


def shingles(text: bytes | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    import xxhash

    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(w)] if len(w) < size else map(b" ".join, zip(*(w[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(g, 42) for g in grams], np.uint64))


def signature(grams: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2048):
        least = np.minimum(least, ((grams[None, at:at + 2048] ^ MIX[0]) * MIX[1]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def _node(grams: np.ndarray) -> int:
    import xxhash

    return simhash._signed(xxhash.xxh3_64_intdigest(grams.tobytes())) if len(grams) else 0


def marks(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, _key, fingerprint, bands, simhash) of (doc_id, _key, text); the fingerprint stands for the shingle set."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for b in batches:
            node, bands, sim = [], [], []
            for t in text_bytes(b.column(2)):
                grams = shingles(t, size)
                node.append(_node(grams))
                sim.append(simhash._signed(simhash.fingerprint(t, size)))
                parts = signature(grams).reshape(BANDS, ROWS) if len(grams) else []
                bands.append([simhash._signed(xxhash.xxh3_64_intdigest(p.tobytes(), i)) for i, p in enumerate(parts)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sim, pa.int64())],
                names=["doc_id", "_key", "fingerprint", "bands", "simhash"])

    return docs.select("doc_id", "_key", "text").mapInArrow(
        run, f"doc_id {kind}, _key bigint, fingerprint bigint, bands array<bigint>, simhash bigint")


def shingle_sets(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(node, grams, sig) of the texts of `docs`, one row per node."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            grams = [shingles(t, size) for t in text_bytes(b.column(0))]
            grams = [g for g in grams if len(g)]
            yield pa.RecordBatch.from_arrays([
                pa.array([_node(g) for g in grams], pa.int64()), pa.array([g.tobytes() for g in grams], pa.binary()),
                pa.array([signature(g).tobytes() for g in grams], pa.binary())], names=["node", "grams", "sig"])

    return docs.select("text").mapInArrow(run, "node bigint, grams binary, sig binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of `similar` or more."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                same = 0
                if min(len(x), len(y)) >= similar * max(len(x), len(y)) - 1e-9:
                    same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(same >= similar * (len(x) + len(y) - same) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


class Overlap:
    """Numbers of common shingles of one set with others of a task."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(x) for x in sets])
        self.rows = None
        known, at = np.unique(np.concatenate(sets), return_inverse=True)
        width = -(-len(known) // 64)
        if len(sets) * width * 8 <= BITS:
            self.rows = np.zeros((len(sets), width), np.uint64)
            ends = np.cumsum(self.sizes)
            for k, end in enumerate(ends):  # one row at a time: a byte per bit for all would be eight times the rows
                bits = np.zeros(width * 64, dtype=bool)
                bits[at[end - self.sizes[k]:end]] = True
                self.rows[k] = np.packbits(bits).view(np.uint64)

    def common(self, one: int, others: np.ndarray) -> np.ndarray:
        if self.rows is not None:
            return np.bitwise_count(self.rows[others] & self.rows[one]).sum(axis=1, dtype=np.int64)
        x = self.sets[one]
        return np.array([len(np.intersect1d(x, self.sets[o], assume_unique=True)) for o in others], dtype=np.int64)


def forest(fp: np.ndarray, root: np.ndarray, piece: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray],
           similar: float = SIMILAR) -> tuple[list[int], list[int]]:
    """Verified links that join two components (`root`) of a task's nodes; between the pieces if there are two."""
    order = np.argsort(fp, kind="stable")
    fp, piece, sigs, sets = fp[order], piece[order], sigs[order], [sets[k] for k in order]
    of = np.unique(root[order], return_inverse=True)[1]
    across = piece.min() != piece.max()
    shared, least = Overlap(sets), BANDS * ROWS * (similar - SLACK)
    size = shared.sizes
    a, b = [], []
    for k in range(len(fp) - 1):
        to = np.arange(k + 1, len(fp))
        to = to[(of[to] != of[k]) & ((piece[to] != piece[k]) | (not across))]
        to = to[(np.minimum(size[to], size[k]) >= similar * np.maximum(size[to], size[k]) - 1e-9)]
        to = to[(sigs[to] == sigs[k]).sum(axis=1) >= least]
        if not len(to):
            continue
        same = shared.common(k, to)
        for t in to[same >= similar * (size[to] + size[k] - same) - 1e-9]:
            if of[t] != of[k]:
                of[of == of[t]] = of[k]
                a.append(int(fp[k]))
                b.append(int(fp[t]))
    return a, b


def _crossing(full: DataFrame, sets: DataFrame, roots: DataFrame, similar: float) -> DataFrame:
    """Verified links (a, b) between the components that are left in a bucket."""
    placed = full.where("n > 2").join(roots, F.col("fp") == F.col("node"), "left").select(
        "key", "fp", "centre", "n", F.coalesce("root", "fp").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    placed = cut_lineage(placed.join(mixed, "key", "left_semi").where("fp <> centre"))
    sized = placed.join(sets.select(F.col("node").alias("fp"), F.octet_length("grams").alias("bytes")), "fp")
    parts = sized.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TASK), F.ceil(F.sum("bytes") / BYTES)).cast("bigint").alias("parts"))
    pieces = placed.join(parts, "key").withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("parts")))
    # A piece meets every piece of its bucket, itself included.
    dealt = pieces.select("key", "fp", "root", "piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("key", "fp", "root", "piece", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"))
    # With several pieces, a piece meets itself only where it is asked for alone.
    rows = dealt.join(sets.select(F.col("node").alias("fp"), "grams", "sig"), "fp").select(
        "key", "i", "j", "fp", "root", "piece", "grams", "sig").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def told(group: list[tuple]) -> pa.RecordBatch:
            fp, root, piece = (np.array([g[k] for g in group], np.int64) for k in range(3))
            grams = [np.frombuffer(g[3], np.uint64) for g in group]
            a, b = forest(fp, root, piece, np.array([np.frombuffer(g[4], np.uint32) for g in group]), grams, similar)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        now, group = None, []
        for batch in batches:  # sorted, so a group's rows follow each other
            columns = [batch.column(k).to_pylist() for k in range(6)] + [batch.column(6), batch.column(7)]
            for at, (key, i, j, fp, root, piece) in enumerate(zip(*columns[:6])):
                if (key, i, j) != now:
                    if len(group) > 1:
                        yield told(group)
                    now, group = (key, i, j), []
                group.append((fp, root, piece, columns[6][at].as_py(), columns[7][at].as_py()))
        if len(group) > 1:
            yield told(group)

    return rows.mapInArrow(search, "a bigint, b bigint")


def ring_pairs(marked: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that SimHash links, not yet verified: at most two bits apart.

    Nodes of one SimHash are paired with the smallest of them, which stands for them in the
    links between different ones; so a line that rules many texts gives no more pairs than nodes.
    """
    of = cut_lineage(marked.where(F.size("bands") > 0).groupBy("fingerprint").agg(F.min("simhash").alias("sim")))
    first = cut_lineage(of.groupBy("sim").agg(F.min("fingerprint").alias("node")))
    same = of.join(first, "sim").where("fingerprint <> node").select(F.col("node").alias("a"), F.col("fingerprint").alias("b"))
    near = simhash.links(first.select("sim"), "sim")
    ends = [first.select(F.col("sim").alias(e), F.col("node").alias(f"{e}_node")) for e in ("a", "b")]
    near = near.join(ends[0], "a").join(ends[1], "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return cut_lineage(same.unionByName(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def links(docs: DataFrame, marked: DataFrame, size: int = SIZE, similar: float = SIMILAR) -> DataFrame:
    """Verified links (a, b) of nodes, from `docs` (doc_id, _key, text) and their `marks`."""
    nodes = marked.where(F.size("bands") > 0).groupBy("fingerprint").agg(F.first("bands").alias("bands"))
    keyed = nodes.select(F.col("fingerprint").alias("fp"), F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut_lineage(keyed.join(sizes, "key"))
    mass = met.groupBy("fp").agg(F.sum("n").alias("mass"))
    centres = met.join(mass, "fp").groupBy("key").agg(F.max(F.struct("mass", "fp")).alias("m")).select("key", F.col("m.fp").alias("centre"))
    full = cut_lineage(met.join(centres, "key"))
    ring = ring_pairs(marked)
    met = full.select("fp").union(ring.select("a")).union(ring.select("b")).distinct()
    # One row of each node in a bucket or pair gives the set.
    shown = marked.groupBy("fingerprint").agg(F.min(F.struct("doc_id", "_key")).alias("m")).join(
        met.withColumnRenamed("fp", "fingerprint"), "fingerprint", "left_semi")
    shown = shown.select(F.col("m.doc_id").alias("_i"), F.col("m._key").alias("_k"))
    sets = cut_lineage(shingle_sets(docs.join(
        shown, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left_semi"), size))
    star = full.where("fp <> centre").select(F.least("centre", "fp").alias("a"), F.greatest("centre", "fp").alias("b"))
    found = cut_lineage(verified(ring.unionByName(star).distinct(), sets, similar))
    return found.unionByName(cut_lineage(_crossing(full, sets, components(found), similar)))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE,
             similar: float = SIMILAR) -> DataFrame:
    """The row with the smallest id of every class of near copies, with the columns of `docs`."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), simhash.checksum(text).alias("_key"), F.col(text).alias("text"))
    marked = cut_lineage(marks(narrow, size))
    found = simhash.classes(marked.drop("bands", "simhash"), edges=links(narrow, marked, size, similar), root="_root")
    return simhash.keep_first(docs, found, doc_id, text)
