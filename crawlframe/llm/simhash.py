"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint has 64 bits in a ring of six segments. If two differ in at most
two bits, some segment starts a chain around the ring whose first l segments
differ in at most l * 2 / 6 bits in sum, for every l: none over two segments,
one over five. So candidates agree in two neighbouring segments (an equality
join on 20 to 22 bits), and the budget of the longer chain prunes them before
the full Hamming check.

Copies share one fingerprint and are one node. Buckets of few fingerprints are
joined with themselves. Larger ones are searched in a task, which returns a
spanning forest instead of all pairs; those beyond `TASK` fingerprints are first
cut by the five-segment chain with one bit masked, which leaves at most 4,096
fingerprints each and loses no pair within the chain's budget of one.

Defined cases: null and empty texts have fingerprint zero and link like others;
repeated rows fall into one class; a null id takes part, and a class of null ids
only has a null id. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.functions.text import spare
from crawlframe.llm.common import cols, query, table, text_bytes, without, words
from crawlframe.llm.components import components
from crawlframe.session import cut_lineage, ship_package

WIDTHS = (11, 11, 11, 11, 10, 10)
DISTANCE = 2
#: Bucket sizes up to which pairs are joined, and up to which one task searches.
JOIN, TASK = 32, 4096


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chain(start: int, length: int) -> int:
    """Bit mask of `length` segments of the ring from `start`."""
    at, mask = np.concatenate([[0], np.cumsum(WIDTHS)]), 0
    for k in range(length):
        i = (start + k) % len(WIDTHS)
        mask |= ((1 << WIDTHS[i]) - 1) << int(at[i])
    return mask


#: Per start: masks of the chains whose budgets are 0, 1 and 1 bits.
MASKS = [[_chain(s, n) for n in (2, 3, 5)] for s in range(len(WIDTHS))]


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """64-bit SimHash over word shingles, repeats included; zero without words."""
    import xxhash

    w = words(text)
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < size else map(b" ".join, zip(*(w[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, 42) for g in grams], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, out: str = "fingerprint") -> DataFrame:
    """`docs` without the text, with the fingerprint as a signed bigint."""
    ship_package(docs.sparkSession)
    keep = without(docs, [text, out])
    sent = docs.select(*cols(keep), *[c.alias(f"{spare(docs)}text") for c in cols([text])])
    schema = T.StructType([*sent.schema.fields[:-1], T.StructField(out, T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            made = np.array([fingerprint(t, size) for t in text_bytes(b.column(len(keep)))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(made.view(np.int64))], names=[*b.schema.names[:-1], out])

    return sent.mapInArrow(run, schema)


def forest(fps: np.ndarray, start: int) -> tuple[list[int], list[int]]:
    """Spanning forest of the links within one bucket: chain budgets first, then the full check."""
    m3, m5 = (np.uint64(m) for m in MASKS[start][1:])
    left = np.unique(fps)
    a: list[int] = []
    b: list[int] = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            apart = left ^ x
            near = np.flatnonzero(np.bitwise_count(apart & m3) <= 1)
            near = near[np.bitwise_count(apart[near] & m5) <= 1]
            near = near[np.bitwise_count(apart[near]) <= DISTANCE]
            if len(near):
                found = left[near]
                a += [int(x)] * len(found)
                b += found.tolist()
                queue += list(found)
                left = np.delete(left, near)
    return a, b


def links(fps: DataFrame, column: str = "fingerprint") -> DataFrame:
    """Links (a, b) that connect exactly what the pairs within `DISTANCE` bits connect.

    `fps` holds distinct fingerprints. Every pair in a small bucket is returned;
    a large bucket gives a spanning forest of its pairs.
    """
    ship_package(fps.sparkSession)
    one = fps.where(F.col(column).isNotNull()).select(F.col(column).alias("fp"))
    keyed = one.select("fp", F.explode(F.array(*[
        F.struct(F.lit(s).alias("start"), F.col("fp").bitwiseAND(F.lit(_signed(m[0]))).alias("key"))
        for s, m in enumerate(MASKS)])).alias("k")).select("fp", "k.start", "k.key")
    sizes = keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    full = cut_lineage(keyed.join(sizes, ["start", "key"]))

    small = full.where(F.col("n") <= JOIN)
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))

    def budget(part: int, most: int):
        mask = F.element_at(F.array(*[F.lit(_signed(m[part])) for m in MASKS]), F.col("l.start") + 1)
        return F.bit_count(x.bitwiseAND(mask)) <= most

    pairs = small.alias("l").join(small.alias("r"), (F.col("l.start") == F.col("r.start"))
                                  & (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp"))
                                  & budget(1, 1) & budget(2, 1) & (F.bit_count(x) <= DISTANCE))
    pairs = pairs.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))

    mid = full.where((F.col("n") > JOIN) & (F.col("n") <= TASK)).select(
        "fp", "start", "key", F.lit(-1).alias("bit"))
    # Beyond TASK: the key grows to five segments, with one bit of the last three masked at a time.
    finer = [
        F.struct(F.lit(s).alias("start"), F.lit(bit).alias("bit"),
                 F.col("fp").bitwiseAND(F.lit(_signed(m[2] & ~(1 << bit)))).alias("key"))
        for s, m in enumerate(MASKS) for bit in range(64) if (m[2] & ~m[0]) >> bit & 1]
    cut = full.where(F.col("n") > TASK).select("fp", "start").select("fp", F.explode(
        F.filter(F.array(*finer), lambda k: k["start"] == F.col("start"))).alias("k")).select(
        "fp", "k.start", "k.key", "k.bit")

    def search(pdf):
        import pandas as pd

        a, b = forest(pdf["fp"].to_numpy(np.int64).view(np.uint64), int(pdf["start"].iloc[0]))
        as_long = lambda v: np.array(v, np.uint64).view(np.int64)
        return pd.DataFrame({"a": as_long(a), "b": as_long(b)})

    hot = mid.unionByName(cut).groupBy("start", "key", "bit").applyInPandas(search, "a bigint, b bigint")
    return pairs.unionByName(hot).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(marked: DataFrame, doc_id: str = "doc_id", fp: str = "fingerprint", edges: DataFrame | None = None,
            root: str | None = None) -> DataFrame:
    """`marked` with component_id: the smallest id that links lead to, its own included.

    Links are `edges` (a, b) of fingerprints, by default those of `links`. The
    smallest fingerprint of the class is kept under the name `root`, if there is one.
    """
    own = f"{spare(marked)}fp"
    nodes = cut_lineage(marked.groupBy(F.col(fp).alias("_fp")).agg(F.min(doc_id).alias("_least")))
    roots = components(links(nodes.select("_fp"), "_fp") if edges is None else edges)
    joined = nodes.join(roots, nodes["_fp"] == roots["node"], "left").select(
        "_fp", "_least", F.coalesce("root", "_fp").alias("_root"))
    least = joined.groupBy("_root").agg(F.min("_least").alias("component_id"))
    extra = [F.col("_root").alias(root)] if root else []
    of = joined.join(least, "_root").select(F.col("_fp").alias(own), "component_id", *extra)
    keep = without(marked, ["component_id"])
    return marked.select(*cols(keep)).join(of, F.col(fp).eqNullSafe(F.col(own))).drop(own)


def checksum(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the smallest id of every class, with the columns of `docs`."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), checksum(text).alias("_key"), F.col(text).alias("text"))
    found = classes(cut_lineage(fingerprints(narrow)), root="_root")
    return keep_first(docs, found, doc_id, text)


def keep_first(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the smallest id of every class in `found` (doc_id, _key, component_id, _root).

    Losers are found on narrow rows (id, text checksum) and taken out with an
    anti join; only rows that are repeated as they are get regrouped.
    """
    key, p = checksum(text), spare(docs)
    rows = found.groupBy("doc_id", "_key", "component_id", "_root").agg(F.count(F.lit(1)).alias("n"))
    rows = cut_lineage(rows.select("doc_id", "_key", "component_id", "n", "_root"))
    # Of a class, the row of the smallest id stays; of equal ids, the one with the smallest checksum.
    best = rows.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("_root")).alias("_f")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "_key")).alias("m"))
    i, k = f"{p}i", f"{p}k"
    stays = best.select(F.col("m.doc_id").alias(i), F.col("m._key").alias(k))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col("_key") == F.col(k))
    lost = rows.join(stays, same, "left_anti").select(F.col("doc_id").alias(i), F.col("_key").alias(k))
    twice = rows.where("n > 1").join(stays, same, "left_semi").select(
        F.col("doc_id").alias(i), F.col("_key").alias(k))
    at = cols([doc_id])[0].eqNullSafe(F.col(i)) & (key == F.col(k))
    once = docs.join(lost.union(twice), at, "left_anti")
    again = docs.join(twice, at, "left_semi").withColumn(k, key).dropDuplicates([doc_id, k]).drop(k)
    return once.unionByName(again).select(*cols(docs.columns))


@query("op5_simhash")
def op5(spark, d) -> DataFrame:
    marked = cut_lineage(fingerprints(table(spark, d, "documents").select("doc_id", "text")))
    return classes(marked).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
