"""Sharding by a k-d tree over document metadata, with shards of near equal bytes.

A node is split along its widest dimension (language, source, size; scaled to
the whole table's range) at the weighted median: the key up to which the bytes
come nearest to the left part's share. The median is found by radix: the bytes
per leading digits of the key are summed where the rows are, and the digits are
refined in three passes for all nodes of a level at once. Only sums per digit
move, and only a node's digits so far reach the driver. A hash behind the scaled
value breaks ties, so one value that holds a third of all rows is split as well.

DataFrame functions only. Law: bytes. Defined cases: a null text has no bytes
(size 1), a null language or source counts as empty; rows that are the same in
all of id and text share a shard; fewer rows than shards leave shards empty; an
empty table gives no rows. Extra columns pass through whatever their names, those
named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlframe.llm.common import given, query, restored, table, without
from crawlframe.session import cut_lineage

SCALE, TIE = 1 << 20, 32
#: Bits of the key (scaled value, then tie) that each refining pass fixes.
PASSES = (18, 18, 17)
#: Rows of a shard that are numbered together.
PIECE = 50_000
DIMS = ("lang", "source", "size")
MADE = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def _number(text: Column) -> Column:
    """A name as a number: 28 bits of its md5."""
    return F.conv(F.substring(F.md5(F.coalesce(text.cast("string"), F.lit(""))), 1, 7), 16, 10).cast("bigint")


def _key(dim: str) -> Column:
    return F.shiftleft(F.col(f"__{dim}"), TIE).bitwiseOR(F.col("__tie"))


def _medians(rows: DataFrame, nodes: dict[int, tuple[str, int, int, int]]) -> dict[int, tuple[int, bool]]:
    """Per node (dimension, left shards, shards, bytes): the splitting key, and whether it goes left."""
    total = sum(PASSES)
    found = {n: (0, 0) for n in nodes}  # digits so far, bytes before them
    fixed = 0
    for bits in PASSES:
        fixed += bits
        prefix = F.lit(None).cast("bigint")
        digit = F.lit(None).cast("bigint")
        for n, (dim, *_rest) in nodes.items():
            head = F.shiftright(_key(dim), total - fixed)
            here = F.col("__node") == n
            prefix = F.when(here, F.shiftright(head, bits)).otherwise(prefix)
            digit = F.when(here, head).otherwise(digit)
        want = F.lit(None).cast("bigint")
        for n, (head, _) in found.items():
            want = F.when(F.col("__node") == n, F.lit(head)).otherwise(want)
        sums = rows.where(prefix == want).groupBy("__node", digit.alias("d")).agg(F.sum("size").alias("b"))
        upto = F.sum("b").over(W.partitionBy("__node").orderBy("d").rowsBetween(W.unboundedPreceding, W.currentRow))
        goal, before, shards = (F.lit(None).cast("bigint") for _ in range(3))
        for n, (_, left, parts, whole) in nodes.items():
            here = F.col("__node") == n
            goal = F.when(here, F.lit(whole * left)).otherwise(goal)
            before = F.when(here, F.lit(found[n][1])).otherwise(before)
            shards = F.when(here, F.lit(parts)).otherwise(shards)
        at = sums.select("__node", "d", "b", (upto + before).alias("upto")).where(shards * F.col("upto") >= goal)
        best = at.groupBy("__node").agg(F.min(F.struct("d", "upto", "b")).alias("m"))
        found = {r["__node"]: (r["m"]["d"], r["m"]["upto"] - r["m"]["b"], r["m"]["upto"]) for r in best.collect()}
        last = found
        found = {n: v[:2] for n, v in found.items()}
    out = {}
    for n, (head, before_, upto_) in last.items():
        _, left, parts, whole = nodes[n]
        out[n] = (head, parts * upto_ - whole * left <= whole * left - parts * before_)
    return out


def shard(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          source: str = "source") -> DataFrame:
    """`docs` without the text, with size, text_crc32, law, shard, slot and grown_shard (null)."""
    keep = without(docs, [text, *MADE])
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(given(docs, keep), F.col(doc_id).cast("string").alias("__id"),
                       (F.octet_length(body) + 1).cast("bigint").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"), _number(F.col(lang)).alias("__lang0"),
                       _number(F.col(source)).alias("__source0"))
    tie = F.md5(F.concat_ws(":", F.coalesce("__id", F.lit("")), F.col("text_crc32").cast("string")))
    rows = cut_lineage(rows.withColumn("__size0", F.col("size")).withColumn(
        "__tie", F.conv(F.substring(tie, 1, 8), 16, 10).cast("bigint")))
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), *[
        f(f"__{d}0").alias(f"{f.__name__}_{d}") for d in DIMS for f in (F.min, F.max)]).first()
    for d in DIMS:
        low, high = ends[f"min_{d}"] or 0, ends[f"max_{d}"] or 0
        scaled = F.expr(f"((__{d}0 - {low}L) * {SCALE}L) div {max(high - low, 1)}L")
        rows = rows.withColumn(f"__{d}", scaled)
    node = F.lit(0)
    leaves = {0: (0, shards)}  # node: its first shard, how many
    while any(k > 1 for _, k in leaves.values()) and ends["n"]:
        rows_ = rows.withColumn("__node", node)
        wide = rows_.groupBy("__node").agg(F.sum("size").alias("bytes"), *[
            (F.max(f"__{d}") - F.min(f"__{d}")).alias(d) for d in DIMS]).collect()
        todo = {}
        for r in wide:
            first, k = leaves[r["__node"]]
            if k > 1:
                dim = max(DIMS, key=lambda d: (r[d], -DIMS.index(d)))
                todo[r["__node"]] = (dim, k // 2, k, r["bytes"])
        cuts = _medians(rows_, todo)
        grown = {}
        for n, (first, k) in leaves.items():
            if n not in cuts:  # a single shard, or a node without rows
                grown[n] = (first, 1)
                continue
            key, with_left = cuts[n]
            own = _key(todo[n][0])
            left = own <= key if with_left else own < key
            at = F.col("__node") == n
            grown[2 * n + 1], grown[2 * n + 2] = (first, k // 2), (first + k // 2, k - k // 2)
            rows_ = rows_.withColumn("__next", F.when(at, F.when(left, 2 * n + 1).otherwise(2 * n + 2)).otherwise(
                F.col("__next") if "__next" in rows_.columns else F.col("__node")))
        rows = rows_.withColumn("__node", F.col("__next")).drop("__next")
        node, leaves = F.col("__node"), grown
    where = F.lit(0)
    for n, (first, _) in leaves.items():
        where = F.when(F.col("__node") == n, first).otherwise(where) if "__node" in rows.columns else where
    rows = rows.withColumn("shard", where.cast("int"))
    # Slots: rows are numbered within hash pieces of bounded size; the pieces' counts give the offsets.
    bits = 0
    while bits < 24 and ends["n"] > PIECE << bits:
        bits += 1
    rows = cut_lineage(rows.withColumn("__piece", F.shiftright("__tie", TIE - bits)))
    counts = rows.groupBy("shard", "__piece").agg(F.count(F.lit(1)).alias("c"))
    along = W.partitionBy("shard").orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "__piece", F.coalesce(F.sum("c").over(along), F.lit(0)).alias("__before"))
    inside = W.partitionBy("shard", "__piece").orderBy("__tie", "__id", "text_crc32")
    done = rows.withColumn("__at", F.row_number().over(inside) - 1).join(offsets, ["shard", "__piece"])
    return done.select(*restored(keep), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                       (F.col("__before") + F.col("__at")).cast("bigint").alias("slot"),
                       F.lit(None).cast("int").alias("grown_shard"))


def _sql(depth: int = 3) -> str:
    scaled = ", ".join(f"(({d}0 - (SELECT min({d}0) FROM a)) * {SCALE}) // greatest((SELECT max({d}0) - min({d}0) FROM a), 1) AS {d}1"
                       for d in DIMS)
    levels, prev = "", "n0"
    for i in range(depth):
        spread = [f"max({d}1) - min({d}1)" for d in DIMS]
        pick = (f"CASE WHEN {spread[0]} >= greatest({spread[1]}, {spread[2]}) THEN 0 "
                f"WHEN {spread[1]} >= {spread[2]} THEN 1 ELSE 2 END")
        levels += f""",
w{i} AS (SELECT node, sum(size) AS whole, {pick} AS dim FROM {prev} GROUP BY node),
k{i} AS (SELECT p.*, whole, (CASE dim WHEN 0 THEN lang1 WHEN 1 THEN source1 ELSE size1 END) * {1 << TIE} + tie AS key
         FROM {prev} p JOIN w{i} USING (node)),
c{i} AS (SELECT node, key, whole, b, sum(b) OVER (PARTITION BY node ORDER BY key) AS upto
         FROM (SELECT node, key, whole, sum(size) AS b FROM k{i} GROUP BY node, key, whole)),
m{i} AS (SELECT node, min(key) AS cut, arg_min(2 * upto - whole <= whole - 2 * (upto - b), key) AS with_left
         FROM c{i} WHERE 2 * upto >= whole GROUP BY node),
n{i + 1} AS (SELECT k.* EXCLUDE (node, whole, key), 2 * node + CASE WHEN key < cut OR (key = cut AND with_left) THEN 0 ELSE 1 END AS node
         FROM k{i} k JOIN m{i} USING (node))"""
        prev = f"n{i + 1}"
    return f"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
bytes AS (SELECT doc_id, lang, source, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
    lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
a AS (SELECT doc_id, len(b) + 1 AS size, len(b) + 1 AS size0,
    xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS crc,
    CAST('0x' || substr(md5(coalesce(lang, '')), 1, 7) AS BIGINT) AS lang0,
    CAST('0x' || substr(md5(coalesce(source, '')), 1, 7) AS BIGINT) AS source0 FROM bytes, tab),
n0 AS (SELECT doc_id, size, crc, 0 AS node, {scaled},
    CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || crc), 1, 8) AS BIGINT) AS tie FROM a){levels}
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(node AS INT) AS shard,
  CAST(row_number() OVER (PARTITION BY node ORDER BY tie, doc_id::VARCHAR, crc) - 1 AS BIGINT) AS slot,
  CAST(NULL AS INT) AS grown_shard FROM {prev}"""


@query("op10_kd_shards", sql=_sql())
def op10(spark, d) -> DataFrame:
    return shard(table(spark, d, "documents").select("doc_id", "text", "lang", "source")).select("doc_id", *MADE)
