"""Quality rules: base counts per text, and frequent lines per host.

Lines are normalised (A-Z lower-cased, blanks joined) and hashed. Per host, the
distinct documents that hold a line are counted; equal whole texts are one
document there, so mere copies do not turn their lines into boilerplate, unless
`every_row` counts each row. A line
in more than `SHARE` of a host's documents, and in more than `LEAST` of them, is
removed. A text of which too few words are left is depleted and rejected.

Defined cases: a null or empty text has no words and fails the base rules; a
null host is the empty host; repeated rows are judged each; a line counts once
per document. Extra columns pass through, those named like a result go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.functions.text import spare
from crawlframe.llm.common import LOWER, WORD, cols, query, table, text_bytes, without
from crawlframe.session import broadcast_if_small, cut_lineage, ship_package

SHARE, LEAST = 0.02, 20
#: A text is depleted if less than this share of its words, or fewer than so many words, are left.
LEFT, LEFT_WORDS = 0.3, 20
SYMBOLS = b"#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MADE = [*STATS, "n_removed_words", "base_failed", "depleted", "kept"]


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words in windows of `size` words that the text holds twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    key = ids[:n]
    for k in range(1, size):
        # Number the pairs again after each word, so that no product of counts can overflow.
        key = np.unique(key * len(seen) + ids[k:n + k], return_inverse=True)[1]
    twice = np.bincount(key)[key] > 1
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k:n + k] |= twice
    return int(covered.sum())


def text_stats(text: bytes | None) -> tuple[list[int], dict[int, int]]:
    """The five base counts, and the words of each distinct normalised line by its hash."""
    import xxhash

    text = text or b""
    lines: dict[int, int] = {}
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        w = line.split()
        if not w:
            continue
        dup += line in seen
        seen.add(line)
        h = xxhash.xxh3_64_intdigest(b" ".join(w).translate(LOWER))
        lines[h] = lines.get(h, 0) + len(w)
    words = text.split()
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = sum(text.count(SYMBOLS[i:i + 1]) for i in range(len(SYMBOLS)))
    return [len(words), chars, symbols, dup, repeated_words(words)], lines


def line_stats(docs: DataFrame, text: str = "text", host: str = "source", prefix: str = "__") -> DataFrame:
    """`docs` without the text: base counts and, under `prefix`, host, text (hash) and lines of (h, w)."""
    ship_package(docs.sparkSession)
    keep = without(docs, [text, *MADE])
    (body, home) = cols([text, host])
    sent = docs.select(*cols(keep), F.coalesce(home.cast("string"), F.lit("")).alias(f"{prefix}host"), body.alias(f"{prefix}t"))
    line = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("w", T.LongType())]))
    schema = T.StructType([*sent.schema.fields[:-1], *[T.StructField(s, T.LongType()) for s in STATS],
                           T.StructField(f"{prefix}text", T.LongType()), T.StructField(f"{prefix}lines", line)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for b in batches:
            texts = text_bytes(b.column(b.num_columns - 1))
            done = [text_stats(t) for t in texts]
            arrays = [pa.array([d[0][k] for d in done], pa.int64()) for k in range(len(STATS))]
            whole = pa.array([signed(xxhash.xxh3_64_intdigest(t or b"")) for t in texts], pa.int64())
            sizes = np.cumsum([0, *[len(d[1]) for d in done]]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([
                pa.array([signed(h) for d in done for h in d[1]], pa.int64()),
                pa.array([w for d in done for w in d[1].values()], pa.int64())], ["h", "w"])
            lines = pa.ListArray.from_arrays(pa.array(sizes), pairs)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays, whole, lines], names=schema.names)

    return sent.mapInArrow(run, schema)


def frequent_lines(stats: DataFrame, share: float = SHARE, least: int = LEAST, prefix: str = "__",
                   every_row: bool = False) -> DataFrame:
    """(host, h, n) of the lines above a host's limit; all counting combines before the shuffle.

    With `every_row` each row is a document of its own, copies of a text too.
    """
    own = stats.select(F.col(f"{prefix}host").alias("host"), F.col(f"{prefix}text").alias("text"), F.col(f"{prefix}lines.h").alias("h"))
    lines, texts = own.select("host", "text", F.explode("h").alias("h")), own.select("host", "text")
    if not every_row:  # copies of a text fall together first; the rest is an ordinary count
        lines, texts = lines.distinct(), texts.distinct()
    counts = lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    hosts = texts.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    return counts.join(hosts, "host").where(F.col("n") > F.col("docs") * share).select("host", "h", "n")


def without_lines(text: bytes | None, gone: set[int]) -> tuple[bytes | None, int]:
    """The text without the lines of these (unsigned) hashes, and how many words went."""
    import xxhash

    if not text or not gone:
        return text, 0
    left, n = [], 0
    for line in text.split(b"\n"):
        w = line.split()
        if w and xxhash.xxh3_64_intdigest(b" ".join(w).translate(LOWER)) in gone:
            n += len(w)
        else:
            left.append(line)
    return b"\n".join(left), n


def clean(docs: DataFrame, text: str = "text", host: str = "source", every_row: bool = False) -> DataFrame:
    """`docs` with the text less its frequent lines, the base counts of the whole text, n_removed_words, base_failed,
    depleted and kept.

    The first pass keeps line hashes only; the second gets each text's frequent ones and counts what it removes.
    """
    p = spare(docs)
    (body, home) = cols([text, host])
    key = F.xxhash64(F.coalesce(body.cast("string"), F.lit("")))
    home = F.coalesce(home.cast("string"), F.lit(""))
    stats = cut_lineage(line_stats(docs.select(body.alias("t"), key.alias("key"), home.alias("s")), "t", "s"))
    often = broadcast_if_small(cut_lineage(frequent_lines(stats, every_row=every_row).select(F.col("host").alias("__host"), "h")))
    lines = stats.select("__host", "key", F.explode("__lines.h").alias("h")).join(often, ["__host", "h"]).distinct()
    gone = lines.groupBy(F.col("__host").alias(f"{p}host"), F.col("key").alias(f"{p}key")).agg(F.collect_set("h").alias(f"{p}gone"))
    keep = without(docs, [text, *MADE])
    sent = docs.select(*cols(keep), body.alias(f"{p}t"), home.alias(f"{p}host"), key.alias(f"{p}key")).join(
        gone, [f"{p}host", f"{p}key"], "left").select(*cols(keep), f"{p}t", f"{p}gone")
    schema = T.StructType([*sent.schema.fields[:-2], T.StructField(text, T.StringType()), *[
        T.StructField(c, T.LongType()) for c in [*STATS, "n_removed_words"]]])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = text_bytes(b.column(len(keep)))
            made = [text_stats(t)[0] for t in texts]
            sets = [{h & (1 << 64) - 1 for h in g or ()} for g in b.column(len(keep) + 1).to_pylist()]
            done = [without_lines(t, g) for t, g in zip(texts, sets)]
            yield pa.RecordBatch.from_arrays([
                *b.columns[:len(keep)], pa.array([t for t, _ in done], pa.binary()).cast(pa.string()),
                *[pa.array([m[k] for m in made], pa.int64()) for k in range(len(STATS))],
                pa.array([n for _, n in done], pa.int64())], names=schema.names)

    return _judged(sent.mapInArrow(run, schema))


def _judged(out: DataFrame) -> DataFrame:
    left = F.col("n_words") - F.col("n_removed_words")
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).withColumn(
        "depleted", (F.col("n_removed_words") > 0) & ((left < LEFT * F.col("n_words")) | (left < LEFT_WORDS)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def quality(docs: DataFrame, text: str = "text", host: str = "source", every_row: bool = False) -> DataFrame:
    """The judgements of `clean` without the text, which is read once and never moves.

    The words that go are counted from the lines' hashes and word counts. Texts are
    told apart by host and hash; only those with a frequent line are looked up.
    """
    p = spare(docs)
    stats = cut_lineage(line_stats(docs, text, host, p))
    often = broadcast_if_small(cut_lineage(frequent_lines(stats, prefix=p, every_row=every_row).select(F.col("host").alias(f"{p}host"), F.col("h").alias(f"{p}h"))))
    lines = stats.select(f"{p}host", f"{p}text", F.explode(f"{p}lines").alias(f"{p}l")).select(
        f"{p}host", f"{p}text", F.col(f"{p}l.h").alias(f"{p}h"), F.col(f"{p}l.w").alias(f"{p}w"))
    # Copies of a text give the same lines; one of each is enough.
    met = lines.join(often, [f"{p}host", f"{p}h"]).groupBy(f"{p}host", f"{p}text", f"{p}h").agg(F.max(f"{p}w").alias(f"{p}w"))
    gone = met.groupBy(f"{p}host", f"{p}text").agg(F.sum(f"{p}w").alias("n_removed_words"))
    narrow = stats.drop(f"{p}lines").join(broadcast_if_small(cut_lineage(gone)), [f"{p}host", f"{p}text"], "left")
    keep = without(docs, [text, *MADE])
    return _judged(narrow.select(*cols(keep), *STATS, F.coalesce("n_removed_words", F.lit(0).cast("bigint")).alias("n_removed_words")))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(t, '{WORD}')) AS x, generate_subscripts(regexp_extract_all(t, '{WORD}'), 1) AS i FROM d),
g AS (SELECT rid, i, [x, lead(x) OVER p, lead(x, 2) OVER p] AS k, lead(x, 2) OVER p IS NOT NULL AS ok FROM w
      WINDOW p AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM g WHERE ok) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY rid),
l AS (SELECT rid, host, t, x, regexp_extract_all(translate(x, '{_LETTERS}', '{_LETTERS.lower()}'), '{WORD}') AS ws FROM
      (SELECT rid, host, t, unnest(string_split(t, chr(10))) AS x FROM d)),
n AS (SELECT rid, host, t, x, array_to_string(ws, ' ') AS norm, len(ws) AS nw FROM l WHERE len(ws) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT x) AS n FROM n GROUP BY rid),
hosts AS (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host),
often AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT t) AS c FROM n GROUP BY host, norm) JOIN hosts USING (host)
          WHERE c > {LEAST} AND c > docs * {SHARE}),
cut AS (SELECT rid, sum(nw) AS n FROM n JOIN often USING (host, norm) GROUP BY rid),
s AS (SELECT doc_id, CAST(len(regexp_extract_all(t, '{WORD}')) AS BIGINT) AS n_words,
  CAST(length(array_to_string(regexp_extract_all(t, '{WORD}'), '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(cut.n, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN cut USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < {LEFT} * n_words
  OR n_words - n_removed_words < {LEFT_WORDS})) AS kept FROM b"""


@query("op7_line_rules", sql=SQL)
def op7(spark, d) -> DataFrame:
    done = quality(table(spark, d, "documents").select("doc_id", "source", "text"))
    return done.select("doc_id", *STATS, "n_removed_words", "base_failed", "kept")
