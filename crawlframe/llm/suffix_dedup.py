"""Repeated passages by a hash-compared suffix sort, over all documents.

A byte goes if a string of `LENGTH` bytes that covers it starts anywhere else,
in the same document or another. Every such string (window) is held by its
anchor: the leftmost of its 64-byte substrings with the least hash. Equal
windows have equal anchors at the same place, so only suffixes that start at
anchors need comparing, and only within an anchor's hash.

The windows in a row that share an anchor form its context. Contexts that are
equal (128-bit hash) are counted first, with partial sums, so copies by the
thousand become one line. One context of each kind is fetched where an anchor
has several kinds. In a task, these are sorted by their text to the right of the
anchor and by their text to the left, in a mergesort whose comparisons find the
common extension by binary search over prefix polynomial hashes. Neighbours are
then checked byte by byte; if a hash deceived, the texts are sorted as they are.
For each offset of the anchor in a window, runs of the two orders tell which
windows are equal. Anchors with more kinds than a task should hold have their
windows' hashes counted instead, with the same result.

Passages of over 50 words that another document holds too, many of which are shorter
than `LENGTH`, are counted beside that and not removed: windows of `WORDS` words,
held by their least gram of `WORD_GRAM` words. Rows of anchors met in one document
alone end early; equal contexts met in two count whole, and of the others the windows'
hashes are compared (64 bits, within one anchor hash). White space between words makes
no difference, and rows with the same id and text are one document there.

Defined cases: null and short texts keep all their bytes; rows repeated as they
are repeat each other; an empty table gives no rows. Matches never cross rows. Only id
and text are read; other columns may have any name and are not in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.llm.common import query, table, text_bytes
from crawlframe.session import scratch, ship_package

LENGTH, GRAM = 400, 64
#: The same for passages, in words.
WORDS, WORD_GRAM = 51, 8
#: Bytes of contexts that a task compares at once, and kinds of one anchor up to which it does.
TASK, KINDS = 3 << 20, 20_000
#: Texts are scanned in parts of so many windows (bytes, words); places in a part fit 24 bits.
PART, WORD_PART = 8 << 20, 1 << 20

_rng = np.random.default_rng(20_240_901)
LETTERS = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 5
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64 for i < n; kept and grown by doubling."""
    if len(_powers[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            row = np.full(size, b, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Hashes:
    """Prefix polynomial hashes of a byte string, modulo 2 ** 64."""

    def __init__(self, x: np.ndarray):
        up, self.down = powers(len(x) + 1)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(LETTERS[x] * up[:-1], out=self.sums[1:])

    def of(self, at: np.ndarray, size) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.down[at]


def _window_minima(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours: blockwise running minima from either side."""
    n = len(key)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(back[:m], ahead[width - 1:width - 1 + m])


def _runs(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the least gram, first and last window of each run of windows of `width` grams that share it."""
    places = np.arange(len(grams))
    mixed = grams * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    key = mixed & np.uint64(~0xFFFFFF & (1 << 64) - 1) | places.astype(np.uint64)
    anchor = (_window_minima(key, width) & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return anchor[first], first, np.r_[first[1:], len(anchor)] - 1


def contexts(text: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, int]]:
    """(anchor hash, anchor place, first window, last window) of each run of windows with one anchor."""
    n = len(text)
    if n < length:
        return
    whole = np.frombuffer(text, np.uint8)
    for at in range(0, n - length + 1, PART):
        x = whole[at:at + PART + length - 1]
        h = Hashes(x)
        grams = (h.sums[gram:] - h.sums[:-gram]) * h.down[:len(x) - gram + 1]
        p, first, last = _runs(grams, length - gram + 1)
        signed = grams[p].view(np.int64)
        yield from zip(signed.tolist(), (p + at).tolist(), (first + at).tolist(), (last + at).tolist())


def split_words(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by blanks, and where each starts and ends there."""
    joined = b" ".join(text.split())
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return joined, np.r_[0, gaps + 1], np.r_[gaps, len(joined)]


def word_contexts(joined: bytes, starts: np.ndarray, ends: np.ndarray, length: int = WORDS,
                  gram: int = WORD_GRAM) -> Iterator[tuple[int, int, int, int]]:
    """What `contexts` gives, of a text as `split_words` has it; places and windows count words."""
    n = len(starts)
    whole = np.frombuffer(joined, np.uint8)
    for at in range(0, n - length + 1, WORD_PART):
        to = min(at + WORD_PART + length - 1, n)
        a, z = starts[at:to] - starts[at], ends[at:to] - starts[at]
        grams = Hashes(whole[starts[at]:ends[to - 1]]).of(a[:len(a) - gram + 1], z[gram - 1:] - a[:len(a) - gram + 1])
        p, first, last = _runs(grams, length - gram + 1)
        signed = grams[p].view(np.int64)
        yield from zip(signed.tolist(), (p + at).tolist(), (first + at).tolist(), (last + at).tolist())


def _slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Batches of few rows, so that what a task makes of them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _rows(batches: Iterator) -> Iterator:
    """Per text and kind of context: anchor, kind, place of the anchor, size, and where it starts."""
    import pyarrow as pa
    import xxhash

    digest = xxhash.xxh3_128_digest
    for b in _slices(batches):
        row, anchor, kind, left, size, starts = [], [], [], [], [], []
        for i, text in enumerate(text_bytes(b.column(2))):
            seen: dict[tuple[int, bytes], int] = {}
            for h, p, s0, s1 in contexts(text or b""):
                k = (h, digest(text[s0:s1 + LENGTH], p - s0))
                j = seen.get(k)
                if j is None:
                    seen[k] = len(row)
                    row.append(i)
                    anchor.append(h)
                    kind.append(k[1])
                    left.append(p - s0)
                    size.append(s1 + LENGTH - s0)
                    starts.append([s0])
                else:
                    starts[j].append(s0)
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([
            b.column(0).take(take), b.column(1).take(take), pa.array(anchor, pa.int64()), pa.array(kind, pa.binary()),
            pa.array(left, pa.int32()), pa.array(size, pa.int32()), pa.array(starts, pa.list_(pa.int64()))],
            ["id", "text_key", "anchor", "kind", "left", "size", "starts"])


def _word_rows(batches: Iterator) -> Iterator:
    """Per text and kind of context in words: anchor, kind, how many words it has and the words at which it starts."""
    import pyarrow as pa
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    for b in _slices(batches):
        row, anchor, kind, size, starts = [], [], [], [], []
        for i, text in enumerate(text_bytes(b.column(2))):
            seen: dict[tuple[int, int], int] = {}
            joined, begin, end = split_words(text or b"")
            for h, p, s0, s1 in word_contexts(joined, begin, end):
                k = (h, digest(joined[begin[s0]:end[s1 + WORDS - 1]], p - s0))
                j = seen.get(k)
                if j is None:
                    seen[k] = len(row)
                    row.append(i)
                    anchor.append(h)
                    kind.append(k[1])
                    size.append(s1 + WORDS - s0)
                    starts.append([s0])
                else:
                    starts[j].append(s0)
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([
            b.column(0).take(take), b.column(1).take(take), pa.array(anchor, pa.int64()),
            pa.array(np.array(kind, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(starts, pa.list_(pa.int64()))],
            ["id", "text_key", "anchor", "kind", "size", "starts"])


def _extension(h: Hashes, a, na, b, nb) -> np.ndarray:
    """Common extension of the strings at a and b of sizes na and nb, by binary search."""
    low, high = np.zeros(len(a), np.int64), np.minimum(na, nb)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) >> 1
        same = h.of(a, mid) == h.of(b, mid)
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)


def sort_suffixes(x: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings (place, size) in `x` within groups, and each one's common part with its predecessor.

    `group` is sorted. Runs are merged level by level for all groups at once: an
    element's place is its own plus its rank in the other run. A group's first
    has -1 in common. Order and common parts are verified on the bytes.
    """
    n = len(at)
    h = Hashes(x)
    begin = np.searchsorted(group, group, "left")
    count = np.searchsorted(group, group, "right") - begin
    order = np.arange(n)
    place = np.arange(n)

    def before(a, b, ties):
        """Whether string a comes before b; equal ones as `ties` says."""
        e = _extension(h, at[a], size[a], at[b], size[b])
        ended = e >= np.minimum(size[a], size[b])
        ca, cb = (x[np.minimum(at[k] + e, len(x) - 1)] for k in (a, b))
        return np.where(ended, (size[a] < size[b]) | (size[a] == size[b]) & ties, ca < cb)

    width = 1
    while n and width < count.max():
        pos = place[count > width]
        q = pos - begin[pos]
        pair, right = q // (2 * width) * (2 * width), (q // width) % 2 == 1
        end = begin[pos] + count[pos]
        other = begin[pos] + pair + np.where(right, 0, width)
        low = np.minimum(other, end)
        high = np.minimum(other + width, end)
        zero = low.copy()
        while (go := np.flatnonzero(low < high)).size:
            mid = (low[go] + high[go]) >> 1
            less = before(order[mid], order[pos[go]], right[go])
            low[go[less]] = mid[less] + 1
            high[go[~less]] = mid[~less]
        to = begin[pos] + pair + (q - pair - np.where(right, width, 0)) + (low - zero)
        moved = order.copy()
        moved[to] = order[pos]
        order = moved
        width *= 2
    common = np.full(n, -1, np.int64)
    if n > 1:
        same = np.flatnonzero(group[1:] == group[:-1]) + 1
        a, b = order[same - 1], order[same]
        common[same] = _extension(h, at[a], size[a], at[b], size[b])
        raw = x.tobytes()
        for i, j, c in zip(a.tolist(), b.tolist(), common[same].tolist()):
            s, t = raw[at[i]:at[i] + size[i]], raw[at[j]:at[j] + size[j]]
            if s[:c] != t[:c] or s[c:c + 1] > t[c:c + 1] or (c < min(len(s), len(t)) and s[c] == t[c]):
                return _sort_plainly(raw, at, size, group)
    return order, common


def _sort_plainly(raw: bytes, at, size, group) -> tuple[np.ndarray, np.ndarray]:
    """The same without hashes, for the case that one deceived."""
    texts = [raw[a:a + s] for a, s in zip(at.tolist(), size.tolist())]
    order = sorted(range(len(texts)), key=lambda i: (group[i], texts[i]))
    common = [-1] * len(texts)
    for k in range(1, len(order)):
        s, t = texts[order[k - 1]], texts[order[k]]
        if group[order[k - 1]] == group[order[k]]:
            common[k] = next((c for c, (u, v) in enumerate(zip(s, t)) if u != v), min(len(s), len(t)))
    return np.array(order, np.int64), np.array(common, np.int64)


def equal_windows(texts: list[bytes], left: np.ndarray, group: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Per context, the byte ranges covered by windows that another context of its group holds too.

    Windows at one offset of the anchor are equal if they fall into one run of
    the right order (common part at least what lies right) and one of the left.
    """
    n = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    at = np.cumsum(size) - size
    x = np.frombuffer(b"".join(texts), np.uint8)
    r_order, r_common = sort_suffixes(x, at + left, size - left, group)
    y = np.frombuffer(b"".join(t[:k][::-1] for t, k in zip(texts, left.tolist())), np.uint8)
    y = y if len(y) else np.zeros(1, np.uint8)
    l_order, l_common = sort_suffixes(y, np.cumsum(left) - left, left, group)
    low = left - (size - length)
    found = np.zeros((n, int(left.max()) + 1 if n else 1), bool)
    r_run, l_run = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for offset in range(found.shape[1]):
        own = np.flatnonzero((offset <= left) & (offset >= low))
        if len(own) < 2:
            continue
        r_run[r_order] = np.cumsum(r_common < length - offset)
        l_run[l_order] = np.cumsum(l_common < offset)
        key = r_run[own] * (n + 1) + l_run[own]
        order = np.argsort(key, kind="stable")
        k = key[order]
        twin = np.r_[False, k[1:] == k[:-1]]
        twin[:-1] |= twin[1:]
        found[own[order[twin]], offset] = True
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    # A window's start is the anchor's place less the offset, so runs of offsets are runs of starts.
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    for i, (a, z) in zip(np.nonzero(edge == 1)[0].tolist(), zip(
            np.nonzero(edge == 1)[1].tolist(), np.nonzero(edge == -1)[1].tolist())):
        out[i].append((int(left[i]) - z + 1, int(left[i]) - a + length))
    return out


def _word_kinds(slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the anchors in words that two documents have: their rows, and their kinds of contexts.

    A kind has the least and the greatest document (a, z) that has it, and how many kinds its anchor has.
    """
    spark = slim.sparkSession
    kind_of = slim.schema["id"].dataType.simpleString()
    path = scratch(spark, "word-anchors")
    slim.mapInArrow(_word_rows, f"id {kind_of}, text_key bigint, anchor bigint, kind bigint, size int, "
                                "starts array<bigint>").write.parquet(path)
    rows = spark.read.parquet(path)
    doc = F.xxhash64("id", "text_key")
    path = scratch(spark, "word-met")  # written first, so that the join can split a frequent anchor
    rows.groupBy("anchor").agg(F.min(doc).alias("a"), F.max(doc).alias("z")).where("a != z").select("anchor").write.parquet(path)
    met = spark.read.parquet(path)
    path = scratch(spark, "word-shared")
    rows.join(met, "anchor", "left_semi").write.parquet(path)
    rows = spark.read.parquet(path)
    kinds = rows.groupBy("anchor", "kind").agg(
        F.min(doc).alias("a"), F.max(doc).alias("z"), F.min(F.struct("id", "text_key", F.col("starts")[0].alias("at"), "size")).alias("one"))
    path = scratch(spark, "word-kinds")
    kinds.join(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")), "anchor").write.parquet(path)
    return rows, spark.read.parquet(path)


def _shared_windows(fetched: DataFrame, windows: int) -> DataFrame:
    """(anchor, kind, cover): of contexts that one document has, the word ranges of windows that another has too."""

    def compare(t):
        import pyarrow as pa

        t = t.to_pandas().drop_duplicates(["anchor", "kind"])  # equal rows of the table give a context twice
        size = t["hashes"].map(len).to_numpy()
        own = np.repeat(np.arange(len(t)), size)
        h, anchor = np.concatenate(t["hashes"].to_list()), t["anchor"].to_numpy()[own]
        order = np.lexsort((h, anchor))
        g, k = h[order], anchor[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (k[1:] != k[:-1])]
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(t["a"].to_numpy()[own[order]], first)
        greatest = np.maximum.reduceat(t["z"].to_numpy()[own[order]], first)
        found = np.zeros(len(h) + 1, bool)
        found[order] = (least != greatest)[np.cumsum(new) - 1]
        end = np.cumsum(size)
        alone = (t["a"] == t["z"]).to_numpy()
        hit = [i for i in np.unique(own[found[:-1]]).tolist() if alone[i]]
        covers = []
        for i in hit:
            edge = np.diff(np.r_[0, found[end[i] - size[i]:end[i]].astype(np.int8), 0])
            covers.append([{"a": a, "b": b - 1 + WORDS} for a, b in zip(
                np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())])
        return pa.table({"anchor": pa.array(t["anchor"].to_numpy()[hit], pa.int64()), "kind": pa.array(t["kind"].to_numpy()[hit], pa.int64()),
                         "cover": pa.array(covers, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))})

    part = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-8 * windows // TASK)))).alias("part")
    some = fetched.where(F.col("kinds") <= KINDS).groupBy(part).applyInArrow(
        compare, "anchor bigint, kind bigint, cover array<struct<a:int,b:int>>")
    hot = fetched.where(F.col("kinds") > KINDS)
    if not hot.limit(1).count():
        return some
    each = hot.dropDuplicates(["anchor", "kind"]).select("anchor", "kind", "a", "z", F.posexplode("hashes").alias("at", "hash"))
    twice = each.groupBy("anchor", "hash").agg(F.min("a").alias("a"), F.max("z").alias("z")).where("a != z").select("anchor", "hash")
    counted = each.where("a = z").join(twice, ["anchor", "hash"]).groupBy("anchor", "kind").agg(F.collect_list(F.struct(
        F.col("at").alias("a"), (F.col("at") + WORDS).alias("b"))).alias("cover"))
    return some.unionByName(counted)


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per document that has any, unsorted and overlapping: the byte ranges that go (id, text_key, spans),
    and the word ranges of passages that another document has too (id, text_key, passages)."""
    spark = docs.sparkSession
    ship_package(spark)
    slim = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"),
                       F.col(text).alias("text"))
    kind_of = slim.schema["id"].dataType.simpleString()
    path = scratch(spark, "anchors")
    slim.mapInArrow(_rows, f"id {kind_of}, text_key bigint, anchor bigint, kind binary, left int, size int, "
                           "starts array<bigint>").write.parquet(path)
    rows = spark.read.parquet(path)
    kinds = rows.groupBy("anchor", "kind").agg(
        F.sum(F.size("starts")).alias("n"), F.min(F.struct("id", "text_key", F.col("starts")[0].alias("at"), "left", "size")).alias("one"))
    # Only anchors met twice matter; most are met once and end here.
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("met"))
    path = scratch(spark, "kinds")  # columns in files take half the room of a checkpoint's rows
    kinds.join(several.where("met > 1"), "anchor").write.parquet(path)
    kinds = spark.read.parquet(path)
    whole = kinds.where("n > 1").select("anchor", "kind", F.array(F.struct(
        F.lit(0).alias("a"), F.col("one.size").alias("b"))).alias("cover"))

    word_rows, word_kinds = _word_kinds(slim)
    mixed, owner = kinds.where("kinds > 1"), [F.col("one.id").alias("id"), F.col("one.text_key").alias("text_key")]
    # Texts are shuffled once to cut the contexts of both sorts out of them.
    wanted = mixed.select(*owner, F.struct("anchor", "kind", "kinds", "one.at", "one.left", "one.size", "n").alias("want")).unionByName(
        word_kinds.where("kinds > 1").select(*owner, F.struct("anchor", "kind", "kinds", "a", "z", "one.at", "one.size").alias("want_words")),
        allowMissingColumns=True).groupBy("id", "text_key").agg(
            F.collect_list("want").alias("want"), F.collect_list("want_words").alias("want_words"))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for b in _slices(batches):
            out = []
            for t, want, want_words in zip(text_bytes(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist()):
                out += [(w["anchor"], w["kind"], w["kinds"], w["left"], w["n"], t[w["at"]:w["at"] + w["size"]], *[None] * 4) for w in want]
                joined, starts, ends = split_words(t or b"") if want_words else (b"", (), ())
                for w in want_words:
                    own = np.array([digest(joined[starts[k]:ends[k + WORDS - 1]]) for k in range(
                        w["at"], w["at"] + w["size"] - WORDS + 1)], np.uint64).view(np.int64)
                    out.append((w["anchor"], None, w["kinds"], None, None, None, w["kind"], w["a"], w["z"], own))
            cols_ = list(zip(*out)) if out else [()] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols_, (
                pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 3, pa.list_(pa.int64())))],
                ["anchor", "kind", "kinds", "left", "n", "context", "word_kind", "a", "z", "hashes"])

    same = slim["id"].eqNullSafe(wanted["id"]) & (slim["text_key"] == wanted["text_key"])
    fetched = slim.join(wanted, same).select(slim["text"], "want", "want_words").mapInArrow(
        cut, "anchor bigint, kind binary, kinds bigint, left int, n bigint, context binary, "
             "word_kind bigint, a bigint, z bigint, hashes array<bigint>")
    path = scratch(spark, "contexts")
    fetched.write.parquet(path)
    fetched = spark.read.parquet(path)
    total, windows_ = fetched.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (
        F.octet_length("context"), F.when(F.col("hashes").isNotNull(), F.size("hashes")))]).first()
    shared = _shared_windows(fetched.where("hashes is not null").select(
        "anchor", F.col("word_kind").alias("kind"), "kinds", "a", "z", "hashes"), windows_)
    fetched = fetched.where("hashes is null").select("anchor", "kind", "kinds", "left", "n", "context")
    tasks = max(1, -(-total // TASK))

    def compare(t):
        import pyarrow as pa

        t = t.sort_by([("anchor", "ascending"), ("kind", "ascending")])
        # Equal rows of the table give a context twice.
        anchor, kind = t["anchor"].to_pylist(), t["kind"].to_pylist()
        keep = [i for i in range(len(anchor)) if not i or (anchor[i], kind[i]) != (anchor[i - 1], kind[i - 1])]
        t = t.take(pa.array(keep, pa.int64()))
        group = np.unique(t["anchor"].to_numpy(), return_inverse=True)[1]
        covers = equal_windows(t["context"].to_pylist(), t["left"].to_numpy().astype(np.int64), group)
        hit = [i for i, c in enumerate(covers) if c and t["n"][i].as_py() == 1]
        t = t.take(pa.array(hit, pa.int64()))
        return pa.table({"anchor": t["anchor"], "kind": t["kind"], "cover": pa.array(
            [[{"a": a, "b": b} for a, b in covers[i]] for i in hit],
            pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))})

    found = "anchor bigint, kind binary, cover array<struct<a:int,b:int>>"
    part = F.pmod(F.xxhash64("anchor"), F.lit(tasks)).alias("part")
    sorted_ = fetched.where(F.col("kinds") <= KINDS).groupBy(part).applyInArrow(compare, found)

    def windows(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for b in batches:
            for a, k, left, c in zip(*(b.column(n).to_pylist() for n in ("anchor", "kind", "left", "context"))):
                m = len(c) - LENGTH + 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([a] * m, pa.int64()), pa.array([k] * m, pa.binary()), pa.array(range(m), pa.int32()),
                    pa.array([xxhash.xxh3_128_digest(c[i:i + LENGTH]) for i in range(m)], pa.binary())],
                    ["anchor", "kind", "at", "hash"])

    hot = fetched.where(F.col("kinds") > KINDS).dropDuplicates(["anchor", "kind"])
    each = hot.mapInArrow(windows, "anchor bigint, kind binary, at int, hash binary")
    twice = each.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    counted = each.join(twice, ["anchor", "hash"]).groupBy("anchor", "kind").agg(F.collect_list(F.struct(
        F.col("at").alias("a"), (F.col("at") + LENGTH).alias("b"))).alias("cover"))
    many = spark.createDataFrame([], found) if not hot.limit(1).count() else counted.join(
        mixed.where("n = 1").select("anchor", "kind"), ["anchor", "kind"], "left_semi")
    cover = whole.unionByName(sorted_).unionByName(many)
    spans = rows.select("id", "text_key", "anchor", "kind", "starts").join(cover, ["anchor", "kind"]).select(
        "id", "text_key", F.explode("starts").alias("s"), "cover").select(
        "id", "text_key", F.transform("cover", lambda c: F.struct(
            (F.col("s") + c["a"]).alias("a"), (F.col("s") + c["b"]).alias("b"))).alias("c"))
    equal = word_kinds.where("a != z").select("anchor", "kind", F.array(F.struct(
        F.lit(0).alias("a"), F.col("one.size").alias("b"))).alias("cover"))
    passages = word_rows.select("id", "text_key", "anchor", "kind", "starts").join(equal.unionByName(shared), ["anchor", "kind"]).select(
        "id", "text_key", F.explode("starts").alias("s"), "cover").select(
        "id", "text_key", F.transform("cover", lambda c: F.struct(
            (F.col("s") + c["a"]).alias("a"), (F.col("s") + c["b"]).alias("b"))).alias("c"))
    return (spans.groupBy("id", "text_key").agg(F.flatten(F.collect_set("c")).alias("spans")),
            passages.groupBy("id", "text_key").agg(F.flatten(F.collect_set("c")).alias("passages")))


def _merged(ranges) -> list[list[int]]:
    """The ranges in order; those that meet or overlap as one."""
    merged: list[list[int]] = []
    for a, z in sorted((s["a"], s["b"]) for s in ranges or ()):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], z)
        else:
            merged.append([a, z])
    return merged


def remove_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, removed, n_passage_words): remaining bytes, the maximal removed runs,
    and how many words stand in passages of `WORDS` words or more that another document has too."""
    spans, passages = repeated(docs, doc_id, text)
    key = F.xxhash64(F.coalesce(text, F.lit("")))
    slim = docs.select(F.col(doc_id).alias("doc_id"), key.alias("key_"), F.col(text).alias("text"))
    of = lambda found: slim["doc_id"].eqNullSafe(found["id"]) & (slim["key_"] == found["text_key"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in _slices(batches):
            kept, sizes, gone, runs, held = [], [], [], [], []
            for t, spans_, passages_ in zip(text_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                t = t or b""
                merged = _merged(spans_)
                ends = [0, *[e for m in merged for e in m], len(t)]
                kept.append(b"".join(t[ends[i]:ends[i + 1]] for i in range(0, len(ends), 2)))
                sizes.append(len(t))
                gone.append(sum(z - a for a, z in merged))
                runs.append([{"a": a, "b": z} for a, z in merged])
                held.append(sum(z - a for a, z in _merged(passages_)))
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
                pa.array(runs, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(held, pa.int64())],
                ["doc_id", "kept", "n_bytes", "n_removed", "removed", "n_passage_words"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.join(spans, of(spans), "left").join(passages, of(passages), "left").select(
        slim["doc_id"], "text", "spans", "passages").mapInArrow(
        run, f"doc_id {kind}, kept binary, n_bytes bigint, n_removed bigint, removed array<struct<a:bigint,b:bigint>>, n_passage_words bigint")


@query("op9_suffix_dedup")
def op9(spark, d) -> DataFrame:
    done = remove_repeated(table(spark, d, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"),
                       # What is left, as text; a character that a cut went through is U+FFFD.
                       F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"),
                       # Passages of over 50 words; the bytes removed are those of 400-byte strings alone.
                       "n_passage_words")
