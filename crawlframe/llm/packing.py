"""Best-fit packing by a grouping genetic algorithm on islands.

Token counts become pieces of at most `CAPACITY`. Pieces are dealt by number
into blocks of bounded size, so no source or group of copies is ever together
by itself. Every block is solved on several islands, each a row with the
block's lengths and its own population. A generation crosses two packings:
well-filled bins of one are injected whole into the other, bins there that hold
an injected piece are opened, and their other pieces are placed again by best
fit. After each epoch the elite of an island moves to the next one. The best
packing of a block stands; bins that are not well filled are then opened in all
blocks and packed again together, until that saves nothing more.

Defined cases: a null or empty text is one piece with the end mark only;
repeated rows are packed each; pieces longer than the capacity are not allowed,
those as long fill a sequence; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.functions.text import spare
from crawlframe.llm.common import cols, query, table, without
from crawlframe.session import cut_lineage, ship_package

CAPACITY = 2048
BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 16_384, 2, 2, 12, 4
#: Share of the capacity from which a bin counts as well filled.
WELL = 0.998
END = 0


class WordTokens:
    """Ids of whole texts, word by word, as the tokenizer gives them for the whole text.

    This tokenizer never joins characters across white space, so a word's ids
    do not depend on its neighbours. Words of Latin letters are normalised by a
    table that the tokenizer itself fills, split, and encoded by its model;
    any other word goes through the full tokenizer. Both caches hold two
    generations of bounded size.
    """

    SIMPLE = 0x250

    def __init__(self, path: str, words: int = 200_000, parts: int = 120_000):
        import os
        import re

        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        plain = [chr(i) for i in range(1, self.SIMPLE) if not chr(i).isspace()]
        self.norm = {ord(c): self.full.normalizer.normalize_str(c) for c in plain}
        level = self.full.pre_tokenizer
        inner = set("".join(self.norm.values()))
        self.bytes = {ord(c): "".join(p for p, _ in level.pre_tokenize_str(c)) for c in inner}
        # The split pattern of the tokenizer file.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        # Words that the table does not cover: controls, blanks, special marks, other scripts.
        self.odd = re.compile(f"[\x00-\x20\x7f-\xa0]|<\\||[^\x00-{chr(self.SIMPLE - 1)}]").search
        self.sizes = (words, parts)
        self.words: tuple[dict, dict] = ({}, {})
        self.parts: tuple[dict, dict] = ({}, {})

    def _part(self, part: str) -> bytes:
        new, old = self.parts
        ids = old.get(part)
        if ids is None:
            ids = array("I", [t.id for t in self.model.tokenize(part.translate(self.bytes))]).tobytes()
        if len(new) >= self.sizes[1]:
            self.parts = ({}, new)
            new = self.parts[0]
        new[part] = ids
        return ids

    def _word(self, word: bytes) -> bytes:
        new, old = self.words
        ids = old.get(word)
        if ids is None:
            text = word.decode("utf-8", "replace")
            if not self.odd(text):
                text = text.translate(self.norm)
                get = self.parts[0].get
                if text.isalpha():
                    ids = get(text) or self._part(text)
                else:
                    ids = b"".join([get(p) or self._part(p) for p in self.split(text)])
            else:
                ids = np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(new) >= self.sizes[0]:
            self.words = ({}, new)
            new = self.words[0]
        new[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        get, miss = self.words[0].get, self._word
        return b"".join([get(w) or miss(w) for w in text.split()])


_loaded: dict[str, WordTokens] = {}


def token_pieces(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the columns of `docs` without the text, piece, start, length, ids_crc32.

    `tokenizer` is a tokenizer file that every executor has at that path.
    """
    from crawlframe.llm.common import text_bytes

    ship_package(docs.sparkSession)
    made = ["piece", "start", "length", "ids_crc32"]
    keep = without(docs, [text, *made])
    sent = docs.select(*cols(keep), *[c.alias(f"{spare(docs)}text") for c in cols([text])])
    schema = T.StructType([*sent.schema.fields[:-1], T.StructField("piece", T.IntegerType()), *[
        T.StructField(n, T.LongType()) for n in made[1:]]])
    tail = np.array([END], "<u4").tobytes()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if tokenizer not in _loaded:
            _loaded[tokenizer] = WordTokens(tokenizer)
        encode = _loaded[tokenizer].encode
        step = 4 * capacity
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(text_bytes(b.column(len(keep)))):
                ids = encode(t or b"") + tail
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[c.take(take) for c in b.columns[:-1]], pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=[*b.schema.names[:-1], *made])

    return sent.mapInArrow(run, schema)


class Packing:
    """Packings of one block: an array of bin numbers per packing."""

    def __init__(self, lengths: np.ndarray, capacity: int, rng: np.random.Generator):
        self.n, self.cap, self.rng = lengths, capacity, rng
        self.bound = -(-int(lengths.sum()) // capacity)

    def fills(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, self.n, int(bins.max()) + 1).astype(np.int64)

    def fitness(self, bins: np.ndarray) -> tuple[int, float]:
        """Fewer bins first, then fuller ones (mean square of the fill)."""
        f = self.fills(bins)
        used = int((f > 0).sum())
        return -used, float(((f / self.cap) ** 2).sum() / used)

    def best_fit(self, bins: np.ndarray, items: np.ndarray, fills: np.ndarray) -> np.ndarray:
        """Place `items` in their order, each where the least room is left; `bins` is changed.

        Bins stand in lists by free room; a bit set over the rooms finds the
        smallest room that suffices.
        """
        room: dict[int, list[int]] = {}
        free = self.cap - fills
        open_ = np.flatnonzero((fills > 0) & (free > 0))
        for r, b in zip(free[open_].tolist(), open_.tolist()):
            room.setdefault(r, []).append(b)
        there = sum(1 << r for r in room)
        fresh = len(fills)
        for i, size in zip(items.tolist(), self.n[items].tolist()):
            fit = there >> size
            if fit:
                r = size + (fit & -fit).bit_length() - 1
                at = room[r]
                b = at.pop()
                if not at:
                    there ^= 1 << r
                    del room[r]
            else:
                b, r = fresh, self.cap
                fresh += 1
            bins[i] = b
            r -= size
            if r:
                if r in room:
                    room[r].append(b)
                else:
                    room[r] = [b]
                    there |= 1 << r
        return np.unique(bins, return_inverse=True)[1].astype(np.int32)

    def start(self, noise: float) -> np.ndarray:
        key = self.n * (1 + noise * self.rng.standard_normal(len(self.n)))
        order = np.lexsort((np.arange(len(key)), -key))
        return self.best_fit(np.full(len(self.n), -1, np.int64), order, np.zeros(0, np.int64))

    def cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Inject some of a's well-filled bins into b; open b's bins that share a piece with them."""
        fa = self.fills(a)
        good = np.flatnonzero(fa >= WELL * self.cap)
        if not len(good):
            good = np.argsort(-fa)[:max(1, len(fa) // 4)]
        chosen = np.zeros(len(fa), bool)
        chosen[good[self.rng.random(len(good)) < self.rng.uniform(0.05, 0.3)]] = True
        injected = chosen[a]
        hit = np.zeros(int(b.max()) + 1, bool)
        hit[b[injected]] = True
        # The worst bins are opened as well, so that new room meets the displaced pieces.
        fb = self.fills(b)
        hit[np.argsort(fb, kind="stable")[:max(1, len(fb) // 100)]] = True
        displaced = np.flatnonzero(hit[b] & ~injected)
        child = np.where(injected, a + len(fb), b).astype(np.int64)
        child[displaced] = -1
        kept = child >= 0
        fills = np.bincount(child[kept], self.n[kept], len(fb) + len(fa)).astype(np.int64)
        order = displaced[np.argsort(-self.n[displaced], kind="stable")]
        return self.best_fit(child, order, fills)

    def evolve(self, population: list[np.ndarray], generations: int) -> list[np.ndarray]:
        ranked = sorted(population, key=self.fitness, reverse=True)
        for _ in range(generations):
            if -self.fitness(ranked[0])[0] <= self.bound or len(ranked) < 2:
                break
            i, j = self.rng.choice(len(ranked), 2, replace=False)
            ranked.append(self.cross(ranked[i], ranked[j]))
            ranked = sorted(ranked, key=self.fitness, reverse=True)[:POPULATION]
        return ranked


STATE = "block bigint, island int, uids array<bigint>, lengths array<int>, packings array<array<int>>"


def _solve(pieces: DataFrame, capacity: int, seed: int) -> DataFrame:
    """(block, uid, bin, length) for the best packing of each block of (uid, length)."""
    n = pieces.count()
    blocks = max(1, -(-n // BLOCK))
    dealt = pieces.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(blocks)).alias("block"))

    def gather(pdf):
        import pandas as pd

        pdf = pdf.sort_values("uid")
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "uids": [pdf["uid"].to_numpy()],
                             "lengths": [pdf["length"].to_numpy(np.int32)]})

    state = dealt.groupBy("block").applyInPandas(gather, "block bigint, uids array<bigint>, lengths array<int>")
    state = state.select("block", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), "uids",
                         "lengths", F.expr("cast(array() as array<array<int>>)").alias("packings"))

    def epoch(number: int):
        def run(frames: Iterator) -> Iterator:
            for pdf in frames:
                done = []
                for block, island, lengths, given in zip(pdf["block"], pdf["island"], pdf["lengths"], pdf["packings"]):
                    rng = np.random.default_rng([seed, int(block), int(island), number])
                    p = Packing(np.asarray(lengths, np.int64), capacity, rng)
                    own = [np.asarray(g, np.int32) for g in given]
                    for k in range(POPULATION - len(own)):
                        own.append(p.start(0.0 if k == 0 and island == 0 else 0.02 * (k + 1)))
                        if -p.fitness(own[-1])[0] <= p.bound:
                            break
                    done.append([x.tolist() for x in p.evolve(own, GENERATIONS)[:2]])
                yield pdf.assign(packings=done)
        return run

    state = cut_lineage(state.repartition(max(1, min(blocks * ISLANDS, 100_000)), "block", "island").mapInPandas(
        epoch(0), STATE))
    for number in range(1, EPOCHS):
        elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"),
                             F.element_at("packings", 1).alias("guest"))
        met = state.join(elite, ["block", "island"]).select(
            "block", "island", "uids", "lengths", F.array_distinct(
                F.array_append(F.slice("packings", 1, 1), F.col("guest"))).alias("packings"))
        state = cut_lineage(met.mapInPandas(epoch(number), STATE))
    best = F.element_at("packings", 1)
    # The size of a block's packing decides; ties go to the first island.
    ranked = state.select("block", "island", (F.array_max(best) + 1).alias("used"))
    win = ranked.groupBy("block").agg(F.min(F.struct("used", "island")).alias("w")).select("block", "w.island")
    chosen = state.join(win, ["block", "island"]).select(
        "block", F.explode(F.arrays_zip("uids", F.col("lengths").alias("n"), best.alias("b"))).alias("z"))
    return cut_lineage(chosen.select("block", F.col("z.uids").alias("uid"), F.col("z.b").cast("bigint").alias("bin"),
                                     F.col("z.n").cast("bigint").alias("length")))


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, rounds: int = 3,
         seed: int = 11) -> DataFrame:
    """`pieces` with sequence_id and offset; both columns are replaced if they exist.

    Rows are numbered and written once; packing itself moves (number, length).
    """
    ship_package(pieces.sparkSession)
    keep = without(pieces, ["sequence_id", "offset", "__uid"])
    rows = cut_lineage(pieces.select(*cols(keep), F.monotonically_increasing_id().alias("__uid")))
    todo = rows.select(F.col("__uid").alias("uid"), F.col(length).cast("bigint").alias("length"))
    done, before = None, None
    for k in range(rounds):
        solved = _solve(todo, capacity, seed + k)
        fills = solved.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
        blocks, bins = fills.agg(F.count_distinct("block"), F.count(F.lit(1))).first()
        named = solved.select("uid", "length", "block", "bin", F.concat_ws(
            "-", F.lit(k), "block", "bin").alias("name"))
        last = k == rounds - 1 or blocks <= 1 or (before is not None and bins >= before)
        if last:
            done = named if done is None else done.unionByName(named)
            break
        poor = fills.where(F.col("fill") < WELL * capacity).select("block", "bin")
        before = poor.count()
        kept = named if not before else named.join(poor, ["block", "bin"], "left_anti")
        done = kept if done is None else done.unionByName(kept)
        if before <= 1:
            done = done.unionByName(named.join(poor, ["block", "bin"], "left_semi"))
            break
        todo = cut_lineage(named.join(poor, ["block", "bin"], "left_semi").select("uid", "length"))
    # A bin holds at most `capacity` pieces, so its window is bounded.
    from pyspark.sql import Window as W

    w = W.partitionBy("name").orderBy("uid")
    placed = done.select("uid", F.xxhash64("name").alias("sequence_id"), (F.sum("length").over(
        w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("length")).alias("offset"))
    return rows.join(placed, rows["__uid"] == placed["uid"]).select(*cols(keep), "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces of (doc_id, text) with their place in a sequence."""
    return pack(token_pieces(docs.select("doc_id", "text"), tokenizer)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_packing")
def op1(spark, d) -> DataFrame:
    return pack_documents(table(spark, d, "documents"), word_bpe())
