"""Search for contained text through character grams, so that only candidates are read.

`GramIndex` is an inverted index for one keyword at a time: the places of every piece of
three characters, stored by piece. `contained_join` looks up many patterns at once: each is
represented by one rare piece of eight characters or fewer, and texts by their window minima.
Both find candidates by equality and place, and test them with the real pattern afterwards, so
results are those of `ILIKE '%pattern%'`, wildcards (`%`, `_`) included.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.functions.text import spare
from crawlframe.operators.matching import contained, rule_groups
from crawlframe.session import cut_lineage

GRAM = 3
#: Folders of the index; a piece lies in one of them.
PARTS = 64
#: Rarest pieces of a keyword that are looked up.
LOOKED_UP = 4


def pieces(text: Column, n: int) -> Column:
    """All pieces of `n` characters of a text with their places from 1: array of (gram, at)."""
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    made = F.transform(starts, lambda i: F.struct(F.substr(text, i, F.lit(n)).alias("gram"), i.alias("at")))
    return F.when(F.length(text) >= n, made).otherwise(F.expr("cast(array() as array<struct<gram:string,at:int>>)"))


def literal_runs(pattern: str) -> list[str]:
    """What a pattern asks for literally, in order: the text between its wildcards."""
    return [r for r in re.split("[%_]+", pattern.lower()) if r]


class GramIndex:
    """The pieces of some text columns of a table whose rows are named by `key`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def build(cls, rows: DataFrame, key: str, columns: list[str], root: str) -> GramIndex:
        """Index the columns under `root`; rows are named by the 64-bit hash of `key`.

        Places are written by piece, so a lookup prunes to a folder and, inside a
        file, to the row groups of its pieces.
        """
        made = cls(rows.sparkSession, root)
        texts = F.array(*[F.struct(F.lit(i).alias("field"), F.lower(c).alias("text")) for i, c in enumerate(columns)])
        one = rows.select(F.xxhash64(key).alias("id"), F.explode(texts).alias("t")).select("id", "t.field", "t.text")
        places = one.select("id", "field", F.explode(pieces(F.col("text"), GRAM)).alias("p")).select(
            "id", "field", "p.at", "p.gram", cls._part(F.col("p.gram")).alias("part"))
        places.hint("rebalance", "part").sortWithinPartitions("part", "gram", "id").write.partitionBy("part").option(
            "compression", "zstd").parquet(f"{made.root}/places")
        counts = rows.sparkSession.read.parquet(f"{made.root}/places").groupBy("part", "gram").agg(F.count(F.lit(1)).alias("n"))
        counts.hint("rebalance", "part").sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(
            f"{made.root}/counts")
        return made

    @staticmethod
    def _part(gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")

    def _of(self, table: str, grams: list[str]) -> DataFrame:
        """Rows of the index with one of the pieces; folders and pieces are both pushed to the scan."""
        named = self.spark.range(1).select(F.explode(F.array(*map(F.lit, grams))).alias("g")).select(self._part(F.col("g")).alias("p"))
        parts = sorted({r["p"] for r in named.collect()})
        return self.spark.read.parquet(f"{self.root}/{table}").filter(F.col("part").isin(parts) & F.col("gram").isin(grams))

    def candidates(self, pattern: str) -> DataFrame | None:
        """Ids that can match `%pattern%`, or None if it has no literal run of three characters.

        Of every run the rarest pieces are looked up; they must lie in one text
        of the row at the distances that the run gives them.
        """
        runs = [r for r in literal_runs(pattern) if len(r) >= GRAM]
        if not runs:
            return None
        wanted = [(k, i, r[i:i + GRAM]) for k, r in enumerate(runs) for i in range(len(r) - GRAM + 1)]
        grams = sorted({g for _, _, g in wanted})
        known = {r["gram"]: r["n"] for r in self._of("counts", grams).select("gram", "n").collect()}  # the keyword's own pieces
        asked = []
        for k in range(len(runs)):
            own = sorted((known.get(g, 0), i, g) for j, i, g in wanted if j == k)
            asked += [(k, i, g) for _, i, g in own[:LOOKED_UP]]
        table = F.array(*[F.struct(F.lit(k).alias("run"), F.lit(i).alias("off"), F.lit(g).alias("g")) for k, i, g in asked])
        met = self._of("places", sorted({g for _, _, g in asked})).select(
            "id", "field", "gram", "at", F.explode(F.filter(table, lambda a: a["g"] == F.col("gram"))).alias("a"))
        # The places of a run agree on where it starts.
        starts = met.groupBy("id", "field", F.col("a.run").alias("run"), (F.col("at") - F.col("a.off")).alias("start")).agg(
            F.count(F.lit(1)).alias("n"))
        need = F.create_map(*[F.lit(x) for k in range(len(runs)) for x in (k, sum(1 for j, _, _ in asked if j == k))])
        whole = starts.filter(F.col("n") == need[F.col("run")])
        fields = whole.groupBy("id", "field").agg(F.count_distinct("run").alias("runs")).filter(F.col("runs") == len(runs))
        return fields.select("id").distinct()


def search(rows: DataFrame, key: str, columns: list[str], pattern: str, index: GramIndex) -> DataFrame:
    """Rows where one of the indexed columns matches `%pattern%`, without regard to case."""
    found, own = index.candidates(pattern), spare(rows) + "id"
    near = rows if found is None else rows.join(found.withColumnRenamed("id", own), F.xxhash64(key) == F.col(own), "left_semi")
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{pattern}%"), F.lit(False))
    return near.filter(hit)


# --- many patterns against many texts -------------------------------------------------------

#: Characters of a piece that stands for a pattern, pieces in a window, and characters kept on either side of a piece.
PIECE, WINDOW, AROUND = 6, 3, 12


def _minima(text: Column, literal: bool = False) -> Column:
    """The pieces of `PIECE` characters that have the least hash of some window of `WINDOW` of them: array of (gram, at).

    A text that contains a run of `PIECE + WINDOW - 1` characters has the same minima
    in it, at the same places, as the run itself: the leftmost of equal ones is taken in
    both. With `literal`, windows that hold `_` are left out.
    """
    grams = F.transform(pieces(text, PIECE), lambda p: F.struct(F.xxhash64(p["gram"]).alias("h"), p["at"].alias("at"), p["gram"].alias("gram")))

    def chosen(g: Column) -> Column:
        windows = F.sequence(F.lit(1), F.size(g) - (WINDOW - 1))
        if literal:
            windows = F.filter(windows, lambda i: ~F.contains(F.substr(text, i, F.lit(PIECE + WINDOW - 1)), F.lit("_")))
        least = F.array_distinct(F.transform(windows, lambda i: F.array_min(F.slice(g, i, F.lit(WINDOW)))))
        return F.transform(least, lambda m: F.struct(m["gram"].alias("gram"), m["at"].alias("at")))

    return F.transform(F.array(grams), lambda g: F.when(F.size(g) >= WINDOW, chosen(g)).otherwise(
        F.expr("cast(array() as array<struct<gram:string,at:int>>)")))[0]


def _around(text: Column, at: Column, fill: str) -> Column:
    """A piece at `at` with `AROUND` characters on either side, `fill` beyond the ends."""
    edge = F.lit(fill * AROUND)
    return F.substr(F.concat(edge, text, edge), at, F.lit(PIECE + 2 * AROUND))


def _escaped(pattern: Column) -> Column:
    return F.replace(pattern, F.lit("\\"), F.lit("\\\\"))


def candidate_pairs(names: DataFrame, rows: DataFrame) -> DataFrame:
    """(_id, _pattern), distinct: texts, by hash, that may match a pattern of `names`, as far as the surroundings of a piece tell.

    A row of `told` has what stands around its piece, so a pattern that shares only
    a frequent piece with many texts is settled where the two meet, and no such pair goes on.
    """
    part = F.explode(F.split(F.lower("_pattern"), "%+")).alias("_part")
    anchors = names.select("_pattern", part).select("_pattern", "_part", F.explode(_minima(F.col("_part"), literal=True)).alias("_p"))
    anchors = anchors.select("_pattern", F.col("_p.gram").alias("_piece"), _around(F.col("_part"), F.col("_p.at"), "_").alias("_mask"))
    # Only hashes, pieces and their surroundings of the distinct texts meet the patterns; a text itself is fetched for a candidate.
    told = rows.select(F.xxhash64("_low").alias("_id"), "_low").dropDuplicates(["_id", "_low"]).select(
        "_id", "_low", F.explode(_minima(F.col("_low"))).alias("_p")).select(
        "_id", F.col("_p.gram").alias("_piece"), _around(F.col("_low"), F.col("_p.at"), "\0").alias("_near"))
    common = told.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    run = F.array_max(F.transform(F.split("_mask", "_"), lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))["run"]
    # Sizes are guessed from before the explode, so neither exploded side may be broadcast by them.
    rare = anchors.hint("merge").join(common, "_piece").groupBy("_pattern").agg(F.min(F.struct("_n", "_piece", "_mask")).alias("_a")).select(
        "_pattern", F.col("_a._piece").alias("_piece"), F.col("_a._mask").alias("_mask")).select(
        "_pattern", "_piece", run.alias("_run"), _escaped(F.col("_mask")).alias("_mask"))
    met = told.hint("merge").join(rare, "_piece").filter(F.contains("_near", "_run") & F.like("_near", F.col("_mask")))
    return met.select("_id", "_pattern").distinct()


def contained_join(patterns: DataFrame, pattern: str, texts: DataFrame, text: str) -> DataFrame:
    """Pairs of a distinct pattern and a row of `texts` whose `text` matches ILIKE '%pattern%'.

    A pattern's longest literal runs give its pieces; the one that the fewest texts
    have stands for it, so a piece that most texts share (a common folder or ending)
    joins nothing unless a pattern has no other; then what stands around it is compared
    in the join. Patterns without a run of eight characters
    are matched by the automaton over the run they have, and by a scan if they have none.
    Gives the columns of `texts` and `pattern`.
    """
    wild = F.split(F.lower("_pattern"), "[%_]+")
    names = cut_lineage(patterns.select(F.col(pattern).cast("string").alias("_pattern")).filter("_pattern is not null").distinct()
                        .withColumn("_runs", F.filter(wild, lambda r: F.length(r) > 0)))
    least = PIECE + WINDOW - 1
    hit = F.like("_low", F.concat(F.lit("%"), _escaped(F.lower("_pattern")), F.lit("%")))
    out = [F.col(f"`{c}`") for c in texts.columns] + [F.col("_pattern").alias(pattern)]
    rows = texts.withColumn("_low", F.lower(text)).filter("_low is not null")

    long_ = F.exists("_runs", lambda r: F.length(r) >= least)
    near = candidate_pairs(names.filter(long_), rows)
    pairs = rows.withColumn("_id", F.xxhash64("_low")).join(near, "_id").filter(hit).select(*out)

    short = names.filter(~long_).withColumn("_run", F.array_max(F.transform(
        "_runs", lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))["run"])
    for words in rule_groups(short.filter("_run is not null"), "_run"):
        if words:
            lows = rows.select("_low").distinct()
            met = contained(lows, "_low", "_low", words, "_run").join(short.select("_pattern", "_run"), "_run")
            pairs = pairs.unionByName(rows.join(met, "_low").filter(hit).select(*out))
    # A pattern of wildcards alone asks for a least length; there are few of them, as they are distinct.
    blank = short.filter("_run is null").select("_pattern", F.length(F.replace("_pattern", F.lit("%"), F.lit(""))).alias("_least"))
    if not blank.isEmpty():
        shortest = blank.groupBy("_least").agg(F.collect_list("_pattern").alias("_ps"))
        every = shortest.agg(F.collect_list(F.struct("_least", "_ps")).alias("_all"))
        listed = every.first()["_all"]
        found = F.flatten(F.array(*[F.when(F.length("_low") >= r["_least"], F.array(*map(F.lit, r["_ps"]))).otherwise(
            F.array().cast("array<string>")) for r in listed]))
        pairs = pairs.unionByName(rows.select("*", F.explode(found).alias("_pattern")).select(*out))
    return pairs
