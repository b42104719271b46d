"""Many substrings at once: an automaton over all rules, run over each text in one Arrow pass.

The automaton is a trie of the rules with failure links, so a text is read once
whatever the number and the lengths of the rules. A worker builds it once per rule
list and keeps it for its next tasks. Texts stay where they are: nothing is joined,
exploded or shuffled, and only hits come out.

A rule list of any length works: beyond a measured bound of rows and bytes it is cut
into hash groups, each with an automaton and a pass of its own, and never held whole.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.functions.text import spare
from crawlframe.operators.batches import pieces
from crawlframe.session import cut_lineage, ship_package

#: Rules of one automaton: at most so many, and so many characters in all.
GROUP_RULES, GROUP_CHARS = 200_000, 16 << 20
#: Automata that a worker keeps.
KEPT = 1
#: Hits after which a batch goes out.
HITS = 1 << 16
_automata: dict[str, ahocorasick.Automaton] = {}


def automaton(words: list[str]) -> ahocorasick.Automaton:
    """Finds the places in `words` of all that occur in a text."""
    made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, w in enumerate(words):
        made.add_word(w, i)
    if words:
        made.make_automaton()
    return made


def _of_worker(key: str, words: list[str]) -> ahocorasick.Automaton:
    if key not in _automata:
        while len(_automata) >= KEPT:
            _automata.pop(next(iter(_automata)))
        _automata[key] = automaton(words)
    return _automata[key]


def rule_groups(rules: DataFrame, rule: str = "rule", most: int = GROUP_RULES, chars: int = GROUP_CHARS) -> Iterator[list[str]]:
    """The distinct, non-empty rules in groups of bounded size; one group if they fit."""
    words = rules.select(F.col(rule).alias("w")).filter("w <> ''").distinct()
    n, size = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("w")), F.lit(0))).first()
    groups = max(1, -(-n // most), -(-size // chars))
    if groups > 1:
        words = cut_lineage(words)
    for g in range(groups):
        part = words if groups == 1 else words.filter(F.pmod(F.xxhash64("w"), F.lit(groups)) == g)
        yield sorted(r["w"] for r in part.collect())


def _shared(spark: SparkSession, words: list[str]):
    """A name for the list, and the list as a broadcast; its size is bounded by `rule_groups`."""
    ship_package(spark)
    return uuid.uuid4().hex, spark.sparkContext.broadcast(words)


def contained(texts: DataFrame, text: str, key: str, words: list[str], rule: str = "rule") -> DataFrame:
    """(key, rule) for every one of `words` that a row's text contains, once per row."""
    narrow = texts.select(F.col(key), F.col(text).cast("string").alias("text"))
    name, shared = _shared(texts.sparkSession, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        found = _of_worker(name, names)
        told = pa.array(names, pa.string())

        def out(b: pa.RecordBatch, rows: array, which: array) -> pa.RecordBatch:
            at, of = (pa.array(np.frombuffer(x, np.int64)) for x in (rows, which))
            return pa.RecordBatch.from_arrays([b.column(0).take(at), told.take(of)], [key, rule])

        for b in pieces(batches, 1):
            rows, which = array("q"), array("q")
            for i, t in enumerate(b.column(1)):
                if names and (t := t.as_py()):
                    hits = {v for _, v in found.iter(t)}
                    rows.extend([i] * len(hits))
                    which.extend(hits)
                    if len(which) >= HITS:
                        yield out(b, rows, which)
                        rows, which = array("q"), array("q")
            yield out(b, rows, which)

    schema = narrow.select(key).schema.add(rule, "string")
    return narrow.mapInArrow(run, schema)


def without_hits(df: DataFrame, text, words: list[str]) -> DataFrame:
    """Rows of `df` whose `text` (a column expression) contains none of `words`; a null text contains none."""
    made = spare(df) + "text"
    name, shared = _shared(df.sparkSession, words)
    columns, width = df.columns, len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _of_worker(name, shared.value)
        for b in pieces(batches, width):
            free = [not t or not shared.value or next(found.iter(t), None) is None for t in b.column(width).to_pylist()]
            kept = pa.RecordBatch.from_arrays([b.column(i) for i in range(width)], names=columns)
            yield kept.filter(pa.array(free, pa.bool_()))

    return df.withColumn(made, text.cast("string")).mapInArrow(run, df.schema)
