"""Mixing sources to target weights by hierarchical budgets.

The token budget goes down a tree (domain, language, source). At each node it
is shared among the children by weight; a child that cannot use its share (its
tokens times the epochs allowed) takes what it has, and its siblings share the
rest. A node never gets more than its subtree holds, so a shortage leaves the
family only when all siblings are full. A leaf takes its documents in seeded
order, epoch after epoch, up to the document with which its budget is reached.

DataFrame functions only, whole numbers throughout. Decisions need no sort of a
leaf: hash buckets of bounded size are summed, all before the budget's bucket
are in, all behind it are out, and only that bucket's rows are put in order.

Defined cases: a null text has no tokens, a null level name counts as empty; a
weight of zero or less takes nothing; a leaf without tokens takes nothing; rows
repeated as they are count each, in one bucket; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlframe.llm.common import WORD, given, query, restored, table, without
from crawlframe.session import cut_lineage

#: Rows that one bucket of a leaf should hold, and leaves up to which their plan is broadcast.
BUCKET, LEAVES = 20_000, 100_000
LEVELS = ("domain", "lang", "source")
WEIGHTS = {
    "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
    "source": {},
}
SEED = 42
#: Names of the results.
MADE = ["__domain", "__epoch", "__tokens"]


def domain_of(source: Column) -> Column:
    """Domain of a source: by its number modulo four, d0 if it has none."""
    digits = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})", 1)
    return F.concat(F.lit("d"), F.when(digits == "", 0).otherwise(digits.cast("bigint") % 4).cast("string"))


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(f"__{level}") == name, w).otherwise(out)
    return out.cast("bigint")


def _share(nodes: DataFrame, parents: list[str], child: str) -> DataFrame:
    """`alloc` of each child from the parent's `budget` and the children's `cap` and `w`."""
    p = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    by = p.orderBy(F.col("cap").cast("double") / F.col("w"), child)
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(by.rowsBetween(W.currentRow, W.unboundedFollowing))
    full = (F.col("cap") * F.col("rest") <= F.col("w") * (F.col("budget") - F.col("before")))
    marked = nodes.where("w > 0").withColumn("before", before).withColumn("rest", rest).withColumn("full", full)
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(p), F.lit(0))
    open_ = F.sum(F.when(~F.col("full"), F.col("w"))).over(p)
    marked = marked.withColumn("taken", taken).withColumn("open_", open_)
    alloc = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(w * (budget - taken)) div open_"))
    return marked.withColumn("alloc", F.greatest(alloc, F.lit(0))).drop("before", "rest", "full", "taken", "open_")


def budgets(leaves: DataFrame, weights: dict, share: float, epochs: int) -> DataFrame:
    """`leaves` (levels, tokens) with alloc: the leaf's part of `share` of all tokens."""
    keys = [f"__{n}" for n in LEVELS]
    caps = leaves
    for n in LEVELS:
        caps = caps.withColumn(f"w_{n}", _weight(n, weights))
    usable = F.least(*[F.col(f"w_{n}") for n in LEVELS]) > 0
    caps = caps.withColumn("cap", F.when(usable, F.col("tokens") * epochs).otherwise(0))
    whole = caps.agg(F.least(F.floor(F.sum("tokens") * share), F.sum("cap")).cast("bigint").alias("budget"))
    up = whole  # one row
    for depth, n in enumerate(LEVELS, 1):
        nodes = caps.groupBy(*keys[:depth]).agg(
            F.sum("cap").alias("cap"), F.first(f"w_{n}").alias("w"), F.sum("tokens").alias("tokens"))
        joined = nodes.join(up, keys[:depth - 1]) if depth > 1 else nodes.join(F.broadcast(up))
        shared = _share(joined, keys[:depth - 1], keys[depth - 1])
        up = shared.select(*keys[:depth], F.col("alloc").alias("budget"),
                           *([F.col("tokens")] if depth == len(LEVELS) else []))
    return up.withColumnRenamed("budget", "alloc")


def mix(docs: DataFrame, weights: dict = WEIGHTS, share: float = 0.6, epochs: int = 4, seed: int = SEED,
        doc_id: str = "doc_id", text: str = "text", domain: Column | None = None, lang: str = "lang",
        source: str = "source") -> DataFrame:
    """One row per document and epoch that is taken: the columns of `docs`, and __domain, __epoch, __tokens.

    Columns of `docs` may have any name; those named like a result are replaced.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    keys = [f"__{n}" for n in LEVELS]
    keep = without(docs, MADE)
    rows = docs.select(
        given(docs, keep), name(domain_of(F.col(source)) if domain is None else domain).alias("__domain"),
        name(F.col(lang)).alias("__lang"), name(F.col(source)).alias("__source"),
        token_count(F.col(text)).alias("__tokens"))
    id_ = F.col("__given")[doc_id].cast("string")
    slim = rows.select(*keys, "__tokens", id_.alias("__id"))
    leaves = cut_lineage(slim.groupBy(*keys).agg(F.sum("__tokens").alias("tokens"), F.count(F.lit(1)).alias("n")))
    n, most = leaves.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    sent = F.broadcast if n <= LEAVES else (lambda x: x)
    digits = 1
    while digits < 8 and most > BUCKET * 16 ** digits:
        digits += 1
    plan = budgets(leaves.select(*keys, "tokens"), weights, share, epochs).where("tokens > 0 AND alloc > 0")
    plan = cut_lineage(plan.select(*keys, F.expr("alloc div tokens").alias("__full"),
                                   F.expr("alloc % tokens").alias("__part")))

    def order(id_: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(seed), F.col("__full"), F.coalesce(id_, F.lit(""))))

    parts = slim.join(sent(plan.where("__part > 0")), keys).select(
        *keys, "__part", "__tokens", order(F.col("__id")).substr(1, digits).alias("__bucket"))
    sums = parts.groupBy(*keys, "__part", "__bucket").agg(F.sum("__tokens").alias("t"))
    along = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = sums.withColumn("upto", F.sum("t").over(along)).where(
        "upto >= __part AND upto - t < __part").groupBy(*keys).agg(
        F.min(F.struct("__bucket", (F.col("upto") - F.col("t")).alias("__before"))).alias("e"))
    plan = cut_lineage(plan.join(edge.select(*keys, F.col("e.__bucket").alias("__edge"),
                                             F.col("e.__before").alias("__before")), keys, "left"))

    met = rows.join(sent(plan), keys)
    key = order(id_)
    copies = F.sequence(F.lit(0).cast("bigint"), F.col("__full") - 1)
    inside = met.withColumn("__key", key).withColumn("__bucket", F.col("__key").substr(1, digits))
    whole = F.when(F.col("__full") > 0, copies).otherwise(F.expr("cast(array() as array<bigint>)"))
    sure = inside.withColumn("__epoch", F.explode(F.concat(whole, F.when(
        F.col("__bucket") < F.col("__edge"), F.array("__full")).otherwise(F.expr("cast(array() as array<bigint>)")))))
    w = W.partitionBy(*keys, "__bucket").orderBy("__key", F.xxhash64(F.col("__given")[text])).rowsBetween(
        W.unboundedPreceding, W.currentRow)
    last = inside.where(F.col("__bucket") == F.col("__edge")).withColumn(
        "__start", F.col("__before") + F.sum("__tokens").over(w) - F.col("__tokens")).where(
        "__start < __part").withColumn("__epoch", F.col("__full"))
    out = [*restored(keep), *[F.col(c) for c in MADE]]
    return sure.select(*out).unionByName(last.select(*out))


def _sql(share: float = 0.6, epochs: int = 4) -> str:
    def case(level):
        given = WEIGHTS[level]
        return "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in given.items()) + " ELSE 1 END" \
            if given else "1"

    def level(depth):
        keys, ups = LEVELS[:depth], LEVELS[:depth - 1]
        child, p = LEVELS[depth - 1], ", ".join(ups) or "1"
        join = f"JOIN l{depth - 1} u USING ({', '.join(ups)})" if ups else "CROSS JOIN whole u"
        budget = "u.alloc" if ups else "u.budget"
        return f"""
l{depth} AS (SELECT *, CASE WHEN sat THEN cap ELSE (w * (budget - coalesce(sum(cap) FILTER (sat) OVER (PARTITION BY {p}), 0)))
    // (sum(w) FILTER (NOT sat) OVER (PARTITION BY {p})) END AS alloc
  FROM (SELECT *, cap * sum(w) OVER (PARTITION BY {p} ORDER BY cap::DOUBLE / w, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= w * (budget - coalesce(sum(cap) OVER (PARTITION BY {p} ORDER BY cap::DOUBLE / w, {child}
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS sat
  FROM (SELECT n.*, {budget} AS budget FROM (SELECT {', '.join(keys)}, sum(t) * {epochs} AS cap, sum(t) AS t, {case(child)} AS w
        FROM leaf GROUP BY {', '.join(keys)}) n {join})))"""

    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, 'd' || (coalesce(
    try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})', 1) AS BIGINT), 0) % 4) AS domain,
  CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS n, text FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS t FROM d GROUP BY ALL),
whole AS (SELECT least(floor(sum(t) * {share})::BIGINT, sum(t) * {epochs}) AS budget FROM leaf),{level(1)},{level(2)},{level(3)},
plan AS (SELECT domain, lang, source, alloc // t AS ful, alloc % t AS part FROM l3 WHERE t > 0 AND alloc > 0),
m AS (SELECT d.*, ful, part, md5({SEED} || ':' || ful || ':' || coalesce(doc_id::VARCHAR, '')) AS k
      FROM d JOIN plan USING (domain, lang, source)),
o AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id) - n AS st FROM m),
r AS (SELECT *, unnest(range(CAST(ful + CASE WHEN st < part THEN 1 ELSE 0 END AS BIGINT))) AS epoch FROM o)
SELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch, n AS n_tokens FROM r"""


@query("op3_mixing", sql=_sql())
def op3(spark, d) -> DataFrame:
    taken = mix(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))
    return taken.select("doc_id", F.col("__domain").alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"),
                        F.coalesce("source", F.lit("")).alias("source"), F.col("__epoch").alias("epoch"),
                        F.col("__tokens").alias("n_tokens"))
