"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings.

DataFrame functions only. Patterns give spans per kind, leftmost and without
overlap. A candidate is a long run of key characters; its character class sets
the entropy that a window of `WINDOW` characters must reach. Counts and entropy
are updated by the character that enters and the one that leaves. The span goes
from the first to the last window that reaches it, unless an allow-list rule
takes the candidate for harmless or the span touches a pattern's span.

Positions count code points, ends are exclusive. All work is linear in the text
and its matches: no pattern repeats a repeat, spans come from running sums, and
redaction cuts pieces by place. Defined cases: null and empty texts have no spans;
repeated rows are scanned alike; extra columns pass through whatever their
names, but `scan` replaces those named like a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.functions.text import let, spare
from crawlframe.llm.common import cols, query, running, running_sums, table, without


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = ("(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
          + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Kinds in their order: pattern, group whose length counts, least length, texts that must occur.
KINDS = {
    "assign": (ASSIGN, 2, 6, (":", "=")),
    "access": ("AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    # Runs are maximal, so asking for 24 in the pattern drops the same short runs.
    "hex": ("[0-9a-f]{24,}", 0, 24, ()),
}
WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
#: Character classes in the order of their test: (name, pattern, bits a window must reach).
CLASSES = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", 2.97),
    ("letters", "^[A-Za-z]+$", 3.93),
    ("mixed", "", 3.53),
)
#: Harmless candidates: words in one case, paths or identifiers made of words, sample values.
ALLOW = (
    "^([a-z]+|[A-Z]?[a-z]+|[A-Z]+)$",
    "^[/_-]*([A-Za-z]?[a-z]*[/_-]+)+([A-Za-z]?[a-z]*)$",
    "(?i)example|sample|placeholder|lorem|abcdefgh|12345678",
)
#: Tells the reader of UTF-32 the order of bytes, so that a mark in the text is not taken for it.
BIG_ENDIAN = b"\x00\x00\xfe\xff"
MADE = ["base_spans", "entropy_spans"]
SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def _placed(found: str, pieces: str, ok, rank: int, kind: str) -> Column:
    """Spans of matches from the lengths of the matches and of the text between them."""
    steps = F.transform(found, lambda m, i: F.col(pieces)[i] + F.length(m))

    def spans(before: Column) -> Column:
        every = F.transform(found, lambda m, i: F.struct(
            (before[i] + F.col(pieces)[i]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
            (before[i] + F.col(pieces)[i] + F.length(m)).alias("end"), ok(i).alias("ok")))
        return F.transform(F.filter(every, lambda s: s["ok"]), lambda s: F.struct(
            s["start"], s["rank"], s["kind"], s["end"]))

    return F.when(F.size(found) == 0, F.expr(f"cast(array() as {SPAN})")).otherwise(
        let(running_sums(steps), spans).cast(SPAN))


def _harmless(c: Column) -> Column:
    """Whether an allow-list rule takes `c`; each test is one run over it, without repeats inside repeats."""
    words_ = c.rlike("^[A-Za-z/_-]+$") & c.rlike("[/_-]") & ~c.rlike("[A-Za-z][A-Z]")
    return c.rlike(ALLOW[0]) | words_ | c.rlike(ALLOW[2])


def _free(spans: Column, base: Column) -> Column:
    """The indices of those of the sorted, disjoint `spans` that touch none of the `base` spans.

    All are sorted by start: a span is hit if a base span before it ends behind
    its start, or the next base span starts before its end.
    """
    far = 1 << 62
    events = F.array_sort(F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(-1).alias("at"), b["end"].alias("end"))),
        F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.cast("int").alias("at"), s["end"].alias("end")))))

    def told(e: Column) -> Column:
        ends = F.transform(e, lambda v: F.when(v["at"] < 0, v["end"]).otherwise(0).cast("bigint"))
        starts = F.reverse(F.transform(e, lambda v: F.when(v["at"] < 0, v["start"]).otherwise(far).cast("bigint")))
        both = F.struct(running(ends, F.greatest, 0).alias("before"), F.reverse(running(starts, F.least, far)).alias("after"))
        return let(both, lambda r: F.transform(F.filter(F.transform(e, lambda v, i: F.struct(
            v["at"].alias("at"), ((r["before"][i] <= v["start"]) & (r["after"][i] >= v["end"])).alias("free"))),
            lambda v: (v["at"] >= 0) & v["free"]), lambda v: v["at"]))

    return F.when(F.size(base) == 0, F.transform(spans, lambda s, i: i.cast("int"))).otherwise(let(events, told))


def _window_span(c: Column) -> Column:
    """(first, last) of the windows of candidate `c` that reach the entropy of its class; 0, 0 if none.

    Characters are numbered by their place in the candidate's own alphabet, so
    the counts are a short array, updated in one pass per character.
    """
    w = WINDOW
    table_ = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(w + 1)])
    f = lambda n: F.element_at(table_, n + 1)
    limit = F.lit(CLASSES[-1][2])
    for _, pattern, bits in reversed(CLASSES[:-1]):
        limit = F.when(c.rlike(pattern), bits).otherwise(limit)

    def scan(idx: Column, size: Column, least: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            x = F.element_at(idx, i)
            y = F.when(i > w, F.element_at(idx, F.greatest(i - w, F.lit(1)))).otherwise(0)
            cx = F.element_at(acc["n"], x)
            cy = F.when(y > 0, F.element_at(acc["n"], F.greatest(y, F.lit(1)))).otherwise(0)
            s = F.when(x == y, acc["s"]).otherwise(
                acc["s"] + f(F.least(cx + 1, F.lit(w))) - f(cx) + f(F.greatest(cy - 1, F.lit(0))) - f(cy))
            n = F.transform(acc["n"], lambda v, j: v + (j + 1 == x).cast("int") - (j + 1 == y).cast("int"))
            # The window's entropy is log2(w) - s / w, so a low s is a high entropy.
            hit = (i >= w) & (F.lit(math.log2(w)) - s / w >= least)
            first = F.when(hit & (acc["first"] == 0), i - w + 1).otherwise(acc["first"])
            return F.struct(n.alias("n"), s.alias("s"), first.alias("first"),
                            F.when(hit, i).otherwise(acc["last"]).alias("last"))

        zero = F.struct(F.transform(F.sequence(F.lit(1), size), lambda _: F.lit(0)).alias("n"),
                        F.lit(0.0).alias("s"), F.lit(0).alias("first"), F.lit(0).alias("last"))
        return F.aggregate(F.sequence(F.lit(1), F.size(idx)), zero, step,
                           lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    chars = F.regexp_extract_all(c, F.lit("."), F.lit(0))
    none = F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"))
    one = F.array(F.struct(chars.alias("c"), F.array_distinct(chars).alias("d"), limit.alias("least")))
    two = F.transform(one, lambda o: F.struct(
        F.transform(o["c"], lambda ch: F.array_position(o["d"], ch).cast("int")).alias("idx"),
        F.size(o["d"]).alias("size"), o["least"].alias("least")))
    # So few different characters cannot reach the limit in any window.
    return F.element_at(F.transform(two, lambda o: F.when(F.log2(o["size"]) < o["least"] - 1e-6, none).otherwise(
        scan(o["idx"], o["size"], o["least"]))), 1)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with base_spans and entropy_spans: sorted arrays of (start, rank, kind, end)."""
    keep = without(docs, MADE)
    p = spare(docs)
    whole = F.coalesce(*cols([text]), F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    patterns = {k: (v[0], v[3]) for k, v in KINDS.items()} | {"entropy": (CANDIDATE, ())}
    out = docs.select(*cols(keep), whole.alias(f"{p}t"))
    found = []
    for k, (pattern, need) in patterns.items():
        all_ = F.regexp_extract_all(f"{p}t", F.lit(pattern), F.lit(0))
        if need:
            there = F.col(f"{p}t").contains(need[0])
            for n in need[1:]:
                there = there | F.col(f"{p}t").contains(n)
            all_ = F.when(there, all_).otherwise(none)
        found.append(all_.alias(f"{p}m_{k}"))
    out = out.select("*", *found)
    between = [
        F.when(F.size(f"{p}m_{k}") > 0, F.transform(F.split(f"{p}t", pattern, -1), lambda x: F.length(x).cast("bigint")))
        .otherwise(F.expr("cast(array() as array<bigint>)")).alias(f"{p}p_{k}")
        for k, (pattern, _) in patterns.items()]
    assign = F.when(F.size(f"{p}m_assign") > 0, F.regexp_extract_all(f"{p}t", F.lit(ASSIGN), F.lit(2))).otherwise(none)
    out = out.select("*", *between, assign.alias(f"{p}g_assign"))
    base = []
    for rank, (k, (_, group, least, _)) in enumerate(KINDS.items()):
        told = F.col(f"{p}g_assign" if group else f"{p}m_{k}")
        base.append(_placed(f"{p}m_{k}", f"{p}p_{k}", lambda i, told=told, least=least: F.length(told[i]) >= least, rank, k))
    out = out.select(*cols(keep), f"{p}m_entropy", F.array_sort(F.concat(*base)).alias("base_spans"), _placed(
        f"{p}m_entropy", f"{p}p_entropy", lambda i: F.lit(True), len(KINDS), "entropy").alias(f"{p}placed"))
    texts, places = F.col(f"{p}m_entropy"), F.col(f"{p}placed")
    raw = F.transform(F.filter(_free(places, F.col("base_spans")), lambda i: ~_harmless(texts[i])), lambda i: F.struct(
        places[i].alias("p"), _window_span(texts[i]).alias("w")))
    spans = F.transform(F.filter(raw, lambda r: r["w"]["last"] > 0), lambda r: F.struct(
        (r["p"]["start"] + r["w"]["first"] - 1).alias("start"), r["p"]["rank"].alias("rank"),
        r["p"]["kind"].alias("kind"), (r["p"]["start"] + r["w"]["last"]).alias("end")))
    spans = F.when(F.size(texts) == 0, F.expr(f"cast(array() as {SPAN})")).otherwise(spans.cast(SPAN))
    return out.select(*cols(keep), "base_spans", spans.alias("entropy_spans"))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", length: str | None = "n_chars") -> DataFrame:
    """`docs` with every span (overlapping ones as one) replaced by `mark`; clean texts stay as they are.

    A column named `length` gets the new text's length where something was replaced.
    """
    p = spare(docs)
    (whole,) = cols([text])
    own = docs.select("*", F.struct("*").alias(f"{p}given"))
    found = scan(own, text)
    spans = F.col(f"{p}s")

    def cut(given_: Column) -> Column:
        ends, raw = given_["ends"], given_["raw"]

        def piece(start: Column, size: Column) -> Column:
            """Code points of the text by their place, at the cost of the piece alone."""
            own = F.substr(raw, (start * 4 + 1).cast("int"), (size * 4).cast("int"))
            return F.decode(F.concat(F.lit(bytearray(BIG_ENDIAN)), own), "UTF-32")

        parts = F.transform(spans, lambda s, i: F.when(s["start"] >= ends[i], F.concat(
            piece(ends[i], s["start"] - ends[i]), F.lit(mark))).otherwise(""))
        last = F.greatest(F.element_at(spans, -1)["end"], F.element_at(ends, -1))
        return F.concat(F.array_join(parts, ""), piece(last, F.octet_length(raw) / 4 - last))

    out = found.select(f"{p}given", F.array_sort(F.concat("base_spans", "entropy_spans")).alias(f"{p}s"), whole.alias(f"{p}t"))
    # Bound by `let`, the bytes are held once; read from a row, they would be copied for each piece.
    held = F.struct(running(F.transform(spans, lambda s: s["end"]), F.greatest, 0).alias("ends"),
                    F.encode(f"{p}t", "UTF-32").alias("raw"))
    done = F.when(F.size(spans) == 0, F.col(f"{p}t")).otherwise(let(held, cut))
    out = out.select(f"{p}given", f"{p}s", done.alias(f"{p}d"))
    new = {text: F.col(f"{p}d")}
    given = F.col(f"{p}given")
    if length and length in docs.columns:
        new[length] = F.when(F.size(spans) == 0, given[length]).otherwise(F.length(f"{p}d").cast(docs.schema[length].dataType))
    return out.select(*[new.get(c, given[c]).alias(c) for c in docs.columns])


def _sql() -> str:
    """The same spans in SQL; windows are counted anew instead of step by step."""
    q = lambda s: s.replace("'", "''")
    part = """SELECT rid, '{k}' AS kind, {r} AS rank, regexp_extract_all(t, '{p}', 0) AS m,
      regexp_extract_all(t, '{p}', {g}) AS g, string_split_regex(t, '{p}') AS b, {n} AS least FROM d"""
    parts = [part.format(k=k, r=r, p=q(p), g=g, n=n) for r, (k, (p, g, n, _)) in enumerate(KINDS.items())]
    parts.append(part.format(k="entropy", r=len(KINDS), p=CANDIDATE, g=0, n=WINDOW))
    limit = "CASE " + " ".join(f"WHEN regexp_matches(c, '{p}') THEN {b}" for _, p, b in CLASSES[:-1]) + (
        f" ELSE {CLASSES[-1][2]} END")
    allow = " OR ".join(f"regexp_matches(c, '{a}')" for a in ALLOW)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f),
s AS (SELECT rid, kind, rank, m[i] AS c, list_sum([length(x) for x in b[1:i]])
        + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS st FROM i WHERE length(g[i]) >= least),
base AS (SELECT rid, kind, rank, CAST(st AS BIGINT) AS st, CAST(st + length(c) AS BIGINT) AS en
         FROM s WHERE kind <> 'entropy'),
cand AS (SELECT * FROM s WHERE kind = 'entropy' AND NOT ({allow}) AND NOT EXISTS (
  SELECT 1 FROM base WHERE base.rid = s.rid AND base.st < s.st + length(s.c) AND s.st < base.en)),
win AS (SELECT rid, rank, st, c, j, substr(c, j, {WINDOW}) AS x
        FROM (SELECT *, unnest(range(1, length(c) - {WINDOW - 2})) AS j FROM cand)),
ent AS (SELECT *, list_sum([-(length(x) - length(replace(x, u, ''))) / {WINDOW}.0
          * log2((length(x) - length(replace(x, u, ''))) / {WINDOW}.0)
          for u in list_distinct(string_split(x, ''))]) AS h FROM win),
entropy AS (SELECT rid, 'entropy' AS kind, rank, CAST(st + min(j) - 1 AS BIGINT) AS st,
  CAST(st + max(j) + {WINDOW - 1} AS BIGINT) AS en FROM ent WHERE h >= {limit} GROUP BY rid, rank, st),
every AS (SELECT * FROM base UNION ALL SELECT * FROM entropy),
told AS (SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k,
  count(*) FILTER (kind = 'hex') AS h,
  string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, rank) FILTER (kind <> 'entropy') AS bs,
  string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, rank) AS sp FROM every GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(bs, '')) AS base_sha256, coalesce(sp, '') AS spans
FROM d LEFT JOIN told USING (rid)"""


@query("op8_secrets", sql=_sql())
def op8(spark, d) -> DataFrame:
    found = scan(table(spark, d, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(_told(F.col("base_spans")), 256).alias("base_sha256"),
        _told(F.array_sort(F.concat("base_spans", "entropy_spans"))).alias("spans"))
