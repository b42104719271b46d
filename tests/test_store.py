"""Stored state: rule automaton, visited set, bucketed frontier, live rows, contained search."""

import random
import re
import subprocess
import sys
from datetime import datetime, timedelta, timezone

import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from crawlframe.operators import frontier as FR
from crawlframe.operators import graph as G
from crawlframe.operators import grams, lookup, matching
from crawlframe.operators.visited import Visited
from crawlframe.plans import q_stream
from crawlframe.schemas import CRAWL_LOG, URLS
from crawlframe.session import cut_lineage, scratch
from crawlframe.sources.frontier_store import FrontierStore
from crawlframe.streaming import live


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- many rules ----------------------------------------------------------------------


def test_a_hundred_thousand_rules(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdeé矿") for _ in range(rnd.randrange(1, 10)))
    rules = {word() for _ in range(260_000)}
    assert len(rules) > 100_000
    texts = [(i, " ".join(word() for _ in range(rnd.randrange(40)))) for i in range(60)] + [(90, None), (91, ""), (90, "abc")]
    df = spark.createDataFrame(texts, "k int, t string")
    table = spark.createDataFrame([(r,) for r in rules] + [("",), (None,)], "rule string")
    got = [(r.k, r.rule) for r in lookup.substring_matches(df, "t", "k", table).collect()]
    want = {(k, t[i:j]) for k, t in texts if t for i in range(len(t)) for j in range(i + 1, min(i + 10, len(t) + 1)) if t[i:j] in rules}
    assert len(got) == len(set(got)) and set(got) == want


def test_rules_do_not_move_or_multiply_texts(spark):
    df = spark.range(100).select("id", F.concat(F.lit("text "), "id").alias("t"), F.lit(1).alias("__text"))
    table = spark.range(500).select(F.concat(F.lit("t "), "id").alias("rule"))
    out = lookup.drop_blacklisted(df, "t", table)
    assert out.count() == 0 and out.columns == df.columns
    plan = plan_of(out)
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan and "Generate" not in plan
    plan = plan_of(lookup.substring_matches(df, "t", "id", table))
    assert "Join" not in plan and "Generate" not in plan and plan.count("Exchange") == 1  # the found pairs, made distinct


def test_rules_in_groups_give_the_same(spark, monkeypatch):
    df = spark.range(50).select("id", F.concat(F.lit("x"), "id").alias("t"))
    table = spark.range(30).select(F.concat(F.lit("x"), "id").alias("rule"))
    whole = sorted(map(tuple, lookup.substring_matches(df, "t", "id", table, inline_rules=0).collect()))
    monkeypatch.setattr(matching.rule_groups, "__defaults__", ("rule", 7, 1 << 20))
    assert len(list(matching.rule_groups(table))) == 5
    assert sorted(map(tuple, lookup.substring_matches(df, "t", "id", table, inline_rules=0).collect())) == whole
    assert lookup.drop_blacklisted(df, "t", table, inline_rules=0).count() == 0


# --- visited set -----------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_levels_over_the_stored_set(spark, kind):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(700)]
    df = spark.createDataFrame(edges, "src long, dst long").select(F.col("src").cast(kind), F.col("dst").cast(kind))
    seeds = spark.createDataFrame([(1,), (2,), (2,)], "node long").select(F.col("node").cast(kind))
    rows = lambda out: sorted((str(r.node), str(r.source), r.depth) for r in out.collect())
    one = rows(G.expand(df, seeds, 6, stored=False))
    two = rows(G.expand(df, seeds, 6, stored=True))
    assert one == two and len(one) > 100
    assert not [t for t in spark.catalog.listTables() if "visited" in t.name]


def test_no_level_moves_the_stored_set(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        seen = Visited(spark, 60_000, 4)
        seen.add(cut_lineage(spark.range(10_000).select(F.col("id").alias("node"))))
        asked = cut_lineage(spark.range(9_000, 12_000).select(F.col("id").alias("node")))
        flagged = seen.flagged(seen.dealt(asked))
        plan = plan_of(flagged)
        assert plan.count("Exchange") == 1  # the candidates; the filter's words come in their buckets
        hits = flagged.groupBy("maybe").count().collect()
        assert {r["maybe"]: r["count"] for r in hits}[True] in range(1_000, 1_200)
        maybe = flagged.filter("maybe").drop("maybe")
        plan = plan_of(seen.lookup(cut_lineage(maybe).repartition(4, "slot"), [0, 3]))
        assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan
        assert re.search(r"PartitionFilters: \[[^\]]*part", plan)
        fresh = seen.unseen(seen.dealt(asked))
        assert sorted(r.node for r in fresh.collect()) == list(range(10_000, 12_000))
        seen.close()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# --- bucketed frontier ---------------------------------------------------------------------

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def frontier(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("https://x/"), "id").alias("url"), F.lit(None).cast("string").alias("source_url"),
        F.when(F.col("id") % 5 == 0, "crawling").otherwise("pending").alias("status"), F.lit(1).alias("depth"),
        F.lit("t").alias("title"), F.lit(None).cast("string").alias("html_file_path"), F.lit(T0).alias("created_time"),
        F.lit(None).cast("timestamp").alias("crawled_time"), F.lit(None).cast("string").alias("error_message"))


def marks(spark, urls):
    return spark.createDataFrame([(u, 1, "success", "new", None, None, T0) for u in urls],
                                 "url string, seq long, op string, title string, html_file_path string, error_message string, ts timestamp")


def test_store_rewrites_changed_buckets_only(spark):
    s = FrontierStore.create(spark, scratch(spark, "store"), frontier(spark, 2_000), 16)
    whole = s.written_bytes(0)
    v = s.apply_updates(marks(spark, ["https://x/7", "https://unknown/"]))
    assert v == 1 and 0 < s.written_bytes(1) < whole / 8
    assert s.manifest().count() == 16 and s.read().count() == 2_000
    assert s.read().filter("title = 'new'").select("url").collect() == [("https://x/7",)]
    assert s.read(0).filter("title = 'new'").count() == 0  # the older version stays
    # Changes that touch nothing write nothing.
    assert s.apply_updates(marks(spark, ["https://unknown/"])) == 1
    known = spark.createDataFrame([("https://x/1", "https://s/", 1)], "url string, source_url string, depth int")
    assert s.add_urls(known, F.lit(T0)) == 1 and s.versions() == [0, 1]
    fresh = spark.createDataFrame([("https://y/1", "https://s/", 2), ("https://y/1", "https://r/", 1)], known.schema)
    assert s.add_urls(fresh.unionByName(known), F.lit(T0)) == 2
    row = s.read().filter("url = 'https://y/1'").first()
    assert (row.source_url, row.depth, row.status) == ("https://r/", 1, "pending") and s.read().count() == 2_001
    assert s.reset_stale(F.lit(T0 + timedelta(hours=2))) == 3
    assert s.read().filter("status = 'crawling'").count() == 0
    assert FrontierStore(spark, s.root).read().count() == 2_001


def test_kept_figures_follow_the_changes(spark):
    from crawlframe.operators import reports as RP

    s = FrontierStore.create(spark, scratch(spark, "store"), frontier(spark, 300), 8)

    def check():
        rows = s.read()
        assert sorted(map(tuple, s.status_counts().collect())) == sorted(map(tuple, RP.status_counts(rows).collect()))
        assert sorted(map(tuple, s.daily_stats().collect())) == sorted(map(tuple, RP.daily_stats(rows).collect()))
        assert s.frontier_stats().first() == RP.frontier_stats(rows).first()

    check()
    s.apply_updates(marks(spark, [f"https://x/{i}" for i in range(0, 300, 7)]))
    check()
    s.add_urls(spark.createDataFrame([("https://y/1", "https://s/", 1)], "url string, source_url string, depth int"), F.lit(T0 + timedelta(days=3)))
    s.reset_stale(F.lit(T0 + timedelta(hours=2)))
    check()
    assert s.frontier_stats(0).first().success == 0  # the older version keeps its own


def test_store_ignores_unfinished_versions(spark):
    s = FrontierStore.create(spark, scratch(spark, "store"), frontier(spark, 100), 4)
    s._write(1, s._placed(frontier(spark, 5)))  # a writer that died before its manifest
    assert s.versions() == [0] and s.read().count() == 100
    assert s.apply_updates(marks(spark, ["https://x/1"])) == 1 and s.read().count() == 100
    with pytest.raises(Exception, match="(?i)already exists"):
        s._commit(1, s.manifest(0), None)


def test_empty_store(spark):
    s = FrontierStore.create(spark, scratch(spark, "store"), None, 4)
    assert s.read().count() == 0 and s.versions() == [0]
    assert s.apply_updates(marks(spark, ["https://x/1"])) == 0
    one = spark.createDataFrame([("https://y/1", "https://s/", 2)], "url string, source_url string, depth int")
    assert s.add_urls(one, F.lit(T0)) == 1 and s.read().count() == 1
    assert s.import_rows(frontier(spark, 3).withColumn("n", F.lit(1)), "n") == 2 and s.read().count() == 4
    assert s.read().schema.names == URLS.names


# --- live rows --------------------------------------------------------------------------------


def log_row(seq, hours, url, op, title=None):
    return (seq, T0 + timedelta(hours=hours), url, op, 0, "s", title, None, "bad" if op == "failed" else None)


def run_live(spark, batches, **kw):
    path, out = scratch(spark, "log"), scratch(spark, "live")
    for rows in batches:
        spark.createDataFrame(rows, CRAWL_LOG).coalesce(1).write.mode("append").parquet(path)
    q = live.stream_live(spark.readStream.schema(CRAWL_LOG).option("maxFilesPerTrigger", 1).parquet(path), out,
                         scratch(spark, "ckpt"), **kw)
    q.awaitTermination()
    assert q.exception() is None
    return out


def test_stale_rows_fall_back_by_timer(spark):
    batches = [
        [log_row(1, 0, "a", "add"), log_row(2, 0.1, "a", "crawling"), log_row(3, 0, "b", "add"), log_row(4, 0, "edge", "add"),
         log_row(5, 0, "edge", "crawling"), log_row(6, 0, "done", "add"), log_row(7, 0.2, "done", "crawling")],
        [log_row(8, 0.3, "done", "success", "T"), log_row(9, 1, "b", "crawling"), log_row(10, 1, "late", "add")],
        [log_row(11, 2, "x", "add")],
    ]
    # The watermark ends at the second hour; the first two are stale then, `late` is not marked.
    out = run_live(spark, batches, delay="0 seconds")
    rows = {r.url: r for r in live.read_live(spark, out).collect()}
    assert {u: r.status for u, r in rows.items()} == {
        "a": "pending", "b": "pending", "edge": "pending", "done": "success", "late": "pending", "x": "pending"}
    assert rows["done"].title == "T"
    told = spark.read.parquet(out).filter("url = 'a'").select("status").collect()
    assert sorted(r.status for r in told) == ["crawling", "pending"]  # rows come out when they change, not otherwise


def test_a_row_exactly_at_the_limit_is_not_stale(spark):
    out = run_live(spark, [[log_row(1, 0, "a", "add"), log_row(2, 0, "a", "crawling"), log_row(3, 1, "z", "add")]], delay="0 seconds")
    assert {r.url: r.status for r in live.read_live(spark, out).collect()} == {"a": "crawling", "z": "pending"}


def test_live_rows_equal_the_fold(spark):
    rnd = random.Random(4)
    rows = [log_row(i, i / 100, f"u{rnd.randrange(12)}", rnd.choice(["add", "crawling", "success", "failed"]), rnd.choice(["t", None]))
            for i in range(300)]
    late = sorted(rows, key=lambda r: r[0] + rnd.random() * 40)
    out = run_live(spark, [late[k:k + 75] for k in range(0, 300, 75)], delay="1 hour", stale_hours=1)
    log = spark.createDataFrame(rows, CRAWL_LOG)
    now = max(r[1] for r in rows) - timedelta(hours=1)
    want = FR.reset_stale(FR.fold_log(log), F.lit(now)).drop("was_stale")
    key = lambda df: sorted(map(str, df.select(*FR.FRONTIER_COLUMNS).collect()))
    assert key(live.read_live(spark, out)) == key(want)


# --- contained search ------------------------------------------------------------------------------


def like(pattern, text):
    rx = "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in pattern.lower())
    return text is not None and re.search(rx, text.lower(), re.S) is not None


PATTERNS = ["abc", "abca", "ABCABC", "a%c", "ab", "", "_", "%", "bca_bc", "abcab%cab", "cabcabcabc", "zzz", "c_b%abca", "____________",
            "é矿abc", "aaaa", "aaa", "abcabcab", "bcabcabc", "a\\b", "a.c", "(ab"]


def haystack(spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice(["abc", "ABCA", "bc", "é矿", "a", "aaaa", "\\", "."]) for _ in range(rnd.randrange(9))) for _ in range(150)]
    texts += ["a\\b", "", "abcabcabcabcabc"]
    return [(i, t, None if i % 3 else t[::-1]) for i, t in enumerate(texts)] + [(900, None, None)]


def test_index_search_equals_a_scan(spark):
    rows = haystack(spark)
    df = spark.createDataFrame(rows, "k int, t string, u string")
    index = grams.GramIndex.build(df, "k", ["t", "u"], scratch(spark, "grams"))
    for p in PATTERNS:
        if "\\" in p:
            continue  # an escape in ILIKE itself
        got = sorted(r.k for r in grams.search(df, "k", ["t", "u"], p, index).collect())
        assert got == [k for k, t, u in rows if like(p, t) or like(p, u)], p
    assert index.candidates("ab") is None and index.candidates("zzzz").count() == 0


def test_index_reads_its_pieces_only(spark):
    df = spark.range(50).select("id", F.concat(F.lit("page number "), "id").alias("t"))
    index = grams.GramIndex.build(df, "id", ["t"], scratch(spark, "grams"))
    plan = plan_of(index.candidates("number 1"))
    assert re.search(r"PartitionFilters: \[[^\]]*part", plan) and re.search(r"PushedFilters: \[In\(gram", plan)
    assert grams.search(df, "id", ["t"], "number 1", index).count() == 11


def test_contained_join_equals_every_pair(spark):
    rows = haystack(spark)
    df = spark.createDataFrame(rows, "k int, t string, u string")
    names = spark.createDataFrame([(p,) for p in PATTERNS] * 2 + [(None,)], "p string")
    got = sorted((r.p, r.k) for r in grams.contained_join(names, "p", df, "t").collect())
    assert got == sorted((p, k) for p in PATTERNS for k, t, _ in rows if like(p, t))


def test_contained_join_looks_around_a_shared_piece(spark):
    """Patterns that share only frequent pieces with the texts make no candidates; those at edges and repeats are kept."""
    texts = [f"webpages/{i:08x}_{i}7.html" for i in range(3000)] + [
        "abababababababab", "xabababab", "a\\b12345678", "12345678", "été_1234567é", "ab%cd_efghijkl", "0_12345.html", "q" * 40 + "12345678", None]
    names = [f"stray_{i}7.html" for i in range(1000)] + [
        "abababab", "babababa", "b12345678", "a\\b12345678", "12345678_", "_12345678", "%12345678", "_t__1234567_", "cd_efghijkl",
        "b%cd_efghijkl", "_0_12345.html", "0_12345.html", "q12345678", "q" * 41 + "12345678", "00000b_b_117.html", "0000000b_%17.html"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    told = spark.createDataFrame([(n,) for n in names], "p string")
    got = sorted((r.p, r.t) for r in grams.contained_join(told, "p", df, "t").collect())
    assert got == sorted((n, t) for n in names for t in texts if t is not None and like(n, t))
    rows = df.selectExpr("lower(t) AS _low").filter("_low IS NOT NULL")
    near = grams.candidate_pairs(told.withColumnRenamed("p", "_pattern").filter("_pattern LIKE 'stray%'"), rows)
    assert near.count() == 0


def test_live_stream_runs_in_a_plain_session_elsewhere(tmp_path):
    """Neither the session's state store nor the folder it was started in may matter."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from crawlframe.streaming import live
spark = SparkSession.builder.master("local[2]").config(map={{
    "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.sql.session.timeZone": "UTC"}}).getOrCreate()
rows = "seq long, ts timestamp, url string, op string, depth int, source_url string, title string, html_file_path string, error_message string"
spark.sql("SELECT 1L seq, timestamp'2020-01-01 00:00:00' ts, 'u' url, 'add' op, 0 depth, 's' source_url, '' title, '' html_file_path,"
          " '' error_message UNION ALL SELECT 2L, timestamp'2020-01-01 00:00:01', 'u', 'crawling', 0, 's', '', '', ''").coalesce(1).write.parquet("log")
before = spark.conf.get(live.PROVIDER)
q = live.stream_live(spark.readStream.schema(rows).parquet("log"), "out", "ckpt")
q.awaitTermination()
assert spark.conf.get(live.PROVIDER) == before
print("ROWS", [(r.url, r.status) for r in live.read_live(spark, "out").collect()])
"""
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS [('u', 'crawling')]" in ran.stdout, ran.stderr[-2000:]


def test_live_row_without_a_time_sets_no_timer():
    class Kept:
        def exists(self):
            return False

        def update(self, value):
            pass

    class Handle:
        def getValueState(self, name, schema):
            return Kept()

        def listTimers(self):
            return iter(())

    made = live.LiveFrontier(1000)
    made.init(Handle())
    rest = dict(us=None, depth=0, source_url="s", title=None, html_file_path=None, error_message=None)
    out = list(made.handleInputRows(("u",), [dict(seq=1, op="add", **rest), dict(seq=2, op="crawling", **rest)], None))
    assert [(r.url, r.status, r.created_us) for r in out] == [("u", "crawling", None)]


def test_stale_query_reads_rows_without_a_time(spark, tmp_path):
    spark.sql("""SELECT id AS event_id, IF(id = 2, NULL, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, id * 10)) AS ts, id AS user_id,
        'click' AS event_type, 1.0D AS value, '{}' AS props FROM range(6)""").write.parquet(f"{tmp_path}/events.parquet")
    got = q_stream.stream_stale(spark, str(tmp_path)).collect()
    assert sorted(r.url[-1] for r in got) == list("012345")
    assert [r.url[-1] for r in got if r.created_time is None] == ["2"]
