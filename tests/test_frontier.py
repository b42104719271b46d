"""Frontier folds, ranks, lookups and the graph against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from crawlframe import schemas
from crawlframe.functions import urls as U
from crawlframe.operators import dedup as D
from crawlframe.operators import frontier as FR
from crawlframe.operators import graph as G
from crawlframe.operators import lookup as L
from crawlframe.operators import reports as RP
from crawlframe.operators import topk as T
from crawlframe.operators.ranking import running_index, salted_rank
from crawlframe.session import scratch
from crawlframe.streaming import jobs as S

T0 = datetime(2024, 1, 1)


def log(spark, ops):
    rows = []
    for seq, (url, op, *rest) in enumerate(ops):
        a, b = (rest + [None, None])[:2]
        rows.append((seq, T0 + timedelta(minutes=seq), url, op, 0, None,
                     a if op == "success" else None, b if op == "success" else None, a if op == "failed" else None))
    return spark.createDataFrame(rows, schemas.CRAWL_LOG)


def replay(rows):
    """The table as single statements would leave it."""
    table = {}
    for r in sorted(rows, key=lambda r: r.seq):
        if r.op == "add":
            table.setdefault(r.url, dict(status="pending", title=None, html_file_path=None, created_time=r.ts,
                                         crawled_time=None, error_message=None))
        elif r.url in table:
            row = table[r.url]
            row["status"] = r.op
            if r.op == "success":
                row.update(title=r.title, html_file_path=r.html_file_path, crawled_time=r.ts)
            elif r.op == "failed":
                row.update(error_message=r.error_message, crawled_time=r.ts)
    return table


def as_table(df):
    keys = ("status", "title", "html_file_path", "created_time", "crawled_time", "error_message")
    return {r.url: {k: r[k] for k in keys} for r in df.collect()}


def test_scenario(spark):
    df = log(spark, [("t1", "add"), ("t2", "add"), ("t1", "add"), ("t1", "crawling")])
    assert [r.added for r in FR.log_adds(df).orderBy("seq").collect()] == [True, True, False]
    f = FR.fold_log(df)
    asked = spark.createDataFrame([("t1",), ("t3",)], "url string")
    assert FR.already_crawled(asked, f).count() == 0
    done = FR.fold_log(log(spark, [("t1", "add"), ("t1", "crawling"), ("t1", "success", "T", "p")]))
    assert [r.url for r in FR.skip_crawled(asked, done).collect()] == ["t3"]


def test_double_success_keeps_the_last(spark):
    f = FR.fold_log(log(spark, [("u", "add"), ("u", "success"), ("u", "success", "T", "p.html")])).first()
    assert (f.title, f.html_file_path) == ("T", "p.html")
    f = FR.fold_log(log(spark, [("u", "add"), ("u", "success", "T", "p"), ("u", "success"), ("u", "failed", "e")])).first()
    assert (f.status, f.title, f.error_message) == ("failed", None, "e")


def test_fold_like_single_statements(spark):
    rnd = random.Random(5)
    ops = []
    for _ in range(3000):
        url = "hot" if rnd.random() < 0.34 else f"u{rnd.randrange(60)}"
        op = rnd.choice(["add", "crawling", "success", "failed"])
        ops.append((url, op, rnd.choice([None, f"t{rnd.random()}"]), f"p{rnd.random()}"))
    df = log(spark, ops)
    assert as_table(FR.fold_log(df)) == replay(df.collect())


def test_stream_equals_batch_with_late_add(spark):
    ops = [("a", "success", "early", "p"), ("a", "add"), ("a", "failed", "e"), ("b", "add"), ("b", "success", "T", "p")]
    df = log(spark, ops)
    src = scratch(spark, "log")
    # The first add of `a` comes in a later batch than its marks.
    df.filter("seq <> 1").coalesce(1).write.parquet(src)
    out, ckpt = scratch(spark, "out"), scratch(spark, "ckpt")
    stream = S.read_log_stream(spark, src, schemas.CRAWL_LOG)
    S.stream_frontier(stream, out, ckpt).awaitTermination()
    assert set(as_table(S.read_frontier(spark, out))) == {"b"}
    df.filter("seq = 1").coalesce(1).write.mode("append").parquet(src)
    S.stream_frontier(S.read_log_stream(spark, src, schemas.CRAWL_LOG), out, ckpt).awaitTermination()
    assert as_table(S.read_frontier(spark, out)) == as_table(FR.fold_log(df)) == replay(df.collect())
    small = scratch(spark, "compact")
    S.compact_frontier(spark, out, small)
    assert as_table(S.read_frontier(spark, small)) == as_table(FR.fold_log(df))


def test_empty_frontier(spark):
    empty = spark.createDataFrame([], schemas.URLS)
    assert RP.frontier_stats(empty).first().total == 0
    assert RP.success_rate(empty).first().success_rate == 0.0
    assert {r.percent for r in RP.status_share(empty).collect()} == {0}
    assert RP.run_status(empty).first().run_status == "idle"
    assert RP.run_status(empty, running=True).first().run_status == "running"


def test_limits():
    for kind, n in [("pages", 0), ("failed", 51), ("search", 101), ("files", 201)]:
        with pytest.raises(ValueError):
            T.check_limit(kind, n)


def hot(spark, n=5000):
    rnd = random.Random(3)
    rows = [(i, "hot" if rnd.random() < 0.4 else f"g{rnd.randrange(50)}") for i in range(n)] + [(n, None), (n + 1, None)]
    return rows, spark.createDataFrame(rows, "seq long, g string")


def test_salted_rank_is_a_ranking(spark):
    rows, df = hot(spark)
    groups = {}
    for r in salted_rank(df, ["g"], "seq").collect():
        groups.setdefault(r.g, []).append(r["rank"])
    assert sum(map(len, groups.values())) == len(rows)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in groups.values())


def test_running_index_follows_the_order(spark):
    rows, df = hot(spark)
    seen, want = {}, {}
    for seq, g in rows:
        seen[g] = seen.get(g, 0) + 1
        want[seq] = seen[g]
    assert {r.seq: r["rank"] for r in running_index(df, ["g"], "seq", width=64).collect()} == want


def test_site_filenames_stay_distinct(spark):
    urls = ["http://h.com/a", "https://h.com/a", "http://h.com/a?x", "http://h.com/a_1", "http://h.com/a_2", "http://h.com/b"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    names = [r.file_name for r in D.site_filenames(df).collect()]
    assert len(set(names)) == len(urls) and "h.com_b.html" in names


@pytest.mark.parametrize("inline", [0, 1000])
def test_substring_matches_both_ways(spark, inline):
    texts = ["abcabc", "", "xyz", "矿产abc", "zz"]
    words = ["abc", "c", "矿", "zzz", "abcabca", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rules = spark.createDataFrame([(w,) for w in words + [""]], "rule string")
    got = {(r.i, r.rule) for r in L.substring_matches(df, "t", "i", rules, inline_rules=inline).collect()}
    assert got == {(i, w) for i, t in enumerate(texts) for w in words if w in t}
    left = {r.t for r in L.drop_blacklisted(df, "t", rules, inline_rules=inline).collect()}
    assert left == {t for t in texts if not any(w in t for w in words)}


def test_allowed_domains(spark):
    urls = ["http://a.com/", "http://x.a.com/", "http://ba.com/", "http://a.com:80/", "http://A.com/p", "mailto:x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    dom = spark.createDataFrame([("a.com",)], "domain string")
    want = {"http://a.com/", "http://x.a.com/", "http://A.com/p"}
    assert {r.url for r in L.in_allowed_domains(df, "url", dom).collect()} == want
    assert {r.url for r in df.filter(U.in_domains("url", ["a.com"])).collect()} == want


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_expand_both_join_ways(spark, limit):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    rnd = random.Random(9)
    # Node 1 is a hub on both ends.
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(150)] + [(1, i) for i in range(40)] + [(i, 1) for i in range(40)]
    df = spark.createDataFrame(edges, "src long, dst long")
    seeds = spark.createDataFrame([(7,), (8,)], "node long")
    depth, level = {7: (0, None), 8: (0, None)}, [7, 8]
    for d in range(1, 4):
        found = {}
        for s, t in edges:
            if s in level and t not in depth:
                found[t] = min(found.get(t, s), s)
        depth.update({t: (d, s) for t, s in found.items()})
        level = list(found)
    got = {r.node: (r.depth, r.source) for r in G.expand_collector(df, seeds, 2).collect()}
    assert got == depth
    shallow = {n for n, (d, _) in depth.items() if d <= 2}
    assert {r.node for r in G.expand_spider(df, seeds, 2).collect()} == shallow
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame([("u1", "x"), ("u2", "x"), ("u3", "y")], "url string, html string")
    once = D.keep_first_content(df).drop("content_hash")
    twice = D.keep_first_content(once).drop("content_hash")
    assert sorted(once.collect()) == sorted(twice.collect()) and once.count() == 2


def test_repeated_rows_stay_once(spark):
    df = spark.createDataFrame([("u1", "x")] * 3 + [("u2", "x"), ("u3", "y")], "url string, html string")
    assert sorted(r.url for r in D.keep_first_content(df).collect()) == ["u1", "u3"]


def test_updates_move_no_rows_to_one_task(spark):
    f = spark.createDataFrame([("u", None, "pending", 0, None, None, None, None, None)], schemas.URLS)
    marks = spark.createDataFrame([], "url string, seq long, op string, title string, html_file_path string, error_message string, ts timestamp")
    plan = FR.apply_updates(f, marks)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_new_rows_lie_below_their_page(spark):
    from crawlframe.plans import jobs as J

    page = spark.createDataFrame([("http://a.com/p", "<a href='/q'>q</a>")], "url string, html string")
    known = spark.createDataFrame([("http://a.com/p", 3)], "url string, depth int")
    assert [(r.url, r.depth) for r in J.crawl_step(page, known).collect()] == [("http://a.com/q", 4)]


def test_stale_flag_on_missing_time(spark):
    row = ("u", None, "crawling", 0, None, None, None, None, None)
    f = spark.createDataFrame([row], schemas.URLS)
    assert FR.reset_stale(f, F.lit(T0).cast("timestamp")).first().was_stale is False


def test_content_duplicates_move_no_text(spark):
    rows = [("b", "x"), ("a", "x"), ("a", "x"), ("c", "y"), (None, "y"), (None, None), ("d", None), ("e", "z"), ("e", "w")]
    df = spark.createDataFrame(rows, "url string, html string")
    got = sorted((str(r.url), str(r.html)) for r in D.keep_first_content(df).collect())
    assert got == sorted([("a", "x"), ("None", "y"), ("None", "None"), ("e", "z"), ("e", "w")])
    many = spark.range(1000).select(F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit("t"), (F.col("id") % 990).cast("string")).alias("html"))
    out = D.keep_first_content(many)
    assert out.count() == 990
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_site_filenames_meet_suffixed_names(spark):
    urls = [f"{s}://h.com/{p}" for s in ("http", "https") for p in ("a", "a_1", "a_1_1", "b", "c_1")] + ["http://h.com/a?x", "http://h.com/a#y"]
    df = spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, k int")
    out = D.site_filenames(df).collect()
    names = [r.file_name for r in out]
    assert len(set(names)) == len(urls) and sorted(r.k for r in out) == list(range(len(urls)))


def test_rows_without_a_file_are_dealt_out(spark):
    set_ = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in set_}
    try:
        for k, v in set_.items():
            spark.conf.set(k, v)
        f = spark.range(2000).selectExpr("concat('u', id) AS url", "IF(id < 20, concat('p/f', id, '.html'), NULL) AS html_file_path")
        files = spark.createDataFrame([("f1.html",), ("f1.html",), ("f2.html",), (None,), ("u7",)], "file_name string")
        got = L.with_file_exists(f, files).withColumn("task", F.spark_partition_id()).collect()
        assert sorted(r.url for r in got if r.file_exists) == ["u1", "u2"] and len(got) == 2000
        assert len({r.task for r in got if r.html_file is None}) == 4  # all partitions of the session
        assert set(got[0].asDict()) == {"url", "html_file_path", "html_file", "file_exists", "task"}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_requests_are_not_sorted_for_the_crawled_ones(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "url string")
        f = spark.createDataFrame([("a", "success"), ("a", "success"), ("b", "failed"), (None, "success")], "url string, status string")
        for made, want in ((FR.already_crawled, ["a", "a"]), (FR.skip_crawled, [None, "b", "c"])):
            df = made(asked, f)
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
            assert sorted((r.url for r in df.collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
