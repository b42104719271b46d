"""Secret scan on hostile and long texts: no deep recursion, linear time, any column names."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from crawlframe.llm import secret_scan

MILLION = 10 ** 6


def made(spark, *texts):
    return spark.range(len(texts)).select("id", F.element_at(F.array(*texts), (F.col("id") + 1).cast("int")).alias("text"))


def test_paths_and_rules_of_a_million_characters(spark):
    r = lambda s, n=MILLION: F.repeat(F.lit(s), n)
    texts = [F.concat(r("a/"), F.lit("1")), r("-"), r("a"), F.concat(r("Ab_"), F.lit("9")), F.concat(r("a"), F.lit(" token="), r("b", 50)),
             r("/-_"), F.concat(F.lit("token:"), r("x"))]
    out = secret_scan.scan(made(spark, *texts)).select(
        "id", F.size("base_spans").alias("base"), F.size("entropy_spans").alias("entropy")).collect()
    assert [(x.id, x.base, x.entropy) for x in sorted(out)] == [
        (0, 0, 0), (1, 0, 0), (2, 1, 0), (3, 0, 0), (4, 3, 0), (5, 0, 0), (6, 1, 0)]  # runs of a and b are hex


@pytest.mark.parametrize("step", ["scan", "redact"])
def test_time_is_linear_in_the_matches(spark, step):
    def seconds(n):
        one = "token=abc123 aB3dE5fG7hI9jK1lM2nO4pQ6 "
        df = spark.range(1).select("id", F.repeat(F.lit(one), n).alias("text"))
        start = time.perf_counter()
        if step == "scan":
            got = secret_scan.scan(df).select(F.size("base_spans"), F.size("entropy_spans")).first()
            assert tuple(got) == (n, n)
        else:
            assert secret_scan.redact(df).select(F.length("text")).first()[0] == n * len("[SECRET] [SECRET] ")
        return time.perf_counter() - start

    seconds(100)
    few, many = seconds(5_000), seconds(50_000)  # a hundred thousand matches
    assert many < 20 * few + 5


def test_harmless_candidates_are_those_of_the_rules(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("aBcD/_-") for _ in range(rnd.randrange(1, 12))) for _ in range(400)] + ["/", "a/b", "A", "aB", "a/B", "aB/"]
    got = spark.createDataFrame([(w,) for w in words], "c string").select("c", secret_scan._harmless(F.col("c"))).collect()
    for c, harmless in got:
        assert harmless == any(re.search(a, c) for a in secret_scan.ALLOW), c


def test_candidates_that_touch_a_pattern_go(spark):
    rnd = random.Random(9)
    key = lambda: "".join(rnd.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(24))
    rows = []
    for i in range(60):
        parts = [rnd.choice([f"token={key()}", key(), "AKIA" + key().upper().replace("_", "A"), "word", f"{key()} token: {key()}", "é" * 30])
                 for _ in range(rnd.randrange(12))]
        rows.append((i, " ".join(parts)))
    got = secret_scan.scan(spark.createDataFrame(rows, "id int, text string")).collect()
    for r in got:
        base = [(b["start"], b["end"]) for b in r.base_spans]
        text = rows[r.id][1]
        for e in r.entropy_spans:
            assert all(e["end"] <= s or t <= e["start"] for s, t in base)
        free = [m for m in re.finditer(secret_scan.CANDIDATE, text) if all(m.end() <= s or t <= m.start() for s, t in base)]
        assert all(any(m.start() <= e["start"] and e["end"] <= m.end() for m in free) for e in r.entropy_spans)


def test_redaction_cuts_by_code_points(spark):
    text = "\U0001F600é token=abc123﻿x 😀 ﻿token=zzz999 日本"
    df = spark.createDataFrame([(1, text, 5), (2, None, 7), (3, "clean", 9)], "id int, text string, n_chars long")
    got = {r.id: (r.text, r.n_chars) for r in secret_scan.redact(df).collect()}
    want = "\U0001F600é [SECRET]﻿x 😀 ﻿[SECRET] 日本"
    assert got == {1: (want, len(want)), 2: (None, 7), 3: ("clean", 9)}


def test_any_extra_column_name(spark):
    names = ["__t", "__s", "__p", "__m_hex", "___t", "base_spans", "entropy_spans", "__given", "a.b", "__placed"]
    df = spark.createDataFrame([(1, "token=abc123", *names)], ", ".join(["id int", "text string", *[f"`{n}` string" for n in names]]))
    out = secret_scan.redact(df)
    assert out.columns == df.columns and tuple(out.first()) == (1, "[SECRET]", *names)
    scanned = secret_scan.scan(df)
    assert scanned.count() == 1 and "__t" in scanned.columns and scanned.schema["base_spans"].dataType.typeName() == "array"
