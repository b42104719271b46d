"""Markdown text expressions against a line-by-line Python reading of the rules."""

import re

from conftest import SF_DIR

from crawlframe import rules
from crawlframe.functions import markdown as M

PATTERNS = [re.compile(re.escape(t)) for t in rules.NAV_TEXTS] + [
    re.compile(r"位置[\s:：]*首页"), re.compile(r">\s*>"), re.compile(r"\|\s*\|")]
RULE = re.compile(r"^[\s|>\-─│├┤┴┬┼—–]*$")


def kept(line):
    return bool(
        line and not any(p.search(line) for p in PATTERNS) and line not in rules.NAV_EXACT_LINES
        and not RULE.match(line) and not (len(line) <= 5 and any(w in line for w in rules.NAV_SHORT_WORDS))
    )


def score(text):
    t = text.strip()
    if not t:
        return 0.0
    total = min(20, len(t) / 50)
    total += 5 * ("。" in t or "." in t) + 5 * ("\n" in t) + 5 * (len(t.split()) > 10) + 5 * any(c in t for c in "：，；、")
    total += len(re.findall("[一-鿿a-zA-Z0-9]", t)) / len(t) * 30
    total += max(0, 20 - 5 * sum(bool(p.search(t)) for p in PATTERNS))
    return total + min(10, 2 * sum(w in t for w in rules.DOMAIN_WORDS))


CASES = [
    "", " 　\n\t", "首页", "首页 > 新闻", "位置： 首页", "更多新闻", "| --- |", ">> x", "> > x", "a | | b", "a | b",
    "导航栏", "-- ─ |", "---", "--", "普通一行", "　矿产资源。　\n菜单\n菜单栏目内容\n返回", "a b c d e f g h i j",
    "a b c d e f g h i j k", "地质、环境；保护：开发，利用", "x" * 2000, "位置\n首页", "a\r\nb", "a\x85b",
]


def test_filter_and_quality(spark):
    docs = [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").collect()]
    texts = CASES + docs + [f"{c}\n{d}\n{c}" for c, d in zip(CASES, docs)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", M.filter_nav("t").alias("f"), M.quality("t").alias("q"), M.assess("t").alias("a")).collect()
    for r in rows:
        t = texts[r.i]
        want = "\n".join(x for x in (line.strip() for line in t.split("\n")) if kept(x))
        assert r.f == want, repr(t)
        assert abs(r.q.total - score(t)) < 1e-9, repr(t)
        good = len(want) >= 200 and score(want) >= 40
        assert (r.a.outcome == "success") == good and r.a.clean == want
