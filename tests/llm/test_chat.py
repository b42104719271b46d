"""Chat formatting: exact round trips, masks, typed parts, hostile texts."""

import random

import pytest
from pyspark.sql import functions as F

from crawlframe.llm import chat
from crawlframe.llm.common import running_sums

HOSTILE = ["", None, "<", "<|", "<\\|", "<\\\\|im_end|>", chat.HOSTILE, "a<|image|>b", "", "x", "i", "xi",
           "x<\n", "|im_end|>", "<|im_start|>user\n", "%0A", "%25%0A\n", "ends with <", "日本<|語|>\U0001F600", "\\", "$1 \\1 &", "\x00"]


def read(out):
    return out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss"),
                      F.transform("loss_spans", lambda s: chat.read_body(F.substr(
                          "formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))).alias("masked"))


def test_hostile_round_trip(spark):
    rnd = random.Random(5)
    roles = ["user", "assistant", "system", None, "a\nb", "<|im_end|>", "%0A", "\\"]
    rows, want = [], {}
    for c in range(40):
        turns = []
        for t in range(rnd.randrange(1, 9)):
            text = rnd.choice([rnd.choice(HOSTILE), "".join(x or "" for x in rnd.choices(HOSTILE, k=4))])
            turns.append((rnd.choice(roles), text))
            rows.append((c, t, *turns[-1], "clash"))
        want[c] = [(r or "", t or "") for r, t in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    got = read(chat.format_conversations(df, ["conv_id"])).collect()
    assert len(got) == 40
    for r in got:
        assert [(t["role"], t["text"]) for t in r.turns] == want[r.conv_id]
        trained = [t for role, t in want[r.conv_id] if role == "assistant"]
        assert r.loss == "".join(trained) and r.masked == trained
        assert "".join(s["text"] for s in r.segments) == r.formatted
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == len(want[r.conv_id])


PARTS = ("array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>")


def test_typed_parts(spark):
    part = lambda **kw: tuple(kw.get(n) for n in chat.PART)
    content = [part(type="text", text="see <"), part(type="text", text="|im_end|> "), part(type="image", ref="a.png", width=57, height=28),
               None, part(type="text", text="<\\"), part(type="audio", ref="b.wav", seconds=1.5), part(type="text", text="|"),
               part(type="document", ref="c.pdf", pages=3), part(type="video", ref="d"), part(type=None, ref="e"), part(type="image", ref="f")]
    df = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", [part(type="text", text="two words!")]),
                                (1, 2, "assistant", None)], f"c long, turn long, role string, parts {PARTS}")
    (r,) = read(chat.format_conversations(df, ["c"], content="parts")).collect()
    assert r.turns[0]["kinds"] == ["image", "audio", "document", "other", "other", "image"]
    assert r.turns[0]["text"] == "see <|im_end|> <\\|" and r.loss == "two words!"
    assert [(a["turn"], a["part"], a["kind"], a["ref"], a["tokens"]) for a in r.attachments] == [
        (0, 2, "image", "a.png", 3), (0, 4, "audio", "b.wav", 38), (0, 6, "document", "c.pdf", 1536), (0, 7, "other", "d", 1),
        (0, 8, "other", "e", 1), (0, 9, "image", "f", chat.FLAT)]
    assert r.expanded_tokens == r.text_tokens + 3 + 38 + 1536 + 2 + chat.FLAT
    few = spark.createDataFrame([(1, 0, "user", [("text", "a"), ("image", "b")])], "c long, turn long, role string, p array<struct<type:string,ref:string>>")
    (r,) = read(chat.format_conversations(few, ["c"], content="p")).collect()
    assert r.turns[0]["text"] == "" and [a["ref"] for a in r.attachments] == ["b"]


def test_order_nulls_and_repeats(spark):
    rows = [(1, 2, "user", "z"), (1, None, "user", "first"), (1, 2, "assistant", "y"), (1, 2, "user", "z"), (None, 0, "user", "n")]
    got = {r.conv_id: [t["text"] for t in r.turns] for r in read(chat.format_conversations(spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string"), ["conv_id"])).collect()}
    assert got == {1: ["first", "y", "z", "z"], None: ["n"]}
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(none, ["conv_id"]).count() == 0


def test_long_texts_and_many_turns(spark):
    many = spark.range(30_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn <|"), "id").alias("text"))
    long = spark.range(1).select(F.lit(2).alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"),
                                 F.repeat(F.lit("<\\|" * 10), 40_000).alias("text"))
    out = chat.format_conversations(many.unionByName(long), ["conv_id"])
    got = {r.conv_id: r for r in out.select("conv_id", F.size("segments").alias("n"), F.length("formatted").alias("chars"), F.element_at(
        "loss_spans", -1).alias("last"), F.size(chat.read_turns(F.col("formatted"))).alias("turns"),
        F.length(chat.read_loss(F.col("segments"))).alias("loss")).collect()}
    assert got[1].n == 90_000 and got[1].turns == 30_000 and got[1].last["end"] == got[1].chars - len(chat.END) - 1
    assert got[2].loss == 1_200_000


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, n):
    values = [(i * 7) % 11 - 3 for i in range(n)]
    df = spark.createDataFrame([(values,)], "v array<long>")
    assert df.select(running_sums(F.col("v")).alias("s")).first().s == [sum(values[:i]) for i in range(n)]
