"""Pieces of Arrow batches: all rows in order, none of them held in large numbers as Python objects."""

import pyarrow as pa

from crawlframe.operators import batches, matching
from crawlframe.operators.parse import decode_pages


def test_pieces_hold_all_rows_in_order():
    rows = ["x" * (i % 50) if i % 7 else None for i in range(1000)] + ["y" * 5000, "", None, "z"]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], names=["k", "t"])
    got = list(batches.pieces([b, b.slice(0, 0)], 1, most=200))
    assert [k for p in got for k in p.column(0).to_pylist()] == list(range(len(rows)))
    assert [t for p in got for t in p.column(1).to_pylist()] == rows
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) < 250 for p in got if "y" * 5000 not in p.column(1).to_pylist())


def stage_of(monkeypatch, spark, make):
    """The function that a Python stage runs over its batches."""
    taken = []
    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: taken.append(run))
        make()
    return taken[0]


def test_hits_go_out_in_short_batches(spark, monkeypatch):
    """Some 400,000 hits of one input batch must not come as one batch."""
    words = [f"w{i:03d}" for i in range(400)]
    texts = spark.createDataFrame([(0, "")], "id long, t string")
    run = stage_of(monkeypatch, spark, lambda: matching.contained(texts, "t", "id", words))
    b = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([" ".join(words)] * 1000)], names=["id", "text"])
    got = list(run([b]))
    assert max(g.num_rows for g in got) <= matching.HITS + len(words)
    pairs = [p for g in got for p in zip(*(c.to_pylist() for c in g.columns))]
    assert sorted(pairs) == [(i, w) for i in range(1000) for w in words]


def test_pages_are_decoded_in_pieces(spark, monkeypatch):
    rows = spark.createDataFrame([(0, b"", "", "")], "id long, body binary, content_type string, original_charset string")
    run = stage_of(monkeypatch, spark, lambda: decode_pages(rows))
    body = ("矿" * 20 + "页" * 20_000).encode()
    b = pa.RecordBatch.from_arrays([pa.array(range(301)), pa.array([body] * 300 + [None]), pa.array(["text/html"] * 301),
                                    pa.array(["latin-1"] * 301), pa.array([""] * 301)], names=[*rows.columns, "_header"])
    got = list(run([b]))
    assert len(got) > 5 and [i for g in got for i in g.column(0).to_pylist()] == list(range(301))
    assert [t for g in got for t in g.column(g.schema.get_field_index("html")).to_pylist()] == [body.decode()] * 300 + [None]
