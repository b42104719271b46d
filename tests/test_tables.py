"""Tables, text files and snapshots on small inputs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from crawlframe.session import fits_broadcast, scratch
from crawlframe.sources import files as IO
from crawlframe.sources import tables as TB


def test_snapshot_notices_a_change(spark):
    df = spark.createDataFrame([(f"u{i}", "x" * 200) for i in range(50)], "url string, html string")
    root, at = scratch(spark, "snap"), datetime(2024, 1, 2, 3, 4, 5)
    m = TB.snapshot(df, root, at).first()
    assert (m.name, m.rows, m.raw_bytes) == ("webpages_archive_20240102_030405", 50, 10000)
    assert TB.verify_snapshot(spark, root, m.name).first().ok
    spark.createDataFrame([("extra", "y")], df.schema).coalesce(1).write.mode("append").parquet(f"{root}/{m.name}/{TB.BUCKET}=3")
    bad = TB.verify_snapshot(spark, root, m.name).first()
    assert not bad.ok and bad.actual_rows == 51
    told = {r.bucket: r for r in TB.verify_tree(spark, root, m.name).collect()}
    assert [b for b, r in told.items() if not r.ok] == [3] and len(told[3].bad_files) == 1


def test_damaged_files_are_named(spark):
    import pathlib

    df = spark.createDataFrame([(f"u{i}", f"text {i}" * 50, i) for i in range(300)], "url string, html string, k int")
    root = scratch(spark, "snap")
    m = TB.snapshot(df, root, datetime(2024, 1, 2)).first()
    folder = pathlib.Path(root.removeprefix("file:")) / m.name
    cut = next(folder.glob(f"{TB.BUCKET}=4/*.parquet"))
    cut.write_bytes(cut.read_bytes()[:200])  # a torn file
    gone = next(folder.glob(f"{TB.BUCKET}=7/*.parquet"))
    gone.unlink()
    told = {r.bucket: r for r in TB.verify_tree(spark, root, m.name).collect()}
    assert sorted(b for b, r in told.items() if not r.ok) == [4, 7]
    assert told[4].bad_files == [cut.name] and told[7].bad_files == [gone.name] and told[7].actual_rows == 0
    bad = TB.verify_snapshot(spark, root, m.name).first()
    assert not bad.ok and bad.rows == 300 and bad.actual_rows < 300


def test_equal_folders_are_not_read(spark):
    df = spark.createDataFrame([(f"u{i}", "x" * i) for i in range(200)], "url string, html string")
    root = scratch(spark, "snap")
    a = TB.snapshot(df, root, datetime(2024, 1, 2)).first().name
    b = TB.snapshot(df.withColumn("html", F.when(F.col("url") == "u7", "new").otherwise(F.col("html"))), root, datetime(2024, 1, 3)).first().name
    assert [tuple(r) for r in TB.compare_snapshots(spark, root, a, b).collect()] == [("u7", "changed")]
    assert len(TB._different(TB.tree_checksums(spark, root, a), TB.tree_checksums(spark, root, b))) == 1
    more = df.unionByName(spark.createDataFrame([("z", "1")], df.schema))
    assert [r.url for r in TB.retain_by_tree(more, root, a).collect()] == ["z"]
    assert TB.retain_by_tree(df, root, a).count() == 0 and TB.compare_snapshots(spark, root, a, a).count() == 0


def test_tables_keep_types(spark):
    root = scratch(spark, "tables")
    TB.create_tables(spark, root)
    TB.append_rows(spark.createDataFrame([("u", 3)], "url string, depth long"), root, "urls")
    TB.create_tables(spark, root)  # leaves the filled table alone
    got = TB.read_table(spark, root, "urls")
    assert got.count() == 1 and got.schema["depth"].dataType.simpleString() == "int"
    TB.reset_tables(spark, root)
    assert TB.read_table(spark, root, "urls").count() == 0


def test_names_stay_over_batches(spark):
    from crawlframe.sources.name_registry import NameRegistry

    def batch(rows):
        return spark.createDataFrame(rows, "url string, stem string")

    reg = NameRegistry(spark, scratch(spark, "names"), 4)
    one = {(r.url, r.stem): r.name for r in reg.assign(batch([(f"u{i}", "x") for i in range(5)] + [("a", "x_2"), ("b", "y"), ("b", "y")]), "1").collect()}
    assert sorted(n for (u, s), n in one.items() if s == "x") == ["x", "x_1", "x_3", "x_4", "x_5"]
    assert one["a", "x_2"] == "x_2" and one["b", "y"] == "y" and len(one) == 7
    second = batch([("u1", "x"), ("v1", "x"), ("v2", "x"), ("c", "x_4"), ("d", "y_7"), ("e", "y"), ("g", "x_7")])
    two = {(r.url, r.stem): r.name for r in reg.assign(second, "2").collect()}
    assert two["u1", "x"] == one["u1", "x"] and two["c", "x_4"] == "x_4_1" and two["d", "y_7"] == "y_7" and two["e", "y"] == "y_1"
    assert {two["v1", "x"], two["v2", "x"]} == {"x_6", "x_8"} and two["g", "x_7"] == "x_7"
    again = {(r.url, r.stem): r.name for r in reg.assign(second, "2").collect()}
    assert again == two
    every = [r.name for r in reg.names().collect()]
    assert len(every) == len(set(every)) == 13
    assert reg.assign(batch([]), "3").count() == 0


def test_taken_numbers_are_ranges(spark):
    from crawlframe.sources.name_registry import TAKEN, NameRegistry

    reg = NameRegistry(spark, scratch(spark, "names"), 4)
    reg.assign(spark.range(10_000).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("s").alias("stem")), "1")
    assert reg._read("taken", TAKEN).count() <= 3
    reg.assign(spark.range(10_000, 10_010).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("s").alias("stem")), "2")
    names = {r.name for r in reg.names().collect()}
    assert names == {"s"} | {f"s_{i}" for i in range(1, 10_010)}


def test_text_lists(spark, tmp_path):
    p = tmp_path / "seeds.txt"
    p.write_text("# note\nhttp://a.com/ \n\n #http://b.com/\nnot-a-url\nhttps://facebook.com/x\n", encoding="utf-8")
    path = str(p)
    assert [r.url for r in IO.read_seeds(spark, path).collect()] == [
        "http://a.com/", "#http://b.com/", "not-a-url", "https://facebook.com/x"]
    (tmp_path / "rules.txt").write_text("# r\nFaceBook.com\nfacebook.com\n", encoding="utf-8")
    rules = IO.read_rules(spark, str(tmp_path / "rules.txt"))
    assert [r.rule for r in rules.collect()] == ["facebook.com"]
    assert [r.url for r in IO.read_seeds(spark, path, True, rules).collect()] == ["http://a.com/"]


def test_html_folder(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>矿\n二</p>", encoding="utf-8")
    (tmp_path / "b.json").write_text("{}")
    r = IO.read_html_dir(spark, str(tmp_path)).collect()
    assert [(x.file_name, x.html) for x in r] == [("a.html", "<p>矿\n二</p>")]
    assert [x.file_name for x in IO.list_files(spark, str(tmp_path)).collect()] == ["a.html"]


def test_broadcast_is_bounded_in_rows_and_bytes(spark):
    df = spark.range(100).withColumn("s", F.repeat(F.lit("x"), 1000))
    assert fits_broadcast(df) and not fits_broadcast(df, max_rows=99) and not fits_broadcast(df, max_bytes=50_000)


def test_bad_bytes_are_left_out(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<p>a\xff\xfeb</p>")
    assert IO.read_html_dir(spark, str(tmp_path)).first().html == "<p>ab</p>"


def test_shared_folder_is_required_off_local(monkeypatch):
    from types import SimpleNamespace as NS

    from crawlframe.session import shared_root

    bare = NS(conf=NS(get=lambda *a: None), sparkContext=NS(
        master="spark://host:7077", getConf=lambda: NS(get=lambda k: None), getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        shared_root(bare)


def test_first_free_suffix(spark):
    batch = spark.createDataFrame([("u1", "x.md"), ("u2", "x_1.md"), ("u3", "x.md"), ("u4", "y.md"), ("u5", "y.md")], "url string, md_name string")
    old = spark.createDataFrame([("x.md",), ("x_2.md",), ("x_5.md",)], "md_name string")
    got = {r.url: r.md_name for r in IO.unique_md_names(batch, old).collect()}
    assert sorted([got["u1"], got["u3"]]) == ["x_3.md", "x_4.md"] and got["u2"] == "x_1.md"
    assert sorted([got["u4"], got["u5"]]) == ["y.md", "y_1.md"]
    one = spark.createDataFrame([("u1", "x.md")], "url string, md_name string")
    gap = spark.createDataFrame([("x.md",), ("x_5.md",)], "md_name string")
    assert IO.unique_md_names(one, gap).first().md_name == "x_1.md"
