"""The texts that the line rules leave."""

from crawlframe.llm import line_rules


def test_frequent_lines_leave_the_text(spark):
    own = [" ".join(f"d{i}w{k}" for k in range(60)) for i in range(30)]
    rows = [(i, f"Read  MORE here\n{t}\n\nread more here" if i else None, "a") for i, t in enumerate(own)]
    rows.append((99, "read more here\n" + own[0], "b"))  # another host, where the line is rare
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_rules.clean(docs).collect()}
    assert got[0].text is None and got[0].n_removed_words == 0
    assert all(got[i].text == own[i] + "\n" and got[i].n_removed_words == 6 and got[i].kept for i in range(1, 30))
    assert got[99].text == rows[-1][1] and got[99].n_removed_words == 0
    assert all(r.n_words == len((rows[k][1] or "").split()) for k, r in enumerate(got[i] for i in [*range(30), 99]))


def test_copies_count_once_or_each(spark):
    line = "this line stands in every copy of the text and nowhere else"
    body = "\n".join(f"w{i} x{i} y{i} z{i}" for i in range(40))
    rows = [(i, "h", line + "\n" + body) for i in range(30)] + [(100 + i, "h", body.replace("w", f"v{i}")) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for read in (line_rules.quality, line_rules.clean):
        once = {r.doc_id: r for r in read(docs).collect()}
        each = {r.doc_id: r for r in read(docs, every_row=True).collect()}
        assert all(r.kept and r.n_removed_words == 0 for r in once.values())
        assert not any(each[i].kept for i in range(30)) and all(each[100 + i].kept for i in range(30))
        assert each[0].depleted and each[0].n_removed_words == 12 + 160
