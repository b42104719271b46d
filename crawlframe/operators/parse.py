"""The one Python stage: HTML pages to typed columns, in Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe import rules
from crawlframe.functions.dom import HEADINGS, Page
from crawlframe.functions.render import to_markdown
from crawlframe.functions.text import header_charset
from crawlframe.operators.batches import pieces
from crawlframe.session import ship_package

FEATURES = {
    "title": "string",
    "title_text": "string",
    "page_text": "string",
    "meta_text": "string",
    "heading_text": "string",
    "hrefs": "array<string>",
    "clean_html": "string",
    "main_text": "string",
    "markdown": "string",
}
_CLEAN = {"clean_html", "main_text", "markdown"}


def _page_features(html: str, want: set[str], bullet: str) -> dict:
    """Asked features of one page; a page that cannot be read gives NULLs."""
    out = dict.fromkeys(want)
    if html is None:
        return out
    try:
        page = Page(html)
        if want & {"title", "title_text"}:
            title = page.first_text("title")
            if "title" in want:
                out["title"] = None if title is None else title.strip()
            if "title_text" in want:
                out["title_text"] = (title or "").lower()
        if "hrefs" in want:
            out["hrefs"] = page.hrefs()
        if "page_text" in want:
            out["page_text"] = page.text().lower()
        if "meta_text" in want:
            metas = [page.meta(n).lower() for n in ("keywords", "description")]
            out["meta_text"] = "".join(m + " " for m in metas if m)
        if "heading_text" in want:
            out["heading_text"] = "".join(
                page.text(i, page.end[i]).lower() + " " for i in page.elements(HEADINGS)
            )
        if want & _CLEAN:
            page.clean()
            lo, hi = page.main()
            if "clean_html" in want:
                out["clean_html"] = page.to_html(lo, hi)
            if "main_text" in want:
                out["main_text"] = page.text(lo, hi)
            if "markdown" in want:
                out["markdown"] = to_markdown(page, lo, hi, bullet)
    except Exception:  # one bad page must not end the job
        if "clean_html" in want:
            out["clean_html"] = html
    return out


def parse_pages(
    df: DataFrame, features: list[str], html: str = "html", bullet: str = "*", keep_html: bool = False
) -> DataFrame:
    """Add the asked features; the page itself is dropped unless kept.

    Select only the columns needed before the call: Spark cannot prune through
    a Python stage. Rows stay in their partitions; nothing is shuffled.
    """
    at = df.columns.index(html)
    carried = [i for i, f in enumerate(df.schema.fields) if keep_html or i != at]
    want = set(features)
    schema = T.StructType([df.schema.fields[i] for i in carried] + [
        T.StructField(n, T.ArrayType(T.StringType()) if n == "hrefs" else T.StringType()) for n in features])

    def run(batches):
        for b in pieces(batches, at):
            got = [_page_features(h, want, bullet) for h in b.column(at).to_pylist()]
            made = [
                pa.array([g[n] for g in got], pa.list_(pa.string()) if n == "hrefs" else pa.string())
                for n in features]
            # Carried columns stay the Arrow arrays they are.
            yield pa.RecordBatch.from_arrays([b.column(i) for i in carried] + made, names=schema.names)

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def decode_pages(
    df: DataFrame, body: str = "body", content_type: str = "content_type",
    original: str = "original_charset", sample: int | None = 1000,
) -> DataFrame:
    """Decode raw bytes: the first candidate charset whose first `sample` characters
    hold more than ten Chinese ones, else the response's own charset.

    The sample is only for the choice (None: the whole text); all bytes are decoded.
    """
    with_header = df.withColumn("_header", F.coalesce(header_charset(content_type), F.lit("")))
    names = with_header.columns
    at, own_at, header_at = names.index(body), names.index(original), names.index("_header")
    carried = [i for i, n in enumerate(names) if n not in (body, "_header")]
    schema = T.StructType([with_header.schema.fields[i] for i in carried] + [
        T.StructField("html", T.StringType()), T.StructField("charset", T.StringType())])

    def decode(raw, name):
        try:
            return raw.decode(name, errors="replace")
        except (LookupError, TypeError):
            return raw.decode("utf-8", errors="replace")

    def choose(raw, header, own):
        for name in ([header] if header else []) + rules.CHARSET_CANDIDATES:
            text = decode(raw, name)
            if sum("一" <= ch <= "鿿" for ch in text[:sample]) > 10:
                return text, name
        return decode(raw, own), own

    def run(batches):
        for b in pieces(batches, at):
            pairs = [
                choose(r, h, o) if r is not None else (None, None)
                for r, h, o in zip(*(b.column(i).to_pylist() for i in (at, header_at, own_at)))
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in carried]
                + [pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=schema.names)

    ship_package(df.sparkSession)
    return with_header.mapInArrow(run, schema)
