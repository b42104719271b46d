"""URL expressions: parsing, joining, filtering and naming.

A URL is split once into an array (scheme, authority, path, query); the
fragment is dropped there and then. All functions are plain column expressions
and stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlframe import rules
from crawlframe.functions.text import as_col, contains_any, let

# RFC 3986, appendix B, with the scheme's alphabet spelt out.
_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_HIERARCHICAL = ["http", "https", "ftp", "file", "sftp", "ws", "wss"]


def parts(url: Column | str) -> Column:
    """array(scheme, authority, path, query); absent parts are empty.

    Leading blanks and control characters, tabs and line ends are not part of a
    URL, which leaves the line feed free as a separator.
    """
    clean = F.regexp_replace(as_col(url), r"^[\x00-\x20]+|[\t\r\n]", "")
    return F.split(F.regexp_replace(clean, _SPLIT, "$1\n$2\n$3\n$4"), "\n", 4)


def scheme(p: Column) -> Column:
    return F.lower(p[0])


def authority(url: Column | str) -> Column:
    return parts(url)[1]


def _path_of(p: Column) -> Column:
    return F.regexp_replace(p[2], r";[^/]*$", "")


def path(url: Column | str) -> Column:
    """Path without the parameters (`;...`) of its last segment."""
    return _path_of(parts(url))


def _unsplit(sch: Column, auth: Column, pth: Column, qry: Column) -> Column:
    slash = F.when((auth != "") & (pth != "") & ~pth.startswith("/"), "/").otherwise("")
    return F.concat(
        F.when(sch != "", F.concat(sch, F.lit(":"))).otherwise(""),
        F.when(auth != "", F.concat(F.lit("//"), auth)).otherwise(""),
        slash,
        pth,
        F.when(qry != "", F.concat(F.lit("?"), qry)).otherwise(""),
    )


def _from_parts(p: Column) -> Column:
    return _unsplit(scheme(p), p[1], p[2], p[3])


def _fold_dots(pth: Column) -> Column:
    segs = F.split(pth, "/")
    kept = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(F.element_at(segs, -1).isin(".", ".."), F.array(F.lit("")))
    joined = F.array_join(F.concat(kept, F.coalesce(tail, F.array().cast("array<string>"))), "/")
    return F.when(joined == "", "/").otherwise(joined)


def join_parts(base: Column, ref: Column) -> Column:
    """Resolve one split reference against one split base, without the fragment."""
    b_scheme = scheme(base)
    r_scheme = scheme(ref)
    foreign = (r_scheme != "") & (r_scheme != b_scheme) | ~(
        (b_scheme == "") | b_scheme.isin(_HIERARCHICAL)
    )
    from_base = F.concat(F.regexp_extract(base[2], r"^(?s)(.*/)?", 1), ref[2])
    relative = F.regexp_replace(
        F.when(from_base.startswith("/"), from_base).otherwise(F.concat(F.lit("/"), from_base)),
        "/{2,}", "/",
    )
    merged = F.when(ref[2].startswith("/"), ref[2]).otherwise(relative)
    folded = let(
        merged, lambda m: F.when(m.rlike(r"(^|/)\.\.?(/|$)"), _fold_dots(m)).otherwise(m)
    )
    return (
        F.when(foreign, _from_parts(ref))
        .when(ref[1] != "", _unsplit(b_scheme, ref[1], ref[2], ref[3]))
        .when(
            ref[2] == "",
            _unsplit(b_scheme, base[1], base[2], F.when(ref[3] == "", base[3]).otherwise(ref[3])),
        )
        .otherwise(_unsplit(b_scheme, base[1], folded, ref[3]))
    )


def url_join(base: Column | str, ref: Column | str) -> Column:
    """Absolute form of `ref` on page `base`, fragment dropped, nothing else changed."""
    return let(parts(base), lambda b: let(parts(ref), lambda r: join_parts(b, r)))


def normalize_url(url: Column | str) -> Column:
    """Drop the fragment of an absolute URL; the scheme is lower-cased."""
    return let(parts(url), _from_parts)


def is_valid_url(url: Column | str) -> Column:
    return let(parts(url), lambda p: scheme(p).isin("http", "https") & (p[1] != "") & _paired(p[1]))


def _paired(host: Column) -> Column:
    """Brackets in a host come as a pair; a URL with one alone cannot be parsed."""
    return host.contains("[") == host.contains("]")


def has_http_prefix(url: Column | str) -> Column:
    url = as_col(url)
    return url.startswith("http://") | url.startswith("https://")


def _has_extension(url: Column | str, extensions: list[str]) -> Column:
    return F.lower(path(url)).rlike(r"\.(" + "|".join(extensions) + r")$")


def is_document_file(url: Column | str, extensions=rules.DOCUMENT_EXTENSIONS) -> Column:
    return _has_extension(url, extensions)


def is_static_file(url: Column | str, extensions=rules.STATIC_EXTENSIONS) -> Column:
    return _has_extension(url, extensions)


def is_api_or_download(url: Column | str, patterns=rules.API_PATTERNS) -> Column:
    return contains_any(F.lower(as_col(url)), patterns)


def in_domains(url: Column | str, domains: list[str]) -> Column:
    """Host (port included) equals a listed domain or lies below it."""

    def test(host: Column) -> Column:
        hit = F.lit(False)
        for d in domains:
            hit = hit | (host == d.lower()) | host.endswith("." + d.lower())
        return hit

    return let(F.lower(authority(url)), test)


def is_blacklisted(url: Column | str, blacklist=rules.BLACKLIST) -> Column:
    """A rule is a lower-case substring; it matches anywhere in the URL."""
    return contains_any(F.lower(as_col(url)), list(blacklist))


def url_hint(url: Column | str, preset: str = "spider") -> Column:
    """struct(keyword hit, institution hit, gate); the gate lets every URL pass."""
    low = F.lower(as_col(url))
    return F.struct(
        contains_any(low, rules.URL_HINT_WORDS[preset]).alias("kw_hit"),
        contains_any(low, rules.INSTITUTION_MARKS).alias("inst_hit"),
        F.lit(True).alias("gate"),
    )


def should_crawl(url: Column | str, blacklist: list[str] | None = None) -> Column:
    """Not blacklisted, not a static file, not an API or download address, and parsable."""
    ok = ~is_static_file(url) & ~is_api_or_download(url) & _paired(F.coalesce(authority(url), F.lit("")))
    if blacklist:
        ok = ~is_blacklisted(url, blacklist) & ok
    return F.coalesce(ok, F.lit(False))


def is_crawlable_absolute(url: Column, blacklist: list[str] | None = None) -> Column:
    """`is_valid_url` and `should_crawl` for an address that is normalised already."""
    low = F.lower(url)
    static = (
        r"^https?://[^/?#]+/(?:[^?#]*/)?[^/?#;]*\.(?:"
        + "|".join(rules.STATIC_EXTENSIONS) + r")(?:;[^/?#]*)?(?:\?.*)?$"
    )
    lone = r"^https?://(?:[^/?#\[]*\]|[^/?#\]]*\[[^/?#\]]*(?:[/?#]|$))"
    ok = url.rlike(r"^https?://[^/?#]") & ~url.rlike(lone) & ~low.rlike(static) & ~contains_any(low, rules.API_PATTERNS)
    return ok & ~contains_any(low, blacklist) if blacklist else ok


def url_needs_js(url: Column | str) -> Column:
    static = _has_extension(url, rules.JS_URL_STATIC_EXTENSIONS)
    return ~static & contains_any(F.lower(as_col(url)), rules.JS_URL_WORDS)


def is_html(content_type: Column | str, url: Column | str, strict: bool = False) -> Column:
    """Content-type gate; without a header the path decides, and `/page` fails."""
    ctype = F.lower(F.coalesce(as_col(content_type), F.lit("")))
    if strict:
        return ctype.contains("text/html")
    pth = F.lower(path(url))
    by_path = (pth == "") | pth.rlike(r"(/|\.html|\.htm)$")
    blank = ctype.rlike(f"^{rules.WS}*$")
    return contains_any(ctype, rules.HTML_CONTENT_TYPES) | (blank & by_path)


def page_filename(url: Column | str) -> Column:
    """md5 prefix, last path part without its extension (or the host), `.html`."""

    def stem(p: Column) -> Column:
        last = F.regexp_extract(_path_of(p), r"([^/]+)/*$", 1)
        host = F.regexp_replace(p[1], "[:.]", "_")
        return let(last, lambda s: F.when(s == "", host).otherwise(F.regexp_replace(s, r"\.[^.]*$", "")))

    head = F.substring(F.md5(as_col(url)), 1, 8)
    name = F.concat_ws("_", head, let(parts(url), stem))
    safe = F.regexp_replace(name, r'[<>:"/\\|?*]', "_")
    # 200 characters with the extension.
    return F.concat(F.substring(safe, 1, 195), F.lit(".html"))


def metadata_filename(html_name: Column | str) -> Column:
    return F.replace(as_col(html_name), F.lit(".html"), F.lit("_metadata.json"))


def site_stem(url: Column | str, rendered: Column | None = None) -> Column:
    """Host and path as one flat name, at most 150 characters, `_js` if rendered."""

    def flat(p: Column) -> Column:
        host = F.replace(p[1], F.lit(":"), F.lit("_"))
        bare = F.regexp_replace(F.regexp_replace(_path_of(p), r"^/+|/+$", ""), r"[/\\]", "_")
        return F.concat_ws("_", host, F.nullif(bare, F.lit("")))

    stem = F.substring(let(parts(url), flat), 1, 150)
    if rendered is not None:
        stem = F.concat(stem, F.when(rendered, "_js").otherwise(""))
    return stem


def md_filename(name: Column | str, url: Column | str | None = None) -> Column:
    """Markdown file name from a file's stem or, if given, from its URL."""
    base = F.regexp_replace(F.regexp_extract(as_col(name), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    if url is not None:
        from_file = base

        def better(p: Column) -> Column:
            last = F.regexp_extract(_path_of(p), r"([^/]+)/*$", 1)
            second = F.regexp_extract(p[1], r"(?:^|\.)([^.]*)\.[^.]*$", 1)
            return let(
                last,
                lambda s: F.when((s != "") & (s != "index"), s)
                .when((s == "") & p[1].contains("."), second)
                .otherwise(from_file),
            )

        base = let(parts(url), better)
    clean = F.regexp_replace(base, r"[^\p{L}\p{N}_\-]", "_")
    clean = F.regexp_replace(F.regexp_replace(clean, "_+", "_"), "^_+|_+$", "")
    return F.concat(F.when(clean == "", "page").otherwise(clean), F.lit(".md"))
