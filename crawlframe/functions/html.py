"""Page expressions that need no DOM: title, links, script addresses, JS need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlframe import rules
from crawlframe.functions import urls as U
from crawlframe.functions.text import as_col, contains_any, let, strip

_HREF = r"(?is)<(?:a|iframe)\s(?:[^>]*\s)?(?:href|src)\s*=\s*\"([^\"]*)\""


def title_regex(html: Column | str, head: int | None = None) -> Column:
    """Title found in the page, or in its first `head` characters (file lists read 5,000), else the default text."""
    head = as_col(html) if head is None else F.substring(as_col(html), 1, head)
    found = F.regexp_extract(head, r"(?i)<title[^>]*>([^<]+)</title>", 1)
    return F.when(found == "", rules.NO_TITLE).otherwise(strip(found))


def raw_hrefs(html: Column | str) -> Column:
    """Double-quoted `href` of anchors and `src` of iframes, in page order.

    Not complete: it misses other quotes and keeps references as written. The
    operators read the parsed page; this is for pages known to be well formed.
    """
    return F.regexp_extract_all(as_col(html), F.lit(_HREF), 1)


def resolve_links(url: Column | str, hrefs: Column, blacklist: list[str] | None = None) -> Column:
    """Set of crawlable absolute addresses among a page's references.

    References are split, joined and filtered inside the row, so that the set
    per page costs no shuffle.
    """
    split_refs = F.transform(F.array_distinct(hrefs), U.parts)
    full = let(
        U.parts(url),
        lambda base: F.transform(split_refs, lambda r: U.join_parts(base, r)),
    )
    return F.array_distinct(F.filter(full, lambda u: U.is_crawlable_absolute(u, blacklist)))


def js_urls(url: Column | str, html: Column | str) -> Column:
    """Set of page addresses quoted in scripts: `....htm(l)`, or a directory at the very end."""
    html = as_col(html)
    pages = F.regexp_extract_all(html, F.lit(r"([\"']https?://[^\"']*\.html?[\"'])"), 1)
    last = F.regexp_extract(html, r"([\"']https?://[^\"']*/)\n?\z", 1)
    found = F.concat(pages, F.when(last != "", F.array(last)).otherwise(F.array().cast("array<string>")))
    bare = F.transform(found, lambda u: F.regexp_replace(u, r"^[\"']+|[\"']+$", ""))
    return resolve_links(url, bare)


def valid_html(html: Column | str) -> Column:
    return F.length(strip(F.coalesce(as_col(html), F.lit("")))) >= 10


def without_scripts(html: Column | str) -> Column:
    return F.regexp_replace(
        as_col(html), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", ""
    )


def has_placeholder(html: Column | str) -> Column:
    """More than ten empty blocks, or a loading mark, outside scripts and styles.

    One simple pattern per tag is far cheaper than one alternation over all;
    the blocks of different tags cannot overlap, so their counts add up.
    """
    def test(body: Column) -> Column:
        blocks = reduce(
            lambda a, b: a + b,
            [F.regexp_count(body, F.lit(f"(?i)<{t}[^>]*>{rules.WS}*</{t}>")) for t in rules.PLACEHOLDER_TAGS],
        )
        return contains_any(F.lower(body), rules.LOADING_WORDS) | (blocks > 10)

    return let(without_scripts(html), test)


def js_reason(url: Column | str, html: Column | str) -> Column:
    """Name of the first sign that a page needs JavaScript; NULL if there is none."""
    html = as_col(html)

    def first_mark(low: Column) -> Column:
        chain = F
        for name, word, pattern in rules.JS_HTML_PATTERNS:
            # The plain search spares most pages the pattern.
            chain = chain.when(low.contains(word) & html.rlike(f"(?i){pattern}"), name)
        return chain

    mark = let(F.lower(html), first_mark)
    placeholder = F.when(has_placeholder(html), "placeholder")
    by_url = F.when(contains_any(F.lower(as_col(url)), rules.JS_URL_PATTERNS), "url")
    return F.coalesce(mark, placeholder, by_url)


def choose_content(html: Column, rendered: Column, url: Column, enabled: bool = True):
    """struct(content, rendered): the rendered page where one is needed and exists."""
    needs = js_reason(url, html).isNotNull() if enabled else F.lit(False)
    use = needs & rendered.isNotNull()
    return F.struct(
        F.when(use, rendered).otherwise(html).alias("content"), use.alias("rendered")
    )


def page_facts(html: Column | str, content_type: Column, links: Column) -> Column:
    html = as_col(html)
    return F.struct(
        F.sha2(html, 256).alias("content_hash"),
        F.octet_length(html).cast("int").alias("content_size"),
        content_type.alias("content_type"),
        F.size(links).alias("extracted_urls_count"),
    )
