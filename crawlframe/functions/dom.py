"""Per-page helper of the parse stage: a flat page tree on the standard parser.

Nodes lie in document order and every element knows where its subtree ends, so
a subtree is a slice and no walk recurses, however deep unclosed tags nest.
"""

from __future__ import annotations

import re
from html import escape
from html.entities import html5
from html.parser import HTMLParser

from crawlframe import rules

VOID = set(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen "
    "link menuitem meta nextid param source spacer track wbr".split()
)
# Text inside these is not part of the page's text.
HIDDEN = {"script", "style", "template", "rt", "rp"}
MULTI = {"class", "rel", "rev", "accesskey", "dropzone", "headers", "accept-charset"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_CLASS_RE = re.compile("|".join(map(re.escape, rules.UNWANTED_CLASSES)), re.I)
_ID_RE = re.compile("|".join(map(re.escape, rules.UNWANTED_IDS)), re.I)
_DROP_TAGS = set(rules.UNWANTED_TAGS)


class Page(HTMLParser):
    """`kind` is e (element), t (text), h (hidden text) or n (comment, doctype)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=False)
        self.kind, self.data, self.attrs, self.end = [], [], [], []
        self._open, self._hidden, self._pre, self._buf = [], 0, 0, []
        self._names = {}
        self.feed(html)
        self.close()
        self._flush()
        while self._open:
            self._pop()

    def updatepos(self, i, j):
        return j  # line numbers are not kept

    # -- building ----------------------------------------------------------
    def _add(self, kind, data, attrs=None):
        self.kind.append(kind)
        self.data.append(data)
        self.attrs.append(attrs)
        self.end.append(len(self.kind))

    def _flush(self):
        if not self._buf:
            return
        text = "".join(self._buf)
        self._buf = []
        if not self._pre and not text.strip(" \t\n\r\f\v"):
            text = "\n" if "\n" in text else " "
        self._add("h" if self._hidden else "t", text)

    def _pop(self):
        i = self._open.pop()
        self.end[i] = len(self.kind)
        self._names[self.data[i]] -= 1
        self._hidden -= self.data[i] in HIDDEN
        self._pre -= self.data[i] in ("pre", "textarea")
        return self.data[i]

    def handle_starttag(self, tag, attrs):
        self._flush()
        i = len(self.kind)
        self._add("e", tag, {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self._open.append(i)
            self._names[tag] = self._names.get(tag, 0) + 1
            self._hidden += tag in HIDDEN
            self._pre += tag in ("pre", "textarea")

    def handle_endtag(self, tag):
        self._flush()
        if self._names.get(tag):  # open tags by name, so that a stray end tag costs nothing
            while self._pop() != tag:
                pass

    def handle_data(self, data):
        self._buf.append(data)

    def handle_entityref(self, name):
        self._buf.append(html5.get(name + ";", "&" + name))

    def handle_charref(self, name):
        try:
            code = int(name[1:], 16) if name[0] in "xX" else int(name)
            # Numbers below 256 are meant as Windows-1252 on real pages.
            self._buf.append(bytes([code]).decode("cp1252", "ignore") or chr(code) if code < 256 else chr(code))
        except (ValueError, OverflowError):
            self._buf.append("\ufffd")

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self._buf.append(data[6:])

    def _note(self, text):
        self._flush()
        self._add("n", text)

    def handle_comment(self, data):
        self._note(f"<!--{data}-->")

    def handle_decl(self, decl):
        self._note(f"<!{decl}>")

    def handle_pi(self, data):
        self._note(f"<?{data}>")

    # -- reading -----------------------------------------------------------
    def elements(self, tags, lo=0, hi=None):
        hi = len(self.kind) if hi is None else hi
        return (i for i in range(lo, hi) if self.kind[i] == "e" and self.data[i] in tags)

    def text(self, lo=0, hi=None):
        hi = len(self.kind) if hi is None else hi
        return "".join(self.data[i] for i in range(lo, hi) if self.kind[i] == "t")

    def first_text(self, tag):
        for i in self.elements({tag}):
            return self.text(i, self.end[i])
        return None

    def meta(self, name):
        for i in self.elements({"meta"}):
            if self.attrs[i].get("name") == name:
                return self.attrs[i].get("content") or ""
        return ""

    def hrefs(self):
        links = [self.attrs[i]["href"] for i in self.elements({"a"}) if "href" in self.attrs[i]]
        frames = [self.attrs[i]["src"] for i in self.elements({"iframe"}) if "src" in self.attrs[i]]
        return links + frames

    # -- cleaning ----------------------------------------------------------
    def _keep(self, keep):
        """Rewrite the arrays to the kept nodes; subtree ends move along."""
        new = [0]
        for k in keep:
            new.append(new[-1] + k)
        idx = [i for i, k in enumerate(keep) if k]
        self.end = [new[self.end[i]] for i in idx]
        self.kind = [self.kind[i] for i in idx]
        self.data = [self.data[i] for i in idx]
        self.attrs = [self.attrs[i] for i in idx]

    def _drop(self, unwanted):
        keep, i = [True] * len(self.kind), 0
        while i < len(self.kind):
            if self.kind[i] == "e" and unwanted(i):
                keep[i:self.end[i]] = [False] * (self.end[i] - i)
                i = self.end[i]
            else:
                i += 1
        self._keep(keep)

    def clean(self):
        """Drop frames, menus, ads, images, link targets and empty boxes."""
        self._drop(
            lambda i: self.data[i] in _DROP_TAGS
            or _CLASS_RE.search(" ".join(self.attrs[i].get("class", "").split()))
            or _ID_RE.search(self.attrs[i].get("id", ""))
            or self.data[i] == "img"
        )
        for i in self.elements({"a"}):
            if self.attrs[i].get("href"):
                del self.attrs[i]["href"]
        solid = [0]
        for k, d in zip(self.kind, self.data):
            solid.append(solid[-1] + (k == "t" and bool(d.strip())))
        self._drop(lambda i: self.data[i] in ("div", "span") and solid[self.end[i]] == solid[i])

    def main(self):
        """Subtree range of the main content of a cleaned page."""
        full, bare = [0], [0]
        for k, d in zip(self.kind, self.data):
            full.append(full[-1] + (len(d) if k == "t" else 0))
            bare.append(bare[-1] + (len(d.strip()) if k == "t" else 0))
        elements = [i for i, k in enumerate(self.kind) if k == "e"]

        def size(i, sums):
            return sums[self.end[i]] - sums[i]

        for how, value in rules.MAIN_SELECTORS:
            for i in elements:
                a = self.attrs[i]
                if (
                    self.data[i] == value if how == "tag"
                    else value in a.get("class", "").split() if how == "class"
                    else a.get(how) == value
                ):
                    if size(i, bare):
                        return i, self.end[i]
                    break  # only the first match of a selector is looked at
        boxes = [i for i in elements if self.data[i] in ("div", "section", "article")]
        boxes.sort(key=lambda i: -size(i, full))
        for i in boxes[:3]:
            if size(i, bare) > 500:
                return i, self.end[i]
        for i in elements:
            if self.data[i] == "body":
                return i, self.end[i]
        return 0, len(self.kind)

    def to_html(self, lo, hi):
        out, ends = [], []
        for i in range(lo, hi):
            while ends and ends[-1][0] <= i:
                out.append(f"</{ends.pop()[1]}>")
            if self.kind[i] == "e":
                attrs = "".join(
                    f' {k}="{_attr(" ".join(v.split()) if k in MULTI else v)}"'
                    for k, v in self.attrs[i].items()
                )
                void = self.data[i] in VOID
                out.append(f"<{self.data[i]}{attrs}{'/' if void else ''}>")
                if not void:
                    ends.append((self.end[i], self.data[i]))
            elif self.kind[i] == "t":
                out.append(escape(self.data[i], quote=False))
            else:
                out.append(self.data[i])
        while ends:
            out.append(f"</{ends.pop()[1]}>")
        return "".join(out)


def _attr(v):
    return escape(v, quote=False).replace('"', "&quot;")
