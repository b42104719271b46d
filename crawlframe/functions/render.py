"""Per-page helper of the parse stage: Markdown text from a page subtree.

Links and images are left out, tables kept, lines never wrapped, and blocks are
one line break apart.
"""

from __future__ import annotations

import re
import string

from crawlframe.functions.dom import HEADINGS, Page

_ESCAPES = [
    (re.compile(r"\\(?=[\\`*_{}\[\]()#+\-.!])"), r"\\\\"),
    (re.compile(r"^(\s*\d+)\.(?=\s)", re.M), r"\1\\."),
    (re.compile(r"^(\s*)([+])(?=\s)", re.M), r"\1\\\2"),
    (re.compile(r"^(\s*)(-)(?=[\s\-])", re.M), r"\1\\\2"),
]
_EMPHASIS = {"em": "_", "i": "_", "u": "_", "b": "**", "strong": "**",
             "del": "~~", "strike": "~~", "s": "~~"}
_CODE = {"code", "tt", "kbd"}
_SPACE_AFTER_MARK = re.compile(r"[^\]\[(){}\s.!?]")


class Markdown:
    def __init__(self, bullet: str = "*"):
        self.out, self.bullet = [], bullet
        self.breaks = 0          # line breaks owed before the next text
        self.space = False       # one blank owed before the next text
        self.fresh = True        # nothing written yet on this block
        self.quiet = self.quote = 0
        self.pre = self.code = False
        self.opened = self.closed = False   # emphasis just opened / text after it
        self.last = ""
        self.lists = []
        self.cells, self.in_row, self.head_row = 0, False, False

    def block(self):
        self.breaks = 1

    def line(self):
        self.breaks = self.breaks or 1

    def put(self, s, raw=False):
        if self.quiet:
            return
        if not (raw or self.pre):
            s = re.sub(r"\s+", " ", s)
            if s[:1] == " ":
                self.space, s = True, s[1:]
            if not s:
                return
        prefix = ">" * self.quote + (" " if self.quote and s[:1] != ">" else "")
        if self.fresh:
            self.breaks, self.space, self.fresh = 0, False, False
        if self.breaks:
            self.out.append("\n" + prefix)
            self.breaks, self.space = 0, False
        if self.space:
            self.out.append(" ")
            self.space = False
        self.out.append(s.replace("\n", "\n" + prefix) if self.pre else s)

    def text(self, data):
        # An escaped &, < or > arrives apart from the text around it.
        for piece in re.split(r"([&<>])", data):
            if piece:
                self._piece(piece)

    def _piece(self, s):
        if self.opened:
            s, self.opened, self.closed = s.strip(), False, True
        elif self.closed:
            if _SPACE_AFTER_MARK.match(s) and not (self.code or self.pre):
                s = " " + s
            self.closed = False
        if not (self.code or self.pre or s in ("&", "<", ">")):
            for pattern, repl in _ESCAPES:
                s = pattern.sub(repl, s)
        self.last = s or self.last
        self.put(s)

    def _emphasis(self, mark, start):
        glued = self.last[-1:] and (
            self.last[-1] == mark[0] if mark == "**"
            else self.last[-1] not in string.whitespace + string.punctuation
        )
        self.put(f" {mark}" if start and glued else mark)
        self.opened = start or self.opened

    def tag(self, name, start):
        if name in HEADINGS:
            self.block()
            if start:
                self.put("#" * int(name[1]) + " ", raw=True)
                self.fresh = True
        elif name in ("p", "div"):
            if not self.in_row:
                self.block()
        elif name == "br" and start:
            self.put("  \n", raw=True)
            self.space = False
        elif name == "hr" and start:
            self.block()
            self.put("* * *")
            self.block()
        elif name in ("head", "style", "script"):
            self.quiet += 1 if start else -1
        elif name == "blockquote":
            self.block()
            self.quote += 1 if start else -1
        elif name in _EMPHASIS:
            self._emphasis(_EMPHASIS[name], start)
        elif name in _CODE and not self.pre:
            self.put("`")
            self.code = start
        elif name == "pre":
            self.block()
            self.pre = start
        elif name in ("ul", "ol"):
            if start:
                if not self.lists:
                    self.block()
                self.lists.append([name, 0])
            else:
                if self.lists:
                    self.lists.pop()
                self.line()
        elif name == "li":
            self.line()
            if start:
                owner = self.lists[-1] if self.lists else ["ul", 0]
                owner[1] += 1
                mark = self.bullet if owner[0] == "ul" else f"{owner[1]}."
                self.put("  " * len(self.lists) + mark + " ", raw=True)
                self.fresh = True
        elif name in ("dt", "dd"):
            if not start:
                self.line()
        elif name == "dl" and start:
            self.block()
        else:
            self._table(name, start)

    def _table(self, name, start):
        if name == "table" and start:
            self.head_row = True
        elif name in ("td", "th") and start:
            if self.in_row:
                self.put("| ", raw=True)
            self.in_row = True
            self.cells += 1
        elif name == "tr" and start:
            self.cells = 0
        elif name == "tr":
            self.in_row = False
            self.line()
            if self.head_row:
                self.put("|".join(["---"] * self.cells))
                self.line()
                self.head_row = False


def to_markdown(page: Page, lo: int, hi: int, bullet: str = "*") -> str:
    md, ends = Markdown(bullet), []
    for i in range(lo, hi):
        while ends and ends[-1][0] <= i:
            md.tag(ends.pop()[1], False)
        if page.kind[i] == "e":
            md.tag(page.data[i], True)
            ends.append((page.end[i], page.data[i]))
        elif page.kind[i] == "t":
            md.text(page.data[i])
    while ends:
        md.tag(ends.pop()[1], False)
    return "".join(md.out).strip("\n")
