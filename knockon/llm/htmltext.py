"""Layout-aware HTML rendering to plain text.

A tokeniser feeds a stack of open elements that applies implied end tags (a new
``p``, ``li``, ``td``... closes the open one) and visibility rules.  The
renderer writes blocks on lines of their own with blank lines between
paragraphs, headings, lists and tables, marks list items by depth, keeps
``pre`` as it is, and pads table cells so that columns line up.

Defined results: null and empty pages give empty text; text outside ``body``,
unclosed or misnested tags, unknown entities and stray ``<`` are kept as a
browser would show them; extra columns are not read by ``extract``.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements without content, raw-text elements, and elements never shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
HIDDEN = frozenset("head script style title template noscript iframe object svg math datalist "
                   "audio video canvas select noembed noframes".split())
#: Blocks, and the blocks that stand apart by a blank line.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
                   "menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table pre blockquote figure hr".split())
#: What a start tag closes, and the elements beyond which it does not look.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th caption", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "tbody": ("tbody thead tfoot tr td th caption", ("table",)),
    "thead": ("tbody thead tfoot tr td th caption", ("table",)),
    "tfoot": ("tbody thead tfoot tr td th caption", ("table",)),
    "option": ("option", ("select", "datalist")), "optgroup": ("option optgroup", ("select",)),
    "body": ("head", ("html",)),
}
CLOSES = {k: (frozenset(v.split()), stop) for k, (v, stop) in CLOSES.items()}
SCOPES = frozenset("table td th caption html template button object".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"<([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_INVISIBLE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2].strip("\"'")) if m[2] else ""
            for m in _ATTRIBUTE.finditer(source)} if source.strip(" /\n\t") else {}


def is_hidden(tag: str, attrs: dict[str, str]) -> bool:
    return (tag in HIDDEN or "hidden" in attrs or bool(_INVISIBLE.search(attrs.get("style", "")))
            or tag == "input" and attrs.get("type", "").lower() == "hidden"
            or tag == "dialog" and "open" not in attrs)


class Flow:
    """Text of one block context: finished lines, the open line, and the gap asked for."""

    def __init__(self):
        self.lines: list[str] = []
        self.open = ""
        self.gap = 0
        self.marker = ""

    def text(self, data: str, pre: bool):
        if pre:
            first, *rest = data.replace("\r\n", "\n").split("\n")
            self._put(first)
            for line in rest:
                self.lines.append(self.open)
                self.open = line
            return
        data = _SPACE.sub(" ", data)
        if not self.open or self.open.endswith(" "):
            data = data.lstrip(" ")
        if data:
            self._put(data)

    def _put(self, data: str):
        if not self.open and data:
            if self.gap and self.lines:
                self.lines.extend([""] * (self.gap - 1))
            self.gap = 0
            self.open, self.marker = self.marker, ""
        self.open += data

    def end_line(self, gap: int = 1, pre: bool = False):
        if self.open.strip():
            self.lines.append(self.open if pre else self.open.rstrip())
        self.open = ""
        self.gap = max(self.gap, gap)

    def line_break(self):
        if self.open.strip():
            self.lines.append(self.open.rstrip())
            self.open = ""
            self.gap = max(self.gap, 1)
        elif self.lines:
            self.gap += 1

    def rendered(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


class Table:
    """Rows of rendered cells, written as aligned columns."""

    def __init__(self):
        self.rows: list[list[str]] = []
        self.caption = ""

    def rendered(self) -> list[str]:
        width: dict[int, int] = {}
        for row in self.rows:
            for i, cell in enumerate(row[:-1]):
                width[i] = max(width.get(i, 0), *(len(x) for x in cell.split("\n")))
        out = self.caption.split("\n") if self.caption else []
        for row in self.rows:
            cells = [cell.split("\n") for cell in row]
            for k in range(max(map(len, cells), default=0)):
                parts = [(c[k] if k < len(c) else "").ljust(width.get(i, 0) if i < len(row) - 1 else 0)
                         for i, c in enumerate(cells)]
                out.append(" | ".join(parts).rstrip())
        return [line for line in out if line.strip(" |")]


class Renderer:
    """Open elements as (tag, hidden), with one flow for the page and one for each open cell."""

    def __init__(self):
        self.stack: list[tuple[str, bool]] = []
        self.flows = [Flow()]
        self.tables: list[Table] = []
        self.lists: list[list] = []
        self.hidden = self.pre = 0

    def start(self, tag: str, attrs: dict[str, str]):
        if tag in CLOSES:
            closes, stops = CLOSES[tag]
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in stops:
                    break
                if self.stack[i][0] in closes:
                    self._pop_to(i)
        if tag in BLOCKS and tag not in ("html", "body"):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in SCOPES:
                    break
                if self.stack[i][0] == "p":
                    self._pop_to(i)
                    break
        hidden = is_hidden(tag, attrs)
        if tag in VOID:
            if not self.hidden and not hidden:
                self._void(tag, attrs)
            return
        if tag not in ("html", "body", "head") and not self.stack:
            self.stack.append(("body", False))
        self.stack.append((tag, hidden))
        self.hidden += hidden
        if not self.hidden:
            self._open(tag, attrs)

    def end(self, tag: str):
        if tag == "p" and not any(t == "p" for t, _ in self.stack):
            self.start("p", {})
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop_to(i)
                return
            if self.stack[i][0] in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return

    def text(self, data: str):
        if self.hidden:
            return
        if self.stack and self.stack[-1][0] in ("table", "tbody", "thead", "tfoot", "tr") and not data.strip():
            return
        self.flows[-1].text(html.unescape(data), bool(self.pre))

    def _pop_to(self, i: int):
        while len(self.stack) > i:
            tag, hidden = self.stack.pop()
            if not self.hidden:
                self._close(tag)
            self.hidden -= hidden

    def _void(self, tag: str, attrs: dict[str, str]):
        flow = self.flows[-1]
        if tag == "br":
            flow.line_break()
        elif tag == "hr":
            flow.end_line(2)
        elif tag == "img" and attrs.get("alt", "").strip():
            flow.text(f"[{attrs['alt'].strip()}]", False)
        elif tag == "input" and attrs.get("type", "text").lower() in ("button", "submit", "reset"):
            flow.text(attrs.get("value", ""), False)

    def _open(self, tag: str, attrs: dict[str, str]):
        flow = self.flows[-1]
        if tag == "table":
            flow.end_line(2)
            self.tables.append(Table())
        elif tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif tag in ("td", "th", "caption") and self.tables:
            self.flows.append(Flow())
        elif tag in BLOCKS:
            nested = tag in ("ul", "ol", "menu") and self.lists
            flow.end_line(2 if tag in SPACED and not nested else 1)
        if tag in ("ul", "ol", "menu"):
            start = attrs.get("start", "1")
            self.lists.append([tag, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
        elif tag == "li":
            depth = "  " * max(len(self.lists) - 1, 0)
            if self.lists and self.lists[-1][0] == "ol":
                flow.marker = f"{depth}{self.lists[-1][1]}. "
                self.lists[-1][1] += 1
            else:
                flow.marker = f"{depth}- "
        elif tag == "dd":
            flow.marker = "  "
        elif tag == "pre":
            self.pre += 1

    def _close(self, tag: str):
        flow = self.flows[-1]
        if tag == "pre":
            self.pre -= 1
            flow.end_line(2, pre=True)
        elif tag == "table" and self.tables:
            table = self.tables.pop()
            lines = table.rendered()
            flow = self.flows[-1]
            flow.end_line(2)
            if lines:
                if flow.lines:
                    flow.lines.extend([""] * (flow.gap - 1))
                flow.lines.extend(lines)
                flow.gap = 2
        elif tag in ("td", "th", "caption") and self.tables and len(self.flows) > 1:
            cell = self.flows.pop().rendered()
            if tag == "caption":
                self.tables[-1].caption = cell
            else:
                if not self.tables[-1].rows:
                    self.tables[-1].rows.append([])
                self.tables[-1].rows[-1].append(cell)
        elif tag in ("ul", "ol", "menu"):
            if self.lists:
                self.lists.pop()
            flow.end_line(1 if self.lists else 2)
            flow.marker = ""
        elif tag in BLOCKS:
            flow.end_line(2 if tag in SPACED else 1)
            if tag in ("li", "dd"):
                flow.marker = ""

    def finish(self) -> str:
        self._pop_to(0)
        return self.flows[0].rendered()


class Tokens:
    """Markup of a page, found in time linear in its length.

    A start tag ends at the first ``>`` outside quotes, or with the page.  A ``<``
    after which a quote never closes is text; the marks that such a scan passed
    are noted, so later scans that meet one of them stop there.
    """

    def __init__(self, page: str):
        self.page = page
        self.bare = (0, -1)
        self.open_marks: set[int] = set()

    def _mark(self, at: int) -> int:
        """Place of the next ``>`` or quote (the end, if none); ``bare`` holds none of them."""
        if not self.bare[0] <= at <= self.bare[1]:
            found = _MARK.search(self.page, at)
            self.bare = (at, found.start() if found else len(self.page))
        return self.bare[1]

    def _tag_end(self, at: int) -> int | None:
        passed = []
        while True:
            at = self._mark(at)
            if at == len(self.page):
                return at
            if self.page[at] == ">":
                return at + 1
            if at in self.open_marks:
                self.open_marks.update(passed)
                return None
            passed.append(at)
            at = self.page.find(self.page[at], at + 1) + 1
            if not at:
                self.open_marks.update(passed)
                return None

    def next(self, at: int) -> tuple[int, int, str | None, str | None, str] | None:
        """(start, end, name that is closed, name that is opened, attributes) of the next markup."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if other := _MARKUP.match(page, at):
                return at, other.end(), other[1], None, ""
            if name := _NAME.match(page, at):
                ends = [name.end()] + [i for i in range(name.end() - 1, at + 1, -1) if page[i] in "\"'"]
                for name_end in ends:  # a quote inside the name may be the first of a value
                    end = self._tag_end(name_end)
                    if end is not None:
                        rest = page[name_end:end - 1] if page[end - 1] == ">" and end > name_end else page[name_end:end]
                        return at, end, None, page[at + 1:name_end], rest
            at += 1
        return None


def render(source: str | None) -> str:
    """The visible text of one page."""
    page, out, at = source or "", Renderer(), 0
    tokens = Tokens(page)
    while True:
        token = tokens.next(at)
        if not token:
            out.text(page[at:])
            return out.finish()
        start, end, closed, opened, rest = token
        if start > at:
            out.text(page[at:start])
        at = end
        if closed:
            out.end(closed.lower())
        elif opened:
            tag = opened.lower()
            out.start(tag, attributes(rest))
            if tag in RAW:
                raw_end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                out.text(page[at:raw_end.start() if raw_end else len(page)])
                out.end(tag)
                at = raw_end.end() if raw_end else len(page)
            elif rest.rstrip().endswith("/") and tag in ("svg", "math", "path"):
                out.end(tag)


def render_column(page: Column) -> Column:
    """The visible text of each page."""
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(render)
    return run(page)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: id, text, n_chars, n_lines."""
    return (pages.select(F.col(id_col).alias("id"), render_column(F.col(html_col)).alias("text"))
            .withColumns({"n_chars": F.length("text").cast("long"),
                          "n_lines": F.when(F.col("text") == "", 0).otherwise(
                              F.size(F.split("text", "\n"))).cast("long")}))
