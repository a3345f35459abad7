"""Visible text of HTML by layout-aware rendering (operator 6).

A tree builder reads the tags with a stack of open elements: implied end tags close paragraphs, list items, table parts and
options, stray end tags are ignored, and what is left open ends with the page. Every element writes into a flow, in which
blocks end lines, paragraphs and the like leave a blank line, list items get their mark and an indent, and table cells
are laid out in aligned columns. Elements that are not rendered (head, script, style, template, hidden ones, closed dialogs, and
noscript, as scripts are taken to run) write nothing, and the text of svg drawings is left out. An element without visibility keeps its
place, and what is visible within it is shown. All other text is kept: formulas, menus, banners and footers too.

Every tag takes a time that does not depend on how many elements are open. Where more than MOST_FLOWS flows are open, list items and cells
write into the one that is there, without a further indent or alignment.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.llm.common import slices

# names of elements by their part in the layout (fixed values of the HTML standard)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript noembed noframes datalist iframe object audio video canvas svg annotation annotation-xml mphantom".split())
RAW = frozenset("script style textarea title noembed noframes iframe xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl blockquote pre figure fieldset table xmp".split())
BLOCK = SPACED | frozenset("html body address article aside center details dialog dd dir div dt figcaption footer form header hgroup legend li main nav search section summary caption option optgroup tr thead tbody tfoot td th".split())
#: Roots of elements that '/>' closes, and those within whose children are HTML again.
FOREIGN = frozenset("svg math".split())
INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
SCOPES = frozenset("html body table td th caption object template button".split())
#: An opening tag ends these open elements, looking no further out than the given ones.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "caption"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
}
PARAGRAPH_ENDS = (BLOCK | {"hr"}) - frozenset("html body li dt dd td th tr thead tbody tfoot caption option optgroup legend".split()) | frozenset(("li", "dt", "dd"))

TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|([!?])[^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|=)*+)(?:>|\Z))", re.S)
HIDDEN = re.compile(r"(?:^|[\s/\"'])hidden(?=[\s=/>]|$)(?!\s*=\s*[\"']?until-found)", re.I)
OPEN = re.compile(r"(?:^|[\s/\"'])open(?=[\s=/>]|$)", re.I)
QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')")
UNQUOTED_END = re.compile(r"=\s*\S+\Z")
STYLE = re.compile(r"(?:^|[\s/\"'])style\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
UNSHOWN = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(hidden|collapse|visible)", re.I)
NUMBER = {k: re.compile(rf"(?:^|[\s/\"']){k}\s*=\s*[\"']?\s*(-?\d{{1,6}})", re.I) for k in ("start", "value", "colspan", "rowspan")}
HIDDEN_INPUT = re.compile(r"type\s*=\s*[\"']?hidden", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
GAP = "  "
MOST_COLUMNS = 1000
MOST_ROWS = 65534
MOST_FLOWS = 100
LISTS = ("ul", "ol", "menu")
PARTS = ("thead", "tbody", "tfoot")


class Flow:
    """Lines under way."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = False

    def text(self, s: str) -> None:
        s = SPACE.sub(" ", s)
        if s == " " or s[:1] == " ":
            if not self.now or self.now[-1][-1:] == " ":
                s = s[1:]
        if s:
            self.now.append(s)

    def pre(self, s: str) -> None:
        head, *rest = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.now.append(head) if head else None
        for x in rest:
            self.line(keep=True)
            if x:
                self.now.append(x)

    def line(self, keep: bool = False) -> None:
        s = "".join(self.now)
        self.now = []
        s = s.rstrip() if keep else s.rstrip(" ")
        if s or keep:
            self.put([s])

    def put(self, lines: list[str]) -> None:
        if not lines:
            return
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines += lines

    def space(self) -> None:
        self.line()
        self.blank = True

    def close(self) -> list[str]:
        self.line()
        return self.lines


class Element:
    __slots__ = ("cells", "count", "down", "flow", "foreign", "mark", "name", "pre", "rows", "span", "unseen", "veiled")

    def __init__(self, name: str, unseen: bool, veiled: bool, pre: bool, foreign: bool):
        self.name, self.unseen, self.veiled, self.pre = name, unseen, veiled, pre
        self.foreign = name in FOREIGN or foreign and name not in INTEGRATION  # whether its children are elements of svg or math
        self.flow: Flow | None = None
        self.rows: list | None = None
        self.cells: list | None = None
        self.count, self.mark, self.span, self.down = 0, "", 1, 1


def table_lines(rows: list[list[tuple[list[str], int, int]] | None]) -> list[str]:
    """Rows of (lines of a cell, columns it spans, rows it spans) in columns as wide as their widest cell that spans no other.

    Cells that reach down keep their columns in the rows below, up to the end of the table's part (None among the rows).
    """
    width: dict[int, int] = {}
    placed: list[list[tuple[list[str], int]]] = []
    # columns that cells from above hold: [first column, column after the last, row at which they are free], those side by side that end together as one
    above: list[list[int]] = []
    free_at: list[int] = []
    stop = 0
    for number, row in enumerate(rows):
        if number == stop:
            above, free_at = [], []
            stop = next((k for k in range(number, len(rows)) if rows[k] is None), len(rows)) + (row is None)
        if row is None:
            continue
        if free_at and free_at[0] <= number:
            above = [x for x in above if x[2] > number]
            while free_at and free_at[0] <= number:
                heappop(free_at)
        at = passed = 0
        cells, reach = [], []
        for lines, span, down in row:
            while passed < len(above) and above[passed][0] <= at:
                at = max(at, above[passed][1])
                passed += 1
            if span == 1:
                width[at] = max(width.get(at, 0), max(map(len, lines), default=0))
            if down > 1:
                # beyond the part's end all are alike
                reach.append([at, at + span, min(number + down, stop)])
            cells.append((lines, at))
            at += span
        for x in reach:
            k = bisect_left(above, x)
            if k and above[k - 1][1] == x[0] and above[k - 1][2] == x[2]:
                above[k - 1][1] = x[1]
            else:
                above.insert(k, x)
                heappush(free_at, x[2])
        placed.append(cells)
    known = sorted(width)
    sums = [0, *accumulate(width[k] for k in known)]
    out = []
    for cells in placed:
        for k in range(max((len(lines) for lines, _ in cells), default=0)):
            s = ""
            for lines, at in cells:
                s = s.ljust(len(GAP) * at + sums[bisect_left(known, at)]) + (lines[k] if k < len(lines) else "")
            out.append(s.rstrip())
    return out


class Page:
    """The tree builder and its open elements."""

    def __init__(self) -> None:
        self.flow = Flow()
        self.open: list[Element] = []
        self.flows = [self.flow]
        self.depths: dict[str, list[int]] = {}  # of the open elements of each name
        self.lists: list[Element] = []
        self.tables: list[Element] = []  # that take rows
        self.rowed: list[Element] = []  # rows and such tables

    @property
    def unseen(self) -> bool:
        return bool(self.open) and self.open[-1].unseen

    def is_open(self, name: str) -> bool:
        return bool(self.depths.get(name))

    def text(self, s: str) -> None:
        if not s or self.unseen or self.open and self.open[-1].veiled:
            return
        s = html.unescape(s) if "&" in s else s
        if self.open and self.open[-1].pre:
            self.flows[-1].pre(s)
        elif not (self.open and (self.open[-1].name in ("table", "tr") or self.open[-1].name in PARTS) and not s.strip(" \t\n\r\f")):
            self.flows[-1].text(s.replace("\0", ""))

    def start(self, name: str, attributes: str) -> bool:
        """Opens an element; whether it is open still."""
        if name in ENDS:
            self.end_any(*ENDS[name])
        if name in PARAGRAPH_ENDS:
            self.end_any({"p"}, SCOPES)
        if name in VOID:
            if self.unseen:
                return False
            if name == "br":
                self.flows[-1].line(keep=True)
            elif name == "hr":
                self.flows[-1].space()
            return False
        if name == "body" and self.is_open("head"):
            self.end("head")
        up = self.open[-1] if self.open else None
        style = STYLE.search(attributes) if "style" in attributes or "STYLE" in attributes else None
        rules = html.unescape(next(g for g in style.groups() if g is not None)) if style else ""
        bare = QUOTED.sub("=", attributes) if attributes else ""
        unseen = self.unseen or name in UNSEEN or name == "dialog" and not OPEN.search(bare) or bool(bare and HIDDEN.search(bare)) or bool(rules and UNSHOWN.search(rules))
        seen = VISIBILITY.findall(rules)
        veiled = seen[-1].lower() != "visible" if seen else bool(up and up.veiled)
        e = Element(name, unseen, veiled, name in ("pre", "textarea", "xmp") or bool(up and up.pre), bool(up and up.foreign))
        if not unseen:
            flow = self.flows[-1]
            if name in SPACED and not (name in LISTS and self.is_open("li")):
                flow.space()
            elif name in BLOCK:
                flow.line()
            room = len(self.flows) <= MOST_FLOWS
            if name == "li":
                e.mark = "- "
                if self.lists and self.lists[-1].name == "ol":
                    given = NUMBER["value"].search(attributes)
                    self.lists[-1].count = int(given[1]) if given else self.lists[-1].count + 1
                    e.mark = f"{self.lists[-1].count}. "
                e.mark = "" if veiled else e.mark
                if not room and e.mark:
                    flow.now.append(e.mark)
            elif name == "ol":
                given = NUMBER["start"].search(attributes)
                e.count = int(given[1]) - 1 if given else 0
            elif name == "table" and room:
                e.rows = []
            elif name == "tr" and (self.is_open("table") or self.is_open("tr")):
                e.cells = []
            elif name in ("td", "th"):
                given = NUMBER["colspan"].search(attributes)
                e.span = min(max(int(given[1]), 1), MOST_COLUMNS) if given else 1
                given = NUMBER["rowspan"].search(attributes)
                down = int(given[1]) if given else 1
                e.down = MOST_ROWS if down == 0 else min(max(down, 1), MOST_ROWS)  # 0: to the end of the part
            if room and name in ("li", "td", "th", "table", "dd", "blockquote"):
                e.flow = Flow()
                self.flows.append(e.flow)
        # in an unquoted value the slash is part of the value
        closed = attributes.endswith("/") and (name in FOREIGN or bool(up and up.foreign)) and not UNQUOTED_END.search(QUOTED.sub("", attributes))
        self.depths.setdefault(name, []).append(len(self.open))
        self.open.append(e)
        if name in LISTS:
            self.lists.append(e)
        if e.rows is not None:
            self.tables.append(e)
        if name == "tr" or e.rows is not None:
            self.rowed.append(e)
        if closed:
            self.pop()
        return not closed

    def end_any(self, names, limits) -> None:
        """Ends the innermost open element of the names, and all within it, if no limit stands further in."""
        inmost = max((self.depths[n][-1] for n in names if self.depths.get(n)), default=-1)
        if inmost >= 0 and inmost >= max((self.depths[n][-1] for n in limits if self.depths.get(n)), default=-1):
            while len(self.open) > inmost:
                self.pop()

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
            return
        if name in ("html", "body", "table"):
            limits = frozenset()
        elif name in ("tr", "td", "th", "caption") or name in PARTS:
            limits = frozenset(("table",))
        else:
            limits = frozenset(("table", "td", "th"))
        self.end_any({name}, limits)

    def pop(self) -> Element:
        e = self.open.pop()
        name = e.name
        self.depths[name].pop()
        for stack in (self.lists, self.tables, self.rowed):
            if stack and stack[-1] is e:
                stack.pop()
        if e.unseen:
            return e
        lines: list[str] = []
        if e.flow is not None:
            lines = e.flow.close()
            self.flows.pop()
        flow = self.flows[-1]
        if e.flow is None and name in ("td", "th"):
            flow.text(" ")
        elif e.flow is None and name in BLOCK:
            flow.line()
        elif name == "li":
            flow.line()
            indent = " " * len(e.mark)
            flow.put([(e.mark if k == 0 else indent if x else "") + x for k, x in enumerate(lines)])
        elif name in ("dd", "blockquote"):
            flow.line()
            flow.put(["  " + x if x else "" for x in lines])
        elif name in ("td", "th"):
            row, table = (x[-1] if x else None for x in (self.rowed, self.tables))
            if row is not None and row.cells is not None:
                row.cells.append((lines, e.span, e.down))
            elif table is not None:
                table.rows.append([(lines, e.span, e.down)])
            else:
                flow.line()
                flow.put(lines)
        elif name == "table":
            flow.put(lines)
            flow.put(table_lines(e.rows))
        if self.tables and not e.unseen:
            if name == "tr" and e.cells is not None:
                self.tables[-1].rows.append(e.cells)
            elif name in PARTS:
                self.tables[-1].rows.append(None)
        if name in SPACED and not (name in LISTS and self.is_open("li")):
            flow.space()
        return e


def render(source: str | None) -> str:
    """The visible text of a page; lines end with ``\\n`` between them only."""
    if not source:
        return ""
    page, at, n = Page(), 0, len(source)
    while at < n:
        cut = source.find("<", at)
        if cut < 0:
            page.text(source[at:])
            break
        m = TAG.match(source, cut)
        if m is None:  # a lone < is text; so is what stands before it
            page.text(source[at : cut + 1])
            at = cut + 1
            continue
        page.text(source[at:cut])
        at = m.end()
        if not m[3]:
            continue
        name = m[3].lower()
        if m[2]:
            page.end(name)
            continue
        opened = page.start(name, m[4])
        if name in RAW and opened:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
            stop = close.start() if close else n
            body = source[at:stop]
            page.text(body if name in ("textarea", "title") else body.replace("&", "&amp;"))
            at = stop
        elif name == "pre" and source[at : at + 1] == "\n":
            at += 1
        elif name == "plaintext":
            page.text(source[at:].replace("&", "&amp;"))
            break
    while page.open:
        page.pop()
    return "\n".join(page.flow.close()).strip("\n")


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, text, n_chars.

    Null and empty pages have an empty text. Broken markup never fails: what is not a tag is text, and open elements end
    with the page. Repeated rows get a row each, null ids stay null, pages of any length are read whole, an empty table
    gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = [render(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "text", "n_chars"])

    return pages.select(F.col(id_col), F.col(html_col).cast("string")).mapInArrow(run, f"page_id {pages.schema[id_col].dataType.simpleString()}, text string, n_chars long")
