"""Visible text of web pages, laid out in blocks, lists and aligned tables."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# fixed values: element names as HTML defines them
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("script style template noscript head title iframe object svg math datalist audio video canvas".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hr legend li main nav ol p pre section summary table ul tr caption thead tbody tfoot".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol table blockquote pre figure dl".split())
#: A start tag closes open elements of these names, up to the nearest of the stops.
IMPLIED = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
           "tr": (("tr", "td", "th", "caption"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
           "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",)),
           "thead": (("caption",), ("table",)), "option": (("option",), ("select",)), "body": (("head",), ())}
APART = frozenset("option optgroup button".split())  # inline, but never run together with what is beside them
MOST_COLUMNS, MOST_ROWS = 1000, 65534  # of a cell's span, as HTML limits them
_GONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_COMMENT_END = re.compile("--!?>")
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    """hidden: gone with all it holds. unseen, pre: of its own text, handed down. closed: a
    details element that shows its first summary only."""

    __slots__ = ("name", "parts", "hidden", "start", "unseen", "pre", "closed", "columns", "rows")

    def __init__(self, name: str, hidden: bool = False, start: int = 1, unseen: bool = False, pre: bool = False, closed: bool = False,
                 columns: int = 1, rows: int = 1):
        self.name, self.parts, self.hidden, self.start, self.unseen, self.pre = name, [], hidden, start, unseen, pre
        self.closed, self.columns, self.rows = closed, columns, rows


def _number(text: str | None, pattern: str, other: int) -> int:
    return int(text) if re.fullmatch(pattern, text or "") else other


class TreeBuilder(HTMLParser):
    """A tree of any tag soup; end tags that fit nothing open are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a name, so none is looked for one by one

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "html":
            return
        if tag in BLOCKS and tag not in ("tr", "thead", "tbody", "tfoot", "caption"):
            self._close(("p",), ("table", "td", "th", "div", "li", "button"))
        closes, stops = IMPLIED.get(tag, ((), ()))
        if closes:
            self._close(closes, stops)
        style, over = given.get("style") or "", self.open[-1]
        hidden = tag in UNSEEN or "hidden" in given or bool(_GONE.search(style)) or (tag == "dialog" and "open" not in given) or (
            tag == "input" and (given.get("type") or "").lower() == "hidden")
        if over.closed and (tag != "summary" or any(not isinstance(p, str) and p.name == "summary" for p in over.parts)):
            hidden = True
        said = _VISIBILITY.findall(style)
        node = Node(tag, hidden, _number(given.get("start"), "-?[0-9]{1,9}", 1), said[-1].lower() != "visible" if said else over.unseen,
                    over.pre or tag == "pre", tag == "details" and "open" not in given,
                    min(max(_number(given.get("colspan"), "[0-9]{1,9}", 1), 1), MOST_COLUMNS),
                    min(_number(given.get("rowspan"), "[0-9]{1,9}", 1), MOST_ROWS))
        over.parts.append(node)
        if tag not in VOID:
            self.places[tag].append(len(self.open))
            self.open.append(node)

    def _last(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places[n]), default=0)

    def _leave(self, k: int) -> None:
        while len(self.open) > k:
            self.places[self.open.pop().name].pop()

    def _close(self, names, stops):
        stop = self._last(stops)
        if self._last(names) > stop:  # the outermost one this side of the stop
            self._leave(min(at[i] for n in names if (at := self.places[n]) and (i := bisect_right(at, stop)) < len(at)))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        stops = ("table",) if tag not in ("table", "body") else ()
        k = self._last((tag,))
        if k > self._last(stops):
            self._leave(k)

    def parse_marked_section(self, i, report=1):
        # of any name: a comment up to the next > or the end, as in browsers; the base class fails on unknown names
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    def parse_comment(self, i, report=1):
        # an unclosed comment hides the rest, and --!> ends one, as in browsers
        found = _COMMENT_END.search(self.rawdata, i + 2)
        return found.end() if found else len(self.rawdata)

    def handle_data(self, data):
        if not (self.open[-1].unseen or self.open[-1].closed):
            self.open[-1].parts.append(data)


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _run(task: Generator):
    """The result of a renderer that yields the renderers it waits for: an explicit stack,
    so no depth of a page ends it."""
    waiting, value = [task], None
    while waiting:
        try:
            task, value = waiting[-1].send(value), None
            waiting.append(task)
        except StopIteration as done:
            waiting.pop()
            value = done.value
    return value


def _lines(node: Node, out: list[str]) -> Generator:
    """Adds the node's lines to ``out``; an empty line separates spaced blocks."""
    base = len(out)
    run: list[str] = []
    pre = node.pre

    def flush():
        text = "".join(run)
        run.clear()
        if pre:
            out.extend(x.rstrip() for x in text.strip("\n").split("\n")) if text.strip() else None
        else:
            found = [_BLANKS.sub(" ", x).strip(" ") for x in text.split("\x00")]
            while found and not found[-1]:
                found.pop()
            out.extend(found if any(found) else [])

    number = node.start
    walks = [iter(node.parts)]
    while walks:
        part = next(walks[-1], None)
        if part is None:
            walks.pop()
        elif isinstance(part, str):
            run.append(part.replace("\x00", ""))
        elif part.hidden:
            continue
        elif part.name == "br":
            run.append("\n" if pre else "\x00")
        elif part.name in BLOCKS or part.name in ("td", "th"):
            flush()
            mark = len(out)
            if part.name in SPACED and mark > base and out[-1]:
                out.append("")
            begin = len(out)
            if part.name == "table":
                out.extend((yield _table(part)))
            else:
                yield _lines(part, out)
            if part.name == "li":
                sign = f"{number}. " if node.name == "ol" else "- "
                number += 1
                out[begin:] = [(sign if i == 0 else " " * len(sign)) + x if x else x for i, x in enumerate(out[begin:])]
            if len(out) == begin:
                del out[mark:]
            elif part.name in SPACED:
                out.append("")
        elif part.name in APART:
            walks.append(iter([" ", *part.parts, " "]))
        else:
            walks.append(iter(part.parts))
    flush()
    while len(out) > base and not out[-1]:
        out.pop()


def _table(node: Node) -> Generator:
    """Rows of cells under one another. A cell begins where its column does, below whatever
    cell of an earlier row spans it; a column begins behind the widest cell that ends
    before it."""
    out, rows = [], []
    above: list[tuple[int, int, int]] = []  # (first column, end, rows to come) of cells that reach into the next row
    walks = [iter(node.parts)]
    while walks:
        x = next(walks[-1], None)
        if x is None:
            walks.pop()
        elif isinstance(x, str):
            if x.strip():
                out.append(_BLANKS.sub(" ", x).strip(" "))
        elif x.hidden:
            continue
        elif x.name == "tr":
            loose = " ".join(_BLANKS.sub(" ", c).strip(" ") for c in x.parts if isinstance(c, str) and c.strip())
            row, at, taken = [(0, 1, loose)] if loose else [], 1 if loose else 0, iter(above)
            below = [(a, e, n - 1) for a, e, n in above if n > 1]
            barrier = next(taken, None)
            for c in x.parts:
                if isinstance(c, str) or c.hidden:
                    continue
                cell: list[str] = []
                yield _lines(_wrapped(c), cell)
                while barrier and barrier[0] <= at:
                    at, barrier = max(at, barrier[1]), next(taken, None)
                row.append((at, at + c.columns, " ".join(t.strip() for t in cell if t)))
                if c.rows != 1:
                    below.append((at, at + c.columns, c.rows - 1 if c.rows else MOST_ROWS))
                at += c.columns
            rows.append(row)
            above = sorted(below)
        elif x.name in ("thead", "tbody", "tfoot"):
            walks.append(iter(x.parts))
            above = []
        else:
            lines: list[str] = []
            yield _lines(_wrapped(x), lines)
            out.extend(lines)
    starts = sorted({a for row in rows for a, _, _ in row})
    cells: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for row in rows:
        for a, e, text in row:
            cells[a].append((bisect_left(starts, e), _width(text)))
    place = [0] * (len(starts) + 1)
    for k, a in enumerate(starts):
        for then, wide in cells[a]:
            place[then] = max(place[then], place[k] + wide + 2)
        place[k + 1] = max(place[k + 1], place[k])
    of = dict(zip(starts, place))
    for row in rows:
        line, wide = [], 0
        for a, _, text in row:
            line.append(" " * (of[a] - wide) + text)
            wide = max(of[a], wide) + _width(text)
        shown = "".join(line).rstrip()
        if shown:
            out.append(shown)
    return out


def _wrapped(part: Node) -> Node:
    if part.name in ("td", "th", "caption"):
        return part
    box = Node("div", pre=part.pre)
    box.parts.append(part)
    return box


def visible_text(html: str | None) -> str:
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    out: list[str] = []
    _run(_lines(builder.root, out))
    return "\n".join(out)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([visible_text(h.as_py()) for h in batch.column(1)], pa.string())],
                                         [batch.schema.names[0], "text"])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of every row. Null and empty pages, and pages that show nothing, give an
    empty text; repeated rows are rendered one by one. Nothing is shuffled."""
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, F.col(html_col)).mapInArrow(_texts, f"{id_col} {kind}, text string")
