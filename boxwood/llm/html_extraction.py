"""HTML extraction: a tree builder with implied tags and visibility rules, then a layout pass.

The tokenizer reads tags, comments, declarations and character references;
the tree builder closes what a start tag ends by implication (p, li, dt/dd,
option, table parts), ignores stray end tags (but a stray ``</br>`` or ``</p>`` is an empty element, in a cell the latter a space), and drops nothing else; the places
of open elements are kept by name, so its work grows with the page, however deep it is. The
layout pass walks the tree without recursion: hidden elements (script, style,
head parts, ``hidden``, ``aria-hidden=true``, ``display:none``,
closed dialogs, inputs other than buttons with a label, options that a closed list doesn't show) give no text, those with
``visibility:hidden`` only that of children that are made visible again; blocks
are set apart by line breaks (paragraphs and headings by a blank line), list
items get a bullet or number and are indented by depth, ``pre`` keeps its white space,
and table cells are padded to the width of their columns, those over several columns or rows to all of them.
A cell of several lines (blocks, lists, inner tables) is laid out as those lines beside the
cells of its row. A table whose rows hold one cell each is a column of blocks, not padded. A column is
padded to ``PAD`` characters at most: longer cells stand whole, what is right of them moves on. Columns
that begin beyond ``PAD_LINE`` characters are not padded to, so a line has no more padding than that; how
many rows a table has or how long its text is changes nothing. Cells in tables
within ``NESTED`` others are blocks, too, and cells beyond the thousandth column don't reach into rows below.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from boxwood.llm.common import quoted, table

#: Classes of elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
UNSEEN = frozenset("script style head title meta link template noscript noembed noframes iframe object audio video canvas datalist param source track base area rp desc defs metadata symbol annotation annotation-xml".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr".split())
BLOCKS = PARAGRAPHS | frozenset(
    "html body address article aside center details dialog dd div dt figcaption footer form header hgroup legend li main menu nav search section summary tr caption thead tbody tfoot option optgroup".split()
)
CLOSES_P = (PARAGRAPHS | frozenset("address article aside center details dialog dir div dl fieldset figcaption footer form header hgroup main menu nav search section summary li dd dt".split())) - {"p"} | {"p"}
#: A start tag ends these open elements, up to the nearest of the others.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: A p is not closed through these.
SCOPE = frozenset("table td th caption button object template html body".split())

_MARKUP = re.compile(r"<(?:!--.*?(?:--!?>|$)|[!?][^>]*(?:>|$)|/([A-Za-z][^\s/>]*)[^>]*(?:>|$)|([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$))", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s"'>]+))?""")
_HIDING = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
#: The most columns and rows that a cell may span in the HTML standard.
_COLUMNS, _ROWS = 1000, 65534
#: The widest padding of a column, and where the last column begins that lines are padded to.
PAD, PAD_LINE = 40, 160
#: Characters of texts that a task gives on at a time.
_HELD = 1 << 24
#: Tables in more tables than these are blocks.
NESTED = 6
#: Inputs whose value is a label.
BUTTONS = frozenset("submit button reset".split())
_SPACE = re.compile(r"[\x20\t\n\r\f]+")


class Element:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        if value[:1] in "\"'" and value:
            value = value[1:-1] if value[-1:] == value[0] and len(value) > 1 else value[1:]
        found.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return found


class Open:
    """The open elements, and where those of each name stand."""

    def __init__(self, root: Element):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Element) -> None:
        self.places.setdefault(node.name, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """Closes the element at this place and all in it."""
        while len(self.nodes) > at:
            self.places[self.nodes.pop().name].pop()

    def last(self, names: Iterable[str]) -> int:
        """Place of the innermost element with one of these names, 0 for none."""
        places = self.places
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def imply(self, name: str) -> None:
        """Closes what a start tag ends."""
        if name in CLOSES_P and self.places.get("p"):
            p = self.places["p"][-1]
            if p > self.last(SCOPE):
                self.cut(p)
        if name in IMPLIED:
            ends, stops = IMPLIED[name]
            stop = self.last(stops)
            found = [own[at] for x in ends if (own := self.places.get(x)) and (at := bisect_right(own, stop)) < len(own)]
            if found:
                self.cut(min(found))

    def close(self, name: str) -> None:
        """An end tag: ends the innermost element of its name, but doesn't reach out of a cell or table unless it is a table's part."""
        at = self.places[name][-1] if self.places.get(name) else 0
        if at and (name in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or at >= self.last(("td", "th", "table"))):
            self.cut(at)
        elif name == "p" and self.last(("td", "th")) > self.last(("table",)):
            self.nodes[-1].children.append(" ")
        elif name in ("br", "p"):
            self.nodes[-1].children.append(Element(name, {}))


def parse(markup: str) -> Element:
    """The tree of a page. Anything parses; a part that is no markup is text."""
    root = Element("#root", {})
    open_, at, end = Open(root), 0, len(markup)
    while at < end:
        m = _MARKUP.search(markup, at)
        text = markup[at : m.start() if m else end]
        if text:
            open_.nodes[-1].children.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[1]:
            open_.close(m[1].lower())
        elif m[2]:
            name, raw = m[2].lower(), m[3] or ""
            open_.imply(name)
            node = Element(name, _attributes(raw) if raw.strip("/ ") else {})
            open_.nodes[-1].children.append(node)
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(markup, at)
                body = markup[at : close.start() if close else end]
                node.children.append(html.unescape(body) if name in ("textarea", "title") else body)
                at = markup.find(">", close.start()) + 1 or end if close else end
            elif name not in VOID:
                open_.push(node)
    return root


def visible(node: Element) -> bool:
    if node.name in UNSEEN or "hidden" in node.attrs:
        return False
    a = node.attrs
    if not a:
        return node.name != "dialog"
    if a.get("aria-hidden", "").lower() == "true" or node.name == "dialog" and "open" not in a:
        return False
    return not ("style" in a and _HIDING.search(a["style"]))


def _shown(node: Element, around: bool) -> bool:
    """Whether text in node is visible, if that around it is or isn't."""
    found = _VISIBILITY.findall(node.attrs.get("style", "")) if node.attrs else ()
    return found[-1].lower() == "visible" if found else around


def _choose(select: Element) -> None:
    """Hides the options that a closed list doesn't show: all but the last selected one, or else the first. An open list shows all."""
    if "multiple" in select.attrs or re.fullmatch(r"0*(?:[2-9]|[1-9]\d+)", select.attrs.get("size", "").strip()):
        return
    options, todo = [], [select]
    while todo:
        node = todo.pop()
        if node.name == "option":
            options.append(node)
        todo += [x for x in reversed(node.children) if isinstance(x, Element)]
    chosen = ([x for x in options if "selected" in x.attrs] or options[:1])[-1:]
    for x in options:
        if x not in chosen:
            x.attrs = {"hidden": ""}


def _span(node: Element, name: str, most: int) -> int:
    value = node.attrs.get(name, "").strip()
    return max(1, min(most, int(value))) if re.fullmatch(r"[0-9]{1,9}", value) else 1


class Page:
    """Lines of text; gap: line breaks that the next text needs before it."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.gap, self.space, self.started = 0, False, False
        self.prefix = ""

    def text(self, raw: str, pre: bool) -> None:
        if pre:
            if raw:
                self._open()
                self.out.append(raw)
                self.space = False
            return
        shrunk = _SPACE.sub(" ", raw)
        if shrunk in ("", " "):
            self.space |= bool(shrunk)
            return
        body = shrunk.strip(" ")
        if not self.gap and self.started and (self.space or shrunk[0] == " "):
            self.out.append(" ")
        self._open()
        self.out.append(body)
        self.space = shrunk[-1] == " "

    def _open(self) -> None:
        if self.gap and self.started:
            self.out.append("\n" * self.gap)
        if self.prefix:
            self.out.append(self.prefix)
            self.prefix = ""
        self.gap, self.started = 0, True

    def brk(self, lines: int) -> None:
        self.gap = max(self.gap, lines)
        self.space = False

    def line(self) -> None:
        """A br."""
        self.gap = min(2, self.gap + 1)
        self.space = False

    def done(self) -> str:
        return "".join(self.out)


def render(root: Element) -> str:
    """All visible text under root. Deep pages need no deep Python stack: open elements wait in a list."""
    page = Page()
    #: (element, next child, list depth, counter of an ordered list, pre, whether text is shown, whether it began a page of its own)
    todo: list[list] = [[root, 0, 0, None, False, True, False]]
    #: Tables that are open: the page around, and the rows of cells.
    tables: list[tuple[Page, list[list[Cell]]]] = []
    cells: list[Page] = []
    deep = 0  # open tables that are blocks
    while todo:
        frame = todo[-1]
        node, i, depth, counter, pre, shown, apart = frame
        if i >= len(node.children):
            todo.pop()
            name = node.name
            if apart and name != "table":
                cell, page = page, cells.pop()
                tables[-1][1][-1].append((cell.done(), _span(node, "colspan", _COLUMNS), _span(node, "rowspan", _ROWS)))
            elif apart:
                inner = page
                page, rows = tables.pop()
                text = "\n".join(x for x in (inner.done(), align(rows)) if x)
                if text:
                    page.brk(2)
                    page.text(text, True)
                page.brk(2)
            elif name in PARAGRAPHS:
                if name == "table":
                    deep -= 1
                page.brk(1 if name in ("ul", "ol", "dl") and depth > 1 else 2)
            elif name in BLOCKS or name in ("td", "th"):
                page.brk(1)
            if name == "li":
                page.prefix = ""
            continue
        frame[1] += 1
        child = node.children[i]
        if isinstance(child, str):
            if node.name in ("table", "tr", "thead", "tbody", "tfoot") and not child.strip():
                continue
            if shown:
                child = child.replace("\r\n", "\n") if pre else child
                page.text(child.removeprefix("\n") if node.name == "pre" and i == 0 else child, pre)
            continue
        if not visible(child):
            continue
        name = child.name
        if name == "select":
            _choose(child)
        if name == "br":
            page.line()
            continue
        if name == "hr":
            page.brk(2)
            continue
        if name == "input" and child.attrs.get("type", "").strip().lower() in BUTTONS and _shown(child, shown):
            page.text(child.attrs.get("value", ""), False)
        if name in ("img", "wbr", "input"):
            continue
        inside = [child, 0, depth, None, pre or name == "pre", _shown(child, shown), False]
        if name == "table" and not deep and len(tables) < NESTED:
            tables.append((page, []))
            page, inside[6] = Page(), True
        elif name == "table":
            deep += 1
            page.brk(2)
        elif name == "tr" and tables and not deep:
            tables[-1][1].append([])
        elif name in ("td", "th") and (deep or not tables):
            page.brk(1)
        elif name in ("td", "th"):
            inside[6] = True
            if not tables[-1][1]:
                tables[-1][1].append([])
            cells.append(page)
            page = Page()
        elif name in ("ul", "ol", "menu", "dl"):
            inside[2] = depth + 1
            if name == "ol":
                start = child.attrs.get("start", "1")
                inside[3] = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
            page.brk(1 if depth else 2)
        elif name == "li":
            page.brk(1)
            mark = "- "
            if counter is not None:
                mark = f"{counter}. "
                frame[3] = counter + 1
            page.prefix = "  " * max(0, depth - 1) + mark
        elif name == "dd":
            page.brk(1)
            page.prefix = "  " * depth
        elif name in PARAGRAPHS:
            page.brk(1 if page.prefix else 2)
        elif name in BLOCKS:
            page.brk(1)
        todo.append(inside)
    return page.done()


#: Text, columns, rows.
Cell = tuple[str, int, int]


class Taken:
    """Columns that cells above still reach into, as bits, and until which row."""

    def __init__(self) -> None:
        self.row, self.bits = 0, 0
        self.held: list[tuple[int, int]] = []  # a heap of (the row that is free again, bits)

    def place(self, row: list[Cell]) -> list[tuple[int, int, str]]:
        """First column, the one behind, and text of each cell of the next row."""
        while self.held and self.held[0][0] <= self.row:
            self.bits &= ~heappop(self.held)[1]
        own, column, below = [], 0, []
        for text, columns, reach in row:
            free = ~self.bits >> column
            column += (free & -free).bit_length() - 1
            own.append((column, column + columns, text))
            if reach > 1 and column < _COLUMNS:
                below.append((self.row + reach, (1 << min(column + columns, _COLUMNS)) - (1 << column)))
            column += columns
        for x in below:
            heappush(self.held, x)
            self.bits |= x[1]
        self.row += 1
        return own


def align(rows: list[list[Cell]]) -> str:
    """Rows of cells as lines; every column as wide as its widest line, up to PAD. Cells of several lines stand beside the others of their row. Rows without text give none."""
    taken = Taken()
    placed = [own for own in map(taken.place, filter(None, rows)) if any(text for *_, text in own)]
    if all(len(own) == 1 for own in placed):
        return "\n".join(own[0][2] for own in placed)
    # Columns are numbered by the places where cells begin and end, so that wide spans cost no more than others.
    place = {x: k for k, x in enumerate(sorted({x for own in placed for cell in own for x in cell[:2]}))}
    cut = [[(place[a], place[b], text.split("\n")) for a, b, text in own] for own in placed]
    widths = [0] * len(place)
    wide = []
    for own in cut:
        for a, b, lines in own:
            longest = min(PAD, max(map(len, lines)))
            if b == a + 1:
                widths[a] = max(widths[a], longest)
            else:
                wide.append((a, b, longest))
    starts = [0, *accumulate(w + 3 for w in widths)]
    more = [0] * len(starts)
    for a, b, longest in wide:  # what a cell over several columns lacks is added before the column behind it
        more[b] = max(more[b], longest + 3 - (starts[b] - starts[a]))
    starts = [x + y for x, y in zip(starts, accumulate(more), strict=True)]
    return _laid(cut, [x if x <= PAD_LINE else 0 for x in starts])


def _laid(cut: list[list[tuple[int, int, list[str]]]], starts: list[int]) -> str:
    """The lines of the rows with their columns at starts."""
    out = []
    for own in cut:
        k, left = 0, own[: max(i for i, x in enumerate(own) if x[2] != [""]) + 1]  # after the first line, only the cells that go on are looked at
        while left:
            line, length = [], 0
            for a, _, lines in left:
                if not lines[k] and k:
                    continue
                if a:
                    gap = max(0, starts[a] - 3 - length)
                    line.append(" " * gap + " | ")
                    length += gap + 3
                line.append(lines[k])
                length += len(lines[k])
            out.append("".join(line).rstrip(" "))
            k += 1
            left = [x for x in left if len(x[2]) > k]
    return "\n".join(out)


def extract_html(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row for each row of df: id, text (the visible text of the page).

    A null or empty page gives an empty text; a very long or deep one is read
    whole. Repeated rows stay; other columns, whatever their names, are not read; an empty
    table gives an empty result.
    """
    kind = dict(df.dtypes)[id_col]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts, held = 0, [], 0
            for row, x in enumerate(batch.column(1).to_pylist()):
                texts.append(render(parse(x)) if x else "")
                held += len(texts[-1])
                if held > _HELD or row + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(texts, pa.string())], names=[id_col, "text"])
                    at, texts, held = row + 1, [], 0

    return df.select(quoted(id_col), quoted(html_col)).mapInArrow(extract, f"{quoted(id_col)} {kind}, text string")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(table(spark, sf_dir, "pages"))
