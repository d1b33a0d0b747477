"""Visible text of HTML pages, laid out as a reader sees it.

A tree builder makes a tree of the page with implied tags (a new ``<p>``, ``<li>``, ``<td>`` … ends the open
one; what is left open ends with its parent). Elements that a browser does not show are left out with all
that they hold. The rest is laid out: blocks stand on their own lines, paragraphs, headings, lists and
tables are set off by an empty line, list items carry ``- `` or their number and are indented by depth, cells
of a table row stand in columns, ``<pre>`` keeps its spaces and ``<br>`` breaks the line. Navigation, footers
and the like are visible text and stay.

Work and memory follow the size of the page: no recursion, each open tag is closed once, and padding is
limited to ``WIDEST`` characters a cell.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

FILLERS = 1 << 20  #: places of a table that cells from rows above may take; none is kept free beyond them
COLUMNS = 1000  #: columns in which such cells are carried
WIDEST = 60  #: cells up to this width are padded to their column's width
DEEPEST_LIST = 20  #: list levels that still indent further

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_HIDDEN = frozenset(
    "head script style template noscript title meta link iframe object video audio canvas svg math noembed"
    " noframes datalist area base param source track map".split())
_PARAGRAPHS = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre table figure fieldset hr xmp listing".split())
_BLOCKS = _PARAGRAPHS | frozenset(
    "html body address article aside center details dialog dir div dd dt figcaption footer form header hgroup"
    " legend li main nav section summary caption tr thead tbody tfoot search optgroup option".split())
_CELLS = frozenset(("td", "th"))
_ROW_GROUPS = frozenset(("thead", "tbody", "tfoot"))
_COLLAPSING = _ROW_GROUPS | {"tr"}  #: ``visibility: collapse`` takes these away with all that they hold
_ENDS_P = _BLOCKS - {"html", "body", "tr", "thead", "tbody", "tfoot", "caption", "option", "optgroup"}
#: opening the key ends these open elements, up to one of the second set
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}), "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
    **{f"h{i}": ({f"h{j}" for j in range(1, 7)}, {"div", "section", "article", "td", "th", "li"}) for i in range(1, 7)},
}
_BARRIER = frozenset("html table td th caption object template button".split())  #: a ``<p>`` is not sought beyond
#: a quote opens a value only directly after "=" and white space; one that is never closed opens none
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^ \t\n\r\f"'>][^ \t\n\r\f>]*+)"""
_TAG = re.compile(rf"""<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?+)?+)*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_UNSHOWN = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?<![-\w])visibility\s*:\s*(visible|initial|hidden|collapse|inherit|unset|revert)(?![-\w])", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class _Node:
    __slots__ = ("tag", "attrs", "children", "shown", "visible")

    def __init__(self, tag: str, attrs: dict[str, str], shown: bool = True, visible: bool = True):
        self.tag, self.attrs, self.shown, self.visible, self.children = tag, attrs, shown, visible, []


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if "=" in source or not source.isspace():
        for name, double, single, bare in _ATTRIBUTE.findall(source):
            out.setdefault(name.lower(), html.unescape(double or single or bare))
    return out


def _shown(tag: str, attrs: dict[str, str]) -> bool:
    if tag in _HIDDEN or "hidden" in attrs and attrs["hidden"] != "until-found":
        return False
    if tag == "dialog" and "open" not in attrs:
        return False
    style = attrs.get("style", "")
    if tag in _COLLAPSING and (_VISIBILITY.findall(style) or [""])[-1].lower() == "collapse":
        return False
    return not _UNSHOWN.search(style)


def _visible(attrs: dict[str, str], inherited: bool) -> bool:
    """The last declaration of visibility, else that of the parent."""
    found = _VISIBILITY.findall(attrs["style"]) if "style" in attrs else []
    value = found[-1].lower() if found else ""
    return value in ("visible", "initial") or value not in ("hidden", "collapse") and inherited


def build_tree(page: str) -> _Node:
    """The tree of a page; texts are strings among the children."""
    root = _Node("#root", {})
    stack, count = [root], defaultdict(int)

    def close(upto: int) -> None:
        while len(stack) > upto:
            count[stack.pop().tag] -= 1

    def end(tags: set, barrier: set | frozenset) -> None:
        """End the outermost open element of ``tags`` that no element of ``barrier`` encloses."""
        if not any(count[t] > 0 for t in tags):
            return
        found = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                found = i
            elif stack[i].tag in barrier:
                break
        if found:
            close(found)

    def text(value: str) -> None:
        if value:
            stack[-1].children.append(html.unescape(value) if "&" in value else value)

    at, pattern, lower = 0, _TAG, None
    while True:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 >= len(page):
            text(page[at:])
            return root
        after = page[lt + 1]
        if after in "!?":
            text(page[at:lt])
            if page.startswith("<!--", lt):
                stop = page.find("-->", lt + 4) if not page.startswith(("<!-->", "<!--->"), lt) else page.find(">", lt) - 2
                at = len(page) if stop < 0 else stop + 3
            else:
                stop = page.find(">", lt)
                at = len(page) if stop < 0 else stop + 1
            continue
        m = pattern.match(page, lt)
        if m is None and pattern is _TAG and (after.isalpha() or after == "/"):
            pattern = _LOOSE_TAG  # a quote is never closed; from here on a tag ends at the next ">"
            m = pattern.match(page, lt)
        if m is None:
            if after.isalpha() and page.find(">", lt) < 0:  # a tag that the page's end cuts off
                text(page[at:lt])
                return root
            text(page[at:lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        tag, source = m[2].lower(), m[3]
        if m[1]:
            if tag == "br":
                stack[-1].children.append(_Node("br", {}))
            elif count[tag] > 0:
                barrier = frozenset() if tag in ("table", "html", "body", "template") else {"table", "template"}
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if stack[i].tag in barrier:
                        break
            elif tag == "p":
                stack[-1].children.append(_Node("p", {}))
            continue
        if tag in ("html", "body") and count[tag] > 0:
            continue
        if tag in _ENDS_P and count["p"] > 0:
            end({"p"}, _BARRIER)
        if tag in _IMPLIED:
            end(*_IMPLIED[tag])
        if count["head"] > 0 and tag not in ("base", "link", "meta", "title", "style", "script", "noscript", "template", "head"):
            end({"head"}, {"html"})
        attrs = _attributes(source) if source else {}
        node = _Node(tag, attrs, _shown(tag, attrs), _visible(attrs, stack[-1].visible))
        stack[-1].children.append(node)
        if tag in _VOID:
            continue
        if tag in _RAW:
            if lower is None:
                lower = page.lower()
                lower = lower if len(lower) == len(page) else None
            stop = lower.find(f"</{tag}", at) if lower is not None else _find(page, f"</{tag}", at)
            body = page[at:] if stop < 0 else page[at:stop]
            if tag in ("textarea", "xmp"):
                node.children.append(html.unescape(body) if tag == "textarea" else body)
            gt = page.find(">", stop) if stop >= 0 else -1
            at = len(page) if gt < 0 else gt + 1
            continue
        if tag == "plaintext":
            node.children.append(page[at:])
            return root
        stack.append(node)
        count[tag] += 1


def _find(page: str, what: str, at: int) -> int:
    m = re.compile(re.escape(what), re.I).search(page, at)
    return m.start() if m else -1


class _Lines:
    """Lines of a page or a cell while it is laid out."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap, self.space, self.prefix = False, False, ""

    def words(self, value: str) -> None:
        value = _SPACES.sub(" ", value)
        if value.startswith(" "):
            self.space, value = True, value[1:]
        if not value:
            return
        if self.parts and self.space:
            self.parts.append(" ")
        self.space = value.endswith(" ")
        self.parts.append(value[:-1] if self.space else value)

    def end_line(self) -> None:
        line = "".join(self.parts)
        if line:
            self.put(line)
        self.parts, self.space = [], False

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(self.prefix + line if line else line)
        if self.prefix:
            self.prefix = " " * len(self.prefix)

    def pre(self, value: str) -> None:
        first, *rest = value.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.parts.append(first)
        for line in rest:
            self.put("".join(self.parts))
            self.parts = [line]


class _Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.groups: set[int] = set()


def _spread(rows: list[list[tuple[list[str], int, int]]], groups: set[int]) -> list[list[tuple[list[str] | None, int]]]:
    """Rows of (lines, columns); ``None`` stands in a column that a cell of a row above takes. A cell spans rows
    up to the end of its row group, and all of them where ``rowspan`` is 0."""
    open_until: dict[int, int] = {}
    out, room = [], FILLERS
    for r, row in enumerate(rows):
        if r in groups:
            open_until.clear()
        cells, column, opened = [], 0, []
        for lines, span, down in row:
            while room and open_until.get(column, 0) > r:
                room -= 1
                cells.append((None, 1))
                column += 1
            cells.append((lines, span))
            if down != 1:
                opened += [(c, r + down if down else len(rows)) for c in range(column, min(column + span, COLUMNS))]
            column += span
        open_until.update(opened)
        out.append(cells)
    return out


def _format(table: _Table) -> list[str]:
    """Cells in columns; a cell over several columns or of great width does not widen a column."""
    rows = _spread(table.rows, table.groups)
    widths: dict[int, int] = defaultdict(int)
    for row in rows:
        column = 0
        for lines, span in row:
            wide = max(map(len, lines or ()), default=0)
            if span == 1 and wide <= WIDEST:
                widths[column] = max(widths[column], wide)
            column += span
    out = []
    for row in rows:
        for k in range(max((len(lines) for lines, _ in row if lines), default=0)):
            line, column, width = [], 0, 0
            for lines, span in row:
                width = sum(widths[c] for c in range(column, column + span)) + 2 * (span - 1)
                column += span
                line.append((lines[k] if lines and k < len(lines) else "").ljust(width))
            out.append("  ".join(line).rstrip())
    return [x for x in out if x]


def _spans(attrs: dict[str, str], name: str, least: int, most: int) -> int:
    """The number of columns or rows of a cell; 1 where it is not a number of at least ``least``."""
    value = attrs.get(name, "1").strip()
    return min(int(value), most) if re.fullmatch(r"[0-9]{1,9}", value) and int(value) >= least else 1


def _chosen(select: _Node) -> list[_Node]:
    """What a closed menu shows: the selected option, else the first."""
    options = [x for c in select.children if isinstance(c, _Node)
               for x in ([c] if c.tag == "option" else c.children if c.tag == "optgroup" else ())
               if isinstance(x, _Node) and x.tag == "option"]
    return [x for x in options if "selected" in x.attrs][-1:] or options[:1]


def render(root: _Node) -> str:
    """Text of a tree."""
    out = _Lines()
    buffers, tables, lists = [out], [], []
    pre = 0
    work: list[tuple[bool, _Node | str]] = [(True, root)]
    while work:
        opening, node = work.pop()
        lines = buffers[-1]
        if isinstance(node, str):
            if pre:
                lines.pre(node)
            else:
                lines.words(node)
            continue
        tag = node.tag
        if opening:
            if not node.shown or tag == "input":
                continue
            if tag == "br":
                line = "".join(lines.parts)
                lines.put(line) if line or pre else None
                lines.parts, lines.space = [], False
                continue
            if tag in _CELLS and tables:
                if not tables[-1].rows:
                    tables[-1].rows.append([])
                buffers.append(_Lines())
            elif tag in _BLOCKS:
                lines.end_line()
                if tag in _PARAGRAPHS and not (tag in ("ul", "ol", "menu") and lists):
                    lines.gap = True
            if tag == "table":
                tables.append(_Table())
                buffers.append(_Lines())
            elif tag == "tr" and tables:
                tables[-1].rows.append([])
            elif tag in _ROW_GROUPS and tables:
                tables[-1].groups.add(len(tables[-1].rows))
            elif tag in ("ul", "ol", "menu", "dir"):
                start = node.attrs.get("start", "")
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                numbered, number = lists[-1] if lists else (False, 1)
                if lists:
                    lists[-1][1] += 1
                mark = f"{number}. " if numbered else "- "
                work.append((False, _Node("#li", {"before": lines.prefix})))
                mark = mark if node.visible else " " * len(mark)
                lines.prefix = "  " * min(max(len(lists) - 1, 0), DEEPEST_LIST) + mark
                work.append((False, node))
                work.extend((True, c) for c in reversed(node.children) if node.visible or isinstance(c, _Node))
                continue
            elif tag in ("pre", "xmp", "listing", "textarea", "plaintext"):
                pre += 1
                if node.children and isinstance(node.children[0], str):
                    node.children[0] = node.children[0].removeprefix("\n")
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, _Node) and c.tag == "summary"][:1]
            elif tag == "select" and "multiple" not in node.attrs and node.attrs.get("size", "1") == "1":
                children = _chosen(node)
            work.append((False, node))
            work.extend((True, c) for c in reversed(children) if node.visible or isinstance(c, _Node))
            continue
        if tag == "#li":
            lines.prefix = node.attrs["before"]
        elif tag in _CELLS and tables and len(buffers) > 1:
            lines.end_line()
            buffers.pop()
            tables[-1].rows[-1].append((lines.lines, _spans(node.attrs, "colspan", 1, 1000), _spans(node.attrs, "rowspan", 0, 65534)))
        elif tag == "table":
            lines.end_line()
            buffers.pop()
            around = buffers[-1]
            for line in lines.lines + _format(tables.pop()):  # captions and strays stand above the rows
                around.put(line)
            around.gap = True
        elif tag in ("ul", "ol", "menu", "dir"):
            lines.end_line()
            lists.pop()
            lines.gap = lines.gap or not lists
        elif tag in _BLOCKS or tag == "textarea":
            if tag in _ROW_GROUPS and tables:
                tables[-1].groups.add(len(tables[-1].rows))
            if pre and tag in ("pre", "xmp", "listing", "textarea", "plaintext"):
                pre -= 1
            lines.end_line()
            if tag in _PARAGRAPHS:
                lines.gap = True
    out.end_line()
    return "\n".join(line.rstrip() for line in out.lines)


def page_text(page: str | None) -> str:
    """Visible text of one page; the empty text for null, empty and invisible pages."""
    return render(build_tree(page)) if page else ""


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [page_text(x.as_py()) for x in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], ["id", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id`` and ``text`` of every page, in the rows' own partitions.

    Null and empty pages have the empty text, repeated rows and null ids stay rows of their own, other
    columns are left out, and no rows give no rows.
    """
    rows = pages.select(pages[id_col].alias("id"), pages[html_col].alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_texts, f"id {kind}, text string")
