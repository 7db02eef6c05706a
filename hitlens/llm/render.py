"""Visible text of HTML, laid out.

A tree builder reads tags in order, closing what the next tag implies (a paragraph before a block, a list item
before the next one, cells and rows of a table), and ignores end tags without a start. A renderer walks the tree
without recursion: hidden elements are left out, runs of white space collapse within a block, paragraphs,
headings and lists are set apart by an empty line, list items get their mark and indentation, table cells are
padded to columns, preformatted text keeps its lines. All visible text is kept, whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlens.llm.common import text_of

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
HIDDEN = {"head", "script", "style", "template", "noscript", "iframe", "noembed", "noframes", "title", "datalist"}
HIDDEN |= {"object", "audio", "video", "canvas"}
# Drawings and formulas are shown, apart from what describes or only defines; titles are hidden anywhere.
FOREIGN = {"svg", "math"}
FOREIGN_HIDDEN = {"desc", "defs", "metadata", "annotation", "annotation-xml"}
# Inside these, content is HTML again; elsewhere in a drawing or formula a start tag of BREAKOUT ends it.
INTEGRATION = {"foreignobject", "desc", "title", "annotation-xml", "mi", "mo", "mn", "ms", "mtext"}
BREAKOUT = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta "
    "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
# Parts of a formula that are set apart.
APART = {"mfrac", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mroot", "mtr"}
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset menu".split())
BLOCK = SPACED | set(
    "address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup "
    "html legend li main nav option optgroup section select summary tbody td tfoot th thead tr text foreignobject mtr".split()
)
# A start tag closes an open element of the second set, unless one of the third set is in between.
_LIST, _TABLE = {"ul", "ol", "menu", "dir"}, {"table"}
IMPLIED = {
    "li": ({"li"}, _LIST),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "caption"}, _TABLE),
    "td": ({"td", "th"}, _TABLE | {"tr"}),
    "th": ({"td", "th"}, _TABLE | {"tr"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, _TABLE),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, _TABLE),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, _TABLE),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
# Elements that an end tag, or an implied one, does not reach beyond.
SCOPE = {"table", "td", "th", "caption", "html", "body"}
CLOSES_P = SPACED | set("address article aside center details dir div dl fieldset figcaption footer form header".split())
CLOSES_P |= {"hgroup", "main", "nav", "section", "summary", "li", "dt", "dd", "td", "th", "tr"}

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S,
)
# A tag with a quote that is never closed, or without an end.
BROKEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDING_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")
# Columns are padded to this width at most; longer cells are written whole and push the rest of their row.
WIDEST_COLUMN = 40
DEEPEST_INDENT = 20


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []


def attributes_of(text: str) -> dict[str, str]:
    if not text.strip(" \t\n\r\f/"):
        return {}
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


def parse(page: str) -> Node:
    """The tree of a page; text is a plain string among the children."""
    root = Node("#root", {})
    open_nodes = [root]
    foreign = [0]  # per open element, the depth of the drawing or formula its content belongs to
    names: dict[str, int] = {}  # open elements by name, so that an unmatched end tag costs nothing

    def close_to(depth: int) -> None:
        for node in open_nodes[depth:]:
            names[node.name] -= 1
        del open_nodes[depth:], foreign[depth:]

    def close(wanted: set[str], limits: set[str]) -> None:
        if not any(names.get(name) for name in wanted):
            return
        for depth in range(len(open_nodes) - 1, 0, -1):
            name = open_nodes[depth].name
            if name in wanted:
                close_to(depth)
                return
            if name in limits:
                return

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at:
            open_nodes[-1].children.append(html.unescape(page[at:start]))
        if start == end:
            break
        match = TAG.match(page, start) or BROKEN_TAG.match(page, start)
        if not match:
            open_nodes[-1].children.append("<")
            at = start + 1
            continue
        at = match.end()
        if match[2] is None:
            if match[0].startswith("<![CDATA["):
                open_nodes[-1].children.append(match[0][9:].removesuffix("]]>"))
            continue
        name = match[2].lower()
        if match[1]:
            if name == "p" and not names.get("p"):
                open_nodes[-1].children.append(Node("p", {}))
            elif name == "br":
                open_nodes[-1].children.append(Node("br", {}))
            else:
                close({name}, SCOPE - {name} if name not in SCOPE else {"table"} - {name})
            continue
        if foreign[-1] and name in BREAKOUT:
            close_to(foreign[-1])
        inside = foreign[-1]
        if not inside and name in CLOSES_P and names.get("p"):
            close({"p"}, SCOPE | _LIST)
        if not inside and name in IMPLIED:
            close(*IMPLIED[name])
        node = Node(name, attributes_of(match[3]))
        open_nodes[-1].children.append(node)
        if inside and name in FOREIGN_HIDDEN:
            node.attributes["hidden"] = ""
        if name in VOID or (match[3].endswith("/") and (inside or name in FOREIGN)):
            continue
        if name in RAW and not inside:
            closing = re.compile(f"</{re.escape(name)}(?=[\\s/>]|$)[^>]*>?", re.I).search(page, at)
            if not closing and name == "noscript":
                continue
            text = page[at : closing.start() if closing else end]
            node.children.append(html.unescape(text) if name in ("textarea", "title") else text)
            at = closing.end() if closing else end
            continue
        open_nodes.append(node)
        if name in FOREIGN:
            inside = inside or len(open_nodes) - 1
        foreign.append(0 if name in INTEGRATION else inside)
        names[name] = names.get(name, 0) + 1
    return root


def hidden(node: Node) -> bool:
    if node.name in HIDDEN:
        return True
    if not node.attributes:
        return False
    style = node.attributes.get("style")
    return (
        "hidden" in node.attributes
        or bool(style and HIDING_STYLE.search(style))
        or (node.name == "input" and node.attributes.get("type", "").lower() == "hidden")
    )


class Layout:
    """Collects lines; ``gap`` is 0 within a line, 1 for a new line, 2 for an empty line before what comes."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.blank = False  # white space is due before the next word
        self.indent = 0
        self.mark = ""

    def start_block(self, gap: int) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line, self.gap = [], 0
        self.gap = max(self.gap, gap)
        self.blank = False

    def _open(self) -> None:
        if not self.line:
            if self.gap == 2 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.line.append("  " * min(self.indent, DEEPEST_INDENT) + self.mark)
            self.mark, self.gap = "", 0

    def text(self, words: str) -> None:
        shown = BLANKS.sub(" ", words)
        body = shown.strip(" ")
        if not body:
            self.blank = self.blank or bool(shown)
            return
        fresh = not self.line
        self._open()
        if not fresh and (self.blank or shown[0] == " "):
            self.line.append(" ")
        self.line.append(body)
        self.blank = shown[-1] == " "

    def breaks(self) -> None:
        self._open()
        self.lines.append("".join(self.line).rstrip())
        self.line, self.blank, self.gap = [], False, 0

    def preformatted(self, text: str) -> None:
        for k, line in enumerate(text.split("\n")):
            if k:
                self._open()
                self.lines.append("".join(self.line).rstrip())
                self.line = []
            if line:
                self._open()
                self.line.append(line)

    def result(self) -> str:
        self.start_block(0)
        return "\n".join(self.lines).strip("\n")


def number(text: str | None) -> int | None:
    """The whole number that an attribute states in up to nine ASCII digits; nothing for any other text."""
    return int(text) if re.fullmatch("-?[0-9]{1,9}", text or "") else None


def item_mark(node: Node, parent: Node, numbers: dict[int, int]) -> str:
    if parent.name != "ol":
        return "- "
    value = number(node.attributes.get("value"))
    if value is None:
        first = number(parent.attributes.get("start"))
        value = numbers.get(id(parent), 1 if first is None else first)
    numbers[id(parent)] = value + 1
    return f"{value}. "


def rows_of(table: Node) -> Iterator[list[Node]]:
    """Rows of cells in order, of this table only; anything else in it is a row of its own."""
    for child in table.children:
        if isinstance(child, str):
            if child.strip():
                yield [child]
        elif hidden(child):
            continue
        elif child.name in ("thead", "tbody", "tfoot"):
            yield from rows_of(child)
        elif child.name == "tr":
            cells = [cell for cell in child.children if not isinstance(cell, str) or cell.strip()]
            yield [cell for cell in cells if isinstance(cell, str) or not hidden(cell)]
        elif child.name not in ("colgroup", "col"):
            yield [child]


def cell_span(cell) -> int:
    span = None if isinstance(cell, str) else number(cell.attributes.get("colspan"))
    return min(span, 100) if span and span > 0 else 1


def table_lines(table: Node, depth: int) -> list[str]:
    """Lines of a table of text cells: one per row, cells padded to their columns."""
    rows, widths = [], []
    for cells in rows_of(table):
        row, column = [], 0
        for cell in cells:
            wrapped = Node("td", {})
            wrapped.children = [cell]
            text = " ".join(line.strip() for line in render(wrapped, depth + 1).split("\n") if line.strip())
            row.append((column, text))
            span = cell_span(cell)
            widths += [0] * (column + span - len(widths))
            if span == 1:
                widths[column] = max(widths[column], min(len(text), WIDEST_COLUMN))
            column += span
        if any(text for _, text in row):
            rows.append(row)
    begins = [3 * column + width for column, width in enumerate(accumulate(widths, initial=0))]
    lines = []
    for row in rows:
        line = ""
        for column, text in row:
            if column:
                line = line.ljust(begins[column] - 3) + " | "
            line += text
        lines.append(line.rstrip())
    return lines


# Tables nested deeper are set as blocks, cell by cell; no text is lost.
DEEPEST_TABLE = 8


def render(root: Node, depth: int = 0) -> str:
    layout, numbers = Layout(), {}
    # Entries: (node or text, parent, entering); a leaving entry undoes what entering set.
    todo = [(child, root, True) for child in reversed(root.children)]
    pre = 0
    while todo:
        node, parent, entering = todo.pop()
        if isinstance(node, str):
            layout.preformatted(node) if pre else layout.text(node)
            continue
        name = node.name
        if not entering:
            if name in ("ul", "ol", "menu", "blockquote", "dd"):
                layout.indent -= 1
            elif name == "li":
                layout.mark = ""
            elif name == "pre":
                pre -= 1
        # A list within a list is not set apart.
        gap = 2 if name in SPACED and not (layout.indent and name in ("ul", "ol", "menu")) else 1
        if not entering:
            if name in BLOCK:
                layout.start_block(gap)
            continue
        if hidden(node):
            continue
        if name == "br":
            layout.breaks()
            continue
        if name == "hr":
            layout.start_block(2)
            continue
        if name == "img" or name == "input":
            label = node.attributes.get("alt" if name == "img" else "value", "")
            if label:
                layout.text(f" {label} " if name == "input" else label)
            continue
        if name == "table" and depth < DEEPEST_TABLE:
            layout.start_block(2)
            for line in table_lines(node, depth):
                layout.start_block(0)
                layout._open()
                layout.line.append(line)
                layout.start_block(1)
            layout.start_block(2)
            continue
        if name in BLOCK:
            layout.start_block(gap)
        if parent.name in APART:
            layout.blank = True
        if name in ("ul", "ol", "menu", "blockquote", "dd"):
            layout.indent += 1
        elif name == "li":
            layout.mark = item_mark(node, parent, numbers)
        elif name == "pre":
            pre += 1
        todo.append((node, parent, False))
        todo += [(child, node, True) for child in reversed(node.children)]
    return layout.result()


def visible_text(page: str) -> str:
    return render(parse(page))


ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _render(batches):
    for batch in batches:
        texts = [visible_text(page.as_py()) for page in batch.column(2)]
        lengths = pa.array([len(text) for text in texts], pa.int64())
        columns = [batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), lengths]
        yield pa.RecordBatch.from_arrays(columns, schema=ARROW)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``, no shuffle.

    A null or empty page gives an empty text; other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_of("html").alias("html"))
    return rows.mapInArrow(_render, "page_id long, url string, text string, n_chars long")
