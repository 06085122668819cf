"""Layout-aware rendering of HTML to text.

A tokeniser and a tree builder with implied tags make a tree of any input; visibility rules prune it; a renderer emits all
visible text with block spacing, list markers and aligned table cells.

Tree: void elements take no children; `head` ends at the first thing that can't be in it; a paragraph ends at a block, a
list item at its sibling, a cell, row or row group at the next of its kind, an option at the next; an end tag closes up to
its element unless a table cell or the like stands between; others are ignored. Elements nested deeper than MAX_DEPTH
become siblings, so their text is kept.

Visibility: rules of the page's own style sheets count as far as their selectors name an element, its classes and id,
without combinators, outside at-rules but those for screens, the most specific and then the last rule winning, an inline
style over all. Head matter, scripts, styles, templates, noscript, media fallbacks and data lists are not shown, nor elements
that are `hidden`, `display: none`, a closed dialog, or a hidden input; `visibility: hidden` hides text until a descendant
says `visible`. Closed details are shown, since their text is the page's. Of drawings (svg) the text labels and foreign
objects are shown, of formulas (MathML) all but annotations and phantoms.

Layout: white space collapses except in `pre`, `textarea`, `listing`; paragraphs, headings, lists, tables and the like are
set off by a blank line, other blocks by a line break; nested lists are indented; ordered lists count from `start`, with
`value` and `reversed`; a table's cells line up in columns, spans counted, cells of more than CELL_PAD characters not
padded after. Blocks, lists and tables in a cell keep their lines: those of cells side by side stand side by side. A table
is one for layout, whose cells follow one another as blocks, if a cell has a blank line or several lines of which one is
longer than CELL_PAD.

Defined results: null gives an empty text; so does a page without visible text. Any malformed input gives a text. Repeated
rows are rendered one by one; an empty table gives an empty one. Other columns stay as they are, but for a column of the
output's name, which the text replaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, spread

MAX_DEPTH = 250
CELL_PAD = 40
#: Columns that one span may cover, as browsers have it.
MAX_SPAN = 1000

_words = lambda s: frozenset(s.split())
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style xmp iframe noembed noframes")
ESCAPABLE = _words("textarea title")
HEAD = _words("title meta link base style script template noscript basefont bgsound")
NOT_SHOWN = _words(
    "head script style template noscript noembed noframes iframe title meta link base object video audio canvas datalist area param source track rp"
)
#: Elements of a drawing and of a formula that have no visible text.
DRAWN_UNSEEN = _words("title desc defs metadata symbol clippath mask pattern marker lineargradient radialgradient filter")
MATH_UNSEEN = _words("annotation annotation-xml mphantom")
SPACED = _words("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset listing menu")
BLOCK = SPACED | _words(
    "html body div section article aside header footer nav main address li dt dd tr thead tbody tfoot caption form figcaption details summary legend center dir dialog hgroup search option optgroup"
)
ENDS_P = (BLOCK - _words("tr thead tbody tfoot caption option optgroup html body legend")) | _words("plaintext")
#: An element's start ends an open one of these, unless one of those stands between.
IMPLIED = {
    "li": (_words("li"), _words("ul ol menu dir table")),
    "dt": (_words("dt dd"), _words("dl table")),
    "dd": (_words("dt dd"), _words("dl table")),
    "td": (_words("td th"), _words("table")),
    "th": (_words("td th"), _words("table")),
    "tr": (_words("tr"), _words("table")),
    "thead": (_words("thead tbody tfoot caption colgroup"), _words("table")),
    "tbody": (_words("thead tbody tfoot caption colgroup"), _words("table")),
    "tfoot": (_words("thead tbody tfoot caption colgroup"), _words("table")),
    "option": (_words("option"), _words("select datalist optgroup")),
    "optgroup": (_words("optgroup"), _words("select")),
    "body": (_words("head"), _words("body")),
}
SCOPE = _words("table td th caption button object")
KEEPS_SPACE = _words("pre textarea listing xmp plaintext")

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|<(?:[!?]|/[^a-zA-Z])[^>]*>?", re.S
)
ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?", re.S)
SPACES = re.compile(r"[ \t\n\f\r]+")
RULE = re.compile(r"[{}]|[^{}]+")
SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
SCREENS = ("", "all", "screen", "only screen")
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-zA-Z-]+)", re.I)


class Node:
    """An element; kids are nodes and strings. A root has the page's style sheets as well."""

    __slots__ = ("tag", "raw", "kids", "sheets")

    def __init__(self, tag: str, raw: str = "") -> None:
        self.tag, self.raw, self.kids, self.sheets = tag, raw, [], None

    def attrs(self) -> dict[str, str]:
        out: dict[str, str] = {}
        if self.raw:
            for m in ATTR.finditer(self.raw):
                out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        return out


def parse(html: str) -> Node:
    """The tree of a page; its root has the whole page below it."""
    root = Node("#root")
    root.sheets = []
    stack = [root]

    def text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and not s.isspace():
                stack.pop()
            stack[-1].kids.append(s)

    # no tag ends behind the last >, so none is looked for there
    at, end, limit = 0, len(html), html.rfind(">") + 1
    while at < end:
        m = TOKEN.search(html, at, limit)
        if m is None:
            text(unescape(html[at:]))
            break
        if m.start() > at:
            text(unescape(html[at : m.start()]))
        at = m.end()
        tag = m[2]
        if tag is None:
            if at == limit and m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>", "<!-->", "<!--->")):
                break
            continue
        tag = tag.lower()
        if m[1]:
            _close(stack, tag)
            continue
        if stack[-1].tag == "head" and tag not in HEAD:
            stack.pop()
        if tag in ENDS_P:
            _end_implied(stack, _words("p"), SCOPE)
        rule = IMPLIED.get(tag)
        if rule:
            _end_implied(stack, *rule)
        raw = m[3]
        node = Node(tag, raw)
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        stack[-1].kids.append(node)
        if raw.endswith("/") and any(n.tag in ("svg", "math") for n in stack):
            continue
        if tag in RAW or tag in ESCAPABLE:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            body = html[at : stop.start() if stop else end]
            node.kids.append(unescape(body) if tag in ESCAPABLE else body)
            if tag == "style" and node.attrs().get("media", "").strip().lower() in SCREENS:
                root.sheets.append(body)
            at = stop.end() if stop else end
        elif tag == "plaintext":
            node.kids.append(html[at:])
            at = end
        elif tag not in VOID and len(stack) < MAX_DEPTH:
            stack.append(node)
    return root


def _end_implied(stack: list[Node], ends: frozenset, bars: frozenset) -> None:
    for i in range(len(stack) - 1, 0, -1):
        tag = stack[i].tag
        if tag in ends:
            del stack[i:]
            return
        if tag in bars:
            return


def _close(stack: list[Node], tag: str) -> None:
    if tag in ("html", "body"):
        return
    if tag == "br":
        stack[-1].kids.append(Node("br"))
        return
    bars = _words("table") if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li") else SCOPE
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if stack[i].tag in bars and tag != "table":
            return
    if tag == "p":
        stack[-1].kids.append(Node("p"))


class Sheet:
    """The rules of a page's style sheets that say what is displayed or visible, by the rarest part of their selectors."""

    def __init__(self, sheets: list[str]) -> None:
        self.rules: dict[str, list[tuple]] = {}
        for css in sheets:
            if "display" in css.lower() or "visibility" in css.lower():
                self._read(re.sub(r"/\*.*?(?:\*/|\Z)", " ", css, flags=re.S))

    def _read(self, css: str) -> None:
        heads: list[str] = []
        head = ""
        for m in RULE.finditer(css):
            if m[0] == "{":
                heads.append(head.strip())
                head = ""
            elif m[0] == "}":
                heads and heads.pop()
                head = ""
            else:
                head = m[0].rpartition(";")[2]
                *around, selector = heads or [""]
                if selector and not selector.startswith("@") and all(re.sub(r"\s+", " ", h[6:].strip().lower()) in SCREENS[1:] and h.lower().startswith("@media") for h in around):
                    said = {k.lower(): v.lower() for k, v in DECLARED.findall(m[0])}
                    for one in selector.split(",") if said else ():
                        self._add(one.strip(), said)

    def _add(self, selector: str, said: dict[str, str]) -> None:
        m = SELECTOR.fullmatch(selector)
        if not m or not selector:
            return
        marks = frozenset(re.findall(r"[.#][\w-]+", m[2]))
        tag = (m[1] or "*").lower()
        ids = sum(x[0] == "#" for x in marks)
        weight = (ids, len(marks) - ids, tag != "*", len(self.rules), sum(map(len, self.rules.values())))
        key = min(marks, key=lambda x: (x[0] != "#", x)) if marks else tag
        self.rules.setdefault(key, []).append((weight[:3], weight[4], tag, marks, said))

    def of(self, node: Node) -> dict[str, str]:
        """What the rules say of an element."""
        marks: set[str] = set()
        low = node.raw.lower()
        if "class" in low or "id" in low:
            a = node.attrs()
            marks = {f".{x}" for x in a.get("class", "").split()} | ({f"#{a['id']}"} if a.get("id") else set())
        found = [r for key in (*marks, node.tag, "*") for r in self.rules.get(key, ()) if r[2] in ("*", node.tag) and r[3] <= marks]
        out: dict[str, str] = {}
        for rule in sorted(found, key=lambda r: (r[0], r[1])):
            out |= rule[4]
        return out


def shown(node: Node, seen: bool, sheet: Sheet | None = None) -> tuple[bool, bool]:
    """Whether an element takes part in the layout, and whether its text is visible."""
    if node.tag in NOT_SHOWN:
        return False, seen
    said = sheet.of(node) if sheet is not None and sheet.rules else {}
    raw = node.raw
    if raw:
        low = raw.lower()
        if "hidden" in low or "style" in low:
            a = node.attrs()
            if "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
                return False, seen
            said = said | {k.lower(): v.lower() for k, v in DECLARED.findall(a.get("style", ""))}
    if said.get("display") == "none":
        return False, seen
    if said.get("visibility") in ("hidden", "collapse", "visible"):
        seen = said["visibility"] == "visible"
    if node.tag == "dialog" and "open" not in node.attrs():
        return False, seen
    return True, seen


class Page:
    """Lines in the making."""

    def __init__(self, sheet: Sheet | None = None) -> None:
        self.sheet = sheet
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.space = False
        self.indent = ""
        self.marker = ""

    def flush(self) -> None:
        if self.line:
            if self.gap == 2 and self.lines:
                self.lines.append("")
            if self.marker:
                lead = self.indent[: len(self.indent) - len(self.marker)] + self.marker
                self.marker = ""
            else:
                lead = self.indent
            self.lines.append(lead + "".join(self.line))
            self.line, self.gap = [], 1
        self.space = False

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def text(self, s: str) -> None:
        words = SPACES.sub(" ", s)
        if not words:
            return
        if words[0] == " ":
            self.space = True
            words = words[1:]
            if not words:
                return
        if self.space and self.line:
            self.line.append(" ")
        self.space = words[-1] == " "
        self.line.append(words[:-1] if self.space else words)

    def kept(self, s: str) -> None:
        """Text whose white space counts."""
        first, *rest = s.replace("\r\n", "\n").split("\n")
        for i, part in enumerate([first, *rest]):
            if i:
                if not self.line:
                    self.line.append("")
                self.flush()
            if part:
                self.line.append(part)

    def done(self) -> str:
        self.flush()
        return "\n".join(x.rstrip(" ") for x in self.lines).strip("\n")


def _number(s: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", s or "")
    return int(m[1]) if m else default


def _children(node: Node, page: Page, seen: bool, keep: bool) -> None:
    for kid in node.kids:
        if isinstance(kid, str):
            if seen:
                page.kept(kid) if keep else page.text(kid)
        else:
            _render(kid, page, seen, keep)


def _render(node: Node, page: Page, seen: bool, keep: bool) -> None:
    ok, seen = shown(node, seen, page.sheet)
    if not ok:
        return
    tag = node.tag
    if tag == "br":
        if not page.line:
            page.line.append("") if page.lines else None
        page.flush()
    elif tag == "table":
        page.block(2)
        _table(node, page, seen)
        page.block(2)
    elif tag in ("ul", "ol", "menu", "dir"):
        _list(node, page, seen)
    elif tag == "svg":
        _drawing(node, page, seen)
    elif tag == "math":
        gap = "block" in node.raw and node.attrs().get("display", "").lower() == "block"
        if gap:
            page.block(1)
        _formula(node, page, seen)
        if gap:
            page.block(1)
    elif tag in BLOCK:
        gap = 2 if tag in SPACED else 1
        page.block(gap)
        inner = page.indent
        if tag in ("blockquote", "dd"):
            page.indent += "  "
        _children(node, page, seen, keep or tag in KEEPS_SPACE)
        page.block(gap)
        page.indent = inner
    elif tag in KEEPS_SPACE:
        _children(node, page, seen, True)
    elif tag not in VOID:
        _children(node, page, seen, keep)


def _drawing(node: Node, page: Page, seen: bool) -> None:
    """The labels of a drawing, set off by spaces, and the pages within it; other strings in a drawing are not shown."""
    for kid in node.kids:
        if isinstance(kid, str) or kid.tag in DRAWN_UNSEEN:
            continue
        ok, inside = shown(kid, seen, page.sheet)
        if not ok or ("display" in kid.raw and kid.attrs().get("display") == "none"):
            continue
        if kid.tag in ("text", "foreignobject"):
            page.space = True
            _children(kid, page, inside, False)
            page.space = True
        else:
            _drawing(kid, page, inside)


def _formula(node: Node, page: Page, seen: bool) -> None:
    for kid in node.kids:
        if isinstance(kid, str):
            if seen:
                page.text(kid)
        elif kid.tag.startswith("m") and kid.tag not in MATH_UNSEEN or kid.tag == "semantics":
            ok, inside = shown(kid, seen, page.sheet)
            if ok:
                _formula(kid, page, inside)
        elif kid.tag not in MATH_UNSEEN:
            _render(kid, page, seen, False)


def _list(node: Node, page: Page, seen: bool) -> None:
    outer, nested = page.indent, bool(page.indent)
    gap = 1 if nested else 2
    page.block(gap)
    a = node.attrs() if node.tag == "ol" else {}
    step = -1 if "reversed" in a else 1
    items = sum(1 for k in node.kids if isinstance(k, Node) and k.tag == "li")
    number = _number(a.get("start"), items if step < 0 else 1)
    for kid in node.kids:
        if isinstance(kid, str):
            if seen:
                page.indent = outer + "  "
                page.text(kid)
            continue
        if kid.tag != "li":
            page.indent = outer + "  "
            _render(kid, page, seen, False)
            continue
        ok, inside = shown(kid, seen, page.sheet)
        if not ok:
            continue
        page.block(1)
        mark = "- "
        if node.tag == "ol":
            number = _number(kid.attrs().get("value"), number) if kid.raw else number
            mark = f"{number}. "
            number += step
        page.indent, page.marker = outer + " " * len(mark), mark
        before = len(page.lines)
        _children(kid, page, inside, False)
        page.flush()
        if len(page.lines) == before:
            page.marker = ""
        page.block(1)
    page.flush()
    page.indent = outer
    page.block(gap)


def _table(node: Node, page: Page, seen: bool) -> None:
    """Rows of cells, each with its lines. What stands in a table outside its rows is set before it."""
    rows: list[list[tuple[int, int, list[str]]]] = []

    def cell(n: Node, seen: bool) -> list[str]:
        inner = Page(page.sheet)
        _children(n, inner, seen, False)
        lines = inner.done().split("\n")
        return [lines[0].strip()] if len(lines) == 1 else lines

    def walk(n: Node, seen: bool) -> None:
        row: list[tuple[int, int, list[str]]] | None = None
        for kid in n.kids:
            if isinstance(kid, str):
                if seen and not kid.isspace():
                    page.text(kid)
                continue
            ok, inside = shown(kid, seen, page.sheet)
            if not ok:
                continue
            if kid.tag in ("thead", "tbody", "tfoot", "tr"):
                if kid.tag == "tr":
                    rows.append([])
                walk(kid, inside)
                row = None
            elif kid.tag in ("td", "th"):
                if n.tag == "tr":
                    row = rows[-1]
                elif row is None:
                    rows.append([])
                    row = rows[-1]
                a = kid.attrs()
                wide = min(MAX_SPAN, max(1, _number(a.get("colspan"), 1)))
                high = min(MAX_SPAN, max(1, _number(a.get("rowspan"), 1)))
                row.append((wide, high, cell(kid, inside)))
            elif kid.tag not in ("colgroup", "col"):
                _render(kid, page, seen, False)

    walk(node, seen)
    page.flush()
    if any(len(x) > 1 and ("" in x or max(map(len, x)) > CELL_PAD) for row in rows for _, _, x in row):
        _stack([x for row in rows for _, _, x in row], page)
        return
    grid: list[dict[int, list[str]]] = []
    taken: dict[int, int] = {}
    width: dict[int, int] = {}
    for row in rows:
        line: dict[int, list[str]] = {}
        now, taken, c = taken, {k: n - 1 for k, n in taken.items() if n > 1}, 0
        for wide, high, x in row:
            while now.get(c, 0) > 0:
                c += 1
            line[c] = x
            if wide == 1:
                width[c] = max([width.get(c, 0), *(len(y) for y in x if len(y) <= CELL_PAD)])
            for k in range(c, c + wide):
                if high > 1:
                    taken[k] = high - 1
            c += wide
        grid.append(line)
    place, at = {}, 0
    for c in sorted({c for line in grid for c in line}):
        place[c] = at
        at += width.get(c, 0) + 2
    for line in grid:
        for k in range(max(map(len, line.values()), default=0)):
            out = ""
            for c in sorted(line):
                if k < len(line[c]) and line[c][k]:
                    out = out.ljust(place[c]) if len(out) + 2 <= place[c] or not out else out + "  "
                    out += line[c][k]
            if out:
                page.line.append(out)
                page.flush()


def _stack(cells: list[list[str]], page: Page) -> None:
    """The cells of a layout table, one below the other, their blank lines kept."""
    for lines in cells:
        gap = 2 if "" in lines else 1
        page.block(gap)
        for x in lines:
            if x:
                page.line.append(x)
                page.flush()
            else:
                page.block(2)
        page.block(gap)


def render(html: str | None) -> str:
    """All visible text of a page, laid out."""
    if not html:
        return ""
    root = parse(html.replace("\x00", ""))
    page = Page(Sheet(root.sheets) if root.sheets else None)
    _children(root, page, True, False)
    return page.done().replace("\xa0", " ")


def extract(df: DataFrame, html_col: str, out_col: str) -> DataFrame:
    """df with the rendered text of a column, which replaces a column of that name. Rows stay where they are, but those of
    tables so small that most cores would be idle."""

    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield series.map(lambda h: render(h if isinstance(h, str) else None))

    bound_batches(df.sparkSession)
    return spread(df).withColumn(out_col, F.pandas_udf(answer, "string")(F.col(html_col)))
