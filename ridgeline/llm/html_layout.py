"""Layout-aware HTML rendering to text.

A tree is built with implied tags, visibility rules decide what shows, and a renderer writes all visible text
with block spacing, list markers and aligned table cells.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import table

# Element names by behaviour.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp noembed noframes iframe".split())
ESCAPABLE = frozenset("textarea title".split())
UNSEEN = frozenset("head script style template title meta link base iframe object embed audio video canvas noembed noframes datalist param source track colgroup col map area rp".split())
BLOCK = frozenset(
    "address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table ul xmp".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl menu dir table figure hr fieldset xmp".split())
#: A start tag on the left ends an open element on the right, unless a barrier is nearer.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    **{t: ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}) for t in ("tbody", "thead", "tfoot")},
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}), "body": ({"head"}, {"html"}),
}
ENDS_P = BLOCK - {"body", "html", "option", "optgroup", "legend", "select"}
IN_HEAD = frozenset("base link meta title style script template noscript".split())
SCOPE = frozenset("html body table td th caption button object template".split())

#: Width in px of the screen that media queries are answered for.
SCREEN = 1280
#: Deeper elements become siblings, as browsers do at a depth of this order; no text is lost.
DEPTH = 128

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|</[^>]*(?:>|\Z)
    |<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[\s/]+|[^\s/>=][^\s/>=]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|(?!["'])[^\s>]*))?|=)*+)>
    |<(?P<loose>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)(?:>|\Z)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*([\w-]+)[^;!]*(!\s*important)?", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_CSS_PART = re.compile(r"""[{};]|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""", re.S)
_SELECTOR = re.compile(r"[.#]?[\w-]+")
_MEDIA_WIDTH = re.compile(r"\(\s*(min|max)-(?:device-)?width\s*:\s*(\d+(?:\.\d+)?)(px|r?em)\s*\)")
_SPACES = re.compile(r"[ \t\n\r\f]+")


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)


# Tree


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(text):
        out.setdefault(name.lower(), unescape(next((v for v in values if v), "")))
    return out


def parse(html: str) -> Node:
    """The tree of a page. Never fails: what cannot be a tag is text."""
    root = Node("html")
    open_, at, size = [root], 0, len(html)

    def current() -> Node:
        return open_[-1]

    def close(names, barriers) -> None:
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in names:
                del open_[k:]
                return
            if open_[k].tag in barriers:
                return

    def add(node: Node, push: bool) -> None:
        current().children.append(node)
        if push and len(open_) < DEPTH:
            open_.append(node)

    def text(data: str) -> None:
        if data:
            if data.strip() and current().tag == "head":
                open_.pop()
            current().children.append(unescape(data))

    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        m = _TOKEN.match(html, lt)
        if not m:
            text(html[at : lt + 1])
            at = lt + 1
            continue
        text(html[at:lt])
        at = m.end()
        if m["data"] is not None:
            current().children.append(m["data"])
        elif m["end"]:
            name = m["end"].lower()
            if name == "br":
                add(Node("br"), False)
            elif name == "p" and not any(x.tag == "p" for x in open_):
                add(Node("p"), False)
            elif name not in ("html", "body"):
                close({name}, {"table"} - {name} if name not in ("table", "div", "section", "article", "main") else set())
        elif m["start"] or m["loose"]:
            name, given = (m["start"] or m["loose"]).lower(), m["attrs"] or m["rest"] or ""
            if name in ("html", "body"):
                if name == "body":
                    close({"head"}, {"html"})
                    if not any(x.tag == "body" for x in open_):
                        add(Node("body", _attributes(given)), True)
                continue
            if current().tag == "head" and name not in IN_HEAD:
                open_.pop()
            if name in ENDS_P:
                close({"p"}, SCOPE)
            if name in ENDS:
                close(*ENDS[name])
                if name in ("tbody", "thead", "tfoot", "tr"):  # cells and rows of an unclosed section
                    while current().tag in ENDS[name][0]:
                        open_.pop()
            if name in ("h1", "h2", "h3", "h4", "h5", "h6") and re.fullmatch("h[1-6]", current().tag):
                open_.pop()
            if name in ("td", "th") and current().tag in ("table", "tbody", "thead", "tfoot"):
                add(Node("tr"), True)
            node = Node(name, _attributes(given) if given else {})
            if name in VOID:
                add(node, False)
            elif name in RAW or name in ESCAPABLE:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                inner = html[at : end.start() if end else size]
                node.children.append(inner if name in RAW else unescape(inner))
                add(node, False)
                at = end.end() if end else size
            else:
                add(node, not given.rstrip().endswith("/") or name not in ("svg", "path"))
    return root


# Visibility


def _on_screen(query: str) -> bool:
    """If a media query list holds on a screen SCREEN wide. A list of what is not understood does not hold."""

    def holds(part: str) -> bool | None:
        if part in ("all", "screen", "only screen", "only all"):
            return True
        if re.fullmatch(r"(only\s+)?[a-z-]+", part):
            return False
        m = _MEDIA_WIDTH.fullmatch(part)
        if m is None:
            return None
        width = float(m[2]) * (1 if m[3] == "px" else 16)
        return SCREEN >= width if m[1] == "min" else SCREEN <= width

    def one(text: str) -> bool:
        text = " ".join(text.split())
        negated, text = text.startswith("not "), text.removeprefix("not ")
        values = [holds(p) for p in text.split(" and ")]
        if None in values:  # unknown; false all the same if another part is
            return negated and False in values
        return all(values) != negated

    return not query.strip() or any(one(x) for x in query.lower().split(","))


def _supported(condition: str) -> bool:
    """If an @supports condition holds: single declarations of the usual layouts do, what is not understood does not."""
    text = " ".join(condition.lower().split())
    negated, text = text.startswith("not "), text.removeprefix("not ")
    known = re.fullmatch(r"\(\s*display\s*:\s*(grid|flex|block|inline-block|inline|none|table)\s*\)", text)
    return bool(known) and not negated


def _rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that apply on a screen, in order; in time linear in css."""
    css = _CSS_COMMENT.sub(" ", css)
    start, blocks, off = 0, [], 0  # blocks: (prelude, whether its rules apply, whether it holds rules)
    for m in _CSS_PART.finditer(css):
        part = m[0]
        if part == "{":
            prelude = css[start : m.start()].strip()
            name = re.match(r"@?[\w-]*", prelude)[0].lower()
            if prelude.startswith("@"):
                rest = prelude[len(name) :].strip()
                applies = _on_screen(rest) if name == "@media" else _supported(rest) if name == "@supports" else name == "@layer"
                blocks.append((prelude, applies, True))
            else:
                applies = not blocks or blocks[-1][2]  # a rule inside a rule is of no simple selector
                blocks.append((prelude, applies, False))
            off += not applies
            start = m.end()
        elif part == "}":
            if blocks:
                prelude, applies, group = blocks.pop()
                off -= not applies
                if not group and applies and not off:
                    yield prelude, css[start : m.start()]
            start = m.end()
        elif part == ";" and (not blocks or blocks[-1][2]):  # @import, @charset
            start = m.end()
    if blocks and not blocks[-1][2] and not off:  # the last rule that is not closed
        yield blocks[-1][0], css[start:]


def _display(declarations: str) -> tuple[bool, bool] | None:
    """(important, hides) of the display declaration that counts."""
    out = None
    for value, important in _DISPLAY.findall(declarations):
        if out is None or bool(important) >= out[0]:
            out = (bool(important), value.lower() == "none")
    return out


def display_rules(root: Node) -> dict[str, tuple]:
    """What a page's own style sheets say of display, by simple selector (tag, .class, #id), if any of them hides.

    The value orders the rules as a browser does: important, kind of selector, place; whether it hides comes last.
    Style sheets and blocks that are not for a screen (print, narrow screens, unknown conditions) do not count.
    """
    out: dict[str, tuple] = {}
    todo, place = [root], 0
    while todo:
        node = todo.pop()
        if node.tag == "style" and _on_screen(node.attrs.get("media", "")):
            for selectors, body in _rules("".join(x for x in node.children if isinstance(x, str))):
                said = _display(body)
                for s in (x.strip() for x in selectors.split(",")) if said else ():
                    if _SELECTOR.fullmatch(s):
                        place += 1
                        kind = 2 if s[0] == "#" else 1 if s[0] == "." else 0
                        s = s if kind else s.lower()
                        out[s] = max(out.get(s, (False, 0, 0, False)), (said[0], kind, place, said[1]))
        todo.extend(x for x in reversed(node.children) if isinstance(x, Node))
    return out if any(x[3] for x in out.values()) else {}


def _displayed(node: Node, selectors: dict[str, tuple]) -> bool:
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or (node.tag == "dialog" and "open" not in a) or (node.tag == "input"):
        return False
    if not a and not selectors:
        return True
    own = _display(a["style"]) if "style" in a else None
    if not selectors:
        return not (own and own[1])
    names = [node.tag, f"#{a.get('id')}", *(f".{c}" for c in a.get("class", "").split())]
    rules = [selectors[x] for x in names if x in selectors]
    if own:
        rules.append((own[0], 3, 0, own[1]))
    return not (rules and max(rules)[3])


# Rendering


def _width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Page:
    """Lines as they are laid out. Blank lines never start or end a text and never follow each other."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = 0
        self.indent = ""
        self.marker = ""

    def write(self, data: str) -> None:
        collapsed = _SPACES.sub(" ", data)
        if not collapsed:
            return
        if collapsed == " ":
            self.space = self.space or bool(self.parts)
            return
        if collapsed[0] == " ":
            self.space = self.space or bool(self.parts)
        if self.space:
            self.parts.append(" ")
        self.parts.append(collapsed.strip(" "))
        self.space = collapsed[-1] == " "

    def line(self, data: str) -> None:
        if self.gap > 1 and self.lines:
            self.lines.append("")
        self.gap = 0
        self.lines.append((self.indent[: len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent) + data)
        self.marker = ""

    def end(self, gap: int = 1) -> None:
        if self.parts:
            self.line("".join(self.parts))
        self.parts, self.space = [], False
        self.gap = max(self.gap, gap)

    def preformatted(self, data: str) -> None:
        for k, part in enumerate(data.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if k:
                joined = "".join(self.parts)
                self.parts, self.space = [], False
                self.line(joined)
            if part:
                self.parts.append(part)

    def text(self) -> str:
        self.end()
        return "\n".join(x.rstrip() for x in self.lines).strip("\n")


def _render(node: Node, page: _Page, selectors: dict[str, tuple], pre: bool = False, seen: bool = True, depth: int = 0) -> None:
    number, step = None, 1
    if node.tag == "ol":
        start = node.attrs.get("start", "")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        if "reversed" in node.attrs:
            step = -1
            if not re.fullmatch(r"-?\d{1,9}", start):
                number = sum(isinstance(x, Node) and x.tag == "li" and _displayed(x, selectors) for x in node.children)
    closed = node.tag == "details" and "open" not in node.attrs
    for x in node.children:
        if isinstance(x, str):
            if seen and not closed:
                page.preformatted(x) if pre else page.write(x)
            continue
        if not _displayed(x, selectors) or (closed and x.tag != "summary"):
            continue
        rule = _VISIBILITY.search(x.attrs["style"]) if "style" in x.attrs else None
        shows = seen if rule is None else rule[1].lower() == "visible"
        tag = x.tag
        if tag == "br":
            if page.parts:
                page.end(0)
            elif page.lines:
                page.gap = 2
            continue
        if tag == "wbr" or tag == "img":
            continue
        gap = 2 if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and node.tag == "li") else 1
        if tag == "table":
            page.end(gap)
            _table(x, page, selectors, shows, depth + 1)
            page.end(gap)
            continue
        if tag not in BLOCK:
            _render(x, page, selectors, pre, shows, depth + 1)
            if tag in ("td", "th"):  # outside of a table
                page.write(" ")
            continue
        page.end(gap)
        if tag == "hr":
            if shows:
                page.line("---")
            page.end(gap)
            continue
        indent, marker = page.indent, page.marker
        if tag == "li":
            sign = "- " if number is None else f"{number}. "
            if number is not None:
                value = x.attrs.get("value", "")
                if re.fullmatch(r"-?\d{1,9}", value):
                    sign = f"{value}. "
                    number = int(value)
                number += step
            page.indent, page.marker = indent + " " * len(sign), sign if shows else ""
        elif tag == "blockquote":
            page.indent = indent + "> "
        elif tag == "dd":
            page.indent = indent + "    "
        _render(x, page, selectors, pre or tag in ("pre", "xmp", "textarea"), shows, depth + 1)
        page.end(gap)
        page.indent, page.marker = indent, "" if tag == "li" else page.marker if marker else ""


def _table(node: Node, page: _Page, selectors: dict[str, tuple], seen: bool, depth: int) -> None:
    """Rows of cells, columns as wide as their widest line; a cell over several columns or rows takes the first."""
    rows: list[list[list[str]]] = []
    below: dict[int, int] = {}  # rows for which a column is still taken by a cell from above

    def span(x: Node, name: str, most: int) -> int:
        given = x.attrs.get(name, "")
        return min(int(given), most) if re.fullmatch(r"\d{1,5}", given) and (name == "rowspan" or given.strip("0")) else 1

    def place(row: list[list[str]], x: Node, lines: list[str]) -> None:
        while below.get(len(row), 0):
            row.append([])
        down = span(x, "rowspan", 65_534) or 65_534  # 0: to the end of the section
        for k in range(span(x, "colspan", 1000)):
            if down > 1:
                started[len(row)] = max(down, below.get(len(row), 0))
            row.append([] if k else lines)

    started: dict[int, int] = {}

    def cell(x: Node) -> list[str]:
        inner = _Page()
        rule = _VISIBILITY.search(x.attrs.get("style", ""))
        _render(x, inner, selectors, False, seen if rule is None else rule[1].lower() == "visible", depth + 1)
        text = inner.text()
        return text.split("\n") if text else []

    def walk(x: Node) -> None:
        loose: list = []  # captions and misplaced content, before the rows that follow
        for y in [*x.children, Node("tfoot")]:
            if isinstance(y, str):
                if y.strip():
                    loose.append(y)
                continue
            if not _displayed(y, selectors):
                continue
            if loose and y.tag in ("tbody", "thead", "tfoot", "tr"):
                rows.append([cell(Node("td", {}, loose))])
                loose = []
            if y.tag in ("tbody", "thead", "tfoot"):
                if y.children:
                    below.clear()
                    walk(y)
                    below.clear()
            elif y.tag == "tr":
                row: list[list[str]] = []
                for z in y.children:
                    if isinstance(z, Node) and z.tag in ("td", "th"):
                        if _displayed(z, selectors):
                            place(row, z, cell(z))
                    elif isinstance(z, Node) or z.strip():
                        place(row, Node("td"), cell(Node("td", {}, [z])))
                for k in [k for k in below if below[k] > 1]:
                    started.setdefault(k, below[k])
                below.clear()
                below.update({k: n - 1 for k, n in started.items()})
                started.clear()
                rows.append(row)
            else:
                loose.append(y)

    walk(node)
    rows = [r for r in rows if any(r)]
    many = [r for r in rows if len(r) > 1]
    widths = [max((_width(line) for r in many if k < len(r) for line in r[k]), default=0) for k in range(max(map(len, many), default=0))]
    for row in rows:
        for k in range(max(map(len, row))):
            line = ""
            for c, lines in enumerate(row):
                part = lines[k] if k < len(lines) else ""
                line += part if c == len(row) - 1 else part + " " * (widths[c] - _width(part) + 2)
            page.line(line.rstrip())


def render(html: str | None) -> str:
    """All visible text of a page; empty for a null or empty page."""
    if not html:
        return ""
    root, page = parse(html), _Page()
    _render(root, page, display_rules(root))
    return page.text()


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with visible_text, row for row; a column of that name is replaced. Equal pages give equal texts.

    A null or empty page has an empty text, an empty table an empty result. A page of any length is rendered as a
    whole, in time and memory in proportion to it; other columns, whatever their names, stay as they are.
    """

    @F.pandas_udf("string")
    def rendered(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([render(x) for x in batch], dtype=object)

    return pages.drop("visible_text").withColumn("visible_text", rendered(F.col(html).cast("string")))


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "visible_text", F.length("visible_text").cast("long").alias("n_chars"))
