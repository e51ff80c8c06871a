"""Visible text of HTML pages, laid out: a small tree builder and a renderer.

Tree: tags are read as browsers read them (quotes count only as values, ``<!-->`` is a whole comment, a tag that the page ends in is none);
start tags close what they imply closed (a block closes an open paragraph, ``li`` an item, ``td`` a cell, body content the head, ...) and
open what they imply open (a cell outside a row opens the row); end tags close up to their element and are ignored if it isn't
open; void elements have no content; script, style and similar elements are read to their end tag as raw text; comments,
doctypes and stray markup go.

Visibility: ``head``, scripts, styles, templates, closed dialogs, form values, elements with ``hidden`` (unless their style sets a display) and
those with an inline style of ``display: none`` show nothing; ``visibility: hidden`` hides text until ``visibility: visible`` shows it again. Formulas are shown in their line, with ``/``, ``^`` and ``_`` between the
parts of fractions and scripts; each ``text`` of a drawing is a line, its title, description and definitions are not shown. A drop-down
shows the choice that is selected, or its first; a list box shows all of its options and their groups' labels.

Layout: white space collapses except in ``pre`` and ``textarea``; blocks start a line; paragraphs, headings, lists, tables and the
like are set off by an empty line; list items get a bullet or their number (``start``, ``reversed``, ``type`` and ``value`` count) and hang at
their depth; the cells of a table column start at one place, spans left empty and wide characters taking two places. Cells of all
columns but the last wrap at ``WRAP`` places, as on a screen, so that no cell can widen the lines of all others.

Nothing recurses, so any depth of nesting is rendered. Defined cases: null gives null text, empty gives empty; a null page_id
is carried through; repeated rows get equal answers; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame

WRAP = 120  # places that a cell takes at most unless it ends in its table's last column
_VALUE = r"\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^\s>]*+)?)"
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:{_VALUE})?+")
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[(CDATA)\[|<[!?][^>]*+(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*+(?:>|\Z))"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:{_VALUE.replace('([^', '(?:[^')})?+)*+)(>|\Z)",
    re.S,
)
_SPACE = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes object audio video canvas datalist param".split())
BLOCKS = frozenset("address article aside body center details dialog dir div dd dt fieldset figcaption footer form header hgroup html legend li main menu nav section summary tr caption".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
#: Not shown inside of a drawing or a formula.
UNDRAWN = frozenset("title desc defs metadata symbol clippath mask pattern marker annotation annotation-xml mphantom".split())
#: What stands between the parts of a formula's element.
BETWEEN = {"mfrac": "/", "msup": "^", "mover": "^", "msub": "_", "munder": "_", "msubsup": "_^", "munderover": "_^"}
_TOKENS = frozenset("mi mn mo ms mtext".split())
#: HTML that ends an open drawing or formula, and elements beyond which it doesn't.
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_FOREIGN = frozenset(("svg", "math"))
_WITHIN = frozenset("foreignobject desc title annotation-xml".split()) | _TOKENS
_SELF_CLOSED = re.compile(r"(?:\A|[\s\"'])/\s*\Z")
CLOSES_P = (BLOCKS | SPACED) - {"tr", "caption", "html", "body"}
_CELLS = frozenset(("td", "th"))
_PARTS = frozenset(("thead", "tbody", "tfoot"))
#: start tag -> (open elements that it ends, elements beyond which it doesn't look)
IMPLIED_END = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir", "table", "td", "th"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table"))), "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "td": (_CELLS, frozenset(("tr", "table"))), "th": (_CELLS, frozenset(("tr", "table"))),
    "tr": (frozenset(("tr",)), frozenset(("table",))), "caption": (frozenset(("caption",)), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))), "optgroup": (frozenset(("option", "optgroup")), frozenset(("select", "datalist"))),
    "select": (frozenset(("select",)), frozenset()), "input": (frozenset(("select",)), frozenset()), "textarea": (frozenset(("select",)), frozenset()),
    "thead": (_PARTS | {"tr"}, frozenset(("table",))), "tbody": (_PARTS | {"tr", "caption"}, frozenset(("table",))), "tfoot": (_PARTS | {"tr"}, frozenset(("table",))),
}
IMPLIED_OPEN = {"td": ("tr", frozenset(("tr",))), "th": ("tr", frozenset(("tr",)))}
P_LIMITS = frozenset(("table", "td", "th", "caption", "body", "html", "button", "object"))


#: What may stand in a head; anything else begins the body.
HEADED = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())


def _declared(style: str) -> dict[str, str]:
    """The declarations of an inline style; of several for one property the last counts, an important one before others."""
    found: dict[str, tuple[bool, str]] = {}
    for part in _COMMENT.sub(" ", style).lower().split(";"):
        name, _, value = part.partition(":")
        plain = value.replace("!important", "").strip()
        important = "!important" in value
        if plain and not (found.get(name.strip(), (False, ""))[0] and not important):
            found[name.strip()] = important, plain
    return {k: v for k, (_, v) in found.items()}


_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self, name: str) -> str | None:
        if name not in self.attributes.lower():
            return None
        for key, a, b, c in _ATTRIBUTE.findall(self.attributes):
            if key.lower() == name:
                return unescape(a or b or c)
        return None

    def style(self) -> dict[str, str]:
        style = self.get("style") if self.attributes else None
        return _declared(style) if style else {}

    def seen(self) -> bool:
        """Whether it takes part in the layout at all."""
        if self.tag in UNSEEN:
            return False
        if self.tag == "dialog" and self.get("open") is None:
            return False
        if not self.attributes:
            return True
        display = self.style().get("display")
        return display != "none" if display else self.get("hidden") is None

    def shows(self, shown: bool) -> bool:
        """Whether its own text is visible, ``shown`` being its parent's."""
        value = self.style().get("visibility")
        return value == "visible" if value in ("visible", "hidden", "collapse") else shown


def build(html: str) -> Node:
    """The tree of a page; text is in the children as strings."""
    root = Node("#root")
    stack, names = [root], {"#root": 1}

    def close(to: int) -> None:
        for node in stack[to:]:
            names[node.tag] -= 1
        del stack[to:]

    def end_up_to(tags: frozenset, limits: frozenset) -> None:
        if not any(names.get(t) for t in tags):
            return
        found = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                found = k
            elif stack[k].tag in limits:
                break
        if found is not None:
            close(found)

    def open_(tag: str, attributes: str) -> Node:
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
            names[tag] = names.get(tag, 0) + 1
        return node

    at = 0
    paragraph = frozenset(("p",))
    while True:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            if names.get("head") and stack[-1].tag == "head" and not text.isspace():
                close(len(stack) - 1)
            stack[-1].children.append(unescape(text) if "&" in text else text)
        if not m:
            return root
        at = m.end()
        tag = m[3]
        if not tag:
            if m[1]:  # data in drawings and formulas, a comment elsewhere
                mark = "]]>" if names.get("svg") or names.get("math") else ">"
                stop = html.find(mark, at)
                stop = len(html) if stop < 0 else stop
                if mark == "]]>":
                    stack[-1].children.append(html[at:stop])
                at = min(len(html), stop + len(mark))
            continue
        if not m[5]:  # the page ends inside of it
            return root
        tag = tag.lower()
        if m[2]:
            if tag == "p" and not names.get("p"):
                open_("p", "")
            if tag == "br":
                open_("br", "")
            elif names.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag and not (stack[k].tag in ("td", "th", "table") and tag not in ("td", "th", "tr", "table", "thead", "tbody", "tfoot")):
                    k -= 1
                if stack[k].tag == tag:
                    close(k)
            continue
        if names.get("head") and tag not in HEADED:
            end_up_to(frozenset(("head",)), frozenset(("template", "noscript")))
        foreign = names.get("svg") or names.get("math")
        if foreign and tag in BREAKS_OUT:
            end_up_to(_FOREIGN, _WITHIN)
        if tag in CLOSES_P and names.get("p"):
            end_up_to(paragraph, P_LIMITS)
        if tag in IMPLIED_END:
            end_up_to(*IMPLIED_END[tag])
        if tag in IMPLIED_OPEN and names.get("table"):
            parent, enough = IMPLIED_OPEN[tag]
            if stack[-1].tag not in enough:
                open_(parent, "")
        node = open_(tag, m[4] or "")
        if (foreign or tag in _FOREIGN) and tag not in VOID and _SELF_CLOSED.search(node.attributes):
            close(len(stack) - 1)
        elif tag in RAW:
            end = _RAW_END[tag].search(html, at)
            stop = end.start() if end else len(html)
            body = html[at:stop]
            node.children.append(unescape(body) if tag in ("textarea", "title") else body)
            close(len(stack) - 1)
            at = html.find(">", stop) + 1 or len(html)


class Flow:
    """Lines under construction: pending line breaks, pending space, and the indents of open lists."""

    def __init__(self):
        self.lines, self.line, self.gap, self.space, self.indent, self.mark = [], [], 0, False, 0, ""

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def want(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def put(self, text: str) -> None:
        if not self.line:
            if self.lines and self.gap > 1 and self.lines[-1] != "":
                self.lines.append("")
            self.gap = 0
            if self.mark:
                self.line.append(" " * max(0, self.indent - len(self.mark)) + self.mark)
                self.mark = ""
            elif self.indent:
                self.line.append(" " * self.indent)
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(text)

    def text(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if words == " ":
            self.space = bool(self.line)
            return
        if words[0] == " ":
            self.space = bool(self.line)
        self.put(words.strip(" "))
        self.space = words[-1] == " "

    def kept(self, text: str) -> None:
        for k, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if k:
                self.end_line() if self.line else self.lines.append("")
            if line:
                self.put(line)

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def places(text: str) -> int:
    """Places that a text takes in a line: two for wide characters, none for combining marks."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def wrapped(lines: list[str]) -> list[str]:
    """The lines cut to WRAP places, at spaces where there are any."""
    out = []
    for line in lines:
        while places(line) > WRAP:
            at, taken = 0, 0
            while at < len(line) and (taken := taken + places(line[at])) <= WRAP:
                at += 1
            space = line.rfind(" ", 0, at + 1)
            space = space if line[: max(space, 0)].strip(" ") else 0
            out.append(line[: space or at].rstrip(" "))
            line = line[space:].lstrip(" ") if space else line[at:]
        out.append(line)
    return out


def numbered(n: int, kind: str) -> str:
    """An item's number in the style of a list's ``type``."""
    if kind.lower() == "a" and n > 0:
        out = ""
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(97 + k) + out
        return out if kind == "a" else out.upper()
    if kind.lower() == "i" and 0 < n < 4000:
        out = ""
        for value, mark in _ROMAN:
            out, n = out + mark * (n // value), n % value
        return out if kind == "i" else out.upper()
    return str(n)


_ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))
_NUMBER = re.compile(r"\s*([+-]?\d{1,9})")


def _whole(node: Node, name: str) -> int | None:
    value = _NUMBER.match(node.get(name) or "")
    return int(value[1]) if value else None


def lay_out(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table of (cell lines, columns, rows) with each column at one place."""
    grid: list[dict[int, tuple[list[str], int]]] = []
    taken: dict[int, int] = {}  # column -> rows it is still covered by a cell from above
    for row in rows:
        placed, col = {}, 0
        blocked = {c for c, n in taken.items() if n > 0}
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        for lines, wide, high in row:
            while col in blocked:
                col += 1
            placed[col] = lines, col + wide
            if high > 1:
                for c in range(col, col + wide):
                    taken[c] = high - 1
            col += wide
        grid.append(placed)
    end = max([stop for placed in grid for _, stop in placed.values()], default=0)
    grid = [{c: (wrapped(lines) if stop < end else lines, stop) for c, (lines, stop) in placed.items()} for placed in grid]
    width: dict[int, int] = {}
    spanning = []
    for placed in grid:
        for c, (lines, stop) in placed.items():
            width.setdefault(c, 0)
            if stop < end:
                need = max(map(places, lines), default=0)
                if stop == c + 1:
                    width[c] = max(width[c], need)
                else:
                    spanning.append((c, stop, need))
    columns = sorted(width)
    for c, stop, need in spanning:  # what doesn't fit over its columns widens the last of them
        own = [k for k in columns if c <= k < stop]
        width[own[-1]] += max(0, need - sum(width[k] for k in own) - 2 * (len(own) - 1))
    out = []
    for placed in grid:
        for k in range(max((len(lines) for lines, _ in placed.values()), default=0)):
            line, place, at = [], 0, 0  # at: places that the line has taken
            for c in columns:
                text = placed[c][0][k] if c in placed and k < len(placed[c][0]) else ""
                if text:
                    gap = max(place - at, 2 if line else 0)
                    line += [" " * gap, text]
                    at += gap + places(text)
                place += width[c] + 2 if width[c] or c in placed else 0
            out.append("".join(line))
    return out


def _span(node: Node, name: str, most: int) -> int:
    value = node.get(name)
    return min(most, max(1, int(value))) if value and value.strip().isdigit() and len(value) < 9 else 1


def _text(node: Node) -> str:
    """The seen text of an option, in one line."""
    out, todo = [], [node]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            out.append(at)
        elif at.seen():
            todo.extend(reversed(at.children))
    return _SPACE.sub(" ", "".join(out)).strip(" ")


def choices(select: Node) -> tuple[bool, list[str]]:
    """Whether a select is a list box, and the lines it shows."""
    size = (select.get("size") or "").strip()
    box = select.get("multiple") is not None or size.isdigit() and int(size[:9]) > 1
    lines, chosen, first = [], None, None
    todo = [(c, False) for c in reversed(select.children)]
    while todo:
        node, off = todo.pop()
        if isinstance(node, str) or not node.seen():
            continue
        off = off or node.get("disabled") is not None
        if node.tag == "option":
            lines.append(node.get("label") or _text(node))
            if node.get("selected") is not None:
                chosen = lines[-1]
            if first is None and not off:
                first = lines[-1]
            continue
        if node.tag == "optgroup":
            lines.append(node.get("label") or "")
        todo.extend((c, off and node.tag == "optgroup") for c in reversed(node.children))
    return box, [x for x in (lines if box else [chosen if chosen is not None else first]) if x]


def _operand(node: Node | str) -> list[Node | str]:
    """A part of a formula, in parentheses if it is a row of several."""
    several = isinstance(node, Node) and node.tag == "mrow" and sum(isinstance(c, Node) for c in node.children) > 1
    return ["(", node, ")"] if several else [node]


def render(root: Node) -> str:
    """The visible text of a tree."""
    flow, pre, drawn, formulas = Flow(), 0, 0, 0
    lists: list[list] = []  # [ordered, next number, step, type]
    tables: list[list] = []  # [rows, flow around]
    todo: list[tuple[Node | str, bool, bool]] = [(root, True, True)]
    while todo:
        node, enter, shown = todo.pop()
        if isinstance(node, str):
            if shown:
                flow.kept(node) if pre else flow.text(node)
            continue
        tag = node.tag
        if enter:
            if tag == "br":
                if not shown:
                    pass
                elif flow.line:
                    flow.end_line()
                elif flow.lines:
                    flow.gap = 2
                continue
            if not node.seen() or tag == "input" or (drawn or formulas) and tag in UNDRAWN:
                continue
            if drawn and node.get("display") == "none":
                continue
            if node.attributes:
                if drawn and (value := node.get("visibility")) in ("hidden", "collapse", "visible"):
                    shown = value == "visible"
                shown = node.shows(shown)
            if tag == "select":
                box, lines = choices(node) if shown else (False, [])
                for line in lines:
                    if box:
                        flow.want(1)
                    flow.text(line if box else f" {line} ")
                if box:
                    flow.want(1)
                continue
            if tag == "svg":
                drawn += 1
            elif tag == "math":
                formulas += 1
                if node.get("display") == "block":
                    flow.want(1)
            if drawn and tag == "text" or formulas and tag == "mtr" or tag in ("option", "optgroup"):
                flow.want(1)
            elif formulas and tag == "mtd":
                flow.text(" ")
            if tag in ("td", "th") and tables:
                tables[-1][1].append(flow)
                flow = Flow()
            elif tag == "table":
                flow.want(2)
                tables.append([[], []])
            elif tag == "tr" and tables:
                tables[-1][0].append([])
            elif tag in SPACED:
                flow.want(1 if tag in ("ul", "ol") and lists else 2)
            elif tag in BLOCKS:
                flow.want(1)
            if tag in ("ul", "ol", "menu", "dir"):
                back = tag == "ol" and node.get("reversed") is not None
                start = _whole(node, "start")
                if start is None:
                    start = sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if back else 1
                lists.append([tag == "ol", start, -1 if back else 1, (node.get("type") or "").strip()])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0]:
                    own = lists[-1]
                    value = _whole(node, "value")
                    own[1] = own[1] if value is None else value
                    mark, own[1] = f"{numbered(own[1], own[3])}. ", own[1] + own[2]
                flow.indent += len(mark)
                flow.mark = mark if shown else ""
                lists.append([False, len(mark)])
            elif tag in ("dd", "blockquote"):
                flow.indent += 2
            elif tag in ("pre", "textarea", "xmp"):
                pre += 1
            children = node.children
            if formulas and tag not in _TOKENS:  # white space between a formula's elements isn't shown
                children = [c for c in children if not isinstance(c, str) or c.strip(" \t\n\r\f")]
                if tag in BETWEEN:
                    marks = BETWEEN[tag]
                    children = [x for k, c in enumerate(children) for x in ([marks[k - 1]] if 0 < k <= len(marks) else []) + _operand(c)]
            todo.append((node, False, shown))
            todo.extend((c, True, shown) for c in reversed(children))
            continue
        if drawn and tag == "text" or formulas and tag == "mtr" or tag in ("option", "optgroup"):
            flow.want(1)
        if tag == "svg":
            drawn -= 1
        elif tag == "math":
            formulas -= 1
            if node.get("display") == "block":
                flow.want(1)
        if tag in ("td", "th") and tables and tables[-1][1]:
            lines = flow.done()
            flow = tables[-1][1].pop()
            if not tables[-1][0]:
                tables[-1][0].append([])
            tables[-1][0][-1].append((lines, _span(node, "colspan", 1000), _span(node, "rowspan", 65534)))
        elif tag == "table":
            for line in lay_out(tables.pop()[0]):
                flow.end_line()
                if line:
                    flow.put(line)
            flow.want(2)
        elif tag == "li":
            flow.want(1)
            flow.indent -= lists.pop()[1]
            flow.mark = ""
        elif tag in SPACED:
            flow.want(1 if tag in ("ul", "ol") and len(lists) > 1 else 2)
        elif tag in BLOCKS:
            flow.want(1)
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag in ("dd", "blockquote"):
            flow.indent -= 2
        elif tag in ("pre", "textarea", "xmp"):
            pre -= 1
    return "\n".join(flow.done()).strip("\n")


def visible_text(html: str | None) -> str | None:
    return None if html is None else render(build(html))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [visible_text(h) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "text": text, "n_chars": [len(t or "") for t in text]})

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["html"].cast("string").alias("html"))
    return rows.mapInPandas(run, "page_id long, text string, n_chars long")
