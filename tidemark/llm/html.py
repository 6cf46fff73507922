"""HTML extraction by layout: a tree builder with implied tags, then a renderer of all visible text.

The tree builder closes and opens tags as documents leave them out (``p``, ``li``, ``dt``/``dd``, table
parts, ``option``), ignores stray end tags and takes scripts and the like as raw text. The renderer
leaves out what is not shown, folds white space outside ``pre``, starts a line at each block, sets headings,
paragraphs, lists and tables off by an empty line, marks list items, and lays table cells out on a grid with
``colspan`` and ``rowspan`` whose columns align by display width (wide characters count two).
What a table holds outside its cells comes as lines before its rows, a table opened there after them.
Texts of ``svg`` and ``math`` are shown, those in ``defs`` or ``symbol`` too, as they may be drawn from elsewhere;
a closed ``details`` is shown, as it opens in the page; a closed ``dialog`` is not.

Hidden are ``head``, scripts and the like, ``hidden``, ``display: none`` with all below it, and
``visibility: hidden`` but for what is visible again below it. Styles count from ``style`` attributes and from
rules of ``style`` elements whose selector is one compound of tag, ``#id`` and ``.class``; other selectors,
and blocks for media other than screens, do not.

The work is one pass over the rows, without a shuffle; a page is handled alone, in time about linear in its
length: no step recurses or looks back over what is open, so depth is bounded only by the page. A column is
aligned on its widest line of up to ``ALIGN`` characters, longer lines run on, so that one long cell does
not pad all rows.

Defined results: null or empty pages give an empty text; rows with a null id are rows like others; text without
tags is text; unclosed tags end with the page, a tag cut off by its end is no text; repeated rows come back
repeated; an empty table gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame

from tidemark.llm.common import map_batches

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title noembed noframes iframe object audio video canvas datalist input".split())
#: Parts of drawings and formulas that are never shown.
UNSEEN_PARTS = frozenset("desc metadata annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption tr thead tbody tfoot".split())
#: Parts of a formula stand side by side or one above the other; a blank keeps their texts apart.
APART = frozenset("mfrac msub msup msubsup munder mover munderover mroot mtr".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre figure hr".split())
LISTS = frozenset("ul ol menu dir".split())
#: An opening tag closes open tags of the second set, up to a tag of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
ENDS_P = BLOCK - {"body", "html", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption"}
P_SCOPE = ("td", "th", "li", "div", "table", "button")
IN_HEAD = frozenset("head title meta link base style script noscript template".split())
#: An end tag does not reach beyond these, but for those of the parts of a table and a page.
SCOPE = ("table", "td", "th", "caption", "html")
FAR = frozenset("table tr tbody thead tfoot html body".split())
#: Columns align on lines of up to so many characters.
ALIGN = 200
#: The most blanks between two cells.
GAP = 4 * ALIGN
#: The most that spans can say, as in the standard.
COLSPAN, ROWSPAN = 1000, 65534

_START = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])")
#: A well-formed tag. It holds no further "<", so a failed attempt costs no more than the way to the next one.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/><]*+)((?:\s++[^\s/>=\"'<]++(?:=(?:\"[^\"<>]*+\"|'[^'<>]*+'|[^\s\"'<>=`/]++))?)*+)\s*+(/?)>")
_SAID = re.compile(r"([^\s/>=]+)(?:=(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>=`/]+)))?")
_NAME = re.compile(r"[^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"[^\s/>][^\s/>=]*")
_IS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_FOLD = re.compile(r"[ \t\n\r\f\v]+")
_ZEROS = re.compile(r"&#0+(?=[0-9])")
_HUGE = re.compile(r"&#[0-9]{8,};?")


def _chars(text: str) -> str:
    """Character references replaced. Those of numbers beyond all characters are one unknown character."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _HUGE.sub("�", _ZEROS.sub("&#", text))
    return unescape(text)


class Element:
    __slots__ = ("tag", "attrs", "kids", "cells")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids = tag, attrs if attrs is not None else {}, []
        self.cells = False  # whether rows or cells of the table around it are in it


def _read_tag(html: str, at: int, last: dict[str, int]) -> tuple[str, bool, dict[str, str], bool, int]:
    """Name, whether it is an end tag, attributes, whether it closes itself, and where it ends; an end of -1: cut off.

    A quote opens a value only right after "="; elsewhere, and where none closes it, it is a plain character.
    """
    m = _TAG.match(html, at)
    if m:
        attrs: dict[str, str] = {}
        if m[3]:
            for key, a, b, c in _SAID.findall(m[3]):
                attrs.setdefault(key.lower(), _chars(a or b or c))
        return m[2].lower(), bool(m[1]), attrs, bool(m[4]), m.end()
    end = html[at + 1] == "/"
    m = _NAME.match(html, at + 1 + end)
    name, at, attrs, slash = m[0].lower(), m.end(), {}, False
    while True:
        m = _GAP.match(html, at)
        slash, at = m[0].endswith("/"), m.end()
        if at >= len(html):
            return name, end, attrs, slash, -1
        if html[at] == ">":
            return name, end, attrs, slash, at + 1
        m = _KEY.match(html, at)
        key, value, at = m[0].lower(), "", m.end()
        if eq := _IS.match(html, at):
            at = eq.end()
            quote = html[at : at + 1]
            if quote in ("'", '"') and quote and at < last[quote]:
                shut = html.index(quote, at + 1)
                value, at = html[at + 1 : shut], shut + 1
            else:
                m = _BARE.match(html, at)
                value, at = m[0], m.end()
        attrs.setdefault(key, _chars(value))


class _Open:
    """The open elements, with the places of each tag, so that no search walks the stack."""

    def __init__(self, root: Element):
        self.stack, self.at = [root], {root.tag: [0]}

    def push(self, node: Element) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def pop_to(self, size: int) -> None:
        while len(self.stack) > size:
            self.at[self.stack.pop().tag].pop()

    def nearest(self, tags) -> int:
        """The place of the innermost of these tags, or -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def close(self, tags: set[str], until) -> None:
        k = self.nearest(tags)
        if k >= 1 and k > self.nearest(until):
            while k > 1 and self.stack[k - 1].tag in tags:
                k -= 1
            self.pop_to(k)

    def foreign(self) -> bool:
        """Whether a drawing or a formula is open."""
        drawn = self.nearest(("svg", "math"))
        return drawn > self.nearest(("foreignobject",))


def parse(html: str) -> Element:
    """The tree of a page. Texts of ``style`` elements are kept at the root, under the attribute "style-rules"."""
    root = Element("html")
    rules: list[str] = []
    opened = _Open(root)
    stack = opened.stack
    last = {q: html.rfind(q) for q in "'\""}

    def put(node: Element | str) -> None:
        stack[-1].kids.append(node)

    def put_text(text: str) -> None:
        if stack[-1].tag == "head" and text.strip():
            opened.pop_to(len(stack) - 1)  # text ends an unclosed head
        if stack[-1].tag == "pre" and not stack[-1].kids and text.startswith("\n"):
            text = text[1:]
        put(_chars(text))

    at = 0
    while at < len(html):
        m = _START.search(html, at)
        if not m:
            put_text(html[at:])
            break
        if m.start() > at:
            put_text(html[at : m.start()])
        at = m.start()
        if m[0] in ("<!--", "<!", "<?"):
            shut = html.find("-->" if m[0] == "<!--" else ">", m.end())
            at = len(html) if shut < 0 else shut + (3 if m[0] == "<!--" else 1)
            continue
        tag, end, attrs, slash, at = _read_tag(html, at, last)
        if at < 0:
            break
        if end:
            if tag == "p" and not opened.at.get("p"):
                put(Element("p"))
            elif tag == "br":
                put(Element("br"))
            else:
                k = opened.nearest((tag,))
                if k >= 1 and (tag in FAR or k >= opened.nearest(SCOPE)):
                    opened.pop_to(k)
            continue
        if tag == "html":
            root.attrs = {**attrs, **root.attrs}
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            opened.pop_to(len(stack) - 1)
        if tag in CLOSES:
            opened.close(*CLOSES[tag])
        if tag in ENDS_P:
            opened.close({"p"}, P_SCOPE)
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Element("tr")
            put(row)
            _mark_cells(stack)
            opened.push(row)
        node = Element(tag, attrs)
        put(node)
        if tag in ("tr", "td", "th"):
            _mark_cells(stack)
        if tag in UNSEEN_PARTS and opened.foreign():
            node.attrs["hidden"] = ""
        if slash and tag not in VOID and opened.foreign():
            continue  # in drawings and formulas a tag can close itself
        if tag in RAW:
            shut = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
            stop = shut.start() if shut else len(html)
            said = html[at:stop]
            if tag == "style":
                rules.append(said)
            node.kids.append(_chars(said) if tag in ("textarea", "title") else said)
            over = html.find(">", stop)
            at = len(html) if over < 0 else over + 1
        elif tag not in VOID:
            opened.push(node)
    if rules:
        root.attrs["style-rules"] = "\n".join(rules)
    return root


def _mark_cells(stack: list[Element]) -> None:
    """Note in all elements around, up to the table, that they hold parts of its grid; each is noted once."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].cells or stack[k].tag in ("table", "caption"):
            return
        stack[k].cells = True


# ---- styles ----

_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_COMPOUND = re.compile(r"(?:\*|[A-Za-z][\w-]*)?(?:[.#][\w-]+)*\Z")
_PART = re.compile(r"([.#]?)([\w-]+)")
_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*([\w-]+)\s*(!\s*important)?", re.I)
_VISIBLE = re.compile(r"(?:^|[;\s])visibility\s*:\s*([\w-]+)\s*(!\s*important)?", re.I)


def _said(body: str, found: re.Pattern) -> tuple[str, bool] | None:
    """The value that a list of declarations ends with, and whether it is important."""
    out = None
    for m in found.finditer(body):
        if out is None or m[2] or not out[1]:
            out = m[1].lower(), bool(m[2])
    return out


def _bodies(css: str) -> Iterator[tuple[str, str]]:
    """Selector and declarations of each rule, those for screens included."""
    css = _COMMENT.sub(" ", css)
    at, on = 0, []  # whether each open block counts
    for m in re.finditer(r"[{};]", css):
        if m[0] == "{":
            head = css[at : m.start()].strip()
            if head.startswith("@"):
                on.append(bool(re.match(r"@(?:media\s+(?:only\s+)?(?:all|screen)\s*$|layer\b|supports\b)", head, re.I)))
                at = m.end()
            else:
                on.append(None)
                opened, at = head, m.end()
        elif m[0] == "}":
            if on and on.pop() is None and all(x is not False for x in on):
                yield opened, css[at : m.start()]
            at = m.end()
        elif not (on and on[-1] is None):
            at = m.end()  # a statement such as @import


class Styles:
    """Rules about what is shown, found by id, class or tag."""

    def __init__(self, css: str):
        self.known: dict[tuple, list] = {}
        rules: dict[tuple, list] = {}  # display and visibility of each compound, as (important, order, value)
        for n, (heads, body) in enumerate(_bodies(css)):
            told = _said(body, _DISPLAY), _said(body, _VISIBLE)
            if told == (None, None):
                continue
            for head in heads.split(","):
                head = head.strip()
                if not head or not _COMPOUND.match(head):
                    continue
                parts = _PART.findall(head)
                tag = "".join(x for mark, x in parts if not mark).lower()
                compound = tag, frozenset(x for mark, x in parts if mark == "#"), frozenset(x for mark, x in parts if mark == ".")
                rule = rules.setdefault(compound, [None, None])
                for k in (0, 1):
                    if told[k] and (rule[k] is None or (told[k][1], n) > rule[k][:2]):
                        rule[k] = told[k][1], n, told[k][0]
        self.by: dict[str, list[tuple]] = {}
        for (tag, ids, classes), rule in rules.items():
            keys = ["#" + x for x in ids] or ["." + x for x in classes] or [tag]
            key = min(keys, key=lambda x: (len(self.by.get(x, ())), x))
            self.by.setdefault(key, []).append((tag, ids, classes, (len(ids), len(classes), bool(tag)), rule))

    def _by_rules(self, tag: str, id_: str, names: str) -> list:
        """The best (important, specificity, order, value) for display and for visibility."""
        found = self.known.get((tag, id_, names))
        if found is None:
            found, classes = [None, None], {*names.split()}
            for key in ("", tag, "#" + id_, *("." + x for x in sorted(classes))):
                for of, ids, needed, rank, rule in self.by.get(key, ()):
                    if of in ("", tag) and ids <= {id_} and needed <= classes:
                        for k in (0, 1):
                            if rule[k] and (found[k] is None or (rule[k][0], rank, rule[k][1]) > found[k][:3]):
                                found[k] = rule[k][0], rank, rule[k][1], rule[k][2]
            self.known[tag, id_, names] = found
        return found

    def of(self, node: Element) -> list:
        """The display and the visibility that rules and the element itself ask for; None where nothing does."""
        style = node.attrs.get("style")
        own = (_said(style, _DISPLAY), _said(style, _VISIBLE)) if style else (None, None)
        best = self._by_rules(node.tag, node.attrs.get("id", ""), node.attrs.get("class", "")) if self.by else (None, None)
        out = []
        for k in (0, 1):
            rule = best[k]
            if own[k] and not (rule and rule[0] and not own[k][1]):
                out.append(own[k][0])
            else:
                out.append(rule[3] if rule else None)
        return out


def _own_line(node: Element) -> bool:
    """Texts of a drawing, and parts of them that are placed anew."""
    return node.tag == "text" or (node.tag == "tspan" and not node.attrs.keys().isdisjoint(("x", "y", "dy")))


def width(text: str) -> int:
    """Columns that a text takes."""
    if text.isascii():
        return len(text)
    wide = sum(unicodedata.east_asian_width(c) in "WF" for c in text)
    return len(text) + wide - sum(unicodedata.combining(c) > 0 or unicodedata.category(c) in ("Mn", "Me", "Cf") for c in text)


class _Out:
    """Lines of text; knows how many line breaks stand open."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the current line
        self.gap = 0  # wanted breaks before the next text
        self.blank = True  # nothing on the current line yet
        self.said = 0  # texts so far

    def text(self, s: str, keep: bool) -> None:
        if not keep:
            s = _FOLD.sub(" ", s)
            if self.gap or self.blank:
                s = s.lstrip(" ")
            elif s.startswith(" ") and self.parts and self.parts[-1].endswith(" "):
                s = s[1:]
        if not s:
            return
        self._settle()
        self.said += 1
        if keep and "\n" in s:
            for x in s.split("\n"):
                self.parts.append(x)
                self._end()
            s = self.lines.pop()
            self.parts = [s] if s else []
        else:
            self.parts.append(s)
        self.blank = not self.parts

    def _end(self) -> None:
        self.lines.append("".join(self.parts))
        self.parts = []

    def _settle(self) -> None:
        if self.gap and (self.lines or self.parts):
            self._end()
            self.lines.extend([""] * (self.gap - 1))
        self.gap = 0

    def brk(self, n: int) -> None:
        """At least n line breaks before what follows."""
        self.gap = max(self.gap, n)
        self.blank = True

    def newline(self) -> None:
        self._settle()
        self._end()
        self.blank = True

    def done(self) -> list[str]:
        self._end()
        lines = [x.rstrip(" ") for x in self.lines]
        first = next((k for k, x in enumerate(lines) if x), len(lines))
        end = next((k for k in range(len(lines), first, -1) if lines[k - 1]), first)
        return lines[first:end]


class _View:
    """How a piece is shown: kept white space, visibility, and the level of the list around it (None: none)."""

    __slots__ = ("keep", "seen", "level")

    def __init__(self, keep: bool = False, seen: bool = True, level: int | None = None):
        self.keep, self.seen, self.level = keep, seen, level


def _span(said: str | None, most: int) -> int:
    return min(int(said[:9]), most) if said and said.isascii() and said.isdigit() else 1


class Renderer:
    """Renders a tree. Its methods are generators that yield the generators of what is inside, so ``run`` needs no recursion."""

    def __init__(self, root: Element):
        self.styles = Styles(root.attrs.pop("style-rules", ""))

    @staticmethod
    def run(work: Iterator) -> None:
        todo = [work]
        while todo:
            inner = next(todo[-1], None)
            if inner is None:
                todo.pop()
            else:
                todo.append(inner)

    def shown(self, node: Element, seen: bool) -> bool | None:
        """None if nothing of it is shown, else whether its own texts are."""
        if node.tag in HIDDEN or (node.tag == "dialog" and "open" not in node.attrs):
            return None
        attrs = node.attrs
        if not self.styles.by and "style" not in attrs:
            return None if "hidden" in attrs else seen
        display, visibility = self.styles.of(node)
        if display == "none" or ("hidden" in attrs and display is None):
            return None
        return seen if visibility in (None, "inherit", "unset") else visibility not in ("hidden", "collapse")

    def kids(self, node: Element, out: _Out, view: _View) -> Iterator:
        for kid in node.kids:
            if isinstance(kid, str):
                if view.seen:
                    out.text(kid, view.keep)
            else:
                yield self.element(kid, out, view)

    def element(self, node: Element, out: _Out, view: _View) -> Iterator:
        seen = self.shown(node, view.seen)
        if seen is None:
            return
        tag = node.tag
        if tag == "br":
            out.newline()
            return
        if tag == "img":
            if seen:
                out.text(node.attrs.get("alt", ""), False)
            return
        space = 2 if tag in SPACED and not (tag in LISTS and view.level is not None) else 1 if tag in BLOCK or _own_line(node) else 0
        if space:
            out.brk(space)
        if tag == "table":
            yield self.table(node, out, _View(False, seen))
        elif tag in LISTS:
            yield self.list(node, out, _View(view.keep, seen, view.level))
        else:
            inner = _View(view.keep or tag in ("pre", "textarea", "xmp"), seen, view.level)
            if tag in APART:
                for kid in node.kids:
                    yield self.kids(_only(kid), out, inner)
                    out.text(" ", False)
            else:
                yield self.kids(node, out, inner)
            if tag in ("td", "th", "mtd"):
                out.text(" ", False)
        if space:
            out.brk(space)

    def list(self, node: Element, out: _Out, view: _View) -> Iterator:
        number = node.attrs.get("start", "1")
        at = int(number) if re.fullmatch(r"-?[0-9]{1,9}", number) else 1
        level = view.level or 0
        for kid in node.kids:
            seen = self.shown(kid, view.seen) if isinstance(kid, Element) and kid.tag == "li" else None
            if seen is None:
                yield self.kids(_only(kid), out, view)
                continue
            out.brk(1)
            value = kid.attrs.get("value", "")
            at = int(value) if node.tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", value) else at
            if seen:
                out.text("  " * min(level, ALIGN) + (f"{at}. " if node.tag == "ol" else "- "), True)
            out.blank = True  # what follows the mark starts a line
            at += 1
            said, inner = out.said, _View(view.keep, seen, level + 1)
            for x in kid.kids:
                if isinstance(x, Element) and x.tag in BLOCK and out.said == said and x.tag not in LISTS and x.tag != "table":
                    shown = self.shown(x, seen)
                    if shown is not None:  # a block that opens the item stands beside its mark
                        yield self.kids(x, out, _View(inner.keep or x.tag == "pre", shown, level + 1))
                        out.brk(1)
                else:
                    yield self.kids(_only(x), out, inner)
            out.brk(1)

    def rows(self, kids: list, row: list | None, view: _View, loose: list, tables: list, rows: list) -> Iterator:
        """What stands beside the cells (None: a new line), tables opened outside a cell, and the rows of cells, each with its view.

        Cells count wherever they are, so also in a form around them.
        """
        for kid in kids:
            if isinstance(kid, str):
                loose.append((kid, view) if kid.strip() else None)
                continue
            seen = self.shown(kid, view.seen)
            if seen is None:
                continue
            inner = view if seen == view.seen else _View(False, seen)
            if kid.tag in ("td", "th"):
                if row is None:
                    row = []
                    rows.append(row)
                row.append((kid, inner))
                loose.append(None)
            elif kid.tag == "tr":
                rows.append([])
                yield self.rows(kid.kids, rows[-1], inner, loose, tables, rows)
                loose.append(None)
                row = None
            elif kid.tag in ("thead", "tbody", "tfoot") or (kid.cells and kid.tag not in ("table", "caption")):
                yield self.rows(kid.kids, row, inner, loose, tables, rows)
            elif kid.tag == "table":
                tables.append((kid, view))
            else:
                loose.append((kid, view))

    def table(self, node: Element, out: _Out, view: _View) -> Iterator:
        loose: list = []
        tables: list = []
        rows: list = []
        yield self.rows(node.kids, None, view, loose, tables, rows)
        out.brk(1)
        for x in loose:
            if x is None:
                out.brk(1)
            else:
                yield self.kids(_only(x[0]), out, x[1])
        if len(rows) == 1 and len(rows[0]) == 1:  # a lone cell needs no grid
            cell, inner = rows[0][0]
            out.brk(1)
            yield self.kids(cell, out, inner)
        else:
            grid = []
            for row, places in zip(rows, _places(rows), strict=True):
                cells = []
                for (cell, inner), (col, span) in zip(row, places, strict=True):
                    sub = _Out()
                    yield self.kids(cell, sub, inner)
                    cells.append((col, span, sub.done()))
                grid.append(cells)
            for line in _laid_out(grid):
                out.brk(1)
                out.text(line, True)
        out.brk(1)
        for inner, around in tables:
            yield self.element(inner, out, around)


def _only(kid: Element | str) -> Element:
    """An element around a single piece."""
    box = Element("")
    box.kids = [kid]
    return box


def _places(rows: list) -> list[list[tuple[int, int]]]:
    """Column and width in columns of each cell. Cells of earlier rows that reach down keep their columns."""
    out = []
    taken: list[tuple[int, int, int]] = []  # first column, column after, last row; by column
    for r, row in enumerate(rows):
        taken = [x for x in taken if x[2] >= r]
        places, new, col, k = [], [], 0, 0
        for cell, _ in row:
            while k < len(taken) and taken[k][0] <= col:
                col, k = max(col, taken[k][1]), k + 1
            span = max(1, _span(cell.attrs.get("colspan"), COLSPAN))
            places.append((col, span))
            down = _span(cell.attrs.get("rowspan"), ROWSPAN)
            if down != 1:
                until = r + down - 1 if down else len(rows)
                if new and new[-1][1] == col and new[-1][2] == until:
                    new[-1] = (new[-1][0], col + span, until)
                else:
                    new.append((col, col + span, until))
            col += span
        if new:
            taken = sorted(taken + new)
        out.append(places)
    return out


def _laid_out(grid: list[list[tuple[int, int, list[str]]]]) -> Iterator[str]:
    """Lines of a grid: columns in which a cell starts, two blanks apart; a cell over several columns may use them all."""
    used = sorted({col for row in grid for col, _, lines in row})
    place = {col: k for k, col in enumerate(used)}
    wide = [0] * len(used)
    fits = lambda lines: max((w for w in map(width, lines) if w <= ALIGN), default=0)
    spread = []
    for row in grid:
        for col, span, lines in row:
            k = place[col]
            if span == 1 or k + 1 == len(used) or used[k + 1] >= col + span:
                wide[k] = max(wide[k], fits(lines))
            else:
                spread.append((k, col + span, lines))
    for k, end, lines in spread:
        stop = bisect_left(used, end)
        lack = fits(lines) - sum(wide[k:stop]) - 2 * (stop - k - 1)
        if lack > 0:
            wide[stop - 1] += lack
    start = [0]
    for w in wide:
        start.append(start[-1] + w + 2)
    for row in grid:
        for n in range(max((len(lines) for _, _, lines in row), default=0)):
            line, at = [], 0
            for col, _, lines in row:
                if n < len(lines) and lines[n]:
                    gap = min(max(start[place[col]] - at, 2) if line else start[place[col]], GAP)
                    line.append(" " * gap + lines[n])
                    at += gap + width(lines[n])
            yield "".join(line).rstrip(" ")


def extract(html: str | None) -> str:
    """All visible text of a page."""
    tree, out = parse(html or ""), _Out()
    view = Renderer(tree)
    view.run(view.element(tree, out, _View()))
    return "\n".join(out.done())


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """<id_col>, text of every row."""
    kind = pages.schema[id_col].dataType.simpleString()
    return map_batches(pages.select(id_col, html_col), lambda cols: [cols[0], [extract(h) for h in cols[1]]], f"`{id_col}` {kind}, text string", rows=256)
