"""Visible text of HTML pages, laid out as lines.

A tree builder turns the markup into properly nested elements: it closes
what HTML lets authors leave open (paragraphs, list items, table parts,
options), ignores end tags without a start, and treats scripts and the like
as raw text. A head ends where something stands that may not be in it. The
renderer leaves out what a browser does not show (head, scripts, ``hidden``,
``display:none`` and ``visibility:hidden`` in style attributes or in
style-sheet rules that hold on any screen, closed
details, drawings but for their text), keeps a blank
line around paragraphs and headings, a line per block, markers and
indentation for lists, the lines of ``pre``, and pads the cells of a table
so that its columns are aligned. Cells are wrapped at ``WRAP`` characters,
as a browser wraps them; a longer word stands out on its own line alone.

Rules count for selectors of tags, classes, ids and attributes, joined in one
compound or as descendants and children; rules with other selectors (states,
siblings) hide nothing. An element knows which parts of the selectors it and
the elements around it have matched, so no rule walks the open elements.

Each page is one walk over its markup with a stack of open elements and,
for each name, the places where it is open; tags, quotes and end tags that
are never closed are looked for once. Pages are independent, so nothing is
shuffled.

Defined results: a null or empty page has the empty text; null and repeated
ids are rendered row by row; markup that is cut off is rendered up to its
end; an empty table gives an empty result. Columns other than page_id and
html are not read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame

from veeduria.llm.common import tidy

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript datalist iframe noembed noframes object audio video "
                   "canvas".split())
HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template head html".split())
UNDRAWN = {"svg": frozenset("defs symbol desc metadata clippath mask pattern marker".split()),
           "math": frozenset("annotation annotation-xml mphantom".split())}
ENDS_DRAWING = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li "
                         "listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
VERBATIM = {"pre", "xmp"}
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre xmp table figure fieldset menu hr".split())
BLOCK = SPACED | frozenset("html body div section article aside nav header footer main address li dt dd form figcaption "
                           "caption details summary legend center dialog hgroup option optgroup search".split())
CLOSES_P = BLOCK - frozenset("html body caption option optgroup li dt dd".split()) | {"li", "dt", "dd"}
#: Start tag: the open elements it ends, and those beyond which it does not look.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    **{x: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"})
       for x in ("thead", "tbody", "tfoot")},
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
CELL = {"td", "th"}
WRAP = 60                     # characters in a line of a cell
#: The greatest spans and list numbers of HTML.
MOST = {"colspan": 1000, "rowspan": 65534, "start": 2**31 - 1, "value": 2**31 - 1}

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_VALUE = re.compile(r"=\s*([\"'])|>")
_ZEROS = re.compile(r"&#(?:0+(?=[0-9])|([xX])0+(?=[0-9a-fA-F]))")
_TOO_LONG = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
_PART = re.compile(r"\s*([>+~]?)\s*((?:[^\s>+~\[]|\[[^\]]*\])+)")
_SIMPLE = re.compile(r"([.#]?)((?:[\w-]|[^\x00-\x7f]|\\.)+)|\[\s*([\w-]+)\s*(?:([~|^$*]?)=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\]]*))\s*)?\]|(\*)")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_CSS = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[{};]", re.S)
_NESTED = re.compile(r"[^{};]*\{[^{}]*\}")
GONE, BLANK = 2, 1            # not laid out; laid out without its text
_SPACE = re.compile(r"[ \t\n\f\r]+")


def on_screen(media: str) -> bool:
    """Whether a media query list holds on every screen."""
    return any(x.strip().lower() in ("", "all", "screen", "only all", "only screen") for x in media.split(","))


def style_rules(css: str) -> list[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on every screen."""
    css = _COMMENT.sub(" ", css)
    out, blocks, at = [], [], 0
    for m in _CSS.finditer(css + "}" * css.count("{")):
        if m[0] == "{":
            blocks.append((css[at:m.start()].strip(), m.end()))
            at = m.end()
        elif m[0] == "}":
            if blocks:
                names, start = blocks.pop()
                if not names.startswith("@") and all(x.lower().startswith("@layer") or x.lower().startswith("@media")
                                                     and on_screen(x[6:]) for x, _ in blocks):
                    out.append((names, _NESTED.sub("", css[start:m.start()])))
            at = m.end()
        elif m[0] == ";" and (not blocks or blocks[-1][0].startswith("@")):
            at = m.end()
    return out


def shown(declarations: str) -> dict[str, tuple[bool, str]]:
    """(important, value) of display and visibility, as declared last."""
    out: dict[str, tuple[bool, str]] = {}
    for d in _COMMENT.sub(" ", declarations).lower().split(";"):
        name, _, value = d.partition(":")
        value, mark, _ = value.partition("!")
        if name.strip() in ("display", "visibility") and (bool(mark) or not out.get(name.strip(), (False,))[0]):
            out[name.strip()] = (bool(mark), value.strip())
    return out


def number(attrs: dict[str, str], name: str, otherwise: int = 1) -> int:
    """A whole number of an attribute, at most what HTML allows."""
    t = attrs.get(name, "").strip()
    if not (t.isascii() and t.isdecimal()):
        return otherwise
    return min(int(t.lstrip("0")[:10] or "0"), MOST[name])


def unescape(text: str) -> str:
    """Character references resolved; numbers beyond all characters, however
    long, are the replacement character."""
    if "&#" in text:
        text = _TOO_LONG.sub("\ufffd", _ZEROS.sub(lambda m: "&#" + (m[1] or ""), text))
    return entities.unescape(text)


class Selector:
    """A selector's parts: (child or descendant, tests); ``tests`` are (kind,
    name, operator, value) with kind tag, class, id, attribute or any."""

    def __init__(self, text: str):
        self.parts: list[tuple[str, list[tuple]]] = []
        self.weight, at = [0, 0, 0], 0
        while at < len(text):
            m = _PART.match(text, at)
            if not m or m[1] in ("+", "~"):
                raise ValueError(text)
            self.parts.append((m[1] or " ", self.compound(m[2])))
            at = m.end() if text[m.end():].strip() else len(text)
        if not self.parts or self.parts[0][0] != " ":
            raise ValueError(text)

    def compound(self, text: str) -> list[tuple]:
        tests, at = [], 0
        while at < len(text):
            m = _SIMPLE.match(text, at)
            if not m:
                raise ValueError(text)
            if m[3]:
                value = next((x for x in m.group(5, 6, 7) if x is not None), None)
                tests.append(("attribute", m[3].lower(), m[4], value))
            elif m[8]:
                tests.append(("any", "", "", None))
            else:
                kind = {".": "class", "#": "id", "": "tag"}[m[1]]
                tests.append((kind, m[2].lower() if kind == "tag" else m[2].replace("\\", ""), "", None))
            kind = tests[-1][0]
            if kind != "any":
                self.weight[("id", "class", "tag").index(kind if kind != "attribute" else "class")] += 1
            at = m.end()
        return tests


def _has(value: str | None, how: str, wanted: str | None) -> bool:
    if value is None or wanted is None:
        return value is not None
    return {"": value == wanted, "~": wanted in value.split(), "|": value == wanted or value.startswith(wanted + "-"),
            "^": value.startswith(wanted), "$": value.endswith(wanted), "*": wanted in value}[how] and (wanted != "" or how == "")


class Lines:
    """Text being laid out: finished lines and the line being filled."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False
        self.indent: list[str] = []
        self.marker = ""

    def text(self, s: str):
        self.now.append(s)

    def end_line(self, keep: bool = False):
        s = "".join(self.now)
        s = s.rstrip(" ") if keep else _SPACE.sub(" ", s).strip(" ")
        self.now = []
        if s or keep:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            pad = "".join(self.indent)
            if self.marker:
                pad = pad[:len(pad) - len(self.marker)] + self.marker
                self.marker = ""
            self.lines.append(pad + s if s else "")

    def put(self, lines: list[str]):
        self.end_line()
        for x in lines:
            self.now = [x]
            self.end_line(keep=True)


class Page:
    """Builds the element stack of one page and renders as it goes."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []       # (element, 0, BLANK or GONE)
        self.out = [Lines()]
        self.tables: list[dict] = []
        self.lists: list[list] = []
        self.at: dict[str, list[int]] = {}           # where each name is open in the stack
        self.matched: list[tuple[frozenset, frozenset]] = []     # per open element: parts it matches; with those around it
        self.selectors: list[tuple[Selector, dict]] = []     # and (property, important, weight, order, value)
        self.parts: dict[tuple, list[tuple[int, int]]] = {}      # a test of a part: (selector, part)
        self.numbers: dict[str, int] = {}            # of the selectors by their text
        self.n_rules = 0
        self.drawn = False       # a drawing or formula was met
        self.fresh = False

    # ---------------------------------------------------------------- tree --
    def hidden(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def push(self, tag: str, hidden: int, matched: tuple[frozenset, frozenset]):
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, hidden))
        self.matched.append(matched)

    def pop(self) -> tuple[str, int]:
        name, hidden = self.stack.pop()
        self.matched.pop()
        self.at[name.partition(":")[0]].pop()
        return name, hidden

    def last(self, names) -> int:
        """Where the innermost open element of these names is; -1: nowhere."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def drawing(self) -> str:
        """The drawing or formula that the next words are a part of."""
        if not self.drawn:
            return ""
        i = self.last(("svg", "math", "foreignobject"))
        return self.stack[i][0] if i >= 0 and self.stack[i][0] != "foreignobject" else ""

    def start(self, tag: str, attrs: dict[str, str], closed: bool = False):
        if self.stack and self.stack[-1][0] == "head" and tag not in HEAD:
            self.leave(*self.pop())
        if tag == "html" and self.stack or tag == "head" and len(self.stack) > len(self.at.get("html", ())):
            return
        self.drawn = self.drawn or tag in UNDRAWN
        inside = self.drawing()
        if inside and tag in ENDS_DRAWING:
            self.close({inside}, {"foreignobject"})
            inside = self.drawing()
        if tag in CLOSES_P or tag == "table":
            self.close({"p"}, CELL | {"table", "button"})
        if tag in IMPLIED:
            self.close(*IMPLIED[tag])
        if tag in CELL and self.tables and not self.inside("tr"):
            self.start("tr", {})
        matched = self.match(tag, attrs)
        hidden = self.hides(tag, attrs, inside, matched[0])
        if tag in VOID or inside and closed:
            if hidden != GONE and tag in VOID:
                self.enter(tag, attrs)
            return
        self.push(tag, hidden, matched)
        if hidden != GONE:
            self.enter(tag, attrs)

    def inside(self, tag: str) -> bool:
        return self.last((tag,)) > self.last(("table",))

    def match(self, tag: str, attrs: dict[str, str]) -> tuple[frozenset, frozenset]:
        """The selector parts that an element matches as the end of what is
        before them, and these with those of the elements around it."""
        own, (above, around) = set(), self.matched[-1] if self.matched else (frozenset(), frozenset())
        if self.parts:
            classes = attrs.get("class", "").split()
            keys = [("tag", tag), ("any", ""), ("id", attrs.get("id", "")), *(("class", c) for c in set(classes)),
                    *(("attribute", a) for a in attrs)]
            for key in keys:
                for s, i in self.parts.get(key, ()):
                    how, tests = self.selectors[s][0].parts[i]
                    if (i == 0 or (s, i - 1) in (above if how == ">" else around)) and all(
                            kind == "any" or kind == "tag" and name == tag or kind == "id" and name == attrs.get("id")
                            or kind == "class" and name in classes
                            or kind == "attribute" and _has(attrs.get(name), how_, value)
                            for kind, name, how_, value in tests):
                        own.add((s, i))
        mine = frozenset(own)
        return mine, around if mine <= around else around | mine

    def hides(self, tag: str, attrs: dict[str, str], inside: str, matched: frozenset) -> int:
        above = self.hidden()
        closed = bool(self.stack) and self.stack[-1][0] == "details:closed" and tag != "summary"
        if above == GONE or tag in UNSEEN or closed or tag in UNDRAWN.get(inside, ()):
            return GONE
        best: dict[str, tuple] = {}
        first = [float("inf")]                      # a style attribute comes before all rules
        own = [(k, important, first, 0, v) for k, (important, v) in shown(attrs["style"]).items()] if "style" in attrs else []
        for n, i in matched:
            if i == len(self.selectors[n][0].parts) - 1:
                own += self.selectors[n][1].values()
        for k, *rank in own:
            best[k] = max(best.get(k, rank), rank)
        display, visible = (best[k][-1] if k in best else None for k in ("display", "visibility"))
        if display == "none" or display is None and ("hidden" in attrs or tag == "dialog" and "open" not in attrs):
            return GONE
        if visible in ("hidden", "collapse"):
            return BLANK
        return 0 if visible in ("visible", "initial") else above

    def read_style(self, css: str):
        for names, body in style_rules(css):
            found = shown(body)
            self.n_rules += 1
            for name in {x.strip() for x in names.split(",")} if found else ():
                if name not in self.numbers:
                    try:
                        self.add_selector(name, Selector(name))
                    except ValueError:
                        continue                    # a state, a sibling: not known to hold
                rule, values = self.selectors[self.numbers[name]]
                for k, (important, v) in found.items():
                    # a later rule of the same selector counts, but for an important one
                    values[k, important] = (k, important, rule.weight, self.n_rules, v)

    def add_selector(self, name: str, rule: Selector):
        n = self.numbers[name] = len(self.selectors)
        self.selectors.append((rule, {}))
        for i, (_, tests) in enumerate(rule.parts):
            # found by its most telling test
            kind, test, *_ = min(tests, key=lambda t: ("id", "class", "attribute", "tag", "any").index(t[0]))
            self.parts.setdefault((kind, test), []).append((n, i))

    def close(self, tags: set[str], stop: set[str]):
        """End the outermost element of ``tags`` above any of ``stop``."""
        border, first = self.last(stop), []
        for t in tags:
            open_at = self.at.get(t, ())
            i = bisect_right(open_at, border)
            if i < len(open_at):
                first.append(open_at[i])
        while first and len(self.stack) > min(first):
            self.leave(*self.pop())

    def end(self, tag: str):
        if tag == "br":
            self.start("br", {})
            return
        stop = set() if tag in ("table", "body", "html") else {"table"} if tag in CELL | {"tr", "thead", "tbody", "tfoot"} \
            else CELL | {"table"}
        at = self.last((tag,))
        if at < 0 or at < self.last(stop - {tag}):
            return
        while len(self.stack) > at:
            self.leave(*self.pop())

    # -------------------------------------------------------------- render --
    def block(self, tag: str):
        o = self.out[-1]
        o.end_line()
        if tag in SPACED and not (tag in ("ul", "ol", "menu") and len(self.lists) > (tag != "")):
            o.gap = True

    def enter(self, tag: str, attrs: dict[str, str]):
        o = self.out[-1]
        if tag == "br":
            o.end_line(keep=bool(o.now))
        elif tag in ("text", "mtd") and self.drawing():
            o.text(" ")
        elif tag == "table":
            self.block(tag)
            self.tables.append({"rows": [], "taken": []})
        elif tag == "tr" and self.tables:
            self.tables[-1]["rows"].append([0, []])      # the next column; (column, lines) of its cells
        elif tag in CELL and self.tables:
            self.tables[-1]["span"] = [max(1, number(attrs, k)) for k in ("colspan", "rowspan")]
            self.out.append(Lines())
        elif tag in BLOCK:
            if tag in ("ul", "ol", "menu"):
                self.lists.append([tag, number(attrs, "start")])
            self.block(tag)
            self.fresh = tag == "pre"
            if tag == "li":
                marker = "- "
                if self.lists and self.lists[-1][0] == "ol":
                    self.lists[-1][1] = number(attrs, "value", self.lists[-1][1])
                    marker = f"{self.lists[-1][1]}. "
                    self.lists[-1][1] += 1
                o.indent.append(" " * len(marker))
                o.marker = marker
            elif tag in ("blockquote", "dd"):
                o.indent.append("  ")
            elif tag == "details" and "open" not in attrs:
                self.stack[-1] = ("details:closed", self.stack[-1][1])

    def leave(self, tag: str, hidden: int):
        if hidden == GONE:
            return
        o = self.out[-1]
        if tag in CELL and self.tables and len(self.out) > 1:
            o.end_line()
            self.out.pop()
            table = self.tables[-1]
            wide, tall = table.pop("span", (1, 1))
            row, at, taken = table["rows"][-1], len(table["rows"]) - 1, table["taken"]
            i = bisect_right(taken, row[0], key=lambda t: t[0]) - 1
            while i >= 0 and i < len(taken):             # columns taken by a cell above
                first, beyond, until = taken[i]
                if until < at:
                    del taken[i]                         # it ended; the next one moves here
                    i -= i == len(taken)
                elif first <= row[0] < beyond:
                    row[0] = beyond
                    i += 1
                elif first > row[0]:
                    break
                else:
                    i += 1
            if tall > 1:
                insort(taken, (row[0], row[0] + wide, at + tall - 1))
            row[1].append((row[0], o.lines))
            row[0] += wide
        elif tag == "table" and self.tables:
            self.block(tag)
            self.out[-1].put(aligned([cells for _, cells in self.tables.pop()["rows"]]))
            self.block(tag)
        elif tag.partition(":")[0] in BLOCK:
            if tag in VERBATIM:
                if "".join(o.now):
                    o.end_line(keep=True)
                o.now = []
            if tag in ("ul", "ol", "menu") and self.lists:
                self.lists.pop()
                o.end_line()
                o.gap = o.gap or not self.lists
            else:
                self.block(tag.partition(":")[0])
            if tag in ("li", "blockquote", "dd") and o.indent:
                o.indent.pop()
                if tag == "li":
                    o.marker = ""
        elif tag == "textarea" or tag in ("text", "mtd") and self.drawing():
            o.text(" ")

    def chars(self, s: str):
        if s and self.stack and self.stack[-1][0] == "head" and s.strip(" \t\n\f\r"):
            self.leave(*self.pop())
        if not s or self.hidden():
            return
        if self.drawn and self.last(("svg",)) > self.last(("text", "foreignobject")):
            return
        if self.stack and self.stack[-1][0] == "details:closed":
            return
        o = self.out[-1]
        if self.last(VERBATIM) >= 0:
            s = s.replace("\r\n", "\n")
            if self.fresh:
                s, self.fresh = s.removeprefix("\n"), False
            first, *more = s.split("\n")
            o.text(first)
            for line in more:
                o.end_line(keep=True)
                o.now = [line]
        elif self.tables and len(self.out) <= len(self.tables) and not s.strip():
            return
        else:
            o.text(s)

    def render(self, markup: str) -> str:
        at, tags = 0, Tags(markup)
        while at < len(markup):
            begin, end, name = tags.next(at)
            self.chars(unescape(markup[at:begin]))
            at = end
            if not name:
                continue
            tag = name.lower()
            if markup[begin + 1] == "/":
                self.end(tag)
                continue
            inner = markup[begin + 1 + len(name):end - 1]
            attrs: dict[str, str] = {}
            for a, x, y, z in _ATTR.findall(inner):
                attrs.setdefault(a.lower(), unescape(x or y or z or ""))
            self.start(tag, attrs, inner.endswith("/"))
            if tag in RAW:
                begin, end = tags.raw_end(tag, at)
                raw = markup[at:begin]
                if tag == "style" and on_screen(attrs.get("media", "")) and self.last(("noscript", "template")) < 0:
                    self.read_style(raw)
                self.chars(unescape(raw) if tag == "textarea" else raw if tag == "xmp" else "")
                at = end
                self.end(tag)
        while self.stack:
            self.leave(*self.pop())
        self.out[0].end_line()
        return "\n".join(x.rstrip(" ") for x in self.out[0].lines)


class Tags:
    """Finds the tags of a page from left to right. What is not found once
    (a quote, an end) is not looked for again further on."""

    def __init__(self, markup: str):
        self.markup = markup
        self.missing: set[str] = set()

    def find(self, what: str, at: int) -> int:
        i = -1 if what in self.missing else self.markup.find(what, at)
        if i < 0:
            self.missing.add(what)
        return i

    def next(self, at: int) -> tuple[int, int, str]:
        """(begin, end, name) of the next tag; comments and the like have no
        name; at the page's end an empty one."""
        m, size = self.markup, len(self.markup)
        while True:
            begin = self.find("<", at)
            if begin < 0:
                return size, size, ""
            if m.startswith("<!--", begin):
                end = self.find("-->", begin + 4)
                return begin, size if end < 0 else end + 3, ""
            if m[begin + 1:begin + 2] in ("!", "?"):
                end = self.find(">", begin)
                return begin, size if end < 0 else end + 1, ""
            name = _NAME.match(m, begin)
            if name:
                end = self.tag_end(name.end())
                if end > 0:
                    return begin, end, name[1]
            at = begin + 1

    def tag_end(self, at: int) -> int:
        """Behind the ``>`` that ends a tag, quoted values passed over; a quote
        that is never closed is no quote. 0: the tag has no end."""
        start = at
        while ">" not in self.missing:
            m = _VALUE.search(self.markup, at)
            if not m:
                break
            if not m[1]:
                return m.end()
            close = self.find(m[1], m.end())
            if close < 0:
                break
            at = close + 1
        end = self.find(">", start)
        return end + 1

    def raw_end(self, tag: str, at: int) -> tuple[int, int]:
        """(begin, end) of the end tag of a raw element, or the page's end."""
        size, what = len(self.markup), f"</{tag}>"
        if what not in self.missing:
            m = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.markup, at)
            if m:
                return m.span()
            self.missing.add(what)
        return size, size


def wrapped(line: str) -> list[str]:
    """Lines of at most ``WRAP`` characters, broken at blanks."""
    out = []
    while len(line) > WRAP:
        cut = line.rfind(" ", 1, WRAP + 1)
        cut = cut if cut > 0 and line[:cut].strip(" ") else line.find(" ", WRAP)
        if cut < 0:
            break
        out.append(line[:cut])
        line = line[cut + 1:].lstrip(" ")
    return [*out, line]


def aligned(rows: list[list[tuple[int, list[str]]]]) -> list[str]:
    """Lines of a table whose columns start at the same place; its rows are
    (column, lines) of their cells. Columns without a text are left out."""
    rows = [[(i, [y for x in c for y in wrapped(x)]) for i, c in r] for r in rows if any(c for _, c in r)]
    width: dict[int, int] = {}
    for r in rows:
        for i, cell in r:
            for line in cell:
                width[i] = max(width.get(i, 0), len(line) if len(line) <= WRAP else 0)
    columns = sorted(width)
    place = {i: k for k, i in enumerate(columns)}
    out = []
    for r in rows:
        cells = [(place[i], c) for i, c in r if c]
        last = max(k for k, _ in cells)
        for n in range(max(len(c) for _, c in cells)):
            parts = [" " * width[columns[k]] for k in range(last + 1)]
            for k, c in cells:
                parts[k] = (c[n] if n < len(c) else "").ljust(width[columns[k]])
            out.append(" | ".join(parts).rstrip(" ") if len(columns) > 1 else parts[0].rstrip(" "))
    return out


def visible_text(markup: str | None) -> str:
    return Page().render(markup or "")


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, text."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([visible_text(x) for x in b.column(1).to_pylist()], pa.string())],
                names=["page_id", "text"])
    return pages.selectExpr("cast(page_id as long) page_id", "html").mapInArrow(tidy(run), "page_id long, text string")
