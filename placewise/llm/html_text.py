"""Layout-aware text of HTML pages: a tree builder with implied tags, visibility rules, and a renderer.

`build` makes a tree of any input: void and raw-text elements, end tags that authors leave out (p, li, dt, dd, rows,
cells, options, the head), stray end tags ignored. `render` emits all visible text of it: blocks on lines of their own,
paragraph-like ones with a blank line around them, list items behind their markers with nesting as indentation,
preformatted text as it stands, and table cells in columns, each as wide as its widest cell, spans included. Formulas
(math), drawings' labels (svg) and what stands in for an object that isn't shown are text like any other.

A closed drop-down shows the option that is selected, a list box all options and the labels of their groups; buttons and fields show
their value. Items are numbered as value, start, reversed and type say. The head of a table comes first and its foot last,
wherever they stand, and wide characters count two columns.

Not visible are elements that browsers don't paint (head, script, style, template and the like; definitions, titles and
annotations of svg and math; parentheses for ruby, and what stands in for a meter or a progress bar), the hidden attribute, closed details and dialogs, comments, and what `display: none` takes
out. `visibility: hidden` hides text but not a descendant that is made visible again. Both are read from style
attributes and from rules of style elements whose selector is made of tags, classes and ids, also of descendants and children; the
usual cascade decides between them. Rules with other selectors, and those for media other than screens, are left aside.

Both work with stacks of their own, so nesting of any depth is no recursion. Where full padding would make a table PAD_TIMES
as long as its content and PAD_FREE characters more, columns are narrowed until it doesn't; a cell wider than its column
then ends its line, and the rest of the row follows on the next, still each under its own column. Spans are
held to the limits that the HTML standard sets.

Defined results: a null or empty page has an empty text; text without tags is its own rendering with white space
collapsed; an unclosed comment or raw-text element runs to the end; pages of any length count whole; repeated rows render
alike; an empty table gives no rows; other columns pass.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm._common import fresh

PAD_TIMES = 8
PAD_FREE = 1 << 16
_NARROWEST = 16
#: The largest spans of the HTML standard.
_MOST_COLUMNS, _MOST_ROWS = 1000, 65534

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNPAINTED = frozenset("head title script style template noscript iframe noembed noframes canvas audio video datalist meta link base rp meter progress".split())
#: Not painted within svg and math, and what stands apart from its neighbours there.
UNPAINTED_WITHIN = {
    "svg": frozenset("defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split()),
    "math": frozenset("annotation annotation-xml".split()),
}
APART_WITHIN = {"svg": frozenset({"text"}), "math": frozenset("mtr mtd".split())}
HEAD_ONLY = frozenset("base link meta title script style noscript template head html".split())
#: Blocks with a blank line around them, and blocks that only stand on lines of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table fieldset hr menu".split())
BLOCKS = SPACED | frozenset("address article aside body center dd details dialog div dt figcaption footer form header html legend li main nav optgroup option section summary caption tr td th thead tbody tfoot search".split())
ENDS_P = BLOCKS - frozenset("li dd dt body html option optgroup td th tr thead tbody tfoot caption legend".split()) | {"li", "dd", "dt"}
WALLS = frozenset("table td th caption template button object html body".split())
#: A start tag's name, to the names that it ends and those beyond which it doesn't look.
ENDS = {
    "li": (frozenset({"li"}), frozenset("ul ol menu".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "tr": (frozenset({"tr", "caption"}), frozenset({"table"})),
    "thead": (frozenset("tr thead tbody tfoot caption".split()), frozenset({"table"})),
    "tbody": (frozenset("tr thead tbody tfoot caption".split()), frozenset({"table"})),
    "tfoot": (frozenset("tr thead tbody tfoot caption".split()), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset({"optgroup", "option"}), frozenset({"select"})),
}

#: Kinds of input that show their value, and numerals of lists.
SHOWN_INPUTS = frozenset("submit reset button text search tel url email number date month week time datetime-local".split())
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*>|</?>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")  # for pages with a quote that never closes
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WHITE = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return out


def build(source: str | None) -> Node:
    """The tree of a page, under a node named html."""
    source = (source or "").replace("\r\n", "\n").replace("\0", "")
    root = Node("html")
    opened, at, end, last, loose = [root], 0, len(source), source.rfind(">"), False
    n_open: Counter[str] = Counter()

    def close_to(i: int) -> None:
        n_open.subtract(x.tag for x in opened[i:])
        del opened[i:]

    def innermost(names: frozenset[str], walls: frozenset[str]) -> int:
        if not any(n_open[x] for x in names):
            return 0
        for i in range(len(opened) - 1, 0, -1):
            if opened[i].tag in names:
                return i
            if opened[i].tag in walls:
                return 0
        return 0

    def add_text(text: str) -> None:
        if text:
            if opened[-1].tag == "head" and text.strip():
                close_to(len(opened) - 1)
            opened[-1].children.append(html.unescape(text) if "&" in text else text)

    while at < end:
        start = source.find("<", at)
        if start < 0:
            add_text(source[at:])
            break
        m = None if loose else _TOKEN.match(source, start)
        if m is None and start < last:
            m = _LOOSE.match(source, start) or (_TOKEN.match(source, start) if loose and source[start + 1] in "!?/" else None)
            loose |= m is not None
        if m is None:  # a sign, not a tag
            add_text(source[at : start + 1])
            at = start + 1
            continue
        add_text(source[at:start])
        at = m.end()
        if m[2] is None:
            continue
        closing, tag = m[1], m[2].lower()
        if closing:
            if tag in BLOCKS or tag in WALLS:
                i = innermost(frozenset({tag}), frozenset({"table"}) if tag not in ("table", "body", "html") else frozenset())
            else:
                i = innermost(frozenset({tag}), BLOCKS | WALLS)  # an inline end tag doesn't end blocks
            if i:
                close_to(i)
            continue
        if tag in ("html", "body"):
            if opened[-1].tag == "head":
                close_to(len(opened) - 1)
            continue
        if tag not in HEAD_ONLY and opened[-1].tag == "head":
            close_to(len(opened) - 1)
        while tag in ENDS and (i := innermost(*ENDS[tag])):
            close_to(i)
        if tag in ENDS_P and (i := innermost(frozenset({"p"}), WALLS)):
            close_to(i)
        node = Node(tag, _attributes(m[3]) if m[3] else {})
        opened[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            raw = source[at : stop.start() if stop else end]
            node.children.append(html.unescape(raw) if tag in ("textarea", "title") else raw)
            at = stop.end() if stop else end
            continue
        opened.append(node)
        n_open[tag] += 1
    return root


_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_BRACE = re.compile(r"[{}]")
_COMPOUND = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)\Z")
_SCREENS = frozenset({"", "all", "screen", "only screen"})
_STYLED = ("display", "visibility")


def declared(source: str) -> dict[str, tuple[bool, str]]:
    """(whether important, value) of the properties in a list of declarations that decide visibility."""
    out: dict[str, tuple[bool, str]] = {}
    for part in source.split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if name in _STYLED and value:
            plain = value.removesuffix("important").rstrip().removesuffix("!").rstrip() if value.endswith("important") else value
            if not (name in out and out[name][0] and plain == value):
                out[name] = (plain != value, plain)
    return out


def _marks(node: Node) -> frozenset[str]:
    a = node.attributes
    return frozenset({f".{x}" for x in a.get("class", "").split()} | ({f"#{a['id']}"} if "id" in a else set()))


Compound = tuple[str, frozenset[str]]  # a tag or *, classes and ids


def _is(node: Node, wanted: Compound) -> bool:
    return wanted[0] in ("*", node.tag) and (not wanted[1] or wanted[1] <= _marks(node))


def _names(node: Node) -> list[str]:
    return [node.tag, *_marks(node)]


def _above(chain: list[tuple[str, Compound]], around: list[Node], names: Counter[str]) -> bool:
    """Whether the compounds of a selector, the inmost first, each with its combinator to the one within, are met by the elements around.

    names: how many of those have each tag, class and id.
    """
    if any((tag != "*" and not names[tag]) or not all(names[x] for x in marks) for _, (tag, marks) in chain):
        return False
    at = [len(around)]  # where the element within may stand, the inmost first
    for k, (combinator, wanted) in enumerate(chain):
        if combinator == ">":
            at = [i - 1 for i in at if i and _is(around[i - 1], wanted)]
        elif all(c == " " for c, _ in chain[k:]):  # the nearest leaves most room to the others
            at = [next((i for i in range(at[0] - 1, -1, -1) if _is(around[i], wanted)), -1)]
            at = [] if at == [-1] else at
        else:
            at = [i for i in range(at[0] - 1, -1, -1) if _is(around[i], wanted)]
        if not at:
            return False
    return True


class Sheet:
    """The rules of style elements that bear on visibility, by what their selector asks for."""

    def __init__(self, sources: Iterable[str]) -> None:
        self.rules: dict[str, list[tuple[tuple[int, int, int, int], Compound, list[tuple[str, Compound]], dict[str, tuple[bool, str]]]]] = {}
        self.n = 0
        for source in sources:
            self._read(_COMMENT.sub(" ", source))

    def _read(self, source: str) -> None:
        at = 0
        while (begin := source.find("{", at)) >= 0:
            prelude, depth, end = source[at:begin].rpartition(";")[2].strip(), 1, begin + 1
            while depth and (m := _BRACE.search(source, end)):
                depth += 1 if m[0] == "{" else -1
                end = m.end()
            body = source[begin + 1 : end - 1] if not depth else source[begin + 1 :]
            at = end if not depth else len(source)
            if not prelude.startswith("@"):
                self._add(prelude, declared(body))
            elif prelude[:6].lower() == "@media" and " ".join(prelude[6:].lower().split()) in _SCREENS:
                self._read(body)

    def _add(self, selectors: str, styles: dict[str, tuple[bool, str]]) -> None:
        for selector in selectors.split(",") if styles else ():
            parts = re.sub(r"\s*>\s*", " > ", selector.strip()).split()
            found = [_COMPOUND.match(x) for x in parts if x != ">"]
            steps = [">" if x == ">" else " " for x, y in zip(parts[1:], parts, strict=False) if x == ">" or y != ">"]
            if not found or not all(found) or len(steps) != len(found) - 1:
                continue
            compounds = [((m[1] or "*").lower(), frozenset(re.findall(r"[.#][\w-]+", m[2] or ""))) for m in found]
            if any(tag == "*" and not marks and text != "*" for (tag, marks), text in zip(compounds, (m[0] for m in found), strict=True)):
                continue
            marks = [x for _, of in compounds for x in of]
            ids = sum(x[0] == "#" for x in marks)
            self.n += 1
            weight = (ids, len(marks) - ids, sum(tag != "*" for tag, _ in compounds), self.n)
            own = compounds[-1]
            chain = list(zip(reversed(steps), reversed(compounds[:-1]), strict=True))
            self.rules.setdefault(min(own[1], default=own[0]), []).append((weight, own, chain, styles))

    def styles(self, node: Node, around: list[Node], names: Counter[str]) -> dict[str, str]:
        """What the rules and the node's own style attribute say, after the cascade; around: the elements it stands in, the outmost first."""
        a = node.attributes
        best: dict[str, tuple[tuple, str]] = {}
        if self.rules:
            for key in (node.tag, "*", *_marks(node)):
                for weight, own, chain, styles in self.rules.get(key, ()):
                    if _is(node, own) and (not chain or _above(chain, around, names)):
                        for name, (important, value) in styles.items():
                            best[name] = max(best.get(name, ((False, False, ()), "")), ((important, False, weight), value))
        if "style" in a:
            for name, (important, value) in declared(a["style"]).items():
                best[name] = max(best.get(name, ((False, False, ()), "")), ((important, True, ()), value))
        return {name: value for name, (_, value) in best.items()}


def displayed(node: Node, parent: Node, styles: dict[str, str], within: str) -> bool:
    """Whether a node is laid out at all. within: svg or math if it stands in one."""
    if node.tag in UNPAINTED or node.tag in UNPAINTED_WITHIN.get(within, ()):
        return False
    if parent.tag == "details" and "open" not in parent.attributes and node.tag != "summary":
        return False
    if "display" in styles:
        return styles["display"] != "none"
    return not ("hidden" in node.attributes or (node.tag == "dialog" and "open" not in node.attributes))


@dataclass
class _Flow:
    """Lines of a block of text that grows."""

    lines: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    space: bool = False
    gap: bool = False
    indents: list[str] = field(default_factory=list)
    marker: str = ""

    def put(self, text: str) -> None:
        parts = _WHITE.split(text)
        if len(parts) > 1 and not parts[0]:
            self.space = True
        for i, part in enumerate(parts):
            if part:
                if self.words and (self.space or i):
                    self.words.append(" ")
                self.words.append(part)
                self.space = False
        if len(parts) > 1 and not parts[-1]:
            self.space = True

    def put_lines(self, lines: list[str]) -> None:
        for line in lines:
            self._line(line)

    def _line(self, line: str) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        indent = "".join(self.indents)
        if self.marker:
            indent = "".join(self.indents[:-1]) + self.marker
            self.marker = ""
        self.lines.append((indent + line).rstrip(" ") if line or indent else "")

    def end_line(self, gap: bool = False) -> None:
        if self.words:
            self._line("".join(self.words))
            self.words = []
        self.space = False
        self.gap |= gap

    def new_line(self) -> None:
        if self.words:
            self.end_line()
        elif self.lines and not self.gap:
            self._line("")


@dataclass
class _Table:
    rows: list[list[tuple[int, int, list[str]]]] = field(default_factory=list)  # of cells: first column, columns, lines
    kinds: list[int] = field(default_factory=list)  # of rows: 0 in the head, 1, 2 in the foot
    section: int = 1
    taken: set[int] = field(default_factory=set)
    held: list[tuple[int, int, int]] = field(default_factory=list)  # of cells of rows above: first column, the one after, the row after
    later: list[tuple[int, int, int]] = field(default_factory=list)  # the same of cells of the row that is open
    column: int = 0
    next_held: int = 0

    def new_section(self, kind: int = 1) -> None:
        """kind: as of its rows; a second head or foot is a body."""
        self.held, self.later = [], []
        self.section = 1 if kind in self.taken else kind
        self.taken |= {kind} - {1}

    def new_row(self) -> None:
        n = len(self.rows)
        if self.later or any(end <= n for _, _, end in self.held[:1]):
            self.held = sorted(h for h in (*self.held, *self.later) if h[2] > n)
        self.rows.append([])
        self.kinds.append(self.section)
        self.later, self.column, self.next_held = [], 0, 0

    def add(self, lines: list[str], columns: int, rows: int) -> None:
        if not self.rows:
            self.new_row()
        row = len(self.rows) - 1
        while self.next_held < len(self.held) and self.held[self.next_held][0] <= self.column:
            _, end, last = self.held[self.next_held]
            self.column = max(self.column, end) if last > row else self.column
            self.next_held += 1
        self.rows[-1].append((self.column, columns, lines))
        if rows > 1:
            self.later.append((self.column, self.column + columns, row + rows))
        self.column += columns

    def lines(self) -> list[str]:
        rows = [[c for c in r if c[2]] for _, r in sorted(zip(self.kinds, self.rows, strict=True), key=lambda x: x[0])]
        rows = [r for r in rows if r]
        widths: dict[int, int] = {}
        for first, _, lines in (c for r in rows for c in r if c[1] == 1):
            widths[first] = max(widths.get(first, 0), max(map(width, lines)))
        columns = sorted(widths)
        for first, n, lines in sorted((c for r in rows for c in r if c[1] > 1), key=lambda c: c[1]):
            wide, a = max(map(width, lines)), bisect.bisect_left(columns, first)
            own = columns[a : bisect.bisect_left(columns, first + n)]
            if not own:
                widths[first] = wide
                columns.insert(a, first)
            else:  # what its columns lack, the last of them gets
                widths[own[-1]] += max(0, wide - sum(widths[c] for c in own) - 2 * (len(own) - 1))
        most, offsets = max(widths.values(), default=0), _offsets(widths, columns, None)
        content = sum(len(x) for r in rows for _, _, lines in r for x in lines)
        while most > _NARROWEST and sum(offsets[_column(columns, r[-1][0])] * max(len(c[2]) for c in r) for r in rows) > PAD_TIMES * content + PAD_FREE:
            most = max(_NARROWEST, most // 2)
            offsets = _offsets(widths, columns, most)
        out = []
        for row in rows:
            for k in range(max(len(lines) for _, _, lines in row)):
                line = ""
                for first, _, lines in row:
                    if k < len(lines) and lines[k]:
                        offset = offsets[_column(columns, first)]
                        if line and width(line) + 2 > offset:  # a cell wider than its column
                            out.append(line.rstrip(" "))
                            line = ""
                        line += " " * (offset - width(line)) + lines[k]
                out.append(line.rstrip(" "))
        return out


def width(line: str) -> int:
    """Columns that a line takes: wide characters two, combining ones none."""
    if line.isascii():
        return len(line)
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) or c == "\u200b" else 1 for c in line)


def numeral(n: int, kind: str) -> str:
    """An item's number in the style of a list's type."""
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(ord(kind) + r) + out
        return out
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, sign in ROMAN:
            out += sign * (n // value)
            n %= value
        return out.upper() if kind == "I" else out
    return str(n)


def _whole(text: str | None) -> int | None:
    return int(text.strip()) if text is not None and re.fullmatch(r"-?\d{1,9}", text.strip()) else None


def _shown_options(select: Node) -> set[int] | None:
    """The identity of the option that a closed drop-down shows, alone in a set; None if all are shown."""
    size = _whole(select.attributes.get("size"))
    if "multiple" in select.attributes or (size or 0) > 1:
        return None
    options, work = [], list(reversed(select.children))
    while work:
        node = work.pop()
        if isinstance(node, Node):
            options += [node] * (node.tag == "option")
            work += reversed(node.children)
    able = [x for x in options if "disabled" not in x.attributes and "hidden" not in x.attributes]
    return {id(next((x for x in reversed(options) if "selected" in x.attributes), able[0] if able else None))}


def _column(columns: list[int], first: int) -> int:
    """The column with text that a cell begins in or before."""
    return columns[min(bisect.bisect_left(columns, first), len(columns) - 1)]


def _offsets(widths: dict[int, int], columns: list[int], most: int | None) -> dict[int, int]:
    out, at = {}, 0
    for c in columns:
        out[c] = at
        at += (widths[c] if most is None else min(widths[c], most)) + 2
    return out


def _span(node: Node, name: str, most: int) -> int:
    value = node.attributes.get(name, "1").strip()
    if not (value.isascii() and value.isdigit()):
        return 1
    n = int(value[:8])
    return min(most, n) if n else most if name == "rowspan" else 1  # a rowspan of 0 runs to the end of its section


def _trimmed(lines: list[str]) -> list[str]:
    first = next((i for i, x in enumerate(lines) if x), len(lines))
    last = next((i for i in range(len(lines) - 1, -1, -1) if lines[i]), -1)
    return lines[first : last + 1]


def _style_sources(root: Node) -> Iterator[str]:
    work = [root]
    while work:
        node = work.pop()
        if node.tag == "style":
            if " ".join(node.attributes.get("media", "").lower().split()) in _SCREENS:
                yield "".join(x for x in node.children if isinstance(x, str))
        else:
            work += [x for x in reversed(node.children) if isinstance(x, Node)]


def render(root: Node) -> str:
    """All visible text of a tree."""
    flows, tables, lists, pre, items = [_Flow()], [], [], 0, 0
    drop_downs: list[set[int] | None] = []
    work: list[tuple[Node, Iterator[Node | str], bool, str]] = []  # and whether text is hidden, and the svg or math around
    sheet = Sheet(_style_sources(root))

    def enter(node: Node, hidden: bool, within: str) -> None:
        nonlocal pre, items
        tag, flow = node.tag, flows[-1]
        if tag in APART_WITHIN.get(within, ()):
            flow.put(" ")
        if tag == "br":
            flow.new_line()
            return
        if tag in BLOCKS and tag not in ("td", "th", "tr"):
            flow.end_line(gap=tag in SPACED and not (tag in ("ul", "ol") and (lists or items)))
        if tag in ("ul", "ol", "menu"):
            start, down = _whole(node.attributes.get("start")), "reversed" in node.attributes and tag == "ol"
            last = sum(isinstance(x, Node) and x.tag == "li" for x in node.children) if down else 1
            lists.append([tag == "ol", last if start is None else start, -1 if down else 1, node.attributes.get("type", "1").strip()])
        elif tag == "li":
            items += 1
            mark = "- "
            if lists and lists[-1][0]:
                own = _whole(node.attributes.get("value"))
                lists[-1][1] = lists[-1][1] if own is None else own
                mark = f"{numeral(lists[-1][1], node.attributes.get('type', lists[-1][3]).strip())}. "
                lists[-1][1] += lists[-1][2]
            flow.indents.append(" " * len(mark))
            flow.marker = " " * len(mark) if hidden else mark
        elif tag in ("dd", "blockquote"):
            flow.indents.append("  ")
        elif tag == "pre":
            pre += 1
        elif tag == "table":
            tables.append(_Table())
        elif tag in ("thead", "tbody", "tfoot") and tables:
            tables[-1].new_section({"thead": 0, "tbody": 1, "tfoot": 2}[tag])
        elif tag == "tr" and tables:
            tables[-1].new_row()
        elif tag in ("td", "th") and tables:
            flows.append(_Flow())
        elif tag == "input" and not hidden and node.attributes.get("type", "text").strip().lower() in SHOWN_INPUTS:
            flow.put(f" {node.attributes.get('value', '')} ")
        elif tag == "select":
            drop_downs.append(_shown_options(node))
        elif tag == "optgroup" and not hidden and drop_downs and drop_downs[-1] is None and node.attributes.get("label", "").strip():
            flow.put(node.attributes["label"])
            flow.end_line()

    def leave(node: Node, within: str) -> None:
        nonlocal pre, items
        tag = node.tag
        if tag in APART_WITHIN.get(within, ()):
            flows[-1].put(" ")
        if tag in ("td", "th") and tables:
            cell = flows.pop()
            cell.end_line()
            tables[-1].add(_trimmed(cell.lines), _span(node, "colspan", _MOST_COLUMNS), _span(node, "rowspan", _MOST_ROWS))
            return
        flow = flows[-1]
        if tag in BLOCKS and tag != "tr":
            flow.end_line()
        if tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag in ("li", "dd", "blockquote"):
            flow.marker = ""
            flow.indents.pop()
            items -= tag == "li"
        elif tag == "pre":
            pre -= 1
        elif tag == "select":
            drop_downs.pop()
        elif tag == "table":
            flow.put_lines(tables.pop().lines())
        if tag in SPACED and not (tag in ("ul", "ol") and (lists or items)):
            flow.gap = True

    work.append((root, iter(root.children), False, ""))
    around, names = [root], Counter({"html": 1})  # the elements of work, and their tags and marks
    while work:
        node, rest, hidden, within = work[-1]
        child = next(rest, None)
        if child is None:
            work.pop()
            names.subtract(_names(around.pop()) if sheet.rules else ())
            if work:
                leave(node, work[-1][3])
        elif isinstance(child, str):
            if hidden or (node.tag == "details" and "open" not in node.attributes):
                continue
            if pre:
                first, *more = child.split("\n")
                flows[-1].words.append(first)
                for line in more:
                    flows[-1].new_line() if flows[-1].words == [""] else flows[-1].end_line()
                    flows[-1].words.append(line)
            else:
                flows[-1].put(child)
        else:
            if child.tag == "option" and drop_downs and drop_downs[-1] is not None and id(child) not in drop_downs[-1]:
                continue
            styles = sheet.styles(child, around, names) if sheet.rules or "style" in child.attributes else {}
            if displayed(child, node, styles, within):
                seen = styles.get("visibility", "inherit")
                unseen = hidden if seen in ("inherit", "unset") else seen in ("hidden", "collapse")
                enter(child, unseen, within)
                if child.tag not in VOID:
                    around.append(child)
                    names.update(_names(child) if sheet.rules else ())
                    work.append((child, iter(child.children), unseen, child.tag if child.tag in UNPAINTED_WITHIN else "" if child.tag == "foreignobject" else within))
                elif child.tag == "hr":
                    leave(child, within)
    flows[0].end_line()
    return "\n".join(_trimmed(flows[0].lines))


def page_text(source: str | None) -> str:
    return render(build(source))


def extract(pages: DataFrame, source: str = "html", name: str = "text") -> DataFrame:
    """pages with a string column at the end, called name or, if pages has that, the like: the visible text."""
    name, at = fresh(pages, name), pages.columns.index(source)
    pages = pages.withColumn(source, F.col(source).cast("string"))
    schema = pages.withColumn(name, F.lit(None).cast("string")).schema
    fields = schema.names

    def extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([page_text(x.as_py()) for x in batch.column(at)], pa.string())], fields)

    return pages.mapInArrow(extracted, schema)
