"""HTML extraction as a renderer: a tree with implied tags, visibility rules, and text in its layout."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.text import bounded_batches

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks with a blank line around them, and blocks that only start a line of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
BLOCK = SPACED | frozenset("html body address article aside caption center dd details dialog dir div dt fieldset figcaption footer form header hgroup legend li main menu nav optgroup option search section summary tr".split())
CLOSES_P = BLOCK - frozenset("html body caption dd dt legend li optgroup option summary tr".split()) | frozenset(["dd", "dt", "li", "summary"])
UNSEEN = frozenset("head script style template noscript title meta link base datalist object iframe audio video canvas svg math".split())
#: An opening tag ends these open elements, unless one of the third set lies between.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "thead": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
}
#: End tags look no further out than these.
SCOPE = frozenset(["table", "td", "th", "caption", "body", "html"])
#: Lists, quotes and tables nested deeper than this add no further indentation or columns; their text stays.
INDENTS = 24
#: Width in pixels of the screen that media queries are asked about.
SCREEN = 1280


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent


class TreeBuilder(HTMLParser):
    """Builds the element tree: implied end tags, implied rows, void elements, scoped end tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.held: Counter[str] = Counter()  # open elements by tag
        self.styles: list[str] = []

    def _cut(self, at: int) -> None:
        self.held.subtract(n.tag for n in self.open[at:])
        del self.open[at:]

    def _end(self, tags: frozenset, limits: frozenset) -> None:
        """Close out to the outermost open element among ``tags`` this side of ``limits``."""
        left = sum(self.held[t] for t in tags)
        cut = None
        for i in range(len(self.open) - 1, 0, -1):
            if not left or self.open[i].tag in limits:
                break
            if self.open[i].tag in tags:
                cut, left = i, left - 1
        if cut:
            self._cut(cut)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            for k, v in attrs:
                self.root.attrs.setdefault(k, v)
            self._end(frozenset(["head"]), frozenset())
            return
        if tag in CLOSES_P:
            self._end(frozenset(["p"]), SCOPE)
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push(Node("tr", {}))
        node = Node(tag, dict(reversed(attrs)))  # of a repeated attribute the first counts
        if tag in VOID:
            node.parent = self.open[-1]
            self.open[-1].children.append(node)
        else:
            self._push(node)

    def _push(self, node: Node) -> None:
        node.parent = self.open[-1]
        self.open[-1].children.append(node)
        self.open.append(node)
        self.held[node.tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
        elif self.held[tag]:
            limits = frozenset(["table"]) if tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else SCOPE - {tag}
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == tag:
                    self._cut(i)
                    break
                if self.open[i].tag in limits:
                    break

    def handle_data(self, data):
        if self.open[-1].tag == "style":
            self.styles.append(data)
        self.open[-1].children.append(data)


def declarations(body: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of the display and visibility declarations of a rule or style attribute."""
    found = re.findall(r"(?:^|;)\s*(display|visibility)\s*:\s*([\w-]+)[^;!]*(!\s*important)?", body, re.I)
    return [(name.lower(), value.lower(), bool(bang)) for name, value, bang in found]


def on_screen(query: str) -> bool:
    """Whether a media query list holds for a screen of the assumed width; features other than widths don't."""
    for one in query.lower().split(","):
        words = one.strip()
        negated = words.startswith("not ")
        words = re.sub(r"^(not|only)\s+", "", words)
        features = re.findall(r"\(([^)]*)\)", words)
        kind = re.sub(r"\([^)]*\)|\band\b", " ", words).strip()
        holds = kind in ("", "all", "screen")
        for feature in features:
            wide = re.fullmatch(r"\s*(min|max)-width\s*:\s*(\d+(?:\.\d+)?)(px|em|rem)\s*", feature)
            width = wide and float(wide.group(2)) * (1 if wide.group(3) == "px" else 16)
            holds = holds and bool(wide) and (width <= SCREEN if wide.group(1) == "min" else width >= SCREEN)
        if holds != negated:
            return True
    return False


_SIMPLE = re.compile(r"([.#]?)([\w-]+)|\*|\[\s*([\w-]+)\s*(?:=\s*[\"']?([^\]\"']*)[\"']?\s*)?\]")


def selector_of(text: str) -> list[tuple[str, list[tuple[str, str, str | None]]]] | None:
    """[(combinator before it, simple selectors)], or None for selectors that say more than tags, classes, ids and attributes."""
    out, combinator = [], ""
    for part in re.sub(r"\s*>\s*", " > ", text.strip()).split():
        if part == ">":
            combinator = ">"
            continue
        at, simple = 0, []
        while at < len(part):
            m = _SIMPLE.match(part, at)
            if not m:
                return None
            at = m.end()
            if m.group(2):
                simple.append((m.group(1) or "tag", m.group(2) if m.group(1) else m.group(2).lower(), None))
            elif m.group(3):
                simple.append(("[", m.group(3).lower(), m.group(4)))
        out.append((combinator or " ", simple))
        combinator = ""
    return out if out and not combinator else None


def _is(node: Node, simple: list[tuple[str, str, str | None]]) -> bool:
    a = node.attrs
    for kind, name, value in simple:
        if kind == "tag":
            good = node.tag == name
        elif kind == "#":
            good = a.get("id") == name
        elif kind == ".":
            good = name in (a.get("class") or "").split()
        else:
            good = name in a and (value is None or (a[name] or "") == value)
        if not good:
            return False
    return True


def _fits(node: Node, selector: list) -> bool:
    """Whether a node is what the whole selector says, its ancestors included."""
    if not _is(node, selector[-1][1]):
        return False
    at = {node.parent} if node.parent else set()
    for i in range(len(selector) - 2, -1, -1):
        near, simple = selector[i + 1][0] == ">", selector[i][1]
        found: set[Node] = set()
        for n in at:
            while n is not None and n not in found:
                if _is(n, simple):
                    found.add(n)
                if near:
                    break
                n = n.parent
        at = found if i == 0 else {n.parent for n in found if n.parent}
        if not at:
            return False
    return True


class Styles:
    """The display and visibility rules of a page's style sheets."""

    def __init__(self, css: str):
        self.rules: dict[tuple[str, str], list[tuple]] = {}  # by a tag, class or id of the last part
        self.count = 0
        self._read(re.sub(r"/\*.*?\*/|<!--|-->", "", css, flags=re.S))

    def _read(self, css: str) -> None:
        at = 0
        while True:
            open_ = css.find("{", at)
            if open_ < 0:
                return
            depth, end = 1, open_ + 1
            while end < len(css) and depth:
                mark = re.compile("[{}]").search(css, end)
                if not mark:
                    end = len(css)
                    break
                depth += 1 if mark.group() == "{" else -1
                end = mark.end()
            head = css[at:open_].rpartition(";")[2].strip()
            body = css[open_ + 1 : end - 1 if depth == 0 else end]
            at = end
            if head.startswith("@"):
                name, _, query = head.partition(" ")
                if (name.lower() == "@media" and on_screen(query)) or name.lower() in ("@supports", "@layer"):
                    self._read(body)
                continue
            said = declarations(body)
            for text in head.split(",") if said else ():
                selector = selector_of(text)
                if selector:
                    last = selector[-1][1]
                    key = next(((k, n) for k, n, _ in last if k in ("#", ".", "tag")), ("*", ""))
                    weight = tuple(sum(k in kinds for _, simple in selector for k, _, _ in simple) for kinds in ("#", ".[", ("tag",)))
                    self.rules.setdefault(key, []).append((weight, self.count, selector, said))
                    self.count += 1

    def of(self, node: Node) -> dict[str, str]:
        """The display and visibility that rules and the style attribute give a node."""
        won: dict[str, tuple] = {}

        def claim(said, rank):
            for name, value, important in said:
                if (important, *rank) >= won.get(name, ((False, -1),))[0]:
                    won[name] = ((important, *rank), value)

        if self.rules:
            keys = [("tag", node.tag), ("#", node.attrs.get("id") or ""), ("*", ""), *((".", c) for c in (node.attrs.get("class") or "").split())]
            for key in keys:
                for weight, order, selector, said in self.rules.get(key, ()):
                    if _fits(node, selector):
                        claim(said, (0, weight, order))
        style = node.attrs.get("style")
        if style:
            claim(declarations(style), (1, (0, 0, 0), 0))
        return {name: value for name, (_, value) in won.items()}


class Page:
    """Lines of text with pending spaces and blank lines; what nested blocks are rendered into."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.gap = False

    def text(self, data: str) -> None:
        words = data.split()
        if not words:
            self.space |= bool(data) and bool(self.now)
            return
        if self.now and (self.space or data[0].isspace()):
            self.now.append(" ")
        self.now.append(" ".join(words))
        self.space = data[-1].isspace()

    def verbatim(self, data: str) -> None:
        first, *rest = data.expandtabs().split("\n")
        self.now.append(first)
        for line in rest:
            self.line(keep=True)
            self.now.append(line)

    def line(self, keep: bool = False) -> None:
        """End the current line, if it has text or must stay."""
        if self.now or keep:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append("".join(self.now).rstrip())
        self.now, self.space = [], False

    def blank(self) -> None:
        self.line()
        self.gap = True

    def block(self, lines: list[str]) -> None:
        self.line()
        if lines:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines += lines

    def done(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        while self.lines and not self.lines[0]:
            self.lines.pop(0)
        return self.lines


def run_steps(step):
    """Run a generator whose yields are further generators, each answered with its result: recursion without Python's stack."""
    stack, answer = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(answer))
            answer = None
        except StopIteration as done:
            stack.pop()
            answer = done.value
    return answer


class Renderer:
    """Renders a tree with its stylesheets' rules. Methods that yield are steps for ``run_steps``."""

    def __init__(self, styles: Styles):
        self.styles = styles

    def seen(self, node: Node, shown: bool) -> bool | None:
        """None where a node is not displayed at all; else whether its own text is visible."""
        a = node.attrs
        if node.tag in UNSEEN or (node.tag == "dialog" and "open" not in a) or (node.tag == "input" and (a.get("type") or "").lower() == "hidden"):
            return None
        style = self.styles.of(node) if a or self.styles.rules else {}
        if style.get("display", "none" if "hidden" in a else "") == "none":
            return None
        visibility = style.get("visibility")
        return shown if visibility in (None, "inherit") else visibility in ("visible", "initial", "unset")

    def lines(self, node: Node, shown: bool, pre: bool, level: int):
        page = Page()
        yield self.walk(node, page, shown, pre, level)
        return page.done()

    def walk(self, node: Node, page: Page, shown: bool, pre: bool, level: int):
        item = self._first(node)
        closed = node.tag == "details" and "open" not in node.attrs
        for child in node.children:
            if isinstance(child, str):
                if shown and not closed:
                    page.verbatim(child) if pre else page.text(child)
                continue
            tag = child.tag
            seen = None if closed and tag != "summary" else self.seen(child, shown)
            if seen is None:
                continue
            if tag == "br":
                page.line(keep=bool(page.lines or page.now))
                continue
            if tag in SPACED:
                page.blank() if not (tag in ("ul", "ol") and node.tag == "li") else page.line()
            elif tag in BLOCK:
                page.line()
            if tag == "pre" and child.children and isinstance(child.children[0], str):
                child.children[0] = re.sub(r"^\r?\n", "", child.children[0])
            if tag == "table" and level < INDENTS:
                page.block((yield self.table(child, seen, level + 1)))
            elif tag == "li":
                mark = "- "
                if node.tag == "ol":
                    item = self._number(child.attrs.get("value"), item)
                    mark, item = f"{item}. ", item + 1
                if level < INDENTS:
                    own = yield self.lines(child, seen, pre, level + 1)
                    page.block([mark + own[0], *(" " * len(mark) + x if x else "" for x in own[1:])] if own else [])
                else:
                    if seen and any(isinstance(c, str) and c.strip() for c in child.children):
                        page.text(mark)
                    yield self.walk(child, page, seen, pre, level)
            elif tag in ("dd", "blockquote") and level < INDENTS:
                own = yield self.lines(child, seen, pre, level + 1)
                page.block(["  " + x if x else "" for x in own])
            elif tag == "input":
                if seen and (child.attrs.get("type") or "").lower() in ("submit", "button", "reset"):
                    page.text(f" {child.attrs.get('value') or ''} ")
            else:
                yield self.walk(child, page, seen, pre or tag in ("pre", "textarea", "listing"), level)
                if tag in ("td", "th"):
                    page.space |= bool(page.now)
            if tag in SPACED:
                page.blank() if not (tag in ("ul", "ol") and node.tag == "li") else page.line()
            elif tag in BLOCK:
                page.line()

    def _number(self, value: str | None, otherwise: int) -> int:
        return int(value) if value and re.fullmatch(r"-?\d{1,9}", value.strip()) else otherwise

    def _first(self, node: Node) -> int:
        return self._number(node.attrs.get("start"), 1)

    def table(self, node: Node, shown: bool, level: int):
        """Caption, then rows whose cells start at the same column of text."""
        head, rows = [], []
        yield self._rows(node, shown, level, head, rows)
        grid: list[dict[int, tuple[list[str], int]]] = []
        below: dict[int, int] = {}  # column -> rows that a cell above still spans
        for row in rows:
            cells, at = {}, 0
            for cell, seen in row:
                while below.get(at, 0):
                    at += 1
                wide = min(1000, max(1, self._number(cell.attrs.get("colspan"), 1)))
                deep = min(65534, max(1, self._number(cell.attrs.get("rowspan"), 1)))
                cells[at] = ((yield self.lines(cell, seen, False, level)), wide)
                for c in range(at, at + wide):
                    below[c] = max(below.get(c, 0), deep)
                at += wide
            below = {c: n - 1 for c, n in below.items() if n > 1}
            grid.append(cells)
        width: dict[int, int] = {}
        for cells in grid:
            for at, (text, wide) in cells.items():
                if wide == 1:
                    width[at] = max(width.get(at, 0), max(map(len, text), default=0))
        starts = [0]
        for c in range(max((at for cells in grid for at in cells), default=0)):
            starts.append(starts[-1] + width.get(c, 0) + 2)
        out = list(head)
        for cells in grid:
            for i in range(max((len(t) for t, _ in cells.values()), default=0)):
                line = ""
                for at in sorted(cells):
                    text = cells[at][0][i] if i < len(cells[at][0]) else ""
                    if text:
                        line = line.ljust(starts[at]) if len(line) <= starts[at] else line + "  "
                        line += text
                out.append(line.rstrip())
        return out

    def _rows(self, node: Node, shown: bool, level: int, head: list[str], rows: list):
        for child in node.children:
            if isinstance(child, str):
                if shown and child.strip():
                    head.append(" ".join(child.split()))  # text outside cells stands before the table
                continue
            seen = self.seen(child, shown)
            if seen is None:
                continue
            if child.tag == "tr":
                cells = [(c, see) for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and (see := self.seen(c, seen)) is not None]
                stray = Node("div", {}, child)
                stray.children = [c for c in child.children if isinstance(c, str) or c.tag not in ("td", "th")]
                head += yield self.lines(stray, seen, False, level)
                if cells:
                    rows.append(cells)
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield self._rows(child, seen, level, head, rows)
            else:
                head += yield self.lines(child, seen, False, level)


def render(html: str | None) -> str:
    """The visible text of a page in its layout; empty for null and for pages without visible text."""
    if not html:
        return ""
    tree = TreeBuilder()
    tree.feed(html)
    tree.close()
    renderer = Renderer(Styles("\n".join(tree.styles)))
    seen = renderer.seen(tree.root, True)
    return "" if seen is None else "\n".join(run_steps(renderer.lines(tree.root, seen, False, 0)))


def render_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of every row of ``pages``: all visible text of the whole page.

    Blocks are kept apart, list items marked and indented, table cells aligned.
    Elements may nest to any depth; beyond INDENTS nested lists, quotes or
    tables the text stands without further indentation. Style sheets count as
    far as they set display and visibility by tags, classes, ids, attributes
    and ancestors, for a screen. A null or empty page gives an empty text; very
    long pages are read whole; repeated rows stay and get equal texts; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(x.as_py()) for x in batch.column(1)], pa.string())], ["page_id", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return bounded_batches(pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))).mapInArrow(run, f"page_id {kind}, text string")
