"""Operator 2: layout-aware text of HTML pages.

A tree builder closes elements that HTML leaves open by implication; a renderer walks the tree without recursion, skips
what is not visible, and lays the rest out: blank lines between blocks, list markers with indents, table cells of one or more
lines padded to columns, preformatted text as it stands. Visible is what a browser with scripts and media shows at first: rules
by tag, class and id in the page's style elements count, closed details show their summary, <noscript> and the fallback
content of media do not show. Work is per row: no shuffle.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pieces, table

#: Facts of HTML (fixed values): elements without content, never shown, laid out as blocks, with a blank line around.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title meta link object iframe audio video canvas datalist".split())
#: Start tags that leave <head> open; parts of a drawing that are not drawn where they stand.
METADATA = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
UNDRAWN = frozenset("defs symbol desc metadata clippath mask marker pattern".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul caption tr thead tbody tfoot".split())
SPACED = frozenset("article blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 main menu nav ol p pre section table ul".split())
#: A start tag closes these open elements, up to the nearest of the elements behind the bar.
CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "thead": ("tr td th tbody tfoot", "table"), "tbody": ("tr td th thead tfoot", "table"),
    "tfoot": ("tr td th tbody thead", "table"), "option": ("option", "select"), "optgroup": ("option optgroup", "select"), "body": ("head", "html"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
SCOPE = frozenset("td th table caption html body".split())
#: Kinds of input whose value is not seen as text (fixed values).
NO_VALUE = frozenset("hidden password checkbox radio file range color image".split())
#: Columns of a table are padded up to this width: a wider cell stands as it is.
WIDEST = 1000
_SIMPLE = re.compile(r"^([a-z][a-z0-9]*|\*)?((?:[.#][-_a-z0-9\u0080-\uffff]+)*)$", re.I)
_VALUE = re.compile(r"[a-z-]+")
_HEADING = re.compile(r"h[0-9]+")


def _declared(style: str) -> dict[str, tuple[bool, str]]:
    """display and visibility in a list of declarations: (important, value), the last important one first."""
    out: dict[str, tuple[bool, str]] = {}
    for said in style.split(";"):
        name, _, value = said.partition(":")
        name = name.strip().lower()
        if name in ("display", "visibility"):
            value, marked, word = value.lower().partition("!")
            value, important = value.strip(), word.strip() == "important"
            if _VALUE.fullmatch(value) and important == bool(marked) and (important or not out.get(name, (False,))[0]):
                out[name] = important, value
    return out


def _without_comments(css: str) -> str:
    out, at = [], 0
    while (a := css.find("/*", at)) >= 0:
        out.append(css[at:a])
        at = css.find("*/", a + 2)
        if at < 0:
            return " ".join(out)
        at += 2
    return " ".join([*out, css[at:]])


def _rules(css: str):
    """Selectors and declarations of each rule that stands by itself, in one pass; at-rules and rules that hold others are left out."""
    css = _without_comments(css)
    start = body = deep = 0
    nested = False
    for m in re.finditer("[{};]", css):
        sign, at = m[0], m.start()
        if sign == "{":
            deep += 1
            nested = deep > 1 or nested
            body = at if deep == 1 else body
        elif sign == "}":
            deep = max(0, deep - 1)
            if not deep:
                selectors = css[start:body]
                if not nested and not selectors.lstrip().startswith("@"):
                    yield selectors, css[body + 1 : at]
                start, body, nested = at + 1, at + 1, False
        elif not deep and css[start:at].lstrip().startswith("@"):
            start = body = at + 1


class Sheet:
    """The rules of style elements that show or hide elements by tag, class or id; rules within at-rules, and selectors with
    combinators, attributes or states, are left aside. Rules are kept by an id, class or tag that they ask for."""

    def __init__(self):
        self.rules: dict[tuple[str, str], list[tuple[tuple, str, frozenset, frozenset, dict]]] = {}
        self.count = 0

    def add(self, css: str) -> None:
        for selectors, body in _rules(css):
            if said := _declared(body):
                for one in selectors.split(","):
                    if (m := _SIMPLE.match(one.strip())) and one.strip():
                        names = re.findall(r"([.#])([^.#]+)", m[2])
                        ids, classes = (frozenset(n for k, n in names if k == x) for x in "#.")
                        tag = (m[1] or "*").lower()
                        key = ("#", min(ids)) if ids else (".", min(classes)) if classes else ("", tag)
                        self.rules.setdefault(key, []).append(((len(ids), len(classes), tag != "*", self.count), tag, ids, classes, said))
                        self.count += 1

    def style(self, node: Node) -> dict[str, str]:
        """display and visibility said of a node by rules and its own style."""
        found: dict[str, tuple] = {}
        a = node.attrs
        if self.rules:
            own_id, own = a.get("id"), frozenset((a.get("class") or "").split())
            for key in (("#", own_id), *((".", c) for c in own), ("", node.tag), ("", "*")):
                for rank, tag, ids, classes, said in self.rules.get(key, ()):
                    if tag in ("*", node.tag) and classes <= own and ids <= {own_id}:
                        for k, (important, v) in said.items():
                            found[k] = max(found.get(k, ((),)), ((important, False, *rank), v))
        if a.get("style"):
            for k, (important, v) in _declared(a["style"]).items():
                found[k] = max(found.get(k, ((),)), ((important, True), v))
        return {k: v[1] for k, v in found.items()}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.sheet = Sheet()
        self.open = [self.root]
        self.count: dict[str, int] = {}  # open elements by tag: most searches of a deep stack end here
        self.tail = 0  # characters from the last end of a comment on: a comment that begins among them has none

    def parse_html_declaration(self, i):
        if self.rawdata.startswith("<![", i):  # of any kind: a comment up to the next >
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def parse_comment(self, i, report=1):
        return -1 if len(self.rawdata) - i - 4 < self.tail else super().parse_comment(i, report)

    def whole(self, html: str) -> None:
        """Reads a page. After its last > no tag can end, so what follows is text."""
        end = html.rfind(">") + 1
        self.tail = end - max(0, html.rfind("-->", 0, end))
        self.feed(html[:end])
        self.close()
        if html[end:]:
            self.handle_data(html[end:] if self.cdata_elem else unescape(html[end:]))

    def _cut(self, i: int) -> None:
        """Closes the open elements from place i on."""
        for node in self.open[i:]:
            self.count[node.tag] -= 1
        del self.open[i:]

    def _close(self, tags: frozenset, stop: frozenset) -> None:
        """Closes the nearest open element of tags inside the nearest of stop, and those of tags right around it."""
        if not any(self.count.get(t) for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in stop:
                return
            if tag in tags:
                while i > 1 and self.open[i - 1].tag in tags and self.open[i - 1].tag not in stop:
                    i -= 1
                self._cut(i)
                return

    def _leave_head(self) -> None:
        while self.open[-1].tag == "head":
            self._cut(len(self.open) - 1)

    def handle_starttag(self, tag, attrs):
        if tag not in METADATA:
            self._leave_head()
        if tag in BLOCK and tag not in ("html", "body"):
            self._close(frozenset({"p"}), SCOPE)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if _HEADING.fullmatch(tag) and _HEADING.fullmatch(self.open[-1].tag):
            self._cut(len(self.open) - 1)
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (tag in ("path", "use") or self.count.get("svg")):
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        fence = frozenset() if tag in SCOPE or tag in ("tr", "tbody", "thead", "tfoot") else SCOPE - {"html", "body"}
        for i in range(len(self.open) - 1 if self.count.get(tag) else 0, 0, -1):
            if self.open[i].tag == tag:
                self._cut(i)
                return
            if self.open[i].tag in fence:
                break
        if tag == "p":  # stands for an empty paragraph
            self.open[-1].children.append(Node("p", {}))

    def handle_data(self, data):
        if self.open[-1].tag == "style":
            self.sheet.add(data)
        if data.strip():
            self._leave_head()
        self.open[-1].children.append(data)


class Writer:
    """Text with pending white space and line breaks."""

    def __init__(self):
        self.out, self.breaks, self.gap, self.indent, self.marker, self.column = [], 0, False, "", "", 0

    def line(self, n: int) -> None:
        self.breaks, self.gap = max(self.breaks, n), False

    def _begin(self) -> None:
        if self.breaks or not self.out:
            if self.out:
                self.out.append("\n" * self.breaks)
            self.out.append(self.indent[: len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent)
            self.marker, self.breaks, self.gap = "", 0, False

    def text(self, data: str) -> None:
        words = data.split()
        if not words:
            self.gap = self.gap or bool(data)
            return
        fresh = bool(self.breaks) or not self.out
        self._begin()
        if not fresh and (self.gap or data[0].isspace()):
            self.out.append(" ")
        self.out.append(" ".join(words))
        self.gap = data[-1].isspace()

    def plain(self, data: str) -> None:
        for i, part in enumerate(data.split("\n")):
            if i:
                self.breaks += 1
            if part:
                self._begin()
                self.out.append(part)

    def done(self) -> str:
        return "".join(self.out).rstrip()


def _seen(node: Node, sheet: Sheet, visible: bool) -> tuple[bool, bool]:
    """Whether a node is laid out at all, and whether its own text is visible. Visibility is inherited, and a child may take
    it back; what is not laid out takes its children with it."""
    a = node.attrs
    said = sheet.style(node) if sheet.rules or a.get("style") else {}
    gone = "hidden" in a and "display" not in said or node.tag == "dialog" and "open" not in a
    if node.tag in UNSEEN or gone or said.get("display") == "none":
        return False, False
    if "visibility" in said and said["visibility"] != "inherit":
        visible = said["visibility"] not in ("hidden", "collapse")
    return True, visible


def _drawn(svg: Node, sheet: Sheet) -> list:
    """The texts of a drawing, each apart."""
    out, todo = [], list(reversed(svg.children))
    while todo:
        node = todo.pop()
        if isinstance(node, str) or node.tag in UNDRAWN or not _seen(node, sheet, True)[0]:
            continue
        if node.tag in ("text", "foreignobject"):
            out += [" ", node, " "]
        else:
            todo += reversed(node.children)
    return out


def _laid_out(rows: list[list[str]]) -> list[str]:
    """Lines of a table: columns as wide as their widest line, rows as high as their highest cell."""
    rows = [[c.split("\n") for c in r] for r in rows if any(r)]
    widths = [0] * max(map(len, rows), default=0)
    for r in rows:
        for i, cell in enumerate(r):
            widths[i] = max(widths[i], min(WIDEST, max(map(len, cell))))
    out = []
    for r in rows:
        for k in range(max(map(len, r))):
            line = [(c[k] if k < len(c) else "").ljust(w) for c, w in zip(r, widths, strict=False)]
            out.append(" | ".join(line).rstrip())
    return out


def render(html: str | None) -> str:
    """The visible text of a page."""
    if not html:
        return ""
    builder = Builder()
    builder.whole(html)
    sheet = builder.sheet
    writers, tables, lists = [Writer()], [], []
    # what is left to do: node, whether it is being left, inside preformatted text, visible
    todo: list[tuple[object, bool, bool, bool]] = [(c, False, False, True) for c in reversed(builder.root.children)]
    while todo:
        node, leaving, pre, seen = todo.pop()
        w = writers[-1]
        if isinstance(node, str):
            if seen:
                (w.plain if pre else w.text)(node)
            continue
        tag = node.tag
        if not leaving:
            there, seen = _seen(node, sheet, seen)
            if not there:
                continue
            if not seen and tag in ("hr", "img", "input", "svg", "select", "textarea"):
                continue
            if tag == "br":
                w.breaks = w.breaks + 1 if w.out else 0
                w.gap = False
                continue
            if tag == "hr":
                w.line(1)
                w.text("---")
                w.line(1)
                continue
            if tag == "img":
                if node.attrs.get("alt"):
                    w.text(f" {node.attrs['alt']} ")
                continue
            if tag == "input":
                kind = (node.attrs.get("type") or "text").lower()
                shown = node.attrs.get("alt") if kind == "image" else None if kind in NO_VALUE else node.attrs.get("value") or node.attrs.get("placeholder")
                if shown:
                    w.text(f" {shown} ")
                continue
            if tag == "svg":
                todo += [(c, False, False, seen) for c in reversed(_drawn(node, sheet))]
                continue
            if tag in ("select", "optgroup", "option"):
                label = node.attrs.get("label") if tag != "select" else None
                w.text(f" {label or ''} ")
                if tag != "option" or not label:
                    todo += [(c, False, False, seen) for c in reversed([*node.children, " "])]
                continue
            if tag == "textarea":
                w.line(1)
                w.plain("".join(c for c in node.children if isinstance(c, str)).strip("\r\n"))
                w.line(1)
                continue
            if tag == "table":
                w.line(2)
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                writers.append(Writer())
            elif tag in BLOCK:
                w.line(2 if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else 1)
            if tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start") or ""
                lists.append(int(start) if tag == "ol" and start.isascii() and start.isdecimal() and len(start) < 10 else 1 if tag == "ol" else 0)
            elif tag == "li":
                mark = "- "
                if lists and lists[-1]:
                    mark = f"{lists[-1]}. "
                    lists[-1] += 1
                w.indent += " " * len(mark)
                w.marker = mark
                node.attrs["#"] = len(mark)
            elif tag in ("blockquote", "dd"):
                w.indent += "  "
            todo.append((node, True, pre, seen))
            pre = pre or tag in ("pre", "listing")
            shown = node.children
            if tag == "details" and "open" not in node.attrs:  # closed: its first summary alone is seen
                shown = [c for c in shown if not isinstance(c, str) and c.tag == "summary"][:1]
            todo += [(c, False, pre, seen) for c in reversed(shown)]
            continue
        if tag in ("ul", "ol", "menu") and lists:
            lists.pop()
        elif tag == "li":
            w.indent, w.marker = w.indent[: len(w.indent) - node.attrs["#"]], ""
        elif tag in ("blockquote", "dd"):
            w.indent = w.indent[:-2]
        if tag in ("td", "th") and tables:
            cell = writers.pop().done()
            if not tables[-1]:
                tables[-1].append([])
            span = node.attrs.get("colspan") or "1"
            tables[-1][-1] += [cell] + [""] * (min(int(span), 100) - 1 if span.isascii() and span.isdecimal() and len(span) < 5 else 0)
        elif tag == "table" and tables:
            for row in _laid_out(tables.pop()):
                w.line(1)
                w.plain(row)
            w.line(2)
        elif tag in BLOCK and not (tag in ("tr", "thead", "tbody", "tfoot") and tables):
            w.line(2 if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else 1)
    return writers[0].done()


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_words per row of pages (page_id, url, html); other columns are ignored.

    text: all visible text, laid out; empty for null, empty and wholly hidden pages. Unclosed and stray tags are repaired as
    far as implied tags go, and text is kept wherever it stands. Repeated rows come back as often as they came, null
    ids and addresses stay. An empty table gives an empty result. A page is parsed whole in one task, at some 200 bytes of memory
    for each of its elements and 10 for each of its bytes.
    """
    bounded_batches(pages.sparkSession)

    def run(batches):
        for rb in pieces(batches, "html"):
            yield table(page_id=rb.column("page_id"), url=rb.column("url"), text=pa.array([render(x) for x in rb.column("html").to_pylist()], pa.string()))

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = rows.mapInArrow(run, "page_id long, url string, text string")
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), words.cast("long").alias("n_words"))
