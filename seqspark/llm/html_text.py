"""Layout-aware extraction of all visible text from HTML.

A tokenizer feeds a tree builder with implied end tags; rules decide what is visible; boxes are laid out
bottom-up without recursion, so nesting may be of any depth.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from seqspark.llm import common

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER_SHOWN = frozenset("head script style template title iframe noembed noframes noscript object video audio canvas datalist svg math meta link base".split())
MARGIN = {t: 1 for t in "p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset".split()}
BLOCK = frozenset(MARGIN) | frozenset("html body div section article aside nav header footer main address form li dt dd tr td th thead tbody tfoot caption hr details summary legend figcaption center dialog menu option optgroup select search hgroup".split())
#: An opening tag ends the open elements named here, looked for up to one of the stop tags.
P_ENDERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section search summary table ul li dt dd tr td th thead tbody tfoot caption".split())
CLOSES: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select", "optgroup", "datalist"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"td", "th", "tr", "caption"}), frozenset({"table", "thead", "tbody", "tfoot"})),
    "thead": (frozenset({"td", "th", "tr", "caption", "thead", "tbody", "tfoot"}), frozenset({"table"})),
    "body": (frozenset({"head"}), frozenset()),
}
CLOSES["tbody"] = CLOSES["tfoot"] = CLOSES["thead"]
#: End tags do not look beyond these.
WALLS = frozenset("td th table caption html".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|(?<==)\s*+\"[^\"]*+\"|(?<==)\s*+'[^']*+'|[\"'])*+)>|</[^a-zA-Z][^>]*>|</\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
BLANKS = re.compile(r"[ \t\n\r\f]+")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
BRACE = re.compile(r"[{}]")
#: Blocks of rules that hold on a screen; others are skipped.
HOLDS = re.compile(r"@layer\b.*|@media\s+(?:only\s+)?(?:screen|all)", re.I | re.S)
#: Values that a declaration needs to count; others make it void, as unknown ones do in browsers.
VALUES = {"display": re.compile(r"[a-z]+(?:-[a-z]+)*(?: [a-z-]+)*"), "visibility": re.compile("hidden|collapse|visible|inherit|initial|unset|revert")}
#: A selector of tags, classes and ids, and of these below each other; what says more is left out.
COMPOUND = r"(?:[a-zA-Z][\w-]*|\*)?(?:[.#][\w-]+)*"
SELECTOR = re.compile(rf"{COMPOUND}(?:\s*>\s*{COMPOUND}|\s+{COMPOUND})*")
#: Characters up to which a cell widens its column.
MOST_WIDTH = 200
BR = "\0br\0"
PARTS = frozenset("thead tbody tfoot".split())


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), html.unescape(value))
    return out


def rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, body) of the rules of a style sheet, those in @-blocks if the block holds."""
    css, at = COMMENT.sub(" ", css), 0
    open_: list[tuple[str, bool, list[str]]] = []  # (what leads the block, whether its rules hold, its own text)
    for m in BRACE.finditer(css):
        holds = not open_ or open_[-1][1]
        if m[0] == "{":
            before, _, lead = css[at : m.start()].rpartition(";")
            if open_:
                open_[-1][2].append(before)
            lead = lead.strip()
            open_.append((lead, holds and HOLDS.fullmatch(lead) is not None, []))
        elif open_:
            lead, _, own = open_.pop()
            if not lead.startswith("@") and (not open_ or open_[-1][1]):
                yield lead, ";".join([*own, css[at : m.start()]])
        at = m.end()


def declared(body: str) -> dict[str, tuple[bool, str]]:
    """What a block of declarations says of display and visibility: (whether it is important, value). Later ones win, important ones first."""
    out: dict[str, tuple[bool, str]] = {}
    for part in body.split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), BLANKS.sub(" ", value.strip().lower())
        important = value.endswith("!important") or value.endswith("! important")
        value = value.rpartition("!")[0].strip() if important else value
        if name in VALUES and VALUES[name].fullmatch(value) and (important or not out.get(name, (False,))[0]):
            out[name] = important, value
    return out


class Styles:
    """What style sheets say of display and visibility: selectors by a class, id or tag that their last part asks for."""

    def __init__(self) -> None:
        self.by_key: dict[str, list[tuple]] = {}
        self.order = 0

    def add(self, selectors: str, body: str) -> None:
        said = declared(body)
        self.order += 1
        for text in selectors.split(",") if said else ():
            text = text.strip()
            if text and SELECTOR.fullmatch(text):
                # chains of parents, the element's own first; in a chain the lowest part first
                chains: list[list[list[str]]] = [[]]
                for combinator, x in reversed(re.findall(r"\s*(>|\s)?\s*([^\s>]+)", text)):
                    chains[-1].append([y if y[0] == "#" else y.lower() for y in re.findall(r"[.#]?[\w-]+", x)])
                    if combinator != ">":
                        chains.append([])
                chains = [c for c in chains if c]
                every = [x for c in chains for part in c for x in part]
                weight = (sum(x[0] == "#" for x in every), sum(x[0] == "." for x in every), sum(x[0] not in ".#" for x in every), self.order)
                self.by_key.setdefault(max(chains[0][0], default="*", key=lambda x: x[0] in ".#"), []).append((chains, weight, said))

    def of(self, node: Node, above: tuple) -> dict[str, str]:
        """Values that hold for a node, by importance, inline style, specificity and order; above: its parent and what is above that."""
        best: dict[str, tuple] = {}

        def offer(said: dict[str, tuple[bool, str]], inline: bool, weight: tuple) -> None:
            for name, (important, value) in said.items():
                best[name] = max(best.get(name, ((), "")), ((important, inline, weight), value))

        if self.by_key:
            keys = ["*", node.tag, *(f".{c.lower()}" for c in node.attrs.get("class", "").split()), f"#{node.attrs.get('id', '')}"]
            for k in dict.fromkeys(keys):
                for chains, weight, said in self.by_key.get(k, ()):
                    if self.fits(chains, node, above):
                        offer(said, False, weight)
        if node.attrs.get("style"):
            offer(declared(COMMENT.sub(" ", node.attrs["style"])), True, ())
        return {name: value for name, (_, value) in best.items()}

    @staticmethod
    def fits(chains: list[list[list[str]]], node: Node, above: tuple) -> bool:
        def one(simple: list[str], n: Node) -> bool:
            classes = n.attrs.get("class", "").lower().split()
            return all(x[1:] in classes if x[0] == "." else x[1:] == n.attrs.get("id", "") if x[0] == "#" else x == n.tag for x in simple)

        def along(chain: list[list[str]], n: Node, up: tuple) -> tuple | None:
            """What is above the chain if it stands at n and its parents."""
            for k, simple in enumerate(chain):
                if k:
                    if not up:
                        return None
                    n, up = up
                if not one(simple, n):
                    return None
            return (up,)

        found = along(chains[0], node, above)
        for chain in chains[1:]:
            # the nearest place where the whole chain stands leaves the most above it
            up = found[0] if found else ()
            found = None
            while up and not found:
                found = along(chain, *up)
                up = up[1]
        return found is not None


def parse(source: str) -> tuple[Node, Styles]:
    """The tree of a page, and what its style sheets hide."""
    root = Node("html", {})
    stack, at, hidden = [root], 0, Styles()
    where: dict[str, list[int]] = {"html": [0]}  # places on the stack of each open tag, so that none is looked for
    end_of_tags = source.rfind(">") + 1

    def nearest(tags) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=-1)

    def cut(k: int) -> None:
        while len(stack) > k:
            where[stack.pop().tag].pop()

    def add_text(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            if stack[-1].tag == "head" and text.strip():
                cut(len(stack) - 1)
            stack[-1].children.append(text.replace("\0", ""))

    while True:
        m = TOKEN.search(source, at, end_of_tags) if at < end_of_tags else None
        add_text(source[at : m.start() if m else len(source)])
        if not m:
            return root, hidden
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add_text(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if m[1]:
            k = nearest([tag])
            beyond = tag in ("table", "tr", "tbody", "thead", "tfoot", "body", "html")
            if k > 0 and (beyond or k >= nearest(WALLS)):
                cut(k)
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            continue
        attrs = attributes(m[3]) if m[3] else {}
        if tag in ("html", "body") and where.get(tag):
            stack[0].attrs |= attrs if tag == "html" else {}
            continue
        if tag in P_ENDERS and (k := nearest(["p"])) > nearest((*WALLS, "button")):
            cut(k)
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            while (k := nearest(ends)) > max(0, nearest(stops - ends)):
                cut(k)
                if tag not in ("tr", "thead", "tbody", "tfoot", "optgroup"):
                    break
        if stack[-1].tag == "head" and tag not in NEVER_SHOWN and tag != "noscript":
            cut(len(stack) - 1)
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            inner = source[at : end.start() if end else len(source)]
            at = source.find(">", end.end()) + 1 or len(source) if end else len(source)
            if tag == "textarea":
                node.children.append(html.unescape(inner))
            elif tag == "style":
                for selectors, body in rules(inner):
                    hidden.add(selectors, body)
        elif tag == "form" and stack[-1].tag in ("table", "tr", *PARTS):
            pass  # as in browsers: empty, what follows belongs to the table
        elif tag not in VOID and not (m[3].endswith("/") and tag in ("svg", "math")):
            where.setdefault(tag, []).append(len(stack))
            stack.append(node)


def shown(node: Node, style: dict[str, str]) -> bool:
    """Whether an element is rendered: by its tag, by a style that holds for it, or else by its attributes."""
    tag, attrs = node.tag, node.attrs
    if tag in NEVER_SHOWN or (tag == "input" and attrs.get("type", "").lower() == "hidden"):
        return False
    if style.get("display") not in (None, "revert"):
        return style["display"] != "none"
    return "hidden" not in attrs and (tag != "dialog" or "open" in attrs)


def visible(style: dict[str, str], before: bool) -> bool:
    """Whether the text of an element is visible, which it takes from its parent unless a style says otherwise."""
    told = style.get("visibility", "inherit")
    return told in ("visible", "initial") or told in ("inherit", "unset", "revert") and before


# Boxes: a str is inline text (BR breaks the line); (lines, margin) is a block.


def lines_of(text: str) -> list[str]:
    return [BLANKS.sub(" ", x).strip(" ") for x in text.split(BR)]


def flow(items: list) -> list[str]:
    """Lay out inline text and blocks below each other; the larger of two margins separates blocks."""
    out: list[str] = []
    inline: list[str] = []
    owed = 0

    def put(lines: list[str], margin: int) -> None:
        nonlocal owed
        if out and max(owed, margin):
            out.append("")
        out.extend(lines)
        owed = margin

    for item in [*items, None]:
        if isinstance(item, str):
            inline.append(item)
            continue
        if inline:
            lines = lines_of("".join(inline))
            inline = []
            while lines and not lines[-1]:
                lines.pop()
            if any(lines):
                put(lines, 0)
        if item is not None and item[0]:
            put(*item)
    return out


def table_lines(node: Node, done: dict[int, list]) -> list[str]:
    """Rows of cells aligned in columns; a spanning cell takes its columns' widths.

    Cells of more than MOST_WIDTH characters reach out of their column, so padding stays in proportion to the page.
    """
    rows, captions, queue = [], [], list(reversed(node.children))
    held: list[tuple[int, int, int]] = []  # columns from, to, that cells of rows above hold for so many rows more

    def number(text: str, most: int) -> int:
        return min(int(text), most) if text.isdecimal() and int(text) else 1

    while queue:
        x = queue.pop()
        if not isinstance(x, Node) or id(x) not in done:
            if isinstance(x, str) and x.strip():
                captions += [BLANKS.sub(" ", x).strip()]
        elif x.tag in PARTS:
            queue += reversed(x.children)
        elif x.tag == "tr":
            cells, k, at, new = [], 0, 0, []
            for c in x.children:
                if isinstance(c, Node) and id(c) in done:
                    text = flow(done[id(c)])
                    if not text and c.tag not in ("td", "th"):
                        continue
                    span, down = number(c.attrs.get("colspan", "1"), 1000), number(c.attrs.get("rowspan", "1"), 65534)
                elif isinstance(c, str) and c.strip():
                    text, span, down = [BLANKS.sub(" ", c).strip()], 1, 1
                else:
                    continue
                while at < len(held) and held[at][0] <= k:
                    k, at = max(k, held[at][1]), at + 1
                cells.append((k, text, span))
                if down > 1:
                    new.append((k, k + span, down - 1))
                k += span
            held = sorted([*((a, b, n - 1) for a, b, n in held if n > 1), *new])
            if cells:
                rows.append(cells)
        else:
            captions += flow(done[id(x)])
    widths: dict[int, int] = {}
    for cells in rows:
        for k, text, span in cells:
            if span == 1:
                widths[k] = max([widths.get(k, 0), *(len(t) for t in text if len(t) <= MOST_WIDTH)])

    def wide(a: int, b: int) -> int:
        own = [widths[j] + 2 for j in range(a, b) if j in widths]
        return sum(own) - 2 if own else 0

    out = list(captions)
    for cells in rows:
        for n in range(max([1, *(len(t) for _, t, _ in cells)])):
            upto, parts = 0, []
            for k, text, span in cells:
                if any(j in widths for j in range(upto, k)):  # held by a cell above
                    parts.append(" " * wide(upto, k))
                parts.append((text[n] if n < len(text) else "").ljust(wide(k, k + span)))
                upto = k + span
            out.append("  ".join(parts).rstrip())
    return out


def render(source: str) -> str:
    """All visible text of a page."""
    root, hidden = parse(source)
    done: dict[int, list] = {}
    # (node, whether it is a table's child or in a part of one, whether blanks are kept, whether its text is visible,
    # its parent and those above, whether its children are done)
    stack: list[tuple[Node, bool, bool, bool, tuple, bool]] = [(root, False, False, True, (), False)]
    while stack:
        node, inside, keeps, seen, above, ready = stack.pop()
        if not ready:
            style = hidden.of(node, above)
            if not shown(node, style):
                continue
            seen = visible(style, seen)
            keeps = keeps or node.tag in ("pre", "textarea", "listing")
            stack.append((node, inside, keeps, seen, above, True))
            closed = node.tag == "details" and "open" not in node.attrs
            for c in node.children:
                if isinstance(c, Node) and (not closed or c.tag == "summary"):
                    stack.append((c, node.tag == "table" or (inside and node.tag in PARTS), keeps, seen, (node, above), False))
            if not seen:
                node.children = [c for c in node.children if isinstance(c, Node)]
            continue
        tag = node.tag
        closed = tag == "details" and "open" not in node.attrs
        if tag == "table":
            done[id(node)] = [(table_lines(node, done), 1)]
        elif tag == "br":
            done[id(node)] = [BR]
        elif inside and (tag == "tr" or tag in PARTS):
            done[id(node)] = []  # the table lays out the children
        else:
            items: list = []
            count = 0
            if tag == "ol":
                first = node.attrs.get("start", "1")
                count = int(first) - 1 if re.fullmatch(r"-?\d{1,9}", first) else 0
            for c in node.children:
                if isinstance(c, str):
                    if not closed:
                        items.append(c.replace("\n", BR).replace(" ", "\xa0").replace("\t", "\xa0" * 4) if keeps else c)
                elif id(c) in done:
                    own = done.pop(id(c))
                    if c.tag == "li" and tag in ("ul", "ol", "menu"):
                        count += 1
                        mark = f"{count}. " if tag == "ol" else "- "
                        lines = flow(own)
                        items.append(([mark + lines[0], *(" " * len(mark) + x if x else "" for x in lines[1:])] if lines else [], 0))
                    elif c.tag in ("td", "th", "tr", *PARTS):
                        items.append((flow(own), 0))
                    elif c.tag in BLOCK:
                        margin = MARGIN.get(c.tag, 0)
                        if c.tag in ("ul", "ol", "menu") and tag == "li":
                            margin = 0
                        if len(own) == 1 and isinstance(own[0], tuple) and not margin:
                            items.append(own[0])
                        else:
                            lines = flow(own)
                            if c.tag == "blockquote" or c.tag == "dd":
                                lines = ["  " + x if x else "" for x in lines]
                            items.append((lines, margin))
                    else:
                        items += own
            done[id(node)] = items
    return "\n".join(flow(done.get(id(root), []))).replace("\xa0", " ").strip("\n")


def extract(pages: DataFrame, *, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """Visible text of each whole page: id_column, text.

    Blocks are separated by line breaks or blank lines, lists carry marks, table cells are aligned. A null
    or empty page has the text "". A null id stays null, repeated rows each give a row, an empty table an
    empty one; other columns are ignored.
    """
    common.small_batches(pages.sparkSession)
    kind = pages.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "t"):
                text = [render(x) if x else "" for x in batch.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(text, pa.string())], [id_column, "text"])

    return pages.select(pages[id_column].alias("i"), pages[html_column].alias("t")).mapInArrow(common.tidy(run), f"`{id_column}` {kind}, text string")
