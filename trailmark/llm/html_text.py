"""Operator 5, HTML extraction, by layout-aware rendering.

A tree builder closes elements whose end tags HTML lets authors leave out, and skips what a reader doesn't see. Each
element is laid out from what stands in it: inline text flows and its white space collapses; blocks start new lines,
paragraphs and headings stand between blank lines, also through blocks around them; list items get a bullet or number and
hang below it; table cells are padded so that columns align; preformatted text keeps its white space.

What is seen: `display: none`, `hidden` and elements like script remove all that stands in them. `visibility` is inherited, and
an element within a hidden one may be seen again. Rules of `style` elements are followed where their selector is an element
name, a class, an id, or a name with one of these, and they set display or visibility; the last that fits wins, a
`style` attribute over all. Buttons and text inputs show their value, and a closed `details` its content, since a
reader can open it.

Pages are independent: one pass without a shuffle, and a hot host or page costs nothing more than its rows. Python gets them
in Arrow batches of at most 64 MB, and a longer page alone. Nesting needs no recursion, and time and output are linear in a
page: text is written straight to the nearest element with a layout of its own (cell, list item, table, pre, quote); within
`DEPTH` of these more are laid out as plain blocks. Cells are padded to `PAD` characters at most and a wider one overflows its
column, and a cell spans `SPAN` columns and rows at most; below a cell that spans rows its columns stay free.

A head ends at its end tag or at the first text or tag that can't stand in one. What stands in a table or row outside
its cells comes before the table.

Nulls: a null page has a null text, an empty one an empty text. Malformed markup never fails: an unknown end tag is
ignored, and what is left open at the end of the page is closed there; a tag without `>` stands as text with all that follows. Repeated rows are rendered each. An empty table gives an
empty result. A column of the input that has the result's name is an error.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("audio canvas datalist head iframe math noembed noframes object script style svg template title video".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup html legend li main menu nav ol optgroup option search section summary ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote table".split())
LISTS = frozenset("ul ol menu dir".split())
TABULAR = frozenset("table thead tbody tfoot tr".split())
#: What may stand in a head; any other start tag, or text, ends one that is open.
METADATA = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Start tag to the open elements that it closes, and the elements beyond which it doesn't look (fixed values).
IMPLIED = {
    **dict.fromkeys((BLOCKS | SPACED | {"hr"}) - {"option", "optgroup", "html", "body", "caption"}, ({"p"}, {"button", "td", "th", "table", "caption"})),
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"})),
    "body": ({"head"}, {"html"}),
}
STYLE = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)", re.I)
BRACE = re.compile(r"[{}]")
SELECTOR = re.compile(r"(\*|[a-z][a-z0-9]*)?(?:([.#])([\w-]+))?", re.I)
# Names, attributes and ends in tags.
NAME = re.compile(r"[^\s/>]+")
BETWEEN = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"(.[^\s/>=]*)(\s*=\s*)?", re.S)
UNQUOTED = re.compile(r"[^\s>]*")
COMMENT_END = re.compile(r"--!?>")
#: Elements whose content is text up to their end tag.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("iframe", "noembed", "noframes", "script", "style", "xmp")}
SHOWN_INPUTS = frozenset(["button", "reset", "submit", "text", "email", "number", "search", "tel", "url"])
BREAK = "\x00"  # a forced line end within inline text; NUL can't be in text
SPACE = re.compile(r"[ \t\n\r\f]+")
EDGE, GAP = (0,), (1,)  # the edge of a block, and that of one between blank lines
DEPTH, PAD, SPAN = 24, 80, 50
#: Elements whose content is laid out on its own; all others write to the nearest of these.
OWN = frozenset("blockquote dd li pre table tbody td textarea tfoot th thead tr".split())
CELLS = ("td", "th")
BARRIERS = ("td", "th", "table")
BEYOND_CELLS = frozenset("body html table tbody tfoot thead tr".split())


class Box:
    """Content that is laid out together: strings (inline), block edges, and lists of lines; rows of a table."""

    __slots__ = ("depth", "down", "number", "parts", "pre", "rows", "span")

    def __init__(self, depth: int = 0, pre: bool = False, span: int = 1, down: int = 1):
        self.depth, self.pre, self.span, self.down = depth, pre, span, down
        self.parts: list = []
        self.rows: list = []
        self.number = 0


def spans(value: str | None) -> int:
    """Columns or rows that a cell spans."""
    return min(SPAN, max(1, int(value))) if value and re.fullmatch(r"[0-9]{1,6}", value) else 1


class Element:
    """An open element; `box` is its own or that of the nearest element around it that has one."""

    __slots__ = ("box", "gone", "name", "number", "own", "unseen")

    def __init__(self, name: str, box: Box, own: bool, gone: bool, unseen: bool):
        self.name, self.box, self.own, self.gone, self.unseen = name, box, own, gone, unseen
        self.number = 0


def lines_of(parts: list, pre: bool = False) -> list[str]:
    """Lines of a box from its parts; a blank line stands at gaps between lines, once. `pre` keeps the white space of inline
    text, but for a line end before a block or at the end."""
    out: list[str] = []
    text: list[str] = []
    gap = False

    def put(lines: list[str]) -> None:
        nonlocal gap
        if lines:
            if out and gap:
                out.append("")
            out.extend(lines)
            gap = False

    def flow() -> None:
        run = "".join(text)
        text.clear()
        if run and pre:
            lines = run.split(BREAK)
            put(lines[: len(lines) - (len(lines) > 1 and not lines[-1])])
        elif run:
            lines = [SPACE.sub(" ", x).strip(" ") for x in run.split(BREAK)]
            last = len(lines)
            while last and not lines[last - 1]:
                last -= 1
            first = 0
            while first < last and not lines[first]:
                first += 1
            put(lines[first:last])

    for part in parts:
        if isinstance(part, str):
            text.append(part)
        elif isinstance(part, list):
            flow()
            put(part)
        else:
            flow()
            gap = gap or part is GAP
    flow()
    return out


def placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, list[str], int]]]:
    """Cells with their first column: rows of (lines, columns, rows that it spans) as rows of (column, lines, columns). A cell
    stands in the first column that no cell of a row above reaches down to."""
    free_from: list[int] = []  # for each column the first row in which it is free
    out = []
    for r, row in enumerate(rows):
        at, found = 0, []
        for lines, span, down in row:
            while at < len(free_from) and free_from[at] > r:
                at += 1
            found.append((at, lines, span))
            free_from += [0] * (at + span - len(free_from))
            free_from[at : at + span] = [r + down] * span
            at += span
        out.append(found)
    return out


def table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (lines of a cell, columns and rows that it spans) as lines with aligned columns, two blanks between columns."""
    table = placed(rows)
    widths: list[int] = []
    for spanning in (False, True):  # a cell over several columns widens the last of them
        for row in table:
            for at, cell, span in row:
                widths += [0] * (at + span - len(widths))
                if (span > 1) == spanning:
                    had = sum(widths[at : at + span]) + 2 * (span - 1)
                    widths[at + span - 1] += max(0, min(PAD, max(map(len, cell), default=0)) - had)
    start = [0]  # where each column starts
    for w in widths:
        start.append(start[-1] + w + 2)
    out = []
    for row in table:
        for k in range(max((len(cell) for _, cell, _ in row), default=0)):
            line, after = [], 0
            for at, cell, span in row:
                text = cell[k] if k < len(cell) else ""
                line.append(" " * (start[at] - start[after]) + text.ljust(start[at + span] - start[at] - 2) + "  ")
                after = at + span
            out.append("".join(line).rstrip())
    return out


def rules_in(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, body) of the innermost braces, in one pass."""
    bare, at = [], 0
    while (start := css.find("/*", at)) >= 0:
        bare.append(css[at:start])
        at = css.find("*/", start + 2) + 2
        if at < 2:  # a comment without an end goes to the end
            at = len(css)
    css = "".join([*bare, css[at:]])
    before, opened = 0, -1
    for m in BRACE.finditer(css):
        if m[0] == "{":
            before, opened = (before if opened < 0 else opened + 1), m.start()
        elif opened >= 0:
            yield css[before:opened], css[opened + 1 : m.start()]
            before, opened = m.end(), -1
        else:
            before = m.end()


def style_rules(css: str) -> list[tuple[str, str, str, dict[str, str]]]:
    """(name, kind, value, settings) of the rules with simple selectors that set display or visibility."""
    found = []
    for selectors, body in rules_in(css):
        settings = {k.lower(): v.lower() for k, v in STYLE.findall(body)}
        if settings:
            for one in selectors.split(","):
                m = SELECTOR.fullmatch(one.strip())
                if m and (m[1] or m[3]):
                    found.append(((m[1] or "*").lower(), m[2] or "", m[3] or "", settings))
    return found


class Scanner:
    """Tags and text of a page, in one pass: every search for an end that fails is the last of its kind, so time is in proportion
    to the page whatever is left open. A tag without an end stands as text, as does all that follows it; a comment without one
    hides the rest; a quote without its pair is a character of the value."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.unpaired: set[str] = set()

    def feed(self, to) -> None:
        page, n = self.page, len(self.page)
        while self.at < n:
            start = page.find("<", self.at)
            if start < 0 or start + 1 == n:
                break
            sign = page[start + 1]
            if not (sign in "!?/" or sign.isascii() and sign.isalpha()):
                self._text(to, start + 1)
                continue
            self._text(to, start)
            if sign.isalpha():
                if not self._start_tag(to, start):
                    break
            elif sign == "/" and page[start + 2 : start + 3].isascii() and page[start + 2 : start + 3].isalpha():
                end = page.find(">", start)
                if end < 0:
                    break
                name = NAME.match(page, start + 2)
                self.at = end + 1
                to.handle_endtag(name[0].lower())
            else:
                self._skip(start)
        self._text(to, n)

    def _text(self, to, end: int) -> None:
        """Text from where the scan stands to `end`."""
        if self.at < end:
            to.handle_data(unescape(self.page[self.at : end]))
            self.at = end

    def _skip(self, start: int) -> None:
        """Comments, declarations and the like."""
        page = self.page
        if page.startswith("<!--", start):
            end = COMMENT_END.search(page, start + 2 if page.startswith(("<!-->", "<!--->"), start) else start + 4)
            self.at = end.end() if end else len(page)
        elif page.startswith("<![CDATA[", start) and (end := page.find("]]>", start)) >= 0:
            self.at = end + 3
        else:
            end = page.find(">", start)
            self.at = end + 1 if end >= 0 else len(page)

    def _start_tag(self, to, start: int) -> bool:
        """Reads the tag at `start`; false if it has no end."""
        page, n = self.page, len(self.page)
        m = NAME.match(page, start + 1)
        name, at, attrs = m[0].lower(), m.end(), []
        if page.find(">", at) < 0:
            return False
        while True:
            at = BETWEEN.match(page, at).end()
            if at >= n:
                return False
            if page[at] == ">":
                break
            m = ATTRIBUTE.match(page, at)
            key, at, value = m[1].lower(), m.end(), None
            if m[2]:
                quote = page[at : at + 1]
                end = page.find(quote, at + 1) if quote in ("'", '"') and quote not in self.unpaired else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    if quote in ("'", '"'):
                        self.unpaired.add(quote)
                    m = UNQUOTED.match(page, at)
                    value, at = m[0], m.end()
            attrs.append((key, None if value is None else unescape(value)))
        self.at = at + 1
        to.handle_starttag(name, attrs)
        if name in RAW:
            end = RAW[name].search(page, self.at)
            self._raw(to, end.start() if end else n)
        return True

    def _raw(self, to, end: int) -> None:
        if self.at < end:
            to.handle_data(self.page[self.at : end])
            self.at = end


class Renderer:
    """The tree of a page: its open elements, told by a `Scanner`."""

    def __init__(self):
        self.open = [Element("", Box(), True, False, False)]
        self.at: dict[str, list[int]] = defaultdict(list)  # places of the open elements of each name
        self.rules: dict[tuple[str, str, str], dict[str, tuple[int, str]]] = defaultdict(dict)  # by kind, value, name of selector
        self.n_rules = 0

    def last(self, names) -> int:
        return max((self.at[n][-1] for n in names if self.at[n]), default=0)

    # --- what is seen -----------------------------------------------------------------------------------------------

    def settings(self, tag: str, had: dict) -> dict[str, str]:
        found: dict[str, tuple[int, str]] = {}
        if self.n_rules:
            keys = [("", "", tag), ("", "", "*")]
            for kind, value in (("#", had.get("id") or ""), *((".", c) for c in (had.get("class") or "").split())):
                keys += [(kind, value, tag), (kind, value, "*")]
            for key in keys:
                for prop, setting in self.rules.get(key, {}).items():
                    found[prop] = max(setting, found.get(prop, setting))
        return {prop: value for prop, (_, value) in found.items()} | {k.lower(): v.lower() for k, v in STYLE.findall(had.get("style") or "")}

    def learn(self, css: str) -> None:
        """Of rules with one selector, each property's last setting is all that counts."""
        for name, kind, value, settings in style_rules(css):
            for prop, setting in settings.items():
                self.rules[kind, value, name][prop] = (self.n_rules, setting)
            self.n_rules += 1

    # --- tags -------------------------------------------------------------------------------------------------------

    def end_head(self) -> None:
        """Closes an open head whose end tag was left out; what stands in its other elements, as a template, stays there."""
        if not self.at["head"]:
            return
        i = len(self.open) - 1
        while self.open[i].name == "noscript":
            i -= 1
        if self.open[i].name == "head":
            self.close_down_to(i)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in METADATA:
            self.end_head()
        closes, limits = IMPLIED.get(tag, ((), ()))
        if closes:
            limit = self.last(limits)
            lowest = min((self.at[n][k] for n in closes if (k := bisect_right(self.at[n], limit)) < len(self.at[n])), default=0)
            if lowest:
                self.close_down_to(lowest)
        above, had = self.open[-1], dict(attrs)
        box = above.box
        if tag == "br":
            box.parts.append(BREAK)
        elif tag == "hr":
            box.parts.append(GAP)
        elif tag in ("img", "input") and not above.gone and not above.unseen and "hidden" not in had and self.settings(tag, had).get("display") != "none":
            if tag == "img":
                box.parts.append(had.get("alt") or "")
            elif (had.get("type") or "text").lower() in SHOWN_INPUTS:
                box.parts.append(had.get("value") or "")
        if tag in VOID:
            return
        settings = self.settings(tag, had)
        gone = above.gone or tag in UNSEEN or "hidden" in had or settings.get("display") == "none"
        unseen = settings["visibility"] in ("hidden", "collapse") if settings.get("visibility", "inherit") != "inherit" else above.unseen
        own = tag in OWN and not gone and box.depth < DEPTH
        if not gone and not own and (tag in BLOCKS or tag in SPACED or tag in OWN):
            box.parts.append(GAP if tag in SPACED else EDGE)
        if own:
            box = Box(box.depth + (tag not in TABULAR or tag == "table"), box.pre or tag in ("pre", "textarea"), spans(had.get("colspan")), spans(had.get("rowspan")))
        element = Element(tag, box, own, gone, unseen)
        if tag == "ol" and re.fullmatch(r"-?\d{1,9}", had.get("start") or ""):
            element.number = int(had["start"]) - 1
        self.at[tag].append(len(self.open))
        self.open.append(element)
        if tag == "li" and not own and not gone:
            box.parts.append(self.mark())

    def handle_endtag(self, tag: str) -> None:
        places = self.at[tag]
        if places and (tag in BEYOND_CELLS or places[-1] >= self.last(BARRIERS)):  # an end tag in a cell closes nothing outside it
            self.close_down_to(places[-1])

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if top.name == "style":
            self.learn(data)
        if top.gone and self.at["head"] and data.strip():
            self.end_head()
            top = self.open[-1]
        if top.gone or top.unseen or (top.box.pre and top.name in TABULAR and not data.strip()):
            return
        data = data.replace(BREAK, "�")
        top.box.parts.append(data.replace("\n", BREAK) if top.box.pre else data)

    # --- layout -----------------------------------------------------------------------------------------------------

    def mark(self) -> str:
        """The bullet or number of the next item of the innermost open list."""
        holder = self.open[self.last(LISTS)]
        holder.number += 1
        return f"{holder.number}. " if holder.name == "ol" else "- "

    def close_down_to(self, i: int) -> None:
        while len(self.open) > i:
            self.close_last()

    def close_last(self) -> None:
        e = self.open.pop()
        self.at[e.name].pop()
        if e.gone:
            return
        out = self.open[-1].box
        if not e.own:
            if e.name in BLOCKS or e.name in SPACED or e.name in OWN:
                out.parts.append(GAP if e.name in SPACED else EDGE)
            return
        box = e.box
        if e.name in CELLS:
            out.rows.append((lines_of(box.parts, box.pre), box.span, box.down))
        elif e.name == "tr":
            out.rows.append(box.rows)
            out.parts.extend(box.parts)
        elif e.name in ("thead", "tbody", "tfoot"):
            out.rows.extend(box.rows)
            out.parts.extend(box.parts)
        else:
            if e.name == "pre":
                self.drop_first_line_end(box.parts)
            lines = lines_of(box.parts, box.pre) + self.table(box)
            if e.name == "li":
                mark = self.mark()
                lines = [(" " * len(mark) if k else mark) + x if x or not k else "" for k, x in enumerate(lines or [""])]
            elif e.name in ("dd", "blockquote"):
                lines = ["    " + x if x else "" for x in lines]
            edge = GAP if e.name in SPACED else EDGE
            out.parts += [edge, lines, edge]

    @staticmethod
    def drop_first_line_end(parts: list) -> None:
        """The line end that may follow the start tag of a pre isn't part of it."""
        k = next((k for k, p in enumerate(parts) if p != ""), None)
        if k is not None and isinstance(parts[k], str) and parts[k].startswith(BREAK):
            parts[k] = parts[k][1:]

    @staticmethod
    def table(box: Box) -> list[str]:
        """Lines of the rows in a box; cells without a row are a row each."""
        return table_lines([r if isinstance(r, list) else [r] for r in box.rows if r])

    def text(self) -> str:
        self.close_down_to(1)
        top = self.open[0].box
        return "\n".join(lines_of(top.parts) + self.table(top))


def render(html: str | None) -> str | None:
    """The visible text of a page, laid out in lines."""
    if html is None:
        return None
    renderer = Renderer()
    Scanner(html).feed(renderer)
    return renderer.text()


@F.pandas_udf(T.StringType())
def rendered(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield pd.Series([render(x) for x in batch], dtype="object")


def visible_text(pages: DataFrame, html: str = "html", name: str = "visible_text") -> DataFrame:
    """`pages` with column `name`, the rendered text of `html`; the name must be new."""
    if name in pages.columns:
        raise ValueError(f"the input has a column {name}; name another one for the text")
    return pages.withColumn(name, rendered(F.col(f"`{html}`")))
