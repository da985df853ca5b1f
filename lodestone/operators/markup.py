"""Markdown and HTML as tables of elements, made in Arrow batches without a shuffle.

Markdown is read line by line by an automaton over its block structure: quotes and list items hold
blocks, a fence hides what looks like a heading, an underline turns the paragraph above into one.
HTML is read tag by tag: block tags part texts, and the cells of a table get their row and column on a
grid in which spans take their room.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The markers of Markdown's blocks and the tags that open its HTML blocks.
_ATX = re.compile(r"(#{1,6})(?:[ \t]+(.*?))?[ \t]*$", re.S)
_CLOSER = re.compile(r"(?:^|[ \t]+)#+[ \t]*$")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_RULE = re.compile(r"([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_FENCE = re.compile(r"(`{3,}(?=[^`]*$)|~{3,})")
_ITEM = re.compile(r"([-+*]|(\d{1,9})[.)])(?=[ \t]|$)")
_DEFINITION = re.compile(r"[ ]{0,3}\[(?:[^\[\]\\]|\\.)+\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)(?:[ \t]*\n?[ \t]+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)")
_HTML_BLOCKS = "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
_ATTRIBUTE = r"\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?"
#: (opening, end, whether it may end a paragraph); an end of None is a blank line.
_HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?=\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I), True),
    (re.compile(r"<!--"), re.compile(r"-->"), True),
    (re.compile(r"<\?"), re.compile(r"\?>"), True),
    (re.compile(r"<![A-Za-z]"), re.compile(r">"), True),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>"), True),
    (re.compile(rf"</?(?:{_HTML_BLOCKS.replace(' ', '|')})(?=\s|/?>|$)", re.I), None, True),
    (re.compile(rf"(?:<[A-Za-z][A-Za-z0-9-]*(?:{_ATTRIBUTE})*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"), None, False),
]


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


class _Markdown:
    """The automaton: containers that are open (0 for a quote, else the indent of a list item's text), and the block in the innermost one."""

    def __init__(self):
        self.open: list[int] = []
        self.kind, self.lines, self.end = "", [], None
        self.out: list[tuple[int, str]] = []

    def close(self) -> None:
        """Ends the open block; a paragraph gives its text without link definitions."""
        if self.kind == "text":
            text = "\n".join(self.lines)
            while m := _DEFINITION.match(text):
                text = text[m.end() :]
            if text.strip():
                self.out.append((0, text.strip()))
        self.kind, self.lines = "", []

    def leave(self, depth: int) -> None:
        """Ends the containers below this depth."""
        if len(self.open) > depth:
            self.close()
            del self.open[depth:]

    def containers(self, line: str) -> tuple[int, str]:
        """How many open containers go on in a line, and the rest of it."""
        for depth, width in enumerate(self.open):
            n = _indent(line)
            if width == 0:
                if n > 3 or line[n : n + 1] != ">":
                    return depth, line
                line = line[n + 1 :]
                line = line[1:] if line[:1] == " " else line
            elif n >= width:
                line = line[width:]
            elif line.strip():
                return depth, line
        return len(self.open), line

    def hidden(self, line: str) -> None:
        """A line of code or HTML."""
        if self.kind == "fence":
            n, mark = _indent(line), line.strip(" \t")
            if n <= 3 and len(mark) >= len(self.end) and not mark.strip(self.end[0]):
                self.close()
        elif self.end.search(line) if self.end else not line.strip():
            self.close()

    def feed(self, line: str) -> None:
        lead = len(line) - len(line.lstrip(" \t"))
        line = line[:lead].expandtabs(4) + line[lead:]
        depth, line = self.containers(line)
        whole = depth == len(self.open)
        if self.kind in ("fence", "html"):
            if whole:
                return self.hidden(line)
            self.leave(depth)
            whole = True
        fresh = False
        while True:
            n, rest = _indent(line), line.lstrip(" ")
            text = self.kind == "text" and not fresh
            if not rest.strip() or (n > 3 and (text or self.kind == "code")):
                break
            if n > 3:
                self.leave(depth)
                self.close()
                self.kind = "code"
                return
            if rest[0] == ">":
                self.leave(depth)
                self.close()
                self.open.append(0)
                line = rest[1:].expandtabs(4)
                line = line[1:] if line[:1] == " " else line
            elif m := _ATX.match(rest):
                self.leave(depth)
                self.close()
                self.out.append((len(m[1]), _CLOSER.sub("", m[2] or "").strip()))
                return
            elif m := _FENCE.match(rest):
                self.leave(depth)
                self.close()
                self.kind, self.end = "fence", m[1]
                return
            elif html := next((x for x in _HTML if x[0].match(rest) and (x[2] or not text)), None):
                self.leave(depth)
                self.close()
                self.kind, self.end = "html", html[1]
                return self.hidden(rest)
            elif text and whole and (m := _SETEXT.match(rest)) and self.lines:
                before = len(self.out)
                self.close()
                if len(self.out) > before:
                    self.out[-1] = (1 if m[1][0] == "=" else 2, self.out[-1][1])
                    return
            elif _RULE.match(rest):
                self.leave(depth)
                self.close()
                return
            elif (m := _ITEM.match(rest)) and not (text and whole and (not rest[m.end() :].strip() or m[2] not in (None, "1"))):
                self.leave(depth)
                self.close()
                after = rest[m.end() :].expandtabs(4)
                blanks = _indent(after)
                blanks = 1 if blanks > 4 or not after.strip() else blanks
                self.open.append(n + m.end() + blanks)
                line = after[blanks:] if after.strip() else ""
            else:
                break
            depth, whole, fresh = len(self.open), True, True
        if not line.strip():
            self.leave(depth if any(w == 0 for w in self.open[depth:]) else len(self.open))
            if self.kind != "code":
                self.close()
        elif self.kind == "text" and not fresh:
            # A paragraph goes on, with or without the marks of its containers.
            self.lines.append(line)
        elif self.kind == "code" and _indent(line) > 3 and whole:
            return
        else:
            self.leave(depth)
            self.close()
            self.kind, self.lines = "text", [line.lstrip(" ")]


def markdown_blocks(text: str) -> list[tuple[int, str]]:
    """(level, text) of headings (1 to 6) and of paragraphs (0), in order; code, HTML blocks and link definitions are left out."""
    automaton = _Markdown()
    for line in re.split(r"\r\n|\n|\r", text):
        automaton.feed(line)
    automaton.leave(0)
    automaton.close()
    return automaton.out


# Tags that part texts, and those whose text isn't shown.
_PARTING = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_UNSEEN = frozenset("head noscript script style template title".split())
_HEADINGS = {f"h{i}": i for i in range(1, 7)}
#: Spans beyond these are read as these.
_MOST_COLUMNS, _MOST_ROWS = 1000, 65_534


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.text: list[str] = []
        self.level, self.unseen, self.tables, self.stack = 0, 0, 0, []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        table = self.stack[-1] if self.stack else None
        if table is not None and table["cell"] is not None:
            if text:
                table["cell"].append(text)
        elif text:
            self.rows.append(("heading" if self.level else "text", self.level, None, None, None, text))

    def end_cell(self) -> None:
        table = self.stack[-1]
        if table["cell"] is None:
            return
        words, (wide, high) = table["cell"], table["span"]
        table["cell"] = None
        row, column = table["row"], table["column"]
        while table["taken"].get(column, 0) > row:
            column += 1
        self.rows.append(("cell", 0, table["number"], row, column, " ".join(words)))
        for c in range(column, column + wide):
            if high > 1:
                table["taken"][c] = row + high
            if c > column:
                self.rows.append(("span", 0, table["number"], row, c, " ".join(words)))
        if high > 1:
            table["below"] += [(c, row + high, " ".join(words)) for c in range(column, column + wide)]
        table["column"] = column + wide

    def begin_row(self) -> None:
        table = self.stack[-1]
        table["row"] += 1
        table["column"] = 0
        table["below"] = [x for x in table["below"] if x[1] > table["row"]]
        self.rows += [("span", 0, table["number"], table["row"], c, text) for c, _, text in table["below"]]

    def handle_starttag(self, tag: str, attributes: list) -> None:
        if tag in _UNSEEN:
            self.unseen += 1
        if tag == "body":
            self.unseen = 0
        if tag in _PARTING:
            self.flush()
            if tag != "br":
                self.level = _HEADINGS.get(tag, 0)
        if tag == "table":
            self.stack.append({"number": self.tables, "row": -1, "column": 0, "cell": None, "span": (1, 1), "taken": {}, "below": []})
            self.tables += 1
        elif self.stack and tag in ("tr", "td", "th"):
            self.end_cell()
            if tag == "tr" or self.stack[-1]["row"] < 0:
                self.begin_row()
            if tag != "tr":
                given = dict(attributes)
                span = [int(v) if (v := given.get(k) or "").isdecimal() and v.isascii() and int(v) > 0 else 1 for k in ("colspan", "rowspan")]
                self.stack[-1]["cell"], self.stack[-1]["span"] = [], (min(span[0], _MOST_COLUMNS), min(span[1], _MOST_ROWS))

    def handle_endtag(self, tag: str) -> None:
        if tag in _UNSEEN:
            self.unseen = max(0, self.unseen - 1)
        if tag in _PARTING:
            self.flush()
            self.level = 0
        if self.stack and tag in ("td", "th", "tr", "table"):
            self.end_cell()
            if tag == "table":
                self.stack.pop()

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.text.append(data)

    def done(self) -> list[tuple]:
        self.close()
        self.flush()
        while self.stack:
            self.end_cell()
            self.stack.pop()
        return self.rows


#: An ampersand, and the reference that it begins if a semicolon ends one.
_AMPERSAND = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


def html_rows(html: str, ended: bool = False) -> list[tuple]:
    """(element, level, table_no, row_no, column_no, text) of a page in order; element is heading, text, cell, or span for the further places of a cell.

    HTML also reads some references that no semicolon ends; with ended these stay text, as where a text was escaped and then cut.
    """
    if ended:
        html = _AMPERSAND.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[1] or ''}", html)
    parser = _Html()
    parser.feed(html)
    return parser.done()


def _exploded(docs: DataFrame, key: str, column: str, read: Callable[[str], list[tuple]], fields: str) -> DataFrame:
    """key, seq and fields of the rows that read makes of each text; a null text has none."""
    names = [f.split(":")[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[] if t is None else [dict(zip(names, r)) for r in read(t)] for t in batch.column(1).to_pylist()]
            kinds = [pa.field(n, pa.string() if f.endswith("string") else pa.int32()) for n, f in zip(names, fields.split(", "))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.struct(kinds)))], [key, "rows"])

    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(key, column).mapInArrow(run, f"{key} {kind}, rows array<struct<{fields}>>")
    return made.select(key, F.posexplode("rows").alias("seq", "r")).select(key, "seq", "r.*")


def markdown_elements(docs: DataFrame) -> DataFrame:
    """doc_id, seq, level, text of the headings and paragraphs of Markdown texts (see markdown_blocks)."""
    return _exploded(docs, "doc_id", "text", markdown_blocks, "level:int, text:string")


def html_elements(pages: DataFrame, ended: bool = False) -> DataFrame:
    """page_id, seq, element, level, table_no, row_no, column_no, text of the headings, texts and cells of pages (see html_rows)."""
    return _exploded(pages, "page_id", "html", partial(html_rows, ended=ended), "element:string, level:int, table_no:int, row_no:int, column_no:int, text:string")


def element_sections(elements: DataFrame, key: str = "page_id") -> DataFrame:
    """key, section_no, title, content of the texts between headings of levels 1 and 2; deeper headings are text, a span's text counts once.

    section_no counts the headings so far, sections without text are left out, text before the first heading has a
    null title, as has a section whose heading is empty. Elements are shuffled by key.
    """
    heads = F.col("level").between(1, 2)
    own = elements.where("element <> 'span'") if "element" in elements.columns else elements
    s = own.select(key, "seq", "text", heads.alias("heads"), F.sum(heads.cast("int")).over(Window.partitionBy(key).orderBy("seq")).alias("section_no"))
    lines = F.array_sort(F.collect_list(F.when(~F.col("heads"), F.struct("seq", "text"))))
    return s.groupBy(key, "section_no").agg(F.nullif(F.max(F.when(F.col("heads"), F.col("text"))), F.lit("")).alias("title"), F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("content"))


def html_tables(elements: DataFrame) -> DataFrame:
    """page_id, table_no, row_no, cells of the rows of tables, each cell in all places that it spans; places without a cell are empty. See cleaning.table_rows_markdown."""
    places = elements.where("table_no is not null").groupBy("page_id", "table_no", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("column_no", "text"))).alias("m"))
    last = F.array_max(F.map_keys("m"))
    return places.select("page_id", "table_no", "row_no", F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))).alias("cells"))
