"""H1's element scanner: the text of a page by its elements, ends that the page leaves out included.

A page is cut into tags and text by one pattern that knows quoted attributes,
comments and raw text (a script goes up to its end tag or the end of the
page). Of the open elements only those that matter to lines are kept on a
stack: an opening tag first ends what it can't stand in (a row ends a row, a
block ends a paragraph), an end tag ends what is still open inside its element.
Every ended line element gives one line break, after its text.

``page_text`` is a plain function over one page; ``scan_markup`` runs it over a
column in Arrow batches, a narrow step. A page costs time in proportion to its
length and its depth, and memory in proportion to its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import decode_entities, normalize_lines

# FIXED VALUES: elements that end a line, and those whose content is no text.
LINE_ELEMENTS = frozenset("p div tr li h1 h2 h3 h4 h5 h6 table".split())
NO_TEXT = ("script", "style", "noscript", "svg")
# FIXED VALUES: the structure of HTML that decides where omitted end tags stand.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH_ENDERS = HEADINGS | frozenset(
    "address article aside blockquote center dd details dir div dl dt fieldset figcaption figure footer form header hr li main menu nav ol p pre section table ul".split())
CELLS, SECTIONS = frozenset(("td", "th", "caption")), frozenset(("thead", "tbody", "tfoot"))
KEPT = LINE_ELEMENTS | CELLS | SECTIONS | frozenset("ul ol dl dt dd blockquote section article form fieldset body".split())
#: An opening tag ends the nearest open element of the first set unless one of the second is nearer.
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "table")) | CELLS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table")) | CELLS),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table")) | CELLS),
    "td": (CELLS, frozenset(("tr", "table"))),
    "th": (CELLS, frozenset(("tr", "table"))),
    "tr": (frozenset(("tr", "caption")), frozenset(("table",))),
    **{s: (frozenset(("tr", "caption")) | SECTIONS, frozenset(("table",))) for s in SECTIONS},
    **{h: (HEADINGS, KEPT - HEADINGS) for h in HEADINGS},
}
_PARAGRAPH = (frozenset(("p",)), frozenset(("table", "caption", "td", "th")))
#: End tags don't reach out of a cell or table, unless they are those of table parts.
_TABLE_PARTS = CELLS | SECTIONS | {"tr", "table"}
_CELL_WALL = CELLS | {"table"}

_QUOTED = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+"""  # nothing is tried twice: a tag without its end costs its length
_TOKEN = re.compile(
    rf"""<!--(?:>|->|.*?(?:-->|--!>|\Z))            # a comment, to the end of the page when it is left open
       | <(?P<raw>{"|".join(NO_TEXT)})(?=[\s/>])(?P<attrs>{_QUOTED})>
       | <(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?:{_QUOTED}>|[^>]*(?:>|\Z))   # a quote left open: up to the next mark
       | <[!?/][^>]*(?:>|\Z)""", re.S | re.I | re.X)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in NO_TEXT}


def page_text(page: str) -> str:
    """Text and line breaks of ``page`` (its character references decoded), joined by spaces."""
    out: list[str] = []
    stack: list[str] = []
    count: Counter = Counter()

    def end_nearest(wanted: frozenset, wall: frozenset) -> None:
        if not any(count[w] for w in wanted):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in wanted:
                for name in reversed(stack[i:]):
                    count[name] -= 1
                    if name in LINE_ELEMENTS:
                        out.append("\n")
                del stack[i:]
                return
            if stack[i] in wall:
                return

    at = 0
    while token := _TOKEN.search(page, at):
        if token.start() > at:
            out.append(page[at:token.start()])
        at = token.end()
        if raw := token["raw"]:
            if not token["attrs"].endswith("/") or raw.lower() != "svg":
                stop = _RAW_END[raw.lower()].search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if not (name := token["name"]):
            continue
        name = name.lower()
        if name == "br":
            out.append("\n")
        elif token["end"]:
            if name in KEPT and count[name]:
                end_nearest(frozenset((name,)), frozenset() if name == "table" else frozenset(("table",)) if name in _TABLE_PARTS else _CELL_WALL)
            elif name == "p":
                out.append("\n")  # an end without a beginning is an empty paragraph
        elif name in KEPT or name in PARAGRAPH_ENDERS:
            if name in ENDS:
                end_nearest(*ENDS[name])
            if name in PARAGRAPH_ENDERS:
                end_nearest(*_PARAGRAPH)
            if name in KEPT:
                stack.append(name)
                count[name] += 1
    out.append(page[at:])
    return " ".join(out) + " \n" * sum(name in LINE_ELEMENTS for name in stack)


def scan_markup(df: DataFrame, texts: str, flags: str | None = None) -> DataFrame:
    """``df`` with ``page_text`` of the column ``texts``, a string or an array of strings.

    ``flags`` (of the same shape) names the texts that are pages; the others stay.
    """
    def one(text, flag):
        return text if text is None or not flag or "<" not in text else page_text(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(texts)
            column, given = b.column(at), b.column(flags).to_pylist() if flags else [True] * b.num_rows
            if pa.types.is_list(column.type):
                new = [None if t is None else [one(x, f) for x, f in zip(t, fs if flags else [True] * len(t))] for t, fs in zip(column.to_pylist(), given)]
            else:
                new = [one(t, f) for t, f in zip(column.to_pylist(), given)]
            yield b.set_column(at, b.schema.field(at), pa.array(new, column.type))

    return df.mapInArrow(run, df.schema)


def pages_to_text(df: DataFrame, column: str) -> DataFrame:
    """H1 + N1-N4 on the pages in ``column``: references decoded and lines tidied by expressions, elements by the scanner."""
    decoded = df.withColumn(column, decode_entities(F.col(column)))
    return scan_markup(decoded, column).withColumn(column, normalize_lines(F.col(column)))
