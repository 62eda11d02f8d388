"""Documents to sections to overlapping chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import collapse, short_id

MAX_CHARS, OVERLAP = 1600, 200
INTRO = "(intro)"


def windows(text: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Windows of ``max_chars`` every ``max_chars - overlap`` characters; a text that fits is one."""
    step = max_chars - overlap
    cut = F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(max_chars)))
    return F.when(F.length(text) > max_chars, cut).when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def markdown_sections(text: str) -> list[tuple[str, str]]:
    """(section, body) of a Markdown text; the section is the stack of headings above the body.

    A heading of level n keeps the first n - 1 headings of the stack as they are, whatever their
    levels were; lines of fenced code that look like headings count as such.
    """
    stack: list[str] = []
    found: list[tuple[str, list[str]]] = [(INTRO, [])]
    for line in text.splitlines():
        m = re.match(r"(#{1,6})\s+(.*\S)", line)
        if m:
            del stack[len(m[1]) - 1 :]
            stack.append(m[2].strip())
            found.append((" > ".join(stack), []))
        else:
            found[-1][1].append(line)
    return [(name, body) for name, lines in found if (body := "\n".join(lines).strip())]


HEADINGS = ("h1", "h2", "h3", "h4")
BODY = ("p", "li", "pre", "code", "td")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OPAQUE = frozenset(("script", "style"))
_TEMPLATE = "text/x-handlebars-template"
#: Elements that a new element ends when they are open, and where the search for them stops.
_BLOCKS = "address article aside blockquote center dd dir div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split()
_ENDS = {name: ("p",) for name in _BLOCKS} | {
    "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tr": ("p", "td", "th", "tr"), "tbody": ("p", "td", "th", "tr", "thead", "tbody"),
}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "p": ("table", "td", "th", "button", "object"), "td": ("table",), "th": ("table",), "tr": ("table",), "tbody": ("table",), "thead": ("table",)}


class _Page(HTMLParser):
    """The headings and text elements of a page in the order they open, each with the stripped pieces of its text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str] | None]] = []
        self.elements: list[tuple[str, list[str]]] = []
        self.template: str | None = None
        self.taken = False
        self.waiting: list[str] = []

    def _settle(self) -> None:
        """End a run of text."""
        raw = "".join(self.waiting)
        self.waiting.clear()
        if self.open and self.open[-1][0] in _OPAQUE:
            if self.open[-1] == ("script", None) and self.taken and self.template is None and raw:
                self.template = raw
            return
        piece = raw.strip()
        if piece:
            for _, pieces in self.open:
                if pieces is not None:
                    pieces.append(piece)

    def handle_starttag(self, tag, attrs):
        self._settle()
        for old in _ENDS.get(tag, ()):
            self._end(old, _SCOPE.get(old, ()))
        if tag in _VOID:
            return
        if tag == "script":
            self.taken = (dict(attrs).get("type") or "") == _TEMPLATE
        pieces: list[str] | None = [] if tag in HEADINGS or tag in BODY else None
        if pieces is not None:
            self.elements.append((tag, pieces))
        self.open.append((tag, pieces))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._settle()
        self._end(tag, ())

    def _end(self, tag: str, scope: tuple[str, ...]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in scope:
                return

    def handle_data(self, data):
        self.waiting.append(data)

    def handle_comment(self, data):
        self._settle()

    def handle_decl(self, decl):
        self._settle()


def _parsed(text: str) -> _Page:
    page = _Page()
    page.feed(text)
    page.close()
    page._settle()
    return page


_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")


def _closed_references(text: str) -> str:
    """The page with each ampersand escaped that begins no reference with a semicolon."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], text)


def html_sections(text: str, open_references: bool = True) -> list[tuple[str, str]]:
    """(section, body) of an HTML page.

    A page that carries its content as a template in a script is that template, its first.  An
    element's text is its stripped pieces put together; elements inside others count again, after
    them; a section's elements are joined by spaces.  References such as ``&amp`` are read without their
    semicolon, too, as HTML has it; without ``open_references`` they are text, as in a page cut off inside one.
    """
    page = _parsed(text if open_references else _closed_references(text))
    if page.template is not None:
        page = _parsed(page.template)
    stack: list[str] = []
    found: list[tuple[str, list[str]]] = [(INTRO, [])]
    for tag, pieces in page.elements:
        words = "".join(pieces)
        if tag in HEADINGS:
            del stack[int(tag[1]) - 1 :]
            stack.append(words)
            found.append((" > ".join(stack) or INTRO, []))
        elif words:
            found[-1][1].append(words)
    return [(name, body) for name, parts in found if (body := " ".join(parts).strip())]


def _section_lists(docs: DataFrame, fmt: str, key: str, text: str, open_references: bool) -> DataFrame:
    """key and s, the sections of each document in order."""
    split = {"markdown": markdown_sections, "html": partial(html_sections, open_references=open_references)}[fmt]
    kind = docs.schema[key].dataType.simpleString()
    shape = pa.list_(pa.struct([("section", pa.string()), ("body", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [[{"section": n, "body": b} for n, b in split(t or "")] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, type=shape)], names=["key", "s"])

    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"key {kind}, s array<struct<section: string, body: string>>")
    return out.withColumnRenamed("key", key)


def sections(docs: DataFrame, fmt: str, key: str = "doc_id", text: str = "text", open_references: bool = True) -> DataFrame:
    """key, position, section and body of each section; ``fmt`` is markdown or html."""
    return _section_lists(docs, fmt, key, text, open_references).select(key, F.posexplode("s").alias("position", "x")).select(key, "position", "x.section", "x.body")


def chunk_documents(
    docs: DataFrame, fmt: str, key: str = "doc_id", text: str = "text", max_chars: int = MAX_CHARS, overlap: int = OVERLAP, open_references: bool = True
) -> DataFrame:
    """Chunks with a running index and id within each document, which stays in one piece until then."""
    lists = _section_lists(docs, fmt, key, text, open_references)
    cut = F.transform("s", lambda x: F.transform(windows(x["body"], max_chars, overlap), lambda t: F.struct(x["section"].alias("section"), t.alias("text"))))
    out = lists.select(key, F.posexplode(F.flatten(cut)).alias("chunk_index", "c"))
    return out.select(key, "chunk_index", "c.section", "c.text", short_id(F.col(key).cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"))


def chunk_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", max_chars: int = MAX_CHARS, overlap: int = OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of plain texts with ids, and the columns of ``keep``."""
    out = docs.select(key, *keep, F.posexplode(windows(F.col(text), max_chars, overlap)).alias("chunk_index", "text"))
    return out.withColumn("chunk_id", short_id(F.col(key).cast("string"), F.col("chunk_index").cast("string")))


def corpus_inventory(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("project", "source_path").agg(F.count(F.lit(1)).alias("chunks"))


def clean_text(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn(text, collapse(F.col(text)))
