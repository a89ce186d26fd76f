"""HTML to text: the one place where a parser runs, inside Arrow batches."""

from __future__ import annotations

import html
import sys
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import by_slices

# Executors need not have this package installed: the reader travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements whose text counts as one line, elements without text or end tag.
BLOCKS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6", "p", "li"])
SILENT = frozenset(["script", "style", "template"])
VOID = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
    "basefont", "bgsound", "command", "frame", "image", "isindex", "keygen", "menuitem", "nextid", "spacer",
])


class _Reader(HTMLParser):
    """Collects text pieces and, per outermost block element, its own pieces."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.pieces: list[str] = []
        self.blocks: list[list[str]] = []
        self.depth = 0
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and self.depth == 0:
            self.blocks.append([])
        if tag not in VOID:
            self.open.append(tag)
            self.depth += tag in BLOCKS
            self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while True:
            top = self.open.pop()
            self.depth -= top in BLOCKS
            self.silent -= top in SILENT
            if top == tag:
                return

    def handle_data(self, data):
        piece = data.strip()
        if piece and not self.silent:
            self.pieces.append(piece)
            if self.depth:
                self.blocks[-1].append(piece)


def read_html(content: str | None) -> tuple[str, list[str] | None]:
    """Plain text, and the text of the outermost blocks or None when there are none."""
    if not content:
        return "", []
    reader = _Reader()
    reader.feed(html.unescape(content))
    reader.close()
    text = " ".join(" ".join(reader.pieces).split())
    if not reader.blocks:
        return text, None
    return text, [line for line in (" ".join(" ".join(b).split()) for b in reader.blocks) if line]


_PARSED = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("blocks", T.ArrayType(T.StringType())),
])


_ARROW = pa.struct([("text", pa.string()), ("blocks", pa.list_(pa.string()))])


def _parsed(content: pa.Array) -> pa.Array:
    pages = [read_html(c.as_py()) for c in content]
    return pa.StructArray.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*pages, strict=True), _ARROW, strict=True)], fields=list(_ARROW)) if pages else pa.array([], _ARROW)


#: Escaped HTML to ``struct<text, blocks>``; blocks is null when the page has no block element.
parse_html = F.arrow_udf(by_slices(_parsed), _PARSED)

# Keeps Spark from running the reader again for filters on its result.
parse_html = parse_html.asNondeterministic()
