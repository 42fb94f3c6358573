"""From markup back to tables: box trees of pseudo-markup, texts with the colour they are drawn in, and the pool of marking colours.

Each row's text is scanned by a small helper in Arrow batches; what comes out are rows.

Defined cases: a null or empty text gives no rows; the scan of pseudo-markup ends at the
first thing that is no tag with a box, and keeps what it has; a closing tag that is not that
of the innermost open one is passed over; tags after the root's end are children of the root.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = re.compile(r"\s*(?:<s>\s*)*<(/?)([a-zA-Z0-9]+)\s*([^>]*)>")
_BOX = re.compile(r"\[([^\]]*)\]")
NODE = "node int, parent int, place int, tag string, x int, y int, w int, h int"
# The steps of a channel of the marking colours, elements without an end tag, and named colours by their CSS values.
POOL_FIRST, POOL_STEP, POOL_LEVELS = 10, 16, 16
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMED_COLOURS = {"black": "#000000", "silver": "#c0c0c0", "gray": "#808080", "white": "#ffffff", "maroon": "#800000", "red": "#ff0000", "purple": "#800080", "fuchsia": "#ff00ff", "green": "#008000", "lime": "#00ff00", "olive": "#808000", "yellow": "#ffff00", "navy": "#000080", "blue": "#0000ff", "teal": "#008080", "aqua": "#00ffff", "orange": "#ffa500"}


def box_nodes(text: str | None, width: float = 1, height: float = 1) -> list[tuple]:
    """Rows of NODE of one pseudo-markup text, boxes in units of a page of width and height."""
    out: list[tuple] = []
    stack: list[int] = []
    children: list[int] = []
    at, text = 0, text or ""
    while found := _TAG.match(text, at):
        closing, tag, rest = found.groups()
        at = found.end()
        if closing:
            if len(stack) > 1 and out[stack[-1]][3] == tag:
                stack.pop()
            continue
        box = _BOX.search(rest)
        try:
            x, y, w, h = (float(v) for v in box.group(1).split(",")[:4])
        except (AttributeError, ValueError):
            break
        parent = stack[-1] if stack else None
        place = 0 if parent is None else children[parent]
        if parent is not None:
            children[parent] += 1
        stack.append(len(out))
        out.append((len(out), parent, place, tag, int(x * width), int(y * height), int(w * width), int(h * height)))
        children.append(0)
    return out


def _rows_of(texts: DataFrame, keys: list[str], text_col: str, schema: str, scan) -> DataFrame:
    """The rows that scan gives for each text, beside its keys."""
    fields = T._parse_datatype_string(schema).fields
    full = T.StructType([*(texts.schema[k] for k in keys), *fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(T.StructType(fields))
        for batch in batches:
            for i, text in enumerate(batch.column(len(keys))):
                rows = scan(text.as_py())
                if rows:
                    own = [batch.column(k).slice(i, 1).take(pa.array([0] * len(rows))) for k in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True))], names=full.names)

    return texts.select(*keys, F.col(text_col)).mapInArrow(work, full)


def markup_nodes(texts: DataFrame, keys: list[str], *, html_col: str = "html", width: float = 1, height: float = 1) -> DataFrame:
    """keys and NODE: the box trees of pseudo-markup, as trees.pseudo_markup writes it."""
    return _rows_of(texts, keys, html_col, NODE, lambda text: box_nodes(text, width, height))


def _colour(style: str) -> str | None:
    """The last colour a style sets, as #rrggbb."""
    set_ = [s for s in style.split(";") if "color" in s and "background-color" not in s and ":" in s]
    if not set_:
        return None
    value = set_[-1].split(":", 1)[1].replace("!important", "").strip().lower()
    if value.startswith("#"):
        return value
    if value.startswith("rgb(") and value.endswith(")"):
        try:
            return "#{:02x}{:02x}{:02x}".format(*map(int, value[4:-1].split(",")))
        except (ValueError, IndexError):
            return None
    return NAMED_COLOURS.get(value)


class _Texts(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.inside = False
        self.rows: list[tuple] = []
        self.pending = ""

    def flush(self) -> None:
        text, self.pending = self.pending.strip(), ""
        if text and self.inside:
            self.rows.append((len(self.rows), text, self.open[-1][1] if self.open else "#000000"))

    def handle_starttag(self, tag, attrs):
        self.flush()
        self.inside = self.inside or tag == "body"
        if tag not in VOID:
            above = self.open[-1][1] if self.open else "#000000"
            own = _colour(dict(attrs).get("style") or "") if self.inside else None
            self.open.append((tag, own or above))

    def handle_startendtag(self, tag, attrs):
        self.flush()

    def handle_endtag(self, tag):
        self.flush()
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
        self.inside = self.inside and tag != "body"

    def handle_data(self, data):
        self.pending += data

    def handle_comment(self, data):
        self.flush()


def coloured_texts(html: str | None) -> list[tuple]:
    """(place, text, colour) of the texts of a page's body; a colour counts for all below it that sets none."""
    reader = _Texts()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.rows


def text_colours(pages: DataFrame, keys: list[str], *, html_col: str = "html") -> DataFrame:
    """keys, place, text, colour: every text of every page's body with the colour it is drawn in."""
    return _rows_of(pages, keys, html_col, "place int, text string, colour string", coloured_texts)


def pool_colour(place: Column, offset: int = 0) -> Column:
    """The marking colour of the element at a place, RRGGBB, from the end of the pool; null beyond its 4096 colours.

    It follows from the place alone, so a task that runs again deals the same colours.
    """
    at = POOL_LEVELS**3 - 1 - place
    level = lambda i: (POOL_FIRST + POOL_STEP * (F.floor(at / POOL_LEVELS**i) % POOL_LEVELS) + offset) % 256
    text = F.concat(*(F.lpad(F.hex(level(i).cast("long")), 2, "0") for i in (2, 1, 0)))
    return F.when((place >= 0) & (place < POOL_LEVELS**3), text)
