"""Markup without the copies of elements that stand in a page too often.

An element's copies are the elements of the same page with equal markup: names, attributes
in their order and all that is inside; quotes, spaces inside tags and character references
do not count. They are told by hashes over the page's tokens, so that a page takes time in
proportion to its length, however deep its elements are nested.

Defined cases
  null markup     null, nothing removed
  empty markup    itself
  unclosed tags   end where the element around them ends
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.operators.dom import VOID

#: Base and modulus of the hashes of runs of tokens.
BASE, MODULUS = 0x1F3D5B79A8C6E24, (1 << 61) - 1


class _Tokens(HTMLParser):
    """kind, name, normal form and place of each token of a text; the end of one is the place of the next."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.tokens: list[tuple[str, str, str, int]] = []
        self.feed(html)
        self.close()

    def _add(self, kind: str, name: str, normal: str) -> None:
        line, column = self.getpos()
        self.tokens.append((kind, name, normal, self.lines[line - 1] + column))

    def handle_starttag(self, tag, attrs):
        self._add("void" if tag in VOID else "open", tag, repr(("<", tag, attrs)))

    def handle_startendtag(self, tag, attrs):
        self._add("void", tag, repr(("<", tag, attrs)) if tag in VOID else repr(("</>", tag, attrs)))

    def handle_endtag(self, tag):
        self._add("close", tag, repr((">", tag)))

    def handle_data(self, data):
        self._add("text", "", repr(("text", data)))

    def handle_comment(self, data):
        self._add("text", "", repr(("comment", data)))

    def handle_decl(self, decl):
        self._add("text", "", repr(("declaration", decl)))

    handle_pi = unknown_decl = handle_decl


def _elements(tokens: list[tuple[str, str, str, int]]) -> list[tuple[int, int]]:
    """First token of each element and the one behind its last, in the order of the page."""
    found: list[list[int]] = []
    inside: list[tuple[str, int]] = []
    still_open: Counter[str] = Counter()
    for at, (kind, name, _, _) in enumerate(tokens):
        if kind in ("open", "void"):
            found.append([at, at + 1])
        if kind == "open":
            inside.append((name, len(found) - 1))
            still_open[name] += 1
        if kind == "close" and still_open[name]:
            while True:
                last, element = inside.pop()
                still_open[last] -= 1
                found[element][1] = at + (last == name)
                if last == name:
                    break
    for _, element in inside:
        found[element][1] = len(tokens)
    return [(a, b) for a, b in found]


def without_copies(html: str, most: int) -> tuple[str, int]:
    """html without the copies of an element behind its first most, and the number of elements taken out, what they hold not counted."""
    tokens = _Tokens(html).tokens
    sums, power = [0], [1]
    for _, _, normal, _ in tokens:
        sums.append((sums[-1] * BASE + int.from_bytes(blake2b(normal.encode("utf-8", "surrogatepass"), digest_size=7).digest())) % MODULUS)
        power.append(power[-1] * BASE % MODULUS)
    places = [t[3] for t in tokens] + [len(html)]
    times: dict[tuple[int, int], int] = {}
    kept, upto, behind, removed = [], 0, 0, 0
    for a, b in _elements(tokens):
        if a < behind:
            continue  # gone with an element around it
        key = b - a, (sums[b] - sums[a] * power[b - a]) % MODULUS
        times[key] = times.get(key, 0) + 1
        if times[key] > most:
            kept.append(html[upto : places[a]])
            upto, behind, removed = places[b], b, removed + 1
    return "".join(kept) + html[upto:], removed


def cut_repeats(html: Column, most: int = 50) -> Column:
    """A struct of html, without the copies of elements behind the first most of a page, and removed, the number of those."""

    def of(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, 0) if x is None else without_copies(x, most) for x in html], columns=["html", "removed"])

    return F.pandas_udf(of, "struct<html:string,removed:int>")(html)


def as_page(text: Column) -> Column:
    """A text as a page: itself if it begins with an html element, else as one paragraph."""
    return F.when(text.rlike(r"^(?i)<html[^>]*>"), text).otherwise(F.concat(F.lit("<html><body><p>"), text, F.lit("</p></body></html>")))
