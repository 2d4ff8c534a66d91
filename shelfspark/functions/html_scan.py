"""One small reader of HTML structure, run on Arrow batches.

It only reports elements; which of them make a product, and how, is decided
in Spark expressions over its output.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style"}
WANTED_CLASS = (
    "product-title", "description", "entry-content", "annotation", "about", "page-text", "product-tab", "price", "author",
    "publisher", "isbn", "sku", "brand",
)
SCOPE_CLASS = ("attribute", "product", "data", "params", "spec")
WANTED_TAG = {"h1", "a", "img", "title"}

ELEMENT = "struct<tag:string,cls:string,ident:string,prop:string,kind:string,value:string,data:map<string,string>,text:string>"
SCAN_SCHEMA = f"elements array<{ELEMENT}>, rows array<struct<name:string,value:string>>, lines array<struct<tag:string,text:string>>, stock string"


# Which open elements a start tag ends, and the elements that such an end does not reach beyond.
_BLOCKS = (
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr li main menu nav ol p pre search section summary table ul"
).split()
ENDS = {
    **{t: ({"p"}, {"table", "td", "th", "button"}) for t in _BLOCKS},
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
}
TABLE_TAGS = {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}
OUT_OF_STOCK, IN_STOCK = ("нет в наличии", "out of stock"), ("в наличии", "в продаже", "in stock")


class _Node:
    __slots__ = ("tag", "cls", "ident", "attrs", "start", "cells", "parts", "scoped", "opens_scope", "slot", "classed")


class _Reader(HTMLParser):
    """One buffer holds the page's text; elements remember where theirs starts, and it is cut out where a rule reads it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Node] = []
        self.count: dict[str, int] = {}
        self.elements: list[dict | None] = []
        self.rows: list[dict] = []
        self.lines: list[dict] = []
        self.text: list[str] = []
        self.holders: list[_Node] = []
        self.out = self.inside = False
        self.silent = self.scopes = self.classed = 0

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in ("li", "dt", "dd"):
            self._end(*ENDS["p"])
        a = {k: (v or "") for k, v in attrs}
        node = _Node()
        node.tag, node.attrs, node.cls, node.ident = tag, a, a.get("class", "").lower(), a.get("id", "").lower()
        node.start, node.cells, node.parts, node.scoped, node.slot = len(self.text), [], {}, self.scopes > 0, None
        node.opens_scope = any(t in node.cls for t in SCOPE_CLASS) or "attribute" in node.ident
        # only the outermost of nested elements with a class is searched for stock marks: it holds the texts of all
        node.classed = bool(node.cls) and not self.classed
        wanted = (
            tag in WANTED_TAG or "itemprop" in a or "itemtype" in a or node.ident in ("age", "age_dopusk")
            or any(t in node.cls for t in WANTED_CLASS) or "description" in node.ident or "annotation" in node.ident
            or any(k.startswith("data-") for k in a)
        )
        if wanted:
            # document order: the place is taken when the element opens
            node.slot = len(self.elements)
            self.elements.append(None)
        if tag in VOID:
            self._close(node)
            return
        self.silent += tag in SILENT
        self.scopes += node.opens_scope
        self.classed += node.classed
        self.count[tag] = self.count.get(tag, 0) + 1
        if "params-row" in node.cls:
            self.holders.append(node)
        self.open.append(node)

    def _pop(self) -> _Node:
        node = self.open.pop()
        self.silent -= node.tag in SILENT
        self.scopes -= node.opens_scope
        self.classed -= node.classed
        self.count[node.tag] -= 1
        if self.holders and self.holders[-1] is node:
            self.holders.pop()
        self._close(node)
        return node

    def _end(self, tags: set[str], bounds: set[str]) -> None:
        """End the nearest open element of `tags`, and what is open inside it, unless a bound lies between."""
        if not any(self.count.get(t) for t in tags):
            return
        for node in reversed(self.open):
            if node.tag in tags:
                while self._pop() is not node:
                    pass
                return
            if node.tag in bounds:
                return

    def handle_endtag(self, tag):
        if self.count.get(tag):
            self._end({tag}, {"table"} if tag in TABLE_TAGS - {"table"} else set() if tag == "table" else {"td", "th", "caption"})

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)

    def _cut(self, node: _Node) -> str:
        return " ".join("".join(self.text[node.start :]).split())

    def _close(self, node: _Node) -> None:
        a, tag, cls = node.attrs, node.tag, node.cls
        above = self.open[-1] if self.open else None
        cell = tag in ("td", "th") and above is not None and above.tag == "tr"
        line = tag in ("li", "p", "div") and node.scoped
        part = next((p for p in ("param-name", "param-value") if p in cls), None) if self.holders else None
        if not (node.slot is not None or node.classed or cell or line or part or "not-available" in cls):
            text = None
        else:
            text = self._cut(node)
        if node.slot is not None:
            self.elements[node.slot] = {
                "tag": tag, "cls": cls, "ident": node.ident, "prop": a.get("itemprop", ""), "kind": a.get("itemtype", ""),
                "value": a.get("content") or a.get("href") or a.get("src") or a.get("data-src") or "",
                "data": {k: v for k, v in a.items() if k.startswith("data-")}, "text": text,
            }
        if text and "not-available" in cls:
            self.out = True
        if text and node.classed:
            low = text.lower()
            self.out |= any(t in low for t in OUT_OF_STOCK)
            self.inside |= any(t in low for t in IN_STOCK)
        if cell:
            above.cells.append(text)
        if part:
            self.holders[-1].parts.setdefault(part, text)
        if "params-row" in cls and len(node.parts) == 2:
            self.rows.append({"name": node.parts["param-name"], "value": node.parts["param-value"]})
        if tag == "tr" and node.scoped and len(node.cells) >= 2:
            self.rows.append({"name": node.cells[0], "value": node.cells[1]})
        if line and ":" in text:
            self.lines.append({"tag": tag, "text": text})

    def finish(self) -> dict:
        self.close()
        while self.open:
            self._pop()
        stock = "out_of_stock" if self.out else "in_stock" if self.inside else ""
        return {"elements": [e for e in self.elements if e], "rows": self.rows, "lines": self.lines, "stock": stock}


def scan(html: str | None) -> dict:
    reader = _Reader()
    reader.feed(html or "")
    return reader.finish()


def scan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas: every column of the batch plus the scan of its html."""
    for batch in batches:
        found = pd.DataFrame([scan(h) for h in batch["html"]], index=batch.index, columns=["elements", "rows", "lines", "stock"])
        yield pd.concat([batch, found], axis=1)
