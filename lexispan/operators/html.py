"""Article text from raw HTML."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.lists import CONTENT_SELECTORS, REMOVED_SELECTORS, REMOVED_TAGS

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote"}
_CLOSES_P = _BLOCKS | {"div", "ul", "ol", "article", "section", "table", "main", "header", "footer", "nav", "aside", "figure", "form", "pre"}


class _Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: "_Node | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, _Node))

    def strings(self):
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            else:
                todo.extend(reversed(x.children))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P:
            self._close("p", stop={"div", "li", "article", "section", "td", "blockquote", "main", "aside"})
        if tag == "li":
            self._close("li", stop={"ul", "ol"})
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(node)
        if tag not in _VOID:
            self.now = node

    def handle_endtag(self, tag):
        self._close(tag, stop=set())

    def _close(self, tag, stop):
        node = self.now
        while node.parent is not None and node.tag not in stop:
            if node.tag == tag:
                self.now = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.now.children.append(data)


def matches(node: _Node, selector: str) -> bool:
    """Whether a simple selector (tag, .class, #id, [attribute='x'], [attribute*='x'], or a descendant of a tag) fits."""
    if " " in selector:
        outer, inner = selector.split(" ", 1)
        up = node.parent
        while up is not None and not matches(up, outer):
            up = up.parent
        return up is not None and matches(node, inner)
    if selector[0] == ".":
        return selector[1:] in node.attrs.get("class", "").split()
    if selector[0] == "#":
        return node.attrs.get("id") == selector[1:]
    if m := re.fullmatch(r"\[([\w-]+)(\*?)='(.*)'\]", selector):
        held = node.attrs.get(m[1])
        return held is not None and (m[3] in held if m[2] else held == m[3])
    return node.tag == selector


def text_of(html: str | None) -> str:
    """Text of the content's paragraphs, headings, list items and quotes, in order; nested ones again."""
    if not html or not html.strip():
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    for node in list(tree.root.walk()):
        if node.tag in REMOVED_TAGS or any(matches(node, s) for s in REMOVED_SELECTORS):
            if node.parent is not None:
                node.parent.children.remove(node)
    nodes = list(tree.root.walk())
    root = next((n for s in CONTENT_SELECTORS for n in nodes if n.tag and matches(n, s)), tree.root)
    parts = [x for n in root.walk() if n.tag in _BLOCKS and (x := " ".join(n.strings())).strip()] or [" ".join(root.strings())]
    return re.sub(r"\s+", " ", " ".join(parts)).strip()


@F.pandas_udf(StringType())
def _text(html: pd.Series) -> pd.Series:
    return html.map(text_of)


def extract_text(column: str | Column) -> Column:
    return _text(column)
