"""Selected node texts of HTML pages: one Arrow-batched function over a column of pages."""

from __future__ import annotations

from collections import defaultdict
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, elements whose text isn't shown, and start tags that end an open p.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style"}
BLOCK = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: For each of these, the elements that keep an open p outside them from being ended.
KEEPS_P = {tag: {"div", "li", "td", "body", "section", "article"} - {tag} for tag in BLOCK}


class Node:
    """An element; what lies inside are the tree's items from `start` to `end`."""

    __slots__ = ("tag", "classes", "start", "end")

    def __init__(self, tag: str, classes: frozenset, start: int):
        self.tag, self.classes, self.start, self.end = tag, classes, start, start

    def fits(self, step: list[str]) -> bool:
        """step: a tag, which may be empty, and classes."""
        return step[0] in ("", self.tag) and self.classes.issuperset(step[1:])


class Tree(HTMLParser):
    """Elements and texts in document order; unclosed p and li end where HTML says. Depth costs nothing.

    references: whether character references are resolved, by HTML's rules; otherwise texts keep them as they are written.
    """

    def __init__(self, page: str, references: bool = True):
        super().__init__(convert_charrefs=True)
        # the parser resolves what follows an ampersand, so another character, which the page doesn't have, stands in for it
        self.stand_in = None if references else next(c for c in map(chr, range(0xE000, 0x110000)) if c not in page)
        page = page.replace("&", self.stand_in) if self.stand_in else page
        self.items: list[Node | str] = []
        self.root = Node("", frozenset(), 0)
        self.stack = [self.root]
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of each tag in the stack
        self.scopes: dict[str, Node | None] = {}
        self.feed(page)
        self.close()
        self._drop(0)

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns of the page, which nothing asks for, aren't counted."""
        return j

    def _drop(self, to: int) -> None:
        """End the open elements from place `to` on."""
        while len(self.stack) > to:
            node = self.stack.pop()
            node.end = len(self.items)
            if self.stack:
                self.places[node.tag].pop()

    def _end(self, tag: str, within: set[str]) -> None:
        """End the innermost open element of a tag, unless one of `within` stands between."""
        at = self.places[tag][-1] if self.places.get(tag) else 0
        if at and not any(self.places[w] and self.places[w][-1] > at for w in within):
            self._drop(at)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self._end("p", KEEPS_P[tag])
        if tag == "li":
            self._end("li", {"ul", "ol"})
        named = (dict(attrs).get("class") or "") if attrs else ""
        named = named.replace(self.stand_in, "&") if self.stand_in else named
        node = Node(tag, frozenset(named.split()), len(self.items) + 1)
        self.items.append(node)
        if tag not in VOID:
            self.places[tag].append(len(self.stack))
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._drop(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        self._end(tag, set())

    def handle_data(self, data: str) -> None:
        self.items.append(data.replace(self.stand_in, "&") if self.stand_in else data)

    def text(self, node: Node, between: str) -> str:
        found, at = [], node.start
        while at < node.end:
            x = self.items[at]
            at += 1
            if isinstance(x, str):
                found.append(x.strip())
            elif x.tag in HIDDEN:
                at = x.end
        return between.join(filter(None, found))

    def select(self, root: Node, selector: str) -> list[Node]:
        """Descendants that match steps of tag.class.class, in document order."""
        *outer, last = (step.split(".") for step in selector.split())
        met = int(bool(outer) and root.fits(outer[0]))
        found, around = [], [(root.end, met)]  # ends of the elements around, and how many outer steps they match
        for x in self.items[root.start : root.end]:
            if isinstance(x, str):
                continue
            while x.start > around[-1][0]:
                around.pop()
            met = around[-1][1]
            if met == len(outer):
                if x.fits(last):
                    found.append(x)
            elif x.fits(outer[met]):
                met += 1
            around.append((x.end, met))
        return found

    def first(self, selector: str) -> Node | None:
        """The first node of the page that a selector finds, searched for once, as many rules have the same scope."""
        if selector not in self.scopes:
            self.scopes[selector] = next(iter(self.select(self.root, selector)), None)
        return self.scopes[selector]


def pick(tree: Tree, rule: dict) -> list[str] | None:
    """Texts that a rule selects: selectors are fallbacks; `of` first narrows down to the first node it finds."""
    for scope in rule.get("of", [None]):
        place = tree.root if scope is None else tree.first(scope)
        if place is not None:
            break
    else:
        return None
    if place is None:
        return None
    if not rule.get("select"):
        return [""]
    for selector in rule["select"]:
        if nodes := tree.select(place, selector):
            wanted = {"first": nodes[:1], "last": nodes[-1:]}.get(rule.get("pick", "first"), nodes)
            return [t for n in wanted if (t := tree.text(n, rule.get("join", " ")))]
    return []


def select_text(html: Column, rules: dict[str, dict], references: bool = True) -> Column:
    """A map from each rule's name to the texts it selects; a null entry where its scope is missing, null for pages that can't be read.

    rules: name -> {"select": [selectors], "of": [scopes], "pick": "first" | "last" | "all", "join": text}.
    references: resolve character references; otherwise texts have them as the page does.
    """

    @F.pandas_udf("map<string,array<string>>")
    def chosen(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            try:
                tree = Tree(page or "", references)
            except AssertionError:  # the parser's word for a declaration that it doesn't know
                out.append(None)
                continue
            out.append({k: pick(tree, r) for k, r in rules.items()})
        return pd.Series(out)

    return chosen.asNondeterministic()(html)  # otherwise filters on its fields run it twice
