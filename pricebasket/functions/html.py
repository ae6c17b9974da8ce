"""A page's items, by the selector forms that outlets use (a helper of the extraction job).

A page is read once, into flat lists: elements in the order of their start tags, each with its parent and where it ends, and
texts with the element each stands in. What is below an element is a stretch of these lists, so no step walks a tree, and
each selector is matched in one pass over the elements, however deep they are and however many blocks there are.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

# What looks like a price, texts that are no items, the marker for prices that follow the name.
PRICE_TEXT = re.compile(r"\$\s*\d{1,3}(?:\.\d{2})?")
NOT_AN_ITEM = re.compile(r"^(gift card|delivery|tip|tax|subtotal|total|minimum|fee)\b", re.IGNORECASE)
TEXT_AFTER_NAME = "::text_after_name"
TRAILING_NUMBER = re.compile(r"(\d+(?:\.\d{1,2})?)\s*$")
EDGES, LONGEST_NAME = " .-–—|·", 90
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
IN_HEAD = {"title", "meta", "link", "base", "style", "script"}
CLOSED_BY = {"p": {"p", "div", "ul", "ol", "table", "section", "h1", "h2", "h3", "h4"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
COMPOUND = re.compile(r"^(?P<tag>[a-zA-Z][\w-]*|\*)?(?P<rest>(?:\.[\w-]+|#[\w-]+|\[[^\]]+\]|:has\([^)]*\))*)$")


class Page(HTMLParser):
    """Element 0 is the html element; content outside of the head is in a body, also that of a fragment without one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attributes: list[dict[str, str]] = []
        self.parents: list[int] = []
        #: For each element, the first element and the first text after what is below it, and its own first text.
        self.ends: list[int] = []
        self.text_starts: list[int] = []
        self.text_ends: list[int] = []
        self.texts: list[str] = []
        self.owners: list[int] = []
        self._open: list[int] = []
        self._named: Counter[str] = Counter()
        self._hidden, self._data, self._body = 0, [], False
        self._start("html", {})

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        self.parents.append(self._open[-1] if self._open else -1)
        self._open.append(len(self.tags))
        self._named[tag] += 1
        self.tags.append(tag)
        self.attributes.append(attributes)
        self.ends.append(0)
        self.text_starts.append(len(self.texts))
        self.text_ends.append(0)

    def _end(self) -> None:
        element = self._open.pop()
        self._named[self.tags[element]] -= 1
        self.ends[element], self.text_ends[element] = len(self.tags), len(self.texts)

    def _now(self) -> str:
        return self.tags[self._open[-1]]

    def _into(self, part: str) -> None:
        """Opens the head or the body, if content comes that belongs there."""
        if part == "body" and self._now() in ("html", "head"):
            if self._now() == "head":
                self._end()
            self._start("body", {})
            self._body = True
        elif part == "head" and self._now() == "html" and not self._body:
            self._start("head", {})

    def _flush(self) -> None:
        text, self._data = "".join(self._data), []
        if text.strip():
            self._into("body")
            self.texts.append(text)
            self.owners.append(self._open[-1])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._flush()
        if tag in ("script", "style"):
            self._hidden += 1
            return
        attributes = {k: v or "" for k, v in attrs}
        if tag in ("html", "head", "body"):
            if tag == "html":
                self.attributes[0] = attributes | self.attributes[0]
            else:
                self._into(tag)
                if self._now() == tag:
                    self.attributes[self._open[-1]].update(attributes)
            return
        self._into("head" if tag in IN_HEAD and not self._body else "body")
        while self._now() in CLOSED_BY and tag in CLOSED_BY[self._now()]:
            self._end()
        self._start(tag, attributes)
        if tag in VOID:
            self._end()

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if tag in ("script", "style"):
            self._hidden = max(0, self._hidden - 1)
        elif tag not in ("html", "body") and self._named[tag]:
            while self._now() != tag:
                self._end()
            self._end()

    def handle_comment(self, data: str) -> None:
        self._flush()

    def handle_data(self, data: str) -> None:
        if not self._hidden and data:
            self._data.append(data)

    def finished(self) -> Page:
        self.close()
        self._flush()
        while self._open:
            self._end()
        return self

    def text(self, element: int) -> str:
        return " ".join(t.strip() for t in self.texts[self.text_starts[element] : self.text_ends[element]])


def parse(html: str) -> Page:
    page = Page()
    page.feed(html)
    return page.finished()


@dataclass(frozen=True)
class Compound:
    """What one step of a selector asks of an element."""

    tag: str | None
    classes: tuple[str, ...]
    ids: tuple[str, ...]
    attributes: tuple[tuple[str, str], ...]
    has: tuple[str, ...]


@lru_cache(maxsize=4096)
def compiled(selector: str) -> tuple[Compound, ...] | None:
    """A selector of tags, classes, ids, attributes and :has, and descendants of such; None for any other."""
    steps = []
    for step in re.findall(r"(?:\[[^\]]*\]|\([^)]*\)|\S)+", selector):
        found = COMPOUND.match(step)
        if not found:
            return None
        parts = re.findall(r"\.[\w-]+|#[\w-]+|\[[^\]]+\]|:has\([^)]*\)", found["rest"])
        of = lambda mark, parts=parts: tuple(p for p in parts if p[0] == mark)
        attributes = tuple((n, v.strip("'\"")) for n, _, v in (p[1:-1].partition("=") for p in of("[")))
        steps.append(Compound(None if found["tag"] in (None, "*") else found["tag"], tuple(p[1:] for p in of(".")), tuple(p[1:] for p in of("#")), attributes, tuple(p[5:-1] for p in of(":"))))
    return tuple(steps) or None


def _below(matches: list[int], element: int, end: int) -> int | None:
    """The first match below an element."""
    k = bisect_right(matches, element)
    return matches[k] if k < len(matches) and matches[k] < end else None


def select(page: Page, selector: str) -> list[int]:
    """The elements that a selector matches, in order."""
    steps = compiled(selector)
    if steps is None:
        return []
    inner = {h: select(page, h) for step in steps for h in step.has}

    def fits(element: int, step: Compound) -> bool:
        own = page.attributes[element]
        return (
            step.tag in (None, page.tags[element])
            and (not step.classes or set(step.classes) <= set(own.get("class", "").split()))
            and all(own.get("id") == i for i in step.ids)
            and all(n in own and (not v or own[n] == v) for n, v in step.attributes)
            and all(_below(inner[h], element, page.ends[element]) is not None for h in step.has)
        )

    last, out = len(steps) - 1, []
    above = [0] * len(page.tags)  # how many steps the elements from the top down to this one fulfil, in order
    for element, parent in enumerate(page.parents):
        done = above[parent] if parent >= 0 else 0
        if done == last and fits(element, steps[last]):
            out.append(element)
        above[element] = done + 1 if done < last and fits(element, steps[done]) else done
    return out


def _after_name(page: Page, block: int, name: str) -> str | None:
    """The number at the end of a block's text, which is in its last piece, less the name if the block begins with it."""
    first, end = page.text_starts[block], page.text_ends[block]
    if first == end:
        return None
    last, before, k = page.texts[end - 1].strip(), 0, first
    while k < end - 1 and before <= len(name):
        before += len(page.texts[k].strip()) + 1
        k += 1
    if name and len(name) > before and page.text(block).startswith(name):  # the name reaches into the last piece
        last = last[len(name) - before :]
    found = TRAILING_NUMBER.search(last)
    return found[1] if found else None


def by_selectors(page: Page, item: str, name: str, price: str) -> tuple[int, list[tuple[str, str]]]:
    """How many blocks there are, and the name and price texts of those that have both."""
    blocks, names, pairs = select(page, item), select(page, name), []
    prices = [] if price == TEXT_AFTER_NAME else select(page, price)
    for block in blocks:
        own = _below(names, block, page.ends[block])
        if own is None:
            continue
        name_text = page.text(own)
        if price == TEXT_AFTER_NAME:
            price_text = _after_name(page, block, name_text)
        else:
            at = _below(prices, block, page.ends[block])
            price_text = None if at is None else page.text(at)
        if price_text is not None:
            pairs.append((name_text, price_text))
    return len(blocks), pairs


def by_sweep(page: Page) -> list[tuple[str, str]]:
    """Texts that look like prices, with what stands around them as names: the text two elements up, without its prices."""
    stripped = [t.strip() for t in page.texts]
    telling = [k for k, t in enumerate(stripped) if PRICE_TEXT.sub("", t).strip(EDGES)]
    # a price may be in two pieces, of which one ends in its mark
    open_ended = [k for k, t in enumerate(stripped) if t.endswith("$")]
    names: dict[int, str | None] = {}

    def name_of(around: int) -> str | None:
        first, end = page.text_starts[around], page.text_ends[around]
        if (k := bisect_left(open_ended, first)) == len(open_ended) or open_ended[k] >= end:
            own = telling[bisect_left(telling, first) : bisect_left(telling, end)]
            if not own or own[-1] - own[0] > LONGEST_NAME:  # pieces are a space apart at least
                return None
            first, end = own[0], own[-1] + 1
        name = PRICE_TEXT.sub("", " ".join(stripped[first:end])).strip(EDGES)
        return name if name and len(name) <= LONGEST_NAME and not NOT_AN_ITEM.match(name) else None

    pairs = []
    for text, own, owner in zip(page.texts, stripped, page.owners, strict=True):
        if "$" not in text or not PRICE_TEXT.search(text):
            continue
        around = page.parents[owner] if page.parents[owner] >= 0 else owner
        if around not in names:
            names[around] = name_of(around)
        if names[around] is not None:
            pairs.append((names[around], own))
    return pairs
