"""Reading pages: what selectors and the sweep find, on well-formed, odd and hostile pages."""

import random
import re
import time

import pytest

from pricebasket.functions import html

TAGS, CLASSES = ["div", "b", "i", "span", "section"], ["m", "n", "p"]


class Tree:
    """The plain form: a tree of nodes, walked for each selector and block."""

    def __init__(self, page):
        self.page = page
        self.children = [[c for c, q in enumerate(page.parents) if q == e] for e in range(len(page.tags))]

    def below(self, e):
        return [x for c in self.children[e] for x in (c, *self.below(c))]

    def above(self, e):
        return [] if self.page.parents[e] < 0 else [self.page.parents[e], *self.above(self.page.parents[e])]

    def texts(self, e):
        own = {e, *self.below(e)}
        return [t.strip() for t, o in zip(self.page.texts, self.page.owners, strict=True) if o in own]

    def fits(self, e, step):
        tag, rest = re.match(r"([a-z]*)(.*)", step).groups()
        if tag and self.page.tags[e] != tag:
            return False
        for part in re.findall(r"\.[a-z]+|\[[^\]]+\]|:has\([^)]+\)", rest):
            own = self.page.attributes[e]
            if part[0] == "." and part[1:] not in own.get("class", "").split():
                return False
            if part[0] == "[" and part[1:-1].split("=")[0] not in own:
                return False
            if part[0] == ":" and not any(self.fits(x, part[5:-1]) for x in self.below(e)):
                return False
        return True

    def select(self, selector):
        *left, last = selector.split()

        def chain(e, left):
            return not left or any(self.fits(x, left[-1]) and chain(x, left[:-1]) for x in self.above(e))

        return [e for e in range(len(self.page.tags)) if self.fits(e, last) and chain(e, left)]

    def pairs(self, item, name, price):
        out = []
        for block in self.select(item):
            own = [e for e in self.select(name) if e in self.below(block)]
            if not own:
                continue
            name_text, price_text = " ".join(self.texts(own[0])), None
            if price == html.TEXT_AFTER_NAME:
                whole = " ".join(self.texts(block))
                found = html.TRAILING_NUMBER.search(whole[len(name_text) :] if name_text and whole.startswith(name_text) else whole)
                price_text = found and found[1]
            elif prices := [e for e in self.select(price) if e in self.below(block)]:
                price_text = " ".join(self.texts(prices[0]))
            if price_text is not None:
                out.append((name_text, price_text))
        return out

    def swept(self):
        out = []
        for text, owner in zip(self.page.texts, self.page.owners, strict=True):
            if html.PRICE_TEXT.search(text):
                around = self.page.parents[owner] if self.page.parents[owner] >= 0 else owner
                name = html.PRICE_TEXT.sub("", " ".join(self.texts(around))).strip(" .-–—|·")
                if name and len(name) <= 90 and not html.NOT_AN_ITEM.match(name):
                    out.append((name, text.strip()))
        return out


def random_page(r, n=40):
    out, opened = [], []
    for _ in range(n):
        kind = r.random()
        if kind < 0.35:
            tag = r.choice(TAGS)
            opened.append(tag)
            out.append(f"<{tag} class='{' '.join(r.sample(CLASSES, r.randint(0, 2)))}'{r.choice(['', ' x', ' x=1'])}>")
        elif kind < 0.6 and opened:
            out.append(f"</{r.choice(opened) if r.random() < 0.2 else opened.pop()}>")
        else:
            out.append(r.choice(["Soup", " Tea 4", "$7.25", "$", " 5 ", "for $3 each", " - ", "$1,2", "tax", "9.50", "<!-- x -->", "<br>", "&amp;", "w" * 50]))
    return "".join(out)


@pytest.mark.parametrize("seed", range(60))
def test_flat_lists_give_what_a_tree_gives(seed):
    r = random.Random(seed)
    page = html.parse(random_page(r))
    tree = Tree(page)
    for selector in (".m", "div", "div.m", ".m .n", "section .m b", "[x]", ".m[x]", "div:has(b)", "div:has(.n) i", ".m .m"):
        assert html.select(page, selector) == tree.select(selector), selector
    for price in (".p", "i", html.TEXT_AFTER_NAME):
        for item in (".m", "div:has(b)"):
            assert html.by_selectors(page, item, ".n", price) == (len(tree.select(item)), tree.pairs(item, ".n", price))
    assert html.by_sweep(page) == tree.swept()


def test_deep_pages_cost_one_pass():
    n = 100_000
    for page in ("<div class=m>" * n + "Soup $7.25", "<div class=m><b class=n>Soup</b>$7" * n, "<div>$1 " * n, "<b>" * n + "</i>" * n + "$2", "<div>" * n + "</div>" * n + "<p>Tea $2.00"):
        began = time.time()
        read = html.parse(page)
        html.by_selectors(read, ".m", ".m .n", html.TEXT_AFTER_NAME)
        html.by_selectors(read, ".m:has(.n)", ".n", "b")
        html.by_sweep(read)
        assert time.time() - began < 60
    assert html.by_sweep(html.parse("<div>" * n + "<p>Tea <i>$2.00</i></p>")) == [("Tea", "$2.00")]


def test_fragments_are_in_a_body():
    assert html.by_sweep(html.parse("Soup <b>$7.25</b>")) == [("Soup", "$7.25")]
    assert html.by_sweep(html.parse("<p>Soup $7.25</p><p>Tea $2.00</p>")) == [("Soup  Tea", "Soup $7.25"), ("Soup  Tea", "Tea $2.00")]
    assert html.by_sweep(html.parse("<title>Menu</title><p><b>Soup</b> <i>$7</i></p>")) == [("Soup", "$7")]
    assert html.select(html.parse("<html><head><title>x</title></head><body class=c><p>y"), "body.c p") == [4]
    assert html.by_sweep(html.parse("")) == [] and html.parse("").tags == ["html"]
    assert html.by_selectors(html.parse("<p>x"), "p >", "b", "i") == (0, [])


def test_a_price_in_two_pieces():
    assert html.by_sweep(html.parse("<div><b>Soup $</b><i>5</i><i>$4</i></div>")) == [("Soup", "$4")]


def test_the_sweep_over_raw_pages():
    """What the sweep finds on given pages is what a tree gives."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet", columns=["html"]).column("html").to_pylist()
    assert len(pages) > 20
    for page in pages:
        read = html.parse(page or "")
        assert html.by_sweep(read) == Tree(read).swept()
        assert html.select(read, "div p") == Tree(read).select("div p")
