"""Layouts with known main text, to train the extractor on: pages drawn from a grammar, filled with texts of the table."""

from __future__ import annotations

import html as entities
import random

#: A node: (tag, attributes, children, part of the main text). A child that is a string is text.
Node = tuple

# Attribute values for the parts of a layout.
MAIN_NAMES = ["content", "main-content", "post", "entry-content", "article-body", "story", "post-body", "text", "page-content", "blog-post", "articleText", "single-post", "news-item", "prose"]
NEUTRAL_NAMES = ["wrap", "container", "row", "col-8", "outer", "inner", "box", "grid", "layout", "c1", "block", "l-2"]
NAMES = {
    "nav": ["nav", "navbar", "main-menu", "menu", "site-navigation", "topNav", "breadcrumb", "breadcrumbs", "pagination", "toc", "tabs"],
    "header": ["header", "site-header", "masthead", "branding", "top-banner"],
    "footer": ["footer", "site-footer", "copyright", "page-foot", "legal", "colophon"],
    "sidebar": ["sidebar", "side-bar", "widget", "related-posts", "recommended", "trending", "most-popular", "rail", "read-more", "right-side widget-area"],
    "notice": ["cookie-notice", "cookie-banner", "gdpr-consent", "alert", "popup", "modal", "site-notice", "notification", "disclaimer", "message-bar"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promo-box", "ad-slot", "sponsor-message", "promotion"],
    "form": ["newsletter", "search-form", "login", "signup", "subscribe", "contact-form", "subscribe-box"],
    "comment": ["comments", "comment-list", "reader-comments", "discussion", "responses", "disqus_thread", "comment-section"],
    "social": ["share", "social-share", "share-buttons", "follow-us", "byline", "post-meta"],
}
TAGS = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "notice": "div", "advert": "div", "form": "form", "comment": "section", "social": "div"}


class Layout:
    def __init__(self, seed: int, texts: list[str]):
        self.rng, self.texts = random.Random(seed), texts
        self.plain = self.rng.random() < 0.2  # a page whose main part has no telling name

    def words(self, least: int, most: int) -> str:
        words = self.rng.choice(self.texts).split() or ["text"]
        n, at = self.rng.randint(least, most), self.rng.randrange(len(words))
        return " ".join((words * (1 + n // len(words) + 1))[at : at + n])

    def paragraph(self) -> str:
        x = self.rng.random()
        return self.rng.choice(self.texts) if x < 0.4 else self.words(1, 4) if x < 0.65 else self.words(1, 90)

    def named(self, value: str) -> str:
        return self.rng.choice([f' class="{value}"', f' id="{value}"', f' class="{self.rng.choice(NEUTRAL_NAMES)} {value}"', f" class={value.split()[0]}"])

    def links(self, n: int) -> Node:
        items = [("li", "", [("a", ' href="/x"', [self.words(1, 4)], 0)], 0) for _ in range(n)]
        return ("ul", "", items, 0) if self.rng.random() < 0.7 else ("div", "", [i[2][0] for i in items], 0)

    def boiler(self, kind: str) -> Node:
        rng = self.rng
        semantic = rng.random() < 0.5 and TAGS[kind] != "div"
        tag = TAGS[kind] if semantic or kind == "form" else rng.choice(["div", "div", "section", "p" if kind in ("notice", "advert", "social") else "div"])
        attributes = self.named(rng.choice(NAMES[kind])) if not semantic or rng.random() < 0.4 else ""
        if kind == "nav":
            inner = [self.links(rng.randint(2, 9))]
        elif kind == "header":
            inner = [("a", ' href="/"', [self.words(1, 3)], 0), ("p", "", [self.words(2, 8)], 0)] + ([self.boiler("nav")] if rng.random() < 0.4 else [])
        elif kind == "footer":
            inner = [f"© {self.words(1, 30)}"] if rng.random() < 0.5 else [("p", "", [f"© {self.words(3, 30)}"], 0), self.links(rng.randint(1, 5))]
        elif kind == "sidebar":
            inner = [("h3", "", [self.words(1, 4)], 0), rng.choice([self.links(rng.randint(2, 6)), ("p", "", [self.words(5, 40)], 0), ("div", "", [self.words(5, 40)], 0)])]
        elif kind in ("notice", "advert"):
            inner = [self.words(2, 40)] if tag == "p" or rng.random() < 0.6 else [("p", "", [self.words(3, 40)], 0), ("a", ' href="/y"', [self.words(1, 3)], 0)]
            if kind == "notice" and tag != "p" and rng.random() < 0.5:
                inner = [*inner, ("button", "", [self.words(1, 2)], 0)]
        elif kind == "form":
            inner = [("label", "", [self.words(1, 5)], 0), ("input", ' type="text"', [], 0), ("button", "", [self.words(1, 2)], 0)]
            if rng.random() < 0.5:
                inner = [("p", "", [self.words(3, 20)], 0), *inner]
            if rng.random() < 0.4:
                inner = [*inner, ("select", "", [("option", "", [self.words(1, 2)], 0) for _ in range(3)], 0)]
        elif kind == "comment":
            one = rng.choice(["div", "li", "article"])
            said = [(one, rng.choice(["", ' class="comment"', ' class="reply"']), [(rng.choice(["span", "b", "div", "h4"]), "", [self.words(1, 3)], 0), ("p", "", [self.paragraph()], 0)], 0) for _ in range(rng.randint(1, 6))]
            inner = [("h3", "", [self.words(1, 3)], 0), ("ul" if one == "li" else "div", "", said, 0)]
        else:
            inner = [self.words(1, 6)] if tag == "p" else [("span", "", [self.words(1, 3)], 0), ("a", ' href="/s"', [self.words(1, 2)], 0)]
        return (tag, attributes, inner, 0)

    def body(self) -> list[Node]:
        rng, out = self.rng, []
        if rng.random() < 0.85:
            out.append(("h1", "", [self.words(2, 12)], 1))
        for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 7, 9, 12, 16])):
            x = rng.random()
            if x < 0.72:
                text = self.paragraph()
                inner = [text]
                if rng.random() < 0.3:
                    cut = text.split()
                    k = rng.randint(0, len(cut))
                    mid = (rng.choice(["b", "i", "em", "strong", "span", "a"]), "", [self.words(1, 4)], 1)
                    inner = [" ".join(cut[:k]) + " ", mid, " " + " ".join(cut[k:])]
                out.append(("p", "", inner, 1))
            elif x < 0.80:
                out.append((rng.choice(["h2", "h3"]), "", [self.words(1, 8)], 1))
            elif x < 0.86:
                out.append((rng.choice(["ul", "ol"]), "", [("li", "", [self.words(2, 20)], 1) for _ in range(rng.randint(2, 5))], 1))
            elif x < 0.90:
                out.append(("blockquote", "", [("p", "", [self.paragraph()], 1)] if rng.random() < 0.5 else [self.paragraph()], 1))
            elif x < 0.93:
                out.append(("table", "", [("tr", "", [("td", "", [self.words(1, 5)], 1) for _ in range(3)], 1) for _ in range(rng.randint(1, 4))], 1))
            elif x < 0.95:
                out.append(("figure", "", [("img", ' src="x"', [], 0), ("figcaption", "", [self.words(3, 12)], 1)], 1))
            elif x < 0.97:
                out.append(("pre", "", [self.words(3, 30)], 1))
            else:
                out.append(("div", "", [self.paragraph(), ("br", "", [], 1), self.paragraph()], 1))
        for kind, chance in (("advert", 0.25), ("social", 0.15), ("form", 0.08), ("sidebar", 0.08), ("notice", 0.06)):
            if rng.random() < chance:
                out.insert(rng.randint(0, len(out)), self.boiler(kind))
        if rng.random() < 0.1:
            out.append(self.boiler("comment"))
        return out

    def page(self) -> Node:
        rng, body = self.rng, self.body()
        if not self.plain and rng.random() < 0.55:
            main = (rng.choice(["article", "article", "main"]), self.named(rng.choice(MAIN_NAMES)) if rng.random() < 0.3 else "", body, 1)
        else:
            main = (rng.choice(["div", "section"]), "" if self.plain else self.named(rng.choice(MAIN_NAMES)), body, 1)
        parts = [main]
        for kind, chance, where in (("header", 0.45, 0), ("nav", 0.7, 0), ("advert", 0.5, 2), ("notice", 0.35, 2), ("sidebar", 0.45, 2), ("form", 0.3, 2), ("comment", 0.4, 1), ("social", 0.2, 1), ("footer", 0.85, 1)):
            if rng.random() < chance:
                here = self.boiler(kind)
                front = where == 0 or where == 2 and rng.random() < 0.5
                parts = [here, *parts] if front else [*parts, here]
        while rng.random() < 0.35:
            parts = [("div", rng.choice(["", self.named(rng.choice(NEUTRAL_NAMES))]), parts, 1)]
        if rng.random() < 0.3:
            parts.append(("script", "", ["var a = 1 < 2; f(a);"], 0))
        head = ("head", "", [("title", "", [self.words(2, 8)], 0), ("style", "", ["p{margin:0}"], 0), ("script", "", ["var t;"], 0)], 0)
        return ("html", "", [head, ("body", "", parts, 1)], 1)


def render(node: Node, labels: list[int]) -> str:
    """The page's HTML; ``labels`` gets a 0 or 1 for each element in document order."""
    if isinstance(node, str):
        return entities.escape(node)
    tag, attributes, children, label = node
    labels.append(label)
    inner = "".join(render(c, labels) if not isinstance(c, str) or tag not in ("script", "style") else c for c in children)
    return f"<{tag}{attributes}>" + ("" if tag in ("br", "img", "input") else f"{inner}</{tag}>")


def layout(seed: int, texts: list[str]) -> tuple[str, list[int]]:
    labels: list[int] = []
    return render(Layout(seed, texts).page(), labels), labels
