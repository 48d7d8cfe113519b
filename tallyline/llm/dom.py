"""A light DOM of an HTML page, and the features of its nodes."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag that ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split())
#: Elements that end an open one of the same family, and where the search for it stops.
FAMILIES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "body": (("head",), ()),
}
TAG_GROUPS = {
    "main": "article main",
    "navigation": "nav menu",
    "header": "header hgroup",
    "footer": "footer",
    "aside": "aside dialog",
    "form": "form input button select option textarea label fieldset legend datalist",
    "list": "ul ol li dl dt dd",
    "heading": "h1 h2 h3 h4 h5 h6",
    "paragraph": "p blockquote pre",
    "table": "table thead tbody tfoot tr td th caption",
    "figure": "figure figcaption picture",
    "unseen": "head title meta link script style noscript template base iframe object embed svg canvas video audio img source",
    "division": "div section center",
    "root": "html body",
    "link": "a",
}
TAG_GROUP = {tag: k for k, tags in enumerate(TAG_GROUPS.values()) for tag in tags.split()}
# Words in class, id, role and label attributes, by what they tell.
TOKEN_GROUPS = {
    "content": "content article post entry story main body text page prose markdown blog news read column mainbody hentry",
    "navigation": "nav navbar navigation menu breadcrumb breadcrumbs crumbs crumb topbar toolbar pagination pager tabs toc skip sitemap submenu dropdown",
    "header": "header masthead banner branding logo hero site sitename",
    "footer": "footer foot copyright colophon legal bottom contentinfo imprint",
    "sidebar": "sidebar side aside widget widgets complementary related recommended recommendations trending popular rail more also teaser tagcloud tags recirc latest",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay message warning notification announcement privacy disclaimer toast paywall",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner adsense dfp gpt outbrain taboola commercial adbox adslot",
    "form": "form search login signin signup subscribe subscription newsletter register contact input button cta email",
    "comment": "comment comments commentlist respond reply replies discussion disqus thread responses reader feedback",
    "social": "share sharing social follow twitter facebook like likes author byline bio meta date rating print",
    "hidden": "hidden hide invisible collapsed none sr offscreen visuallyhidden",
}
TOKEN_GROUP: dict[str, list[int]] = {}
for _k, _words in enumerate(TOKEN_GROUPS.values()):
    for _word in _words.split():
        TOKEN_GROUP.setdefault(_word, []).append(_k)

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"']+)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""",
    re.S,
)
TELLING = re.compile(r"""\b(?:class|id|role|aria-label|itemprop|name)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
MARKS = re.compile(r"[.,;:!?]")


@dataclass
class Page:
    """Elements in document order (a parent before its children) and the texts between tags, with their element."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    #: (element, text) in document order; element -1 with a space marks where a block starts or ends.
    pieces: list[tuple[int, str]] = field(default_factory=list)


def parse(html: str) -> Page:
    """The page's elements, with implied end tags; never fails, whatever the markup. Its time is linear in the page."""
    page, stack, at, size = Page(), [], 0, len(html)
    opened: dict[str, list[int]] = {}  # depths of the open elements by tag

    def shut(depth: int) -> None:
        for n in stack[depth:]:
            opened[page.tags[n]].pop()
        del stack[depth:]

    def innermost(tag: str) -> int:
        return opened[tag][-1] if opened.get(tag) else -1

    def push(tag: str, attributes: str) -> None:
        page.tags.append(tag)
        page.parents.append(stack[-1] if stack else -1)
        page.attributes.append(attributes)

    def enter(tag: str) -> None:
        opened.setdefault(tag, []).append(len(stack))
        stack.append(len(page.tags) - 1)

    def add_text(text: str) -> None:
        if text:
            if not stack and not text.isspace():  # a page without its own body
                push("body", "")
                enter("body")
            page.pieces.append((stack[-1] if stack else -1, entities.unescape(text) if "&" in text else text))

    while at < size:
        m = TOKEN.search(html, at)
        if not m:
            add_text(html[at:])
            break
        add_text(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            page.pieces.append((-1, " "))
        if m[1] or m[4]:
            if opened.get(tag):
                shut(innermost(tag))
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in ENDS_P and opened.get("p"):
            shut(innermost("p"))
        if tag in FAMILIES:
            family, stops = FAMILIES[tag]
            within = max((innermost(t) for t in stops), default=-1)
            depths = [opened[f][k] for f in family if (k := bisect_right(opened.get(f, []), within)) < len(opened.get(f, []))]
            if depths:
                shut(min(depths))
        if not stack and tag not in ("html", "head", "body"):
            push("body", "")
            enter("body")
        push(tag, attributes)
        if tag in VOID or attributes.endswith("/") and tag in ("path", "g", "svg", "use"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            stop = end.start() if end else size
            page.pieces.append((len(page.tags) - 1, html[at:stop]))
            at = stop
        enter(tag)
    return page


def _groups(attributes: str) -> int:
    """Bits of the token groups that an element's attributes name."""
    bits = 0
    if attributes:
        for m in TELLING.finditer(attributes):
            for word in WORD.findall(m[1] or m[2] or m[3] or ""):
                for k in TOKEN_GROUP.get(word.lower(), ()):
                    bits |= 1 << k
        if HIDDEN.search(attributes):
            bits |= 1 << (len(TOKEN_GROUPS) - 1)
    return bits


FEATURES = [
    *(f"tag_{g}" for g in TAG_GROUPS), *(f"within_{g}" for g in TAG_GROUPS), *(f"token_{g}" for g in TOKEN_GROUPS), *(f"within_token_{g}" for g in TOKEN_GROUPS), *(f"holds_token_{g}" for g in TOKEN_GROUPS),
    "depth", "children", "siblings", "place_among_siblings", "log_text", "log_own_text", "text_share", "density", "link_density", "tags_below", "paragraphs_below", "marks_per_text",
    "density_to_siblings", "siblings_log_text", "siblings_link_density", "place_in_text", "parent_link_density", "parent_text_share", "own_to_text",
]


def features(page: Page) -> np.ndarray:
    """A row of FEATURES for each element."""
    n = len(page.tags)
    groups, tokens = len(TAG_GROUPS), len(TOKEN_GROUPS)
    parents = np.array(page.parents, dtype=np.int64)
    group = np.array([TAG_GROUP.get(t, -1) for t in page.tags], dtype=np.int64)
    seen = group != list(TAG_GROUPS).index("unseen")
    own, own_marks, before, total = np.zeros(n), np.zeros(n), np.zeros(n), 0
    first = np.full(n, -1.0)
    for node, text in page.pieces:
        if node >= 0 and seen[node]:
            k = len(text) - text.count(" ")
            if first[node] < 0:
                first[node] = total
            own[node] += k
            own_marks[node] += len(MARKS.findall(text))
            total += k
    link = np.zeros(n, dtype=bool)
    depth, tag_bits, token_bits = np.zeros(n), [0] * n, [_groups(a) for a in page.attributes]
    below_bits = list(token_bits)
    within_tags, within_tokens = [0] * n, [0] * n
    for i, p in enumerate(page.parents):
        tag_bits[i] = 1 << int(group[i]) if group[i] >= 0 else 0
        if p >= 0:
            depth[i] = depth[p] + 1
            within_tags[i] = within_tags[p] | tag_bits[p]
            within_tokens[i] = within_tokens[p] | token_bits[p]
            link[i] = link[p]
        link[i] |= page.tags[i] == "a"
    text, marks, links, tags, paragraphs = own.copy(), own_marks.copy(), np.where(link, own, 0), np.ones(n), np.array([float(t == "p") for t in page.tags])
    start, children, order = first.copy(), np.zeros(n), np.zeros(n)
    for i in range(n - 1, -1, -1):
        p = page.parents[i]
        if p >= 0:
            text[p] += text[i]
            marks[p] += marks[i]
            links[p] += links[i]
            tags[p] += tags[i]
            paragraphs[p] += paragraphs[i]
            below_bits[p] |= below_bits[i]
            if start[i] >= 0 and (start[p] < 0 or start[i] < start[p]):
                start[p] = start[i]
    for i, p in enumerate(page.parents):
        if p >= 0:
            order[i] = children[p]
            children[p] += 1
    up = np.where(parents >= 0, parents, 0)
    siblings = np.where(parents >= 0, children[up], 1)
    others = np.maximum(siblings - 1, 1)

    def of_siblings(x: np.ndarray) -> np.ndarray:
        sums = np.zeros(n)
        np.add.at(sums, up[parents >= 0], x[parents >= 0])
        return np.where(siblings > 1, (sums[up] - x) / others, 0)

    density, link_density = text / tags, links / np.maximum(text, 1)

    def bits(values: list[int], width: int) -> np.ndarray:
        return (np.array(values, dtype=np.int64)[:, None] >> np.arange(width)) & 1

    numbers = [
        depth, children, siblings, order / np.maximum(siblings, 1), np.log1p(text), np.log1p(own), text / max(total, 1), np.log1p(density), link_density, np.log1p(tags), np.log1p(paragraphs), marks / np.maximum(text, 1),
        np.log1p(density) - np.log1p(of_siblings(density)), np.log1p(of_siblings(text)), of_siblings(link_density), start / max(total, 1), link_density[up], text[up] / max(total, 1), own / np.maximum(text, 1),
    ]
    return np.concatenate([bits(tag_bits, groups), bits(within_tags, groups), bits(token_bits, tokens), bits(within_tokens, tokens), bits(below_bits, tokens), np.stack(numbers, axis=1)], axis=1).astype(np.float64)


def text_of_kept(page: Page, kept: np.ndarray) -> str:
    """Text of the kept elements in page order, white space as one space, blocks joined by one."""
    return " ".join("".join(text for node, text in page.pieces if node < 0 or kept[node]).split())
