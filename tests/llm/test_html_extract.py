import time

import numpy as np
import pytest

from tallyline.llm import html_extract as hx
from tallyline.llm.dom import FEATURES, features, parse
from tallyline.llm.html_layouts import layout


@pytest.fixture(scope="module")
def forest(spark):
    pages = spark.createDataFrame([(i, f"<p>{' '.join(f'word{i}x{k},' for k in range(5 + 7 * i))}</p>") for i in range(12)], "page_id bigint, html string")
    return hx.fit_extractor(pages)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy this now, please.</div><article><h1>Title &amp; more</h1><p><b>One <i>two</i>
 three.<br>four<p>Short.</p><p>Long paragraph of the article, with a <a href="/x">link</a> inside, and more words after it.</p></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with this article at all, really.</p></div></section>
<footer>&copy; example</footer></body></html>"""
WANT = "Title & more One two three. four Short. Long paragraph of the article, with a link inside, and more words after it."


def test_main_text(forest):
    assert hx.main_texts([PAGE], forest) == [WANT]


def test_held_out_layouts(forest):
    right = total = 0
    for seed in range(10**6, 10**6 + 150):
        html, labels = layout(seed, [f"some words, number {k}, that fill a paragraph of a page." for k in range(9)])
        page = parse(html)
        x = features(page)
        assert x.shape == (len(labels), len(FEATURES))
        own = x[:, hx.OWN] > 0
        kept = hx.decode(page.parents, forest.probabilities(x), 1 + np.sqrt(np.expm1(x[:, hx.OWN])))
        right += (kept == np.array(labels, bool))[own].sum()
        total += own.sum()
    assert right / total >= 0.95


def test_decoding_never_contradicts_and_is_the_best():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        parents = [-1, *(int(rng.integers(-1, i)) for i in range(1, n))]
        p, w = rng.random(n), 1 + rng.random(n)

        def value(kept, p=p, w=w):
            return sum(w[i] * np.log(p[i] if k else 1 - p[i]) for i, k in enumerate(kept))

        allowed = [[m >> i & 1 for i in range(n)] for m in range(2**n)]
        allowed = [k for k in allowed if all(not k[i] or parents[i] < 0 or k[parents[i]] for i in range(n))]
        got = hx.decode(parents, p, w).astype(int).tolist()
        assert got in allowed and value(got) == pytest.approx(max(map(value, allowed)))


@pytest.mark.parametrize("html", ["", "<", "</p>", "<p", "<p class='x", "a<b", "<div>" * 3000, "<script>", "&amp &#0; &bogus;", "<p>x</div></p></p>", "<table><tr><td>a<td>b<tr>", "\0", "<a href=\"x>y</a>", "<ul><li>a<li>b</ul>" * 50])
def test_broken_markup_never_fails(forest, html):
    page = parse(html)
    assert all(p < i for i, p in enumerate(page.parents)) and len(features(page)) == len(page.tags)
    assert isinstance(hx.main_texts([html], forest)[0], str)


def test_every_training_layout_is_read_as_its_labels_say():
    for seed in range(0, hx.LAYOUTS, 5):
        html, labels = layout(seed, ["A text & more.", "<none>", "Words, words."])
        assert len(parse(html).tags) == len(labels)


@pytest.mark.parametrize("html", ["<div>" * 100_000, "<div>" * 50_000 + "</div>" * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<li>x" * 50_000, "<ul><li>" * 50_000, "<p><b>" * 50_000, "<table><tr><td>" * 30_000])
def test_deep_pages_take_linear_time(html):
    began = time.process_time()
    page = parse(html)
    assert len(features(page)) == len(page.tags) and time.process_time() - began < 15


def test_rows(spark, forest):
    pages = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (None, "u", PAGE, "t"), (3, "u", PAGE, "t"), (3, "u", PAGE, "t")], "page_id bigint, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in hx.extract_text(pages, forest).collect()), key=str)
    assert got == [(0, "u", WANT, len(WANT)), (1, "u", "", 0), (2, None, "", 0), (3, "u", WANT, len(WANT)), (3, "u", WANT, len(WANT))]
    assert hx.extract_text(pages.limit(0), forest).count() == 0
