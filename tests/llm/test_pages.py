import itertools
import time

import numpy as np
import pytest

from hindcast.llm.pages import Block, Field, block_features, extract, labelled_page, leaf_blocks, main_text, train, trained

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div id="cookie-banner" class="notice">We use cookies to make this better for all of us.</div>
<header class="site-header"><h1>My Site</h1></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<main><article><h1>A  title &amp; more</h1><p><b>First &eacute; paragraph, with &#8220;quotes&#8221;<br>and a break.<p>Second one,
over two lines that go on for a while so that it is a paragraph.</p><div class="advert">Buy this now, it is cheap!</div><p>Short.</p></article>
<aside class="related"><h3>Related</h3><p>Another story that has nothing to do with it at all.</p></aside>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this article very much, thank you all for it.</p></div></section></main>
<form><label>Search</label><input><button>Go</button></form><footer>&copy; 2020 My Site</footer></body></html>"""
TEXT = "A title & more\nFirst é paragraph, with “quotes” and a break.\nSecond one, over two lines that go on for a while so that it is a paragraph.\nShort."


def test_blocks():
    got = [b.text for b in leaf_blocks(PAGE)]
    assert got[:4] == ["We use cookies to make this better for all of us.", "My Site", "Home", "News"] and got[4:8][0] == "A title & more"
    assert [b.text for b in leaf_blocks("a<p>b<i>c</i>d<div>e</p>f")] == ["a", "bcd", "e", "f"]
    assert leaf_blocks("") == [] and leaf_blocks("<p> \n</p>") == []
    assert [b.text for b in leaf_blocks("<p>cut &am")] == ["cut &am"]
    assert [b.text for b in leaf_blocks("</div></p>x</td><li>y<li>z")] == ["x", "y", "z"]


def test_formulas_and_fallbacks_are_text():
    page = "<head><noscript>n</noscript><title>t</title></head><body><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then stop.</p>"
    assert [b.text for b in leaf_blocks(page)] == ["If x=2 then stop."]
    for tag in ("noscript", "object", "video", "audio", "canvas"):
        assert [b.text for b in leaf_blocks(f"<p>a <{tag}>b</{tag}> c</p>")] == ["a b c"]
    for tag in ("script", "style", "template", "iframe", "svg"):
        assert [b.text for b in leaf_blocks(f"<p>a <{tag}>b</{tag}> c</p>")] == ["a c"]


PLAIN = "".join(f"<p>Plain paragraph number {k} says a few things about the river, the town and its people." for k in range(6))


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>t</title><meta name=x>{}", "<head><script>x</script>{}", "<html><head><style>p</style><body>{}", "<title>t</title>{}",
        "<body><svg><path d=x>{}", "<head><svg><g>{}", "<body><div><head><title>late</title></head>{}</div>",
        "<body><div>{}</div>", "<body><div class=container>{}</div>", "<table><tr><td>{}</td></tr></table>", "<body>{}", "{}",
    ],
)
def test_no_article_is_lost(page):
    assert main_text(page.format(PLAIN), trained()).count("Plain paragraph") == 6


def test_what_ends_a_head_and_an_svg():
    def texts(page):
        return [b.text for b in leaf_blocks(page)]

    assert texts("<head>loose<p>a") == ["loose", "a"]
    assert texts("<head> <title>t</title> <template><p>no</p></template> <meta x><p>a") == ["a"]
    assert texts("<p>a<svg><text>no</text><foreignObject><p>no</p></foreignObject></svg>b") == ["ab"]
    assert texts("<p>a<svg><svg><text>no<p>b</svg>c") == ["a", "bc"]
    assert texts("<div>a<template><p>no</div>b<body>c") == ["a", "b", "c"]


def test_deep_pages_are_read_in_linear_time():
    """Paths, hints and what is around a block against a plain walk; and 20,000 open elements."""
    page = "<div class=nav><ul><li>a<li>b<section id=comments><p>c<div>d</section>e<td>f</ul>g"
    blocks = leaf_blocks(page)
    assert [b.text for b in blocks] == ["a", "b", "c", "d", "e", "f", "g"]
    assert [b.path[-1] for b in blocks] == ["li", "li", "p", "div", "li", "td", "div"]
    assert [b.near for b in blocks] == ["nav", "nav", "comment", "comment", "nav", "nav", "nav"]
    assert [set(b.hints) for b in blocks[2:5]] == [{"nav", "comment"}, {"nav", "comment"}, {"nav"}]
    start = time.process_time()
    assert len(leaf_blocks("<div class=content>w <b><x-y>" * 20_000)) == 20_000
    assert time.process_time() - start < 10


def test_pages(spark):
    rows = [(1, "u", PAGE, "clash"), (2, None, None, ""), (3, "u", "", ""), (4, "u", "<nav><a href=x>y</a></nav>", ""), (1, "u", PAGE, "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract(df)
    assert out.columns == ["page_id", "url", "text", "_text"]
    assert sorted((r["page_id"], r["_text"]) for r in out.collect()) == [(1, TEXT), (1, TEXT), (2, ""), (3, ""), (4, "")]
    assert extract(df.limit(0)).count() == 0


def test_held_out_layouts():
    model, rng = trained(), np.random.default_rng(12345)
    right = total = 0
    for _ in range(200):
        blocks = leaf_blocks(labelled_page(rng))
        gold = [b.text.startswith("\x01") for b in blocks]
        for b in blocks:
            b.text = b.text.replace("\x01", "").strip() or "-"
        got = model.decode(block_features(blocks))
        right += sum(bool(a) == b for a, b in zip(got, gold, strict=True))
        total += len(gold)
    assert right / total > 0.97
    # A long text in a comment list stays out, whatever its length.
    page = PAGE.replace("I liked", "I liked " + "many words of it, " * 40)
    assert main_text(page, model) == TEXT


def test_viterbi_and_training_against_all_label_sequences():
    rng = np.random.default_rng(1)
    names = [["a"], ["b"], ["a", "b"], ["c"], []]
    model = Field({"a": 0, "b": 1, "c": 2}, rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
    scores = model.scores(names)

    def worth(labels):
        return sum(scores[k][y] for k, y in enumerate(labels)) + sum(model.moves[a, b] for a, b in itertools.pairwise(labels))

    assert tuple(model.decode(names)) == max(itertools.product((0, 1), repeat=5), key=worth)
    pages = []
    for k in range(40):
        blocks = [Block("word " * n, ("html", t), frozenset(), "none", 0, y) for t, n, y in (("nav", 2, 0), ("p", 30, 1), ("p", 1 + k % 3, 1), ("footer", 9, 0))]
        pages.append(blocks)
    learned = train(pages, rounds=40)
    assert all(learned.decode(block_features(p)) == [b.label for b in p] for p in pages)
    assert learned.moves[1, 1] > learned.moves[1, 0] or learned.moves == pytest.approx(learned.moves)
