"""Main text of pages: marked and unmarked articles, broken markup, and what the ratios decide."""

import random
import time

import numpy as np
import pytest

from keyloom.llm import html_extract

LONG = "One two three four five six seven eight nine ten eleven twelve words of prose."
PAGES = {
    "": "",
    "<p>hi": "hi",
    "plain &amp; simple": "plain & simple",
    "<nav>a</nav><article><h1>T</h1><p>One&nbsp;two <b>th</b>ree<br>four</p><aside>x</aside><form>y</form><p>z</p></article><footer>f</footer>": "T One two three four z",
    "<div class='sidebar'>s</div><main><p>Long enough to be the article of this page.</p><p>ok</p><section class='comments'><article><p>no, no, no</p></article></section></main>": "Long enough to be the article of this page. ok",
    "<header>h</header><article><script>var t='</p>'</script><p>a</p><style>b{}</style></article><article><p>c</p></article>": "a",
    "<div id=c><p>One two three four five six seven eight.</p><p>ok</p><p>Nine ten eleven twelve thirteen words.</p></div><div class='cookie-notice'>n</div>": "One two three four five six seven eight. ok Nine ten eleven twelve thirteen words.",
    # text around what is not shown stays
    "<article><p>Before <script>x</script> after</p></article>": "Before after",
    "<article><p>a <iframe>x</iframe>b <svg><text>c</text></svg> <button>d</button> <label>e</label><p>f</p></article>": "a b c d e f",
    "<article><p>a<noscript>x</noscript>b</p><select><option>x</select> c<textarea>x</textarea></article>": "ab c",
    # declarations, broken and truncated markup
    "<p>a</p><![ foo ]]><p>b</p>": "a b",
    "<p>a</p><![xyz[ b": "a",
    "<!DOCTYPE html [<p>a</p><![CDATA[x]]><?php x ?>b": "a b",
    "<p>a</p><!-- left open <p>b</p>": "a",
    "<p>a <a href=\"x>b</a> c</p>": "a b c",
    "<article><p>a</p><p>b</artic": "a b",
    "<article><p>a < b &lt; c & d</p></article>": "a < b < c & d",
    "<p>&#0000065;&#" + "9" * 6000 + ";&#xD800;b": "A��b",
    # names that only hold a word like those of menus
    "<article><div class='share-of-market with-sidebar'>a</div><section id='no-comments-allowed'>b</section></article>": "a b",
    f"<div class='has-sidebar'><article><p>{LONG}</p><div class='ad'>x</div><div class='socialShareButtons'>x</div></article></div>": LONG,
    "<article><article>inner</article><p>outer</p><article class='comment'>x</article></article>": "inner outer",
    # wrappers
    f"<form id=f><div class=menu-page><article><p>{LONG}</p></article></div></form>": LONG,
    f"<nav><ul><li>a<li>b<article><p>{LONG}</p></article>": LONG,
    f"<form><div><p>{LONG}</p><p>{LONG}</p></div></form>": f"{LONG} {LONG}",
    f"<aside><article>x</article></aside><div><p>{LONG}</p></div>": LONG,
    # unmarked: the common container of the upper cluster, all its lines
    f"<body><div><a href=/>x</a></div><div><p>Intro of some words that are enough to be text.</p><blockquote>{LONG * 3}</blockquote><p>End of some words that are enough to be text.</p><ul><li>last</ul></div></body>": f"Intro of some words that are enough to be text. {LONG * 3} End of some words that are enough to be text. last",
}
LINKS = "".join(f"<li><a href='/{i}'>Go {i}</a>" for i in range(30))
SOUP = f"<body><div><h2>Site</h2><ul>{LINKS}</ul></div><div><h1>Head</h1><p>{LONG}</p><p>Short.</p><p>{LONG} {LONG}</p></div><div><ul>{LINKS}</ul><p>All rights</p></div></body>"


@pytest.mark.parametrize("html", PAGES)
def test_main_text(html):
    assert html_extract.main_text(html) == PAGES[html]


def test_ratios_decide_where_nothing_is_marked(monkeypatch):
    want = f"Head {LONG} Short. {LONG} {LONG}"
    assert html_extract.main_text(SOUP) == want
    monkeypatch.setattr(html_extract, "upper_cluster", lambda sizes, tags: np.ones(len(sizes), bool))
    assert html_extract.main_text(SOUP) != want


def test_ratios_choose_among_articles(monkeypatch):
    cards = "".join(f"<article><a href=/>Card {i}</a><a href=/>more</a></article>" for i in range(40))
    page = f"<body><div>{cards}</div><div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert html_extract.main_text(page) == f"Head {LONG} {LONG}"
    monkeypatch.setattr(html_extract, "upper_cluster", lambda sizes, tags: np.ones(len(sizes), bool))
    assert html_extract.main_text(page) != f"Head {LONG} {LONG}"


def test_smoothing_and_threshold():
    flat = html_extract.smoothed(np.full(9, 3.0))
    assert np.allclose(flat, 3.0)
    peak = html_extract.smoothed(np.array([0.0, 0, 0, 9, 0, 0, 0]))
    assert peak.argmax() == 3 and peak[2] > peak[1] and np.allclose(peak, peak[::-1])
    assert 2 < html_extract.threshold(np.array([1.0, 1, 2, 9, 10])) < 9


def test_any_markup_is_read_and_words_of_an_article_stay():
    pick = random.Random(3)
    bits = ["<", ">", "</", "<!", "<![", "<!DOCTYPE", "<?", "--", "]]>", '"', "'", "=", "&", "&#", "&#x", "/", "div", "p", "svg", "li", "a", " ", "x", "é", "\x00", "\n"]
    tags = ["<p>", "</p>", "<title>", "<main>", "<nav>", "</nav>", "<form>", "<article>", "</article>", "<!--", "-->", "<script>", "</script>", "<svg/>", "<select>", "<ul class=ad>", "</ul>"]
    for _ in range(4000):
        html_extract.main_text("".join(pick.choice(bits + tags) for _ in range(pick.randrange(40))))
    inline = ["<b>", "</b>", "<i class='ad x'>", "</i>", "<script>z('</p>')</script>", "<svg><path d=''/></svg>", "<br>", "<img src=x>", "<iframe>z</iframe>", "<!-- z -->", "<![if z]>", "</u>", "<section>", "</section>", "<table><tr><td>", "</table>"]
    for _ in range(500):
        words = [f"w{i}" for i in range(pick.randrange(1, 12))]
        body = "".join(f" {w} {pick.choice(inline)}" for w in words)
        assert html_extract.main_text(f"<nav>n</nav><article><p>{body}</p></article><footer>f</footer>").split() == words, body


@pytest.mark.parametrize("unit", ["<div>x", "<!-- x ", "<a x='", "</p></ul><div><ul>", "<![", "<p>x</p>", "&#", "<svg><title>"])
def test_time_is_linear(unit):
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        html_extract.main_text("<div>" + unit * n)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_extract(spark):
    rows = [(i, f"u{i}", h, "old", "k") for i, h in enumerate(PAGES)] + [(None, None, None, None, None), (1, "u1", "<p>hi", "old", "k"), (500, "long", f"<article><p>{LONG * 60_000}</p></article>", "", "")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, _kl_html string")).collect()
    assert list(got[0].asDict()) == ["page_id", "url", "_kl_html", "text", "n_chars"]
    texts = [*PAGES.values(), "", "hi", LONG * 60_000]
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r.page_id, r.url, r._kl_html, r.text, r.n_chars) for r in got), key=key) == sorted(((r[0], r[1], r[4], t, len(t)) for r, t in zip(rows, texts)), key=key)
    none = html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string"))
    assert none.columns == ["page_id", "url", "text", "n_chars"] and none.count() == 0
