"""Main text: scoring against brute force, and pages of several shapes."""

import random

from ratecard.llm import html_extract as h

PAGE = ('<!DOCTYPE html><html><head><title>T x</title><script>var t="</p>";f(1);</script></head><body><nav><ul>'
        '<li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav><!-- ad 1 --><div class="ad">buy this now '
        'and more of it today</div><article><h1>{0}</h1><p><b>{0}<br><p>{1}</p></article><footer>&copy; x &middot; '
        'all rights of this are reserved now</footer>{2}')


def page(i):
    body = " ".join(f"w{i}x{k}" for k in range(1 + i % 40))
    return (PAGE.format(f"Head {i} &amp; on", body, "</body></html>" if i % 3 else ""),
            f"Head {i} & on\nHead {i} & on\n{body}")


def test_best_stretch():
    rng = random.Random(1)
    for _ in range(500):
        s = [rng.randint(-4, 4) for _ in range(rng.randint(0, 12))]
        a, b = h.best_stretch(s)
        want = max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        assert sum(s[a:b]) == want


def test_pages():
    w = h.Weights(page(i)[0] for i in range(60))
    for i in range(60, 140):
        assert h.main_text(*[page(i)[0], w]) == page(i)[1]
    inner = ("<body><article><p>one  two &lt;b&gt;\n three</p><aside>side words here</aside><form>your name</form>"
             "<div class='share-bar'>share me</div><p>four <a href='x>y'>five</a>six</p><section id=comments><p>first"
             "!</p></section></article>")
    assert h.main_text(inner, w) == "one two <b> three\nfour fivesix"
    for empty in (None, "", "<p></p>", "<!-- x", "<script>a b c", "<nav>"):
        assert h.main_text(empty, w) == ""
    assert h.main_text("<p>no article here but words</p>", h.Weights([])) == "no article here but words"


def test_slugs_of_titles_are_content():
    w = h.Weights(page(i)[0] for i in range(60))
    inner = ('<body><article><p>a first paragraph of several words</p><h2 id="search-algorithms">one</h2><section id="social-history"><p>two three</p></section>'
             '<h2 id="related_work">four</h2><h3 id=comments>five</h3><p class="informed-consent">six</p>'
             '<section id="comments"><p>no</p></section><div class="x cookie-banner">no</div><div id="ad-2">no</div>'
             '<div class="post-share-buttons">no</div><div role="search">no</div><p>seven</p></article>')
    want = "a first paragraph of several words\none\ntwo three\nfour\nfive\nsix\nseven"
    assert h.main_text(inner, w) == want
    in_main = h.tokens(inner.replace("article>", "main>"))
    assert "\n".join(t.text for t in in_main if t.text and not t.skip) == want
    page_without = '<h2 id="search-algorithms">these are eight words so that they count</h2>'
    assert h.main_text(page_without, h.Weights([])) == "these are eight words so that they count"


WRAPPED = [
    '<form id="aspnetForm">{}</form>', '<div class="content no-sidebar">{}</div>', '<div class="with-sidebar">{}</div>',
    '<div id="page" class="site cookies-not-set">{}</div>', '<div class="page-wrapper sidebar">{}</div>',
    '<section role="search"><form><div id=comments>{}</div></form></section>', '<header class="banner">{}</header>',
    '<form class="x">{}', '<div class="widget"><div class="share">{}</div>',
]


def test_what_lies_around_an_article_does_not_drop_it():
    w = h.Weights(page(i)[0] for i in range(60))
    text = "a first paragraph of several words\nand a second one"
    for box in ("article", "main"):
        inner = f"<{box}><p>a first paragraph of several words</p><form>your name</form><p>and a second one</p></{box}>"
        for wrapper in WRAPPED:
            whole = ("<html><body><nav><a href='/'>home</a></nav>" + wrapper.format(inner)
                     + "<footer>all rights of this are reserved now</footer></body></html>")
            if box == "article":
                assert h.main_text(whole, w) == text, wrapper
            else:
                assert "\n".join(t.text for t in h.tokens(whole) if t.text and not t.skip) == text, wrapper


def test_teasers_and_headers():
    w = h.Weights(page(i)[0] for i in range(60))
    card = "<article><p>read this other long and interesting story of ours now</p></article>"
    own = "<article><header><h1>Title</h1></header><p>short text</p></article>"
    for around in ('<div class="related-posts">{}</div>', "<aside>{}</aside>", "<form>{}</form>"):
        assert h.main_text(f"<body>{own}{around.format(card * 3)}</body>", w) == "Title\nshort text"
    assert h.main_text(f"<body><aside>{card}</aside></body>", w) == ""  # an aside is never spared
    two = f'<div class="related"><article><p>one two</p></article></div><form>{card}</form>'
    assert h.main_text(two, w) == "read this other long and interesting story of ours now"  # the longest is
    seen = h.tokens("<body><header>site</header><main><header><h1>Title</h1></header><p>some text</p></main>")
    assert [t.text for t in seen if t.text and not t.skip] == ["Title", "some text"]


def test_page_wide_forms():
    none = h.Weights([])
    words = " ".join(f"w{i}" for i in range(30))
    assert h.main_text(f"<form id=f><div><p>{words}</p></div></form>", none) == words
    assert h.main_text(f"<p>{words}</p><form>name and street</form>", none) == words


def test_held_out_pages_without_article_elements(spark):
    """The scan finds the content where no element marks it: the article tag renamed after fitting."""
    w = h.Weights(page(i)[0] for i in range(60))
    right = [h.main_text(page(i)[0].replace("article>", "div>"), w) == page(i)[1] for i in range(60, 260)]
    assert sum(right) >= 0.95 * sum(len(page(i)[1].split()) > 12 for i in range(60, 260))


def test_a_very_long_page():
    body = "".join(f"<p>paragraph {i} of the long text &amp; more</p>" for i in range(40_000))
    got = h.main_text(f"<body><nav>menu</nav><article>{body}</article><footer>end</footer>", h.Weights([page(1)[0]]))
    assert got.count("\n") == 39_999 and got.endswith("paragraph 39999 of the long text & more")


def test_weights_counted_by_tasks_equal_those_of_the_pages(spark):
    rows = [(i, page(i)[0]) for i in range(40)] + [(3, page(3)[0]), (50, "<p>no label</p>"), (51, None)]
    fitted = h.fit_weights(spark.createDataFrame(rows, "page_id long, html string").repartition(3))
    assert fitted.odds == h.Weights(page(i)[0] for i in range(40)).odds


def test_rows(spark):
    rows = [(i, "u", page(i)[0], "x") for i in range(50)] + [(None, None, None, None), (3, "u", page(3)[0], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = h.extract(pages).collect()
    want = [(i, u, page(i)[1] if t else "", len(page(i)[1]) if t else 0) for i, u, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert h.extract(pages.limit(0)).count() == 0
