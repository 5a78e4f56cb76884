"""The alignment tells a host's template from a page's text."""

import random
import re

import pytest

from lodestead.llm import html_wrapper


def page(k):
    return f"<body><div><p>Lead {k} of the day.</p><div>Opening hours nine to five.</div><p>Body text number {k} goes here.</p><p>Second {k}.</p><p>Call us today.</p></div></body>"


def test_constant_text_is_template():
    wrapper = html_wrapper.infer([page(k) for k in range(5)])
    assert html_wrapper.extract(page(77), wrapper) == ("Lead 77 of the day. Body text number 77 goes here. Second 77.", 0)
    without = {"items": [], "main": wrapper["main"]}
    assert html_wrapper.extract(page(77), without)[0] != html_wrapper.extract(page(77), wrapper)[0]
    assert "Call us today" in html_wrapper.extract(page(1), html_wrapper.infer([page(1)]))[0]  # one page shows no template
    # the same words in another place, or on some pages only, are text
    some = html_wrapper.infer([page(k).replace("Opening hours", f"Hours {k}" if k else "Opening hours") for k in range(5)])
    assert "Opening hours nine to five." in html_wrapper.extract(page(77), some)[0]


def test_query_drops_template(spark):
    pages = spark.createDataFrame([(k, f"https://h.example/{k}", page(k)) for k in range(20)], "page_id bigint, url string, html string")
    assert {r.text for r in html_wrapper.main_text(pages).collect()} == {f"Lead {k} of the day. Body text number {k} goes here. Second {k}." for k in range(20)}


ARTICLE = "<article><h1>Title</h1><p class='notice'>One <span class='related'>two</span> <em class='ad'>three</em></p><fieldset><label>four</label></fieldset><object>five</object><output>six</output></article>"


@pytest.mark.parametrize("around", ["has-sidebar", "content-with-sidebar", "page-with-header", "no-comments", "ad-free", "article-share-enabled", "sidebar", "layout-sidebar-left", "hasSidebar", "header"])
def test_marks_around_the_article_do_not_lose_it(around):
    page = f"<body><nav>menu</nav><div class='{around}'>{ARTICLE}<div class='related-posts'><article>teaser</article></div><div id='comments'><article class='comment'>{'said ' * 50}</article></div></div><div class='sidebar'>side</div></body>"
    assert html_wrapper.extract(page, html_wrapper.infer([page]))[0] == "Title One two three four five six"


@pytest.mark.parametrize("block", ["<div class='ad'>x</div>", "<div class='site-header'>x</div>", "<section id='cookie-notice'>x</section>", "<ul class='mainNav navMenu'><li>x</ul>", "<aside>x</aside>", "<form>x<label>y</label></form>", "<div role='navigation'>x</div>", "<div class='share-buttons'>x</div>", "<script>x</script>"])
def test_marked_blocks_go(block):
    page = f"<body>{block}<article><p>a</p>{block}<p>b</p></article>{block}</body>"
    assert html_wrapper.extract(page, html_wrapper.infer([page]))[0] == "a b"


def test_depth_changes_nothing():
    """The same page in 1, 99, 101 and 5000 levels of divisions, with what must go at the bottom."""
    inner = "<p>a</p><div class='ad'>b</div><p>c</p>"
    for levels in (1, 99, 101, 5000):
        for outside, inside in ((levels, 0), (0, levels)):
            page = "<body>" + "<div>" * outside + "<article>" + "<div>" * inside + inner + "</div>" * inside + "</article>" + "</div>" * outside
            assert html_wrapper.extract(page, html_wrapper.infer([page]))[0] == "a c"


def language(items, rng):
    """A random word of the expression, as page source."""
    out = []
    for quantifier, what in items:
        times = {"": 1, "?": rng.randint(0, 1), "+": rng.randint(1, 3), "*": rng.randint(0, 3)}[quantifier]
        for _ in range(times):
            out.append("t" if what == "#" or what[0] == "t" else language(what[1], rng) if what[0] == "g" else f"<{what[1]}>{language(what[2], rng)}</{what[1]}>")
    return "".join(out)


def covers(items, node):
    """Brute force: whether an expression's language, written as a regular expression, holds the node's children."""

    def pattern(items):
        out = []
        for quantifier, what in items:
            body = "#" if what == "#" or what[0] == "t" else pattern(what[1]) if what[0] == "g" else f"<{what[1]}>{pattern(what[2])}</{what[1]}>"
            out.append(f"(?:{body}){quantifier}")
        return "".join(out)

    def said(node):
        return "".join("#" if isinstance(k, str) else f"<{k.sig}>{said(k)}</{k.sig}>" for k in node.kids)

    return re.fullmatch(pattern(items), said(node)) is not None


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(("h2", "dl", "div", "t") if depth < 2 else ("h2", "t"))
        out.append("t" if kind == "t" and (not out or out[-1] != "t") else f"<{'h2' if kind == 't' else kind}>{random_page(rng, depth + 1) if kind in ('dl', 'div') else 't'}</{'h2' if kind == 't' else kind}>")
    return "".join(out)


def test_alignment_covers_both_sides():
    """Against brute force: the alignment of two pages has both in its language, as have those of pages drawn from it."""
    rng = random.Random(5)
    for _ in range(300):
        a, b = (html_wrapper.parse(random_page(rng)) for _ in range(2))
        x, y = html_wrapper.generalise(a), html_wrapper.generalise(b)
        assert covers(x, a) and covers(y, b)
        both = html_wrapper.align(x, y)
        assert covers(both, a) and covers(both, b)
        assert html_wrapper.expression(html_wrapper.align(both, x)) == html_wrapper.expression(both) or covers(html_wrapper.align(both, x), b)


def test_many_hosts_with_large_wrappers(spark, monkeypatch):
    """Wrappers beyond the broadcast bound are joined by host and give the same texts."""
    pages = spark.createDataFrame([(k, f"https://h{0 if k % 3 else k}.example/{k}", page(k)) for k in range(60)] + [(99, None, None)], "page_id bigint, url string, html string")
    want = sorted(map(str, html_wrapper.main_text(pages).collect()))
    monkeypatch.setattr(html_wrapper, "BROADCAST_BYTES", 0)
    assert sorted(map(str, html_wrapper.main_text(pages).collect())) == want


def test_query_against_brute_force(spark, sf):
    """Every supplied page: what stands between the article's tags, cut at blocks, entities decoded."""
    import html

    from lodestead.llm import queries

    def brute(page):
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", re.sub(r"<!--.*?-->", "", page or "", flags=re.S), re.S)
        blocks = re.split(r"</?(?:h1|p)\b[^>]*>", re.sub(r"<[^>]*\Z", "", body[1])) if body else []
        said = (" ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", x))).split()) for x in blocks)
        return " ".join(x for x in said if x)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = queries.op2_html_main_text(spark, sf).collect()
    assert {r.page_id: r.text for r in out} == {i: brute(h) for i, h in pages.items()} and all(r.n_chars == len(r.text) for r in out)
