import itertools

import numpy as np
import pytest

from tierpick.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- c -->
<div class="ad">Buy now {i}.</div><article><h1>Title {i} &amp; more</h1><p><b>It begins{i}.<br>
<p>A long paragraph of text&nbsp;that goes on &#8211; and on,\n  number {i}. It has an end.</p>
<p>Another one follows here, also of some length. That is all.</p></article>
<footer>&copy; site &middot; all rights</footer></body></html>"""
TEXT = ("Title {i} & more It begins{i}. A long paragraph of text that goes on – and on, "
        "number {i}. It has an end. Another one follows here, also of some length. That is all.")


@pytest.fixture(scope="module")
def got(spark):
    rows = [(i, f"u{i}", PAGE.replace("{i}", str(i))) for i in range(60)]
    rows += [(100, "u", None), (101, None, ""), (102, "u", "<p>" * 4000 + "deep" * 20_000),
             (None, "u", PAGE), (5, "u5", PAGE.replace("{i}", "5"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'x' AS text", "1 AS _id").repartition(3)
    return html.extract(df).collect()


def test_whole_articles_and_nothing_else(got):
    assert len(got) == 65
    for r in got:
        if r.page_id is not None and r.page_id < 60:
            assert r.text == TEXT.replace("{i}", str(r.page_id))
        assert r.n_chars == len(r.text)
    by_id = {r.page_id: r for r in got}
    assert by_id[100].text == by_id[101].text == "" and by_id[101].url is None


def test_other_layouts(spark):
    model = html.ChainModel().fit(list(html.labelled(
        [html.blocks(PAGE.replace("{i}", str(i))) for i in range(80)])))
    page = (
        '<body><div class="cookie-banner">We use cookies to make this site better. Accept?</div>'
        "<header><a href=/>Site</a></header><main><div class='post-content'>"
        "<h2>A head line</h2><p>First words of it, two lines or more. They go on and on.<p>More "
        "<i>text</i> &lt;here&gt;, which goes on for a while as articles do.</div>"
        "<form><label>Mail</label><button>Subscribe</button></form></main>"
        "<aside><p>Another story that you might like to read.</p></aside>"
        '<div id="comments"><p class="comment">I think that this is wrong, at length.</p></div>'
        "<footer>All rights reserved.</footer></body>")
    assert html.main_text(model, page) == (
        "A head line First words of it, two lines or more. They go on and on. More text <here>, "
        "which goes on for a while as articles do.")


@pytest.mark.parametrize("page, want", [
    ("a < b &amp c", ["a < b & c"]), ("<p>one<p>two", ["one", "two"]),
    ("<ul><li>x<li>y</ul>z", ["x", "y", "z"]), ("x<br>y", ["x y"]),
    ("<script>a</p>b</script>c", ["c"]), ("<style>p{}", []), ("<!-- open", []),
    ("a<b>b</b>c<div>d</div>e", ["abc", "d", "e"]), ("<p hidden>no</p>yes", ["yes"]),
    ("</p></div>text", ["text"]), ("<a title='1>2'>t</a>", ["t"]), ("", []),
])
def test_blocks(page, want):
    assert [b.text for b in html.blocks(page)] == want


@pytest.mark.parametrize("page, want", [
    ("<html><head><title>T</title><body><article><p>one<p>two</article>", ["one", "two"]),
    ("<head><meta charset=x><link href=y><style>p{}</style>\n<p>one", ["one"]),
    ("<head><title>T</title>\n one<b>two</b>", ["onetwo"]), ("<head>a < b", ["a < b"]),
    ("<head><noscript><img src=x>no</noscript><template><p>no</template><br>yes", ["yes"]),
    ("<head><title>T</title></head><body>one<head><p>two", ["one", "two"]),
    ("<head><script>var a='<p>no';</script><title>no</title>\n</head>yes", ["yes"]),
])
def test_an_open_head_ends_where_the_body_begins(page, want):
    assert [b.text for b in html.blocks(page)] == want


def test_viterbi_and_marginals_like_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(1, 7))
        model = html.ChainModel()
        model.index = {f"f{i}": i for i in range(n)}
        model.weights, model.pairs = rng.normal(size=n), rng.normal(size=(2, 2))
        features = [[f"f{i}"] for i in range(n)]

        def value(y):
            return sum(model.weights[i] * y[i] for i in range(n)) + sum(
                model.pairs[y[i], y[i + 1]] for i in range(n - 1))

        ways = list(itertools.product([0, 1], repeat=n))
        assert tuple(model.decode(features)) == max(ways, key=value)
        weight = np.exp([value(y) for y in ways])
        one, _ = model._marginals(model.weights.copy())
        for i in range(n):
            assert np.isclose(one[i], weight[[y[i] == 1 for y in ways]].sum() / weight.sum())


def test_whole_article_without_an_end_of_head(spark):
    rows = [(i, f"u{i}", PAGE.replace("{i}", str(i)).replace("</head>", "")) for i in range(60)]
    pages = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert [r.text for r in pages.orderBy("page_id").collect()] == [
        TEXT.replace("{i}", str(i)) for i in range(60)]


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(empty).count() == 0


def extracted(spark, pages):
    rows = [(i, f"u{i}", page) for i, page in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [r.text for r in html.extract(frame).orderBy("page_id").collect()]


MENU = '<div class="menu"><a href="/">Home</a> <a href="/m">Menu</a></div>'
FOOT = '<div class="footer">Copyright foot</div>'


def test_articles_of_long_pages(spark):
    body = " ".join(f"Sentence {k} of a long text goes on for some words." for k in range(60))
    pages = [f"<html><body>{MENU}<article>" + "".join(
        f"<p>Part {i} {k}. {body}</p>" for k in range(9)) + f"</article>{FOOT}</body></html>"
        for i in range(30)]
    assert min(map(len, pages)) > 23_000
    assert extracted(spark, pages) == [
        " ".join(f"Part {i} {k}. {body}" for k in range(9)) for i in range(30)]


def test_pages_without_article_elements(spark):
    text = "Real text of page {i}, which says something. It says it in two sentences."
    pages = [f'<html><body>{MENU}<div class="content"><p>{text.replace("{i}", str(i))}</p>'
             f"<p>And a second part.</p></div>{FOOT}</body></html>" for i in range(30)]
    assert extracted(spark, pages) == [
        f"{text.replace('{i}', str(i))} And a second part." for i in range(30)]


def test_one_page_and_formulas(spark):
    page = (f"{MENU}<article><p>Area is <math><mi>a</mi>=<mn>5</mn></math> here, as was said.</p>"
            f"<p>It is so.</p></article>{FOOT}")
    assert extracted(spark, [page]) == ["Area is a=5 here, as was said. It is so."]


def test_copies_of_a_page_count_once_in_training(spark):
    pages = spark.createDataFrame(
        [(1, "u", PAGE)] * 500, "page_id long, url string, html string")
    assert {r.text for r in html.extract(pages).collect()} == {TEXT}
