import pytest

from lodestar.llm.html import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, really, many of them, for everything.</p></div>
<div id="main-content"><h1>Headline &amp; more</h1>
<p>First  paragraph,
with <b>bold</b> and a <a href=x>link</a>, and commas, and so on to be long enough.</p>
<p>Second&nbsp;paragraph&#33; It has <br>a break, and is not short either, is it?
<ul><li>An item of the article<li>Another item</ul>
<form><p>Your name, please</p><input></form>
<blockquote>A quoted line, of someone.</blockquote></div>
<div class="sidebar"><p>Sidebar text, with commas, and more commas, and even more, of them.</p></div>
<div id="comments"><p>A reader writes, at length, that all of this, really, is wrong.</p></div>
<div class="ad">Buy, buy, buy.</div><footer>&copy; nobody</footer></body></html>"""


def test_page():
    assert extract(PAGE).split("\n") == [
        "Headline & more",
        "First paragraph, with bold and a link, and commas, and so on to be long enough.",
        "Second paragraph! It has a break, and is not short either, is it?",
        "An item of the article",
        "Another item",
        "A quoted line, of someone.",
    ]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("<html></html>", ""), ("just words", "just words"), ("a &lt; b", "a < b"), ("<p>a<p>b", "a\nb"),
        ("<p>a</p></div></div><p>b", "a\nb"), ("<script>x</script>", ""), ("<p>x</p><script>never closed", "x"), ("<!-- c -->t", "t"),
        ("<p>a<b>b<i>c</b>d</i>e</p>", "abcde"), ("<table><tr><td>a<td>b</table>", "a\nb"), ("&eacute;&#x41;&bogus;", "éA&bogus;"),
        ("<" * 50, "<" * 50), ("<p>  \n</p>", ""),
    ],
)
def test_odd_markup(html, text):
    assert extract(html) == text


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "<p>inside, of all</p>"
    assert extract(deep) == "inside, of all"
    paragraph = "<p>" + "many words, in a line, " * 20 + "</p>"
    assert len(extract(f"<article>{paragraph * 2000}</article>").split("\n")) == 2000


def test_link_lists_lose_against_text():
    links = "".join(f'<p><a href="{k}">a link, with some, commas, {k}</a></p>' for k in range(30))
    text = "<p>Real text, that goes on, for a while, and says something.</p>" * 3
    assert "link" not in extract(f"<div>{links}</div><div>{text}</div>")


LONG = "<p>Many words, in a line, that goes on, for long enough to win.</p>" * 10


@pytest.mark.parametrize(
    ("before", "after", "kept"),
    [
        ("<h1>Head</h1><p>Short lead.</p>", "<div><p>Short closing paragraph.</p></div>", ["Head", "Short lead.", "Short closing paragraph."]),
        ("", "<ul><li>Item</ul><pre>code</pre><blockquote>Quote</blockquote><h3>Part</h3>bare <b>text</b>", ["Item", "code", "Quote", "Part", "bare text"]),
        ("<div><div>Deep lead</div></div>", "<table><tr><td>1<td>2</table>", ["Deep lead", "1", "2"]),
        ("<h1><a href=x>Linked head</a></h1>", "<p>See <a href=y>this</a>, or something else.</p>", ["Linked head", "See this, or something else."]),
        ("<a href=a>Home</a> | <a href=b>News</a><hr>", "<div><ul><li><a href=c>More news, of the day</a></ul><p>By me</p></div>", ["By me"]),
        ("<div class=sidebar>beside</div>", "<a href=x><div>A card that is a link</div></a><nav>n</nav>", []),
    ],
)
def test_blocks_around_the_best_container(before, after, kept):
    inner = f"<div class='entry-content'>{LONG}</div>"
    for page in (f"<article>{before}{inner}{after}</article>", f"{before}<span>{inner}</span>{after}"):
        lines = extract(page).split("\n")
        assert [x for x in lines if not x.startswith("Many")] == kept and len(lines) == 10 + len(kept)


@pytest.mark.parametrize("name", ["comment-body", "footer-text", "ad-content", "sidebar-main", "nav-text other"])
def test_boilerplate_wins_within_a_name(name):
    assert extract(f"<div class='post-content'>{LONG}</div><div class='{name}'><p>Not a part, of the article.</p></div>").split("\n") == extract(LONG).split("\n")


def test_a_name_of_the_layout_does_not_hide_the_article():
    assert extract(f"<div class='main-content with-sidebar'>{LONG}</div>").split("\n") == extract(LONG).split("\n")


def test_unclassed_wrappers_of_one_paragraph():
    short = [f"Paragraph {k}." for k in range(5)]
    page = "".join(f"<div><p>{t}</p></div>" for t in short)
    assert extract(f"<main>{page}<div>{LONG}</div></main>").split("\n")[:5] == short


def test_table(spark):
    pages = [(1, "u", PAGE), (2, None, None), (2, "v", ""), (None, "w", "<p>x"), (3, "u", PAGE)]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id bigint, url string, html string, text string, n_chars int")
    got = main_text(df).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"], len(r["text"])) for r in got) == sorted(
        (p or 0, len(extract(h)), len(extract(h))) for p, _, h in pages
    )
    assert main_text(df.where("false")).count() == 0
    assert main_text(df).where("page_id = 2").count() == 2
