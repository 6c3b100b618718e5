"""Main text of pages: markup cases, host votes, and texts that must come through whole."""

import random
import time
from html.parser import HTMLParser

import pytest

from colloquy.llm import html_text as ht

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">x</a></li></ul></nav><div class="ad">Buy &amp; go.</div><div id="cookie-notice">We use cookies</div>
<article><h1>Head&shy;line &lt;1&gt;</h1>{body}<div class="share-buttons">Share</div><section class="comments"><article>Nice!</article></section></article>
<aside>More</aside><form><p>Mail</p><input value="x"></form><footer>&copy; host &middot; all</footer></body></html>"""


def page(body):
    return PAGE.format(body=body)


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<p>One  two\n three</p><p>Four</p>", ["One two three", "Four"]),
        ("<p><b>One.<br><p>Two <i>it</i>alic", ["One.", "Two italic"]),
        ("<p>a&nbsp;&#98;&#x63; &eacute; &amp;amp;</p>", ["a b" + "c é &amp;"]),
        ("<div><p>In <a href='q'>link</a> text</p></div>loose text", ["In link text", "loose text"]),
        ("<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table>", ["one", "two", "c1", "c2"]),
        ("<p>1 < 2 and 3 > 2</p><!-- no --><p>x<!-- y -->z</p>", ["1 < 2 and 3 > 2", "xz"]),
        ("<P CLASS='lead'>Up</P></div></span><p>Down", ["Up", "Down"]),
        ("<p>text<script>if (a<b) x()</script> goes on</p>", ["text goes on"]),
        ("<p style='display: none'>no</p><p>yes</p><p hidden>no</p>", ["yes"]),
    ],
)
def test_blocks(body, want):
    got = ht.extract(page(body)).split("\n\n")
    assert got == ["Head\u00adline <1>", *want]


def test_article_inside_a_layout_wrapper():
    assert ht.extract("<body><div class='with-sidebar'><article><p>Long enough text here.</p></article><div class='sidebar'><p>no</p></div></div>") == "Long enough text here."


def test_no_text():
    assert [ht.extract(x) for x in (None, "", "<nav>a</nav>", "<p> </p>", "<!-- open")] == [""] * 5
    assert ht.extract("just text") == "just text"


def test_long_page_is_taken_whole():
    body = "".join(f"<p>paragraph {i}</p>" for i in range(20_000))
    assert ht.extract(page(body)).count("\n\n") == 20_000


def test_hosts_vote(spark):
    text = "A sentence of the story, long enough to count. " * 3
    common = "<div class='story-12'><p>{}</p></div><div class='box'><p>{}</p></div>"
    rows = [(i, "http://h.test/a", common.format(text * 5, "Small box.")) for i in range(5)]
    # On this page the box is longer than the story: alone it would win.
    rows += [(9, "http://h.test/b", common.format("Short story.", text * 3)), (10, "http://other.test", common.format("Short story.", text * 3))]
    rows += [(11, None, None), (11, None, None), (12, "bad", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in ht.extract_text(df, ["page_id", "url"]).collect()}
    assert got[9].text == "Short story."
    assert got[10].text == text.strip() * 0 + " ".join((text * 3).split())
    assert (got[11].text, got[11].n_chars, got[12].text) == ("", 0, "x")
    assert ht.extract_text(df, ["page_id"]).count() == len(rows)
    assert ht.extract_text(df.limit(0), ["page_id"]).collect() == []


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="content no-sidebar"><p>Main text</p></div>', "Main text"),
        ('<div class="has-sidebar"><p>Main text</p><div class="sidebar">Side</div></div>', "Main text"),
        ('<form action="/x"><div><p>Body of a page.</p><p>More.</p><input value=1><select><option>o</select></div></form>', "Body of a page.\n\nMore."),
        ('<article><p>One</p><p class="notice-board">On the board</p><p class="notice">Notice!</p><p class="cookie-box">Cookies</p></article>', "One\n\nOn the board"),
        ("<div><p>" + "intro " * 30 + "</p><blockquote><p>" + "cited " * 70 + "</p></blockquote></div>", ("intro " * 30).strip() + "\n\n" + ("cited " * 70).strip()),
        ('<div class="sidebar-layout"><p>Main text</p></div><div class="sidebar">Side</div>', "Main text"),
        ('<div class="sidebar"><p>Side</p></div><section class="ad">Buy</section>', ""),
        ('<div><p>Short.</p></div><div class="comments"><p>' + "said " * 300 + "</p></div>", "Short."),
        ('<article><div class="share-price"><p>Up again.</p></div></article>', "Up again."),
        ('<article><section class="intro"><p>First half.</p></section><section class="related-work"><p>Other half.</p></section></article>', "First half.\n\nOther half."),
        ('<article><p>Text of it.</p><div class="related-posts"><p>Other posts here.</p></div><div class="share-this"><a href="x">Share on all networks</a></div></article>', "Text of it."),
        ('<article><p>Text of it.</p><div class="article-share"><p>Share this one.</p></div><div class="comment-thread"><p>Nice one, all.</p></div></article>', "Text of it."),
        ("<main><div><header><h1>Heading</h1></header><p>Text.</p></div></main>", "Heading\n\nText."),
        ('<p title=don"t>It is.</p><p data-x=\'a>b\' title="c>d">Two</p>', "It is.\n\nTwo"),
    ],
)
def test_wrappers_and_words(page, want):
    assert ht.extract(page) == want


@pytest.mark.parametrize(
    "page",
    ["<div>" * 100_000 + "x", '<a x=">" ' * 100_000, "<a x='>' y=\"" * 100_000 + ">", "<a " * 200_000, '<a "' * 200_000, '<a ="' * 100_000 + ">", "</section>" * 50_000, "<b>" * 50_000 + "<p>x</p>" * 10_000, "<i><div>" * 30_000 + "</b>" * 30_000, "<!-- " * 100_000, "<ul>" + "<li>x" * 30_000],
    ids=lambda p: p[:8],
)
def test_time_is_in_proportion(page):
    began = time.process_time()
    ht.extract(page)
    assert time.process_time() - began < 12


def test_plain_pages_equal_another_extractor():
    """Articles of plain blocks between dropped parts, against the standard library's parser."""

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.out, self.held = 0, [], ""

        def handle_starttag(self, tag, attrs):
            if tag in ("nav", "aside", "footer", "script") or ("class", "ad") in attrs:
                self.depth += 1
            elif tag in ("p", "h2", "li") and not self.depth:
                self.held = ""

        def handle_endtag(self, tag):
            if tag in ("nav", "aside", "footer", "script", "section"):
                self.depth -= 1
            elif tag in ("p", "h2", "li") and not self.depth and " ".join(self.held.split()):
                self.out.append(" ".join(self.held.split()))

        def handle_data(self, data):
            self.held += "" if self.depth else data

    r = random.Random(7)
    words = ["one", "caf&eacute;", "a &amp; b", "<b>bold</b>", "<a href='x>y'>link</a>", "&lt;tag&gt;", "x<br>y", "l\n  m", "&#x263A;"]
    line = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 25)))
    for _ in range(200):
        parts = []
        for _ in range(r.randint(2, 12)):
            kind = r.choice(["p", "p", "h2", "li", "nav", "aside", "script", "ad"])
            parts.append(f"<section class='ad'><p>{line()}</p></section>" if kind == "ad" else f"<script>if (a < b) x = '<p>no</p>'</script>" if kind == "script" else f"<{kind}><p>{line()}</p></{kind}>" if kind in ("nav", "aside") else f"<{kind}>{line()}</{kind}>")
        page = f"<html><body><nav><p>menu</p></nav><article>{''.join(parts)}</article><footer><p>foot</p></footer></body></html>"
        plain = Plain()
        plain.feed(page.replace("<br>", " "))
        plain.close()
        assert ht.extract(page) == "\n\n".join(plain.out)


def test_two_templates_of_a_host(spark):
    story = "A sentence of the story, long enough to count." * 9
    a = "<div class='story'><p>{}</p></div>"
    b = "<div class='story'><p>Teaser.</p></div><div class='report'><p>{}</p></div>"
    rows = [(i, "http://h.test/a", (a if i % 2 else b).format(f"{story} {i}")) for i in range(8)]
    got = {r.page_id: r.text for r in ht.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert got == {i: f"{story} {i}" for i in range(8)}


@pytest.mark.parametrize("chars", [100, 8_000, 9_000, 2_000_000])
def test_attributes_of_any_length(chars):
    assert ht.extract(f"<article><div data-state='{'<p>no</p>' * (chars // 9)}'><p>Text.</p></div></article>") == "Text."


def test_article_in_siblings_under_the_body():
    one, two = "First half of the story. " * 40, "The other half of it. " * 40
    for a, b in ((one, two), (two, one), (one, two[: len(two) // 2])):
        page = f"<body><div class='top'><a href='/'>Home</a></div><div class='lead'><p>{a}</p></div><div class='rest'><p>{b}</p></div><footer><p>{one * 3}</p></footer></body>"
        assert ht.extract(page) == f"{a.strip()}\n\n{b.strip()}"


def test_rare_template_of_a_host(spark):
    """One page of ten is of another template, and has the box that the others keep their story in."""
    story = "A sentence of the story, long enough to count. " * 40
    usual = "<body><div class='story'><p>{}</p></div></body>"
    rare = "<body><div class='story'><p>See also us.</p></div><div class='report'><p>{}</p></div></body>"
    rows = [(i, "http://h.test/a", (rare if i == 9 else usual).format(f"{story}{i}")) for i in range(10)]
    got = {r.page_id: r.text for r in ht.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert got == {i: f"{story}{i}" for i in range(10)}
