import html
import re

import pytest

from netshield.llm.html import extract, main_text
from netshield.llm.queries import op6_html

ARTICLE = "<h1>The title</h1><p>First paragraph, with <b>bold</b> and <a href='/x'>a link</a>; it is long enough.<p>Oh.</p>"
WANT = "The title\nFirst paragraph, with bold and a link; it is long enough.\nOh."
AROUND = [
    "<html><head><title>T</title><style>p{}</style><script>var a='</p>'</script></head><body>{}</body></html>",
    "<body><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><main>{}</main><footer>&copy; 2020, all.</footer>",
    "<div id=header>Site name. Slogan, here.</div><article>{}</article><section class='comments'><p>I agree, a lot. Really, very much so.</p></section>",
    "<aside>Aside, text.</aside><div class=page><div class='ad-box'>Buy now, cheap!</div>{}</div><form><p>Name</p><input></form>",
    "<div class='cookie-notice'>We use cookies, sorry.</div><div class='content has-sidebar'>{}</div><!-- <p>hidden</p> -->",
    "<p hidden>secret</p><div><div><div>{}</div></div></div><div role=navigation>More, here.</div>",
    "<ul><li><a href=1>Home page of it</a></li><li><a href=2>Another page</a></li></ul><div>{}</div>",
]


@pytest.mark.parametrize("around", AROUND)
def test_article_only(around):
    assert main_text(around.replace("{}", ARTICLE)) == WANT


def test_blocks():
    assert main_text("") == "" and main_text("plain &amp; simple") == "plain & simple"
    assert main_text("<p>a\n\t b&nbsp;c<br>d</p><p></p><p>e&#233;&lt;x&gt;</p>") == "a b c d\neé<x>"
    assert main_text("1 < 2 <p>x<") == "1 < 2\nx<"
    assert main_text("<ul><li>one, a<li>two, b</ul><table><tr><td>three, c<td>d</table>") == "one, a\ntwo, b\nthree, c\nd"
    assert main_text("<main><div><p>" + "long, " * 50 + "</p></div><div><p>Short</p></div></main>").endswith("\nShort")
    assert main_text("<article><p>Kept.</p><p>Cut <b class='x") == "Kept.\nCut"


def test_strange_pages():
    assert main_text("<div>" * 20000 + "deep" + "</div>" * 20000) == "deep"
    assert main_text("<a href=\"" * 3000 + "x") is not None
    assert len(main_text("<p>" + "word, " * 200000)) == 6 * 200000 - 1
    assert main_text("</p></div></b>x<b></p>y") == "x\ny"
    assert main_text("<script>never closed <p>x") == ""


def test_table(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "<p>One, two.</p>", "t"), (2, "<p>One, two.</p>", "t"), (None, "", "t")],
                               "page_id long, html string, text string")
    rows = sorted((tuple(r) for r in extract(df).select("page_id", "text", "n_chars").collect()), key=repr)
    assert rows == sorted([(1, "", 0), (2, "One, two.", 9), (2, "One, two.", 9), (None, "", 0)], key=repr)
    assert extract(df.limit(0)).collect() == []


def test_query(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op6_html(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|<footer|$)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split())
                  for b in re.split(r"</?(?:p|h1|h2|ul|ol|li|blockquote|div|pre)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


WORDS = "Some words, that are here; and more of them. "


@pytest.mark.parametrize("page, want", [
    # title and lead beside the body's div
    ("<body><div class=page><h1>The title</h1><p>{lead}</p><div class=text><p>{long}</p><p>{long}</p></div></div></body>",
     "The title\n{lead}\n{long}\n{long}"),
    ("<body><nav>Menu, here.</nav><div><h1>The title</h1></div><div><p>{lead}</p></div><div><p>{long}</p><p>{long}</p></div></body>",
     "The title\n{lead}\n{long}\n{long}"),
    # a section of 85 % beside one of 15 %
    ("<div class=page><section><h2>One</h2><p>{long}</p><p>{long}</p></section><div><h2>Two</h2><p>{lead}</p></div></div>",
     "One\n{long}\n{long}\nTwo\n{lead}"),
])
def test_content_outside_the_largest_element(page, want):
    parts = {"lead": (WORDS * 4).strip(), "long": (WORDS * 11).strip()}
    assert main_text(page.format(**parts)) == want.format(**parts)


def test_links_in_the_article():
    text = (WORDS * 10).strip()
    article = ("<h1><a href=/t>Title, linked</a></h1><p>" + text + "</p><h2><a href=/s>Sources</a></h2>"
               "<ul><li><a href=1>Source one</a><li><a href=2>Source two</a></ul>")
    want = f"Title, linked\n{text}\nSources\nSource one\nSource two"
    menus = "<nav><a href=1>Home</a></nav><ul class=menu><li><a href=2>Menu</a></ul><div role=navigation><a href=3>More</a></div>"
    outside = "<ul><li><a href=4>Elsewhere</a></ul>"
    assert main_text(f"<body>{menus}<article>{menus}{article}</article>{outside}</body>") == want
    assert main_text(f"<body>{menus}{outside}<div>{menus}{article}</div></body>") == want
    assert main_text("<article><ul><li><a href=1>Source one</a><li><a href=2>Source two</a></ul></article>") == "Source one\nSource two"
    assert main_text("<ul><li><a href=1>Home page of it</a></li><li><a href=2>Another page</a></li></ul>") == ""


LONG = (WORDS * 10).strip()


@pytest.mark.parametrize("page, want", [
    # words of furniture on elements around the page or the article
    ("<body><div class='layout sidebar-right'><p>{long}</p></div></body>", "{long}"),
    ("<body><div id=page class=menu-open><nav>Menu.</nav><article><h1>Title</h1><p>{long}</p></article></div></body>", "Title\n{long}"),
    ("<article class='post ad-free'><p>{long}</p></article>", "{long}"),
    ("<article class='category-social-studies'><h1>Title</h1><p>{long}</p></article>", "Title\n{long}"),
    ("<div class=post-header><h1>Title</h1></div><div><p>{long}</p></div>", "Title\n{long}"),
    ("<form id=aspnetForm action=x><div><h1>Title</h1><p>{long}</p><input></div></form>", "Title\n{long}"),
    ("<article><header><h1>Title</h1></header><p>{long}</p></article>", "Title\n{long}"),
    ("<div class='site-header'>Slogan, of a site.</div><div><h1>Title</h1><p>{long}</p></div>", "Title\n{long}"),
    # a menu that nothing marks, before and after the text
    ("<ul><li><a href=1>Home</a><li><a href=2>About us</a></ul><p>{long}</p><p>{long}</p>", "{long}\n{long}"),
    ("<div><p>{long}</p><p>{long}</p><ul><li><a href=1>Terms</a><li><a href=2>Contact us</a></ul></div>", "{long}\n{long}"),
    ("<div><p>{long}</p><ul><li><a href=1>A link</a></ul><p>{long}</p><h2>Sources</h2><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div>",
     "{long}\nA link\n{long}\nSources\nOne\nTwo"),
    # comments go even where they are longer, and articles among them protect nothing
    ("<div class=wrap><h1>Title</h1><p>{long}</p></div><div id=comments class=comments-area><article id=comment-1 class=comment-body>"
     "<p>{long} {long}</p><p>{long} {long}</p></article></div>", "Title\n{long}"),
    # furniture inside an element around the page still goes
    ("<div class='layout sidebar-right'><p>{long}</p><div class=sidebar>Side, here.</div><footer>Foot.</footer></div>", "{long}"),
    ("<div class='promo-box'><h1>Title</h1><p>Buy it.</p></div><div><p>{long}</p></div>", "Title\n{long}"),
])
def test_words_of_furniture(page, want):
    assert main_text(page.replace("{long}", LONG)) == want.replace("{long}", LONG)


def test_tokens():
    from netshield.llm.html import _kind_of_token

    for token in ("ad", "cookie-notice", "ad-box", "siteHeader", "comment_list", "sidebar-right", "related-posts", "footer2"):
        assert _kind_of_token(token), token
    for token in ("ad-free", "menu-open", "has-sidebar", "post-header", "category-social-studies", "article", "adult", ""):
        assert not _kind_of_token(token), token


def test_many_nested_wrappers_are_linear():
    page = "<div class=sidebar>" * 20_000 + "<p>" + LONG + "</p>" + "</div>" * 20_000
    assert main_text(page) == LONG
