from __future__ import annotations

import html
import re
import time

from foliant.llm.extract import BONUS, SURGE, WINDOW, extract_text, main_text, op10_html_extraction

LONG = "These are plain words of an article. " * 5


def test_article_with_furniture():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a href='/'>Home</a></nav><div class='cookie-notice'>We use cookies on this site</div>"
        f"<article><header>By someone</header><h1>The&nbsp;Title</h1><p>First <b>par</b>agraph.<br>Second&amp;line.<p>{LONG}<aside>Related stories</aside>"
        "<div class='ad'>Buy now</div><p>After the advert.</p><form>Name: <input></form><script>var t='</p>';</script></article>"
        "<section id='comments'><p>Great post, thanks a lot for writing it all down!</p></section><footer>(c) us</footer></body></html>"
    )
    assert main_text(page) == f"The Title First paragraph. Second&line. {LONG.strip()} After the advert."


def test_page_without_article():
    page = f"<div id=menu><a>A</a> <a>B</a></div><div><h2>Head</h2><p>{LONG}</p><p>Short.</p></div><ul class='sidebar'><li>x</li></ul><p></p><p></p><p></p><p></p><p>tail</p>"
    assert main_text(page) == f"Head {LONG.strip()} Short."


def test_short_blocks_and_text_after_adverts_are_kept():
    assert main_text(f"<p>{LONG}</p><div class=ad><p>x</p></div><p>After the advert.</p>") == f"{LONG.strip()} After the advert."
    poem = [f"line {i} is" for i in range(20)]
    assert main_text("".join(f"<p>{x}</p>\n" for x in poem)) == " ".join(poem)
    assert main_text("<ul>" + "".join(f"<li>{x}</li>" for x in poem) + "</ul>") == " ".join(poem)
    assert main_text("<p>too short</p>") == ""


def test_a_body_outside_an_article_card_is_kept():
    card = "<article class='card'><a href='/x'>Another story</a></article>"
    assert main_text(f"<div><p>{LONG}</p><p>Short.</p></div>{card}") == f"{LONG.strip()} Short. Another story"
    assert main_text(f"{card}<div>{LONG}</div>") == f"Another story {LONG.strip()}"
    # The bonus: little text is enough in an article and not outside of it.
    assert main_text("<p>Outside.</p><main><p>In it.</p></main><p>Outside.</p>") == "In it."


def test_page_wrappers_are_no_furniture():
    for page in (
        f"<body class='single no-sidebar'><p>{LONG}</p></body>",
        f"<div class='layout with-sidebar'><p>{LONG}</p></div>",
        f"<main class='has-nav'><p>{LONG}</p></main>",
        f"<article class='post no-comments'><p>{LONG}</p></article>",
        f"<article class='nav' id='comments'><p>{LONG}</p></article>",
        f"<form action='/'><nav><a>Home</a></nav><p>{LONG}</p><footer>(c) us</footer></form>",
        f"<div id='content-sidebar-wrap'><h1></h1><article><p>{LONG}</p></article><aside>Related stories</aside></div>",
    ):
        assert main_text(page) == LONG.strip(), page
    # Readers' comments are furniture, however long, and so is a notice alone.
    assert main_text(f"<div><p>{LONG}</p></div><div id='comments'><h2>Two</h2><p>{LONG * 3}</p></div>") == LONG.strip()
    assert main_text(f"<div class='cookie-notice'>{LONG}</div>") == ""


def test_troubles():
    assert main_text(None) == "" and main_text("") == "" and main_text("<p>") == ""
    assert main_text("<article>a < b and <!-- never closed") == "a < b and"
    assert main_text(f"<article>{LONG}<script>unclosed") == LONG.strip()
    assert main_text("<article><p title='a>b'>x</p></article>") == "x"
    assert main_text("<ARTICLE>É&eacute;<BR/>2</ARTICLE>") == "Éé 2"


def test_linear_time():
    began = time.time()
    for piece in ("<div>", "<!--", "<script>", "<p title='", "</div>", "<", "&amp;", "x "):
        main_text("<article>" + piece * 60_000)
    assert time.time() - began < 30


def test_whole_table_equals_its_articles(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    found = {r["page_id"]: r for r in op10_html_extraction(spark, small).collect()}
    for page in pages:
        body = re.search("<article>(.*)</article>", page["html"], re.S)[1]
        text = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", body))).split())
        assert (found[page["page_id"]]["text"], found[page["page_id"]]["n_chars"]) == (text, len(text))


def test_null_rows(spark):
    frame = spark.createDataFrame([(1, None, "t"), (None, "<article>x</article>", "t"), (1, None, "t")], "page_id long, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in extract_text(frame, "html", "page_id").collect()) == [(0, "x", 1), (1, "", 0), (1, "", 0)]
    assert extract_text(frame.limit(0), "html", "page_id").isEmpty()


def test_surges_decide_inside_marked_articles_too():
    empty = "<div></div>" * (WINDOW + 3)
    page = f"<article><p>{'long text ' * 9}</p><p>near</p>{empty}<p>far</p>{empty}<p>far, but long enough</p></article>"
    body = ("long text " * 9).strip()
    assert main_text(page) == f"{body} near far, but long enough"
    assert main_text(page, window=50) == f"{body} near far far, but long enough"
    assert main_text(page, surge=SURGE + 40) == f"{body} near"
    assert main_text(page, bonus=0) == f"{body} near"
    # An article of a few characters is still the page's text; the same outside is none.
    assert main_text("<body><article><p>Hi</p></article></body>") == "Hi" and main_text("<body><div>Hi</div></body>") == ""
    assert BONUS < SURGE
