"""Main text of pages."""

from llm_cases import table

from forecourt.llm import html_extract, queries
from forecourt.llm.html_extract import main_text

PROSE = "This is the article that we want to have, and it is one of those that are of use to all of us for what is in them."


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_query_gives_the_articles(spark):
    import html
    import re

    rows = {r["page_id"]: r for r in queries.op3_html(spark, "/root/testdata/sf0.001").collect()}
    pages = table("pages")
    assert len(rows) == len(pages)
    for p in pages:
        inside = re.search(r"<article>(.*?)</article>", p["html"], re.S)
        plain = re.sub(r"</?(?:b|i|em)>", "", inside[1])
        expected = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", plain)).split())
        got = rows[p["page_id"]]
        assert " ".join(got["text"].split()) == expected and got["n_chars"] == len(got["text"]) and got["url"] == p["url"]


def test_everything_around_an_article_goes():
    around = [
        "<nav><ul><li><a href=/x>Menu of the site</a></li></ul></nav>",
        f"<header><p>{PROSE} header</p></header>",
        f"<aside><p>{PROSE} aside</p></aside>",
        f'<div class="cookie-notice"><p>{PROSE} cookies</p></div>',
        f'<div id="ad-slot" class="adsbygoogle">{PROSE} advert</div>',
        f"<form><label>{PROSE} form</label><input name=q></form>",
        f"<script>var x = '<p>{PROSE} script</p>';</script>",
        "<style>p > a { color: red }</style>",
        f"<!-- <p>{PROSE} comment</p> -->",
        f'<section class="comments"><p>{PROSE} reader</p></section>',
        f"<footer>&copy; {PROSE} footer</footer>",
        f"<noscript><p>{PROSE} noscript</p></noscript>",
    ]
    half = len(around) // 2
    article = f"<h1>Head</h1><p>{PROSE}</p><p>Short &amp; sweet.</p>"
    expected = f"Head\n{PROSE}\nShort & sweet."
    for holder in ("<article>%s</article>", "<main>%s</main>", "<div id=content>%s</div>"):
        assert main_text(page("".join(around[:half]) + holder % article + "".join(around[half:]))) == expected


def test_comments_inside_an_article_go():
    body = f'<article><p>{PROSE}</p><div class="comment-list"><p>{PROSE} I say.</p></div></article>'
    assert main_text(page(body)) == PROSE


def test_blocks_and_white_space():
    assert main_text(page(f"<article><p>{PROSE}\n\t&nbsp; two<br>three <b>b</b>old<p>next</article>")) == f"{PROSE} two three bold\nnext"
    assert main_text(page("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>")) == "one\ntwo\na\nb"
    assert main_text(page("<article><p>&lt;p&gt; &#233;&#x1F600; &xyzzy;</p></article>")) == "<p> é😀 &xyzzy;"


def test_broken_markup():
    assert main_text(f"<article><p>{PROSE}") == PROSE
    assert main_text(page(f"<nav><a href=x>menu</a><article><p>{PROSE}</p></article>")) == PROSE
    assert main_text(page(f'<article><p>{PROSE}</p><a href="x>never closed')) .startswith(PROSE)
    assert main_text(page(f"<article><p>{PROSE} 1 < 2 and 3 > 2</p></article>")) == f"{PROSE} 1 < 2 and 3 > 2"
    assert main_text("<!-- never closed <article><p>x</p></article>") == ""
    assert main_text("") == "" and main_text("<html></html>") == ""
    main_text("<" * 5000 + "a" + '"' * 5000)


def test_second_pass_inherits_from_the_nearest():
    short = lambda n: html_extract.Block(f"short {n}", 0, False, False, 0)
    found = [short(i) for i in range(6)]
    labels = [True, None, None, None, False, None]
    assert html_extract.second_pass(found, labels) == [True, True, True, False, False, False]


def test_link_lists_are_bad_and_prose_is_good():
    links = "".join(f'<p><a href="/{i}">A link with a long text of the kind that is in a list {i} of them all</a></p>' for i in range(5))
    assert main_text(page(f"<div>{links}</div><div><p>{PROSE}</p></div>")) == PROSE


def test_text_outside_of_teaser_articles():
    cards = "".join(f'<article><h3><a href="/{i}">Another story {i}</a></h3><p>A teaser.</p></article>' for i in range(4))
    text = f"<h1>Head</h1><p>{PROSE}</p><p>{PROSE} More.</p><p>Short.</p>"
    expected = f"Head\n{PROSE}\n{PROSE} More.\nShort."
    for body in (f"<div>{text}</div>{cards}", f"{cards}<div>{text}</div>", f"<article>{text}</article>{cards}"):
        assert main_text(page(body)) == expected


def test_text_of_which_an_article_holds_a_part():
    rest = "".join(f"<p>{PROSE} Part {i}.</p>" for i in range(3))
    expected = "\n".join([PROSE, *(f"{PROSE} Part {i}." for i in range(3))])
    assert main_text(page(f"<article><p>{PROSE}</p></article><div>{rest}</div>")) == expected


def test_an_article_with_most_of_the_text_wins():
    article = "".join(f"<p>{PROSE} Part {i}.</p>" for i in range(4))
    expected = "\n".join(f"{PROSE} Part {i}." for i in range(4))
    assert main_text(page(f"<div><p>{PROSE}</p></div><article>{article}</article><p>Short.</p>")) == expected


def test_linked_titles_and_paragraphs_of_an_article():
    article = f'<h1><a href="/x">The title</a></h1><p>{PROSE}</p><p><a href="/y">The report.</a></p><p>{PROSE}</p>'
    expected = f"The title\n{PROSE}\nThe report.\n{PROSE}"
    assert main_text(page(f"<article>{article}</article>")) == expected
    links = "".join(f'<li><a href="/{i}">Story {i}</a>' for i in range(5))
    assert main_text(page(f"<article>{article}<ul>{links}</ul></article>")) == expected
    assert main_text(page(f'<div><h1><a href="/x">The title</a></h1><p>{PROSE}</p></div>')) == f"The title\n{PROSE}"


def test_languages_without_stop_words():
    russian = "Сегодня утром в городе открылась новая библиотека, в которой собрано более ста тысяч книг на разных языках мира."
    chinese = "今天上午，市中心的新图书馆正式向公众开放，馆内收藏了超过十万册不同语言的图书，吸引了许多读者前来参观。"
    italian = "Questa mattina è stata inaugurata nel centro della città una nuova biblioteca che raccoglie oltre centomila volumi."
    for words in (russian, chinese, italian):
        for times in (1, 3):
            text = " ".join([words] * times)
            menu = "".join(f'<li><a href="/{i}">{words[:20]}</a>' for i in range(6))
            body = f"<ul>{menu}</ul><div><h1>{words[:12]}</h1><p>{text}</p><p>{text}</p></div><ul>{menu}</ul>"
            assert main_text(page(body)) == "\n".join([words[:12].strip(), text, text])
    # English words around do not make a page English.
    notice = f"<p>{PROSE}</p>"
    assert russian in main_text(page(notice + f"<p>{russian}</p>" * 5))
    # In a known language, long blocks without stop words are no text.
    names = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda Omicron Rho Sigma Tau"
    assert main_text(page(f"<p>{PROSE}</p><p>{PROSE}</p><p>{names}</p><p>{PROSE}</p>")) == "\n".join([PROSE] * 3)


def test_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, page(f"<article><p>{PROSE}</p></article>")), (2, "v", "x " * 200_000)]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id bigint, url string, html string, text string")
    found = html_extract.extract(pages).collect()
    assert len(found) == 4
    assert [(r["text"], r["n_chars"]) for r in found if r["page_id"] == 1] == [("", 0)] * 2
    assert [r["text"] for r in found if r["page_id"] is None] == [PROSE]
    assert html_extract.extract(pages.limit(0)).count() == 0


NAMES = [
    "no-sidebar", "site has-sidebar", "with-nav", "page-header-fixed", "share-price-news", "commentary", "navy-history",
    "socialism", "cookie-recipes", "promoted",
]


def test_no_page_is_lost_to_the_name_of_its_wrapper():
    body = f"<h1>Head</h1><p>{PROSE}</p><p>{PROSE} More.</p>"
    margin = f'<div class="sidebar"><p>{PROSE[:80]}</p></div><nav><a href=x>menu</a></nav>'
    for name in NAMES:
        for inner in (body, f"<article>{body}</article>"):
            assert main_text(page(f'<div class="{name}">{inner}</div>{margin}')) == f"Head\n{PROSE}\n{PROSE} More.", name


def test_long_comments_and_margins_of_an_article_still_go():
    article = f"<article><p>{PROSE}</p></article>"
    for name in ("comments", "comment-list", "disqus", "advert"):
        assert main_text(page(f'{article}<div class="{name}">' + f"<p>{PROSE} I say.</p>" * 9 + "</div>")) == PROSE
    for name in ("sidebar", "related posts-list", "cookie-notice"):
        assert main_text(page(f'{article}<div class="{name}">' + f"<p>{PROSE} aside.</p>" * 9 + "</div>")) == PROSE


def test_broken_pages_take_linear_time():
    import time

    n = 100_000
    for broken in (
        "<a " * n, "<div>" * n + "</b>" * n, '<a b="' * n, '<a b="' * n + ">", '<a x=">"' * n + "'", "</1 " * n, "<head>" * n,
        "<span x>" * n + "<li>" * n, "<form>" * n + "<article>" * n, '<div class="menu">' * n, "<!" * n, "<p>" + "</p>" * n,
    ):
        start = time.time()
        main_text(broken)
        assert time.time() - start < 5, broken[:20]
    assert main_text("<article><p>" + PROSE + "</p></article>" + "<a " * n).startswith(PROSE)
