import random
import time

import pytest

from talktree.llm.html_text import extract_pages, main_text

ARTICLE = "<h1>Title &amp; more</h1><p>First paragraph, with some words, commas, and enough length to count.</p><p>Second &quot;paragraph&quot;,   also\n long enough to be kept.</p>"
TEXT = 'Title & more\nFirst paragraph, with some words, commas, and enough length to count.\nSecond "paragraph", also long enough to be kept.'
NAV = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>News</a></li></ul></nav>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<html><body>{NAV}<article>{ARTICLE}</article><footer>&copy; foot</footer></body></html>", TEXT),
        (f"<body><div class='ad'>Buy this, now, it is a very long advert with commas, more than the article has, really.</div><article>{ARTICLE}</article>", TEXT),
        (f"<body><header><h1>Site</h1></header><div id=content>{ARTICLE}</div><div class='sidebar'><p>Related, links, and other things that are long enough.</p></div>", TEXT),
        (f"<article>{ARTICLE}<section class='comments'><p>A reader says something long, with commas, about it all.</p></section><form><p>Subscribe, please, with your address here.</p></form></article>", TEXT),
        (f"<script>var t='</p><p>x';</script><style>p{{}}</style><!-- <p>hidden</p> --><main>{ARTICLE}</main>", TEXT),
        (f"<div class='cookie-notice'><p>We use cookies, as everybody does, for a lot of reasons.</p></div><main>{ARTICLE}</main>", TEXT),
        (f"<main>{ARTICLE}<p hidden>secret, long, hidden text that nobody should see here</p><p style='display: none'>also, hidden, text that is long enough</p></main>", TEXT),
        (f"<ARTICLE>{ARTICLE.replace('<p>', '<P><b>').replace('</p>', '<br>')}", TEXT),
        (f"<div id='page-header'><p>Site name, with a slogan, that is long enough to count</p></div><div class='post'><div class='post-header'><h1>Title &amp; more</h1></div>{ARTICLE[25:]}</div>", TEXT),
        (f"<main>{ARTICLE}<ins class='adsbygoogle'><p>Buy, buy, and buy again, for it is cheap and good.</p></ins></main>", TEXT),
        ("<article><p>Cut off in the mid", "Cut off in the mid"),
        ("<article><p>Cut off &am", "Cut off &am"),
        ("<article><p>Cut off <b", "Cut off"),
        ("<p>one<p>two", "one\ntwo"),
        ("<body>bare text only</body>", "bare text only"),
        ("<div>a < b and c</div>", "a < b and c"),
        ("<article><p>&#233;&#x1F600;&nbsp;x</p></article>", "é😀 x"),
        ("<table><tr><td>cell one<td>cell two</table>", "cell one\ncell two"),
        ("<nav>only a menu</nav>", ""), ("", ""), (None, ""), ("<script>x</script>", ""), ("<<<>>>", "<<<>>>"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_container_with_its_siblings():
    part = "<p>" + "Long sentence, with commas, that goes on and on. " * 6 + "</p>"
    page = f"<body>{NAV}<div><div>{part * 3}</div><div>{part * 2}</div><div><a href=1>link text that is long enough to count</a></div></div></body>"
    assert main_text(page).count("\n") == 4 and "link text" not in main_text(page)


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + "deep text") == "deep text"
    long = "<article>" + "<p>word, " * 20000
    assert main_text(long).count("\n") == 19999


def test_table(spark):
    df = spark.createDataFrame([(1, "u", f"<article>{ARTICLE}</article>", "x"), (None, None, None, "x"), (1, "u", "", "x")], "page_id long, url string, html string, text string")
    rows = extract_pages(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in rows) == [(0, 0), (1, 0), (1, len(TEXT))] and rows[0].url == "u"
    assert extract_pages(df.where("false")).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{NAV}<div class='content has-sidebar'>{ARTICLE}</div></body>",
        f"<body>{NAV}<h2>Stray</h2><div class='post share-enabled'>{ARTICLE}</div></body>",
        f"<body><form id='aspnetForm'>{NAV}<div><div>{ARTICLE}</div></div><fieldset><p>Search, for something, in all of this site</p></fieldset></form></body>",
        f"<body><form>{NAV}<article>{ARTICLE}</article><div class='comments'><p>{'A reader says something long, with commas. ' * 20}</p></div></form></body>",
        f"<body><div class='content no-comments'>{ARTICLE}</div><div class='comments'><p>A reader says something, with commas.</p></div></body>",
    ],
)
def test_main_text_is_not_cut_with_its_container(page):
    assert main_text(page).removeprefix("Stray\n") == TEXT


def test_smaller_siblings_stay():
    part = "<p>" + "Long sentence, with commas, that goes on and on. " * 3 + "</p>"
    assert main_text(f"<body>{NAV}<div>{part * 2}</div><div>{part}</div></body>").count("\n") == 2


P = "Long sentence, with commas, that goes on and on. " * 3


@pytest.mark.parametrize(
    "page, lines",
    [
        (f"<body>{NAV}<div><p>Short intro.</p><div class='x'><p>{P}</p><p>{P}</p></div><p>The end.</p></div></body>", ["Short intro.", P, P, "The end."]),
        (f"<body>{NAV}<div id=wrap><div><p>First part.</p></div><div><p>{P}</p><p>{P}</p></div><div><p>Last part.</p></div></div></body>", ["First part.", P, P, "Last part."]),
        (f"<body><form>{NAV}<div><h1>T</h1><p>{P}</p></div></form></body>", ["T", P]),
        (f"<body><div class='post'><h1>T</h1><div class='related-work'><p>{P}</p></div><div class='tags-explained'><p>{P}</p></div><div class='related'><p>Other, more, stories, and so on, and on</p></div></div></body>", ["T", P, P]),
        (f"<body><article><h1>T</h1><section class='share-prices'><p>{P}</p></section><p>ok</p><div class='user-comments'><p>{P}</p></div></article></body>", ["T", P, "ok"]),
        (f"<body><div><p>Intro</p>loose text<div><p>{P}</p></div></div><div class='sidebar'><p>{P}</p></div></body>", ["Intro", "loose text", P]),
    ],
)
def test_whole_article_stays(page, lines):
    assert main_text(page) == "\n".join(x.strip() for x in lines)


def test_generated_articles_come_back_whole():
    """Against the text that a page was made from: blocks of any length, in nested wrappers, with things beside them."""
    rng = random.Random(6)
    junk = [NAV, "<div class='ad'>Buy, now, cheap, things, that nobody needs at all</div>", "<div class='comments'><p>A reader says, at length, something about it all.</p></div>", "<footer>&copy; x</footer>", "<div class='newsletter-signup'><p>Sign up, for mail, every day, of the week.</p></div>"]
    for _ in range(300):
        blocks = [" ".join(rng.choice(["some", "words,", "go", "on.", "é"]) + str(k) for k in range(rng.choice([1, 3, 20, 60]))) for _ in range(rng.randint(2, 9))]
        blocks.append(" ".join(f"long{k}," for k in range(60)))
        tags = [rng.choice(["p", "p", "div", "li", "blockquote", "h2", "pre"]) for _ in blocks]
        inner = "".join(f"<{t}>{b}</{t}>" for t, b in zip(tags, blocks))
        for wrap in rng.choice([["article"], ["main", "div"], ["div class='post'"], ["article", "section"], ["div class='entry-content'", "div"]]):
            inner = f"<{wrap}>{inner}</{wrap.split()[0]}>"
        page = f"<html><body>{''.join(rng.sample(junk, 2))}{inner}{''.join(rng.sample(junk, 2))}</body></html>"
        assert main_text(page) == "\n".join(blocks), page


@pytest.mark.parametrize("name", ["tags-explained", "copyright-history", "social-history", "notice-period", "menu-planning"])
@pytest.mark.parametrize("tag", ["div", "section"])
@pytest.mark.parametrize("length", [1, 20])
def test_short_sections_with_mild_words_stay(name, tag, length):
    part = "A short one. " * length
    page = f"<body>{NAV}<article><h1>T</h1><p>{P}</p><{tag} class='{name}'><p>{part}</p></{tag}><{tag} class='{name.split('-')[0]}-links'><a href=x>one</a> two</{tag}></article></body>"
    assert main_text(page) == "\n".join(["T", P.strip(), part.strip()])


@pytest.mark.parametrize("box", ["article", "main", "div", "div class='post'"])
def test_headings_right_before_the_container_stay(box):
    page = f"<body>{NAV}<h1>The title</h1><h2>What it says</h2><{box}><p>{P}</p><p>{P}</p></{box.split()[0]}><footer>x</footer></body>"
    assert main_text(page) == "\n".join(["The title", "What it says", P.strip(), P.strip()])
    page = f"<body><h1><a href='/'>Site</a></h1>{NAV}<{box}><p>{P}</p><p>{P}</p></{box.split()[0]}></body>"
    assert "Site" not in main_text(page) or box.startswith("div")


def test_comments_are_known_by_their_shape():
    one = "<div class='x'><span class='author'>Ann</span> <time>May 5</time><p>I think so too, and more than that, for it is true and long enough to count.</p><a href='#r'>Reply</a></div>"
    old = "<li><div class='meta'>Bo, 3 May</div><p>No, not at all, I say, and I say it at some length so that it may count.</p><p><a href='#'>Antworten</a></p></li>"
    for block in (f"<section class='reader-feedback'><h3>What readers say</h3>{one * 3}</section>", f"<div class='voices'>{one}</div>", f"<ol class='thread'>{old * 5}</ol>"):
        for page in (f"<body><article><h1>T</h1><p>{P}</p></article>{block}</body>", f"<body><div class='post'><h1>T</h1><p>{P}</p></div>{block}</body>", f"<body><article><h1>T</h1><p>{P}</p>{block}</article></body>"):
            assert main_text(page) == f"T\n{P.strip()}"
    by = f"<body><article><div class='byline'>By Ann</div><p>{P} She gave no <a href=x>reply</a> to it.</p><p>{P}</p></article></body>"
    assert main_text(by).count("\n") == 2


def test_broken_markup_takes_linear_time():
    for page in ("<b>" * 100_000 + "</i>" * 100_000 + "text", "<div>" * 50_000 + "<b>" * 50_000 + "</i>" * 100_000 + "text", "<p><b>" * 60_000 + "text", "<table><tr><td>" * 30_000 + "</b></p>" * 30_000 + "text"):
        began = time.process_time()
        assert main_text(page) == "text"
        assert time.process_time() - began < 5
