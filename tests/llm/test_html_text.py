import random
import time

import pytest

from emberfield.llm.html_text import extract_text, main_text

PROSE = "A first sentence, with commas, that is long enough to count as prose. And more of it, to be sure."


def test_article_without_the_rest():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var a="</p>";</script></head><body>
    <header><h1>Site name</h1></header><nav><ul><li><a href=/a>Menu entry</a></li></ul></nav><!-- x > y --><div class="ad">Buy, buy, buy it now, today, here.</div>
    <div id=cookie-notice>We use cookies, and more cookies, for all of it.</div>
    <article><h1>Title &amp; more</h1><p><b>One   <i>two</i>,<br>three.<p>{PROSE}</p><ul><li>item</ul>
    <aside>Side, side, side, side, side, side text.</aside><div class="share">Share</div>
    <section id="comments"><p>I, as a reader, think, that this is nonsense, really.</p></section></article>
    <form><input><p>Type here, or here, or there, please, now.</p></form><footer>&copy; someone, somewhere, 2020, all rights.</footer></body></html>"""
    assert main_text(page) == f"Title & more\n\nOne two, three.\n\n{PROSE}\n\nitem"


def test_scoring_finds_the_container_without_article():
    links = "".join(f'<a href="/{i}">Some linked headline, number {i}, to click</a> ' for i in range(30))
    page = f"<body><div><div>{links}</div></div><div id=x><div><p>{PROSE}<p>{PROSE} Again.</div><p>{PROSE} Sibling.</p><div><a href=/>next, page, of, many, many, many things</a></div></div></body>"
    assert main_text(page) == f"{PROSE}\n\n{PROSE} Again.\n\n{PROSE} Sibling."


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<script>x") == ""
    assert main_text("a < b &lt; c") == "a < b < c"
    assert main_text("<div" * 3000) is not None
    assert main_text("<div>" * 30000 + PROSE) == PROSE
    assert main_text("<p title='a>b'>" + PROSE + "<p class=\"x>" + PROSE)
    assert main_text("<body><article><p>Short.</p></article><footer>No</footer>") == "Short."
    assert len(main_text("<article><p>" + PROSE * 20000)) > 1_000_000


def test_table(spark):
    rows = [(1, "u", f"<p>{PROSE}é</p>", "x"), (1, "u", None, "x"), (None, None, "", "x")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [tuple(r) for r in got] == [(1, "u", PROSE + "é", len(PROSE) + 1), (1, "u", "", 0), (None, None, "", 0)]
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("name", ["post-comments", "comments content", "sidebar-content", "main-sidebar", "entry-footer", "post footer", "content-menu", "main-nav", "entry-share", "story-related", "newsletter body", "article-ad"])
def test_parts_with_names_of_both_kinds_go(name):
    part = f'<div class="{name}"><p>{PROSE} Not this one, though.</p><p>{PROSE} Nor, of course, that one.</p></div>'
    assert main_text(f"<body><article><h1>T</h1><p>{PROSE}</p>{part}<p>{PROSE} End.</p></article></body>") == f"T\n\n{PROSE}\n\n{PROSE} End."
    assert main_text(f'<body><div id="main"><p>{PROSE}</p><p>{PROSE} End.</p></div>{part}</body>') == f"{PROSE}\n\n{PROSE} End."


def test_names_of_the_page_around_stay():
    for name in ("page has-sidebar", "content with-comments", "no-footer", "layout-sidebar-right main"):
        assert main_text(f'<body class="{name}"><div class="{name}"><div class="entry-header"><h1>T</h1></div><p>{PROSE}</p></div></body>') == f"T\n\n{PROSE}"


def test_siblings():
    short = "A short one, but prose it is, as one can see."
    articles = f"<main><article><p>{PROSE * 4}</p></article><article><p>{short}</p></article></main>"
    assert main_text(f"<body>{articles}</body>") == f"{PROSE * 4}\n\n{short}"
    sections = f"<div><h2>One</h2><section><p>{PROSE * 3}</p><p>{PROSE * 3}</p></section>bare text<h4>Two</h4><section><p>{short}</p></section><ul><li>a</li></ul><section><p>{PROSE}</p></section><div><a href=/>more</a></div></div>"
    assert main_text(f"<body>{sections}</body>") == "\n\n".join(["One", PROSE * 3, PROSE * 3, "bare text", "Two", short, "a", PROSE])


def test_tags_of_any_length():
    for n in (100, 201, 1000, 50_000):
        tag = "<p " + " ".join(f'd{k}="a>b"' for k in range(n)) + ">"
        assert main_text(f"<article>{tag}{PROSE}</p></article>") == PROSE
    # no end by its quotes: read up to the first bracket, in linear time
    began = time.time()
    assert main_text('<article><p title="x>' + PROSE + "</p>" + f"<p a='>'>{PROSE}</p>" * 3 + "</article>") == "\n\n".join([PROSE] * 4)
    assert main_text("<article>" + '<a ">" x' * 100_000 + PROSE) is not None
    assert time.time() - began < 20


def test_round_trip_of_made_pages():
    """Texts put into pages of many shapes come out as they went in."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)) + ", " + " ".join(word() for _ in range(n)) + "."
    junk = ["<nav><a href=/>Home</a> <a href=/b>News</a></nav>", '<div class="sidebar"><p>{}</p></div>', '<ul class="menu"><li><a href=/>{}</a></li></ul>', "<aside><p>{}</p></aside>", '<div id="cookie-banner">{}</div>', "<script>var x = '<p>{}</p>';</script>", '<section class="post-comments"><p>{}</p><p>{}</p></section>', '<form action="/s"><label>{}</label><input></form>', "<!-- {} -->", '<div class="ad-box content"><p>{}</p></div>']
    for _ in range(300):
        blocks = [sentence(r.randrange(6, 30)) for _ in range(r.randrange(2, 9))]
        made = [r.choice(["<p>{}</p>", "<p>{}", "<p class='x'><b>{}</b></p>", "<blockquote>{}</blockquote>", "<p>{}\n</p>"]).format(b.replace(" ", r.choice([" ", "\n  "]))) for b in blocks]
        mess = lambda: "".join(r.choice(junk).replace("{}", sentence(8)) for _ in range(r.randrange(3)))
        inner = "".join(m + mess() for m in made)
        shape = r.choice(["<article>{}</article>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main"><div class="post-body">{}</div></div>', "<table><tr><td>{}</td></tr></table>"])
        page = f"<html><head><title>{sentence(3)}</title></head><body><header><h1>{word()}</h1></header>{mess()}{shape.format(inner)}{mess()}<footer><p>{sentence(9)}</p></footer></body></html>"
        assert main_text(page) == "\n\n".join(blocks), page


@pytest.mark.parametrize("name", ["adsbygoogle", "googleads", "sharebar", "relatedPosts", "cookiebar", "adbox", "notification", "AdSlot", "newsletterBox", "has-comments", "sidebar-with-ads", "with-sidebar-ads"])
def test_names_in_one_word_or_about_the_part_itself(name):
    part = f'<div class="{name}"><p>{PROSE} Not this one, though.</p></div>'
    assert main_text(f"<body><article><h1>T</h1><p>{PROSE}</p>{part}<p>{PROSE} End.</p></article></body>") == f"T\n\n{PROSE}\n\n{PROSE} End."


@pytest.mark.parametrize("name", ["legal", "alert-level", "social-history", "comment-on-results", "related-work", "promotion-to-captain", "shareholders", "menu-of-1890"])
def test_names_of_topics_stay_inside_an_article(name):
    for kind in ("id", "class"):
        part = f'<section {kind}="{name}"><h2>Of it</h2><p>{PROSE} This one, too.</p></section>'
        assert main_text(f"<body><main><p>{PROSE}</p>{part}</main></body>") == f"{PROSE}\n\nOf it\n\n{PROSE} This one, too."
        assert main_text(f'<body><article><p>{PROSE}</p><h2 {kind}="{name}">Of it</h2><p>{PROSE}</p></article></body>') == f"{PROSE}\n\nOf it\n\n{PROSE}"
    links = f'<div class="{name}"><a href=/a>One of many</a> <a href=/b>Another, to be clicked</a></div>'
    if name != "shareholders":  # no name of furniture at all
        assert main_text(f"<body><article><p>{PROSE}</p>{links}</article></body>") == PROSE


def test_sources_and_signs():
    items = '<ul><li><a href="/a">First one</a></li><li><a href="/b">Second one</a></li></ul>'
    assert main_text(f"<article><p>{PROSE}</p><h2>Sources and notes</h2>{items}</article>") == f"{PROSE}\n\nSources and notes\n\nFirst one\n\nSecond one"
    assert main_text(f"<article><p>{PROSE}</p><h2>More to read</h2>{items}</article>") == f"{PROSE}\n\nMore to read"
    signs = f"<p>{PROSE} Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> and <svg><title>no</title><text>y</text></svg> be.</p><svg><text>a drawing</text></svg>"
    assert main_text(f"<article>{signs}</article>") == f"{PROSE} Let x=2 and y be."


@pytest.mark.parametrize("text", ["Why did nobody see it coming?", "It was over!", "这是一个句子。", "So it was.", "هل انتهى الأمر؟", "“It was.”"])
def test_short_paragraphs_beside_the_best_container(text):
    assert main_text(f"<body><div><div><p>{PROSE * 3}</p></div><p>{text}</p></div></body>") == f"{PROSE * 3}\n\n{text}"
    assert main_text(f"<body><div><div><p>{PROSE * 3}</p></div><p><a href=/>{text}</a></p></div></body>") == PROSE * 3
