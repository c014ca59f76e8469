import random
import time

import pytest

from gleaner.llm import html

W = html.fit()


def text(page):
    return html.extract(page, W)


def test_weights_follow_the_method():
    assert W["word"] > 0 and all(v < 0 for k, v in W.items() if k != "word")
    assert W["<p>"] > W["<a>"] and W["boiler"] < 0 and W["link"] < 0


def plain_best(scores):
    best, span = 0, (0, 0)
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > best:
                best, span = s, (i, j)
    return best, span


def test_best_run_equals_all_runs():
    rng = random.Random(0)
    for _ in range(300):
        scores = [rng.randint(-4, 4) for _ in range(rng.randrange(0, 14))]
        a, b = html.best_run(scores)
        assert sum(scores[a:b]) == plain_best(scores)[0]


def test_labelled_pages_give_back_their_content():
    for page in html.LABELLED:
        body = page[page.index(html.START) + 2 : page.index(html.STOP)]
        got = text(page.replace(html.START, "").replace(html.STOP, ""))
        want = text(f"<div>{body}</div>")
        assert got == want and len(got) > 100


PARAGRAPHS = "<p>First paragraph with a good number of words in it.</p><p>Second &amp; last one, with&nbsp;<b>bo</b>ld   text.<br>End</p>"
WANT = "First paragraph with a good number of words in it. Second & last one, with bold text. End"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><a href=x>Home</a> and more</nav><main>{PARAGRAPHS}</main><footer>All rights reserved, by all of us</footer></body></html>",
        f"<body><div class='sidebar'>Many words that stand in the side bar of this page</div><div>{PARAGRAPHS}</div><div id=comments><p>What a page! I read it with joy.</p></div>",
        f"<body><header>The name of the site in some words</header>{PARAGRAPHS}<form>Write to us <input> now</form><script>var a = '<p>no words</p>';</script>",
        f"<article><div class='ad banner'>Buy this thing now</div>{PARAGRAPHS}<aside>Read this too, and this</aside><style>p {{ a: b }}</style></article>",
        f"<article>{PARAGRAPHS}<div class=\"cookie-notice\" data-x='a>b'>We use cookies here</div><!-- <p>comment</p> --></article>",
        f"<body><article title='hidden menu' data-id=comments data-class='ad'>{PARAGRAPHS}<p hidden>Not shown at all to you</p></article>",
        f"<body><ul class=menu><li>One<li>Two<li>Three</ul><article>{PARAGRAPHS}",
    ],
)
def test_boilerplate_is_left_out(page):
    assert text(page) == WANT


@pytest.mark.parametrize(
    "page",
    [
        f"<div id=page class='site has-sidebar'><article>{PARAGRAPHS}</article></div>",
        f"<div class='no-sidebar comments-enabled'><div>{PARAGRAPHS}</div></div>",
        f"<div class=widget><article>{PARAGRAPHS}</article><div class=comments><article>I read it with joy, and again.</article></div></div>",
        f"<div id=login><div>{PARAGRAPHS}</div></div>",
        f"<main>{PARAGRAPHS}<div class='site-footer'>All rights reserved</div></main>",
    ],
)
def test_names_do_not_drop_what_holds_the_content(page):
    assert text(page) == WANT


@pytest.mark.parametrize("tag", ["article", "main", "div class=post"])
def test_boilerplate_within_the_content_does_not_cut_it(tag):
    lead, ad = " ".join(f"lead{i}" for i in range(20)), " ".join(f"buy{i}" for i in range(60))
    page = f"<{tag}><h1>Title</h1><div class=lead><p>{lead}</p></div><div class=ad><p>{ad}</p></div><div class=body>{PARAGRAPHS}{PARAGRAPHS}</div></{tag.split()[0]}>"
    assert text(page) == f"Title {lead} {WANT} {WANT}"


def test_links_within_an_article_do_not_cut_it():
    links = "<ul>" + "".join(f"<li><a href=/{i}>see this other page</a></li>" for i in range(20)) + "</ul>"
    assert text(f"<article><div><p>A lead of some words.</p></div>{links}<div>{PARAGRAPHS}</div></article>") == "A lead of some words. " + WANT


@pytest.mark.parametrize("start", ["<svg class=i/>", "<svg/>", "<math/>", "<svg>", "<object data=x>", "<canvas>", "<select>", "<noscript>", "<iframe src=x>"])
def test_elements_without_end_do_not_empty_the_page(start):
    assert text(f"<body>{start}<article>{PARAGRAPHS}</article>") == WANT


def test_math_and_fallback_texts_stay_and_scripts_go_to_the_end():
    page = "<article><p>Where <math><mi>x</mi><annotation>\\x</annotation></math> is small, <object data=o>an object</object> and <canvas>a canvas</canvas> stand.</p><script>var a = 1; <p>no words</p></article>"
    assert text(page) == "Where x is small, an object and a canvas stand."
    assert text(f"<article>{PARAGRAPHS}<svg><text>icon</text></svg><select><option>One</select></article>") == WANT


def test_title_in_an_article_header_stays():
    assert text(f"<div class=article-header><h1>A title of some words</h1></div><div>{PARAGRAPHS}</div>") == "A title of some words " + WANT


def test_short_blocks_inside_stay():
    assert text("<article><h1>Be.</h1><p>A paragraph of quite some words here.</p><p>Er.</p></article>") == "Be. A paragraph of quite some words here. Er."


def test_unclosed_and_nested_tags():
    assert text("<article><p><b>bold start<br><p>next one here<ul><li>a<li>b</ul></article>") == "bold start next one here a b"


def test_nothing_to_find():
    for page in (None, "", "   ", "<nav>Home</nav>", "<script>x", "<!--"):
        assert text(page) == ""
    assert text("only words without any tag") == "only words without any tag"


def test_very_long_page_is_linear():
    page = "<article>" + "<p>some words here</p>" * 50_000 + "</article>"
    assert len(text(page)) == 50_000 * 16 - 1


@pytest.mark.parametrize("opens", ["<div>", "<span class=x>", "<div class=a><p>some text</p>", "<b class=x><p>", "<section><ul><li>item"])
def test_deep_pages_are_linear(opens):
    began = time.perf_counter()
    assert WANT in text(opens * 20_000 + f"<article>{PARAGRAPHS}</article>" + "</table></i></div>" * 20_000)
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize(
    "page",
    [
        f"<div data-x=it's><article>{PARAGRAPHS}</article></div><p title=don't></p>",
        f"<body><div data-a=5\" class=x><article title='a>b' data-y = \"c>d\">{PARAGRAPHS}</article>",
        f"<article class=\"one>{PARAGRAPHS}</article>",
    ],
)
def test_quotes_within_values(page):
    assert text(page) == WANT


def made(rng):
    """A page of known parts, and the text that it should give."""
    sentence = lambda k: " ".join(rng.choice(["river", "stone", "bread", "und", "ciudad", "été", "Q&amp;A", "x&lt;y", "caf&eacute;", "no&nbsp;one"]) for _ in range(k)) + "."
    plain = lambda t: " ".join(__import__("html").unescape(t).split())
    links = lambda k: "".join(f"<li><a href='/{i}'>{sentence(2)}</a></li>" for i in range(k))
    noise = [
        lambda: f"<nav><ul>{links(6)}</ul></nav>", lambda: f"<div class='ad'>{sentence(8)}</div>", lambda: f"<aside><h3>{sentence(3)}</h3><ul>{links(4)}</ul></aside>",
        lambda: f"<footer><p>{sentence(9)}</p></footer>", lambda: f"<form action=/s><input name=q><label>{sentence(3)}</label></form>",
        lambda: f"<script>if (a<b) {{ c('<p>{sentence(4)}</p>') }}</script>", lambda: f"<div id=\"sidebar\"><p>{sentence(12)}</p></div>",
        lambda: f"<div class=cookie-notice>{sentence(10)}</div>", lambda: f"<!-- <p>{sentence(5)}</p> -->", lambda: f"<style>p{{a:b}}</style><div class='social share'>{links(3)}</div>",
    ]
    blocks, want = [], []
    for _ in range(rng.randint(4, 12)):
        words = sentence(rng.randint(10, 50))
        form = rng.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<div><p>{}</p></div>", "<ul><li>{}</li></ul>", "<p class=lead>{}\n\t </p>", "<section><p><b>{}</b></p></section>"])
        blocks.append(form.format(words))
        want.append(plain(words))
        if rng.random() < 0.2:
            blocks.append(rng.choice(noise)())
    tag = rng.choice(["article", "main", "div class=post", "div", "section"])
    around = lambda: "".join(rng.choice(noise)() for _ in range(rng.randint(0, 3)))
    after = f"<div class=comments><h3>Comments</h3><p>{sentence(25)}</p><p>{sentence(25)}</p></div>" if rng.random() < 0.5 else ""
    page = f"<html><head><title>{sentence(4)}</title></head><body>{around()}<{tag}>{''.join(blocks)}</{tag.split()[0]}>{after}{around()}</body></html>"
    return page, " ".join(want)


def test_pages_of_known_parts_give_back_their_articles():
    rng = random.Random(21)
    for _ in range(300):
        page, want = made(rng)
        assert text(page) == want, page


def test_edges(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    pages = spark.createDataFrame([(1, None, None, "t", 1), (None, "u", f"<p>{PARAGRAPHS}</p>", "t", 2), (2, "u", "<p>é\U0001f600</p>", None, None)] * 2, schema)
    rows = html.extracted(pages).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in rows) == sorted([(1, "", 0), (0, WANT, len(WANT)), (2, "é\U0001f600", 2)] * 2)
    assert html.extracted(spark.createDataFrame([], schema)).count() == 0
