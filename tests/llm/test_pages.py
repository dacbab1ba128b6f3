"""Generated pages, of which it is known what is article and what is not."""

from __future__ import annotations

import random

import pytest

from motionspark.llm import pages

TEXT = "The main text, which goes on for quite a while and then ends. " * 3
JUNK = ["<nav><ul><li><a href='/a'>Menu</a></li></ul></nav>", "<div class='ad'>Buy now</div>", "<aside>Besides</aside>", "<footer>Copyright</footer>", "<div class='cookie-banner'>We use cookies</div>", "<div id='left-sidebar'><p>Beside it</p></div>", "<script>var x = '<p>no</p>';</script>", "<form><input><button>Go</button> Sign in</form>", "<div class='user-comments'><p>Nice post!</p></div>", "<div style='display: none'>hidden text</div>", "<div role='navigation'><a href='/'>Home</a></div>"]
AROUND = ["<div class='layout has-sidebar'>", "<div id='page' class='nav-open'>", "<div class='ad-hoc'>", "<div class='main'>", "<div>", "<form id='all'>", "<div class='widget'>", "<section class='no-comments'>", "<div class='site-banner'>"]


def page(rng: random.Random, article: bool) -> tuple[str, list[str]]:
    """A page and the blocks of its article."""
    blocks, body = [], []
    for i in range(rng.randrange(3, 9)):
        text = f"Paragraph {i} of {rng.randrange(10**9)}. {TEXT}".strip()
        blocks.append(text)
        words = text.split(" ")
        at = rng.randrange(len(words))
        words[at] = f"<b>{words[at]}</b>"
        body.append(f"<p>{' '.join(words)}" + rng.choice(["</p>", ""]))
        if rng.random() < 0.3:
            body.append(rng.choice(JUNK))
    inner = "\n".join(body)
    if article:
        inner = f"<article>{inner}</article>"
    around = rng.sample(AROUND, rng.randrange(4))
    for open_ in around:
        inner = f"{open_}{inner}</{open_[1:].split()[0].rstrip('>')}>"
    before, after = rng.sample(JUNK, 3), rng.sample(JUNK, 3)
    if rng.random() < 0.3:
        before.append("<nav>" + "<span>" * rng.randrange(60, 200) + "x</nav>")
    return f"<html><head><title>t</title></head><body>{''.join(before)}{inner}{''.join(after)}</body></html>", blocks


@pytest.mark.parametrize("article", [True, False])
def test_generated_pages_give_their_articles(article):
    rng = random.Random(3)
    for _ in range(300):
        html, blocks = page(rng, article)
        assert pages.main_text(html).split("\n\n") == blocks, html


@pytest.mark.parametrize("name,share", [("ad", 0.9), ("cookie-banner", 0.9), ("comments__list", 0.9), ("ad-300x250", 0.9), ("user-comments", 0.5), ("has-sidebar", 0), ("nav-open", 0), ("ad-hoc", 0), ("content", 0), ("", 0), ("-", 0)])
def test_names_of_elements(name, share):
    assert pages._share_of_name(name) == share


def test_elements_that_may_go_are_judged_by_what_they_hold():
    post, talk = f"<p>{TEXT}</p>" * 2, "<article><p>nice</p></article>"
    want = "\n\n".join([TEXT.strip()] * 2)
    assert pages.main_text(f"<article>{post}<div class='comments'>{talk * 30}</div></article>") == want  # holds not all articles
    assert pages.main_text(f"<div>{post}</div><ol class='comments'><li>{talk}</ol>") == want  # all of them, but little text
    assert pages.main_text(f"<div class='ad'>{post}</div><p>x</p>").startswith(want)  # nearly all text
    assert pages.main_text(f"<div class='ad'>Buy<article>{post}</article>") == want  # an advert that never ends
    assert pages.main_text(f"<div class='widget'><div class='ad'>Buy</div>{post}</div>") == want  # inner ones are judged too
    assert pages.main_text("<div class='ad'>only</div>") == "only"
    assert pages.main_text("") == pages.main_text("<nav>x</nav>") == ""


BODY = [f"{i}: {TEXT}".strip() for i in range(6)]
SIX = "".join(f"<p>{x}</p>" for x in BODY)
INNER = ["elementor-element elementor-widget", "post-widget", "widget", "block warning", "entry social", "content-teaser", "article-banner"]


@pytest.mark.parametrize("outer", ["<main>", "<article>", "<div>", "<main><article>"])
@pytest.mark.parametrize("name", INNER)
@pytest.mark.parametrize("parts", [1, 2, 6])
def test_names_inside_the_article_that_hold_its_text(outer, name, parts):
    """Names of page builders' blocks, one around all or each around some of it."""
    step = len(BODY) // parts
    inner = "".join(f"<div class='{name}'><div class='{name.split()[-1]}-container'>" + "".join(f"<p>{x}</p>" for x in BODY[i : i + step]) + "</div></div>" for i in range(0, len(BODY), step))
    ends = "".join(f"</{x}>" for x in reversed(outer.strip("<>").split("><")))
    html = f"<body>{JUNK[0]}{JUNK[1]}{outer}{inner}{JUNK[4]}{ends}<div class='user-comments'><p>Nice post!</p></div>{JUNK[3]}</body>"
    assert pages.main_text(html).split("\n\n") == BODY


@pytest.mark.parametrize("n", [1, 40, 400])
@pytest.mark.parametrize("article", [True, False])
def test_reader_comments_go_whatever_their_share(n, article):
    talk = f"<article><p>Nice. {TEXT}</p></article>" * n
    post = f"<article>{SIX}</article>" if article else SIX
    assert pages.main_text(f"<body>{post}<ol class='commentlist'>{talk}</ol></body>").split("\n\n") == BODY
    assert pages.main_text(f"<body><article>{SIX}<div id='comments'>{talk}</div></article></body>").split("\n\n") == BODY
    assert "Nice" in pages.main_text(f"<body><p>x</p><div id='comments'>{talk}</div></body>")  # nothing else on the page
    code = "<pre><span class='comment'># one</span> x = 1</pre>"
    assert "# one x = 1" in pages.main_text(f"<article>{SIX}{code}</article>")


@pytest.mark.parametrize("around", ["<article>", "<div class='text'>", "<main>", ""])
def test_short_blocks_up_to_the_end_of_the_content(around):
    short = [f"D{i} she said." for i in range(14)]
    end = f"</{around.strip('<>').split()[0]}>" if around else ""
    inner = f"<h1>Title</h1><p class='teaser'>The lead.</p>{SIX}" + "".join(f"<p>{x}</p>" for x in short)
    html = f"<body>{''.join(JUNK)}{around}{inner}{end}{''.join(JUNK)}</body>"
    assert pages.main_text(html).split("\n\n") == ["Title", "The lead.", *BODY, *short]


def test_lists_of_references_stay_in_articles():
    refs = "".join(f"<li><a href='/{i}'>Reference {i}</a></li>" for i in range(4))
    assert pages.main_text(f"<article><h1>T</h1>{SIX}<h2>References</h2><ul>{refs}</ul></article>").split("\n\n") == ["T", *BODY, "References", *(f"Reference {i}" for i in range(4))]


def test_text_after_broken_markup_stays():
    for broken, seen in (('<p>See <a href="x>this</a> there.</p>', "See this there."), ("<!-- never ends", "never ends"), ("<![foo[ x ]]>", ""), ("<p>a < b & c</p>", "a < b & c")):
        got = pages.main_text(f"<body><article>{SIX}{broken}{SIX}</article></body>").split("\n\n")
        assert got == [*BODY, *([seen] if seen else []), *BODY], broken
    assert pages.main_text(f'<article>{SIX}</article><a href="').split("\n\n") == BODY


@pytest.mark.parametrize("piece", ['<a href="', "<![CDATA[", "</", "<!--", "<?", "<", "<a b=c ", "<a '", "<div>", "<ul><li>", "&#", "<!doctype ", "<a/"])
@pytest.mark.parametrize("end", ["", '">', "-->"])
def test_much_broken_markup_takes_linear_time(piece, end):
    import time

    began = time.process_time()
    pages.main_text(piece * (250_000 // len(piece)) + end)
    assert time.process_time() - began < 4
