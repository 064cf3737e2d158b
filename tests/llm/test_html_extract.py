import random
import time

import pytest

from spanforge.llm.html_extract import CHROME, DOUBTFUL, extract, main_text, name_points

PROSE = "This is a sentence, with commas, long enough to count as a paragraph of the article itself."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


def test_article_with_surroundings():
    body = f"""<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy, now, please, this.</div>
    <article><h1>A &amp; B</h1><p><b>First line.<br><p>{PROSE}</p><p>Nd.</p><script>var t="</p>";</script>
    <div class="share-links"><a href="#">Tweet</a></div><ul><li>one<li>two</ul></article>
    <div id="comments"><p>{PROSE}</p></div><aside><p>{PROSE}</p></aside><form><p>{PROSE}</p></form><footer>&copy; x</footer>"""
    assert main_text(page(body, "<style>p{}</style>")) == f"A & B\n\nFirst line.\n\n{PROSE}\n\nNd.\n\none\n\ntwo"


def test_best_container_without_semantic_elements():
    links = "".join(f'<li><a href="/{i}">A link, with words, {i}</a></li>' for i in range(30))
    body = f'<div><div class="col1"><ul>{links}</ul></div><div class="col2"><h2>Title</h2><p>{PROSE}</p><p>{PROSE} More.</p></div></div><div class="cookie-consent"><p>{PROSE}</p></div>'
    assert main_text(page(body)) == f"Title\n\n{PROSE}\n\n{PROSE} More."


def test_siblings_are_kept():
    body = f"<div><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div><div><p>{PROSE} Two.</p><p>{PROSE}</p></div>"
    assert main_text(page(body)).count("\n\n") == 4


def test_references_and_space():
    assert main_text(page("<article><p>a&nbsp;&lt;b&gt;\n\t c &#233;&#x1F600; &notaref; d<br>e</p></article>")) == "a <b> c é😀 ¬aref; d e"


def test_odd_markup():
    assert main_text("no markup at all, just words") == "no markup at all, just words"
    assert main_text("a < b and <p>c") == "a < b and\n\nc"
    assert main_text("<p>open <!-- never closed") == "open"
    assert main_text("<article><p>x</b></i></p></section>y</article>") == "x\n\ny"
    assert main_text(page("<nav>only</nav>")) == ""
    assert main_text("<script>x") == ""
    assert main_text("<div " * 50) != "crash"
    assert len(main_text("<article>" + "<div>" * 5000 + PROSE + "</div>" * 5000)) == len(PROSE)


def test_table(spark):
    rows = [(1, "u", None, "x"), (1, "u", "", "x"), (None, None, "<article><p>é😀</p></article>", "x"), (2, "v", f"<article><p>{PROSE * 20000}</p></article>", "x")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("1", 0), ("2", len(PROSE) * 20000), ("None", 2)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "part",
    [
        '<div class="entry-header"><h1>{}</h1></div>',
        '<p class="notice-board">{}</p>',
        '<p id="related-work">{}</p>',
        '<section class="alert-systems"><h2>A title</h2><p>{}</p></section>',
        '<div class="skip-connections"><p>{}</p><p>{}</p></div>',
        '<div class="header"><p>{}</p></div>',
        '<div class="has-sidebar"><p>{}</p></div>',
        '<section id="market-share-by-rail-operator"><p>{}</p></section>',
    ],
)
def test_names_do_not_remove_prose_of_the_article(part):
    inner = part.replace("{}", f"{PROSE} Part.")
    got = main_text(page(f"<article><p>{PROSE}</p>{inner}<p>{PROSE}</p></article>"))
    assert got.count(f"{PROSE} Part.") == part.count("{}") and got.count(PROSE) == 2 + part.count("{}")


@pytest.mark.parametrize("name", ["comments", "user-comments", "comment-list", "ad", "ad-slot", "cookie-notice", "notice", "site-alert-box", "newsletter-signup", "share", "social-links", "related-posts", "sidebar"])
def test_names_of_chrome_remove(name):
    got = main_text(page(f'<article><p>{PROSE}</p><div class="{name}"><p>Not, this.</p></div><p>{PROSE}</p></article>'))
    assert got == f"{PROSE}\n\n{PROSE}"


def test_comments_go_however_long():
    thread = "".join(f'<article class="comment"><p>{PROSE} {i}</p></article>' for i in range(30))
    assert main_text(page(f'<main><article class="post comments-open"><p>{PROSE}</p></article><section id="comments">{thread}</section></main>')) == PROSE
    assert main_text(page(f'<article><p>{PROSE}</p></article><div class="thread">{thread}</div>')) == PROSE


def test_name_points():
    assert name_points("post entry-content") == name_points("has-sidebar") == name_points("") == 0
    assert name_points("notice") > name_points("notice-board") > 0
    assert name_points("Comments") == name_points("adSlot") == float("inf") > name_points("comment-on-methods")


def test_planted_articles():
    """Generated pages: an article of known blocks among chrome of every kind comes back block by block."""
    words = "river stone light under many roads carry people where old towns keep their names while winter moves along".split()
    for seed in range(150):
        rng = random.Random(seed)

        def prose(least=20):
            text = " ".join(rng.choice(words) + ("," if rng.random() < 0.1 else "") for _ in range(rng.randint(least, 60)))
            return text.rstrip(",").capitalize() + "."

        def links(n):
            return "<ul>" + "".join(f'<li><a href="/{i}">{rng.choice(words)} {rng.choice(words)}</a></li>' for i in range(n)) + "</ul>"

        title = prose(20)[:60].strip()
        blocks = [title] + [prose() for _ in range(rng.randint(3, 9))]
        kept = ["p", 'p class="lead"', 'p class="notice-board"', 'blockquote id="alert-history"', "h2", 'div class="related-work-section"']
        inside = [f"<{(t := rng.choice(kept))}>{b}</{t.split()[0]}>" for b in blocks[1:]]
        noise = [f'<div class="ad">{prose()}</div>', f'<div class="share">{links(3)}</div>', f'<div class="related-posts">{links(4)}</div>', f'<aside><p>{prose()}</p></aside>', f"<form><p>{prose()}</p></form>", "<script>var t='</p>';</script>"]
        for n in rng.sample(noise, rng.randint(0, 4)):
            inside.insert(rng.randint(0, len(inside)), n)
        shell = rng.choice(["article", "main", 'div class="story"', 'div id="content"'])
        article = f"<{shell}><h1>{title}</h1>{''.join(inside)}</{shell.split()[0]}>"
        around = [f"<header><p>{prose()}</p></header>", f"<nav>{links(8)}</nav>", f'<div class="cookie-consent"><p>{prose()}</p></div>', f'<div class="sidebar"><p>{prose()}</p>{links(5)}</div>']
        after = [f'<div id="comments"><p>{prose()}</p><p>{prose()}</p></div>', f"<footer><p>{prose()}</p></footer>"]
        body = "".join(rng.sample(around, rng.randint(0, 4))) + article + "".join(rng.sample(after, rng.randint(0, 2)))
        assert main_text(page(body)) == "\n\n".join(blocks), (seed, body)


@pytest.mark.parametrize("word", sorted(CHROME | DOUBTFUL))
def test_every_word_before_another_leaves_prose(word):
    long = f"{PROSE} " * 4
    for name in (f"{word}-recipe", f"{word}-theory history", f"the{word.title()}Engineering"):
        inner = f'<div class="{name}"><p>{long}</p></div>'
        assert main_text(page(f"<article><p>{PROSE}</p>{inner}<p>{PROSE}</p></article>")).count(PROSE) == 6, name
        assert main_text(page(f'<div id="story"><p>{PROSE}</p><section class="{name}"><p>{long}</p><p>{long}</p><p>{long}</p></section><p>{PROSE}</p></div>')).count(PROSE) == 14, name


@pytest.mark.parametrize("word", sorted(CHROME))
def test_every_word_of_chrome_removes_as_the_last_one(word):
    for name in (word, f"reader-{word}", f"{word}-box", f"site{word.title()}Wrapper"):
        assert main_text(page(f'<article><p>{PROSE}</p><div class="{name}"><p>{PROSE * 5}</p></div></article>')) == PROSE, name


def test_formulas_are_text():
    assert main_text(page("<article><p>If <math><mi>a</mi><mo>=</mo><mi>b</mi><annotation>a=b</annotation></math> holds.</p></article>")) == "If a=b holds."


@pytest.mark.parametrize(
    ("one", "size"),
    [("<div>a", 100_000), ("<b>a", 100_000), ("<p><b><li>a", 50_000), ("<span></i>", 100_000), ("<b><table><tr><td>x", 30_000), ("<div><p>a, b</p>", 60_000), ("<ul><li>a", 60_000)],
)
def test_deep_pages_take_seconds(one, size):
    began = time.process_time()
    main_text(one * size)
    main_text("<b>" * size + "<li></li><div></div>" * size)
    assert time.process_time() - began < 20
