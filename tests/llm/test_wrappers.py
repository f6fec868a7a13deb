"""Main text of pages whose wrappers or comments carry telling names, and the scores that labelled pages give."""

import random
import re
from html.parser import HTMLParser

import pytest

from pathflow.llm import html_text, queries

STORY = "<h1>Title</h1>" + "".join(f"<p>Paragraph {k} tells a long story of many plain words.</p>" for k in range(6))
NAV = "<nav><a href='/'>Home page</a></nav>"
TEXT = "\n\n".join(["Title", *(f"Paragraph {k} tells a long story of many plain words." for k in range(6))])


def main(page):
    return html_text.main_text(page, html_text.DEFAULT_WEIGHTS)


@pytest.mark.parametrize("start", ["div class='page no-sidebar'", "div class='content has-sidebar'", "div id='social-wrap'", "form action='/'", "div class='widget'", "div class='share-page'"])
def test_wrappers_stay(start):
    tag = start.split()[0]
    assert main(f"<html><body>{NAV}<{start}>{STORY}</{tag}><footer>All rights</footer></body></html>") == TEXT
    side = "<div class='sidebar'>" + "<p>Some other words stand here beside it.</p>" * 9 + "</div>"
    if "widget" not in start:
        assert main(f"<html><body>{NAV}<{start}>{STORY}</{tag}>{side}</body></html>") == TEXT


@pytest.mark.parametrize(
    "aside",
    [
        "<section class='comments'><article><p>A reader says a lot of words about this.</p></article></section>",
        "<section id='c'><article class='comment'><p>A reader says a lot of words about this.</p></article></section>",
        "<aside><article><p>A teaser of another story with words.</p></article></aside>",
        "<form class='x'><p>Send us words of your own today please.</p></form>",
        "<div class='related-posts'><article><p>A teaser of another story with words.</p></article></div>",
        "<div class='comment-list'><p>A reader says a lot of words about this.</p></div>",
    ],
)
def test_asides_go(aside):
    assert main(f"<html><body><article>{STORY}</article>{aside}</body></html>") == TEXT
    assert main(f"<html><body><div>{STORY}</div>{aside}</body></html>") == TEXT
    assert main(f"<html><body><main>{STORY}{aside}</main></body></html>") == TEXT


def test_unclosed_asides():
    assert main(f"<html><body><div class='ad'>Buy now<article>{STORY}</article></body></html>") == TEXT
    assert main(f"<html><body><article>{STORY}<div class='ad'>Buy now</article></body></html>") == TEXT
    assert main(f"<html><body><p class='ad'>Buy now<div>{STORY}</div></body></html>") == TEXT
    assert main(f"<html><body><div>{STORY}<svg class='share'/><p>More of the story follows here after the picture of it.</p></div></body></html>") == TEXT + "\n\nMore of the story follows here after the picture of it."


class Reference(HTMLParser):
    """Text of <article>, blocks apart, by the standard library's parser; the pages of the tables hold nothing else in it."""

    def __init__(self, page):
        super().__init__()
        self.inside, self.blocks = 0, [""]
        self.feed(page)
        self.close()
        self.text = "\n\n".join(t for t in (" ".join(b.split()) for b in self.blocks) if t)

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


@pytest.fixture(scope="module")
def pages(spark):
    return [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def learned(spark):
    return html_text.learn_weights(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_equal_to_a_parser(spark, pages, learned):
    found = {r["page_id"]: r["text"] for r in queries.op10_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert [found[k] for k in sorted(found)] == [Reference(p).text for p in pages]
    assert learned[".ad"] < html_text.ASIDE_ODDS and learned["<nav>"] < html_text.ASIDE_ODDS
    assert learned["word"] > 0 > learned["p"] > learned["li"] and learned["div"] < learned["p"]


def unmarked(page):
    return re.sub(r"<(/?)(article|main)\b", r"<\1div", page)


def test_scan_decides(pages, learned, monkeypatch):
    # without any list of names, learned or not, and without marks, the scan finds the article; without the scan nothing does
    monkeypatch.setattr(html_text, "_ASIDE", frozenset())
    monkeypatch.setattr(html_text, "_NEVER", frozenset())
    bare = {k: v for k, v in learned.items() if k[0] not in "<."}
    expected = [Reference(p).text for p in pages]
    assert sum(html_text.main_text(unmarked(p), bare) == e for p, e in zip(pages, expected, strict=True)) > 0.98 * len(pages)
    assert all(html_text.main_text(p, bare) == e for p, e in zip(pages, expected, strict=True))
    monkeypatch.setattr(html_text, "best_region", lambda scores: (0, len(scores)))
    assert not any(html_text.main_text(unmarked(p), bare) == e for p, e in zip(pages, expected, strict=True))


def test_unmarked_pages_with_lists(pages, learned):
    assert all(html_text.main_text(unmarked(p), learned) == Reference(p).text for p in pages)


READERS = "<p>A reader says a lot of words about this story today.</p>"


@pytest.mark.parametrize("n", [1, 9, 30, 400])
@pytest.mark.parametrize("start", ["div class='comments'", "div class='comment-list'", "ol class='commentlist'", "div id='disqus_thread'", "section class='discussion'", "div class='reply-box'"])
@pytest.mark.parametrize("story", [STORY, "<p>Short words of an article.</p>"])
def test_comments_of_any_length_go(learned, n, start, story):
    expected = TEXT if story is STORY else "Short words of an article."
    readers = f"<{start}>{READERS * n}</{start.split()[0]}>"
    for weights in (learned, html_text.DEFAULT_WEIGHTS):
        for page in (f"<article>{story}</article>{readers}", f"<main>{story}{readers}</main>", f"<div>{story}</div>{readers}", f"<article>{story}{readers}</article>"):
            assert html_text.main_text(f"<html><body>{NAV}{page}<footer>All rights</footer></body></html>", weights) == expected


@pytest.mark.parametrize("n", [1, 9, 400])
def test_unnamed_comments_beside_a_marked_article_go(learned, n):
    assert html_text.main_text(f"<html><body><article>{STORY}</article><ul>{f'<li>{READERS}</li>' * n}</ul></body></html>", learned) == TEXT


def test_all_articles_stay(learned):
    other = "<p>The second article is shorter.</p>"
    between = f"<div>{'Words between the two articles of this page. ' * 20}</div>"
    page = f"<html><body>{NAV}<article>{STORY}</article>{between}<article>{other}</article><article class='comment'>{READERS * 40}</article></body></html>"
    assert html_text.main_text(page, learned) == TEXT + "\n\nThe second article is shorter."


@pytest.mark.parametrize("name", ["post comments-open", "entry has-comments", "page sidebar-closed"])
def test_states_name_no_comments(learned, name):
    assert html_text.main_text(f"<html><body><div class='{name}'><article class='{name}'>{STORY}</article></div></body></html>", learned) == TEXT


@pytest.mark.parametrize("n", [1, 40])
def test_doubtful_elements_within_an_article_go(learned, n):
    box = f"<div class='promo-box'>{'<p>Buy this thing now.</p>' * n}</div>"
    rest = "<p>The last paragraph of the story.</p>"
    for page in (f"<article>{STORY}{box}{rest}</article>", f"<div class='share-page'><article>{STORY}{box}{rest}</article></div>", f"<div>{STORY}{box}{rest}</div>"):
        assert html_text.main_text(f"<html><body>{page}</body></html>", learned) == TEXT + "\n\nThe last paragraph of the story."


def test_many_tags_within_an_article(learned):
    rows = "<table>" + "<tr><td><img src=a></td><td><br></td></tr>" * 500 + "</table>"
    assert html_text.main_text(f"<html><body><article><p>One.</p>{rows}<p>Two.</p></article></body></html>", learned) == "One.\n\nTwo."


def test_nothing_else_on_the_page(learned):
    for start in ("div class='comments'", "div class='modal'", "form", "div class='ad'"):
        assert html_text.main_text(f"<html><body>{NAV}<{start}>{STORY}</{start.split()[0]}></body></html>", learned) == TEXT


def test_scan_without_names(learned):
    """Menus and link lists without any telling tag or name around an unmarked article."""
    menu = "<div>" + "".join(f"<a href='/{k}'>Topic {k}</a> " for k in range(8)) + "</div>"
    more = "<ul>" + "".join(f"<li><a href='/{k}'>Some other story of today, number {k}</a></li>" for k in range(9)) + "</ul>"
    page = f"<html><body>{menu}<div>{STORY}</div>{more}</body></html>"
    assert html_text.main_text(page, learned) == TEXT
    assert len(html_text.main_text(f"<html><body>{menu}{more}</body></html>", learned).split()) < 10  # no more than one link's words


@pytest.mark.parametrize("seed", range(20))
def test_region_by_brute_force(learned, seed):
    rng = random.Random(seed)
    parts = ["<p>", "</p>", "<li>", "<a href=x>", "</a>", "<div class='ad'>", "</div>", "<article>", "</article>", "one two three ", "word ", "<nav>", "</nav>", "<br>", "<form>"]
    page = "".join(rng.choices(parts, k=rng.randrange(1, 40)))
    pieces = list(html_text.items(page, learned))
    scores = html_text.scores_of(pieces, learned)
    best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
    a, b = html_text.best_region(scores)
    assert sum(scores[a:b]) == pytest.approx(max(0, best))
    begun = {x.doubt for x in pieces[a:b] if x.kind == "doubt" and x.value != "/"}
    words = " ".join(x.value for x in pieces[a:b] if x.kind.endswith("word") and x.doubt not in begun).split()
    assert html_text.joined(html_text.region(pieces, learned, hidden=True)).split() == words


def test_learning_needs_marks(spark):
    none = spark.createDataFrame([(1, "<p>no mark here</p>"), (2, None)], "page_id long, html string")
    assert html_text.learn_weights(none) == html_text.DEFAULT_WEIGHTS
    # a name that stands in articles isn't learned, whatever stands around them
    kept = spark.createDataFrame([(k, f"<div class='promoted'>A word</div><article>{STORY}<div class='figure-note'>A note of some words.</div></article><div class='tease'>A tease</div>") for k in range(5)], "page_id long, html string")
    found = html_text.learn_weights(kept)
    assert found[".note"] > html_text.ASIDE_ODDS > found[".tease"]
