"""Main text of pages whose layouts the given table lacks: excluded parts inside articles, few telling tags, hostile markup."""

import random
import re
import time

import numpy as np
import pytest

from panelwerk.llm import html_extract as H

PAGES = "/root/testdata/sf0.01/pages.parquet"
SAID = "Some other words are said here about nothing at all, and they go on for a while."


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet(PAGES).orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def wanted(spark, pages):
    """The blocks of each article, cut out by hand (the table's articles hold nothing else)."""
    from html import unescape

    found = []
    for page in pages:
        inner = page[page.index("<article>") : page.index("</article>")].replace("<br>", " ")
        parts = (" ".join(unescape(x).split()) for x in re.split(r"<(?!/?b>)[^>]*>|</?b>", inner))
        found.append("\n".join(p for p in parts if p))
    return found


def in_article(page, made):
    return re.sub(r"<article>(.*?)</article>", lambda m: made(m[1]), page, flags=re.S)


def other_words(pages, k):
    return " ".join(re.sub(r"<[^>]*>", " ", pages[(k + 1) % len(pages)]).split()[20:60])


def divided(k):
    return lambda body: f"<div>{body}</div>" if k % 2 else f'<div class="zone-7">{body}</div>'


def unmarked(page):
    return re.sub(r"<(nav|footer)>(.*?)</\1>", r"<div>\2</div>", page, flags=re.S)


CASES = {
    "two of 250 tagged": lambda pages: [p if k in (10, 100) else in_article(p, divided(k)) for k, p in enumerate(pages)],
    "comments inside": lambda pages: [in_article(p, lambda b, k=k: f'<article>{b}<section class="comments"><h3>Comments</h3><div><p>{other_words(pages, k)}</p></div><div><p>{SAID}</p></div></section></article>') for k, p in enumerate(pages)],
    "form inside": lambda pages: [in_article(p, lambda b: f'<article>{b}<form class="newsletter"><p>{SAID}</p><input type=text><button>Go</button></form></article>') for p in pages],
    "aside between": lambda pages: [in_article(p, lambda b, k=k: "<article>" + b.replace("<br>", f"</p><aside><h3>See</h3><p>{other_words(pages, k)}</p></aside><p>", 1) + "</article>") for k, p in enumerate(pages)],
    "plain divisions": lambda pages: [unmarked(in_article(p, divided(1))) for p in pages],
}


@pytest.mark.parametrize("case", CASES)
def test_cases(spark, pages, wanted, case):
    made = CASES[case](pages)
    table = spark.createDataFrame(list(enumerate(made)), "page_id long, html string")
    found = {r.page_id: r.text for r in H.extract_text(table, H.train(table)).collect()}
    assert all(found.values())
    assert sum(found[k] == w for k, w in enumerate(wanted)) >= 245


def test_introduction_without_a_block(spark, pages):
    trees = H.train(spark.createDataFrame(list(enumerate(pages[:100])), "page_id long, html string"))
    page = H.Page(f"<body>Intro. {SAID}<p>Para one. {SAID}</p><p>Para two. {SAID} {SAID}</p></body>")
    assert H.main_text(page, trees.log_odds(H.node_features(page))) == f"Intro. {SAID}\nPara one. {SAID}\nPara two. {SAID} {SAID}"


@pytest.mark.parametrize(
    "source",
    ['<a "' * 250_000, '<a ">"' * 60_000, "<span>" * 40_000 + "</i>" * 40_000, "<!" * 200_000, '<svg ">"' * 40_000, "<p><div>" + "<span>" * 30_000 + "<hr>" * 30_000, "<html>" + "<span>" * 30_000 + "</html>" * 30_000, "<a '\">" * 60_000, "<a<" * 200_000],
    ids=["quotes", "quoted ends", "end tags", "declarations", "graphics", "rules", "page ends", "mixed quotes", "names"],
)
def test_hostile_markup_is_read_in_linear_time(source):
    began = time.process_time()
    H.node_features(H.Page(source))
    assert time.process_time() - began < 6  # seconds of this thread; a quadratic reader takes minutes


def test_tags_end_outside_quotes_or_else_at_the_first_sign():
    tags = lambda s: [(t[3], t[4]) for t in iter_tags(s)]
    assert tags('<a title="x>y">z</a>') == [("a", ' title="x>y"'), ("a", "")]
    assert tags('<a title="x>y z') == [("a", ' title="x')]
    assert tags("<!-- <b> --><i class='\"'>") == [(None, ""), ("i", " class='\"'")]
    assert tags("a < b <c") == [] and tags("<!doctype html><p") == [(None, "")]


def iter_tags(source):
    tags, at = H.Tags(source), 0
    while tag := tags.following(at):
        yield tag
        at = tag[1]


def test_labels_leave_out_parts_of_an_article():
    page = H.Page("<article><h1>T</h1><p>A</p><aside><p>B</p></aside><form><p>C</p></form><div class=comments><p>D</p></div><div class='story'><p>E</p></div></article><p>F</p>")
    inside = H._inside(page)
    assert [t for n, t in page.runs if inside[n]] == ["T", "A", "E"]


def test_layouts_hold_excluded_parts_inside_the_article(spark, pages):
    found = [made for k in range(160) for made in [H._layout(H.Page(pages[k]), random.Random(k))] if made]
    inside = [m for m in found if re.search(r"<p data-truth.*(<aside|<form|comments?\"|disqus|sidebar|newsletter).*<p data-truth", m)]
    assert len(inside) >= 8
    x, y = zip(*H._examples(pages[0], 1), strict=True)
    assert 0 < np.concatenate(y).mean() < 1 and all(len(a) == len(b) for a, b in zip(x, y, strict=True))
