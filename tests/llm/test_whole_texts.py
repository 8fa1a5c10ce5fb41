"""Texts that the training-data operators once lost in part."""

import numpy as np
import pytest

from panelwerk.llm import html_extract

SAID = ["A first paragraph of the story, long enough to be read. It has two sentences.", "A second one follows and goes on for some more words, as stories do."]
LINKS = "<ul>" + "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(6)) + "</ul>"


@pytest.fixture(scope="module")
def trees(spark):
    return html_extract.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def extracted(spark, trees, pages):
    rows = html_extract.extract_text(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"), trees).collect()
    return [r.text for r in sorted(rows, key=lambda r: r.page_id)]


@pytest.mark.parametrize(
    "skipped",
    [
        "<datalist><option value=a><option value=b></datalist>",
        "<datalist><option value=a>A</datalist><select><option>B</option></select>",
        '<svg viewBox="0 0 1 1" />',
        "<svg/>",
        "<svg width=1>",
        "<svg><svg></svg><text>no</text></svg>",
        "<canvas id=c>",
        '<iframe src="x"/>',
        "<script src='x'/>",
        "<select><option>no<option>no</select>",
        "<textarea>no",
        "<!-- <svg> --><svg><text>no</text></svg>",
    ],
)
def test_skipped_elements_end_where_they_end(skipped):
    page = html_extract.Page(f"<article><p>{SAID[0]}</p>{skipped}<p>{SAID[1]}</p></article>")
    assert [t for _, t in page.runs] == SAID


def test_code_without_an_end_tag_is_no_text():
    assert [t for _, t in html_extract.Page(f"<p>{SAID[0]}</p><script>if (a<b) x = '<p>no</p>'").runs] == SAID[:1]


def test_text_of_the_root_has_nodes_of_its_own():
    page = html_extract.Page("Bare <b>text</b> <a href=x>of two</a>.<div>Inside.</div>After.<html><body><p>Body.</p></body></html>Last.")
    assert [(t, page.parent[n]) for n, t in page.runs if page.tag[n] == "#text"] == [("Bare text of two.", 0), ("After.", 0)]
    assert [page.links[n] for n, t in page.runs if page.tag[n] == "#text"] == [2, 0] and page.links[0] == 0
    assert [page.tag[n] for n, t in page.runs if t == "Last."] == ["body"]
    odds = np.ones(len(page.parent))
    assert html_extract.main_text(page, odds) == "Bare text of two.\nInside.\nAfter.\nBody.\nLast."
    odds[[n for n, t in page.runs if t == "After."]] = -1
    assert html_extract.main_text(page, odds) == "Bare text of two.\nInside.\nBody.\nLast."


def test_bare_pages_are_extracted(spark, trees):
    bare = " ".join(SAID * 3)
    pages = [bare, bare.replace("story", "<b>story</b>"), f"{SAID[0]}<br>{SAID[1]}", f"<html><body><article><h1>Title</h1><p>{bare}</p><p>{bare}</p></article></body></html>{SAID[0]}"]
    found = extracted(spark, trees, pages)
    assert found == [bare, bare, " ".join(SAID), "\n".join(["Title", bare, bare, SAID[0]])]


def test_pages_without_article_or_main(spark):
    def page(i):
        body = "".join(f"<p>{x} This is page {i}.</p>" for x in SAID * 2)
        return f'<html><body><div class="navbar">{LINKS}</div><div class="content"><h1>Title {i}</h1>{body}</div><div class="footer">{LINKS}</div></body></html>'

    for n in (1, 40):
        pages = [page(i) for i in range(n)]
        trees = html_extract.train(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"))
        for i, text in enumerate(extracted(spark, trees, pages)):
            assert all(f"{x} This is page {i}." in text for x in SAID) and "Link" not in text


def test_training_takes_a_bounded_number_of_nodes(monkeypatch):
    monkeypatch.setattr(html_extract, "TRAIN_NODES", 50)
    body = "".join(f"<p>Paragraph {k} of a long story, with a sentence.</p>" for k in range(500))
    made = list(html_extract._examples(f"<html><body><article>{body}</article></body></html>", 3))
    assert len(made) > 3 and all(len(x) == len(y) <= 50 for x, y in made) and max(len(y) for _, y in made) == 50
    again = list(html_extract._examples(f"<html><body><article>{body}</article></body></html>", 3))
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(made, again, strict=True))
