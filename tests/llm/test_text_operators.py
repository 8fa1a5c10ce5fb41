"""Quality classifier, HTML extraction, line rules and the pipeline."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwerk.llm import html_extract, quality_classifier, quality_rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeats(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    return len({p for i, g in enumerate(grams) if g in twice for p in (i, i + 1, i + 2)})


def test_line_rules_counts(spark):
    texts = [None, "", " \n\t", "a a a a", "one two three\none two three\n\none two three", " ".join(["of"] * 60), "x" * 100000, "\n".join(f"w{i} w{i + 1} w{i % 9} q" for i in range(400)), "a | b | c | d\nplain line here.", "a b c " * 40 + "d e f " * 40 + " ".join(map(str, range(2000)))]
    texts += [" ".join(str((i * i) % m) for i in range(3 * m)) for m in (5, 40, 90)]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    rows = sorted(quality_rules.line_quality(docs).collect(), key=lambda r: r.doc_id)
    assert rows[0].kept is True
    for r, t in zip(rows, texts, strict=True):
        words = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert r.lq_n_words == len(words) and r.lq_word_chars == sum(map(len, words))
        assert r.lq_n_symbols == sum(c in "#*$%&|<>" for c in t or "") and r.lq_n_dup_lines == len(lines) - len(set(lines))
        assert r.lq_n_repeat_words == brute_repeats(words), t
        assert r.lq_base_failed == (len(words) < 50 or 100 * brute_repeats(words) > 50 * len(words))
    assert quality_rules.line_quality(docs.limit(0)).count() == 0


def test_line_rules_remove_lines_and_reject(spark):
    prose = "\n".join("Some clean words are said here and nothing is amiss in them at all." for _ in range(1)) + "\n" + " ".join(f"word{i}" for i in range(60)) + "."
    texts = [prose + "\nHome | About | Contact | Help\nAll Rights Reserved 2020", "\n".join(f"a{i} | b{i} | c{i} | d{i} | e{i}" for i in range(30)), " ".join(f"W{i}!!" for i in range(80)), " ".join(f"w{i}*** x{i}$$$" for i in range(60))]
    rows = sorted(quality_rules.line_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    assert [r.lq_kept for r in rows] == [True, False, False, False]
    assert rows[0].lq_text == prose and rows[0].lq_n_lines_removed == 2


def test_classifier_on_held_out_rows(spark):
    rows = quality_classifier.op1_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (None, "a b", 0.3), (2, "", 0.2)], "doc_id long, text string, score2 double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    weights = quality_classifier.train(docs, none)
    rows = quality_classifier.score_texts(docs, weights).collect()
    assert [r.score for r in rows] == [0.5] * 4
    labels = spark.createDataFrame([(1, None, 0), (2, 1, 0), (2, 0, 0), (None, 1, 0)], none.schema)
    assert len(quality_classifier.train(docs, labels)) == 2**quality_classifier.BITS + 1
    assert quality_classifier.score_texts(docs.limit(0), weights).count() == 0


def test_ftrl_learns_a_sign():
    samples = [(np.array([1, 2]), 1), (np.array([3, 2]), 0)] * 50
    weights = quality_classifier.train_ftrl(samples)
    assert weights[1] > 0 > weights[3]


@pytest.fixture(scope="module")
def trees(spark):
    return html_extract.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_extraction_of_known_articles(spark, trees):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = html_extract.extract_text(pages, trees).collect()
    from html import unescape

    wrong = 0
    for r in rows:
        inner = r.html[r.html.index("<article>") : r.html.index("</article>")].replace("<br>", " ")
        parts = (" ".join(unescape(x).split()) for x in re.split(r"<(?!/?b>)[^>]*>|</?b>", inner))
        wrong += r.text != "\n".join(p for p in parts if p)
    assert wrong <= 0.02 * len(rows)


def test_extraction_of_other_layouts(spark, trees):
    said = ["A first paragraph of the story, long enough to be read. It has two sentences.", "A second one follows &amp; goes on for some more words, as stories do."]
    body = "".join(f"<p>{x}</p>" for x in said)
    links = "<ul>" + "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(6)) + "</ul>"
    page = f"""<html><body><div class="navbar">{links}</div><div class="cookie-notice"><p>We use cookies on this site.</p><button>OK</button></div>
    <div class="content"><h1>The title of it</h1>{body}</div><div class="comments"><h3>Comments</h3><div><p>I do not agree with this at all.</p></div></div>
    <aside class="sidebar">{links}</aside><form><p>Subscribe to our letter</p><input></form><footer>&copy; someone</footer></body></html>"""
    odd = [None, "", "no tags at all", "<p>", "<script>var a = '<p>x</p>'", "<article><p>a&nbsp;b\n c <b>d<br>e</p></article>" * 1, "<div " * 50, "<" * 1000]
    pages = spark.createDataFrame(list(enumerate([page, *odd])), "page_id long, html string")
    rows = [r.text for r in sorted(html_extract.extract_text(pages, trees).collect(), key=lambda r: r.page_id)]
    assert rows[0] == "The title of it\n" + said[0] + "\n" + said[1].replace("&amp;", "&")
    assert rows[1] == rows[2] == "" and rows[5] == "" and all(r is not None for r in rows)
    assert html_extract.extract_text(pages.limit(0), trees).count() == 0
    assert html_extract.train(pages.limit(0)) is None


def test_decoding_never_keeps_below_a_dropped_node():
    draw = np.random.default_rng(0)
    for _ in range(50):
        n = int(draw.integers(1, 30))
        parent = [-1, *(int(draw.integers(0, i)) for i in range(1, n))]
        odds = draw.normal(size=n)
        keep = html_extract.decode(parent, odds)
        assert all(keep[parent[i]] for i in range(1, n) if keep[i])
        if n <= 12:  # the best of all consistent sets
            best = max(sum(odds[i] for i in range(1, n) if m >> i & 1) for m in range(1, 1 << n, 2) if all(m >> parent[i] & 1 for i in range(1, n) if m >> i & 1))
            assert abs(sum(odds[i] for i in range(1, n) if keep[i]) - best) < 1e-9


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = before = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == before.columns
        if k < 3:
            assert docs.count() < before.count()
        if k == 2:
            from panelwerk.llm import simhash

            found = simhash.near_duplicates(before)
            assert docs.count() == found.select(F.coalesce("component_id", "fp")).distinct().count()
        before = docs
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def brute_ftrl(samples, passes=quality_classifier.PASSES):
    """The update rule, a coordinate at a time."""
    q = quality_classifier
    z, n = {}, {}
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= q.L1 else -(z[i] - np.sign(z[i]) * q.L1) / ((q.BETA + n[i] ** 0.5) / q.ALPHA + q.L2)
    for _ in range(passes):
        for found, label in samples:
            x = {int(i): q.SCALE * c / max(1, len(found)) for i, c in Counter(found.tolist()).items()}
            x[1 << q.BITS] = 1.0
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                s = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / q.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - s * w[i], n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_training_and_scores_are_brute_force(spark, tmp_path):
    draw = np.random.default_rng(1)
    texts = [" ".join(draw.choice(["good", "bad", "the", "Is", "7", "!", "of"], size=int(draw.integers(0, 30)))) for _ in range(60)]
    found = [quality_classifier.features(t, quality_classifier._Codes()) for t in texts]
    samples = [(f, int("good" in t)) for f, t in zip(found, texts, strict=True)]
    weights, want = quality_classifier.train_ftrl(samples), brute_ftrl(samples)
    assert {int(i) for i in np.flatnonzero(weights)} == {i for i, v in want.items() if v} and all(abs(weights[i] - v) < 1e-9 for i, v in want.items())
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate([*texts, "", None, "bad " * 300_000])], "doc_id long, text string, score double")
    rows = quality_classifier.score_texts(docs, weights.astype(np.float32)).collect()
    for r in rows:
        own = quality_classifier.features(r.text, quality_classifier._Codes())
        odds = want[1 << quality_classifier.BITS] + quality_classifier.SCALE * sum(want.get(int(i), 0.0) for i in own) / max(1, len(own))
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(odds, -35, 35)))) < 1e-4 and r.score_ == 0.5


def test_page_columns_of_clashing_names_are_kept(spark, trees):
    pages = spark.createDataFrame([(1, "<p>x</p>", "a", "b")], "page_id long, html string, text string, n_chars string")
    row = html_extract.extract_text(pages, trees)
    assert row.columns == ["page_id", "html", "text_", "n_chars", "text"] and row.first().text_ == "a"


def test_long_repeated_and_empty_pages(spark, trees, tmp_path):
    body = "".join(f"<p>Paragraph {k} of a long story, with a sentence. And one more.</p>" for k in range(30_000))
    page = f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Story</h1>{body}</article><footer>&copy; us</footer></body></html>"
    assert len(page) > 2_000_000
    pages = spark.createDataFrame([(1, page), (2, page), (3, None)], "page_id long, html string")
    rows = {r.page_id: r.text for r in html_extract.extract_text(pages, trees).collect()}
    assert rows[1] == rows[2] and rows[1].count("\n") == 30_000 and rows[1].startswith("Story\nParagraph 0 ") and "Home" not in rows[1] and rows[3] == ""
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert html_extract.op2_html_extraction(spark, str(tmp_path)).count() == 0


def test_op2_query_on_known_articles(spark):
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = html_extract.op2_html_extraction(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    wrong = 0
    for r in rows:
        page = pages[r.page_id]
        inner = page[page.index("<article>") : page.index("</article>")].replace("<br>", " ")
        parts = (" ".join(unescape(x).split()) for x in re.split(r"<(?!/?b>)[^>]*>|</?b>", inner))
        wrong += r.text != "\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)
    assert wrong == 0


def test_pages_of_plain_divisions_are_extracted_alike(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")
    plain = pages.withColumn("html", F.replace(F.replace("html", F.lit("<article>"), F.lit('<div class="content">')), F.lit("</article>"), F.lit("</div>")))
    want = {r.page_id: r.text for r in html_extract.extract_text(pages, html_extract.train(pages)).collect()}
    got = {r.page_id: r.text for r in html_extract.extract_text(plain, html_extract.train(plain)).collect()}
    assert sum(got[k] == want[k] for k in want) >= 0.98 * len(want)


def test_rules_keep_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(80)) + ".", "a", "b")], "doc_id long, text string, lq_text string, lq_kept string")
    row = quality_rules.line_quality(docs).first()
    assert (row.lq_text_, row.lq_kept_, row.lq_kept) == ("a", "b", True)
    cleaned = quality_rules.cleaned_documents(docs)
    assert cleaned.columns == docs.columns and tuple(cleaned.first())[2:] == ("a", "b")


def test_rules_in_four_languages(spark):
    prose = " ".join(f"word{i}" for i in range(80)) + "."
    lines = ["Mentions légales et conditions d'utilisation", "Datenschutzerklärung", "Política de privacidad", "All rights reserved"]
    docs = spark.createDataFrame([(k, f"{prose}\n{x}") for k, x in enumerate(lines)], "doc_id long, text string")
    assert [r.lq_text for r in quality_rules.line_quality(docs).orderBy("doc_id").collect()] == [prose] * 4


def test_op3_query_repeats_and_nulls(spark, tmp_path):
    texts = [None, "", "one two " * 100, " ".join(str(i) for i in range(70)), " ".join(str(i) for i in range(70))]
    spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted((r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules.op3_line_quality_rules(spark, str(tmp_path)).collect())
    assert rows == [(0, 0, True, False), (0, 0, True, False), (70, 0, False, True), (70, 0, False, True), (200, 200, True, False)]


def test_pipeline_with_nulls_repeats_and_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    odd = docs.limit(40).select(F.lit(None).cast("long").alias("doc_id"), "text", "lang", F.lit(None).cast("string").alias("source"), "n_chars")
    blank = docs.limit(3).withColumn("text", F.lit(None).cast("string"))
    some = docs.unionByName(odd).unionByName(blank).unionByName(docs.limit(30))
    for name, table in (("some", some), ("none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert rows and all(r.n_tokens > 0 for r in rows) and max(Counter(r.doc_id for r in rows if r.doc_id is not None).values()) <= 2
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
