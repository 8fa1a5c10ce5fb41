"""Inputs made once, terms found by an automaton, linear word sets, hashed joins, grids of boxes and bounded offsets."""

import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwerk.functions.patterns import Automaton, code_points, whole_words
from panelwerk.operators import geometry as G
from panelwerk.operators import memory as M
from panelwerk.plans import registry
from panelwerk.plans.book import Tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["reference_pairs", "edition_pairs", "follow_up_requests", "build_requests", "page_offset", "align_boxes", "translation_totals"])
def test_few_scans(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert 0 < len(re.findall(r"FileScan|Scan ExistingRDD", plan)) < 40


def test_views_are_built_once_and_over_shared_ones(spark):
    t = Tables(spark, SF)
    assert t.sheets is t.sheets
    before = t.edition_b.count()
    t.share("blocks", "sheets")
    plan = t.edition_b._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and plan.count("Scan ExistingRDD") == 2 and t.edition_b.count() == before
    assert spark.sparkContext._jsc.sc().conf().get("spark.cleaner.referenceTracking.cleanCheckpoints") == "true"
    with pytest.raises(AttributeError):
        t.nothing  # noqa: B018


# -- terms


def naive_places(terms, text):
    return sorted((m + len(t) - 1, t) for t in terms for m in range(len(text)) if text.startswith(t, m))


def test_automaton_finds_every_place():
    rng = random.Random(2)
    for _ in range(60):
        terms = sorted({"".join(rng.choice("abÀ ") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))})
        text = "".join(rng.choice("abcÀ ") for _ in range(rng.randint(0, 1500)))
        made = Automaton(terms)
        end, term = made.found(code_points(text))
        assert sorted((e, terms[k]) for e, k in zip(end.tolist(), term.tolist(), strict=True)) == naive_places(terms, text)
    assert len(Automaton([]).found(code_points("abc"))[0]) == 0


def test_whole_words_of_many_texts():
    text, term = whole_words(Automaton(["A", "A B", "B"]), ["A B", "AB", "", "B.A", "XA BX"], lambda p: (p >= 65) & (p <= 90))
    assert list(zip(text.tolist(), term.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (3, 0), (3, 2)]


@pytest.mark.parametrize("most", [10**6, 0], ids=["automaton", "first words"])
def test_terms_that_overlap_or_hold_signs_of_patterns(spark, most):
    texts = [(1, 1, "IL GATTO NERO"), (2, 1, "GATTONE E GATTO"), (3, 2, "IL GATTO NERO"), (4, 1, r"A\EB C.D [X"), (5, 1, ""), (6, 1, None), (7, None, "GATTO"), (8, 1, "ÀGATTO GATTOÝ"), (9, 1, "NERO " * 3000 + "GATTO")]
    terms = [(1, "GATTO", "MAČKA"), (1, "GATTO NERO", "CRNA MAČKA"), (1, "NERO", "CRN"), (1, "GATTO", "MAČAK"), (1, r"A\EB", "Q"), (1, "C.D", "CD"), (1, "[X", "X"), (1, "", "E"), (1, None, "N"), (3, "IL", "TAJ")]
    glossary = spark.createDataFrame([(*t, "approved") for t in terms] + [(1, "IL", "X", "suggested")], "series_id long, source string, target string, status string")
    rows = spark.createDataFrame(texts, "block_id long, series_id long, flat string")
    found = sorted(tuple(r) for r in M.relevant_glossary(rows, glossary, "block_id", most).collect())
    cats = [("GATTO", "MAČAK"), ("GATTO", "MAČKA")]
    signs = [("A\\EB", "Q"), ("C.D", "CD"), ("[X", "X")]
    assert found == [*((1, *c) for c in cats), (1, "GATTO NERO", "CRNA MAČKA"), (1, "NERO", "CRN"), *((2, *c) for c in cats), *((4, *s) for s in signs), *((9, *c) for c in cats), (9, "NERO", "CRN")]


# -- words


@pytest.mark.parametrize("most", [10**6, 0], ids=["sent", "joined"])
def test_unknown_words_first_spelling_and_place(spark, most):
    texts = spark.createDataFrame([(1, "Dan dan Noć-i NOĆ-I, o'k DAN 5 žut"), (2, None), (3, ""), (4, "dan nov Nov")], "k long, text string")
    known = spark.createDataFrame([("dan",), (None,), ("dan",)], "word string")
    allowed = spark.createDataFrame([("žut",)], "word string")
    found = sorted(tuple(r) for r in M.unknown_words(texts, known, allowed, "k", most).collect())
    assert found == [(1, "noć-i", 2, "Noć-i"), (1, "o'k", 4, "o'k"), (4, "nov", 1, "nov")]


def test_a_text_of_a_million_words_takes_seconds(spark):
    text = " ".join(f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}{'efghijklmn'[i // 1000 % 10]}{'opqrstuvwx'[i // 10000 % 10]}" for i in range(1_000_000))
    rows = spark.createDataFrame([(1, text)], "k long, text string")
    word = spark.createDataFrame([("akueo",)], "word string")
    began = time.time()
    assert M.unknown_words(rows, word, word, "k").count() == 99_999
    assert time.time() - began < 60


# -- texts that meet by a hash


def test_lookups_bear_collisions(spark):
    texts = spark.createDataFrame([(1, 7, "AB"), (2, 7, "AC"), (3, 7, "AD"), (4, 8, "AB"), (5, None, "AB"), (6, 7, "ABC")], "id long, series_id long, flat string")
    memory = spark.createDataFrame([(7, "AB", "x"), (7, "AC", "y"), (8, "AB", "z")], "series_id long, source string, target string")
    for digest in (F.xxhash64, lambda c: F.lit(1).cast("long")):
        found = {r.id: r.remembered for r in M.memory_lookup(texts, memory, digest).collect()}
        assert found == {1: "x", 2: "y", 3: None, 4: "z", 5: None, 6: None}
        approved = spark.createDataFrame([(7, "ab", "1", 1), (7, "AC", "2", 1), (7, "AB", "3", 2), (7, "ad", " ", 3)], "series_id long, text string, translation string, ord long")
        assert sorted(tuple(r) for r in M.latest_memory(approved, digest).collect()) == [(7, "AB", "3"), (7, "AC", "2")]


# -- boxes


def made_boxes(seed, many, width=1800, height=2400, size=90):
    rng = np.random.default_rng(seed)
    return np.column_stack([rng.uniform(-50, width, many), rng.uniform(-50, height, many), rng.uniform(0, size, many), rng.uniform(0, size, many)])


def shares(a, b):
    """Overlap by the smaller area of every box of ``a`` with every one of ``b``."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, :2] + a[:, None, 2:], b[None, :, :2] + b[None, :, 2:])
    area = lambda x: x[:, 2] * x[:, 3]
    least = np.minimum.outer(area(a), area(b))
    return np.where(least > 0, np.clip(high - low, 0, None).prod(axis=2) / np.where(least > 0, least, 1), 0)


def greedy_by_hand(score, threshold):
    i, j = np.nonzero(score >= threshold)
    taken, left, right = [], set(), set()
    for s, a, b in sorted(zip(score[i, j].tolist(), i.tolist(), j.tolist(), strict=True), reverse=True):
        if a not in left and b not in right:
            left.add(a), right.add(b), taken.append((a, b))
    return sorted(taken)


def page_of(spark, boxes, name, page=1):
    return spark.createDataFrame([(page, i, *map(float, b)) for i, b in enumerate(boxes)], f"page_id long, {name} long, x double, y double, width double, height double")


def test_matching_is_that_of_all_pairs(spark):
    for seed, many in ((1, 300), (2, 40)):
        a, b = made_boxes(seed, many, 900, 900), made_boxes(seed + 10, many, 900, 900)
        found = G.match_boxes(page_of(spark, a, "i"), page_of(spark, b, "j"), ["page_id"], 0.3).collect()
        assert sorted((r.i, r.j) for r in found) == greedy_by_hand(shares(a, b), 0.3)


def test_a_page_of_20_000_boxes_takes_seconds(spark):
    boxes = made_boxes(3, 20_000, size=30)
    page = page_of(spark, boxes, "i").cache()
    page.count()
    began = time.time()
    assert G.match_boxes(page, page.withColumnRenamed("i", "j"), ["page_id"], 0.9).count() >= 19_000
    detections = page.select("page_id", F.col("i").alias("det_id"), F.lit("text_free").alias("label"), (F.col("i") % 97 / 97).alias("score"), *G.BOX)
    assert 10_000 < G.suppress(detections).count() <= 20_000
    assert time.time() - began < 60


def test_boxes_of_any_size_meet_once(spark):
    boxes = [(0, 0, 5000, 5000), (511, 511, 2, 2), (512, 512, 100, 0), (1024, 0, 512, 512), (-600, -600, 700, 700)]
    a = page_of(spark, boxes, "i")
    left, right = G._prefixed(a, "a_", ["page_id"]), G._prefixed(a, "b_", ["page_id"])
    found = [(r.a_i, r.b_i) for r in G.meeting(left, right, ["page_id"], G.Box.of("a_"), G.Box.of("b_")).where("a_i <> b_i").collect()]
    assert len(found) == len(set(found)) and {(0, 1), (0, 3), (0, 4)} <= set(found) and (1, 3) not in found


def offset_by_hand(source, target, limit=8):
    """(offset, score) by matching all pairs of pages; pages: position to boxes."""
    best = None
    for offset in range(-limit, limit + 1):
        pairs = [(source[p], target[p + offset]) for p in source if p + offset in target]
        if pairs:
            score = sum(len(greedy_by_hand(shares(t, s), 0.3)) / max(len(s), len(t)) for s, t in pairs)
            best = max(best or (-1.0,), (round(score, 9), -abs(offset), -offset))
    return -best[2], best[0]


def test_offsets_are_those_of_the_exhaustive_score(spark):
    rng = random.Random(9)
    rows, there, expected = [], [], {}
    for album in range(6):
        pages = {p: made_boxes(100 * album + p, rng.randint(1, 8), 300, 300, 200) for p in range(1, rng.randint(4, 25))}
        shift = rng.randint(-5, 5)
        other = {p + shift: b[: rng.randint(1, len(b))] + rng.uniform(0, 30) for p, b in pages.items() if rng.random() < 0.8} or {1: made_boxes(1, 2)}
        expected[album] = offset_by_hand(pages, other)
        rows += [(album, p, 1000 * p + k, *map(float, x)) for p, b in pages.items() for k, x in enumerate(b)]
        there += [(album, p, 1000 * p + k, *map(float, x)) for p, b in other.items() for k, x in enumerate(b)]
    schema = "album long, position long, {} long, x double, y double, width double, height double"
    source, target = spark.createDataFrame(rows, schema.format("j")), spark.createDataFrame(there, schema.format("i"))
    found = {r.album: (r.offset, r.score) for r in G.page_offset(source, target, ["album"]).collect()}
    assert found.keys() == expected.keys()
    for album, (offset, score) in expected.items():
        assert found[album][0] == offset and abs(found[album][1] - score) < 1e-8


def test_panels_by_shared_area_or_else_the_nearest_centre(spark):
    panels = [(1, 0, 0.0, 0.0, 100.0, 100.0), (1, 1, 90.0, 0.0, 100.0, 100.0), (1, 2, 900.0, 900.0, 50.0, 50.0), (2, 5, 0.0, 0.0, 1.0, 1.0)]
    blocks = [(1, 1, 10.0, 10.0, 5.0, 5.0), (1, 2, 85.0, 10.0, 30.0, 5.0), (1, 3, 95.0, 0.0, 4.0, 4.0), (1, 4, 700.0, 700.0, 10.0, 10.0), (2, 6, 50.0, 50.0, 1.0, 1.0), (3, 7, 0.0, 0.0, 1.0, 1.0)]
    box = "x double, y double, width double, height double"
    found = G.assign_panel(spark.createDataFrame(blocks, f"page_id long, block_id long, {box}"), spark.createDataFrame(panels, f"page_id long, panel int, {box}")).collect()
    assert {r.block_id: r.panel for r in found} == {1: 0, 2: 1, 3: 1, 4: 2, 6: 5, 7: None}


def test_suppression_by_hand(spark):
    rng = random.Random(5)
    rows = [(p, 100 * p + k, rng.choice(["bubble", "text_bubble", "text_free"]), rng.randint(0, 9) / 9, *map(float, b)) for p in (1, 2) for k, b in enumerate(made_boxes(p, 60, 250, 250))]
    det = spark.createDataFrame(rows, "page_id long, det_id long, label string, score double, x double, y double, width double, height double")
    kept = defaultdict(list)
    for p, d, label, s, x, y, w, h in sorted(rows, key=lambda r: (-r[3], r[1])):
        own, group = np.array([[x, y, w, h]]), (p, label == "bubble")
        if not any(iou(own, o) > 0.5 for _, o in kept[group]):
            kept[group].append((d, own))
    assert {r.det_id for r in G.suppress(det).collect()} == {d for g in kept.values() for d, _ in g}


def iou(a, b):
    low, high = np.maximum(a[0, :2], b[0, :2]), np.minimum(a[0, :2] + a[0, 2:], b[0, :2] + b[0, 2:])
    shared = np.clip(high - low, 0, None).prod()
    union = a[0, 2:].prod() + b[0, 2:].prod() - shared
    return shared / union if union > 0 else 0.0


def first_pair_first(boxes):
    """Merging as the rule is said: look for the first near pair, merge it into the first of both, begin again."""
    boxes = [tuple(b) for b in boxes]
    while True:
        near = [
            (i, j)
            for i, a in enumerate(boxes)
            for j, b in enumerate(boxes)
            if i < j and min(a[3], b[3]) - max(a[1], b[1]) >= 0.25 * min(a[3] - a[1], b[3] - b[1]) and max(a[0], b[0]) - min(a[2], b[2]) <= 0.75 * min(a[3] - a[1], b[3] - b[1])
        ]
        if not near:
            return sorted(boxes)
        i, j = near[0]
        a, b = boxes[i], boxes.pop(j)
        boxes[i] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))


def test_merging_takes_the_first_pair_first():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        corners = rng.integers(0, 60, (rng.integers(1, 25), 2))
        boxes = np.hstack([corners, corners + rng.integers(0, 14, corners.shape)]).astype(float)
        assert sorted(map(tuple, G._joined(boxes, 0.25, 0.75))) == first_pair_first(boxes)


def test_merging_many_boxes_takes_seconds():
    boxes = made_boxes(4, 8000, 60_000, 60_000, 40)
    boxes[:, 2:] += boxes[:, :2]
    began = time.process_time()
    assert 100 < len(G._joined(boxes, 0.25, 0.75)) < 8000
    assert time.process_time() - began < 30
