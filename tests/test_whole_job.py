"""Whole jobs, where a query or an operator once did a part: against plain Python or literal rows."""

import re
from collections import defaultdict

import pytest

from panelwerk.functions.text import ACCENTS
from panelwerk.operators import chains as C
from panelwerk.operators import history as H
from panelwerk.operators import memory as M
from panelwerk.operators import metrics as X
from panelwerk.operators import reports as R
from panelwerk.plans import registry
from panelwerk.plans.book import Tables

SF = "/root/testdata/sf0.001"


def normal(text):
    text = text.replace("ß", "ss").upper()
    for a, b in ACCENTS.items():
        text = text.replace(a, b)
    text = re.sub(r"-[ \t]*\n\s*", "", text)
    return re.sub(r"\s+([!?.,;:])", r"\1", re.sub(r"\s+", " ", text)).strip()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def by_role(pairs):
    sums = defaultdict(lambda: [0, 0])
    for role, h, r in pairs:
        sums[role][0] += edits(normal(h), normal(r))
        sums[role][1] += len(normal(r))
    return {k: (e, n, pytest.approx(e / n)) for k, (e, n) in sums.items()}


def test_error_rates_with_accents(spark):
    pairs = [("a", "Über den Weg", "uber dem Weg"), ("a", "déjà vu", "deja vu"), ("a", "große Straße", "GROSSE STRASSE"), ("b", "señor", "señora"), ("b", "日本語", "日本"), ("b", "plain", "plane")]
    found = X.cer(spark.createDataFrame(pairs, "role string, hypothesis string, reference string"), ["role"]).collect()
    assert {r.role: (r.errors, r.length, r.cer) for r in found} == by_role(pairs)


def test_error_rates_count_every_turn(spark):
    turns = defaultdict(list)
    for r in Tables(spark, SF).conversations.collect():
        turns[r.conv_id].append((r.turn, r.role, r.text))
    pairs = [(a[1], a[2], b[2]) for rows in turns.values() for a, b in zip(sorted(rows), sorted(rows)[1:])]
    assert any(not (h + r).isascii() for _, h, r in pairs)
    found = registry.QUERIES["cer"](spark, SF).collect()
    assert {r.role: (r.errors, r.length, r.cer) for r in found} == by_role(pairs)


def drawn(kind, text, translation):
    bare = lambda x: re.sub(r"[\W_]", "", x.replace("ß", "ss").upper())
    redraw = kind in ("title", "other", "sfx") and bool(text.strip(" ") and translation.strip(" ")) and bare(text) != bare(translation)
    return redraw, redraw or kind in ("speech", "thought", "caption")


def test_redraw_of_sharp_s(spark):
    rows = [(1, "other", "Straße", "STRASSE"), (2, "other", "Straße", "Strafe"), (3, "speech", "Straße", "x"), (4, "sfx", "SPASS!", "Spaß"), (5, "title", "ß", "")]
    found = R.needs_redraw(spark.createDataFrame(rows, "block_id int, kind string, text string, translation string")).collect()
    assert {r.block_id: (r.redraw, r.lettered) for r in found} == {k: drawn(*rest) for k, *rest in rows}


def test_redraw_of_every_block(spark):
    want = {r.block_id: drawn(r.kind, r.text, r.translation) for r in Tables(spark, SF).blocks.collect()}
    found = registry.QUERIES["needs_redraw"](spark, SF).collect()
    assert len(found) == len(want) and {r.block_id: (r.redraw, r.lettered) for r in found} == want


def test_links_in_a_cycle(spark):
    links = {1: 2, 2: 1, 3: 4, 4: 5, 5: 3, 6: 7, 7: 8, 8: None, 9: 9, 10: 99, 11: 13, 12: 13, 13: 12, 14: 15, 15: 16, 16: 14, 17: 14, 99: None}
    blocks = spark.createDataFrame([(1 + (k == 99), k, k, v) for k, v in links.items()], "page_id int, block_id int, position int, continues_id int")
    want = {1: "cycle", 2: "cycle", 3: "cycle", 4: "cycle", 5: "cycle", 9: "self", 10: "other page", 12: "taken", 14: "cycle", 15: "cycle", 16: "cycle", 17: "taken"}
    assert sorted(map(tuple, C.invalid_links(blocks).collect())) == sorted(want.items())


def test_chains_are_planned_as_one(spark):
    rows = [
        (1, 1, 1, "speech", "known", "none", 2), (1, 2, 2, "sfx", "bang", "none", None), (1, 3, 3, "speech", "known", "none", None), (1, 4, 4, "sfx", "bang", "none", None),
        (1, 5, 5, "speech", "a", "edited", 6), (1, 6, 6, "speech", "known", "none", None), (1, 7, 7, "speech", "a", "edited", 8), (1, 8, 8, "speech", "b", "approved", None),
        (1, 9, 9, "speech", "known", "none", 10), (1, 10, 10, "speech", " ", "none", None), (1, 11, 11, "speech", "new", "none", 99),
    ]
    blocks = spark.createDataFrame([(1, *r) for r in rows], "series_id int, page_id int, block_id int, position int, kind string, text string, translation_status string, continues_id int")
    memory = spark.createDataFrame([(1, "KNOWN", "ZNANO")], "series_id int, source string, target string")
    plan = M.translation_plan(blocks, memory)
    found = {r.block_id: (r.head, r.route, r.remembered) for r in plan.collect()}
    assert found == {
        1: (1, "model", None), 2: (1, "model", None), 3: (3, "memory", "ZNANO"), 4: (4, "glossary", None), 5: (5, "model", None), 6: (5, "model", None),
        7: (7, "kept", None), 8: (7, "kept", None), 9: (9, "memory", "ZNANO"), 11: (11, "model", None),
    }
    sheets = spark.createDataFrame([(1, 1, "original", False)], "page_id int, album_id int, kind string, skip boolean")
    totals = M.translation_totals(plan, sheets).first()
    assert (totals.translated, totals.from_memory, totals.by_glossary, totals.by_model) == (6, 2, 1, 3)


def test_pages_are_restored_with_all_columns_and_patches(spark):
    fields = "page_id int, block_id int, position int, text string, source string, ocr_model string, updated_at string"
    rows = [(1, 1, 1, "a", "auto", "m", "t1"), (1, 2, 2, "b", "manual", None, "t2"), (2, 3, 1, "c", "auto", "m", "t3")]
    blocks, patches = spark.createDataFrame(rows, fields), spark.createDataFrame([(1, 7, 1), (2, 8, 3)], "page_id int, patch_id int, block_id int")
    pages = spark.createDataFrame([(1,), (3,)], "page_id int")
    past = spark.createDataFrame([(1, "redo", 4, "x"), (1, "undo", 2, "x")], "page_id int, kind string, position int, action string")
    after = H.snapshot_pages(blocks, past, pages, "clear", patches)
    damaged = spark.createDataFrame([(1, 1, 5, "", "manual", "n", "t9"), rows[2], (3, 4, 1, "d", "auto", "m", "t4")], fields)
    assert sorted(map(tuple, H.restore_pages(after, damaged).collect())) == rows
    marred = spark.createDataFrame([(1, 9, 1), (2, 8, 3), (3, 5, 4)], "page_id int, patch_id int, block_id int")
    assert sorted(map(tuple, H.restore_patches(after, marred).collect())) == [(1, 7, 1), (2, 8, 3)]
    assert {(r.page_id, r.kind, r.position) for r in after.collect()} == {(1, "undo", 2), (1, "undo", 3), (3, "undo", 1)}
