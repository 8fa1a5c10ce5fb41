"""Queries that wrote too much: the same rows by plans that carry less."""

import re

from pyspark.sql import functions as F

from panelwerk.operators import memory as M
from panelwerk.operators import review as V
from panelwerk.plans import registry
from panelwerk.plans import review_queries as Q
from panelwerk.plans.book import Tables

SF = "/root/testdata/sf0.001"


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def written(monkeypatch, module):
    """Columns of what a module's queries write on their way."""
    found, write = [], module.checkpointed
    monkeypatch.setattr(module, "checkpointed", lambda df: (found.append(df.columns), write(df))[1])
    return found


def test_report_writes_no_texts(spark, monkeypatch):
    t = Tables(spark, SF)
    blocks = t.linked_blocks.select(*Q._REVIEWED)
    want = Q._report(t, blocks)
    kept = written(monkeypatch, Q)
    assert same(registry.QUERIES["review_report"](spark, SF), want)
    assert kept and not any("text" in columns for columns in kept)
    assert same(registry.QUERIES["review_summary"](spark, SF), V.review_summary(want, blocks, t.sheets, True))
    assert len(kept) == 2 and not any("text" in columns for columns in kept)


def test_terms_of_rows_by_either_way(spark):
    texts = [(1, 1, "THE BIG CAT"), (2, 1, "BIGGER"), (3, 2, "BIG CAT"), (4, None, "BIG"), (5, 1, ""), (6, 1, None), (7, 9, "BIG")]
    glossary = [(1, "BIG", "VELIK", "approved"), (1, "BIG", "GOLEM", "approved"), (1, "CAT", "MACA", "approved"), (2, "BIG CAT", "TIGAR", "approved"), (2, "CAT", "MACA", "suggested")]
    rows = spark.createDataFrame(texts, "block_id long, series_id int, flat string")
    terms = spark.createDataFrame(glossary, "series_id int, source string, target string, status string")
    for most in (M.AUTOMATON_LETTERS, 1):
        found = {r.block_id: sorted(target for _, target in r.terms or []) for r in M.with_terms(rows, terms, "block_id", most).collect()}
        assert found == {1: ["GOLEM", "MACA", "VELIK"], 2: [], 3: ["TIGAR"], 4: [], 5: [], 6: [], 7: []}


def test_told_report_keeps_blocks_without_a_page(spark):
    rows = [(1, 7, "speech", "THE *CAT*", "x", "draft", None, 1), (2, 7, "sfx", "WHAM", "y", "draft", None, None), (3, 8, "caption", " ", "", "none", None, 1)]
    blocks = spark.createDataFrame(rows, "block_id long, page_id long, kind string, text string, translation string, translation_status string, continues_id long, series_id int")
    terms = spark.createDataFrame([(1, "CAT", "MACKA", "approved")], "series_id int, source string, target string, status string")
    unknown = spark.createDataFrame([(1, 0, "x")], "block_id long, place int, spelling string")
    sounds = spark.createDataFrame([(2, ["WHAM=VHAM"])], "block_id long, proposals array<string>")
    told = V.told_of_texts(blocks, lambda r: M.with_terms(r, terms, "block_id"))
    texts = blocks.where("series_id IS NOT NULL").select("block_id", "series_id", F.upper(F.replace("text", F.lit("*"), F.lit(""))).alias("flat"))
    want = V.review_report(blocks, terms, M.relevant_glossary(texts, terms, "block_id"), unknown, sounds)
    found = V.review_told(told.drop("page_id"), unknown, sounds)
    assert found.columns == want.columns and same(found, want)
    assert {r.block_id: (r.unknown, r.glossary_missing, r.sfx_unconfirmed, r.emphasis_missing) for r in found.collect()} == {1: ("x", "MACKA", "", True), 2: ("", "", "WHAM=VHAM", False), 3: ("", "", "", False)}


def test_chains_are_shuffled_once_and_plans_meet_the_memory_by_tags(spark):
    from panelwerk.operators import chains as C

    long = "WORD " * 60
    rows = [(1, 7, 1, 1, "speech", long + "A", "none", None), (2, 7, 2, 1, "speech", long + "B", "none", 99), (3, 7, 3, 1, "speech", "SHORT", "none", 4), (4, 7, 4, 1, "speech", "END", "edited", 3), (5, 7, 5, 1, "sfx", "SHORT", "none", None), (6, 7, 6, 2, "speech", "SHORT", "none", None), (7, 7, 7, 1, "speech", " ", "none", 1), (8, 7, 8, 1, "speech", "SHORT", "draft", None)]
    blocks = spark.createDataFrame(rows, "block_id long, page_id long, position long, series_id int, kind string, text string, translation_status string, continues_id long")
    memory = spark.createDataFrame([(1, long + "B", "x" * 400), (1, "SHORT", "s"), (2, "SHOR", "t")], "series_id int, source string, target string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(re.findall(r"Exchange hashpartitioning", plan_of(C.resolve_chains(blocks)))) == 1
        for shown in (None, ["page_id"]):
            plan = M.translation_plan(blocks, memory, shown=shown)
            assert ("flat" in plan.columns) == (shown is None)
            found = {r.block_id: (r.head, r.part, r.route, r.remembered and r.remembered[0], r.memory_too_long) for r in plan.collect()}
            assert found == {
                1: (1, 0, "model", None, None), 2: (2, 0, "memory", "x", True), 3: (3, 0, "model", None, False), 4: (3, 1, "model", None, None),
                5: (5, 0, "glossary", "s", False), 6: (6, 0, "model", None, None), 8: (8, 0, "kept", "s", False),
            }
        asked = M.translation_plan(blocks, memory, asked_only=True, shown=["page_id"])
        assert {r.block_id: r.route for r in asked.collect()} == {1: "model", 2: "memory", 3: "model", 4: "model", 5: "glossary", 6: "model"}
        plan = plan_of(registry.QUERIES["translation_plan_of_chains"](spark, SF))
        assert not re.search(r"(Window|collect_list)[^\n]*(flat|text)#", plan)  # chains are resolved without texts
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_requests_write_little_on_the_way(spark, monkeypatch):
    from panelwerk.plans import text_queries as X

    kept = written(monkeypatch, X)
    plan = plan_of(registry.QUERIES["build_requests"](spark, SF))
    assert not kept and "Scan ExistingRDD" not in plan
    registry.QUERIES["follow_up_requests"](spark, SF)
    assert kept and not any("translation" in columns for columns in kept)


def test_context_and_examples_as_before(spark):
    from panelwerk.operators import reports as R
    from panelwerk.plans import text_queries as X

    t = Tables(spark, SF)
    wanted = t.sheets.where("page_id % 3 = 0").select("page_id")
    assert same(X._context(t, wanted), M.previous_page_context(t.sheets, t.blocks).join(wanted, "page_id"))
    rows = [(1, k % 11 * "A" + "B", f"t{k}", k) for k in range(60)] + [(2, "Z", "z", 1), (2, "Z", "last", 2), (2, "Y", " ", 3), (2, " ", "y", 4)]
    approved = spark.createDataFrame(rows, "series_id int, text string, translation string, ord int")
    memory = M.latest_memory(approved).withColumn("ord", F.col("source"))
    assert same(R.memory_examples(M.least_memory(approved).withColumn("ord", F.col("source"))), R.memory_examples(memory))
    assert {r.series_id: r.n for r in M.least_memory(approved).groupBy("series_id").agg(F.count("*").alias("n")).collect()} == {1: 8, 2: 1}


def test_restored_pages_leave_out_before_texts(spark):
    t = Tables(spark, SF)
    assert same(registry.QUERIES["restore_pages"](spark, SF), t.blocks.select("page_id", "block_id", "position", "text", "translation", "source", "ocr_model", "updated_at"))
    gone = t.sheets.where("page_id % 2 = 0").select("page_id")
    assert same(t.blocks_of(gone, how="left_anti"), t.blocks.join(gone, "page_id", "left_anti"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(registry.QUERIES["restore_pages"](spark, SF))
        assert re.findall(r"SortMergeJoin \[(\w+)#[^\n]*LeftAnti", plan) == ["l_orderkey"] * 2  # for blocks with a translation and without, both before they have texts
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_blocks_are_merged_in_one_shuffle(spark):
    from panelwerk.operators import history as H

    rows = [(1, 10, 1, "speech", 0.0, 0.0, 2.0, 2.0, "a", False), (1, 11, 2, "sfx", 3.0, 1.0, 2.0, 5.0, "b", True), (1, 12, 3, "speech", 1.0, 1.0, 1.0, 1.0, " ", False), (2, 20, 1, "speech", 0.0, 0.0, 1.0, 1.0, "c", False), (3, 30, 1, "title", 0.0, 0.0, 1.0, 1.0, "d", True)]
    blocks = spark.createDataFrame(rows, "page_id long, block_id long, position long, kind string, x double, y double, width double, height double, text string, needs_review boolean")
    groups = spark.createDataFrame([(1, 11, 5), (1, 10, 5), (2, 21, 6), (3, 30, 7), (9, 20, 8)], "page_id long, block_id long, group_id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = H.merge_blocks(blocks, groups)
        assert len(re.findall(r"Exchange hashpartitioning", plan_of(found))) == 2  # blocks and groups, by page
        assert same(found, H.merge_blocks(blocks, groups.where("block_id <> 20").drop("page_id")))
        assert {r.block_id: (r.position, r.text, r.width, r.height, r.needs_review) for r in found.collect()} == {10: (1, "a\nb", 5.0, 6.0, True), 12: (2, "", 1.0, 1.0, False), 20: (1, "c", 1.0, 1.0, False), 30: (1, "d", 1.0, 1.0, True)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rejected_rows_read_no_texts_and_agree_with_sound_ones(spark):
    from panelwerk.sources import tables as TB

    assert not re.search(r"FileScan parquet \[doc_id[^\]]*text", plan_of(registry.QUERIES["rejected_rows"](spark, SF)))
    rows = [(1, 7, "speech", "a"), (1, 7, "speech", "b"), (1, 7, "shout", "c"), (1, 7, None, "a"), (2, 7, "sfx", "d"), (None, 7, "sfx", "e"), (None, 8, "sfx", "f")]
    blocks = spark.createDataFrame(rows, "block_id long, page_id long, kind string, text string").selectExpr("*", "1L AS position", "0D AS x", "0D AS y", "1D AS width", "1D AS height")
    sheets = spark.createDataFrame([(7, 1, "original")], "page_id long, album_id long, kind string").selectExpr("*", "1L AS position", "1L AS import_order", "1 AS width", "1 AS height")
    given = {"blocks": TB.conform(blocks, "blocks"), "sheets": TB.conform(sheets, "sheets")}
    sound, broken = TB.checked_tables(given)
    told = sorted((r.key, tuple(r.reasons)) for r in broken.where("table = 'blocks'").collect())
    judged = TB._judged("blocks", given)
    assert judged.columns == [*given["blocks"].columns, "_reasons"]
    assert told == sorted(("" if r.block_id is None else str(r.block_id), tuple(r._reasons)) for r in judged.where(F.size("_reasons") > 0).collect())
    assert told[:2] == [("", ("block_id missing",)), ("", ("block_id missing", "no sheets for page_id"))] and sum("repeated block_id" in r for _, r in told) == 3
    assert sound["blocks"].columns == given["blocks"].columns and sorted(r.block_id for r in sound["blocks"].collect()) in ([2], [1, 2])
    assert not re.search(r"(Sort|Window) [^\n]*(kind|width|to_json)", plan_of(broken))  # what a row's own values tell is told before it is shuffled


def test_plans_meet_no_translations_that_they_do_not_read(spark):
    t = Tables(spark, SF)
    pages = t.sheets.select("page_id")
    assert same(t.blocks_of(pages, linked=True, translations=False), t.linked_blocks.join(pages, "page_id").drop("translation"))
    # texts of blocks, and texts and translations of approved ones (with the documents' largest id, read once for each): no third time
    assert len(re.findall(r"FileScan parquet \[doc_id[^,\]]*,text", plan_of(registry.QUERIES["translation_plan"](spark, SF)))) == 3


def test_restored_pairs_write_no_texts_on_the_way(spark, monkeypatch):
    from panelwerk.operators import geometry as G
    from panelwerk.plans import layout_queries as L

    kept = written(monkeypatch, G)
    found = registry.QUERIES["restore_pairs"](spark, SF)
    assert not any({"pairs", "source", "target"} & set(columns) for columns in kept)
    pairs = L._exported(Tables(spark, SF))[1].select("album_id", F.col("position").alias("page"), F.posexplode("pairs").alias("at", "p"))
    assert same(found.select("album_id", "page", "position", "text"), pairs.select("album_id", "page", (F.col("at") + 1).alias("position"), F.col("p.target").alias("text")))
    rows = spark.createDataFrame([(1, 2, 9, "b", "B"), (1, 1, 8, "a", "A"), (2, 3, 7, "c", "C")], "page int, i int, j int, source string, target string")
    assert {r.page: [tuple(p) for p in r.pairs] for r in G.listed_pairs(rows, ["page"]).collect()} == {1: [(1, 8, "a", "A"), (2, 9, "b", "B")], 2: [(3, 7, "c", "C")]}
