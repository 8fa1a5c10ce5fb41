"""Queries whose shuffle, reads or memory grew too fast: the same rows by plans that carry less."""

import re

from pyspark.sql import functions as F

from panelwerk.operators import memory as M
from panelwerk.operators import reports as R
from panelwerk.plans import registry
from panelwerk.plans.book import Tables

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (hash|range)partitioning", plan_of(df)))


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_script_meets_pages_before_texts(spark):
    t = Tables(spark, SF)
    assert same(registry.QUERIES["script_rows"](spark, SF), R.script_rows(t.sheets, t.blocks))
    pages = R.script_pages(t.sheets)
    met = t.blocks_of(pages)
    assert same(met, t.blocks.join(pages, "page_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        last = re.search(r"SortMergeJoin \[(\w+)#", plan_of(registry.QUERIES["script_rows"](spark, SF)))
        assert last[1] in ("d1", "d2")  # not page_id: texts are not shuffled again
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rating_summary_gathers_no_study(spark):
    rows = [(1, 1, 1, 1, "a", 5), (1, 1, 2, 2, "b", 4), (2, 1, 1, 3, "a", None), (2, 1, 2, 4, "b", 3)]
    ratings = spark.createDataFrame(rows, "study int, item long, turn long, rating_id long, candidate string, score int")
    found = R.rating_summary(ratings)
    assert {(r.study, r.candidate, r.average, r.place) for r in found.collect()} == {(1, "a", 5.0, 1), (1, "b", 4.0, 2)}
    assert "Join" not in plan_of(found)


def test_totals_plan_only_what_is_asked(spark):
    rows = [(1, 1, 1, 1, "speech", "A", "", "none"), (2, 1, 2, 1, "speech", "B", "x", "draft"), (3, 2, 1, 1, "sfx", "C", "", "none"), (4, 2, 2, 1, "speech", "M*O*", "", "none"), (5, 2, 3, 1, "speech", " ", "", "none")]
    blocks = spark.createDataFrame(rows, "block_id long, page_id long, position long, series_id int, kind string, text string, translation string, translation_status string")
    memory = spark.createDataFrame([(1, "MO", "longer than thirteen letters")], "series_id int, source string, target string")
    sheets = spark.createDataFrame([(1, 7, "original", False), (2, 7, "original", False), (3, 8, "original", False), (4, 8, "original", True)], "page_id long, album_id long, kind string, skip boolean")
    asked = M.translation_plan(blocks, memory, asked_only=True)
    assert {r.block_id: r.route for r in asked.collect()} == {1: "model", 3: "glossary", 4: "memory"}
    want = {7: (2, 3, 1, 1, 1, 1), 8: (1, 0, 0, 0, 0, 0)}
    for plan in (asked, M.translation_plan(blocks, memory)):
        assert {r.album_id: tuple(r)[1:] for r in M.translation_totals(plan, sheets).collect()} == want
    assert "Scan ExistingRDD" not in plan_of(registry.QUERIES["translation_totals"](spark, SF))  # nothing is written on the way


def test_plan_of_chains_writes_nothing_on_the_way(spark):
    assert "Scan ExistingRDD" not in plan_of(registry.QUERIES["translation_plan_of_chains"](spark, SF))
    blocks = spark.createDataFrame([(1, 1, 1, 1, "speech", "A", "none", 2), (2, 1, 2, 1, "speech", "B", "approved", None), (3, 1, 3, 1, "speech", "C", "approved", None)], "block_id long, page_id long, position long, series_id int, kind string, text string, translation_status string, continues_id long")
    memory = spark.createDataFrame([(1, "C", "c")], "series_id int, source string, target string")
    found = {r.block_id: (r.head, r.part, r.route, r.remembered) for r in M.translation_plan(blocks, memory).collect()}
    assert found == {1: (1, 0, "model", None), 2: (1, 1, "model", None), 3: (3, 0, "kept", "c")}
    assert {r.block_id for r in M.translation_plan(blocks, memory, asked_only=True).collect()} == {1, 2}


def test_rows_without_a_reference_are_spread(spark):
    from panelwerk.sources import tables as TB

    rows = [(k, 1, None if k > 3 else k - 1) for k in range(1, 4001)] + [(9, 1, None)]
    blocks = TB.conform(spark.createDataFrame(rows, "block_id long, page_id long, continues_id long").selectExpr("*", "'speech' AS kind", "1L AS position", "0D AS x", "0D AS y", "1D AS width", "1D AS height"), "blocks")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sound, broken = TB.checked_tables({"blocks": blocks})
        assert sorted(tuple(r) for r in broken.collect()) == [("blocks", "1", ["no blocks for continues_id"]), ("blocks", "9", ["repeated block_id"])]
        assert sound["blocks"].columns == blocks.columns and sound["blocks"].count() == 3999
        plan = plan_of(broken)
        assert not re.search(r"(Sort|Window) .*to_json", plan)  # the row is not carried to be sorted by
        assert not re.search(r"hashpartitioning\(continues_id", plan)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_store_reads_each_batch_alone(spark, monkeypatch):
    from panelwerk.plans import state_queries as S

    plans, make = [], S.MS.memory_writer

    def writer(folder):
        write = make(folder)
        return lambda rows, n: (plans.append(plan_of(rows)), write(rows, n))

    monkeypatch.setattr(S.MS, "memory_writer", writer)
    assert same(registry.QUERIES["memory_store"](spark, SF), registry.QUERIES["latest_memory"](spark, SF))
    assert len(plans) == 7 and not any("Join" in p for p in plans) and all("PartitionFilters: [isnotnull(batch" in p for p in plans)


def test_tables_are_written_compressed_and_patches_need_no_texts(spark):
    files = registry.QUERIES["load_tables"](spark, SF).inputFiles()
    assert files and all(".zstd." in f for f in files)
    assert "text" not in plan_of(Tables(spark, SF).patches)


def test_upsert_meets_in_one_aggregate(spark):
    memory = spark.createDataFrame([(1, "A", "old", 1), (1, "A", "last", 2), (1, "B", "b", 1), (2, "C", "c", 5)], "series_id long, source string, target string, ord long")
    approved = spark.createDataFrame([(1, "b", "new", 1), (1, "b", "newest", 2), (2, "d", " ", 3), (2, "*d*", "d", 4)], "series_id int, text string, translation string, ord int")
    found = M.upsert_memory(memory, approved)
    assert "Join" not in plan_of(found) and shuffles(found) == 1
    assert sorted(map(tuple, found.collect())) == [(1, "A", "last"), (1, "B", "newest"), (2, "C", "c"), (2, "D", "d")]


def test_unknown_words_read_no_texts_of_blocks(spark):
    t = Tables(spark, SF)
    assert same(t.block_translations.select("block_id", "translation"), t.blocks.select("block_id", "translation"))
    plan = plan_of(registry.QUERIES["unknown_words"](spark, SF))
    assert len(re.findall(r"FileScan parquet \[doc_id[^,\]]*,text", plan)) == 1


def test_glossary_requests_flatten_once(spark):
    plan = plan_of(registry.QUERIES["glossary_requests"](spark, SF))
    assert plan.count("(?U)\\s+") == 1


def test_review_summary_meets_series_before_texts(spark):
    from panelwerk.operators import review as V
    from panelwerk.plans import review_queries as Q

    t = Tables(spark, SF)
    blocks = t.linked_blocks.select(*Q._REVIEWED)
    assert same(registry.QUERIES["review_summary"](spark, SF), V.review_summary(Q._report(t, blocks), blocks, t.sheets, True))
    rows = spark.createDataFrame([(1, "speech", "A", "a", "draft", None)], "block_id long, kind string, text string, translation string, translation_status string, continues_id long")
    none = spark.createDataFrame([], "block_id long, source string, target string, place int, spelling string, proposals array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(V.review_report(rows, none, none.select("block_id", "source", "target"), none.select("block_id", "place", "spelling"), none.select("block_id", "proposals")))
        assert "text#" not in plan.split("SortMergeJoin")[0]  # all that texts tell stands below the joins
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
