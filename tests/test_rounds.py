"""Faults that only larger or odd tables show: letters whose upper case engines spell differently, ties, jobs cut by their SQL."""

import shutil

import duckdb
import pytest

from panelwerk.plans import registry
from panelwerk.sources.fixtures import TABLES

SF = "/root/testdata/sf0.001"


def both(spark, folder, name):
    """A query's rows, and those of its SQL."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    found = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    twin = con.sql(registry.ORACLE_SQL[name])
    at = [twin.columns.index(c) for c in columns]
    return found, sorted(tuple(str(r[k]) for k in at) for r in twin.fetchall())


def changed(folder, **queries):
    """The smallest tables, some of them replaced by the result of a query over ``old``."""
    for t in TABLES:
        if t in queries:
            duckdb.sql(f"COPY (WITH old AS (SELECT * FROM '{SF}/{t}.parquet') {queries[t]}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        else:
            shutil.copy(f"{SF}/{t}.parquet", folder)
    return folder


@pytest.fixture(scope="module")
def sharp(tmp_path_factory):
    """Tables in which passages begin with words that hold ß, and texts hold these words."""
    words = "CASE item_id % 3 WHEN 0 THEN 'erßie ' WHEN 1 THEN 'Fußball, ' ELSE '' END"
    return changed(
        tmp_path_factory.mktemp("sharp"),
        benchmark=f"SELECT * REPLACE ({words} || text AS text) FROM old",
        documents="SELECT * REPLACE (CASE doc_id % 2 WHEN 0 THEN 'erßie Fußball ' ELSE '' END || text AS text) FROM old",
    )


@pytest.mark.parametrize("name", ["glossary_view", "relevant_glossary", "upsert_glossary", "upsert_lexicon", "upsert_sounds", "seed_sounds", "suggest_entries"])
def test_terms_with_sharp_s(spark, sharp, name):
    found, told = both(spark, sharp, name)
    assert found == told and found


def test_names_of_several_pages(spark, tmp_path):
    folder = changed(tmp_path, pages="SELECT * FROM old UNION ALL SELECT * REPLACE (page_id + 1000000 AS page_id) FROM old ORDER BY page_id % 7, page_id DESC")
    found, told = both(spark, folder, "natural_sort")
    assert found == told and found
    place = {int(page): int(at) for _, page, at in found}
    assert all(place[page] < place[page + 1000000] for page in place if page < 1000000)


def test_editions_lie_together_and_hold_only_boxes(spark):
    from panelwerk.plans import layout_queries as L
    from panelwerk.plans.book import Tables

    t = Tables(spark, SF)
    for side in L._editions(t):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "text" not in plan and "image_path" not in plan
    assert t.block_boxes.count() == t.blocks.count() == t.block_texts.count()
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_plans_keep_only_what_they_read(spark):
    from panelwerk.plans import text_queries as X
    from panelwerk.plans.book import Tables

    t = Tables(spark, SF)
    X._plan(t)
    assert t.blocks.columns == X._PLANNED and t.sheets.columns == X._PAGES


def test_reports_show_every_series_terms(spark):
    terms = duckdb.sql(f"SELECT count(DISTINCT upper(replace(w, 'ß', 'ss'))) FROM (SELECT string_split(replace(replace(text, '.', ''), ',', ''), ' ')[1] AS w FROM '{SF}/benchmark.parquet') WHERE length(w) >= 4").fetchall()[0][0]
    counts = registry.QUERIES["glossary_counts"](spark, SF).collect()
    assert len(counts) == 25 and {r.entries for r in counts} == {terms}
    assert len({r.series_id for r in registry.QUERIES["glossary_view"](spark, SF).collect()}) == 25


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Passages whose first words have no letter, white space at an end, a capital ß, or one key with another of their series (by a sign that keys leave out)."""
    words = "CASE item_id % 7 WHEN 0 THEN '---- ' WHEN 1 THEN 'Word' || chr(10) || ' ' WHEN 2 THEN chr(10) || 'Begun ' WHEN 3 THEN 'Abcd-e ' WHEN 4 THEN 'Abcd_e ' WHEN 5 THEN 'GROẞER ' ELSE '' END"
    return changed(tmp_path_factory.mktemp("odd"), benchmark=f"SELECT * REPLACE ({words} || text AS text) FROM old")


@pytest.mark.parametrize("name", ["upsert_glossary", "upsert_lexicon", "upsert_sounds", "seed_sounds"])
def test_odd_terms(spark, odd, name):
    found, told = both(spark, odd, name)
    assert found == told and found


def test_answers_are_cleaned_once(spark):
    """Each rule of an answer's text stands once in the plan: an expression named twice is run twice."""
    from pyspark.sql import functions as F

    from panelwerk.functions import text as T
    from panelwerk.streaming import activity as A

    rows = spark.createDataFrame([(1, "speech", "Text: una CASA nuova")], "block_id long, kind string, answer string")
    plan = A.clean_answers(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transcription") == 1 and plan.count("{8,}") == 1
    read = rows.select(T.ocr_text(F.col("answer"), F.col("kind")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert read.count("transcription") == 1 and read.count("{8,}") == 1


def test_blocks_shuffle_raw_rows_once(spark):
    """The two parts of blocks read one shuffle by page, which carries no column made of others; untranslated blocks meet no document of translations."""
    from panelwerk.plans.book import Tables

    t = Tables(spark, SF)
    found = t.blocks.select("block_id", "text", "translation", "translation_status")
    plan = found._jdf.queryExecution().executedPlan().toString()
    by_page = [x for x in plan.splitlines() if "hashpartitioning(l_orderkey" in x]
    assert by_page and not [x for x in plan.splitlines() if "Project" in x and " AS d2#" in x and "l_linenumber" in x]
    assert t.blocks.where("translation_status = 'none' AND translation <> ''").count() == 0
    assert sorted(t.blocks.columns) == sorted(t.linked_blocks.drop("continues_id").columns)
    assert t.blocks.count() == t.lineitem.count()


def test_sound_words_meet_no_other_words(spark):
    """A frequent sound word gathers in no task: the texts' words are shuffled by their text alone."""
    from panelwerk.operators import review as V

    texts = spark.createDataFrame([(1, "BANG BANG! CRAAASH"), (2, "AH AH AH"), (3, ""), (4, None), (5, "12 SHH")], "id long, text string")
    glossary = spark.createDataFrame([(1, "BANG", "BUM"), (2, "CRASH", "KRAŠ"), (3, "AH AH AH", "HA-HA-HA!")], "id int, source string, target string")
    found = V.sound_translations(texts, glossary, "id")
    assert sorted(map(tuple, found.collect())) == [(1, "BUM BUM! KRAAAŠ", ["CRAAASH=KRAAAŠ"]), (2, "HA-HA-HA!", []), (3, "", []), (4, "", []), (5, "12 ŠŠ", ["SHH=ŠŠ"])]
    plan = V.sound_translations(texts, spark.sql("SELECT * FROM VALUES (1, 'BANG', 'BUM') AS t(id, source, target)"), "id")._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "hashpartitioning(word" in x]


@pytest.fixture(scope="module")
def spaced(tmp_path_factory):
    """Passages whose first words begin with, end with and hold white space beyond ASCII's (and its vertical tab)."""
    words = "CASE item_id % 5 WHEN 0 THEN chr(160) || 'Begun ' WHEN 1 THEN 'Ended' || chr(12288) || chr(11) || ' ' WHEN 2 THEN 'Two' || chr(8199) || chr(133) || 'parts ' WHEN 3 THEN chr(8232) || 'All' || chr(11) || 'of' || chr(160) || 'it' || chr(5760) || ' ' ELSE '' END"
    return changed(tmp_path_factory.mktemp("spaced"), benchmark=f"SELECT * REPLACE ({words} || text AS text) FROM old")


@pytest.mark.parametrize("name", ["upsert_lexicon", "upsert_sounds"])
def test_white_space_of_all_kinds(spark, spaced, name):
    found, told = both(spark, spaced, name)
    assert found == told and found


def test_automata_are_kept_in_four_bytes():
    """States of a shard take four bytes a number, and building and uniting them holds few copies: the memory of a task's worker."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from panelwerk.llm import collocations as C

    draw = np.random.default_rng(3)
    words = [f"w{k}" for k in range(3000)]
    text = " ".join(words[k] for k in draw.zipf(1.3, 200_000) % 3000)
    rows = pa.RecordBatch.from_pydict({"lang": pa.array(["en"]), "text": pa.array([text])})
    ((made, codes),) = C.shards(iter([rows]))
    assert {a.dtype.itemsize for part in (made.parent, made.label, made.weight) for a in part} == {4}
    states = sum(map(len, made.label))
    tracemalloc.start()
    packed = made.packed(codes, np.array([], np.uint64), 1)
    assert tracemalloc.get_traced_memory()[1] < 90 * states
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    found = C.united(pa.Table.from_batches([packed]), 100)
    assert tracemalloc.get_traced_memory()[1] - before < 55 * states
    tracemalloc.stop()
    assert found["a"].to_pylist()[0] == 200_000


def test_grams_are_counted_by_so_much_text_a_task(spark, monkeypatch):
    """A task holds the grams of a bounded amount of text, however few partitions the pairs lie in; the score stays."""
    from panelwerk.operators import metrics as X

    pairs = spark.range(40).selectExpr("id", "'m' AS g", "repeat('una casa ', 20) AS hypothesis", "repeat('una cosa ', 20) AS reference").coalesce(1)
    whole = X.chrf(pairs, ["g"]).first().chrf
    monkeypatch.setattr(X, "PAIR_LETTERS", 1000)
    dealt = X.chrf(pairs, ["g"])
    assert "REPARTITION_BY_NUM, [plan_id" in (plan := dealt._jdf.queryExecution().executedPlan().toString()) and ", 15)" in plan
    assert dealt.first().chrf == pytest.approx(whole) and 0 < whole < 100


def test_restored_pages_hold_what_is_shown(spark):
    """Snapshots of the query hold the columns that it shows, no boxes."""
    plan = registry.QUERIES["restore_pages"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_discount" not in plan and "translation_status" not in plan
