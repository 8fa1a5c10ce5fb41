"""Reports by hand, with rows on which a looser reading of a rule would give another answer."""

from pyspark.sql import functions as F

from panelwerk.operators import reports as R


def test_script_rows(spark):
    sheets = spark.createDataFrame([(1, 9, "original", 1, False), (2, 9, "original", 2, True), (3, 9, "reference", 1, False)], "page_id long, album_id long, kind string, position int, skip boolean")
    rows = [
        (1, 1, 1, "sfx", " BANG\n", "", "none", False, True, None),
        (2, 1, 2, "speech", "  ", "\tSAMO PREVOD ", "draft", True, True, "m"),
        (3, 1, 3, "speech", " \n", "  ", "none", True, True, None),  # neither
        (4, 1, 4, "note", "A", "B" * 99, "lost", False, False, None),  # long, but not noted as such; never read, but not for review
        (5, 1, 5, "speech", None, "X", "edited", None, None, "m"),
        (6, 2, 1, "speech", "A", "B", "none", False, False, "m"),
        (7, 3, 1, "speech", "A", "B", "none", False, False, "m"),
    ]
    blocks = spark.createDataFrame(rows, "block_id long, page_id long, position int, kind string, text string, translation string, translation_status string, translation_too_long boolean, needs_review boolean, ocr_model string")
    found = sorted((r.block_id, r.kind, r.text, r.translation, r.status, r.notes) for r in R.script_rows(sheets, blocks).collect())
    assert found == [
        (1, "sound", "BANG", "", "untranslated", "needs review"),
        (2, "speech", "", "SAMO PREVOD", "draft", "too long, needs review"),
        (4, "note", "A", "B" * 99, "lost", ""),
        (5, "speech", "", "X", "edited", ""),
    ]
    assert {r.block_id for r in R.script_rows(sheets, blocks, skipped=True).collect()} == {1, 2, 4, 5, 6}


def test_processing_totals(spark):
    sheets = spark.createDataFrame([(1, 9, "original", False), (2, 9, "original", True), (3, 9, "original", False), (4, 9, "reference", False)], "page_id long, album_id long, kind string, skip boolean")
    blocks = spark.createDataFrame([(1, True, None), (1, False, None), (2, True, "m"), (4, True, "m"), (1, None, "m")], "page_id long, needs_review boolean, ocr_model string")
    (r,) = R.processing_totals(sheets, blocks).collect()
    assert (r.album_id, r.pages, r.skipped, r.blocks, r.needs_review) == (9, 2, 1, 3, 1)


def test_rating_summary_lists_the_best_first(spark):
    rows = [("s", 1, 2, "a", 3), ("s", 1, 1, "b", 3), ("s", 2, 1, "c", 5), ("s", 2, 2, "a", 4), ("s", 2, 3, "b", 4), ("open", 1, 1, "a", None), ("open", 1, 2, "b", 5)]
    ratings = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rating_id long, study string, item long, turn int, candidate string, score int")
    found = sorted((r.study, r.place, r.candidate, r.average, r.good_share, r.ratings) for r in R.rating_summary(ratings).collect())
    assert found == [("s", 1, "c", 5.0, 1.0, 1), ("s", 2, "b", 3.5, 0.5, 2), ("s", 3, "a", 3.5, 0.5, 2)]


def test_only_long_jobs_have_an_estimate(spark):
    jobs = spark.createDataFrame([(1, "translate_project", "running"), (2, "ai_patch", "running"), (3, "translate_project", "queued"), (4, "export_draw", "running")], "job_id long, type string, status string")
    rows = [(j, s, p, t) for j, t in ((1, 100), (2, 100), (4, 0)) for s, p in ((0, 0), (100, 20))]
    samples = spark.createDataFrame(rows, "job_id long, s int, progress long, total long").withColumn("ts", F.timestamp_seconds("s"))
    found = {r.job_id: (r.seconds_left, r.queued, r.seconds_with_queued) for r in R.queue_eta(samples, jobs).collect()}
    assert found == {1: (400.0, 1, 900.0), 2: (None, 0, None), 4: (None, 0, None)}
