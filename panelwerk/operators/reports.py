"""Reports over albums, sheets (pages), blocks, jobs and ratings: filters, counts, windows.

Plain functions from DataFrames to DataFrames. Everything is declared with joins, aggregates and windows on album or page
keys, so a report runs over all albums at once; tables of one row per album join what one album's page shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Codes and their labels (fixed values).
DIALOGUE = ("speech", "thought", "caption")
REDRAWN = ("title", "other", "sfx")
LONG_JOBS = ("process_project", "translate_project", "clean_project", "prepare_project", "export_draw")
STATUS_LABELS = {"none": "untranslated", "draft": "draft", "edited": "edited", "approved": "approved"}
KIND_LABELS = {"speech": "speech", "thought": "thought", "caption": "caption", "sfx": "sound", "other": "sign", "title": "title"}


def labelled(column: Column, labels: dict[str, str]) -> Column:
    """A code's label, or the code itself."""
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(table[column], column)


def active_pages(sheets: DataFrame) -> DataFrame:
    return sheets.where("kind = 'original' AND NOT skip")


def album_pages(sheets: DataFrame, skipped: bool = True, first: int | None = None, last: int | None = None) -> DataFrame:
    """Original pages in a range of positions; ``skipped``: also those marked to be left out."""
    found = sheets.where("kind = 'original'")
    if not skipped:
        found = found.where("NOT skip")
    if first is not None:
        found = found.where(F.col("position") >= first)
    if last is not None:
        found = found.where(F.col("position") <= last)
    return found


def script_rows(sheets: DataFrame, blocks: DataFrame, skipped: bool = False) -> DataFrame:
    """Blocks of an album's pages with a text or a translation, both trimmed, with labels and the notes that the block's flags give."""
    return script_of(blocks.join(script_pages(sheets, skipped), "page_id"))


def script_pages(sheets: DataFrame, skipped: bool = False) -> DataFrame:
    """(page_id, album_id, page): the pages that a script is of."""
    return album_pages(sheets, skipped).select("page_id", "album_id", F.col("position").alias("page"))


def script_of(blocks: DataFrame) -> DataFrame:
    """``script_rows`` of blocks that have the columns of ``script_pages``."""
    bare = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)^\s+|\s+\z", "")
    rows = blocks.withColumns({"text": bare("text"), "translation": bare("translation")}).where("text <> '' OR translation <> ''")
    notes = F.concat_ws(", ", F.when(F.col("translation_too_long"), "too long"), F.when(F.col("needs_review"), "needs review"))
    return rows.select(
        "album_id",
        "page",
        "position",
        "block_id",
        labelled(F.col("kind"), KIND_LABELS).alias("kind"),
        "text",
        "translation",
        labelled(F.col("translation_status"), STATUS_LABELS).alias("status"),
        notes.alias("notes"),
    )


def script_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("album_id", "status").agg(F.count("*").alias("blocks"))


def glossary_counts(glossary: DataFrame, needle: str) -> DataFrame:
    """Entries per series and status, and how many of them hold ``needle`` in source or target."""
    hit = F.col("source").contains(needle) | F.col("target").contains(needle)
    return glossary.groupBy("series_id", "status").agg(F.count("*").alias("entries"), F.count_if(hit).alias("found"))


def glossary_view(glossary: DataFrame, status: str | None = None, needle: str = "") -> DataFrame:
    """Entries of a status (or all) that hold ``needle`` in source or target, with their ``place`` in the series' list.

    Suggested entries are listed by falling occurrences, all others by source and target.
    """
    rows = glossary if status is None else glossary.where(F.col("status") == status)
    rows = rows.where(F.col("source").contains(needle) | F.col("target").contains(needle))
    often = -F.coalesce("occurrences", F.lit(0)) if status == "suggested" else F.lit(0)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("series_id").orderBy(often, "source", "target")))


def needs_redraw(blocks: DataFrame) -> DataFrame:
    """Blocks with ``redraw`` (a sign, title or sound whose letters and digits change) and ``lettered``."""
    bare = lambda c: F.regexp_replace(T.upper(F.col(c)), r"[^\p{L}\p{N}]", "")
    redraw = F.col("kind").isin(*REDRAWN) & (F.trim("text") != "") & (F.trim("translation") != "") & (bare("text") != bare("translation"))
    return blocks.withColumn("redraw", redraw).withColumn("lettered", F.col("kind").isin(*DIALOGUE) | F.col("redraw"))


def unread_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where("source = 'auto' AND ocr_model IS NULL")


def stale_pages(sheets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Active pages with blocks that were never cleaned, or not since their last edit."""
    edits = blocks.groupBy("page_id").agg(F.max("updated_at").alias("edited_at"))
    return sheets.where("NOT skip").join(edits, "page_id").where("cleaned_at IS NULL OR edited_at > cleaned_at")


def uncovered_blocks(sheets: DataFrame, blocks: DataFrame, patches: DataFrame) -> DataFrame:
    """Signs, titles and sounds of active pages without a patch of their own."""
    pages = active_pages(sheets).select("page_id", "album_id", F.col("position").alias("page"))
    rows = blocks.where(F.col("kind").isin(*REDRAWN)).join(pages, "page_id").join(patches.select("block_id"), "block_id", "left_anti")
    return rows.select("album_id", "page", "page_id", "block_id", (F.trim("translation") != "").alias("translated"))


def album_progress(sheets: DataFrame, blocks: DataFrame) -> DataFrame:
    """How far each album is, step by step; skipped pages do not count."""
    originals = sheets.where("kind = 'original'")
    per_page = blocks.groupBy("page_id").agg(
        F.count_if(F.expr("source = 'auto' AND ocr_model IS NULL")).alias("unread"),
        *(F.count_if((F.col("text") != "") & (F.col("translation_status") == s)).alias(s) for s in STATUS_LABELS),
        F.lit(1).alias("has_blocks"),
    )
    rows = originals.join(per_page, "page_id", "left").withColumn("active", ~F.col("skip"))
    total = lambda c: F.coalesce(F.sum(F.when(F.col("active"), F.col(c))), F.lit(0)).alias(c)
    done = rows.groupBy("album_id").agg(
        F.count_if("active").alias("pages"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("skip"), F.col("position")))), lambda p: p.cast("string")), ",").alias("skipped"),
        F.count_if(F.col("active") & (F.col("has_blocks") == 1) & (F.col("unread") == 0)).alias("read_pages"),
        total("unread"),
        *(total(s) for s in STATUS_LABELS),
        F.count_if(F.col("active") & F.col("translation_reviewed")).alias("proofread"),
        F.count_if(F.col("active") & F.col("cleaned_at").isNotNull()).alias("cleaned"),
    )
    return done.withColumn("blocks", F.col("none") + F.col("draft") + F.col("edited") + F.col("approved")).withColumnRenamed("none", "untranslated")


def album_freshness(sheets: DataFrame, blocks: DataFrame, exported: DataFrame) -> DataFrame:
    """Last export, last change of an active page or block, and whether the album changed since the export.

    ``exported``: (album_id, finished_at).
    """
    pages = active_pages(sheets).select("page_id", "album_id", "cleaned_at")
    edits = blocks.groupBy("page_id").agg(F.max("updated_at").alias("edited_at"))
    changed = pages.join(edits, "page_id", "left").groupBy("album_id").agg(F.greatest(F.max("cleaned_at"), F.max("edited_at")).alias("changed_at"))
    last = exported.groupBy("album_id").agg(F.max("finished_at").alias("exported_at"))
    return changed.join(last, "album_id", "left").withColumn("outdated", F.coalesce(F.col("changed_at") > F.col("exported_at"), F.lit(False)))


def ai_cost(jobs: DataFrame) -> DataFrame:
    paid = jobs.where("type = 'ai_patch' AND status = 'done'")
    return paid.groupBy("album_id").agg(F.count("*").alias("calls"), F.bround(F.sum(F.coalesce("cost", F.lit(0.0))), 4).alias("cost"))


def album_summary(albums: DataFrame, sheets: DataFrame) -> DataFrame:
    """Pages by kind, the cover (first original page) and its version (12 characters of its file's stem) of every album, newest first by ``place``."""
    stem = F.regexp_replace(F.regexp_extract("image_path", r"([^/]*)\z", 1), r"(?<=.)\.[^.]*\z", "")
    sheets = sheets.withColumn("version", F.left(stem, F.lit(12)))
    original = F.col("kind") == "original"
    counts = sheets.groupBy("album_id").agg(
        F.count_if(original).alias("page_count"),
        F.count_if(~original).alias("reference_page_count"),
        F.min_by("page_id", F.when(original, F.col("position"))).alias("cover_page_id"),
        F.min_by("version", F.when(original, F.col("position"))).alias("cover_version"),
    )
    rows = albums.select("album_id", "series_id", "original_title").join(counts, "album_id", "left").na.fill(0, ["page_count", "reference_page_count"])
    rows = rows.na.fill("", ["cover_version"])
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("album_id"))))


def readiness(sheets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per original page: dialogue with text, how much of it is untranslated, and what is left to do."""
    spoken = blocks.where(F.col("kind").isin(*DIALOGUE) & (F.trim("text") != ""))
    per_page = spoken.groupBy("page_id").agg(F.count("*").alias("dialogue"), F.count_if(F.trim("translation") == "").alias("untranslated"))
    rows = sheets.where("kind = 'original'").join(per_page, "page_id", "left").na.fill(0, ["dialogue", "untranslated"])
    return rows.select("album_id", "page_id", "position", "skip", "dialogue", "untranslated", F.col("cleaned_at").isNotNull().alias("cleaned"), F.col("translation_reviewed").alias("reviewed"))


def readiness_totals(pages: DataFrame) -> DataFrame:
    """Per album: pages to print and the pages of each issue; skipped pages have none."""
    rows = pages.where("NOT skip")
    issue = {"untranslated_pages": F.col("untranslated") > 0, "uncleaned_pages": ~F.col("cleaned"), "unreviewed_pages": (F.col("dialogue") > 0) & ~F.col("reviewed")}
    return rows.groupBy("album_id").agg(F.count("*").alias("pages"), *(F.count_if(c).alias(n) for n, c in issue.items()))


def rating_summary(ratings: DataFrame) -> DataFrame:
    """Per study and candidate: average, share of 4 and 5, count, and the ``place`` in the study, best average first; studies with an open row are left out.

    Candidates of equal average keep the order in which the study (by item and turn) first shows them.
    """
    found = ratings.groupBy("study", "candidate").agg(
        F.bool_or(F.col("score").isNull()).alias("_open"),
        F.avg("score").alias("average"), F.avg((F.col("score") >= 4).cast("double")).alias("good_share"), F.count("*").alias("ratings"), F.min(F.struct("item", "turn", "rating_id")).alias("_first")
    )
    found = found.withColumn("_open", F.bool_or("_open").over(Window.partitionBy("study"))).where("NOT _open")
    best = Window.partitionBy("study").orderBy(F.desc("average"), "_first")
    return found.withColumn("place", F.row_number().over(best)).drop("_first", "_open")


def rating_progress(ratings: DataFrame) -> DataFrame:
    """Per study: items, items with all scores, the first open one."""
    items = ratings.groupBy("study", "item").agg(F.bool_and(F.col("score").isNotNull()).alias("rated"))
    return items.groupBy("study").agg(F.count("*").alias("items"), F.count_if("rated").alias("rated"), F.min(F.when(~F.col("rated"), F.col("item"))).alias("first_open"))


def rating_items(ratings: DataFrame) -> DataFrame:
    """(study, item, candidates, rated): the items of each study with their candidates in blind order, without what made them.

    ``ratings``: rating_id, study, item, turn (drawn at random for the study), score; candidates are structs of rating_id and score.
    """
    blind = F.struct("turn", "rating_id", "score")
    listed = F.transform(F.sort_array(F.collect_list(blind)), lambda c: F.struct(c["rating_id"].alias("rating_id"), c["score"].alias("score")))
    return ratings.groupBy("study", "item").agg(listed.alias("candidates"), F.bool_and(F.col("score").isNotNull()).alias("rated"))


def processing_totals(sheets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per album: original pages that were processed and those that were skipped, and of the former the blocks and how many are flagged for review."""
    per_page = blocks.groupBy("page_id").agg(F.count("*").alias("b"), F.count_if("needs_review").alias("r"))
    rows = sheets.where("kind = 'original'").join(per_page, "page_id", "left").na.fill(0, ["b", "r"])
    of_processed = lambda c: F.sum(F.when(~F.col("skip"), F.col(c)).otherwise(0))
    return rows.groupBy("album_id").agg(F.count_if(~F.col("skip")).alias("pages"), F.count_if("skip").alias("skipped"), of_processed("b").alias("blocks"), of_processed("r").alias("needs_review"))


def page_pitch(sheets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per page the upper median of line pitches of blocks with two lines or more, clamped by the page's height."""
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    rows = blocks.withColumn("lines", lines).withColumn("pitch", F.col("height") / F.greatest(F.col("lines"), F.lit(1)))
    measured = F.sort_array(F.collect_list(F.when((F.col("lines") >= 2) & ~F.col("kind").isin("sfx", "other"), F.col("pitch"))))
    middle = F.get(measured, F.floor(F.size(measured) / 2).cast("int"))
    per_page = rows.groupBy("page_id").agg(middle.alias("median"), F.count("*").alias("blocks"))
    usual = F.col("page_height") / 64
    per_page = per_page.join(sheets.select("page_id", F.col("height").alias("page_height")), "page_id")
    clamped = F.greatest(F.least(F.coalesce("median", usual), 1.5 * usual), 0.7 * usual)
    return per_page.select("page_id", "blocks", clamped.alias("page_pitch"))


def block_pitch(sheets: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, block_id, page_pitch, pitch): a block's own pitch where it has two lines or more, clamped by its page's, else that."""
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    rows = blocks.select("page_id", "block_id", "height", lines.alias("lines")).join(page_pitch(sheets, blocks).drop("blocks"), "page_id")
    own = F.least(F.greatest(F.col("height") / F.greatest(F.col("lines"), F.lit(1)), 0.7 * F.col("page_pitch")), 1.4 * F.col("page_pitch"))
    return rows.select("page_id", "block_id", "page_pitch", F.when(F.col("lines") >= 2, own).otherwise(F.col("page_pitch")).alias("pitch"))


def renumber(df: DataFrame, keys: list[str], order: list, column: str = "position") -> DataFrame:
    """Dense positions from 1 in each group."""
    return df.withColumn(column, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def is_reordered(sheets: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("album_id", "kind").orderBy("import_order"))
    moved = sheets.withColumn("moved", rank != F.col("position"))
    return moved.groupBy("album_id", "kind").agg(F.bool_or("moved").alias("reordered"), F.count_if("moved").alias("moved_pages"))


def runs(df: DataFrame, keys: list[str], index: str, predicate: Column) -> DataFrame:
    """Maximal runs [first, last] of consecutive indexes where the predicate holds."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(index))
    islands = df.where(predicate).withColumn("island", F.col(index) - place)
    return islands.groupBy(*keys, "island").agg(F.min(index).alias("first"), F.max(index).alias("last")).drop("island")


def retain_history(history: DataFrame, limit: int = 30) -> DataFrame:
    """Snapshots with ``keep``: the newest ``limit`` of each page and stack."""
    newest = F.row_number().over(Window.partitionBy("page_id", "kind").orderBy(F.desc("position")))
    return history.withColumn("keep", newest <= limit)


def history_state(history: DataFrame) -> DataFrame:
    """The action on top of each page's undo and redo stack."""
    return history.groupBy("page_id").agg(*(F.max_by("action", F.when(F.col("kind") == k, F.col("position"))).alias(k) for k in ("undo", "redo")))


def pending_blocks(sheets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks with text that are not approved, with the next one of the album (after the last: the first)."""
    pages = active_pages(sheets).select("page_id", "album_id", F.col("position").alias("page"))
    rows = blocks.where("text <> '' AND translation_status <> 'approved'").join(pages, "page_id")
    turn = Window.partitionBy("album_id").orderBy("page", "position", "block_id")
    following = F.coalesce(F.lead("block_id").over(turn), F.first("block_id").over(turn))
    first = F.row_number().over(Window.partitionBy("album_id", "page").orderBy("position", "block_id")) == 1
    return rows.select("album_id", "page", "block_id", "translation_status", following.alias("next_block"), first.alias("first_of_page"))


def job_eta(samples: DataFrame, least_seconds: int = 60) -> DataFrame:
    """Seconds left of each job by its first and latest sample, once it has run for a while and got anywhere."""
    ends = samples.groupBy("job_id").agg(
        F.min("ts").alias("started"), F.max("ts").alias("latest"), F.min_by("progress", "ts").alias("p0"), F.max_by("progress", "ts").alias("p1"), F.max("total").alias("total")
    )
    seconds = F.unix_timestamp(F.col("latest").cast("timestamp")) - F.unix_timestamp(F.col("started").cast("timestamp"))
    ends = ends.withColumn("elapsed", seconds).withColumn("done", F.col("p1") - F.col("p0"))
    known = (F.col("elapsed") >= least_seconds) & (F.col("done") > 0)
    left = F.when(known, F.round((F.col("total") - F.col("p1")) * F.col("elapsed") / F.col("done"), 3))
    return ends.select("job_id", F.col("p1").alias("progress"), "elapsed", "done", "total", left.alias("seconds_left"))


def queue_eta(samples: DataFrame, jobs: DataFrame) -> DataFrame:
    """``job_eta`` of running jobs with ``queued`` jobs of the same type and ``seconds_with_queued``, as each lasts as long as this one.

    Only long jobs (LONG_JOBS) with a total have an estimate. ``jobs``: job_id, type, status; ``samples``: of ``job_eta``.
    """
    queued = jobs.where("status = 'queued'").groupBy("type").agg(F.count("*").alias("queued"))
    running = jobs.where("status = 'running'").select("job_id", "type").join(job_eta(samples), "job_id").join(queued, "type", "left").na.fill(0, ["queued"])
    told = F.col("type").isin(*LONG_JOBS) & (F.col("total") > 0)
    running = running.withColumn("seconds_left", F.when(told, F.col("seconds_left")))
    whole = F.col("total") * F.col("elapsed") / F.nullif("done", F.lit(0))
    return running.select("job_id", "type", "progress", "elapsed", "seconds_left", "queued", F.round(F.col("seconds_left") + F.col("queued") * whole, 3).alias("seconds_with_queued"))


def recent_jobs(jobs: DataFrame, n: int = 10) -> DataFrame:
    return jobs.withColumn("rank", F.row_number().over(Window.partitionBy("album_id").orderBy(F.desc("job_id")))).where(F.col("rank") <= n)


def ai_proposals(jobs: DataFrame) -> DataFrame:
    """Finished proposals of each block, newest first by ``newest``, with model and cost from their JSON ``result``."""
    result = lambda name, kind: F.try_variant_get(F.try_parse_json("result"), f"$.{name}", kind)
    paid = jobs.where("type = 'ai_patch' AND status = 'done'").select("job_id", "updated_at", result("block_id", "long").alias("block_id"), result("model", "string").alias("model"), result("cost", "double").alias("cost"))
    turn = Window.partitionBy("block_id").orderBy(F.desc("job_id"))
    return paid.where("block_id IS NOT NULL").select("block_id", "job_id", "model", "cost", F.row_number().over(turn).alias("newest"))


def memory_examples(memory: DataFrame, n: int = 8) -> DataFrame:
    """The first pairs of each series' memory, by order of entry."""
    first = memory.withColumn("rank", F.row_number().over(Window.partitionBy("series_id").orderBy("ord"))).where(F.col("rank") <= n)
    pairs = F.sort_array(F.collect_list(F.struct("rank", "source", "target")))
    return first.groupBy("series_id").agg(F.transform(pairs, lambda p: F.struct(p["source"].alias("source"), p["target"].alias("target"))).alias("examples"))


def queue_listing(jobs: DataFrame, drawing: DataFrame, albums: DataFrame) -> DataFrame:
    """Jobs that wait or run, and exports that are being drawn (negative id, not abandoned), with album titles; drawing comes first by ``part``.

    ``drawing``: export_id, album_id and, of ``drawing_activity``, abandoned.
    """
    if "abandoned" in drawing.columns:
        drawing = drawing.where("NOT abandoned")
    waiting = jobs.where("status IN ('queued', 'running')").select("job_id", "type", "status", "album_id", F.lit(1).alias("part"))
    drawn = drawing.select((-F.col("export_id")).alias("job_id"), F.lit("export_draw").alias("type"), F.lit("running").alias("status"), "album_id", F.lit(0).alias("part"))
    titles = albums.select("album_id", F.col("original_title").alias("title"))
    return drawn.unionByName(waiting).join(titles, "album_id", "left")


#: Seconds without a new page after which an export is stale, and abandoned (fixed values).
STALE_SECONDS, ABANDONED_SECONDS = 90, 3600


def drawing_activity(progress: DataFrame, uploads: DataFrame, now: Column) -> DataFrame:
    """``progress`` (export_id, created_at and others) with the last activity, and whether it is stale or abandoned at ``now``.

    ``uploads``: export_id, ts of each page that came.
    """
    latest = uploads.groupBy("export_id").agg(F.max("ts").alias("_ts"))
    rows = progress.join(latest, "export_id", "left").withColumn("last", F.greatest("created_at", "_ts")).drop("_ts")
    idle = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))
    return rows.withColumns({"stale": idle > STALE_SECONDS * 1_000_000, "abandoned": idle > ABANDONED_SECONDS * 1_000_000})


def drawing_progress(exports: DataFrame) -> DataFrame:
    """Per export: positions to draw (not skipped) and those of them received."""
    to_draw = exports.where("NOT skip").select("export_id", "position").distinct()
    received = exports.where("received").select("export_id", "position", F.lit(1).alias("got")).distinct()
    both = to_draw.join(received, ["export_id", "position"], "left")
    return both.groupBy("export_id").agg(F.count("got").alias("done"), F.count("*").alias("total"))


def orphan_files(listing: DataFrame, *used: DataFrame) -> DataFrame:
    """Files of a listing that no table of used files names."""
    known = used[0]
    for more in used[1:]:
        known = known.union(more)
    return listing.join(known.toDF("file"), "file", "left_anti")


def validate_order(requested: DataFrame, existing: DataFrame, key: str, item: str) -> DataFrame:
    """Per key, whether the requested items are a permutation of the existing ones."""
    listed = lambda df, name: df.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias(name))
    both = listed(existing, "have").join(listed(requested, "want"), key, "full")
    return both.select(key, F.coalesce(F.col("have") == F.col("want"), F.lit(False)).alias("valid"))
