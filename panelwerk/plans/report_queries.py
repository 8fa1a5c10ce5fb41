"""Queries of ``operators.reports`` over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from .book import Tables, query


@query("SELECT album_id, page_id, position FROM sheets WHERE kind = 'original' AND NOT skip")
def active_pages(t: Tables):
    return R.active_pages(t.sheets).select("album_id", "page_id", "position")


@query("SELECT album_id, page_id, position, skip FROM sheets WHERE kind = 'original' AND NOT skip AND position BETWEEN 2 AND 6")
def album_pages(t: Tables):
    return R.album_pages(t.sheets, False, 2, 6).select("album_id", "page_id", "position", "skip")


_SCRIPT = r"""
WITH bare AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS said, regexp_replace(translation, '^\s+|\s+$', '', 'g') AS told FROM blocks),
rows AS (SELECT s.album_id, s.position AS page, b.position, b.block_id,
 CASE b.kind WHEN 'sfx' THEN 'sound' WHEN 'other' THEN 'sign' ELSE b.kind END AS kind, said AS text, told AS translation,
 CASE b.translation_status WHEN 'none' THEN 'untranslated' ELSE b.translation_status END AS status,
 concat_ws(', ', CASE WHEN translation_too_long THEN 'too long' END, CASE WHEN needs_review THEN 'needs review' END) AS notes
 FROM bare b JOIN sheets s ON s.page_id = b.page_id WHERE (said <> '' OR told <> '') AND s.kind = 'original' AND NOT s.skip)
"""


@query(_SCRIPT + "SELECT * FROM rows")
def script_rows(t: Tables):
    return R.script_of(t.blocks_of(R.script_pages(t.sheets)))


@query(_SCRIPT + "SELECT album_id, status, count(*) AS blocks FROM rows GROUP BY ALL")
def script_summary(t: Tables):
    return R.script_summary(R.script_of(t.blocks_of(R.script_pages(t.sheets))))


@query(
    """SELECT series_id, status, count(*) AS entries, count(*) FILTER (WHERE contains(source, 'TH') OR contains(target, 'TH')) AS found
FROM every_glossary GROUP BY ALL"""
)
def glossary_counts(t: Tables):
    return R.glossary_counts(t.every_glossary, "TH")


@query(
    """SELECT series_id, source, target, CAST(row_number() OVER (PARTITION BY series_id ORDER BY source, target) AS INT) AS place FROM every_glossary
WHERE status = 'approved' AND (contains(source, 'E') OR contains(target, 'E'))"""
)
def glossary_view(t: Tables):
    return R.glossary_view(t.every_glossary, "approved", "E").select("series_id", "source", "target", "place")


_BARE = r"regexp_replace(upper(replace({0}, 'ß', 'ss')), '[^\p{{L}}\p{{N}}]', '', 'g')"
_REDRAW = f"""WITH b AS (SELECT *, {_BARE.format('text')} AS bt, {_BARE.format('translation')} AS bx FROM blocks),
r AS (SELECT block_id, kind, kind IN ('title', 'other', 'sfx') AND trim(text) <> '' AND trim(translation) <> '' AND bt <> bx AS redraw FROM b)
SELECT block_id, redraw, kind IN ('speech', 'thought', 'caption') OR redraw AS lettered FROM r"""


@query(_REDRAW)
def needs_redraw(t: Tables):
    """The verdict on every block; ß is folded on both sides."""
    return R.needs_redraw(t.blocks).select("block_id", "redraw", "lettered")


@query("SELECT page_id, count(*) AS unread FROM blocks WHERE source = 'auto' AND ocr_model IS NULL GROUP BY page_id")
def unread_blocks(t: Tables):
    return R.unread_blocks(t.blocks).groupBy("page_id").agg(F.count("*").alias("unread"))


@query(
    """SELECT s.page_id, s.album_id FROM sheets s WHERE NOT skip AND EXISTS (SELECT 1 FROM blocks b WHERE b.page_id = s.page_id
 AND (s.cleaned_at IS NULL OR b.updated_at > s.cleaned_at))"""
)
def stale_pages(t: Tables):
    return R.stale_pages(t.sheets, t.blocks).select("page_id", "album_id")


@query(
    """SELECT s.album_id, s.position AS page, b.page_id, b.block_id, trim(b.translation) <> '' AS translated FROM blocks b
JOIN sheets s ON s.page_id = b.page_id WHERE s.kind = 'original' AND NOT s.skip AND b.kind IN ('title', 'other', 'sfx')
 AND NOT EXISTS (SELECT 1 FROM patches p WHERE p.block_id = b.block_id)"""
)
def uncovered_blocks(t: Tables):
    return R.uncovered_blocks(t.sheets, t.blocks, t.patches)


@query(
    """WITH o AS (SELECT * FROM sheets WHERE kind = 'original'),
b AS (SELECT page_id, count(*) FILTER (WHERE source = 'auto' AND ocr_model IS NULL) AS unread,
 count(*) FILTER (WHERE text <> '' AND translation_status = 'none') AS untranslated, count(*) FILTER (WHERE text <> '' AND translation_status = 'draft') AS draft,
 count(*) FILTER (WHERE text <> '' AND translation_status = 'edited') AS edited, count(*) FILTER (WHERE text <> '' AND translation_status = 'approved') AS approved
 FROM blocks GROUP BY page_id),
r AS (SELECT album_id, count(*) FILTER (WHERE NOT skip) AS pages,
 coalesce(string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) FILTER (WHERE skip), '') AS skipped,
 count(*) FILTER (WHERE NOT skip AND unread = 0) AS read_pages,
 CAST(coalesce(sum(unread) FILTER (WHERE NOT skip), 0) AS BIGINT) AS unread, CAST(coalesce(sum(untranslated) FILTER (WHERE NOT skip), 0) AS BIGINT) AS untranslated,
 CAST(coalesce(sum(draft) FILTER (WHERE NOT skip), 0) AS BIGINT) AS draft, CAST(coalesce(sum(edited) FILTER (WHERE NOT skip), 0) AS BIGINT) AS edited,
 CAST(coalesce(sum(approved) FILTER (WHERE NOT skip), 0) AS BIGINT) AS approved,
 count(*) FILTER (WHERE NOT skip AND translation_reviewed) AS proofread, count(*) FILTER (WHERE NOT skip AND cleaned_at IS NOT NULL) AS cleaned
 FROM o LEFT JOIN b USING (page_id) GROUP BY album_id)
SELECT *, untranslated + draft + edited + approved AS blocks FROM r"""
)
def album_progress(t: Tables):
    return R.album_progress(t.sheets, t.blocks)


@query(
    """WITH c AS (SELECT s.album_id, greatest(max(s.cleaned_at), max(b.updated_at)) AS changed_at FROM sheets s LEFT JOIN blocks b ON b.page_id = s.page_id
 WHERE s.kind = 'original' AND NOT s.skip GROUP BY s.album_id),
e AS (SELECT user_id AS album_id, max(ts) AS exported_at FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT c.album_id, changed_at, exported_at, coalesce(changed_at > exported_at, FALSE) AS outdated FROM c LEFT JOIN e USING (album_id)"""
)
def album_freshness(t: Tables):
    exported = t.jobs.where("type = 'export'").select("album_id", F.col("updated_at").alias("finished_at"))
    return R.album_freshness(t.sheets, t.blocks, exported)


@query("SELECT album_id, count(*) AS calls, round_even(sum(coalesce(cost, 0)), 4) AS cost FROM jobs WHERE type = 'ai_patch' AND status = 'done' GROUP BY album_id")
def ai_cost(t: Tables):
    return R.ai_cost(t.jobs)


@query(
    """WITH c AS (SELECT album_id, count(*) FILTER (WHERE kind = 'original') AS page_count, count(*) FILTER (WHERE kind <> 'original') AS reference_page_count,
 min_by(page_id, position) FILTER (WHERE kind = 'original') AS cover_page_id,
 min_by(substr(regexp_extract(image_path, '([^/]*)\\.[^./]*$', 1), 1, 12), position) FILTER (WHERE kind = 'original') AS cover_version FROM sheets GROUP BY album_id)
SELECT a.album_id, series_id, original_title, coalesce(page_count, 0) AS page_count, coalesce(reference_page_count, 0) AS reference_page_count, cover_page_id,
 coalesce(cover_version, '') AS cover_version, CAST(row_number() OVER (PARTITION BY series_id ORDER BY a.album_id DESC) AS INT) AS place
FROM albums a LEFT JOIN c ON c.album_id = a.album_id"""
)
def album_summary(t: Tables):
    return R.album_summary(t.albums, t.sheets)


_READY = """
WITH d AS (SELECT page_id, count(*) AS dialogue, count(*) FILTER (WHERE trim(translation) = '') AS untranslated FROM blocks
 WHERE kind IN ('speech', 'thought', 'caption') AND trim(text) <> '' GROUP BY page_id),
p AS (SELECT album_id, s.page_id, position, skip, coalesce(dialogue, 0) AS dialogue, coalesce(untranslated, 0) AS untranslated,
 cleaned_at IS NOT NULL AS cleaned, translation_reviewed AS reviewed FROM sheets s LEFT JOIN d ON d.page_id = s.page_id WHERE kind = 'original')
"""


@query(_READY + "SELECT * FROM p")
def readiness(t: Tables):
    return R.readiness(t.sheets, t.blocks)


@query(
    _READY
    + """SELECT album_id, count(*) AS pages, count(*) FILTER (WHERE untranslated > 0) AS untranslated_pages,
 count(*) FILTER (WHERE NOT cleaned) AS uncleaned_pages, count(*) FILTER (WHERE dialogue > 0 AND NOT reviewed) AS unreviewed_pages FROM p WHERE NOT skip GROUP BY album_id"""
)
def readiness_totals(t: Tables):
    return R.readiness_totals(R.readiness(t.sheets, t.blocks))


@query(
    """WITH r AS (SELECT study, candidate, avg(score) AS average, avg(CASE WHEN score >= 4 THEN 1.0 ELSE 0.0 END) AS good_share, count(*) AS ratings, min((item, turn, rating_id)) AS first FROM ratings
WHERE study NOT IN (SELECT study FROM ratings WHERE score IS NULL) GROUP BY study, candidate)
SELECT study, candidate, average, good_share, ratings, CAST(row_number() OVER (PARTITION BY study ORDER BY average DESC, first) AS INT) AS place FROM r"""
)
def rating_summary(t: Tables):
    return R.rating_summary(t.ratings)


@query(
    """WITH i AS (SELECT study, item, bool_and(score IS NOT NULL) AS rated FROM ratings GROUP BY study, item)
SELECT study, count(*) AS items, count(*) FILTER (WHERE rated) AS rated, min(item) FILTER (WHERE NOT rated) AS first_open FROM i GROUP BY study"""
)
def rating_progress(t: Tables):
    return R.rating_progress(t.ratings)


@query(
    """SELECT study, item, array_to_string(list(rating_id ORDER BY turn, rating_id), ' ') AS candidates, bool_and(score IS NOT NULL) AS rated FROM ratings GROUP BY study, item"""
)
def rating_items(t: Tables):
    rows = R.rating_items(t.ratings)
    return rows.select("study", "item", F.array_join(F.transform("candidates", lambda c: c["rating_id"].cast("string")), " ").alias("candidates"), "rated")


@query(
    """WITH p AS (SELECT page_id, count(*) AS b, count(*) FILTER (WHERE needs_review) AS r FROM blocks GROUP BY page_id)
SELECT album_id, count(*) FILTER (WHERE NOT skip) AS pages, count(*) FILTER (WHERE skip) AS skipped, CAST(coalesce(sum(b) FILTER (WHERE NOT skip), 0) AS BIGINT) AS blocks,
 CAST(coalesce(sum(r) FILTER (WHERE NOT skip), 0) AS BIGINT) AS needs_review FROM sheets LEFT JOIN p USING (page_id) WHERE kind = 'original' GROUP BY album_id"""
)
def processing_totals(t: Tables):
    return R.processing_totals(t.sheets, t.blocks)


_PITCH = """WITH l AS (SELECT page_id, block_id, kind, height, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n FROM (SELECT * REPLACE (replace(text, '. ', '.' || chr(10)) AS text) FROM blocks)),
m AS (SELECT page_id, list_sort(list(height / n) FILTER (WHERE n >= 2 AND kind NOT IN ('sfx', 'other'))) AS ps, count(*) AS blocks FROM l GROUP BY page_id),
pp AS (SELECT m.page_id, blocks, greatest(least(coalesce(ps[len(ps) // 2 + 1], s.height / 64), 1.5 * (s.height / 64)), 0.7 * (s.height / 64)) AS page_pitch
 FROM m JOIN sheets s ON s.page_id = m.page_id)
"""


def _in_lines(t: Tables):
    return t.blocks.withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n")))


@query(_PITCH + "SELECT * FROM pp")
def page_pitch(t: Tables):
    """Blocks have a line for each sentence."""
    return R.page_pitch(t.sheets, _in_lines(t))


@query(
    _PITCH
    + """SELECT l.page_id, block_id, page_pitch, CASE WHEN n >= 2 THEN least(greatest(l.height / n, 0.7 * page_pitch), 1.4 * page_pitch) ELSE page_pitch END AS pitch
FROM l JOIN pp ON pp.page_id = l.page_id"""
)
def block_pitch(t: Tables):
    return R.block_pitch(t.sheets, _in_lines(t))


@query("SELECT block_id, page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY position) AS BIGINT) AS position FROM blocks WHERE kind <> 'sfx'")
def renumber(t: Tables):
    return R.renumber(t.blocks.where("kind <> 'sfx'").select("block_id", "page_id", "position"), ["page_id"], ["position"])


@query(
    """WITH r AS (SELECT album_id, kind, row_number() OVER (PARTITION BY album_id, kind ORDER BY import_order) <> position AS moved FROM sheets)
SELECT album_id, kind, bool_or(moved) AS reordered, count(*) FILTER (WHERE moved) AS moved_pages FROM r GROUP BY album_id, kind"""
)
def is_reordered(t: Tables):
    return R.is_reordered(t.sheets)


@query(
    """WITH i AS (SELECT page_id, position, position - row_number() OVER (PARTITION BY page_id ORDER BY position) AS island FROM blocks WHERE height >= 60)
SELECT page_id, min(position) AS first, max(position) AS last FROM i GROUP BY page_id, island"""
)
def runs(t: Tables):
    return R.runs(t.blocks, ["page_id"], "position", F.col("height") >= 60)


@query("SELECT page_id, kind, position, row_number() OVER (PARTITION BY page_id, kind ORDER BY position DESC) <= 30 AS keep FROM history")
def retain_history(t: Tables):
    return R.retain_history(t.history).select("page_id", "kind", "position", "keep")


@query(
    """SELECT page_id, max_by(action, position) FILTER (WHERE kind = 'undo') AS undo, max_by(action, position) FILTER (WHERE kind = 'redo') AS redo
FROM history GROUP BY page_id"""
)
def history_state(t: Tables):
    return R.history_state(t.history)


@query(
    """WITH r AS (SELECT s.album_id, s.position AS page, b.position, b.block_id, b.translation_status FROM blocks b JOIN sheets s ON s.page_id = b.page_id
 WHERE s.kind = 'original' AND NOT s.skip AND b.text <> '' AND b.translation_status <> 'approved')
SELECT album_id, page, block_id, translation_status,
 coalesce(lead(block_id) OVER w, first_value(block_id) OVER w) AS next_block,
 row_number() OVER (PARTITION BY album_id, page ORDER BY position, block_id) = 1 AS first_of_page
FROM r WINDOW w AS (PARTITION BY album_id ORDER BY page, position, block_id)"""
)
def pending_blocks(t: Tables):
    return R.pending_blocks(t.sheets, t.blocks)


@query(
    """WITH e AS (SELECT job_id, min(ts) AS s, max(ts) AS l, min_by(progress, ts) AS p0, max_by(progress, ts) AS p1, max(total) AS total FROM job_samples GROUP BY job_id),
d AS (SELECT job_id, p1, total, p1 - p0 AS done, CAST(floor(epoch(l)) - floor(epoch(s)) AS BIGINT) AS elapsed FROM e)
SELECT job_id, p1 AS progress, elapsed, CASE WHEN elapsed >= 60 AND done > 0 THEN round((total - p1) * elapsed / done, 3) END AS seconds_left FROM d"""
)
def job_eta(t: Tables):
    return R.job_eta(t.job_samples).select("job_id", "progress", "elapsed", "seconds_left")


@query(
    """WITH e AS (SELECT job_id, min(ts) AS s, max(ts) AS l, min_by(progress, ts) AS p0, max_by(progress, ts) AS p1, max(total) AS total FROM job_samples GROUP BY job_id),
d AS (SELECT job_id, p1, total, p1 - p0 AS done, CAST(floor(epoch(l)) - floor(epoch(s)) AS BIGINT) AS elapsed FROM e),
q AS (SELECT type, count(*) AS queued FROM jobs WHERE status = 'queued' GROUP BY type)
SELECT d.job_id, j.type, p1 AS progress, elapsed, CASE WHEN elapsed >= 60 AND done > 0 AND j.type IN ('process_project', 'translate_project', 'clean_project', 'prepare_project', 'export_draw') THEN round((total - p1) * elapsed / done, 3) END AS seconds_left, coalesce(queued, 0) AS queued,
 CASE WHEN elapsed >= 60 AND done > 0 AND j.type IN ('process_project', 'translate_project', 'clean_project', 'prepare_project', 'export_draw') THEN round(round((total - p1) * elapsed / done, 3) + coalesce(queued, 0) * (total * elapsed / done), 3) END AS seconds_with_queued
FROM jobs j JOIN d ON d.job_id = j.job_id LEFT JOIN q ON q.type = j.type WHERE j.status = 'running'"""
)
def queue_eta(t: Tables):
    return R.queue_eta(t.job_samples, t.jobs)


@query("SELECT album_id, job_id, type, status FROM jobs QUALIFY row_number() OVER (PARTITION BY album_id ORDER BY job_id DESC) <= 10")
def recent_jobs(t: Tables):
    return R.recent_jobs(t.jobs).select("album_id", "job_id", "type", "status")


@query(
    """WITH r AS (SELECT job_id, CAST(result::JSON->>'block_id' AS BIGINT) AS block_id, result::JSON->>'model' AS model, CAST(result::JSON->>'cost' AS DOUBLE) AS cost FROM jobs
 WHERE type = 'ai_patch' AND status = 'done')
SELECT *, CAST(row_number() OVER (PARTITION BY block_id ORDER BY job_id DESC) AS INT) AS newest FROM r"""
)
def ai_proposals(t: Tables):
    return R.ai_proposals(t.jobs)


@query("SELECT series_id, source, target, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ord) AS INT) AS place FROM memory QUALIFY place <= 8")
def memory_examples(t: Tables):
    found = R.memory_examples(t.memory).select("series_id", F.posexplode("examples").alias("place", "e"))
    return found.select("series_id", "e.source", "e.target", (F.col("place") + 1).alias("place"))


_NOW = "2024-01-30 23:30:00"
_ACTIVITY = f"""WITH p AS (SELECT export_id, count(*) FILTER (WHERE got) AS done, count(*) AS total, TIMESTAMP '2024-01-29 00:00:00' + to_hours(CAST(export_id % 60 AS INT)) AS created_at FROM
 (SELECT export_id, position, bool_or(received) AS got FROM exports WHERE NOT skip GROUP BY export_id, position) GROUP BY export_id),
l AS (SELECT export_id, max(ts) AS ts FROM uploads GROUP BY export_id),
m AS (SELECT p.*, greatest(created_at, ts) AS last FROM p LEFT JOIN l ON l.export_id = p.export_id),
a AS (SELECT *, epoch_us(TIMESTAMP '{_NOW}') - epoch_us(last) > 90000000 AS stale, epoch_us(TIMESTAMP '{_NOW}') - epoch_us(last) > 3600000000 AS abandoned FROM m)
"""


def _activity(t: Tables):
    created = F.expr("timestamp_ntz'2024-01-29 00:00:00' + make_dt_interval(0, CAST(export_id % 60 AS INT))")
    return R.drawing_activity(R.drawing_progress(t.exports).withColumn("created_at", created), t.uploads, F.expr(f"timestamp_ntz'{_NOW}'"))


@query(
    _ACTIVITY
    + """, d AS (SELECT export_id, export_id AS album_id FROM a WHERE done < total AND NOT abandoned),
q AS (SELECT -export_id AS job_id, 'export_draw' AS type, 'running' AS status, album_id, 0 AS part FROM d
 UNION ALL SELECT job_id, type, status, album_id, 1 FROM jobs WHERE status IN ('queued', 'running'))
SELECT q.*, original_title AS title FROM q LEFT JOIN albums a ON a.album_id = q.album_id"""
)
def queue_listing(t: Tables):
    open_exports = _activity(t).where("done < total").withColumn("album_id", F.col("export_id"))
    return R.queue_listing(t.jobs, open_exports, t.albums)


@query(_ACTIVITY + "SELECT * FROM a")
def drawing_activity(t: Tables):
    return _activity(t)


@query(
    """SELECT export_id, count(*) FILTER (WHERE got) AS done, count(*) AS total FROM
(SELECT export_id, position, bool_or(received) AS got FROM exports WHERE NOT skip GROUP BY export_id, position) GROUP BY export_id"""
)
def drawing_progress(t: Tables):
    return R.drawing_progress(t.exports)


@query(
    """WITH f AS (SELECT 'p' || CAST(page_id AS VARCHAR) AS file FROM sheets UNION ALL SELECT 'b' || CAST(block_id AS VARCHAR) FROM blocks WHERE kind IN ('title', 'other', 'sfx'))
SELECT file FROM f EXCEPT ALL (SELECT 'b' || CAST(patch_id AS VARCHAR) FROM patches UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR) FROM sheets WHERE kind = 'original')"""
)
def orphan_files(t: Tables):
    pages, patches = F.concat(F.lit("p"), "page_id").alias("file"), F.concat(F.lit("b"), "patch_id").alias("file")
    listing = t.sheets.select(pages).unionByName(t.blocks.where(F.col("kind").isin("title", "other", "sfx")).select(F.concat(F.lit("b"), "block_id").alias("file")))
    return R.orphan_files(listing, t.patches.select(patches), t.sheets.where("kind = 'original'").select(pages))


@query(
    """WITH w AS (SELECT page_id, list_sort(list(block_id)) AS want FROM blocks WHERE block_id % 11 <> 0 GROUP BY page_id),
h AS (SELECT page_id, list_sort(list(block_id)) AS have FROM blocks GROUP BY page_id)
SELECT h.page_id, coalesce(want = have, FALSE) AS valid FROM h LEFT JOIN w ON w.page_id = h.page_id"""
)
def validate_order(t: Tables):
    """Requests that leave out some blocks are invalid."""
    return R.validate_order(t.blocks.where("block_id % 11 <> 0"), t.blocks, "page_id", "block_id")
