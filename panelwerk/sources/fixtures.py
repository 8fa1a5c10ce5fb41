"""Corpus tables as views over the driver tables, in SQL that Spark and DuckDB both run.

A view's text may name driver tables and other views. ``view`` runs it on Spark; ``with_views`` writes it as common table
expressions for an oracle query.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_PLACE = "ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)"
_BLANK, _WHOLE = "(l_partkey * 7 + l_suppkey) % 23 = 0", "(l_partkey + l_suppkey * 3) % 50 = 0"
#: What a block is made of besides its texts, and the documents of these.
_MADE = f"""l_orderkey AS page_id,
  CAST({_PLACE} AS BIGINT) AS position,
  CASE l_partkey % 6 WHEN 0 THEN 'caption' WHEN 1 THEN 'sfx' WHEN 2 THEN 'other' WHEN 3 THEN 'title' ELSE 'speech' END AS kind,
  CAST((l_partkey * 37) % 1600 AS DOUBLE) AS x, CAST((l_suppkey * 211 + l_linenumber * 331) % 2200 AS DOUBLE) AS y,
  60 + l_quantity * 4 AS width, 30 + 10 * round(l_discount * 100) AS height,
  CASE l_returnflag WHEN 'N' THEN 'none' WHEN 'A' THEN 'draft' ELSE CASE l_linestatus WHEN 'O' THEN 'edited' ELSE 'approved' END END AS translation_status,
  CASE WHEN l_partkey % 4 = 0 THEN 'manual' ELSE 'auto' END AS source,
  CASE WHEN l_suppkey % 7 <> 0 THEN 'model-a' END AS ocr_model, l_partkey % 9 = 0 AS needs_review, (l_partkey + l_suppkey) % 11 = 0 AS translation_too_long,
  {_BLANK} AS blank, {_WHOLE} AS whole,
  l_shipdate AS updated_at, CAST(l_quantity AS INT) AS qty"""
_DOCS = "l_partkey % (SELECT max(doc_id) + 1 FROM documents) AS d1, (l_suppkey * 31 + l_partkey) % (SELECT max(doc_id) + 1 FROM documents) AS d2"
#: Rows of blocks without texts, and with the text alone.
_PLACED = f"""SELECT {_MADE},
  {_DOCS} FROM lineitem"""
_LETTERED = f"""SELECT b.*, CASE WHEN b.blank THEN '  ' WHEN b.whole THEN coalesce(d1.text, '') ELSE substr(coalesce(d1.text, ''), 1, 20 + b.qty) END AS text
 FROM ({_PLACED}) b
 LEFT JOIN (SELECT doc_id, text FROM documents) d1 ON d1.doc_id = b.d1"""

VIEWS: dict[str, str] = {
    # Series.
    'series': """
SELECT n_nationkey AS series_id, n_name AS name, CASE WHEN n_nationkey % 5 = 4 THEN 'sr' ELSE 'it' END AS source_lang, 'sr' AS target_lang FROM nation
""",
    # Albums (projects).
    'albums': """
SELECT c_custkey AS album_id, c_nationkey AS series_id, c_name AS original_title FROM customer
""",
    # Page metadata (the driver also has an unrelated HTML table named `pages`, hence `sheets`).
    'sheets': """
SELECT o_orderkey AS page_id, o_custkey AS album_id,
 CASE WHEN o_orderkey % 4 = 3 THEN 'reference' ELSE 'original' END AS kind,
 CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey, CASE WHEN o_orderkey % 4 = 3 THEN 'reference' ELSE 'original' END ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS position,
 CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey, CASE WHEN o_orderkey % 4 = 3 THEN 'reference' ELSE 'original' END ORDER BY o_orderkey) AS BIGINT) AS import_order,
 1801 AS width, 2457 AS height, (o_orderstatus = 'P' AND o_orderkey % 3 = 0) AS skip, o_orderstatus = 'F' AS translation_reviewed,
 CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS cleaned_at,
 'albums/' || CAST(o_custkey AS VARCHAR(20)) || '/scan-' || CAST(o_orderkey AS VARCHAR(20)) || '.v2.jpg' AS image_path FROM orders
""",
    # Text blocks with boxes, text and translation. Lettering is short: a block's text is the beginning of a document, cut before others are joined; one block in
    # fifty holds the whole of it, and some hold nothing but spaces.
    'blocks': f"""
SELECT page_id * 100 + position AS block_id, c.page_id, c.position, c.kind, c.x, c.y, c.width, c.height, c.translation_status, c.source, c.ocr_model, c.updated_at, c.needs_review, c.translation_too_long, c.text,
 CASE WHEN c.translation_status = 'none' THEN '' WHEN c.whole THEN coalesce(d2.text, '') ELSE substr(coalesce(d2.text, ''), 1, 15 + 2 * (c.qty % 20)) END AS translation
FROM ({_LETTERED}) c
LEFT JOIN (SELECT doc_id, text FROM documents) d2 ON d2.doc_id = c.d2
""",
    # The same blocks for queries that read no text, or no translation: the documents that they do not show are not joined.
    'block_boxes': f"""
SELECT page_id * 100 + position AS block_id, * FROM ({_PLACED}) b
""",
    'block_texts': f"""
SELECT page_id * 100 + position AS block_id, * FROM ({_LETTERED}) c
""",
    'block_translations': f"""
SELECT page_id * 100 + position AS block_id, c.*, CASE WHEN c.translation_status = 'none' THEN '' WHEN c.whole THEN coalesce(d2.text, '') ELSE substr(coalesce(d2.text, ''), 1, 15 + 2 * (c.qty % 20)) END AS translation
FROM ({_PLACED}) c
LEFT JOIN (SELECT doc_id, text FROM documents) d2 ON d2.doc_id = c.d2
""",
    # Blocks that continue in the next of their page: every third, and on some pages the next back in it (a ring).
    'linked_blocks': """
SELECT *, CASE WHEN position % 3 = 1 THEN block_id + 1 WHEN position % 3 = 2 AND page_id % 5 = 0 THEN block_id - 1 END AS continues_id FROM blocks
""",
    # Four panels per page.
    'panels': """
SELECT o_orderkey AS page_id, CAST(p.n AS INT) AS panel, CAST(40 + 880 * (p.n % 2) AS DOUBLE) AS x, CAST(40 + 1200 * floor(p.n / 2) AS DOUBLE) AS y, CAST(840 AS DOUBLE) AS width, CAST(1160 AS DOUBLE) AS height FROM orders o JOIN (VALUES (0), (1), (2), (3)) AS p(n) ON TRUE
""",
    # Patches (C9, K11).
    'patches': """
SELECT block_id AS patch_id, page_id, block_id, x, y, width, height FROM blocks WHERE kind IN ('title', 'other', 'sfx') AND block_id % 7 = 0
""",
    # Raw detector output (B8 threshold, C4, E6, E7, C12).
    'detections': """
SELECT page_id, block_id AS det_id, CASE block_id % 3 WHEN 0 THEN 'bubble' WHEN 1 THEN 'text_bubble' ELSE 'text_free' END AS label,
 CAST((block_id * 13) % 101 AS DOUBLE) / 100 AS score, x, y, width, height FROM blocks
""",
    # Second edition: scaled ×2, shifted, one block in five missing, two extra pages in front (C6–C8, D14 must give +2).
    'edition_b': """
SELECT b.block_id, s.album_id, s.position + 2 AS position, b.kind, b.x * 2 + 15 AS x, b.y * 2 - 10 AS y, b.width * 2 AS width, b.height * 2 AS height, 3602 AS page_width, 4914 AS page_height FROM blocks b JOIN sheets s ON s.page_id = b.page_id WHERE s.kind = 'original' AND b.block_id % 5 <> 0
""",
    # Blocks with continues_id for chains.
    'links': """
SELECT conv_id AS page_id, conv_id * 100 + turn AS block_id, turn + 1 AS position, CASE WHEN turn % 3 <> 2 AND next_turn IS NOT NULL THEN conv_id * 100 + next_turn END AS continues_id, text
FROM (SELECT *, LEAD(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations) t
""",
    # Seed memory from whole documents (exact duplicates give hits); K3 over approved `blocks` gives the second memory.
    'memory': """
SELECT d.doc_id % 25 AS series_id, d.text AS source, b.text AS target, d.doc_id AS ord FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT max(item_id) + 1 FROM benchmark)
""",
    # Approved glossary: the first word of each benchmark passage, in one of the series. ß is folded first, as engines differ in its upper case.
    'glossary': """
SELECT DISTINCT n_nationkey AS series_id, upper(replace(w, 'ß', 'ss')) AS source, substr(upper(replace(w, 'ß', 'ss')), 1, length(w) - 1) || 'A' AS target, 'approved' AS status FROM nation JOIN (SELECT DISTINCT split(replace(replace(text, '.', ''), ',', ''), ' ')[1] AS w FROM benchmark) t ON n_nationkey = (ascii(w) * 7 + ascii(substr(w, 2, 1)) * 31 + ascii(substr(w, 3, 1)) + length(w)) % 25 WHERE length(w) >= 4
""",
    # The same terms in every series, for reports of whole glossaries.
    'every_glossary': """
SELECT DISTINCT n_nationkey AS series_id, upper(replace(w, 'ß', 'ss')) AS source, substr(upper(replace(w, 'ß', 'ss')), 1, length(w) - 1) || 'A' AS target, 'approved' AS status FROM nation CROSS JOIN (SELECT DISTINCT split(replace(replace(text, '.', ''), ',', ''), ' ')[1] AS w FROM benchmark) t WHERE length(w) >= 4
""",
    # Sound-word glossary.
    'sfx_glossary': """
SELECT * FROM (VALUES (1, 'BANG', 'BANG'), (2, 'SWACK', 'SCVAK'), (3, 'CRASH', 'KRAŠ'), (4, 'SVISH', 'SVIŠ'), (5, 'WOAH', 'VOAH'), (6, 'THAT', 'TET'), (7, 'AH AH AH', 'HA-HA-HA!')) AS t(id, source, target)
""",
    # Blind study; study 4 is incomplete on purpose.
    'ratings': """
SELECT study, item, item * 100 + n AS rating_id, (item + n * 7) % 11 AS turn, candidate, score FROM
(SELECT l_orderkey % 5 AS study, l_orderkey AS item, l_returnflag AS candidate, CASE WHEN l_orderkey % 5 = 4 AND l_linenumber = 1 THEN NULL ELSE CAST(l_quantity AS INT) % 5 + 1 END AS score,
 CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS n FROM lineitem) r
""",
    # Job log (D3, E11–E13, F2).
    'jobs': """
SELECT event_id AS job_id, user_id AS album_id, CASE event_type WHEN 'view' THEN 'process_project' WHEN 'click' THEN 'translate_project' WHEN 'purchase' THEN 'ai_patch' WHEN 'signup' THEN 'export' ELSE 'clean_project' END AS type,
 CASE WHEN event_id % 10 = 0 THEN 'queued' WHEN event_id % 10 = 1 THEN 'running' WHEN event_id % 10 = 2 THEN 'failed' ELSE 'done' END AS status, value AS cost, ts AS updated_at,
 '{"block_id":' || CAST(user_id * 100 + event_id % 3 AS VARCHAR(20)) || ',"model":"m' || CAST(event_id % 4 AS VARCHAR(2)) || '","cost":' || CAST(event_id % 9 AS VARCHAR(2)) || '}' AS result FROM events
""",
    # Worker heartbeats.
    'heartbeats': """
SELECT 'w' || CAST(user_id % 5 AS VARCHAR(2)) AS worker_id, ts FROM events
""",
    # Progress samples.
    'job_samples': """
SELECT user_id AS job_id, ts, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS progress, CAST(500 AS BIGINT) AS total FROM events
""",
    # Upload activity.
    'uploads': """
SELECT user_id AS export_id, ts, event_id % 40 + 1 AS position FROM events
""",
    # Undo/redo log, more than 30 per (page, kind).
    'history': """
SELECT page_id, kind, CAST(ROW_NUMBER() OVER (PARTITION BY page_id, kind ORDER BY ts, event_id) AS BIGINT) AS position, action, ts AS created_at FROM (SELECT user_id AS page_id, CASE WHEN event_id % 4 = 3 THEN 'redo' ELSE 'undo' END AS kind, event_type AS action, ts, event_id FROM events) e
""",
    # Model answers, good and broken.
    'responses': """
SELECT c_custkey AS request_id, CASE c_custkey % 4 WHEN 0 THEN 'not json' WHEN 1 THEN '{"translations":"x"}' ELSE '{"translations":[{"number":1,"text":"[speech] ' || lower(c_mktsegment) || ' tisuć","note":""},{"number":"2","text":"ПРЕКО","note":"a"},{"number":1,"text":"again"},{"number":9,"text":"x"},{"number":3,"text":""}]}' END AS response FROM customer
""",
    # Exploded exports: one row per exported position.
    'exports': """
SELECT album_id AS export_id, position, position % 3 <> 0 AS received, skip FROM sheets WHERE kind = 'original'
""",
}

_DOC = "(SELECT doc_id, text FROM documents)"
#: Whether a block has no translation yet.
_BARE = "coalesce(l_returnflag = 'N', FALSE)"
#: What a block of the view of linked blocks continues in.
LINK = "CASE WHEN position % 3 = 1 THEN block_id + 1 WHEN position % 3 = 2 AND page_id % 5 = 0 THEN block_id - 1 END"
_RAW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate", "place"]
_MADE_LAST = _MADE.replace(_PLACE, "place")
_TEXT = f"CASE WHEN {_BLANK} THEN '  ' WHEN {_WHOLE} THEN coalesce(d.text, '') ELSE substr(coalesce(d.text, ''), 1, 20 + CAST(l_quantity AS INT)) END AS text"
_TOLD = f"CASE WHEN {_WHOLE} THEN coalesce(d.text, '') ELSE substr(coalesce(d.text, ''), 1, 15 + 2 * (CAST(l_quantity AS INT) % 20)) END AS translation"
_SHOWN = "page_id * 100 + position AS block_id, page_id, position, kind, x, y, width, height, translation_status, source, ocr_model, updated_at, needs_review, translation_too_long, text, translation"


def _block_views() -> dict[str, str]:
    """The views of blocks by plans that cost Spark less.

    Places are given first; what is shuffled to meet the documents are raw columns, of which those of blocks are made at the end. Blocks without a translation
    (half of them) do not meet the documents of translations.
    """
    raw = f"SELECT {', '.join(_RAW)}, {_DOCS} FROM (SELECT *, {_PLACE} AS place FROM lineitem) l"
    lettered = f"SELECT r.*, {_TEXT} FROM ({raw}) r LEFT JOIN {_DOC} d ON d.doc_id = r.d1"

    def both(rows: str) -> str:
        return f"SELECT r.*, '' AS translation FROM {rows} r WHERE {_BARE} UNION ALL SELECT r.*, {_TOLD} FROM {rows} r LEFT JOIN {_DOC} d ON d.doc_id = r.d2 WHERE NOT {_BARE}"

    block = "SELECT page_id * 100 + position AS block_id,"
    return {
        "block_boxes": f"{block} * FROM (SELECT {_MADE_LAST}, d1, d2 FROM ({raw}) r) b",
        "block_texts": f"{block} * FROM (SELECT {_MADE_LAST}, d1, d2, text FROM ({lettered}) r) b",
        "block_translations": f"WITH raw AS ({raw}) {block} * FROM (SELECT {_MADE_LAST}, d1, d2, translation FROM ({both('raw')}) r) b",
        "blocks": f"WITH lettered AS ({lettered}) SELECT {_SHOWN} FROM (SELECT {_MADE_LAST}, text, translation FROM ({both('lettered')}) r) b",
    }


#: The same rows by other plans; views that show no text are over blocks without any.
SPARK_VIEWS = _block_views() | {name: VIEWS[name].replace("FROM blocks", "FROM block_boxes") for name in ("patches", "detections", "edition_b")}
assert all(LINK in VIEWS["linked_blocks"] and text != VIEWS[name] for name, text in SPARK_VIEWS.items())


def blocks_of(spark: SparkSession, sf_dir: str, pages: DataFrame, linked: bool = False, how: str = "inner", told: Callable[[DataFrame], DataFrame] | None = None, translations: bool = True) -> DataFrame:
    """The blocks of ``pages`` (page_id and other columns, which the blocks get too); ``linked``: of the view of linked blocks; ``how`` they meet the pages;
    without ``translations`` the documents of these are not met.

    Pages are met where the rows lie by page, before they have texts. ``told`` adds columns to rows that have all but their translation; the blocks have those instead of
    the text, so that it is not carried to the translations.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    more = [c for c in pages.columns if c != "page_id"]
    docs = _DOCS.replace("FROM documents", f"FROM parquet.`{sf_dir}/documents.parquet`").split(", (")
    placed = read("lineitem").selectExpr("*", f"{_PLACE} AS place")
    raw = placed.join(pages, placed["l_orderkey"] == pages["page_id"], how).selectExpr(*_RAW, docs[0], f"({docs[1]}", *more)
    texts = lambda: read("documents").select("doc_id", "text").alias("d")
    lettered = raw.join(texts(), F.col("d1") == F.col("d.doc_id"), "left").selectExpr(*_RAW, "d2", *more, _TEXT)
    said = ["text"]
    if told:
        made = spark.sql(f"SELECT *, {_MADE_LAST} FROM {{rows}}", rows=lettered).selectExpr("*", "page_id * 100 + position AS block_id").selectExpr("*", f"{LINK} AS continues_id")
        rows = told(made)
        said = [c for c in rows.columns if c not in made.columns]
        lettered = rows.select(*_RAW, "d2", *more, *said)
    shown = _SHOWN if not told else _SHOWN.replace(", text,", f", {', '.join(said)},")
    if not translations:
        made = spark.sql(f"SELECT {_MADE_LAST}, {', '.join([*said, *more])} FROM {{rows}}", rows=lettered)
        shown = spark.sql(f"SELECT {', '.join([shown.removesuffix(', translation'), *more])} FROM {{made}}", made=made)
        return shown.selectExpr("*", f"{LINK} AS continues_id") if linked else shown
    translated = lettered.where(f"NOT {_BARE}").withColumnsRenamed({c: f"_{c}" for c in said}).join(texts(), F.col("d2") == F.col("d.doc_id"), "left")
    translated = translated.selectExpr(*_RAW, *more, *(f"_{c} AS {c}" for c in said), _TOLD)
    rows = lettered.where(_BARE).selectExpr(*_RAW, *more, *said, "'' AS translation").unionByName(translated)
    made = spark.sql(f"SELECT {_MADE_LAST}, {', '.join([*said, 'translation', *more])} FROM {{rows}}", rows=rows)
    shown = spark.sql(f"SELECT {', '.join([shown, *more])} FROM {{made}}", made=made)
    return shown.selectExpr("*", f"{LINK} AS continues_id") if linked else shown


def _needed(sql: str, made: tuple[str, ...] = (), texts: dict[str, str] = VIEWS) -> list[str]:
    """Views that a text names, those that they name first; those in ``made`` need none."""
    found: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                if name not in made:
                    add(texts[name])
                if name not in found:
                    found.append(name)

    add(sql)
    return found


def with_views(sql: str) -> str:
    """An oracle query (which may start with its own WITH) with the views that it names."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in _needed(sql))
    body = sql.strip()
    if not ctes:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{ctes}, {body[len(start) :]}"
    return f"WITH {ctes} {body}"


def view(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A driver table or a view over the driver tables in ``sf_dir``; views in ``made`` are taken from there, also below others."""
    made = made or {}
    if name in made:
        return made[name]
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    said = VIEWS | {n: x for n, x in SPARK_VIEWS.items() if n.startswith("block") or "blocks" not in made}
    names = [*_needed(said[name], tuple(made), said), name]
    texts = {n: re.sub(r"\)\[1\]", ")[0]", said[n].strip()) for n in names if n not in made}  # array subscripts start at 0 in Spark
    used = [t for t in TABLES if any(re.search(rf"\b{t}\b", x) for x in texts.values())]
    ctes = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in used]
    given = {n: made[n] for n in names if n in made}
    if given:  # their names stand in braces, so those of the texts are doubled
        texts = {n: x.replace("{", "{{").replace("}", "}}") for n, x in texts.items()}
    ctes += [f"{n} AS (SELECT * FROM {{{n}}})" for n in given]
    ctes += [f"{n} AS ({x})" for n, x in texts.items()]
    return spark.sql(f"WITH {', '.join(ctes)} SELECT * FROM {name}", **given)
