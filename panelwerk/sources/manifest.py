"""Files in and out: import lists, their limits, gold sets as nested JSON, scripts as CSV, manifests of exported albums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key

#: Limits of one import.
MAX_FILES, MAX_BYTES = 2000, 1 << 30


def natural_sort(df: DataFrame, column: str, keys: list[str], rank: str = "place", ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows numbered in each group by a name in which digit runs compare as numbers, case ignored; those of one name by the columns ``ties``."""
    turn = Window.partitionBy(*keys).orderBy(natural_key(F.col(column)), column, *ties)
    return df.withColumn(rank, F.row_number().over(turn))


def import_manifest(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Files to import, numbered after what an album has already; hidden and system files are left out.

    ``files``: album_id, kind, archive, entry; ``existing``: album_id, kind, position, import_order.
    """
    shown = files.where(~F.col("entry").rlike(r"(^|/)(\.|__MACOSX/|Thumbs\.db$|desktop\.ini$)"))
    keys = [natural_key(F.col("archive")), natural_key(F.col("entry")), F.col("archive"), F.col("entry")]
    place = F.row_number().over(Window.partitionBy("album_id", "kind").orderBy(*keys))
    last = existing.groupBy("album_id", "kind").agg(F.max("position").alias("p"), F.max("import_order").alias("o"))
    rows = shown.withColumn("place", place).join(last, ["album_id", "kind"], "left")
    number = lambda c: (F.coalesce(c, F.lit(0)) + F.col("place")).cast("long")
    return rows.select("album_id", "kind", "archive", "entry", number(F.col("p")).alias("position"), number(F.col("o")).alias("import_order"))


def import_budget(files: DataFrame, keys: list[str], order: str, size: str, most_files: int = MAX_FILES, most_bytes: int = MAX_BYTES) -> DataFrame:
    """Per import: files, bytes, and the first entry at which a limit is passed (null: none)."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = files.withColumns({"_files": F.count("*").over(so_far), "_bytes": F.sum(size).over(so_far)})
    over = (F.col("_files") > most_files) | (F.col("_bytes") > most_bytes)
    return rows.groupBy(*keys).agg(F.max("_files").alias("files"), F.max("_bytes").alias("bytes"), F.min(F.when(over, F.col(order))).alias("first_over"))


def export_gold(sheets: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row for each page with its blocks nested in order, boxes rounded to a tenth; write it as JSON."""
    box = F.array(*(F.round(c, 1) for c in ("x", "y", "width", "height"))).alias("box")
    nested = blocks.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("position", "kind", box, "text"))).alias("blocks"))
    return sheets.select("page_id", "position", "width", "height").join(nested, "page_id")


def restore_gold(pages: DataFrame) -> DataFrame:
    """Block rows of a gold set."""
    rows = pages.select("page_id", F.explode("blocks").alias("b"))
    return rows.select("page_id", F.col("b.position").alias("position"), F.col("b.kind").alias("kind"), *(F.col("b.box")[k].alias(c) for k, c in enumerate(("x", "y", "width", "height"))), F.col("b.text").alias("text"))


#: Columns of a proofreading script, in order; the first name starts with a byte order mark.
SCRIPT_COLUMNS = {"﻿page": "page", "block": "position", "kind": "kind", "text": "text", "translation": "translation", "status": "status", "notes": "notes"}


def proofreading_script(rows: DataFrame, path: str) -> None:
    """Write script rows as CSV: semicolons, CRLF, UTF-8 with a byte order mark, one folder for each album."""
    named = rows.select("album_id", *(F.col(c).alias(n) for n, c in SCRIPT_COLUMNS.items()))
    named.write.mode("overwrite").partitionBy("album_id").option("sep", ";").option("lineSep", "\r\n").option("header", True).csv(path)


def album_manifest(exports: DataFrame, drawn: DataFrame) -> DataFrame:
    """For every exported position of an album its number in the archive and file name.

    ``exports``: export_id, position; ``drawn``: export_id, position of pages that were drawn anew.
    """
    turn = F.row_number().over(Window.partitionBy("export_id").orderBy("position"))
    rows = exports.select("export_id", "position", turn.alias("number")).join(drawn.select("export_id", "position", F.lit(True).alias("drawn")).distinct(), ["export_id", "position"], "left")
    name = F.concat(F.lpad(F.col("number").cast("string"), 3, "0"), F.when(F.col("drawn"), ".png").otherwise(".jpg"))
    return rows.select("export_id", "position", "number", F.coalesce("drawn", F.lit(False)).alias("drawn"), name.alias("file"))


def album_metadata(albums: DataFrame, notes: str) -> DataFrame:
    """(album_id, metadata): what an exported album says of itself, as JSON; empty fields are left out.

    ``albums``: album_id, series, issue_number, translated_title, original_title, target_lang, page_count.
    """
    filled = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    fields = {
        "Series": filled(F.col("series")),
        "Number": filled(F.col("issue_number")),
        "Title": F.coalesce(filled(F.col("translated_title")), filled(F.col("original_title"))),
        "LanguageISO": F.coalesce(filled(F.col("target_lang")), F.lit("sr")),
        "PageCount": F.col("page_count").cast("string"),
        "Notes": F.lit(notes or None),
    }
    return albums.select("album_id", F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))).alias("metadata"))
