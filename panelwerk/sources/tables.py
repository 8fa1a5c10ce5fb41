"""Schemas and rules of the corpus tables, loading them typed, and the rows that break a rule."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.session import checkpointed

_BOX = "x double, y double, width double, height double"
SCHEMAS = {
    "series": "series_id long, name string, source_lang string, target_lang string, translation_notes string",
    "glossary": "series_id long, source string, target string, kind string, note string, status string, origin string, occurrences long",
    "sound_glossary": "id long, source string, target string, note string",
    "allowed_words": "series_id long, word string",
    "albums": "album_id long, series_id long, issue_number string, original_title string, translated_title string, created_at timestamp_ntz",
    "sheets": "page_id long, album_id long, kind string, position long, import_order long, source_name string, image_path string, width int, height int, skip boolean, ocr_reviewed boolean, translation_reviewed boolean, panels array<array<double>>, cleaned_at timestamp_ntz",
    "blocks": f"block_id long, page_id long, position long, kind string, {_BOX}, text string, ocr_text string, ocr_model string, confidence double, bubble_polygon array<array<double>>, translation string, translation_model string, translation_status string, translation_too_long boolean, translation_note string, needs_review boolean, source string, continues_id long, updated_at timestamp_ntz",
    "patches": f"patch_id long, page_id long, block_id long, {_BOX}, image_path string",
    "memory": "series_id long, source string, target string, ord long",
    "history": "page_id long, kind string, position long, action string, created_at timestamp_ntz",
    "exports": "export_id long, album_id long, status string, positions array<long>, received array<long>, created_at timestamp_ntz, finished_at timestamp_ntz",
    "jobs": "job_id long, album_id long, type string, status string, progress long, total long, cost double, result string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "ratings": "rating_id long, study string, item long, turn long, candidate string, translation string, score int",
    "heartbeats": "worker_id string, ts timestamp_ntz",
    "styles": "style_id long, name string, text string, active boolean",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns of table ``name`` in their types; those it lacks are null, others are left out."""
    have = {c.lower() for c in df.columns}
    return df.select(*((F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)))


def load_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a folder (NAME.parquet each), typed: all known ones or those of ``names``."""
    return {n: spark.read.schema(schema(n)).parquet(f"{folder}/{n}.parquet") for n in names or SCHEMAS}


@dataclass(frozen=True)
class Rules:
    """What every row of a table must keep to. ``key`` identifies a row; ``unique`` lists other columns that are so together; ``given`` may not be
    null; ``refers`` names the table and column that a value (if any) must occur in; ``among`` lists the values that a column may have, if any."""

    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    given: tuple[str, ...] = ()
    refers: dict[str, tuple[str, str]] = field(default_factory=dict)
    among: dict[str, tuple] = field(default_factory=dict)


_SERIES = {"series_id": ("series", "series_id")}
_PAGE = {"page_id": ("sheets", "page_id")}
#: Rules of the tables (fixed values).
RULES = {
    "series": Rules(("series_id",), (("name",),), ("name", "source_lang", "target_lang")),
    "glossary": Rules(("series_id", "source", "target"), (), (), _SERIES, {"kind": ("name", "place", "phrase"), "status": ("suggested", "approved"), "origin": ("manual", "reference")}),
    "sound_glossary": Rules(("id",), (("source",),), ("source", "target")),
    "allowed_words": Rules(("series_id", "word"), (), (), _SERIES),
    "albums": Rules(("album_id",), (), ("series_id",), _SERIES),
    "sheets": Rules(("page_id",), (), ("album_id", "kind", "position", "import_order", "width", "height"), {"album_id": ("albums", "album_id")}, {"kind": ("original", "reference")}),
    "blocks": Rules(
        ("block_id",), (), ("page_id", "kind", "position", "x", "y", "width", "height"), _PAGE | {"continues_id": ("blocks", "block_id")},
        {"kind": ("speech", "thought", "caption", "sfx", "other", "title"), "translation_status": ("none", "draft", "edited", "approved"), "source": ("auto", "manual")},
    ),
    "patches": Rules(("patch_id",), (), ("page_id",), _PAGE | {"block_id": ("blocks", "block_id")}),
    "memory": Rules(("series_id", "source"), (), ("target",), _SERIES),
    "history": Rules(("page_id", "kind", "position"), (), ("action",), _PAGE, {"kind": ("undo", "redo")}),
    "exports": Rules(("export_id",), (), ("album_id",), {"album_id": ("albums", "album_id")}),
    "jobs": Rules(("job_id",), (), ("type", "status"), {"album_id": ("albums", "album_id")}, {"status": ("queued", "running", "done", "failed", "cancelled")}),
    "ratings": Rules(("rating_id",), (), ("study", "item", "candidate"), {}, {"score": (1, 2, 3, 4, 5)}),
    "styles": Rules(("style_id",), (("name",),), ("name",)),
}


def _read(name: str) -> list[str]:
    """Columns that the rules of a table read."""
    rules = RULES[name]
    return list(dict.fromkeys([*rules.key, *(c for u in rules.unique for c in u), *rules.given, *rules.refers, *rules.among]))


def _told(name: str, rows: DataFrame) -> DataFrame:
    """``rows`` with what is told of each alone, before it is shuffled: a hash of what the rules read (windows over it need not carry the row), and ``_own``, the reasons in its own values."""
    rules = RULES[name]
    own = [F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in dict.fromkeys([*rules.key, *rules.given])]
    own += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.concat(F.lit(f"{c} "), F.col(c).cast("string"))) for c, values in rules.among.items()]
    return rows.withColumns({"_order": F.xxhash64(F.to_json(F.struct(*_read(name)))), "_own": F.array_compact(F.array(*own))})


def _ordered(name: str, rows: DataFrame) -> DataFrame:
    """``_told`` rows that keep all columns: those that are alike in what the rules read are put in order by a hash of the whole row."""
    return _told(name, rows).withColumn("_whole", F.xxhash64(F.to_json(F.struct(*rows.columns))))


def _ruled(name: str, rows: DataFrame) -> DataFrame:
    """``_told`` rows with what meets other rows: keys and references. Repeats that are alike in what the rules read have the same reasons, so their order does not matter."""
    rules = RULES[name]
    kept = [*rules.key, *(c for u in rules.unique for c in u), *rules.refers]
    return _told(name, rows).select(*dict.fromkeys(kept), "_order", "_own")


def _judged(name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A table's rows with ``_reasons``: the rules that each breaks, in the order of the rules; none for a sound row.

    The row's own values were judged before (``_own``); repeats of a key by a window over its hash and values (all but the first are told, in the order of
    a hash of the row); references by a join with the distinct values referred to.
    """
    rules, rows = RULES[name], tables[name] if "_order" in tables[name].columns else _ordered(name, tables[name])
    reasons: list[Column] = []
    order = F.col("_order")
    ranked = [c for c in ("_order", "_whole") if c in rows.columns]
    for k, columns in enumerate([rules.key, *rules.unique]):
        # null keys are told above; their rows are spread by their own hash
        whole = ~F.concat_ws("", *[F.when(F.col(c).isNull(), "x") for c in columns]).contains("x")
        spread = F.when(whole, F.xxhash64(*columns)).otherwise(F.col(ranked[-1]))
        rows = rows.withColumn(f"_turn{k}", F.row_number().over(Window.partitionBy(spread, *columns).orderBy(*ranked)))
        reasons.append(F.when(whole & (F.col(f"_turn{k}") > 1), F.lit(f"repeated {', '.join(columns)}")))
    for k, (column, (other, there)) in enumerate(rules.refers.items()):
        if other in tables:
            known = tables[other].select(F.col(there).alias(f"_known{k}")).where(F.col(f"_known{k}").isNotNull()).distinct()
            # rows that refer to nothing, which may be most, are spread as well
            spread = F.when(F.col(column).isNull(), order).otherwise(F.xxhash64(column))
            rows = rows.join(known, (spread == F.xxhash64(f"_known{k}")) & (F.col(column) == F.col(f"_known{k}")), "left")
            reasons.append(F.when(F.col(column).isNotNull() & F.col(f"_known{k}").isNull(), F.lit(f"no {other} for {column}")))
    return rows.select(*tables[name].columns, F.concat("_own", F.array_compact(F.array(*reasons))).alias("_reasons"))


def checked_tables(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the sound rows of each table, the others as (table, key, reasons)).

    References are looked up in the tables as they are given; those to tables that are not given are not judged.
    """
    sound, broken = {}, []
    targets = {other for name in tables for other, _ in RULES[name].refers.values()}
    narrow = {name: _ruled(name, rows) for name, rows in tables.items()}
    narrow = {name: checkpointed(rows) if name in targets else rows for name, rows in narrow.items()}
    for name in tables:
        sound[name] = _judged(name, tables).where(F.size("_reasons") == 0).drop("_reasons")
        judged = _judged(name, narrow)
        key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in RULES[name].key])
        broken.append(judged.where(F.size("_reasons") > 0).select(F.lit(name).alias("table"), key.alias("key"), F.col("_reasons").alias("reasons")))
    rejected = broken[0]
    for more in broken[1:]:
        rejected = rejected.unionByName(more)
    return sound, rejected
