"""Translation memory, glossary and the plan of a translation run."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import Automaton, whole_words
from ..plans.session import checkpointed, python_workers
from .chains import with_chains
from .review import sound_words

#: Letters of a glossary that goes to all tasks as automata, and moves of these; bytes of known words that do, and what a row takes besides its word.
AUTOMATON_LETTERS, AUTOMATON_MOVES, LEXICON_BYTES, ROW_BYTES = 200_000, 16_000_000, 32 << 20, 40


def relevant_glossary(texts: DataFrame, glossary: DataFrame, key: str, most_letters: int = AUTOMATON_LETTERS) -> DataFrame:
    """(key, source, target): approved terms that occur as whole words in a flattened text of their series.

    ``texts``: (key, series_id, flat), keys unique. A glossary of ``most_letters`` at most becomes an automaton for each series, which go to
    all tasks; the texts are read once and nothing is shuffled. A larger one meets the texts by series and first word of a term.
    """
    terms = _terms(glossary)
    listed = _listed(terms, most_letters)
    return _by_first_word(texts, terms, key) if listed is None else _by_automaton(texts, listed, key)


def with_terms(rows: DataFrame, glossary: DataFrame, key: str, most_letters: int = AUTOMATON_LETTERS) -> DataFrame:
    """``rows`` (key, series_id, flat and others, keys unique) with ``terms``: what ``relevant_glossary`` finds for each, an array of [source, target].

    By automata the rows are read once and nothing is shuffled.
    """
    terms = _terms(glossary)
    listed = _listed(terms, most_letters)
    if listed is None:
        found = _by_first_word(rows.where("flat <> '' AND series_id IS NOT NULL"), terms, key).groupBy(key).agg(F.collect_set(F.array("source", "target")).alias("terms"))
        return rows.join(found, key, "left")
    return rows.withColumn("terms", _automata(rows, listed)("flat", "series_id"))


def _terms(glossary: DataFrame) -> DataFrame:
    return glossary.where("status = 'approved' AND source <> ''").select("series_id", "source", "target").distinct()


def _listed(terms: DataFrame, most_letters: int) -> dict | None:
    """Targets by series and source, if they are few enough to go to all tasks as automata."""
    letters = terms.agg(F.sum(F.length("source") + F.length("target"))).first()[0] or 0
    if letters > most_letters:
        return None
    listed: dict = {}
    for r in terms.collect():  # most_letters at most
        listed.setdefault(r.series_id, {}).setdefault(r.source, []).append(r.target)
    moves = sum(sum(map(len, t)) * (1 + len(set("".join(t)))) for t in listed.values())
    return listed if moves <= AUTOMATON_MOVES else None


def _is_letter(points: np.ndarray) -> np.ndarray:
    """Upper-case letters as the rule has them: A to Z, and U+00C0 to U+00DD."""
    return ((points >= 0x41) & (points <= 0x5A)) | ((points >= 0xC0) & (points <= 0xDD))


def _by_automaton(texts: DataFrame, listed: dict, key: str) -> DataFrame:
    kind = texts.schema[key].dataType.simpleString()
    sent = texts.sparkSession.sparkContext.broadcast(listed)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict = {}
        for batch in batches:
            for series, rows in batch.groupby("series_id", sort=False):
                if series not in sent.value:
                    continue
                if series not in made:
                    made[series] = Automaton(sorted(sent.value[series]))
                text, term = whole_words(made[series], rows.flat.to_list(), _is_letter)
                found = [(rows[key].iat[i], source, target) for i, k in zip(text.tolist(), term.tolist(), strict=True) for source in [made[series].terms[k]] for target in sent.value[series][source]]
                yield pd.DataFrame(found, columns=[key, "source", "target"])

    python_workers(texts.sparkSession, 10_000)
    return texts.where("flat <> '' AND series_id IS NOT NULL").select(key, "series_id", "flat").mapInPandas(find, f"{key} {kind}, source string, target string")


def _automata(rows: DataFrame, listed: dict) -> Callable:
    """A function of a flattened text and its series: sources and targets of the terms found."""
    sent = rows.sparkSession.sparkContext.broadcast(listed)

    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        made: dict = {}
        for flat, series in batches:
            found: list = [[] for _ in range(len(flat))]
            at = pd.Series(range(len(flat)))
            for s, places in at.groupby(series.to_numpy()):
                if s not in sent.value:
                    continue
                if s not in made:
                    made[s] = Automaton(sorted(sent.value[s]))
                text, term = whole_words(made[s], flat.iloc[places].fillna("").to_list(), _is_letter)
                for i, k in zip(text.tolist(), term.tolist(), strict=True):
                    source = made[s].terms[k]
                    found[places.iat[i]] += [[source, target] for target in sent.value[s][source]]
            yield pd.Series(found)

    python_workers(rows.sparkSession, 10_000)
    return F.pandas_udf(find, "array<array<string>>")


def _by_first_word(texts: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """A term can only occur where its first word does, so keys and terms meet by that word first; texts come in only for the pairs that are left."""
    letters = "A-ZÀ-Ý"
    first = lambda c: F.regexp_extract_all(c, F.lit(f"([{letters}]+|[^{letters} ]+)"), 1)
    terms = terms.withColumn("token", F.get(first(F.col("source")), F.lit(0)))
    tokens = texts.select(key, "series_id", F.explode(F.array_distinct(first(F.col("flat")))).alias("token"))
    pairs = tokens.join(terms.where("token IS NOT NULL"), ["series_id", "token"]).select(key, "source", "target")
    quoted = F.concat(F.lit("\\Q"), F.replace("source", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.concat(F.lit(f"(?<![{letters}])"), quoted, F.lit(f"(?![{letters}])"))
    return pairs.join(texts.select(key, "flat"), key).where(F.contains("flat", "source") & F.rlike("flat", pattern)).select(key, "source", "target").distinct()


def _hashed(df: DataFrame, column: str, digest) -> DataFrame:
    """``df`` with a hash and the length of a text, by which long texts meet."""
    return df.withColumns({"_hash": digest(column), "_length": F.length(column)})


#: What rows of equal texts meet by, beside the texts' length.
BY_TEXT = ["series_id", "_hash", "_length"]


def memory_lookup(texts: DataFrame, memory: DataFrame, digest=F.xxhash64) -> DataFrame:
    """``texts`` (with series_id and flat) and the ``remembered`` target of an equal source of the series, if any.

    Texts meet by a hash (``digest``) and their length, and are compared then: of one length, one begins with the other only if both are equal.
    """
    known = _hashed(memory.select("series_id", F.col("source").alias("_source"), F.col("target").alias("remembered")), "_source", digest)
    known = known.withColumnsRenamed({c: f"_m{c}" for c in BY_TEXT})
    rows = _hashed(texts, "flat", digest)
    same = reduce(and_, [F.col(c) == F.col(f"_m{c}") for c in BY_TEXT]) & F.startswith("flat", "_source")
    return rows.join(known, same, "left").drop("_source", "_hash", "_length", *(f"_m{c}" for c in BY_TEXT))


def _approvals(approved: DataFrame) -> DataFrame:
    """(series_id, source, target, ord) of approvals with a source and a target."""
    rows = approved.where("trim(translation) <> ''").select("series_id", "text", F.col("translation").alias("target"), "ord")
    return T.with_flat(rows, "text", "source").drop("text")


def latest_memory(approved: DataFrame, digest=F.xxhash64) -> DataFrame:
    """(series_id, source, target): the last approval of each flattened source; blank translations do not count.

    ``approved``: (series_id, text, translation, ord). Rows are sorted by a hash and the length first, so that texts are compared only where these agree.
    """
    rows = _hashed(_approvals(approved), "source", digest)
    return rows.groupBy(*BY_TEXT, "source").agg(F.max_by("target", "ord").alias("target")).select("series_id", "source", "target")


def upsert_memory(memory: DataFrame, approved: DataFrame) -> DataFrame:
    """A memory with the approvals on top: a new approval replaces an older entry of its key.

    ``memory``: series_id, source, target; with ``ord`` the last entry of a key counts, without it keys are unique. Entries and approvals of a key meet in one
    aggregate, so each text is shuffled once.
    """
    old = memory.select("series_id", "source", "target", (F.col("ord").cast("long") if "ord" in memory.columns else F.lit(0).cast("long")).alias("_old"))
    new = _approvals(approved).withColumnRenamed("ord", "_new")
    rows = _hashed(old.unionByName(new, allowMissingColumns=True), "source", F.xxhash64)
    last = F.struct(F.col("_new").isNotNull(), "_new", "_old")
    return rows.groupBy(*BY_TEXT, "source").agg(F.max_by("target", last).alias("target")).select("series_id", "source", "target")


def context_before(blocks: DataFrame, n: int = 12) -> DataFrame:
    """``previous_page_context`` of blocks that know the page (``for_page``) that comes after theirs: they are shuffled by it, once."""
    rows = T.with_flat(blocks.where("trim(translation) <> ''").select("for_page", "page_id", "position", "text", "translation"))
    rows = rows.select("for_page", "page_id", "position", F.col("flat").alias("source"), F.col("translation").alias("target")).repartition("for_page")
    back = F.row_number().over(Window.partitionBy("for_page", "page_id").orderBy(F.desc("position")))
    return rows.withColumn("back", back).where(F.col("back") <= n).select(F.col("for_page").alias("page_id"), "back", "source", "target")


def least_memory(approved: DataFrame, n: int = 8) -> DataFrame:
    """Of ``latest_memory`` the first ``n`` sources of each series. Ranks are told in each task first, so no more than these are shuffled."""
    rank = F.dense_rank().over(Window.partitionBy("series_id").orderBy("source"))
    rows = _approvals(approved).withColumn("_rank", rank).where(F.col("_rank") <= n)
    return rows.groupBy("series_id", "source").agg(F.max_by("target", "ord").alias("target"))


def previous_page_context(sheets: DataFrame, blocks: DataFrame, n: int = 12) -> DataFrame:
    """(page_id, place, source, target): the last translated pairs of the page before, in order."""
    pages = sheets.select("page_id", "album_id", "kind", "position")
    after = pages.select(F.col("page_id").alias("for_page"), "album_id", F.col("kind").alias("page_kind"), (F.col("position") - 1).alias("before"))
    rows = blocks.where("trim(text) <> '' AND trim(translation) <> ''").select("page_id", F.col("position").alias("p"), "text", "translation")
    last = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("p")))
    rows = rows.withColumn("back", last).where(F.col("back") <= n)
    prior = pages.select("page_id", "album_id", F.col("kind").alias("page_kind"), F.col("position").alias("before"))
    found = after.join(prior, ["album_id", "page_kind", "before"]).join(rows, "page_id")
    return found.select(F.col("for_page").alias("page_id"), F.col("back"), T.flatten(F.col("text")).alias("source"), F.col("translation").alias("target"))


#: Letters of a text that stands for itself where texts meet; a longer one is told by its SHA-256.
TAG_LETTERS = 64
#: What equal texts of a series have in common.
BY_TAG = ["series_id", "_length", "_tag"]


def tagged(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the length and the tag of a text, which texts have in common only if they are equal."""
    tag = F.when(F.length(column) <= TAG_LETTERS, F.col(column)).otherwise(F.sha2(F.col(column), 256))
    return rows.withColumns({"_length": F.length(column), "_tag": tag})


def tagged_memory(approved: DataFrame) -> DataFrame:
    """``latest_memory`` by the tags of its sources. ``approved``: (series_id, translation, ord) and what ``tagged`` made of the flattened text."""
    rows = approved.where("trim(translation) <> '' AND _length > 0")
    return rows.groupBy(*BY_TAG).agg(F.max_by("translation", "ord").alias("target"))


def _remembered(rows: DataFrame, memory: DataFrame) -> DataFrame:
    """``rows`` with the ``remembered`` target of an equal text of the series, if any; both tagged."""
    known = memory.select(*(F.col(c).alias(f"_m{c}") for c in BY_TAG), F.col("target").alias("remembered"))
    return rows.join(known, reduce(and_, [F.col(c) == F.col(f"_m{c}") for c in BY_TAG]), "left").drop(*(f"_m{c}" for c in BY_TAG))


def translation_plan(blocks: DataFrame, memory: DataFrame, overwrite: bool = False, asked_only: bool = False, shown: Sequence[str] | None = None) -> DataFrame:
    """How each block with text is to be translated: ``kept``, by the sound ``glossary``, from ``memory`` or by the ``model``.

    ``blocks``: with series_id; with continues_id, chains of blocks with text go to the model as one, if any of their blocks is
    eligible: each row has its chain's ``head``, its ``part`` in it and the chain's route. Only untranslated blocks are eligible,
    with ``overwrite`` drafts too. With ``asked_only`` blocks that are kept are left out. ``memory``: of ``latest_memory`` or ``tagged_memory``.
    ``shown``: columns of blocks, flat among them, that the plan is to have (all, if it is not given); give few, as chains sort them by page.
    ``memory_too_long`` tells whether what is remembered is too long.

    Blocks meet the memory first, by tags, so that chains are resolved without texts.
    """
    linked = "continues_id" in blocks.columns
    statuses = ["none", "draft"] if overwrite else ["none"]
    eligible = F.col("translation_status").isin(*statuses)
    if asked_only and not linked:
        blocks, eligible = blocks.where(eligible), F.lit(True)
    rows = T.with_flat(blocks.withColumn("_eligible", eligible))  # told here, the status need not be carried
    eligible = F.col("_eligible")
    shown = [c for c in (shown or rows.columns) if c not in ("block_id", "page_id", "continues_id", "_eligible")]
    told = ["_eligible", *(c for c in ("kind", "position") if c in rows.columns and c not in shown)]
    memory = memory if "_tag" in memory.columns else tagged(memory, "source")
    keys = ["block_id", "page_id", *(["continues_id"] if linked else []), *([] if "series_id" in shown else ["series_id"])]
    rows = tagged(rows, "flat").select(*keys, *shown, *told, "_length", "_tag")
    if asked_only:  # what is kept, and sounds, are routed without the memory
        used = eligible & (F.col("kind") != "sfx")
        found = _remembered(rows.where(used), memory).unionByName(rows.where(~F.coalesce(used, F.lit(False))), allowMissingColumns=True)
    else:
        found = _remembered(rows, memory)
    long = T.too_long_for(F.col("_length"), F.col("remembered"))
    found = found.withColumn("memory_too_long", long).drop("_length", "_tag", *([] if "series_id" in shown else ["series_id"]))
    if linked:
        chain = Window.partitionBy("page_id", "head")
        found = with_chains(found).withColumns({"eligible": F.bool_or(eligible).over(chain), "chained": F.count("*").over(chain) > 1})
    else:
        found = found.withColumns({"head": F.col("block_id"), "part": F.lit(0), "eligible": eligible, "chained": F.lit(False)})
    if asked_only:
        found = found.where("eligible")
    found = found.withColumn("remembered", F.when(~F.col("chained"), F.col("remembered")))
    route = (
        F.when(~F.col("eligible"), "kept")
        .when(F.col("chained"), "model")
        .when(F.col("kind") == "sfx", "glossary")
        .when(F.col("remembered").isNotNull(), "memory")
        .otherwise("model")
    )
    return found.withColumn("route", route).drop("eligible", "chained", *told)


def translation_totals(plan: DataFrame, sheets: DataFrame) -> DataFrame:
    """Per album, over its original pages that are not skipped: pages, chains by route (a block alone is one) and those whose memory is too long."""
    pages = sheets.where("kind = 'original' AND NOT skip").select("page_id", "album_id")
    by = lambda r: F.count_if(F.col("route") == r)
    counts = {
        "translated": F.count_if(F.col("route").isin("glossary", "memory", "model")),
        "from_memory": by("memory"),
        "by_glossary": by("glossary"),
        "by_model": by("model"),
        "too_long": F.count_if((F.col("route") == "memory") & F.col("memory_too_long")),
    }
    per_page = plan.where("part = 0").groupBy("page_id").agg(*(c.alias(n) for n, c in counts.items()))
    rows = pages.join(per_page, "page_id", "left")
    return rows.groupBy("album_id").agg(F.count_distinct("page_id").alias("pages"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts))


def suggest_entries(extracted: DataFrame, glossary: DataFrame) -> DataFrame:
    """The glossary with suggestions counted in: (series_id, source, target, kind, status, occurrences).

    ``extracted``: (series_id, page_id, source, target, kind), counted once a page. A new pair takes its commonest kind (tie: the
    one seen on the first page) and is suggested; a suggested one is counted up; approved ones stay.
    """
    pair = ["series_id", "source", "target"]
    once = extracted.distinct()
    kinds = once.groupBy(*pair, "kind").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    best = kinds.groupBy(*pair).agg(F.sum("n").alias("found"), F.max_by("kind", F.struct("n", -F.col("first"), "kind")).alias("new_kind"))
    both = glossary.join(best, pair, "full")
    return both.select(
        *pair,
        F.coalesce("kind", "new_kind").alias("kind"),
        F.coalesce("status", F.lit("suggested")).alias("status"),
        F.when(F.col("status") == "approved", F.col("occurrences")).otherwise(F.coalesce("occurrences", F.lit(0)) + F.coalesce("found", F.lit(0))).alias("occurrences"),
    )


def unknown_words(texts: DataFrame, lexicon: DataFrame, allowed: DataFrame, key: str, most_bytes: int = LEXICON_BYTES) -> DataFrame:
    """(key, word, place, spelling): words, in lower case, that neither table of ``word`` has; the first spelling and place of each.

    The words of a text are sorted once, so that the first of each stands beside the one before it. Known words of ``most_bytes`` at most go
    to all tasks, and the texts are read once; of more, the texts' distinct words (counted before they are shuffled) are looked up first, and only
    rows of unknown ones, which are rare each, meet them.
    """
    each = F.transform(T.words(F.col("text")), lambda w, i: F.struct(F.lower(w).alias("word"), i.alias("place"), w.alias("spelling")))
    first = T.let(F.sort_array(each), lambda ws: F.filter(ws, lambda w, i: (i == 0) | (F.get(ws, i - 1)["word"] != w["word"])))
    rows = texts.select(key, F.inline(first)).select(key, "word", "place", "spelling")
    known = checkpointed(lexicon.select("word").unionByName(allowed.select("word")).where("word IS NOT NULL").distinct())
    size = known.agg(F.sum(F.octet_length("word") + F.lit(ROW_BYTES))).first()[0] or 0
    if size <= most_bytes:
        return rows.join(F.broadcast(known), "word", "left_anti").select(key, "word", "place", "spelling")
    unknown = rows.select("word").distinct().join(known, "word", "left_anti")
    return rows.join(unknown, "word", "left_semi").select(key, "word", "place", "spelling")


def missing_sounds(blocks: DataFrame, sheets: DataFrame, albums: DataFrame, series: DataFrame, sfx_glossary: DataFrame) -> DataFrame:
    """(word, count, suggestion), by falling count and word: words of sound blocks that the glossary has neither alone nor in the block's phrase.

    Only original pages of series that are translated (source and target language differ) count. The suggestion is the form that
    a look-up of the word gives: drawn out from the glossary, or by the rule.
    """
    translated = series.where("source_lang <> target_lang").select("series_id")
    pages = sheets.where("kind = 'original'").select("page_id", "album_id").join(albums.select("album_id", "series_id"), "album_id").join(translated, "series_id", "left_semi")
    rows = blocks.where("kind = 'sfx'").join(pages.select("page_id"), "page_id", "left_semi").select(T.flatten(F.col("text")).alias("flat")).withColumn("key", T.sound_key(F.col("flat")))
    known = sfx_glossary.select(F.col("source").alias("key")).distinct()
    found = rows.join(known, "key", "left_anti").select(F.explode(F.regexp_extract_all("flat", F.lit(r"(\p{L}+)"), 1)).alias("word"))
    counts = found.groupBy("word").agg(F.count("*").alias("count")).join(known.withColumnRenamed("key", "word"), "word", "left_anti")
    forms = sound_words(counts.select("word"), sfx_glossary).select("word", F.col("form").alias("suggestion"))
    return counts.join(forms, "word").orderBy(F.desc("count"), "word")
