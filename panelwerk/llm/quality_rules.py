"""Line-first quality rules, DataFrame functions only.

Every line of a text is judged first, by punctuation, navigation and boilerplate rules. Failing lines are removed, and a
document that loses too large a share of its word characters is rejected. Everything happens inside one row of one scan:
there is no shuffle, so neither a hot source nor a long text needs special care.

Defined results: a null text counts as no words and fails the base rule, as do empty and blank texts; repeated rows are
judged one by one; an empty table gives no rows; extra columns pass through ``line_quality`` untouched (its own columns start
with ``lq_``; an input's of these names are kept under other names).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, free_name, let, set_aside, table, words

#: Marks that count as symbols, and the class that deletes them.
SYMBOLS = "#*$%&|<>"
SYMBOL_CLASS = "[#*$%&|<>]"

#: Production parameters of the line rules.
MAX_SYMBOLS_PER_WORD = 0.5  # of a line with at least MIN_LINE_WORDS words
MAX_EXCLAIMED = 0.5  # share of a line's words that end in !! or ??
MAX_SEPARATORS = 0.2  # share of a line's words that are only a separator
MIN_LINE_WORDS = 4
MAX_BOILERPLATE_WORDS = 25
MAX_LOST = 0.5  # share of word characters in removed lines

#: Words that stand for a menu's separators (fixed values).
SEPARATORS = ["|", "||", "»", "«", "›", "‹", "•", "·", "→", "←", "::", "/", ">", "<", ">>", "<<"]
#: What a text must have for a rule on marks to count anything: a symbol, a separator or a doubled !! or ??.
MARKS = "[#*$%&|<>»«›‹•·→←]|!!|[?][?]|::|/"
#: Phrases of boilerplate lines, lower case (fixed values).
BOILERPLATE = [
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "cookie settings",
    "cookie consent", "accept cookies", "accept all cookies", "enable javascript", "javascript is disabled",
    "javascript is required", "sign in to", "log in to", "click here to", "subscribe to our", "skip to content",
    "skip to main content", "lorem ipsum", "back to top", "tous droits réservés", "alle rechte vorbehalten",
    "todos los derechos reservados", "politique de confidentialité", "conditions d'utilisation", "mentions légales",
    "accepter les cookies", "cliquez ici pour", "aller au contenu", "datenschutzerklärung", "nutzungsbedingungen",
    "cookies akzeptieren", "zum inhalt springen", "klicken sie hier", "política de privacidad", "términos de uso", "aviso legal",
    "aceptar cookies", "haga clic aquí", "ir al contenido",
]

#: Up to so many different repeated windows are looked up one by one.
FEW = 24


def _chars(ws: Column) -> Column:
    """Code points of a list of words."""
    return F.length(F.array_join(ws, ""))


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, SYMBOL_CLASS, ""))


def _repeat_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are compared by a 64-bit hash of their three words. Texts without a repeated window (a set of the hashes is as
    large as their list) end there. Otherwise sorting the hashes shows which occur twice. A few of them are looked up
    one by one; many are found by sorting (hash, position) pairs, so that equal windows become neighbours. Both ways mark
    the three positions of each repeated window.
    """

    def covered(positions: Column) -> Column:
        known = F.filter(positions, lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(known, lambda i: F.array(i, i + 1, i + 2)))))

    def neighbours(pairs: Column) -> Column:
        same = lambda i, h: F.coalesce(F.get(pairs, i)["h"] == h, F.lit(False))
        return covered(F.transform(pairs, lambda p, i: F.when(same(i + 1, p["h"]) | ((i > 0) & same(i - 1, p["h"])), p["i"])))

    def among(h: Column, twice: Column) -> Column:
        few = covered(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)))
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(twice) <= FEW, few).otherwise(let(pairs, neighbours))

    def twice(ordered: Column) -> Column:
        return F.array_distinct(F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i + 1) == x, F.lit(False))))

    def of(w: Column) -> Column:
        windows = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
        hashes = F.transform(windows, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
                let(let(F.sort_array(h), twice), lambda t: among(h, t))
            ),
        )

    return let(ws, of)


def line_fails(line: Column, parts: Column, marked: Column) -> Column:
    """Whether a line fails a punctuation, navigation or boilerplate rule.

    ``parts``: its words; ``marked``: whether its text has any mark that the first three rules count.
    """
    n = F.size(parts)
    long_enough = n >= MIN_LINE_WORDS
    exclaimed = F.size(F.filter(parts, lambda w: w.endswith("!!") | w.endswith("??")))
    separators = F.size(F.filter(parts, lambda w: w.isin(SEPARATORS)))
    boilerplate = let(F.lower(line), lambda x: _any(x.contains(p) for p in BOILERPLATE))

    def by_marks(s: Column) -> Column:
        return (
            (long_enough & (_symbols(line) - s > MAX_SYMBOLS_PER_WORD * n))
            | (long_enough & (exclaimed > MAX_EXCLAIMED * n))
            | ((s >= 2) & (s > MAX_SEPARATORS * n))
        )

    return (marked & let(separators, by_marks)) | ((n <= MAX_BOILERPLATE_WORDS) & boilerplate)


def _any(tests: Iterable[Column]) -> Column:
    return reduce(or_, tests)


def line_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its counts, its cleaned text and its verdict in ``lq_`` columns."""
    docs = set_aside(docs, *(c for c in docs.columns if c.lower().startswith("lq_")))
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))
    judged = docs.withColumn("lq_lines", F.transform(lines, lambda x: F.struct(x.alias("line"), words(x).alias("parts"))))
    judged = judged.withColumns({"lq_words": F.flatten(F.transform("lq_lines", lambda x: x["parts"])), "lq_marked": body.rlike(MARKS)})
    judged = judged.withColumns(
        {
            "lq_word_chars": _chars(F.col("lq_words")).cast("long"),
            "lq_n_symbols": F.when(F.col("lq_marked"), _symbols(body)).otherwise(0).cast("long"),
            "lq_n_words": F.size("lq_words").cast("long"),
            "lq_n_repeat_words": _repeat_words(F.col("lq_words")).cast("long"),
            "lq_n_dup_lines": let(F.transform("lq_lines", lambda x: x["line"]), lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
            "lq_kept_lines": F.filter("lq_lines", lambda x: ~line_fails(x["line"], x["parts"], F.col("lq_marked"))),
        }
    ).drop("lq_words", "lq_marked")
    judged = judged.withColumns(
        {
            "lq_text": F.array_join(F.transform("lq_kept_lines", lambda x: x["line"]), "\n"),
            "lq_kept_chars": _chars(F.flatten(F.transform("lq_kept_lines", lambda x: x["parts"]))).cast("long"),
            "lq_n_lines_removed": (F.size("lq_lines") - F.size("lq_kept_lines")).cast("long"),
            "lq_base_failed": (F.col("lq_n_words") < 50) | (100 * F.col("lq_n_repeat_words") > 50 * F.col("lq_n_words")),
        }
    ).drop("lq_lines", "lq_kept_lines")
    lost = F.col("lq_word_chars") - F.col("lq_kept_chars")
    return judged.withColumn("lq_kept", ~F.col("lq_base_failed") & (lost <= MAX_LOST * F.col("lq_word_chars")))


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` (doc_id, text, n_chars and others) without their failing lines.

    Rejected rows leave by a generator: a filter would be pushed below the projections and repeat all their expressions.
    """
    given = docs.columns
    docs = docs.withColumnsRenamed({c: free_name(docs, "in_" + c) for c in given if c.lower().startswith("lq_")})
    judged = line_quality(docs)
    cleaned = judged.withColumn("text", F.when(F.col("lq_n_lines_removed") > 0, F.col("lq_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast("long"))
    return cleaned.select(F.inline(F.when(F.col("lq_kept"), F.array(F.struct(*docs.columns))))).toDF(*given)


def op3_line_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    named = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "kept_chars"]
    return line_quality(docs).select("doc_id", *(F.col(f"lq_{x}").alias(x) for x in named))


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: The same rows in DuckDB's SQL.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
grams AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
counted AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM grams),
repeated AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM
  (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM counted WHERE n >= 2) GROUP BY rid),
lines AS (SELECT rid, unnest(ls) AS line FROM w),
lparts AS (SELECT rid, line, list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ps,
  length(line) - length(translate(line, '{SYMBOLS}', '')) AS syms FROM lines),
lcounts AS (SELECT *, len(ps) AS n, len(list_filter(ps, lambda x: x LIKE '%!!' OR x LIKE '%??')) AS ex,
  len(list_filter(ps, lambda x: list_contains({_list(SEPARATORS)}, x))) AS seps FROM lparts),
ljudged AS (SELECT rid, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars,
  (n >= {MIN_LINE_WORDS} AND syms - seps > {MAX_SYMBOLS_PER_WORD} * n) OR (n >= {MIN_LINE_WORDS} AND ex > {MAX_EXCLAIMED} * n)
  OR (seps >= 2 AND seps > {MAX_SEPARATORS} * n)
  OR (n <= {MAX_BOILERPLATE_WORDS} AND ({" OR ".join(f"contains(lower(line), '{p.replace(chr(39), chr(39) * 2)}')" for p in BOILERPLATE)})) AS fails FROM lcounts),
lsum AS (SELECT rid, CAST(sum(CASE WHEN fails THEN 0 ELSE chars END) AS BIGINT) AS kept_chars,
  CAST(sum(CASE WHEN fails THEN 1 ELSE 0 END) AS BIGINT) AS n_lines_removed FROM ljudged GROUP BY rid),
base AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(kept_chars, 0) AS kept_chars
  FROM w LEFT JOIN repeated USING (rid) LEFT JOIN lsum USING (rid)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars - kept_chars <= {MAX_LOST} * word_chars AS kept, n_lines_removed, kept_chars FROM failed
"""
