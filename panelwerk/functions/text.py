"""Text functions as column expressions: lettering, OCR clean-up, checks of translations.

All are built from Spark's own functions, so they stay in the JVM. Patterns are Unicode-aware where letters are meant.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# -- fixed values of the rules

LONG_RATIO, LONG_LEAST = 1.3, 10
MAX_LOWERCASE = 0.3
STYLED_KINDS = ("sfx", "title", "other")
#: Cyrillic letters with one Latin letter each, and those with more or none.
CYRILLIC = ("АБВГДЂЕЖЗИЈКЛМНОПРСТЋУФХЦЧШЫЭ", "ABVGDĐEŽZIJKLMNOPRSTĆUFHCČŠIE")
CYRILLIC_MORE = {"Љ": "LJ", "Њ": "NJ", "Џ": "DŽ", "Ё": "JO", "Щ": "ŠĆ", "Ъ": "", "Ь": "", "Ю": "JU", "Я": "JA"}
SERBIAN_FORMS = [("TISUĆ", "HILJAD"), ("TKO\\b", "KO"), ("NETKO\\b", "NEKO"), ("NITKO\\b", "NIKO")]
NON_SERBIAN_WORDS = ["TKO", "NETKO", "NITKO", "SVATKO", "PRIJE"]
NON_SERBIAN_STEMS = [
    "TISUĆ", "TOČN", "TJED", "KRUH", "VLAK", "OBITELJ", "ZRAKOPLOV",
    "UVIJEK", "VRIJEM", "RIJEČ", "DJEVOJ", "LIJEP", "BIJEL", "CIJEL", "MJEST", "DJEC", "SVIJET",
    "VIJEST", "POSLIJE", "OVDJE", "GDJE", "ONDJE", "NIGDJE", "NEGDJE", "SJEĆ", "RIJEK",
    "ČOVJEK", "TIJEL", "PJESM", "MLIJEK", "DIJET", "SNIJEG", "MJESEC", "ŽELJEZ", "SJEDI", "VJER",
]
ACCENTS = {"À": "A'", "Á": "A'", "È": "E'", "É": "E'", "Ì": "I'", "Í": "I'", "Ò": "O'", "Ó": "O'", "Ù": "U'", "Ú": "U'", "`": "'", "’": "'", "‘": "'", "“": '"', "”": '"', "…": "..."}
SOUND_RULES = [("CH", "Č"), ("CK", "K"), ("WH", "V"), ("PH", "F"), ("TH", "T"), ("C", "K"), ("Q", "K"), ("X", "KS"), ("W", "V"), ("Y", "J")]
PUNCTUATION_FIXES = [("(?<=[A-ZÀ-Ý])- (?=[A-ZÀ-Ý])", "-\n"), ("·", "'"), ("''", "'"), ("!/", "!"), (r"(?U)\s+/(?=\.{2,})", "!")]
HYPHENATED = [(r"-\*[ \t]*\n(?U:\s)*\*", ""), (r"-\*[ \t]*\n(?U:\s)*([^*\s]+)", "$1*"), (r"([^*\s]+)-[ \t]*\n(?U:\s)*\*", "*$1"), (r"-[ \t]*\n(?U:\s)*", "")]
LETTERS = "A-Za-zČĆŽŠĐčćžšđ"
SENTENCE_ENDS = list('.!?…»"”)')


def _chained(text: Column, rules: list[tuple[str, str]], step: Callable = F.regexp_replace) -> Column:
    return reduce(lambda t, r: step(t, F.lit(r[0]), F.lit(r[1])), rules, text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` made once: a variable of a lambda is bound, an expression is made anew wherever it stands."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeezed(text: Column) -> Column:
    """Single spaces, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def upper(text: Column) -> Column:
    """Upper case with ß as SS."""
    return F.upper(F.replace(text, F.lit("ß"), F.lit("ss")))


def lettering(text: Column) -> Column:
    return squeezed(upper(text))


def join_hyphenated(text: Column) -> Column:
    """Join words split at a line's end; a word emphasised in part becomes emphasised as a whole."""
    return _chained(text, HYPHENATED)


def flatten(text: Column, emphasis: bool = False) -> Column:
    """A block's text in one line."""
    joined = F.when(F.contains(text, F.lit("\n")), join_hyphenated(text)).otherwise(text)  # no rule fits a text of one line
    return lettering(joined if emphasis else F.replace(joined, F.lit("*"), F.lit("")))


def with_flat(rows: DataFrame, column: str = "text", name: str = "flat") -> DataFrame:
    """``rows`` with a flattened text that is not empty. It is made once for each row: a filter on a column makes it a second time below."""
    return rows.select("*", F.explode_outer(F.array(flatten(F.col(column)))).alias(name)).where(F.col(name) != "")


def normalize_text(text: Column) -> Column:
    """The form in which error rates compare texts."""
    t = _chained(upper(text), list(ACCENTS.items()), F.replace)
    t = F.regexp_replace(t, r"-[ \t]*\n(?U:\s)*", "")
    return squeezed(F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"(?U)\s+(?=[!?.,;:])", ""))


def to_latin(text: Column) -> Column:
    return _chained(F.translate(text, *CYRILLIC), list(CYRILLIC_MORE.items()), F.replace)


def serbian_forms(text: Column) -> Column:
    return _chained(text, [(rf"(?U)\b{p}", s) for p, s in SERBIAN_FORMS])


def clean_output(raw: Column) -> Column:
    """A model's answer without fences, label, outer quotes and blank lines."""
    strip = lambda t: F.regexp_replace(t, r"(?U)^\s+|(?<!\s)\s+\z", "")
    t = strip(F.regexp_replace(strip(raw), r"^```[a-zA-Z]*(?U:\s)*|(?<!(?U:\s))(?U:\s)*```\z", ""))
    t = F.regexp_replace(t, r"(?i)^(text|testo|transcription|ocr)(?U:\s)*:(?U:\s)*", "")

    def unquoted(t: Column) -> Column:
        quoted = reduce(lambda a, b: a | b, [(F.left(t, F.lit(1)) == o) & (F.right(t, F.lit(1)) == c) for o, c in ('""', "“”", "«»")])
        return F.when((F.length(t) >= 2) & quoted, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)

    lines = F.transform(F.split(let(t, unquoted), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def fix_punctuation(text: Column) -> Column:
    return _chained(text, PUNCTUATION_FIXES)


def lowercase_share(text: Column) -> Column:
    """Share of lower-case letters among letters; null without letters."""
    count = lambda t, c: F.length(t) - F.length(F.regexp_replace(t, c, ""))
    return let(text, lambda t: let(count(t, r"\p{L}+"), lambda letters: F.when(letters > 0, count(t, r"\p{Ll}+") / letters)))


def uppercase_lettering(text: Column) -> Column:
    return let(text, lambda t: F.when(lowercase_share(t) <= MAX_LOWERCASE, F.upper(t)).otherwise(t))


def needs_review(text: Column) -> Column:
    """No letters, mostly lower case, a letter beyond Latin, or a very long text."""
    low = lambda share: share.isNull() | (share > MAX_LOWERCASE)
    return let(text, lambda t: (F.length(t) > 500) | let(lowercase_share(t), low) | t.rlike(r"[\p{L}&&[^\u0000-\u024F]]"))


def tame_repeats(text: Column) -> Column:
    """Shorten what a model repeats when it is stuck: a character beyond 8 times, a pattern beyond 6."""
    return F.regexp_replace(F.regexp_replace(text, r"(.)\1{8,}", "$1$1$1$1"), r"(..{1,3}?)\1{6,}", "$1$1$1")


def ocr_read(raw: Column, kind: Column) -> Column:
    """(text, looped): the text of a model's answer for a block, and whether the model repeated itself; the answer is cleaned once for both."""

    def read(t: Column) -> Column:
        lettered = lambda u: F.when(kind.isin(*STYLED_KINDS) & ~u.rlike(r"\p{L}"), "").otherwise(u)
        return let(tame_repeats(t), lambda u: F.struct(uppercase_lettering(lettered(u)).alias("text"), (t != u).alias("looped")))

    return let(fix_punctuation(clean_output(raw)), read)


def ocr_text(raw: Column, kind: Column) -> Column:
    """The text of a model's answer for a block."""
    return ocr_read(raw, kind)["text"]


def ocr_looped(raw: Column) -> Column:
    return ocr_read(raw, F.lit(""))["looped"]


def not_a_sound(text: Column) -> Column:
    """At least three words, all different, none with a tripled letter: a sign rather than a sound."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}{3,})"), 1), upper)
    differ = lambda ws: (F.size(ws) >= 3) & (F.size(F.array_distinct(ws)) == F.size(ws))
    return let(found, lambda ws: differ(ws) & ~F.exists(ws, lambda w: w.rlike(r"(.)\1\1")))


def emphasis_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\*[^*\s][^*]*\*"))


def keep_emphasis(source: Column, translation: Column) -> Column:
    """A translation keeps its marks only if it has as many emphasised parts as the source."""
    stars = F.regexp_count(translation, F.lit(r"\*"))
    same = (emphasis_count(translation) == emphasis_count(source)) & (stars % 2 == 0)
    return F.when(same, translation).otherwise(squeezed(F.replace(translation, F.lit("*"), F.lit(""))))


def _bare_length(text: Column) -> Column:
    return F.length(F.replace(text, F.lit("*"), F.lit("")))


def too_long_for(letters: Column, translation: Column) -> Column:
    """``is_too_long`` where of the source only its length without marks is at hand."""
    return _bare_length(translation) > LONG_RATIO * F.greatest(letters, F.lit(LONG_LEAST))


def is_too_long(source: Column, translation: Column) -> Column:
    return too_long_for(_bare_length(source), translation)


def sound_key(text: Column) -> Column:
    """Letters and digits only, upper case: the key of a sound word."""
    return F.array_join(F.regexp_extract_all(upper(text), F.lit(r"(\p{L}+|\p{N}+)"), 1), " ")


def adapt_sound(word: Column) -> Column:
    """A word with SH or W as it is pronounced; other words unchanged."""
    word = upper(word)
    # each H after an S is one Š
    hissed = F.array_join(
        F.transform(
            F.regexp_extract_all(word, F.lit("(SH+|S(?!H)|[^S]+)"), 1),
            lambda p: F.when(p.startswith("SH"), F.repeat(F.lit("Š"), F.length(p) - 1)).otherwise(p),
        ),
        "",
    )
    return F.when(word.contains("SH") | word.contains("W"), _chained(hissed, SOUND_RULES, F.replace)).otherwise(word)


def collapsed(word: Column) -> Column:
    """A word without drawn-out letters."""
    return F.regexp_replace(word, r"(?s)(.)\1+", "$1")


def uses_glossary_term(translation: Column, target: Column) -> Column:
    """Every word of the term, less its last two letters but three at least, occurs in the translation."""
    text = upper(translation)
    words = F.filter(F.split(upper(target), r"(?U)\s+"), lambda w: w != "")
    return F.forall(words, lambda w: F.contains(text, F.left(w, F.greatest(F.lit(3), F.length(w) - 2))))


def words(text: Column) -> Column:
    """Words with inner apostrophes and hyphens."""
    return F.regexp_extract_all(text, F.lit(f"([{LETTERS}]+(?:['’\\-][{LETTERS}]+)*)"), 1)


def non_serbian_words(text: Column) -> Column:
    found = F.regexp_extract_all(upper(text), F.lit("([A-ZČĆŽŠĐ]+)"), 1)
    foreign = lambda w: w.isin(NON_SERBIAN_WORDS) | w.rlike(f"^({'|'.join(NON_SERBIAN_STEMS)})")
    return F.array_distinct(F.filter(found, foreign))


def maybe_continues(kind: Column, text: Column, continues_id: Column) -> Column:
    """A long caption without a link that ends in mid-sentence and not in a signature."""
    flat = flatten(text)
    last = F.element_at(F.split(F.regexp_replace(text, r"(?U)^\s+|\s+\z", ""), r"\r\n|[\n\r]"), -1)
    parts = F.filter(F.split(last, r"(?U)\s+"), lambda w: w != "")
    titled = F.forall(parts, lambda w: w.rlike(r"^[^\p{Lu}\p{Ll}]*\p{Lu}\p{Ll}*([^\p{Lu}\p{Ll}]+\p{Lu}\p{Ll}*)*[^\p{Lu}\p{Ll}]*$"))
    signature = F.size(parts).between(1, 3) & titled
    return (kind == "caption") & continues_id.isNull() & (F.length(flat) >= 60) & ~F.right(flat, F.lit(1)).isin(SENTENCE_ENDS) & ~signature


def natural_key(name: Column) -> Column:
    """A sortable key in which digit runs of any length compare as numbers, case ignored: by their length without leading zeros, then as text."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), 1)

    def key(part: Column) -> Column:
        digits = F.when(part.rlike("^[0-9]"), F.regexp_replace(part, "^0+(?=[0-9])", ""))
        return F.struct(digits.isNull().alias("is_text"), F.length(digits).alias("size"), digits.alias("digits"), part.alias("text"))

    return F.transform(parts, key)
