"""Document fingerprints by winnowing, DataFrame functions only.

Every k-gram of a text's characters (code points) has a hash. Hashes are not rolled one from the one before, but doubled: a gram's hash combines those of
its two halves, and each half serves two grams, down to single characters. Which hash function is taken makes no difference to
winnowing, so the guarantees are those of rolled hashes; a rolled update would be a fold with a state of one interpreted step for each character, where doubling
takes three passes of whole arrays. The minimum of every window of w grams is chosen in the same way, the rightmost
where several are equal, and its position is kept. Any run of w + k - 1 characters that two texts share is found in both
fingerprints, whatever the script.

Windows compare grams by the upper 33 bits of their hashes with the position in the lower 31 bits of the same number, which
hold any position of a Spark string; equal grams have equal hashes, so the guarantee holds. Two grams that agree in these 33 bits
count as a tie, and the right one is taken. The fingerprint then keeps the
whole 64-bit hash of each chosen gram and its position.

Defined results: a text of fewer than k characters is one gram of all of it; null and empty texts have an empty fingerprint,
like any other such text (likeness 1) and unlike all others (0). Documents with equal ids follow each other in the order of
a hash of their text; null ids come first; repeated rows follow each other; an empty table gives no rows. Extra columns are
left out, whatever their names. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets_in_order, let, table

#: Characters in a gram, grams in a window (powers of two).
K, WINDOW = 8, 8
#: Positions lie in the lower bits of what windows compare.
LAST = (1 << 31) - 1
#: Bytes of text in a bucket when documents are put in order, about; there are some buckets for each core in any case.
BUCKET_BYTES, BUCKETS_A_CORE = 64 << 20, 16


def _doubled(values: Column, size: int, combine: Callable[[Column, Column], Column], then: Callable[[Column], Column], step: int = 1) -> Column:
    """``then`` of what ``combine`` makes of every ``size`` neighbours, from what it makes of the halves; the last size - 1 are of no use."""
    if step == size:
        return then(values)
    pairs = F.zip_with(values, F.slice(values, step + 1, F.size(values)), lambda a, b: combine(a, b))
    return let(pairs, lambda p: _doubled(p, size, combine, then, 2 * step))


def winnowed(text: Column, k: int = K, w: int = WINDOW) -> Column:
    """The fingerprint of a text (not null): a struct of the chosen grams' ``hashes`` and ``positions``, in order."""
    if any(n & (n - 1) or n < 2 for n in (k, w)):
        raise ValueError("grams and windows must be powers of two")
    last = F.lit(LAST).cast("long")

    def packed(grams: Column) -> Column:
        places = F.sequence(last, last - F.size(grams) + 1, F.lit(-1).cast("long"))
        return F.zip_with(grams, places, lambda h, p: h.bitwiseAND(F.lit(~LAST)).bitwiseOR(p))

    def chosen(grams: Column, least: Column) -> Column:
        windows = F.greatest(F.size(grams) - (w - 1), F.lit(1))
        places = F.transform(F.array_distinct(F.slice(least, 1, windows)), lambda x: (last - x.bitwiseAND(last)).cast("int"))
        return let(places, lambda at: F.struct(F.transform(at, lambda i: F.get(grams, i)).alias("hashes"), at.alias("positions")))

    def of(hashes: Column) -> Column:
        grams = F.slice(hashes, 1, F.size(hashes) - (k - 1))
        return let(grams, lambda g: let(packed(g), lambda p: _doubled(p, w, F.least, lambda least: chosen(g, least))))

    none = F.struct(F.array().cast("array<long>").alias("hashes"), F.array().cast("array<int>").alias("positions"))
    whole = F.struct(F.array(F.xxhash64(text)).alias("hashes"), F.array(F.lit(0)).alias("positions"))
    long = let(F.split(text, ""), lambda chars: _doubled(chars, k, F.xxhash64, of))
    return F.when(F.length(text) >= k, long).when(F.length(text) > 0, whole).otherwise(none)


def changed_at_end(marks: Column, kept: Column, text: Column, k: int = K, w: int = WINDOW) -> Column:
    """The fingerprint of ``text``, whose first ``kept`` characters are those of a text with fingerprint ``marks``.

    What all windows inside the kept characters decide stays; only the windows behind are made anew. Where kept characters fill
    no window, all is made anew.
    """
    stay = kept - (k + w - 2)  # positions below this lie in windows of kept characters only
    begin = F.when(stay > 0, F.greatest(stay - (w - 1), F.lit(0))).otherwise(0)

    def joined(new: Column, first: Column, begin: Column) -> Column:
        before = F.size(F.filter(marks["positions"], lambda p: p < first))
        behind = F.size(F.filter(new["positions"], lambda p: p + begin < first))
        rest = lambda c: F.slice(new[c], behind + 1, F.greatest(F.size(new[c]) - behind, F.lit(0)))
        places = F.transform(rest("positions"), lambda p: p + begin)
        return F.struct(F.concat(F.slice(marks["hashes"], 1, before), rest("hashes")).alias("hashes"), F.concat(F.slice(marks["positions"], 1, before), places).alias("positions"))

    tail = F.substring(text, begin + 1, F.length(text))
    return let(winnowed(tail, k, w), lambda new: F.when(stay > 0, joined(new, stay, begin)).otherwise(new))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of gram hashes; 1 if both are empty."""
    common = F.size(F.array_intersect(a, b))

    def of(n: Column) -> Column:
        union = F.size(a) + F.size(b) - n
        return F.when(union == 0, F.lit(1.0)).otherwise(n / union)

    return let(common, of)


def digest(marks: Column) -> Column:
    """16 hexadecimal digits of the whole fingerprint, positions included."""
    return F.lower(F.lpad(F.hex(F.xxhash64(marks)), 16, "0"))


def with_next(docs: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """(order, text, marks, hashes, next_text, next_hashes): each document, its fingerprint and distinct hashes, and the text and hashes of the next one.

    The next is that in ascending order; after the last comes the first. Documents are dealt to buckets of neighbouring ids, and
    the first of each bucket also to the bucket before it, where it follows the last; so one shuffle of the texts is enough.
    Fingerprints are made after the texts are sorted, so neither the shuffle nor the sort carries them.
    """
    base = docs.select(F.col(order).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, buckets = buckets_in_order(base.withColumn("tie", F.xxhash64("text")), "id", "tie", "text", BUCKET_BYTES, BUCKETS_A_CORE)
    place = lambda bucket, head: F.struct(bucket.alias("bucket"), F.lit(head).alias("head"))
    own, before = place(F.col("bucket"), False), place(F.pmod(F.col("bucket") - 1, F.lit(buckets)), True)
    rows = rows.select("id", "tie", "text", F.inline(F.when(F.col("first"), F.array(own, before)).otherwise(F.array(own)))).repartitionById(buckets, F.col("bucket"))
    near = Window.partitionBy("bucket").orderBy("head", F.asc_nulls_first("id"), "tie")
    rows = rows.withColumn("next_text", F.lead("text").over(near)).withColumn("marks", winnowed(F.col("text")))
    rows = rows.withColumn("hashes", F.array_distinct("marks.hashes")).withColumn("next_hashes", F.lead("hashes").over(near))
    return rows.where(~F.col("head")).select(F.col("id").alias(order), "text", "marks", "hashes", "next_text", "next_hashes")


def op10_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    docs = docs.withColumn("stays", F.col("n_chars").cast("int") - cut)
    edited = F.concat(F.substring("text", F.lit(1), F.col("stays")), F.substring("next_text", F.lit(1), cut))
    docs = docs.withColumn("edited", edited).drop("text", "next_text")
    docs = docs.withColumns({"edited_marks": changed_at_end(F.col("marks"), F.col("stays"), F.col("edited")), "edited_sha256": F.sha2("edited", 256)})
    near = lambda other: let(other, lambda b: likeness(F.col("hashes"), b))
    return docs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        digest(F.col("marks")).alias("fingerprint"),
        digest(F.col("edited_marks")).alias("edited_fingerprint"),
        near(F.array_distinct("edited_marks.hashes")).alias("near_edited"),
        near(F.col("next_hashes")).alias("near_next"),
    )
