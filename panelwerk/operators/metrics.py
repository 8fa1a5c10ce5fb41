"""Evaluation metrics over tables of texts and matched boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Letters of both sides of the pairs whose grams a task counts at once, about; a letter has six grams.
PAIR_LETTERS = 1 << 20


def cer(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the edit distance of all (hypothesis, reference) pairs, the references' length and their quotient."""
    rows = pairs.select(*keys, T.normalize_text(F.col("hypothesis")).alias("h"), T.normalize_text(F.col("reference")).alias("r"))
    sums = rows.groupBy(*keys).agg(F.sum(F.levenshtein("h", "r")).alias("errors"), F.sum(F.length("r")).alias("length"))
    return sums.withColumn("cer", F.when(F.col("length") > 0, F.col("errors") / F.col("length")))


def chrf(pairs: DataFrame, keys: list[str], order: int = 6, beta: float = 2.0, ids: tuple[str, ...] = ("id",)) -> DataFrame:
    """Per group the corpus chrF of (ids, hypothesis, reference): character n-grams without spaces, clipped by pair.

    Grams are hashed inside a text, each from the one shorter by a character. Both sides are counted by one aggregate whose key
    begins with the pair; pairs are dealt to tasks by PAIR_LETTERS of text, as a task holds all grams of its pairs.
    """

    def grams(side: str) -> Column:
        chars = F.split(F.replace(F.coalesce(side, F.lit("")), F.lit(" "), F.lit("")), "")
        none = F.array().cast("array<struct<_n: int, _g: bigint>>")

        def longer(c: Column, shorter: Column, n: int) -> Column:
            hashed = F.transform(F.slice(shorter, 1, F.greatest(F.size(c) - (n - 1), F.lit(0))), lambda h, i: F.xxhash64(h, F.get(c, i + (n - 1))))
            named = lambda a: F.transform(a, lambda h: F.struct(F.lit(n).alias("_n"), h.alias("_g")))
            more = lambda a: F.concat(named(a), longer(c, a, n + 1) if n < order else none)
            return F.element_at(F.transform(F.array(hashed), more), 1)

        return F.element_at(F.transform(F.array(F.filter(chars, lambda x: x != "")), lambda c: longer(c, F.transform(c, lambda _: F.lit(0).cast("long")), 1)), 1)

    own = [*ids, *keys]
    pairs = pairs.select(*own, "hypothesis", "reference")
    size = pairs.agg(F.sum(sum(F.coalesce(F.length(s), F.lit(0)) for s in ("hypothesis", "reference")))).first()[0] or 0
    pairs = pairs.repartition(-(-size // PAIR_LETTERS) or 1, *ids)
    sides = pairs.select(*own, F.explode(F.array(*(F.struct(grams(s).alias("grams"), F.lit(s == "hypothesis").alias("own")) for s in ("hypothesis", "reference")))).alias("_s"))
    rows = sides.select(*own, F.col("_s.own").alias("_own"), F.inline("_s.grams"))
    both = rows.groupBy(*own, "_n", "_g").agg(F.count_if("_own").alias("_hypothesis"), F.count_if(~F.col("_own")).alias("_reference"))
    found = F.sum(F.least("_hypothesis", "_reference")).alias("_m")
    per_order = both.groupBy(*keys, "_n").agg(found, F.sum("_hypothesis").alias("_h"), F.sum("_reference").alias("_r"))
    mean = lambda side: F.coalesce(F.avg(F.when(F.col(side) > 0, F.col("_m") / F.col(side))), F.lit(0.0))
    means = per_order.groupBy(*keys).agg(mean("_h").alias("_p"), mean("_r").alias("_q"))
    p, q, b = F.col("_p"), F.col("_q"), beta**2
    return means.select(*keys, F.when(p + q > 0, 100 * (1 + b) * p * q / F.nullif(b * p + q, F.lit(0.0))).otherwise(0.0).alias("chrf"))


def order_correct(matches: DataFrame, key: str) -> DataFrame:
    """Per page whether the matched gold positions rise in the order of prediction. ``matches``: (key, predicted, gold)."""
    turn = Window.partitionBy(key).orderBy("predicted")
    rising = matches.withColumn("rising", F.col("gold") >= F.coalesce(F.lag("gold").over(turn), F.col("gold")))
    return rising.groupBy(key).agg(F.bool_and("rising").alias("correct"))


def detection_quality(predicted: DataFrame, gold: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Per page and group of gold kinds (``main``, ``sfx``, ``other``): gold boxes, matched ones and recall; and, in the row ``all``, all boxes and the predictions without a match.

    ``gold``: keys, j, kind; ``matches``: keys, i, j.
    """
    group = F.when(F.col("kind") == "sfx", "sfx").when(F.col("kind").isin("other", "title"), "other").otherwise("main")
    hits = gold.select(*keys, "j", group.alias("group")).join(matches.select(*keys, "j", F.lit(1).alias("_hit")), [*keys, "j"], "left")
    per_group = hits.groupBy(*keys, "group").agg(F.count("*").alias("gold"), F.count("_hit").alias("matched"))
    total = per_group.groupBy(*keys).agg(F.sum("gold").alias("gold"), F.sum("matched").alias("matched"))
    total = total.join(predicted.groupBy(*keys).agg(F.count("*").alias("predicted")), keys, "full").na.fill(0)
    total = total.select(*keys, F.lit("all").alias("group"), "gold", "matched", (F.col("predicted") - F.col("matched")).alias("unmatched"))
    rows = per_group.withColumn("unmatched", F.lit(None).cast("long")).unionByName(total)
    return rows.withColumn("recall", F.when(F.col("gold") > 0, F.col("matched") / F.col("gold")))
