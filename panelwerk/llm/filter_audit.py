"""Filter interaction audit: what every order of a set of filters removes, by min-plus removal ranks.

A text's failures are a mask of one bit for each filter, and all that is counted depends on the mask alone. So documents are
counted by (part, mask) first, with the weights asked for (documents, good ones, toxic ones), and the orders are applied to
masks, of which there are at most 2**filters. With P the position of each filter in each order (the inverse permutation), and M a
matrix that is 0 where a mask fails a filter and infinite elsewhere, the min-plus product of M and P is the step at which
each order removes each mask: the least position of a failed filter. Scattering the weights of the masks by that step gives what is
removed, what is left, and what a filter would have removed had an earlier one not done so.

Copies are told by a SHA-256 digest of the text. Rows move as (doc_id, digest, mask, part), never as texts, and are combined
before each shuffle, so a text or a part that holds a third of all rows is one row for each task. A digest's rows after that are
as many as its parts and labels.

Defined results: a null text is empty; a null lang is the part ''; rows with a null doc_id have no smaller or larger ids and no labels, so they
never count as later copies; rows that repeat an id and text are no copies of each other; several labels for an id count as the
greatest; an empty table has no parts and gives no rows; extra columns are left out. Texts are never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import python_workers
from .common import table

#: Filters that look at the text alone, in the order of their bits; the copy filter has the next bit.
TEXT_FILTERS, COPIES = "ABCD", "E"
FEW_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
CAPITALS, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
WEIGHTS = ("n", "good", "toxic")


def text_mask(text: str, data: bytes) -> int:
    """The text filters that a text fails, as bits."""
    words = data.split()  # bytes: ASCII white space only
    few = len(words) < FEW_WORDS
    repeated = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    loud = 100 * (len(data) - len(data.translate(None, CAPITALS))) > MOST_CAPITALS * len(text)
    marked = len(data.translate(None, SYMBOLS)) < len(data)
    return few | repeated << 1 | loud << 2 | marked << 3


def masked_texts(docs: DataFrame, part: str = "lang", text: str = "text") -> DataFrame:
    """(doc_id, part, mask, digest) of every row."""

    @F.pandas_udf("mask int, digest binary")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(text_mask(t, d), hashlib.sha256(d).digest()) for t in batch for d in [t.encode()]]
            yield pd.DataFrame(found, columns=["mask", "digest"])

    python_workers(docs.sparkSession)
    made = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), read(F.coalesce(F.col(text), F.lit(""))).alias("_r"))
    return made.select("doc_id", "part", "_r.mask", "_r.digest")


def labelled(rows: DataFrame, labels: DataFrame, *names: str) -> DataFrame:
    """Rows of equal (doc_id, part, mask, digest) as one with their count ``n``, and 1 or 0 for each label in ``names``.

    Null ids are spread over the join's partitions by their digest; they match nothing.
    """
    counted = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    counted = counted.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)))
    given = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in names]).withColumn("spread", F.lit(0).cast("long"))
    return counted.join(given, ["doc_id", "spread"], "left").drop("spread").withColumns({c: F.coalesce((F.col(c) > 0).cast("int"), F.lit(0)) for c in names})


def counted_masks(rows: DataFrame, bit: int) -> DataFrame:
    """(part, mask, n, good, toxic) with the copy filter's ``bit`` set in the masks of rows whose text a smaller doc_id has.

    ``rows``: (doc_id, part, mask, digest, n, quality, toxic).
    """
    groups = rows.groupBy("digest", "part", "mask", "quality", "toxic").agg(
        F.min("doc_id").alias("least"),
        F.min_by("n", "doc_id").alias("at_least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without_id"),
        F.sum("n").alias("rows"),
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    groups = groups.withColumn("passing", F.col("without_id") + F.when(first, F.col("at_least")).otherwise(0))
    either = F.array(F.struct("mask", F.col("passing").alias("n")), F.struct((F.col("mask") + F.lit(1 << bit)).alias("mask"), (F.col("rows") - F.col("passing")).alias("n")))
    single = groups.select("part", "quality", "toxic", F.explode(either).alias("e")).select("part", "quality", "toxic", "e.mask", "e.n")
    return single.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def removal_ranks(masks: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Min-plus product: the step (from 1) at which each order removes each mask, one more than the filters where none does.

    ``masks``: (masks, filters), true where failed; ``positions``: (orders, filters), the step of each filter.
    """
    never = positions.shape[1] + 1
    ranks = np.full((len(masks), len(positions)), never, np.int64)
    for f in range(positions.shape[1]):
        np.minimum(ranks, np.where(masks[:, f], 0, never)[:, None] + positions[None, :, f], out=ranks)
    return ranks


def audit_of(masks: np.ndarray, weights: np.ndarray, names: str) -> pd.DataFrame:
    """The audit of one part. ``masks``: bits; ``weights``: (masks, WEIGHTS), in whole numbers."""
    size, orders = len(names), np.array(list(permutations(range(len(names)))))
    failed = masks[:, None] >> np.arange(size) & 1 == 1
    positions = np.argsort(orders, axis=1) + 1
    ranks = removal_ranks(failed, positions)
    removed = np.zeros((len(WEIGHTS), len(orders), size + 2), np.int64)
    for w in range(len(WEIGHTS)):
        np.add.at(removed[w], (np.arange(len(orders))[None, :], ranks), weights[:, w, None])
    left = weights[:, 0].sum() - removed[0].cumsum(axis=1)
    n, alone = weights[:, 0], failed.sum(axis=1) == 1
    fails, only = n @ failed, n @ (failed & alone[:, None])
    step = np.broadcast_to(np.arange(1, size + 1), orders.shape)
    row = np.broadcast_to(np.arange(len(orders))[:, None], orders.shape)
    gone = np.zeros(orders.shape, np.int64)  # failing a step's filter, removed before it
    for f in range(size):
        at = positions[:, f]
        gone[np.arange(len(orders)), at - 1] = ((ranks < at[None, :]) * (n * failed[:, f])[:, None]).sum(axis=0)
    credit = fails * len(orders) - np.bincount(orders.ravel(), gone.ravel(), size).astype(np.int64)
    return pd.DataFrame(
        {
            "filter_order": np.repeat(["".join(names[f] for f in o) for o in orders], size),
            "step": step.ravel().astype(np.int32),
            "kept": left[row, step].ravel(),
            "removed": removed[0][row, step].ravel(),
            "redundant": gone.ravel(),
            "unique_fails": only[orders].ravel(),
            "good_lost": removed[1][row, step].ravel(),
            "toxic_lost": removed[2][row, step].ravel(),
            "shapley": credit[orders].ravel(),
        }
    )


def audit(counts: DataFrame, names: str) -> DataFrame:
    """The audit of every part from its masks' counts (part, mask, n, good, toxic): a row for each order of ``names`` and step."""
    masks = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *[F.col(w).cast("long").alias(w) for w in WEIGHTS])).alias("masks"))  # 2**filters at most

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, found in zip(batch.part, batch.masks, strict=True):
                made = audit_of(np.array([m["mask"] for m in found]), np.array([[m[w] for w in WEIGHTS] for m in found], np.int64), names)
                made.insert(0, "part", part)
                yield made

    kept = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return masks.mapInPandas(of, f"part string, filter_order string, step int, {kept}")


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of the five filters over ``docs``, by ``part``."""
    rows = labelled(masked_texts(docs, part), labels, "quality", "toxic")
    return audit(counted_masks(rows, len(TEXT_FILTERS)), TEXT_FILTERS + COPIES)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))


_FAILS = "(CASE letter WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END)"

ORACLE_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM texts),
tagged AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(quality, 0) > 0 AS good, coalesce(g.toxic, 0) > 0 AS bad,
    len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS e
  FROM worded w LEFT JOIN tagged g ON w.doc_id = g.doc_id),
cells AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE bad) AS n_bad FROM failing GROUP BY ALL),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM letters p, letters q, letters r, letters s, letters u
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
ranked AS (
  SELECT cells.*, filter_order, least(
    CASE WHEN a THEN strpos(filter_order, 'A') ELSE 6 END, CASE WHEN b THEN strpos(filter_order, 'B') ELSE 6 END,
    CASE WHEN c THEN strpos(filter_order, 'C') ELSE 6 END, CASE WHEN d THEN strpos(filter_order, 'D') ELSE 6 END,
    CASE WHEN e THEN strpos(filter_order, 'E') ELSE 6 END) AS gone FROM cells, orders),
stepped AS (SELECT *, substr(filter_order, step::INT, 1) AS letter FROM ranked, (SELECT unnest(range(1, 6)) AS step)),
told AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone < step AND {_FAILS} THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN {_FAILS} AND a::INT + b::INT + c::INT + d::INT + e::INT = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN gone = step THEN n_good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN n_bad ELSE 0 END) AS toxic_lost
  FROM stepped GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM told
"""
