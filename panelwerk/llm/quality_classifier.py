"""Quality classifier: hashed word n-grams, logistic regression trained with follow-the-regularised-leader updates.

A text is read as tokens (runs of word characters, and single other characters). Its features are hashed single tokens,
token pairs, and triples of token shapes (case, digits, the character itself for marks, and a sign for a token equal to the
one before). A feature's value is its share of all features, so a score is a sparse dot product: the mean weight of a text's
features, scaled, plus a bias. Only the text is read.

Training takes a bounded sample (TRAIN_ROWS and TRAIN_BYTES, chosen by a hash of doc_id) of the labelled rows outside the held-out fold:
features are made where the rows lie, and one task makes the updates, in an order given by that hash. The weights are one
array of 2**BITS numbers, whatever the input. Scoring is one scan without a shuffle.

Defined results: null, empty and blank texts have no features and score by the bias; rows with a null doc_id are in fold 0 of a
null id's hash (held out) and never train; several labels for an id count as the greatest; null labels are ignored; with no
labels every score is 0.5; an empty table gives no rows; extra columns are kept by ``score_texts``, one named like the
score under another name; repeated rows are scored one by one. Texts are never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import python_workers
from .common import set_aside, table

BITS = 18
#: Expected number of labelled rows that are trained on, at most, and of bytes of their texts.
TRAIN_ROWS, TRAIN_BYTES = 6000, 256 << 20
FOLDS, THRESHOLD = 5, 0.3
#: Follow-the-regularised-leader: rate, offset, L1, L2, passes over the sample, scale of the mean weight.
ALPHA, BETA, L1, L2, PASSES, SCALE = 0.5, 1.0, 0.002, 0.1, 3, 30.0
KEPT_TOKENS = 300_000

_TOKENS = re.compile(r"\w+|[^\w\s]").findall
_MASK = np.uint64((1 << BITS) - 1)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


class _Codes(dict):
    """Token to (hash of the token, hash of its shape), packed in one number; forgets all when full."""

    def __missing__(self, token: str) -> int:
        shape = "A" if token.isupper() and len(token) > 1 else "T" if token[0].isupper() else "0" if token[0].isdigit() else "a" if token[0].isalpha() else token
        code = crc32(token.lower().encode()) << 32 | crc32(b"shape" + shape.encode())
        if len(self) >= KEPT_TOKENS:
            self.clear()
        if len(token) <= 64:
            self[token] = code
        return code


def features(text: str | None, codes: dict) -> np.ndarray:
    """The hashed features of a text, repeats included."""
    tokens = _TOKENS(text or "")
    if not tokens:
        return np.zeros(0, np.int64)
    packed = np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))
    word, shape = packed >> np.uint64(32), packed & np.uint64(0xFFFFFFFF)
    same = np.concatenate([[False], word[1:] == word[:-1]])
    shape = np.where(same, np.uint64(0xABCDEF), shape)
    single = word * _MIX[0]
    pair = (word[:-1] * _MIX[1] ^ word[1:]) * _MIX[0]
    triple = ((shape[:-2] * _MIX[2] ^ shape[1:-1]) * _MIX[1] ^ shape[2:]) * _MIX[0]
    mixed = np.concatenate([single, pair, triple])
    return (mixed >> np.uint64(40) & _MASK).astype(np.int64)


def train_ftrl(samples: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Weights of all features and, last, the bias. ``samples``: (features, label) in training order."""
    n = (1 << BITS) + 1
    z, g2 = np.zeros(n), np.zeros(n)
    rows = []
    for found, label in samples:
        at, count = np.unique(found, return_counts=True)
        rows.append((np.append(at, n - 1), np.append(SCALE * count / max(1, len(found)), 1.0), label))
    at_all = lambda at: np.where(np.abs(z[at]) <= L1, 0.0, (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(g2[at])) / ALPHA + L2))
    for _ in range(PASSES):
        for at, x, label in rows:
            w = at_all(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / ALPHA
            z[at] += g - sigma * w
            g2[at] += g * g
    return at_all(np.arange(n))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from the labelled rows of ``docs`` outside the held-out fold, about ``rows`` of them at most."""
    given = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    given = given.where(~held_out(F.col("doc_id")))
    length = docs.agg(F.avg(F.octet_length("text"))).first()[0] or 1.0
    share = min(1.0, min(rows, TRAIN_BYTES / max(1.0, length)) / max(1, given.count()))
    order = F.xxhash64(F.lit("training order"), "doc_id")
    given = given.withColumn("turn", F.shiftrightunsigned(order, 33)).where(F.col("turn") < F.lit(int(share * (1 << 31))))
    sample = docs.select("doc_id", "text").join(given, "doc_id").select("turn", "doc_id", "quality", "text")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = _Codes()
        for b in batches:
            found = [features(t, codes).astype("<i4").tobytes() for t in b.text]
            yield pd.DataFrame({"turn": b.turn, "doc_id": b.doc_id, "label": (b.quality > 0).astype("int32"), "found": found})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        group = pd.concat(parts).sort_values(["turn", "doc_id", "found"])
        rows = [(np.frombuffer(f, "<i4").astype(np.int64), y) for f, y in zip(group.found, group.label, strict=True)]
        yield pd.DataFrame({"weights": [train_ftrl(rows).astype("<f4").tobytes()]})

    python_workers(docs.sparkSession)
    made = sample.mapInPandas(make, "turn long, doc_id long, label int, found binary")
    got = made.repartition(1).mapInPandas(learn, "weights binary").collect()  # one row of a fixed size
    return np.frombuffer(got[0].weights, "<f4") if got else np.zeros((1 << BITS) + 1, np.float32)


def score(text: str | None, weights: np.ndarray, codes: dict) -> float:
    found = features(text, codes)
    mean = float(weights[found].mean()) if len(found) else 0.0
    return 1 / (1 + float(np.exp(-np.clip(SCALE * mean + float(weights[-1]), -35, 35))))


def score_texts(docs: DataFrame, weights: np.ndarray, text: str = "text", column: str = "score") -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS + 1 numbers

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = partial(score, weights=sent.value, codes=_Codes())
        for batch in texts:
            yield pd.Series([one(t) for t in batch], dtype="float64")

    python_workers(docs.sparkSession)
    return set_aside(docs, column).withColumn(column, of(F.coalesce(F.col(text), F.lit(""))))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
