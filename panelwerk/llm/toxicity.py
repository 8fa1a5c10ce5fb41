"""Toxicity: a hashed n-gram classifier regularised by counterfactuals.

A text's features are its distinct words, their beginnings (PREFIXES letters) and pairs of neighbours, hashed into 2**BITS; a
score is a sparse dot product and a bias, through the logistic function. A labelled text also gives counterfactuals: its mentions of groups are swapped
for others of the same language, or, in a text without any, one is put beside a word of a sentence and then swapped. Training
adds to the logistic loss the square of what each counterfactual changes, so terms of groups, and what stands beside them, get no
weight of their own however often they occur in toxic texts, and a neutral mention scores like the sentence without it.
Updates follow the regularised leader, so that features seen by chance stay at zero.

Training takes a bounded sample (TRAIN_ROWS of each class and TRAIN_BYTES, chosen by a hash of doc_id) of the labelled rows outside the held-out fold;
features are made where the rows lie, and one task makes the updates in an order given by that hash. Scoring is one scan without a
shuffle.

Defined results: null, empty and blank texts have no features and score by the bias; rows with a null doc_id are held out and never
train; several labels for an id count as the greatest; null labels are ignored; without labels every score is 0.5; an empty table gives
no rows; extra columns are kept by ``score_texts``, one named like the score under another name; repeated rows are scored one by one.
Texts are never cut.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import python_workers
from .common import set_aside, table

BITS = 20
#: Expected number of labelled rows of each class that are trained on, at most, and of bytes of their texts.
TRAIN_ROWS, TRAIN_BYTES = {1: 3000, 0: 6000}, 96 << 20
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
#: Follow-the-regularised-leader: rate, offset, L1, L2, passes over the sample; weight of a counterfactual's squared change.
ALPHA, BETA, L1, L2, PASSES, COUNTERFACTUAL = 1.0, 1.0, 4.0, 0.5, 8, 1.0
#: Features of fewer texts of the sample are left out.
LEAST_TEXTS = 5
#: Bytes of a word's beginnings; bytes of a text that are hashed at once, about.
PREFIXES, SLICE = (4, 5, 6, 7), 1 << 20

#: Words for groups of people, by language; each may stand for another of its line (fixed values).
GROUPS = [
    "women men girls boys gays lesbians muslims christians jews hindus buddhists atheists immigrants refugees foreigners blacks whites asians arabs africans latinos".split(),
    "gay straight lesbian bisexual transgender muslim christian jewish hindu buddhist black white asian arab african latino disabled deaf blind old young".split(),
    "femmes hommes filles garçons gays lesbiennes musulmans chrétiens juifs hindous bouddhistes athées immigrés réfugiés étrangers noirs blancs asiatiques arabes africains".split(),
    "frauen männer mädchen jungen schwule lesben muslime christen juden hindus buddhisten atheisten einwanderer flüchtlinge ausländer schwarze weiße asiaten araber afrikaner".split(),
    "mujeres hombres chicas chicos gays lesbianas musulmanes cristianos judíos hindúes budistas ateos inmigrantes refugiados extranjeros negros blancos asiáticos árabes africanos".split(),
]
OTHERS = {w: [v for line in GROUPS if w in line for v in line if v != w] for line in GROUPS for w in line}

_GAP = re.compile(rb"[\x00-/:-@\[-^`{-\x7f]")
_INSIDE = np.array([bytes([c]).isalnum() or c == 95 or c > 127 for c in range(256)])
BASE, _BEGUN = 0x5851F42D4C957F2D, np.uint64(0xD1B54A32D192ED03)
_known: tuple = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
_PAIR, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, n of each at least."""
    global _known
    if len(_known[0]) < n:
        size = 1 << n.bit_length()
        made = [np.full(size, p, np.uint64) for p in (BASE, pow(BASE, -1, 1 << 64))]
        for m in made:
            m[0] = 1
        _known = tuple(np.cumprod(m, dtype=np.uint64) for m in made)
    return _known


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of UTF-8 text in turn, and of their beginnings (a row for each word).

    A word is a run of letters, digits and underscores; beyond ASCII all counts but general punctuation. The hash of a span is the
    difference of two running sums, so all are made at once.
    """
    b = np.frombuffer(data, np.uint8)
    inside = _INSIDE[b]
    for at, length in ((np.flatnonzero((b[:-1] == 0xC2) & (b[1:] < 0xC0)), 2), (np.flatnonzero((b[:-1] == 0xE2) & (b[1:] < 0x82)), 3), (np.flatnonzero((b[:-1] == 0xE3) & (b[1:] == 0x80)), 3)):
        for k in range(length if len(at) else 0):
            inside[np.minimum(at + k, len(b) - 1)] = False
    edge = np.diff(np.concatenate([[False], inside, [False]]).view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(b) + 1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], dtype=np.uint64)])
    span = lambda to: (run[to] - run[start]) * inverse[start]
    begun = [span(np.minimum(start + k, end)) for k in PREFIXES]
    return span(end), np.column_stack(begun) if len(start) else np.zeros((0, len(PREFIXES)), np.uint64)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _folded(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _SPREAD
    return (x ^ (x >> np.uint64(29))) * _PAIR >> np.uint64(64 - BITS)


def features(text: str) -> np.ndarray:
    """The distinct hashed features of a text, in order."""
    data, at, last, found = text.lower().encode(), 0, None, []
    while at < len(data):
        end = at + SLICE
        if end < len(data):  # up to an ASCII character outside words
            gap = _GAP.search(data, end)
            end = gap.start() if gap else len(data)
        word, begun = hashed_words(data[at:end])
        at = end
        if not len(word):
            continue
        row = word if last is None else np.concatenate([[last], word])
        last = word[-1]
        longer = begun[begun != word[:, None]]  # a short word is its own beginning
        found.append(_distinct(np.concatenate([_folded(word), _folded(longer ^ _BEGUN), _folded(row[:-1] * _PAIR + row[1:])])))
    return (found[0] if len(found) == 1 else _distinct(np.concatenate(found or [np.zeros(0, np.uint64)]))).astype(np.int64)


def counterfactuals(text: str, rng: random.Random) -> list[tuple[str, str]]:
    """Pairs of texts that should score alike: mentions of groups swapped, or one put in and swapped."""

    places = list(re.finditer(r"\w+", text))
    if not places:
        return []
    if any(m[0].lower() in OTHERS for m in places):
        parts, at = [], 0
        for m in places:
            if m[0].lower() in OTHERS:
                other = rng.choice(OTHERS[m[0].lower()])
                parts += [text[at : m.start()], other.capitalize() if m[0][0].isupper() else other]
                at = m.end()
        return [(text, "".join([*parts, text[at:]]))]
    at, word = rng.choice(places).end(), rng.choice(rng.choice(GROUPS))
    named, other = (f"{text[:at]} {w}{text[at:]}" for w in (word, rng.choice(OTHERS[word])))
    return [(text, named), (named, other)]


def changes(text: str, rng: random.Random) -> list[np.ndarray]:
    """For each counterfactual pair the features that one side alone has, those of the second as they are, those of the first as -1 - feature."""
    found = []
    for a, b in counterfactuals(text, rng):
        x, y = features(a), features(b)
        found.append(np.concatenate([np.setdiff1d(y, x, assume_unique=True), -1 - np.setdiff1d(x, y, assume_unique=True)]))
    return found


def learn(samples: list[tuple[np.ndarray, int, list[np.ndarray]]], weight: float = COUNTERFACTUAL) -> np.ndarray:
    """Weights of all features and, last, the bias. ``samples``: (features, label, changes) in training order."""
    n = (1 << BITS) + 1
    known = np.append(np.bincount(np.concatenate([f for f, _, _ in samples]), minlength=n - 1) >= LEAST_TEXTS, True)
    z, g2 = np.zeros(n), np.zeros(n)

    def at_all(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(g2[at])) / ALPHA + L2))

    def step(at: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        new = g2[at] + g * g
        z[at] += g - (np.sqrt(new) - np.sqrt(g2[at])) / ALPHA * w
        g2[at] = new

    for _ in range(PASSES):
        for found, label, pairs in samples:
            at = np.append(found[known[found]], n - 1)
            w = at_all(at)
            step(at, w, np.full(len(at), 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label))
            for change in pairs if weight else ():
                at, sign = np.where(change < 0, -1 - change, change), np.where(change < 0, -1.0, 1.0)
                at, sign = at[known[at]], sign[known[at]]
                w = at_all(at)
                step(at, w, 2 * weight * float(w @ sign) * sign)
    return at_all(np.arange(n))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: dict[int, int] = TRAIN_ROWS, weight: float = COUNTERFACTUAL) -> np.ndarray:
    """Weights from the labelled rows of ``docs`` outside the held-out fold, about ``rows`` of each class at most."""
    given = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    given = given.where(~held_out(F.col("doc_id")))
    many = {r.toxic: r["count"] for r in given.groupBy("toxic").count().collect()}
    length = docs.where(F.rand(5) < 0.05).agg(F.avg(F.octet_length("text"))).first()[0] or docs.agg(F.avg(F.octet_length("text"))).first()[0] or 1.0
    fits = min(1.0, TRAIN_BYTES / max(1.0, length) / sum(rows.values()))
    share = {c: min(1.0, fits * rows[c] / max(1, many.get(c, 0))) for c in (0, 1)}
    turn = F.shiftrightunsigned(F.xxhash64(F.lit("training order"), "doc_id"), 33)
    bound = F.when(F.col("toxic") == 1, int(share[1] * (1 << 31))).otherwise(int(share[0] * (1 << 31)))
    given = given.withColumn("turn", turn).where(F.col("turn") < bound)
    # the sample's ids are of a fixed number, so that no text but theirs moves
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(given), "doc_id").select("turn", "doc_id", "toxic", "text")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, changed = [], []
            for text, turn in zip(b.text, b.turn, strict=True):
                found.append(features(text).astype("<i4").tobytes())
                changed.append([c.astype("<i4").tobytes() for c in changes(text, random.Random(int(turn)))])
            yield pd.DataFrame({"turn": b.turn, "doc_id": b.doc_id, "label": b.toxic, "found": found, "changed": changed})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        group = pd.concat(parts).sort_values(["turn", "doc_id", "found"])
        whole = lambda data: np.frombuffer(data, "<i4").astype(np.int64)
        samples = [(whole(f), y, [whole(c) for c in cs]) for f, y, cs in zip(group.found, group.label, group.changed, strict=True)]
        yield pd.DataFrame({"weights": [learn(samples, weight).astype("<f4").tobytes()]})

    python_workers(docs.sparkSession)
    made = sample.mapInPandas(make, "turn long, doc_id long, label int, found binary, changed array<binary>")
    got = made.repartition(1).mapInPandas(fit, "weights binary").collect()  # one row of a fixed size
    return np.frombuffer(got[0].weights, "<f4") if got else np.zeros((1 << BITS) + 1, np.float32)


def score(text: str, weights: np.ndarray) -> float:
    return 1 / (1 + float(np.exp(-np.clip(float(weights[features(text)].sum()) + float(weights[-1]), -35, 35))))


def score_texts(docs: DataFrame, weights: np.ndarray, text: str = "text", column: str = "score") -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS + 1 numbers

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([score(t, sent.value) for t in batch], dtype="float64")

    python_workers(docs.sparkSession)
    return set_aside(docs, column).withColumn(column, of(F.coalesce(F.col(text), F.lit(""))))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
