"""Phrase collocations by weighted acyclic automata.

A shard of texts becomes a count transducer: a state for each distinct run of up to LONGEST words within a piece (below a root arc
for the language), an arc for the word that leads to it, and the number of positions that pass as its weight. It is built level by level
from the sorted pairs (state, word) of all positions, so that states are in the order of their paths.

Shards are cut into prefix ranges by the hash of a path's shortest prefix that is not crowded. Crowded prefixes are those that hold
more than one in HOT of a sample's positions (so HOT for each length at most); their continuations are spread by one word more,
again and again, so no range holds a hot word or pair. Each state's weight lies in one range; ranges below a crowded prefix
repeat its states without weight. A range's task unites the shards' automata level by level, adds their weights and drops states
below the least count, with all that continues them.

The parts of a phrase are looked up by composing paths with the united automaton: its states in sorted order, walked with a stack
that holds the weights along the path, give the weights of all first parts; the same walk over reversed phrases gives those of all last
parts. Crowded prefixes of that walk are few and come by a bounded broadcast. Products are whole Python numbers.

Defined results: a null text is empty; a null lang is ``und``; repeated rows count each; rows with null ids count too; equal
phrases cannot occur, so ranks have no ties; an empty table gives no rows; extra columns are left out. Texts are never cut: long ones
are cut into shards between any two words, each shard reading the words that its last positions need.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import python_workers
from .common import checkpointed, table

LONGEST, LEAST, TOP = 5, 100, 2000
#: Positions of a shard; bytes of text for each prefix range, and fewest ranges; bytes of a sample.
SHARD, RANGE_BYTES, LEAST_RANGES, SAMPLE_BYTES = 250_000, 4 << 20, 24, 24 << 20
#: A prefix is crowded if more than one position in so many passes it.
HOT = 1000
#: Frequent phrases of a range in the look-up of parts.
LOOKED_UP = 200_000
#: Bytes of a text that are split at once, and words whose codes a task keeps.
SLICE, KEPT_WORDS = 1 << 20, 150_000
_BREAKS = bytes.maketrans(b"\t.,;:!?\n\x0b\x0c\r", b" " + b"\n" * 10)
_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


class _Codes(dict):
    """Words to numbers; a piece's end is -1, an empty string -2."""

    def __init__(self):
        super().__init__({b"\n": -1, b"": -2})
        self.words: list[bytes] = []
        self.hashes = array("Q")

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return code


def coded(text: bytes, codes: _Codes) -> Iterator[np.ndarray]:
    """The codes of a text's words in turn, pieces apart."""
    data = text.lower().translate(_BREAKS)  # bytes: A-Z only
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= SLICE else max(data.rfind(b" ", at, at + SLICE), data.rfind(b"\n", at, at + SLICE)) + 1
        if end <= at:  # one word beyond a slice
            ends = [x for x in (data.find(b" ", at), data.find(b"\n", at)) if x >= 0]
            end = min(ends) + 1 if ends else len(data)
        tokens = data[at:end].replace(b"\n", b" \n ").split(b" ")
        found = np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))
        yield found[found > -2]
        at = end
    yield np.array([-1])


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _rows(there: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The place of each of ``place`` (in order, each in ``there``) in ``there``."""
    head = np.flatnonzero(np.diff(place, prepend=-1) != 0)
    return np.repeat(np.searchsorted(there, place[head]), np.diff(np.append(head, len(place))))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _MIX) ^ b
    return (x ^ (x >> _TURN)) * _MIX


class Automaton:
    """States by level in the order of their paths: parent (a state of the level above), arc label (a word's number), weight.

    A shard has less than 2^31 of each, so they are kept in four bytes.
    """

    def __init__(self, parent: list[np.ndarray], label: list[np.ndarray], weight: list[np.ndarray]):
        self.parent, self.label, self.weight = parent, label, weight

    @classmethod
    def of_positions(cls, lang: np.ndarray, codes: np.ndarray, starts: int) -> Automaton:
        """Counts of the paths that begin at the first ``starts`` positions; ``lang`` gives each position's root arc."""
        at = np.flatnonzero(codes[:starts] >= 0)
        label, state, weight = np.unique(lang[at], return_inverse=True, return_counts=True)
        made = cls([np.zeros(len(label), np.int32)], [label.astype(np.int32)], [weight.astype(np.int32)])
        many = np.int64(max(codes.max(initial=0), 0) + 1)
        for _ in range(LONGEST):
            going = np.flatnonzero(codes[np.minimum(at, len(codes) - 1)] >= 0) if made.label[1:] else np.arange(len(at))
            going = going[at[going] < len(codes)]
            at, state = at[going], state[going]
            pair, state, weight = np.unique(state * many + codes[at], return_inverse=True, return_counts=True)
            made.parent.append((pair // many).astype(np.int32)), made.label.append((pair % many).astype(np.int32)), made.weight.append(weight.astype(np.int32))
            at = at + 1
        return made

    def hashes(self, of_word: np.ndarray) -> list[np.ndarray]:
        """A hash of each state's path."""
        found = [_mixed(np.zeros(1, np.uint64), of_word[self.label[0]])]
        for p, w in zip(self.parent[1:], self.label[1:], strict=True):
            found.append(_mixed(found[-1][p], of_word[w]))
        return found

    def ranges(self, hashes: list[np.ndarray], hot: np.ndarray, many: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level (range, state) in order: each state in the range of its shortest prefix that is not crowded, and the states
        above it."""
        place = lambda h: ((h >> np.uint64(1)).astype(np.int64) % many).astype(np.int32)
        own, crowded = [place(hashes[0])], [np.ones(len(hashes[0]), bool)]  # a language is never a range of its own
        for p, h in zip(self.parent[1:], hashes[1:], strict=True):
            above = crowded[-1][p]
            own.append(np.where(above, place(h), own[-1][p]))
            crowded.append(above & np.isin(h, hot))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(len(own) - 1, -1, -1):
            size = np.int64(max(1, len(own[k])))
            key = own[k] * size + np.arange(len(own[k]))
            if found:
                below, state = found[-1]
                parent = self.parent[k + 1][state]
                spread = crowded[k][parent]
                key = np.concatenate([key, below[spread] * size + parent[spread]])
            key = _distinct(key)
            found.append(((key // size).astype(np.int32), (key % size).astype(np.int32)))
        self.own = own
        return found[::-1]

    def packed(self, codes: _Codes, hot: np.ndarray, many: int) -> pa.RecordBatch:
        """A row for each range: its words, and parent steps, labels and weights of its states, level after level."""
        cut = self.ranges(self.hashes(np.array(codes.hashes, np.uint64)), hot, many)
        there = _distinct(cut[0][0])  # every range has a root
        rows, steps, labels, weights = [], [], [], []
        for k, (place, state) in enumerate(cut):
            row, new = _rows(there, place).astype(np.int32), np.diff(place, prepend=-1) != 0
            parent = np.zeros(len(state), np.int32)
            if k:
                above, before, at_own, begin = last
                up = self.parent[k][state]
                parent = np.where(self.own[k - 1][up] == place, at_own[up], -1)
                spread = np.flatnonzero(parent < 0)  # below a crowded prefix
                size = np.int64(max(1, len(self.own[k - 1])))
                if len(spread):
                    parent[spread] = np.searchsorted(above * size + before, place[spread] * size + up[spread])
                parent -= begin[row]
            at_own = np.zeros(len(self.own[k]), np.int32)
            mine = np.flatnonzero(self.own[k][state] == place)
            at_own[state[mine]] = mine
            count = np.bincount(row, minlength=len(there))
            last = place, state, at_own, (np.cumsum(count) - count).astype(np.int32)
            step = np.diff(parent, prepend=np.int32(0))
            step[new] = parent[new]
            rows.append(row), steps.append(step), labels.append(self.label[k][state])
            weight = np.zeros(len(state), np.int32)
            weight[mine] = self.weight[k][state[mine]]
            weights.append(weight)
        level = np.repeat(np.arange(len(rows), dtype=np.int8), [len(row) for row in rows])
        row, steps, labels, weights = (np.concatenate(x) for x in (rows, steps, labels, weights))
        del cut, rows, last, place, state, parent, at_own, mine, step, weight
        order = np.argsort(row, kind="stable")
        row, level = row[order], level[order]
        at = np.searchsorted(row, np.arange(len(there) + 1)).astype(np.int32)
        sizes = np.bincount(row * np.int64(LONGEST + 1) + level, minlength=len(there) * (LONGEST + 1)).astype(np.int32)
        words, label = np.unique(row * np.int64(len(codes.words)) + labels[order], return_inverse=True)
        of_row, word = np.divmod(words, max(1, len(codes.words)))
        words_at = np.searchsorted(of_row, np.arange(len(there) + 1)).astype(np.int32)
        every = pa.array(codes.words, pa.binary()).cast(pa.string())
        listed = pa.ListArray.from_arrays(pa.array(words_at), every.take(pa.array(word)))
        columns = {"place": pa.array(there, pa.int64()), "words": pc.binary_join(listed, "\n"), "sizes": _bytes(sizes, np.arange(len(there) + 1) * (LONGEST + 1))}
        for name, values in (("steps", steps), ("labels", None), ("weights", weights)):
            columns[name] = _bytes(label - words_at[:-1][row] if values is None else values[order], at)
        return pa.RecordBatch.from_pydict(columns)


PACKED = "place long, words string, sizes binary, steps binary, labels binary, weights binary"


def _bytes(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of whole numbers as binary values of one width, which is the length over the number of values."""
    width = next(w for w in (1, 2, 4, 8) if values.max(initial=0) < 1 << 8 * w)
    data = values.astype(f"<u{width}").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * width).astype(np.int32).tobytes()), pa.py_buffer(data)])


def _numbers(column: pa.Array, counts: np.ndarray) -> np.ndarray:
    """The runs of ``_bytes``, one after another; ``counts``: the length of each. All are numbers of a shard (see ``Automaton``)."""
    parts = [np.frombuffer(v.as_buffer(), f"<u{len(v.as_buffer()) // n}") for v, n in zip(column, counts.tolist(), strict=True) if n]
    return np.concatenate(parts, dtype=np.int32, casting="unsafe") if parts else np.zeros(0, np.int32)


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Automaton, _Codes]]:
    """Automata of the texts (columns lang and text), SHARD positions each."""
    codes, lang, found, held = _Codes(), [], [], 0

    def cut(whole: bool) -> Iterator[tuple[Automaton, _Codes]]:
        nonlocal lang, found, held
        root, code = np.concatenate(lang), np.concatenate(found)
        at = 0
        while at < len(code) if whole else len(code) - at >= SHARD + LONGEST:
            starts = min(SHARD, len(code) - at)
            some = slice(at, at + starts + LONGEST - 1)
            yield Automaton.of_positions(root[some], code[some], starts), codes
            at += starts
        lang, found, held = [root[at:]], [code[at:]], len(code) - at

    for batch in batches:
        for root, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            for part in coded(text.as_buffer().to_pybytes(), codes):
                lang.append(np.full(len(part), codes[quote(root).encode()]))
                found.append(part)
                held += len(part)
                if held >= SHARD + LONGEST:
                    yield from cut(False)
        if len(codes.words) > KEPT_WORDS and held:
            yield from cut(True)
            codes, lang, found, held = _Codes(), [], [], 0
    if held:
        yield from cut(True)


def united(rows: pa.Table, least: int) -> pa.Table:
    """The union of one range's automata: (lang, phrase, m, a) of its states with a weight of ``least`` at least, and of the languages."""
    column = {c: rows[c].combine_chunks() for c in rows.column_names}
    sizes = _numbers(column["sizes"], np.full(len(rows), LONGEST + 1)).reshape(-1, LONGEST + 1)
    listed = pc.split_pattern(column["words"], "\n")
    words = listed.flatten().dictionary_encode()
    code, names, many = words.indices.to_numpy(), words.dictionary, np.int64(max(1, len(words.dictionary)))
    words_at = np.concatenate([[0], np.cumsum(pc.list_value_length(listed).to_numpy())])[:-1]
    counts = sizes.sum(axis=1)
    step, label, weight = (_numbers(column[c], counts) for c in ("steps", "labels", "weights"))
    del rows, column, listed
    n, segment = len(sizes), sizes.ravel()
    level = np.repeat(np.tile(np.arange(LONGEST + 1, dtype=np.int8), n), segment)
    blob = np.repeat(np.arange(n, dtype=np.int32), counts)
    label = code[words_at[blob] + label]
    begin = np.cumsum(segment, dtype=np.int64) - segment
    run = np.cumsum(step, dtype=np.int64)
    parent = (run - np.repeat(np.where(segment > 0, run[np.minimum(begin, len(run) - 1)] - step[np.minimum(begin, len(run) - 1)], 0), segment)).astype(np.int32)
    del step, run, code
    paths: np.ndarray = np.zeros((1, 0), np.int64)
    merged, base = np.zeros(n, np.int64), np.arange(n)
    out = []
    for k in range(LONGEST + 1):
        at = np.flatnonzero(level == k)
        above = merged[base[blob[at]] + (parent[at] if k else 0)] if len(at) else np.zeros(0, np.int64)
        going = above >= 0
        pair, state = np.unique(above[going] * many + label[at[going]], return_inverse=True)
        total = np.zeros(len(pair), np.int64)
        np.add.at(total, state, weight[at[going]])
        kept = (total >= least) | (total == 0) | (k == 0)  # without weight: above a range's states
        number = np.where(kept, np.cumsum(kept) - 1, -1)
        merged = np.full(len(at), -1)
        merged[going] = number[state]
        base = np.cumsum(sizes[:, k], dtype=np.int64) - sizes[:, k]
        pair, total = pair[kept], total[kept]
        paths = np.column_stack([paths[pair // many], pair % many])
        told = total > 0
        parts = [names.take(pa.array(c)) for c in paths[told].T]
        roots = parts[0].dictionary_encode()
        lang = pa.array([unquote(r) for r in roots.dictionary.to_pylist()], pa.string()).take(roots.indices)
        phrase = pc.binary_join_element_wise(*parts[1:], " ") if k else pa.array([""] * int(told.sum()), pa.string())
        out.append(pa.table({"lang": lang, "phrase": phrase, "m": pa.array(np.full(int(told.sum()), k, np.int32)), "a": pa.array(total[told])}))
    return pa.concat_tables(out)


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, m, a): all phrases of 1 to LONGEST words that occur ``least`` times at least in their language; with m = 0 the
    number of all words of each language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(LEAST_RANGES, -(-size // RANGE_BYTES))
    python_workers(spark)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made, codes in shards(batches):
            hashes, total = made.hashes(np.array(codes.hashes, np.uint64)), int(made.weight[0].sum())
            some = [np.flatnonzero(w * 2 * HOT > total) for w in made.weight[1:]]
            hashed = np.concatenate([h[s] for h, s in zip(hashes[1:], some, strict=True)]).view(np.int64)
            weight = np.concatenate([w[s] for w, s in zip(made.weight[1:], some, strict=True)])
            yield pa.RecordBatch.from_pydict({"hash": pa.array([*hashed, None], pa.int64()), "n": pa.array([*weight, total], pa.int64())})

    sample = texts.where(F.rand(11) < min(1.0, SAMPLE_BYTES / max(1, size)))
    weighed = checkpointed(sample.mapInArrow(weigh, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))
    total = weighed.where("hash IS NULL").agg(F.sum("n")).first()[0] or 0
    crowded = weighed.where(F.col("hash").isNotNull() & (F.col("n") * HOT > total)).select("hash").collect()  # HOT for each length at most
    hot = np.sort(np.array([r.hash for r in crowded], np.int64).view(np.uint64))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made, codes in shards(batches):
            yield made.packed(codes, hot, many)

    return texts.mapInArrow(build, PACKED).groupBy("place").applyInArrow(lambda rows: united(rows, least), "lang string, phrase string, m int, a long")


def along(phrases: DataFrame, column: str, backwards: bool) -> DataFrame:
    """``phrases`` (lang, phrase, m, a and others) with the counts of each phrase's first 0 to m - 1 words in ``column``; of its last, if ``backwards``.

    Every first (last) part of a phrase must be a row of its own.
    """
    schema = phrases.schema.simpleString()[7:-1]
    total = phrases.count()
    many = max(LEAST_RANGES, -(-total // LOOKED_UP))
    part = "substring_index(phrase, ' ', {})".format("-k" if backwards else "k")
    passed = phrases.where("m > 0").select("lang", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("k"), "phrase").selectExpr("lang", f"{part} AS phrase")
    crowded = passed.groupBy("lang", "phrase").agg(F.count("*").alias("passing")).where(F.col("passing") * HOT > total)
    known = phrases.select("lang", "phrase", "a").join(F.broadcast(crowded), ["lang", "phrase"])  # HOT for each length at most
    hot = {(r.lang, r.phrase): r.a for r in known.collect()}

    @F.pandas_udf("long")
    def place(lang: pd.Series, phrase: pd.Series) -> pd.Series:
        found = []
        for root, text in zip(lang, phrase, strict=True):
            words = text.split(" ") if text else []
            tried = [" ".join(words[len(words) - k :] if backwards else words[:k]) for k in range(len(words) + 1)]
            first = next((t for t in tried if (root, t) not in hot), text)
            found.append(xxhash.xxh64_intdigest(f"{root}\n{first}") % many)
        return pd.Series(found, dtype="int64")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        turned = (lambda w: w[::-1]) if backwards else (lambda w: w)
        words = [t.split(" ") if t else [] for t in group.phrase]
        keys = [(root, turned(w)) for root, w in zip(group.lang, words, strict=True)]
        weight, found = group.a.to_list(), [None] * len(keys)
        path: list = []  # (lang, words), weight of the states from the root to the one last met
        for i in sorted(range(len(keys)), key=keys.__getitem__):
            root, w = keys[i]
            while path and (path[-1][0][0] != root or path[-1][0][1] != w[: len(path[-1][0][1])]):
                path.pop()
            above = {len(k[1]): n for k, n in path}
            found[i] = [above[k] if k in above else hot[root, " ".join(turned(w[:k]))] for k in range(len(w))]
            path.append((keys[i], weight[i]))
        group[column] = found
        return group[[*schema_names, column]]

    schema_names = phrases.columns
    python_workers(phrases.sparkSession)
    return phrases.withColumn("_place", place("lang", "phrase")).groupBy("_place").applyInPandas(lambda g: walk(g.drop(columns="_place")), f"{schema}, {column} array<long>")


def scored_phrases(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, m, a, l, r, n, score) of the phrases of two words and more, by their lowest cut."""
    both = along(along(phrases, "first", False), "last", True).where("m > 1")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            best = []
            for a, first, last in zip(b.a.to_list(), b["first"], b["last"], strict=True):
                n, m = int(first[0]), len(first)
                best.append(min((1000 * a * n // (int(first[k]) * int(last[m - k])), k, int(first[k]), int(last[m - k]), n) for k in range(1, m)))
            s, _, left, right, n = zip(*best, strict=True) if best else ([], [], [], [], [])
            yield b[["lang", "phrase", "m", "a"]].assign(l=list(left), r=list(right), n=list(n), score=list(s))

    return both.mapInPandas(score, "lang string, phrase string, m int, a long, l long, r long, n long, score long")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases.

    A phrase goes if a longer one that holds it occurs as often. One with a word more is enough to look at: what
    lies between two phrases that occur equally often does so too.
    """
    phrases = checkpointed(frequent_phrases(docs, least))
    scored = checkpointed(scored_phrases(phrases))
    inner = scored.where("m > 2").select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', m - 1)"), F.expr("substring_index(phrase, ' ', 1 - m)"))).alias("phrase"), "a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.join(inner.distinct(), ["lang", "phrase", "a"], "left_anti").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE_SQL = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT d, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
numbered AS (SELECT row_number() OVER () AS p, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM numbered),
total AS (SELECT lang, count(*) AS n FROM starts GROUP BY lang),
grams AS (SELECT lang, unnest([ws[i:i + k] FOR k IN range(0, 5) IF i + k <= len(ws)]) AS g FROM starts),
counted AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM counted WHERE len(g) > 1),
scored AS (
  SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.g = c.g[:k] JOIN counted y ON y.lang = c.lang AND y.g = c.g[k + 1:] JOIN total t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
holders AS (SELECT lang, g, f, unnest(range(1, len(g))) AS i FROM counted WHERE len(g) > 2),
spans AS (SELECT lang, g, f, i, unnest(range(i + 1, len(g) + 1)) AS j FROM holders),
held AS (SELECT lang, g[i:j] AS g, max(f) AS f FROM spans WHERE j - i + 1 < len(g) GROUP BY ALL),
kept AS (SELECT w.* FROM lowest w LEFT JOIN held h ON h.lang = w.lang AND h.g = w.g WHERE h.f IS NULL OR h.f < w.a),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank FROM ranked) WHERE rank <= {TOP}
"""
