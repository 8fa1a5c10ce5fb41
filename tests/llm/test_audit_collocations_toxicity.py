"""Phrase collocations, toxicity and the filter audit."""

import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from panelwerk.llm import collocations, filter_audit, registry, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op13_filter_audit"])
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    twin = con.sql(registry.ORACLE_SQL[name])
    assert sorted(twin.columns) == columns
    at = [twin.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(tuple(r[k] for k in at) for r in twin.fetchall())


# -- collocations


def brute_collocations(rows, least, top):
    """Counting with dictionaries, cuts and containment tried one by one."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    phrases = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    kept = []
    for (lang, w), a in phrases.items():
        if any(la == lang and len(v) > len(w) and 100 * b >= 100 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (la, v), b in phrases.items()):
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        kept.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], total[lang]))
    out = []
    for lang in {k[0] for k in kept}:
        ranked = sorted(k for k in kept if k[0] == lang)[:top]
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (_, s, a, p, left, right, n) in enumerate(ranked)]
    return sorted(out)


def collocated(spark, rows, least, top):
    docs = spark.createDataFrame(rows, "lang string, text string")
    return sorted(tuple(r) for r in collocations.collocations(docs, least, top).collect())


def made_texts(seed, many):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "a", "x", "über", "=en", "é", "o'k", "%20"]
    return [(rng.choice(["en", "de", None, "x y", "und"]), "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", "\n", ", ", " "]) for _ in range(rng.randrange(60)))) for _ in range(many)]


def test_collocations_against_counting(spark):
    rows = made_texts(3, 120) + [("en", None), ("en", ""), (None, " \t "), ("en", "new york city " * 40), ("fr", "word")]
    expected = brute_collocations(rows, 5, 9)
    assert len(expected) > 20
    assert collocated(spark, rows, 5, 9) == expected


def test_collocations_cut_into_many_shards_and_ranges(spark, monkeypatch):
    """Shards of a few positions, slices of a few bytes, every common prefix crowded: nothing changes."""
    rows = made_texts(5, 60) + [("en", "a " * 3000)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    expected = sorted(tuple(r) for r in collocations.collocations(docs, 4, 50).collect())
    assert expected == brute_collocations(rows, 4, 50)
    for name, value in (("SHARD", 50), ("SLICE", 40), ("KEPT_WORDS", 3), ("HOT", 10), ("LEAST_RANGES", 7)):
        monkeypatch.setattr(collocations, name, value)
    codes = collocations._Codes()
    batch = pa.RecordBatch.from_pylist([{"lang": la or "und", "text": t} for la, t in rows])
    packed = [made.packed(codes, np.zeros(0, np.uint64), 7) for made, codes in collocations.shards(iter([batch]))]
    assert len(packed) > 20
    hot = np.sort(np.unique(np.concatenate([h for made, codes in collocations.shards(iter([batch])) for h in made.hashes(np.array(codes.hashes, np.uint64))[1:4]])))
    counted = {}
    for crowded in (hot[:0], hot, hot[::2]):
        rows_of = [made.packed(codes, crowded, 7) for made, codes in collocations.shards(iter([batch]))]
        everything = pa.Table.from_batches(rows_of)
        found = {}
        for place in range(7):
            own = everything.filter(pa.compute.equal(everything["place"], place))
            if len(own):
                for r in collocations.united(own, 4).to_pylist():
                    assert (r["lang"], r["phrase"]) not in found
                    found[r["lang"], r["phrase"]] = r["a"]
        counted[len(crowded)] = found
    first, *others = counted.values()
    assert first and all(o == first for o in others)


def test_collocations_of_nothing(spark):
    assert collocated(spark, [], 1, 5) == []
    assert collocated(spark, [(None, None), ("en", "...")], 1, 5) == []
    assert collocated(spark, [("en", "A b")], 1, 5) == [("en", 1, "a b", 1, 1, 1, 2, 2000)]


def test_scores_beyond_64_bits(spark):
    big = 10**12
    rows = [("en", "", 0, big * 9), ("en", "a", 1, big), ("en", "b", 1, big + 7), ("en", "a b", 2, big - 1)]
    (r,) = collocations.scored_phrases(spark.createDataFrame(rows, "lang string, phrase string, m int, a long")).collect()
    assert r.score == 1000 * (big - 1) * 9 * big // (big * (big + 7)) and (r.l, r.r, r.n) == (big, big + 7, 9 * big)


# -- toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = toxicity.op12_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    bad, good = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    assert np.mean([b > g for b in bad for g in good]) > 0.8
    assert sum(r.predicted for r in held if not r.toxic) <= 2
    assert all(r.predicted == (r.score >= 0.7) for r in rows)


def planted(weight):
    """A classifier of sentences in which groups are named more often in toxic ones."""
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(80)]
    samples = []
    for i in range(900):
        toxic = i % 3 == 0
        words = rng.sample(plain, 12) + (["scum"] if toxic and rng.random() < 0.7 else [])
        if rng.random() < (0.8 if toxic else 0.05):
            words.append(rng.choice(["muslims", "jews", "gays", "immigrants"]))
        rng.shuffle(words)
        text = " ".join(words)
        samples.append((toxicity.features(text), int(toxic), toxicity.changes(text, random.Random(i))))
    return toxicity.learn(samples, weight)


def test_counterfactuals_lower_the_score_of_neutral_mentions():
    plain, tamed = planted(0.0), planted(toxicity.COUNTERFACTUAL)
    neutral, bare, toxic = "w1 w2 immigrants w3 w4", "w1 w2 w3 w4", "w1 w2 scum w3 w4"
    gap = lambda w: toxicity.score(neutral, w) - toxicity.score(bare, w)
    assert gap(plain) > 0.3 and gap(tamed) < gap(plain) / 3
    assert toxicity.score(toxic, tamed) > 0.7 > toxicity.score(neutral, tamed)


def test_counterfactual_pairs():
    rng = random.Random(1)
    ((a, b),) = toxicity.counterfactuals("Women and men, or Frauen.", rng)
    assert a == "Women and men, or Frauen." and re.fullmatch(r"[A-Z]\w+ and \w+, or [A-Z]\w+\.", b) and "Women" not in b and "Frauen" not in b
    (x, named), (same, other) = toxicity.counterfactuals("no one here", rng)
    assert x == "no one here" and named == same and named != other and len(named.split()) == len(other.split()) == 4
    assert toxicity.counterfactuals(" ... ", rng) == []


def test_features_do_not_depend_on_slices(monkeypatch):
    text = "Das ist “ein” Text, über 12 Wörter – und mehr; 　ganz viele_mehr. " * 30
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "SLICE", 50)
    assert (toxicity.features(text) == whole).all()
    word, begun = toxicity.hashed_words("ab abcde über — ab".encode())
    assert len(word) == 4 and word[0] == word[3] and begun[0, 0] == word[0] and begun[1, 0] == toxicity.hashed_words(b"abcd")[0][0]
    assert len(toxicity.features("")) == len(toxicity.features(" .,\n")) == 0


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (None, "a b", 0.3), (2, "", 0.2), (5, "x " * 300000, 0.1)], "doc_id long, text string, Score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score_texts(docs, toxicity.train(docs, none)).collect()
    assert [r.score for r in rows] == [0.5] * 5 and sorted(r.Score_ for r in rows) == [0.1, 0.1, 0.2, 0.2, 0.3]
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 1), (2, 0, 0), (None, 0, 1), (5, 0, 0)], none.schema)
    assert len(toxicity.train(docs, labels)) == (1 << toxicity.BITS) + 1
    assert toxicity.score_texts(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0
    held = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.held_out(docs.doc_id).alias("h")).collect()}
    assert held[None] and held[1] == (__import__("zlib").crc32(b"1") % 3 == 1)


# -- filter audit


def brute_audit(docs, labels):
    """Every order applied to every document, one filter after another."""
    tags = {}
    for i, quality, toxic in labels:
        if i is not None:
            q, t = tags.get(i, (0, 0))
            tags[i] = max(q, quality or 0), max(t, toxic or 0)
    cells = {}
    for i, lang, text in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(words) < 100:
            fails.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in docs):
            fails.add("E")
        cells.setdefault(lang or "", []).append((fails, *tags.get(i, (0, 0))))
    out = []
    for part, rows in cells.items():
        removed_by = Counter()
        kept_rows = []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                removed_by[f] += len(gone)
                fails = sum(f in r[0] for r in rows)
                kept_rows.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), f))
        out += [(*r[:-1], removed_by[r[-1]]) for r in kept_rows]
    return sorted(out)


def audit_rows(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, lang string, text string").selectExpr("*", "1 AS n", "'x' AS part", "0 AS mask")
    la = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in filter_audit.filter_audit(d, la).collect())


def test_audit_against_applying_every_order(spark):
    rng = random.Random(8)
    texts = [None, "", "A#", " ".join(f"w{i}" for i in range(120)), "same " * 150, "LOUD " * 20, " ".join(f"W{i}" for i in range(101)), "x | y", "a" * 50000]
    docs = [(rng.choice([None, *range(12)]), rng.choice(["en", "de", None, ""]), rng.choice(texts)) for _ in range(60)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in [*range(8), 3, None]]
    assert audit_rows(spark, docs, labels) == brute_audit(docs, labels)


def test_audit_edges(spark):
    assert audit_rows(spark, [], []) == []
    rows = audit_rows(spark, [(7, None, None)], [])
    assert len(rows) == 600 and {r[0] for r in rows} == {""} and all(r[3] + r[4] + r[5] >= 0 for r in rows)
    assert sum(r[4] for r in rows) == 120  # only A fails


def test_removal_ranks_are_least_positions():
    masks = np.array([[0, 0, 0], [1, 0, 1], [0, 1, 0]], bool)
    positions = np.array([[1, 2, 3], [3, 1, 2]])
    assert filter_audit.removal_ranks(masks, positions).tolist() == [[4, 4], [1, 2], [2, 1]]
