"""SimHash, winnowing, mixing and URL rules against brute force."""

import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from panelwerk.llm import fingerprints, mixing, simhash, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_simhash(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=4):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= radius and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_simhash_is_the_brute_force_one(spark):
    texts = [None, "", " \t\n", "One", "one TWO three", "É a b c d e f", "a\x0bb c\xa0d e f g h " * 50, "x " * 70000]
    assert [simhash.simhash(t) for t in texts] == [brute_simhash(t) for t in texts]
    native = spark.createDataFrame([("É a b c",)], "s string").selectExpr("xxhash64(s) AS h").first().h
    assert native % 2**64 == xxhash.xxh64_intdigest("É a b c".encode(), 42)


def test_links_connect_what_brute_force_connects(spark, tmp_path):
    draw = random.Random(5)
    values = set()
    for _ in range(40):
        v = draw.getrandbits(64)
        for _ in range(draw.choice([1, 2, 12])):
            values.add(v)
            for b in draw.sample(range(64), draw.randint(1, 6)):
                v ^= 1 << b
    signed = lambda v: v - 2**64 if v >> 63 else v
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(fps, f"file://{tmp_path}/links")).collect()}
    want = brute_components(sorted(values))
    groups = lambda of: {frozenset(x for x in of if of[x] == r) for r in set(of.values())}
    assert groups({signed(v): found.get(signed(v), signed(v)) for v in values}) == groups({signed(v): signed(r) for v, r in want.items()})


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(61)} == {0} and {found[i] for i in range(1000, 1200)} == {1000}


DOCS = [(7, "a b c d e f g h", "s"), (3, "a b c d e f g h", "s"), (3, "a b c d e f g h", "s"), (9, None, None), (8, " ", None), (None, "q r s t u v", "t"), (None, "q r s t u v", "t"), (20, "z y x", "t")]


def test_near_duplicates_with_nulls_and_repeats(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, fp string")
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(DOCS)
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id is not None) == [(3, 3), (3, 3), (7, 3), (8, 8), (9, 8), (20, 20)]
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    kept = simhash.one_of_each(docs).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == [(-1, "q r s t u v"), (3, "a b c d e f g h"), (8, " "), (20, "z y x")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 == simhash.one_of_each(docs.limit(0)).count()


def test_components_are_brute_force_ones(spark, tmp_path, monkeypatch):
    """Hot copies, near copies, blank texts and repeated rows, through the query."""
    draw = random.Random(9)
    base = [" ".join(draw.choice("one two three four five six seven eight nine ten".split()) for _ in range(90)) for _ in range(6)]
    rows = [(k, base[0]) for k in range(100, 160)] + [(k, draw.choice(["", None, " \n"])) for k in range(20)]
    for k in range(200, 300):
        words = draw.choice(base).split()
        words[draw.randrange(90)] = draw.choice(["x", "one", "y"])
        rows.append((k, " ".join(words)))
    rows += rows[:3] + rows[-2:]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    prints = {t: brute_simhash(t) for _, t in rows}
    of = brute_components(sorted(set(prints.values())))
    assert len(set(of.values())) < len(of)
    least = {}
    for i, t in rows:
        r = of[prints[t]]
        least[r] = min(least.get(r, i), i)
    want = sorted((i, f"{prints[t]:016x}", least[of[prints[t]]]) for i, t in rows)
    for hot in (1000, 5):
        monkeypatch.setattr(simhash, "HOT", hot)
        assert sorted(map(tuple, simhash.op6_simhash_near_dedup(spark, str(tmp_path)).collect())) == want
    kept = simhash.one_of_each(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(least.values())


def test_one_of_each_keeps_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2, 3, 4, 5), (2, "a b c", 1, 2, 3, 4, 5), (1, "q w", 6, 7, 8, 9, 0)], "doc_id long, text string, fp int, root int, _hash int, n int, component_id int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted([(1, "a b c", 1, 2, 3, 4, 5), (1, "q w", 6, 7, 8, 9, 0)])


def chained(*parts):
    """Spark's xxhash64 of several values: each one's hash seeds the next."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else (p % 2**64).to_bytes(8, "little"), h)
    return h - 2**64 if h >> 63 else h


def brute_winnow(text, k=fingerprints.K, w=fingerprints.WINDOW):
    if len(text) < k:
        return [(chained(text), 0)] if text else []
    halves = lambda part: part if len(part) == 1 else chained(halves(part[: len(part) // 2]), halves(part[len(part) // 2 :]))
    grams = [halves(text[i : i + k]) for i in range(len(text) - k + 1)]
    chosen = []
    for i in range(max(1, len(grams) - w + 1)):
        best = min(range(i, min(i + w, len(grams))), key=lambda p: (grams[p] >> 31, -p))
        if (grams[best], best) not in chosen:
            chosen.append((grams[best], best))
    return chosen


def test_winnowing_is_the_brute_force_one(spark):
    draw = random.Random(2)
    texts = ["", "  ", "a", "12345678", "123456789", "a" * 40, "ab" * 30, "é\t日本\n語 x y z q", "日本語の文章には空白がない" * 9, "\U0001f600b" * 20]
    texts += ["".join(draw.choice("abcdef ") for _ in range(draw.randint(1, 400))) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for k, w in ((8, 8), (4, 2)):
        rows = docs.select("text", fingerprints.winnowed(F.col("text"), k, w).alias("s")).collect()
        for r in rows:
            assert list(zip(r.s.hashes, r.s.positions, strict=True)) == brute_winnow(r.text, k, w), r.text


def test_changes_at_the_end_are_made_as_if_anew(spark):
    draw = random.Random(6)
    rows = []
    for _ in range(300):
        text = "".join(draw.choice("ab ") for _ in range(draw.choice([0, 5, 9, 17, 40, 200])))
        keep = draw.randint(0, len(text))
        rows.append((text, keep, text[:keep] + "".join(draw.choice("ab ") for _ in range(draw.choice([0, 1, 9, 60])))))
    df = spark.createDataFrame(rows, "a string, keep int, b string")
    for k, w in ((8, 8), (4, 2)):
        got = fingerprints.changed_at_end(fingerprints.winnowed(F.col("a"), k, w), F.col("keep"), F.col("b"), k, w)
        for r in df.select("a", "keep", "b", got.alias("got")).collect():
            assert list(zip(r.got.hashes, r.got.positions, strict=True)) == brute_winnow(r.b, k, w), r


def test_shared_runs_are_found_in_long_texts(spark):
    draw = random.Random(3)
    noise = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    run = noise(fingerprints.K + fingerprints.WINDOW - 1)  # the least length that is guaranteed
    a, b = noise(300_000) + run + noise(50), noise(31) + run + noise(9)
    rows = spark.createDataFrame([(0, a), (1, b)], "i int, text string").select("i", fingerprints.winnowed(F.col("text")).alias("s")).orderBy("i").collect()
    at = [dict(zip(r.s.hashes, r.s.positions, strict=True)) for r in rows]
    assert any(300_000 <= at[0][h] and 31 <= at[1][h] and at[0][h] - 300_000 == at[1][h] - 31 for h in at[0].keys() & at[1].keys())
    assert max(at[0].values()) > 299_000


def test_next_document_follows_across_buckets(spark, monkeypatch):
    ids = [None, *range(0, 2000, 7), 14, 5000]
    docs = spark.createDataFrame([(i, f"text {i} number {k}", 1, 2) for k, i in enumerate(ids)], "doc_id long, text string, bucket int, marks int")
    for size in (64, fingerprints.BUCKET_BYTES):
        monkeypatch.setattr(fingerprints, "BUCKET_BYTES", size)
        rows = fingerprints.with_next(docs).collect()
        assert len(rows) == len(ids)
        follows = {r.text: r.next_text for r in rows}
        assert sorted(follows.values()) == sorted(follows)  # one cycle over all
        seen, at = [], next(t for t in follows if t.startswith("text None"))
        for _ in ids:
            seen.append(at)
            at = follows[at]
        order = [-1 if t.split()[1] == "None" else int(t.split()[1]) for t in seen]
        assert order == sorted(order) and at == seen[0]
    assert fingerprints.with_next(docs.limit(0)).count() == 0
    assert [r.next_text for r in fingerprints.with_next(docs.limit(1)).collect()] == [docs.first().text]


def test_op10_is_brute_force(spark, tmp_path):
    draw = random.Random(8)
    texts = ["a b c d e f g h", "", None, "x y z", "a b c d e f g h", "日本語の文章" * 40, " ".join(draw.choice(["one", "two", "three"]) for _ in range(700))]
    texts += [" ".join(draw.choice("red blue green grey pink teal".split()) for _ in range(draw.randint(1, 60))) for _ in range(60)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in fingerprints.op10_winnowing_fingerprints(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    import hashlib

    def like(a, b):
        a, b = ({h for h, _ in brute_winnow(x)} for x in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    marks = {}
    for k, (i, t) in enumerate(rows):
        t, following = t or "", texts[(k + 1) % len(texts)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - like(t, edited)) < 1e-12 and abs(r.near_next - like(t, following)) < 1e-12
        for text, mark in ((t, r.fingerprint), (edited, r.edited_fingerprint)):
            assert marks.setdefault(text, mark) == mark
    assert len(set(marks.values())) == len({tuple(brute_winnow(t)) for t in marks})


def test_repeated_rows_and_short_texts_keep_their_likeness(spark, tmp_path):
    rows = [(5, "the same words again")] * 30 + [(k, f"a text of some eight or nine words, number {k}") for k in range(10, 60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = fingerprints.op10_winnowing_fingerprints(spark, str(tmp_path)).collect()
    assert len(found) == 80 and sum(r.near_next == 1.0 for r in found) >= 29
    assert sum(r.near_edited for r in found) / 80 > 0.4


def water_level(sizes, weights):
    """Targets by dealing again and again."""
    targets, total, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while open_:
        level = total / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not full:
            return targets | {s: level * weights[s] for s in open_}
        for s in full:
            targets[s], total = 2 * sizes[s], total - 2 * sizes[s]
        open_ -= full
    return targets


@pytest.mark.parametrize(("seed", "block"), [(0, 1024), (1, 64), (2, 7), (3, 1)])
def test_targets_and_mix(spark, seed, block, monkeypatch):
    draw = random.Random(seed)
    names = [None, "b", "a", "é", "zz"][: draw.randint(2, 5)]
    rows = []
    for i in range(300):
        source = names[0] if draw.random() < 0.4 else draw.choice(names)
        rows.append((i if i % 50 else None, source, draw.choice([0, 1, 3, draw.randint(1, 400)])))
    rows += [rows[7], rows[7]]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    targets = {r.source: r for r in mixing.source_targets(sized).collect()}
    order = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    sizes = {s: sum(r[2] for r in rows if r[1] == s) for s in order}
    want = water_level(sizes, weights)
    assert all(abs(targets[s].target - want[s]) < 1e-6 * max(1, want[s]) for s in order)

    table = mixing.source_targets(sized)
    monkeypatch.setattr(mixing, "BLOCK", block)
    placed = mixing.placed(sized, table, ["doc_id"])
    plan = mixing.block_plan(table)
    pieces = mixing.mix(placed, plan)
    taken = {r.sid: r.t for r in pieces.groupBy("sid").sum("n").withColumnRenamed("sum(n)", "t").collect()}
    per_doc = {(r.sid, r.start): r.t for r in pieces.groupBy("sid", "start").sum("n").withColumnRenamed("sum(n)", "t").collect()}
    for r in placed.collect():
        assert per_doc.get((r.sid, r.start), 0) <= 2 * r.size or r.size == 0
    for s in order:
        assert abs(taken.get(targets[s].sid, 0) - want[s]) <= 1
    again = sorted(map(tuple, pieces.collect()))
    assert again == sorted(map(tuple, mixing.mix(mixing.placed(sized, table, ["doc_id"]), plan).collect()))
    slots = {r.source: r for r in plan.collect()}
    drawn = {r.sid: r.n for r in mixing.draw_slots(plan).groupBy("sid").count().withColumnRenamed("count", "n").collect()}
    assert all(drawn.get(p.sid, 0) == p.slots for p in slots.values())
    twice = Counter()  # no word of a document more than twice, none again in one epoch
    for r in pieces.collect():
        for w in range(r.first, r.first + r.n):
            twice[r.sid, r.start, r.epoch, w] += 1
    assert set(twice.values()) <= {1} and {k[2] for k in twice} <= {0, 1}


def test_permutations_are_permutations(spark):
    for n in (1, 2, 7, 100, 257):
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(n))
        back = spark.range(n).select("id", mixing.permuted(mixing.permuted(F.col("id"), F.lit(n), F.lit(3)), F.lit(n), F.lit(3), inverse=True).alias("p")).collect()
        assert all(r.p == r.id for r in back)


def test_mixed_documents(spark, monkeypatch):
    rows = [(1, "a b c", "s", 5), (1, "a b c", "s", 5), (2, None, "s", 0), (3, " ".join(map(str, range(500))), None, 9), (4, "", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    monkeypatch.setattr(mixing, "BLOCK", 64)
    mixed = mixing.mix_documents(docs).collect()
    assert {r.doc_id for r in mixed} == {1, 3} and mixed[0].__fields__ == docs.columns
    assert 753 <= sum(len(WORD.findall(r.text)) for r in mixed) <= 755  # 150 % of 503
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    clash = docs.selectExpr("doc_id", "text", "source", "1 AS _hash", "2 AS p", "3 AS part", "4 AS n_chars", "5 AS size", "6 AS sid")
    assert sorted({tuple(r)[3:6] + tuple(r)[7:] for r in mixing.mix_documents(clash).collect()}) == [(1, 2, 3, 5, 6)]


def test_spans_keep_white_space(spark):
    text = "  one\ttwo\n\nthree  four\nfive six \n"
    cases = [([(0, 6)], "one\ttwo\n\nthree  four\nfive six"), ([(1, 1), (2, 2)], "two\n\nthree  four"), ([(0, 1), (3, 2)], "one\nfour\nfive"), ([(0, 2), (5, 1)], "one\ttwo\nsix")]
    df = spark.createDataFrame([(text, spans, want) for spans, want in cases], "text string, spans array<struct<first long, n long>>, want string")
    for r in df.select(mixing._spans(F.col("text"), F.col("spans")).alias("got"), "want").collect():
        assert r.got == r.want


def test_op7_query(spark, tmp_path):
    """Null ids, null sources, repeats and a hot source: words of each source come to its target, no document beyond twice."""
    draw = random.Random(4)
    rows = [(draw.choice([None, k]), draw.choice(["a", "a", "a", "b", None]), draw.choice([None, "", "w " * draw.randint(1, 900)])) for k in range(300)]
    rows += rows[:5]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op7_mix_sources(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and sorted(r.size for r in got) == sorted(len(WORD.findall(t or "")) for _, _, t in rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source_size, r.target] += r.size
        taken[r.source_size, r.target] += r.taken
    for (size, target), n in sizes.items():
        assert n == size and abs(taken[size, target] - target) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.op7_mix_sources(spark, str(tmp_path)).collect()))


def brute_glob(glob, text):
    star = "[^\n]*"
    return re.fullmatch("".join(star if c == "*" else "[^\n]" if c == "?" else re.escape(c) for c in glob), text, re.S) is not None


def test_automaton_is_a_regex_for_every_glob():
    draw = random.Random(1)
    globs = ["*", "*\n*", "a*b\n", "??", "*.net\n/*", "x" * 100 + "*" + "y" * 70 + "\n", "*a?*b*\n/*", "a", ""]
    globs += ["".join(draw.choice("ab*?\n") for _ in range(draw.randint(1, 9))) for _ in range(60)]
    texts = ["", "a", "ab\n", "aéb\n/", ".a.net\n/x", "x" * 100 + "y" * 70 + "\n", "\n"] + ["".join(draw.choice("ab\né") for _ in range(draw.randint(0, 9))) for _ in range(300)]
    hit = url_filter.Automaton(globs).match(texts)
    for i, t in enumerate(texts):
        assert hit[i].tolist() == [brute_glob(g, t) for g in globs], t


def test_url_verdicts(spark):
    urls = ["http://A.Example.NET/en/1?x=/fr/", "https://x.net", "https://x.net/", "ftp://example.com/de/1#y", "nope", None, "", "://org/fr/1", "http://notexample.com/de/", "http://free-bets.io/a", "http://fine.io/ads/1"]
    pages = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "page_id long, url string, verdict2 string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in sorted(url_filter.judge_urls(pages).collect(), key=lambda r: r.page_id)]
    assert got == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("x.net", "", None, "allow"), ("x.net", "/", "net/", "block"), ("example.com", "/de/1", "example.com/de/", "block"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("org", "/fr/1", "org/fr/", "allow"), ("notexample.com", "/de/", None, "allow"),
        ("free-bets.io", "/a", None, "block"), ("fine.io", "/ads/1", None, "block"),
    ]


def test_urls_long_repeated_empty_and_of_clashing_names(spark, tmp_path):
    long = "http://fine.io/" + "a" * 100_000 + "/ads/x"
    pages = spark.createDataFrame([(1, long, "H", "P", "R", "V", 1), (1, long, "H", "P", "R", "V", 1)], "page_id long, url string, host string, path string, rule string, verdict string, judged int")
    rows = url_filter.judge_urls(pages)
    assert rows.columns == ["page_id", "url", "host_", "path_", "rule_", "verdict_", "judged", "host", "path", "rule", "verdict"]
    for r in rows.collect():
        assert (r.host, r.verdict, r.host_, r.path_, r.rule_, r.verdict_, r.judged) == ("fine.io", "block", "H", "P", "R", "V", 1) and len(r.path) > 100_000
    pages.limit(0).write.parquet(f"{tmp_path}/pages.parquet")
    assert url_filter.op8_url_filter(spark, str(tmp_path)).count() == 0


def test_op8_query_is_brute_force(spark):
    pages = {r.page_id: r.url or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in url_filter.op8_url_filter(spark, "/root/testdata/sf0.01").collect():
        rest = pages[r.page_id].partition("://")[2]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        blocked = any(brute_glob(h, "." + host) and brute_glob(p, path) for h, p in url_filter.BLOCKED)
        want = max(fits)[1:] if fits else (None, "block" if blocked else "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *want)
