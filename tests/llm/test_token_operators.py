"""Token operators against their libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelwerk.llm import byte_bpe, token_counts, token_files
from panelwerk.llm.word_tokens import chunk_counter, chunk_encoder, count_texts, encode_texts, vocabulary_path, whole_tokens

TEXTS = [
    None, "", " \n\n \t ", "a", "That it.", "THTHES!! REWH!! don't I'll 'S", "x\x1cy\x85z\x0b\x0c\r\n", "日本語 12345 ½ ﬁ é ẛ̣ é", "<|endoftext|> a<|startoftext|>b <|",
    "İstanbul ΣΑΣ ß ÿ ª µ", "\x00\x01�\U0001F600" * 3, "a\xa0b c", " ́x", "ab " * 3000, "a" * 20000, "x" + " " * 5000 + "y", "of of of of", "of of of of",
]
SCHEMA = "doc_id long, text string, n_tokens string, ids int"  # two columns clash with the operators' own


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 3 else i * 10, t, "x", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5]], SCHEMA)


def test_word_ids_and_counts_are_the_librarys():
    path = vocabulary_path()
    library = Tokenizer.from_file(path)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    got = encode_texts(chunk_encoder(path), [t or "" for t in TEXTS])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    counts = count_texts(chunk_counter(path, whole_tokens(path)), [t or "" for t in TEXTS])
    assert counts == [len(w) for w in want]


def test_byte_bpe_is_the_rank_librarys_and_decodes():
    path = public_tokenizers.path(byte_bpe.RANKS)
    own = byte_bpe.ByteBpe(path, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    texts = [t or "" for t in TEXTS]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_byte_bpe_query_columns(docs):
    rows = byte_bpe.digests(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    empty = next(r for r in rows if r.doc_id == 0)
    assert empty.n_tokens == 0 and empty.ids_sha256 == hashlib.sha256(b"").hexdigest() == empty.decoded_sha256


def test_token_counts_over_rows(docs):
    rows = token_counts.token_counts(docs, column="found").collect()
    assert len(rows) == len(TEXTS) + 1 and {r.n_tokens for r in rows} == {"x"}
    assert token_counts.token_counts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("top", [1, 50, 10**6, 2**40])
@pytest.mark.parametrize("n", [0, 1, 5, 700])
def test_elias_fano_round_trip(n, top):
    values = np.sort(np.random.default_rng(n + top).integers(0, top, n)).astype(np.uint64)
    coded = token_files.elias_fano(values)
    part = token_files.EliasFano(memoryview(coded))
    assert part.values().tolist() == values.tolist() == [part.select(k) for k in range(n)]
    assert part.end == len(coded)
    if n == 700:
        assert 8 * len(coded) < n * (2.6 + max(0, np.log2(top / n)) + 1) + 8 * 24 + 64
    with pytest.raises(IndexError):
        part.select(n)


@pytest.mark.parametrize(("files", "shards"), [(40, 1), (1 << 26, 8)])
def test_token_files_read_back_what_was_written(spark, docs, tmp_path, monkeypatch, files, shards):
    monkeypatch.setattr(token_files, "FILE_BYTES", files)
    monkeypatch.setattr(token_files, "SHARDS_A_CORE", shards)
    folder = f"file://{tmp_path}/files"
    manifest = token_files.write_token_files(docs.withColumn("bucket", F.lit(1)), folder)
    assert manifest.count() > 2 and (manifest.where("part > 0").count() > 0) == (files < 100)
    rows = sorted(token_files.read_token_files(manifest, folder).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(vocabulary_path())
    ids = [(-1 if d is None else d, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in ((r.doc_id, r.text) for r in docs.collect())]
    ids.sort(key=lambda x: (x[0], x[1]))
    start = 0
    for row, (doc_id, own) in zip(rows, ids, strict=True):
        data = np.array(own, "<u4").tobytes()
        assert (-1 if row.doc_id is None else row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, start, len(own), zlib.crc32(data))
        start += len(own)


def test_files_are_numbered_over_all_shards(spark):
    sizes = [(s, p, (7 * s + p) % 5 + 1) for s in range(50) if s % 9 for p in range(1 + s % 3)]
    manifest = spark.createDataFrame([(s, p, f"{s}-{p}", 1, n) for s, p, n in sizes], "shard int, part int, file string, n_docs long, n_tokens long")
    found = {r.file: r.first for r in token_files.numbered(manifest).collect()}
    so_far = 0
    for s, p, n in sizes:
        assert found[f"{s}-{p}"] == so_far
        so_far += n


def table_of(spark, tmp_path, docs, name="documents"):
    docs.repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_queries_of_token_operators_are_brute_force(spark, docs, tmp_path):
    """op4, op5 and op9 over a table with a null id, repeats, long texts and columns of clashing names."""
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    folder = table_of(spark, tmp_path, docs)
    library = Tokenizer.from_file(vocabulary_path())
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.RANKS))
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    word, byte = {t: library.encode(t, add_special_tokens=False).ids for _, t in rows}, {t: tik.encode_ordinary(t) for _, t in rows}
    key = lambda r: tuple((v is None, v) for v in r)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    pack = lambda ids: np.array(ids, "<u4").tobytes()
    want = [(i, len(word[t]) + 1, zlib.crc32(pack([*word[t], 2]))) for i, t in rows]
    got = token_files.op4_token_files(spark, folder).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    assert [r.start for r in sorted(got, key=lambda r: r.start)] == [sum(r.n_tokens for r in sorted(got, key=lambda r: r.start)[:k]) for k in range(len(got))]
    want = [(i, len(byte[t]), sha(pack(byte[t])), sha(t.encode())) for i, t in rows]
    assert sorted(map(tuple, byte_bpe.op5_byte_bpe(spark, folder).collect()), key=key) == sorted(want, key=key)
    want = [(i, len(t.encode()), len(word[t]), len(word[t]) > 2048) for i, t in rows]
    assert sorted(map(tuple, token_counts.op9_token_counts(spark, folder).collect()), key=key) == sorted(want, key=key)


def test_queries_of_empty_tables(spark, tmp_path):
    folder = table_of(spark, tmp_path, spark.createDataFrame([], "doc_id long, text string"))
    for query in (token_files.op4_token_files, byte_bpe.op5_byte_bpe, token_counts.op9_token_counts):
        assert query(spark, folder).count() == 0


def test_columns_of_clashing_names_are_kept(spark):
    given = spark.createDataFrame([(1, "ab", "x", "y")], "doc_id long, text string, n_tokens string, bpe string")
    counted = token_counts.token_counts(given)
    assert counted.columns == ["doc_id", "text", "n_tokens_", "bpe", "n_tokens"] and counted.first().n_tokens_ == "x"
    coded = byte_bpe.encode_documents(given)
    assert coded.columns == ["doc_id", "text", "n_tokens", "bpe_", "bpe"] and coded.first().bpe_ == "y"


def test_token_files_of_an_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    manifest = token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), folder)
    assert token_files.read_token_files(manifest, folder).count() == 0


def test_files_of_an_attempt_that_failed_are_not_read(spark, docs, tmp_path):
    """Each writing makes files of its own; what is read are those of the manifest."""
    folder = f"{tmp_path}/t"
    first = token_files.write_token_files(docs, folder)
    names = {r.file for r in first.collect()}
    want = sorted(map(tuple, token_files.read_token_files(first, folder).collect()), key=str)
    again = token_files.write_token_files(docs, folder)
    assert not names & {r.file for r in again.collect()}
    assert sorted(map(tuple, token_files.read_token_files(again, folder).collect()), key=str) == want
