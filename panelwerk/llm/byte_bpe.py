"""Byte-level BPE with a sentencepiece model made from a rank file.

The rank file's byte strings are written as pieces of printable characters (one for each byte), scored by negative rank, with
identity normalisation; no merges are stored. sentencepiece joins the neighbours whose piece has the best score, leftmost
first, which is the order of the ranks. A pre-token that is in the vocabulary is that token, as the rank files' own
library has it, and only the others are merged. Ids are decoded by the inverse mapping of bytes.

Encoding is one scan without a shuffle. Pre-tokens repeat, so a worker keeps what it has encoded, within a bound.

Defined results: null and empty texts have no ids (the digest of no bytes); repeated rows are encoded one by one; extra
columns are kept by ``encode_documents``, one named ``bpe`` under another name. Texts are never cut. A lone surrogate cannot occur in Spark's strings.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import python_workers
from .common import set_aside, table
from .word_tokens import Kept, byte_characters

RANKS = "byte_bpe_multi_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _field(number: int, wire: int, value: int | bytes) -> bytes:
    """A field of protocol buffers' wire format."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    key = varint(number << 3 | wire)
    if wire == 0:
        return key + varint(value)
    return key + (value if wire == 5 else varint(len(value)) + value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model: piece i + 1 is the i-th entry in rank order, piece 0 is unknown."""
    char = byte_characters()
    out = [_field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, 2))]
    for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
        name = "".join(map(char.__getitem__, piece)).encode()
        out.append(_field(1, 2, _field(1, 2, name) + _field(2, 5, struct.pack("<f", -float(rank))) + _field(3, 0, 1)))
    trainer = _field(3, 0, 2) + _field(4, 0, len(ranks) + 1) + _field(40, 0, 0)  # BPE, size, id of unknown
    trainer += b"".join(_field(n, 0, (1 << 64) - 1) for n in (41, 42, 43))  # no begin, end or padding
    normalizer = _field(1, 2, b"identity") + _field(3, 0, 0) + _field(4, 0, 0) + _field(5, 0, 0)  # no prefix, trimming or escape
    return b"".join(out) + _field(2, 2, trainer) + _field(3, 2, normalizer)


class ByteBpe:
    """Encodes texts, a batch at a time, and decodes ids; ids are the ranks."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        self.by_piece = np.array([-1, *sorted(self.ranks.values())], dtype=np.int64)
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(model_bytes(self.ranks))
        self.whole = {b: np.array([r], "<u4").tobytes() for b, r in self.ranks.items()}
        self.latin = {b: c for b, c in byte_characters().items()}
        self.find = regex.compile(pattern).findall
        self.kept = Kept(self._make)

    def _make(self, pres: list[str]) -> list[bytes]:
        made = [self.whole.get(raw := p.encode()) or raw for p in pres]
        rest = [k for k, p in enumerate(pres) if p.encode() not in self.whole]
        pieces = self.model.encode([made[k].decode("latin-1").translate(self.latin) for k in rest], num_threads=1) if rest else []
        for k, found in zip(rest, pieces, strict=True):
            ids = self.by_piece[found]
            if (ids < 0).any():
                raise ValueError("the vocabulary lacks a byte")
            made[k] = ids.astype("<u4").tobytes()
        return made

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text, 4 bytes each."""
        parts = [self.find(t) for t in texts]
        self.kept.learn(chain.from_iterable(parts))
        return [b"".join(map(self.kept.get, p)) for p in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``bpe``: its ids (little-endian, 4 bytes each), their number, and the bytes decoded from them."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    @F.pandas_udf("n_tokens long, ids binary, decoded binary")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = coder(path, pattern)
        for batch in texts:
            ids = bpe.encode(batch)
            yield pd.DataFrame({"n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": [bpe.decode(x) for x in ids]})

    python_workers(docs.sparkSession)
    return set_aside(docs, "bpe").withColumn("bpe", encode(F.coalesce(F.col(text), F.lit(""))))


def digests(docs: DataFrame) -> DataFrame:
    made = encode_documents(docs)
    return made.select("doc_id", "bpe.n_tokens", F.sha2("bpe.ids", 256).alias("ids_sha256"), F.sha2("bpe.decoded", 256).alias("decoded_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
