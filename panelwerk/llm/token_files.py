"""Token-id files: one concatenated id array a shard, with Elias-Fano coded document boundaries.

A shard holds the documents of a range of ids in ascending order. Its layout, little-endian:

    magic "EFTK" | u32 version | u32 id width in bytes | u32 spare | u64 documents | u64 null ids | i64 least id | u64 tokens
    | Elias-Fano of the document ids (less the least) | Elias-Fano of the boundaries (0, end of 1st, ..., end of last)
    | ids, each of 2 bytes if the vocabulary allows, else of 4

An Elias-Fano part is u64 count | u64 low bits | u64 bytes of the upper part | low bits, packed | upper bits (unary gaps) | a u64
for every SAMPLE-th value: the bit where it stands in the upper part. ``select`` starts at a sample and counts the bits of at most
SAMPLE values, word by word, so a boundary is found in near-minimal space without a table of 64-bit offsets. Reading takes
every boundary by ``select``.

Texts are dealt to shards of neighbouring ids by one shuffle (by ranges that Spark draws a sample for) and encoded by the task that writes their
shard. A task that runs again (or twice) after an executor is lost writes files of other names; the manifest, which Spark commits, names one whole
file of each part. Defined results: null texts are written as the end id alone; documents with equal ids follow each other in the order
of a hash of their text; a null doc_id comes first; repeated rows are written one by one; an empty table makes no file and no
rows; extra columns are left out. Texts are never cut.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import python_workers
from .common import shared_dir, table
from .word_tokens import chunk_encoder, encode_texts, library, vocabulary_path

END_ID = 2
SAMPLE = 256
#: Bytes of text in a shard, about (there are some shards for each core in any case), and bytes of ids after which a shard goes on in
#: another file.
SHARD_BYTES, SHARDS_A_CORE, FILE_BYTES = 64 << 20, 8, 1 << 26
HEAD = struct.Struct("<4sIIIQQqQ")
PART = struct.Struct("<QQQ")


def elias_fano(values: np.ndarray) -> bytes:
    """Code a non-descending array of non-negative integers."""
    values = values.astype(np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    bits = (values[:, None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)).astype(np.uint8) if low else np.zeros((n, 0), np.uint8)
    lows = np.packbits(bits.ravel(), bitorder="little").tobytes()
    at = (values >> np.uint64(low)) + np.arange(n, dtype=np.uint64)
    upper = np.zeros((int(at[-1]) + 1 if n else 0), np.uint8)
    upper[at] = 1
    uppers = np.packbits(upper, bitorder="little").tobytes()
    return PART.pack(n, low, len(uppers)) + lows + uppers + at[::SAMPLE].astype("<u8").tobytes()


class EliasFano:
    """Reads a coded part where it lies in a buffer."""

    def __init__(self, data: memoryview, start: int = 0):
        self.n, self.low, upper = PART.unpack_from(data, start)
        a = start + PART.size
        b = a + (self.n * self.low + 7) // 8
        c = b + upper
        self.end = c + 8 * -(-self.n // SAMPLE)
        self.lows, self.uppers, self.samples = data[a:b], data[b:c], np.frombuffer(data[c : self.end], "<u8")

    def select(self, k: int) -> int:
        """The k-th value, from 0."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        at, rest = int(self.samples[k // SAMPLE]), k % SAMPLE
        byte, skip = at // 8, at % 8
        word = int.from_bytes(self.uppers[byte : byte + 8], "little") >> skip << skip
        while (ones := word.bit_count()) <= rest:
            rest, byte = rest - ones, byte + 8
            word = int.from_bytes(self.uppers[byte : byte + 8], "little")
        for _ in range(rest):
            word &= word - 1
        high = 8 * byte + (word & -word).bit_length() - 1 - k
        first = k * self.low
        lows = int.from_bytes(self.lows[first // 8 : (first + self.low + 7) // 8], "little") >> first % 8
        return high << self.low | lows & ((1 << self.low) - 1)

    def values(self) -> np.ndarray:
        """All values at once."""
        at = np.flatnonzero(np.unpackbits(np.frombuffer(self.uppers, np.uint8), bitorder="little"))[: self.n].astype(np.uint64)
        highs = (at - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low)
        if not self.low:
            return highs.astype(np.int64)
        bits = np.unpackbits(np.frombuffer(self.lows, np.uint8), bitorder="little", count=self.n * self.low).reshape(self.n, self.low)
        return (highs | (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)).astype(np.int64)


def open_shard(data: bytes | memoryview) -> tuple[int, int, EliasFano, EliasFano, np.ndarray]:
    """(null ids, least id, coded ids, coded boundaries, token ids) of a shard."""
    data = memoryview(data)
    magic, version, width, _, n, nulls, least, tokens = HEAD.unpack_from(data)
    if magic != b"EFTK" or version != 1:
        raise ValueError("not a token file")
    ids = EliasFano(data, HEAD.size)
    ends = EliasFano(data, ids.end)
    return nulls, least, ids, ends, np.frombuffer(data[ends.end : ends.end + tokens * width], f"<u{width}")


def shard_bytes(doc_ids: list[int | None], lengths: list[int], blobs: list[bytes], width: int) -> list[bytes]:
    """A shard in pieces, ready to be written one after another."""
    known = [i for i in doc_ids if i is not None]
    least = known[0] if known else 0
    ids = np.array([i - least for i in known], dtype=np.uint64)
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.uint64)
    head = HEAD.pack(b"EFTK", 1, width, 0, len(doc_ids), len(doc_ids) - len(known), least, int(ends[-1]))
    return [head, elias_fano(ids), elias_fano(ends), *blobs]


def id_width(path: str) -> int:
    return 2 if library(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the shards of ``docs`` into ``folder`` and return their manifest: (shard, part, file, n_docs, n_tokens)."""
    path = path or vocabulary_path()
    width = id_width(path)
    spark = docs.sparkSession

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = pafs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        kept, end = chunk_encoder(path, f"<u{width}"), end_id.to_bytes(width, "little")
        shard, part, held, ids, lengths, blobs = None, 0, 0, [], [], []

        def close() -> pd.DataFrame:
            # a name of its own for each attempt: the manifest, which Spark commits, names those that count
            name = f"{root}/shard-{shard:07d}-{part:05d}-{uuid.uuid4().hex}.eftk"
            with system.open_output_stream(name) as out:
                for piece in shard_bytes(ids, lengths, blobs, width):
                    out.write(piece)
            return pd.DataFrame({"shard": [shard], "part": [part], "file": [name], "n_docs": [len(ids)], "n_tokens": [sum(lengths)]})

        for batch in batches:
            for s, i, b in zip(batch.bucket, batch.doc_id.astype("object"), encode_texts(kept, batch.text), strict=True):
                if shard is not None and (s != shard or held >= FILE_BYTES):
                    yield close()
                    part = part + 1 if s == shard else 0
                    held, ids, lengths, blobs = 0, [], [], []
                b += end
                shard, held = s, held + len(b)
                ids.append(None if pd.isna(i) else int(i))
                lengths.append(len(b) // width)
                blobs.append(b)
        if shard is not None:
            yield close()

    python_workers(spark)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(-(-size // SHARD_BYTES), SHARDS_A_CORE * spark.sparkContext.defaultParallelism)
    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    dealt = base.withColumn("tie", F.xxhash64("text")).repartitionByRange(shards, *order).sortWithinPartitions(*order).withColumn("bucket", F.spark_partition_id())
    manifest = dealt.select("bucket", "doc_id", "text").mapInPandas(write, "shard int, part int, file string, n_docs long, n_tokens long")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def numbered(manifest: DataFrame) -> DataFrame:
    """``manifest`` with ``first``: the ids in all files before. Shards are summed in runs, and runs by a window of one row for each."""
    size = max(1, math.isqrt(manifest.agg(F.max("shard")).first()[0] or 0))
    runs = manifest.groupBy(F.expr(f"shard DIV {size}").alias("run")).agg(F.sum("n_tokens").alias("all"))
    before = lambda of: of.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("run", F.coalesce(F.sum("all").over(before(Window.orderBy("run"))), F.lit(0)).alias("base"))  # as many rows as the root of the shards
    placed = manifest.withColumn("run", F.expr(f"shard DIV {size}"))
    placed = placed.withColumn("inner", F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("run").orderBy("shard", "part"))), F.lit(0)))
    return placed.join(runs, "run").withColumn("first", (F.col("base") + F.col("inner")).cast("long")).drop("run", "base", "inner")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the shards back: (doc_id, start, n_tokens, ids_crc32), positions over all shards, boundaries by ``select``."""
    spark = manifest.sparkSession
    placed = numbered(manifest).repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(batch.file, batch["first"], strict=True):
                with system.open_input_stream(name) as got:
                    nulls, least, ids, ends, tokens = open_shard(got.read())
                doc_ids = np.concatenate([np.zeros(nulls, np.int64), ids.values() + least])
                at = np.array([ends.select(k) for k in range(ends.n)], np.int64)
                crcs = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                out = pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "start": first + at[:-1], "n_tokens": np.diff(at), "ids_crc32": crcs})
                out.loc[out.index < nulls, "doc_id"] = pd.NA
                yield out

    return placed.select("file", "first").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    manifest = write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    return read_token_files(manifest, folder)
