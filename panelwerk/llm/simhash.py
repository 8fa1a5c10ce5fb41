"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most R = 4 bits have a value within R / 2 = 2 bits of both. So every distinct fingerprint
emits all 2,081 values within two bits of it, the values are shuffled, and fingerprints that meet at a value are verified
and linked. All that meet at one value are within 4 bits of each other, so each is linked to the least of them only: a value's
group makes one link less than it has members, never all pairs, and no connection is lost. A bucket of values keeps a spanning
forest of its links. Connected components of all are found by alternating large-star and small-star rounds.

What moves is bounded at every step: equal fingerprints are one before anything is emitted; at most 2,081 distinct ones can
meet at a value; the values are dealt in PASSES rounds (by a linear syndrome, so that each round makes only its own), and
their shuffle files are dropped after each; inside a round they travel as packed arrays of 10 bytes an entry (the value and
which of the 2,081 masks made it) to as many buckets as the number of fingerprints asks for.

Defined results: a null, empty or blank text has fingerprint zero, linked like any other; texts of fewer than SHINGLE words are
one shingle; repeated rows are kept and share their component; a component whose documents all have a null doc_id has a null
component_id; an empty table gives no rows. Texts are never cut. Extra columns are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import python_workers
from .common import checkpointed, drop_folder, free_name, settings, shared_dir, table

SHINGLE, SEED, BITS, RADIUS = 4, 42, 64, 4
#: Rounds in which the values are dealt (a power of two), entries of a bucket, fewest buckets, and fingerprints expanded at once.
PASSES, BUCKET_ENTRIES, LEAST_BUCKETS, EXPANDED = 8, 1_000_000, 24, 4096
#: A key is hot if more than one row in so many has it.
HOT = 1000
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    parts = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    joined = memoryview(b" ".join(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(parts))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(parts) - k + 1)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        block = hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprinted(docs: DataFrame, text: str = "text", column: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of each text as a long (its 64 bits)."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([simhash(t) for t in batch], dtype=np.uint64).view(np.int64))

    python_workers(docs.sparkSession)
    return docs.withColumn(column, of(F.coalesce(F.col(text), F.lit(""))))


def ball_masks(radius: int = RADIUS // 2) -> np.ndarray:
    bits = [1 << b for b in range(BITS)]
    return np.array([0, *(sum(c) for r in range(1, radius + 1) for c in combinations(bits, r))], dtype=np.uint64)


def syndromes(values: np.ndarray) -> np.ndarray:
    """A linear map to 0 .. PASSES - 1: of a xor b it is that of a xor that of b, so masks can be chosen by it."""
    out = np.zeros(len(values), np.int64)
    for j in range(PASSES.bit_length() - 1):
        row = np.uint64(sum(1 << b for b in range(BITS) if b >> j & 1))
        out |= (np.bitwise_count(values & row).astype(np.int64) & 1) << j
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (a, b) connect: each member of a group with the group's least, once."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def _met(fps: DataFrame, turn: int, buckets: int) -> DataFrame:
    """(a, b): links of the fingerprints that meet at a value whose syndrome is ``turn``."""
    masks = ball_masks()
    of_mask = syndromes(masks)
    chosen = [np.flatnonzero(of_mask == s).astype(np.uint16) for s in range(PASSES)]

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def expand(own: np.ndarray) -> pd.DataFrame:
            kinds = syndromes(own)
            values, which = [], []
            for s in range(PASSES):
                some, with_masks = own[kinds == s], chosen[turn ^ s]
                values.append((some[:, None] ^ masks[with_masks][None, :]).ravel())
                which.append(np.tile(with_masks, len(some)))
            value, mask = np.concatenate(values), np.concatenate(which)
            bucket = ((value * SPREAD) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint64), kind="stable")
            value, mask, bucket = value[order], mask[order], bucket[order]
            at = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1)))
            ends = np.append(at[1:], len(bucket))
            entries = [value[a:b].tobytes() + mask[a:b].tobytes() for a, b in zip(at, ends, strict=True)]
            return pd.DataFrame({"bucket": bucket[at].astype(np.int64), "entries": entries})

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.fp.to_numpy().view(np.uint64))
            if sum(map(len, held)) >= EXPANDED:
                yield expand(np.concatenate(held))
                held = []
        if sum(map(len, held)):
            yield expand(np.concatenate(held))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(e) // 10 for e in group.entries]
        value = np.concatenate([np.frombuffer(e, np.uint64, n) for e, n in zip(group.entries, sizes, strict=True)])
        mask = np.concatenate([np.frombuffer(e, np.uint16, n, 8 * n) for e, n in zip(group.entries, sizes, strict=True)])
        order = np.argsort(value)
        value, mask = value[order], mask[order]
        same = value[1:] == value[:-1]
        inside = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        if not len(inside):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        value, fp = value[inside], value[inside] ^ masks[mask[inside]]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        least = np.repeat(np.minimum.reduceat(fp, first), np.diff(np.append(first, len(fp))))
        near = (fp != least) & (np.bitwise_count(fp ^ least) <= RADIUS)
        a, b = forest(fp[near], least[near])
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    packed = fps.select("fp").mapInPandas(emit, "bucket long, entries binary")
    return packed.groupBy("bucket").applyInPandas(meet, "a long, b long")


def links(fps: DataFrame, folder: str) -> DataFrame:
    """(a, b) with a other than b: enough pairs within RADIUS bits to connect all distinct fingerprints that are so linked.

    The rounds are written into ``folder``, from which the pairs are read.
    """
    spark = fps.sparkSession
    entries = fps.count() * len(ball_masks()) // PASSES
    buckets = max(LEAST_BUCKETS, -(-entries // BUCKET_ENTRIES))
    # each round's shuffle files go when the round has been written
    with settings(spark, conf={"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        for turn in range(PASSES):
            _met(fps, turn, buckets).write.mode("overwrite").parquet(f"{folder}/turn={turn}")
    return spark.read.schema("a long, b long").parquet(*[f"{folder}/turn={turn}" for turn in range(PASSES)]).distinct()


def _joined(rows: DataFrame, per_key: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``per_key`` (key, n and others; n: its rows out of ``total``).

    Keys that more than one row in HOT has are few, HOT at most, and so their rows are joined by a broadcast; only the other rows are
    dealt by key.
    """
    hot, cold = per_key.where(F.col("n") * HOT > total).drop("n"), per_key.where(F.col("n") * HOT <= total).drop("n")
    of_hot = rows.join(F.broadcast(hot), key)
    return of_hot.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the pairs (a, b); the root is the least node reachable.

    Large-star and small-star rounds in turn; each shrinks the distance to the root, and a hub's neighbours meet only in a
    minimum (combined before the shuffle) and in a join that deals none of them by the hub.
    """
    edges = checkpointed(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = state(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _joined(both, least, "u", 2 * seen[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = state(edges)
        if now == seen:
            break
        seen = now
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, key: list[str] | None = None, text: str = "text") -> DataFrame:
    """(doc_id, *key, fp, root, component_id) for every row of ``docs``; ``root`` tells components apart."""
    spark, extra = docs.sparkSession, key or []
    rows = checkpointed(fingerprinted(docs.select("doc_id", *extra, text), text).drop(text))
    by_fp = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    folder = f"{shared_dir(spark)}/links-{uuid.uuid4().hex}"
    found = components(links(by_fp, folder)).withColumnRenamed("node", "fp")
    drop_folder(spark, folder)
    linked = found.join(by_fp.select("fp", "least"), "fp")
    per_root = checkpointed(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    named = _joined(found, per_root, "root", per_root.agg(F.sum("n")).first()[0] or 0)
    per_fp = by_fp.join(named, "fp", "left")
    of_fp = F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("least"))
    per_fp = checkpointed(per_fp.select("fp", "n", F.coalesce("root", "fp").alias("root"), of_fp.alias("component_id")))
    total = per_fp.agg(F.sum("n")).first()[0] or 0
    return _joined(rows, per_fp, "fp", total).select("doc_id", *extra, "fp", "root", "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the least doc_id (where all are null: a null one), then the least text hash.

    Whether a row has its component's least id is told by the row alone; only those that have it are grouped.
    """
    hashed = free_name(docs, "_hash")
    keyed = docs.withColumn(hashed, F.xxhash64("text"))
    found = near_duplicates(keyed, [hashed]).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    counted = checkpointed(found.groupBy("root", "doc_id", F.col(hashed).alias("_hash")).agg(F.count("*").alias("n")))
    best = counted.groupBy("root").agg(F.min(F.struct("_hash", "doc_id")).alias("b"), F.min_by("n", F.struct("_hash", "doc_id")).alias("n"))
    best = checkpointed(best.select(F.col("b.doc_id").alias("best_id"), F.col("b._hash").alias("best_hash"), "n"))
    same = lambda df: keyed["doc_id"].eqNullSafe(df["best_id"]) & keyed[hashed].eqNullSafe(df["best_hash"])
    single, repeated = best.where("n = 1"), best.where("n > 1")
    kept = keyed.join(single, same(single), "left_semi")
    if not repeated.isEmpty():
        kept = kept.unionByName(keyed.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", hashed]))
    return kept.select(*docs.columns)
