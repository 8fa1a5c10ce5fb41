"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import checkpointed, shared_dir  # noqa: F401

#: White space of the contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable is bound, an inlined expression is not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder that the library wrote and needs no more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings (``_`` for ``.`` is not guessed: pass a dict) for the jobs run inside."""
    pairs = conf.pop("conf", conf)
    old = {k: spark.conf.get(k, None) for k in pairs}
    for k, v in pairs.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows drawn for each bound between buckets.
DRAWN = 4


def set_aside(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with columns named like one of ``names`` (case ignored) kept under their name with underscores added."""
    taken = {c.lower() for c in df.columns} | {n.lower() for n in names}
    renamed = {}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            new = c + "_"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            renamed[c] = new
    return df.withColumnsRenamed(renamed)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def buckets_in_order(rows: DataFrame, key: str, tie: str, text: str, bucket_bytes: int, a_core: int) -> tuple[DataFrame, int]:
    """(``rows`` with ``bucket`` and ``first``, number of buckets).

    Buckets 0, 1, ... are ranges of (key, tie) in ascending order, null keys first. Each begins with a row of the table, so
    none is empty; ``first`` marks rows equal to that. Their number follows from the bytes of ``text`` and the cluster's cores
    (``a_core`` for each, at least). A run of equal keys is cut by ``tie`` (a long); rows equal in both are one bucket. Only bounds reach the driver and
    the tasks: about DRAWN rows, and one, for every ``bucket_bytes``, so they grow with the input (choose ``bucket_bytes`` with it).
    """
    keyed = rows.withColumn("_at", F.struct(F.col(key).isNotNull().alias("a"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("b"), F.col(tie).alias("c")))
    size = keyed.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("bytes"), F.min("_at").alias("least")).first()
    if not size["n"]:
        return rows.withColumns({"bucket": F.lit(0), "first": F.lit(True)}), 1
    wanted = max(-(-(size["bytes"] or 0) // bucket_bytes), a_core * rows.sparkSession.sparkContext.defaultParallelism)
    share = min(1.0, max(1000, DRAWN * wanted) / size["n"])
    drawn = sorted(tuple(r["_at"]) for r in keyed.where(F.rand(7) < share).select("_at").collect())
    step = max(1.0, len(drawn) / wanted)
    bounds = sorted({tuple(size["least"]), *(drawn[int(i * step)] for i in range(int(len(drawn) / step)))})
    kind = "struct<a: boolean, b: bigint, c: bigint>"
    width = max(1, round(len(bounds) ** 0.5))
    known = lambda values, of: F.from_json(F.lit(json.dumps(values)), of)
    record = lambda v: dict(zip("abc", v, strict=True))
    grid = [[record(b) for b in bounds[i : i + width]] for i in range(0, len(bounds), width)]
    outer, inner = known([g[0] for g in grid], f"array<{kind}>"), known(grid, f"array<array<{kind}>>")
    line = F.size(F.filter(outer, lambda b: b <= F.col("_at"))) - 1
    bucket = let(line, lambda k: k * width + F.size(F.filter(F.get(inner, k), lambda b: b <= F.col("_at"))) - 1)
    found = keyed.withColumn("bucket", bucket)
    first = F.get(F.get(inner, F.floor(F.col("bucket") / width).cast("int")), (F.col("bucket") % width).cast("int")) == F.col("_at")
    return found.withColumn("first", first).drop("_at"), len(bounds)
