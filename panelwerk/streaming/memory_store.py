"""Translation memory as a store of runs: a batch of approvals is written as it is, and runs are merged now and then.

Batch n is written as the run of batches n to n, by key bucket. When FAN runs of one length stand side by side, they become one run of FAN times the
length; so a row is rewritten as often as the logarithm of the number of batches, and a batch costs in proportion to its own size, on average.
Which runs there are after batch n follows from n alone, so a batch that runs again (after a failure, or on restart) writes the
same files again. A merged run's parts are removed by the next batch, when nothing can ask for them any more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.memory import latest_memory

FAN, BUCKETS = 4, 8
SCHEMA = "series_id long, source string, target string, batch long, bucket int"


def runs_after(batch: int) -> list[tuple[int, int]]:
    """(first, last) of the runs that hold batches 0 to ``batch``, oldest first."""
    found, first, left = [], 0, batch + 1
    size = 1
    while size * FAN <= left:
        size *= FAN
    while left:
        while left >= size:
            found.append((first, first + size - 1))
            first, left = first + size, left - size
        size //= FAN
    return found


def merges_of(batch: int) -> list[tuple[list[tuple[int, int]], tuple[int, int]]]:
    """The merges that batch ``batch`` brings about: (parts, whole), short ones first."""
    made, size = [], 1
    while (batch + 1) % (size * FAN) == 0:
        first = batch + 1 - size * FAN
        made.append(([(first + k * size, first + (k + 1) * size - 1) for k in range(FAN)], (first, batch)))
        size *= FAN
    return made


def _path(folder: str, run: tuple[int, int]) -> str:
    return f"{folder}/run={run[0]:012d}-{run[1]:012d}"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _read(spark: SparkSession, folder: str, runs: list[tuple[int, int]]) -> DataFrame:
    return spark.read.schema(SCHEMA).option("basePath", folder).parquet(*(_path(folder, r) for r in runs))


def _latest(rows: DataFrame) -> DataFrame:
    """The last batch's row of each key."""
    keyed = rows.withColumn("_hash", F.xxhash64("source"))
    found = keyed.groupBy("series_id", "_hash", "source").agg(F.max_by("target", "batch").alias("target"), F.max("batch").alias("batch"), F.first("bucket").alias("bucket"))
    return found.drop("_hash")


def _write(rows: DataFrame, folder: str, run: tuple[int, int]) -> None:
    placed = rows.select("series_id", "source", "target", "batch", F.pmod(F.xxhash64("series_id", "source"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    placed.write.mode("overwrite").partitionBy("bucket").parquet(_path(folder, run))


def memory_writer(folder: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: each batch of approvals (series_id, text, translation, ord) goes into the store in ``folder``."""

    def write(approved: DataFrame, batch_id: int) -> None:
        spark = approved.sparkSession
        files, _ = _files(spark, folder)
        if batch_id:  # what the batch before has merged
            for parts, _whole in merges_of(batch_id - 1):
                for run in parts:
                    if run not in runs_after(batch_id - 1):
                        files.delete(_files(spark, _path(folder, run))[1], True)
        _write(latest_memory(approved).withColumn("batch", F.lit(batch_id).cast("long")), folder, (batch_id, batch_id))
        for parts, whole in merges_of(batch_id):
            _write(_latest(_read(spark, folder, parts)), folder, whole)

    return write


def read_memory(spark: SparkSession, folder: str) -> DataFrame:
    """(series_id, source, target): the memory as of the last batch whose runs are all written."""
    files, path = _files(spark, folder)
    names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    done = {tuple(int(x) for x in n.removeprefix("run=").split("-")) for n in names if n.startswith("run=") and files.exists(_files(spark, f"{folder}/{n}/_SUCCESS")[1])}
    for last in sorted({b for _, b in done}, reverse=True):
        runs = runs_after(last)
        if done.issuperset(runs):
            return _latest(_read(spark, folder, runs)).select("series_id", "source", "target")
    return spark.createDataFrame([], SCHEMA).select("series_id", "source", "target")
