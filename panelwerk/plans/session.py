"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it on a cluster. Where it is unset (tests on one machine) a new folder is made and set.
    """
    sc = spark.sparkContext
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # read when a checkpoint is made
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(given)
        return given
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` made once: its rows are written to the shared folder, where they outlive a lost executor, and its lineage ends there.

    The files go when no DataFrame, and no query made from one, refers to them any more. Inputs that an operator or a query reads several
    times are shared in this way; select the columns that are needed before.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def _set(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session for a while."""
    names = {"adaptive": "spark.sql.adaptive.enabled", "all_keys": "spark.sql.requireAllClusterKeysForCoPartition"}
    before = {n: spark.conf.get(names[n]) for n in values}
    try:
        for n, value in values.items():
            spark.conf.set(names[n], value)
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(names[n], value)


def together(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` made once, with the rows of equal ``keys`` in one partition. A plan that adapts does not tell how its rows lie, so this one is fixed."""
    with _set(df.sparkSession, adaptive="false"):
        return checkpointed(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys))


def co_located(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``make()`` made once, planned so that tables that lie together by some of a join's keys are not shuffled for the others.

    For tables of ``together`` whose keys have few rows each, as the pages of an album; the settings hold for this plan and what it makes on its way.
    """
    with _set(spark, adaptive="false", all_keys="false"):
        return checkpointed(make())


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder that the library wrote and needs no more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch sent to Python, about; one row is a batch at least.
BATCH_BYTES = 32 << 20


def python_workers(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers find this package where the driver has it, and bound their Arrow batches by rows and bytes.

    The bounds are settings of the session, read when a plan runs, so they stay; they are only ever lowered. On a cluster the package is
    installed or sent with ``--py-files``; then the added path does no harm.
    """
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < _bytes(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def _bytes(value: str) -> int:
    """A size as Spark writes it, as a number."""
    found = re.fullmatch(r"(-?[0-9]+)([kmg]?)b?", value.strip().lower())
    return int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[found[2]] if found else 0
