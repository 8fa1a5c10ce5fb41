"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. quality classifier: documents scored below the threshold go;
2. line-first quality rules: failing lines go, then documents that fail the base rules or lose too much;
3. SimHash near-duplicates: one document of each group stays;
4. mixing: documents (or parts of them) are taken, some twice, so that sources meet their targets;
5. byte-level BPE: the ids of every text that is left, with digests of them and of what they decode to.

Defined results: null, empty and blank texts fall at stage 2 at the latest (fewer than 50 words); repeated rows are near-duplicates
of each other, so one stays; rows with a null doc_id are kept, one of each group; rows with a null source are a source of their
own; an empty table gives no rows; extra columns go through all stages but the last. Texts are never cut.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwerk.llm import byte_bpe, mixing, quality_classifier, quality_rules, simhash
from panelwerk.llm.common import drop_folder, free_name, shared_dir, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labelled rows of its own input; keeps what op1 predicts as 1."""
    weights = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "_score")
    scored = quality_classifier.score_texts(docs, weights, column=score)
    return scored.where(F.col(score) >= quality_classifier.THRESHOLD).select(*docs.columns)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.cleaned_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = byte_bpe.encode_documents(docs.select("doc_id", "source", "text"))
    return made.select(
        "doc_id",
        "source",
        "bpe.n_tokens",
        F.sha2("bpe.ids", 256).alias("ids_sha256"),
        F.sha2("bpe.decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", clean_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Neither a trained classifier nor XXH64 fingerprints can be expressed in DuckDB's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:  # the stage before has been read for the last time
            drop_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
